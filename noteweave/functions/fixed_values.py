"""Word lists, patterns and tables of the extraction rules, as they must be for equal results."""

# Fixed values. Order matters: alternations take the first item that fits.
LAB_TEST_NAMES = ['WBC', 'NEUT%', 'NEUT#', 'LYMPH%', 'LYMPH#', 'RBC', 'HGB', 'HCT', 'MCV', 'MCH', 'MCHC', 'PLT', 'MPV', 'PDW', 'Glucose', 'GLU', 'Creatinin', 'CRE',
 'BUN', 'Urea', 'AST', 'ALT', 'GGT', 'ALP', 'TP', 'ALB', 'Total Bilirubin', 'TBIL', 'Direct Bilirubin', 'DBIL', 'Cholesterol', 'CHOL', 'Triglyceride',
 'TG', 'HDL', 'LDL', 'LDL-C', 'VLDL', 'eGFR', 'LDH', 'Troponin', 'CPK', 'CK-MB', 'BNP', 'NT-proBNP', 'Na', 'K', 'Cl', 'Ca', 'Mg', 'Phosphate', 'TSH',
 'FT3', 'FT4', 'T3', 'T4', 'pH', 'Protein', 'Glucose', 'Ketone', 'Blood', 'Leukocyte', 'PT', 'INR', 'APTT', 'Fibrinogen', 'D-dimer', 'CRP', 'ESR',
 'Procalcitonin', 'PCT', 'ABO', 'Rh', 'tổng phân tích tế bào máu', 'tbm', 'tế bào máu', 'huyết đồ', 'công thức máu', 'CTM', 'đường huyết',
 'đường máu', 'chức năng gan', 'chức năng thận', 'ion đồ', 'điện giải']
LAB_PHRASES = [('tổng phân tích tế bào máu', 'Tổng phân tích tế bào máu'), ('huyết đồ', 'Huyết đồ'), ('công thức máu', 'Công thức máu'),
 ('chức năng gan', 'Chức năng gan'), ('chức năng thận', 'Chức năng thận'), ('điện giải đồ', 'Điện giải đồ'), ('ion đồ', 'Ion đồ'),
 ('đường huyết', 'Đường huyết')]
LAB_SYNONYMS = {'wbc': 'WBC',
 'rbc': 'RBC',
 'hgb': 'HGB',
 'hct': 'HCT',
 'plt': 'PLT',
 'glu': 'Glucose',
 'cre': 'Creatinin',
 'bun': 'Urea',
 'ast': 'AST',
 'alt': 'ALT',
 'tbil': 'Total Bilirubin',
 'chol': 'Cholesterol',
 'tg': 'Triglyceride',
 'tbm': 'Tổng phân tích tế bào máu',
 'ctm': 'Công thức máu'}
COMMON_DRUGS = ['paracetamol', 'acetaminophen', 'aspirin', 'ibuprofen', 'metformin', 'amlodipine', 'losartan', 'metoprolol', 'atenolol', 'bisoprolol', 'carvedilol',
 'ceftriaxone', 'omeprazole', 'esomeprazole', 'pantoprazole', 'simvastatin', 'atorvastatin', 'rosuvastatin', 'lisinopril', 'enalapril', 'ramipril',
 'hydrochlorothiazide', 'furosemide', 'spironolactone', 'azithromycin', 'clarithromycin', 'amoxicillin', 'metronidazole', 'gliclazide', 'glimepiride',
 'sitagliptin', 'vildagliptin']
DRUG_CONTEXTS = ['thuốc\\s+\\w+', 'dùng\\s+\\w+', 'uống\\s+\\w+', 'tiêm\\s+\\w+', 'điều trị\\s+\\w+', 'đã\\s+(?:sử dụng|dùng|uống)\\s+\\w+',
 'đang\\s+(?:dùng|sử dụng)\\s+\\w+', 'kê\\s+\\w+']
DISEASE_KEYWORDS = ['viêm phổi cộng đồng', 'viêm phổi mắc phải', 'viêm phổi', 'viêm phế quản', 'viêm dạ dày', 'viêm gan B', 'viêm gan C', 'viêm gan virus', 'viêm gan',
 'viêm ruột', 'viêm mũi dị ứng', 'viêm mũi', 'viêm họng', 'viêm màng não', 'viêm amidan', 'viêm xoang', 'viêm túi mật', 'viêm khớp dạng thấp',
 'viêm khớp', 'viêm thần kinh', 'viêm cơ tim', 'viêm phúc mạc', 'viêm bìu', 'viêm bao quy đầu', 'viêm cổ tử cung', 'viêm nội mạc tử cung',
 'viêm ống cổ tử cung', 'viêm phần phụ', 'viêm tử cung', 'viêm bàng quang', 'viêm da cơ địa', 'viêm da dị ứng', 'viêm da tiếp xúc',
 'viêm loét đại trực tràng', 'viêm loét miệng', 'viêm miệng', 'viêm mô tế bào', 'trào ngược dạ dày thực quản', 'trào ngược dạ dày', 'trào ngược',
 'đái tháo đường type 2', 'đái tháo đường type 1', 'đái tháo đường', 'tiểu đường', 'tăng huyết áp nguyên phát', 'tăng huyết áp thứ phát',
 'tăng huyết áp', 'cao huyết áp', 'huyết áp cao', 'hen suyễn', 'hen phế quản', 'phổi tắc nghẽn', 'bệnh phổi tắc nghẽn', 'đau thượng vị', 'đau dạ dày',
 'khó tiêu', 'ợ hơi', 'ợ chua', 'tức ngực', 'đau ngực', 'đau bụng', 'đau đầu', 'đau lưng', 'đau cơ', 'đau khớp', 'đau tim', 'ho gà', 'ho khan',
 'ho đờm', 'sốt xuất huyết', 'sốt ret', 'sốt dengue', 'sốt malaria', 'sốt phát ban', 'sốt virus', 'sốt kèm', 'tiêu chảy cấp', 'tiêu chảy mãn',
 'táo bón mãn', 'mất ngủ', 'lo âu', 'trầm cảm', 'rối loạn lo âu', 'rối loạn giấc ngủ', 'rối loạn tiêu hóa', 'rối loạn nhịp tim', 'rối loạn lipid máu',
 'rối loạn chuyển hóa', 'rối loạn tuyến giáp', 'suy thận', 'suy tim', 'suy gan', 'suy hô hấp', 'suy giảm miễn dịch', 'tăng cholesterol',
 'tăng triglyceride', 'tăng đường huyết', 'tăng acid uric', 'hạ đường huyết', 'hạ canxi máu', 'hạ kali máu', 'hạ natri máu', 'tăng kali máu',
 'tăng canxi máu', 'bướu cổ', 'basedow', 'hashimoto', 'ung thư', 'khối u', 'u lành tính', 'u ác tính', 'polyp', 'nhiễm trùng huyết',
 'nhiễm trùng tiết niệu', 'nhiễm trùng', 'nhiễm nấm', 'nhiễm khuẩn', 'nhiễm virus', 'lao phổi', 'lao', 'nhồi máu cơ tim', 'tai biến mạch máu não',
 'đột quỵ', 'xuất huyết não', 'xơ gan', 'xơ vữa động mạch', 'gout', 'thống phong', 'lupus ban đỏ', 'dị ứng', 'quá mẫn', 'phù quinck', 'sốc phản vệ',
 'hen', 'co thắt phế quản', 'cơn hen', 'cơn đau thắt ngực', 'đau thắt ngực', 'nhồi máu', 'tắc mạch', 'thuyên tắc', 'giãn tĩnh mạch',
 'suy giãn tĩnh mạch', 'trĩ', 'nứt hậu môn', 'mụn trứng cá', 'viêm da', 'chàm', ' eczema', 'psoriasis', 'vảy nến', ' zona', 'herpes', 'HIV', 'AIDS',
 'viêm não', 'viêm màng não', 'viêm tủy', 'động kinh', ' Parkinson', 'Alzheimer', 'sa sút trí tuệ', 'loạn thần', 'tâm thần phân liệt',
 'rối loạn lưỡng cực', 'rối loạn cảm xúc', 'chán nản', 'stress', 'mệt mỏi mãn tính', 'xạ trị', 'hóa trị', 'cắt cụt', 'ghép', 'ghép thận', 'ghép gan',
 'ghép tim', 'chạy thận', 'lọc máu', 'thẩm phân', 'oxy', 'thở máy', 'đặt nội khí quản', 'đặt sonde', ' sonde dạ dày', 'ống thông', ' catheter']
ENGLISH_DISEASES = ['\\b(?:GERD|GORD|GERD)\\b', '\\b(?:diabetes|DM|T1DM|T2DM)\\b', '\\b(?:hypertension|HTN|high blood pressure)\\b',
 '\\b(?:asthma|COPD|pneumonia|bronchitis)\\b', '\\b(?:gastritis|peptic ulcer|GERD)\\b', '\\b(?:hepatitis|liver disease)\\b',
 '\\b(?:arthritis|osteoarthritis|rheumatoid)\\b', '\\b(?:cancer|carcinoma|tumor|malignancy)\\b', '\\b(?:infection|inflammation|injury)\\b']
DIAGNOSTIC_MARKERS = ['chẩn\\s+đoán', 'được\\s+chẩn\\s+đoán', 'chẩn\\s+đoán\\s+là', 'bệnh\\s+chính', 'bệnh\\t+hiểu', 'primary\\s+diagnosis']
KNOWN_DIAGNOSES = ['viêm phổi', 'viêm phổi cộng đồng', 'viêm phổi mắc phải', 'viêm phế quản', 'viêm gan', 'viêm gan B', 'viêm gan C', 'viêm dạ dày', 'viêm màng não',
 'viêm khớp', 'viêm bàng quang', 'đái tháo đường', 'đái tháo đường type', 'tiểu đường', 'tăng huyết áp', 'cao huyết áp', 'huyết áp cao', 'trào ngược',
 'trào ngược dạ dày', 'hen suyễn', 'hen phế quản', 'hen', 'nhồi máu', 'nhồi máu cơ tim', 'tai biến', 'tai biến mạch máu não', 'đột quỵ',
 'xuất huyết não', 'suy tim', 'suy thận', 'suy gan', 'nhiễm trùng', 'nhiễm trùng tiết niệu', 'nhiễm trùng huyết', 'xơ gan', 'xơ vữa động mạch',
 'đau thượng vị']
SYMPTOM_MARKERS = ['triệu chứng', 'biểu hiện', 'phàn nàn', 'thấy', 'kêu']
SYMPTOM_WORDS = ['ho', 'đau', 'sốt', 'tức', 'khó', 'mệt', 'ngứa', 'ợ']
DIAGNOSED_MARKERS = ['chẩn đoán', 'được chẩn đoán', 'xác định', 'chẩn đoán:', 'chẩn đoán là', 'confirm', 'diagnosed', 'confirmed', 'diagnosis:']

# Fixed values: (pattern, kind, priority) of assertion cues.
CUES = [('không\\b', 'NEGATION', 10), ('chưa\\b', 'NEGATION', 10), ('ko\\b', 'NEGATION', 10), ('k\\b', 'NEGATION', 5), ('không\\s+có\\b', 'NEGATION', 15),
 ('chưa\\s+ghi\\s+nhận\\b', 'NEGATION', 20), ('chưa\\s+ghi\\s+nhận\\s+bệnh', 'NEGATION', 25), ('không\\s+ghi\\s+nhận\\b', 'NEGATION', 20),
 ('không\\s+ghi\\s+nhận\\s+bệnh', 'NEGATION', 25), ('không\\s+thấy\\b', 'NEGATION', 20), ('không\\s+xuất\\s+hiện\\b', 'NEGATION', 20),
 ('loại\\s+trừ\\b', 'NEGATION', 20), ('loại\\s+trừ\\s+bệnh', 'NEGATION', 25), ('âm\\s+tính\\s+với\\b', 'NEGATION', 25),
 ('dương\\s+tính\\s+với\\b', 'NEGATION', 15), ('không\\s+bình\\s+thường\\b', 'NEGATION', 20), ('bình\\s+thường\\b', 'NEGATION', 15),
 ('bình\\s+thường\\s+về\\b', 'NEGATION', 20), ('không\\s+phải\\b', 'NEGATION', 20), ('không\\s+còn\\b', 'NEGATION', 20), ('hết\\s+', 'NEGATION', 15),
 ('đã\\s+hết\\b', 'NEGATION', 20), ('tạm\\s+thời\\s+không\\b', 'NEGATION', 20),
 ('không\\s+(ho|sốt|đau|sốt|khó\\s+thở|buồn|nôn|tiêu\\s+chảy|mệt|chóng\\s+mặt)', 'NEGATION', 25), ('\\bno\\b', 'NEGATION', 10),
 ('\\bnot\\b', 'NEGATION', 10), ('\\bwithout\\b', 'NEGATION', 10), ('\\bnegative\\b', 'NEGATION', 15), ('\\bruled\\s+out\\b', 'NEGATION', 25),
 ('\\babsent\\b', 'NEGATION', 15), ('\\bdenies\\b', 'NEGATION', 20), ('\\bdenied\\b', 'NEGATION', 20), ('tiền\\s+sử\\b', 'HISTORICAL', 20),
 ('tiền\\s+sử\\s+bệnh\\b', 'HISTORICAL', 25), ('có\\s+tiền\\s+sử\\b', 'HISTORICAL', 25), ('có\\s+tiền\\s+sử\\s+bệnh\\b', 'HISTORICAL', 30),
 ('đã\\s+từng\\b', 'HISTORICAL', 20), ('từng\\b', 'HISTORICAL', 15), ('trước\\s+đây\\b', 'HISTORICAL', 20), ('trước\\s+đó\\b', 'HISTORICAL', 20),
 ('trước\\s+khi\\b', 'HISTORICAL', 20), ('cách\\s+đây\\b', 'HISTORICAL', 20), ('từng\\s+điều\\s+trị\\b', 'HISTORICAL', 25),
 ('đã\\s+điều\\s+trị\\b', 'HISTORICAL', 25), ('đã\\s+sử\\s+dụng\\b', 'HISTORICAL', 25), ('từng\\s+sử\\s+dụng\\b', 'HISTORICAL', 25),
 ('bệnh\\s+cũ\\b', 'HISTORICAL', 20), ('tình\\s+trạng\\s+cũ\\b', 'HISTORICAL', 25), ('cũ\\s+có\\b', 'HISTORICAL', 20),
 ('đã\\s+có\\b', 'HISTORICAL', 20), ('lâu\\s+năm\\b', 'HISTORICAL', 15), ('mắc\\s+từ\\s+trước\\b', 'HISTORICAL', 20),
 ('từ\\s+lâu\\b', 'HISTORICAL', 15), ('\\bhistory\\s+of\\b', 'HISTORICAL', 20), ('\\bhad\\b', 'HISTORICAL', 15), ('\\bprevious\\b', 'HISTORICAL', 15),
 ('\\bpast\\b', 'HISTORICAL', 15), ('\\bformer\\b', 'HISTORICAL', 15), ('\\bonce\\s+had\\b', 'HISTORICAL', 20),
 ('\\bwas\\s+diagnosed\\b', 'HISTORICAL', 20), ('\\bbố\\b', 'FAMILY', 15), ('\\bmẹ\\b', 'FAMILY', 15), ('\\bcha\\b', 'FAMILY', 15),
 ('\\bông\\b', 'FAMILY', 15), ('\\bbà\\b', 'FAMILY', 15), ('\\banh\\b', 'FAMILY', 10), ('\\bchị\\b', 'FAMILY', 10), ('\\bem\\b', 'FAMILY', 10),
 ('\\bcon\\b', 'FAMILY', 10), ('người\\s+nhà\\b', 'FAMILY', 20), ('gia\\s+đình\\b', 'FAMILY', 20), ('gia\\s+đình\\s+có\\b', 'FAMILY', 25),
 ('họ\\s+hàng\\b', 'FAMILY', 20), ('họ\\s+hàng\\s+bên\\b', 'FAMILY', 25), ('ông\\s+bà\\b', 'FAMILY', 20), ('cha\\s+mẹ\\b', 'FAMILY', 25),
 ('anh\\s+chị\\s+em\\b', 'FAMILY', 25), ('tiền\\s+sử\\s+gia\\s+đình\\b', 'FAMILY', 30), ('tiền\\s+sử\\s+gia\\s+đình\\s+bệnh\\b', 'FAMILY', 35),
 ('bệnh\\s+nhân\\s+có\\s+người\\s+nhà\\b', 'FAMILY', 25), ('\\bfather\\b', 'FAMILY', 15), ('\\bmother\\b', 'FAMILY', 15),
 ('\\bparent\\b', 'FAMILY', 15), ('\\bsibling\\b', 'FAMILY', 15), ('\\bfamily\\b', 'FAMILY', 20), ('\\bfamily\\s+history\\b', 'FAMILY', 25),
 ('\\bhereditary\\b', 'FAMILY', 25), ('\\bgenetic\\b', 'FAMILY', 20)]
CONJUNCTIONS = [('nhưng\\b', 'contrast'), ('tuy\\s+nhiên\\b', 'contrast'), ('song\\b', 'contrast'), ('hiện\\s+tại\\b', 'current'), ('còn\\b', 'contrast'),
 ('tuy\\b', 'contrast'), ('mặc\\s+dù\\b', 'contrast'), ('thế\\s+mà\\b', 'contrast'), ('đồng\\s+thời\\b', 'concurrent')]
DELIMITERS = ['[.。]', '[;；]', '[!！]', '[?？]']
HISTORICAL_SECTIONS = ['tiền\\s+sử\\s+bệnh\\b', 'quá\\s+khứ\\b', 'tiền\\s+sử\\b', 'bệnh\\s+sử\\b', 'past\\s+history\\b', 'history\\b']

# Fixed values of normalisation; dictionaries are applied in this order.
ABBREVIATIONS = {'ts': 'tiền sử',
 'tsử': 'tiền sử',
 'tăng huyết áp': 'tăng huyết áp',
 'huyết áp': 'huyết áp',
 'b/a': 'bệnh án',
 'bt': 'bình thường',
 'kt': 'không thấy',
 'kn': 'không',
 'k': 'không',
 'kp': 'không phải',
 'ktg': 'không ghi nhận',
 'ct': 'chưa',
 'kq': 'kết quả',
 'cls': 'cận lâm sàng',
 'ls': 'lâm sàng',
 'shs': 'số huyết sắc tố',
 'bc': 'bạch cầu',
 'hct': 'hematocrit',
 'hb': 'hemoglobin',
 'ht': 'hồng cầu',
 'pt': ' prothrombin time',
 'aptt': 'activated partial thromboplastin time',
 'ck': 'creatinine kinase',
 'ckm': 'creatinine kinase myocardial fraction',
 'nt': 'nhịp tim',
 'huyết động': 'huyết động',
 'cl': 'chẩn đoán',
 'cp': 'cận phẫu thuật',
 'tt': 'tiến triển',
 'td': 'triệu chứng',
 'thdt': 'theo dõi',
 'tn': 'tăng',
 'cgd': 'cơn gió',
 'cv': 'cơn xoắn',
 'cơn': 'cơn',
 'nmct': 'nhồi máu cơ tim',
 'tdn': 'tiểu đường',
 'blt': 'bệnh lý tim',
 'bld': 'bệnh lý đường',
 'tmc': 'tổn thương mạch vành',
 'copd': 'bệnh phổi tắc nghẽn mạn tính',
 'gerd': 'bệnh trào ngược dạ dày'}
SYNONYMS = {'viêm phổi': 'viêm phổi',
 'viêm phế quản': 'viêm phế quản',
 'viêm mũi dị ứng': 'viêm mũi dị ứng',
 'viêm dạ dày': 'viêm dạ dày',
 'viêm dạ dày tá tràng': 'viêm dạ dày tá tràng',
 'viêm khớp dạng thấp': 'viêm khớp dạng thấp',
 'viêm gan': 'viêm gan',
 'viêm bàng quang': 'viêm bàng quang',
 'viêm đại tràng': 'viêm đại tràng',
 'viêm mũi họng': 'viêm mũi họng',
 'viêm phổi cộng đồng': 'viêm phổi cộng đồng',
 'bệnh phổi tắc nghẽn mạn tính': 'bệnh phổi tắc nghẽn mạn tính',
 'bệnh trào ngược dạ dày': 'bệnh trào ngược dạ dày',
 'trào ngược dạ dày': 'trào ngược dạ dày',
 'suy tim': 'suy tim',
 'suy thận': 'suy thận',
 'suy giáp': 'suy giáp',
 'cường giáp': 'cường giáp',
 'tăng huyết áp': 'tăng huyết áp',
 'huyết áp cao': 'tăng huyết áp',
 'cao huyết áp': 'tăng huyết áp',
 'đái tháo đường': 'đái tháo đường',
 'tiểu đường': 'đái tháo đường',
 'động kinh': 'động kinh',
 'co giật': 'động kinh',
 'đau nửa đầu': 'đau nửa đầu',
 'migraine': 'đau nửa đầu',
 'mất ngủ': 'mất ngủ',
 'khó ngủ': 'mất ngủ',
 'rối loạn giấc ngủ': 'mất ngủ',
 'trầm cảm': 'trầm cảm',
 'rối loạn lo âu': 'rối loạn lo âu',
 'lo âu': 'rối loạn lo âu',
 'béo phì': 'béo phì',
 'thừa cân': 'béo phì',
 'hen suyễn': 'hen phế quản',
 'hen': 'hen phế quản',
 'viêm phế quản dị ứng': 'hen phế quản',
 'nhồi máu cơ tim': 'nhồi máu cơ tim',
 'đau tim': 'đau thắt ngực',
 'đau ngực': 'đau thắt ngực',
 'đau thắt ngực': 'đau thắt ngực',
 'rung nhĩ': 'rung nhĩ',
 'đột quỵ': 'đột quỵ',
 'tai biến mạch não': 'đột quỵ',
 'nghiện thuốc lá': 'nghiện thuốc lá',
 'hút thuốc': 'nghiện thuốc lá',
 'sỏi thận': 'sỏi thận',
 'sỏi đường tiết niệu': 'sỏi thận',
 'nhiễm trùng tiết niệu': 'nhiễm trùng tiết niệu',
 'nhiễm trùng đường tiết niệu': 'nhiễm trùng tiết niệu',
 'viêm đường tiết niệu': 'nhiễm trùng tiết niệu',
 'xơ gan': 'xơ gan',
 'đau thắt lưng': 'đau thắt lưng',
 'đau lưng': 'đau thắt lưng',
 'đau bụng': 'đau bụng',
 'bệnh mạch vành': 'bệnh mạch vành',
 'bệnh tim thiếu máu': 'bệnh mạch vành',
 'bệnh tim': 'bệnh tim',
 'loét dạ dày': 'loét dạ dày',
 'loét tá tràng': 'loét tá tràng',
 'hội chứng ruột kích thích': 'hội chứng ruột kích thích',
 'nhiễm trùng hô hấp': 'nhiễm trùng hô hấp',
 'nhiễm trùng hô hấp trên': 'nhiễm trùng hô hấp trên'}
INGREDIENT_SYNONYMS = {'paracetamol': 'paracetamol', 'acetaminophen': 'paracetamol', 'tylenol': 'paracetamol', 'panadol': 'paracetamol', 'efferalgan': 'paracetamol'}
BRAND_ALIASES = {'aspirin': 'aspirin',
 'asp': 'aspirin',
 'metformin': 'metformin',
 'met': 'metformin',
 'omeprazole': 'omeprazole',
 'pantoprazole': 'pantoprazole',
 'amlodipine': 'amlodipine',
 'norvasc': 'amlodipine',
 'atorvastatin': 'atorvastatin',
 'lipitor': 'atorvastatin',
 'simvastatin': 'simvastatin',
 'zocor': 'simvastatin',
 'clopidogrel': 'clopidogrel',
 'plavix': 'clopidogrel',
 'bisoprolol': 'bisoprolol',
 'concor': 'bisoprolol',
 'losartan': 'losartan',
 'cozaar': 'losartan',
 'metronidazole': 'metronidazole',
 'flagyl': 'metronidazole',
 'ciprofloxacin': 'ciprofloxacin',
 'cipro': 'ciprofloxacin',
 'azithromycin': 'azithromycin',
 'zithromax': 'azithromycin',
 'amoxicillin': 'amoxicillin',
 'amoxil': 'amoxicillin',
 'cefuroxime': 'cefuroxime',
 'ceftriaxone': 'ceftriaxone',
 'rocephin': 'ceftriaxone',
 'prednisolone': 'prednisolone',
 'prednison': 'prednisolone',
 'dexamethasone': 'dexamethasone',
 'decadron': 'dexamethasone',
 'alprazolam': 'alprazolam',
 'xanax': 'alprazolam',
 'diazepam': 'diazepam',
 'valium': 'diazepam',
 'zopiclone': 'zopiclone',
 'imovane': 'zopiclone',
 'sertraline': 'sertraline',
 'zoloft': 'sertraline',
 'sitagliptin': 'sitagliptin',
 'januvia': 'sitagliptin',
 'glibenclamide': 'glibenclamide',
 'gliburide': 'glibenclamide',
 'spironolactone': 'spironolactone',
 'aldactone': 'spironolactone'}
DOSE_FORMS = {'tablet': 'tablet',
 'tab': 'tablet',
 'capsule': 'capsule',
 'cap': 'capsule',
 'injection': 'injection',
 'inj': 'injection',
 'solution': 'solution',
 'sol': 'solution',
 'cream': 'cream',
 'ointment': 'ointment',
 'drops': 'drops',
 'syrup': 'syrup',
 'spray': 'spray',
 'patch': 'patch',
 'inhaler': 'inhaler',
 'powder': 'powder',
 'granules': 'granules',
 'suspension': 'suspension'}
BRAND_INDICATORS = ['thuốc', 'bản', 'hãng', 'pfizer', 'novartis', 'gsK', 'merck']
STANDARD_STRENGTHS = {'aspirin': (325.0, 'MG'),
 'metformin': (1000.0, 'MG'),
 'atorvastatin': (20.0, 'MG'),
 'amlodipine': (5.0, 'MG'),
 'losartan': (50.0, 'MG'),
 'bisoprolol': (5.0, 'MG'),
 'spironolactone': (25.0, 'MG'),
 'clopidogrel': (75.0, 'MG'),
 'omeprazole': (20.0, 'MG'),
 'pantoprazole': (40.0, 'MG'),
 'alprazolam': (0.5, 'MG'),
 'diazepam': (5.0, 'MG'),
 'zopiclone': (7.5, 'MG'),
 'sertraline': (50.0, 'MG'),
 'amoxicillin': (500.0, 'MG'),
 'ciprofloxacin': (500.0, 'MG'),
 'azithromycin': (500.0, 'MG'),
 'cefuroxime': (500.0, 'MG'),
 'metronidazole': (500.0, 'MG'),
 'ceftriaxone': (1.0, 'G'),
 'sitagliptin': (100.0, 'MG'),
 'glibenclamide': (5.0, 'MG'),
 'prednisolone': (5.0, 'MG'),
 'dexamethasone': (4.0, 'MG'),
 'paracetamol': (500.0, 'MG'),
 'acetaminophen': (500.0, 'MG')}
DETAIL_SIGNALS = ['mg', 'ml', 'g/', 'lần', 'ngày', 'buổi', 'liều', 'uống', 'tiêm', 'viên', 'gói', 'tremor', 'đau đầu', 'đau ngực', 'khó thở', 'sốt', 'ho']

# Fixed values of text variants.
KEYBOARD_NEIGHBOURS = {'a': ['q', 's', 'z'],
 'b': ['v', 'n', 'g', 'h'],
 'c': ['x', 'v', 'd', 'f'],
 'd': ['s', 'e', 'r', 'f', 'c', 'x'],
 'e': ['w', 's', 'd', 'r'],
 'f': ['d', 'r', 't', 'g', 'v', 'c'],
 'g': ['f', 't', 'y', 'h', 'b', 'v'],
 'h': ['g', 't', 'y', 'u', 'j', 'n', 'b'],
 'i': ['u', 'j', 'k', 'o'],
 'j': ['h', 'y', 'u', 'i', 'k', 'm', 'n'],
 'k': ['j', 'u', 'i', 'o', 'l', 'm'],
 'l': ['k', 'i', 'o', 'p'],
 'm': ['n', 'j', 'k'],
 'n': ['b', 'h', 'j', 'm'],
 'o': ['i', 'k', 'l', 'p'],
 'p': ['o', 'l'],
 'q': ['w', 'a'],
 'r': ['e', 'd', 'f', 't'],
 's': ['a', 'w', 'e', 'd', 'x', 'z'],
 't': ['r', 'f', 'g', 'y'],
 'u': ['y', 'j', 'k', 'i'],
 'v': ['c', 'f', 'g', 'b'],
 'w': ['q', 'a', 's', 'e'],
 'x': ['s', 'd', 'c'],
 'y': ['t', 'g', 'h', 'u'],
 'z': ['a', 's', 'x'],
 'đ': ['d'],
 'ă': ['â', 'a'],
 'ô': ['o', 'ơ'],
 'ơ': ['ô', 'ư'],
 'ư': ['ơ']}
DIACRITIC_VARIANTS = {'á': ['à', 'a', 'ả', 'ã', 'ạ'],
 'é': ['è', 'e', 'ẻ', 'ẽ', 'ẹ'],
 'í': ['ì', 'i', 'ỉ', 'ĩ', 'ị'],
 'ó': ['ò', 'o', 'ỏ', 'õ', 'ọ'],
 'ú': ['ù', 'u', 'ủ', 'ũ', 'ụ'],
 'ớ': ['ờ', 'ơ', 'ở', 'ỡ', 'ợ'],
 'ứ': ['ừ', 'ư', 'ử', 'ữ', 'ự'],
 'ý': ['ỳ', 'y', 'ỷ', 'ỹ', 'ỵ'],
 'ă': ['a', 'à', 'á', 'ả', 'ã', 'ạ'],
 'ắ': ['ă', 'à', 'á', 'ả', 'ã', 'ạ'],
 'ơ': ['o', 'ô', 'ò', 'ó', 'ỏ', 'õ', 'ọ'],
 'â': ['a', 'à', 'á', 'ả', 'ã', 'ạ'],
 'ê': ['e', 'è', 'é', 'ẻ', 'ẽ', 'ẹ'],
 'ô': ['o', 'ò', 'ó', 'ỏ', 'õ', 'ọ'],
 'đ': ['d']}
PATIENT_PRONOUNS = ['Bệnh nhân', 'BN', 'Người bệnh', 'Bệnh', 'BN nam', 'BN nữ']

# Patterns of the baseline drug parser.
BASE_STRENGTH = r"(?i)(\d+(?:[.,]\d+)?)\s*(mg|g|ml|mcg|iu|%)"
BASE_FORMS = "tablet|capsule|injection|solution|cream|ointment|drops|syrup|spray|patch|inhaler|powder|granules|tab|cap|inj|sol|crem|ung"
BASE_ROUTES = "po|oral|iv|im|sc|topical|inh|inhale|rectal|sublingual|sl|intranasal|transdermal|ophthalmic|otic|vaginal"
BASE_FREQUENCIES = r"q\d+h?|qd|bid|tid|qid|daily|weekly|monthly|once|twice|thrice|prn|qhs|qam|qpm|qod|ac|pc|stat"

# Headers of history sections.
SECTION_CUE = r"(?imU)^[ \t]*\d+[\.\)][ \t]+tiền\s+sử\b|^[ \t]*-*[ \t]*tiền\s+sử\s+bệnh\s+hiện\s+tại\b"
SECTION_HEADER = r"(?imU)^[ \t]*\d+[\.\)][ \t]+tiền\s+sử\b|^[ \t]*-*[ \t]*tiền\s+sử\s+bệnh\s+hiện\s+tại\b|^tiền\s+sử\s+bệnh\s+(?=\s)(?!\S)"

# Forms that exclude each other, and penalties and boosts of the ontology checks.
CONFLICTING_FORMS = [("tablet", "injection"), ("injection", "tablet"), ("cream", "tablet"), ("tablet", "cream"), ("syrup", "tablet"), ("tablet", "syrup")]
CHILD_PENALTY, EXCLUDE_PENALTY, FORM_PENALTY = 0.25, 1.0, 0.2
INCLUDE_SHARE, INCLUDE_HIT, INCLUDE_MOST = 0.15, 0.05, 0.25
STRENGTH_PENALTIES = {0.5: 0.5, 0.2: 0.3, 0.0: 0.15}

# Words of the simple paraphrase and what they may become.
PARAPHRASES = {
    "bệnh nhân": ["BN", "người bệnh", "bệnh"],
    "ho": ["ho", "ho khan", "ho đờm"],
    "sốt": ["sốt", "sốt cao", "nóng sốt"],
    "đau": ["đau", "đau nhức", "đau đớn"],
    "dùng": ["dùng", "sử dụng", "uống"],
}
