"""Templates and word lists of the sample generators."""

# Fixed values.
DIAGNOSES = {'viêm phổi': {'icd10': 'J18.9', 'name_vi': 'Viêm phổi không xác định'},
 'viêm phổi cộng đồng': {'icd10': 'J18.9', 'name_vi': 'Viêm phổi cộng đồng'},
 'tăng huyết áp': {'icd10': 'I10', 'name_vi': 'Tăng huyết áp nguyên phát'},
 'đái tháo đường type 2': {'icd10': 'E11.9', 'name_vi': 'Đái tháo đường type 2'},
 'đái tháo đường': {'icd10': 'E11.9', 'name_vi': 'Đái tháo đường'},
 'trào ngược dạ dày thực quản': {'icd10': 'K21.9', 'name_vi': 'Trào ngược dạ dày thực quản'},
 'viêm dạ dày': {'icd10': 'K29.9', 'name_vi': 'Viêm dạ dày'},
 'viêm phổi mắc phải': {'icd10': 'J18.9', 'name_vi': 'Viêm phổi mắc phải'},
 'hen suyễn': {'icd10': 'J45.9', 'name_vi': 'Hen suyễn'},
 'bệnh phổi tắc nghẽn mạn tính': {'icd10': 'J44.9', 'name_vi': 'Bệnh phổi tắc nghẽn mạn tính'},
 'suy tim': {'icd10': 'I50.9', 'name_vi': 'Suy tim'},
 'nhồi máu cơ tim': {'icd10': 'I21.9', 'name_vi': 'Nhồi máu cơ tim'},
 'đột quỵ': {'icd10': 'I64', 'name_vi': 'Đột quỵ'},
 'viêm gan B': {'icd10': 'B18.1', 'name_vi': 'Viêm gan B mạn tính'},
 'viêm khớp dạng thấp': {'icd10': 'M06.9', 'name_vi': 'Viêm khớp dạng thấp'},
 'loét dạ dày': {'icd10': 'K25.9', 'name_vi': 'Loét dạ dày'},
 'sỏi thận': {'icd10': 'N20.0', 'name_vi': 'Sỏi thận'},
 'viêm bàng quang': {'icd10': 'N30.9', 'name_vi': 'Viêm bàng quang'},
 'nhiễm trùng tiết niệu': {'icd10': 'N39.0', 'name_vi': 'Nhiễm trùng tiết niệu'},
 'viêm mũi dị ứng': {'icd10': 'J30.4', 'name_vi': 'Viêm mũi dị ứng'}}
SYMPTOMS = {'ho': ['ho', 'ho khan', 'ho đờm', 'ho ra máu'],
 'sốt': ['sốt cao', 'sốt nhẹ', 'sốt không', 'ủn ỉn sốt'],
 'đau': ['đau đầu', 'đau bụng', 'đau ngực', 'đau lưng', 'đau khớp'],
 'khó thở': ['khó thở', 'thở nhanh', 'thở khò khè', 'thở hụt hơi'],
 'mệt': ['mệt mỏi', 'mệt', 'kiệt sức', 'uể oải'],
 'buồn nôn': ['buồn nôn', 'nôn', 'nôn ói'],
 'tiêu chảy': ['tiêu chảy', 'đi lỏng', 'phân lỏng'],
 'táo bón': ['táo bón', 'đi cầu khó'],
 'chóng mặt': ['chóng mặt', 'hoa mắt', 'ý whơi'],
 'phù': ['phù chân', 'phù mặt', 'phù toàn thân'],
 'vàng da': ['vàng da', 'vàng mắt', 'vàng da niêm mạc'],
 'xuất huyết': ['xuất huyết da', 'bầm tím', 'chảy máu'],
 'đờm': ['đờm', 'đờm xanh', 'đờm vàng', 'đờm trắng'],
 'nghẹt mũi': ['nghẹt mũi', 'chảy mũi', 'mũi tắc'],
 'đau họng': ['đau họng', 'nuốt đau', 'nuốt khó']}
DRUGS = {'paracetamol': {'rxcui': '161', 'name': 'Acetaminophen', 'strength': '500mg'},
 'paracetamol 500mg': {'rxcui': '161', 'name': 'Acetaminophen 500mg', 'strength': '500mg'},
 'paracetamol 1g': {'rxcui': '161', 'name': 'Acetaminophen 1g', 'strength': '1g'},
 'ceftriaxone': {'rxcui': '8628', 'name': 'Ceftriaxone', 'strength': '1g'},
 'ceftriaxone 1g': {'rxcui': '8628', 'name': 'Ceftriaxone 1g', 'strength': '1g'},
 'amoxicillin': {'rxcui': '723', 'name': 'Amoxicillin', 'strength': '500mg'},
 'amoxicillin 500mg': {'rxcui': '723', 'name': 'Amoxicillin 500mg', 'strength': '500mg'},
 'metformin': {'rxcui': '6809', 'name': 'Metformin', 'strength': '500mg'},
 'metformin 500mg': {'rxcui': '6809', 'name': 'Metformin 500mg', 'strength': '500mg'},
 'omeprazole': {'rxcui': '7646', 'name': 'Omeprazole', 'strength': '20mg'},
 'omeprazole 20mg': {'rxcui': '7646', 'name': 'Omeprazole 20mg', 'strength': '20mg'},
 'amlodipine': {'rxcui': '32937', 'name': 'Amlodipine', 'strength': '5mg'},
 'amlodipine 5mg': {'rxcui': '32937', 'name': 'Amlodipine 5mg', 'strength': '5mg'},
 'aspirin': {'rxcui': '1191', 'name': 'Aspirin', 'strength': '81mg'},
 'aspirin 81mg': {'rxcui': '1191', 'name': 'Aspirin 81mg', 'strength': '81mg'},
 'losartan': {'rxcui': '52175', 'name': 'Losartan', 'strength': '50mg'},
 'atorvastatin': {'rxcui': '617312', 'name': 'Atorvastatin', 'strength': '20mg'},
 'pantoprazole': {'rxcui': '40790', 'name': 'Pantoprazole', 'strength': '40mg'},
 'ciprofloxacin': {'rxcui': '2556', 'name': 'Ciprofloxacin', 'strength': '500mg'},
 'azithromycin': {'rxcui': '18631', 'name': 'Azithromycin', 'strength': '500mg'},
 'prednisolone': {'rxcui': '8640', 'name': 'Prednisolone', 'strength': '5mg'}}
LAB_TESTS = {'CBC': ['WBC', 'RBC', 'Hemoglobin', 'Hematocrit'],
 'sinh hóa': ['Glucose', 'Creatinine', 'BUN', 'ALT', 'AST', 'Cholesterol', 'Triglyceride', 'HDL', 'LDL'],
 'điện giải': ['Na+', 'K+', 'Ca2+', 'Mg2+'],
 'viêm': ['CRP', 'ESR', 'PCT'],
 'chức năng gan': ['ALT', 'AST', 'GGT', 'Bilirubin'],
 'chức năng thận': ['Creatinine', 'BUN', 'eGFR']}
LAB_VALUES = {'WBC': ('5.0-10.0 G/L', '12.5 G/L'),
 'RBC': ('4.5-5.5 T/L', '4.2 T/L'),
 'Hemoglobin': ('120-160 g/L', '95 g/L'),
 'Hematocrit': ('36-46%', '32%'),
 'Glucose': ('70-100 mg/dL', '126 mg/dL'),
 'Creatinine': ('0.6-1.2 mg/dL', '1.5 mg/dL'),
 'BUN': ('7-20 mg/dL', '25 mg/dL'),
 'ALT': ('7-56 U/L', '85 U/L'),
 'AST': ('10-40 U/L', '72 U/L'),
 'Cholesterol': ('<200 mg/dL', '245 mg/dL'),
 'Triglyceride': ('<150 mg/dL', '180 mg/dL'),
 'HDL': ('>40 mg/dL', '35 mg/dL'),
 'LDL': ('<100 mg/dL', '165 mg/dL'),
 'CRP': ('<10 mg/L', '85 mg/L'),
 'ESR': ('0-20 mm/h', '45 mm/h'),
 'Na+': ('136-145 mmol/L', '132 mmol/L'),
 'K+': ('3.5-5.0 mmol/L', '5.8 mmol/L')}
NEGATION_TEMPLATES = ['Bệnh nhân không {symptom}.', 'Không có biểu hiện {symptom}.', 'Không thấy {symptom}.', 'Chưa ghi nhận {symptom}.', 'Loại trừ {diagnosis}.',
 'Không phải {diagnosis}.', 'Bệnh nhân hết {symptom}.']
HISTORICAL_TEMPLATES = ['Tiền sử {diagnosis}.', 'Có tiền sử {diagnosis}.', 'Đã từng bị {diagnosis}.', 'Trước đây mắc {diagnosis}.', 'BN có {diagnosis} từ trước.']
FAMILY_TEMPLATES = ['Bố bệnh nhân bị {diagnosis}.', 'Mẹ có tiền sử {diagnosis}.', 'Gia đình có người bị {diagnosis}.', 'Ông bà bệnh nhân từng bị {diagnosis}.']
ICD_CONTEXTS = ['Chẩn đoán: {mention}', 'Bệnh nhân bị {mention}', 'Phát hiện {mention}', 'Tiền sử {mention}', 'Có {mention}', 'Bị {mention}', 'Mắc {mention}',
 '{mention} được ghi nhận', 'Xác định {mention}', 'BN được chẩn đoán {mention}']
DRUG_CONTEXTS = ['Điều trị: {mention}', 'Kê đơn {mention}', 'Dùng {mention}', 'Uống {mention}', 'Tiêm {mention}', 'Sử dụng {mention}', 'BN được prescrible {mention}',
 '{mention} được chỉ định', 'Dùng thuốc {mention}', 'Uống thuốc {mention}']
