"""The built-in knowledge bases."""

# 38 ICD-10 entries.
ICD = [{'code': 'K21.9',
  'name_en': 'Gastro-oesophageal reflux disease without oesophagitis',
  'name_vi': 'Bệnh trào ngược dạ dày thực quản không có viêm thực quản',
  'parent_code': 'K21',
  'chapter': 'XI',
  'synonyms': ['GERD', 'GORD', 'acid reflux disease', 'reflux disease'],
  'aliases': ['trào ngược dạ dày', 'trào ngược', 'GERD', 'bệnh trào ngược'],
  'include_terms': ['ợ nóng', 'ợ chua', 'acid reflux', 'gastro-oesophageal reflux']},
 {'code': 'K25.9',
  'name_en': 'Gastric ulcer, unspecified, without haemorrhage or perforation',
  'name_vi': 'Loét dạ dày không xác định không chảy máu hoặc thủng',
  'parent_code': 'K25',
  'chapter': 'XI',
  'synonyms': ['gastric ulcer', 'stomach ulcer'],
  'aliases': ['loét dạ dày', 'loét bao tử', 'dạ dày'],
  'include_terms': ['đau dạ dày', 'loét dạ dày']},
 {'code': 'K26.9',
  'name_en': 'Duodenal ulcer, unspecified, without haemorrhage or perforation',
  'name_vi': 'Loét tá tràng không xác định không chảy máu hoặc thủng',
  'parent_code': 'K26',
  'chapter': 'XI',
  'synonyms': ['duodenal ulcer', 'peptic ulcer duodenum'],
  'aliases': ['loét tá tràng', 'loét tá tràng không biến chứng'],
  'include_terms': ['đau tá tràng', 'loét tá tràng']},
 {'code': 'K29.9',
  'name_en': 'Gastritis and duodenitis, unspecified',
  'name_vi': 'Viêm dạ dày và viêm tá tràng không xác định',
  'parent_code': 'K29',
  'chapter': 'XI',
  'synonyms': ['gastritis', 'duodenitis', 'gastric inflammation'],
  'aliases': ['viêm dạ dày', 'viêm dạ dày tá tràng', 'đau dạ dày'],
  'include_terms': ['đau dạ dày', 'nóng rát dạ dày', 'viêm dạ dày']},
 {'code': 'K58.9',
  'name_en': 'Irritable bowel syndrome, unspecified',
  'name_vi': 'Hội chứng ruột kích thích không xác định',
  'parent_code': 'K58',
  'chapter': 'XI',
  'synonyms': ['IBS', 'irritable bowel syndrome', 'spastic colon'],
  'aliases': ['hội chứng ruột kích thích', 'ruột kích thích'],
  'include_terms': ['đau bụng', 'rối loạn tiêu hóa', 'đi cầu không đều']},
 {'code': 'K70.30',
  'name_en': 'Alcoholic cirrhosis of liver without ascites',
  'name_vi': 'Xơ gan do rượu không có cổ trướng',
  'parent_code': 'K70',
  'chapter': 'XI',
  'synonyms': ['alcoholic cirrhosis', 'alcoholic liver cirrhosis'],
  'aliases': ['xơ gan do rượu', 'xơ gan', 'xơ gan nghiện rượu'],
  'include_terms': ['gan', 'xơ gan', 'cirrhosis']},
 {'code': 'A09',
  'name_en': 'Infectious gastroenteritis and colitis, unspecified',
  'name_vi': 'Viêm dạ dày ruột nhiễm trùng và viêm đại tràng không xác định',
  'parent_code': 'A09',
  'chapter': 'I',
  'synonyms': ['infectious gastroenteritis', 'gastroenteritis', 'food poisoning'],
  'aliases': ['viêm dạ dày ruột', 'tiêu chảy nhiễm trùng', 'ngộ độc thức ăn'],
  'include_terms': ['nôn', 'tiêu chảy', 'đau bụng', 'sốt']},
 {'code': 'I10',
  'name_en': 'Essential (primary) hypertension',
  'name_vi': 'Tăng huyết áp nguyên phát',
  'parent_code': 'I10',
  'chapter': 'IX',
  'synonyms': ['high blood pressure', 'HTN', 'hypertension', 'elevated blood pressure'],
  'aliases': ['tăng huyết áp', 'huyết áp cao', 'cao huyết áp', 'huyết áp'],
  'include_terms': ['huyết áp cao', 'tăng huyết áp']},
 {'code': 'I21.9',
  'name_en': 'Acute myocardial infarction, unspecified',
  'name_vi': 'Nhồi máu cơ tim cấp không xác định',
  'parent_code': 'I21',
  'chapter': 'IX',
  'synonyms': ['myocardial infarction', 'MI', 'heart attack', 'acute MI'],
  'aliases': ['nhồi máu cơ tim', 'nhồi máu', 'đau tim', 'tai biến mạch vành'],
  'include_terms': ['đau ngực', 'khó thở', 'đổ mồ hôi', 'buồn nôn']},
 {'code': 'I25.10',
  'name_en': 'Atherosclerotic heart disease of native coronary artery without angina pectoris',
  'name_vi': 'Bệnh tim do xơ vữa động mạch vành tự nhiên không có đau thắt ngực',
  'parent_code': 'I25',
  'chapter': 'IX',
  'synonyms': ['coronary artery disease', 'CAD', 'ischemic heart disease', 'atherosclerotic heart disease'],
  'aliases': ['bệnh mạch vành', 'xơ vữa động mạch vành', 'bệnh tim thiếu máu cơ tim'],
  'include_terms': ['đau ngực', 'mệt', 'khó thở khi gắng sức']},
 {'code': 'I48.9',
  'name_en': 'Atrial fibrillation and atrial flutter, unspecified',
  'name_vi': 'Rung nhĩ và cuồng động nhĩ không xác định',
  'parent_code': 'I48',
  'chapter': 'IX',
  'synonyms': ['atrial fibrillation', 'AF', 'AFib', 'irregular heartbeat'],
  'aliases': ['rung nhĩ', 'nhịp tim không đều', 'cuồng động nhĩ', 'rung tâm nhĩ'],
  'include_terms': ['nhịp tim nhanh', 'tim đập không đều', 'đánh trống ngực']},
 {'code': 'I50.9',
  'name_en': 'Heart failure, unspecified',
  'name_vi': 'Suy tim không xác định',
  'parent_code': 'I50',
  'chapter': 'IX',
  'synonyms': ['heart failure', 'cardiac failure', 'congestive heart failure'],
  'aliases': ['suy tim', 'suy tim sung huyết', 'suy tim cấp'],
  'include_terms': ['khó thở', 'phù chân', 'mệt', 'gan to']},
 {'code': 'I64',
  'name_en': 'Stroke, not specified as haemorrhage or infarction',
  'name_vi': 'Đột quỵ không xác định là xuất huyết hay nhồi máu',
  'parent_code': 'I64',
  'chapter': 'IX',
  'synonyms': ['stroke', 'cerebrovascular accident', 'CVA', 'brain attack'],
  'aliases': ['đột quỵ', 'tai biến mạch não', 'tai biến mạch máu não', 'đột quỵ não'],
  'include_terms': ['liệt', 'nói khó', 'mất ý thức', 'yếu nửa người']},
 {'code': 'J06.9',
  'name_en': 'Acute upper respiratory infection, unspecified',
  'name_vi': 'Nhiễm trùng hô hấp trên cấp tính không xác định',
  'parent_code': 'J06',
  'chapter': 'X',
  'synonyms': ['URI', 'upper respiratory infection', 'common cold', 'acute upper respiratory infection'],
  'aliases': ['nhiễm trùng hô hấp', 'cảm cúm', 'viêm mũi họng', 'nhiễm trùng hô hấp trên'],
  'include_terms': ['ho', 'sổ mũi', 'đau họng', 'hắt hơi', 'nghẹt mũi']},
 {'code': 'J18.9',
  'name_en': 'Pneumonia, unspecified',
  'name_vi': 'Viêm phổi không xác định',
  'parent_code': 'J18',
  'chapter': 'X',
  'synonyms': ['pneumonia', 'lung infection', 'community acquired pneumonia'],
  'aliases': ['viêm phổi', 'viêm phổi cộng đồng', 'pneumonia'],
  'include_terms': ['sốt', 'ho', 'khó thở', 'đau ngực', 'đờm']},
 {'code': 'J20.9',
  'name_en': 'Acute bronchitis, unspecified',
  'name_vi': 'Viêm phế quản cấp tính không xác định',
  'parent_code': 'J20',
  'chapter': 'X',
  'synonyms': ['acute bronchitis', 'bronchitis', 'acute bronchiolitis'],
  'aliases': ['viêm phế quản cấp', 'viêm phế quản', 'phế quản'],
  'include_terms': ['ho', 'khó thở', 'sốt', 'đờm', 'thở khò khè']},
 {'code': 'J30.4',
  'name_en': 'Allergic rhinitis, unspecified',
  'name_vi': 'Viêm mũi dị ứng không xác định',
  'parent_code': 'J30',
  'chapter': 'X',
  'synonyms': ['allergic rhinitis', 'hay fever', 'pollen allergy', 'seasonal allergies'],
  'aliases': ['viêm mũi dị ứng', 'sốt mùa', 'dị ứng mũi', 'viêm mũi do dị ứng'],
  'include_terms': ['hắt hơi', 'nghẹt mũi', 'chảy nước mũi', 'ngứa mũi']},
 {'code': 'J44.9',
  'name_en': 'Chronic obstructive pulmonary disease, unspecified',
  'name_vi': 'Bệnh phổi tắc nghẽn mạn tính không xác định',
  'parent_code': 'J44',
  'chapter': 'X',
  'synonyms': ['COPD', 'chronic obstructive pulmonary disease', 'chronic bronchitis', 'emphysema'],
  'aliases': ['bệnh phổi tắc nghẽn mạn tính', 'COPD', 'phổi tắc nghẽn mạn'],
  'include_terms': ['ho', 'khó thở', 'thở khò khè', 'đờm']},
 {'code': 'J45.9',
  'name_en': 'Other and unspecified asthma',
  'name_vi': 'Hen phế quản không xác định',
  'parent_code': 'J45',
  'chapter': 'X',
  'synonyms': ['asthma', 'bronchial asthma', 'asthmatic bronchitis'],
  'aliases': ['hen suyễn', 'hen', 'viêm phế quản dị ứng', 'bệnh hen'],
  'include_terms': ['thở khò khè', 'khó thở', 'ho', 'co thắt phế quản']},
 {'code': 'E03.9',
  'name_en': 'Hypothyroidism, unspecified',
  'name_vi': 'Suy giáp không xác định',
  'parent_code': 'E03',
  'chapter': 'IV',
  'synonyms': ['hypothyroidism', 'underactive thyroid', 'thyroid insufficiency'],
  'aliases': ['suy giáp', 'giảm chức năng tuyến giáp', 'nhiễm độc giáp', 'tuyến giáp kém'],
  'include_terms': ['mệt', 'tăng cân', 'lạnh', 'táo bón', 'da khô']},
 {'code': 'E05.90',
  'name_en': 'Thyrotoxicosis, unspecified without thyrotoxic crisis or storm',
  'name_vi': 'Nhiễm độc giáp không xác định không có khủng hoảng nhiễm độc giáp',
  'parent_code': 'E05',
  'chapter': 'IV',
  'synonyms': ['hyperthyroidism', 'thyrotoxicosis', 'overactive thyroid', 'Graves disease'],
  'aliases': ['nhiễm độc giáp', 'cường giáp', 'basedow', ' Graves'],
  'include_terms': ['tim đập nhanh', 'sụt cân', 'run tay', 'đổ mồ hôi']},
 {'code': 'E11.9',
  'name_en': 'Type 2 diabetes mellitus without complications',
  'name_vi': 'Đái tháo đường type 2 không biến chứng',
  'parent_code': 'E11',
  'chapter': 'IV',
  'synonyms': ['diabetes type 2', 'T2DM', 'type 2 diabetes', 'NIDDM'],
  'aliases': ['đái tháo đường', 'tiểu đường', 'bệnh đường', 'tiểu đường type 2'],
  'include_terms': ['đường huyết cao', 'uống nhiều nước', 'tiểu nhiều']},
 {'code': 'E66.9',
  'name_en': 'Obesity, unspecified',
  'name_vi': 'Béo phì không xác định',
  'parent_code': 'E66',
  'chapter': 'IV',
  'synonyms': ['obesity', 'overweight', 'adiposity'],
  'aliases': ['béo phì', 'thừa cân', 'béo', 'overweight'],
  'include_terms': ['BMI cao', 'tích mỡ']},
 {'code': 'F17.210',
  'name_en': 'Nicotine dependence, cigarettes, uncomplicated',
  'name_vi': 'Phụ thuộc nicotin, thuốc lá, không biến chứng',
  'parent_code': 'F17',
  'chapter': 'V',
  'synonyms': ['nicotine dependence', 'tobacco dependence', 'smoking addiction', 'cigarette dependence'],
  'aliases': ['nghiện thuốc lá', 'nghiện thuốc', 'hút thuốc', 'phụ thuộc nicotin'],
  'include_terms': ['thuốc lá', 'hút thuốc', 'nicotine']},
 {'code': 'F32.9',
  'name_en': 'Major depressive disorder, single episode, unspecified',
  'name_vi': 'Rối loạn trầm cảm nặng, giai đoạn đơn, không xác định',
  'parent_code': 'F32',
  'chapter': 'V',
  'synonyms': ['depression', 'major depression', 'depressive disorder', 'clinical depression'],
  'aliases': ['trầm cảm', 'rối loạn trầm cảm', 'mất tinh thần', 'u sầm'],
  'include_terms': ['buồn', 'mất hứng thú', 'rối loạn giấc ngủ', 'mệt']},
 {'code': 'F41.1',
  'name_en': 'Generalized anxiety disorder',
  'name_vi': 'Rối loạn lo âu tổng quát',
  'parent_code': 'F41',
  'chapter': 'V',
  'synonyms': ['generalized anxiety disorder', 'GAD', 'anxiety neurosis', 'anxiety disorder'],
  'aliases': ['rối loạn lo âu', 'lo âu', 'rối loạn lo âu tổng quát', 'GAD'],
  'include_terms': ['lo âu', 'bồn chồn', 'căng thẳng', 'khó ngủ', 'mệt']},
 {'code': 'B18.1',
  'name_en': 'Chronic viral hepatitis B without delta-agent',
  'name_vi': 'Viêm gan virus B mạn tính không có delta agent',
  'parent_code': 'B18',
  'chapter': 'I',
  'synonyms': ['chronic hepatitis B', 'HBV', 'hep B'],
  'aliases': ['viêm gan B mạn', 'viêm gan B', 'viêm gan virus B', 'gan nhiễm mỡ B'],
  'include_terms': ['gan', 'viêm gan', 'vàng da', 'mệt']},
 {'code': 'B18.2',
  'name_en': 'Chronic viral hepatitis C',
  'name_vi': 'Viêm gan virus C mạn tính',
  'parent_code': 'B18',
  'chapter': 'I',
  'synonyms': ['chronic hepatitis C', 'HCV', 'hep C'],
  'aliases': ['viêm gan C mạn', 'viêm gan C', 'viêm gan virus C'],
  'include_terms': ['gan', 'viêm gan', 'mệt']},
 {'code': 'B34.9',
  'name_en': 'Viral infection, unspecified',
  'name_vi': 'Nhiễm virus không xác định',
  'parent_code': 'B34',
  'chapter': 'I',
  'synonyms': ['viral infection', 'virus infection', 'viraemia'],
  'aliases': ['nhiễm virus', 'nhiễm trùng virus', 'cảm virus'],
  'include_terms': ['sốt', 'mệt', 'đau cơ']},
 {'code': 'G40.909',
  'name_en': 'Epilepsy, unspecified, not intractable, without status epilepticus',
  'name_vi': 'Động kinh không xác định, không khó trị, không có trạng thái động kinh',
  'parent_code': 'G40',
  'chapter': 'VI',
  'synonyms': ['epilepsy', 'seizure disorder', 'convulsive disorder', 'epileptic'],
  'aliases': ['động kinh', 'co giật', 'bệnh động kinh', 'suy giáp'],
  'include_terms': ['co giật', 'ngã', 'mất ý thức', 'cứng người']},
 {'code': 'G43.909',
  'name_en': 'Migraine, unspecified, not intractable, without status migrainosus',
  'name_vi': 'Đau nửa đầu không xác định, không khó trị, không có trạng thái đau nửa đầu',
  'parent_code': 'G43',
  'chapter': 'VI',
  'synonyms': ['migraine', 'migraine headache', 'hemicrania', 'sick headache'],
  'aliases': ['đau nửa đầu', 'migraine', 'đau đầu một bên', 'đau đầu migraine'],
  'include_terms': ['đau đầu', 'buồn nôn', 'nhạy cảm ánh sáng', 'hoa mắt']},
 {'code': 'G47.00',
  'name_en': 'Insomnia, unspecified',
  'name_vi': 'Mất ngủ không xác định',
  'parent_code': 'G47',
  'chapter': 'VI',
  'synonyms': ['insomnia', 'sleep disorder', 'sleeplessness', 'difficulty sleeping'],
  'aliases': ['mất ngủ', 'khó ngủ', 'rối loạn giấc ngủ', 'ngủ không sâu'],
  'include_terms': ['khó ngủ', 'thức giấc', 'ngủ ít', 'thiếu ngủ']},
 {'code': 'M06.9',
  'name_en': 'Rheumatoid arthritis, unspecified',
  'name_vi': 'Viêm khớp dạng thấp không xác định',
  'parent_code': 'M06',
  'chapter': 'XIII',
  'synonyms': ['rheumatoid arthritis', 'RA', 'chronic polyarthritis'],
  'aliases': ['viêm khớp dạng thấp', 'viêm khớp', 'thấp khớp', 'dạng thấp'],
  'include_terms': ['đau khớp', 'sưng khớp', 'cứng khớp', 'biến dạng khớp']},
 {'code': 'M54.5',
  'name_en': 'Low back pain',
  'name_vi': 'Đau thắt lưng',
  'parent_code': 'M54',
  'chapter': 'XIII',
  'synonyms': ['low back pain', 'lumbago', 'lumbar pain', 'lower back pain'],
  'aliases': ['đau thắt lưng', 'đau lưng', 'đau thắt lưng dưới', 'thoái hóa cột sống'],
  'include_terms': ['đau lưng', 'cứng lưng', 'đau thắt lưng']},
 {'code': 'M79.3',
  'name_en': 'Panniculitis, unspecified',
  'name_vi': 'Viêm mô mỡ không xác định',
  'parent_code': 'M79',
  'chapter': 'XIII',
  'synonyms': ['panniculitis', 'lipoedema', 'inflammation of subcutaneous fat'],
  'aliases': ['viêm mô mỡ', 'panniculitis', 'sưng mô mỡ'],
  'include_terms': ['sưng', 'đau', 'mô mỡ']},
 {'code': 'N18.3',
  'name_en': 'Chronic kidney disease, stage 3',
  'name_vi': 'Bệnh thận mạn tính giai đoạn 3',
  'parent_code': 'N18',
  'chapter': 'XIV',
  'synonyms': ['chronic kidney disease stage 3', 'CKD stage 3', 'moderate chronic renal failure'],
  'aliases': ['bệnh thận mạn giai đoạn 3', 'suy thận mạn giai đoạn 3', 'bệnh thận mạn'],
  'include_terms': ['thận', 'suy thận', 'creatinine cao', 'đạm máu']},
 {'code': 'N20.0',
  'name_en': 'Calculus of kidney',
  'name_vi': 'Sỏi thận',
  'parent_code': 'N20',
  'chapter': 'XIV',
  'synonyms': ['kidney stone', 'nephrolithiasis', 'renal calculus', 'kidney calculus'],
  'aliases': ['sỏi thận', 'sỏi đường tiết niệu', 'sỏi niệu quản', 'sỏi bàng quang'],
  'include_terms': ['đau thắt lưng', 'đau bụng dưới', 'tiểu máu', 'buồn nôn']},
 {'code': 'N39.0',
  'name_en': 'Urinary tract infection, site not specified',
  'name_vi': 'Nhiễm trùng đường tiết niệu không xác định vị trí',
  'parent_code': 'N39',
  'chapter': 'XIV',
  'synonyms': ['urinary tract infection', 'UTI', 'cystitis', 'bladder infection'],
  'aliases': ['nhiễm trùng tiết niệu', 'nhiễm trùng đường tiết niệu', 'viêm bàng quang', 'viêm đường tiết niệu'],
  'include_terms': ['tiểu rắt', 'tiểu buốt', 'đau khi tiểu', 'nước tiểu đục']}]

# 15 ICD-10 entries of the baseline.
ICD_BASE = [{'code': 'K21.0',
  'name': 'Gastro-oesophageal reflux disease with oesophagitis',
  'name_vi': 'Bệnh trào ngược dạ dày thực quản có viêm thực quản',
  'parent_code': 'K21',
  'chapter': 'XI',
  'synonyms': ['GERD with oesophagitis', 'reflux oesophagitis'],
  'aliases': []},
 {'code': 'K21.9',
  'name': 'Gastro-oesophageal reflux disease without oesophagitis',
  'name_vi': 'Bệnh trào ngược dạ dày thực quản không có viêm thực quản',
  'parent_code': 'K21',
  'chapter': 'XI',
  'synonyms': ['GERD', 'GORD', 'acid reflux'],
  'aliases': ['trào ngược dạ dày', 'trào ngược', 'gastroesophageal reflux']},
 {'code': 'K21',
  'name': 'Gastro-oesophageal reflux disease',
  'name_vi': 'Bệnh trào ngược dạ dày thực quản',
  'parent_code': 'K20',
  'chapter': 'XI',
  'synonyms': ['GERD', 'GORD'],
  'aliases': []},
 {'code': 'I10',
  'name': 'Essential (primary) hypertension',
  'name_vi': 'Tăng huyết áp nguyên phát',
  'parent_code': 'I10',
  'chapter': 'IX',
  'synonyms': ['high blood pressure', 'HTN'],
  'aliases': ['tăng huyết áp', 'huyết áp cao', 'cao huyết áp']},
 {'code': 'E11.9',
  'name': 'Type 2 diabetes mellitus without complications',
  'name_vi': 'Đái tháo đường type 2 không biến chứng',
  'parent_code': 'E11',
  'chapter': 'IV',
  'synonyms': ['diabetes type 2', 'T2DM', 'NIDDM'],
  'aliases': ['đái tháo đường', 'tiểu đường', 'bệnh đường']},
 {'code': 'E11',
  'name': 'Type 2 diabetes mellitus',
  'name_vi': 'Đái tháo đường type 2',
  'parent_code': 'E10',
  'chapter': 'IV',
  'synonyms': ['diabetes type 2', 'T2DM'],
  'aliases': []},
 {'code': 'J06.9',
  'name': 'Acute upper respiratory infection, unspecified',
  'name_vi': 'Nhiễm trùng hô hấp trên cấp tính không xác định',
  'parent_code': 'J06',
  'chapter': 'X',
  'synonyms': ['URI', 'common cold', 'upper respiratory infection'],
  'aliases': ['nhiễm trùng hô hấp', 'cảm cúm', 'viêm mũi']},
 {'code': 'J18.9',
  'name': 'Pneumonia, unspecified',
  'name_vi': 'Viêm phổi không xác định',
  'parent_code': 'J18',
  'chapter': 'X',
  'synonyms': ['pneumonia'],
  'aliases': ['viêm phổi']},
 {'code': 'R50.9',
  'name': 'Fever, unspecified',
  'name_vi': 'Sốt không xác định',
  'parent_code': 'R50',
  'chapter': 'XVIII',
  'synonyms': ['fever', 'pyrexia'],
  'aliases': ['sốt']},
 {'code': 'R51',
  'name': 'Headache',
  'name_vi': 'Đau đầu',
  'parent_code': 'R50',
  'chapter': 'XVIII',
  'synonyms': ['cephalgia', 'head pain'],
  'aliases': ['đau đầu']},
 {'code': 'R07.0',
  'name': 'Pain in throat',
  'name_vi': 'Đau họng',
  'parent_code': 'R07',
  'chapter': 'XVIII',
  'synonyms': ['sore throat', 'throat pain'],
  'aliases': ['đau họng', 'viêm họng']},
 {'code': 'R05', 'name': 'Cough', 'name_vi': 'Ho', 'parent_code': 'R00', 'chapter': 'XVIII', 'synonyms': ['tussis'], 'aliases': ['ho']},
 {'code': 'J45.9',
  'name': 'Other and unspecified asthma',
  'name_vi': 'Hen phế quản không xác định',
  'parent_code': 'J45',
  'chapter': 'X',
  'synonyms': ['asthma', 'bronchial asthma'],
  'aliases': ['hen suyễn', 'hen', 'viêm phế quản dị ứng']},
 {'code': 'K29.7',
  'name': 'Gastritis, unspecified',
  'name_vi': 'Viêm dạ dày không xác định',
  'parent_code': 'K29',
  'chapter': 'XI',
  'synonyms': ['gastritis'],
  'aliases': ['viêm dạ dày', 'đau dạ dày']},
 {'code': 'K30',
  'name': 'Functional dyspepsia',
  'name_vi': 'Khó tiêu chức năng',
  'parent_code': 'K30',
  'chapter': 'XI',
  'synonyms': ['indigestion', 'dyspepsia'],
  'aliases': ['khó tiêu', 'đầy hơi', 'ợ hơi']}]

# 28 drugs (rxcui, name, short name, ingredient, strength, brands, category).
DRUGS = [('161', 'Acetaminophen 500 MG Oral Tablet', 'Paracetamol 500mg', 'Acetaminophen', '500mg', ['Panadol', 'Efferalgan', 'Tylenol'], 'analgesic'),
 ('1191', 'Aspirin 81 MG Oral Tablet', 'Aspirin 81mg', 'Aspirin', '81mg', ['Bayer', 'Bufferin'], 'analgesic'),
 ('1192', 'Aspirin 325 MG Oral Tablet', 'Aspirin 325mg', 'Aspirin', '325mg', ['Bayer'], 'analgesic'),
 ('8628', 'Ceftriaxone 1 GM Injection', 'Ceftriaxone 1g', 'Ceftriaxone', '1g', ['Rocephin'], 'antibiotic'),
 ('723', 'Amoxicillin 500 MG Oral Capsule', 'Amoxicillin 500mg', 'Amoxicillin', '500mg', ['Amoxil', 'Moxatag'], 'antibiotic'),
 ('2556', 'Ciprofloxacin 500 MG Oral Tablet', 'Ciprofloxacin 500mg', 'Ciprofloxacin', '500mg', ['Cipro'], 'antibiotic'),
 ('18631', 'Azithromycin 500 MG Oral Tablet', 'Azithromycin 500mg', 'Azithromycin', '500mg', ['Zithromax', 'Azithrocin'], 'antibiotic'),
 ('83367', 'Cefuroxime 500 MG Oral Tablet', 'Cefuroxime 500mg', 'Cefuroxime', '500mg', ['Ceftin', 'Zinnat'], 'antibiotic'),
 ('1116635', 'Metronidazole 500 MG Oral Tablet', 'Metronidazole 500mg', 'Metronidazole', '500mg', ['Flagyl'], 'antibiotic'),
 ('6809', 'Metformin 500 MG Oral Tablet', 'Metformin 500mg', 'Metformin', '500mg', ['Glucophage', 'Fortamet'], 'antidiabetic'),
 ('860975', 'Metformin 850 MG Oral Tablet', 'Metformin 850mg', 'Metformin', '850mg', ['Glucophage'], 'antidiabetic'),
 ('316672', 'Glibenclamide 5 MG Oral Tablet', 'Glibenclamide 5mg', 'Glibenclamide', '5mg', ['Glyburide', 'DiaBeta'], 'antidiabetic'),
 ('861007', 'Metformin 1000 MG Oral Tablet', 'Metformin 1000mg', 'Metformin', '1000mg', ['Glucophage'], 'antidiabetic'),
 ('317541', 'Sitagliptin 100 MG Oral Tablet', 'Sitagliptin 100mg', 'Sitagliptin', '100mg', ['Januvia'], 'antidiabetic'),
 ('7646', 'Omeprazole 20 MG Delayed Release Oral Tablet', 'Omeprazole 20mg', 'Omeprazole', '20mg', ['Prilosec', 'Losec'], 'gastrointestinal'),
 ('32937', 'Amlodipine 5 MG Oral Tablet', 'Amlodipine 5mg', 'Amlodipine', '5mg', ['Norvasc'], 'cardiovascular'),
 ('52175', 'Losartan 50 MG Oral Tablet', 'Losartan 50mg', 'Losartan', '50mg', ['Cozaar'], 'cardiovascular'),
 ('617312', 'Atorvastatin 20 MG Oral Tablet', 'Atorvastatin 20mg', 'Atorvastatin', '20mg', ['Lipitor'], 'cardiovascular'),
 ('197361', 'Pantoprazole 40 MG Delayed Release Oral Tablet', 'Pantoprazole 40mg', 'Pantoprazole', '40mg', ['Protonix'], 'gastrointestinal'),
 ('314076', 'Bisoprolol 5 MG Oral Tablet', 'Bisoprolol 5mg', 'Bisoprolol', '5mg', ['Zebeta'], 'cardiovascular'),
 ('198211', 'Spironolactone 25 MG Oral Tablet', 'Spironolactone 25mg', 'Spironolactone', '25mg', ['Aldactone'], 'cardiovascular'),
 ('855332', 'Clopidogrel 75 MG Oral Tablet', 'Clopidogrel 75mg', 'Clopidogrel', '75mg', ['Plavix'], 'cardiovascular'),
 ('8640', 'Prednisolone 5 MG Oral Tablet', 'Prednisolone 5mg', 'Prednisolone', '5mg', ['Prelone', 'Orapred'], 'steroid'),
 ('285070', 'Dexamethasone 4 MG Oral Tablet', 'Dexamethasone 4mg', 'Dexamethasone', '4mg', ['Decadron'], 'steroid'),
 ('72407', 'Sertraline 50 MG Oral Tablet', 'Sertraline 50mg', 'Sertraline', '50mg', ['Zoloft'], 'psychiatric'),
 ('72509', 'Alprazolam 0.5 MG Oral Tablet', 'Alprazolam 0.5mg', 'Alprazolam', '0.5mg', ['Xanax'], 'psychiatric'),
 ('312961', 'Diazepam 5 MG Oral Tablet', 'Diazepam 5mg', 'Diazepam', '5mg', ['Valium'], 'psychiatric'),
 ('206977', 'Zopiclone 7.5 MG Oral Tablet', 'Zopiclone 7.5mg', 'Zopiclone', '7.5mg', ['Imovane'], 'psychiatric')]

# 19 drugs of the baseline.
DRUGS_BASE = [{'rxcui': '308135',
  'name': 'amlodipine 10 MG Oral Tablet',
  'ingredient': 'Amlodipine',
  'strength': '10 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '308136',
  'name': 'amlodipine 5 MG Oral Tablet',
  'ingredient': 'Amlodipine',
  'strength': '5 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '243670',
  'name': 'aspirin 81 MG Oral Tablet',
  'ingredient': 'Aspirin',
  'strength': '81 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '212033',
  'name': 'aspirin 325 MG Oral Tablet',
  'ingredient': 'Aspirin',
  'strength': '325 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '866436',
  'name': 'metoprolol succinate 50 MG Extended Release Tablet',
  'ingredient': 'Metoprolol Succinate',
  'strength': '50 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '866924',
  'name': 'metoprolol tartrate 50 MG Oral Tablet',
  'ingredient': 'Metoprolol Tartrate',
  'strength': '50 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '392085',
  'name': 'guaifenesin 200 MG Oral Tablet',
  'ingredient': 'Guaifenesin',
  'strength': '200 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '198240',
  'name': 'Guaifenesin 100 MG/5ML Oral Solution',
  'ingredient': 'Guaifenesin',
  'strength': '100 MG/5ML',
  'unit': 'MG/ML',
  'dose_form': 'solution',
  'tty': 'SCD'},
 {'rxcui': '7597',
  'name': 'nystatin 100000 UNT/ML Oral Suspension',
  'ingredient': 'Nystatin',
  'strength': '100000 UNT/ML',
  'unit': 'UNT/ML',
  'dose_form': 'suspension',
  'tty': 'SCD'},
 {'rxcui': '313782',
  'name': 'acetaminophen 325 MG Oral Tablet',
  'ingredient': 'Acetaminophen',
  'strength': '325 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '313783',
  'name': 'acetaminophen 500 MG Oral Tablet',
  'ingredient': 'Acetaminophen',
  'strength': '500 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '313797',
  'name': 'acetaminophen 650 MG Oral Tablet',
  'ingredient': 'Acetaminophen',
  'strength': '650 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '904475',
  'name': 'pravastatin sodium 40 MG Oral Tablet',
  'ingredient': 'Pravastatin',
  'strength': '40 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '1099279',
  'name': 'docusate sodium 100 MG Oral Capsule',
  'ingredient': 'Docusate Sodium',
  'strength': '100 MG',
  'unit': 'MG',
  'dose_form': 'capsule',
  'tty': 'SCD'},
 {'rxcui': '312935',
  'name': 'senna 8.6 MG Oral Tablet',
  'ingredient': 'Senna',
  'strength': '8.6 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '197527',
  'name': 'clonazepam 0.5 MG Oral Tablet',
  'ingredient': 'Clonazepam',
  'strength': '0.5 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '197528',
  'name': 'clonazepam 1.5 MG Oral Tablet',
  'ingredient': 'Clonazepam',
  'strength': '1.5 MG',
  'unit': 'MG',
  'dose_form': 'tablet',
  'tty': 'SCD'},
 {'rxcui': '360047',
  'name': 'chlorpheniramine 0.4 MG/ML Oral Solution',
  'ingredient': 'Chlorpheniramine',
  'strength': '0.4 MG/ML',
  'unit': 'MG/ML',
  'dose_form': 'solution',
  'tty': 'SCD'},
 {'rxcui': '1660761',
  'name': 'capsaicin 0.38 MG/ML Topical Cream',
  'ingredient': 'Capsaicin',
  'strength': '0.38 MG/ML',
  'unit': 'MG/ML',
  'dose_form': 'cream',
  'tty': 'SCD'}]
