"""Values that results depend on: vocabularies, tables, limits and patterns."""

from __future__ import annotations

# ---- Fixed values: these decide results and are stated as they are, in their own order. ----

FIELDS = ["date", "vehicle_num", "total_weight", "tare_weight", "net_weight", "company", "product", "type", "ticket_id", "issuer", "gps", "phone", "address"]

#: field -> labels (canonical then variants) and keywords
LABELS = {
    "total_weight": (["총중량", "총 중량", "Gross Weight", "총량", "합계중량", "합계 중량", "전체중량", "전체 중량", "Gross"], ["총", "합계", "전체", "계", "Gross"]),
    "tare_weight": (["공차중량", "공차 중량", "차중량", "차 중량", "Tare Weight", "빈차중량", "빈 차 중량", "공 차 중 량", "Tare"], ["공", "차", "빈", "공차", "Tare"]),
    "net_weight": (["실중량", "실 중량", "Net Weight", "순중량", "순 중량", "정미중량", "적재중량", "실 중 량", "Net"], ["실", "순", "정미", "적재", "적", "Net"]),
    "date": (["계량일자", "측정일자", "날짜", "Date", "계량 일자", "측정 일자", "일자", "일시", "일 시", "계량일"], ["계량", "측정", "날짜", "일자", "일시", "Date"]),
    "vehicle": (["차량번호", "차량 번호", "Truck No", "Lorry No", "차번호", "차 번호", "차량No", "차량 No", "차 량 번 호", "번호", "Truck", "Vehicle"], ["차량", "차", "번호", "Truck", "No"]),
    "company": (["거래처", "Customer", "거 래 처", "상호", "상 호", "회사명", "고객명", "업체명", "거ㄹh처"], ["거래", "상호", "회사", "업체", "고객"]),
    "product": (["품명", "Product", "Item", "품 명", "품목", "품종", "품종명", "제품명", "제품"], ["품명", "품목", "품종", "제품", "Product"]),
    "ticket_id": (["ID-NO", "계량번호", "Ticket No", "Slip No", "ID - NO", "IDNO", "계량 번호", "계량횟수", "순번", "No.", "Ticket"], ["ID", "계량", "번호", "순번", "Ticket", "No"]),
}
LABEL_THRESHOLD = {"date": 65.0, "vehicle": 70.0, "company": 60.0, "product": 60.0, "total_weight": 60.0, "tare_weight": 60.0, "net_weight": 60.0, "ticket_id": 70.0}
REACH = {"date": 150.0, "vehicle": 150.0, "company": 300.0, "product": 400.0, "phone": 150.0}
MERGE_GAP_X, MERGE_GAP_Y, MERGE_WORDS = 200.0, 20.0, 6
NEAR = {"up": -30.0, "down": 150.0, "line": 15.0, "right": 20.0, "below": 50.0, "line_weight": 0.5, "drop_weight": 3.0, "overlap": 0.5}
LAYOUT_DEFAULT = {"char": 10.0, "line": 20.0, "space": 5.0, "page": 1000.0}

DIGIT_LIKE = ("OoDlI|BSsZgq", "000111855299")
CONFUSABLE = ("BZOID", "82010")
UNIT_FIXES = [("k9", "kg"), ("K9", "kg"), ("kG", "kg"), ("kg9", "kg"), ("KG9", "KG"), ("Te1", "Tel"), ("TeI", "Tel"), ("Te l", "Tel")]
HANGUL_FIXES = [
    ("거래쳐", "거래처"), ("거ㄹh쳐", "거래처"), ("フㅓㄹh처", "거래처"), ("차랑", "차량"), ("차 랑", "차량"), ("차 번 호", "차량번호"), ("차번호", "차량번호"),
    ("충중량", "총중량"), ("충 중 량", "총중량"), ("총 중 량", "총중량"), ("공차중량", "공차중량"), ("공차 중량", "공차중량"), ("실중량", "실중량"), ("실 중 량", "실중량"),
    ("실 충 량", "실중량"), ("실충량", "실중량"), ("낱짜", "날짜"), ("날좌", "날짜"), ("낱 짜", "날짜"), ("날 짜", "날짜"), ("계량일자", "날짜"), ("샹호", "상호"),
    ("샹 호", "상호"), ("상 호", "상호"), ("샹  호", "상호"), ("샹   호", "상호"), ("상  호", "상호"), ("상   호", "상호"), ("품면", "품명"), ("품 면", "품명"),
    ("품 명", "품명"), ("제품명", "품명"), ("게근표", "계근표"), ("입 고", "입고"), ("출 고", "출고"),
]
NUMBER_RULES = [
    (r"(\d)O(\d)", "$10$2"), (r"(\d)O([,.])", "$10$2"), (r"([,.])OOO", "$1000"), (r"([,.])\s*O00", "$1000"), (r"(\d)l(\d)", "$11$2"), (r"(\d)I(\d)", "$11$2"),
    (r"(\d)B(\d)", "$18$2"), (r",BB", ",88"), (r"(\d)o(\d)", "$10$2"), (r"2O2", "202"), (r"(\d)B", "$18"), (r"B(\d)", "8$1"), (r"(\d)S", "$15"), (r"S(\d)", "5$1"), (r",,", ","),
]
#: What a text holds if any of the rules matches in it.
NUMBER_RULED = r"\d[OolIBS]|[BS]\d|[,.]\s*O|,BB|,,"
NUMBER_ROUNDS = 10
LABEL_RULES = [
    (r"[샹상]\s*[후호]", "상호"), (r"거\s*[래레]\s*[처쳐]", "거래처"), (r"품\s*[면명]", "품명"), (r"품\s*종\s*명\s*[랑]?\s*", "품명"), (r"제\s*품\s*[면명]", "제품명"),
    (r"[충총]\s*중\s*량", "총중량"), (r"공\s*차\s*중\s*량", "공차중량"), (r"실\s*[충중]\s*량", "실중량"), (r"[낱날]\s*[짜좌]", "날짜"), (r"계\s*량\s*일\s*자", "날짜"),
    (r"차\s*번\s*호", "차량번호"), (r"일\s*련\s*번\s*호", "일련번호"), (r"구\s*분", "구분"), (r"경\s*위\s*도", "GPS"),
]

NOISE_WORDS = ["공육을", "unle"]
MONTHS = {"Jan": "01", "Feb": "02", "Mar": "03", "Apr": "04", "May": "05", "Jun": "06", "Jul": "07", "Aug": "08", "Sep": "09", "Oct": "10", "Nov": "11", "Dec": "12"}
REGIONS = ["경기도", "강원도", "충청북도", "충청남도", "전라북도", "전라남도", "경상북도", "경상남도", "제주도", "서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종"]
CORP_WORDS = ["(주)", "주식회사", "Co.", "Inc.", "Corp.", "ENG"]
TRADE_WORDS = ["리사이클", "환경", "자원", "산업", "개발", "펄프", "제지", "장원"]
HEADER_WORDS = ["계량", "증명", "확인서", "전표", "발행"]
PHONE_WORDS = ["TEL", "Tel", "전화", "연락처", "H.P", "HP", "Fax", "FAX"]
TICKET_WORDS = ["ID-NO", "계량번", "계량횟", "계량회", "전표", "TICKET", "SLIP", "ID", "번호", "일련번호"]
LABEL_TOKENS = ["NO", "ID", "TEL", "FAX", "DATE", "N0"]
COMPANY_STOPS = ["품면", "품명", "품 명", "구분", "입고", "출고", "총중량", "실중량", "공차", "차량", "날짜", "보관용", "전화", "TEL", "FAX"]
PREFIX_STOPS = ["전화", "TEL", "FAX", "HP", "주소"]
COMPANY_BLACKLIST = ["경기도", "서울", "Tel", "TEL", "보관용", "차량", "계량", "전화", "FAX"]
UNIT_NOISE = ["k9", "kg", "ton", "pe", "m3"]
ISSUER_STOPS = ["경기도", "서울", "인천", "충남", "충북", "전남", "전북", "경남", "경북", "강원", "제주", "세종", "광주", "대전", "대구", "부산", "울산", "TEL", "FAX", "HP", "전화", "주소", "포승", "팔탄", "품목", "품명"]
PRODUCT_STOPS = ["총중량", "실중량", "공차중량", "중량", "계량", "확인", "차중량", "표"]
TRAILING_LABELS = ["품명", "제품", "구분", "날짜", "시간", "중량", "차량", "전표", "계량", "발행", "품종", "명랑"]
NEXT_LABELS = ["구분", "입고", "출고", "수량", "중량", "비고", "차량", "전표", "단가", "금액", "확인"]
COMPANY_EXCLUDED = ["kg", "ton", "입고", "출고", "총", "중량", "계량"]
WEIGHT_WORDS = {
    "total": (["총중량", "합계중량"], ["총", "합계"]),
    "tare": (["차중량", "공차중량", "빈차중량"], ["차중량", "공차", "빈차"]),
    "net": (["실중량", "순중량"], ["실", "순", "적"]),
}
DUPLICATE_FIELDS = ["vehicle_num", "ticket_id", "total_weight", "tare_weight", "net_weight", "company", "issuer", "product", "phone", "date"]
COMPARED_FIELDS = ["date", "vehicle_num", "total_weight", "tare_weight", "net_weight", "company", "product", "type", "ticket_id", "issuer", "gps", "phone"]

DATE_MONTH = r"(\d{4})[-/\.\s]+([A-Za-z]{3})[-/\.\s]+(\d{1,2})"
DATE_NUMERIC = r"(\d{2,4})[\.\-/]\s*(\d{1,2})[\.\-/]\s*(\d{1,2})"
DATE_NOISY = r"(\d{4})\s*[,.\-/]\s*(\d{1,2})\s*[,.\-/]\s*(\d{1,2})"
DATE_BARE = r"20\d{2}[-./]\d{1,2}[-./]\d{1,2}"
PLATES = [r"[가-힣]{2}\s*\d{2}\s*[가-힣]\s*\d{4}", r"[가-힣]{2}\s*\d{1,2}\s*[가-힣]\s*\d{4}", r"\d{2,3}\s*[가-힣]\s*\d{4}", r"0\d[-\s]*\d{4}", r"[가-힣]{2}\s*\d{3}-\d{3}", r"임\s*시\s*\d{4,6}"]
PLATE_NOISY = r"(\d{2,3})([가-힣ㄱ-ㅎㅏ-ㅣ])([A-Z0-9]{4})"
PLATE_NEAR = r"([가-힣]{0,2})\d{2,3}[가-힣]\d{4}|[A-Z]{1,3}[-\s]?\d{3,4}|(?<!\d)\d{4}(?!\d)"
PLATE_BARE = r"(?<![-/])\b\d{4}\b(?![-/])"
PLATE_PREFIX = r"^(상|체명|차량\s*번호|번호)\s*"
PLATE_STANDARD = r"^([가-힣]{2})?\d{1,3}[가-힣]\d{4}$"
TICKET = r"(N[O0]\.?|전\s*표(?:번\s*호)?|티\s*켓|계\s*량\s*(?:번\s*호|횟\s*수|회\s*수)|ID[-\s]*N[O0]|번\s*호:?|일\s*련\s*번\s*호)\s*[:：\.;,]?\s*([A-Z0-9-]{1,18})"
TICKET_AFTER_DATE = r"20\d{2}[-.\s/]*\d{1,2}[-.\s/]*\d{1,2}(?:\s+\d{2}:\d{2}(?::\d{2})?)? +([A-Z0-9]{1,8})(?![\d:])"
GPS_PAIR = r"(\d{2}\.\d{4,})[^\d]{1,30}(\d{2,3}\.\d{4,})"
GPS_LOOSE = r"(3\d[\.,]\d{4,})[^\d]{1,50}(1[23]\d[\.,]\d{4,})"
GPS_ANY = r"(\d{2,3}\.\d{4,})"
LATITUDES, LONGITUDES = (33.0, 43.0), (124.0, 132.0)
PHONE = r"(0\d{1,2})\s*[-.)]\s*(\d{3,4})\s*[-.]\s*(\d{4})"
COMPANY_LABELLED = r"(상\s*호|샹\s*호|성\s*명|거\s*래\s*처|공\s*급\s*자|공\s*급\s*받\s*는\s*자|업\s*체\s*명)\s*[:;：]?\s*([가-힣\(\)A-Z0-9 ]+)"
COMPANY_HONORIFIC = r"([가-힣\(\)A-Z0-9 ]+)\s*귀하"
CORP_AFTER = r"([가-힣A-Za-z0-9 ]+)\s*\(주\)"
CORP_BEFORE = r"\(주\)\s*([가-힣A-Za-z0-9 ]+)"
ISSUER_BEFORE = r"(\(주\)\s*[가-힣A-Za-z0-9 ]+)"
ISSUER_AFTER = r"([가-힣A-Za-z0-9 ]+\s*\(주\))"
ADDRESS_TAIL = r"\s*[가-힣]+(?:시|군|구).*?)(?=\s*(?:Tel|Tel\)|FAX|Fax|\*|20\d{2}[-.]|$))"
PRODUCT = r"(품\s*명|품\s*면|제\s*품\s*명|제\s*품|품\s*목|품\s*\.+\s*목)\s*[:;：]?\s*([가-힣A-Za-z0-9 ]+?)(?=\s*(?:\(|구분|입고|출고|날짜|차량|발행|총중량|실중량|공차중량|ID-NO)|[:：\n]|$)"
TYPE_LABELLED = r"(구\s*분|구\s*문)\s*[:;：]?\s*([가-힣 ]+)"
TYPE_IN, TYPE_OUT = r"입\s*고", r"출\s*고"

EQUATION_TOLERANCE, SANITY_TOLERANCE = 50, 100
CANDIDATE_RANGE = (100, 100_000)
RANGES = {"total_weight": (1_000, 100_000), "tare_weight": (500, 50_000), "net_weight": (10, 99_000)}
RATIO = (0.001, 0.95)
RATIO_STRICT = (0.01, 0.9)
YEARS = (2020, 2030)
FIELD_WEIGHTS = {"date": 1.0, "vehicle_num": 1.0, "total_weight": 1.5, "tare_weight": 1.0, "net_weight": 1.5, "company": 0.4}
PRIORITIES = [("NONE", 90.0), ("LOW", 75.0), ("MEDIUM", 50.0), ("HIGH", 25.0), ("CRITICAL", None)]
SEVERE_ISSUES = ["논리 오류", "파싱 오류", "범위 초과"]
COHERENCE = {"most": 600.0, "near": 300.0, "x": 100.0, "y": 50.0}
SPACE_PIXELS, LINE_FACTOR = 12.0, 0.3
PARSER_VERSION, TEXT_METHOD = "integrated_v6", "text_fallback_heuristic"
# ---- end of fixed values ----
