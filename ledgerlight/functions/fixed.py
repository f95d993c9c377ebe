"""Fixed values of the published sources: codes, labels, markers and characters that results depend on."""

# Prefecture codes and labels.
PREFECTURES = {
    "01": "北海道", "02": "青森県", "03": "岩手県", "04": "宮城県", "05": "秋田県", "06": "山形県", "07": "福島県",
    "08": "茨城県", "09": "栃木県", "10": "群馬県", "11": "埼玉県", "12": "千葉県", "13": "東京都", "14": "神奈川県",
    "15": "新潟県", "16": "富山県", "17": "石川県", "18": "福井県", "19": "山梨県", "20": "長野県", "21": "岐阜県",
    "22": "静岡県", "23": "愛知県", "24": "三重県", "25": "滋賀県", "26": "京都府", "27": "大阪府", "28": "兵庫県",
    "29": "奈良県", "30": "和歌山県", "31": "鳥取県", "32": "島根県", "33": "岡山県", "34": "広島県", "35": "山口県",
    "36": "徳島県", "37": "香川県", "38": "愛媛県", "39": "高知県", "40": "福岡県", "41": "佐賀県", "42": "長崎県",
    "43": "熊本県", "44": "大分県", "45": "宮崎県", "46": "鹿児島県", "47": "沖縄県",
}

# Department categories and labels.
CATEGORIES = {
    1: "内科", 2: "外科", 3: "小児科", 4: "皮膚科", 5: "眼科", 6: "耳鼻いんこう科", 7: "産科", 8: "婦人科",
    9: "リハビリテーション科", 10: "放射線科", 11: "麻酔科", 12: "泌尿器科", 13: "精神科", 14: "神経科", 15: "歯科",
    16: "リウマチ科", 17: "アレルギー科", 18: "肛門科", 19: "形成外科", 20: "病理診断科", 21: "臨床検査科", 22: "救急科",
    23: "循環器内科", 24: "消化器内科", 25: "呼吸器内科", 26: "総合診療科",
}
DENTISTRY = 15

# Markers of departments in order of priority, with their category.
MARKERS = [
    ("耳鼻いんこう科", 6), ("リハビリテーション科", 9), ("臨床検査科", 21), ("病理診断科", 20), ("総合診療科", 26),
    ("アレルギー科", 17), ("リウマチ科", 16), ("放射線科", 10), ("形成外科", 19), ("産婦人科", 7), ("泌尿器科", 12),
    ("救急科", 22), ("麻酔科", 11), ("皮膚科", 4), ("精神科", 13), ("神経科", 14), ("小児科", 3), ("肛門科", 18),
    ("胃腸科", 24), ("循環器", 23), ("消化器", 24), ("呼吸器", 25), ("心臓", 23), ("腎臓", 1), ("肝臓", 24),
    ("糖尿病", 1), ("眼科", 5), ("歯科", 15), ("婦人科", 8), ("産科", 7), ("心内", 23), ("心外", 23), ("消内", 24),
    ("循内", 23), ("呼内", 25), ("脳外", 14), ("脳内", 14), ("神内", 14), ("歯外", 15), ("小歯", 15), ("口腔", 15),
    ("形外", 19), ("整外", 2), ("リハ", 9), ("リウ", 16), ("アレ", 17), ("耳い", 6), ("産婦", 7), ("こう", 18),
    ("胃腸", 24), ("救命", 22), ("臨床", 21), ("病理", 20), ("胃", 24), ("腸", 24), ("肝", 24), ("腎", 1), ("循", 23),
    ("消", 24), ("呼", 25), ("耳", 6), ("眼", 5), ("産", 7), ("婦", 8), ("精", 13), ("神", 14), ("ひ", 12), ("放", 10),
    ("麻", 11), ("皮", 4), ("小", 3), ("外", 2), ("内", 1), ("歯", 15),
]

# What a vendor's private characters stand for, and the mark for those that are not known.
PRIVATE_USE = {
    0xE061: "土", 0xE087: "斎", 0xE089: "祐", 0xE08E: "尻", 0xE0A1: "葛", 0xE0A9: "巽", 0xE0AA: "簗", 0xE0AC: "樋",
    0xE0AE: "塚", 0xE0BE: "松", 0xE0C5: "辺", 0xE0C7: "片", 0xE0CA: "真", 0xE0E6: "竜", 0xE0E7: "滝", 0xE0E9: "葛",
    0xE0EA: "葛", 0xE0F4: "角", 0xE0F5: "塚", 0xE134: "西", 0xE14C: "潟", 0xE165: "鈴", 0xE18D: "榊", 0xE191: "槙",
    0xE192: "辻", 0xE199: "土", 0xE1B1: "芦", 0xE1B4: "辻", 0xE1C4: "槌", 0xE1CE: "櫛", 0xE1D1: "逢", 0xE1E6: "辻",
    0xE222: "増", 0xE22B: "広", 0xE234: "鶏", 0xE255: "祁", 0xE30D: "菅", 0xE37D: "滝", 0xE37E: "沢", 0xE37F: "辺",
    0xE380: "辺", 0xE381: "塚", 0xE382: "広", 0xE38B: "吉", 0xE398: "辺", 0xE39A: "高", 0xE3A1: "広", 0xE3A6: "静",
    0xE3C5: "橋", 0xE3CD: "祇", 0xE3D6: "辺", 0xE3E8: "藤", 0xE3E9: "原", 0xE404: "真", 0xE405: "㟢",
}
UNKNOWN_CHARACTER = "〓"

# First years of the eras, by full name; a cell's date has the first character only.
ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019}

# Types, their digit in national codes, categories of lists, states, bureaus, events, origins, levels of positions.
TYPES = {1: "病院", 2: "診療所", 3: "歯科診療所", 4: "薬局"}
HOSPITAL, CLINIC, DENTAL, PHARMACY = 1, 2, 3, 4
TYPE_DIGITS = {1: "1", 2: "1", 3: "3", 4: "4"}
CATEGORY_TYPES = {1: (1, 2), 2: (3,), 3: (4,)}
STATUSES = {1: "指定中", 2: "廃止", 3: "休止"}
ACTIVE, CLOSED, SUSPENDED = 1, 2, 3
CREATED, REMOVED, UPDATED = 1, 2, 3
BASELINE, DETECTED, REPROCESSED = 1, 2, 3
BUREAUS = {1: "北海道厚生局", 2: "東北厚生局", 3: "関東信越厚生局", 4: "東海北陸厚生局", 5: "近畿厚生局", 6: "中国四国厚生局", 7: "四国厚生局", 8: "九州厚生局"}
EVENT_TYPES = {1: "新規", 2: "廃止", 3: "変更"}
ORIGINS = {1: "初回取込", 2: "検知", 3: "再処理"}
LEVELS = {1: "住居", 2: "街区", 3: "地番", 4: "地番（枝番なし）", 5: "町丁目", 6: "医療情報ネット", 7: "国土数値情報"}
RESIDENCE, BLOCK, PARCEL, PARCEL_BASE, TOWN, HOURS_SOURCE, LAND_SOURCE = 1, 2, 3, 4, 5, 6, 7

# Kinds of corporations that may stand before a name, in full and abbreviated, and spellings that count as one.
CORPORATIONS = (
    "社会医療法人", "医療法人", "特定医療法人", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "社会福祉法人", "学校法人",
    "独立行政法人", "地方独立行政法人", "国立大学法人", "株式会社", "有限会社", "合同会社",
)
ABBREVIATED = ("医", "福", "社", "財", "学", "独", "公", "一", "特医", "社医")
SPELLINGS = {"付属": "附属", "皮フ": "皮膚", "ひふ科": "皮膚科"}

# How addresses name counties and cities, directions along a street, and blocks.
COUNTY_OR_CITY = "^.+?(?:郡(.+[町村])|市(.+区))$"
STREET = r"^\s*\S{1,25}?(?:上る|上ル|下る|下ル|東入る|東入ル|東入|西入る|西入ル|西入)"
BLOCK_HYPHEN = r"^\s*([0-9]+)-"
BLOCK_CHO = r"^\s*([0-9]+|[〇一二三四五六七八九十]+)丁(?=\s*[0-9])"

# What stands between a corporation's kind and a name, and how addresses write areas and house numbers.
CORPORATION_BODY = r"(?:\S{1,20}?(?:会|団|社|機構|法人))?"
AREA_MARK = "大字|(?<=[^0-9])字(?=[^0-9])"
BLOCK_MARK = "([0-9]+)(?:丁目|番地?の?|号?の(?=[0-9]))"
NUMBER_MARK = "([0-9]+)号"
SPACE_BEFORE_NUMBER = r"(?<=[^0-9\s-]) (?=[0-9])"
UP_TO_HOUSE_NUMBER = "^(?:[0-9]+(?=[条線地区割])|[^0-9])*?[0-9]+(?:-[0-9]+)*(?![0-9条線地区割])"
LINE_NUMERAL = "(?<![一二三四五六七八九十])([一二三四五六七八九]?十[一二三四五六七八九]?|[一二三四五六七八九])(?=条|線)"
BLOCK_NUMERAL = "([〇一二三四五六七八九十]+)(?=丁目)"

# What scanners ask for: folders, endings of files, and the names that are no such thing.
PROBED_FOLDERS = ("cgi-bin", "phpmyadmin", "pma")
PROBED_ENDINGS = (".sql", ".bak")
SPARED_SEGMENT, SPARED_PATH = ".well-known", "/index.php"

# Days of the week as the hours' source names them, and their numbers.
DAYS = {"月": "mon", "火": "tue", "水": "wed", "木": "thu", "金": "fri", "土": "sat", "日": "sun", "祝": "holiday"}
DAY_NUMBERS = {"mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6, "sun": 7, "holiday": 8}
HOLIDAY = 8
ALL_WEEKS = 31
