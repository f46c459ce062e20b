"""Labels and vocabularies."""

from __future__ import annotations

# --- fixed values: results depend on them -----------------------------------------------------------

LABELS = [
    "person_name", "phone_number", "government_id", "street_address", "date_of_birth", "email_address", "passport_number", "license_plate", "bank_account_number",
]
DESCRIPTIONS = {
    "person_name": "full name of a real person including first name and family name",
    "phone_number": "telephone or mobile phone number with country or area code",
    "government_id": "national identification number such as NRIC MyKad IC Aadhaar CCCD NIK Thai ID Citizen ID",
    "street_address": "physical street address including building number street name city or district",
    "date_of_birth": "date of birth of a person in any date format",
    "email_address": "email address with username and domain name",
    "passport_number": "passport travel document number with country prefix",
    "license_plate": "vehicle license plate number",
    "bank_account_number": "bank account number or routing number for financial transactions",
}
IP_LABEL = "ip_address"
PHONE_MARKERS = ["电话", "手机", "号码", "联系"]
PHONE_MARKER_LABEL = "contact number"
ALIASES = {
    "person_name": ["person", "person name", "patient name", "full name", "姓名"],
    "phone_number": ["phone number", "mobile number", "contact number", "联系电话", "电话", "手机"],
    "government_id": [
        "national id", "identification number", "id number", "identity card number", "nric", "cccd", "thai_id", "nik", "aadhaar", "citizen id", "can cuoc cong dan",
        "căn cước công dân", "cmnd", "บัตรประชาชน", "thai national id", "thai citizen id", "เลขบัตรประชาชน", "nomor induk kependudukan", "ktp", "kartu tanda penduduk",
        "aadhar", "aadhar card", "aadhaar card", "aadhaar number", "आधार", "aadhaar no", "身份证号码",
    ],
    "street_address": ["mailing_address", "mailing address", "address", "home address", "地址", "住址"],
    "date_of_birth": ["date of birth", "birthday", "出生日期", "生日"],
    "email_address": ["email", "email address", "电子邮件"],
    "passport_number": ["passport", "passport number"],
    "license_plate": ["license plate", "vehicle plate", "车牌", "車牌"],
    "bank_account_number": ["bank account", "account number", "银行账户"],
}
META = [
    "person", "patient", "full", "name", "姓名", "phone", "mobile", "联系电话", "电话", "手机", "national", "identification", "身份证号码", "address", "home", "mailing", "地址", "住址",
    "birthday", "出生日期", "生日", "电子邮件", "passport", "vehicle", "车牌", "車牌", "银行账户", "account",
    "dob", "d.o.b", "d.o.b.", "id", "no", "no.", "number", "contact", "new", "old", "current", "previous", "on file",
    "tomorrow", "yesterday", "today", "tonight", "morning", "afternoon", "evening", "noon", "midnight", "emergency", "urgent", "primary", "secondary", "main", "standard",
    "doctor", "nurse", "clinic", "hospital", "lab", "mdm", "madam", "sir", "n/a", "na", "n.a.", "tbd", "tbc", "unknown", "anonymous", "none",
    "周一", "周二", "周三", "周四", "周五", "周六", "周日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日", "上午", "下午", "晚上", "中午",
    "i", "you", "he", "she", "we", "they", "it", "me", "my", "your", "his", "her", "their", "our", "us", "i'm", "i've", "you're", "we're", "they're",
    "我", "你", "他", "她", "我们", "你们", "他们", "它",
    "mom", "dad", "mum", "mother", "father", "parent", "parents", "husband", "wife", "spouse", "son", "daughter", "kid", "kids", "child", "children", "sister", "brother", "sibling",
    "grandma", "grandpa", "grandmother", "grandfather", "uncle", "aunt", "cousin", "nephew", "niece", "friend", "colleague", "neighbour", "neighbor",
    "someone", "anyone", "everyone", "nobody", "people",
    "妈妈", "爸爸", "母亲", "父亲", "儿子", "女儿", "妻子", "丈夫", "哥哥", "弟弟", "姐姐", "妹妹", "爷爷", "奶奶", "外公", "外婆",
]
CONTEXT = [
    "patient", "doctor", "dr", "mr", "mrs", "ms", "born", "aged", "called", "患者", "医生", "大夫", "先生", "女士", "我的", "他的", "她的", "你的", "是", "叫", "住在", "住址", "电话是", "生日是",
    "名字是", "名字", "姓名是", "号码是", "号码", "身份证号码是", "身份证是", "手机号码是",
]
STRIP_CHARS = " \t.,;:!?　，。；："
CLEAN_CHARS = ".,;:!?()[]{}，。；："
SERVER_THRESHOLDS = {
    "person_name": 0.25, "phone_number": 0.30, "government_id": 0.20, "street_address": 0.25, "date_of_birth": 0.25, "email_address": 0.30, "passport_number": 0.25,
    "license_plate": 0.25, "bank_account_number": 0.25,
}

# --- derived ----------------------------------------------------------------------------------------

#: Lower-case label or alias to label.
CANONICAL = {x: x for x in LABELS} | {a: label for label, aliases in ALIASES.items() for a in aliases}
META_WORDS = sorted({*LABELS, *META})
CONTEXT_WORDS = sorted({*META_WORDS, *CONTEXT}, key=lambda w: (-len(w.encode()), w))
