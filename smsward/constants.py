"""Fixed values that results depend on: patterns, word lists, thresholds, column orders."""

# Tags, in the order in which entities are masked.
ENTITY_TAGS = {
    "zalo": "<APP_LINK>", "telegram": "<APP_LINK>", "email": "<EMAIL>", "url": "<URL>", "bank_acc": "<BANK_ACC>", "hotline": "<PHONE>",
    "landline": "<PHONE>", "mobile": "<PHONE>", "shortcode": "<PHONE>", "datetime": "<TIME>", "money": "<MONEY>", "code": "<CODE>",
}

# Entity patterns (Java syntax; flags are added where they're used).
ZALO = r"(?:https?://)?(?:www\.)?(?:zalo\.me|zalo\.vn)/[\w.-]+"
TELEGRAM = r"(?:https?://)?(?:www\.)?(?:t\.me|telegram\.me)/[\w_]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
HOTLINE = r"(?<!\d)(?:1800|1900)(?:[\s.-]?\d){4,6}(?!\d)"
LANDLINE = r"(?<!\d)02\d(?:[\s.-]?\d){8}(?!\d)"
MOBILE = r"(?<!\d)(?:(?:[+]84|84)[\s.-]?\d(?:[\s.-]?\d){8}|0[35789](?:[\s.-]?\d){8})(?!\d)"
DATETIME = r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b|\b\d{1,2}[:h]\d{2}\b|\b\d+\s?(?:phút|p|giờ|h|ngày|tháng|năm)\b"
MONEY_UNITS = ("triệu", "trieu", "tr", "tỷ", "ty", "nghìn", "nghin", "ngàn", "ngan", "đồng", "dong", "vnd", "vnđ", "usd", "k", "đ", "d")
SAFE_TLDS = ("vn", "com", "net", "org", "edu", "gov", "int", "mil", "biz", "info", "mobi", "aero", "asia", "jobs", "museum", "app", "io", "dev", "cloud")
RISKY_TLDS = (
    "name", "ly", "me", "gl", "to", "co", "cc", "ws", "tk", "ga", "cf", "ml", "at", "su", "bid", "cfd",
    "xyz", "top", "icu", "vip", "pro", "club", "win", "life", "fun", "tech", "site", "online", "store", "shop", "live", "website",
)
OBFUSCATION_EXEMPT = ("microsoft", "apple", "google", "facebook", "truy cập", "website", "trang web")
BANK_WORDS = (
    "stk", "số tk", "so tk", "số tài khoản", "so tai khoan", "tài khoản", "tai khoan", "tk", "account", "acc",
    "ngân hàng", "ngan hang", "bank", "banking",
    "vietcombank", "vcb", "techcombank", "tcb", "mbbank", "mb", "bidv", "vietinbank", "vtb",
    "agribank", "vpbank", "acb", "sacombank", "tpbank", "hdbank", "vib", "ocb", "shb", "eximbank", "msb",
)
SHORTCODES = ("191", "900", "999", "18001091", "106226", "5050", "9029", "888", "1414", "9123", "9011")
SHORTCODE_WORDS = ("gửi", "gui", "lh", "liên hệ", "hotline", "tổng đài", "cskh")
CODE_PREFIXES = ("V", "ST", "D", "C", "M", "MI", "SD", "HD", "VD", "MAX", "BIG", "KC", "DK", "HUY", "Y", "KT", "T", "NAP", "TK", "MK", "UMAX", "TRE", "SV", "ECO")

# Normalisation.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
LEET_COUNTED = "013456789!@$"
LEET_MAP = ("@$+j", "asti")
TEENCODE = ((r"\bko\b", "không"), (r"\bck\b", "ch"))
VISUAL_LEET = (
    (r"\b0k\b", "ok"), (r"\b0([a-zA-Z]{2,})\b", "o$1"), (r"\b([a-zA-Z]+)0\b", "$1o"),
    (r"(?<=[a-zA-Z])0(?=[a-zA-Z])", "o"), (r"(?<=[a-zA-Z])1(?=[a-zA-Z])", "i"), (r"(?<=[a-zA-Z])3(?=[a-zA-Z])", "e"),
    (r"(?<=[a-zA-Z])4(?=[a-zA-Z])", "a"), (r"(?<=[a-zA-Z])5(?=[a-zA-Z])", "s"), (r"(?<=[a-zA-Z])8(?=[a-zA-Z])", "b"),
)
SEPARATORS = "'-~:;,.\"*^{}[]()/|\\!"
TELEX = ("aa", "ee", "dd", "oo", "ow", "uw", "ww", "aw", "af", "as", "ar", "ax", "aj", "aq")

# Whitelists. The reference behaviour lacks the entries in WHITELIST_REPAIRED (commas were missing there).
BRANDS = (
    "vcb", "vietcombank", "acb", "bidv", "vietinbank", "techcombank", "tcb", "mbbank", "mb", "tpbank", "vpbank", "sacombank", "shb",
    "hdbank", "ocb", "msb", "agribank", "pvcombank", "momo", "zalopay", "viettelpay", "vnpay", "shoppeepay", "fecredit", "homecredit",
    "viettel", "vinaphone", "mobifone", "vietnamobile", "shopee", "lazada", "tiki", "grab", "gojek", "be", "tiktok", "facebook", "fb",
    "zalo", "telegram", "apple", "iphone", "samsung", "vingroup", "vinfast", "money", "vnpt", "vina", "vinaphonemobi", "mobiphone", "fpt",
    "post", "myvt", "myvnpt", "myviettel", "vietteltt", "tv360", "fptplay", "steam", "riot", "vneid", "evnhcmc", "google", "netflix", "instagram",
)
JARGON = (
    "sim", "3g", "4g", "5g", "lte", "data", "wifi", "roaming", "otp", "pin", "atm", "pos", "qr", "visa", "mastercard", "digibank",
    "smartbanking", "ebanking", "ibanking", "usdt", "btc", "eth", "crypto", "blockchain", "app", "web", "link", "url", "online", "offline",
    "download", "update", "login", "logout", "sms", "voucher", "gb", "mb", "page", "https",
)
SLANG = (
    "tb", "qc", "tkclh", "tc", "tc1", "tc2", "tc3", "sdt", "đt", "dt", "sđt", "tk", "stk", "tt", "cskh", "bhtn", "bhxh", "bhyt", "cmnd",
    "cccd", "nd", "mgd", "ref", "cty", "yc", "tp", "hcm", "gplx", "cntt", "dhko", "k", "dc", "đc", "r", "bn", "ok", "okie", "oke", "okay",
    "dk", "hsd", "qk", "gd", "dv", "dh", "kh", "nv", "lh", "hs", "thpt", "thcsref", "sms", "verify", "code", "bank", "transfer",
    "verification", "send", "transaction", "mobile", "phone", "number", "tel", "call", "contact", "covid", "website", "big", "airtime",
)
ENTITY_TOKENS = ("<url>", "<phone>", "<money>", "<code>", "<time>", "<email>", "<app_link>", "<URL>", "<PHONE>", "<MONEY>", "<CODE>", "<TIME>", "<EMAIL>", "<APP_LINK>")
WHITELIST_REPAIRED = ("mobi", "tkc", "ko", "thcs")

# Domains.
TRUSTED_DOMAINS = (
    "vietcombank.com.vn", "vcb.com.vn", "viettel.vn", "vietteltelecom.vn", "viettelpay.vn", "tiki.vn", "tiki.com", "shopee.vn", "shopee.com",
    "momo.vn", "zalopay.vn", "zalo.me", "vnpt.com.vn", "vinaphone.com.vn", "mobifone.vn", "google.com", "google.com.vn", "facebook.com",
    "youtube.com", "gmail.com", "apple.com", "microsoft.com", "instagram.com",
)
MESSAGE_URL = r"(?:https?://|www\.)[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/\S*)?"
USER_CONTENT = ("google", "drive", "docs", "sheet", "form", "dropbox", "bit.ly", "tinyurl", "zalopay")
#: A small public-suffix table of our own.
PUBLIC_SUFFIXES = (
    "com", "net", "org", "edu", "gov", "info", "biz", "app", "io", "dev", "xyz", "top", "vip", "club", "online", "site", "shop", "store", "me", "ly", "co", "vn",
    "com.vn", "net.vn", "org.vn", "edu.vn", "gov.vn", "uk", "co.uk", "org.uk", "de", "fr", "es",
)

# Guards on folded text.
CONVERSATION_WORDS = ("tao", "may", "ba", "me", "bo", "anh", "em", "chi", "minh", "vo", "chong")
CONVERSATION_PHRASES = ("sinh nhat", "an com", "di choi", "di nhau", "cafe", "hop lop", "lam viec", "gui xe", "ve chua", "nha mang", "qc", "quang cao")
DANGER = (
    "vay", "no xau", "lai suat", "giai ngan", "chuyen khoan", "stk", "ngan hang", "bank", "so du", "viec nhe", "ctv", "hoa hong", "chot don",
    "tuyen dung", "trung thuong", "qua tang", "cong an", "toa an", "lenh bat", "dieu tra", "trieu tap",
)
DANGER_V1 = (
    "otp", "mã", "cskh", "bank", "thưởng", "tặng", "phí", "lệnh", "công an", "tòa án", "click", "truy cập", "chuyển khoản", "vui lòng",
    "xác thực", "trúng", "vay", "nợ", "lãi", "thuong", "lenh", "cong an", "toa an", "chuyen khoan", "xac thuc", "trung", "nhan qua",
    "nhan tien", "qua tang", "nhan thuong", "gui tang", "trung thuong", "tuyen dung", "ctv", "viec lam", "thu nhap", "chot don", "luong cao",
)

# What the policies say to the user; %s is the domain's reason.
REASONS = {
    "Domain Risk": "CẢNH BÁO CAO: Phát hiện liên kết độc hại hoặc bị làm nhiễu (%s).",
    "Hybrid Warning": "Cảnh báo: Tên miền sạch (%s) nhưng nội dung có dấu hiệu lừa đảo.",
    "Hybrid Safe": "An toàn: Tên miền dịch vụ lưu trữ/rút gọn uy tín.",
    "Authority Whitelist": "An toàn: Tên miền chính chủ đã được xác thực (%s).",
    "Conversation Guard": "Cảnh báo mức thấp: AI nghi ngờ nhưng văn phong mang tính hội thoại cá nhân.",
    "AI Detection": "Cảnh báo: AI phát hiện cấu trúc văn bản thường thấy trong tin nhắn rác/lừa đảo.",
    "Keyword Trigger": "Cảnh báo: Nội dung chứa các từ khóa rủi ro cao (Tài chính/Giả danh) cần xác minh.",
    "AI Model": "An toàn: Không tìm thấy yếu tố rủi ro trong nội dung.",
}
REASON_V1_PHISHING = "PHÁT HIỆN TÊN MIỀN ĐỘC HẠI: %s"
REASON_V1_DOUBTFUL = "Domain an toàn (%s), nhưng nội dung đáng ngờ."
REASON_V1_VERIFIED = "Tên miền chính chủ/Whitelist: %s"
REASON_V1_CHAT = "Tin nhắn hội thoại thông thường (Conversation)"
REASON_V1_DETECTED = "AI phát hiện nội dung/hành vi đáng ngờ"
REASON_V1_SAFE = "Nội dung an toàn"
STATUS_BAD, STATUS_CLEAN = "LỪA ĐẢO", "SẠCH"

# Flags of a message, placeholders of a sheet, themes of a corpus.
FLAG_TLDS = ("com", "vn", "net", "org", "info", "xyz", "top", "club", "vip", "pro", "me", "io", "edu", "gov", "biz", "cc", "tv", "site", "asia", "online", "tech")
FLAG_PHONE = r"(?:\+84|84|0)(?:[\s.-]*\d){9,10}\b|(?:1800|1900)(?:[\s.-]*\d){4,6}\b|(?:02)(?:[\s.-]*\d){9}\b"
PLACEHOLDERS = ("[NAME]", "[CCCD]", "[LOCATION]", "[PHONE_NUMBER]", "[LINK]", "[MONEY_AMOUNT]", "[BANK_ACCOUNT]", "[DATETIME]", "[PRIVATE_INFO]")
THEMES = {
    "Khuyến mãi/Giảm giá": ("khuyến mãi", "giảm giá", "sale", "giảm", "khuyến", "mãi", "ưu đãi", "voucher", "deal", "combo"),
    "Miễn phí/Tặng": ("miễn phí", "free", "tặng", "quà", "nhận", "tri ân"),
    "Tiền/Tài chính": ("tiền", "đồng", "vnd", "k", "triệu", "nghìn", "vnđ", "rút", "nạp", "chuyển khoản", "tài khoản"),
    "Hành động khẩn cấp": ("ngay", "nhanh", "gấp", "lập tức", "vui lòng", "nhanh tay", "chỉ", "còn", "hạn"),
    "Liên hệ": ("gọi", "call", "inbox", "liên hệ", "nhắn", "sdt", "zalo"),
    "Dịch vụ": ("dịch vụ", "đăng ký", "gói", "gói cước", "thuê bao", "data"),
}

# Column orders.
ENTITY_COLUMNS = [f"{k}_count" for k in ENTITY_TAGS]
FEATURES = ENTITY_COLUMNS + [
    "leet_count", "separator_count", "teencode_count", "visual_leet_count", "symbol_leet_count", "validated_leet_count", "weighted_leet_score",
    "whitelist_count", "oov_count", "oov_density", "broken_telex_count", "longest_oov_length", "gibberish_count", "repeated_char_count", "run_on_word_count",
]
THRESHOLD = 0.46
