"""Values that are part of the data formats.

Everything in this module is a fixed value: changing one changes results.
"""

# --- fixed values: special tokens, ids are their positions ---------------
SPECIAL_TOKENS = ["<pad>", "<bos>", "<eos>", "<sep>", "<unk>"]
PAD, BOS, EOS, SEP, UNK = range(5)

# --- fixed values: merchant category codes of the card vocabulary --------
KNOWN_MCCS = [
    -1, 1711, 3000, 3001, 3005, 3006, 3007, 3008, 3009, 3058, 3066,
    3075, 3132, 3144, 3174, 3256, 3260, 3359, 3387, 3389, 3390, 3393,
    3395, 3405, 3504, 3509, 3596, 3640, 3684, 3722, 3730, 3771, 3775,
    3780, 4111, 4112, 4121, 4131, 4214, 4411, 4511, 4722, 4784, 4814,
    4829, 4899, 4900, 5045, 5094, 5192, 5193, 5211, 5251, 5261, 5300,
    5310, 5311, 5411, 5499, 5533, 5541, 5621, 5651, 5655, 5661, 5712,
    5719, 5722, 5732, 5733, 5812, 5813, 5814, 5815, 5816, 5912, 5921,
    5932, 5941, 5942, 5947, 5970, 5977, 6300, 7011, 7210, 7230, 7276,
    7349, 7393, 7531, 7538, 7542, 7549, 7801, 7802, 7832, 7922, 7995,
    7996, 8011, 8021, 8041, 8043, 8049, 8062, 8099, 8111, 8931, 9402,
]

# --- fixed values: industry ranges (token label, display label) ----------
INDUSTRY_RANGES = [
    (0, 1499, "AGRICULTURAL", "Agricultural"),
    (1500, 2999, "CONTRACTED", "Contracted"),
    (3000, 3299, "AIRLINES", "Airlines"),
    (3300, 3499, "CAR_RENTAL", "Car Rental"),
    (3500, 3999, "LODGING", "Lodging"),
    (4000, 4799, "TRANSPORTATION", "Transportation"),
    (4800, 4999, "UTILITIES", "Utilities"),
    (5000, 5599, "RETAIL", "Retail"),
    (5600, 5699, "CLOTHING", "Clothing"),
    (5700, 7299, "MISC_STORES", "Misc Stores"),
    (7300, 7999, "BUSINESS", "Business Services"),
    (8000, 8999, "PROFESSIONAL", "Professional"),
    (9000, 9999, "GOVERNMENT", "Government"),
]

# --- fixed values: entry modes --------------------------------------------
CHIP_MAPPING = {
    "SWIPE TRANSACTION": "SWIPE",
    "CHIP TRANSACTION": "CHIP",
    "ONLINE TRANSACTION": "ONLINE",
}

# --- fixed values: states ---------------------------------------------------
ALL_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
    "DC", "PR", "VI", "GU", "AS", "MP", "XX", "ONLINE",
]

# --- fixed values: amount thresholds of the fixed strategy ------------------
AMOUNT_THRESHOLDS = [10, 50, 100, 500, 1000, 5000]

# --- fixed values: closed sets of the nested-record route -------------------
CARD_LEVELS = ["普", "金", "白", "钻"]
CONN_MODES = ["直", "间"]

# --- fixed values: positions inside a nested transaction --------------------
# position, working name, name in the source format, Spark type
TXN_FIELDS = [
    (0, "issuer_addr", "cups_发卡机构地址", "string"),
    (1, "issuer_bank", "cups_发卡机构银行", "string"),
    (2, "card_level", "cups_卡等级", "string"),
    (3, "year", "year", "int"),
    (4, "month", "month", "int"),
    (5, "day", "day", "int"),
    (6, "hour", "hour", "int"),
    (7, "minutes", "minutes", "int"),
    (8, "seconds", "seconds", "int"),
    (9, "unix_ts", "unix_timestap", "double"),
    (10, "acq_addr", "cups_收单机构地址", "string"),
    (11, "acq_bank", "cups_收单机构银行", "string"),
    (12, "txn_code", "cups_交易代码", "string"),
    (13, "channel", "cups_交易渠道", "string"),
    (14, "pos_input", "cups_服务点输入方式", "string"),
    (15, "resp_code", "cups_应答码", "string"),
    (16, "merch_type", "cups_商户类型", "string"),
    (17, "conn_mode", "cups_连接方式", "string"),
    (18, "merch_name", "cups_受卡方名称地址", "string"),
    (19, "amount", "cups_交易金额", "string"),
]
TXN_ARITY = 20
DERIVED_NAMES = {"dow": "cups_星期", "period": "cups_时间段", "user_id": "cert_sm3"}
RAW_TIME_COLUMNS = ["year", "month", "day", "hour", "minutes", "seconds"]

# --- fixed values: labels ----------------------------------------------------
POSITIVE_LABELS = ["Yes", "1"]
LABEL_COLUMNS = ["Is Fraud?", "is_fraud", "Is_Fraud", "label", "fraud"]

# --- fixed values: columns a history may be keyed by --------------------------
USER_COLUMNS = ["user", "User", "cust", "cert_sm3"]
CARD_COLUMNS = ["card", "Card", "card_id"]

# --- fixed values: feature lists of the comparison job ------------------------
CARD_FEATURES = [
    "User", "Card", "Year", "Month", "Day", "Hour", "Amount", "Use Chip",
    "Merchant Name", "Merchant City", "Merchant State", "Zip", "MCC",
]
NDJSON_FEATURES = [
    "issuer_addr", "issuer_bank", "card_level", "acq_addr", "acq_bank",
    "txn_code", "channel", "pos_input", "resp_code", "merch_type",
    "conn_mode", "amount", "dow", "period",
]

# --- fixed values: defaults ------------------------------------------------------
CARD_CHUNK = 315
NDJSON_CHUNK = 230
SECONDS_PER_YEAR = 31556951.999999996
EPSILON_BIN = 1e-8
