"""Rule tables and constants.

FIXED VALUES: everything in this module must equal the valuation rules the
engine reproduces (keyword lists, regex patterns in Python ``re`` syntax,
lookup tables, thresholds). They are listed plainly, in their natural order.
Order matters where noted: "later overwrites earlier" lists are evaluated
with ``last_wins``; "first match" lists with ``first_wins``.
"""

# ---------------------------------------------------------------------------
# Property types
# ---------------------------------------------------------------------------
ALLOWED_TYPES = ["Apartment", "Villa", "Penthouse", "Duplex", "Chalet"]

ARABIC_TYPE_NAMES = {
    "شقة": "Apartment",
    "شقه": "Apartment",
    "شقا": "Apartment",
    "فيلا": "Villa",
    "فيله": "Villa",
    "شاليه": "Chalet",
    "شليه": "Chalet",
    "دوبلكس": "Duplex",
    "دوبليكس": "Duplex",
    "بنتهاوس": "Penthouse",
    "رووف": "Penthouse",
    "روف": "Penthouse",
}

VILLA_VARIANTS = ["Ivilla", "Twin House", "Townhouse", "Twin Villa", "Standalone Villa"]

# ---------------------------------------------------------------------------
# Compounds and standalone signals
# ---------------------------------------------------------------------------
KNOWN_LUXURY_COMPOUNDS = [
    "taj city", "mivida", "hyde park", "mountain view", "palm hills",
    "sodic", "la vista", "el gouna", "sahl hasheesh", "marassi", "hacienda",
    "amwaj", "bo island", "jefaira", "mountain view icity", "palm hills katameya",
    "village gate", "fleur de ville", "the waterway", "eastown", "westown",
    "allegria", "katameya dunes", "katameya plaza", "uptown cairo",
]

KNOWN_MID_COMPOUNDS = [
    "madinaty", "beit el watan", "arkan", "zed west",
    "rehab", "el rehab", "fifth square", "woodville",
    "golf extension", "golf views", "el patio", "patio", "casa", "alma",
    "hayah", "mena garden city", "village gardens", "galleria",
]

STANDALONE_KEYWORDS = [
    "standalone", "al yasmine", "el yasmin", "yasmin", "yasmine",
    "el yasmine", "yasmeen", "el yasmeen",
    "عمارة", "منطقة سكنية", "حي", "الحي", "المنطقة",
    "بدون كمبوند", "بدون مجمع", "شقة في عمارة",
    "residential area", "neighborhood", "district", "off compound",
    "عمارات", "منطقة", "حى", "الحى", "بيت", "منزل",
]

EMPTY_COMPOUND_NAMES = ["", "-", "unknown", "na", "n/a", "other", "none"]

COMPOUND_WORD = r"\bcompound\b|\bكمبوند\b|\bمجمع\b"

# ---------------------------------------------------------------------------
# Cleaning parsers
# ---------------------------------------------------------------------------
SIZE_SPACE_CHARS = "\u200c\u200d\u200e\u200f\u2028\u2029\u2060\u180e\u2000-\u200a\u202f\u205f\u3000"  # regex class body
SIZE_SQM = r"([\d,]+(?:\.\d+)?)\s*sqm"
SIZE_SQFT = r"([\d,]+(?:\.\d+)?)\s*sqft"
SIZE_BARE = r"([\d,]+(?:\.\d+)?)"
SQFT_TO_SQM = 0.0929
SIZE_MIN, SIZE_MAX = 5, 5000

INSTALLMENT_WORDS = r"install|قسط|تقسيط"
CASH_WORDS = r"\bcash\b|كاش"
DP_MILLION = r"\bm\b|million|مليون"
DP_THOUSAND = r"\bk\b|thousand|الف|ألف"
URL_PATTERN = r"http\S+|www\.\S+"
INSTALL_YEARS = r"(\d+)\s*year"
INSTALL_YEARS_MIN, INSTALL_YEARS_MAX = 2, 25
RENT_URL_MARK = "/plp/rent/"

# later overwrites earlier
FINISH_RULES = [
    (r"core.?shell|bare.?shell|unfinished", 0.0),
    (r"semi.?finish", 1.0),
    (r"fully.?finish|full.?finish", 2.0),
    (r"luxury.?finish|super.?lux", 3.0),
]

# later overwrites earlier; default 0
VIEW_RULES = [
    (r"pool.?view", 1.0),
    (r"garden.?view", 2.0),
    (r"lagoon", 3.0),
    (r"sea.?view|ocean.?view|panoramic.*sea", 4.0),
    (r"golf.?view|golf.?course", 5.0),
]

# first match wins; default 0
MARKET_TIER_RULES = [
    (r"north\s*coast|sahel|ras\s*el?\s*hekma|matrouh|gouna|sokhna", 3.0),
    (r"new\s*cairo|5th\s*settlement|fifth\s*settlement|sheikh.?zayed|6th.?october|new\s*capital", 2.0),
    (r"giza|maadi|zamalek|heliopolis|nasr\s*city|mohandessin", 1.0),
]

COASTAL_PATTERNS = (r"north\s*coast|sahel|ras\s*el?\s*hekma|matrouh|marsa\s*matrouh|el\s*alamein|"
                    r"hacienda|marassi|amwaj|bo\s*island|jefaira")
RED_SEA_PATTERNS = (r"sokhna|ain\s*sokhna|red\s*sea|ghardaqa|hurghada|sharm\s*el\s*sheikh|dahab|"
                    r"porto\s*sokhna|mountain\s*view\s*sokhna")
ZONE_ORDINAL = {"urban": 0.0, "coastal": 1.0, "red_sea": 2.0}

# size bucket upper bounds (exclusive): small < 80 <= medium < 150 <= large < 250 <= xlarge
SIZE_BUCKETS = [(80, "small"), (150, "medium"), (250, "large")]
SIZE_BUCKET_TOP = "xlarge"

# fence bins, right-closed: (0,80], (80,150], (150,250], (250,9999]
FENCE_BINS = [0, 80, 150, 250, 9999]
FENCE_BIN_LABELS = ["small", "medium", "large", "xlarge"]
FENCE_IQR_MULT = 3.0
FENCE_MIN_GROUP = 10
FENCE_MIN_APARTMENTS = 100

# keyword type repair for rows typed "Apartment" (later overwrites earlier)
PENTHOUSE_WORDS = r"\bpenthouse\b|بنتهاوس|بنتهاوس"
DUPLEX_WORDS = r"\bduplex\b|دوبلكس|دوبليكس|دوبليكس"
VILLA_WORDS = r"\bvilla\b|فيلا|توين هاوس|تاون هاوس|i?villa"
VILLA_MIN_SIZE = 400

# price trim quantiles
PRICE_TRIM = (0.05, 0.95)

# ---------------------------------------------------------------------------
# Description keyword flags (nlp_*)
# ---------------------------------------------------------------------------
KWS = [
    ("north_coast",    r"north\s*coast|ras\s*el?\s*hekma|sahel"),
    ("penthouse",      r"\bpenthouse\b"),
    ("lagoon",         r"lagoon"),
    ("fully_finished", r"fully.?finish"),
    ("sea_view",       r"sea.?view|panoramic.*sea|ocean.?view"),
    ("furnished",      r"\bfurnish"),
    ("new_cairo",      r"new\s*cairo|5th\s*settlement|fifth\s*settlement"),
    ("premium_dev",    r"palm hills|sodic|orascom|emaar|mountain view|la vista|hyde park|tatweer"),
    ("garden",         r"private.?garden|\bgarden\b"),
    ("pool",           r"\bpool\b|swimming"),
    ("compound_kw",    r"\bcompound\b"),
    ("ready_now",      r"immediate.?delivery|ready.?to.?move|استلام\s*فوري"),
    ("sheikh_zayed",   r"sheikh.?zayed|6th.?october"),
    ("duplex",         r"\bduplex\b"),
    ("prime_loc",      r"prime.?location|prime"),
    ("core_shell",     r"core.?shell|bare.?shell|unfinished"),
    ("installment_kw", r"install|قسط|تقسيط"),
    ("resort",         r"resort|chalet"),
]
DESC_LEN_DIVISOR, DESC_LEN_CAP = 500, 4

LUXURY_TERMS = r"sea.?view|lagoon|prime|fully.?finish|super.?lux|luxury|penthouse|panoramic|golf.?view"
BUDGET_TERMS = r"core.?shell|bare.?shell|unfinished|semi.?finish|economy|affordable"
INVEST_TERMS = r"install|قسط|تقسيط|compound|resort|chalet|north.?coast|sahel|delivery\s*\d{4}"

# ---------------------------------------------------------------------------
# Content extractors
# ---------------------------------------------------------------------------
ANCHOR_YEAR = 2026
DELIVERY_YEAR_AFTER = r"(?:deliver|delivery|استلام|تسليم|سنة|عام)\s*(?:in|في|by)?\s*(\d{4})"
DELIVERY_YEAR_BEFORE = r"(\d{4})\s*(?:deliver|delivery|استلام|تسليم)"
AGE_IN_YEARS = r"(\d+)\s*(?:years?\s*old|سنين?\s*عمر|سنة\s*عمر)"
UNDER_CONSTRUCTION = r"under\s*construction|قيد\s*الانشاء|unfinished\s*building|لم\s*يتم\s*البناء"
AGE_RANGE = (0, 100)

# later overwrites earlier
FLOOR_RULES = [
    (r"\bground\s*floor\b|الدور\s*الارضي|دور\s*ارضي", 0.0),
    (r"\bfirst\s*floor\b|الدور\s*الاول|1st\s*floor", 1.0),
    (r"\bsecond\s*floor\b|الدور\s*الثاني|2nd\s*floor", 2.0),
    (r"\bthird\s*floor\b|الدور\s*الثالث|3rd\s*floor", 3.0),
    (r"\bhigh\s*floor\b|دور\s*عالي|علوي", 4.0),
    (r"\btop\s*floor\b|roof\s*top|اخر\s*دور|الدور\s*الاخير", 5.0),
]
FLOOR_NUMBER = r"(?:floor|دور)\s*(\d+)|(\d+)(?:st|nd|rd|th)\s*(?:floor|دور)"
FLOOR_RANGE = (0, 50)

# later overwrites earlier; default 0
LEGAL_RULES = [
    (r"registered|مسجل|tabo|طابو|سجل\s*عقاري", 3),
    (r"equity|حصة|equal\s*share|شراكة", 2),
    (r"contract|عقد|عقود", 1),
    (r"not\s*registered|غير\s*مسجل|بدون\s*عقد|without\s*papers", -1),
]

# later overwrites earlier; default NULL
CONDITION_RULES = [
    (r"needs\s*renovation|يحتاج\s*تجديد|needs\s*work|يحتاج\s*صيانة", 0.0),
    (r"old\s*building|عمارة\s*قديمة|used|مستعمل|قديم", 1.0),
    (r"good\s*condition|حالة\s*جيدة|average|متوسط", 2.0),
    (r"renovated|متشطب|renewed|مجدد|تم\s*التجديد", 3.0),
    (r"brand\s*new|جديد\s*بالكامل|first\s*use|اول\s*استخدام|never\s*lived|لم\s*يسكن", 4.0),
]

AMENITY_FLAGS = [
    ("has_elevator", r"\belevator\b|أسانسير|مصعد"),
    ("has_garage",   r"\bgarage\b|جراج|موقف\s*سيارات|parking"),
    ("has_security", r"\bsecurity\b|أمن|حارس|guard|gated|بوابة"),
    ("has_balcony",  r"\bbalcony\b|بلكونة|تراس|terrace|لانش"),
    ("has_ac",       r"\b(ac|air\s*condition|conditioning|تكييف|مكيف)\b"),
    ("has_gas",      r"\bgas\b|غاز\s*طبيعي|natural\s*gas"),
    ("has_storage",  r"\bstorage\b|مخزن|store\s*room|مستودع"),
]

MICRO_LOCATION_FLAGS = [
    ("near_metro",   r"metro|مترو|subway|station|محطة"),
    ("near_mall",    r"mall|مول|shopping\s*center|سوق\s*تجاري"),
    ("near_highway", r"highway|طريق\s*سريع|ring\s*road|محور|autostrad"),
    ("main_street",  r"main\s*street|شارع\s*رئيسي|على\s*الشارع|facing\s*street"),
    ("corner_unit",  r"corner|زاوية|ناصية|زاويه"),
    ("quiet_zone",   r"quiet|هادئ|سكني|calm|residential"),
]

MOTIVATION_FLAGS = [
    ("motivation_urgent",       r"urgent|عاجل|فوري|سريع|للبيع\s*السريع"),
    ("motivation_negotiable",   r"negotiable|قابل\s*للتفاوض|تفاوض|سوم"),
    ("motivation_cash_only",    r"cash\s*only|كاش\s*فقط"),
    ("motivation_below_market", r"below\s*market|أقل\s*من\s*السوق|فرصة|opportunity|لقطة"),
]
MOTIVATION_SCORE_PARTS = ["motivation_urgent", "motivation_negotiable", "motivation_below_market"]

EXPOSURE_FLAGS = [
    ("north_facing", r"\bnorth\s*facing\b|شمالي|اتجاه\s*شمال"),
    ("south_facing", r"\bsouth\s*facing\b|جنوبي|اتجاه\s*جنوب"),
    ("east_west",    r"\beast\b|\bwest\b|شرقي|غربي|شرق|غرب"),
    ("street_view",  r"street\s*view|اطلالة\s*شارع|على\s*الشارع"),
]

ROOM_CONFIG_FLAGS = [
    ("has_master_bedroom", r"master\s*bedroom|ماستر|غرفة\s*رئيسية"),
    ("has_dressing_room",  r"dressing\s*room|دريسينج|غرفة\s*ملابس"),
    ("has_driver_room",    r"driver\s*room|غرفة\s*سائق"),
    ("has_nanny_room",     r"nanny|مربية|babysitter|غرفة\s*مربية"),
]

PHONE_PATTERN = r"(?:\+\d{1,3}[\s-]?)?(?:\(\d+\)|\d{2,})[\s.-]?\d{3,}[\s.-]?\d{3,}|\b\d{7,15}\b"
CAPS_PATTERN = r"[A-Z]"
EXCL_PATTERN = r"!"
SENTENCE_PATTERN = r"[.!?۔]"
DIGIT_PATTERN = r"\d"
EXCL_CAP, SENTENCE_RANGE, DIGIT_CAP = 10, (1, 50), 100

NORTH_COAST_PATTERN = r"north\s*coast|ras\s*el?\s*hekma|sahel"

# ---------------------------------------------------------------------------
# Target encodings (column -> smoothing k)
# ---------------------------------------------------------------------------
TE_SMOOTHING = [
    ("type_clean", 20), ("governorate", 20), ("city", 20), ("compound", 30),
    ("city_comp", 20),
    ("comp_type", 30), ("bed_type", 15), ("nc_type", 10), ("finish_type", 15), ("type_tier", 15),
]
N_FOLDS = 5
TEST_SHARE = 0.20
SEED = 42

NUM_COLS = [
    "size_sqm", "bedrooms_n", "bathrooms_n",
    "has_maid", "is_installment", "is_cash",
    "room_ratio", "install_years", "log_comp_size",
    "finish_ord", "view_score",
    "down_payment_ratio", "log_down_payment",
    "market_tier", "size_per_bedroom", "size_x_finish",
    "price_per_sqm_estimate",
    "luxury_score", "budget_score", "investment_signal",
    "building_age", "under_construction",
    "floor_level", "has_explicit_floor",
    "legal_status", "condition_score",
    "has_elevator", "has_garage", "has_security", "has_balcony",
    "has_ac", "has_gas", "has_storage",
    "near_metro", "near_mall", "near_highway", "main_street",
    "corner_unit", "quiet_zone",
    "motivation_urgent", "motivation_negotiable",
    "motivation_cash_only", "motivation_below_market", "motivation_score",
    "north_facing", "south_facing", "east_west", "street_view",
    "has_master_bedroom", "has_dressing_room", "has_driver_room", "has_nanny_room",
    "has_phone_in_desc", "caps_ratio", "excl_count", "sentence_count", "num_count",
    "area_market_zone_ord",
    "is_compound", "compound_tier", "standalone_premium", "compound_premium",
    "log_size_sqm", "size_sqm_inv",
]

MUST_KEEP = [
    "size_sqm", "bedrooms_n", "bathrooms_n",
    "compound_te", "city_te", "governorate_te",
    "type_clean_te", "finish_ord", "view_score",
    "price_per_sqm_estimate", "log_comp_size",
    "market_tier", "size_per_bedroom",
    "is_compound", "compound_tier", "log_size_sqm", "city_comp_te",
    "standalone_premium", "compound_premium",
    "size_sqm_inv",
]
TOP_IMPORTANCE, FEATURE_CAP = 50, 55
SELECTION_ROUNDS = 300
SELECTION_RATE = 0.08
ENSEMBLE_ROUNDS = 3000  # at most; early stopping decides
LEARNING_RATE = 0.035
PATIENCE = 100  # rounds without a gain on the held-out rows that end a fit

# ---------------------------------------------------------------------------
# TF-IDF / LSA
# ---------------------------------------------------------------------------
TFIDF_MAX_FEATURES = 2000
TFIDF_MIN_DF = 5
TFIDF_MAX_DF = 0.85
LSA_COMPONENTS = 25

# ---------------------------------------------------------------------------
# Decision engine
# ---------------------------------------------------------------------------
MAPE_BY_TYPE = {
    "Penthouse": 0.162,
    "Apartment": 0.175,
    "Chalet":    0.194,
    "Duplex":    0.211,
    "Villa":     0.254,
}
DEFAULT_MAPE = 0.20

BASE_CONFIDENCE = {
    "Penthouse": 82,
    "Apartment": 85,
    "Chalet":    75,
    "Duplex":    68,
    "Villa":     55,
}
DEFAULT_BASE_CONFIDENCE = 75

TYPE_RELIABILITY = {
    "Penthouse": 1.05,
    "Apartment": 1.00,
    "Chalet":    0.95,
    "Villa":     0.85,
    "Duplex":    0.80,
}

BIAS_FACTOR = {"compound": 1.041, "standalone": 1.051}

PREMIUM_CITIES = [
    "new cairo", "5th settlement", "fifth settlement",
    "sheikh zayed", "6th october", "new capital",
    "tagamoa", "el tagamoa", "التجمع",
]

STANDALONE_CALIBRATION = [
    ("new cairo",   0.72),
    ("tagamoa",     0.72),
    ("sheikh zayed", 0.78),
    ("6th october", 0.80),
    ("new capital", 0.75),
]
DEFAULT_STANDALONE_DISCOUNT = 0.82

VILLA_CLUSTER_MEDIAN_P50 = {"urban": 18_500_000, "coastal": 6_200_000, "red_sea": 8_900_000}
VILLA_CLUSTER_OVERALL_MEDIAN = 15_000_000
VILLA_ZONE_THRESHOLDS = {
    "urban":   (0.65, 1.50),
    "coastal": (0.55, 1.70),
    "red_sea": (0.60, 1.60),
}
DEFAULT_VILLA_THRESHOLDS = (0.60, 1.60)

BAND_MARGIN_SHARE = 0.90
WIDE_UNCERTAINTY, NARROW_UNCERTAINTY = 0.40, 0.20
WIDE_BAND = (0.90, 1.10)
NARROW_BAND = (0.97, 0.97)

EXTREME_RATIO_LOW, EXTREME_RATIO_HIGH = 0.40, 2.00
RARITY_HIGH_THRESHOLD, RARITY_MED_THRESHOLD = 0.50, 0.30
RARITY_UNKNOWN_KEY = 0.7
BENCHMARK_UPPER, BENCHMARK_LOWER = 1.80, 0.40
RARITY_PENALTY_HIGH, RARITY_PENALTY_MED, BENCHMARK_PENALTY = 15, 8, 25
SAFETY_SCORE_CAP = 35
SCORE_RANGE = (20, 95)
SIGNAL_SLOPE, SIGNAL_CAP = 60, 15
LEVEL_HIGH, LEVEL_MEDIUM = 75, 50

# confidence penalties: (land missing villa / other), (not in compound villa / other),
# developer unknown, wide uncertainty
PENALTY_LAND_MISSING = (15, 5)
PENALTY_NOT_COMPOUND = (5, 10)
PENALTY_DEVELOPER_UNKNOWN = 5
PENALTY_WIDE_UNCERTAINTY = 10
VILLA_PREMIUM_DEV_BOOST, VILLA_PREMIUM_DEV_CAP = 10, 65
VILLA_RESORT_CAP = 50
DUPLEX_BASE_CAP = 65

DOWN_PAYMENT_SUSPECT_RATIO = 0.35
DOWN_PAYMENT_GUESS_SHARE = 0.20

COVERAGE_WEIGHTS = {
    "building_age": 15,
    "floor_level": 10,
    "amenities": 20,
    "condition_score": 15,
    "view_score": 10,
    "financial_info": 15,
}
COVERAGE_OTHER_WEIGHT, COVERAGE_CAP = 5, 100

POOL_WORDS = ["pool", "swimming"]
PREMIUM_DEVELOPERS = ["palm hills", "sodic", "orascom", "emaar",
                      "mountain view", "la vista", "hyde park"]
COVERAGE_AMENITIES = ["has_elevator", "has_garage", "has_security",
                      "has_balcony", "has_ac", "has_gas", "has_storage"]

# quick valuation (request path)
FALLBACK_PRICE_PER_SQM = 36_500
QUICK_RANGE = (0.9, 1.1)
QUICK_GOOD_DEAL, QUICK_OVERPRICED = 0.85, 1.15
# fixed value: the sentence users see, with the range in millions
QUICK_REASON = "السعر ضمن النطاق المتوقع ({lo}M-{hi}M) للعقارات المشابهة."

# reason texts
AREA_FALLBACK_TEXT = "similar locations"
REASON_STANDALONE_NOTE = " (Standalone area pricing applied.)"
REASON_POOL_NOTE = "A pool supports a higher valuation."
REASON_DEVELOPER_NOTE = "Premium developers typically command higher prices."
ZONE_PREFIX = {"coastal": "Coastal ", "red_sea": "Red Sea "}
AR_UNDER_EXTREME = "السعر أقل بكثير من النطاق المتوقع ({lo}–{hi})، مما يشير إلى فرصة قوية."
AR_UNDER = "السعر أقل من النطاق المتوقع ({lo}–{hi}) للعقارات المشابهة."
AR_OVER_EXTREME = "السعر أعلى بكثير من النطاق المتوقع ({lo}–{hi}) مقارنة بالسوق."
AR_OVER = "السعر أعلى من النطاق المتوقع ({lo}–{hi}) للعقارات المشابهة."
AR_FAIR = "السعر ضمن النطاق المتوقع ({lo}–{hi}) للعقارات المشابهة."
AR_WEAK_DATA = "لكن دقة التقدير منخفضة بسبب قلة البيانات في هذه المنطقة."
AR_LOW = "لكن مستوى الثقة منخفض بسبب محدودية المعلومات المتاحة."
AR_MEDIUM = "التقدير متوسط الثقة بناءً على البيانات المتاحة."
AR_HIGH = "التقدير عالي الثقة بناءً على بيانات السوق المتاحة."

# ---------------------------------------------------------------------------
# rental
# ---------------------------------------------------------------------------
RENTAL_YIELDS = {
    ("urban", "Apartment"):     (0.055, 0.075, 0.065),
    ("urban", "Villa"):         (0.045, 0.065, 0.055),
    ("urban", "Duplex"):        (0.050, 0.070, 0.060),
    ("urban", "Penthouse"):     (0.050, 0.070, 0.060),
    ("urban", "Chalet"):        (0.040, 0.060, 0.050),
    ("new_cairo", "Apartment"): (0.055, 0.070, 0.062),
    ("new_cairo", "Villa"):     (0.045, 0.060, 0.052),
    ("new_cairo", "Duplex"):    (0.050, 0.065, 0.057),
    ("new_cairo", "Penthouse"): (0.050, 0.065, 0.057),
    ("coastal", "Apartment"):   (0.040, 0.060, 0.050),
    ("coastal", "Villa"):       (0.035, 0.055, 0.045),
    ("coastal", "Chalet"):      (0.045, 0.065, 0.055),
    ("coastal", "Duplex"):      (0.040, 0.060, 0.050),
    ("red_sea", "Apartment"):   (0.045, 0.065, 0.055),
    ("red_sea", "Villa"):       (0.040, 0.060, 0.050),
    ("red_sea", "Chalet"):      (0.050, 0.070, 0.060),
}
DEFAULT_YIELD = (0.050, 0.070, 0.060)

FEATURE_ALIASES = {
    "furnished": ["مفروش", "مفروشة", "مفروشه", "فرش كامل", "فرش", "تأثيث", "fully furnished", "furnished", "semi furnished"],
    "ac": ["تكييف", "تكييفات", "تكيف", "مكيف", "مكيفة", "مكيفه", "مكيفات", "ac", "air condition", "air conditioning", "conditioning"],
    "parking": ["جراج", "موقف", "باركينج", "جراجات", "مواقف", "parking", "garage", "car park", "موقف سيارات", "موقف خاص"],
    "elevator": ["مصعد", "اسانسير", "أسانسير", "اسانسيرات", "مصاعد", "elevator", "lift"],
    "security": ["امن", "حارس", "حرس", "بوابة", "بوابات", "سيكيوريتي", "security", "guard", "gated", "secured"],
    "gym": ["جيم", "نادي رياضي", "رياضة", "فتنس", "gym", "fitness", "health club", "sports club"],
    "pool": ["حمام سباحة", "بيسين", "مسطح مائي", "سباحة", "pool", "swimming pool", "swimming"],
    "balcony": ["بلكونة", "بلكونه", "تراس", "لانش", "شرفة", "balcony", "terrace", "lanai", "veranda", "patio"],
    "garden": ["حديقة", "جاردن", "جاردنات", "حدائق", "garden", "private garden", "green area", "yard"],
    "storage": ["مخزن", "مخازن", "مستودع", "تخزين", "storage", "store room", "storeroom"],
    "generator": ["مولد", "مولدات", "كهرباء احتياطية", "باور", "generator", "power backup", "backup power"],
    "cameras": ["كاميرات", "كاميرا", "مراقبة", "cameras", "cctv", "surveillance", "security cameras"],
    "mosque": ["مسجد", "مساجد", "مصلى", "صلاة", "mosque", "prayer area", "masjid"],
    "school": ["مدرسة", "مدارس", "تعليم", "دولي", "school", "international school", "academy", "nursery"],
    "hospital": ["مستشفى", "مستشفيات", "عيادة", "مركز صحي", "hospital", "clinic", "medical center"],
    "transport": ["مترو", "مواصلات", "مواصلات عامة", "حافلة", "اتوبيس", "ترام", "transport", "metro", "subway", "bus", "station", "near station"],
    "wifi": ["واي فاي", "واى فاى", "انترنت", "نت", "dsl", "فايبر", "wifi", "wi-fi", "internet", "broadband", "fiber"],
}
SHORT_ALIAS_MAX_LEN = 4
CHECKBOX_TRUE = ["yes", "true", "1", "on"]

ARABIC_VARIANTS = [
    ("اسانسير", "مصعد"),
    ("أسانسير", "مصعد"),
    ("اسانسيرات", "مصاعد"),
    ("واى فاى", "واي فاي"),
    ("تكيف", "تكييف"),
    ("مكيفه", "مكيفة"),
    ("مفروشه", "مفروشة"),
    ("بلكونه", "بلكونة"),
    ("جراجات", "جراج"),
    ("مواقف", "موقف"),
    ("مصاعد", "مصعد"),
    ("مولدات", "مولد"),
    ("كاميرا", "كاميرات"),
    ("مساجد", "مسجد"),
    ("مدارس", "مدرسة"),
    ("مستشفيات", "مستشفى"),
    ("عيادة", "مستشفى"),
]

FEATURE_WEIGHTS = {
    "furnished": 20,
    "transport": 10,
    "ac": 8,
    "parking": 6,
    "pool": 5,
    "elevator": 5,
    "security": 5,
    "garden": 4,
    "gym": 4,
    "balcony": 3,
    "generator": 3,
    "cameras": 3,
    "storage": 2,
    "wifi": 2,
    "school": 2,
    "hospital": 2,
    "mosque": 1,
}

# rent zone: first match wins, literal substrings
RENT_ZONE_WORDS = [
    ("coastal", ["north coast", "sahel", "ras el hekma", "matrouh",
                 "hacienda", "marassi", "amwaj", "bo island", "jefaira"]),
    ("red_sea", ["sokhna", "red sea", "ghardaqa", "hurghada",
                 "sharm", "dahab", "porto sokhna"]),
    ("new_cairo", ["new cairo", "5th settlement", "fifth settlement",
                   "tagamoa", "التجمع"]),
]
RENT_ZONE_DEFAULT = "urban"

# premium tiers: (score upper bound inclusive, premium, tier)
PREMIUM_TIERS = [
    (10, 0.0, "base"),
    (20, 0.05, "standard"),
    (35, 0.12, "enhanced"),
    (50, 0.20, "premium"),
]
PREMIUM_TOP = (0.30, "luxury")
PREMIUM_CAP = 0.45

RENT_CONF_BASE = 50
RENT_CONF_CHECKBOX, RENT_CONF_NLP, RENT_CONF_SOURCE_CAP = 5, 2, 80
RENT_UNKNOWN_AREAS = ["unknown", "", "na", "n/a"]
RENT_GOOD_AREAS = ["new cairo", "sheikh zayed", "6th october",
                   "nasr city", "maadi", "zamalek", "heliopolis"]
RENT_AREA_UNKNOWN, RENT_AREA_GOOD, RENT_AREA_OTHER = -15, 10, 5
RENT_DESC_SHORT, RENT_DESC_LONG = 20, 100
RENT_DESC_SHORT_ADJ, RENT_DESC_LONG_ADJ = -10, 5
RENT_RARITY_HIGH, RENT_RARITY_MED = 0.5, 0.3
RENT_RARITY_HIGH_ADJ, RENT_RARITY_MED_ADJ = -15, -8

RENT_BANDS = {"MEDIUM": (0.80, 1.25), "LOW": (0.70, 1.35), "HIGH": (0.85, 1.20)}
RENT_EXTREME_LOW, RENT_EXTREME_HIGH = 0.50, 2.00
MONTHS = 12.0

RENT_ZONE_LABELS = {
    "coastal": "الساحلية",
    "red_sea": "البحر الأحمر",
    "new_cairo": "القاهرة الجديدة",
    "urban": "المشابهة",
}
RENT_AR_UNDER = "السعر أقل من المتوقع ({lo}–{hi}) مقارنة بالعقارات {zone}."
RENT_AR_OVER = "السعر المطلوب أعلى من المعتاد ({lo}–{hi}) للعقارات {zone}."
RENT_AR_FAIR = "السعر ضمن النطاق المتوقع ({lo}–{hi}) للعقارات {zone}."
RENT_AR_LOW = "لكن مستوى الثقة منخفض بسبب محدودية البيانات المتاحة."
RENT_AR_MANY = "التقدير يعتمد على المميزات المتعددة المتوفرة في العقار."
RENT_AR_SOME = "التقدير يعتمد على المميزات المتوفرة والموقع."
RENT_AR_BASIC = "التقدير يعتمد على المنطقة والمميزات الأساسية المتوفرة."
RENT_SCORE_MANY, RENT_SCORE_SOME = 30, 15

# ---------------------------------------------------------------------------
# Payment / cash equivalence
# ---------------------------------------------------------------------------
ANNUAL_DISCOUNT_RATE = 0.14
INSTALLMENT_MULTIPLIERS = {
    "cash":      1.00,
    "short":     1.05,
    "medium":    1.10,
    "long":      1.18,
    "very_long": 1.25,
}
DOWN_PAYMENT_IMPACT = {
    "high":     0.00,
    "medium":   0.03,
    "low":      0.05,
    "very_low": 0.08,
}
# installment tiers by years (upper bound inclusive)
INSTALLMENT_TIERS = [(4, "short"), (7, "medium"), (12, "long")]
INSTALLMENT_TOP = "very_long"
# down-payment tiers by ratio (lower bound inclusive)
DOWN_PAYMENT_TIERS = [(0.30, "high"), (0.15, "medium"), (0.05, "low")]
DOWN_PAYMENT_BOTTOM = "very_low"
LINEAR_MULT_CAP = 1.35
ADJUSTED_THRESHOLD = 1.01
PAYMENT_INSTALLMENT_WORDS = ["install", "قسط", "تقسيط", "installment"]
PAY_AR_PV = "تم احتساب تأثير القيمة الحالية للتقسيط الطويل عند تحليل السعر."
PAY_AR_SHORT = "تم احتساب تأثير التقسيط القصير عند تحليل السعر."
PAY_AR_LONG = "السعر يتضمن نظام سداد طويل الأمد قد يرفع القيمة الإجمالية للعقار."
PAY_AR_OTHER = "تم احتساب تأثير نظام التقسيط عند تحليل السعر."

# ---------------------------------------------------------------------------
# Sentences of the reason and of the down-payment warning
# ---------------------------------------------------------------------------
REASON_ENGLISH = "Similar {prefix}{type}s in {area} typically sell between {low} and {high}. Your price is {interpretation}{note}"
REASON_STRONG = ("significantly {word} than the market range ({low}–{high}). Your price is ~{dev}% {direction} expected value, "
                 "placing it {position} of comparable listings.")
REASON_STRONG_FROM = 25
REASON_POSITION = "{end}{pct}%"
REASON_LOWEST, REASON_HIGHEST = "among the lowest ", "among the highest "
REASON_MILD = "{word} than most comparable listings in the {low}–{high} range."
REASON_FAIR = "generally in line with the market range of {low}–{high}."
DOWN_PAYMENT_WARNING = ("⚠️ Alert: The entered price ({ask}) equals {share}% of the expected price. "
                        "Did you enter the down payment (≈{guess}) instead of the full price?")

# ---------------------------------------------------------------------------
# monitoring
# ---------------------------------------------------------------------------
PSI_MONITOR = 0.10
PSI_RETRAIN = 0.25
PSI_BINS = 10
PSI_EPS = 1e-4
BIAS_WARNING_PCT = 20.0
BIAS_MIN_N = 5
MAPE_MIN_N = 10
