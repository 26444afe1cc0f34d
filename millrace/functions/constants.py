"""Word lists, tables and patterns that results depend on."""

# Fixed values, in the order that decides between them.
LEGACY_TYPES = {
    "activity_feed": "daily_activity_log",
    "alert": "community_alert",
    "incident_log": "incident_report",
    "incident_reports": "incident_report",
    "open_data_api": "open_data_record",
    "pdf_library": "pdf_document",
}
VALID_TYPES = ("press_release", "arrest_log", "daily_activity_log", "community_alert", "incident_report", "crimemapping_incident", "open_data_record", "pdf_document", "rss_item")
PLATFORM_PRIORS = {
    "crimemapping": ("crimemapping_incident", 1.0),
    "citizenrims": ("incident_report", 0.9),
    "nixle": ("community_alert", 0.9),
    "rave": ("community_alert", 0.9),
    "socrata": ("open_data_record", 0.85),
    "arcgis": ("open_data_record", 0.85),
    "pdf": ("pdf_document", 0.75),
    "civicplus": ("press_release", 0.7),
    "rss": ("rss_item", 0.7),
}
URL_SIGNALS = (
    ("/press.?release|/news/|/media-release", "press_release", 0.2),
    ("/arrest|/booking|/jail|/inmate", "arrest_log", 0.25),
    ("/activity.?log|/daily.?log|/blotter|/patrol-log", "daily_activity_log", 0.25),
    ("/alert|/warn|/emergency|/bolo", "community_alert", 0.2),
    ("/incident|/crime.?report", "incident_report", 0.2),
)
KEYWORDS = {
    "press_release": ("press release", "for immediate release", "media contact", "public information officer", "pio"),
    "arrest_log": ("arrested", "booking", "bail", "arraignment", "charges filed", "booked into", "remanded"),
    "daily_activity_log": ("daily activity", "patrol log", "calls for service", "cad report", "shift summary", "service calls"),
    "community_alert": ("bolo", "be on the lookout", "wanted", "missing person", "amber alert", "silver alert", "shelter in place", "advisory"),
    "incident_report": ("case number", "report number", "occurred at", "victim reported", "suspect fled", "investigation ongoing"),
}
COUNTY_REGIONS = {
    "Bay Area": ("Alameda", "Contra Costa", "Marin", "Napa", "San Francisco", "San Mateo", "Santa Clara", "Solano", "Sonoma"),
    "Sacramento": ("Sacramento", "El Dorado", "Placer", "Yolo", "Sutter", "Yuba"),
    "Central Valley": ("San Joaquin", "Stanislaus", "Merced", "Madera", "Fresno", "Kings", "Tulare", "Kern"),
    "NorCal": ("Del Norte", "Siskiyou", "Modoc", "Humboldt", "Trinity", "Shasta", "Lassen", "Tehama", "Glenn", "Mendocino", "Lake", "Colusa", "Butte", "Plumas", "Sierra", "Nevada"),
    "Central Coast": ("Santa Cruz", "San Benito", "Monterey", "San Luis Obispo", "Santa Barbara", "Ventura"),
    "Inland Empire": ("Riverside", "San Bernardino"),
    "SoCal": ("Los Angeles", "Orange"),
    "San Diego": ("San Diego", "Imperial"),
}
PAGE_RULES = (
    # platform, address tokens, markup tokens
    ("citizenrims", ("citizenrims.com",), ("CitizenRIMS", "citizen-rims")),
    ("crimegraphics", ("crimegraphics.com",), ("CrimeGraphics",)),
    ("crimemapping", ("crimemapping.com",), ("CrimeMapping", "crimemapping")),
    ("civicplus", (), ("civicplus", "CivicPlus", "civic-plus")),
    ("nixle", ("nixle.com",), ("nixle", "Nixle")),
    ("axon", (), ("axon.com", "evidence.com", "Axon")),
    ("mark43", (), ("mark43", "Mark43")),
    ("socrata", (), ("socrata", "Socrata")),
    ("arcgis", ("arcgis",), ("ArcGIS", "arcgis")),
    ("rave", (), ("rave", "RaveMobileSafety", "smart911")),
)
NEWS_WORDS = ("news", "press", "release", "alert", "blotter", "arrest", "log", "crime", "activity", "incident")
PROBE_PATHS = ("/CivicAlerts.aspx", "/news", "/News", "/press-releases", "/Press-Releases", "/news-releases", "/police-news", "/department-news")
DATE_FIELDS = ("date_occ", "date_rptd", "date", "datetime", "incident_date", "reported_date", "occurred_date")
TYPE_FIELDS = ("crm_cd_desc", "offense_type", "incident_category", "crime_type", "offense_description", "type_desc")
LOCATION_FIELDS = ("location", "address", "block_address", "incident_address", "location_1")
REPORT_FIELDS = ("dr_no", "incident_number", "report_id", "case_number", "report_number", "id")
FEATURE_TYPE_FIELDS = (*TYPE_FIELDS, "incident_type")
FEATURE_REPORT_FIELDS = ("dr_no", "incident_number", "report_id", "case_number", "report_number", "objectid", "id")
# Boilerplate rules in order: pattern, and whether letter case is ignored. One that starts with
# ^ blanks the whole line.
BOILERPLATE = {
    "civicplus": (
        (r"\bShare\b.*?\bPrint\b.*?\bEmail\b", True),
        (r"\b(Share|Print|Email)\s+(this\s+)?(page|article|post)\b", True),
        (r"^\s*(Home|Residents|Government|Services|Departments)\s*[/|>]\s*", True),
        (r"\bHome\s*[/|>]\s*(Residents|Government|Services|Departments)\b", True),
        (r"sign\s+up\s+for\s+(news|alerts?|notifications?|updates?)", True),
        (r"subscribe\s+to\s+(news|alerts?|notifications?|email\s+updates?)", True),
        (r"(this\s+site\s+uses?\s+cookies?|we\s+use\s+cookies?)[^.]*\.", True),
        (r"(accept\s+all\s+cookies?|cookie\s+policy|cookie\s+settings?)", True),
        (r"powered\s+by\s+civicplus", True),
        (r"civicplus\s+(cms|platform|technology)", True),
    ),
    "crimemapping": (
        (r"powered\s+by\s+crime\s*mapping", True),
        (r"\bview\s+map\b", True),
        (r"\b(download|export)\s+(report|data|csv|pdf)\b", True),
        (r"\bfilter\s+(by|results?|incidents?)\b", True),
        (r"^\s*(Category|Type|Status|Zone|Beat|District|Address):\s*$", True),
        (r"^\s*(Show|Hide)\s+(all|filters?|map|legend)\s*$", True),
    ),
    "nixle": (
        (r"sent\s+via\s+(nixle|rave)", True),
        (r"to\s+manage\s+your\s+notifications?", True),
        (r"\bunsubscribe\b[^.]*", True),
        (r"(standard\s+)?((sms|message|data)\s+rates?\s+(may\s+)?apply)", True),
        (r"reply\s+stop\s+to\s+(opt.?out|unsubscribe|cancel)", True),
        (r"reply\s+(stop|help|info)\b[^.]*", True),
        (r"you\s+(are\s+)?receiving\s+this\s+(message|alert|notification)", True),
    ),
    "pdf": (
        (r"^\s*CONFIDENTIAL\s*$", False),
        (r"^\s*FOR\s+OFFICIAL\s+USE\s+ONLY\s*$", False),
        (r"^\s*LAW\s+ENFORCEMENT\s+SENSITIVE\s*$", False),
        (r"^\s*THIS\s+PAGE\s+(INTENTIONALLY\s+)?LEFT\s+BLANK\s*$", False),
        (r"^\s*[A-Z\s]{10,}\s+(?:POLICE|SHERIFF|DEPARTMENT|DEPT\.?)\s*$", False),
    ),
    "default": (
        (r"(this\s+site\s+uses?\s+cookies?|we\s+use\s+cookies?)[^.]*\.", True),
        (r"(accept\s+all\s+cookies?|cookie\s+policy)", True),
        (r"^\s*(Home|About|Contact|Search|Menu|Navigation|Accessibility)\s*$", True),
        (r"follow\s+us\s+on\s+(facebook|twitter|instagram|x|youtube|linkedin)", True),
        (r"like\s+us\s+on\s+facebook", True),
        (r"©\s*\d{4}[^.\n]*", True),
        (r"copyright\s+\d{4}[^.\n]*", True),
        (r"^\s*back\s+to\s+top\s*$", True),
    ),
}
# For each rule set, in lower case, words of which a line must hold one for any of its rules to match.
BOILERPLATE_WORDS = {
    "civicplus": ("share", "print", "email", "home", "residents", "government", "services", "departments", "sign", "subscribe", "cookie", "civicplus"),
    "crimemapping": ("map", "download", "export", "filter", "category:", "type:", "status:", "zone:", "beat:", "district:", "address:", "show", "hide"),
    "nixle": ("sent", "manage", "unsubscribe", "apply", "reply", "receiving"),
    "pdf": ("confidential", "official", "enforcement", "page", "police", "sheriff", "department", "dept"),
    "default": ("cookie", "home", "about", "contact", "search", "menu", "navigation", "accessibility", "follow", "like", "©", "copyright", "back"),
}
# Letters that a pattern without letter case takes for i, k or s, and that lower case keeps apart.
ODD_LETTERS = ("\u0130", "\u0131", "\u017f", "\u212a")
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_STREET = r"(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Pl|Hwy|Fwy|Pkwy|Cir|Ter|Loop)"
PROTECTED = (
    (r"\b(CAD|DR|case|report\s+no\.?|badge|ORI)[#:\s]+[\w-]+", True),
    (r"\d+\s+(?:[NSEW]\.?\s+)?[A-Za-z][\w\s]+\s+" + _STREET + r"\.?\b", True),
    (r"\b\d{1,2}/\d{1,2}/\d{4}\b", False),
    (r"\b\d{4}-\d{2}-\d{2}\b", False),
    (r"\b" + _MONTH + r"\.?\s+\d{1,2},\s+\d{4}\b", True),
    (r"\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+" + _MONTH + r"\.?\s+\d{1,2}", True),
    (r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", False),
    (r"\(\d{3}\)\s*\d{3}[-.\s]\d{4}", False),
)
SCORE_DATE = r"\b(?:\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},\s+\d{4})\b"
SCORE_ID = r"\b(CAD|DR|case|report\s+no\.?|incident)[#:\s]+[\w-]+"
SCORE_ADDRESS = r"\b\d+\s+(?:[NSEW]\.?\s+)?[A-Za-z][\w\s]+\s+" + _STREET + r"\.?\b"
# Accepted date patterns by source, in order.
DATES_LISTING = ("yyyy-M-d'T'H:m:s", "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy")
DATES_TABLE = ("M/d/yyyy H:m", "M/d/yyyy h:m a", "M/d/yyyy h:m:s a", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d", "M/d/yyyy")
DATES_MAP = ("M/d/yyyy h:m:s a",)
DATES_OPEN_DATA = ("yyyy-M-d'T'H:m:s", "yyyy-M-d", "yyyy-M-d'T'H:m:s.SSSSSS")
DATES_PDF = ("MMMM d, yyyy", "MMM d, yyyy", "MMM. d, yyyy", "M/d/yyyy")
DATES_ISO = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
PDF_DATE_HEADER = r"(?i)^(?:(?:MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY),\s+(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\s+\d{1,2},\s+\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"
LISTING_SELECTORS = ("li.list-group-item", ".civicAlert", ".alertItem", "#fa_newslist .fa_rowcmp", "article")
TABLE_SELECTORS = ("table.table tbody tr", "table.incidents tbody tr", "table#incidentTable tbody tr", "table#callTable tbody tr", ".incident-row", ".call-row", "table tbody tr")
ALERT_SELECTORS = (".alert-item", ".nixle-alert", ".alertItem", ".alert-card", "article.alert", "article")
