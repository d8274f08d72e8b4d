"""Word lists, patterns and weights that results depend on."""

# Characters replaced one by one before a page is cleaned.
BLANKS = "\u00a0\u2007\u202f"
DELETED = "\u200b\ufeff\u0000"
DOUBLE_QUOTES = "\u201c\u201d"
SINGLE_QUOTES = "\u2018\u2019"
DASHES = "\u2013\u2014\u2212\u2022\u25aa\u2023"  # dashes, the minus sign and bullets
ELLIPSES = "\u2026\u22ef"

# Items whose bare heading is navigation.
BARE_ITEMS = ["1", "1A", "1B", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "10", "11", "12", "13", "14", "15"]
PAGE_NOISE_EXACT = ["", "Table of Contents", "Page", "PART I", "PART II", "PART III", "PART IV"] + [f"Item {i}." for i in BARE_ITEMS]
PAGE_NOISE = [r"^\s*\d+\s*$", r"(?i)^\s*page\s+\d+\s*$", r"^\s*[Ff]\-\d+\s*$", r"^[\s\-_=]+$"]
PAGE_NOISE_AGGRESSIVE = [r"^\s*\d{1,2}\s*$", r"^\s*\.+\s*$", r"^\s*[\d\s,\.]+\s*$"]

# Lines that make a chunk navigation.
CHUNK_NOISE_EXACT = ["", "Table of Contents", "Page", "Part I", "Part II", "Part III", "Part IV"] + [f"Item {i}." for i in BARE_ITEMS]
CHUNK_NOISE = [
    r"(?i)^\s*table of contents\s*$",
    r"(?i)^\s*exhibits?\s*$",
    r"(?i)^\s*signatures?\s*$",
    r"(?i)^\s*report of independent registered public accounting firm\s*$",
    r"(?i)^\s*incorporated by reference\s*$",
    r"(?i)^\s*report on internal control over financial reporting\s*$",
    r"(?i)^\s*form\s+10[-]?k\s*$",
    r"(?i)^\s*securities and exchange commission\s*$",
    r"(?i)^\s*washington,\s*d\.c\.\s*20549\s*$",
    r"(?i)^\s*item\s+\d+[ab]?\.\s*$",
]

# Words left out of lexical queries, and short ones that count.
STOPWORDS = "what are the in did how main of or and to by for with on from a an their its annual report".split()
SHORT_TOKENS = "ai ar vr ml ui ux eps".split()

# Company names in queries, in order, and the years that count.
COMPANY_ALIASES = [("adobe", "adobe"), ("lockheed martin", "lockheedmartin"), ("lockheedmartin", "lockheedmartin"), ("pfizer", "pfizer")]
QUERY_YEARS = ["2022", "2023", "2024"]

# Sections as (code, title, group, heading patterns, body patterns, priority).
SECTIONS = [
    ("item_1", "Business", "business", [r"item\s*1[\.\-:\s]+business", r"business"], [r"\bbusiness\b"], 1.00),
    ("competition", "Competition", "competition", [r"competition"], [r"\bcompetition\b", r"\bcompetitive\b"], 1.05),
    ("item_1a", "Risk Factors", "risk_factors", [r"item\s*1a[\.\-:\s]+risk factors", r"risk factors"], [r"\brisk factors\b"], 1.15),
    ("item_1c", "Cybersecurity", "cybersecurity", [r"item\s*1c[\.\-:\s]+cybersecurity", r"cybersecurity"], [r"\bcybersecurity\b"], 1.10),
    ("item_2", "Properties", "properties", [r"item\s*2[\.\-:\s]+properties", r"properties"], [r"\bproperties\b"], 1.00),
    ("item_3", "Legal Proceedings", "legal_proceedings", [r"item\s*3[\.\-:\s]+legal proceedings", r"legal proceedings"], [r"\blegal proceedings\b"], 1.10),
    (
        "executive_officers",
        "Information About Our Executive Officers",
        "executives",
        [r"item\s*4a?[\.\-:\s]+information about (our )?executive officers", r"information about (our )?executive officers"],
        [r"\bexecutive officers\b"],
        1.00,
    ),
    (
        "item_5",
        "Market For Registrant's Common Equity",
        "market_and_equity",
        [r"item\s*5[\.\-:\s]+market for registrant'?s common equity.*", r"market for registrant'?s common equity.*"],
        [r"\bmarket for registrant'?s common equity\b"],
        1.05,
    ),
    (
        "item_7",
        "Management's Discussion and Analysis",
        "management_discussion",
        [r"item\s*7[\.\-:\s]+management'?s discussion.*analysis.*", r"management'?s discussion.*analysis.*", r"management discussion and analysis.*"],
        [r"\bmanagement'?s discussion\b", r"\bresults of operations\b"],
        1.15,
    ),
    (
        "item_7a",
        "Quantitative And Qualitative Disclosures About Market Risk",
        "market_risk",
        [r"item\s*7a[\.\-:\s]+quantitative and qualitative disclosures about market risk", r"quantitative and qualitative disclosures about market risk"],
        [r"\bmarket risk\b"],
        1.10,
    ),
    (
        "item_8",
        "Financial Statements And Supplementary Data",
        "financial_statements",
        [
            r"item\s*8[\.\-:\s]+financial statements.*",
            r"financial statements.*supplementary data",
            r"consolidated statements of (income|operations|cash flows|financial position).*",
        ],
        [r"\bfinancial statements\b", r"\bconsolidated statements of income\b", r"\bconsolidated balance sheets\b"],
        1.20,
    ),
    (
        "principal_products",
        "Principal Products, Services And Solutions",
        "products_and_offerings",
        [r"principal products, services and solutions", r"products, services and solutions"],
        [r"\bprincipal products, services and solutions\b"],
        1.05,
    ),
    ("operations", "Operations", "operations", [r"operations"], [r"\boperations\b"], 1.00),
]
FRONT_MATTER = ("front_matter", "Front Matter", "front_matter")
CONTENTS_SIGNALS = [
    "risk factors",
    "legal proceedings",
    "management's discussion",
    "management discussion",
    "quantitative and qualitative disclosures about market risk",
    "financial statements",
]

# What a query's words say about its intent, in order.
INTENTS = {
    "risk_factors": ["risk factor", "risks", "risk"],
    "competition": ["competition", "competitive", "competitor", "compete"],
    "business_segments": ["business segment", "segments", "segment"],
    "financial_metrics": ["financial metric", "financial metrics", "eps", "revenue", "income", "margin", "cash flow"],
    "ai": ["artificial intelligence", "generative ai", "ai-related"],
}
# Words of a chunk that speak for an intent.
INTENT_PATTERNS = {
    "risk_factors": [r"risk factors", r"\brisk\b", r"\buncertaint", r"\bcybersecurity\b", r"\bthreat", r"\badverse\b"],
    "competition": [r"\bcompetition\b", r"\bcompetitive\b", r"\bcompetitor", r"\bcompete\b", r"\bbid", r"\bbidders\b", r"\bmarket position\b"],
    "business_segments": [r"\bbusiness segment", r"\bsegment\b", r"\boperating segment\b", r"\bcommercial\b", r"\bportfolio\b", r"\bproducts?\b", r"\bservices?\b"],
    "financial_metrics": [
        r"\brevenue\b",
        r"\bincome\b",
        r"\bnet income\b",
        r"\boperating income\b",
        r"\bps\b",
        r"\bdiluted eps\b",
        r"\bcash flow\b",
        r"\bmargin\b",
        r"\bprofit\b",
    ],
    "ai": [r"\bartificial intelligence\b", r"\bgenerative ai\b", r"\bgenerative artificial intelligence\b", r"\bmachine learning\b", r"\bai\b"],
}
# Sections wanted and unwanted for an intent.
WANTED = {
    "risk_factors": {"risk_factors": 1.00, "cybersecurity": 0.45, "management_discussion": 0.20},
    "competition": {"competition": 1.00, "business": 0.35, "products_and_offerings": 0.20, "risk_factors": 0.15},
    "business_segments": {"business": 0.95, "products_and_offerings": 0.80, "operations": 0.35},
    "financial_metrics": {"financial_statements": 1.00, "management_discussion": 0.90, "market_risk": 0.30},
    "ai": {"products_and_offerings": 0.80, "business": 0.55, "competition": 0.20},
}
UNWANTED = {
    "risk_factors": {"front_matter": 0.45, "business": 0.18, "financial_statements": 0.55, "market_and_equity": 0.20},
    "competition": {"front_matter": 0.25, "financial_statements": 0.40},
    "business_segments": {"front_matter": 0.25, "financial_statements": 0.30},
    "ai": {"front_matter": 0.20, "financial_statements": 0.25},
}
# Fixed values: (relation, intent or words of the query, score).
RELATION_BY_INTENT = [("COMPETES_WITH", "competition", 1.0), ("REPORTS", "financial_metrics", 1.0), ("FACES_RISK_FROM", "risk_factors", 1.0)]
RELATION_BY_WORD = [
    ("OFFERS", ["offer", "product", "products", "platform", "service"], 0.85),
    ("LEADS_BY", ["ceo", "chief executive", "lead", "led by", "executive"], 0.85),
    ("MENTIONS", ["mention", "mentions", "mentioned"], 0.50),
]

# Guardrail patterns by family.
INJECTION = [
    r"\bignore (all|any|the|previous|prior)\b",
    r"\boverride\b",
    r"\bdisregard\b",
    r"\bforget (the|your)\b",
    r"\bdeveloper message\b",
    r"\bsystem prompt\b",
    r"\bhidden instructions\b",
    r"\buse outside knowledge\b",
    r"\bbrowse the web\b",
    r"\bfabricate citations?\b",
]
BIAS = [r"\bscam\b", r"\bfraud\b", r"\bcorrupt\b", r"\billegal\b", r"\bdishonest\b", r"\bworst company\b", r"\bterrible company\b", r"\bevil\b", r"\bcriminal\b"]
REFUSAL = [
    r"\bnot available in the provided context\b",
    r"\binsufficient context\b",
    r"\bprovided context does not contain\b",
    r"\bi cannot verify\b",
    r"\bi cannot provide a grounded answer\b",
]
LOADED = [r"\bscam\b", r"\bfraud\b", r"\bcriminal\b", r"\bevil\b", r"\bdishonest\b", r"\bterrible\b", r"\bworthless\b"]

# Source companies and their spellings.
SOURCE_ALIASES = {
    "adobe": ["adobe", "adobe inc.", "adobe inc"],
    "lockheedmartin": ["lockheed martin", "lockheed martin corporation", "lockheedmartin"],
    "pfizer": ["pfizer", "pfizer inc.", "pfizer inc"],
}
COMPETITION_SIGNALS = [r"\bcompetition\b", r"\bcompetitive\b", r"\bcompetitor", r"\bcompete\b", r"\brisk\b", r"\brisk factors\b"]
LEGAL_SUFFIXES = [
    r",?\s+inc\.?$",
    r",?\s+incorporated$",
    r",?\s+corp\.?$",
    r",?\s+corporation$",
    r",?\s+ltd\.?$",
    r",?\s+limited$",
    r",?\s+plc$",
    r",?\s+llc$",
    r",?\s+group$",
]
NOT_COMPETITORS = [
    "adobe foundation",
    "european commission",
    "u.s. internal revenue service",
    "internal revenue service",
    "irs",
    "the metropolitan museum of art",
    "pfizer",
    "adobe",
    "lockheedmartin",
    "lockheed martin",
]
NOT_COMPETITOR_PATTERNS = [
    r"\bfoundation\b",
    r"\bcommission\b",
    r"\bdepartment\b",
    r"\bministry\b",
    r"\bgovernment\b",
    r"\bagency\b",
    r"\bauthorit",
    r"\buniversity\b",
    r"\bcollege\b",
    r"\bmuseum\b",
    r"\binternal revenue service\b",
    r"\birs\b",
    r"\bcommissioner\b",
    r"\bassociation\b",
    r"\bcouncil\b",
    r"\badministration\b",
]
GENERIC_NAME_PATTERNS = [
    r"\bproducts?\b",
    r"\bservices?\b",
    r"\bsolutions?\b",
    r"\bsystems?\b",
    r"\bplatforms?\b",
    r"\bsoftware\b",
    r"\bpublishing\b",
    r"\bmarket\b",
    r"\bmarkets\b",
    r"\bcompany\b",
    r"\bcompanies\b",
]
GENERIC_NAMES = ["company", "business", "market", "markets", "industry", "industries", "competitor", "competitors"]

# Entity types, relations, and what isn't one.
ENTITY_TYPES = {
    "company": "company",
    "companies": "company",
    "executive": "executive",
    "executives": "executive",
    "person": "executive",
    "product": "product",
    "products": "product",
    "financial_metric": "financial_metric",
    "financial metrics": "financial_metric",
    "metric": "financial_metric",
    "metrics": "financial_metric",
}
NOT_PRODUCTS = [
    "common stock",
    "class a",
    "class b",
    "class a common stock",
    "class b common stock",
    "software-as-a-service",
    "saas",
    "subscription",
    "subscriptions",
    "service",
    "services",
    "product",
    "products",
]
NOT_METRICS = ["adbe", "pfe", "lmt"]
NOT_EXECUTIVES = ["chief executive officer", "ceo", "chairman", "executive officer", "officer"]
RELATIONS = ["COMPETES_WITH", "OFFERS", "LEADS_BY", "REPORTS", "MENTIONS", "FACES_RISK_FROM"]
RELATION_ALIASES = {
    "COMPETES": "COMPETES_WITH",
    "COMPETITOR_OF": "COMPETES_WITH",
    "PROVIDES": "OFFERS",
    "SELLS": "OFFERS",
    "LED_BY": "LEADS_BY",
    "MANAGED_BY": "LEADS_BY",
    "HAS_EXECUTIVE": "LEADS_BY",
    "REPORT": "REPORTS",
    "REPORTS_METRIC": "REPORTS",
    "HAS_RISK_FROM": "FACES_RISK_FROM",
    "RISK_FROM": "FACES_RISK_FROM",
}
GENERIC_ENDS = "company business market markets product products service services risk risks offerings solutions".split()
NOT_OFFERS = [
    "offerings",
    "products",
    "services",
    "solutions",
    "line of products and services",
    "a comprehensive suite of offerings",
    "comprehensive suite of offerings",
    "suite of offerings",
]
NOT_LEADERS = ["chief executive officer", "ceo", "chairman", "officer", "leadership position", "leadership position in document-intensive industries"]
NOT_LEADER_PATTERNS = [r"\bposition\b", r"\bindustr", r"\bmarket\b", r"\bleadership\b", r"\badoption\b"]
METRIC_SIGNALS = [
    r"\brevenue\b",
    r"\bincome\b",
    r"\bnet income\b",
    r"\boperating income\b",
    r"\bps\b",
    r"\bdiluted eps\b",
    r"\bmargin\b",
    r"\bcash flow\b",
    r"\bmarket capitalization\b",
    r"\bshares?\b",
    r"\$\s?\d",
    r"\d+(\.\d+)?\s?%",
]

# Words (between word edges) that make a chunk worth extracting from.
ENTITY_HINTS = [
    "risk", "risk factors", "competition", "competitive", "competitor", "ai", "artificial intelligence", "generative ai", "revenue", "income",
    "ps", "margin", "cash flow", "product", "products", "service", "services", "segment", "segments", "chief executive officer", "ceo",
    "chairman", "executive", "officer", "market share", "operating income", "net income", "cash flow from operations",
]
TRIPLET_HINTS = [
    "competition", "competitive", "competitor", "compete", "risk", "risk factors", "threat", "offers?", "provide", "platform", "product",
    "products", "service", "services", "chief executive officer", "ceo", "chairman", "officer", "revenue", "income", "ps", "cash flow", "ai",
    "artificial intelligence", "margin", "operating income", "net income", "market share",
]

# Retrieval modes and their other names.
MODES = {
    "classical_ml": ["classical_ml", "classic_ml", "ml", "tfidf"],
    "naive": ["naive", "baseline", "simple"],
    "improved": ["improved", "advanced", "hybrid", "dense_hybrid"],
}
# Benchmark selection.
QUESTION_TYPES = ["domain-relevant", "metrics-generated", "novel-generated"]
CORE_QUOTAS = [
    ("AMD", 2022, 6),
    ("American Express", 2022, 6),
    ("Boeing", 2022, 5),
    ("PepsiCo", 2022, 5),
    ("Amcor", 2023, 4),
    ("3M", 2022, 3),
    ("AES Corporation", 2022, 3),
    ("Adobe", 2022, 2),
    ("Best Buy", 2023, 2),
    ("Pfizer", 2021, 3),
    ("Lockheed Martin", 2022, 1),
]
SMOKE_SCOPE = [(c, y) for c in ("Adobe", "Lockheed Martin", "Pfizer") for y in (2022, 2023, 2024)]
# Labels of error causes.
CAUSE_GENERATION, CAUSE_RETRIEVAL, CAUSE_CONTEXT, CAUSE_CHUNKING = "generation imprecise", "mauvais retrieval", "contexte incomplet", "chunking inadequat"
