"""Fixed values. They decide results, so they are spelled out here as text and nowhere else."""

# --- Fixed values: tax categories, rates, flags -------------------------------------------
CATEGORIES = ("standard", "zero_rated", "exempt")
RATES = {"standard": "0.1500", "zero_rated": "0.0000", "exempt": "0.0000"}
UBL_CATEGORY_CODES = ("S", "Z", "E", "O")
UBL_CODE_TO_CATEGORY = {"S": "standard", "Z": "zero_rated", "E": "exempt"}
TAXPAYER_TYPES = ("company", "individual")
CALCULATION_FLAGS = ("reverse_charge_import_of_services", "related_party_zero_rating")
CURRENCY = "SAR"
VAT_NUMBER_LENGTH = 15
MISMATCH_TOLERANCE = "0.02"
REGISTER_TOLERANCE = "0.01"

# --- Fixed values: reconciliation defaults ------------------------------------------------
DATE_PROXIMITY_DAYS = 3
AMOUNT_TOLERANCE = "0.01"
GROUP_MIN_SIZE = 2
GROUP_MAX_SIZE = 4
SUM_MATCH_MAX_DAYS = 90
VAT_GAP_RATIO = "0.15"
VAT_GAP_BAND = "0.005"
SEQUENTIAL_GAP = 20

# --- Fixed values: words that say nothing about a transaction's subject ---------------------
DESCRIPTION_STOP_WORDS = (
    "the", "and", "for", "from", "with", "this", "that", "order", "invoice", "payment",
    "purchase", "receipt", "transfer", "made", "received", "note", "batch", "phase",
    "consolidated", "delivery", "service", "services",
)

# --- Fixed values: header synonyms of a ledger or statement ---------------------------------
LEDGER_SYNONYMS = {
    "reference": [
        "reference", "ref", "ref no", "ref no.", "ref number", "reference number",
        "doc no", "doc no.", "doc number", "document number", "document no",
        "invoice no", "invoice no.", "invoice number", "entry number", "move name",
        "transaction id", "txn id", "voucher no", "voucher number", "cheque no", "check no",
        "receipt no",
    ],
    "date": ["date", "posting date", "transaction date", "entry date", "invoice date", "value date"],
    "amount": ["amount", "total"],
    "debit": ["debit", "dr"],
    "credit": ["credit", "cr"],
    "description": [
        "description", "label", "narration", "narrative", "particulars", "partner", "memo",
        "communication", "details", "remarks", "vendor", "supplier", "customer",
        "counterparty", "payee",
    ],
}

# --- Fixed values: header synonyms of a sales or purchase register --------------------------
REGISTER_SYNONYMS = {
    "amount": ["amount", "taxable amount", "net amount", "value"],
    "vat": ["vat", "vat amount", "tax amount", "output vat", "input vat"],
    "category": ["tax category", "vat category", "category", "rate", "vat rate"],
    "reclaimable": ["reclaimable", "recoverable", "input vat recoverable"],
    "expense_type": ["expense type", "description", "particulars", "narration", "item"],
    "party": ["vendor", "supplier", "customer", "counterparty"],
}
SALES_KEYWORDS = ("sales", "output", "revenue")
PURCHASE_KEYWORDS = ("purchase", "input", "expense", "vendor", "supplier")

# --- Fixed values: reclaimability words -----------------------------------------------------
BLOCKED_KEYWORDS = (
    "entertainment", "sporting", "cultural", "catering", "hospitality", "hotel", "restaurant",
)
AMBIGUOUS_KEYWORDS = (
    "vehicle", "motor", "car rental", "car lease", "fuel", "petrol", "gasoline",
)
STATED_YES = ("y", "yes", "true")
STATED_NO = ("n", "no", "false")

# --- Fixed values: countries outside the knowledge base's jurisdiction, in test order --------
OTHER_JURISDICTIONS = (
    ("bahrain", "Bahrain"), ("البحرين", "Bahrain"),
    ("uae", "UAE"), ("united arab emirates", "UAE"), ("الإمارات", "UAE"), ("الامارات", "UAE"),
    ("oman", "Oman"), ("عمان", "Oman"),
    ("qatar", "Qatar"), ("قطر", "Qatar"),
    ("kuwait", "Kuwait"), ("الكويت", "Kuwait"),
)
JURISDICTION = "KSA"

# --- Fixed values: retrieval and chunking limits ---------------------------------------------
TOP_K = 10
RELEVANCE_THRESHOLD = 0.5
CONTEXT_CAP = 6
MAX_ARTICLE_WORDS = 500
TABLE_TEXT_CHARS = 1500
QA_HISTORY_MESSAGES = 16
CHAT_HISTORY_MESSAGES = 30
WIRE_MESSAGES = 8
BATCH_TTL_HOURS = 24

# --- Fixed values: English number words -------------------------------------------------------
ONES = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")

# --- Fixed values: words dropped from the end of a stated name --------------------------------
NAME_TRAILING_WORDS = ("please", "thanks", "thank", "too", "also", "here", "now", "today")

# --- Fixed values: cell texts a CSV reader takes for "no value" (pandas' documented list) ------
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: block-level tags of the HTML text job ---------------------------------------
HTML_BLOCK_TAGS = ("p", "li", "tr", "h2", "h3", "h4")
HTML_CELL_TAGS = ("th", "td")
HTML_SILENT_TAGS = ("script", "style")
HTML_VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
HTML_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "middot": "\u00b7",
                 "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
                 "euro": "\u20ac", "times": "\u00d7", "sect": "\u00a7", "amp": "&"}
