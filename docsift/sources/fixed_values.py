"""FIXED VALUES — configuration that must equal the behaviour we re-implement.

Everything in this module is data, stated plainly and in natural order:
the three shipped industry configurations, the base (shared) features, the
reply-key mapping, the predefined learner regexes, the street-type map and the
small keyword lists used by the scoring rules.  Code elsewhere turns these into
Spark tables or literal maps; nothing here is executed logic.
"""

# --- Base features (shared ids resolved against this set) -------------------
BASE_FEATURES = {
    "date": {
        "type": "date",
        "patterns": [
            r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
            r"\d{4}-\d{2}-\d{2}",
            r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}",
        ],
        "rules": [("regex", r"^\d{4}-\d{2}-\d{2}$")],
        "description": "Date values in various formats",
        "examples": ["2024-03-15", "03/15/2024", "March 15, 2024"],
    },
    "amount": {
        "type": "amount",
        "patterns": [
            r"\$\d+(?:,\d{3})*(?:\.\d{2})?",
            r"€\d+(?:,\d{3})*(?:\.\d{2})?",
            r"£\d+(?:,\d{3})*(?:\.\d{2})?",
        ],
        "rules": [("regex", r"^[\$€£]\d+(?:,\d{3})*(?:\.\d{2})?$")],
        "description": "Monetary amounts in various currencies",
        "examples": ["$1,234.56", "€1000.00", "£500.00"],
    },
    "identifier": {
        "type": "identifier",
        "patterns": [
            r"[A-Z0-9]+-\d{4}-\d{3,}",
            r"ID[-:]?\s*[A-Z0-9-]+",
            r"[A-Z]{2,}-\d{5,}",
        ],
        "rules": [("regex", r"^[A-Z0-9-]+$"), ("length", '{"min": 5, "max": 50}')],
        "description": "Generic identifier patterns",
        "examples": ["INV-2024-001", "ID: ABC12345", "DOC-12345"],
    },
    "signature": {
        "type": "signature",
        "patterns": [
            r"Signed[:]?\s+[A-Za-z\s,\.]+",
            r"Signature[:]?\s*[_]{3,}",
            r"/s/\s*[A-Za-z\s,\.]+",
        ],
        "rules": [("regex", r"^(Signed:|Signature:|/s/)\s*[A-Za-z\s,\.]+$")],
        "description": "Signature blocks and electronic signatures",
        "examples": ["Signed: John Doe", "Signature: _______", "/s/ Jane Smith"],
    },
}

# --- Industry configurations ---------------------------------------------
INDUSTRIES = {
    "financial": {
        "version": "1.0.0",
        "description": "Financial industry document configuration",
        "shared": ["date", "amount", "identifier"],
        "specific": {
            "invoice_number": {
                "type": "identifier", "importance": "required",
                "patterns": [r"(?:INV|INVOICE)[-:]?\s*[A-Z0-9-]+",
                             r"Invoice\s+Number[-:]?\s*[A-Z0-9-]+"],
                "format": "alphanumeric",
                "rules": [("regex", r"^[A-Z0-9-]+$")],
                "description": "Invoice identification number",
            },
            "payment_terms": {
                "type": "terms", "importance": "recommended",
                "patterns": [r"Net\s+\d+",
                             r"Due\s+(?:on|in)\s+\d+\s+days",
                             r"Terms[-:]?\s*Net\s*\d+"],
                "format": "text",
                "rules": [("regex", r"^(?:Net\s+\d+|Due\s+(?:on|in)\s+\d+\s+days)$")],
                "description": "Payment terms",
            },
            "account_number": {
                "type": "identifier", "importance": "required",
                "patterns": [r"(?:Account|Acct)[-:]?\s*[A-Z0-9-]+",
                             r"Account\s+Number[-:]?\s*[A-Z0-9-]+"],
                "format": "alphanumeric",
                "rules": [("regex", r"^[A-Z0-9-]+$")],
                "description": "Bank account number",
            },
        },
        "required": ["date", "amount"],
        "conditional": [("invoice", ["invoice_number", "payment_terms"]),
                        ("bank_statement", ["account_number"])],
        "thresholds": {"minimum": 0.7, "high": 0.9},
    },
    "healthcare": {
        "version": "1.0.0",
        "description": "Healthcare industry document configuration",
        "shared": ["date", "amount", "identifier"],
        "specific": {
            "patient_id": {
                "type": "patient_identifier", "importance": "required",
                "patterns": [r"(?:Patient|ID)[-:]?\s*[A-Z0-9-]+",
                             r"MRN[-:]?\s*\d+",
                             r"Chart[-:]?\s*[A-Z0-9]+"],
                "format": "alphanumeric",
                "rules": [("regex", r"^[A-Z0-9-]+$")],
                "description": "Patient identification number",
            },
            "medical_code": {
                "type": "procedure_code", "importance": "required",
                "patterns": [r"(?:CPT|ICD)-?10?:?\s*(\d{4,5}(?:\.\d{1,2})?)",
                             r"(?:CPT|ICD)-?10?\s*(\d{4,5}(?:\.\d{1,2})?)"],
                "format": "code",
                "rules": [("regex", r"^\d{4,5}(?:\.\d{1,2})?$")],
                "description": "Medical procedure or diagnosis codes",
            },
            "provider_npi": {
                "type": "npi", "importance": "recommended",
                "patterns": [r"NPI[-:]?\s*(\d{10})",
                             r"Provider\s+ID[-:]?\s*(\d{10})"],
                "format": "numeric",
                "rules": [("regex", r"^\d{10}$")],
                "description": "National Provider Identifier",
            },
        },
        "required": ["patient_id", "medical_code", "date"],
        "conditional": [("claim", ["amount", "provider_npi"])],
        "thresholds": {"minimum": 0.6, "high": 0.8},
    },
    "test_industry": {
        "version": "1.0.0",
        "description": "Test industry",
        "shared": ["date"],
        "specific": {
            "test_feature": {
                "type": "test", "importance": "required",
                "patterns": [r"Test\s+Feature"],
                "format": "text",
                "rules": [("regex", r"^Test Feature$")],
                "description": "A test feature",
            },
        },
        "required": ["test_feature"],
        "conditional": [],
        "thresholds": {"minimum": 0.5, "high": 0.8},
    },
}

# --- Reply key -> feature type mapping (keys are lower-case) ---------------
FEATURE_KEY_MAP = {
    "patient id": "patient_id",
    "date of service": "date",
    "service date": "date",
    "date": "date",
    "agreement date": "date",
    "statement period": "date",
    "appraisal date": "date",
    "semester": "date",
    "cpt code": "cpt_code",
    "cpt codes": "cpt_code",
    "cpt": "cpt_code",
    "service": "cpt_code",
    "icd-10": "diagnosis",
    "icd10": "diagnosis",
    "diagnosis code": "diagnosis",
    "diagnosis": "diagnosis",
    "npi": "npi",
    "provider npi": "npi",
    "provider name": "provider",
    "provider": "provider",
    "invoice number": "invoice_number",
    "amount": "amount",
    "monetary value": "amount",
    "fee structure": "amount",
    "total amount": "amount",
    "opening balance": "amount",
    "closing balance": "amount",
    "market value": "amount",
    "payment terms": "payment_terms",
    "terms": "payment_terms",
    "document type": "document_type",
    "account number": "account_number",
    "contract id": "contract_id",
    "document number": "contract_id",
    "report id": "report_id",
    "property address": "property_address",
    "parties": "parties",
    "student id": "student_id",
    "student name": "student_name",
    "program": "program",
    "gpa": "gpa",
    "course": "course",
    "section": "section",
    "clause": "clause",
}

# --- Reply line rules ---------------------------------------------------
CURRENCY_AMOUNT_REGEX = r"[€£$¥₿]\s?\d+[\d,.]*"
SECTION_LINE_REGEX = r"^\d+\.\s*(.*?)(?:\s*-|$)"
CPT_LINE_REGEX = r"CPT:?\s*(\d{5})"
MULTILINGUAL_PAIRS = ["date/fecha", "amount/monto", "invoice/factura"]

# --- Document-type normalisation -------------------------------------------
DOC_TYPE_UNKNOWN = ["unknown", "unclassified", "not sure", "unclear"]
DOC_TYPE_BANK_STATEMENT = ["bank statement", "bank_statement", "statement", "account statement"]
DOC_TYPE_INVOICE = ["invoice", "bill", "receipt"]
DOC_TYPE_PRESCRIPTION = ["medical prescription", "medical_prescription", "prescription", "rx"]
DOC_TYPE_PREFIX_REGEX = r"^(a |an |the |medical )"
DOC_TYPE_SUFFIX_REGEX = r" (document|doc|form)$"

# --- Industry signal feature types ------------------------------------------
MEDICAL_SIGNALS = ["patient_id", "medical_code", "cpt_code", "npi"]
FINANCIAL_SIGNALS = ["invoice_number", "payment_terms", "account_number"]

# --- Long-document fast path ------------------------------------------------
LONG_DOC_CHARS = 5000
LONG_DOC_NEWLINES = 200
LONG_DOC_INVOICE_REGEX = r"Invoice Number: ([^\n]+)"
LONG_DOC_AMOUNT_REGEX = r"Amount: ([^\n]+)"

# --- Learner: predefined feature regexes ------------------------------------
PREDEFINED_FEATURE_REGEX = {
    "amount": r"^\$?\d+(\.\d{2})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$|^\d{2}-\d{2}-\d{4}$",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
}
LEARNER_BASIC_PATTERNS = [r"\d+", r"[A-Za-z]+", r"[0-9]+"]
LEARNER_TOO_PERMISSIVE = [r".*", r".+", r"\w+"]
LEARNER_NEGATIVE_PROBES = ["", " ", "a", "." * 300, "<text>extra", "invalid"]

# --- Fuzzy address matching ---------------------------------------------
STREET_TYPE_MAP = {
    "st": "street", "str": "street", "street": "street",
    "ave": "avenue", "av": "avenue", "avenue": "avenue",
    "rd": "road", "road": "road",
    "ln": "lane", "lane": "lane",
    "dr": "drive", "drive": "drive",
    "blvd": "boulevard", "boulevard": "boulevard",
}
STREET_TYPES = ["st", "street", "ave", "avenue", "rd", "road",
                "ln", "lane", "dr", "drive", "blvd", "boulevard"]
NAME_TITLES = ["Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Professor", "Doctor"]

# --- Best text variant keywords ------------------------------------------
VARIANT_KEYWORDS = ["INVOICE", "TOTAL", "AMOUNT", "DATE"]

# --- Matcher defaults -----------------------------------------------------
MIN_MATCH_CONFIDENCE = 0.6
DEFAULT_CONTEXT_WEIGHTS = {"section": 0.4, "proximity": 0.3, "semantic": 0.3}

# --- File validation --------------------------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
TEXT_EXTENSIONS = [".txt", ".text", ".log"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png"]
ALLOWED_EXTENSIONS = [".pdf", ".txt", ".text", ".log", ".jpg", ".jpeg", ".png",
                      ".doc", ".docx", ".xls", ".xlsx"]

# --- Result cache lifetimes (seconds) -----------------------------------------
TTL_TASK_RESULT = 3600
TTL_FILE_RESULT = 86400
TTL_PATTERNS = 3600
TTL_REPLIES = 43200
