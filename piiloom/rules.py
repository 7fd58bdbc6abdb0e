"""Detection rules and scoring tables, kept as plain data.

Every table here is a default; each public function takes a caller's own
version.  Patterns are Java regular expressions evaluated in Unicode mode
(see :func:`piiloom.functions.spans.unicode_pattern`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

GOVT_ID = "IndianGovtID"


@dataclass(frozen=True)
class Rule:
    """One pattern.

    ``needs`` is a cheap necessary condition (a literal or a small regex): a
    text without it is never searched with ``pattern``.  ``context`` words
    raise the score when they occur among the tokens before a match.
    """

    name: str
    entity_type: str
    pattern: str
    score: float
    subtype: str | None = None
    context: tuple[str, ...] = ()
    needs: str | None = None

    def __post_init__(self):
        if not 0.0 <= self.score <= 1.0:
            raise ValueError(f"rule {self.name}: score must lie in [0, 1]")
        try:
            matches_nothing = re.compile(self.pattern).match("") is not None
        except re.error:
            matches_nothing = False  # Java-only syntax; Spark will check it
        if matches_nothing:
            raise ValueError(f"rule {self.name}: pattern may not match the empty string")


# --- Fixed values: context words that precede each kind of number -----------
AADHAAR_CONTEXT = (
    "aadhaar", "aadhar", "uid", "uidai", "unique identification",
    "government of india", "भारत सरकार",
)
PAN_CONTEXT = ("permanent account number", "pan")
LICENSE_CONTEXT = (
    "dl", "driving licence", "driving license", "license no", "licence no",
    "dl no", "driver", "transport",
)
PHONE_CONTEXT = ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call")

_DIGITS = "[0-9]{4}"

# --- Fixed values: recogniser patterns and scores ---------------------------
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("aadhaar_spaced", "AADHAAR", r"\b[2-9][0-9]{3}\s[0-9]{4}\s[0-9]{4}\b",
         0.85, GOVT_ID, AADHAAR_CONTEXT, _DIGITS),
    Rule("aadhaar_hyphen", "AADHAAR", r"\b[2-9][0-9]{3}-[0-9]{4}-[0-9]{4}\b",
         0.85, GOVT_ID, AADHAAR_CONTEXT, _DIGITS),
    Rule("aadhaar_plain", "AADHAAR", r"\b[2-9][0-9]{11}\b",
         0.60, GOVT_ID, AADHAAR_CONTEXT, _DIGITS),
    Rule("pan_holder_letter", "PAN", r"\b[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\b",
         0.85, GOVT_ID, PAN_CONTEXT, _DIGITS),
    Rule("pan_shape", "PAN", r"\b[A-Z]{3}[DEIKMNOQRSUVWXYZ][A-Z][0-9]{4}[A-Z]\b",
         0.60, GOVT_ID, PAN_CONTEXT, _DIGITS),
    Rule("dl_spaced_initials", "DRIVING_LICENSE",
         r"\b[A-Z]{2}[0-9]{2}\s[A-Z]{1,2}\s[0-9]{4}\s[0-9]{7}\b",
         0.80, GOVT_ID, LICENSE_CONTEXT, _DIGITS),
    Rule("dl_spaced", "DRIVING_LICENSE", r"\b[A-Z]{2}[0-9]{2}\s[0-9]{4}\s[0-9]{7}\b",
         0.75, GOVT_ID, LICENSE_CONTEXT, _DIGITS),
    Rule("dl_hyphen4_initials", "DRIVING_LICENSE",
         r"\b[A-Z]{2}-[0-9]{2}-[A-Z]{1,2}-[0-9]{4}-[0-9]{7}\b",
         0.80, GOVT_ID, LICENSE_CONTEXT, _DIGITS),
    Rule("dl_hyphen4", "DRIVING_LICENSE", r"\b[A-Z]{2}-[0-9]{2}-[0-9]{4}-[0-9]{7}\b",
         0.75, GOVT_ID, LICENSE_CONTEXT, _DIGITS),
    Rule("dl_hyphen3", "DRIVING_LICENSE", r"\b[A-Z]{2}-[0-9]{2}[A-Z]{0,2}-[0-9]{11}\b",
         0.70, GOVT_ID, LICENSE_CONTEXT, _DIGITS),
    Rule("dl_plain", "DRIVING_LICENSE",
         r"\b[A-Z]{2}[0-9]{2}[A-Z]{0,2}[0-9]{4}[0-9]{7}\b",
         0.65, GOVT_ID, LICENSE_CONTEXT, _DIGITS),
    # Possessive quantifiers keep the e-mail rule linear on long unbroken runs.
    Rule("email", "EMAIL_ADDRESS",
         r"\b[\w.+-]++@\w++(?:-\w++)*+(?:\.\w++(?:-\w++)*+)++",
         1.0, None, (), "@"),
    Rule("phone_in", "PHONE_NUMBER", r"(?:\+91[\s-]?|\b)[6-9][0-9]{4}[\s-]?[0-9]{5}\b",
         0.40, None, PHONE_CONTEXT, _DIGITS),
    Rule("phone_us", "PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
         0.75, None, PHONE_CONTEXT, _DIGITS),
)

# --- Fixed values: entity names after detection -----------------------------
NORMALISED_TYPES = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE"}

CONFIDENCE_THRESHOLD = 0.7
CONTEXT_WINDOW = 5
CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.40

# --- Fixed values: risk score -----------------------------------------------
WEIGHTS = {
    "AADHAAR": 25.0,
    "PAN": 20.0,
    "DRIVING_LICENSE": 20.0,
    "EMAIL": 5.0,
    "PHONE": 5.0,
    "PERSON": 3.0,
}
UNKNOWN_WEIGHT = 1.0
CRITICAL_TYPES = ("AADHAAR",)
HIGH_TYPES = ("PAN", "DRIVING_LICENSE")
CRITICAL_FLOOR = 30.0
HIGH_FLOOR = 15.0
MAX_SCORE = 100.0
DIVERSITY_STEP = 0.3
CRITICAL_FACTOR = 1.5
COMBINATIONS: tuple[tuple[tuple[str, ...], float], ...] = (
    (("AADHAAR", "PAN"), 12.0),
    (("AADHAAR", "PAN", "DRIVING_LICENSE"), 20.0),
    (("AADHAAR", "PHONE"), 5.0),
    (("PAN", "DRIVING_LICENSE"), 8.0),
)
BANDS = ((5.0, "LOW"), (15.0, "MEDIUM"), (30.0, "HIGH"))
TOP_BAND = "CRITICAL"
SENSITIVITIES = ((9.0, "Very High"), (6.0, "High"), (4.0, "Medium"))
LOWEST_SENSITIVITY = "Low"
POLICY_SCORE = 51.0

# --- Fixed values: lifecycle -------------------------------------------------
STATUSES = ("PENDING", "EXTRACTING", "PII_DETECTING", "PII_DETECTED",
            "REDACTING", "COMPLETED", "FAILED")
PROGRESS_STEPS = {"PENDING": 0, "EXTRACTING": 1, "PII_DETECTING": 2, "PII_DETECTED": 2,
                  "REDACTING": 3, "COMPLETED": 5, "FAILED": -1}
TERMINAL_STATUSES = ("COMPLETED", "FAILED")
REDACTABLE_STATUSES = ("PII_DETECTED", "COMPLETED")
# Statuses that may follow each; "" before the first. A failed document may be sent again.
NEXT_STATUSES = {"": ("PENDING",), "PENDING": ("EXTRACTING", "FAILED"), "EXTRACTING": ("PII_DETECTING", "FAILED"),
                 "PII_DETECTING": ("PII_DETECTED", "FAILED"), "PII_DETECTED": ("REDACTING", "FAILED"),
                 "REDACTING": ("COMPLETED", "FAILED"), "COMPLETED": ("REDACTING",), "FAILED": ("PENDING",)}
REDACTION_LEVELS = ("LIGHT", "FULL", "SYNTHETIC")

# --- Fixed values: file checks ------------------------------------------------
MAGIC_BYTES = {
    "pdf": "25504446",
    "png": "89504E470D0A1A0A",
    "jpg": "FFD8FF",
    "jpeg": "FFD8FF",
    "docx": "504B0304",
}
SIZE_LIMITS = {"pdf": 10485760, "png": 5242880, "jpg": 5242880, "jpeg": 5242880,
               "docx": 10485760}
SCAN_CHARS = 100
CHARS_PER_PAGE = 3000
TEXT_CACHE_SECONDS = 3600
UPLOADS_PER_MINUTE = 10
REQUESTS_PER_MINUTE = {"UPLOAD": 10, "REDACT": 10, "STATUS": 100}

# --- Fixed values: synthetic identifiers ---------------------------------------
STATE_CODES = (
    "AP", "AR", "AS", "BR", "CG", "GA", "GJ", "HR", "HP", "JK",
    "JH", "KA", "KL", "MP", "MH", "MN", "ML", "MZ", "NL", "OD",
    "PB", "RJ", "SK", "TN", "TS", "TR", "UP", "UK", "WB", "AN",
    "CH", "DN", "DD", "DL", "LD", "PY",
)
FIRST_NAMES = ("Asha", "Ravi", "Meera", "Arjun", "Leela", "Kiran", "Nila", "Dev")
LAST_NAMES = ("Rao", "Sen", "Nair", "Das", "Iyer", "Gill", "Bose", "Shah")
PERSON_SCORE = 0.85

# --- Fixed values: governance ----------------------------------------------------
TAG_ROOT = "PII"
TAGS = {
    "AADHAAR": "Sensitive.IndianGovtID.Aadhaar",
    "PAN": "Sensitive.IndianGovtID.PAN",
    "DRIVING_LICENSE": "Sensitive.IndianGovtID.DrivingLicense",
    "EMAIL_ADDRESS": "Sensitive.ContactInfo.Email",
    "EMAIL": "Sensitive.ContactInfo.Email",
    "PHONE_NUMBER": "Sensitive.ContactInfo.Phone",
    "PHONE": "Sensitive.ContactInfo.Phone",
    "PERSON": "Sensitive",
}
TAG_LABELS = {
    "Sensitive": ("Sensitive", "Sensitive PII data requiring special protection"),
    "Sensitive.IndianGovtID": (
        "Indian Government ID",
        "Indian Government identification documents (Aadhaar, PAN, Driving License)"),
    "Sensitive.ContactInfo": ("Contact Information", "Contact information (email, phone)"),
    "Sensitive.IndianGovtID.Aadhaar": ("Aadhaar", "Aadhaar (12-digit biometric ID by UIDAI)"),
    "Sensitive.IndianGovtID.PAN": ("PAN", "PAN (Permanent Account Number for taxation)"),
    "Sensitive.IndianGovtID.DrivingLicense": (
        "Driving License", "DL (State-issued driving license)"),
    "Sensitive.ContactInfo.Email": ("Email", "Email address"),
    "Sensitive.ContactInfo.Phone": ("Phone", "Phone number"),
}
FILE_FORMATS = {
    "zip": "zip", "gz": "gz", "gzip": "gz", "zstd": "zstd", "zst": "zstd",
    "csv": "csv", "tsv": "tsv", "json": "json", "parquet": "parquet", "avro": "avro",
}
SERVICE_NAME = "document-store"
MANAGED_BY = "PII governance"


def tag_map(root: str = TAG_ROOT) -> dict[str, str]:
    """Entity type -> full tag name below ``root``."""
    return {entity: f"{root}.{tag}" for entity, tag in TAGS.items()}


def select_rules(rules=DEFAULT_RULES, entity_types=None, threshold=0.0):
    """Rules worth running: requested types that can reach ``threshold``.

    This is the allow-list applied before any text is read.  Types may be
    given in the raw or the normalised spelling.
    """
    wanted = None if entity_types is None else set(entity_types)
    kept = []
    for rule in rules:
        names = {rule.entity_type, NORMALISED_TYPES.get(rule.entity_type, rule.entity_type)}
        best = rule.score
        if rule.context:
            best = min(1.0, max(rule.score + CONTEXT_BOOST, CONTEXT_FLOOR))
        if (wanted is None or names & wanted) and best >= threshold:
            kept.append(rule)
    return tuple(kept)
