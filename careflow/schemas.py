"""Fixed vocabularies and texts of the patient-flow domain.

Values in this module must equal the behaviour being reproduced; they are
stated plainly and kept together here.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Severity vocabulary, in the display order of the severity chart.
SEVERITY_ORDER = ["emergency", "high", "medium", "low"]
# Severities that raise an alert (compared case-sensitively).
ALERT_SEVERITIES = ["emergency", "high"]

# Speech / translation languages (ten codes).
SPEECH_LANGUAGES = {
    "hi-IN": "Hindi", "ta-IN": "Tamil", "te-IN": "Telugu",
    "kn-IN": "Kannada", "ml-IN": "Malayalam", "bn-IN": "Bengali",
    "mr-IN": "Marathi", "gu-IN": "Gujarati", "pa-IN": "Punjabi",
    "en-IN": "English",
}
# Labels the dashboard knows (nine codes, no pa-IN); unknown codes show as is.
DASHBOARD_LANGUAGE_LABELS = {
    "hi-IN": "Hindi", "ta-IN": "Tamil", "te-IN": "Telugu", "kn-IN": "Kannada",
    "ml-IN": "Malayalam", "bn-IN": "Bengali", "mr-IN": "Marathi",
    "gu-IN": "Gujarati", "en-IN": "English",
}
# Source languages that are already English: no translation needed.
ENGLISH_CODES = ["en-IN", "en"]

# Defaults used when a patient record has no row of a kind.
NO_LAB_STATUS = "not_ordered"
NO_RX_STATUS = "not_prescribed"
UNKNOWN_HOSPITAL = "Unknown Hospital"
EMPTY_LIST, EMPTY_MAP = "[]", "{}"
DEFAULT_FOLLOWUP = "Follow up with your doctor"
NO_SYMPTOMS = "None reported"
NO_ITEMS = "None"

# Department actions that close orders.
LAB_DEPT, LAB_DONE_ACTION = "lab", "submitted_results"
RX_DEPT, RX_DONE_ACTION = "pharmacy", "dispensed"

# Patient table as bound here (ids are numbers in the bindings).
PATIENT_TABLE = ("patient_id bigint, name string, age int, gender string, language string, token_number bigint, "
                 "room_number bigint, checked_in int, hospital_id int, created_at timestamp_ntz")
# Table-level column defaults (DDL DEFAULT clauses).
PATIENT_DEFAULTS = {"room_number": 1, "checked_in": 0}
LAB_ORDER_DEFAULTS = {"status": "pending", "results": "{}"}
LAB_ORDER_TABLE = ("order_id bigint, patient_id bigint, consultation_id bigint, tests string, status string, "
                   "results string, created_at timestamp_ntz, updated_at timestamp_ntz")
RX_TABLE = ("rx_id bigint, patient_id bigint, consultation_id bigint, medicines string, status string, "
            "created_at timestamp_ntz, updated_at timestamp_ntz")
ALERT_TABLE = ("alert_id bigint, consultation_id bigint, patient_id bigint, severity string, diagnosis string, "
               "sms_sent int, created_at timestamp_ntz")
APPLICATION_TABLE = "app_id bigint, data string, status string, comments string, created_at timestamp_ntz"
RX_DEFAULTS = {"status": "pending"}
ALERT_DEFAULTS = {"sms_sent": 0}
APPLICATION_DEFAULTS = {"status": "pending"}

# Discharge message (English template); {name} and {followup} are filled in.
DISCHARGE_TEMPLATE = (
    "%s, your consultation is complete. Your medicines have been dispensed. "
    "Important: %s. Please take care and get well soon."
)
# Alert text (name, id, severity, diagnosis, room).
ALERT_TEMPLATE = ("%s\nPatient: %s (%s)\nSeverity: %s\nDiagnosis: %s\nRoom: %s\n"
                  "Immediate attention required.")
# Welcome line at check-in (name, token, room).
WELCOME_TEMPLATE = "Welcome %s. You are Token %s. Please go to Room %s."
# Colour band of the record sheet by severity.
SEVERITY_BANDS = {"emergency": "red", "high": "orange"}
OTHER_BAND = "green"

# Fields of a clinical record an extraction answer must carry, with kinds.
RECORD_FIELDS = [
    ("patient_id", "string"),
    ("symptoms", "list"),
    ("diagnosis", "string"),
    ("prescriptions", "list"),
    ("lab_tests", "list"),
    ("severity", "string"),
    ("followup", "string"),
    ("clinical_notes", "string"),
]

# Triage baseline, checked in this order; the first match wins and anything
# unmatched is "low". A rule holds if all phrases of one of its lists occur,
# each as whole words.
TRIAGE_RULES = [
    ("emergency", 1, [["chest pain", "arm pain"], ["chest pain", "jaw pain"], ["breathing difficulty"], ["stroke"],
                      ["unconscious"]]),
    ("high", 2, [["high fever"], ["severe pain"], ["abnormal vitals"]]),
    ("medium", 3, [["moderate"], ["monitoring"]]),
]
TRIAGE_DEFAULT = "low"

# --- end of fixed values ----------------------------------------------------
