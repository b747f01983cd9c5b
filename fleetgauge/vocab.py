"""Shared vocabulary.

Everything in this module is a *fixed value*: signal names, units, identifier prefixes,
word lists and patterns are part of the data contract and must not be changed.
"""

# --- fixed values: telemetry signals -------------------------------------------------------
TIMESTAMP = "timestamp_s"
SPEED = "ego_speed_mps"
ACCEL = "ego_acceleration_mps2"
GAP = "relative_distance_m"
REL_V = "relative_velocity_mps"
OBJ_CLASS = "object_class"
CONF = "object_confidence"
BRAKE = "brake_command"
AEB_STATE = "aeb_state"
WEATHER = "weather"

SIGNALS = (
    TIMESTAMP, SPEED, ACCEL, GAP, REL_V, OBJ_CLASS, CONF, BRAKE, AEB_STATE, WEATHER,
)
NUMERIC_SIGNALS = (TIMESTAMP, SPEED, ACCEL, GAP, REL_V, CONF, BRAKE, AEB_STATE)
CRITICAL_SIGNALS = (TIMESTAMP, SPEED, GAP, REL_V, CONF, BRAKE)
OPTIONAL_SIGNALS = (ACCEL, OBJ_CLASS, AEB_STATE, WEATHER)

SIGNAL_UNITS = {
    TIMESTAMP: "s", SPEED: "m/s", ACCEL: "m/s^2", GAP: "m", REL_V: "m/s",
    OBJ_CLASS: "category", CONF: "ratio", BRAKE: "bool", AEB_STATE: "enum", WEATHER: "category",
}
# base name of a header (without unit suffix) -> signal
SIGNAL_ALIASES = {
    "timestamp": TIMESTAMP, "time": TIMESTAMP, "ego_speed": SPEED, "ego_acceleration": ACCEL,
    "relative_distance": GAP, "relative_velocity": REL_V, "object_class": OBJ_CLASS,
    "object_confidence": CONF, "brake_command": BRAKE, "aeb_state": AEB_STATE, "weather": WEATHER,
}
SUFFIX_UNITS = {"kmh": "km/h", "mps": "m/s", "mps2": "m/s^2", "m": "m", "s": "s", "ms": "ms"}
SUFFIX_PATTERN = r"^(.+?)_(kmh|mps2|mps|ms|m|s)$"
UNIT_FACTORS = {("km/h", "m/s"): 1.0 / 3.6, ("ms", "s"): 1e-3}
MPS_TO_KMH = 3.6
# strings a CSV reader treats as missing
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: identifiers --------------------------------------------------------------
ID_PREFIXES = (
    "window", "metric", "chunk", "event", "report", "run", "doc", "file", "scenario", "quality",
    "verification",
)
ID_SEPARATOR = "\x1f"
OBSERVATION_ID_PATTERN = r"\b(?:metric|event|window|chunk|quality|file|doc|run)_[0-9a-f]{12}\b"
REPORT_ID_PATTERN = (
    r"\b(?:metric|event|window|chunk|quality|file|doc|run|verification|report|scenario)_"
    r"[0-9a-f]{12}\b"
)

# --- fixed values: events and metrics ---------------------------------------------------------
EV_BRAKE = "aeb_brake_command"
EV_CROSSING = "ttc_threshold_crossing"
EV_COLLISION = "collision"

M_MIN_TTC = "min_ttc_s"
M_CROSSING = "ttc_threshold_crossing_s"
M_BRAKE = "brake_command_time_s"
M_LATENCY = "braking_latency_s"
M_SPEED_AT_BRAKE = "ego_speed_at_brake_command_mps"
M_MIN_GAP = "min_relative_distance_m"
M_COLLISION = "collision"
M_COLLISION_TIME = "collision_time_s"
M_MAX_DECEL = "max_deceleration_mps2"
M_MAX_JERK = "max_abs_jerk_mps3"
M_FIRST_DETECTION = "first_detection_time_s"
M_DROPOUT = "confidence_dropout_during_risk_s"
M_MIN_CONF = "min_confidence_during_risk"
CRITICAL_METRICS = (M_LATENCY, M_CROSSING, M_BRAKE, M_MIN_TTC)
FAILURE_CLASSES = (
    "sensor_limitation", "perception_error", "fusion_error", "planner_logic_error",
    "control_issue", "calibration_config_issue", "data_logging_issue", "unknown",
)

# --- fixed values: documents ------------------------------------------------------------------
SOURCE_ALIASES = {
    "requirement": "requirement", "requirements": "requirement", "srs": "requirement",
    "dbc": "dbc", "signal_definitions": "dbc", "manual": "manual",
    "test_spec": "test_spec", "test": "test_spec", "issue": "issue", "issues": "issue",
    "release_note": "release_note",
}
SOURCE_TRUST = {
    "requirement": 1.00, "test_spec": 0.95, "dbc": 0.90, "manual": 0.85, "release_note": 0.80,
    "issue": 0.75,
}
ACCESS_LEVELS = ("public", "internal", "restricted")  # each level includes those before it
FEATURES = ("AEB", "ACC", "LKA", "TSR", "BSD", "DMS")
FRONT_MATTER_PATTERN = r"(?sd)\A---\s*\n(.*?)\n---\s*\n"
HEADING_PATTERN = r"(?md)^(#{1,6})\s+(.*\S)\s*$"
REQUIREMENT_PATTERN = r"\b(?:REQ|TC|SCN)-[A-Z]+(?:-[A-Z]+)*-\d+\b|\bINC-\d+\b"
KEYWORD_TOKEN_PATTERN = r"[a-z0-9][a-z0-9_.\-]*"
EMBEDDING_TOKEN_PATTERN = r"[a-z0-9][a-z0-9_]*"
BASE_QUERY = "AEB brake command latency TTC threshold requirement valid target confidence"
LOGGING_QUERY = "data logging requirements"
INDEX_FORMAT = "fleetgauge-index/1"

INJECTION_PATTERNS = {
    "ignore_instructions": r"ignore (all |any |the )?(previous|prior|above) instructions",
    "role_override": r"\byou are (now|no longer)\b",
    "system_prompt": r"\bsystem prompt\b",
    "exfiltration": (
        r"\b(api[_ ]?key|password|secret)s?\b.*\b(print|reveal|output|send)\b"
        r"|\b(print|reveal|output|send)\b.*\b(api[_ ]?key|password|secret)s?\b"
    ),
    "tool_call": r"\b(call|invoke|execute) (the )?(tool|function|command)\b",
    "hidden_directive": r"\[\[.*?\]\]|<\s*/?\s*(system|assistant|instruction)\s*>",
}
CONTROL_CHARS_PATTERN = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
REAL_WORLD_PATTERN = (
    r"\b(real[- ]world|on[- ]road|in the field|production vehicle|customer vehicle|road safety)\b"
)

# --- fixed values: confidence -------------------------------------------------------------------
CONFIDENCE_ORDER = ("blocked", "low", "medium", "high")
SINGLE_SOURCE_CAP = 0.6
STALE_PENALTY = 0.10
INJECTION_PENALTY = 0.20
PASSING_ONLY_PENALTY = 0.15
COMPETING_THRESHOLD = 0.6
GROUND_TRUTH_TOLERANCE_S = 0.05
SYNTHETIC_LIMITATION = (
    "Evidence is synthetic/simulation-only. No claim here describes real-world vehicle behaviour."
)
NO_DIAGNOSIS_LIMITATION = (
    "No AI diagnosis was run; hypotheses and next tests are not available."
)
