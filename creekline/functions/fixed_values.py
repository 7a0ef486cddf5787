"""These must equal the published configuration for results to agree."""

# Forecast timing, in days.
LEAD_DAYS = 7
RESULT_DELAY_DAYS = 3
MAX_AGE_DAYS = 120

# Minimum rows per split and minimum test sites for a fold to be evaluated.
MIN_TRAIN = 150
MIN_VALIDATION = 30
MIN_TEST = 30
MIN_TEST_SITES = 5

# Minimum class sizes for a tail classifier, recall its cutoff must reach, and
# the cutoff that never flags.
MIN_CLASS_TRAIN = 20
MIN_CLASS_VALIDATION = 5
CUTOFF_RECALL = 0.75
NEVER_FLAG = 1.1

# Minimum support for a prospective verdict.
MIN_VERDICT_OBSERVATIONS = 100
MIN_VERDICT_SITES = 10

# Groups smaller than this are marked as small samples.
SMALL_SAMPLE = 20

# Targets judged first in a prospective run.
PRIMARY_TARGETS = ["water_temperature", "dissolved_oxygen"]

# Sites recorded under several names.
CONFLICT_SITES = [
    "5303387", "5303391", "5303392", "5303393", "5303394",
    "5303395", "5303396", "5303397", "5303398",
]

# Rain stations averaged into one regional series, and the stream gauge.
RAIN_STATIONS = ["USW00024233", "USW00024222", "USW00094290", "USW00024234"]
STREAM_GAUGE = "12121600"

# Text read as missing in a survey export.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Patterns of a valid row.
SITE_PATTERN = r"\A[0-9]{7,12}\z"
CREATED_PREFIX = r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} "
SAMPLE_TIME_PATTERN = (
    r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{1,6}\z"
)
# The short form cannot overflow a double; the full one can.
SHORT_NUMBER_PATTERN = r"\A[+-]?([0-9]{1,100}(\.[0-9]{0,100})?|\.[0-9]{1,100})([eE][+-]?[0-9]{1,2})?\z"
NUMBER_PATTERN = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

# Survey columns.
SITE_COLUMN = "gww_site_code_double"
CREATED_COLUMN = "CreationDate"
SAMPLE_TIME_COLUMN = "sample_date_time"
LOCATION_COLUMN = "Site_Location"
METHOD_COLUMN = "turbidity_tube_or_meter"

# Measurements: name, source, column, label, transform, direction, min, max, caution.
TARGETS = [
    ("ecoli", "bacteria", "Average_e_coli", "E. coli", "log1p", "high", 0, None, ""),
    ("other_coliform", "bacteria", "Average_coliform", "Other coliform", "log1p", "high", 0, None, ""),
    ("water_temperature", "chemistry", "water_temperature", "Water temperature", "identity", "high", -5, 45, ""),
    ("dissolved_oxygen", "chemistry", "Average_dissolved_oxygen_dis", "Dissolved oxygen", "identity", "low", 0, 50, ""),
    ("oxygen_saturation", "chemistry", "Per_Oxy_Sat_Auto_W_Hight", "Oxygen saturation", "identity", "low", 0, 300, ""),
    ("ph", "chemistry", "ph_standard_units", "pH", "identity", "both", 0, 14, ""),
    ("conductivity", "chemistry", "conductivity", "Conductivity", "log1p", "both", 0, None, ""),
    ("nitrate", "chemistry", "Nitrate", "Nitrate", "log1p", "high", 0, None, ""),
    ("phosphate", "chemistry", "Phosphate", "Phosphate", "log1p", "high", 0, None, ""),
    ("turbidity_reported", "chemistry", "Turbidity", "Turbidity (reported field)", "log1p", "high", 0, None,
     "Mixed or missing tube/meter method; possible detection-limit values. Do not combine with legacy turbidity."),
    ("turbidity_legacy", "chemistry", "turbidity_x_5_bc_50ml", "Turbidity (legacy field)", "log1p", "high", 0, None,
     "Legacy measurement field; protocol and detection limits need confirmation."),
    ("suspended_solids", "chemistry", "TSS", "Suspended solids", "log1p", "high", 0, None, ""),
    ("alkalinity", "chemistry", "total_alkalinity", "Alkalinity", "log1p", "both", 0, None, ""),
    ("hardness", "chemistry", "total_hardness", "Hardness", "log1p", "both", 0, None, ""),
    ("salinity", "chemistry", "Salinity", "Salinity", "log1p", "both", 0, None,
     "Units and unusually large values need verification."),
]

# Reference limits: target, min, max, basis.
LIMITS = [
    ("water_temperature", None, 16.0,
     "Core summer salmonid habitat. The criterion is a 7-day average of daily maximums; a single reading only approximates it."),
    ("dissolved_oxygen", 8.0, None,
     "Salmonid spawning, rearing and migration, lowest 1-day minimum. Provisional: the stricter core summer habitat limit is 9.5; confirm which applies with the data owner."),
    ("ph", 6.5, 8.5, "Salmonid habitat range."),
    ("ecoli", None, 320,
     "Primary contact recreation: no more than 10% of samples above 320 per 100 mL (the geometric mean limit is 100)."),
]

# First-generation chemistry and temperature columns with accepted ranges.
V1_CHEMISTRY = {
    "water_temperature": (0, 40),
    "ph_standard_units": (0, 14),
    "Average_dissolved_oxygen_dis": (0, 30),
    "conductivity": (0, 10000),
    "Nitrate": (0, 100),
    "Phosphate": (0, 100),
}
V1_TEMPERATURES = {"air_temperature": (-20, 50), "water_temperature": (0, 40)}

# Replicate counts behind each bacteria average.
COUNT_COLUMNS = {
    "ecoli": ["sample_1_e_coli_count", "sample_2_e_coli_count", "sample_3_e_coli_count"],
    "other_coliform": [
        "sample_1_other_coliform_if_test", "sample_2_other_coliform_if_test", "sample_3_other_coliform_if_test",
    ],
}
VOLUME_COLUMN = "sample_volume"

# Chemistry averages: target, parts averaged, factor.
DERIVED_FORMULAS = {
    "dissolved_oxygen": (["rep_1_dissolved_oxygen_do", "rep_2_dissolved_oxygen_do"], 1),
    "alkalinity": (["total_alkalinity_of_drops"], 5),
    "hardness": (["total_hardness_of_drops"], 10),
}

# Reviewed copies of a measurement column.
REVIEW_COLUMNS = {
    "water_temperature": "Review_Water_temperature",
    "ph": "Review_PH",
    "conductivity": "Review_conductivity",
    "nitrate": "Review_Nitrate",
    "phosphate": "Review_Phosphate",
    "turbidity_reported": "Review_Turbidity",
    "suspended_solids": "Review_TSS",
}

# Units shown where the accepted range makes them unambiguous.
UNITS = {
    "water_temperature": "°C", "dissolved_oxygen": "mg/L", "oxygen_saturation": "%", "ph": "",
    "ecoli": "per 100 mL", "other_coliform": "per 100 mL",
}

# Reader's text for each forecast status, and notes per target.
STATUS_TEXT = {
    "eligible": "Forecast available",
    "fewer_than_two_available_target_samples": "Fewer than two earlier samples were available at issue time",
    "target_history_older_than_120_days": "Latest usable sample is more than 120 days before the visit",
    "insufficient_training_history": "Not enough history to train a forecast for this measurement",
    "date_overlaps_training_information": "Visit date overlaps the data the model was trained on",
}
NOTES = {
    "water_temperature": "Strongest evidence; gains survive data-quality exclusions.",
    "dissolved_oxygen": "Strong evidence; low-oxygen events are harder.",
    "ecoli": "Gain depends on which sites are included; site names need confirmation. No risk flags.",
    "turbidity_reported": "Tube readings cluster at 8; reporting convention unconfirmed.",
    "salinity": "Units and large values need verification.",
}
OVERVIEW_NOTE = "Correlated target flags; no combined safety score."
ALIAS_NOTE = (
    "Same normalized waterbody and location text; candidate only. Location text omitted for privacy."
)
NO_METHOD = "(no method recorded)"
METER_METHOD = "Turbidity meter"

# Forecasts that need no fitted model, in order of preference on ties.
BASELINES = ["global_median", "last_observation", "site_median", "site_seasonal"]

# Rolling rain and flow features.
RAIN_WINDOWS = [1, 3, 7, 14, 30]
WEATHER_FEATURES = [
    "rain_1", "rain_3", "rain_7", "rain_14", "rain_30",
    "days_since_rain5", "flow_log", "flow_7_log", "flow_ratio_30",
]

# Cell of the rolling table for a fold without enough history.
NOT_ENOUGH = "not enough history"
