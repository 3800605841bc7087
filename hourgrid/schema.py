"""Column contracts, fixed values and struct types of the activity model."""

from pyspark.sql import types as T

# --- Fixed values: file contract -------------------------------------------
RAW_COLUMNS = [
    "datetime", "CellID", "countrycode",
    "smsin", "smsout", "callin", "callout", "internet",
]
RAW_MEASURES = ["smsin", "smsout", "callin", "callout", "internet"]
FILE_PATTERN = "sms-call-internet-mi-*.csv"
CANONICAL_NAMES = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet_activity",
}
KEYS = ["grid_id", "timestamp"]
MEASURES = ["sms_in", "sms_out", "call_in", "call_out", "internet_activity"]
TOTALS = ["total_sms", "total_calls", "total_activity"]
HOURLY_COLUMNS = KEYS + MEASURES + TOTALS + ["date"]
N_CELLS = 10_000

# --- Fixed values: rules ----------------------------------------------------
HIGH_MULTIPLIER = 1.5
SPIKE_MULTIPLIER = 1.5
DROP_MULTIPLIER = 0.7
FLOOR_PERCENTILE = 0.10
ANOMALY_THRESHOLD = 0.5
RISK_HIGH = 0.80
RISK_ATTENTION = 0.50
RECENT_ROWS = 24
BASELINE_ROWS = 24
TRAIN_SHARE = 0.80
MIN_PRECISION = 0.60
MIN_ACCURACY = 0.90
ALERT_TYPES = ["HIGH_ACTIVITY", "ACTIVITY_SPIKE", "ACTIVITY_DROP"]
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
ALERT_SEVERITY = {
    "HIGH_ACTIVITY": "HIGH",
    "ACTIVITY_SPIKE": "MEDIUM",
    "ACTIVITY_DROP": "LOW",
}
DIRECTIONS = ["HIGH", "LOW", "NORMAL"]
AGREEMENT = ["MODEL_AND_NP3", "MODEL_ONLY", "NP3_ONLY", "NEITHER"]
COMPARISON = [
    "ALL_THREE", "ML4_NP3", "ML4_ML3", "NP3_ML3",
    "ML4_ONLY", "NP3_ONLY", "ML3_ONLY", "NONE",
]
DISAGREEMENT_ORDER = [
    "ML4_ONLY", "ML4_NP3", "ML4_ML3", "NP3_ONLY", "ML3_ONLY", "NP3_ML3",
]
PIPELINE_TASKS = [
    "ingest", "validate", "spark_process",
    "load_warehouse", "quality_check", "notify",
]

# --- Fixed values: features -------------------------------------------------
WINDOW_FEATURES = [
    "avg_activity", "activity_growth", "active_hours",
    "peak_ratio", "variability", "internet_share",
]
TEMPORAL_FEATURES = [
    "current_activity", "previous_hour_activity",
    "rolling_3h_activity", "rolling_6h_activity", "rolling_24h_activity",
    "activity_change", "activity_change_pct",
]
MODEL_FEATURES = [
    "avg_activity", "activity_growth", "peak_ratio", "variability",
    "internet_share", "current_activity", "previous_hour_activity",
    "rolling_3h_activity", "rolling_6h_activity",
    "activity_change", "activity_change_pct",
]

# --- Struct types -----------------------------------------------------------
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
ACTIVITY_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("grid_id", T.StringType()),
        T.StructField("country_code", T.StringType()),
    ]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)
GEOJSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([
            T.StructField("cellId", T.StringType()),
            T.StructField("grid_id", T.StringType()),
            T.StructField("gridId", T.StringType()),
            T.StructField("id", T.StringType()),
        ])),
        # Kept as JSON text: Polygon and MultiPolygon nest to different depths.
        T.StructField("geometry", T.StringType()),
    ]))),
])
STATUS_SCHEMA = T.StructType([
    T.StructField("pipeline", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("healthy", T.BooleanType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("as_of", T.StringType()),
    T.StructField("quality_check", T.StringType()),
    T.StructField("failed_task", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("rows_rejected", T.LongType()),
    T.StructField("nulls_handled", T.LongType()),
    T.StructField("rows_published", T.LongType()),
    T.StructField("checks", T.MapType(T.StringType(), T.BooleanType())),
    T.StructField("reasons", T.ArrayType(T.StringType())),
])
AUDIT_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
])
RISK_SCHEMA = T.StructType([
    T.StructField("grid_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("model_version", T.StringType()),
])
