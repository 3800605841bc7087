"""Cleaning: canonical names and types, the reject split, zero fill and derived columns."""

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid import schema as S
from hourgrid.functions import columns as C


def canonical(raw: DataFrame) -> DataFrame:
    """Raw file names become canonical names; columns already canonical stay."""
    return raw.withColumnsRenamed(S.CANONICAL_NAMES)


def parse_activity(raw: DataFrame) -> DataFrame:
    """Typed activity: what cannot be parsed is NULL, blank grid ids are NULL."""
    df = C.require_columns(canonical(raw), ["timestamp", "grid_id", "country_code", *S.MEASURES])
    return df.withColumns({
        "timestamp": C.parsed_timestamp(df, "timestamp"),
        "grid_id": C.normalised_grid("grid_id"),
        "country_code": F.trim(F.col("country_code").cast("string")),
        **{m: C.parsed_measure(df, m) for m in S.MEASURES},
    })


def reject_reason(mode: str = "strict") -> Column:
    """Why a parsed row is refused; NULL for a good row. `lenient` keeps rows without a grid."""
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown reject mode {mode!r}")
    reason = F.when(F.col("timestamp").isNull(), "MISSING_TIMESTAMP")
    if mode == "strict":
        reason = reason.when(F.col("grid_id").isNull(), "MISSING_GRID")
    return reason.when(C.any_negative(S.MEASURES), "NEGATIVE_MEASURE")


def split_rejects(parsed: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with `reject_reason`)."""
    marked = parsed.withColumn("reject_reason", reject_reason(mode))
    accepted = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, marked.filter(F.col("reject_reason").isNotNull())


def balance_counts(mode: str = "strict") -> list[Column]:
    """Aggregates over parsed rows: all of them, those kept, those refused and why."""
    bad = reject_reason(mode).isNotNull()
    return [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(~bad).alias("clean_rows"),
        F.count_if(bad).alias("rejected_rows"),
        F.count_if(F.col("timestamp").isNull()).alias("null_timestamps"),
        F.count_if(F.col("grid_id").isNull()).alias("null_grids"),
        F.count_if(C.any_negative(S.MEASURES)).alias("negative_rows"),
    ]


def reject_counts(parsed: DataFrame, *more: Column, mode: str = "strict") -> DataFrame:
    """Row balance of the split in one pass: raw = clean + rejected; `more` are further aggregates of that pass."""
    counted = parsed.agg(*balance_counts(mode), *more)
    balanced = F.col("raw_rows") == F.col("clean_rows") + F.col("rejected_rows")
    return counted.withColumn("balanced", balanced)


def refuse_negatives(parsed: DataFrame) -> DataFrame:
    """Strict policy: an error naming the number of rows with a negative measure."""
    bad = parsed.agg(F.count_if(C.any_negative(S.MEASURES)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} rows hold a negative activity value")
    return parsed


def drop_keyless(parsed: DataFrame) -> DataFrame:
    return parsed.dropna(subset=S.KEYS)


def zero_fill(parsed: DataFrame) -> DataFrame:
    return parsed.fillna(0.0, subset=S.MEASURES)


def derive(filled: DataFrame) -> DataFrame:
    """Adds the three totals and the calendar parts."""
    return filled.withColumns({**C.total_columns(), **C.time_parts(F.col("timestamp"))})


def clean_activity(raw: DataFrame, mode: str = "strict") -> DataFrame:
    """Raw rows to clean activity; one narrow stage, no shuffle."""
    return clean_parsed(parse_activity(raw), mode)


def clean_parsed(parsed: DataFrame, mode: str = "strict") -> DataFrame:
    accepted, _ = split_rejects(parsed, mode)
    return derive(zero_fill(accepted)).select(
        *S.KEYS, "country_code", *S.MEASURES, *S.TOTALS,
        "date", "hour", "day_of_week", "weekday", "hour_timestamp",
    )


def out_of_range_grids(parsed: DataFrame, n_cells: int = S.N_CELLS) -> DataFrame:
    """Rows whose grid id is not a whole number in 1..n_cells."""
    return parsed.filter(~C.in_grid_range(F.col("grid_id"), n_cells))


def protect_features(features: DataFrame, names=None) -> DataFrame:
    """NaN and infinities become 0.0; hours stay in 0..24 and shares in 0..1."""
    names = names or [c for c in S.WINDOW_FEATURES + S.TEMPORAL_FEATURES if c in features.columns]
    safe = features.withColumns({n: C.finite_or_zero(F.col(n).cast("double")) for n in names})
    bounded = {}
    if "active_hours" in names:
        bounded["active_hours"] = C.clip(F.col("active_hours"), 0.0, 24.0).cast("int")
    if "internet_share" in names:
        bounded["internet_share"] = C.clip(F.col("internet_share"), 0.0, 1.0)
    return safe.withColumns(bounded)
