"""Column expressions shared by the operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hourgrid import schema as S


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required) -> DataFrame:
    """Fail while the plan is built when a column is absent; runs no job."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, candidates, default=None) -> Column:
    """First candidate present, ignoring case; else `default` as a literal, else an error."""
    present = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in present:
            return F.col(f"`{present[name.lower()]}`")
    if default is not None:
        return F.lit(default)
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def parsed_timestamp(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that is not one becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(F.trim(F.col(name)))
    return F.col(name).cast("timestamp")


def parsed_measure(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is not a number becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.trim(F.col(name)).try_cast("double")
    return F.col(name).cast("double")


def normalised_grid(name: str) -> Column:
    text = F.trim(F.col(name).cast("string"))
    return F.when(~text.isin("", "null", "NULL"), text)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite_or_zero(value: Column) -> Column:
    return F.when(finite(value), value).otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient, or 0.0 when it or its denominator is zero or not finite."""
    usable = F.when(finite(denominator), denominator)
    return finite_or_zero(F.try_divide(numerator, usable))


def rounded(value: Column, scale) -> Column:
    return value if scale is None else F.round(value, scale)


def total_columns(scale=None) -> dict[str, Column]:
    sms = F.col("sms_in") + F.col("sms_out")
    calls = F.col("call_in") + F.col("call_out")
    return {
        "total_sms": rounded(sms, scale),
        "total_calls": rounded(calls, scale),
        "total_activity": rounded(sms + calls + F.col("internet_activity"), scale),
    }


def time_parts(ts: Column) -> dict[str, Column]:
    """Calendar parts; `day_of_week` counts from Sunday=1, `weekday` from Monday=0."""
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "day_of_week": F.dayofweek(ts),
        "weekday": F.weekday(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "hour_timestamp": F.date_trunc("hour", ts),
    }


def any_negative(names) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(n) < 0, F.lit(False)) for n in names])


def in_grid_range(grid: Column, n_cells: int = S.N_CELLS) -> Column:
    return F.coalesce(grid.try_cast("bigint").between(1, n_cells), F.lit(False))


def fact_total() -> Column:
    return (
        F.coalesce(F.col("sms_count"), F.lit(0.0))
        + F.coalesce(F.col("call_count"), F.lit(0.0))
        + F.coalesce(F.col("internet_volume"), F.lit(0.0))
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= S.RISK_HIGH, "HIGH")
        .when(score >= S.RISK_ATTENTION, "ATTENTION")
        .when(score.isNotNull(), "LOW")
    )


def alert_severity(alert_type: Column) -> Column:
    pairs = S.ALERT_SEVERITY.items()
    known = reduce(lambda acc, kv: acc.when(alert_type == kv[0], kv[1]), pairs, F)
    return known.otherwise("LOW")


def rank_in(value: Column, ordered) -> Column:
    """Position of `value` in a short fixed list, from 1; past the end when absent."""
    chain = reduce(lambda acc, iv: acc.when(value == iv[1], iv[0]), enumerate(ordered, 1), F)
    return chain.otherwise(len(ordered) + 1)


def severity_rank(severity: Column) -> Column:
    return rank_in(severity, S.SEVERITIES)


def first_match(pairs, default: str) -> Column:
    """`CASE` over (condition, label) pairs, the first true one wins."""
    return reduce(lambda acc, cl: acc.when(cl[0], cl[1]), pairs, F).otherwise(default)


def age_label(as_of: Column, now: Column, labels=("FRESH", "STALE", "VERY_STALE")) -> Column:
    """Age bands of 24 h and 72 h, both inclusive; UNKNOWN without a timestamp."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(as_of)) / 3600.0
    return (
        F.when(hours <= 24, labels[0])
        .when(hours <= 72, labels[1])
        .when(hours.isNotNull(), labels[2])
        .otherwise("UNKNOWN")
    )


def health_label(as_of: Column, now: Column) -> Column:
    """Strict form of the same bands: below 24 h healthy, below 72 h warning."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(as_of)) / 3600.0
    return F.when(hours < 24, "healthy").when(hours < 72, "warning").otherwise("failure")
