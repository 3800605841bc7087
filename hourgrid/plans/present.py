"""Final form of a registered result: plain values that two engines print alike."""

from pyspark.sql import DataFrame, functions as F, types as T

DIGITS = 6
# Keeps exact halves of the last digit from falling to different sides in two engines.
NUDGE = 1e-9


def present(df: DataFrame) -> DataFrame:
    """Dates and times as text, doubles rounded; other columns as they are."""
    shown = {}
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            shown[field.name] = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            shown[field.name] = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DoubleType):
            shown[field.name] = F.round(value + NUDGE, DIGITS)
    return df.withColumns(shown) if shown else df
