"""Admission of daily files: header gate, row gate, routing.

A file of any size is judged without bringing its rows together. Rows are read as
lines with the offset of their block; each block reports its row count and its first
bad row, and only those reports, one per block, are ordered within a file.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourgrid import schema as S

# Fixed value: what counts as a number, in the sense of Python's float().
NUMBER = r"(?i)^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|nan|inf(inity)?)$"
WHOLE = r"^[+-]?\d+$"
DATE = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"
# A comma followed by an even number of quotes is a separator.
SEPARATOR = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def split_fields(line: Column) -> Column:
    """Fields of one CSV line; quotes around a field are taken off, doubled ones halved."""
    def unquote(field):
        inner = F.regexp_extract(field, r'^"(.*)"$', 1)
        return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))
                      ).otherwise(field)

    return F.transform(F.split(line, SEPARATOR, -1), unquote)


def file_headers(lines: DataFrame) -> DataFrame:
    """Header fields and the id of the header line, per file that has a line; its path, where `lines` has one."""
    path = [F.min("path").alias("path")] if "path" in lines.columns else []
    first = lines.filter(F.col("block") == 0).groupBy("filename").agg(
        F.min_by("value", "line_id").alias("_line"), F.min("line_id").alias("first_line"), *path
    )
    clean = F.transform(
        split_fields(F.regexp_replace("_line", "^﻿", "")), lambda c: F.trim(c)
    )
    return first.select("filename", clean.alias("header"), "first_line", *(["path"] if path else []))


def header_gate(files: DataFrame, headers: DataFrame, required=S.RAW_COLUMNS) -> DataFrame:
    """Adds `schema_reason`: SCHEMA_VALID, EMPTY_FILE or MISSING_COLUMNS:a,b."""
    wanted = F.array(*[F.lit(c) for c in required])
    missing = F.array_except(wanted, F.col("header"))
    reason = (
        F.when(F.col("header").isNull(), "EMPTY_FILE")
        .when(F.size(missing) > 0, F.concat(F.lit("MISSING_COLUMNS:"), F.array_join(missing, ",")))
        .otherwise("SCHEMA_VALID")
    )
    return files.join(headers, "filename", "left").withColumn("schema_reason", reason)


def fields_by_name(lines: DataFrame, headers: DataFrame, names=S.RAW_COLUMNS) -> DataFrame:
    """Data rows with the named fields as text, by the header of their own file."""
    # Headers are one row per file; the optimizer broadcasts them when they are few and
    # otherwise splits a file that is much larger than the rest.
    joined = lines.join(headers.drop("path"), "filename").withColumn("_f", split_fields(F.col("value")))
    is_header = (F.col("block") == 0) & (F.col("line_id") == F.col("first_line"))
    place = {n: F.array_position("header", n) for n in names}
    return joined.filter(~is_header).select(
        "filename", "block", "line_id",
        *[F.coalesce(F.try_element_at("_f", F.when(place[n] > 0, place[n]).cast("int")),
                     F.lit("")).alias(n) for n in names],
    )


def row_failure(measures=S.RAW_MEASURES, n_cells=S.N_CELLS) -> Column:
    """Code of the first rule a row of text fields breaks; NULL for a good row."""
    stamp, cell = F.trim("datetime"), F.trim("CellID")
    readable = stamp.rlike(DATE) & F.try_to_timestamp(stamp).isNotNull()
    number = cell.try_cast("bigint")
    rules = [
        (stamp == "", "MISSING_TIMESTAMP"),
        (~readable, "MALFORMED_TIMESTAMP"),
        (~cell.rlike(WHOLE), "INVALID_CELLID"),
        (~F.coalesce(number.between(1, n_cells), F.lit(False)), "CELLID_OUT_OF_RANGE"),
    ]
    for m in measures:
        text = F.trim(F.col(m))
        rules.append(((text != "") & ~text.rlike(NUMBER), f"NON_NUMERIC_{m}"))
        rules.append((F.coalesce(text.try_cast("double") < 0, F.lit(False)), f"NEGATIVE_{m}"))
    return reduce(lambda acc, rule: acc.when(*rule), rules, F)


def row_gate(rows: DataFrame) -> DataFrame:
    """Per file: rows read and the first failure as CODE_AT_ROW_n, counted from 2.

    `line_id` must rise by one from row to row inside a block.
    """
    coded = rows.withColumn("_code", row_failure())
    bad = F.col("_code").isNotNull()
    blocks = coded.groupBy("filename", "block").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("line_id").alias("_first"),
        F.min(F.when(bad, F.struct("line_id", "_code"))).alias("_bad"),
    )
    before = W.partitionBy("filename").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    seen = F.col("_before") + F.col("_bad.line_id") - F.col("_first") + 1
    hit = F.when(F.col("_bad").isNotNull(), F.struct(
        seen.alias("seen"), F.col("_bad._code").alias("code")))
    files = placed.select("filename", "_rows", hit.alias("_hit")).groupBy("filename").agg(
        F.sum("_rows").alias("_rows"), F.min("_hit").alias("_hit")
    )
    reason = F.concat("_hit.code", F.lit("_AT_ROW_"), (F.col("_hit.seen") + 1).cast("string"))
    return files.select(
        "filename",
        F.coalesce("_hit.seen", "_rows").cast("bigint").alias("row_count"),
        F.coalesce(reason, F.lit("QUALITY_VALID")).alias("quality_reason"),
    )


def route_files(schema_checked: DataFrame, rows_checked: DataFrame, manifest: DataFrame) -> DataFrame:
    """ACCEPTED, REJECTED or DUPLICATE per file, with the row count and the reason.

    `manifest` lists the names already accepted. A file with a good header and no rows
    is refused with NO_DATA_ROWS.
    """
    known = manifest.select("filename", F.lit(True).alias("_known")).distinct()
    good_header = F.col("schema_reason") == "SCHEMA_VALID"
    reason = F.when(~good_header, F.col("schema_reason")).otherwise(
        F.coalesce("quality_reason", F.lit("NO_DATA_ROWS"))
    )
    judged = (
        schema_checked.select("filename", "schema_reason")
        .join(rows_checked, "filename", "left").join(known, "filename", "left")
        .withColumn("_reason", reason)
    )
    valid = F.col("_reason") == "QUALITY_VALID"
    repeated = valid & F.col("_known").isNotNull()
    return judged.select(
        "filename",
        F.when(repeated, "DUPLICATE").when(valid, "ACCEPTED").otherwise("REJECTED").alias("status"),
        F.when(good_header, F.coalesce("row_count", F.lit(0))).otherwise(F.lit(0))
        .cast("bigint").alias("row_count"),
        F.when(repeated, "FILE_ALREADY_EXISTS_IN_RAW").otherwise(F.col("_reason")).alias("reason"),
    )


def new_files(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates whose name is not in the manifest yet."""
    return candidates.join(manifest.select("filename").distinct(), "filename", "left_anti")


def raw_zone_check(files: DataFrame) -> DataFrame:
    """Files present, empty ones among them, and whether the zone may be processed."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") == 0).alias("empty_files")
    ).withColumn("passed", (F.col("files") > 0) & (F.col("empty_files") == 0))
