"""Reading activity files, tables, polygons and status records."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hourgrid import schema as S
from hourgrid.functions.columns import require_columns


def _empty_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of length zero, which Spark's readers leave out of their listing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{folder}/{pattern}")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.globStatus(place) or [] if s.isFile() and s.getLen() == 0]
    rows = [(p.getName(), p.toString(), 0) for p in found]
    return spark.createDataFrame(rows, "filename string, path string, length long")


def discover_files(spark: SparkSession, folder: str, pattern: str = S.FILE_PATTERN) -> DataFrame:
    """Name, path and length of the files that match; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = found.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length"
    )
    return named.unionByName(_empty_files(spark, folder, pattern)).orderBy("filename")


def read_activity(spark: SparkSession, path, pattern: str | None = S.FILE_PATTERN) -> DataFrame:
    """Daily CSV files with every field as text and the name of its file.

    Text first, types later: an inferred type would turn one odd value into a failed job. All files must have the
    columns in the standard order, else the read fails; `read_by_header` takes any order.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).schema(S.RAW_TEXT_SCHEMA)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.csv(path)
    if not rows.inputFiles():
        raise FileNotFoundError(f"no activity file in {path}")
    return rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_by_header(spark: SparkSession, headers: DataFrame, required=S.RAW_COLUMNS) -> DataFrame:
    """The required columns of CSV files, taken by the names in each file's own header, and the name of the file.

    `headers` has path and header (see `gates.file_headers`). Files with equal headers are one read; there are as many reads as
    different headers. A file whose header lacks a required column is not read. Of equal names the first column counts.
    """
    wanted = F.array(*[F.lit(c) for c in required])
    admitted = headers.filter(F.size(F.array_except(wanted, F.col("header"))) == 0)
    # Names of files: as many as days arrive at once.
    groups = admitted.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")
    reads = []
    for group in sorted(groups, key=lambda g: g["paths"]):
        # Columns are named by place, since the names of a file may clash.
        places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(group["header"]))])
        rows = spark.read.option("header", True).schema(places).csv(group["paths"])
        reads.append(rows.select(*[F.col(f"c{group['header'].index(c)}").alias(c) for c in required], name))
    if not reads:
        empty = T.StructType([*[T.StructField(c, T.StringType()) for c in required], T.StructField("source_file", T.StringType())])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, reads)


def activity_source(spark: SparkSession, path=None, frame: DataFrame | None = None) -> DataFrame:
    """Exactly one of a path and an existing frame."""
    if (path is None) == (frame is None):
        raise ValueError("give either a path or a frame")
    if frame is not None:
        return frame
    return read_activity(spark, path, None)


def read_lines(spark: SparkSession, path, pattern: str = S.FILE_PATTERN) -> DataFrame:
    """Lines with file name and path, block offset and an id that rises by one inside a block.

    Blank lines are left out before ids are given, as a CSV reader would skip them.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    placed = lines.select(
        F.col("_metadata.file_name").alias("filename"),
        # The path comes encoded as in a URL, where a plus sign stands for itself.
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value",
    ).filter(F.col("value") != "")
    return placed.withColumn("line_id", F.monotonically_increasing_id())


def read_table(spark: SparkSession, *paths: str) -> DataFrame:
    """One Parquet table from one or more paths, for instance several processed days."""
    return spark.read.parquet(*paths)


def read_geojson(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Grid lookup (grid_id, geometry text) of a feature collection; of a repeated id the geometry first in text order.

    The id is `properties.cellId`, never the feature's own id. A collection is one JSON
    document, so it is read by one task; its size is that of the map, not of the data.
    """
    document = spark.read.option("multiLine", True).schema(S.GEOJSON_SCHEMA).json(path)
    kind = document.select("type", F.size("features").alias("n")).first()
    if kind is None or kind["type"] != "FeatureCollection" or (kind["n"] or 0) < 1:
        raise ValueError(f"{path} holds no feature collection")
    props = F.col("feature.properties")
    lookup = document.select(F.explode("features").alias("feature")).select(
        F.coalesce(props["cellId"], props["grid_id"], props["gridId"], props["id"])
        .alias("grid_id"),
        F.col("feature.geometry").alias("geometry"),
    ).filter("grid_id IS NOT NULL AND geometry IS NOT NULL").groupBy("grid_id").agg(
        F.min("geometry").alias("geometry")
    )
    if expected is not None:
        cells = lookup.count()
        if cells != expected:
            raise ValueError(f"{path} holds {cells} cells, expected {expected}")
    return lookup


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.STATUS_SCHEMA).option("multiLine", True).json(path)


def table_columns(spark: SparkSession, name: str, required=()) -> list[str]:
    """Columns of a catalog table; an error when it or a required column is absent."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"required table does not exist: {name}")
    table = spark.table(name)
    require_columns(table, required)
    return table.columns


def partition_values(table: DataFrame, name: str = "date") -> DataFrame:
    """Partition values found in the file paths of a partitioned table, with file counts."""
    value = F.regexp_extract(F.col("_metadata.file_path"), rf"/{name}=([^/]+)/", 1)
    return table.select(value.alias(name), F.col("_metadata.file_path").alias("_f")).groupBy(
        name, "_f"
    ).count().groupBy(name).agg(F.count("_f").alias("files"), F.sum("count").alias("rows"))
