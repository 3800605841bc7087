"""Tables whose new state appears all at once, as plain Parquet files and a log.

A change writes its rows into folders of its own; nothing is overwritten. Its commit adds one record to the log, by renaming a
finished file, and only then do readers see the rows: those of all its tables together, and the names of the input files it
took in. A change that breaks leaves folders that no record names; it is simply made again. A table consists of parts:
`date` is the rows of a date, `date@change` are rows that a change added to that date. One job at a time changes a store.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hourgrid.sources.sinks import write_by_date

LOG = "number long, kind string, name string, part string, folder string, detail string"
# Kinds of log entries: a part's folder, a part that is gone, a table's schema, an input file taken in, a token of a change.
PART, GONE, SCHEMA, FILE, TOKEN = "part", "gone", "schema", "file", "token"
WHOLE = ""  # the only part of a table that is replaced as a whole
VERSION = "_version"


class Store:
    """The committed state of the tables below `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._known, self._folded = None, ({}, {})
        self._log = self._hadoop.Path(f"{self.root}/log")
        self.files_of = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def list_names(self, folder: str) -> list[str]:
        path = self._hadoop.Path(folder)
        if not self.files_of.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.files_of.listStatus(path))

    def _records(self) -> list[str]:
        """Log files from the last one that holds the whole state on."""
        names = [n for n in self.list_names(f"{self.root}/log") if n.endswith(".json") and n[0] not in "_."]
        whole = [i for i, n in enumerate(names) if ".whole." in n]
        return names[whole[-1]:] if whole else names

    def last(self) -> int:
        """Number of the newest record; 0 for an empty store."""
        names = self._records()
        return int(names[-1].split(".")[0]) if names else 0

    def entries(self) -> DataFrame:
        """The log from its last whole state on."""
        paths = [f"{self.root}/log/{n}" for n in self._records()]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(paths)

    def _state(self) -> tuple[dict, dict]:
        """Live parts and schemas by table; read again only when the log has grown. As many entries as tables have dates."""
        names = self._records()
        if names != self._known:
            rows = self.entries().filter(F.col("kind").isin(PART, GONE, SCHEMA)).collect()
            parts: dict[str, dict[str, str]] = {}
            schemas = {}
            for r in sorted(rows, key=lambda r: r["number"]):
                if r["kind"] == SCHEMA:
                    schemas[r["name"]] = T.StructType.fromJson(json.loads(r["detail"]))
                elif r["kind"] == PART:
                    parts.setdefault(r["name"], {})[r["part"]] = r["folder"]
                else:
                    parts.get(r["name"], {}).pop(r["part"], None)
            self._known, self._folded = names, (parts, schemas)
        return self._folded

    def parts(self, name: str) -> dict[str, str]:
        """Live parts of a table with their folders: some for each date."""
        return dict(self._state()[0].get(name, {}))

    def schema(self, name: str) -> T.StructType | None:
        return self._state()[1].get(name)

    def files(self) -> DataFrame:
        """Names of the input files that committed changes took in."""
        return self.entries().filter(F.col("kind") == FILE).select(F.col("name").alias("filename")).distinct()

    def holds_token(self, token: str) -> bool:
        """Whether a change with this token, such as the number of a batch, is committed."""
        return not self.entries().filter((F.col("kind") == TOKEN) & (F.col("name") == token)).isEmpty()

    def read(self, name: str, schema: T.StructType | None = None, dates=None) -> DataFrame:
        """A table, or its rows of some dates; `schema` is for tables that may not exist yet."""
        known = self.schema(name) or schema
        if known is None:
            raise LookupError(f"no table {name} in {self.root}")
        parts = self.parts(name)
        if dates is not None:
            wanted = {str(d) for d in dates}
            parts = {p: f for p, f in parts.items() if p.split("@")[0] in wanted}
        return self.load(name, known, list(parts.values()))

    def load(self, name: str, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/data/{name}"
        found = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in sorted(folders)])
        return found.select(*schema.fieldNames())

    def newest(self, name: str, keys, schema: T.StructType | None = None, dates=None) -> DataFrame:
        """The row of the latest change for each key, of a table that changes only add to."""
        rows = self.read(name, schema, dates)
        return newest_rows(rows, keys).drop(VERSION)

    def begin(self) -> "Change":
        return Change(self)

    def compact(self, name: str, keys, least: int = 2) -> int:
        """Fold the dates of an added-to table that have at least `least` parts; returns how many dates.

        Rows of other dates are not read. Readers see the same rows before and after.
        """
        by_date: dict[str, list[str]] = {}
        for part in self.parts(name):
            by_date.setdefault(part.split("@")[0], []).append(part)
        dates = [d for d, parts in by_date.items() if len(parts) >= least]
        if dates:
            change = self.begin()
            change.replace(name, newest_rows(self.read(name, dates=dates), keys))
            change.commit()
        return len(dates)

    def shorten_log(self) -> None:
        """Write the whole state as one record, so that readers need no older ones."""
        rows = self.entries()
        live = rows.filter(F.col("kind").isin(PART, GONE)).groupBy("name", "part").agg(
            F.max_by(F.struct("number", "kind", "folder", "detail"), "number").alias("e")
        ).filter(F.col("e.kind") == PART).select("e.number", "e.kind", "name", "part", "e.folder", "e.detail")
        schemas = rows.filter(F.col("kind") == SCHEMA).groupBy("name").agg(
            F.max_by(F.struct("number", "kind", "part", "folder", "detail"), "number").alias("e")
        ).select("e.number", "e.kind", "name", "e.part", "e.folder", "e.detail")
        taken = rows.filter(F.col("kind") == FILE).select(*live.columns)
        # Of tokens that differ behind a `#` only, such as the batches of a stream, the last is enough.
        tokens = rows.filter(F.col("kind") == TOKEN).groupBy(F.substring_index("name", "#", 1)).agg(
            F.max_by(F.struct(*live.columns), "number").alias("e")).select("e.*")
        lines = live.unionByName(schemas).unionByName(taken).unionByName(tokens).select(F.to_json(F.struct("*")).alias("line")).collect()
        self.add_record([r["line"] for r in lines], self.last(), whole=True)

    def unused_folders(self, name: str) -> list[str]:
        """Folders of changes of a table that no live part lies in: left by broken changes, or replaced since."""
        used = {f.split("/")[0] for f in self.parts(name).values()}
        return [n for n in self.list_names(f"{self.root}/data/{name}") if n not in used]

    def add_record(self, lines: list[str], base: int, whole=False) -> int:
        """One more log file; refused when another change was committed since record `base`."""
        if self.last() != base:
            raise RuntimeError(f"{self.root} was changed by another job")
        number = base + 1
        final = self._hadoop.Path(f"{self.root}/log/{number:012d}{'.whole' if whole else ''}.json")
        draft = self._hadoop.Path(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = self.files_of.create(draft, False)
        try:
            out.write(bytearray("\n".join(lines).encode()))
        finally:
            out.close()
        if self.files_of.exists(final) or not self.files_of.rename(draft, final):
            raise RuntimeError(f"{self.root} was changed by another job")
        return number


def newest_rows(rows: DataFrame, keys) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(VERSION)).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*rows.columns)


class Change:
    """Rows to become visible together."""

    def __init__(self, store: Store):
        self.store, self.id, self.base = store, uuid.uuid4().hex, store.last()
        self._entries: list[dict] = []
        self._written: dict[str, tuple[T.StructType, dict[str, str]]] = {}

    def _note(self, kind, name, part=None, folder=None, detail=None) -> None:
        self._entries.append({"number": self.base + 1, "kind": kind, "name": name, "part": part, "folder": folder, "detail": detail})

    def _write(self, name: str, df: DataFrame, sort) -> dict[str, str]:
        """Writes by date; returns the dates with their folders below the table's."""
        run = f"run={self.id}-{len(self._entries)}"
        path = f"{self.store.root}/data/{name}/{run}"
        write_by_date(df, path, sort=sort)
        dates = [n.removeprefix("date=") for n in self.store.list_names(path) if n.startswith("date=")]
        found = {d: f"{run}/date={d}" for d in dates}
        self._note(SCHEMA, name, detail=df.schema.json())
        known = self._written.get(name, (df.schema, {}))[1]
        self._written[name] = df.schema, {**known, **found}
        return found

    def replace(self, name: str, df: DataFrame, sort=("grid_id",)) -> list[str]:
        """`df` (with `date`) takes the place of all rows of the dates it holds; returns these dates."""
        live = self.store.parts(name)
        found = self._write(name, df, sort)
        for date, folder in found.items():
            self._note(PART, name, date, folder)
            for part in live:
                if part.startswith(f"{date}@"):
                    self._note(GONE, name, part)
        return list(found)

    def add(self, name: str, df: DataFrame, sort=("grid_id",)) -> list[str]:
        """The rows of `df` (with `date`) beside what its dates hold already, marked with the change's number."""
        marked = df.withColumn(VERSION, F.lit(self.base + 1).cast("long"))
        found = self._write(name, marked, sort)
        for date, folder in found.items():
            self._note(PART, name, f"{date}@{self.id}", folder)
        return list(found)

    def replace_whole(self, name: str, df: DataFrame) -> None:
        """`df` takes the place of the table."""
        run = f"run={self.id}-{len(self._entries)}"
        df.write.parquet(f"{self.store.root}/data/{name}/{run}")
        self._note(SCHEMA, name, detail=df.schema.json())
        self._note(PART, name, WHOLE, run)
        self._written[name] = df.schema, {WHOLE: run}

    def written(self, name: str) -> DataFrame:
        """What this change has written of a table."""
        schema, folders = self._written[name]
        return self.store.load(name, schema, list(folders.values()))

    def read(self, name: str) -> DataFrame:
        """A table as it will be after the commit."""
        parts = self.store.parts(name)
        for e in self._entries:
            if e["name"] == name and e["kind"] == PART:
                parts[e["part"]] = e["folder"]
            elif e["name"] == name and e["kind"] == GONE:
                parts.pop(e["part"], None)
        schema = self._written[name][0] if name in self._written else self.store.schema(name)
        if schema is None:
            raise LookupError(f"no table {name} in {self.store.root}")
        return self.store.load(name, schema, list(parts.values()))

    def commit(self, files=(), token: str | None = None) -> int:
        """Make everything visible, with the names of the input files it came from."""
        for name in files:
            self._note(FILE, name)
        if token is not None:
            self._note(TOKEN, token)
        return self.store.add_record([json.dumps(e) for e in self._entries], self.base)
