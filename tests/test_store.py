"""The snapshot store, reading by header, and the day-by-day job: late rows, breaks and reruns."""

import random

import pytest
from pyspark.sql import functions as F

from hourgrid import schema as S
from hourgrid.operators import aggregate, clean, gates, incremental, series
from hourgrid.plans import day_by_day
from hourgrid.sources import files
from hourgrid.sources.snapshots import Store
from test_files import HEADER, name, write


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These tests run very many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(df, columns=None):
    df = df.select(*columns) if columns else df
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def dated(spark, rows):
    return spark.createDataFrame(rows, "grid_id string, day string, x int").select("grid_id", "x", F.to_date("day").alias("date"))


def test_store_shows_commits_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.last() == 0 and store.files().count() == 0
    with pytest.raises(LookupError):
        store.read("t")
    change = store.begin()
    assert sorted(change.replace("t", dated(spark, [("a", "2024-01-01", 1), ("b", "2024-01-02", 2)]))) == ["2024-01-01", "2024-01-02"]
    change.replace_whole("w", spark.range(3))
    assert change.written("t").count() == 2
    with pytest.raises(LookupError):
        Store(spark, str(tmp_path / "s")).read("t")
    change.commit(files=["f1"], token="batch 0")
    assert store.read("t").count() == 2 and store.read("w").count() == 3 and store.read("t", dates=["2024-01-02"]).first()["x"] == 2
    assert [r[0] for r in store.files().collect()] == ["f1"] and store.holds_token("batch 0") and not store.holds_token("batch 1")
    broken = store.begin()
    broken.replace("t", dated(spark, [("c", "2024-01-01", 3)]))
    assert store.read("t").count() == 2 and broken.read("t").count() == 2 and len(store.unused_folders("t")) == 1
    after = store.begin()
    after.replace("t", dated(spark, [("d", "2024-01-02", 4)]))
    after.replace_whole("w", spark.range(5))
    after.commit(files=["f2"])
    with pytest.raises(RuntimeError, match="another job"):
        broken.commit()
    assert rows_of(store.read("t"), ["grid_id", "x"]) == [("a", 1), ("d", 4)] and store.read("w").count() == 5
    before = store.parts("t")
    store.shorten_log()
    again = Store(spark, str(tmp_path / "s"))
    assert again.parts("t") == before and again.read("w").count() == 5 and again.entries().count() < 12
    assert sorted(r[0] for r in again.files().collect()) == ["f1", "f2"] and again.holds_token("batch 0")
    empty = again.begin()
    assert empty.replace("t", dated(spark, [])) == []
    empty.commit()
    assert rows_of(again.read("t"), ["grid_id", "x"]) == [("a", 1), ("d", 4)]


def test_added_rows_newest_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sizes = []
    for version, rows in enumerate([[("a", "2024-01-01", 1), ("b", "2024-01-01", 1), ("a", "2024-01-02", 1)], [("a", "2024-01-01", 2)],
                                    [("c", "2024-01-01", 3), ("a", "2024-01-01", 3)]]):
        change = store.begin()
        change.add("t", dated(spark, rows))
        sizes.append(change.written("t").count())
        change.commit()
    assert sizes == [3, 1, 2]  # each change writes its own rows only
    keys = ["grid_id", "date"]
    want = [("a", 1), ("a", 3), ("b", 1), ("c", 3)]
    assert rows_of(store.newest("t", keys), ["grid_id", "x"]) == want
    assert store.compact("t", keys) == 1 and len(store.parts("t")) == 2
    assert rows_of(store.newest("t", keys), ["grid_id", "x"]) == want and store.compact("t", keys) == 0
    change = store.begin()
    change.add("t", dated(spark, [("c", "2024-01-01", 9)]))
    change.commit()
    assert rows_of(store.newest("t", keys), ["grid_id", "x"]) == [("a", 1), ("a", 3), ("b", 1), ("c", 9)]


def test_columns_are_taken_by_header(spark, tmp_path):
    """Permuted, quoted, extra and repeated columns give the rows of the standard order; files without a column are left out."""
    line = {"datetime": "2013-11-01 03:00:00", "CellID": "7", "countrycode": "39", "smsin": "1.5", "smsout": "", "callin": "2", "callout": "0.5", "internet": "900"}
    orders = [S.RAW_COLUMNS, S.RAW_COLUMNS[::-1], ["extra", *S.RAW_COLUMNS[3:], "more", *S.RAW_COLUMNS[:3], "CellID"]]
    folder = tmp_path / "with space+plus"
    folder.mkdir()
    for day, columns in enumerate(orders, 1):
        values = [line.get(c, "x") if i == columns.index(c) else "99" for i, c in enumerate(columns)]
        write(folder, day, [",".join(values)], header=",".join(columns if day != 2 else [f'" {c} "' for c in columns]))
    write(folder, 4, ["1,2"], header="datetime,CellID")
    headers = gates.file_headers(files.read_lines(spark, str(folder)))
    got = files.read_by_header(spark, headers)
    assert got.columns == [*S.RAW_COLUMNS, "source_file"]
    parsed = clean.parse_activity(got).orderBy("source_file").collect()
    assert [r["source_file"][-6:-4] for r in parsed] == ["01", "02", "03"]
    assert len({tuple(r)[:-1] for r in parsed}) == 1 and parsed[0]["internet_activity"] == 900.0 and parsed[0]["grid_id"] == "7"
    assert files.read_by_header(spark, headers.filter("filename = 'none'")).count() == 0
    with pytest.raises(Exception, match="(?i)header"):
        files.read_activity(spark, f"{folder}/{name(2)}").collect()


def activity(spark, rows):
    """(day, hour, grid, value) to clean activity."""
    made = spark.createDataFrame(rows, "day int, hour int, grid_id string, v double").select(
        F.make_timestamp(F.lit(2024), F.lit(1), "day", "hour", F.lit(0), F.lit(0.0)).alias("timestamp"), "grid_id", F.lit("39").alias("country_code"),
        F.col("v").alias("sms_in"), F.lit(None).cast("double").alias("sms_out"), (F.col("v") * 2).alias("call_in"), F.lit(1.0).alias("call_out"),
        (F.col("hour") * 1.0).alias("internet_activity"))
    return clean.clean_parsed(made)


def days(rng):
    """Rows of four days: grids with gaps, one that begins late, rows that come days after their hour, and repeated hours."""
    out = [[] for _ in range(4)]
    for d in range(4):
        for h in range(24):
            for g in ("1", "2", "3", "9"):
                if (g == "2" and rng.random() < 0.6) or (g == "9" and d < 1):
                    continue
                arrives = min(3, d + (rng.choice([1, 3]) if g == "3" and rng.random() < 0.08 else 0))
                out[arrives].append((d + 1, h, g, float(rng.randrange(1, 90))))
                if rng.random() < 0.1:
                    out[arrives].append((d + 1, h, g, 0.5))
    return out


def test_day_by_day_equals_one_batch(spark, tmp_path):
    parts = days(random.Random(51))
    store = Store(spark, str(tmp_path / "s"))
    for rows in parts:
        change = store.begin()
        day_by_day.advance(change, activity(spark, rows))
        day_by_day.advance_warehouse(change)
        change.commit()
    whole = activity(spark, [r for rows in parts for r in rows])
    hourly = aggregate.hourly_grid(whole).select(*S.HOURLY_COLUMNS).cache()
    assert rows_of(store.read(day_by_day.HOURLY).select(*S.HOURLY_COLUMNS)) == rows_of(hourly)
    features = series.feature_table(hourly)
    stored = store.read(day_by_day.FEATURES)
    assert features.count() > 100 and rows_of(stored.select(*features.columns)) == rows_of(features)
    assert rows_of(store.read(day_by_day.DAYS)) == rows_of(aggregate.dashboard_totals(hourly))
    assert rows_of(store.read(day_by_day.TAIL)) == rows_of(incremental.last_rows(hourly.select(*incremental.SERIES)))
    facts = store.read(day_by_day.FACT)
    named = facts.join(store.read(day_by_day.TIMES), "time_key").join(store.read(day_by_day.GRIDS).select("grid_key", F.col("grid_id").alias("g")), "grid_key")
    assert facts.count() == hourly.count() == named.filter("g = grid_id AND hour = hour(event_time) AND event_date = to_date(event_time)").count()
    assert store.read(day_by_day.ACTIVITY).count() == whole.count()



def test_rows_read_do_not_grow_with_history(spark, tmp_path):
    """What a day in order reads from the store is the tail, whatever lies before."""
    store = Store(spark, str(tmp_path / "s"))
    loaded = []
    load = store.load
    store.load = lambda table, schema, folders: loaded.append((table, folders)) or load(table, schema, folders)
    for day in range(1, 4):
        loaded.clear()
        change = store.begin()
        day_by_day.advance(change, activity(spark, [(day, h, g, 2.0) for h in range(24) for g in "12"]))
        read = {table: sum(f"={change.id}" not in f for f in folders) for table, folders in loaded}
        before = [f for table, folders in loaded for f in folders if f"run={change.id}" not in f and table not in (day_by_day.TAIL, day_by_day.DAYS, day_by_day.SKETCHES)]
        assert before == [] and read[day_by_day.TAIL] <= 1
        change.commit()
        assert store.read(day_by_day.TAIL).count() == min(47, 24 * day) * 2
    loaded.clear()
    change = store.begin()  # one late row: its grid's hours are read
    day_by_day.advance(change, activity(spark, [(2, 5, "1", 7.0)]))
    assert {f.split("date=")[1] for table, folders in loaded for f in folders if table == day_by_day.HOURLY and "date=" in f} == {
        f"2024-01-0{d}" for d in range(1, 4)}


STAGES = ["advance", "commit"]


def test_broken_runs_are_taken_up(spark, tmp_path, monkeypatch):
    """A break in or after any stage, then a rerun, gives the tables of an unbroken run."""
    def day(d):
        late = [f"2013-11-{d - 1:02d} 23:00:00,1,39,4,,,,1"] if d > 1 else []
        return [f"2013-11-{d:02d} {h:02d}:00:00,{c},39,{h % 7}.5,{c},1,{h * c % 11},2" for h in range(24) for c in (1, 2)] + late

    def start(folder):
        folder.mkdir()
        write(folder, 1, day(1))
        return folder

    def go(landing, out, now):
        return day_by_day.run(spark, str(landing), f"{out}/clean", str(out), now=f"2013-11-0{now} 00:00:00").first()

    landing, out = start(tmp_path / "in"), tmp_path / "out"
    assert go(landing, out, 2)["healthy"]
    # The second day's file has its columns in another order, and a row of the first day.
    write(landing, 2, [",".join(line.split(",")[::-1]) for line in day(2)], header=",".join(HEADER.split(",")[::-1]))
    store = Store(spark, str(out))
    first = rows_of(store.read(day_by_day.HOURLY))
    for stage in STAGES:
        with monkeypatch.context() as patch:
            def broken(*args, **kwargs):
                raise OSError(f"lost in {stage}")

            where = day_by_day.Change if stage == "commit" else day_by_day
            patch.setattr(where, stage, broken)
            with pytest.raises(OSError, match=stage):
                go(landing, out, 3)
        assert rows_of(store.read(day_by_day.HOURLY)) == first and store.last() == 1
        assert files.read_status(spark, f"{out}/pipeline_status").first()["status"] == "FAILED"
    calls = []
    with monkeypatch.context() as patch:
        settle = day_by_day.settle

        def broken(*args, **kwargs):
            calls.append(1)
            if len(calls) == 2:  # the one behind the commit
                raise OSError("lost behind the commit")
            settle(*args, **kwargs)

        patch.setattr(day_by_day, "settle", broken)
        with pytest.raises(OSError):
            go(landing, out, 3)
    audit = spark.read.schema(S.AUDIT_SCHEMA).parquet(f"{out}/ingest_audit")
    assert store.last() == 2 and audit.filter("status = 'ACCEPTED'").count() == 1
    go(landing, out, 4)  # nothing new: the claim is settled, nothing is taken twice
    audit = spark.read.schema(S.AUDIT_SCHEMA).parquet(f"{out}/ingest_audit")
    assert {(r["filename"], r["row_count"]) for r in audit.filter("status = 'ACCEPTED'").collect()} == {(name(1), 48), (name(2), 49)}
    assert store.last() == 2

    other = tmp_path / "unbroken"
    landing = start(tmp_path / "in2")
    write(landing, 2, day(2))
    assert go(landing, other, 3)["rows_in"] == 97
    twin = Store(spark, str(other))
    for table in (day_by_day.HOURLY, day_by_day.FEATURES, day_by_day.DAYS, day_by_day.ANOMALIES, day_by_day.ALERTS, day_by_day.FACT):
        assert rows_of(store.read(table)) == rows_of(twin.read(table)), table
    late = store.read(day_by_day.HOURLY).filter("grid_id = '1' AND timestamp = '2013-11-01 23:00:00'").first()
    assert late["sms_in"] == 23 % 7 + 0.5 + 4 and store.read(day_by_day.HOURLY, dates=["2013-11-01"]).count() == 48
