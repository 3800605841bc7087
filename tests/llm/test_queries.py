"""The registered corpus queries on the smallest tables, against SQL or brute force."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from check import TABLES, differences
from hourgrid.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert differences(got, con.execute(queries.ORACLE_SQL[name]).df()) == ""


def test_language_model(spark, folder, documents):
    got = queries.QUERIES["op3_language_model"](spark, folder).toPandas().set_index("doc_id")
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in zip(documents.doc_id, documents.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tokens)
    for i, ws in tokens.items():
        row = got.loc[i]
        assert row.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_language_id(spark, folder, documents):
    got = queries.QUERIES["op4_language_id"](spark, folder).toPandas().merge(documents, on="doc_id")
    assert len(got) == len(documents) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang_pred == held.lang).mean() > 0.9


def test_quality(spark, folder, documents):
    got = queries.QUERIES["op5_quality"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(got) == len(documents) and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    high, low = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([h > x for h in high for x in low]) > 0.9
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_token_counts(spark, folder, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.QUERIES["op6_token_counts"](spark, folder).toPandas().set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text):
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert tuple(got.loc[i, ["n_bytes", "n_tokens", "over_limit"]]) == (len((t or "").encode()), n, n > 2048)


def test_tree_search(spark, folder):
    x = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    got = queries.QUERIES["op8_tree_search"](spark, folder).toPandas()
    v, ids = np.stack(x.embedding).astype(float), x.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = (v * v[ids == q]).sum(axis=1)
        scores[ids == q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1))
        assert mine.score.to_numpy() == pytest.approx([scores[ids == i][0] for i in mine.vec_id])
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(mine.vec_id))
        total += 20
    assert hits >= 0.9 * total


def test_pipeline(spark, folder, documents):
    """Every stage against a brute-force version of its decision."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [w for (t,) in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()
             for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))] if w]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "source_mix":
            assert after.columns == docs.columns
        after = after.toPandas()
        before = docs.toPandas()
        rows[name] = after
        if name == "language_id":
            gone = before[~before.doc_id.isin(after.doc_id)]
            assert len(gone) < 0.02 * len(before)
        if name == "near_duplicates":
            assert set(after.doc_id) == least_of_groups(dict(zip(before.doc_id, before.text)))
        if name == "benchmark_decontamination":
            for old, new in before.merge(after, on="doc_id", how="left", suffixes=("", "_new")).apply(
                    lambda r: (r.text, r.text_new), axis=1):
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", old.translate(LOWER))
                hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows for p in range(i, i + n)}
                if not isinstance(new, str):
                    assert len(hit) > 0.5 * len(w)
                elif not hit:
                    assert new == old
                else:
                    assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", new)) == len(w) - len(hit)
        if name == "secret_scan":
            assert not after.text.str.contains(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", regex=True).any()
            same = before.merge(after, on="doc_id")
            changed = same[same.text_x != same.text_y]
            assert changed.text_y.str.contains(r"\[(?:ASSIGN|ACCESS|HEX|IDENTIFIER|BARE|ENDPOINT)\]").all()
        if name == "source_mix":
            assert set(after.doc_id) <= set(before.doc_id) and after.shuffle_key.is_monotonic_increasing
            assert 0.8 * before.n_chars.sum() < after.n_chars.sum() < 1.2 * before.n_chars.sum()
        docs = spark.createDataFrame(after, docs.schema) if name != "source_mix" else docs
    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "copy", "text"]
    assert sorted(map(tuple, whole[key].values)) == sorted(map(tuple, rows["source_mix"][key].values))


def least_of_groups(texts: dict) -> set:
    """The ids that are the smallest of their group of linked texts."""
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    low = {i: i for i in sets}
    by = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            least = min(low[a], low[b])
            if (low[a], low[b]) != (least, least):
                low[a] = low[b] = least
                moved = True
    return {i for i in low if low[i] == i}
