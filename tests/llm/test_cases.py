"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import bisect
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourgrid.llm import (decontaminate, graph, hmm, langid, mixing, ngram_join, quality, secrets, tokens, tree_search, urls)
from test_queries import LOWER, SPACED, least_of_groups

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def odd(frame):
    """Documents with every odd case, and columns whose names clash with results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, match string, spans string, n_tokens int, score double"
    texts = [(1, None), (None, "no id here"), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "é ß 漢字 😀 end"), (6, "word " * 30_000)]
    return frame([(i, t, None, None, None, "m", "s", 7, None) for i, t in texts], schema)


def test_decontaminate_brute_force(frame, odd):
    rng = random.Random(1)
    items = [(1, "alpha beta"), (2, prose(rng, 10)), (3, prose(rng, 25)), (4, None), (5, ""), (6, "omega"), (None, prose(rng, 12)), (2, prose(rng, 14))]
    docs = [(i, prose(rng, 40) + " " + (items[rng.randrange(3)][1] or "") + " " + prose(rng, 10).upper()) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "omega"), (102, "omega"), (103, items[2][1][20:])]
    found = decontaminate.match_items(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    got = found.collect()
    assert len(got) == len(docs)
    split = [(i, (t or "").split()) for i, t in items]
    windows = [(i, tuple(w[k:k + 10])) for i, w in split if w for k in range(max(len(w) - 9, 1))]
    for row in got:
        w = (row.text or "").lower().split()
        hit, names = set(), set()
        for name, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    names |= {str(name)} if name is not None else set()
        assert (row.match.n_words, row.match.n_hit, row.match["items"]) == (len(w), len(hit), sorted(names))
    none = frame([], "item_id long, text string")
    clean = decontaminate.decontaminate(odd, none)
    assert clean.columns == odd.columns and clean.count() == odd.count()


def test_decontaminate_shards(frame, monkeypatch):
    rng = random.Random(2)
    items = frame([(i, prose(rng, 20)) for i in range(30)], "item_id long, text string")
    docs = frame([(i, prose(rng, 5) + " " + t.text) for i, t in enumerate(items.collect())], "doc_id long, text string")
    one = [r.match for r in decontaminate.match_items(docs, items).orderBy("doc_id").collect()]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    many = [r.match for r in decontaminate.match_items(docs, items).orderBy("doc_id").collect()]
    assert [(m.n_hit, m["items"], m.spans) for m in one] == [(m.n_hit, m["items"], m.spans) for m in many]


def test_ngram_join_brute_force(frame, odd, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts, i = {}, 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 90]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[i] = " ".join(copy)
            i += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(40):
        texts[i] = passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([10, 30, 60])))
        i += 1
    texts |= {i: None, i + 1: "", i + 2: "same", i + 3: "SAME"}
    docs = frame(list(texts.items()), "doc_id long, text string")
    want = least_of_groups(texts)
    monkeypatch.setattr(ngram_join, "TILE", 8)  # so that anchors need several tiles
    got = {r.doc_id: r for r in ngram_join.linked_components(docs).collect()}
    assert {i for i, r in got.items() if r.component_id == i} == want and len(got) == len(texts)
    for k, t in texts.items():
        w = SPACED.findall((t or "").translate(LOWER))
        assert got[k].n_shingles == len({tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set())
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_bitmap_bound_never_too_low():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 300, 2)
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        bits = 8 * min(len(x), len(y))
        bound = ngram_join.overlap_bound(ngram_join.fold_bitmap(x, bits), len(a), ngram_join.fold_bitmap(y, bits), len(b))
        assert bound >= len(np.intersect1d(a, b))


def test_components(frame):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 3), (3, 7), (9, 9), (None, 4)]
    edges += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    low = {n: n for e in edges for n in e if n is not None}
    for _ in range(len(low)):
        for a, b in edges:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in graph.components(frame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in low.items() if n != c}


def test_hmm_likelihood():
    rng = np.random.default_rng(6)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T, np.ones(3) / 3)
    seq = [rng.integers(0, 5, n) for n in (1, 2, 4, 5)]
    for s, got in zip(seq, model.log10(seq), strict=True):
        paths = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            paths += p
        assert got == pytest.approx(np.log10(paths))
    long = rng.integers(0, 5, 1700)
    assert model._long(long) == pytest.approx(model.log10([long])[0])
    # Expected counts add up, and a step of training raises the likelihood.
    first, moved, emitted = model.counts([*seq, long])
    assert emitted.sum() == pytest.approx(sum(map(len, seq)) + len(long)) and first.sum() == pytest.approx(5)
    unigram = np.ones(5) / 5
    after = hmm.maximise(first, moved, emitted, unigram)
    assert after.log10([long])[0] > model.log10([long])[0]


def test_hmm_cases(odd, frame):
    from pyspark.sql import functions as F

    got = hmm.score_texts(odd, F.col("doc_id") == 5).collect()
    assert len(got) == odd.count() and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert hmm.score_texts(odd.limit(0), F.lit(False)).count() == 0


def test_language_id_cases(odd, frame):
    rng = random.Random(7)
    rows = [(i, prose(rng, 30, ["the", "of", "and", "that"]), "en") for i in range(60)]
    rows += [(100 + i, prose(rng, 30, ["der", "und", "ist", "nicht"]), "de") for i in range(60)]
    model = langid.fit(frame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "accepted"]
    for r in got.collect():
        assert (r.lang_pred == "und") == (r.text is None or not re.search(r"[^\W\d_]", r.text))
    asked = langid.identify(frame([(1, "the that of and"), (2, "der und nicht")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in asked.orderBy("doc_id").collect()] == ["en", "de"]
    assert langid.have_letters(pa.array(["½ ²", "12_3", "½ é", "漢", None])) == [False, False, True, True, False]
    empty = langid.fit(odd)
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, empty).collect()} == {("und", 0.0)}


def test_language_id_learns_every_language(frame):
    """More languages than 200, equal in rows: each is learned and found again by its words."""
    rng = random.Random(11)
    vocabulary = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4)] for _ in range(250)]
    assert len({w for words in vocabulary for w in words}) == 1000
    rows = [(250 * j + k, prose(rng, 12, vocabulary[k]), f"l{k:03d}") for j in range(12) for k in range(250)]
    model = langid.fit(frame(rows, "doc_id long, text string, lang string"), rows=1000)
    assert len(model.languages) == 250
    got = langid.identify(frame(rows, "doc_id long, text string, lang string"), model)
    assert got.filter("lang = lang_pred").count() > 0.9 * len(rows)


def test_quality_cases(odd, frame):
    rng = random.Random(8)
    rows = [(str(i), prose(rng, 30), 1) for i in range(60)] + [(str(100 + i), prose(rng, 20).upper() + "!!", 0) for i in range(60)]
    table = frame([*rows, ("200", None, 1), (None, "", 0)], "doc_id string, text string, label int")
    model = quality.fit(table.drop("label"), table.drop("text"))
    got = quality.rate(frame([(1, prose(rng, 25)), (2, prose(rng, 25).upper() + "!!")], "doc_id long, text string"), model)
    assert [r.predicted for r in got.orderBy("doc_id").collect()] == [1, 0]
    scored = quality.rate(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    none = quality.fit(table.drop("label"), frame([("1", None)], "doc_id string, label int"))
    assert {r.score for r in quality.rate(odd, none).collect()} == {0.5}


def test_token_cases(odd, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    texts = ["It's we'll DON'T a<|endoftext|>b <|startoftext|>", "x\u00a0y\u2003z\x1cq\x85r", "e\u0301 \u0301a", "12345 67", "a.b,c!d" * 20_000,
             "ab1" * 40_000, "Σίσυφος ΣΑΣ", "\ud7a3\u1100\u1161", None, "", " "]
    got = tokens.count_tokens(frame(list(enumerate(texts)), "doc_id int, text string"), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]
    assert tokens.count_tokens(odd, path).columns == [c for c in odd.columns if c not in ("text", "n_tokens")] + ["n_bytes", "n_tokens", "over_limit"]


def test_url_brute_force(frame, spark):
    rng = random.Random(9)
    hosts = ["a.b.com", "b.com", "x.b.com", "com", "c.net", "b.com.", "ab.com", "", "a..com", "B.Com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/fr/y", "/EN/x"]
    urls_ = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?a://b'])}"
             for _ in range(300)] + [None, "", "nothing", "://", "http://b.com\n/en/"]
    rules = [("allow", "com", "/"), ("block", "b.com", "/en"), ("allow", "a.b.com", "/en/"), ("block", "b.com", "/"), ("block", "net", ""),
             ("allow", "b.com", "/en/"), ("block", "b.com", "/en/"), ("block", None, "/"), ("allow", "", "/")]
    pages = frame(list(enumerate(urls_)), "page_id int, url string").selectExpr("page_id", "url", "1 AS host", "page_id % 3 AS verdict")
    got = urls.filter_urls(pages, frame(rules, "verdict string, host string, path string")).collect()
    assert len(got) == len(urls_)
    for r in got:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3]), r
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urls.filter_urls(pages, none).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_tree_search_cases(frame):
    rng = np.random.default_rng(10)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[50:150] = v[50]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    bad = [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None] * 8), (380, [1.0]), (None, [1.0] * 8), (400, [])]
    table = frame(rows + [(*b, 1) for b in bad] + rows[:3], "vec_id long, embedding array<float>, rank int")
    got = tree_search.nearest(table, table.filter("vec_id % 20 = 0"), recall=1.0).toPandas()
    assert set(got.query_id) == set(range(0, 300, 20))
    x = v.astype(float)
    for q, r in got.groupby("query_id"):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        assert r.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(300), -scores))[:20].tolist()
    few = tree_search.nearest(table.filter("vec_id < 5"), table.filter("vec_id = 0"))
    assert few.count() == 4
    assert tree_search.nearest(table.limit(0), table.limit(0)).count() == 0


def test_mixing_rates(frame, odd):
    docs = frame([(i, "x" * 10, "a" if i < 3000 else "b" if i < 3900 else "c") for i in range(4000)], "doc_id long, text string, source string")
    weights = frame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "source string, weight double")
    got = mixing.mix_sources(docs, weights).toPandas()
    n = got.groupby("source").size()
    assert n["a"] == pytest.approx(1000, rel=0.12) and n["b"] == pytest.approx(1000, rel=0.12) and n["c"] == pytest.approx(2000, rel=0.12)
    counts = got[got.source == "b"].groupby("doc_id").size().reindex(range(3000, 3900), fill_value=0)
    assert counts.var() == pytest.approx(counts.mean(), rel=0.25)
    assert got.shuffle_key.is_monotonic_increasing
    again = mixing.mix_sources(docs.repartition(3), weights).toPandas()
    assert again.equals(got)
    assert mixing.mix_sources(odd).columns == [*odd.columns, "copy", "shuffle_key"]
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(docs.filter("source = 'zzz'"), weights).count() == 0


def spans_of(text):
    """Brute force over the base kinds."""
    out = []
    for kind, pattern, fits in (
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if fits(m)]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets_brute_force(frame, odd):
    rng = random.Random(11)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", '"', "'", " ", "é", "😀", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4,
             "0123456789abcdef", "short", "longer_value.1=", "\n", "x" * 9]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "AKIA", "token=token=abcdefgh"]
    for r in secrets.find_secrets(frame(list(enumerate(texts)), "doc_id int, text string")).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")]
        assert base == spans_of(r.text or ""), r.text
    found = secrets.find_secrets(odd, into="found")
    assert found.columns == [*odd.columns, "found"] and found.count() == odd.count()


def test_secrets_linked_only_together(frame):
    far = " filler" * 100
    bare, user, host = "Zk3Jx9QpLm2Rt8VbNc5YwA71", "username=svc_loader", "https://db.example.com:8443/x"
    texts = [bare, user, host, f"{user} {bare}", f"{user}{far} {bare}", f"{host} {user} {bare}", f"{host} {user}", f"{host}{far} {user} {bare}"]
    got = secrets.find_secrets(frame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in got] == [
        [], [], [], ["identifier", "bare"], [], ["endpoint", "identifier", "bare"], [], ["identifier", "bare"]]
    clean = secrets.redact_secrets(frame([(1, f"a {user} {bare} é password=hunter2222 z"), (2, None)], "doc_id int, text string"))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["a [IDENTIFIER] [BARE] é [ASSIGN] z", None]


def test_secrets_many_spans(frame):
    """Time in proportion to the spans, links and gaps as in brute force."""
    rng = random.Random(14)
    bare, parts = "Zk3Jx9QpLm2Rt8VbNc5YwA71", []
    for i in range(10_000):
        parts.append(rng.choice(["password=hunter2222", f"user=name{i}", bare, "https://db.example.com:8443/x", "AKIA" + "Z9" * 8, "é" * 90]))
    text = " ".join(parts)
    docs = frame([(1, text)], "doc_id int, text string")
    secrets.find_secrets(frame([(1, "user=x token=abcdefghi")], "doc_id int, text string")).collect()
    begun = time.monotonic()
    spans = secrets.find_secrets(docs).first().spans
    assert time.monotonic() - begun < 10 and len(text) > 200_000
    assert [(s.kind, s.start, s.end) for s in spans if s.kind in secrets.BASE] == spans_of(text)
    near = {"identifier": [secrets.SECRETS], "bare": [secrets.HOLDERS], "endpoint": [secrets.SECRETS, secrets.HOLDERS]}
    at, weak, every = 0, [], []
    for part in parts:
        kind = {"p": "assign", "u": "identifier", "Z": "bare", "h": "endpoint", "A": "access"}.get(part[0])
        if kind:
            every.append((kind, at))
        at += len(part) + 1
    at_of = [a for _, a in every]
    for kind, start in every:
        close = {k for k, a in every[bisect.bisect_left(at_of, start - secrets.SCOPE):bisect.bisect_right(at_of, start + secrets.SCOPE)]}
        if kind in near and all(close & set(need) for need in near[kind]):
            weak.append((kind, start))
    assert [(s.kind, s.start) for s in spans if s.kind not in secrets.BASE] == weak
    clean = secrets.redact_secrets(docs).first().text
    held, out = 0, []
    for s in spans:
        out += [text[held:s.start], f"[{s.kind.upper()}]"]
        held = s.end
    assert clean == "".join(out) + text[held:]


def test_secrets_weak_spans_beside_base_spans(frame):
    """A weak span that overlaps a base span, before or behind it, counts for nothing."""
    texts = ["user=abc secret=user=name1234 https://x.example.com/p?token=abcdefgh", "login=" + "deadbeef" * 5 + " password=longenough",
             "https://a.example.com/" + "0123456789abcdef" * 3 + " account=me12 password=longenough"]
    got = secrets.find_secrets(frame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in got] == [["identifier", "assign", "assign"], ["hex", "assign"], ["hex", "identifier", "assign"]]


def test_models_do_not_depend_on_layout(frame):
    """The same rows in other files give the same models."""
    rng = random.Random(15)
    texts = [(i, prose(rng, rng.randrange(5, 40)) + (" !!" if i % 3 else "")) for i in range(600)]
    v = np.random.default_rng(3).standard_normal((600, 6))
    docs = frame([(i, t, int(i % 3 > 0), v[i].tolist()) for i, t in texts], "doc_id long, text string, label int, v array<double>")
    got = []
    for table in (docs, docs.orderBy(F.desc("doc_id")).repartition(5, "text")):
        model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "label"), rows=200)
        scored = hmm.score_texts(table.select("doc_id", "text"), F.col("doc_id") % 7 == 2).orderBy("doc_id").toPandas()
        near = tree_search.nearest(table, table.filter("doc_id % 20 = 0"), "doc_id", "v", 5).orderBy("query_id", "rank").toPandas()
        got.append((model, scored, near))
    (a, b) = got
    assert np.array_equal(a[0].weights, b[0].weights) and (a[0].slope, a[0].offset) == (b[0].slope, b[0].offset)
    assert np.allclose(a[1].score, b[1].score, rtol=1e-6) and a[1].base_score.round(6).equals(b[1].base_score.round(6))
    assert a[2].equals(b[2])


def test_mixing_rows_without_key(frame):
    docs = frame([(None, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).toPandas()
    counts = got.groupby("text").size()
    assert set(counts) >= {1, 2, 3} and len(got) == pytest.approx(400, rel=0.2)
    assert got.shuffle_key.nunique() == len(got)


def test_mixing_many_small_sources(frame, monkeypatch):
    """Rates sent to the documents and rates met by an exchange give the same mix."""
    docs = frame([(i, "x" * (i % 50), "big" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 1500}") for i in range(4000)],
                 "doc_id long, text string, source string")
    mixed = []
    for share in (0.0, mixing.LARGE, 2.0):
        monkeypatch.setattr(mixing, "LARGE", share)
        mixed.append(mixing.mix_sources(docs).toPandas())
    assert len(mixed[0]) > 1000 and mixed[0].equals(mixed[1]) and mixed[0].equals(mixed[2])
    assert mixed[0].shuffle_key.is_monotonic_increasing


def test_known_pieces_are_bounded(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(tokens.VOCABULARY)
    texts = [b"some words here", b"z" * 500, b"more of the words " * 3]
    whole = tokens.count_texts(texts, path)
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 3)
    assert [tokens.count_texts([t], path)[0] for t in texts] == whole == tokens.count_texts(texts, path)
    known = tokens._known(path)
    assert len(known) <= 3 and all(len(p) <= tokens.KNOWN_BYTES for p in known)
    known.clear()


def test_hmm_starts_from_every_text(frame):
    """The start counts every token of every training text, long texts and repeated rows too; groups are joined by likeness."""
    rng = random.Random(21)
    sizes = [rng.randrange(0, 40) for _ in range(900)] + [5000]
    rows = [(i % 700, np.array([rng.randrange(60) for _ in range(n)] + [0], dtype=np.uint16).tobytes()) for i, n in enumerate(sizes)]
    counts = hmm.group_counts(frame(rows, "doc_id long, symbols binary").repartition(7))
    want = np.zeros_like(counts)
    for _, b in rows:
        s = np.frombuffer(b, dtype=np.uint16)
        np.add.at(want, (s, int(s[0]) % hmm.GROUPS), 1)
    assert np.array_equal(counts, want)
    like = np.zeros((hmm.HEAD + hmm.CLASSES, 5))
    like[:4, 0] = like[:4, 3] = [9, 5, 1, 1]
    like[10:14, 1] = like[10:14, 4] = [4, 4, 2, 7]
    joined = hmm.joined_groups(like, 2)
    assert np.array_equal(joined, np.stack([like[:, 0] * 2, like[:, 1] * 2], axis=1))
    assert not hmm.joined_groups(like * 0, 2).any()


def test_common_shingles_of_all_documents(frame, monkeypatch):
    """Counted over all documents: a passage in documents that a sample by id would miss is found, in any layout."""
    words = [f"w{i}" for i in range(3000)]
    rng = random.Random(22)
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 7, 9, 20)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, ""]
    hashed = frame([(i,) for i in range(300)], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("h"))
    missed = [r.doc_id for r in hashed.filter("h <> 0").orderBy("doc_id").collect()]
    for passage, many in zip(passages, (8, 9, 10, 40), strict=True):
        for i in rng.sample(missed, many):
            texts[i] += " " + passage
    docs = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    (sets,) = [list(ngram_join.text_shingles(pa.array(texts, pa.string())))]
    at, n = np.unique(np.concatenate(sets), return_counts=True)
    want = at[n > 8]
    assert len(want) == 3 + 5 + 16
    assert np.array_equal(ngram_join.common_shingles(docs), want)
    monkeypatch.setattr(ngram_join, "COUNTED_DOCS", 40)
    assert np.array_equal(ngram_join.common_shingles(docs.repartition(9)), want)
    assert not len(ngram_join.common_shingles(docs.limit(0)))
