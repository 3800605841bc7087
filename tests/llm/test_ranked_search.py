"""Ranked search against a brute-force version, with blocks and bundles cut small, and its cases."""

import collections
import math
import random
import re

import pytest

from hourgrid.llm import ranked_search
from test_cases import odd  # noqa: F401
from test_queries import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_force(docs, items, best=20):
    """The sorted lists of (doc_id, score), one for each item row with a result."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 100 - 25 + (25 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scored.append((doc, score))
        scored.sort(key=lambda s: (-s[1], s[0] is not None, s[0] or 0))
        out += [(item, scored[:best])] if scored else []
    return sorted(out, key=str)


def lists(rows):
    """The same of result rows; rows of equal item ids come as one list each, told apart by rank 1."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.item_id].append(r)
    out = []
    for item, found in by.items():
        assert len({(r["rank"], r.doc_id, r.score) for r in found}) >= len(found) // 2
        out.append((item, [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"])]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [ranked_search.Sizes(), ranked_search.Sizes(docs=7, postings=40, items=3, terms=20, held=30)])
def test_brute_force(frame, sizes):
    rng = random.Random(31)
    pool = [f"w{i}" for i in range(40)] + ["É", "漢字", "The", "the", "a_b", "x-y", "3.5"]
    weights = [1 / (i + 1) for i in range(len(pool))]

    def text(n):
        return " ".join(rng.choices(pool, weights, k=n))

    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(300)] + [(300, None), (301, ""), (302, "...")]
    docs += [(400 + i, docs[5][1]) for i in range(60)] + [(None, text(9)), (6, docs[6][1])]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(20)] + [(50, None), (51, ""), (52, "unheard of"), (None, "w1 w1 w7")]
    got = ranked_search.ranked(frame(docs, "doc_id long, text string").repartition(5), frame(items, "item_id long, text string"), sizes=sizes).collect()
    assert lists(got) == brute_force(docs, items)
    for item in {r.item_id for r in got}:
        ranks = sorted(r["rank"] for r in got if r.item_id == item)
        assert ranks == list(range(1, len(ranks) + 1))


def test_string_ids_and_best(frame):
    docs = frame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "y z"), ("d", "z z"), ("e", "q")], "name string, body string")
    got = ranked_search.ranked(docs, frame([("i", "x")], "q string, body string"), "name", "q", "body", best=2).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("i", 1, None), ("i", 2, "a")]


def test_cases(frame, odd):  # noqa: F811
    items = frame([(1, "one", "c"), (2, "word", "c"), (3, "漢字", "c"), (1, "one", "c")], "item_id long, text string, score string")
    got = ranked_search.ranked(odd, items).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 4), (1, 1, 4), (1, 2, 4), (1, 2, 4), (2, 1, 6), (3, 1, 5)]
    assert ranked_search.ranked(odd.limit(0), items).count() == 0
    assert ranked_search.ranked(odd, items.limit(0)).count() == 0
