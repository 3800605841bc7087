"""The licence scan against a brute-force version of its base part, its expressions and its cases."""

import random
import re

import pytest

from hourgrid.llm import licenses, queries
from test_cases import odd  # noqa: F401
from test_queries import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    got = queries.QUERIES["op13_license_scan"](spark, folder).collect()
    assert len(got) == len(docs)
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in got:
        assert tuple(r[1:6]) == base_of(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") == (r.use is not None)
    gnu = [r for r in got if "GNU General Public License, version 3" in (texts[r.doc_id] or "")]
    assert all("gpl-3" in r.labels.split(",") for r in gnu)


def test_base_brute_force(frame):
    rng = random.Random(21)
    pool = ["under", "the", "MIT", "license", "Apache", "version", "2", "2.0", "CC", "BY", "NC", "BY-NC", ",", "\n", "é", "漢", "(", "under the mit license"]
    texts = [rng.choice(["", " ", "-"]).join(rng.choice(pool) + " " for _ in range(rng.randrange(60))) for _ in range(400)] + [None, ""]
    got = licenses.find_licenses(frame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for r in got:
        base = [s for s in r.license.spans if s.kind == "base"]
        want = base_of(r.text)
        starts = [s.start for s in base]
        assert (r.license.n_words, len(base), min(starts, default=None), max(starts, default=None)) == want[:4], r.text
        assert all(r.license.spans[i].start <= r.license.spans[i + 1].start for i in range(len(r.license.spans) - 1))


@pytest.mark.parametrize("line, labels, free", [
    ("MIT", {"mit"}, licenses.FREE),
    ("MIT OR GPL-2.0-only AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, licenses.FREE),
    ("(MIT OR GPL-2.0-only) AND CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, licenses.RESTRICTED),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT", {"gpl-2", "mit"}, licenses.WEAK),
    ("((Apache-2.0)) or BSD-3-Clause and LGPL-3.0+", {"apache-2", "bsd-3-clause", "lgpl-3"}, licenses.FREE),
    ("MIT Copyright of somebody", {"mit"}, licenses.FREE), ("MIT AND (", {"mit"}, licenses.FREE), ("MIT) AND GPL-3.0", {"mit"}, licenses.FREE),
    ("(GPL-3.0 OR (MIT", {"gpl-3", "mit"}, licenses.FREE), ("no-such-thing", set(), None), ("", set(), None), ("AND MIT", set(), None),
    ("LicenseRef-Own AND unheard-of", {"licenseref-own"}, licenses.RESTRICTED),
])
def test_expressions(line, labels, free):
    assert licenses.evaluate(line.encode()) == (labels, free)


def test_expressions_brute_force():
    """Random trees written with and without parentheses have the value computed on the tree."""
    rng = random.Random(22)
    names = {"MIT": licenses.FREE, "MPL-2.0": licenses.WEAK, "GPL-3.0-only": licenses.COPYLEFT, "CC-BY-NC-4.0": licenses.RESTRICTED}

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(names))
            if rng.random() < 0.3:
                return f"{name} WITH some-exception", min(names[name] + 1, licenses.FREE), 3
            return name, names[name], 3
        op, pick, rank = rng.choice([("AND", min, 2), ("or", max, 1)])
        sides = [tree(depth - 1), tree(depth - 1)]
        written = [f"({t})" if r < rank or rng.random() < 0.2 else t for t, _, r in sides]
        return f" {op} ".join(written), pick(v for _, v, _ in sides), rank

    for _ in range(300):
        line, value, _ = tree(5)
        assert licenses.evaluate(line.encode())[1] == value, line
    deep = "(" * 50_000 + "MIT" + ")" * 50_000
    assert licenses.evaluate(deep.encode()) == ({"mit"}, licenses.FREE)


def test_tags_and_cases(frame, odd, spark):  # noqa: F811
    texts = ["# SPDX-License-Identifier: Apache-2.0 OR MIT\nCC-BY-NC", "é SPDX-License-Identifier : \"GPL-2.0-only\" */", "spdx license identifier MIT",
             "GNU General Public License, version 3", "word " * 50_000 + "all rights reserved", "under the MIT license " * 20_000]
    got = [r.license for r in licenses.find_licenses(frame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert [sorted({s.label for s in g.spans}) for g in got] == [["apache-2", "cc-by-nc", "mit"], ["gpl-2"], [], ["gpl-3"], ["proprietary"], ["mit"]]
    assert [g.freedom for g in got] == [licenses.RESTRICTED, licenses.COPYLEFT, None, licenses.COPYLEFT, licenses.CLOSED, licenses.FREE]
    assert (got[4].spans[0].start, got[4].spans[0].end, len(got[5].spans)) == (50_000, 50_003, 20_000)
    found = licenses.find_licenses(odd, into="SCORE")
    assert found.columns == [c for c in odd.columns if c != "score"] + ["SCORE"] and found.count() == odd.count()
    assert licenses.find_licenses(odd.limit(0)).count() == 0
