"""License scans: an Aho-Corasick automaton for notices and tags, a shunting-yard parser for expressions.

A text becomes its words in lower case with one space between and around them. One automaton of all phrases, each with a
space at both ends, runs over it once and reports every place. Three kinds of phrases are in it: the base phrases, notices
of further licences, and identifier tags. Behind a tag (and a colon or equals sign) stands a licence expression up to the
end of its line; it is brought into postfix order with two stacks (`with` binds before `and`, `and` before `or`) and
evaluated: `or` gives the freer of two terms, `and` the stricter, `with` one step more freedom than its licence.

Texts are scanned in their own tasks, whole, in time in proportion to their length and places; nothing is shuffled.

Cases: null and empty texts have no words, no places, no labels and a score of 0. Repeated rows each get their row. An
expression ends before the first token that cannot follow; an operator left over at its end is ignored, an open parenthesis
is closed there. Identifiers of no known family are kept as labels only with the prefix `licenseref-`. A notice inside a longer
one counts once, as the longer; base phrases always count. All other columns are kept, whatever their names.
"""

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid.llm import storage, words

# The phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the mit license": "mit", "mit licence": "mit", "expat license": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "isc license": "isc",
    "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2", "eclipse public license": "epl",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3", "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0", "dedicated to the public domain": "cc0", "released into the public domain": "cc0",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx license identifier", "spdx licence identifier", "license expression", "licence expression")
# How free a licence family leaves the reader; the longest fitting prefix counts.
FREE, WEAK, COPYLEFT, RESTRICTED, CLOSED = 4, 3, 2, 1, 0
USES = ["closed", "restricted", "copyleft", "weak", "free"]
FAMILIES = {
    "mit": FREE, "apache": FREE, "bsd": FREE, "0bsd": FREE, "isc": FREE, "zlib": FREE, "unlicense": FREE, "cc0": FREE, "cc-by": FREE,
    "psf": FREE, "python": FREE, "bsl-1": FREE, "ncsa": FREE, "wtfpl": FREE, "postgresql": FREE, "openssl": FREE, "x11": FREE,
    "lgpl": WEAK, "mpl": WEAK, "epl": WEAK, "cddl": WEAK, "eupl": WEAK, "ms-pl": WEAK, "artistic": WEAK,
    "gpl": COPYLEFT, "agpl": COPYLEFT, "gfdl": COPYLEFT, "cc-by-sa": COPYLEFT, "osl": COPYLEFT, "odbl": COPYLEFT,
    "cc-by-nc": RESTRICTED, "cc-by-nd": RESTRICTED, "sspl": RESTRICTED, "busl": RESTRICTED, "licenseref-": RESTRICTED,
    "proprietary": CLOSED, "unlicensed": CLOSED,
}
# How sure a label of each kind is.
SURE = {"base": 0.9, "notice": 0.7, "tag": 0.95}

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                     T.StructField("label", T.StringType()), T.StructField("kind", T.StringType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
                      T.StructField("freedom", T.IntegerType())])

_SPACES = bytes(words.LOWER[i] if words.ALNUM[i] else 32 for i in range(256))
_TOKEN = re.compile(rb"[ \t\"'`]*([A-Za-z0-9][A-Za-z0-9.+-]*|[()])")
_BEFORE = re.compile(rb"[ \t\"'`]*[:=]")
_BINDS = {"or": 1, "and": 2, "with": 3}


@cache
def _automaton():
    made, known = ahocorasick.Automaton(), {}
    for kind, phrases in (("notice", NOTICES), ("tag", dict.fromkeys(TAGS)), ("base", BASE)):
        known |= {p: (kind, label, len(p.split())) for p, label in phrases.items()}
    for phrase, value in known.items():
        made.add_word(f" {phrase} ", value)
    made.make_automaton()
    return made


def freedom(identifier: str) -> int | None:
    """How free a licence of this identifier or label is; None for one of no known family."""
    fits = [p for p in FAMILIES if identifier.startswith(p) and (p[-1] == "-" or identifier[len(p):len(p) + 1] in ("", "-"))]
    return FAMILIES[max(fits, key=len)] if fits else None


def label_of(identifier: str) -> str | None:
    """The label of an identifier: without `-only`, `-or-later`, `+`, a final `.0` and the version of the CC licences."""
    if freedom(identifier) is None:
        return None
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    name = re.sub(r"\.0$", "", name)
    return re.sub(r"^(cc-by(?:-nc|-nd|-sa)*|cc0)-[0-9.]+$", r"\1", name) if name.startswith("cc") else name


def postfix(line: bytes) -> list[str]:
    """The operands and operators of the expression that `line` begins with, operators behind their operands."""
    out, waiting, operand, at = [], [], True, 0
    while token := _TOKEN.match(line, at):
        name = token[1].decode().lower()
        if operand:
            if name == "(":
                waiting.append(name)
            elif name == ")" or name in _BINDS:
                break
            else:
                out.append(name)
                operand = False
        elif name == ")":
            if "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif name in _BINDS:
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[name]:
                out.append(waiting.pop())
            waiting.append(name)
            operand = True
        else:
            break
        at = token.end()
    if operand:  # what waits behind the last operand has no second one
        while waiting and waiting.pop() == "(":
            pass
    return out + [w for w in reversed(waiting) if w != "("]


def evaluate(line: bytes) -> tuple[set[str], int | None]:
    """The labels in the expression that `line` begins with, and its freedom (None: no known licence)."""
    labels: set[str] = set()
    values: list[tuple[str, int | None]] = []
    for token in postfix(line):
        if token not in _BINDS:
            values.append((token, freedom(token)))
            continue
        (_, b), (name, a) = values.pop(), values.pop()
        if token == "with":  # its second operand is an exception, no licence
            values.append((name, None if a is None else min(a + 1, FREE)))
        else:
            for side in ((name, a), (_, b)):
                if side[1] is not None and side[0] and (label := label_of(side[0])):
                    labels.add(label)
            known = [x for x in (a, b) if x is not None]
            pick = max if token == "or" else min
            values.append(("", pick(known) if known else None))
    for name, value in values[:1]:
        if value is not None and name and (label := label_of(name)):
            labels.add(label)
    return labels, values[0][1] if values else None


def scan_text(text: bytes) -> tuple[int, list[tuple[int, int, str, str]], int | None]:
    """Words of a UTF-8 text, its spans (first word, word behind the last, label, kind) in order, its freedom."""
    parts = text.translate(_SPACES).split()
    line = f" {b' '.join(parts).decode(errors='replace')} "
    base, notices, tags = [], [], []
    n = reached = 0
    for end, (kind, label, length) in _automaton().iter(line):
        n += line.count(" ", reached, end)
        reached = end
        {"base": base, "notice": notices, "tag": tags}[kind].append((n - length, n, label, kind))
    spans, free = list(base), []
    furthest = -1
    for span in sorted(base + notices, key=lambda s: (s[0], -s[1], s[3])):
        if span[1] > furthest:
            furthest = span[1]
            free.append(freedom(span[2]))
            if span[3] == "notice":
                spans.append(span)
    if tags:
        block = words.Block(0, np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
        ends = words.find_words(block, words.ALNUM).ends
        for first, last, _, kind in tags:
            at = int(ends[last - 1])
            if not (sign := _BEFORE.match(text, at)):
                continue
            stop = re.compile(rb"[\r\n]|$").search(text, sign.end()).start()
            labels, value = evaluate(text[sign.end():stop])
            spans += [(first, last, label, kind) for label in sorted(labels)]
            free += [value] if value is not None else []
    return len(parts), sorted(spans), min(free, default=None)


def _scanner(text: str, keep: bool, into: str):
    def scan(batches):
        for batch in batches:
            column = batch.column(text).cast(pa.large_binary())
            found = [scan_text(t.as_py() or b"") for t in column]  # one text at a time
            rows = pa.array([{"n_words": n, "spans": [dict(zip(SPAN.names, s, strict=True)) for s in spans], "freedom": free}
                             for n, spans, free in found], pa.struct([
                                 ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([
                                     ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string())]))),
                                 ("freedom", pa.int32())]))
            kept = [i for i, name in enumerate(batch.schema.names) if keep or name != text]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [rows],
                                             names=[batch.schema.names[i] for i in kept] + [into])

    return scan


def find_licenses(docs: DataFrame, text: str = "text", into: str = "license", keep_text: bool = True) -> DataFrame:
    """`docs` with a struct: n_words, spans (start, end, label, kind; in words) and freedom (index into USES, or null).

    A column named as `into` is replaced; without `keep_text` the text is left out.
    """
    storage.bounded_batches(docs)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower() or c == text])
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    return docs.mapInArrow(_scanner(text, keep_text, into), T.StructType([*fields, T.StructField(into, FOUND)]))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = storage.table(spark, folder, "documents").select("doc_id", "text")
    found = find_licenses(docs, keep_text=False)
    base = F.filter("license.spans", lambda s: s["kind"] == "base")

    def listed(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    # A label counts once, with the surest of its kinds.
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])
    labels = F.array_distinct(F.transform("license.spans", lambda s: s["label"]))
    doubt = F.aggregate(labels, F.lit(1.0), lambda left, label: left * (1 - F.array_max(F.transform(
        F.filter("license.spans", lambda s: s["label"] == label), lambda s: sure[s["kind"]]))))
    uses = F.array(*[F.lit(u) for u in USES])
    return found.select(
        "doc_id", "license.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("license.spans")).alias("labels"),
        F.round(1 - doubt, 6).alias("score"), F.get(uses, F.col("license.freedom")).alias("use"))
