"""Secret scans with multipart credential linking, in DataFrame functions only.

Positions come from splitting a text by a pattern: the pieces between matches and the matches, laid end to
end, give every match its place. Base kinds are reported as they are. Weak kinds mean little alone: an access identifier
(user, client or account name), a bare secret (a long mixed token) and an endpoint (a URL or an address with a port). They are
joined as intervals: a part is reported when the other two kinds both have a part in its scope, that is, starting within
`SCOPE` code points. The join is a binary search of each part's scope among the sorted places of the others, so it takes time in
proportion to the spans and the logarithm of their number. All parts of one join lie in one text, so nothing is shuffled.

Cases: null and empty texts have no spans. Repeated rows each get their row. All other columns are kept. Offsets
are code points, ends exclusive. Spans are sorted by start, then by the order of KINDS, then by end.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import storage

SCOPE = 200
# The patterns of the base kinds and the least length of what counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same matches as AKIA[A-Z0-9]+ of at least 16 characters
HEX = r"[0-9a-f]{32,}"  # the same matches as [0-9a-f]+ of at least 32 characters
ASSIGN_LEAST = 8
# The weak kinds.
IDENTIFIER = r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BARE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|s3)[a-z:+]*://[^\s\"'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b"
KINDS = ["assign", "access", "hex", "identifier", "bare", "endpoint"]
BASE = KINDS[:3]
SECRETS, HOLDERS = ("assign", "hex", "bare"), ("access", "identifier")
SPAN = "struct<start:int,kind:int,end:int,hit:string>"
PIECE = 32
CUT = 2048


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, zero: int, join, levels: int = 2) -> Column:
    """For each of `values` what `join` makes of `zero` and all values before it.

    A fold copies its state at every step, so results are not gathered in one: pieces of `PIECE` values are joined first, what
    is before each piece follows from those (by the same means, `levels` times), and each piece is gone through alone.
    """
    def each(v, start):
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i), start, join))

    if not levels:
        return _let(values, lambda v: each(v, F.lit(zero)))

    def cut(v):
        def piece(b):
            return F.slice(v, b * PIECE + 1, F.lit(PIECE))

        count = F.ceil(F.size(v) / PIECE).cast("int")
        whole = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.aggregate(piece(b), F.lit(zero), join))
        return F.flatten(F.transform(_before(whole, zero, join, levels - 1), lambda start, b: _let(piece(b), lambda w: each(w, start))))

    return _let(values, cut)


def _below(places: Column, value: Column) -> Column:
    """How many of the sorted `places` are below `value`, by binary search."""
    def halve(s, _):
        middle = F.shiftright(s["low"] + s["high"], 1)
        left, less = s["low"] < s["high"], F.get(places, middle) < value
        return F.struct(F.when(left & less, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(left & ~less, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(places))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(places).alias("high")), halve, lambda s: s["low"])


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, text) of the leftmost non-overlapping matches of `pattern`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(parts):
        starts = _before(F.transform(parts, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))), 0, lambda a, b: a + b)
        spans = F.transform(F.arrays_zip(parts.alias("part"), starts.alias("at")), lambda z: F.struct(
            (z["at"] + F.length(z["part"]["gap"])).alias("start"), F.lit(kind).alias("kind"),
            (z["at"] + F.length(z["part"]["gap"]) + F.length(z["part"]["hit"])).alias("end"), z["part"]["hit"].alias("hit")))
        return F.filter(spans, lambda s: s["hit"].isNotNull())  # the last gap has no match behind it

    spans = _let(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), placed)
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def _is(span: Column, *kinds: str) -> Column:
    return span["kind"].isin([KINDS.index(k) for k in kinds])


def _places(spans: Column, *kinds: str) -> Column:
    return F.transform(F.filter(spans, lambda s: _is(s, *kinds)), lambda s: s["start"])


def _free(spans: Column) -> Column:
    """Sorted `spans` without weak ones that overlap a base one. Spans of a kind are apart, so the last to start before the end decides."""
    def apart(kind, rest):
        def check(own):
            return _let(F.transform(own, lambda o: o["start"]), lambda starts: F.filter(rest, lambda s: _is(s, *BASE) | F.coalesce(
                F.get(own, _below(starts, s["end"]) - 1)["end"] <= s["start"], F.lit(True))))

        return _let(F.filter(spans, lambda s: _is(s, kind)), check)

    left = spans
    for kind in BASE:
        left = apart(kind, left)
    return left


def _linked(spans: Column) -> Column:
    """The base spans of sorted `spans`, and the weak ones whose complementary parts start within the scope."""
    def near(places, span):
        return F.coalesce(F.get(places, _below(places, span["start"] - SCOPE)) <= span["start"] + SCOPE, F.lit(False))

    def join(secret, holder):
        return F.filter(spans, lambda s: _is(s, *BASE) | ((_is(s, "bare") | near(secret, s)) & (_is(s, "identifier") | near(holder, s))))

    return _let(_places(spans, *SECRETS), lambda secret: _let(_places(spans, *HOLDERS), lambda holder: join(secret, holder)))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """`docs` with `into`: an array of (kind, start, end). `into` must not be a column of `docs`."""
    names = [storage.free_name(docs, f"found_{k}") for k in KINDS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    patterns = [ASSIGN, ACCESS, HEX, IDENTIFIER, BARE, ENDPOINT]
    found = docs.select(*columns, *[matches(body, p, k).alias(n) for k, (p, n) in enumerate(zip(patterns, names, strict=True))])
    assign, access, hexes, identifier, bare, endpoint = (F.col(n) for n in names)
    assign = F.filter(assign, lambda s: F.length(F.regexp_replace(s["hit"], ASSIGN_HEAD, "")) >= ASSIGN_LEAST)
    bare = F.filter(bare, lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]"))
    every = storage.free_name(docs, "every_span")
    found = found.select(*columns, F.array_sort(F.concat(assign, access, hexes, identifier, bare, endpoint)).alias(every))
    spans = F.col(every)

    for work in (_free, _linked):
        found = found.withColumn(every, F.when(F.exists(spans, lambda s: ~_is(s, *BASE)), _let(spans, work)).otherwise(spans))
    named = F.transform(spans, lambda s: F.struct(_name(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*columns, named.alias(into))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span of the text replaced by `[KIND]`; overlapping spans are replaced together."""
    into, pieces = storage.free_name(docs, "spans"), storage.free_name(docs, "pieces")
    body = F.col(f"`{text}`")
    # Substrings of a long text are found from its start; those of a piece are not far.
    found = find_secrets(docs, text, into).withColumn(pieces, F.when(
        F.size(into) > 0, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))

    def between(start, end):
        first = F.floor(start / CUT).cast("int")
        held = F.slice(F.col(pieces), first + 1, F.floor(end / CUT).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * CUT + 1, end - start)

    reached = _before(F.transform(F.col(into), lambda p: p["end"]), 0, lambda a, b: F.greatest(a, b))
    shown = F.transform(F.arrays_zip(F.col(into).alias("span"), reached.alias("at")), lambda z: F.when(
        z["span"]["start"] < z["at"], "").otherwise(F.concat(
            between(z["at"], z["span"]["start"]), F.lit("["), F.upper(z["span"]["kind"]), F.lit("]"))))
    last = F.array_max(F.transform(F.col(into), lambda p: p["end"]))
    clean = F.when(F.size(into) > 0, F.concat(F.array_join(shown, ""), between(last, F.length(body)))).otherwise(body)
    return found.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(storage.table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH kinds(k, kind, pattern) AS (VALUES {', '.join(f"({k}, '{n}', {_quoted(p)})" for k, (n, p) in enumerate(
    zip(KINDS, [ASSIGN, ACCESS, HEX, IDENTIFIER, BARE, ENDPOINT], strict=True)))}),
parts AS (SELECT doc_id, k, kind, string_split_regex(coalesce(text, ''), pattern) AS gaps,
                 regexp_extract_all(coalesce(text, ''), pattern) AS hits FROM documents, kinds),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM parts),
placed AS (SELECT doc_id, k, kind, hits[i] AS hit, length(hits[i]) AS n,
                  CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
                       + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM numbered),
spans AS (SELECT doc_id, k, kind, a, a + n AS b, hit FROM placed
          WHERE (k <> 0 OR length(regexp_replace(hit, {_quoted(ASSIGN_HEAD)}, '')) >= {ASSIGN_LEAST})
            AND (k <> 4 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')))),
usable AS (SELECT * FROM spans s WHERE k < 3 OR NOT EXISTS (
             SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.k < 3 AND o.a < s.b AND s.a < o.b)),
near AS (SELECT *,
           EXISTS (SELECT 1 FROM usable o WHERE o.doc_id = u.doc_id AND o.k IN (0, 2, 4) AND abs(o.a - u.a) <= {SCOPE}) AS secret,
           EXISTS (SELECT 1 FROM usable o WHERE o.doc_id = u.doc_id AND o.k IN (1, 3) AND abs(o.a - u.a) <= {SCOPE}) AS holder
         FROM usable u),
reported AS (SELECT *, kind || ':' || a || ':' || b AS s FROM near
             WHERE k < 3 OR (k = 3 AND secret) OR (k = 4 AND holder) OR (k = 5 AND holder AND secret)),
joined AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                  string_agg(s, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k, b) AS spans
           FROM reported GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""
