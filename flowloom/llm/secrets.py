"""Secret scans (native): multipart credential linking.

Strong patterns are reported wherever they match. Weak parts (a login or client name, a mixed token, an
endpoint) mean little alone, so each is reported only when a complementary part lies within the same scope:
a secret for an identifier or an endpoint, an identifier or an endpoint for a secret. The parts are joined
as intervals: an equi-join on (document, scope bucket) with the neighbouring buckets, then the exact
distance. No text is ever shuffled, only the parts found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import materialize, table

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the base's least length can never pass, so the pattern asks for it at once.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"'<>]+"""
#: Least characters of an assigned value.
ASSIGNED = 6
#: Code points between two parts of one credential, at most.
SCOPE = 256
KINDS = ("assign", "access", "hex", "login", "token", "endpoint")

SPANS = "array<struct<start:long,end:long>>"


#: Matches that one fold takes: a fold copies its list at each step, so a text of many matches is folded in parts.
FOLD = 256


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def spans(text: Column, pattern: str, group: int | None = None, least: int = 0, accept=None) -> Column:
    """Code point spans of the leftmost non-overlapping matches, from the pieces between them.

    Only matches whose group has `least` characters and whose text `accept` takes count. The places inside a part of FOLD
    matches come from a fold, those of the parts from a fold over parts, so work grows little faster than the matches.
    """
    long = lambda c: c.cast("long")
    lengths = lambda c: F.transform(c, lambda x: long(F.length(x)))
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    good = F.transform(found(group or 0), lambda x: F.length(x) >= least)
    if accept is not None:
        good = F.transform(found(0), accept)
    steps = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("g"), lengths(found(0)).alias("h"), good.alias("v"))
    zero, kind = F.lit(0).cast("long"), "array<struct<start:bigint,end:bigint,v:boolean>>"

    def step(a, x):
        start = a["at"] + x["g"]
        end = start + F.coalesce(x["h"], zero)
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.coalesce(x["v"], F.lit(False)).alias("v")))).alias("out"))

    def places(all_):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda i: F.slice(all_, i * FOLD + 1, FOLD))
        folded = F.transform(parts, lambda p: F.aggregate(p, F.struct(zero.alias("at"), F.array().cast(kind).alias("out")), step))
        first = lambda f: F.aggregate(f, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        moved = let(folded, lambda f: F.zip_with(f, first(f), lambda x, low: F.transform(F.filter(x["out"], lambda s: s["v"]), lambda s: F.struct((s["start"] + low).alias("start"), (s["end"] + low).alias("end")))))
        return F.flatten(moved)

    return F.when(text.rlike(pattern), let(steps, places)).otherwise(F.array().cast(SPANS))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), and an array of spans for each kind."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), "text",
        spans(F.col("text"), ASSIGN, 2, ASSIGNED).alias("assign"), spans(F.col("text"), ACCESS).alias("access"), spans(F.col("text"), HEX).alias("hex"),
        spans(F.col("text"), LOGIN).alias("login"), spans(F.col("text"), TOKEN, accept=lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")).alias("token"), spans(F.col("text"), ENDPOINT).alias("endpoint"),
    )
    token = F.when(F.size("token") > 0, F.array_except("token", F.concat("assign", "access", "hex"))).otherwise(F.col("token"))
    return found.withColumn("token", token).drop("text")


#: Which weak part each kind completes: identifiers and endpoints go with secrets.
SIDE = {"access": "name", "login": "name", "endpoint": "name", "assign": "secret", "hex": "secret", "token": "secret"}
WEAK = ("login", "token", "endpoint")
#: Characters of a stretch of text, and spans of a run, that mask() handles at once.
CUT, PART = 4096, 512


def tagged(kind: str, *more: Column) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), *more))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part in scope: doc_id, h, weak (array of start, kind order, end)."""
    one = F.array_distinct(F.flatten(F.array(*[tagged(k, F.lit(SIDE[k]).alias("side")) for k in KINDS])))
    rows = found.dropDuplicates(["doc_id", "h"]).where(" or ".join(f"size({k}) > 0" for k in WEAK)).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("no_id"), "h", F.explode(one).alias("p")).select("d", "no_id", "h", "p.*")
    bucket = lambda c: F.floor(c / F.lit(scope)).cast("long")
    weak = rows.where(F.col("kind") >= 3).withColumn("b", F.explode(F.sequence(bucket(F.col("start")) - 1, bucket(F.col("end")) + 1)))
    other = rows.select("d", "no_id", "h", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("side").alias("side2"))
    w, o = weak.alias("w"), other.alias("o")
    same = (F.col("w.d") == F.col("o.d")) & (F.col("w.no_id") == F.col("o.no_id")) & (F.col("w.h") == F.col("o.h")) & (F.col("w.b") == F.col("o.b"))
    near = (F.col("w.side") != F.col("o.side2")) & (F.col("o.s2") <= F.col("w.end") + scope) & (F.col("o.e2") >= F.col("w.start") - scope)
    kept = w.join(o, same & near, "left_semi").select("d", "no_id", "h", "start", "kind", "end").distinct()
    return kept.groupBy("d", "no_id", "h").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak")).withColumnRenamed("h", "h2")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h, base and spans: arrays of (start, kind, end), kind an index into KINDS, in order.

    base holds the strong patterns alone, spans those and the linked weak parts. One row per input row; null and
    empty texts have no spans, an empty table gives no rows, and other columns are ignored. Spans with one start stand in the order of
    KINDS. Rows that repeat a document get the same spans each; rows with one id are told apart by their texts. A text is taken whole,
    however long.
    """
    found = materialize(parts(docs))
    base = F.flatten(F.array(*[tagged(k) for k in KINDS[:3]]))
    found = found.withColumn("base", F.array_sort(base))
    more = linked(found, scope)
    joined = found.join(more, (F.coalesce(found.doc_id, F.lit(-1)) == more.d) & (found.doc_id.isNull() == more.no_id) & (found.h == more.h2), "left")
    return joined.select("doc_id", "h", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "weak"))).alias("spans"))


def written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gaps(found: Column) -> Column:
    """What lies between the spans of `found` (sorted by start), as structs (a, b); the spans that overlap one before are part of it.

    A fold over all spans would copy its result for each of them, so runs of PART spans are folded each by itself, from the furthest
    end of the runs before.
    """

    def of_runs(runs):
        ends = F.transform(runs, lambda r: F.array_max(F.transform(r, lambda s: s["end"])))

        def fold(run, i):
            at = F.coalesce(F.array_max(F.filter(ends, lambda _, k: k < i)), F.lit(0))
            start = F.struct(at.cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"))
            new = lambda a, s: F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.struct(a["at"].alias("a"), s["start"].cast("long").alias("b"))))).otherwise(a["out"])
            return F.aggregate(run, start, lambda a, s: F.struct(F.greatest(a["at"], s["end"].cast("long")).alias("at"), new(a, s).alias("out")), lambda a: a["out"])

        return F.flatten(F.transform(runs, fold))

    count = F.floor((F.size(found) - 1) / F.lit(PART)).cast("int")
    return let(F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(found, i * PART + 1, F.lit(PART))), of_runs)


def mask(text: Column, found: Column, with_text: str = "[SECRET]") -> Column:
    """The text with every span of `found` (in order) replaced; overlapping spans become one. Linear in the text and its spans.

    Places count characters, and a substring is found by walking from the start of its text. So the text is first cut into stretches of CUT
    characters, in one pass, and every piece that stays is put together from these.
    """

    def of_stretches(stretches):
        def piece(a, b):
            i, j = (F.floor(x / F.lit(CUT)).cast("int") for x in (a, b))
            at = lambda k: F.coalesce(F.get(stretches, k), F.lit(""))
            first, left, right = at(i), (a % CUT + 1).cast("int"), (b % CUT).cast("int")
            whole = F.array_join(F.slice(stretches, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            return F.when(i == j, F.substr(first, left, (b - a).cast("int"))).otherwise(F.concat(F.substr(first, left, F.lit(CUT)), whole, F.substr(at(j), F.lit(1), right)))

        kept = F.transform(gaps(found), lambda g: piece(g["a"], g["b"]))
        end = F.array_max(F.transform(found, lambda s: s["end"])).cast("long")
        tail = piece(end, F.greatest(F.length(text).cast("long"), end))
        return F.array_join(F.concat(kept, F.array(tail)), with_text)

    return F.when(F.size(found) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), of_stretches)).otherwise(text)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _found_sql(i: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """The same spans in SQL: the pieces between the matches add up to their places. RE2 has no look-behind; greedy runs need none."""
    r = "'" + pattern.replace("'", "''") + "'"
    lengths = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(x))), 0)"
    return f"""SELECT rid, {i} AS kind, text, CAST({lengths('p[1:i]')} + {lengths('m[1:i-1]')} AS BIGINT) AS s, CAST({lengths('p[1:i]')} + {lengths('m[1:i]')} AS BIGINT) AS e
  FROM (SELECT rid, text, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, text, regexp_extract_all(text, {r}, 0) AS m, regexp_extract_all(text, {r}, {group}) AS v, string_split_regex(text, {r}) AS p FROM d WHERE regexp_matches(text, {r})))
  WHERE length(v[i]) >= {least}"""


_RE2 = {"assign": ASSIGN.replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), "token": TOKEN.partition(")")[2]}
_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "login": LOGIN, "token": TOKEN, "endpoint": ENDPOINT}
_SIDES = "CASE WHEN kind IN (1, 3, 5) THEN 'name' ELSE 'secret' END"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found_sql(i, _RE2.get(k, p), *((2, ASSIGNED) if k == "assign" else ())) for i, (k, p) in enumerate(_PATTERNS.items()))}),
g AS (SELECT rid, kind, s, e FROM f WHERE kind <> 4 OR (regexp_matches(text[s + 1:e], '[0-9]') AND regexp_matches(text[s + 1:e], '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM f b WHERE b.rid = f.rid AND b.kind < 3 AND b.s = f.s AND b.e = f.e))),
h AS (SELECT *, {_SIDES} AS side, ['assign', 'access', 'hex', 'login', 'token', 'endpoint'][kind + 1] || ':' || s || ':' || e AS t FROM g),
a AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(t, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind) AS spans
  FROM h WHERE kind < 3 OR EXISTS (SELECT 1 FROM h o WHERE o.rid = h.rid AND o.side <> h.side AND o.s <= h.e + {SCOPE} AND o.e >= h.s - {SCOPE}) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
