"""Document fingerprints (native): a Merkle tree over leaves, paragraphs, sections and the root.

A section is up to 16 lines, or fewer before blank lines; a paragraph is a line; a leaf is a sentence, or 200
characters of a longer one. A leaf's hash is the MD5 of its text, any other node's the MD5 of its children's hashes,
the root's SHA-256, so equal roots mean equal texts. Lengths in code points stand beside the hashes, and likeness weighs by
them. A comparison descends only into sections whose hashes differ. The fingerprint is the written tree: the root, and
of each section its hash, its length, and its leaves with theirs. The tree is built inside the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import table

SECTION = r"(?:[^\n]+(?:\n|\z)){1,16}\n*|\n+"
PARAGRAPH = r"[^\n]*\n|[^\n]+"
LEAF = r"[^.!?\n]{1,200}[.!?\n]*|[.!?\n]+"
#: Groups of neighbouring ids, at most, and documents in one, about.
MOST_GROUPS, PER_GROUP = 65536, 64
LOWEST = -(1 << 63)


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def tree(text: Column) -> Column:
    """array of sections: struct(h, n, leaves: array of struct(h, n)). Text must not be null; an empty text has no sections."""
    pieces = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    leaves = lambda p: F.transform(pieces(p, LEAF), lambda x: F.struct(F.md5(x.cast("binary")).alias("h"), F.length(x).alias("n")))
    joined = lambda nodes: F.md5(F.array_join(nodes, ".").cast("binary"))

    def section(s):
        made = F.transform(pieces(s, PARAGRAPH), leaves)
        above = lambda m: joined(F.transform(m, lambda p: joined(F.transform(p, lambda x: x["h"]))))
        return let(made, lambda m: F.struct(above(m).alias("h"), F.length(s).alias("n"), F.flatten(m).alias("leaves")))

    return F.transform(pieces(text, SECTION), section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["h"]), "."), 256)


def fingerprint(sections: Column) -> Column:
    """root:section;section..., a section being hash*length(leaf*length,leaf*length...)."""
    node = lambda x: F.concat(x["h"], F.lit("*"), x["n"].cast("string"))
    whole = lambda s: F.concat(node(s), F.lit("("), F.array_join(F.transform(s["leaves"], node), ","), F.lit(")"))
    return F.concat(root(sections), F.lit(":"), F.array_join(F.transform(sections, whole), ";"))


def counted(nodes: Column, side: int) -> Column:
    """The distinct nodes in order of their hashes: struct(h, side, m, node), m times each. Sorted once, then only neighbours are compared."""

    def runs(s):
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] != x["h"]), i)), lambda i: i.isNotNull())
        one = lambda at, j: F.struct(F.get(s, at)["h"].alias("h"), F.lit(side).alias("side"), (F.coalesce(F.get(starts_, j + 1), F.size(s)) - at).alias("m"), F.get(s, at).alias("node"))

        def all_(found):
            nonlocal starts_
            starts_ = found
            return F.transform(found, one)

        starts_ = None
        return let(starts, all_)

    return let(F.array_sort(nodes), runs)


def paired(a: Column, b: Column) -> Column:
    """array of struct(node, a, b): how often each distinct node stands on both sides."""

    def join(both):
        def one(x, i):
            after, zero = F.get(both, i + 1), F.lit(0)
            two = F.when(after["h"] == x["h"], after["m"]).otherwise(zero)
            return F.struct(x["node"].alias("node"), F.when(x["side"] == 0, x["m"]).otherwise(zero).alias("a"), F.when(x["side"] == 0, two).otherwise(x["m"]).alias("b"), ((i == 0) | (F.get(both, F.greatest(i - 1, zero))["h"] != x["h"])).alias("first"))

        return F.filter(F.transform(both, one), lambda p: p["first"])

    return let(F.array_sort(F.concat(counted(a, 0), counted(b, 1))), join)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the shared text over both texts. Sections count as often as both have them; of the others, so do the leaves."""
    shared = lambda pairs: total(F.transform(pairs, lambda p: (F.least(p["a"], p["b"]) * p["node"]["n"]).cast("long")))
    rest = lambda pairs, side: F.flatten(F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["node"]["leaves"], p[side] - F.least(p["a"], p["b"])))))
    whole = total(F.transform(a, lambda s: s["n"].cast("long"))) + total(F.transform(b, lambda s: s["n"].cast("long")))
    both = let(paired(a, b), lambda p: shared(p) + shared(paired(rest(p, "a"), rest(p, "b"))))
    return F.when(whole == 0, F.lit(1.0)).otherwise((2 * both).cast("double") / F.greatest(whole, F.lit(1)))


def changed_sections(a: Column, b: Column) -> Column:
    """Where an edit lies: the indexes of a's sections that b doesn't have."""
    held = F.transform(b, lambda s: s["h"])
    marked = F.transform(a, lambda s, i: F.when(F.array_contains(held, s["h"]), F.lit(None)).otherwise(i))
    return F.array_compact(marked)


def with_next(docs: DataFrame, add) -> DataFrame:
    """docs(doc_id, text) plus add(text) as `tree`, and next_text, next_tree: those of the next row by descending doc_id.

    After the last row comes the first. A null doc_id stands last; ties stand by a hash of the text. The order
    is global but no task sees it whole: ids are cut at approximate quantiles into groups, the first row of a
    group is sent to the group before it as well, and each group is then windowed by itself. Texts are
    shuffled once.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("k"))
    n = ids.count()
    groups = max(1, min(MOST_GROUPS, n // PER_GROUP))
    cuts = [i / groups for i in range(1, groups)]
    bounds = sorted(set(ids.agg(F.percentile_approx("k", cuts, 100 * groups)).first()[0] or [])) if cuts and n else []
    step = max(1, math.isqrt(len(bounds)))
    below = lambda arr, k: F.size(F.filter(arr, lambda b: b < k))

    def group(k):
        if not bounds:
            return F.lit(0)
        coarse = F.greatest(below(F.lit(bounds[::step]), k) - 1, F.lit(0))
        return coarse * step + below(F.slice(F.lit(bounds), coarse * step + 1, F.lit(step)), k)

    tops = {r["p"]: r["k"] for r in ids.groupBy(group(F.col("k")).cast("int").alias("p")).agg(F.max("k").alias("k")).collect()}
    there = sorted(tops)
    size = len(bounds) + 1
    first, before = [None] * size, [0] * size
    for i, p in enumerate(there):
        first[p], before[p] = tops[p], there[i + 1] if i + 1 < len(there) else there[0]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("k")).withColumn("p", group(F.col("k")).cast("int"))
    at = lambda values: F.lit(values)[F.col("p")]
    own = F.struct(F.col("p").alias("p"), F.lit(False).alias("ghost"))
    if there:
        ghost = F.struct(at(before).cast("int").alias("p"), F.lit(True).alias("ghost"))
        rows = rows.withColumn("o", F.explode(F.when(F.col("k") == at([LOWEST if x is None else x for x in first]), F.array(own, ghost)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("o", own)
    rows = rows.select("doc_id", "text", "k", F.xxhash64("text").alias("h"), "o.*").repartition("p")
    rows = rows.withColumn("tree", add(F.col("text")))
    w = Window.partitionBy("p").orderBy("ghost", F.col("k").desc(), "h")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_tree", F.lead("tree").over(w))
    return rows.where(~F.col("ghost")).select("doc_id", "text", "tree", "next_text", "next_tree")


def compare_edits(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document, by descending doc_id. A
    null text is empty. One row per input row; rows of one id follow each other in an order that depends on their texts alone. An empty table gives no
    rows, the only document is its own next one, other columns are not read. A very long text is one row, and so is its tree, which has some 36
    characters for each paragraph.
    """
    n = F.length("text")
    cut = F.floor(n / F.lit(3)).cast("int")
    rows = with_next(docs, tree).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_tree", tree(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, text: str) -> str:
    """Sections of a text: hash, length and leaves, as lists."""
    join = lambda nodes: f"md5(array_to_string({nodes}, '.'))"
    leaves = f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: {{'h': md5(x), 'n': length(x)}})"
    made = f"list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: {leaves})"
    above = join("list_transform(m, lambda p: " + join("list_transform(p, lambda x: x.h)") + ")")
    return f"""{name}_made AS (SELECT rid, i, s, {made} AS m FROM (SELECT rid, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT rid, regexp_extract_all({text}, '{SECTION}') AS ss FROM e))),
{name}_sec AS (SELECT rid, i, {above} AS h, length(s) AS n, flatten(m) AS leaves FROM {name}_made),
{name} AS (SELECT rid, sum(n) AS n, sha256(string_agg(h, '.' ORDER BY i)) || ':' || string_agg(h || '*' || n || '(' || array_to_string(list_transform(leaves, lambda x: x.h || '*' || x.n), ',') || ')', ';' ORDER BY i) AS f FROM {name}_sec GROUP BY rid)"""


def _near_sql(name: str, a: str, b: str, mate: str) -> str:
    """Shared length of two trees: sections as often as on both sides, then the leaves of the others. `mate`: which row b's tree belongs to."""
    side = lambda t, key: f"(SELECT {key} AS rid, h, any_value(n) AS n, any_value(leaves) AS leaves, count(*) AS m FROM {t} GROUP BY {key}, h)"
    other = f"(SELECT m.rid AS rid, t.h, t.n, t.leaves FROM {b}_sec t JOIN {mate} m ON m.mate = t.rid)"
    return f"""{name}_p AS (SELECT coalesce(x.rid, y.rid) AS rid, coalesce(x.n, y.n) AS n, coalesce(x.leaves, y.leaves) AS leaves, coalesce(x.m, 0) AS a, coalesce(y.m, 0) AS b
  FROM {side(a + '_sec', 'rid')} x FULL JOIN {side(other, 'rid')} y ON x.rid = y.rid AND x.h = y.h),
{name}_l AS (SELECT rid, l.h AS h, l.n AS n, sum(a) AS a, sum(b) AS b FROM (SELECT rid, unnest(leaves) AS l, a - least(a, b) AS a, b - least(a, b) AS b FROM {name}_p WHERE a <> b) GROUP BY ALL),
{name} AS (SELECT rid, sum(n) AS n FROM (SELECT rid, least(a, b) * n AS n FROM {name}_p UNION ALL SELECT rid, least(a, b) * n FROM {name}_l) GROUP BY rid)"""


_LIKE = "CASE WHEN coalesce({0}.n, 0) + coalesce({1}.n, 0) = 0 THEN 1.0 ELSE CAST(2 * coalesce({2}.n, 0) AS DOUBLE) / greatest(coalesce({0}.n, 0) + coalesce({1}.n, 0), 1) END"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT rid, doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY rid), first(text) OVER (ORDER BY rid)) AS next_text, coalesce(lead(rid) OVER (ORDER BY rid), 1) AS mate FROM d),
e AS (SELECT *, substring(text, 1, n - n // 3) || substring(next_text, 1, n // 3) AS edited FROM c),
own AS (SELECT rid, rid AS mate FROM e), nxt AS (SELECT rid, mate FROM e),
{_tree_sql('t', 'text')},
{_tree_sql('u', 'edited')},
{_near_sql('ne', 't', 'u', 'own')},
{_near_sql('nn', 't', 't', 'nxt')}
SELECT doc_id, e.n AS n_chars, sha256(edited) AS edited_sha256, coalesce(t.f, sha256('') || ':') AS fingerprint, coalesce(u.f, sha256('') || ':') AS edited_fingerprint,
  {_LIKE.format('t', 'u', 'ne')} AS near_edited, {_LIKE.format('t', 't2', 'nn')} AS near_next
FROM e LEFT JOIN t ON e.rid = t.rid LEFT JOIN u ON e.rid = u.rid LEFT JOIN t t2 ON e.mate = t2.rid LEFT JOIN ne ON e.rid = ne.rid LEFT JOIN nn ON e.rid = nn.rid
"""
