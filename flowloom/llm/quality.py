"""Quality rules (native): a short-circuit cascade, ordered by rejection per cost.

Each rule is a boolean expression over the text and its base measures. On a bounded sample every rule is
timed and its rejections are counted; the rules then stand in one CASE in the order of rejections per
second among what the rules before have left, so that a document pays for the later rules only while it is still kept. The order never changes a
verdict (a document is kept if no rule rejects it), only the time. What a job costs beside its rule is measured in each turn with a
rule that looks at nothing; medians over turns count by powers of four, so that the order doesn't hang on noise.

All work on a document stays inside its row: no shuffle, no explode. Repeated 5-word windows are looked for
with a hash set over 64-bit window hashes first, and only documents with repeats sort their windows.
"""

from __future__ import annotations

import math
import time
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import GAP, materialize, table

WINDOW = 5
#: Documents on which costs and rejection rates are estimated, about, and how often each is judged when a rule is timed.
SAMPLE_DOCS, REPEAT = 500, 16
#: Seconds by which costs are told apart at least, the factor between steps of them, and how often each rule is timed.
RESOLUTION, STEPS, TURNS = 0.1, 4.0, 5


def let(value: Column, use) -> Column:
    """use(value), with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def repeat_words(hashes: Column) -> Column:
    """Words inside a window of 5 words that occurs at least twice, from an array of word hashes."""
    zero = F.lit(0).cast("long")

    def covered(windows):
        tagged = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))

        def count(s):
            twice = F.filter(s, lambda e, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["x"] == e["x"])) | ((j + 1 < F.size(s)) & (s[F.least(j + 1, F.size(s) - 1)]["x"] == e["x"])))
            at = F.array_sort(F.transform(twice, lambda e: e["i"]))
            start = F.struct(zero.alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
            return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), zero).otherwise(let(tagged, count))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))
    return F.when(F.size(hashes) < WINDOW, zero).otherwise(let(windows, covered))


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to docs(text, ...)."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("_h", F.transform(F.filter(F.split("text", GAP, -1), lambda w: w != ""), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        *[c for c in docs.columns if c != "_h"],
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """True where a rule rejects. They need the columns of measures()."""
    n = F.col("n_words")
    return {
        "symbols": F.col("n_symbols") * 10 > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "dup_lines": F.col("n_dup_lines") * 2 > F.size(F.split("text", "\n", -1)),
        "letterless": F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])")) * 10 > n * 4,
        "shouting": F.regexp_count("text", F.lit("!")) * 2 > n,
        "bullets": F.regexp_count("text", F.lit(r"(?m)^[-*\u2022]")) * 10 > F.size(F.split("text", "\n", -1)) * 9,
        "ellipses": F.regexp_count("text", F.lit(r"(?m)(\.\.\.|\u2026)$")) * 10 > F.size(F.split("text", "\n", -1)) * 3,
        "capitals": F.regexp_count("text", F.lit(r"\p{Lu}")) * 5 > F.col("word_chars") * 2,
    }


def costs(measured_sample: DataFrame, found: dict[str, Column]) -> dict[str, float]:
    """Seconds that each rule takes on the sample beside an empty job: medians over turns in which every rule is timed once, after one turn to warm up."""
    often = measured_sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def timed(rejects: Column) -> float:
        began = time.perf_counter()
        often.agg(F.coalesce(F.sum((rejects & (F.col("_turn") > 0)).cast("long")), F.lit(0))).first()
        return time.perf_counter() - began

    took: dict[str, list[float]] = {name: [] for name in found}
    for turn in range(TURNS + 1):
        empty = timed(F.col("n_words") < 0)
        for name, rejects in found.items():
            net = timed(rejects) - empty
            if turn:
                took[name].append(net)
    return {name: median(seconds) for name, seconds in took.items()}


def order_rules(measured_sample: DataFrame, found: dict[str, Column]) -> list[str]:
    """Names in the order of the cascade: each time the rule with the most rejections per second among the documents that no earlier rule rejects.

    Ties go to the rule with more rejections per second among all, then by name.
    """
    cost = {name: STEPS ** round(math.log(max(seconds, RESOLUTION), STEPS)) for name, seconds in costs(measured_sample, found).items()}
    names = sorted(found)
    seen = measured_sample.select(*[F.coalesce(found[k], F.lit(False)).alias(k) for k in names]).groupBy(names).count().collect()  # one row for each document of the sample at most
    left, order = [({k for k in names if r[k]}, r["count"]) for r in seen], []
    whole = left
    while len(order) < len(names):
        value = lambda k, rows: sum(n for hit, n in rows if k in hit) / cost[k]
        best = min((k for k in names if k not in order), key=lambda k: (-value(k, left), -value(k, whole), k))  # noqa: B023
        order.append(best)
        left = [(hit, n) for hit, n in left if best not in hit]
    return order


def judge(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the measures, base_failed, kept; one row per input row.

    Null or blank texts have no words and fail the base rule. The sample holds about `sample_docs` rows; rules of one value stand by
    name. Repeated rows are judged alike, an empty table gives no rows, other columns are ignored. A very long text is judged whole
    inside its row.
    """
    docs = docs.select("doc_id", "text")
    n = docs.count()
    measured = measures(docs)
    found = rules()
    sample = materialize(measures(docs.sample(fraction=min(1.0, sample_docs / max(n, 1)), seed=11)))
    verdict = F.lit(True)
    for name in reversed(order_rules(sample, found)):
        verdict = F.when(found[name], False).otherwise(verdict)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, False).otherwise(verdict).alias("kept"),
    )


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win),
gaps AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(i - p, 5))) AS n FROM gaps GROUP BY rid),
m AS (
  SELECT w.doc_id, w.text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(w.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(w.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_letterless,
    len(regexp_extract_all(w.text, '!')) AS n_shouts, len(regexp_extract_all(w.text, '\p{Lu}')) AS n_capitals,
    len(string_split(w.text, chr(10))) AS n_lines, len(regexp_extract_all(w.text, '(?m)^[-*\x{2022}]')) AS n_bullets,
    len(regexp_extract_all(w.text, '(?m)(\.\.\.|\x{2026})$')) AS n_ellipses
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR n_dup_lines * 2 > n_lines OR n_letterless * 10 > n_words * 4 OR n_shouts * 2 > n_words
    OR n_bullets * 10 > n_lines * 9 OR n_ellipses * 10 > n_lines * 3
    OR n_capitals * 5 > word_chars * 2) AS kept
FROM b
"""
