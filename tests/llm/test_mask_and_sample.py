"""Masks of many spans, and the bound of the language sample."""

import random
import time

from pyspark.sql import functions as F

from flowloom.llm import langid, secrets

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def masked(text, spans):
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_masks_by_brute_force(spark, monkeypatch):
    """Small stretches and runs, so that spans and gaps cross them; overlaps, equal starts, spans at both ends, characters beyond the first plane."""
    monkeypatch.setattr(secrets, "CUT", 8)
    monkeypatch.setattr(secrets, "PART", 3)
    rng = random.Random(1)
    rows = [("", []), ("abc", []), (None, []), ("abc", [(0, 0, 3)]), ("é🙂" * 8, [(0, 0, 1), (15, 1, 16)]), ("x" * 16, [(8, 0, 16)])]
    for _ in range(120):
        text = "".join(rng.choice("abé🙂\n ") for _ in range(rng.randint(1, 70)))
        cuts = [sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randint(0, 12))] if len(text) > 1 else []
        rows.append((text, sorted((a, k, b) for k, (a, b) in enumerate(cuts))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, text string, spans {SPAN}")
    got = {r["i"]: r["m"] for r in df.select("i", secrets.mask(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {i: masked(t, s) if s else t for i, (t, s) in enumerate(rows)}


def test_masks_of_many_spans_take_linear_time(spark):
    """50,000 spans in one text of 2 million characters that aren't ASCII."""
    text = "é" + "password=abcdef1234 and some wörds… " * 50_000
    n = len(text) // 50_000
    spans = [(1 + n * i + 9, 0, 1 + n * i + 19) for i in range(50_000)]
    df = spark.createDataFrame([(text, spans)], f"text string, spans {SPAN}")
    began = time.perf_counter()
    got = df.select(secrets.mask(F.col("text"), F.col("spans")).alias("m")).first()["m"]
    assert got == masked(text, spans) and time.perf_counter() - began < 60


def test_sample_is_bounded(spark, monkeypatch):
    """3,000 rows of one id, equal rows, and one huge text: no more than the documents and chains asked for reach the driver, and rare languages are whole."""
    rows = [(7, f"the thing number {i} is here", "en") for i in range(3000)] + [(8, "ein Satz für sich", "de")] * 2000 + [(i, f"noch ein Satz {i} und mehr", "de") for i in range(20, 30)] + [(9, "mot " * 60_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(langid.remainder() != 0)
    held = []
    monkeypatch.setattr(langid, "fit", lambda rows: held.append(rows))
    langid.learn(df, 120, 300)
    count = {lang: sum(r[0] == lang for r in held[0]) for lang in ("en", "de", "fr")}
    distinct = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.countDistinct("doc_id", "text").alias("n")).collect()}
    assert count["en"] == 120 and count["de"] == distinct["de"] and count["fr"] == (300 if "fr" in distinct else 0)
    again = []
    monkeypatch.setattr(langid, "fit", lambda rows: again.append(rows))
    langid.learn(df.repartition(5), 120, 300)
    assert again == held


def test_merges_in_the_row(spark, sf):
    """The higher-order form of byte-level BPE gives the ids of the Arrow form."""
    import struct

    from flowloom.llm import bpe, bpe_rows

    path, pattern = bpe.vocabulary()
    odd = [None, "", " ", "it's 12 o'clock\n\n  ok ", "Größe 漢字 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaa", "x y\u0085z  ", "the the the"]
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 400").select("text").limit(40)
    df = spark.createDataFrame([(t,) for t in odd], "text string").union(texts).withColumn("ids", F.lit("x")).withColumn("i", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    want = {r["i"]: list(struct.unpack(f"<{len(r['ids']) // 4}I", bytes(r["ids"]))) for r in bpe.encode(df, path, pattern).collect()}
    got = {r["i"]: r["ids"] for r in bpe_rows.encode_in_row(df, path, pattern).collect()}
    assert got == want and bpe_rows.encode_in_row(df.limit(0), path, pattern).count() == 0


def test_rules_count_what_earlier_ones_leave(spark):
    """Of two rules as cheap, the one that rejects what the first has left goes before the one that rejects more, but the same again."""
    from flowloom.llm import quality

    sample = quality.measures(spark.createDataFrame([(i, "some words " * 30) for i in range(100)], "doc_id long, text string"))
    found = {"a": F.col("doc_id") < 50, "b": F.col("doc_id") < 60, "c": (F.col("doc_id") >= 60) & (F.col("doc_id") < 65), "d": F.col("doc_id") == 99}
    assert quality.order_rules(sample, found) == ["b", "c", "d", "a"]


def test_pipeline_mixes_in_order_of_slots(spark, sf):
    """As many readings as the mix of these documents has, each at the slot in which it begins."""
    import corpus_pipeline
    from flowloom.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read = [r["doc_id"] for r in corpus_pipeline.mixture(spark, docs, sf).select("doc_id").collect()]
    more = F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source")
    keyed = docs.withColumn("doc_id", corpus_pipeline.identity(*more))
    taken = mixing.mix(keyed).where("taken > 0").select(F.ceil(F.col("taken") / F.col("size")).alias("n"))
    plan = mixing.mix_schedule(mixing.sized_documents(keyed)).where("word_from = 0 AND word_to > 0").orderBy("slot", "start").select("doc_id.id").collect()
    assert len(read) == taken.agg(F.sum("n")).first()[0] and read == [r["id"] for r in plan]
