"""A corpus pipeline of five stages over `documents`: language, near copies, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import bpe, jaccard, langid, mixing, secrets
from flowloom.llm.common import materialize, table
from flowloom.operators.store import mark, sweep

#: A document stays if the mean marginal of its language is at least this.
SURE = 0.4
#: Words of a shingle and similarity in hundredths of near copies here; op10 has its own.
WORDS, PERCENT = 5, 80
#: Columns inside a stage. Documents may have columns of any other name.
KEY, TURNS, SPANS = "_document", "_turns", "_spans"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, no letter) or whose words agree on none.

    Every other row stays as it is, repeated ones too; a very long text is labelled whole; an empty table gives no rows, and so does one without
    labels to learn from.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]  # so that nothing of theirs is replaced
    found = langid.predict(docs.toDF(*names), langid.learn(docs.select("doc_id", "text", "lang")), names[docs.columns.index("text")])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(names).toDF(*docs.columns)


def identity(*more: Column) -> Column:
    """What makes a row a document: its id (or that it has none) and its text; a struct without nulls."""
    return F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), jaccard.text_hash().alias("h"), *more)


def typed(docs: DataFrame, other: DataFrame) -> DataFrame:
    """docs with the KEY in the type that a table has it in (read back, its fields may be null): else a join casts it, and the texts are shuffled twice."""
    return docs.withColumn(KEY, F.col(KEY).cast(other.schema[KEY].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Documents that share an id, or have none, are told apart by their texts. Rows that repeat a document, and documents
    without words, stay once for each id and text. Very long texts are rows like others; an empty table gives no rows.
    """
    found = jaccard.join(docs, percent=PERCENT, words=WORDS).withColumn("document", F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), "h"))
    groups = found.where("n_shingles > 0").groupBy("component").agg(F.min("document").alias("document")).select("document")
    wanted = groups.union(found.where("n_shingles = 0").select("document")).distinct()
    wanted = wanted.select(F.struct("document.id", "document.no_id", "document.h").alias(KEY))
    return typed(docs.withColumn(KEY, identity()), wanted).join(wanted, KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret and every linked part of a credential by a mask.

    Null texts stay null, rows that repeat a document are masked alike, a very long text is masked whole in linear time; an empty table gives no
    rows.
    """
    held = F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), "h")
    found = secrets.scan(docs).where(F.size("spans") > 0).select(held.alias(KEY), F.col("spans").alias(SPANS)).dropDuplicates([KEY])
    joined = docs.withColumn(KEY, identity()).join(found, KEY, "left")
    masked = secrets.mask(F.col("text"), F.col(SPANS))
    masked = F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(masked)
    joined = joined.withColumn("text", masked)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it, in the order of the schedule: whole turns, and once more for a part of one.

    A reading stands at the slot in which it begins. Rows that repeat a document (id, source and text) give it the turns of all of them together.
    Documents without words are not read; a very long text spans many slots and is read as one row; an empty table gives no rows.
    """
    since = mark()
    keyed = docs.withColumn(KEY, identity(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source")))
    plan = mixing.mix_schedule(mixing.sized_documents(keyed.select(F.col(KEY).alias("doc_id"), "source", "text")))
    begins = materialize(plan.where("word_from = 0 AND word_to > 0").select(F.col("doc_id").alias(KEY), F.struct("slot", "start").alias(TURNS)))
    sweep(spark, since, begins)  # the schedule's tables and shuffles are gone before the texts are shuffled
    return typed(keyed, begins).dropDuplicates([KEY]).join(begins, KEY).orderBy(TURNS).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and their number beside the documents' columns.

    A null text has none; very long texts are encoded whole; an empty table gives no rows. Columns named ids or n_tokens are replaced.
    """
    path, pattern = bpe.vocabulary()
    return bpe.encode(docs, path, pattern).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", without_secrets),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: Clustering by similarity and a fitted field can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
