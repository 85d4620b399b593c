"""What the near-copy join and the pipeline's stages leave on disk and shuffle."""

import os

from flowloom.llm import jaccard
from flowloom.operators.store import shared_dir


def test_join_leaves_only_its_result(spark, sf):
    """Tables of steps are deleted, and the result is a table of its own."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = jaccard.join(docs)
    assert len(set(os.listdir(folder)) - before) == 1 and found.count() == docs.count()


def test_stages_shuffle_texts_once(spark, sf):
    """One exchange by the key; the mix has one more for its order."""
    import corpus_pipeline

    docs, was = spark.read.parquet(f"{sf}/documents.parquet"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage, most in ((corpus_pipeline.near_copies, 1), (corpus_pipeline.mixture, 2)):
            plan = stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            sides, at = [], None
            for i, line in enumerate(lines):  # the texts' side of the join lies above the table's
                if "FileScan parquet" in line and "text#" in line:
                    at = i
                    break
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            low = depth(lines[at])
            for line in reversed(lines[:at]):
                if depth(line) < low:
                    low = depth(line)
                    sides.append(line)
            assert sum(" Exchange " in f" {line.lstrip(' :+-')}" for line in sides) == most, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
