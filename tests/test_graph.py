"""Connected components in rounds and in one task."""

import random

import pytest

from flowloom.operators import graph


@pytest.mark.parametrize("most", [-1, 20_000])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "IN_TASK", most)
    rng = random.Random(5)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)] + [(i, i + 1) for i in range(100, 112)] + [(7, 7), (101, 100)]
    least = {i: i for a, b in links if a != b for i in (a, b)}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(least) and {r["id"]: r["component"] for r in got} == least
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_few_links_take_no_rounds(spark, monkeypatch):
    """A chain of 60 ids is two tables, not two for each round."""
    written = []
    monkeypatch.setattr(graph, "settle", lambda df, f=graph.settle: written.append(1) or f(df))
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    assert {r["component"] for r in got.collect()} == {0} and len(written) == 2
