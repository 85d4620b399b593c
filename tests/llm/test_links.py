"""Links of later rounds are joined to the components found before."""

import random

from flowloom.llm import jaccard
from flowloom.operators import graph


def test_components_grow_by_new_links(spark):
    """As components() of all links at once: new ids, joined components, links inside one, chains over several, none at all."""
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(240)]
    rows = lambda part: spark.createDataFrame(part, "a long, b long")
    found = lambda t: {r["id"]: r["component"] for r in t.collect()}
    for cut in (0, 120, 239, 240):
        label = graph.grown(graph.components(rows(links[:cut])), rows(links[cut:]))
        assert found(label) == found(graph.components(rows(links)))
        assert label.count() == label.select("id").distinct().count()


def test_each_link_is_gone_through_once(spark, monkeypatch):
    """However many rounds a large group of near copies takes, its components are searched for over as many links as were verified."""
    rng, base = random.Random(5), [f"w{i}" for i in range(400)]
    held = {}
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(400), rng.choice((1, 3, 6, 9))):
            words[at] = f"x{rng.randrange(10**6)}"
        held[i] = " ".join(words)
    verified, gone, overlaps, components = [], [], jaccard.overlaps, graph.components

    def verifying(*args):
        verified.append((found := overlaps(*args)).count())
        return found

    def going(links):
        gone.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard, "overlaps", verifying)
    monkeypatch.setattr(jaccard, "components", going)
    monkeypatch.setattr(graph, "components", going)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    jaccard.join(spark.createDataFrame(list(held.items()), "doc_id long, text string"))
    assert len(gone) > 1 and verified[0] > 0 and sum(gone) <= sum(verified)
