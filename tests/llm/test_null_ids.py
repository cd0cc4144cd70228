"""Near copies among rows without a doc_id."""

import random

from quillon.llm.jaccard_join import ngram_jaccard_join


def test_classes_without_any_doc_id_link_and_bridge(spark):
    words = [f"w{i}" for i in range(120)]
    bridge = list(words)
    bridge[10] = "x"
    far = list(bridge)
    far[100] = "y"
    rng = random.Random(8)
    other = [" ".join(f"o{rng.randrange(500)}" for _ in range(60)) for _ in range(20)]
    lonely = [" ".join([*other[0].split()[:58], "z", str(i)]) for i in range(2)]
    rows = [(5, " ".join(words)), (9, " ".join(far)), (None, " ".join(bridge)), (None, " ".join(bridge)), (None, lonely[0]), (None, lonely[1]), *((20 + i, t) for i, t in enumerate(other[1:]))]
    out = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 90, 100).collect()
    got = {r.doc_id: (r.component_id, r.n_links) for r in out if r.doc_id in (5, 9)}
    assert got == {5: (5, 1), 9: (5, 1)}  # linked only through the row without an id
    assert sorted((r.component_id or 0, r.n_links) for r in out if r.doc_id is None) == [(0, 1), (0, 1), (5, 2), (5, 2)]
