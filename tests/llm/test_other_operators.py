"""Top-k search and url filter against brute force; the pipeline stage by stage."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.llm.cover_tree import CoverTree, dual_search, exact_top_k
from quillon.llm.url_filter import RULES, url_filter


def brute_top_k(data, k=10):
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v)]
    out = set()
    for i in {i for i, _ in good if i % 100 == 0}:
        q = next(v for j, v in good if j == i)
        best = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    data += [(1000 + i, data[5][1]) for i in range(15)]  # ties
    data += [(800, None), (801, [1.0, None] * 4), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (None, [0.0] * 8), (804, [])]
    df = spark.createDataFrame([(*r, 1, 1) for r in data], "vec_id long, embedding array<float>, score int, rank int")
    for options in ({}, {"query_block": 3, "block": 100}):
        assert {tuple(r) for r in exact_top_k(df, **options).collect()} == brute_top_k(data)
    assert exact_top_k(df.limit(0)).count() == 0
    assert exact_top_k(df.where("vec_id in (100)")).count() == 0


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(size=(200, 3)) for c in rng.normal(size=(10, 3)) * 50])
    tree = CoverTree(np.floor(x * 16))
    for lo, hi, c, r in zip(tree.lo, tree.hi, tree.centre, tree.radius, strict=True):
        assert np.sqrt(((tree.x[tree.order[lo:hi]] - tree.x[c]) ** 2).sum(1)).max() <= r + 1e-9
    best = dual_search(tree.x[:40], np.arange(40), tree.x, np.arange(len(x)), 5)
    scores = (tree.x[:40] @ tree.x.T).astype(int)
    for i in range(40):
        want = sorted((-scores[i, j], j) for j in range(len(x)) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)] == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (7, 7)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:stop]


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    hosts = ["a.example.org", "example.org", "xexample.org", "b.com", "C.COM", "d.net", "com", "adorg"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(3000)}{rng.choice(['', '/', '.html', '?q=1', '#top'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "http://", "http://x.org", "http://X.ORG?a=/b", "ftp://e.com#/fr/", "http://e.com/fr/", "a://b://c/d", "http://ÀB.com/de/x", "http://e.com/de"] * 2
    return spark.createDataFrame([(i, u, "html", "h") for i, u in enumerate(urls)] + [(None, "http://n.org/", "x", "y")], "page_id long, url string, host string, segs string")


def test_url_filter(pages):
    out = url_filter(pages, RULES).collect()
    data = pages.select("page_id", "url").collect()
    want = collections.Counter((r.page_id, *host_path(r.url), rule(*host_path(r.url))[0]) for r in data)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in out) == want
    for r in out:
        if r.rule is not None:
            assert r.verdict == rule(r.host, r.path)[1]
        assert r.verdict in ("allow", "block")
    assert url_filter(pages.limit(0), RULES).count() == 0


def test_url_templates(spark):
    """A host whose labelled urls of one branch are blocked loses its unlabelled urls of that branch only."""
    rows = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}", None if i % 5 == 0 else i % 2 == 0) for i in range(400)]
    rows += [(1000 + i, f"http://g.net/u{chr(97 + i % 26)}{chr(97 + i // 26)}/x", True) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, ok boolean")
    out = {r.page_id: r for r in url_filter(df, [], label=F.col("ok")).collect()}
    assert all(out[i].verdict == ("block" if i % 2 else "allow") for i in range(400))
    assert out[1000].template == "*/x" and out[0].template == "good/{n}"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hard = docs.limit(40).union(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, "word " * 3000, None, None, None)], docs.schema)).union(docs.limit(2))
    hard = hard.withColumn("n_removed", F.lit(1)).withColumn("node", F.lit("x"))
    for at in (hard, hard.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, sf)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == hard.columns
            out.write.parquet(path := f"{tmp_path}/{at is hard}{i}{random.random()}")
            at = spark.read.parquet(path)
    assert at.columns == ["doc_id", "n_tokens", "ids"]
