"""Near words of toxic terms: which of them are hits, and which are common words."""

import random

import numpy as np

from quillon.llm.toxicity import Automaton, toxicity_scores


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_stem(w, s):
    """A beginning of w is s with an edit before its last letter."""
    return any(w[i] == s[-1] and within_one(w[:i], s[:-1]) for i in range(len(w)))


def test_stems_and_inflections_accept_an_edit():
    terms, stem, under = ["moron"], "idiot", ["idioten", "idiotic"]
    auto = Automaton(terms, [stem], {*terms, stem, *under}, dict.fromkeys(under, stem), frozenset(["oron"]))
    rng = random.Random(6)
    words = {"oron", *("".join(rng.choice("idotmrnec") for _ in range(rng.randint(1, 9))) for _ in range(3000))}
    for t in [*terms, stem, *under, "idiotisch"]:
        for i in range(len(t) + 1):
            words |= {t[:i] + t[i + 1 :], *(t[:i] + c + t[i:] for c in "xio"), *(t[:i] + c + t[i + 1 :] for c in "zmo")}
    words = sorted(w for w in words if w)
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    _, _, _, found, states = auto.hits(points, np.array([0, len(points)]))
    got = {i: (k, t) for i, k, t in zip(found.tolist(), auto.final[states].tolist(), auto.term[states].tolist(), strict=True)}
    for i, w in enumerate(words):
        moron, idiot = within_one(w, "moron"), near_stem(w, stem) or any(within_one(w, u) for u in under)
        want = 1 if w in terms or w.startswith(stem) else 2 if w != "oron" and (moron or idiot) else 0
        assert got.get(i, (0, -1))[0] == want, w
        if want:
            assert got[i][1] == (1 if idiot or w.startswith(stem) else 0), w


def test_a_common_near_word_does_not_switch_off_misspellings(spark):
    rng = random.Random(7)
    plain = ["the", "and", "river", "stone", "green", "walk", "house", "table", "under", "light", "oron"]

    def make(bad):
        w = [rng.choice(plain) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = "moron"
        return " ".join(w)

    data = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    extra = [(1000, "walk under the morron light and river"), (1001, "walk under the oron light and river"), (1002, "walk under the m0ron light and river")]
    d = spark.createDataFrame([x[:2] for x in data] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity_scores(d, labels, remainder=None).collect()}
    assert out[1000] == 1 and out[1001] == 0 and out[1002] == 1


def test_letters_and_punctuation_beyond_the_table():
    terms = ["坏人蛋", "바보같은놈"]
    auto = Automaton(terms, [], {"바보같은놈"})
    words = ["好", "坏人蛋", "你坏人蛋", "바보같은놈", "바보가같은놈", "𠀀", "좋은"]
    points = np.frombuffer("。".join(words).encode("utf-32-le"), np.uint32)
    start, _, _, found, states = auto.hits(points, np.array([0, len(points)]))
    assert len(start) == len(words)
    assert dict(zip(found.tolist(), auto.final[states].tolist(), strict=True)) == {1: 1, 3: 1, 4: 2}
