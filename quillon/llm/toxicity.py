"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

Lexicon.  From a bounded sample of the labelled training rows (max_training, a
parameter) whole words and word beginnings are counted by label; those with enough
support and smoothed purity become terms, a beginning only where several words share it.
The words under a beginning stay as its inflections.

Automaton.  The terms form a trie.  Its intersection with the Levenshtein automata of
distance 1 (insertions, deletions, substitutions; only for terms and inflections of
min_fuzzy letters or more; in a beginning before its last letter, as the words under it
go on freely) is determinised into one transition table over character classes.  All
words of a batch walk the table side by side, a step a character; words that reach the
dead state leave at once.  Near words of a term that clean documents have are no hits,
those of the cleanest evidence first, until the rest is in at most a share max_near of
the clean sample; other misspellings of that term stay hits.

Context.  Each hit looks at the words around it: inside quotation marks or beside a
reporting word it counts as quotation, else as abuse, and a second-person word beside it
as address.  The counts of these kinds give the score by a logistic model, fitted to the
sample with a Gaussian prior on its weights, so kinds absent from the sample keep
sensible weights.

Edge cases: null and empty texts have no hits and get the score of such documents; with
no toxic training rows the lexicon is empty and every score is a smoothed base rate below 0.1;
null labels and doc_ids train nothing; repeated rows are each scored; other columns pass
unread.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Chunk, chunks, lean, materialize, small_batches
from quillon.llm.quality_classifier import held_out

# Words that mark quotation or report, and words of address.
REPORTING = frozenset("said says wrote writes quoted quote quotes called calls reported reports word term sagte schrieb zitat zitiert nannte dit écrit citation cité appelé dijo escribió cita citó llamó".split())
ADDRESS = frozenset("you your you're u du dich dir dein deine ihr euch tu te toi vous votre ton tú usted vosotros ustedes tus".split())
OPENING, CLOSING = "\"“„«‹‘>", "\"”“»›’"
WINDOW = 6
N_KINDS = 5
#: Prior means of the logistic weights: bias, abusive exact, abusive fuzzy, quoted, addressed, share of words.
PRIOR = np.array([-5.0, 7.0, 5.0, 1.0, 1.0, 1.0])
WORD = re.compile(r"[^\W_]+")


class Automaton:
    """Deterministic table of the lexicon within distance 1.  State 0 is dead, 1 the start.

    final[state]: 0 none, 1 exact term or beginning, 2 within distance 1; term[state]: its place in words + stems.
    fuzzy: the words, stems and inflections that allow an edit; under: inflection -> its stem; clean: near words that are no hits.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy: set[str], under: dict[str, str] | None = None, clean: frozenset[str] = frozenset()):
        kids: list[dict[str, int]] = [{}]
        under, self.clean = {w: s for w, s in (under or {}).items() if w in fuzzy}, clean
        place = {s: len(words) + i for i, s in enumerate(stems)}
        whole, stem, far, name, near_end = set(), {}, {}, {}, {}
        for term, marks in [*((w, whole) for w in words), *((s, stem) for s in stems), *((w, under) for w in under)]:
            node = 0
            for ch in term:
                if ch not in kids[node]:
                    kids.append({})
                    kids[node][ch] = len(kids) - 1
                node = kids[node][ch]
                if term in fuzzy:
                    far[node] = True  # lies on a path of a term that allows an edit
            if marks is whole:
                whole.add(node)
                name[node] = words.index(term)
                if term in fuzzy:
                    near_end[node] = name[node]
            elif marks is stem:
                stem[node] = term
            else:
                near_end[node] = place[under[term]]
        letters = sorted({ch for k in kids for ch in k})
        self.classes = {ch: i + 1 for i, ch in enumerate(letters)}  # class 0: any other letter
        loose = {n: place[s] for n, s in stem.items() if s in fuzzy}

        def close(states: set[tuple[int, int]]) -> frozenset:
            out, todo = set(states), [s for s in states if s[1] == 0]
            for node, _ in todo:  # a letter of the term left out
                out.update((k, 1) for k in kids[node].values() if k in far)
            return frozenset(out)

        start = close({(0, 0)})
        index, order, rows, final, term_of = {start: 1}, [start], [], [0, 0], [-1, -1]
        at = 0
        while at < len(order):
            now = order[at]
            at += 1
            row = []
            for ch in [None, *letters]:
                nxt: set[tuple[int, int]] = set()
                hit = False
                for node, e in now:
                    if node < 0:  # a beginning within distance 1, whatever follows
                        nxt.add((node, 1))
                        continue
                    if ch in kids[node] and (e == 0 or kids[node][ch] in far):
                        k = kids[node][ch]
                        hit |= e == 0 and k in stem
                        if e == 0 and k in stem:
                            reached = stems.index(stem[k])
                        nxt.add((k, e))
                        if e == 1 and k in loose:
                            nxt.add((-1 - loose[k], 1))
                    if e == 0:
                        if node in far or node == 0:
                            nxt.add((node, 1))  # a letter too many
                        nxt.update((k, 1) for c, k in kids[node].items() if c != ch and k in far)  # another letter
                if hit:
                    row.append(-1 - reached)
                    continue
                most = max((n for n, _ in nxt if n < 0), default=0)
                nxt_ = close({(n, e) for n, e in nxt if n >= 0 or n == most})
                if not nxt_:
                    row.append(0)
                    continue
                if nxt_ not in index:
                    index[nxt_] = len(order) + 1
                    order.append(nxt_)
                    near = min((-1 - n if n < 0 else near_end[n] for n, e in nxt_ if e == 1 and (n < 0 or n in near_end)), default=-1)
                    exact = min((name[n] for n, e in nxt_ if e == 0 and n in whole), default=-1)
                    final.append(1 if exact >= 0 else 2 if near >= 0 else 0)
                    term_of.append(exact if exact >= 0 else near)
                row.append(index[nxt_])
            rows.append(row)
        absorb = len(order) + 1  # and on, a state a beginning
        table = np.zeros((absorb + len(stems), len(letters) + 1), np.int32)
        table[1:absorb] = np.where(np.array(rows) < 0, absorb - 1 - np.array(rows), np.array(rows))
        table[absorb:] = np.arange(absorb, len(table))[:, None]
        self.table, self.final, self.term = table, np.array([*final, *[1] * len(stems)], np.int8), np.array([*term_of, *range(len(words), len(words) + len(stems))])
        # code point -> class; -1 separates words
        self.code = np.array([self.class_of(i) for i in range(0x3000)], np.int16)

    def class_of(self, point: int) -> int:
        ch = chr(point)
        return self.classes.get(ch.lower(), 0) if ch.isalnum() else -1

    def hits(self, points: np.ndarray, bounds: np.ndarray):
        """Word starts, ends, word bounds of documents, the hit words and their final states."""
        cls = self.code[np.minimum(points, 0x2FFF)]
        high = np.flatnonzero(points >= 0x3000)
        if len(high):  # beyond the table, each different one once
            kinds, at = np.unique(points[high], return_inverse=True)
            cls[high] = np.array([self.class_of(x) for x in kinds.tolist()], np.int16)[at]
        solid = np.zeros(len(points) + 1, bool)
        solid[:-1] = cls >= 0
        edge = np.zeros(len(points) + 1, bool)
        edge[bounds] = True
        before = np.zeros_like(solid)
        before[1:] = solid[:-1]
        start, end = np.flatnonzero(solid & (~before | edge)), np.flatnonzero(before & (~solid | edge))
        live, state, at = np.arange(len(start)), np.ones(len(start), np.int32), start.copy()
        found, kinds = [], []
        while len(live):
            state = self.table[state, cls[at]]
            at = at + 1
            over = (at == end[live]) & (state > 0)
            hit = over & (self.final[state] > 0)
            found.append(live[hit])
            kinds.append(state[hit])
            go = (state > 0) & ~over
            live, state, at = live[go], state[go], at[go]
        found, kinds = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, kinds))
        if self.clean:
            near = np.flatnonzero(self.final[kinds] == 2)
            keep = np.ones(len(found), bool)
            keep[near] = [word(points, start[w], end[w]) not in self.clean for w in found[near]]
            found, kinds = found[keep], kinds[keep]
        order = np.argsort(found)
        return start, end, np.searchsorted(start, bounds), found[order], kinds[order]


def word(points: np.ndarray, start: int, end: int) -> str:
    return points[start:end].tobytes().decode("utf-32-le", "replace").lower()


def context(points: np.ndarray, lo: int, start: int, end: int, hi: int) -> tuple[bool, bool]:
    """Whether the hit [start, end) is quoted, and addressed, by the text of lo..hi around it."""
    left = points[lo:start].tobytes().decode("utf-32-le", "replace").lower()
    right = points[end:hi].tobytes().decode("utf-32-le", "replace").lower()
    around = set(WORD.findall(left)) | set(WORD.findall(right))
    opened = max((left.rfind(ch) for ch in OPENING), default=-1)
    quoted = opened >= 0 and opened >= max((left.rfind(ch) for ch in CLOSING if ch not in OPENING), default=-1) and any(ch in right for ch in CLOSING)
    return quoted or not around.isdisjoint(REPORTING), not around.isdisjoint(ADDRESS)


def code_points(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the chunk, and how many of them lie before each byte."""
    return np.frombuffer(c.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])


def near_words(auto: Automaton, sample: DataFrame) -> list:
    """term, word, clean, toxic: documents of the sample by label with a word at distance 1 of the term."""

    def run(batches):
        for b in batches:
            labels = b.column(1).to_numpy()
            for lo, _, c in chunks(b.column(0)):
                points, heads = code_points(c)
                start, end, bounds, found, states = auto.hits(points, heads[c.off])
                near = auto.final[states] == 2
                owner = np.searchsorted(bounds, found[near], "right") - 1
                seen = sorted({(d, t, word(points, start[w], end[w])) for d, t, w in zip(owner.tolist(), auto.term[states[near]].tolist(), found[near].tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in seen], pa.int64()), pa.array([x[2] for x in seen], pa.string()), pa.array(labels[lo + np.array([x[0] for x in seen], np.int64)], pa.int32())], ["term", "word", "label"])

    return sample.select("text", "label").mapInArrow(lean(run), "term long, word string, label int").groupBy("term", "word").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic")).collect()  # the near words of a bounded sample


def clean_words(rows: list, most: float, bad: int, good: int) -> frozenset[str]:
    """Of each term's near words those that go, the cleanest evidence first, until the rest is in at most `most` clean documents."""
    out: set[str] = set()
    left: dict[int, float] = {}
    for r in rows:
        left[r.term] = left.get(r.term, 0) + r.clean
    for r in sorted((r for r in rows if r.clean), key=lambda r: (r.toxic / bad - r.clean / good, r.word)):
        if left[r.term] > most and r.toxic / bad <= r.clean / good:
            out.add(r.word)
            left[r.term] -= r.clean
    return frozenset(out)


def hit_counts(auto: Automaton, strength: np.ndarray, column: pa.Array):
    """Batches of rows: (first row, array of N_KINDS numbers a document); hits weigh strength[term]."""
    for lo, hi, c in chunks(column):
        points, heads = code_points(c)
        start, end, bounds, found, states = auto.hits(points, heads[c.off])
        out = np.zeros((hi - lo, N_KINDS))
        owner = np.searchsorted(bounds, found, "right") - 1
        for w, kind, d, weight in zip(found.tolist(), auto.final[states].tolist(), owner.tolist(), strength[auto.term[states]].tolist(), strict=True):
            a, b = max(int(bounds[d]), w - WINDOW), min(int(bounds[d + 1]) - 1, w + WINDOW)
            first = 0 if a == bounds[d] else int(start[a])
            last = int(end[b])
            quoted, addressed = context(points, max(first, int(heads[c.off[d]])), int(start[w]), int(end[w]), last + 1 if last < heads[c.off[d + 1]] else last)
            out[d, 2 if quoted else kind - 1] += weight
            out[d, 3] += addressed
        n = np.maximum(np.diff(bounds), 1)
        out[:, 4] = np.minimum(1, 20 * out[:, :2].sum(1) / n)
        out[:, :4] = np.minimum(np.log1p(out[:, :4]) / np.log(2), 2)
        yield lo, out


def count_terms(sample: DataFrame, longest: int = 20) -> DataFrame:
    """term, is_word, toxic and clean document counts, of the words and beginnings in sample."""

    def run(batches):
        seen: dict[tuple[str, bool], list[int]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall((text or "").lower()) if 3 <= len(w)}
                terms = {(w, True) for w in words} | {(w[:k], False) for w in words for k in range(4, min(len(w), longest) + 1)}
                for t in terms:
                    seen.setdefault(t, [0, 0])[label] += 1
            if len(seen) > 150_000:
                yield flush(seen)
                seen = {}
        yield flush(seen)

    def flush(seen):
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k][1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64())], ["term", "is_word", "toxic", "clean"])

    parts = sample.select("text", "label").mapInArrow(lean(run), "term string, is_word boolean, toxic long, clean long")
    return parts.groupBy("term", "is_word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_lexicon(rows: list, max_terms: int, bad: int, good: int) -> tuple[list[str], list[str], np.ndarray, dict[str, str]]:
    """Pure words, the shortest pure beginnings that no single word accounts for, the strength of each: log odds in fifths, and the pure words under a beginning."""
    words = {r.term: r.toxic for r in rows if r.is_word}
    stems: list[str] = []
    for r in sorted((r for r in rows if not r.is_word), key=lambda r: (len(r.term), r.term)):
        best = max((n for w, n in words.items() if w.startswith(r.term)), default=0)
        if best < 0.8 * r.toxic and not any(r.term.startswith(s) for s in stems):
            stems.append(r.term)
    keep = [w for w in sorted(words, key=lambda w: (-words[w], w)) if not any(w.startswith(s) for s in stems)]
    words_, stems_ = keep[:max_terms], stems[:max_terms]
    seen = {(r.term, r.is_word): (r.toxic, r.clean) for r in rows}
    odds = [(a + 0.5) / (bad + 1) / ((b + 0.5) / (good + 1)) for a, b in [*(seen[w, True] for w in words_), *(seen[x, False] for x in stems_)]]
    under = {w: s for w in sorted(words) for s in stems_ if w.startswith(s)}
    return words_, stems_, np.clip(np.log(odds) / 5, 0.2, 1.5), under


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.2) -> np.ndarray:
    """Newton steps for the logistic weights under a Gaussian prior about PRIOR."""
    x, w = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
    return w


def bounded_sample(labels: DataFrame, most: int) -> DataFrame:
    """About most rows at most, chosen by a hash of doc_id; all rows where there are fewer."""
    n = labels.count()
    return labels if n <= most else labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int | None = 2, threshold: float = 0.3, max_training: int = 20_000, max_terms: int = 300, purity: float = 0.8, min_fuzzy: int = 5, max_near: float = 0.0005) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text).

    labels: doc_id, toxic.  remainder None: no rows are held out.
    """
    small_batches(docs.sparkSession)
    out_of_training = held_out(modulus, -1 if remainder is None else remainder)
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~out_of_training).select("doc_id", F.col("toxic").cast("int").alias("label"))
    sample = materialize(docs.select("doc_id", "text").join(bounded_sample(known, max_training), "doc_id").select("text", "label"))
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    least = max(3, int(0.01 * bad))
    if bad:
        chosen = count_terms(sample).where((F.col("toxic") >= least) & ((F.col("toxic") + 0.1) / (F.col("toxic") + F.col("clean") + 1) >= purity))
        words, stems, strength, under = choose_lexicon(chosen.orderBy(F.desc("toxic"), "term", "is_word").limit(20 * max_terms).collect(), max_terms, bad, good)
    else:
        words, stems, strength, under = [], [], np.zeros(0), {}
    fuzzy = {w for w in [*words, *stems, *under] if len(w) >= min_fuzzy}
    auto = Automaton(words, stems, fuzzy, under)
    if fuzzy:  # near words that are common in clean documents are no hits
        auto.clean = clean_words(near_words(auto, sample), max_near * good, bad, good)

    def kinds(batches):
        for b in batches:
            for lo, x in hit_counts(auto, strength, b.column(0)):
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in x.T), b.column(1).slice(lo, len(x))], [*(f"k{i}" for i in range(N_KINDS)), "label"])

    if bad:
        schema = ", ".join(f"k{i} double" for i in range(N_KINDS)) + ", label int"
        rows = np.array(sample.mapInArrow(lean(kinds), schema).groupBy(*(f"k{i}" for i in range(N_KINDS)), "label").agg(F.count("*").alias("n")).collect(), dtype=float).reshape(-1, N_KINDS + 2)
        weights = fit_logistic(np.repeat(rows[:, :N_KINDS], rows[:, -1].astype(int), 0), np.repeat(rows[:, N_KINDS], rows[:, -1].astype(int)))
    else:
        weights = np.zeros(N_KINDS + 1)
        weights[0] = np.log(0.5 / (good + 5))

    def score(batches):
        for b in batches:
            for lo, x in hit_counts(auto, strength, b.column(1)):
                z = np.clip(weights[0] + x @ weights[1:], -30, 30)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(x)).cast(pa.int64()), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(lean(score), "doc_id long, score double")
    return out.withColumn("held_out", out_of_training).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
