"""Soft-membership mixing: document rates whose expected domain tokens match targets.

A naive Bayes classifier over hashed words, fitted on a bounded sample of the rows that
carry a domain (max_training, a parameter), gives each document a posterior over domains,
its log odds divided by a power of its length so that membership stays soft.  A document
of n tokens with posterior p and rate r contributes r n p_d tokens to domain d.  The rates
minimise the squared misfit of the domain totals to their targets over r >= floor, by
projected gradient: all rates start equal and step along p . G^-1 residual, G being the
token-weighted second moment of the posteriors (D by D), then are projected to the bound.
A rate is a function of its own posterior and the residuals so far, so a worker replays the
steps from those D numbers a round; a round is one scan of the posteriors that sums D
numbers, and no rates are stored between rounds.

Edge cases: null and empty texts have no tokens, the prior as posterior and a rate like
others; a null domain trains nothing; domains beyond the max_domains largest count as one
("other", by name None); an empty table gives an empty one; targets of unknown domains are
ignored and missing ones count as 0; repeated rows are each mixed; extra columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Chunk, chunks, lean, materialize, small_batches

BITS = 14


@dataclass
class Mixture:
    """A fitted classifier and the steps of the rates."""

    domains: list[str | None]
    loglik: np.ndarray  # hashed word by domain
    prior: np.ndarray
    softness: float
    floor: float = 0.0
    start: float = 1.0
    steps: list[np.ndarray] = field(default_factory=list)

    def posteriors(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and posterior over domains, of each document."""
        buckets, bounds = word_buckets(c)
        n = np.diff(bounds)
        total = np.zeros((len(n), len(self.prior)))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(self.loglik[buckets], bounds[:-1][some], axis=0)
        z = self.prior + total / np.maximum(n, 1)[:, None] ** self.softness
        z = np.exp(z - z.max(1, keepdims=True))
        return n, z / z.sum(1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.full(len(p), self.start)
        for step in self.steps:
            r = np.maximum(self.floor, r - p @ step)
        return r


def word_buckets(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    low = Chunk(LOWER[c.data], c.off)
    start, end, bounds = low.words()
    return (low.hashes(start, end) >> np.uint64(64 - BITS)).astype(np.int64), bounds


def fit_classifier(docs: DataFrame, domain: str, max_training: int, max_domains: int, softness: float) -> Mixture:
    labelled = docs.where(F.col(domain).isNotNull()).select("doc_id", "text", F.col(domain).cast("string").alias("domain"))
    sizes = labelled.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(max_domains + 1).collect()
    names: list[str | None] = [r.domain for r in sizes[:max_domains]]
    if len(sizes) > max_domains:
        names.append(None)
    if not names:
        return Mixture([None], np.zeros((1 << BITS, 1)), np.zeros(1), softness)
    index = {d: i for i, d in enumerate(names)}
    n = labelled.count()
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_training / max(n, 1))))

    def count(batches):
        total = np.zeros((len(names) + 1, 1 << BITS), np.int64)
        for b in batches:
            where = np.array([index.get(d, len(names) - 1) for d in b.column(1).to_pylist()])
            for lo, hi, c in chunks(b.column(0)):
                buckets, bounds = word_buckets(c)
                np.add.at(total, (np.repeat(where[lo:hi], np.diff(bounds)), buckets), 1)
                np.add.at(total, (len(names), where[lo:hi]), 1)
        d, w = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(w), pa.array(total[d, w])], ["d", "w", "n"])

    counts = np.zeros((len(names) + 1, 1 << BITS))
    for r in sample.select("text", "domain").mapInArrow(lean(count), "d long, w long, n long").groupBy("d", "w").agg(F.sum("n").alias("n")).toLocalIterator():  # (domains + 1) * 2**BITS rows at most
        counts[r.d, r.w] = r.n
    words = counts[:-1].T + 0.5
    prior = np.log(counts[-1, : len(names)] + 1)
    return Mixture(names, np.log(words / words.sum(0)), prior - prior.max(), softness)


def fit_rates(posteriors: DataFrame, model: Mixture, targets: dict | None, temper: float, keep_all: bool, rounds: int, tolerance: float) -> dict:
    """Find the steps of the rates; posteriors has n_tokens and posterior.  Returns the totals and targets."""
    d = len(model.domains)

    def sums(moments: bool):
        def run(batches):
            total = np.zeros(d * d + d if moments else d)
            for b in batches:
                n, p = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, d)
                if moments:
                    total += np.concatenate([n @ p, ((p * n[:, None]).T @ p).ravel()])
                else:
                    total += (n * model.rates(p)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

        rows = posteriors.select("n_tokens", "posterior").mapInArrow(lean(run), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(d * d + d if moments else d)
        for at, value in rows:
            out[at] = value
        return out

    first = sums(True)
    have, second = first[:d], first[d:].reshape(d, d)
    tokens = have.sum()
    if tokens == 0:
        return {"have": have, "want": have, "got": have}
    share = have / tokens
    weight = np.array([(targets or {}).get(x, 0.0) for x in model.domains]) if targets else share**temper
    weight = weight / weight.sum() if weight.sum() else share
    model.start = float((have[weight > 0] / weight[weight > 0]).max() / tokens) if keep_all else 1.0
    model.floor = 1.0 if keep_all else 0.0
    want = weight * tokens * model.start
    inverse = np.linalg.pinv(second / tokens + 1e-6 * np.eye(d))
    got = have * model.start
    for _ in range(rounds):
        residual = (got - want) / tokens
        if np.abs(residual).max() <= tolerance:
            break
        model.steps.append(inverse @ residual)
        got = sums(False)
    return {"have": have, "want": want, "got": got}


def fit_mixture(docs: DataFrame, domain: str = "lang", targets: dict | None = None, temper: float = 0.7, keep_all: bool = False, max_training: int = 20_000, max_domains: int = 64, softness: float = 0.5, rounds: int = 20, tolerance: float = 1e-4) -> tuple[Mixture, DataFrame, dict]:
    """The fitted mixture, the table of doc_id, n_tokens and posterior, and the totals.

    targets: weight by domain; without them each domain's share to the power temper.
    keep_all: the total grows until no domain needs fewer tokens than it has, and every rate
    is 1 at least; else the total stays.
    """
    small_batches(docs.sparkSession)
    model = fit_classifier(docs, domain, max_training, max_domains, softness)

    def run(batches):
        for b in batches:
            for lo, hi, c in chunks(b.column(1)):
                n, p = model.posteriors(c)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n), lists], ["doc_id", "n_tokens", "posterior"])

    posteriors = materialize(docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, posterior array<double>"))
    return model, posteriors, fit_rates(posteriors, model, targets, temper, keep_all, rounds, tolerance)


def soft_mixing_rates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, posterior (by domain, largest first) and rate for each row of docs."""
    model, posteriors, _ = fit_mixture(docs, **options)
    d = len(model.domains)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.rates(b.column(2).flatten().to_numpy().reshape(-1, d)))], ["doc_id", "n_tokens", "posterior", "rate"])

    return posteriors.mapInArrow(lean(run), "doc_id long, n_tokens long, posterior array<double>, rate double")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as its rate says: the whole part, and one more by a hash of its text and id for the rest."""
    model, _, _ = fit_mixture(docs, **options)

    def run(batches):
        for b in batches:
            out = []
            for _, _, c in chunks(b.column(0)):
                out.append(model.rates(model.posteriors(c)[1]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(out) if out else np.zeros(0))], [*b.schema.names[1:], "__rate"])

    rated = docs.select(F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    schema = rated.select("__row").schema.add("__rate", "double")
    rated = rated.mapInArrow(lean(run), schema)
    draw = F.pmod(F.xxhash64("__row", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("__rate") + (draw < F.col("__rate") - F.floor("__rate")).cast("long")
    return rated.withColumn("__n", times).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select("__row.*")
