"""Quality rules with risk-controlled cutoffs.

Each rule is a ratio of document statistics; a document is rejected when the ratio
lies beyond the rule's cutoff for the document's stratum (a band of lengths).  Cutoffs
come from a grid.  For every (stratum, rule, grid point) one distributed aggregation
counts how many labelled good documents the cutoff rejects.  Each rule is tested in each
stratum from its loosest cutoff on: a cutoff passes while the exact one-sided binomial
(Clopper-Pearson) upper bound of its false-rejection rate, at level delta / (strata *
rules), stays within max_false_rejection / rules; testing stops at the first failure, so
the grid costs no further correction (fixed-sequence testing) and Bonferroni covers
strata and rules.  So with probability 1 - delta, in all strata at once, the rules
together reject at most max_false_rejection of the good documents.  Where too few labels exist
to prove a cutoff, the rule rejects nothing in that stratum.

Nulls and edge cases: null text counts as empty; rows with null doc_id are kept as rows
and match no label; null quality is no label; repeated rows each get a row; labels that
repeat a doc_id are each counted; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize
from quillon.llm.docstats import document_statistics

#: rule -> (statistic, base statistic, grid of cutoffs in units of the ratio); beyond the cutoff means rejected
GRID = [0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.65, 0.8]
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_upper", "word_chars"),
    "bangs": ("n_bang", "n_words"),
    "same_next": ("n_same_next", "n_words"),
}
#: Upper ends of the bands of n_words that are the strata.
BANDS = [100, 400]


def ratio(rule: str) -> Column:
    a, b = RULES[rule]
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def band() -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(F.col("n_words") < BANDS[i], i).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction: a number of steps about the root of a + b at most."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or tiny), 1 + t / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the p at which P(X <= k) = alpha for X binomial(n, p); 1 if k = n."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_share(1 - mid, n - k, k + 1) > alpha else (lo, mid)
    return hi


def select_cutoffs(counts: dict[int, dict], max_false_rejection: float, delta: float) -> dict[tuple[int, str], float]:
    """counts: stratum -> {"n": good documents, (rule, i): good ones beyond GRID[i]}."""
    alpha, each = delta / max(1, len(counts) * len(RULES)), max_false_rejection / len(RULES)
    out = {}
    for stratum, c in counts.items():
        for rule in RULES:
            for i in reversed(range(len(GRID))):  # the smallest cutoff rejects most
                k = c[rule, i]
                if k > each * c["n"] or upper_bound(k, c["n"], alpha) > each:
                    break
                out[stratum, rule] = GRID[i]
    return out


def fit_cutoffs(stats: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule); all labelled rows count, as a histogram of how many cutoffs of the grid a document exceeds."""
    good = stats.join(labels.where("quality = 1 and doc_id is not null").select("doc_id"), "doc_id").where(~base_failed())
    grid = F.array(*(F.lit(x) for x in GRID))

    def level(rule: str) -> Column:
        return F.size(F.filter(grid, lambda cut: ratio(rule) > cut))

    levels = [F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES]
    each = good.select(band().alias("stratum"), F.explode(F.array(*levels)).alias("x")).groupBy("stratum", "x.rule", "x.level").agg(F.count("*").alias("n"))
    counts: dict[int, dict] = {}
    for x in each.collect():  # strata * rules * (cutoffs + 1) rows at most
        c = counts.setdefault(x["stratum"], {"n": 0} | {(r, i): 0 for r in RULES for i in range(len(GRID))})
        c["n"] += x["n"] if x["rule"] == next(iter(RULES)) else 0
        for i in range(x["level"]):
            c[x["rule"], i] += x["n"]
    return select_cutoffs(counts, max_false_rejection, delta)


def rejected(cutoffs: dict[tuple[int, str], float]) -> Column:
    out = F.lit(False)
    for (stratum, rule), cut in sorted(cutoffs.items()):
        out = out | ((band() == stratum) & (ratio(rule) > cut))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Statistics, base_failed, kept and the method's verdict for each row of docs.

    docs: doc_id, text.  labels: doc_id, quality (1 good).
    """
    stats = materialize(document_statistics(docs))
    cutoffs = fit_cutoffs(stats, labels, max_false_rejection, delta)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule_failed", rejected(cutoffs)).withColumn("kept", ~F.col("base_failed") & ~F.col("rule_failed"))
