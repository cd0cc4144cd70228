"""URL filter by a tree of path templates, in DataFrame functions only.

Rules (verdict, host, path) judge first: a rule fits its host and all subdomains where the
path starts with the rule's path, and the longest rule wins.  All other urls get the
verdict of their template:

1. Path segments are generalised by shape (numbers, hexadecimal ids), urls are counted by
   (host, shape), and from there on only those counts are worked with, so a host of a
   third of all urls is a handful of rows.
2. Where a node of a host's tree has many children that hold few urls each, its children
   become one wildcard.
3. Children of a node whose share of allowed urls does not differ significantly from that
   of all its children (a two-sided z test) are merged and share their counts.
4. From the root down, the purity of a node is its share of allowed labelled urls, smoothed
   by the purity of its parent with a fixed weight.  Templates below min_purity are blocked.

Labels are the verdicts of the rules, or a given column.  Edge cases: a null url, or one
without ://, has empty host and path and falls to the empty host's root; hosts without
labels fall back to the purity of all labelled urls, and with no labels at all purity is a
half and urls are allowed; repeated rows count and are judged each; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query op9.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Path segments with variable text generalised."""

    def one(s: Column) -> Column:
        return F.when(s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-fA-F-]"), "{h}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def template_verdicts(counts: DataFrame, weight: float, min_purity: float, min_children: int, max_mean: float, z: float) -> DataFrame:
    """counts: host, segs, n, allowed, labelled.  Adds template and purity."""
    levels = counts.select("*", F.posexplode("segs").alias("level", "seg")).withColumn("parent", F.slice("segs", 1, F.col("level")))
    children = levels.groupBy("host", "parent", "seg").agg(F.sum("n").alias("n"))
    varied = children.groupBy("host", "parent").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= min_children) & (F.col("n") <= max_mean * F.col("kinds")))
    marked = levels.join(varied.select("host", "parent", F.lit(True).alias("varied")), ["host", "parent"], "left")
    own = marked.groupBy("host", "segs").agg(F.array_sort(F.collect_list(F.struct("level", F.when(F.col("varied"), "*").otherwise(F.col("seg")).alias("seg")))).alias("t"))
    rows = counts.join(own.select("host", "segs", F.col("t.seg").alias("template")), ["host", "segs"], "left").withColumn("template", F.coalesce("template", F.array().cast("array<string>")))
    total = counts.agg(((F.sum("allowed") + 1) / (F.sum("labelled") + 2)).alias("root"))
    nodes = rows.select("host", "template", "allowed", "labelled", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level"))
    nodes = nodes.groupBy("host", "level", F.slice("template", 1, F.col("level")).alias("node")).agg(F.sum("allowed").alias("allowed"), F.sum("labelled").alias("labelled"))
    nodes = nodes.withColumn("up", F.when(F.col("level") > 0, F.slice("node", 1, F.col("level") - 1)))
    inner = nodes.where("level > 0")
    sums = inner.groupBy("host", "up").agg(F.sum("allowed").alias("a"), F.sum("labelled").alias("l"))
    p = F.col("a") / F.greatest(F.col("l"), F.lit(1))
    seen = F.greatest(F.col("labelled"), F.lit(1))
    near = (F.col("labelled") > 0) & (F.abs(F.col("allowed") / seen - p) <= z * F.sqrt(p * (1 - p) / seen) + 1e-9)
    judged = inner.join(sums, ["host", "up"]).withColumn("near", F.coalesce(near, F.lit(False)))
    merged = judged.where("near").groupBy("host", "up").agg(F.sum("allowed").alias("ma"), F.sum("labelled").alias("ml"))
    judged = judged.join(merged, ["host", "up"], "left").select("host", "node", F.when(F.col("near"), F.col("ma")).otherwise(F.col("allowed")).alias("allowed"), F.when(F.col("near"), F.col("ml")).otherwise(F.col("labelled")).alias("labelled"))
    known = judged.unionByName(nodes.where("level = 0").select("host", "node", "allowed", "labelled"))
    steps = rows.select("host", "segs", "template", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level")).withColumn("node", F.slice("template", 1, F.col("level")))
    chain = steps.join(known, ["host", "node"]).groupBy("host", "segs", "template").agg(F.array_sort(F.collect_list(F.struct("level", "allowed", "labelled"))).alias("chain"))
    fold = F.aggregate("chain", F.col("root"), lambda acc, x: (x["allowed"] + weight * acc) / (x["labelled"] + weight))
    out = chain.crossJoin(F.broadcast(total)).select("host", "segs", F.array_join("template", "/").alias("template"), fold.alias("purity"))
    return out.withColumn("method", F.when(F.col("purity") < min_purity, "block").otherwise("allow"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], label: Column | None = None, weight: float = 10.0, min_purity: float = 0.35, min_children: int = 20, max_mean: float = 3.0, z: float = 2.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for each row of pages (page_id, url).

    label: a boolean column of pages, true for allowed; by default the rules' verdicts.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", (F.lit(None).cast("boolean") if label is None else label).alias("label")).select("page_id", host.alias("host"), path.alias("path"), "label")
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", shape(F.col("path")))
    known = F.coalesce("label", F.col("fit.verdict") == "allow")
    counts = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.coalesce(F.sum(known.cast("long")), F.lit(0)).alias("allowed"), F.count(known).alias("labelled"))
    verdicts = template_verdicts(counts, weight, min_purity, min_children, max_mean, z)
    out = rows.join(verdicts, ["host", "segs"], "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "method", F.lit("allow")).alias("verdict"), "template", "purity")
