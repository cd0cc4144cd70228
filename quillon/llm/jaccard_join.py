"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two documents link when their sets of distinct word k-grams have a Jaccard similarity of
at least num / den.  Documents with equal sets share a node, so copies never multiply.

Blocks.  In any fixed order of all items, two linked sets A and B share one of the first
|A| - ceil(|A| * num / den) + 1 items of A and of B.  The order here goes by rarity: by the
exact number of nodes that hold the item, so a text that shares passages with many others
but is mostly its own offers only items that nothing else holds, and meets nobody.  To halve
the items that are counted, the order starts with the items of one half of the hash space
and a set sends only these, or as many more, in hash order, as its front needs.  Items go
to buckets by hash as packed bytes; a bucket counts its items and returns those that two
nodes hold or more, each with its rank in the order.  Nodes that share an item of their
fronts form clusters, and a cluster is a block of the product.

Items that HOT or more sets of one map task's flush hold do not go to a bucket row by row:
the flush sends one mark for the item, and its rows go straight to their nodes.  Items of
HOT or more nodes all rank alike, so that changes no result.

Product.  Each block builds its incidence rows from the whole texts of its nodes and
multiplies them by their transpose, which accumulates the exact overlap of every pair;
columns of a few rows add their pairs one by one, others go as slices.  Pairs under the
overlap their sizes demand are discarded.  Clusters above block_rows nodes, groups of many
different near copies, are cut into a grid of blocks, one task a pair of blocks.  A task
returns a spanning forest of its links and each node's number of links, never the pairs.

Edge cases: null, empty and blank texts have the empty set and link with nothing; a text of
fewer than k words has its whole word sequence as its only item; rows with a null doc_id
take part and may get a null component_id; repeated rows each get a row; other columns
are not read.  Items and nodes are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Chunk, chunks, combine, discard, lean, lean_group, materialize, mix, shuffle_partitions, small_batches
from quillon.llm.components import attach_least, connected_components

HOT = 63
FILTER_BITS = 26
_G = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = 5  # bytes of an item that travel; the bucket stands for others


def front(n, num: int, den: int):
    """How many first items of a set of n must hold one that any linked set shares."""
    return n - (n * num + den - 1) // den + 1


def item_sets(c: Chunk, k: int) -> list[np.ndarray]:
    """The sorted distinct k-gram hashes of each document, A-Z lower-cased."""
    low = Chunk(LOWER[c.data], c.off)
    start, end, bounds = low.words()
    words = low.hashes(start, end)
    grams = combine(words, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(combine(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(items: np.ndarray) -> int:
    """A 64-bit id of the set; 0 for the empty one."""
    if not len(items):
        return 0
    with np.errstate(over="ignore"):
        return int((mix(np.add.reduce(mix(items ^ _G), keepdims=True) + np.uint64(len(items))) | np.uint64(1)).view(np.int64)[0])


def bucket_of(items: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets go by the lowest 24 bits, which the tokens leave out."""
    return (((items & np.uint64(0xFFFFFF)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int32)


def rank_of(token: np.ndarray, bucket, holders: np.ndarray) -> np.ndarray:
    """The place of an item in the order: half of the hash space, number of holders up to HOT, hash."""
    late = (token >> np.uint64(39)) << np.uint64(6)
    return (((late | np.minimum(holders, HOT).astype(np.uint64)) << np.uint64(56)) | (token << np.uint64(16)) | np.uint64(bucket & 0xFFFF)).view(np.int64)


SENT = "bucket int, node binary, count binary, token binary, mark binary"


def _sent_items(k: int, num: int, den: int, buckets: int, flush: int = 600_000):
    """mapInArrow of (doc_id, text): rows of SENT.

    Buckets from 0 on: runs (node, count) of tokens, and tokens marked as held often.  Below 0:
    documents as (doc_id, n, node, spare, is null), or rows (node, rank) of such tokens.
    """

    def run(batches):
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        seen: set[int] = set()
        size = turn = 0

        def rows(bucket, node, count, token, mark):
            kinds = [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, t) for x, t in zip((node, count, token, mark), kinds, strict=True))], ["bucket", "node", "count", "token", "mark"])

        def out():
            item, node = np.concatenate(sets), np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])
            order = np.argsort(item, kind="stable")
            same = item[order]
            first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            held = np.diff(np.concatenate([first, [len(same)]]))
            marked = same[first[held >= HOT]]
            often = np.zeros(len(item), bool)
            often[order] = np.repeat(held >= HOT, held)
            if len(marked):
                token = item[often] >> np.uint64(24)
                rank = rank_of(token, bucket_of(item[often], buckets), np.full(len(token), HOT))
                yield rows([-1 - turn % buckets], [None], [None], [np.column_stack([node[often], rank]).tobytes()], [b""])
                item, node = item[~often], node[~often]
            bucket = bucket_of(item, buckets)
            order = np.argsort(bucket, kind="stable")
            item, node, bucket = item[order], node[order], bucket[order]
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])])
            at = np.flatnonzero(new)
            within = np.arange(len(item)) - np.repeat(at, np.diff(np.concatenate([at, [len(item)]])))
            run = np.flatnonzero(within % 65535 == 0)  # counts have two bytes
            count = np.diff(np.concatenate([run, [len(item)]])).astype(np.uint16)
            token = np.ascontiguousarray((item >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :_TOKEN])
            marks = np.sort(bucket_of(marked, buckets)), marked[np.argsort(bucket_of(marked, buckets), kind="stable")] >> np.uint64(24)
            all_buckets = np.unique(np.concatenate([bucket, marks[0]]))
            ends = [np.searchsorted(x, all_buckets, side) for x in (bucket[run], bucket, marks[0]) for side in ("left", "right")]
            runs_node = node[run]
            blobs = [(runs_node[a:b].tobytes(), count[a:b].tobytes(), token[c:d].tobytes(), marks[1][e:f].tobytes()) for a, b, c, d, e, f in zip(*ends, strict=True)]
            yield rows(all_buckets, *map(list, zip(*blobs, strict=True)))

        for b in batches:
            docs = np.zeros((b.num_rows, 5), np.int64)
            for lo, hi, c in chunks(b.column(1)):
                for i, items in enumerate(item_sets(c, k), lo):
                    node, n = node_of(items), len(items)
                    need = front(n, num, den)
                    sent = max(need, int(np.searchsorted(items, np.uint64(1 << 63)))) if n else 0
                    docs[i, 1:4] = n, node, sent - need
                    if node and node not in seen:
                        seen.add(node)
                        sets.append(items[:sent])
                        nodes.append(node)
                        size += sent
                if size >= flush:
                    yield from out()
                    sets, nodes, size = [], [], 0
            ids = b.column(0).cast(pa.int64())
            docs[:, 0] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            docs[:, 4] = ids.is_null().to_numpy(zero_copy_only=False)
            turn += 1
            yield rows([-1 - (int(docs[0, 2]) + turn) % buckets], [docs.tobytes()], [None], [None], [None])
        if size:
            yield from out()

    return run


def _ranked(groups_key, t):
    """applyInArrow of a bucket: (node, rank) of the items that two nodes hold or more; documents as they are."""
    names = ["doc_id", "n", "node", "spare", "rank"]
    key = groups_key[0].as_py()
    if key < 0:
        docs = np.concatenate([np.zeros((0, 5), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 5) for x in t.column("node").to_pylist() if x is not None)])
        often = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 2) for x in t.column("token").to_pylist() if x is not None)])
        a = pa.Table.from_arrays([pa.array(docs[:, 0], mask=docs[:, 4] > 0), *(pa.array(docs[:, i]) for i in (1, 2, 3)), pa.nulls(len(docs), pa.int64())], names)
        none = pa.nulls(len(often), pa.int64())
        return pa.concat_tables([a, pa.Table.from_arrays([none, none, pa.array(often[:, 0]), none, pa.array(often[:, 1])], names)])
    node = np.frombuffer(b"".join(t.column("node").to_pylist()), np.int64)
    count = np.frombuffer(b"".join(t.column("count").to_pylist()), np.uint16)
    packed = np.frombuffer(b"".join(t.column("token").to_pylist()), np.uint8).reshape(-1, _TOKEN)
    mark = np.unique(np.frombuffer(b"".join(t.column("mark").to_pylist()), np.uint64))
    token = np.zeros((len(packed), 8), np.uint8)
    token[:, :_TOKEN] = packed
    token, node = token.view(np.uint64).ravel(), np.repeat(node, count)
    order = np.argsort(token)
    token, node = token[order], node[order]
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(token) else new
    often = np.isin(token, mark) if len(mark) else np.zeros(len(token), bool)
    pick = ~(new & last) | often  # the others have one holder
    token, node, often = token[pick], node[pick], often[pick]
    order = np.lexsort((node, token))
    token, node, often = token[order], node[order], often[order]
    once = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])]) if len(token) else np.zeros(0, bool)
    token, node, often = token[once], node[once], often[once]  # a node may come from several tasks
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(token)]])).astype(np.int64)
    holders = np.where(often, HOT, np.repeat(n, n))
    token, node, holders = token[holders > 1], node[holders > 1], holders[holders > 1]
    none = pa.nulls(len(token), pa.int64())
    return pa.Table.from_arrays([none, none, pa.array(node), none, pa.array(rank_of(token, key, holders))], names)


def overlaps(sets: list[np.ndarray], cells: int = 1 << 22, few: int = 24) -> np.ndarray:
    """Overlap counts of all pairs: the incidence matrix, columns that have the same rows merged, times its transpose.

    Columns of at most few rows add their pairs; the others are multiplied as slices.
    """
    g = len(sets)
    out = np.zeros((g, g), np.float64)
    item = np.concatenate(sets)
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    rows = np.diff(np.concatenate([first, [len(item)]]))
    first, rows = first[rows > 1], rows[rows > 1]  # a column of one row adds to no pair
    if not len(first):
        return out
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix((row.astype(np.uint64) + np.uint64(1)) * _G))])
        pattern = total[first + rows] - total[first]
    _, at, weight = np.unique(pattern, return_index=True, return_counts=True)
    first, rows = first[at], rows[at]
    for n in np.unique(rows[rows <= few]).tolist():
        pick = np.flatnonzero(rows == n)
        for a in range(0, len(pick), max(1, cells // (n * n))):
            p = pick[a : a + max(1, cells // (n * n))]
            members = row[first[p][:, None] + np.arange(n)]
            pairs = (members[:, :, None] * g + members[:, None, :]).ravel()
            out += np.bincount(pairs, np.repeat(weight[p].astype(np.float64), n * n), g * g).reshape(g, g)
    pick = np.flatnonzero(rows > few)
    width = max(1, cells // g)
    for a in range(0, len(pick), width):
        p = pick[a : a + width]
        part = np.zeros((g, len(p)), np.float64 if weight[p].sum() >= 1 << 24 else np.float32)
        column = np.repeat(np.arange(len(p)), rows[p])
        inside = np.arange(len(column)) - np.repeat(np.cumsum(rows[p]) - rows[p], rows[p])
        part[row[first[p][column] + inside], column] = 1
        out += (part * weight[p].astype(part.dtype)) @ part.T
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _product(k: int, num: int, den: int):
    """applyInArrow over a cell: rows (node, root, links, big) of the spanning forest of its links."""

    def run(groups_key, t):
        t = t.combine_chunks()
        column = t.column("text")
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        sets: list[np.ndarray] = []
        for _, _, c in chunks(column):
            sets += item_sets(c, k)
        label, node, side = (t.column(x).to_numpy() for x in ("label", "node", "side"))
        big = groups_key[0].as_py() == 1
        good = np.array([node_of(s) for s in sets], np.int64) == node  # a repeated doc_id may have another text
        order = np.flatnonzero(good)
        order = order[np.lexsort((node[order], label[order]))]
        out: list[tuple[int, int, int]] = []
        for block in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            block = block[np.concatenate([[True], node[block][1:] != node[block][:-1]])] if len(block) else block
            if len(block) < 2:
                continue
            n = np.array([len(sets[i]) for i in block])
            over = overlaps([sets[i] for i in block])
            link = over * (num + den) >= num * (n[:, None] + n[None, :])
            np.fill_diagonal(link, False)
            if big and len(np.unique(side[block])) > 1:  # a cell off the diagonal only has pairs of its two sides
                link &= side[block][:, None] != side[block][None, :]
            degree = link.sum(1)
            parent = list(range(len(block)))
            for i in np.flatnonzero(degree).tolist():
                near = np.flatnonzero(link[i, :i]).tolist()
                for j in near:
                    a, b = _find(parent, i), _find(parent, j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            out += [(int(node[block[i]]), int(node[block[_find(parent, i)]]), int(degree[i])) for i in np.flatnonzero(degree).tolist()]
        rows = np.array(out, np.int64).reshape(-1, 3)
        return pa.Table.from_arrays([*(pa.array(x) for x in rows.T), pa.array(np.full(len(rows), big))], ["node", "root", "links", "big"])

    return run


def _nodes(k: int):
    """mapInArrow of text: rows (text, node)."""

    def run(batches):
        for b in batches:
            for lo, hi, c in chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([node_of(s) for s in item_sets(c, k)], pa.int64())], ["text", "node"])

    return run


def _near_filter(ids: DataFrame, id_type) -> DataFrame:
    """A bitmap of 2**FILTER_BITS bits over hashed ids, as at most 2**(FILTER_BITS - 6) rows (word, bits)."""
    h = F.xxhash64(F.col("doc_id").cast(id_type)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return ids.select(F.shiftright(h, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) with a doc_id of wanted, and maybe some others: what the bitmap lets through.

    The broadcast has at most 2**20 rows (word, bits) however many ids are wanted; the more
    there are the less it holds back before the shuffle of the join that follows.
    """
    id_type = docs.schema["doc_id"].dataType
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = F.broadcast(_near_filter(wanted, id_type))
    rows = docs.select("doc_id", "text", F.shiftright(h, 6).alias("word"), h.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    return rows.join(bits, "word").where("(shiftright(bits, at) & 1) = 1").select("doc_id", "text")


def _clusters(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc_id, n_shingles, node) of docs, clusters (node, label), and what to discard in the end."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = min(1 << 22, max(shuffle_partitions(docs.sparkSession), size >> 23))  # of some 8 MB of text each
    sent = docs.select("doc_id", "text").mapInArrow(lean(_sent_items(k, num, den, buckets)), SENT)
    ranked = materialize(sent.groupBy("bucket").applyInArrow(lean_group(_ranked), "doc_id long, n long, node long, spare long, rank long"))
    rows = ranked.where("n is not null").select("doc_id", F.col("n").alias("n_shingles"), "node", "spare")
    spare = rows.where("node <> 0").groupBy("node").agg(F.min("spare").alias("spare"))
    shared = ranked.where("n is null").select("node", F.lit(None).cast("long").alias("spare"), "rank")
    both = shared.unionByName(spare.select("node", "spare", F.lit(-1).cast("long").alias("rank")))
    node = W.partitionBy("node")
    # of the sent items, those with one holder come before the shared ones
    placed = both.withColumn("place", F.dense_rank().over(node.orderBy("rank")) - 1)  # a row may come from several tasks
    placed = placed.withColumn("most", F.max("place").over(node) - F.max("spare").over(node))
    fronts = materialize(placed.where("rank >= 0 and place <= most").select("node", "rank"))
    edges = attach_least(fronts, "rank", "node").where("node <> least").select("node", "least").distinct()
    label = connected_components(edges, "node", "least").withColumnRenamed("component", "label")
    return rows.drop("spare"), label, [ranked, fronts]


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block_rows: int = 1024) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links and component_id for each row of docs (doc_id, text).

    class_id names the set (null for the empty one); n_links counts the other classes that
    the row's class links with; component_id is the smallest doc_id reachable.
    """
    small_batches(docs.sparkSession)
    parts = 4 * shuffle_partitions(docs.sparkSession)
    rows, clusters, used = _clusters(docs, k, num, den)
    first = rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    cand = materialize(clusters.join(sizes, "label").join(first, "node").select("doc_id", "node", "label", "size"))
    texts = texts_of(docs, cand).join(cand.hint("merge"), "doc_id")
    unnamed = cand.where("doc_id is null").drop("doc_id")
    if not unnamed.isEmpty():  # classes without any doc_id: found again by their node, a text a class
        again = docs.where("doc_id is null").select("text").mapInArrow(lean(_nodes(k)), "text string, node long").groupBy("node").agg(F.min("text").alias("text"))
        texts = texts.unionByName(again.join(unnamed, "node").withColumn("doc_id", F.lit(None).cast(texts.schema["doc_id"].dataType)))
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    cells = texts.withColumn("blocks", blocks).withColumn("side", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "text", "node", "label", "side", (F.col("blocks") > 1).cast("int").alias("big"),
        F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(parts))).alias("cell"),
        F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"),
    )
    forest = materialize(cells.groupBy("big", "cell", "bi", "bj").applyInArrow(lean_group(_product(k, num, den)), "node long, root long, links long, big boolean"))
    degrees = forest.groupBy("node").agg(F.sum("links").alias("n_links"))
    large = forest.where("big and node <> root")
    comp = forest.where("not big").select("node", F.col("root").alias("comp"))
    if not large.isEmpty():
        comp = comp.unionByName(connected_components(large, "node", "root").select("node", F.col("component").alias("comp")))
    least = comp.join(first, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = materialize(comp.join(least, "comp").join(degrees, "node").select("node", "component_id", "n_links"))
    for x in (used[1], cand, forest):
        discard(x)
    alone = first.select("node", F.col("doc_id").alias("first_id"))
    out = rows.join(alone, "node", "left").join(names, "node", "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("node") != 0, F.col("node")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "first_id", "doc_id").alias("component_id"),
    )
