"""Suffix-array dedup: repeated byte strings by longest-previous-factor arrays.

A byte is removed when a string of min_bytes bytes that covers it also starts elsewhere in
the corpus (keep="none"), or starts earlier (keep="first", positions ordered by doc_id and
offset).  Matches never cross documents and are judged on the input.

Only strings that can repeat get suffixes.  Each string of min_bytes bytes is assigned the
least hash of the 64-byte grams inside it; equal strings have equal least hashes, and
neighbouring strings share theirs, so a document falls into runs of some 70 strings.  Runs
are grouped by least hash, packed and pre-deduplicated in each map task.  Two runs of
equal content repeat as a whole.  The other runs of a shared hash, those about the ends of
a repeat, and runs that hold their least gram twice, are fetched as bytes, and for each cell of them the suffixes at the strings'
starts are put into suffix order with their common prefix lengths; previous and next
smaller positions in that order give the longest previous factor (and, with positions
reversed, the longest next factor) of each, and a factor of min_bytes or more is a repeat.
Groups of more than hot_runs such runs are spread over cells by a hash of each string,
after each task has settled the strings that it holds twice itself.

Copies of a whole text are one text with a count; text is only shuffled by its hash.

Edge cases: null and empty texts have no bytes and keep none; texts below min_bytes lose
nothing; a null doc_id comes first; rows equal in doc_id and text count as copies for
"none" and as one document for "first"; other columns are not read.  Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Chunk, batch_bytes, chunks, discard, lean, lean_group, materialize, mix, shuffle_partitions, small_batches

GRAM = 64
RUN = np.dtype([("least", "<u8"), ("content", "<u8"), ("text", "<i8"), ("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("inner", "<u4")])
_G = np.uint64(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of width items."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :])


def runs_of(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least hash, first and last start, and document of each run of strings of size bytes.

    And whether the least gram occurs twice in the run, which strings of a run that equal
    each other need.
    """
    n = len(c.data)
    none = np.zeros(0, np.int64)
    nothing = (np.zeros(0, np.uint64), none, none, none, none)
    if n < size:
        return nothing
    width = size - GRAM + 1
    start = np.arange(n - GRAM + 1)
    gram = c.window_hashes(start, start + GRAM)
    low = _sliding(gram, width, np.minimum)
    doc = np.repeat(np.arange(c.n), np.diff(c.off))
    valid = np.arange(len(low)) + size <= c.off[doc[: len(low)] + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return nothing
    least = low[at]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    run, lo, hi = least[first], at[first], at[last]
    # a gram is some string's least if it equals the greatest of the least hashes about it
    about = np.zeros(len(gram) + width - 1, np.uint64)
    about[width - 1 : width - 1 + len(low)] = np.where(valid, low, 0)
    chosen = np.flatnonzero(gram == _sliding(about, width, np.maximum))
    rank = np.unique(np.concatenate([gram[chosen], run]), return_inverse=True)[1]
    places = np.sort(rank[: len(chosen)] * n + chosen)
    value = rank[len(chosen) :] * n
    inner = np.searchsorted(places, value + hi + width - 1, "right") - np.searchsorted(places, value + lo) > 1
    return run, lo, hi, doc[lo], inner


def _run_blobs(size: int, buckets: int, flush: int = 300_000):
    """mapInArrow of (doc_id, text, hash): rows (bucket, blob of RUN)."""

    def run(batches):
        seen: dict[int, int] = {}
        parts: list[np.ndarray] = []
        n = 0

        def out():
            rows = np.concatenate(parts)
            bucket = (((mix(rows["least"]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(rows)]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[first[:-1]]), pa.array([rows[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["bucket", "blob"])

        for b in batches:
            ids = b.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            texts = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, c in chunks(b.column(1)):
                fresh = np.zeros(hi - lo, bool)
                for i, (t, d) in enumerate(zip(texts[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True)):
                    if d < seen.get(t, d + 1):
                        seen[t] = d
                        fresh[i] = True
                least, first, last, doc, inner = runs_of(c, size)
                keep = fresh[doc]
                least, first, last, doc, inner = least[keep], first[keep], last[keep], doc[keep], inner[keep]
                rows = np.zeros(len(least), RUN)
                rows["least"], rows["content"] = least, c.window_hashes(first, last + size)
                rows["text"], rows["doc"] = texts[lo:hi][doc], ids[lo:hi][doc]
                rows["lo"], rows["hi"] = first - c.off[doc], last - c.off[doc]
                rows["inner"] = inner
                parts.append(rows)
                n += len(rows)
                if n >= flush:
                    yield out()
                    parts, n = [], 0
        if n:
            yield out()

    return run


FOUND = "text_hash long, doc long, lo long, hi long, least long, hot boolean, fetch boolean"


def _group_runs(size: int, keep: str, hot_runs: int):
    """applyInArrow of a bucket: runs that repeat as a whole (fetch false: bytes lo..hi go), and runs to fetch."""

    def run(key, t):
        rows = np.concatenate([np.frombuffer(x, RUN) for x in t.column("blob").to_pylist()])
        rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["content"], rows["least"]))]
        least, content = rows["least"], rows["content"]
        new_least = np.concatenate([[True], least[1:] != least[:-1]])
        new = new_least | np.concatenate([[True], content[1:] != content[:-1]])
        # the same run of the same text may come from several tasks; the least document comes first
        place = mix(rows["text"].view(np.uint64) ^ mix(rows["lo"].astype(np.uint64) + _G))
        kind = np.cumsum(new) - 1
        order = np.lexsort((np.arange(len(rows)), place, kind))
        again = np.zeros(len(rows), bool)
        again[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (kind[order[1:]] == kind[order[:-1]])
        rows, new, new_least = rows[~again], new[~again], new_least[~again]
        kind, group = np.cumsum(new) - 1, np.cumsum(new_least) - 1
        n_kind, n_kinds = np.bincount(kind), np.bincount(group[new])
        whole = n_kind[kind] > 1
        if keep == "first":
            whole &= ~new
        several, inner = n_kinds[group] > 1, rows["inner"] > 0
        if keep == "none":  # nothing is left to learn where all runs of the group go
            several &= (np.bincount(group[new & ~whole], minlength=len(n_kinds)) > 0)[group]
            inner &= ~whole
        fetch = new & (several | inner)
        out = []
        for mask, is_fetch in ((whole, False), (fetch, True)):
            r = rows[mask]
            g = group[mask]
            hot = np.bincount(g, minlength=len(n_kinds))[g] > hot_runs if is_fetch else np.zeros(len(r), bool)
            end = r["hi"].astype(np.int64) + (0 if is_fetch else size)
            out.append(pa.table([pa.array(r["text"]), pa.array(r["doc"]), pa.array(r["lo"].astype(np.int64)), pa.array(end), pa.array(r["least"].view(np.int64)), pa.array(hot), pa.array(np.full(len(r), is_fetch))], ["text_hash", "doc", "lo", "hi", "least", "hot", "fetch"]))
        return pa.concat_tables(out)

    return run


PIECE = "cell int, least long, text_hash long, doc long, lo long, bytes binary, done boolean"


def _fetch(size: int, cells: int, keep: str):
    """mapInArrow of (text, runs): the bytes of each run, by cell; of hot groups string by string."""

    def run(batches):
        seen: dict[int, tuple] = {}  # string hash of a hot group -> its first place in this task
        settled: set[tuple] = set()
        for b in batches:
            data, off = batch_bytes(b.column(0))
            rows = []
            for i, runs in enumerate(b.column(1).to_pylist()):
                text = data[off[i] : off[i + 1]].tobytes()
                for r in runs:
                    if not r["hot"]:
                        rows.append((r["least"] % cells, r["least"], r["text_hash"], r["doc"], r["lo"], text[r["lo"] : r["hi"] + size], False))
                        continue
                    part = np.frombuffer(text, np.uint8)[r["lo"] : r["hi"] + size]
                    at = np.arange(len(part) - size + 1)
                    for s, h in zip(at.tolist(), (Chunk(part, np.array([0, len(part)])).window_hashes(at, at + size) ^ np.uint64(r["least"] % (1 << 64))).view(np.int64).tolist(), strict=True):
                        place = (r["doc"], r["lo"] + s, r["text_hash"])
                        other = seen.get(h)
                        if other is None:
                            seen[h] = place
                            continue
                        if other == place:
                            continue
                        first, later = min(place, other), max(place, other)
                        for p in (later,) if keep == "first" else (first, later):
                            if p not in settled:
                                settled.add(p)
                                rows.append((0, 0, p[2], p[0], p[1], b"", True))
                        seen[h] = first
                        if len(settled) > 1_000_000:
                            settled.clear()
                    for h, place in seen.items() if len(seen) > 100_000 else ():
                        rows.append((h % cells, h, place[2], place[0], place[1], b"", False))
                    if len(seen) > 100_000:
                        seen.clear()
            yield batch(rows)
        yield batch([(h % cells, h, p[2], p[0], p[1], b"", False) for h, p in seen.items()])

    def batch(rows):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["cell", "least", "text_hash", "doc", "lo", "bytes", "done"])

    return run


def longest_previous_factor(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF of suffixes given in suffix order.

    position[r]: where the r-th suffix starts (any distinct numbers); lcp[r]: common prefix
    of suffixes r - 1 and r.  The longest match with an earlier suffix is with the previous
    or the next smaller position in suffix order, whichever has the longer common prefix.
    """
    out = np.zeros(len(position), np.int64)
    stack: list[list[int]] = []  # [rank, position, common prefix with the one below]
    best = out.tolist()
    pos, common = position.tolist(), lcp.tolist()
    for r in range(len(pos)):
        shared = common[r] if r else 0
        while stack and pos[r] < stack[-1][1]:
            top = stack.pop()  # r is its next smaller position
            if shared > best[top[0]]:
                best[top[0]] = shared
            shared = min(shared, top[2])
        best[r] = max(best[r], shared if stack else 0)  # what remains on top is its previous smaller position
        stack.append([r, pos[r], shared])
    out[:] = best
    return out


def repeats(pieces: list[bytes], group: np.ndarray, rank: np.ndarray, size: int, keep: str) -> list[np.ndarray]:
    """For each piece the offsets of its strings of size bytes that repeat in its group (earlier, for "first").

    rank: the order of the pieces' places; within a piece, offsets ascend.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    base = np.concatenate([[0], np.cumsum(lengths)])
    strings = np.maximum(lengths - size + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), strings)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(strings)[:-1]]), strings)
    at = base[owner] + offset
    key = Chunk(data, np.array([0, len(data)])).window_hashes(at, at + size) ^ mix(group[owner].astype(np.int64).view(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    pick = np.flatnonzero(twice)  # suffixes with a partner; no other can have a factor of size bytes
    hit = np.zeros(len(key), bool)
    step = max(1, (8 << 20) // size)  # strings a slice of the suffix order, whole equal keys together
    pick = pick[np.argsort(key[pick], kind="stable")]
    while len(pick):
        stop = min(step, len(pick))
        while stop < len(pick) and key[pick[stop]] == key[pick[stop - 1]]:
            stop += 1
        part, pick = pick[:stop], pick[stop:]
        windows = np.lib.stride_tricks.sliding_window_view(data, size)[at[part]]
        text = np.ascontiguousarray(windows).view(f"S{size}").ravel()
        place = np.lexsort((offset[part], rank[owner[part]]))
        where = np.empty(len(part), np.int64)
        where[place] = np.arange(len(part))
        suffix = np.lexsort((where, group[owner[part]], text))
        prior, now = windows[suffix[:-1]], windows[suffix[1:]]
        differ = prior != now
        common = np.where(differ.any(1), differ.argmax(1), size)
        common[group[owner[part]][suffix[:-1]] != group[owner[part]][suffix[1:]]] = 0
        lcp = np.concatenate([[0], common])
        factor = longest_previous_factor(where[suffix], lcp)
        if keep == "none":
            factor = np.maximum(factor, longest_previous_factor(-where[suffix], lcp))
        hit[part[suffix[factor >= size]]] = True
    found = np.flatnonzero(hit)
    return np.split(offset[found], np.searchsorted(owner[found], np.arange(1, len(pieces))))


def _settle(size: int, keep: str):
    """applyInArrow of a cell of fetched runs: spans (text_hash, lo, hi) to remove."""

    def run(key, t):
        rows = t.to_pydict()
        spans: list[tuple[int, int, int]] = [(h, lo, lo + size) for h, lo, done in zip(rows["text_hash"], rows["lo"], rows["done"], strict=True) if done]
        by: dict[int, list[tuple]] = {}  # strings of hot groups, known by hash
        pieces, seen = [], set()
        for least, h, doc, lo, data, done in sorted(zip(rows["least"], rows["text_hash"], rows["doc"], rows["lo"], rows["bytes"], rows["done"], strict=True), key=lambda r: (r[2], r[3])):
            if done:
                continue
            if not data:
                by.setdefault(least, []).append((doc, lo, h))
            elif (h, lo, least) not in seen:
                seen.add((h, lo, least))
                pieces.append((least, h, lo, data))
        for places in by.values():
            distinct = {(h, lo): None for _, lo, h in places}
            if len(distinct) > 1:
                spans += [(h, lo, lo + size) for h, lo in list(distinct)[keep == "first" :]]
        if pieces:
            group = np.array([p[0] for p in pieces], np.int64)
            for (_, h, lo, _), off in zip(pieces, repeats([p[3] for p in pieces], group, np.arange(len(pieces)), size, keep), strict=True):
                if len(off):
                    cut = np.flatnonzero(np.diff(off) > 1) + 1
                    spans += [(h, lo + int(x[0]), lo + int(x[-1]) + size) for x in np.split(off, cut)]
        return pa.table([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], ["text_hash", "lo", "hi"])

    return run


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [lo, hi)."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[True], lo[1:] > top[:-1]])
    return lo[first], top[np.concatenate([first[1:], [True]])]


def _remove(size: int, keep: str, with_text: bool, pass_row: bool):
    """mapInArrow of (doc_id, text, spans, copies, first_doc, row): what is left of each text."""

    def run(batches):
        for b in batches:
            data, off = batch_bytes(b.column(1))
            out = []
            for i, (doc, spans, copies, first_doc) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4)), strict=True)):
                text = data[off[i] : off[i + 1]]
                n = len(text)
                lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if copies and n >= size and (keep == "none" or doc != first_doc):
                    lo, hi = np.array([0]), np.array([n])
                elif spans:
                    lo, hi = merge(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
                gone = np.zeros(n + 1, np.int8)
                gone[lo] += 1
                gone[hi] -= 1
                left = text[np.cumsum(gone[:-1]) == 0].tobytes()
                out.append((n, n - len(left), len(lo), hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "ignore")] if with_text else [])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            results = [pa.array([r[j] for r in out], kinds[j]) for j in range(5 if with_text else 4)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(results)]
            head = [("document", b.column(5))] if pass_row else [("doc_id", b.column(0).cast(pa.int64()))]
            yield pa.RecordBatch.from_arrays([head[0][1], *results], [head[0][0], *names])

    return run


def suffix_array_dedup(docs: DataFrame, min_bytes: int = 200, keep: str = "first", with_text: bool = False, pass_columns: bool = False, hot_runs: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) for each row of docs (doc_id, text).

    n_spans counts maximal removed runs.  kept_text drops bytes of a character that was cut.
    pass_columns: a struct document with all columns of docs comes first instead of doc_id.
    """
    if min_bytes < GRAM:
        raise ValueError(f"min_bytes must be {GRAM} at least")
    small_batches(docs.sparkSession)
    parts = 4 * shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    blobs = rows.mapInArrow(lean(_run_blobs(min_bytes, parts)), "bucket int, blob binary")
    found = materialize(blobs.groupBy("bucket").applyInArrow(lean_group(_group_runs(min_bytes, keep, hot_runs)), FOUND))
    wanted = found.where("fetch").groupBy("text_hash", "doc").agg(F.collect_list(F.struct("text_hash", "doc", "lo", "hi", "least", "hot")).alias("runs"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min))
    texts = rows.select("text", "text_hash", order.alias("doc")).join(wanted.hint("merge"), ["text_hash", "doc"]).select("text", "runs")
    pieces = texts.mapInArrow(lean(_fetch(min_bytes, parts, keep)), PIECE)
    spread = F.when(F.col("done"), F.pmod(F.xxhash64("text_hash", "lo"), F.lit(parts)).cast("int")).otherwise(F.col("cell"))
    ends = pieces.withColumn("cell", spread).groupBy("cell").applyInArrow(lean_group(_settle(min_bytes, keep)), "text_hash long, lo long, hi long")
    spans = ends.unionByName(found.where("not fetch").select("text_hash", "lo", "hi"))
    spans = spans.groupBy("text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    copies = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").cast("long").alias("first_doc"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).where("n > 1")
    copies = copies.select("text_hash", F.lit(True).alias("copies"), F.when(F.col("nulls") == 0, F.col("first_doc")).alias("first_doc"))
    known = materialize(spans.join(copies, "text_hash", "full"))
    discard(found)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if pass_columns else F.lit(0)
    schema = docs.select(row.alias("r")).schema["r"].dataType.simpleString() if pass_columns else ""
    schema = f"document {schema}" if pass_columns else "doc_id long"
    schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    all_rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), row.alias("row"))
    joined = all_rows.join(known.hint("merge"), "text_hash", "left")  # the same plan at every size
    final = joined.select("id", "body", "spans", "copies", "first_doc", "row")
    return final.mapInArrow(lean(_remove(min_bytes, keep, with_text, pass_columns)), schema)
