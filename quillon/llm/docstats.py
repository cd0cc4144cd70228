"""Per-document text statistics, one vectorised pass over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import WHITE, Chunk, chunks, combine, doc_of, lean, mix, small_batches

SYMBOLS = b"#*$%&|<>"
COUNTS = [
    "n_chars_all", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_digits", "n_punct", "n_bang", "n_pipe", "n_same_next", "n_distinct_words",
]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS = {
    "n_symbols": _mask(SYMBOLS),
    "n_upper": _mask(bytes(range(65, 91))),
    "n_digits": _mask(bytes(range(48, 58))),
    "n_punct": _mask(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])),
    "n_bang": _mask(b"!"),
    "n_pipe": _mask(b"|"),
}


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items whose key an item before has too, and items whose key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def statistics(c: Chunk, window: int = 8) -> dict[str, np.ndarray]:
    """COUNTS of each document of the chunk; empty texts have zeros."""
    out = {k: _per_doc(m[c.data], c.off) for k, m in _IS.items()}
    head = (c.data & 0xC0) != 0x80
    out["n_chars_all"] = _per_doc(head, c.off)
    solid = ~WHITE[c.data]
    out["word_chars"] = _per_doc(head & solid, c.off)
    start, end, bounds = c.words()
    doc = doc_of(bounds)
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    words = c.hashes(start, end)
    out["n_words"] = np.diff(bounds)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["n_same_next"] = _per_doc(same, bounds)
    later, _ = _repeats(words ^ salt)
    out["n_distinct_words"] = out["n_words"] - _per_doc(later, bounds)
    grams = combine(words, window)
    whole = doc[: len(grams)] == doc[window - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, twice = _repeats(grams[at] ^ salt[at])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(cover)[:-1] > 0, bounds)
    breaks = np.flatnonzero(c.data == 10)
    line = np.unique(np.concatenate([c.off[:-1][np.diff(c.off) > 0], breaks + 1]))
    line = line[line < len(c.data)]
    stop = np.concatenate([line[1:], [len(c.data)]]) if len(line) else line
    stop = stop - (c.data[stop - 1] == 10) if len(line) else stop
    n_solid = np.concatenate([[0], np.cumsum(solid)])
    full = n_solid[stop] > n_solid[line]
    line, stop = line[full], stop[full]
    lines = np.searchsorted(line, c.off)
    owner = doc_of(lines)
    out["n_lines"] = np.diff(lines)
    later, _ = _repeats(c.hashes(line, stop) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = _per_doc(later, lines)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for every row of docs (doc_id, text); null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, c in chunks(b.column(1)):
                s = statistics(c)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), *(pa.array(s[k]) for k in COUNTS)], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)
