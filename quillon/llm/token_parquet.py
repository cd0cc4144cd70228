"""Token ids as Parquet list columns, with delta and dictionary pages and page indexes.

encode_to_parquet() range-partitions the documents by doc_id, encodes each with a public
tokenizer and writes one sorted file a partition.  Counters (doc_id, n_tokens, offsets) have
no dictionary and use DELTA_BINARY_PACKED pages (writer version 2); the id lists use a
dictionary, which bit-packs a vocabulary of 49k in 16 bits, and fall back to delta pages.
Row groups and pages have set sizes and the writer adds column and offset indexes, so a
read of some documents or only of the metadata touches few pages.

A tokenizer that drops white space and never looks across it gets each different word (run
between ASCII blanks) once: a worker keeps the ids of words in a bounded cache and asks the
library only for words that are new to it.  Any other tokenizer gets whole texts.

Edge cases: null text is encoded as the empty text, which has the end id alone; null
doc_ids come first; repeated doc_ids keep each row, in an order by text; an empty table
gives an empty file set; other columns are not written.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, WHITE, batch_bytes, lean, shared_dir, shuffle_partitions, small_batches, text_slices
from quillon.llm.word_cache import WordCache, little

SCHEMA = "part int, doc_id long, n_tokens long, part_start long, ids array<int>"


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for 256 and on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}


#: ASCII bytes in lower case, blanks as spaces.
SMALL = LOWER.copy()
SMALL[WHITE] = 32
#: Kinds of bytes: 0 blank, 1 ASCII letter, 2 other ASCII, 3 ASCII digit, 4 beyond ASCII.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]], KIND[48:58], KIND[128:], KIND[WHITE] = 1, 3, 4, 0
#: Whether a new word starts at a byte of the second kind after one of the first.
STARTS = np.zeros((5, 5), bool)
STARTS[1:, 0] = True  # the first of some blanks
for _a, _b in ((1, 2), (1, 3), (2, 3), (3, 4)):
    STARTS[_a, _b] = STARTS[_b, _a] = True


def cuts(data: np.ndarray, off: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Bounds of words: at document bounds, in front of blanks, and where ASCII letters, digits and marks meet.

    An apostrophe stays with its neighbours, for a contraction is a word of its own; where a
    special token occurs, only blanks cut.
    """
    cut = np.zeros(len(data) + 1, bool)
    kind = KIND[data]
    table = STARTS
    raw = data.tobytes() if any(special) else b""
    if any(x in raw for x in special):
        table = np.zeros_like(STARTS)
        table[1:, 0] = True
    cut[1:-1] = table[kind[:-1], kind[1:]]
    mark = np.flatnonzero(data == 39)
    glued = np.concatenate([mark, mark + 1])
    glued = glued[(glued > 0) & (glued < len(data))]
    cut[glued[kind[glued] > 0]] = False
    cut[off] = True
    cut[[0, -1]] = True
    return np.flatnonzero(cut)


class WordEncoder:
    """Ids of whole texts by a cache of words; equals encode() of the text as one string.

    That holds for tokenizers whose normaliser and pre-tokenizer drop white space and never
    look across it, as blanks_split() checks.  A word of letters that lower-casing and
    composition leave letters is one word to the tokenizer too, so the library's model encodes
    it directly; any other goes through the whole tokenizer.  Ids are little-endian 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = WordCache(self._word)
        spec = json.loads(self.tokenizer.to_str())
        self.split = blanks_split(spec)
        self.special = [x["content"].encode() for x in spec["added_tokens"]]

    def _new(self, word: str) -> bytes:
        if word.isalpha() and word.lower() == word and is_normalized("NFC", word):
            return little([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LEVEL))])
        return little(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A word of letters and a tail of ASCII marks is encoded as its two parts."""
        if word.isascii() and word.isalpha() and word.islower():
            return little([t.id for t in self.model.tokenize(word)])
        if not word:
            return b""
        core = word.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
        low = core.lower()
        if core.isalpha() and low.isalpha() and "\u03a3" not in core:  # capital sigma lower-cases by its place
            return self._new(low) if low == word else self.words.young[low] + self.words.young[word[len(core) :]]
        return self._new(word)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many ids each text has."""
        texts = texts.fill_null("")
        if not self.split:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in ids for i in x], "<i4"), np.array([len(x) for x in ids], np.int64)
        data, off = batch_bytes(texts)
        return self.words.spread(SMALL[data], cuts(data, off, self.special), off, trim=" ")


def blanks_split(spec: dict) -> bool:
    """Whether a tokenizer's file says what WordEncoder relies on: lower case and composed letters, blanks dropped, words split by a pattern, then byte-level BPE with a word end."""
    steps = [spec["normalizer"], *((spec["normalizer"] or {}).get("normalizers") or [])]
    cuts = [spec["pre_tokenizer"], *((spec["pre_tokenizer"] or {}).get("pretokenizers") or [])]
    kinds = {x["type"] for x in steps if x} - {"Sequence"}
    split = [x for x in cuts if x and x["type"] == "Split"]
    byte_level = [x for x in cuts if x and x["type"] == "ByteLevel"]
    return (
        kinds == {"NFC", "Replace", "Lowercase"}
        and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps if x and x["type"] == "Replace")
        and len(split) == 1 and r"|[\p{L}]+|" in split[0]["pattern"].get("Regex", "") and split[0]["behavior"] == "Removed" and split[0]["invert"]
        and len(byte_level) == 1 and not byte_level[0]["add_prefix_space"]
        and spec["model"]["type"] == "BPE" and bool(spec["model"]["end_of_word_suffix"])
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so its words last over tasks."""
    return WordEncoder(path)


def by_range(docs: DataFrame, parts: int) -> DataFrame:
    """docs in parts of ascending doc_id, nulls first.  The bounds come from a pass over doc_id alone, not over the texts."""
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    at = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in bounds)), lambda x: x < F.col("doc_id").cast("long"))) if bounds else F.lit(0)
    return docs.repartitionById(len(bounds) + 1, F.when(F.col("doc_id").isNull(), 0).otherwise(at).cast("int"))


def encode_to_parquet(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 2000) -> str:
    """Write the token ids of docs (doc_id, text) under path, in ascending doc_id order over the files."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        words, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in text_slices(batch, 1, 4 << 20):
                values, n = words.encode(b.column(1))
                if end_id is not None:  # one place more behind each document
                    n = n + 1
                    more = np.full(int(n.sum()), end_id, np.int32)
                    inner = np.ones(len(more), bool)
                    inner[np.cumsum(n) - 1] = False
                    more[inner] = values
                    values = more
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column(0).cast(pa.int64()), pa.array(n), pa.array(start + np.cumsum(n) - n), ids], ["part", "doc_id", "n_tokens", "part_start", "ids"])
                start += int(n.sum())

    rows = by_range(docs.select("doc_id", "text"), shuffle_partitions(docs.sparkSession)).sortWithinPartitions("doc_id", "text")
    writer = rows.mapInArrow(lean(run), SCHEMA).write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    for column in ("doc_id", "n_tokens", "part_start"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table with start: the number of ids of all documents before.

    Each file has its own running start; those of whole files are summed over one row a file.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    small_batches(tokens.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column(3)
            bounds, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/quillon-tokens-{uuid.uuid4().hex}"
