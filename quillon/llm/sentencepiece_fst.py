"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into machines with numbered states and labelled arcs:

* the normaliser, from characters to characters: the rules of the model's character map as a
  trie, of which the longest match at a place wins, then a machine with one state for "after
  a blank" and one for "after another character", which drops surplus blanks if the model
  says so, puts the blank in front and writes U+2581 for blanks;
* the pieces, from characters to ids: arcs by character, and at the last character of a
  piece an arc back to the start that puts out its id at its weight;
* byte fallback: for a character that is no piece, arcs to its UTF-8 byte pieces (to the
  unknown piece in models without), at a weight beyond all others;
* junctions, from ids to ids: one state for each last piece, and a weight for each next one.

The composition of these with an input is walked from the front, place by place, and the
path of least weight in the tropical semiring (weights add along a path, the least path
wins) gives the ids.  For unigram models an arc weighs minus its piece's score and junctions
weigh nothing.  For BPE models arcs weigh nothing and the junction (a, b) weighs 0 if merging
the characters of ab alone ends in just a, b, else infinity; a segmentation is the BPE result
if and only if all of its junctions weigh 0, so one path is finite, and every prefix has one
too.  Arcs of the junction machine are compiled when a path first asks for them.

A place between two characters that are neighbours in no piece is a state that every path
passes, so the input is cut there and each part has its own shortest path; words with the
blank before them are such parts, for the most part, and a worker keeps their ids in a
bounded cache.  The cuts lose nothing.

Edge cases: null and empty texts have no ids and decode to the empty text; other columns
are not read; repeated rows are each encoded.  Decoding undoes encoding exactly if the model
normalises nothing and the text does not hold U+2581 itself.  Ties go to the path that the
library takes; it adds 32-bit weights over a whole text, so paths whose weights differ by
less than that rounding may come out otherwise.  Models with unused pieces are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import batch_bytes, lean, small_batches, text_slices
from quillon.llm.word_cache import WordCache, little

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INF = float("inf")
LEAF: dict[str, int] = {}


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[at]
        at += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, at


def _fields(b: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            value, at = _varint(b, at)
        elif key & 7 == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, at = b[at : at + n], at + n
        yield key >> 3, value


class Machine:
    """States and labelled arcs of the strings that were added; state 0 is the start."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.put: list = [None]

    def add(self, string: str, put) -> None:
        """Arcs for the string; its last state puts out put."""
        at = 0
        for ch in string:
            if ch not in self.arcs[at]:
                if self.arcs[at] is LEAF:
                    self.arcs[at] = {}
                self.arcs[at][ch] = len(self.arcs)
                self.arcs.append(LEAF)
                self.put.append(None)
            at = self.arcs[at][ch]
        self.put[at] = put

    def longest(self, text: str, at: int):
        """(end, output) of the longest string from at on, or (at, None)."""
        state, best = 0, (at, None)
        for i in range(at, len(text)):
            state = self.arcs[state].get(text[i])
            if state is None:
                break
            if self.put[state] is not None:
                best = (i + 1, self.put[state])
        return best


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array of 32-bit units over UTF-8 bytes, then the replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    unit, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    label = unit & np.uint32(0x800000FF)
    offset = ((unit >> np.uint32(10)).astype(np.int64)) << ((unit & np.uint32(1 << 9)) >> np.uint32(6)).astype(np.int64)
    letters = np.arange(1, 256)
    out, todo = {}, [(int(offset[0]), b"")]
    while todo:
        at, key = todo.pop()
        near = at ^ letters
        fits = near < len(unit)
        fits[fits] = label[near[fits]] == letters[fits]
        for p, ch in zip(near[fits].tolist(), letters[fits].tolist(), strict=True):
            below, longer = p ^ int(offset[p]), key + bytes([ch])
            if unit[p] >> 8 & 1:
                start = int(unit[below] & 0x7FFFFFFF)
                out[longer.decode()] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((below, longer))
    return out


class Normaliser:
    """Characters to characters, as the model's normaliser specification asks."""

    def __init__(self, spec: dict, user: list[str], suffix: bool):
        self.prefix, self.squeeze, self.escape, self.suffix = (bool(x) for x in (spec.get(3, 1), spec.get(4, 1), spec.get(5, 1), suffix))
        self.rules, self.user = Machine(), Machine()
        rules = character_map(spec.get(2, b""))
        for key, value in rules.items():
            self.rules.add(key, value)
        for piece in user:
            self.user.add(piece, piece)
        self.identity = not rules and not self.squeeze and not self.suffix and self.escape

    def _rewritten(self, text: str):
        """Replacements along the text; a user's piece stays as it is."""
        at = 0
        while at < len(text):
            end, put = self.user.longest(text, at)
            if put is None:
                end, put = self.rules.longest(text, at)
            if put is None:
                end, put = at + 1, text[at]
            yield put
            at = end

    def __call__(self, text: str) -> str:
        if self.identity:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""
        out, after_blank = [], self.squeeze
        for put in self._rewritten(text):
            if after_blank:
                put = put.lstrip(" ")
            if put:
                out.append(put)
                after_blank = self.squeeze and put.endswith(" ")
        whole = "".join(out)
        whole = whole.rstrip(" ") if self.squeeze else whole
        if not whole:
            return ""
        blank = SPACE if self.escape else " "
        whole = whole.replace(" ", SPACE) if self.escape else whole
        return whole if not self.prefix else whole + blank if self.suffix else blank + whole


class Transducer:
    """The compiled model; encode() and decode() are its two directions."""

    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        spec: dict = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    text, score, kind = "", 0.0, NORMAL
                    for n, v in _fields(value):
                        text, score, kind = (v.decode(), score, kind) if n == 1 else (text, struct.unpack("<f", v)[0], kind) if n == 2 else (text, score, v)
                    pieces.append((text, score, kind))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    spec = dict(_fields(value))
        if trainer.get(3, 1) not in (1, 2) or any(kind == UNUSED for _, _, kind in pieces):
            raise ValueError("only unigram and BPE models without unused pieces are compiled")
        self.bpe = trainer.get(3, 1) == 2
        self.text = [p[0] for p in pieces]
        self.arc = {t: i for i, (t, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        normal = [score for _, score, kind in pieces if kind == NORMAL]
        self.score = [0.1 * (len(t.encode()) - 1) if kind == USER else score for t, score, kind in pieces]  # the library's bonus
        self.weight = [0.0 if self.bpe else -x for x in self.score]
        self.fallback = 0.0 if self.bpe else 10.0 - min(normal, default=0.0)
        self.byte = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i, p in enumerate(pieces) if p[2] in (CONTROL, UNKNOWN)}
        self.odd = self.silent | set(self.byte_of)
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        user = [t for t, _, kind in pieces if kind == USER]
        self.normal = Normaliser(spec, user, bool(trainer.get(24, 0)))
        self.prefix = self.normal.prefix and not self.normal.suffix
        self.pieces, self.frozen = Machine(), Machine()
        for t, i in self.arc.items():  # BPE never merges into or out of a piece of the user
            (self.frozen if self.bpe and pieces[i][2] == USER else self.pieces).add(t, i)
        self.inside = {t[i : i + 2] for t in self.arc for i in range(len(t) - 1)}
        self.plain = [t.replace(SPACE, " ") for t in self.text]
        # forced states between two bytes of a text that is only prefixed: ASCII characters that are neighbours in no piece
        self.vectors = self.normal.identity and self.normal.prefix and not user
        self.forced = np.zeros((256, 256), bool)
        if self.vectors:
            self.forced[:128, :128] = True
            for pair in self.inside:
                a, b = (ord(ch) if ch != SPACE else 32 for ch in pair)
                if a < 128 and b < 128:
                    self.forced[a, b] = False
            if not any(SPACE in t.lstrip(SPACE) for t in self.arc):  # in front of a blank, unless after U+2581, which ends in 0x81
                self.forced[128:, 32] = True
                self.forced[0x81, 32] = False
        self.junctions: dict[tuple[int, int], float] = {}
        self.words = WordCache(lambda w: self._bytes(w.replace(" ", SPACE)), most=400_000)
        self.parts = WordCache(lambda part: little(self._shortest(part)), most=100_000)

    def _merge(self, chars: str) -> list[str]:
        """BPE of a short string: the best-scored neighbour pair first, the leftmost of equals."""
        left = list(chars)
        while True:
            best = max(((self.score[self.arc[a + b]], -i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if a + b in self.arc), default=None)
            if best is None:
                return left
            i = -best[1]
            left[i : i + 2] = [left[i] + left[i + 1]]

    def junction(self, a: int, b: int) -> float:
        """Weight of the arc of piece b out of the state of piece a; a = -1: at the start of a part."""
        if not self.bpe:
            return 0.0
        weight = self.junctions.get((a, b))
        if weight is None:
            if len(self.junctions) > 300_000:  # bounded; arcs are compiled again when they are asked for
                self.junctions.clear()
            want = [self.text[b]] if a < 0 else [self.text[a], self.text[b]]
            weight = self.junctions[a, b] = 0.0 if self._merge("".join(want)) == want else INF
        return weight

    def _shortest(self, part: str) -> list[int]:
        """Ids of the shortest path through the composition of the machines with a part that has no forced state inside."""
        n = len(part)
        arcs, put, weight, known, bpe = self.pieces.arcs, self.pieces.put, self.weight, self.junctions.get, self.bpe
        total: list[float] = [0.0] + [INF] * n  # least weight of a path to each place, its last piece and where that starts
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            here = total[start]
            if here == INF:
                continue
            before, state, single = last[start], 0, False
            for end in range(start + 1, n + 1):
                state = arcs[state].get(part[end - 1])
                if state is None:
                    break
                piece = put[state]
                if piece is None:
                    continue
                single |= end == start + 1
                if bpe:
                    if total[end] != INF:  # one path to a place is finite
                        continue
                    step = known((before, piece))
                    if (self.junction(before, piece) if step is None else step) == INF:
                        continue
                least = here + weight[piece]
                if least < total[end]:
                    total[end], last[end], back[end] = least, piece, start
            if not single and here + self.fallback < total[start + 1]:
                total[start + 1], last[start + 1], back[start + 1] = here + self.fallback, self.unknown, start
        ids: list[int] = []
        at = n
        while at:
            start = back[at]
            if last[at] != self.unknown:
                ids.append(last[at])
            elif self.byte:
                ids += [self.byte[b] for b in reversed(part[start:at].encode())]
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknown characters are one
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def _bytes(self, text: str) -> bytes:
        """Ids of a normalised text, as little-endian 32-bit bytes: cut at its forced states, the paths joined."""
        inside = self.inside
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside), len(text)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        get = self.parts.table().__getitem__
        return b"".join(map(get, parts))

    def _ids(self, text: str) -> bytes:
        """Ids of a normalised text; of a BPE model, pieces of the user stand alone, the longest first."""
        if len(self.frozen.arcs) == 1:
            out = self._bytes(text)
        else:
            out, first, at = b"", 0, 0
            while at < len(text):
                end, piece = self.frozen.longest(text, at)
                if piece is not None:
                    out += self._bytes(text[first:at]) + little([piece])
                    first = at = end
                else:
                    at += 1
            out += self._bytes(text[first:])
        if not self.byte:  # unknown characters of neighbouring parts are one
            ids = np.frombuffer(out, "<i4")
            out = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])].tobytes() if len(ids) else out
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many ids each text has; words new to the worker are walked first."""
        data, off = batch_bytes(texts)
        if not self.vectors:
            ids = [self._ids(self.normal(t)) if t else b"" for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], np.int64)
        full = np.diff(off) > 0  # the prefix is one more blank in front
        data = np.insert(data, off[:-1][full], 32)
        off = off + np.concatenate([[0], np.cumsum(full)])
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = self.forced[data[:-1], data[1:]]
        cut[off] = True
        ids, counts = self.words.spread(data, np.flatnonzero(cut), off)
        if not self.byte:  # unknown characters of neighbouring words are one
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            first = (np.cumsum(counts) - counts)[counts > 0]
            again[first] = False
            counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[again], minlength=len(counts))
            ids = ids[~again]
        return ids, counts

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self._ids(self.normal(text)), "<i4").tolist() if text else []

    def decode(self, ids) -> str:
        if self.odd.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
        else:
            raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else self.plain[i].encode() for i in ids)
            text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer a worker process, so its paths last over tasks."""
    return Transducer(path)


def sentencepiece_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and ids for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        fst = transducer(model)
        for b in batches:
            for part in text_slices(b, 1):
                ids, n = fst.encode_all(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>")


def sentencepiece_round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (of little-endian 32-bit ids) and round_trip.

    round_trip: whether decoding the ids gives the text back (null text: the empty one).
    """
    small_batches(docs.sparkSession)

    def run(batches):
        fst = transducer(model)
        byte = np.zeros(len(fst.text), bool)
        byte[list(fst.byte_of)] = True
        for batch in batches:
            for b in text_slices(batch, 1):
                ids, n = fst.encode_all(b.column(1))
                bounds = np.concatenate([[0], np.cumsum(n)])
                n_byte = np.diff(np.concatenate([[0], np.cumsum(byte[ids])])[bounds])
                raw, every, at = memoryview(ids.astype("<u4").tobytes()), ids.tolist(), bounds.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at, at[1:], strict=False)]
                same = [fst.decode(every[a:z]) == (t or "") for a, z, t in zip(at, at[1:], b.column(1).to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), pa.array(n_byte.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
