"""Each operator against a brute-force version, on texts with nulls, blanks, copies, ties and repeated rows."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillon.llm.common import Chunk
from quillon.llm.jaccard_join import ngram_jaccard_join, overlaps
from quillon.llm.quality_classifier import quality_scores
from quillon.llm.quality_rules import BANDS, GRID, RULES, quality_rules, select_cutoffs, upper_bound
from quillon.llm.sentencepiece_fst import Transducer, sentencepiece_round_trip
from quillon.llm.soft_mixing import fit_mixture, mix_documents, soft_mixing_rates
from quillon.llm.suffix_dedup import longest_previous_factor, suffix_array_dedup
from quillon.llm.token_parquet import WordEncoder, encode_to_parquet, new_path, read_tokens, token_digests
from quillon.llm.toxicity import Automaton, toxicity_scores

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, label int, score double, spans string"


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(rng.choice([1, 3, 4, 7, 30, 80, 150])) for _ in range(30)]
    passage = make(70)
    out: list[str | None] = [None, "", " \n\t", "one", "one", *base, base[3], base[3].upper(), "x " * 300, "ab" * 900, "é ü 中文 😀 " * 30]
    for t in base[:12]:  # near copies
        w = t.split(" ")
        for _ in range(4):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
    out += [make(20) + " " + passage + "\n" + make(25) for _ in range(6)]
    return out


def rows(seed: int = 5) -> list[tuple]:
    out = [(i, t, "en" if i % 3 else "fr", "s", 1, 7, 1, 0.5, "x") for i, t in enumerate(texts(seed))]
    return [*out, out[7], (None, "a null id " * 40, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


# ------------------------------------------------------------------ quality


def base_statistics(text):
    w = [x.decode() for x in words_of(text)]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(covered)


def test_quality_rules_base(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules(docs, labels).collect())
    want = collections.Counter()
    for r in rows():
        s = base_statistics(r[1])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want[r[0], *s, failed, not failed] += 1
    assert got == want


def test_quality_rules_lines(spark):
    text = "a b\na b\n\n \na b#\nx\nx\nx"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_statistics(text)


def test_binomial_bound_and_cutoffs():
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert upper_bound(5, 5, 0.05) == 1
    tail = sum(float(np.prod([(50 - j) / (j + 1) for j in range(i)])) * 0.15**i * 0.85 ** (50 - i) for i in range(4))
    assert upper_bound(3, 50, tail) == pytest.approx(0.15, abs=1e-6)
    counts = {0: {"n": 5000} | {(r, i): 5000 if g < 0.1 else 0 for r in RULES for i, g in enumerate(GRID)}, 1: {"n": 3} | {(r, i): 0 for r in RULES for i in range(len(GRID))}}
    cuts = select_cutoffs(counts, 0.05, 0.05)
    assert {v for (s, _), v in cuts.items() if s == 0} == {min(g for g in GRID if g >= 0.1)}
    assert not [k for k in cuts if k[0] == 1]  # three labels prove nothing


def test_quality_rules_with_cutoffs(spark):
    """Cutoffs and verdicts against counts taken row by row, with labels enough to prove some cutoffs."""
    rng = random.Random(12)
    data = []
    for i in range(3000):
        w = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(rng.choice([30, 150]))]
        if i % 10 == 0:
            w[5:20] = ["BUY!!"] * 15
        elif i % 31 == 0:
            w[0] = "Wow!"
        data.append((i, " ".join(w)))
    labels = [(i, 0 if i % 10 == 0 else 1 if i % 7 else None) for i in range(2800)]
    docs, table = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules(docs, table, 0.3, 0.1).collect()}
    good = {i for i, q in labels if q == 1}
    stratum = lambda r: sum(r.n_words >= x for x in BANDS)
    share = lambda r, rule: r[RULES[rule][0]] / max(1, r[RULES[rule][1]])
    counts = {}
    for s in {stratum(out[i]) for i in good if not out[i].base_failed}:
        rows = [out[i] for i in good if stratum(out[i]) == s and not out[i].base_failed]
        counts[s] = {"n": len(rows)} | {(rule, i): sum(share(r, rule) > g for r in rows) for rule in RULES for i, g in enumerate(GRID)}
    cuts = select_cutoffs(counts, 0.3, 0.1)
    assert len(cuts) > 6
    for r in out.values():
        assert r.kept == (not r.base_failed and not any(share(r, rule) > cut for (s, rule), cut in cuts.items() if s == stratum(r)))
    assert sum(not r.kept for i, r in out.items() if i % 10 == 0) > 250


def test_quality_rules_empty(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules(empty, none).count() == 0
    assert quality_rules(spark.createDataFrame([(1, None)], "doc_id long, text string"), none).first().kept is False


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["word", "other", "thing", "the"]) for _ in range(60)), 1) for i in range(1000, 1200)]
    bad = [(i, " ".join(rng.choice(["WORD!!", "OTHER!!", "$$$", "|"]) for _ in range(60)), 0) for i in range(1200, 1400)]
    d = spark.createDataFrame([x[:2] for x in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(1000, None), (None, 1)], "doc_id long, quality int")
    out = quality_scores(d, labels).collect()
    assert len(out) == 400 and any(r.held_out for r in out)
    assert all(r.predicted == (1 if r.doc_id < 1200 else 0) for r in out if r.held_out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    none = quality_scores(docs, labels.limit(0)).collect()
    assert len(none) == len(rows()) and {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality_scores(empty, labels).count() == 0


# ------------------------------------------------------------------ toxicity


def edit_one(a, b):
    if a == b:
        return 0
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b, strict=True)) == 1 else 2
    if abs(len(a) - len(b)) != 1:
        return 2
    a, b = sorted((a, b), key=len)
    return 1 if any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def test_levenshtein_automaton():
    terms, stems = ["idiot", "moron", "scum"], ["lowei"]
    auto = Automaton(terms, stems, {"idiot", "moron"})
    rng = random.Random(2)
    words = {"".join(rng.choice("idotmrnscuelw") for _ in range(rng.randint(1, 7))) for _ in range(3000)}
    for t in terms + stems:
        for i in range(len(t) + 1):
            words |= {t[:i] + t[i + 1 :], *(t[:i] + c + t[i:] for c in "xio"), *(t[:i] + c + t[i + 1 :] for c in "zmo")}
    words = sorted(w for w in words if w)
    text = " ".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    _, _, _, found, states = auto.hits(points, np.array([0, len(points)]))
    got = dict(zip(found.tolist(), auto.final[states].tolist(), strict=True))
    for i, w in enumerate(words):
        want = 1 if w in terms or w.startswith("lowei") else 2 if any(edit_one(w, t) == 1 for t in ("idiot", "moron")) else 0
        assert got.get(i, 0) == want, w


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    plain = ["the", "and", "river", "stone", "green", "walk", "house", "table", "under", "light"]

    def make(bad):
        w = [rng.choice(plain) for _ in range(30)]
        for _ in range(2 * bad):
            w[rng.randrange(30)] = rng.choice(["moronic", "dirtbag", "scumbag"])
        return " ".join(w)

    data = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    extra = [(1000, "you are a dirtbga no dirtbaag here under the light", 1), (1001, None, 0), (1002, "", 0), (1003, 'she said "dirtbag" was the word reported', 0)]
    d = spark.createDataFrame([x[:2] for x in data + extra], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity_scores(d, labels).collect()}
    assert all(out[i].predicted == y for i, _, y in data if out[i].held_out)
    assert out[1000].predicted == 1  # misspelled
    assert out[1001].score == out[1002].score < 0.3
    assert out[1003].score < out[0].score  # quoted
    assert toxicity_scores(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity_scores(empty, labels).count() == 0


# ------------------------------------------------------------------ n-gram Jaccard join


def brute_components(data, k, num, den):
    sets, parent = {}, {}
    for i, (d, text) in enumerate(data):
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i in sets:
        if data[i][0] is not None:
            least[find(i)] = min(least.get(find(i), data[i][0]), data[i][0])
    return collections.Counter((data[i][0], len(sets[i]), least.get(find(i)) if sets[i] else data[i][0]) for i in sets)


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 1024), (5, 80, 100, 1024), (2, 60, 100, 3)])
def test_jaccard_join(docs, k, num, den, block):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs, k, num, den, block).collect())
    assert got == brute_components([(r[0], r[1]) for r in rows()], k, num, den)


def test_jaccard_links_and_empty(spark, docs, empty):
    out = {r.doc_id: r for r in ngram_jaccard_join(docs, 4, 85, 100).where("doc_id is not null").collect()}
    assert out[0].n_links == 0 and out[0].class_id is None and out[3].class_id == out[4].class_id
    assert ngram_jaccard_join(empty).count() == 0


def test_overlaps_are_exact():
    rng = random.Random(4)
    for g in (2, 7, 60):
        common = [rng.getrandbits(60) for _ in range(80)]
        sets = [sorted({rng.choice(common) for _ in range(rng.randint(1, 70))} | {rng.getrandbits(60)}) for _ in range(g)]
        got = overlaps([np.array(s, np.uint64) for s in sets], cells=1 << 10, few=5)
        assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(g) for j in range(i))


def test_frequent_passages_and_small_flushes(spark):
    """Items that many sets hold, copies in all tasks, and items marked as held often by some tasks only."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    data = []
    for i in range(500):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 100]))]
        data.append((i, " ".join([*own, passage]) if i % 3 else " ".join(own)))
    data += [(1000 + i, data[i % 7][1]) for i in range(200)]
    data += [(2000 + i, data[i % 11][1] + f" x{i % 13}") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs, 4, 85, 100).collect())
    assert got == brute_components(data, 4, 85, 100)


def test_word_hashes_have_no_algebra():
    """A Thue-Morse word and its complement collide under polynomial hashes modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    words = [bytes(97 + b for b in bits), bytes(98 - b for b in bits)]
    data = np.frombuffer(b"".join(words), np.uint8)
    c = Chunk(data, np.array([0, 4096, 8192]))
    a, b = c.hashes(np.array([0, 4096]), np.array([4096, 8192]))
    assert a != b


# ------------------------------------------------------------------ suffix-array dedup


def brute_dedup(data, size, keep):
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0))
    where = collections.defaultdict(set)
    for i in order:
        b = (data[i][1] or "").encode()
        for j in range(len(b) - size + 1):
            where[b[j : j + size]].add((order.index(i), j))
    out = collections.Counter()
    for i in order:
        b = (data[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - size + 1):
            places = where[b[j : j + size]]
            if (len(places) > 1) if keep == "none" else (min(places) < (order.index(i), j)):
                gone[j : j + size] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[data[i][0], len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("keep", "hot"), [("none", 4096), ("first", 4096), ("none", 1), ("first", 1)])
def test_suffix_dedup(docs, keep, hot):
    data = [(r[0], r[1]) for r in rows()]
    if keep == "first":  # equal rows are one document there
        data = list(dict.fromkeys(data))
    got = collections.Counter(tuple(r) for r in suffix_array_dedup(docs if keep == "none" else docs.dropDuplicates(), 70, keep, hot_runs=hot).collect())
    assert got == brute_dedup(data, 70, keep)


def test_suffix_dedup_columns_and_empty(docs, empty):
    out = suffix_array_dedup(docs, 70, "first", with_text=True, pass_columns=True)
    assert out.columns == ["document", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert out.where("n_removed = 0 and document.text is not null and document.text <> kept_text").count() == 0
    assert suffix_array_dedup(empty).count() == 0


def test_longest_previous_factor():
    rng = random.Random(6)
    for _ in range(60):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
        order = sorted(range(len(s)), key=lambda i: s[i:])
        common = lambda i, j: next((n for n in range(len(s)) if s[i + n : i + n + 1] != s[j + n : j + n + 1] or i + n >= len(s) or j + n >= len(s)), 0)
        lcp = np.array([0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))])
        got = longest_previous_factor(np.array(order), lcp)
        assert {p: int(f) for p, f in zip(order, got, strict=True)} == {i: max((common(i, j) for j in range(i)), default=0) for i in range(len(s))}


# ------------------------------------------------------------------ tokens


def test_token_parquet(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = token_digests(read_tokens(spark, encode_to_parquet(docs, new_path(spark), path))).collect()
    data = sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, collections.Counter()
    for d, text in data:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert collections.Counter(tuple(r) for r in out) == want
    assert read_tokens(spark, encode_to_parquet(empty, new_path(spark), path)).count() == 0


def test_words_of_the_token_cache_are_exact():
    """Texts cut into words, of all kinds of marks and letters, against the library on whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = WordEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(17)
    bits = ["a", "the", "Nter", "don't", "we'll", "'s", "'", "é", "École", "1", "23", ".", ",", "...", "—", "…", "!?", " ", "  ", "\n", "\t", "\x0b", "\xa0", "<|endoftext|>", "<|", "\u0301", "ß", "İ", "ΣΑΣ", "中文", "😀", "²", "\x00", "K"]
    for n in (1, 3, 8, 30):
        for special in (False, True):
            samples = ["".join(x for x in (rng.choice(bits) for _ in range(rng.randint(0, n))) if special or "endof" not in x) for _ in range(400)]
            ids, counts = encoder.encode(pa.array([None, *samples, ""]))
            want = [library.encode(t, add_special_tokens=False).ids for t in ["", *samples, ""]]
            assert counts.tolist() == [len(x) for x in want]
            for t, got, x in zip(["", *samples, ""], np.split(ids, np.cumsum(counts)[:-1]), want, strict=True):
                assert got.tolist() == x, t


def test_token_file_format(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = encode_to_parquet(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))
    columns = {}
    for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet"):
        for i in range((meta := pq.ParquetFile(f).metadata).num_row_groups):
            for j in range(meta.num_columns):
                c = meta.row_group(i).column(j)
                columns.setdefault(c.path_in_schema, set()).update(c.encodings)
                assert c.has_column_index and c.has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"] and any("DICTIONARY" in e for e in next(v for k, v in columns.items() if k.startswith("ids")))


def test_sentencepiece_is_exact():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    fst, library = Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    alphabet = "aabcdeeinrst  \n\t.,'\"()<>=_-0123AÄéß中文😀"
    samples = [t for t in texts() if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [" " * 50, "<0x0A>", "<s>"]
    for s in samples:
        ids = fst.encode(s)
        assert ids == library.encode(s), s
        assert fst.decode(ids) == s
    samples += ["a\u2581 b", "\u2581", " \u2581\u2581 c", "x\n\n y"]
    ids, counts = fst.encode_all(pa.array([None, *samples]))
    for s, part in zip(["", *samples], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == library.encode(s), s


def _field(number: int, value) -> bytes:
    """A field of a protocol-buffer message."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("bpe", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("spec", [{}, {4: 0}, {3: 0, 4: 0}, {"map": 1}])
def test_sentencepiece_made_models(tmp_path, bpe, fallback, spec):
    """Models put together by hand, unigram and BPE, with pieces of the user, byte fallback and a character map, against the library."""
    import sentencepiece

    rng = random.Random(11)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback), ("USR", 0.0, 4), ("a\u2581b", 0.0, 4)]
    letters = "abcde\u2581"
    seen = {p[0] for p in pieces}
    for i in range(150):
        t = letters[i] if i < len(letters) else "".join(rng.choice(letters) for _ in range(rng.randint(2, 5)))
        if t not in seen:
            seen.add(t)
            pieces.append((t, float(-i) if bpe else -rng.randint(1, 60) / 4, 1))
    rules = dict(spec)
    data = b"".join(_field(1, _field(1, t.encode()) + _field(2, score) + _field(3, kind)) for t, score, kind in pieces)
    data += _field(2, _field(3, 2 if bpe else 1) + _field(35, int(fallback)))
    if rules.pop("map", None):
        data += sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    else:
        data += _field(3, b"".join(_field(k, v) for k, v in rules.items()))
    path = tmp_path / "made.model"
    path.write_bytes(data)
    fst, library = Transducer(str(path)), sentencepiece.SentencePieceProcessor(model_proto=data)
    for _ in range(1500):
        s = "".join(rng.choice(["a", "b", "c", "d", "e", " ", "  ", "USR", "a b", "x", "é", "\uff21", "\u2460", "\ufb01", "\u3000", "\n"]) for _ in range(rng.randint(0, 14)))
        assert fst.encode(s) == library.encode(s), s
        ids, counts = fst.encode_all(pa.array([s, None, s]))
        assert ids.tolist() == 2 * fst.encode(s) and counts[1] == 0


def test_sentencepiece_table(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_round_trip(docs, path)
    assert out.count() == len(rows()) and out.where("not round_trip").count() == 0
    assert sentencepiece_round_trip(empty, path).count() == 0


# ------------------------------------------------------------------ mixing


def test_mixing_meets_targets(spark, empty):
    rng = random.Random(8)
    kinds = {"x": ["foo", "bar", "baz"], "y": ["un", "deux", "trois"], "z": ["eins", "zwei", "drei"]}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 40))), k, 1.0) for i in range(600) for k in ["x" if i % 6 else "y" if i % 4 else "z"]]
    data += [(9001, None, "x", None), (9002, "", None, None), (None, "foo bar", None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, rate double")
    want = {"x": 0.4, "y": 0.4, "z": 0.2}
    model, _, totals = fit_mixture(d, targets=want)
    assert np.abs(totals["got"] - totals["want"]).max() <= 1e-3 * totals["have"].sum()
    rates = soft_mixing_rates(d, targets=want)
    assert rates.count() == len(data) and rates.where("rate < 0").count() == 0
    lang = dict(zip(model.domains, totals["want"] / totals["want"].sum(), strict=True))
    assert all(lang[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    mixed = mix_documents(d, keep_all=True)
    assert mixed.columns == d.columns and mixed.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
    assert soft_mixing_rates(empty).count() == 0 and mix_documents(empty).count() == 0
