"""Operators 4, 8, 9 and 10 against the tokenizers library."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from escarp.llm import bpe, bpe_codec, packing, token_counts, token_files

from .conftest import TEXTS

NAMES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


@pytest.fixture(scope="module")
def libraries():
    return {k: Tokenizer.from_file(P.path(v)) for k, v in NAMES.items()}


@pytest.fixture(scope="module")
def vocabularies():
    return {k: bpe.Vocabulary(P.path(v)) for k, v in NAMES.items()}


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def random_texts(n=400):
    r = random.Random(5)
    pick = "ab '\n\t.'strvelmd  é中1२ Ab"
    return ["".join(r.choice(pick) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x17F), r.randint(0x4E00, 0x4FFF)])) for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize("kind", NAMES)
def test_encoding_is_the_librarys(kind, libraries, vocabularies):
    coder, all_texts = bpe.Coder(vocabularies[kind]), TEXTS + random_texts()
    found = []
    for _, ids, counts in coder.encode_column(pa.array(all_texts, pa.string())):
        ends = np.cumsum(counts)
        found += [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]
    assert found == [expected(libraries[kind], t) for t in all_texts]


def test_long_texts_and_forgotten_words(libraries, vocabularies, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 50)
    monkeypatch.setattr(bpe, "UNIT", 700)
    text = " ".join(random_texts(200))
    coder = bpe.Coder(vocabularies["byte"])
    for _ in range(2):
        (_, ids, _), *_ = coder.encode_column(pa.array([text]))
        assert ids.tolist() == expected(libraries["byte"], text)


def long_texts(kind):
    """Unbroken words of 2 MB, and a text of 6 MB; a tenth for the second vocabulary."""
    r, k = random.Random(9), 1 if kind == "byte" else 10
    some = ["".join(r.choice("etaoinsrhldcumfpgwybvk") for _ in range(r.randint(1, 9))) for _ in range(700)]
    return {
        "ascii": "".join(r.choices(some, k=100_000 // k)),
        "letters": "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=40_000)),
        "period": "qz" * 20_000 + "abc" * 20_000,
        "run": "=" * 40_001 + "-" * 20_003,
        "cjk": "".join(chr(0x4E00 + int(r.paretovariate(0.5)) % 20_000) for _ in range(300_000 // k)),
        "cjk with marks": "".join("。" if r.random() < 0.02 else chr(r.randint(0x4E00, 0x9FA5)) for _ in range(500_000 // k)),
        "prose": " ".join(r.choices(some, k=1_000_000 // k)),
    }


@pytest.mark.parametrize("kind", NAMES)
def test_very_long_words_and_texts(kind, libraries, vocabularies):
    """Unbroken words of 2 MB and a text of 20 MB, in bounded memory and with the library's ids."""
    coder = bpe.Coder(vocabularies[kind])
    counter = token_counts.PrefixCounter(vocabularies["byte"]) if kind == "byte" else None
    for name, text in long_texts(kind).items():
        (_, ids, counts), *rest = coder.encode_column(pa.array([text]))
        want = expected(libraries[kind], text)
        assert not rest and counts.tolist() == [len(want)] and ids.tolist() == want, name
        if counter:
            assert counter.counts_of_column(pa.array([text]))[1].tolist() == [len(want)], name


def test_tiles_go_on_from_one_another(vocabularies, monkeypatch):
    """Small tiles, which seldom agree at once, give what side-by-side merging gives."""
    monkeypatch.setattr(bpe, "TILE", 7)
    monkeypatch.setattr(bpe, "TILES", 50)
    r = random.Random(2)
    for v in vocabularies.values():
        coder = bpe.Coder(v)
        for alphabet in ("ab", "aei=", "qzthe", "the of and"):
            raw = np.frombuffer("".join(r.choice(alphabet) for _ in range(900)).encode(), np.uint8).astype(np.int64)
            assert coder.long_word(raw).tolist() == coder.merge(raw, np.array([0, len(raw)]))[1].tolist()


def test_pair_check_is_exact(vocabularies):
    """Two tokens are compatible exactly if merging their bytes gives them back."""
    v, r = vocabularies["byte"], random.Random(3)
    coder = bpe.Coder(v)
    usable = v.prefix_values[v.prefix_values >= 0].tolist()
    a, b = (np.array([r.choice(usable) for _ in range(2000)]) for _ in range(2))
    for x, y, good in zip(a.tolist(), b.tolist(), coder.compatible(a, b).tolist()):
        raw = np.frombuffer(v.bytes[x] + v.bytes[y], np.uint8).astype(np.int64)
        merged = coder.merge(raw, np.array([0, len(raw)]))[1].tolist()
        assert good == (merged == [x, y])


def test_counts_at_every_prefix(libraries, vocabularies):
    counter = token_counts.PrefixCounter(vocabularies["byte"])
    for text in [t for t in TEXTS if t and len(t) < 120] + random_texts(25):
        counts = counter.prefix_counts(text)
        for i in range(1, len(text) + 1):
            assert counts[len(text[:i].encode()) - 1] == len(expected(libraries["byte"], text[:i]))
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(vocabularies["word"])


def test_codec(spark, texts, libraries):
    vocabulary = bpe_codec.shared_vocabulary(spark, P.path(NAMES["byte"]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r["doc_id"], len(ids := expected(libraries["byte"], r["text"])), sha(",".join(map(str, ids))), sha(r["text"] or "")) for r in texts.collect())
    assert Counter(map(tuple, bpe_codec.round_trip(texts, vocabulary).collect())) == want
    ids = bpe_codec.encode(texts, vocabulary)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((r["doc_id"], tuple(expected(libraries["byte"], r["text"]))) for r in texts.collect())
    assert Counter(map(tuple, bpe_codec.decode(ids, vocabulary).collect())) == Counter((r["doc_id"], r["text"] or "") for r in texts.collect())
    assert bpe_codec.round_trip(texts.limit(0), vocabulary).count() == 0


def test_token_counts_and_truncation(spark, texts, libraries):
    vocabulary = bpe_codec.shared_vocabulary(spark, P.path(NAMES["byte"]))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(expected(libraries["byte"], r["text"])), n > 20) for r in texts.collect())
    assert Counter(map(tuple, token_counts.token_counts(texts, vocabulary, 20).collect())) == want
    assert token_counts.token_counts(texts.limit(0), vocabulary, 20).count() == 0
    for r in token_counts.truncate(texts.where("doc_id < 4"), vocabulary, 5).collect():
        full = TEXTS[r["doc_id"]]
        best = max(i for i in range(len(full) + 1) if len(expected(libraries["byte"], full[:i])) <= 5)
        assert r["text"] == full[:best] and r["n_tokens"] == len(expected(libraries["byte"], full[:best]))


def test_files(spark, texts, libraries, tmp_path):
    vocabulary = bpe_codec.shared_vocabulary(spark, P.path(NAMES["byte"]))
    manifest = token_files.write(texts, vocabulary, f"file://{tmp_path}", end_id=2)
    stream = [i for r in sorted(texts.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)) for i in [*expected(libraries["byte"], r["text"]), 2]]
    assert sum(s["tokens"] for s in manifest) == len(stream)
    assert token_files.window(str(tmp_path), 0, 1 << 40).tolist() == stream
    assert token_files.window(str(tmp_path), 100, 333).tolist() == stream[100:433]
    at = 0
    rows = sorted(token_files.read(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert len(rows) == texts.count() and rows[0]["doc_id"] is None
    for r in rows:
        part = stream[at : at + r["n_tokens"]]
        assert r["start"] == at and part[-1] == 2 and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at += r["n_tokens"]
    assert token_files.round_trip(texts.limit(0), vocabulary, 2).count() == 0
    least = spark.createDataFrame([(-(1 << 63), "a b"), (None, "c"), ((1 << 63) - 1, None)], "doc_id bigint, text string")
    again = token_files.round_trip(least, vocabulary, 2).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in again] == [(None, 2), (-(1 << 63), 3), ((1 << 63) - 1, 1)]


def test_files_of_many_shards(spark, texts, libraries, tmp_path, monkeypatch):
    """Shards follow the bytes, and are read by small ranges, also where they can't be mapped."""
    monkeypatch.setattr(token_files, "READ_DOCS", 3)
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    vocabulary = bpe_codec.shared_vocabulary(spark, P.path(NAMES["byte"]))
    manifest = token_files.write(texts, vocabulary, f"file://{tmp_path}", end_id=2, shard_bytes=400)
    assert len(manifest) > 3
    stream = token_files.window(str(tmp_path), 0, 1 << 40).tolist()
    monkeypatch.setattr(token_files.os.path, "exists", lambda p: False)
    found = [(s["base"] + int(o), ids[o - offsets[0] : e - offsets[0]].tolist()) for s in manifest for docs, offsets, ids in token_files.documents(str(tmp_path), s, "<u2") for o, e in zip(offsets[:-1], offsets[1:])]
    assert len(found) == texts.count() and [i for _, ids in found for i in ids] == stream


@pytest.mark.parametrize("capacity", [16, 100])
def test_packing(spark, texts, libraries, capacity):
    vocabulary = bpe_codec.shared_vocabulary(spark, P.path(NAMES["word"]))
    rows = packing.packed(texts, vocabulary, capacity, end_id=1).collect()
    want = Counter()
    for r in texts.collect():
        ids = [*expected(libraries["word"], r["text"]), 1]
        want.update((r["doc_id"], k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert packing.packed(texts.limit(0), vocabulary, capacity, end_id=1).count() == 0


def test_plans_are_near_the_bound():
    """Never more sequences than best fit alone, and never fewer than the dual's bound, which is near."""
    r = random.Random(1)
    cases = {
        "uniform": (4096, [r.randint(1, 4096) for _ in range(3000)], 1.02),
        "log-normal": (4096, [min(4096, int(r.lognormvariate(6.5, 1.2)) + 1) for _ in range(20000)], 1.001),
        "clustered": (4096, [int(r.choice([300, 900, 1700, 2600]) + r.gauss(0, 60)) for _ in range(5000)], 1.12),
        "narrow": (4096, [r.randint(1250, 1500) for _ in range(5000)], 1.12),
        "thirds": (100, [34] * 300 + [33] * 600 + [50] * 10, 1.0),
        "three": (4096, [1400] * 9 + [1300] * 9 + [1396] * 9, 1.0),
    }
    for name, (capacity, sizes, most) in cases.items():
        histogram = dict(Counter(sizes))
        groups, bound = packing.plan(histogram, capacity)
        assert Counter(x for times, filled in groups for x in filled * times) == Counter(sizes), name
        assert all(sum(filled) <= capacity for _, filled in groups), name
        assert packing.sequences(groups) <= packing.sequences(packing.best_fit([], dict(histogram), capacity)), name
        assert math.ceil(sum(sizes) / capacity) <= bound <= packing.sequences(groups) <= bound * most, name
    assert packing.plan({}, 10) == ([], 0)


def test_knapsack_is_exact():
    r = random.Random(4)
    for _ in range(50):
        sizes = np.array(sorted(r.sample(range(1, 40), r.randint(1, 12))))
        values = np.array([r.random() for _ in sizes])
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes.tolist(), values.tolist()) if s <= c)])
        found = packing.knapsack(sizes, values, 60)
        assert sum(sizes[k] * a for k, a in found.items()) <= 60
        assert sum(values[k] * a for k, a in found.items()) == pytest.approx(best[60])
