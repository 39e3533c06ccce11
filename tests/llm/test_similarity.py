"""Operators 1, 5 and 6, and components, against brute force."""

import random

import numpy as np
import pytest

from escarp.llm import cover_tree, minhash, vptree
from escarp.operators import components


def groups(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components(spark, one_task):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    frame = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    found = {x["id"]: x["component"] for x in components.components(frame, one_task).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert found == {k: v for k, v in groups([p for p in links if p[0] != p[1]], ids).items()}
    assert components.components(frame.limit(0), one_task).count() == 0


def brute(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, groups(links, list(sets))


@pytest.fixture(scope="module")
def near_texts():
    """Copies, near copies about the threshold, one large group of them, short and empty texts."""
    r, out = random.Random(4), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for _ in range(25):
        base = [word() for _ in range(r.randint(30, 90))]
        for _ in range(r.randint(1, 4)):
            copy = base[:]
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    base = [word() for _ in range(60)]
    for _ in range(150):
        copy = base[:]
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = word()
        out.append("  ".join(copy).upper() if r.random() < 0.1 else " ".join(copy))
    out += ["one", "ONE", "one two", "one  two", "", None, "   ", "a b c d", "x " * 5000, "x " * 300, out[0], out[0]]
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "percent", "small"), [(3, 85, 64), (5, 80, 8), (3, 85, 4)])
def test_minhash(spark, near_texts, words, percent, small):
    sets, want = brute(near_texts, words, percent)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in near_texts] + [(0, near_texts[0][1], "again", 2), (None, "no id at all", "x", 1)], "doc_id bigint, text string, node string, n int")
    rows = minhash.near_duplicates(frame, words, percent, small=small).collect()
    assert len(rows) == len(near_texts) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_minhash_of_very_long_texts(spark, monkeypatch):
    """Texts of many hashing groups, and words of more than one, have the sets of short ones."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 8))) for _ in range(400)] + ["q" * 5000]
    long = [" ".join(r.choices(words, k=900)) for _ in range(2)]
    texts = [(0, long[0]), (1, long[0] + " end"), (2, long[1]), (3, "q" * 5000), (4, "q" * 5001)]
    data = np.frombuffer("".join(t for _, t in texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in texts])))
    monkeypatch.setattr(minhash, "UNIT", 300)
    found = [len(minhash.shingles(data[a:b], np.array([0, b - a]), 3)[0]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert found == [len(s) for s in brute(texts, 3, 85)[0].values()]
    sets = [minhash.shingles(data[a:b], np.array([0, b - a]), 3)[0] for a, b in zip(offsets[:-1], offsets[1:])]
    assert len(np.setdiff1d(sets[0], sets[1])) == 0 and sets[3][0] != sets[4][0]


def test_minhash_keeps_one_of_each_group(spark, near_texts):
    _, want = brute(near_texts, 5, 80)
    frame = spark.createDataFrame([(i, t, "x") for i, t in near_texts] + [(0, near_texts[0][1], "again"), (None, "no id", "x")], "doc_id bigint, text string, n string")
    kept = minhash.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i, c in want.items() if i == c)
    assert kept.where("doc_id is null").count() == 1
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(1, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    x = minhash.sketches([a, b, a[:3], a[:1]], 256)
    assert (x != ~np.uint64(0)).all()
    assert abs((x[0] == x[1]).mean() - 1500 / 2500) < 0.12


def vectors(seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, x.tolist(), int(i % 3)) for i, x in enumerate(r.normal(size=(150, 16)))]
    base = r.normal(size=16)
    rows += [(200 + i, (base + r.normal(scale=0.12, size=16)).tolist(), 1) for i in range(120)]
    rows += [(400 + i, (base * (i + 1)).tolist(), 1) for i in range(5)] + [(410, base.tolist(), 2), (411, base.tolist(), None)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [], [1e-300] * 16, [1e300] * 16]
    return rows + [(500 + i, x, 1) for i, x in enumerate(bad)]


def is_usable(x):
    return x is not None and len(x) > 0 and None not in x and np.isfinite(x).all() and np.any(np.array(x) != 0)


@pytest.mark.parametrize("block", [1024, 25])
def test_cover_tree(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(i, x, label, "clash", 7) for i, x, label in rows], "vec_id bigint, embedding array<double>, label int, unit string, cell int")
    unit = {i: (np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max()), label) for i, x, label in rows if is_usable(x) and label is not None}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    want = groups(links, [i for i, *_ in rows])
    found = cover_tree.near_duplicates(frame, 0.98, block=block).collect()
    assert len(found) == len(rows) and len(links) > 1000
    for r in found:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(i in p for p in links), want[i], want[i] == i)
    assert cover_tree.near_duplicates(frame.limit(0)).count() == 0


def test_cover_tree_with_text_labels(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], "x y"), (2, [2.0, 0.0], "x y"), (3, [1.0, 0.0], "z"), (4, [1.0, 0.0], None)], "vec_id bigint, embedding array<double>, label string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(frame, block=1).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def nearest(rows, k):
    good = {i: np.array(x) for i, x, _ in rows if is_usable(x)}
    out = {}
    for q in good:
        if q % 5 == 0:
            scored = sorted((-float((good[q] * x).sum()), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize(("shard", "block"), [(10_000, 8192), (40, 8192), (20, 7)])
def test_vantage_trees_are_exact_at_factor_one(spark, shard, block, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    rows = vectors()
    rows += [(600 + i, rows[0][1], 0) for i in range(12)]  # ties
    frame = spark.createDataFrame([(i, x, 5) for i, x, _ in rows] + [(rows[1][0], rows[1][1], 5)], "vec_id bigint, embedding array<double>, rank int")
    found: dict = {}
    for r in sorted(vptree.nearest(frame, frame.where("vec_id % 5 = 0"), 6, shard=shard, block=block).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {q: x for q, x in nearest(rows, 6).items() if x}
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t, rel=1e-12) for q in want for (_, s), (_, t) in zip(found[q], want[q]))
    assert vptree.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_a_larger_factor_loses_little(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 8)) * 4
    x = centres[r.integers(0, 30, 1500)] + r.normal(size=(1500, 8))
    tree = vptree.VantageTree(np.hstack([x, np.sqrt((x**2).sum(axis=1).max() - (x**2).sum(axis=1))[:, None]]), leaf=16)
    exact, loose = (vptree.Search(tree, x, np.arange(1500), x[:50], np.arange(50), np.full(50, -np.inf), 10, f).best for f in (1.0, 1.1))
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose)]) >= 0.9


def test_recall_at_a_larger_factor(spark, sf):
    """On the embeddings table, with shards that are passed over."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact, loose = ({(r["query_id"], r["vec_id"]) for r in vptree.nearest(rows, rows.where("vec_id % 20 = 0"), 20, factor=f, shard=50).collect()} for f in (1.0, 1.1))
    assert len(exact & loose) >= 0.9 * len(exact)
