"""The Jaccard join, its parts, and the pipeline against brute force."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from conftest import SF_SMALL
from revisio.llm import jaccard as J
from revisio.llm.graph import components
from revisio.llm.shingles import shingle_sets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "A", "b", "é", "É", "x1", "\t", "\n", " ", "\xa0", "\x1c", "日"]), max_size=20).map(" ".join), max_size=5),
       st.integers(1, 5))
def test_shingle_sets_are_sets_of_word_tuples(texts, size):
    got = shingle_sets([*texts, None], size)
    expect = [brute.shingles(t, size) for t in [*texts, None]]
    assert [len(g) for g in got] == [len(e) for e in expect]
    names = {}
    for g, e in zip(got, expect):
        assert (np.diff(g.astype(object)) > 0).all()
    for a in range(len(expect)):  # equal parts get equal hashes, others do not
        for b in range(a):
            names[a, b] = len(np.intersect1d(got[a], got[b]))
            assert names[a, b] == len(expect[a] & expect[b])


def _near_copies(seed, n):
    """Groups of near copies at and around the threshold, exact copies, shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(200))
    passage = [word() for _ in range(30)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 25, 60]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text += passage
            out.append(" ".join(text).upper() if rng.random() < 0.1 else "\n".join(text))
            if rng.random() < 0.3:
                out.append(out[-1])
    return out[:n]


@pytest.mark.parametrize("size,percent,pairs,gain,broadcast", [(3, 90, 2, 0.3, 500_000), (5, 80, 0, 0.01, 0), (2, 60, 10**9, 0.3, 0)])
def test_components_by_brute_force(spark, monkeypatch, size, percent, pairs, gain, broadcast):
    monkeypatch.setattr(J, "PAIRS_PER_ROW", pairs)
    monkeypatch.setattr(J, "STAR_GAIN", gain)
    monkeypatch.setattr(J, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(J, "MAX_SHARED", broadcast)
    rows = [(i * 3 % 401, t) for i, t in enumerate(_near_copies(size, 250))] + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, sig string, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, size, percent).collect()}
    assert got == brute.jaccard_components(rows, size, percent)
    kept = J.keep_one(docs, size, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        text = list(base)
        text[i % 80] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, 3, 90).collect()}
    assert got == brute.jaccard_components(rows, 3, 90)


def test_long_texts_that_share_passages_are_no_candidates(spark, monkeypatch):
    """Large sets with a common passage among their rarest shingles are told apart before they are joined into pairs."""
    rng = random.Random(5)
    passages = [[f"p{i}w{rng.randrange(10**6)}" for _ in range(600)] for i in range(40)]
    rows = [(i, " ".join(w for p in rng.sample(passages, 10) for w in p)) for i in range(100)]
    seen, verified = [], J._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(J, "_verified", counted)
    monkeypatch.setattr(J, "PAIRS_PER_ROW", 10**9)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}
    assert len(seen) == 2 and seen[1] < 20  # the small groups' pairs, and all others


def test_slots_follow_the_size_of_a_set(spark):
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 2040, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:-5], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
    x, y = J.parities(a), J.parities(b)
    assert len(x) == 32 and len(y) == 64 and (J.parities(a[:3]).size, J.parities(rng.integers(0, 2**63, 10**5, dtype=np.uint64)).size) == (32, 256)
    wide = np.zeros(64 * 64, dtype=np.uint8)  # the smaller set in the larger one's slots
    np.bitwise_xor.at(wide, (a >> np.uint64(20)).astype(np.int64) % len(wide), 1)
    assert (np.packbits(wide).view(np.int64).reshape(2, 32)[0] ^ np.packbits(wide).view(np.int64).reshape(2, 32)[1] == x).all()
    row = spark.createDataFrame([(x.tolist(), y.tolist(), x[:8].tolist())], "x array<long>, y array<long>, z array<long>")
    apart = row.select(J._apart(row.x, row.y), J._apart(row.y, row.x), J._apart(row.x, row.x)).first()
    folded = np.bitwise_xor.reduce(y.reshape(2, 32), axis=0)
    assert tuple(apart) == (np.bitwise_count(x ^ folded).sum(), np.bitwise_count(x ^ folded).sum(), 0)
    assert 0 < apart[0] <= len(np.setxor1d(a, b))
    text = [f"w{i}" for i in range(2045)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text, *[f"v{i}" for i in range(30)]])), (3, " ".join(text[::-1]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs, 5, 80).collect()} == {1: 1, 2: 1, 3: 3}


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "alone it stands here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in J.jaccard_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (1, 3, 1), (2, 4, 1), (None, 4, 1), (None, 2, None)], key=str)
    kept = sorted((tuple(r) for r in J.keep_one(docs, 3, 90).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (1, "other words are here now"), (None, "alone it stands here")], key=str)
    assert J.jaccard_components(docs.limit(0), 3, 90).count() == 0 and J.keep_one(docs.limit(0), 3, 90).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    names = [rng.randbytes(4).hex() for _ in range(300)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(180)] + list(zip(names[:60], names[1:61]))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[find(a)] = find(b)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    groups = {}
    for x in got:
        groups.setdefault(find(x), set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len({*map(tuple, map(sorted, groups.values()))}) == len(groups)


def test_pipeline(spark):
    """The whole of it: each stage's decision repeated in plain Python."""
    import corpus_pipeline as C
    from revisio.llm.common import new_folder, read_table
    docs, names = read_table(spark, SF_SMALL, "documents"), [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "benchmark_decontamination", "packing"]
    columns, kept = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        path = new_folder(spark, "test-stage")
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= set(before)
        kept.append(len(after))
        if name == "quality_rules":
            for i, text in before.items():
                e = brute.quality_stats(text)
                if e["n_words"] < 10 or 100 * e["n_repeat_words"] > 20 * e["n_words"]:
                    assert i not in after
        if name == "near_duplicates":
            assert after == {c for _, c in brute.jaccard_components(list(before.items()), 5, 80).values()}
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in read_table(spark, SF_SMALL, "benchmark").select("item_id", "text").collect()]
            assert after == {d for d, n, hit, _ in brute.contamination(list(before.items()), items) if not (hit and 20 * hit >= n)}
    pieces = C.run(spark, SF_SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == after
    assert kept[0] > 100
