"""Operator 12 against plain rounds over all distances, in Python integers."""
import hashlib
import math
import random

import numpy as np
import pytest

from revisio.llm import vector_codes as vc

TABLE = "vec_id long, embedding array<float>, label int, code int, q string"


def brute(rows, rounds=6):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = [len(r[1]) for r in rows]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if rows else 0
    rows = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], l) for i, v, l in rows if len(v) == size]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    places = vc.cuts(size)
    books = [[q[lo:hi] for _, q, _ in rows[:16]] for lo, hi in places]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (lo, hi) in enumerate(places):
            groups = {}
            for _, q, _ in rows:
                groups.setdefault(nearest(q[lo:hi], books[p])[1], []).append(q[lo:hi])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    found = [[nearest(q[lo:hi], books[p]) for p, (lo, hi) in enumerate(places)] for _, q, _ in rows]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(rows, errors):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by[label], digest) for (i, _, label), f, e in zip(rows, found, errors)), key=str)


def run(spark, rows, partitions=3):
    table = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], TABLE).repartition(partitions)
    coded, books = vc.compress(table)
    out = vc.with_label_errors(coded).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, vc.codebooks_digest(books)) for r in out), key=str)


def vectors(n, size, seed=0, centres=5):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(centres)]
    return [(i * 3 - 40, [m + rng.gauss(0, 0.2) for m in rng.choice(middle)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    vectors(400, 32), vectors(300, 16, 1, 40), vectors(9, 8, 2), vectors(60, 13, 3),
    [(i, [float(i % 3)] * 8, i % 2) for i in range(50)],  # ties and equal vectors
    vectors(50, 8, 4) + [(7, [0.5] * 8, 1)] * 200 + [(None, [0.25] * 8, None), (None, None, 1), (5, [None] * 8, 1), (5, [float("nan")] * 8, 1),
                                                    (5, [float("inf")] * 8, 1), (5, [0.1] * 7, 1), (7, [-0.5] * 8, 3)],
    [(3, [0.5] * 8, None)], []])
def test_equals_plain_rounds(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_bounds_decide_most_parts_and_never_wrongly():
    rng = np.random.default_rng(0)
    x = rng.integers(-3000, 3000, (2000, 6))
    old = x[:16].copy()
    state = vc.Bounds.exact(x, old, 4)
    skipped, b = 0, 4
    for step in range(8):
        new = old + rng.integers(-400 // (step + 1), 400 // (step + 1) + 1, old.shape)
        moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float))
        state.moved(np.where(moved > 0, vc._up(moved), np.float32(0)).astype(np.float32), b)
        needed = state.assign(x, new)
        d2 = vc._squared(x, new[None])
        assert (state.code == d2.argmin(axis=1)).all()
        d = np.sqrt(d2)
        own = np.take_along_axis(d, state.code[:, None].astype(int), axis=1)[:, 0]
        assert (state.upper >= own).all() and (state.lower <= np.take_along_axis(d, state.near.astype(int), axis=1)).all()
        named = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(named, np.concatenate([state.code[:, None], state.near], axis=1).astype(int), True, axis=1)
        assert (np.where(named, np.inf, d).min(axis=1) >= state.outer).all()
        skipped, old, b = skipped + (needed == -1).sum(), new, max(2, b - step % 2)
    assert skipped > 2000


def test_huge_components_are_held(spark):
    rows = [(i, [float(i), -3e38, 3e38, 0.0, 0.0, 0.0, 0.0, 1.0], None) for i in range(40)]
    got = run(spark, rows)
    assert len(got) == 40 and all(r[2] >= 0 for r in got)


def test_registered_query(spark):
    got = sorted((tuple(r) for r in vc.op12_vector_codes(spark, "/root/testdata/sf0.001").collect()), key=str)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert got == brute([(r["vec_id"], r["embedding"], r["label"]) for r in table])
