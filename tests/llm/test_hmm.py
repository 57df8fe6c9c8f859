"""Operator 11: counts and base scores by brute force, the recursions by enumeration."""
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from revisio.llm import hmm
from tests.llm.brute import SPACE_WORD, lower_ascii

DOCS = "doc_id long, text string, lang string, n bigint, h int, other string"


def model(states=3, classes=5, seed=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random(states), 0), norm(rng.random((states, states)), 1),
                     norm(rng.random((classes, states)), 0))


def paths(seq, start, m):
    """All state paths with their joint probability."""
    for path in itertools.product(range(len(start)), repeat=len(seq)):
        p = start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        yield path, p


def test_likelihood_is_the_sum_over_all_paths_whole_or_in_pieces():
    m = model()
    seqs = [np.asarray(x) for x in ([1], [0, 2, 4], [3, 3, 1, 0, 2, 4, 1], [2, 1], [4, 4, 4, 4, 4, 4])]
    want = [math.log(sum(p for _, p in paths(s, m.start, m))) for s in seqs]
    assert np.allclose(hmm.log_likelihoods(seqs, m), want)
    assert np.allclose(hmm.log_likelihoods(seqs, m, piece=2, long=3), want)
    rng = np.random.default_rng(0)
    long = [rng.integers(0, 5, n) for n in (1, 700, 64, 3001)]
    assert np.allclose(hmm.log_likelihoods(long, m), hmm.log_likelihoods(long, m, piece=50, long=60))


def test_expected_counts_are_those_over_all_paths():
    m = model()
    seqs, first = [np.asarray(x) for x in ([0, 2, 4], [3, 1], [1, 1, 0, 2], [4])], [True, False, True, True]
    start, moves, emitted, log = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for s, f in zip(seqs, first):
        every = list(paths(s, m.start if f else m.share, m))
        total = sum(p for _, p in every)
        log += math.log(total)
        for path, p in every:
            start[path[0]] += f * p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for x, a in zip(s, path):
                emitted[x, a] += p / total
    got = hmm.expectations(seqs, np.asarray(first), m)
    for a, b in zip(got, (start, moves, emitted, log)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def brute_base(rows):
    tokens = [SPACE_WORD.findall(lower_ascii(t or "")) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for ws, x in zip(tokens, held) if not x for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, x, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
                   for (i, _), x, ws in zip(rows, held, tokens)), key=str)


ROWS = [(i, f"the cat {'sat ' * (i % 7)} on Word{i % 50}\tunique{i}\nÄrger") for i in range(120)] + [
    (None, "null id the cat"), (200, None), (201, ""), (202, " \n\t"), (7, "the cat sat"), (7, "the cat sat"), (300, "rare rare x" + " lone" * 9000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in rows], DOCS)


@pytest.mark.parametrize("head, known", [(hmm.HEAD, hmm.KNOWN), (8, 16), (4, 0)])
def test_base_columns_equal_brute_force(spark, head, known):
    got = hmm.hmm_scores(frame(spark, ROWS), head=head, known=known, states=2, rounds=2).collect()
    want = brute_base(ROWS)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert sorted(x[:5] for x in map(lambda r: (str(r[0]), *r[1:]), got)) == sorted(x[:5] for x in map(lambda r: (str(r[0]), *r[1:]), want))
    key = lambda r: (str(r[0]), r[2], r[5])
    assert np.allclose([r[5] for r in sorted(got, key=key)], [r[5] for r in sorted(want, key=key)], rtol=1e-9)


def test_score_does_not_depend_on_what_is_broadcast(spark):
    a = hmm.hmm_scores(frame(spark, ROWS), head=8, known=1 << 20, states=2, rounds=2).collect()
    b = hmm.hmm_scores(frame(spark, ROWS).repartition(3), head=8, known=16, states=2, rounds=2).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    assert np.allclose([r.score for r in sorted(a, key=key)], [r.score for r in sorted(b, key=key)], rtol=1e-5)


def test_probabilities_of_all_words_sum_to_one(spark):
    docs = hmm._texts(frame(spark, ROWS))
    counts = hmm.word_counts(docs, ~docs["held_out"])
    v = hmm.vocabulary(counts, 10, head=8)
    words = counts.toPandas()
    h, n = words["h"].to_numpy().view(np.uint64), words["n"].to_numpy()
    count, class_ = v.look_up(h)
    assert (count == n).all() and class_.min() >= 1 and (np.bincount(class_)[1:9] == 1).all()
    inside = np.zeros(len(v.shares))
    slot = class_ > v.head
    np.add.at(inside, class_[slot], 10 ** (np.log10(count[slot] + hmm.ADD) - v.rest_log[class_[slot] - 1 - v.head]))
    unseen = np.where(np.arange(len(v.shares)) > v.head, hmm.ADD / 10 ** np.concatenate([np.zeros(1 + v.head), v.rest_log]), 1.0)
    assert np.allclose(inside[v.head + 1:] + unseen[v.head + 1:], 1.0) and math.isclose(v.shares.sum(), 1.0)


def test_empty_and_untrained_tables(spark):
    empty = frame(spark, []).select("doc_id", "text")
    assert hmm.hmm_scores(empty).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = hmm.hmm_scores(frame(spark, [(held, "a b")]), states=2).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


def test_training_raises_the_likelihood_and_held_out_texts_beat_the_base(spark):
    docs = hmm._texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    counts = hmm.word_counts(docs, ~docs["held_out"])
    v = hmm.vocabulary(counts, docs.filter("not held_out").count())
    code = hmm.coded(docs, v).cache()
    m, history = hmm.learn(code, v, rounds=6)
    assert all(b > a for a, b in zip(history, history[1:]))
    rows = hmm.scored(code, v, m).filter("held_out").selectExpr("sum(log + rest_log) as s", f"sum(known_log - n_tokens * {v.base}) as b").first()
    assert rows.s > rows.b
