"""Language identification and the quality vote: held-out accuracy and cases."""
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from conftest import SF_SMALL
from revisio.llm import language_id as L
from revisio.llm import quality_knn as K
from revisio.llm.common import read_table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocabulary = {"▁a": 0, "b": 1, "▁ab": 2, "c": 3, "bc": 4}
    prob = np.array([[.1], [.2], [.3], [.15], [.05], [1e-3], [0]])
    lattice = L.Lattice(vocabulary)
    got = lattice.forward(lattice.edges(["▁abc", "▁a", "▁axc"]), prob)[:, :, 0]
    unknown = 1e-3
    # "▁" and "a" are no pieces here: each may stand as an unknown character.
    assert np.isclose(got[0, 4], .1 * .2 * .15 + .3 * .15 + .1 * .05 + unknown * unknown * (.2 * .15 + .05))
    assert np.isclose(got[1, 2], .1 + unknown * unknown)
    assert np.isclose(got[2, 4], (.1 + unknown * unknown) * unknown * .15)


def test_long_words_are_scored_in_parts():
    assert L.parts_of("ab" * 40) == [L.MARK + "ab" * 16, "ab" * 16, "ab" * 8]
    model = {"langs": ["x"], "prob": np.array([[.5], [.25], [1e-3], [0]]), "pieces": "none"}
    L._VOCABULARIES["none"] = {"a": 0, L.MARK: 1}
    scorer = L.Scorer(model)
    scorer.score(["a" * 70 + " a"])
    assert np.isclose(scorer.rows[scorer.index["a" * 70], 0], 70 * np.log(.5) + np.log(.25))


def test_expected_counts_by_enumeration():
    vocabulary = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    prior = np.array([[.2], [.3], [.1], [.25], [.15], [1e-7], [0]])
    cuts = [((0, 1, 2), .2 * .3 * .1), ((0, 3), .2 * .25), ((4, 2), .15 * .1)]
    total = sum(p for _, p in cuts)
    expect = np.zeros(7)
    for pieces, p in cuts:
        for x in pieces:
            expect[x] += 3 * p / total
    got = L.expected_counts(L.Lattice(vocabulary), [("ab", np.array([3.0]))], prior)[:, 0]
    assert np.allclose(got, expect, atol=1e-4)


def test_languages_are_told_apart(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = L.op3_language_id(spark, SF_SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(out) == docs.filter(held).count()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    train = spark.createDataFrame([(1, "the house and the tree", "en"), (2, "das Haus und der Baum", "de"), (3, None, "fr"), (4, "un arbre", None)],
                                  "doc_id long, text string, lang string")
    model = L.learn(train, PIECES)
    assert model["langs"] == ["de", "en"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? ½ Ⅷ"), (4, "the tree"), (4, "the tree"), (5, "und das " * 20000), (6, "日本"), (7, "x" * 300)],
                                 "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in L.predict(docs, model, F.lit(False)).collect()]
    pred = {d: p for d, _, p, _ in got}
    assert len(got) == 8 and [pred[i] for i in (1, 2, 3)] == ["und"] * 3 and pred[4] == "en" and pred[5] == "de"
    assert all(s == 0 for d, _, p, s in got if p == "und")
    empty = L.learn(train.limit(0), PIECES)
    assert {r.lang_pred for r in L.predict(docs, empty, F.lit(False)).collect()} == {"und"}


def _corpus(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiklmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 80))]
        low = i % 5 == 0
        rows.append((i, " ".join(w + rng.choice(["***", "$$$", "%%%"]) if low else w for w in words)))
        labels.append((i, 0 if low else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(3, None), (4, 5)], "doc_id long, quality int")


def test_quality_vote_on_held_out(spark):
    docs, labels = _corpus(spark)
    model = K.learn(docs, labels.filter("doc_id % 3 <> 0"))
    rows = K.score(docs, model, F.col("doc_id") % 3 == 0).collect()
    assert len(rows) == 400
    assert all(r.predicted == (r.doc_id % 5 != 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    kept = K.keep_good(docs.selectExpr("'x' as score", "text", "doc_id"), model)
    assert kept.columns == ["score", "text", "doc_id"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_quality_cases(spark):
    docs, labels = _corpus(spark, 60)
    model = K.learn(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, " \n"), (4, "ab cd " * 30000)], "doc_id long, text string")
    rows = K.score(odd, model, F.lit(False)).collect()
    assert len(rows) == 5 and all(abs(r.score - model["share"]) < 1e-6 for r in rows if r.doc_id < 4)
    assert K.score(odd.limit(0), model, F.lit(False)).count() == 0
    none = K.learn(docs, labels.limit(0))
    assert {r.score for r in K.score(odd, none, F.lit(False)).collect()} == {0.5}


def test_vote_by_hand():
    model = {"share": .5, "project": np.eye(2, dtype=np.float32), "vectors": np.array([[1, 0], [0, 1], [.6, .8]], np.float32), "y": np.array([1, 0, 0], np.float32)}
    got = K.vote(model, np.array([[1, 0], [0, 0]], np.float32), neighbours=2)
    assert np.allclose(got, [1 / (1 + .6 ** 4), .5])


def test_long_words_count_whole():
    head = "x" * 64
    tails = ["", "9" * 40, "9" * 400, "AbC-" * 300]
    rows = K.Terms().rows([head + t for t in tails] + ["漢字、" * 500 + "END9", "漢字、" * 500])
    assert len({r[:K.FORMS + K.PAIRS].tobytes() for r in rows}) == len(rows)  # what stands behind the head tells in forms and pairs
    parts = K.words_of(" a\x1c" + "漢" * 150 + "　b ")
    assert [len(p) for p in parts] == [1, 64, 64, 22, 1] and "".join(parts) == "a" + "漢" * 150 + "b"
    assert K.words_of("ab  c\td e " + "y" * 64) == ["ab", "c", "d", "e", "y" * 64]
    assert K.form("a" * 70 + "9B") == "a0A"


def test_sample_keeps_rare_languages(spark):
    rows = [(i, "common", f"text {i}") for i in range(3000)] + [(5000 + i, "rare", f"seldom {i}") for i in range(3)] \
        + [(6000 + i, "rare", None if i % 2 else "- -") for i in range(500)] + [(9000, None, "x"), (None, "common", "y")] \
        + [(8000, "copies", "one id")] * 50
    train = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = L.sample(train, 40).collect()
    assert sorted(r.doc_id for r in got if r.lang == "rare") == [5000, 5001, 5002]
    assert "copies" in {r.lang for r in got} and sum(r.lang == "common" for r in got) == 19
    assert sorted(r.doc_id for r in L.sample(train.repartition(7), 40).collect()) == sorted(r.doc_id for r in got)
    assert L.sample(train, 10_000).filter("lang = 'common'").count() == 3000
    assert L.sample(train.limit(0), 40).count() == 0
    assert set(L.learn(L.sample(train, 2), PIECES)["langs"]) == {"common", "rare", "copies"}
    assert L.quotas({"a": 1, "b": 100, "c": 9}, 30) == {"a": 1, "c": 9, "b": 20}


def test_frequencies_cover_all_documents(spark):
    texts = ["a a b", "a", "", None, "a 漢字"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    n, having = K.document_frequencies(docs)
    assert n == 150 and (having == (K.Terms().rows(texts) > 0).sum(axis=0)).all()
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    few, more = (K.learn(d, labels) for d in (docs.filter("doc_id < 2"), docs))
    assert (few["y"] == more["y"]).all() and not np.allclose(few["project"], more["project"])
    assert K.document_frequencies(docs.limit(0))[0] == 0


def test_repeated_ids_are_cut_in_a_fixed_order(spark):
    rows = [(1, f"word{i} " * (i % 7 + 1) + "x" * i) for i in range(60)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    models = []
    for parts, backwards in ((1, False), (1, True), (7, False)):
        docs = spark.createDataFrame(rows[::-1] if backwards else rows, "doc_id long, text string").repartition(parts, "text")
        models.append(K.learn(docs, labels, max_labelled=2))
    assert all(len(m["y"]) == 8 and np.array_equal(m["vectors"], models[0]["vectors"]) for m in models)


def test_no_piece_is_dropped():
    pieces = L.load_pieces(PIECES)
    assert {"▁international", "▁professional", "▁relationship", "▁construction"} <= set(pieces)
    edges = L.Lattice(pieces).edges(["▁international"])
    assert edges[0, 14, 13] == pieces["▁international"]


def test_segmentations_across_parts(monkeypatch):
    names = [L.MARK, L.MARK + "a", "a", "b", "ab", "ba", "abab", "babba"]
    vocabulary = {p: i for i, p in enumerate(names)}
    prob = np.random.default_rng(3).uniform(.01, .2, (len(names) + 2, 3))
    prob[-1] = 0
    prior, rand = prob[:, :1], random.Random(4)
    words = ["".join(rand.choice("aabbx") for _ in range(n)) for n in (1, 2, 5, 9, 17, 30, 31, 30)]
    counts = [(w, np.array([i + 1.0, 2.0])) for i, w in enumerate(words)]
    L._VOCABULARIES["parts"] = vocabulary

    def scores():
        scorer = L.Scorer({"langs": ["x", "y", "z"], "prob": prob, "pieces": "parts"})
        scorer.score([" ".join(words)])
        return np.stack([scorer.rows[scorer.index[w]] for w in words])

    whole, uses = scores(), L.expected_counts(L.Lattice(vocabulary), counts, prior)
    for chars in (1, 3, 8):
        monkeypatch.setattr(L, "WORD_CHARS", chars)
        assert np.allclose(scores(), whole)
        assert np.allclose(L.expected_counts(L.Lattice(vocabulary), counts, prior), uses)
    monkeypatch.undo()
    uses = L.expected_counts(L.Lattice(vocabulary), [("ab" * 3000, np.ones(1))], prior)  # below the smallest float
    assert np.isclose(sum(uses[i, 0] * len(p) for i, p in enumerate(names)) + uses[-2, 0], 6001)
