"""Counts, stored ids and packing against the tokenizers library itself."""
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revisio.llm.common import new_folder
from revisio.llm.packing import cut_lengths, harmonic_packing
from revisio.llm.token_counts import Counter, token_counts
from revisio.llm.token_store import read_tokens, token_digest, write_tokens
from revisio.llm.units import ByteLists, ByteUnits, WordUnits

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_TOK, WORD_TOK = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
# A small memo, so that eviction is tested too.
BYTE_UNITS, WORD_UNITS, COUNTER = ByteUnits(BYTE, 50), WordUnits(WORD, 50), Counter(BYTE, 50)
BYTE_LISTS = ByteLists(BYTE, 50)

TRICKY = ["", " ", "\n", "  ", "\n\n", " \n", "\n ", "a", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a \tb", "a\t b",
          "don't 'tis it's", "a's  's\n's", "x\r\ny", "x\xa0y", "x \xa0y", "x y", "x\x1cy", "x \x1f y", "<|endoftext|>", "a <|endoftext|> b",
          "a<|endoftext|>\n\nb", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|>", "été été ́x", "Σας ΣΑΣ", "日本語 テスト", "😀 😀😀",
          "1234 12 3", "A.B, C!!??", "Ġ Ċ", "ﬁ ½ Ⅷ", "a\x00b", "a\x0b\x0cb", "  lead", "trail  ", "　x　", "İstanbul ŉ"]


def _ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def _unpack(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_tricky_texts_equal_the_library():
    assert [_unpack(x) for x in BYTE_UNITS.encode(TRICKY)] == [_ids(BYTE_TOK, t) for t in TRICKY]
    assert [_unpack(x) for x in WORD_UNITS.encode(TRICKY)] == [_ids(WORD_TOK, t) for t in TRICKY]
    assert COUNTER.count([*TRICKY, None]) == [*(len(_ids(BYTE_TOK, t)) for t in TRICKY), 0]


ALPHABET = st.sampled_from(list("aAbs't1 .\n\t!<|>") + ["  ", " \n", "\n\n", "the", " and", "\x1d", "\xa0", "é", "é", "日", "😀", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(ALPHABET, max_size=25).map("".join), st.text(max_size=20)), max_size=4))
def test_random_texts_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [_unpack(x) for x in BYTE_UNITS.encode(texts)] == [_ids(BYTE_TOK, t) for t in texts]
    assert [_unpack(x) for x in WORD_UNITS.encode(texts)] == [_ids(WORD_TOK, t) for t in texts]
    assert COUNTER.count(texts) == [len(_ids(BYTE_TOK, t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(ALPHABET, max_size=25).map("".join), st.lists(st.sampled_from(["a", "b.", "é", "\nÉt", "1", "日", "'s"]), max_size=9)
                          .map(" ".join), st.text(max_size=20)), max_size=5))
def test_columns_of_texts_equal_the_library(texts):
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    assert BYTE_LISTS.lists(pa.array(texts, pa.string()), 7).to_pylist() == [_ids(BYTE_TOK, t or "") + [7] for t in texts]


def test_columns_of_tricky_texts_equal_the_library():
    column = pa.array(["left out", *TRICKY, None, *TRICKY], pa.string()).slice(1)
    assert BYTE_LISTS.lists(column, 0).to_pylist() == [_ids(BYTE_TOK, t or "") + [0] for t in column.to_pylist()]
    assert BYTE_LISTS.lists(pa.array(["", None]), 0).to_pylist() == [[0], [0]]


def test_words_of_a_column_are_looked_up_once(monkeypatch):
    """Evenly spaced texts take no step of their own: each different word is merged once, whatever stands around it."""
    units, merged, texts = ByteLists(BYTE), [], ["the oddword, and oddword.\nOddword oddword!" for _ in range(200)]
    monkeypatch.setattr(units, "_merge", lambda part, merge=units._merge: merged.append(part) or merge(part))
    for name in ("_cut", "_plain", "_learn", "plans", "whole"):
        monkeypatch.setattr(units, name, None)
    assert units.lists(pa.array(texts), 0).to_pylist() == [_ids(BYTE_TOK, t) + [0] for t in texts]
    assert sorted(merged) == sorted(["Ċ", "the", "Ġoddword", "Ġand", "Oddword", ",", ".", "!"])


class Whole(str):
    """A text that tells when it is split into words."""

    def split(self, *args):
        raise AssertionError("split only to look at its spaces")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*filter(str.isspace, map(chr, range(0x3001))), " ", " ", "\n", "a", "b.", "é"]), max_size=12).map("".join))
def test_plainly_spaced_texts_are_split_once(text):
    plain = text != "" and " ".join(text.split()) == text.replace("\n", " ") and not any(c in text for c in "\x1c\x1d\x1e\x1f")
    if plain:
        units = BYTE_UNITS._cut(Whole(text))
        assert units == ["\r" + text.split()[0], *text.replace("\n", " \n").split(" ")[1:]]
    assert BYTE_UNITS.encode([text]) == [BYTE_UNITS.whole(text) if text else b""]


def test_shortcut_is_proven_and_used():
    for name in list(COUNTER.shortcut)[:2000]:
        assert len(COUNTER.tok.model.tokenize(name)) == 1
    assert "Ġthe" in COUNTER.shortcut and len(COUNTER.shortcut) > 40_000
    fresh = Counter(BYTE)
    assert fresh.count(["the cat and the dog"]) == [5] and fresh.merged == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TRICKY)] + [(100, None, "x", 2), (101, "word " * 9000, "x", 3), (7, TRICKY[7], "x", 4), (7, "other", "x", 5),
                                                             (None, "no id", "x", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int").repartition(3)


def test_token_counts(spark, docs):
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts(docs, BYTE).collect()}
    for r in docs.collect():
        n = len(_ids(BYTE_TOK, r.text or ""))
        assert got[(r.doc_id, len((r.text or "").encode()))] == (n, n > 512)
    assert token_counts(docs, BYTE).count() == docs.count()
    assert token_counts(docs.limit(0), BYTE).count() == 0


def test_store_round_trip(spark, docs):
    path = new_folder(spark, "test-tokens")
    write_tokens(docs, path, BYTE, end_id=0, row_group_bytes=1 << 16, page_bytes=1 << 12, file_chars=5000)
    expect = sorted(((r.doc_id, tuple(_ids(BYTE_TOK, r.text or "") + [0])) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    stored = [(r.doc_id, tuple(r.ids)) for r in read_tokens(spark, path).collect()]
    assert sorted(stored, key=str) == sorted(expect, key=str)
    rows = sorted((tuple(r) for r in token_digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [d for d, _ in expect]
    at = 0
    by_key = {(d, zlib.crc32(np.array(ids, "<u4").tobytes())): len(ids) for d, ids in expect}
    for doc, start, n, crc in rows:
        assert start == at and by_key[(doc, crc)] == n
        at += n
    plan = read_tokens(spark, path, ("doc_id", "n_tokens")).filter("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "EqualTo(doc_id,3)" in plan


def test_store_of_nothing(spark, docs):
    path = new_folder(spark, "test-tokens")
    write_tokens(docs.limit(0), path, BYTE)
    assert token_digest(spark, path).count() == 0


def test_cut_lengths():
    for n in range(1, 9000):
        cut = cut_lengths(n)
        assert sum(cut) == n and all(0 < c <= 4096 for c in cut) and len(cut) <= n // 4096 + 5


def test_packing(spark, docs):
    got = harmonic_packing(docs, WORD, 2).collect()
    expect = [(r.doc_id, _ids(WORD_TOK, r.text or "") + [2]) for r in docs.collect()]
    lengths = {}
    for doc, ids in expect:
        lengths.setdefault(doc, []).append(ids)
    tokens = 0
    for doc, options in lengths.items():
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == sum(map(len, options))
        for r in mine:
            assert any(len(o) == r.doc_tokens and zlib.crc32(np.array(o[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for o in options)
        tokens += sum(r.length for r in mine)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(sequences) <= -(-tokens // 4096) + 1
    assert harmonic_packing(docs.limit(0), WORD, 2).count() == 0


def test_packing_does_not_depend_on_partitions_or_buckets(spark):
    from revisio.llm.packing import pack
    cut = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"),
                                   (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"), F.col("id").alias("ids_crc32"),
                                   F.lit(1).cast("long").alias("doc_tokens"))
    for bucket_rows in (300, 100_000):
        rows = pack(cut.repartition(5), bucket_rows=bucket_rows).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
        total = cut.agg(F.sum("length")).first()[0]
        r = rows.agg(F.sum("n").alias("n"), F.max("e").alias("e"), F.sum(F.when(F.col("n") != F.col("e"), 1).otherwise(0)).alias("gaps")).first()
        assert (r.n, r.gaps) == (total, 0) and r.e <= 4096
