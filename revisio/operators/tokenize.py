"""Vocabulary, token ids, padding and label masking.

The reference loads a trained subword vocabulary that is not available
offline; ``build_vocab`` is the stand-in: a word vocabulary built from the
corpus, ids by (count desc, token), 0 = pad, 1 = eos, 2 = unk.

Lookups happen in the row while the table's measured bytes are below
``IN_ROW_BYTES``: the vocabulary travels as one broadcast row that holds an array
of small maps (a key's hash says in which one it is), read inside ``transform``,
so no token is ever exploded or shuffled. Beyond that, tokens are exploded and
joined: with a broadcast up to ``BROADCAST_BYTES``, else by a shuffle, where
Spark splits skewed words. ``tokenize_with`` is the other mode: a tokenizer file
given by the user.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Optional, Sequence

import pyarrow as pa
from pyspark import cloudpickle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisio.functions.text import first_words, words
from revisio.operators.order import ordered_rank
from revisio.session import removed, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAD, EOS, UNK = 0, 1, 2
SPECIALS = 3
#: A table that is read inside the row is copied along with each row that reads it.
IN_ROW_BYTES = 4 << 20
BROADCAST_BYTES = 64 << 20


def build_vocab(df: DataFrame, cols: Sequence[str], size: int = 32000) -> DataFrame:
    """``(token, count, id)`` for the ``size - 3`` most frequent words.
    Counting is a partial (map-side) aggregate, so frequent words do not
    gather raw rows in one task."""
    toks = None
    for c in cols:
        t = df.select(F.explode(words(c)).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    # Read twice: for the least count that is kept, and for the words.
    counts = written(counts, "word-counts")
    kept = counts.filter(F.col("count") >= _least_count(counts, size - SPECIALS))
    ranked = ordered_rank(kept, [F.col("count").desc(), F.col("token")], rank_col="_r")
    removed(counts)
    return ranked.filter(F.col("_r") < size - SPECIALS).select("token", "count", (F.col("_r") + SPECIALS)
                                                                .cast("int").alias("id"))


def _least_count(counts: DataFrame, n: int) -> int:
    """The count of the ``n``-th most frequent word (0 if there are fewer words):
    only words that are at least as frequent need a rank."""
    by = counts.groupBy("count").agg(F.count(F.lit(1)).alias("_n"))
    # One row a distinct count: as many as the square root of twice the words of all texts at most.
    above = Window.orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by.withColumn("_above", F.sum("_n").over(above)).filter(F.col("_above") >= n).agg(F.max("count")).first()[0] or 0


def _side_entry(i: int):
    return lambda t, p: F.struct(F.lit(i).alias("side"), p.alias("pos"), t.alias("token"))


def _is_side(i: int):
    return lambda e: e["side"] == i


def _bytes(vocab: DataFrame) -> int:
    """Measured size: 40 bytes for an entry beside its text."""
    return vocab.agg(F.sum(F.octet_length("token") + F.lit(40))).first()[0] or 0


def _lookup(vocab: DataFrame, size: int) -> DataFrame:
    return F.broadcast(vocab) if size <= BROADCAST_BYTES else vocab


def _map_row(vocab: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``_one, _maps``: an array of maps key -> value of about four
    entries each, the map's number being the key's hash."""
    n = max(1, vocab.count() // 4)
    entries = vocab.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")) \
        .agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    every = vocab.sparkSession.range(n).join(entries, F.col("id") == F.col("b"), "left").select("id", "m")
    empty = F.map_from_arrays(F.array().cast(f"array<{vocab.schema[key].dataType.simpleString()}>"),
                              F.array().cast(f"array<{vocab.schema[value].dataType.simpleString()}>"))
    numbered = every.select("id", F.coalesce("m", empty).alias("m"))
    pairs = F.collect_list(F.struct("id", "m"))
    in_order = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(F.col("_by"), i.cast("long")))
    return numbered.agg(F.map_from_entries(pairs).alias("_by")).select(F.lit(1).alias("_one"), in_order.alias("_maps"))


def find_in_row(key: Column) -> Column:
    """The value of ``key`` in the row's ``_maps``, null if it has none."""
    return F.element_at(F.get(F.col("_maps"), F.pmod(F.xxhash64(key), F.size("_maps")).cast("int")), key)


def with_map_row(df: DataFrame, vocab: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with the table's maps beside each row; the table has to be small."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(_map_row(vocab, key, value)), "_one")


def _cut_words(col: str, max_len: int) -> Column:
    return F.coalesce(first_words(col, max_len - 1), F.array().cast("array<string>"))


def tokenize(df: DataFrame, vocab: DataFrame, sides: Sequence[tuple], row_id: str = "row_id",
             in_row_bytes: Optional[int] = None) -> DataFrame:
    """Token ids per side: ``sides`` is ``[(column, out_column, max_len), ..]``.
    Words beyond ``max_len - 1`` are cut (truncation keeps the end token), the
    ids end with eos; a null side is empty. A vocabulary of at most
    ``in_row_bytes`` is read in the row; for a larger one there is one explode
    over all sides, one lookup join and one regroup by row (each group is
    bounded by ``max_len`` per side), for which ``row_id`` must be unique."""
    vocab = vocab.select("token", "id")
    size = _bytes(vocab)
    if size <= (IN_ROW_BYTES if in_row_bytes is None else in_row_bytes):
        cut = df.select(F.col(row_id).alias("row_id"), *[_cut_words(c, n).alias(f"_w{i}") for i, (c, _, n) in enumerate(sides)])
        found = with_map_row(cut, vocab, "token", "id")
        ids = lambda i: F.transform(f"_w{i}", lambda w: F.coalesce(find_in_row(w), F.lit(UNK)))
        return found.select("row_id", *[F.concat(ids(i), F.array(F.lit(EOS))).alias(out) for i, (_, out, _) in enumerate(sides)])
    items = []
    for i, (col, _, max_len) in enumerate(sides):
        items.append(F.transform(_cut_words(col, max_len), _side_entry(i)))
    base = df.select(F.col(row_id).alias("row_id"), F.explode_outer(F.concat(*items)).alias("_t"))
    base = base.select("row_id", "_t.side", "_t.pos", "_t.token")
    joined = base.join(_lookup(vocab, size), "token", "left")
    entry = F.struct("side", "pos", F.coalesce("id", F.lit(UNK)).alias("id"))
    grouped = joined.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), entry)))
                                           .alias("_all"))
    outs = []
    for i, (_, out, _) in enumerate(sides):
        ids = F.transform(F.filter("_all", _is_side(i)), lambda e: e["id"])
        outs.append(F.concat(ids, F.array(F.lit(EOS))).alias(out))
    return grouped.select("row_id", *outs)


def tokenize_with(df: DataFrame, tokenizer_path: str, sides: Sequence[tuple], eos: int, row_id: str = "row_id") -> DataFrame:
    """Token ids per side from a tokenizer file (the ``tokenizers`` library's
    JSON), which each task reads once; ``sides`` as for ``tokenize``. Whole
    texts are encoded, then cut to ``max_len - 1`` ids, and end with ``eos``; a
    null side is empty. Encoding is a map over Arrow batches, without a shuffle."""
    cuts = [n - 1 for _, _, n in sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer_path)
        for batch in batches:
            outs = []
            for i, n in enumerate(cuts):
                found = tok.encode_batch_fast([t or "" for t in batch.column(i + 1).to_pylist()], add_special_tokens=False)
                outs.append(pa.array([e.ids[:n] + [eos] for e in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *outs], ["row_id", *[out for _, out, _ in sides]])

    rows = df.select(F.col(row_id).alias("row_id"), *[F.col(c).cast("string").alias(f"_s{i}") for i, (c, _, _) in enumerate(sides)])
    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"row_id {kind}", *[f"{out} array<int>" for _, out, _ in sides]]))


def pad_to_length(ids: Column, length, pad: int = PAD) -> Column:
    """Right-pad ``ids`` to ``length`` (longer arrays are left as they are)."""
    ln = length if isinstance(length, Column) else F.lit(length)
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(ln - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length) -> Column:
    ln = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(ln - F.size(ids),
                                                                                                   F.lit(0))))


def mask_label_padding(labels: Column, pad: int = PAD) -> Column:
    return F.transform(labels, lambda x: F.when(x == pad, F.lit(-100)).otherwise(x))


def unmask_label_padding(labels: Column, pad: int = PAD) -> Column:
    return F.transform(labels, lambda x: F.when(x == -100, F.lit(pad)).otherwise(x))


def shift_right(labels: Column, start: int = PAD, pad: int = PAD) -> Column:
    """Decoder input: start id, then the labels without the last (-100 -> pad)."""
    body = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    return unmask_label_padding(F.concat(F.array(F.lit(start)), body), pad)


def decoder_attention_mask(labels: Column, pad: int = PAD) -> Column:
    return F.transform(labels, lambda x: F.when((x == pad) | (x == -100), F.lit(0)).otherwise(F.lit(1)))


def decode_ids(df: DataFrame, vocab: DataFrame, ids_col: str, out_col: str, skip_special: bool = True,
               row_id: str = "row_id", in_row_bytes: Optional[int] = None) -> DataFrame:
    """ids -> text through the vocabulary; specials skipped or kept as
    ``<pad>``, ``</s>``, ``<unk>``. In the row or by a join, as ``tokenize``."""
    vocab = vocab.select("token", "id")
    size = _bytes(vocab)

    def name(token: Column, i: Column) -> Column:
        return F.coalesce(token, F.when(i == PAD, "<pad>").when(i == EOS, "</s>").otherwise("<unk>"))

    if size <= (IN_ROW_BYTES if in_row_bytes is None else in_row_bytes):
        ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
        if skip_special:
            ids = F.filter(ids, lambda i: i >= SPECIALS)
        found = with_map_row(df.select(F.col(row_id).alias("row_id"), ids.alias("_ids")), vocab, "id", "token")
        return found.select("row_id", F.array_join(F.transform("_ids", lambda i: name(find_in_row(i), i)), " ").alias(out_col))
    ex = df.select(F.col(row_id).alias("row_id"), F.posexplode_outer(ids_col).alias("pos", "id"))
    j = ex.join(_lookup(vocab, size), "id", "left")
    keep = F.col("pos").isNotNull()
    if skip_special:
        keep = keep & (F.col("id") >= SPECIALS)
    g = j.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", name(F.col("token"), F.col("id")).alias("t")))))
                                .alias("_p"))
    return g.select("row_id", F.array_join(F.transform("_p", lambda s: s["t"]), " ").alias(out_col))


def ids_text(c) -> Column:
    """Render an id array as text (for display and comparison)."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), " ")
