"""1. Token counts with a whole-token shortcut.

Offline, once: every vocabulary string that is one pre-token by itself is
encoded alone; those that give one token are *whole*. That is the proof the
shortcut rests on, since a pre-token's merges depend on nothing but itself. In
a text, a pre-token that is whole counts 1 without any merging; only the rest
is merged by the library. Counts of pre-tokens and of white-space units
are kept in bounded memos.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated rows; other columns are ignored, whatever their names; an empty table
gives an empty result; a text of any length is counted whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from revisio.llm.common import on_workers, read_table
from revisio.llm.units import MEMO_LIMIT, ByteUnits, blocks

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(tok) -> set[str]:
    """The pre-tokens (in the tokenizer's byte alphabet) proven to be one token.

    A vocabulary string qualifies if the pre-tokenizer leaves it in one piece
    and the library encodes it to that one id. Strings that are not valid UTF-8
    by themselves can never be a pre-token and are left to the merges.
    """
    ids = tok.get_vocab(with_added_tokens=False)
    names = [s for s in ids if s not in {t.content for t in tok.get_added_tokens_decoder().values()}]
    out = set()
    for at in range(0, len(names), 2000):
        some = names[at:at + 2000]
        got = tok.encode_batch_fast([tok.decoder.decode([s]) for s in some], add_special_tokens=False)
        out.update(s for s, e in zip(some, got) if e.ids == [ids[s]])
    return out


class Counter(ByteUnits):
    """Counts instead of ids; the same cutting of texts into units."""

    def __init__(self, path: str, limit: int = MEMO_LIMIT):
        super().__init__(path, limit)
        self.shortcut = whole_tokens(self.tok)
        self.merged = 0  # pre-tokens that had to be merged

    def _merge(self, part: str) -> int:
        if part in self.shortcut:
            return 1
        self.merged += 1
        return len(self.tok.model.tokenize(part))

    def _encode_many(self, keys: list[str]) -> None:
        for k in keys:
            text = k[1:] if k[0] == "\r" else k if k[0] == "\n" else " " + k
            self.memo[k] = sum(self._part(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text))

    def count(self, texts: list[str | None]) -> list[int]:
        plans, get = self.plans(texts), self.memo.__getitem__
        return [len(self.whole(t)) // 4 if p is None else sum(map(get, p)) for t, p in zip(texts, plans)]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    A narrow map over the scan: no shuffle, memory bounded by one block of
    texts and the memo.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in blocks(column):
                texts = column.slice(a, b - a).to_pylist()
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pc.fill_null(pc.binary_length(column.slice(a, b - a)), 0).cast(pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    on_workers(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
