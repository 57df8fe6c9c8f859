"""From pairs to padded batches in one call: what a trainer reads."""
from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame

from revisio.operators.batch import assign_batches, pad_batches
from revisio.operators.filters import drop_empty_pairs
from revisio.operators.order import slice_rows
from revisio.operators.projections import add_prefix
from revisio.operators.tokenize import tokenize
from revisio.session import written


def prepare(pairs: DataFrame, vocab: DataFrame, batch_size: int, seed: int, source_len: int, target_len: int,
            order: Sequence[str] = ("row_id",), start: int = 0, stop: Optional[int] = None, prefix: str = "",
            mode: str = "drop_last", multiple: Optional[int] = 8) -> DataFrame:
    """Rows ``[start, stop)`` of ``pairs`` (row_id, input, output) in key order,
    without empty sides, prefixed, tokenised, dealt into batches and padded:
    ``row_id, batch_id, pos_in_batch, input_ids, attention_mask, labels,
    pad_len, label_len``. Null and empty sides are dropped before tokenising."""
    if start or stop is not None:
        pairs = slice_rows(pairs, start, stop, list(order), rank=False)
    rows = add_prefix(drop_empty_pairs(pairs), "input", prefix)
    # The ranks read the rows twice: the cut ids are stored, so that texts are split and looked up once.
    tokens = written(tokenize(rows, vocab, [("input", "input_ids", source_len), ("output", "labels", target_len)]), "tokens")
    return pad_batches(assign_batches(tokens, batch_size, seed, mode), multiple).drop("rank")
