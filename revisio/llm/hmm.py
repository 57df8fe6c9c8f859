"""11. Language-model scoring with a hidden Markov model.

Tokens are white-space words, A-Z lowered, and one end token a text.

1. Training words are counted in Spark: each task sends one row a distinct
   word, and the rows are summed by word. Words are told apart by 64-bit hashes.
2. A token falls into a *class*: the end, one of the ``HEAD`` most frequent
   words, or one of ``REST`` slots to which all other words are dealt by hash.
   The model's tables have one row a class, so they are bounded however many
   words there are. Inside a slot a word w has the probability
   (c + 0.1) / (N_slot + 0.1 * (V_slot + 1)), unseen words included.
3. Baum-Welch: in each round every task runs the scaled forward and backward
   recursions over its training texts and adds up expected starts, transitions
   and emissions; the sums (fixed-point integers, so that their order does not
   matter) are added across partitions. Texts are learned in consecutive pieces
   of ``PIECE`` tokens, which bounds the memory of the backward pass; pieces
   after a text's first begin with the states' overall shares.
4. Scoring is exact over the whole text: the scaled forward recursion, for many
   texts at once. A long text is cut into pieces whose forward results from
   every state (a matrix) are computed side by side and then chained.

The counts of the ``KNOWN`` most frequent words at most (16 bytes each) are
broadcast. Other words that a text holds are joined with the counts by a
shuffle and summed by text; a word in very many texts is never among them,
unless all words are that frequent.

Cases: null, empty and blank texts consist of the end token; a null doc_id is
trained on (``held_out`` false); repeated rows count and are scored each time;
ties in frequency are broken by the word's hash; other columns are ignored; an
empty table gives an empty result, and without any training text every base
probability is 0.1 / 0.1 = 1 and the classes are equally likely.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.llm.common import arrow_rows, crc32_mod, on_workers, read_table, written
from revisio.llm.shingles import word_hashes
from revisio.llm.units import blocks

STATES, ROUNDS = 8, 6
#: Classes: frequent words, and slots for all others.
HEAD, REST = 16_384, 1_024
#: Words whose counts are broadcast, 16 bytes each.
KNOWN = 1 << 18
#: Distinct words between two mergers of a task's counts; at four times as many they are sent off.
TASK_WORDS = 1 << 20
#: Added to counts, as the contract's base has it.
ADD = 0.1
#: Tokens of a training piece, and of a piece of a long text that is scored.
PIECE = 512
#: Tokens that are worked on at once in a task.
BLOCK_TOKENS = 1_000_000
#: Expected counts are summed as integers of this fraction.
UNIT = 1 << 20
#: Strength of the pull of a state's emissions towards the classes' overall shares.
PULL = 50.0


@dataclass
class Vocabulary:
    """What tasks need to know of the counts: all of bounded size."""
    tokens: int                 # N: training tokens with their ends
    distinct: int               # V
    ends: int
    hashes: np.ndarray          # known words, sorted
    counts: np.ndarray
    classes: np.ndarray         # of the known words
    whole: bool                 # the known words are all words
    shares: np.ndarray          # probability of each class
    rest_log: np.ndarray        # log10 of the denominator inside each slot
    head: int

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return 1 + self.head + _slot(hashes)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not known) and class of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), self.slots(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return np.where(there, self.counts[at], 0), np.where(there, self.classes[at], self.slots(hashes))

    @property
    def base(self) -> float:
        """log10 of the base probability's denominator."""
        return float(np.log10(self.tokens + ADD * (self.distinct + 1)))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(17)).astype(np.int64) % REST


def _texts(docs: DataFrame) -> DataFrame:
    held = F.coalesce(crc32_mod(docs["doc_id"], 10) == 0, F.lit(False))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), docs["text"].cast("string").alias("text"))


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """``h, n``: how often each word stands in the texts for which ``training`` holds."""
    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, where = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return words, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(words)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, limit = [], 0, TASK_WORDS
        for batch in batches:
            for a, b in blocks(batch.column(0), rows=4096):
                parts.append(np.unique(word_hashes(batch.column(0).slice(a, b - a).to_pylist())[0], return_counts=True))
                size += len(parts[-1][0])
                if size > limit:
                    parts = [rows(parts)]
                    size = len(parts[0][0])
                    limit = size + TASK_WORDS
                    if size > 4 * TASK_WORDS:  # bounds the memory of a task
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["h", "n"])
                        parts, size, limit = [], 0, TASK_WORDS
        if parts:
            words, n = rows(parts)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.filter(training & F.col("text").isNotNull()).select("text").mapInArrow(run, "h long, n long") \
        .groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """The vocabulary from ``counts`` (h, n) and the number of training texts.

    The driver gets the words above a count that at most ``known`` words reach
    (found from a histogram of powers of two), the ``head`` most frequent, and
    one row a slot.
    """
    size = F.floor(F.log2("n")).cast("int")
    by_size = {r["k"]: r["c"] for r in counts.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    n_words, least, total = sum(by_size.values()), 64, 0
    for k in sorted(by_size, reverse=True):
        total += by_size[k]
        if total > known:
            break
        least = k
    frequent = counts.filter(size >= least).toPandas() if least < 64 else counts.limit(0).toPandas()
    top = counts.orderBy(F.col("n").desc(), "h").limit(head).toPandas()
    slots = counts.groupBy(F.pmod(F.shiftrightunsigned("h", 17), F.lit(REST)).cast("int").alias("slot")) \
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    slot_n, slot_v = np.zeros(REST), np.zeros(REST)
    slot_n[slots["slot"].to_numpy(np.int64)], slot_v[slots["slot"].to_numpy(np.int64)] = slots["n"], slots["v"]
    words = slot_n.sum()
    top_h, top_n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    np.subtract.at(slot_n, _slot(top_h), top_n)
    np.subtract.at(slot_v, _slot(top_h), 1)
    every = np.concatenate([frequent["h"].to_numpy(np.int64).view(np.uint64), top_h])
    hashes, where = np.unique(every, return_index=True)
    classes = 1 + len(top_h) + _slot(hashes)
    classes[np.searchsorted(hashes, top_h)] = 1 + np.arange(len(top_h))
    inside = slot_n + ADD * (slot_v + 1)
    shares = np.concatenate([[ends + ADD], top_n + ADD, inside])
    return Vocabulary(int(words) + ends, n_words + (ends > 0), ends, hashes,
                      np.concatenate([frequent["n"].to_numpy(np.int64), top_n])[where], classes.astype(np.int64),
                      len(hashes) >= n_words, shares / shares.sum(), np.log10(inside), len(top_h))


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, rest_log double, classes binary, " \
    "other array<struct<h: long, n: int>>"


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``x`` from each place of ``at`` to the next."""
    if not len(x):
        return np.zeros(len(at) - 1)
    found = np.add.reduceat(np.append(x, 0.0), at[:-1])
    return np.where(np.diff(at) > 0, found, 0.0)


def _others_of(hashes: np.ndarray, at: np.ndarray, places: np.ndarray) -> pa.ListArray:
    """Each text's distinct words among ``places``, with how often they stand there."""
    text, h = np.searchsorted(at, places, side="right") - 1, hashes[places]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(h))).astype(np.int32)
    offsets = np.searchsorted(text[first], np.arange(len(at)))
    pairs = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(times)], ["h", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text as its classes (16 bits a token), with the sums over its known
    words; ``other`` counts the words that are not broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        end_log = float(np.log10(v.ends + ADD))
        for batch in batches:
            for a, b in blocks(batch.column(2), rows=4096):
                hashes, at = word_hashes(batch.column(2).slice(a, b - a).to_pylist())
                unique, where = np.unique(hashes, return_inverse=True)
                count, class_ = v.look_up(unique)
                log = np.log10(count + ADD)
                in_slot = class_ > v.head
                if not v.whole:  # the share of the words that are not broadcast is joined later
                    log[count == 0] = 0.0
                slot_log = np.where(in_slot, log - v.rest_log[np.maximum(class_ - 1 - v.head, 0)], 0.0)
                known_log, rest_log, n_known = (_sums(x[where], at) for x in (log, slot_log, (count > 0).astype(np.float64)))
                codes = class_.astype("<u2")[where]
                others = _others_of(hashes, at, np.zeros(0, dtype=np.int64) if v.whole else np.flatnonzero(count[where] == 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at) + 1, pa.int64()),
                     pa.array(n_known.round().astype(np.int64) + (v.ends > 0)), pa.array(known_log + end_log), pa.array(rest_log),
                     pa.array([codes[p:q].tobytes() + b"\0\0" for p, q in zip(at[:-1], at[1:])], pa.binary()), others],
                    ["doc_id", "held_out", "n_tokens", "n_known", "known_log", "rest_log", "classes", "other"])

    return docs.mapInArrow(run, CODED)


@dataclass
class Model:
    start: np.ndarray           # S
    share: np.ndarray           # S: the states' overall shares
    move: np.ndarray            # S x S
    emit: np.ndarray            # classes x S


def first_model(vocab: Vocabulary, states: int = STATES) -> Model:
    """Emissions around the classes' shares, apart by fixed draws; states last."""
    draws = np.random.default_rng(1).normal(size=(len(vocab.shares), states))
    emit = vocab.shares[:, None] * np.exp(draws)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1.0 / states)
    return Model(even, even, move, emit / emit.sum(axis=0))


def _by_time(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as one array ordered by time, longest piece first in each step:
    (classes, places of the steps, pieces in each step, order of the pieces)."""
    lengths = np.asarray([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    steps = np.concatenate([[0], np.cumsum(live)])
    t = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = np.empty(len(t), dtype=np.int64)
    flat[steps[t] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([pieces[i] for i in order])
    return flat, steps, live, order


def expectations(pieces: list[np.ndarray], first: np.ndarray, model: Model):
    """Baum-Welch's expected counts over the pieces: (starts of first pieces,
    moves, emissions by class, log likelihood)."""
    flat, steps, live, order = _by_time(pieces)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    seen = np.take(emit, flat, axis=0)
    alpha, scale = np.empty_like(seen), np.empty(len(flat), dtype=np.float32)
    ones = np.ones(len(move), dtype=np.float32)
    is_first = np.asarray(first, dtype=bool)[order]
    for t, n in enumerate(live):
        a, b = steps[t], steps[t + 1]
        if t:
            now = alpha[steps[t - 1]:steps[t - 1] + n] @ move
        else:
            now = np.where(is_first[:, None], model.start, model.share).astype(np.float32)
        now *= seen[a:b]
        scale[a:b] = now @ ones
        np.divide(now, scale[a:b, None], out=alpha[a:b])
    moves = np.zeros(move.shape)
    seen /= scale[:, None]
    beta = np.ones((live[-1], len(move)), dtype=np.float32)
    back = move.T.copy()
    gamma = alpha  # the forward values give way to the states' probabilities, from the end
    for t in range(len(live) - 2, -1, -1):
        n, a, b = live[t + 1], steps[t], steps[t + 1]
        ahead = seen[b:steps[t + 2]] * beta
        moves += alpha[a:a + n].T @ ahead
        gamma[b:steps[t + 2]] *= beta
        beta = np.concatenate([ahead @ back, np.ones((live[t] - n, len(move)), dtype=np.float32)])
    gamma[:steps[1]] *= beta
    emitted = np.stack([np.bincount(flat, weights=gamma[:, s], minlength=len(emit)) for s in range(len(move))], axis=1)
    return gamma[:steps[1]][is_first].sum(axis=0, dtype=np.float64), moves * move, emitted, float(np.log(scale.astype(np.float64)).sum())


def forward(pieces: list[np.ndarray], starts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, from its row of ``starts`` (probabilities of the state of
    its first token): states at its end, and log of the likelihood."""
    flat, steps, live, order = _by_time(pieces)
    now, log, product = starts[order], np.zeros(len(order)), np.ones(len(order))
    ones = np.ones(len(model.move))
    last = np.empty_like(now)
    for t, n in enumerate(live):
        if t:
            last[n:len(now)] = now[n:]
            now = now[:n] @ model.move
        now *= np.take(model.emit, flat[steps[t]:steps[t + 1]], axis=0)
        scale = now @ ones
        now /= scale[:, None]
        product[:n] *= scale
        if t % 16 == 15:
            log += np.log(product)
            product[:] = 1.0
    last[:len(now)] = now
    log += np.log(product)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return last[back], log[back]


def log_likelihoods(texts: list[np.ndarray], model: Model, piece: int = PIECE, long: int = 16 * PIECE) -> np.ndarray:
    """Natural log of each token sequence's probability, exactly; sequences
    above ``long`` tokens are computed in pieces side by side."""
    states = len(model.move)
    pieces, starts, owner = [], [], []
    for i, x in enumerate(texts):
        cut = [x] if len(x) <= long else [x[k:k + piece] for k in range(0, len(x), piece)]
        pieces.append(cut[0])
        starts.append(model.start[None])
        owner.append((i, len(cut) - 1))
        for p in cut[1:]:
            pieces += [p] * states
            starts.append(model.move)
    ends, logs = forward(pieces, np.concatenate(starts), model)
    out, at = np.zeros(len(texts)), 0
    for i, more in owner:
        now, log = ends[at], logs[at]
        at += 1
        for _ in range(more):
            top = logs[at:at + states].max()
            now = (now * np.exp(logs[at:at + states] - top)) @ ends[at:at + states]
            scale = now.sum()
            now, log = now / scale, log + top + np.log(scale)
            at += states
        out[i] = log
    return out


def _token_blocks(column, piece: int | None) -> Iterator[list[np.ndarray]]:
    """The column's sequences, about ``BLOCK_TOKENS`` at a time, with ``piece``
    cut into pieces (first pieces have True)."""
    out, size = [], 0
    for x in column:
        codes = np.frombuffer(x.as_buffer(), dtype="<u2")
        for k in range(0, len(codes), piece or len(codes)):
            part = codes[k:k + (piece or len(codes))]
            out.append((part, k == 0))
            size += len(part)
            if size >= BLOCK_TOKENS:
                yield out
                out, size = [], 0
    if out:
        yield out


def learn(code: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over the rows of ``code`` that are not held out; also the log
    likelihood before each round. A round brings one row a class to the driver."""
    spark, model, history = code.sparkSession, first_model(vocab, states), []
    training = code.filter("not held_out").select("classes")
    n_classes = len(vocab.shares)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            start, moves, emitted, log, any_ = np.zeros(states), np.zeros((states, states)), np.zeros((n_classes, states)), 0.0, False
            for batch in batches:
                for block in _token_blocks(batch.column(0), PIECE):
                    found = expectations([p for p, _ in block], np.asarray([f for _, f in block]), m)
                    start, moves, emitted, log, any_ = start + found[0], moves + found[1], emitted + found[2], log + found[3], True
            if not any_:
                return
            # Rows: the classes, then a row for each state's moves, then the starts, then the likelihood.
            rows = np.concatenate([emitted, moves, start[None], np.full((1, states), log)])
            at = np.flatnonzero(rows.any(axis=1))
            values = np.round(rows[at] * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(values[:, s].copy()) for s in range(states)]],
                                             ["row", *[f"s{s}" for s in range(states)]])

        schema = ", ".join(["row int", *[f"s{s} long" for s in range(states)]])
        # Whole numbers beyond a long, at the largest corpora, are sums of decimals.
        sums = [F.sum(F.col(f"s{s}").cast("decimal(20,0)")).cast("double").alias(f"s{s}") for s in range(states)]
        with arrow_rows(spark, 2000):
            got = training.mapInArrow(run, schema).groupBy("row").agg(*sums).toPandas()
        shared.unpersist()
        if not len(got):
            break
        total = np.zeros((n_classes + states + 2, states))
        total[got["row"].to_numpy(np.int64)] = got[[f"s{s}" for s in range(states)]].to_numpy(np.float64) / UNIT
        emitted, moves, start, log = total[:n_classes], total[n_classes:-2], total[-2], total[-1, 0]
        history.append(float(log))
        emit = emitted + PULL * vocab.shares[:, None]
        moves = moves + 1.0 / states
        start, share = start + 1.0 / states, emitted.sum(axis=0) + 1.0 / states
        model = Model(start / start.sum(), share / share.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model, history


def scored(code: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """``code`` without its classes, with ``log``: log10 probability of the classes."""
    shared = code.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            logs = [log_likelihoods([p for p, _ in block], m) for block in _token_blocks(column, None)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate([*logs, np.zeros(0)]) / np.log(10))],
                                             [*batch.schema.names[:-1], "log"])

    rest = code.select(*[c for c in code.columns if c not in ("classes", "other")], "classes")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields[:-1]]
    return rest.mapInArrow(run, ", ".join([*fields, "log double"]))


def _others(code: DataFrame, counts: DataFrame) -> DataFrame:
    """``file, row`` with the sums over the words that are not broadcast."""
    words = code.select("file", "row", F.explode("other").alias("w")).select("file", "row", F.col("w.h").alias("h"), F.col("w.n").alias("times"))
    found = words.join(counts.select("h", F.col("n").alias("c")), "h", "left")
    return found.groupBy("file", "row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).cast("long").alias("o_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("o_log"))


def hmm_scores(docs: DataFrame, head: int = HEAD, known: int = KNOWN, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    on_workers(spark)
    docs = _texts(docs)
    counts = written(word_counts(docs, ~F.col("held_out")), "hmm-words")
    vocab = vocabulary(counts, docs.filter("not held_out").count(), head, known)
    with arrow_rows(spark, 2000):
        code = written(coded(docs, vocab), "hmm-classes")
    model, _ = learn(code, vocab, states, rounds)
    if vocab.whole:
        out = scored(code, vocab, model).withColumns({"o_known": F.lit(0), "o_log": F.lit(0.0)})
    else:
        # A row is named by its file's number and its place in it.
        placed = code.withColumns({"file": F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int"), "row": F.col("_metadata.row_index")})
        out = scored(placed, vocab, model).join(_others(placed, counts), ["file", "row"], "left")
    other = F.coalesce("o_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("o_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + other - F.col("n_tokens") * F.lit(vocab.base)).alias("base_score"),
        (F.col("log") + F.col("rest_log") + other).alias("score"))


def op11_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(read_table(spark, sf_dir, "documents"))
