"""3. Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public (the pieces of a sentencepiece model). For
each language, a piece's probability is learned from at most ``MAX_TRAIN``
training documents (the same number of each language, as far as it has them:
those with the smallest hash of the id) by expected counts: one forward-backward pass over all segmentations of each word
under a language-neutral prior (a piece's share falls with its number of
characters), weighted by how often the word occurs in that language. A word's
probability in a language is the sum over all its segmentations of the product
of piece probabilities (forward algorithm); a text's log-probability is the sum
over its words. The score is the posterior of the best language, tempered by
the number of words so that it does not saturate.

Words are runs of letters, lower-cased; the piece model's word mark stands
before each. Characters outside the vocabulary get a fixed small probability in
every language.

Cases: null text, and text without a letter, give ``und`` with score 0; rows
without a language or text teach nothing; ties between languages go to the
alphabetically first; without any training row all predictions are ``und``;
repeated rows are predicted one by one; other columns are never read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisio.llm.common import crc32_mod, on_workers, read_table
from revisio.llm.units import blocks

#: Characters of a word that a lattice takes at a time; longer runs of letters
#: go on where the part before ended, so pieces across the parts count as well.
WORD_CHARS = 32
#: Words whose lattices are held at once.
GROUP = 1500
#: Words whose vectors a worker keeps.
MEMO_LIMIT = 800_000
#: Bound of the training sample, in documents (documented parameter).
MAX_TRAIN = 20_000
#: Probability of a character outside the vocabulary; share for unseen pieces.
UNKNOWN = 1e-7
SMOOTHING = 0.5
#: Distinct language values that are learned, the most frequent first: a bound
#: on the model's size (vocabulary times languages). A corpus with more raises.
MAX_LANGUAGES = 400

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


def words_of(text: str) -> list[str]:
    """Letter runs, lower-cased."""
    return _LETTERS.findall(text.lower())


def parts_of(word: str) -> list[str]:
    """A word as the lattice takes it: marked as a beginning, in parts of at most WORD_CHARS."""
    if len(word) <= WORD_CHARS:
        return [MARK + word]
    return [MARK + word[:WORD_CHARS], *(word[i:i + WORD_CHARS] for i in range(WORD_CHARS, len(word), WORD_CHARS))]


def _has_letter(words: list[str]) -> bool:
    """Number characters such as fractions stand in words, but are no letters."""
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def load_pieces(path: str) -> dict[str, int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return {p: i for i, p in enumerate(sorted(p for p in names if p))}


class Lattice:
    """All segmentations of many words at once."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.size = len(vocabulary)
        self.deep = max(map(len, vocabulary), default=1)
        # Beginnings of pieces that are not pieces themselves: where to go on looking.
        self.reach: dict[str, int] = {p[:k]: -1 for p in vocabulary for k in range(1, len(p))} | vocabulary

    def edges(self, words) -> np.ndarray:
        """[word, end, length - 1] -> piece, -1 for none, ``size`` for an unknown character."""
        n = max(map(len, words))
        out = np.full((len(words), n + 1, self.deep), -1, dtype=np.int32)
        get, unknown = self.reach.get, self.size
        across, deep = n + 1, self.deep
        at: list[int] = []
        found: list[int] = []
        put, name = at.append, found.append
        for r, w in enumerate(words):
            size = len(w)
            for i in range(size):
                end = (r * across + i + 1) * deep
                p = get(w[i])
                put(end)
                if p is None:
                    name(unknown)
                    continue
                name(p if p >= 0 else unknown)
                for k in range(1, min(deep, size - i)):
                    p = get(w[i:i + k + 1])
                    if p is None:
                        break
                    if p >= 0:
                        put(end + k * (deep + 1))
                        name(p)
        out.reshape(-1)[at] = found
        return out

    @staticmethod
    def forward(edges: np.ndarray, prob: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """[word, end, language]: probability of each prefix; ``prob`` has a zero
        last row. ``start`` has the first ends' values if they are known."""
        rows, ends, _ = edges.shape
        alpha = np.zeros((rows, ends, prob.shape[1]))
        first = 1 if start is None else start.shape[1]
        alpha[:, :first] = 1.0 if start is None else start
        used = (edges >= 0).any(axis=0)
        for j in range(first, ends):
            for k in np.flatnonzero(used[j, :j]) + 1:
                alpha[:, j] += alpha[:, j - k] * prob[edges[:, j, k - 1]]
        return alpha

    def log_forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """[word, language]: log-probability over all segmentations of each word.

        Long words go through the lattice part by part: the values at the last
        ends, as many as a piece can reach back over, are carried on, scaled so
        that the last is 1.
        """
        out = np.zeros((len(words), prob.shape[1]))
        parts = [parts_of(w) for w in words]
        rows, before, start, t = np.arange(len(words)), [""] * len(words), None, 0
        while len(rows):
            spans = [b + parts[i][t] for i, b in zip(rows, before)]
            size = np.array([len(x) for x in spans])
            alpha = self.forward(self.edges(spans), prob, start)
            last = np.maximum(alpha[np.arange(len(rows)), size], 1e-300)
            out[rows] += np.log(last)
            t += 1
            more = np.flatnonzero([len(parts[i]) > t for i in rows])  # their spans are full, so of one length
            if not len(more):
                break
            n = int(size[more[0]])
            back = min(self.deep - 1, n)
            start = alpha[more, n - back:n + 1] / last[more, None]
            rows, before = rows[more], [spans[i][n - back:] for i in more]
        return out

    def uses(self, word: str, prior: np.ndarray) -> np.ndarray:
        """[piece]: expected uses in one word of any length, summed in logarithms."""
        edges = self.edges([word])[0]
        with np.errstate(divide="ignore"):
            logs = np.log(prior[:, 0])
        end, short = np.nonzero(edges >= 0)
        piece = edges[end, short]
        begin, value = end - short - 1, logs[piece]
        bounds = np.searchsorted(end, np.arange(len(word) + 2))
        left, right = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
        left[0] = right[len(word)] = 0.0
        for j in range(1, len(word) + 1):
            at = slice(bounds[j], bounds[j + 1])
            left[j] = np.logaddexp.reduce(left[begin[at]] + value[at])
        for j in range(len(word), 0, -1):
            at = slice(bounds[j], bounds[j + 1])
            right[begin[at]] = np.logaddexp(right[begin[at]], right[j] + value[at])  # each place once
        return np.bincount(piece, np.exp(left[begin] + value + right[end] - left[-1]), minlength=self.size + 2)


def _groups(words: list[str]) -> Iterator[list[str]]:
    """Words of like length together, a bounded number at a time."""
    words = sorted(words, key=len)
    for at in range(0, len(words), GROUP):
        yield words[at:at + GROUP]


def expected_counts(lattice: Lattice, counts: list[tuple[str, np.ndarray]], prior: np.ndarray) -> np.ndarray:
    """[piece, language]: expected uses under ``prior`` (one column), times the words' counts."""
    out = np.zeros((lattice.size + 2, len(counts[0][1]) if counts else 0))
    by_word: dict[str, np.ndarray] = {}
    for word, n in counts:
        if len(word) > WORD_CHARS:
            out += lattice.uses(MARK + word, prior)[:, None] * n
        else:
            by_word[MARK + word] = by_word.get(MARK + word, 0) + n
    for words in _groups(list(by_word)):
        edges = lattice.edges(words)
        alpha = lattice.forward(edges, prior)[:, :, 0]
        size = np.array([len(w) for w in words])
        rows, ends = alpha.shape
        beta = np.zeros((rows, ends + lattice.deep))
        beta[np.arange(rows), size] = 1.0
        weight = np.stack([by_word[w] for w in words]) / alpha[np.arange(rows), size][:, None]
        for j in range(ends - 1, 0, -1):
            for k in range(1, min(lattice.deep, j) + 1):
                e = edges[:, j, k - 1]
                use = alpha[:, j - k] * prior[e, 0] * beta[:, j]
                beta[:, j - k] += prior[e, 0] * beta[:, j]
                hit = use > 0
                np.add.at(out, e[hit], use[hit, None] * weight[hit])
    return out


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows each language gets of ``rows``: all of a small one's, an
    equal number of the others', at least one."""
    out, left = {}, rows
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def sample(train: DataFrame, rows: int = MAX_TRAIN, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """At most ``rows`` rows with a language and letters in the text, shared out
    by ``quotas``: those of each language with the smallest hash of the id. Rows
    without letters teach nothing and take no places."""
    spark = train.sparkSession
    lang = train[lang_col].cast("string")
    marks = train.filter(lang.isNotNull() & train[text_col].cast("string").rlike(r"[\p{L}\p{N}]")) \
        .select(train[id_col].alias("_id"), lang.alias("_lang"), F.xxhash64(train[id_col]).alias("_h"))
    found = marks.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("low")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if the model may be that large")
    quota = quotas({r["_lang"]: r["n"] for r in found}, rows)
    # A threshold on a uniform hash takes the share that is wanted and some more, without a sort of all rows;
    # the smallest hash is taken in any case.
    shares = spark.createDataFrame(
        [(r["_lang"], quota[r["_lang"]], min(1.0, (1.2 * quota[r["_lang"]] + 30) / r["n"]), r["low"]) for r in found],
        "_lang string, _quota long, _share double, _low long")
    near = marks.join(F.broadcast(shares), "_lang").filter("_h <= _low or double(_h) / 18446744073709551616D + 0.5D <= _share")  # a row a language
    own = Window.partitionBy("_lang").orderBy("_h", "_id")
    marks = near.withColumn("_place", F.row_number().over(own)).filter("_place <= _quota").select("_id", "_lang").distinct()
    return train.join(F.broadcast(marks), (train[id_col] == marks["_id"]) & (lang == marks["_lang"]), "left_semi")  # at most ``rows`` ids


def learn(train: DataFrame, piece_path: str, lang_col: str = "lang", text_col: str = "text") -> dict:
    """The model: languages and a [piece, language] table, from all of ``train``.

    Each task counts its words and adds up expected piece uses; Spark sums them
    by language and piece (map-side first), so what reaches the driver is at
    most vocabulary times languages, however many rows there are.
    """
    spark = train.sparkSession
    on_workers(spark)
    train = train.select(train[lang_col].cast("string").alias("lang"), train[text_col].cast("string").alias("text")) \
        .filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_vocabulary(piece_path))
        prior = _prior(lattice.vocabulary)
        found: dict[str, Counter] = {}

        def emit() -> pa.RecordBatch:
            langs = sorted(found)
            words = sorted(set().union(*found.values()))
            uses = np.stack([np.fromiter(map(found[x].__getitem__, words), dtype=float, count=len(words)) for x in langs], axis=1)
            pairs = list(zip(words, uses))
            table = expected_counts(lattice, pairs, prior)[:lattice.size] if pairs else np.zeros((0, 0))
            piece, lang = np.nonzero(table)
            return pa.RecordBatch.from_arrays([pa.array([langs[i] for i in lang], pa.string()), pa.array(piece, pa.int32()),
                                               pa.array(table[piece, lang] if len(piece) else [], pa.float64())], ["lang", "piece", "uses"])

        for batch in batches:
            langs, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in blocks(column):
                for lang, text in zip(langs[a:b], column.slice(a, b - a).to_pylist()):
                    found.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, found.values())) > MEMO_LIMIT // 4:
                    yield emit()
                    found.clear()
        if found:
            yield emit()

    summed = train.mapInArrow(run, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    # One language's rows at a time would need a job each; the whole table is bounded instead.
    rows = summed.limit(MAX_LANGUAGES * len(_vocabulary(piece_path)) + 1).toPandas()
    langs = sorted(rows["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if the model may be that large")
    size = len(_vocabulary(piece_path))
    table = np.zeros((size, len(langs)))
    table[rows["piece"].to_numpy(dtype=np.int64), np.searchsorted(langs, rows["lang"])] = rows["uses"].round(6)
    table = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=0, keepdims=True) if langs else table
    # Then the unknown character, then the row for "no piece".
    prob = np.vstack([table, np.full((1, len(langs)), UNKNOWN), np.zeros((1, len(langs)))])
    return {"langs": langs, "prob": prob.astype(np.float32), "pieces": piece_path}


_VOCABULARIES: dict[str, dict[str, int]] = {}


def _vocabulary(path: str) -> dict[str, int]:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = load_pieces(path)
    return _VOCABULARIES[path]


def _prior(vocabulary: dict[str, int]) -> np.ndarray:
    """Language-neutral start: longer pieces are rarer, but beat their letters' product."""
    p = np.array([8.0 ** -len(w) if len(w) > 1 else 1 / 64 for w in vocabulary])
    return np.concatenate([p / p.sum(), [UNKNOWN, 0.0]])[:, None]


class Scorer:
    """Word vectors of log-probabilities, kept in a bounded memo."""

    def __init__(self, model: dict, limit: int = MEMO_LIMIT):
        self.lattice = Lattice(_vocabulary(model["pieces"]))
        self.prob = model["prob"].astype(np.float64)
        self.limit, self.width = limit, len(model["langs"])
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.limit:
            self.index.clear()
            new = list(words)
        at = len(self.index)
        while at + len(new) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[at:at + len(new)] = 0
        order = sorted(range(len(new)), key=lambda i: len(new[i]))
        for k in range(0, len(order), GROUP):
            group = order[k:k + GROUP]
            self.rows[at + np.array(group)] = self.lattice.log_forward([new[i] for i in group], self.prob)
        self.index.update(zip(new, range(at, at + len(new))))

    def score(self, texts: list[str | None]) -> tuple[list[int], list[float]]:
        """For each text the best language's place (-1: none) and its posterior."""
        words = [words_of(t) if t else [] for t in texts]
        need = set().union(*words)
        if not need <= self.index.keys():
            self._learn(need)
        best, posterior = [], []
        for ws in words:
            if not self.width or not _has_letter(ws):
                best.append(-1)
                posterior.append(0.0)
                continue
            at = np.fromiter(map(self.index.__getitem__, ws), dtype=np.int64, count=len(ws))
            total = self.rows[at].sum(axis=0) / np.sqrt(len(ws))
            e = np.exp(total - total.max())
            best.append(int(total.argmax()))
            posterior.append(float(e.max() / e.sum()))
        return best, posterior


_SCORERS: dict[tuple, Scorer] = {}


def predict(docs: DataFrame, model: dict, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; only the text is scored."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(model)  # vocabulary times languages, bounded above
    key = hash((tuple(model["langs"]), model["prob"].tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer, langs = _SCORERS[key], [*shared.value["langs"], "und"]
        for batch in batches:
            column = batch.column(2)
            for a, b in blocks(column):
                best, score = scorer.score(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                                  pa.array([langs[i] for i in best], pa.string()), pa.array(score, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"),
                       docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod(docs["doc_id"], 4) == 2, F.lit(False))
    model = learn(sample(docs.filter(~held_out)), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model, held_out)
