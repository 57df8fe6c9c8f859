"""5. Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms. Each white-space word gives its form (letters by case, digits and other
characters as they are, runs written once), pairs of neighbouring forms give
another term, and a word that repeats the one before it a third; words
themselves are hashed into a fixed number of terms. A word above ``PART_CHARS``
characters (unspaced scripts, encoded runs, minified code) is cut into
consecutive parts, and each part counts as a word. A text's vector holds
damped, length-normalised term shares weighted by inverse document frequency,
which is counted over all documents.

Space. A singular value decomposition of the labelled vectors (on the driver,
from a bounded sample: ``max_labelled`` rows, the smallest by a hash of the id,
times ``TERMS`` columns; if ids repeat in the documents, the first four times as
many matches by the hashes of id and text) gives the latent directions.

Voting. The labelled latent vectors are broadcast (max_labelled x rank floats,
about 1 MB); every document's cosine with every one of them is computed exactly
in blocks, and the nearest ``NEIGHBOURS`` vote, each with a power of its
similarity; the score is the share of the votes for label 1.

Cases: null and empty texts have the zero vector and get the sample's share of
label 1 as score; conflicting or repeated labels count one by one; labels that
are null or neither 0 nor 1 are ignored; ties in similarity go to the smaller
id; without any label all scores are 0.5; repeated rows are scored one by one.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.llm.common import crc32_mod, on_workers, read_table
from revisio.llm.units import blocks

#: Columns of the term space: forms, pairs of forms, and hashed words.
FORMS, PAIRS, WORDS = 512, 1024, 512
TERMS = FORMS + PAIRS + WORDS
RANK = 48
NEIGHBOURS = 15
#: Bound of the labelled sample (documented parameter).
MAX_LABELLED = 6000
THRESHOLD = 0.3
MEMO_LIMIT = 300_000
#: Longest word that is one term; longer ones are cut, and all their parts count.
PART_CHARS = 64

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_RUN = re.compile(r"(.)\1+", re.S)
_PART = re.compile(rf"\S{{1,{PART_CHARS}}}")


def form(word: str) -> str:
    """Letters become a or A, digits 0; runs are written once."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", out)


def words_of(text: str) -> list[str]:
    """White-space words, long ones in parts of at most PART_CHARS."""
    words = text.split()
    return _PART.findall(text) if max(map(len, words), default=0) > PART_CHARS else words


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


class Terms:
    """Texts to sparse rows of term shares; forms are kept in a bounded memo."""

    def __init__(self, limit: int = MEMO_LIMIT):
        self.memo: dict[str, int] = {}
        self.limit = limit

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = list(words)
        for w in new:  # both columns in one number
            self.memo[w] = _bucket(form(w), FORMS) * WORDS + _bucket(w.lower(), WORDS)

    def rows(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) if t else [] for t in texts]
        need = set().union(*words)
        if not need <= self.memo.keys():
            self._learn(need)
        out = np.zeros((len(texts), TERMS), dtype=np.float32)
        get = self.memo.__getitem__
        for row, ws in zip(out, words):
            if not ws:
                continue
            code = np.fromiter(map(get, ws), dtype=np.int64, count=len(ws))
            forms, hashed = code // WORDS, code % WORDS
            row[:FORMS] = np.bincount(forms, minlength=FORMS)
            pair = (forms[:-1] * 31 + forms[1:]) % (PAIRS - 1)
            again = code[:-1] == code[1:]
            row[FORMS:FORMS + PAIRS - 1] = np.bincount(pair[~again], minlength=PAIRS - 1)
            row[FORMS + PAIRS - 1] = again.sum()
            row[FORMS + PAIRS:] = np.bincount(hashed, minlength=WORDS)
            row /= len(ws)
        return np.sqrt(out)  # damped: a term in 1 % of the words weighs a tenth of one in all


_TERMS: dict[str, Terms] = {}


def _terms() -> Terms:
    return _TERMS.setdefault("terms", Terms())


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows of ``docs`` and for each term the number that have it.

    Each task adds up its own rows, so at most TERMS + 1 numbers a task are
    summed by Spark, and as many reach the driver.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TERMS + 1, dtype=np.int64)  # the last: rows
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                n[:TERMS] += (_terms().rows(batch.column(0).slice(a, b - a).to_pylist()) > 0).sum(axis=0)
                n[TERMS] += b - a
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["term", "n"])

    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[TERMS]), out[:TERMS]


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK) -> dict:
    """The latent space and the labelled vectors, from at most ``max_labelled``
    labelled rows, those with the smallest hash of the id."""
    spark = docs.sparkSession
    on_workers(spark)
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).filter("quality in (0, 1)")
    total = max(1, marks.count())
    # A threshold on a uniform hash takes the share that is wanted, without a sort of all labels.
    share = min(1.0, 1.2 * max_labelled / total)
    marks = marks.withColumn("_h", F.xxhash64("doc_id")).filter((F.col("_h").cast("double") / 2.0**64 + 0.5) <= share) \
        .orderBy("_h", "doc_id", "quality").limit(max_labelled)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")) \
        .join(F.broadcast(marks.drop("_h")), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("_t"))  # at most max_labelled narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(2)):
                rows = _terms().rows(batch.column(2).slice(a, b - a).to_pylist())
                at = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.astype("<i2").tobytes() for x in at], pa.binary()),
                     pa.array([r[x].astype("<f4").tobytes() for r, x in zip(rows, at)], pa.binary()),
                     batch.column(3).slice(a, b - a)], ["doc_id", "quality", "cols", "vals", "_t"])

    found = texts.mapInArrow(run, "doc_id long, quality int, cols binary, vals binary, _t long") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_t", "quality", "vals", "cols").limit(4 * max_labelled).collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["quality"], bytes(r["vals"]), bytes(r["cols"])))
    x = np.zeros((len(found), TERMS), dtype=np.float32)
    for row, r in zip(x, found):
        row[np.frombuffer(r["cols"], "<i2")] = np.frombuffer(r["vals"], "<f4")
    y = np.array([r["quality"] for r in found], dtype=np.float32)
    if not len(found):
        return {"share": 0.5, "vectors": np.zeros((0, 1), np.float32), "y": y, "project": np.zeros((TERMS, 1), np.float32)}
    total, having = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + having)) + 0.1
    x = _unit(x * idf)
    # Singular vectors by the terms' own products: TERMS x TERMS, whatever the sample.
    value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
    keep = np.argsort(value)[::-1][:min(rank, len(found))]
    project = vector[:, keep] * np.sign(vector[np.abs(vector[:, keep]).argmax(axis=0), keep])
    project = (idf[:, None] * project).astype(np.float32)
    return {"share": float(y.mean()), "vectors": _unit((x / idf) @ project).astype(np.float32), "y": y, "project": project}


def vote(model: dict, rows: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    labelled, y = model["vectors"], model["y"]
    out = np.full(len(rows), model["share"])
    if not len(y):
        return out
    k = min(neighbours, len(y))
    for at in range(0, len(rows), block):
        latent = _unit(rows[at:at + block] @ model["project"])
        near = latent @ labelled.T
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** 4
        mass = weight.sum(axis=1)
        known = (mass > 0) & (np.abs(latent).sum(axis=1) > 0)
        out[at:at + block][known] = (weight * y[best]).sum(axis=1)[known] / mass[known]
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; only the text is scored."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(2)):
                s = vote(shared.value, _terms().rows(batch.column(2).slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s, pa.float64()),
                                                  pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), docs["text"].cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored at the threshold or above, with their columns."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(vote(shared.value, _terms().rows(part.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc32_mod(docs["doc_id"], 5) == 0, F.lit(False))
    return score(docs, learn(docs, labels.filter(crc32_mod(labels["doc_id"], 5) != 0)), held_out)
