"""The streaming sink: equal to batch, and exact over restarts and replays."""
import os

from revisio.plans import queries as Q
from revisio.plans.recipes import RECIPES, generate
from revisio.streaming import stream_to_corpus

SF = "/root/testdata/sf0.001"
COLS = ["row_id", "variant", "input", "output", "type", "from"]


def rows(df):
    return sorted(tuple(r) for r in df.select(COLS).collect())


def test_restarts_and_replayed_batches_leave_no_duplicates(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    corpus = Q.CORPUS["wiki_large"](spark, SF).cache()
    want = rows(generate(RECIPES["wiki_large"], corpus, Q.catalogue(), 5, shuffle=None).filter("type <> 'no edit'"))

    def start():
        stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_to_corpus(stream, RECIPES["wiki_large"], Q.catalogue(), out, state, 5).awaitTermination()

    even = corpus.filter("cast(row_id as long) % 2 = 0")
    even.coalesce(1).write.parquet(source)
    start()
    some = rows(spark.read.parquet(out))
    assert 0 < len(some) < len(want)
    start()  # nothing new
    assert rows(spark.read.parquet(out)) == some
    corpus.subtract(even).coalesce(1).write.mode("append").parquet(source)
    start()
    assert rows(spark.read.parquet(out)) == want
    # The last batch's commit is lost: it runs again and replaces what it wrote.
    last = max((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{f}"):
            os.remove(f"{state}/commits/{f}")
    start()
    assert rows(spark.read.parquet(out)) == want
