import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from revisio.plans.recipes import RECIPES, generate
from revisio.sources import standins as S
from revisio.sources.prompts import load_prompts
from revisio.streaming import stream_examples


def test_stream_matches_batch(spark):
    cat = load_prompts()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    src = tempfile.mkdtemp(prefix="revisio-stream-")
    docs.write.mode("overwrite").parquet(f"{src}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{src}/in")
    corpus = S.related_from(stream).select("row_id", "split", F.col("text").alias("normal"),
                                           F.col("edited").alias("simple"))
    out = stream_examples(corpus, RECIPES["wiki_auto"], cat, 3)
    q = out.writeStream.format("memory").queryName("wiki_stream").outputMode("append") \
        .option("checkpointLocation", f"{src}/ckpt").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM wiki_stream")
    batch = generate(RECIPES["wiki_auto"], S.wiki_auto_corpus(spark, SF_SMALL), cat, 3, shuffle=None) \
        .filter(F.col("type") != "no edit").drop("type")
    cols = ["row_id", "variant", "input", "output", "from"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_metrics_json_sorted_keys(spark):
    from revisio.sources.sinks import metrics_json
    m = spark.createDataFrame([("rouge1", 1.5), ("bleu", 2.0)], "metric string, value double")
    assert metrics_json(m, "eval_").collect()[0].value == '{"eval_bleu":2.0,"eval_rouge1":1.5}'


def test_prompt_catalogue_layout():
    cat = load_prompts()
    for g in ("gec", "coherence", "simplification", "paraphrasing", "neutralization", "offensive", "toxic",
              "formality", "formality_rev", "do_not_edit"):
        assert cat[g], g
    for r in RECIPES.values():
        assert r.group in cat and (r.reverse_group is None or r.reverse_group in cat)


def test_with_row_id_is_unique_and_stable(spark):
    from revisio.sources.corpus import with_row_id
    df = with_row_id(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"))
    a = df.select("row_id").distinct().count()
    assert a == df.count()
    b = sorted(r.row_id for r in with_row_id(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"))
               .repartition(5).select("row_id").collect())
    assert b == sorted(r.row_id for r in df.select("row_id").collect())


def test_stream_has_both_directions(spark):
    cat = load_prompts()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = stream_examples(S.gyafc_corpus(spark, SF_SMALL), RECIPES["gyafc"], cat, 3)
    assert {r[0] for r in got.select("from").distinct().collect()} == {"gyafc_formal", "gyafc_informal"} and docs.count()


def test_predictions_keep_the_order_of_examples(spark):
    from revisio.session import scratch_path
    from revisio.sources.sinks import write_predictions
    path = scratch_path(spark, f"test-predictions-{os.getpid()}")
    df = spark.range(1000).select(F.format_string("%05d", F.col("id")).alias("row_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prediction"))
    write_predictions(df.repartition(7), path)
    folder = path.removeprefix("file://").removeprefix("file:")
    lines = [x.rstrip("\n") for f in sorted(os.listdir(folder)) if f.startswith("part-") for x in open(os.path.join(folder, f))]
    assert lines == [f"p{i}" for i in range(1000)]


def test_build_reads_corpora_by_name(spark):
    import yaml
    from revisio.plans.recipes import OUT_COLS, build_all
    from revisio.session import scratch_path
    root = scratch_path(spark, f"test-build-{os.getpid()}")
    S.wiki_large_corpus(spark, SF_SMALL).write.partitionBy("split").parquet(f"{root}/in/my_wiki")
    config = tempfile.mkdtemp(prefix="revisio-config-") + "/c.yaml"
    with open(config, "w") as fh:
        yaml.safe_dump({"datasets": [{"wiki_large": {"name": "my_wiki", "use": True}}, {"lang8": {"use": False}}]}, fh)
    got = build_all(spark, config, f"{root}/in", f"{root}/out", seed=4)
    expect = generate(RECIPES["wiki_large"], S.wiki_large_corpus(spark, SF_SMALL), load_prompts(), 4)
    assert sorted(map(tuple, got.select(OUT_COLS).collect())) == sorted(map(tuple, expect.select(OUT_COLS).collect()))
