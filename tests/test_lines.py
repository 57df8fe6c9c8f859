"""Global line numbers over files and blocks, and pairing by position."""
import pytest

from revisio.sources.lines import numbered_lines, pair_lines
from revisio.sources.sinks import write_predictions


def write(folder, files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


FILES = {"part-00000": "a\nb\n\nd\n", "part-00001": "", "part-00010": "e", "part-00002": "c2\n\n", "part-100000": "last\n"}
LINES = ["a", "b", "", "d", "c2", "", "e", "last"]


def test_lines_count_over_files_in_part_order(spark, tmp_path):
    got = numbered_lines(spark, write(tmp_path / "t", FILES)).orderBy("line").collect()
    assert [(r.line, r.value) for r in got] == list(enumerate(LINES))


@pytest.mark.parametrize("block", [3000, 7919])
def test_files_cut_into_blocks(spark, tmp_path, block):
    lines = [f"line {i} " + "x" * (i * 37 % 90) for i in range(700)]
    path = write(tmp_path / "t", {"part-00000": "\n".join(lines[:500]) + "\n", "part-00001": "\n".join(lines[500:])})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = numbered_lines(spark, path).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [(r.line, r.value) for r in got] == list(enumerate(lines))


def test_long_blocks_span_batches(spark, tmp_path):
    path = write(tmp_path / "t", {"part-00000": "".join(f"{i}\n" for i in range(25_000))})
    got = numbered_lines(spark, path)
    assert got.filter("cast(value as long) != line").count() == 0 and got.count() == 25_000


def test_pairs_by_position_and_unequal_lengths(spark, tmp_path):
    p = write(tmp_path / "p", FILES)
    r = write(tmp_path / "r", {"part-00000": "A\nB\nC\n", "part-00001": "D\nE\nF\nG\nH\n"})
    got = pair_lines(spark, p, r).orderBy("line").collect()
    assert [(x.prediction, x.reference) for x in got] == list(zip(LINES, "ABCDEFGH"))
    short = write(tmp_path / "s", {"part-00000": "A\nB\n"})
    with pytest.raises(Exception, match="no partner for line"):
        pair_lines(spark, p, short).collect()


def test_no_files_give_no_lines(spark, tmp_path):
    assert numbered_lines(spark, write(tmp_path / "t", {"part-00000": ""})).collect() == []


def test_lines_meet_without_their_texts(spark, tmp_path):
    """Before, the texts of both sides went through the join's shuffles, and through the sort of the writer."""
    rows = [(f"{i:04d}", f"p{i}\n\\{'é' * (i % 50)}" if i % 9 else None, f"r {i}" if i % 7 else "") for i in range(500)]
    df = spark.createDataFrame(rows, "row_id string, prediction string, reference string").repartition(7)
    paths = [str(tmp_path / n) for n in ("prediction", "reference")]
    for path, col in zip(paths, ("prediction", "reference")):
        write_predictions(df, path, col)
    got = pair_lines(spark, *paths)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.rindex("MapInArrow") < plan.index("Exchange ")
    want = [((p or "").replace("\\", "\\\\").replace("\n", "\\n"), r) for _, p, r in rows]
    assert [(r.prediction, r.reference) for r in got.orderBy("line").collect()] == want


def test_lines_meet_where_files_cannot_be_read_plainly(spark, tmp_path, monkeypatch):
    from revisio.sources import lines, sinks
    for module in (lines, sinks):
        monkeypatch.setattr(module, "can_put_aside", lambda spark: False)
    df = spark.createDataFrame([(f"{i:03d}", f"p{i}", f"r{i}") for i in range(40)], "row_id string, prediction string, reference string")
    paths = [str(tmp_path / n) for n in ("prediction", "reference")]
    for path, col in zip(paths, ("prediction", "reference")):
        write_predictions(df, path, col)
    assert [tuple(r) for r in pair_lines(spark, *paths).orderBy("line").collect()] == [(i, f"p{i}", f"r{i}") for i in range(40)]
