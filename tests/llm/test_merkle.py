"""Operator 13 against a plain tree."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from revisio.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, pos int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(lv, at):
    out = []
    for nodes in lv[:-1]:
        run = nodes[at // 3 * 3:at // 3 * 3 + 3]
        out.append((at % 3, run[:at % 3] + run[at % 3 + 1:]))
        at //= 3
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(top, k)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "")) if tampered else h
            for i, others in path:
                node = sha(others[:i] + [node] + others[i:])
            out.append((r[0], h, trees[s][-1][0], top[-1][0], sha([x for _, o in path for x in o]), node, node == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, partitions=3):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(partitions)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return sorted((tuple(r) for r in merkle.manifest(docs, even).collect()), key=str)


MIXED = [(i * 37 - 900, f"s{i % 5}", "en", i, f"line {i}\nnext\n" if i % 3 else "plain") for i in range(60)] + [
    (1, None, None, None, None), (2, None, "de", 5, ""), (None, "s1", None, 3, "null id\n"), (None, "s1", None, 4, "null id\n"), (None, None, None, None, None),
    (None, "only", "en", 1, "x"), (7, "é", "en", 1, "x\n"), (8, "z", "en", 1, "\n"), (9, "", "en", 1, "y"), (2**63 - 1, "s0", "en", 1, "a\n"),
    (-2**63, "s0", "en", 1, "b\n"), (2**40 + 63, "s0", "en", 1, "c"), (2**40 + 64, "s0", "en", 1, "c"), (-1, "s0", "en", 1, "d"), (0, "s0", "en", 1, "d")]
COPIES = [(5, "s", "en", 1, "copy\n")] * 40 + [(5, "s", "en", 1, f"other {i}") for i in range(9)] + [(i, "s", "en", 1, "t\n") for i in range(12)] + [(4, "s", "en", 1, "t\n")]


@pytest.mark.parametrize("rows", [MIXED, COPIES, MIXED + COPIES + MIXED, [(3, "a", "en", 1, "alone\n")], [(2, "a", None, None, "alone")]])
def test_equals_a_plain_tree(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_trees_of_several_steps_and_many_sources(spark):
    rows = [(i * 11, "big", "en", i, f"text {i}\n") for i in range(2300)] + [(i, f"source{i}", "en", i, "a\nb") for i in range(800)] + \
        [(10**6 + i, "block", "en", i, "c\n") for i in range(729)] + [(10**7 + i, "more", "en", i, "c\n") for i in range(730)]
    assert run(spark, rows) == brute(rows)


def test_copies_by_the_thousand_take_places_in_a_row(spark):
    rows = [(5, "s", "en", 1, "copy\n")] * 2500 + [(None, "s", "en", 1, "n")] * 1100 + [(6, "s", "en", 1, "last")]
    assert run(spark, rows, 5) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_registered_query_verifies_what_was_not_changed(spark):
    got = merkle.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
