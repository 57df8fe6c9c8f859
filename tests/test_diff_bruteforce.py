"""Difference masks have no SQL form; check them against a plain-Python
brute force on the smallest tables."""
import difflib
import itertools
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from revisio.operators import diff as D
from revisio.operators.pairs import masked_pairs
from revisio.sources import standins as S


def encode(words, mask):
    """By the definition: group the words by mask, then write each group."""
    groups = [(m, [w for w, _ in g]) for m, g in itertools.groupby(zip(words, mask), key=lambda x: x[1])]
    hidden = [g for m, g in groups if m]
    numbers = itertools.count()
    masked = [w for m, g in groups for w in ([f"<extra_id_{next(numbers)}>"] + [""] * (len(g) - 1) if m else g)]
    target = "".join(f"<extra_id_{i}> {' '.join(g)} " for i, g in enumerate(hidden)) + f"<extra_id_{len(hidden)}>"
    return " ".join(masked), target if hidden else ""


def runs(mask):
    out, start = [], None
    for i, m in enumerate(mask + [False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            out.append((start, i))
            start = None
    return out


def test_diff_masks_match_bruteforce(spark):
    src = S.c4_corpus(spark, SF_SMALL).filter(F.col("split") == "train").select("row_id", "input", "output")
    rows = {r.row_id: (r.input, r.output) for r in src.collect()}
    got = masked_pairs(src, ["P"], 0, True, 11).collect()
    by = {}
    for r in got:
        by.setdefault(r.row_id, {})[r.variant] = r
    assert set(by) == set(rows)
    for rid, (inp, out) in rows.items():
        a, b = out.split(), inp.split()
        mask = [False] * len(a)
        for tag, i1, i2, _, _ in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if tag != "equal":
                for i in range(i1, i2):
                    mask[i] = True
        masked, target = encode(a, mask)
        d0 = by[rid]["md0"]
        assert d0.input == f"P: {inp} -> {masked}" and d0.output == target
        n_masked = sum(mask)
        singles = [v for v in by[rid] if v in ("md1", "md2")]
        assert len(singles) == min(2, n_masked)
        full_runs = runs(mask)
        for v in singles:
            ok = False
            for st, en in full_runs:
                sm = [st <= i < en for i in range(len(a))]
                if encode(a, sm) == (by[rid][v].input[len(f"P: {inp} -> "):], by[rid][v].output):
                    ok = True
            assert ok, (rid, v)


def _edited(rng, a):
    """``a`` with some words dropped and some doubled."""
    return [w for w in a for _ in range(rng.choice([0, 2, 1, 1, 1, 1, 1, 1, 1]))]


def test_opcodes_are_the_library_s_on_random_words(monkeypatch):
    rng = random.Random(3)
    for most in (D.MAX_PLACES, 50):  # also where some texts go to the library
        monkeypatch.setattr(D, "MAX_PLACES", most)
        for _ in range(1500):
            words = rng.choice([1, 2, 3, 5, 20, 200])
            a = [rng.randrange(words) for _ in range(rng.choice([0, 1, 3, 10, 40, 150, 250, 400]))]
            b = _edited(rng, a) if rng.random() < 0.5 else [rng.randrange(words) for _ in range(rng.choice([0, 1, 5, 30, 199, 220, 300]))]
            assert D._opcodes(a, b) == difflib.SequenceMatcher(None, a, b).get_opcodes(), (a, b)


def test_long_texts_are_not_scanned_again_at_every_level(monkeypatch):
    """The library's search for one block is not called: it reads all words of its box each time."""
    def refuse(*_):
        raise AssertionError("the library scanned a box")

    rng = random.Random(4)
    a = [rng.randrange(5000) for _ in range(20_000)]
    b = _edited(rng, a)
    expected = difflib.SequenceMatcher(None, a, b).get_opcodes()
    monkeypatch.setattr(difflib.SequenceMatcher, "find_longest_match", refuse)
    assert D._opcodes(a, b) == expected
