"""The two classifiers on held-out labels, and their edge cases."""

import random

import numpy as np
import pytest

from quillon.llm.quality_classifier import isotonic, quality_scores, statistics
from quillon.llm.toxicity import toxicity_scores

from ..conftest import DATA

SF = f"{DATA}/sf0.01"


def held_out_accuracy(scores, labels, label):
    known = scores.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return np.mean([r[0] == r[1] for r in known])


@pytest.mark.parametrize(("scorer", "label", "least"), [(quality_scores, "quality", 0.95), (toxicity_scores, "toxic", 0.9)])
def test_held_out(spark, scorer, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = scorer(docs, labels)
    rows = scores.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert held_out_accuracy(scores, labels, label) >= least


@pytest.mark.parametrize(("scorer", "label"), [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_edges(spark, scorer, label):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice(["good", "bad", "x"]) for _ in range(rnd.randint(0, 30))), "s", 1.0) for k in range(120)]
    rows += [(500, None, "s", 1.0), (501, "", "s", 1.0), (502, "w " * 50_000, "s", 1.0), (None, "no key", "s", 1.0)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string, score double")
    told = [(k, int("bad" in (t or ""))) for k, t, _, _ in rows if k is not None and k % 2]
    told += [(1, 1), (1, 0), (2, None), (None, 1), (9999, 1), (4, 2), (6, -1)]
    labels = spark.createDataFrame(told, f"doc_id long, {label} int")
    got = scorer(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is not None and not np.isnan(r.score) for r in got)
    known = labels.where(f"{label} in (0, 1)")
    assert {(r.doc_id, r.score) for r in scorer(docs, known).collect()} == {(r.doc_id, r.score) for r in got}
    for some in (labels.where("false"), labels.where(f"{label} = 1"), labels.where(f"{label} = 2")):
        assert len({r.score for r in scorer(docs, some).collect()}) == 1
    assert scorer(docs.where("false"), labels).count() == 0


def test_isotonic_grid():
    grid = isotonic(np.array([0, 3, 1, 0, 9.0]), np.array([5, 4, 4, 0, 9.0]))
    assert (np.diff(grid) >= 0).all() and grid[0] < 0.01 and abs(grid[1] - 0.5) < 0.01 and grid[-1] > 0.99


def test_statistics_take_any_text():
    assert np.isfinite(statistics(["", " ", "\n", "é", "a" * 100_000, "a b c a b c", "!!! ### |"])).all()
