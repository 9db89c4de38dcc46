"""Quality classifier over document statistics (operator 8).

A Gaussian kernel over standardised document statistics is approximated by random Fourier features. Each
partition sums its part of the normal equations; the sums are added by row of the matrix, so that what reaches
the driver is one matrix of a fixed size, and ridge scores are solved there. Scores are then calibrated by
isotonic regression over a fixed grid, counted from labelled rows that the fit did not see. All labelled rows
outside the held-out fold take part: there is no sample. Partial sums are added in groups of ``TOGETHER`` partitions
first, so that no task gathers those of all partitions.

Folds go by crc32 of the key as text, modulo ``folds``: remainder 0 is held out, remainder 1 calibrates, the
others fit. Labels other than 0 and 1 are not used; of several labels of a key, the least counts. The statistics come
from the whole text alone. Null and empty texts have the statistics of no words and are scored like any other;
repeated rows each get their score; other columns are not read. With no labelled rows, or rows of one label
only, every score is the mean label (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, release, written
from .piece_codec import in_portions
from .quality_rules import COMMON_WORDS

COMMON = frozenset(w for ws in COMMON_WORDS.values() for w in ws)
#: Classes of bytes.
LOWER, UPPER, DIGIT, SPACE, LINE, POINT, SYMBOL, BANG, BAR, LEAD, INNER, OTHER = range(12)
N_STATS = 17
GRID = 500
TOGETHER = 64


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0], table[0xC0:] = INNER, LEAD
    for chars, kind in (
        ("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT),
        (" \t\r\x0b\x0c", SPACE), ("\n", LINE), (".,;:'\"()?-", POINT), ("#*$%&<>@=", SYMBOL), ("!", BANG), ("|", BAR),
    ):
        table[list(chars.encode())] = kind
    return table


CLASSES = _byte_classes()


def statistics(texts: list[str]) -> np.ndarray:
    """A row of N_STATS numbers for each text, from its bytes, words and lines."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    kinds = CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    own = np.repeat(np.arange(len(texts), dtype=np.int64) * 12, sizes)
    own += kinds
    count = np.bincount(own, minlength=12 * len(texts)).reshape(-1, 12).astype(float)
    chars = np.maximum(sizes - count[:, INNER], 1.0)
    letters = np.maximum(count[:, LOWER] + count[:, UPPER] + count[:, LEAD], 1.0)
    out = np.zeros((len(texts), N_STATS))
    for k, t in enumerate(texts):
        words = t.split()
        n = len(words)
        lines = [x for x in t.split("\n") if x and not x.isspace()]
        if n:
            out[k, 0] = np.log1p(n)
            different = len(set(words))
            out[k, 1] = different / n
            out[k, 2] = np.log1p(different) / np.log1p(n)
            out[k, 3] = sum(map(str.__eq__, words, words[1:])) / n
            out[k, 4] = len([1 for w in words if w in COMMON]) / n
            out[k, 5] = 1 - len(set(lines)) / len(lines)
            out[k, 6] = np.log1p((sizes[k] - count[k, SPACE] - count[k, LINE] - count[k, INNER]) / n)
            # windows of three words that came before: repeated stretches
            out[k, 7] = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 0.0  # noqa: B905
    out[:, 8] = count[:, UPPER] / letters
    out[:, 9] = np.sqrt(count[:, DIGIT] / chars)
    out[:, 10] = np.sqrt(count[:, LINE] / chars)
    out[:, 11] = count[:, POINT] / chars
    out[:, 12] = np.sqrt(count[:, SYMBOL] / chars)
    out[:, 13] = np.sqrt(count[:, BANG] / chars)
    out[:, 14] = np.sqrt(count[:, BAR] / chars)
    out[:, 15] = np.sqrt((count[:, LEAD]) / chars)
    out[:, 16] = count[:, SPACE] / chars
    return out


def statistics_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, stats): written once, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [statistics(texts[a:b]) for a, b in in_portions(texts)]
            flat = np.concatenate(rows).astype(np.float32) if rows else np.empty((0, N_STATS), np.float32)
            stats = pa.ListArray.from_arrays(
                pa.array(np.arange(0, flat.size + 1, N_STATS), pa.int32()), pa.array(flat.ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"doc_id {kind}, stats array<float>"), "stats")


class Fourier:
    """Random Fourier features of a Gaussian kernel over standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.turn = rng.normal(size=(len(mean), n)) / width
        self.shift = rng.uniform(0, 2 * np.pi, n)
        self.scale = np.sqrt(2 / n)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.shift) * self.scale, np.ones((len(z), 1))])


def _stats_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_STATS)


def _normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows (stats, label) of the outer product of features and of features times label."""
    n = features.turn.shape[1] + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                f = features(_stats_of(piece.column(0)))
                y = piece.column(1).to_numpy(zero_copy_only=False).astype(float)
                total[:, :n] += f.T @ f
                total[:, n] += f.T @ y
        if total[n - 1, n - 1]:
            some = pa.array([TaskContext.get().partitionId() // TOGETHER] * n, pa.int32())
            yield pa.RecordBatch.from_arrays([some, pa.array(range(n), pa.int32()), pa.array(list(total))], ["some", "row", "cells"])

    def added(parts: pa.Table) -> pa.Table:
        cells = parts.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, n + 1).sum(axis=0)
        return pa.table({"row": pa.array([parts.column("row")[0].as_py()], pa.int32()), "cells": pa.array([cells])})

    schema = "row int, cells array<double>"
    parts = rows.select("stats", "label").mapInArrow(lean(part), f"some int, {schema}")
    sums = parts.groupBy("some", "row").applyInArrow(added, schema).groupBy("row").applyInArrow(added, schema)
    matrix = np.zeros((n, n + 1))
    for r in sums.collect():  # n rows of n + 1 numbers, whatever the input
        matrix[r["row"]] = r["cells"]
    return matrix[:, :n], matrix[:, n]


def isotonic(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing calibrated values of a grid of cells, by pooling adjacent violators. Each cell also holds
    a thousandth of a row of the share that its place suggests, which settles cells without rows."""
    blocks: list[list[float]] = []
    places = np.clip(np.linspace(-0.25, 1.25, len(counts)), 0, 1)
    for p, c, place in zip(positives.tolist(), counts.tolist(), places.tolist(), strict=True):
        blocks.append([p + 1e-3 * place, c + 1e-3, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([p / c for p, c, _ in blocks], [int(n) for _, _, n in blocks])


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    n_features: int = 256,
    width: float = 4.0,
    ridge: float = 1e-3,
    seed: int = 8,
    threshold: float = 0.3,
) -> DataFrame:
    """(key, held_out, score, predicted), a row for each row of docs."""
    stats = statistics_table(docs, key, text)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    known = (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    rows = written(stats.join(known, "doc_id").where(fold != 0).withColumn("fold", fold), "labelled")
    sums = [F.sum(F.get("stats", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(N_STATS)]
    squares = [F.sum(F.pow(F.get("stats", F.lit(i)).cast("double"), F.lit(2.0))).alias(f"q{i}") for i in range(N_STATS)]
    own = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos"), *sums, *squares).first()
    prior = own["pos"] / own["n"] if own["n"] else 0.5
    grid, scorer, weights = np.full(GRID, prior), None, None
    if own["n"] and 0 < prior < 1:
        mean = np.array([own[f"s{i}"] for i in range(N_STATS)]) / own["n"]
        var = np.array([own[f"q{i}"] for i in range(N_STATS)]) / own["n"] - mean**2
        scorer = Fourier(mean, np.sqrt(np.maximum(var, 1e-6)), n_features, width, seed)
        gram, target = _normal_equations(rows.where("fold <> 1"), scorer)
        if gram[-1, -1]:
            penalty = np.eye(len(gram)) * ridge * max(gram[-1, -1], 1.0) / 100
            penalty[-1, -1] = 1e-9
            weights = np.linalg.solve(gram + penalty, target)

            def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    raw = scorer(_stats_of(batch.column(0))) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(_cell(raw), pa.int32()), batch.column(1)], ["cell", "label"])

            counted = (
                rows.where("fold = 1").select("stats", "label").mapInArrow(lean(cells), "cell int, label double")
                .groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()
            )
            n, pos = np.zeros(GRID), np.zeros(GRID)
            for r in counted:
                n[r["cell"]], pos[r["cell"]] = r["n"], r["pos"]
            grid = isotonic(pos, n) if n.sum() else np.linspace(0, 1, GRID)
    release(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if weights is None:
                got = np.full(batch.num_rows, prior)
            else:
                got = grid[_cell(scorer(_stats_of(batch.column(1))) @ weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.select("doc_id", "stats").mapInArrow(lean(score), f"doc_id {kind}, score double")
    return scored.select(
        F.col("doc_id").alias(key),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _cell(raw: np.ndarray) -> np.ndarray:
    """Place of raw scores on the grid, which spans a little more than the labels 0 to 1."""
    return np.clip(((raw + 0.25) / 1.5 * GRID).astype(int), 0, GRID - 1)
