"""Toxicity by a character n-gram classifier with naive Bayes log-count ratios (operator 6).

The features of a text are the character n-grams of ``orders`` characters within its different words (lower case,
marks at the ends of words taken off, a space on either side), hashed to ``buckets``, counted, and divided by the
root of their number plus ``damping``, so that neither repetition nor length adds up. Each feature is scaled by
the log-ratio of the smoothed shares of toxic and of other labelled texts that have it (0 where fewer than
``support`` texts do), and a logistic model is fitted to the scaled features by full gradient steps, beginning
from the ratios alone and drawn to them by ``pull``.

The fit uses a bounded sample of labelled rows: of each label the ``sample`` keys with the least hash, outside
the held-out fold (crc32 of the key as text, modulo ``folds``, is 0). Their texts are whole, are read by a join
with these at most 2 * ``sample`` keys, and the fit runs in one task. Both labels
weigh the same, so that 0.5 is where a text is as likely under either. Every text of the table is then scored, whole.

Null labels are not used; of several labels of a key, the greatest counts. Null and empty texts have no features
and get the score of the intercept; repeated rows each get their score; other columns are not read. Without
labels of both kinds every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, written
from .piece_codec import in_portions

#: What is taken off the ends of a word.
MARKS = ".,;:!?*%$&#|()\"'"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_once(text: str) -> str:
    """The different words of a text in lower case without the marks around them, a space around each."""
    return f" {' '.join(dict.fromkeys([w.strip(MARKS) for w in text.lower().split()]))} "


def ngrams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (bucket of each n-gram, text of it). N-grams across words get a bucket of no weight."""
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    shift = np.uint64(65 - int(buckets).bit_length())
    space = points == 32
    mark, across = points + np.uint64(1), np.zeros(len(points), bool)
    for n in range(2, max(orders) + 1):
        if len(mark) < 2:
            return
        mark = mark[:-1] * MIX + points[n - 1 :] + np.uint64(1)
        mark ^= mark >> np.uint64(29)
        # a space may stand first or last, not between
        across = across[:-1] | (space[n - 2 : -1] if n > 2 else (space[:-1] & space[1:]))
        if n in orders:
            yield np.where(across, buckets, (mark * MIX >> shift).astype(np.int64)), own[: len(mark)]


def norms(texts: list[str], damping: float) -> np.ndarray:
    return np.sqrt(np.array([len(t) for t in texts]) + damping)


def sums(texts: list[str], weights: np.ndarray, orders: tuple[int, ...], damping: float) -> np.ndarray:
    """Weighted sum of the features of each text; weights ends in a 0 for n-grams across words."""
    texts = [words_once(t) for t in texts]
    total = np.zeros(len(texts))
    for bucket, own in ngrams(texts, orders, len(weights) - 1):
        total += np.bincount(own, weights[bucket], len(texts))
    return total / norms(texts, damping)


def fit(
    texts: list[str], labels: np.ndarray, orders, buckets: int, damping: float, steps: int, support: int, pull: float
) -> np.ndarray:
    """Weights of the buckets, a 0, and last the intercept at equal shares of both labels."""
    texts = [words_once(t) for t in texts]
    keys, counts = [], []
    for begin, end in in_portions(texts):
        parts = [own * np.int64(buckets + 1) + bucket for bucket, own in ngrams(texts[begin:end], orders, buckets)]
        if parts:
            key, count = np.unique(np.concatenate(parts), return_counts=True)
            inside = key % (buckets + 1) < buckets
            keys.append(key[inside] + begin * np.int64(buckets + 1))
            counts.append(count[inside].astype(np.float32))
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    value = np.concatenate(counts) if counts else np.empty(0, np.float32)
    row, column = (key // (buckets + 1)).astype(np.int32), (key % (buckets + 1)).astype(np.int32)
    # texts of each label that have the n-gram
    have = [np.bincount(column[labels[row] == k], minlength=buckets) for k in (0, 1)]
    n = [max((labels == k).sum(), 1) for k in (0, 1)]
    ratio = np.log((have[1] + 1) / (n[1] + 2)) - np.log((have[0] + 1) / (n[0] + 2))
    ratio[have[0] + have[1] < support] = 0
    kept = ratio[column] != 0
    row, column, value = row[kept], column[kept], value[kept]
    x = value / norms(texts, damping)[row].astype(np.float32) * ratio[column].astype(np.float32)
    side = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])

    def margin(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, x * v[column], len(texts))

    begin = np.ones(buckets, np.float32)
    base = margin(begin)
    begin /= np.std(base) or 1.0
    v, bias, squares, bias_squares = begin.copy(), -np.median(base * begin[0]), np.zeros(buckets, np.float32), 0.0
    for _ in range(steps):
        slope = -side * share / (1 + np.exp(np.clip(side * (margin(v) + bias), -30, 30)))
        g = np.bincount(column, x * slope[row].astype(np.float32), buckets).astype(np.float32) + pull * (v - begin)
        squares += g * g
        v -= 0.5 * g / (np.sqrt(squares) + 1e-6)
        step = slope.sum()
        bias_squares += step * step
        bias -= 0.5 * step / (np.sqrt(bias_squares) + 1e-9)
    return np.r_[v * ratio, 0.0, bias]


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    sample: int = 2000,
    orders: tuple[int, ...] = (3, 4, 5),
    buckets: int = 1 << 19,
    damping: float = 30.0,
    steps: int = 40,
    support: int = 8,
    pull: float = 1e-4,
) -> DataFrame:
    """(key, held_out, score, predicted), a row for each row of docs."""
    fold = lambda c: F.crc32(F.col(c).cast("string")) % folds
    known = (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
        .where(fold("doc_id") != 0)
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*order).limit(sample).union(
        known.where("label = 1").orderBy(*order).limit(sample)
    )
    weights, prior = None, counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) == 2:

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted(
                (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)),
                key=lambda r: (r[0], r[1]),
            )
            if rows:
                got = fit([t for t, _ in rows], np.array([y for _, y in rows]), orders, buckets, damping, steps, support, pull)
                used = np.r_[np.flatnonzero(got[:-1]), len(got) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(got[used])], ["at", "w"])

        texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        with scratch():
            learned = written(
                texts.join(F.broadcast(picked), "doc_id").select("text", "label").repartition(1)
                .mapInArrow(lean(train), "at int, w double"),
                "weights",
            ).toArrow()  # no more rows than buckets
        if learned.num_rows:
            weights = np.zeros(buckets + 2)
            weights[learned.column("at").to_numpy()] = learned.column("w").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if own is None:
                got = np.full(len(texts), prior)
            else:
                parts = [sums(texts[a:b], own[:-1], orders, damping) for a, b in in_portions(texts, 500_000)]
                got = 1 / (1 + np.exp(-np.clip(np.concatenate(parts or [np.empty(0)]) + own[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key), F.col(text)).mapInArrow(lean(score), f"doc_id {kind}, score double")
    return scored.select(
        F.col("doc_id").alias(key),
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
