"""Near duplicates by circulant MinHash (operator 1).

Texts are sets of word shingles. Two permutations of the 32-bit marks make all coordinates of a signature: the
first scatters a mark, the second is shifted circularly by one more step for each coordinate, and the least value
is kept. ``rows`` coordinates make a band; texts that share a band are candidates, and two texts are linked when
their whole sets have a Jaccard similarity of at least ``percent`` hundredths, counted exactly.

With 40 bands of 5 rows a pair at 0.8 shares no band with a chance of 1e-7. A pair leaves the joins unless its odd
sketches prove it to lie below the threshold: a set's sketch has a bit for each of ``sketch`` cells, whether an odd
number of shingles falls there, and where two sketches differ the sets differ by one shingle at least. Sets of n and m
shingles that reach the threshold differ in at most (n + m) * (100 - percent) / (100 + percent), so that no link is
lost by this; sets of up to some thousand shingles are told apart sharply, larger ones are verified.

Copies (equal sets) are one node, found by a digest of the set with map-side combine. A band's texts are never
paired with each other at once: first each is compared with ``stars`` texts of its band only (that of the least
key, and others by hash), and links join them into components; after that only texts of one band that lie in
different components are compared, those outside a band's most common component with all others of the band. Verified pairs carry 8 bytes a shingle,
read again from the texts that pairs name. Components are found by alternating star steps. All steps are
written to the shared folder.

A null, empty or blank text is an empty set, linked with nothing. A text of fewer words than a shingle is one
shingle of them all. Rows of one key are one document with all their links, also where their texts differ; a row
without a key is its own document, kept, without a component. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, lean, only_keys, release, written
from .piece_codec import in_portions
from .shingles import shingle_sets


def _first(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _second(x: np.ndarray) -> np.ndarray:
    """Another one, in place."""
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of ``size`` coordinates for each set; the sets are not empty."""
    out = np.empty((size, len(sets)), np.uint32)
    begin = 0
    while begin < len(sets):  # portions that stay in the processor's cache
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + len(sets[end]) <= 30_000):
            total += len(sets[end])
            end += 1
        flat = np.concatenate(sets[begin:end])
        starts = np.cumsum([0] + [len(s) for s in sets[begin : end - 1]])
        placed = _first((flat >> np.uint64(32)).astype(np.uint32))
        for k in range(size):
            out[k, begin:end] = np.minimum.reduceat(_second(placed + np.uint32(k)), starts)
        begin = end
    return out.T


def odd_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits / 64 numbers for each set: for each cell whether an odd number of shingles falls into it."""
    out = []
    for begin in range(0, len(sets), 128):
        some = sets[begin : begin + 128]
        cell = (np.concatenate(some) & np.uint64(bits - 1)).astype(np.int64)
        cell += np.repeat(np.arange(len(some), dtype=np.int64) * bits, [len(s) for s in some])
        odd = (np.bincount(cell, minlength=len(some) * bits) & 1).astype(np.uint8).reshape(len(some), bits)
        out.append(np.packbits(odd, axis=1).view(np.int64))
    return np.concatenate(out)


def sketches(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int, sketch: int) -> DataFrame:
    """(doc_id, n, digest, bands, odd) for each row; digest and what follows are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in in_portions(texts, 1_000_000):
                sets = shingle_sets(texts[begin:end], width)
                full = [k for k, s in enumerate(sets) if len(s)]
                digest, band, odd = ([None] * len(sets) for _ in range(3))
                if full:
                    own = [sets[k] for k in full]
                    cells = np.ascontiguousarray(signatures(own, bands * rows)).reshape(len(full), bands, rows).astype(np.uint64)
                    mark = np.zeros((len(full), bands), np.uint64)
                    for r in range(rows):
                        mark = (mark ^ cells[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                        mark ^= mark >> np.uint64(32)
                    for k, m, o in zip(full, (mark >> np.uint64(32)).astype(np.int32), odd_sketches(own, sketch), strict=True):
                        digest[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                        band[k], odd[k] = m, o
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int32())),
                        pa.array(odd, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "bands", "odd"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n long, digest binary, bands array<int>, odd array<long>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), schema)


def _may_link(sketch: int, percent: int) -> Column:
    """Whether sizes n, m and sketches odd, other_odd leave it open that two sets are as similar as asked."""
    differing = F.lit(0)
    for k in range(sketch // 64):
        differing = differing + F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("other_odd", F.lit(k))))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return fits & (differing * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of which a whole set of each are as similar as asked; the table of pairs is given up."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in in_portions(texts, 1_000_000):
                sets = [s.tobytes() for s in shingle_sets(texts[begin:end], width)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
                    ["doc_id", "digest", "s"],
                )

    sets = written(
        only_keys(texts, ids).mapInArrow(lean(shingled), "doc_id long, digest binary, s binary").where("s <> x''")
        .dropDuplicates(["doc_id", "digest"]).select("doc_id", "s"),
        "sets",
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    out = written(both.mapInArrow(lean(compare), "a long, b long"), "links")
    release(sets, pairs)
    return out


def _ordered(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of met rows (node, other), once each."""
    pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    return written(pairs, "pairs")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
    sketch: int = 2048,
    stars: int = 2,
) -> DataFrame:
    """(key, n_shingles, component_id, kept), a row for each row of docs; component_id is the least key that
    links reach, and kept says that it is the row's own. Keys are integers."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = written(sketches(texts, "doc_id", "text", width, bands, rows, sketch), "sketches")
    full = table.where("digest is not null and doc_id is not null")
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = written(
        full.join(copies.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("node")))
        .dropDuplicates(["node", "digest"]).select("node", "n", "bands", "odd"),
        "nodes",
    )
    # keys with different texts: linked with the nodes of each; a node may have several sets
    texted = table.where("doc_id is not null").select("doc_id", F.coalesce("digest", F.lit(b"")).alias("digest"))
    several = written(
        texted.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high"),
        "several",
    ).toDF("id", "low", "high")
    kin = written(
        full.join(several, F.col("doc_id") == F.col("id")).select("doc_id", "digest").join(copies, "digest")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(),
        "kin",
    )
    every = nodes.select("node", F.posexplode("bands").alias("at", "band")).select(
        F.xxhash64("at", "band").alias("bucket"), "at", "node"
    )
    hubs = [F.min("node"), *(F.min_by("node", F.xxhash64("node", F.lit(turn))) for turn in range(1, stars))]
    shared = every.groupBy("bucket").agg(
        F.array(*hubs).alias("hubs"), F.min("node").alias("low"), F.max("node").alias("high")
    ).where("low < high")
    buckets = written(every.join(shared.select("bucket", "hubs"), "bucket"), "buckets")
    may = _may_link(sketch, percent)
    starred = buckets.select("node", F.explode("hubs").alias("other")).where("node <> other").distinct()
    own = nodes.select("node", "n", "odd")
    met = starred.join(own, "node").join(own.toDF("o", "m", "other_odd"), (F.col("other") == F.col("o")) & may)
    near = _verified(_ordered(met), texts, width, percent)
    links = near.union(kin)
    roots = components(links)
    known = written(
        buckets.join(roots, "node", "left").select("bucket", "at", "node", F.coalesce("root", "node").alias("root")),
        "known",
    )
    lead = (
        known.groupBy("bucket", "root").agg(F.count("*").alias("held"))
        .groupBy("bucket").agg(F.max_by("root", F.struct("held", "root")).alias("lead"), F.count("*").alias("different"))
        .where("different > 1").drop("different")
    )
    rest = written(known.join(lead, "bucket").join(nodes, "node"), "mixed")
    other = rest.where("root <> lead").select(
        F.col("bucket").alias("b"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"),
        F.col("odd").alias("other_odd"), F.col("bands").alias("other_bands"),
    )
    # a pair is compared in the first of the bands that it shares
    first = F.array_position(F.zip_with("bands", "other_bands", lambda x, y: x == y), True) == F.col("at") + 1
    apart = (F.col("root") < F.col("other_root")) | ((F.col("root") == F.col("lead")) & (F.col("root") != F.col("other_root")))
    met = rest.join(other, (F.col("bucket") == F.col("b")) & apart & may & first)
    more = _verified(_ordered(met), texts, width, percent)
    if not more.isEmpty():
        roots = components(links.union(more))
    grouped = copies.select(F.col("digest").alias("d"), "node").join(roots, "node", "left")
    grouped = grouped.select("d", F.coalesce("root", "node").alias("component"))
    release(nodes, kin, near, more, buckets, known, rest)
    bare = table.where("digest is null").join(several, F.col("doc_id") == F.col("id"), "left")
    rows_of = table.where("digest is not null").select("doc_id", "n", "digest").union(
        bare.select("doc_id", "n", F.col("high").alias("digest"))
    )
    return rows_of.join(grouped, F.col("digest") == F.col("d"), "left").select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
