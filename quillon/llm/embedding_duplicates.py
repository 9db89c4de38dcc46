"""Near-duplicate embeddings by iterative quantisation (operator 5).

Vectors are made unit, centred and projected on principal axes, and rotations are learned that make balanced
binary codes lose least (iterative quantisation), each from another random start, until ``bits`` bits are there.
The codes are cut into substrings, one multi-index table each: a vector looks up its own substring and those that
differ in one bit among the vectors of its label. Pairs found are kept when their whole codes differ in at most as many
bits as pairs at the threshold do, and are then ranked by the cosine of the original vectors in double precision.
Pairs of at least ``threshold`` are links; none below it is.

The rotations are fitted on a bounded sample (``sample`` vectors of least hash) in one task, so that the driver holds
no vectors; every vector is indexed and looks itself up. How far the codes of a pair at the threshold lie apart depends
on the vectors: where they share a mean, centring widens the angle. It is measured on the fitted codes, with pairs of
the sample close above the threshold and pairs made to lie at it; ``bits`` double up to ``most_bits`` until at most a
thousandth of them meets in no table, and the bound of the whole codes is six standard deviations above their mean
distance, and no less than ``LEAST_APART``. Where ``most_bits`` are not enough, all pairs of a label are ranked.

The vectors of a label are searched in one task, without a row for each look-up, candidate or link: a task gives each
of its vectors that has links their number and the least vector that it reaches there. A label of more than ``chunk``
vectors is cut into chunks, a task for each two of them and each one, so that tasks stay bounded and cells sparse; its
vectors are shuffled once for each chunk of the label. Small labels share tasks.
Equal vectors of one label are one node, found by map-side combine, and count as many links as they are.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or an id, link
with nothing; vectors of different lengths never link. Rows of one id are one vertex with all their links. Other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, lean, written

#: The bound of whole codes is this share of their bits at least: six deviations for vectors without a common mean.
LEAST_APART = 62 / 256

#: Of a chunk with its codes and tables, at most so many bytes and vectors; candidates looked at together; numbers of the
#: sample (10,000 vectors of up to 1,600 dimensions; of wider ones fewer, but ten times the 128 axes at least).
CHUNK_BYTES, CHUNK_ROWS, CANDIDATES, SAMPLE_NUMBERS, SAMPLE_LEAST = 84_000_000, 200_000, 1_500_000, 16_000_000, 1280

#: Tables have a place for each value of so many bits at most; longer substrings are held by these bits of them.
TABLE_BITS = 18


def rotations(low: np.ndarray, bits: int, rounds: int, seed: int) -> np.ndarray:
    """The signs of low @ turns are the code; low are vectors less their mean on the principal axes."""
    rng = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(rng.normal(size=(low.shape[1],) * 2))[0]
        for _ in range(rounds):
            codes = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(low.T @ codes)
            turn = u @ v
        parts.append(turn)
    return np.hstack(parts)[:, :bits]


def trial_pairs(unit: np.ndarray, threshold: float, seed: int, most: int = 4000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pairs (x, y) at the threshold: vectors turned towards another one, and into any direction; and pairs of the
    sample that lie up to 0.02 above it. They come in slices, with the number of their kind."""
    rng = np.random.default_rng(seed)
    step = _step(unit.shape[1], most)
    first, others = rng.integers(0, len(unit), most), rng.integers(0, len(unit), most)
    for begin in range(0, most, step):
        x = unit[first[begin : begin + step]]
        for kind, aim in enumerate((unit[others[begin : begin + step]], rng.normal(size=x.shape))):
            aim -= (aim * x).sum(axis=1, keepdims=True) * x
            aim /= np.maximum(np.sqrt((aim * aim).sum(axis=1, keepdims=True)), 1e-9)
            y = threshold * x + np.sqrt(1 - threshold**2) * aim
            yield x, y / np.sqrt((y * y).sum(axis=1, keepdims=True)), kind
    small, left, right = unit.astype(np.float32), [], []
    for begin in range(0, len(unit), 500):
        cosine = small[begin : begin + 500] @ small.T
        i, j = np.nonzero((cosine >= threshold) & (cosine < threshold + 0.02))
        own = i + begin < j
        left.append(i[own][:most] + begin)
        right.append(j[own][:most])
    left, right = np.concatenate(left), np.concatenate(right)
    some = rng.permutation(len(left))[:most]
    for begin in range(0, len(some), step):
        yield unit[left[some[begin : begin + step]]], unit[right[some[begin : begin + step]]], 2


def fitted(unit: np.ndarray, threshold: float, bits: int, most_bits: int, rounds: int, seed: int, substring: int):
    """(mean, axes, turns, most_apart) of the fewest bits that suffice, or nothing where most_bits don't."""
    mean, step = unit.mean(axis=0), _step(unit.shape[1], len(unit))
    slices = [unit[k : k + step] for k in range(0, len(unit), step)]
    values, axes = np.linalg.eigh(sum((x - mean).T @ (x - mean) for x in slices))
    axes = axes[:, np.argsort(values)[::-1][: min(unit.shape[1], 128)]]
    low = np.vstack([(x - mean) @ axes for x in slices])
    pairs = [((x - mean) @ axes, (y - mean) @ axes, kind) for x, y, kind in trial_pairs(unit, threshold, seed)]
    trials = [
        tuple(np.vstack([p[side] for p in pairs if p[2] == kind]) for side in (0, 1)) for kind in sorted({p[2] for p in pairs})
    ]
    del pairs
    while bits <= most_bits:
        turns = rotations(low, bits, rounds, seed)
        bounds, enough = [LEAST_APART * bits], True
        for x, y in trials:
            differ = np.vstack([(x[k : k + 500] @ turns >= 0) != (y[k : k + 500] @ turns >= 0) for k in range(0, len(x), 500)])
            apart = differ.sum(axis=1)
            bounds.append(max(apart.mean() + 6 * apart.std(), apart.max()))
            tables = differ[:, : bits // substring * substring].reshape(len(x), -1, substring)
            missed = (tables.sum(axis=2) > 1).all(axis=1).sum()
            enough = enough and missed <= 1 + len(x) // 1000
        if enough:
            return mean, axes, turns, int(np.ceil(max(bounds)))
        bits *= 2
    return None


def _step(width: int, most: int) -> int:
    """How many vectors are looked at together: some 10 MB in double precision, whatever their width."""
    return max(1, min(most, 1_280_000 // width))


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    # scaled first, so that squares neither overflow nor vanish
    out = rows.astype(float)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _filled(columns: list[pa.Array], width: int) -> np.ndarray:
    """Rows of list columns, padded with zeros, in the type of the lists."""
    out = np.zeros((sum(map(len, columns)), width), columns[0].type.value_type.to_pandas_dtype())
    begin = 0
    for column in columns:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        out[begin : begin + len(column)][np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        begin += len(column)
    return out


class _Links:
    """What the links of a task come to: for each vector how many links it has, and a root, least in the end."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, groups: np.ndarray, copies: np.ndarray, threshold: float):
        self.vectors, self.nodes, self.groups, self.copies, self.threshold = vectors, nodes, groups, copies, threshold
        self.more, self.root = np.zeros(len(vectors), np.int64), np.arange(len(vectors))

    def rank(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes the pairs, each given once, whose cosine in double precision reaches the threshold."""
        step = _step(self.vectors.shape[1], 20_000)
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            cosine = np.einsum("ij,ij->i", _units(self.vectors[x]), _units(self.vectors[y]))
            keep = (cosine >= self.threshold) & (self.groups[x] == self.groups[y]) & (self.nodes[x] != self.nodes[y])
            x, y = x[keep], y[keep]
            np.add.at(self.more, x, self.copies[y])
            np.add.at(self.more, y, self.copies[x])
            while len(x):
                u, v = self.found(x), self.found(y)
                self.root[x], self.root[y] = u, v
                apart = u != v
                x, y, u, v = x[apart], y[apart], u[apart], v[apart]
                np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))

    def found(self, x: np.ndarray) -> np.ndarray:
        at = self.root[x]
        while (self.root[at] != at).any():
            at = self.root[at]
        return at


def _codes(
    vectors: np.ndarray, substring: int, mean: np.ndarray, axes: np.ndarray, turns: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Codes as rows of 64 bits each, and the cells of the vectors, a column for each table."""
    bits, step = turns.shape[1], _step(vectors.shape[1], 2000)
    words = np.empty((bits // 64, len(vectors)), np.uint64)
    cells = np.empty((len(vectors), bits // substring), np.int32)
    held = min(substring, TABLE_BITS)
    for k in range(0, len(vectors), step):
        signs = (_units(vectors[k : k + step]) - mean) @ axes @ turns >= 0
        words[:, k : k + step] = np.packbits(signs, axis=1).view(np.uint64).T
        whole = signs[:, : bits // substring * substring].reshape(len(signs), -1, substring)[:, :, :held]
        cells[k : k + step] = whole @ (2.0 ** np.arange(held))
    return words, cells


def _search(links: _Links, first: int, same: bool, substring: int, code: tuple[np.ndarray, ...], most_apart: int) -> None:
    """Ranks pairs of the first vectors with the later ones (of all among themselves, if same) that meet in a table
    and whose whole codes differ in at most most_apart bits."""
    words, cells = _codes(links.vectors, substring, *code)
    held, tables, begin = min(substring, TABLE_BITS), cells.shape[1], 0 if same else first
    cells ^= (links.groups & ((1 << held) - 1)).astype(np.int32)[:, None]  # labels that share the task don't share cells
    order = np.empty((tables, len(cells) - begin), np.int32)
    places = np.zeros((tables, (1 << held) + 1), np.int32)
    for t in range(tables):
        order[t] = np.argsort(cells[begin:, t], kind="stable") + begin
        np.cumsum(np.bincount(cells[begin:, t], minlength=1 << held), out=places[t, 1:])
    order, masks, table = order.ravel(), np.array([0, *(1 << k for k in range(held))], np.int32), np.arange(tables)[:, None]
    parts = [(k, min(k + 256, first)) for k in range(0, first, 256)][::-1]
    while parts:
        low, high = parts.pop()
        asked = cells[low:high, :, None] ^ masks
        start = places[table, asked].astype(np.int64)
        size = places[table, asked + 1] - start
        if size.sum() > CANDIDATES and high - low > 1:
            parts += [((low + high) // 2, high), (low, (low + high) // 2)]
            continue
        start += table * (len(cells) - begin)
        a = np.repeat(np.arange(low, high), size.sum(axis=(1, 2)))
        start, size = start.ravel(), size.ravel()
        b = order[np.arange(len(a)) + np.repeat(start - np.cumsum(size) + size, size)].astype(np.int64)
        if same:
            a, b = a[b > a], b[b > a]
        apart = np.zeros(len(a), np.int32)
        for word in words:
            apart += np.bitwise_count(word[a] ^ word[b])
        near = apart <= most_apart
        pair = np.unique(a[near] * len(cells) + b[near])
        links.rank(pair // len(cells), pair % len(cells))


def _all_pairs(links: _Links, first: int, same: bool) -> None:
    """Ranks all pairs of the first vectors with the later ones (of all among themselves, if same)."""
    order, step = np.argsort(links.groups, kind="stable"), _step(links.vectors.shape[1], 2000)
    ends = [0, *(np.flatnonzero(np.diff(links.groups[order])) + 1), len(order)] if same else [0, len(order)]
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        left, right = (order[low:high],) * 2 if same else (np.arange(first), np.arange(first, high))
        for k in range(0, len(right) if high - low > 1 else 0, step):
            some = _units(links.vectors[right[k : k + step]])
            for m in range(0, min(len(left), k + step) if same else len(left), 500):
                a, b = np.nonzero(_units(links.vectors[left[m : m + 500]]) @ some.T >= links.threshold - 1e-9)
                once = (a + m < b + k) | (not same)
                links.rank(left[a[once] + m], right[b[once] + k])


def _dealt(nodes: DataFrame, chunk: int) -> DataFrame:
    """nodes for the tasks (task, i, j): i and j are two chunks of a label, or the same; c is the one of the node. Labels of
    an eighth of a chunk or less share tasks."""
    sizes = written(nodes.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    own = F.col("n") * 8 > chunk
    small = sizes.where(~own).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.broadcast(sizes.where(own).select("group", F.ceil(F.col("n") / chunk).alias("chunks")))  # 8 / chunk of the nodes
    c, d = F.col("c"), F.col("d")
    return (
        nodes.join(large, "group", "left")
        .withColumn("task", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("group"), F.lit(max(1, 2 * small // chunk)))).otherwise(F.col("group")))
        .withColumn("shared", F.col("chunks").isNull()).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("c", F.pmod(F.xxhash64("node"), "chunks")).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("shared", "task", F.least(c, d).alias("i"), F.greatest(c, d).alias("j"), "c", "node", "group", "copies", "v")
    )


def linked_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    bits: int = 256,
    most_bits: int = 4096,
    substring: int = 16,
    sample: int = 10_000,
    rounds: int = 30,
    seed: int = 5,
    chunk: int | None = None,
) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row of vectors."""
    v = F.col("v")
    kind = vectors.select(F.col(vector)).schema[0].dataType
    exact = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & F.col("l").isNotNull() & F.col("id").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    rows = (
        vectors.select(
            F.col(key).cast("long").alias("id"), F.col(label).alias("l"), F.col(vector).cast(f"array<{exact}>").alias("v")
        )
        .withColumn("use", F.coalesce(usable, F.lit(False)))
        .withColumn("h", F.when(F.col("use"), F.xxhash64("l", "v"))).withColumn("g", F.when(F.col("use"), F.xxhash64(F.lit(7), "v", "l")))
    )
    same = rows.where("use").select("id", "h", "g", F.xxhash64("l", F.size("v")).alias("group"), "v").groupBy("h", "g")
    nodes = written(
        same.agg(
            F.min("id").alias("node"), F.count("*").alias("copies"), F.min("group").alias("group"), F.min_by("v", "id").alias("v"),
            F.min(F.size("v")).alias("size"),
        ),
        "nodes",
    )
    width, count = nodes.agg(F.max("size"), F.count("*")).first()
    zero = F.lit(0).cast("long")
    if width is None:
        return rows.select(F.col("id").alias(key), zero.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    substring, sample = min(substring, 48), min(sample, max(SAMPLE_LEAST, SAMPLE_NUMBERS // width))
    hashed = nodes.select("node", F.xxhash64("node").alias("hash"), "v")
    if count > 4 * sample:  # twice as many as are wanted, not all, go to the task that takes them
        hashed = hashed.where(F.col("hash") < int(2 * sample / count * 2**64) - 2**63)
    picked = hashed.orderBy("hash", "node").limit(sample).select("v")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _filled([x.column(0) for x in batches], width)
        unit, step = np.empty(rows.shape), _step(width, len(rows))
        for k in range(0, len(rows), step):
            unit[k : k + step] = _units(rows[k : k + step])
        del rows
        row = fitted(unit, threshold, bits, most_bits, rounds, seed, substring) or [None] * 4
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([x if x is None else x.tobytes()], pa.binary()) for x in row[:3]), pa.array([row[3]], pa.int32())],
            ["mean", "axes", "turns", "most_apart"],
        )

    found = picked.mapInArrow(lean(fit), "mean binary, axes binary, turns binary, most_apart int").collect()[0]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        i, j, c, node, group, copies = (
            np.concatenate([x.column(n).to_numpy(zero_copy_only=False) for x in parts]) for n in ("i", "j", "c", "node", "group", "copies")
        )
        filled = _filled([x.column("v") for x in parts], width)
        del parts
        both, first = i[0] == j[0], int((c == i).sum())
        if not both:  # those of chunk i first
            turn = np.argsort(c != i, kind="stable")
            node, group, copies, filled = node[turn], group[turn], copies[turn], filled[turn]
        links = _Links(filled, node, group, copies, threshold)
        if found["mean"] is None:
            _all_pairs(links, first, both)
        else:
            mean, axes, turns = (np.frombuffer(found[n]) for n in ("mean", "axes", "turns"))
            axes = axes.reshape(width, -1)
            _search(links, first, both, substring, (mean, axes, turns.reshape(axes.shape[1], -1)), found["most_apart"])
        root = links.found(np.arange(len(node)))
        least = node.copy()
        np.minimum.at(least, root, node)
        some = links.more > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links.more, least[root])], ["node", "more", "root"])

    wide = len(found["turns"] or b"") // 8 // min(width, 128)  # bits of the codes
    each = width * (4 if exact == "float" else 8) + wide // 8 + 8 * (wide // substring)
    chunk = chunk or max(1, min(CHUNK_ROWS, CHUNK_BYTES // each))
    dealt = _dealt(nodes, chunk)
    links = written(dealt.groupBy("shared", "task", "i", "j").applyInArrow(lean(linked), "node long, more long, root long"), "links")
    counts = links.groupBy("node").agg(F.sum("more").alias("more"))
    known = (
        nodes.select("node", "h", "g", "copies").join(counts, "node", "left")
        .join(components(links, "node", "root").toDF("node", "root"), "node", "left")
        .select("h", "g", (F.coalesce("more", zero) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root"))
    )
    return rows.select("id", F.coalesce("h", F.xxhash64("id")).alias("h"), "g").join(known, ["h", "g"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n", zero).alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(True)).alias("kept"),
    )
