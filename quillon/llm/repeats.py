"""Removal of repeated byte strings by column-wise suffix ordering of many passages (operator 10).

A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a document of a smaller key,
or before it in the same one. Strings never cross documents and are judged on the input.

1. Every string lies in the passage of its anchor (see passages), and equal strings lie in passages of one mark,
   at the same place from the anchor. Marks are counted over all texts; passages whose mark occurs once hold
   nothing repeated. Those of repeated marks pass a bit filter of a fixed size, and are counted exactly after it.
2. Equal passages (of one 128-bit digest of their bytes and anchor) are one, with its earliest place; all its other
   places go whole.
3. Different passages of one mark are put in order together, aligned at their anchors, by inserting one symbol of
   each passage a round, from the last column to the first. The order of the suffixes that begin at a column is
   the order of the round before, read once from front to back and dealt out stably by the symbols inserted (the
   step from a Burrows-Wheeler transform to its extension); the column up to which two neighbours agree is the
   least over the neighbours they were dealt out of. Passages that agree over ``length`` columns hold equal
   strings there, and all but the earliest go. Only suffixes of one column can begin equal strings, so that a
   round holds one suffix for each passage rather than all those inserted before.
   The sequential files of a round are the arrays of a bucket: buckets hold a bounded number of passages. A mark
   with more different passages than ``most`` is not gathered: its passages are cut by the place of the anchor in
   their strings, into stretches of ``STEPS`` strings, which share all but so many bytes; these are the mark of what
   is cut, so that few passages still have one mark, and both steps above run again on them.
4. The stretches of each document are merged and cut from its text.

Null, empty and short texts lose nothing. Rows of one key stand at one place: they don't take strings from each
other, and a stretch found in one is cut from each as far as it reaches. Rows without a key lose nothing and take
nothing. Other columns are not read; an empty table gives no rows. Nothing is kept outside Spark's own
shuffle and the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, scratch, split_by_keys, written
from .passages import Passages, passages
from .piece_codec import in_portions

FILTER_BITS = 1 << 26
#: Strings of a cut passage, first and then of what still is too many; cuts of one string with one mark are equal.
STEPS = (10, 1)
AT_A_TIME = 400_000
#: Bytes of a text that meet their passages at once.
SLICE = 4096


def _portions(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[pa.RecordBatch, list, Passages]]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for begin, end in in_portions(texts, AT_A_TIME):
            raw = [t.encode() for t in texts[begin:end]]
            yield batch.slice(begin, end - begin), raw, passages(raw, length, gram)


def _repeated_marks(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """A bit filter of the marks that occur twice or more."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own in _portions(batches, length, gram):
            mark, count = np.unique(own.mark, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[mark, mark[count > 1]].view(np.int64))], ["mark"])

    place = F.pmod("mark", F.lit(FILTER_BITS))
    cells = (
        texts.mapInArrow(lean(marks), "mark long").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
        .select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    ).toArrow()  # a cell for each 64 bits of the filter at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    if cells.num_rows:
        bits[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return bits


def _occurrences(texts: DataFrame, bits: np.ndarray, length: int, gram: int) -> DataFrame:
    """(mark, c, d, doc_id, at, n, off) of each passage that the filter lets pass: it starts at byte ``at``, holds
    ``n`` strings, its anchor is ``off`` bytes on, and c and d are the digest of what it holds."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, raw, own in _portions(batches, length, gram):
            place = (own.mark.view(np.int64) % FILTER_BITS).astype(np.uint64)
            own = own[(known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            at, n, off = own.first - own.bounds[own.text], own.last - own.first + 1, own.anchor - own.first
            ends = at + n + length - 1
            digests = _digests(
                (raw[t][a:b], o) for t, a, b, o in zip(*(x.tolist() for x in (own.text, at, ends, off)), strict=True)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own.mark.view(np.int64)), *digests, batch.column(0).take(pa.array(own.text)),
                    *(pa.array(x.astype(np.int32)) for x in (at, n, off)),
                ],
                ["mark", "c", "d", "doc_id", "at", "n", "off"],
            )

    return texts.mapInArrow(lean(run), "mark long, c long, d long, doc_id long, at int, n int, off int")


def _digests(passages: Iterable[tuple[bytes, int]]) -> tuple[pa.Array, pa.Array]:
    """Both halves of a digest of the bytes of each passage and the place of its anchor."""
    hashed = b"".join([hashlib.blake2b(raw, digest_size=16, salt=off.to_bytes(4, "little")).digest() for raw, off in passages])
    halves = np.frombuffer(hashed, np.int64).reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def repeated_starts(
    cells: list[bytes], n: np.ndarray, off: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of passages in the order of their places: (passage, first start, last start), stretches of strings that an
    earlier passage holds, too. Column 0 is that of the anchors."""
    m = len(cells)
    sizes = np.array([len(c) for c in cells], np.int64)
    left, right = int(off.max()), int((sizes - off).max())
    columns = np.full((left + right, m), 255, np.uint8)  # a byte that no text holds: no symbol
    flat = np.frombuffer(b"".join(cells), np.uint8)
    inner = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes[:-1])], sizes)
    columns[inner + np.repeat(left - off, sizes), np.repeat(np.arange(m), sizes)] = flat
    begin, stop = left - off, left - off + n  # columns at which a passage's strings start
    order = np.arange(m)
    agree = np.full(m, left + right, np.int16)  # column up to which a row agrees with the row before
    agree[:1] = 0
    again = np.zeros((left + right, m), bool)
    for column in range(left + right - 1, -1, -1):
        symbols = columns[column][order]
        dealt = np.argsort(symbols, kind="stable")
        # least agreement on the way from one dealt row to the next, by spans of powers of two
        a, b = dealt[:-1] + 1, dealt[1:]
        same = symbols[dealt[1:]] == symbols[dealt[:-1]]
        a, b = a[same], b[same]
        levels, spans = [agree], 1
        longest = int((b - a).max()) + 1 if len(a) else 1
        while spans * 2 <= longest:
            prior = levels[-1]
            after = prior.copy()
            np.minimum(prior[:-spans], prior[spans:], out=after[:-spans])
            levels.append(after)
            spans *= 2
        table = np.stack(levels)
        level = (np.frexp((b - a + 1).astype(np.float64))[1] - 1).astype(np.int64)
        new = np.full(m, column, np.int16)
        new[1:][same] = np.minimum(table[level, a], table[level, b - (1 << level) + 1])
        order, agree = order[dealt], new
        if column < left + 1 or column < int(stop.max()):
            valid = (begin[order] <= column) & (column < stop[order])
            if valid.any():
                group = np.cumsum(agree < column + length)[valid]
                rows = order[valid]
                head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                least = np.repeat(np.minimum.reduceat(rows, head), np.diff(np.r_[head, len(rows)]))
                again[column, rows[rows != least]] = True
    by_row = np.zeros((m, left + right + 2), bool)
    by_row[:, 1:-1] = again.T
    turn = by_row[:, 1:] != by_row[:, :-1]
    row, at = np.nonzero(turn)
    row, a, b = row[::2], at[::2], at[1::2] - 1
    return row, a - (left - off)[row], b - (left - off)[row]


def _split(found: DataFrame, length: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Of passages (mark, c, d, doc_id, at, n, off and more columns): the earliest of equal ones, with ``different``,
    how many of these their mark has; and (doc_id, a, b), the bytes of all others."""
    columns = ["doc_id", "at", "n", "off", *more]
    distinct = written(
        found.groupBy("mark", "c", "d").agg(F.min(F.struct(*columns)).alias("e")).select("mark", "c", "d", "e.*"), "distinct"
    )
    first = distinct.select("mark", "c", "d", F.col("doc_id").alias("doc"), F.col("at").alias("place"))
    later = (
        found.join(first, ["mark", "c", "d"]).where("doc_id <> doc or at <> place")
        .select("doc_id", F.col("at").alias("a"), (F.col("at") + F.col("n") + length - 1).alias("b"))
    )
    counts = distinct.groupBy("mark").agg(F.count("*").alias("different")).where("different > 1")
    return distinct.drop("c", "d").join(counts, "mark"), later


def _with_cells(several: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Passages with their bytes; only texts that hold any are shuffled, in slices of bounded size, each with what
    a passage that starts in it reaches beyond it."""
    size = F.octet_length("raw")
    parts = (
        split_by_keys(texts, several.select("doc_id"))[0].select("doc_id", F.col("text").cast("binary").alias("raw"))
        .select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.floor(size / SLICE).cast("int"))).alias("slice"))
        .select("doc_id", "slice", F.substring("raw", F.col("slice") * SLICE + 1, F.lit(SLICE + 2 * length)).alias("raw"))
    )
    cells = F.substring("raw", F.col("at") % SLICE + 1, F.col("n") + length - 1)
    asked = several.withColumn("slice", F.floor(F.col("at") / SLICE).cast("int"))
    return written(
        asked.join(parts, ["doc_id", "slice"])
        .select("mark", "different", "doc_id", "at", "n", "off", cells.alias("cells"))
        # of rows with one key another text may have come
        .where(F.octet_length("cells") == F.col("n") + length - 1),
        "passages",
    )


def _finer(passages: DataFrame, length: int, step: int) -> DataFrame:
    """Passages cut where the place of the anchor in their strings passes a multiple of ``step``. All strings of a
    cut share ``length - step + 1`` bytes around the anchor, which are its mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, n, off, cells in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for k in range((off - n + 1) // step, off // step + 1):
                    a, b = max(off - k * step - step + 1, 0), min(off - k * step, n - 1)
                    shared = cells[off - k * step : off - k * step + length - step + 1]
                    mark = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=k.to_bytes(4, "little")).digest(), "little", signed=True)
                    rows.append((mark, doc, at + a, b - a + 1, off - a, cells[a : b + length]))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                mark, doc, at, n, off, cells = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
                digests = _digests((r[5], r[4]) for r in rows)
                yield pa.RecordBatch.from_arrays(
                    [mark, *digests, doc, at, n, off, cells], ["mark", "c", "d", "doc_id", "at", "n", "off", "cells"]
                )

    schema = "mark long, c long, d long, doc_id long, at int, n int, off int, cells binary"
    return written(passages.select("doc_id", "at", "n", "off", "cells").mapInArrow(lean(run), schema), "finer")


def _ordered(passages: DataFrame, length: int, total: int) -> DataFrame:
    """(doc_id, a, b): bytes that go from passages of one mark, by their order."""

    def ordered(rows: pa.Table) -> pa.Table:
        rows = rows.append_column("anchor", pa.array(rows.column("at").to_numpy() + rows.column("off").to_numpy()))
        rows = rows.sort_by([("doc_id", "ascending"), ("anchor", "ascending")]).combine_chunks()
        at, n, off = (rows.column(c).to_numpy() for c in ("at", "n", "off"))
        row, a, b = repeated_starts(rows.column("cells").to_pylist(), n.astype(np.int64), off.astype(np.int64), length)
        return pa.table({
            "doc_id": rows.column("doc_id").take(pa.array(row)),
            "a": pa.array((at[row] + a).astype(np.int32)),
            "b": pa.array((at[row] + b + length).astype(np.int32)),
        })

    buckets = max(1, -(-total // 20_000))
    return (
        passages.withColumn("bucket", F.pmod(F.xxhash64("mark"), F.lit(buckets)))
        .groupBy("bucket").applyInArrow(ordered, "doc_id long, a int, b int")
    )


def _merged(every: DataFrame) -> DataFrame:
    """(doc_id, stretches) of rows (doc_id, a, b): stretches that overlap or touch are one before a document's are
    gathered, so that the array holds what is cut, not a passage each."""
    ordered = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = every.withColumn("apart", F.coalesce(F.col("a") > reach, F.lit(True)).cast("long"))
    runs = runs.withColumn("run", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy("doc_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return one.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("stretches"))


def repeated_stretches(docs: DataFrame, key: str, text: str, length: int = 100, gram: int = 24, most: int = 20_000) -> DataFrame:
    """(doc_id, stretches): arrays of (a, b), bytes a to b - 1 go; no two of a document overlap or touch."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(
        "doc_id is not null and text is not null"
    )
    found = written(_occurrences(texts, _repeated_marks(texts, length, gram), length, gram), "occurrences")
    several, every = _split(found, length)
    passages = _with_cells(written(several, "several"), texts, length)
    for step in (*STEPS, None):
        few, many = (passages.where(f"different {sign} {most}") for sign in ("<=", ">"))
        more = step and not many.isEmpty()
        every = every.union(_ordered(few if more else passages, length, passages.count()))
        if not more:
            break
        several, later = _split(_finer(many, length, step), length, "cells")
        passages, every = written(several, "passages"), every.union(later)
    return _merged(every)


def _cut(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(row, bytes, removed, spans, kept binary, rest string): the row of docs and what is left of its text; rest
    is without the bytes of characters that were cut in two, and null where the text is.

    Only texts that lose something are shuffled, to meet their stretches, and go through Python."""
    with scratch() as kept:
        cuts = kept(written(repeated_stretches(docs, key, text, length), "stretches"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    near, far = split_by_keys(rows, cuts.select("doc_id"))
    kind = rows.schema["row"].dataType.simpleString()
    names = ["bytes", "removed", "spans", "kept", "rest", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, parts, done, removed, spans, reach = (t or "").encode(), [], 0, 0, 0, -1
                for a, b in sorted((min(x["a"], len(raw)), min(x["b"], len(raw))) for x in stretches or ()):
                    if b > max(a, done):
                        spans += a > reach  # stretches that touch are one
                        parts.append(raw[done:a])
                        removed += b - max(a, done)
                        done = b
                    reach = max(reach, b)
                kept = b"".join([*parts, raw[done:]])
                rest = None if t is None else kept.decode("utf-8", "ignore")
                for column, value in zip(out, (len(raw), removed, spans, kept, rest), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, batch.column(2)], names)

    own = F.col("row").getField(text).alias("body")
    cut = near.join(cuts, "doc_id", "left").select(own, "stretches", "row").mapInArrow(
        lean(run), f"bytes long, removed long, spans long, kept binary, rest string, row {kind}"
    )
    zero = F.lit(0).cast("long")
    raw = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary")
    whole = far.select(F.octet_length(raw).cast("long").alias("bytes"), zero, zero, raw, own, "row")
    return cut.union(whole)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary), a row for each row of docs."""
    out = _cut(docs.select(key, text), key, text, length).select(f"row.`{key}`", "bytes", "removed", "spans", "kept")
    return out.toDF(key, "n_bytes", "n_removed", "n_spans", "kept")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """docs with the text cut; a character that lost a byte goes, and a null text stays null."""
    return _cut(docs, key, text, length).select(F.col("row").withField(text, F.col("rest")).alias("row")).select("row.*")
