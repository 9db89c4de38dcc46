"""Encoding and decoding with a BPE piece model (operator 3).

A text becomes flat numpy arrays of symbols, one stretch for each segment (a run of space marks and what follows
up to the next one, cut at line ends, which no piece contains). In each round every segment finds its best pair
by a segmented minimum of pair ranks, all segments merge their leftmost occurrences at once, the arrays are
compacted, and segments without a pair leave, until none is left. Where a merge could make a better pair than
the one just merged (or an equal one), only the leftmost occurrence of a segment merges in a round, so that the
order is exactly the sequential one. Segments never share a piece, so that each different segment is merged once
and its ids are kept in a bounded table of the worker.

Null and empty texts have no ids and decode to the empty text. Every row is encoded on its own: repeated rows,
ties of the key and further columns have no influence; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MARK = "▁"
CUT = "\ue000"
NONE = np.iinfo(np.int32).max
#: Segments a worker keeps, and characters of text that it takes at a time.
KEPT, AT_A_TIME = 400_000, 400_000
#: Bytes of text whose new segments are merged together.
MERGED = 2_000_000


class PieceCodec:
    """Tables of a piece model: symbols, pairs that merge, ranks, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        plain: dict[str, int] = {}
        spelled: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                spelled.append(bytes([int(name[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                spelled.append(b"")
            else:
                plain[name] = i
                spelled.append(name.replace(MARK, " ").encode())
        self.spelled = spelled
        score = {p: model.get_score(i) for p, i in plain.items()}
        # symbols: the pieces under their ids, then characters that occur in pieces only, then code points
        symbol = dict(plain)
        for c in sorted({c for p in plain for c in p} - plain.keys()):
            symbol[c] = size + len(symbol) - len(plain)
        self.first_unknown = size + len(symbol) - len(plain)
        self.n_pieces = size
        self.char_of = {s: c for c, s in symbol.items() if s >= size}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, ranks, made = [], [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * self.first_unknown + right)
                    ranks.append(order[score[p]])
                    made.append(i)
        by = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x)[by] for x in (keys, ranks, made))
        self.ranks = self.ranks.astype(np.int32)
        rank_of = np.full(self.first_unknown, -1, np.int64)
        rank_of[self.made] = self.ranks
        self.one_by_one = np.zeros(self.first_unknown, bool)
        for side in (self.keys // self.first_unknown, self.keys % self.first_unknown):
            self.one_by_one[side[rank_of[side] >= self.ranks]] = True
        self.symbol = symbol
        inside = {c for p in plain if len(p) > 1 for c in p}
        assert "\n" not in inside and CUT not in inside
        assert not any(MARK in p.lstrip(MARK) for p in plain), "a piece holds a space mark after another symbol"
        points = np.arange(0x110000)
        self.of_point = points + self.first_unknown
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_point[ord(c)] = s

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the table of pairs, -1 where two symbols don't merge."""
        known = (left < self.first_unknown) & (right < self.first_unknown)
        wanted = np.where(known, left * self.first_unknown + right, -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def merge(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment, by vectorised merge rounds."""
        lengths = np.array([len(s) for s in segments])
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym = self.of_point[points]
        own = np.repeat(np.arange(len(segments)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(pair: np.ndarray) -> np.ndarray:
            return np.where(pair >= 0, self.ranks[pair], NONE)

        pair = np.full(len(sym), -1)
        if len(sym):
            pair[:-1] = np.where(own[1:] == own[:-1], self._pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = ranked(pair)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            stay = np.repeat(best < NONE, sizes)
            if not stay.all():
                done.append((own[~stay], sym[~stay]))
                best, sizes = best[best < NONE], sizes[best < NONE]
                sym, own, pair, rank = sym[stay], own[stay], pair[stay], rank[stay]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            run = np.r_[True, hits[1:] != hits[:-1] + 1]
            since = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
            made = self.made[pair[hits]]
            first = np.r_[True, own[hits[1:]] != own[hits[:-1]]]
            single = self.one_by_one[made]
            # a segment with any such pair takes its leftmost hit alone
            group = np.cumsum(first) - 1
            careful = np.zeros(group[-1] + 1, bool)
            careful[group[single]] = True
            take = np.where(careful[group], first, since % 2 == 0)
            hits, made = hits[take], made[take]
            sym[hits] = made
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            stale = np.zeros(len(sym), bool)
            stale[hits] = True
            before = hits - 1
            # the symbol before may itself be what was merged away: then the one before that
            before = np.where((before >= 0) & ~keep[before], before - 1, before)
            stale[before[before >= 0]] = True
            sym, own, pair, stale = sym[keep], own[keep], pair[keep], stale[keep]
            look = np.flatnonzero(stale)
            after = np.minimum(look + 1, len(sym) - 1)
            joined = (look + 1 < len(sym)) & (own[after] == own[look])
            pair[look] = np.where(joined, self._pairs(sym[look], sym[after]), -1)
        if not done:
            return [[] for _ in segments]
        own, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(own, kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=len(segments))).tolist()
        final = sym[by].tolist()
        out = [final[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in np.unique(own[sym >= self.n_pieces]).tolist():
            out[k] = self._ids(out[k])
        return out

    def _ids(self, symbols: list[int]) -> list[int]:
        """Ids of final symbols: a character that is no piece becomes the ids of its bytes."""
        out: list[int] = []
        for s in symbols:
            if s < self.n_pieces:
                out.append(s)
            else:
                c = self.char_of[s] if s < self.first_unknown else chr(s - self.first_unknown)
                out += self.byte_ids[list(c.encode())].tolist()
        return out

    def decode(self, ids: list[int], begins: bool = True) -> str:
        """The text of ids: spelled pieces joined, the space that encoding put first left out."""
        text = b"".join([self.spelled[i] for i in ids])
        return (text[1:] if begins and text[:1] == b" " else text).decode("utf-8", "replace")

    @staticmethod
    def segments(text: str) -> list[str]:
        """The segments of a non-empty text; joined they are the text behind a space mark."""
        marked = MARK + text.replace(" ", MARK)
        if MARK + MARK in marked or CUT in marked:
            return re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", marked)
        return marked.replace(MARK, CUT + MARK).replace("\n", f"{CUT}\n{CUT}").split(CUT)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for ids in self.merge([s for s in self.segments(text) if s]) for i in ids]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def in_portions(texts: list[str], most: int = AT_A_TIME) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``most`` characters together, one text at least."""
    begin = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have some ``most`` bytes: rounds over few symbols cost as many calls."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode_documents(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, if asked for, ids and decoded, a row for each row."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        listed: dict[str, str] = {"": ""}
        spelled: dict[str, str] = {"": ""}
        for batch in joined(batches, MERGED):
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for begin, end in in_portions(texts, MERGED):
                parts = [own.segments(t) if t else [] for t in texts[begin:end]]
                new = [s for s in set().union(*parts) if s not in listed]
                if len(listed) + len(new) > KEPT:
                    listed, spelled = {"": ""}, {"": ""}
                    new = [s for s in set().union(*parts) if s]
                for s, ids in zip(new, own.merge(new), strict=True):
                    listed[s] = ",".join(map(str, ids)) + ","
                    spelled[s] = own.decode(ids, begins=False)
                for segs in parts:
                    ids = "".join([listed[s] for s in segs])[:-1]
                    decoded = "".join([spelled[s] for s in segs])[1:]
                    out[0].append(ids.count(",") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out[3].append([int(i) for i in ids.split(",")] if ids else [])
                        out[4].append(decoded)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            if with_ids:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [keys, *columns], [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns) + 1]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {kind}, {schema}")
