"""Packing of token sequences (operator 9).

Each document becomes its token ids and an end id. The stream of documents, in the order of the input, is cut
into windows of at most ``window`` ids. Dynamic programming picks the cuts: a window costs the ids that it lacks
(padding), a cut costs nothing at the end of a document, ``sentence_cost`` at the end of a sentence and
``inner_cost`` elsewhere; cuts elsewhere are offered where a window from such a place would be full and within
stretches of over ``stretch`` ids without a better place. The cost of the best cuts up to a place is a minimum over the places within a window before it,
which a monotone queue gives in constant time on average. The ids behind the last cut wait for more documents;
what is left at the end of a partition is cut into windows whose lengths are powers of two, which need no
padding.

Sequence ids hold the partition and a count within it, so that no shuffle and no order among partitions is
needed and a task that runs again gives the same rows. Null and empty texts are documents of the end id alone.
Repeated rows are packed one by one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .piece_codec import in_portions

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Chunks of text a worker keeps the ids of, and ids that are cut at a time.
KEPT, AT_A_TIME = 350_000, 1 << 19


class WordTokenizer(dict):
    """Ids of chunks without white space (as little-endian bytes) by a word BPE vocabulary; those seen are kept.

    A chunk is normalised and split into words by the vocabulary file's own rules. A word is merged by a byte-pair
    core whose ranks are the places of the merges; a byte that no text holds stands for the end of a word and
    joins the last letter before anything else. A chunk with characters beyond ``PLAIN`` goes through the
    tokenizer itself.
    """

    #: Letters whose normal form is themselves, and the marks between them.
    PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    MARKS = frozenset(".,;:!?")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|[0-9]|(?:[^\\w]|_)+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocabulary = self.model.get_vocab()
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        letters = _byte_letters()

        def spelled(name: str) -> bytes:
            bare = name.removesuffix("</w>")
            return bytes(letters[c] for c in bare) + (b"\xff" if bare != name else b"")

        ranks = {bytes([b, 255]): b for b in range(255)}
        for k, pair in enumerate(merges):
            ranks.setdefault(spelled("".join(pair.split(" ") if isinstance(pair, str) else pair)), 256 + k)
        single = 256 + len(merges)
        ranks |= {bytes([b]): single + b for b in range(256)}
        self.spelled = [bytes(4)] * (single + 256)
        for name, i in vocabulary.items():
            if not name.startswith("<|") and (k := ranks.get(spelled(name))) is not None:
                self.spelled[k] = i.to_bytes(4, "little")
        self.core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.words: dict[str, bytes] = {}
        self[""] = b""
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for name, i in vocabulary.items():
            bare = name.removesuffix("</w>")
            self.ends[i] = bare != name and bare != "" and set(bare) <= set(".!?")

    def __missing__(self, chunk: str) -> bytes:
        word, mark = (chunk, "") if chunk[-1] not in self.MARKS else (chunk[:-1], chunk[-1])
        if word.isalpha() and word.isascii():  # one word and at most one mark, as the patterns would say
            word = word.lower()
            ids = self.words.get(word) or self._word(word)
            if mark:
                ids += self.words.get(mark) or self._word(mark)
        elif self.PLAIN.fullmatch(chunk) and "<|" not in chunk:
            parts = self.PARTS.findall(chunk.lower())
            ids = b"".join([self.words.get(w) or self._word(w) for w in parts])
        else:
            ids = np.array(self.model.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = b"".join([self.spelled[k] for k in self.core.encode_single_piece(word.encode() + b"\xff")])
        self.words[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.words.clear()
        self[""] = b""

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > KEPT:
            self.forget()
        return [b"".join([self[c] for c in t.replace("\n", " ").split(" ")]) for t in texts]


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_cuts(
    doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, window: int, sentence_cost: int, inner_cost: int,
    stretch: int,
) -> list[int]:
    """Cuts in (0, total] of least cost, the last within a window of total. Places count ids before the cut."""
    places = np.union1d(np.union1d(doc_ends, sentence_ends), [0, total])
    # where a window that begins at such a place would be full
    full = places + window
    places = np.union1d(places, full[full < total])
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > stretch)
    if len(wide):
        inner = [np.arange(places[k] + stretch, places[k + 1], stretch) for k in wide]
        places = np.union1d(places, np.concatenate(inner))
    costs = np.full(len(places), inner_cost, np.int64)
    costs[np.isin(places, sentence_ends)] = sentence_cost
    costs[np.isin(places, doc_ends)] = 0
    where, price = places.tolist(), costs.tolist()
    # least[k]: cost of the best cuts up to place k; a window from i to k costs window - (k - i)
    least, back = [0] * len(where), [0] * len(where)
    queue: deque[int] = deque([0])
    for k in range(1, len(where)):
        here = where[k]
        while where[queue[0]] < here - window:
            queue.popleft()
        best = queue[0]
        least[k] = least[best] + window - (here - where[best]) + price[k]
        back[k] = best
        value = least[k] + here
        while queue and least[queue[-1]] + where[queue[-1]] >= value:
            queue.pop()
        queue.append(k)
    # the ids behind the last cut are carried on, so that the last window is chosen as if they were whole
    k = min(
        (j for j in range(len(where) - 1, 0, -1) if where[j] > total - window), key=lambda j: (least[j] + where[j], -j)
    )
    cuts = []
    while k:
        cuts.append(where[k])
        k = back[k]
    return cuts[::-1]


class Packer:
    """The pending stream of one partition."""

    def __init__(self, base: int, ends: np.ndarray, window: int, sentence_cost: int, inner_cost: int, stretch: int):
        self.next, self.ends = base, ends
        self.how = (window, sentence_cost, inner_cost, stretch)
        self.window = window
        self.docs: list[tuple[object, int, int, bytes]] = []
        self.total = 0

    def add(self, key: object, ids: bytes) -> None:
        self.docs.append((key, len(ids) // 4, 0, ids))
        self.total += len(ids) // 4

    def cut(self, last: bool = False) -> list[tuple]:
        """The pieces of the windows that are settled; all of them at the end."""
        rows: list[tuple] = []
        if self.total > self.window or (last and self.total):
            raw = b"".join([d[3] for d in self.docs])
            doc_ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
            cuts = []
            if self.total > self.window:
                sentence_ends = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
                cuts = best_cuts(doc_ends, sentence_ends, self.total, *self.how)
            if last:
                done = cuts[-1] if cuts else 0
                while done < self.total:
                    done += min(self.window, 1 << (self.total - done).bit_length() - 1)
                    cuts.append(done)
            rows = self._pieces(raw, doc_ends, cuts)
        return rows

    def _pieces(self, raw: bytes, doc_ends: np.ndarray, cuts: list[int]) -> list[tuple]:
        settled = cuts[-1]
        bounds = np.union1d(np.r_[0, doc_ends[doc_ends <= settled]], cuts)
        begins = bounds[:-1]
        doc = np.searchsorted(doc_ends, begins, side="right")
        window = np.searchsorted(cuts, begins, side="right")
        window_start = np.r_[0, cuts][window]
        doc_start = np.r_[0, doc_ends][doc]
        rows = []
        for a, b, d, w, ws, ds in zip(*(x.tolist() for x in (begins, bounds[1:], doc, window, window_start, doc_start)), strict=True):
            key, tokens, before, _ = self.docs[d]
            rows.append((key, before + a - ds, b - a, zlib.crc32(raw[4 * a : 4 * b]), tokens, self.next + w, a - ws))
        self.next += len(cuts)
        first = int(np.searchsorted(doc_ends, settled, side="right"))
        rest = self.docs[first:]
        if rest:
            begin = settled - (int(doc_ends[first - 1]) if first else 0)
            key, tokens, before, own = rest[0]
            rest[0] = (key, tokens, before + begin, own[4 * begin :])
        self.docs, self.total = rest, self.total - settled
        return rows


def pack_documents(
    docs: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    end_id: int = 1,
    sentence_cost: int = 4,
    inner_cost: int = 16,
    stretch: int = 256,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(model)
        packer = Packer(TaskContext.get().partitionId() << 36, own.ends, window, sentence_cost, inner_cost, stretch)
        kind, last = None, np.uint32(end_id).astype("<u4").tobytes()

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(
                    arrays, [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                )

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in in_portions(texts):
                for k, ids in zip(keys[begin:end], own.encode(texts[begin:end]), strict=True):
                    packer.add(k, ids + last)
                if packer.total >= AT_A_TIME:
                    yield from out(packer.cut())
        yield from out(packer.cut(last=True))
        own.forget()  # a task meets most of its chunks anew, and the worker lives on through other stages

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"`{key}` {kind}, {SCHEMA}")
