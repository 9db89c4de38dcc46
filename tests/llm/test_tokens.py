"""The piece codec and packing against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm.packing import WordTokenizer, best_cuts, pack_documents
from quillon.llm.piece_codec import PieceCodec, encode_documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
POOL = ["the", "▁", " ", "  ", "\n", "!!!", "==", "ing", "Éé", "日本", "🤗", " ", " ", "​", "    ", "aaaa", "1234", "\t", "ß", "́",
        "<s>", "<0x0A>", "\r\n", "abab", "_____", "\x00", "", "'s", "'re", "<|endoftext|>", "İ", "Σ", "...", "?", "\x85", "ª", "µ", "don't", "a_b9"]


def texts(n, seed):
    rnd = random.Random(seed)
    fixed = ["", " ", "\n", "  a  b ", "a" * 40 + " " + "b" * 33, " " * 300 + "x" + " " * 33]
    return fixed + ["".join(rnd.choice(POOL) for _ in range(rnd.randint(1, 50))) for _ in range(n)]


def test_codec_is_the_library():
    own, model = PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in texts(2000, 1):
        ids = model.encode(t)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == model.decode(ids), t


def test_codec_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(k, t, k) for k, t in enumerate([*texts(300, 2), None, "word " * 30_000])]
    rows.append(rows[7])
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids long"), PIECES).collect()
    assert len(got) == len(rows)
    known = {k: t or "" for k, t, _ in rows}
    for r in got:
        ids = model.encode(known[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(WORDS)
    own.encode_special_tokens = True
    return own


def test_words_are_the_library(library):
    own = WordTokenizer(WORDS)
    rnd = random.Random(3)
    letters = "aaabbcdeeefghiiijlmnnooprrssttuuvxyzéèüß"
    made = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) for _ in range(8)) for _ in range(2000)]
    made += [rnd.choice("abcelmnorstx") * rnd.randint(2, 40) + rnd.choice(["", "b", "ed"]) for _ in range(500)]
    for t in texts(2000, 4) + made:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing(spark, library):
    rnd = random.Random(5)
    rows = [(k, t) for k, t in enumerate([*texts(400, 6), None, "word " * 9000, "nobreak" * 4000])]
    rows += [(1000 + k, " ".join(rnd.choice(["The", "of", "a", "cat."]) for _ in range(rnd.randint(1, 900)))) for k in range(100)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {k for k, _ in rows}
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.06 * total  # few sentence ends here; 0.8 % on prose
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_packing_repeated_rows_and_other_columns(spark):
    rows = [(1, "a b", 3, 4)] * 2
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, start int, length int").coalesce(1), WORDS)
    assert sum(r.length for r in got.collect()) == 6


def test_cuts_cost_as_little_as_any():
    """Against every choice of cuts, without a queue: at places that documents, sentences and stretches offer."""
    rnd = np.random.default_rng(12)
    for _ in range(300):
        window, total = int(rnd.integers(4, 12)), int(rnd.integers(13, 60))
        doc_ends = np.union1d(rnd.integers(1, total, rnd.integers(1, 8)), [total])
        sentence_ends = np.unique(rnd.integers(1, total + 1, rnd.integers(0, 10)))
        cuts = best_cuts(doc_ends, sentence_ends, total, window, 4, 16, 1)

        def price(at, doc_ends=doc_ends, sentence_ends=sentence_ends):
            return 0 if at in doc_ends else 4 if at in sentence_ends else 16

        least = {0: 0}
        for at in range(1, total + 1):  # a stretch of 1 offers every place
            least[at] = min(least[k] + window - (at - k) + price(at) for k in range(max(0, at - window), at))
        own = sum(window - (b - a) + price(b) for a, b in zip([0, *cuts], cuts))
        assert all(0 < b - a <= window for a, b in zip([0, *cuts], cuts)) and total - window < cuts[-1] <= total
        assert own == least[cuts[-1]]
        assert own + cuts[-1] == min(least[k] + k for k in range(total - window + 1, total + 1))
