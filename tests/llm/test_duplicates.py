"""Near duplicates, linked vectors and repeated strings against brute force."""

import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quillon.llm import embedding_duplicates, repeats
from quillon.llm.common import components, split_by_keys, without_keys
from quillon.llm.embedding_duplicates import linked_vectors
from quillon.llm.near_duplicates import near_duplicates, odd_sketches
from quillon.llm.repeats import cut_repeats, without_repeats
from quillon.llm.shingles import shingle_sets


def roots(ids, links):
    up = {k: k for k in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {k: find(k) for k in ids}


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[1] is not None and x[0] != x[1]]
    want = roots({k for x in real for k in x}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_filter(spark):
    docs = spark.createDataFrame([(k if k % 5 else None, k) for k in range(200)], "doc_id long, _p long")
    ids = spark.range(0, 200, 3).withColumnRenamed("id", "doc_id")
    near, far = split_by_keys(docs, ids)
    assert near.count() + far.count() == 200 and far.join(ids, "doc_id").count() == 0
    left = {r["_p"] for r in without_keys(docs, ids).collect()}
    assert left == {k for k in range(200) if k % 5 == 0 or k % 3}


def shingles(text, width):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", own)
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, min(len(words), 1)))}


def test_marks_of_words():
    one, other = "a", "b"
    for _ in range(10):  # a word and its complement, which agree in any polynomial modulo a power of two
        one, other = one + other, other + one
    texts = [f"{one} tail {other} tail", f"{one} tail", f"{other} tail", "a\0 b", "a b", "a\0\0 b", "\x1c \x85 b", "É é", ""]
    rnd = random.Random(4)
    texts += [" ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 70))) for _ in range(300)) for _ in range(40)]
    for width in (1, 2, 3):
        got = shingle_sets(texts, width)
        assert [len(s) for s in got] == [len(shingles(t, width)) for t in texts]
        assert len(set(np.concatenate(got).tolist())) == len(set().union(*(shingles(t, width) for t in texts)))
        assert [s.tolist() for s in got] == [shingle_sets([t], width)[0].tolist() for t in texts]
    assert shingle_sets([], 2) == []


def test_no_pair_at_the_threshold_is_told_apart():
    rng = np.random.default_rng(2)
    for size in (9, 45, 450, 4500):  # pairs at exactly 0.8
        for _ in range(200 if size < 1000 else 20):
            marks = rng.integers(0, 1 << 63, size * 10 // 9, np.uint64) * np.uint64(2)
            x, y = np.sort(marks[:size]), np.sort(np.r_[marks[: size * 8 // 9], marks[size:]])
            a, b = odd_sketches([x, y], 2048)
            assert 180 * sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= 20 * (len(x) + len(y))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rnd = random.Random(width)
    vocabulary = ["w%d" % k for k in range(400)]
    texts = ["", None, " \n", "a", "A", "a", "a b", "A  b", "é É"]
    for _ in range(12):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(15, 150))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(own)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(20000)))
    rows = [(3 * k, t, "x") for k, t in enumerate(texts)]
    rows += rows[10:12]  # repeated rows
    sets = {k: shingles(t, width) for k, t, _ in rows}
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = roots(ids, links)
    got = near_duplicates(spark.createDataFrame([*rows, (None, "a b", "x")], "doc_id long, text string, bucket string"), width=width).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
            continue
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])


def test_pairs_at_the_threshold(spark):
    # 40 of 50 shingles in common, picked among 200,000 such pairs: their signatures agree least
    rows = []
    for seed in (129485, 115626, 69926, 66194, 135730, 21198, 103373, 122942):
        words = [f"{seed}.{k}" for k in range(50)]
        rows += [(2 * seed, " ".join(words[:45])), (2 * seed + 1, " ".join(words[:40] + words[45:]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id - r.doc_id % 2 for r in got)


def test_keys_with_two_texts(spark):
    rnd = random.Random(8)
    own = [[f"{k}.{rnd.randrange(10**6)}" for _ in range(60)] for k in range(40)]
    near = [" ".join([*w[:30], "x", *w[31:]]) for w in own]
    rows = []
    for k in range(0, 40, 2):  # one key has two texts, whose near copies have keys of their own
        rows += [(10 * k + 5, " ".join(own[k])), (10 * k + 5, " ".join(own[k + 1])), (10 * k + 5, ["", None][k % 4 // 2])]
        rows += [(10 * k + 6, near[k]), (10 * k + 3, near[k + 1]), (10 * k + 7, " ".join(own[k + 1]))]
    rnd.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == r.doc_id - r.doc_id % 10 + 3 and r.kept == (r.doc_id == r.component_id) for r in got)


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    assert without_repeats(empty).count() == 0 and cut_repeats(empty).count() == 0
    assert linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_linked_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(25):
        centre = rng.normal(size=64)
        rows += [(centre + rng.normal(size=64) * rng.choice([0, 0.1, 0.2, 0.26, 0.3]), c % 3) for _ in range(rng.integers(1, 20))]
    rows = [(k, [float(x) for x in np.asarray(v, np.float32)], int(g)) for k, (v, g) in enumerate(rows)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None] + [0.0] * 62, [1e30] * 64, [2.0] * 64, [1e-30] * 64, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, rows[0][1], rows[0][2] + 1)]
    rows.append(rows[0])
    clean = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for i, a in enumerate(clean):
        for b in clean[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / np.abs(v).max() for v in (a[1], b[1]))
                if x @ y >= 0.93 * np.sqrt((x @ x) * (y @ y)):
                    links.append((a[0], b[0]))
    want = roots({r[0] for r in rows}, [x for x in links if x[0] != x[1]])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = linked_vectors(table.selectExpr("*", "1 as node", "2 as v", "3 as h")).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.vec_id] and r.kept == (r.vec_id == want[r.vec_id]) for r in got)
    count = Counter(k for link in links for k in link)  # rows of one id count as many links as they are
    assert sum(count.values()) > 200 and all(r.n_links == count[r.vec_id] for r in got if r.vec_id != 0)
    assert all(r.n_links == 0 for r in got if r.vec_id in (1000, 1001, 1002, 1003, 1004, 2000, 2001))
    assert {r.vec_id: r.n_links for r in got}[1005] == 2


@pytest.mark.parametrize(("norm", "substring"), [(0.02, 16), (0.02, 21), (0.8, 16), (0.87, 16), (0.92, 16)])
def test_linked_vectors_with_a_common_mean(spark, norm, substring):
    rng = np.random.default_rng(11)

    def units(x):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    own = units(units(rng.normal(size=(400, 64))) * np.sqrt(1 - norm**2) + np.eye(64)[0] * norm)
    aside = rng.normal(size=own.shape)
    aside = units(aside - (aside * own).sum(axis=1, keepdims=True) * own)
    cosine = rng.uniform(0.92, 0.96, (400, 1))
    every = units(np.vstack([own, cosine * own + np.sqrt(1 - cosine**2) * aside]))
    want = (every @ every.T >= 0.93).sum(axis=1) - 1
    rows = [(k, v.tolist(), 1) for k, v in enumerate(every)]
    got = linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), substring=substring).collect()
    assert all(r.n_links <= want[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.998 * want.sum() > 0


def test_vectors_are_not_fitted_in_the_driver(spark, monkeypatch):
    driver, own = os.getpid(), embedding_duplicates.fitted

    def fitted(*args):
        assert os.getpid() != driver
        return own(*args)

    monkeypatch.setattr(embedding_duplicates, "fitted", fitted)
    rows = [(k, [1.0, k / 10, 0.5], 1) for k in range(40)]
    got = linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    every = np.array([r[1] for r in rows])
    every /= np.sqrt((every * every).sum(axis=1, keepdims=True))
    want = (every @ every.T >= 0.93).sum(axis=1) - 1
    assert [r.n_links for r in sorted(got)] == want.tolist()


def test_rows_of_one_id(spark):
    rows = [(1, [1.0, 0.1], 1), (1, [1.0, 0.2], 1), (2, [1.0, 0.15], 1), (3, [-1.0, 0.0], 1), (3, [-1.0, 0.1], 1)]
    got = linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)]


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_look_ups_in_slices(monkeypatch, most):
    monkeypatch.setattr(embedding_duplicates, "CANDIDATES", most)
    rng = np.random.default_rng(17)
    every = np.repeat(rng.normal(size=(20, 32)), 30, axis=0) + rng.normal(size=(600, 32)) * 0.1
    unit = every / np.sqrt((every * every).sum(axis=1, keepdims=True))
    *code, apart = embedding_duplicates.fitted(unit, 0.93, 256, 256, 5, 5, 16)
    linked = np.triu(unit @ unit.T >= 0.93, 1)
    for first, part in ((600, linked), (250, linked & (np.arange(600)[:, None] < 250) & (np.arange(600) >= 250))):
        links = embedding_duplicates._Links(every, np.arange(600), *np.ones((2, 600), np.int64), 0.93)
        embedding_duplicates._search(links, first, first == 600, 16, code, apart)
        assert links.more.tolist() == (part.sum(axis=0) + part.sum(axis=1)).tolist()
        want = roots(range(600), np.argwhere(part).tolist())
        assert links.found(np.arange(600)).tolist() == [want[k] for k in range(600)]


def test_wide_vectors_are_fitted_in_little_memory():
    every = np.random.default_rng(7).normal(size=(2500, 1200))
    every /= np.sqrt((every * every).sum(axis=1, keepdims=True))
    tracemalloc.start()
    try:
        assert embedding_duplicates.fitted(every, 0.93, 256, 256, 2, 5, 16)
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("chunk", "most_bits"), [(40, 256), (40, 0), (500, 256), (500, 0)])
def test_chunks_of_labels(spark, chunk, most_bits):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(30, 32))
    every = (centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 32)) * rng.choice([0, 0.1, 0.25], (600, 1))).astype(np.float32)
    # a large label, some of middle size, many small ones that hold vectors of each other
    labels = np.where(rng.random(600) < 0.5, 0, np.where(rng.random(600) < 0.5, rng.integers(1, 5, 600), rng.integers(5, 90, 600)))
    rows = [(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(every, labels, strict=True))]
    got = linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), chunk=chunk, most_bits=most_bits)
    unit = every.astype(float) / np.sqrt((every.astype(float) ** 2).sum(axis=1, keepdims=True))
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(600, dtype=bool)
    want = roots(range(600), np.argwhere(linked).tolist())
    got = sorted(got.collect())
    assert [r.n_links for r in got] == linked.sum(axis=1).tolist() and linked.sum() > 1000
    assert [r.component_id for r in got] == [want[k] for k in range(600)]


def cut_by_hand(rows):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if raw else 0
        out[key] = (len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]))
    return out


@pytest.mark.parametrize("most", [1, 20_000])
def test_repeats(spark, most, monkeypatch):
    monkeypatch.setattr(repeats.repeated_stretches, "__defaults__", (100, 24, most))
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abcde é\n") for _ in range(rnd.randint(30, 400))) for _ in range(12)]
    rows = []
    for k in range(150):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            part = rnd.choice(parts)
            begin = rnd.randrange(len(part))
            text += part[begin : begin + rnd.randint(1, 400)] + rnd.choice(["", "", "aaaaaaaaaa" * 30, "abab" * 60, "zz"])
        rows.append((3 * k + 1, text))
    rows += [(5000 + k, t) for k, t in enumerate(["", None, "a" * 99, "a" * 100, "a" * 101, "ab" * 5000])]
    want = cut_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    kept = {r.doc_id: r.text for r in cut_repeats(docs.selectExpr("text", "doc_id", "1 as _bits", "2 as stretches")).collect()}
    assert kept[5001] is None
    assert all(kept[k] == w[3].decode("utf-8", "ignore") for k, w in want.items() if k != 5001)


def test_repeats_in_long_texts_and_odd_keys(spark):
    rnd = random.Random(8)
    pool = "".join(rnd.choice("abcdefgh ") for _ in range(6000))

    def mixed(n):
        text = ""
        while len(text) < n:
            begin, size = rnd.randrange(len(pool)), rnd.randint(90, 700)
            cut = list(pool[begin : begin + size])
            cut[rnd.randrange(len(cut))] = rnd.choice("xyz")  # passages that agree but for a byte
            text += "".join(cut) + str(rnd.random())
        return text

    # over several slices, and at their edges
    edge = [pool[: 4096 + d] + str(d) + pool[4000 : 4300 + d] for d in (-101, -100, -99, -1, 0, 1)]
    rows = [(k, t) for k, t in enumerate([*edge, *(mixed(15_000) for _ in range(4))])]
    want = cut_by_hand(rows)
    # rows of one key stand at one place, those without a key at none
    again = "".join(rnd.choice("qrst") for _ in range(300))
    docs = spark.createDataFrame(
        [*rows, (70, again), (70, again), (71, again), (None, again), (None, pool)], "doc_id long, text string"
    )
    got = without_repeats(docs).collect()
    told = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, bytes(r.kept)) for r in got}
    assert len(got) == len(rows) + 5 and sum(r.doc_id == 70 for r in got) == 2
    assert all(told[k, w[0]] == w[1:] for k, w in want.items()) and sum(w[1] for w in want.values()) > 20_000
    assert told[70, 300] == (0, 0, again.encode()) and told[71, 300] == (300, 1, b"")
    assert told[None, 300] == (0, 0, again.encode()) and told[None, 6000] == (0, 0, pool.encode())
