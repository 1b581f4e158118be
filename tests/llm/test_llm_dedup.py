"""Substring, suffix and n-gram dedup against brute force on texts that have every odd case."""

import hashlib
import random

import numpy as np
import pytest

from claimgrid.llm import components, ngram_join, substring, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, `row` string, h1 string, score double, found string, _id string, bucket string"


def texts(seed: int, copies: int = 30) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "be", "ça", "dog", "é", "fox", "go", "hi", "ink", "joy", "KEY", "low"])
    line = lambda n: " ".join(word() for _ in range(n))
    hot, base = line(14), [word() for _ in range(60)]
    out = [line(rng.randrange(0, 60)) for _ in range(30)]
    out += [f"{line(rng.randrange(3, 9))}\t{hot}\n{line(rng.randrange(3, 9))}" for _ in range(copies)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append("  ".join(w))
    out += [out[3]] * 4 + ["", " \n ", "x", "x y", "X  y", "ab" * 300, "aaaa " * 120, "日本語 " * 40, None, None]
    rng.shuffle(out)
    rows = [(i, t) for i, t in enumerate(out)]
    rows += [rows[5], (7, "another text under the same name, long enough to be seen twice by all of them"), (None, out[6]), (None, "nameless")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "k", "n", "r", "h", 0.5, "f", "i", "b") for i, t in rows], SCHEMA)


def order(i):
    return (1 << 63) - 1 if i is None else i


def test_substring(spark):
    rows, n = texts(1), 6
    lowest = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            g = tuple(w[k: k + n])
            lowest[g] = min(order(i), lowest.get(g, 1 << 63))
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        drop = {j for k in range(len(w) - n + 1) if lowest[tuple(w[k: k + n])] < order(i) for j in range(k, k + n)}
        want.append((i, len(w), len(drop), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in drop)).hexdigest()))
    got = [tuple(r) for r in substring.dedup(frame(spark, rows), n).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_longest_repeats(spark):
    found = substring.longest_repeats(frame(spark, texts(1)), 6).groupBy("length").count().collect()
    assert {r.length for r in found} >= {6, 12}


def test_every_level_of_repeats(spark):
    """A passage in exactly two documents, one in three and one that ends in a document without id, level by level."""
    rng = random.Random(12)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    two, three, last = line(100), line(45), line(30)
    rows = [(1, f"{line(5)} {two}"), (2, f"{two} {line(7)}"), (3, f"{three} {last}"), (4, f"x {three}"), (5, f"{three} y"), (None, f"{last} z"), (6, line(60))]
    want = {}
    for length in (6, 12, 24, 48, 96):
        lowest = {}
        grams = [(order(i), tuple(t.split()[k: k + length])) for i, t in rows for k in range(len(t.split()) - length + 1)]
        for i, g in grams:
            lowest[g] = min(i, lowest.get(g, i))
        for i, g in grams:
            if lowest[g] < i:
                at = (None if i == order(None) else i, length)
                want[at] = want.get(at, 0) + 1
    got = {(r.doc_id, r.length): r.n_windows for r in substring.longest_repeats(frame(spark, rows), 6).collect()}
    assert got == want and (2, 96) in got and (5, 24) in got and (None, 24) in got


@pytest.mark.parametrize("crowd", [256, 3])
def test_suffix(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "SUFFIXES", 64 if crowd == 3 else 400_000)
    rows, n = texts(2), 24
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            seen[b[k: k + n]] = seen.get(b[k: k + n], 0) + 1
    want = []
    for i, t in rows:
        b = (t or "").encode()
        drop = {j for k in range(len(b) - n + 1) if seen[b[k: k + n]] > 1 for j in range(k, k + n)}
        runs = sum(j - 1 not in drop for j in drop)
        want.append((i, len(b), len(drop), runs, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in drop)).hexdigest()))
    got = [tuple(r) for r in suffix.dedup(frame(spark, rows), n).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_texts_that_polynomial_hashes_confuse(spark):
    """A letter up or down in Thue-Morse order leaves every polynomial modulo 2**64 with an odd base as it is."""
    rng = random.Random(20)
    one = [rng.randrange(98, 120) for _ in range(2048)]
    two = [c + (1 if bin(k).count("1") % 2 else -1) for k, c in enumerate(one)]
    whole = lambda b: suffix.flat.stretch_hash(suffix.prefix_sums(b), np.array([0]), np.array([2048]), suffix.flat.BYTE_BASE)
    assert whole(np.array(one, np.uint8)) == whole(np.array(two, np.uint8))
    rows = [(1, bytes(one).decode()), (2, bytes(two).decode())]
    for n, removed in ((400, [0, 0]), (2048, [0, 0])):
        got = suffix.dedup(frame(spark, rows), n).orderBy("doc_id").collect()
        assert [r.n_removed for r in got] == removed
    assert [r.n_removed for r in suffix.dedup(frame(spark, [*rows, (3, rows[0][1])]), 400).orderBy("doc_id").collect()] == [2048, 0, 2048]


def test_suffix_texts(spark):
    rows = [(1, "é" * 40 + "tail one"), (2, "é" * 40 + "rest"), (3, "alone and whole")]
    got = {r.doc_id: r.text for r in suffix.deduped(frame(spark, rows), 21).collect()}
    assert got == {1: "tail one", 2: "rest", 3: "alone and whole"}


def brute_join(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[j: j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    part = list(range(len(rows)))

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                part[top(x)] = top(y)
    best = {}
    for x, (i, _) in enumerate(rows):
        best[top(x)] = min(order(i), best.get(top(x), 1 << 63))
    return [(i, len(sets[x]), None if best[top(x)] == order(None) else best[top(x)]) for x, (i, _) in enumerate(rows)], [top(x) for x in range(len(rows))]


@pytest.mark.parametrize("block", [400, 6])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 5 if block < 100 else 2048)
    rows = texts(3, 60)
    want, _ = brute_join(rows, 3, 90)
    got = [tuple(r) for r in ngram_join.join(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_of_each_group(spark):
    rows = texts(4)
    _, parts = brute_join(rows, 3, 90)
    docs = frame(spark, rows)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    worded = {p for p, (_, t) in zip(parts, rows) if (t or "").split()}
    bare = {(i, t) for i, t in rows if not (t or "").split()}
    assert kept.count() == len(worded) + len(bare)


def test_empty_tables(spark):
    none = frame(spark, texts(1)).limit(0)
    for run in (substring.dedup, suffix.dedup, suffix.deduped, ngram_join.join, ngram_join.representatives):
        assert run(none).count() == 0


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(9)
    links = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (2000, 2001)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: x for x in {y for a, b in links if a != b for y in (a, b)}}
    for _ in links:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
