"""Whitening, prefix trie and chat formatting on small inputs with every odd case."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from claimgrid.llm import chat, prefix_trie, whitening
from claimgrid.llm.tables import ORACLES, ready
from compare import duck, norm


# ---- whitening

@pytest.mark.parametrize("kind", ["plain", "equal", "decoupled", "tiny", "one", "ranks"])
def test_leading_components(kind):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    values = {"plain": np.arange(24, 0, -1.0) ** 2, "equal": np.array([9.0] * 4 + [9 - 1e-9] + [1.0] * 19), "decoupled": np.arange(24, 0, -1.0),
              "tiny": np.arange(24, 0, -1.0) * 1e-30, "one": np.array([5.0] + [0.0] * 23), "ranks": np.array([1e12, 1e6, 1.0, 1e-3] + [1e-9] * 20)}[kind]
    a = np.diag(values) if kind == "decoupled" else q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a, 4)
    want = np.sort(values)[::-1][:4]
    scale = np.max(np.abs(a))
    assert got == pytest.approx(want, rel=1e-9, abs=1e-13 * scale)
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12)
    assert np.max(np.abs(a @ vectors.T - vectors.T * got)) < 1e-12 * scale


@pytest.mark.parametrize("d", [1, 2, 3])
def test_small_matrices(d):
    a = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]])[:d, :d]
    got, vectors = whitening.leading(a, 4)
    assert got == pytest.approx(np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors @ a @ vectors.T, np.diag(got))


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diagonal, beside = rng.normal(size=30), rng.normal(size=29)
    beside[[4, 17]] = 0
    eigen = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    at = np.linspace(-4, 4, 101)
    assert (whitening.sturm_count(diagonal, beside, at) == (eigen[None, :] < at[:, None]).sum(axis=1)).all()


def test_whitening(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * [3, 2, 1, 0.5, 0.3, 0.1]], 1, "r", 0.5) for i in range(400)]
    rows += rows[:50] * 4 + [(9, rows[3][1], 2, "r", 0.5), (None, rows[4][1], 2, "r", 0.5)]
    bad = [(1000, None, 1, "r", 0.5), (1001, [], 1, "r", 0.5), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "r", 0.5), (1003, [float("nan")] * 6, 1, "r", 0.5), (1004, [float("-inf")] * 6, 1, "r", 0.5), (1005, [1.0], 1, "r", 0.5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x int, row string, whitened double")
    ready(spark)
    out = whitening.components(df).collect()
    x = np.array([[math.floor(256 * c) for c in r[1]] for r in rows])
    different = np.unique(x, axis=0)
    n, sums = len(different), different.sum(axis=0)
    v = (different - sums / n).T @ (different - sums / n) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    assert len(out) == 4 * len(rows)
    white = {}
    for r in out:
        white.setdefault((r.vec_id, r.deviation), {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v))
    for (i, *_), y in zip(rows, x):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(y, sums))
        got = white[i, deviation]
        want = (y - sums / n) @ vectors[:4].T / np.sqrt(values[:4])
        assert [abs(got[c].whitened) for c in range(1, 5)] == pytest.approx(np.abs(want), abs=1e-8)
    done, _ = whitening.whiten(df)
    assert done.select("row.*").columns == df.columns


def test_whitening_of_little(spark):
    layout = "vec_id long, embedding array<double>"
    assert whitening.components(spark.createDataFrame([], layout)).count() == 0
    assert whitening.components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], layout)).count() == 0
    two = whitening.components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], layout)).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whitening.components(spark.createDataFrame([(i, [1e300 * (i % 3), -1e17 * i, 1.0 * i]) for i in range(9)], layout)).collect()
    assert {r.deviation for r in huge} == {None} and all(math.isfinite(r.whitened) for r in huge)


# ---- prefix trie

def brute_nodes(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, name, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    out = []
    for node, held in members.items():
        below = [m for m in members if m[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in held if whole[c] == node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), sum(len(m) == len(node) + 1 for m in below),
                    sum(not any(len(k) == len(m) + 1 and k[:len(m)] == m for k in below) for m in below),
                    sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 305, -7, -200, -150, 10**15]:
        n = rng.choice([1, 2, 3, 5, 9, 17])
        for k in range(n):
            rows.append((c, k, ("system", "user", "assistant")[k and 1 + k % 2], rng.choice(["a", "bb", "é日", "", "ok"]) if k < 6 or rng.random() < .3 else "same"))
    rows += [(c, k, "user", f"hot {k}") for c in range(400, 430) for k in range(12)] + [(c, k, "user", "copy") for c in range(500, 520) for k in range(7)]
    rows += [(700, None, None, None), (700, None, "user", "x"), (700, 1, "user", None), (700, 1, "user", None), (700, -3, "", "y"), (None, 0, "user", "nobody")]
    rng.shuffle(rows)
    return rows


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, depth int")


@pytest.mark.parametrize("shard,pack", [(1 << 18, 1 << 18), (20, 50), (3, 1)])
def test_trie_nodes(spark, monkeypatch, shard, pack):
    """Also with shards so small that most nodes are merged from several."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PACK", pack)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 4)
    rows = talk(shard)
    got = [tuple(r) for r in prefix_trie.trie(chats(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_nodes(rows), key=repr)


def test_trie_sql(spark, tmp_path):
    chats(spark, talk(1)).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duck("/root/testdata/sf0.001")
    con.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["op12_conversation_prefix_trie"]).fetchall()
    got = [tuple(r) for r in prefix_trie.op12(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trie_of_little(spark):
    assert prefix_trie.trie(chats(spark, [])).count() == 0
    assert prefix_trie.trie(chats(spark, [(None, 1, "a", "b")])).count() == 0
    rows = [(3, None, "user", "gone")]  # three of its turns stand in a conversation that is not there
    assert zlib.crc32(b"3") % 6 > 0
    assert [tuple(r) for r in prefix_trie.trie(chats(spark, rows)).collect()] == brute_nodes(rows)


def test_double_array():
    rng = np.random.default_rng(8)
    sequences = {tuple(rng.integers(0, k, rng.integers(0, 8)).tolist()) for k in (2, 5, 300) for _ in range(400)}
    sequences |= {(7, k) for k in range(300)}  # a node with many children
    held = [(r, s) for r in range(3) for s in sorted(sequences) if (len(s) + r) % 2]
    first = np.append(0, np.cumsum([len(s) for _, s in held]))
    labels = np.array([x for _, s in held for x in s])
    made, dense = prefix_trie.DoubleArray.pack(3, np.array([r for r, _ in held]), first, labels, 300)
    places = {}
    for root, s in held:
        slot = np.array([root])
        for k, x in enumerate(s):
            slot = made.step(slot, dense[[x]])
            assert slot[0] >= 3 and places.setdefault(int(slot[0]), (root, s[:k + 1])) == (root, s[:k + 1])
    assert len(places) == made.used.sum() - 3 < len(made.used)
    known = set(places.values())
    for root in range(3):
        for x in np.flatnonzero(dense >= 0):
            assert (made.step(np.array([root]), dense[[x]])[0] >= 0) == ((root, (int(x),)) in known)


# ---- chat formatting

ODD = ["", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<s", "[", "[[INST]]", "<<s>>", "\\<s>", "é日本😀\r\n\t", " lead and trail ", "<|endoftext|>", "\0", "x" * 50_000 + " </s> " + " " * 50_000 + "y", "\n" * 30_000]


@pytest.mark.parametrize("text", ODD)
def test_escape(text):
    made = chat.escaped(text)
    assert chat.unescaped(made) == text and not any(m in made for m in chat.MARKS)
    assert chat.escaped(made) != made or made == text


def test_chat(spark):
    rng = random.Random(1)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "", "[INST]", None, "a\nb"]), rng.choice([*ODD, None])) for c in range(40) for k in range(rng.randrange(1, 6))]
    rows += [(None, 0, "assistant", "nobody"), (50, None, "assistant", "b"), (50, 3, "assistant", "c"), (50, 3, "assistant", "c"), (50, -1, "user", "a"), (60, 0, "user", "")]
    df = chats(spark, rows)
    formatted = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    held = {}
    for c, k, role, text in rows:
        held.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert set(got) == set(held)
    vocabulary = chat.Vocabulary.open(chat.VOCABULARY)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in formatted.collect():
        turns = [(role, text) for *_, role, text in sorted(held[r.conv_id])]
        learnt = "".join(t for role, t in turns if role == "assistant")
        whole = "<s>" + "".join(f"[INST]{chat.escaped(role)}[/INST]{chat.escaped(t)}</s>" for role, t in turns)
        back, text = chat.turns_of(np.array(r.input_ids), np.array(r.loss_mask), vocabulary)
        assert text == whole and [t[:2] for t in back] == turns and len(r.loss_mask) == len(r.input_ids)
        assert [t[2] for t in back] == [role == "assistant" for role, _ in turns]
        assert sum(i >= vocabulary.first for i in r.input_ids) == 1 + 3 * len(turns)  # no text became a mark
        assert tuple(got[r.conv_id])[1:] == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), sha(learnt), len(whole))
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_chat_probe(spark, tmp_path):
    chats(spark, talk(2)).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duck("/root/testdata/sf0.001")
    con.execute(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op13(spark, str(tmp_path))
    cur = con.execute(ORACLES["op13_chat_formatting"])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
    probe = got.filter("conv_id = -1").first()
    assert (probe.n_turns, probe.loss_chars, probe.loss_sha256) == (2, 21, hashlib.sha256(chat.PROBE.encode()).hexdigest())
