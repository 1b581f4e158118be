"""LM scoring with Elias-Fano n-gram tries.

All two-grams counted ``LEAST`` times or more are kept, and all three-grams so counted whose two two-grams are kept,
whatever the size of the input. N-grams are dealt by their context into parts of bounded size; a context that holds a
large share of the tokens is dealt by its successors too. Each part is one level of a trie: pointers to the successors
of each context, the successors as a monotone sequence, and quantised probabilities, all in one memory map, searched
relative to the context.

Texts are held in blocks of a few MB. Each block sends its different two-grams to their parts with the number of times
they stand in training texts. A part sums these, builds its level, looks up what each block asked for, and answers in the
order of the questions: a bit for each two-gram and the probability of those that it holds. With the answers a block
knows which three-grams can be kept at all, and asks for these in the same way. So every n-gram is shuffled once, as a
question, and answers need no names. Contexts are named by 64 bits, the successors of one context by ``BITS`` bits.

Smoothing is interpolated absolute discounting: p(w | c) = (n(c w) - D) / n(c) + rest(c) * p(w | shorter c) for what the
tries hold and rest(c) * p(w | shorter c) otherwise, where rest(c) is what the kept successors leave. The shortest
context is the smoothed count p(w) = (n(w) + 0.5) / (N + 0.5 * (V + 1)), so every distribution sums to one but for
the 8-bit quantisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.elias_fano import Level, Trie
from claimgrid.llm.tables import LAST_ID, crc_part, plain_id, query, table, written

LEAST, DISCOUNT = 2, 0.6
START, END = np.uint64(0x5D588B656C078965), np.uint64(0x27BB2EE687B0B0FD)
#: Bytes of text in a block, bytes of text whose n-grams make a part, and the share (one in SHARE) of all tokens from
#: which a context is dealt by its successors: at most 2 * SHARE + 1 words and SHARE two-grams have it.
BLOCK, PART_BYTES, SHARE = 8 << 20, 24 << 20, 1024
SLICE = 512 << 10
BITS, LEVEL = 40, 3  # of the names of successors, and of the compression of texts
CELL, ANSWER = "part int, block long, cell binary", "block long, part int, cell binary, shares binary, name long, value double"
TAKEN, TYPES, OFTEN = -1, -2, -3  # in place of a block: what a part says to all of them


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, the first bytes of all numbers, then the second ones and so on, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    body = b"".join([head.tobytes(), *(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    body = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(body, np.int64, 1)[0])
    at, out = 8 + 16 * count, []
    for kind, n in np.frombuffer(body, np.int64, 2 * count, 8).reshape(-1, 2).tolist():
        kind = np.dtype(chr(kind))
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, with an end after its words, and the index of the first of each. Texts of about
    SLICE bytes are worked on together, as this takes many times their memory; a word has the same hash in any slice."""
    made, low = [], 0
    while low < len(off) - 1:
        high = max(low + 1, int(np.searchsorted(off, off[low] + SLICE, side="right")) - 1)
        made.append(_tokens(data[off[low]: off[high]], off[low: high + 1] - off[low]))
        low = high
    base = np.cumsum([0, *(len(h) for h, _ in made)])
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in made)]), np.concatenate([*(f[:-1] + b for (_, f), b in zip(made, base)), base[-1:]])


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = flat.lower_ascii(data)
    starts, ends, first = flat.words(data, off)
    n = np.diff(first)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    out = np.full(len(starts) + len(n), END, np.uint64)
    out[at] = flat.word_hashes(data, starts, ends)
    return out, first + np.arange(len(first))


def _key(words: np.ndarray) -> np.ndarray:
    """What tells a word from the other successors of a context."""
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _joined(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The name of a context with one more word."""
    return flat.mix(flat.mix(context) * np.uint64(flat.BASE) + successor.astype(np.uint64))


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    return ((flat.mix(names) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _is_in(names: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names are in an ascending list, and the place of each."""
    if not len(held):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(held, names), len(held) - 1)
    return held[at] == names, at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive texts of about BLOCK bytes, with their tokens counted, and the words and starts that a block's training
    texts hold in a quarter of the share of a hot context or more (at most 4 * SHARE words)."""
    held: list[tuple[np.ndarray, ...]] = []
    size, block = 0, TaskContext.get().partitionId() << 32

    def out() -> pa.RecordBatch:
        ids, learn, data = (np.concatenate([h[i] for h in held]) for i in range(3))
        lengths = np.concatenate([np.diff(h[3]) for h in held])
        hashes, first = tokens(data, np.append(0, np.cumsum(lengths)))
        train = np.repeat(learn, np.diff(first))
        names, n = np.unique(hashes[train], return_counts=True)
        names, n = np.append(names, START), np.append(n, learn.sum())
        often = n * 4 * SHARE >= train.sum()
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([len(data)]), pa.array([len(hashes)]), pa.array([int(train.sum())]), pa.array([pack(ids, learn, lengths)]), pa.array([pa.Codec("zstd", LEVEL).compress(data.tobytes(), asbytes=True)]),
             pa.array([names[often].view(np.int64)]), pa.array([n[often].astype(np.int64)])], ["block", "bytes", "tokens", "train", "rows", "texts", "often", "times"])

    for batch in batches:
        for rows, data, off in flat.slices(batch, limit=BLOCK // 2):
            if size and size + len(data) > BLOCK:
                yield out()
                held, size, block = [], 0, block + 1
            held.append((rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False), data, off))
            size += len(data)
    if held:
        yield out()


class Grams:
    """Words and two-grams of a block: ``ids`` of the tokens among the ascending ``words``, the token before each (the start
    before the first), and the number of each two-gram among the ascending ``pairs`` (before * number of words + token)."""

    def __init__(self, size: int, rows: bytes, texts: bytes):
        self.doc_ids, self.learn, lengths = unpack(rows)
        data = np.frombuffer(pa.decompress(texts, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
        hashes, self.first = tokens(data, np.append(0, np.cumsum(lengths)))
        self.words, at = np.unique(np.append(START, hashes), return_inverse=True)
        self.start, self.ids, self.width = at[0], at[1:], len(self.words)
        self.before = np.append(self.start, self.ids[:-1])
        self.before[self.first[:-1]] = self.start
        self.train = np.repeat(self.learn, np.diff(self.first))
        self.pairs, self.pair = np.unique(self.before * self.width + self.ids, return_inverse=True)

    def asked(self, hot: np.ndarray, parts: int) -> "Asked":
        n = np.bincount(self.ids, self.train, self.width).astype(np.int64)
        n[self.start] = self.learn.sum()
        times = np.bincount(self.pair, self.train, len(self.pairs)).astype(np.int32)
        return Asked(self.words, n, self.pairs // self.width, _key(self.words[self.pairs % self.width]), times, hot, parts)

    def above(self, kept: np.ndarray) -> None:
        """With the two-grams that are ``kept``: the kept one before each token (-1 if there is none), the ascending names
        of these contexts, and the three-grams that both of whose two-grams are kept."""
        above = np.append(-1, self.pair[:-1])
        above[self.first[:-1]] = -1
        self.has = (above >= 0) & kept[above]
        self.contexts = np.unique(above[self.has])
        pairs = self.pairs[self.contexts]
        names = _joined(self.words[pairs // self.width], _key(self.words[pairs % self.width]))
        order = np.argsort(names)
        self.contexts, self.names = self.contexts[order], names[order]
        place = np.full(len(self.pairs), -1, np.int64)
        place[self.contexts] = np.arange(len(order))
        self.context = np.where(self.has, place[above], -1)
        self.maybe = self.has & kept[self.pair]
        self.threes, self.three = np.unique(self.context[self.maybe] * self.width + self.ids[self.maybe], return_inverse=True)

    def asked_above(self, n: np.ndarray, hot: np.ndarray, parts: int) -> "Asked":
        times = np.bincount(self.three, self.train[self.maybe], len(self.threes)).astype(np.int32)
        return Asked(self.names, n[self.contexts], self.threes // self.width, _key(self.words[self.threes % self.width]), times, hot, parts)


class Asked:
    """Questions of a block: contexts (ascending names) and their successors (ascending within a context), dealt into the
    parts. A context goes to the part of its name and its successors with it; those of a hot context are spread."""

    def __init__(self, names: np.ndarray, n: np.ndarray, context: np.ndarray, successor: np.ndarray, times: np.ndarray, hot: np.ndarray, parts: int):
        self.names, self.n, self.successor, self.times = names, n, successor, times
        self.contexts = np.concatenate([np.arange(len(names)), context])
        self.hot = _is_in(names, hot)[0]
        home = _part(names, parts)
        part = np.concatenate([home, np.where(self.hot[context], _part(_joined(names[context], successor), parts), home[context])])
        self.order = np.argsort((part * len(names) + self.contexts) * 2 + (np.arange(len(part)) >= len(names)), kind="stable")
        part = part[self.order]
        self.cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
        self.parts = part[self.cuts[:-1]]

    def cells(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: its number, the contexts, whether each is at home there, how many successors each has, and these."""
        for k, part in enumerate(self.parts.tolist()):
            entry = self.order[self.cuts[k]: self.cuts[k + 1]]
            context, pair = self.contexts[entry], entry >= len(self.names)
            new = np.append(True, context[1:] != context[:-1])
            yield part, context[new], ~pair[new], np.bincount(np.cumsum(new) - 1, pair, new.sum()).astype(np.int32), entry[pair] - len(self.names)

    def batch(self, block: int, everywhere: bool) -> pa.RecordBatch:
        """``everywhere``: the number of a context is the same in all blocks, so every part may have it."""
        made = [pack(np.diff(self.names[c], prepend=np.uint64(0)), self.n[c] * (home | everywhere), k, np.diff(self.successor[s], prepend=0) & ((1 << BITS) - 1), self.times[s]) for _, c, home, k, s in self.cells()]
        return pa.RecordBatch.from_arrays([pa.array(self.parts.astype(np.int32)), pa.array(np.full(len(made), block)), pa.array(made, pa.binary())], ["part", "block", "cell"])

    def kept(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is kept, and its number. ``answers`` in the order of the parts, here and below."""
        kept, times = np.zeros(len(self.times), bool), np.zeros(len(self.times), np.int64)
        for (*_, s), data in zip(self.cells(), answers, strict=True):
            bits, number = unpack(data)
            hit = s[np.unpackbits(bits, count=len(s)).astype(bool)]
            kept[hit], times[hit] = True, number
        return kept, times

    def shares(self, kept: np.ndarray, answers: list[bytes]) -> tuple[np.ndarray, ...]:
        """log10 of the discounted share of each pair kept, and for each context log10 of the rest and the number."""
        share, rest, n = np.zeros(len(self.times)), np.zeros(len(self.names)), np.zeros(len(self.names), np.int64)
        for (_, c, home, _, s), data in zip(self.cells(), answers, strict=True):
            value, left, total = unpack(data)
            share[s[kept[s]]] = value
            rest[c[home]], n[c[home]] = left[home], total[home]
        return share, rest, n


def _answers(everywhere: bool, hot: np.ndarray, parts: int, often: float) -> Callable[[pa.Table], pa.Table]:
    """The work of one part: the level of what was counted LEAST times or more, and the answers to all blocks.
    ``everywhere`` as in the questions. In a hot context whose number no part knows the shares are counts."""

    def run(rows: pa.Table) -> pa.Table:
        own, blocks = rows["part"][0].as_py(), rows["block"].to_pylist()
        cells = [unpack(x) for x in rows["cell"].to_pylist()]
        names, n, k = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cells]), np.concatenate([c[1] for c in cells]), np.concatenate([c[2] for c in cells])
        successor = np.concatenate([np.cumsum(c[3]) & ((1 << BITS) - 1) for c in cells])
        times = np.concatenate([c[4] for c in cells])
        sizes = [(len(c[0]), len(c[3])) for c in cells]
        del cells, rows
        contexts, place = np.unique(names, return_inverse=True)
        total = np.bincount(place, n, len(contexts)).astype(np.int64)
        if everywhere:
            total[place] = n
        context = np.repeat(place, k)
        grams, gram = np.unique(context.astype(np.uint64) << np.uint64(BITS) | successor.astype(np.uint64), return_inverse=True)
        counted = np.bincount(gram, times, len(grams)).astype(np.int64)
        del gram, times, names, n, k
        keep = counted >= LEAST
        grams, counted = grams[keep], counted[keep]
        of, follower = (grams >> np.uint64(BITS)).astype(np.int64), (grams & np.uint64((1 << BITS) - 1)).astype(np.int64)
        is_hot = _is_in(contexts, hot)[0]
        taken = np.bincount(of, counted - DISCOUNT, len(contexts))
        left = np.log10(np.where(is_hot | (taken == 0), 1.0, (total - taken) / np.maximum(total, 1)))
        divisor = np.where(is_hot & (not everywhere), 1, total)
        level = Trie.load(Trie([Level.build(len(contexts), of, follower, np.log10((counted - DISCOUNT) / divisor[of]), left)]).dump()).levels[0]
        found = level.find(context, successor)
        rests = level.rests[level.rest[place]].astype(np.float16)
        made, shares, a, b = [], [], 0, 0
        for c, s in sizes:
            hit = found[b: b + s]
            held = hit[hit >= 0]
            made.append(pack(np.packbits(hit >= 0), counted[held] * (not everywhere)))
            shares.append(pack(level.probs[level.prob[held]].astype(np.float16), rests[a: a + c], total[place[a: a + c]] * (not everywhere)))
            a, b = a + c, b + s
        said = [(TAKEN, contexts[i], taken[i]) for i in np.flatnonzero(is_hot & (taken > 0)).tolist()]
        if not everywhere:
            said.append((TYPES, np.uint64(0), float(((total > 0) & (contexts != START) & (_part(contexts, parts) == own)).sum())))
            large = np.flatnonzero(counted >= often)
            said += zip([OFTEN] * len(large), _joined(contexts[of[large]], follower[large]), counted[large].tolist())
        return pa.table([
            pa.array([*blocks, *(x[0] for x in said)], pa.int64()), pa.array([own] * (len(blocks) + len(said)), pa.int32()), *(pa.array([*x, *[None] * len(said)], pa.binary()) for x in (made, shares)),
            pa.array([*[None] * len(blocks), *(int(x[1].view(np.int64)) for x in said)], pa.int64()), pa.array([*[None] * len(blocks), *(float(x[2]) for x in said)], pa.float64())], ["block", "part", "cell", "shares", "name", "value"])

    return run


def _ask(hot: np.ndarray, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, rows, texts in zip(*(batch.column(c) for c in ("block", "bytes", "rows", "texts"))):
                yield Grams(size.as_py(), rows.as_py(), texts.as_py()).asked(hot, parts).batch(block.as_py(), False)

    return run


def _grams(blocks: pa.Table) -> Grams:
    return Grams(*(blocks[c][0].as_py() for c in ("bytes", "rows", "texts")))


def _told(answers: pa.Table, level: int, column: str = "cell") -> list[bytes]:
    mine = sorted((p, c) for p, c, x in zip(*(answers[c].to_pylist() for c in ("part", column, "level"))) if x == level)
    return [c for _, c in mine]


def _ask_above(hot: np.ndarray, hot_above: np.ndarray, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _grams(blocks)
        kept, times = grams.asked(hot, parts).kept(_told(answers, 2))
        grams.above(kept)
        return pa.Table.from_batches([grams.asked_above(times, hot_above, parts).batch(blocks["block"][0].as_py(), True)])

    return run


def _left(names: np.ndarray, n: np.ndarray, rest: np.ndarray, taken: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rest of each context, those of hot contexts from what all parts took of them."""
    found, at = _is_in(names, taken[0])
    out = 10.0 ** rest
    out[found] = 1 - taken[1][at[found]] / n[found]
    return out


def _score(hot: np.ndarray, hot_above: np.ndarray, taken: tuple[np.ndarray, np.ndarray], taken_above: tuple[np.ndarray, np.ndarray], parts: int, slots: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        g = _grams(blocks)
        asked = g.asked(hot, parts)
        kept, times = asked.kept(_told(answers, 2))
        share, rest, n = asked.shares(kept, _told(answers, 2, "shares"))
        rest = _left(g.words, n, rest, taken)
        context = g.pairs // g.width
        share = np.where(kept, 10.0 ** share / np.where(asked.hot[context], np.maximum(n[context], 1), 1), 0.0)
        plain = (n[g.ids] + 0.5) / slots
        p = share[g.pair] + rest[g.before] * plain
        g.above(kept)
        of = times[g.contexts]
        asked = g.asked_above(times, hot_above, parts)
        held, _ = asked.kept(_told(answers, 3))
        share, rest, _ = asked.shares(held, _told(answers, 3, "shares"))
        rest = _left(g.names, of, rest, taken_above)
        p[g.has] *= rest[g.context[g.has]]
        p[np.flatnonzero(g.maybe)] += np.where(held, 10.0 ** share, 0.0)[g.three]
        at = g.first[:-1]  # every text has a token
        sums = lambda v: np.add.reduceat(v, at) if len(at) else v
        return pa.table([pa.array(g.doc_ids), pa.array(np.diff(g.first)), pa.array(sums((n[g.ids] > 0).astype(np.int64))), pa.array(sums(np.log10(plain))), pa.array(sums(np.log10(p)))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _ascending(rows: list) -> tuple[np.ndarray, np.ndarray]:
    names = np.array([r.name for r in rows], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r.value for r in rows], float)[order]


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs; learns from rows with ``learn``.

    A null text is empty and has one token, its end. Repeated rows are each scored, and each learnt from. Without
    training rows N and V are 0 and every token has the same probability of one; without rows there is no result. A text
    of over BLOCK bytes is a block of its own, so it must fit into a task. Other columns are not looked at."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    blocks = written(texts.mapInArrow(_blocks, "block long, bytes long, tokens long, train long, rows binary, texts binary, often array<long>, times array<long>"), "lm-blocks")
    size = blocks.agg(F.sum("bytes").alias("bytes"), F.sum("train").alias("train")).first()
    total, parts = int(size.train or 0), 1 + int(size.bytes or 0) // PART_BYTES
    often = blocks.select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy(F.col("x.often").alias("name")).agg(F.sum("x.times").alias("value"))
    hot = _ascending(often.filter(F.col("value") * (2 * SHARE) >= total).collect())[0]  # at most 2 * SHARE words and the start
    whole = blocks.select("block", "bytes", "rows", "texts")

    two = written(whole.mapInArrow(_ask(hot, parts), CELL).groupBy("part").applyInArrow(_answers(False, hot, parts, max(LEAST, total / SHARE)), ANSWER), "lm-two")
    types = int(two.filter(F.col("block") == TYPES).agg(F.sum("value")).first()[0] or 0)
    hot_above = _ascending(two.filter(F.col("block") == OFTEN).collect())[0]  # at most SHARE two-grams
    of = lambda df: _ascending(df.filter(F.col("block") == TAKEN).groupBy("name").agg(F.sum("value").alias("value")).collect())  # noqa: E731  hot contexts only
    told = lambda df, level: df.filter("block >= 0").select("block", "part", "cell", "shares", F.lit(level).alias("level"))
    asked = whole.groupBy("block").cogroup(told(two, 2).drop("shares").groupBy("block")).applyInArrow(_ask_above(hot, hot_above, parts), CELL)
    three = written(asked.groupBy("part").applyInArrow(_answers(True, hot_above, parts, 0.0), ANSWER), "lm-three")

    scored = whole.groupBy("block").cogroup(told(two, 2).unionByName(told(three, 3)).groupBy("block")).applyInArrow(
        _score(hot, hot_above, of(two), of(three), parts, total + 0.5 * (types + 1)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(plain_id(), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


@query("op3_lm_scoring")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    return score(docs, crc_part(5) != 1).withColumn("held_out", crc_part(5) == 1)
