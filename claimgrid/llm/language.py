"""Language ID by prediction by partial matching over bytes.

For each language a context tree counts the bytes that follow every context of up to three bytes. A byte that was
seen n times in a context with t counts of d distinct bytes costs -log2(n / (t + d)); one that was not seen costs the
escape -log2(d / (t + d)) and is looked up in the context without its oldest byte; below the empty context all 256
bytes are equally likely. Contexts that were never seen cost nothing. Statistics are frozen after training, so the
code length of a text is an exact sum, and the language with the shortest code is predicted.

Counting combines within a task before the shuffle. All four-byte strings of all languages are kept, whatever their
counts, and all shorter contexts are sums of these; the tree grows with the different strings, not with the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.tables import crc_part, query, table, written

MAX_LANGUAGES = 256


def four_bytes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each byte with the three before it; line ends stand before a text."""
    sizes = np.diff(off)
    at = np.arange(len(data)) + 3 * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded = np.full(len(data) + 3 * len(sizes), 10, np.uint32)
    padded[at] = data
    return padded[at - 3] << 24 | padded[at - 2] << 16 | padded[at - 1] << 8 | padded[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

    for batch in batches:
        for rows, data, off in flat.slices(batch):
            grams, langs = four_bytes(data, off), np.array(rows.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = np.repeat(langs == lang, np.diff(off))
                parts = held.setdefault(lang, [])
                parts.append(np.unique(grams[mine], return_counts=True))
                if len(parts) > 8:
                    held[lang] = [merge(parts)]
    for lang, parts in held.items():
        grams, count = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(count)], ["lang", "gram", "n"])


class Trees:
    """Code lengths of all languages, looked up for many bytes at once."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs, k = langs, len(langs)
        seen = np.unique(np.concatenate([gram & 255, gram >> 8 & 255, gram >> 16 & 255, gram >> 24, [10]])).astype(np.int64)
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)  # bytes never seen share the code 0
        s = self.symbols = len(seen) + 1
        parts = [self.code[gram >> shift & 255] for shift in (24, 16, 8, 0)]
        strings, counts = [], []
        for length in (1, 2, 3, 4):
            joined = np.zeros(len(gram), np.int64)
            for p in parts[4 - length:]:
                joined = joined * s + p
            names, at = np.unique(joined, return_inverse=True)
            table = np.zeros((len(names), k))
            np.add.at(table, (at, lang), n)
            strings.append(names)
            counts.append(table)
        cost = np.full((s, k), 8.0)
        below = lambda names, length: names % s ** (length - 1)  # noqa: E731  the string without its oldest byte
        self.costs, self.escapes = [], []
        for length, names, count in zip((1, 2, 3, 4), strings, counts):
            context, at = np.unique(names // s, return_inverse=True)
            total, kinds = np.zeros((len(context), k)), np.zeros((len(context), k))
            np.add.at(total, at, count)
            np.add.at(kinds, at, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(count / (total + kinds)[at])
            if length == 1:
                shorter = np.full((len(names), k), 8.0)
            else:
                at_below = np.searchsorted(strings[length - 2], below(names, length))
                shorter = self.costs[-1][at_below]
            self.costs.append(np.where(count > 0, own, escape[at] + shorter).astype(np.float32))
            self.escapes.append((context, escape.astype(np.float32)))
        self.first = np.append(self.escapes[0][1][0] + np.float32(8.0), 0).astype(np.float32)[:k]
        # strings of one and two bytes and contexts of three are found directly, strings of four among all in order
        self.two = self._dense(strings[1], s * s)
        self.three = self._dense(strings[2], s ** 3)
        self.context3 = self._dense(self.escapes[3][0], s ** 3)
        self.context2 = self._dense(self.escapes[2][0], s * s)
        self.context1 = self._dense(self.escapes[1][0], s)
        self.one = self._dense(strings[0], s)
        self.four = strings[3]

    @staticmethod
    def _dense(names: np.ndarray, size: int) -> np.ndarray:
        out = np.full(size, -1, np.int32)
        out[names] = np.arange(len(names))
        return out

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        s = self.symbols
        a, b, c, d = (self.code[(grams >> shift) & 255] for shift in (24, 16, 8, 0))
        before = self.context3[(a * s + b) * s + c]
        name = ((a * s + b) * s + c) * s + d
        at = np.minimum(np.searchsorted(self.four, name), len(self.four) - 1)
        at = np.where(self.four[at] == name, at, -1)
        out = self.costs[3][np.maximum(at, 0)]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            total = np.zeros((len(rest), len(self.langs)), np.float32)
            b, c, d, before = b[rest], c[rest], d[rest], before[rest]
            todo = np.arange(len(rest))
            for known, context, costs, escape, name in (
                    (self.three, before, self.costs[2], self.escapes[3][1], (b * s + c) * s + d),
                    (self.two, self.context2[b * s + c], self.costs[1], self.escapes[2][1], c * s + d),
                    (self.one, self.context1[c], self.costs[0], self.escapes[1][1], d)):
                there = context[todo] >= 0
                total[todo[there]] += escape[context[todo[there]]]
                at = known[name[todo]]
                total[todo[at >= 0]] += costs[at[at >= 0]]
                todo = todo[at < 0]
            total[todo] += self.first
            out[rest] = total
        return out


def _no_letter(text: bytes) -> bool:
    return not any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def _predict(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value  # one object in each worker, so the tables are built once
        langs = held["langs"]
        if langs and "trees" not in held:
            held["trees"] = Trees(langs, held["lang"], held["gram"], held["n"])
        trees = held.get("trees")
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                sizes = np.diff(off)
                letters = np.append(0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122)))
                plain = letters[off[1:]] == letters[off[:-1]]
                whole = data.tobytes()
                und = np.array([bool(p) and _no_letter(whole[a:b]) for p, a, b in zip(plain, off[:-1].tolist(), off[1:].tolist())], bool)
                if trees is None:
                    pred, score = ["und"] * len(sizes), np.zeros(len(sizes))
                else:
                    bits = np.zeros((len(sizes), len(langs)))
                    some = sizes > 0
                    if some.any():
                        bits[some] = np.add.reduceat(trees.lengths(four_bytes(data, off)).astype(np.float64), off[:-1][some], axis=0)
                    best = bits.argmin(axis=1)
                    score = np.where(und, 0.0, 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1))
                    pred = ["und" if u else langs[i] for u, i in zip(und, best)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return run


def train(docs: DataFrame) -> Broadcast:
    """Counts of four-byte strings by language as a broadcast variable. Rows without text or lang teach nothing, nor does
    an empty text."""
    counts = (docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
              .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rows = written(counts, "language-counts").orderBy("lang", "gram").toArrow()
    named = pc.dictionary_encode(rows["lang"]).unify_dictionaries().combine_chunks()
    names = named.dictionary.to_pylist()
    langs = sorted(names)
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MAX_LANGUAGES}")
    place = np.array([langs.index(x) for x in names], np.int64)
    model = {"langs": langs, "lang": place[named.indices.to_numpy()], "gram": rows["gram"].to_numpy(), "n": rows["n"].to_numpy().astype(float)}
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Broadcast) -> DataFrame:
    """row (all columns of docs), lang_pred, score: the learned language with the shortest code and its share of the
    probability of the text over all languages. A text that is null or has no letter is ``und`` with score 0, and so
    is every text if nothing was learned. Equal code lengths give the language first in order."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"row {kind}, lang_pred string, score double")


@query("op4_language_id")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(crc_part(5) != 0))
    return identify(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score").withColumn("held_out", crc_part(5) == 0)
