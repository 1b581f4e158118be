"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased in A-Z. Alignment gives +2 a match, -1 a mismatch or gap; a pair is
reported when its best alignment reaches the share ``score`` of what the item reaches against itself (items of fewer than
LEAST_WORDS words: all of it, so that only their whole word sequence is found).

An alignment that reaches it matches at least ceil(score * n) of the n words of the item and spans at most 3n - 2n * score
words of the document. Of any n - ceil(score * n) + t words of the item it therefore holds t within that span, whatever was
replaced, left out or put in between. The rarest words of the item are taken for it, so a seed is an n-gram of t rare words
with gaps, and no pair is lost to the seeds. Stretches that hold too few words of the item to match that many are not
aligned. Items are taken in blocks of bounded size; each block is sent to the executors
and the documents are read against it twice, once to count its words, once to find seeds and to align.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.tables import query, table

SCORE = 0.6
LEAST_WORDS = 8
BLOCK_BYTES = 8 << 20


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = flat.lower_ascii(data)
    starts, ends, first = flat.words(low, off, (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)))
    return flat.word_hashes(low, starts, ends), first


def _least(n: int, share: float) -> int:
    """How many of ``n`` words match at least in an alignment that reaches the share."""
    return math.ceil(share * n - 1e-9)


def needed(n: int, score: float) -> tuple[float, int, int, int]:
    """For an item of ``n`` words: the share of its own score it must reach, how many of its rarest words are looked for,
    how many of these must stand together, and in how many words of the document."""
    share = score if n >= LEAST_WORDS else 1.0
    together = max(1, n // 5)
    return share, n - _least(n, share) + together, together, math.floor((3 - 2 * share) * n + 1e-9)


def align(item: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman along anti-diagonals for a batch: item (B, n), part (B, L); 0 never matches. Returns the best
    score with the first and last word of the part in it."""
    b, n = item.shape
    size = part.shape[1]
    wide = np.zeros((b, size + 2 * n), part.dtype)
    wide[:, n: n + size] = part
    back = item[:, ::-1]
    one, two = np.zeros((b, n + 1), np.int32), np.zeros((b, n + 1), np.int32)  # the last two diagonals; column n is the border
    from_one, from_two = np.zeros((b, n + 1), np.int32), np.zeros((b, n + 1), np.int32)
    best, low, high = np.zeros(b, np.int32), np.zeros(b, np.int32), np.zeros(b, np.int32)
    for d in range(size + n - 1):
        # cell c of a diagonal is item word n - 1 - c against part word d - (n - 1 - c)
        words = wide[:, d + 1: d + 1 + n]
        same = (words == back) & (words != 0)
        at = d - (n - 1) + np.arange(n)
        now = np.zeros((b, n + 1), np.int32)
        start = np.zeros((b, n + 1), np.int32)
        step = two[:, 1:] + np.where(same, 2, -1)
        came = np.where(two[:, 1:] > 0, from_two[:, 1:], at)
        gap_item, gap_part = one[:, 1:] - 1, one[:, :-1] - 1
        gap = np.maximum(gap_item, gap_part)
        gap_from = np.where(gap_item >= gap_part, from_one[:, 1:], from_one[:, :-1])
        value = np.maximum(np.maximum(step, gap), 0)
        value[:, (at < 0) | (at >= size)] = 0
        now[:, :n] = value
        start[:, :n] = np.where(step >= gap, came, gap_from)
        cell = value.argmax(axis=1)
        top = value[np.arange(b), cell]
        better = top > best
        best = np.where(better, top, best)
        low = np.where(better, start[np.arange(b), cell], low)
        high = np.where(better, at[cell], high)
        two, one, from_two, from_one = one, now, from_one, start
    return best, low, high


def _hits(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for rows, data, off in flat.slices(batch):
            words, first = tokens(data, off)
            place = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            at = np.flatnonzero(known[place] == words) if len(known) else np.zeros(0, np.int64)
            yield rows, words, first, at, place[at]


def _frequency(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value["words"]
        total = np.zeros(len(known), np.int64)
        for _, _, _, _, place in _hits(batches, known):
            total += np.bincount(place, minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    return run


def _windows(doc: np.ndarray, item: np.ndarray, at: np.ndarray, first: np.ndarray, together: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, word after the last): wherever enough rare words of the item stand together, with all
    that an alignment over them can reach. Windows that overlap are one; long ones are cut into pieces that overlap by
    the reach, so that every alignment lies in a piece."""
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    last = np.arange(len(at)) + together[item] - 1
    inside = last < len(at)
    k, last = np.flatnonzero(inside), last[inside]
    close = (doc[last] == doc[k]) & (item[last] == item[k]) & (at[last] - at[k] < reach[item[k]])
    k, last = k[close], last[close]
    doc, item = doc[k], item[k]
    low, high = np.maximum(at[last] - reach[item] + 1, first[doc]), np.minimum(at[k] + reach[item], first[doc + 1])
    new = np.ones(len(k), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])  # both ends rise within a pair
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(k))[: len(head)] - 1
    for d, i, a, b in zip(doc[head].tolist(), item[head].tolist(), low[head].tolist(), high[tail].tolist()):
        over = int(reach[i])
        step = 3 * over
        while b - a > step + over:
            yield d, i, a, a + step + over
            a += step
        yield d, i, a, b


def _enough(part: np.ndarray, own: tuple[np.ndarray, np.ndarray], least: int) -> bool:
    """Whether a stretch holds as many words of the item, each as often as it stands there at most, as must match."""
    words, times = own
    place = np.minimum(np.searchsorted(words, part), len(words) - 1)
    return int(np.minimum(np.bincount(place[words[place] == part], minlength=len(words)), times).sum()) >= least


def _matched(rare: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = rare.value
        known, first_use, item_of, items, share, together, reach = (held[k] for k in ("words", "first_use", "item", "items", "share", "together", "reach"))
        bags = [np.unique(w, return_counts=True) for w in items]
        least_match = [_least(len(w), s) for w, s in zip(items, share)]
        for rows, words, first, at, place in _hits(batches, known):
            uses = first_use[place + 1] - first_use[place]
            use = np.repeat(first_use[place], uses) + np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
            at, item = np.repeat(at, uses), item_of[use]
            out: dict[tuple[int, int], tuple[int, int, int]] = {}
            found = _windows(flat.doc_of(first, at), item, at, first, together, reach)
            spans = sorted((x for x in found if _enough(words[x[2]: x[3]], bags[x[1]], least_match[x[1]])), key=lambda x: (len(items[x[1]]), x[3] - x[2], x))
            begin = 0
            while begin < len(spans):
                n, least = len(items[spans[begin][1]]), spans[begin][3] - spans[begin][2]
                end = begin + 1
                while end < len(spans) and len(items[spans[end][1]]) == n and (end + 1 - begin) * (n + spans[end][3] - spans[end][2]) < 1_000_000 and spans[end][3] - spans[end][2] <= 2 * least + n:
                    end += 1
                some, begin = spans[begin:end], end
                part = np.zeros((len(some), max(x[3] - x[2] for x in some)), np.uint64)
                for k, (_, _, a, b) in enumerate(some):
                    part[k, : b - a] = words[a:b]
                best, left, right = align(np.stack([items[x[1]] for x in some]), part)
                for (d, i, a, _), value, x, y in zip(some, best.tolist(), left.tolist(), right.tolist()):
                    if value >= share[i] * 2 * n - 1e-9:
                        # of equal scores the one that ends first
                        out[d, i] = max(out.get((d, i), (0, 0, 0)), (value, -(a - int(first[d]) + y), -(a - int(first[d]) + x)))
            keys = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([[{"item_id": held["ids"][i], "score": out[d, i][0] / (2 * len(items[i])), "first_word": -out[d, i][2], "last_word": -out[d, i][1]} for d, i in mine] for mine in _by_doc(keys, rows.num_rows)],
                                          pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])))], ["row", "matches"])

    return run


def _by_doc(keys: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for d, i in keys:
        out[d].append((d, i))
    return out


def blocks(benchmark: DataFrame) -> Iterator[dict]:
    """The items and their different words, about BLOCK_BYTES of text at a time. An item of over BLOCK_BYTES is a block."""
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // BLOCK_BYTES) + 1
    for part in range(parts):
        rows = sorted(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()) if total else []
        made = []
        for row in rows:
            data = np.frombuffer(row.text.encode(), np.uint8)
            words = tokens(data, np.array([0, len(data)]))[0]
            if len(words):
                made.append((row.item_id, words))
        yield {"ids": [i for i, _ in made], "items": [w for _, w in made], "words": np.unique(np.concatenate([w for _, w in made])) if made else np.zeros(0, np.uint64)}


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """row (all columns of docs), matches: array of item_id, score, first_word, last_word.

    Null texts and null or empty items match nothing. Items of fewer than LEAST_WORDS words match where their whole word
    sequence stands; an item of one word thus matches wherever the word stands. Repeated items count once, repeated
    documents each. Of several places with the best score the one that ends first is given. Long texts are read whole, in
    pieces. With no items every document comes back without matches."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    matches = "array<struct<item_id:bigint,score:double,first_word:int,last_word:int>>"
    out = None
    for block in blocks(benchmark):
        known = block["words"]
        counts = rows.select("text").mapInArrow(_frequency(context.broadcast({"words": known})), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        often = np.zeros(len(known), np.int64)
        for r in counts:  # at most one for each word of the block
            often[r.word] = r.n
        rules = [needed(len(w), score) for w in block["items"]]
        uses = []
        for i, own in enumerate(block["items"]):
            place = np.searchsorted(known, own)
            rare = np.lexsort((own, often[place]))[: rules[i][1]]
            uses += [(k, i) for k in np.unique(place[rare]).tolist()]
        use = np.array(sorted(uses), np.int64).reshape(-1, 2)
        keep, first_use = np.unique(use[:, 0], return_index=True)
        held = context.broadcast({"ids": block["ids"], "items": block["items"], "words": known[keep], "first_use": np.append(first_use, len(use)), "item": use[:, 1],
                                  "share": [r[0] for r in rules], "together": np.array([r[2] for r in rules], np.int64), "reach": np.array([r[3] for r in rules], np.int64)})
        src = rows if out is None else out
        found = src.select("row" if out is None else F.struct("row", "matches").alias("row"), F.col("row.text").cast("string").alias("text")) if out is not None else rows
        shape = f"row {kind}, matches {matches}" if out is None else f"row struct<row:{kind},matches:{matches}>, matches {matches}"
        made = found.mapInArrow(_matched(held), shape)
        out = made if out is None else made.select("row.row", F.concat("row.matches", "matches").alias("matches"))
    return out


@query("op8_benchmark_decontamination")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf, "benchmark")).select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.score", "m.first_word", "m.last_word")
