"""Suffix-array dedup: byte strings of a given length that start more than once, found by sorting suffixes.

The suffixes of the whole corpus are not sorted at once. A window of ``length`` bytes contains one anchor, the stretch
of ``anchor`` bytes in it with the smallest hash (the leftmost of equal ones). Equal windows have equal anchors at the
same offset, so only suffixes with the same anchor and offset have to be sorted against each other, and anchors that
stand once in the corpus need no sorting at all. Each task sorts many such segments side by side in one mergesort:
two suffixes are compared by binary search for their common extension on prefix polynomial hashes, then by the next
byte. Neighbours with a common extension of ``length`` bytes are repeated, after their bytes have been compared.

Whole texts, and stretches around an anchor, that are equal as a whole are found by their SHA-256, as polynomial hashes
of different long texts can agree; they are counted and sorted once. Where many different stretches share an anchor (a passage that a third of the documents quote), they are dealt out again by longer anchors, at last
by the window itself, so no task meets an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.tables import DEAL, grouped, keyed, named, plain_id, query, table, written

CROWD = 256
SUFFIXES, SLICE = 100_000, 512 << 10  # suffixes sorted together, bytes of text worked on together: each takes some 100 bytes of memory
CONTEXT = "doc_id long, key long, anchor long, digest binary, lead int, size int, starts array<int>, body binary"


def prefix_sums(data: np.ndarray, base: int = flat.BYTE_BASE) -> np.ndarray:
    return flat.prefix_hash(data.astype(np.uint16) + np.uint16(1), base)


def anchors(data: np.ndarray, off: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of the anchor of each, the hash of every stretch of ``width``."""
    prefix = prefix_sums(data)
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    hashes = flat.mix((prefix[width:] - prefix[:-width]) * flat.powers(flat.BYTE_BASE, n + 1)[1][: n - width + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    low = flat.window_min(ranked, length - width + 1)
    at = np.flatnonzero(flat.inside(off, n, length))
    return at, (low[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), hashes


def _survey(length: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch, limit=SLICE):
                at, spot, hashes = anchors(data, off, length, width)
                new = np.ones(len(at), bool)
                new[1:] = (spot[1:] != spot[:-1]) | (flat.doc_of(off, at[1:]) != flat.doc_of(off, at[:-1]))
                cuts = np.searchsorted(at[new], off)
                whole = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(off)), pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes[spot[new]].view(np.int64)))],
                    ["doc_id", "key", "n_bytes", "sha", "anchors"])

    return run


def _contexts(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, length: int, width: int, wanted: np.ndarray | None, shift: np.ndarray) -> pa.RecordBatch:
    """The stretches that the windows of one anchor cover; equal ones of a document are one row with all their starts."""
    at, spot, hashes = anchors(data, off, length, width)
    if wanted is not None:
        keep = np.isin(hashes[spot], wanted)
        at, spot = at[keep], spot[keep]
    doc = flat.doc_of(off, at)
    new = np.ones(len(at), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, end = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + length
    doc, spot = doc[first], spot[first]
    whole = data.tobytes()
    digest = [hashlib.sha256(whole[a:b]).digest()[:16] for a, b in zip(start.tolist(), end.tolist())]
    d1, d2 = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2).T
    order = np.lexsort((start, d2, d1, doc))
    start, end, doc, spot, d1, d2 = (x[order] for x in (start, end, doc, spot, d1, d2))
    head = np.ones(len(start), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    top = np.flatnonzero(head)
    take = pa.array(doc[top])
    return pa.RecordBatch.from_arrays(
        [rows.column(0).take(take), rows.column(1).take(take), pa.array(hashes[spot[top]].view(np.int64)), pa.array([digest[i] for i in order[top].tolist()], pa.binary()),
         pa.array((spot - start)[top].astype(np.int32)), pa.array((end - start)[top].astype(np.int32)),
         pa.ListArray.from_arrays(pa.array(np.append(top, len(start)).astype(np.int32)), pa.array((start - off[doc] + shift[doc]).astype(np.int32))),
         pa.array([whole[a:b] for a, b in zip(start[top].tolist(), end[top].tolist())], pa.binary())],
        ["doc_id", "key", "anchor", "digest", "lead", "size", "starts", "body"])


def _from_texts(length: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch, limit=SLICE):
                yield _contexts(rows, data, off, length, width, rows.column("anchors").flatten().to_numpy().view(np.uint64), np.zeros(len(off), np.int64))

    return run


def _from_contexts(length: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, off = _bodies(batch)
            first = np.array([x[0].as_py() for x in batch.column("starts")], np.int64)
            yield _contexts(batch, body, off, length, width, None, first)

    return run


def _bodies(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    size = np.asarray(rows.column("size"), np.int64)
    return np.frombuffer(b"".join(rows.column("body").to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(size)])


class Suffixes:
    """Suffixes of one buffer, compared over at most ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.prefix = data, length, prefix_sums(data)
        self.power = flat.powers(flat.BYTE_BASE, len(data) + 1)[0]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search on the prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        pa_, pb, wa, wb = self.prefix[a], self.prefix[b], self.power[a], self.power[b]
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa_) * wb == (self.prefix[b + mid] - pb) * wa
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            high = np.maximum(high, low)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        end = n >= self.length
        x, y = self.data[np.minimum(a + n, len(self.data) - 1)], self.data[np.minimum(b + n, len(self.data) - 1)]
        return np.where(end, or_equal, x < y)

    def sort(self, segment: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of all segments at once; returns the segment and the position of each suffix in order."""
        order = np.argsort(segment, kind="stable")
        segment, at = segment[order], at[order]
        edge = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(at)))
        base, size = np.repeat(edge, size), np.repeat(size, size)
        rank = np.arange(len(at)) - base
        width = 1
        while len(at) and width < size.max():
            run = rank // width
            other = (run ^ 1) * width
            low, high = other.copy(), np.minimum(other + width, size)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                right = self.before(at[base[open_] + mid], at[open_], (run[open_] & 1) == 1)
                low[open_] = np.where(right, mid + 1, low[open_])
                high[open_] = np.where(right, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            moved = np.where(other < size, (run >> 1) * 2 * width + (rank - run * width) + (low - other), rank)
            merged = np.empty_like(at)
            merged[base + moved] = at
            at, width = merged, width * 2
        return segment, at

    def repeated(self, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions whose ``length`` bytes stand at another position of the same segment."""
        segment, at = self.sort(segment, at)
        pair = np.flatnonzero(segment[1:] == segment[:-1])
        pair = pair[self.common(at[pair], at[pair + 1]) >= self.length]
        if not self.verified(at[pair], at[pair + 1]):  # a hash collision: fall back to the bytes of this batch
            seen: dict[tuple[int, bytes], list[int]] = {}
            for s, p in zip(segment.tolist(), at.tolist()):
                seen.setdefault((s, self.data[p: p + self.length].tobytes()), []).append(p)
            return np.array([p for found in seen.values() if len(found) > 1 for p in found], np.int64)
        return np.unique(np.concatenate([at[pair], at[pair + 1]]))

    def verified(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Compare the bytes of all pairs; pairs that move on by one byte together are one stretch."""
        if not len(a):
            return True
        order = np.lexsort((a, b - a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, ((b - a)[1:] != (b - a)[:-1]) | (a[1:] != a[:-1] + 1)))
        span = np.diff(np.append(first, len(a))) + self.length - 1
        step = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        return bool((self.data[np.repeat(a[first], span) + step] == self.data[np.repeat(b[first], span) + step]).all())


def _sorted(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come ordered by anchor; whole anchors are sorted together until about SUFFIXES suffixes are met."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        data, off = _bodies(rows)
        anchor, lead = np.asarray(rows.column("anchor"), np.int64), np.asarray(rows.column("lead"), np.int64)
        group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
        count = np.diff(off) - length + 1
        owner = np.repeat(np.arange(len(count)), count)
        local = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found = Suffixes(data, length).repeated(group[owner] * (length + 1) + lead[owner] - local, off[owner] + local)
        owner = flat.doc_of(off, found)
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1] + 1) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found))[: len(first)] - 1
        owner, low, high = owner[first], (found[first] - off[owner[first]]), (found[last] - off[owner[first]] + length)
        starts = rows.column("starts").combine_chunks()
        count = np.diff(np.asarray(starts.offsets))[owner]
        flat_starts = starts.values.to_numpy()
        which = np.repeat(np.arange(len(owner)), count)
        place = flat_starts[np.repeat(np.asarray(starts.offsets)[:-1][owner], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        take = pa.array(owner[which])
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").combine_chunks().take(take), rows.column("key").combine_chunks().take(take), pa.array((place + low[which]).astype(np.int32)), pa.array((place + high[which]).astype(np.int32))],
            ["doc_id", "key", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        met = 0
        for batch in batches:
            anchor = np.asarray(batch.column("anchor"), np.int64)
            windows = np.cumsum(np.asarray(batch.column("size"), np.int64) - length + 1)
            low = 0
            edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and len(anchor) and held[-1].column("anchor")[-1].as_py() != anchor[0]:
                edges = np.append(0, edges)
            for edge in edges.tolist():
                here = int(windows[edge - 1] - (windows[low - 1] if low else 0)) if edge > low else 0
                if met + here >= SUFFIXES:
                    if edge > low:
                        held.append(batch.slice(low, edge - low))
                    yield work(pa.Table.from_batches(held))
                    held, met, low = [], 0, edge
            if low < len(anchor):
                held.append(batch.slice(low))
                met += int(windows[-1] - (windows[low - 1] if low else 0))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in flat.slices(batch, limit=SLICE):
            found = rows.column("found")
            spans, size = found.flatten(), np.diff(np.asarray(found.offsets))
            shift = np.repeat(off[:-1], size)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, spans.field("low").to_numpy() + shift, 1)
            np.add.at(edge, spans.field("high").to_numpy() + shift, -1)
            drop = np.cumsum(edge[:-1]) > 0
            new = drop.copy()
            new[1:] &= ~drop[:-1]
            inner = off[:-1][off[:-1] < len(data)]
            new[inner] = drop[inner]
            below = lambda x: np.diff(np.append(0, np.cumsum(x))[off])
            kept, cuts = data[~drop].tobytes(), np.append(0, np.cumsum(below(~drop))).tolist()
            pieces = [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(below(drop)), pa.array(below(new)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces]), pa.array(pieces, pa.binary())],
                ["doc_id", "key", "n_removed", "n_spans", "cut_sha", "kept"])


def repeated_spans(contexts: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """doc_id, key, low, high: stretches of a document made of repeated windows; they may overlap. Each step is a table
    of its own, so that no plan covers more than one join."""
    shape = ["anchor", "digest"]
    shapes = grouped(contexts, *shape).agg(F.sum(F.size("starts")).alias("n"), F.min(F.struct("doc_id", "key")).alias("head")).drop(DEAL)
    shapes = written(shapes, "suffix-shapes")
    crowds = grouped(shapes, "anchor").agg(F.count("*").alias("kinds")).drop(DEAL)
    shapes = written(shapes.join(crowds, "anchor").filter("n > 1 or kinds > 1"), "suffix-crowds")
    spoken = F.expr("kinds > 1 and doc_id = head.doc_id and key = head.key")
    met = contexts.join(shapes, shape).filter((F.col("n") > 1) | spoken)
    met = written(met.select(*[c for c in contexts.columns if c != "body"], "n", "kinds", F.when(spoken, F.col("body")).alias("body")), "suffix-met")
    whole = (met.filter("n > 1").select("doc_id", "key", "size", F.explode("starts").alias("low"))
             .select("doc_id", "key", "low", (F.col("low") + F.col("size")).alias("high")))
    few = met.filter(F.col("body").isNotNull() & (F.col("kinds") <= CROWD)).select(*contexts.columns).repartition("anchor").sortWithinPartitions("anchor")
    spans = written(whole.unionByName(few.mapInArrow(_sorted(length), "doc_id long, key long, low int, high int")), "suffix-spans")
    crowded = met.filter(F.col("body").isNotNull() & (F.col("kinds") > CROWD))
    if len(widths) < 2 or crowded.isEmpty():
        return spans
    again = written(crowded.select(*contexts.columns).mapInArrow(_from_contexts(length, widths[1]), CONTEXT), "suffix-contexts")
    return spans.unionByName(repeated_spans(again, length, widths[1:]))


def scan(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Surveyed documents, texts that stand more than once (sha, head, copies), texts that hold repeated windows, and the
    repeated spans in these."""
    widths = (length // 2, length - max(1, length // 20), length)
    seen = written(keyed(docs).mapInArrow(_survey(length, widths[0]), "doc_id long, key long, n_bytes long, sha string, anchors array<long>"), "suffix-survey")
    same = written(grouped(seen.filter(F.col("n_bytes") >= length), "sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).drop(DEAL).filter("copies > 1"), "suffix-copies")
    stood = seen.filter(F.size("anchors") > 0).join(same, "sha", "left").filter("head is null or doc_id = head").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    stood = written(stood, "suffix-anchors")
    twice = grouped(stood, "anchor").count().filter("count > 1").select("anchor")
    lists = stood.join(twice, "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors"))
    lists = written(lists, "suffix-lists").filter("size(anchors) > 0")
    texts = written(keyed(docs).join(lists.hint("shuffle_hash"), ["doc_id", "key"]), "suffix-texts")
    contexts = written(texts.mapInArrow(_from_texts(length, widths[0]), CONTEXT), "suffix-contexts")
    return seen.drop("anchors"), same, texts.select("doc_id", "key", "text"), repeated_spans(contexts, length, widths)


CUT = "doc_id long, key long, n_removed long, n_spans long, cut_sha string, kept binary"


def _cut_rows(texts: DataFrame, spans: DataFrame) -> DataFrame:
    lists = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("low", "high")).alias("found"))
    return texts.join(lists.hint("shuffle_hash"), ["doc_id", "key"]).mapInArrow(_cut, CUT)


def deduped(docs: DataFrame, length: int = 400) -> DataFrame:
    """All columns of docs, with ``text`` replaced by what remains. Bytes of a character that lost its other bytes go
    too. Copies of a whole text of at least ``length`` bytes keep nothing."""
    seen, same, texts, spans = scan(docs, length)
    cut = _cut_rows(texts, spans).select("doc_id", "key", "kept").unionByName(seen.join(same, "sha").select("doc_id", "key", F.lit(b"").alias("kept")))
    best = written(cut.groupBy("doc_id", "key").agg(F.min("kept").alias("kept")), "suffix-cut")
    joined = named(docs).join(best.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("kept").alias("_kept")).hint("shuffle_hash"), ["_id", "_key"], "left")
    whole = F.decode(F.try_validate_utf8(F.col("_kept").cast("string")).cast("binary"), "UTF-8")
    mended = F.regexp_replace(F.make_valid_utf8(F.col("_kept").cast("string")), "\ufffd", "")
    text = F.when(F.col("_kept").isNull(), F.col("row.text")).otherwise(F.coalesce(whole, mended))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else, same document included.

    Input: doc_id, text; other columns are ignored. Output: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (remaining bytes). A null text is empty. Repeated rows are copies of each other. Documents shorter than
    ``length`` lose nothing. Positions in a text are 32-bit, as a text is below 2 GB.
    """
    seen, same, texts, spans = scan(docs, length)
    cut = written(_cut_rows(texts, spans).drop("kept").dropDuplicates(["doc_id", "key"]), "suffix-cut")
    copy = F.col("copies").isNotNull()
    return (seen.join(same.select("sha", "copies"), "sha", "left").join(cut, ["doc_id", "key"], "left")
            .select(plain_id(), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")))


@query("op9_suffix_array_dedup")
def op9(spark, sf):
    return dedup(table(spark, sf, "documents"))
