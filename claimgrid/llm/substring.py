"""Substring dedup by level-wise doubling.

The loop starts at a quarter of the length, and each level doubles the length. Of the windows of one level inside each
window of the next only the one with the smallest hash speaks for it; equal windows have equal speakers, so a window can
only repeat where its speaker does. Speakers found in one document alone are dropped, and a level looks only at windows
whose speaker repeats. All documents that hold a repeated window go on, the smallest too. Windows of the full length are
counted, and what repeats is removed; ``longest_repeats`` goes on doubling until none is left.

Documents with the same word sequence are one document to both levels, under the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.tables import DEAL, grouped, keyed, plain_id, query, table, written

SECOND, NONE = np.uint64(0xA0761D6478BD642F), np.uint64(0xFFFFFFFFFFFFFFFF)


def _sequence(data: np.ndarray, off: np.ndarray):
    starts, ends, first = flat.words(data, off)
    hashes = flat.word_hashes(data, starts, ends)
    return hashes, first, flat.prefix_hash(hashes, flat.BASE), flat.prefix_hash(flat.mix(hashes ^ SECOND), flat.BASE2)


def _speakers(prefix: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each window of ``length`` the smallest hash among its windows of half that length."""
    half = (length + 1) // 2
    at = np.arange(max(0, n - half + 1))
    return flat.window_min(flat.stretch_hash(prefix, at, at + half, flat.BASE), length - half + 1)


def _texts(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _survey(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                hashes, first, p1, p2 = _sequence(data, off)
                low = _speakers(p1, len(hashes), length)
                at = np.flatnonzero(flat.inside(first, len(hashes), length))
                doc, value = flat.doc_of(first, at), low[at]
                new = np.ones(len(at), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                doc, value = doc[new], value[new]
                cuts = np.searchsorted(doc, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(first)),
                     pa.array(flat.stretch_hash(p1, first[:-1], first[1:], flat.BASE).view(np.int64)),
                     pa.array(flat.stretch_hash(p2, first[:-1], first[1:], flat.BASE2).view(np.int64)),
                     pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in _texts(rows, data, off)]),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(value.view(np.int64)))],
                    ["doc_id", "key", "n_words", "h1", "h2", "sha", "speakers"])

    return run


def _speaking(length: int, longer: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of ``length`` that speak for windows of the ``longer`` size and whose own speaker is in the document's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                hashes, first, p1, _ = _sequence(data, off)
                held = rows.column("speakers").flatten().to_numpy().view(np.uint64)
                at = np.arange(max(0, len(hashes) - length + 1))
                own = flat.stretch_hash(p1, at, at + length, flat.BASE)
                alive = np.isin(_speakers(p1, len(hashes), length), held)
                low = flat.window_min(np.where(alive, own, NONE), longer - length + 1)  # a window whose speaker was dropped can't repeat
                whole = _speakers(p1, len(hashes), longer)
                at = np.flatnonzero(flat.inside(first, len(hashes), longer))
                at = at[low[at] == whole[at]]
                doc, value = flat.doc_of(first, at), whole[at]
                new = np.ones(len(at), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                doc = doc[new]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), rows.column("key").take(pa.array(doc)), pa.array(value[new].view(np.int64))], ["doc_id", "key", "speaker"])

    return run


def _extended(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of full length whose speaker is in the document's list of repeated speakers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                hashes, first, p1, p2 = _sequence(data, off)
                low = _speakers(p1, len(hashes), length)
                at = np.flatnonzero(flat.inside(first, len(hashes), length))
                at = at[np.isin(low[at], rows.column("speakers").flatten().to_numpy().view(np.uint64))]
                doc = flat.doc_of(first, at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32)),
                     pa.array(flat.stretch_hash(p1, at, at + length, flat.BASE).view(np.int64)),
                     pa.array(flat.stretch_hash(p2, at, at + length, flat.BASE2).view(np.int64))],
                    ["doc_id", "key", "at", "h1", "h2"])

    return run


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                sums, gone = [], []
                for text, found in zip(_texts(rows, data, off), rows.column("found")):
                    words = text.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = found.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    drop = np.cumsum(edge[:-1]) > 0
                    gone.append(int(drop.sum()))
                    sums.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~drop)])).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(gone, pa.int64()), pa.array(sums)], ["doc_id", "key", "n_removed", "cut_sha"])

    return run


def survey(docs: DataFrame, length: int) -> DataFrame:
    """One row per document: word count, hash of the sequence, digest of the kept words if nothing is removed, and the
    hashes that speak for its windows."""
    return keyed(docs).mapInArrow(_survey(length), "doc_id long, key long, n_words long, h1 long, h2 long, sha string, speakers array<long>")


def repeated_windows(texts: DataFrame, speakers: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Texts of the candidates, and all their windows of the last size that start in two documents, with the smallest of
    these as ``lo``. Each size is twice the one before (less one where the next is odd); ``speakers`` are half the first."""
    for size in sizes:
        owners = grouped(speakers, "speaker").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("speaker")
        lists = speakers.join(owners, "speaker").groupBy("doc_id", "key").agg(F.collect_set("speaker").alias("speakers"))
        lists = written(lists, "substring-lists").filter("size(speakers) > 0")
        texts = written(texts.select("doc_id", "key", "text").join(lists.hint("shuffle_hash"), ["doc_id", "key"]), "substring-texts")
        if size != sizes[-1]:
            speakers = written(texts.mapInArrow(_speaking(size, sizes[sizes.index(size) + 1]), "doc_id long, key long, speaker long"), "substring-speakers")
    windows = texts.mapInArrow(_extended(sizes[-1]), "doc_id long, key long, at int, h1 long, h2 long")
    lowest = grouped(windows, "h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    return texts, windows.join(lowest, ["h1", "h2"]).select("doc_id", "key", "at", "h1", "h2", "lo")


def doubled(length: int) -> list[int]:
    """The levels up to ``length``."""
    return [(length + 1) // 2, length] if length > 1 else [length]


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts in a document with a smaller doc_id.

    Input: doc_id, text; other columns are ignored. Output: doc_id, n_words, n_removed, kept_sha256 (words that stay,
    joined by one space). Windows are judged on the input. A null text has no words. A null doc_id stands after all
    others; such documents are never "smaller" than each other. Repeated rows each get the same result row.
    Memory: one slice of a few MB and the longest document; no group is ever gathered.
    """
    sizes = doubled(length)
    seen = written(survey(docs, sizes[0]), "substring-survey")
    classes = grouped(seen, "h1", "h2", "n_words").agg(F.min("doc_id").alias("head")).drop(DEAL)
    seen_in = seen.join(classes, ["h1", "h2", "n_words"])
    candidates = seen_in.filter("doc_id = head").select("doc_id", "key", F.explode("speakers").alias("speaker"))
    texts, found = repeated_windows(keyed(docs), candidates, sizes)
    spans = found.filter("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_set("at").alias("found"))
    cut = (texts.select("doc_id", "key", "text").join(spans.hint("shuffle_hash"), ["doc_id", "key"])
           .mapInArrow(_cut(length), "doc_id long, key long, n_removed long, cut_sha string").dropDuplicates(["doc_id", "key"]))
    copy = (F.col("doc_id") > F.col("head")) & (F.col("n_words") >= length)
    none = hashlib.sha256(b"").hexdigest()
    return (seen_in.select("doc_id", "key", "n_words", "sha", "head").join(cut, ["doc_id", "key"], "left")
            .select(plain_id(), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(copy, F.lit(none)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")))


def longest_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Go on doubling: 2 x ``length``, 4 x ``length``, ... for the windows that repeat at the length before, until none does.

    Output: doc_id, length, n_windows (windows of that length that also start in a smaller document). The loop tests
    only whether a level is empty; the number of levels is the logarithm of the longest repeat.
    """
    out, sizes = None, doubled(length)
    texts, speakers = keyed(docs), survey(docs, sizes[0]).select("doc_id", "key", F.explode("speakers").alias("speaker"))
    while True:
        texts, found = repeated_windows(texts.dropDuplicates(["doc_id", "key"]), speakers, sizes)
        found = written(found, "substring-level")
        level = found.filter("doc_id > lo").groupBy("doc_id").agg(F.countDistinct("key", "at").alias("n_windows")).select(plain_id(), F.lit(sizes[-1]).alias("length"), "n_windows")
        out = level if out is None else out.unionByName(level)
        if found.isEmpty():
            return out
        speakers, sizes = found.select("doc_id", "key", F.col("h1").alias("speaker")).distinct(), [2 * sizes[-1]]


@query("op1_substring_dedup", r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) as h, unnest(range(1, len(w) - 48)) as i from d),
low as (select h, min(doc_id) as lo from win group by h),
bad as (select doc_id, list(i) as found from win join low using (h) where doc_id > lo group by doc_id),
covered as (select doc_id, list_distinct(flatten(list_transform(found, lambda i: range(i, i + 50)))) as gone from bad),
kept as (select d.doc_id, w, coalesce(gone, []) as gone, list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)) as k from d left join covered using (doc_id))
select doc_id, cast(len(w) as bigint) as n_words, cast(len(gone) as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""")
def op1(spark, sf):
    return dedup(table(spark, sf, "documents"))
