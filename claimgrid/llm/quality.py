"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

Each document is described by a few statistics. They are standardised with sums over all documents and mapped to
random cosine features, whose inner products approximate a Gaussian kernel. Each partition sums its share of the
normal equations; the sums are added up by Spark, cell by cell, and the small system is solved on the driver. Scores of
a part of the labelled rows that the equations have not seen are pooled into bins and calibrated by the pool-adjacent-
violators rule, so a score is the share of label 1 among documents like it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.tables import crc_part, query, table, written

FEATURES, WIDTH, RIDGE, SEED, BINS = 192, 6.0, 0.1, 7, 256
THRESHOLD = 0.7
NAMES = ["log_words", "word_bytes", "upper", "symbols", "marks", "stops", "digits", "wide_bytes", "distinct", "twice_in_a_row", "most_frequent", "line_words", "repeated_lines", "bare_words", "loud_words", "long_words"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, NAMES). All are 0 for an empty text."""
    docs = len(off) - 1
    starts, ends, first = flat.words(data, off)
    hashes = flat.word_hashes(data, starts, ends)
    n, size = np.diff(first), np.maximum(np.diff(off), 1)
    words = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[off[1:]] - total[off[:-1]]) / size

    def of_words(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return (total[first[1:]] - total[first[:-1]]) / words

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    letters = np.append(0, np.cumsum(upper | lower | (data >= 128)))
    capitals = np.append(0, np.cumsum(upper))
    length = ends - starts
    has, caps = letters[ends] - letters[starts], capitals[ends] - capitals[starts]
    again = np.append(False, hashes[1:] == hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    again[first[:-1][n > 0]] = False
    doc = np.repeat(np.arange(docs), n)
    order = np.lexsort((hashes, doc))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(hashes) else np.zeros(0, bool)
    runs = np.flatnonzero(new)
    run_doc, run_size = doc[order][runs], np.diff(np.append(runs, len(hashes)))
    distinct, most = np.bincount(run_doc, minlength=docs), np.zeros(docs)
    np.maximum.at(most, run_doc, run_size)
    lines = share(data == 10) * size + 1
    whole = data.tobytes()
    repeated = np.zeros(docs)
    for d in np.flatnonzero(lines > 2):
        parts = [x for x in whole[off[d]: off[d + 1]].split(b"\n") if x.strip()]
        repeated[d] = 1 - len(set(parts)) / len(parts) if parts else 0
    out = np.stack([
        np.log1p(n), of_words(length), share(upper), share(symbol), share(data == 33), share(np.isin(data, np.frombuffer(b".,;:?", np.uint8))), share((data >= 48) & (data <= 57)),
        share(data >= 128), distinct / words, of_words(again), most / words, np.log1p(n / lines), repeated, of_words(has == 0), of_words((has > 0) & (caps == has)), of_words(length > 20)], axis=1)
    out[n == 0] = 0
    return out.astype(np.float32)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in flat.slices(batch):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def lift(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, and a constant."""
    rng = np.random.default_rng(SEED)
    directions, shift = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ directions + shift) * np.sqrt(2 / FEATURES)
    return np.hstack([z, np.ones((len(x), 1))])


def _equations(mean: np.ndarray, scale: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = lift(_matrix(batch.column("x")), mean, scale)
                total += z.T @ np.hstack([z, np.asarray(batch.column("y"), np.float64)[:, None]])
        cells = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _scored(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, steps: np.ndarray, levels: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = lift(_matrix(batch.column("x")), mean, scale) @ weights
                score = np.interp(raw, steps, levels) if len(steps) else np.clip(raw, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def isotonic(value: np.ndarray, count: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order; with half a case of either label added to a pool, so that no score
    is certain. Returns the middle of each pool and its level."""
    pools: list[list[float]] = []
    for v, n, k in zip(value.tolist(), count.tolist(), ones.tolist()):
        pools.append([v * n, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    return np.array([a / n for a, n, _ in pools]), np.maximum.accumulate(np.array([(k + 0.5) / (n + 1) for _, n, k in pools]))


def classify(docs: DataFrame, labels: DataFrame, learn, calibrate) -> DataFrame:
    """doc_id, score for every row of docs. ``learn`` and ``calibrate`` are conditions on doc_id that choose the
    labelled rows for the equations and for the calibration.

    labels: doc_id, quality; null and unknown ids teach nothing, a document with several labels counts once with their
    mean. Null texts are empty; statistics are 0 for these. Without labels every score is 0.5. The driver holds the
    FEATURES x FEATURES system and at most BINS bins."""
    described = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_described, "doc_id long, x array<float>"), "quality-statistics")
    k = len(NAMES)
    sums = described.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("x")[i].cast("double") * F.col("x")[i]).alias(f"q{i}") for i in range(k)]).first()
    n = max(1, sums["n"])
    mean = np.array([sums[f"s{i}"] or 0 for i in range(k)], np.float64) / n
    scale = np.sqrt(np.maximum(np.array([sums[f"q{i}"] or 0 for i in range(k)], np.float64) / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    labelled = written(described.join(known, "doc_id"), "quality-labelled")
    cells = labelled.filter(learn).select("x", "y").mapInArrow(_equations(mean, scale), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow().to_pandas()
    total = np.zeros((FEATURES + 1) * (FEATURES + 2))
    total[cells["cell"].to_numpy(np.int64)] = cells["value"]
    total = total.reshape(FEATURES + 1, FEATURES + 2)
    if not total.any():
        return described.select("doc_id", F.lit(0.5).alias("score"))
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    none = np.zeros(0)
    raw = labelled.filter(calibrate).mapInArrow(_scored(mean, scale, weights, none, none), "doc_id long, score double").join(known, "doc_id")
    bins = raw.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.avg("score").alias("value"), F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").toArrow().to_pandas()
    steps, levels = isotonic(bins["value"].to_numpy(float), bins["n"].to_numpy(float), bins["ones"].to_numpy(float)) if len(bins) else (none, none)
    return described.mapInArrow(_scored(mean, scale, weights, steps, levels), "doc_id long, score double")


@query("op5_quality_classifier")
def op5(spark, sf):
    part = crc_part(4)
    out = classify(table(spark, sf, "documents"), table(spark, sf, "labels"), part.isin(0, 1), part == 3)
    return out.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
