"""Connected components of a table of links, by alternating large-star and small-star steps.

A table of at most FEW links, a constant, is finished by one task instead of in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.tables import DEAL, grouped, written


FEW = 1 << 17


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest node of each component, for links that fit in one task: labels go along the links and are shortened."""
    rows = pa.Table.from_batches(list(batches))
    if rows.num_rows:
        node, at = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
        a, b = at[: rows.num_rows], at[rows.num_rows:]
        label = np.arange(len(node))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for end in (a, b, label[a], label[b]):
                np.minimum.at(new, end, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "label"])


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = grouped(both, "a").agg(F.least(F.col("a"), F.min("b")).alias("low")).drop(DEAL)
    return both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    lowest = grouped(down, "a").agg(F.min("b").alias("low")).drop(DEAL)
    return (down.join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(lowest.select("a", F.col("low").alias("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node of its component.

    The table may name a link many times. The number of rounds is logarithmic for all practical graphs. Each round is written to the shared folder, and
    only its row count and checksum come to the driver. No node's neighbours are ever gathered.
    """
    links = written(_small(links), "links")
    last = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] <= FEW:
            return links.coalesce(1).mapInArrow(_finish, "node long, label long") if state[0] else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        if state == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        last = state
        links = written(_small(_large(links)), "links")
