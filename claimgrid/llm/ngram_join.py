"""N-gram Jaccard join by grouped prefixes.

Shingles are ordered by their hash. Documents that link share at least ``m`` shingles among the first
``n - ceil(t * n) + m`` of each, so a document with fewer than that many of these shingles standing in other documents
has no links. What is left is ordered again, rarest first, and cut to the shingles of which one must be shared: the
prefix. Documents of the same size and prefix form one group; groups that share a prefix shingle, with sizes that
allow a link, are brought together; then the groups are expanded and their members verified on whole sets.

A cluster of groups can be large without holding a link, as where a line that thousands of documents share makes up
much of short ones. Such clusters are first taken apart by parity sketches: bit h of a sketch tells whether an odd
number of shingles has hash h, so two sketches differ in no more bits than the sets differ in shingles. Blocks of
sketches, by bands of sizes, return only what connects the documents whose sketches allow a link.

Verification runs in blocks of bounded size. In a large cluster the most typical document is compared with all
others first. Those that link with it are settled: they are in one component, so only pairs with an unsettled
document are left, and each task returns no more links than it needs to connect its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrid.llm import flat
from claimgrid.llm.components import components
from claimgrid.llm.substring import SECOND
from claimgrid.llm.tables import DEAL, grouped, keyed, named, plain_id, query, table, written

BLOCK = 400
SKETCH_BITS, SKETCH_BLOCK = 1024, 2048


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of ``n`` shares at least with any set it links with."""
    return -(-n * percent // 100)


def spare(n: np.ndarray) -> np.ndarray:
    return n // 20 + 1


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer than ``k`` words are one shingle."""
    data = flat.lower_ascii(data)
    starts, ends, first = flat.words(data, off)
    prefix = flat.prefix_hash(flat.word_hashes(data, starts, ends), flat.BASE)
    at = np.arange(max(0, len(starts) - k + 1))
    hashes = flat.stretch_hash(prefix, at, at + k, flat.BASE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if 0 < b - a < k:
            out.append(flat.stretch_hash(prefix, np.array([a]), np.array([b]), flat.BASE) ^ np.uint64(b - a))
        else:
            out.append(np.unique(hashes[a: max(a, b - k + 1)]))
    return out


def _survey(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                sets = shingle_sets(data, off, k)
                n = np.array([len(s) for s in sets])
                h1 = np.array([np.add.reduce(flat.mix(s)) for s in sets], np.uint64)
                h2 = np.array([np.add.reduce(flat.mix(s ^ SECOND)) for s in sets], np.uint64)
                first = n - least_overlap(n, percent) + np.minimum(spare(n), least_overlap(n, percent))
                head = [s[:p] for s, p in zip(sets, first.tolist())]
                sketch = [np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in head])).astype(np.int32)), pa.array(np.concatenate(head).view(np.int64))), pa.array(sketch, pa.binary())],
                    ["doc_id", "key", "n", "h1", "h2", "first", "sketch"])

    return run


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in flat.slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [rows.column("node"), rows.column("cluster"), rows.column("members"), rows.column("centre"), pa.array([s.tobytes() for s in shingle_sets(data, off, k)], pa.binary())],
                    ["node", "cluster", "members", "centre", "shingles"])

    return run


def _linked(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def _allowed(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of a block whose sketches allow a link, as links that connect the same documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node, n, own = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()
        bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(node), -1)
        apart = rows["p"].iloc[0] != rows["q"].iloc[0]
        label = np.arange(len(node))
        a, b = [], []
        for i in range(len(node) - 1):
            later = slice(i + 1, None)
            total = n[i] + n[later]
            differ = np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1, dtype=np.int64)
            ok = (differ <= total - 2 * -(-percent * total // (100 + percent))) & (label[later] != label[i])
            if apart:
                ok &= own[later] != own[i]
            found = np.flatnonzero(ok) + i + 1
            if len(found):
                joined, first = np.unique(label[found], return_index=True)
                a += [node[i]] * len(joined)
                b += node[found[first]].tolist()
                label[np.isin(label, np.append(joined, label[i]))] = min(label[i], joined[0])
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def _against_typical(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for one, other in zip(rows.column("shingles").to_pylist(), rows.column("centre_shingles").to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(bool(_linked(both, len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("cluster"), rows.column("shingles"), rows.column("centre"), pa.array(out, pa.bool_())], ["node", "cluster", "shingles", "centre", "settled"])

    return run


def _verify(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All pairs of a bounded block through shared shingles; returns links that connect what is linked."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = int(column.max()) + 1 if len(column) else 0
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, width, 4096):  # dense strips keep the matrix small
            a, b = np.searchsorted(column, (low, low + 4096))
            strip = np.zeros((len(sets), 4096), np.float32)
            strip[owner[a:b], column[a:b] - low] = 1
            both += strip @ strip.T
        i, j = np.nonzero(np.triu(_linked(both.astype(np.int64), size[:, None], size[None, :], percent), 1))
        root = list(range(len(sets)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keep = []
        for p, q in zip(i.tolist(), j.tolist()):
            x, y = top(p), top(q)
            if x != y:
                root[max(x, y)] = min(x, y)
                keep.append((p, q))
        a, b = np.array([p for p, _ in keep], np.int64), np.array([q for _, q in keep], np.int64)
        return pd.DataFrame({"a": node[a], "b": node[b]}, dtype="int64")

    return run


def survey(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, key, n, node (names the set of shingles), the first shingles in the order of hashes, and the sketch."""
    seen = keyed(docs).mapInArrow(_survey(k, percent), "doc_id long, key long, n long, h1 long, h2 long, first array<long>, sketch binary")
    return seen.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.xxhash64("h1", "h2", "n")).alias("node"), "first", "sketch")


def bands(percent: int) -> Column:
    """Sizes that can link lie in one band of sizes or in two neighbouring ones; a document is in its own and the next."""
    width = -1.001 * float(np.log(percent / 100))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")
    return F.array(band, band + 1)


def _sized(placed: DataFrame) -> DataFrame:
    """Adds the number of members of a cluster and its centre, where there are two at least."""
    sizes = grouped(placed, "cluster").agg(F.count("*").alias("members"), F.max(F.struct("typical", "node")).alias("centre")).drop(DEAL).filter("members > 1")
    return placed.join(sizes.select("cluster", "members", F.col("centre.node").alias("centre")), "cluster")


def taken_apart(large: DataFrame, percent: int) -> DataFrame:
    """large: node, cluster, typical, n, sketch. The same without sketches, with clusters that their sketches connect."""
    lists = large.select("node", "cluster", "n", "sketch", F.explode(bands(percent)).alias("band"))
    counts = grouped(lists.select("cluster", "band"), "cluster", "band").agg(F.ceil(F.count("*") / SKETCH_BLOCK).cast("int").alias("blocks"), F.count("*").alias("k")).drop(DEAL).filter("k > 1")
    own = lists.join(counts, ["cluster", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) as p, greatest(x, own) as q))")
    dealt = own.withColumn("m", F.explode(meets)).select("cluster", "band", "node", "n", "sketch", "own", "m.p", "m.q")
    pairs = written(dealt.groupBy("cluster", "band", "p", "q").applyInPandas(_allowed(percent), "a long, b long"), "join-allowed")
    return large.select("node", "typical", "doc_id", "key").join(components(pairs), "node").withColumnRenamed("label", "cluster")


def clusters(seen: DataFrame, percent: int = 90) -> DataFrame:
    """node, cluster, members, centre, doc_id, key: documents, one for each set, that may be linked through others of
    their cluster. ``centre``: the node of which most first shingles stand in other documents too."""
    heads = grouped(seen.filter("node is not null"), "node").agg(F.min(F.struct("doc_id", "key")).alias("head"), F.max("n").alias("n")).drop(DEAL)
    sizes, heads = heads.select("node", "n"), heads.drop("n")
    sets = seen.join(heads, "node").filter("doc_id = head.doc_id and key = head.key")
    at = sets.select("node", F.explode("first").alias("shingle"))
    # dealt by one more bit, like ``grouped``, which costs nothing in the shuffle; the size is joined to the lists, not sent with every shingle
    found = at.groupBy("shingle", F.pmod("shingle", F.lit(2)).alias(DEAL)).count().drop(DEAL).filter("count > 1")
    smallest = F.ceil(F.col("n") * percent / 100)
    need = F.floor(smallest / 20) + 1  # shingles shared even with the smallest possible partner
    shared = at.join(found, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("shared")).join(sizes, "node").filter(F.size("shared") >= need)
    prefix = written(shared.select("node", "n", F.size("shared").alias("typical"), F.slice("shared.shingle", F.lit(1), (F.size("shared") - need + 1).cast("int")).alias("prefix")), "join-prefixes")
    groups = prefix.select("node", "n", "prefix", F.xxhash64("n", "prefix").alias("grp"))
    members = groups.select("node", "grp")
    entries = written(groups.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "join-groups").select("grp", "n", F.explode("prefix").alias("shingle"))
    lists = entries.select("grp", "shingle", F.explode(bands(percent)).alias("band"))
    lowest = grouped(lists, "shingle", "band").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low < high").select("shingle", "band", "low")
    pairs = lists.join(lowest, ["shingle", "band"]).filter("grp <> low").select(F.col("grp").alias("a"), F.col("low").alias("b")).distinct()
    labels = components(pairs)
    kept = members.join(labels.withColumnRenamed("node", "grp"), "grp", "left").select("node", F.coalesce("label", "grp").alias("cluster"))
    placed = written(kept.join(prefix.select("node", "typical"), "node").join(heads, "node").select("node", "cluster", "typical", "head.doc_id", "head.key"), "join-clusters")
    found = written(_sized(placed), "join-members")
    columns = ["node", "cluster", "members", "centre", "doc_id", "key"]
    if found.filter(F.col("members") > BLOCK).isEmpty():
        return found.select(*columns)
    large = found.filter(F.col("members") > BLOCK).drop("members", "centre").join(seen.select("doc_id", "key", "n", "sketch"), ["doc_id", "key"]).dropDuplicates(["node"])
    apart = _sized(written(taken_apart(written(large, "join-large"), percent), "join-apart"))
    return written(found.filter(F.col("members") <= BLOCK).select(*columns).unionByName(apart.select(*columns)), "join-found")


def links(docs: DataFrame, found: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(a, b): verified links between sets that connect all that are linked."""
    texts = keyed(docs).join(found.filter("members > 1").hint("shuffle_hash"), ["doc_id", "key"])
    sets = written(texts.mapInArrow(_sets(k), "node long, cluster long, members long, centre long, shingles binary"), "join-sets")
    out = "a long, b long"
    small = sets.filter(F.col("members") <= BLOCK).select("cluster", "node", "shingles").groupBy("cluster").applyInPandas(_verify(percent), out)
    large = sets.filter(F.col("members") > BLOCK)
    if large.select("node").isEmpty():
        return small
    centres = large.filter("node = centre").dropDuplicates(["node"]).select("centre", F.col("shingles").alias("centre_shingles"))
    tested = written(large.join(centres, "centre").mapInArrow(_against_typical(percent), "node long, cluster long, shingles binary, centre long, settled boolean"), "join-settled")
    stars = tested.filter("settled and node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    counts = grouped(tested, "cluster").agg(F.ceil(F.count_if("settled") / (BLOCK / 2)).cast("int").alias("calm"), F.ceil(F.count_if(~F.col("settled")) / (BLOCK / 2)).cast("int").alias("open")).drop(DEAL)
    dealt = tested.join(counts, "cluster").filter("open > 0")
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("settled"), F.greatest("calm", F.lit(1))).otherwise(F.greatest("open", F.lit(1)))).cast("int")
    placed = dealt.withColumn("own", spread)
    # an unsettled block meets every unsettled block and every settled one; settled blocks never meet each other
    with_open = F.expr("transform(sequence(0, open - 1), x -> case when settled then struct(x as p, own as q, true as s) else struct(least(x, own) as p, greatest(x, own) as q, false as s) end)")
    with_calm = F.expr("case when settled or calm = 0 then array() else transform(sequence(0, calm - 1), x -> struct(own as p, x as q, true as s)) end")
    meets = placed.select("cluster", "node", "shingles", F.explode(F.concat(with_open, with_calm)).alias("m")).select("cluster", "node", "shingles", "m.p", "m.q", "m.s")
    blocks = meets.groupBy("cluster", "p", "q", "s").applyInPandas(_verify(percent), out)
    return small.unionByName(stars).unionByName(blocks)


def resolved(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The surveyed documents, and (node, label) for the sets that are linked with others."""
    seen = written(survey(docs, k, percent), "join-survey")
    return seen, components(written(links(docs, clusters(seen, percent), k, percent), "join-links"))


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Components of documents whose sets of distinct ``k``-word shingles have a Jaccard similarity of ``percent``.

    Input: doc_id, text; other columns are ignored. Output: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, itself included). Words are lower-cased in A-Z only. A text of fewer than ``k`` words is one
    shingle; a null text or one without words is empty and linked with nothing. A null doc_id is reached last: the
    component of such documents alone has none. Repeated rows have equal sets and so one component.
    """
    seen, labels = resolved(docs, k, percent)
    placed = seen.select("doc_id", "n", "node").join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    lowest = grouped(placed.filter("part is not null"), "part").agg(F.min("doc_id").alias("low")).drop(DEAL)
    component = F.coalesce("low", "doc_id")
    return placed.join(lowest, "part", "left").select(plain_id(), F.col("n").alias("n_shingles"), F.when(component != (1 << 63) - 1, component).alias("component_id"))


def representatives(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns of docs. Documents without
    words stay, each once for its doc_id and text."""
    seen, labels = resolved(docs, k, percent)
    placed = seen.select("doc_id", "key", "node").join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    heads = placed.filter("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("head")).select("head.doc_id", "head.key")
    stay = heads.unionByName(placed.filter("part is null").select("doc_id", "key").distinct()).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    return named(docs).join(stay.hint("shuffle_hash"), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("row.*")


@query("op6_ngram_jaccard_join", r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) end) as sh from d),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
common as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
link as (select x, y from common where 100 * c >= 90 * (nx + ny - c)),
reach as (with recursive r(doc_id, comp) as (select doc_id, doc_id from s union select l.y, r.comp from r join link l on l.x = r.doc_id where r.comp < l.y) select * from r)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, min(comp) as component_id from s join reach using (doc_id) group by s.doc_id, len(sh)""")
def op6(spark, sf):
    return join(table(spark, sf, "documents"))
