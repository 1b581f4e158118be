"""Prefix trie of conversations: the nodes that conversations share, packed into double arrays by prefix shard.

A turn is named by a digest of its role and text, a sequence of turns by a chained digest, 128 bits of SHA-256 each.
Conversations with the same sequence are one row before anything is built. Sequences are dealt by a prefix: the first
turn, or 2, 4, 8 ... turns where more than ``SHARD`` turns share the shorter prefix. A task packs the tails of its
shards into one double array: a slot for each node, the child of slot ``p`` under the dense turn id ``t`` at
``BASE[p] + t``, which is occupied by that child if ``CHECK`` names ``p`` there. Walking all sequences through it gives
the slots, whose aggregates are summed upwards. Nodes on the prefix of a shard can be shared by several shards; these
are merged by digest over all shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrid.llm.tables import DEAL, grouped, query, table, written

SHARD, PACK, ID_BLOCK = 1 << 10, 1 << 18, 4096
TRIES, TRY_CELLS = 64, 1 << 14
NAME = 16
ROOT = b"\0" * NAME
NOTHING = sha256(b"").hexdigest()


# ---- the double array -----------------------------------------------------------------------------------------------

class DoubleArray:
    """Sequences of labels as a trie in two arrays. Slots 0 .. roots - 1 are the roots, one for each shard. Dense ids are
    given to labels in the order in which the levels meet them, so that siblings lie close together."""

    def __init__(self, roots: int):
        self.roots = roots
        self.base = np.zeros(roots, np.int64)
        self.check = np.full(roots, -1, np.int64)
        self.used = np.ones(roots, bool)
        self.free_from = roots

    def _reach(self, end: int) -> None:
        have = len(self.used)
        if end > have:
            more = max(end, have + have // 2 + 1024) - have
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
            self.used = np.append(self.used, np.zeros(more, bool))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        free = np.flatnonzero(~self.used[self.free_from:]) + self.free_from
        if len(free) < n:
            have = len(self.used)
            self._reach(have + n - len(free))
            free = np.append(free, np.arange(have, have + n - len(free)))
        return free[:n]

    def _take(self, parents: np.ndarray, slots: np.ndarray) -> None:
        self.used[slots] = True
        self.check[slots] = parents
        while self.free_from < len(self.used) and self.used[self.free_from]:
            ahead = self.used[self.free_from: self.free_from + 4096]
            step = np.flatnonzero(~ahead)
            self.free_from += int(step[0]) if len(step) else len(ahead)

    def _family(self, parent: int, labels: np.ndarray) -> None:
        """A base under which the slots of all labels are free: one of the first free slots, else behind all others."""
        free = self._free(max(1, min(TRIES, TRY_CELLS // len(labels))))
        slots = free[:, None] - labels[0] + labels[None, :]
        self._reach(int(slots.max()) + 1)
        fits = np.flatnonzero(~self.used[slots].any(axis=1))
        base = int(free[fits[0]] - labels[0]) if len(fits) else int(np.flatnonzero(self.used)[-1]) + 1 - int(labels[0])
        self._reach(base + int(labels[-1]) + 1)
        self.base[parent] = base
        self._take(np.full(len(labels), parent), base + labels)

    @staticmethod
    def pack(roots: int, root: np.ndarray, first: np.ndarray, labels: np.ndarray, kinds: int) -> tuple["DoubleArray", np.ndarray]:
        """``root`` of each sequence; its labels (below ``kinds``) are labels[first[i]: first[i + 1]]. Returns the arrays
        and the dense id of each label."""
        made = DoubleArray(roots)
        dense, met = np.full(kinds, -1, np.int64), 0
        slot, length, depth = root.astype(np.int64), np.diff(first), 0
        open_ = np.flatnonzero(length > 0)
        while len(open_):
            label = labels[first[open_] + depth]
            pair, back = np.unique(slot[open_] * kinds + label, return_inverse=True)
            parent, label = pair // kinds, pair % kinds
            new = np.flatnonzero(dense[label] < 0)
            names, at = np.unique(label[new], return_index=True)
            names = names[np.argsort(at)]
            dense[names] = met + np.arange(len(names))
            met += len(names)
            order = np.lexsort((dense[label], parent))
            parent, ids = parent[order], dense[label][order]
            edge = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            size = np.diff(np.append(edge, len(parent)))
            for a, n in zip(edge[size > 1].tolist(), size[size > 1].tolist()):
                made._family(int(parent[a]), ids[a: a + n])
            only = edge[size == 1]
            free = made._free(len(only))
            made.base[parent[only]] = free - ids[only]
            made._take(parent[only], free)
            depth += 1
            slot[open_] = (made.base[pair // kinds] + dense[pair % kinds])[back]
            open_ = open_[length[open_] > depth]
        return made, dense

    def step(self, slot: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The child of each slot under each dense id, -1 if there is none."""
        to = self.base[slot] + ids
        ok = (to >= self.roots) & (to < len(self.check))
        ok &= self.check[np.where(ok, to, 0)] == slot
        return np.where(ok, to, -1)


# ---- sequences ------------------------------------------------------------------------------------------------------

def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: array of (turn, name, chars), by turn (null first), turns of the same number by name."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, NAME)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), name.alias("name"), F.char_length(text).alias("chars"))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """The first h turns of conversation c - c % 100, then the own turns behind the first h; h = crc32(c) % 6."""
    shift = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    own = lists.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), shift.cast("int").alias("h"))
    heads = lists.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(heads, "base", "left").select("conv_id", turns.alias("turns"))


def _chained(names: list[bytes]) -> list[bytes]:
    out, last = [], ROOT
    for name in names:
        last = sha256(last + name).digest()[:NAME]
        out.append(last)
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each sequence, of its prefixes of 1, 2, 4, 8 ... turns, and its turns in two lists."""
    for batch in batches:
        turns = batch.column("turns")
        offsets = turns.offsets
        held = turns.flatten()
        at = (np.asarray(offsets) - np.asarray(offsets)[0]).astype(np.int32)
        names = held.field("name").to_pylist()
        whole, steps = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            chain = _chained(names[a:b])
            whole.append(chain[-1] if chain else ROOT)
            steps.append([chain[(1 << k) - 1] for k in range((b - a - 1).bit_length() if b > a else 0) if 1 << k < b - a])
        at = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(at, held.field("name")), pa.ListArray.from_arrays(at, held.field("chars")), pa.array(steps, pa.list_(pa.binary()))],
            ["conv_id", "whole", "names", "chars", "steps"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by sequence and block of ids; the digest of a sequence's ids grows as they pass, whatever their number."""
    last, state = None, sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for whole, ids in zip(batch.column("whole").to_pylist(), batch.column("ids").to_pylist()):
            if whole == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((last, state.hexdigest()))
            last, state = whole, sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["whole", "ends"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["whole", "ends"])


def ends_of(named: DataFrame) -> DataFrame:
    """whole, ends: SHA-256 of the ascending ids of the conversations with a sequence. Ids are put together in blocks of
    ID_BLOCK numbers first; a digest is made in order, so the blocks of one sequence pass through one task, a few at a time."""
    blocks = named.groupBy("whole", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return blocks.repartition("whole").sortWithinPartitions("whole", "block").select("whole", "ids").mapInArrow(_hashed_ids, "whole binary, ends string")


def sharded(sequences: DataFrame) -> DataFrame:
    """``shard`` and ``depth`` of each sequence: the shortest of its listed prefixes that SHARD turns or fewer share, else
    the whole sequence."""
    steps = F.concat(F.transform("steps", lambda s, i: F.struct(F.pow(F.lit(2), i).cast("int").alias("depth"), s.alias("shard"))), F.array(F.struct(F.size("names").alias("depth"), F.col("whole").alias("shard"))))
    each = sequences.select("whole", F.size("names").alias("turns"), F.explode(steps).alias("s")).select("whole", "turns", "s.depth", "s.shard")
    light = grouped(each, "shard").agg(F.sum("turns").alias("weight")).drop(DEAL).filter(F.col("weight") <= SHARD).withColumn("light", F.lit(True)).drop("weight")
    chosen = each.join(light, "shard", "left").groupBy("whole").agg(
        F.min(F.when(F.col("light"), F.struct("depth", "shard"))).alias("first"), F.max(F.struct("depth", "shard")).alias("last"))
    chosen = chosen.select("whole", F.coalesce("first", "last").alias("s")).select("whole", "s.depth", "s.shard")
    return sequences.drop("steps").join(chosen, "whole")


# ---- nodes of a pack of shards --------------------------------------------------------------------------------------

NODES = "own boolean, shard binary, name binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, ends string"


def _flat_names(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each different name once, as a number, and the number of each place."""
    raw = np.frombuffer(b"".join(names.to_pylist()), np.uint64).reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    new = np.ones(len(raw), bool)
    new[1:] = (raw[order][1:] != raw[order][:-1]).any(axis=1)
    out = np.empty(len(raw), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, new


def nodes(rows: pa.Table) -> pa.RecordBatch:
    """Rows ordered by shard, whole shards. ``own`` nodes belong to one shard alone and are final; for each node on the
    prefix of a shard what this shard holds of it."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).chunk(0) if rows.column(c).num_chunks else rows.column(c).combine_chunks()
    names, chars = column("names"), column("chars")
    offsets = np.asarray(names.offsets, np.int64) - np.asarray(names.offsets)[0]
    labels, new = _flat_names(names.flatten())
    all_chars = chars.flatten().to_numpy().astype(np.int64)
    depth, n, conv = (column(c).to_numpy().astype(np.int64) for c in ("depth", "n", "conv_id"))
    ends = column("ends").to_pylist()
    shard_names = column("shard").to_pylist()
    change = np.array([True] + [a != b for a, b in zip(shard_names[1:], shard_names)])
    shard = np.cumsum(change) - 1
    heads = np.flatnonzero(change)
    roots = len(heads)
    tail = np.diff(offsets) - depth
    place = np.repeat(offsets[:-1] + depth - (np.cumsum(tail) - tail), tail) + np.arange(int(tail.sum()))
    first = np.append(0, np.cumsum(tail))
    trie, dense = DoubleArray.pack(roots, shard, first, labels[place], int(new.sum()))
    ids, tail_chars = dense[labels[place]], all_chars[place]

    size = len(trie.check)
    count, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    level, text, end = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    slot, at, step = shard.copy(), np.arange(len(tail)), 0
    level[:roots] = depth[heads]
    np.add.at(count, slot, n)
    np.minimum.at(low, slot, conv)
    end[slot[tail == 0]] = np.flatnonzero(tail == 0)
    while True:
        at = at[tail[at] > step]
        if not len(at):
            break
        slot[at] = trie.step(slot[at], ids[first[at] + step])
        if (slot[at] < 0).any():
            raise AssertionError("a packed sequence is not found")
        np.add.at(count, slot[at], n[at])
        np.minimum.at(low, slot[at], conv[at])
        text[slot[at]] = tail_chars[first[at] + step]
        step += 1
        level[slot[at]] = depth[at] + step
        done = at[tail[at] == step]
        end[slot[done]] = done
    inner = np.flatnonzero(trie.used[roots:]) + roots
    parent = trie.check
    children = np.bincount(parent[inner], minlength=size)
    leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    leaves[inner] = children[inner] == 0
    saved[inner] = (count[inner] - 1) * text[inner]
    by_level = inner[np.argsort(-level[inner], kind="stable")]
    steps = np.flatnonzero(np.append(True, level[by_level][1:] != level[by_level][:-1])) if len(by_level) else []
    for a, b in zip(steps, np.append(steps[1:], len(by_level)).astype(int)):
        np.add.at(leaves, parent[by_level[a:b]], leaves[by_level[a:b]])
        np.add.at(saved, parent[by_level[a:b]], saved[by_level[a:b]])

    name_list = names.flatten().to_pylist()
    prefix = [_chained(name_list[offsets[h]: offsets[h] + depth[h]]) for h in heads]
    up = np.repeat(np.arange(roots), depth[heads])  # the shard of each prefix node
    on = np.concatenate([np.arange(1, depth[h] + 1) for h in heads]) if roots else np.zeros(0, np.int64)
    last = on == depth[heads][up]
    prefix_chars = all_chars[offsets[heads][up] + on - 1]
    flat_prefix = [x for chain in prefix for x in chain]
    parents = [x for chain in prefix for x in [ROOT, *chain[:-1]]]
    finish = lambda s: [ends[e] if e >= 0 else None for e in end[s].tolist()]
    none = [None] * len(inner)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(np.ones(len(inner), bool), np.zeros(len(up), bool))),
         pa.array(none + [shard_names[heads[u]] for u in up.tolist()], pa.binary()), pa.array(none + flat_prefix, pa.binary()), pa.array(none + parents, pa.binary()),
         pa.array(np.append(level[inner], on).astype(np.int32)), pa.array(np.append(low[inner], low[up])), pa.array(np.append(low[parent[inner]], np.zeros(len(up), np.int64))),
         pa.array(np.append(count[inner], count[up])), pa.array(np.append(children[inner], np.where(last, children[up], 0))), pa.array(np.append(leaves[inner], leaves[up])),
         pa.array(np.append(saved[inner], saved[up])), pa.array(np.append(text[inner], prefix_chars)),
         pa.array(finish(inner) + [e if is_last else None for e, is_last in zip(finish(up), last.tolist())], pa.string())],
        [c.split()[0] for c in NODES.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard; whole shards are packed together until they hold PACK turns."""
    held: list[pa.RecordBatch] = []
    met = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.array(batch.column("shard").to_pylist(), object)
        turns = np.diff(np.asarray(batch.column("names").offsets))
        edges = (np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()
        if held and held[-1].column("shard")[-1].as_py() != names[0]:
            edges = [0, *edges]
        low = 0
        for edge in edges:
            met += int(turns[low:edge].sum())
            if met >= PACK:
                if edge > low:
                    held.append(batch.slice(low, edge - low))
                yield nodes(pa.Table.from_batches(held))
                held, met = [], 0
                low = edge
            else:
                if edge > low:
                    held.append(batch.slice(low, edge - low))
                low = edge
        if low < batch.num_rows:
            held.append(batch.slice(low))
            met += int(turns[low:].sum())
    if held:
        yield nodes(pa.Table.from_batches(held))


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Input: conv_id, turn, role, text; other columns are ignored. Null roles and texts are empty. Turns with the same
    number go by the digest of role and text; repeated rows are repeated turns. Rows without conv_id are left out. An
    empty table has no node, not even the root. The names of the turns of one conversation (20 bytes each) must fit
    into a task, its texts need not.
    """
    named = written(rebuilt(turn_lists(conversations)).mapInArrow(_named, "conv_id long, whole binary, names array<binary>, chars array<int>, steps array<binary>"), "trie-sequences")
    ends = ends_of(named)
    first = F.min(F.struct("conv_id", "names", "chars", "steps")).alias("s")
    sequences = named.filter("size(names) > 0").groupBy("whole").agg(F.count("*").alias("n"), first).select("whole", "n", "s.*").join(ends, "whole")
    packed = sharded(written(sequences, "trie-distinct")).repartition("shard").sortWithinPartitions("shard")
    parts = written(packed.mapInArrow(_packed, NODES), "trie-nodes")

    mine = parts.filter("own").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends")
    shared = parts.filter("not own")
    merged = grouped(shared, "name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("low"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"), F.max("ends").alias("ends")).drop(DEAL)
    merged = written(merged, "trie-shared")
    below = grouped(merged, "parent").agg(F.count("*").alias("more")).drop(DEAL).select(F.col("parent").alias("name"), "more")
    merged = merged.join(below, "name", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    # a node's text and its leaf count once: for the shard that holds its smallest member
    chain = shared.select("shard", "name", "depth", "conv_id", "n_convs", "n_leaves", "saved", "chars").join(merged.select("name", "low", "n_children"), "name")
    down = Window.partitionBy("shard").orderBy(F.desc("depth"))
    speaks = F.when(F.col("conv_id") == F.col("low"), 1).otherwise(0)
    sums = chain.select("name", (F.col("n_leaves") + F.sum(F.when(F.col("n_children") == 0, speaks).otherwise(0)).over(down)).alias("leaves"),
                        (F.col("saved") + F.sum((F.col("n_convs") - speaks) * F.col("chars")).over(down)).alias("saved")).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    shared = written(merged.join(sums, "name"), "trie-merged")
    top = shared.filter("depth = 1").agg(F.min("low").alias("low"), F.sum("n_convs").alias("n"), F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    bare = named.filter("size(names) = 0").agg(F.min("conv_id").alias("low"), F.count("*").alias("n")).first()
    bare_ends = ends.filter(F.col("whole") == F.lit(ROOT)).first() if bare.n else None
    lows = [x for x in (top.low, bare.low) if x is not None]
    root = [(min(lows), 0, None, (top.n or 0) + bare.n, top.kids, top.leaves or 1, top.saved or 0, bare_ends.ends if bare_ends else None)] if lows else []
    layout = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
    up = shared.select(F.col("name").alias("parent"), F.col("low").alias("parent_low"))
    outer = shared.join(up, "parent", "left").select(F.col("low").alias("conv_id"), "depth", F.coalesce("parent_low", F.lit(min(lows) if lows else None)).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    out = mine.unionByName(outer).unionByName(conversations.sparkSession.createDataFrame(root, layout))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


@query("op12_conversation_prefix_trie", r"""
with crc_table as (
    select list(v order by i) as crc from (select i, list_reduce(list_prepend(i, range(8)), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from (select unnest(range(256)) as i))),
lists as (
    select conv_id, list(name order by turn nulls first, name) as names, list(chars order by turn nulls first, name) as chars
    from (select conv_id, turn, left(sha256(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')), 32) as name, length(coalesce(text, '')) as chars
        from conversations where conv_id is not null) group by conv_id),
shifts as (
    select conv_id, names, chars, conv_id - conv_id % 100 as base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(unicode(c) as bigint))),
            lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 as h
    from lists, crc_table),
rebuilt as (
    select s.conv_id, list_concat(coalesce(b.names, [])[1:s.h], s.names[s.h + 1:]) as names, list_concat(coalesce(b.chars, [])[1:s.h], s.chars[s.h + 1:]) as chars
    from shifts s left join lists b on b.conv_id = s.base),
steps as (
    select conv_id, depth, case when depth > 0 then chars[depth] else 0 end as chars, depth = len(names) as ends,
        sha256(array_to_string(names[1:depth], ' ')) as node, case when depth > 0 then sha256(array_to_string(names[1:depth - 1], ' ')) end as parent
    from (select *, unnest(range(0, len(names) + 1)) as depth from rebuilt)),
tops as (
    select node, depth, parent, min(conv_id) as low, count(*) as n_convs, any_value(chars) as chars,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
    from steps group by node, depth, parent),
kids as (select parent, count(*) as n from tops where parent is not null group by parent),
sums as (
    select s.node, sum(case when t.low <> s.conv_id then s.chars else 0 end) over (partition by s.conv_id order by s.depth desc) as saved,
        sum(case when t.low = s.conv_id and k.n is null then 1 else 0 end) over (partition by s.conv_id order by s.depth desc) as leaves
    from steps s join tops t using (node) left join kids k on k.parent = s.node)
select t.low as conv_id, t.depth, p.low as parent_conv_id, t.n_convs, coalesce(k.n, 0) as n_children, cast(a.leaves as bigint) as n_leaves, cast(a.saved as bigint) as saved_tokens, t.ends_sha256
from tops t left join tops p on p.node = t.parent left join kids k on k.parent = t.node join (select node, sum(saved) as saved, sum(leaves) as leaves from sums group by node) a on a.node = t.node
""")
def op12(spark, sf):
    return trie(table(spark, sf, "conversations"))
