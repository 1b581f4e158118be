"""Chat formatting at the level of tokens, with a loss mask, and the way back from ids to turns.

A conversation becomes one sequence of ids::

    <s> ( [INST] role [/INST] text </s> )*

The four marks are reserved ids behind the vocabulary. Roles and texts are encoded apart from each other and from the
marks, so no token reaches over a boundary, and what stands in a text can never become a reserved id. Marks that occur
in a text are escaped besides, so that the rendered text can be cut at its marks as well: one more backslash is put
behind the first character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which is undone by taking one
away. All marks start with ``<`` or ``[`` and hold these nowhere else, so a mark can't arise across a boundary either.

Positions of the segments come from prefix sums over their lengths; the loss mask is the prefix sum of +1 where the text
of an assistant starts and -1 behind the mark that ends it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.llm.tables import query, table

# fixed values: the marks of the template, and how byte-level BPE cuts a text into pieces
MARKS = ["<s>", "[INST]", "[/INST]", "</s>"]
BEGIN, ROLE, TEXT, END = range(4)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LEARNT_ROLE = "assistant"
SEGMENT = 20_000  # longer texts are encoded in pieces, as the pattern recurses over runs of white space
SLICE_BYTES = 4 << 20

_MARK = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")
_OPENED: dict[str, "Vocabulary"] = {}


def escaped(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Vocabulary:
    """Byte-level BPE from a file of ranks; the marks have the ids behind the last rank."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.coder = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        pieces = [b""] * (self.first + len(MARKS))
        for piece, rank in ranks.items():
            pieces[rank] = piece
        pieces[self.first:] = [m.encode() for m in MARKS]
        self.size = np.array([len(p) for p in pieces])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    @staticmethod
    def open(path: str) -> "Vocabulary":
        if path not in _OPENED:
            _OPENED[path] = Vocabulary(path)
        return _OPENED[path]

    def encode(self, text: str) -> list[int]:
        if len(text) <= SEGMENT:
            return self.coder.encode_ordinary(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            end = at + SEGMENT
            space = text.rfind(" ", at + 1, end) if end < len(text) else -1
            end = space if space > 0 else end
            out += self.coder.encode_ordinary(text[at:end])
            at = end
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where those of each start."""
        size = self.size[ids]
        to = np.cumsum(size) - size
        place = np.repeat(self.start[ids] - to, size) + np.arange(int(size.sum()))
        return self.bytes[place].tobytes(), np.append(to, size.sum())


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns: array of (turn, role, text), by turn (null first), then role and text. Null roles and texts
    are empty; repeated rows are turns of their own."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whole conversations of about SLICE_BYTES together."""
    turns = batch.column("turns")
    size = pc.binary_length(turns.flatten().field("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.asarray(turns.offsets, np.int64)
    ends = np.append(0, np.cumsum(size))[offsets - offsets[0]]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(low, min(high, batch.num_rows) - low)
        low = high


def assemble(counts: np.ndarray, roles: list[str], texts: list[str], vocabulary: Vocabulary, learnt: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of all conversations one after the other, and where each starts; ``counts``: turns of each."""
    known: dict[str, list[int]] = {}
    parts: list[list[int]] = []
    for role, text in zip(roles, texts):
        if role not in known:
            known[role] = vocabulary.encode(escaped(role))
        parts += (known[role], vocabulary.encode(escaped(text)))
    length = np.array([len(p) for p in parts], np.int64).reshape(-1, 2)
    first_turn = np.cumsum(counts) - counts
    conversation = np.repeat(np.arange(len(counts)), counts)
    begins = np.zeros(len(roles), np.int64)
    begins[first_turn[counts > 0]] = 1
    size = length.sum(axis=1) + 3  # three marks a turn
    at = np.cumsum(size) - size + conversation + 1  # where the turn starts; every conversation starts with a mark
    total = int(size.sum()) + len(counts)
    text_at = at + length[:, 0] + 2
    end_at = text_at + length[:, 1]
    ids = np.empty(total, np.int32)
    starts = np.append(0, np.cumsum(np.bincount(conversation, size, len(counts)).astype(np.int64) + 1))
    ids[starts[:-1]] = vocabulary.first + BEGIN
    ids[at], ids[text_at - 1], ids[end_at] = vocabulary.first + ROLE, vocabulary.first + TEXT, vocabulary.first + END
    begin, n = np.column_stack([at + 1, text_at]).ravel(), length.ravel()
    place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    ids[place] = np.fromiter((i for p in parts for i in p), np.int32, int(n.sum()))
    edge = np.zeros(total + 1, np.int32)
    learns = np.array([r == learnt for r in roles], bool)
    edge[text_at[learns]] += 1
    edge[end_at[learns] + 1] -= 1
    return ids, np.cumsum(edge[:-1]).astype(bool), starts


def _format(path: str, learnt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.open(path)
        for batch in batches:
            for rows in _slices(batch):
                turns = rows.column("turns")
                held = turns.flatten()
                ids, mask, starts = assemble(np.diff(np.asarray(turns.offsets)), held.field("role").to_pylist(), held.field("text").to_pylist(), vocabulary, learnt)
                starts = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("conv_id"), pa.ListArray.from_arrays(starts, pa.array(ids)), pa.ListArray.from_arrays(starts, pa.array(mask))], ["conv_id", "input_ids", "loss_mask"])

    return run


FORMATTED = "conv_id long, input_ids array<int>, loss_mask array<boolean>"


def format_chat(turns: DataFrame, vocabulary: str = VOCABULARY, learnt: str = LEARNT_ROLE) -> DataFrame:
    """conv_id, input_ids, loss_mask: one sequence for each conversation.

    Input: conv_id, turn, role, text; other columns are ignored. Turns go by turn (null first), then role and text; null
    roles and texts are empty, an empty text has no ids of its own; repeated rows are repeated turns; a null conv_id is a
    conversation of its own; an empty table gives no rows. Texts over SEGMENT characters are encoded in pieces cut before
    a space where there is one. The mask covers the texts of ``learnt`` and the mark that ends each. One sequence is one
    row, so a conversation must fit into a task; conversations are formatted by slices of some MB.
    """
    return conversations(turns).mapInArrow(_format(vocabulary, learnt), FORMATTED)


def turns_of(ids: np.ndarray, mask: np.ndarray, vocabulary: Vocabulary) -> tuple[list[tuple[str, str, bool]], str]:
    """(role, text, learnt) of each turn of one sequence, and the sequence as it reads."""
    data, at = vocabulary.decode(ids)
    marks = np.flatnonzero(ids >= vocabulary.first)
    kind = ids[marks] - vocabulary.first
    segment = lambda a, b: data[at[a + 1]: at[b]].decode()  # noqa: E731  between two marks
    found, k = [], 1
    while k < len(marks):
        if kind[k: k + 3].tolist() != [ROLE, TEXT, END]:
            raise ValueError("not a sequence of turns")
        role, text, end = marks[k: k + 3].tolist()
        found.append((unescaped(segment(role, text)), unescaped(segment(text, end)), bool(mask[text + 1: end].all() and mask[end])))
        k += 3
    return found, data.decode()


def _read(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.open(path)
        for batch in batches:
            ids, masks = batch.column("input_ids"), batch.column("loss_mask")
            out: list[tuple] = []
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                seq, mask = ids[i].values.to_numpy(), masks[i].values.to_numpy(zero_copy_only=False)
                turns, whole = turns_of(seq, mask, vocabulary)
                learnt = "".join(unescaped(t) for t in _runs(seq, mask, vocabulary))  # by the mask alone
                out.append((conv, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), len(whole)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), READ_TYPES)] if out else [pa.array([], t) for t in READ_TYPES], READ_NAMES)

    return run


def _runs(ids: np.ndarray, mask: np.ndarray, vocabulary: Vocabulary) -> Iterator[str]:
    """The texts under the mask: runs of masked ids between marks."""
    open_ = mask & (ids < vocabulary.first)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield vocabulary.decode(ids[a:b])[0].decode()


READ_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
READ_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of what stands in the sequences: turns, texts under the mask, and the length of the rendered text."""
    return formatted.mapInArrow(_read(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


@query("op13_chat_formatting", r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(3 + sum(17 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))) as bigint) as formatted_chars
from t group by conv_id
""")
def op13(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(turns.unionByName(probe)))
