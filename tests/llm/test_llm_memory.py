"""What a slice of text takes in memory, and that slices change no result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from claimgrid.llm import flat, ngram_lm, suffix


def texts(n, seed=5):
    rnd = np.random.default_rng(seed)
    words = np.array([f"W{i}x" for i in range(3000)])
    return [" ".join(words[rnd.integers(0, 3000, 700)]) for _ in range(n)]


def peak(work):
    flat._POWERS.clear()
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tokens_of_a_block_take_little_more_than_their_hashes():
    raw = [t.encode() for t in texts(1200)] + [b"", b" ", "ÄÖ ü".encode()]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    (hashes, first), most = peak(lambda: ngram_lm.tokens(data, off))
    assert len(data) > 4 << 20 and most < 12 * len(data)
    whole, at = ngram_lm._tokens(data, off)
    assert (hashes == whole).all() and (first == at).all()
    none, at = ngram_lm.tokens(data[:0], np.zeros(1, np.int64))
    assert len(none) == 0 and at.tolist() == [0]


def test_survey_takes_memory_by_the_slice():
    rows = texts(1200)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "key", "text"])
    out, most = peak(lambda: [b.num_rows for b in suffix._survey(400, 200)(iter([batch]))])
    assert sum(out) == len(rows) and most < 24 * sum(map(len, rows))
