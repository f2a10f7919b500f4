"""What tasks pass on to each other, whichever rows they hold."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from rankwright.llm import substring

SPEC = substring.RepeatSpec(window=6, block=3)


def _batch(rows):
    docs, texts, bases = zip(*rows)
    bases = pa.array([[(substring.hashlib.sha256(t.encode()).hexdigest(), b)] for t, b in zip(texts, bases)], pa.map_(pa.string(), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts), bases], ["doc_id", "text", "bases"])


def _hits(tasks):
    """(doc, place) found by tasks that hold the given rows, and the range that all their hashes meet in."""
    dealt = [b for rows in tasks for b in substring._probe(SPEC, 1)(iter([_batch(rows)]))]
    table = pa.Table.from_batches(dealt)
    ready = [(d, p) for d, p in zip(table["doc_id"].to_pylist(), table["settled"].to_pylist()) if d is not None]
    near = table.filter(pa.compute.is_valid(table["range"])).combine_chunks().to_batches()
    found = [r for b in substring._meet(True)(iter(near)) for r in zip(b["doc_id"].to_pylist(), b["settled"].to_pylist())]
    return {(d, int(x)) for d, p in ready + found for x in np.frombuffer(p, np.int32)}


@pytest.mark.parametrize("order", list(itertools.permutations([(5, 0), (3, 0), (5, 100), (3, 200)])))
def test_rows_of_one_document_in_several_tasks(order):
    rows = [(doc, f"a{doc}x{base} b c one two three four five six", base) for doc, base in order]
    every = {(doc, base + k) for doc, base in order for k in (3, 6)}  # the blocks that are indexed
    for cut in range(1, 4):
        assert _hits([rows[:cut], rows[cut:]]) >= every


def test_hashes_of_windows_keep_all_bits():
    hashes = np.sort(np.random.default_rng(1).integers(0, 2**64, 100, dtype=np.uint64))
    assert (substring._unpacked(substring._packed(hashes, 8), 100, 8) == hashes).all()
    assert (substring._unpacked(substring._packed(hashes, 6), 100, 6) == hashes % np.uint64(2**48)).all()
