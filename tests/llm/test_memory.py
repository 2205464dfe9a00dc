import tracemalloc

import numpy as np
import pyarrow as pa

from strandloom.llm import common
from strandloom.llm.common import Words, slices


def test_a_worker_holds_little_beside_its_text():
    """Six workers share an executor with its heap: tables of powers and arrays of a slice count for each of them."""
    text = "some words of a text, " * 400
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 2000, pa.string())], names=["text"])
    common._POWERS.clear()
    tracemalloc.start()
    for part in slices(batch, "text"):
        Words(part.column(0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20, most


def test_hashes_do_not_depend_on_segments(monkeypatch):
    """Words on either side of a segment's edge hash as they do on their own, and as in segments of another size."""
    texts = pa.array(["ab" * 9000 + " x", "one two", None, "one " * 90_000], pa.string())
    got = Words(texts)
    alone = Words(pa.array(["one"], pa.string())).hash[0]
    assert (got.hash[got.first[3] :] == alone).all() and got.hash[got.first[1]] == alone
    monkeypatch.setattr(common, "_SEGMENT", 1 << 20)
    common._POWERS.clear()
    assert np.array_equal(Words(texts).hash, got.hash)
