"""Work arrays of a task."""

import tracemalloc

import numpy as np

from brindle.llm import substring_dedup


def test_cells_take_little_beside_themselves():
    h = np.arange(1 << 20, dtype=np.uint64) << np.uint64(40)
    tracemalloc.start()
    try:
        substring_dedup._cells(h, 0, 26)
        assert tracemalloc.get_traced_memory()[1] < h.nbytes
    finally:
        tracemalloc.stop()
