"""Arrow batches of texts in slices of bounded size."""

from collections.abc import Iterator

import numpy as np

#: Text of a slice, in bytes; a longer text is a slice of its own.
SLICE = 2_000_000


def slices(batches: Iterator, column: str = "text", size: int = SLICE) -> Iterator:
    """The rows of all batches, in order, in slices whose texts have about size bytes at most."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            # A copy: some kernels misread arrays that begin inside a larger one.
            yield batch.take(pa.array(np.arange(a, b)))
            a = b
    release()


def release() -> None:
    """Gives what this worker no longer needs back to the system, as it may wait long for its next task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
