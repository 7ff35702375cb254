"""Memory of Python workers that hold many values of all sizes for a short time."""

from __future__ import annotations

import ctypes

import pyarrow as pa

M_MMAP_THRESHOLD, APART = -3, 256 << 10


def steady_heap() -> None:
    """Blocks of ``APART`` bytes or more are mapped apart and given back once they are free.

    By itself glibc raises that size, up to 32 MB, whenever such a block is freed; later ones then lie among small ones on a heap that
    grows with all that a worker has ever seen. Arrow's own pool keeps freed blocks in the same way. Other C libraries are left as they are.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(M_MMAP_THRESHOLD, APART)
