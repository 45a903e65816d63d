"""What Python workers hold between groups and tasks. Workers are used again, so they hand back what freed tables took."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa

#: Bytes of tables after which a worker hands memory back.
HAND_BACK = 64 << 20
_seen = [0]


def hand_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def passed(size: int) -> None:
    """Count ``size`` bytes as read and hand memory back after every ``HAND_BACK`` of them."""
    _seen[0] += size
    if _seen[0] >= HAND_BACK:
        _seen[0] = 0
        hand_back()


def frugal(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` on one group, handing memory back now and then."""
    @functools.wraps(run)
    def group(rows: pa.Table) -> pa.Table:
        passed(rows.nbytes)
        return run(rows)

    return group
