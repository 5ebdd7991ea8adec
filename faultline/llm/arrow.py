"""Arrow batches in small pieces, so that what Python holds at a time stays small."""

from __future__ import annotations

import ctypes

ROWS = 512


def trim() -> None:
    """Give freed memory back to the system, where the C library can (workers live on between tasks)."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def pieces(batches, rows: int = ROWS):
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    trim()
