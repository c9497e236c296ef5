"""Arrow columns of texts in small pieces, so that a worker's Python objects don't follow the size of its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows of a piece.
PIECE = 1 << 20
PIECE_ROWS = 1024


def pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of columns of one length, of PIECE bytes of text or little more, unless one row is larger; one empty slice of empty columns."""
    texts = [c for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    size = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(len(columns[0]), dtype=np.int64)))
    at = 0
    while at < len(size) or at == 0:
        before = size[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(size, before + PIECE, side="right"))), at + PIECE_ROWS)
        yield tuple(c.slice(at, end - at) for c in columns)
        at = end
