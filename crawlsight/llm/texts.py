"""Texts of a task in blocks of bounded size, and their words as Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, size: int, kind: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Iterator[tuple[int, pa.Table]]:
    """(kind, rows): the rows of a task, in order, in tables whose texts have about ``size`` bytes; a longer text has a table of its own.

    With ``kind`` (an integer per row) each kind has its own tables. Texts must not be null.
    """
    open_: dict[int, tuple[list[pa.RecordBatch], int]] = {}
    for batch in batches:
        of = np.zeros(batch.num_rows, "i8") if kind is None else kind(batch)
        for k in np.unique(of).tolist():
            rows = batch if kind is None else batch.filter(pa.array(of == k))
            ends = np.cumsum(pc.binary_length(rows.column(text)).to_numpy().astype("i8"))
            at, done = 0, 0
            while at < rows.num_rows:
                held, full = open_.get(k, ([], 0))
                n = max(int(np.searchsorted(ends, done + size - full, side="right")) - at, 0 if full else 1)
                if n:
                    held, full = [*held, rows.slice(at, n)], full + int(ends[at + n - 1]) - done
                    at, done = at + n, int(ends[at + n - 1])
                if at < rows.num_rows or full >= size:
                    yield k, pa.Table.from_batches(held)
                    held, full = [], 0
                open_[k] = (held, full)
    for k, (held, _) in sorted(open_.items()):
        if held:
            yield k, pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A table's column as one array; ``pa.large_string`` holds texts beyond 2 GB."""
    if column.nbytes >= 2**31 - 1:
        column = column.cast(pa.large_string())
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def spaced_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, sizes): maximal runs without ASCII white space, A-Z lower-cased, of all texts in order; how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = split.values, split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(before[offsets])


#: What becomes of each byte of a text: 0 parts terms, A-Z are lower-cased; bytes of letters beyond ASCII stay.
_TERM_BYTES = np.arange(256, dtype="u1")
_TERM_BYTES[0x41:0x5B] += 32
_TERM_BYTES[np.r_[0:0x41, 0x5B:0x61, 0x7B:0x80]] = 0


def letter_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms, text of each): maximal runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased, as bytes."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], "<i8" if wide else "<i4")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, "u1")[offsets[0] : offsets[-1]] if data else np.zeros(0, "u1")
    folded = _TERM_BYTES[raw]
    inside = folded != 0
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    ends = (offsets[1:] - offsets[0]).astype("i8")
    first = np.concatenate([[0], ends[:-1]])[: len(ends)]
    first, last = first[first < len(raw)], ends[ends > 0] - 1
    starts[first] = inside[first]
    stops[last] = inside[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    bounds = np.concatenate([[0], np.cumsum(end - begin)])
    kept = pa.py_buffer(folded[inside])
    if bounds[-1] >= 2**31:
        terms = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds.astype("<i8")), kept])
    else:
        terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds.astype("<i4")), kept])
    return terms, np.searchsorted(ends, begin, side="right")
