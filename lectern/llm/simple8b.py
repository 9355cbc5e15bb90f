"""Simple-8b blocks of token ids: word-aligned coding with escapes and per-document offsets.

A block is one bytes value, little-endian throughout:

    magic 4 bytes 'S8L1' | n_docs u32 | n_ids u32 | n_words u32 | n_escapes u32
    doc_id i64 x n_docs | null flags u8 x n_docs | ids of each document u32 x n_docs
    words u64 x n_words | escape positions u32 x n_escapes | escape values u32 x n_escapes

Each word holds a selector in its top four bits and WIDTHS[selector] ids below it, the first in the lowest bits.
An id wider than the block's escape width is written as 0 and stands in the escape list, so that a large id does not
widen the word around it; of the widths, the one by which the block is estimated to be smallest is taken. The last word
of a block may be filled up with zeros; n_ids tells where the ids end.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8L1"
#: (ids in a word, bits of each), by selector.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Widest ids that can stand in a word beside others, and bytes of an escape.
MOST_BITS, ESCAPE_BYTES = 30, 8


def _take(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the words, and their selectors: at each start the selector that holds most ids."""
    n = len(values)
    top = np.arange(n, dtype=np.int32)
    choice = np.full(n, len(WIDTHS) - 1, np.uint8)
    narrow = values.astype(np.uint32)
    for s in range(len(WIDTHS) - 2, -1, -1):
        count, bits = WIDTHS[s]
        fits = np.flatnonzero(narrow < (1 << bits)).astype(np.int32)
        if not len(fits):
            break
        # each run of ids that fit ends before the first that does not; the block's end is followed by zeros
        last = np.flatnonzero(np.diff(fits) > 1)
        run_ends = np.append(fits[last] + 1, fits[-1] + 1 if fits[-1] < n - 1 else n + 64)
        lengths = np.diff(np.concatenate([[-1], last, [len(fits) - 1]]))
        choice[fits[np.repeat(run_ends, lengths) - fits >= count]] = s
    jump = (top + np.array([w for w, _ in WIDTHS])[choice]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = jump[at]
    where = np.array(starts, np.int64)
    return where, choice[where]


def escape_width(values: np.ndarray) -> int:
    """Bits above which ids are escaped: words for the others, as if all had the same width, and escapes cost least."""
    bits = np.frexp(values.astype(np.float64))[1]
    wider = len(values) - np.cumsum(np.bincount(bits, minlength=65))
    return min((b for _, b in WIDTHS if b <= MOST_BITS), key=lambda b: (8 * len(values) * b / 60 + ESCAPE_BYTES * wider[b], -b))


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escape positions and escape values of ``ids`` (unsigned, up to 32 bits)."""
    values = np.asarray(ids, np.uint64)
    escapes = np.flatnonzero(values >> np.uint64(escape_width(values)))
    large = values[escapes].astype(np.uint32)
    if len(escapes):
        values = values.copy()
        values[escapes] = 0
    if not len(values):
        return np.empty(0, np.uint64), escapes.astype(np.uint32), large
    starts, chosen = _take(values)
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(WIDTHS):
        rows = np.flatnonzero(chosen == s)
        for j in range(count if len(rows) else 0):
            words[rows] |= padded[starts[rows] + j] << np.uint64(j * bits)
    return words, escapes.astype(np.uint32), large


def decode(words: np.ndarray, n_ids: int, escapes: np.ndarray, large: np.ndarray) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([w for w, _ in WIDTHS], np.int64)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n_ids + 64, np.uint64)
    for s, (count, bits) in enumerate(WIDTHS):
        rows = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(rows) else 0):
            out[starts[rows] + j] = (words[rows] >> np.uint64(j * bits)) & mask
    out = out[:n_ids].astype(np.uint32)
    out[escapes] = large
    return out


def write_block(doc_ids: np.ndarray, gone: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of documents: their ids (``gone`` marks those that are null), lengths in token ids, and all token ids."""
    words, escapes, large = encode(ids)
    head = MAGIC + struct.pack("<4I", len(doc_ids), len(ids), len(words), len(escapes))
    parts = ((np.where(gone, 0, doc_ids), "<i8"), (gone, "u1"), (lengths, "<u4"), (words, "<u8"), (escapes, "<u4"), (large, "<u4"))
    return head + b"".join(np.asarray(x).astype(kind).tobytes() for x, kind in parts)


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, which of them are null, ids of each document, all ids) of a block."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n_ids, n_words, n_escapes = struct.unpack_from("<4I", data, 4)
    at = 20
    parts = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_words), ("<u4", n_escapes), ("<u4", n_escapes)):
        part = np.frombuffer(data, kind, n, at)
        at += part.nbytes
        parts.append(part)
    return parts[0], parts[1].astype(bool), parts[2].astype(np.int64), decode(parts[3], n_ids, parts[4], parts[5])
