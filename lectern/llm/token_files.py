"""Token-id output: documents encoded with a public tokenizer and written to files of Simple-8b blocks in document order.

A file holds the blocks of one part one after the other (``simple8b`` describes a block), then an index and its end:

    blocks | per block: offset u64, bytes u64, documents u32, ids u32, ids of the part before it u64 | blocks u32 | magic 'S8F1'

Files are written to the shared folder under a name of their own for each attempt of a task. The manifest, a table of
one row per block, names those of the attempts that counted; readers take no others.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simple8b
from .scratch import batches_of, keep, shared_dir

#: The id that ends a document, and the ids from which on a block is closed.
END_ID, BLOCK_IDS = 1, 65_536
#: Bytes of text and new words encoded at once, and bytes of words that a worker remembers before it starts anew.
AT_ONCE, WORDS_AT_ONCE, REMEMBERED = 4_000_000, 2048, 16_000_000
#: Bytes of a batch of texts that goes to be encoded.
ENCODED_AT_ONCE = "4m"
#: Bytes of text in a part at most, and the least ones for which a part of its own is worth while.
PART_BYTES, LEAST_BYTES = 128_000_000, 4_000_000
FILE_MAGIC = b"S8F1"
_ENTRY = "<QQIIQ"

#: Latin letters, which are one piece before they are split further, and the signs after them, which are another.
_LATIN_TAIL = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class Pieces:
    """Strings with their ids: the strings in one Arrow array, all ids in one pool."""

    def __init__(self):
        self.strings = pa.array([], pa.string())
        self.starts, self.lengths, self.pool = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def codes(self, strings: pa.Array) -> np.ndarray:
        """Places of the strings, -1 for those that are not there."""
        return pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, strings: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.strings = pa.concat_arrays([self.strings, strings.cast(pa.string())])
        self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(lengths) - lengths).astype(np.int32)])
        self.lengths, self.pool = np.concatenate([self.lengths, lengths.astype(np.int32)]), np.concatenate([self.pool, ids])

    def flat(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings with these codes, one after the other, and the number of each one's ids."""
        counts = self.lengths[codes]
        ends = np.cumsum(counts, dtype=np.int64)
        n = int(ends[-1]) if len(ends) else 0
        places = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
        places += np.repeat((self.starts[codes] - (ends - counts)).astype(places.dtype), counts)
        return self.pool[places], counts

    def size(self) -> int:
        return self.strings.nbytes + self.pool.nbytes + self.starts.nbytes + self.lengths.nbytes


_ENCODERS: dict[str, "WordEncoder"] = {}


def encoder_for(path: str) -> "WordEncoder":
    """One encoder per tokenizer in each Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """Encodes texts word by word, which gives what encoding whole texts gives for tokenizers that drop white space
    and never join pieces across it; each different word goes to the tokenizer once while it is remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        # the first word stands for a text's end; no word of a text holds a blank
        self.words, self.parts = Pieces(), Pieces()
        self.words.add(pa.array([" "]), np.array([END_ID], np.uint32), np.array([1], np.int64))

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of Latin letters only: each ends with the one piece that ends a word."""
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) if len(ids) else np.empty(0, np.int64)
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self._each(words)

    def _part_codes(self, column: pa.Array, how) -> np.ndarray:
        """Codes of stems or of the signs after them, encoded first where they are new."""
        encoded = column.dictionary_encode()
        codes = self.parts.codes(encoded.dictionary)
        new = encoded.dictionary.filter(pa.array(codes < 0))
        strings, known = new.to_pylist(), len(self.parts.strings)
        found = [how(strings[lo : lo + WORDS_AT_ONCE]) for lo in range(0, len(strings), WORDS_AT_ONCE)]
        if found:
            self.parts.add(new, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            codes[codes < 0] = np.arange(known, known + len(strings))
        return codes[encoded.indices.to_numpy()]

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Codes of new words. Latin-1 letters are lower-cased here as the tokenizer does it, so that a stem is one
        whatever its case; everything else goes to the tokenizer as it is."""
        split = pc.extract_regex(words, _LATIN_TAIL)
        is_latin = split.is_valid()
        latin, other = words.filter(is_latin), words.filter(split.is_null())
        split, known = split.filter(is_latin), len(self.words.strings)
        if len(latin):
            both = np.stack([self._part_codes(pc.utf8_lower(split.field("stem")), self._plain), self._part_codes(split.field("tail"), self._each)], 1)
            ids, counts = self.parts.flat(both.ravel())
            self.words.add(latin, ids, counts[0::2] + counts[1::2])
        if len(other):
            self.words.add(other, *self._each(other.to_pylist()))
        order = np.argsort(~is_latin.to_numpy(zero_copy_only=False), kind="stable")
        codes = np.empty(len(words), np.int64)
        codes[order] = np.arange(known, known + len(words))
        return codes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by the end id, and the number of each text's ids."""
        if self.words.size() + self.parts.size() > REMEMBERED:
            self._clear()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        codes = self.words.codes(words.dictionary)
        if (codes < 0).any():
            codes[codes < 0] = self._learn(words.dictionary.filter(pa.array(codes < 0)))
        edges = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        with_ends = np.insert(codes[words.indices.to_numpy()], edges[1:], 0)
        ids, counts = self.words.flat(with_ends)
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return ids, np.diff(upto[edges + np.arange(len(edges))])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text of about AT_ONCE bytes of text, of several batches or of a part of one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= AT_ONCE:
            yield from _slices(held)
            held, size = [], 0
    if held:
        yield from _slices(held)


def _slices(batches: list[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The batches' rows cut by bytes of text; a longer text comes alone."""
    ids, texts = (pa.concat_arrays([b.column(i) for b in batches]) for i in (0, 1))
    bytes_ = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bytes_, (bytes_[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        lo = hi


_MANIFEST = "part int, number int, file string, offset long, bytes long, n_docs int, n_ids long, before long"


def _write(tokenizer: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_for(tokenizer), TaskContext.get().partitionId()
        file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.s8b"
        system, path = fs.FileSystem.from_uri(file)
        system.create_dir(os.path.dirname(path), recursive=True)
        rows: list[dict] = []
        docs: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = offset = before = 0

        def close() -> None:
            nonlocal held, offset, before
            n = np.concatenate(lengths)
            data = simple8b.write_block(np.concatenate(docs), np.concatenate(nulls), n, np.concatenate(ids))
            out.write(data)
            rows.append({"part": part, "number": len(rows), "file": file, "offset": offset, "bytes": len(data), "n_docs": len(n), "n_ids": held, "before": before})
            before, offset, held = before + held, offset + len(data), 0
            for x in (docs, nulls, lengths, ids):
                x.clear()

        with system.open_output_stream(path) as out:
            for doc_ids, texts in _gathered(batches):
                found, sizes = encoder(texts)
                ends = np.cumsum(sizes)
                gone = doc_ids.is_null().to_numpy(zero_copy_only=False)
                known = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
                lo = 0
                while lo < len(sizes):
                    first = ends[lo - 1] if lo else 0
                    hi = min(len(sizes), int(np.searchsorted(ends, first + BLOCK_IDS - held)) + 1)
                    docs.append(known[lo:hi])
                    nulls.append(gone[lo:hi])
                    lengths.append(sizes[lo:hi])
                    ids.append(found[first : ends[hi - 1]])
                    held += int(ends[hi - 1] - first)
                    if held >= BLOCK_IDS:
                        close()
                    lo = hi
                pa.default_memory_pool().release_unused()
            if docs:
                close()
            for r in rows:
                out.write(struct.pack(_ENTRY, r["offset"], r["bytes"], r["n_docs"], r["n_ids"], r["before"]))
            out.write(struct.pack("<I", len(rows)) + FILE_MAGIC)
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names)

    return run


def parts_of(docs: DataFrame) -> int:
    """Number of parts: by the bytes of the texts, not more than PART_BYTES each."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // PART_BYTES), min(-(-size // LEAST_BYTES), 4 * cores))


def write_blocks(docs: DataFrame, tokenizer: str, partitions: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write a file of blocks for each part to the shared folder. Returns the manifest,
    a row per block: part, number, file, offset, bytes, n_docs, n_ids, before (ids of the part before it).

    Parts and numbers follow ascending doc_id (null ids first, equal ids by their text's hash; equal rows stay as often
    as they are). Null texts are empty and have just the end id. A document is never cut, so a block is as long as its
    longest document at least. An empty table gives no blocks; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions or parts_of(docs), *order).sortWithinPartitions(*order)
    folder = f"{shared_dir(docs.sparkSession)}/lectern/tokens-{uuid.uuid4().hex}"
    with batches_of(docs.sparkSession, ENCODED_AT_ONCE):
        return keep(ordered.mapInArrow(_write(tokenizer, folder), _MANIFEST), "manifest")


def read_index(file: str) -> list[tuple[int, int, int, int, int]]:
    """(offset, bytes, documents, ids, ids before) of each block of a file, from its own index."""
    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as f:
        end = f.size() - 8
        f.seek(end)
        (n,), magic = struct.unpack("<I", f.read(4)), f.read(4)
        if magic != FILE_MAGIC:
            raise ValueError("not a file of this format")
        size = struct.calcsize(_ENTRY)
        f.seek(end - n * size)
        return list(struct.iter_unpack(_ENTRY, f.read(n * size)))


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, rows in batch.groupby("file", sort=False):
            system, path = fs.FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                for start, offset, size in zip(rows["start"].tolist(), rows["offset"].tolist(), rows["bytes"].tolist()):
                    f.seek(offset)
                    docs, gone, lengths, ids = simple8b.read_block(f.read(size))
                    ends = np.cumsum(lengths)
                    raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                    yield pd.DataFrame({"doc_id": pd.array(docs, "Int64").copy() if not gone.any() else pd.array(np.where(gone, None, docs), "Int64"), "start": ends - lengths + start, "n_tokens": lengths, "ids_crc32": crcs})


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of the written blocks: doc_id, start (ids before it), n_tokens (with the end id), ids_crc32.

    A block knows how many ids of its part come before it; the running sum over parts has as many rows as parts.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    parts = parts.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("start"), "file", "offset", "bytes")
    return placed.mapInPandas(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
