"""Language-model scores by logistic context mixing over bits.

A text is its lower-cased words and one end. A word that training has seen is coded by the bits of its hash, from the top
down: each node of this binary tree is a prefix of the hash, and a bit is coded where both branches hold words. Several
contexts predict the bit from how often training went each way there: none (which alone would give the word's
frequency), the kind of the last frequent word of the sentence, and the kinds of the last two. Their stretched
predictions are mixed with weights that a gate selects by how much the contexts have seen, and a last stage refines the
mixed probability from how such probabilities came out. The kinds are clusters of frequent words that stand in the same
texts, so they tell language and register.

One bit before each word tells whether training has seen it, by the share of words seen once. A word that it has not
seen is spelled by bytes: a byte is a path in a binary code tree, and its bits are predicted, mixed and gated in the same
way from hashed contexts of the last 1 to 4 bytes. Every different word of training counts once there.

Over whole sentences, the probability that the words give is mixed with how often training has the sentence, and has it
after the one before. The shares of the three are those of training's own sentences, each without its own occurrence.
The contexts of words begin anew with each sentence, so a sentence's own cost is one number.

Everything is learned from all training documents. Kinds come from the products of the frequent words' columns, summed
over all documents. The mixing weights and refinements are fitted online in each group of words (those with the same top
bits of the hash), over all its bits; the mixer is the mean of the groups' weights by use, and their outcomes together.
So a score depends neither on the order of documents nor on how the rows are dealt to tasks.

Documents are read in chunks, whose texts become places in the chunk's own list of words. Only these lists go to the
groups of words, and their costs come back to the chunk: what is shuffled are different words of chunks, not tokens.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Frequent words that tell the context, the most bytes of one, and their kinds.
ANCHORS, ANCHOR_BYTES, KINDS = 256, 6, 6
STATES = (KINDS + 1) ** 2
#: Top bits of a hash that choose what part of a chunk's list goes out together; tokens of all texts to a group of words.
PREFIX, GROUP = 10, 500_000
#: Bits of a hash by which words and sentences are told apart: the bucket and six bytes.
KEY_BITS = PREFIX + 48
#: Pairs of word and context that _commonest gives at most.
TOP = 262_144
#: Slots of the spelling's tables as powers of two, by bytes of context.
TABLE_BITS = (14, 16, 19, 20)
#: Bytes of text parsed at once and in a chunk, size of a step of online learning, passes, buckets of probability.
AT_ONCE, CHUNK, ONLINE, PASSES, BUCKETS = 5_000_000, 32_000_000, 1024, 3, 33
#: Words spelled at once; levels of what a context has seen; levels of how often training has the sentence before.
SPELL_ONCE, LEVELS, SAID = 4000, 8, 9
_EDGES = np.array([1, 2, 4, 11, 31, 101, 1001])
_BREAK = "\uffff"
_K = 0x9E3779B97F4A7C15
_TOP_BIT = np.uint64(1 << 63)


# --- texts as numbers ------------------------------------------------------------------------------------------


class Parsed:
    """Texts as arrays with an entry for each token: ``word`` (place in ``words`` and ``hashes``), ``text``, ``sentence``."""

    def __init__(self, texts: pa.Array):
        texts = pc.ascii_lower(texts)
        # line ends are marked at the word before them, with what no text holds
        mark = next(m for m in (_BREAK * k for k in itertools.count(1)) if not pc.any(pc.match_substring(texts, m)).as_py())
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring(texts, "\n", mark + "\n")))
        encoded = split.flatten().dictionary_encode()
        found = encoded.dictionary
        marked = pc.ends_with(found, mark)
        plain = pc.if_else(marked, pc.utf8_slice_codeunits(found, 0, -len(mark)), found)
        self.words = [*plain.to_pylist(), ""]
        each = plain.cast(pa.binary()).to_pylist()
        self.hashes = np.fromiter(map(_digest, [*each, b""]), np.uint64, len(each) + 1).view(np.int64) ^ np.int64(-(2**63))
        size = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bytes = np.append(size, 0) + 1
        # marks alone and the empty word of an empty text are no tokens; words that only differ by their mark are one
        gone = np.append(size == 0, False)
        breaks = np.append(np.any([m.to_numpy(zero_copy_only=False) for m in (marked, *(pc.ends_with(found, e) for e in ".!?"))], 0), True)
        edges = split.offsets.to_numpy().astype(np.int64) - (split.offsets[0].as_py() if len(split) else 0)
        codes = np.insert(encoded.indices.to_numpy().astype(np.int64), edges[1:], len(found))
        text = np.repeat(np.arange(len(texts)), np.diff(edges) + 1)
        ends = np.insert(breaks[codes][:-1] | (text[1:] != text[:-1]), 0, True) if len(codes) else np.empty(0, bool)
        stays = ~gone[codes]
        number = np.cumsum(ends)[stays]
        self.word, self.text = codes[stays], text[stays]
        self.first = np.insert(number[1:] != number[:-1], 0, True) if len(number) else np.empty(0, bool)
        self.sentence = np.cumsum(self.first) - 1
        self.texts = len(texts)

    def states(self, kinds: dict[int, int]) -> np.ndarray:
        """Context of each token: the kinds of the last two frequent words before it in its sentence."""
        known = np.array(sorted(kinds), np.int64)
        at = np.minimum(np.searchsorted(known, self.hashes), max(len(known) - 1, 0))
        kind = np.where(known[at] == self.hashes, np.array([kinds[h] for h in known.tolist()])[at], -1)[self.word] if len(known) else np.full(len(self.word), -1)
        at = np.flatnonzero(kind >= 0)
        before = np.cumsum(kind >= 0) - (kind >= 0)
        start = np.flatnonzero(self.first)[self.sentence] if len(kind) else at
        out = []
        for back in (1, 2):
            place = at[np.maximum(before - back, 0)] if len(at) else np.zeros(len(kind), np.int64)
            held = (before >= back) & (place >= start)
            out.append(np.where(held, kind[place] if len(kind) else place, KINDS))
        return out[0] * (KINDS + 1) + out[1]

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each sentence, of the one before it in its text (0 if there is none), and the text."""
        if not len(self.word):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.flatnonzero(self.first)
        place = np.arange(len(self.word)) - starts[self.sentence]
        with np.errstate(over="ignore"):
            each = _mix(self.hashes.view(np.uint64)[self.word] + place.astype(np.uint64) * np.uint64(_K))
            own = _mix(np.add.reduceat(each, starts)).view(np.int64)
        text = self.text[starts]
        before = np.where(np.insert(text[1:] == text[:-1], 0, False), np.insert(own[:-1], 0, 0), 0)
        return own, before, text


def _digest(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def hash_of(word: str) -> int:
    return _digest(word.encode("utf-8", "surrogatepass")) - 2**63


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function with public constants (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(_K)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Parsed]]:
    """Rows of about AT_ONCE bytes of text, the last column, and their parsed texts."""

    def parsed(held: list) -> tuple[pa.Table, Parsed]:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column(table.num_columns - 1)
        return table, Parsed(texts.chunk(0) if texts.num_chunks else pa.array([], pa.string()))

    held, size = [], 0
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(part.num_columns - 1))).as_py() or 0
            if size >= AT_ONCE:
                yield parsed(held)
                held, size = [], 0
    if held:
        yield parsed(held)


def _tallied(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys (less than 2^62), how often each stands in training (``train`` is 1), and how often at all."""
    found, times = np.unique(key * 2 + train, return_counts=True)
    starts = np.flatnonzero(np.diff(found >> 1, prepend=-1))
    if not len(starts):
        return found, times, times
    return found[starts] >> 1, np.add.reduceat(times * (found & 1), starts), np.add.reduceat(times, starts)


def _packed(values) -> bytes:
    data = pickle.dumps(values, protocol=5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes):
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def _small(x: np.ndarray) -> np.ndarray:
    """In as few bytes as the largest number takes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _bytes_apart(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers by their first bytes, their second ones and so on, which packs better."""
    x = _small(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), x.dtype.itemsize


def _together(parts: tuple[np.ndarray, int]) -> np.ndarray:
    data, size = parts
    return np.ascontiguousarray(data.T).view(f"<u{size}").ravel().astype(np.int64)


# --- kinds of frequent words -----------------------------------------------------------------------------------


def _flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy().astype(np.int64)
    return split.flatten(), offsets - (offsets[0] if len(offsets) else 0)


def _short_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word of at most ANCHOR_BYTES stands in a task's texts."""
    found: Counter = Counter()
    for batch in batches:
        words, _ = _flat(batch.column(0))
        size = pc.binary_length(words)
        counts = pc.value_counts(words.filter(pc.and_(pc.greater(size, 0), pc.less_equal(size, ANCHOR_BYTES))))
        for w, c in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
            found[w] += c
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["w", "c"])


def _products(anchors: list[str]):
    """Sums over a task's texts of the products of the anchors' columns; column ANCHORS is 1 in every text. A column is the
    logarithm of a count as a whole number, so that sums are exact and don't depend on order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(anchors)
        total = np.zeros((n + 1, n + 1), np.int64)
        wanted = pa.array(anchors, pa.string())
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                words, edges = _flat(batch.column(0).slice(lo, 2000))
                which = pc.index_in(words, wanted).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(~np.isnan(which)) if which.dtype.kind == "f" else np.arange(len(which))
                text = np.searchsorted(edges, at, "right") - 1
                texts = len(edges) - 1
                counts = np.bincount(text * n + which[at].astype(np.int64), minlength=texts * n).reshape(texts, n)
                x = np.column_stack([np.rint(np.log1p(counts) * 256), np.ones(texts)])
                total += np.rint(x.T @ x).astype(np.int64)
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.int64())], ["i", "j", "c"])

    return run


def cluster(products: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """Kind of each column, from the products of the columns, the last of which is 1 in all rows: columns that are high in
    the same rows are of one kind (k-means over directions)."""
    rows, sums = products[-1, -1], products[:-1, -1]
    inner = products[:-1, :-1] - np.outer(sums, sums) / rows
    size = np.sqrt(np.maximum(np.diag(inner), 1e-9))
    values, vectors = np.linalg.eigh(np.round(inner / np.outer(size, size), 12))
    x = vectors * np.sqrt(np.maximum(values, 0))  # points with these inner products
    centres = x[:1]
    while len(centres) < min(kinds, len(x)):  # the column farthest from all centres is the next one
        centres = np.vstack([centres, x[np.argmin(np.round((x @ centres.T).max(1), 9))]])
    for _ in range(30):
        of = np.argmax(np.round(x @ centres.T, 9), 1)
        new = np.stack([x[of == k].mean(0) if (of == k).any() else centres[k] for k in range(len(centres))])
        centres = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    return of


def _kinds(train: DataFrame) -> dict[int, int]:
    """Kinds of the ANCHORS most frequent short words of all training documents, by the words' hashes."""
    counts = train.select("text").mapInArrow(_short_words, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "w").limit(ANCHORS).collect()
    anchors = [r[0] for r in counts]
    if not anchors:
        return {}
    products = np.zeros((len(anchors) + 1,) * 2)
    for i, j, c in train.select("text").mapInArrow(_products(anchors), "i int, j int, c long").groupBy("i", "j").agg(F.sum("c")).collect():  # ANCHORS^2 at most
        products[i, j] = products[j, i] = c
    return dict(zip(map(hash_of, anchors), cluster(products).tolist()))


# --- bits ------------------------------------------------------------------------------------------------------


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -14, 14)))


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


class Mixer:
    """Weights of the inputs by gate, and a refinement of the mixed probability by level of the gate and bucket."""

    def __init__(self, gates: int, inputs: int):
        self.weights = np.zeros((gates, inputs))
        self.weights[:, -1] = 1.0
        prior = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
        self.refine = np.repeat(prior[None], gates, 0)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(_squash(np.einsum("ij,ij->i", x, self.weights[gate])), 1e-6, 1 - 1e-6)

    def bucket(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(_stretch(p) * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)

    def __call__(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of bit 1: mixed, and half of it as refined."""
        p = self.mixed(x, gate)
        return np.clip((p + self.refine[gate, self.bucket(p)]) / 2, 1e-6, 1 - 1e-6)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray, passes: int = PASSES) -> None:
        """Online: weights by the error of each step, then how the mixed probabilities came out."""
        gates, speed = len(self.weights), np.full_like(self.weights, 1e-3)
        order = np.random.default_rng(1).permutation(len(bit))
        for lo in range(0, len(order) * passes, ONLINE):
            at = order[np.arange(lo, min(lo + ONLINE, len(order) * passes)) % len(order)]
            seen, of, weight = x[at], gate[at], times[at]
            error = (bit[at] - self.mixed(seen, of)) * weight
            held = np.bincount(of, weight, gates) + 1e-9
            slope = np.stack([np.bincount(of, error * seen[:, i], gates) for i in range(x.shape[1])], 1) / held[:, None]
            speed += slope**2
            self.weights += 0.05 * slope / np.sqrt(speed)
        self._refined(*self.outcomes(x, gate, bit, times))

    def outcomes(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By gate and bucket of the mixed probability: how often the bit was 1, and how often there was one."""
        key = gate * BUCKETS + self.bucket(self.mixed(x, gate))
        return np.bincount(key, times * bit, self.refine.size).reshape(self.refine.shape), np.bincount(key, times, self.refine.size).reshape(self.refine.shape)

    def _refined(self, ones: np.ndarray, all_: np.ndarray) -> None:
        self.refine = (ones + 20 * self.refine) / (all_ + 20)

    def part(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray) -> bytes:
        """What a group of bits adds to a mixer of all groups: its weights by how often each gate was used, and outcomes."""
        self.learn(x, gate, bit, times, 1)
        ones, all_ = self.outcomes(x, gate, bit, times)
        held = np.bincount(gate, times, len(self.weights))
        return np.concatenate([held, (self.weights * held[:, None]).ravel(), ones.ravel(), all_.ravel()]).astype("<f8").tobytes()

    def gather(self, parts: list[bytes]) -> Mixer:
        """The mixer of all groups: means of their weights, and their outcomes together."""
        gates, inputs = self.weights.shape
        if parts:
            held, weights, ones, all_ = np.split(np.sum([np.frombuffer(p, "<f8") for p in parts], 0), np.cumsum([gates, gates * inputs, self.refine.size]))
            used = held > 0
            self.weights[used] = weights.reshape(gates, inputs)[used] / held[used, None]
            self._refined(ones.reshape(self.refine.shape), all_.reshape(self.refine.shape))
        return self


# --- words that training has seen: bits of the hash ------------------------------------------------------------


def _level(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, n, "right")


def inputs(n: list[tuple[np.ndarray, np.ndarray]], from_half: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions of bit 1 by the contexts, from the shortest to the longest, and the gate. ``n`` are the
    counts of 0 and 1 in each; a longer context starts from what the shorter one predicts, the first from its own
    counts or from a half."""
    p = np.full(len(n[0][0]), 0.5) if from_half else n[0][1] / np.maximum(n[0][0] + n[0][1], 1)
    x = []
    for i, (zeros, ones) in enumerate(n):
        if i or from_half:
            p = (ones + 2 * p) / (zeros + ones + 2)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        x.append(_stretch(p))
    return np.stack(x, 1), _level(n[-2][0] + n[-2][1]) * LEVELS + _level(n[-1][0] + n[-1][1])


def paths(h: np.ndarray, s: np.ndarray, c: np.ndarray, q_h: np.ndarray, q_s: np.ndarray, top: int, use) -> None:
    """Walk the trees of words (hash, state, count) from depth ``top`` down the paths of the queries, whose words are among
    them.

    At each depth ``use(at, bit, counts)`` gets the queries whose bit is coded there and the counts of 0 and 1 in the
    three contexts. Hashes are compared as unsigned numbers.
    """
    if not len(h) or not len(q_h):
        return
    words, rank = np.unique(h.view(np.uint64) ^ _TOP_BIT, return_inverse=True)
    n = len(words) + 1
    q = q_h.view(np.uint64) ^ _TOP_BIT
    views = []
    for context, asked in ((np.zeros_like(s), np.zeros_like(q_s)), (s // (KINDS + 1), q_s // (KINDS + 1)), (s, q_s)):
        key = context.astype(np.int64) * n + rank
        order = np.argsort(key, kind="stable")
        views.append((key[order], np.concatenate([[0], np.cumsum(c[order])]), asked.astype(np.int64) * n))

    def sums(view, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Count of what lies before the places in the queries' contexts."""
        key, total, asked = view
        return total[np.searchsorted(key, asked[at] + place)]

    # queries in the order of their words find neighbouring places
    at = np.argsort(q, kind="stable")
    mask = np.uint64(2**64 - 1) >> np.uint64(top) if top < 64 else np.uint64(0)
    lo, hi = np.searchsorted(words, q[at] & ~mask, "left"), np.searchsorted(words, q[at] | mask, "right")
    ends = [[sums(v, at, lo), sums(v, at, hi)] for v in views]
    for depth in range(top, 64):
        more = hi - lo > 1  # a query leaves once its word is alone
        at, lo, hi, ends = at[more], lo[more], hi[more], [[a[more], b[more]] for a, b in ends]
        if not len(at):
            break
        half = np.uint64(1 << (63 - depth))
        below = np.uint64((1 << (63 - depth)) - 1)
        bit = (q[at] & half) != 0
        middle = np.searchsorted(words, (q[at] & ~(half | below)) | half, "left")
        counts = []
        for v, e in zip(views, ends):
            half_way = sums(v, at, middle)
            counts.append((half_way - e[0], e[1] - half_way))
            e[0], e[1] = np.where(bit, half_way, e[0]), np.where(bit, e[1], half_way)
        lo, hi = np.where(bit, middle, lo), np.where(bit, hi, middle)
        coded = (counts[0][0] > 0) & (counts[0][1] > 0)
        if coded.any():
            use(at[coded], bit[coded], [(a[coded], b[coded]) for a, b in counts])


def path_costs(h: np.ndarray, s: np.ndarray, c: np.ndarray, q_h: np.ndarray, q_s: np.ndarray, top: int, mixer: Mixer) -> np.ndarray:
    """log10 probability of the queries' bits from depth ``top`` on."""
    lg = np.zeros(len(q_h))

    def use(at: np.ndarray, bit: np.ndarray, counts: list) -> None:
        p = mixer(*inputs(counts))
        lg[at] += np.log10(np.where(bit, p, 1 - p))

    paths(h, s, c, q_h, q_s, top, use)
    return lg


def _learning_bits(h: np.ndarray, s: np.ndarray, c: np.ndarray, c0: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bits of all words that training has twice or more (c0), each without one occurrence of its own: for a mixer."""
    some = np.flatnonzero((c > 0) & (c0 > 1))
    out: list = [[], [], [], []]

    def use(at: np.ndarray, bit: np.ndarray, counts: list) -> None:
        less = [(a - ~bit, b - bit) for a, b in counts]
        ok = (less[0][0] > 0) & (less[0][1] > 0)
        x, gate = inputs([(a[ok], b[ok]) for a, b in less])
        for o, new in zip(out, (x, gate, bit[ok], c[some][at[ok]].astype(float))):
            o.append(new)

    paths(h[c > 0], s[c > 0], c[c > 0], h[some], s[some], top, use)
    if not out[0]:
        return np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
    return tuple(np.concatenate(o) for o in out)


# --- words that training has not seen: bits of their bytes -----------------------------------------------------


_OFFSETS = np.cumsum([0, *(2 << b for b in TABLE_BITS)])
#: Counters in a block of the tables.
_BLOCK = 1 << 17


def _spelled_bytes(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bytes and terminators of the words, the bytes before each in its word (plus 1; 0 at the start), and the sizes."""
    each = [w.encode("utf-8", "surrogatepass") + b" " for w in words]
    data, sizes = np.frombuffer(b"".join(each), np.uint8).astype(np.uint64), np.fromiter(map(len, each), np.int64, len(each))
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    backs = []
    for k in range(1, len(TABLE_BITS) + 1):
        back = np.zeros(len(data), np.uint64)
        back[k:] = data[:-k] + np.uint64(1) if len(data) > k else 0
        back[place < k] = 0
        backs.append(back)
    return data, backs, sizes


def _slots(data: np.ndarray, backs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of all bits of the bytes: place of the counter of 0 in each table, the bit."""
    bit = np.unpackbits(data.astype(np.uint8)).astype(bool)
    # a node is the bits of the byte that are known, after a leading 1
    step = np.tile(np.arange(8, dtype=np.uint64), len(data))
    node = (np.repeat(data, 8) | np.uint64(256)) >> (np.uint64(8) - step)
    context, slots = np.zeros(len(data), np.uint64), []
    with np.errstate(over="ignore"):
        spread = node * np.uint64(_K)
        for k, (b, offset, back) in enumerate(zip(TABLE_BITS, _OFFSETS, backs), 1):
            context = context * np.uint64(257) + back
            x = (np.repeat(_mix(context + np.uint64(k)), 8) ^ spread) * np.uint64(0xD6E8FEB86659FD93)
            slots.append(((x >> np.uint64(64 - b)) << np.uint64(1)).astype(np.int64) + offset)
    return slots, bit


def spelled_bits(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of all bits of the words' bytes and terminators: place of the counter of 0 in each table, the bit, the word."""
    data, backs, sizes = _spelled_bytes(words)
    return *_slots(data, backs), np.repeat(np.repeat(np.arange(len(words)), sizes), 8)


def _different_bits(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bits of the words' different bytes with what stands before them: places of counters, the bit, how often it is there."""
    data, backs, _ = _spelled_bytes(words)
    key = data
    for back in backs:
        key = key * np.uint64(257) + back
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return *_slots(data[first], [b[first] for b in backs]), np.repeat(times, 8)


_TABLE = "block int, data binary"


def _type_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """Group and training's different words in it, which are the column after it."""
    for batch in batches:
        for g, n, types in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield g, (_unpacked(types).decode("utf-8", "surrogatepass").split(" ") if n else [])


def _spelling_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of one task's words, by blocks."""
    table, found = np.zeros(_OFFSETS[-1], np.int64), False
    for _, words in _type_words(batches):
        found = found or bool(words)
        if words:
            slots, bit, times = _different_bits(words)
            for s in slots:
                np.add.at(table, s + bit, times)
    if found:
        blocks = [_packed(_small(table[i : i + _BLOCK])) for i in range(0, len(table), _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "data"])


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_BLOCK, np.int64)
    for data in rows["data"]:
        part = _unpacked(data)
        total[: len(part)] += part
    return pd.DataFrame({"block": [int(key[0])], "data": [total.astype("<i8").tobytes()]})


class Spelling:
    """Counts of all tables, and the mixer of their predictions."""

    def __init__(self, blocks: list):
        self.table = np.zeros(-(-_OFFSETS[-1] // _BLOCK) * _BLOCK, np.int64)
        for block, data in blocks:
            self.table[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(data, "<i8")
        self.mixer = Mixer(LEVELS * LEVELS, len(TABLE_BITS))

    def counts(self, slots: list[np.ndarray], own: np.ndarray | int = 0, bit: np.ndarray | None = None) -> list:
        return [(np.maximum(self.table[s] - (own if bit is None else own * ~bit), 0), np.maximum(self.table[s + 1] - (own if bit is None else own * bit), 0)) for s in slots]

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different bits of the words with how often they stand there, each as if its word had stood once less in training."""
        slots, bit, times = _different_bits(words)
        x, gate = inputs(self.counts(slots, 1, bit), from_half=True)
        return x, gate, bit, times.astype(float)

    def learn(self, words: list[str]) -> None:
        """Each word as if it had stood once less in training."""
        if words:
            self.mixer.learn(*self.bits(words))

    def __call__(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word's bytes and terminator."""
        if not words:
            return np.zeros(0)
        out = []
        for lo in range(0, len(words), SPELL_ONCE):
            slots, bit, of = spelled_bits(words[lo : lo + SPELL_ONCE])
            p = self.mixer(*inputs(self.counts(slots), from_half=True))
            out.append(np.bincount(of, np.log10(np.where(bit, p, 1 - p)), len(words[lo : lo + SPELL_ONCE])))
        return np.concatenate(out)


def _spelling_parts(spelling):
    """What each group's words add to the spelling's mixer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, words in _type_words(batches):
            if words:
                part = Mixer(LEVELS * LEVELS, len(TABLE_BITS)).part(*spelling.value.bits(words))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([part], pa.binary())], ["g", "part"])

    return run


# --- chunks of documents ---------------------------------------------------------------------------------------

_CHUNKS = "chunk long, bucket int, n long, docs binary, words binary, types binary, sentences binary"


def _sentence_keys(own: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sentences and of sentences after the one before (0 where there is none)."""
    alone = np.maximum(_mix(own.view(np.uint64)) >> np.uint64(64 - KEY_BITS), np.uint64(1))
    both = np.maximum(_mix(own.view(np.uint64) ^ _mix(before.view(np.uint64) + np.uint64(1))) >> np.uint64(64 - KEY_BITS), np.uint64(1))
    return alone, np.where(before == 0, np.uint64(0), both)


def _piece(table: pa.Table, p: Parsed, kinds: dict[int, int]) -> dict:
    """Parsed texts in terms of their own pairs of word and state."""
    fold = table.column("fold").to_numpy()
    key = p.word * STATES + p.states(kinds)
    size = len(p.words) * STATES
    seen = np.zeros(size, bool)
    seen[key] = True
    pairs = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[pairs] = np.arange(len(pairs))
    own, before, text = p.sentences()
    alone, both = _sentence_keys(own, before)
    return {
        "ids": table.column("doc_id").combine_chunks(), "fold": fold, "words": p.words, "hashes": p.hashes, "word": pairs // STATES, "state": pairs % STATES, "codes": place[key],
        "c": np.bincount(place[key], (fold != 0)[p.text], len(pairs)).astype(np.int64), "tokens": np.bincount(p.text, minlength=p.texts), "bytes": np.bincount(p.text, p.bytes[p.word], p.texts).astype(np.int64),
        "lengths": np.diff(np.append(np.flatnonzero(p.first), len(p.word))), "said": np.bincount(text, minlength=p.texts), "alone": alone, "both": both, "train": (fold != 0)[text],
    }


def _cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted keys, and where each begins, with the end."""
    bucket = (keys >> np.uint64(KEY_BITS - PREFIX)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[starts], np.append(starts, len(keys))


def _chunk(number: int, pieces: list[dict]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents in places of its lists, and the lists of pairs and sentences by bucket."""
    join = lambda name: np.concatenate([p[name] for p in pieces])
    words, first, of = np.unique((join("hashes").view(np.uint64) ^ _TOP_BIT) >> np.uint64(64 - KEY_BITS), return_index=True, return_inverse=True)
    strings = [w for p in pieces for w in p["words"]]
    base = np.cumsum([0, *(len(p["words"]) for p in pieces)])
    pair, where = np.unique(of[np.concatenate([p["word"] + b for p, b in zip(pieces, base)])] * STATES + join("state"), return_inverse=True)
    c = np.bincount(where, join("c"), len(pair)).astype(np.int64)
    word, state = pair // STATES, pair % STATES
    base = np.cumsum([0, *(len(p["word"]) for p in pieces)])
    codes = np.concatenate([where.astype(np.int32)[b + p["codes"]] for p, b in zip(pieces, base)])
    trained = np.bincount(word, c, len(words)) > 0
    # words of which this chunk has none in training may be new, and have to be spelled
    maybe = np.flatnonzero(~trained)
    spelled = np.flatnonzero(~trained[word])
    keys, which = np.unique(np.concatenate([join("alone"), join("both")]), return_inverse=True)
    times = np.bincount(which, np.tile(join("train"), 2), len(keys)).astype(np.int64)
    alone, both = which[: len(which) // 2], which[len(which) // 2 :]
    # a sentence always has the same pairs, so they are listed at its first place only
    lengths = join("lengths")
    said, place, alone = np.unique(alone, return_index=True, return_inverse=True)
    listed = np.zeros(len(lengths), bool)
    listed[place] = True
    by_place = np.cumsum(listed) - 1
    ids = pa.concat_arrays([p["ids"] for p in pieces])
    docs = {
        "ids": ids.fill_null(0).to_numpy(), "null": np.asarray(ids.is_null()), "codes": _bytes_apart(codes[np.repeat(listed, lengths)]), "lengths": _small(lengths[listed]), "spelled": _small(spelled), "which": _small(np.searchsorted(maybe, word[spelled])),
        "strings": " ".join([strings[i] for i in first[maybe].tolist()]).encode("utf-8", "surrogatepass"), "alone": _bytes_apart(by_place[place][alone]), "both": _bytes_apart(both), "keys": _bytes_apart(said[np.argsort(place)]), "none": bool(len(keys) and keys[0] == 0),
    } | {name: _small(join(name)) for name in ("fold", "tokens", "bytes", "said")}
    empty = {"bucket": pa.nulls(1, pa.int32()), "n": pa.array([len(codes)], pa.int64()), "docs": pa.array([_packed(docs)], pa.binary())}
    # what the lists don't need is let go
    pieces.clear()
    del docs, codes
    yield _row_batch(number, 1, empty)
    # the key 0 is of no sentence; it is in no list
    keys, times = (keys[1:], times[1:]) if len(keys) and keys[0] == 0 else (keys, times)
    parts: dict[int, list] = {}
    buckets, starts = _cut(words[word])
    for b, lo, hi in zip(buckets.tolist(), starts, starts[1:]):
        known = np.arange(word[lo], word[hi - 1] + 1)[trained[word[lo] : word[hi - 1] + 1]]
        listed = " ".join([strings[i] for i in first[known].tolist()]).encode("utf-8", "surrogatepass")
        parts[b] = [_pair_list(words, word[lo:hi], state[lo:hi], c[lo:hi]), listed, None]
    buckets, starts = _cut(keys)
    for b, lo, hi in zip(buckets.tolist(), starts, starts[1:]):
        parts.setdefault(b, [None, None, None])[2] = (hi - lo).astype("<i8").tobytes() + _six(keys[lo:hi]) + times[lo:hi].astype("<u4").tobytes()
    order = sorted(parts)
    yield _row_batch(number, len(order), {"bucket": pa.array(order, pa.int32())} | {name: pa.array([parts[b][i] for b in order], pa.binary()) for i, name in enumerate(("words", "types", "sentences"))})


def _row_batch(number: int, rows: int, columns: dict) -> pa.RecordBatch:
    types = {"n": pa.int64(), "docs": pa.binary(), "words": pa.binary(), "types": pa.binary(), "sentences": pa.binary()}
    values = [pa.array(np.full(rows, number), pa.int64()), columns["bucket"], *(columns.get(n, pa.nulls(rows, t)) for n, t in types.items())]
    return pa.RecordBatch.from_arrays(values, ["chunk", "bucket", *types])


def _pair_list(words: np.ndarray, word: np.ndarray, state: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs in the order of words: the six bytes of the words' hashes after the bucket, how many pairs each has, states,
    counts in training."""
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    each = np.diff(np.append(starts, len(word)))
    return np.array([len(starts), len(word)], "<i8").tobytes() + _six(words[word[starts]]) + each.astype(np.uint8).tobytes() + state.astype(np.uint8).tobytes() + c.astype("<u4").tobytes()


def _six(keys: np.ndarray) -> bytes:
    """The lower 48 bits of keys; the PREFIX bits above are the bucket."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(data: bytes, n: int, at: int, bucket: int) -> np.ndarray:
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return keys.view("<u8").ravel() | np.uint64(bucket << 48)


def _pairs_of(data: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of KEY_BITS as unsigned numbers, states and counts of a list's pairs."""
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    at = 16 + 6 * n
    h, each = _of_six(data, n, 16, bucket), np.frombuffer(data, np.uint8, n, at)
    return np.repeat(h, each), np.frombuffer(data, np.uint8, m, at + n).astype(np.int64), np.frombuffer(data, "<u4", m, at + n + m).astype(np.int64)


def _sentences_of(data: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return _of_six(data, n, 8, bucket), np.frombuffer(data, "<u4", n, 8 + 6 * n).astype(np.int64)


def _chunks(kinds: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces, size = TaskContext.get().partitionId() << 32, [], 0
        for table, p in _gathered(batches):
            pieces.append(_piece(table, p, kinds))
            size += int(pieces[-1]["bytes"].sum())
            if size >= CHUNK:
                yield from _chunk(number, pieces)
                number, pieces, size = number + 1, [], 0
        if pieces:
            yield from _chunk(number, pieces)

    return run


# --- groups of words -------------------------------------------------------------------------------------------


def _merged(lists: list[bytes], buckets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of all lists: words, the pairs' word, state and count, count of the word, place of each list's
    pairs among them, where each list begins."""
    each = [_pairs_of(x, int(b)) for x, b in zip(lists, buckets)]
    h, s, c = (np.concatenate(x) for x in zip(*each))
    words, rank = np.unique(h, return_inverse=True)
    pair, where = np.unique(rank * STATES + s, return_inverse=True)
    c = np.bincount(where, c, len(pair)).astype(np.int64)
    word = pair // STATES
    c0 = np.bincount(word, c, len(words)).astype(np.int64)[word]
    return words, word, pair % STATES, c, c0, where, np.cumsum([0, *(len(x[0]) for x in each)])


_GROUPS = "g long, v long, types binary, totals binary, once binary, part binary"


def _group(top: int):
    """What a group of words knows: how many training has, which, counts by state, of words seen once too, its mixer."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["words"].notna()]
        if not len(rows):
            return pd.DataFrame({n.split()[0]: [] for n in _GROUPS.split(", ")})
        words, word, s, c, c0, _, _ = _merged(rows["words"].tolist(), rows["bucket"].tolist())
        h = ((words << np.uint64(64 - KEY_BITS)) ^ _TOP_BIT).view(np.int64)[word]
        totals, once = np.bincount(s, c, STATES), np.bincount(s, np.where(c0 == 1, c, 0), STATES)
        found: dict = {}
        for data, pairs, bucket in zip(rows["types"], rows["words"], rows["bucket"]):
            each, _, times = _pairs_of(pairs, int(bucket))
            trained = np.unique(each[times > 0])  # in the order of the strings
            if len(trained):
                found.update(zip(trained.tolist(), data.split(b" ")))
        types = [found[k] for k in sorted(found)]
        part = Mixer(LEVELS * LEVELS, 3).part(*_learning_bits(h, s, c, c0, top))
        return pd.DataFrame({"g": [int(key[0])], "v": [len(types)], "types": [_packed(b" ".join(types))], "totals": [totals.astype("<f8").tobytes()], "once": [once.astype("<f8").tobytes()], "part": [part]})

    return run


_ANSWERS = "chunk long, bucket int, lg binary, c0 binary, said binary"


def _answers(top: int, sent):
    """To each list of pairs: log10 probability of each (of being new, if training lacks the word) and the word's count;
    to each list of sentences: their counts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = {name: rows[name].tolist() for name in ("chunk", "bucket")} | {name: [None] * len(rows) for name in ("lg", "c0", "said")}
        at = np.flatnonzero(rows["words"].notna())
        if len(at):
            words, word, s, c, c0, where, starts = _merged([rows["words"].iloc[i] for i in at], [rows["bucket"].iloc[i] for i in at])
            h = ((words << np.uint64(64 - KEY_BITS)) ^ _TOP_BIT).view(np.int64)[word]
            mixer, above, known, new = sent.value
            seen, has = c > 0, c0 > 0
            lg = new[s]
            lg[has] = path_costs(h[seen], s[seen], c[seen], h[has], s[has], top, mixer) + above[int(key[0]), s[has]] + known[s[has]]
            for i, a, b in zip(at, starts, starts[1:]):
                out["lg"][i], out["c0"][i] = lg[where[a:b]].astype("<f4").tobytes(), c0[where[a:b]].astype("<i8").tobytes()
        at = np.flatnonzero(rows["sentences"].notna())
        if len(at):
            each = [_sentences_of(rows["sentences"].iloc[i], int(rows["bucket"].iloc[i])) for i in at]
            _, where = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
            c = np.bincount(where, np.concatenate([t for _, t in each])).astype(np.int64)[where]
            starts = np.cumsum([0, *(len(k) for k, _ in each)])
            for i, a, b in zip(at, starts, starts[1:]):
                out["said"][i] = c[a:b].astype("<i8").tobytes()
        return pd.DataFrame(out)

    return run


# --- scores ----------------------------------------------------------------------------------------------------

_SCORED = "chunk long, data binary, tries array<long>, fails array<long>"


def _said_level(n: np.ndarray) -> np.ndarray:
    """Of how often training has the sentence before: 0 for none."""
    return np.minimum(np.ceil(np.log2(n + 1.0)), SAID - 1).astype(np.int64)


def _scored(spelling):
    """Of each chunk: sums of its documents, and of each sentence what its words cost and how often training has it, it
    after the one before, and the one before, each without its own occurrence. Besides, how often those of training were
    tried at each level and failed; the last entry is of sentences alone."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        answers = rows[rows["docs"].isna()].sort_values("bucket")
        d = _unpacked(rows["docs"].dropna().iloc[0])
        lg, c0, said = (np.frombuffer(b"".join(answers[name].dropna()), kind) for name, kind in (("lg", "<f4"), ("c0", "<i8"), ("said", "<i8")))
        lg = lg.astype(np.float64)
        spelled, which = d["spelled"].astype(np.int64), d["which"].astype(np.int64)
        new = c0[spelled] == 0
        if new.any():
            strings = d["strings"].decode("utf-8", "surrogatepass").split(" ")
            need, of = np.unique(which[new], return_inverse=True)
            lg[spelled[new]] += spelling.value([strings[i] for i in need.tolist()])[of]
        codes, tokens, lengths, per = _together(d["codes"]), d["tokens"].astype(np.int64), d["lengths"].astype(np.int64), d["said"].astype(np.int64)
        begins = lambda n: np.cumsum(n) - n
        of = _together(d["alone"])
        base, known, cost = (np.add.reduceat(x[codes], begins(lengths))[of] for x in (np.log10(c0 + 0.1), (c0 > 0).astype(np.int64), lg))
        base, known = (np.add.reduceat(x, begins(per)) for x in (base, known))
        counts = np.insert(said, 0, 0) if d["none"] else said
        alone, both = counts[_together(d["keys"])][of], counts[_together(d["both"])]
        train = np.repeat(d["fold"] != 0, per)
        first = np.zeros(len(cost), bool)
        first[begins(per)] = True
        own = train.astype(np.int64)
        before = np.where(first, 0, np.insert(alone[:-1], 0, 0) - own)
        alone, both = alone - own, np.where(first, 0, both - own)
        level = _said_level(before)
        tries, fails = (np.bincount(level[train & w], minlength=SAID) for w in (before > 0, (before > 0) & (both <= 0)))
        tries, fails = np.append(tries, train.sum()), np.append(fails, (train & (alone <= 0)).sum())
        data = {n: d[n] for n in ("ids", "null", "fold", "tokens", "bytes", "said")} | {"base": base, "known": known, "cost": cost.astype("<f4"), "alone": _small(alone), "both": _small(both), "before": _small(before)}
        return pd.DataFrame({"chunk": [int(key[0])], "data": [_packed(data)], "tries": [tries.tolist()], "fails": [fails.tolist()]})

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def sentence_costs(words: np.ndarray, alone: np.ndarray, both: np.ndarray, before: np.ndarray, total: np.ndarray, tries: np.ndarray, fails: np.ndarray) -> np.ndarray:
    """log10 probability of sentences, from that of their words, mixed with how often training has the sentence among its
    ``total`` sentences, and it after the one before. ``tries`` and ``fails`` of training's own sentences tell the shares."""
    share = (fails + 0.5) / (tries + 0.5)
    with np.errstate(divide="ignore"):
        lg = np.logaddexp(words * math.log(10) + math.log(share[-1]), np.log(1 - share[-1]) + np.log(alone / np.maximum(total, 1)))
        left = share[_said_level(before)]
        after = np.logaddexp(lg + np.log(left), np.log(1 - left) + np.log(both / np.maximum(before, 1)))
    return np.where(before > 0, after, lg) / math.log(10)


def _final(n: int, v: int, tries: np.ndarray, fails: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                d = _unpacked(data)
                per, tokens, fold = (d[x].astype(np.int64) for x in ("said", "tokens", "fold"))
                counts = (d[x].astype(np.int64) for x in ("alone", "both", "before"))
                lg = sentence_costs(d["cost"].astype(np.float64), *counts, tries[-1] - np.repeat(fold != 0, per), tries, fails)
                score = np.add.reduceat(lg, np.cumsum(per) - per)
                columns = [fold == 0, tokens, d["known"], np.full(len(tokens), n), d["base"] - tokens * math.log10(n + 0.1 * (v + 1)), score, -score * math.log2(10) / d["bytes"]]
                names = [c.strip().split(" ")[0] for c in _SCORES.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(d["ids"], pa.int64(), mask=d["null"]), *map(pa.array, columns)], names)

    return run


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents whose crc32(doc_id as text) mod ``folds`` is 0 are held out (a null id is not); all others train, whole
    texts and every row. Null texts are empty and have just the end. n_known counts tokens seen in training.
    base_score is the unigram model's log10 probability with 0.1 added to each count, score the mixed model's. Without
    training documents all words are spelled, by even bits. Repeated rows are scored, and train, as often as they stand
    there; an empty table gives no rows. Other columns are not read. Words and sentences are
    told apart by KEY_BITS bits of their hashes.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(folds - 1)).cast("int")
    rows = docs.select(doc_id.alias("doc_id"), fold.alias("fold"), text.alias("text"))
    chunks = keep(rows.mapInArrow(_chunks(_kinds(rows.where("fold <> 0"))), _CHUNKS), "chunks")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    # the tree of hashes: groups of words by the top bits, the bits above on the driver
    top = min(PREFIX, max(0, math.ceil(math.log2(max(total, 1) / GROUP))))
    lists = chunks.where("bucket is not null").withColumn("g", F.shiftright("bucket", PREFIX - top).cast("long"))
    groups = keep(lists.where("words is not null").select("g", "bucket", "words", "types").groupBy("g").applyInPandas(_group(top), _GROUPS), "groups")
    found = groups.select("g", "v", "totals", "once", "part").orderBy("g").collect()  # 2^PREFIX at most
    v = sum(r["v"] for r in found)
    table = lambda name: np.array([np.frombuffer(r[name], "<f8") for r in found]).reshape(-1, STATES)
    totals, once = table("totals"), table("once")
    n = int(totals.sum())
    mixer, above = Mixer(LEVELS * LEVELS, 3), np.zeros((1 << top, STATES))
    parts = [r["part"] for r in found]
    if top and n:
        # the bits above the groups
        at, s = np.nonzero(totals)
        h = ((np.array([r["g"] for r in found], np.uint64)[at] << np.uint64(64 - top)) ^ _TOP_BIT).view(np.int64)
        c = totals[at, s].astype(np.int64)
        parts.append(Mixer(LEVELS * LEVELS, 3).part(*_learning_bits(h, s, c, totals.sum(1)[at], 0)))
        mixer.gather(parts)
        g = np.array([r["g"] for r in found if r["v"]], np.int64)
        root = np.repeat((g.astype(np.uint64) << np.uint64(64 - top)) ^ _TOP_BIT, STATES).view(np.int64)
        above[g] = path_costs(h, s, c, root, np.tile(np.arange(STATES), len(g)), 0, mixer).reshape(-1, STATES)
    else:
        mixer.gather(parts)
    # new words: as many as words seen once, by the kind of the last frequent word
    by_kind = np.stack([totals.sum(0), once.sum(0)]).reshape(2, KINDS + 1, KINDS + 1).sum(2)
    share = np.repeat((by_kind[1] + 0.5) / (by_kind[0] + 1), KINDS + 1)
    types = groups.select("g", "v", "types")
    spelling = Spelling(types.mapInArrow(_spelling_counts, _TABLE).groupBy("block").applyInPandas(_added, _TABLE).collect())  # the tables' size
    parts = types.mapInArrow(_spelling_parts(send(spelling)), "g long, part binary").orderBy("g").collect()  # 2^PREFIX at most
    spelling.mixer.gather([r["part"] for r in parts])
    answers = lists.select("chunk", "bucket", "g", "words", "sentences").groupBy("g").applyInPandas(_answers(top, send((mixer, above, np.log10(1 - share), np.log10(share)))), _ANSWERS)
    both = answers.unionByName(chunks.where("docs is not null").select("chunk", "docs"), allowMissingColumns=True)
    scored = keep(both.groupBy("chunk").applyInPandas(_scored(send(spelling)), _SCORED), "scored")
    tries, fails = np.zeros(SAID + 1), np.zeros(SAID + 1)
    for r in scored.select(F.posexplode(F.arrays_zip("tries", "fails"))).groupBy("pos").agg(F.sum("col.tries").alias("tries"), F.sum("col.fails").alias("fails")).collect():
        tries[r["pos"]], fails[r["pos"]] = r["tries"], r["fails"]
    return scored.select("data").mapInArrow(_final(n, v, tries, fails), _SCORES)


def _commonest(scored: DataFrame) -> DataFrame:
    """At most TOP pairs: those from a count on, in steps of a sixteenth of a power of two, so that nothing is sorted."""
    step = F.floor(F.log2("c") * 16)
    rows, least = 0, None
    for r in scored.where("c > 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 1024 at most
        rows += r["count"]
        if rows > TOP:
            break
        least = r["step"]
    return scored.where("c > 0").where(step >= least) if least is not None else scored.limit(0)
