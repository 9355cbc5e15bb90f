"""MinHash near-duplicates by probability Jaccard: ProbMinHash signatures, banding, exact verification, classes.

The weight of a shingle is 1 + ln(count in the text). Two texts are linked if the probability Jaccard similarity of
their weighted five-word shingles is 0.8 or more, as computed exactly from both; banding only proposes pairs. With 25
bands of 5 components a pair of similarity 0.8 shares no band once in 20,000 cases, and ever more rarely above.

Equal texts are one node from the start. Pairs are compared in rounds, and after each the links found so far make
provisional classes; later rounds leave out what is of one class already. First every node is compared with the least
leader (least node) of its buckets, then with each bucket's leader, then with each bucket's last node. Nodes that are
still of another class than their bucket's leader are then searched for, as queries in blocks, among all nodes of the
buckets that this class leads; only links come out. So no two classes stay apart that a link in a bucket joins, and a
group of copies costs a few pairs a node, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import batches_of, keep
from .shingles import SIMILARITY, shingle_hashes

BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Rows up to which a counted table is broadcast, and elements in a numpy step.
BROADCAST_ROWS, STEP = 500_000, 250_000
#: Bytes of a batch of shingles that goes to be signed or compared.
SIGNED_AT_ONCE = "4m"
#: Nodes of the two sides of a block.
QUERIES, ROWS_AT_ONCE = 128, 512
#: Shared shingles of two blocks that are compared at once.
COLUMNS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function with public constants (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, ascending, and their weights."""
    values, counts = np.unique(np.asarray(hashes, np.int64), return_counts=True)
    return values, 1.0 + np.log(counts)


def signatures(values: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, m: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash signatures of many documents at once; ``doc`` tells whose each element is.

    Each element's arrivals are a Poisson process of rate equal to its weight, drawn from its hash alone; an arrival
    falls on one of the m components, which keeps the element that came first. Element after element leaves once its
    next arrival is later than every component of its document; the rest arrive again. Elements come in steps of
    STEP, so that a very long text needs no more memory than many short ones.
    """
    first = np.full(docs * m, np.inf)
    kept = np.zeros(docs * m, np.uint64)
    for lo in range(0, len(values), STEP):
        step = slice(lo, lo + STEP)
        _arrive(values[step], weights[step], doc[step], first, kept, m)
    return kept.reshape(docs, m)


def _arrive(values: np.ndarray, weights: np.ndarray, doc: np.ndarray, first: np.ndarray, kept: np.ndarray, m: int) -> None:
    """Let elements arrive; ``first`` and ``kept`` hold each component's earliest time and its element."""
    values = values.astype(np.int64).view(np.uint64)
    time = np.zeros(len(values))
    state = _mix(values)
    latest = first.reshape(-1, m).max(1)
    with np.errstate(over="ignore"):
        while len(values):
            state = _mix(state)
            u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(u) / weights
            alive = time < latest[doc]
            values, weights, doc, time, state = values[alive], weights[alive], doc[alive], time[alive], state[alive]
            at = doc * m + (_mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = time == first[at]
            kept[at[won]] = values[won]
            latest = first.reshape(-1, m).max(1)


def bands(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(signature), BANDS), np.uint64)
        for r in range(ROWS):
            out = _mix(out ^ signature[:, r::ROWS])
        return out.view(np.int64)


def _weighted_lists(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists laid end to end: their different hashes, ascending in each list, with weights and the list's number."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])]))
    return values[starts], 1.0 + np.log(np.diff(np.append(starts, len(values)))), doc[starts]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of rows (doc_id, node, s); rows without shingles have none. Shingles stay in Arrow's flat buffers, and rows
    are signed in runs of at most STEP shingles."""
    for batch in batches:
        lists = batch.column("s")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(at)
        found, lo = [], 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP, "right")) - 1)
            rows = sizes[lo:hi][sizes[lo:hi] > 0]
            if len(rows):
                found.append(bands(signatures(*_weighted_lists(values[at[lo] : at[hi]], rows), len(rows))).ravel())
            lo = hi
        ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
        out = pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), out], ["doc_id", "node", "bands"])


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of the weighted hashes of two texts: the sum over shared elements i of
    1 / sum_j max(a_j / a_i, b_j / b_i)."""
    (x, u), (y, v) = weighted(a), weighted(b)
    shared, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    # max(a_j / a_i, b_j / b_i) is the first where the ratio a_j / b_j is at least that of i
    u_all, v_all = np.concatenate([u, np.zeros(len(y) - len(shared))]), np.zeros(len(x) + len(y) - len(shared))
    v_all[ix] = v[iy]
    v_all[len(x) :] = np.delete(v, iy)
    with np.errstate(divide="ignore"):
        ratio = np.where(v_all > 0, u_all / np.where(v_all > 0, v_all, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    r, below, above = ratio[order], np.concatenate([[0], np.cumsum(v_all[order])]), np.concatenate([np.cumsum(u_all[order][::-1])[::-1], [0]])
    place = np.searchsorted(r, ratio[ix], "left")
    return float((1.0 / (above[place] / u_all[ix] + below[place] / v_all[ix])).sum())


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": [probability_jaccard(x, y) for x, y in zip(batch["sa"], batch["sb"])]})


def _node() -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


class _Verifier:
    """Exact similarities of pairs of nodes; the shingles of nodes asked for are read once more from the texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, s: the shingles of the wanted nodes. A row that stands in the table twice is read twice."""
        wanted = keep(wanted.select("node").distinct().join(self.nodes.select("node", "rep"), "node"), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        texts = self.docs.withColumn("own", _node()).join(few, (F.col("doc_id").eqNullSafe(F.col("rep"))) & (F.col("own") == F.col("node")))
        return keep(texts.select("node", shingle_hashes(F.col("text"), short=True).alias("s")), "sets")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        with batches_of(self.docs.sparkSession, SIGNED_AT_ONCE):
            return keep(both.mapInPandas(_compare, "a binary, b binary, similarity double").distinct(), "similar")


def components(links: DataFrame) -> DataFrame:
    """node, label: connected components of ``links(a, b)``, label the least node. Labels spread to neighbours and
    then jump to their label's label, so the rounds grow with the logarithm of the longest chain."""
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = keep(labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("near", "label").alias("next")), "spread")
        jump = spread.select(F.col("node").alias("at"), F.col("next").alias("to"))
        new = spread.join(jump, F.col("next") == F.col("at"), "left").select("node", "label", F.least("next", F.coalesce("to", F.col("next"))).alias("next"))
        new = keep(new, "labels")
        labels = new.select("node", F.col("next").alias("label"))
        if new.where("label <> next").limit(1).count() == 0:
            return labels


def _labelled(rows: DataFrame, labels: DataFrame, other: str) -> DataFrame:
    """``rows`` with the class of ``node`` (own) and of the node in column ``other`` (led)."""
    mine = labels.select(F.col("node").alias("n1"), F.col("label").alias("l1"))
    theirs = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
    j = rows.join(mine, F.col("node") == F.col("n1"), "left").join(theirs, F.col(other) == F.col("n2"), "left")
    return j.withColumn("own", F.coalesce("l1", "node")).withColumn("led", F.coalesce("l2", other)).drop("n1", "n2", "l1", "l2")


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def overlaps(q: list[tuple[np.ndarray, np.ndarray]], r: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs of weighted sets: the weight of their shared elements in the one, in the other, and their number."""
    shared = np.intersect1d(np.unique(np.concatenate([v for v, _ in q])), np.unique(np.concatenate([v for v, _ in r])), assume_unique=True)
    sides = []
    for side in (q, r):
        values, weights = np.concatenate([v for v, _ in side]), np.concatenate([w for _, w in side]).astype(np.float32)
        at = np.searchsorted(shared, values)
        found = np.flatnonzero((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values)) if len(shared) else np.empty(0, np.int64)
        order = found[np.argsort(at[found], kind="stable")]
        sides.append((np.repeat(np.arange(len(side)), [len(v) for v, _ in side])[order], at[order], weights[order]))
    out = [np.zeros((len(q), len(r)), np.float32) for _ in range(3)]
    for lo in range(0, len(shared), COLUMNS):
        dense = []
        for (row, at, weight), side in zip(sides, (q, r)):
            i = slice(*np.searchsorted(at, (lo, lo + COLUMNS)))
            heavy, plain = np.zeros((len(side), COLUMNS), np.float32), np.zeros((len(side), COLUMNS), np.float32)
            heavy[row[i], at[i] - lo], plain[row[i], at[i] - lo] = weight[i], 1
            dense.append((heavy, plain))
        (hq, pq), (hr, pr) = dense
        for total, part in zip(out, (hq @ pr.T, pq @ hr.T, pq @ pr.T)):
            total += part
    return out[0], out[1], out[2]


def most_similar(q: list[tuple[np.ndarray, np.ndarray]], r: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Upper bounds of the probability Jaccard similarities of all pairs, exact where all weights are 1.

    With weights x and y of 1 or more, sum_j max(x_j / x_i, y_j / y_i) is at least S / max(x_i, y_i), where S is the weight
    outside the shared elements and the larger one inside, and max(x_i, y_i) is at most x_i + y_i - 1.
    """
    a, b, n = overlaps(q, r)
    x, y = np.array([w.sum() for _, w in q])[:, None], np.array([w.sum() for _, w in r])[None]
    return (a + b - n) / np.maximum(x - a + y - b + np.maximum(a, b), 1e-9)


def _search(similarity: float):
    """Links between a block of queries and a block of nodes of one pool: those of another class that share a band. Two
    classes need one link."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            sets = [[weighted(s) for s in side["s"]] for side in (queries, rows)]
            possible = most_similar(*sets) >= similarity - 1e-3
            own = pd.factorize(pd.concat([queries["own"], rows["own"]]))[0]
            mine, theirs = own[: len(queries)], own[len(queries) :]
            held, bands_ = np.stack(rows["bands"].to_numpy()), np.stack(queries["bands"].to_numpy())
            led, x, nodes = (rows["own"] == rows["pool"]).to_numpy(), queries["node"].tolist(), rows["node"].tolist()
            linked = set()
            for i in range(len(queries)):
                at = np.flatnonzero(possible[i] & (theirs != mine[i]))
                for j in at[(held[at] == bands_[i]).any(1)].tolist():
                    if (mine[i], theirs[j]) not in linked and (led[j] or x[i] < nodes[j]) and probability_jaccard(queries["s"].iat[i], rows["s"].iat[j]) >= similarity:
                        out.append((min(x[i], nodes[j]), max(x[i], nodes[j])))
                        linked.add((mine[i], theirs[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _across(members: DataFrame, nodes: DataFrame, labels: DataFrame, verify: _Verifier, similarity: float) -> DataFrame:
    """Links (a, b) of one bucket between different classes that no round has compared.

    The buckets led by a class make its pool. Queries are the pool's nodes of other classes, searched among all its
    nodes in blocks of QUERIES by ROWS_AT_ONCE; a block of one side is sent to every block of the other.
    """
    near = _labelled(members, labels, "leader").select("node", "own", F.col("led").alias("pool")).distinct()
    near = keep(near, "near")
    lost = keep(near.where("own <> pool"), "lost")
    pools = lost.groupBy("pool").agg(F.count("*").alias("m")).join(near.groupBy("pool").agg(F.count("*").alias("n")), "pool")
    pools = keep(pools.select("pool", F.ceil(F.col("m") / QUERIES).alias("qs"), F.ceil(F.col("n") / ROWS_AT_ONCE).alias("rs")), "pools")
    sets = verify.sets(near.join(pools, "pool", "left_semi"))
    full = sets.dropDuplicates(["node"]).join(nodes.select("node", "bands"), "node")
    full = keep(full, "pooled")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    q = lost.join(pools, "pool").withColumn("q", F.pmod(F.xxhash64("node"), F.col("qs"))).withColumn("r", spread(F.col("rs"))).select("pool", "q", "r", "node", "own").join(full, "node")
    r = near.join(pools, "pool").withColumn("r", F.pmod(F.xxhash64("node"), F.col("rs"))).withColumn("q", spread(F.col("qs"))).select("pool", "q", "r", "node", "own").join(full, "node")
    # both sides come of the same tables; names of their own keep their columns apart
    q, r = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (q, r))
    found = q.groupBy("pool", "q", "r").cogroup(r.groupBy("pool", "q", "r")).applyInPandas(_search(similarity), "a binary, b binary")
    return keep(found.distinct(), "found")


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), and nodes (node, rep, copies, label, links): ``label`` is the least node of the class."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    hashed = texts.select("doc_id", _node().alias("node"), shingle_hashes(F.col("text"), short=True).alias("s"))
    with batches_of(docs.sparkSession, SIGNED_AT_ONCE):
        signed = keep(hashed.mapInArrow(_sign, "doc_id long, node binary, bands array<bigint>"), "signed")
    nodes = keep(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
    entries = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    ends = entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    ends = keep(ends, "leaders")
    members = keep(entries.join(ends, "bucket").where("node <> leader"), "members")
    verify = _Verifier(texts, nodes)
    compared = verify(members.groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"))
    for other in ("leader", "last"):
        labels = components(compared.where(F.col("similarity") >= similarity))
        open_pairs = _pairs(_labelled(members, labels, other).where("own <> led"), "node", other).join(compared, ["a", "b"], "left_anti")
        compared = compared.union(verify(keep(open_pairs, "pairs")))
    links = compared.where(F.col("similarity") >= similarity).select("a", "b")
    links = links.union(_across(members, nodes, components(links), verify, similarity)).distinct()
    links = keep(links, "linked")
    labels = components(links)
    ends = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    classed = keep(
        nodes.join(labels, "node", "left").join(ends.withColumnRenamed("a", "end"), F.col("node") == F.col("end"), "left")
        .select("node", "rep", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "classed",
    )
    return signed.select("doc_id", "node"), classed


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, class_id (the least doc_id of its class), links (of its text to
    different texts, those compared), copies (rows of the same text).

    Classes are the connected components of links and equal texts. Null texts count as empty; empty texts are equal
    to one another. Texts of fewer than five words have one shingle, of all their words. Repeated rows are copies. An
    empty table gives no rows; other columns are not read.
    """
    rows, classed = _classes(docs, similarity)
    least = keep(classed.groupBy("label").agg(F.min("rep").alias("class_id")), "classes")
    of_node = keep(classed.join(least, "label").select("node", "class_id", "links", "copies"), "of-node")
    return rows.join(of_node, "node").select("doc_id", "class_id", "links", "copies")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, and of its texts the least node; null ids come
    last. Rows are told apart by doc_id and text, so documents of one id, or of none, that are of different classes
    all have their row; of rows with the same id and text one stays. All columns stay."""
    rows, classed = _classes(docs, similarity)
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "node")
    chosen = classed.groupBy("label").agg(F.min(order).alias("c")).select(F.col("c.rep").alias("__rep"), F.col("c.node").alias("__node"))
    chosen = keep(chosen, "kept")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__rep")) & (_node() == F.col("__node"))
    kept = docs.join(few, same, "left_semi")
    repeated = rows.groupBy("doc_id", "node").count().where("count > 1").join(few, F.col("doc_id").eqNullSafe(F.col("__rep")) & (F.col("node") == F.col("__node")), "left_semi")
    return kept.withColumn("__own", _node()).dropDuplicates(["doc_id", "__own"]).drop("__own") if repeated.limit(1).count() else kept
