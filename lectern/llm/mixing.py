"""Mixing sources to target weights: fixed-length blocks, multinomial shards, per-source index permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import keep

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Words in a block, blocks in an output shard, documents in a bucket of the running sum, rows summed up at once.
BLOCK, SHARD, BUCKET, CHUNK = 64, 1024, 256, 4096
SEED = 20240501
#: Ordinals are split at this power of two, so that products with a multiplier stay within 64 bits up to 2^42 blocks.
SPLIT = 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted from each source: ``share`` of all words dealt by weight (repeating), none over ``most`` times its
    source; what is above is dealt again by weight among the others until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * w[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in over)
    return out


def _step(n: int, sid: int, epoch: int) -> tuple[int, int]:
    """Multiplier (prime to n) and offset of a source's index permutation i -> (a * i + c) mod n in an epoch."""
    mixed = (SEED * 6364136223846793005 + (sid * 2 + epoch + 1) * 1442695040888963407) % (1 << 61)
    a = max(1, (int(n * 0.6180339887) + mixed % max(1, n // 7 + 1)) % n) if n > 1 else 1
    while math.gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 0, (mixed >> 17) % n


def plan(spark: SparkSession, stats: Sequence[tuple], weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source, from ``stats`` of (source, words) in rank order: what the mix takes from it."""
    wanted = targets([s[1] for s in stats], weights, share, most)
    rows = []
    for sid, ((source, words), want) in enumerate(zip(stats, wanted)):
        blocks = -(-words // BLOCK)
        take = min(round(want / words * blocks), math.floor(most * blocks)) if words else 0
        steps = [_step(blocks, sid, e) if blocks else (0, 0) for e in range(math.ceil(most))]
        fields = [(a, (a << SPLIT) % blocks if blocks else 0, c) for a, c in steps]
        rows.append(F.struct(
            F.lit(sid).alias("sid"), F.lit(source).cast("string").alias("source"), F.lit(words).cast("long").alias("source_size"), F.lit(float(want)).alias("target"),
            F.lit(blocks).cast("long").alias("blocks"), F.lit(take).cast("long").alias("take"),
            F.array(*[F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(("a", "b", "c"), f)]) for f in fields]).alias("steps"),
        ))
    if not rows:
        return spark.createDataFrame([], "sid int, source string, source_size long, target double, blocks long, take long, steps array<struct<a:long,b:long,c:long>>")
    return spark.range(1).select(F.inline(F.array(*rows)))


def _with_sum_before(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same ``key`` and smaller ``at``. It is summed
    within chunks of CHUNK places and over the chunks, so that no task sorts all rows of a key."""
    rows = rows.withColumn("__chunk", F.floor(F.col(at) / CHUNK))
    sums = rows.groupBy(key, "__chunk").agg(F.sum(value).alias("__sum"))
    sums = sums.select(key, "__chunk", (F.sum("__sum").over(W.partitionBy(key).orderBy("__chunk")) - F.col("__sum")).alias("__base"))
    inside = F.sum(value).over(W.partitionBy(key, "__chunk").orderBy(at)) - F.col(value)
    return rows.withColumn("__inside", inside).join(sums, [key, "__chunk"]).withColumn("before", F.col("__base") + F.col("__inside")).drop("__chunk", "__base", "__inside")


def slots(spark: SparkSession, sources: DataFrame, takes: Sequence[int]) -> DataFrame:
    """Output slots (shard, sid, ordinal, block). Each shard draws its slots' sources, that is multinomial counts, by
    the share of blocks still to take; a source's draws beyond its take are void and what it lacks fills shards at
    the end. The ordinals of a source are then 0 to take - 1, mapped to blocks by its permutation of each epoch."""
    total = sum(takes)
    if not total:
        return spark.createDataFrame([], "shard long, sid int, ordinal long, block long")
    marks, run = [], 0
    for t in takes:
        run += t
        marks.append(run)
    u = F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(total))
    drawn = F.aggregate(F.array(*[F.lit(m).cast("long") for m in marks]), F.lit(0), lambda acc, m: acc + (m <= u).cast("int"))
    counts = spark.range(0, total).select(F.floor(F.col("id") / SHARD).alias("shard"), drawn.alias("sid")).groupBy("shard", "sid").agg(F.count("*").alias("n"))
    placed = keep(_with_sum_before(counts, "sid", "shard", "n").select("shard", "sid", "n", (F.col("before") + F.col("n")).alias("upto")), "shards")
    last = placed.groupBy("sid").agg(F.max("upto").alias("got"))
    lack = sources.join(last, "sid", "left").select(
        F.lit(-(-total // SHARD)).cast("long").alias("shard"), "sid", F.coalesce("got", F.lit(0)).alias("lo"), F.col("take").alias("hi")
    )
    runs = placed.select("shard", "sid", (F.col("upto") - F.col("n")).alias("lo"), F.col("upto").alias("hi")).unionByName(lack)
    runs = runs.join(F.broadcast(sources.select("sid", "take", "blocks", "steps")), "sid").withColumn("hi", F.least("hi", "take")).where("lo < hi")
    # long runs are cut, so that no row expands to more than a shard of slots
    cut = runs.withColumn("lo2", F.explode(F.expr(f"sequence(lo, hi - 1, {SHARD}L)"))).withColumn("hi2", F.least(F.col("hi"), F.col("lo2") + SHARD))
    each = cut.withColumn("ordinal", F.explode(F.expr("sequence(lo2, hi2 - 1)")))
    step = F.element_at("steps", (F.floor(F.col("ordinal") / F.col("blocks")) + 1).cast("int"))
    place = F.pmod(F.col("ordinal"), F.col("blocks"))
    low, high = place.bitwiseAND((1 << SPLIT) - 1), F.shiftright(place, SPLIT)
    block = F.pmod(F.pmod(step["a"] * low, F.col("blocks")) + F.pmod(step["b"] * high, F.col("blocks")) + step["c"], F.col("blocks"))
    return each.select((F.col("shard") + F.floor((F.col("lo2") - F.col("lo")) / SHARD)).alias("shard"), "sid", "ordinal", block.alias("block"))


def _mark() -> Column:
    """Tells rows of different doc_id or text apart, and gives the order of documents in their source."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


class Mix:
    """The parts of one mix: ``sources`` (a row per source), ``spans`` (a row per document: rid, doc_id, source, size,
    mark, sid, start) and ``pieces`` (a row per taken piece of a document: rid, block, ordinal, shard, lo, hi in words)."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0):
        spark = docs.sparkSession
        sized = keep(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), _mark().alias("mark")), "sizes")
        stats = [(r[0], r[1] or 0) for r in sized.groupBy("source").agg(F.sum("size")).collect()]  # a row per source
        stats.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
        self.sources = plan(spark, stats, weights, share, most)
        # buckets are ranges of the mark, so the order of marks is that of the buckets
        bits = min(28, max(0, sized.count() // BUCKET).bit_length())
        bucket = F.shiftright(F.conv(F.substring("mark", 1, 7), 16, 10).cast("long"), 28 - bits)
        known = sized.join(F.broadcast(self.sources.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", bucket)
        parts = _with_sum_before(known.groupBy("sid", "bucket").agg(F.sum("size").alias("part")), "sid", "bucket", "part").drop("part")
        inside = W.partitionBy("sid", "bucket").orderBy("mark").rowsBetween(W.unboundedPreceding, 0)
        spans = known.withColumn("upto", F.sum("size").over(inside)).join(parts, ["sid", "bucket"])
        self.spans = keep(
            spans.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "size", "mark", "sid", (F.col("before") + F.col("upto") - F.col("size")).alias("start")), "spans"
        )
        takes = [r[0] for r in self.sources.orderBy("sid").select("take").collect()]
        self.slots = slots(spark, self.sources, takes)
        held = self.spans.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
        # there is a slot for every block taken: neither side may be broadcast, whatever size Spark expects of it
        self.pieces = held.hint("merge").join(self.slots, ["sid", "block"]).select(
            "rid", "sid", "block", "shard", "ordinal",
            F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0)).alias("lo"),
            F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size")).alias("hi"),
        )


def taken_words(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken (words in the mix, repeats counted).

    Null texts are empty, null is a source of its own, after all others. Repeated rows are separate documents. An
    empty table gives no rows. Only these columns of ``docs`` are read: doc_id, text, source.
    """
    mix = Mix(docs, weights, share, most)
    got = mix.pieces.groupBy("rid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return (
        mix.spans.join(got, "rid", "left")
        .join(F.broadcast(mix.sources.select("sid", "source_size", "target")), "sid")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` as the mix has them: a row per document and epoch with the words taken, in the document's order.

    A document taken whole keeps its text as it is; of others the taken blocks stay, joined by blanks, and by line
    ends where blocks between them are left out. A document of which an epoch takes nothing has no row there. Other
    columns stay, whatever their names; n_chars, if there, is counted anew. Null ids and sources, null and empty texts,
    repeated rows and empty tables are treated as by ``taken_words``.
    """
    mix = Mix(docs, weights, share, most)
    spans = mix.pieces.join(F.broadcast(mix.sources.select("sid", "blocks")), "sid").withColumn("epoch", F.floor(F.col("ordinal") / F.col("blocks")))
    runs = spans.groupBy("rid", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__runs"), F.sum(F.col("hi") - F.col("lo")).alias("__taken"))
    owners = mix.spans.select("rid", F.col("source").alias("__source"), F.col("mark").alias("__mark"), F.col("size").alias("__size"))
    twins = owners.groupBy("__source", "__mark").count().where("count > 1").limit(1).count()
    # equal rows (id, source and text) are numbered, so that each meets its own runs
    nth = (lambda source, mark, order: F.row_number().over(W.partitionBy(source, mark).orderBy(order))) if twins else (lambda *_: F.lit(1))
    owners = owners.withColumn("__nth", nth("__source", "__mark", "rid"))
    chosen = runs.join(owners, "rid").drop("rid", "epoch")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(row, _mark().alias("__own"), F.col("source").cast("string").alias("__from"))
    keyed = keyed.withColumn("__place", nth("__from", "__own", "__own"))
    full = keyed.join(chosen, F.col("__from").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__mark")) & (F.col("__place") == F.col("__nth")))
    whole = F.col("__taken") >= F.col("__size")
    split = F.filter(F.split(F.col("__row.text"), SPACE), lambda w: w != "")
    full = full.withColumn("__words", F.when(~whole, split))
    cut = F.expr("""
        aggregate(__runs, struct('' as t, cast(-1 as bigint) as last),
          (acc, r) -> struct(concat(acc.t, case when acc.last < 0 then '' when acc.last = r.lo then ' ' else '\n' end,
                             array_join(slice(__words, cast(r.lo as int) + 1, cast(r.hi - r.lo as int)), ' ')) as t, r.hi as last),
          acc -> acc.t)""")
    text = F.when(whole, F.col("__row.text")).otherwise(cut)
    new = {"text": text, "n_chars": F.length(text)}
    return full.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("__row").getField(c).alias(c) for c in docs.columns])


#: The mix in DuckDB. Draws and shards don't change what is taken, so it follows from the takes and the permutations.
ORACLE = rf"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS mark FROM documents),
    stats AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
    weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * words AS most, 1.5::DOUBLE * sum(words) OVER () AS wanted FROM stats),
    ranked AS (
        SELECT *, coalesce(sum(most) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w, row_number() OVER (ORDER BY most / w, sid) AS r
        FROM weighed WINDOW before AS (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT (wanted - capped)::DOUBLE AS rest, open_w AS open_w, r FROM ranked WHERE (wanted - capped)::DOUBLE * w / open_w <= most ORDER BY r LIMIT 1),
    targets AS (
        SELECT sid, source, words, (words + {BLOCK - 1}) // {BLOCK} AS blocks,
            coalesce((SELECT CASE WHEN t.r >= l.r THEN l.rest * t.w / l.open_w END FROM level l), t.most)::DOUBLE AS target FROM ranked t),
    taken AS (SELECT *, CASE WHEN words > 0 THEN least(round_even(target / words * blocks, 0)::BIGINT, 2 * blocks) ELSE 0 END AS take FROM targets),
    mixed AS (SELECT sid, blocks AS n, epoch, ({SEED}::HUGEINT * 6364136223846793005 + (sid * 2 + epoch + 1)::HUGEINT * 1442695040888963407) % 2305843009213693952 AS m FROM taken, range(2) e(epoch) WHERE blocks > 0),
    first_steps AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, (floor(n * 0.6180339887::DOUBLE)::HUGEINT + m % greatest(1, n // 7 + 1)) % n) ELSE 1 END AS a0 FROM mixed),
    steps AS (SELECT sid, epoch, (m // 131072) % n AS c, CASE WHEN n > 1 THEN (SELECT min(a0 + x) FROM range(1000) g(x) WHERE gcd((a0 + x)::HUGEINT, n::HUGEINT) = 1) % n ELSE 0 END AS a FROM first_steps),
    slots AS (
        SELECT o.sid, ((s.a::HUGEINT * (o.ordinal % o.blocks) + s.c) % o.blocks)::BIGINT AS block
        FROM (SELECT sid, blocks, unnest(range(take)) AS ordinal FROM taken WHERE take > 0) o JOIN steps s ON s.sid = o.sid AND s.epoch = o.ordinal // o.blocks),
    times AS (SELECT sid, block, count(*) AS times FROM slots GROUP BY ALL),
    spans AS (
        SELECT doc_id, s.source, size, t.sid, t.words, t.target, row_number() OVER () AS rid,
            sum(size) OVER (PARTITION BY t.sid ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
        FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source),
    pieces AS (SELECT rid, sid, size, start, unnest(range((start // {BLOCK})::BIGINT, ((start + size - 1) // {BLOCK})::BIGINT + 1)) AS block FROM spans WHERE size > 0),
    got AS (
        SELECT rid, sum(times * (least((block + 1) * {BLOCK} - start, size) - greatest(block * {BLOCK} - start, 0)))::BIGINT AS taken
        FROM pieces JOIN times USING (sid, block) GROUP BY rid)
    SELECT doc_id, source, size::BIGINT AS size, words AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM spans LEFT JOIN got USING (rid)"""
