"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in the order (size, doc_id); each has the same
expected number of copies, target / source size. The prefix sum of the expected
copies starts at one offset per source, and a document comes out once for every
integer that its stretch of the sum crosses. The order by size makes the words
taken follow the target closely. No document comes out more than CAP times.

A source of any size is spread over tasks: the rank of a document is the count of
all smaller (size, slot) cells, from a table of counts, plus its rank in its cell. So are
any number of sources: their order comes from sorted ranges and the sums of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelore.llm.textkit import WORD, shuffle_width, stored

#: Weights of the sources in code-point order, repeated; percent of all sizes to share; most copies.
WEIGHTS, SHARE_PERCENT, CAP = (3, 1, 2), 150, 2
#: Cells that the documents of one source and size are dealt over, by a hash of the id: id * FACTOR, modulo 2^32, its upper bits.
SLOTS, FACTOR = 1024, 2_654_435_761


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _slot(doc_id: Column) -> Column:
    spread = F.pmod(doc_id.cast("long"), F.lit(1 << 31)) * F.lit(FACTOR) % F.lit(1 << 32)
    return F.coalesce(F.floor(spread / F.lit((1 << 32) // SLOTS)).cast("int"), F.lit(0))


def _offset(source: Column) -> Column:
    """The offset of a source in [0, 1), the same at each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("\x00null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The pool is ``share_percent`` of all sizes. A source gets the least of ``cap`` times
    its size and its weight times a level, the level chosen such that the pool is used
    up: which is what repeated resharing of the excess leads to.
    """
    ranked = _with_sums(sizes, [F.col("source").asc_nulls_last()], {"k": F.lit(1).cast("long")})
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(cap)).withColumn("level", F.col("cap") / F.col("w"))
    ranked = _with_sums(ranked, ["level", "k"], {"before": F.col("cap"), "w_before": F.col("w")})
    everything = ranked.agg(F.sum("w").alias("w"), F.sum("source_size").alias("n")).first()
    # the level if this source and all with a higher level stay below their caps; the first such source, which has the highest try, fixes it
    tried = (F.lit(float(everything["n"] or 0) * (share_percent / 100.0)) - F.col("before")) / (F.lit(float(everything["w"] or 0)) - F.col("w_before"))
    water = ranked.agg(F.max(F.when(tried <= F.col("level"), tried)).alias("water")).first()["water"]
    target = F.col("cap") if water is None else F.when(F.col("level") <= F.lit(water), F.col("cap")).otherwise(F.col("w") * F.lit(water))
    return ranked.select("source", "source_size", target.alias("target"))


def _with_sums(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over all rows that come before in the order: those of earlier ranges, of which there are as many as shuffle partitions, and those before in the row's own."""
    sorted_ = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = stored(sorted_, "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before(Window.orderBy("_range"))), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = at.withColumns({n: F.coalesce(F.sum(c).over(before(Window.partitionBy("_range").orderBy("_at"))), F.lit(0)) for n, c in sums.items()})
    return inside.join(F.broadcast(earlier), "_range").select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): one row per row of ``docs`` (doc_id, text, source).

    Null texts have size 0; a null source is a source of its own, the last one. Documents
    of size 0 stand first in their source and come out like any other, taking no words.
    Equal rows share their copies as equals. An empty table gives an empty result.
    """
    return _mixed(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _slot(F.col("doc_id")).alias("slot")), **options)


def _mixed(rows: DataFrame, **options) -> DataFrame:
    """``mix`` of rows (doc_id, source, size, slot); other columns come along."""
    # a few numbers per document, counted once and read three times
    rows = stored(rows, "sizes")
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size", "slot")]
    cells = rows.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    # counts per (source, size), then per (source, band of sizes): no window has more rows than there are sizes in a band
    flat = cells.groupBy("source", "size").agg(F.sum("n").alias("n")).withColumn("band", F.floor(F.sqrt("size")))
    bands = flat.groupBy("source", "band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    run = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    start = bands.select("source", "band", F.coalesce(F.sum("n").over(run("source", by="band")), zero).alias("from_band"))
    wanted = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    flat = flat.withColumn("from_size", F.coalesce(F.sum("n").over(run("source", "band", by="size")), zero))
    base = flat.join(start, (flat["source"].eqNullSafe(start["source"])) & (flat["band"] == start["band"])).select(flat["source"], "size", (F.col("from_band") + F.col("from_size")).alias("from_flat"))
    cells = cells.withColumn("from_slot", F.coalesce(F.sum("n").over(run("source", "size", by="slot")), zero))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("doc_id", *more)))
    low = ranked.join(cells.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("slot").alias("t2"), "from_slot"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("slot") == F.col("t2"))).drop("s2", "z2", "t2")
    low = low.join(base.select(F.col("source").alias("s3"), F.col("size").alias("z3"), "from_flat"), F.col("source").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3"))).drop("s3", "z3")
    low = low.join(wanted.select(F.col("source").alias("s4"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s4"))).drop("s4")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("from_flat") + F.col("from_slot") + F.col("rank")
    crossed = F.floor(_offset(F.col("source")) + rate * at) - F.floor(_offset(F.col("source")) + rate * (at - 1))
    return low.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), *more)


def mix_report(docs: DataFrame) -> DataFrame:
    """The digest that query op6 returns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it.

    A row is known by two hashes of its id, source and text, so texts move once. Rows that
    share all three take their copies in the order of a hash of the whole row.
    """
    key = [F.xxhash64(F.lit(k), F.isnull("doc_id"), "doc_id", F.isnull("source"), "source", F.isnull("text"), "text") for k in (0, 1)]
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _slot(F.col("doc_id")).alias("slot"), key[0].alias("_k0"), key[1].alias("_k1"))
    # the number of rows with that many copies or more, of rows that look the same
    times = _mixed(rows, **options).groupBy("_k0", "_k1").agg(F.count("*").alias("_n"), *[F.count_if(F.col("copies") >= k).alias(f"_c{k}") for k in range(1, options.get("cap", CAP) + 1)])
    times = stored(times, "copies")
    joined = docs.withColumns({"_k0": key[0], "_k1": key[1]}).join(times.hint("shuffle_hash"), ["_k0", "_k1"])
    place = F.lit(1)
    if times.where("_n > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("_k0", "_k1").orderBy(F.xxhash64(*docs.columns)))
    some = sum((F.when(F.col("_place") <= F.col(c), 1).otherwise(0) for c in times.columns if c.startswith("_c")), F.lit(0))
    joined = joined.withColumn("_place", place).withColumn("_some", some).where("_some > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_some")))).select(*docs.columns)


MIX_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM d GROUP BY source),
a AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][k % {len(WEIGHTS)} + 1]::DOUBLE AS w, source_size * {CAP}.0::DOUBLE AS cap FROM s),
b AS (SELECT *, cap / w AS level, sum(w) OVER () AS w_all, (sum(source_size) OVER ())::DOUBLE * {SHARE_PERCENT / 100} AS pool,
  coalesce(sum(cap) OVER p, 0) AS before, coalesce(sum(w) OVER p, 0) AS w_before FROM a WINDOW p AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (pool - before) / (w_all - w_before) AS try FROM b),
e AS (SELECT *, max(CASE WHEN try <= level THEN try END) OVER () AS water FROM c),
t AS (SELECT source, source_size, CASE WHEN level <= coalesce(water, 'inf'::DOUBLE) THEN cap ELSE w * water END AS target,
  ('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM e),
o AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, coalesce((((doc_id % 2147483648) + 2147483648) % 2147483648) * {FACTOR} % 4294967296 // {(1 << 32) // SLOTS}, 0), doc_id NULLS FIRST, r) AS n FROM d),
x AS (SELECT o.doc_id, o.size, t.source_size, t.target, t.u, o.n, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(u + rate * n) - floor(u + rate * (n - 1)))::BIGINT AS taken FROM x"""
