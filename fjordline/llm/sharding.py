"""Sharding by proportional stratified interleaving.

Within each source the rows are put in a seeded random order; the row of rank r
among n gets the fractional rank (r - 1/2) / n; all rows are sorted by it and cut
into shards of equal row counts, so every shard holds the mixture of the whole.

Neither a source nor the whole table is ever ranked in one task.  The random key
is cut into buckets, a small table of counts by (source, bucket) gives every
bucket the number of rows before it, and only rows of one bucket are sorted
together.  The same is done for the global order; how many rows precede a bucket
of fractional ranks follows from the sources' sizes alone, in integers.

Defined results: a null source is a source of its own; a null id or text is
allowed; repeated rows are separate rows; an empty table gives an empty result;
columns named like the results (shard, slot) are replaced, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def buckets(rows: int) -> int:
    """Small buckets as long as their table stays small, then 200,000 rows in each."""
    return max(1, -(-rows // 200_000), min(-(-rows // 2_000), 4_096))


def interleave(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", source_col: str = "source", seed: int = 2024, tie: list[str] | None = None) -> DataFrame:
    """docs with `shard` (0 .. shards - 1) and `slot` (place in the shard, gapless from 0)."""
    clash = {c: f"user{c}" for c in docs.columns if c.startswith("_fj_")}
    if clash:
        return interleave(docs.withColumnsRenamed(clash), shards, clash.get(id_col, id_col), clash.get(source_col, source_col), seed, [clash.get(t, t) for t in tie or []]).withColumnsRenamed({b: a for a, b in clash.items()})
    docs = docs.drop("shard", "slot")
    total = docs.count()
    if not total:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    n_buckets = buckets(total)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    keyed = docs.withColumns({"_fj_s": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), "_fj_h": key, "_fj_t": F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])})
    keyed = keyed.withColumn("_fj_b", F.expr(f"(cast(conv(substr(_fj_h, 1, 8), 16, 10) as bigint) * {n_buckets}L) div 4294967296L"))
    in_source = Window.partitionBy("_fj_s")
    counts = keyed.groupBy("_fj_s", "_fj_b").agg(F.count("*").alias("_fj_c"))
    counts = counts.select("_fj_s", "_fj_b", F.sum("_fj_c").over(in_source).alias("_fj_n"), F.coalesce(F.sum("_fj_c").over(in_source.orderBy("_fj_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_fj_off"))
    own = Window.partitionBy("_fj_s", "_fj_b").orderBy("_fj_h", id_col, *(tie or []), "_fj_t")
    ranked = keyed.withColumn("_fj_r", F.row_number().over(own)).join(counts, ["_fj_s", "_fj_b"]).withColumn("_fj_r", F.col("_fj_r") + F.col("_fj_off"))
    ranked = ranked.withColumn("_fj_k", F.expr(f"((2 * _fj_r - 1) * {n_buckets}L) div (2 * _fj_n)")).drop("_fj_off")
    # Rows of a source of n rows whose bucket is at most k: the r with (2 r - 1) * buckets < 2 n (k + 1).
    before = counts.select("_fj_s", "_fj_n").distinct().select("_fj_n", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("_fj_k"))
    before = before.select((F.col("_fj_k") + 1).cast("long").alias("_fj_k"), F.expr(f"((((_fj_k + 1) * 2L * _fj_n - 1) div {n_buckets}L) + 1) div 2").alias("c"))
    before = before.groupBy("_fj_k").agg(F.sum("c").alias("_fj_off")).unionAll(docs.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(0).cast("long")))
    place = Window.partitionBy("_fj_k").orderBy(((2 * F.col("_fj_r") - 1) / (2.0 * F.col("_fj_n"))), "_fj_s", "_fj_r")
    placed = ranked.withColumn("_fj_p", F.row_number().over(place)).join(before, "_fj_k").withColumn("_fj_p", F.col("_fj_p") + F.col("_fj_off") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((_fj_p * {shards}L) div {total}L as int)"))
    return placed.withColumn("slot", F.expr(f"_fj_p - ((cast(shard as long) * {total}L + {shards - 1}L) div {shards}L)")).select(*docs.columns, "shard", "slot")
