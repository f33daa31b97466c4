"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; row r of n gets the fractional
rank (r - 1/2) / n. Sorting all rows by fractional rank interleaves the sources in proportion,
so every contiguous cut of the sequence holds the mixture of the whole; shard s takes positions
[ceil(s N / S), ceil((s + 1) N / S)), so shard row counts differ by at most one (law "rows").

Both ranks are exact yet no source is sorted in one task: rows are bucketed by their place in
the order, bucket counts give offsets, and only a bucket is sorted in a task. Rows of one fractional
rank, of which sources of equal size have one each, follow each other by the seeded hash; where more of
them meet than a task should sort, they are bucketed by that hash.
Null sources form a stratum of their own; repeated rows are placed like any others (rows alike in
every ordering column are interchangeable); an empty table gives an empty result. Other columns, whatever their
names, come along, so whole rows are shuffled: where texts are very long, shard the keys and join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ROWS_PER_BUCKET, exact_rank, hash_bits, hash_bucket, portable_hash, running_before, small, staged, stratum

LAW = "rows"
SEED = 17


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 16; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.coalesce(F.crc32(text), F.lit(0)).cast("long")


def _tie_ranks(placed: DataFrame, most: int, order: list[str]) -> DataFrame:
    """placed (part, slice, h) with place, the rank by order (which begins with part and h), where more than most rows may share a part.

    In a slice each such part is cut by its hash into 2^bits pieces, and rows between them are a piece each; only pieces are sorted.
    """
    heavy = placed.groupBy("slice", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    bits = F.least(F.ceil(F.log2(F.col("n") / most)), F.lit(40)).cast("int")
    entries = heavy.select("slice", F.struct("part", bits.alias("bits"), (F.pow(F.lit(2.0), bits) + 1).cast("long").alias("pieces")).alias("entry"))
    entries = staged(entries.groupBy("slice").agg(F.collect_list("entry").alias("heavy")), "shard-ties")
    top = F.shiftright("h", 24) + F.lit(1 << 39)
    piece = lambda bits: F.floor(top / F.pow(F.lit(2.0), F.lit(40) - bits)).cast("long")
    upto = F.aggregate("heavy", F.lit(0).cast("long"), lambda a, e: a + F.when(e["part"] < F.col("part"), e["pieces"]).when(e["part"] == F.col("part"), piece(e["bits"]) + 1).otherwise(0))
    cut = placed.join(small(entries), "slice", "left").withColumn("bucket", F.coalesce(upto, F.lit(0).cast("long"))).drop("heavy")
    ranked = exact_rank(cut, ["slice"], "bucket", order, "in_slice")
    starts = running_before(placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), [], "slice", "n", "before").select("slice", "before")
    return ranked.join(starts, "slice").withColumn("place", F.col("before") + F.col("in_slice"))


def interleave_shards(rows: DataFrame, n_shards: int, source: str = "source", key: list[str | Column] | None = None, seed: int = SEED, n_rows: int | None = None) -> DataFrame:
    """rows with `shard` int and `slot` long (gapless from 0 within a shard) added, in place of columns so named.

    key: what the seeded shuffle and its ties are ordered by. n_rows: the row count, if known.
    rows must give the same rows each time it is read, as tables do.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    n = rows.count() if n_rows is None else n_rows
    key = [F.col(k) if isinstance(k, str) else k for k in key or ["doc_id"]]
    names = [f"k{i}" for i in range(len(key))]
    taken = ("shard", "slot")
    row = F.struct(*[c for c in rows.columns if c not in taken])
    placed = rows.select(row.alias("row"), stratum(source).alias("stratum"), *[k.alias(name) for k, name in zip(key, names)])
    placed = placed.withColumn("h", portable_hash(seed, *names))
    placed = placed.withColumn("bucket", hash_bucket(F.col("h"), hash_bits(n)))
    placed = exact_rank(placed, ["stratum"], "bucket", ["h", *names], "rank").drop("bucket")

    sizes = rows.groupBy(stratum(source).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    placed = placed.join(sizes, "stratum").withColumn("part", (F.col("rank") - F.lit(0.5)) / F.col("size"))
    slices = max(1, -(-n // ROWS_PER_BUCKET))
    placed = placed.withColumn("slice", F.floor(F.col("part") * F.lit(slices)))
    order = ["part", "h", "stratum"]
    many = sizes.limit(ROWS_PER_BUCKET + 1).count() > ROWS_PER_BUCKET
    placed = _tie_ranks(placed, ROWS_PER_BUCKET, order) if many else exact_rank(placed, [], "slice", order, "place")

    placed = placed.withColumn("cut", F.expr(f"((place - 1) * {n_shards}L) div {max(1, n)}L"))
    slot = F.expr(f"place - 1 - (cut * {n}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("row.*", F.col("cut").cast("int").alias("shard"), slot.alias("slot"))
