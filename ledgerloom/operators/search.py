"""Indexes of a voucher table: trigrams of a text for searching, ranges of an order for paging.

Both are written once and read in part: a search reads the postings of a few trigrams and the blocks of ids that they name, a page
reads the ranges that hold it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.narration import normalised

GRAM = 3
#: Folders of postings, and ids in a block of rows.
BUCKETS, BLOCK = 64, 1 << 16
#: Rows, and postings, that a task which writes the index should sort.
ROWS, POSTINGS = 200_000, 500_000
#: Trigrams of a query that are looked up, its rarest; the text decides in the end.
LOOKED_UP = 4


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class TrigramIndex:
    """postings (bucket, gram, block, id), counts (gram, n) and rows (the table with block and _said, its normal text)."""

    postings: DataFrame
    counts: DataFrame
    rows: DataFrame


def write_trigram_index(rows: DataFrame, path: str, text: str = "narration", id: str = "id", most_rows: int = ROWS, most_postings: int = POSTINGS) -> TrigramIndex:
    """Index rows (id a long, each once) by the trigrams of their normalised text, in folders under path.

    A task sorts about most_rows rows or most_postings postings, and a block's rows or a block's postings of a trigram at least.
    """
    spark = rows.sparkSession
    made = rows.withColumn("block", F.floor(F.col(id) / BLOCK).cast("long")).withColumn("_said", normalised(F.col(text)))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, math.ceil(rows.count() / most_rows))
    made.repartition(tasks, "block").write.partitionBy("block").parquet(f"{path}/rows")
    made = spark.read.parquet(f"{path}/rows")
    # a trigram of many rows is dealt by their blocks over as many pieces of its bucket as keep a task's share bounded
    n = made.agg(F.sum(F.size(trigrams(F.col("_said"))).cast("long"))).first()[0] or 0
    pieces = max(1, math.ceil(n / (BUCKETS * most_postings)))
    piece = F.pmod(F.xxhash64("gram", "block"), F.lit(pieces))
    each = made.select("block", F.col(id).alias("id"), "_said").repartition(tasks, "id").select("block", "id", F.explode(trigrams(F.col("_said"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    each.repartition(max(least, BUCKETS * pieces), "bucket", piece).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return TrigramIndex(postings, spark.read.parquet(f"{path}/counts"), made)


def read_trigram_index(spark, path: str) -> TrigramIndex:
    return TrigramIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "counts", "rows")))


def candidates(index: TrigramIndex, phrase: str) -> DataFrame | None:
    """(block, id) of the rows that hold the phrase's rarest trigrams; None if it is too short to have any."""
    grams = sorted({phrase[i : i + GRAM] for i in range(len(phrase) - GRAM + 1)})
    if not grams:
        return None
    known = {r["gram"]: r["n"] for r in index.counts.where(F.col("gram").isin(grams)).collect()}
    rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
    buckets = [r[0] for r in index.counts.sparkSession.createDataFrame([(g,) for g in rarest], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    found = index.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(rarest))
    return found.groupBy("block", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).drop("n")


def search_phrase(index: TrigramIndex, phrase: str, id: str = "id") -> DataFrame:
    """Rows whose normalised text holds the normalised phrase, as by_phrase() of the ledger gives them.

    Only blocks that hold a candidate are read: their numbers, of a block for each 2^16 ids at most, go to the driver.
    """
    phrase = index.rows.sparkSession.createDataFrame([(phrase,)], "p string").select(normalised(F.col("p"))).first()[0]
    found, rows = candidates(index, phrase), index.rows
    if found is not None:
        blocks = [r[0] for r in found.select("block").distinct().collect()]
        rows = rows.where(F.col("block").isin(blocks)).join(found.withColumnRenamed("id", id), ["block", id], "left_semi")
    return rows.where(F.col("_said").contains(phrase)).drop("block", "_said")


@dataclass
class OrderedTable:
    """rows in ranges (range, the table's columns, place within the range from 0) and starts: by range, rows before it and in it."""

    rows: DataFrame
    starts: list[tuple[int, int, int]]
    order: list[str]


def write_ordered(rows: DataFrame, path: str, order: list[str], ranges: int) -> OrderedTable:
    """Sort a table once into so many ranges of the order, a folder each; order must tell rows apart."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt.sortWithinPartitions(*order).write.partitionBy("range").parquet(path)
    return read_ordered(spark, path, order)


def read_ordered(spark, path: str, order: list[str]) -> OrderedTable:
    rows = spark.read.parquet(path)
    counts = sorted((r["range"], r["n"]) for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, before = [], 0
    for number, n in counts:
        starts.append((number, before, n))
        before += n
    return OrderedTable(rows, starts, order)


def page(table: OrderedTable, first: int, count: int) -> DataFrame:
    """Rows first to first + count - 1 of the order, with place; only the ranges that hold them are read."""
    held = [(number, before) for number, before, n in table.starts if before < first + count and first < before + n]
    rows = table.rows.where(F.col("range").isin([number for number, _ in held]))
    before = F.coalesce(*[F.when(F.col("range") == number, F.lit(at).cast("long")) for number, at in held], F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*table.order)) - 1 + before
    return rows.withColumn("place", place).where(F.col("place").between(first, first + count - 1)).drop("range")
