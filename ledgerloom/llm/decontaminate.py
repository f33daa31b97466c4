"""Benchmark decontamination: SimHash of item-sized windows and rarest shingles propose, an exact check decides.

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A leak of an item
shares 5-word shingles with it; a shingle weighs ln(1 + N / (1 + the times it occurs in the N
documents)). A document is contaminated if a window of as many words as an item holds at least
THRESHOLD of the item's shingle weight.

A document that can pass holds one of the item's heaviest shingles, as many as weigh more than
1 - THRESHOLD of it: whoever holds none of them can't hold THRESHOLD. Only there are windows looked at, so a
stock phrase of many items, which is light in them, makes none. For such a shingle at word p of a text and
word j of an item of L words, the SimHash (over distinct words) of the window of L words from p - j
is looked up among the items of its length: the 64 bits are cut into BLOCKS of 8, and of two
fingerprints at most RADIUS apart one block differs in at most RADIUS // BLOCKS = 1 bit, so items are
indexed under every block value and its one-bit neighbours. No radius holds all windows that can
pass, as few lost shingles can be many words and light shingles can be most of them. So a document
is also proposed for every item of which it holds one of the heaviest shingles, and it is these that make the
search whole (README: how many the fingerprints alone find).

The check looks at every window that begins with one of the item's shingles. Any other window holds
no more than the one from its first such shingle, so no window that passes is missed. Only DataFrame
functions are used.

An item of fewer than five words is one shingle, its whole sequence, and leaks where a text has
these words in a row; items without words leak nowhere. Null and empty texts are clean, and so are
rows with a null doc_id, which are not looked at; repeated rows of a document share its windows and
are each reported; doc_id is taken to name one text and item_id one item; other columns are left
out; an empty benchmark leaves every document clean. Very long texts are cut into shingles whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import small, staged
from ledgerloom.llm.licenses import lowered, words_of

SHINGLE = 5
BITS, BLOCKS, RADIUS = 64, 8, 12
THRESHOLD = 0.8
#: 64-bit keys that may be broadcast after they were counted.
BROADCAST_KEYS = 2_000_000


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of `size` words, in order."""
    run = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))
    return F.slice(run, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))


def _placed_shingles(words: Column, sizes: list[int]) -> Column:
    """(place, shingle) of all runs of these sizes."""
    runs = [F.transform(shingle_hashes(words, k), lambda h, i: F.struct(i.alias("place"), h.alias("shingle"))) for k in sizes]
    return F.concat(*runs) if len(runs) > 1 else runs[0]


def simhash(words: Column) -> Column:
    """64-bit SimHash of the distinct words."""
    hashes = F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
    bits = [F.when(2 * ones(b) > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(fingerprint: Column, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 8 * b).bitwiseAND(F.lit(255)).cast("int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, similarity): the windows (from word start, an item's shingle) that hold at least threshold of an item."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(lowered(F.col(item_text))).alias("words")).withColumn("length", F.size("words")).where("length > 0")
    short = [F.when(F.col("length") == k, shingle_hashes(F.col("words"), k)) for k in range(1, SHINGLE)]
    items = staged(items.withColumn("shingles", F.coalesce(*short, shingle_hashes(F.col("words")))), "leak-items")
    sizes = [SHINGLE, *[r["length"] for r in items.where(F.col("length") < SHINGLE).select("length").distinct().collect()]]
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), words_of(lowered(F.col(text))).alias("words"))
    n_docs = docs.count()

    # places of the benchmark's shingles in all documents
    wanted = staged(items.select(F.explode("shingles").alias("shingle")).distinct(), "leak-shingles")
    found = rows.select("doc_id", F.inline(_placed_shingles(F.col("words"), sizes)))
    hits = staged(found.join(small(wanted, BROADCAST_KEYS), "shingle", "left_semi"), "leak-hits")
    counts = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))

    # the heaviest shingles of each item, of which a document that can pass has one
    weight = F.log(F.lit(1.0) + F.lit(float(n_docs)) / (F.lit(1.0) + F.coalesce("n", F.lit(0))))
    weighed = items.select("item_id", "length", F.explode(F.array_distinct("shingles")).alias("shingle")).join(counts, "shingle", "left").select("item_id", "length", "shingle", weight.alias("weight"))
    item = Window.partitionBy("item_id")
    heavier = item.orderBy(F.desc("weight"), "shingle").rowsBetween(Window.unboundedPreceding, -1)
    weighed = staged(weighed.withColumn("whole", F.sum("weight").over(item)).withColumn("before", F.coalesce(F.sum("weight").over(heavier), F.lit(0.0))), "leak-weights")
    heavy = staged(weighed.where(F.col("before") <= (1 - threshold + 1e-9) * F.col("whole")).select("shingle", "item_id"), "leak-heavy")

    # where windows begin that hold them as the item does
    places = items.select("item_id", "length", F.posexplode("shingles").alias("at", "shingle")).join(heavy, ["shingle", "item_id"])
    shapes = staged(places.groupBy("shingle").agg(F.collect_set(F.struct("length", "at")).alias("items")), "leak-shapes")
    starts = hits.join(small(shapes), "shingle").select("doc_id", "place", F.explode("items").alias("item")).select("doc_id", F.col("item.length").alias("length"), F.greatest(F.col("place") - F.col("item.at"), F.lit(0)).alias("start")).distinct()
    windows = staged(starts.groupBy("doc_id").agg(F.collect_list(F.struct("length", "start")).alias("windows")), "leak-windows")

    # fingerprints of those windows; short texts are one window, and a window ends where the text ends
    shape = F.transform("windows", lambda w: F.struct(w.length.alias("length"), F.greatest(F.least(w.start, F.size("words") - w.length), F.lit(0)).alias("start")))
    held = rows.join(small(windows.select("doc_id"), BROADCAST_KEYS), "doc_id", "left_semi")
    cut = held.join(windows, "doc_id").withColumn("windows", F.array_distinct(shape))
    cut = cut.select("doc_id", F.explode(F.transform("windows", lambda w: F.struct(w.length.alias("length"), w.start.alias("start"), F.slice("words", w.start + 1, w.length).alias("words")))).alias("w")).select("doc_id", "w.*")
    cut = staged(cut.select("doc_id", "length", "start", simhash(F.col("words")).alias("own")), "leak-fingerprints")

    near = lambda v: F.concat(F.array(v), F.array(*[v.bitwiseXOR(F.lit(1 << i)) for i in range(8)]))
    prints = items.select("item_id", "length", simhash(F.col("words")).alias("theirs"))
    index = prints.select("item_id", "length", "theirs", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), near(_block(F.col("theirs"), b)).alias("values")) for b in range(BLOCKS)])).alias("x"))
    index = staged(index.select("item_id", "length", "theirs", F.col("x.block").alias("block"), F.explode("x.values").alias("value")), "leak-index")
    probe = cut.select("doc_id", "length", "start", "own", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("own"), b).alias("value")) for b in range(BLOCKS)])).alias("x"))
    probe = probe.select("doc_id", "length", "start", "own", F.col("x.block").alias("block"), F.col("x.value").alias("value"))
    by_prints = probe.join(small(index), ["length", "block", "value"]).where(F.bit_count(F.col("own").bitwiseXOR(F.col("theirs"))) <= RADIUS)

    spots = hits.select("doc_id", "shingle", "place").distinct()
    by_shingles = spots.select("doc_id", "shingle").distinct().join(small(heavy), "shingle")
    pairs = staged(by_prints.select("doc_id", "item_id").union(by_shingles.select("doc_id", "item_id")).distinct(), "leak-pairs")

    # what the windows from each of the item's shingles hold; places differ, so a window of L words holds at most L - 4 of them
    spotted = pairs.join(small(weighed), "item_id").join(spots, ["doc_id", "shingle"])
    spotted = spotted.groupBy("doc_id", "item_id", "length", "whole").agg(F.sort_array(F.collect_list(F.struct("place", "shingle", "weight"))).alias("spots"))
    total = lambda xs: F.aggregate(F.array_distinct(F.transform(xs, lambda x: F.struct(x.shingle, x.weight.alias("weight")))), F.lit(0.0), lambda s, x: s + x.weight)
    last = F.greatest(F.col("length") - SHINGLE, F.lit(0))
    within = lambda x, i: F.filter(F.slice("spots", i + 1, last + 1), lambda y: y.place <= x.place + last)
    spotted = spotted.where(total(F.col("spots")) >= (threshold - 1e-9) * F.col("whole"))
    windows = F.transform("spots", lambda x, i: F.struct(x.place.alias("start"), (total(within(x, i)) / F.col("whole")).alias("similarity")))
    return spotted.select("doc_id", "item_id", F.explode(windows).alias("w")).select("doc_id", "item_id", "w.*").where(F.col("similarity") >= threshold - 1e-9)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Per row of docs: doc_id, contaminated boolean, n_items int, item_ids array (sorted), similarity double (the best, else 0)."""
    leaks = find_leaks(docs, benchmark, doc_id, text, **more)
    found = leaks.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    found = staged(found, "leak-documents")
    rows = docs.select(F.col(doc_id).alias("doc_id")).join(found, "doc_id", "left")
    none = F.array().cast(found.schema["item_ids"].dataType)
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(F.coalesce("item_ids", none)).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
