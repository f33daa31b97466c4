"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

Source token shares p are raised to an exponent a in [0, 1] and normalised: w ~ p^a. The exponent
is the largest that reaches the target entropy (a share of ln k), raised as far as the repetition
limit asks: as a grows to 1 the weights return to the natural ones, entropy falls and so does the
largest number of repeats. Both are monotone, so the exponent is found by repeated section; each
step is one aggregation over the source table, and only its few sums reach the driver.

The budget is in tokens. By default it is the least at which no source is cut below one whole
pass, so every document is kept. Each source is then realised as whole passes (blocks), each a
seeded permutation of its documents, and the last block is cut where the source's budget ends:
its documents are taken in permuted order while their running token sum stays within the budget.

Null sources form a source of their own; documents without words count one token, so that they
are placed like any other; an empty table gives an empty result. Repeated rows are all taken or,
where the cut falls between rows equal in the whole key, taken together or not at all. Very long texts are
counted whole where they are read. Other columns of mix_sources() come along, whatever their names; those of
block_slots() must not be named _stratum, _h, _b or _r.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import exact_rank, hash_bits, hash_bucket, portable_hash, running_before, small, staged, stratum

SEED = 29
SECTIONS, STEPS = 32, 5


def token_count(text: Column) -> Column:
    """Whitespace-separated words, at least one."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def _least_exponent(logs: DataFrame, measure, wanted: float) -> float:
    """Least exponent in [0, 1] at which measure (falling in the exponent) is at most wanted."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        points = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        sums = logs.agg(*[x for i, a in enumerate(points) for x in (F.sum(F.exp(a * F.col("lp"))).alias(f"z{i}"), F.sum(F.exp(a * F.col("lp")) * F.col("lp")).alias(f"e{i}"))], F.max("lp").alias("top"), F.min("lp").alias("low")).first()
        good = [i for i, a in enumerate(points) if measure(a, sums[f"z{i}"], sums[f"e{i}"], sums["top"], sums["low"]) <= wanted]
        if not good:
            return hi
        if good[0] == 0:
            return lo
        lo, hi = points[good[0] - 1], points[good[0]]
    return hi


def _entropy(a: float, z: float, e: float, top: float, low: float) -> float:
    """Of w = p^a / z."""
    return math.log(z) - a * e / z


def mixing_plan(totals: DataFrame, target_entropy: float, max_repeats: float, budget: int | None = None) -> DataFrame:
    """Per source of totals (_stratum, _tokens): weight, repeats, whole passes and tokens of the cut block."""
    stats = totals.agg(F.sum("_tokens").alias("t"), F.max("_tokens").alias("m"), F.count(F.lit(1)).alias("k")).first()
    all_tokens, most, k = stats["t"] or 1, stats["m"] or 1, stats["k"] or 1
    logs = totals.withColumn("lp", F.log(F.col("_tokens") / F.lit(float(all_tokens))))

    def repeats(a, z, e, top, low):
        """Of the smallest source: (w / p) * budget / tokens of all."""
        spent = budget / all_tokens if budget else math.exp(top - a * top) * z
        return math.exp((a - 1) * low) / z * spent

    reached = 0.0
    if k > 1:
        natural = logs.agg(F.sum(F.exp("lp") * -F.col("lp"))).first()[0]
        wanted = target_entropy * math.log(k)
        # entropy falls from ln k at 0: the largest exponent that still reaches the target
        reached = 1.0 if natural >= wanted else _least_exponent(logs, _entropy, wanted)
        reached = max(reached, _least_exponent(logs, repeats, max_repeats))
    z = logs.agg(F.sum(F.exp(reached * F.col("lp")))).first()[0] or 1.0
    spent = float(budget) if budget else most / math.exp(reached * math.log(most / all_tokens)) * z
    plan = logs.withColumn("weight", F.exp(reached * F.col("lp")) / F.lit(z))
    plan = plan.withColumn("_share", F.col("weight") * F.lit(spent) / F.col("_tokens"))
    plan = plan.withColumn("_passes", F.floor(F.col("_share") + F.lit(1e-9)).cast("int"))
    plan = plan.withColumn("_rest", F.floor((F.col("_share") - F.col("_passes")) * F.col("_tokens") + F.lit(1e-6)))
    return plan.select("_stratum", "weight", F.col("_share").alias("repeats"), "_passes", F.greatest("_rest", F.lit(0)).cast("long").alias("_rest"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: list[str] | None = None, target_entropy: float = 0.9, max_repeats: float = 1.5, budget: int | None = None, seed: int = SEED, tag: str = "mix") -> DataFrame:
    """docs with every row once for each pass it is in, and n_tokens long, weight and repeats double, epoch int, in place of columns so named.

    The text is read twice (to count, then to emit) and never shuffled.
    """
    key = key or ["doc_id"]
    slim = docs.select(stratum(source).alias("_stratum"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], token_count(F.col(text)).alias("_n"))
    slim = staged(slim, tag)
    names = [f"_k{i}" for i in range(len(key))]
    n = slim.count()
    totals = staged(slim.groupBy("_stratum").agg(F.sum("_n").alias("_tokens")), f"{tag}-totals")
    plan = staged(mixing_plan(totals, target_entropy, max_repeats, budget), f"{tag}-plan")

    # The cut block: the bucket in which a source's rest ends is found from bucket sums, and only
    # that bucket's rows are sorted. The last row taken is the source's threshold.
    bits = hash_bits(n)
    slim = slim.join(small(plan), "_stratum").withColumn("_h", portable_hash(seed, "_passes", *names)).withColumn("_b", hash_bucket(F.col("_h"), bits))
    sums = slim.groupBy("_stratum", "_b").agg(F.sum("_n").alias("_t"))
    sums = running_before(sums, ["_stratum"], "_b", "_t", "_before").join(small(plan.select("_stratum", "_rest")), "_stratum")
    cut = sums.where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_t") > F.col("_rest"))).select("_stratum", "_b", "_before")
    order = Window.partitionBy("_stratum", "_b").orderBy("_h", *names)
    place = F.struct("_h", *names)
    last = slim.join(small(cut), ["_stratum", "_b"]).withColumn("_sum", F.col("_before") + F.sum("_n").over(order))
    last = last.where(F.col("_sum") <= F.col("_rest")).groupBy("_stratum").agg(F.max(place).alias("_last"))
    # no row taken in the cut bucket: all rows of the buckets before it are
    ends = cut.groupBy("_stratum").agg(F.max("_b").alias("_cut"))
    plan = staged(plan.join(ends, "_stratum", "left").join(last, "_stratum", "left"), f"{tag}-cuts")

    made = ("epoch", "weight", "repeats", "n_tokens")
    row = F.struct(*[c for c in docs.columns if c not in made])
    out = docs.select(row.alias("row"), stratum(source).alias("_stratum"), token_count(F.col(text)).alias("n_tokens"), *[F.col(k).alias(name) for k, name in zip(key, names)])
    out = out.join(small(plan), "_stratum").withColumn("_h", portable_hash(seed, "_passes", *names))
    b = hash_bucket(F.col("_h"), bits)
    more = F.col("_cut").isNotNull() & ((b < F.col("_cut")) | ((b == F.col("_cut")) & F.col("_last").isNotNull() & (place <= F.col("_last"))))
    out = out.withColumn("_copies", F.col("_passes") + F.coalesce(more, F.lit(False)).cast("int")).where("_copies > 0")
    epochs = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
    return out.select("row", "n_tokens", "weight", "repeats", epochs.alias("epoch")).select("row.*", "n_tokens", "weight", "repeats", "epoch")


def block_slots(mixed: DataFrame, source: str = "source", key: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """mixed with `slot` long: each (source, epoch) block's place in its seeded permutation, gapless from 0."""
    key = key or ["doc_id"]
    bits = hash_bits(mixed.count())
    rows = mixed.withColumn("_stratum", stratum(source)).withColumn("_h", portable_hash(seed, "epoch", *key))
    rows = rows.withColumn("_b", hash_bucket(F.col("_h"), bits))
    rows = exact_rank(rows, ["_stratum", "epoch"], "_b", ["_h", *key], "_r")
    return rows.withColumn("slot", F.col("_r") - 1).drop("_stratum", "_h", "_b", "_r")
