"""Duplicate vouchers: imported rows against those already booked.

Candidates have the same type, amounts within a cent and dates within some days. A score adds up
what speaks for a pair. Each booked voucher is given to one import at most; imports are served in
their order, each taking its best voucher left. Candidates are an equi-join on type and cents (with
their neighbours), so no pair beyond them is made.

Serving in order is done by deferred acceptance: every import proposes to its best voucher left, a voucher
keeps the earliest import that proposes, and the rejected propose again. As all vouchers rank imports alike,
this ends with what serving one after the other gives. Rounds are joins keyed by import or by voucher, so
the rows of an account meet in many tasks. Imports that want the same vouchers in the same order, which
nobody else wants, are served at once before the rounds: the k-th takes the k-th.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.functions.dates import month_key
from ledgerloom.functions.narration import alike
from ledgerloom.operators.ledger import side_sum
from ledgerloom.operators.rounds import written

#: Points of a pair.
BASE, SAME_DAY, NEAR_DAY, EACH_TEXT, MOST = 50, 20, 10, 5, 100


def candidates(imports: DataFrame, booked: DataFrame, days: int = 0, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """Scored pairs (keys, type, cents, booked_date, import_seq, booked_seq, score, reasons), cents and date of the booked row.

    Both tables: keys, seq, gl_date, amount, type, vch_type, narration, particulars.
    """
    if not 0 <= days <= 3:
        raise ValueError("days must be 0 to 3")
    cents = F.round(F.col("amount") * 100).cast("long")
    sides = {}
    for name, df in (("i", imports), ("b", booked)):
        sides[name] = df.select(*keys, "type", *[F.col(c).alias(f"{name}_{c}") for c in ("seq", "gl_date", "amount", "vch_type", "narration", "particulars")], cents.alias("_cents"))
    left = sides["i"].withColumn("_cents", F.explode(F.array(F.col("_cents") - 1, F.col("_cents"), F.col("_cents") + 1)))
    apart = F.abs(F.datediff("i_gl_date", "b_gl_date"))
    pairs = left.join(sides["b"], [*keys, "type", "_cents"]).where((apart <= days) & (F.abs(F.col("i_amount") - F.col("b_amount")) <= F.lit("0.01").cast(MONEY)))
    same_type = F.lower("i_vch_type") == F.lower("b_vch_type")
    narration, particulars = (alike(F.col(f"i_{c}"), F.col(f"b_{c}")) for c in ("narration", "particulars"))
    reasons = F.array_compact(F.array(F.when(apart == 0, "same day").otherwise("near day"), F.when(same_type, "voucher type"), F.when(narration, "narration"), F.when(particulars, "particulars")))
    points = F.lit(BASE) + F.when(apart == 0, SAME_DAY).otherwise(NEAR_DAY) + sum(F.when(F.coalesce(x, F.lit(False)), EACH_TEXT).otherwise(0) for x in (same_type, narration, particulars))
    return pairs.select(*keys, "type", F.round(F.col("b_amount") * 100).cast("long").alias("cents"), F.col("b_gl_date").alias("booked_date"), F.col("i_seq").alias("import_seq"), F.col("b_seq").alias("booked_seq"), F.least(points, F.lit(MOST)).alias("score"), reasons.alias("reasons"))


def _like_minded(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """pairs with _taken: true for the pair an import of a closed group gets, false for the group's others, null outside such groups.

    A group holds the imports with one list of vouchers, best first; it is closed if no other import wants any of them.
    """
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "import_seq").orderBy(F.desc("score"), "booked_seq")))
    lists = ranked.groupBy(*keys, "import_seq").agg(F.bit_xor(F.xxhash64("booked_seq", "_rank")).alias("_list"), F.count(F.lit(1)).alias("_wants"))
    suitors = pairs.groupBy(*keys, "booked_seq").agg(F.count(F.lit(1)).alias("_suitors"))
    whole = ranked.join(lists, [*keys, "import_seq"]).join(suitors, [*keys, "booked_seq"])
    groups = whole.groupBy(*keys, "_list", "_wants").agg(F.count(F.lit(1)).alias("_n"), F.min("_suitors").alias("_fewest"), F.max("_suitors").alias("_most"))
    closed = groups.where((F.col("_fewest") == F.col("_most")) & (F.col("_n") == F.col("_most") * F.col("_wants"))).select(*keys, "_list", "_wants")
    places = lists.join(closed, [*keys, "_list", "_wants"]).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_list", "_wants").orderBy("import_seq")))
    served = ranked.join(places.select(*keys, "import_seq", "_place"), [*keys, "import_seq"], "left")
    return served.withColumn("_taken", F.col("_rank") == F.col("_place")).select(*pairs.columns, "_taken")


def _round(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pairs still possible after one round of proposals, and those settled by it (_taken).

    A voucher that an import holds is lost to all later imports. Where the holder is the earliest of all imports that
    could still want it, the pair is settled and both leave.
    """
    best = Window.partitionBy(*keys, "import_seq").orderBy(F.desc("score"), "booked_seq")
    asked = pairs.withColumn("_asks", F.row_number().over(best) == 1)
    vouchers = asked.groupBy(*keys, "booked_seq").agg(F.min("import_seq").alias("_first"), F.min(F.when(F.col("_asks"), F.col("import_seq"))).alias("_holder"))
    seen = asked.join(vouchers, [*keys, "booked_seq"]).withColumn("_taken", F.col("_asks") & (F.col("import_seq") == F.col("_first")))
    settled = F.max("_taken").over(Window.partitionBy(*keys, "import_seq"))
    free = F.col("_holder").isNull() | (F.col("_holder") != F.col("_first")) & (F.col("import_seq") <= F.col("_holder"))
    return seen.withColumn("_settled", settled).where(F.col("_taken") | ~F.col("_settled") & free).select(*pairs.columns, "_taken")


def assign(pairs: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """One-to-one matches of candidates, as serving imports in order gives them."""
    pairs = written(pairs, "duplicate-pairs")
    first = written(_like_minded(pairs, keys), "duplicate-rounds")
    matches = first.where("_taken").drop("_taken")
    rest = first.where("_taken IS NULL").drop("_taken")
    while not rest.isEmpty():
        step = written(_round(rest, keys), "duplicate-rounds")
        matches = matches.unionByName(step.where("_taken").drop("_taken"))
        rest = step.where("NOT _taken").drop("_taken")
    return matches


def best_candidates(pairs: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """For each import the best pair, the earliest voucher among equals, whether or not another import takes it."""
    best = F.max_by(F.struct("booked_seq", "score", "reasons"), F.struct("score", -F.col("booked_seq"))).alias("best")
    return pairs.groupBy(*keys, "import_seq").agg(best).select(*keys, "import_seq", "best.*")


def annotate(imports: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """imports with status (Duplicate or New), matched_seq, score and reasons."""
    found = matches.select(*keys, F.col("import_seq").alias("seq"), F.col("booked_seq").alias("matched_seq"), "score", "reasons")
    out = imports.join(found, [*keys, "seq"], "left")
    return out.withColumn("status", F.when(F.col("matched_seq").isNull(), "New").otherwise("Duplicate"))


def reconciliation(imports: DataFrame, booked: DataFrame) -> DataFrame:
    """By account and month: sums of imported, booked and duplicate rows, from one pass over their union.

    imports carries status.
    """
    parts = [imports.select("account", "gl_date", "amount", "type", F.lit("imported").alias("kind")), booked.select("account", "gl_date", "amount", "type", F.lit("booked").alias("kind")), imports.where("status = 'Duplicate'").select("account", "gl_date", "amount", "type", F.lit("duplicate").alias("kind"))]
    rows = parts[0].union(parts[1]).union(parts[2]).withColumn("month", month_key(F.col("gl_date")))
    rows = rows.withColumns({k: F.when(F.col("kind") == k, F.col("amount")) for k in ("imported", "booked", "duplicate")})
    sums = [side_sum(side, kind).alias(f"{kind}_{side.lower()}") for kind in ("imported", "booked", "duplicate") for side in ("DEBIT", "CREDIT")]
    return rows.groupBy("account", "month").agg(*sums, *[F.count(kind).alias(f"{kind}_n") for kind in ("imported", "booked", "duplicate")])


def by_match_status(imports: DataFrame, status: str) -> DataFrame:
    """Annotated imports that are Duplicate or New, or all."""
    if status not in ("all", "Duplicate", "New"):
        raise ValueError("status must be all, Duplicate or New")
    return imports if status == "all" else imports.where(F.col("status") == status)


def duplicate_closing(imports: DataFrame, opening: Column) -> DataFrame:
    """By account: sums of the duplicates and the opening moved by them."""
    sums = by_match_status(imports, "Duplicate").groupBy("account").agg(side_sum("DEBIT").alias("debit"), side_sum("CREDIT").alias("credit"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("closing", (opening + F.col("debit") - F.col("credit")).cast(MONEY))


def with_closings(months: DataFrame, opening: Column) -> DataFrame:
    """reconciliation() with the running closing of each of its three series, and a row "TOTAL" for each account with its last closings."""
    order = Window.partitionBy("account").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = ("imported", "booked", "duplicate")
    months = months.withColumns({f"{k}_closing": (opening + F.sum(F.col(f"{k}_debit") - F.col(f"{k}_credit")).over(order)).cast(MONEY) for k in kinds})
    sums = [F.sum(c).cast(months.schema[c].dataType).alias(c) for k in kinds for c in (f"{k}_debit", f"{k}_credit", f"{k}_n")]
    total = months.groupBy("account").agg(F.lit("TOTAL").alias("month"), *sums, *[F.max_by(f"{k}_closing", "month").alias(f"{k}_closing") for k in kinds])
    return months.unionByName(total)


def full_outer_months(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Month tables side by side with zeros for months that one of them lacks, and whether they agree to a cent."""
    left = a.select("account", "month", *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select("account", "month", *[F.col(c).alias(f"b_{c}") for c in columns])
    both = left.join(right, ["account", "month"], "full_outer").na.fill(0)
    same = F.lit(True)
    for c in columns:
        same = same & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= F.lit("0.01").cast(MONEY))
    return both.withColumn("agrees", same)
