"""Ledger operators: balances, monthly rollups, duplicate numbers, filters and edits of vouchers.

A ledger table has (account, seq, gl_date, amount, type, ...): seq orders the rows of an account.
Windows are always split by account; scans over all rows of an account cut large ones (scans.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY, signed
from ledgerloom.functions.dates import month_key
from ledgerloom.functions.narration import normalised, search_pattern
from ledgerloom.operators import scans

SIDES = ("DEBIT", "CREDIT")


def side_sum(side: str, amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(F.col("type") == side, F.col(amount))), F.lit(0)).cast(MONEY)


def valid_only(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("type").isin(*SIDES))


def totals(ledger: DataFrame, *keys: str) -> DataFrame:
    """Debit, credit and count of rows with a side, over all or by keys."""
    return valid_only(ledger).groupBy(*keys).agg(side_sum("DEBIT").alias("debit"), side_sum("CREDIT").alias("credit"), F.count(F.lit(1)).alias("n"))


def type_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Values that stand in more than one row."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def running_balance(ledger: DataFrame, opening: Column | None = None, most: int = scans.MOST) -> DataFrame:
    """ledger with balance: the account's opening and all signed amounts up to the row."""
    start = F.lit(0) if opening is None else opening
    rows = scans.running_sum(ledger, ["account"], ["seq"], signed(F.col("amount"), F.col("type")), "_moved", most)
    return rows.withColumn("balance", (start + F.col("_moved")).cast(MONEY)).drop("_moved")


def monthly_summary(ledger: DataFrame) -> DataFrame:
    """By account and month: count, sums, the first row's balance as it stands after and before it, the last row's balance."""
    rows = valid_only(ledger).withColumn("month", month_key(F.col("gl_date")))
    effect = signed(F.col("amount"), F.col("type"))
    return rows.groupBy("account", "month").agg(
        F.count(F.lit(1)).alias("n"),
        side_sum("DEBIT").alias("debit"),
        side_sum("CREDIT").alias("credit"),
        F.min_by("balance", "seq").alias("first_balance"),
        F.min_by((F.col("balance") - effect).cast(MONEY), "seq").alias("opening"),
        F.max_by("balance", "seq").alias("closing"),
    )


def month_closings(ledger: DataFrame, opening: Column | None = None, rolling: bool = True) -> DataFrame:
    """By account and month: sums, net and closing; rolling adds up the months, else a month stands for itself (cash books)."""
    months = valid_only(ledger).groupBy("account", month_key(F.col("gl_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), side_sum("DEBIT").alias("debit"), side_sum("CREDIT").alias("credit"))
    months = months.withColumn("net", (F.col("debit") - F.col("credit")).cast(MONEY))
    start = F.lit(0) if opening is None else opening
    order = Window.partitionBy("account").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.withColumn("closing", (start + (F.sum("net").over(order) if rolling else F.col("net"))).cast(MONEY))


def in_order(months: DataFrame) -> DataFrame:
    """Month rows by account and month, as reports list them; a total comes last."""
    return months.orderBy("account", F.col("month") == "TOTAL", "month")


def largest_months(months: DataFrame) -> DataFrame:
    """By account: the largest sum of any month on either side, the scale of a chart of the months."""
    return months.groupBy("account").agg(F.max(F.greatest("debit", "credit")).alias("largest"))


def with_grand_total(months: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Sums by key and a row "TOTAL" over all."""
    rolled = months.rollup(key).agg(F.grouping(key).alias("all"), *[F.sum(c).cast(months.schema[c].dataType).alias(c) for c in sums])
    return rolled.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col(key)).alias(key), *sums)


def closing_balance(ledger: DataFrame, opening: Column) -> DataFrame:
    """By account: opening plus debits less credits."""
    return totals(ledger, "account").select("account", (opening + F.col("debit") - F.col("credit")).cast(MONEY).alias("closing"))


def back_computed_opening(ledger: DataFrame) -> DataFrame:
    """By account: the first row's balance with its own amount taken back."""
    before = F.col("balance") - signed(F.col("amount"), F.col("type"))
    return ledger.groupBy("account").agg(F.min_by(before, "seq").cast(MONEY).alias("opening"))


def from_date(ledger: DataFrame, boundary: str) -> DataFrame:
    """Rows on or after the boundary; rows without a date go."""
    return ledger.where(F.col("gl_date") >= F.to_date(F.lit(boundary)))


def period(ledger: DataFrame, first: str, last: str) -> DataFrame:
    return ledger.where(F.col("gl_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def is_suspense() -> Column:
    return F.lower(F.coalesce("particulars", F.lit(""))).contains("suspense")


def by_status(vouchers: DataFrame, status: str) -> DataFrame:
    """all, suspense or modified."""
    return vouchers.where({"all": F.lit(True), "suspense": is_suspense(), "modified": F.coalesce("modified", F.lit(False))}[status])


def by_ledger(vouchers: DataFrame, name: str) -> DataFrame:
    return vouchers.where(F.col("particulars") == name)


def search_narration(vouchers: DataFrame, query: str) -> DataFrame:
    return vouchers.where(F.col("narration").rlike(search_pattern(query))) if query.split() else vouchers


def by_phrase(vouchers: DataFrame, phrase: str) -> DataFrame:
    return vouchers.where(normalised(F.col("narration")).contains(phrase))


def review(vouchers: DataFrame, first: str | None = None, last: str | None = None, status: str = "all", ledger: str | None = None, query: str = "", phrase: str = "") -> DataFrame:
    """The review desk's filters, all at once; Catalyst merges them into one."""
    rows = period(vouchers, first, last) if first and last else vouchers
    rows = by_status(rows, status)
    rows = by_ledger(rows, ledger) if ledger else rows
    rows = search_narration(rows, query)
    return by_phrase(rows, phrase) if phrase else rows


def counters(vouchers: DataFrame) -> DataFrame:
    """Total, modified and suspense vouchers."""
    return vouchers.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("modified", F.lit(False))).alias("modified"), F.count_if(is_suspense()).alias("suspense"))


def ledger_names(vouchers: DataFrame, part: str = "") -> DataFrame:
    """Distinct names that hold the text (case aside), in order, for completion."""
    return vouchers.where(F.lower("particulars").contains(part.lower())).select(F.col("particulars").alias("name")).distinct().orderBy("name")


def bounds(vouchers: DataFrame) -> DataFrame:
    return vouchers.agg(F.min("gl_date").alias("first"), F.max("gl_date").alias("last"))


def replace_ledger(vouchers: DataFrame, ids: DataFrame, target: str, name: str, contra: bool = False) -> DataFrame:
    """For the selected ids, where particulars equal target (case aside; * for any): the new name, modified, and type Contra if asked."""
    chosen = vouchers.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    hit = F.coalesce("_chosen", F.lit(False)) & (F.lit(target == "*") | (F.lower(F.coalesce("particulars", F.lit(""))) == target.lower()))
    out = chosen.withColumn("_hit", hit).withColumn("particulars", F.when(F.col("_hit"), name).otherwise(F.col("particulars"))).withColumn("modified", F.col("_hit") | F.coalesce("modified", F.lit(False)))
    if contra:
        out = out.withColumn("vch_type", F.when(F.col("_hit"), "Contra").otherwise(F.col("vch_type")))
    return out.drop("_chosen", "_hit")


def delete_vouchers(vouchers: DataFrame, ids: DataFrame) -> DataFrame:
    return vouchers.join(ids.select("id").distinct(), "id", "left_anti")


def numbered(ledger: DataFrame, keys: list[str], most: int = scans.MOST) -> DataFrame:
    """index from 1 among the rows with a side, by date (missing dates first), then seq."""
    day = F.coalesce(F.unix_date("gl_date"), F.lit(-(1 << 31)))
    rows = scans.running_sum(valid_only(ledger).withColumn("_day", day), keys, ["_day", "seq"], F.lit(1), "index", most)
    return rows.drop("_day").withColumn("index", F.col("index").cast("int"))


def viewport(rows: DataFrame, order: list[str], first: int, count: int) -> DataFrame:
    return rows.orderBy(*order).offset(first).limit(count)
