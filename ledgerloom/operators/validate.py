"""Checks of a conversion: do vouchers say what the statement says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.functions.dates import month_key
from ledgerloom.operators import ledger as L
from ledgerloom.operators.linkage import full_outer_months


#: What a report says of each count that isn't 0.
FAULTS = {"months_off": "months differ", "rows_off": "rows differ", "repeated": "vouchers share a number", "without_digits": "numbers end without a digit"}


def voucher_months(vouchers: DataFrame, bank: str = "bank") -> DataFrame:
    """By account and month: count and sums of the bank ledger's entries. bank names the column with the ledger."""
    entries = vouchers.select("account", "date", F.col(bank).alias("bank"), F.explode("entries").alias("e")).where(F.col("e.ledger") == F.col("bank"))
    month = F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2))
    part = lambda side: F.coalesce(F.sum(F.when(F.col("e.is_debit") == side, F.abs("e.amount"))), F.lit(0)).cast(MONEY)
    return entries.groupBy("account", month.alias("month")).agg(F.count(F.lit(1)).alias("n"), part(True).alias("debit"), part(False).alias("credit"))


def summary_match(ledger: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Months of the statement and of its vouchers side by side."""
    months = L.valid_only(ledger).groupBy("account", month_key(F.col("gl_date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), L.side_sum("DEBIT").alias("debit"), L.side_sum("CREDIT").alias("credit"))
    return full_outer_months(months, voucher_months(vouchers), ["n", "debit", "credit"])


def row_match(ledger: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Rows that differ from the voucher of their place: both sides are numbered the same way, then joined by number."""
    left = L.numbered(ledger, ["account"]).select("account", "index", F.date_format("gl_date", "yyyyMMdd").alias("date"), "amount", "type")
    bank = F.get(F.filter("entries", lambda e: ~e.is_party), F.lit(0))
    right = vouchers.select("account", "index", F.col("date").alias("v_date"), F.abs(bank.amount).alias("v_amount"), F.when(bank.is_debit, "DEBIT").otherwise("CREDIT").alias("v_type"))
    both = left.join(right, ["account", "index"], "full_outer")
    wrong = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reasons = F.array_compact(F.array(F.when(wrong("date", "v_date"), "date"), F.when(F.coalesce(F.abs(F.col("amount") - F.col("v_amount")) > 0.01, F.lit(True)), "amount"), F.when(wrong("type", "v_type"), "type")))
    return both.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("account", "index", "reasons")


def sequence_check(vouchers: DataFrame) -> DataFrame:
    """By account: vouchers, repeated numbers, and numbers that don't end in digits."""
    order = Window.partitionBy("account", "number")
    rows = vouchers.withColumn("_n", F.count(F.lit(1)).over(order))
    return rows.groupBy("account").agg(F.count(F.lit(1)).alias("vouchers"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(~F.col("number").rlike("[0-9]$")).alias("without_digits"))


def report(ledger: DataFrame, vouchers: DataFrame) -> DataFrame:
    """By account: counts, sums, closing movement, unknown rows, months and rows that disagree, number faults, verdict and message.

    warning marks statements whose directions rest on a fallback; message says so too.
    """
    fallback = F.coalesce(F.bool_or("is_fallback_type"), F.lit(False)) if "is_fallback_type" in ledger.columns else F.lit(False)
    base = ledger.groupBy("account").agg(F.count(F.lit(1)).alias("transactions"), F.count_if(~F.coalesce("type", F.lit("")).isin(*L.SIDES)).alias("unknown"), L.side_sum("DEBIT").alias("debit"), L.side_sum("CREDIT").alias("credit"), fallback.alias("warning"))
    months = summary_match(ledger, vouchers).groupBy("account").agg(F.count_if(~F.col("agrees")).alias("months_off"))
    rows = row_match(ledger, vouchers).groupBy("account").agg(F.count(F.lit(1)).alias("rows_off"))
    out = base.join(months, "account", "left").join(rows, "account", "left").join(sequence_check(vouchers), "account", "left")
    counts = ("months_off", "rows_off", "vouchers", "repeated", "without_digits")
    out = out.na.fill(0, list(counts)).withColumn("closing_movement", (F.col("debit") - F.col("credit")).cast(MONEY))
    bad = F.col("months_off") + F.col("rows_off") + F.col("repeated") + F.col("without_digits")
    faults = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}"))) for c, what in FAULTS.items()]
    message = F.when(bad == 0, "all checks passed").otherwise(F.concat_ws(", ", *faults))
    message = F.concat(message, F.when(F.col("warning"), "; directions rest on a fallback, check them").otherwise(""))
    return out.withColumn("passed", bad == 0).withColumn("message", message)
