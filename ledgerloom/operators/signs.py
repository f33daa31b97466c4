"""Direction of statement rows from the movement of the printed balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.operators import scans

TOLERANCE = 0.01
ACCEPTED_ERRORS = 0.25


def _moves(rows: DataFrame, opening: str, overdrawn: str | None = None) -> DataFrame:
    """balance_used (all -|balance| for an overdrawn opening, or where overdrawn says so) and delta to the row before, or to the opening."""
    used = F.when(F.col(opening) < 0 if overdrawn is None else F.col(overdrawn), -F.abs("balance")).otherwise(F.col("balance"))
    rows = rows.withColumn("balance_used", used.cast(MONEY))
    rows = scans.row_before(rows, ["account"], ["seq"], F.col("balance_used"), "_before")
    return rows.withColumn("delta", (F.col("balance_used") - F.coalesce("_before", opening)).cast(MONEY)).drop("_before")


def _by_sign() -> Column:
    return F.when(F.col("delta") > 0, "DEBIT").when(F.col("delta") < 0, "CREDIT")


def _fits() -> Column:
    return F.abs(F.abs("delta") - F.col("amount")) <= F.lit(TOLERANCE).cast(MONEY)


def by_delta(rows: DataFrame, opening: str = "opening", overdrawn: str | None = None) -> DataFrame:
    """Sign of the movement; where the balance stands still a positive amount is a DEBIT. Without an opening the first row stays UNKNOWN."""
    still = F.when((F.col("delta") == 0) & (F.col("amount") > 0), "DEBIT")
    return _moves(rows, opening, overdrawn).withColumn("type", F.coalesce(_by_sign(), still, F.lit("UNKNOWN")))


def by_checked_delta(rows: DataFrame, opening: str = "opening", overdrawn: str | None = None) -> DataFrame:
    """Sign of the movement if it equals the amount, else UNKNOWN."""
    return _moves(rows, opening, overdrawn).withColumn("type", F.coalesce(F.when(_fits() & (F.col("delta") != 0), _by_sign()), F.lit("UNKNOWN")))


def by_delta_or_mark(rows: DataFrame, opening: str = "opening", mark: str = "bank_indicator") -> DataFrame:
    """Sign of a movement that equals the amount, else the printed mark from the bank's side (CR: DEBIT, DR: CREDIT), else UNKNOWN."""
    printed = F.when(F.upper(mark) == "CR", "DEBIT").when(F.upper(mark) == "DR", "CREDIT")
    still = F.when((F.col("delta") == 0) & (F.col("amount") == 0), "UNKNOWN")
    moved = F.when(_fits() & (F.col("delta") != 0), _by_sign())
    return _moves(rows, opening).withColumn("type", F.coalesce(still, moved, printed, F.lit("UNKNOWN")))


def balance_errors(rows: DataFrame) -> DataFrame:
    """By account: rows checked against the row before, those that don't add up, their share, and whether the share is accepted.

    One row, or none to check, is accepted.
    """
    effect = F.when(F.col("type") == "DEBIT", F.col("amount")).otherwise(-F.col("amount"))
    wrong = F.abs(F.col("_before") + effect - F.col("balance")) > F.lit(TOLERANCE).cast(MONEY)
    checked = scans.row_before(rows, ["account"], ["seq"], F.col("balance"), "_before").withColumn("_wrong", wrong)
    out = checked.groupBy("account").agg(F.count("_wrong").alias("checked"), F.count_if("_wrong").alias("errors"))
    return out.withColumn("accepted", (F.col("checked") == 0) | (F.col("errors") < F.lit(ACCEPTED_ERRORS) * F.col("checked")))
