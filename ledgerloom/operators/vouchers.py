"""Vouchers: nested double entries from transactions, and flat rows from nested vouchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts
from ledgerloom.operators.ledger import numbered, running_balance

#: Names by which a bank's own ledger is told where entries carry no party flag.
BANK_NAMES = r"(?i)\b(bank|cash|a/c|account)\b"


def _entry(ledger: Column, is_debit: Column, is_party: bool, amount: Column) -> Column:
    return F.struct(ledger.alias("ledger"), is_debit.alias("is_debit"), F.lit(is_party).alias("is_party"), F.when(is_debit, -amount).otherwise(amount).cast(amounts.MONEY).alias("amount"))


def double_entries(ledger: DataFrame, bank: Column, other: Column, keys: list[str], fallback: str = "BANK", receipts_only: bool = False, narration: str = "Transaction") -> DataFrame:
    """One voucher per DEBIT or CREDIT row: keys, index, date yyyymmdd, number, type, narration, entries.

    A DEBIT takes the amount into the bank (or cash) ledger and credits the other one. Rows are numbered among those kept, by
    date. receipts_only books every row as a receipt, as cash books do. Entries' amounts are negative for debits.
    """
    rows = numbered(ledger, keys)
    taken_in = F.lit(True) if receipts_only else F.col("type") == "DEBIT"
    entries = F.array(_entry(other, ~taken_in, True, F.col("amount")), _entry(bank, taken_in, False, F.col("amount")))
    kind = F.lit("Receipt") if receipts_only else amounts.voucher_type(F.col("type"))
    text = F.coalesce(F.nullif(F.trim("narration"), F.lit("")), F.lit(narration))
    return rows.select(*keys, "index", F.date_format("gl_date", "yyyyMMdd").alias("date"), amounts.voucher_number(bank, F.col("gl_date"), F.col("index"), fallback).alias("number"), kind.alias("vch_type"), text.alias("narration"), entries.alias("entries"))


def ledger_masters(openings: DataFrame, bank: str, other: str) -> DataFrame:
    """The two masters (name, parent, opening) a voucher file starts with; the openings' sum is stored negated."""
    start = (-F.sum("opening")).cast(amounts.MONEY)
    master = lambda name, parent, value: F.struct(F.lit(name).alias("name"), F.lit(parent).alias("parent"), value.alias("opening"))
    both = F.array(master(bank, "Bank Accounts", F.col("opening")), master(other, "Suspense A/c", F.lit(None).cast(amounts.MONEY)))
    return openings.agg(start.alias("opening")).select(F.inline(both))


def flatten(vouchers: DataFrame, key: str = "id") -> DataFrame:
    """Flat rows: particulars are the party side's ledgers; debit and credit come from the bank side.

    Entries without a party flag (null) are told by name.
    """
    party = lambda e: F.coalesce(e.is_party, ~e.ledger.rlike(BANK_NAMES))
    parties = F.filter("entries", party)
    bank = F.get(F.filter("entries", lambda e: ~party(e)), F.lit(0))
    amount = F.abs(bank.amount)
    date = F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date")
    zero = F.lit(0).cast(amounts.MONEY)
    return vouchers.select(key, date.alias("gl_date"), F.array_join(F.transform(parties, lambda e: e.ledger), ", ").alias("particulars"), "narration", "vch_type", F.col("number").alias("vch_no"), F.when(bank.is_debit, amount).otherwise(zero).alias("debit"), F.when(~bank.is_debit, amount).otherwise(zero).alias("credit"), F.lit(False).alias("modified"))


def of_ledger(vouchers: DataFrame, bank: str, key: str = "id") -> DataFrame:
    """Vouchers that book the ledger (case aside): its entry gives amount and type, the other ledgers the particulars."""
    own = lambda e: F.lower(e.ledger) == bank.lower()
    entry = F.get(F.filter("entries", own), F.lit(0))
    others = F.transform(F.filter("entries", lambda e: ~own(e)), lambda e: e.ledger)
    return vouchers.where(F.exists("entries", own)).select(key, F.col("number").alias("vch_no"), "date", "vch_type", F.abs(entry.amount).alias("amount"), F.when(entry.is_debit, "DEBIT").otherwise("CREDIT").alias("type"), "narration", F.coalesce(F.nullif(F.array_join(others, ", "), F.lit("")), F.lit("Suspense")).alias("particulars"))


def audit_rows(vouchers: DataFrame, keys: list[str], opening: Column | None = None) -> DataFrame:
    """The audit sheet: flat rows in order with the running balance."""
    flat = flatten(vouchers.withColumn("_id", F.struct(*keys, "index")), "_id")
    rows = flat.select(F.concat_ws("/", *[F.col(f"_id.{k}").cast("string") for k in keys]).alias("account"), F.col("_id.index").alias("seq"), "gl_date", "particulars", "vch_type", "vch_no", "narration", "debit", "credit")
    rows = rows.withColumn("amount", F.col("debit") + F.col("credit")).withColumn("type", F.when(F.col("debit") > 0, "DEBIT").otherwise("CREDIT"))
    return running_balance(rows, opening).drop("amount", "type")
