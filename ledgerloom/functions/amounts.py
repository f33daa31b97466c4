"""Amounts, balances and directions written in statements, as DECIMAL(18,2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.try_cast(MONEY)


def unsigned_amount(c: Column) -> Column:
    """Digits and dots only (the sign is lost); empty, a dash or anything unreadable is 0."""
    return F.coalesce(money(F.regexp_replace(c, r"[^0-9.]", "")), F.lit(0).cast(MONEY))


def marked_amount(c: Column) -> Column:
    """Commas and a Cr/Dr mark taken off; null if what is left is no number."""
    return money(F.trim(F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"(?i)(cr|dr)\.?$", "")))


def absolute_amount(c: Column) -> Column:
    """Digits, dots and minus signs, without the sign; unreadable is 0."""
    return F.coalesce(F.abs(money(F.regexp_replace(c, r"[^0-9.\-]", ""))), F.lit(0).cast(MONEY))


def strict_amount(c: Column) -> Column:
    """An optional minus, digits (commas allowed) and exactly two decimals, else null."""
    plain = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^-?[0-9]+\.[0-9]{2}$"), money(plain))


def suffixed_balance(c: Column) -> Column:
    """A balance whose Dr mark makes it negative."""
    value = marked_amount(c)
    return F.when(F.lower(F.trim(c)).rlike(r"dr\.?$"), -F.abs(value)).otherwise(value)


def marked_balance(c: Column) -> Column:
    """A balance that any of dr, od, debit or a minus makes negative."""
    value = absolute_amount(c)
    return F.when(F.lower(c).rlike(r"dr|od|debit|-"), -value).otherwise(value)


def indicated_side(c: Column) -> Column:
    """DEBIT for dr, w or minus, else CREDIT for cr, d or plus, else DEBIT; the marks are looked for in this order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    debit = low.contains("dr") | low.contains("w") | low.contains("-")
    credit = low.contains("cr") | low.contains("d") | low.contains("+")
    return F.when(debit, "DEBIT").when(credit, "CREDIT").otherwise("DEBIT")


def signed(amount: Column, side: Column) -> Column:
    """Effect on a balance: a DEBIT voucher entry takes in, a CREDIT gives out, anything else leaves it."""
    return F.when(side == "DEBIT", amount).when(side == "CREDIT", -amount).otherwise(F.lit(0)).cast(MONEY)


def voucher_type(side: Column) -> Column:
    return F.when(side == "CREDIT", "Payment").when(side == "DEBIT", "Receipt")


def initials(name: Column) -> Column:
    """First letters of a name's purely alphabetic words, in capitals."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w.rlike("^[A-Za-z]+$"))
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def voucher_number(ledger: Column, date: Column, index: Column, fallback: str = "BANK") -> Column:
    """Initials of the ledger (or the fallback), yyyymmdd and a five-digit index, which longer indexes outgrow."""
    first = initials(ledger)
    number = index.cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return F.concat(F.when(first == "", fallback).otherwise(first), F.date_format(date, "yyyyMMdd"), padded)


def compact_rupees(c: Column) -> Column:
    """Crores, lakhs or thousands with one decimal for reports."""
    value = F.abs(c)
    say = lambda unit, mark: F.concat(F.format_string("%.1f", (c / unit).cast("double")), F.lit(mark))
    return F.when(value >= 10_000_000, say(10_000_000, "Cr")).when(value >= 100_000, say(100_000, "L")).when(value >= 1000, say(1000, "K")).otherwise(c.cast(MONEY).cast("string"))


def indian_grouping(c: Column) -> Column:
    """12,34,567.89: the last three digits, then pairs."""
    text = F.abs(c).cast(MONEY).cast("string")
    whole, cents = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    pairs = F.regexp_replace(F.regexp_replace(whole, r"([0-9]{3})$", ",$1"), r"(?<=[0-9])(?=([0-9]{2})+,)", ",")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.regexp_replace(pairs, "^,", ""), F.lit("."), cents)
