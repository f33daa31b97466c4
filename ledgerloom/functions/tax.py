"""Public rules of India's goods and services tax: identification numbers, rates, places, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rates in percent that the law knows.
RATES = (0, 0.1, 0.25, 1, 1.5, 3, 5, 6, 7.5, 12, 18, 28, 40)
#: The check character's alphabet.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_character(first14: Column) -> Column:
    """Check character of the first 14 characters: factors 1, 2, 1, 2 ..., quotient and remainder by 36 added."""

    def part(i):
        product = (F.instr(F.lit(DIGITS), F.substring(first14, i, F.lit(1))) - 1) * F.when(i % 2 == 1, 1).otherwise(2)
        return F.floor(product / 36) + F.pmod(product, F.lit(36))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(14)), part), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.substring(F.lit(DIGITS), (F.pmod(F.lit(36) - F.pmod(total, F.lit(36)), F.lit(36)) + 1).cast("int"), F.lit(1))


def valid_gstin(c: Column) -> Column:
    """15 characters of the prescribed shape (state, PAN, entity number from 1, a letter or digit, mostly Z) and the right check character."""
    text = F.upper(F.trim(c))
    shape = text.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z][0-9A-Z][0-9A-Z]$")
    return F.coalesce(shape & (F.substring(text, 15, 1) == check_character(F.substring(text, 1, 14))), F.lit(False))


def valid_period(c: Column) -> Column:
    """MMYYYY with a month of 1 to 12."""
    return F.coalesce(c.rlike(r"^(0[1-9]|1[0-2])[0-9]{4}$"), F.lit(False))


def rate(c: Column) -> Column:
    """A percentage, with or without its sign."""
    return F.regexp_replace(c.cast("string"), r"[%\s]", "").try_cast("decimal(9,3)")


def known_rate(c: Column) -> Column:
    return F.coalesce(c.cast("decimal(9,3)").isin(*[F.lit(r).cast("decimal(9,3)") for r in RATES]), F.lit(False))


def tax_split(taxable: Column, percent: Column, within_state: Column) -> tuple[Column, Column, Column]:
    """(cgst, sgst, igst), rounded half up to paise; within a state each half is rounded by itself."""
    total = F.round(taxable.cast("decimal(18,2)") * percent.cast("decimal(9,3)") / F.lit(100), 2).cast("decimal(18,2)")
    half = F.round(total / F.lit(2), 2).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    return F.when(within_state, half).otherwise(zero), F.when(within_state, half).otherwise(zero), F.when(within_state, zero).otherwise(total)


def padded(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def place_code(c: Column) -> Column:
    """Two-digit state code: before a dash, without a decimal part."""
    return padded(F.trim(F.regexp_replace(F.split(c, "-")[0], r"\.0+$", "")), 2)


def reverse_charge(c: Column) -> Column:
    return F.when(F.upper(F.coalesce(c, F.lit(""))).contains("Y"), "Y").otherwise("N")


def invoice_type(c: Column) -> Column:
    """Codes of supplies: zones without or with payment, deemed exports, bonded sales, regular."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.contains("sez") & low.contains("without"), "SEWOP").when(low.contains("sez"), "SEWP").when(low.contains("deemed"), "DE").when(low.contains("bond"), "CBW").otherwise("R")


def hsn_code(c: Column) -> Column:
    """Digits without a decimal part; odd lengths 3, 5 and 7 regain a leading zero."""
    text = F.trim(F.regexp_replace(c, r"\.0+$", ""))
    return F.when(F.length(text).isin(3, 5, 7), F.concat(F.lit("0"), text)).otherwise(text)


def unit_code(c: Column) -> Column:
    """Unit before a dash, in capitals; OTH where there is none."""
    return F.coalesce(F.nullif(F.upper(F.trim(F.split(c, "-")[0])), F.lit("")), F.lit("OTH"))
