"""Sales registers to tax returns: invoices by recipient, HSN summaries.

Register rows carry row_no, the order of the file.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import tax
from ledgerloom.functions.amounts import MONEY
from ledgerloom.functions.dates import any_date

#: Rows of a register that one task should join and group.
ROWS = 250_000
REQUIRED = ("recipient", "invoice", "invoice_date", "invoice_value", "place", "taxable", "rate")

#: Headings of the public HSN summary template and short forms of them, by our names.
HSN_ALIASES = {"hsn/sac": "hsn", "hsn code": "hsn", "unit": "uqc", "total quantity": "qty", "quantity": "qty", "total value": "value", "taxable value": "taxable", "integrated tax": "igst", "integrated tax amount": "igst", "central tax": "cgst", "central tax amount": "cgst", "state/ut tax": "sgst", "state/ut tax amount": "sgst", "cess amount": "cess", "tax rate": "rate", "desc": "description"}


#: Headings of the public B2B template, by our names.
B2B_ALIASES = {"gstin/uin of recipient": "recipient", "invoice number": "invoice", "invoice date": "invoice_date", "invoice value": "invoice_value", "place of supply": "place", "reverse charge": "reverse_charge", "invoice type": "invoice_type", "taxable value": "taxable", "cess amount": "cess"}


def require_columns(register: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The register, or an error that names the columns it lacks."""
    missing = [c for c in required if c not in register.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return register


def rename_headers(register: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Headers in lower case and by their aliases."""
    aliases = HSN_ALIASES if aliases is None else aliases
    low = {c: c.strip().lower() for c in register.columns}
    return register.withColumnsRenamed({c: aliases.get(x, x) for c, x in low.items()})


def usable_rows(register: DataFrame) -> DataFrame:
    """Without blank, short or total recipients and blank invoices."""
    who = F.trim(F.coalesce("recipient", F.lit("")))
    return register.where((F.length(who) >= 2) & ~F.lower(who).contains("total") & (F.trim(F.coalesce(F.col("invoice").cast("string"), F.lit(""))) != ""))


def invalid_rates(register: DataFrame) -> DataFrame:
    """Rows whose rate the law doesn't know; one is enough to reject a register."""
    return register.where(~tax.known_rate(F.col("rate")))


def reject_invalid(register: DataFrame) -> DataFrame:
    """The register, checked: an unknown rate fails the job where it is read."""
    return register.withColumn("rate", F.when(tax.known_rate(F.col("rate")), F.col("rate")).otherwise(F.raise_error(F.concat(F.lit("unknown rate "), F.coalesce(F.col("rate").cast("string"), F.lit("null")))).cast(register.schema["rate"].dataType)))


def taxed(register: DataFrame) -> DataFrame:
    """cgst, sgst and igst of each row; a supply within the state has place equal to state."""
    cgst, sgst, igst = tax.tax_split(F.col("taxable"), F.col("rate"), F.col("place") == F.col("state"))
    return filled(register).withColumns({"cgst": cgst, "sgst": sgst, "igst": igst})


TAXES = ("taxable", "cgst", "sgst", "igst", "cess")


def filled(register: DataFrame) -> DataFrame:
    """The register with its optional columns: cess (0), reverse charge (N) and invoice type (R) in the codes of returns."""
    text = lambda c: F.col(c).cast("string") if c in register.columns else F.lit(None).cast("string")
    cess = F.coalesce(text("cess").try_cast(MONEY), F.lit(0).cast(MONEY))
    return register.withColumns({"cess": cess, "reverse_charge": tax.reverse_charge(text("reverse_charge")), "invoice_type": tax.invoice_type(text("invoice_type"))})


def typed_register(register: DataFrame, gstin: str) -> DataFrame:
    """A register as files give it, all text, with amounts, dates, rates and place codes read; state is that of the taxpayer's number."""
    money = lambda c: F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast(MONEY)
    return register.withColumns({"invoice_value": money("invoice_value"), "taxable": money("taxable"), "rate": tax.rate(F.col("rate")), "place": tax.place_code(F.col("place")), "invoice_date": any_date(F.col("invoice_date").cast("string")), "state": F.lit(gstin[:2])})


def invoices(register: DataFrame) -> DataFrame:
    """By recipient and invoice: the first row's header, item count and sums."""
    rows = taxed(register)
    head = [c for c in ("invoice_date", "invoice_value", "place", "state", "reverse_charge", "invoice_type") if c in rows.columns]
    per = rows.groupBy("recipient", "invoice").agg(F.min(F.struct("row_no", *head)).alias("first"), F.count(F.lit(1)).alias("items"), *[F.sum(c).cast(MONEY).alias(c) for c in TAXES])
    return per.select("recipient", "invoice", *[f"first.{c}" for c in head], "items", *TAXES)


def register_totals(register: DataFrame) -> DataFrame:
    """Sums, invoices and recipients of the register; an invoice's value counts once."""
    per = invoices(register)
    return per.agg(*[F.sum(c).cast(MONEY).alias(c) for c in TAXES], F.sum("invoice_value").cast(MONEY).alias("value"), F.count(F.lit(1)).alias("invoices"), F.count_distinct("recipient").alias("recipients"))


def item_numbers(register: DataFrame) -> DataFrame:
    order = Window.partitionBy("recipient", "invoice").orderBy("row_no")
    return register.withColumn("item_no", F.row_number().over(order))


def tasks_for(register: DataFrame, most: int = ROWS) -> int:
    """Tasks that a register is joined and grouped in: as the session says, and more where one would hold over `most` rows."""
    return max(int(register.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(register.count() / most))


def return_documents(register: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per recipient with its part of the return, nested as recipient, invoices, items, item details, in order.

    tasks: among how many the recipients are dealt; by default as the session says.
    """
    items = item_numbers(taxed(register))
    detail = F.struct(F.col("rate").cast("double").alias("rt"), F.col("taxable").alias("txval"), F.col("cgst").alias("camt"), F.col("sgst").alias("samt"), F.col("igst").alias("iamt"), F.col("cess").alias("csamt"))
    head = F.struct("row_no", F.col("invoice_value").alias("val"), F.date_format("invoice_date", "dd-MM-yyyy").alias("idt"), F.col("place").alias("pos"), F.col("reverse_charge").alias("rchrg"), F.col("invoice_type").alias("inv_typ"))
    per = items.groupBy("recipient", "invoice").agg(F.min(head).alias("first"), F.sort_array(F.collect_list(F.struct(F.col("item_no").alias("num"), detail.alias("itm_det")))).alias("itms")).select("recipient", "invoice", "first.val", "first.idt", "first.pos", "first.rchrg", "first.inv_typ", "itms")
    inv = F.struct(F.col("invoice").cast("string").alias("inum"), "idt", "val", "pos", "rchrg", "inv_typ", "itms")
    per = per if tasks is None else per.repartition(tasks, "recipient")
    return per.groupBy("recipient").agg(F.sort_array(F.collect_list(inv)).alias("inv")).select(F.col("recipient").alias("ctin"), "inv")


def fill_sections(rows: DataFrame, label: str = "hsn") -> DataFrame:
    """Rows with section: the last divider row (B2B or B2C in its label) before them in the file, at first B2B; dividers and totals go."""
    text = F.upper(F.coalesce(label, F.lit("")))
    mark = F.when(text.contains("B2C"), "B2C").when(text.contains("B2B"), "B2B")
    order = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_mark", mark).withColumn("section", F.coalesce(F.last("_mark", ignorenulls=True).over(order), F.lit("B2B")))
    return filled.where(F.col("_mark").isNull() & ~text.contains("TOTAL") & (F.trim(text) != "")).drop("_mark")


def hsn_rows(rows: DataFrame) -> DataFrame:
    """Cleaned rows with num, their place in their section."""
    order = Window.partitionBy("file", "section").orderBy("row_no")
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    clean = rows.withColumns({"hsn": tax.hsn_code(F.col("hsn")), "uqc": tax.unit_code(F.col("uqc")), "rate": tax.rate(F.col("rate")), "description": F.coalesce(F.trim(text("description")), F.lit("")), "cess": F.coalesce(text("cess").try_cast(MONEY), F.lit(0).cast(MONEY))})
    return clean.withColumn("num", F.row_number().over(order))


def hsn_totals(rows: DataFrame) -> DataFrame:
    """Sums of the summary, taxes without cess."""
    return rows.agg(*[F.sum(c).cast(MONEY).alias(c) for c in ("qty", "taxable", "cgst", "sgst", "igst", "value")], F.count(F.lit(1)).alias("n"))
