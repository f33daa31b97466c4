"""Whole jobs: statements, cash books and registers to vouchers, reports and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.tax import valid_gstin, valid_period
from ledgerloom.operators import cash, gst, signs, statements, tables, validate, vouchers
from ledgerloom.sources import writers

#: Direction rule of each statement profile.
DIRECTIONS = {"dash_two_dates": signs.by_checked_delta, "printed_side": signs.by_delta_or_mark, "slash_dates": signs.by_delta}


def convert_statement(texts: DataFrame, profile: str, bank: str, other: str = "Suspense", strategy: str = "whole", boundary: str | None = None, opening: Column | None = None) -> dict[str, DataFrame]:
    """Statement texts (statement_id, text) to transactions, vouchers with their two ledger masters, the audit sheet and the validation report.

    An opening given takes the place of those found in the text.
    """
    lines = statements.lines_of(texts)
    rows, found = statements.ingest(lines, profile, strategy, boundary)
    rows = rows.drop("type").join(found, "statement_id", "left").withColumn("opening", F.coalesce(*([opening] if opening is not None else []), "opening"))
    rows = DIRECTIONS[profile](rows.withColumnRenamed("statement_id", "account"))
    made = vouchers.double_entries(rows, F.lit(bank), F.lit(other), ["account"]).withColumn("bank", F.lit(bank))
    missed = statements.coverage(lines, rows.withColumnRenamed("account", "statement_id"))
    report = validate.report(rows, made).join(missed.withColumnRenamed("statement_id", "account"), "account", "left").na.fill(0, ["missed"])
    masters = vouchers.ledger_masters(rows.groupBy("account").agg(F.first("opening").alias("opening")), bank, other)
    return {"transactions": rows, "vouchers": made, "masters": masters, "audit": vouchers.audit_rows(made, ["account"]), "report": report}


def convert_tables(rows: DataFrame, mapping: dict[str, int] | DataFrame | None, bank: str, other: str = "Suspense", boundary: str | None = None) -> dict[str, DataFrame]:
    """Mapped tables to transactions and vouchers."""
    found = tables.transactions(rows, mapping, boundary).withColumnRenamed("statement_id", "account")
    made = vouchers.double_entries(found, F.lit(bank), F.lit(other), ["account"]).withColumn("bank", F.lit(bank))
    return {"transactions": found, "vouchers": made, "report": validate.report(found, made)}


def convert_cash(cells: DataFrame, lexicon: DataFrame | None = None, cutoff: str | None = None, book: str = "Cash", other: str = "Donations") -> dict[str, DataFrame]:
    """Cash sheets to receipts, vouchers and the month audit."""
    found = cash.receipts(cells, cutoff)
    if lexicon is not None:
        found = cash.apply_lexicon(found, lexicon).withColumn("name", F.col("spelled")).drop("spelled")
    rows = found.withColumn("account", F.col("workbook")).withColumn("seq", F.struct("sheet", "row_no")).withColumn("narration", F.concat_ws(" ", F.lit("Receipt"), "rc_no", "name"))
    made = vouchers.double_entries(rows, F.lit(book), F.lit(other), ["account"], fallback="CASH", receipts_only=True)
    return {"receipts": found, "vouchers": made, "audit": cash.receipt_audit(found)}


def gst_return(register: DataFrame) -> dict[str, DataFrame]:
    """A register with the required columns to return documents and totals; an unknown rate fails the job. Rows without recipient or invoice go."""
    rows = gst.reject_invalid(gst.usable_rows(gst.require_columns(register)))
    return {"documents": gst.return_documents(rows), "totals": gst.register_totals(rows)}


def register_return(register: DataFrame, gstin: str, period: str) -> dict[str, DataFrame]:
    """A register as files give it, by its template's headings, to the return of one taxpayer and period, as documents, totals and JSON."""
    rows = gst.typed_register(gst.require_columns(gst.rename_headers(register, gst.B2B_ALIASES)), gstin)
    out = gst_return(rows)
    return out | {"json": writers.return_json(out["documents"], gstin, period)}


def hsn_return(rows: DataFrame) -> dict[str, DataFrame]:
    """An HSN summary as files give it to its rows and totals; an unknown rate fails the job."""
    found = gst.reject_invalid(gst.hsn_rows(gst.fill_sections(gst.rename_headers(rows))))
    return {"rows": found, "totals": gst.hsn_totals(found)}


def check_return_head(heads: DataFrame) -> DataFrame:
    """heads (gstin, period) with whether both are valid."""
    return heads.withColumn("valid", valid_gstin(F.col("gstin")) & valid_period(F.col("period")))
