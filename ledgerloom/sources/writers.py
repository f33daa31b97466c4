"""DataFrames to files: voucher XML, tax returns in JSON, cash sheets by month, audit sheets, settings."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _escaped(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _tag(name: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def voucher_xml(vouchers: DataFrame) -> DataFrame:
    """vouchers with xml, the voucher as one line."""
    flag = lambda c: F.when(c, "Yes").otherwise("No")
    entry = lambda e: _tag("ALLLEDGERENTRIES.LIST", F.concat(_tag("LEDGERNAME", _escaped(e.ledger)), _tag("ISDEEMEDPOSITIVE", flag(e.is_debit)), _tag("ISPARTYLEDGER", flag(e.is_party)), _tag("AMOUNT", e.amount.cast("string"))))
    head = F.concat(_tag("DATE", _escaped(F.col("date"))), _tag("VOUCHERTYPENAME", _escaped(F.col("vch_type"))), _tag("VOUCHERNUMBER", _escaped(F.col("number"))), _tag("NARRATION", _escaped(F.col("narration"))))
    return vouchers.withColumn("xml", _tag("VOUCHER", F.concat(head, F.array_join(F.transform("entries", entry), ""))))


def master_xml(masters: DataFrame) -> DataFrame:
    """masters (name, parent, opening) with xml, the ledger as one line; a null opening is left out."""
    opening = F.coalesce(_tag("OPENINGBALANCE", F.col("opening").cast("string")), F.lit(""))
    name = F.concat(F.lit('<LEDGER NAME="'), _escaped(F.col("name")), F.lit('">'))
    return masters.withColumn("xml", F.concat(name, _tag("NAME", _escaped(F.col("name"))), _tag("PARENT", _escaped(F.col("parent"))), opening, F.lit("</LEDGER>")))


def write_vouchers(vouchers: DataFrame, path: str, order: list[str], masters: DataFrame | None = None) -> None:
    """Voucher XML, one envelope per file: each task sorts its range of vouchers and frames them, so no single task writes all.

    masters, a few ledgers, stand at the head of the first file, which is read before the others.
    """
    head = [r["xml"] for r in master_xml(masters).collect()] if masters is not None else []
    lines = voucher_xml(vouchers).repartitionByRange(*order).sortWithinPartitions(*order).select("xml")

    def framed(batches):
        batch = lambda rows: pa.RecordBatch.from_arrays([rows], ["xml"])
        yield batch(pa.array(["<ENVELOPE><BODY>", *(head if TaskContext.get().partitionId() == 0 else [])]))
        for b in batches:
            yield batch(b.column(0))
        yield batch(pa.array(["</BODY></ENVELOPE>"]))

    lines.mapInArrow(framed, "xml string").write.mode("overwrite").text(path)


def save_review(vouchers: DataFrame, audit: DataFrame, path: str, order: list[str], masters: DataFrame | None = None) -> None:
    """What a review ends with: the edited vouchers and the audit sheet made of them, under vouchers and audit."""
    write_vouchers(vouchers, f"{path}/vouchers", order, masters)
    write_audit(audit, f"{path}/audit")


def _nil_block() -> Column:
    """The fixed block of supplies at nil rate."""
    #: The four kinds of supplies that the block lists.
    kinds = ("INTRB2B", "INTRAB2B", "INTRB2C", "INTRAB2C")
    zero = F.lit(0).cast("decimal(18,2)")
    return F.struct(F.array(*[F.struct(F.lit(k).alias("sply_ty"), zero.alias("expt_amt"), zero.alias("nil_amt"), zero.alias("ngsup_amt")) for k in kinds]).alias("inv"))


def return_json(documents: DataFrame, gstin: str, period: str) -> DataFrame:
    """The return as one JSON document, recipients in order and the fixed block of supplies at nil rate.

    A return is one value here, so its recipients meet in one row; write_return() writes one of any size.
    """
    b2b = F.sort_array(F.collect_list(F.struct(*documents.columns))).alias("b2b")
    head = F.struct(F.lit(gstin).alias("gstin"), F.lit(period).alias("fp"), "b2b", _nil_block().alias("nil"))
    return documents.agg(b2b).select(F.to_json(head).alias("json"))


def return_lines(documents: DataFrame, gstin: str, period: str) -> DataFrame:
    """(section, ctin, line): the same document as lines, which read in this order are it; each recipient is a line."""
    first = documents.agg(F.min("ctin")).first()[0]
    comma = F.when(F.col("ctin") == F.lit(first), "").otherwise(",")
    body = documents.select(F.lit(1).alias("section"), "ctin", F.concat(comma, F.to_json(F.struct(*documents.columns))).alias("line"))
    head = F.concat(F.regexp_replace(F.to_json(F.struct(F.lit(gstin).alias("gstin"), F.lit(period).alias("fp"))), r"\}$", ""), F.lit(',"b2b":['))
    tail = F.concat(F.lit('],"nil":'), F.to_json(_nil_block()), F.lit("}"))
    ends = documents.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("section"), F.lit("").alias("ctin"), F.when(F.col("id") == 0, head).otherwise(tail).alias("line"))
    return body.unionByName(ends)


def write_return(documents: DataFrame, gstin: str, period: str, path: str, files: int = 8) -> None:
    """The return as text files which, one after the other by name, are the JSON document; no task holds more than its share."""
    lines = return_lines(documents, gstin, period)
    lines.repartitionByRange(files, "section", "ctin").sortWithinPartitions("section", "ctin").select("line").write.mode("overwrite").text(path)


def hsn_json(rows: DataFrame) -> DataFrame:
    """By file one JSON document with the rows of its two sections, in order."""
    item = F.struct("num", F.col("hsn").alias("hsn_sc"), F.col("description").alias("desc"), "uqc", F.col("qty").cast("double").alias("qty"), F.col("rate").cast("double").alias("rt"), F.col("taxable").alias("txval"), F.col("igst").alias("iamt"), F.col("cgst").alias("camt"), F.col("sgst").alias("samt"), F.col("cess").alias("csamt"))
    part = lambda s: F.sort_array(F.collect_list(F.when(F.col("section") == s, item)))
    return rows.groupBy("file").agg(part("B2B").alias("hsn_b2b"), part("B2C").alias("hsn_b2c")).select("file", F.to_json(F.struct("hsn_b2b", "hsn_b2c")).alias("json"))


def write_cash_months(cash: DataFrame, path: str) -> None:
    """A folder per month label, labels of at most 31 characters as sheets have them."""
    cash.withColumn("sheet", F.substring("month_label", 1, 31)).repartition("sheet").write.mode("overwrite").partitionBy("sheet").csv(path, header=True)


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_settings(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
