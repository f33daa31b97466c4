"""Files to DataFrames: voucher XML, registers with a late header, JSON settings, text statements, PDF and workbooks."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.sources import connector, workbook

#: Shape of a voucher in XML; tags as voucher files name them.
ENTRIES_XML = "array<struct<LEDGERNAME: string, ISDEEMEDPOSITIVE: string, ISPARTYLEDGER: string, AMOUNT: string>>"
VOUCHER_XML = f"DATE string, VOUCHERTYPENAME string, VOUCHERNUMBER string, NARRATION string, `ALLLEDGERENTRIES.LIST` {ENTRIES_XML}, `LEDGERENTRIES.LIST` {ENTRIES_XML}"


def scrub_references(text: Column) -> Column:
    """XML text without references to control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"(?i)&#(?:x(?!0*(?:9|a|d);)0*(?:[0-9a-f]|1[0-9a-f])|(?!0*(?:9|10|13);)0*(?:[0-9]|[12][0-9]|3[01]));", "")


def shape_vouchers(raw: DataFrame) -> DataFrame:
    """VOUCHER_XML rows as date, vch_type, number, narration, entries (of both lists that files use); entries without a party tag keep a null flag."""
    yes = lambda c: F.lower(c) == "yes"
    none = F.array().cast(ENTRIES_XML)
    entries = F.transform(F.concat(F.coalesce("`ALLLEDGERENTRIES.LIST`", none), F.coalesce("`LEDGERENTRIES.LIST`", none)), lambda e: F.struct(e.LEDGERNAME.alias("ledger"), F.coalesce(yes(e.ISDEEMEDPOSITIVE), F.lit(False)).alias("is_debit"), yes(e.ISPARTYLEDGER).alias("is_party"), e.AMOUNT.try_cast(MONEY).alias("amount")))
    return raw.select(F.col("DATE").alias("date"), F.col("VOUCHERTYPENAME").alias("vch_type"), F.col("VOUCHERNUMBER").alias("number"), F.col("NARRATION").alias("narration"), entries.alias("entries"))


def read_vouchers(spark: SparkSession, path: str) -> DataFrame:
    """Vouchers of XML files; Spark splits large files at the row tag."""
    return shape_vouchers(spark.read.format("xml").option("rowTag", "VOUCHER").schema(VOUCHER_XML).load(path))


def parse_voucher_text(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Vouchers of one-voucher XML strings, as a connector receives them."""
    parsed = rows.select(F.from_xml(scrub_references(F.col(column)), F.lit(VOUCHER_XML)).alias("v"))
    return shape_vouchers(parsed.select("v.*"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(statement_id, text), a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("statement_id"), F.col("value").alias("text"))


def read_register(spark: SparkSession, path: str, header_row: int = 4) -> DataFrame:
    """CSV register whose header stands in row header_row (from 1) of each file; columns in lower case, file and row_no added.

    Quoted cells may hold line ends; blank rows go. The header of the first file names the columns: one row reaches the driver.
    A file is read whole by one task, 2 GB at most; give large registers as several files.
    """

    def cells(batches):
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(file, n, row) for n, row in enumerate(csv.reader(io.StringIO(text, newline=""))) if any(c.strip() for c in row)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [(), (), ()], (pa.string(), pa.int32(), pa.list_(pa.string())))], ["file", "row_no", "cells"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = files.mapInArrow(cells, "file string, row_no int, cells array<string>")
    head = rows.where(F.col("row_no") == header_row - 1).orderBy("file").select("cells").first()
    if head is None:
        raise ValueError(f"no header in row {header_row}")
    names = [c.strip().lower() or f"c{i}" for i, c in enumerate(head["cells"])]
    return rows.where(F.col("row_no") >= header_row).select("file", "row_no", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved layouts, companies or match history: JSON lines of a known schema."""
    return spark.read.schema(schema).json(path)


LAYOUT = "name string, mapping map<string,int>, headers array<string>, col_count int"
HISTORY = "account string, import_seq long, booked_seq long, score int, reasons array<string>"


def read_lexicon(spark: SparkSession, path: str | None, default: dict[str, str] | None = None) -> DataFrame:
    """(source, target) of a JSON object of words, or the default where no path is given."""
    if path:
        words = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", F.lit("map<string,string>"))).alias("source", "target"))
        return words
    return spark.createDataFrame(list((default or {}).items()), "source string, target string")


def read_workbook_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of .xlsx files as (workbook, sheet, row_no, cells), by Spark's own file reader: any store Spark reads, a file at a time in a task."""
    return workbook_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows of workbooks held as (path, content)."""
    return files.mapInPandas(workbook.sheet_rows, workbook.ROWS)


def read_sheets(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The same rows with a partition per sheet, for large workbooks on a path or URI that pyarrow opens."""
    workbook.register(spark)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def cash_cells(rows: DataFrame) -> DataFrame:
    """Workbook rows as the five cells of cash sheets; blank and shorter rows go."""
    some = F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return rows.where(some & (F.size("cells") >= 5)).select("workbook", "sheet", "row_no", *[F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit("")).alias(f"c{i}") for i in range(5)])


def sheet_table(rows: DataFrame, sheet: str, header_row: int = 4) -> DataFrame:
    """One sheet of workbooks as a table named by its header row (from 1); the name is matched case aside."""
    own = rows.where(F.lower(F.trim("sheet")) == sheet.lower())
    head = own.where(F.col("row_no") == header_row).orderBy("workbook").select("cells").first()
    if head is None:
        raise ValueError(f"no sheet {sheet} with a row {header_row}")
    names = [(c or f"c{i}").strip().lower() for i, c in enumerate(head["cells"])]
    return own.where(F.col("row_no") > header_row).select(F.col("workbook").alias("file"), "row_no", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(statement_id, page, page_text) of PDF files; needs the optional pypdf package on the executors."""

    def pages(frames):
        import pandas as pd
        from pypdf import PdfReader

        for frame in frames:
            for row in frame.itertuples():
                found = PdfReader(io.BytesIO(row.content)).pages
                yield pd.DataFrame({"statement_id": row.path, "page": range(len(found)), "page_text": [p.extract_text() or "" for p in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "statement_id string, page int, page_text string")


def page_texts(pages: DataFrame) -> DataFrame:
    """(statement_id, text): a document's pages with text, in order, joined by line ends."""
    full = pages.where(F.trim(F.coalesce("page_text", F.lit(""))) != "")
    return full.groupBy("statement_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "page_text"))), lambda x: x.page_text), "\n").alias("text"))


def booked_vouchers(spark: SparkSession, url: str, company: str, first: str, last: str, days: int = 31) -> DataFrame:
    """Vouchers that a server has booked between two dates, fetched span by span in tasks."""
    return parse_voucher_text(connector.fetch_vouchers(spark, url, company, first, last, days))


def row_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with seq, their place by order within keys, for sources without one of their own."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
