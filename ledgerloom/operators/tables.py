"""Tables found in documents: rows (statement_id, page, table_no, row_no, cells ARRAY<STRING>) to transactions.

Which column holds what is told for each document by its header row: a layout saved under the same headers, else
the headers' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts
from ledgerloom.functions.dates import any_date
from ledgerloom.operators import scans

#: Our own header words of each role, in the order in which roles are given out.
ROLES = {"date": ("date",), "narration": ("narration", "description", "particulars", "details", "remarks"), "debit": ("debit", "withdrawal", "paid out", "amount"), "credit": ("credit", "deposit", "paid in"), "balance": ("balance",)}
PLACE = ("page", "table_no", "row_no")


def _has_text(cells: str | Column = "cells") -> Column:
    return F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def first_tables(rows: DataFrame, least_columns: int = 5, most_rows: int = 11) -> DataFrame:
    """By document the first table of more than one row, enough columns and any text: its header and first rows, in order."""
    sized = rows.groupBy("statement_id", "page", "table_no").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("width"), F.bool_or(_has_text()).alias("filled"))
    first = sized.where((F.col("n") > 1) & (F.col("width") >= least_columns) & F.col("filled")).groupBy("statement_id").agg(F.min(F.struct("page", "table_no")).alias("at"))
    chosen = rows.join(first, "statement_id").where((F.col("page") == F.col("at.page")) & (F.col("table_no") == F.col("at.table_no"))).drop("at")
    order = Window.partitionBy("statement_id").orderBy("row_no")
    return chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_rows).drop("_n")


def header_rows(rows: DataFrame, least_columns: int = 5) -> DataFrame:
    """(statement_id, headers): the first row with text of the first wide table, or of the document where no table is wide."""
    full = rows.where(_has_text())
    tables = full.groupBy("statement_id", "page", "table_no").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("width"), F.min(F.struct("row_no", "cells")).alias("top"))
    wide = (F.col("n") > 1) & (F.col("width") >= least_columns)
    best = F.min_by("top.cells", F.struct((~wide).alias("narrow"), "page", "table_no"))
    return tables.groupBy("statement_id").agg(best.alias("headers"))


def role_map(headers: Column) -> Column:
    """MAP of role to column (-1: none): the roles in turn take the first header left that holds one of their words."""
    said = F.transform(headers, lambda h: F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"[^a-z\s/()_]", ""))
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.array(*map(F.lit, words)).alias("words")) for role, words in ROLES.items()])

    def give(found: Column, role: Column) -> Column:
        fits = lambda h, i: F.when(F.exists(role["words"], lambda w: h.contains(w)) & ~F.array_contains(F.map_values(found), i), i)
        first = F.coalesce(F.array_min(F.transform(said, fits)), F.lit(-1))
        return F.map_concat(found, F.map_from_arrays(F.array(role["role"]), F.array(first)))

    return F.aggregate(roles, F.expr("cast(map() as map<string,int>)"), give)


def header_print(headers: Column) -> Column:
    """What layouts are recognised by: the headers in lower case, single-spaced, in order."""
    return F.md5(F.array_join(F.transform(headers, lambda h: F.trim(F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"\s+", " "))), "\x1f"))


def column_maps(rows: DataFrame, layouts: DataFrame | None = None, least_columns: int = 5) -> DataFrame:
    """By document: headers, layout (its name, if one is saved for these headers), mapping and trusted.

    layouts: (name, mapping, headers), the first name counts where several hold the same headers. A mapping from words
    is trusted with four columns or more, a date and a narration; a saved one always.
    """
    found = header_rows(rows, least_columns).withColumn("guess", role_map(F.col("headers")))
    if layouts is None:
        saved = found.select("*", F.lit(None).cast("string").alias("layout"), F.lit(None).cast("map<string,int>").alias("saved"))
    else:
        known = layouts.groupBy(header_print(F.col("headers")).alias("print")).agg(F.min("name").alias("layout"), F.min_by("mapping", "name").alias("saved"))
        saved = found.withColumn("print", header_print(F.col("headers"))).join(known, "print", "left").drop("print")
    sure = (F.size("headers") >= 4) & (F.col("guess")["date"] >= 0) & (F.col("guess")["narration"] >= 0)
    return saved.select("statement_id", "headers", "layout", F.coalesce("saved", "guess").alias("mapping"), (F.col("saved").isNotNull() | sure).alias("trusted"))


def body_rows(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows of documents in maps (statement_id, headers, mapping) with _mapping: all but blank ones, those too short for the mapping, and repeats of the header."""
    mapped = rows.where(_has_text()).join(maps.select("statement_id", F.col("headers").alias("_headers"), F.col("mapping").alias("_mapping")), "statement_id")
    long_enough = F.size("cells") > F.array_max(F.map_values("_mapping"))
    return mapped.where(long_enough & ~F.col("cells").eqNullSafe(F.col("_headers"))).drop("_headers")


def transactions(rows: DataFrame, mapping: dict[str, int] | DataFrame | None = None, boundary: str | None = None, most: int = scans.MOST) -> DataFrame:
    """Transactions of mapped tables. Rows without a date go on from the dated row before them; a boundary is applied after that.

    mapping: one for all documents (role -> column; roles date, narration, narration_2, debit, credit, balance, -1 or missing
    where there is none), or column_maps() (untrusted documents give no rows), or None for column_maps(rows). With
    one amount column (no credit column, or the same) marks in the cell tell the side: a debit mark is money paid, so CREDIT.
    """
    if isinstance(mapping, dict):
        own = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        maps = header_rows(rows).withColumn("mapping", own)
    else:
        maps = (column_maps(rows) if mapping is None else mapping).where("trusted")
    column = lambda role: F.coalesce(F.try_element_at("_mapping", F.lit(role)), F.lit(-1))
    at = lambda role: F.when(column(role) >= 0, F.trim(F.coalesce(F.get("cells", F.greatest(column(role), F.lit(0))), F.lit("")))).otherwise("")
    text = F.concat_ws(" | ", F.nullif(at("narration"), F.lit("")), F.nullif(at("narration_2"), F.lit("")))
    single = (column("credit") < 0) | (column("credit") == column("debit"))
    body = body_rows(rows, maps)
    cells = body.select("statement_id", *PLACE, any_date(at("date")).alias("gl_date"), text.alias("_text"), amounts.absolute_amount(at("debit")).alias("_debit"), amounts.absolute_amount(at("credit")).alias("_credit"), at("debit").alias("_cell"), single.alias("_single"), amounts.marked_balance(at("balance")).alias("balance"))
    dated = F.col("gl_date").isNotNull()
    cells = scans.running_sum(cells, ["statement_id"], list(PLACE), dated.cast("int"), "_island", most, rows).where("_island > 0")
    told = cells.where(dated | ~F.lower("_text").isin(*ROLES["narration"]))
    first = lambda c: F.min_by(c, F.struct(*PLACE)).alias(c)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*PLACE, F.col("_text").alias("text")))), lambda x: x.text), " ")
    out = told.groupBy("statement_id", "_island").agg(first("gl_date"), F.trim(joined).alias("narration"), first("_debit"), first("_credit"), first("_cell"), first("_single"), first("balance"))
    paid = F.when(F.col("_single"), amounts.indicated_side(F.col("_cell")) == "DEBIT").otherwise(F.col("_debit") > 0)
    amount = F.when(F.col("_single") | paid, F.col("_debit")).otherwise(F.col("_credit"))
    side = F.when(amount == 0, "UNKNOWN").when(paid, "CREDIT").otherwise("DEBIT")
    out = out.select("statement_id", F.col("_island").alias("seq"), "gl_date", "narration", amount.alias("amount"), "balance", side.alias("type"))
    return out.where(F.col("gl_date") >= F.to_date(F.lit(boundary))) if boundary else out
