"""Cash receipts and the name lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.functions.dates import any_date, day_of_month
from ledgerloom.functions.narration import clean_name, odd_name
from ledgerloom.operators import scans
from ledgerloom.operators.lexicon import ADDRESS_SPELLINGS, UNKNOWN, plain_name

#: Words of a heading row.
HEADINGS = ("date", "rc.no", "amount")


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def _heading() -> Column:
    """Rows that name their columns: one of HEADINGS stands in them, and neither number nor amount is one."""
    text = F.lower(F.concat_ws(" ", "c0", "c1", "c2", "c3", "c4"))
    named = F.exists(F.array(*map(F.lit, HEADINGS)), lambda w: text.contains(w))
    return named & _number(F.col("c1")).isNull() & _number(F.col("c4")).isNull()


def reference_dates(rows: DataFrame) -> DataFrame:
    """By sheet: the date of its first row with date, receipt and amount cells whose date can be read."""
    full = rows.where(F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c4").isNotNull() & ~_heading())
    return full.withColumn("_date", any_date(F.col("c0"))).where("_date IS NOT NULL").groupBy("workbook", "sheet").agg(F.min_by("_date", "row_no").alias("reference"))


def undated_sheets(rows: DataFrame) -> DataFrame:
    """Sheets that receipts() can't date: no row of theirs gives a reference date."""
    return rows.select("workbook", "sheet").distinct().join(reference_dates(rows), ["workbook", "sheet"], "left_anti")


def receipts(rows: DataFrame, cutoff: str | None = None, most: int = scans.MOST) -> DataFrame:
    """Receipts of workbook cells (workbook, sheet, row_no, c0 date or day, c1 number, c2 name, c3, c4 amount).

    All dates of a sheet lie in the month of its reference date: a cell gives the day, by a date or its first number, and
    blank or unreadable cells go on with the day before them. A day that the month lacks is the reference date. Numbers and
    amounts are whole, an amount that is no number is 0, a missing name is UNKNOWN. Rows without number or amount
    and headings are no receipts; sheets without a reference date give none (undated_sheets).
    """
    amount = F.coalesce(_number(F.col("c4")).try_cast("long"), F.lit(0)).cast(MONEY)
    number = F.coalesce(F.col("c1").try_cast("double").try_cast("long").cast("string"), F.trim("c1"))
    cell = F.nullif(F.trim("c0"), F.lit(""))
    fragment = F.regexp_extract(cell, r"^(\d+)(?:\.0+)?(?:[-./\s]+\d+[-./\s]*)?$", 1)
    day = F.coalesce(F.dayofmonth(any_date(cell)), fragment.try_cast("int"))
    given = rows.where(F.col("c1").isNotNull() & F.col("c4").isNotNull() & ~_heading()).withColumn("_given", day)
    dated = scans.carried(given, ["workbook", "sheet"], ["row_no"], F.col("_given"), "_day", most, rows)
    dated = dated.join(reference_dates(rows), ["workbook", "sheet"])
    date = F.when(F.col("_day").isNull(), F.col("reference")).otherwise(day_of_month(F.col("reference"), F.col("_day").cast("string")))
    name = F.nullif(F.trim("c2"), F.lit(""))
    out = dated.select("workbook", "sheet", "row_no", date.alias("gl_date"), number.alias("rc_no"), F.col("c2").alias("raw_name"), F.coalesce(clean_name(name), F.lit(UNKNOWN)).alias("name"), F.coalesce(odd_name(name), F.lit(False)).alias("flagged"), amount.alias("amount"), F.lit("DEBIT").alias("type"))
    out = out.withColumn("month_label", F.date_format("gl_date", "MMM yyyy"))
    return out.where(F.col("gl_date") >= F.to_date(F.lit(cutoff))) if cutoff else out


def receipt_audit(cash: DataFrame) -> DataFrame:
    """By month, in order: receipts and sum; and receipt numbers that stand more than once in it."""
    twice = cash.groupBy("rc_no").agg(F.count(F.lit(1)).alias("_n"))
    rows = cash.join(twice, "rc_no", "left")
    return rows.groupBy("month_label").agg(F.min(F.trunc("gl_date", "month")).alias("month"), F.count(F.lit(1)).alias("n"), F.sum("amount").cast(MONEY).alias("total"), F.lit(0).cast(MONEY).alias("credit"), F.count_if(F.col("_n") > 1).alias("repeated_numbers")).orderBy("month")


def apply_lexicon(names: DataFrame, lexicon: DataFrame, name: str = "name") -> DataFrame:
    """names with spelled: the lexicon's text (source, target) for the whole name, else word by word, words it lacks as they are."""
    words = names.select(name).distinct().select(name, F.posexplode(F.split(name, " ")).alias("_place", "source"))
    known = lexicon.select("source", "target").dropDuplicates(["source"])
    spelled = words.join(known, "source", "left").groupBy(name).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", F.coalesce("target", "source").alias("word")))), lambda x: x.word), " ").alias("_words"))
    whole = known.select(F.col("source").alias(name), F.col("target").alias("_whole"))
    return names.join(whole, name, "left").join(spelled, name, "left").withColumn("spelled", F.coalesce("_whole", "_words")).drop("_whole", "_words")


def update_lexicon(lexicon: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lexicon with corrections (source, target, seq): each whole, and word by word where both have as many words; later ones win, empty targets delete."""
    pair = F.arrays_zip(F.split("source", " ").alias("s"), F.split("target", " ").alias("t"))
    same = F.size(F.split("source", " ")) == F.size(F.split("target", " "))
    words = corrections.where(same & (F.col("target") != "")).select(F.explode(pair).alias("p"), "seq").select(F.col("p.s").alias("source"), F.col("p.t").alias("target"), "seq", F.lit(1).alias("rank"))
    new = words.union(corrections.select("source", "target", "seq", F.lit(2).alias("rank"))).union(lexicon.select("source", "target", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("rank")))
    return new.groupBy("source").agg(F.max_by("target", F.struct("seq", "rank")).alias("target")).where("target <> ''")


def clean_lexicon(entries: DataFrame, script: str = r"\x{0C00}-\x{0C7F}") -> DataFrame:
    """Single words with letters of the script (by default Telugu), without the address in source or target; the least target where words meet."""
    source = plain_name(F.col("source"))
    target = F.trim(F.regexp_replace(F.regexp_replace("target", r"(?iU)\b(" + "|".join(ADDRESS_SPELLINGS) + r")\b", ""), r"\s+", " "))
    own = entries.where(F.col("source").rlike(f"[{script}]")).select(source.alias("source"), target.alias("target"))
    return own.where("source <> '' AND target <> '' AND NOT contains(source, ' ')").groupBy("source").agg(F.min("target").alias("target"))
