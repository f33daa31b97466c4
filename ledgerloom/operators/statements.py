"""Text statements to transactions.

Lines are rows (statement_id, line_no, line). Rows that go on from a dated line belong to its
island, the running count of dated lines; islands are formed before any filter. Every parser gives
(statement_id, seq, gl_date, value_date, narration, amount, balance), and bank_indicator where one
is printed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts
from ledgerloom.functions.dates import any_date, day_month_year
from ledgerloom.operators import scans
from ledgerloom.operators.ledger import from_date
from ledgerloom.operators.rounds import written
from ledgerloom.operators.signs import balance_errors, by_delta

DASHED = r"^\d{1,2}-\d{1,2}-\d{4}$"
SLASHED = r"^\d{1,2}/\d{1,2}/\d{4}$"
DECIMAL = r"^-?[0-9,]+\.[0-9]{2}$"
RESULT = ("statement_id", "seq", "gl_date", "value_date", "narration", "amount", "balance")

#: Our own marks by which a statement's profile is told.
PROFILE_MARKS = {"dash_two_dates": ("value date", "cr/dr"), "printed_side": ("particulars", "init.br"), "slash_dates": ("post date", "branch code")}


def lines_of(texts: DataFrame) -> DataFrame:
    """(statement_id, text) as lines, numbered from 0."""
    return texts.select("statement_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def is_readable(pages: DataFrame, least: int = 50) -> DataFrame:
    """By document: whether some page holds more than `least` characters of text."""
    return pages.groupBy("statement_id").agg((F.max(F.coalesce(F.length(F.trim("page_text")), F.lit(0))) > least).alias("readable"))


def matches_profile(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return out


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("t", words_of(F.col("line")))


def _starts(pattern: str, least: int) -> Column:
    return (F.size("t") >= least) & F.get("t", F.lit(0)).rlike(pattern) & F.get("t", F.lit(1)).rlike(pattern)


def _numbered_islands(lines: DataFrame, start: Column, most: int = scans.MOST) -> DataFrame:
    """lines with _start and _island, the running count of starts, from the first start on."""
    marked = lines.withColumn("_start", F.coalesce(start, F.lit(False)))
    return scans.running_sum(marked, ["statement_id"], ["line_no"], F.col("_start").cast("int"), "_island", most, lines).where("_island > 0")


def islands(lines: DataFrame, start: Column, stop: Column | None = None, most: int = scans.MOST) -> DataFrame:
    """One row per dated line: its tokens and the text of the lines that go on from it, up to a stop line."""
    marked = _numbered_islands(lines, start, most)
    if stop is not None:
        inner = Window.partitionBy("statement_id", "_island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marked = marked.withColumn("_stopped", F.max(F.when(~F.col("_start"), stop.cast("int")).otherwise(0)).over(inner)).where("_stopped = 0")
    more = F.when(~F.col("_start") & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("line")))
    return marked.groupBy("statement_id", "_island").agg(F.min("line_no").alias("seq"), F.first(F.when(F.col("_start"), F.col("t")), ignorenulls=True).alias("t"), F.array_join(F.transform(F.sort_array(F.collect_list(more)), lambda x: x.line), " ").alias("more"))


def _joined(tokens: Column, more: Column | None = None) -> Column:
    text = F.array_join(tokens, " ")
    return text if more is None else F.trim(F.concat_ws(" ", text, F.nullif(more, F.lit(""))))


def dash_two_dates(lines: DataFrame) -> DataFrame:
    """date date narration... amount balanceCr/Dr: the last token with a mark is the balance, the token before it the amount.

    Where that balance stands earlier in the line already, the first place counts.
    """
    rows = _tokens(lines).where(_starts(DASHED, 4)).withColumnRenamed("line_no", "seq")
    marked = F.filter("t", lambda w: F.lower(w).rlike(r"[0-9](cr|dr)\.?$"))
    rows = rows.withColumn("_b", F.try_element_at(marked, F.lit(-1))).where("_b IS NOT NULL").withColumn("_at", F.array_position("t", F.col("_b")).cast("int")).where("_at > 3")
    rows = rows.withColumn("amount", amounts.marked_amount(F.get("t", F.col("_at") - 2))).where("amount IS NOT NULL")
    return rows.select("statement_id", "seq", day_month_year(F.col("t")[0]).alias("gl_date"), day_month_year(F.col("t")[1]).alias("value_date"), _joined(F.slice("t", F.lit(3), F.col("_at") - 4)).alias("narration"), "amount", amounts.suffixed_balance(F.col("_b")).alias("balance"))


def printed_side(lines: DataFrame) -> DataFrame:
    """date date particulars... amount DR/CR balance, narration going on in the lines below until a blank one."""
    rows = islands(_tokens(lines), _starts(DASHED, 6), F.trim("line") == "")
    side = F.filter(F.transform("t", lambda w, i: F.struct(i.alias("i"), F.upper(w).alias("w"))), lambda x: (x.i > 2) & x.w.isin("DR", "CR"))
    rows = rows.withColumn("_side", F.get(side, F.lit(0))).where("_side IS NOT NULL").withColumn("_at", F.col("_side.i"))
    return rows.select("statement_id", "seq", day_month_year(F.col("t")[0]).alias("gl_date"), day_month_year(F.col("t")[1]).alias("value_date"), _joined(F.slice("t", F.lit(3), F.col("_at") - 3), F.col("more")).alias("narration"), amounts.unsigned_amount(F.get("t", F.col("_at") - 1)).alias("amount"), amounts.unsigned_amount(F.get("t", F.col("_at") + 1)).alias("balance"), F.col("_side.w").alias("bank_indicator"))


def _read(amount: Column, gl_date: Column, value_date: Column, narration: Column, balance: Column) -> Column:
    """What a parser reads of an island; null without an amount."""
    return F.when(amount.isNotNull(), F.struct(gl_date.alias("gl_date"), value_date.alias("value_date"), F.coalesce(narration, F.lit("")).alias("narration"), amount.alias("amount"), balance.alias("balance")))


def _rows_read(rows: DataFrame, read: Column) -> DataFrame:
    return rows.withColumn("_read", read).where("_read IS NOT NULL").select("statement_id", "seq", "_read.*")


def _numeric_tail(t: Column, more: Column, candidates: Column, gl_date: Column, value_date: Column) -> Column:
    """Balance from the last token, amount from the last numeric candidate before it; the rest is narration."""
    amount, last = F.try_element_at(candidates, F.lit(-1)), F.try_element_at(t, F.lit(-1))
    text = F.filter(F.slice(t, F.lit(3), F.greatest(F.size(t) - 2, F.lit(0))), lambda w: (w != last) & (w != amount))
    return F.when(amount.isNotNull(), _read(amounts.unsigned_amount(amount), gl_date, value_date, _joined(text, more), amounts.unsigned_amount(last)))


def _posted_start() -> Column:
    return _starts(SLASHED, 4) & F.try_element_at(F.col("t"), F.lit(-1)).rlike(DECIMAL)


def _posted(t: Column, more: Column) -> Column:
    numbers = F.filter(F.slice(t, F.lit(3), F.greatest(F.size(t) - 3, F.lit(0))), lambda w: w.rlike(DECIMAL))
    return _numeric_tail(t, more, numbers, day_month_year(F.get(t, F.lit(0))), day_month_year(F.get(t, F.lit(1))))


def slash_posted(lines: DataFrame) -> DataFrame:
    """d/m/y posted, d/m/y value, description... amount balance; any number before the balance can be the amount, the last is."""
    return _rows_read(islands(_tokens(lines), _posted_start()), _posted(F.col("t"), F.col("more")))


def _valued_start() -> Column:
    return _starts(SLASHED, 5) & F.try_element_at(F.col("t"), F.lit(-1)).rlike(DECIMAL)


def _valued(t: Column, more: Column) -> Column:
    near = F.slice(t, F.greatest(F.size(t) - 3, F.lit(3)), F.greatest(F.least(F.lit(3), F.size(t) - 3), F.lit(0)))
    return _numeric_tail(t, more, F.filter(near, lambda w: w.rlike(r"^[0-9,]+(\.[0-9]+)?$")), day_month_year(F.get(t, F.lit(1))), day_month_year(F.get(t, F.lit(0))))


def slash_valued(lines: DataFrame) -> DataFrame:
    """d/m/y value, d/m/y posted, description... ; the amount is among the three tokens before the balance."""
    return _rows_read(islands(_tokens(lines), _valued_start()), _valued(F.col("t"), F.col("more")))


MONTH_DATE = r"\d{1,2} (?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def stitch_years(lines: DataFrame) -> DataFrame:
    """Lines that end in a date without its year take the year from the start of the next line."""
    order = Window.partitionBy("statement_id").orderBy("line_no")
    cut = F.trim("line").rlike(rf"({MONTH_DATE} \d{{4}} )?{MONTH_DATE}$")
    after = F.lead("line").over(order)
    took = F.lag(cut & after.rlike(r"^\s*\d{4}\b")).over(order)
    stitched = F.when(cut & after.rlike(r"^\s*\d{4}\b"), F.concat_ws(" ", F.trim("line"), F.regexp_extract(after, r"^\s*(\d{4})", 1))).when(F.coalesce(took, F.lit(False)), F.regexp_replace("line", r"^\s*\d{4}\s*", "")).otherwise(F.col("line"))
    return lines.withColumn("line", stitched)


MONTH_HEAD = rf"^\s*({MONTH_DATE} \d{{4}}) ({MONTH_DATE} \d{{4}})\b"


def _by_month(head: Column, lines: Column) -> Column:
    """Of an island's lines (start, line), in order: dates from the head, amount and balance from the last line with two numbers, the rest is narration."""
    words = F.transform(lines, lambda x: words_of(F.when(x["start"], F.regexp_replace(x["line"], MONTH_HEAD, "")).otherwise(x["line"])))
    numbers = F.transform(words, lambda t: F.filter(t, lambda w: w.rlike(DECIMAL)))
    pair = F.try_element_at(F.filter(numbers, lambda n: F.size(n) >= 2), F.lit(-1))
    text = F.array_join(F.flatten(F.transform(words, lambda t: F.filter(t, lambda w: ~w.rlike(DECIMAL)))), " ")
    date = lambda i: any_date(F.regexp_extract(head, MONTH_HEAD, i))
    number = lambda i: amounts.strict_amount(F.try_element_at(pair, F.lit(i)))
    return F.when(pair.isNotNull(), _read(number(-2), date(1), date(2), text, number(-1)))


def month_names(lines: DataFrame) -> DataFrame:
    """d Mon y d Mon y description, then lines; the last line with two two-decimal numbers gives amount and balance."""
    rows = _numbered_islands(stitch_years(lines), F.col("line").rlike(MONTH_HEAD))
    each = F.sort_array(F.collect_list(F.struct("line_no", F.col("_start").alias("start"), "line")))
    blocks = rows.groupBy("statement_id", "_island").agg(F.min("line_no").alias("seq"), F.max(F.when(F.col("_start"), F.col("line"))).alias("head"), each.alias("lines"))
    return _rows_read(blocks, _by_month(F.col("head"), F.col("lines")))


NOISE = "balance brought|page no|txn date"


def _wrapped_start() -> Column:
    dates = F.array_join(F.slice("t", F.lit(1), F.lit(6)), " ").rlike(rf"^{MONTH_DATE} \d{{4}} {MONTH_DATE} \d{{4}}$")
    return (F.size("t") >= 8) & dates & F.try_element_at(F.col("t"), F.lit(-1)).rlike(DECIMAL) & F.get("t", F.size("t") - 2).rlike(DECIMAL)


def _wrapped(t: Column, more: Column) -> Column:
    date = lambda i: any_date(F.array_join(F.slice(t, F.lit(i), F.lit(3)), " "))
    text = _joined(F.slice(t, F.lit(7), F.greatest(F.size(t) - 8, F.lit(0))), more)
    return _read(amounts.unsigned_amount(F.get(t, F.size(t) - 2)), date(1), date(4), text, amounts.unsigned_amount(F.try_element_at(t, F.lit(-1))))


def wrapped(lines: DataFrame) -> DataFrame:
    """Older wrapped layout: at least eight tokens, two month-name dates of three tokens each, amount and balance last."""
    rows = _tokens(lines).where(~F.lower("line").rlike(NOISE))
    return _rows_read(islands(rows, _wrapped_start()), _wrapped(F.col("t"), F.col("more")))


def candidates(lines: DataFrame, most: int = scans.MOST) -> DataFrame:
    """(statement_id, parser, seq, what the parser reads): the rows of all parsers of the cascade, from one scan of the lines.

    Each line is split into words once and told to begin an island or not for each parser; one window counts the
    islands of all four; a line then goes to the island it is in, for each parser that has one there.
    """
    rows = stitch_years(lines.withColumn("_plain", F.col("line"))).withColumnsRenamed({"line": "_stitched", "_plain": "line"})
    rows = _tokens(rows)
    starts = (_posted_start(), _valued_start(), F.col("_stitched").rlike(MONTH_HEAD), _wrapped_start() & ~F.lower("line").rlike(NOISE))
    rows = rows.withColumns({f"_start{k}": F.coalesce(start, F.lit(False)) for k, start in enumerate(starts)}).drop("t")
    rows = scans.running_sums(rows, ["statement_id"], ["line_no"], {f"_island{k}": F.col(f"_start{k}").cast("int") for k in range(len(starts))}, most, lines)
    line = lambda k: F.col("_stitched" if k == 2 else "line")
    held = lambda k: (F.col(f"_island{k}") > 0) & (F.lit(True) if k != 3 else ~F.lower("line").rlike(NOISE))
    of_parser = [F.when(held(k), F.struct(F.lit(k).alias("parser"), F.col(f"_island{k}").alias("island"), F.col(f"_start{k}").alias("start"), line(k).alias("line"))) for k in range(len(starts))]
    each = rows.select("statement_id", "line_no", F.inline(F.array_compact(F.array(*of_parser))))
    gathered = each.groupBy("statement_id", "parser", "island").agg(F.min("line_no").alias("seq"), F.max(F.when(F.col("start"), F.col("line"))).alias("head"), F.sort_array(F.collect_list(F.struct("line_no", "start", "line"))).alias("lines"))
    more = F.array_join(F.transform(F.filter("lines", lambda x: ~x["start"] & (F.trim(x["line"]) != "")), lambda x: F.trim(x["line"])), " ")
    gathered = gathered.withColumns({"t": words_of(F.col("head")), "more": more})
    t, more = F.col("t"), F.col("more")
    read = F.when(F.col("parser") == 0, _posted(t, more)).when(F.col("parser") == 1, _valued(t, more)).when(F.col("parser") == 2, _by_month(F.col("head"), F.col("lines"))).otherwise(_wrapped(t, more))
    return gathered.withColumn("_read", read).where("_read IS NOT NULL").select("statement_id", "parser", "seq", "_read.*")


def cascade(lines: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Rows of the first parser (slash_posted, slash_valued, month_names, wrapped) whose balances add up in the statement; none if no parser's do.

    The choice is one aggregation over candidates() and a join on the few (statement, parser) pairs.
    """
    tried = written(candidates(lines), "statement-candidates")
    if openings is not None:
        tried = tried.join(openings.select("statement_id", "opening"), "statement_id", "left")
    else:
        tried = tried.withColumn("opening", F.lit(None).cast(amounts.MONEY))
    signed = by_delta(tried.withColumn("account", F.struct("statement_id", "parser"))).withColumn("balance", F.col("balance_used"))
    good = balance_errors(signed).where("accepted").groupBy(F.col("account.statement_id").alias("statement_id")).agg(F.min("account.parser").alias("parser"))
    return signed.join(good, ["statement_id", "parser"]).drop("account", "balance_used", "delta", "opening")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"dash_two_dates": dash_two_dates, "printed_side": printed_side, "slash_dates": cascade}


def parser_of(profile: str) -> Callable[[DataFrame], DataFrame]:
    if profile not in PARSERS:
        raise ValueError(f"unknown profile {profile}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[profile]


#: Labels of an opening balance, with a remark in brackets or a date after them, and the amount.
OPENING = r"(?i)(?:(?<!closing )\bbalance\s+as\s+on\s+[^:]+:|(?:opening\s+balance|brought\s+forward|\bb/f|\bclear\s+balance)(?:\s*\([^)]*\))?(?:\s+as\s+on\s+[^:]*:)?)[^0-9\-]*(-?[0-9,]+(?:\.[0-9]+)?\s*(?:cr|dr)?)"


def opening_balances(lines: DataFrame) -> DataFrame:
    """By statement: the first labelled opening balance, negative with a Dr mark."""
    found = lines.withColumn("_o", F.nullif(F.regexp_extract("line", OPENING, 1), F.lit(""))).where("_o IS NOT NULL")
    return found.groupBy("statement_id").agg(F.min_by(amounts.suffixed_balance(F.col("_o")), "line_no").alias("opening"))


LEADING_DATE = r"^\s*(\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2} [A-Za-z]{3,9}(?: \d{4})?)"


def slice_from(lines: DataFrame, boundary: str, year: int | None = None) -> DataFrame:
    """Lines without those whose leading date is before the boundary; a leading date without a year gets the year given."""
    head = F.regexp_extract("line", LEADING_DATE, 1)
    if year is not None:
        head = F.when(head.rlike(r"[A-Za-z]$"), F.concat(head, F.lit(f" {year}"))).otherwise(head)
    date = any_date(F.nullif(head, F.lit("")))
    return lines.where(date.isNull() | (date >= F.to_date(F.lit(boundary))))


STRATEGIES = ("whole", "first", "continuation")


def ingest(lines: DataFrame, profile: str, strategy: str = "whole", boundary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions, openings). A continuation parses all lines, then keeps rows from the boundary on and has no opening."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    rows, openings = parser_of(profile)(lines), opening_balances(lines)
    if strategy == "continuation":
        rows, openings = from_date(rows, boundary), openings.limit(0)
    return rows, openings


def coverage(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """By statement: lines after the last transaction's line that look like one (a date and a two-decimal number) and are later."""
    ends = rows.groupBy("statement_id").agg(F.max("seq").alias("_last"), F.max("gl_date").alias("_date"))
    date = any_date(F.nullif(F.regexp_extract("line", LEADING_DATE, 1), F.lit("")))
    likely = lines.join(ends, "statement_id", "left").where((F.col("line_no") > F.coalesce("_last", F.lit(-1))) & F.col("line").rlike(r"\d\.\d{2}\b") & date.isNotNull() & (F.col("_date").isNull() | (date > F.col("_date"))))
    return likely.groupBy("statement_id").agg(F.count(F.lit(1)).alias("missed"))
