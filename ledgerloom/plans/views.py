"""The driver's tables seen as ledgers, registers and statements; each view as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.operators import gst
from ledgerloom.operators import ledger as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: customers are accounts; finished orders debit, open ones credit, the rest unknown."""
    o = table(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("date")
    kind = F.when(F.col("o_orderstatus") == "F", "DEBIT").when(F.col("o_orderstatus") == "O", "CREDIT").otherwise("UNKNOWN")
    return o.select(
        F.col("o_custkey").alias("account"),
        (F.unix_date(date) * F.lit(100_000_000).cast("long") + F.col("o_orderkey")).alias("seq"),
        F.col("o_orderkey").alias("id"),
        date.alias("gl_date"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        kind.alias("type"),
        F.concat(F.lit("NEFT "), F.lower("o_orderpriority"), F.lit(" REF "), F.col("o_orderkey").cast("string")).alias("narration"),
        F.when(F.col("o_orderkey") % 7 == 0, "Suspense").otherwise(F.col("o_orderpriority")).alias("particulars"),
        (F.col("o_orderkey") % 5 == 0).alias("modified"),
        F.when(kind == "CREDIT", "Payment").otherwise("Receipt").alias("vch_type"),
    )


LEDGER = """v_ledger AS (
  SELECT o_custkey AS account, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 100000000 + o_orderkey AS seq, o_orderkey AS id,
    CAST(o_orderdate AS DATE) AS gl_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'DEBIT' WHEN 'O' THEN 'CREDIT' ELSE 'UNKNOWN' END AS type,
    'NEFT ' || lower(o_orderpriority) || ' REF ' || o_orderkey AS narration,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Suspense' ELSE o_orderpriority END AS particulars, o_orderkey % 5 = 0 AS modified,
    CASE WHEN o_orderstatus = 'O' THEN 'Payment' ELSE 'Receipt' END AS vch_type
  FROM orders)"""
SIGNED = "CASE type WHEN 'DEBIT' THEN amount WHEN 'CREDIT' THEN -amount ELSE 0 END"


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's rows with a side, their running balance over an opening of 1000."""
    return L.running_balance(L.valid_only(ledger(spark, sf_dir)), F.lit(1000))


BALANCED = f"""v_balanced AS (
  SELECT *, CAST(1000 + sum({SIGNED}) OVER (PARTITION BY account ORDER BY seq) AS DECIMAL(18,2)) AS balance FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT'))"""


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a statement prints of the balanced ledger: no side but a mark, and some amounts misread. Every third account is overdrawn."""
    rows = balanced(spark, sf_dir)
    amount = F.when(F.col("id") % 11 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(MONEY)
    opening = F.when(F.col("account") % 3 == 0, F.lit(-1000)).otherwise(F.lit(1000)).cast(MONEY)
    return rows.select("account", "seq", amount.alias("amount"), "balance", opening.alias("opening"), F.when(F.col("id") % 2 == 0, F.when(F.col("type") == "DEBIT", "CR").otherwise("DR")).alias("bank_indicator"))


PRINTED = """v_printed AS (
  SELECT account, seq, CAST(CASE WHEN id % 11 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(18,2)) AS amount, balance,
    CAST(CASE WHEN account % 3 = 0 THEN -1000 ELSE 1000 END AS DECIMAL(18,2)) AS opening,
    CASE WHEN id % 2 = 0 THEN CASE WHEN type = 'DEBIT' THEN 'CR' ELSE 'DR' END END AS bank_indicator FROM v_balanced),
v_moves AS (
  SELECT *, used - coalesce(lag(used) OVER (PARTITION BY account ORDER BY seq), opening) AS delta
  FROM (SELECT *, CASE WHEN opening < 0 THEN -abs(balance) ELSE balance END AS used FROM v_printed))"""


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vouchers booked before: two thirds of the ledger, a cent or a day off here and there."""
    rows = ledger(spark, sf_dir).where("id % 3 <> 0")
    return rows.withColumn("amount", (F.col("amount") + (F.col("id") % 4 - 1) * F.lit("0.01").cast(MONEY)).cast(MONEY)).withColumn("gl_date", F.date_add("gl_date", (F.col("id") % 2).cast("int"))).withColumn("narration", F.when(F.col("id") % 2 == 0, F.col("narration")).otherwise("cheque"))


BOOKED = """v_booked AS (
  SELECT account, seq, id, gl_date + CAST(id % 2 AS INTEGER) AS gl_date, CAST(amount + (id % 4 - 1) * 0.01 AS DECIMAL(18,2)) AS amount, type,
    CASE WHEN id % 2 = 0 THEN narration ELSE 'cheque' END AS narration, particulars, vch_type FROM v_ledger WHERE id % 3 <> 0)"""


#: The rate that stands for a tax of 0 %, 1 % and so on.
RATES = (0, 1, 1.5, 3, 5, 12, 18, 28, 40)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a sales register; customer and supplier nations stand for states, taxes of 0 to 8 % for the rates of RATES."""
    rates = F.array(*[F.lit(r).cast("decimal(9,3)") for r in RATES])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem")
    n = gst.tasks_for(lines)
    # customers and suppliers first: what is dealt by order into so many tasks stays so up to the return
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).repartition(n, "o_orderkey")
    lines = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).repartition(n, "l_orderkey")
    lines = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    taxable = F.round(F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return lines.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("recipient"), F.col("l_orderkey").alias("invoice"), F.row_number().over(order).alias("row_no"), F.col("o_orderdate").cast("date").alias("invoice_date"), F.col("o_totalprice").cast(MONEY).alias("invoice_value"), F.col("c_nationkey").alias("place"), F.col("s_nationkey").alias("state"), taxable.alias("taxable"), rates[F.round(F.col("l_tax") * 100).cast("int")].alias("rate"), F.when(F.col("l_linenumber") == 3, F.lit("1.25")).alias("cess"), F.when(F.col("l_orderkey") % 4 == 0, F.lit("Yes")).alias("reverse_charge"), F.when(F.col("l_orderkey") % 5 == 0, F.lit("SEZ supplies without payment")).alias("invoice_type"))


REGISTER = f"""v_register AS (
  SELECT 'C' || o_custkey AS recipient, l_orderkey AS invoice, CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_totalprice AS DECIMAL(18,2)) AS invoice_value,
    c_nationkey AS place, s_nationkey AS state, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS taxable,
    CAST([{', '.join(map(str, RATES))}][CAST(round(l_tax * 100) AS INTEGER) + 1] AS DECIMAL(9,3)) AS rate, CAST(CASE WHEN l_linenumber = 3 THEN 1.25 ELSE 0 END AS DECIMAL(18,2)) AS cess,
    CASE WHEN l_orderkey % 4 = 0 THEN 'Y' ELSE 'N' END AS reverse_charge, CASE WHEN l_orderkey % 5 = 0 THEN 'SEWOP' ELSE 'R' END AS invoice_type,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS item_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
v_taxed AS (
  SELECT *, CAST(CASE WHEN place = state THEN round(CAST(total AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)), 2) ELSE 0 END AS DECIMAL(18,2)) AS half, CAST(CASE WHEN place = state THEN 0 ELSE total END AS DECIMAL(18,2)) AS igst
  FROM (SELECT *, CAST(round(CAST(taxable * rate AS DECIMAL(26,5)) * 0.01, 2) AS DECIMAL(18,4)) AS total FROM v_register))"""


HSN_RATES = ("0", "1.5", "5", "18")


def hsn_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an HSN summary of ten files, with divider rows."""
    k = F.col("p_partkey")
    label = F.when(k % 50 == 0, "B2C supplies").when(k % 50 == 25, "B2B supplies").when(k % 50 == 49, "Total").otherwise((k * 7 + 123).cast("string"))
    value = F.col("p_retailprice").cast(MONEY)
    half = F.round(value * F.lit("0.025").cast("decimal(4,3)"), 2).cast(MONEY)
    within = lambda c: F.when(k % 2 == 0, c).otherwise(0).cast(MONEY)
    beyond = F.when(k % 2 == 1, half * 2).otherwise(0).cast(MONEY)
    return table(spark, sf_dir, "part").select((k % 10).alias("file"), k.alias("row_no"), label.alias("hsn"), F.concat(F.when(k % 3 == 0, "nos-numbers").otherwise(""), F.lit("")).alias("uqc"), F.col("p_size").cast(MONEY).alias("qty"), value.alias("value"), value.alias("taxable"), beyond.alias("igst"), within(half).alias("cgst"), within(half).alias("sgst"), (k % 7).cast("string").alias("cess"), F.concat(F.lit(" "), F.col("p_name")).alias("desc"), F.concat(F.get(F.array(*map(F.lit, HSN_RATES)), k % 4), F.lit("%")).alias("rate"))


def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("narration"))


def statement_lines(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """The balanced ledger printed line by line in a layout, a statement per account, and a stray heading before each."""
    rows = balanced(spark, sf_dir)
    plain = F.abs("balance").cast("string")
    date = lambda f: F.date_format("gl_date", f)
    forms = {
        "dash": F.concat_ws(" ", date("dd-MM-yyyy"), date("dd-MM-yyyy"), "narration", F.col("amount").cast("string"), F.concat(plain, F.when(F.col("balance") < 0, "Dr").otherwise("Cr"))),
        "side": F.concat_ws(" ", date("dd-MM-yyyy"), date("dd-MM-yyyy"), "narration", F.col("amount").cast("string"), F.when(F.col("type") == "DEBIT", "CR").otherwise("DR"), plain),
        "slash": F.concat_ws(" ", date("dd/MM/yyyy"), date("dd/MM/yyyy"), "narration", F.col("amount").cast("string"), plain),
        "month": F.concat_ws(" ", date("d MMM yyyy"), date("d MMM yyyy"), "narration", F.col("amount").cast("string"), plain),
    }
    lines = rows.select(F.col("account").alias("statement_id"), (F.col("seq") * 10).alias("line_no"), forms[layout].alias("line"))
    more = rows.where("id % 4 = 0").select(F.col("account").alias("statement_id"), (F.col("seq") * 10 + 1).alias("line_no"), F.lit("to shop").alias("line"))
    head = rows.select(F.col("account").alias("statement_id")).distinct().select("statement_id", F.lit(-1).cast("long").alias("line_no"), F.lit("Opening Balance : 1,000.00 Cr").alias("line"))
    return lines.union(head) if layout == "dash" else lines.union(more).union(head)


def cascade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced ledger printed in four layouts, by account, of which each parser of the cascade reads one.

    Amounts of the second have three decimals, so that the first parser knows none. The third has amount and balance in a line of
    their own. The fourth is followed by lines of two numbers that are neither, but for accounts of one row.
    """
    rows = balanced(spark, sf_dir).join(balanced(spark, sf_dir).groupBy("account").agg(F.count(F.lit(1)).alias("n")), "account")
    plain, amount, kind = F.abs("balance").cast("string"), F.col("amount").cast("string"), F.col("account") % 4
    dates = lambda f: F.concat_ws(" ", F.date_format("gl_date", f), F.date_format("gl_date", f), "narration")
    slashed, named = dates("dd/MM/yyyy"), dates("d MMM yyyy")
    line = F.when(kind == 0, F.concat_ws(" ", slashed, amount, plain)).when(kind == 1, F.concat_ws(" ", slashed, F.concat(amount, F.lit("0")), plain)).when(kind == 2, named).otherwise(F.concat_ws(" ", named, amount, plain))
    after = F.when(kind == 2, F.concat_ws(" ", amount, plain)).when(kind == 3, F.when(F.col("n") > 1, "at 1.00 2.00")).when(F.col("id") % 4 == 0, "to shop")
    lines = rows.select(F.col("account").alias("statement_id"), (F.col("seq") * 10).alias("line_no"), line.alias("line"))
    more = rows.select(F.col("account").alias("statement_id"), (F.col("seq") * 10 + 1).alias("line_no"), after.alias("line")).where("line IS NOT NULL")
    head = rows.select(F.col("account").alias("statement_id")).distinct().select("statement_id", F.lit(-1).cast("long").alias("line_no"), F.lit("Opening Balance : 1,000.00 Cr").alias("line"))
    return lines.union(more).union(head)


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced ledger as document tables: pages of 20 rows, the header repeated, some narrations going on in an undated row."""
    rows = balanced(spark, sf_dir)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    debit = F.when(F.col("type") == "CREDIT", F.col("amount"))
    credit = F.when(F.col("type") == "DEBIT", F.col("amount"))
    cells = F.array(F.date_format("gl_date", "d/M/yyyy"), F.col("narration"), text(debit), text(credit), F.col("balance").cast("string"))
    page = F.floor((F.row_number().over(Window.partitionBy("account").orderBy("seq")) - 1) / 20).cast("int")
    rows = rows.withColumn("page", page)
    place = [F.col("account").alias("statement_id"), F.col("page"), F.lit(0).alias("table_no")]
    body = rows.select(*place, (F.col("seq") * 10).alias("row_no"), cells.alias("cells"))
    more = rows.where("id % 4 = 0").select(*place, (F.col("seq") * 10 + 1).alias("row_no"), F.array(F.lit(""), F.lit("to shop"), F.lit(""), F.lit(""), F.lit("")).alias("cells"))
    header = F.array(*[F.lit(h) for h in ("Txn Date", "Narration", "Withdrawal", "Deposit", "Balance")])
    one = rows.select(*place).distinct()
    heads = one.select("statement_id", "page", "table_no", F.lit(-1).cast("long").alias("row_no"), header.alias("cells")).union(one.select("statement_id", "page", "table_no", F.lit(1 << 60).cast("long").alias("row_no"), header.alias("cells")))
    return body.union(more).union(heads)


def cash_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cash sheets: a sheet per user, dates blank in every third row, days or fragments of dates in some, every twentieth receipt number used twice, some names missing, some amounts no number."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    sheets = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    day = F.date_format("ts", "dd-MM-yyyy")
    cell = F.when(k == F.col("first"), day).when(k % 3 == 0, "").when(k % 5 == 0, F.dayofmonth("ts").cast("string")).when(k % 7 == 0, F.date_format("ts", "d-M-")).when(k % 11 == 0, F.date_format("ts", "d/M")).otherwise(day)
    number = F.concat((k - (k % 20 == 1).cast("int")).cast("string"), F.lit(".0"))
    name = F.when(k % 13 != 0, F.concat(F.lit("Sri "), F.col("event_type")))
    amount = F.when((k % 17 == 0) & (k != F.col("first")), "n/a").otherwise(F.floor(F.abs("value")).cast("long").cast("string"))
    return e.join(sheets, "user_id").select(F.lit("book").alias("workbook"), F.col("user_id").cast("string").alias("sheet"), k.alias("row_no"), cell.alias("c0"), number.alias("c1"), name.alias("c2"), F.lit("").alias("c3"), amount.alias("c4"))


CASH = """v_cash AS (
  SELECT user_id, event_id, ts, event_type, min(event_id) OVER (PARTITION BY user_id) AS first,
    CAST(CASE WHEN event_id % 17 = 0 AND event_id <> min(event_id) OVER (PARTITION BY user_id) THEN 0 ELSE CAST(floor(abs(value)) AS BIGINT) END AS DECIMAL(18,2)) AS amount,
    event_id % 3 <> 0 OR event_id = min(event_id) OVER (PARTITION BY user_id) AS dated
  FROM events),
v_carried AS (
  SELECT c.*, s.ts AS from_ts, f.ts AS first_ts FROM (
    SELECT *, max(CASE WHEN dated THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS src FROM v_cash) c
  JOIN v_cash s ON s.user_id = c.user_id AND s.event_id = c.src JOIN v_cash f ON f.user_id = c.user_id AND f.event_id = c.first),
v_receipts AS (
  SELECT user_id, event_id, amount, event_type, CAST(CASE WHEN event_id % 20 = 1 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS rc_no,
    CASE WHEN event_id % 13 <> 0 THEN 'Sri ' || event_type END AS raw_name,
    CASE WHEN day(from_ts) <= day(last_day(CAST(first_ts AS DATE))) THEN CAST(date_trunc('month', CAST(first_ts AS DATE)) AS DATE) + CAST(day(from_ts) - 1 AS INTEGER)
      ELSE CAST(first_ts AS DATE) END AS gl_date FROM v_carried)"""


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cash sheets of cash_cells() as .xlsx files (path, content), a file per user: dates are serial numbers with a date style, in the 1904 system for odd users."""
    cells = cash_cells(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("row_no"), "ts"), "row_no")
    dated = F.col("c0").rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$")
    from_1904 = F.col("sheet").cast("long") % 2 == 1
    days = F.unix_date(F.col("ts").cast("date")) + F.when(from_1904, 24107).otherwise(25569)
    cell = lambda column, value, text: F.when(value != "", F.concat(F.lit(f'<c r="{column}'), "row_no", F.lit('" t="inlineStr"><is><t>' if text else '"><v>'), value, F.lit("</t></is></c>" if text else "</v></c>"))).otherwise("")
    date = F.when(dated, F.concat(F.lit('<c r="A'), "row_no", F.lit('" s="1"><v>'), days.cast("string"), F.lit("</v></c>"))).otherwise(cell("A", F.col("c0"), True))
    parts = [date, cell("B", F.col("c1"), False), cell("C", F.coalesce("c2", F.lit("")), True), F.when(F.col("c4") == "n/a", cell("E", F.col("c4"), True)).otherwise(cell("E", F.col("c4"), False))]
    rows = cells.select("sheet", "row_no", F.concat(F.lit('<row r="'), "row_no", F.lit('">'), *parts, F.lit("</row>")).alias("xml"))
    sheets = rows.groupBy("sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "xml"))), lambda x: x.xml), "").alias("xml"))

    def zipped(batches):
        import io
        import zipfile

        import pyarrow as pa

        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        for batch in batches:
            out = []
            for sheet, xml in zip(*(c.to_pylist() for c in batch.columns)):
                with zipfile.ZipFile(held := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(sheet) % 2}"/><sheets><sheet name="{sheet}" r:id="r1"/></sheets></workbook>')
                    z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
                    z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
                    z.writestr("xl/worksheets/s.xml", f"<worksheet {main}><sheetData>{xml}</sheetData></worksheet>")
                out.append({"path": "book", "content": held.getvalue()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return sheets.mapInArrow(zipped, "path string, content binary")


#: Headers of document tables by account: usual ones, ones in another order, four columns with one amount, and two that no word tells.
LAYOUTS = (("Txn Date", "Narration", "Withdrawal", "Deposit", "Balance"), ("Balance", "Paid In", "Paid Out", "Details", "Date"), ("Date", "Particulars", "Amount", "Balance"), ("Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta"), ("A", "B", "C", "D", "E"))
SAVED_LAYOUT = ("house bank", {"date": 0, "narration": 1, "narration_2": 2, "debit": 3, "credit": 4, "balance": 5})


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced ledger as one table per account, in five layouts."""
    rows = balanced(spark, sf_dir)
    paid = F.col("type") == "CREDIT"
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    date, debit, credit, balance = F.date_format("gl_date", "d MMMM yyyy"), text(F.when(paid, F.col("amount"))), text(F.when(~paid, F.col("amount"))), F.col("balance").cast("string")
    marked = F.concat(F.col("amount").cast("string"), F.when(paid, " Dr").otherwise(" Cr"))
    cells = (F.array(date, "narration", debit, credit, balance), F.array(balance, credit, debit, "narration", date), F.array(date, "narration", marked, balance), F.array(date, "narration", "particulars", debit, credit, balance), F.array(date, "narration", debit, credit, balance))
    kind = F.col("account") % len(LAYOUTS)
    of_kind = lambda values: F.coalesce(*[F.when(kind == k, v) for k, v in enumerate(values)])
    place = [F.col("account").alias("statement_id"), F.lit(0).alias("page"), F.lit(0).alias("table_no")]
    heads = of_kind([F.array(*map(F.lit, h)) for h in LAYOUTS])
    return rows.select(*place, F.col("seq").alias("row_no"), of_kind(cells).alias("cells")).union(rows.select("account").distinct().select(*place, F.lit(-1).cast("long"), heads))


def layouts(spark: SparkSession) -> DataFrame:
    """The one layout that was saved."""
    name, mapping = SAVED_LAYOUT
    return spark.createDataFrame([(name, mapping, list(LAYOUTS[3]), len(LAYOUTS[3]))], "name string, mapping map<string,int>, headers array<string>, col_count int")


def said_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all conversations, and of them the lexicon: those of two to four letters a to z, each in angle brackets."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''").distinct()
    return words


def said_lexicon(words: DataFrame) -> DataFrame:
    return words.where(F.col("word").rlike("^[a-z]{2,4}$")).select(F.col("word").alias("source"), F.concat(F.lit("<"), "word", F.lit(">")).alias("target"))


WORDS_SAID = """v_said AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM conversations),
v_entries AS (SELECT word AS source, '<' || word || '>' AS target FROM v_said WHERE regexp_full_match(word, '[a-z]{2,4}'))"""
