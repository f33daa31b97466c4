"""The registered queries of the ledger library and the SQL they must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, narration, script, tax
from ledgerloom.operators import cash, chunks, gst, lexicon, linkage, phrases, rounds, search, signs, statements, tables, validate, vouchers
from ledgerloom.operators import ledger as L
from ledgerloom.plans import jobs
from ledgerloom.plans import views as V
from ledgerloom.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
S = V.SIGNED
DEBIT, CREDIT = (f"CAST(coalesce(sum(CASE WHEN type = '{s}' THEN amount END), 0) AS DECIMAL(18,2))" for s in L.SIDES)


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name, with its SQL over the views named."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = _plain_sql(f.__name__, ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + sql)
        return f

    return add


#: Columns that queries return as decimals and dates; results show them as doubles and as text.
DECIMALS = {
    "ledger_totals": "debit credit",
    "month_closings": "debit credit net closing",
    "cash_month_closings": "debit credit net closing",
    "months_with_grand_total": "debit credit",
    "running_balance": "amount balance",
    "monthly_summary": "debit credit first_balance opening closing",
    "back_computed_opening": "opening",
    "closing_balance": "closing",
    "month_reconciliation": "imported_debit imported_credit booked_debit booked_credit duplicate_debit duplicate_credit",
    "full_outer_months": "a_debit a_credit b_debit b_credit",
    "gst_invoices": "invoice_value taxable cgst sgst igst cess",
    "gst_totals": "taxable cgst sgst igst cess value",
    "gst_documents": "value taxable cgst sgst igst cess",
    "hsn_rows": "cess",
    "largest_months": "largest",
    "duplicate_closing": "debit credit closing",
    "reconciliation_report": "imported_debit imported_credit booked_debit booked_credit duplicate_debit duplicate_credit imported_closing booked_closing duplicate_closing",
    "hsn_totals": "qty taxable cgst sgst igst value",
    "parse_dash_dates": "amount balance",
    "parse_printed_side": "amount balance",
    "parse_slash_dates": "amount balance",
    "parse_slash_valued": "amount balance",
    "parse_month_names": "amount balance",
    "parse_wrapped": "amount balance",
    "opening_balances": "opening",
    "parse_tables": "amount balance",
    "parse_layouts": "amount balance",
    "balance_of_one_account": "balance",
    "cash_receipts": "amount",
    "workbook_receipts": "amount",
    "cash_audit": "total credit",
    "voucher_entries": "party_amount bank_amount",
    "flat_vouchers": "debit credit",
    "vouchers_of_ledger": "amount",
    "audit_sheet": "balance",
    "validation_report": "debit credit closing_movement",
    "amount_forms": "unsigned absolute dr marked",
}
DATES = {
    "running_balance": "gl_date",
    "review_filters": "gl_date",
    "date_bounds": "first last",
    "continuation_rows": "gl_date",
    "viewport": "gl_date",
    "gst_invoices": "invoice_date",
    "parse_dash_dates": "gl_date",
    "parse_printed_side": "gl_date",
    "parse_slash_dates": "gl_date",
    "parse_slash_valued": "gl_date",
    "parse_month_names": "gl_date",
    "parse_wrapped": "gl_date",
    "parse_tables": "gl_date",
    "parse_layouts": "gl_date",
    "cash_receipts": "gl_date",
    "workbook_receipts": "gl_date",
    "cash_audit": "month",
    "flat_vouchers": "gl_date",
    "date_forms": "a b c e f g h",
}


def _plain(df: DataFrame) -> DataFrame:
    """df with decimals as doubles and dates as text, which other engines' clients show alike."""
    kinds = {"decimal": "double", "date": "string"}
    return df.select(*[F.col(c).cast(kinds[k]).alias(c) if (k := t.split("(")[0]) in kinds else F.col(c) for c, t in df.dtypes])


def _plain_sql(name: str, sql: str) -> str:
    casts = [f'CAST("{c}" AS {t}) AS "{c}"' for cols, t in ((DECIMALS, "DOUBLE"), (DATES, "VARCHAR")) for c in cols.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


@query(f"SELECT {DEBIT} AS debit, {CREDIT} AS credit, count(*) AS n FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT')", V.LEDGER)
def ledger_totals(spark, d):
    return L.totals(V.ledger(spark, d))


@query("SELECT type, count(*) AS n FROM v_ledger GROUP BY type", V.LEDGER)
def type_counts(spark, d):
    return L.type_counts(V.ledger(spark, d))


MONTH = "strftime(gl_date, '%Y-%m')"
NORMAL_OF = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\pL\\pM\\pN]+', ' ', 'g'))"


@query(
    f"""SELECT account, month, n, debit, credit, CAST(debit - credit AS DECIMAL(18,2)) AS net, CAST(sum(debit - credit) OVER (PARTITION BY account ORDER BY month) AS DECIMAL(18,2)) AS closing
FROM (SELECT account, {MONTH} AS month, count(*) AS n, {DEBIT} AS debit, {CREDIT} AS credit FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT') GROUP BY ALL)""",
    V.LEDGER,
)
def month_closings(spark, d):
    return L.month_closings(V.ledger(spark, d))


@query(
    f"""SELECT account, month, n, row_number() OVER (ORDER BY account, month) AS place FROM (SELECT account, {MONTH} AS month, count(*) AS n FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT') GROUP BY ALL)
QUALIFY place <= 500""",
    V.LEDGER,
)
def months_in_order(spark, d):
    """The first 500 month rows of a report, with their places."""
    first = L.in_order(L.month_closings(V.ledger(spark, d))).limit(500)
    return first.select("account", "month", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("account", "month")).cast("long").alias("place"))


@query(
    f"""SELECT account, month, n, debit, credit, CAST(debit - credit AS DECIMAL(18,2)) AS net, CAST(500 + debit - credit AS DECIMAL(18,2)) AS closing
FROM (SELECT account, {MONTH} AS month, count(*) AS n, {DEBIT} AS debit, {CREDIT} AS credit FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT') GROUP BY ALL)""",
    V.LEDGER,
)
def cash_month_closings(spark, d):
    return L.month_closings(V.ledger(spark, d), F.lit(500), rolling=False)


@query(f"SELECT coalesce(m, 'TOTAL') AS month, n, debit, credit FROM (SELECT {MONTH} AS m, count(*) AS n, {DEBIT} AS debit, {CREDIT} AS credit FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT') GROUP BY ROLLUP (m))", V.LEDGER)
def months_with_grand_total(spark, d):
    return L.with_grand_total(L.month_closings(V.ledger(spark, d)), "month", ["n", "debit", "credit"])


@query("SELECT account, seq, gl_date, amount, type, balance FROM v_balanced", V.LEDGER, V.BALANCED)
def running_balance(spark, d):
    return V.balanced(spark, d).select("account", "seq", "gl_date", "amount", "type", "balance")


@query(f"SELECT id, CAST(1000 + sum({S}) OVER (ORDER BY seq) AS DECIMAL(18,2)) AS balance, row_number() OVER (ORDER BY seq) AS index FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT')", V.LEDGER)
def balance_of_one_account(spark, d):
    """All orders as one account, scanned in blocks of 4,096 rows or so."""
    one = L.valid_only(V.ledger(spark, d)).withColumn("account", F.lit("all"))
    return L.numbered(L.running_balance(one, F.lit(1000), 4096), ["account"], 4096).select("id", "balance", F.col("index").cast("long").alias("index"))


@query(
    """SELECT CAST(island AS BIGINT) AS island, min(seq) AS seq, coalesce(string_agg(CASE WHEN NOT is_start THEN narration END, ' ' ORDER BY seq), '') AS more
FROM (SELECT *, sum(CAST(is_start AS INTEGER)) OVER (ORDER BY seq) AS island FROM (SELECT *, id % 4 <> 0 AS is_start FROM v_ledger)) WHERE island > 0 GROUP BY island""",
    V.LEDGER,
)
def islands_of_one_statement(spark, d):
    """All narrations as the lines of one statement, scanned in blocks."""
    lines = V.ledger(spark, d).select(F.lit("all").alias("statement_id"), F.col("seq").alias("line_no"), F.col("narration").alias("line"), "id", F.array().cast("array<string>").alias("t"))
    return statements.islands(lines, F.col("id") % 4 != 0, most=4096).select(F.col("_island").alias("island"), "seq", "more")


@query(
    f"""SELECT account, {MONTH} AS month, count(*) AS n, {DEBIT} AS debit, {CREDIT} AS credit, arg_min(balance, seq) AS first_balance,
CAST(arg_min(balance - ({S}), seq) AS DECIMAL(18,2)) AS opening, arg_max(balance, seq) AS closing FROM v_balanced GROUP BY ALL""",
    V.LEDGER,
    V.BALANCED,
)
def monthly_summary(spark, d):
    return L.monthly_summary(V.balanced(spark, d))


@query(f"SELECT account, CAST(arg_min(balance - ({S}), seq) AS DECIMAL(18,2)) AS opening FROM v_balanced GROUP BY account", V.LEDGER, V.BALANCED)
def back_computed_opening(spark, d):
    return L.back_computed_opening(V.balanced(spark, d))


@query(f"SELECT account, CAST(1000 + sum({S}) AS DECIMAL(18,2)) AS closing FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT') GROUP BY account", V.LEDGER)
def closing_balance(spark, d):
    return L.closing_balance(V.ledger(spark, d), F.lit(1000))


FITS = "abs(abs(delta) - amount) <= 0.01"
BY_SIGN = "CASE WHEN delta > 0 THEN 'DEBIT' WHEN delta < 0 THEN 'CREDIT'"


@query(f"SELECT account, seq, {BY_SIGN} WHEN delta = 0 AND amount > 0 THEN 'DEBIT' ELSE 'UNKNOWN' END AS type FROM v_moves", V.LEDGER, V.BALANCED, V.PRINTED)
def sides_by_delta(spark, d):
    return signs.by_delta(V.printed(spark, d)).select("account", "seq", "type")


@query(f"SELECT account, seq, CASE WHEN {FITS} AND delta <> 0 THEN {BY_SIGN} END ELSE 'UNKNOWN' END AS type FROM v_moves", V.LEDGER, V.BALANCED, V.PRINTED)
def sides_by_checked_delta(spark, d):
    return signs.by_checked_delta(V.printed(spark, d)).select("account", "seq", "type")


@query(
    f"""SELECT account, seq, CASE WHEN delta = 0 AND amount = 0 THEN 'UNKNOWN' WHEN {FITS} AND delta <> 0 THEN {BY_SIGN} END
WHEN bank_indicator = 'CR' THEN 'DEBIT' WHEN bank_indicator = 'DR' THEN 'CREDIT' ELSE 'UNKNOWN' END AS type FROM v_moves""",
    V.LEDGER,
    V.BALANCED,
    V.PRINTED,
)
def sides_by_delta_or_mark(spark, d):
    return signs.by_delta_or_mark(V.printed(spark, d)).select("account", "seq", "type")


@query(
    """SELECT account, count(wrong) AS checked, count(*) FILTER (wrong) AS errors, count(wrong) = 0 OR count(*) FILTER (wrong) < 0.25 * count(wrong) AS accepted FROM (
SELECT account, abs(lag(balance) OVER (PARTITION BY account ORDER BY seq) + CASE WHEN t = 'DEBIT' THEN amount ELSE -amount END - balance) > 0.01 AS wrong
FROM (SELECT *, CASE WHEN delta >= 0 THEN 'DEBIT' ELSE 'CREDIT' END AS t FROM v_moves)) GROUP BY account""",
    V.LEDGER,
    V.BALANCED,
    V.PRINTED,
)
def balance_errors(spark, d):
    return signs.balance_errors(signs.by_delta(V.printed(spark, d)))


@query("SELECT vch_no, count(*) AS n FROM (SELECT account || '-' || strftime(gl_date, '%Y%m') AS vch_no FROM v_ledger) GROUP BY vch_no HAVING count(*) > 1", V.LEDGER)
def duplicate_numbers(spark, d):
    rows = V.ledger(spark, d).select(F.concat_ws("-", F.col("account").cast("string"), F.date_format("gl_date", "yyyyMM")).alias("vch_no"))
    return L.duplicate_keys(rows, "vch_no")


@query(
    """SELECT id, account, gl_date, particulars, narration FROM v_ledger WHERE gl_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
AND lower(particulars) LIKE '%suspense%' AND regexp_matches(narration, '(?i)neft\\s+2')""",
    V.LEDGER,
)
def review_filters(spark, d):
    found = L.review(V.ledger(spark, d), "1995-01-01", "1996-12-31", "suspense", query="neft  2")
    return found.select("id", "account", "gl_date", "particulars", "narration")


@query("SELECT id, particulars FROM v_ledger WHERE modified AND particulars = '1-URGENT' AND trim(regexp_replace(lower(narration), '[^\\pL\\pM\\pN]+', ' ', 'g')) LIKE '%urgent ref 1%'", V.LEDGER)
def review_phrase(spark, d):
    return L.review(V.ledger(spark, d), status="modified", ledger="1-URGENT", phrase="urgent ref 1").select("id", "particulars")


@query("SELECT count(*) AS total, count(*) FILTER (modified) AS modified, count(*) FILTER (lower(particulars) LIKE '%suspense%') AS suspense FROM v_ledger", V.LEDGER)
def review_counters(spark, d):
    return L.counters(V.ledger(spark, d))


@query("SELECT DISTINCT particulars AS name FROM v_ledger WHERE lower(particulars) LIKE '%e%'", V.LEDGER)
def ledger_names(spark, d):
    return L.ledger_names(V.ledger(spark, d), "e")


@query('SELECT min(gl_date) AS "first", max(gl_date) AS "last" FROM v_ledger', V.LEDGER)
def date_bounds(spark, d):
    return L.bounds(V.ledger(spark, d))


@query("SELECT id, gl_date FROM v_ledger WHERE gl_date >= DATE '1997-01-01'", V.LEDGER)
def continuation_rows(spark, d):
    return L.from_date(V.ledger(spark, d), "1997-01-01").select("id", "gl_date")


@query(
    """SELECT id, CASE WHEN hit THEN 'Head office' ELSE particulars END AS particulars, hit OR modified AS modified, CASE WHEN hit THEN 'Contra' ELSE vch_type END AS vch_type
FROM (SELECT *, id % 2 = 0 AND lower(particulars) = 'suspense' AS hit FROM v_ledger)""",
    V.LEDGER,
)
def replace_ledger(spark, d):
    rows = V.ledger(spark, d)
    return L.replace_ledger(rows, rows.where("id % 2 = 0"), "suspense", "Head office", contra=True).select("id", "particulars", "modified", "vch_type")


@query("SELECT id, account FROM v_ledger WHERE NOT (id % 2 = 0 AND lower(particulars) = 'suspense')", V.LEDGER)
def delete_vouchers(spark, d):
    rows = V.ledger(spark, d)
    return L.delete_vouchers(rows, rows.where("id % 2 = 0 AND lower(particulars) = 'suspense'")).select("id", "account")


@query("SELECT id, gl_date FROM v_ledger ORDER BY gl_date, id LIMIT 50 OFFSET 100", V.LEDGER)
def viewport(spark, d):
    return L.viewport(V.ledger(spark, d).select("id", "gl_date"), ["gl_date", "id"], 100, 50)


@query("SELECT id, CAST(place AS BIGINT) AS place FROM (SELECT id, row_number() OVER (ORDER BY gl_date, id) - 1 AS place FROM v_ledger) WHERE place BETWEEN 900 AND 1299", V.LEDGER)
def page_of_ordered(spark, d):
    """Rows 900 to 1299 of the ledger by date, from the ranges that hold them."""
    path = f"{rounds.shared_dir(spark).rstrip('/')}/ordered-{uuid.uuid4().hex}"
    table = search.write_ordered(V.ledger(spark, d).select("id", "gl_date"), path, ["gl_date", "id"], 16)
    return search.page(table, 900, 400).select("id", "place")


@query(f"SELECT id, narration FROM v_ledger WHERE contains({NORMAL_OF.format('narration')}, 'specified ref 14')", V.LEDGER)
def search_by_trigrams(spark, d):
    """Narrations that hold a phrase, by an index of the trigrams of all narrations."""
    path = f"{rounds.shared_dir(spark).rstrip('/')}/trigrams-{uuid.uuid4().hex}"
    index = search.write_trigram_index(V.ledger(spark, d).select("id", "narration"), path)
    return search.search_phrase(index, "Specified  ref-14").select("id", "narration")


@query("SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY gl_date NULLS FIRST, seq) AS index FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT')", V.LEDGER)
def voucher_index(spark, d):
    return L.numbered(V.ledger(spark, d), ["account"]).select("account", "id", F.col("index").cast("long").alias("index"))


STOPS = ", ".join(f"'{w}'" for w in narration.STOP_WORDS)
NORMAL = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\pL\\pM\\pN]+', ' ', 'g'))"
WORDS = f"""v_words AS (
  SELECT conv_id, turn, i, w, length(w) > 1 AND w NOT IN ({STOPS}) AND (NOT regexp_full_match(w, '[0-9]+') OR length(w) = 10) AS ok FROM (
    SELECT conv_id, turn, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM (SELECT conv_id, turn, {NORMAL.format('text')} AS t FROM conversations))),
v_runs AS (SELECT *, lead(w) OVER o AS w2, lead(ok) OVER o AS ok2, lead(w, 2) OVER o AS w3, lead(ok, 2) OVER o AS ok3 FROM v_words WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
v_phrases AS (
  SELECT conv_id, turn, w AS phrase, 1 AS words FROM v_runs WHERE ok UNION SELECT conv_id, turn, w || ' ' || w2, 2 FROM v_runs WHERE ok AND ok2
  UNION SELECT conv_id, turn, w || ' ' || w2 || ' ' || w3, 3 FROM v_runs WHERE ok AND ok2 AND ok3)"""


@query("SELECT phrase, CAST(words AS INTEGER) AS words, count(*) AS n FROM v_phrases GROUP BY ALL HAVING count(*) >= 2", WORDS)
def phrase_frequency(spark, d):
    return phrases.phrase_frequency(V.narrations(spark, d))


TOKENS = "list_distinct(list_filter(string_split(" + NORMAL + ", ' '), lambda w: length(w) > 2))"


@query(
    f"""SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) END AS similarity
FROM (SELECT a.conv_id, a.turn, {TOKENS.format('a.text')} AS x, {TOKENS.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
)
def narration_similarity(spark, d):
    rows = V.narrations(spark, d)
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("narration").alias("b"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", narration.similarity(F.col("narration"), F.col("b")).alias("similarity"))


ALIKE = f"""(lower({{0}}) <> '' AND lower({{1}}) <> '' AND (contains(lower({{0}}), lower({{1}})) OR contains(lower({{1}}), lower({{0}})) OR
  (len(list_intersect({TOKENS.format('{0}')}, {TOKENS.format('{1}')})) / greatest(len({TOKENS.format('{0}')}), len({TOKENS.format('{1}')}), 1)) >= 0.3))"""
PAIRS = f"""v_pairs AS (
  SELECT i.account, i.seq AS import_seq, b.seq AS booked_seq, 50 + CASE WHEN i.gl_date = b.gl_date THEN 20 ELSE 10 END + CASE WHEN i.vch_type = b.vch_type THEN 5 ELSE 0 END
    + CASE WHEN {ALIKE.format('i.narration', 'b.narration')} THEN 5 ELSE 0 END + CASE WHEN {ALIKE.format('i.particulars', 'b.particulars')} THEN 5 ELSE 0 END AS score
  FROM v_ledger i JOIN v_booked b ON i.account = b.account AND i.type = b.type AND abs(i.amount - b.amount) <= 0.01 AND abs(date_diff('day', i.gl_date, b.gl_date)) <= 2)"""


def _pairs(spark, d):
    return linkage.candidates(V.ledger(spark, d), V.booked(spark, d), days=2)


@query("SELECT account, import_seq, booked_seq, CAST(score AS INTEGER) AS score FROM v_pairs", V.LEDGER, V.BOOKED, PAIRS)
def duplicate_candidates(spark, d):
    return _pairs(spark, d).select("account", "import_seq", "booked_seq", "score")


@query("SELECT account, import_seq, arg_max(booked_seq, score * 1e15 - booked_seq) AS booked_seq, CAST(max(score) AS INTEGER) AS score FROM v_pairs GROUP BY account, import_seq", V.LEDGER, V.BOOKED, PAIRS)
def best_candidates(spark, d):
    return linkage.best_candidates(_pairs(spark, d)).select("account", "import_seq", "booked_seq", "score")


#: Imports served one after the other, account by account, each with the vouchers it wants, best first, and those used before it.
SERVED = """v_wants AS (SELECT account, import_seq, row_number() OVER (PARTITION BY account ORDER BY import_seq) AS k, list({'v': booked_seq, 's': score} ORDER BY score DESC, booked_seq) AS wants FROM v_pairs GROUP BY account, import_seq),
v_served(account, k, import_seq, used, got) AS (
  SELECT account, 0, NULL::BIGINT, []::BIGINT[], NULL::STRUCT(v BIGINT, s INTEGER) FROM v_wants WHERE k = 1
  UNION ALL SELECT account, k, import_seq, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.v) END, got FROM (
    SELECT w.account, w.k, w.import_seq, s.used, list_filter(w.wants, lambda x: NOT list_contains(s.used, x.v))[1] AS got FROM v_served s JOIN v_wants w ON w.account = s.account AND w.k = s.k + 1)),
v_matched AS (SELECT l.*, got.v AS matched_seq, got.s AS score FROM v_ledger l LEFT JOIN (SELECT * FROM v_served WHERE got IS NOT NULL) m ON m.account = l.account AND m.import_seq = l.seq)"""
MATCHED = (V.LEDGER, V.BOOKED, PAIRS, SERVED)


@query("SELECT account, seq, CASE WHEN matched_seq IS NULL THEN 'New' ELSE 'Duplicate' END AS status, matched_seq, CAST(score AS INTEGER) AS score FROM v_matched", *MATCHED)
def duplicate_matches(spark, d):
    return _annotated(spark, d).select("account", "seq", "status", "matched_seq", "score")


def _annotated(spark, d):
    """The ledger as imports, matched to the vouchers booked before."""
    return linkage.annotate(V.ledger(spark, d), linkage.assign(_pairs(spark, d)))


@query(
    f"""SELECT account, month, {', '.join(f"CAST(coalesce(sum(CASE WHEN kind = '{k}' AND type = '{s}' THEN amount END), 0) AS DECIMAL(18,2)) AS {k}_{s.lower()}" for k in ('imported', 'booked', 'duplicate') for s in L.SIDES)},
{', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_n" for k in ('imported', 'booked', 'duplicate'))} FROM (
SELECT account, {MONTH} AS month, amount, type, 'imported' AS kind FROM v_ledger UNION ALL SELECT account, {MONTH}, amount, type, 'booked' FROM v_booked
UNION ALL SELECT account, {MONTH}, amount, type, 'duplicate' FROM v_matched WHERE matched_seq IS NOT NULL) GROUP BY account, month""",
    *MATCHED,
)
def month_reconciliation(spark, d):
    return linkage.reconciliation(_annotated(spark, d), V.booked(spark, d))


SUMS = f"SELECT account, {MONTH} AS month, count(*) AS n, {DEBIT} AS debit, {CREDIT} AS credit FROM {{0}} WHERE type IN ('DEBIT', 'CREDIT') GROUP BY ALL"


@query(
    f"""SELECT account, month, coalesce(a.n, 0) AS a_n, coalesce(a.debit, 0) AS a_debit, coalesce(a.credit, 0) AS a_credit, coalesce(b.n, 0) AS b_n, coalesce(b.debit, 0) AS b_debit, coalesce(b.credit, 0) AS b_credit,
abs(coalesce(a.n, 0) - coalesce(b.n, 0)) <= 0.01 AND abs(coalesce(a.debit, 0) - coalesce(b.debit, 0)) <= 0.01 AND abs(coalesce(a.credit, 0) - coalesce(b.credit, 0)) <= 0.01 AS agrees
FROM ({SUMS.format('v_ledger')}) a FULL JOIN ({SUMS.format('v_booked')}) b USING (account, month)""",
    V.LEDGER,
    V.BOOKED,
)
def full_outer_months(spark, d):
    return linkage.full_outer_months(L.month_closings(V.ledger(spark, d)), L.month_closings(V.booked(spark, d)), ["n", "debit", "credit"])


TAX_SUMS = "CAST(sum(taxable) AS DECIMAL(18,2)) AS taxable, CAST(sum(half) AS DECIMAL(18,2)) AS cgst, CAST(sum(half) AS DECIMAL(18,2)) AS sgst, CAST(sum(igst) AS DECIMAL(18,2)) AS igst, CAST(sum(cess) AS DECIMAL(18,2)) AS cess"


def _register(spark, d):
    """The whole register, checked."""
    return gst.reject_invalid(gst.usable_rows(V.register(spark, d)))


def _documents(spark, d):
    return gst.return_documents(_register(spark, d), gst.tasks_for(V.table(spark, d, "lineitem")))


@query(f"SELECT recipient, invoice, any_value(invoice_date) AS invoice_date, any_value(invoice_value) AS invoice_value, any_value(place) AS place, any_value(reverse_charge) AS reverse_charge, any_value(invoice_type) AS invoice_type, count(*) AS items, {TAX_SUMS} FROM v_taxed GROUP BY recipient, invoice", V.REGISTER)
def gst_invoices(spark, d):
    return gst.invoices(_register(spark, d)).drop("state")


@query(
    f"""SELECT {TAX_SUMS}, (SELECT CAST(sum(v) AS DECIMAL(18,2)) FROM (SELECT any_value(invoice_value) AS v FROM v_taxed GROUP BY recipient, invoice)) AS value,
count(DISTINCT invoice) AS invoices, count(DISTINCT recipient) AS recipients FROM v_taxed""",
    V.REGISTER,
)
def gst_totals(spark, d):
    return gst.register_totals(_register(spark, d))


@query("SELECT recipient, count(*) AS n FROM v_register WHERE invoice % 11 > 3 GROUP BY recipient", V.REGISTER)
def usable_register_rows(spark, d):
    """Recipients missing, in totals or too short, and blank invoices, each in one of eleven invoices."""
    k = F.col("invoice") % 11
    planted = V.register(spark, d).withColumn("recipient", F.when(k == 0, None).when(k == 1, "Grand Total").when(k == 2, "x").otherwise(F.col("recipient"))).withColumn("invoice", F.when(k == 3, " ").otherwise(F.col("invoice").cast("string")))
    return gst.usable_rows(planted).groupBy("recipient").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tax, count(*) AS n FROM (SELECT CAST(round(l_tax * 100) AS INTEGER) AS tax FROM lineitem) WHERE tax NOT IN (0, 1, 3, 5, 6) GROUP BY tax")
def gst_invalid_rates(spark, d):
    lines = V.table(spark, d, "lineitem").select(F.round(F.col("l_tax") * 100).cast("decimal(9,3)").alias("rate"))
    return gst.invalid_rates(lines).groupBy(F.col("rate").cast("int").alias("tax")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT recipient, CAST(invoice AS VARCHAR) AS invoice, strftime(invoice_date, '%d-%m-%Y') AS dated, invoice_value AS value, place, reverse_charge, invoice_type, CAST(item_no AS INTEGER) AS item_no,
CAST(rate AS DOUBLE) AS rate, taxable, half AS cgst, half AS sgst, igst, cess FROM v_taxed""",
    V.REGISTER,
)
def gst_documents(spark, d):
    """Every item of the return, read back from the nested documents."""
    invoices = _documents(spark, d).select(F.col("ctin").alias("recipient"), F.explode("inv").alias("i"))
    items = invoices.select("recipient", "i", F.explode("i.itms").alias("t"))
    t = lambda c: F.col(f"t.itm_det.{c}")
    return items.select("recipient", F.col("i.inum").alias("invoice"), F.col("i.idt").alias("dated"), F.col("i.val").alias("value"), F.col("i.pos").alias("place"), F.col("i.rchrg").alias("reverse_charge"), F.col("i.inv_typ").alias("invoice_type"), F.col("t.num").alias("item_no"), t("rt").alias("rate"), t("txval").alias("taxable"), t("camt").alias("cgst"), t("samt").alias("sgst"), t("iamt").alias("igst"), t("csamt").alias("cess"))


@query(
    """SELECT 1 AS section, recipient AS ctin, count(DISTINCT invoice) AS invoices, recipient = min(recipient) OVER () AS leads FROM v_register GROUP BY recipient
UNION ALL SELECT 0, '', NULL, false UNION ALL SELECT 2, '', NULL, false""",
    V.REGISTER,
)
def return_lines(spark, d):
    """The lines of the written return, each recipient's read back."""
    lines = writers.return_lines(_documents(spark, d), "27AAPFU0939F1ZV", "042024")
    back = F.from_json(F.regexp_replace("line", "^,", ""), "ctin string, inv array<struct<inum: string>>")
    read = lines.withColumn("r", F.when(F.col("section") == 1, back))
    return read.select("section", F.coalesce("r.ctin", F.lit("")).alias("ctin"), F.size("r.inv").cast("long").alias("invoices"), ((F.col("section") == 1) & ~F.col("line").startswith(",")).alias("leads"))


HSN = """v_hsn AS (
  SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'B2B') AS section FROM (
    SELECT p_partkey % 10 AS file, p_partkey AS row_no, p_size AS qty, CAST(p_retailprice AS DECIMAL(18,2)) AS value, CAST([0, 1.5, 5, 18][p_partkey % 4 + 1] AS DOUBLE) AS rate, trim(p_name) AS description,
      CAST(p_partkey % 7 AS DECIMAL(18,2)) AS cess, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.025 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) AS half,
      CASE p_partkey % 50 WHEN 0 THEN 'B2C' WHEN 25 THEN 'B2B' END AS mark, p_partkey % 50 = 49 AS total, CAST(p_partkey * 7 + 123 AS VARCHAR) AS hsn, CASE WHEN p_partkey % 3 = 0 THEN 'NOS' ELSE 'OTH' END AS uqc FROM part)),
v_hsn_rows AS (SELECT * EXCLUDE (hsn), CASE WHEN length(hsn) IN (3, 5, 7) THEN '0' || hsn ELSE hsn END AS hsn FROM v_hsn WHERE mark IS NULL AND NOT total)"""


@query("SELECT file, row_no, section, hsn, uqc, rate, description, cess, row_number() OVER (PARTITION BY file, section ORDER BY row_no) AS num FROM v_hsn_rows", HSN)
def hsn_rows(spark, d):
    found = jobs.hsn_return(V.hsn_file(spark, d))["rows"]
    return found.select("file", "row_no", "section", "hsn", "uqc", F.col("rate").cast("double").alias("rate"), "description", "cess", F.col("num").cast("long").alias("num"))


@query("SELECT CAST(sum(qty) AS DECIMAL(18,2)) AS qty, CAST(sum(value) AS DECIMAL(18,2)) AS taxable, CAST(sum(CASE WHEN row_no % 2 = 0 THEN half ELSE 0 END) AS DECIMAL(18,2)) AS cgst, CAST(sum(CASE WHEN row_no % 2 = 0 THEN half ELSE 0 END) AS DECIMAL(18,2)) AS sgst, CAST(sum(CASE WHEN row_no % 2 = 1 THEN 2 * half ELSE 0 END) AS DECIMAL(18,2)) AS igst, CAST(sum(value) AS DECIMAL(18,2)) AS value, count(*) AS n FROM v_hsn_rows", HSN)
def hsn_totals(spark, d):
    return jobs.hsn_return(V.hsn_file(spark, d))["totals"]


FIRST14 = "lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z'"
DIGIT = "(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(g, i, 1)) - 1) * (2 - i % 2)"


@query(
    f"""SELECT c_custkey, g || CASE WHEN c_custkey % 3 <> 0 THEN c WHEN c = 'A' THEN 'B' ELSE 'A' END AS gstin, c_custkey % 3 <> 0 AS valid FROM (
SELECT c_custkey, g, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - sum({DIGIT} // 36 + {DIGIT} % 36) % 36) % 36 + 1 AS BIGINT), 1) AS c
FROM (SELECT c_custkey, {FIRST14} AS g FROM customer), range(1, 15) t(i) GROUP BY c_custkey, g)"""
)
def gstin_check(spark, d):
    k = F.col("c_custkey")
    first = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("F1Z"))
    made = V.table(spark, d, "customer").select("c_custkey", first.alias("g")).withColumn("c", tax.check_character(F.col("g")))
    wrong = F.when(F.col("c") == "A", "B").otherwise("A")
    made = made.withColumn("gstin", F.concat("g", F.when(k % 3 == 0, wrong).otherwise(F.col("c"))))
    return made.select("c_custkey", "gstin", tax.valid_gstin(F.col("gstin")).alias("valid"))


PLACES = "account AS statement_id, seq * 10 AS seq, gl_date"


@query(f"SELECT {PLACES}, narration, amount, balance FROM v_balanced", V.LEDGER, V.BALANCED)
def parse_dash_dates(spark, d):
    return statements.dash_two_dates(V.statement_lines(spark, d, "dash")).select("statement_id", "seq", "gl_date", "narration", "amount", "balance")


@query(f"SELECT {PLACES}, narration || CASE WHEN id % 4 = 0 THEN ' to shop' ELSE '' END AS narration, amount, CAST(abs(balance) AS DECIMAL(18,2)) AS balance, CASE WHEN type = 'DEBIT' THEN 'CR' ELSE 'DR' END AS bank_indicator FROM v_balanced", V.LEDGER, V.BALANCED)
def parse_printed_side(spark, d):
    return statements.printed_side(V.statement_lines(spark, d, "side")).select("statement_id", "seq", "gl_date", "narration", "amount", "balance", "bank_indicator")


WRAPPED = f"SELECT {PLACES}, narration || CASE WHEN id % 4 = 0 THEN ' to shop' ELSE '' END AS narration, amount, CAST(abs(balance) AS DECIMAL(18,2)) AS balance FROM v_balanced"


def _parsed(rows):
    return rows.select("statement_id", "seq", "gl_date", "narration", "amount", "balance")


@query(WRAPPED, V.LEDGER, V.BALANCED)
def parse_slash_dates(spark, d):
    return _parsed(statements.slash_posted(V.statement_lines(spark, d, "slash")))


@query(WRAPPED, V.LEDGER, V.BALANCED)
def parse_slash_valued(spark, d):
    return _parsed(statements.slash_valued(V.statement_lines(spark, d, "slash")))


@query(WRAPPED, V.LEDGER, V.BALANCED)
def parse_month_names(spark, d):
    return _parsed(statements.month_names(V.statement_lines(spark, d, "month")))


@query(WRAPPED, V.LEDGER, V.BALANCED)
def parse_wrapped(spark, d):
    return _parsed(statements.wrapped(V.statement_lines(spark, d, "month")))


CASCADE = """v_printed_slash AS (SELECT account, seq, amount, CAST(abs(balance) AS DECIMAL(18,2)) AS balance FROM v_balanced),
v_steps AS (SELECT *, balance - lag(balance) OVER (PARTITION BY account ORDER BY seq) AS step, balance - coalesce(lag(balance) OVER (PARTITION BY account ORDER BY seq), 1000) AS delta FROM v_printed_slash),
v_sided AS (SELECT *, CASE WHEN delta > 0 OR (delta = 0 AND amount > 0) THEN 'DEBIT' WHEN delta < 0 THEN 'CREDIT' ELSE 'UNKNOWN' END AS type FROM v_steps),
v_good AS (
  SELECT account FROM (SELECT account, abs(CASE WHEN type = 'DEBIT' THEN amount ELSE -amount END - step) > 0.01 AS wrong FROM v_sided)
  GROUP BY account HAVING count(wrong) = 0 OR count(*) FILTER (wrong) < 0.25 * count(wrong))"""


@query("SELECT account AS statement_id, seq * 10 AS seq, CASE WHEN account % 4 = 3 AND count(*) OVER (PARTITION BY account) = 1 THEN 2 ELSE account % 4 END AS parser, type, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance FROM v_sided SEMI JOIN v_good USING (account)", V.LEDGER, V.BALANCED, CASCADE)
def parse_cascade(spark, d):
    """Statements of four layouts; the first parser whose balances add up is taken."""
    # lines and openings are read several times: printed once
    lines = rounds.written(V.cascade_lines(spark, d), "cascade-lines")
    found = statements.cascade(lines, statements.opening_balances(lines))
    return found.select("statement_id", "seq", F.col("parser").cast("long").alias("parser"), "type", "amount", "balance")


@query(
    """SELECT account AS statement_id, seq * 10 AS seq, narration || CASE WHEN id % 4 = 0 THEN ' to shop' ELSE '' END AS narration, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance, type FROM v_sided JOIN v_printed_ids USING (account, seq)""",
    V.LEDGER,
    V.BALANCED,
    CASCADE,
    "v_printed_ids AS (SELECT account, seq, id, narration FROM v_balanced)",
)
def parse_in_chunks(spark, d):
    """Statements that come in three chunks of lines, cut between a transaction and the line that goes on from it wherever that falls."""
    lines = V.statement_lines(spark, d, "slash")
    cuts = [0, *lines.where("line_no > 0").approxQuantile("line_no", [0.4, 0.8], 0.001), 1 << 62]
    state, found = chunks.first_state(lines), None
    for k in range(3):
        own = lines.where(F.col("line_no").between(int(cuts[k]) + (k > 0), int(cuts[k + 1])) | (F.lit(k == 0) & (F.col("line_no") < 0)))
        rows, state = chunks.parse_chunk(own, state, statements.slash_posted, signs.by_delta, last=k == 2)
        found = rows if found is None else found.unionByName(rows)
    return found.select("statement_id", "seq", "narration", F.col("amount").cast("double").alias("amount"), F.col("balance").cast("double").alias("balance"), "type")


@query("SELECT DISTINCT account AS statement_id, 2 AS missed FROM v_balanced WHERE account % 3 = 0", V.LEDGER, V.BALANCED)
def missed_lines(spark, d):
    """Every third statement ends with two later lines that no parser reads, an earlier one and one without an amount."""
    lines = V.statement_lines(spark, d, "dash")
    late = [(1, "31-12-2099 OUT OF FORM 12.00"), (2, "1 Jan 2100 AND SO ON 1.00 2.00"), (3, "01-01-1990 EARLIER 3.00"), (4, "31-12-2099 no amount")]
    said = F.explode(F.array(*[F.struct(F.lit((1 << 60) + k).alias("line_no"), F.lit(text).alias("line")) for k, text in late]))
    more = lines.where("line_no = -1 AND statement_id % 3 = 0").select("statement_id", said.alias("l")).select("statement_id", "l.line_no", "l.line")
    rows = statements.dash_two_dates(lines)
    return statements.coverage(lines.unionByName(more), rows)


@query("SELECT DISTINCT account AS statement_id, CAST(CASE WHEN account % 3 = 0 THEN -1 ELSE 1 END * (1000 + account % 700 + 0.25) AS DECIMAL(18,2)) AS opening FROM v_balanced", V.LEDGER, V.BALANCED)
def opening_balances(spark, d):
    """Openings that differ by statement in amount, mark and label, some with a date or a remark between, and a later line that looks like one."""
    k = F.col("statement_id")
    amount = F.format_number((1000 + k % 700 + F.lit(0.25)), 2)
    labels = ("Opening Balance : ", "B/F ", "Balance as on 1 Apr 2024 : ", "Clear Balance : ", "Opening Balance (as on 01-04-2024) : ", "Closing balance as on 31 Mar 2024: none, brought forward ", "Balance  as on 01/04/2024:&")
    label = F.coalesce(*[F.when(k % len(labels) == i, said) for i, said in enumerate(labels)])
    first = F.concat(label, amount, F.when(k % 3 == 0, "Dr").when(k % 3 == 1, " Cr").otherwise(""))
    lines = V.statement_lines(spark, d, "dash").withColumn("line", F.when(F.col("line_no") == -1, first).otherwise(F.col("line")))
    late = lines.where("line_no = -1").select("statement_id", F.lit(1 << 60).cast("long").alias("line_no"), F.lit("Opening Balance : 1.00 Cr").alias("line"))
    return statements.opening_balances(lines.union(late))


@query("SELECT account AS statement_id, seq * 10 AS line_no FROM v_balanced WHERE gl_date >= DATE '1997-01-01' UNION ALL SELECT DISTINCT account, -1 FROM v_balanced", V.LEDGER, V.BALANCED)
def sliced_lines(spark, d):
    return statements.slice_from(V.statement_lines(spark, d, "dash"), "1997-01-01").select("statement_id", "line_no")


MAPPING = {"date": 0, "narration": 1, "debit": 2, "credit": 3, "balance": 4}


@query(
    """SELECT account AS statement_id, row_number() OVER (PARTITION BY account ORDER BY seq) AS seq, gl_date, narration || CASE WHEN id % 4 = 0 THEN ' to shop' ELSE '' END AS narration, amount, balance,
CASE WHEN amount = 0 THEN 'UNKNOWN' WHEN type = 'CREDIT' THEN 'CREDIT' ELSE 'DEBIT' END AS type FROM v_balanced""",
    V.LEDGER,
    V.BALANCED,
)
def parse_tables(spark, d):
    return tables.transactions(V.table_rows(spark, d), MAPPING)


@query(
    """SELECT account AS statement_id, row_number() OVER (PARTITION BY account ORDER BY seq) AS seq, gl_date, narration || CASE WHEN account % 5 = 3 THEN ' | ' || particulars ELSE '' END AS narration, amount, balance, type
FROM v_balanced WHERE account % 5 <> 4""",
    V.LEDGER,
    V.BALANCED,
)
def parse_layouts(spark, d):
    """Documents of five layouts: three told by their words, one saved before, one unknown."""
    rows = V.layout_rows(spark, d)
    return tables.transactions(rows, tables.column_maps(rows, V.layouts(spark)))


ROLE_COLUMNS = {"date": (0, 4, 0, 0, -1), "narration": (1, 3, 1, 1, -1), "narration_2": (None, None, None, 2, None), "debit": (2, 2, 2, 3, -1), "credit": (3, 1, -1, 4, -1), "balance": (4, 0, 3, 5, -1)}


@query(
    f"""SELECT DISTINCT account AS statement_id, CASE WHEN account % 5 = 3 THEN '{V.SAVED_LAYOUT[0]}' END AS layout, account % 5 <> 4 AS trusted,
{', '.join(f"CAST([{', '.join('NULL' if x is None else str(x) for x in at)}][account % 5 + 1] AS INTEGER) AS {role}" for role, at in ROLE_COLUMNS.items())} FROM v_balanced""",
    V.LEDGER,
    V.BALANCED,
)
def column_maps(spark, d):
    maps = tables.column_maps(V.layout_rows(spark, d), V.layouts(spark))
    return maps.select("statement_id", "layout", "trusted", *[F.try_element_at("mapping", F.lit(role)).alias(role) for role in ROLE_COLUMNS])


RECEIPTS = "SELECT CAST(user_id AS VARCHAR) AS sheet, event_id AS row_no, gl_date, rc_no, raw_name, raw_name IS NULL AS nameless, amount FROM v_receipts"


def _receipts(cells):
    return cash.receipts(cells).select("sheet", F.col("row_no").cast("long").alias("row_no"), "gl_date", "rc_no", "raw_name", (F.col("name") == lexicon.UNKNOWN).alias("nameless"), "amount")


@query(RECEIPTS, V.CASH)
def cash_receipts(spark, d):
    return _receipts(V.cash_cells(spark, d))


@query(RECEIPTS, V.CASH)
def workbook_receipts(spark, d):
    """The same receipts out of .xlsx files, whose date cells are serial numbers in either date system."""
    # cells are counted, dated and read: the files are made and parsed once
    return _receipts(rounds.written(readers.cash_cells(readers.workbook_rows(V.workbook_files(spark, d))), "workbook-cells"))


@query("SELECT strftime(gl_date, '%b %Y') AS month_label, CAST(date_trunc('month', any_value(gl_date)) AS DATE) AS month, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total, CAST(0 AS DECIMAL(18,2)) AS credit, count(*) FILTER (n_same > 1) AS repeated_numbers FROM (SELECT *, count(*) OVER (PARTITION BY rc_no) AS n_same FROM v_receipts) GROUP BY 1", V.CASH)
def cash_audit(spark, d):
    return cash.receipt_audit(cash.receipts(V.cash_cells(spark, d)))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'ordinary' ELSE array_to_string(list_transform(string_split(o_orderpriority, ' '), lambda w: CASE w WHEN '4-NOT' THEN 'never' ELSE w END), ' ') END AS spelled FROM orders")
def lexicon_lookup(spark, d):
    words = spark.createDataFrame([("3-MEDIUM", "ordinary"), ("4-NOT", "never")], "source string, target string")
    rows = V.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"))
    return cash.apply_lexicon(rows, words).select("o_orderkey", "spelled")


#: A Telugu letter, sign or mark for each letter a to z, so that part names become clusters of them.
TELUGU = "ా్కదెఖగహిజఱలమనొపంరసతువఅఃయ౩"
LATIN = ", ".join(f"('{c}', '{said}', {c in script.CONSONANTS}, {c in script.SIGNS or c == script.VIRAMA})" for c, said in script.LETTERS.items())


@query(
    f"""SELECT p_partkey, string_agg(coalesce(said, c) || CASE WHEN consonant AND NOT coalesce(after, false) THEN 'a' ELSE '' END, '' ORDER BY i) AS spelled FROM (
SELECT p_partkey, i, c, said, coalesce(consonant, false) AS consonant, lead(coalesce(joins, false)) OVER (PARTITION BY p_partkey ORDER BY i) AS after FROM (
SELECT p_partkey, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT p_partkey, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz', '{TELUGU}') AS t FROM part))
LEFT JOIN (VALUES {LATIN}) l(letter, said, consonant, joins) ON letter = c) GROUP BY p_partkey"""
)
def romanised_names(spark, d):
    names = V.table(spark, d, "part").select("p_partkey", F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz", TELUGU).alias("name"))
    return names.select("p_partkey", script.romanised(F.col("name")).alias("spelled"))


INSIDE = """v_places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v_said),
v_hits AS (
  SELECT word, i, max(n) AS n, arg_max(target, n) AS target FROM (SELECT word, i, n, substr(word, i, n) AS piece FROM v_places, (SELECT DISTINCT length(source) AS n FROM v_entries) WHERE i + n - 1 <= length(word) AND n < length(word))
  JOIN v_entries ON source = piece GROUP BY word, i),
v_walk(word, i, done) AS (
  SELECT word, CAST(1 AS BIGINT), '' FROM v_said
  UNION ALL SELECT w.word, w.i + coalesce(n, 1), done || coalesce(target, substr(w.word, w.i, 1)) FROM v_walk w LEFT JOIN v_hits h ON h.word = w.word AND h.i = w.i WHERE w.i <= length(w.word))"""


@query("SELECT word, done AS replaced FROM v_walk WHERE i > length(word)", V.WORDS_SAID, INSIDE)
def lexicon_inside_words(spark, d):
    """All words of the conversations by a lexicon that the same words make."""
    words = V.said_words(spark, d)
    return lexicon.replace_inside(words, V.said_lexicon(words))


def _vouchers(spark, d):
    return vouchers.double_entries(V.ledger(spark, d), F.lit("Main Bank"), F.col("particulars"), ["account"]).withColumn("bank", F.lit("Main Bank"))


NUMBERED = """v_numbered AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY gl_date, seq) AS index FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT'))"""


@query(
    """SELECT account, index, strftime(gl_date, '%Y%m%d') AS date, 'MB' || strftime(gl_date, '%Y%m%d') || lpad(CAST(index AS VARCHAR), 5, '0') AS number, CASE type WHEN 'CREDIT' THEN 'Payment' ELSE 'Receipt' END AS vch_type, narration, particulars AS party,
CAST(CASE WHEN type = 'DEBIT' THEN amount ELSE -amount END AS DECIMAL(18,2)) AS party_amount, CAST(CASE WHEN type = 'DEBIT' THEN -amount ELSE amount END AS DECIMAL(18,2)) AS bank_amount FROM v_numbered""",
    V.LEDGER,
    NUMBERED,
)
def voucher_entries(spark, d):
    e = F.col("entries")
    return _vouchers(spark, d).select("account", F.col("index").cast("long").alias("index"), "date", "number", "vch_type", "narration", e[0].ledger.alias("party"), e[0].amount.alias("party_amount"), e[1].amount.alias("bank_amount"))


@query("SELECT account, index, gl_date, particulars, CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END AS debit, CASE WHEN type = 'CREDIT' THEN amount ELSE 0 END AS credit FROM v_numbered", V.LEDGER, NUMBERED)
def flat_vouchers(spark, d):
    flat = vouchers.flatten(_vouchers(spark, d).withColumn("id", F.struct("account", "index")))
    return flat.select("id.account", F.col("id.index").cast("long").alias("index"), "gl_date", "particulars", "debit", "credit")


@query("SELECT account, index, amount, type, particulars FROM v_numbered", V.LEDGER, NUMBERED)
def vouchers_of_ledger(spark, d):
    own = vouchers.of_ledger(_vouchers(spark, d).withColumn("id", F.struct("account", "index")), "main bank")
    return own.select("id.account", F.col("id.index").cast("long").alias("index"), "amount", "type", "particulars")


@query(f"SELECT CAST(account AS VARCHAR) AS account, index AS seq, CAST(sum({S}) OVER (PARTITION BY account ORDER BY index) AS DECIMAL(18,2)) AS balance FROM v_numbered", V.LEDGER, NUMBERED)
def audit_sheet(spark, d):
    return vouchers.audit_rows(_vouchers(spark, d), ["account"]).select("account", F.col("seq").cast("long").alias("seq"), "balance")


def _misread(rows):
    """Every tenth amount is one too high."""
    return rows.withColumn("amount", F.when(F.col("id") % 10 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(amounts.MONEY))


MISREAD = """v_misread AS (SELECT * REPLACE (CAST(CASE WHEN id % 10 = 0 THEN amount + 1 ELSE amount END AS DECIMAL(18,2)) AS amount), id % 10 = 0 AND type <> 'UNKNOWN' AS off FROM v_ledger)"""


@query(
    f"""SELECT *, rows_off = 0 AS passed, CASE WHEN rows_off = 0 THEN 'all checks passed' ELSE months_off || ' months differ, ' || rows_off || ' rows differ' END AS message FROM (
SELECT account, count(*) AS transactions, count(*) FILTER (type = 'UNKNOWN') AS unknown, {DEBIT} AS debit, {CREDIT} AS credit, CAST(coalesce(sum({S}), 0) AS DECIMAL(18,2)) AS closing_movement, count(*) FILTER (type <> 'UNKNOWN') AS vouchers,
  count(DISTINCT CASE WHEN off THEN {MONTH} END) AS months_off, count(*) FILTER (off) AS rows_off
FROM v_misread GROUP BY account)""",
    V.LEDGER,
    MISREAD,
)
def validation_report(spark, d):
    """Vouchers against a statement of which every tenth amount is misread."""
    return validate.report(_misread(V.ledger(spark, d)), _vouchers(spark, d)).select("account", "transactions", "unknown", "debit", "credit", "closing_movement", "vouchers", "months_off", "rows_off", "passed", "message")


@query(
    """SELECT account, count(*) AS vouchers, count(*) FILTER (odd AND n > 1) AS repeated, count(*) FILTER (odd) AS without_digits
FROM (SELECT account, index % 5 = 0 AS odd, count(*) OVER (PARTITION BY account, index % 5 = 0) AS n FROM v_numbered) GROUP BY account""",
    V.LEDGER,
    NUMBERED,
)
def voucher_sequence(spark, d):
    """Every fifth voucher of an account bears the same number, without digits."""
    made = _vouchers(spark, d)
    return validate.sequence_check(made.withColumn("number", F.when(F.col("index") % 5 == 0, "none").otherwise(F.col("number"))))


@query("SELECT account, index, 'amount' AS reason FROM v_numbered WHERE id % 10 = 0 AND amount <> 0", V.LEDGER, NUMBERED)
def row_mismatches(spark, d):
    return validate.row_match(_misread(V.ledger(spark, d)), _vouchers(spark, d)).select("account", F.col("index").cast("long").alias("index"), F.array_join("reasons", ",").alias("reason"))


@query(
    """SELECT o_orderkey, p AS unsigned, p AS absolute, CAST(-p AS DECIMAL(18,2)) AS dr, p AS marked FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)"""
)
def amount_forms(spark, d):
    p = F.col("o_totalprice").cast(amounts.MONEY)
    text = F.format_number(p, 2)
    rows = V.table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    t = F.col("t")
    return rows.select("o_orderkey", amounts.unsigned_amount(F.concat(F.lit("-"), t)).alias("unsigned"), amounts.absolute_amount(F.concat(F.lit("-"), t)).alias("absolute"), amounts.suffixed_balance(F.concat(t, F.lit("Dr"))).alias("dr"), amounts.marked_amount(F.concat(t, F.lit(" Cr"))).alias("marked"))


@query("SELECT o_orderkey, d AS a, d AS b, d AS c, d AS e, d AS f, d AS g, d AS h FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def date_forms(spark, d):
    f = lambda p: dates.any_date(F.date_format("o_orderdate", p))
    return V.table(spark, d, "orders").select("o_orderkey", f("dd/MM/yyyy").alias("a"), f("d-MMM-yyyy").alias("b"), f("yyyy-MM-dd HH:mm:ss").alias("c"), f("d.M.yyyy").alias("e"), f("MMMM d, yyyy").alias("f"), f("d MMMM yyyy").alias("g"), f("yyyyMMdd").alias("h"))


@query(
    """SELECT account AS statement_id, CAST(island AS BIGINT) AS island, min(seq) AS seq, coalesce(string_agg(CASE WHEN NOT is_start THEN narration END, ' ' ORDER BY seq), '') AS more
FROM (SELECT *, sum(CAST(is_start AS INTEGER)) OVER (PARTITION BY account ORDER BY seq) AS island FROM (SELECT *, id % 4 <> 0 AS is_start FROM v_ledger)) WHERE island > 0 GROUP BY account, island""",
    V.LEDGER,
)
def continuation_islands(spark, d):
    """Narrations as lines, three of four of which begin a transaction."""
    lines = V.ledger(spark, d).select(F.col("account").alias("statement_id"), F.col("seq").alias("line_no"), F.col("narration").alias("line"), "id", F.array().cast("array<string>").alias("t"))
    return statements.islands(lines, F.col("id") % 4 != 0).select("statement_id", F.col("_island").alias("island"), "seq", "more")


@query("SELECT phrase, CAST(words AS INTEGER) AS words, count(*) AS n FROM v_phrases GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, phrase LIMIT 50", WORDS)
def top_phrases(spark, d):
    return phrases.ranked(phrases.phrase_frequency(V.narrations(spark, d)))


@query(f"SELECT account, max(greatest(debit, credit)) AS largest FROM (SELECT account, {MONTH} AS month, {DEBIT} AS debit, {CREDIT} AS credit FROM v_ledger WHERE type IN ('DEBIT', 'CREDIT') GROUP BY ALL) GROUP BY account", V.LEDGER)
def largest_months(spark, d):
    return L.largest_months(L.month_closings(V.ledger(spark, d)))


@query("SELECT account, id FROM v_matched WHERE matched_seq IS NULL", *MATCHED)
def new_imports(spark, d):
    return linkage.by_match_status(_annotated(spark, d), "New").select("account", "id")


@query(f"SELECT account, {DEBIT} AS debit, {CREDIT} AS credit, count(*) AS n, CAST(1000 + coalesce(sum({S}), 0) AS DECIMAL(18,2)) AS closing FROM v_matched WHERE matched_seq IS NOT NULL GROUP BY account", *MATCHED)
def duplicate_closing(spark, d):
    return linkage.duplicate_closing(_annotated(spark, d), F.lit(1000))


KINDS = ("imported", "booked", "duplicate")
RECONCILED = f"""v_kinds AS (
  SELECT account, {MONTH} AS month, {', '.join(f"CAST(coalesce(sum(CASE WHEN kind = '{k}' AND type = '{s}' THEN amount END), 0) AS DECIMAL(18,2)) AS {k}_{s.lower()}" for k in KINDS for s in L.SIDES)},
    {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_n" for k in KINDS)}
  FROM (SELECT account, gl_date, amount, type, 'imported' AS kind FROM v_ledger UNION ALL SELECT account, gl_date, amount, type, 'booked' FROM v_booked UNION ALL SELECT account, gl_date, amount, type, 'duplicate' FROM v_matched WHERE matched_seq IS NOT NULL) GROUP BY ALL),
v_closed AS (SELECT *, {', '.join(f"CAST(1000 + sum({k}_debit - {k}_credit) OVER (PARTITION BY account ORDER BY month) AS DECIMAL(18,2)) AS {k}_closing" for k in KINDS)} FROM v_kinds)"""


@query(
    f"""SELECT * FROM v_closed UNION ALL BY NAME SELECT account, 'TOTAL' AS month, {', '.join(f"CAST(sum({k}_{c}) AS DECIMAL(18,2)) AS {k}_{c}" for k in KINDS for c in ('debit', 'credit'))},
{', '.join(f"CAST(sum({k}_n) AS BIGINT) AS {k}_n, arg_max({k}_closing, month) AS {k}_closing" for k in KINDS)} FROM v_closed GROUP BY account""",
    *MATCHED,
    RECONCILED,
)
def reconciliation_report(spark, d):
    return linkage.with_closings(linkage.reconciliation(_annotated(spark, d), V.booked(spark, d)), F.lit(1000))
