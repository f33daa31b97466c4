import bisect
import datetime as dt
import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cash, chunks, gst, ledger, lexicon, linkage, scans, search, signs, statements, tables
from ledgerloom.plans import jobs


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "statement_id string, text string")


DASHED = """Opening Balance : 100.00 Cr
01-04-2024 01-04-2024 UPI RAM 20.00 120.00Cr
02-04-2024 02-04-2024 RENT SHOP 150.00 30.00Dr
03-04-2024 03-04-2024 ODD 5.00 99.00Cr
totals 1.00"""


def test_dash_statement(spark):
    out = jobs.convert_statement(frame(spark, {"a": DASHED, "b": ""}), "dash_two_dates", "My Bank")
    rows = out["transactions"].orderBy("seq").collect()
    assert [(r["narration"], r["amount"], r["balance"], r["type"]) for r in rows] == [("UPI RAM", D(20), D(120), "DEBIT"), ("RENT SHOP", D(150), D(-30), "CREDIT"), ("ODD", D(5), D(99), "UNKNOWN")]
    report = out["report"].collect()
    assert len(report) == 1 and report[0]["passed"] and report[0]["unknown"] == 1 and report[0]["missed"] == 0
    assert [r["balance"] for r in out["audit"].orderBy("seq").collect()] == [D(20), D(-130)]


def test_printed_side_stops_at_blank_line(spark):
    text = "01-04-2024 01-04-2024 NEFT A 10.00 CR 110.00\nmore words\n\nnot these\n02-04-2024 02-04-2024 ATM B 20.00 DR 90.00"
    rows = statements.printed_side(statements.lines_of(frame(spark, {"a": text}))).orderBy("seq").collect()
    assert [(r["narration"], r["amount"], r["balance"], r["bank_indicator"]) for r in rows] == [("NEFT A more words", D(10), D(110), "CR"), ("ATM B", D(20), D(90), "DR")]


def test_month_names_stitch_years(spark):
    text = "1 Apr 2024 1 Apr\n2024 TO TRANSFER\nUPI 123 10.00 110.00\n2 May 2024 2 May 2024 X 5.00 105.00"
    rows = statements.month_names(statements.lines_of(frame(spark, {"a": text}))).orderBy("seq").collect()
    assert [(r["gl_date"], r["narration"], r["amount"], r["balance"]) for r in rows] == [(dt.date(2024, 4, 1), "TO TRANSFER UPI 123", D(10), D(110)), (dt.date(2024, 5, 2), "X", D(5), D(105))]


def test_cascade_takes_the_first_that_adds_up(spark):
    good = "\n".join(f"0{i}/04/2024 0{i}/04/2024 PAY {i} 10.00 {100 + 10 * i}.00" for i in range(1, 8))
    bad = "\n".join(f"0{i}/04/2024 0{i}/04/2024 PAY {i} 10.00 {100 + 37 * i}.00" for i in range(1, 8))
    rows = statements.cascade(statements.lines_of(frame(spark, {"good": good, "bad": bad}))).collect()
    assert {(r["statement_id"], r["parser"]) for r in rows} == {("good", 0)} and len(rows) == 7


def test_strategies(spark):
    lines = statements.lines_of(frame(spark, {"a": DASHED}))
    rows, openings = statements.ingest(lines, "dash_two_dates", "continuation", "2024-04-02")
    assert rows.count() == 2 and openings.count() == 0
    with pytest.raises(ValueError):
        statements.ingest(lines, "dash_two_dates", "sometimes")
    with pytest.raises(ValueError):
        statements.parser_of("nobody")
    kept = statements.slice_from(statements.lines_of(frame(spark, {"a": "1 Apr x\n03/04/2024 y\nz"})), "2024-04-02", 2024)
    assert [r["line"] for r in kept.orderBy("line_no").collect()] == ["03/04/2024 y", "z"]


def printed(spark, opening, rows):
    data = [("a", i, D(a), D(b), opening, m) for i, (a, b, m) in enumerate(rows)]
    return spark.createDataFrame(data, "account string, seq int, amount decimal(18,2), balance decimal(18,2), opening decimal(18,2), bank_indicator string")


def test_signs(spark):
    rows = [(10, 110, None), (20, 90, None), (5, 90, "CR"), (7, 100, "DR"), (0, 100, None)]
    df = printed(spark, D(100), rows)
    kinds = lambda f: [r["type"] for r in f(df).orderBy("seq").collect()]
    assert kinds(signs.by_delta) == ["DEBIT", "CREDIT", "DEBIT", "DEBIT", "UNKNOWN"]
    assert kinds(signs.by_checked_delta) == ["DEBIT", "CREDIT", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert kinds(signs.by_delta_or_mark) == ["DEBIT", "CREDIT", "DEBIT", "CREDIT", "UNKNOWN"]
    over = printed(spark, D(-100), [(10, 90, None), (20, 110, None)])
    assert [(r["type"], r["balance_used"]) for r in signs.by_delta(over).orderBy("seq").collect()] == [("DEBIT", D(-90)), ("CREDIT", D(-110))]
    unknown = printed(spark, None, [(10, 90, None), (20, 110, None)])
    assert [r["type"] for r in signs.by_delta(unknown).orderBy("seq").collect()] == ["UNKNOWN", "DEBIT"]


VOUCHER = "account int, seq int, gl_date date, amount decimal(18,2), type string, vch_type string, narration string, particulars string"


def vouchers(spark, rows):
    return spark.createDataFrame([(1, i, dt.date(2024, 4, d), D(a), "DEBIT", "Receipt", n, "P") for i, d, a, n in rows], VOUCHER)


def test_matching_is_greedy_in_import_order(spark):
    imports = vouchers(spark, [(0, 1, "10.00", "x"), (1, 1, "10.00", "rent april"), (2, 1, "10.01", ""), (3, 9, "10.00", "x"), (4, 1, "50.00", "z")])
    booked = vouchers(spark, [(0, 1, "10.00", "rent april"), (1, 2, "10.00", ""), (2, 1, "10.02", None)])
    pairs = linkage.candidates(imports, booked, days=1)
    assert {(r["import_seq"], r["booked_seq"], r["score"]) for r in pairs.collect()} == {(0, 0, 80), (0, 1, 70), (1, 0, 85), (1, 1, 70), (2, 0, 80), (2, 1, 70), (2, 2, 80)}
    out = {r["seq"]: (r["status"], r["matched_seq"]) for r in linkage.annotate(imports, linkage.assign(pairs)).collect()}
    assert out == {0: ("Duplicate", 0), 1: ("Duplicate", 1), 2: ("Duplicate", 2), 3: ("New", None), 4: ("New", None)}
    with pytest.raises(ValueError):
        linkage.candidates(imports, booked, days=4)


def test_matching_equals_serving_one_by_one(spark):
    for days, seed in ((0, 1), (1, 2), (3, 3)):
        rng = random.Random(seed)
        some = lambda n: [(1, i, dt.date(2024, 4, 1) + dt.timedelta(rng.randrange(20)), D(1000 + rng.choice((0, 1, 2, 3, 9, 10, 40))) / 100, rng.choice(("DEBIT", "CREDIT")), "Receipt", rng.choice(("", "rent", "rent april", "tea")), "P") for i in range(n)]  # noqa: E731, B023
        imports, booked = some(80), some(60)
        pairs = linkage.candidates(spark.createDataFrame(imports, VOUCHER), spark.createDataFrame(booked, VOUCHER), days=days)
        scores = {(r["import_seq"], r["booked_seq"]): r["score"] for r in pairs.collect()}
        assert set(scores) == {(i[1], b[1]) for i in imports for b in booked if i[4] == b[4] and abs(i[3] - b[3]) <= D("0.01") and abs((i[2] - b[2]).days) <= days}
        left, want = {b[1] for b in booked}, {}
        for i, *_ in sorted((i[1],) for i in imports):
            own = [(-scores[i, b], b) for b in left if (i, b) in scores]
            if own:
                want[i] = min(own)[1]
                left.remove(want[i])
        assert {r["import_seq"]: r["booked_seq"] for r in linkage.assign(pairs).collect()} == want


def test_tables(spark):
    head = ["Txn Date", "Narration", "Debit", "Credit", "Balance"]
    rows = [("d", 0, 0, 0, ["x"]), ("d", 1, 0, 0, head), ("d", 1, 0, 1, ["1/4/2024", "A", "10", "", "90"]), ("d", 1, 0, 2, ["", "more", "", "", ""]), ("d", 1, 0, 3, ["", None, "", "", " "]), ("d", 2, 0, 0, head), ("d", 2, 0, 1, ["2/4/2024", "B", "", "5", "95"]), ("d", 2, 0, 2, ["short"])]
    df = spark.createDataFrame(rows, "statement_id string, page int, table_no int, row_no int, cells array<string>")
    found = tables.column_maps(df).first()
    mapping = found["mapping"]
    assert mapping == {"date": 0, "narration": 1, "debit": 2, "credit": 3, "balance": 4} and found["trusted"] and found["headers"] == head
    out = tables.transactions(df, mapping).orderBy("seq").collect()
    assert [(r["narration"], r["amount"], r["type"], r["balance"]) for r in out] == [("A more", D(10), "CREDIT", D(90)), ("B", D(5), "DEBIT", D(95))]
    assert [r["narration"] for r in tables.transactions(df, mapping, "2024-04-02").collect()] == ["B"]
    assert tables.first_tables(df).count() == 4
    job = jobs.convert_tables(df, mapping, "My Bank")
    assert job["vouchers"].count() == 2 and job["report"].first()["message"] == "all checks passed"


def test_register(spark):
    rows = [("27AAPFU0939F1ZV", "1", 1, dt.date(2024, 4, 1), D("105.11"), 27, 27, D("100.10"), D("5")), ("27AAPFU0939F1ZV", "1", 2, dt.date(2024, 4, 2), D("1"), 27, 29, D("10"), D("18")), ("Grand Total", "2", 3, None, None, 1, 1, D("1"), D("5"))]
    df = spark.createDataFrame(rows, "recipient string, invoice string, row_no int, invoice_date date, invoice_value decimal(18,2), place int, state int, taxable decimal(18,2), rate decimal(9,3)")
    out = jobs.gst_return(df)
    t = out["totals"].first()
    assert (t["taxable"], t["cgst"], t["sgst"], t["igst"], t["value"], t["invoices"], t["recipients"]) == (D("110.10"), D("2.51"), D("2.51"), D("1.80"), D("105.11"), 1, 1)
    doc = out["documents"].first()
    assert [i["num"] for i in doc["inv"][0]["itms"]] == [1, 2]
    with pytest.raises(ValueError):
        gst.require_columns(df.drop("rate"))
    with pytest.raises(Exception, match="unknown rate"):
        jobs.gst_return(df.withColumn("rate", F.lit(4).cast("decimal(9,3)")))["totals"].collect()


def test_cash(spark):
    rows = [("w", "s", 1, "Date", "No", "Name", "Phone", "Amount"), ("w", "s", 2, "05-04-2024", "1.0", "Sri Ram", None, "100.9"), ("w", "s", 3, None, "2", "Sita", None, "50"), ("w", "s", 4, "31", "2", "Lava", None, "1,000"), ("w", "s", 5, "7", "3", None, None, "x")]
    rows += [("w", "s", 6, "9-4", "4a", "Update Datta", None, "-7.9"), ("w", "s", 7, "soon", "5", "Kusa", None, "8"), ("w", "s", 8, "12.05.2024", "6", "Bala", None, "9"), ("w", "s", 9, "1", None, "Nobody", None, "9"), ("w", "s", 10, "1", "7", "Nobody", None, None), ("w", "t", 1, "x", "1", "A", None, "1")]
    df = spark.createDataFrame(rows, "workbook string, sheet string, row_no int, c0 string, c1 string, c2 string, c3 string, c4 string")
    out = jobs.convert_cash(df, spark.createDataFrame([("Ram", "Rama")], "source string, target string"))
    got = out["receipts"].orderBy("row_no").collect()
    want = [(5, "1", "Rama", D(100)), (5, "2", "Sita", D(50)), (5, "2", "Lava", D(1000)), (7, "3", "Unknown Person", D(0)), (9, "4a", "Update Datta", D(-7)), (9, "5", "Kusa", D(8)), (12, "6", "Bala", D(9))]
    assert [(r["gl_date"].day, r["rc_no"], r["name"], r["amount"]) for r in got] == want and {r["gl_date"].month for r in got} == {4}
    assert [(r["workbook"], r["sheet"]) for r in cash.undated_sheets(df).collect()] == [("w", "t")]
    assert out["audit"].first()["repeated_numbers"] == 2
    assert {r["vch_type"] for r in out["vouchers"].collect()} == {"Receipt"}


def test_lexicon_updates(spark):
    lexicon = spark.createDataFrame([("a", "A"), ("b", "B")], "source string, target string")
    fixes = spark.createDataFrame([("a x", "Aa Xx", 1), ("b", "", 2), ("c d", "One", 3)], "source string, target string, seq long")
    assert {(r[0], r[1]) for r in cash.update_lexicon(lexicon, fixes).collect()} == {("a", "Aa"), ("x", "Xx"), ("a x", "Aa Xx"), ("c d", "One")}
    words = spark.createDataFrame([("రామ", "rama"), ("రామ సీత", "x"), ("ram", "y")], "source string, target string")
    assert [r[0] for r in cash.clean_lexicon(words).collect()] == ["రామ"]
    told = spark.createDataFrame([("సీత-గారు", "Seetha  Garū"), ("సీత గారూ", "Sita"), ("గారు", "Garu"), ("రావు", " gaaru "), (None, "x"), ("దేవ", None)], "source string, target string")
    assert [tuple(r) for r in cash.clean_lexicon(told).collect()] == [("సీత", "Seetha")]


def test_edits(spark):
    df = spark.createDataFrame([(1, "Suspense", "Receipt", None), (2, "suspense", "Receipt", True), (3, "X", "Payment", False)], "id int, particulars string, vch_type string, modified boolean")
    out = {r["id"]: (r["particulars"], r["vch_type"], r["modified"]) for r in ledger.replace_ledger(df, df.where("id < 3"), "SUSPENSE", "Y", contra=True).collect()}
    assert out == {1: ("Y", "Contra", True), 2: ("Y", "Contra", True), 3: ("X", "Payment", False)}
    assert [r["id"] for r in ledger.delete_vouchers(df, df.where("id < 3")).collect()] == [3]


def served(pairs):
    """Imports one by one, each its best voucher left."""
    want, used = {}, set()
    for i in sorted({p[0] for p in pairs}):
        own = [(-s, b) for j, b, s in pairs if j == i and b not in used]
        if own:
            want[i] = min(own)[1]
            used.add(want[i])
    return want


def assigned(spark, pairs):
    rows = spark.createDataFrame([(1, i, b, s) for i, b, s in pairs], "account int, import_seq int, booked_seq int, score int")
    got = linkage.assign(rows).collect()
    assert len({r["import_seq"] for r in got}) == len({r["booked_seq"] for r in got}) == len(got)
    return {r["import_seq"]: r["booked_seq"] for r in got}


def test_assignment_by_proposals_equals_serving_in_turn(spark):
    chain = [(i, i + k, 90 - 20 * k) for i in range(12) for k in range(2)]  # each wants its own, then the next one's
    late = [(i, b, 50 + b) for i in range(8) for b in range(6)]  # all want the same, best last
    turned = [(i, b, 50 + (i + b) % 5) for i in range(15) for b in range(11) if (i * 7 + b) % 3]
    for pairs in (chain, late, turned, [], [(1, 1, 50)]):
        assert assigned(spark, pairs) == served(pairs)


def test_equal_imports_are_served_at_once(spark):
    pairs = [(i, b, 70) for i in range(60) for b in range(40)] + [(100, 50, 60)]
    rows = spark.createDataFrame([(1, *p) for p in pairs], "account int, import_seq int, booked_seq int, score int")
    first = linkage._like_minded(rows, ("account",))
    assert first.where("_taken IS NULL").count() == 0
    assert {(r["import_seq"], r["booked_seq"]) for r in first.where("_taken").collect()} == {(i, i) for i in range(40)} | {(100, 50)}


def test_scans_of_cut_keys_equal_plain_windows(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice((None, *range(9)))) for k, n in ((1, 2000), (2, 3), (None, 700)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(7)
    for most in (100, 10_000):
        for f in (scans.running_sum, scans.carried, scans.row_before):
            df = f(df, ["k"], ["i"], F.col("v"), f"{f.__name__}_{most}", most)
    for r in df.collect():
        assert [r[f"{f}_100"] for f in ("running_sum", "carried", "row_before")] == [r[f"{f}_10000"] for f in ("running_sum", "carried", "row_before")]
    got = {r["i"]: r for r in df.where("k = 1").collect()}
    total, last, before = None, None, None
    for i in range(2000):
        v = got[i]["v"]
        total = total if v is None else (total or 0) + v
        last = last if v is None else v
        assert (got[i]["running_sum_100"], got[i]["carried_100"], got[i]["row_before_100"]) == (total, last, before)
        before = v
    assert len({r[0] for r in scans._blocks(df, ["k"], "i", 100, None)[0].where("k = 1").select("_block").distinct().collect()}) > 10


def test_a_row_meets_a_bounded_number_of_cuts(spark):
    rng = random.Random(15)
    cuts = {1: sorted(rng.randrange(3000) for _ in range(2200)), 2: sorted(rng.randrange(50) for _ in range(2200))}
    rows = [(k, i) for k in (1, 2, 3) for i in range(-1, 3002, 7)] + [(1, None), (None, 5)]
    df = spark.createDataFrame(rows, "k int, i int")
    placed = scans._placed(df, ["k"], "i", spark.createDataFrame(list(cuts.items()), "k int, _cuts array<int>"), 2201)
    got = {(r["k"], r["i"]): r["_block"] for r in placed.collect()}
    assert got == {(k, i): (0 if i is None else bisect.bisect_left(cuts[k], i)) if k in cuts else None for k, i in rows}
    held = scans._blocks(spark.range(20000).selectExpr("1 AS k", "id"), ["k"], "id", 5, None)[0]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Broadcast(Hash|NestedLoop)Join", plan)) == 3 and held.groupBy("_block").count().agg({"count": "max"}).first()[0] <= 20


CELLS = "statement_id string, page int, table_no int, row_no int, cells array<string>"


def test_layouts_by_document(spark):
    usual = ["Txn Date", "Narration", "Debit", "Credit", "Balance"]
    rows = [("narrow", 0, 0, i, c) for i, c in enumerate([["Date", "Details", "Amount", "Balance"], ["1/4/2024", "A", "10.00 Dr", "5 Dr"], ["", "more", "", ""], ["", "Details", "", ""], ["2/4/2024", "B", "7 Cr", "2"]])]
    rows += [("house", 0, 0, i, c) for i, c in enumerate([[" K1 ", "K2", "K3", "K4"], ["x", "2024-04-03", "C", "30"], ["y", "2024-04-03", "D", "0"]])]
    rows += [("odd", 0, 0, i, c) for i, c in enumerate([["a", "b"], ["1/4/2024", "lost"]])] + [("usual", 1, 0, 0, usual), ("usual", 1, 0, 1, ["January 5 2024", "E", "", "4", "9"]), ("empty", 0, 0, 0, [None, ""])]
    df = spark.createDataFrame(rows, CELLS)
    saved = spark.createDataFrame([("house", {"narration_2": 0, "date": 1, "narration": 2, "debit": 3, "credit": 3}, ["k1", "K2", "k3", "K4"]), ("later", {"date": 0}, ["k1", "K2", "k3", "K4"])], "name string, mapping map<string,int>, headers array<string>")
    maps = tables.column_maps(df, saved)
    assert {(r["statement_id"], r["layout"], r["trusted"]) for r in maps.collect()} == {("narrow", None, True), ("house", "house", True), ("odd", None, False), ("usual", None, True)}
    got = {(r["statement_id"], r["narration"], r["amount"], r["type"], r["balance"]) for r in tables.transactions(df, maps).collect()}
    assert got == {("narrow", "A more", D(10), "CREDIT", D(-5)), ("narrow", "B", D(7), "DEBIT", D(2)), ("house", "C | x", D(30), "CREDIT", D(0)), ("house", "D | y", D(0), "UNKNOWN", D(0)), ("usual", "E", D(4), "DEBIT", D(9))}


def brute_inside(word, entries):
    out, i = "", 0
    while i < len(word):
        n = max((n for n in range(1, len(word)) if word[i : i + n] in entries and i + n <= len(word)), default=0)
        out, i = (out + entries[word[i : i + n]], i + n) if n else (out + word[i], i + 1)
    return out


def test_lexicon_entries_inside_words(spark):
    rng = random.Random(9)
    letter = "abcఅక్é"
    words = ["".join(rng.choice(letter) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [None, "", "a"]
    entries = {"".join(rng.choice(letter) for _ in range(n)): f"<{k}>" for k, n in enumerate([1, 2, 2, 3, 3, 3, 5, 8] * 3) if k}
    lex = spark.createDataFrame([*entries.items(), (None, "x"), ("", "y")], "source string, target string")
    got = {r["word"]: r["replaced"] for r in lexicon.replace_inside(spark.createDataFrame([(w,) for w in words], "word string"), lex).collect()}
    assert got == {w: brute_inside(w, entries) for w in words if w is not None}
    none = lexicon.replace_inside(spark.createDataFrame([("ab",)], "word string"), lex.limit(0)).collect()
    assert [(r["word"], r["replaced"]) for r in none] == [("ab", "ab")]


def test_large_lexicon_is_not_broadcast(spark):
    words = spark.range(2000).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit("y")).alias("word"))
    lex = spark.range(100_000).select(F.concat(F.col("id").cast("string"), F.lit("y")).alias("source"), F.lit("!").alias("target"))
    got = {r["word"]: r["replaced"] for r in lexicon.replace_inside(words, lex).collect()}
    assert got == {f"x{i}y": "x!" for i in range(2000)}


def test_names_are_spelled(spark):
    lex = spark.createDataFrame([("రామ", "Rāma"), ("సీత దేవి", "Seetha Devi"), ("శ్రీ", "Sri"), ("rao", "Rao")], "source string, target string")
    cases = {
        "సీత  దేవి గారు": ("Seetha Devi", False),
        "రామ-rao": ("Rama Rao", True),
        "శ్రీనివాస్": ("Sri Nivas", True),
        "కృష్ణ": ("Krsna", True),
        "K.లక్ష్మి": ("K. Laksmi", True),
        "Ravi garu": ("Ravi", False),
        "abcdefghijklmnopq": ("Abcdefghijklmnopq", True),
        " ": ("Unknown Person", False),
        None: ("Unknown Person", False),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw_name string")
    assert {r["raw_name"]: (r["spelled"], r["flagged"]) for r in lexicon.spell_names(rows, lex).collect()} == cases


def test_openings_by_label(spark):
    said = {
        "a": "Opening Balance (as on 01-04-2024) : 1,500.00 Cr",
        "b": "Balance as on 1 Apr 2024 : 1,500.00",
        "c": "Clear Balance : 1,500.00Dr",
        "d": "Balance as on 31/03/2024 :& 1500",
        "e": "Opening balance as on 01-04-2024: -1,500.00",
        "f": "Closing Balance as on 31 Mar 2024 : 9.00",
        "g": "BALANCE BROUGHT FORWARD 1,500.00",
    }
    lines = spark.createDataFrame([(k, 0, v) for k, v in said.items()], "statement_id string, line_no int, line string")
    got = {r["statement_id"]: r["opening"] for r in statements.opening_balances(lines).collect()}
    assert got == {"a": D(1500), "b": D(1500), "c": D(-1500), "d": D(1500), "e": D(-1500), "g": D(1500)}


def test_search_by_trigrams_equals_a_scan(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i * 1000, rng.choice(["NEFT rent april", "UPI tea-stall 12", "cheque", "", None, "rent  April!", "x", f"no {i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, narration string")
    search.write_trigram_index(df, f"{tmp_path}/index")
    index = search.read_trigram_index(spark, f"{tmp_path}/index")
    for phrase in ("rent april", "Rent", "tea stall 12", "no 7", "x", "", "nothing like it", "apr!!il"):
        want = {r["id"] for r in ledger.by_phrase(df, df.select(ledger.normalised(F.lit(phrase))).first()[0]).collect()}
        assert {r["id"] for r in search.search_phrase(index, phrase).collect()} == want, phrase
    few = search.search_phrase(index, "tea stall 12")
    assert re.search(r"PartitionFilters: \[.*block", few._jdf.queryExecution().toString()) and index.postings.where("gram = 'tea'").count() < index.postings.count() / 10


def test_pages_are_read_by_range(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, rng.randrange(50)) for i in range(1000)]
    table = search.write_ordered(spark.createDataFrame(rows, "id int, day int"), f"{tmp_path}/o", ["day", "id"], 9)
    want = [i for _, i in sorted((d, i) for i, d in rows)]
    for first, count in ((0, 5), (990, 50), (333, 400), (2000, 5), (10, 0)):
        got = search.page(table, first, count).orderBy("place").collect()
        assert [r["id"] for r in got] == want[first : first + count] and [r["place"] for r in got] == list(range(first, first + len(got)))
    plan = search.page(table, 500, 10)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*range", plan) and len(table.starts) == 9


def test_chunks_give_what_the_whole_gives(spark):
    rng = random.Random(14)
    lines, at = [], {}
    for k, start in (("a", 1000), ("b", -500), ("c", None)):
        balance, n = start or 0, 0
        if start is not None:
            lines.append((k, 0, f"Opening Balance : {abs(start)}.00 {'Dr' if start < 0 else 'Cr'}"))
        for day in range(1, 25):
            move = rng.choice((-1, 1)) * rng.randrange(1, 90)
            balance += move
            n += 1
            lines.append((k, n, f"{day:02d}/04/2024 {day:02d}/04/2024 UPI {day} {abs(move)}.00 {abs(balance)}.00"))
            for _ in range(rng.randrange(3)):
                n += 1
                lines.append((k, n, f"more {n}"))
        at[k] = n
    df = spark.createDataFrame(lines, "statement_id string, line_no int, line string")
    whole, _ = chunks.parse_chunk(df, chunks.first_state(df), statements.slash_posted, signs.by_delta, last=True)
    want = {tuple(r) for r in whole.select("statement_id", "seq", "narration", "amount", "balance", "balance_used", "type").collect()}
    assert len(want) == 72
    for cuts in ((7, 8, 30), (1, 2, 3)):
        state, got, low = chunks.first_state(df), [], -1
        for k, high in enumerate((*cuts, 10**6)):
            own = df.where(F.col("line_no").between(low + 1, high))
            rows, state = chunks.parse_chunk(own, state, statements.slash_posted, signs.by_delta, last=k == len(cuts))
            got += [tuple(r) for r in rows.select("statement_id", "seq", "narration", "amount", "balance", "balance_used", "type").collect()]
            low = high
        assert len(got) == len(want) and set(got) == want


def test_large_registers_are_grouped_in_more_tasks(spark):
    rows = spark.range(1001).selectExpr("concat('C', id % 10) AS recipient", "id div 2 AS invoice", "id AS row_no", "date'2024-04-01' AS invoice_date", "CAST(10 AS DECIMAL(18,2)) AS invoice_value", "1 AS place", "2 AS state", "CAST(10 AS DECIMAL(18,2)) AS taxable", "CAST(5 AS DECIMAL(9,3)) AS rate")
    assert gst.tasks_for(rows) == 4 and gst.tasks_for(rows, 100) == 11
    few, many = gst.return_documents(rows), gst.return_documents(rows, 11)
    assert {str(r) for r in few.collect()} == {str(r) for r in many.collect()}
    assert "hashpartitioning(recipient" in (plan := many._jdf.queryExecution().executedPlan().toString()) and ", 11), REPARTITION_BY_NUM" in plan


def test_a_trigram_of_many_rows_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 4000 << 8, 1 << 8).selectExpr("id", "concat('always the same ', id % 7) AS narration")
    index = search.write_trigram_index(rows, f"{tmp_path}/i", most_rows=500, most_postings=200)
    at = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    assert max(r["n"] for r in index.postings.groupBy(at.alias("task")).agg(F.count("*").alias("n")).collect()) < 4000
    assert index.postings.where("gram = 'alw'").select(at).distinct().count() >= 4
    assert index.counts.where("gram = 'alw'").first()["n"] == 4000
    assert search.search_phrase(index, "same 3").count() == rows.where("narration LIKE '%same 3'").count() > 0


def test_what_is_read_several_times_is_made_once(spark):
    from ledgerloom.plans import queries

    for name, made_by in (("workbook_receipts", "MapIn"), ("parse_cascade", "Union")):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert made_by not in plan
