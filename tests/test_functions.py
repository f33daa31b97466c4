import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, narration, script, tax


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def T():
    """The column under test; columns need a session."""
    return F.col("t")


def test_amounts(spark):
    got = values(spark, ["1,234.50", "-12", "-", "", "abc", "5.00Dr", "7 Cr", None], amounts.unsigned_amount(T()), amounts.marked_amount(T()), amounts.absolute_amount(T()), amounts.strict_amount(T()), amounts.suffixed_balance(T()), amounts.marked_balance(T()))
    assert got[0] == (D("1234.50"), D("1234.50"), D("1234.50"), D("1234.50"), D("1234.50"), D("1234.50"))
    assert got[1] == (D("12.00"), D("-12.00"), D("12.00"), None, D("-12.00"), D("-12.00"))
    assert got[2][:3] == (D(0), None, D(0)) and got[4][:3] == (D(0), None, D(0))
    assert got[5][1] == D(5) and got[5][4:] == (D(-5), D(-5)) and got[6][1] == D(7)
    assert got[7] == (D(0), None, D(0), None, None, D(0))


def test_sides_and_numbers(spark):
    assert [x for x, in values(spark, ["12 Dr", "W", "-5", "12 Cr", "D", "+5", "5", None], amounts.indicated_side(T()))] == ["DEBIT", "DEBIT", "DEBIT", "CREDIT", "CREDIT", "CREDIT", "DEBIT", "DEBIT"]
    day, n = F.lit(dt.date(2024, 4, 5)), F.lit(123456)
    assert values(spark, ["State Bank 2 of-India", "123", None], amounts.voucher_number(T(), day, n), amounts.voucher_number(T(), day, F.lit(7))) == [("SB20240405123456", "SB2024040500007"), ("BANK20240405123456", "BANK2024040500007"), ("BANK20240405123456", "BANK2024040500007")]


def test_grouping(spark):
    c = T().cast("decimal(18,2)")
    assert values(spark, ["1234567.89", "-123", "1234", "12345678"], amounts.indian_grouping(c), amounts.compact_rupees(c)) == [("12,34,567.89", "12.3L"), ("-123.00", "-123.00"), ("1,234.00", "1.2K"), ("1,23,45,678.00", "1.2Cr")]


def test_dates(spark):
    day = dt.date(2025, 4, 5)
    good = ["5-4-2025", "05/04/2025", "5.4.25", "5-Apr-2025", "5 APR 25", "2025-04-05", "2025-04-05 10:11:12", "5 April 2025", "Apr 5, 2025", "20250405"]
    assert values(spark, good, dates.any_date(T())) == [(day,)] * len(good)
    assert values(spark, ["31-2-2025", "x", "", None], dates.any_date(T())) == [(None,)] * 4
    assert values(spark, ["30", "31", "x"], dates.day_of_month(F.lit(day), T())) == [(dt.date(2025, 4, 30),), (day,), (day,)]


def test_phrases(spark):
    got = values(spark, ["UPI/Ram the Stores 9876543210 12", "a b", "", None], narration.phrases(narration.normalised(T())))
    assert set(got[0][0]) == {"upi", "ram", "stores", "9876543210", "upi ram", "stores 9876543210"}
    assert got[1:] == [([],), ([],), ([],)]


def test_similarity(spark):
    rows = [("rent for april shop", "april rent"), ("", "x"), ("ab cd", "ab"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(narration.similarity(F.col("a"), F.col("b")), narration.alike(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.5, True), (0.0, False), (0.0, True), (0.0, False)]


def test_names(spark):
    assert values(spark, ["Sri. Rāma-kṛṣṇa", "Abcdefghijklmnopq x", "Bob"], narration.clean_name(T()), narration.odd_name(T())) == [("Rama Krsna", True), ("Abcdefghijklmnopq X", True), ("Bob", False)]
    assert values(spark, ["UPI/Ram Stores, April rent"], narration.ledger_keywords(T())) == [("UPI RAM STORES",)]
    assert values(spark, ["యూపీఐ/రామ 12"], narration.normalised(T())) == [("యూపీఐ రామ 12",)]
    assert values(spark, ['a/b:"c"?'], narration.safe_filename(T())) == [("abc",)]
    assert values(spark, ["Account No: 12345 - My Shop (INR)"], narration.account_name(T())) == [("My Shop",)]


def check_digit(first):
    """The public rule in plain Python."""
    digits, total = tax.DIGITS, 0
    for i, c in enumerate(first):
        p = digits.index(c) * (1 + i % 2)
        total += p // 36 + p % 36
    return digits[(36 - total % 36) % 36]


def test_gstin(spark):
    first = ["27AAPFU0939F1Z", "29ABCDE1234F2Z", "07ZZZZZ9999Z9Z"]
    good = [x + check_digit(x) for x in first]
    assert good[0] == "27AAPFU0939F1ZV"
    odd = [x + check_digit(x) for x in ("27AAPFU0939F0Z", "27AAPFU0939F1C")]  # entity number 0; a collector's number
    assert values(spark, [*good, good[0][:-1] + "A", "27", None, good[0].lower(), *odd], tax.valid_gstin(T())) == [(True,)] * 3 + [(False,)] * 3 + [(True,), (False,), (True,)]


def test_tax_codes(spark):
    assert values(spark, ["042024", "132024", "4 2024", None], tax.valid_period(T())) == [(True,), (False,), (False,), (False,)]
    assert values(spark, ["18%", "0.25", "4", None], tax.known_rate(tax.rate(T()))) == [(True,), (True,), (False,), (False,)]
    assert values(spark, ["7-Delhi", "27.0", "123"], tax.place_code(T())) == [("07",), ("27",), ("123",)]
    assert values(spark, ["SEZ without pay", "sez", "Deemed Exp", "Bonded WH", None], tax.invoice_type(T())) == [("SEWOP",), ("SEWP",), ("DE",), ("CBW",), ("R",)]
    assert values(spark, ["123.0", "1234", "12345"], tax.hsn_code(T())) == [("0123",), ("1234",), ("012345",)]
    assert values(spark, ["nos-numbers", "", None], tax.unit_code(T())) == [("NOS",), ("OTH",), ("OTH",)]


def test_tax_split_rounds_halves_up(spark):
    df = spark.createDataFrame([(D("0.50"), D("5"), True), (D("100.10"), D("5"), True), (D("100.10"), D("5"), False)], "t decimal(18,2), r decimal(9,3), s boolean")
    got = [tuple(r) for r in df.select(*tax.tax_split(F.col("t"), F.col("r"), F.col("s"))).collect()]
    assert got == [(D("0.02"), D("0.02"), D(0)), (D("2.51"), D("2.51"), D(0)), (D(0), D(0), D("5.01"))]


def test_script_in_latin_letters(spark):
    cases = {"రామ": "rāma", "కృష్ణ": "kr̥ṣṇa", "శ్రీ": "śrī", "లక్ష్మి": "lakṣmi", "అంబ": "aṁba", "దుఃఖం": "duḥkhaṁ", "సీతా 12 ౧౨ x": "sītā 12 12 x", "క్": "k", "క": "ka", "": "", "abc": "abc", "ఐఔఋ": "aiaur̥"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in rows.select("t", script.romanised(F.col("t"))).collect()} == cases


def test_dates_by_shape(spark):
    day = dt.date(2024, 1, 5)
    cases = {"January 5 2024": day, "5 January 24": day, "5 jan 2024": day, "Jan 5, 2024": day, "5/1/2024 10:15": day, "2024-01-05 00:00:00": day, "05.01.24": day, "20240105": day, "5 May 2024": dt.date(2024, 5, 5), "31-02-2024": None, "5-1": None, "x": None, None: None, "5 Janvember 2024": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in rows.select("t", dates.any_date(F.col("t"))).collect()} == cases
