import datetime as dt
import http.server
import io
import json
import re
import threading
import time
import zipfile
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import gst, statements
from ledgerloom.operators import vouchers as V
from ledgerloom.plans import jobs
from ledgerloom.sources import connector, readers, writers
from ledgerloom.streaming import ingest


def made(spark):
    rows = [("a", i, dt.date(2024, 4, 3 - i), D(10 + i), ["DEBIT", "CREDIT"][i % 2], "text & <more>", "P") for i in range(3)]
    df = spark.createDataFrame(rows, "account string, seq int, gl_date date, amount decimal(18,2), type string, narration string, particulars string")
    return V.double_entries(df, F.lit("My Bank"), F.col("particulars"), ["account"])


def test_voucher_files_come_back(spark, tmp_path):
    path = f"{tmp_path}/xml"
    out = made(spark)
    writers.write_vouchers(out, path, ["date", "index"])
    back = readers.read_vouchers(spark, path)
    key = lambda df: sorted((r["date"], r["vch_type"], str(r["number"]), r["narration"], [(e.ledger, e.is_debit, e.is_party, e.amount) for e in r["entries"]]) for r in df.collect())
    assert key(back) == key(out)
    text = readers.parse_voucher_text(writers.voucher_xml(out))
    assert key(text) == key(out)
    flat = V.flatten(back.withColumn("id", F.col("number"))).collect()
    assert {(r["particulars"], r["debit"], r["credit"]) for r in flat} == {("P", D(10), D(0)), ("P", D(0), D(11)), ("P", D(12), D(0))}
    assert V.of_ledger(back.withColumn("id", F.col("number")), "MY BANK").count() == 3


def test_missing_narrations_have_a_default(spark):
    rows = [("a", i, dt.date(2024, 4, 1), D(1), "DEBIT", text, "P") for i, text in enumerate(["said", None, "", " "])]
    df = spark.createDataFrame(rows, "account string, seq int, gl_date date, amount decimal(18,2), type string, narration string, particulars string")
    out = V.double_entries(df, F.lit("My Bank"), F.col("particulars"), ["account"]).orderBy("index").collect()
    assert [r["narration"] for r in out] == ["said", "Transaction", "Transaction", "Transaction"]


def test_references_are_scrubbed(spark):
    df = spark.createDataFrame([("a&#4;b&#9;c&#x1F;d&#x0a;e&#31;f&#32;g&#x41;",)], "t string")
    assert df.select(readers.scrub_references(F.col("t"))).first()[0] == "ab&#9;cd&#x0a;ef&#32;g&#x41;"


def test_register_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('x\ny\n\nGSTIN,Invoice,"Value, total"\na,1,"2,5"\n\nb,"2\nand more",3\n')
    got = readers.read_register(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["gstin"], r["invoice"], r["value, total"]) for r in got] == [("a", "1", "2,5"), ("b", "2\nand more", "3")]


RETURN = """Summary,,
of,,
sales,,
GSTIN/UIN of Recipient,Invoice Number,Invoice date,Invoice Value,Place Of Supply,Reverse Charge,Invoice Type,Rate,Taxable Value,Cess Amount
27AAPFU0939F1ZV,A1,1-Apr-2024,"1,180.00",27-Maharashtra,N,Regular,18%,"1,000.00",2.5
27AAPFU0939F1ZV,A1,1-Apr-2024,"1,180.00",27-Maharashtra,N,Regular,5,100,
29ABCDE1234F2Z5,B7,05/04/2024,50,29.0,Y,SEZ supplies with payment,12,44.64,
Total,,,,,,,,,
"""


def test_register_file_to_return(spark, tmp_path):
    (tmp_path / "r.csv").write_text(RETURN)
    out = jobs.register_return(readers.read_register(spark, str(tmp_path)), "27AAPFU0939F1ZV", "042024")
    said = json.loads(out["json"].first()["json"])
    assert said["gstin"] == "27AAPFU0939F1ZV" and said["fp"] == "042024" and len(said["nil"]["inv"]) == 4
    first, second = said["b2b"]
    assert first["inv"][0]["itms"] == [{"num": 1, "itm_det": {"rt": 18.0, "txval": 1000.0, "camt": 90.0, "samt": 90.0, "iamt": 0.0, "csamt": 2.5}}, {"num": 2, "itm_det": {"rt": 5.0, "txval": 100.0, "camt": 2.5, "samt": 2.5, "iamt": 0.0, "csamt": 0.0}}]
    assert {k: second["inv"][0][k] for k in ("inum", "idt", "val", "pos", "rchrg", "inv_typ")} == {"inum": "B7", "idt": "05-04-2024", "val": 50.0, "pos": "29", "rchrg": "Y", "inv_typ": "SEWP"}
    assert second["inv"][0]["itms"][0]["itm_det"]["iamt"] == 5.36 and second["inv"][0]["itms"][0]["itm_det"]["camt"] == 0
    docs = jobs.gst_return(gst.typed_register(gst.rename_headers(readers.read_register(spark, f"{tmp_path}/r.csv"), gst.B2B_ALIASES), "27AAPFU0939F1ZV"))["documents"]
    for files, some in ((1, docs), (3, docs), (2, docs.limit(0))):
        writers.write_return(some, "27AAPFU0939F1ZV", "042024", f"{tmp_path}/json-{files}", files)
        text = "".join(p.read_text() for p in sorted((tmp_path / f"json-{files}").glob("part-*")))
        assert json.loads(text) == (said if files != 2 else said | {"b2b": []})
    heads = spark.createDataFrame([("27AAPFU0939F1ZV", "042024"), ("27AAPFU0939F1ZV", "132024"), ("x", "042024")], "gstin string, period string")
    assert [r["valid"] for r in jobs.check_return_head(heads).collect()] == [True, False, False]


def test_summary_file_to_return(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a\nb\nc\nHSN/SAC,Desc,UQC,Total Quantity,Total Value,Tax Rate,Taxable Value,Integrated Tax,Central Tax,State/UT Tax,Cess\n100,Tea,NOS-NUMBERS,2,10,5%,9.5,0,0.24,0.24,1\nB2C,,,,,,,,,,\n2001.0,Oil,,1,5,18,4,0.72,0,0,\nTotal,,,,,,,,,,\n")
    rows = readers.read_register(spark, str(tmp_path))
    money = {c: F.col(c).try_cast("decimal(18,2)") for c in ("total quantity", "total value", "taxable value", "integrated tax", "central tax", "state/ut tax")}
    out = jobs.hsn_return(rows.withColumns(money))
    said = json.loads(writers.hsn_json(out["rows"]).first()["json"])
    assert said["hsn_b2b"] == [{"num": 1, "hsn_sc": "0100", "desc": "Tea", "uqc": "NOS", "qty": 2.0, "rt": 5.0, "txval": 9.5, "iamt": 0.0, "camt": 0.24, "samt": 0.24, "csamt": 1.0}]
    assert [(r["num"], r["hsn_sc"], r["uqc"], r["csamt"]) for r in said["hsn_b2c"]] == [(1, "2001", "OTH", 0.0)]
    with pytest.raises(Exception, match="unknown rate"):
        jobs.hsn_return(rows.withColumns(money | {"tax rate": F.lit("7")}))["rows"].collect()


def test_review_is_saved_with_its_masters(spark, tmp_path):
    text = "Opening Balance : 100.00 Cr\n01-04-2024 01-04-2024 UPI RAM 20.00 120.00Cr\n02-04-2024 02-04-2024 RENT 150.00 30.00Dr"
    out = jobs.convert_statement(spark.createDataFrame([("a", text)], "statement_id string, text string"), "dash_two_dates", "My & Bank")
    assert [(r["name"], r["parent"], r["opening"]) for r in out["masters"].collect()] == [("My & Bank", "Bank Accounts", D(-100)), ("Suspense", "Suspense A/c", None)]
    writers.save_review(out["vouchers"], out["audit"], f"{tmp_path}/r", ["date", "index"], out["masters"])
    found = "".join(r[0] for r in spark.read.text(f"{tmp_path}/r/vouchers").collect())
    assert found.count("<LEDGER NAME=") == 2 and "<OPENINGBALANCE>-100.00</OPENINGBALANCE>" in found and "My &amp; Bank" in found
    assert readers.read_vouchers(spark, f"{tmp_path}/r/vouchers").count() == 2
    assert spark.read.csv(f"{tmp_path}/r/audit", header=True).count() == 2


def test_settings_and_cash_months(spark, tmp_path):
    rows = spark.createDataFrame([("bank", {"date": 0}, ["Date"], 5)], readers.LAYOUT)
    writers.write_settings(rows, f"{tmp_path}/s")
    assert readers.read_settings(spark, f"{tmp_path}/s", readers.LAYOUT).collect() == rows.collect()
    cash = spark.createDataFrame([("Apr 2024", 1), ("Apr 2024", 2), ("x" * 40, 3)], "month_label string, n int")
    writers.write_cash_months(cash, f"{tmp_path}/c")
    assert {r["sheet"]: r["count"] for r in spark.read.csv(f"{tmp_path}/c", header=True).groupBy("sheet").count().collect()} == {"Apr 2024": 2, "x" * 31: 1}


def test_pages_and_connectors(spark):
    pages = spark.createDataFrame([("a", 1, "second"), ("a", 0, "first " * 20), ("a", 2, " "), ("b", 0, None)], "statement_id string, page int, page_text string")
    assert {r[0]: r[1] for r in statements.is_readable(pages).collect()} == {"a": True, "b": False}
    assert {r[0]: r[1] for r in readers.page_texts(pages).collect()} == {"a": "first " * 20 + "\nsecond"}
    placed = readers.row_order(spark.createDataFrame([("a", 5), ("a", 2), ("b", 1)], "k string, v int"), ["k"], ["v"])
    assert {(r["k"], r["v"], r["seq"]) for r in placed.collect()} == {("a", 2, 1), ("a", 5, 2), ("b", 1, 1)}
    texts = spark.createDataFrame([("Value Date x",), ("nothing",)], "t string")
    assert [r[0] for r in texts.select(statements.matches_profile(F.col("t"), statements.PROFILE_MARKS["dash_two_dates"])).collect()] == [True, False]


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="2"><c r="E2" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>'


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", SHEET)
    rows = readers.read_workbook_pages(spark, str(tmp_path))
    assert [(r["sheet"], r["row_no"], r["cells"]) for r in rows.orderBy("row_no").collect()] == [("One", 1, ["head", None, "5"]), ("One", 2, [None, None, None, None, "z"])]
    assert [r["c4"] for r in readers.cash_cells(rows).collect()] == ["z"]
    table = readers.sheet_table(rows, "ONE", 1)
    assert table.columns == ["file", "row_no", "head", "c1", "5"] and [r["row_no"] for r in table.collect()] == [2]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": "A", "b c": "BC"}')
    assert {tuple(r) for r in readers.read_lexicon(spark, str(tmp_path / "l.json")).collect()} == {("a", "A"), ("b c", "BC")}
    assert readers.read_lexicon(spark, None, {"x": "y"}).count() == 1


def test_stream_counts_repeats_once(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame([(1, i, dt.datetime(2024, 4, d), D(10), "DEBIT") for i, d in rows], ingest.LEDGER).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    put("a", [(1, 1), (2, 1)])
    put("b", [(2, 1), (3, 20)])
    stream = spark.readStream.schema(ingest.LEDGER).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = ingest.daily_totals(stream).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        for _ in range(20):
            got = spark.table("daily").collect()
            if got:
                break
            time.sleep(0.5)
        assert [(r["day"], r["n"], r["debit"]) for r in got] == [(dt.date(2024, 4, 1), 2, D(20))]
    finally:
        query.stop()


STYLES = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="dd\\-mmm"/><numFmt numFmtId="165" formatCode="0.00&quot; dry&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs></styleSheet>'


def dated_book(path, date1904):
    cells = "".join(f'<c r="{c}1" s="{s}"><v>{v}</v></c>' for c, s, v in (("A", 1, 45387), ("B", 0, 45387), ("C", 2, "45387.5"), ("D", 3, 45387), ("E", 4, "0.25"), ("F", 1, 60), ("G", 1, 1)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{date1904}"/><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        for name in "ab":
            z.writestr(f"xl/worksheets/{name}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1">{cells}</row></sheetData></worksheet>')


def test_dates_of_workbooks(spark, tmp_path):
    dated_book(tmp_path / "x.xlsx", 0)
    dated_book(tmp_path / "y.xlsx", 1)
    (tmp_path / "z.txt").write_text("no workbook")
    want = {"x": ["2024-04-05", "45387", "2024-04-05 12:00:00", "45387", "06:00:00", "1900-02-28", "1900-01-01"], "y": ["2028-04-06", "45387", "2028-04-06 12:00:00", "45387", "1904-01-01 06:00:00", "1904-03-01", "1904-01-02"]}
    for rows in (readers.read_sheets(spark, str(tmp_path)), readers.read_workbook_pages(spark, f"{tmp_path}/*.xlsx")):
        got = {(r["workbook"].rsplit("/", 1)[1][0], r["sheet"]): r["cells"] for r in rows.collect()}
        assert got == {(book, sheet): cells for book, cells in want.items() for sheet in ("One", "Two")}
    assert readers.read_sheets(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    assert {r["sheet"] for r in readers.read_sheets(spark, f"file://{tmp_path}/x.xlsx", "two ").collect()} == {"Two"}


VOUCHER = "<VOUCHER><DATE>{0:%Y%m%d}</DATE><VOUCHERTYPENAME>Receipt</VOUCHERTYPENAME><VOUCHERNUMBER>{1}</VOUCHERNUMBER><NARRATION>a &amp; b&#4; {1}</NARRATION><{2}.LIST><LEDGERNAME>My Bank</LEDGERNAME><ISDEEMEDPOSITIVE>Yes</ISDEEMEDPOSITIVE><AMOUNT>-{1}.50</AMOUNT></{2}.LIST></VOUCHER>"


@pytest.fixture
def server():
    """A server with a voucher for each day of 2024 that answers whole days, one too many, and keeps the ranges asked."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            said = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if "<ID>Ledger</ID>" in said:
                body = '<ENVELOPE><LEDGER NAME="Cash"/><LEDGER><NAME> My Bank </NAME></LEDGER><LEDGER NAME="Cash"/><LEDGER NAME=""/></ENVELOPE>'
            else:
                first, last = (dt.datetime.strptime(x, "%Y%m%d").date() for x in re.findall(r'DATE TYPE="Date">(\d+)<', said))
                asked.append((first, last))
                days = [first + dt.timedelta(days=k) for k in range(-1, (last - first).days + 1)]
                body = "<ENVELOPE>" + "".join(VOUCHER.format(d, d.timetuple().tm_yday, ("ALLLEDGERENTRIES", "LEDGERENTRIES")[d.day % 2]) for d in days if d.year == 2024) + "<VOUCHER><DATE/></VOUCHER></ENVELOPE>"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    it = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=it.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{it.server_port}", asked
    it.shutdown()


def test_vouchers_are_fetched_by_spans(spark, server):
    url, asked = server
    got = readers.booked_vouchers(spark, url, "X & Y", "2024-03-01", "2024-04-10", days=10)
    rows = {(r["date"], r["number"], r["narration"], r["entries"][0].amount) for r in got.collect()}
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=k) for k in range(41)]
    assert rows == {(f"{d:%Y%m%d}", str(n), f"a & b {n}", D(f"-{n}.50")) for d in days for n in [d.timetuple().tm_yday]}
    assert sorted(set(asked)) == [(days[k], days[min(k + 9, 40)]) for k in (0, 10, 20, 30, 40)]
    own = V.of_ledger(got.withColumn("id", F.col("number")), "my bank").first()
    assert (own["type"], own["particulars"]) == ("DEBIT", "Suspense")


def test_a_filter_leaves_the_frame_as_it_is(spark, server):
    url, asked = server
    frame = connector.fetch_vouchers(spark, url, "c", "2024-05-01", "2024-05-31")
    assert sorted(r[0] for r in frame.where("date > '2024-05-01' AND date <= '2024-05-04'").select("date").collect()) == [dt.date(2024, 5, d) for d in (2, 3, 4)]
    assert frame.count() == 31 and set(asked) == {(dt.date(2024, 5, 1), dt.date(2024, 5, 31))}
    assert connector.fetch_vouchers(spark, url, "c", "2024-05-02", "2024-05-01").count() == 0


def test_ledger_names_are_fetched(spark, server):
    assert {r[0] for r in connector.fetch_ledger_names(spark, server[0], "c").collect()} == {"Cash", "My Bank"}


def test_answers_are_read_as_they_come():
    said = "<E>" + "".join(f"<V><N>{i}&#x1F;&#233;&amp;ü</N></V>" for i in range(50)) + "</E>"
    for size in (1, 3, 7, 1000):
        assert [e.findtext("N") for e in connector.elements(io.BytesIO(said.encode()), "V", size)] == [f"{i}é&ü" for i in range(50)]
