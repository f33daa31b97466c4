"""Vouchers and ledger names of an accounting server that answers XML requests over HTTP.

A date range is cut into spans of days, a partition each: tasks ask for their span and read the answer as it comes, so
neither the driver nor a task holds more than one voucher. The range is given as options: filters aren't pushed down, as
Spark keeps a Python reader, with what was pushed into it, for later queries on the same DataFrame.
"""

from __future__ import annotations

import codecs
import datetime as dt
import re
import sys
import urllib.request
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Workers get this module's functions by value: they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOUCHERS, LEDGERS = "vouchers", "ledgers"
#: What the server's collections fetch of a voucher.
FETCHED = "DATE, VOUCHERNUMBER, VOUCHERTYPENAME, NARRATION, ALLLEDGERENTRIES"
DAY = dt.timedelta(days=1)


def request_xml(company: str, kind: str, first: dt.date | None = None, last: dt.date | None = None) -> bytes:
    """The server's export request for a collection of vouchers in a date range, or of ledgers."""
    envelope = ElementTree.Element("ENVELOPE")
    node = lambda parent, tag, text=None, **more: _filled(ElementTree.SubElement(parent, tag, more), text)
    head, desc = node(envelope, "HEADER"), node(node(envelope, "BODY"), "DESC")
    for tag, text in (("VERSION", "1"), ("TALLYREQUEST", "Export Data"), ("TYPE", "Collection"), ("ID", "Ledger" if kind == LEDGERS else "BookedVouchers"), ("SVCURRENTCOMPANY", company)):
        node(head, tag, text)
    fixed = node(desc, "STATICVARIABLES")
    node(fixed, "SVEXPORTFORMAT", "$$SysName:XML")
    if kind == VOUCHERS:
        node(fixed, "SVFROMDATE", f"{first:%Y%m%d}", TYPE="Date")
        node(fixed, "SVTODATE", f"{last:%Y%m%d}", TYPE="Date")
        collection = node(node(node(desc, "TDL"), "TDLMESSAGE"), "COLLECTION", NAME="BookedVouchers", ISMODIFY="No")
        node(collection, "TYPE", "Voucher")
        node(collection, "FETCH", FETCHED)
    return ElementTree.tostring(envelope)


def _filled(node, text: str | None):
    node.text = text
    return node


def _scrubbed(text: str) -> str:
    """Without references to control characters that XML forbids."""

    def keep(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return m[0] if code >= 32 or code in (9, 10, 13) else ""

    return re.sub(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));", keep, text)


def elements(response, tag: str, size: int = 1 << 16) -> Iterator[ElementTree.Element]:
    """Elements of an answer as they come; only one is held."""
    parser, decoder, kept = ElementTree.XMLPullParser(["start", "end"]), codecs.getincrementaldecoder("utf-8")("ignore"), ""
    path: list = []
    while True:
        chunk = response.read(size)
        text = kept + decoder.decode(chunk, final=not chunk)
        cut = text.rfind("&")
        # a reference may go on in the next chunk
        kept = text[cut:] if chunk and cut >= 0 and ";" not in text[cut:] else ""
        parser.feed(_scrubbed(text[: len(text) - len(kept)]))
        for event, element in parser.read_events():
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if element.tag == tag:
                yield element
                if path:
                    path[-1].remove(element)
        if not chunk:
            return


class _Span(InputPartition):
    def __init__(self, first: dt.date | None, last: dt.date | None) -> None:
        self.first, self.last = first, last


class _ServerReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.company, self.kind = options["url"], options.get("company", ""), options.get("kind", VOUCHERS)
        self.days, self.timeout = int(options.get("days", 31)), float(options.get("timeout", 600))
        self.first, self.last = (dt.date.fromisoformat(options[k]) if k in options else None for k in ("first", "last"))
        if self.days < 1:
            raise ValueError("days must be at least 1")

    def partitions(self) -> list[_Span]:
        if self.kind == LEDGERS:
            return [_Span(None, None)]
        if self.first is None or self.last is None:
            raise ValueError("vouchers need a first and a last date")
        starts = range(0, (self.last - self.first).days + 1, self.days)
        return [_Span(self.first + k * DAY, min(self.last, self.first + (k + self.days - 1) * DAY)) for k in starts]

    def read(self, partition: _Span | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there is no partition
            return
        asked = urllib.request.Request(self.url, request_xml(self.company, self.kind, partition.first, partition.last), {"Content-Type": "text/xml; charset=utf-8"})
        with urllib.request.urlopen(asked, timeout=self.timeout) as response:
            if self.kind == LEDGERS:
                for ledger in elements(response, "LEDGER"):
                    name = (ledger.get("NAME") or ledger.findtext("NAME") or "").strip()
                    if name:
                        yield (name,)
                return
            for voucher in elements(response, "VOUCHER"):
                said = (voucher.findtext("DATE") or "").strip()
                if not said and not (voucher.findtext("VOUCHERNUMBER") or "").strip():
                    continue
                day = dt.datetime.strptime(said, "%Y%m%d").date() if re.fullmatch(r"\d{8}", said) else None
                # a server may answer with more than it was asked for; each day is one span's
                if day is None or partition.first <= day <= partition.last:
                    voucher.tail = None
                    yield day, ElementTree.tostring(voucher, encoding="unicode")


class VoucherServer(DataSource):
    """format("voucherserver"): options url, company, kind (vouchers or ledgers), first, last (yyyy-MM-dd), days of a partition, timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "voucherserver"

    def schema(self) -> str:
        return "name string" if self.options.get("kind") == LEDGERS else "date date, xml string"

    def reader(self, schema) -> DataSourceReader:
        return _ServerReader(dict(self.options))


def _server(spark: SparkSession, **options):
    spark.dataSource.register(VoucherServer)
    return spark.read.format("voucherserver").options(**options).load()


def fetch_vouchers(spark: SparkSession, url: str, company: str, first: str, last: str, days: int = 31) -> DataFrame:
    """(date, xml) of the vouchers booked from first to last (yyyy-MM-dd), a voucher a row; readers.parse_voucher_text shapes the XML."""
    return _server(spark, url=url, company=company, first=first, last=last, days=str(days))


def fetch_ledger_names(spark: SparkSession, url: str, company: str) -> DataFrame:
    """Names of the company's ledgers, each once."""
    return _server(spark, url=url, company=company, kind=LEDGERS).distinct()
