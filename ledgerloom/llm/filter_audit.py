"""Filter interaction audit: how five filters overlap, in every order.

The filters fail a text that A: has under 200 words, B: has under half as many distinct words as words,
C: has more than 3 capitals A-Z in 100 code points, D: holds any of `#$%&*|`, E: equals the text of a
smaller doc_id anywhere in the table. Words are `[^\\x20\\x09-\\x0D]+`, case kept; null texts are empty.

Duplicates come from radix tries of full texts. Texts are dealt to tasks by ranges of an adaptive prefix:
the shortest of 16, 64, 256, ... code points whose texts weigh less than a task's share, so that
a passage that opens many texts is split further down, and equal texts share their prefix. A text whose own
copies outweigh the share is dealt over salts. Each task inserts the texts of its range into a compressed
trie; terminals hold the least doc_id and the text's mask of A to D. Where a text was salted, the
terminals of its tries are merged by their least id. Rows become masks, masks become counts per part,
and the 120 orders are read from these counts.

A null doc_id has no label, is no smaller id and fails no E; repeated rows count each, and equal
(doc_id, text) rows aren't each other's duplicates; labels of one doc_id count as 1 if any is 1; a null or
empty part is the empty string; an empty table gives an empty result. Columns other than the key, part and
text are ignored. A range of texts is held by one task: about TARGET bytes, or one text if that is longer.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, ship, small, staged

ship(__name__)

FILTERS = "ABCDE"
#: Bytes of text that one task should hold, and how many light prefixes it should at least be made of.
TARGET, SHARES = 16 << 20, 4
#: Bytes a row weighs besides its text.
ROW = 64
FIRST_LEVEL, STEP, LEVELS = 16, 4, 4
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits 1, 2, 4, 8 of filters A to D that a UTF-8 text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3


class TextTrie:
    """A compressed trie of byte strings; terminals hold the least id inserted and a value made once per text."""

    def __init__(self, make) -> None:
        self.make = make
        self.labels, self.below, self.least, self.values = [b""], [{}], [None], [None]

    def _node(self, label: bytes) -> int:
        self.labels.append(label)
        self.below.append({})
        self.least.append(None)
        self.values.append(None)
        return len(self.labels) - 1

    def insert(self, text: bytes, number: int | None) -> int:
        """The terminal of text, which stays the same node whatever is inserted later."""
        node, at = 0, 0
        while at < len(text):
            child = self.below[node].get(text[at])
            if child is None:
                child = self.below[node][text[at]] = self._node(text[at:])
                at = len(text)
            elif text.startswith(self.labels[child], at):
                at += len(self.labels[child])
            else:
                label = self.labels[child]
                low, high = 1, min(len(label), len(text) - at)
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if label[:middle] == text[at : at + middle] else (low, middle - 1)
                upper = self.below[node][text[at]] = self._node(label[:low])
                self.labels[child] = label[low:]
                self.below[upper][label[low]] = child
                child, at = upper, at + low
            node = child
        if self.values[node] is None:
            self.values[node] = self.make(text)
        if number is not None and (self.least[node] is None or number < self.least[node]):
            self.least[node] = number
        return node


def _range_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All texts of the task's range into one trie, then every row's mask."""
    trie, held = TextTrie(text_mask), []
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        nodes = [trie.insert(t, i) for t, i in zip(batch.column("body").to_pylist(), ids)]
        held.append((ids, batch.column("part"), batch.column("hot"), nodes))
    for ids, parts, hot, nodes in held:
        least = [trie.least[n] for n in nodes]
        masks = [trie.values[n] | (i is not None and i > low) << 4 for i, low, n in zip(ids, least, nodes)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), parts, pa.array(masks, pa.int32()), hot, pa.array(least, pa.int64())], ["doc_id", "part", "mask", "hot", "least"])


def _prefix(level: int) -> tuple[Column, Column]:
    """The prefix of so many code points, and whether it is the whole text."""
    prefix = F.substring("text", 1, level)
    return prefix, prefix == F.col("text")


def _fingerprint(level: int) -> Column:
    prefix, whole = _prefix(level)
    return F.xxhash64(F.lit(level), whole, prefix)


def heavy_prefixes(rows: DataFrame, limit: int) -> dict[int, DataFrame]:
    """By level the fingerprints (h, and root, that of their first level) of prefixes whose texts weigh more than limit, with weight and whether they are whole texts.

    There are at most total / limit of a level. A level is looked at where the level above is heavy and not whole.
    """
    found: dict[int, DataFrame] = {}
    root = _fingerprint(FIRST_LEVEL).alias("root")
    levels = [FIRST_LEVEL * STEP**k for k in range(LEVELS)]
    while True:
        reached = []
        for k, level in enumerate(levels):
            _, whole = _prefix(level)
            looked_at = F.lit(True) if not k else ~_prefix(levels[k - 1])[1]
            reached.append(F.when(looked_at, F.struct(F.lit(level).alias("level"), _fingerprint(level).alias("h"), whole.alias("whole"))))
        each = rows.select("weight", root, F.explode(F.filter(F.array(*reached), lambda x: x.isNotNull())).alias("p")).select("weight", "root", "p.*")
        heavy = staged(each.groupBy("level", "root", "h", "whole").agg(F.sum("weight").alias("w")).where(F.col("w") > limit), "audit-prefixes")
        deepest = set()
        for r in heavy.groupBy("level").agg(F.min("whole").alias("whole")).collect():
            found[r["level"]] = heavy.where(F.col("level") == r["level"]).select("root", "h", "whole", "w")
            if not r["whole"]:
                deepest.add(r["level"])
        if levels[-1] not in deepest:
            return found
        last = levels[-1]
        rows = rows.join(small(found[last].where("NOT whole").select(F.col("h").alias("h_last"))), _fingerprint(last) == F.col("h_last"), "left_semi")
        levels = [last * STEP**k for k in range(1, LEVELS + 1)]


def dealt_texts(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """docs (doc_id, part, text not null) dealt to tasks by ranges of adaptive prefixes; hot names a salted text, else null."""
    rows = docs.withColumn("weight", F.octet_length("text").cast("long") + ROW)
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / target))
    limit = max(1, total // (SHARES * tasks))
    heavy = heavy_prefixes(rows, limit)
    key, salt, hot = F.col("text"), F.lit(0), F.lit(None).cast("string")
    if heavy:
        # one row per heavy first prefix, with all heavy prefixes that begin with it: one lookup of a row tells its levels
        below = functools.reduce(DataFrame.unionByName, heavy.values()).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("h", F.struct("whole", "w")))).alias("below"))
        rows = rows.join(small(below), _fingerprint(FIRST_LEVEL) == F.col("root"), "left")
    for level in sorted({FIRST_LEVEL, *heavy, *(STEP * k for k in heavy)}, reverse=True):
        prefix, whole = _prefix(level)
        if level not in heavy:
            key, salt, hot = prefix, F.lit(0), F.lit(None).cast("string")
            continue
        own = F.try_element_at("below", _fingerprint(level))
        weighs, salted = own.isNotNull(), own["whole"]
        split = F.pmod(F.xxhash64("doc_id"), F.ceil(own["w"] / limit)).cast("int")
        key = F.when(weighs & ~salted, key).otherwise(prefix)
        hot = F.when(weighs, F.when(salted, F.sha2("text", 256)).otherwise(hot))
        salt = F.when(weighs, F.when(salted, split).otherwise(salt)).otherwise(0)
    dealt = rows.select("doc_id", "part", F.encode("text", "UTF-8").alias("body"), key.alias("key"), salt.alias("salt"), hot.alias("hot"))
    return dealt.repartitionByRange(tasks, "key", "salt").drop("key", "salt")


def text_masks(docs: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text", target: int = TARGET) -> DataFrame:
    """Per row of docs: doc_id, part, mask int (bits 1 to 16 of the filters A to E that it fails)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    masked = staged(dealt_texts(rows, target).mapInArrow(_range_masks, "doc_id long, part string, mask int, hot string, least long"), "audit-masks")
    merged = masked.where("hot IS NOT NULL").groupBy("hot").agg(F.min("least").alias("least_of_all"))
    both = masked.join(small(merged), "hot", "left")
    late = F.when((F.col("doc_id") > F.col("least_of_all")), F.lit(1 << 4)).otherwise(0)
    return both.select("doc_id", "part", F.col("mask").bitwiseOR(late).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: n, good (quality 1) and toxic documents."""
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = masks.join(small(marked), "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps() -> str:
    """All orders and steps with the filters before and the step's own, as JSON."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        out += [{"filter_order": name, "step": k + 1, "before": sum(1 << f for f in order[:k]), "own": 1 << f} for k, f in enumerate(order)]
    return json.dumps(out)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", target: int = TARGET) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(text_masks(docs, part=part, target=target), labels)
    counts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    rows = counts.select("part", "counts", F.explode(steps).alias("s")).select("part", "counts", "s.*")

    def total(value: str, held) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + F.when(held(c["mask"]), c[value]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    orders = math.factorial(len(FILTERS))
    fair = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), F.expr(f"{orders}L") * c["n"] / F.bit_count(c["mask"])).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        fair.alias("shapley"),
    )
