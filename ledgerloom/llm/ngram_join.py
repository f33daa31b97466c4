"""N-gram Jaccard join: documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

Method: shingles are put in one global order, rare ones first; a document's prefix are its first
n - ceil(t n) + 1 shingles, and two documents that link share a shingle of both prefixes. Prefix
shingles are joined, candidates are dropped by length (t |x| <= |y|), by the place of the common
shingle in both orders (positional filter) and by counts in ranges of the sorted sets (suffix
filter), and each pair left is verified once on the whole sets.

The order is by how often a shingle's hash bucket occurs over all documents (a table of SKETCH
counters, so of fixed size whatever the corpus), then by hash. Any order that all documents share
gives exact results; counts only make common shingles fall outside the prefixes.

Results are components, so pairs inside a group need not be listed. Documents with equal sets are
one class, and only its least doc_id takes part. Then come rounds in which every prefix shingle
links its documents to one of them (first the least, then one by hash). Whole sets are made again
from the texts, for the documents of a round's pairs only, and never stored; shingles whose documents
are in one component already are left out. After the rounds, all pairs left whose documents share
a prefix shingle but not a component are verified, so no link between components is lost.

Null and empty texts have no shingles and link with nothing; rows that share a doc_id are one
document if their texts are equal, and doc_id is taken to name one text; rows with a null doc_id
link with nothing and have no component; other columns are left out, whatever their names; a very
long text takes its own size of hashes in its task; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, discard, salted_lookup, ship, small, staged
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shingles import batch_sets, mix

ship(__name__)

SKETCH_BITS = 20
SKETCH_PARTS = 16
ROUNDS = 2
THRESHOLD = 80
NARROW_ROWS = 250_000
MEMBERS_PER_TASK_GROUP = 256


def required(n: np.ndarray | int, percent: int = THRESHOLD):
    """ceil(percent / 100 * n) in whole numbers."""
    return -(-n * percent // 100)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (its set's size and digest), then the task's shingle counts in SKETCH_PARTS rows."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    shift, names = np.uint64(64 - SKETCH_BITS), ["doc_id", "n", "digest", "part", "counts"]
    for batch in batches:
        sizes, digests = [], []
        for s in batch_sets(batch.column(1)):
            sizes.append(len(s))
            digests.append(np.array([len(s), s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(s)], np.uint64).tobytes() if len(s) else None)
            np.add.at(counts, (s >> shift).astype(np.int64), 1)
        k = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    small_counts = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(SKETCH_PARTS, -1)
    k = SKETCH_PARTS
    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in small_counts], pa.binary())], names)


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of one part's counters."""
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
    for batch in batches:
        for row in batch.column("counts"):
            own = np.frombuffer(row.as_py(), np.uint8)
            total += own.view(np.uint64 if len(own) == total.nbytes else np.uint16)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])


def frequency_steps(sketches: DataFrame) -> np.ndarray:
    """The corpus-wide counters in quarter octaves: 2^SKETCH_BITS of them whatever the corpus. Summed in two steps."""
    some = sketches.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    some = some.groupBy("part", "salt").applyInArrow(_summed, "part int, counts binary")
    rows = some.groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint64)
    for r in rows:
        counts[r["part"]] = np.frombuffer(r["counts"], np.uint64)
    return np.round(4 * np.log2(counts.reshape(-1) + 1.0)).astype(np.uint8)


def _prefixes(steps, percent: int):
    """Prefix shingles (hash), their place in the document's order, and the set's size."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shift = steps.value, np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            ids, parts, places, sizes = [], [], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), batch_sets(batch.column(1))):
                n = len(s)
                if not n or doc_id is None:
                    continue
                p = n - required(n, percent) + 1
                order = (table[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.argsort(order[first], kind="stable")]
                parts.append(s[first].view(np.int64))
                places.append(np.arange(p, dtype=np.int32))
                ids.append(np.full(p, doc_id, np.int64))
                sizes.append(np.full(p, n, np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (parts, ids, places, sizes)], ["s", "doc", "place", "n"])

    return prefixes


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in batch_sets(batch.column(1))], pa.binary())], ["doc", "shingles"])


def linked(x: np.ndarray, y: np.ndarray, percent: int = THRESHOLD) -> bool:
    """Whether two sorted sets have 100 |x & y| >= percent |x | y|; counts in ranges of the values come first."""
    if len(x) > len(y):
        x, y = y, x
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if len(x) < need:
        return False
    cuts = x[:: max(1, len(x) // 16)]
    at_x, at_y = np.searchsorted(x, cuts), np.searchsorted(y, cuts)
    most = np.minimum(np.diff(at_x, append=len(x)), np.diff(at_y, append=len(y))).sum() + min(at_x[0], at_y[0])
    if most < need:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (pivot, salt, member first null): the pivot's set, then its candidates'."""
        pivot, own = None, None
        for batch in batches:
            out = []
            for p, doc, is_pivot, s in zip(batch.column("pivot").to_pylist(), batch.column("doc").to_pylist(), batch.column("is_pivot").to_pylist(), batch.column("shingles")):
                values = np.frombuffer(s.as_buffer(), np.uint64)
                if is_pivot:
                    pivot, own = p, values.copy()
                    continue
                if p != pivot:
                    raise ValueError("a candidate stands before its pivot")
                out.append((p, doc, linked(own, values, percent)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["pivot", "doc", "linked"])

    return verify


def _narrow(df: DataFrame) -> DataFrame:
    return small(df, NARROW_ROWS)


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(pivot, doc, linked) of candidate pairs of rows (doc_id, text); each pivot's set is sent once to every group of its candidates.

    Sets are made where the texts are read, of the pairs' documents only, and go straight to where they are compared.
    """
    sized = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(MEMBERS_PER_TASK_GROUP))).cast("int")
    salts = staged(sized.select("pivot", groups.alias("groups")), "ngram-salts")
    members = pairs.join(_narrow(salts), "pivot").select("doc", "pivot", F.pmod(F.xxhash64("doc"), F.col("groups")).cast("int").alias("salt"), F.lit(False).alias("is_pivot"))
    heads = salts.select(F.col("pivot").alias("doc"), "pivot", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(True).alias("is_pivot"))
    roles = staged(members.unionByName(heads), "ngram-roles")
    wanted = rows.join(_narrow(staged(roles.select(F.col("doc").alias("doc_id")).distinct(), "ngram-wanted")), "doc_id", "left_semi")
    sets = wanted.mapInArrow(_sets, "doc long, shingles binary")
    dealt = sets.join(_narrow(roles), "doc").select("pivot", "salt", "is_pivot", "doc", "shingles")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", F.desc("is_pivot"))
    out = staged(dealt.mapInArrow(_verify(percent), "pivot long, doc long, linked boolean"), "ngram-checked")
    discard(salts, roles)
    return out


def _may_link(percent: int, a: str, b: str) -> Column:
    """Length and positional filters of postings a and b for the first shingle that two sets share.

    In one global order nothing common stands before it, so the overlap is at most what stands from it on in either set.
    """
    n, place = (lambda s: F.col(f"{s}.n").cast("long")), (lambda s: F.col(f"{s}.place"))
    need = F.ceil((n(a) + n(b)) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))
    return (100 * F.least(n(a), n(b)) >= percent * F.greatest(n(a), n(b))) & (n(a) - place(a) >= need) & (n(b) - place(b) >= need)


def _with_pivot(postings: DataFrame, turn: int) -> DataFrame:
    """Postings with the one of their shingle that the others are joined with: the least document at first, then one by hash."""
    rank = F.col("doc") if turn == 0 else F.xxhash64(F.lit(turn), "doc")
    least = F.min(F.struct(rank.alias("rank"), "doc", "place", "n", "component")).over(Window.partitionBy("s"))
    return postings.select("s", "doc", "place", "n", "component", least.alias("pivot"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id long."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    first = staged(rows.mapInArrow(_digests, "doc_id long, n long, digest binary, part int, counts binary"), "ngram-digests")
    steps = spark.sparkContext.broadcast(frequency_steps(first.where("part IS NOT NULL").select("part", "counts")))
    digests = staged(first.where("part IS NULL").select("doc_id", "n", "digest"), "ngram-documents")
    discard(first)

    classes = staged(digests.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    copies = salted_lookup(digests.where("digest IS NOT NULL"), classes, "digest", F.col("doc_id")).where("doc_id <> rep").select("doc_id").distinct()
    alone = rows.join(_narrow(staged(copies, "ngram-copies")), "doc_id", "left_anti")

    postings = alone.mapInArrow(_prefixes(steps, percent), "s long, doc long, place int, n int")
    # kept: postings of documents that have another one of a fitting size beside them, the next in size being the most fitting
    by_size = Window.partitionBy("s").orderBy("n", "doc")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = (100 * before.cast("long") >= percent * F.col("n")) | (100 * F.col("n").cast("long") >= percent * after.cast("long"))
    hits = postings.withColumn("fits", F.coalesce(fits, F.lit(False))).where("fits").withColumn("component", F.col("doc"))
    hits = staged(_with_pivot(hits, 0), "ngram-hits")

    active = staged(hits.select("doc").distinct(), "ngram-active")

    component = active.select(F.col("doc").alias("node"), F.col("doc").alias("component"))
    edges = failed = None
    for turn in range(ROUNDS + 1):
        a, b = F.col("pivot"), F.struct("doc", "place", "n", "component")
        if turn < ROUNDS:
            found = hits.select(a.alias("a"), b.alias("b"))
        else:
            left, right = hits.select("s", b.alias("a")), hits.select("s", b.alias("b"))
            found = left.join(right, "s").where(F.col("a.doc") < F.col("b.doc"))
        found = found.where(F.col("a.component") != F.col("b.component")).where(_may_link(percent, "a", "b"))
        pairs = found.select(F.col("a.doc").alias("pivot"), F.col("b.doc").alias("doc")).distinct()
        if failed is not None:
            pairs = pairs.join(failed, [pairs.pivot == failed.x, pairs.doc == failed.y], "left_anti").join(failed, [pairs.pivot == failed.y, pairs.doc == failed.x], "left_anti")
        pairs = staged(pairs, "ngram-pairs")
        if not pairs.isEmpty():
            checked = verified(pairs, rows, percent)
            new = checked.where("linked").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
            missed = checked.where("NOT linked").select(F.col("pivot").alias("x"), F.col("doc").alias("y"))
            edges = new if edges is None else edges.union(new)
            failed = missed if failed is None else failed.union(missed)
            component = connected_components(edges, "ngram-components")
            component = staged(active.withColumnRenamed("doc", "node").join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "ngram-labels")
        discard(pairs)
        if turn < ROUNDS:
            # components only merge, so what is settled stays settled: the next round reads what this one left
            placed = hits.select("s", "doc", "place", "n").join(_narrow(component.withColumnRenamed("node", "doc")), "doc")
            group = Window.partitionBy("s")
            mixed = placed.withColumn("c0", F.min("component").over(group)).withColumn("c1", F.max("component").over(group)).where("c0 < c1").drop("c0", "c1")
            left_over = staged(_with_pivot(mixed, turn + 1), "ngram-hits")
            discard(hits)
            hits = left_over

    discard(hits)
    known = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = salted_lookup(digests, known, "digest", F.col("doc_id"))
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"))
