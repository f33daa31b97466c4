"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors within cosine c of each other lie within eps = sqrt(2 - 2c), and so do their
projections on any orthonormal directions. Vectors are projected on their leading principal
directions, put in the order of their eps-grid cells, and cut into blocks of that sequence, each
with the box of its projections. Intervals of the sequence are joined recursively: a pair of
intervals whose boxes are more than eps apart is skipped, any other is taken apart into pairs of
its parts, down to pairs of blocks. Inside a pair of blocks a pair of vectors is skipped if the
product of their leading projections and of the norms of what is left over can't reach c. Skipping
is provable, so no pair is lost. Where vectors fill all directions alike few blocks are far apart,
and the second bound, a product of LEADING + 1 numbers instead of all, does most of the work; the
number of block pairs then still grows with the square of the blocks.

The recursion ends at pairs of runs of 2^TILE_BITS neighbouring blocks (tiles). If a run is in at most
FEW_TILES of them on average, blocks are shuffled to their tiles. Else that shuffle would grow with the
square of the vectors, so every block is joined with every other one by a Cartesian product: its tasks
read the blocks from the shared folder again and write nothing, and drop pairs of distant boxes first.
Vectors keep the width of their column (float or double) until they are compared in double precision.

The principal directions are fitted on at most FIT_ROWS vectors (by hash); they only steer the
order and the bounds. Equal vectors are one class. A block pair yields, for each vector that links, its number of
links and the least vector of its component in that pair, never the pairs themselves, so results
grow with the vectors however large a group is.

Null, empty or zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths don't link. Rows that share a vec_id and a vector link with each other;
vec_id is taken to name one vector. Rows with a null vec_id link with nothing and have neither a
component nor are they kept; other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ledgerloom.llm.common import bound_batches, discard, salted_lookup, ship, staged
from ledgerloom.llm.components import connected_components

ship(__name__)

FIT_ROWS = 4096
DIRECTIONS = 4
LEADING = 16
BLOCK_ROWS = 1024
BLOCK_BYTES = 1 << 20
TILE_BITS = 3
FAN_OUT = 8
FEW_TILES = 2
#: Blocks that a task of the Cartesian product holds of one side, and that its Python worker keeps ready.
SIDE_BLOCKS, READY_BLOCKS = 256, 64
#: Tasks of the comparison at most; a task takes its tiles one after the other and holds one.
MOST_TASKS = 20_000


def _valid(kind: type):
    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, digest and vector (bytes of kind); null where the vector links with nothing."""
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no -0.0; null is NaN
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())])
            odd, some = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (~np.isfinite(flat), flat != 0))
            fit = (np.diff(odd) == 0) & (np.diff(some) > 0)
            vectors = [flat[i:j].tobytes() if ok else None for i, j, ok in zip(ends[:-1], ends[1:], fit)]
            digests = [v and hashlib.blake2b(v, digest_size=16).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "vector"])

    return valid


def _units(vectors: bytes, kind: type, width: int) -> np.ndarray:
    """Unit vectors in double precision of vectors one after the other."""
    x = np.frombuffer(vectors, kind).reshape(-1, width).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _basis(vectors: DataFrame, n: int, kind: type) -> dict[int, np.ndarray]:
    """Leading principal directions by vector length, from a bounded number of the n different vectors, those of least hash."""
    h = F.xxhash64("digest")
    share = min(1.0, 2 * FIT_ROWS / max(n, 1))
    some = vectors.where(h <= F.lit(-(1 << 63) + min(int(share * 2**64), 2**64 - 1))).dropDuplicates(["digest"])
    out: dict[int, list] = {}
    for r in some.orderBy(h).limit(FIT_ROWS).select("vector").collect():
        out.setdefault(len(r[0]) // np.dtype(kind).itemsize, []).append(r[0])
    return {d: np.linalg.eigh(np.cov(_units(b"".join(rows), kind, d).T, bias=True).reshape(d, d))[1][:, ::-1][:, : min(LEADING, d)].copy() for d, rows in out.items()}


def _leading(units: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """LEADING projections and the norm of the rest; without a basis of that length, 0s and 1."""
    out = np.zeros((len(units), LEADING + 1))
    b = basis.get(units.shape[1])
    if b is not None:
        out[:, : b.shape[1]] = units @ b
    out[:, LEADING] = np.sqrt(np.maximum(1 - (out**2).sum(axis=1), 0))
    return out


def _cells(basis: dict[int, np.ndarray], eps: float, kind: type):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            width = np.array([len(v) // np.dtype(kind).itemsize for v in vectors], np.int32)
            grid = np.zeros((len(vectors), DIRECTIONS), np.int32)
            for d in np.unique(width):
                at = np.flatnonzero(width == d)
                grid[at] = np.floor(_leading(_units(b"".join(vectors[i] for i in at), kind, d), basis)[:, :DIRECTIONS] / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width), *[pa.array(grid[:, k]) for k in range(DIRECTIONS)]], [*batch.schema.names, "width", *[f"c{k}" for k in range(DIRECTIONS)]])

    return cells


def _blocks(basis: dict[int, np.ndarray], block_rows: int, kind: type):
    """Blocks of a sorted partition: number in the sequence, members, matrix and box of projections."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []

        def cut():
            nonlocal number
            reps, sizes, vectors, widths = zip(*held)
            matrix = b"".join(vectors)
            box = _leading(_units(matrix, kind, widths[0]), basis)[:, :DIRECTIONS]
            row = {"block": number, "reps": list(reps), "sizes": list(sizes), "width": widths[0], "matrix": matrix, "low": box.min(axis=0).tolist(), "high": box.max(axis=0).tolist()}
            number += 1
            held.clear()
            fields = [("block", pa.int64()), ("reps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("width", pa.int32()), ("matrix", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
            return pa.RecordBatch.from_pylist([row], pa.schema(fields))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("rep", "size", "vector", "width"))):
                if held and (len(held) >= min(block_rows, max(64, BLOCK_BYTES // (8 * row[3]))) or held[-1][3] != row[3]):
                    yield cut()
                held.append(row)
        if held:
            yield cut()

    return blocks


def block_pairs(boxes: DataFrame, eps: float, spread: int) -> DataFrame:
    """(i, j), i <= j: blocks whose boxes are at most eps apart and widths equal, by recursion over intervals.

    boxes: block, width, low, high. spread: bits of a block number.
    """
    shift = max(1, FAN_OUT.bit_length() - 1)
    levels = [boxes]
    used = 0
    while used < spread:
        used += shift
        up = levels[-1].withColumn("block", F.shiftright("block", shift)).groupBy("block")
        ends = [F.array(*[f(F.col(c)[k]) for k in range(DIRECTIONS)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
        levels.append(up.agg(*ends, F.lit(None).cast("int").alias("width")))
    top = levels.pop()
    pairs = top.select(F.col("block").alias("i"), F.col("block").alias("j"))
    for level in reversed(levels):
        side = lambda s: level.select(F.shiftright("block", shift).alias(s), F.col("block").alias(f"{s}_"), *[F.col(c).alias(f"{s}{c}") for c in ("low", "high", "width")])  # noqa: E731, B023
        gap = lambda k: F.greatest(F.col("ilow")[k] - F.col("jhigh")[k], F.col("jlow")[k] - F.col("ihigh")[k], F.lit(0.0))
        near = sum((gap(k) * gap(k) for k in range(1, DIRECTIONS)), gap(0) * gap(0)) <= F.lit(eps * eps + 1e-9)
        alike = F.col("iwidth").isNull() | (F.col("iwidth") == F.col("jwidth"))
        pairs = pairs.join(side("i"), "i").join(side("j"), "j").where((F.col("i_") <= F.col("j_")) & near & alike).select(F.col("i_").alias("i"), F.col("j_").alias("j"))
    return pairs


def _local_roots(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Least index of each node's component over edges (rows, cols)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _sparse(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of a bipartite mask: each row with its first column, each column with its first row, and rows with the first row of any of their columns."""
    if np.count_nonzero(mask) <= 8 * sum(mask.shape):
        return np.nonzero(mask)
    rows, cols = [], []
    left = mask.copy()
    while True:
        live = np.flatnonzero(left.any(axis=1))
        if not len(live):
            return np.concatenate(rows), np.concatenate(cols)
        # a row and every row that shares a column with it; then the rest, where those columns still count
        r = live[0]
        own = np.flatnonzero(left[r])
        rows.append(np.full(len(own), r))
        cols.append(own)
        sharing = np.flatnonzero(left[:, own].any(axis=1))
        sharing = sharing[sharing != r]
        rows.append(sharing)
        cols.append(own[np.argmax(left[np.ix_(sharing, own)], axis=1)])
        left[:, own] = False
        left[r] = False


def _linked(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b reach the cosine; decided in double precision wherever it is close."""
    slack = 4e-7 * (a.shape[1] + LEADING)
    mask = lead_a @ lead_b.T >= cosine - slack
    r, c = np.nonzero(mask)
    if len(r) > mask.size // 16:
        near = a.astype(np.float32) @ b.astype(np.float32).T
        mask = near >= cosine - slack
        r, c = np.nonzero(mask & (near < cosine + slack))
    for k in range(0, len(r), 1 << 16):
        s = slice(k, k + (1 << 16))
        mask[r[s], c[s]] = np.einsum("ij,ij->i", a[r[s]], b[c[s]]) >= cosine
    return mask


def tile_tasks(tiles: int, cores: int) -> int:
    """Tasks for so many tiles: two a tile as long as that is few, so that small ones even out."""
    return max(2 * cores, min(2 * tiles, MOST_TASKS))


def _block_links(x: dict, y: dict, cosine: float) -> pa.RecordBatch | None:
    """For each vector of two blocks that links: its number of links and the least vector of its component, in this pair of blocks."""
    same = x["block"] == y["block"]
    mask = _linked(x["matrix"], y["matrix"], x["lead"], y["lead"], cosine)
    if same:
        np.fill_diagonal(mask, False)
    if not mask.any():
        return None
    links = [mask @ y["sizes"], np.zeros(0) if same else x["sizes"] @ mask]
    r, c = _sparse(mask)
    n = len(x["reps"])
    roots = _local_roots(r, c if same else c + n, n if same else n + len(y["reps"]))
    members = x["reps"] if same else np.concatenate([x["reps"], y["reps"]])
    least = members.copy()
    np.minimum.at(least, roots, members)
    counts = np.concatenate(links)
    live = counts > 0
    return pa.RecordBatch.from_arrays([pa.array(members[live]), pa.array(counts[live].astype(np.int64)), pa.array(least[roots][live])], ["rep", "links", "root"])


def _loaded(batch: pa.RecordBatch, p: int, basis: dict[int, np.ndarray], kind: type, prefix: str = "") -> dict:
    """A block ready for comparison, from row p."""
    column = lambda c: batch.column(prefix + c)[p]
    row = {c: column(c).as_py() for c in ("block", "width")} | {c: column(c).values.to_numpy() for c in ("reps", "low", "high")}
    row["sizes"] = column("sizes").values.to_numpy().astype(np.float64)
    row["matrix"] = _units(column("matrix").as_py(), kind, row["width"])
    row["lead"] = _leading(row["matrix"], basis).astype(np.float32)
    return row


def _compare_pairs(basis: dict[int, np.ndarray], cosine: float, kind: type):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks; one comes many times, so some are kept ready."""
        ready: dict[int, dict] = {}
        for batch in batches:
            for p in range(batch.num_rows):
                pair = []
                for prefix in ("x_", "y_"):
                    block = batch.column(prefix + "block")[p].as_py()
                    if (own := ready.get(block)) is None:
                        if len(ready) >= READY_BLOCKS:
                            del ready[next(iter(ready))]
                        own = ready[block] = _loaded(batch, p, basis, kind, prefix)
                    pair.append(own)
                if (found := _block_links(*pair, cosine)) is not None:
                    yield found

    return compare


def _compare(basis: dict[int, np.ndarray], cosine: float, eps: float, kind: type):
    def tile(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for x in rows:
            for y in rows:
                if x["block"] > y["block"] or x["width"] != y["width"] or (x["block"] >> TILE_BITS, y["block"] >> TILE_BITS) != (x["i"], x["j"]):
                    continue
                gap = np.maximum(np.maximum(x["low"] - y["high"], y["low"] - x["high"]), 0)
                if (gap**2).sum() <= eps * eps + 1e-9 and (found := _block_links(x, y, cosine)) is not None:
                    yield found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks sorted by tile."""
        held: list[dict] = []
        for batch in batches:
            for p in range(batch.num_rows):
                row = _loaded(batch, p, basis, kind) | {c: batch.column(c)[p].as_py() for c in ("i", "j")}
                if held and (held[0]["i"], held[0]["j"]) != (row["i"], row["j"]):
                    yield from tile(held)
                    held = []
                held.append(row)
        yield from tile(held)

    return compare


def all_block_pairs(blocks: DataFrame, sides: int, eps: float) -> DataFrame:
    """x_ and y_ columns of every pair of near blocks of equal width, once each, by a Cartesian product of so many partitions a side."""
    x, y = (blocks.coalesce(sides).select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns]) for s in "xy")
    gap = lambda k: F.greatest(F.col("x_low")[k] - F.col("y_high")[k], F.col("y_low")[k] - F.col("x_high")[k], F.lit(0.0))
    near = reduce(lambda a, b: a + b, (gap(k) * gap(k) for k in range(DIRECTIONS))) <= F.lit(eps * eps + 1e-9)
    i, j = F.col("x_block"), F.col("y_block")
    # one of (i, j) and (j, i), by the sum's parity, so that every task has the same share of its pairs
    once = (i == j) | F.when((i + j) % 2 == 1, i < j).otherwise(i > j)
    return x.hint("shuffle_replicate_nl").join(y, once & (F.col("x_width") - F.col("y_width") == 0) & near)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id long, kept boolean."""
    spark = vectors.sparkSession
    bound_batches(spark)
    eps = math.sqrt(2 - 2 * cosine)
    kind = np.float32 if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else np.float64
    valid = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(_valid(kind), "vec_id long, digest binary, vector binary")
    rows = staged(valid.select("vec_id", "digest"), "ego-vectors")
    linking = "digest IS NOT NULL AND vec_id IS NOT NULL"
    classes = staged(rows.where(linking).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")), "ego-classes")
    n = classes.count()
    basis = _basis(valid.where(linking), n, kind)

    grid = ["width", *[f"c{k}" for k in range(DIRECTIONS)]]
    placed = valid.where(linking).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector")).select("rep", "size", "vector")
    placed = placed.mapInArrow(_cells(basis, eps, kind), "rep long, size long, vector binary, width int, " + ", ".join(f"c{k} int" for k in range(DIRECTIONS)))
    parts = max(1, math.ceil(n / (4 * block_rows)))
    placed = placed.repartitionByRange(parts, *grid, "rep").sortWithinPartitions(*grid, "rep")
    blocks_table = staged(placed.mapInArrow(_blocks(basis, block_rows, kind), "block long, reps array<long>, sizes array<long>, width int, matrix binary, low array<double>, high array<double>"), "ego-blocks")

    # block numbers are sparse (partition, place): recursion needs their rank, over a table of block numbers only
    numbered = blocks_table.select("block", F.shiftright("block", 24).alias("part"), F.col("block").bitwiseAND(F.lit((1 << 24) - 1)).alias("place"))
    deepest = numbered.agg(F.max("place"), F.max("part")).first()
    wide = max(1, (deepest[0] or 0).bit_length())
    spread = wide + max(1, (deepest[1] or 0).bit_length())
    dense = F.shiftleft(F.shiftright("block", 24), wide).bitwiseOR(F.col("block").bitwiseAND(F.lit((1 << 24) - 1)))
    blocks = blocks_table.withColumn("block", dense)

    run = F.shiftright("block", TILE_BITS)
    ends = [F.array(*[f(F.col(c)[k]) for k in range(DIRECTIONS)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    runs = staged(blocks.groupBy(run.alias("block")).agg(*ends, F.lit(None).cast("int").alias("width"), F.count(F.lit(1)).alias("n")), "ego-runs")
    tiles = staged(block_pairs(runs.drop("n"), eps, max(1, spread - TILE_BITS)), "ego-tiles")
    n_tiles, met = tiles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2)), F.lit(0))).first()
    n_runs, n_blocks = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = tile_tasks(n_tiles, spark.sparkContext.defaultParallelism)
    if met <= FEW_TILES * n_runs:
        work = tiles.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("run")).join(blocks.withColumn("run", run), "run")
        work = work.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "block")
        work = work.select("i", "j", "block", "width", "reps", "sizes", "matrix", "low", "high").mapInArrow(_compare(basis, cosine, eps, kind), "rep long, links long, root long")
    else:
        sides = max(math.isqrt(tasks), math.ceil(n_blocks / SIDE_BLOCKS))
        work = all_block_pairs(blocks, sides, eps).mapInArrow(_compare_pairs(basis, cosine, kind), "rep long, links long, root long")
    found = staged(work, "ego-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "ego-components")
    discard(blocks_table, runs, tiles)

    known = classes.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = salted_lookup(rows.select("vec_id", "digest"), known, "digest", F.col("vec_id"))
    named = F.col("vec_id").isNotNull()
    component_id = F.when(named, F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
