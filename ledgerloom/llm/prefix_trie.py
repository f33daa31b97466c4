"""Conversation prefix trie and its balanced rollup by centroid decomposition.

Conversations are rebuilt: conversation c starts with the first h turns of conversation c - c % 100,
h = crc32(c) % 6, and goes on with its own turns after its first h. A node is a distinct sequence of first
turns; it is named by its least member and its depth, as (conv_id, depth). Sequences are told apart by two
64-bit xors of hashes of (turn's MD5, depth), so a conversation of any length is read by blocks of 1,024 turns.

Sums over subtrees come from a centroid decomposition of the parent edges. The members' remaining turns
are a subtree weight that needs no rollup: a node's weight is its n_convs plus its children's weights.
In each component the deepest node with more than half of the top's weight is its centroid. The centroid's
subtree total is added to it and to every node on its path to the component's top; the subtrees below its
children and what is left above become components. A component's weight halves, so each node takes
part in a logarithmic number of rounds, however deep the trie is. Rounds are joins as long as a component holds more
than COMPONENT nodes; the others are dealt to tasks by component and finished there, all at once.

Turns are ordered by turn (null first), then role, then text; null role or text is empty. Rows with a null
conv_id are left out. Repeated rows are turns of their own. A conversation without turns after rebuilding
is a member of the root only; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, exact_rank, ship, small, staged

ship(__name__)

FAMILY, SHARED = 100, 6
#: Nodes of a component that one task finishes.
COMPONENT = 256
#: Nodes that one task of the finishing step should hold.
NODES_PER_TASK = 100_000
#: Range of conversation ids whose ends are one chunk of a node's list.
CHUNK = 1 << 16


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars) of each turn in order."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.shiftright(F.col("turn").cast("long"), 10), F.lit(-(1 << 62))))
    ranked = exact_rank(rows, ["conv_id"], "block", [F.col("turn").asc_nulls_first(), "role", "text"], "pos")
    said = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    return ranked.select("conv_id", F.col("pos").cast("long").alias("pos"), said.alias("digest"), F.char_length("text").cast("long").alias("chars"))


def rebuilt_turns(own: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, digest, chars) of each rebuilt conversation."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("long")
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    convs = own.select("conv_id").distinct().select("conv_id", base.alias("base"), shared.alias("h"))
    taken = convs.join(first, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    held = first.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    rest = own.select("*", base.alias("base"), shared.alias("h")).where("pos > h").join(small(held), "base", "left")
    return taken.union(rest.select("conv_id", (F.least("h", F.coalesce("held", F.lit(0))) + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns with a, b: xors over the turns up to this one, and up_a, up_b: those of the turns before it."""
    each = turns.select("conv_id", "depth", "chars", F.xxhash64("digest", "depth").alias("x"), F.xxhash64("depth", "digest").alias("y"), F.shiftright("depth", 10).alias("block"))
    blocks = each.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", F.bit_xor("x").over(earlier).alias("p"), F.bit_xor("y").over(earlier).alias("q")).where("p IS NOT NULL")
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = each.withColumn("a", F.bit_xor("x").over(upto)).withColumn("b", F.bit_xor("y").over(upto)).join(before, ["conv_id", "block"], "left")
    whole = within.withColumn("a", F.col("a").bitwiseXOR(F.coalesce("p", F.lit(0)))).withColumn("b", F.col("b").bitwiseXOR(F.coalesce("q", F.lit(0))))
    return whole.select("conv_id", "depth", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"))


def trie_nodes(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, ends): nodes (conv_id, depth, parent, n_convs, weight, saved, top: the root's conv_id), paths (member, depth, conv_id, parent), ends (conv_id, depth, member)."""
    hashed = staged(prefix_hashes(rebuilt_turns(own)), "trie-hashes")
    lengths = hashed.groupBy("conv_id").agg(F.max("depth").alias("length"))
    convs = staged(own.select("conv_id").distinct().join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length")), "trie-lengths")
    each = hashed.join(convs, "conv_id").select("conv_id", "depth", "a", "b", "up_a", "up_b", "chars", (F.col("length") - F.col("depth") + 1).alias("below"))
    found = each.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum("below").alias("weight"), F.max("chars").alias("chars"))
    found = staged(found, "trie-found")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("weight"))
    top = root.first()["node"]
    members = hashed.select("conv_id", "depth", "a", "b").join(found.select("depth", "a", "b", "node"), ["depth", "a", "b"]).select(F.col("conv_id").alias("member"), "depth", "node")
    steps = staged(members.union(convs.select("conv_id", zero, F.lit(top).cast("long"))), "trie-steps")
    above = steps.select("member", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    paths = staged(steps.join(above, ["member", "depth"], "left").select("member", "depth", F.col("node").alias("conv_id"), "parent"), "trie-paths")
    every = found.select("node", "depth", "n_convs", "weight", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    every = every.union(root.where("n_convs > 0").select("node", zero, "n_convs", "weight", zero))
    up = paths.select(F.col("member").alias("node"), "depth", "parent")
    nodes = every.join(up, ["node", "depth"]).select(F.col("node").alias("conv_id"), "depth", "parent", "n_convs", "weight", "saved", F.lit(top).cast("long").alias("top"))
    ends = paths.join(convs.select(F.col("conv_id").alias("member"), F.col("length").alias("depth")), ["member", "depth"]).select("conv_id", "depth", "member")
    discard(hashed)
    return nodes, paths, ends


def local_rollup(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of values by centroid decomposition of a forest; parent is -1 at tops, weight strictly falls down the tree.

    weight must be additive: a node's weight less its children's weights is positive.
    """
    n = len(parent)
    parent, weight, sums = parent.copy(), weight.astype(np.int64).copy(), np.zeros_like(values)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    top = np.where(parent < 0, np.arange(n), -1)
    for level in levels:
        inner = level[parent[level] >= 0]
        top[inner] = top[parent[inner]]
    alive = np.ones(n, bool)
    while alive.any():
        rows = np.flatnonzero(alive & (2 * weight > weight[top]))
        rows = rows[np.lexsort((weight[rows], top[rows]))]
        centroids = rows[np.append(True, top[rows][1:] != top[rows][:-1])]
        is_centroid = np.zeros(n, bool)
        is_centroid[centroids] = True
        now = top.copy()
        for level in levels:
            inner = level[alive[level] & (parent[level] >= 0)]
            p = parent[inner]
            cut = is_centroid[p]
            now[inner] = np.where(cut, inner, np.where(is_centroid[inner], top[inner], now[p]))
        below = np.flatnonzero(alive & ((now != top) | is_centroid))
        totals = np.zeros_like(values)
        np.add.at(totals, top[below], values[below])
        at, added, less = centroids, totals[top[centroids]], weight[centroids]
        while len(at):
            sums[at] += added
            weight[at] -= less
            on = parent[at] >= 0
            at, added, less = parent[at][on], added[on], less[on]
        parent[(parent >= 0) & is_centroid[parent]] = -1
        alive[centroids] = False
        top = now
    return sums


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All components of a task; a component's top has its own name as component."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    column = lambda c: table[c].to_numpy()
    conv, depth = column("conv_id"), column("depth")
    is_top = (conv == column("top")) & (depth == column("top_depth"))
    place = {name: i for i, name in enumerate(zip(depth.tolist(), conv.tolist()))}
    parents = zip((depth - 1).tolist(), table["parent"].to_pylist())
    parent = np.array([-1 if at_top else place[up] for at_top, up in zip(is_top.tolist(), parents)], np.int64)
    sums = local_rollup(parent, depth, column("weight"), np.stack([column("leaf"), column("saved")], axis=1))
    out = [table["conv_id"], table["depth"], pa.array(column("n_leaves") + sums[:, 0]), pa.array(column("saved_tokens") + sums[:, 1])]
    yield from pa.table(out, ["conv_id", "depth", "n_leaves", "saved_tokens"]).to_batches(max_chunksize=65_536)


def centroid_rollup(nodes: DataFrame, paths: DataFrame, component: int = COMPONENT) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of written nodes with leaf and saved: sums over their subtrees."""
    spark = nodes.sparkSession
    zero = F.lit(0).cast("long")
    state = nodes.select("conv_id", "depth", "parent", "weight", "leaf", "saved", "top", zero.alias("top_depth"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    done, ready = [], []
    name = ["top", "top_depth"]
    while True:
        sizes = staged(state.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("whole")), "trie-sizes")
        large = sizes.where(F.col("n") > component)
        if large.isEmpty():
            ready.append(state)
            break
        large = small(large.select(*name, "whole"))
        ready.append(state.join(large, name, "left_anti"))
        open_ = state.join(large, name)
        centroids = open_.where(F.col("weight") * 2 > F.col("whole")).groupBy(*name).agg(F.min(F.struct("weight", "conv_id", "depth")).alias("c"))
        centroids = staged(centroids.select(*name, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "trie-centroids")
        step = paths.select(F.col("member").alias("conv_id"), (F.col("depth") - 1).alias("c_depth"), F.col("conv_id").alias("x_conv"), F.col("parent").alias("x_parent"))
        told = open_.drop("whole").join(small(centroids), name).join(step, ["conv_id", "c_depth"], "left")
        under = (F.col("depth") > F.col("c_depth")) & (F.col("x_parent") == F.col("c_conv"))
        is_c = (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv"))
        told = staged(told.withColumn("under", F.coalesce(under, F.lit(False))).withColumn("is_c", is_c), "trie-told")
        totals = told.where("under OR is_c").groupBy(*name).agg(F.sum("leaf").alias("c_leaf"), F.sum("saved").alias("c_saved"))
        climbed = centroids.join(totals, name)
        route = paths.select("member", F.col("depth").alias("at"), F.col("conv_id").alias("at_conv"))
        climbed = climbed.join(route, (F.col("member") == F.col("c_conv")) & F.col("at").between(F.col("top_depth"), F.col("c_depth")))
        climbed = climbed.select(F.col("at_conv").alias("conv_id"), F.col("at").alias("depth"), "c_leaf", "c_saved", F.col("c_weight").alias("less"))
        moved = told.drop("c_weight").join(climbed, ["conv_id", "depth"], "left")
        leaves, saved = (F.col(c) + F.coalesce(x, zero) for c, x in (("n_leaves", "c_leaf"), ("saved_tokens", "c_saved")))
        moved = moved.select(
            "conv_id", "depth", "parent", (F.col("weight") - F.coalesce("less", zero)).alias("weight"), "leaf", "saved",
            F.when(F.col("under"), F.col("x_conv")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            leaves.alias("n_leaves"), saved.alias("saved_tokens"), "is_c",
        )
        moved = staged(moved, "trie-state")
        done.append(moved.where("is_c").select("conv_id", "depth", "n_leaves", "saved_tokens"))
        state = moved.where("NOT is_c").drop("is_c")
        discard(told)
    rest = ready[0]
    for r in ready[1:]:
        rest = rest.unionByName(r)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() / NODES_PER_TASK))
    out = rest.repartition(tasks, *name).mapInArrow(_finish, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for d in done:
        out = out.union(d)
    return out


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which come in order; a chunk at a time is held."""
    now, state, out = None, None, []
    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
            if (conv, depth) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (conv, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), r)) for r in out])
            out = []
    if now:
        out.append((*now, state.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), r)) for r in out])


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the ascending members that end at the node.

    The hash of a list is sequential by its nature; it is fed chunks of at most chunk ids, which are
    sorted and joined apart from each other.
    """
    parts = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / chunk).alias("k")).agg(F.array_sort(F.collect_list("member")).alias("ids"))
    parts = parts.select("conv_id", "depth", "k", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "k").mapInArrow(_hash_chunks, "conv_id long, depth long, ends_sha256 string")


def prefix_rollup(conversations: DataFrame, component: int = COMPONENT, chunk: int = CHUNK) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = staged(own_turns(conversations), "trie-turns")
    nodes, paths, ends = trie_nodes(own)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = staged(whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-nodes")
    sums = centroid_rollup(nodes, paths, component)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(sums, ["conv_id", "depth"]).join(end_digests(ends, chunk), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
