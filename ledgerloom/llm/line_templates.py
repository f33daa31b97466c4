r"""Line dedup with a fixed-depth template tree.

Every line (split at \n) is trimmed, white space in it becomes single spaces, and its variable
fields, tokens with a digit, become <*>. The tree's leaves are (token count, first DEPTH tokens). Equal masked lines are one variant. Where a
leaf holds several variants, a token past the leading ones is a constant of the leaf if at least
min_docs documents hold a variant with it at that place, else a variable field. A variant whose
constants make up at least `alike` of the tokens past the leading ones gets its template from
them, others keep their masked line. A template found in at least min_docs documents is recurring,
and its lines are dropped, all of them or, with keep_first, all but the one of the least doc_id
and line. A document counts once, however many variants of a template it holds.

The tree needs no order of arrival: what a token is depends on counts over all documents only.
With a min_docs of 1 to 3 a variant held by fewer documents is held by its least and its greatest one
alone, so these two tell, for every token and template, the distinct documents of all its variants
up to min_docs, and no document is looked up again. With a greater one, the variants that fewer documents hold
are looked up again for all of them, at most min_docs - 1 each.

Blank lines are kept and never counted. Lines of at most DEPTH tokens are matched whole, whatever
their length. Null texts stay null, empty ones empty; rows with a null doc_id are not counted and
stay as they are; repeated rows share their doc_id's lines and lose the same ones; doc_id is taken
to name one text; other columns are left out. An empty table gives an empty result. Variants and
templates are told apart by 128 bits of hashes. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, small, staged

DEPTH = 3
MIN_DOCS = 3
ALIKE = 0.6
FIELD = "<*>"
#: What tells by which documents a variant is held.
HELD = ("docs", "least", "greatest", "holders")
#: Rows of two 64-bit hashes that may be broadcast after they were counted.
BROADCAST_KEYS = 1_000_000
#: What lines that stay as they are don't hold.
TO_CHANGE = r"[0-9\x09\x0B-\x0D]|  "
WHITE, WITH_DIGIT = r"[\x20\x09-\x0D]+", r"[^\x20]*[0-9][^\x20]*"


def _hashes(line: Column, *names: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), line).alias(name) for seed, name in enumerate(names)]


def masked_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, masked) of every line that isn't blank, of rows with a doc_id."""
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.btrim("line", F.lit(" \t\r\x0b\x0c")).alias("line")).where("line <> ''")
    changed = F.regexp_replace(F.regexp_replace("line", WHITE, " "), WITH_DIGIT, FIELD)
    return lines.select("doc_id", "line_no", F.when(F.col("line").rlike(TO_CHANGE), changed).otherwise(F.col("line")).alias("masked"))


def _held_by_enough(rows: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """The keys of rows (keys, docs, least, greatest: of one variant) whose variants at least min_docs documents hold."""
    holders = F.col("holders") if "holders" in rows.columns else F.array("least", "greatest")
    each = rows.select(*keys, "docs", F.explode(holders).alias("doc"))
    each = each.groupBy(*keys, "doc").agg(F.max("docs").alias("docs"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("docs").alias("most")).where((F.col("n") >= min_docs) | (F.col("most") >= min_docs)).select(*keys)


def line_variants(slim: DataFrame) -> DataFrame:
    """(v1, v2, leaf, n, docs, least, greatest): each variant's documents, every one counted once, however hot the variant."""
    once = slim.groupBy("v1", "v2", "doc_id").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"))
    return once.groupBy("v1", "v2").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))


def with_holders(variants: DataFrame, slim: DataFrame, min_docs: int) -> DataFrame:
    """variants with holders: all documents of those that fewer than min_docs hold, one of any other."""
    few = variants.where(F.col("docs") < min_docs).select("v1", "v2")
    all_of = slim.select("v1", "v2", "doc_id").join(few, ["v1", "v2"]).groupBy("v1", "v2").agg(F.collect_set("doc_id").alias("holders"))
    return variants.join(all_of, ["v1", "v2"], "left").withColumn("holders", F.coalesce("holders", F.array("least")))


def line_templates(slim: DataFrame, mixed: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """(v1, v2, t1, t2, docs, least, greatest) of the variants of mixed leaves whose constants make a template."""
    keys = small(mixed.select("v1", "v2"), BROADCAST_KEYS)
    texts = slim.select("v1", "v2", "masked").join(keys, ["v1", "v2"], "left_semi").dropDuplicates(["v1", "v2"])
    held = [c for c in mixed.columns if c in HELD]
    tokens = mixed.join(texts, ["v1", "v2"]).select("leaf", "v1", "v2", *held, F.posexplode(F.split("masked", " ")).alias("place", "token"))
    tokens = staged(tokens, "line-tokens")
    place = ["leaf", "place", "token"]
    constants = _held_by_enough(tokens.where((F.col("place") >= DEPTH) & (F.col("token") != FIELD)), place, min_docs).withColumn("constant", F.lit(True))
    late = F.col("place") >= DEPTH
    kept = tokens.select("v1", "v2", *place).join(constants, place, "left").select("v1", "v2", "place", "constant", F.when(~late | F.col("constant"), F.col("token")).otherwise(F.lit(FIELD)).alias("kept"))
    made = kept.groupBy("v1", "v2").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kept"))), lambda x: x.kept), " ").alias("line"),
        F.count(F.when(late & F.col("constant"), 1)).alias("constants"),
        F.count(F.when(late, 1)).alias("rest"),
    )
    made = made.where((F.col("constants") > 0) & (F.col("constants") >= alike * F.col("rest"))).select("v1", "v2", *_hashes(F.col("line"), "t1", "t2"))
    return mixed.select("v1", "v2", *held).join(made, ["v1", "v2"])


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """(doc_id, line_no, t1, t2): the lines of recurring templates and the template's hashes."""
    if min_docs < 1:
        raise ValueError("min_docs must be at least 1")
    lines = masked_lines(docs, doc_id, text)
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf")
    slim = staged(lines.withColumn("n", n).select("doc_id", "line_no", "masked", *_hashes(F.col("masked"), "v1", "v2"), "n", leaf), "lines")
    variants = staged(line_variants(slim), "line-variants")

    # leaves in which variants can make a template together; the sum is never less than the documents
    leaves = variants.where(F.col("n") > DEPTH).groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("docs").alias("all")).where((F.col("kinds") > 1) & (F.col("all") >= min_docs))
    mixed = variants.where(F.col("n") > DEPTH).join(leaves.select("leaf"), "leaf")
    mixed = staged(mixed if min_docs <= 3 else with_holders(mixed, slim, min_docs), "line-mixed")
    templates = staged(line_templates(slim, mixed, min_docs, alike), "line-templates")

    # a variant without a template stands for itself, and then recurs by its own count
    itself = variants.where(F.col("docs") >= min_docs).join(templates.select("v1", "v2"), ["v1", "v2"], "left_anti")
    itself = itself.select("v1", "v2", F.col("v1").alias("t1"), F.col("v2").alias("t2"))
    often = _held_by_enough(templates, ["t1", "t2"], min_docs)
    recurring = staged(itself.unionByName(templates.join(often, ["t1", "t2"]).select("v1", "v2", "t1", "t2")), "line-recurring")
    found = slim.select("doc_id", "line_no", "v1", "v2").join(small(recurring, BROADCAST_KEYS), ["v1", "v2"])
    found = staged(found.select("doc_id", "line_no", "t1", "t2"), "line-found")
    discard(slim, variants, mixed, templates, recurring)
    return found


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_first: bool = False, **more) -> DataFrame:
    """docs (doc_id, text) without the lines dropped, and n_lines, n_dropped int."""
    found = recurring_lines(docs, doc_id, text, **more)
    dropped = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped"))
    if keep_first:
        firsts = found.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "line_no")).alias("first")).select("first.doc_id", F.col("first.line_no").alias("kept"))
        both = found.select("doc_id", "line_no", F.lit(None).cast("int").alias("kept")).union(firsts.select("doc_id", F.lit(None).cast("int"), "kept"))
        dropped = both.groupBy("doc_id").agg(F.array_except(F.collect_set("line_no"), F.collect_set("kept")).alias("dropped"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(dropped, "doc_id", "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    left = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    n_lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0))
    return rows.select("doc_id", F.when(F.size("dropped") > 0, left).otherwise(F.col("text")).alias("text"), n_lines.alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(n_dropped).alias("n_dropped"))
