"""Names by a lexicon: whole, word by word, by the entries inside a word, and else letter by letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.narration import odd_name, plain_letters
from ledgerloom.functions.script import romanised

#: The address after a name, in script and in Latin letters; it is no part of the name.
ADDRESS = ("గారూ", "గారు")
ADDRESS_SPELLINGS = ("garu", "garū", "gaaru", "gaarū")
UNKNOWN = "Unknown Person"


def plain_name(c: Column) -> Column:
    """Without address, dashes as spaces, single spaces."""
    for a in ADDRESS:
        c = F.replace(c, F.lit(a), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[-—]", " "), r"\s+", " "))


def _entries(lexicon: DataFrame) -> DataFrame:
    """One target for each source: the least, where a source has several."""
    return lexicon.where("source IS NOT NULL AND source <> '' AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))


def replace_inside(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, replaced) of the distinct words: lexicon entries inside a word give way to their targets, leftmost first, the longest at a place.

    Every piece of a word that has the length of some entry is joined with the lexicon, so neither is searched through and
    neither is broadcast. An entry that is the whole word doesn't count; what a target brings in is not searched again.
    """
    known = _entries(lexicon)
    lengths = known.select(F.length("source").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    sizes = lengths.first()["lengths"]
    distinct = words.where(F.col(word).isNotNull()).select(F.col(word).alias("_word")).distinct()
    if not sizes:
        return distinct.select(F.col("_word").alias(word), F.col("_word").alias("replaced"))
    most = F.length("_word")
    starts = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: (i + n - 1 <= most) & (n < most)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    cut = distinct.select("_word", F.explode(pieces).alias("p")).select("_word", "p.at", "p.n", F.expr("substring(_word, p.at, p.n)").alias("source"))
    hits = cut.join(known, "source").groupBy("_word").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "target"))).alias("hits"))
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("done"))

    def take(so_far: Column, hit: Column) -> Column:
        between = F.substring("_word", so_far["next"], hit["at"] - so_far["next"])
        taken = F.struct((hit["at"] - hit["less"]).alias("next"), F.concat(so_far["done"], between, hit["target"]).alias("done"))
        return F.when(hit["at"] >= so_far["next"], taken).otherwise(so_far)

    folded = hits.select("_word", F.aggregate("hits", start, take, lambda s: F.concat(s["done"], F.substring("_word", s["next"], F.length("_word")))).alias("replaced"))
    return distinct.join(folded, "_word", "left").select(F.col("_word").alias(word), F.coalesce("replaced", "_word").alias("replaced"))


def spell_names(names: DataFrame, lexicon: DataFrame, name: str = "raw_name") -> DataFrame:
    """names with spelled (plain Latin letters, capital initials) and flagged (to be looked at).

    The whole name is looked up first, then each word; in a word the lexicon lacks, entries inside it are replaced, and
    what is left of another script is written in Latin letters, after the word's Latin ones. Such names are flagged, and
    those with letters or words that odd_name() marks. Missing names are UNKNOWN.
    """
    known = _entries(lexicon)
    plain = names.withColumn("_plain", F.nullif(plain_name(F.col(name)), F.lit("")))
    each = plain.where("_plain IS NOT NULL").select("_plain").distinct()
    words = each.select("_plain", F.posexplode(F.split("_plain", " ")).alias("_at", "word"))
    looked = words.join(known.select(F.col("source").alias("word"), "target"), "word", "left")
    inside = replace_inside(looked.where("target IS NULL"), lexicon)
    foreign = F.regexp_replace("replaced", r"[\x00-\x7F]", "")
    spelled = F.when(foreign == "", F.col("replaced")).otherwise(F.trim(F.concat_ws(" ", F.regexp_replace("replaced", r"[^\x00-\x7F]", ""), romanised(foreign))))
    inside = inside.select("word", spelled.alias("_letters"), (foreign != "").alias("_foreign"))
    both = looked.join(inside, "word", "left").withColumn("_said", F.coalesce("target", "_letters"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_said"))), lambda x: x._said), " ")
    by_words = both.groupBy("_plain").agg(joined.alias("_words"), F.bool_or(F.coalesce("_foreign", F.lit(False))).alias("_foreign"))
    by_words = by_words.withColumn("_words", F.trim(F.regexp_replace("_words", r"(?iU)\b(" + "|".join(ADDRESS_SPELLINGS) + r")\b", "")))
    whole = known.select(F.col("source").alias("_plain"), F.col("target").alias("_whole"))
    out = plain.join(by_words, "_plain", "left").join(whole, "_plain", "left")
    text = F.coalesce("_whole", "_words")
    spelled = F.when(F.col("_whole").isNotNull(), plain_letters(F.col("_whole"))).otherwise(F.initcap(F.trim(F.regexp_replace(plain_letters(F.col("_words")), r"\s+", " "))))
    flagged = odd_name(text) | (F.col("_whole").isNull() & F.coalesce("_foreign", F.lit(False)))
    return out.withColumn("spelled", F.coalesce(spelled, F.lit(UNKNOWN))).withColumn("flagged", F.coalesce(flagged, F.lit(False))).drop("_plain", "_words", "_foreign", "_whole")
