"""The registered queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, decontaminate, ego_join, filter_audit, licenses, line_templates, mixing, ngram_join, prefix_trie, quality_forest, sharding, toxicity, warc
from ledgerloom.llm.common import scratch_path

N_SHARDS = 40
TARGET_ENTROPY, MAX_REPEATS = 0.95, 4.0
#: Only A-Z in lower case, null as empty.
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts hold the template's control strings."""
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.format_digests(chat_format.render(chat_format.fold_events(chat_format.conversation_events(rows))))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("text_crc32"))
    placed = sharding.interleave_shards(rows, N_SHARDS, key=["doc_id", "text_crc32", "size"], n_rows=docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.training_labels(_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "gain")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, target_entropy=TARGET_ENTROPY, max_repeats=MAX_REPEATS)
    rounded = [F.round(c, 9).alias(c) for c in ("weight", "repeats")]
    return mixing.block_slots(mixed.select("doc_id", "source", "n_tokens", *rounded, "epoch"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join("item_ids", ",").alias("item_ids"), F.round("similarity", 6).alias("similarity"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_rollup(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_forest.judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def _license_sql() -> str:
    """Base phrases word by word and every window against every template, without filters."""
    split = lambda x: x.split(" ")
    templates = ", ".join(f"('{label}', {length}, [{', '.join(repr(w) for w in sorted(tokens))}])" for label, length, tokens in licenses.template_sets(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', {split(p)!r})" for p, label in licenses.BASE_PHRASES.items())
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{licenses.WORD}') AS w FROM documents),
templates(label, size, tokens) AS (VALUES {templates}),
phrases(label, p) AS (VALUES {phrases}),
likely AS (SELECT * FROM words WHERE len(list_intersect(w, ['license', 'licensed', 'cc', 'reserved', 'free', 'software', 'provided', 'mpl', 'source', 'gnu', 'apache', 'redistribution', 'public', 'warranty'])) > 0),
starts AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM likely),
runs AS (SELECT *, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4 FROM starts WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT doc_id, label, i FROM runs JOIN phrases ON x = p[1] AND x2 = p[2] AND x3 = p[3] AND (len(p) = 3 OR x4 = p[4])),
base AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
held AS (SELECT label, size, tokens, unnest(tokens) AS x FROM templates),
marks AS (SELECT doc_id, label, size, tokens, x, unnest([i // size, i // size - 1]) AS k FROM starts JOIN held USING (x)),
shares AS (SELECT doc_id, label, max(share) AS share FROM (SELECT doc_id, label, count(DISTINCT x) / len(tokens) AS share FROM marks WHERE k >= 0 GROUP BY doc_id, label, size, tokens, k) GROUP BY doc_id, label),
met AS (SELECT doc_id, label, share FROM shares WHERE share >= {licenses.THRESHOLD} - 1e-9),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM met) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT x.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM words x LEFT JOIN base ON base.doc_id = x.doc_id LEFT JOIN labels ON labels.doc_id = x.doc_id LEFT JOIN best ON best.doc_id = x.doc_id"""


def _signed(text: str) -> str:
    """SQL of common.portable_hash over '|'-joined texts."""
    top = f"CAST(CAST('0x' || substr(md5({text}), 1, 16) AS UBIGINT) AS HUGEINT)"
    return f"({top} - CASE WHEN {top} >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)"


ID = "coalesce(CAST(doc_id AS VARCHAR), '')"


def _mixing_sql() -> str:
    """The same repeated section and cut, over the list of the sources' logarithmic shares."""
    point = f"lo + (hi - lo) * CAST(i AS DOUBLE) / {mixing.SECTIONS}"
    total = lambda inner: f"list_sum(list_transform(lps, lambda l: {inner}))"
    z, e = total(f"exp(({point}) * l)"), total(f"exp(({point}) * l) * l")
    measure = f"CASE kind WHEN 'entropy' THEN ln({z}) - ({point}) * {e} / {z} ELSE exp((1 - ({point})) * (top - low)) END"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS stratum, CAST(greatest(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')), 1) AS BIGINT) AS n FROM documents),
totals AS (SELECT stratum, sum(n) AS tokens FROM docs GROUP BY stratum),
logs AS (SELECT stratum, tokens, ln(CAST(tokens AS DOUBLE) / CAST((SELECT sum(tokens) FROM totals) AS DOUBLE)) AS lp FROM totals),
stats AS (SELECT list(lp ORDER BY stratum) AS lps, max(lp) AS top, min(lp) AS low, count(*) AS k, -sum(exp(lp) * lp) AS entropy FROM logs),
search(kind, step, lo, hi, done, wanted, lps, top, low) AS (
  SELECT kind, 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), kind = 'entropy' AND entropy >= {TARGET_ENTROPY} * ln(k), CASE kind WHEN 'entropy' THEN {TARGET_ENTROPY} * ln(k) ELSE {MAX_REPEATS} END, lps, top, low
  FROM stats, (VALUES ('entropy'), ('repeats')) t(kind) WHERE k > 1
  UNION ALL
  SELECT kind, step + 1, CASE WHEN g IS NULL THEN hi WHEN g = 0 THEN lo ELSE lo + (hi - lo) * CAST(g - 1 AS DOUBLE) / {mixing.SECTIONS} END,
    CASE WHEN g IS NULL THEN hi WHEN g = 0 THEN lo ELSE lo + (hi - lo) * CAST(g AS DOUBLE) / {mixing.SECTIONS} END, g IS NULL OR g = 0, wanted, lps, top, low
  FROM (SELECT *, list_filter(range({mixing.SECTIONS + 1}), lambda i: {measure} <= wanted)[1] AS g FROM search WHERE step < {mixing.STEPS} AND NOT done)),
reached AS (SELECT coalesce(max(hi), 0.0) AS a FROM (SELECT kind, arg_max(hi, step) AS hi FROM search GROUP BY kind)),
weighed AS (SELECT stratum, tokens, exp(a * lp) / (SELECT sum(exp(a * lp)) FROM logs, reached) AS weight, (SELECT max(tokens) / exp(any_value(a) * ln(max(tokens) / CAST(sum(tokens) AS DOUBLE))) FROM logs, reached) * (SELECT sum(exp(a * lp)) FROM logs, reached) AS spent FROM logs, reached),
shared AS (SELECT stratum, tokens, weight, weight * spent / tokens AS share, CAST(floor(weight * spent / tokens + 1e-9) AS INTEGER) AS passes FROM weighed),
plan AS (SELECT *, greatest(floor((share - passes) * tokens + 1e-6), 0) AS rest FROM shared),
cut AS (SELECT doc_id, source, stratum, n, weight, share, passes, rest, sum(n) OVER (PARTITION BY stratum ORDER BY {_signed(f"concat_ws('|', {mixing.SEED}, passes, {ID})")}, doc_id NULLS FIRST) AS upto FROM docs JOIN plan USING (stratum)),
blocks AS (SELECT *, unnest(range(passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS e FROM cut)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight, round(share, 9) AS repeats, CAST(e AS INTEGER) AS epoch,
  row_number() OVER (PARTITION BY stratum, e ORDER BY {_signed(f"concat_ws('|', {mixing.SEED}, e, {ID})")}, doc_id NULLS FIRST) - 1 AS slot FROM blocks"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLE = {
    "op1_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(role) + 2 * (length(role) - length(replace(role, '%', ''))) + 2 * (length(role) - length(replace(role, chr(10), '')))
      + len(regexp_extract_all(role, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 24 AS chars FROM rows),
said AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(chars) AS chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM said""",
    "op2_sharding": rf"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, source, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
sized AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS stratum, CAST(len(b) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, steps),
shuffled AS (SELECT *, {_signed(f"concat_ws('|', {sharding.SEED}, {ID}, text_crc32, size)")} AS h FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS r, count(*) OVER (PARTITION BY stratum) AS own, count(*) OVER () AS n FROM shuffled),
placed AS (SELECT *, row_number() OVER (ORDER BY (CAST(r AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(own AS DOUBLE), h, stratum) - 1 AS p FROM ranked)
SELECT doc_id, size, text_crc32, '{sharding.LAW}' AS law, CAST(p * {N_SHARDS} // n AS INTEGER) AS shard, CAST(p - ((p * {N_SHARDS} // n) * n + {N_SHARDS - 1}) // {N_SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id""",
    "op4_license_scan": _license_sql(),
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS least, list_transform(range(4), lambda k: CAST('0x' || substr(hex, 10 * k + 1, 10) AS BIGINT)) AS parts FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, CASE WHEN page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to, url,
  array_to_string(flatten(list_transform(parts, lambda v: list_transform(range(8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> CAST(35 - 5 * j AS INTEGER)) & 31) + 1, 1)))), '') AS payload_digest FROM d""",
    "op7_mixing": _mixing_sql(),
    "op8_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
masked AS (
  SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]*[0-9][^ ]*', '{line_templates.FIELD}', 'g') AS m
  FROM (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM lines) WHERE line <> ''),
held AS (SELECT DISTINCT doc_id, m FROM masked),
variants AS (SELECT m, len(w) AS n, string_split(m, ' ')[1:{line_templates.DEPTH}] AS lead, w FROM (SELECT m, string_split(m, ' ') AS w FROM (SELECT DISTINCT m FROM held))),
mixed AS (SELECT * FROM variants JOIN (SELECT n, lead FROM variants WHERE n > {line_templates.DEPTH} GROUP BY ALL HAVING count(*) > 1) USING (n, lead)),
tokens AS (SELECT m, n, lead, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS place FROM mixed),
constants AS (
  SELECT n, lead, place, t, true AS constant FROM tokens JOIN held USING (m) WHERE place >= {line_templates.DEPTH} AND t <> '{line_templates.FIELD}'
  GROUP BY n, lead, place, t HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}),
made AS (
  SELECT m, string_agg(CASE WHEN place < {line_templates.DEPTH} OR constant THEN t ELSE '{line_templates.FIELD}' END, ' ' ORDER BY place) AS template,
    count(*) FILTER (constant) AS c, count(*) FILTER (place >= {line_templates.DEPTH}) AS rest
  FROM tokens LEFT JOIN constants USING (n, lead, place, t) GROUP BY m),
named AS (SELECT v.m, coalesce(made.template, v.m) AS template FROM variants v LEFT JOIN made ON made.m = v.m AND c > 0 AND c >= {line_templates.ALIKE} * rest),
often AS (SELECT template FROM named JOIN held USING (m) GROUP BY template HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}),
dropped AS (SELECT DISTINCT doc_id, line_no FROM masked JOIN named USING (m) JOIN often USING (template)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines ANTI JOIN dropped USING (doc_id, line_no) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(n.n, 0) AS INTEGER) AS n_dropped, CAST(length(x) AS BIGINT) AS kept_chars, sha256(x) AS kept_sha256
FROM (SELECT documents.doc_id, documents.text, CASE WHEN documents.text IS NOT NULL THEN coalesce(kept.text, '') END AS x FROM documents LEFT JOIN kept USING (doc_id)) d LEFT JOIN n USING (doc_id)""",
    "op9_decontamination": rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{licenses.WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT item_id, w, len(w) AS length, least(len(w), {decontaminate.SHINGLE}) AS span FROM (SELECT item_id, regexp_extract_all({LOWER.format('text')}, '{licenses.WORD}') AS w FROM benchmark) WHERE len(w) > 0),
theirs AS (SELECT DISTINCT item_id, length, span, unnest(list_transform(range(1, length - span + 2), lambda i: array_to_string(w[i:i + span - 1], ' '))) AS s FROM items),
spans AS (SELECT DISTINCT span FROM items),
own AS (SELECT doc_id, span, unnest(list_transform(range(1, len(w) - span + 2), lambda i: array_to_string(w[i:i + span - 1], ' '))) AS s, generate_subscripts(list_transform(range(1, len(w) - span + 2), lambda i: i), 1) AS place FROM words, spans WHERE len(w) >= span),
hits AS (SELECT * FROM own WHERE s IN (SELECT s FROM theirs)),
n AS (SELECT s, count(*) AS n FROM hits GROUP BY s),
weighed AS (SELECT item_id, length, span, theirs.s, ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(n, 0))) AS weight FROM theirs LEFT JOIN n ON n.s = theirs.s),
whole AS (SELECT item_id, sum(weight) AS whole FROM weighed GROUP BY item_id),
spots AS (SELECT DISTINCT doc_id, item_id, length, span, place, h.s, weight FROM hits h JOIN weighed w USING (s, span)),
likely AS (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, item_id, s, weight FROM spots) JOIN whole USING (item_id) GROUP BY doc_id, item_id, whole HAVING sum(weight) >= ({decontaminate.THRESHOLD} - 1e-9) * whole),
near AS (SELECT * FROM spots SEMI JOIN likely USING (doc_id, item_id)),
shares AS (
  SELECT doc_id, item_id, place, sum(weight) AS held FROM (SELECT DISTINCT a.doc_id, a.item_id, a.place, b.s, b.weight FROM near a JOIN near b USING (doc_id, item_id) WHERE b.place BETWEEN a.place AND a.place + a.length - a.span)
  GROUP BY doc_id, item_id, place),
met AS (SELECT doc_id, item_id, max(held / whole) AS share FROM shares JOIN whole USING (item_id) GROUP BY doc_id, item_id HAVING max(held / whole) >= {decontaminate.THRESHOLD} - 1e-9),
found AS (SELECT doc_id, count(*) AS k, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids, max(share) AS share FROM met GROUP BY doc_id)
SELECT d.doc_id, k IS NOT NULL AS contaminated, CAST(coalesce(k, 0) AS INTEGER) AS n_items, coalesce(ids, '') AS item_ids, round(coalesce(share, 0.0), 6) AS similarity FROM documents d LEFT JOIN found USING (doc_id)""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id""",
    "op11_prefix_trie": rf"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bytes AS (SELECT conv_id, said, conv_id - conv_id % {prefix_trie.FAMILY} AS base, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM own),
dealt AS (SELECT conv_id, said, base, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {prefix_trie.SHARED} AS h FROM bytes, steps),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(o.said[1:h], []), a.said[h + 1:]) AS said FROM dealt a LEFT JOIN own o ON o.conv_id = base),
paths AS (SELECT conv_id, unnest(range(len(said) + 1)) AS d, said FROM rebuilt),
named AS (SELECT conv_id, d, len(said) AS n, sha256(array_to_string(list_transform(said[1:d], lambda x: sha256(length(x.role) || ':' || x.role || x.text)), ',')) AS key, length(said[d].text) AS chars, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(said[1:d - 1], lambda x: sha256(length(x.role) || ':' || x.role || x.text)), ',')) END AS up FROM paths),
nodes AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * coalesce(any_value(chars), 0) AS saved, sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM named GROUP BY d, key),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, key)),
above AS (SELECT w.conv_id AS low, w.d AS low_d, m.d, m.key, w.saved, CAST(w.n_children = 0 AS BIGINT) AS leaf FROM whole w JOIN named m ON m.conv_id = w.conv_id AND m.d <= w.d),
sums AS (SELECT d, key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (d, key) LEFT JOIN nodes p ON p.d = w.d - 1 AND p.key = w.up""",
    "op12_filter_audit": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
masks AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask FROM words),
marked AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN marked ON marked.doc_id = masks.doc_id GROUP BY part, mask),
orders(name) AS (SELECT '' UNION ALL SELECT name || substr('ABCDE', CAST(i AS BIGINT), 1) FROM orders, range(1, 6) r(i) WHERE length(name) < 5 AND NOT contains(name, substr('ABCDE', CAST(i AS BIGINT), 1))),
steps AS (SELECT name, k AS step, CAST(list_sum(list_transform(string_split(name[1:k - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)) AS INTEGER) AS gone, 1 << (ascii(name[k]) - 65) AS own FROM orders, range(1, 6) r(k) WHERE length(name) = 5),
audit AS (
  SELECT part, name, step, own, sum(CASE WHEN mask & (coalesce(gone, 0) | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own > 0 AND mask & coalesce(gone, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(gone, 0) > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & coalesce(gone, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & coalesce(gone, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, name, step, own)
SELECT part, name AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM audit""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
