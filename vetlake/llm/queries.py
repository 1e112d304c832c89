"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them.

Each query gets its rows through its operator and derives the digest columns from the operator's own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_quality, decontaminate, filter_audit, licences, packing, quality_rules, secret_scan, sharding, spelling, substring_dedup, tokens, toxicity
from .folds import held_out
from .jaccard_join import ngram_jaccard_join


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    rows = attention_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    rows = rows.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", decontaminate.contaminated(F.col("n_hit"), F.col("n_words")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    rows = tokens.token_files(_table(spark, sf_dir, "documents"), end=2)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files: source / language / doc_id; short ones that name a licence are licence files."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), "text")
    rows = licences.scan(files, is_licence_file=F.octet_length("text") < 2000)
    return rows.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "own_licence", F.round("similarity", 6).alias("similarity"), "licence", "licence_dir")


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document: measurements, base_failed, kept, and the bits of failed rules."""
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates: doc_id, n_shingles, component_id."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    rows = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = packing.pack(_table(spark, sf_dir, "documents"), end=1)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share: other_id's and doc_id's word ranges, with other_id < doc_id."""
    rows = substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("b").alias("doc_id"), F.col("begin_b").alias("begin"), F.col("end_b").alias("end"), F.col("a").alias("other_id"), F.col("begin_a").alias("other_begin"), F.col("end_a").alias("other_end"), "n_equal", "n_columns")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over all documents, for each source: what each step keeps, removes and loses."""
    rows = filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda x: x.getField("rank") == rank)).cast("long")
    base = F.filter("spans", lambda x: x.getField("rank") < secret_scan.BASE)
    counts = [count(i).alias(f"n_{secret_scan.RULES[i].kind}") for i in range(secret_scan.BASE)]
    return rows.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and the forms they vary: word, form, root, n, n_near, form_n."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    every = (op1_attention_quality, op2_prefix_decontamination, op3_token_files, op4_licence_scan, op5_sampled_splitters, op6_rule_ledger, op7_ngram_jaccard, op8_kneser_ney_toxicity, op9_hierarchical_packing, op10_chained_passages, op11_filter_audit, op12_secret_scan, op13_spelling_variants)
    return {f.__name__: f for f in every}


#: A-Z to a-z, as the contracts lower-case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM ds),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM s),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_bangs, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (10 * n_dup_lines > 6 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
    + 32 * (2 * n_bangs > n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, least(len(w), 5) AS n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM x),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * o.n >= 80 * (u.n + v.n - o.n)),
t AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, m.b) AS component_id
FROM d LEFT JOIN z ON d.doc_id = z.doc_id JOIN (SELECT a, min(b) AS b FROM c GROUP BY a) m ON m.a = d.doc_id
"""


_OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS bits
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
o(filter_order, mask) AS (SELECT '', 0 UNION ALL SELECT filter_order || chr(65 + i::INT), mask | (1 << i)::INT FROM o, range(5) r(i) WHERE mask & (1 << i)::INT = 0),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS name, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::INT AS before FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
t AS (SELECT filter_order, step, name, bit::INT AS bit, coalesce(before, 0) AS before FROM s),
g AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, bits),
r AS (SELECT part, filter_order, step, name,
    sum(CASE WHEN bits & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN bits & before <> 0 AND bits & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bits & before = 0 AND bits & bit <> 0 THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM r
"""


#: kind, rank, pattern, and the pattern's group and its least length, as op12 lists its kinds.
_OP12_KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35,}", 0, 0),
    ("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("bearer", r"[Bb][Ee][Aa][Rr][Ee][Rr]\x20+[A-Za-z0-9._~+/-]{16,}", 0, 0),
    ("url", r"://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{3,64}@", 0, 0),
]


def _op12() -> str:
    found = []
    for rank, (kind, pattern, group, least) in enumerate(_OP12_KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        found.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(m) + 1)) AS i, m, v, g, {least} AS least FROM "
            f"(SELECT doc_id, regexp_extract_all(text, {quoted}) AS m, regexp_extract_all(text, {quoted}, {group}) AS v, regexp_split_to_array(text, {quoted}) AS g FROM d)"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(found)}),
p AS (SELECT doc_id, kind, rank, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM s WHERE length(v[i]) >= least),
q AS (SELECT doc_id, kind, rank, a::BIGINT AS a, (a + n)::BIGINT AS b FROM p),
r AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3), '') AS base,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex FROM q GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


#: crc32 over code points up to U+00FF as UTF-8, by its table; words a deletion apart, or alike after one deletion each at the same place.
_OP13 = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT doc_id, run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, c.word AS other, c.n AS m FROM x a JOIN x c ON a.cut = c.cut AND a.i = c.i AND a.word <> c.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.cut = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.cut = v.word),
g AS (SELECT word, count(*) AS n_near, max(m) AS form_n, arg_min(other, (-m, other)) AS form FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM v LEFT JOIN g ON v.word = g.word),
c AS (SELECT word, word AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.root AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express: models, tokenizers, samples and alignments are tested otherwise."""
    return {"op2_prefix_decontamination": _OP2, "op6_rule_ledger": _OP6, "op7_ngram_jaccard": _OP7, "op11_filter_audit": _OP11, "op12_secret_scan": _op12(), "op13_spelling_variants": _OP13}
