"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.llm import ball_codes, coordinate_join, decontaminate, html_text, importance, mixing, ngram_join, private_spans, quality_model, quality_rules, sharding, substring, token_store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1."""
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


WORDS_SQL = r"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)"""

RULES_SQL = "WITH" + WORDS_SQL + r""",
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
l AS (SELECT *, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM w),
m AS (SELECT l.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(regexp_extract_all(t, '!!')) AS shouts, len(regexp_extract_all(t, '\p{Lu}')) AS upper, len(regexp_extract_all(t, '\p{L}')) AS letters,
  len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS stutter FROM l LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (word_chars > 20::DOUBLE * n_words OR n_symbols > 0.1::DOUBLE * n_words
  OR shouts > 0.2::DOUBLE * n_words OR upper > 0.6::DOUBLE * letters OR n_dup_lines > 0.4::DOUBLE * n_lines OR stutter > 0.2::DOUBLE * n_words) AS kept FROM b"""

REPEATS_SQL = "WITH" + WORDS_SQL + r""",
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) > 34)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM again, (SELECT unnest(range(35)) AS k)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS s FROM p ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

LINKS_SQL = "WITH RECURSIVE" + WORDS_SQL + r""",
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)
  UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.t = y.t AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT d.doc_id, class_id, (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links, (count(*) OVER (PARTITION BY t)) - 1 AS n_copies FROM d JOIN class USING (doc_id)"""


@query(RULES_SQL)
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and the verdict of the cascade for every document."""
    docs = quality_rules.measure(table(spark, sf, "documents").select("doc_id", "text"))
    failed = quality_rules.base_failed(F.col("q_n_words"), F.col("q_n_repeat_words"))
    return (docs.select(
        "doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"), F.col("q_n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & F.col("rejected_by").isNull()).alias("kept")))


@query(LINKS_SQL)
def op5_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Near-copy class and number of links of every document."""
    return ngram_join.jaccard_classes(table(spark, sf, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query()
def op6_shuffle_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written to sixteen shards and read back."""
    out = sharding.shard_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", sharding.row_size(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
                      F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), 17).cast("int").alias("grown_shard"))


@query(REPEATS_SQL)
def op7_remove_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the words of 35-word windows that occur more than once."""
    return substring.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a benchmark item, one row for each such pair."""
    out = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", "n_covered", "n_item", "changed")


@query()
def op4_token_store(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as ids in raw files, read back through the perfect hash index."""
    import public_tokenizers
    out = token_store.token_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op1_extract_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf, "pages"))


@query()
def op9_private_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document."""
    return private_spans.find_private(table(spark, sf, "documents"))


@query()
def op10_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def codes_sql(rounds: int = 4) -> str:
    """Each round is an assignment by full search and a floored mean."""
    ctes = [r"""kept AS (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
            "p AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS v FROM kept, (VALUES (0), (1), (2), (3)) AS t(p))",
            "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM p QUALIFY e < 256)"]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, p, v, min(CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)]) AS BIGINT) * 256 + e) AS best
  FROM p JOIN b{k} USING (p) GROUP BY ALL)""")
        if k < rounds:
            ctes.append(f"""s{k} AS (SELECT p, best % 256 AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT p, best, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT p, e, list(m ORDER BY i) AS m FROM s{k} GROUP BY ALL)""")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))")
    return "WITH " + ",\n".join(ctes) + f""",
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, d"""


@query(codes_sql())
def op11_ball_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all vectors under codebooks fitted by ball k-means."""
    return ball_codes.encode(table(spark, sf, "embeddings"))


#: crc32 of every different word, byte by byte; a byte's step is made of eight one-bit steps.
RESAMPLE_SQL = r"""
WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS i))),
w AS (SELECT doc_id, NULL AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM w) GROUP BY ALL),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM f)),
c AS MATERIALIZED (SELECT w, xor(list_reduce([4294967295] || [CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT) FOR k IN range(length(x) // 2)],
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM h, steps),
b AS MATERIALIZED (SELECT b, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (doc_id IS NULL), 0) AS t FROM f JOIN c USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM b) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM b) + 10000) AS DOUBLE))) AS BIGINT) AS g FROM b),
m AS (SELECT doc_id, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM f JOIN c USING (w) JOIN g USING (b) WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(len(w), 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (doc_id) WHERE doc_id IS NOT NULL),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= 20 QUALIFY rank <= (SELECT count(*) FROM s WHERE n_features >= 20) * 10 // 100)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, rank FROM s LEFT JOIN r USING (doc_id)"""


@query(RESAMPLE_SQL)
def op12_resample(spark: SparkSession, sf: str) -> DataFrame:
    """All documents weighed by likeness to the benchmark, a tenth of those with 20 words drawn."""
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM class LEFT JOIN n USING (doc_id)"""


@query(NEAR_SQL)
def op13_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return coordinate_join.near_components(table(spark, sf, "documents"))
