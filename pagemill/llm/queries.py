"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, mixing, neardup, quality, sharding, tokenout, topk, urlfilter
from .common import read, scratch, width

URL_RULES = [
    urlfilter.UrlRule("com", "/", "allow"),
    urlfilter.UrlRule("example.com", "/en/", "block"),
    urlfilter.UrlRule("www.example.com", "/en/", "allow"),
    urlfilter.UrlRule("net", "/es/", "block"),
    urlfilter.UrlRule("net", "/fr/", "block"),
]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", taken)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(langid.learnable(F.col("doc_id"), F.col("lang"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.report(docs).drop("text", "n_lines")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(100)) == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"))
    both = bpe.decode(encoded)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, but for English documents, which share one key: a key far over the limit."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "en").otherwise(F.col("doc_id").cast("string")).alias("key"))
    return sharding.shard(docs, "key", limit=SHARD_BYTES, row=F.col("doc_id")).drop("text", "key")


#: Small enough that every size of the tables needs several shards.
SHARD_BYTES = 256 << 10


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards as written and read again; ids as a digest."""
    made, total = tokenout.sequences(read(spark, sf_dir, "documents").select("doc_id", "text"))
    path = scratch(spark, "token_output")
    tokenout.write(spark, made, total, path, parts=width(spark))
    schema = "slot long, position int, doc_id long, chunk long, n_tokens int, ids binary, shard long"
    written = spark.read.schema(schema).parquet(path)
    return written.select("slot", "shard", "position", "doc_id", "chunk", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is chosen; the rejected one ends in another answer at its last assistant turn.

    Of ids divisible by 7 the rejected one is the same, of those divisible by 5 (not 7) it is missing.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id is not null")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    other = turns.join(last, "conv_id", "left").where("conv_id % 7 = 0 or (conv_id % 5 <> 0 and (last is null or turn <= last))")
    text = F.when((F.col("conv_id") % 7 != 0) & (F.col("turn") == F.col("last")), F.concat(F.lit("No. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    both = turns.withColumn("side", F.lit(True)).unionByName(other.withColumns({"text": text, "side": F.lit(False)}).drop("last"))
    both = both.withColumns({"pair": F.col("conv_id"), "conv_id": 2 * F.col("conv_id") + F.when(F.col("side"), 0).otherwise(1)})
    return chat.preference_pairs(both, F.col("pair"), F.col("side"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(read(spark, sf_dir, "documents").select("doc_id", "text"), k=2).drop("text")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR (NOT regexp_matches(t, '\p{Ll}') AND regexp_matches(t, '\p{Lu}'))) AS kept
FROM b
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)
"""

OP5_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CASE WHEN lang = 'en' THEN 'en' ELSE CAST(doc_id AS VARCHAR) END AS key,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS t FROM documents),
e AS (SELECT *, CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) AS h FROM d),
a AS (
  SELECT e.*, k, sum(n_bytes) OVER p AS b, count(*) OVER p AS r, min(h) OVER p = max(h) OVER p AS alone
  FROM e, range(0, 61) t(k) WINDOW p AS (PARTITION BY k, h >> (60 - k))),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth FROM a WHERE b <= 262144 OR alone),
f AS (SELECT *, substr(lpad(to_binary(h), 60, '0'), 1, CAST(k AS INT)) AS shard, b > 262144 AS over FROM s WHERE nth = 1),
g AS (SELECT *, t % (2 * CAST(ceil(b / 262144) AS BIGINT)) AS g, n_bytes > 131072 AS big FROM f WHERE over),
c AS (
  SELECT *, CASE WHEN big THEN row_number() OVER w
    ELSE floor((sum(n_bytes) OVER (w ROWS UNBOUNDED PRECEDING) - n_bytes) / (262144 - max(n_bytes) OVER (PARTITION BY shard, g, big))) END AS cut
  FROM g WINDOW w AS (PARTITION BY shard, g, big ORDER BY t, n_bytes)),
n AS (SELECT *, dense_rank() OVER (PARTITION BY shard ORDER BY g, big, cut) - 1 AS part FROM c)
SELECT doc_id, n_bytes, shard, CAST(part AS BIGINT) AS part, CAST(sum(n_bytes) OVER (PARTITION BY shard, part) AS BIGINT) AS shard_bytes,
       CAST(count(*) OVER (PARTITION BY shard, part) AS BIGINT) AS shard_rows FROM n
UNION ALL SELECT doc_id, n_bytes, shard, 0, CAST(b AS BIGINT), CAST(r AS BIGINT) FROM f WHERE NOT over
"""

OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM c GROUP BY conv_id),
o AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 7 <> 0 AND turn = last THEN 'No. ' || coalesce(text, '') ELSE text END AS text
  FROM c WHERE conv_id % 7 = 0 OR (conv_id % 5 <> 0 AND (last IS NULL OR turn <= last))),
u AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM o GROUP BY conv_id),
p AS (
  SELECT conv_id AS pair_id, 2 * conv_id AS chosen_id, CASE WHEN u.ts IS NOT NULL THEN 2 * conv_id + 1 END AS rejected_id, t.ts AS a, u.ts AS b FROM t LEFT JOIN u USING (conv_id)),
n AS (
  SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce(
    list_min(list_filter(range(1, least(len(a), len(b)) + 1),
      lambda i: a[i].role IS DISTINCT FROM b[i].role OR a[i].text IS DISTINCT FROM b[i].text)) - 1, least(len(a), len(b))) END AS n FROM p),
r AS (SELECT *, a[n+1:] AS ra, b[n+1:] AS rb FROM n)
SELECT pair_id, chosen_id, rejected_id,
  CASE WHEN a IS NULL OR b IS NULL THEN 'unpaired' WHEN n = len(a) AND n = len(b) THEN 'identical' ELSE 'paired' END AS status,
  CAST(n AS BIGINT) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(coalesce(a, b)[1:n], lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  CASE WHEN a IS NOT NULL THEN coalesce(array_to_string(list_transform(ra, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), ''), '') END AS chosen,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(list_transform(rb, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), ''), '') END AS rejected,
  CASE WHEN a IS NOT NULL THEN coalesce(array_to_string(list_transform(ra, lambda x: CAST(13 + length(coalesce(x.role, '')) AS VARCHAR) || ':0,' || CAST(11 + length(coalesce(x.text, '')) AS VARCHAR) || CASE WHEN x.role = 'assistant' THEN ':1' ELSE ':0' END), ','), '') END AS chosen_mask,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(list_transform(rb, lambda x: CAST(13 + length(coalesce(x.role, '')) AS VARCHAR) || ':0,' || CAST(11 + length(coalesce(x.text, '')) AS VARCHAR) || CASE WHEN x.role = 'assistant' THEN ':1' ELSE ':0' END), ','), '') END AS rejected_mask
FROM r
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_top_k": op5_top_k,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_token_output": op8_token_output,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE_SQL = {
    "op3_quality_rules": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op5_top_k": OP5_SQL,
    "op7_sharding": OP7_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op10_near_duplicates": OP10_SQL,
}
