"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.embed_dedup import embedding_groups
from docframe.llm.exact_dedup import exact_dedup
from docframe.llm.langid import fit_dictionaries, identify_language
from docframe.llm.mixing import mix_sources
from docframe.llm.packing import pack_documents
from docframe.llm.quality import quality_scores
from docframe.llm.secrets import BASE, EXTRA, find_secrets, secret_digest
from docframe.llm.simhash import simhash_groups
from docframe.llm.storage import finished, scratch
from docframe.llm.toxicity import fit_toxicity, score_toxicity
from docframe.llm.url_filters import filter_urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Target shares by source, for the 20 sources of the test tables: proportional to 1 / sqrt(1 + i).
MIX_WEIGHTS = {f"src{i}": round((1 + i) ** -0.5, 6) for i in range(20)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "op1", lambda: secret_digest(find_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])))


def _op1_sql() -> str:
    """Each rule's matches and what stands between them give the places of the matches."""
    parts = []
    for rank, r in enumerate(BASE + EXTRA):
        # RE2 has no look-behind: the character before a match is matched too, and not counted
        before, pattern = re.fullmatch(r"(\(\?<!\[.*?\]\))?(.*)", r.pattern).groups()
        quoted = pattern.replace("'", "''")
        whole = f"(?:^|[^{before[5:-2]}])({quoted})" if before else f"({quoted})"
        group = r.group + 1 if r.group else 1
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, regexp_extract_all(text, '{whole}') AS found, "
            f"regexp_extract_all(text, '{whole}', 1) AS own, regexp_extract_all(text, '{whole}', {group}) AS part, string_split_regex(text, '{whole}') AS rest FROM docs"
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({' UNION ALL '.join(parts)}),
places AS (
  SELECT *, list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)
            + length(found[i]) - length(own[i]) AS s
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches WHERE len(found) > 0)),
spans AS (
  SELECT doc_id, kind, rank, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || (s + length(own[i]))::BIGINT AS span FROM places WHERE length(part[i]) >= least),
digests AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({base})) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN digests USING (doc_id)
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda: exact_dedup(_table(spark, sf_dir, "documents"))
    return finished(spark, "op2", lambda: found().select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "op3", lambda: simhash_groups(_table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "op4", lambda: pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = lambda: quality_scores(_table(spark, sf_dir, "documents"), trusted)
    # sums of doubles differ in their last digits with the order of adding
    rounded = [F.round(c, 6).alias(c) for c in ("perplexity", "threshold")]
    return finished(spark, "op5", lambda: found().select("doc_id", "lang", *rounded, "kept"))


def _fold_number(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.where(_fold_number(5) != 0))
    found = identify_language(docs, dictionaries)
    return found.select("doc_id", (_fold_number(5) == 0).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "op7", lambda: embedding_groups(_table(spark, sf_dir, "embeddings")))


OP7_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a, vectors b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, (SELECT min(b) FROM reached r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reached r WHERE r.a = e.vec_id) AS kept
FROM embeddings e
"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time by rule: one a second, in a scattered order over 180 days."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    second = F.col("page_id") * 7919 % (180 * 86400)
    return pages.withColumn("fetch_time", F.timestamp_seconds(second + 1_704_067_200))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Dated entries by rule, up to four for each pattern on two lists.

    Patterns are hosts and their registered domains, and by hash some paths: of one segment, of one in the wrong
    case, of two below a host in capitals with a closing slash, and of four.
    """
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:@]+)", 1)
    segments = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1), "/"), lambda s: s != "")
    places = captures.select(host.alias("host"), F.get(segments, 0).alias("s"), F.get(segments, 1).alias("t"))
    several = F.array(
        F.col("host"),
        F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1),
        F.concat("host", F.lit("/"), "s"),
        F.concat("host", F.lit("/"), F.upper("s")),
        F.concat(F.upper("host"), F.lit("/"), "s", F.lit("/"), "t", F.lit("/")),
        F.concat("host", F.lit("/"), "s", F.lit("/"), "t", F.lit("/x/y")),
    )
    patterns = places.select(F.explode(several).alias("pattern")).where("pattern <> ''").distinct()
    some = patterns.where(~F.col("pattern").contains("/") | (F.substring(F.md5("pattern"), 1, 1) < "4"))
    numbered = some.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "pattern", F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    return numbered.withColumn("r", number).select(
        F.when(F.col("k") % 2 == 0, "ads").otherwise("malware").alias("list_name"),
        "pattern",
        F.when(F.col("r") % 3 == 0, "remove").when(F.col("r") % 3 == 1, "block").otherwise("allow").alias("action"),
        F.timestamp_seconds(F.col("r") % (180 * 86400) + 1_704_067_200).alias("listed_at"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    found = filter_urls(captures, _list_entries(captures))
    return found.withColumn("fetch_time", F.date_format("fetch_time", "yyyy-MM-dd HH:mm:ss"))


OP8_SQL = r"""
WITH captures AS (
  SELECT page_id, url, 1704067200 + page_id * 7919 % 15552000 AS ft, lower(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
places AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1) AS host, segs[1] AS s, segs[2] AS t FROM captures),
patterns AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), host || '/' || s, host || '/' || upper(s),
                   upper(host) || '/' || s || '/' || t || '/', host || '/' || s || '/' || t || '/x/y']) AS pattern FROM places)
  WHERE pattern <> '' AND (NOT contains(pattern, '/') OR substr(md5(pattern), 1, 1) < '4')),
numbered AS (
  SELECT pattern, k, ('0x' || substr(md5(pattern || ':' || k), 1, 8))::BIGINT AS r FROM patterns, range(4) t(k)),
entries AS (
  SELECT list_name, pattern, listed_at, max(action) AS action FROM (
    SELECT CASE WHEN k % 2 = 0 THEN 'ads' ELSE 'malware' END AS list_name,
           rtrim(lower(string_split(pattern, '/')[1]) || substr(pattern, length(string_split(pattern, '/')[1]) + 1), '/') AS pattern,
           r % 15552000 + 1704067200 AS listed_at,
           CASE r % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'block' ELSE 'allow' END AS action FROM numbered) GROUP BY ALL),
valid AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY list_name, pattern ORDER BY listed_at) AS valid_to FROM entries),
labels_of AS (SELECT DISTINCT *, string_split(host, '.') AS parts FROM captures),
keyed AS (
  SELECT DISTINCT page_id, url, ft, unnest(list_concat(
    list_transform(range(1, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 1 ELSE greatest(len(parts) - 1, 1) END + 1), lambda i: array_to_string(parts[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/')))) AS pattern FROM labels_of),
found AS (
  SELECT k.page_id, k.url, k.ft, v.pattern, v.list_name, v.action,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.ft ORDER BY length(v.pattern) DESC, listed_at DESC, list_name DESC, action DESC) AS rn,
         count(*) OVER (PARTITION BY k.page_id, k.url, k.ft) AS n
  FROM keyed k JOIN valid v ON k.pattern = v.pattern AND v.listed_at <= k.ft AND (v.valid_to IS NULL OR k.ft < v.valid_to) WHERE v.action <> 'remove')
SELECT c.page_id, c.url, strftime(make_timestamp(c.ft * 1000000), '%Y-%m-%d %H:%M:%S') AS fetch_time, c.host, coalesce(f.n, 0) AS n_active,
       f.pattern, f.list_name, f.action, coalesce(f.action = 'block', false) AS blocked
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id AND c.url = f.url AND c.ft = f.ft AND f.rn = 1
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, keep_other=True)


def mix_sql(docs: str, weights: dict[str, float], seed: str = "mix", part: float = 8.0) -> str:
    """SQL for mix_sources with keep_other over a relation with the columns of documents and unique ids."""
    values = ", ".join(f"('{k}', {w!r}::DOUBLE)" for k, w in weights.items())
    return f"""
WITH w(source, weight) AS (VALUES {values}),
keyed AS (SELECT d.*, coalesce(w.source, '*') AS key, w.weight FROM {docs} d LEFT JOIN w ON d.source = w.source),
n AS (SELECT key, any_value(weight) AS weight, count(*)::DOUBLE AS c FROM keyed GROUP BY key),
named AS (SELECT sum(c) AS c, sum(weight) AS weight FROM n WHERE key <> '*'),
rate AS (SELECT key, CASE WHEN key = '*' THEN 1.0 ELSE (SELECT c FROM named) * weight / (SELECT weight FROM named) / c END AS r FROM n),
parts AS (SELECT key, greatest(1, ceil(r / {part}))::BIGINT AS m, r / greatest(1, ceil(r / {part})) AS mean FROM rate),
terms AS (SELECT key, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM parts, range(64) t(k)),
cdf AS (SELECT key, k, sum(p) OVER (PARTITION BY key ORDER BY k) AS p FROM terms),
drawn AS (
  SELECT d.doc_id, key, unnest(range(1, m + 1)) AS j FROM keyed d JOIN parts USING (key)),
numbers AS (
  SELECT *, ('0x' || substr(md5('{seed}:' || doc_id || ':' || j), 1, 12))::BIGINT / 281474976710656.0 AS u FROM drawn),
found AS (SELECT doc_id, j, count(*) FILTER (WHERE p <= u) AS x FROM numbers JOIN cdf USING (key) GROUP BY doc_id, j),
counts AS (SELECT doc_id, sum(x)::BIGINT AS n FROM found GROUP BY doc_id HAVING sum(x) > 0),
copies AS (SELECT doc_id, unnest(range(n))::INTEGER AS copy FROM counts)
SELECT d.*, copy, substr(md5('{seed}:' || d.doc_id || ':copy:' || copy), 1, 16) AS shuffle_key FROM copies JOIN {docs} d USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    with scratch(spark):
        model = fit_toxicity(docs, labels.where(_fold_number(4) != 2))
    found = score_toxicity(docs, model)
    return found.select("doc_id", (_fold_number(4) == 2).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_simhash": op3_simhash,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_language": op6_language,
        "op7_embeddings": op7_embeddings,
        "op8_url_filter": op8_url_filter,
        "op9_mixing": op9_mixing,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _op1_sql(),
        "op2_exact_dedup": OP2_SQL,
        "op7_embeddings": OP7_SQL,
        "op8_url_filter": OP8_SQL,
        "op9_mixing": mix_sql("documents", MIX_WEIGHTS),
    }
