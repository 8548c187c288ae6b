"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .brown_lm import score_documents
from .common import held_out, table
from .decontam import find_leaks
from .jaccard_join import join_similar
from .langid import identify_languages
from .mixing import mix_documents
from .packing import pack_documents
from .resampling import resample
from .revisits import recrawled, resolve_revisits
from .secrets import scan_secrets
from .token_count import count_tokens
from .topk import top_k
from .url_filter import filter_urls


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"), size=3, percent=90)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), held_out(7))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


#: The contract's rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents"), ~held_out(4))
    return found.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").filter(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(recrawled(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url_key", "outcome", "original_id", F.array_join(lines, "; ").alias("headers"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vocabulary_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_class_lm, op2_packing, op3_url_filters, op4_language_id, op5_decontamination, op6_top_k, op7_secret_scans, op8_jaccard_join, op9_token_counts, op10_revisits, op11_source_mix, op12_importance_resampling, op13_vocabulary_alignment)}

#: The other methods (models, tokenizers, scanners) are beyond SQL, or too slow there on whole tables; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_revisits": r"""
WITH bare AS (
  SELECT page_id, md5(page_id::VARCHAR) AS digest, '"' || md5(coalesce(html, '')) || '"' AS tag,
    regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
cut AS (SELECT *, regexp_extract(bare, '^[^/?]*', 0) AS host FROM bare),
halves AS (SELECT *, split_part(substr(bare, length(host) + 1), '?', 1) AS path, substr(bare, length(host) + 1) AS rest FROM cut),
keyed AS (
  SELECT *, ltrim(regexp_replace('&' || substr(rest, length(path) + 2), '&utm_[^&]*', '', 'g'), '&') AS query FROM halves),
urls AS (
  SELECT page_id, digest, tag, regexp_replace(lower(host), ':(80|443)$', '') || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key
  FROM keyed),
caps AS (
  SELECT 5 * page_id AS record_id, url_key, 2 * page_id AS ts, FALSE AS "full", NULL AS etag, page_id AS d, page_id - 1 AS modified FROM urls
  UNION ALL SELECT 5 * page_id + 1, url_key, 2 * page_id + 1, TRUE, tag, page_id, page_id - 1 FROM urls
  UNION ALL SELECT 5 * page_id + 2, url_key, 2 * page_id + 3, TRUE, '"second"', page_id + 1, page_id FROM urls WHERE md5(page_id::VARCHAR) >= '8'
  UNION ALL SELECT 5 * page_id + 3, url_key, 2 * (page_id + 10000) + 1, FALSE,
    CASE WHEN digest < '3' THEN '"changed"' WHEN digest < '6' THEN NULL WHEN digest >= 'c' THEN '"second"' ELSE 'W/' || tag END, page_id + 10000, page_id - 1 FROM urls
  UNION ALL SELECT 5 * page_id + 4, url_key, 2 * (page_id + 10000) + 2, FALSE, NULL, page_id + 10001, NULL FROM urls),
ranked AS (
  SELECT r.*, o.record_id AS o_id, o.etag AS o_etag, o.modified AS o_modified, o.d AS o_d,
    row_number() OVER (PARTITION BY r.record_id ORDER BY o.ts DESC NULLS LAST, o.record_id DESC NULLS LAST) AS place
  FROM caps r LEFT JOIN caps o ON NOT r."full" AND o."full" AND o.url_key = r.url_key AND o.ts < r.ts),
judged AS (
  SELECT *, CASE WHEN "full" THEN 'response' WHEN o_id IS NULL THEN 'no_original'
    ELSE CASE coalesce(regexp_replace(etag, '^W/', '') = o_etag, modified = o_modified) WHEN TRUE THEN 'resolved' WHEN FALSE THEN 'mismatch' ELSE 'unvalidated' END END AS outcome
  FROM ranked WHERE place = 1)
SELECT record_id, url_key, outcome, o_id AS original_id,
  CASE outcome
    WHEN 'response' THEN 'content-type: text/html; date: day ' || d || '; etag: ' || etag || '; last-modified: day ' || modified
    WHEN 'resolved' THEN 'content-type: text/html; date: day ' || d || '; etag: ' || coalesce(etag, o_etag) || '; last-modified: day ' || coalesce(modified, o_modified)
    ELSE 'content-length: 0; date: day ' || d || coalesce('; etag: ' || etag, '') || coalesce('; last-modified: day ' || modified, '') END AS headers
FROM judged""",
    "op11_source_mix": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 10))::BIGINT AS h
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS s,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight
  FROM docs GROUP BY source),
-- sources in the order in which they reach their limits; the level after the first ones did
filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, s) AS nth, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    coalesce(sum(weight) OVER (ORDER BY source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone_weight
  FROM named),
levels AS (SELECT *, ((total - gone) / (weights - gone_weight))::DOUBLE AS lv FROM filled),
fixed AS (SELECT lv FROM levels WHERE 2 * source_size >= weight * lv ORDER BY nth LIMIT 1),
aimed AS (SELECT n.*, least(2.0::DOUBLE * source_size, weight * lv)::DOUBLE AS target FROM named n, fixed),
cut AS (
  SELECT *, ceil(source_size / 128)::BIGINT AS blocks, floor(target)::BIGINT % greatest(source_size, 1) AS rest,
    (floor(target)::BIGINT // greatest(source_size, 1)) * ceil(source_size / 128)::BIGINT + ceil((floor(target)::BIGINT % greatest(source_size, 1)) / 128)::BIGINT AS slots
  FROM aimed),
sources AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, (sum(slots) OVER ())::BIGINT AS n FROM cut),
points AS (
  SELECT k, ((k & 1048575) * 679535556991 + (k >> 20) * 668269019136) & 1099511627775 AS v
  FROM (SELECT unnest(range((SELECT max(n) FROM sources))) AS k)),
ranked AS (
  SELECT s, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS rank
  FROM points p JOIN sources c ON v::DOUBLE / 1099511627776::DOUBLE * n::DOUBLE >= first AND v::DOUBLE / 1099511627776::DOUBLE * n::DOUBLE < first + slots),
slots AS (
  SELECT c.s, r.rank FROM ranked r JOIN sources c USING (s) WHERE r.rank < c.slots
  UNION ALL
  SELECT s, unnest(range(found, slots)) FROM (SELECT c.s, c.slots, (SELECT count(*) FROM ranked r WHERE r.s = c.s) AS found FROM sources c) WHERE found < slots),
limits AS (
  SELECT s, rank % blocks AS block, CASE WHEN rank = slots - 1 AND rest > 0 THEN rest - 128 * (rank % blocks) ELSE 128 END AS most FROM slots JOIN sources USING (s)),
placed AS (
  SELECT d.*, c.s, sum(size) OVER (PARTITION BY c.s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS place
  FROM docs d JOIN sources c ON d.source IS NOT DISTINCT FROM c.source WHERE size > 0),
pieces AS (SELECT *, unnest(range(place // 128, (place + size - 1) // 128 + 1)) AS block FROM placed),
sums AS (
  SELECT p.s, p.doc_id, p.size, p.place,
    coalesce(sum(greatest(0, least(least(place + size, 128 * p.block + 128) - greatest(place, 128 * p.block), most - (greatest(place, 128 * p.block) - 128 * p.block)))) FILTER (WHERE most IS NOT NULL), 0)::BIGINT AS taken
  FROM pieces p LEFT JOIN limits l ON p.s = l.s AND p.block = l.block GROUP BY p.s, p.doc_id, p.size, p.place)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken FROM (
  SELECT s, doc_id, size, taken FROM sums
  UNION ALL SELECT c.s, d.doc_id, d.size, 0 FROM docs d JOIN sources c ON d.source IS NOT DISTINCT FROM c.source WHERE size = 0) JOIN sources USING (s)""",
}
