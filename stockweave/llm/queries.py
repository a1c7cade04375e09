"""Queries over the supplied tables, one per operator, with their DuckDB checks.

``QUERIES`` and ``CHECKS`` are added to the driver contract if this subpackage can be imported.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import (
    attention_quality,
    bag_minhash,
    bpe,
    exact_dedup,
    html_text,
    middle,
    mixing,
    periodic_runs,
    quality_rules,
    secrets,
    sentence_spans,
    url_filter,
    warc,
)
from stockweave.llm.common import read
from stockweave.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern that the contract of the tokenizer query names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "n_left_words",
        "kept",
    )


QUERIES["op2_quality_rules"] = op2_quality_rules
CHECKS["op2_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(md5(text), 'null') AS key, coalesce('=' || source, 'null') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), raw_lines AS (
  SELECT doc_id, key, host, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, key, host, line,
         regexp_replace(lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')), '[0-9]', '0', 'g') AS plain,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), hosts AS (
  SELECT host, count(DISTINCT key) AS host_docs FROM d GROUP BY host
), frequent AS (
  SELECT l.host, l.plain FROM lines l JOIN hosts h ON l.host = h.host
  GROUP BY l.host, l.plain, h.host_docs HAVING count(DISTINCT l.key) > greatest(25, 0.01 * h.host_docs)
), removed AS (
  SELECT l.doc_id, sum(l.words) AS words FROM lines l JOIN frequent f ON l.host = f.host AND l.plain = f.plain GROUP BY l.doc_id
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
), windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d
), keyed AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS times FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE times > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(w) - coalesce(r.words, 0) AS BIGINT) AS n_left_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= 0.5 * n_words AS kept
FROM m
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents"))


QUERIES["op3_exact_dedup"] = op3_exact_dedup
CHECKS["op3_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same_text AS keep_id, count(*) OVER same_text AS group_size,
       doc_id = max(doc_id) OVER same_text AS kept, sha256(text) AS text_sha256
FROM d WINDOW same_text AS (PARTITION BY text)
"""


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("node", "component")


QUERIES["op5_bag_minhash"] = op5_bag_minhash


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "passes"
    )


QUERIES["op7_mixing"] = op7_mixing
CHECKS["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '>' ELSE '=' || source END AS sk,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15)
              AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY sk) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM s
), l AS (
  SELECT *, source_size * CAST(3 AS DOUBLE) AS lim, source_size * CAST(3 AS DOUBLE) / weight AS level FROM w
), f AS (
  SELECT *, sum(lim) OVER up + level * (sum(weight) OVER () - sum(weight) OVER up) <= CAST(total AS DOUBLE) AS stops
  FROM l WINDOW up AS (ORDER BY level, sk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT *, CASE WHEN stops THEN lim ELSE
           (CAST(total AS DOUBLE) - coalesce(sum(CASE WHEN stops THEN lim END) OVER (), CAST(0 AS DOUBLE))) * weight
           / sum(CASE WHEN NOT stops THEN weight END) OVER () END AS target,
         32 AS block, greatest(1, CAST(ceil(source_size / CAST(4194304 AS DOUBLE)) AS BIGINT)) AS shards
  FROM f
), seats AS (
  SELECT sk, (total + block - 1) // block AS free, target, unnest(range(1, CAST(3 * source_size // block + n + 3 AS BIGINT))) AS k
  FROM t WHERE target > 0
), won AS (
  SELECT sk, count(*) AS blocks
  FROM (SELECT sk, free, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, sk, k) AS place FROM seats) AS r
  WHERE place <= free GROUP BY sk
), dealt AS (
  SELECT d.*, source_size, target, block, coalesce(blocks, 0) AS blocks, place % shards AS shard
  FROM d JOIN t ON d.sk = t.sk LEFT JOIN won ON d.sk = won.sk
), sh AS (
  SELECT sk, shard, block, blocks, CAST(sum(size) AS BIGINT) AS shard_size, count(*) OVER (PARTITION BY sk) AS n,
         greatest(1, CAST(ceil(sum(size) / CAST(block AS DOUBLE)) AS BIGINT)) AS line
  FROM dealt GROUP BY sk, shard, block, blocks
), sh_seats AS (
  SELECT sk, shard, shard_size, blocks, unnest(range(1, CAST(3 * line + n + 3 AS BIGINT))) AS k FROM sh WHERE shard_size > 0
), sh_won AS (
  SELECT sk, shard, count(*) AS quota
  FROM (SELECT sk, shard, blocks,
               row_number() OVER (PARTITION BY sk ORDER BY shard_size / CAST(2 * k - 1 AS DOUBLE) DESC, shard, k) AS place
        FROM sh_seats) AS r
  WHERE place <= blocks GROUP BY sk, shard
), q AS (
  SELECT sh.sk, sh.shard, line, least(coalesce(quota, 0), 3 * line) AS quota,
         CAST('0x' || substr(md5('17:' || sh.sk || ':' || CAST(sh.shard AS VARCHAR)), 1, 15) AS BIGINT) % line AS skip
  FROM sh LEFT JOIN sh_won ON sh.sk = sh_won.sk AND sh.shard = sh_won.shard
), p AS (
  SELECT dealt.*, line, quota, skip,
         CAST(sum(size) OVER (PARTITION BY dealt.sk, dealt.shard ORDER BY place, doc_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
  FROM dealt JOIN q ON dealt.sk = q.sk AND dealt.shard = q.shard
), b AS (
  SELECT doc_id, size, source_size, target, stop - size AS start, stop, line, quota, skip, block,
         unnest(range((stop - size) // block, (stop - 1) // block + 1)) AS b
  FROM p WHERE size > 0
), part AS (
  SELECT doc_id, CAST(sum(least((b + 1) * block, stop) - greatest(b * block, start)) AS BIGINT) AS words
  FROM b WHERE (b * 2654435761 + skip) % line < quota % line GROUP BY doc_id
)
SELECT p.doc_id, size, source_size, target,
       CAST((CASE WHEN size = 0 THEN 0 ELSE quota // line END) * size + coalesce(words, 0) AS BIGINT) AS taken,
       CAST(CASE WHEN size = 0 THEN 0 ELSE quota // line END AS BIGINT) AS passes
FROM p LEFT JOIN part ON p.doc_id = part.doc_id
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), *vocabulary())


QUERIES["op10_byte_bpe"] = op10_byte_bpe


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op1_attention_quality"] = op1_attention_quality


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives = warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read_records(spark, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES["op4_warc_chunks"] = op4_warc_chunks
CHECKS["op4_warc_chunks"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), m AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter(F.split("base", ","), lambda x: x.startswith(kind))).cast("long")

    return secrets.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign:").alias("n_assign"),
        count("access:").alias("n_access"),
        count("hex:").alias("n_hex"),
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


QUERIES["op6_secret_scan"] = op6_secret_scan


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.deduplicate(read(spark, sf_dir, "documents"))


QUERIES["op8_sentence_spans"] = op8_sentence_spans


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES["op9_html_text"] = op9_html_text


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")))
    return periodic_runs.digests(found)


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/urls-{uuid.uuid4().hex}"
    index = url_filter.build(url_filter.default_entries(spark), folder)
    return url_filter.judge(read(spark, sf_dir, "pages"), index).drop("url", "listed")


QUERIES["op12_url_filter"] = op12_url_filter
CHECKS["op12_url_filter"] = (
    r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules (rule_host, rule_path, said) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
  SELECT p.*, rule_host || rule_path AS rule, said,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN len(list_intersect(string_split(replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '-', '.'), '.'),
                                                   string_split('"""
    + " ".join(url_filter.BLOCK_WORDS)
    + r"""', ' '))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged WHERE place = 1
"""
)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(middle.fill_in_middle(read(spark, sf_dir, "documents")))


QUERIES["op13_fill_in_middle"] = op13_fill_in_middle
CHECKS["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS one,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), s AS (
  SELECT *, array_to_string(u[1:least(one, two)], '') AS p,
         array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m,
         array_to_string(u[greatest(one, two) + 1:n], '') AS s
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
