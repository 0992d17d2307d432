"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tradewind.llm import byte_bpe, token_orc
from tradewind.llm.common import scratch
from tradewind.llm.exact_dedup import exact_dedup
from tradewind.llm.fertility import fertility
from tradewind.llm.html_text import extract_text
from tradewind.llm.line_dedup import repeats
from tradewind.llm.lm import lm_scores
from tradewind.llm.minhash_join import near_duplicates as near_by_minhash
from tradewind.llm.packing import pack_documents
from tradewind.llm.phrases import collocations
from tradewind.llm.simhash import near_duplicates
from tradewind.llm.warc import archive
from tradewind.llm.word_runs import find_runs

QUERIES: dict = {}
ORACLE: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_orc.write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, added=True)
    return token_orc.token_spans(spark, path)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(_table(spark, sf_dir, "documents")).drop("text_key")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


ORACLE["op4_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


@query
def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


@query
def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op7_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> winner THEN winner END AS refers_to
FROM f
"""


@query
def op8_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, added=True).drop("ids")


@query
def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(_table(spark, sf_dir, "documents"), plant=True)


@query
def op12_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_by_minhash(_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op12_minhash_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingles FROM d),
     n AS (SELECT doc_id, shingles, len(shingles) AS n_shingles, min(doc_id) OVER (PARTITION BY list_sort(shingles)) AS node FROM s),
     e AS (SELECT node, n_shingles, unnest(shingles) AS shingle FROM n WHERE doc_id = node),
     met AS (SELECT a.node AS u, b.node AS v, count(*) AS common, any_value(a.n_shingles) + any_value(b.n_shingles) - count(*) AS whole
             FROM e a JOIN e b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
     links AS (SELECT u, v FROM met WHERE 100 * common >= 80 * whole UNION ALL SELECT v, u FROM met WHERE 100 * common >= 80 * whole),
     reach AS (SELECT DISTINCT node AS u, node AS v FROM n UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
     least AS (SELECT u AS node, min(v) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id,
       doc_id = CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS kept
FROM n JOIN least USING (node)
"""


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


ORACLE["op13_phrases"] = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n-\r]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
     t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
     g AS (SELECT lang, w[i : i + m - 1] AS ws FROM w, unnest(range(1, 6)) AS x(m), unnest(range(1, len(w) - m + 2)) AS y(i)),
     f AS (SELECT lang, ws, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
     cut AS (SELECT f.lang, f.ws, f.a, k, l.a AS l, r.a AS r, t.n, CAST((1000::HUGEINT * f.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
             FROM f, unnest(range(1, len(f.ws))) AS x(k) JOIN f l ON l.lang = f.lang AND l.ws = f.ws[1 : k] JOIN f r ON r.lang = f.lang AND r.ws = f.ws[k + 1 :] JOIN t ON t.lang = f.lang),
     best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
     longer AS (SELECT DISTINCT lang, unnest([ws[1 : len(ws) - 1], ws[2 :]]) AS ws, a FROM f WHERE len(ws) > 2),
     kept AS (SELECT * FROM best ANTI JOIN longer USING (lang, ws, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank,
       array_to_string(ws, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY rank <= 2000
"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
