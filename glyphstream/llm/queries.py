"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm import debruijn, fingerprints, language_id, licenses, media, packing, sentencepiece, simhash_neardup, suffix_dedup, toxicity
from glyphstream.llm.common import crc_mod, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    found = language_id.predict_documents(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.code_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removed_words_digest(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_language_id, op4_fingerprints, op5_packing, op6_sentencepiece, op7_simhash_neardup, op8_license_scan, op9_debruijn_dedup, op10_media)}
#: Equal windows are told by md5 of the whole window; bytes are looked at in hexadecimal.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM d, unnest(range(0, length(x) // 2 - 199)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
isle AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 200, true)::INT AS new FROM rep WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM isle) GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS s, max(b) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(s, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 20) AS r(j)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS s, count(gone.p) AS n_removed FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op9_debruijn_dedup": OP9_SQL}
