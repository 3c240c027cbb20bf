"""documents through five stages: toxicity, language, near duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents.  Empty tables pass through; a null text counts as empty and is rejected by the language stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm import language_id, packing, simhash_neardup, suffix_dedup, toxicity
from glyphstream.llm.common import checkpoint_dir, table
from glyphstream.llm.queries import tokenizer_path

LEAST_CONFIDENCE = 0.5


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, numbered, so that no name clashes with what an operator adds."""
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("row"))


def unboxed(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs again, of a table that has boxed()'s; the column `text` holds the texts."""
    at = {"doc_id": "doc_id", "text": text}
    return found.select(*[F.col(at.get(c, f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the labels of sf_dir."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return unboxed(toxicity.score_documents(boxed(docs), model, ["text", "row"]).where("predicted = 0"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with a confidence of 0.5 at least."""
    found = language_id.predict_documents(boxed(docs), language_id.train(docs), ["text", "row"])
    return unboxed(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CONFIDENCE)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the rows of the smallest doc_id; all rows without one."""
    found = simhash_neardup.similar_documents(docs.where("doc_id is not null").select("doc_id", "text"), width=5, threshold=0.8)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of 200 bytes; documents that consist of copies alone go.

    n_chars, if it is there, is counted anew.
    """
    left = suffix_dedup.remove_substrings(boxed(docs), length=200, keep_first=True)
    left = unboxed(left.where((F.col("kept_text") != "") | (F.coalesce("text", F.lit("")) == "")), docs, "kept_text")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return left


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("simhash_neardup", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: Trained models and hashed fingerprints: SQL can't express the first stage.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stage's table; one that is gone already is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    A stage's table goes when the next one's is written; that which the last stage reads stays in the
    shared folder, since its rows are computed when they are asked for.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/glyph-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
