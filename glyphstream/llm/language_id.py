"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into buckets.  Document frequencies are counted
over all training documents by Spark.  The weights are learned by follow-the-regularised-leader
with L1 and L2 penalties on a bounded, hashed sample that holds as many rows of each language as
there are, up to an equal share; a part of the sample sets the temperature.  One scan predicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm.common import crc_mod, hash_bound, hash_rank, kept_names, slices

BUCKETS = 1 << 14


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the 1- to 3-grams of the lower-cased text; digits and blanks are one sign each."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    low = c < 65
    c = np.where(low, np.where((c >= 48) & (c < 58), np.uint64(48), np.where(c <= 32, np.uint64(32), c)), c)
    mul = np.uint64(0x9E3779B97F4A7C15)
    grams = [c]
    for n in (2, 3):
        if len(c) >= n:
            grams.append(grams[-1][:-1] * np.uint64(1 << 21) + c[n - 1 :])
    h = np.concatenate([(g + np.uint64(k << 62)) * mul >> np.uint64(50) for k, g in enumerate(grams)]).astype(np.int64)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = ngram_counts(text)
        v = (1 + np.log(n)) * self.idf[at]
        return at, v / (np.sqrt((v * v).sum()) + 1e-12)

    def logits(self, text: str) -> np.ndarray:
        at, v = self.row(text)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """`und` and 0 for a text without a letter, or if no language was learned."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Over all rows; a task sends one row for each bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in slices(batches, "text", 8 << 20):
            for t in batch.column(0).to_pylist():
                df[ngram_counts(t)[0]] += 1
                n += 1
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "df"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        out[r["bucket"]] = r["df"]
    return out


def fit_ftrl(rows: list, classes: int, *, rounds: int = 3, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from rows (buckets, values, class); the elastic net makes unused weights zero."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            at, v, y = rows[k]
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(v, p)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search on a fine scale."""

    def loss(t):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 5, 60), key=loss) if len(y) else 1.0


def train(docs: DataFrame, *, held_out_mod: int = 4, held_out_rest: int = 2, max_rows: int = 4000, max_languages: int = 1000) -> LanguageModel:
    """The model from text and non-null lang of docs whose crc32(doc_id as text) modulo held_out_mod isn't held_out_rest.

    max_rows bounds the sample over all languages: of each language the rows with the least hashes, at
    most an equal share and at least one.  More than max_languages languages are an error, since
    the weights of all must fit in a task.  Null texts and langs teach nothing; an empty table gives a model that knows no language.
    """
    free = docs.where((crc_mod("doc_id", held_out_mod) != held_out_rest) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in free.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS, 1)), np.zeros(1))
    df = document_frequencies(free)
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    most = max(1, max_rows // len(languages))
    # twice the share and 64 rows are looked at, so that fewer than the share are not to be expected
    bounds = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, hash_bound(2 * most + 64, n))])
    near = free.withColumn("rank", hash_rank("doc_id", "text", salt="language")).where(F.col("rank") <= bounds[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", "text"))
    chosen = near.withColumn("first", first).where(F.col("first") <= most).select("rank", "lang", "text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [ngram_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())], ["rank", "lang", "at", "n"])

    sample = chosen.mapInArrow(rows_of, "rank bigint, lang string, at binary, n binary").collect()  # max_rows bounds it
    rows = []
    for r in sorted(sample, key=lambda r: (r["rank"], r["lang"], r["at"], r["n"])):
        at, n = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.float64)
        v = (1 + np.log(n)) * idf[at]
        rows.append((at, v / (np.sqrt((v * v).sum()) + 1e-12), languages.index(r["lang"])))
    apart = rows[::5] if len(rows) >= 50 else []
    model.weights, model.bias = fit_ftrl([r for k, r in enumerate(rows) if not apart or k % 5], len(languages))
    if apart:
        logits = np.array([v @ model.weights[at] + model.bias for at, v, _ in apart])
        model.temperature = float(fit_temperature(logits, np.array([y for *_, y in apart])))
    return model


def predict_documents(docs: DataFrame, model: LanguageModel, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and, between them, the columns of docs named in keep; whole texts, one scan.

    A text that is null or has no letter gets `und` and 0, as does every text if no language was learned; of languages
    of equal score the first in alphabetical order holds.  A null doc_id stays null, equal rows get equal results, an
    empty table gives no row.  A kept column named like a result gets `_of_docs` behind its name.
    """
    own = kept_names(list(keep), ["doc_id", "lang_pred", "score"])
    rows = docs.select(F.col("doc_id").alias("_0"), F.col("text").cast("string").alias("_1"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_1", 4 << 20):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(k) for k in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", *own, "lang_pred", "score"])

    types = [t for _, t in rows.dtypes]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(["doc_id", *own], [types[0], *types[2:]])) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)
