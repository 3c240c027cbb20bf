"""Sampling, label model, FTRL and scores of the two trained operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.llm import common, language_id, toxicity


def test_hash_bound_never_vanishes():
    for n in (1, 10, 10**6, 10**9, 10**12, 10**18):
        for most in (1, 40, 12_000):
            bound = common.hash_bound(most, n)
            assert 0 < bound < 1 << 63
            assert n <= most and bound == (1 << 63) - 1 or math.isclose(bound / 2**63 * n, most, rel_tol=0.2) or bound == 1


def test_hash_sample_is_whole_and_bounded(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"))
    got = [r["doc_id"] for r in common.hash_sample(ids, 100, 5000).collect()]
    assert len(set(got)) == len(got) == 100
    assert got == [r["doc_id"] for r in common.hash_sample(ids.repartition(7), 100, 5000).collect()]
    assert common.hash_sample(ids, 9000, 5000).count() == 5000 and common.hash_sample(ids.where("false"), 10, 0).count() == 0
    hot = ids.withColumn("doc_id", F.when(F.col("doc_id") < 2000, F.lit(7)).otherwise(F.col("doc_id")))
    assert common.hash_sample(hot, 100, 5000).distinct().count() == 100


def test_checkpoint_dir_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        common.checkpoint_dir(Session)


def test_sample_of_languages_with_a_hot_row(spark):
    """A third of all rows are one row; every language is learned."""
    signs = {"aa": "abcde", "bb": "xyzuv", "cc": "mnopq"}
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice(signs[k]) for _ in range(5)) for _ in range(9)), k) for i, k in enumerate(["aa"] * 200 + ["bb"] * 200 + ["cc"])]
    rows += [(1, "abcde abcde", "aa")] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df, max_rows=60, held_out_mod=1, held_out_rest=1)
    assert model.languages == ["aa", "bb", "cc"]
    assert [model.predict(t)[0] for t in ("edcba", "zuvxy")] == ["aa", "bb"]
    with pytest.raises(ValueError):
        language_id.train(df, max_languages=2)


def test_ftrl_against_plain_steps():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(50, 6, False)), rng.random(6), int(rng.integers(3))) for _ in range(40)]
    w, b = language_id.fit_ftrl(rows, 3, rounds=2, alpha=0.5, beta=1.0, l1=0.03, l2=0.01, seed=1)
    z, n = {}, {}
    order = np.random.default_rng(1)

    def weight(k, c):
        zz, nn = z.get((k, c), 0.0), n.get((k, c), 0.0)
        return 0.0 if abs(zz) <= 0.03 else -(zz - math.copysign(0.03, zz)) / ((1.0 + math.sqrt(nn)) / 0.5 + 0.01)

    for _ in range(2):
        for r in order.permutation(len(rows)):
            at, v, y = rows[r]
            terms = [*zip(at.tolist(), v.tolist()), (language_id.BUCKETS, 1.0)]
            logits = [sum(x * weight(k, c) for k, x in terms) for c in range(3)]
            total = sum(map(math.exp, logits))
            old = {(k, c): weight(k, c) for k, _ in terms for c in range(3)}
            for k, x in terms:
                for c in range(3):
                    g = x * (math.exp(logits[c]) / total - (c == y))
                    nn = n.get((k, c), 0.0)
                    z[k, c] = z.get((k, c), 0.0) + g - (math.sqrt(nn + g * g) - math.sqrt(nn)) / 0.5 * old[k, c]
                    n[k, c] = nn + g * g
    want = np.array([[weight(k, c) for c in range(3)] for k in range(50)])
    assert np.allclose(w[:50], want) and np.allclose(b, [weight(language_id.BUCKETS, c) for c in range(3)])
    assert (w[50:] == 0).all() and (w == 0).any()


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(6)
    y = (rng.random(4000) < 0.3).astype(int)
    rate = {1: (0.7, 0.6, 0.5), 0: (0.05, 0.1, 0.2)}
    one = np.array([[rng.random() < rate[c][k] for k in range(3)] for c in y], float)
    votes = np.column_stack([one, one[:, 2], np.where(rng.random(4000) < 0.95, one[:, 2], 1 - one[:, 2])])  # two copies of the weakest voter
    labels = np.where(rng.random(4000) < 0.1, y, -1)
    post, fit = toxicity.fit_label_model(votes, labels)
    tree = fit["parent"]
    linked = {frozenset((k, int(p))) for k, p in enumerate(tree) if p >= 0}
    assert frozenset((2, 3)) in linked and linked & {frozenset((2, 4)), frozenset((3, 4))}
    exact = np.array([0.3 * np.prod([rate[1][k] if v else 1 - rate[1][k] for k, v in enumerate(r[:3])]) for r in votes])
    other = np.array([0.7 * np.prod([rate[0][k] if v else 1 - rate[0][k] for k, v in enumerate(r[:3])]) for r in votes])
    free = labels < 0
    assert np.abs(post - exact / (exact + other))[free].mean() < 0.06
    assert ((post > 0.5) == y)[free].mean() > 0.87


def test_linear_classifier_and_ties():
    rng = np.random.default_rng(7)
    x = (rng.random((300, 4)) < 0.4).astype(float)
    target = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0, 3.0] - 1.0)))
    w, b = toxicity.fit_linear(x, target)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = np.append(x, np.ones((300, 1)), 1).T @ (target - p) - np.append(0.05 * w, 1e-3 * b)
    assert np.abs(slope).max() < 1e-2 and np.allclose(w, [2, -1, 0, 3], atol=0.2)


def test_scores_with_clashing_columns_empty_tables_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron", "a", 5, "x"), (1, "you idiot, you moron", "a", 5, "x"), (None, None, "b", 6, "y"), (2, "", "c", 7, "z")], "doc_id bigint, text string, score string, predicted int, `a,b` string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    for model in (toxicity.train(docs, none), toxicity.train(docs.limit(0), none)):
        got = toxicity.score_documents(docs, model, ["score", "text", "a,b"])
        assert got.columns == ["doc_id", "score_of_docs", "text", "a,b", "score", "predicted"]
        rows = got.collect()
        assert len(rows) == 4 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and len({r["score"] for r in rows if r["doc_id"] != 1}) == 1
        assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert {(r["doc_id"], r["predicted"]) for r in toxicity.score_documents(docs, toxicity.train(docs.limit(0), none)).collect()} == {(1, 1), (None, 0), (2, 0)}
    langs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("lang_pred", F.lit("q"))
    got = language_id.predict_documents(langs, language_id.train(langs), ["lang_pred", "a,b"])
    assert got.columns == ["doc_id", "lang_pred_of_docs", "a,b", "lang_pred", "score"] and {r["lang_pred"] for r in got.collect()} == {"und"}
    assert language_id.predict_documents(langs.limit(0), language_id.train(langs.limit(0))).count() == 0


def test_score_is_recomputed_from_the_whole_text(spark):
    """Against the weights summed over features made the long way; a feature at the end of a long text counts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(20)] + ["zork" + word() for _ in range(3)] * (i % 6 == 0))) for i in range(300)]
    rows.append((999, " ".join(word() for _ in range(60_000)) + " zorkaeiou zorktnrsl zorklllll idiot"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id bigint, toxic int"))
    weight = dict(zip(model.names, model.weights))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    for i, t in rows:
        x = model.intercept + sum(weight.get(f, 0.0) for f in toxicity.features(t))
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-40, min(40, x)))), rel_tol=1e-9)
    assert got[999] > 0.5 > got[1]
