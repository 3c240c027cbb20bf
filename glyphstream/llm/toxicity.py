"""Toxicity by weak supervision.

1. Lexicon voters are mined: words and word beginnings that go with label 1 in a bounded, hashed
   sample of labelled rows (counts by Spark).  Pattern voters and a small general lexicon join.
2. A generative label model is fitted by EM over the voters' answers on labelled and unlabelled sample
   rows.  Its parameters are the voters' accuracies and correlations: within each class a voter's rate
   depends on the answer of the one voter it goes with most (a tree of correlations, by conditional
   mutual information).  A label is one more voter, whose accuracy is estimated too.
3. A linear classifier is trained on the posterior labels, over the voters' features.
4. Every whole text is scored in one scan; the model is a few kB in the task's closure.

Texts that are null or empty have no feature and get the intercept's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.common import crc_mod, cut, hash_sample, kept_names, slices

#: Insults that vote before any label has been seen.
LEXICON = ("asshole", "bastard", "bitch", "clown", "cretin", "damn", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "liar", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
#: Patterns that vote.
PATTERNS = {"shouting": r"(?:\b[A-Z]{4,}\b\W+){3}", "marks": r"[!?]{3,}", "masked": r"\b[A-Za-z][*@#$]{2,}[A-Za-z]?", "address": r"(?i)\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|fool|loser|trash|scum)"}
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
STARTS = (3, 4, 5, 6, 7, 8)


def features(text: str) -> set[str]:
    """Distinct words ("=word"), word beginnings and patterns ("~name") of a text.

    "1beg", "2beg", "3beg": at least so many distinct longer words begin so.
    """
    words = set(_WORD.findall(text.lower()))
    found = {f"={w}" for w in words}
    for k in STARTS:
        for beg, n in Counter([w[:k] for w in words if len(w) > k]).items():
            found.update(f"{i}{beg}" for i in range(1, min(n, 3) + 1))
    return found | {f"~{k}" for k, p in _PATTERNS.items() if p.search(text)}


class Finder:
    """Which of a fixed list of features a text has, without making the others."""

    def __init__(self, names: list[str]):
        at = {n: i for i, n in enumerate(names)}
        self.words = {n[1:]: i for n, i in at.items() if n[0] == "="}
        self.starts: dict[int, dict[str, list]] = {}
        for n, i in at.items():
            if n[0] in "123":
                self.starts.setdefault(len(n) - 1, {}).setdefault(n[1:], []).append((int(n[0]), i))
        self.patterns = [(_PATTERNS[n[1:]], i) for n, i in at.items() if n[0] == "~"]

    def __call__(self, text: str) -> list[int]:
        words = set(_WORD.findall(text.lower()))
        found = [self.words[w] for w in words & self.words.keys()]
        for k, own in self.starts.items():
            if hits := [b for b in [w[:k] for w in words if len(w) > k] if b in own]:
                found += [i for b, n in Counter(hits).items() for least, i in own[b] if n >= least]
        return found + [i for p, i in self.patterns if p.search(text)]


@dataclass
class ToxicityModel:
    names: list[str]
    weights: np.ndarray
    intercept: float
    voters: dict = field(default_factory=dict)

    def score(self, finder: Finder, text: str) -> float:
        x = self.intercept + float(self.weights[finder(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def mine_voters(rows: DataFrame, most: int, false_share: float = 0.05) -> list[str]:
    """Features of label 1 in rows (label, text), strongest first: at most `most` of them.

    Strength is the log-likelihood gain, ties go by name.  The list ends where, by chance alone, more than
    `false_share` of its features would be expected there (Benjamini-Hochberg over all features).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            n, pos = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = features(text or "")
                n.update(own)
                if label:
                    pos.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[k] for k in n], pa.int64())], ["feature", "n", "pos"])

    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, p = total["n"], total["pos"] or 0
    if not n or not p or p == n:
        return []
    base = p / n
    counts = rows.mapInArrow(count, "feature string, n bigint, pos bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rate = F.col("pos") / F.col("n")
    part = lambda k, q, r: F.when(k > 0, k * F.log(q / r)).otherwise(0.0)
    gain = 2 * (part(F.col("pos"), rate, F.lit(base)) + part(F.col("n") - F.col("pos"), 1 - rate, F.lit(1 - base)))
    counts = cut(counts)
    tested = max(1, counts.count())
    strong = counts.where(rate >= max(0.5, base)).withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(most).collect()  # `most` bounds it
    chances = [math.erfc(math.sqrt(max(0.0, r["gain"]) / 2)) for r in strong]
    sure = max((k for k, p in enumerate(chances, 1) if p <= false_share * k / tested), default=0)
    return [r["feature"] for r in strong[:sure]]


def correlation_tree(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """For each voter the voter that its rates depend on, or -1: a maximum spanning forest of conditional mutual information.

    Only pairs whose information could not arise by chance among all pairs (at 0.01) are linked.
    """
    v, info = votes.shape[1], 0.0
    for w in (post, 1 - post):
        total = w.sum() + 2.0
        both = (votes * w[:, None]).T @ votes
        one = both.diagonal()
        cells = (both, one[:, None] - both, one[None, :] - both, total - 2 - one[:, None] - one[None, :] + both)
        p = (one + 0.5) / total
        q = [(p[:, None] * p[None, :]), (p[:, None] * (1 - p[None, :])), ((1 - p[:, None]) * p[None, :]), ((1 - p[:, None]) * (1 - p[None, :]))]
        info = info + sum(np.maximum(c, 0) * np.log((np.maximum(c, 0) + 0.25) / (total * x + 0.25)) for c, x in zip(cells, q))
    np.fill_diagonal(info, 0)
    least = math.log(max(2, v * v) / 0.01)
    parent, best, via, waits = np.full(v, -1), np.zeros(v), np.full(v, -1), np.ones(v, bool)
    for _ in range(v):
        u = int(np.argmax(np.where(waits, best, -1.0)))
        waits[u] = False
        parent[u] = via[u] if best[u] >= least else -1
        nearer = waits & (info[u] > best)
        best[nearer], via[nearer] = info[u][nearer], u
    return parent


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 10, trust: float = 0.97) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row; labels are 1, 0 or -1 (none).

    votes: rows x voters of 0/1.  rates[c][a] has each voter's rate in class c given that the voter it
    depends on answered a.  `trust` is the label's first accuracy, worth 200 rows.
    """
    known, v = labels >= 0, votes.shape[1]
    start = np.clip(votes.sum(1) * 0.3 + 0.02, 0.02, 0.9)
    post = np.where(known, np.where(labels == 1, trust, 1 - trust), start)
    right, rates, parent = trust, {}, np.full(v, -1)
    for k in range(2 * rounds):
        if k in (0, rounds):  # the second tree goes by the posteriors that the first one gave
            parent = correlation_tree(votes, post)
            given = np.where(parent >= 0, votes[:, parent], 0.0)  # the answer that each voter's rate depends on
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        logit = np.full(len(votes), np.log(prior / (1 - prior)))
        for c, w in ((1, post), (0, 1 - post)):
            alone = (w @ votes + (0.5 if c else 0.05)) / (w.sum() + 1)
            rates[c] = []
            for a in (0, 1):
                has = given == a
                rates[c].append(np.clip((w @ (votes * has) + 2 * alone) / (w @ has + 2), 1e-6, 1 - 1e-6))
            rate = np.where(given == 1, rates[c][1], rates[c][0])
            own = np.where(votes == 1, np.log(rate), np.log1p(-rate)).sum(1)
            logit += own if c else -own
        logit += np.where(known, np.where(labels == 1, 1, -1) * np.log(right / (1 - right)), 0)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        right = float(np.clip((np.where(labels == 1, post, 1 - post)[known].sum() + 200 * trust) / (known.sum() + 200), 0.55, 0.999))
    return post, {"rates": rates, "parent": parent, "label_accuracy": right}


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (target - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, held_out_mod: int = 5, held_out_rest: int = 0, max_rows: int = 12_000, max_voters: int = 256) -> ToxicityModel:
    """The model from docs (doc_id, text) and labels (doc_id, toxic).

    Only rows whose crc32(doc_id as text) modulo held_out_mod isn't held_out_rest are looked at.
    max_rows bounds the labelled sample and a quarter of it the unlabelled one; the choice goes by a hash of
    doc_id.  max_voters bounds the mined voters.  Of several labels of a document the largest holds, of several texts of
    a doc_id the one with the least hash; null doc_ids and null labels teach nothing, a null text is empty.
    Without rows to learn from, lexicon and patterns alone vote: two of them make a text toxic.
    """
    free = docs.select("doc_id", "text").where("doc_id is not null").where(crc_mod("doc_id", held_out_mod) != held_out_rest)
    own = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", held_out_mod) != held_out_rest)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))

    def rows_of(chosen: DataFrame) -> DataFrame:
        """(label, text) of the chosen documents; max_rows bounds them and what each task sends."""
        hits = free.join(F.broadcast(chosen), "doc_id")
        return hits.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")

    labelled = rows_of(hash_sample(own.select("doc_id"), max_rows, own.count()).join(own, "doc_id"))
    unlabelled = rows_of(hash_sample(free.select("doc_id"), max_rows // 4, free.count()).select("doc_id", F.lit(-1).alias("label")))
    labelled = cut(labelled)
    names = mine_voters(labelled, max_voters)
    names = list(dict.fromkeys(names + [f"={w}" for w in LEXICON] + [f"~{k}" for k in PATTERNS]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names)
        for batch in slices(batches, "text", 8 << 20):
            found = [sorted(finder(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["label", "votes"])

    rows = labelled.unionByName(unlabelled).mapInArrow(vote, "label int, votes array<int>").collect()  # max_rows bounds it
    if not rows:
        return ToxicityModel(names, np.full(len(names), 2.5), -3.0)
    rows = sorted((r["label"], r["votes"]) for r in rows)
    x, y = np.zeros((len(rows), len(names)), np.float64), np.array([label for label, _ in rows], int)
    for k, (_, own_votes) in enumerate(rows):
        x[k, own_votes] = 1
    used = x.sum(0) > 0
    names, x = [n for n, u in zip(names, used) if u] or names[:1], x[:, used] if used.any() else x[:, :1]
    post, voters = fit_label_model(x, y)
    weights, intercept = fit_linear(x, post)
    return ToxicityModel(names, weights, intercept, voters)


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and, between them, the columns of docs named in keep; one row for each row of docs.

    A null or empty text gets the intercept's score, a null doc_id stays null, equal rows get equal scores, an
    empty table gives no row.  A kept column named like a result gets `_of_docs` behind its name.
    """
    own = kept_names(list(keep), ["doc_id", "score", "predicted"])
    rows = docs.select(F.col("doc_id").alias("_0"), F.col("text").cast("string").alias("_1"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep, 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.names)
        for batch in slices(batches, "_1", 4 << 20):
            scores = [model.score(finder, t or "") for t in batch.column(1).to_pylist()]
            cols = [batch.column(k) for k in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", *own, "score", "predicted"])

    types = [t for _, t in rows.dtypes]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(["doc_id", *own], [types[0], *types[2:]])) + ", score double, predicted int"
    return rows.mapInArrow(run, schema)
