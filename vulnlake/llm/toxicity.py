"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

1. Word and word-start statistics of a bounded sample of labelled rows give lexicons: leaning words are dealt into several,
   word starts (which also fit unseen forms) into others. With a fixed list and patterns they form the voters.
2. The label model is a two-class mixture: for each voter the chance of each vote under each class, by expectation and
   maximisation; given labels take part as one more voter of limited accuracy. What voters have in common beyond the
   class (their correlation within it) divides their weight.
3. A logistic regression learns the posteriors from the words and word starts that stand out and are not explained by
   others. Only it scores: texts alone, whole, one pass.

Edge cases. A null text is empty and gets the score of no words. Labels that are null, or of unknown documents, are left
out; several labels of a document count as their maximum. Documents without doc_id are scored and held out. Without
labelled rows every score is 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import ship, table, text_of, written
from vulnlake.llm.registry import query

#: Bound on the labelled rows that the model is fitted to (those with the smallest hashes of their doc_id).
MAX_TRAIN = 24_000
#: How many documents must have a feature.
LEAST_DOCS = 3
LEXICONS, STEMS, FOLDS = 8, (5,), 5
#: Rows with so many chosen features count as explained.
ENOUGH_HITS = 4
#: Assumed accuracy of a given label.
LABEL_ACCURACY = 0.95
#: A small general list (fixed values).
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "dumb", "fool", "imbecile", "jerk", "garbage", "vermin", "filth", "dummkopf", "trottel", "imbécile", "crétin", "idiota", "estúpido", "imbécil"]
WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Lower-case words, and their starts marked by ``^``."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in STEMS))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of the sampled rows. Their ids are at most ``most`` and are broadcast; texts are not shuffled."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return written(text_of(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic"), "toxicity-train")


def statistics(train: DataFrame) -> DataFrame:
    """feature, docs and toxic documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                f = features(text)
                n.update(f)
                if y:
                    toxic.update(f)
        keys = list(n)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[k] for k in part], pa.int64()), pa.array([toxic[k] for k in part], pa.int64())], ["feature", "n", "toxic"])

    return train.select("text", "toxic").mapInArrow(run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


class Voters:
    """Votes of a text: 1 toxic, -1 not, 0 abstains."""

    def __init__(self, leaning: list[str]):
        words, stems = [w for w in leaning if w[0] != "^"], [w for w in leaning if w[0] == "^"]
        self.lexicons = [set(words[k::LEXICONS]) for k in range(LEXICONS)] + [set(stems[k::LEXICONS]) for k in range(LEXICONS)] + [set(INSULTS)]
        self.any = set(words) | set(INSULTS)
        self.address = re.compile(r"\b(?:you|du|tu|vous|eres|this|that)\W+(?:\w+\W+){0,2}(?:%s)" % "|".join(map(re.escape, sorted(self.any)))) if self.any else None
        self.names = [*(f"words{k}" for k in range(LEXICONS)), *(f"starts{k}" for k in range(LEXICONS)), "list", "address", "several", "dense", "shouting", "marks", "none", "long_clean"]

    def __call__(self, text: str, found: set[str]) -> list[int]:
        hits = len(found & self.any)
        n = len(found)
        votes = [1 if found & lexicon else 0 for lexicon in self.lexicons]
        stems = any(votes[LEXICONS : 2 * LEXICONS])
        votes.append(1 if hits and self.address and self.address.search(text.lower()) else 0)
        votes.append(1 if hits >= 2 else 0)
        votes.append(1 if hits * 100 > n else -1 if hits == 0 and n > 100 else 0)
        capitals = sum(map(str.isupper, text))
        votes.append(1 if capitals * 2 > len(text) > 0 else 0)
        votes.append(1 if text.count("!") * 20 > n > 0 else 0)
        votes.append(-1 if hits == 0 else 0)
        votes.append(-1 if hits == 0 and not stems else 0)
        return votes


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 per row, accuracy (log odds of the votes, voters x 3) and correlation of the voters."""
    n, m = votes.shape
    prior = min(max(given.mean(), 0.001), 0.999)
    seen = np.stack([(votes == v).astype(np.float64) for v in (-1, 0, 1)], axis=2)
    label_odds = np.where(given == 1, 1.0, -1.0) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    # Start from the labels' own split; a label is a voter of accuracy LABEL_ACCURACY.
    post = np.where(given == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY) * 1.0
    weight = np.ones(m)
    for _ in range(rounds):
        chance = [(np.einsum("i,ijv->jv", p, seen) + 0.5) / (p.sum() + 1.5) for p in (1 - post, post)]
        odds = np.log(chance[1]) - np.log(chance[0])
        weight, correlation = discount(votes, post)
        total = np.log(prior / (1 - prior)) + label_odds + np.einsum("ijv,jv,j->i", seen, odds, weight)
        post = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        prior = min(max(post.mean(), 0.001), 0.999)
    return post, odds, correlation


def discount(votes: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the voters' correlation within a class: a group of voters that say the same counts as one."""
    correlation = np.zeros((votes.shape[1],) * 2)
    for p in (1 - post, post):
        mean = p @ votes / max(p.sum(), 1e-9)
        centred = (votes - mean) * np.sqrt(p)[:, None]
        cov = centred.T @ centred / max(p.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation += cov / np.outer(sd, sd) * (p.sum() / len(post))
    np.fill_diagonal(correlation, 0)
    return 1 / (1 + np.maximum(correlation, 0).sum(axis=1)), correlation


def fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on sparse 0/1 features: accelerated gradient steps with per-feature scale."""
    share = np.bincount(cols, minlength=m) / n
    scale = 1 / np.sqrt(share + 1.0 / n)
    w, velocity, bias, bias_velocity = np.zeros(m), np.zeros(m), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))), 0.0
    for k in range(rounds):
        z = bias + np.bincount(rows, weights=(w * scale)[cols], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(cols, weights=error[rows], minlength=m) / n * scale + ridge * w
        momentum, rate = min(0.95, k / (k + 3)), 0.5
        velocity = momentum * velocity - rate * grad
        bias_velocity = momentum * bias_velocity - rate * error.mean()
        w, bias = w + velocity, bias + bias_velocity
    return w * scale, bias


def unexplained(rows: np.ndarray, cols: np.ndarray, n: int, order: list[int], target: np.ndarray, enough: float) -> list[int]:
    """Features, in the given order, that still stand out among the rows that fewer than ENOUGH_HITS chosen before are in.

    Words of copied documents and the like go with toxic rows only because a real insult stands in the same rows."""
    by = np.argsort(cols, kind="stable")
    starts = np.searchsorted(cols[by], np.arange(max(order, default=-1) + 2))
    base, times, chosen = target.mean(), np.zeros(n, np.int64), []
    for f in order:
        own = rows[by[starts[f] : starts[f + 1]]]
        left = own[times[own] < ENOUGH_HITS]
        k, m = target[left].sum(), len(left)
        part = lambda x, e: x * np.log(x / e) if x > 0 else 0.0
        if m and k > m * max(base, 0.85) and 2 * (part(k, m * base) + part(m - k, m * (1 - base))) > enough:
            chosen.append(f)
            times[own] += 1
    return chosen


def fit(train: DataFrame, max_features: int | None = None) -> tuple[dict[str, float], float, dict] | None:
    """Feature weights, bias and what the label model found. All features that pass the test take part (with
    ``max_features``, the first so many). The driver sees these, and votes and feature numbers, of at most MAX_TRAIN rows."""
    size = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = size["n"], size["toxic"] or 0
    if not n or toxic in (0, n):
        return None
    base = toxic / n
    # G squared of (feature, class); a feature must stand out from as many features as were looked at.
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    inside, tested = F.col("n"), statistics(train).where(F.col("n") >= LEAST_DOCS)
    tested = written(tested, "toxicity-features")
    g2 = 2 * (part(F.col("toxic"), inside * base) + part(inside - F.col("toxic"), inside * (1 - base)))
    ranked = tested.select("feature", (F.col("toxic") > inside * base).alias("leans"), (F.col("toxic") / inside).alias("rate"), g2.alias("g2"), F.col("feature").isin(INSULTS).alias("listed"))
    enough = 2 * float(np.log(max(tested.count(), 2)))
    passed = ranked.where((F.col("g2") > enough) | F.col("listed")).orderBy(F.desc("g2"), "feature")
    rows = (passed if max_features is None else passed.limit(max_features)).collect()
    vocabulary = {f: k for k, f in enumerate(sorted({r["feature"] for r in rows} | set(INSULTS)))}
    leaning = [r["feature"] for r in rows if r["leans"] and r["rate"] > 0.5 and r["g2"] > enough]
    names = Voters(leaning).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Voters(leaning)
        for b in batches:
            votes, cols = [], []
            for text in b.column("text").to_pylist():
                found = features(text)
                votes.append(bytes(v + 1 for v in vote(text, found)))
                cols.append(sorted(vocabulary[f] for f in found & vocabulary.keys()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(votes, pa.binary()), pa.array(cols, pa.list_(pa.int32()))], ["doc_id", "toxic", "votes", "cols"])

    got = train.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, votes binary, cols array<int>").toPandas().sort_values("doc_id", ignore_index=True)
    votes = np.stack([np.frombuffer(v, np.uint8) for v in got["votes"]]).astype(np.int8) - 1
    post, odds, correlation = label_model(votes.astype(np.float64), got["toxic"].to_numpy())
    sizes = got["cols"].map(len).to_numpy()
    row, col, target = np.repeat(np.arange(len(got)), sizes), np.concatenate(got["cols"].tolist()).astype(np.int64), post
    order = [vocabulary[r["feature"]] for r in rows if r["leans"]]
    chosen = unexplained(row, col, len(got), order, target, 2 * float(np.log(len(order) + 2)))
    number = np.full(len(vocabulary), -1)
    number[chosen] = np.arange(len(chosen))
    known = number[col] >= 0
    w, bias = fit_linear(row[known], number[col[known]], len(got), len(chosen), target)
    names_of = {k: f for f, k in vocabulary.items()}
    report = {"voters": names, "odds": odds, "correlation": correlation}
    return {names_of[k]: float(w[i]) for i, k in enumerate(chosen)}, float(bias), report


def score(docs: DataFrame, model: tuple[dict[str, float], float, dict] | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    d = text_of(docs)
    if model is None:
        scored = d.select("doc_id", F.lit(0.0).alias("score"))
    else:
        weights, bias, _ = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = weights.keys()
            for b in batches:
                z = np.array([bias + sum(weights[f] for f in sorted(features(t) & keys)) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

        scored = d.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))


ship(__name__)
