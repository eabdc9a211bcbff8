"""Toxicity by weak supervision.

1. Terms: words and word beginnings that are far more frequent in labelled toxic documents.
2. Voters: lexicons of words, patterns of word beginnings, density patterns and absence rules;
   each says toxic, clean or nothing about a document.
3. A generative label model (EM) estimates each voter's answers given the hidden class, and the
   correlations of the voters within a class: each answer depends on the class and, where they are
   strongly tied, on one other voter, in the tree of the largest mutual information. The given labels choose the terms only;
   they are no voter, and the first guess of the classes is the voters' own.
4. A linear classifier is trained on the posterior labels and scores every whole text.

Learned from at most ``SAMPLE`` labelled documents (chosen by a hash of the id); what the
driver and the workers hold is bounded by that and by ``TERMS``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import textkit as tk
from heliograph.llm.common import arrow_map, batch, extended, in_fold, share_under, table

SAMPLE, TERMS, LEAST, GAIN = 20_000, 600, 4, 24.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)
GROUPS, EXTRA, AGREE, TIED = 12, 6, 3, 0.05
WHOLE = np.uint64(0x51ED270B0B0B0B0B)


def _keys(texts: list[str]) -> tuple[tk.Block, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(text number, key) of all words, then of all beginnings of each length; and words per text."""
    b = tk.Block([t.lower() for t in texts])
    s, e, doc = b.letters()
    out = [(doc, b.hashes(s, e) ^ WHOLE)]
    for n in BEGINNINGS:
        longer = e - s > n
        out.append((doc[longer], b.hashes(s[longer], s[longer] + n)))
    return b, out, np.bincount(doc, minlength=len(texts))


TERM_COUNTS = pa.schema([("key", pa.int64()), ("whole", pa.bool_()), ("label", pa.int32()), ("n", pa.int64())])


def _term_counts(it):
    """In how many documents of each label a term is."""
    for b in it:
        labels = b.column(1).to_numpy()
        for lo, hi, block in tk.blocks(b.column(0).to_pylist()):
            own = labels[lo:hi]
            for k, (doc, key) in enumerate(_keys(block.texts)[1]):
                pair = np.unique(np.stack([doc.astype(tk.U), key]), axis=1) if len(doc) else np.zeros((2, 0), tk.U)
                for label in (0, 1):
                    keys, n = np.unique(pair[1][own[pair[0].astype(int)] == label], return_counts=True)
                    yield batch(TERM_COUNTS, [tk.signed(keys), [k == 0] * len(keys), np.full(len(keys), label, np.int32), n])


class Terms(NamedTuple):
    find: tk.Lookup
    whole: np.ndarray
    keys: np.ndarray


def pick_terms(counts: pa.Table, toxic: int, clean: int) -> Terms:
    """The terms with the largest signed log-likelihood ratio among those ten times as frequent in toxic documents."""
    key = counts.column("key").to_numpy().view(tk.U)
    x, y = counts.column("toxic").to_numpy().astype(float), counts.column("clean").to_numpy().astype(float)
    whole = counts.column("whole").to_numpy(zero_copy_only=False)
    p, q = (x + 0.1) / max(toxic, 1), (y + 0.1) / max(clean, 1)
    gain = np.where((x >= LEAST) & (p > 10 * q), x * np.log(p / q), 0)
    gain[gain < GAIN] = 0
    order = np.lexsort((key, -gain))
    ordered = order[gain[order] > 0]
    at = np.concatenate([ordered[whole[ordered] == kind][: TERMS // 2] for kind in (True, False)])
    return Terms(tk.Lookup(key[at]), whole[at], key[at])


def features(terms: Terms, texts: list[str]) -> np.ndarray:
    """log(1 + count) of each term, then totals and densities of words and of beginnings, and the log length."""
    n, out = len(terms.keys), np.zeros((len(texts), len(terms.keys) + EXTRA))
    _, keys, words = _keys(texts)
    for doc, key in keys:
        row = terms.find(key)
        hit = row >= 0
        np.add.at(out, (doc[hit], row[hit]), 1)
    for j, kind in enumerate((True, False)):
        own = out[:, :n][:, terms.whole == kind]
        total = own.sum(1)
        out[:, n + j], out[:, n + 2 + j] = np.log1p(total), np.log1p(1000 * total / np.maximum(words, 30))
    distinct = (out[:, :n] > 0).sum(1)
    out[:, n + 4] = np.log1p(distinct)
    out[:, :n] = np.log1p(out[:, :n])
    out[:, n + 5] = 0.1 * np.log1p(words)
    return out


def votes(terms: Terms, x: np.ndarray) -> np.ndarray:
    """A column for each voter: 1 toxic, 0 clean, -1 no answer."""
    n, out = len(terms.keys), []
    for kind in (True, False):
        own = np.flatnonzero(terms.whole == kind)
        for g in range(min(GROUPS, len(own))):
            out.append(np.where((x[:, own[g::GROUPS]] > 0).any(1), 1, -1))
        out.append(np.where((x[:, own] > 0).any(1), -1, 0))
    for column, least in ((n + 2, np.log1p(3.0)), (n + 3, np.log1p(5.0)), (n + 4, np.log1p(2.0)), (n + 4, np.log1p(4.0))):
        out.append(np.where(x[:, column] >= least, 1, -1))
    return np.stack(out, 1)


class LabelModel(NamedTuple):
    """A voter's answers given the class, and given the class and the answer of the voter it depends on most."""

    prior: float
    answers: np.ndarray  # voter, class, answer (-1, 0, 1 at 0, 1, 2)
    joint: np.ndarray  # class, voter and answer, voter and answer
    information: np.ndarray  # conditional mutual information of each two voters given the class
    parent: np.ndarray  # -1: depends on the class alone


def _tree(information: np.ndarray) -> np.ndarray:
    """Parents in the spanning tree of the largest mutual information (Chow and Liu), without its weak edges.

    Weakly dependent voters are left to the class: their dependence would explain away what they say of it.
    """
    n = len(information)
    parent, source, best, done = np.full(n, -1), np.zeros(n, int), information[0].copy(), np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        j = int(np.argmax(np.where(done, -np.inf, best)))
        parent[j], done[j] = source[j] if best[j] >= TIED else -1, True
        closer = ~done & (information[j] > best)
        source[closer], best[closer] = j, information[j][closer]
    return parent


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 40) -> tuple[LabelModel, np.ndarray]:
    """EM over voters' answers from a first guess of the posterior; also the posterior it ends with.

    In each round the accuracies and the correlations within the classes are estimated anew, and a
    voter's answer is explained by the class and by the voter that it depends on most: what
    voters repeat counts once.
    """
    n, post, model = v.shape[1], np.clip(start.astype(float), 0.02, 0.98), None
    one = (v[:, :, None] == np.array([-1, 0, 1])).reshape(len(v), 3 * n).astype(float)
    for _ in range(rounds):
        prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
        answers, joint, information = np.zeros((n, 2, 3)), np.zeros((2, 3 * n, 3 * n)), np.zeros((n, n))
        for c, w in ((0, 1 - post), (1, post)):
            # as if each two voters had given each pair of answers a sixth of a time
            total = w.sum() + 1.5
            single, joint[c] = (w @ one + 0.5) / total, (one.T @ (w[:, None] * one) + 0.5 / 3) / total
            answers[:, c] = single.reshape(n, 3)
            information += (total / len(v)) * (joint[c] * np.log(joint[c] / np.outer(single, single))).reshape(n, 3, n, 3).sum((1, 3))
        model = LabelModel(prior, answers, joint, information, _tree(information))
        now = posterior(model, v)
        change, post = np.abs(now - post).max(), now
        if change < 1e-6:
            break
    return model, post


def posterior(m: LabelModel, v: np.ndarray) -> np.ndarray:
    a, total = v + 1, np.full(len(v), np.log(m.prior / (1 - m.prior)))
    for j, p in enumerate(m.parent):
        for c, sign in ((0, -1), (1, 1)):
            given = m.answers[j, c][a[:, j]] if p < 0 else m.joint[c][3 * p + a[:, p], 3 * j + a[:, j]] / m.answers[p, c][a[:, p]]
            total += sign * np.log(given)
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, an offset for soft labels, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    a = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * a)
        a -= step
        if np.abs(step).max() < 1e-6:
            break
    return a


class Model(NamedTuple):
    terms: Terms
    weights: np.ndarray
    labels: LabelModel


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, sample: int) -> DataFrame:
    """(text, label) of at most about ``sample`` labelled documents. A document with several labels has their maximum."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    part = share_under(own, F.col("doc_id"), sample, own.count()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(part), "doc_id").select("text", "label")


def without_copies(part: DataFrame) -> DataFrame:
    """One of each group of exact copies with a label, so that no copied text makes its words look typical. Copies have the same two hashes of the whole text."""
    both = [F.xxhash64("text", F.lit(salt)) for salt in (1, 2)]
    return part.withColumns({"a__": both[0], "b__": both[1]}).dropDuplicates(["a__", "b__", "label"]).drop("a__", "b__")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From labels (doc_id, toxic) and documents (doc_id, text); None if a class is missing.

    Null labels and ids are passed over, null texts are empty, a document with several labels has
    their maximum, exact copies with one label count once; other columns are ignored. Ties among terms go
    by their hash, and the result doesn't depend on the order of rows.
    """
    part = labelled_texts(docs, labels, "toxic", sample)
    sizes = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    part = without_copies(part)
    sizes = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    counts = arrow_map(part, _term_counts, "key long, whole boolean, label int, n long").groupBy("key", "whole").agg(of(1).alias("toxic"), of(0).alias("clean")).filter((F.col("toxic") >= LEAST) & (F.col("toxic") * sizes[0] > F.col("clean") * (10 * sizes[1])))
    terms = pick_terms(counts.toArrow(), sizes[1], sizes[0])
    n = len(terms.keys) + EXTRA

    def described(it):
        for b in it:
            texts = b.column(0).to_pylist()
            x = np.concatenate([features(terms, k.texts) for _, _, k in tk.blocks(texts)] or [np.zeros((0, n))]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    got = arrow_map(part, described, "x binary").toArrow()
    # in one order, whatever the order of rows
    x = np.frombuffer(b"".join(sorted(got.column("x").to_pylist())), np.float32).reshape(got.num_rows, n).astype(float)
    ballots = votes(terms, x)
    # the first guess is the voters' own: some of them say toxic
    labels_, post = label_model(ballots, (ballots == 1).sum(1) >= AGREE)
    return Model(terms, logistic(x, post), labels_)


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and score, of every whole text (null: empty), repeated rows and null ids included. 0 for all if there is no model; an empty table gives none."""
    kept = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights))
    out = docs.select(*kept, F.col(text_col).cast("string").alias("text__"))

    def run(it):
        terms, w = sent.value
        for b in it:
            z = np.concatenate([features(terms, k.texts) @ w[:-1] + w[-1] for _, _, k in tk.blocks(b.column(len(keep)).to_pylist())] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*keep, "score"])

    return arrow_map(out, run, extended(out.drop("text__").schema, "score double"))


#: The query's contract: labels in fold 1 of 3 are never learned from; a score of 0.7 or more is predicted toxic.
PARTS, HELD, CUT = 3, 1, 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~in_fold("doc_id", PARTS, HELD)))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", PARTS, HELD).alias("held_out"), "text")
    return score(marked, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
