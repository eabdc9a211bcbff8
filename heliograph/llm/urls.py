"""URL filters: host and path rules, and character language models for urls that no rule fits.

Two smoothed variable-order Markov models, one of accepted and one of rejected urls, give each
url a log-likelihood difference; it is divided by the url's length and calibrated to a
probability on labelled urls that the models have not seen. Smoothing interpolates each order
with the next shorter one by the number of different continuations (Witten and Bell).

In the query the rules label the urls. All labelled urls are learned from; at most ``SAMPLE`` of
those held back, chosen by a hash of the url, calibrate the probability.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import textkit as tk
from heliograph.llm.common import arrow_map, batch, extended, share_under, table

SAMPLE, ORDER, FOLDS, LEAST = 4_000, 5, 5, 3


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The query's rules.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits the host (subdomains too) and the start of the path, and its verdict; ties: block."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    pick = lambda value: F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, ordered, strict=True)]) if rules else F.lit(None).cast("string")
    return pick(lambda r: r.text), pick(lambda r: r.verdict)


COUNTS = pa.schema([("label", pa.int32()), ("order", pa.int32()), ("context", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])
EMPTY = 0x5DEECE66D


def _grams(texts: list[str]):
    """For each order: text numbers, hashes of the contexts and of contexts with their next character."""
    b = tk.Block([f"\x02{t}\x03" for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(b.off))
    at = np.flatnonzero(np.arange(len(b.cp)) > b.off[doc])
    for k in range(ORDER + 1):
        i = at[at - k >= b.off[doc[at]]]
        context = b.hashes(i - k, i) if k else np.full(len(i), EMPTY, tk.U)
        yield i, doc[i], context, b.hashes(i - k, i + 1)


def _counts(it):
    for b in it:
        labels, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        for label in (0, 1):
            own = [t for t, x in zip(texts, labels, strict=True) if x == label]
            for order, (_, _, c, g) in enumerate(_grams(own) if own else ()):
                grams, first, n = np.unique(g, return_index=True, return_counts=True)
                yield batch(COUNTS, [np.full(len(grams), label, np.int32), np.full(len(grams), order, np.int32), tk.signed(c[first]), tk.signed(grams), n])


class Model(NamedTuple):
    grams: tk.Lookup
    counts: np.ndarray
    contexts: tk.Lookup
    totals: np.ndarray
    kinds: np.ndarray
    symbols: int
    slope: float = 1.0
    offset: float = 0.0


def difference(m: Model, texts: list[str]) -> np.ndarray:
    """Log-likelihood of the accepted model minus that of the rejected one, divided by the number of characters."""
    if not texts:
        return np.zeros(0)
    held = None
    for i, doc, context, gram in _grams(texts):
        if held is None:
            where, number = np.full(int(i.max()) + 1, -1), doc
            where[i] = np.arange(len(i))
            held = np.full((2, len(i)), 1.0 / m.symbols)
        row, of = where[i], m.contexts(context)
        known = of >= 0
        row, of, g = row[known], of[known], m.grams(gram[known])
        for label in (0, 1):
            n, kinds = m.totals[label][of], m.kinds[label][of]
            seen = n > 0
            count = np.where(g >= 0, m.counts[label][g], 0)[seen]
            held[label][row[seen]] = (count + kinds[seen] * held[label][row[seen]]) / (n + kinds)[seen]
    p = np.log(held[1]) - np.log(held[0])
    return np.bincount(number, p, len(texts)) / np.bincount(number, minlength=len(texts))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From (label int: 1 accepted, 0 rejected; url string). None if a class has no url.

    Each labelled url counts once, however many rows it has. N-grams are counted on the executors over
    all of them; those of two characters or more that fewer than ``LEAST`` urls' places have are pruned, as they
    say no more than their shorter contexts. At most ``sample`` urls calibrate the probability.
    """
    urls_ = labelled.filter("label is not null").groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.min("label").alias("label"))
    later = F.pmod(F.xxhash64("url", F.lit("calibration")), F.lit(FOLDS)) == 0
    counts = arrow_map(urls_.filter(~later).select("label", "url"), _counts, "label int, order int, context long, gram long, n long").groupBy("label", "order", "context", "gram").agg(F.sum("n").alias("n"))
    got = counts.filter((F.col("order") == 0) | (F.col("n") >= LEAST)).select("label", "context", "gram", "n").toArrow()
    if len(set(got.column("label").to_pylist())) < 2:
        return None
    label, n = got.column("label").to_numpy(), got.column("n").to_numpy().astype(np.float32)
    grams, g = np.unique(got.column("gram").to_numpy().view(tk.U), return_inverse=True)
    contexts, c = np.unique(got.column("context").to_numpy().view(tk.U), return_inverse=True)
    counts, totals, kinds = np.zeros((2, len(grams)), np.float32), np.zeros((2, len(contexts)), np.float32), np.zeros((2, len(contexts)), np.float32)
    np.add.at(counts, (label, g), n)
    np.add.at(totals, (label, c), n)
    np.add.at(kinds, (label, c), 1)
    model = Model(tk.Lookup(grams), counts, tk.Lookup(contexts), totals, kinds, 256)
    held = urls_.filter(later)
    rows = share_under(held, F.col("url"), sample, held.count()).select("label", "url").orderBy("url").toArrow()
    y, x = rows.column("label").to_numpy().astype(float), difference(model, rows.column("url").to_pylist())
    return model._replace(**_platt(x, y))


def _platt(x: np.ndarray, y: np.ndarray) -> dict:
    """Slope and offset of a logistic curve with a small ridge; classes weigh the same."""
    if len(set(y.tolist())) < 2:
        return {}
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * a
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return {"slope": float(a[0]), "offset": float(a[1])}


def score(df: DataFrame, model: Model | None, url_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and p_allow: the calibrated probability; 1 if there is no model."""
    kept = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return df.select(*kept, F.lit(1.0).alias("p_allow"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    out = df.select(*kept, F.coalesce(F.col(url_col), F.lit("")).alias("url__"))

    def run(it):
        m = sent.value
        for b in it:
            texts = b.column(len(keep)).to_pylist()
            x = np.concatenate([difference(m, k.texts) for _, _, k in tk.blocks(texts)] or [np.zeros(0)])
            p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p, pa.float64())], names=[*keep, "p_allow"])

    return arrow_map(out, run, extended(out.drop("url__").schema, "p_allow double"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """A verdict for each row: the longest fitting rule's, else allow if the model's probability is 0.5 or more.

    Null urls and those without :// have an empty host and path and fit no rule; the model
    judges them by their text (null: empty). Where the rules don't label urls of both kinds,
    the rest is allowed. Repeated rows stay; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict})
    model = train(ruled.filter("ruled is not null").select((F.col("ruled") == "allow").cast("int").alias("label"), "url"), sample)
    out = score(ruled, model, "url", ["page_id", "host", "path", "rule", "ruled"])
    by_model = F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "p_allow")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)
