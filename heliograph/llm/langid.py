"""Language identification: word-first backoff to character n-grams.

Known words are scored by their log frequency in each language; an unseen word falls back to
its character n-grams (with word bounds), from five characters down to one, and counts with
the mean log frequency of the longest order that has a known n-gram. A text's languages get
the posterior of the summed scores.

Learned from all labelled texts; every text is scored whole. The tables that are sent to the workers
have the words and n-grams of all of them, so they grow with the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import textkit as tk
from heliograph.llm.common import arrow_map, batch, extended, in_fold, table, unused

#: The longest n-gram, and the least count of a word or n-gram that is kept.
LONGEST, LEAST, SMOOTH, CERTAIN = 5, 2, 0.5, 3
WORD = np.uint64(0xA5A5A5A5A5A5A5A5)


class Model(NamedTuple):
    langs: list[str]
    words: tk.Lookup
    word_scores: np.ndarray
    grams: tk.Lookup
    gram_scores: np.ndarray


def _block(texts: list[str]) -> tuple[tk.Block, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts with a bound on each side and a space for whatever is no letter; and their words."""
    b = tk.Block([f" {t.lower()} " for t in texts])
    letter = tk.TABLES.letter[b.cp]
    b.cp = np.where(letter, b.cp, np.uint32(32))
    return (b, *b.runs(letter))


def _windows(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams of words with their bounds (single characters: without), and the number of the word that each is in."""
    bound = int(n > 1)
    per = np.maximum(ends - starts + 2 * bound + 1 - n, 0)
    word = np.repeat(np.arange(len(starts)), per)
    begin = np.cumsum(per) - per
    return starts[word] - bound + np.arange(len(word)) - begin[word], word


COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def _counts(it):
    for b in it:
        langs, texts = np.array(b.column(1).to_pylist(), object), b.column(0).to_pylist()
        for lang in sorted(set(langs)):
            own, parts = [t for t, x in zip(texts, langs, strict=True) if x == lang and t], [[] for _ in range(LONGEST + 1)]
            for _, _, block in tk.blocks(own):
                k, s, e, _ = _block(block.texts)
                parts[0].append(k.hashes(s, e) ^ WORD)
                for n in range(1, LONGEST + 1):
                    at, _ = _windows(s, e, n)
                    parts[n].append(k.hashes(at, at + n))
            for kind, hashes in enumerate(parts):
                keys, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, tk.U), [])
                yield batch(COUNTS, [[lang] * len(keys), [kind] * len(keys), tk.signed(keys), n])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Counts on the executors, of all labelled texts; the driver gets those of words and n-grams.

    Words and n-grams that the texts have less than ``LEAST`` times in a language don't count for it;
    a language all of whose are so rare is not learned. Null texts, languages and ids are passed over,
    repeated rows count once. Frequencies are relative to the language's words, or n-grams of the same length.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    # texts are moved only where an id is there more than once
    repeated = known.groupBy("id").count().filter("count > 1").limit(1).count()
    part = (known.distinct() if repeated else known).select("text", "lang")
    counts = arrow_map(part, _counts, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    got = counts.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    lang, kind = np.searchsorted(np.array(langs, object), got.column("lang").to_numpy()) if langs else np.zeros(0, int), got.column("kind").to_numpy()
    key, n = got.column("key").to_numpy().view(tk.U), got.column("n").to_numpy()

    def logs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, row = np.unique(key[at], return_inverse=True)
        table_ = np.zeros((len(keys), len(langs)))
        np.add.at(table_, (row, lang[at]), n[at])
        return keys, np.log((table_ + SMOOTH) / (table_.sum(0) + SMOOTH * max(1, len(keys))))

    words, word_logs = logs(kind == 0)
    grams = [logs(kind == k) for k in range(1, LONGEST + 1)]
    return Model(langs, tk.Lookup(words), np.ascontiguousarray(word_logs.T), tk.Lookup(np.concatenate([k for k, _ in grams])), np.ascontiguousarray(np.concatenate([x for _, x in grams]).T))


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log frequencies, a row for each text and a column for each language; and the share of each text's words that are known or have a known n-gram of ``CERTAIN`` characters or more."""
    b, s, e, doc = _block(texts)
    total, known = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    if not len(s) or not model.langs:
        return total, known
    words = np.bincount(doc, minlength=len(texts))
    row = model.words(b.hashes(s, e) ^ WORD)
    hit = row >= 0
    known += np.bincount(doc[hit], minlength=len(texts))
    for j in range(len(model.langs)):
        total[:, j] = np.bincount(doc[hit], model.word_scores[j][row[hit]], len(texts))
    s, e, doc = s[~hit], e[~hit], doc[~hit]
    for n in range(LONGEST, 0, -1):
        if not len(s):
            break
        at, word = _windows(s, e, n)
        row = model.grams(b.hashes(at, at + n))
        hit = row >= 0
        row, word = row[hit], word[hit]
        found = np.bincount(word, minlength=len(s))
        got = found > 0
        for j in range(len(model.langs)):
            own = np.bincount(word, model.gram_scores[j][row], len(s))[got] / found[got]
            total[:, j] += np.bincount(doc[got], own, len(texts))
        if n >= CERTAIN:
            known += np.bincount(doc[got], minlength=len(texts))
        s, e, doc = s[~got], e[~got], doc[~got]
    return total, known / np.maximum(words, 1)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """``keep`` and lang_pred, score, known (or as named in ``out``). ``und`` with score 0: null text, no letter, or nothing learned.

    known is the share of words that the learned languages account for.
    A text of letters none of which were seen gets the languages' uniform posterior.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("text__"))
    schema = extended(rows.drop("text__").schema, f"`{out[0]}` string, `{out[1]}` double, `{out[2]}` double")

    def run(it):
        m = sent.value
        for b in it:
            texts, lang, score, shares = b.column(len(keep)).to_pylist(), [], [], []
            for lo, hi, block in tk.blocks(texts):
                total, known = scores(m, block.texts)
                shares += known.tolist()
                if not m.langs:
                    lang, score = lang + ["und"] * (hi - lo), score + [0.0] * (hi - lo)
                    continue
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for t, k, v in zip(block.texts, best, p[np.arange(len(best)), best], strict=True):
                    any_letter = any(map(str.isalpha, t))
                    lang.append(m.langs[k] if any_letter else "und")
                    score.append(float(v) if any_letter else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.float64())], names=[*keep, *out])

    return arrow_map(rows, run, schema)


#: Folds of the query's contract: documents in fold 2 of 4 are never learned from.
PARTS, HELD = 4, 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~in_fold("doc_id", PARTS, HELD)))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", PARTS, HELD).alias("held_out"), "text")
    return predict(marked, model, ["doc_id", "held_out"])


#: The least posterior, and the least share of known words, with which the pipeline's stage keeps a document.
ACCEPT, KNOWN = 0.5, 0.3


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those that no learned language accounts for; adds no column.

    Repeated rows and null ids stay as they are. Without any labelled text nothing can be told, and all go.
    """
    model = train(docs.filter(~in_fold("doc_id", PARTS, HELD)))
    lang, score, known = (unused(docs, c) for c in ("lang_pred", "score", "known"))
    found = predict(docs, model, docs.columns, out=(lang, score, known))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= ACCEPT) & (F.col(known) >= KNOWN)).select(*[F.col(f"`{c}`") for c in docs.columns])
