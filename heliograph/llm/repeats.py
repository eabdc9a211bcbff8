"""Passages that repeat across documents, by a sparse suffix array.

1. Of a text's suffixes (one from each word) only those at minimisers stay: positions whose hash
   of the next ``GRAM`` words is the least of ``WINDOW`` neighbours. Content alone selects them, so
   equal passages keep equal suffixes: any passage of ``MIN_WORDS`` = GRAM + WINDOW - 1 words has one.
2. The suffixes are sorted across the cluster by their first GRAM words, then document and place. As in
   prefix doubling a prefix is represented by a number (its hash): the order among different prefixes is not
   the alphabet's, which nothing depends on; equal prefixes are neighbours. A comparison along
   each run of neighbours gives each suffix the first document that shares GRAM words with it.
3. Matches are extended to both sides: the stretches of MIN_WORDS words around a shared prefix, from each
   place up to WINDOW - 1 words to its left, are sorted and compared in the same way. So a match is found
   against every earlier holder, whatever part of the passage the others quote, and overlapping
   matches of a document join to the passage's true ends.

Guarantee: exactly the words of a document are covered that are in a passage of MIN_WORDS words or
more which an earlier document (smaller id) has too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import textkit as tk
from heliograph.llm.common import Shelf, arrow_map, batch, table, unused

GRAM, WINDOW = 32, 19
MIN_WORDS = GRAM + WINDOW - 1


def _sliding(x: np.ndarray, size: int, of) -> np.ndarray:
    """of (minimum or maximum) over each ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = of(x[: len(x) - step], x[step:])
        have += step
    return x


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words each, from the words' hashes."""
    n = len(h) - size + 1
    power, inverse = tk.TABLES.powers(len(h))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, tk.U), np.cumsum(h * power[: len(h)])])
        return tk.mix((total[size:] - total[:-size]) * inverse[:n] + tk.U(size))


def anchors_of(b: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, hash of the next GRAM words) of each suffix that stays."""
    s, e, doc = b.words()
    h = b.hashes(s, e)
    n = len(h) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(tk.U)
    g = _grams(h, GRAM)
    inside = doc[:n] == doc[GRAM - 1 :]
    top = np.iinfo(np.uint64).max
    # windows must not reach into the next text: each text is followed by grams that are outside, which are set to the top
    g = np.where(inside, g, top)
    if n < WINDOW:
        g, n = np.concatenate([g, np.full(WINDOW - n, top, tk.U)]), WINDOW
        inside = np.concatenate([inside, np.zeros(n - len(inside), bool)])
    low = _sliding(g, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, tk.U)
    stays = _sliding(np.concatenate([pad, low, pad]), WINDOW, np.maximum)[:n] == g
    at = np.flatnonzero(stays & inside)
    d = doc[at]
    first = np.searchsorted(doc, d)
    # many equal hashes in a row (repeated words): one of every WINDOW - 3 positions is enough
    order = np.lexsort((at, g[at], d))
    p, key, own = at[order], g[at][order], d[order]
    chain = np.zeros(len(p), bool)
    chain[1:] = (key[1:] == key[:-1]) & (own[1:] == own[:-1]) & (p[1:] - p[:-1] <= WINDOW)
    begins = np.flatnonzero(~chain)
    start = p[begins][np.cumsum(~chain) - 1] if len(p) else p
    slot = (p - start) // (WINDOW - 3)
    keep = ~chain
    keep[-1:] = True
    keep[1:] |= slot[1:] != slot[:-1]
    keep[:-1] |= ~chain[1:]  # and a chain's last position, from which its end is in reach
    kept = np.sort(order[keep])
    return d[kept], (at - first)[kept], g[at][kept]


ANCHOR = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())])


def _anchors(it):
    for b in it:
        ids = b.column(0).to_numpy()
        for lo, _, k in tk.blocks(b.column(1).to_pylist()):
            doc, pos, h = anchors_of(k)
            yield batch(ANCHOR, [tk.signed(h), ids[lo + doc], pos.astype(np.int32)])


MATCH = pa.schema([("doc", pa.int64()), ("pos", pa.int32()), ("of_doc", pa.int64()), ("of_pos", pa.int32()), ("h", pa.int64()), ("edge", pa.int32())])


def _neighbours(it):
    """Each sorted suffix with the first one of its prefix, if that is of another document.

    A partition's first prefix may have begun in an earlier partition: its rows are marked (edge 1),
    and so is what the partition knows of its last prefix (edge 2, once, with the partition's first prefix
    as ``pos`` 1 if that is the same), so that the partitions can be put together afterwards.
    """
    opening, first = None, None  # the first prefix; the first row of the prefix at hand
    for b in it:
        if not b.num_rows:
            continue
        h, doc, pos = (c.to_numpy() for c in b.columns)
        opening = h[0] if opening is None else opening
        new = np.append(first is None or first[0] != h[0], h[1:] != h[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        of_doc, of_pos = doc[np.maximum(at, 0)], pos[np.maximum(at, 0)]
        if first is not None:
            of_doc, of_pos = np.where(at < 0, first[1], of_doc), np.where(at < 0, first[2], of_pos)
        edge = (h == opening).astype(np.int32)
        take = (of_doc != doc) | (edge > 0)
        yield batch(MATCH, [doc[take], pos[take], of_doc[take], of_pos[take], h[take], edge[take]])
        first = (h[-1], of_doc[-1], of_pos[-1])
    if first is not None:
        yield batch(MATCH, [[0], [int(first[0] == opening)], [first[1]], [first[2]], [first[0]], [2]])


def matched(made: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(doc, pos, of_doc, of_pos, h): the rows (h, doc, pos) of ``name`` on the shelf, which is dropped, whose prefix h an earlier document has; and its first place there."""
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = made.repartitionByRange(parts, "h", "doc", "pos").sortWithinPartitions("h", "doc", "pos")
    got = arrow_map(ordered, _neighbours, "doc long, pos int, of_doc long, of_pos int, h long, edge int")
    got = shelf.put(f"{name}-matches", got.withColumn("part", F.spark_partition_id()))
    shelf.drop(name)
    # one row for each partition that has rows: its last prefix, the first row of that, and whether it is the first prefix too
    last = sorted((r["part"], r["h"], r["of_doc"], r["of_pos"], r["pos"]) for r in got.filter("edge = 2").collect())
    bounds, held = [], None
    openings = {r["part"]: r["h"] for r in got.filter("edge = 1").groupBy("part").agg(F.first("h").alias("h")).collect()}
    for part, h, of_doc, of_pos, whole in last:
        goes_on = held is not None and held[0] == openings[part]
        if goes_on:
            bounds.append((part, *held))
        held = held if goes_on and whole else (h, of_doc, of_pos)
    rows = got.filter("edge < 2")
    if not bounds:
        return rows.filter("doc <> of_doc").select("doc", "pos", "of_doc", "of_pos", "h")
    # as an Arrow table: plain rows would start Python workers of another kind beside the ones there are
    kinds = pa.schema([("part", pa.int32()), ("h", pa.int64()), ("b_doc", pa.int64()), ("b_pos", pa.int32())])
    begun = made.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*bounds, strict=True), kinds, strict=True)], schema=kinds))
    joined = rows.join(F.broadcast(begun), ["part", "h"], "left")
    return joined.select("doc", "pos", F.coalesce("b_doc", "of_doc").alias("of_doc"), F.coalesce("b_pos", "of_pos").alias("of_pos"), "h").filter("doc <> of_doc")


def _stretches(it):
    """The hashes of all stretches of MIN_WORDS words that hold GRAM words with a hash that is asked for."""
    for b in it:
        out = []
        for doc, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            k = tk.Block([text])
            s, e, _ = k.words()
            if len(s) < MIN_WORDS:
                continue
            h = k.hashes(s, e)
            hit = np.isin(tk.signed(_grams(h, GRAM)), asked.values.to_numpy())
            # a stretch from word i holds the grams from i to i + WINDOW - 1
            held = np.concatenate([[0], np.cumsum(hit)])
            at = np.flatnonzero(held[WINDOW:] > held[:-WINDOW])
            out.append((tk.signed(_grams(h, MIN_WORDS))[at], np.full(len(at), doc, np.int64), at.astype(np.int32)))
        yield batch(ANCHOR, [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []])


def matches(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc, pos, of_doc, of_pos): all stretches of MIN_WORDS words that an earlier document has."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    found = matched(shelf.put("anchors", arrow_map(rows, _anchors, "h long, doc long, pos int")), shelf, "anchors")
    # each document of a shared hash has a predecessor or is one
    asked = found.select(F.explode(F.array("doc", "of_doc")).alias("need"), "h").groupBy("need").agg(F.collect_set("h").alias("asked"))
    texts = rows.join(asked, F.col("doc_id") == F.col("need")).select("doc_id", "text", "asked")
    made = shelf.put("stretches", arrow_map(texts, _stretches, "h long, doc long, pos int"))
    shelf.drop("anchors-matches")
    return matched(made, shelf, "stretches").drop("h")


PASSAGE = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("of_doc_id", pa.int64()), ("of_start_word", pa.int32())])


def _joined(it):
    """Overlapping matches of a document as one passage, with the first place of its first match."""
    for b in it:
        m = b.column(1)
        rows = m.flatten()
        pos, of_doc, of_pos = (c.to_numpy() for c in rows.flatten())
        own = np.repeat(np.arange(b.num_rows), m.value_lengths().to_numpy())
        order = np.lexsort((pos, own))
        pos, of_doc, of_pos, own = pos[order], of_doc[order], of_pos[order], own[order]
        new = np.ones(len(pos), bool)
        new[1:] = (own[1:] != own[:-1]) | (pos[1:] > pos[:-1] + MIN_WORDS)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pos))[: len(first)] - 1
        yield batch(PASSAGE, [b.column(0).to_numpy()[own[first]], pos[first], pos[last] + np.int32(MIN_WORDS), of_doc[first], of_pos[first]])


def repeated_passages(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, of_doc_id, of_start_word): passages that an earlier document has.

    Words are runs without white space, compared exactly; words are counted from 0 and end_word
    is not included. The document with the smallest id keeps a passage; of_doc_id is
    the smallest id that has its first MIN_WORDS words, of_start_word their first place there. Repeats within one document
    alone don't count. Null ids or texts, and texts shorter than MIN_WORDS words, have no
    passages; rows with the same id count as one document. An empty table gives an empty result.
    Other columns are ignored.
    """
    shelf = shelf or Shelf(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = matches(docs, shelf).groupBy("doc").agg(F.collect_list(F.struct("pos", "of_doc", "of_pos")).alias("m"))
    joined = arrow_map(found, _joined, "doc_id long, start_word int, end_word int, of_doc_id long, of_start_word int")
    return joined.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "of_doc_id", "of_start_word")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def cut(docs: DataFrame, passages: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without their repeated passages; those of which no word is left by that go.

    Rows with the same id are cut at the same words. Null ids and texts stay as they are; other
    columns stay, whatever their names.
    """
    spans, whose = unused(docs, "spans"), unused(docs, "whose")
    found = passages.groupBy(F.col("doc_id").alias(whose)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    names = docs.columns
    both = docs.join(found, docs[f"`{id_col}`"] == found[whose], "left").select(*[docs[f"`{c}`"] for c in names], spans)
    schema, at = docs.schema, names.index(text_col)

    def run(it):
        for b in it:
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            for i, own in enumerate(b.column(len(names)).to_pylist()):
                if not own or texts[i] is None:
                    continue
                s, e, _ = tk.Block([texts[i]]).words()
                out, done = [], 0
                for r in sorted((r["start_word"], r["end_word"]) for r in own):
                    if r[0] < len(s):
                        out.append(texts[i][done : max(done, s[r[0]])])
                        done = max(done, int(e[min(r[1], len(e)) - 1]))
                texts[i] = "".join([*out, texts[i][done:]])
                keep[i] = not texts[i].isspace() and bool(texts[i])
            cols = [pa.array(texts, b.schema.field(at).type) if j == at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return arrow_map(both, run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; n_chars, where it is there, is counted anew.

    Null and empty texts stay; repeated rows are one document, which is no repeat of itself.
    """
    out = cut(docs, repeated_passages(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
