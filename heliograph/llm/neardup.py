"""Near duplicates by bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed once; it keeps the set's size, a 128-bit
   fingerprint and the ``K`` smallest hashes (its sketch). Equal sets form one class, which
   one document stands for from there on.
2. Inverted lists of retained hashes give overlaps. A list's key is three hashes that follow each
   other in a sketch, which unrelated documents hardly share, even if a common passage makes
   up a good part of both. Similar documents nearly always do: of the hashes of both sketches
   four in five are common at the threshold, and 48 draws at such odds lack a run of three once
   in twenty million. (Sets of up to K hashes are whole; there a fifth of other hashes can't
   break all runs of three if there are six, and up to five are listed by neighbours too.)
   Lists with the same smallest document form one cell, as the lists of a group of copies have
   nearly the same documents: a pair meets in a few cells, not in each of its lists.
3. The sketch of the union (the smallest hashes of both) estimates the similarity; pairs far
   below the threshold are no candidates. A pair at the threshold fails this by chance about
   once in six million. Documents without a candidate in a cell leave it.
4. The full sets decide. Cells are compared in groups of bounded size: first all documents of a
   cell with one, then those outside the cell's largest part with one of that part (``ROUNDS``
   times in all), so that a group of copies costs a few comparisons a copy. What is in different
   parts then is compared in full, block by block. A group puts out the links that join parts,
   fewer than it has documents. 5. Components of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import textkit as tk
from heliograph.llm.common import Shelf, arrow_map, batch, table
from heliograph.llm.graphs import components

#: Hashes retained, and the least overlap of two full sketches at a similarity of 0.8.
K, OVERLAP = 48, 23
#: Documents and hashes a block of sketches and one of full sets has about; rounds against single documents before blocks are compared.
SKETCH_BLOCK, SET_BLOCK, ROUNDS = (512, 1 << 18), (256, 1 << 18), 2
#: Ids that are sent to all executors at most.
SENT = 1_000_000
#: Columns of the matrices of one comparison.
SLICE = 1 << 13


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin (A-Z lower-cased)."""
    values, ends = [], [0]
    for lo, hi, b in tk.blocks(texts, ascii_lower=True):
        s, e, doc = b.words()
        h = b.hashes(s, e)
        x, at = tk.chain(h, doc, words)
        owner = doc[at]
        n = np.bincount(doc, minlength=hi - lo)
        few = np.flatnonzero((n > 0) & (n < words))
        if len(few):
            first = np.searchsorted(doc, few)
            whole = np.array([tk.chain(h[f : f + n[d]], doc[f : f + n[d]], int(n[d]))[0][0] for f, d in zip(first, few, strict=True)], tk.U)
            x, owner = np.concatenate([x, whole]), np.concatenate([owner, few])
        order = np.lexsort((tk.signed(x), owner))
        x, owner = x[order], owner[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        values.append(x[new])
        ends += (ends[-1] + np.cumsum(np.bincount(owner[new], minlength=hi - lo))).tolist()
    return tk.signed(np.concatenate(values)) if values else np.zeros(0, np.int64), np.array(ends)


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fp, sketch); fp is null for a document without words."""

    def run(it):
        for b in it:
            values, ends = shingle_sets(b.column(1).to_pylist(), words)
            n = np.diff(ends)
            v = values.view(tk.U)
            one, two = (np.concatenate([np.zeros(1, tk.U), np.cumsum(tk.mix(v ^ np.uint64(salt)))]) for salt in (0x1111, 0x2222))
            fp = np.stack([one[ends[1:]] - one[ends[:-1]], two[ends[1:]] - two[ends[:-1]]], 1)
            yield batch(SKETCH, [b.column(0), n, [f.tobytes() if m else None for f, m in zip(fp, n, strict=True)], [values[a : a + min(m, K)] for a, m in zip(ends, n, strict=False)]])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n long, fp binary, sketch array<long>")


def runs(reps: DataFrame) -> DataFrame:
    """(value, rep, n): each document under the runs of its retained hashes."""
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("sketch") - (n - 1)), lambda i: F.xxhash64(*[F.element_at("sketch", i + j) for j in range(n)]))
    none = F.array().cast("array<bigint>")
    three = F.when(F.size("sketch") > 2, run(3)).otherwise(none)
    # a set of one shingle is linked with equal sets only, which are one class already
    two = F.when((F.size("sketch") > 1) & (F.col("n") <= 5), run(2)).otherwise(none)
    return reps.select("rep", "n", F.explode(F.concat(three, two)).alias("value"))


def cells(reps: DataFrame, shelf: Shelf) -> DataFrame:
    """(cell, rep, n): the lists of at least two documents, those with the same smallest document (cell) as one."""
    keys = runs(reps)
    lists = shelf.put("lists", keys.groupBy("value").agg(F.min("rep").alias("cell"), F.max("rep").alias("last")).filter("cell <> last").select("value", "cell"))
    found = shelf.put("cells", keys.join(lists, "value").select("cell", "rep", "n").distinct())
    shelf.drop("lists")
    return found


SET = pa.schema([("rep", pa.int64()), ("hashes", pa.binary())])


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(rep, hashes): the sorted shingle hashes of documents (doc_id, text), 8 bytes each."""

    def run(it):
        for b in it:
            values, ends = shingle_sets(b.column(1).to_pylist(), words)
            yield batch(SET, [b.column(0), [values[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]])

    return arrow_map(docs, run, "rep long, hashes binary")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of each of the left sets with each of the right ones, from products of 0/1 matrices."""
    used = np.concatenate([left, right])
    sizes = [len(sets[i]) for i in used]
    values, at = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), sizes)
    # a hash of a single set is in no intersection
    often = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, at = row[often[at]], number[at[often[at]]]
    out = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(often.sum()), SLICE):
        x, y = np.searchsorted(at, [lo, lo + SLICE])
        has = np.zeros((len(used), min(SLICE, int(often.sum()) - lo)), np.float32)
        has[row[x:y], at[x:y] - lo] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _alike(sketch: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the union sketch lets the pairs of documents i and j pass."""
    pad = np.iinfo(np.int64).max
    table = np.full((len(sketch), K), pad)
    for r, s in enumerate(sketch):
        table[r, : len(s)] = s
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        both = np.sort(np.concatenate([table[i[lo : lo + 4096]], table[j[lo : lo + 4096]]], 1), axis=1)
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != pad)
        rank = np.cumsum((both != pad) & ~twice, 1)
        union = np.minimum(rank[:, -1], K)
        common = (twice & (rank <= K)).sum(1)
        out[lo : lo + 4096] = np.where(union < K, common * 100 >= union * percent, common >= OVERLAP)
    return out


def candidates(sketch: list[np.ndarray], n: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right document of different parts (``root``) whose sizes and sketches let them be similar."""
    least, most = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
    may = (root[left][:, None] != root[right][None, :]) & (100 * least >= percent * most)
    if not may.any():
        return np.zeros(0, int), np.zeros(0, int)
    may &= _overlaps(sketch, left, right) >= np.minimum(OVERLAP, np.ceil(least * percent / 100))
    i, j = np.nonzero(may)
    good = _alike(sketch, left[i], right[j], percent)
    return left[i[good]], right[j[good]]


def links(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a left and a right document that are similar and join parts which no pair before has joined."""
    n = np.array([len(s) for s in sets])
    i, j = candidates([s[:K] for s in sets], n, root, left, right, percent)
    if not len(i):
        return []
    rows, at_i = np.unique(i, return_inverse=True)
    columns, at_j = np.unique(j, return_inverse=True)
    common = _overlaps(sets, rows, columns)[at_i, at_j]
    good = 100 * common >= percent * (n[i] + n[j] - common)
    joined: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = x = joined.get(up, up)
        return x

    out = []
    for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
        x, y = find(int(root[a])), find(int(root[b]))
        if x != y:
            joined[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _groups(rows: DataFrame, payload: DataFrame, block: tuple[int, int], among: bool, shelf: Shelf, name: str) -> DataFrame:
    """(cell, inner, m): groups of rows (cell, rep, n, root, major) with their payload (rep, hashes), an array or 8 bytes a hash.

    The documents of a cell that are not major are dealt into blocks by a hash, the major ones
    likewise; each block of the first meets each block of the second in a group of its own and,
    with ``among``, each block of the first (``inner``: itself). A block has about as many
    documents and hashes as ``block`` says.
    """
    ceil = lambda major: F.greatest(F.lit(1), *[F.ceil(F.sum(F.when(F.col("major") == major, x).otherwise(0)) / most) for x, most in zip((F.lit(1), F.col("n")), block, strict=True)]).cast("int")
    # cells of one block are not listed: the table is a small share of the cells
    large = shelf.put(f"{name}-large", rows.groupBy("cell").agg(ceil(False).alias("bs"), ceil(True).alias("bm")).filter("bs > 1 or bm > 1"))
    dealt = rows.join(large, "cell", "left").withColumns({"bs": F.coalesce("bs", F.lit(1)), "bm": F.coalesce("bm", F.lit(1))})
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "cell"), F.when(F.col("major"), F.col("bm")).otherwise(F.col("bs"))).cast("int"))
    own = F.col("own")
    key = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    of_major = F.transform(F.sequence(F.lit(0), F.col("bs") - 1), lambda i: key(1, i, own))
    of_other = F.transform(F.sequence(F.lit(0), F.col("bm") - 1), lambda j: key(1, own, j))
    if among:
        of_other = F.concat(of_other, F.transform(F.sequence(F.lit(0), F.col("bs") - 1), lambda i: key(0, F.least(i, own), F.greatest(i, own))))
    meets = dealt.select("cell", "rep", "n", "root", "major", "own", F.explode(F.when(F.col("major"), of_major).otherwise(of_other)).alias("g"))
    side = F.when(F.col("g.kind") == 1, F.col("major")).otherwise(F.col("own") == F.col("g.y"))
    # one side alone has nothing to meet
    inner = (F.col("g.kind") == 0) & (F.col("g.x") == F.col("g.y"))
    group = meets.join(payload, "rep").groupBy("cell", "g").agg(F.collect_list(F.struct("rep", "n", "root", side.alias("side"), "hashes")).alias("m"))
    return group.filter(F.size("m") > 1).select("cell", inner.alias("inner"), "m")


def _each(batch_: pa.RecordBatch):
    """For each group: cell, numbers of its left and right documents, and its members' rep, n, root and hashes."""
    rep, n, root, side, hashes = batch_.column(2).flatten().flatten()
    rep, n, root, side = (c.to_numpy(zero_copy_only=False) for c in (rep, n, root, side))
    ends = np.concatenate([[0], np.cumsum(batch_.column(2).value_lengths().to_numpy())]).tolist()
    for cell, inner, lo, hi in zip(batch_.column(0).to_pylist(), batch_.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
        own = [x.values.to_numpy() for x in hashes[lo:hi]] if pa.types.is_list(hashes.type) else [np.frombuffer(x, np.int64) for x in hashes[lo:hi].to_pylist()]
        # a block against itself: all pairs, each seen from both sides
        left, right = (np.arange(hi - lo),) * 2 if inner else (np.flatnonzero(~side[lo:hi]), np.flatnonzero(side[lo:hi]))
        if len(left) and len(right):
            yield cell, left, right, rep[lo:hi], n[lo:hi], root[lo:hi], own


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
MEMBER = pa.schema([("cell", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])


def _with_candidates(rows: DataFrame, sketch: DataFrame, percent: int, among: bool, shelf: Shelf, name: str) -> DataFrame:
    """(cell, rep, n), on the shelf: the rows that have a candidate in a group of theirs."""

    def run(it):
        for k in it:
            out = []
            for cell, left, right, rep, n, root, own in _each(k):
                at = np.unique(np.concatenate(candidates(own, n, root, left, right, percent)))
                out.append((np.full(len(at), cell), rep[at], n[at]))
            yield batch(MEMBER, [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 3)

    return shelf.put(name, arrow_map(_groups(rows, sketch, SKETCH_BLOCK, among, shelf, name), run, "cell long, rep long, n long").distinct())


def alive(members: DataFrame, reps: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """The members (cell, rep, n) that have a candidate in their cell by sizes and sketches: few, where a cell shares no more than a passage.

    In a group of copies all are candidates of the cell's first document, which is asked first;
    only those that aren't are compared with the whole cell.
    """
    sketch = shelf.put("cell-sketches", reps.join(members.select("rep").distinct(), "rep").select("rep", F.col("sketch").alias("hashes")))
    each = members.withColumn("root", F.col("rep"))
    first = _with_candidates(each.withColumn("major", F.col("rep") == F.col("cell")), sketch, percent, False, shelf, "alive-0")
    marked = members.join(first.select("cell", "rep", F.lit(True).alias("found")), ["cell", "rep"], "left")
    marked = shelf.put("marked", marked.select("cell", "rep", "n", F.col("rep").alias("root"), F.coalesce("found", F.lit(False)).alias("major")))
    # cells of two are done: their documents have met
    some = shelf.put("some", marked.groupBy("cell").agg(F.count("*").alias("size"), F.min("major").alias("all")).filter("size > 2 and not all").select("cell"))
    other = _with_candidates(marked.join(some, "cell", "left_semi"), sketch, percent, True, shelf, "alive-1")
    live = shelf.put("alive", first.unionByName(other).distinct())
    shelf.drop("alive-0", "alive-1", "marked", "some", "cell-sketches")
    return live


def meet(rows: DataFrame, sets: DataFrame, percent: int, among: bool, shelf: Shelf, name: str) -> DataFrame:
    """Edges (u, v), on the shelf, of similar documents in rows (cell, rep, n, root, major), fewer a group than it has documents."""

    def run(it):
        for k in it:
            u, v = [], []
            for _, left, right, rep, _, root, own in _each(k):
                for a, b in links(own, root, left, right, percent):
                    u.append(max(rep[a], rep[b]))
                    v.append(min(rep[a], rep[b]))
            yield batch(EDGE, [u, v])

    return shelf.put(name, arrow_map(_groups(rows, sets, SET_BLOCK, among, shelf, name), run, "u long, v long"))


def _open(members: DataFrame, root: DataFrame, r: int, shelf: Shelf) -> DataFrame:
    """(cell, rep, n, root, main, leader): the cells of different parts, with their largest part and one document of it."""
    placed = members.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("cell", "rep", "n", F.coalesce("root", "rep").alias("root"))
    parts = placed.groupBy("cell", "root").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("rep", F.lit(r)), "rep")).alias("l"))
    main = parts.groupBy("cell").agg(F.max(F.struct("size", "root", F.col("l.rep").alias("leader"))).alias("m"), F.count("*").alias("parts"), F.sum("size").alias("size"))
    # cells of two are done: their documents have met
    main = shelf.put(f"main-{r}", main.filter("parts > 1 and size > 2").select("cell", F.col("m.root").alias("main"), "m.leader"))
    return shelf.put(f"open-{r}", placed.join(main, "cell").select("cell", "rep", "n", "root", "main", "leader"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents (doc_id, text).

    Null texts and texts without words have an empty set and are linked with nothing; a text of
    fewer words than a shingle is one shingle. A row without doc_id has no component and is not
    kept. Rows with one doc_id and different texts each get the component of their own text.
    Other columns are ignored. An empty table gives an empty result.
    """
    if percent < 80:
        raise ValueError("the sketches are dimensioned for similarities of 0.8 or more")
    shelf = shelf or Shelf(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = shelf.put("sketches", sketches(docs, words))
    some = made.filter("doc_id is not null and fp is not null")
    reps = shelf.put("reps", some.groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")))
    members = alive(cells(reps, shelf), reps, percent, shelf)
    need = shelf.put("need", members.select(F.col("rep").alias("doc_id")).distinct())
    # few ids are sent to the texts; beyond that both are dealt by id
    small = F.broadcast(need) if need.count() <= SENT else need
    own = docs.filter("text is not null").join(small, "doc_id").select("doc_id", "text")
    if not some.groupBy("doc_id").count().filter("count > 1").isEmpty():
        own = own.distinct()  # repeated rows
    sets = shelf.put("sets", full_sets(own, words))
    # a cell's smallest document that is left is its first leader
    lead = members.groupBy("cell").agg(F.min("rep").alias("leader"))
    rows = members.join(lead, "cell").select("cell", "rep", "n", F.col("rep").alias("root"), (F.col("rep") == F.col("leader")).alias("major"))
    edges = meet(rows, sets, percent, False, shelf, "round-0")
    for r in range(1, ROUNDS + 1):
        root = shelf.put(f"root-{r}", components(edges, shelf, f"cc-{r}"))
        rows, last = _open(members, root, r, shelf), r == ROUNDS
        if not last:
            rows = rows.filter("root <> main or rep = leader")
        rows = rows.select("cell", "rep", "n", "root", (F.col("root") == F.col("main") if last else F.col("rep") == F.col("leader")).alias("major"))
        edges = edges.unionByName(meet(rows, sets, percent, last, shelf, f"round-{r}"))
    root = shelf.put("root", components(edges, shelf, "cc"))
    shelf.clear("sketches", "reps", "root")

    plain = made.filter("fp is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    of = made.filter("fp is not null").join(reps.select("fp", "n", "rep"), ["fp", "n"], "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("doc_id", "n", F.coalesce("root", "rep", "doc_id").alias("component")).unionByName(plain)
    return of.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id's (documents without id too). Shingles of five words."""
    shelf = Shelf(spark, "neardup-stage")
    gone = shelf.put("gone", near_duplicates(docs, words=5, shelf=shelf).filter("not kept and doc_id is not null").select("doc_id").distinct())
    shelf.clear("gone")
    left = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    ids = docs.filter("doc_id is not null").select("doc_id")
    repeated = shelf.put("repeated", ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left["doc_id"] == repeated["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, left["doc_id"] == repeated["doc_id"], "left_anti").unionByName(once)
