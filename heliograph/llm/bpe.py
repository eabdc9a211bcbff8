"""Byte-level BPE: encoding by a priority queue over a linked symbol list, and decoding.

A vocabulary file of the ``tokenizers`` library is the only input; nothing is trained. Text is
cut at the file's added tokens, then into pretokens by the byte-level pattern; a pretoken's
symbols form a doubly linked list, and a heap holds the ranks of adjacent pairs. The lowest
rank is merged first (ties: leftmost); an entry whose symbols have changed meanwhile is stale
and skipped. Pretokens repeat, so each worker remembers what it has merged, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import arrow_map, batch, extended, table, unused

#: The published pattern of byte-level BPE pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without the characters that the standard library classes otherwise.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
#: Pretokens in each of two generations of a worker's memory, and the longest one kept.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64


#: Characters that ``re`` and the published pattern put in different classes: numbers that aren't decimal digits, and the separators 0x1C-0x1F.
SEPARATORS = "\x1c\x1d\x1e\x1f"


@lru_cache(1)
def _odd() -> frozenset[str]:
    return frozenset(SEPARATORS) | {c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}


def _plain(text: str) -> bool:
    if text.isascii():
        return not any(c in text for c in SEPARATORS)
    return _odd().isdisjoint(text)


def byte_alphabet() -> dict[int, str]:
    """Each byte's printable stand-in in vocabulary files: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Encoder(dict):
    """Maps a pretoken to its ids as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        back = {ord(c): b for b, c in stand_in.items()}
        plain = lambda s: bytes(back[ord(c)] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = plain(token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: left id << 20 | right id: (rank, merged id)
        self.merges = {vocab[a] << 20 | vocab[b]: (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.of_byte = [vocab[stand_in[b]] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.find = regex.compile(PATTERN).findall
        self.older: dict[str, bytes] = {}
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.older.get(pretoken) or array("I", self.merge(pretoken.encode())).tobytes()
        if len(pretoken) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[pretoken] = ids
        return ids

    def merge(self, word: bytes) -> list[int]:
        of_byte, find = self.of_byte, self.merges.get
        symbols: list[int] = [of_byte[b] for b in word]
        n = len(symbols)
        if n == 1:
            return symbols
        before, after, queue = [*range(-1, n - 1)], [*range(1, n), -1], []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if found := find(left << 20 | right):
                queue.append((found[0], i - 1, left, right, found[1]))
            left = right
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := find(merged << 20 | symbols[k]):
                    heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := find(symbols[h] << 20 | merged)):
                heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def pretokens(self, text: str) -> list[str]:
        return FAST(text) if _plain(text) else self.find(text)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            return b"".join(map(self.__getitem__, self.pretokens(text)))
        out = []
        for k, piece in enumerate(self.cut.split(text)):
            out.append(self.added[piece].to_bytes(4, "little") if k % 2 else b"".join(map(self.__getitem__, self.pretokens(piece))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary's byte strings of the ids, concatenated; invalid UTF-8 becomes replacement characters."""
        i = np.frombuffer(ids, "<u4")
        n = self.sizes[i]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.begins[i] - (ends - n), n)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_vocabulary() -> str:
    """The vocabulary's path, found on each machine by its installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_column(df: DataFrame, text_col: str = "text", path: str | None = None, out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """Adds the ids of each whole text (null: empty) as array<int>, and if named, the text decoded from them."""
    names = [c for c in df.columns if c not in (out_col, decoded_col)]
    kept = df.select(*[F.col(f"`{c}`") for c in names])
    schema = extended(kept.schema, f"`{out_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))

    def run(it):
        enc = encoder(path or public_vocabulary())
        for b in it:
            texts = b.column(names.index(text_col)).to_pylist()
            ids = [enc.encode(t or "") for t in texts]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            cols = [*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
            if decoded_col:
                cols.append(pa.array([enc.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, out_col, *([decoded_col] if decoded_col else [])])

    return arrow_map(kept, run, schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the text decoded from the ids.

    Null and empty texts have no ids and the digests of empty input; repeated rows stay; other columns are ignored.
    """

    def run(it):
        enc, sha = encoder(path or public_vocabulary()), hashlib.sha256
        for b in it:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield batch(ROUND_TRIP, [b.column(0), [len(i) // 4 for i in ids], [sha(i).hexdigest() for i in ids], [sha(enc.decode(i).encode()).hexdigest() for i in ids]])

    return arrow_map(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens, in the place of columns that were named so. All rows stay; null and empty texts have no ids.

    The decoded ids are compared with each text: a difference is an error of the encoder and fails the job.
    """
    decoded = unused(docs, "decoded")
    out = encode_column(docs, decoded_col=decoded)
    same = F.col(f"`{decoded}`") == F.coalesce("text", F.lit(""))
    checked = F.when(same, F.col("token_ids")).otherwise(F.raise_error(F.lit("a text isn't what its ids decode to")).cast("array<int>"))
    return out.withColumn("token_ids", checked).drop(decoded).withColumn("n_tokens", F.size("token_ids").cast("long"))
