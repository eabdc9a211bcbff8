"""BPE and Matroska: exact round trips and comparison with the public library."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from heliograph.llm import bpe
from heliograph.llm import matroska as M

TEXTS = ["", "Hello world", "don't  stop\n\n now ", "日本語 テキスト", "é" * 50, "<|endoftext|>a<|endoftext|>", "½ ² ³ 1234 x1", "\x1c\x1d a\x1f b", "a" * 3000, " " * 500, "😀 mixed\t\ttext", "\x00\x7f"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "null id"), (1, "Hello world"), (1, "Hello world")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"n_tokens": F.lit(9), "feature": F.lit("x"), "lang": F.lit(None).cast("string")})


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.public_vocabulary())
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    e = bpe.Encoder(bpe.public_vocabulary())
    full = bpe.Encoder(bpe.public_vocabulary())
    text = " ".join(f"w{i % 40} word{i}" for i in range(300))
    ids = e.encode(text)
    assert len(e) <= 5 and ids == full.encode(text) and e.decode(ids) == text


def test_bpe_column(spark, docs):
    out = bpe.encode_column(docs, decoded_col="back").filter("doc_id is not null and text is not null")
    assert out.filter("back <> text").count() == 0 and "n_tokens" in out.columns
    assert bpe.encode_column(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 511, 512, 513, 4096, 4160, 65536, 70000])
def test_matroska_round_trip(n):
    raw = bytes(i * 7 % 256 for i in range(n))
    data = M.mux(raw)
    media = M.demux(data)
    assert M.payload(data, media) == raw
    assert sum(p.size for p in media.packets) == n and all(data[p.offset : p.offset + p.size] for p in media.packets)
    segment = next(a for i, _, a, _ in M.elements(data, 0, len(data)) if i == M.SEGMENT)
    clusters = [(at - segment) for i, at, _, _ in M.elements(data, 0, len(data)) if i == M.CLUSTER]
    assert [c[2] for c in media.cues] == clusters


def test_vints_and_lacings():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**40):
        value, width = M._number(M.vint(n), 0, 9)
        assert (value, width) == (n, len(M.vint(n)))
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d" * 9]
    xiph = bytes([3, 255, 45, 5, 255, 255, 190]) + b"".join(frames)
    assert M._sizes(xiph, 0, len(xiph), 1) == ([300, 5, 700, 9], 7)
    ebml = M._laced(frames)
    assert M._sizes(ebml, 0, len(ebml), 3)[0] == [300, 5, 700, 9]
    fixed = bytes([2]) + b"x" * 30
    assert M._sizes(fixed, 0, len(fixed), 2) == ([10, 10, 10], 1)


def test_unknown_sizes_and_block_groups():
    block = b"\x81" + struct.pack(">hB", 5, 0) + b"data"
    cluster = M._uint(M.TIMESTAMP, 40) + M.element(M.GROUP, M.element(M.BLOCK, block))
    data = M.element(M.EBML, b"") + M._id(M.SEGMENT) + b"\x01" + b"\xff" * 7 + M.element(M.CLUSTER, cluster)
    (p,) = M.demux(data).packets
    assert (p.timestamp, data[p.offset : p.offset + p.size]) == (45, b"data")


def test_damaged_files_raise_nothing():
    import random

    rng, data = random.Random(2), M.mux(bytes(i * 31 % 256 for i in range(20_000)))
    whole = M.demux(data).packets
    for n in range(0, len(data), 7):
        assert M.demux(data[:n]).packets[:-8] == whole[: len(M.demux(data[:n]).packets)][:-8]
    for _ in range(3_000):
        b = bytearray(data[: rng.randint(0, 3_000)])
        for _ in range(rng.randint(1, 20)):
            if b:
                b[rng.randrange(len(b))] = rng.choice([0, 1, 0x7F, 0x80, 0xA1, 0xA3, 0xE7, 0xFF])
        for p in M.demux(bytes(b)).packets:
            assert 0 <= p.offset <= p.offset + p.size <= len(b)
    for _ in range(2_000):
        M.demux(bytes(rng.randrange(256) for _ in range(rng.randint(0, 80))))


def test_masters_of_unknown_size_end_at_their_siblings():
    unknown = b"\x01" + b"\xff" * 7
    cluster = lambda t: M._id(M.CLUSTER) + unknown + M._uint(M.TIMESTAMP, t) + M.element(M.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0) + b"x" * 3)
    data = M.element(M.EBML, b"") + M._id(M.SEGMENT) + unknown + b"".join(cluster(t) for t in range(3_000)) + M.element(M.CUES, b"")
    media = M.demux(data)
    assert [p.timestamp for p in media.packets] == list(range(3_000)) and len({p.cluster for p in media.packets}) == 3_000


def test_media_features(spark, docs):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in M.media_features(docs).collect()}
    assert M.media_features(docs).count() == len(ROWS)
    for i, t in ROWS:
        n, raw = M.padded(t)
        row = got[i, hashlib.sha256(raw).hexdigest()]
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len((t or "").encode()), len(raw), zlib.crc32(raw[-64:]))
        assert len(raw) % 64 == 0 and len(raw) >= 64
        assert row["media_sha256"] == hashlib.sha256(M.mux(raw)).hexdigest()
    assert M.media_features(docs.limit(0)).count() == 0


def test_packet_table(spark):
    df = spark.createDataFrame([(1, bytearray(M.mux(b"x" * 1024))), (2, None), (3, bytearray(b"")), (4, bytearray(b"\x00\x01junk")), (5, bytearray(M.mux(b"x" * 1024)[:60]))], "id long, media binary")
    rows = M.packet_table(df, "id", "media").orderBy("packet").collect()
    assert [r["byte_size"] for r in rows] == [512, 512] and {r["id"] for r in rows} == {1}
