"""Operators 7 and 8: exact round trips, damage, and odd rows."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from conftest import DATA
from llm_helpers import as_list, documents, edge_rows, prose
from tokenizers import Tokenizer

from lamina.llm import ogg, tokens
from lamina.llm.common import read

# ---- Ogg


def slow_checksum(page: bytes) -> int:
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 7, 255, 1000):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 510, 575, 576, 577, 1152, 65_025, 65_280, 200_001])
@pytest.mark.parametrize("frame", [576, 255, 70_000])
def test_payload_round_trip(n, frame):
    payload = ogg.pad(random.Random(n).randbytes(n), frame)
    assert len(payload) >= frame and len(payload) % frame == 0
    data = ogg.mux(payload, frame)
    found, streams, rate = ogg.unmux(data)
    assert found == payload and rate == ogg.RATE and list(streams) == [1, 2]
    assert sum(s.times(rate)[-1] for s in streams.values()) == len(payload) / rate


def test_packets_of_every_size_and_three_streams():
    rng = random.Random(2)
    streams = [ogg.Writer(s) for s in (5, 9, 2**32 - 1)]
    sent = {s.serial: [] for s in streams}
    done = dict.fromkeys(sent, 0)
    for _ in range(120):
        stream = rng.choice(streams)
        data = rng.randbytes(rng.choice([0, 1, 254, 255, 256, 509, 510, 511, 70_000]))
        done[stream.serial] += len(data)
        sent[stream.serial].append(data)
        stream.packet(data, done[stream.serial])
        if rng.random() < 0.2 and stream.values:
            stream.flush()
    for stream in streams:
        stream.flush(last=True)
    order = [(s, i) for s in streams for i in range(len(s.pages))]
    rng.shuffle(order)
    at = dict.fromkeys(sent, 0)
    pages = []
    for stream, _ in order:
        pages.append(stream.pages[at[stream.serial]])
        at[stream.serial] += 1
    found = ogg.demux(b"".join(pages))
    assert {k: v.packets for k, v in found.items()} == sent
    assert all(v.granules[-1] == done[k] for k, v in found.items() if v.granules)


def test_damage_is_found():
    data = ogg.mux(ogg.pad(b"some text " * 400))
    for at in (0, 5, 10, 23, 27, 60, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 16
        with pytest.raises(ogg.OggError):
            ogg.unmux(bytes(broken))
    last = data.rfind(b"OggS")
    for cut in (data[:-1], data[:last], data[:10], data + b"x", data[data.find(b"OggS", 4) :]):
        with pytest.raises(ogg.OggError):
            ogg.unmux(cut)


def test_media_brute_force(spark):
    docs = read(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    got = ogg.media_features(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    same = {r.payload_sha256: tuple(r)[1:] for r in got}
    assert all(same[r.payload_sha256][2:] == tuple(r)[3:] for r in got)


def test_media_odd_rows(spark, tmp_path):
    plain = as_list(ogg.media_features(documents(spark)))
    assert len(plain) == len(edge_rows()) and as_list(ogg.media_features(documents(spark, clash=True))) == plain
    assert ogg.media_features(documents(spark, [])).collect() == []
    ogg.media_features(documents(spark), path=f"file://{tmp_path}/media")
    stored = spark.read.parquet(f"file://{tmp_path}/media")
    assert as_list(ogg.decode(stored)) == plain


def test_a_damaged_medium_fails_the_query(spark):
    from pyspark.sql import functions as F

    media = ogg.encode(documents(spark, [(1, "abc", None, None, None)]))
    broken = media.withColumn("media", F.concat(F.col("media"), F.lit(b"x")))
    with pytest.raises(Exception, match="OggError"):
        ogg.decode(broken).collect()


# ---- token files

TRICKY = [
    "", " ", "a", "Hello, World. It's fine.", "don't we've I'LL", "a.b,c 3.14 1,000 x. y, ...", "naïve Ångström ß ẞ İi ﬁ", "日本語 テスト 中文", "\U0001f600\U0001f601 ok",
    "<|endoftext|> and <| no", "<|startoftext|>x", "tab\tline\nreturn\rform\x0cvt\x0b", "nbsp here em thin", "é é", "'s 's", "word" * 300, "___ -- ## 12ab34",
    "ÀÉÎ õ÷× ÿŸ", "a\x00b \x1c x\x85y", "zero​width",
]


def test_ids_are_the_librarys():
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    encode = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), limit=50)
    texts = TRICKY + [prose(i, 200) for i in range(20)] + [" ".join(TRICKY)]
    for batch in (texts, texts[::-1], texts[3:4]):
        got = encode([t.encode() for t in batch])
        for text, ids in zip(batch, got):
            assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text


def file_of(documents_: list[tuple], **options) -> bytes:
    out = io.BytesIO()
    writer = tokens.FileWriter(out, **options)
    for doc_id, ids in documents_:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    return out.getvalue()


def test_file_round_trip_and_reading_by_frame():
    rng = random.Random(4)
    docs = [(i if i % 9 else None, [rng.randrange(50_000) for _ in range(rng.choice([1, 5, 300, 5000]))]) for i in range(60)]
    data = file_of(docs, frame_bytes=4096)
    frames = tokens.FileReader(io.BytesIO(data))
    assert len(frames.table) > 10
    order = list(range(60))
    rng.shuffle(order)
    for i in order:
        assert np.frombuffer(frames.document(i), "<u4").tolist() == docs[i][1]
    assert frames.index["null"].tolist() == [d is None for d, _ in docs]
    # any zstandard reader gets the ids in turn: the index and the seek table are skippable frames
    whole = b"".join(np.array(ids, "<u4").tobytes() for _, ids in docs)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == whole

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    file = Counting(data)
    one = tokens.FileReader(file)
    before = file.got
    one.document(30)
    assert file.got - before < len(data) / 4


def test_damaged_files_are_found():
    data = file_of([(1, list(range(3000))), (2, [7] * 10)], frame_bytes=4096)
    with pytest.raises(tokens.TokenFileError):
        tokens.FileReader(io.BytesIO(data[:-1]))
    with pytest.raises(tokens.TokenFileError):
        tokens.FileReader(io.BytesIO(b""))
    broken = bytearray(data)
    broken[30] ^= 1
    with pytest.raises((tokens.TokenFileError, zstandard.ZstdError)):
        tokens.FileReader(io.BytesIO(bytes(broken))).document(0)
    many = struct.unpack("<I", data[-9:-5])[0]
    seeks = bytearray(data)
    seeks[-9 - 12 * many + 8] ^= 1  # the first frame's checksum in the seek table
    with pytest.raises(tokens.TokenFileError):
        tokens.FileReader(io.BytesIO(bytes(seeks))).document(0)
    assert tokens.FileReader(io.BytesIO(file_of([]))).index.tolist() == []


def brute_tokens(rows: list[tuple]) -> list[tuple]:
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_output_brute_force(spark):
    docs = read(spark, f"{DATA}/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, tokens.token_output(docs).collect())) == brute_tokens(rows)


def test_token_files_odd_rows(spark, tmp_path):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want = sorted(brute_tokens(sorted(((r[0], r[1]) for r in edge_rows()), key=key)), key=repr)
    assert as_list(tokens.token_output(documents(spark))) == want
    assert as_list(tokens.token_output(documents(spark, clash=True))) == want
    assert tokens.token_output(documents(spark, [])).collect() == []
    path = f"file://{tmp_path}/ids"
    manifest = tokens.write_tokens(documents(spark), path, files=3)
    assert len(list((tmp_path / "ids").iterdir())) == manifest.count() <= 3
    full = tokens.read_tokens(spark, path, manifest, ids=True)
    assert as_list(full.drop("ids")) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in full.collect())


def test_files_of_failed_attempts_go_and_those_of_others_stay(spark, tmp_path, monkeypatch):
    path = tmp_path / "ids"
    path.mkdir()
    monkeypatch.setattr(tokens.uuid, "uuid4", lambda: uuid.UUID(int=7))
    (path / f"part-000000-{uuid.UUID(int=7).hex}-99.tok.zst").write_bytes(b"left by a lost executor")
    strangers = {"notes.txt", f"part-000000-{'1' * 32}-3.tok.zst"}
    for name in strangers:
        (path / name).write_bytes(b"somebody's")
    manifest = tokens.write_tokens(documents(spark), f"file://{path}")
    assert {p.name for p in path.iterdir()} == {r.file for r in manifest.collect()} | strangers
