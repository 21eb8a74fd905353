"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit numbers:
frames that each decompress by themselves, a skippable frame with the index of its
documents, and last a skippable frame with the seek table of the public zstd seekable
format (sizes and a checksum, the low 32 bits of XXH64, of each frame). A reader finds a
document in the index and decompresses only the frames it lies in.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, remove, scratch, slices, texts

#: Text in a file, about.
FILE_BYTES = 4 << 30
VOCABULARY, END_ID, FRAME_BYTES, LEVEL, KNOWN_WORDS = "word_bpe_49k.json", 2, 1 << 18, 3, 1_000_000
SKIPPABLE, INDEX_MAGIC, SEEK_MAGIC, SEEK_FOOT = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, struct.Struct("<IBI")
#: Words of letters that are one code point in NFC, in either case.
PLAIN = "[a-zà-öø-þÀ-ÖØ-Þß]+"
#: A letter of those or a digit before a last stop or comma.
TAILED = "[a-zà-öø-þÀ-ÖØ-ÞßA-Z0-9][.,]$"
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("tokens", "<u8")])


class TokenFileError(ValueError):
    """A token file is damaged."""


class Encoder:
    """Ids by the tokenizers library, each word of a batch encoded once, with those already met.

    The vocabulary's pre-tokenizer never joins what white space separates, so a text's ids
    are its words' ids in turn; ``<|`` may begin a special token, and such texts go to the
    library whole. Words met are kept up to ``limit`` and then dropped all at once.
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Puts the ids of ``words`` in ``known``.

        A final stop or comma after a letter or digit is an id of its own. Words of plain
        letters are one piece each, whose last id alone ends a word: they go to the
        library many at a time, and the ids are cut there.
        """
        known, array = self.known, pa.array(words, pa.string())
        tailed = pc.match_substring_regex(array, TAILED).to_pylist()
        stems = [w[:-1] if t else w for w, t in zip(words, tailed)]
        new = list(dict.fromkeys(w for w in [*stems, ".", ","] if w not in known))
        whole = pc.match_substring_regex(pa.array(new, pa.string()), f"^{PLAIN}$").to_pylist()
        names, other = [w for w, p in zip(new, whole) if p], [w for w, p in zip(new, whole) if not p]
        for begin in range(0, len(names), 2048):
            some = names[begin : begin + 2048]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                other += some
                continue
            raw, at = ids.tobytes(), 0
            for name, end in zip(some, (4 * cuts).tolist()):
                known[name] = raw[at:end]
                at = end
        for name in other:
            known[name] = self.library(name).tobytes()
        for word, stem in zip(words, stems):
            if word is not stem:
                known[word] = known[stem] + known[word[-1]]

    def __call__(self, raws: list[bytes], end: int = END_ID) -> list[bytes]:
        """The ids of each text and ``end``, as little-endian unsigned 32-bit numbers."""
        last, special = struct.pack("<I", end), {i for i, raw in enumerate(raws) if b"<|" in raw}
        array = pa.array([b"" if i in special else raw for i, raw in enumerate(raws)], pa.large_binary()).cast(pa.large_string())
        words = pc.ascii_split_whitespace(pc.ascii_lower(array))
        coded = words.flatten().dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > self.limit:
            self.known = {"": b""}
        values = list(map(self.known.get, names))
        if None in values:
            self.learn([n for n, v in zip(names, values) if v is None])
            values = list(map(self.known.__getitem__, names))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids, start = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        lengths = size[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(start[at] - ends + lengths, lengths) + np.arange(total)].tobytes()
        edges = np.concatenate([[0], 4 * ends])[words.offsets.to_numpy()].tolist()
        return [(self.library(raw.decode()).tobytes() if i in special else flat[edges[i] : edges[i + 1]]) + last for i, raw in enumerate(raws)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    import public_tokenizers

    return Encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


class FileWriter:
    """Writes one token file to a stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.seeks, self.index, self.waiting, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids) // 4))
        while self.size + len(ids) > self.frame_bytes and self.size:
            self.flush()
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.size:
            raw = b"".join(self.waiting)
            for at in range(0, len(raw), 1 << 24):  # very long documents span frames
                part = raw[at : at + (1 << 24)]
                packed = self.zstd.compress(part)
                self.out.write(packed)
                self.seeks.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zstd.compress(np.array(self.index, INDEX_ROW).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)))
        rows = [*self.seeks, (len(index) + 12, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = np.array(rows, "<u4").tobytes() + SEEK_FOOT.pack(len(rows), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FileReader:
    """Reads documents of one token file, given a seekable file; only the frames asked for are read."""

    def __init__(self, file) -> None:
        self.file, self.held = file, (None, b"")
        size = file.seek(0, 2)
        if size < SEEK_FOOT.size:
            raise TokenFileError("no seek table")
        file.seek(size - SEEK_FOOT.size)
        many, flags, magic = SEEK_FOOT.unpack(file.read(SEEK_FOOT.size))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise TokenFileError("no seek table")
        begin = size - SEEK_FOOT.size - 12 * many
        file.seek(begin - 8)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE, 12 * many + SEEK_FOOT.size):
            raise TokenFileError("the seek table is damaged")
        self.table = np.frombuffer(file.read(12 * many), "<u4").reshape(many, 3).astype(np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.start = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        file.seek(int(self.place[-2]))
        block = file.read(int(self.table[-1, 0]))
        if struct.unpack("<I", block[:4])[0] != INDEX_MAGIC:
            raise TokenFileError("the document index is damaged")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:-4]), INDEX_ROW)
        self.ends = np.cumsum(self.index["tokens"].astype(np.int64))
        if self.start[-1] != 4 * (self.ends[-1] if len(self.ends) else 0):
            raise TokenFileError("the seek table and the document index differ")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.file.seek(int(self.place[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[k, 0])))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise TokenFileError(f"the checksum of frame {k} is wrong")
            self.held = (k, raw)
        return self.held[1]

    def document(self, i: int) -> bytes:
        """The ids of the i-th document of the file, its end id included."""
        end = 4 * int(self.ends[i])
        at, out = end - 4 * int(self.index["tokens"][i]), []
        while at < end:
            k = int(np.searchsorted(self.start, at, side="right")) - 1
            part = self.frame(k)[at - int(self.start[k]) : end - int(self.start[k])]
            out.append(part)
            at += len(part)
        return b"".join(out)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for executors: local and shared folders, HDFS, S3."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Writes the ids of every text to files below ``path``; returns the manifest: file, part, docs, tokens, start.

    Files follow ascending doc_id (nulls first; repeated ids by text) and each is a range
    of it. ``start`` counts the ids in all files before. A text that is null or empty is
    its end id alone. A task writes under a name of its own attempt and only files in the
    manifest count, so a lost executor leaves nothing behind: other files of the run are
    deleted, those of other runs or owners stay. There are at least as many files as keep
    each near ``FILE_BYTES`` of text, so a task's index is bounded but for floods of one id.
    The manifest, one row a file, is the only thing the driver holds.
    """
    spark = docs.sparkSession
    run_id, bounds = uuid.uuid4().hex, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bounds // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, name = task.partitionId(), f"part-{task.partitionId():06d}-{run_id}-{task.taskAttemptId()}.tok.zst"
        fs, folder = store(path)
        out = writer = None
        encode, docs_, tokens = encoder(vocabulary), 0, 0
        for batch in slices(batches, 4000):
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                writer = FileWriter(out)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch), end_id)):
                writer.add(doc_id, ids)
                docs_, tokens = docs_ + 1, tokens + len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            arrays = [pa.array([name]), pa.array([part], pa.int32()), pa.array([docs_], pa.int64()), pa.array([tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "part", "docs", "tokens"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(many, "doc_id")
    written = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, "file string, part int, docs long, tokens long").collect()
    start, rows = 0, []
    for r in sorted(written, key=lambda r: r["part"]):
        rows.append((r["file"], r["part"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    _drop_others(spark, path, run_id, {r[0] for r in rows})
    return spark.createDataFrame(rows, "file string, part int, docs long, tokens long, start long")


def _drop_others(spark: SparkSession, path: str, run_id: str, names: set[str]) -> None:
    """Deletes what failed and speculative attempts of this run have left in ``path``, and nothing else."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        for status in fs.listStatus(target):
            if run_id in status.getPath().getName() and status.getPath().getName() not in names:
                fs.delete(status.getPath(), False)


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; with ``ids`` also its ids as an array.

    Every frame's checksum is verified; a damaged file raises TokenFileError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as file:
                    reader = FileReader(file)
                    index = reader.index
                    step = 4096 if not ids else 64
                    for at in range(0, len(index), step):
                        some = range(at, min(at + step, len(index)))
                        found = [reader.document(i) for i in some]
                        doc_id = pa.array(index["doc_id"][at : some.stop], mask=index["null"][at : some.stop].astype(bool))
                        columns = [doc_id, pa.array([first + int(reader.ends[i]) - len(x) // 4 for i, x in zip(some, found)], pa.int64())]
                        columns += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in found], pa.list_(pa.int64())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    many = max(1, manifest.count())
    return manifest.select("file", "start").repartition(many, "file").mapInArrow(run, schema)


def token_output(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes the files and returns what ``read_tokens`` finds in them: one row a document.

    Files stay below ``path`` if one is given, else in the shared folder until the rows
    are read. An empty table gives no files and no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = path or scratch(spark, "tokens")
    found = cut(read_tokens(spark, folder, write_tokens(docs, folder, vocabulary, end_id)))
    if path is None:
        remove(spark, folder)
    return found
