"""Language identification with hyperdimensional profiles.

Each letter has a seeded random vector of +1 and -1. An n-gram binds the letters' vectors,
permuted by place (rotation), by multiplication; a text bundles its n-grams by addition; a
language's prototype bundles its texts. A text gets the language whose prototype has the
greatest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import fresh, slices, texts

DIMENSIONS, SEED, UNKNOWN = 1024, 7, "und"
#: Cosines of unlike vectors have the standard deviation 1 / sqrt(DIMENSIONS): a text below two of them is in no learned language.
LEAST_SCORE = 2 / DIMENSIONS**0.5
PIECE, CELLS, POSITIONS = 1 << 20, 1 << 22, 3 << 19
TOP, ROWS = 0x110000, 512


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, the code point of its lower case if it is a letter, else 0."""
    table = np.zeros(TOP, np.int64)
    for i in range(TOP):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@lru_cache(maxsize=65_536)
def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    """The vector of a letter (0: the edge of a word), the same wherever it is made."""
    bits = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dimensions)
    return (2 * bits - 1).astype(np.float32)


def pieces(raw: bytes) -> Iterator[bytes]:
    """Cuts a long text between characters, at white space if there is any; the next piece goes on where one ends."""
    while len(raw) > PIECE:
        at = max(raw.rfind(c, 0, PIECE) for c in (b" ", b"\n"))
        if at <= 0:
            at = next(i for i in range(PIECE, PIECE - 4, -1) if raw[i] & 0xC0 != 0x80)
        yield raw[:at]
        raw = raw[at:]
    yield raw


def trigrams(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c) of each distinct trigram, and (document, trigram) of each place that one begins.

    A trigram is three letters, or two with the edge of their word; none spans two words.
    """
    marks, owner = [np.zeros(1, np.int64)], [np.zeros(1, np.int32)]
    for i, raw in enumerate(group):
        for piece in pieces(raw):
            codes = letters()[np.frombuffer(piece.decode().encode("utf-32-le"), np.uint32)]
            marks.append(codes)
            owner.append(np.full(len(codes), i, np.int32))
        marks.append(np.zeros(1, np.int64))
        owner.append(np.full(1, i, np.int32))
    codes, owners = np.concatenate(marks), np.concatenate(owner)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owners = codes[keep], owners[keep]
    seen = np.zeros(TOP, bool)
    seen[codes] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    small = np.zeros(TOP, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    x, size = small[codes], len(alphabet)
    middle = x[1:-1] != 0
    gram = ((x[:-2] * size + x[1:-1]) * size + x[2:])[middle]
    if size**3 <= 1 << 24:
        there = np.zeros(size**3, bool)
        there[gram] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(size**3, np.int32)
        place[distinct] = np.arange(len(distinct))
        inverse = place[gram]
    else:
        distinct, inverse = np.unique(gram, return_inverse=True)
    parts = np.stack([alphabet[distinct // (size * size)], alphabet[distinct // size % size], alphabet[distinct % size]])
    return parts, owners[1:-1][middle], inverse


def bind(parts: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """One vector a trigram: the first letter's rotated twice, times the second's rotated once, times the third's."""
    codes, index = np.unique(parts, return_inverse=True)
    base = np.stack([letter_vector(int(c), dimensions, seed) for c in codes]) if len(codes) else np.zeros((0, dimensions), np.float32)
    a, b, c = index.reshape(3, -1)
    out = np.roll(base, 2, axis=1)[a]
    out *= np.roll(base, 1, axis=1)[b]
    out *= base[c]
    return out


def bundle(group: list[bytes], dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The vector of each text: the sum of its trigrams' vectors; zero for a text without letters."""
    parts, owner, gram = trigrams(group)
    out, n = np.zeros((len(group), dimensions), np.float32), parts.shape[1]
    step = max(1, 2 * CELLS // dimensions)
    for begin in range(0, n, step):
        vectors = bind(parts[:, begin : begin + step], dimensions, seed)
        inside = slice(None) if n <= step else (gram >= begin) & (gram < begin + step)
        own, at = owner[inside], gram[inside] - begin
        wide = len(vectors)
        rows = max(1, CELLS // max(1, wide))
        for first in range(0, len(group), rows):
            some = slice(None) if len(group) <= rows else (own >= first) & (own < first + rows)
            many = min(rows, len(group) - first)
            counts = np.bincount((own[some] - first).astype(np.int64) * wide + at[some], minlength=many * wide)
            out[first : first + many] += counts.reshape(many, wide).astype(np.float32) @ vectors
    return out


def _held_out(docs: DataFrame, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of doc_id as text leaves remainder ``fold``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The prototype of each language of ``docs`` (text and lang), over all rows with both.

    Each task sends one vector a language; they are summed by language and dimension. The
    driver gets languages x dimensions numbers, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1 << 20, POSITIONS):
            langs, raws = batch.column("lang").to_pylist(), texts(batch)
            names = sorted(set(langs))
            at = {name: i for i, name in enumerate(names)}
            by = [b"\n".join(r for r, one in zip(raws, langs) if one == name) for name in at]
            for name, vector in zip(names, bundle(by, dimensions, seed)):
                sums[name] = sums.get(name, 0) + np.rint(vector).astype(np.int64)
        names = [n for n in sums for _ in range(dimensions)]
        values = np.concatenate(list(sums.values())) if sums else np.zeros(0, np.int64)
        places = np.tile(np.arange(dimensions, dtype=np.int32), len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places), pa.array(values)], ["lang", "place", "value"])

    known = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    summed = known.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["value"]
    return {k: v for k, v in sorted(found.items()) if v.any()}


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that languages may be learned from: those not held out."""
    return docs.where(~_held_out(docs))


def predictor(profiles: dict[str, np.ndarray], seed: int = SEED):
    """A function from texts to (language, cosine) lists. Ties take the first language by name."""
    names = list(profiles)
    matrix = np.stack([(v / np.linalg.norm(v)).astype(np.float32) for v in profiles.values()]) if names else None
    dimensions = matrix.shape[1] if names else DIMENSIONS

    def predict(raws: list[bytes]) -> tuple[list[str], list[float]]:
        if not names:
            return [UNKNOWN] * len(raws), [0.0] * len(raws)
        vectors = bundle(raws, dimensions, seed)
        size = np.linalg.norm(vectors, axis=1)
        cosine = vectors @ matrix.T / np.maximum(size, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(raws)), best], 0, 1).astype(float)
        seen = size > 0
        return [names[b] if s else UNKNOWN for b, s in zip(best, seen)], [x if s else 0.0 for x, s in zip(score.tolist(), seen)]

    return predict


def languages(docs: DataFrame, train: DataFrame | None = None, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document.

    Prototypes are learned from ``train`` (text, lang), by default the documents that are
    not held out. score is the cosine with the chosen prototype, within 0 and 1. A text
    that is null or has no letter is ``und`` with score 0; so is every text where nothing
    could be learned. Repeated rows each get a prediction; other columns are ignored. One
    pass over whole texts after the one that learns; texts are never shuffled.
    """
    held = _held_out(docs)
    profiles = fit(training_rows(docs) if train is None else train, dimensions, seed)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(profiles, seed)
        for batch in slices(batches, ROWS, POSITIONS):
            langs, scores = predict(texts(batch))
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select("doc_id", held.alias("held_out"), "text")
    return chosen.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE, train: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language with at least ``least_score``.

    Texts that are null or have no letter go, and at the default those in other scripts
    or languages and random letters, whose n-grams are as far from every prototype as
    chance would have it. With 0 only texts without letters go.
    """
    profiles = fit(training_rows(docs) if train is None else train)
    (mark,) = fresh(docs, "_known")

    @F.pandas_udf("boolean")
    def known(column):
        predict, out = predictor(profiles), []
        raws = [(t or "").encode() for t in column]
        begin = 0
        while begin < len(raws):
            end, size = begin, 0
            while end < len(raws) and end < begin + ROWS and (end == begin or size + len(raws[end]) <= POSITIONS):
                size += len(raws[end])
                end += 1
            langs, scores = predict(raws[begin:end])
            out += [lang != UNKNOWN and score >= least_score for lang, score in zip(langs, scores)]
            begin = end
        return column.__class__(out, dtype=bool)

    return docs.withColumn(mark, known("text")).where(F.col(mark)).select(*docs.columns)
