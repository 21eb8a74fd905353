"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

All terms of the examples count. Examples lie in an inverted index whose postings are cut
into blocks of examples, each with its greatest weight; blocks whose bound is below the
k-th nearest found so far are not read, so the nearest examples are exact. Their votes,
weighted by closeness, become a probability by a logistic curve fitted on the examples
themselves, each left out of its own vote together with its near copies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, slices

#: Bounds of what is fitted, whatever the size of the corpus: labelled examples, and terms of all examples together.
MAX_EXAMPLES, MAX_POSTINGS = 2048, 2_000_000
#: Examples that vote, examples of a block, share of the examples from which on a term's postings are one dense row.
NEIGHBOURS, BLOCK, DENSE = 32, 64, 0.05
#: Cosine from which on examples are near copies; association (G squared) that one in 100,000 terms reaches by chance.
COPY, CHANCE, PRIOR = 0.8, 20.0, 1e-3
PREFIXES = (4, 5, 6)
NO_LETTERS = r"[^\pL]+"
Vector = tuple[np.ndarray, np.ndarray]


def terms_of(word: str) -> list[str]:
    """The terms of a lower-case word: itself, and its beginnings of 4 to 6 letters (marked) if it is longer."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words(column: pa.Array) -> pa.ListArray:
    """The runs of letters of each text, in lower case, and empty strings between others; null as an empty text."""
    plain = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    return pc.ascii_split_whitespace(pc.replace_substring_regex(plain, NO_LETTERS, " "))


def learnable(docs: Column) -> Column:
    """Whether a row's label may be learned: crc32 of doc_id as text leaves a remainder by 5 other than 0."""
    return F.pmod(F.crc32(F.coalesce(docs.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` labelled documents, chosen by a hash of doc_id among the learnable.

    A document with several labels counts as toxic if one says so; of rows with one
    doc_id, one is taken.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded set: broadcast is safe
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("_")).select("doc_id", "_.text", "_.toxic")


def _counted(rows: DataFrame, most_postings: int) -> pa.Table:
    """doc_id, toxic, terms and tf of the examples, in the order of their hash, as long as they have ``most_postings`` terms together."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            found = []
            for some in words(batch.column("text")).to_pylist():
                tf: Counter = Counter()
                for word, n in Counter(filter(None, some)).items():
                    for term in terms_of(word):
                        tf[term] += n
                found.append(tf)
            arrays = [batch.column("doc_id"), batch.column("toxic"), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "terms", "tf"])

    made = cut(rows.mapInArrow(run, f"doc_id {id_type}, toxic int, terms array<string>, tf array<long>"))
    order = F.xxhash64("doc_id").alias("h")
    sizes = made.select(order, "doc_id", F.size("terms").alias("n")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    fit = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), most_postings, side="right"))
    chosen = made if fit == sizes.num_rows else made.where(F.col("doc_id").isin(sizes.column("doc_id").to_pylist()[:fit]))
    return chosen.select(order, "*").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])


def document_frequencies(docs: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int]:
    """How many of all documents have each of ``terms``, and the number of documents.

    A task sends one number a term that it met; the driver gets one a term.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded as the examples are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, found, rows = Vectors(shared.value, np.ones(len(shared.value)), 1.0), np.zeros(len(shared.value), np.int64), 0
        for batch in slices(batches, 2000):
            found += np.bincount(vectors.terms(batch.column("text"))[1], minlength=len(found))
            rows += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(found[at], rows))], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


class Vectors:
    """Turns texts into sparse vectors of length 1 over ``terms``, weighed by ``weight``.

    A term beyond those counts in the length only, with the weight ``other``, once a word.
    """

    def __init__(self, terms: pa.Array, weight: np.ndarray, other: float) -> None:
        self.names, self.weight, self.other = terms.cast(pa.large_string()), weight, other

    def _ids(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word the places of its terms (-1: none), in columns as ``terms_of`` has them, and how many have none."""
        columns, size, strange = [], pc.utf8_length(some).to_numpy(), np.zeros(len(some), np.int64)
        for n in (0, *PREFIXES):
            name = pc.binary_join_element_wise(pc.utf8_slice_codeunits(some, 0, n), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string())) if n else some
            ids = pc.fill_null(pc.index_in(name, value_set=self.names), -1).to_numpy().astype(np.int64)
            columns.append(np.where(size > n, ids, -1))
            strange += (size > n) & (ids < 0)
        return np.stack(columns), strange

    def terms(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of each distinct known term of each text, by text and term, and the squared length that other terms add."""
        lists = words(column)
        coded = lists.flatten().dictionary_encode()
        ids, strange = self._ids(coded.dictionary)
        word, text = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        wide, many = max(1, len(self.weight)), max(1, len(strange))
        found = ids[:, word]
        key, times = np.unique((text * wide + found)[found >= 0], return_counts=True)
        some = strange[word] > 0
        odd, often = np.unique((text * many + word)[some], return_counts=True)
        rest = np.bincount(odd // many, weights=strange[odd % many] * (1 + np.log(often)) ** 2, minlength=len(lists)) if len(odd) else np.zeros(len(lists))
        return key // wide, key % wide, times, rest * self.other**2

    def __call__(self, column: pa.Array) -> list[Vector]:
        """(terms, weights) of each text: (1 + ln tf) * weight, divided by the vector's length. Empty if no term is known."""
        text, term, tf, rest = self.terms(column)
        weights = (1 + np.log(tf)) * self.weight[term]
        weights /= np.sqrt(np.bincount(text, weights=weights**2, minlength=len(rest)) + rest)[text]
        edges = np.searchsorted(text, np.arange(len(rest) + 1))
        return [(term[a:b], weights[a:b]) for a, b in zip(edges, edges[1:])]


class BlockMaxIndex:
    """Postings of examples by term, with the greatest weight of each term in each block of ``block`` examples.

    The postings of a term that a share ``dense`` of the examples has are one dense row.
    """

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK, dense: float = DENSE) -> None:
        self.block, self.n = block, len(vectors)
        self.blocks = -(-self.n // block)
        self.width = self.blocks * block
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        often = np.flatnonzero(np.bincount(terms, minlength=n_terms) > dense * self.n)
        self.row = np.full(n_terms, -1)
        self.row[often] = np.arange(len(often))
        self.often = np.zeros((len(often), self.width), np.float32)
        there = self.row[terms] >= 0
        self.often[self.row[terms[there]], owner[there]] = weight[there]
        terms, owner, weight = terms[~there], owner[~there], weight[~there]
        order = np.lexsort((owner, terms))
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros((n_terms, self.blocks), np.float32)
        np.maximum.at(self.most, (terms, owner // block), np.nextafter(weight.astype(np.float32), np.float32(2)))

    def nearest(self, queries: list[Vector], k: int, without: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (examples, cosines) of the k nearest with a cosine above 0, greatest first; ties take the first examples.

        The examples ``without`` of each query are left out. Dense rows are scored for the
        whole batch; the other postings are read only in blocks whose bound reaches the
        k-th score so far. Cosines have 6 digits.
        """
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        frequent, out = np.zeros((len(queries), len(self.often)), np.float32), []
        for i, (terms, q) in enumerate(queries):
            row = self.row[terms]
            frequent[i, row[row >= 0]] = q[row >= 0]
        first = frequent @ self.often
        for i, (terms, q) in enumerate(queries):
            skip = np.zeros(0, np.int64) if without is None else without[i]
            score, rare = first[i], self.row[terms] < 0
            terms, q = terms[rare], q[rare]
            if len(terms):
                place = self.width - k - len(skip)
                floor = np.partition(score, place)[place] if place >= 0 else 0.0
                bound = score.reshape(self.blocks, self.block).max(axis=1) + q @ self.most[terms]
                alive = bound >= floor - 2e-6
                lengths = self.start[terms + 1] - self.start[terms]
                ends = np.cumsum(lengths)
                at = np.repeat(self.start[terms] - ends + lengths, lengths) + np.arange(ends[-1])
                own = self.owner[at]
                if 2 * np.count_nonzero(alive) < len(alive):
                    read = alive[own // self.block]
                    at, own, weight = at[read], own[read], np.repeat(q, lengths)[read]
                else:
                    weight = np.repeat(q, lengths)
                score = score + np.bincount(own, weights=weight * self.weight[at], minlength=self.width)
            score = score.astype(float).round(6)
            score[skip] = 0
            least = np.partition(score, self.width - k)[self.width - k] if self.width > k else 0.0
            some = np.flatnonzero(score >= max(least, 1e-6))
            some = some[np.lexsort((some, -score[some]))][:k]
            out.append((some, score[some]))
        return out


@dataclass
class Model:
    """What scoring needs: terms with their weights, and the examples with their votes; bounded by the two limits."""

    terms: pa.Array
    weight: np.ndarray
    other: float
    ids: list
    toxic: np.ndarray
    #: One over the number of an example's near copies, itself included.
    share: np.ndarray
    vectors: list[Vector]
    base: float = 0.0
    curve: tuple[float, float] = (0.0, -10.0)

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The toxic share of the nearest examples, weighted by squared cosine; near copies have one vote together."""
        weight = cosine**2 * self.share[near]
        return float((weight @ self.toxic[near] + PRIOR * self.base) / (weight.sum() + PRIOR))

    def score(self, vote: float) -> float:
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-(slope * vote + offset))))


def association(held: np.ndarray, toxic: np.ndarray, share: np.ndarray, terms: np.ndarray, owner: np.ndarray, n_terms: int) -> np.ndarray:
    """G squared of each term with label 1 over the examples, near copies counted as one; 0 for terms that tell label 0.

    ``held`` has one True an example; ``terms`` and ``owner`` are its postings.
    """
    everything, bad = share[held].sum(), (share * toxic)[held].sum()
    n = np.bincount(terms, weights=share[owner], minlength=n_terms)
    a = np.bincount(terms, weights=(share * toxic)[owner], minlength=n_terms)
    rate = bad / everything if everything else 0.0

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 1e-9, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    rest = everything - n
    g = part(a, n * rate) + part(n - a, n * (1 - rate)) + part(bad - a, rest * rate) + part(everything - bad - n + a, rest * (1 - rate))
    return np.where(a > n * rate, 2 * g, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve nearest to ``y``, with Platt's smoothed targets."""
    bad, good = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (bad + 1) / (bad + 2), 1 / (good + 2))
    a, b = 0.0, float(np.log((bad + 1) / (good + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w, r = np.maximum(p * (1 - p), 1e-9), target - p
        h = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-9]])
        step = np.linalg.solve(h, np.array([r @ x - 1e-3 * a, r.sum()]))
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = MAX_EXAMPLES, most_postings: int = MAX_POSTINGS) -> Model:
    """The model, from at most ``most_examples`` labelled documents with ``most_postings`` terms together.

    Document frequencies are counted over all of ``docs``. A term weighs its inverse
    document frequency times 1 + sqrt(G squared - ``CHANCE``) of its association with
    label 1, where that is positive: no term is left out, those that tell weigh more.
    """
    made = _counted(cut(examples(docs, labels, most_examples)), most_postings)
    lists = made.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    names = pc.array_sort_indices(coded.dictionary)
    terms = coded.dictionary.take(names)
    at = np.argsort(names.to_numpy())[coded.indices.to_numpy()]
    df, rows = document_frequencies(docs, terms)
    idf, other = np.log((1 + rows) / (1 + df)) + 1, float(np.log((1 + rows) / 2) + 1) if rows else 1.0
    edges, times, raw = np.cumsum([0, *pc.list_value_length(lists).to_pylist()]), 1 + np.log(made.column("tf").combine_chunks().flatten().to_numpy()), []
    for a, b in zip(edges, edges[1:]):
        order = np.argsort(at[a:b])
        raw.append((at[a:b][order], times[a:b][order]))
    # nearby blocks hold alike examples, so that bounds are tight: by which of the most frequent terms they have
    common = np.argsort(-np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in raw)]), minlength=len(terms)), kind="stable")[:16]
    has = np.array([np.isin(common, t) for t, _ in raw]).reshape(len(raw), len(common))
    by = np.lexsort((np.arange(len(raw)), *has.T[::-1]))
    raw, made = [raw[i] for i in by], made.select(["doc_id", "toxic"]).take(by)

    def weighed(weight: np.ndarray) -> list[Vector]:
        return [(t, w * weight[t] / np.linalg.norm(w * weight[t])) if len(t) else (t, w) for t, w in raw]

    toxic = made.column("toxic").to_numpy().astype(float)
    plain, k = weighed(idf), 256
    copies = [np.arange(0)] * len(raw)
    index = BlockMaxIndex(plain, len(terms))
    for begin in range(0, len(raw), k):
        for i, (near, cosine) in enumerate(index.nearest(plain[begin : begin + k], len(raw)), begin):
            copies[i] = np.union1d(near[cosine >= COPY], [i]).astype(np.int64)
    share = 1 / np.array([len(c) for c in copies], float) if raw else np.zeros(0)
    owner = np.repeat(np.arange(len(raw)), [len(t) for t, _ in raw])
    told = association(np.ones(len(raw), bool), toxic, share, np.concatenate([np.zeros(0, np.int64), *(t for t, _ in raw)]), owner, len(terms))
    weight = idf * (1 + np.sqrt(np.maximum(0, told - CHANCE)))
    model = Model(terms, weight, other, made.column("doc_id").to_pylist(), toxic, share, weighed(weight))
    model.base = float(share @ toxic / share.sum()) if raw else 0.0
    if 0 < toxic.sum() < len(toxic):
        index, votes = BlockMaxIndex(model.vectors, len(terms)), []
        for begin in range(0, len(raw), k):
            votes += [model.vote(*found) for found in index.nearest(model.vectors[begin : begin + k], NEIGHBOURS, copies[begin : begin + k])]
        model.curve = logistic(np.array(votes), toxic)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, most_examples: int = MAX_EXAMPLES, most_postings: int = MAX_POSTINGS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: one row a document.

    score is the probability of label 1, within 0 and 1; predicted is 1 from 0.5 on;
    evidence lists the doc_ids of the nearest labelled examples, nearest first. A text
    that is null, empty or shares no term with any example has no neighbours and gets the
    score of the examples' toxic share. Without labels of both kinds every score is near
    0. Repeated rows stay; an empty table gives no rows; other columns are ignored. What
    is fitted is bounded by ``most_examples`` and ``most_postings``; document frequencies
    are counted over all documents, and every document is scored over its whole text,
    without a shuffle of texts.
    """
    model = fit(docs, labels, most_examples, most_postings)
    id_type = docs.schema["doc_id"].dataType
    arrow = pa.int64() if id_type.simpleString() in ("bigint", "int") else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: examples and their terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vectors, index = Vectors(model.terms, model.weight, model.other), BlockMaxIndex(model.vectors, len(model.terms))
        for batch in slices(batches, 2000):
            made = vectors(batch.column("text"))
            found = [one for begin in range(0, len(made), 128) for one in index.nearest(made[begin : begin + 128], NEIGHBOURS)]
            scores = [model.score(model.vote(near, cosine)) for near, cosine in found]
            score, predicted = pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())
            evidence = pa.array([[model.ids[i] for i in near] for near, _ in found], pa.list_(arrow or batch.column("doc_id").type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), score, predicted, evidence], ["doc_id", "held_out", "score", "predicted", "evidence"])

    chosen = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "text")
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, score double, predicted int, evidence array<{'bigint' if arrow else id_type.simpleString()}>"
    return chosen.mapInArrow(run, schema)
