"""Toxicity of incident reports from their nearest labelled examples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import Words, chunks, words_of
from kerbline.llm.workers import ship_package
from kerbline.session import durable

# Labelled examples used, about; they are drawn by a hash of the key and the text.
EXAMPLES = 2_500
# Words associated with the label above a chi-square of chance, in at least so many examples,
# count in full; every other word of the examples counts as well, with this share of its weight.
LEAST_CHI_SQUARE = 30.0
LEAST_EXAMPLES = 5
ORDINARY = 0.1
NEIGHBOURS = 15
BLOCK = 256
# Blocks scored at once before the bounds are looked at again; each time twice as many.
STRIDE = 4


def _term_counts(words: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, count) of the words that are terms."""
    at = np.searchsorted(terms, words.keys)
    at[at == len(terms)] = 0
    known = np.flatnonzero(terms[at] == words.keys) if len(terms) else np.zeros(0, np.int64)
    text = np.searchsorted(words.first, known, side="right") - 1
    both, count = np.unique(text * max(1, len(terms)) + at[known], return_counts=True)
    return both // max(1, len(terms)), both % max(1, len(terms)), count


@dataclass
class Weights:
    """Terms (sorted keys) and their weights: inverse document frequency times what the label says."""

    terms: np.ndarray
    idf: np.ndarray

    def vectors(self, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its terms and their TF-IDF weights, of length 1; empty if it has no term."""
        text, term, count = _term_counts(words, self.terms)
        weight = (1 + np.log(count)) * self.idf[term]
        n = len(words.first) - 1
        norm = np.sqrt(np.bincount(text, weight**2, n))
        weight = weight / np.maximum(norm[text], 1e-300)
        cuts = np.searchsorted(text, np.arange(n + 1))
        return [(term[a:b], weight[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class BlockMaxIndex:
    """An inverted index over example vectors in blocks, with each term's largest weight per block.

    Equal vectors are one entry with the number of its examples and of the toxic
    ones among them. ``search`` gives exactly the nearest entries by cosine: it
    scores blocks in the order of their upper bounds and stops when no bound
    exceeds the weakest neighbour found.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, ids: list, terms: int):
        entries: dict[bytes, int] = {}
        self.number, self.toxic, self.example = [], [], []
        kept = []
        # Entries with the same strongest term lie together, which keeps the bounds tight.
        order = sorted(range(len(vectors)), key=lambda i: _strongest(vectors[i]))
        for i in order:
            term, weight = vectors[i]
            if not len(term):
                continue
            place = entries.setdefault(term.tobytes() + weight.tobytes(), len(kept))
            if place == len(kept):
                kept.append((term, weight))
                self.number.append(0)
                self.toxic.append(0)
                self.example.append(ids[i])
            self.number[place] += 1
            self.toxic[place] += int(toxic[i])
        self.number, self.toxic = np.array(self.number, np.float64), np.array(self.toxic, np.float64)
        self.size = len(kept)
        self.blocks = (self.size + BLOCK - 1) // BLOCK
        sizes = [len(t) for t, _ in kept]
        term = np.concatenate([t for t, _ in kept]) if kept else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in kept]) if kept else np.zeros(0)
        entry = np.repeat(np.arange(self.size), sizes)
        by_term = np.lexsort((entry, term))
        self._entry, self._weight, term = entry[by_term].astype(np.int32), weight[by_term], term[by_term]
        # A cell is a term in a block: where its entries begin, its block and its largest weight.
        cell = term * max(1, self.blocks) + self._entry // BLOCK
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self._from = np.append(first, len(cell))
        self._block = (cell[first] % max(1, self.blocks)).astype(np.int32)
        self._most = np.maximum.reduceat(self._weight, first) if len(first) else np.zeros(0)
        self._cells = np.searchsorted(term[first], np.arange(terms + 1))

    def search(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest, nearest first; equal cosines by entry. Only cosines above 0."""
        cell, many = _ranges(self._cells[term], self._cells[term + 1])
        block, each = self._block[cell], np.repeat(weight, many)
        bounds = np.bincount(block, each * self._most[cell], max(1, self.blocks))
        order = np.argsort(-bounds, kind="stable")
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        begin, stride = 0, STRIDE
        while begin < len(order):
            least = cosine[-1] if len(cosine) == k else 0.0
            blocks = order[begin : begin + stride]
            blocks = blocks[(bounds[blocks] > 0) & (bounds[blocks] >= least - 1e-12)]
            if not len(blocks):
                break
            begin, stride = begin + stride, 2 * stride
            chosen = np.zeros(len(bounds), bool)
            chosen[blocks] = True
            now = np.flatnonzero(chosen[block])
            at, inside = _ranges(self._from[cell[now]], self._from[cell[now] + 1])
            scores = np.bincount(self._entry[at], self._weight[at] * np.repeat(each[now], inside), self.size)
            found = np.flatnonzero(scores)
            if len(found) > 2 * k:
                floor = np.partition(scores[found], len(found) - k)[len(found) - k]
                found = found[scores[found] >= floor]
            best, cosine = np.concatenate([best, found]), np.concatenate([cosine, scores[found]])
            top = np.lexsort((best, -cosine))[:k]
            best, cosine = best[top], cosine[top]
        return best, np.minimum(cosine, 1.0)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one after another, and the length of each."""
    many = end - begin
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum()), many


def _strongest(vector: tuple[np.ndarray, np.ndarray]) -> tuple:
    term, weight = vector
    return (int(term[np.argmax(weight)]), len(term)) if len(term) else (-1, 0)


@dataclass
class Votes:
    """Scores from neighbours: votes weigh by closeness, and the base rate has one vote at distance 1."""

    weights: Weights
    index: BlockMaxIndex
    base: float
    none: float
    k: int

    def score(self, term: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        entries, cosine = self.index.search(term, weight, self.k) if len(term) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(entries):
            return (self.none if not len(term) else self.base), entries, cosine
        closeness = cosine / (1.05 - cosine)
        total = (closeness * self.index.number[entries]).sum()
        toxic = (closeness * self.index.toxic[entries]).sum()
        return float((toxic + self.base) / (total + 1)), entries, cosine


def score_toxicity(
    reports: DataFrame,
    labelled: DataFrame,
    key: str = "event_id",
    text: str = "report",
    label: str = "toxic",
    examples: int = EXAMPLES,
    ordinary: float = ORDINARY,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """Scores every whole report by its nearest labelled examples.

    ``labelled`` has ``key``, ``text`` and ``label`` (1: toxic, 0: not). Method:
    about ``examples`` of its rows are drawn by a hash, and all their words span the
    vectors. A word weighs its inverse document frequency over all reports, in full
    if it is associated with the label (chi-square at least ``LEAST_CHI_SQUARE``)
    and else the share ``ordinary`` of it. The ``neighbours`` nearest distinct
    example vectors by exact cosine come from a block-max inverted index, whose
    size the number of examples bounds, and vote with weight cosine / (1.05 -
    cosine) and their numbers of examples.

    Returns per input row: ``key``, score (0 to 1), predicted (1 if score >= 0.5),
    evidence (array of example, cosine, share: the key of one example of the
    neighbour and its share of toxic ones; nearest first).

    Edge cases: a report without any word of the examples, as a null or empty one, gets the share
    of toxic ones among examples without any; 0 if nothing could be learned.
    Equal cosines go by the order of the index. Rows without a label or text
    teach nothing; a key may repeat. Other columns are ignored.
    """
    spark = reports.sparkSession
    ship_package(spark)
    texts = reports.select(F.col(key).alias("id"), F.col(text).alias("text"))
    drawn = _examples(labelled, key, text, label, examples)
    terms, share = _terms(drawn, ordinary)
    weights = Weights(terms, _idf(texts, terms) * share)
    votes = spark.sparkContext.broadcast(_votes(drawn, weights, neighbours))
    kind = texts.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = votes.value
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column(1)):
                scores, evidence = [], []
                for term, weight in held.weights.vectors(words_of(data, offsets)):
                    value, entries, cosine = held.score(term, weight)
                    scores.append(value)
                    share = held.index.toxic[entries] / held.index.number[entries] if len(entries) else cosine
                    evidence.append(
                        [
                            {"example": held.index.example[e], "cosine": c, "share": s}
                            for e, c, s in zip(entries.tolist(), cosine.tolist(), share.tolist(), strict=True)
                        ]
                    )
                fields = [("example", pa.string()), ("cosine", pa.float64()), ("share", pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:to], pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.struct(fields)))],
                    ["id", "score", "evidence"],
                )

    schema = f"id {kind}, score double, evidence array<struct<example: string, cosine: double, share: double>>"
    return texts.mapInArrow(score, schema).select(
        F.col("id").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def _examples(labelled: DataFrame, key: str, text: str, label: str, examples: int) -> DataFrame:
    known = labelled.select(
        F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("toxic")
    ).where("text IS NOT NULL AND toxic IN (0, 1)")
    share = examples / max(examples, known.count())
    return durable(known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))), "examples")


def _terms(drawn: DataFrame, ordinary: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the examples, sorted, and 1 for those that say something about the label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for begin, to, data, offsets in chunks(batch.column("text")):
                words = words_of(data, offsets)
                text = np.repeat(np.arange(to - begin), np.diff(words.first))
                order = np.lexsort((text, words.keys))
                k, t = words.keys[order], text[order]
                once = np.ones(len(k), bool)
                once[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
                keys, where = np.unique(k[once], return_inverse=True)
                bad = np.bincount(where, toxic[begin:to][t[once]], len(keys)).astype(np.int64)
                n = np.bincount(where, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(n), pa.array(bad)], ["term", "n", "bad"]
                )

    whole = drawn.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    every, bad = float(whole["n"]), float(whole["bad"] or 0)
    counts = drawn.mapInArrow(count, "term long, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rows = counts.toArrow()
    terms = rows.column("term").to_numpy().view(np.uint64)
    n, b = rows.column("n").to_numpy().astype(np.float64), rows.column("bad").to_numpy()
    least = bad * (every - bad) * n * (every - n)
    chi_square = np.divide((b * every - n * bad) ** 2 * every, least, out=np.zeros(len(n)), where=least > 0)
    share = np.where((chi_square >= LEAST_CHI_SQUARE) & (n >= LEAST_EXAMPLES), 1.0, ordinary)
    order = np.argsort(terms)
    return terms[order], share[order]


def _idf(texts: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Inverse document frequencies over all reports; one number per term reaches the driver."""
    if not len(terms):
        return np.zeros(0)
    wanted = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(wanted.value), np.int64), 0
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column(0)):
                _, term, _ = _term_counts(words_of(data, offsets), wanted.value)
                total += np.bincount(term, minlength=len(total))
                rows += to - begin
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(-1, held)), pa.array(np.append(rows, total[held]))], ["term", "n"]
        )

    summed = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    # The rows are counted under -1, the last place.
    found = np.zeros(len(terms) + 1)
    found[summed.column("term").to_numpy()] = summed.column("n").to_numpy()
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1e-3


def _votes(drawn: DataFrame, weights: Weights, neighbours: int) -> Votes:
    """The index over the examples; their vectors, not their texts, come to the driver."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column("text")):
                found = weights.vectors(words_of(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[begin:to],
                        batch.column("toxic")[begin:to],
                        pa.array([t for t, _ in found], pa.list_(pa.int64())),
                        pa.array([w for _, w in found], pa.list_(pa.float64())),
                    ],
                    ["id", "toxic", "terms", "weights"],
                )

    schema = "id string, toxic int, terms array<long>, weights array<double>"
    rows = drawn.mapInArrow(vectors, schema).orderBy("id").toArrow()
    toxic = np.array(rows.column("toxic").to_pylist(), np.int64)
    every = [c.combine_chunks() for c in (rows.column("terms"), rows.column("weights"))]
    sizes = np.cumsum(every[0].value_lengths().to_numpy())[:-1] if len(toxic) else []
    held = list(zip(*[np.split(c.flatten().to_numpy(), sizes) for c in every], strict=True)) if len(toxic) else []
    index = BlockMaxIndex(held, toxic, rows.column("id").to_pylist(), max(1, len(weights.terms)))
    base = float(toxic.mean()) if len(toxic) else 0.0
    empty = [y for y, (t, _) in zip(toxic.tolist(), held, strict=True) if not len(t)]
    none = (sum(empty) + base) / (len(empty) + 1) if len(toxic) else 0.0
    return Votes(weights, index, base, none, neighbours)
