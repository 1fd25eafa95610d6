"""Ranked search of incident reports for the names of road segments, by classes of equal bags of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.records import lower_ascii
from kerbline.llm.words import chunks, words_of
from kerbline.llm.workers import ship_package
from kerbline.session import durable

HITS = 10
# A term: letters, digits and characters above ASCII, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Distinct terms of the queries that are looked for at once; more queries take more passes.
BLOCK_TERMS = 1 << 20
# Scores, and products of scores, held at once in a task.
CELLS = 1 << 21


@dataclass
class QueryBlock:
    """The terms of some queries (sorted keys) and, per term, the queries that hold it with their weights."""

    terms: np.ndarray
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    ids: pa.Array


def _bags(reports: DataFrame, terms: np.ndarray) -> DataFrame:
    """(id, n, terms, tfs): a report's number of terms, and its counts of those that are asked for."""
    kind = reports.schema["id"].dataType.simpleString()
    held = reports.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column(1)):
                words = words_of(data, offsets)
                at = np.searchsorted(wanted, words.keys)
                at[at == len(wanted)] = 0
                known = np.flatnonzero(wanted[at] == words.keys) if len(wanted) else np.zeros(0, np.int64)
                owner = np.searchsorted(words.first, known, side="right") - 1
                both, times = np.unique(owner * max(1, len(wanted)) + at[known], return_counts=True)
                ends = np.searchsorted(both // max(1, len(wanted)), np.arange(to - begin + 1), side="left")
                cut = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[begin:to],
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.ListArray.from_arrays(cut, pa.array((both % max(1, len(wanted))).astype(np.int32))),
                        pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                    ],
                    ["id", "n", "terms", "tfs"],
                )

    return reports.mapInArrow(count, f"id {kind}, n long, terms array<int>, tfs array<long>").where("n > 0")


def _scores(block: QueryBlock, rows: pa.RecordBatch) -> np.ndarray:
    """Scores of these classes (terms, tfs, m) for every query of the block, in whole numbers."""
    n, queries = rows.num_rows, len(block.ids)
    out = np.zeros((queries, n), np.int64)
    lists = rows.column("terms")
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    term = lists.flatten().to_numpy()
    tf = rows.column("tfs").flatten().to_numpy()
    owner = np.repeat(np.arange(n), sizes)
    m = rows.column("m").to_numpy()[owner]
    share = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    many = block.first[term + 1] - block.first[term]
    reach = np.cumsum(many)
    begin = 0
    while begin < len(term):
        # At least one entry at once; its queries are bounded by the block.
        to = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + CELLS, side="right")))
        k = many[begin:to]
        at = np.repeat(block.first[term[begin:to]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        np.add.at(
            out.reshape(-1),
            block.query[at] * n + np.repeat(owner[begin:to], k),
            block.weight[at] * np.repeat(share[begin:to], k),
        )
        begin = to
    return out


class _Best:
    """The best classes of each query so far: by score, then by the smallest identifier."""

    def __init__(self, queries: int, k: int, none: pa.Array):
        self.k, self.least = k, np.ones(queries, np.int64)
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), none

    def take(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``ids``: per class its smallest identifiers in order."""
        floor = self.least[:, None]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k, None])
        query, place = np.nonzero(scores >= floor)
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, scores[query, place]])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(place))])
        # A class that is behind k others by its first identifier has no report among the best.
        first = _ranks(self.ids.flatten().take(self.ids.offsets[:-1]))
        keep = _leading(self.query, self.score, first, self.k)
        self.query, self.score, self.ids = self.query[keep], self.score[keep], self.ids.take(pa.array(keep))
        full = np.bincount(self.query, minlength=len(self.least)) >= self.k
        worst = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.query, self.score)
        self.least = np.where(full, worst, self.least)

    def reports(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(query, score, id) of the best reports, classes expanded."""
        sizes = self.ids.value_lengths().to_numpy().astype(np.int64)
        query, score, ids = np.repeat(self.query, sizes), np.repeat(self.score, sizes), self.ids.flatten()
        keep = _leading(query, score, _ranks(ids), self.k)
        return query[keep], score[keep], ids.take(pa.array(keep))


def _ranks(ids: pa.Array) -> np.ndarray:
    return np.unique(np.array(ids.to_pylist()), return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)


def _leading(query: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((rank, -score, query))
    nth = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
    return order[nth < k]


def search_reports(
    reports: DataFrame,
    queries: DataFrame,
    key: str = "event_id",
    text: str = "report",
    query: str = "segment_id",
    query_text: str = "segment_name",
    k: int = HITS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` reports that fit each queried text best, among all reports.

    Terms are runs of letters, digits and characters above ASCII, A-Z lower-cased.
    N counts the reports with a term, L all their terms, n a report's terms, df the
    reports that hold a term, tf its occurrences in a report. A term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), a report has m = 25 + 75 n N div L,
    and its score is the sum of w (10^9 tf div (1000 tf + 8m)) over the query's
    terms with repeats.

    Method: reports are restricted to the terms of the queries. Those with the same
    counts of these and the same m are one class (hashed, then compared in full),
    which is scored once and stands for its ``k`` smallest keys. Tasks keep the
    best classes of each query and expand them. Queries are handled in blocks of
    about ``block_terms`` terms, so what is broadcast is bounded; each further
    block is one more pass over the reports.

    Returns query, rank (from 1), key, score for scores above 0; equal scores by
    ascending key.

    Edge cases: null or empty texts have no terms and are found by nothing, and a
    query without terms finds nothing. Rows with the same query key are one query
    with the terms of all. A report without a key counts for the statistics and is
    not returned, a query without a key is ignored; each row of a repeated report
    is a report. Empty tables give an empty result. Other columns are ignored.
    """
    spark = reports.sparkSession
    ship_package(spark)
    given = reports.select(F.col(key).alias("id"), F.col(text).alias("text"))
    asked = queries.where(F.col(query).isNotNull()).select(
        F.col(query).alias("query"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col(query_text)), F.lit(TERM), F.lit(0))).alias("term"),
    )
    asked = durable(_keyed(asked.groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))), "query-terms")
    blocks = ceil(asked.count() / block_terms)
    best = None
    for number in range(blocks):
        of = F.pmod(F.xxhash64("query"), F.lit(blocks)) == number
        found = _search(given, asked.where(of), k)
        best = found if best is None else best.unionByName(found)
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, id {given.schema['id'].dataType.simpleString()}, score long"
    best = best if best is not None else spark.createDataFrame([], kinds)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return (
        best.withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select(F.col("query").alias(query), "rank", F.col("id").alias(key), "score")
    )


def _keyed(terms: DataFrame) -> DataFrame:
    """Adds the 64-bit key by which words of texts are looked up."""
    kind = terms.schema["query"].dataType.simpleString()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column("term")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query")[begin:to], pa.array(words_of(data, offsets).keys.view(np.int64)), batch.column("times")[begin:to]],
                    ["query", "term", "times"],
                )

    return terms.mapInArrow(key, f"query {kind}, term long, times long")


def _search(given: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the best reports of these queries, as found by each task."""
    spark = given.sparkSession
    terms = np.sort(asked.select("term").distinct().toArrow().column("term").to_numpy().view(np.uint64))
    bags = durable(_bags(given, terms), "bags")
    whole = bags.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n, length = whole["n"], whole["l"] or 1
    df = bags.select(F.explode("terms").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df")).toArrow()
    block = _query_block(asked, terms, n, df)
    m = F.expr(f"25L + (75L * n * {n}L) div {length}L")
    bag = ["mark", "terms", "tfs", "m"]
    alike = bags.where((F.size("terms") > 0) & F.col("id").isNotNull()).select(
        F.xxhash64("terms", "tfs", m).alias("mark"), "terms", "tfs", m.alias("m"), "id"
    )
    # The limit is applied before the shuffle too, so a class of any size moves k rows a task.
    first = F.row_number().over(Window.partitionBy(*bag).orderBy("id"))
    classes = (
        alike.withColumn("_nth", first)
        .where(F.col("_nth") <= k)
        .groupBy(*bag)
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("terms", "tfs", "m", "ids")
    )
    held = spark.sparkContext.broadcast(block)
    kind, query_kind = (d.schema[c].dataType.simpleString() for d, c in ((given, "id"), (asked, "query")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = held.value, None
        for batch in batches:
            best = best or _Best(len(block.ids), k, batch.column("ids").take(pa.array([], pa.int64())))
            at_once = max(1, CELLS // max(1, len(block.ids)))
            for begin in range(0, batch.num_rows, at_once):
                some = batch.slice(begin, at_once)
                best.take(_scores(block, some), some.column("ids"))
        if best is not None:
            query, scores, ids = best.reports()
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(query)), ids, pa.array(scores)], ["query", "id", "score"])

    return durable(classes.mapInArrow(score, f"query {query_kind}, id {kind}, score long"), "best-reports")


def _query_block(asked: DataFrame, terms: np.ndarray, n: int, df: pa.Table) -> QueryBlock:
    """The block's queries by term; weights of terms that no report holds are left out."""
    rows = asked.orderBy("query", "term").toArrow()
    numbered = rows.column("query").combine_chunks().dictionary_encode()
    found = np.zeros(len(terms), np.int64)
    found[df.column("place").to_numpy()] = df.column("df").to_numpy()
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * found + 1))).astype(np.int64)
    place = np.searchsorted(terms, rows.column("term").to_numpy().view(np.uint64))
    order = np.lexsort((numbered.indices.to_numpy(), place))
    place = place[order]
    return QueryBlock(
        terms,
        np.searchsorted(place, np.arange(len(terms) + 1)),
        numbered.indices.to_numpy().astype(np.int64)[order],
        (rows.column("times").to_numpy() * weight[np.searchsorted(terms, rows.column("term").to_numpy().view(np.uint64))])[order],
        numbered.dictionary,
    )
