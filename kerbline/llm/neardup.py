"""Near-duplicate incident reports by DartMinHash and banded joining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.components import components
from kerbline.llm.words import Words, chunks, mixed, powers, words_of
from kerbline.llm.workers import ship_package
from kerbline.session import durable

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Pairs at the least similarity share no band with probability (1 - 0.8**7)**48, about 1e-5.
BANDS = 48
ROWS = 7
# Buckets of up to so many texts are compared in full; larger ones by several pivots a round,
# and what these leave by a join on rare shingles.
FULL_BUCKET = 16
PIVOTS = 3
PIVOT_ROUNDS = 1
# Cells in which shingles are counted; the counts only decide which shingles are joined first.
COUNT_CELLS = 1 << 18
# Texts of one shingle that one salt of the join gets.
SALT_ROWS = 4096
# Sizes are whole numbers; this keeps a similarity that is met exactly.
ROUNDING = 1e-6

# Rank slabs of the dart board: fine where long texts end, 4 high above.
_SLABS = np.concatenate([[0.0], 2.0 ** np.arange(-8, 3)])
_TALLEST = 4.0


def _slab(number: int) -> tuple[float, float]:
    if number < len(_SLABS) - 1:
        return float(_SLABS[number]), float(_SLABS[number + 1])
    low = float(_SLABS[-1]) + _TALLEST * (number - len(_SLABS) + 1)
    return low, low + _TALLEST


def _poisson_limits(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts in a region of this area."""
    limits, term, total, i = [], np.exp(-mean), 0.0, 0
    while total < 1 - 1e-17 and i < 60:
        total += term
        limits.append(min(total, 1.0))
        i += 1
        term *= mean / i
    return np.array(limits)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_sketches(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Weighted signatures of n sets: per coordinate the rank of the earliest dart, inf for an empty set.

    Each element has a board of weight times rank on which darts lie at places
    that its key decides, one per unit of area on average. A set owns the part of
    the board below its weights; a dart falls to one of the k coordinates. Only
    darts up to a rank at which k ln k + 2k are expected are thrown; sets with an
    empty coordinate double that rank. Two sets agree in a coordinate with the
    probability of their weighted Jaccard similarity.
    """
    ranks = np.full((n, k), np.inf)
    if not len(keys):
        return ranks
    total = np.bincount(owner, weights, n)
    limit = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    cells = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(keys)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    boards = mixed(keys[of] ^ mixed(cell.astype(np.uint64)))
    inside = weights[of] - cell
    sets = owner[of]
    todo = total > 0
    while todo.any():
        number = 0
        live = np.flatnonzero(todo[sets])
        while True:
            low, high = _slab(number)
            live = live[limit[sets[live]] > low]
            if not len(live):
                break
            region = mixed(boards[live] ^ np.uint64(0xD6E8FEB86659FD93 * (number + 1) & (2**64 - 1)))
            many = np.searchsorted(_poisson_limits(high - low), _unit(region), side="right")
            hit = np.repeat(np.arange(len(live)), many)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
            dart = mixed(region[hit] + nth.astype(np.uint64))
            rank = low + (high - low) * _unit(dart)
            place = mixed(dart)
            board = live[hit]
            keep = (_unit(mixed(place)) < inside[board]) & (rank <= limit[sets[board]])
            at = sets[board[keep]] * k + (place[keep] % np.uint64(k)).astype(np.int64)
            np.minimum.at(ranks.reshape(-1), at, rank[keep])
            number += 1
        todo &= np.isinf(ranks).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    return ranks


def shingles_of(words: Words, counted: bool, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, weight, text) of each text's distinct shingles; a shorter text with words is one shingle."""
    n = len(words.first) - 1
    keys, at = words.windows(size)
    owner = np.searchsorted(words.first, at, side="right") - 1
    count = np.diff(words.first)
    for short in range(1, size):
        which = np.flatnonzero(count == short)
        if len(which):
            whole = np.zeros(len(which), np.uint64)
            for j in range(short):
                whole = mixed(whole + words.keys[words.first[which] + j])
            keys, owner = np.concatenate([keys, whole]), np.concatenate([owner, which])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    repeats = np.diff(np.append(begin, len(keys)))
    weights = repeats.astype(np.float64) if counted else np.ones(len(begin))
    return keys[begin], weights, owner[begin]


def _fingerprints(words: Words) -> list[np.ndarray]:
    """Two 64-bit keys of each text's whole sequence of words."""
    out, n = [], len(words.keys)
    for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        up, down = powers(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.keys * up[:n], out=sums[1:])
        begin, end = words.first[:-1], words.first[1:]
        out.append(mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64))
    return out


def _signatures(reports: DataFrame, bands: int, rows: int, counted: bool) -> DataFrame:
    kind = reports.schema["id"].dataType.simpleString()
    shift = [pow(0x2545F4914F6CDD1D, j, 1 << 64) for j in range(rows)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column(1)):
                words = words_of(data, offsets)
                keys, weights, owner = shingles_of(words, counted)
                ranks = dart_sketches(keys, weights, owner, to - begin, bands * rows)
                bits = ranks.view(np.uint64).reshape(to - begin, bands, rows)
                band = np.zeros((to - begin, bands), np.uint64)
                for j in range(rows):
                    band += mixed(bits[:, :, j]) * np.uint64(shift[j])
                band = mixed(band ^ mixed(np.arange(bands, dtype=np.uint64))).view(np.int64)
                size = np.bincount(owner, weights, to - begin).astype(np.int64)
                hashed = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, band.size + 1, bands), pa.int32()), pa.array(band.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:to], *map(pa.array, _fingerprints(words)), pa.array(size), hashed],
                    ["id", "fp", "fp2", "size", "bands"],
                )

    return reports.mapInArrow(sign, f"id {kind}, fp long, fp2 long, size long, bands array<long>")


def _shingle_sets(reports: DataFrame, counted: bool) -> DataFrame:
    """(id, set): the distinct shingle keys; repeats are numbered when they count."""
    kind = reports.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, to, data, offsets in chunks(batch.column(1)):
                keys, weights, owner = shingles_of(words_of(data, offsets), counted)
                times = weights.astype(np.int64)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                keys, owner = mixed(np.repeat(keys, times) ^ mixed(nth.astype(np.uint64))), np.repeat(owner, times)
                ends = np.searchsorted(owner, np.arange(to - begin + 1), side="left")
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:to], sets], ["id", "set"])

    return reports.mapInArrow(build, f"id {kind}, set array<long>")


def near_duplicates(
    reports: DataFrame,
    key: str = "event_id",
    text: str = "report",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    counted: bool = False,
) -> DataFrame:
    """The class of near-duplicates of each report: those linked by similarity, directly or in steps.

    Method: DartMinHash signatures of the five-word shingles, joined by bands and
    verified by exact Jaccard similarity. ``counted`` gives a shingle the weight
    of its repeats (weighted Jaccard); otherwise each weighs 1. Words are as in
    the decontamination: A-Z lower-cased, runs of letters, digits and characters
    above ASCII.

    Texts with the same words are one text from the start. In a band's bucket
    every text is first compared with the pivot, the one of least global
    priority, so a bucket of any size gives a linear number of pairs. Buckets
    that then still hold several classes are looked at again: small ones in full
    across the classes, larger ones in ``PIVOT_ROUNDS`` rounds by pivots that each
    bucket draws for itself and for each round. The pivots only join classes
    early: texts of large buckets that still hold several classes are joined on
    their rare shingles (prefix filter with bounds by length and position), which
    finds every similar pair among them, so no cap decides about a link.

    Returns per input row: ``key``, class_id (smallest key of the class),
    class_size (rows). Edge cases: a text without words is alone in its class,
    also if others are equal; one of fewer than five words is a single shingle.
    A row without a key has no class (nulls). A key should name one text; if it
    comes with another text as well, that row is classed by its own text. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = reports.sparkSession
    ship_package(spark)
    texts = reports.select(F.col(key).alias("id"), F.col(text).alias("text"))
    named = texts.where(F.col("id").isNotNull())
    signed = durable(_signatures(named, bands, rows, counted), "signatures")
    # Equal word sequences: one stands for all.
    same = durable(
        signed.where("size > 0").groupBy("fp", "fp2").agg(F.min("id").alias("id")), "distinct-texts"
    )
    single = signed.where("size > 0").join(same, ["fp", "fp2", "id"], "left_semi").dropDuplicates(["id", "fp", "fp2"])
    in_bands = durable(single.select("id", "size", F.explode("bands").alias("band")), "bands")
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Both sides grow with the reports.
    buckets = durable(in_bands.join(shared.hint("merge"), "band"), "buckets")
    near = _Near(named, similarity, counted)

    links = near.verified(_pivots(buckets.withColumn("class", F.col("id")), (0,), similarity, F.lit(0)))
    labels = components(links)
    for number in range(PIVOT_ROUNDS):
        split = _split_buckets(buckets, labels)
        large = split.where(F.col("n") > FULL_BUCKET)
        attempts = tuple(range(1 + number * PIVOTS, 1 + (number + 1) * PIVOTS))
        pairs = _pivots(large, attempts, similarity, F.col("band"))
        if number == 0:
            # Small buckets are done after this; classes only grow.
            pairs = _across(split.where(F.col("n") <= FULL_BUCKET), similarity).union(pairs).distinct()
        more = near.verified(pairs)
        if not more.isEmpty():
            links = durable(links.unionByName(more), "all-links")
            labels = components(links)
    large = _split_buckets(buckets.where(F.col("n") > FULL_BUCKET), labels)
    rest = durable(large.select("id", "size", "class").distinct(), "rest")
    if not rest.isEmpty():
        more = near.verified(_by_rare_shingles(near.sets_of(rest), near.sets_of(None), similarity))
        labels = components(durable(links.unionByName(more), "all-links"))

    classes = signed.join(same.withColumnRenamed("id", "_first"), ["fp", "fp2"], "left").select(
        "id", F.when(F.col("size") > 0, F.col("_first")).alias("node")
    )
    classes = classes.join(labels, "node", "left").select(
        "id", F.coalesce("label", "node", "id").alias("class_id")
    )
    classes = durable(classes, "classes")
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    unnamed = texts.where(F.col("id").isNull()).select("id", F.col("id").alias("class_id"), F.lit(None).cast("long"))
    return classes.join(sizes, "class_id").select("id", "class_id", "class_size").union(unnamed).withColumnRenamed("id", key)


def _close_sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - ROUNDING


def _pivots(buckets: DataFrame, attempts: tuple[int, ...], similarity: float, drawn_by: Column) -> DataFrame:
    """Pairs (a, b) of each text in a bucket with the bucket's pivots, where their classes differ."""
    pivots = []
    for attempt in attempts:
        priority = F.xxhash64(F.lit(attempt), drawn_by, "id").alias("p")
        row = F.struct(priority, F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("class").alias("class2"))
        pivots.append(F.min(row))
    drawn = buckets.groupBy("band").agg(F.array_distinct(F.array(*pivots)).alias("pivots"))
    drawn = drawn.select("band", F.inline("pivots"))
    met = buckets.join(drawn.hint("merge"), "band").where(F.col("class") != F.col("class2"))
    return _pairs(met.where(_close_sizes("size", "size2", similarity)), "id", "id2")


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _split_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets whose texts are in more than one class, with the classes."""
    marked = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "class", F.coalesce("label", "id")
    ).drop("label")
    mixed_up = (
        marked.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("band")
    )
    return durable(marked.join(mixed_up.hint("merge"), "band"), "split-buckets")


def _across(split: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a bucket that are in different classes and close enough in size."""
    other = split.select("band", F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("class").alias("class2"))
    met = split.join(other, "band").where(F.col("class") < F.col("class2"))
    return _pairs(met.where(_close_sizes("size", "size2", similarity)), "id", "id2")


def _cell_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur; at most one number per cell reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            keys = batch.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((keys % np.uint64(COUNT_CELLS)).astype(np.int64), minlength=COUNT_CELLS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["cell", "n"])

    found = sets.select("set").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_CELLS, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return counts


def _prefixes(sets: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """(token, id, class, size, rest, short): the rarest shingles of each set, and how many it has from there on.

    The first shingle two similar sets have in common, in the order by rarity, is
    among these in both: what follows it must hold all they have in common. In the
    smaller set it is even among the ``short`` ones, since both together have more.
    """
    held = sets.sparkSession.sparkContext.broadcast(counts)
    kind = sets.schema["id"].dataType.simpleString()
    both = 2 * similarity / (1 + similarity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                lists = batch.column(2)
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                keys = lists.flatten().to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                often = held.value[(keys.view(np.uint64) % np.uint64(COUNT_CELLS)).astype(np.int64)]
                order = np.lexsort((keys, often, owner))
                place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # ``owner`` is in order already, so a place belongs to the same text before and after.
                first = np.flatnonzero(place <= (1 - similarity) * sizes[owner] + ROUNDING)
                of, size = pa.array(owner[first]), sizes[owner[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[order[first]]), batch.column(0).take(of), batch.column(1).take(of),
                        pa.array(size), pa.array(size - place[first]), pa.array(place[first] <= (1 - both) * size + ROUNDING),
                    ],
                    ["token", "id", "class", "size", "rest", "short"],
                )

    schema = f"token long, id {kind}, class {kind}, size long, rest long, short boolean"
    return sets.select("id", "class", "set").mapInArrow(cut, schema)


def _size_class(size: Column, similarity: float) -> Column:
    return F.floor(F.log(size) / F.lit(np.log(1 / max(min(similarity, 0.99), 0.01)))).cast("int")


def _meetings(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows of two sets of different classes that may be similar, where a shingle of theirs meets.

    The larger set asks with all its rare shingles, the smaller one is found by its
    ``short`` ones; both are in classes of like sizes. Per shingle, the texts of its
    largest class are not compared with each other, so one class of any size gives a
    linear number.
    """
    per_class = rows.groupBy("token", "class").agg(F.count(F.lit(1)).alias("n"))
    tokens = per_class.groupBy("token").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("most")
    )
    tokens = tokens.where("classes > 1").select(
        "token",
        F.col("most.class").alias("most"),
        F.ceil((F.col("n") - F.col("most.n")) / SALT_ROWS).cast("int").alias("salts"),
    )
    met = durable(rows.join(tokens.hint("merge"), "token"), "shared-shingles")
    least = F.greatest(F.col("size") * F.lit(similarity) - ROUNDING, F.lit(1.0))
    sizes = F.sequence(_size_class(least, similarity), _size_class(F.col("size"), similarity))
    asks = met.select("*", F.explode(sizes).alias("sizes"))
    found = met.where("short").select("*", _size_class(F.col("size"), similarity).alias("sizes"))
    # The side that is not in the largest class is spread; a pair has one such side at least.
    other = F.col("class") != F.col("most")
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")
    copies = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    held = ["token", "sizes", "id", "class", "size", "rest"]
    left = asks.where(other).select(*held, salt, F.lit(True).alias("asks")).unionByName(
        found.where(other).select(*held, salt, F.lit(False).alias("asks"))
    )
    right = found.select(*held, copies, F.lit(True).alias("asks")).unionByName(
        asks.where(~other).select(*held, copies, F.lit(False).alias("asks"))
    )
    right = right.withColumnsRenamed({c: f"{c}2" for c in ("id", "class", "size", "rest")})
    # Both sides grow with the reports.
    return left.join(right.hint("merge"), ["token", "sizes", "salt", "asks"])


def _by_rare_shingles(sets: DataFrame, counted: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes, among them all similar ones of these sets (id, class, set).

    ``counted`` are the sets by which shingles are held rare; any others only
    make the join slower.
    """
    rows = durable(_prefixes(sets, _cell_counts(counted), similarity), "prefixes")
    both = _meetings(rows, similarity)
    least = similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - ROUNDING
    both = both.where((F.col("class") != F.col("class2")) & (F.least("rest", "rest2") >= least))
    return _pairs(both.where(_close_sizes("size", "size2", similarity)), "id", "id2")


class _Near:
    """Exact similarity of candidate pairs; a pair is looked at once, a text is cut into shingles once."""

    def __init__(self, named: DataFrame, similarity: float, counted: bool):
        self._named, self._similarity, self._counted = named, similarity, counted
        self._seen: DataFrame | None = None
        self._sets: DataFrame | None = None

    def _sets_of(self, ids: DataFrame) -> DataFrame:
        """Shingle sets of these texts; only those that no earlier round has asked for are read."""
        if self._sets is None:
            # The first round asks for a share of all texts.
            new = self._named.join(ids.hint("merge"), "id", "left_semi")
            self._sets = durable(_shingle_sets(new, self._counted), "shingle-sets")
            return self._sets
        missing = durable(ids.join(self._sets.select("id"), "id", "left_anti"), "new-ids")
        new = self._named.join(missing, "id", "left_semi")
        self._sets = self._sets.unionByName(durable(_shingle_sets(new, self._counted), "shingle-sets"))
        return self._sets.join(ids, "id", "left_semi")

    def sets_of(self, texts: DataFrame | None) -> DataFrame:
        """``texts`` (id and other columns) with their sets; None for all sets that were cut so far."""
        if texts is None:
            return self._sets
        return texts.join(self._sets_of(texts.select("id")).hint("merge"), "id")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (u, v) among the pairs (a, b)."""
        if self._seen is not None:
            pairs = pairs.join(self._seen, ["a", "b"], "left_anti")
        pairs = durable(pairs, "pairs")
        self._seen = pairs if self._seen is None else durable(self._seen.unionByName(pairs), "seen-pairs")
        needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
        sets = self._sets_of(needed)
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"
        )
        common = F.size(F.array_intersect("sa", "sb"))
        alike = common >= self._similarity * (F.size("sa") + F.size("sb") - common) - ROUNDING
        return durable(both.where(alike).select(F.col("a").alias("u"), F.col("b").alias("v")), "verified")
