"""Exact duplicates of incident reports by sorting their content."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.records import lower_ascii
from kerbline.operators.skew import hot_counted, salted_join
from kerbline.session import durable

RETURNED = ("keep_id", "group_size", "kept", "text_sha256")
# Normalised bytes that one sorted range should hold.
RANGE_BYTES = 32 << 20
# Sampled rows per splitter, and characters of the text a splitter keeps.
SAMPLES_PER_RANGE = 40
SPLITTER_CHARS = 48
# Ranges of one sort. Splitters of so many ranges are 4096 * (4 * 48 + 8) bytes at most.
MAX_RANGES = 4096


def _range_of(point: Column, splitters: list) -> Column:
    """How many splitters are not above ``point``, by binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    cuts = F.array(*[F.struct(F.lit(p).alias("head"), F.lit(i).cast("long").alias("tie")) for p, i in splitters])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        there = low + width
        return F.when(F.try_element_at(cuts, there) <= point, there).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def exact_duplicates(
    reports: DataFrame,
    key: str = "event_id",
    text: str = "report",
    keep: str = "smallest",
    range_bytes: int = RANGE_BYTES,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Which report stays of each set of equal ones.

    Method: content sort. Reports are equal when their texts are identical after
    lower-casing A-Z. A sample of (first characters, hash of the key) gives
    splitters; every range is sorted on its own by the whole normalised text and
    neighbours are compared in full. A run of equal texts is one group. Ties at a
    splitter fall by the key's hash, so a text that holds a third of all rows is
    cut over many ranges; the runs of texts that begin like a splitter are then
    joined again, one row per run.

    Returns, for every input row: ``key``, ``columns``, keep_id, group_size,
    kept, text_sha256 (of the normalised text). Exactly one row of a group is
    kept, also when several share the identifier that stays.

    Edge cases: a null text equals an empty one. A row with a null key loses
    against any key and is kept only if the whole group has none (keep_id is
    null then). An empty table gives an empty result. Other columns are ignored
    unless named in ``columns``; these may not have a returned name.
    """
    if clash := {key, *RETURNED}.intersection(columns):
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rest = [c for c in columns if c != text]
    rows = reports.select(
        F.col(key).alias("_id"),
        F.struct(*rest).alias("_rest") if rest else F.lit(None).cast("string").alias("_rest"),
        F.col(text).alias("_given"),
        F.struct(
            lower_ascii(F.substring(F.coalesce(F.col(text), F.lit("")), 1, SPLITTER_CHARS)).alias("head"),
            F.xxhash64(key).alias("tie"),
        ).alias("_point"),
    )
    splitters = _splitters(rows, range_bytes)
    heads = sorted({p for p, _ in splitters})
    # Texts are moved once, as they are; they are normalised in the range where they are sorted.
    rows = (
        rows.withColumn("_range", _range_of(F.col("_point"), splitters))
        .withColumn("_cut", F.col("_point.head").isin(heads) if heads else F.lit(False))
        .drop("_point")
        # A range is one task, however many there are.
        .repartitionById(len(splitters) + 1, F.col("_range").cast("int"))
        .withColumn("_norm", lower_ascii(F.coalesce("_given", F.lit(""))))
    )

    # Neighbours in the sorted range, compared in full; a change opens a new run.
    in_range = Window.partitionBy("_range").orderBy("_norm", "_id")
    before = F.lag("_norm").over(in_range)
    runs = (
        rows.withColumn("_opens", F.when(before == F.col("_norm"), 0).otherwise(1))
        .withColumn("_run", F.sum("_opens").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "_id",
            "_rest",
            *(["_given"] if text in columns else []),
            "_range",
            "_run",
            "_cut",
            F.sha2("_norm", 256).alias("text_sha256"),
            # The whole text travels on only with the first row of a run that a splitter may have cut.
            F.when(F.col("_cut") & (F.col("_opens") == 1), F.col("_norm")).alias("_text"),
        )
    )
    stays = F.max if keep == "largest" else F.min
    best = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_last()
    run = Window.partitionBy("_range", "_run")
    runs = runs.select(
        "*",
        stays("_id").over(run).alias("_stays"),
        F.count(F.lit(1)).over(run).alias("_size"),
        F.row_number().over(run.orderBy(best)).alias("_nth"),
    )
    names = [F.col("_id").alias(key), *[F.col("_given" if c == text else f"_rest.{c}").alias(c) for c in columns]]
    if not splitters:
        return runs.select(
            *names,
            F.col("_stays").alias("keep_id"),
            F.col("_size").alias("group_size"),
            (F.col("_nth") == 1).alias("kept"),
            "text_sha256",
        )

    runs = durable(runs, "content-runs")
    # Runs a splitter may have cut: one row for each, compared by whole text.
    if keep == "largest":
        home = F.max_by("_range", F.struct("_stays", "_range"))
    else:
        home = F.min_by("_range", F.struct(F.col("_stays").isNull(), F.col("_stays"), F.col("_range")))
    joined = (
        runs.where(F.col("_text").isNotNull())
        .groupBy("_text")
        .agg(
            stays("_stays").alias("_all_stays"),
            F.sum("_size").alias("_all_size"),
            home.alias("_home"),
            F.first("text_sha256").alias("text_sha256"),
        )
        .drop("_text")
    )
    whole = runs.where(~F.col("_cut")).select(
        *names,
        F.col("_stays").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_nth") == 1).alias("kept"),
        "text_sha256",
    )
    joined = durable(joined, "cut-runs")
    # A text that holds a share of all rows is one key here.
    hot = hot_counted(joined, ["text_sha256"], "_all_size")
    cut = (
        salted_join(runs.where("_cut"), joined, ["text_sha256"], hot=hot, salt_by=["_id", "_range", "_nth"])
        .select(
            *names,
            F.col("_all_stays").alias("keep_id"),
            F.col("_all_size").alias("group_size"),
            ((F.col("_nth") == 1) & (F.col("_range") == F.col("_home"))).alias("kept"),
            "text_sha256",
        )
    )
    return whole.unionByName(cut)


def _splitters(rows: DataFrame, range_bytes: int) -> list[tuple[str, int]]:
    """Cuts between ranges, from an even sample of (head, tie); MAX_RANGES - 1 at most."""
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_given")).alias("b")
    ).first()
    ranges = min(MAX_RANGES, ceil((size["b"] or 0) / range_bytes))
    if ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLES_PER_RANGE / size["n"])
    # A row's own hash decides, so a repeated run takes the same sample.
    drawn = rows.where(
        F.pmod(F.xxhash64(F.lit(11), "_id", "_point"), F.lit(1 << 20)) < max(1, ceil(share * (1 << 20)))
    )
    sample = drawn.select("_point.head", "_point.tie").orderBy("head", "tie").collect()
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges) if sample]
    return sorted({(r["head"], r["tie"]) for r in cuts}, key=lambda c: (c[0].encode(), c[1]))
