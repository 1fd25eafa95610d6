"""Judging the addresses of data services by rules and by boosted trees on their spelling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.records import lower_ascii
from kerbline.operators.skew import hot_keys, salted_join
from kerbline.session import durable

# Distinct labelled addresses that the trees are fitted on, about; suffixes are counted over all.
FIT_ROWS = 20_000
TREES = 12
DEPTH = 4
# Rows of prior belief in a suffix statistic.
PRIOR_ROWS = 3.0

FEATURES = (
    "length",
    "host_length",
    "depth",
    "digit_ratio",
    "entropy",
    "parameters",
    "host_labels",
    "host_marks",
    "short_rate",
    "short_rows",
    "long_rate",
    "long_rows",
)


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    there = F.instr(url, "://") > 0
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.char_length(rest) + 4)
    host = lower_ascii(F.regexp_extract(after, "^([^/?#]*)", 1))
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as (name, verdict); of equally long ones the first. Null if none fits."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(
            found
        )
    return found


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical_features(addresses: DataFrame) -> DataFrame:
    """Adds the features of an address that its spelling alone gives; needs url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    share = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda total, c: F.when(c == "", total).otherwise(total - share(c) * F.log2(share(c))),
    )
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    return addresses.select(
        "*",
        F.char_length(url).cast("double").alias("length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.regexp_count("path", F.lit("[^/]+")).cast("double").alias("depth"),
        (F.regexp_count(url, F.lit("[0-9]")) / n).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("parameters"),
        F.regexp_count("host", F.lit("[^.]+")).cast("double").alias("host_labels"),
        F.regexp_count("host", F.lit("[^a-z.]")).cast("double").alias("host_marks"),
        _suffix(F.col("host"), 2).alias("short"),
        _suffix(F.col("host"), 3).alias("long"),
    )


class UrlModel:
    """Boosted trees on spelling and on how labelled addresses of the same host suffix were judged."""

    def __init__(self, fitted, suffixes: dict[str, DataFrame], rate: float):
        self._fitted, self._suffixes, self._rate = fitted, suffixes, rate

    @staticmethod
    def fit(labelled: DataFrame, url: str = "service_url", label: str = "blocked", rows: int = FIT_ROWS) -> UrlModel:
        """From labelled addresses (``label`` 1: block, 0: allow); without both labels the model allows all or none."""
        host, path = url_parts(F.col("url"))
        known = (
            labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
            .where("url IS NOT NULL AND label IN (0, 1)")
            .groupBy("url")
            .agg(F.max("label").alias("label"))
        )
        known = durable(known.withColumn("host", host).withColumn("path", path), "known-urls")
        all_known = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
        rate = (all_known["bad"] or 0.0) / all_known["n"] if all_known["n"] else 0.0
        suffixes = {}
        for which, labels in (("short", 2), ("long", 3)):
            by_suffix = known.groupBy(_suffix(F.col("host"), labels).alias(which))
            suffixes[which] = durable(
                by_suffix.agg(F.count(F.lit(1)).alias("_rows"), F.sum("label").alias("_bad")), "suffixes"
            )
        share = rows / max(rows, all_known["n"])
        drawn = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30)))
        drawn = durable(lexical_features(drawn), "labelled-urls")
        whole = drawn.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
        n, bad = whole["n"], whole["bad"] or 0.0
        model = UrlModel(None, suffixes, rate)
        if 0 < bad < n:
            ready = model._with_suffixes(drawn, own=True).select("label", *FEATURES)
            vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, minInstancesPerNode=2)
            model._fitted = trees.fit(durable(vectors.transform(ready).select("label", "features"), "url-features"))
        return model

    def _with_suffixes(self, addresses: DataFrame, own: bool = False) -> DataFrame:
        """Adds the suffix statistics; an address that is being fitted on does not count for itself."""
        out = addresses
        for which, stats in self._suffixes.items():
            rows, bad = F.coalesce("_rows", F.lit(0)), F.coalesce("_bad", F.lit(0.0))
            if own:
                rows, bad = rows - 1, bad - F.col("label")
            # The statistics grow with the labelled addresses; what is fitted on is few.
            hot = {} if own else hot_keys(addresses, [which])
            out = (
                salted_join(out, stats, [which], "left", hot, salt_by=["url"])
                .withColumn(f"{which}_rate", (bad + PRIOR_ROWS * self._rate) / (rows + PRIOR_ROWS))
                .withColumn(f"{which}_rows", F.log1p(rows.cast("double")))
                .drop("_rows", "_bad")
            )
        return out

    def judge(self, addresses: DataFrame) -> DataFrame:
        """Adds block_score (0 to 1); needs url, host and path."""
        if self._fitted is None:
            return addresses.withColumn("block_score", F.lit(self._rate))
        ready = self._with_suffixes(lexical_features(addresses))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        judged = self._fitted.transform(vectors.transform(ready))
        return judged.select(*addresses.columns, vector_to_array("probability")[1].alias("block_score"))


def judge_services(
    services: DataFrame,
    labelled: DataFrame,
    rules: Sequence[UrlRule],
    key: str = "layer_id",
    url: str = "service_url",
    label: str = "blocked",
    rows: int = FIT_ROWS,
) -> DataFrame:
    """Allows or blocks the address of every data service.

    A rule decides where one fits (the longest); elsewhere gradient-boosted trees
    decide, fitted on about ``rows`` of the ``labelled`` addresses (``url`` and
    ``label``, 1: block), drawn by a hash. Features: lengths, depth, digit ratio,
    character entropy, number of parameters, labels and marks of the host, and
    for the last two and three labels of the host the number of labelled addresses
    (all of them, each distinct address once) and their share of blocked ones.
    ``rules`` is a list of policy, not a table:
    it becomes one expression.

    Returns per input row: ``key``, host, path, rule (like ``net/``; else null),
    block_score (null where a rule decides), verdict (allow or block).

    Edge cases: a null address, or one without ``://``, has an empty host and
    path and is left to the trees as an empty or bare text. With labels of one
    kind only, all others get that verdict; without labels they are allowed.
    Repeated rows and keys are kept. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows_in = services.select(F.col(key).alias("_key"), F.col(url).alias("url"))
    parted = rows_in.withColumn("host", host).withColumn("path", path)
    parted = parted.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = UrlModel.fit(labelled, url, label, rows).judge(parted)
    return judged.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.when(F.col("_rule").isNull(), F.col("block_score")).alias("block_score"),
        F.coalesce(
            F.col("_rule.verdict"), F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
        ).alias("verdict"),
    )
