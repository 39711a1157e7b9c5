"""URL filter rules by a sort-merge range join.

A rule (host, path) covers its host and every subdomain, below a path prefix. With host labels reversed, the
urls a rule covers on one host suffix form an interval of (reversed host, path) pairs, and intervals of
different rules are nested or disjoint. Every url is looked up once per suffix of its host. Rules and lookups
are range-partitioned and sorted together; one sweep per partition keeps the stack of rules that are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain.session import cut_lineage

DEFAULT_VERDICT = "allow"
_SWEEP = "host string, path string, rule_host string, rule_path string"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url column; null or without ``://`` gives two empty strings."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _key(host: Column) -> Column:
    """Labels in reverse order, the canonical form in which subdomains follow their domain."""
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _sweeper(carried: dict[int, list[tuple[str, str, str]]]):
    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rules and lookups in, the longest open rule of each lookup out."""
        open_rules: list[tuple[str, str, str]] | None = None
        for part in parts:
            found = []
            names = ("slot", "key", "path", "is_lookup", "host", "url_path", "rule_host")
            for slot, key, path, is_lookup, host, url_path, rule_host in zip(*(part[n] for n in names), strict=True):
                if open_rules is None:
                    open_rules = list(carried.get(slot, ()))
                while open_rules and not (open_rules[-1][0] == key and path.startswith(open_rules[-1][1])):
                    open_rules.pop()
                if not is_lookup:
                    open_rules.append((key, path, rule_host))
                elif open_rules:
                    found.append((host, url_path, open_rules[-1][2], open_rules[-1][1]))
            yield pd.DataFrame(found, columns=["host", "path", "rule_host", "rule_path"])

    return sweep


def _first_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        if len(part):
            yield part[["slot", "key", "path"]].head(1)
            break
    for _ in parts:
        pass


def match_rules(hosts_paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule of each distinct (host, path): rule_host, rule_path; pairs without a rule are absent.

    The rule of the longest host wins, then that of the longest path. Nothing is broadcast but what Spark
    itself finds small, and a host with any number of urls is split along its paths.
    """
    pairs = hosts_paths.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = pairs.select("host", "path", labels.alias("labels")).select(
        "host",
        "path",
        F.explode(F.expr("transform(sequence(1, size(labels)), i -> slice(labels, i, size(labels)))")).alias("suffix"),
    )
    lookups = suffixes.select(
        F.array_join(F.reverse("suffix"), ".").alias("key"),
        "path",
        F.lit(1).alias("is_lookup"),
        "host",
        F.col("path").alias("url_path"),
        F.lit(None).cast("string").alias("rule_host"),
    )
    clean = rules.select("host", "path").filter("host IS NOT NULL AND path IS NOT NULL").distinct()
    starts = clean.select(
        _key(F.col("host")).alias("key"),
        "path",
        F.lit(0).alias("is_lookup"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("url_path"),
        F.col("host").alias("rule_host"),
    )
    order = ["key", "path", "is_lookup", "host"]
    placed = lookups.unionByName(starts).repartitionByRange(*order).sortWithinPartitions(*order)
    # Range bounds are sampled: the partitions are stored, so that the passes below see the same cut.
    stored = cut_lineage(placed.withColumn("slot", F.spark_partition_id()))
    first = stored.mapInPandas(_first_rows, "slot int, key string, path string")
    # A rule that began in an earlier partition and is still open has the first row's key and a prefix of its path.
    stems = first.select(
        "slot", "key", F.explode(F.expr("transform(sequence(0, length(path)), n -> left(path, n))")).alias("path")
    )
    carried: dict[int, list[tuple[str, str, str]]] = {}
    # At most the rules nested along one path for each partition of the sort.
    for row in stems.join(starts, ["key", "path"]).select("slot", "key", "path", "rule_host").orderBy("path").collect():
        carried.setdefault(row["slot"], []).append((row["key"], row["path"], row["rule_host"]))
    found = stored.mapInPandas(_sweeper(carried), _SWEEP)
    longest = F.max(F.struct(F.length("rule_host"), F.length("rule_path"), "rule_host", "rule_path")).alias("best")
    return found.groupBy("host", "path").agg(longest).select("host", "path", "best.rule_host", "best.rule_path")


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule (host and path joined, else null) and verdict.

    ``rules`` has host (lower case), path and verdict; of equal rules the alphabetically last verdict counts, so
    block wins over allow, and rules with a null part are void. Urls no rule fits get ``default``. A null url
    or one without ``://`` has an empty host and path, and only a rule for the empty host could fit it.
    Repeated rows each keep their row; other columns of ``pages`` are not carried.
    """
    urls = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_u"))
    host, path = split_url(F.col("_u"))
    urls = urls.select(id_col, host.alias("host"), path.alias("path"))
    verdicts = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    verdicts = verdicts.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    best = match_rules(urls, rules).join(verdicts, ["rule_host", "rule_path"])
    return urls.join(best, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
