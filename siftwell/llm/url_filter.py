"""Allow and block rules for URLs by a sort-merge join of prefixes.

A host is written label by label from the top ("org.example.blog"), a slash (no host holds one) and the path follow, and a rule
becomes a prefix of such keys: an interval of the sorted keys. A rule fits its host and all
subdomains, so a page has one key for each of its host's ancestors that has no more labels than any rule's; of
its path as many characters as the longest rule has, so keys of very long urls stay short. A rule's path may be empty. Keys and rules are dealt to
ranges by sampled splitters, sorted, and swept once; the sweep keeps a stack of the rules whose
interval is open, which are nested by nature. A rule goes to every range that its interval
meets. Page rows carry a hash to the splitters, so a key that many pages share is split.

Null urls and urls without "://" have an empty host and path and fit no rule; neither does an
empty host. Repeated rows are judged each. Rows with a null id are judged too. Rules that are given twice count once; of
rules with the same host and path that disagree, block wins. Without rules every page gets
the default verdict. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, partitions

Rule = tuple[str, str, str]  # verdict, host, path
SAMPLE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first "://" and the next "/", "?" or "#", A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands between the host and the next "?" or "#"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ancestors(host: Column, path: Column, labels: int, letters: int) -> Column:
    """The key of each ancestor of a host, itself included, of at most so many labels; of the path at most so many letters."""
    own = F.slice(F.reverse(F.split(host, r"\.")), 1, max(labels, 1))
    keys = F.transform(F.sequence(F.lit(1), F.size(own)), lambda n: F.concat(F.array_join(F.slice(own, 1, n), "."), F.lit("/"), F.substring(path, 1, letters)))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range by key, rules first: the longest path among the open rules for each page key."""
    stack: list[tuple[bytes, str, str]] = []
    for batch in batches:
        pages, rules, verdicts = [], [], []
        for key, is_page, page, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("key", "is_page", "page", "rule", "verdict"))):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_page:
                if not stack or stack[-1][0] != key:
                    stack.append((key, rule, verdict))
            elif stack:
                pages.append(page)
                rules.append(stack[-1][1])
                verdicts.append(stack[-1][2])
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page", "rule", "verdict"])


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", id: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the longest rule that fits (host + path) or null, verdict.

    rules: (verdict, host, path) each, a path beginning with "/" or empty; a list, or a DataFrame with
    these columns for long lists. A rule fits if the page's path begins with the rule's; by
    length of host and path the longest wins, then the longer host, then block.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    labels = F.reverse(F.split("host", r"\."))
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.min(F.struct((F.col("verdict") != "block").alias("o"), "verdict")).alias("v"))
    rules = rules.select(F.concat(F.array_join(labels, "."), F.lit("/"), "path").cast("binary").alias("key"), F.concat("host", "path").alias("rule"), F.col("v.verdict").alias("verdict"))

    widest = rules.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("labels"), F.max(F.length("rule")).alias("letters")).first()

    # one narrow table of the pages; what is joined again below must be the same rows
    rows = materialize(pages.select(F.monotonically_increasing_id().alias("page"), F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")), "pages")
    keys = rows.select("page", F.explode(_ancestors(F.col("host"), F.col("path"), widest.labels or 0, widest.letters or 0)).alias("key")).select("page", F.col("key").cast("binary").alias("key"))
    n = partitions(spark)
    # at most SAMPLE keys, chosen by hash among all rows, place the splitters
    total = rows.count()
    share = min(1.0, SAMPLE / 8 / max(total, 1))
    sample = keys.where(F.pmod(F.xxhash64("page", "key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("key").limit(SAMPLE).collect()
    points = sorted(bytes(r.key) for r in sample)
    splitters = [points[len(points) * i // n] for i in range(1, n)] if points else []

    def ranges(batches):
        """The ranges that an interval of keys beginning with ``key`` meets: first and last."""
        for batch in batches:
            lows, highs = [], []
            for key, is_page, salt in zip(*(batch.column(c).to_pylist() for c in ("key", "is_page", "salt"))):
                low = bisect_left(splitters, key)
                high = bisect_right(splitters, key if is_page else key + b"\xff")
                if is_page:  # any range that the key's own splitters enclose will do
                    low = high = low + salt % (high - low + 1)
                lows.append(low)
                highs.append(high)
            yield batch.drop_columns(["salt"]).append_column("low", pa.array(lows, pa.int32())).append_column("high", pa.array(highs, pa.int32()))

    none = F.lit(None).cast("string")
    both = keys.select("key", F.lit(True).alias("is_page"), "page", none.alias("rule"), none.alias("verdict"), F.pmod(F.xxhash64("page"), F.lit(1 << 20)).alias("salt"))
    both = both.unionByName(rules.select("key", F.lit(False).alias("is_page"), F.lit(0).cast("long").alias("page"), "rule", "verdict", F.lit(0).cast("long").alias("salt")))
    dealt = both.mapInArrow(ranges, "key binary, is_page boolean, page long, rule string, verdict string, low int, high int")
    dealt = dealt.withColumn("range", F.explode(F.sequence("low", "high"))).drop("low", "high")
    # a range may be cut further (its rules are few), never mixed with another's order: rows are sorted by range first
    swept = dealt.repartition(n, "range").sortWithinPartitions("range", "key", "is_page").drop("range").mapInArrow(_sweep, "page long, rule string, verdict string")
    return _best(swept, rows, id, default)


def _best(swept: DataFrame, rows: DataFrame, id: str, default: str) -> DataFrame:
    size = F.length("rule")
    best = swept.groupBy("page").agg(F.max(F.struct(size.alias("n"), F.length(F.substring_index("rule", "/", 1)).alias("h"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("r"))
    return rows.join(best, "page", "left").select(
        F.col("id").alias(id), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict")
    )
