"""Random samples of large tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.kinds import orderable
from siftwell.functions.names import column

PARTS = 1_000_000
ROWS_PER_PARTITION = 1_000


def sample_threshold(row_count: int, sample_size: int) -> int:
    """Rows to keep per million for an expected sample of ``sample_size``."""
    return min(PARTS, math.ceil(sample_size / row_count * PARTS)) if row_count else PARTS


def random_sample(df: DataFrame, row_count: int, sample_size: int, seed: int = 7) -> DataFrame:
    """Each row with the same probability; one narrow pass, no shuffle.

    The same seed gives the same rows for the same input splits, so a lost partition is
    recomputed to the same rows.
    """
    return df.sample(fraction=sample_threshold(row_count, sample_size) / PARTS, seed=seed)


def gathered(sample: DataFrame, sample_size: int) -> DataFrame:
    """A sample in as many partitions as its size and the cluster ask for.

    Sampling leaves the splits of the scan, nearly all of them empty; every later pass
    would start a task for each. Only the sampled rows are shuffled.
    """
    cores = sample.sparkSession.sparkContext.defaultParallelism
    return sample.repartition(max(1, min(cores, math.ceil(sample_size / ROWS_PER_PARTITION))))


def hash_part(key_columns: Sequence[str]) -> Column:
    """A number in [0, 1000000) that depends only on the values of the key columns."""
    key = F.concat_ws("-", *[column(c).cast("string") for c in key_columns])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % PARTS


def hash_sample(df: DataFrame, key_columns: Sequence[str], row_count: int, sample_size: int) -> DataFrame:
    """The rows whose key hashes below the threshold.

    Independent of file layout and of the engine. The key should tell rows apart: rows
    with equal keys are kept or dropped together.
    """
    return df.where(hash_part(key_columns) < sample_threshold(row_count, sample_size))


def exact_sample(df: DataFrame, key_columns: Sequence[str], sample_size: int) -> DataFrame:
    """The ``sample_size`` rows with the smallest hashes of their key: exact in size, and the same rows however the data are split.

    One scan counts the rows of 65,536 slices of the hash; slices below the one where the sample ends are taken
    whole, and only that one is ordered (by hash, key and the other columns). Null keys hash like empty ones.
    """
    digest = F.md5(F.concat_ws("-", *[column(c).cast("string") for c in key_columns]))
    slice_of = F.substring(digest, 1, 4)
    counts = df.groupBy(slice_of.alias("slice")).count().collect()
    left = sample_size
    for row in sorted(counts):
        if row["count"] > left:
            break
        left -= row["count"]
    else:
        return df
    rest = [column(f.name) for f in df.schema.fields if f.name not in key_columns and orderable(f.dataType)]
    edge = df.where(slice_of == row["slice"]).orderBy(digest, *[column(c) for c in key_columns], *rest).limit(left)
    return df.where(slice_of < row["slice"]).unionAll(edge)
