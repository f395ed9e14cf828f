"""Exact deduplication by sorting contents.

Texts are dealt to ranges of their normalised bytes, sorted there by Spark's external sort, and
each is compared in full with its neighbour, so equal texts stand next to each other.
Range bounds come from Spark's sample of a short key (leading bytes and a hash of the whole), so
a bound is small however long texts are; the id ends the key, so a group of copies that outgrows
a range is split. A group that goes on in the next range is mended from the two runs
at the ends of every range: a table of a few bytes per range.

Nulls count as empty texts and are copies of each other; a null id comes after all others.
Repeated rows are copies like any others, and of rows with the same text and id one stays. An
empty table gives an empty result. Further columns are not read, unless rows are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import id_or_last, id_or_null, materialize, partitions, text_buffers, whole_text

KEY_BYTES = 24
_RUN = T.StructType(
    [
        T.StructField("at", T.IntegerType()),
        T.StructField("edge", T.BooleanType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("run_first", T.LongType()),
        T.StructField("run_size", T.LongType()),
        T.StructField("leads", T.BooleanType()),
    ]
)


def _runs(batches: Iterator[pa.RecordBatch], carry: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range, with the run of equal texts that each belongs to. The first row
    of a run is the one that stays; only ids of an unfinished run are held."""
    at = TaskContext.get().partitionId()
    names = ["__id", *(["__row", "__null", "__text"] if carry else []), *_RUN.names]
    text, key, digest, first, size = None, None, None, None, 0  # the run that may go on
    held: list[pa.RecordBatch] = []
    first_run = True

    def rows(batch, a, b, lead_at):
        """Columns that are passed on: of leaders alone what is carried."""
        part = batch.slice(a, b - a)
        columns = [part.column("__id")]
        if carry:
            index = np.arange(b - a)
            leading = pa.array(index, mask=~np.isin(index, lead_at))
            columns += [part.column(c).take(leading) for c in ("__row", "__null", "__text")]
        return columns

    def finished(columns, edge, shas, firsts, sizes, leads):
        n = len(columns[0])
        more = [pa.array(np.full(n, at, np.int32)), pa.array(edge), pa.array(shas, pa.string()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(leads)]
        return pa.RecordBatch.from_arrays([*columns, *more], names=names)

    def close(edge):
        for i, columns in enumerate(held):
            n = len(columns[0])
            leads = np.zeros(n, bool)
            leads[0] = i == 0
            yield finished(columns, np.full(n, edge), [digest] * n, np.full(n, first), np.full(n, size), leads)

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        data, offsets = text_buffers(batch.column("__text"))
        whole, hashes, ids = memoryview(data), batch.column("__hash").to_numpy(), batch.column("__id").to_numpy()
        cut = lambda i: whole[offsets[i] : offsets[i + 1]]  # noqa: B023, E731
        new = np.ones(n, bool)
        for i in np.flatnonzero(hashes[1:] == hashes[:-1]).tolist():  # the only ones that can be equal: compared in full
            new[i + 1] = cut(i) != cut(i + 1)
        if text is not None and hashes[0] == key:
            new[0] = cut(0) != text
        starts = np.flatnonzero(new)
        going_on = int(starts[0]) if len(starts) else n
        if going_on:
            held.append(rows(batch, 0, going_on, []))
            size += going_on
        if not len(starts):
            continue
        if held:
            yield from close(first_run)
            first_run = False
        last = int(starts[-1])
        if last > going_on:  # runs that begin and end in this batch
            lengths = np.diff(starts)
            edge = np.zeros(last - going_on, bool)
            edge[: lengths[0]] = first_run
            first_run = False
            shas = np.array([hashlib.sha256(cut(i)).hexdigest() for i in starts[:-1].tolist()], object)
            columns = rows(batch, going_on, last, starts[:-1] - going_on)
            yield finished(columns, edge, np.repeat(shas, lengths), np.repeat(ids[starts[:-1]], lengths), np.repeat(lengths, lengths), new[going_on:last])
        text, key, first, size = bytes(cut(last)), int(hashes[last]), int(ids[last]), n - last
        digest = hashlib.sha256(text).hexdigest()
        held = [rows(batch, last, n, [0])]
    if held:
        yield from close(True)


def groups(
    documents: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, sha256 of the normalised text.

    keep: whether of equal texts the row with the "smallest" or "largest" id stays.
    normalise: what to do with a text column before comparing; nothing if not given.
    carry: adds the document as struct ``row``, of kept documents only; null for the others.
    """
    spark, last = documents.sparkSession, keep == "largest"
    content = normalise(whole_text(text)) if normalise else whole_text(text)
    # a text that is compared as it is need not travel twice
    apart = [c for c in documents.columns if normalise or c != text]
    carried = [F.struct(*(F.col(f"`{c}`") for c in apart), F.lit(0).alias("__end")).alias("__row"), F.col(text).isNull().alias("__null")] if carry else []
    rows = documents.select(id_or_last(id).alias("__id"), *carried, content.cast("binary").alias("__text"), F.xxhash64(content).alias("__hash"))
    lead = F.substring(F.col("__text"), 1, KEY_BYTES)
    order = F.col("__id").desc() if last else F.col("__id").asc()
    ranged = rows.repartitionByRange(partitions(spark), lead.asc(), F.col("__hash").asc(), order)
    # the hash keeps different texts with the same beginning from being compared in full again and again
    ordered = ranged.sortWithinPartitions(lead.asc(), F.col("__hash").asc(), F.col("__text").asc(), order)
    kept = [f for f in rows.schema.fields if f.name != "__hash" and (carry or f.name == "__id")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*kept, *_RUN.fields]])
    runs = materialize(ordered.mapInArrow(lambda batches: _runs(batches, carry), schema), "runs")
    # the same text at the ends of several ranges: two rows at most from each range
    ends = runs.where("edge AND leads").select("at", "sha256", "run_first", "run_size")
    best = F.max if last else F.min
    whole = ends.groupBy("sha256").agg(
        best(F.struct(F.col("run_first").alias("f"), (-F.col("at") if last else F.col("at")).alias("p"))).alias("best"),
        F.sum("run_size").alias("size"),
        F.count("*").alias("runs"),
    )
    whole = whole.where("runs > 1").select("sha256", F.col("best.f").alias("keep"), F.abs("best.p").alias("leader"), "size")
    # two rows at most for each range: as many ranges as there are shuffle partitions
    found = runs.join(F.broadcast(whole), "sha256", "left").withColumn("__keep", F.coalesce("keep", "run_first"))
    result = [
        id_or_null("__id").alias(id),
        id_or_null("__keep").alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        (F.col("leads") & (F.col("leader").isNull() | (F.col("at") == F.col("leader")))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    ]
    if carry:
        unchanged = F.when(~F.col("__null"), F.col("__text").cast("string"))
        fields = [(unchanged if c not in apart else F.col("__row").getField(c)).alias(c) for c in documents.columns]
        result.append(F.when(F.col("leads"), F.struct(*fields)).alias("row"))
    return found.select(*result)


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    return groups(documents, carry=True, **options).where("kept").select("row.*")
