"""Scans, shuffles and exactness of quantiles, distinct counts, samples and text filters."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from siftwell import Constraints, Dataset, ForeignKey
from siftwell.operators import quantiles as quantiles_module
from siftwell.operators import rows
from siftwell.operators.frequency import distinct_counts
from siftwell.operators.quantiles import quantiles, rank_of
from siftwell.plans.graph import KeyGraph
from siftwell.sources.sampling import exact_sample


def test_quantiles_take_three_scans(spark):
    """However many columns and ranks are asked for: a sample, a count, a ranking (and the number of rows)."""
    draw = random.Random(4)
    data = [(draw.randrange(10**6), 2**60 + i * 3, draw.gauss(0, 1), datetime.date(2000, 1, 1) + datetime.timedelta(days=draw.randrange(5000))) for i in range(8000)]
    plain = spark.createDataFrame(data, "a int, b bigint, c double, d date").repartition(3).cache()
    scans = spark.sparkContext.accumulator(0)

    def read(batches):
        scans.add(1)
        yield from batches

    df = plain.mapInArrow(read, plain.schema)
    ps = [i / 50 for i in range(51)]
    found = quantiles(df, {n: ps for n in "abcd"}, rank_limit=1000)
    before = scans.value
    assert before <= 3 * 3  # three partitions each
    got = {(r["column"], r["p"]): r["value"] for r in found.collect()}
    # each column's ranking is a part of one query
    assert scans.value - before <= 4 * 3
    for i, n in enumerate("ab"):
        values = sorted(r[i] for r in data)
        assert all(got[n, p] == str(values[rank_of(p, len(values))]) for p in ps)



def test_distinct_counts_of_long_texts(spark):
    draw = random.Random(6)
    texts = [None, "", "x" * 64, "x" * 65, "é" * 40] + ["".join(draw.choice("ab") for _ in range(200)) for _ in range(50)]
    data = [(draw.choice(texts), draw.choice(texts), bytearray(draw.choice(texts[1:]).encode())) for _ in range(900)]
    df = spark.createDataFrame(data, "a string, b string, c binary")
    want = {"a": len({r[0] for r in data} - {None}), "b": len({r[1] for r in data} - {None}), "c": len({bytes(r[2]) for r in data})}
    assert {r["column"]: r["distinct_count"] for r in distinct_counts(df).collect()} == want
    # values themselves are compared where digests repeat, be the digest as poor as it may
    poor = distinct_counts(df, digest=lambda v: F.substring(F.md5(v), 1, 1))
    assert {r["column"]: r["distinct_count"] for r in poor.collect()} == want
    plan = distinct_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan.lower() and "md5" in plan


@pytest.mark.parametrize("size", [0, 1, 500, 4999, 5000, 9000])
def test_exact_sample(spark, size):
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    first, second = (exact_sample(df.repartition(n), ["id"], size) for n in (1, 9))
    a, b = (sorted(r.id for r in f.collect()) for f in (first, second))
    assert a == b and len(a) == min(size, 5000)


def test_repeated_keys_are_sampled_to_the_row(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(None, 7)] * 50, "k int, v int")
    assert [exact_sample(df, ["k"], n).count() for n in (10, 90, 140)] == [10, 90, 140]


def test_small_doubles_are_found_by_their_digits(spark):
    df = spark.createDataFrame([(1, 1.5e-12), (2, 0.00015), (3, 1.5e20), (4, 2.5e-7), (5, 0.0)], "id int, v double")
    ids = lambda needle: sorted(r.id for r in rows.filtered(df.select("id", "v"), needle).collect())
    assert ids("1.5e-12") == [1] and 1 in ids("1.5") and ids("2.5E-7") == [4]
    assert ids("0.00015") == [2] and ids("150000000000000000000") == [3]


def test_rows_by_a_column_are_all_of_them(spark):
    assert rows.ordered_rows(spark.range(500), "id").count() == 500


def test_a_graph_of_keys_reads_no_profile(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, up int"), spark.createDataFrame([(1,), (5,)], "a_id int")
    keys = Constraints({"a": ("id",)}, (ForeignKey("a", ("up",), "a"), ForeignKey("b", ("a_id",), "a")))
    graph = KeyGraph(Dataset.from_frames(spark, {"a": a, "b": b, "unrelated": spark.range(3)}, constraints=keys))
    assert [r.table for r in graph.self_references().collect()] == ["a"]
    assert [(r.from_table, r.to_table) for r in graph.edges().collect()] == [("b", "a")]
    assert {(r.table, r.orphans) for r in graph.orphans.collect()} == {("a", 1), ("b", 1)}
    assert {(r.table, r.row_count) for r in graph.tables.collect()} == {("a", 3), ("b", 2)}


def test_quantiles_number_ranges_by_column(spark, monkeypatch):
    """A row is looked up once for each column, however many ranges of it are open."""
    looked = []
    place = quantiles_module._place
    monkeypatch.setattr(quantiles_module, "_place", lambda *a: looked.append(a) or place(*a))
    df = spark.range(4000).selectExpr("(id * 7919) % 4001 AS a", "id % 9 AS b")
    ps = [i / 20 for i in range(21)]
    found = {(r["column"], r["p"]): r["value"] for r in quantiles(df, {"a": ps, "b": ps}, rank_limit=5).collect()}
    values = [sorted((i * 7919) % 4001 for i in range(4000)), sorted(i % 9 for i in range(4000))]
    assert all(found[n, p] == str(v[rank_of(p, 4000)]) for n, v in zip("ab", values) for p in ps)
    assert len(looked) <= 2 * 2 * 3 + 2  # for two columns: a range and a place of each cut, and a range to rank
