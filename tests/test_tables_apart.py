"""Tables of a dataset advance alone; types of untyped columns come from the first pass."""

import threading

import pytest
from siftwell import Dataset, ProfileOptions, profile_dataset
from siftwell.plans import profile as plans
from siftwell.sources import dataset as sources


def test_a_slow_table_does_not_hold_up_the_others(spark, monkeypatch):
    """The table that waits can only go on once the other one has gone through all passes."""
    done = threading.Event()
    real = plans._Run._aggregate, plans._Run._fill_bins

    def aggregate(self, result):
        if result.name == "slow":
            assert done.wait(60)
        real[0](self, result)

    def fill(self, result):
        real[1](self, result)
        if result.name == "fast":
            done.set()

    monkeypatch.setattr(plans._Run, "_aggregate", aggregate)
    monkeypatch.setattr(plans._Run, "_fill_bins", fill)
    data = Dataset.from_frames(spark, {"slow": spark.range(50), "fast": spark.range(40)})
    found = profile_dataset(data, ProfileOptions(parallel_tables=2))
    assert {r["table"]: r["row_count"] for r in found.tables.collect()} == {"slow": 50, "fast": 40}
    assert found.histogram.where("table = 'slow'").count() > 0 and found.failed_steps() == {}


def test_the_failed_pass_is_named(spark):
    broken = spark.range(5).selectExpr("id", "raise_error('out of order') AS x")
    data = Dataset.from_frames(spark, {"a": broken, "b": spark.range(3)}, views={"v": "SELECT * FROM nowhere"})
    found = profile_dataset(data)
    assert found.failed_steps() == {"a": "aggregates", "v": "open"}
    assert found.tables.where("error IS NULL").count() == 1


def test_an_interrupted_run_cancels_its_jobs(spark, monkeypatch):
    cancelled = []
    monkeypatch.setattr(plans._Run, "_advance", lambda self, result: (_ for _ in ()).throw(KeyboardInterrupt()))
    monkeypatch.setattr(type(spark.sparkContext), "cancelJobsWithTag", lambda self, tag: cancelled.append(tag))
    run = plans._Run(Dataset.from_frames(spark, {"a": spark.range(3)}), ProfileOptions())
    with pytest.raises(KeyboardInterrupt):
        run.run()
    assert cancelled == [run.tag]


def test_jobs_of_a_run_carry_its_tag(spark):
    seen = []

    def rows():
        seen.extend(spark.sparkContext.getJobTags())
        return spark.range(3)

    profile_dataset(Dataset(spark, {"a": rows}))
    assert len(seen) == 1 and not spark.sparkContext.getJobTags()


def test_types_without_a_job_of_their_own(spark, monkeypatch):
    """Opening reads nothing; the profile binds types from its own pass, and the dataset keeps them."""
    monkeypatch.setattr(sources, "cast_untyped", lambda df: pytest.fail("a scan for types alone"))
    text = spark.createDataFrame([("1", "1.5", "a", "12345678901234567890", "x"), ("-2", "7", "b", "1", None), (None, "1e3", None, None, "2024-01-01")], "i string, r string, t string, w string, `odd ``n` string")
    text = text.unionAll(spark.createDataFrame([("007", None, "c", "9" * 20, None)], text.schema))
    context = spark.sparkContext
    context.setJobGroup("opening", "opening")
    data = Dataset.from_frames(spark, {"t": text}, untyped=["t"])
    data.stored("t")
    assert not context.statusTracker().getJobIdsForGroup("opening") and data.is_untyped("t")
    found = {r["column"]: r for r in profile_dataset(data).columns.collect()}
    assert [found[n]["kind"] for n in "irtw"] == ["integer", "real", "text", "integer"] and found["odd `n"]["kind"] == "text"
    assert (found["i"]["min_num"], found["i"]["max_num"], found["r"]["max_num"]) == (-2, 7, 1000)
    assert found["w"]["max"] == "9" * 20 and found["w"]["distinct_count"] == 3
    types = dict(data.open("t").dtypes)
    assert types == {"i": "bigint", "r": "double", "t": "string", "w": "decimal(38,0)", "odd `n": "string"} and not data.is_untyped("t")


def test_declared_types_decide_where_they_fit(spark):
    df = spark.createDataFrame([(0, 5, "x", 1.5), (1, 7, "y", 2.5)], "a int, b int, c string, d double")
    data = Dataset.from_frames(spark, {"t": df}, declared_types={"t": {"a": "FLOAT", "b": "bool", "c": "INT", "d": "timestamp", "gone": "INT"}})
    kinds = {r["column"]: r["kind"] for r in profile_dataset(data).columns.collect()}
    assert kinds == {"a": "real", "b": "boolean", "c": "text", "d": "real"}
