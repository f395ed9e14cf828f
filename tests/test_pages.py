"""Pages by number against sorting everything."""

import random

import pytest
from siftwell.operators.pages import RankDirectory, deep_page
from siftwell.operators.rows import sorted_page


def brute(rows, order):
    """Sorted rows; order: (place, descending), nulls first going up and last going down."""
    for place, down in reversed(order):
        rows = sorted(rows, key=lambda r: (r[place] is not None, r[place] if r[place] is not None else 0), reverse=down)
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, some have none; the key tells them apart."""
    draw = random.Random(5)
    rows = [(i, 7 if i % 3 == 0 else None if i % 11 == 0 else draw.randrange(400), f"t{draw.randrange(50)}") for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id int, v int, t string").repartition(7).cache()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("leaf", [30, 500, 100_000])
def test_pages_anywhere(skewed, descending, leaf):
    rows, df = skewed
    want = brute(rows, [(1, descending), (0, False)])
    directory = RankDirectory(df, "v", descending, ["id"], fanout=8, leaf=leaf)
    for page in (0, 1, 17, 119, 120, 239, 240):
        assert [tuple(r) for r in sorted(directory.page(page, 25).collect(), key=lambda r: want.index(tuple(r)))] == want[page * 25 : page * 25 + 25]


def test_only_small_ranges_are_sorted(skewed):
    _, df = skewed
    directory = RankDirectory(df, "v", False, ["id"], fanout=8, leaf=100)
    plan = directory.page(200, 25)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "GlobalLimit" not in plan
    here = directory.root
    while here.parts:
        here = next(p for p in here.parts if p.start <= 5000 < p.start + p.rows)
    assert here.rows <= 100


def test_equal_keys_and_empty_frames(spark):
    same = spark.createDataFrame([(1, "a")] * 500 + [(2, "b")] * 3, "x int, y string")
    directory = RankDirectory(same, "x", False, fanout=4, leaf=20)
    assert [directory.page(p, 100).count() for p in range(7)] == [100, 100, 100, 100, 100, 3, 0]
    assert {tuple(r) for r in directory.page(5, 100).collect()} == {(2, "b")}
    assert RankDirectory(same.limit(0), "x").page(0).count() == 0
    assert RankDirectory(same, "x", needle="b").page(0).count() == 3


def test_like_a_sorted_page(skewed):
    _, df = skewed
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(deep_page(df, 30, "t", True, ["id"], leaf=200)) == rows(sorted_page(df, 30, "t", True, ["id"]))
