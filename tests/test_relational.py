import itertools
import random

import pytest
from pyspark.sql import functions as F

from textlake.operators import aggregates as A, quality as Q, relational as R


def test_either_join_equals_or(spark):
    rnd = random.Random(5)
    values = [None, 1, 2, 3]
    left = [(n, rnd.choice(values), rnd.choice(values), rnd.choice(values)) for n in range(40)]
    right = [(n, rnd.choice(values), rnd.choice(values), rnd.choice(values)) for n in range(40)]
    want = sorted(
        (l[0], r[0])
        for l, r in itertools.product(left, right)
        if (l[1] is not None and l[1] == r[1]) or (None not in (l[2], l[3]) and l[2:] == r[2:])
    )
    l, r = spark.createDataFrame(left, "l int, a int, b int, c int"), spark.createDataFrame(right, "r int, x int, y int, z int")
    got = R.either_join(l, r, (F.col("a"), F.col("x")), [(F.col("b"), F.col("y")), (F.col("c"), F.col("z"))], ["l"], ["r"])
    assert sorted(tuple(row) for row in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sources_and_coverage(spark):
    def df(*rows):
        return spark.createDataFrame(list(rows), "k int, v string")

    a, b, c = df((1, "a"), (1, "a2"), (None, "an")), df((1, "b"), (2, "b"), (2, "b2")), df((2, "c"), (3, "c"), (None, "cn"))
    for stage in (False, True):
        got = sorted((r.k or 0, r.v) for r in R.coalesce_sources([a, b, c], "k", stage).collect())
        assert got == [(0, "an"), (0, "cn"), (1, "a"), (1, "a2"), (2, "b"), (2, "b2"), (3, "c")]
    counts = A.origin_counts(b, "k", a).first()
    assert (counts.total, counts.from_first, counts.from_other) == (3, 1, 2)
    plan = R.not_covered(b.hint("merge"), a, "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "LeftAnti" in plan


def test_resolve_id_list(spark):
    df = spark.createDataFrame([(1, "b,a,b"), (2, "zz"), (3, None), (4, "zz,a"), (4, "b")], "k int, ids string")
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "i string, n string")
    got = sorted((r.k, r.names) for r in R.resolve_id_list(df, "ids", names, "i", "n").collect())
    assert got == [(1, "Bob,Ann,Bob"), (2, None), (3, None), (4, "Ann"), (4, "Bob")]


def test_histogram_and_tops(spark):
    votes = [None, 0, 10, 11, 1000, 1001, 500000, 500001]
    df = spark.createDataFrame([(v, n) for n, v in enumerate(votes)], "v int, id int")
    row = A.range_histogram(df, "v").first().asDict()
    hit = {k: n for k, n in row.items() if n}
    assert hit == {
        "in_range_0_10": 2, "in_range_10_50": 1, "in_range_500_1000": 1, "in_range_1000_5000": 1, "in_range_100000_500000": 1,
    }
    long = {(r.lo, r.hi): r.n for r in A.range_histogram(df, "v", wide=False).collect()}
    assert sum(long.values()) == 6 and long[(0, 10)] == 2
    top = A.weighted_top(df.withColumn("r", F.lit(2.0)), "r", "v", 3, "id")
    assert [r.v for r in top.collect()] == [500001, 500000, 1001]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    ks = spark.createDataFrame([(None,), (0,), (1,), (200,), (201,)], "k int").select(A.resolve_k("k").alias("k"))
    assert [r.k for r in ks.collect()] == [20, 1, 1, 200, 200]


def test_quality(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "yy")], "k int, s string")
    assert [tuple(r) for r in Q.unique_violations(df, "k").collect()] == [(1, 2)]
    assert [tuple(r) for r in Q.null_violations(df, ["k", "s"]).collect()] == [("s", 1)]
    bad = Q.bound_violations(df, {"short": F.length("s") < 2, "k1": F.col("k") == 1})
    assert sorted((r.k, r.s or "", r.rule) for r in bad.collect()) == [(1, "", "short"), (2, "yy", "k1"), (2, "yy", "short")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_not_covered_with_a_bitmap(spark, kind, monkeypatch):
    """The same rows with and without, also with a bitmap so small that most keys may be in it; few rows are shuffled."""
    wide = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 700).cast(kind).alias("k"), "id", F.lit("x" * 50).alias("text"))
    other = spark.range(0, 140, 2).select(F.col("id").cast("int").cast("string" if kind == "string" else "int").alias("o")).unionByName(spark.range(1).select(F.lit(None).alias("o")))
    want = sorted(r.id for r in R.not_covered(wide, other, "k", "o").collect())
    for pages in (R.BITMAP_BITS, 64):
        monkeypatch.setattr(R, "BITMAP_BITS", pages)
        got = R.not_covered(wide, other, "k", "o", prefilter=True)
        assert got.columns == wide.columns and sorted(r.id for r in got.collect()) == want
    monkeypatch.setattr(R, "BITMAP_BITS", 1 << 27)
    bits = 1 << 15
    marked = R.maybe_among(wide, "k", R.key_bitmap(other.where("o IS NOT NULL").select(F.col("o").cast(kind).alias("k")), "k", bits), bits)
    assert marked.where("_maybe").count() < 400 and marked.where("_maybe AND k IS NULL").count() == 0
    none = other.where("o IS NULL")
    assert R.not_covered(wide, none, "k", "o", prefilter=True).count() == 3000


def test_checked_writes_and_observed_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 3), (2, None, 5), (2, "c", None)], "k int, t string, v int")
    table, report = Q.write_checked(df, str(tmp_path / "t"), ["k", "t"], {"small": F.col("v") < 4}, unique="k")
    assert table.count() == 3
    assert {(r["check"], r["column"]): r["n"] for r in report.collect()} == {
        ("rows", None): 3, ("null", "k"): 0, ("null", "t"): 1, ("rule", "small"): 2, ("unique", "k"): 1,
    }
    for none in (df.where("v > 9"), df.limit(0), spark.createDataFrame([], df.schema)):
        with pytest.raises(Q.QualityError, match="nothing there"):
            Q.write_checked(none, str(tmp_path / "none"), ["k"], message="nothing there")
        assert not (tmp_path / "none").exists()
    seen, get = Q.observed(df, {"n": F.count(F.lit(1)), "v": F.sum("v")})
    seen.write.format("noop").mode("overwrite").save()
    assert get() == {"n": 3, "v": 8}


def test_either_matched_keeps_rows_without_pairs(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "d", 4), (5, None, 5)], "id int, t string, y int")
    right = spark.createDataFrame([(1, "x", 9), (1, "x", 9), (9, "b", 2), (None, "b", 2), (9, "c", 9), (None, None, 5)], "rid int, rt string, ry int")
    got = R.either_matched(left, right, (F.col("id"), F.col("rid")), [(F.col("t"), F.col("rt")), (F.col("y"), F.col("ry"))])
    assert sorted(r.id for r in got.collect()) == [1, 2] and got.columns == left.columns
