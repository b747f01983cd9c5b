"""Order statistics by narrowing ranges, and fingerprints of nested cases."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import evaluation as el
from fleetgauge.operators import segments


@pytest.mark.parametrize("radix, few", [(4, 3), (16, 10), (4096, 1 << 16)])
def test_order_values_equal_sorting(spark, monkeypatch, radix, few):
    monkeypatch.setattr(segments, "RADIX", radix)
    monkeypatch.setattr(segments, "FEW_VALUES", few)
    rng = random.Random(radix)
    draw = lambda: rng.choice([0.02, rng.random(), rng.random() * 1e-9, 1e12 * rng.random(), -5.0, rng.randint(0, 9) * 1.0])
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 4)}", draw()) for _ in range(1200)] + [("none", None), ("one", 3.0)]
    counts = spark.createDataFrame(data, "k string, x double").groupBy("k", "x").agg(F.count("*").alias("n"))
    ranks = {"low": "0", "mid": "floor(total / 2)", "high": "total - 1"}
    got = {r.k: (r.low, r.mid, r.high) for r in segments.order_values(counts, "k", "x", "n", ranks).collect()}
    want = {}
    for k in {k for k, x in data if x is not None}:
        xs = sorted(x for j, x in data if j == k)
        want[k] = (xs[0], xs[len(xs) // 2], xs[-1])
    assert got == want


CASES = "case_id string, tags array<string>, steps array<struct<name:string,marks:map<string,array<string>>>>, weights array<int>"


def _print(spark, *rows):
    return el.suite_fingerprint(spark.createDataFrame(list(rows), CASES)).first()


def test_fingerprint_of_nested_cases(spark):
    a = ("a", ["x", "y"], [{"name": "s", "marks": {"k": ["1", "2"], "l": []}}], [1, 2])
    b = ("b", None, [], None)
    same = ("a", ["y", "x"], [{"name": "s", "marks": {"l": [], "k": ["2", "1"]}}], [1, 2])
    whole = _print(spark, a, b)
    assert whole.cases == 2 and _print(spark, b, same) == whole
    for other in (("a", ["x", "y"], a[2], [2, 1]), ("a", ["x", "z"], a[2], a[3]), ("a", a[1], [{"name": "s", "marks": {"k": ["1"], "l": ["2"]}}], a[3]),
                  ("a", a[1], a[2], None)):
        assert _print(spark, other, b).suite_sha256 != whole.suite_sha256
    assert _print(spark, a, a, b).suite_sha256 != whole.suite_sha256


def test_rank_with_half_of_all_rows_on_one_score(spark):
    from pyspark.sql import Window

    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"r{i % 7}", 0.6 if i % 2 else rng.randint(0, 99) / 100, f"cause {rng.randint(0, 5000)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, score double, cause string, i int")
    order = [F.desc("score"), F.col("cause"), F.col("i")]
    # so small a table would be read as one partition otherwise
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = segments.ranked_by_range(df, ["run"], order, "place")
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the rows of the one score lie in many ranges
    dealt = df.repartitionByRange(F.col("run"), *order).withColumn("at", F.spark_partition_id())
    sizes = [r["count"] for r in dealt.groupBy("at").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < 3 * 3000 / len(sizes) and len(sizes) > 4


def test_null_runs_shuffle_no_samples_by_log(spark):
    from helpers import frames, log

    from fleetgauge.operators import gates

    def change(r, x):
        x["conf"] = float("nan") if 20 <= r < 25 else x["conf"]
        x["gap"] = None if r >= 95 else x["gap"]

    tel, files = frames(spark, log("file_a", n=100, change=change))
    runs = {r.signal: (r.start_s, r.end_s, r.samples) for r in gates.null_runs(tel, files).collect()}
    assert runs == {"object_confidence": (pytest.approx(0.4), pytest.approx(0.48), 5), "relative_distance_m": (pytest.approx(1.9), pytest.approx(1.98), 5)}
