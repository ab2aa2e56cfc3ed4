import os
import random
import subprocess
import sys
from statistics import median

import pytest
from pyspark.sql import functions as F

from granary.core import rules
from granary.core.islands import first_seen_mode, gap_tolerant_runs, longest_runs, with_islands
from granary.core.numbers import py_round, safe_ratio
from granary.core.ranks import at_ranks, numbered
from granary.functions import text
from granary.functions.bins import bin_of, rounded
from granary.operators.sampling import even_indices, frame_indices, relative_period
from granary.operators.temporal import quota_topk, thresholds


def test_rounding_is_pythons(spark):
    rnd = random.Random(1)
    values = [n / d for d in (8, 16, 80, 400, 7) for n in range(d)] + [rnd.uniform(0, 400) for _ in range(500)] + [0.5, 1.5, 2.675, 1.005, 0.0625]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", *[rounded("v", n).alias(f"r{n}") for n in (2, 3, 4)]).collect():
        assert [row.r2, row.r3, row.r4] == [round(row.v, n) for n in (2, 3, 4)]
    assert spark.sql(f"SELECT {safe_ratio('1', '0')} AS a, {safe_ratio('1', '80')} AS b, {py_round('0.5', 0)} AS c").first() == (0.0, 0.013, 0.0)


@pytest.mark.parametrize(
    ("name", "cases"),
    [
        ("ratio_bin", {0.0: "none", 0.01: "low", 0.5: "medium", 0.75: "high", 0.899: "high", 0.9: "very_high"}),
        ("legacy_ratio_bin", {None: "unknown", 0.0: "none", 0.249: "low", 0.25: "medium", 0.6: "high", 0.85: "very_high"}),
        ("count_level", {0.0: "none", 1.0: "low", 2.0: "medium", 5.0: "high"}),
        ("count_bin", {0.0: "none", 2.0: "low", 6.0: "medium", 7.0: "high"}),
        ("lighting", {44.0: "low", 45.0: "sufficient", 220.0: "sufficient", 240.0: "low", 24.0: "very_low", 241.0: "very_low"}),
        ("audit_seconds", {None: "unknown", 0.0: "0", 29.0: "<30s", 30.0: "30-60s", 1800.0: "30min+"}),
        ("audit_bpm", {59.9: "<60", 60.0: "60-79", 120.0: "120+"}),
        ("activity_level", {0.029: "very_low", 0.03: "low", 0.08: "medium", 0.16: "high"}),
        ("episode_duration", {0.0: "none", 2.0: "very_short", 6.0: "short", 18.0: "medium", 19.0: "long"}),
    ],
)
def test_bins_at_their_cut_points(spark, name, cases):
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    assert [r.b for r in df.select(bin_of(name, "v").alias("b")).collect()] == list(cases.values())


def test_islands_runs_and_modes_equal_a_sequential_reading(spark):
    rnd = random.Random(2)
    rows = [(p, k, rnd.choice("aab"), rnd.random() < 0.5) for p in range(30) for k in range(rnd.randint(1, 25))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "person int, ord int, state string, on boolean").cache()
    by = {}
    for p, k, s, on in sorted(rows):
        by.setdefault(p, []).append((k, s, on))
    islands = {(r.person, r.ord): r.island for r in with_islands(df, ["person"], "ord", ["state"]).collect()}
    runs = {r.person: r.n for r in longest_runs(df, ["person"], "ord", {"n": F.col("on")}).collect()}
    tolerant = {(r.person, r.ord): r.in_run for r in gap_tolerant_runs(df, ["person"], "ord", F.col("on"), 1, 3).collect()}
    mode = {r.person: r.m for r in first_seen_mode(df, ["person"], "state", "ord", "m").collect()}
    for p, seq in by.items():
        n = longest = now = 0
        for i, (k, s, on) in enumerate(seq):
            n += i == 0 or seq[i - 1][1] != s
            assert islands[p, k] == n
            now = now + 1 if on else 0
            longest = max(longest, now)
        assert runs[p] == longest
        groups, run, gap = [], [], 0
        for k, _, on in seq:
            if on:
                run.append(k)
                gap = 0
            elif run and gap < 1:
                gap += 1
            else:
                groups.append(run)
                run, gap = [], 0
        inside = {k for g in [*groups, run] if len(g) >= 3 for k in g}
        assert {k for k, _, _ in seq if tolerant[p, k]} == inside
        states = [s for _, s, _ in seq]
        assert mode[p] == max(dict.fromkeys(states), key=states.count)


def test_even_sampling_and_periods(spark):
    for n in (0, 1, 2, 11, 12, 13, 100):
        for k in (0, 1, 2, 6, 12):
            want = list(range(n)) if k <= 0 or n <= k else [0] if k == 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)]
            assert spark.range(1).select(even_indices(F.lit(n), k).alias("x")).first().x == want
    assert spark.range(1).select(frame_indices(F.lit(100), 5).alias("x")).first().x == [10, 30, 50, 70, 90]
    df = spark.createDataFrame([(0.0, 45.0), (15.0, 30.0), (3600.0, None)], "s double, d double")
    assert [r.p for r in df.select(relative_period(F.col("s"), F.col("d")).alias("p")).collect()] == ["00:00 - 01:00", "00:00 - 01:00", None]


def test_thresholds_fall_back_to_the_minimum(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, 10.0, 100.0, 0.1, 0.5), (2, 20.0, 300.0, 0.3, 0.7)], "person int, global_motion double, near_motion double, hand_motion double, pose_motion double")
    got = {r.person: tuple(r)[1:] for r in thresholds(df).collect()}
    assert got[1] == (8.0, 8.0, 0.06, 0.04)
    assert got[2] == pytest.approx((median([10, 20]) * 1.8, 360.0, 0.36, 1.08))


def test_quota_and_text_helpers(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 8), (1, "a", 7), (1, "b", 6), (1, "b", 1)], "p int, kind string, score int")
    got = quota_topk(df, ["p"], "kind", F.lit(2), [F.desc("score")], 3).orderBy("rank").collect()
    assert [(r.kind, r.score) for r in got] == [("a", 9), ("a", 8), ("b", 6)]
    row = spark.sql("SELECT '-- My.Data set!' AS a, '..x y-z..' AS b, 'quality_drop' AS c, map('b', 2, 'a', 1) AS m")
    assert tuple(row.select(text.safe_slug(F.col("a")), text.tag_slug(F.col("b")), text.display_name(F.col("c")), text.compact_map(F.col("m"))).first()) == ("my_data_set", "x_y-z", "Quality_Drop", "a=1;b=2")
    assert rules.RISK_LABELS[0] == "no_observed_risk"


def test_ranks_equal_those_of_one_ordering(spark):
    rnd = random.Random(3)
    ids = [f"p{rnd.randrange(10**6):06d}" for _ in range(3000)]
    df = spark.createDataFrame([(i,) for i in set(ids)], "k string").repartition(5)
    assert {r.k: r.n for r in numbered(df, "k", "n", 16).collect()} == {k: i for i, k in enumerate(sorted(set(ids)), 1)}
    assert numbered(df.limit(0), "k", "n").collect() == []
    rows = [(k, float(rnd.choice([1, 2, 2, 2, rnd.randrange(1000)]))) for k in "ab" for _ in range(2000)] + [("c", 5.0)]
    got = {r.k: tuple(r)[1:] for r in at_ranks(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", {"x": F.lit(0), "y": F.floor((F.col("total") - 1) / 3), "z": F.col("total") - 1}, 8).collect()}
    for k in "abc":
        own = sorted(v for key, v in rows if key == k)
        assert got[k] == (len(own), own[0], own[(len(own) - 1) // 3], own[-1])


ON_EXECUTORS = """
from pyspark.sql import SparkSession, functions as F
from granary.core.ranks import at_ranks

conf = {"spark.driver.memory": "1g", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
df = spark.range(30000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
print([tuple(r) for r in at_ranks(df, ["k"], "v", {"x": F.floor(F.col("total") / 4), "z": F.col("total") - 1}).orderBy("k").collect()])
spark.stop()
"""


def test_ranks_where_executors_send_pieces_in_any_order(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(tmp_path), "SPARK_LOCAL_DIRS": str(tmp_path)}
    ran = subprocess.run([sys.executable, "-c", ON_EXECUTORS], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=env)
    assert ran.stdout.splitlines()[-1:] == [str([(k, 10000, 7500.0 + k, 29997.0 + k) for k in range(3)])], ran.stderr[-2000:]
