"""Chunked, binned and range-joined forms against brute force on small tables with a dominant key."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import tails
from tidemark.operators import dynamics as dy
from tidemark.operators import ordered as od
from tidemark.operators import separation as sp
from tidemark.operators import signals as sg
from tidemark.operators import windows as wd


def _records(n_hot=2600, n_cold=7):
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", n_hot), ("cold", n_cold)):
        level = 0.5
        for i in range(n):
            level = min(max(level + rng.uniform(-0.05, 0.05), 0.0), 1.0)
            rows.append((key, f"{key}{i:06d}", float(i * 7), level, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1), None if i % 9 == 4 else rng.random()))
    return rows


def _brute(rows):
    """Sequential reference of the recurrences."""
    out, state = {}, {}
    for key, seg, _, x, gamma, v, q, res in rows:
        s = state.setdefault(key, dict(fast=math.nan, dyn=math.nan, recent=[], steps=[], res=math.nan, w=1.0))
        s["steps"] = (s["steps"] + [abs(x - s["recent"][-1]) if s["recent"] else 0.0])[-4:]
        s["recent"] = (s["recent"] + [x])[-5:]
        s["fast"] = x if math.isnan(s["fast"]) else 0.58 * s["fast"] + 0.42 * x
        core = 0.6 * s["fast"] + 0.4 * float(np.median(s["recent"]))
        ratio = float(np.mean(s["steps"])) / 0.035
        drive = 0.45 * (gamma + 1) / 2 + 0.35 * (1 - v) / 2 + 0.2 * (1 - q) / 2
        vn = min(ratio, 1.0)
        w = min(max(ratio, 0.1), 0.7)
        if math.isnan(s["dyn"]):
            s["dyn"] = x
        else:
            t = (1 - w) * x + w * core
            gain = 0.48 + 0.22 * drive + 0.1 * vn if t <= s["dyn"] else max(0.12 + 0.1 * (1 - drive) - 0.04 * vn, 0.08)
            s["dyn"] += min(gain, 0.85) * (t - s["dyn"])
        if res is None:
            s["w"] *= 0.7025
        elif math.isnan(s["res"]):
            s["res"], s["w"] = res, 1.0
        else:
            s["w"] *= 0.7025
            s["res"], s["w"] = (s["w"] * s["res"] + 0.2975 * res) / (s["w"] + 0.2975), 1.0
        out[seg] = (s["dyn"], s["res"])
    return out


def test_chunked_recurrence_equals_sequential(spark):
    rows = _records()
    df = spark.createDataFrame(rows, "source_key string, segment_id string, window_start_sec double, score double, Gamma double, V double, Q double, RES double")
    got = dy.dynamic_frame(df, ["source_key"], bucket_seconds=900.0, chunk_rows=1000, halo=700).select("segment_id", "score_dynamic", "RES_fast").collect()
    want = _brute(rows)
    assert len(got) == len(rows)
    for r in got:
        dyn, res = want[r["segment_id"]]
        assert abs(r["score_dynamic"] - dyn) < 1e-12
        assert abs(r["RES_fast"] - res) < 1e-12


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": np.round(rng.normal(size=500), 2), "b": rng.pareto(1.0, size=301), "c": np.full(20, 3.0)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)], "g string, x double")
    got = {r["g"]: r for r in od.exact_quantiles(df, ["g"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.95}, bins=16).collect()}
    for g, xs in data.items():
        for name, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.95)):
            assert abs(got[g][name] - np.quantile(xs, p)) < 1e-9


def test_positions_and_running_total(spark):
    df = spark.range(0, 500).select((F.col("id") % 3 == 0).cast("string").alias("k"), "id")
    pos = od.with_position(df, ["k"], ["id"], F.floor(F.col("id") / 40))
    tot = od.running_total(pos, ["k"], "pos", F.col("id"), "total", 16).collect()
    for k in ("true", "false"):
        mine = sorted((r["pos"], r["id"], r["total"]) for r in tot if r["k"] == k)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[2] for m in mine] == list(np.cumsum([m[1] for m in mine]))


def test_average_ranks_and_u_with_ties(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.4 else "b", float(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([("g", s, x) for s, x in rows], "g string, side string, x double")
    got = sp.rank_sum(df, ["g"]).first()
    a, b = [x for s, x in rows if s == "a"], [x for s, x in rows if s == "b"]
    assert abs(got["u"] - sum((p > q) + 0.5 * (p == q) for p in a for q in b)) < 1e-9


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(2)
    points = [("hot" if rng.random() < 0.8 else "x", i, rng.uniform(0, 100)) for i in range(200)]
    spans = [("hot", j, s, s + rng.uniform(0, 30)) for j, s in enumerate(rng.uniform(0, 100) for _ in range(20))]
    p = spark.createDataFrame(points, "k string, i long, t double")
    s = spark.createDataFrame(spans, "k string, j long, a double, b double")
    got = {(r["i"], r["j"]) for r in wd.range_join(p, s, ["k"], "t", "a", "b", 7.0).collect()}
    assert got == {(i, j) for k, i, t in points for k2, j, a, b in spans if k == k2 and a <= t <= b}


def test_planted_beats_and_sine_power(spark):
    fs, t = 250.0, np.arange(0, 20, 1 / 250.0)
    beats_at = np.arange(0.5, 19.5, 0.8)
    ecg = sum(np.exp(-0.5 * ((t - b) / 0.012) ** 2) for b in beats_at) + 0.2 * np.sin(2 * np.pi * 0.3 * t)
    sine = 3.0 * np.sin(2 * np.pi * 10.0 * t)
    df = spark.createDataFrame([("s", "ecg", fs, ecg.tolist()), ("s", "sine", fs, sine.tolist())], "segment_id string, kind string, fs double, samples array<double>")
    rr = df.where("kind = 'ecg'").select(sg.beats("samples", "fs", "kind").alias("rr")).first()["rr"]
    assert len(rr) == len(beats_at) - 1 and abs(np.mean(rr) - 0.8) < 0.01
    alpha = df.where("kind = 'sine'").select(sg.band_powers("samples", "fs").alias("p")).first()["p"][1]
    assert abs(alpha - 4.5) < 0.05


def test_tails():
    assert abs(tails.chi2_tail(5.991, 2) - 0.05) < 1e-4
    assert abs(tails.chi2_tail(7.815, 3) - 0.05) < 1e-4
    assert abs(tails.exact_u_tail(0, 3, 3) - 0.1) < 1e-12


def test_montage_sides():
    sides = [s for _, _, _, s in cfg.channel_rows()]
    assert sides.count("left") == sides.count("right")


def test_scatter_sample_is_the_same_for_any_partitioning(spark):
    import hashlib

    from tidemark.operators import compare as cp

    rows = [(g, f"s{i}", float(i)) for g, n in (("hot", 3000), ("cold", 5), (None, 40)) for i in range(n)] + [("cold", None, 1.0), ("cold", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, segment_id string, x double")
    mark = lambda r: (hashlib.md5(f"42:{r[1] or ''}".encode()).hexdigest(), r[1] is not None, r[1] or "", r[2])
    want = sorted((r for g in ("hot", "cold", None) for r in sorted((r for r in rows if r[0] == g), key=mark)[:30]), key=str)
    for parts in (1, 7):
        sample = cp.scatter_sample(df.repartition(parts), ["g"], limit=30)
        assert sorted((tuple(r) for r in sample.collect()), key=str) == want
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    assert cp.scatter_sample(df.where("false"), ["g"]).count() == 0


def test_rough_borders_are_read_and_not_made_again(spark):
    """Counts of bins and the rows in them must meet: borders that each makes for itself depend on the order of rows."""
    from tidemark.operators.ordered import average_ranks, exact_quantiles, with_value_bin

    df = spark.range(0, 5000, 1, 5).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("label"), (F.xxhash64("id") / 1e15).alias("x"))
    made = [
        average_ranks(df, ["g"], ["label"], "x"), exact_quantiles(df, ["g"], "x", {"mid": 0.5}), exact_quantiles(df, [], "x", {"mid": 0.5}), with_value_bin(df, ["g"], "x", df)]
    for out in made:
        assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert made[0].agg(F.sum("c"), F.min("rank"), F.max("rank")).first()[:] == (5000, 1.0, 2500.0)


def test_a_score_that_stays_is_no_recovery():
    rng = random.Random(5)
    for _ in range(2000):
        s, weight = rng.random(), rng.choice([0.1, 0.3, 0.7])
        fast = dy.ewma_step(s, s, dy.D["fast_alpha"])
        core = dy.D["blend"] * fast + (1.0 - dy.D["blend"]) * s
        assert dy.asymmetric_step(s, s, core, weight, 0.5, 0.2)[1] == "response"
    assert dy.asymmetric_step(0.5, 0.5 + 1e-9, 0.5 + 1e-9, 0.1, 0.5, 0.2)[1] == "recovery"


def test_one_decimal_is_printf(spark):
    from tidemark.operators.crossrun import one_decimal

    rng = random.Random(7)
    values = [0.25, 0.75, 0.15, 0.05, 0.35, 12.25, 12.95, 98237.45, 0.0, -0.0, -0.04, -3.25, 9.95, 9.951, 1e14 + 0.25, 3e15]
    values += [rng.randrange(10**8) / 100 for _ in range(3000)] + [rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(1000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", one_decimal(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if r.t != f"{r.x:.1f}"] == []


def test_thresholds_meet_their_rows_without_a_shuffle_by_map(spark):
    """Rows of two maps stay where they are: a join by map would put each map into one task."""
    from tidemark.operators import resource as rs

    cols = [F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"), F.lit("strict").alias("mode"), F.lit("V4").alias("version")]
    rows = spark.range(0, 400, 1, 4).select("id", *cols, *[((F.col("id") * k % 97) / 97.0).alias(c) for c, k in (("score", 7), ("A", 11), ("Gamma", 13), ("V", 17))])
    for out in (rs.state_map(rows), rs.diamond(rows, {"i": "score", "r": "A"}, ["dataset"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and out.count() == 400


def test_a_row_at_both_medians_has_no_direction_as_in_sql(spark, tmp_path):
    """One event a dataset: its radius is zero, and zero by zero is NaN in the SQL."""
    import duckdb
    import oracle_check

    import __spark_entry__ as entry

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id = 1").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert oracle_check.compare(spark, con, entry.queries()["r07_diamond_2d"], entry.oracle_sql()["r07_diamond_2d"], str(tmp_path)) == "ok 1"


def test_generated_methods_are_of_a_size_that_the_jvm_compiles(spark):
    from tidemark.session import METHOD_BYTES, ship_package

    other = spark.newSession()
    ship_package(other)
    assert int(other.conf.get("spark.sql.codegen.hugeMethodLimit")) == METHOD_BYTES


def test_quantiles_without_each_fold_count_every_row_once(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.choice([round(rng.gauss(0, 1), 2), None])) for _ in range(900)] + [("c", 1, 5.0), ("a", None, 0.5)]
    df = spark.createDataFrame(rows, "g string, fold long, x double")
    got = {(r.g, r.fold): (r.lo, r.mid) for r in od.exact_quantiles(df, ["g"], "x", {"lo": 0.05, "mid": 0.5}, left_out=("fold", [0, 1, 2])).collect()}
    want = {}
    for g in "abc":
        for fold in range(3):
            x = [v for h, f, v in rows if h == g and f is not None and f != fold and v is not None]
            if x:
                want[g, fold] = tuple(np.quantile(x, [0.05, 0.5]))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
