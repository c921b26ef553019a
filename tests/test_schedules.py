"""Rates over training logs, step by step."""

import math
import random

from pyspark.sql import functions as F

from linework.operators import schedules


def test_plateau_rates(spark):
    log = [5.0, 4.0, 4.0, 3.9999, 4.1, None, 4.2, 4.3, 4.4, 4.5, 3.0, math.nan, 3.5]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(log)] + [("b", 0, 1.0)], "run string, epoch int, v double")
    found = schedules.plateau_rates(rows, "v", 0.8, "run").orderBy("run", "epoch").collect()
    a = [r for r in found if r["run"] == "a"]
    assert [r["bad"] for r in a] == [0, 0, 1, 2, 3, 0, 1, 2, 3, 0, 0, 1, 2]  # 3.9999 is not better by a ten-thousandth
    assert [r["rate"] for r in a] == [0.8] * 5 + [0.4] * 4 + [0.2] * 4
    assert [r["best"] for r in a] == [5.0] + [4.0] * 9 + [3.0] * 3 and found[-1]["rate"] == 0.8
    floor = schedules.plateau_rates(rows, "v", 0.8, "run", patience=0, least=0.3).where("run = 'a'").orderBy("epoch").collect()
    assert floor[-1]["rate"] == 0.3 and schedules.plateau_rates(rows.where("false"), "v", 1.0, "run").count() == 0


def test_a_long_run_is_folded_alone(spark):
    rng = random.Random(3)
    values = [rng.random() + 1e4 / (i + 1) for i in range(60_000)]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "run int, epoch int, v double")
    best, bad, rate = math.inf, 0, 1.0
    for v in values:
        best, bad = (v, 0) if v < best * (1 - 1e-4) else (best, bad + 1)
        if bad > 3:
            rate, bad = rate / 2 if rate / 2 > 1e-8 else rate, 0
    last = schedules.plateau_rates(rows, "v", 1.0, "run").orderBy(F.desc("epoch")).first()
    assert (last["best"], last["bad"], last["rate"]) == (best, bad, rate)


def test_warm_up(spark):
    shares = [r[0] for r in spark.range(0, 14).select(schedules.warm_up("id", 4, 12)).collect()]
    assert shares == [0, 0.25, 0.5, 0.75, 1, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125, 0, 0]
    assert spark.range(1).select(schedules.warm_up("id", 0, 0)).first()[0] == 0
