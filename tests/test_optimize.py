import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import optimize, raster, validate, whatif, wayfinding
from gridloom.plans import queries

from .oracle import DATA

COLUMNS = "scenario string, entity long, kind string, cost double, uplift double, uplift_per_million double"


def items(spark, rows):
    return spark.createDataFrame([("s", e, k, c, u, u / (c / 1e6)) for e, k, c, u in rows], COLUMNS)


ROWS = [(1, "hardening", 3.4e6, 25.0), (1, "elevation", 5.1e6, 35.0), (2, "hardening", 3.4e6, 20.0), (3, "redundant_feed", 9.5e6, 15.0), (4, "hardening", 1e6, 0.0)]


def test_greedy(spark):
    got = optimize.greedy(items(spark, ROWS), 15e6).orderBy("place").collect()
    assert [(r["entity"], r["kind"]) for r in got] == [(1, "hardening"), (2, "hardening")]
    assert got[-1]["total_cost"] <= 15e6


def test_more_budget_spends_more(spark):
    spent = [optimize.greedy(items(spark, ROWS), b).agg({"cost": "sum"}).first()[0] or 0 for b in (1e6, 4e6, 8e6, 20e6)]
    assert spent == sorted(spent)


@pytest.mark.parametrize("seed", range(5))
def test_exact_against_all_choices(spark, seed):
    rng = random.Random(seed)
    rows = [(e, k, rng.randint(1, 20) * 1e6, float(rng.randint(0, 30))) for e in range(6) for k in ("a", "b")]
    budget = 30e6
    best = max(
        sum(p[3] for p in picks if p)
        for picks in itertools.product(*([None, *(r for r in rows if r[0] == e)] for e in range(6)))
        if sum(p[2] for p in picks if p) <= budget
    )
    got = optimize.exact(items(spark, rows), budget).collect()
    assert sum(r["uplift"] for r in got) == pytest.approx(best)
    assert sum(r["cost"] for r in got) <= budget and len({r["entity"] for r in got}) == len(got)


def scanned(rows, budget):
    """The greedy rule, row by row."""
    spent, taken, out = 0.0, set(), []
    for e, k, c, u in sorted((r for r in rows if r[3] > 0), key=lambda r: (-(r[3] / (r[2] / 1e6)), -r[3], r[0], r[1])):
        if e not in taken and spent + c <= budget:
            spent, taken = spent + c, taken | {e}
            out.append((e, k))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pruned_rows_change_no_portfolio(spark, seed):
    rng = random.Random(seed)
    cost = [lambda: rng.choice([3e6, 5e6, 11e6, 38e6]), lambda: rng.uniform(2e6, 30e6), lambda: rng.randint(1, 90) * 1e6][seed]
    rows = [(e, k, cost(), float(rng.randint(-3, 30))) for e in range(400) for k in "abc"]
    df, budget = items(spark, rows).repartition(5), 60e6
    assert [(r["entity"], r["kind"]) for r in optimize.greedy(df, budget).orderBy("place").collect()] == scanned(rows, budget)
    whole, _, proved = optimize.best_choice([[(c, u, k) for i, k, c, u in rows if i == e] for e in range(400)], budget)
    got = optimize.exact(df, budget).collect()
    assert sum(r["uplift"] for r in got) == pytest.approx(whole) and sum(r["cost"] for r in got) <= budget
    assert optimize.contenders(df, budget, "uplift", ["uplift", "cost", "entity", "kind"]).count() < len(rows) / 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_registered_portfolios_see_every_part(spark):
    every = queries._catalog(spark, DATA).collect()
    for s in range(3):
        rows = [(r["entity"], r["kind"], r["cost"], r["uplift"]) for r in every if r["entity"] % 3 == s]
        got = queries.portfolio_greedy(spark, DATA).where(F.col("scenario") == f"s{s}").orderBy("place").collect()
        assert [(r["entity"], r["kind"]) for r in got] == scanned(rows, 60e6)
        most = {0: 0.0}  # by hundreds of dollars, rounded up: costs are the same few, so no sum is near the budget
        for _, own in itertools.groupby(sorted(rows), key=lambda r: r[0]):
            now = dict(most)
            for _, _, c, u in own:
                for spent, v in most.items():
                    if u > 0 and (x := spent + math.ceil(c / 100)) <= 600_000:
                        now[x] = max(now.get(x, 0.0), v + u)
            most = now
        got = queries.portfolio_exact(spark, DATA).where(F.col("scenario") == f"s{s}").agg({"uplift": "sum"}).first()[0]
        assert got == pytest.approx(max(most.values()))


def test_portfolio_takes_benefits_where_there_are_any(spark):
    rows = items(spark, ROWS).withColumns({"benefit": F.col("entity") * 4e6, "economic": F.lit(0.0), "property": F.lit(None).cast("double")})
    assert [(r["entity"], r["cost"]) for r in optimize.portfolio(rows, 10e6).orderBy("place").collect()] == [(1, 3.4e6), (2, 3.4e6), (4, 1e6)]
    none = rows.withColumn("benefit", F.lit(0.0))
    assert sorted(map(tuple, optimize.portfolio(none, 10e6).drop("proved").collect())) == sorted(map(tuple, optimize.greedy(none, 10e6).collect()))


def test_uniform_factors_leave_ranks_alone(spark):
    assets = spark.createDataFrame([(i, 0.1 + i % 7 / 20, float(i * 13 % 29 + 1), i % 5 / 50) for i in range(40)], "entity long, hazard double, cascade double, betweenness double")
    ways = spark.createDataFrame([("all alike", 1.0, 2.0, 1.0), ("centrality", 1.0, 1.0, 100.0)], "perturbation string, hazard_factor double, cascade_factor double, betweenness_factor double")
    got = {r["perturbation"]: r for r in validate.sweep(assets, ways).collect()}
    assert got["all alike"]["rho"] == 1.0 and got["all alike"]["stable"] and got["centrality"]["rho"] < 1.0


def test_rank_shifts_and_cover(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 3.0)], "k string, x double, y double")
    assert [(r["k"], r["shift"]) for r in validate.rank_shifts(df, "k", "x", "y").collect()] == [("c", 2), ("a", -2)]
    p, a = (spark.createDataFrame([(x,) for x in s], "i string") for s in ("ab", "bc"))
    assert tuple(validate.covered(p, a, "i").first()) == (["b"], ["c"], ["a"])


def grid(spark, n, special):
    return spark.createDataFrame([(r, c, float(special.get((r, c), 1.0))) for r in range(n) for c in range(n)], "row int, col int, cost double")


def route(spark, surface, ends, alternatives=1):
    trips = spark.createDataFrame([(1, *ends, alternatives)], "trip long, r1 int, c1 int, r2 int, c2 int, alternatives int")
    return wayfinding.least_cost_paths(surface, trips).orderBy("alternative", "place").collect()


def test_least_cost_paths(spark):
    plain = route(spark, grid(spark, 10, {}), (0, 0, 9, 9))
    assert len(plain) == 10 and plain[0]["total"] == pytest.approx(9 * 1.4142)
    wall = {(r, 5): 1000.0 for r in range(9)}
    assert all((r["row"], r["col"]) not in wall for r in route(spark, grid(spark, 10, wall), (0, 0, 0, 9)))
    assert route(spark, grid(spark, 10, {(r, 5): float("inf") for r in range(10)}), (0, 0, 0, 9)) == []
    two = route(spark, grid(spark, 30, {}), (15, 0, 15, 29), 2)
    first, second = ({(r["row"], r["col"]) for r in two if r["alternative"] == k} for k in (0, 1))
    assert first != second


def test_base_stays_as_it_is_under_a_scenario(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    out = whatif.overlay(base, spark.createDataFrame([(2, "c"), (3, "d")], base.schema), spark.createDataFrame([(1, "a")], base.schema), ["k"])
    assert sorted(map(tuple, out.collect())) == [(2, "c"), (3, "d")]
    assert sorted(map(tuple, base.collect())) == [(1, "a"), (2, "b")]


def test_committing_twice_changes_nothing(spark):
    entities, edges = spark.createDataFrame([(1,)], "entity long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    stations, serves = spark.createDataFrame([(9,)], "entity long"), spark.createDataFrame([(9, 1)], "src long, dst long")
    once = whatif.commit(entities, stations, edges, serves)
    again = whatif.commit(once[0], stations, once[1], serves)
    assert [sorted(map(tuple, df.collect())) for df in once] == [sorted(map(tuple, df.collect())) for df in again] == [[(1,), (9,)], [(1, 2), (1, 9), (9, 1)]]


def test_smoothing_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(2)
    cells = r.normal(size=(7, 5))
    sigma, reach = 1.5, 6
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    want = cells
    for axis in (0, 1):
        wide = np.pad(want, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, w, mode="valid"), axis, wide)
    df = spark.createDataFrame([(i, j, float(cells[i, j])) for i in range(7) for j in range(5)], "row long, col long, value double")
    got = {(x["row"], x["col"]): x["value"] for x in raster.smoothed(df, sigma, 7, 5).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i in range(7) for j in range(5)})


def test_simplified_lines(spark):
    from gridloom.operators import clip

    line = [{"x": float(i), "y": 0.01 * (i % 2)} for i in range(10)] + [{"x": 9.0, "y": 5.0}]
    df = spark.createDataFrame([(line,), (None,), (line[:1],)], "p array<struct<x: double, y: double>>")
    got = [r[0] and [(p["x"], p["y"]) for p in r[0]] for r in df.select(clip.simplified(df["p"], 0.1)).collect()]
    assert got == [[(0.0, 0.0), (9.0, 0.01), (9.0, 5.0)], None, [(0.0, 0.0)]]


def test_evaluating_a_scenario(spark):
    assets = spark.createDataFrame([(1, "rail", 1000.0, "tunnel", None, None, None, None, 0, 2.0), (2, "bridge", None, None, None, None, 30.0, True, 0, 2.0)], "asset long, type string, length double, terrain string, work string, lanes int, span double, posted boolean, population int, detour_km double")
    samples = spark.createDataFrame([(1, 0.0, 0.0), (1, 1000.0, 0.0)], "asset long, x double, y double")
    areas = spark.createDataFrame([(7, 500.0, 0.0, 100, 0.2), (8, 0.0, 5500.0, 10, 1.0), (9, 1500.0, 0.0, 50, None)], "area long, x double, y double, population int, svi double")
    people = whatif.people_along(samples, areas, "asset", "area")
    assert [tuple(r) for r in people.collect()] == [(1, 150, 45.0)]
    cells = spark.createDataFrame([(1, 1), (1, 0)], "asset long, flood int")
    got = {r["asset"]: r for r in whatif.evaluate(assets, cells, people, "asset").collect()}
    assert got[1]["construction"] == 120e6 and got[1]["affected"] == 7
    assert got[1]["objective"] == pytest.approx(120e6 + 1000 * 500 * 15.3725 + 0.5 * 0.5 * 120e6 - 45_000)
    assert got[2]["construction"] == 7.5e6 and got[2]["capacity"] == 23.0
