"""Operators against brute force on random data where one key holds a third of the rows."""

import random
import statistics
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from honorlens.operators import groups as G
from honorlens.operators import stats as S
from honorlens.plans import marts as M


def _rows(n=3000, seed=11):
    rnd = random.Random(seed)
    cats = ["hot", "b", "c", "d", "e"]
    out = []
    for i in range(n):
        cat = "hot" if i % 3 == 0 else rnd.choice(cats[1:])
        out.append((i % 400, f"n{i % 97}", rnd.choice(["female", "male", "other"]), cat,
                    rnd.randint(20, 80), rnd.choice(["EU", "AS", "AF", None]),
                    None if rnd.random() < 0.3 else round(rnd.uniform(30, 90), 1)))
    return out


SCHEMA = "id int, name string, gender string, category string, age_at_award int, birth_continent string, lifespan double"


def test_descriptive_matches_brute_force(spark):
    rows = _rows()
    got = {r["category"]: r for r in G.descriptive_by_group(spark.createDataFrame(rows, SCHEMA)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    for cat, rs in by.items():
        ages = [r[4] for r in rs]
        life = [r[6] for r in rs if r[6] is not None]
        g = got[cat]
        assert g["count"] == len(rs) and g["unique_laureates"] == len({r[0] for r in rs})
        assert abs(g["avg_age"] - statistics.mean(ages)) < 1e-9
        assert g["median_age"] == statistics.median(ages)
        assert abs(g["std_age"] - statistics.stdev(ages)) < 1e-9
        assert abs(g["pct_female"] - 100 * sum(r[2] == "female" for r in rs) / len(rs)) < 1e-9
        assert abs(g["avg_lifespan"] - statistics.mean(life)) < 1e-9


def test_chi_squared_matches_brute_force(spark):
    rows = _rows()
    got = S.chi_squared(spark.createDataFrame(rows, SCHEMA), "gender", "category").collect()[0]
    cells = Counter((r[2], r[3]) for r in rows)
    rs, cs, n = Counter(r[2] for r in rows), Counter(r[3] for r in rows), len(rows)
    brute = sum((cells.get((a, b), 0) - rs[a] * cs[b] / n) ** 2 / (rs[a] * cs[b] / n) for a in rs for b in cs)
    assert abs(got["chi2_statistic"] - brute) < 1e-9 and got["dof"] == (len(rs) - 1) * (len(cs) - 1)


def test_mann_whitney_matches_brute_force(spark):
    rows = [r for r in _rows() if r[3] in ("hot", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.mann_whitney(df, "age_at_award", F.col("category") == "hot").collect()[0]
    vals = sorted(r[4] for r in rows)
    first, last = {}, {}
    for i, v in enumerate(vals, start=1):
        first.setdefault(v, i)
        last[v] = i
    r1 = sum((first[r[4]] + last[r[4]]) / 2 for r in rows if r[3] == "hot")
    n1 = sum(r[3] == "hot" for r in rows)
    assert abs(got["u_statistic"] - (r1 - n1 * (n1 + 1) / 2)) < 1e-6


def test_sankey_indices_match_first_appearance(spark):
    rows = _rows()
    out = M.sankey_links(spark.createDataFrame(rows, SCHEMA)).collect()
    flow = sorted(Counter((r[5], r[3]) for r in rows if r[5] is not None).items())
    conts = sorted({c for (c, _), _ in flow})
    cats = []
    for (_, cat), _ in flow:
        if cat not in cats:
            cats.append(cat)
    for r in out:
        assert r["source"] == conts.index(r["birth_continent"])
        assert r["target"] == len(conts) + cats.index(r["category"])
        assert r["value"] == dict(flow)[(r["birth_continent"], r["category"])]


def test_first_k_with_hot_group(spark):
    rows = _rows()
    got = {r["category"]: r["notable"] for r in G.first_k_distinct(spark.createDataFrame(rows, SCHEMA), "category",
                                                                   "name", "notable", k=5).collect()}
    names = sorted({r[1] for r in rows if r[3] == "hot"})
    assert got["hot"] == ", ".join(names[:5]) + ("..." if len(names) > 5 else "")


def test_mode_with_hot_group(spark):
    rows = _rows()
    got = {r["category"]: r["top_name"] for r in G.mode_by(spark.createDataFrame(rows, SCHEMA), "category", "name",
                                                           "top_name").collect()}
    c = Counter(r[1] for r in rows if r[3] == "hot")
    best = max(c.values())
    assert got["hot"] == min(k for k, v in c.items() if v == best)


def test_distributed_quantile_matches_percentile(spark):
    from honorlens.operators.windows import distributed_quantile

    rnd = random.Random(3)
    rows = [("hot" if i % 3 == 0 else rnd.choice("ab"), round(rnd.uniform(0, 100), 2)) for i in range(1500)]
    rows += [("c", 7.0)]  # single-row group
    df = spark.createDataFrame(rows, "g string, x double")
    for q in (0.5, 0.25, 0.9):
        got = {r["g"]: r["quantile"] for r in distributed_quantile(df, "x", q, ["g"]).collect()}
        want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("x", q).alias("p")).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), (q, got, want)
    whole = distributed_quantile(df, "x", 0.5).collect()[0]["quantile"]
    assert abs(whole - df.agg(F.median("x")).collect()[0][0]) < 1e-9


def test_box_stats_distributed_equals_exact(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r["category"]: r.asDict() for r in M.box_stats(df, "category", "lifespan").collect()}
    b = {r["category"]: r.asDict() for r in M.box_stats(df, "category", "lifespan", distributed=True).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"):
            assert abs(a[k][c] - b[k][c]) < 1e-9, (k, c)
