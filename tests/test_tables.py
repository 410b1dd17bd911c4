import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import collapse, privacy, release, survival, tables
from cohortspark.sources import sites


def four(spark, a, b, c, d):
    return spark.createDataFrame([(float(a), float(b), float(c), float(d))], "a double, b double, c double, d double")


def test_epi_fixture(spark):
    r = tables.epi2x2(four(spark, 40, 60, 10, 90)).first()
    assert (r.risk_exposed, r.risk_unexposed, r.risk) == (0.4, 0.1, 0.25)
    assert (r.rd, r.rr, r["or"], r.af_exposed, r.paf) == tuple(map(pytest.approx, (0.3, 4, 6, 0.75, 0.6)))
    assert r.number_needed == pytest.approx(1 / 0.3) and r.direction == "harm"


def test_epi_zero_cell(spark):
    t = four(spark, 10, 10, 0, 20)
    assert tables.epi2x2(t).first()["or"] == float("inf")
    assert tables.epi2x2(t, zero_correction="if_zero").first()["or"] == pytest.approx(10.5 * 20.5 / (10.5 * 0.5))


def test_region_holds_every_table_of_the_box(spark):
    r = tables.epi2x2_region(four(spark, 4, 3, 2, 5), 1).first()
    for a, b, c, d in itertools.product(range(3, 6), range(2, 5), range(1, 4), range(4, 7)):
        p1, p0 = a / (a + b), c / (c + d)
        assert r.rd_lower <= p1 - p0 + 1e-12 and p1 - p0 <= r.rd_upper + 1e-12
        assert r.rr_lower <= p1 / p0 + 1e-12 and p1 / p0 <= r.rr_upper + 1e-12
        assert r.or_lower <= a * d / (b * c) + 1e-12 and a * d / (b * c) <= r.or_upper + 1e-12


def test_mantel_haenszel_fixture(spark):
    rows = [("x", 12.0, 8.0, 5.0, 15.0), ("y", 20.0, 10.0, 10.0, 30.0), ("z", 8.0, 12.0, 4.0, 16.0)]
    r = tables.mantel_haenszel(spark.createDataFrame(rows, "stratum string, a double, b double, c double, d double")).first()
    want = sum(a * d / (a + b + c + d) for _, a, b, c, d in rows) / sum(b * c / (a + b + c + d) for _, a, b, c, d in rows)
    assert r["or"] == pytest.approx(want) and r.or_lower < want < r.or_upper and r.status == "finite"


def test_standardization_fixture(spark):
    rows = [("70", 8.0, 400.0, 1000.0), ("50", 12.0, 1200.0, 6000.0), ("60", 20.0, 800.0, 3000.0)]
    r = tables.direct_standardization(spark.createDataFrame(rows, "stratum string, cases double, person_time double, standard double")).first()
    rate = 0.1 * 8 / 400 + 0.6 * 12 / 1200 + 0.3 * 20 / 800
    assert r.estimate == pytest.approx(rate * 1e5) and r.lower < r.estimate < r.upper


def test_auc_and_roc(spark):
    counts = spark.createDataFrame([(1, 1, 4), (2, 2, 3), (3, 5, 1)], "bin int, cases long, controls long")
    pairs = [(i, j) for i, n, _ in [(1, 1, 4), (2, 2, 3), (3, 5, 1)] for _ in range(n) for j, _, m in [(1, 1, 4), (2, 2, 3), (3, 5, 1)] for _ in range(m)]
    want = sum((i > j) + 0.5 * (i == j) for i, j in pairs) / len(pairs)
    assert tables.auc(counts).first().auc == pytest.approx(want)
    assert tables.auc(counts, "lower").first().auc == pytest.approx(1 - want)
    assert tables.roc(counts).count() == 4


def test_quantile_ends(spark):
    hist = spark.createDataFrame([("v", 0, None, 9), ("v", 1, 1.0, 0), ("v", 2, 2.0, 3), ("v", 3, 3.0, 1), ("v", 4, 4.0, 0)], "variable string, bin int, upper double, n long")
    got = {r.prob: r.value for r in tables.histogram_quantiles(hist, [0.0, 0.5, 0.75, 0.76, 1.0]).collect()}
    assert got == {0.0: 2.0, 0.5: 2.0, 0.75: 2.0, 0.76: 3.0, 1.0: 3.0}


def test_unit_rules(spark):
    rows = [(1, "a", 1.0), (1, "a", 3.0), (2, "a", 5.0), (2, "b", float("nan")), (3, None, None), (3, "z", float("inf")), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "u long, g string, x double")
    assert release.count_units(df, "u").first().n == 3
    cells = {r.u: r.g for r in collapse.consistent_cell(df, "u", {"g": ["a", "b"]}).collect()}
    assert cells == {1: "a"}  # unit 2 conflicts, unit 3 has no valid row
    m = release.mean_var(release.moments(df, "u", {"x": (0.0, 4.0)})).first()
    assert (m.n, m["mean"], m.variance) == (2, 3.0, 1.0)
    assert release.mean_var(release.moments(df.limit(0), "u", {"x": (0.0, 4.0)})).first().status == "no_units"


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0001,), (3.0,), (3.1,)], "x double")
    assert [r[0] for r in df.select(collapse.right_closed(df.x, [1.0, 2.0, 3.0])).collect()] == [1, 1, 2, 3, None]


def test_survival_without_noise(spark):
    cells = {"censor": (0, 1, 0, 0), "A": (1, 0, 0, 1), "B": (0, 0, 1, 0)}
    hist = spark.createDataFrame([(i + 1, k, n) for k, v in cells.items() for i, n in enumerate(v)], "bin int, outcome string, n long")
    entry = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 0)], "bin int, n_entry long")
    plain = survival.curves(hist, [1.0, 2.0, 3.0, 4.0], ["A", "B"], "censor").orderBy("bin").collect()
    assert [r.at_risk for r in plain] == [4, 3, 2, 1]
    assert [r.survival for r in plain] == [pytest.approx(x) for x in (0.75, 0.75, 0.375, 0.0)]
    assert all(r.survival + r.cif_1 + r.cif_2 == pytest.approx(1) for r in plain)
    late = survival.curves(hist, [1.0, 2.0, 3.0, 4.0], ["A", "B"], "censor", entry).orderBy("bin").collect()
    assert [r.at_risk for r in late] == [2, 2, 2, 1]


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (4, "w")], "id long, p string")
    b = spark.createDataFrame([(2, 1.0), (4, 2.0), (5, 3.0), (None, 4.0)], "key long, q double")
    f = sites.align({"a": a, "b": b}, {"a": "id", "b": "key"})
    assert sites.is_aligned(f) and f.sites["a"].count() == 3 and f.sites["b"].count() == 2
    assert f.table(["p", "b$q"]).count() == 3
    with pytest.raises(ValueError):
        f.table(["id"])


def test_noise_is_sticky_and_bounded(spark):
    cells = spark.createDataFrame([(str(i), 50) for i in range(200)], "k string, n long")
    p = privacy.geometric_scale(1.0, 1.0)
    draw = lambda secret: [r.n for r in privacy.with_noise(cells, ["k"], "n", secret, {"a": 1}, p, 60).orderBy("k").collect()]
    first = draw("s")
    assert first == draw("s") != draw("t") and all(0 <= x <= 60 for x in first)
    assert abs(sum(first) / 200 - 50) < 1


def test_indirect_region_holds_every_box_table(spark):
    rows = [(4.0, 6.0, 0.2), (3.0, 9.0, 0.5)]
    r = tables.indirect_risk(spark.createDataFrame(rows, "events double, nonevents double, rate double"), 1).first()
    for cells in itertools.product(*[(x - 1, x, x + 1) for e, n, _ in rows for x in (e, n)]):
        o = cells[0] + cells[2]
        e = 0.2 * (cells[0] + cells[1]) + 0.5 * (cells[2] + cells[3])
        assert r.lower - 1e-9 <= o / e <= r.upper + 1e-9


def test_projection_of_infeasible_correlations(spark):
    pairs = spark.createDataFrame([("a", "b", 50, 0.9), ("a", "c", 50, 0.9), ("b", "c", 50, -0.9)], "x string, y string, n long, r double")
    got = {(r.x, r.y): r.projected for r in release.projected_correlations(pairs, ["a", "b", "c"]).collect()}
    m = np.array([[1, got["a", "b"], got["a", "c"]], [got["a", "b"], 1, got["b", "c"]], [got["a", "c"], got["b", "c"], 1]])
    assert np.linalg.eigvalsh(m)[0] > -1e-9 and 0 < got["a", "b"] < 0.9 and -0.9 < got["b", "c"] < 0
    (row,) = [r for r in release.correlation_intervals(pairs).collect() if (r.x, r.y) == ("b", "c")]
    assert row.lower < -0.9 < row.upper < 0


def test_alignment_of_missing_identifiers(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "id long, v string")
    b = spark.createDataFrame([(1, 0), (2, 1), (None, 2)], "id long, w int")
    omit = sites.align({"a": a, "b": b}, "id", ref_server="b")
    assert [r.v for r in omit.sites["a"].collect()] == ["p"]
    none = sites.align({"a": a, "b": b}, "id", na_action="none")
    assert sorted(r.v for r in none.sites["a"].collect()) == ["p", "q"] and sorted(r.w for r in none.sites["b"].collect()) == [0, 2]
    with pytest.raises(ValueError, match="missing identifiers"):
        sites.align({"a": a, "b": b}, "id", na_action="fail")


def test_fisher_of_extreme_tables(spark):
    none = spark.createDataFrame([(0, 10, 5, 5)], "a int, b int, c int, d int")
    got = tables.fisher_test(none)
    assert got["odds_ratio"] == 0 and got["lower"] == 0 and 0 < got["upper"] < 1.1 and abs(got["p_value"] - 0.0325077399) < 1e-9
    with pytest.raises(ValueError):
        tables.fisher_test(none, "both")


def test_quantise_keeps_missing_missing(spark):
    df = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (9.0,), (-3.0,)], "x double")
    assert [r[0] for r in df.select(collapse.quantise(F.col("x"), 0.0, 5.0, 8)).collect()] == [0, None, None, 255, 0]
