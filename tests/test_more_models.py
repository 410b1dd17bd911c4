"""Wide, exact and penalised regression, imputation, hash trees, guards and layouts against numpy and plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.linear import NotIdentifiable
from cohortspark.models import clustered, glm, imputation, lasso, link, wide
from cohortspark.operators import guards, layout, tables
from cohortspark.sources import hash_tree as trees
from cohortspark.sources import sites

# ------------------------------------------------------------------ wide


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((300, 12)) < 0.3, rng.normal(size=(300, 12)), 0.0)
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0] + x[:, 1]))).astype(float)
    long = [(i, j, float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    long = spark.createDataFrame([(int(i), int(j), v) for i, j, v in long], "r long, f int, v double")
    return long, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "r long, y double"), x, y


@pytest.mark.parametrize("family", ["binomial", "gaussian", "poisson"])
def test_wide_fit_has_no_gradient_left(sparse, family):
    long, labels, x, y = sparse
    rows = wide.gathered(long, labels, "r", "f", "v", "y")
    assert rows.count() == 300
    beta, facts = wide.fit_wide(rows, 12, family, 0.05)
    eta = x @ beta
    mu = {"binomial": 1 / (1 + np.exp(-eta)), "gaussian": eta, "poisson": np.exp(eta)}[family]
    assert np.abs(x.T @ (mu - y) / 300 + 0.05 * beta).max() < 1e-8
    assert facts["n"] == 300


def test_directions_are_those_of_the_dense_update():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    a = a @ a.T + np.eye(5)
    steps, changes = [], []
    h = None
    for _ in range(4):
        s = rng.normal(size=5)
        d = a @ s
        steps.append(s)
        changes.append(d)
    scale = (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    h = scale * np.eye(5)
    for s, d in zip(steps, changes, strict=True):
        r = np.eye(5) - np.outer(s, d) / (s @ d)
        h = r @ h @ r.T + np.outer(s, s) / (s @ d)
    slope = rng.normal(size=5)
    np.testing.assert_allclose(wide.direction(slope, steps, changes), -h @ slope, rtol=1e-9)


def test_wide_limits(sparse, monkeypatch):
    long, labels, *_ = sparse
    rows = wide.gathered(long, labels, "r", "f", "v", "y")
    monkeypatch.setattr(wide, "MAX_FEATURES", 10)
    with pytest.raises(ValueError, match="hash"):
        wide.fit_wide(rows, 12)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no rows"):
        wide.fit_wide(rows.limit(0), 12)


# ------------------------------------------------------------------ tables of knots, exact numbers


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_table_of_knots_is_as_near_as_it_says(spark, family):
    df = spark.range(2001).select(((F.col("id") - 1000) / 250.0).alias("eta"))
    got = link.link_errors(df, "eta", family, 4.0, 32).collect()
    assert sum(r.n for r in got) == 2001 and len(got) == 32
    assert 0 < max(r.largest_error for r in got) <= link.error_bound(family, 4.0, 32) + 1e-12
    out = link.approximated(spark.createDataFrame([(9.0,), (-9.0,), (None,), (4.0,)], "eta double"), "eta", family, 4.0, 32).collect()
    by = {r.eta: r for r in out}
    end = 1 / (1 + math.exp(-4)) if family == "binomial" else math.exp(4)
    assert by[9.0].mean == pytest.approx(end) and by[9.0].outside and not by[4.0].outside
    assert by[None].mean is None and by[None].segment is None


def test_exact_fit_has_the_same_bits_at_any_number_of_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()), int(rng.random() < 0.4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, y int")
    fits = [link.fit_exact(df.repartition(n), "y", ["x"], iterations=5) for n in (1, 64)]
    assert fits[0] == fits[1]
    knots, beta = link.knot_units("binomial", 8, 64), [0, 0]
    x = [(10**6, round(v * 10**6)) for v, _ in rows]
    for _ in range(5):
        s = [0, 0]
        for (a, b), (_, y) in zip(x, rows, strict=True):
            e = min(max(a * beta[0] + b * beta[1] + 8 * 10**14, 0), 16 * 10**14) // 10**5
            k = min(e // 250_000_000, 63)
            r = knots[k] + (knots[k + 1] - knots[k]) * (e - k * 250_000_000) // 250_000_000 - y * 10**9
            s = [s[0] + a * r, s[1] + b * r]
        for i in range(2):
            beta[i] = min(max(beta[i] - (s[i] * 10**8 // (500 * 10**15) + beta[i] // 1000), -(10**9)), 10**9)
    assert fits[0].units == tuple(beta)


def test_exact_fit_stays_in_its_box_and_nears_the_optimum(spark):
    rng = np.random.default_rng(4)
    rows = [(v := float(rng.normal()), int(rng.random() < 1 / (1 + math.exp(-v)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y int")
    assert abs(link.fit_exact(df, "y", ["x"], iterations=30, rate=(20, 1), box=0.1).coefficients[1]) == 0.1
    near = glm.fit_glm(df, "y", ["x"], "binomial", lambda_=0.001).coefficients
    np.testing.assert_allclose(link.fit_exact(df, "y", ["x"], iterations=60, rate=(4, 1), segments=256).coefficients, near, atol=2e-3)
    with pytest.raises(ValueError):
        link.fit_exact(df.limit(0), "y", ["x"])
    with pytest.raises(ValueError, match="1,000"):
        link.fit_exact(df.withColumn("x", F.col("x") * 1e5), "y", ["x"])


# ------------------------------------------------------------------ penalised


@pytest.mark.parametrize("family", ["poisson", "binomial", "gaussian"])
def test_proximal_newton_is_optimal(spark, family):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    eta = 0.3 + 0.8 * x[:, 0] - 0.4 * x[:, 1]
    y = {"poisson": rng.poisson(np.exp(eta)), "binomial": rng.random(400) < 1 / (1 + np.exp(-eta)), "gaussian": eta + rng.normal(size=400)}[family].astype(float)
    df = spark.createDataFrame([(float(v), *map(float, r)) for v, r in zip(y, x, strict=True)], "y double, a double, b double, c double, d double")
    beta = lasso.fit_glm_newton(df, "y", ["a", "b", "c", "d"], family, 0.1)
    full = np.column_stack([np.ones(400), x])
    mu = {"poisson": np.exp, "binomial": lambda e: 1 / (1 + np.exp(-e)), "gaussian": lambda e: e}[family](full @ beta)
    slope = full.T @ (y - mu) / 400
    assert abs(slope[0]) < 1e-7
    for s, b in zip(slope[1:], beta[1:], strict=True):
        assert abs(s - 0.1 * math.copysign(1, b)) < 1e-7 if b else abs(s) <= 0.1 + 1e-7
    assert (beta[1:] == 0).any()


# ------------------------------------------------------------------ imputation


def uniform_of(unit, imputation, *key):
    word = "|".join(map(str, (unit, imputation, *key)))
    return (int(hashlib.sha256(word.encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def test_chained_imputation_is_that_of_numpy(spark):
    rng = np.random.default_rng(9)
    n, m, rounds = 120, 3, 2
    a = rng.normal(size=n)
    b = (rng.random(n) < 1 / (1 + np.exp(-a))).astype(float)
    y = 1 + a - b + rng.normal(size=n)
    rows = [(i, float(y[i]), None if i % 4 == 1 else float(a[i]), None if i % 5 == 2 else float(b[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "u long, y double, a double, b double")
    mean, total, share = imputation.fit_mi_chained(df, "u", "y", ["a", "b"], {"a": "gaussian", "b": "binomial"}, m, rounds, seed=7)
    assert share == {"a": pytest.approx(30 / n), "b": pytest.approx(24 / n)}
    no_a, no_b = np.array([r[2] is None for r in rows]), np.array([r[3] is None for r in rows])
    estimates, covariances = [], []
    for i in range(m):
        fa, fb = np.where(no_a, a[~no_a].mean(), a), b.copy()
        rate = b[~no_b].mean()
        for k in np.flatnonzero(no_b):
            fb[k] = float(uniform_of(k, i, 7, "start", "b") < rate)
        for r in range(rounds):
            x = np.column_stack([np.ones(n), fb, y])
            own = x[~no_a]
            beta = np.linalg.solve(own.T @ own, own.T @ a[~no_a])
            s2 = ((a[~no_a] - own @ beta) ** 2).sum() / (len(own) - 3)
            drawn = imputation.draws_of(beta[None], (s2 * np.linalg.inv(own.T @ own))[None], 7, r, 0)[0] if i == 0 else beta + np.linalg.cholesky(s2 * np.linalg.inv(own.T @ own)) @ np.random.default_rng([7, i, r, 0]).standard_normal(3)
            for k in np.flatnonzero(no_a):
                z = math.sqrt(-2 * math.log(uniform_of(k, i, 7, r, "a", "radius"))) * math.cos(2 * math.pi * uniform_of(k, i, 7, r, "a", "angle"))
                fa[k] = x[k] @ drawn + math.sqrt(s2) * z
            x = np.column_stack([np.ones(n), fa, y])
            own, beta = x[~no_b], np.zeros(3)
            for _ in range(40):
                mu = 1 / (1 + np.exp(-own @ beta))
                h = (own * (mu * (1 - mu))[:, None]).T @ own
                beta = beta + np.linalg.solve(h, own.T @ (b[~no_b] - mu))
            drawn = beta + np.linalg.cholesky(np.linalg.inv(h)) @ np.random.default_rng([7, i, r, 1]).standard_normal(3)
            for k in np.flatnonzero(no_b):
                fb[k] = float(uniform_of(k, i, 7, r, "b") < 1 / (1 + math.exp(-x[k] @ drawn)))
        x = np.column_stack([np.ones(n), fa, fb])
        beta = np.linalg.solve(x.T @ x, x.T @ y)
        estimates.append(beta)
        covariances.append(((y - x @ beta) ** 2).sum() / (n - 3) * np.linalg.inv(x.T @ x))
    want, spread = clustered.rubin(estimates, covariances)
    np.testing.assert_allclose(mean, want, rtol=1e-6)
    np.testing.assert_allclose(total, spread, rtol=1e-5)


def test_imputed_columns_do_not_depend_on_partitions_and_keep_what_is_there(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v), None if i % 3 == 0 else float(v + rng.normal())) for i, v in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "u long, y double, a double")
    got = []
    for n in (1, 7):
        whole, partial, _ = imputation.impute_chained(df.repartition(n), "u", {"a": "gaussian"}, ["y"], 2, 2)
        assert whole.count() == 60 and partial.count() == 60
        got.append({(r.u, r[imputation.IMP]): r.a for r in partial.collect()})
    assert got[0].keys() == got[1].keys()
    assert all(got[0][k] == pytest.approx(got[1][k], rel=1e-9) for k in got[0])
    with pytest.raises(NotIdentifiable):
        imputation.impute_chained(df.withColumn("a", F.lit(None).cast("double")), "u", {"a": "gaussian"}, ["y"])


# ------------------------------------------------------------------ hash trees


def test_sites_find_the_ranges_in_which_they_differ(spark):
    rng = np.random.default_rng(5)
    a = [int(i) for i in rng.integers(-300, 5000, 900)] + [None]
    b = [i for i in a if i != a[3]] + [4999, 70000]
    one, two = (spark.createDataFrame([(i,) for i in ids], "id long").repartition(n) for ids, n in ((a, 3), (b, 5)))
    left, right = set(a) - {None}, set(b) - {None}
    got = {tuple(r) for r in trees.manifest_difference(one, two, "id", width=8, fanout=4).collect()}
    want = {(k * 8, k * 8 + 7, sum(i // 8 == k for i in left), sum(i // 8 == k for i in right)) for k in {i // 8 for i in left ^ right}}
    assert got == want
    assert {tuple(r) for r in trees.differing_ids(one, two, "id", 8, 4).collect()} == {(i, "left") for i in left - right} | {(i, "right") for i in right - left}
    assert trees.manifest_difference(one, one.repartition(2).union(one), "id", 8, 4).count() == 0
    assert trees.manifest_difference(one.limit(0), one.limit(0), "id").count() == 0
    assert trees.manifest_difference(one.limit(0), spark.createDataFrame([(9,)], "id long"), "id").collect()[0][2:] == (0, 1)


def test_a_tree_is_that_of_hashlib(spark):
    ids = [5, 1, 1, 40, 17, None]
    got = {(r.level, r.node): (r.n_ids, r.hash) for r in trees.hash_tree(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 1, 16, 16).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = {0: "1,5", 1: "17", 2: "40"}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == 0} == {k: sha(v) for k, v in leaves.items()}
    assert got[1, 0] == (4, sha(",".join(f"{k}:{sha(v)}" for k, v in leaves.items())))


# ------------------------------------------------------------------ guards, layouts, margins


def test_a_release_with_a_small_margin_raises_when_it_is_read(spark):
    table = lambda rows: spark.createDataFrame(rows, "row string, col string, n long")
    fine = [("a", "x", 9), ("a", "y", 0), ("b", "x", 5), ("b", "y", 7)]
    assert sorted(map(tuple, guards.guarded_table(table(fine)).collect())) == fine
    for bad in ([("a", "x", 4), ("a", "y", 9)], [("a", "x", None), ("a", "y", 9)], [("a", "x", -6), ("a", "y", 90)]):
        with pytest.raises(Exception, match="not released"):
            guards.guarded_table(table(bad)).agg(F.sum("n")).collect()
    assert guards.guarded_table(table([])).count() == 0
    one = lambda n: spark.createDataFrame([(n, 2.0)], "n long, g double")
    assert guards.guarded_matrix(one(50), 10).first().n == 50
    for n, p in ((49, 10), (4, 1), (None, 1)):
        with pytest.raises(Exception, match="not released"):
            guards.guarded_matrix(one(n), p).collect()


def test_a_vector_has_every_cell_and_one_shuffle(spark, capsys):
    rows = [(1, "a", "x"), (2, "a", None), (3, "b", "y"), (3, "a", "y"), (4, "zzz", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "u long, p string, q string")
    levels = {"q": ["x", "y"], "p": ["a", "b", "c"]}
    got = {(r.table, r.levels): r.n for r in layout.release_vector(df, levels).collect()}
    assert [t[0] for t in layout.layout(levels)] == ["p", "q", "p::q"]
    assert got == {
        ("p", "a"): 4, ("p", "b"): 1, ("p", "c"): 0, ("q", "x"): 3, ("q", "y"): 2,
        ("p::q", "a::x"): 2, ("p::q", "a::y"): 1, ("p::q", "b::x"): 0, ("p::q", "b::y"): 1, ("p::q", "c::x"): 0, ("p::q", "c::y"): 0,
    }
    by_unit = layout.release_vector(df, levels, "u")
    assert {r.levels: r.n for r in by_unit.where("table = 'p'").collect()} == {"a": 3, "b": 0, "c": 0}
    assert sorted(r.coordinate for r in by_unit.collect()) == list(range(11))
    layout.release_vector(df, levels).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Expand") == 1


def test_margins_stay_fixed_and_the_p_value_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows, cols = np.array([60, 50, 90]), np.array([40, 40, 50, 30, 40])
    x = tables.fixed_margins(rng, rows, cols, 4000)
    assert (x >= 0).all() and (x.sum(2) == rows).all() and (x.sum(1) == cols).all()
    np.testing.assert_allclose(x.mean(0), np.outer(rows, cols) / 200, atol=0.3)
    # the law of one cell is hypergeometric
    assert x[:, 0, 0].var() == pytest.approx(60 * 0.2 * 0.8 * 140 / 199, rel=0.1)
    seen = x[7]
    table = spark.createDataFrame([(f"r{i}", f"c{j}", int(seen[i, j])) for i in range(3) for j in range(5)], "row string, col string, n long")
    got = [tables.bootstrap_test(table.repartition(n), simulations=1200, fisher=True) for n in (1, 6)]
    expected = np.outer(rows, cols) / 200
    chi = lambda t: ((t - expected) ** 2 / expected).sum(axis=(-2, -1))
    hits = sum(int((chi(tables.fixed_margins(np.random.default_rng((1, b)), rows, cols, min(500, 1200 - 500 * b))) >= chi(seen) - 1e-12).sum()) for b in range(3))
    assert got[0] == got[1] and got[0]["exceedances"] == hits
    assert got[0]["p_value"] == pytest.approx((hits + 1) / 1201)


def test_quantiles_with_mass_outside_the_grid(spark):
    hist = [("v", -1, None, 2, 0.0), ("v", 1, 10.0, 4, 0.0), ("v", 2, 20.0, 2, 0.0), ("v", 3, None, 2, 0.0), ("v", 0, None, 50, 0.0)]
    df = spark.createDataFrame(hist, "variable string, bin int, upper double, n long, lower double")
    got = {r.prob: r.value for r in tables.interpolated_quantiles(df, [0.1, 0.2, 0.4, 0.7, 0.95]).collect()}
    assert got == {0.1: 0.0, 0.2: 0.0, 0.4: 5.0, 0.7: 15.0, 0.95: 20.0}


def test_no_variance_no_correlation(spark):
    row = spark.createDataFrame([(10, 10.0, 5.0, 2.5, 4.0, 2.0, 2.0)], "n long, g_0_0 double, g_0_1 double, g_1_1 double, c_0 double, c_1 double, yy double").first()
    with pytest.raises(NotIdentifiable, match="a"):
        glm.correlation_from_gram(row, ["a", "b"])
    with pytest.raises(ValueError):
        glm.pca(np.eye(2), ["a", "b"], 3)


def test_public_reads_its_source_once(spark, monkeypatch):
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (reads.add(1), x)[1], "long")
    df = spark.range(5).select(seen("id").alias("id"))
    assert sorted(r.id for r in tables.public(df).collect()) == list(range(5))
    assert reads.value == 5
    monkeypatch.setattr(tables, "MAX_PUBLIC", 3)
    with pytest.raises(ValueError):
        tables.public(spark.range(5).toDF("id"))




def test_scores_of_named_levels_and_kinds_of_columns(spark):
    counts = spark.createDataFrame([("high", 6, 1), ("low", 1, 5)], "bin string, cases long, controls long")
    got = tables.roc(counts, score_order=["low", "mid", "high"]).orderBy("threshold").collect()
    assert [(r.threshold, round(r.sensitivity, 6), round(r.specificity, 6)) for r in got] == [(0, 0.0, 1.0), (1, round(6 / 7, 6), round(5 / 6, 6)), (2, round(6 / 7, 6), round(5 / 6, 6)), (3, 1.0, 0.0)]
    assert tables.auc(counts, score_order=["low", "mid", "high"]).first().auc == pytest.approx((6 * 5 + 0.5 * (6 * 1 + 1 * 5)) / 42)
    for order in (["low"], ["low", "low", "high"], []):
        if order:
            with pytest.raises(ValueError):
                tables.roc(counts, score_order=order)
    one = spark.createDataFrame([(1, 2.0, "a")], "id long, x double, c string")
    f = sites.Federation({"s": one, "t": one.select("id")}, {"s": "id", "t": "id"})
    assert f.owner("x", "numeric") == ("s", "x") and f.owner("c", "categorical") == ("s", "c") and f.owner("s$x") == ("s", "x")
    for name, kind in (("x", "categorical"), ("c", "numeric"), ("x", "other"), ("id", None)):
        with pytest.raises(ValueError):
            f.owner(name, kind)


def test_wide_fit_beyond_a_million_columns(spark):
    """Two million columns, three of them met; equal rows count as one with a weight, in the gradient too."""
    at, top = [0, 1_500_000, 1_999_999], 2_000_000
    rows = [(float(i % 3 == 0), [0, at[1 + i % 2]], [1.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "y double, features array<int>, values array<double>")
    beta, facts = wide.fit_wide(df, top, "binomial", 0.05, tol=1e-10)
    assert facts["n"] == 60 and facts["gradient"] <= 1e-10 and np.flatnonzero(beta).tolist() == at
    x = np.array([[1.0, float(i % 2 == 0), float(i % 2 == 1)] for i in range(60)])
    mu = 1 / (1 + np.exp(-x @ beta[at]))
    assert np.abs(x.T @ (mu - np.array([r[0] for r in rows])) / 60 + 0.05 * beta[at]).max() < 1e-9


def test_fits_read_equal_rows_once(spark, monkeypatch):
    """Twenty copies of each row: what the passes read are the distinct rows with their number."""
    from cohortspark.models import clustered, mixed

    rng = np.random.default_rng(8)
    some = {(i % 6, float(rng.random() < 0.4 + 0.05 * (i % 6)), float(i % 5)) for i in range(120)}
    df = spark.createDataFrame(sorted(some) * 20, "g int, y double, x double")
    seen = []
    for module in (link, mixed, clustered):
        monkeypatch.setattr(module, "held", lambda d, old=module.held: (seen.append(d.count()) if "copies_" in d.columns else None, old(d))[1])
    link.fit_exact(df, "y", ["x"], iterations=2)
    one, _ = mixed.fit_glmm_laplace(df, "g", "y", ["x"], max_outer=1)
    two, _ = clustered.fit_glmm(df, "g", "y", ["x"], max_outer=1)
    assert seen == [len({r[1:] for r in some}), len(some), len(some)]
    assert one.n == two.n == 20 * len(some)
