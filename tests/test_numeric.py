"""Distribution tails, variance components, scans: against independent formulas."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.functions import dist as D
from locusloom.functions import reml as R
from locusloom.operators import kinship as K
from locusloom.operators import scan as S
from locusloom.operators import simulate, stepwise, traits, variance
from locusloom.panel import Panel, build_panel


def test_tail_identities():
    x = np.array([0.1, 1.0, 5.0, 40.0, 300.0])
    assert np.allclose(D.chi2_sf(x, 2), np.exp(-x / 2), rtol=1e-12)
    assert np.allclose(D.chi2_sf(x, 1), D.gammaincc(0.5, x / 2), rtol=1e-10)
    assert np.allclose(D.f_sf(x, 2, 10), (1 + 2 * x / 10) ** -5.0, rtol=1e-12)
    assert np.allclose(D.t_sf2(np.sqrt(x), 7), D.f_sf(x, 1, 7))
    assert np.allclose(D.f_sf(x, 3, 9), 1 - D.betainc(1.5, 4.5, 3 * x / (3 * x + 9)), atol=1e-12)
    assert D.f_sf(0, 1, 5) == 1 and math.isnan(D.f_sf(float("nan"), 1, 5)) and 0 < D.f_sf(1e4, 1, 100) < 1e-100
    assert D.t_sf2(12.706204736432095, 1) == pytest.approx(0.05, rel=1e-10)


@settings(max_examples=100, deadline=None)
@given(st.floats(0.2, 80), st.floats(0.2, 80), st.floats(0.01, 0.99))
def test_beta_symmetry(a, b, x):
    v = float(D.betainc(a, b, x))
    assert 0 <= v <= 1 and v == pytest.approx(1 - float(D.betainc(b, a, 1 - x)), abs=1e-9)


def test_shapiro_wilk():
    w, p = D.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)
    assert D.shapiro_wilk(np.random.default_rng(1).normal(size=300))[1] > 0.01
    assert D.shapiro_wilk(np.random.default_rng(1).exponential(size=300))[1] < 1e-6
    assert math.isnan(D.shapiro_wilk([1, 1, 1])[0]) and math.isnan(D.shapiro_wilk([1, 2])[1])
    assert D.kolmogorov_sf(0.0, 10) == 1 and D.kolmogorov_sf(0.9, 50) < 1e-6


def model(n=60, m=300, seed=0):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 2, (m, n)).astype(float)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
    k = R.scale_k(z.T @ z / m)
    u = np.linalg.cholesky(k + 1e-6 * np.eye(n)) @ rng.normal(size=n)
    return g, k, u + 0.7 * rng.normal(size=n)


def test_reml_is_the_maximum():
    _, k, y = model()
    x = np.column_stack([np.ones(60), np.arange(60) % 2])
    f = R.fit(y, k, x)
    e = R.Eigen.within(k, x)
    eta2 = (e.vectors.T @ y) ** 2
    fine = R.reml_ll(np.exp(np.linspace(-10, 10, 2001)), e.values, eta2)
    assert f.ll >= fine.max() - 1e-9
    # the profile likelihood against the normal density of a basis orthogonal to x
    q, _ = np.linalg.qr(np.column_stack([x, np.eye(60)]))
    a = q[:, 2:60]
    v = f.vg * (a.T @ k @ a) + f.ve * np.eye(58)
    direct = -0.5 * (58 * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + (a.T @ y) @ np.linalg.solve(v, a.T @ y))
    assert f.ll == pytest.approx(direct, abs=1e-6)
    ml = R.fit(y, k, x, "ML")
    v = ml.vg * k + ml.ve * np.eye(60)
    r = y - x @ ml.beta
    assert ml.ll == pytest.approx(-0.5 * (60 * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r)), abs=1e-6)
    for d in (0.3, 2.0):
        h = 1e-5
        assert R.reml_slope(d, e.values, eta2) == pytest.approx((R.reml_ll(d + h, e.values, eta2) - R.reml_ll(d - h, e.values, eta2)) / (2 * h), rel=1e-4)
        lam = np.linalg.eigvalsh(k)
        assert R.ml_slope(d, e.values, lam, eta2) == pytest.approx((R.ml_ll(d + h, e.values, lam, eta2) - R.ml_ll(d - h, e.values, lam, eta2)) / (2 * h), rel=1e-4)


def test_whitening_blup_and_two_matrices():
    g, k, y = model()
    f = R.fit(y, k)
    assert np.allclose(f.whitener @ (k + f.delta * np.eye(60)) @ f.whitener.T, np.eye(60), atol=1e-8)
    u = R.blup(y, k, f.heritability)
    assert np.corrcoef(u, y)[0, 1] > 0.5 and not R.blup(y, k, 0).any()
    assert np.allclose(R.cholesky_upper(k + np.eye(60)).T @ R.cholesky_upper(k + np.eye(60)), k + np.eye(60))
    assert np.isfinite(R.cholesky_upper(k - 0.5 * np.eye(60))).all()
    other = R.scale_k(np.cov(np.random.default_rng(5).normal(size=(60, 200))))
    two = R.fit_two(y, k, other)
    assert two["ll"] >= f.ll - 0.05 and two["perc_var1"] + two["perc_var2"] + two["perc_error"] == pytest.approx(1)
    stat, p = R.likelihood_ratio(y, k)
    assert stat >= 0 and 0 <= p <= 1
    n = len(k)
    assert np.trace(k) - k.sum() / n == pytest.approx(n - 1)


def test_low_rank_form_equals_dense_form():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 2, (120, 50)).astype(float)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
    y = g[3] + rng.normal(size=50)
    total, local, m = z.T @ z, z[:7].T @ z[:7], 7
    model = R.LocalAndRest(y, R.Eigen.of(total / 120), total / 120, 120, R.LocalAndRest.root_of(local / m), m)
    k1, k2 = R.scale_k((total - local) / 113), R.scale_k(local / 7)
    for a, delta in ((1.0, 0.5), (0.4, 2.0), (0.05, 0.1)):
        v = a * k1 + (1 - a) * k2 + delta * np.eye(50)
        w = np.linalg.inv(v)
        x = np.ones(50)
        r = y - x * (x @ w @ y) / (x @ w @ x)
        s2 = r @ w @ r / 50
        direct = -0.5 * (50 * math.log(2 * math.pi * s2) + 50 + np.linalg.slogdet(v)[1])
        assert model.rank == 7 and model.ll(a, delta) == pytest.approx(direct, abs=1e-7)
    dense, low = variance.local_against_global(y, local / 7, (total - local) / 113), model.test()
    for c in dense:
        assert low[c] == pytest.approx(dense[c], abs=2e-3)


def rss(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ b) ** 2).sum())


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    n, m = 40, 30
    g = rng.integers(0, 3, (m, n))
    g[0], g[1] = 1, np.arange(n) % 2
    calls = g.tolist()
    calls[2][5] = None
    y = g[4] * 0.8 + rng.normal(size=n)
    p = build_panel(spark, [(1 + i // 15, 1000 * (i % 15 + 1)) for i in range(m)], calls, [f"i{k}" for k in range(n)], "diploid_int")
    full = np.array([[np.nan if v is None else v for v in c] for c in calls], float)
    full = np.where(np.isnan(full), np.nanmean(full, axis=1, keepdims=True), full)
    return Panel(p.markers.repartition(3), p.ids, p.data_format), full, y


def test_scan_equals_least_squares(case):
    p, g, y = case
    x = np.column_stack([np.ones(40), np.linspace(0, 1, 40)])
    for w in (None, R.fit(y, R.scale_k(np.cov(g.T)), x).whitener):
        null = S.Null(y, x, w)
        wy, wx = (y, x) if w is None else (w @ y, w @ x)
        base = rss(wx, wy)
        assert null.rss0 == pytest.approx(base)
        for r in S.f_scan(p, null).collect():
            v = g[r.marker_id] if w is None else w @ g[r.marker_id]
            if r.marker_id == 0 and w is None:
                assert (r.f_stat, r.p_value) == (0, 1) and r.rss == pytest.approx(base)
                continue
            if r.marker_id == 0:
                continue
            one = rss(np.column_stack([wx, v]), wy)
            assert r.rss == pytest.approx(one) and r.f_stat == pytest.approx((base / one - 1) * 37)
            assert r.beta == pytest.approx(np.linalg.lstsq(np.column_stack([wx, v]), wy, rcond=None)[0][-1])


def test_anova_gxe_and_interactions(case):
    p, g, y = case
    for r in S.anova_scan(p, S.Null(y)).collect():
        v = np.rint(g[r.marker_id])
        classes = np.unique(v)
        full = rss(np.stack([v == c for c in classes], 1).astype(float), y)
        assert r.n_classes == len(classes) and r.rss == pytest.approx(full)
    e = np.arange(40) // 20
    x = np.column_stack([np.ones(40), e])
    for r in S.gxe_scan(p, S.Null(y, x), e).collect():
        v = g[r.marker_id]
        if r.marker_id == 0:
            continue
        one, two = rss(np.column_stack([x, v]), y), rss(np.column_stack([x, v, v * e]), y)
        assert r.rss_g == pytest.approx(one) and r.rss_joint == pytest.approx(two)
        assert r.f_joint == pytest.approx((rss(x, y) / two - 1) * 36 / 2) and r.f_gxe == pytest.approx((one / two - 1) * 37)
    cof = g[6]
    for r in S.interaction_scan(p, S.Null(y, np.column_stack([np.ones(40), cof])), cof, 5).collect():
        if r.marker_id in (0, 6):
            continue
        v = g[r.marker_id]
        cols = [np.ones(40), cof, v] + ([v * cof] if v.sum() > 5 and (v * cof).sum() > 5 else [])
        assert r.rss == pytest.approx(rss(np.column_stack(cols), y))


def test_replicates_permutations_and_exact(case, spark):
    p, g, y = case
    rows = list(range(40)) + [3, 3, 7]
    y2 = np.r_[y, y[3] + 0.1, y[3] - 0.2, y[7]]
    for r in S.f_scan(p, S.Null(y2, rows=rows)).filter("marker_id = 4").collect():
        assert r.rss == pytest.approx(rss(np.column_stack([np.ones(43), g[4][rows]]), y2))
    k = np.cov(g.T)
    a, fit = S.emmax(p, y, k, exact=5)
    b = S.emma(p, y, k)
    exact = {r.marker_id: r for r in b.collect()}
    top = a.orderBy("p_value").limit(1).first()
    assert top.marker_id == 4 and top.p_value == pytest.approx(exact[4].p_value) and 0 <= fit.heritability <= 1
    one = S.permutation_scan(p, S.Null(y), 40, seed=1).orderBy("perm").collect()
    two = S.permutation_scan(Panel(p.markers.repartition(5), p.ids, p.data_format), S.Null(y), 40, seed=1).orderBy("perm").collect()
    assert [(r.perm, round(r.min_p, 9)) for r in one] == [(r.perm, round(r.min_p, 9)) for r in two] and len(one) == 40
    t = S.permutation_threshold(S.permutation_scan(p, S.Null(y), 40, seed=1))
    assert t[0] == sorted(r.min_p for r in one)[2]


def test_single_tests():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(30), rng.normal(size=(30, 2))])
    y = x @ [1, 2, 0] + rng.normal(size=30)
    f, p = S.general_f_test(y, x, [[0, 0, 1]], [0])
    f2, p2 = S.test_covariate(y, x[:, :2], x[:, 2])
    assert f == pytest.approx(f2) and p == pytest.approx(p2)


def test_pair_scan(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 2, (9, 50))
    g[8] = g[0]
    y = g[1] * g[2] + 0.3 * rng.normal(size=50)
    p = build_panel(spark, [(1, k + 1) for k in range(9)], g.tolist(), [str(k) for k in range(50)])
    rows = {(r.marker1, r.marker2): r for r in S.pair_scan(p, y, block=4).collect()}
    assert len(rows) == 45 and rows[3, 3].f_single == rows[3, 3].f_additive
    assert (rows[1, 2].n11, rows[1, 2].n01) == (int((g[1] * g[2]).sum()), int(((1 - g[1]) * g[2]).sum()))
    r = rows[1, 2]
    cols = [np.ones(50), g[1], g[2], g[1] * g[2]]
    assert r.n_haplotypes == 4 and r.rss_full == pytest.approx(rss(np.column_stack(cols), y)) and r.rss_additive == pytest.approx(rss(np.column_stack(cols[:3]), y))
    assert rows[0, 8].n_haplotypes == 2 and rows[0, 8].p_additive == 1
    with pytest.raises(ValueError):
        S.pair_scan(p, y, max_markers=5)


def test_kinship_forms(spark, case):
    p, g, y = case
    full = p.with_markers(p.markers.filter("marker_id <> 2"))
    h = np.delete(g, 2, 0)
    direct = np.array([[np.mean(1 - np.abs(h[:, i] - h[:, j]) / 2) for j in range(40)] for i in range(40)])
    assert np.allclose(K.ibs_kinship(full, scaled=False), direct)
    z = h[h.std(1) > 0]
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    ibd = K.ibd_kinship(full, scaled=False)
    assert np.allclose(ibd, z.T @ z / len(z)) and np.linalg.eigvalsh(ibd).min() > -1e-9
    assert np.allclose(K.marker_covariance(full), z.T @ z / len(z) - np.outer(z.mean(0), z.mean(0)))
    parts = K.chromosome_kinships(full, scaled=False)
    m1 = int((full.markers.filter("chrom = 1").count()) - 1)  # one constant marker
    assert np.allclose(K.downdate(ibd, len(z), parts[1][0], m1), parts[1][1])
    local, rest, a, b = K.local_and_rest(full, K.window_condition(1, 5000, 2000), scaled=False)
    assert a + b == len(z) and np.allclose((local * a + rest * b) / (a + b), ibd)
    assert np.allclose(K.from_table(K.to_table(spark, ibd), 40), ibd)
    assert K.reorder(ibd, full.ids, ["i3", "nobody", "i1", "i3"]).shape == (3, 3)
    assert K.prune_related(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1.0]]), 0.8) == [1, 2]
    assert np.allclose(K.downdate_monomorphic(np.ones((2, 2)), 10, 4), 1)


def test_kinship_files_and_tree(spark, tmp_path):
    k = np.array([[2.0, 1.5, 0.1], [1.5, 2.0, 0.2], [0.1, 0.2, 2.0]])
    K.save_kinship(spark, str(tmp_path / "k"), k, ["a", "b", "c"], 7)
    back, ids, m = K.load_kinship(spark, str(tmp_path / "k"), ["c", "a"], scaled=False)
    assert ids == ["c", "a"] and m == 7 and back[0, 1] == 0.1
    K.save_kinship_text(spark, str(tmp_path / "t"), k, ["a", "b", "c"])
    assert spark.read.text(str(tmp_path / "t")).first().value == "a,2.0,1.5,0.1"
    merges = K.upgma(k)
    assert merges[0][:2] == (0, 1) and merges[1][3] == 3 and merges[1][2] == pytest.approx((1.9 + 1.8) / 2)


def test_stepwise_recovers_planted_loci(spark):
    p = simulate.genotypes(spark, 150, 200, seed=4)
    rows = {(r.chrom, r.pos): np.array(r.calls, float) for r in p.markers.collect()}
    loci = [(1, 3000), (4, 7000)]
    rng = np.random.default_rng(0)
    y = 1.5 * rows[loci[0]] - 1.2 * rows[loci[1]] + 0.7 * rng.normal(size=150)
    for s in (stepwise.stepwise_linear(p, y, 3), stepwise.multi_locus_mixed_model(p, y, K.ibs_kinship(p), 3)):
        assert set(s.choose("ebic").cofactors) == set(loci)
        assert set(s.choose("mbonf").cofactors) >= set(loci) and s.choose("bonf").action in ("add", "start")
        assert s.table().count() == len(s.steps) and {x.action for x in s.steps} == {"start", "add", "remove"}
        assert s.final_scan(s.steps[2]).filter("chrom = 1 and pos = 3000").count() == 0
        s.done()
    lin = stepwise.stepwise_linear(p, y, 2)
    x = np.column_stack([np.ones(150), *[rows[c] for c in lin.steps[2].cofactors]])
    assert lin.steps[2].rss == pytest.approx(rss(x, y))
    step, table = stepwise.single_step(p, y, [loci[0]])
    assert step.min_locus == loci[1] and table.count() > 100


def test_variance_operators(spark):
    p = simulate.genotypes(spark, 60, 120, n_chroms=3, seed=1)
    t = simulate.traits(p, 1, 0.9, 20, seed=2)
    k = K.ibd_kinship(p)
    h = {r.phen_id: r for r in variance.trait_heritability(t, k, p.ids).collect()}
    assert set(h) == {1, 2} and all(0 <= r.heritability <= 1 for r in h.values())
    b = variance.trait_blups(t, k, p.ids).filter("phen_id = 1").collect()
    assert len(b) == 60
    y = np.array([r.value for r in sorted(t.filter("phen_id = 1").collect(), key=lambda r: int(r.indiv_id))])
    cv = variance.cross_validated_blup(spark, y, k, 4, 2)
    assert cv.filter("repeat = 0").count() == 60 and variance.prediction_accuracy(cv).count() == 2
    c = {r.chrom: r for r in variance.chromosome_scan(p, y).collect()}
    assert set(c) == {1, 2, 3} and all(0 <= r.p_value <= 1 for r in c.values())
    w = variance.window_scan(p, y, 5000, 20_000).collect()
    assert {(r.chrom, r.centre) for r in w} == {(ch, 1000 + 20_000 * i) for ch in (1, 2, 3) for i in (0, 1)}
    genes = spark.createDataFrame([("g", 1, 5000, 9000), ("far", 9, 1, 2)], "gene_id string, chrom int, start_pos long, end_pos long")
    assert [r.gene_id for r in variance.gene_scan(p, y, genes, 3000).collect()] == ["g"]
    pairs = variance.relatedness_pairs(t, 1, k, p.ids)
    assert pairs.count() == 60 * 59 // 2 and variance.relatedness_fit(pairs).first().n_pairs == 1770


def test_transforms(spark):
    rng = np.random.default_rng(0)
    rows = [(1, "skewed", str(i), float(math.exp(x))) for i, x in enumerate(rng.normal(size=80))] + [(2, "share", str(i), float(x)) for i, x in enumerate(rng.uniform(size=80))] + [(3, "flat", str(i), 1.0) for i in range(5)]
    t = traits.phenotypes(spark, rows)
    best = {r.phen_id: r.transformation for r in traits.transform(t, "most_normal").select("phen_id", "transformation").distinct().collect()}
    assert best[1] == "log" and best[3] is None
    bc = {r.phen_id: r.transformation for r in traits.transform(t, "box_cox").select("phen_id", "transformation").distinct().collect()}
    assert bc[1].startswith("box_cox(") and abs(float(bc[1][8:-1])) <= 0.3
    a = traits.transform(t, "arcsin_sqrt")
    assert {r.phen_id for r in a.filter("transformation = 'arcsin_sqrt'").collect()} == {2, 3}
    back = traits.revert(traits.transform(t, "log"))
    assert back.filter("abs(value - raw_value) > 1e-12").count() == 0
    assert {r.phen_id for r in traits.drop_near_constant(t).collect()} == {1, 2}
    assert traits.incidence(t, 2).count() == 80 and traits.drop_outliers(t, 1.5).count() < 165
    with pytest.raises(ValueError):
        traits.transform(t, "cube")
