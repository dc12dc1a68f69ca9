"""Own operators against brute force, worked examples, and odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayflow.functions.numerics import chi2_sf, e_value, kolmogorov_sf
from stayflow.functions.prefix import running
from stayflow.operators import allocation, cleaning, cox, economics, hazard, learners, lifetime, pit, quality, refute, survival
from stayflow.sources import adapters, warehouse


def test_running_sums_within_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, rng.random()]), rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, x double, v long")
    got = {r.k: (r.rn, r.s) for r in running(df, F.col("x"), [F.col("k")], {"s": F.col("v")}, by=["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0.0, r[0]))
        total = 0
        for i, r in enumerate(own, 1):
            total += r[3]
            assert got[r[0]] == (i, total)
    assert running(df.limit(0), F.col("x"), [F.col("k")]).count() == 0


def test_tokens_and_duplicates(spark):
    df = spark.createDataFrame([("word of mouth",), (" SEO ",), ("n/a",), (None,), ("​ppc",)], "c string")
    levels, synonyms = ("organic", "paid", "referral"), {"seo": "organic", "ppc": "paid", "word_of_mouth": "referral"}
    assert [r[0] for r in df.select(cleaning.normalise_token(F.col("c"), levels, synonyms)).collect()] == ["referral", "organic", None, None, "paid"]
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "a"), (1, 3, "a", None), (2, 1, None, None), (2, 2, None, None)], "k int, o int, x string, y string")
    kept, counts = cleaning.first_per_key(rows, ["k"], "o")
    assert kept.count() == 2 and counts.first().asDict() == {"exact": 2, "near": 1}


def test_contract_kinds(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, None, 1)], "k int, s string, v int")
    rule = quality.Expectation
    rules = [rule("k", "column_exists"), rule("gone", "column_exists"), rule("v", "monotonic", {"within": "k", "by": "s"}), rule("k", "dtype", {"dtype": "str"}), rule("s", "not_null", {"max_frac": 0.5})]
    assert {(r.column, r.kind) for r in quality.Contract("c", rules).validate(df).collect()} == {("gone", "column_exists"), ("v", "monotonic"), ("k", "dtype")}
    assert not quality.passed(quality.Contract("c", rules).validate(df)) and quality.passed(quality.Contract("c", rules[:1]).validate(df))


def test_worked_examples(spark):
    df = spark.createDataFrame([(0, 2.0, 1), (1, 5.0, 0)], "id int, t double, e int")
    rows = sorted((r.id, r.period, r.event) for r in survival.person_period(df, "t", "e", 3, ["id"]).collect())
    assert [r[1] for r in rows] == [0, 1, 0, 1, 2] and [r[2] for r in rows] == [0, 1, 0, 0, 0]
    times = spark.createDataFrame([(float(t), 1, float(-t), float(t)) for t in (1, 2, 3, 4)], "t double, e int, up double, down double")
    assert survival.concordance(times, "t", "e", "up").first().c_index == 1.0 and survival.concordance(times, "t", "e", "down").first().c_index == 0.0
    assert [round(x, 4) for x in economics.breakeven()] == [0.0, 7.44, 21.3, 26.4]
    arms = spark.createDataFrame([(a, "x" if i < 4 else "y") for i, a in enumerate((1, 1, 0, 0, 1, 0, 0, 0))], "arm int, g string")
    assert economics.disparate_impact(arms, "arm", "g").first().ratio == 0.5
    assert kolmogorov_sf(0.0, 5, 5) == 1.0 and abs(chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(e_value(2.0) - (2 + math.sqrt(2))) < 1e-12


def test_concordance_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(1, 6)), rng.randint(0, 1), float(rng.randint(0, 4))) for _ in range(60)]
    got = survival.concordance(spark.createDataFrame(rows, "t double, e int, r double"), "t", "e", "r").first()
    pairs = [(a, b) for a in rows for b in rows if a[1] == 1 and (b[0] > a[0] or b[0] == a[0] and b[1] == 0)]
    assert (got.pairs, got.concordant, got.tied) == (len(pairs), sum(a[2] > b[2] for a, b in pairs), sum(a[2] == b[2] for a, b in pairs))


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_passes_over_what_does_not_fit(spark, seed):
    rng = random.Random(seed)
    items = [(i, float(rng.randint(0, 9)), float(rng.choice((1, 3, 7)))) for i in range(40)]
    left, want = 50.0, []
    for i, _, c in sorted(items, key=lambda r: (-r[1], r[0])):
        if c <= left:
            want.append(i)
            left -= c
    got = allocation.fill(spark.createDataFrame(items, "k long, lead double, c double"), F.col("lead"), "k", "c", 50.0)
    assert sorted(r.k for r in got.collect()) == sorted(want)


def test_upgrades_are_the_hull(spark):
    rng = random.Random(4)
    costs, rows = [0.0, 2.0, 3.0, 7.0], [[0.0, *(rng.choice([None, rng.uniform(-3, 9)]) for _ in range(3))] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, net array<double>")
    for r in df.withColumn("s", allocation.upgrades(F.col("net"), costs)).collect():
        for price in (0.1, 0.5, 1.0, 2.0):
            best = max((v or -1e9 if a else 0.0) - price * costs[a] if v is not None else -1e9 for a, v in enumerate(r.net))
            arms = [s.arm for s in r.s if s.slope > price]
            arm = arms[-1] if arms else 0
            assert abs(((r.net[arm] if arm else 0.0) - price * costs[arm]) - best) < 1e-9
    assert allocation.prices(df.limit(0), "net", [5.0], costs)[0]["value"] == 0.0


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def newton(x, y, l2):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ b)
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b)), x.T @ (y - p) - l2 * b)
    return b


def test_propensity_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    arm = (rng.random(300) < sigmoid(x)).astype(int) + (rng.random(300) < 0.2)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, arm, strict=True))], "k long, x double, arm int")
    rows = sorted(learners.propensity(df, "arm", ["x"], 3, "k", 3).collect())
    fold = np.array([r.fold for r in rows])
    z = np.column_stack([np.ones(300), (x - x.mean()) / x.std()])
    raw = np.zeros((300, 3))
    for f in range(3):
        for a in range(3):
            raw[fold == f, a] = sigmoid(z[fold == f] @ newton(z[fold != f], (arm[fold != f] == a).astype(float), 1e-3))
    assert np.allclose([[r.e_0, r.e_1, r.e_2] for r in rows], raw / raw.sum(axis=1, keepdims=True), atol=1e-5)


def test_hazard_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=200)
    t = np.ceil(rng.exponential(3 * np.exp(-0.5 * x))).clip(1, 9)
    e = rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, t, e, strict=True)], "x double, t double, e int")
    m = hazard.fit_hazard(df, "t", "e", 4, ("x",), rounds=40, tol=1e-12)[None]
    design, y = [], []
    for a, b, c in zip(x, t, e, strict=True):
        for k in range(int(min(b, 4))):
            design.append([*(float(k == j) for j in range(4)), a])
            y.append(float(c == 1 and b <= 4 and k == b - 1))
    b = newton(np.array(design), np.array(y), 1e-6)
    assert np.allclose([*m.levels, *m.slopes], b, atol=1e-4)
    curve = df.select(m.survival().alias("s"), hazard.mean_time(m.survival(), 2.5).alias("r"), hazard.falling(F.array(*[F.lit(v) for v in (0.9, 1.2, 0.5, 0.6)])).alias("f")).first()
    s = np.cumprod(1 - sigmoid(b[:4] + b[4] * x[0]))
    assert np.allclose(curve.s, s, atol=1e-4) and abs(curve.r - (s[:2].sum() + 0.5 * s[1])) < 1e-4 and curve.f == [0.9, 0.9, 0.5, 0.5]


def test_refutations_of_a_known_effect(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=600)
    w = (rng.random(600) < sigmoid(x)).astype(int)
    y = 2.0 * w + x + rng.normal(size=600)
    df = spark.createDataFrame([(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, w, y, strict=True))], "k long, x double, w int, y double")
    rows = {r.test: r for r in refute.suite(df, "y", "w", ("x",), "k").collect()}
    assert set(rows) == {"placebo", "random_common_cause", "subset", "unobserved_confounder"} and all(r.passed for r in rows.values())
    want = np.linalg.lstsq(np.column_stack([np.ones(600), x, w]), y, rcond=None)[0][-1]
    assert all(abs(r.original - want) < 1e-8 for r in rows.values())


def test_a_sample_takes_the_rows_that_hash_lowest(spark):
    low = sorted(range(500), key=lambda i: int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:12], 16))
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    for most in (0, 1, 350, 900):
        got = adapters.sample_rows(df.repartition(5), "id", most, 3)
        assert got.columns == ["id", "v"] and sorted(r.id for r in got.collect()) == sorted(low[:most])
    assert adapters.sample_rows(df.where("false"), "id", 5).count() == 0


def test_a_permuted_placebo_keeps_the_arms_and_finds_chance(spark):
    rng = np.random.default_rng(17)
    x, w = rng.normal(size=400), rng.integers(0, 3, 400)
    real, none = x + 1.5 * w + rng.normal(size=400), x + rng.normal(size=400)
    rows = [(i, float(a), int(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x, w, real, none, strict=True))]
    df = spark.createDataFrame([*rows, (400, 0.0, None, 1.0, 1.0)], "k long, x double, w int, y double, z double")
    found, chance = (refute.placebo_permuted(df, y, "w", ("x",), "k", n=40).first() for y in ("y", "z"))
    assert found.p_value == 0 and found.passed and abs(found.mean) < 0.1 and chance.p_value > 0.05
    # one draw against the same shuffle by hand
    u = [int(hashlib.md5(f"11|{i}".encode()).hexdigest()[:12], 16) for i in range(400)]
    shuffled = np.empty(400)
    shuffled[np.argsort(u)] = np.sort(w)
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x, shuffled]), real, rcond=None)[0][-1]
    assert abs(refute.placebo_permuted(df, "y", "w", ("x",), "k", n=1).first()["mean"] - want) < 1e-8


def test_the_hodges_lehmann_estimate_equals_the_median_of_all_averages(spark):
    rng = np.random.default_rng(18)
    for d in (rng.standard_t(2, 2000), np.round(rng.normal(size=301), 1), np.array([1.0, 2.0, 4.0, 1e6]), np.array([3.0, 3.0])):
        i, j = np.triu_indices(len(d))
        got = refute.hodges_lehmann(spark.createDataFrame([(float(v),) for v in [*d, float("nan")]], "difference double")).first()
        assert got.n == len(d) and abs(got.hodges_lehmann - np.median((d[i] + d[j]) / 2)) <= 2e-10 * max(1, np.ptp(d))
    got = refute.hodges_lehmann(spark.createDataFrame([(None,)], "difference double")).first()
    assert got.n == 0 and got.hodges_lehmann is None


def test_lifetime_fit_is_a_maximum(spark):
    rng = np.random.default_rng(8)
    n = 800
    age = rng.uniform(10, 40, n)
    rate, drop = rng.gamma(1.2, 1 / 6.0, n), rng.beta(0.9, 2.5, n)
    rows = []
    for a, lam, p in zip(age, rate, drop, strict=True):
        t = last = x = 0
        while rng.random() > (p if x or t else 0.0):
            t += rng.exponential(1 / lam)
            if t > a:
                break
            x, last = x + 1, t
        rows.append((float(x), float(last), float(a), float(rng.gamma(4.0, 10.0)) if x else 0.0))
    df = spark.createDataFrame(rows, "frequency double, recency double, T double, monetary_value double")
    m = lifetime.fit_purchases(df)
    at = np.array([m.r, m.alpha, m.a, m.b])
    data = np.array(rows).T
    value = lambda theta: lifetime.purchase_likelihood(theta, *data[:3]).mean() - 1e-4 * (theta**2).sum()
    assert all(value(at * np.exp(rng.normal(0, 0.05, 4))) <= value(at) + 1e-7 for _ in range(300))
    got = lifetime.goodness_of_fit(df, m).collect()
    assert abs(sum(r.expected for r in got) - n) < 1e-6 and sum(r.observed for r in got) == n
    assert np.allclose(lifetime.log_gamma(np.array([0.1, 1.0, 2.5, 30.0])), [math.lgamma(v) for v in (0.1, 1.0, 2.5, 30.0)])
    assert abs(sum(m.probability_of(k, np.array([5.0]))[0] for k in range(80)) - 1) < 1e-6


def test_catalogue(spark, tmp_path):
    house = warehouse.Warehouse(spark, str(tmp_path / "house"))
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k int, s string, v double")
    assert house.tables().count() == 0 and not house.has("gold", "panel")
    house.write("gold", "Panel", df)
    house.write("bronze", "events", df.limit(1))
    house.write("gold", "panel", df.union(df))
    assert [tuple(r) for r in house.tables().collect()] == [("bronze_events", "bronze", "events", 1, 3), ("gold_panel", "gold", "panel", 4, 3)]
    assert house.read("gold", "panel").schema == df.schema and house.sql("SELECT sum(k) FROM gold_panel").first()[0] == 6
    assert house.lineage().count() == 3 and house.lineage(latest_only=True).count() == 2
    house.drop("gold", "panel")
    assert not house.has("gold", "panel") and house.lineage().count() == 4
    house.drop("gold", "panel", missing_ok=True)
    for wrong in (lambda: house.read("gold", "panel"), lambda: house.drop("gold", "panel"), lambda: house.write("iron", "x", df), lambda: house.write("gold", "x", df.select("k", F.col("s").alias("K")))):
        with pytest.raises((KeyError, ValueError)):
            wrong()
    a, b = (warehouse.content_hash(x).first() for x in (df, df.repartition(3)))
    assert a == b != warehouse.content_hash(df.union(df)).first()
    told = {warehouse.content_hash(spark.createDataFrame([r], "a string, b string")).first().sha256 for r in [("a\x1fb", "c"), ("a", "b\x1fc"), ("-", None), (None, "-"), ("", None), (None, None)]}
    assert len(told) == 6


def test_content_hash_of_a_time_does_not_hang_on_the_zone(spark):
    df = spark.createDataFrame([(1,)], "us long").select(F.timestamp_micros("us").alias("t"), F.array(F.timestamp_micros("us")).alias("a"))
    zone, told = spark.conf.get("spark.sql.session.timeZone"), set()
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            told.add(warehouse.content_hash(df).first().sha256)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(told) == 1


def test_mean_ranks_of_ties(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 0.0, 1.0, 2.0, rng.random()])) for i in range(300)]
    got = {r.k: (r.rn, r.m) for r in running(spark.createDataFrame(rows, "k long, x double"), F.col("x"), [F.col("k")], mean_rank="m").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    for i, (k, x) in enumerate(order, 1):
        peers = [j for j, r in enumerate(order, 1) if r[1] == x]
        assert got[k] == (i, sum(peers) / len(peers))


def test_sensitivity_equals_regressions(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(0, 1, 400), rng.normal(50, 1000, 400), np.ones(400)
    w = (a + rng.normal(0, 1, 400) > 0).astype(float)
    y = 0.8 * w + a + b / 2000 + rng.normal(0, 1, 400)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, w, a, b, c, strict=True))], "k long, y double, w double, a double, b double, c double")

    def left(target, *others):
        z = np.column_stack([np.ones(400), *others])
        return float(((target - z @ np.linalg.lstsq(z, target, rcond=None)[0]) ** 2).sum())

    got = {r.feature: r for r in refute.benchmarks(df, "y", "w", ("a", "b")).collect()}
    main = refute.robustness(df, "y", "w", ("a", "b")).first()
    for name, x, other in (("a", a, b), ("b", b, a)):
        r = got[name]
        assert r.r2_y == pytest.approx(1 - left(y, w, a, b) / left(y, w, other), abs=1e-9) and r.r2_w == pytest.approx(1 - left(w, a, b) / left(w, other), abs=1e-9)
        bias = main.se * math.sqrt(main.dof * r.r2_y * r.r2_w / (1 - r.r2_w))
        assert r.bias == pytest.approx(bias) and r.nullified == (bias >= abs(main.effect)) and r.adjusted == pytest.approx(main.effect - math.copysign(bias, main.effect))
        # a confounder that many times as strong brings the effect to 0
        assert r.multiple**2 * r.r2_y * r.r2_w / (1 - r.multiple * r.r2_w) == pytest.approx(main.t**2 / main.dof)
    rv = main.robustness
    assert main.se * math.sqrt(main.dof * rv * rv / (1 - rv)) == pytest.approx(abs(main.effect)) and main.robustness_alpha < rv
    spread = y.std(ddof=1)
    for r in refute.confounder_shift(df, "y", "w", ("a", "b"), "k").collect():
        # the confounder's own noise moves the estimate too: four of its standard errors
        noise = r.strength * spread / math.sqrt(left(w, a, b))
        assert r.predicted == pytest.approx(r.strength**2 * spread / w.std()) and r.gap == pytest.approx(abs(r.shift - r.predicted)) and r.gap < 4 * noise
        assert r.effect - r.shift == pytest.approx(main.effect) and r.as_predicted == (r.gap <= max(0.35 * r.predicted, 0.02 * spread))
    # a feature that is constant explains nothing; tables without rows tell so
    assert refute.benchmarks(df, "y", "w", ("a", "c")).where("feature = 'c'").first().multiple is None
    empty = df.limit(0)
    assert refute.robustness(empty.unionByName(df.limit(2)), "y", "w", ("a", "b")).first().robustness is None
    told = refute.suite(empty, "y", "w", ("a",), "k").collect()
    assert len(told) == 4 and not any(r.passed for r in told) and all(r.error for r in told)
    assert all(r.error is None for r in refute.suite(df, "y", "w", ("a", "b"), "k").collect())


def test_effect_stability_leaves_out_units_without_a_prediction(spark):
    from stayflow.operators import drift

    rows = [(i, float(i % 7), float(-i)) for i in range(100)]
    kinds = "k long, a double, b double"
    one, two = (drift.effect_stability(spark.createDataFrame(r, kinds), "a", "b", "k") for r in (rows, [*rows, (500, None, 1.0), (501, 2.0, None)]))
    assert one[0].first() == two[0].first() and sorted(map(tuple, one[1].collect())) == sorted(map(tuple, two[1].collect()))


def test_joins_and_leakage(spark):
    left, right = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    with pytest.raises(ValueError):
        pit.one_to_one(left, right, ["k"])
    assert [r.b for r in pit.aligned(left, "k", right.limit(1)).orderBy("k").collect()] == [5, 0]
    joined = spark.createDataFrame([("2020-01-01", "2019-12-31"), ("2020-01-01", "2020-01-02")], "as_of_date string, event_ts string")
    with pytest.raises(pit.LeakageError):
        pit.assert_no_leakage(joined, left)
    assert pit.assert_no_leakage(joined.where("event_ts < as_of_date"), left).count() == 1


def test_adapters(spark):
    telco = spark.createDataFrame([("a", 20, *["Yes"] * 8, "DSL", 10.0, "200", "Month-to-month", "Credit card (automatic)", "Yes")], "customerID string, tenure int, " + ", ".join(f"{c} string" for c in adapters.TELCO_SERVICES) + ", InternetService string, MonthlyCharges double, TotalCharges string, Contract string, PaymentMethod string, Churn string")
    r = adapters.map_to_panel(telco, "telco").first()
    assert (r.monetary_12m, r.n_categories_12m, r.is_autopay, r.contract_type, r.churn_next, r.src_total_charges) == (120.0, 9.0, "yes", "monthly", 1, 200.0)
    mail = spark.createDataFrame([(3, 100.0, 1, 0, 1, "Web", "Mens E-Mail", 1, 0, 9.5)], "recency int, history double, mens int, womens int, newbie int, channel string, segment string, visit int, conversion int, spend double")
    r = adapters.map_to_panel(mail, "hillstrom").first()
    assert (r.arm, r.treated, r.churn_next, r.value_h, r.recency_days) == (1, 1, 0, 9.5, 3 * 30.4375)
    assert adapters.read_table(spark, "/tmp/no-such-file.csv") is None
    assert adapters.sample_rows(telco, "customerID", 5).count() == 1


def test_cox_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cox, "STEP", 3)  # several rows per time of many events
    rng = random.Random(11)
    rows = [(float(rng.randint(1, 6)), rng.randint(0, 1), rng.gauss(0, 2), float(rng.random() < 0.3)) for _ in range(150)]
    df = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0), (3.0, 1, None, 1.0)], "t double, e int, u double, v double")
    m = cox.fit_cox(df, "t", "e", ("u", "v"))
    t, e, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def likelihood(b):
        risk, total = np.exp(z @ b), 0.0
        for at in np.unique(t[e == 1]):
            dead = (t == at) & (e == 1)
            total += (z[dead] @ b).sum() - sum(math.log(risk[t >= at].sum() - i / dead.sum() * risk[dead].sum()) for i in range(dead.sum()))
        return total

    b = m.coef * x.std(axis=0)
    aim = lambda b: likelihood(b) / len(t) - 0.0005 * (b @ b)
    for step in np.eye(2) * 1e-4:
        assert abs(aim(b + step) - aim(b - step)) / 2e-4 < 1e-6 and aim(b) > max(aim(b + 100 * step), aim(b - 100 * step))
    assert abs(likelihood(b) - m.log_likelihood) < 1e-6
    risk = np.exp((x - x.mean(axis=0)) @ m.coef)
    so_far = 0.0
    for r in m.baseline.orderBy("t").collect():
        own = ((t == r.t) & (e == 1)).sum() / risk[t >= r.t].sum()
        so_far += own
        assert abs(r.hazard - own) < 1e-9 and abs(r.cumhaz - so_far) < 1e-9
    curve = df.dropna().select(m.survival([0.5, 6.0]).alias("s")).first().s
    assert curve[0] == 1.0 and abs(curve[1] - math.exp(-so_far * risk[0])) < 1e-9
    none = cox.fit_cox(df.where("e = 0"), "t", "e", ("u",))
    assert none.coef[0] == 0 and none.baseline.count() == 0
    assert cox.fit_cox(df.limit(0), "t", "e", ("u",)).coef[0] == 0
