"""Queries: net values, decisions, budgets, off-policy value and fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation, constrained, economics
from .features import _rounded
from .inputs import UNITS, frame, plain

E = ("e0", "e1", "e2", "e3")
MU = ("mu0", "mu1", "mu2", "mu3")
TAU = ("tau1", "tau2", "tau3")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, UNITS)


def _nets(spark, sf_dir) -> DataFrame:
    return economics.net_values(_units(spark, sf_dir), TAU)


def _chosen(spark, sf_dir) -> DataFrame:
    """The units with the arm of the largest net value as ``chosen`` and that value as ``gain``."""
    out = _nets(spark, sf_dir).withColumn("chosen", economics.assign_at(F.col("net"), 0.0))
    return out.withColumn("gain", F.element_at("net", F.col("chosen") + 1))


def decisions(spark, sf_dir):
    out = economics.decision_frame(_units(spark, sf_dir), "unit_id", TAU, "risk")
    return _rounded(out, *[f"net_{a}" for a in range(4)], "expected_net")


def net_value(spark, sf_dir):
    n = F.col("net")
    return _nets(spark, sf_dir).select("unit_id", *[F.round(n[a], 6).alias(f"net_{a}") for a in range(4)])


def roi(spark, sf_dir):
    return _rounded(economics.roi_summary(_nets(spark, sf_dir), "arm", "net"), "cost", "net", "gross", "roi", digits=4)


def arms(spark, sf_dir):
    return _rounded(economics.per_arm(_nets(spark, sf_dir), "arm", "net"), "cost", "value", digits=4)


def _budget(spark, sf_dir) -> float:
    """Three units of money per unit."""
    return 3.0 * spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def lagrangian(spark, sf_dir):
    out, told = allocation.lagrangian_allocate(_nets(spark, sf_dir), "net", "unit_id", _budget(spark, sf_dir), top_up=False)
    out = out.groupBy("arm").agg(F.count("*").alias("n"))
    return _rounded(out.withColumns({k: F.lit(float(told[k])) for k in ("price", "spent", "value", "bound")}), "price", "spent", "value", "bound", digits=4)


def topped_up(spark, sf_dir):
    """Each unit's arm once the rest of the budget is spent too."""
    return allocation.lagrangian_allocate(_nets(spark, sf_dir), "net", "unit_id", _budget(spark, sf_dir))[0].select("unit_id", "arm")


def allocation_summary(spark, sf_dir):
    b = _budget(spark, sf_dir)
    out, _ = allocation.lagrangian_allocate(_nets(spark, sf_dir), "net", "unit_id", b, top_up=False)
    return _rounded(allocation.summary(out, "arm", "net", b), "spent", "value", "roi", "utilisation", digits=4)


def greedy(spark, sf_dir):
    return _rounded(allocation.greedy_allocate(_nets(spark, sf_dir), "net", "unit_id", 5000.0), "cost", "value")


def frontier(spark, sf_dir):
    out = allocation.efficient_frontier(_nets(spark, sf_dir), "net", (500.0, 1000.0, 2000.0, 4000.0))
    return _rounded(out, "value", "spent", "price", "bound", "marginal", digits=4)


def pareto(spark, sf_dir):
    return _nets(spark, sf_dir).select("unit_id", F.concat_ws(",", allocation.pareto_keep(F.col("net")).cast("array<string>")).alias("arms"))


def repaired(spark, sf_dir):
    rows = _chosen(spark, sf_dir).withColumn("cost", F.element_at(F.array(*[F.lit(float(c)) for c in economics.COSTS]), F.col("chosen") + 1)).select("unit_id", "chosen", "cost", "gain")
    return _rounded(allocation.repair_budget(rows, "unit_id", "cost", "gain", _budget(spark, sf_dir)), "cost", "gain")


def baselines(spark, sf_dir):
    return allocation.baseline_policies(_units(spark, sf_dir), "unit_id", "risk", "y", economics.COSTS[1], 1000.0)


def parity(spark, sf_dir):
    out, share = allocation.parity_allocate(_nets(spark, sf_dir), "net", "unit_id", "grp", _budget(spark, sf_dir))
    return out.withColumn("share", F.lit(share))


def capacities(spark, sf_dir):
    """A budget, and room for a tenth of the units in each arm but the first."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    out, _ = constrained.capacity_allocate(_nets(spark, sf_dir), "net", "unit_id", 3.0 * n, (None, None, n // 10, n // 10))
    return _rounded(out, "cost", "value")


def parity_within(spark, sf_dir):
    out, told = constrained.parity_reweight(_nets(spark, sf_dir), "net", "unit_id", "grp", _budget(spark, sf_dir), 0.05)
    return _rounded(out.withColumn("share", F.lit(float(told["share"]))), "cost", "value", "share")


def reference_policies(spark, sf_dir):
    """Costs differ by unit: contacts in some nations cost more."""
    nets = _nets(spark, sf_dir)
    cost = F.array(*[F.lit(float(c)) * (1 + (F.col("x2") % 3) / 10) for c in economics.COSTS])
    return _rounded(constrained.reference_policies(nets, "unit_id", "risk", "y", "net", cost, 1000.0), "cost")


def breakevens(spark, sf_dir):
    return spark.createDataFrame([(a, float(c)) for a, c in enumerate(economics.breakeven())], "arm int, breakeven double")


def policy_value(spark, sf_dir):
    out = economics.off_policy(_chosen(spark, sf_dir), "y", "arm", "chosen", E, MU)
    return _rounded(out, "ess", "ipw", "snipw", "dr", "se_ipw", "se_snipw", "se_dr", digits=5)


def policy_bootstrap(spark, sf_dir):
    values = {"chosen": F.col("gain"), "nobody": F.lit(0.0), "first": F.col("net")[1]}
    return _rounded(economics.bootstrap_differences(_chosen(spark, sf_dir), "unit_id", values, "nobody", 50), "diff", "diff_low", "diff_high", digits=5)


def gap(spark, sf_dir):
    units = _units(spark, sf_dir).withColumn("zero", F.lit(0.0))
    return _rounded(economics.oracle_gap(units, "arm", ["zero", *TAU]), "realised", "oracle", "regret", "pct_match", digits=4)


def fairness(spark, sf_dir):
    out = economics.fairness_audit(_chosen(spark, sf_dir), "chosen", "grp", "gain")
    return _rounded(out, "treat_rate", "mean_net", "opportunity", "parity_diff", "parity_ratio")


def impact(spark, sf_dir):
    return _rounded(economics.disparate_impact(_chosen(spark, sf_dir), "chosen", "grp"), "ratio")


QUERIES = {
    "decision_frame": decisions, "net_values": net_value, "roi_summary": roi, "per_arm_summary": arms, "lagrangian_allocate": lagrangian, "greedy_allocate": greedy,
    "topped_up_allocation": topped_up, "allocation_summary": allocation_summary, "pareto_arms": pareto, "repair_budget": repaired, "parity_allocation": parity, "capacity_allocation": capacities, "parity_reweighted": parity_within, "reference_policies": reference_policies, "breakeven_effects": breakevens,
    "efficient_frontier": frontier, "baseline_policies": baselines, "off_policy_value": policy_value, "policy_bootstrap": policy_bootstrap, "oracle_gap": gap,
    "fairness_audit": fairness, "disparate_impact": impact,
}

_U = f"({plain(UNITS)})"
_COSTS = [f"{c:.2f}::DOUBLE" for c in economics.COSTS]
_ARM_COST = f"[{', '.join(_COSTS)}]"
_NET = f"n AS (SELECT *, 0::DOUBLE AS n0, {', '.join(f'tau{a} - {_COSTS[a]} AS n{a}' for a in (1, 2, 3))}, [0, {', '.join(f'tau{a} - {_COSTS[a]}' for a in (1, 2, 3))}]::DOUBLE[] AS net FROM {_U})"
_BEST = "list_position(net, list_max(net)) - 1"
_CHOSEN = f"c AS (SELECT *, {_BEST} AS chosen, list_max(net) AS gain FROM n)"
_NAME = "['control', 'discount_10', 'discount_25', 'concierge']"
#: Each unit's chain of upgrades, all of them in order, and what the budget's price buys.
_NEXT = "SELECT unit_id, unnest(list_transform([1, 2, 3], lambda a: struct_pack(slope := (v[a + 1] - {v0}) / (k[a + 1] - {c0}), arm := a, dv := v[a + 1] - {v0}, dc := k[a + 1] - {c0}))) AS o, v, k FROM {of}"
_PICK = "SELECT unit_id, v, k, {step} AS step, arg_max(o, (o.slope, o.dc)) AS o FROM ({next}) WHERE o.dc > 0 AND o.dv > 0 GROUP BY 1, 2, 3"
_S1 = _PICK.format(step=1, next=_NEXT.format(v0="0", c0="0", of=f"(SELECT unit_id, net AS v, {_ARM_COST}::DOUBLE[] AS k FROM n)"))
_S2, _S3 = (_PICK.format(step=i, next=_NEXT.format(v0="v[o.arm + 1]", c0="k[o.arm + 1]", of=f"s{i - 1}")) for i in (2, 3))
_HULL = f"""{_NET}, s1 AS ({_S1}), s2 AS ({_S2}), s3 AS ({_S3}), s AS (SELECT unit_id, step, o.slope AS slope, o.arm AS arm, o.dv AS dv, o.dc AS dc FROM (SELECT unit_id, step, o FROM s1 UNION ALL SELECT unit_id, step, o FROM s2 UNION ALL SELECT unit_id, step, o FROM s3)),
o AS (SELECT slope, sum(sum(dc)) OVER (ORDER BY slope DESC) AS upto FROM s GROUP BY slope), g AS (SELECT 3.0::DOUBLE * count(*) AS budget FROM customer)"""
_AT = "l AS (SELECT price, coalesce(sum(dc) FILTER (slope > price), 0) AS spent, coalesce(sum(dv) FILTER (slope > price), 0) AS value FROM s, (SELECT coalesce(max(slope) FILTER (upto > budget), 0) AS price FROM o, g) GROUP BY price)"
_FILL = "f AS ({items}), w(rn, spent, took) AS (SELECT 0, 0::DOUBLE, false UNION ALL SELECT w.rn + 1, CASE WHEN w.spent + f.c <= {budget} + 1e-9 THEN w.spent + f.c ELSE w.spent END, w.spent + f.c <= {budget} + 1e-9 FROM w JOIN f ON f.rn = w.rn + 1)"
_GROUP = "count(*) AS n, avg((chosen > 0)::INT) AS treat_rate, avg(gain) AS mean_net, avg((chosen > 0)::INT) FILTER (gain > 0) AS opportunity"
SQL = {
    "net_values": f"WITH {_NET} SELECT unit_id, n0 AS net_0, round(n1, 6) AS net_1, round(n2, 6) AS net_2, round(n3, 6) AS net_3 FROM n",
    "decision_frame": f"""WITH {_NET}, {_CHOSEN}, p AS (
  SELECT *, greatest(tau1, tau2, tau3) AS top, (rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2) / count(*) OVER () AS pct FROM c), t AS (
  SELECT *, CASE WHEN pct <= 1 / 3 THEN 0 WHEN pct <= 2 / 3 THEN 1 ELSE 2 END AS tercile FROM p)
SELECT unit_id, n0 AS net_0, round(n1, 6) AS net_1, round(n2, 6) AS net_2, round(n3, 6) AS net_3, chosen::INT AS arm, {_NAME}[chosen + 1] AS arm_name, round(gain, 6) AS expected_net, tercile,
  CASE WHEN top > 0 AND tercile > 0 THEN 'persuadable' WHEN top > 0 THEN 'sure_thing' WHEN top < 0 AND tercile < 2 THEN 'sleeping_dog' WHEN tercile = 2 THEN 'lost_cause' ELSE 'sure_thing' END AS segment,
  dense_rank() OVER (ORDER BY gain DESC) AS priority FROM t""",
    "roi_summary": f"""WITH {_NET}, s AS (SELECT count(*) FILTER (arm > 0) AS n_targeted, sum({_ARM_COST}[arm + 1]) FILTER (arm > 0) AS cost, sum(net[arm + 1]) FILTER (arm > 0) AS net FROM n)
SELECT n_targeted, round(cost, 4) AS cost, round(net, 4) AS net, round(net + cost, 4) AS gross, round(net / cost, 4) AS roi FROM s""",
    "per_arm_summary": f"WITH {_NET} SELECT arm, count(*) AS n, round(count(*) * any_value({_ARM_COST}[arm + 1]), 4) AS cost, round(sum(net[arm + 1]), 4) AS value FROM n GROUP BY arm",
    "greedy_allocate": f"""WITH RECURSIVE {_NET}, r AS (SELECT *, [CASE WHEN n1 > 0 THEN n1 / {_COSTS[1]} ELSE -1 END, CASE WHEN n2 > 0 THEN n2 / {_COSTS[2]} ELSE -1 END, CASE WHEN n3 > 0 THEN n3 / {_COSTS[3]} ELSE -1 END]::DOUBLE[] AS q FROM n), b AS (
  SELECT unit_id, list_position(q, list_max(q)) AS arm, net, row_number() OVER (ORDER BY list_max(q) DESC, unit_id) AS rn FROM r WHERE list_max(q) > 0), {_FILL.format(items='SELECT rn, ' + _ARM_COST + '[arm + 1] AS c FROM b', budget='5000::DOUBLE')}
SELECT unit_id, arm::INT AS arm, round({_ARM_COST}[arm + 1], 6) AS cost, round(net[arm + 1], 6) AS value FROM b JOIN w ON w.rn = b.rn AND w.took""",
    "lagrangian_allocate": f"""WITH {_HULL}, {_AT}, a AS (SELECT u.unit_id, coalesce(max(s.arm), 0) AS arm FROM n u LEFT JOIN (SELECT * FROM s, l WHERE slope > price) s ON s.unit_id = u.unit_id GROUP BY 1)
SELECT arm::INT AS arm, count(*) AS n, any_value(round(price, 4)) AS price, any_value(round(spent, 4)) AS spent, any_value(round(value, 4)) AS value, any_value(round(value + price * (budget - spent), 4)) AS bound FROM a, l, g GROUP BY arm""",
    "allocation_summary": f"""WITH {_HULL}, {_AT}, a AS (SELECT u.unit_id, coalesce(max(s.arm), 0) AS arm FROM n u LEFT JOIN (SELECT * FROM s, l WHERE slope > price) s ON s.unit_id = u.unit_id GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (arm > 0) AS n_treated, any_value(round(spent, 4)) AS spent, any_value(round(value, 4)) AS value, any_value(round(value / spent, 4)) AS roi, any_value(round(spent / budget, 4)) AS utilisation FROM a, l, g""",
    "topped_up_allocation": f"""WITH RECURSIVE {_HULL}, {_AT}, a AS (SELECT u.unit_id, coalesce(max(s.arm), 0) AS arm, count(s.arm) AS k FROM n u LEFT JOIN (SELECT * FROM s, l WHERE slope > price) s ON s.unit_id = u.unit_id GROUP BY 1), b AS (
  SELECT a.unit_id, s.arm, s.dc, row_number() OVER (ORDER BY slope DESC, a.unit_id) AS rn FROM a JOIN s ON s.unit_id = a.unit_id AND s.step = a.k + 1), {_FILL.format(items='SELECT rn, dc AS c FROM b', budget='(SELECT budget - spent FROM l, g)')}
SELECT a.unit_id, coalesce(t.arm, a.arm)::INT AS arm FROM a LEFT JOIN (SELECT unit_id, arm FROM b JOIN w ON w.rn = b.rn AND w.took) t ON t.unit_id = a.unit_id""",
    "efficient_frontier": f"""WITH {_HULL}, v AS (SELECT unnest([500, 1000, 2000, 4000])::DOUBLE AS budget), p AS (SELECT budget, coalesce(max(slope) FILTER (upto > budget), 0) AS price FROM o, v GROUP BY budget), x AS (
  SELECT budget, price, coalesce(sum(dc) FILTER (slope > price), 0) AS spent, coalesce(sum(dv) FILTER (slope > price), 0) AS value FROM s, p GROUP BY 1, 2)
SELECT budget, round(value, 4) AS value, round(spent, 4) AS spent, round(price, 4) AS price, round(value + price * (budget - spent), 4) AS bound, round((value - lag(value) OVER (ORDER BY budget)) / (budget - lag(budget) OVER (ORDER BY budget)), 4) AS marginal FROM x""",
    "pareto_arms": f"""WITH {_NET} SELECT unit_id, '0' || CASE WHEN n1 > n0 THEN ',1' ELSE '' END || CASE WHEN n2 > greatest(n0, n1) THEN ',2' ELSE '' END || CASE WHEN n3 > greatest(n0, n1, n2) THEN ',3' ELSE '' END AS arms FROM n""",
    "repair_budget": f"""WITH {_NET}, {_CHOSEN}, k AS (SELECT unit_id, chosen::INT AS chosen, {_ARM_COST}[chosen + 1] AS cost, gain FROM c), o AS (SELECT *, CASE WHEN cost > 0 THEN sum(cost) OVER (ORDER BY CASE WHEN cost > 0 THEN gain / cost END DESC NULLS LAST, unit_id DESC ROWS UNBOUNDED PRECEDING) END AS upto FROM k)
SELECT unit_id, chosen, round(cost, 6) AS cost, round(gain, 6) AS gain FROM o WHERE upto IS NULL OR upto <= (SELECT 3.0 * count(*) FROM customer)""",
    "parity_allocation": f"""WITH {_NET}, {_CHOSEN}, k AS (SELECT unit_id, grp, chosen::INT AS arm, {_ARM_COST}[chosen + 1] AS cost, ceil(row_number() OVER (PARTITION BY grp, chosen > 0 ORDER BY gain DESC, unit_id) * 200 / count(*) OVER (PARTITION BY grp)) AS step FROM c QUALIFY chosen > 0),
m AS (SELECT min(s) AS m FROM (SELECT max(step) AS s FROM k GROUP BY grp)), g AS (SELECT r.step, coalesce(sum(cost), 0) AS cost FROM range(1, 201) r(step) LEFT JOIN k ON k.step = r.step GROUP BY 1), t AS (SELECT step, sum(cost) OVER (ORDER BY step) AS upto FROM g), b AS (SELECT coalesce(max(step), 0) AS best FROM t, m WHERE step <= m AND upto <= (SELECT 3.0 * count(*) FROM customer))
SELECT unit_id, grp, arm, best / 200 AS share FROM k, b WHERE step <= best""",
    "breakeven_effects": "SELECT * FROM (VALUES " + ", ".join(f"({a}, {c}::DOUBLE)" for a, c in enumerate(_COSTS)) + ") t(arm, breakeven)",
    "baseline_policies": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS policy, unit_id FROM {_U} ORDER BY {order}, unit_id LIMIT {int(1000.0 // economics.COSTS[1])})"
        for name, order in (("treat_all", "1"), ("highest_risk", "risk DESC NULLS LAST"), ("highest_clv", "y DESC NULLS LAST"), ("risk_x_clv", "risk * y DESC NULLS LAST"), ("random", "md5(concat_ws('|', '7', unit_id))"))
    ),
    "policy_bootstrap": f"""WITH {_NET}, {_CHOSEN}, b AS (SELECT unnest(range(1, 51)) AS b), u AS (SELECT b, gain, net[2] AS one, ('0x' || substr(md5(concat_ws('|', '7', unit_id, b)), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u FROM c, b), w AS (
  SELECT b, gain, one, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]::DOUBLE[], lambda z: z <= u)) AS w FROM u), r AS (
  SELECT b, sum(w * gain) / sum(w) AS chosen, sum(w * one) / sum(w) AS first FROM w GROUP BY b), q AS (SELECT 'chosen' AS policy, quantile_cont(chosen, 0.025) AS lo, quantile_cont(chosen, 0.975) AS hi FROM r UNION ALL SELECT 'first', quantile_cont(first, 0.025), quantile_cont(first, 0.975) FROM r), p AS (
  SELECT 'chosen' AS policy, avg(gain) AS d FROM c UNION ALL SELECT 'first', avg(net[2]) FROM c)
SELECT policy, round(d, 5) AS diff, round(lo, 5) AS diff_low, round(hi, 5) AS diff_high, lo > 0 AS beats_baseline FROM p JOIN q USING (policy)""",
    "off_policy_value": f"""WITH {_NET}, {_CHOSEN}, r AS (
  SELECT y, CASE WHEN arm = chosen THEN least(1 / [e0, e1, e2, e3][arm + 1], 50) ELSE 0 END AS w, [mu0, mu1, mu2, mu3][chosen + 1] AS m FROM c), s AS (SELECT sum(w * y) / sum(w) AS sn, avg(w) AS mw FROM r), d AS (
  SELECT *, m + w * (y - m) AS d, w * (y - sn) / mw AS r FROM r, s)
SELECT count(*) AS n, count(*) FILTER (w > 0) AS n_match, round(sum(w) * sum(w) / sum(w * w), 5) AS ess, round(avg(w * y), 5) AS ipw, round(any_value(sn), 5) AS snipw, round(avg(d), 5) AS dr,
  round(stddev_samp(w * y) / sqrt(count(*)), 5) AS se_ipw, round(stddev_samp(r) / sqrt(count(*)), 5) AS se_snipw, round(stddev_samp(d) / sqrt(count(*)), 5) AS se_dr FROM d""",
    "oracle_gap": f"""WITH g AS (SELECT [0, tau1, tau2, tau3]::DOUBLE[] AS v, arm FROM {_U}), s AS (SELECT sum(v[arm + 1]) AS realised, sum(list_max(v)) AS oracle, avg((list_position(v, list_max(v)) - 1 = arm)::INT) AS m FROM g)
SELECT round(realised, 4) AS realised, round(oracle, 4) AS oracle, round(oracle - realised, 4) AS regret, round(100 * m, 4) AS pct_match FROM s""",
    "fairness_audit": f"""WITH {_NET}, {_CHOSEN}, g AS (SELECT grp, {_GROUP} FROM c GROUP BY grp), a AS (SELECT * FROM g UNION ALL SELECT 'OVERALL', {_GROUP} FROM c), t AS (SELECT max(treat_rate) AS top FROM g)
SELECT grp, n, round(treat_rate, 6) AS treat_rate, round(mean_net, 6) AS mean_net, round(opportunity, 6) AS opportunity, round(treat_rate - top, 6) AS parity_diff, round(treat_rate / top, 6) AS parity_ratio FROM a, t""",
    "disparate_impact": f"WITH {_NET}, {_CHOSEN}, g AS (SELECT avg((chosen > 0)::INT) AS r FROM c GROUP BY grp) SELECT round(min(r) / max(r), 6) AS ratio FROM g",
}
