"""Data contracts: expectations on a table, checked in one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CATEGORICAL_LEVELS, NUMERIC_FEATURES

KINDS = {
    "int": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double"), "str": ("string",), "datetime": ("timestamp", "timestamp_ntz", "date"),
    "bool": ("boolean",), "numeric": ("tinyint", "smallint", "int", "bigint", "float", "double"),
}
SCHEMA = "column string, kind string, severity string, detail string, n_bad long, frac_bad double"


@dataclass(frozen=True)
class Expectation:
    """A rule of one kind on a column: row_count, column_exists, not_null, dtype, in_range, in_set, unique, monotonic or regex."""

    column: str
    kind: str
    params: dict = field(default_factory=dict)
    severity: str = "error"


def _violations(e: Expectation) -> Column:
    """The number of rows against a rule that looks at one row; nulls break not_null only."""
    c, p = F.col(e.column), e.params
    if e.kind == "not_null":
        bad = c.isNull()
    elif e.kind == "in_range":
        bad = F.lit(False)
        if p.get("min") is not None:
            bad = bad | (c < p["min"])
        if p.get("max") is not None:
            bad = bad | (c > p["max"])
    elif e.kind == "in_set":
        bad = ~c.isin(*p["values"])
    else:  # the pattern is anchored at the start only
        bad = ~c.cast("string").rlike(f"^(?:{p['pattern']})")
    return F.count_if(F.coalesce(bad, F.lit(False)))


@dataclass(frozen=True)
class Contract:
    name: str
    expectations: Sequence[Expectation]

    def validate(self, df: DataFrame) -> DataFrame:
        """A row per rule that fails: column, kind, severity, detail, n_bad, frac_bad.

        Row rules share one aggregate over the table; uniqueness and order need a shuffle by their key each.
        """
        spark, types = df.sparkSession, dict(df.dtypes)
        rules = list(enumerate(self.expectations))
        missing = {i for i, e in rules if e.column not in types and e.column != "*" or not set(e.params.get("subset", [])) <= set(types)}
        row_rules = [(i, e) for i, e in rules if i not in missing and e.kind in ("not_null", "in_range", "in_set", "regex")]
        got = df.agg(F.count("*").alias("n"), *[_violations(e).alias(f"r{i}") for i, e in row_rules]).first()
        n, bad = got["n"], {i: got[f"r{i}"] for i, _ in row_rules}
        failed = []
        for i, e in rules:
            p, detail = e.params, ""
            if i in missing:
                count, detail = n, "missing column"
            elif e.kind == "row_count":
                ok = p.get("min", 0) <= n <= p.get("max", n)
                count, detail = (0 if ok else n or 1), f"{n} rows"
            elif e.kind == "dtype":
                count, detail = (0 if types[e.column] in KINDS[p["dtype"]] else n), types[e.column]
            elif e.kind == "unique":
                groups = df.groupBy(*p["subset"]).count()
                count = groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
            elif e.kind == "monotonic":
                by = [p["by"]] if isinstance(p["by"], str) else list(p["by"])
                last = F.lag(e.column).over(Window.partitionBy(p["within"]).orderBy(*by))
                groups = df.select(F.col(p["within"]).alias("g"), (F.col(e.column) < last).alias("down")).where("down").select("g").distinct()
                count = groups.count()
            elif e.kind == "column_exists":
                count = 0
            elif e.kind == "not_null":
                count = bad[i] if n and bad[i] / n > p.get("max_frac", 0.0) else 0
            else:
                count = bad[i]
            if count:
                failed.append((e.column, e.kind, e.severity, detail, int(count), float(count) / n if n else 1.0))
        return spark.createDataFrame(failed, SCHEMA)


def passed(failures: DataFrame) -> bool:
    return failures.where("severity = 'error'").isEmpty()


def panel_contract() -> Contract:
    """The rules of the panel table."""
    rule = Expectation
    # The panel's rules
    rules = [
        rule("*", "row_count", {"min": 1}), rule("customer_id", "not_null"), rule("customer_id", "dtype", {"dtype": "str"}), rule("period", "dtype", {"dtype": "int"}),
        rule("period", "in_range", {"min": 0, "max": 10000}), rule("as_of_date", "dtype", {"dtype": "datetime"}), rule("as_of_date", "not_null"),
        rule("cohort", "regex", {"pattern": r"^\d{4}-\d{2}$"}), rule("split", "in_set", {"values": ["train", "valid", "test"]}),
        rule("assignment_block", "in_set", {"values": ["observational", "rct"]}), rule("arm", "in_set", {"values": [0, 1, 2, 3]}), rule("treated", "in_set", {"values": [0, 1]}),
        rule("offer_cost", "in_range", {"min": 0.0, "max": 1000.0}), rule("churn_next", "in_set", {"values": [0, 1]}), rule("event_time", "in_range", {"min": 0.0}),
        rule("event_observed", "in_set", {"values": [0, 1]}), rule("rmst_h", "in_range", {"min": 0.0}), rule("value_h", "in_range", {"min": -1e6}),
        rule("margin_rate", "in_range", {"min": 0.0, "max": 1.0}), rule("customer_id", "unique", {"subset": ["customer_id", "period"]}),
        rule("period", "monotonic", {"within": "customer_id", "by": "period"}, "warn"),
    ]
    for c in NUMERIC_FEATURES:
        rules += [rule(c, "dtype", {"dtype": "numeric"}), rule(c, "not_null", {"max_frac": 0.35}, "warn")]
    rules += [rule(c, "in_set", {"values": list(v)}) for c, v in CATEGORICAL_LEVELS.items()]
    return Contract("gold_panel", rules)
