"""Cleaning of a panel as one chain of projections, with counts of what each step touched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..functions.tables import written
from ..schema import CATEGORICAL_LEVELS, NUMERIC_FEATURES, PANEL, PLAUSIBLE_RANGES, SYNONYMS

# Tokens that mean a missing category, and that mean true.
NULL_TOKENS = ("", "na", "nan", "none", "null", "unknown", "?")
TRUE_TOKENS = ("1", "true", "t", "y", "yes", "late")


def enforce_schema(df: DataFrame, schema: Mapping[str, str] = PANEL, strict: bool = False) -> DataFrame:
    """The table with the schema's columns in its types: what cannot be read becomes null, whole numbers are rounded half to even, categories are trimmed and lower-cased.

    Other columns pass, columns that are missing stay missing; ``strict`` raises KeyError for those.
    """
    missing = [c for c in schema if c not in df.columns]
    if strict and missing:
        raise KeyError(", ".join(missing))
    out = []
    for name in df.columns:
        c, kind = F.col(name), schema.get(name)
        if kind == "bigint":
            c = F.bround(c.cast("string").try_cast("double")).try_cast("bigint")
        elif name in CATEGORICAL_LEVELS:
            c = F.lower(F.trim(c.cast("string")))
        elif kind:
            c = c.try_cast(kind)
        out.append(c.alias(name))
    return df.select(*out)


def truthy(c: Column) -> Column:
    """Whether a flag of any type reads as true; null is false."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin(*TRUE_TOKENS) | (text.try_cast("double") != 0), F.lit(False))


def normalise_token(c: Column, levels: Sequence[str] | None = None, synonyms: Mapping[str, str] | None = None) -> Column:
    """A category in lower case with runs of blanks, dots, dashes and slashes as one underscore; null tokens and unknown levels are null."""
    t = F.regexp_replace(F.lower(F.translate(F.translate(c.cast("string"), "\u00a0", " "), "\u200b", "")), r"^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s\-./]+", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_|_$", "")
    if synonyms:
        t = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), t), t)
    t = F.when(~t.isin(*NULL_TOKENS), t)
    return F.when(t.isin(*levels), t) if levels else t


def first_per_key(df: DataFrame, key: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows that come first by ``order`` for their key, counts of exact and near duplicates dropped); nulls are equal keys. Both read one written table, so keys are dealt and sorted once."""
    payload = F.struct(*[c for c in df.columns if c not in (order, *key)] or [F.lit(1)])  # as values, null-safe: a hash skips nulls
    w = Window.partitionBy(*key).orderBy(order)
    marked = written(df.withColumn("__rn", F.row_number().over(w)).withColumn("__same", payload.eqNullSafe(F.first(payload).over(w))))
    counts = marked.agg(F.count_if((F.col("__rn") > 1) & F.col("__same")).alias("exact"), F.count_if((F.col("__rn") > 1) & ~F.col("__same")).alias("near"))
    return marked.where("__rn = 1").drop("__rn", "__same"), counts


def iqr_fences(train: DataFrame, columns: Sequence[str], k: float = 30.0, least: int = 50) -> dict[str, tuple[float, float]]:
    """Per column the quartiles widened by k times their distance, over the training rows; none with few values or no spread."""
    got = train.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    out = {}
    for c in columns:
        if got[f"n_{c}"] >= least and got[c][1] > got[c][0]:
            low, high = got[c]
            out[c] = (low - k * (high - low), high + k * (high - low))
    return out


def clean_panel(
    df: DataFrame, key: Sequence[str] = ("customer_id", "period"), order: str = "ingest_seq", late: str = "late_arriving", k: float = 30.0,
    ranges: Mapping[str, tuple[float, float]] = PLAUSIBLE_RANGES, aliases: Mapping[str, str] | None = None, synonyms: Mapping[str, Mapping[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(clean rows, log of (step, column, n_affected)).

    Renamed columns are merged into their canonical ones, repeated keys keep their first row, late rows go, categories
    are normalised, numbers outside plausible ranges and outside the training quartile fences are set to the bound.
    Missing values stay missing. Rows are written once when repeated keys are gone and once when categories and ranges
    are settled; counts, fences and the result read those.
    """
    spark = df.sparkSession
    log: list[tuple[str, str, int]] = []
    for old, name in (aliases or {"net_promoter_score": "nps"}).items():
        if old in df.columns:
            log.append(("rename", name, df.where(F.col(old).isNotNull() & (F.col(name).isNull() if name in df.columns else F.lit(True))).count()))
            df = df.withColumn(name, F.coalesce(F.col(name), F.col(old)) if name in df.columns else F.col(old)).drop(old)
    df, dups = first_per_key(df, key, order)
    n = dups.first()
    log += [("drop_exact_duplicates", "*", n["exact"]), ("drop_near_duplicates", "*", n["near"])]
    if late in df.columns:
        log.append(("drop_late", late, df.where(truthy(F.col(late))).count()))
        df = df.where(~truthy(F.col(late))).drop(late)
    categories = [c for c in CATEGORICAL_LEVELS if c in df.columns]
    numbers = [c for c in ranges if c in df.columns]
    fixed = {c: normalise_token(F.col(c), CATEGORICAL_LEVELS[c], (SYNONYMS if synonyms is None else synonyms).get(c)) for c in categories}
    touched = [F.count_if(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(x)).alias(c) for c, x in fixed.items()]
    touched += [F.count_if((F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1])).alias(c) for c in numbers]
    if touched:
        got = df.agg(*touched).first()
        log += [("normalise", c, got[c]) for c in categories] + [("clip_range", c, got[c]) for c in numbers]
    df = written(df.withColumns(fixed | {c: clip(F.col(c), *ranges[c]) for c in numbers}))
    train = df.where("split = 'train'") if "split" in df.columns else df
    fences = iqr_fences(train, numbers, k) if numbers else {}
    if fences:
        got = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in fences.items()]).first()
        log += [("iqr_fence", c, got[c]) for c in fences]
        df = df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in fences.items()})
    gaps = [c for c in (*NUMERIC_FEATURES, *CATEGORICAL_LEVELS) if c in df.columns]
    if gaps:
        got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in gaps]).first()
        log += [("missing", c, got[c]) for c in gaps]
    return df, spark.createDataFrame(log, "step string, column string, n_affected long")
