"""Splits in time, decision samples, folds and the design matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, train_end: int, valid_end: int, period: str = "period") -> DataFrame:
    p = F.col(period)
    return df.withColumn("split", F.when(p <= train_end, "train").when(p <= valid_end, "valid").otherwise("test"))


def purged_split(df: DataFrame, train_end: int, valid_end: int, embargo: int = 1, purge_valid: bool = True, drop: bool = False, period: str = "period") -> DataFrame:
    """The temporal split with bands of ``embargo`` periods before each border marked (or dropped) as 'embargo'."""
    p = F.col(period)
    band = (p > train_end - embargo) & (p <= train_end)
    if purge_valid:
        band = band | ((p > valid_end - embargo) & (p <= valid_end))
    out = temporal_split(df, train_end, valid_end, period)
    return out.where(~band) if drop else out.withColumn("split", F.when(band, "embargo").otherwise(F.col("split")))


def uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) from a row's key: the same under any partitioning, and in any engine that knows MD5."""
    return F.conv(F.substring(hashed(seed, *key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def hashed(seed: int, *key: str) -> Column:
    """A hash of a seed and a row's key as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def decision_sample(df: DataFrame, unit: Sequence[str] = ("customer_id", "split"), row: str = "period", seed: int = 0, most: int | None = None) -> DataFrame:
    """One row per unit, chosen by hash; ``most`` keeps so many units, those that hash lowest."""
    order = Window.partitionBy(*unit).orderBy(hashed(seed, *unit, row), row)
    one = df.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    return one if most is None else one.orderBy(hashed(seed + 1, *unit)).limit(most)


def folds(df: DataFrame, arm: str, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Adds a fold by hash of the key within arms, so every arm is spread evenly and no global order is needed."""
    return df.withColumn(name, F.floor(uniform(seed, key, arm) * k).cast("int"))


@dataclass(frozen=True)
class Encoder:
    """Numbers with the median for missing ones and a mark, categories as one column per level and one for others."""

    medians: Mapping[str, float]
    levels: Mapping[str, tuple[str, ...]]

    @property
    def names(self) -> list[str]:
        return [*self.medians, *[f"{c}__isna" for c in self.medians], *[f"{c}__{v}" for c, vs in self.levels.items() for v in (*vs, "other")]]

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        gap = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        out = [F.when(gap(c), F.lit(m)).otherwise(F.col(c).cast("double")).alias(c) for c, m in self.medians.items()]
        out += [gap(c).cast("double").alias(f"{c}__isna") for c in self.medians]
        for c, levels in self.levels.items():
            token = F.lower(F.trim(F.col(c).cast("string")))
            out += [F.coalesce((token == v).cast("double"), F.lit(0.0)).alias(f"{c}__{v}") for v in levels]
            out.append((~F.coalesce(token.isin(*levels), F.lit(False))).cast("double").alias(f"{c}__other"))
        return df.select(*keep, *out)


def fit_encoder(df: DataFrame, numbers: Sequence[str], categories: Mapping[str, tuple[str, ...]]) -> Encoder:
    """Exact medians of finite values in one aggregate; 0 where a column has none."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    got = df.agg(*[F.percentile(finite(c), 0.5).alias(c) for c in numbers]).first()
    return Encoder({c: got[c] if got[c] is not None else 0.0 for c in numbers}, dict(categories))
