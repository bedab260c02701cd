"""Folding of a hunk's scored answers into one risk: column arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the fold.
W_CONCERN, W_SCOPE, W_BEYOND, FLAG_P, FLAG_CONFIDENCE, HIGH, MEDIUM = 0.6, 0.4, 0.25, 0.8, 0.6, 0.6, 0.3


def clamp(x: Column, most: float = 1.0) -> Column:
    """Into 0..most; null and NaN are 0."""
    x = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(most))


def risk(concerns: list[Column], blast: Column, effort: Column, beyond: Column, blast_max: int, effort_max: int) -> Column:
    """0..1: the worst concern and the scope, drawn towards 1 by behaviour beyond what the change states."""
    worst = F.greatest(*map(clamp, concerns))
    scope = clamp(blast, blast_max) / blast_max * (0.5 + 0.5 * clamp(effort, effort_max) / effort_max)
    base = clamp(W_CONCERN * worst + W_SCOPE * scope)
    return clamp(base + W_BEYOND * clamp(beyond) * (1 - base))


def flagged(concerns: list[Column], primary: Column, confidence: Column) -> Column:
    return (F.greatest(*map(clamp, concerns)) >= FLAG_P) | (~primary.isin("none", "insufficient_evidence") & (clamp(confidence) >= FLAG_CONFIDENCE))


def level(risk_col: Column, flag: Column) -> Column:
    return F.when(flag & (risk_col >= HIGH), "high").when(flag | (risk_col >= MEDIUM), "medium").otherwise("low")


def verified_units(members: DataFrame, checks: DataFrame, by: list[str], group: list[str], unit: str, p: str = "p", least: float = FLAG_P) -> DataFrame:
    """by, verified_units: distinct units of groups whose check says with `least` or more that they are what they look like."""
    sure = checks.filter(clamp(F.col(p)) >= least).select(*group).distinct()
    return members.join(sure, group, "left_semi").select(*by, unit).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("verified_units"))


def by_role(hunks: DataFrame, role: str, roles: list[str], risk_col: str, place: str) -> DataFrame:
    """Hunks in a fixed order of roles, then falling risk; what has no score comes last."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, roles)), F.col(role)), F.lit(0))
    return hunks.withColumn("bucket", F.when(F.col(risk_col).isNull(), len(roles) + 1).when(rank == 0, len(roles)).otherwise(rank.cast("int") - 1)).orderBy("bucket", F.desc_nulls_last(risk_col), place)
