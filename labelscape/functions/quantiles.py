"""Exact quantiles and weighted quantiles per group, also for groups too large for one task.

The basic step finds, per group, the smallest value whose cumulative mass reaches a wanted mass.
Equal values are added up first. Up to ``SMALL_ROWS`` distinct values in all, a window does it.
Beyond that, rounds of equal-width histograms narrow each group down to the slice that holds
the answer; every round is one aggregation with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.session import written

SMALL_ROWS = 2_000_000
BINS = 4096


def value_at_mass(df: DataFrame, keys: list[str], value: str, mass: str, wanted: DataFrame,
                  *, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Per row of ``wanted`` (keys, slot, want): smallest value with cumulative mass >= want."""
    base = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(mass).alias("_m"))
    rows = base.join(wanted, keys).withColumn("_before", F.lit(0.0))
    group = [*keys, "slot"]
    if base.limit(small_rows + 1).count() > small_rows:
        rows = written(rows)
        while True:
            edges = rows.groupBy(*group).agg(
                F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
            if edges.agg(F.max(F.when(F.col("_hi") > F.col("_lo"), F.col("_n")))).first()[0] is None:
                break
            if edges.agg(F.max("_n")).first()[0] <= small_rows:
                break
            binned = rows.join(edges, group).withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(
                (F.col("_v") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(5e-324))
                * BINS)).cast("int"))
            counts = binned.groupBy(*group, "_bin").agg(
                F.sum("_m").alias("_bm"), F.first("want").alias("want"),
                F.first("_before").alias("_b"))
            upto = F.sum("_bm").over(Window.partitionBy(*group).orderBy("_bin")) + F.col("_b")
            last = F.max("_bin").over(Window.partitionBy(*group))
            counts = counts.withColumn("_upto", upto).withColumn("_last", last)
            hit = counts.where((F.col("_upto") >= F.col("want")) | (F.col("_bin") == F.col("_last")))
            hit = hit.groupBy(*group).agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_bm")).alias(
                "_nb"))).alias("_h")).select(*group, F.col("_h._bin").alias("_bin"), F.col("_h._nb").alias("_nb"))
            rows = written(binned.join(hit, [*group, "_bin"]).select(
                *keys, "_v", "_m", "slot", "want", F.col("_nb").alias("_before")))
    cum = F.sum("_m").over(Window.partitionBy(*group).orderBy("_v")) + F.col("_before")
    reached = F.min(F.when(F.col("_cum") >= F.col("want"), F.col("_v")))
    return rows.withColumn("_cum", cum).groupBy(*group).agg(
        F.coalesce(reached, F.max("_v")).alias("found"))


def quantile(df: DataFrame, keys: list[str], value: str, q: dict[str, float], *,
             freq: str | None = None, bounded: bool = False, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``q``; NULL values are ignored.

    ``bounded`` says that every group is at most dictionary-sized (one row per label or gene), so
    that its size need not be looked up first.

    ``freq`` names a column with the number of times a row counts, so that implicit zeros enter
    as one row per group.
    """
    if not keys:
        return quantile(df.withColumn("_g", F.lit(0)), ["_g"], value, q, freq=freq, bounded=bounded,
                        small_rows=small_rows).drop("_g")
    base = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.sum(F.col(freq) if freq else F.lit(1)).cast("long").alias("_f"))
    base = base.where(F.col("_f") > 0)
    if not bounded:
        base = written(base)
    if bounded or base.count() <= small_rows:
        return base.groupBy(*keys).agg(
            *[F.percentile("_v", F.lit(float(p)), F.col("_f")).alias(name) for name, p in q.items()])
    total = base.groupBy(*keys).agg(F.sum("_f").alias("_n"))
    slots = []
    for name, p in q.items():
        spot = (F.col("_n") - 1) * F.lit(float(p))
        slots += [F.struct(F.lit(f"{name}|lo").alias("slot"), (F.floor(spot) + 1).cast("double").alias("want")),
                  F.struct(F.lit(f"{name}|hi").alias("slot"), (F.ceil(spot) + 1).cast("double").alias("want"))]
    wanted = total.select(*keys, F.inline(F.array(*slots)))
    found = value_at_mass(base, keys, "_v", "_f", wanted, small_rows=small_rows)
    pick = [F.max(F.when(F.col("slot") == f"{n}|{e}", F.col("found"))).alias(f"{n}|{e}")
            for n in q for e in ("lo", "hi")]
    out = found.groupBy(*keys).agg(*pick)
    out = out.join(total, keys)
    cols = []
    for name, p in q.items():
        spot = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"`{name}|lo`"), F.col(f"`{name}|hi`")
        cols.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return out.select(*keys, *cols)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str | None, q: float, *,
                      freq: str | None = None, small_rows: int = SMALL_ROWS, out: str = "value") -> DataFrame:
    """Smallest value whose cumulative weight reaches ``q`` of the total, no interpolation.

    Negative weights count as 0. Where all weights of a group are 0, or without weights, the
    ordinary interpolated quantile is taken. ``freq`` as for ``quantile``.
    """
    if not keys:
        return weighted_quantile(df.withColumn("_g", F.lit(0)), ["_g"], value, weight, q, freq=freq,
                                 small_rows=small_rows, out=out).drop("_g")
    if weight is None:
        return quantile(df, keys, value, {out: q}, freq=freq, small_rows=small_rows)
    often = F.col(freq) if freq else F.lit(1)
    df = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    df = df.withColumn("_w", F.greatest(F.col(weight).cast("double"), F.lit(0.0)))
    df = written(df.groupBy(*keys, value).agg(F.sum(F.col("_w") * often).alias("_w"), F.sum(often).alias("_f")))
    total = df.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    wanted = total.where(F.col("_t") > 1e-8).select(
        *keys, F.lit("q").alias("slot"), (F.col("_t") * min(max(q, 0.0), 1.0)).alias("want"))
    weighted = value_at_mass(df, keys, value, "_w", wanted, small_rows=small_rows).select(
        *keys, F.col("found").alias(out))
    flat = df.join(total.where(F.col("_t") <= 1e-8).select(*keys), keys, "left_semi")
    if flat.isEmpty():
        return weighted
    return weighted.unionByName(quantile(flat, keys, value, {out: q}, freq="_f", small_rows=small_rows))


def plain_mean(value: Column, often: Column) -> Column:
    """Mean of rows that count ``often``; NULL without values."""
    return F.try_divide(F.sum(value * often), F.sum(F.when(value.isNotNull(), often)))


def weighted_mean(value: Column, weight: Column, often: Column | None = None) -> Column:
    """Weighted mean over usable pairs; the plain mean where the weights add up to nothing."""
    usable = value.isNotNull() & weight.isNotNull()
    often = F.lit(1) if often is None else often
    w = F.when(usable, F.greatest(weight, F.lit(0.0))) * often
    return F.when(F.sum(w) > 1e-8, F.sum(value * w) / F.sum(w)).otherwise(plain_mean(F.when(usable, value), often))


def aggregate_weighted(df: DataFrame, keys: list[str], value: str, weight: str,
                       method: str = "weighted_median", *, out: str = "value") -> DataFrame:
    """weighted_median, weighted_trimmed_mean (between the weighted 0.1 and 0.9 quantiles) or mean."""
    if method == "weighted_median":
        return weighted_quantile(df, keys, value, weight, 0.5, out=out)
    if method == "mean":
        return df.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias(out))
    if method != "weighted_trimmed_mean":
        raise ValueError(f"method={method!r} is unknown; use weighted_median, weighted_trimmed_mean or mean")
    df = written(df)
    low = weighted_quantile(df, keys, value, weight, 0.1, out="_low")
    high = weighted_quantile(df, keys, value, weight, 0.9, out="_high")
    total = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sum(F.greatest(F.col(weight), F.lit(0.0))).alias("_t"))
    kept = df.join(low, keys).join(high, keys).join(total, keys).where(
        (F.col("_t") <= 1e-8) | F.col(value).between(F.col("_low"), F.col("_high")))
    return kept.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias(out))


def aggregate_distances(df: DataFrame, keys: list[str], value: str, weight: str, *, agg: str = "quantile",
                        q: float = 0.9, weight_by_expression: bool = True, freq: str | None = None, out: str = "value") -> DataFrame:
    """One number per group from nearest-neighbour distances: mean, median or quantile. ``freq``: how often a row counts."""
    if agg == "mean":
        often = F.col(freq) if freq else F.lit(1)
        mean = weighted_mean(F.col(value), F.col(weight), often) if weight_by_expression else plain_mean(F.col(value), often)
        return df.groupBy(*keys).agg(mean.alias(out))
    if agg not in {"median", "quantile"}:
        raise ValueError(f"Unknown agg: {agg}")
    return weighted_quantile(df, keys, value, weight if weight_by_expression else None,
                             0.5 if agg == "median" else q, freq=freq, out=out)
