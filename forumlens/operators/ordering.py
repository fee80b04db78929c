"""Ranks and running totals within groups that may be far too large for one task.

A window over a whole group would sort the group in one task. Here each group is cut into
ordered buckets; a small table of bucket sizes gives what precedes each bucket, and the window
runs inside the buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import stage

HASH_DIGITS = 3  # 4096 buckets per group
LEAST_BUCKETS, BUCKET_ROWS = 64, 1 << 20


def _preceding(sizes: DataFrame, group: list[str], totals: dict[str, str]) -> DataFrame:
    """Turn per-bucket sums into sums over the earlier buckets and over the whole group."""
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = [*group, "_bucket"]
    for name, source in totals.items():
        out += [F.coalesce(F.sum(source).over(earlier), F.lit(0)).alias(f"_{name}_before"),
                F.sum(source).over(whole).alias(f"_{name}_all")]
    return sizes.select(*out)


def hash_rank(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Add ``pos`` (0-based rank within the group by a seeded hash of the key) and ``group_size``.

    The rank depends on keys and seed only, never on partitioning. Pass staged or cheap rows:
    they are read twice.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))))
    hashed = hashed.withColumn("_bucket", F.substring("_h", 1, HASH_DIGITS))
    sizes = hashed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = _preceding(sizes, [group], {"n": "_n"})
    inner = Window.partitionBy(group, "_bucket").orderBy("_h", key)
    return (
        hashed.join(before, [group, "_bucket"])
        .withColumn("pos", F.col("_n_before") + F.row_number().over(inner) - 1)
        .withColumn("group_size", F.col("_n_all"))
        .drop("_h", "_bucket", "_n_before", "_n_all")
    )


def running_totals(rows: DataFrame, group: list[str], by: str, sums: dict[str, str],
                   buckets: int | None = None) -> DataFrame:
    """Add ``cum_<name>`` (sum over rows with a greater or equal ``by``) and ``all_<name>``.

    ``rows`` must hold each (group, by) once. Bucket limits are quantiles of ``by``, so buckets
    are even however the values cluster; their number grows with the rows. The limits are one short array per group; they are
    staged, so that the planner sees how small they are and broadcasts them.
    """
    rows = stage(rows)
    buckets = buckets or max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    fractions = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    limits = stage(rows.groupBy(*group).agg(F.percentile_approx(by, fractions, F.lit(100 * buckets)).alias("_limits")))
    above = F.size(F.filter("_limits", lambda x: x > F.col(by)))
    placed = rows.join(limits, group).withColumn("_bucket", above).drop("_limits")
    sizes = placed.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = _preceding(sizes, group, {n: f"_s_{n}" for n in sums})
    inner = Window.partitionBy(*group, "_bucket").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(before, [*group, "_bucket"])
    for name, source in sums.items():
        out = (
            out.withColumn(f"cum_{name}", F.col(f"_{name}_before") + F.sum(source).over(inner))
            .withColumn(f"all_{name}", F.col(f"_{name}_all"))
            .drop(f"_{name}_before", f"_{name}_all")
        )
    return out.drop("_bucket")
