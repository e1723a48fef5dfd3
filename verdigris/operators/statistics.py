"""Statistics of evaluations: rates, intervals, paired tests, percentiles and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.session import ship

Z = 1.959963984540054


def rate(n: Column, d: Column) -> Column:
    """n / d, null where d is 0."""
    return F.try_divide(n.cast("double"), F.nullif(d, F.lit(0)))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval of k of n."""
    p, n = k / n, n.cast("double")
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - width) / (1 + z * z / n), (middle + width) / (1 + z * z / n)


def mcnemar(b: Column, c: Column) -> tuple[Column, Column]:
    """(chi squared with continuity correction, exact two-sided binomial p)."""
    n = b + c
    chi = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.pow(F.abs(b - c) - 1, F.lit(2)) / n))
    low = F.least(b, c)
    step = lambda a, k: F.struct((a["t"] * (n - k + 1) / k).alias("t"), (a["s"] + a["t"] * (n - k + 1) / k).alias("s"))
    start = F.struct(F.pow(F.lit(0.5), n).alias("t"), F.pow(F.lit(0.5), n).alias("s"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), low), lambda k: k > 0), start, step, lambda a: a["s"])
    return chi, F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 11) -> DataFrame:
    """Percentile interval of the mean difference (id, diff) by Poisson weights.

    Poisson(1) weights stand for draws with replacement; rows of equal difference share one
    draw, as sums of such weights are Poisson too. So the work follows the distinct differences,
    and only sums per resample are shuffled. The draws follow from the seed and the difference.
    """
    ship(pairs.sparkSession)
    counted = pairs.filter("diff is not null").groupBy(F.col("diff").cast("double").alias("diff")).agg(F.count("*").alias("n"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight, total = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for diff, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.random.default_rng([seed, *np.frombuffer(np.float64(diff).tobytes(), "u4").tolist()]).poisson(n, resamples)
                weight += w
                total += w * diff
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], names=["resample", "w", "t"])

    means = counted.mapInArrow(run, "resample long, w double, t double").groupBy("resample").agg(rate(F.sum("t"), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def stable_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first n rows by the hash of seed and key: the same at every run."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256), key).limit(n)


def stratified(rows: DataFrame, key: str, stratum: str, seed: str, n: int) -> DataFrame:
    """n rows over the strata: an equal share each, the remainder to the first strata in order."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    strata = rows.select(stratum).distinct()
    place = strata.withColumn("__place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(stratum))).withColumn("__strata", F.count("*").over(Window.partitionBy(F.lit(1))))
    quota = F.expr(f"{n} div __strata") + F.when(F.col("__place") <= F.lit(n) % F.col("__strata"), 1).otherwise(0)
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(digest, key)))
    # No stratum gives more than n rows: cut before the join, while the rank can still be cut before the shuffle.
    return ranked.filter(F.col("__r") <= n).join(F.broadcast(place), stratum).filter(F.col("__r") <= quota).drop("__r", "__place", "__strata")


def disagreements(rows: DataFrame, a: object, b: object) -> DataFrame:
    """Scores of two models on one (benchmark, sample) that differ; rows with errors or no score take no part.

    A model that scored a sample several times counts with its highest score.
    """
    good = rows.filter(~F.col("errored") & F.col("score").isNotNull() & F.col("model").isin(a, b))
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    both = good.groupBy("benchmark", "sample").agg(one(a).alias("score_a"), one(b).alias("score_b"))
    return both.filter("score_a != score_b")


def axis_means(rows: DataFrame, axes: tuple[str, ...], condition: str, model: str, category: str) -> DataFrame:
    """Means of the axes and of their mean by condition, by model and condition, by category and condition, in one pass."""
    total = sum((F.col(a) for a in axes[1:]), F.col(axes[0]))
    means = [F.avg(a).alias(a) for a in axes] + [(F.sum(total) / (len(axes) * F.count("*")).cast("double")).alias("mean_score"), F.count("*").alias("n")]
    sets = [[F.col(condition)], [F.col(model), F.col(condition)], [F.col(category), F.col(condition)]]
    return rows.groupingSets(sets, F.col(condition), F.col(model), F.col(category)).agg(*means)


def running(rows: DataFrame, range_: str, order: list[str], of: dict[str, Column]) -> DataFrame:
    """Running sums over all rows in the order of (range, order): sums per range, then within each.

    ``range_`` must follow the order; only the table of ranges is in one task.
    """
    w = Window.partitionBy(range_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(range_).agg(*(F.sum(c).alias(f"__all_{k}") for k, c in of.items()))
    before = Window.partitionBy(F.lit(1)).orderBy(range_)
    offsets = sums.select(range_, *((F.sum(f"__all_{k}").over(before) - F.col(f"__all_{k}")).alias(f"__before_{k}") for k in of))
    found = rows.join(offsets, range_).withColumns({k: F.sum(c).over(w) + F.col(f"__before_{k}") for k, c in of.items()})
    return found.drop(*(f"__before_{k}" for k in of))


def with_context(rows: DataFrame, group: str, order: str, before: int, block: int = 200) -> DataFrame:
    """Rows in blocks with the ``before`` rows of their group ahead of them: (.., __block, __own).

    A window over (group, block) then sees what one over the group would see, and a hot group
    is many tasks. ``order`` is a whole number that grows; only counts per range are in one task.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / 10_000))
    sums = ranged.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    offsets = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__range")) - F.col("__n")).drop("__n")
    w = Window.partitionBy(group, "__range").orderBy(order)
    numbered = ranged.withColumn("__k", F.row_number().over(w)).join(offsets, [group, "__range"]).withColumn("__k", F.col("__k") - 1 + F.col("__before"))
    own = F.floor(F.col("__k") / block)
    blocks = F.when(F.col("__k") % block >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    return numbered.withColumn("__at", F.explode(blocks)).withColumns({"__block": F.col("__at"), "__own": F.col("__at") == own}).drop("__at", "__k", "__range", "__before")
