"""Bootstrap, permutation and multiplicity correction with counter-based draws.

A draw is a function of (seed, draw, slot), so results do not depend on the partitioning
and a lost executor recomputes the same numbers. Indices come from the first hex digits of an
MD5, which SQL engines share. Only sufficient statistics are resampled: the draws join
cluster totals, never rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import f1


#: Rows of a table that a generic statistic may be computed on in one task.
MAX_LOCAL = 1_000_000
#: Draws whose slots one task makes.
TASK_DRAWS = 20


def draw_index(seed: str, draw: Column, slot: Column, size: Column) -> Column:
    """Pseudo-random index in 0..size-1 of a slot of a draw."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), draw.cast("string"), slot.cast("string"))), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), size)


def resample(clusters: DataFrame, key: str, columns: Sequence[str], draws: int, seed: str) -> DataFrame:
    """draw and the sums of ``columns`` over as many clusters as there are, drawn with replacement.

    Draw and slot numbers come from ranges; the cluster table is numbered in key order, a null key last as in SQL
    (one row per cluster, pre-aggregated). An empty table gives no draws.
    """
    spark = clusters.sparkSession
    numbered = clusters.select(*columns, (F.row_number().over(Window.orderBy(F.asc_nulls_last(key))) - 1).cast("long").alias("i"))
    size = clusters.agg(F.count(F.lit(1)).alias("k"))
    slots = spark.range(0, draws, 1, max(1, -(-draws // TASK_DRAWS))).select(F.col("id").alias("draw")).join(F.broadcast(size), F.lit(True)).where("k > 0")
    slots = slots.select("draw", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot"))
    picked = slots.select("draw", draw_index(seed, F.col("draw"), F.col("slot"), F.col("k")).alias("i"))
    # every pick has its cluster; a left join, as Spark's estimate knows nothing of the slots and an inner one would
    # broadcast draws x clusters picks through the driver. The slots of a draw are in one task, so only sums are sent
    return picked.join(numbered, "i", "left").groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])


def resample_poisson(clusters: DataFrame, key: str, columns: Sequence[str], draws: int, seed: str) -> DataFrame:
    """draw and sums of ``columns`` with Poisson(1) repeats of each cluster, for any number of clusters.

    A repeat is a hash of (seed, cluster, draw), so it does not depend on the partitioning. Every batch
    sends one row per draw; clusters are neither numbered nor moved. Null values count as 0.
    """
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    salt = np.uint64(int(hashlib.sha256(seed.encode()).hexdigest()[:16], 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (np.arange(draws, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            values = np.stack([np.nan_to_num(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in batch.columns[1:]], 1)
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ salt
            sums = np.zeros((draws, values.shape[1]))
            for at in range(0, len(keys), 512):
                x = keys[at : at + 512, None] + number[None, :]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                sums += np.searchsorted(steps, uniform).T.astype(np.float64) @ values[at : at + 512]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *[pa.array(sums[:, i]) for i in range(sums.shape[1])]], names=["draw", *columns])

    schema = "draw long, " + ", ".join(f"`{c}` double" for c in columns)
    each = clusters.select(F.xxhash64(key).alias("k"), *columns).mapInArrow(run, schema)
    return each.groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])


def interval(draws: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Lower and upper percentile of each column over the draws where it is defined."""
    q = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    out = draws.agg(*[F.percentile(c, q).alias(c) for c in columns])
    return out.select(*[x for c in columns for x in (F.col(c)[0].alias(f"{c}_low"), F.col(c)[1].alias(f"{c}_high"))])


def bootstrap_confusion(totals: DataFrame, cluster: str, draws: int, seed: str, poisson: bool = False) -> DataFrame:
    """Intervals of precision, recall and f1 from cluster totals of tp, fp, fn.

    The default draws as many clusters as there are, which numbers them in one task: for up to some
    hundred thousand clusters. ``poisson`` has no such bound.
    """
    sums = (resample_poisson if poisson else resample)(totals, cluster, ["tp", "fp", "fn"], draws, seed)
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    rates = sums.withColumns({"precision": d("tp", "fp"), "recall": d("tp", "fn")}).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return interval(rates, ["precision", "recall", "f1"])


def cluster_bootstrap(rows: DataFrame, cluster: str, statistic: Callable[[pd.DataFrame], float], draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Generic interval of any statistic of pandas rows, one task per draw.

    For small, already reduced tables (up to MAX_LOCAL rows, checked): they are shipped to every draw; sums of any number of
    clusters are resampled by ``resample_poisson``. A cluster drawn
    again gets a new name in each copy. Undefined values of the statistic are left out.
    """
    local = rows.limit(MAX_LOCAL + 1).toPandas()
    if len(local) > MAX_LOCAL:
        raise ValueError(f"more than {MAX_LOCAL} rows: reduce them to totals per cluster and use resample_poisson")
    names = sorted(local[cluster].dropna().unique().tolist())
    parts = {n: local[local[cluster] == n] for n in names}

    def run(batches):
        for batch in batches:
            out = []
            for draw in batch["id"]:
                rng = np.random.default_rng([seed, int(draw)])
                picked = [parts[names[i]].assign(**{cluster: f"rep{k:04d}"}) for k, i in enumerate(rng.integers(0, len(names), len(names)))]
                value = statistic(pd.concat(picked, ignore_index=True)) if picked else float("nan")
                out.append(None if value is None or value != value else float(value))
            yield pd.DataFrame({"draw": batch["id"], "value": out})

    values = rows.sparkSession.range(draws if names else 0).mapInPandas(run, "draw long, value double").where("value is not null and not isnan(value)")
    return interval(values, ["value"], alpha)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson's r over complete pairs from moments; null for fewer than two pairs or a constant side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    known = x.isNotNull() & y.isNotNull()
    a, b = F.when(known, x), F.when(known, y)
    n = F.count_if(known)
    vx, vy = F.var_pop(a), F.var_pop(b)
    return F.when((n > 1) & (vx > 1e-30) & (vy > 1e-30), F.covar_pop(a, b) / F.sqrt(vx * vy))


def permutation_test(rows: DataFrame, key: str, x: str, y: str, draws: int, seed: str) -> DataFrame:
    """r, n and p = (draws with |r*| >= |r|, plus 1) / (draws + 1).

    ``rows`` is a reduced table (one row per entity). In each draw y is assigned to x in the
    order of a hash of (seed, draw, key).
    """
    clean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    place = clean.withColumn("i", F.row_number().over(Window.orderBy("k")))
    # every draw lists every entity: the rows are made where the entity is, nothing is collected
    listed = clean.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("k")))
    shuffled = listed.withColumn("i", F.row_number().over(Window.partitionBy("draw").orderBy(order, "k")))
    both = shuffled.join(place.select("i", "x"), "i").join(place.select("k", "y"), "k")
    each = both.groupBy("draw").agg(correlation("x", "y").alias("r"))
    real = clean.agg(correlation("x", "y").alias("r0"), F.count(F.lit(1)).alias("n"))
    out = real.join(each, F.lit(True), "left").groupBy("r0", "n").agg(F.count_if(F.abs("r") >= F.abs("r0") - 1e-12).alias("extreme"))
    return out.select(F.col("r0").alias("r"), "n", F.when(F.col("r0").isNotNull(), (F.col("extreme") + 1) / F.lit(draws + 1.0)).alias("p"))


def exact_inference(rows: DataFrame, by: Sequence[str], x: str, y: str, seed_col: str, draws: int) -> DataFrame:
    """Per group r, n, bootstrap interval and permutation p from one numpy generator seeded by the SHA-256 of ``seed_col``.

    Groups are tests over reduced tables (tens of rows); they run in parallel, each in one task.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", r double, n long, low double, high double, p double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clean = pdf[[x, y]].dropna().astype(float).to_numpy()
        rng = np.random.default_rng(int(hashlib.sha256(str(pdf[seed_col].iloc[0]).encode()).hexdigest()[:16], 16))

        def corr(a, b):
            a, b = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
            d = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
            return np.divide((a * b).sum(-1), d, out=np.full(np.shape(d), np.nan), where=d > 1e-15)

        n = len(clean)
        if n < 3 or np.isnan(r := float(corr(clean[:, 0], clean[:, 1]))):
            return pd.DataFrame([[*key, None, n, None, None, None]])
        at = rng.integers(0, n, (draws, n))
        boot = corr(clean[at, 0], clean[at, 1])
        perm = np.array([corr(clean[:, 0], rng.permutation(clean[:, 1])) for _ in range(draws)])
        low, high = np.nanpercentile(boot, [2.5, 97.5])
        return pd.DataFrame([[*key, r, n, low, high, (np.sum(np.abs(perm) >= abs(r)) + 1) / (draws + 1)]])

    return rows.groupBy(*by).applyInPandas(run, schema)


def holm(tests: DataFrame, by: Sequence[str], p: str, order: Sequence[str]) -> DataFrame:
    """Adds ``p_holm``: step-down correction within each family; ties of p follow ``order``; null p stay null and do not count."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*by, known).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by, known))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    running = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tests.withColumn("_step", step).withColumn("p_holm", F.when(known, running)).drop("_step")
