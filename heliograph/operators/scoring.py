"""Scores of forecast ensembles, deterministic and probabilistic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def ensemble_mean(members: DataFrame) -> DataFrame:
    return members.groupBy("sample_id").agg(F.avg("pred").alias("pred"))


def rmse(pred: str | Column, obs: str | Column) -> Column:
    p, o = (F.col(x) if isinstance(x, str) else x for x in (pred, obs))
    return F.sqrt(F.avg((p - o) * (p - o)))


def mae(pred: str, obs: str) -> Column:
    return F.avg(F.abs(F.col(pred) - F.col(obs)))


def crps(values: Column, obs: Column) -> Column:
    """From the array of members: mean distance to the observation, less half the mean distance among members."""
    x = F.array_sort(values)
    m = F.size(values)
    near = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - obs)) / m
    spread = F.aggregate(F.transform(x, lambda v, i: (2 * (i + 1) - m - 1) * v), F.lit(0.0), lambda s, v: s + v) / (m * m)
    return near - spread


def quantile(ordered: Column, q: float) -> Column:
    """Linear between the two nearest of a sorted array; null if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def winkler(low: Column, high: Column, obs: Column, alpha: float) -> Column:
    wide = high - low
    return F.when(obs < low, wide + 2 * (low - obs) / alpha).when(obs > high, wide + 2 * (obs - high) / alpha).otherwise(wide)


def score_samples(members: DataFrame, truth: DataFrame, by: list[str] | None = None, alpha: float = 0.1) -> DataFrame:
    """For each sample (and group ``by``): ensemble mean, quantiles, CRPS and Winkler score, from one grouping."""
    keys = [*(by or []), "sample_id"]
    out = members.groupBy(*keys).agg(F.avg("pred").alias("pred"), F.array_sort(F.collect_list("pred")).alias("x")).join(truth, "sample_id")
    out = out.withColumns({f"q{int(100 * q)}": quantile(F.col("x"), q) for q in QUANTILES}).withColumn("crps", crps(F.col("x"), F.col("obs")))
    return out.withColumn("winkler", winkler(F.col("q5"), F.col("q95"), F.col("obs"), alpha)).drop("x")


def daily_errors(pairs: DataFrame) -> DataFrame:
    """RMSE and MAE by day, and over all (null day)."""
    return pairs.rollup("day").agg(rmse("pred", "obs").alias("rmse"), mae("pred", "obs").alias("mae"), F.count(F.lit(1)).alias("n"))


def scaling_study(members: DataFrame, truth: DataFrame, ns: list[int], sampling: str = "sampling") -> DataFrame:
    """RMSE, mean CRPS and mean Winkler score with the first n samplings, for each n: a row goes to the n it counts for."""
    wide = members.withColumn("n_samplings", F.explode(F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: n > F.col(sampling))))
    return score_samples(wide, truth, ["n_samplings"]).groupBy("n_samplings").agg(rmse("pred", "obs").alias("rmse"), F.avg("crps").alias("crps"), F.avg("winkler").alias("winkler"), F.count(F.lit(1)).alias("n"))


def forecast_skill(pairs: DataFrame) -> DataFrame:
    """``rmse, persistence_rmse, skill`` in percent; ``now`` is the persistence forecast."""
    out = pairs.agg(rmse("pred", "obs").alias("rmse"), rmse("now", "obs").alias("persistence_rmse"))
    return out.withColumn("skill", (1 - F.col("rmse") / F.col("persistence_rmse")) * 100)


def score(df: DataFrame, models: list, n_samplings: int, predict: Callable) -> DataFrame:
    """``df`` with ``model_id``, ``sampling`` and ``pred`` for each model and sampling.

    ``predict(model, sampling, batch)`` gives an array of predictions for a pandas batch; models are sent once a task, and a batch
    is written before the next model looks at it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("model_id", T.IntegerType()), T.StructField("sampling", T.IntegerType()), T.StructField("pred", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for i, model in enumerate(models):
                for sampling in range(n_samplings):
                    yield batch.assign(model_id=i, sampling=sampling, pred=predict(model, sampling, batch))

    return df.mapInPandas(run, schema)


def first_samplings(members: DataFrame, n: int, sampling: str = "sampling") -> DataFrame:
    return members.where(F.col(sampling) < n)


def last_step(values: Column) -> Column:
    """The last step of a predicted sequence; null if it has none."""
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def score_report(scored: DataFrame, source: str, test_set: str) -> DataFrame:
    """RMSE, mean CRPS and mean Winkler score by source and test set, and by source (null test set)."""
    return scored.groupingSets([[source, test_set], [source]], source, test_set).agg(rmse("pred", "obs").alias("rmse"), F.avg("crps").alias("crps"), F.avg("winkler").alias("winkler"))


def merge_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("run", "metric").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def best_epochs(df: DataFrame) -> DataFrame:
    """Of each fold the epoch of least validation loss, the first on ties."""
    best = df.groupBy("fold").agg(F.min(F.struct("val_loss", "epoch", "train_loss")).alias("b"))
    return best.select("fold", "b.epoch", "b.val_loss", "b.train_loss", F.sqrt("b.val_loss").alias("rmse"))
