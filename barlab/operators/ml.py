"""Learning operators: small linear models as aggregations, tree and logistic models from Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions import rolling as R
from barlab.operators import backtest as B


def prediction_exposure(df: DataFrame, pred: str, train: Column, intercept: float, scale: float, by) -> DataFrame:
    """tanh(intercept + scale * prediction / its training deviation), clipped to [-1, 1]."""
    sd = df.where(train).groupBy(*by).agg(F.stddev_pop(pred).alias("_sd"))
    x = df.join(sd, list(by))
    z = F.tanh(F.lit(intercept) + scale * F.col(pred) / F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0))
    return x.withColumn("exposure", F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))).drop("_sd")


def behavior_profile(df: DataFrame, by, position: str, ret: str, order: str = "ts", samples: int = 256) -> DataFrame:
    """Long share, flips a year, final value, bucket and a sampled 0/1 signature of positions."""
    x = df.withColumns({
        "_flip": F.when(R.lag(position, 1, by, order) != F.col(position), 1).otherwise(0),
        "_i": F.row_number().over(R.ordered(by, order)) - 1,
    })
    g = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(position) > 0).cast("double")).alias("long_fraction"), F.sum("_flip").alias("_f"),
        F.product(1.0 + F.col(ret)).alias("final_nav"),
    )
    want = F.when(F.col("n") <= samples, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.rint(k * (F.col("n") - 1) / float(samples - 1)).cast("int"))
    )
    w = g.select(*by, F.posexplode(want).alias("_k", "_i"))
    sig = x.join(w, [*by, "_i"]).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_k", F.when(F.col(position) > 0, "1").otherwise("0").alias("b")))).alias("_s")
    ).select(*by, F.array_join("_s.b", "").alias("signature"))
    lf = F.col("long_fraction")
    bucket = F.when(lf < 0.02, "always_short").when(lf > 0.98, "always_long").when(lf < 0.40, "short_bias").when(lf > 0.60, "long_bias").otherwise("balanced")
    return g.join(sig, list(by)).select(*by, "long_fraction", (F.col("_f") / (F.col("n") / 252.0)).alias("trades_per_year"), "final_nav", bucket.alias("bucket"), "signature")


def zero_fill(df: DataFrame, columns) -> DataFrame:
    """Missing, NaN and infinite values become zero."""
    ok = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.withColumns({k: F.coalesce(F.when(ok(F.col(k)), F.col(k)), F.lit(0.0)) for k in columns})


def median_impute(df: DataFrame, columns, train: Column) -> DataFrame:
    """Training medians for missing values, then zero; one pass of exact medians."""
    med = df.where(train).agg(*[F.percentile(k, 0.5).alias(f"_m_{k}") for k in columns], F.lit(1).alias("_k"))
    j = df.join(F.broadcast(med), F.lit(1) == F.col("_k"))
    return j.withColumns({k: F.coalesce(k, f"_m_{k}", F.lit(0.0)) for k in columns}).drop("_k", *[f"_m_{k}" for k in columns])


def corr_weights(df: DataFrame, columns, y: str, train: Column, by=()) -> DataFrame:
    """Cosine weight of every feature with the target in one aggregation."""
    t = df.where(train)
    norm_y = F.sqrt(F.sum(F.pow(y, 2)))
    ws = [F.coalesce(F.sum(F.col(k) * F.col(y)) / F.nullif(F.sqrt(F.sum(F.pow(k, 2))) * norm_y, F.lit(0.0)), F.lit(0.0)).alias(f"w_{k}") for k in columns]
    return t.groupBy(*by).agg(*ws) if by else t.agg(*ws, F.lit(1).alias("_k"))


def corr_model(df: DataFrame, columns, y: str, train: Column) -> DataFrame:
    """Score = sum of feature times cosine weight."""
    w = corr_weights(df, columns, y, train)
    j = df.join(F.broadcast(w), F.lit(1) == F.col("_k"))
    score = sum((F.col(k) * F.col(f"w_{k}") for k in columns), F.lit(0.0))
    return j.withColumn("score", score).drop("_k", *[f"w_{k}" for k in columns])


def gram(df: DataFrame, columns, y: str) -> np.ndarray:
    """(k, k+1) sums of products of features with features and target, aggregated map-side."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(
        *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(c) * F.col(y)).alias(f"b_{i}") for i, c in enumerate(columns)],
    ).head()
    k = len(columns)
    out = np.zeros((k, k + 1))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g_{i}_{j}"] or 0.0
    for i in range(k):
        out[i, k] = row[f"b_{i}"] or 0.0
    return out


def ridge(df: DataFrame, columns, y: str, train: Column, alpha: float) -> DataFrame:
    """Closed-form ridge without intercept: Spark sums the Gram matrix, the driver solves k x k."""
    g = gram(df.where(train), columns, y)
    k = len(columns)
    w = np.linalg.solve(g[:, :k] + alpha * np.eye(k), g[:, k])
    return df.withColumn("score", sum((F.col(c) * float(v) for c, v in zip(columns, w)), F.lit(0.0)))


def _vector(df: DataFrame, columns) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep").transform(df)


REGRESSORS = {
    "ridge": lambda p: LinearRegression(elasticNetParam=0.0, regParam=float(p.get("alpha", 1.0)), solver="normal"),
    "random_forest": lambda p: RandomForestRegressor(numTrees=int(p.get("n_estimators", 64)), maxDepth=int(p.get("max_depth", 3)), minInstancesPerNode=8, seed=int(p.get("seed", 0))),
    "hist_gradient_boosting": lambda p: GBTRegressor(maxIter=int(p.get("iterations", 20)), maxDepth=int(p.get("max_depth", 3)), stepSize=float(p.get("learning_rate", 0.05)), seed=int(p.get("seed", 0))),
}


def fit_regressor(df: DataFrame, columns, y: str, train: Column, model: str, **params):
    """Fit on training rows only, predict all rows; returns (frame with ``score``, fitted model)."""
    est = REGRESSORS[model](params).setFeaturesCol("_x").setLabelCol(y).setPredictionCol("score")
    x = _vector(df, columns)
    fitted = est.fit(x.where(train & F.col(y).isNotNull()))
    return fitted.transform(x).drop("_x"), fitted


def logistic(df: DataFrame, columns, y: str, train: Column, reg: float = 1.0) -> DataFrame:
    """Probability of a positive target minus one half; a single class falls back to cosine weights."""
    x = df.withColumn("_label", (F.col(y) > 0).cast("double"))
    classes = x.where(train).agg(F.count_distinct("_label")).head()[0]
    if classes < 2:
        return corr_model(df, columns, y, train)
    est = LogisticRegression(featuresCol="_x", labelCol="_label", regParam=1.0 / reg / 100.0, probabilityCol="_p", predictionCol="_hat", rawPredictionCol="_raw")
    v = _vector(x, columns)
    out = est.fit(v.where(train & F.col(y).isNotNull())).transform(v)
    return out.withColumn("score", vector_to_array("_p")[1] - 0.5).drop("_x", "_p", "_hat", "_raw", "_label")


CLASSIFIERS = {
    "random_forest": lambda p: RandomForestClassifier(numTrees=int(p.get("n_estimators", 80)), maxDepth=int(p.get("max_depth", 3)), minInstancesPerNode=int(p.get("min_samples_leaf", 20)), seed=int(p.get("seed", 0))),
    "gradient_boosting": lambda p: GBTClassifier(maxIter=int(p.get("iterations", 20)), maxDepth=int(p.get("max_depth", 3)), stepSize=float(p.get("learning_rate", 0.05)), seed=int(p.get("seed", 0))),
}


def fit_classifier(df: DataFrame, columns, y: str, train: Column, model: str, **params) -> DataFrame:
    """Probability of a positive target minus one half from trees; a single class falls back to cosine weights."""
    x = df.withColumn("_label", (F.col(y) > 0).cast("double"))
    if x.where(train).agg(F.count_distinct("_label")).head()[0] < 2:
        return corr_model(df, columns, y, train)
    est = CLASSIFIERS[model](params).setFeaturesCol("_x").setLabelCol("_label").setProbabilityCol("_p").setPredictionCol("_hat").setRawPredictionCol("_raw")
    v = _vector(x, columns)
    out = est.fit(v.where(train & F.col(y).isNotNull())).transform(v)
    return out.withColumn("score", vector_to_array("_p")[1] - 0.5).drop("_x", "_p", "_hat", "_raw", "_label")


def importance(spark, fitted, columns) -> DataFrame:
    """Absolute importances or coefficients, normalised to one."""
    raw = fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else fitted.coefficients.toArray()
    a = np.abs(raw)
    total = float(a.sum()) or 1.0
    rows = [(c, float(v / total)) for c, v in zip(columns, a)]
    return spark.createDataFrame(rows, "feature string, importance double")


LINEAR_SCHEMA = T.StructType([
    T.StructField("spec_id", T.StringType()), T.StructField("ts", T.DateType()), T.StructField("score", T.DoubleType()), T.StructField("next_return", T.DoubleType()),
    T.StructField("train", T.BooleanType()),
])


def linear_sweep(xy: DataFrame, specs: DataFrame, columns, parts: int = 8) -> DataFrame:
    """Many small linear models at once: (spec_id, ts, score, next_return, train).

    ``specs`` has spec_id, model (corr or ridge), alpha and features. Training rows reduce to one
    Gram matrix over all columns in Spark; every spec then solves its own sub-matrix and scores are a
    join of specs with rows, so no task holds the sample.
    """
    g = gram(xy.where("train"), columns, "next_return")
    pos = {c: i for i, c in enumerate(columns)}
    k = len(columns)
    norm_y = float(xy.where("train").agg(F.sqrt(F.sum(F.pow("next_return", 2)))).head()[0] or 0.0)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                idx = [pos[f] for f in r.features]
                sub, b = g[np.ix_(idx, idx)], g[idx, k]
                if r.model == "ridge":
                    w = np.linalg.solve(sub + r.alpha * np.eye(len(idx)), b)
                else:
                    d = np.sqrt(np.diag(sub)) * norm_y
                    w = np.divide(b, d, out=np.zeros(len(idx)), where=d > 0)
                full = np.zeros(k)
                full[idx] = w
                out.append((r.spec_id, full.tolist()))
            yield pd.DataFrame(out, columns=["spec_id", "w"])

    weights = specs.repartition(parts, "spec_id").mapInPandas(solve, "spec_id string, w array<double>")
    rows = xy.select("ts", "next_return", "train", F.array(*columns).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_s"))
    w = weights.withColumn("_s", F.pmod(F.xxhash64("spec_id"), F.lit(parts)).cast("int"))
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return w.join(rows, "_s").select("spec_id", "ts", dot.alias("score"), "next_return", "train")


def sweep_statistics(scored: DataFrame, samples: int = 300, threshold: float = 0.0) -> DataFrame:
    """(spec_id, excess_pvalue, bootstrap_calmar_p05) of the validation rows: the one-sided test of the mean excess over
    the benchmark, and the fifth percentile of the Calmar over block resamples."""
    from barlab.operators import robust as RB

    pos = F.when(F.col("score") >= threshold, 1.0).otherwise(-1.0)
    x = scored.where("period = 'validation'").withColumn("strategy_return", pos * F.col("next_return")).withColumn("excess", F.col("strategy_return") - F.col("next_return"))
    boot = RB.bootstrap_samples(x.select(F.col("spec_id").alias("candidate_id"), F.col("ts").alias("timestamp"), F.lit("daily").alias("frequency"), "strategy_return"), samples)
    low = boot.groupBy(F.col("candidate_id").alias("spec_id")).agg(F.percentile("calmar", 0.05).alias("bootstrap_calmar_p05"))
    return RB.mean_pvalue(x, "excess", ("spec_id",)).withColumnRenamed("mean_pvalue", "excess_pvalue").join(low, "spec_id")


def sweep_metrics(scored: DataFrame, by=("spec_id", "period"), threshold: float = 0.0) -> DataFrame:
    pos = F.when(F.col("score") >= threshold, 1.0).otherwise(-1.0)
    return B.metrics_next_returns(scored.withColumn("position", pos), "position", "next_return", list(by))
