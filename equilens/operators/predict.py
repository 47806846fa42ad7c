"""Bias prediction with Spark ML, and the design of new studies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_rows(df: DataFrame, experiment: str, model: str, facets: list[list[str]], correct: str = "acc", least: int = 5) -> DataFrame:
    """experiment, model, facet, n_groups, n and bias (range of group accuracy) for groups of at least ``least`` rows, where there are two or more: one pass over all facets."""
    tags = F.array(*[F.struct(F.lit("+".join(f)).alias("facet"), F.when(~F.greatest(*[F.col(c).isNull() for c in f], F.lit(False)), F.concat_ws("|", *f)).alias("grp")) for f in facets])
    long = df.select(experiment, model, correct, F.explode(tags).alias("z")).select(experiment, model, correct, "z.*").where("grp is not null")
    g = long.groupBy(experiment, model, "facet", "grp").agg(F.count("*").alias("k"), F.avg(correct).alias("a")).where(F.col("k") >= least)
    out = g.groupBy(experiment, model, "facet").agg(F.count("*").alias("n_groups"), F.sum("k").alias("n"), (F.max("a") - F.min("a")).alias("bias"))
    return out.where("n_groups >= 2")


def features(df: DataFrame, n: str = "n", time: str | None = None) -> DataFrame:
    """Adds log_n, n_sq and, with ``time``, month, weekday and hour."""
    out = df.withColumn("log_n", F.log1p(n)).withColumn("n_sq", F.pow(F.col(n).cast("double"), 2))
    return out if time is None else out.withColumn("month", F.month(time)).withColumn("weekday", F.weekday(time)).withColumn("hour", F.hour(time))


def pipeline(texts: list[str], numbers: list[str], label: str, kind: str = "forest", **params):
    """An unfitted pipeline: texts one-hot (new values kept apart), numbers scaled, and a regressor (linear, forest or boosted)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    index = StringIndexer(inputCols=texts, outputCols=[f"__i_{c}" for c in texts], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"__i_{c}" for c in texts], outputCols=[f"__h_{c}" for c in texts])
    nums = VectorAssembler(inputCols=numbers, outputCol="__n", handleInvalid="keep")
    scale = StandardScaler(inputCol="__n", outputCol="__s", withMean=True)
    every = VectorAssembler(inputCols=[*(f"__h_{c}" for c in texts), "__s"], outputCol="features")
    maker = {"linear": LinearRegression, "forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    seed = {} if kind == "linear" else {"seed": 42}
    return Pipeline(stages=[index, hot, nums, scale, every, maker(labelCol=label, featuresCol="features", **seed, **params)])


def compare_models(df: DataFrame, texts: list[str], numbers: list[str], label: str, kinds: tuple[str, ...] = ("linear", "forest", "boosted"), folds: int = 0) -> tuple[dict, dict]:
    """Fit each kind on 80 % of the rows: ({kind: {r2, mae, rmse, cv_rmse?}}, {kind: fitted pipeline}). Needs at least ten rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    if df.limit(10).count() < 10:
        raise ValueError("at least ten rows are needed")
    train, test = df.randomSplit([0.8, 0.2], seed=42)
    scores, models = {}, {}
    for kind in kinds:
        p = pipeline(texts, numbers, label, kind)
        models[kind] = p.fit(train)
        out = models[kind].transform(test)
        scores[kind] = {m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(out) for m in ("r2", "mae", "rmse")}
        if folds:
            cv = CrossValidator(estimator=p, estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, seed=42, parallelism=2).fit(train)
            scores[kind]["cv_rmse"] = cv.avgMetrics[0]
    return scores, models


def tune_forest(df: DataFrame, texts: list[str], numbers: list[str], label: str, trees: tuple[int, ...] = (50, 100, 150), depths: tuple[int, ...] = (5, 10, 15), least: tuple[int, ...] = (2, 5, 10), folds: int = 3):
    """Grid search of a forest (by default 27 settings of trees, depth and least rows of a node) by cross-validated RMSE: (best fitted pipeline, its mean RMSE)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    p = pipeline(texts, numbers, label, "forest")
    forest = p.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).addGrid(forest.minInstancesPerNode, list(least)).build()
    cv = CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, seed=42, parallelism=2).fit(df)
    return cv.bestModel, min(cv.avgMetrics)


def search_forest(df: DataFrame, texts: list[str], numbers: list[str], label: str, draws: int = 20, trees: tuple[int, int] = (50, 200), depths: tuple[int, int] = (3, 20), least: tuple[int, int] = (1, 10), seed: int = 42):
    """Random search over ranges of a forest's settings, each draw judged on a held-out fifth: (best fitted pipeline, its settings, its RMSE)."""
    import random

    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import TrainValidationSplit

    p, rng = pipeline(texts, numbers, label, "forest"), random.Random(seed)
    forest = p.getStages()[-1]
    drawn = [{"numTrees": rng.randint(*trees), "maxDepth": rng.randint(*depths), "minInstancesPerNode": rng.randint(*least)} for _ in range(draws)]
    maps = [{forest.getParam(k): v for k, v in one.items()} for one in drawn]
    judge = RegressionEvaluator(labelCol=label, metricName="rmse")
    found = TrainValidationSplit(estimator=p, estimatorParamMaps=maps, evaluator=judge, trainRatio=0.8, seed=seed, parallelism=2).fit(df)
    best = min(range(draws), key=lambda k: found.validationMetrics[k])
    return found.bestModel, drawn[best], found.validationMetrics[best]


def intervals(model, df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Predictions of a forest pipeline with low and high: percentiles over its trees' predictions."""
    import pandas as pd
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import ArrayType, DoubleType

    forest = model.stages[-1]
    trees = [_as_arrays(t) for t in forest.trees]

    def every(v: pd.Series) -> pd.Series:
        import numpy as np

        x = np.array(v.tolist()) if len(v) else np.zeros((0, 1))
        out = np.zeros((len(x), len(trees)))
        for k, (feature, cut, left, right, value) in enumerate(trees):
            node = np.zeros(len(x), int)
            for _ in range(64):
                inner = feature[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            out[:, k] = value[node]
        return pd.Series(list(out))

    every.__annotations__ = {"v": pd.Series, "return": pd.Series}
    votes = pandas_udf(every, ArrayType(DoubleType()))
    out = model.transform(df).withColumn("__t", F.array_sort(votes(vector_to_array("features"))))

    def at(q: float):
        p = q * (len(trees) - 1)
        i = int(math.floor(p))
        return F.col("__t")[i] * (1 - (p - i)) + F.col("__t")[min(i + 1, len(trees) - 1)] * (p - i)

    return out.withColumn("low", at(alpha / 2)).withColumn("high", at(1 - alpha / 2)).drop("__t")


def _as_arrays(tree):
    """A fitted tree's nodes in arrays: feature (-1: leaf), cut, left, right, value. Categorical splits are on one-hot columns only."""
    import numpy as np

    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            first, second = node.leftChild(), node.rightChild()
            if "Categorical" in split.getClass().getSimpleName():  # of a one-hot column: 0 or 1
                cut = 0.5
                if 0.0 not in list(split.leftCategories()):
                    first, second = second, first
            else:
                cut = split.threshold()
            rows[at][0], rows[at][1] = split.featureIndex(), cut
            rows[at][2] = walk(first)
            rows[at][3] = walk(second)
        return at

    walk(tree._call_java("rootNode"))
    f, c, left, right, v = zip(*rows)
    return np.array(f), np.array(c, float), np.array(left), np.array(right), np.array(v, float)


def risk_level(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Adds level: low below 0.05, moderate below 0.1, high below 0.2, else critical."""
    x = F.col(prediction)
    return df.withColumn("level", F.when(x < 0.05, "low").when(x < 0.1, "moderate").when(x < 0.2, "high").otherwise("critical"))


def held_out(df: DataFrame, key: list[str], texts: list[str], numbers: list[str], label: str, settings: dict[str, dict], folds: int = 5) -> DataFrame:
    """``df`` with kind and prediction: each row once for each of ``settings`` ({name: {"kind": .., parameters}}), predicted by a model that was fitted without the row's fold.

    A row's fold is the hash of its key, so that reruns and all settings have the same folds. Rows without a label are predicted and not fitted on.
    """
    from functools import reduce

    marked = df.withColumn("__fold", F.pmod(F.xxhash64(*key), F.lit(folds)))
    parts = []
    for name, setting in settings.items():
        rest = {k: v for k, v in setting.items() if k != "kind"}
        for fold in range(folds):
            model = pipeline(texts, numbers, label, setting["kind"], **rest).fit(marked.where((F.col("__fold") != fold) & F.col(label).isNotNull()))
            own = model.transform(marked.where(F.col("__fold") == fold))
            parts.append(own.select(*df.columns, F.lit(name).alias("kind"), F.col("__fold").cast("int").alias("fold"), "prediction"))
    return reduce(DataFrame.unionByName, parts)


def fold_errors(predicted: DataFrame, label: str) -> DataFrame:
    """From ``held_out``: kind, n, r2, mae, rmse over all rows with a label, fold_rmse (mean of the folds' rmse) and best (the greatest r2; ties to the first by name)."""
    from pyspark.sql import Window

    y, e = F.col(label), F.col(label) - F.col("prediction")
    by_fold = predicted.where(y.isNotNull()).groupBy("kind", "fold").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("ss"))
    total = by_fold.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("a").alias("a"), F.sum("ss").alias("ss"), F.avg(F.sqrt(F.col("ss") / F.col("n"))).alias("fold_rmse"))
    r2 = 1 - F.try_divide("ss", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    out = total.select("kind", "n", r2.alias("r2"), (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("ss") / F.col("n")).alias("rmse"), "fold_rmse")
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("r2").desc_nulls_last(), "kind"))  # a row for each kind
    return out.withColumn("best", first == 1)


def risk_profiles(predicted: DataFrame, errors: DataFrame, sample_size: str, importances: dict[str, float], family: str = "other", alpha: float = 0.05) -> DataFrame:
    """Profiles of the best kind's predictions: the rows' columns, prediction, low, high, level, factors, mitigations (arrays of text), power and required_n.

    ``predicted`` and ``errors`` come from ``held_out`` and ``fold_errors``. low
    and high: prediction and normal quantile times the kind's held-out rmse.
    power: that of a two-sample t test of the predicted effect with the row's ``sample_size``; required_n by the
    predicted effect; advice goes by the row's own sample size.
    """
    from equilens.functions.dist import norm_ppf

    from . import narrative

    best = predicted.join(F.broadcast(errors.where("best").select("kind", "rmse")), "kind")  # one row
    reach = norm_ppf(1 - alpha / 2) * F.col("rmse")
    told = risk_level(best.withColumn("low", F.col("prediction") - reach).withColumn("high", F.col("prediction") + reach))
    told = required_n(with_power(told, "prediction", sample_size), "prediction")
    n = F.col(sample_size)
    texts = lambda some: F.array(*map(F.lit, some)) if some else F.array().cast("array<string>")
    why, advice = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for least in sorted({0, *narrative.SIZES}):  # what is said changes at these sample sizes only
        said = F.create_map(*[x for level in ("low", "moderate", "high", "critical") for x in (F.lit(level), texts(narrative.mitigations(level, least)))])
        why, advice = F.when(n >= least, texts(narrative.factors(importances, least, family))).otherwise(why), F.when(n >= least, said[F.col("level")]).otherwise(advice)
    return told.withColumn("factors", why).withColumn("mitigations", advice).drop("rmse")


def required_n(df: DataFrame, effect: str) -> DataFrame:
    """Adds required_n: a base by effect (1000 below 0.05, 500 below 0.1, 200 below 0.2, else 100) times ln 3, at least 50."""
    x = F.col(effect)
    base = F.when(x < 0.05, 1000).when(x < 0.1, 500).when(x < 0.2, 200).otherwise(100)
    return df.withColumn("required_n", F.greatest(F.lit(50), F.floor(base * math.log(3)).cast("int")))


def with_power(df: DataFrame, effect: str, n: str) -> DataFrame:
    """Adds power of a two-sample t test at d = effect / 0.1."""
    from equilens.functions.dist import power_col

    return df.withColumn("power", power_col(F.abs(effect) / 0.1, F.col(n).cast("double")))


def recommend_design(risks: DataFrame, combination: str, effect: str, budget: float, price: float = 0.05, seconds: float = 2.0) -> DataFrame:
    """For each combination, by risk: required n, the affordable n (equal shares of the budget), n, cost and hours. An empty table gives an empty design."""
    from pyspark.sql import Window

    r = required_n(risks, effect)
    share = F.floor(F.lit(budget / price) / F.count("*").over(Window.partitionBy(F.lit(0))))  # one row for each combination
    out = r.withColumn("affordable_n", share.cast("bigint")).withColumn("n", F.least("required_n", "affordable_n"))
    return out.withColumn("cost", F.col("n") * price).withColumn("hours", F.col("n") * seconds / 3600).orderBy(F.col(effect).desc(), combination)


def contrasts(risks: DataFrame, combination: str, effect: str, least: float = 0.02) -> DataFrame:
    """Pairs of combinations whose effects differ by more than ``least``: all pairs are the result that is asked for, so each block of combinations meets each other one in cells."""
    from . import ordered as od

    n = od.blocks(risks.count(), 4096)
    kept = risks.select(F.col(combination).alias("c"), F.col(effect).alias("e"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")
    a = kept.select(F.col("c").alias("a"), F.col("e").alias("ea"), own.alias("x"), every.alias("y"))
    b = kept.select(F.col("c").alias("b"), F.col("e").alias("eb"), own.alias("y"), every.alias("x"))
    pairs = a.join(b, ["x", "y"]).where(F.col("a") < F.col("b")).drop("x", "y")
    return pairs.withColumn("difference", F.abs(F.col("ea") - F.col("eb"))).where(F.col("difference") > least)


def n_for_proportions(df: DataFrame, p1: str, p2: str, z_alpha: float = 1.959964, z_beta: float = 0.841621) -> DataFrame:
    """Adds n per group that tells two proportions apart."""
    p, q = F.col(p1), F.col(p2)
    return df.withColumn("n_group", F.ceil(F.pow(F.lit(z_alpha + z_beta), 2) * (p * (1 - p) + q * (1 - q)) / F.pow(p - q, 2)))


def n_for_mcnemar(df: DataFrame, difference: str, discordant: str, z_alpha: float = 1.959964, z_beta: float = 0.841621) -> DataFrame:
    """Adds n pairs that show a difference of paired proportions, given the share of discordant pairs."""
    d, s = F.col(difference), F.col(discordant)
    return df.withColumn("n_pairs", F.ceil(F.pow(z_alpha * F.sqrt(s) + z_beta * F.sqrt(s - d * d), 2) / (d * d)))
