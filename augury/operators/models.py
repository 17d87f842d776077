"""Model pipelines on MLlib: fits, stacking, recalibration, tuning, walk-forward."""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from augury.functions.columns import clip_prob, logit
from augury.operators.ordered import exact_quantiles
from augury.operators.scoring import score_groups
from augury.session import cut_lineage

Builder = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def _doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _prep(cols: Sequence[str], scale: bool = True) -> list:
    imputed = [f"{c}__i" for c in cols]
    stages = [Imputer(strategy="median", inputCols=list(cols), outputCols=imputed),
              VectorAssembler(inputCols=imputed, outputCol="_raw" if scale else "features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return stages


def predict(model: Transformer, df: DataFrame, cols: Sequence[str], out: str = "pred") -> DataFrame:
    """Add the fitted probability and nothing else."""
    base = df.columns
    x = model.transform(_doubles(df, cols))
    return x.withColumn(out, clip_prob(vector_to_array("probability")[1])).select(*[c for c in base if c != out], out)


def penalized_logit(train: DataFrame, cols: Sequence[str], label: str, c: float = 1.0, l1: float = 0.0, max_iter: int = 100) -> PipelineModel:
    """Ridge, lasso or elastic net with median fill and scaling. ``c`` is the inverse total penalty, so
    the per-row penalty is 1 / (n c)."""
    rows = _doubles(train.where(F.col(label).isNotNull()), [*cols, label])
    n = rows.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (max(n, 1) * c), elasticNetParam=l1,
                            maxIter=max_iter, standardization=False)
    return Pipeline(stages=[*_prep(cols), lr]).fit(rows)


def linear_terms(model: PipelineModel) -> tuple[float, dict[str, float]]:
    """Intercept and slopes on the columns' own scale; one number per column."""
    imputer, scaler, lr = model.stages[0], model.stages[2], model.stages[-1]
    names, mean, sd, beta = imputer.getInputCols(), scaler.mean.toArray(), scaler.std.toArray(), lr.coefficients.toArray()
    slopes = {c: (float(b / s) if s > 0 else 0.0) for c, b, s in zip(names, beta, sd)}
    return float(lr.intercept) - sum(slopes[c] * m for c, m in zip(names, mean)), slopes


def binomial_glm(train: DataFrame, cols: Sequence[str], label: str, max_iter: int = 25):
    """Unpenalised binomial fit; the model's ``summary`` has deviance, AIC and standard errors."""
    rows = _doubles(train.where(F.col(label).isNotNull()), [*cols, label])
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=label, maxIter=max_iter)
    return Pipeline(stages=[*_prep(cols), glm]).fit(rows)


def glm_report(model: PipelineModel, spark, n: int) -> DataFrame:
    """AIC, BIC and deviances of a fitted GLM as one row."""
    s = model.stages[-1].summary
    k = len(model.stages[-1].coefficients) + 1
    return spark.createDataFrame([(float(s.aic), float(s.deviance + k * math.log(max(n, 1))), float(s.deviance), float(s.nullDeviance), int(k), int(n))],
                                 "aic double, bic double, deviance double, null_deviance double, parameters int, n long")


def gbt(train: DataFrame, cols: Sequence[str], label: str, depth: int = 4, step: float = 0.05, rounds: int = 300, seed: int = 42) -> PipelineModel:
    t = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=depth, stepSize=step, maxIter=rounds, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[*_prep(cols, False), t]).fit(_doubles(train.where(F.col(label).isNotNull()), [*cols, label]))


def forest(train: DataFrame, cols: Sequence[str], label: str, trees: int = 300, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Random forest; stands for extremely random trees, whose split draws differ."""
    t = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed)
    return Pipeline(stages=[*_prep(cols, False), t]).fit(_doubles(train.where(F.col(label).isNotNull()), [*cols, label]))


def mlp(train: DataFrame, cols: Sequence[str], label: str, hidden: Sequence[int] = (48, 24), max_iter: int = 200, seed: int = 42) -> PipelineModel:
    t = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(cols), *hidden, 2], maxIter=max_iter, seed=seed)
    return Pipeline(stages=[*_prep(cols), t]).fit(_doubles(train.where(F.col(label).isNotNull()), [*cols, label]))


def mlp_gated(train: DataFrame, holdout: DataFrame, cols: Sequence[str], label: str, rival: PipelineModel, gain: float = 0.001, **kw):
    """Keep the perceptron only if its holdout log loss beats the rival's by ``gain``; else None."""
    net = mlp(train, cols, label, **kw)
    loss = {}
    for name, m in (("net", net), ("rival", rival)):
        loss[name] = score_groups(predict(m, holdout, cols), [], label, "pred").first()["log_loss"]
    return (net if loss["net"] <= loss["rival"] - gain else None), loss


class TwoStage:
    """Forests for intermediate targets whose predictions become features of a logistic fit."""

    def __init__(self, train: DataFrame, cols: Sequence[str], targets: Sequence[str], label: str, trees: int = 100, depth: int = 6, seed: int = 42):
        self.cols, self.targets, self.stages = list(cols), list(targets), []
        rows = _doubles(train, [*cols, *targets])
        for t in targets:
            rf = RandomForestRegressor(featuresCol="features", labelCol=t, predictionCol=f"stage_{t}", numTrees=trees, maxDepth=depth, seed=seed)
            self.stages.append(Pipeline(stages=[*_prep(cols, False), rf]).fit(rows.where(F.col(t).isNotNull())))
        self.names = [*cols, *[f"stage_{t}" for t in targets]]
        self.final = penalized_logit(cut_lineage(self._add(train).select(label, *self.names)), self.names, label)  # the forests are asked once

    def _add(self, df: DataFrame) -> DataFrame:
        for t, m in zip(self.targets, self.stages):
            keep = [*df.columns, f"stage_{t}"]
            df = m.transform(_doubles(df, self.cols)).select(*keep)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(self.final, self._add(df), self.names)


def stack(oof: DataFrame, cols: Sequence[str], label: str) -> PipelineModel:
    """Logistic stack of out-of-fold probability columns."""
    return penalized_logit(oof, cols, label, c=0.7)


def recalibrate(train: DataFrame, test: DataFrame, prob: str, label: str, method: str = "platt", out: str = "calibrated") -> DataFrame:
    if method == "platt":
        z = lambda d: d.withColumn("_z", logit(prob))
        return predict(penalized_logit(z(train), ["_z"], label), z(test), ["_z"], out).drop("_z")
    iso = IsotonicRegression(featuresCol="_x", labelCol="_y").fit(
        train.where(F.col(label).isNotNull()).select(F.col(prob).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")))
    x = iso.transform(test.withColumn("_x", F.col(prob).cast("double")))
    return x.withColumn(out, clip_prob("prediction")).drop("_x", "prediction")


def knots(train: DataFrame, cols: Sequence[str], n: int) -> dict[str, list[float]]:
    """Inner quantiles per column; ``n`` numbers per column reach the driver."""
    from augury.functions.columns import stack_long
    probs = [(i + 1) / (n + 1) for i in range(n)]
    q = exact_quantiles(stack_long(train, [], list(cols)), ["feature"], "value", probs).orderBy("feature", "prob").collect()
    out: dict[str, list[float]] = {c: [] for c in cols}
    for r in q:
        if not out[r["feature"]] or r["quantile"] > out[r["feature"]][-1]:
            out[r["feature"]].append(r["quantile"])
    return out


def basis(df: DataFrame, at: Mapping[str, Sequence[float]], degree: int = 1, both: bool = True) -> tuple[DataFrame, list[str]]:
    """Hinge (degree 1) or truncated-power spline columns at given knots."""
    made: dict[str, Column] = {}
    for c, ks in at.items():
        x = F.col(c).cast("double")
        for p in range(1, degree + 1):
            made[f"{c}__p{p}"] = F.pow(x, F.lit(float(p)))
        for i, k in enumerate(ks):
            made[f"{c}__r{i}"] = F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(float(degree)))
            if both and degree == 1:
                made[f"{c}__l{i}"] = F.greatest(k - x, F.lit(0.0))
    return df.withColumns(made), list(made)


def basis_logit(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, n_knots: int = 3, degree: int = 1, c: float = 0.25,
                interactions: bool = False, at: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Hinge-basis or spline-basis logistic fit, with optional products of hinges of different columns. ``at`` has the
    knots where they are known."""
    at = knots(train, cols, n_knots) if at is None else at
    tr, names = basis(train, at, degree)
    te, _ = basis(test, at, degree)
    if interactions:
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if a.split("__")[0] != b.split("__")[0] and "__p" not in a + b]
        prod = {f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in pairs}
        tr, te, names = tr.withColumns(prod), te.withColumns(prod), [*names, *prod]
    base = test.columns
    return predict(penalized_logit(tr, names, label, c=c), te, names).select(*base, "pred")


def mean_dispersion(train: DataFrame, test: DataFrame, cols: Sequence[str], margin: str, iters: int = 2) -> DataFrame:
    """Gaussian mean and log-linear variance of the margin, fitted in turn; P(win) by the normal curve."""
    rows = _doubles(train.where(F.col(margin).isNotNull()), [*cols, margin]).withColumn("_w", F.lit(1.0))
    prep = Pipeline(stages=_prep(cols)).fit(rows)
    x = prep.transform(rows)
    mean = var = None
    for _ in range(iters):
        mean = GeneralizedLinearRegression(family="gaussian", featuresCol="features", labelCol=margin, weightCol="_w", predictionCol="_mu").fit(x.drop("_mu", "_v"))
        r = mean.transform(x.drop("_mu", "_v")).withColumn("_sq", F.greatest(F.pow(F.col(margin) - F.col("_mu"), F.lit(2.0)), F.lit(1e-6)))
        var = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="features", labelCol="_sq", predictionCol="_v").fit(r)
        x = var.transform(r).withColumn("_w", 1.0 / F.greatest("_v", F.lit(1e-6))).drop("_sq")
    base = test.columns
    t = var.transform(mean.transform(prep.transform(_doubles(test, cols))))
    z = F.col("_mu") / F.sqrt(F.greatest("_v", F.lit(1e-6)))
    return t.withColumn("pred", clip_prob(normal_cdf(z))).select(*base, "pred")


def normal_cdf(z: Column) -> Column:
    """Rational approximation, absolute error under 7.5e-8."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def entity_logit(train: DataFrame, test: DataFrame, cols: Sequence[str], entities: Sequence[str], label: str, c: float = 1.0) -> DataFrame:
    """Ridge logistic with one shrunken effect per entity; unseen entities get no effect.

    The one-hot columns are sparse, so the fit scales with rows, not with rows times entities.
    """
    idx = [StringIndexer(inputCol=e, outputCol=f"_ix_{e}", handleInvalid="keep") for e in entities]
    hot = [OneHotEncoder(inputCol=f"_ix_{e}", outputCol=f"_oh_{e}", handleInvalid="keep", dropLast=True) for e in entities]
    rows = _doubles(train.where(F.col(label).isNotNull()), [*cols, label])
    n = rows.count()
    stages = [*_prep(cols)[:2], StandardScaler(inputCol="_raw", outputCol="_num", withMean=True), *idx, *hot,
              VectorAssembler(inputCols=["_num", *[f"_oh_{e}" for e in entities]], outputCol="features", handleInvalid="keep"),
              LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (max(n, 1) * c), standardization=False)]
    return predict(Pipeline(stages=stages).fit(rows), test, cols)


def logit_builder(cols: Sequence[str], label: str, c: float = 1.0, l1: float = 0.0) -> Builder:
    def fit(train: DataFrame):
        m = penalized_logit(train, cols, label, c, l1)
        return lambda df: predict(m, df, cols)
    return fit


def _per_fold(folds: DataFrame, fold_ids: Sequence[int], builder: Builder) -> DataFrame:
    out = None
    for f in fold_ids:
        rows = folds.where(F.col("fold") == f)
        pred = builder(rows.where("role = 'train'"))(rows.where("role = 'valid'"))
        out = pred if out is None else out.unionByName(pred)
    return out


def walk_forward(folds: DataFrame, builders: Mapping[str, Builder], fold_ids: Sequence[int]) -> DataFrame:
    """Out-of-fold predictions, long: the fold's valid rows with ``model`` and ``pred``.

    ``folds`` is a fold table with ``fold`` and ``role``; each model trains only on the fold's past.
    """
    out = None
    for name, b in builders.items():
        p = _per_fold(folds, fold_ids, b).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def width_eval(train: DataFrame, folds: DataFrame, ranked: Sequence[str], widths: Sequence[int], fold_ids: Sequence[int], label: str, c: float = 1.0) -> DataFrame:
    """Cut a ranked feature list to each width and score the walk-forward predictions."""
    grid = {f"width_{w}": logit_builder(list(ranked[:w]), label, c) for w in widths}
    return score_groups(walk_forward(folds, grid, fold_ids), ["model"], label, "pred")
