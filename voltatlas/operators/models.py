"""Regression on tables with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    PolynomialExpansion, RobustScaler, StandardScaler, VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import clip, col, inline_table, or_zero, ratio
from voltatlas.operators import least_squares, trees
from voltatlas.operators.classify import interpret_causal, interpret_fit
from voltatlas.operators.panel import first_difference
from voltatlas.operators.quantiles import exact_quantiles
from voltatlas.session import stored

SEED = 42


# -- scaling -------------------------------------------------------------------------------
def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L1: (x - mean) / population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_s", one).withColumns({
        c: (F.col(c) - F.col(f"_s.m_{c}"))
        / F.when(F.col(f"_s.s_{c}") > 0, F.col(f"_s.s_{c}")).otherwise(1.0)
        for c in cols
    }).drop("_s")


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """L2: (x - median) / interquartile range, with exact quartiles of all columns in one pass."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    q = exact_quantiles(long.select("x.c", "x.v"), "v", {"a": 0.25, "m": 0.5, "b": 0.75}, ["c"], written=True)
    every = q.agg(*[
        F.max(F.when(F.col("c") == c, F.struct("a", "m", "b"))).alias(f"_{i}") for i, c in enumerate(cols)])
    one = every.select(F.struct(*every.columns).alias("q")).scalar()

    def scaled(i: int, c: str):
        own = f"_q._{i}"
        iqr = F.col(f"{own}.b") - F.col(f"{own}.a")
        return (F.col(c) - F.col(f"{own}.m")) / F.when(iqr > 0, iqr).otherwise(1.0)

    return df.withColumn("_q", one).withColumns(
        {c: scaled(i, c) for i, c in enumerate(cols)}).drop("_q")


# -- splits --------------------------------------------------------------------------------
def key_bucket(keys: Sequence[str], buckets: int, seed: int = SEED) -> Column:
    """A bucket that depends on the key only, so it survives any repartitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def holdout_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2,
                  seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """L4."""
    test = key_bucket(keys, 10_000, seed) < int(round(test_share * 10_000))
    return df.where(~test), df.where(test)


def temporal_split(df: DataFrame, cutoff: int = 2020,
                   year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Years before the cutoff against the rest."""
    return df.where(F.col(year) < cutoff), df.where(F.col(year) >= cutoff)


def last_year_split(df: DataFrame, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """The last year is held out."""
    last = df.agg(F.max(year)).scalar()
    return df.where(F.col(year) < last), df.where(F.col(year) == last)


# -- estimators ----------------------------------------------------------------------------
def gradient_boosting(trees: int = 100, depth: int = 4, rate: float = 0.1,
                      min_leaf: int = 1, subsample: float = 1.0) -> GBTRegressor:
    """L6."""
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
                        minInstancesPerNode=min_leaf, seed=SEED)


def random_forest(trees: int = 100, depth: int = 8, min_leaf: int = 1) -> RandomForestRegressor:
    """Every split sees all features, each tree a bootstrap sample."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                 featureSubsetStrategy="all", seed=SEED)


def linear() -> LinearRegression:
    """L8."""
    return LinearRegression(standardization=False)


def ridge(train: DataFrame, label: str, alpha: float = 1.0) -> LinearRegression:
    """Penalty alpha on the sum of squared errors.

    Spark divides the squared error by the number of rows and the penalty by the deviation
    of the label, so alpha is rescaled by both.
    """
    n, s = train.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(regParam=alpha * float(s or 1.0) / max(n, 1), elasticNetParam=0.0,
                            standardization=False, solver="normal")


def elastic_net(alpha: float = 0.1, l1_ratio: float = 0.5) -> LinearRegression:
    """L8."""
    return LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, standardization=False)


def feature_pipeline(features: Sequence[str], estimator: Estimator, label: str,
                     scaler: str | None = "standard", degree: int = 1) -> Pipeline:
    """L1-L3: assemble, expand, scale and fit; everything is fitted on training rows only."""
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="_x0",
                                    handleInvalid="error")]
    x = "_x0"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol=x, outputCol="_x1"))
        x = "_x1"
    if scaler == "standard":
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=x, outputCol="_x2"))
        x = "_x2"
    elif scaler == "robust":
        stages.append(RobustScaler(withCentering=True, inputCol=x, outputCol="_x2"))
        x = "_x2"
    stages.append(estimator.copy().setFeaturesCol(x).setLabelCol(label)
                  .setPredictionCol("prediction"))
    return Pipeline(stages=stages)


def prepare(df: DataFrame, features: Sequence[str], label: str,
            keep: Sequence[str] = ()) -> DataFrame:
    """Model input: missing features are 0, rows without a label drop out."""
    names = list(dict.fromkeys([*keep, *features, label]))
    return df.where(F.col(label).isNotNull()).select(*[
        or_zero(F.col(c).cast("double")).alias(c) if c in features else F.col(c) for c in names])


# -- scores --------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE and RMSE in one aggregate; R2 is NULL for a constant label."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        (1 - ratio(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def fit(train: DataFrame, features: Sequence[str], label: str, estimator: Estimator,
        scaler: str | None = "standard", degree: int = 1) -> PipelineModel:
    """L3: the rows are kept while the stages pass over them, and released."""
    rows = train.select(*dict.fromkeys([*features, label])).persist()
    try:
        return feature_pipeline(features, estimator, label, scaler, degree).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """New or future rows with a prediction; helper columns are dropped."""
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith("_x")])


def _fold_scores(parts: Iterable[tuple[object, DataFrame, DataFrame]], name: str, ddl: str,
                 features: Sequence[str], label: str, estimator: Estimator,
                 scaler: str | None, degree: int = 1) -> DataFrame:
    """One row of scores for each (fold, train, test); the folds are few, the rows are not."""
    out, spark = [], None
    for fold, train, test in parts:
        spark = train.sparkSession
        model = fit(train, features, label, estimator, scaler, degree)
        m = regression_metrics(score(model, test), label).first()
        out.append((fold, m.n, m.r2, m.mae, m.rmse))
    return inline_table(spark, f"{name} {ddl}, n bigint, r2 double, mae double, rmse double", out)


def k_fold(df: DataFrame, features: Sequence[str], label: str, estimator: Estimator,
           keys: Sequence[str], folds: int = 5, scaler: str | None = "standard",
           degree: int = 1) -> DataFrame:
    """Scores of each fold; folds are hash buckets of the key.

    The rows are read once and kept for the passes of all folds.
    """
    marked = df.select(*dict.fromkeys([*features, label]),
                       key_bucket(keys, folds, SEED + 1).cast("int").alias("fold")).persist()
    parts = ((i, marked.where(F.col("fold") != i), marked.where(F.col("fold") == i))
             for i in range(folds))
    try:
        return _fold_scores(parts, "fold", "int", features, label, estimator, scaler, degree)
    finally:
        marked.unpersist()


def expanding_window(df: DataFrame, features: Sequence[str], label: str, estimator: Estimator,
                     splits: int = 3, year: str = "year",
                     scaler: str | None = "standard") -> DataFrame:
    """Each of the last years is predicted from all years before it."""
    kept = df.select(*dict.fromkeys([*features, label, year])).persist()
    try:
        years = [int(r[0]) for r in kept.select(year).distinct().orderBy(F.col(year).desc())
                 .limit(splits).collect()]
        parts = ((y, kept.where(F.col(year) < y), kept.where(F.col(year) == y)) for y in sorted(years))
        return _fold_scores(parts, year, "int", features, label, estimator, scaler)
    finally:
        kept.unpersist()


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return folds.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                     F.count("r2").alias("folds"))


def grid_search(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[dict],
                make: Callable[..., Estimator], keys: Sequence[str], folds: int = 5) -> DataFrame:
    """Mean fold score of each parameter set, best first."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    data = df.withColumn("fold", key_bucket(keys, folds, SEED + 1).cast("int"))
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x0").transform(data)
    est = make(**grid[0]).setFeaturesCol("_x0").setLabelCol(label)
    maps = []
    for g in grid:
        other = make(**g)
        maps.append({q: other.getOrDefault(q.name) for q in est.params
                     if other.hasParam(q.name) and other.isSet(q.name)
                     and q.name not in ("featuresCol", "labelCol")})
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=maps, numFolds=folds, foldCol="fold", parallelism=4,
        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"))
    scores = cv.fit(assembled).avgMetrics
    rows = [(str(sorted(g.items())), float(s)) for g, s in zip(grid, scores)]
    return inline_table(df.sparkSession, "params string, cv_r2_mean double", rows).orderBy(
        F.col("cv_r2_mean").desc(), "params")


def boosting_grid() -> list[dict]:
    """The 48 combinations of the full search, for ``gradient_boosting``.

    The library's trees know the smallest leaf only; ``trees.boosting_grid`` has the smallest split.
    """
    return [
        {"trees": t, "depth": d, "rate": r, "min_leaf": m, "subsample": s}
        for t in (100, 200) for d in (3, 5, 7) for r in (0.05, 0.1)
        for m in (5, 10) for s in (0.8, 1.0)
    ]


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """One row for each feature; linear models give absolute coefficients' shares."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = [abs(c) for c in last.coefficients.toArray()]
        total = sum(values) or 1.0
        values = [v / total for v in values]
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return inline_table(spark, "feature string, importance double", rows)


def compare_models(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                   estimators: dict[str, Estimator],
                   scaler: str | None = "standard") -> DataFrame:
    """Test scores of each model on the same split.

    The training rows are kept for the fits of all models, and all score the test rows in one read.
    """
    rows = train.select(*dict.fromkeys([*features, label])).persist()
    try:
        fitted = {name: feature_pipeline(features, est, label, scaler).fit(rows) for name, est in estimators.items()}
    finally:
        rows.unpersist()
    scored = test.select(*dict.fromkeys([*features, label]))
    for i, model in enumerate(fitted.values()):
        scored = score(model, scored).withColumnRenamed("prediction", f"_p{i}")
    each = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, name in enumerate(fitted)])
    long = scored.select(label, F.explode(each).alias("_each")).select(label, "_each.*")
    return regression_metrics(long, label, by=["model"])


# -- confounding designs -------------------------------------------------------------------
CORRELATION_DESIGNS = ["uncontrolled", "controlled", "per_capita"]
CAUSAL_DESIGNS = ["yoy_change_controlled", "first_difference", "high_intensity_states"]


def confounding_designs(panel: DataFrame, min_rows: int = 30) -> dict[str, tuple]:
    """Name -> (rows, features, target) over a state-year panel.

    The high-intensity design is left out when it has fewer than ``min_rows`` rows.
    """
    small = F.abs(F.col("electricity_pct_change")) < 15
    share = clip(ratio(F.col("cumulative_dc_energy_twh") * 1000, "electricity_gwh") * 100, 0, 100)
    high = panel.where((share > 1.0) & small)
    diff = first_difference(panel, p.DESIGN_DELTAS).where(small)
    per_head = panel.where((F.col("elec_per_capita_mwh") > 0) & (F.col("elec_per_capita_mwh") < 100))
    out = {
        "uncontrolled": (panel, [*p.DESIGN_FACILITY, "year"], "electricity_gwh"),
        "controlled": (panel, [*p.DESIGN_FACILITY, *p.DESIGN_SIZE, "year"], "electricity_gwh"),
        "per_capita": (per_head, [*p.DESIGN_PER_CAPITA, "year"], "elec_per_capita_mwh"),
        "yoy_change_controlled": (panel.where(small), [*p.DESIGN_CHANGE, *p.DESIGN_SIZE],
                                  "electricity_pct_change"),
        "high_intensity_states": (high, [*p.DESIGN_CHANGE, "year"], "electricity_pct_change"),
        "first_difference": (diff, [*p.DESIGN_DELTAS.values(), "year"], "electricity_pct_change"),
    }
    if high.limit(min_rows).count() < min_rows:
        del out["high_intensity_states"]
    return out


def run_designs(designs: dict[str, tuple], estimators: dict[str, Estimator],
                keys: Sequence[str] = ("state", "year"), test_share: float = 0.2) -> DataFrame:
    """Test scores of every model under every design."""
    parts = []
    for name, (rows, features, target) in designs.items():
        data = prepare(rows, features, target, keep=keys)
        train, test = holdout_split(data, keys, test_share)
        scores = compare_models(train, test, features, target, estimators)
        parts.append(scores.withColumn("design", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def design_rows(designs: dict[str, tuple], keys: Sequence[str], test_share: float = 0.2) -> tuple[DataFrame, int]:
    """All designs as one long table ``design, test, x0..., y``, and the number of columns x.

    ``design`` is the place of the design; shorter feature lists are filled up with 0.
    """
    width = max(len(features) for _, features, _ in designs.values())
    test = (key_bucket(keys, 10_000) < int(round(test_share * 10_000))).cast("int")
    parts = [
        prepare(rows, features, target, keep=keys).select(
            F.lit(i).alias("design"), test.alias("test"),
            *[F.col(f).alias(f"x{k}") for k, f in enumerate(features)],
            *[F.lit(0.0).alias(f"x{k}") for k in range(len(features), width)],
            F.col(target).cast("double").alias("y"))
        for i, (rows, features, target) in enumerate(designs.values())]
    return reduce(DataFrame.unionByName, parts), width


def design_suite() -> dict[str, trees.Params | float]:
    """The four models of the suite; a number is the penalty of a ridge."""
    return {
        "gradient_boosting": trees.Params("boost", 200, 5, 0.05, min_leaf=5),
        "random_forest": trees.Params("forest", 200, 8, min_leaf=3),
        "ridge": 1.0,
        "boosting_variant": trees.Params("boost", 300, 4, 0.03, subsample=0.8),
    }


def _suite_job(cells: trees.Summary, job: dict) -> list[dict]:
    own = cells.of(cells.group // 2 == job["design"])
    test = own.group % 2 == 1
    p = trees.Params(**job["params"])
    _, steps = trees.fit(own, ~test, p)
    return [{"design": job["name"], "model": job["model"], **trees.scores(own, test, trees.predicted(p, steps))}]


def run_suite(designs: dict[str, tuple], suite: dict | None = None, keys: Sequence[str] = ("state", "year"),
              test_share: float = 0.2, unit: float = 1e-6) -> DataFrame:
    """``design, model, n, r2, rmse`` of every model under every design, on the same split.

    The long table is written once. One pass sums it for the ridges, one bins it for the trees,
    which grow side by side, a design and model in a task.
    """
    suite = design_suite() if suite is None else suite
    long, width = design_rows(designs, keys, test_share)
    long = stored(long, "design-rows")
    spark, xs, names = long.sparkSession, [f"x{k}" for k in range(width)], list(designs)
    fold = F.col("design") * 2 + F.col("test")
    ridges = {m: a for m, a in suite.items() if not isinstance(a, trees.Params)}
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("design") + 1).alias("design")
    parts = [
        least_squares.pair_scores(long, xs, "y", fold, a).select(name, F.lit(m).alias("model"), "n", "r2", "rmse")
        for m, a in ridges.items()]
    grown = [(m, p) for m, p in suite.items() if isinstance(p, trees.Params)]
    if grown:
        cells = trees.summarise(long, xs, "y", fold, unit, bins=2048)
        jobs = [{"design": i, "name": n, "model": m, "params": asdict(p)} for i, n in enumerate(names) for m, p in grown]
        parts.append(trees.side_by_side(
            spark, cells, jobs, _suite_job, "design string, model string, n long, r2 double, rmse double"))
    return reduce(DataFrame.unionByName, parts)


def design_summary(scores: DataFrame) -> DataFrame:
    """The best model among correlation designs and among causal ones, with a reading."""
    family = F.when(F.col("design").isin(*CORRELATION_DESIGNS), "correlation").when(
        F.col("design").isin(*CAUSAL_DESIGNS), "causal")
    best = (
        scores.withColumn("family", family).where(F.col("family").isNotNull())
        .groupBy("family")
        .agg(F.max_by("model", F.struct("r2", "design", "model")).alias("model"),
             F.max_by("design", F.struct("r2", "design", "model")).alias("design"),
             F.max("r2").alias("r2"))
    )
    return best.withColumn(
        "reading", F.when(F.col("family") == "correlation", interpret_fit("r2"))
        .otherwise(interpret_causal("r2")))


def mean_by(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Baseline prediction: the mean of a group."""
    m = df.groupBy(*by).agg(F.avg(col(label)).alias("prediction"))
    return df.join(m, list(by))
