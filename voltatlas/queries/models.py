"""L1-L17, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas.operators import aggregates as agg
from voltatlas.operators import energy, joins, least_squares, models, panel, trees
from voltatlas.plans import marts
from voltatlas.queries import base, tree_sql
from voltatlas.queries.base import sql, table
from voltatlas.queries.aggregates import _REGION_CELLS
from voltatlas.queries.marts import _SALES_GRID, GROWTH, REGION_PANEL
from voltatlas.queries.panel import _PROJECTED, state_panel, written_panel
from voltatlas.queries.registry import query
from voltatlas.session import stored

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *FEATURES, "l_extendedprice")


def _regions(spark, sf):
    """Region-year panel with model features."""
    df = marts.region_panel(base.sales(spark, sf), base.mapped(spark, sf), minimum=0,
                            base_year=1995)
    return models.prepare(df, marts.REGION_FEATURES, "total_mwh", ["ba_code", "year"])


@query("l01_standard_scale", """
    SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem) AS {c}"
    for c in FEATURES) + " FROM lineitem", {c: 7 for c in FEATURES})
def l01(spark, sf):
    return models.standard_scale(_items(spark, sf), FEATURES).drop("l_extendedprice")


@query("l02_robust_scale", sql("facility") + """
    SELECT data_center_id, (capacity_mw - (SELECT median(capacity_mw) FROM facility))
        / (SELECT quantile_cont(capacity_mw, 0.75) - quantile_cont(capacity_mw, 0.25)
           FROM facility) AS capacity_mw FROM facility""", {"capacity_mw": 7})
def l02(spark, sf):
    df = base.facilities(spark, sf).select("data_center_id", "capacity_mw")
    return models.robust_scale(df, ["capacity_mw"])


_SPLIT = """CASE WHEN CAST('0x' || substr(md5('42|' || CAST(l_orderkey AS VARCHAR) || '|'
    || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000 THEN 1 ELSE 0 END"""
_SQUARES = [*FEATURES, *[f"{a}__{b}" for i, a in enumerate(FEATURES) for b in FEATURES[i:]]]


def _descent(features, rows, l1, l2, steps):
    """``solved(slopes, intercept)`` of ``rows`` by coordinate descent on lists of covariances.

    ``l1`` and ``l2`` are penalties in units of the mean squared error of scaled features.
    """
    p = len(features)
    cov = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in features) + "]" for a in features)
    return f"""moments AS (
      SELECT count(*) AS n, [{", ".join(f"avg({f})" for f in features)}] AS mean, avg(y) AS my, [{cov}] AS g,
        [{", ".join(f"covar_pop({f}, y)" for f in features)}] AS c,
        [{", ".join(f"stddev_samp({f})" for f in features)}] AS sd FROM {rows}),
    scaled AS (
      SELECT n, mean, my, sd, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 1}),
          lambda j: g[i][j] / (sd[i] * sd[j]))) AS g,
        list_transform(range(1, {p + 1}), lambda i: c[i] / sd[i]) AS c, {l1} AS l1, {l2} AS l2 FROM moments),
    descent(k, b) AS (
      SELECT 0, list_transform(range({p}), lambda x: 0::DOUBLE) UNION ALL
      SELECT k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i <> k % {p} + 1 THEN b[i] ELSE
          sign(r) * greatest(abs(r) - l1, 0) / (g[i][i] + l2) END)
      FROM (SELECT k, b, g, l1, l2, c[k % {p} + 1] - list_dot_product(g[k % {p} + 1], b)
          + g[k % {p} + 1][k % {p} + 1] * b[k % {p} + 1] AS r FROM descent, scaled WHERE k < {steps})),
    solved AS (
      SELECT slopes, my - list_dot_product(slopes, mean) AS intercept FROM (
        SELECT list_transform(range(1, {p + 1}), lambda i: b[i] / sd[i]) AS slopes, mean, my
        FROM descent, scaled WHERE k = {steps}))"""


@query("l03_polynomial_ridge", f"""WITH RECURSIVE items AS (
      SELECT {_SPLIT} AS fold, l_extendedprice AS y, {", ".join(FEATURES)}, {", ".join(
          f"{a} * {b} AS {a}__{b}" for i, a in enumerate(FEATURES) for b in FEATURES[i:])} FROM lineitem),
    train AS (SELECT * FROM items WHERE fold = 0),
    {_descent(_SQUARES, "train", "0", "1.0 / n", 9 * 800)}
    SELECT 1 AS fold, 1.0::DOUBLE AS alpha, count(*) AS n, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2,
      sqrt(avg(pow(y - p, 2))) AS rmse
    FROM (SELECT y, intercept + list_dot_product(slopes, [{", ".join(_SQUARES)}]) AS p FROM items, solved WHERE fold = 1)""",
       {"r2": 7, "rmse": 3})
def l03(spark, sf):
    """Degree 2, fitted and scored from one scan: the sums of both parts of the split."""
    keys = ["l_orderkey", "l_linenumber"]
    rows, names = least_squares.squares(_items(spark, sf), FEATURES)
    test = (models.key_bucket(keys, 10_000) < 2_000).cast("int")
    return least_squares.fold_scores(rows, names, "l_extendedprice", test, [1.0]).filter("fold = 1")


@query("l03_polynomial_rows")
def l03_rows(spark, sf):
    """The same model as a pipeline of expansion, scaling and fit."""
    train, test = models.holdout_split(_items(spark, sf), ["l_orderkey", "l_linenumber"])
    model = models.fit(train, FEATURES, "l_extendedprice",
                       models.ridge(train, "l_extendedprice"), degree=2)
    return models.regression_metrics(models.score(model, test), "l_extendedprice")


@query("l04_holdout_split", """
    SELECT l_orderkey, l_linenumber, CASE WHEN CAST('0x' || substr(md5('42|'
        || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT)
        % 10000 < 2000 THEN 'test' ELSE 'train' END AS part FROM lineitem""")
def l04(spark, sf):
    train, test = models.holdout_split(
        _items(spark, sf).select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test")))


@query("l05_temporal_split", sql("electricity") + """
    SELECT state, year, CASE WHEN year < 1999 THEN 'train' ELSE 'test' END AS part,
        CASE WHEN year = (SELECT max(year) FROM electricity) THEN 'held out' ELSE 'kept' END AS last
    FROM electricity""")
def l05(spark, sf):
    e = stored(base.electricity(spark, sf).select("state", "year"), "electricity")
    train, test = models.temporal_split(e, 1999)
    kept, held = models.last_year_split(e)
    first = train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test")))
    second = kept.withColumn("last", F.lit("kept")).unionByName(
        held.withColumn("last", F.lit("held out")))
    return first.join(second, ["state", "year"])


# Ensembles with the settings and tree counts of the full models. Features and label are rounded
# before they are fitted, in the same way on both sides: cuts compare values of doubles.
BOOSTED = trees.Params("boost", 150, 4, 0.1, min_leaf=5, l2=1.0)
FOREST = trees.Params("forest", 150, 6, min_split=5)
_REGION_LABEL = 1000.0


def _rounded(df, features, label, unit):
    return df.withColumns({
        **{f: F.floor(F.col(f).cast("double") * 1e4 + 0.501) / 1e4 for f in features},
        label: F.floor(F.col(label) / unit + 0.501).cast("double")})


def _region_rows(spark, sf):
    """Region-year rows, written once for all passes of a fit, and the last year."""
    rows = stored(_rounded(_regions(spark, sf), marts.REGION_FEATURES, "total_mwh", _REGION_LABEL), "region-rows")
    return rows, int(rows.agg(F.max("year")).first()[0])


def _region_model(rows, last, params):
    cells = trees.summarise(rows, marts.REGION_FEATURES, "total_mwh", F.col("year"))
    return trees.fit(cells, cells.group < last, params)[0]


_REGION_ROWS = f"""panel AS ({REGION_PANEL.replace("g.year - 1996", "g.year - 1995")}),
    rows AS (SELECT row_number() OVER (ORDER BY ba_code, year) AS id, ba_code, year, year AS g,
      year < (SELECT max(year) FROM panel) AS train, floor(total_mwh / 1000 + 0.501::DOUBLE) AS y, {", ".join(
    f"floor({f}::DOUBLE * 1e4 + 0.501::DOUBLE) / 1e4 AS {f}" for f in marts.REGION_FEATURES)} FROM panel)"""


def _region_sql(params, select, more="", rows="rows"):
    grown = tree_sql.boosted(params) if params.kind == "boost" else tree_sql.forest(params)
    return sql("sales", "mapped", more=f"""{_REGION_CELLS}, {_SALES_GRID}, {_REGION_ROWS}{more},
    {tree_sql.points(marts.REGION_FEATURES, rows)}, {grown}""").replace("WITH ", "WITH RECURSIVE ", 1) + select


_METRICS = """
    SELECT count(*) AS n, 1 - avg(pow(y - units, 2)) / var_pop(y) AS r2, avg(abs(y - units)) AS mae,
        sqrt(avg(pow(y - units, 2))) AS rmse FROM rows JOIN fitted USING (id) WHERE NOT train"""
_METRIC_DIGITS = {"r2": 8, "mae": 4, "rmse": 4}


def _test_scores(spark, sf, params):
    rows, last = _region_rows(spark, sf)
    model = _region_model(rows, last, params)
    return models.regression_metrics(
        trees.score(model, rows.filter(F.col("year") == last)), "total_mwh")


@query("l06_gradient_boosting", _region_sql(BOOSTED, _METRICS), _METRIC_DIGITS)
def l06(spark, sf):
    return _test_scores(spark, sf, BOOSTED)


@query("l07_random_forest", _region_sql(FOREST, _METRICS), _METRIC_DIGITS)
def l07(spark, sf):
    return _test_scores(spark, sf, FOREST)


_PREDICTIONS = "SELECT ba_code, year, units AS prediction FROM rows JOIN fitted USING (id)"


@query("l06_boosted_rows", _region_sql(BOOSTED, _PREDICTIONS), {"prediction": 3})
def l06_rows(spark, sf):
    """The ensemble as one expression."""
    rows, last = _region_rows(spark, sf)
    return rows.select("ba_code", "year", _region_model(rows, last, BOOSTED).column().alias("prediction"))


@query("l07_forest_rows", _region_sql(FOREST, _PREDICTIONS), {"prediction": 3})
def l07_rows(spark, sf):
    rows, last = _region_rows(spark, sf)
    return trees.score(_region_model(rows, last, FOREST), rows).select("ba_code", "year", "prediction")


# The growth of one category: 100 trees of depth 4 without a least leaf, a fifth of the rows held out.
GROWN = trees.Params("boost", 100, 4, 0.1)
_GROWTH_KEYS = ["state", "year"]


def _growth_sql(select):
    return sql("categorized", "electricity", more=f"""{GROWTH},
    rows AS (SELECT row_number() OVER (ORDER BY state, year) AS id, state, year, held::INTEGER AS g, NOT held AS train,
      floor(yoy_change_mwh / 1000 + 0.501::DOUBLE) AS y, {", ".join(
          f"floor({f} + 0.501::DOUBLE) AS {f}" for f in marts.GROWTH_FEATURES)}
      FROM (SELECT *, CAST('0x' || substr(md5('42|' || state || '|' || CAST(year AS VARCHAR)), 1, 8) AS BIGINT)
        % 10000 < 2000 AS held FROM growth_rows)),
    {tree_sql.points(marts.GROWTH_FEATURES)}, {tree_sql.boosted(GROWN)}""").replace(
        "WITH ", "WITH RECURSIVE ", 1) + select


def _growth(spark, sf):
    """Rows of the growth table in whole units, written once, and the model of those not held out."""
    table = marts.category_growth_table(base.categorized(spark, sf), base.electricity(spark, sf))
    rows = stored(table.withColumns({
        **{f: F.floor(F.col(f) + 0.501).cast("double") for f in marts.GROWTH_FEATURES},
        "yoy_change_mwh": F.floor(F.col("yoy_change_mwh") / 1000.0 + 0.501).cast("double")}), "growth-rows")
    held = (models.key_bucket(_GROWTH_KEYS, 10_000) < 2_000).cast("int")
    cells = trees.summarise(rows, marts.GROWTH_FEATURES, "yoy_change_mwh", held)
    return rows, trees.fit(cells, cells.group == 0, GROWN)[0]


@query("l06_category_growth_rows", _growth_sql("SELECT state, year, units AS prediction FROM rows JOIN fitted USING (id)"),
       {"prediction": 3})
def l06_growth_rows(spark, sf):
    rows, model = _growth(spark, sf)
    return trees.score(model, rows).select("state", "year", "prediction")


@query("l06_category_growth", _growth_sql(_METRICS), _METRIC_DIGITS)
def l06_growth(spark, sf):
    rows, model = _growth(spark, sf)
    _, held = models.holdout_split(rows, _GROWTH_KEYS)
    return models.regression_metrics(trees.score(model, held), "yoy_change_mwh")


# A tree of one split on a feature with few values: the split with the least squared error.
_STUMP = """
    WITH v AS (SELECT l_linenumber AS v, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
    cuts AS (SELECT c.v AS cut,
        sum(s) FILTER (WHERE v.v <= c.v) / sum(n) FILTER (WHERE v.v <= c.v) AS low,
        sum(s) FILTER (WHERE v.v > c.v) / sum(n) FILTER (WHERE v.v > c.v) AS high,
        pow(sum(s) FILTER (WHERE v.v <= c.v), 2) / sum(n) FILTER (WHERE v.v <= c.v)
        + pow(sum(s) FILTER (WHERE v.v > c.v), 2) / sum(n) FILTER (WHERE v.v > c.v) AS gain
      FROM v, (SELECT v FROM v WHERE v < (SELECT max(v) FROM v)) c GROUP BY c.v),
    best AS (SELECT * FROM cuts ORDER BY gain DESC, cut LIMIT 1)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= cut THEN low ELSE high END AS prediction
    FROM lineitem, best"""


def _stump(spark, sf, estimator):
    rows = _items(spark, sf)
    model = models.fit(rows, ["l_linenumber"], "l_extendedprice", estimator, scaler=None)
    return models.score(model, rows).select("l_orderkey", "l_linenumber", "prediction")


@query("l06_boosted_stump", _STUMP, {"prediction": 3})
def l06_stump(spark, sf):
    return _stump(spark, sf, models.gradient_boosting(1, 1))


@query("l07_forest_stump", _STUMP, {"prediction": 3})
def l07_stump(spark, sf):
    return _stump(spark, sf, models.random_forest(1, 1).setBootstrap(False))


@query("l08_linear", """
    SELECT l_orderkey, l_linenumber, a + b * l_quantity AS prediction FROM lineitem,
        (SELECT regr_intercept(l_extendedprice, l_quantity) AS a,
                regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)""", {"prediction": 3})
def l08(spark, sf):
    rows = _items(spark, sf)
    model = models.fit(rows, ["l_quantity"], "l_extendedprice", models.linear())
    return models.score(model, rows).select("l_orderkey", "l_linenumber", "prediction")


# With one standardised feature the penalised slope has a closed form. The scaler divides by
# the sample deviation, so the sum of squares of the scaled feature is n - 1.
@query("l08_ridge", """
    SELECT l_orderkey, l_linenumber, m + (l_quantity - q) / s * (c / (n - 1 + 1000)) AS prediction
    FROM lineitem, (SELECT avg(l_extendedprice) AS m, avg(l_quantity) AS q,
        stddev_samp(l_quantity) AS s, count(*) AS n,
        covar_pop(l_extendedprice, l_quantity) * count(*) / stddev_samp(l_quantity) AS c
        FROM lineitem)""", {"prediction": 3})
def l08_ridge(spark, sf):
    rows = _items(spark, sf)
    model = models.fit(rows, ["l_quantity"], "l_extendedprice",
                       models.ridge(rows, "l_extendedprice", alpha=1000.0))
    return models.score(model, rows).select("l_orderkey", "l_linenumber", "prediction")


# The penalty keeps the slope of the quantity and shrinks the other two to 0 or near it.
@query("l08_elastic_net", f"""WITH RECURSIVE items AS (
      SELECT l_orderkey, l_linenumber, l_extendedprice AS y, {", ".join(FEATURES)} FROM lineitem),
    {_descent(FEATURES, "items", "100.0 * 0.5", "100.0 * 0.5", 300)}
    SELECT l_orderkey, l_linenumber, intercept + list_dot_product(slopes, [{", ".join(FEATURES)}]) AS prediction
    FROM items, solved""", {"prediction": 3})
def l08_elastic(spark, sf):
    rows = _items(spark, sf)
    line = least_squares.fit_line(rows, FEATURES, "l_extendedprice", 100.0, 0.5)
    return rows.select("l_orderkey", "l_linenumber", line.column().alias("prediction"))


@query("l08_elastic_net_pipeline")
def l08_pipeline(spark, sf):
    rows = _items(spark, sf)
    model = models.fit(rows, FEATURES, "l_extendedprice", models.elastic_net())
    return models.regression_metrics(models.score(model, rows), "l_extendedprice")


_KEYS = ["l_orderkey", "l_linenumber"]
_FOLD = """CAST('0x' || substr(md5('43|' || CAST(l_orderkey AS VARCHAR) || '|'
    || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) % 5"""
_SCORES = """scores AS (SELECT t.fold, any_value(alpha) AS alpha, count(*) AS n,
        1 - avg(pow(y - a - b * x, 2)) / var_pop(y) AS r2, sqrt(avg(pow(y - a - b * x, 2))) AS rmse
      FROM rows t JOIN fits f ON f.fold = t.fold GROUP BY t.fold, alpha)"""


def _fold():
    return models.key_bucket(_KEYS, 5, models.SEED + 1)


@query("l09_k_fold")
def l09(spark, sf):
    return models.fold_summary(least_squares.fold_scores(
        _items(spark, sf), FEATURES, "l_extendedprice", _fold()))


@query("l09_k_fold_one_feature", f"""
    WITH rows AS (SELECT {_FOLD} AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    fits AS (SELECT k.fold, 0.0::DOUBLE AS alpha, regr_intercept(y, x) AS a, regr_slope(y, x) AS b
      FROM rows r, (SELECT DISTINCT fold FROM rows) k WHERE r.fold <> k.fold GROUP BY k.fold),
    {_SCORES} SELECT CAST(fold AS INTEGER) AS fold, alpha, n, r2, rmse FROM scores""",
       {"r2": 8, "rmse": 4})
def l09_one(spark, sf):
    return least_squares.fold_scores(_items(spark, sf), ["l_quantity"], "l_extendedprice", _fold())


@query("l10_expanding_window_linear", f"""
    WITH rows AS (SELECT year(l_shipdate) AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    fits AS (SELECT k.fold, 0.0::DOUBLE AS alpha, regr_intercept(y, x) AS a, regr_slope(y, x) AS b
      FROM rows r, (SELECT DISTINCT fold FROM rows ORDER BY fold DESC LIMIT 3) k
      WHERE r.fold < k.fold GROUP BY k.fold),
    {_SCORES} SELECT CAST(fold AS INTEGER) AS fold, alpha, n, r2, rmse FROM scores""",
       {"r2": 8, "rmse": 4})
def l10_linear(spark, sf):
    items = table(spark, sf, "lineitem")
    return least_squares.fold_scores(
        items, ["l_quantity"], "l_extendedprice", F.year("l_shipdate"), last=3)


# One standardised feature has the penalised slope sxy / (sxx + alpha * s * s), s sample deviation.
@query("l11_ridge_grid", f"""
    WITH rows AS (SELECT {_FOLD} AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    sums AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my, count(*) AS n, regr_sxy(y, x) AS sxy,
        regr_sxx(y, x) AS sxx FROM rows r, (SELECT DISTINCT fold FROM rows) k
      WHERE r.fold <> k.fold GROUP BY k.fold),
    fits AS (SELECT fold, alpha, my - b * mx AS a, b FROM (SELECT *, sxy / (sxx
        + alpha * sxx / (n - 1)) AS b FROM sums, (SELECT unnest([0.0, 10.0, 1000.0, 100000.0]::DOUBLE[])
        AS alpha))),
    {_SCORES} SELECT alpha, avg(r2) AS cv_r2_mean FROM scores GROUP BY alpha""", {"cv_r2_mean": 8})
def l11_ridge(spark, sf):
    return least_squares.grid_scores(least_squares.fold_scores(
        _items(spark, sf), ["l_quantity"], "l_extendedprice", _fold(), [0.0, 10.0, 1e3, 1e5]))


@query("l10_expanding_window")
def l10(spark, sf):
    """The three windows side by side, over one summary."""
    rows, _ = _region_rows(spark, sf)
    cells = trees.summarise(rows, marts.REGION_FEATURES, "total_mwh", F.col("year"))
    return trees.fold_scores(spark, cells, [BOOSTED, FOREST], last=3)


# Features of the state model that the tuned forecast can project.
AHEAD = ["cumulative_dc_mw", "cumulative_dc_count", "population_millions", "gdp_billions", "dc_intensity"]


def _state_cells(grid):
    rows = models.prepare(grid, AHEAD, "electricity_gwh", ["state", "year"])
    fold = models.key_bucket(["state", "year"], 5, models.SEED + 1)
    return trees.summarise(rows, AHEAD, "electricity_gwh", fold, unit=1e-3)


@query("l11_grid_search")
def l11(spark, sf):
    """All 48 points and 5 folds."""
    cells = _state_cells(written_panel(spark, sf))
    return trees.grid_search(spark, cells, trees.boosting_grid())


@query("l12_regression_metrics", """
    SELECT n, 1 - sse / sst AS r2, mae, rmse FROM (
        SELECT count(*) AS n, avg(pow(y - p, 2)) AS sse, var_pop(y) AS sst,
            avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse
        FROM (SELECT l_extendedprice AS y, avg(l_extendedprice)
            OVER (PARTITION BY l_quantity) AS p FROM lineitem))""",
       {"r2": 9, "mae": 4, "rmse": 4})
def l12(spark, sf):
    scored = models.mean_by(_items(spark, sf), "l_extendedprice", ["l_quantity"])
    return models.regression_metrics(scored, "l_extendedprice")


_NAMES = ", ".join(f"'{f}'" for f in marts.REGION_FEATURES)


@query("l13_feature_importance", _region_sql(FOREST, f""",
    gains AS (SELECT cut, sum(gain) AS gain FROM (
        SELECT DISTINCT t, k, node // 2 AS top, cut, gain FROM grown WHERE cut >= 0) GROUP BY cut)
    SELECT row_number() OVER (ORDER BY coalesce(gain, 0) DESC, name)::INTEGER AS rank, name AS feature,
      round(coalesce(gain, 0) / (SELECT sum(gain) FROM gains) * 100, 2) AS importance_pct
    FROM (SELECT unnest([{_NAMES}]) AS name, unnest(range({len(marts.REGION_FEATURES)})) AS cut) f
    LEFT JOIN gains USING (cut) ORDER BY rank LIMIT 10"""))
def l13(spark, sf):
    rows, last = _region_rows(spark, sf)
    model = _region_model(rows, last, FOREST)
    return joins.rank_importances(models.inline_table(
        spark, "feature string, importance double",
        list(zip(marts.REGION_FEATURES, model.importances(), strict=True))))


# Rows with another row's value of one feature go through the same trees without being fitted.
_MOVED = ", ".join(
    f"CASE WHEN permuted = '{f}' THEN coalesce(lag({f}) OVER w, last({f}) OVER every) ELSE {f} END AS {f}"
    for f in marts.REGION_FEATURES)
_PERMUTED = f""",
    moved AS (SELECT id, g, y, permuted, {_MOVED}
      FROM rows, (SELECT unnest([{_NAMES}]) AS permuted)
      WINDOW w AS (PARTITION BY permuted, year ORDER BY ba_code), every AS (PARTITION BY permuted, year ORDER BY
        ba_code ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    both_rows AS (SELECT id, g, train, y, NULL::VARCHAR AS permuted, {", ".join(marts.REGION_FEATURES)} FROM rows
      UNION ALL SELECT id + 1000000 * list_position([{_NAMES}], permuted), g, false, y, permuted,
        {", ".join(marts.REGION_FEATURES)} FROM moved)"""


@query("l13_permutation_importance", _region_sql(FOREST, """,
    mse AS (SELECT permuted, avg(pow(y - units, 2)) AS mse FROM both_rows JOIN fitted USING (id) GROUP BY 1)
    SELECT permuted AS feature, mse - (SELECT mse FROM mse WHERE permuted IS NULL) AS mse_increase
    FROM mse WHERE permuted IS NOT NULL""", _PERMUTED, "both_rows"), {"mse_increase": 2})
def l13_permutation(spark, sf):
    rows, last = _region_rows(spark, sf)
    return trees.permutation_importance(_region_model(rows, last, FOREST), rows, "total_mwh", ["ba_code"], ["year"])


@query("l14_compare_models")
def l14(spark, sf):
    """The panel is written once for all passes; a forest's samples follow the rows' places, so regions keep theirs."""
    rows = stored(_regions(spark, sf), "region-rows").repartition("ba_code").sortWithinPartitions("ba_code", "year")
    train, test = models.last_year_split(rows)
    return models.compare_models(train, test, marts.REGION_FEATURES, "total_mwh", {
        "ridge": models.ridge(train, "total_mwh"), "elastic_net": models.elastic_net(),
        "random_forest": models.random_forest(20, 5),
        "gradient_boosting": models.gradient_boosting(10, 3)})


@query("l14_tree_models", _region_sql(BOOSTED, """,
    boosted AS (SELECT 'gradient_boosting' AS model, y, units FROM rows JOIN fitted USING (id) WHERE NOT train)
    SELECT model, count(*) AS n, 1 - avg(pow(y - units, 2)) / var_pop(y) AS r2,
      sqrt(avg(pow(y - units, 2))) AS rmse FROM boosted GROUP BY 1 UNION ALL (""" + _region_sql(FOREST, """
    SELECT 'random_forest', count(*), 1 - avg(pow(y - units, 2)) / var_pop(y), sqrt(avg(pow(y - units, 2)))
    FROM rows JOIN fitted USING (id) WHERE NOT train)""")), {"r2": 8, "rmse": 4})
def l14_trees(spark, sf):
    rows, last = _region_rows(spark, sf)
    cells = trees.summarise(rows, marts.REGION_FEATURES, "total_mwh", F.col("year"))
    scored = trees.fold_scores(spark, cells, [BOOSTED, FOREST], last=1)
    kind = F.get_json_object("params", "$.kind")
    return scored.select(
        F.when(kind == "boost", "gradient_boosting").otherwise("random_forest").alias("model"), "n", "r2", "rmse")


@query("l15_confounding_designs")
def l15(spark, sf):
    """Four models under every design; the high-intensity one needs 30 rows."""
    designs = models.confounding_designs(written_panel(spark, sf))
    return models.run_suite(designs)


@query("l16_suite_summary")
def l16_suite(spark, sf):
    return models.design_summary(l15(spark, sf))


_DESIGN_SCORES = """scores AS (
    SELECT n_name AS model, CASE n_nationkey % 7 WHEN 0 THEN 'uncontrolled' WHEN 1 THEN 'controlled'
        WHEN 2 THEN 'per_capita' WHEN 3 THEN 'yoy_change_controlled' WHEN 4 THEN 'first_difference'
        WHEN 5 THEN 'high_intensity_states' ELSE 'other' END AS design,
        pow(corr(l_quantity, l_extendedprice), 2) AS r2
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    GROUP BY n_name, n_nationkey)"""


@query("l16_design_summary", f"""WITH {_DESIGN_SCORES},
    f AS (SELECT *, CASE WHEN design IN ('uncontrolled', 'controlled', 'per_capita')
        THEN 'correlation' ELSE 'causal' END AS family FROM scores WHERE design <> 'other')
    SELECT family, arg_max(model, r2) AS model, arg_max(design, r2) AS design, max(r2) AS r2,
        CASE WHEN family = 'causal' THEN CASE WHEN max(r2) > 0.05 THEN 'Detectable' ELSE 'Weak' END
          ELSE CASE WHEN max(r2) > 0.5 THEN 'Strong' WHEN max(r2) > 0.2 THEN 'Moderate'
            ELSE 'Weak' END END AS reading FROM f GROUP BY 1""", {"r2": 9})
def l16(spark, sf):
    names = [*models.CORRELATION_DESIGNS, "yoy_change_controlled", "first_difference",
             "high_intensity_states", "other"]
    design = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("n_nationkey") % 7 + 1)
    scores = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("model"), design.alias("design"))
        .agg(F.pow(agg.safe_corr("l_quantity", "l_extendedprice"), 2).alias("r2"))
    )
    return models.design_summary(scores)


@query("l17_score_projection")
def l17(spark, sf):
    """The best point of the full search, fitted on all rows, scores the projected years."""
    grid = written_panel(spark, sf)
    cells = _state_cells(grid)
    best = trees.best_params(trees.grid_search(spark, cells, trees.boosting_grid()))
    model, _ = trees.fit(cells, cells.group >= 0, best)
    ahead = panel.project_forward(grid, [2002, 2003, 2005])
    scored = trees.score(model, models.prepare(ahead, AHEAD, "electricity_gwh", ["state", "year"]))
    baseline = energy.latest_period(grid).agg(F.sum("electricity_gwh")).scalar()
    return panel.projection_summary(
        scored.withColumnRenamed("prediction", "predicted_electricity_gwh"), baseline)


@query("l17_score_linear", sql("facility", "electricity", "nation_dim", more=f"""{_PROJECTED},
    f AS (SELECT regr_intercept(electricity_gwh, cumulative_dc_mw) AS a,
        regr_slope(electricity_gwh, cumulative_dc_mw) AS b FROM panel)""") + """
    SELECT state, year, a + b * cumulative_dc_mw AS prediction FROM projected, f""", {"prediction": 4})
def l17_linear(spark, sf):
    grid = state_panel(spark, sf)
    features = ["cumulative_dc_mw"]
    model = models.fit(models.prepare(grid, features, "electricity_gwh"), features,
                       "electricity_gwh", models.linear())
    ahead = models.prepare(panel.project_forward(grid, [2002, 2003, 2005]), features,
                           "electricity_gwh", ["state", "year"])
    return models.score(model, ahead).select("state", "year", "prediction")
