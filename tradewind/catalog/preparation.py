"""Quality, cleaning, scaling, encoding and selection queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tradewind.catalog.registry import query
from tradewind.functions import rowwise as R
from tradewind.operators import clean as C
from tradewind.operators import features as X
from tradewind.operators import quality as Q
from tradewind.sources.adapters import SERIES, VIEWS, _select

# Line items with gaps, outliers, a sparse column and repeated rows, derived per row.
MEASURES = {
    "k1": "l_orderkey", "k2": "l_partkey", "k3": "l_suppkey", "k4": "CAST(l_linenumber AS BIGINT)",
    "quantity": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END",
    "price": "CASE WHEN l_partkey % 503 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END",
    "discount": "CASE WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN NULL ELSE l_discount END",
    "sparse": "CASE WHEN l_linenumber < 3 THEN l_tax END",
    "flag": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END",
    "status": "l_linestatus",
}
VIEWS["measures"] = ((), "SELECT " + ", ".join(f"{e} AS {n}" for n, e in MEASURES.items()) + " FROM lineitem")
VALUES = ["quantity", "price", "discount", "sparse", "flag", "status"]
NUMBERS = ["quantity", "price", "discount", "sparse"]


def measures(t, *columns):
    return t.lineitem.selectExpr(*[f"{MEASURES[c]} AS {c}" for c in (columns or MEASURES)])


def _profile(c: str) -> str:
    if c in NUMBERS:
        return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, min({c}) AS low, max({c}) AS high,
            avg({c}) AS mean, stddev_samp({c}) AS std, (SELECT count(*) FROM measures, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM measures)
            WHERE abs({c} - m) / nullif(s, 0) > 3) AS outliers FROM measures"""
    return f"SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL FROM measures"


PROFILE = " UNION ALL ".join(_profile(c) for c in VALUES)


@query("quality_profile", PROFILE, uses="measures", rnd="low high mean std", places=4)
def quality_profile(t):
    return Q.quality_profile(measures(t, *VALUES)).drop("type")


DUPES = f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(VALUES)} FROM measures)) FROM measures)"


@query("quality_score", f"""WITH p AS ({PROFILE}), s AS (SELECT max(rows) AS rows, CAST(sum(nulls) AS BIGINT) AS missing,
    CAST(sum(outliers) AS BIGINT) AS outliers, {DUPES} AS duplicates FROM p)
    SELECT rows, missing, outliers, duplicates, greatest(0.0, least(1.0, 0.5 * (1 - missing / (rows * 6)) + 0.3 * (1 - duplicates / rows)
    + 0.2 * (1 - outliers / (rows * 6)))) AS score FROM s""", uses="measures", rnd="score")
def quality_score(t):
    return Q.quality_score(measures(t, *VALUES))


PAIRS = list(combinations(NUMBERS, 2))
CORR = " UNION ALL ".join(f'SELECT \'{a}\' AS "left", \'{b}\' AS "right", corr({a}, {b}) AS correlation FROM measures' for a, b in PAIRS)


@query("correlation_pairs", CORR, uses="measures", rnd="correlation")
def correlation_pairs(t):
    return Q.correlation_pairs(measures(t, *NUMBERS), NUMBERS)


@query("quality_recommendations", f"""WITH p AS ({PROFILE}), c AS ({CORR})
    SELECT 'high_missing' AS rule, "column", nulls / rows AS detail FROM p WHERE nulls / rows > 0.3
    UNION ALL SELECT 'impute', "column", nulls / rows FROM p WHERE nulls > 0 AND nulls / rows <= 0.3
    UNION ALL SELECT 'outliers', "column", outliers / rows FROM p WHERE outliers / rows > 0.1
    UNION ALL SELECT 'duplicates', '*', {DUPES} WHERE {DUPES} > 0
    UNION ALL SELECT 'encode', "column", NULL FROM p WHERE "column" IN ('flag', 'status')
    UNION ALL SELECT 'few_rows', '*', rows FROM p WHERE rows < 1000 AND "column" = 'flag'
    UNION ALL SELECT 'correlated', concat("left", ',', "right"), abs(correlation) FROM c WHERE abs(correlation) > 0.9""",
       uses="measures", rnd="detail")
def quality_recommendations(t):
    return Q.recommendations(measures(t, *VALUES))


@query("distinct_counts", """SELECT 'flag' AS "column", count(DISTINCT flag) AS distinct_values FROM measures UNION ALL
    SELECT 'status', count(DISTINCT status) FROM measures UNION ALL SELECT 'k2', count(DISTINCT k2) FROM measures""", uses="measures")
def distinct_counts(t):
    return Q.distinct_counts(measures(t), ["flag", "status", "k2"])


@query("redundant_features", """WITH f AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_tax AS c, l_quantity + l_discount AS d FROM lineitem),
    r AS (SELECT abs(corr(a, b)) AS ab, abs(corr(a, c)) AS ac, abs(corr(a, d)) AS ad, abs(corr(b, c)) AS bc, abs(corr(c, d)) AS cd FROM f)
    SELECT 'a' AS feature UNION ALL SELECT 'b' FROM r WHERE ab <= 0.95 UNION ALL SELECT 'c' FROM r WHERE ac <= 0.95
    AND (ab > 0.95 OR bc <= 0.95) UNION ALL SELECT 'd' FROM r WHERE ad <= 0.95 AND cd <= 0.95""")
def redundant_features(t):
    f = t.lineitem.selectExpr("l_quantity AS a", "l_quantity * 2 + l_tax AS b", "l_tax AS c", "l_quantity + l_discount AS d")
    kept = Q.redundant_features(f, ["a", "b", "c", "d"])
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


@query("distinct_rows", f"SELECT DISTINCT {', '.join(VALUES)} FROM measures", uses="measures")
def distinct_rows(t):
    return measures(t, *VALUES).dropDuplicates()


TYPED = {
    "event_id": "event_id",
    "amount": "CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(value AS {s}) END",
    "stamp": "CASE WHEN event_id % 8 = 0 THEN 'unknown' ELSE CAST(CAST(ts AS DATE) AS {s}) END",
    "mixed": "CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(value AS {s}) END",
}


@query("type_coercion", """SELECT event_id, TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(stamp AS TIMESTAMP) AS stamp, mixed FROM (SELECT """
       + ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in TYPED.items()) + " FROM events)")
def type_coercion(t):
    return C.coerce_types(t.events.selectExpr(*[f"{e.format(s='STRING')} AS {n}" for n, e in TYPED.items()]))


@query("custom_validators", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, greatest(l_quantity, 5.0) AS l_quantity, least(l_discount, 0.05) AS l_discount FROM lineitem")
def custom_validators(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    return C.apply_validators(rows, {
        "l_quantity": lambda c: F.greatest(c, F.lit(5.0)),
        "l_discount": C.on_pandas(lambda s: s.clip(upper=0.05)),
    })


@query("drop_empty_rows_columns", """SELECT CASE WHEN l_linenumber > 2 THEN l_quantity END AS a, CASE WHEN l_linenumber > 4 THEN l_tax END AS b
    FROM lineitem WHERE l_linenumber > 2""")
def drop_empty_rows_columns(t):
    rows = t.lineitem.select(
        F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_linenumber") > 4, F.col("l_tax")).alias("b"), F.lit(None).cast("double").alias("c"))
    return C.drop_empty(rows)


@query("drop_sparse_columns", "SELECT k1, k2, k3, k4, quantity, price, discount, flag, status FROM measures", uses="measures")
def drop_sparse_columns(t):
    return C.drop_sparse(measures(t))


@query("impute_mean", "SELECT id, coalesce(price, (SELECT avg(price) FROM series_gaps)) AS price, coalesce(volume, (SELECT avg(volume) FROM series_gaps)) AS volume FROM series_gaps",
       uses="series_gaps", rnd="price volume")
def impute_mean(t):
    return C.impute_numeric(t.series_gaps.select("id", "price", "volume"), ["price", "volume"], "mean")


@query("impute_median", "SELECT id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM series_gaps)) AS price, coalesce(volume, (SELECT quantile_cont(volume, 0.5) FROM series_gaps)) AS volume FROM series_gaps",
       uses="series_gaps", rnd="price volume")
def impute_median(t):
    return C.impute_numeric(t.series_gaps.select("id", "price", "volume"), ["price", "volume"], "median")


MODE = "(SELECT {c} FROM {v} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_most_frequent", f"SELECT id, coalesce(volume, {MODE.format(c='volume', v='series_gaps')}) AS volume FROM series_gaps", uses="series_gaps")
def impute_most_frequent(t):
    return C.impute_numeric(t.series_gaps.select("id", "volume"), ["volume"], "most_frequent")


@query("impute_category", f"SELECT id, coalesce(kind, {MODE.format(c='kind', v='series_gaps')}) AS kind, 'Unknown' AS blank FROM series_gaps", uses="series_gaps")
def impute_category(t):
    rows = t.series_gaps.select("id", "kind", F.lit(None).cast("string").alias("blank"))
    return C.impute_categories(rows, ["kind", "blank"])


KNN = """WITH pairs AS (SELECT a.id, d.id AS donor, d.price AS dp, d.volume AS dv, a.price AS ap, a.volume AS av,
    (coalesce((a.price - d.price) * (a.price - d.price), 0) + coalesce((a.volume - d.volume) * (a.volume - d.volume), 0) + coalesce((a.ratio - d.ratio) * (a.ratio - d.ratio), 0))
    / ((a.price - d.price IS NOT NULL)::INT + (a.volume - d.volume IS NOT NULL)::INT + 1) * 3 AS dist
    FROM (SELECT * FROM series_gaps WHERE price IS NULL OR volume IS NULL) a, series_gaps d),
    p AS (SELECT id, avg(dp) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS rn FROM pairs WHERE ap IS NULL AND dp IS NOT NULL) WHERE rn <= 5 GROUP BY id),
    v AS (SELECT id, avg(dv) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS rn FROM pairs WHERE av IS NULL AND dv IS NOT NULL) WHERE rn <= 5 GROUP BY id)
    SELECT s.id, coalesce(s.price, p.v) AS price, coalesce(s.volume, v.v) AS volume, s.ratio FROM series_gaps s LEFT JOIN p USING (id) LEFT JOIN v ON v.id = s.id"""


@query("impute_nearest", KNN, uses="series_gaps", rnd="price volume ratio")
def impute_nearest(t):
    rows = t.series_gaps.select("id", "price", "volume", "ratio")
    return C.impute_nearest(rows, ["price", "volume", "ratio"], "id")


def flagged(t, flags):
    rows = t.series_gaps.select("id", "price", "volume")
    return rows.select("id", *[f.alias(f"{c}_outlier") for c, f in flags(rows, ["price", "volume"]).items()])


def flag_sql(expr: str) -> str:
    one = lambda c: f"coalesce({expr.replace('$', c)}, false) AS {c}_outlier"
    return f"SELECT id, {one('price')}, {one('volume')} FROM series_gaps, stats"


@query("outliers_zscore", "WITH stats AS (SELECT avg(price) AS pricem, stddev_pop(price) AS prices, avg(volume) AS volumem, stddev_pop(volume) AS volumes FROM series_gaps) "
       + flag_sql("abs($ - $m) / nullif($s, 0) > 3"), uses="series_gaps")
def outliers_zscore(t):
    return flagged(t, C.zscore_flags)


@query("outliers_modified_zscore", """WITH m AS (SELECT quantile_cont(price, 0.5) AS pricem, quantile_cont(volume, 0.5) AS volumem FROM series_gaps),
    stats AS (SELECT any_value(pricem) AS pricem, any_value(volumem) AS volumem, quantile_cont(abs(price - pricem), 0.5) AS prices,
    quantile_cont(abs(volume - volumem), 0.5) AS volumes FROM series_gaps, m) """
       + flag_sql("0.6745 * abs($ - $m) / nullif($s, 0) > 3"), uses="series_gaps")
def outliers_modified_zscore(t):
    return flagged(t, C.modified_z_flags)


IQR = """stats AS (SELECT quantile_cont(price, 0.25) AS price1, quantile_cont(price, 0.75) AS price3, quantile_cont(volume, 0.25) AS volume1,
    quantile_cont(volume, 0.75) AS volume3 FROM series_gaps)"""


@query("outliers_iqr", f"WITH {IQR} " + flag_sql("($ < $1 - 1.5 * ($3 - $1) OR $ > $3 + 1.5 * ($3 - $1))"), uses="series_gaps")
def outliers_iqr(t):
    return flagged(t, C.iqr_flags)


@query("outlier_capping", f"""WITH {IQR}, e AS (SELECT quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM series_gaps)
    SELECT id, CASE WHEN price IS NOT NULL THEN least(hi, greatest(lo, price)) END AS price, volume FROM series_gaps, e""",
       uses="series_gaps", rnd="price")
def outlier_capping(t):
    return C.cap_outliers(t.series_gaps.select("id", "price", "volume"), ["price", "volume"])


@query("winsorize", """WITH e AS (SELECT quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.9) AS hi FROM series_gaps)
    SELECT id, CASE WHEN price IS NOT NULL THEN least(hi, greatest(lo, price)) END AS price FROM series_gaps, e""", uses="series_gaps", rnd="price")
def winsorize(t):
    return C.clip_quantiles(t.series_gaps.select("id", "price"), ["price"], 0.1, 0.9)


@query("series_anomalies", rnd="price")
def series_anomalies(t):
    """Both methods. Draws decide a forest, so the whole has no twin; the halves are queries too, and the statistical one has a twin."""
    return C.series_anomalies(t.series_gaps, "price").drop("id")


@query("series_statistical_anomalies", """WITH s AS (SELECT series_id, avg(price) AS m, stddev_pop(price) AS s, count(price) AS n FROM series_gaps GROUP BY series_id),
    f AS (SELECT g.series_id, ts, price FROM series_gaps g JOIN s USING (series_id) WHERE n >= 10 AND s > 0 AND abs(price - m) / s > 3)
    SELECT *, 'statistical' AS method, count(*) OVER (PARTITION BY series_id) AS anomalies FROM f""", uses="series_gaps", rnd="price")
def series_statistical_anomalies(t):
    return C.series_anomalies(t.series_gaps, "price").where("method = 'statistical'").drop("id")


@query("series_forest_anomalies")
def series_forest_anomalies(t):
    """Draws decide a forest, so its rows have no twin; tests plant outliers and compare with trees walked one by one."""
    return C.series_anomalies(t.series_gaps, "price").where("method = 'isolation_forest'")


@query("interpolate", """WITH p AS (SELECT *, row_number() OVER w - 1 AS pos FROM series_gaps WINDOW w AS (PARTITION BY series_id ORDER BY ts, id)),
    n AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pa, last_value(price IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS na, first_value(price IGNORE NULLS) OVER f AS nv FROM p
    WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT id, coalesce(price, CASE WHEN pa IS NOT NULL AND na IS NOT NULL THEN pv + (nv - pv) * (pos - pa) / (na - pa) END, pv) AS filled FROM n""",
       uses="series_gaps", rnd="filled")
def interpolate(t):
    return C.interpolate(t.series_gaps, "price", "filled").select("id", "filled")


@query("rule_validation", """SELECT event_id, 'amount' AS "column", 'minimum' AS rule FROM v WHERE amount < 5
    UNION ALL SELECT event_id, 'kind', 'required' FROM v WHERE kind IS NULL
    UNION ALL SELECT event_id, 'kind', 'min_length' FROM v WHERE length(kind) < 5
    UNION ALL SELECT event_id, 'day', 'date_format' FROM v WHERE day IS NOT NULL AND try_strptime(day, '%Y-%m-%d') IS NULL""".replace(
    "FROM v", """FROM (SELECT event_id, value AS amount, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS kind,
    CASE WHEN event_id % 9 = 0 THEN 'someday' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events) AS v"""))
def rule_validation(t):
    rows = t.events.selectExpr(
        "event_id", "value AS amount", "CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS kind",
        "CASE WHEN event_id % 9 = 0 THEN 'someday' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS day")
    return C.validate_rules(rows, "event_id", [
        C.rule_minimum("amount", 5), C.rule_required("kind"), C.rule_length("kind", 5), C.rule_date("day")])


@query("cleaning_chain", """WITH d AS (SELECT DISTINCT quantity, price, discount, flag, status FROM (SELECT DISTINCT quantity, price, discount, sparse, flag, status FROM measures)),
    dd AS (SELECT quantity, price, discount, flag, status FROM (SELECT DISTINCT quantity, price, discount, sparse, flag, status FROM measures)),
    q AS (SELECT quantile_cont(quantity, 0.5) AS mq, quantile_cont(price, 0.5) AS mp, quantile_cont(discount, 0.5) AS md,
        (SELECT flag FROM dd WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) AS mf FROM dd),
    i AS (SELECT coalesce(quantity, mq) AS quantity, coalesce(price, mp) AS price, coalesce(discount, md) AS discount, coalesce(flag, mf) AS flag, status FROM dd, q),
    e AS (SELECT quantile_cont(quantity, [0.25, 0.75, 0.05, 0.95]) AS a, quantile_cont(price, [0.25, 0.75, 0.05, 0.95]) AS b, quantile_cont(discount, [0.25, 0.75, 0.05, 0.95]) AS c FROM i),
    h AS (SELECT bool_or(quantity < a[1] - 1.5 * (a[2] - a[1]) OR quantity > a[2] + 1.5 * (a[2] - a[1])) AS ha,
        bool_or(price < b[1] - 1.5 * (b[2] - b[1]) OR price > b[2] + 1.5 * (b[2] - b[1])) AS hb,
        bool_or(discount < c[1] - 1.5 * (c[2] - c[1]) OR discount > c[2] + 1.5 * (c[2] - c[1])) AS hc FROM i, e)
    SELECT CASE WHEN ha THEN least(a[4], greatest(a[3], quantity)) ELSE quantity END AS quantity, CASE WHEN hb THEN least(b[4], greatest(b[3], price)) ELSE price END AS price,
        CASE WHEN hc THEN least(c[4], greatest(c[3], discount)) ELSE discount END AS discount, flag, status FROM i, e, h""",
       uses="measures", rnd="quantity price discount")
def cleaning_chain(t):
    return C.clean(measures(t, *VALUES))


_SHARES = " + ".join(f"CAST(avg(CAST({c} IS NULL AS DOUBLE)) <= 0.5 AS BIGINT)" for c in VALUES)


@query("cleaning_history", f"""WITH m AS (SELECT {', '.join(VALUES)} FROM measures), e AS (SELECT * FROM m WHERE coalesce({', '.join(f'CAST({c} AS VARCHAR)' for c in VALUES)}) IS NOT NULL),
    d AS (SELECT DISTINCT * FROM e), n AS (SELECT (SELECT count(*) FROM m) AS m, (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM d) AS d, (SELECT {_SHARES} FROM d) AS k),
    s AS (SELECT unnest(['empty', 'duplicates', 'sparse', 'missing', 'outliers', 'types', 'validators']) AS step, unnest([m, e, d, d, d, d, d]) AS rows_in, unnest([6, 6, 6, k, k, k, k]) AS columns_in,
        unnest([e, d, d, d, d, d, d]) AS rows_out, unnest([6, 6, k, k, k, k, k]) AS columns_out FROM n)
    SELECT *, rows_out - rows_in AS row_change, columns_out - columns_in AS column_change FROM s""", uses="measures")
def cleaning_history(t):
    steps: list = []
    C.clean(measures(t, *VALUES), history=steps)
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out


for _method, _sql in {
    "standard": "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS quantity",
    "minmax": "(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS quantity",
    "robust": "(l_quantity - quantile_cont(l_quantity, 0.5) OVER ()) / (quantile_cont(l_quantity, 0.75) OVER () - quantile_cont(l_quantity, 0.25) OVER ()) AS quantity",
}.items():
    @query(f"scale_{_method}", f"SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_sql}, CAST(0 AS DOUBLE) AS constant FROM lineitem", rnd="quantity constant")
    def scaled(t, _method=_method):
        rows = t.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.lit(3.0).alias("constant"))
        return X.scale(rows, ["quantity", "absent", "constant"], _method)


@query("one_hot_encoding", """SELECT event_id, CAST(event_type = 'error' AS BIGINT) AS event_type_error, CAST(event_type = 'purchase' AS BIGINT) AS event_type_purchase,
    CAST(event_type = 'signup' AS BIGINT) AS event_type_signup, CAST(event_type = 'view' AS BIGINT) AS event_type_view FROM events""")
def one_hot_encoding(t):
    return X.encode(t.events.select("event_id", "event_type"), ["event_type"])


@query("label_encoding", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_encoded FROM part")
def label_encoding(t):
    return X.encode(t.part.select("p_partkey", "p_brand"), ["p_brand"])


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def ranked(score: str, src: str = "lineitem", k: int = 3, null: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {score.replace('$', c)} AS score FROM {src}" for c in FEATURES)
    return f"SELECT row_number() OVER (ORDER BY score DESC, feature) AS rank, feature, score FROM ({parts}) ORDER BY rank LIMIT {k}"


@query("select_by_correlation", ranked("abs(corr($, l_extendedprice))"), rnd="score")
def select_by_correlation(t):
    return X.select_features(t.lineitem, "l_extendedprice", FEATURES, "correlation", 3)


FTEST = "pow(corr($, l_extendedprice), 2) / (1 - pow(corr($, l_extendedprice), 2)) * (count(*) - 2)"


@query("select_by_f_test", ranked(FTEST), rnd="score", places=4)
def select_by_f_test(t):
    return X.select_features(t.lineitem, "l_extendedprice", FEATURES, "f_test", 3)


@query("select_by_f_test_filled", f"""WITH g AS (SELECT CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity END AS l_quantity, l_tax, l_extendedprice FROM lineitem),
    s AS (SELECT 'l_quantity' AS feature, {FTEST.replace('$', 'l_quantity')} AS score FROM g UNION ALL SELECT 'l_tax', {FTEST.replace('$', 'l_tax')} FROM g)
    SELECT row_number() OVER (ORDER BY score DESC, feature) AS rank, feature, score FROM s""", rnd="score", places=4)
def select_by_f_test_filled(t):
    rows = t.lineitem.select(
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("l_quantity"), "l_tax", "l_extendedprice")
    return X.select_by_f_test(rows, "l_extendedprice", ["l_quantity", "l_tax"], fill=0.0)


def _bin(c: str) -> str:
    return f"len(list_filter(list_distinct(q_{c}), lambda e: {c} > e))"


@query("mutual_information", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS q_{c}" for c in [*FEATURES, "l_extendedprice"]) + " FROM lineitem), b AS (SELECT "
    + ", ".join(f"{_bin(c)} AS {c}" for c in [*FEATURES, "l_extendedprice"]) + " FROM lineitem, q), l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, l_extendedprice AS y FROM b" for c in FEATURES)
    + """), j AS (SELECT feature, x, y, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t,
    sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j)
    SELECT feature, greatest(0.0, sum(n / t * ln(n * t / (nx * ny)))) AS score FROM m GROUP BY feature""", rnd="score")
def mutual_information(t):
    return X.mutual_information(t.lineitem, "l_extendedprice", FEATURES)


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SQL_KEYS = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
PAIR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount")]


def _pair(a, b):
    return (f"{a} * {b} AS {a}_x_{b}, {a} / nullif({b} + 1e-8, 0) AS {a}_div_{b}, {a} - {b} AS {a}_minus_{b}, "
            f"{a} / nullif({a} + {b} + 1e-8, 0) AS {a}_share_{b}")


@query("pair_interactions", f"SELECT {SQL_KEYS}, {', '.join(_pair(a, b) for a, b in PAIR)} FROM lineitem",
       rnd=" ".join(f"{a}_{o}_{b}" for a, b in PAIR for o in ("x", "minus", "share")) + " l_quantity_div_l_extendedprice l_quantity_div_l_discount", places=3)
def pair_interactions(t):
    out = {}
    for a, b in PAIR:
        out |= R.pair_interactions(a, b)
    return t.lineitem.select(*KEYS, *[c.alias(n) for n, c in out.items()])


AUTO = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("auto_interactions", f"SELECT {SQL_KEYS}, {', '.join(f'{a} - {b} AS {a}_minus_{b}' for a, b in AUTO)} FROM lineitem",
       rnd=" ".join(f"{a}_minus_{b}" for a, b in AUTO), places=4)
def auto_interactions(t):
    pairs = R.auto_pairs(NUM)
    return t.lineitem.select(*KEYS, *[R.pair_interactions(a, b)[f"{a}_minus_{b}"].alias(f"{a}_minus_{b}") for a, b in pairs])


LEAD = list(combinations(NUM, 2))


@query("leading_interactions", f"SELECT {SQL_KEYS}, " + ", ".join(
    f"{a} * {b} AS {a}_x_{b}, coalesce({a} / nullif({b} + 1e-8, 0), 0) AS {a}_div_{b}" for a, b in LEAD) + " FROM lineitem",
    rnd=" ".join(f"{a}_{o}_{b}" for a, b in LEAD for o in ("x", "div")), places=2)
def leading_interactions(t):
    return t.lineitem.select(*KEYS, *[c.alias(n) for n, c in R.leading_interactions(NUM).items()])


@query("polynomial_features", f"SELECT {SQL_KEYS}, pow(l_quantity, 2) AS l_quantity_pow2, pow(l_extendedprice, 2) AS l_extendedprice_pow2, pow(l_discount, 2) AS l_discount_pow2 FROM lineitem",
       rnd="l_quantity_pow2 l_extendedprice_pow2 l_discount_pow2", places=4)
def polynomial_features(t):
    return t.lineitem.select(*KEYS, *[c.alias(n) for n, c in R.polynomials(NUM).items()])


@query("row_statistics", """WITH l AS (SELECT id, list_filter([price, volume, ratio, CAST(id % 50 AS DOUBLE)], lambda x: x IS NOT NULL) AS v FROM series_gaps)
    SELECT id, list_avg(v) AS row_mean, list_stddev_samp(v) AS row_std, list_min(v) AS row_min, list_max(v) AS row_max, list_median(v) AS row_median,
    list_skewness(v) AS row_skew FROM l""", uses="series_gaps", rnd="row_mean row_std row_min row_max row_median row_skew", places=5)
def row_statistics(t):
    rows = t.series_gaps.withColumn("extra", (F.col("id") % 50).cast("double"))
    return rows.select("id", *[c.alias(n) for n, c in R.row_statistics(["price", "volume", "ratio", "extra"]).items()])


W = "PARTITION BY series_id ORDER BY ts, id"


def _roll(e: str, c: str, k: int, full: bool) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {k} THEN {e} {frame} END" if full else f"{e} {frame}"


AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
TWO = ("price", "volume")


VIEWS["series_kinds"] = ((), "SELECT " + ", ".join(_select({**SERIES, "kind": "event_type"}, "duckdb")) + " FROM events")
_ANGLE = {"month": ("month(ts)", 12), "dayofweek": ("isodow(ts) - 1", 7), "dayofyear": ("dayofyear(ts)", 365), "day": ("day(ts)", 31)}
_CYCLES = {f"{n}_{f}": f"{f}(2 * pi() * ({e}) / {k})" for n, (e, k) in _ANGLE.items() for f in ("sin", "cos")}
_PARTS = {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1", "dayofyear": "dayofyear(ts)", "quarter": "quarter(ts)", "week": "week(ts)"}
_DAY = "CAST(ts AS DATE)"
_FLAGS = {k: f"CAST({e} AS BIGINT)" for k, e in {
    "is_weekend": "isodow(ts) > 5", "is_month_start": "day(ts) = 1", "is_month_end": f"{_DAY} = last_day(ts)", "is_quarter_start": f"{_DAY} = date_trunc('quarter', ts)",
    "is_quarter_end": f"{_DAY} = last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTH AS DATE))"}.items()}


def _indicators(c: str, spans, bands, changes: dict[str, int]) -> dict[str, str]:
    """Means, exponential means, bands, strength and relative changes of a series without gaps; d_, g_ and l_ columns hold its moves."""
    m, s = _roll(f"avg({c})", c, 20, True), _roll(f"stddev_samp({c})", c, 20, True)
    gain, loss = (_roll(f"avg({x}_{c})", f"{x}_{c}", 14, True) for x in "gl")
    out = {f"{c}_sma_{k}": _roll(f"avg({c})", c, k, True) for k in spans}
    out |= {f"{c}_ema_{k}": f"list_reduce(list(CAST({c} AS DOUBLE)) OVER ({W}), lambda a, x: a * {1 - 2 / (k + 1)} + x) / ((1 - pow({1 - 2 / (k + 1)}, row_number() OVER ({W}))) / {2 / (k + 1)})" for k in spans}
    out |= dict(zip(bands, (f"{m} + 2 * {s}", f"{m} - 2 * {s}", f"4 * {s}", f"({c} - ({m} - 2 * {s})) / nullif(4 * {s}, 0)")))
    out[f"{c}_rsi"] = f"CASE WHEN {loss} = 0 AND {gain} > 0 THEN 100.0 WHEN {loss} = 0 THEN NULL ELSE 100 - 100 / (1 + {gain} / {loss}) END"
    return out | {n: f"{c} / nullif(lag({c}, {k}) OVER ({W}), 0) - 1" for n, k in changes.items()}


def _moves(src: str) -> str:
    """The rows with the gains and losses of both columns."""
    moved = ", ".join(f"coalesce(greatest({c} - lag({c}) OVER ({W}), 0), 0) AS g_{c}, coalesce(greatest(lag({c}) OVER ({W}) - {c}, 0), 0) AS l_{c}" for c in TWO)
    return f"(SELECT *, {moved} FROM {src})"


def _full_columns() -> dict[str, str]:
    out = {f"{c}_lag_{k}": f"lag({c}, {k}) OVER ({W})" for c in TWO for k in (1, 7, 30)}
    out |= {f"{c}_{f}_{k}": _roll(f"{a}({c})", c, k, True) for c in TWO for k in (7, 14, 30) for f, a in AGG.items()}
    out |= {"price_x_volume": "price * volume", "price_div_volume": "coalesce(price / nullif(volume + 1e-8, 0), 0)",
            "price_pow2": "pow(price, 2)", "volume_pow2": "pow(volume, 2)", "row_mean": "(price + volume) / 2", "row_min": "least(price, volume)",
            "row_max": "greatest(price, volume)", "row_median": "(price + volume) / 2", "row_std": "abs(price - volume) / sqrt(2)", "row_skew": "CAST(NULL AS DOUBLE)"}
    out |= {f"kind_{k}": f"CAST(kind = '{k}' AS BIGINT)" for k in ("error", "purchase", "signup", "view")}
    out |= {f"ts_{k}": _PARTS[k] for k in ("year", "month", "day", "dayofweek", "quarter")} | {"ts_hour": "hour(ts)"}
    out |= {f"ts_{k}": _CYCLES[k] for k in ("month_sin", "month_cos", "day_sin", "day_cos")} | {f"ts_{k}": _FLAGS[k] for k in ("is_weekend", "is_month_end", "is_quarter_end")}
    for c in TWO:
        out |= _indicators(c, (5, 10, 20), [f"{c}_bb_{b}" for b in ("upper", "lower", "width")], {f"{c}_roc_{k}": k for k in (1, 5, 10)})
    return out


FULL = _full_columns()
_WHOLE = ("volume_lag", "ts_year", "ts_month", "ts_day", "ts_quarter", "ts_hour", "ts_is", "kind_", "volume_min", "volume_max", "row_skew")


def _doubles(columns) -> str:
    return " ".join(n for n in columns if not n.startswith(_WHOLE) or n.endswith(("_sin", "_cos")))


@query("feature_engineering_full", "SELECT series_id, ts, id, price, volume, " + ", ".join(f"{e} AS {n}" for n, e in FULL.items()) + f" FROM {_moves('series_kinds')}", uses="series_kinds",
       rnd=_doubles(FULL), places=5)
def feature_engineering_full(t):
    return X.engineer(t.events.selectExpr(*_select({**SERIES, "kind": "event_type"})), "ts", list(TWO), ["kind"])


def _basic_columns() -> dict[str, str]:
    out = {f"{c}_lag_{k}": f"lag({c}, {k}) OVER ({W})" for c in TWO for k in (1, 3, 7, 14)}
    out |= {f"{c}_{f}_{k}": _roll(f"{a}({c})", c, k, False) for c in TWO for k in (7, 14, 30, 60) for f, a in {**AGG, "median": "median"}.items()}
    whole = "OVER (PARTITION BY series_id)"
    for c in TWO:
        out[f"{c}_zscore"] = f"({c} - avg({c}) {whole}) / (stddev_samp({c}) {whole} + 1e-8)"
        out[f"{c}_percentile"] = f"(rank() OVER (PARTITION BY series_id ORDER BY {c}) + (count(*) OVER (PARTITION BY series_id, {c}) - 1) / 2.0) / count({c}) {whole}"
        out[f"{c}_change"] = f"{c} - lag({c}) OVER ({W})"
        out[f"{c}_pct_change"] = f"{c} / nullif(lag({c}) OVER ({W}), 0) - 1"
        out |= {f"{c}_volatility_{k}d": _roll(f"stddev_samp({c})", c, k, False) for k in (7, 14, 30)}
    out |= _indicators("price", (5, 10, 20, 50), ("bollinger_upper", "bollinger_lower", "bollinger_width", "bollinger_position"), {})
    out |= {"price_x_volume": "price * volume", "price_div_volume": "price / nullif(volume + 1e-8, 0)", "price_minus_volume": "price - volume",
            "price_share_volume": "price / nullif(price + volume + 1e-8, 0)"}
    return {"price": "price", "volume": "volume"} | _PARTS | _CYCLES | _FLAGS | out


BASIC = _basic_columns()
BASIC_SQL = "SELECT series_id, ts, id, " + ", ".join(f"{e} AS {n}" for n, e in BASIC.items()) + f" FROM {_moves('series')}"
SCALED_SQL = "SELECT series_id, ts, id, " + ", ".join(f"({n} - avg({n}) OVER ()) / coalesce(nullif(stddev_pop({n}) OVER (), 0), 1) AS {n}" for n in BASIC) + f" FROM ({BASIC_SQL})"


@query("feature_engineering_basic", SCALED_SQL, uses="series", rnd=" ".join(BASIC), places=4)
def feature_engineering_basic(t):
    return X.engineer_basic(t.series, "ts", list(TWO))


def _ranked(target: str) -> str:
    """The ten best by F, from the correlation of each scaled feature with the target, missing values as 0."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr(coalesce({c}, 0), {target}) AS r, count(*) AS n FROM f" for c in BASIC if c != target)
    plain = SCALED_SQL.replace(f"({target} - avg({target}) OVER ()) / coalesce(nullif(stddev_pop({target}) OVER (), 0), 1) AS {target}", target, 1)
    return f"""WITH f AS ({plain}), c AS ({each}) SELECT * FROM (SELECT row_number() OVER (ORDER BY round(score, 6) DESC, feature) AS rank, feature FROM (SELECT feature, r * r / (1 - r * r) * (n - 2) AS score FROM c
        WHERE r IS NOT NULL AND NOT isnan(r) AND r * r < 1)) WHERE rank <= 10"""


@query("feature_engineering_selected", _ranked("volume"), uses="series")
def feature_engineering_selected(t):
    best = X.engineer_basic(t.series, "ts", list(TWO), target="volume", k=10)
    return best.sparkSession.createDataFrame([(i, c) for i, c in enumerate(best.columns[1:], 1)], "rank int, feature string")
