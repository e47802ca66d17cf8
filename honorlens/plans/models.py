"""Registered ML, text and forecasting queries (M1-M15, FC1-FC5, W4, W5, W8, A28, C18-C23).

Model outputs (clusters, forests, SVD topics, AR forecasts) get rows-only
checks; the deterministic data preparation (TF-IDF vocabulary, series
windows) is checked against DuckDB."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import round_doubles
from ..operators import forecast as FC
from ..operators.groups import with_scalar
from ..operators import learn as L
from ..operators import topics as TP
from ..operators import windows as W
from ..operators.silhouette import euclidean_silhouette
from ..session import materialised
from ..sources.facts import award_facts, persons, text_facts
from ..sources.tables import read_table
from .oracle_sql import with_fact
from .registry import query
from .reports import CATEGORY_ORDER

# Model sizes of the reference (defaults of the operators).
KMEANS_K, KMEANS_RESTARTS, KMEANS_SWEEP = 5, 10, range(3, 8)
FOREST_TREES, FOREST_DEPTH, FOREST_FOLDS = 200, 10, 5
TOPICS, VOCAB_SIZE, TOP_WORDS = 8, 1000, 10
SERIES_LAGS, SERIES_HORIZON = 10, 10
MIN_TEXT_CHARS = 10


def _documents(spark, sf_dir):
    return text_facts(spark, sf_dir).filter(F.length("motivation") > MIN_TEXT_CHARS)


def _cluster_input(spark, sf_dir):
    """Person rows and their weighted points; iterative fits re-read the points, which are written once."""
    rows, points = L.cluster_features(persons(award_facts(spark, sf_dir)), CATEGORY_ORDER)
    return rows, materialised(points)


@query("kmeans_profiles")
def q_kmeans(spark, sf_dir):
    """M1-M4: K-Means cluster profiles."""
    rows, points = _cluster_input(spark, sf_dir)
    assigned, _ = L.kmeans_clusters(points, k=KMEANS_K, n_init=KMEANS_RESTARTS)
    return round_doubles(L.cluster_profiles(rows, assigned))


@query("kmeans_assignments")
def q_kmeans_points(spark, sf_dir):
    """Every person row with its cluster."""
    rows, points = _cluster_input(spark, sf_dir)
    assigned, _ = L.kmeans_clusters(points, k=KMEANS_K, n_init=KMEANS_RESTARTS)
    keys = ["award_year", "age_at_award", "category"]
    return rows.join(assigned.select(*keys, "cluster"), keys).select(
        "name", "award_year", "age_at_award", "category", "cluster", "birth_country")


@query("kmeans_silhouette")
def q_silhouette(spark, sf_dir):
    """Silhouette sweep over k."""
    _, points = _cluster_input(spark, sf_dir)
    return round_doubles(L.silhouette_sweep(points, KMEANS_SWEEP))


def _points_sql() -> str:
    """M1 in SQL: distinct (year, age, category) points with their weight and standardised features z0, z1, ..."""
    features = ["CAST(award_year AS DOUBLE)", "CAST(age_at_award AS DOUBLE)",
                *[f"CASE WHEN category = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for c in CATEGORY_ORDER]]
    moments = ", ".join(f"avg({f}) AS m{i}, stddev_samp({f}) AS s{i}" for i, f in enumerate(features))
    z = ", ".join(f"coalesce(({f} - m{i}) / nullif(s{i}, 0), 0) AS z{i}" for i, f in enumerate(features))
    return f"""b AS (SELECT * FROM persons WHERE award_year IS NOT NULL AND age_at_award IS NOT NULL),
moments AS (SELECT {moments} FROM b),
d AS (SELECT award_year, age_at_award, category, CAST(count(*) AS DOUBLE) AS weight FROM b GROUP BY ALL),
points AS (SELECT award_year, age_at_award, category, weight, CAST(floor(age_at_award / {AGE_BAND}) AS INTEGER) AS cluster, {z} FROM d CROSS JOIN moments)"""


N_FEATURES = 2 + len(CATEGORY_ORDER)
AGE_BAND = 20  # width of the age bands that are judged as a clustering


def _band_points(spark, sf_dir):
    rows, points = _cluster_input(spark, sf_dir)
    return rows, points.withColumn("cluster", F.floor(F.col("age_at_award") / AGE_BAND).cast("int"))


@query("cluster_feature_points", with_fact(f"""WITH {_points_sql()}
SELECT CAST(award_year AS DOUBLE) AS award_year, CAST(age_at_award AS DOUBLE) AS age_at_award, category, weight,
       {", ".join(f"round(z{i}, 6) AS z{i}" for i in range(N_FEATURES))} FROM points"""))
def q_feature_points(spark, sf_dir):
    """The standardised features that the clusterings are fitted on, a row a distinct point."""
    _, points = _cluster_input(spark, sf_dir)
    z = vector_to_array("features")
    return round_doubles(points.select("award_year", "age_at_award", "category", "weight",
                                       *[z[i].alias(f"z{i}") for i in range(N_FEATURES)]))


@query("band_silhouette", with_fact(f"""WITH {_points_sql()},
sums AS (SELECT i.award_year, i.age_at_award, i.category, i.weight, i.cluster, j.cluster AS other,
                sum(j.weight * sqrt({" + ".join(f"(i.z{k} - j.z{k}) ^ 2" for k in range(N_FEATURES))})) AS dist, sum(j.weight) AS size
         FROM points i CROSS JOIN points j GROUP BY ALL),
per AS (SELECT weight, cluster, award_year, age_at_award, category, max(size) FILTER (cluster = other) AS size,
               max(dist / nullif(size - 1, 0)) FILTER (cluster = other) AS own, min(dist / size) FILTER (cluster <> other) AS nearest
        FROM sums GROUP BY ALL)
SELECT round(sum(weight * CASE WHEN size <= 1 THEN 0 ELSE coalesce((nearest - own) / nullif(greatest(own, nearest), 0), 0) END) / sum(weight), 6) AS silhouette,
       CAST(sum(weight) AS BIGINT) AS n_points, count(DISTINCT cluster) AS n_clusters FROM per"""))
def q_band_silhouette(spark, sf_dir):
    """M3: exact Euclidean silhouette of a given clustering (age bands)."""
    return round_doubles(euclidean_silhouette(_band_points(spark, sf_dir)[1]))


@query("band_profiles", with_fact(f"""
WITH b AS (SELECT *, CAST(floor(age_at_award / {AGE_BAND}) AS INTEGER) AS cluster FROM persons WHERE award_year IS NOT NULL AND age_at_award IS NOT NULL),
cat AS (SELECT cluster, category, count(*) AS n FROM b WHERE category IS NOT NULL GROUP BY ALL),
country AS (SELECT cluster, birth_country, count(*) AS n FROM b WHERE birth_country IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
topcat AS (SELECT cluster, category AS top_category FROM cat QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) = 1),
topcountry AS (SELECT cluster, birth_country AS top_country FROM country QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, birth_country) = 1)
SELECT cluster, count(*) AS count, round(avg(award_year), 6) AS avg_year, round(avg(age_at_award), 6) AS avg_age, any_value(top_category) AS top_category,
       any_value(top_country) AS top_country
FROM b LEFT JOIN topcat USING (cluster) LEFT JOIN topcountry USING (cluster) GROUP BY cluster"""))
def q_band_profiles(spark, sf_dir):
    """M4: cluster profiles of a given clustering (age bands)."""
    return round_doubles(L.cluster_profiles(*_band_points(spark, sf_dir)))


def _forest_frame(spark, sf_dir):
    """Narrow person rows, written once: the level scan, the label indexer, the class
    weights and every forest pass read them instead of re-joining the fact."""
    cols = ["id", "is_org", "award_year", "gender", "birth_continent", "decade", "age_at_award", "category"]
    p = materialised(persons(award_facts(spark, sf_dir)).select(*cols))
    return L.classifier_frame(p, ["female", "male", "other"], L.levels_of(p, "birth_continent"))


@query("forest_cv_accuracy")
def q_forest_cv(spark, sf_dir):
    """M5 / M6: forest cross-validation accuracy."""
    frame, _ = _forest_frame(spark, sf_dir)
    return round_doubles(L.random_forest_cv(frame, num_trees=FOREST_TREES, max_depth=FOREST_DEPTH, n_folds=FOREST_FOLDS))


@query("forest_feature_importances")
def q_forest_imp(spark, sf_dir):
    """Forest feature importances."""
    frame, names = _forest_frame(spark, sf_dir)
    return round_doubles(L.feature_importances(frame, names, num_trees=FOREST_TREES, max_depth=FOREST_DEPTH))


@query("forest_training_summary", with_fact("""
SELECT count(*) AS n, CAST(count(DISTINCT category) AS BIGINT) AS n_classes,
       string_agg(DISTINCT category, ', ' ORDER BY category) AS classes, CAST(2 + count(DISTINCT birth_continent) - 1 + 2 AS BIGINT) AS n_features
FROM persons WHERE age_at_award IS NOT NULL AND birth_continent IS NOT NULL AND decade IS NOT NULL
"""))
def q_forest_summary(spark, sf_dir):
    """Rows, class list and number of features that the forest is trained on."""
    frame, names = _forest_frame(spark, sf_dir)
    return frame.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("n_classes"),
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("classes"),
        F.lit(len(names)).cast("long").alias("n_features"))


@query("forest_training_weights", with_fact(f"""
WITH t AS (SELECT category, count(*) AS n FROM persons WHERE age_at_award IS NOT NULL AND birth_continent IS NOT NULL AND decade IS NOT NULL AND category IS NOT NULL GROUP BY 1),
s AS (SELECT *, sum(n) OVER (ORDER BY category ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total, count(*) OVER () AS k FROM t)
SELECT category, CAST(fold AS INTEGER) AS fold, round(total / (k * n), 6) AS weight,
       CAST(floor((before + n - 1 - fold) / {FOREST_FOLDS}) - floor((before - 1 - fold) / {FOREST_FOLDS}) AS BIGINT) AS n
FROM s CROSS JOIN range({FOREST_FOLDS}) f(fold)"""))
def q_forest_weights(spark, sf_dir):
    """M6: balanced class weight and rows of each class and fold that the forests are trained and judged on."""
    frame, _ = _forest_frame(spark, sf_dir)
    folds = L.fold_column(L.balanced_weights(frame), ["id", "award_year", "age_at_award"], FOREST_FOLDS)
    return round_doubles(folds.groupBy("category", "fold").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n")))


@query("forecast_models")
def q_forecast_models(spark, sf_dir):
    """FC2 / FC5: AR model of each daily event series with its training loss."""
    models = FC.fit_ar(FC.windowed(_event_series(spark, sf_dir), SERIES_LAGS), SERIES_LAGS)
    return round_doubles(models.select("series_id", F.size("weights").alias("n_lags"), "bias", "train_mse"))


def _vocab_sql() -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in TP.english_stop_words())
    return f"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS motivation FROM documents
           WHERE length(coalesce(text, '')) > {MIN_TEXT_CHARS}),
u AS (SELECT id, list_filter(regexp_extract_all(lower(motivation), '{TP.TOKEN_PATTERN}'),
                             lambda x: NOT list_contains([{stop}], x)) AS uni FROM d),
t AS (SELECT id, list_concat(uni, list_transform(range(1, len(uni)), lambda i: uni[i] || ' ' || uni[i + 1])) AS terms FROM u),
x AS (SELECT id, unnest(terms) AS term FROM t),
per AS (SELECT id, term, count(*) AS tf FROM x GROUP BY id, term),
st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf_total FROM per GROUP BY term),
n AS (SELECT count(*) AS n FROM d)
SELECT term, df, tf_total, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf, rank FROM (
  SELECT st.*, n.n, CAST(row_number() OVER (ORDER BY tf_total DESC, term) AS INTEGER) AS rank
  FROM st CROSS JOIN n WHERE df >= 2 AND df <= 0.95 * n.n) WHERE rank <= {VOCAB_SIZE}
"""


@query("tfidf_vocabulary", _vocab_sql())
def q_vocab(spark, sf_dir):
    """M8: TF-IDF vocabulary (df, corpus count, idf)."""
    termed = TP.term_lists(_documents(spark, sf_dir))
    return round_doubles(TP.vocabulary(termed, max_features=VOCAB_SIZE))


def _topic_model(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    termed = TP.term_lists(docs)  # made twice, for the vocabulary and for the vectors: kept, they are ten times the texts
    vocab_rows = TP.vocabulary(termed, max_features=VOCAB_SIZE).orderBy("rank").collect()  # ≤ VOCAB_SIZE rows
    weighted = materialised(TP.tfidf(termed, vocab_rows).select("id", "category", "tfidf"))
    scores, comps, s = TP.truncated_svd(weighted, "id", "tfidf", TOPICS)
    return weighted, [r["term"] for r in vocab_rows], scores, comps


@query("topic_terms")
def q_topic_terms(spark, sf_dir):
    """Top terms per SVD topic."""
    _, vocab, _, comps = _topic_model(spark, sf_dir)
    return round_doubles(TP.top_terms(spark, vocab, comps, TOP_WORDS))


@query("topic_by_category")
def q_topic_category(spark, sf_dir):
    """Dominant topic × category counts."""
    weighted, _, scores, _ = _topic_model(spark, sf_dir)
    dom = TP.dominant_topic(scores).join(weighted.select("id", "category"), "id")
    return dom.groupBy("category", "dominant_topic").agg(F.count(F.lit(1)).alias("count"))


@query("topic_summary")
def q_topic_summary(spark, sf_dir):
    """Explained variance and corpus size."""
    weighted, vocab, scores, comps = _topic_model(spark, sf_dir)
    ev = TP.explained_variance(scores, weighted, "tfidf", len(comps))
    head = ev.select("explained_variance_pct", F.lit(len(vocab)).alias("n_terms"), F.lit(len(comps)).alias("n_topics"))
    return round_doubles(with_scalar(head, weighted.agg(F.count(F.lit(1)).alias("n_documents"))))


def _event_series(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts"])
    return FC.period_counts(ev, "event_type", F.to_date("ts"))


@query("event_series_windows", f"""
WITH s AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS t, CAST(count(*) AS DOUBLE) AS value
           FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
z AS (SELECT *, (value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) AS z FROM s),
w AS (SELECT *, {", ".join(f"lag(z, {i}) OVER (PARTITION BY series_id ORDER BY t) AS lag_{i}" for i in range(1, SERIES_LAGS + 1))},
             count(*) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {SERIES_LAGS} PRECEDING AND 1 PRECEDING) AS nprev FROM z)
SELECT series_id, strftime(t, '%Y-%m-%d') AS t, value, round(z, 6) AS z,
       {", ".join(f"round(lag_{i}, 6) AS lag_{i}" for i in range(1, SERIES_LAGS + 1))}
FROM w WHERE nprev = {SERIES_LAGS}
""")
def q_series(spark, sf_dir):
    """FC1 / W4 / W5: daily event series, z-scores and lag windows."""
    win = FC.windowed(_event_series(spark, sf_dir), SERIES_LAGS)
    lags = [F.col("window")[SERIES_LAGS - i].alias(f"lag_{i}") for i in range(1, SERIES_LAGS + 1)]
    return round_doubles(win.select("series_id", F.date_format("t", "yyyy-MM-dd").alias("t"), "value", "z", *lags))


@query("event_forecast")
def q_forecast(spark, sf_dir):
    """FC2-FC5 / C23: AR forecast of daily event series."""
    out = FC.forecast_series(_event_series(spark, sf_dir), SERIES_LAGS, SERIES_HORIZON)
    return round_doubles(out.select("series_id", F.date_format("t", "yyyy-MM-dd").alias("t"), "kind", "value"))


@query("forecast_trend_verdict")
def q_verdict(spark, sf_dir):
    """Trend verdict per event series."""
    out = FC.forecast_series(_event_series(spark, sf_dir), SERIES_LAGS, SERIES_HORIZON)
    return round_doubles(FC.trend_verdict(out))


# The binding spans 7 award years, so the yearly series use 2 lags
# (the reference's 10 need 11+ years); the horizon is the reference's 10 years.
YEARLY_LAGS, YEARLY_HORIZON = 2, 10
YEARLY_RIDGE = 1.0  # 5 training windows per series: shrink the AR weights so forecasts stay bounded


def _series_sql(series: str) -> str:
    """z-scores, lag windows of two values, and the least-squares AR(2) of each series by Cramer's rule, as CTEs on ``s``."""
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    rows, y = [["aa", "ab", "a"], ["ab", "bb", "b"], ["a", "b", "n"]], ["qa", "qb", "qy"]
    put = lambda k: det(*[[y[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)])
    return f"""s AS ({series}),
z AS (SELECT *, avg(value) OVER g AS mu, stddev_pop(value) OVER g AS sd, (value - avg(value) OVER g) / stddev_pop(value) OVER g AS z FROM s WINDOW g AS (PARTITION BY series_id)),
w AS (SELECT * FROM (SELECT *, lag(z, 2) OVER g AS l2, lag(z, 1) OVER g AS l1 FROM z WINDOW g AS (PARTITION BY series_id ORDER BY t)) WHERE l2 IS NOT NULL),
sums AS (SELECT series_id, sum(l2 * l2) AS aa, sum(l2 * l1) AS ab, sum(l2) AS a, sum(l1 * l1) AS bb, sum(l1) AS b, CAST(count(*) AS DOUBLE) AS n,
                sum(l2 * z) AS qa, sum(l1 * z) AS qb, sum(z) AS qy, sum(z * z) AS yy FROM w GROUP BY series_id),
ridged AS (SELECT series_id, aa + {YEARLY_RIDGE} AS aa, ab, a, bb + {YEARLY_RIDGE} AS bb, b, n + {YEARLY_RIDGE} AS n, qa, qb, qy FROM sums),
model AS (SELECT series_id, {put(0)} / {det(*rows)} AS w2, {put(1)} / {det(*rows)} AS w1, {put(2)} / {det(*rows)} AS w0 FROM ridged)"""


YEARLY_SERIES = """SELECT series_id, award_year AS t, CAST(count(*) AS DOUBLE) AS value
    FROM (SELECT category AS series_id, award_year FROM fact UNION ALL SELECT 'ALL', award_year FROM fact) WHERE award_year IS NOT NULL AND series_id IS NOT NULL GROUP BY ALL"""
AHEAD = f"""last AS (SELECT series_id, max(t) AS last_t, max_by(z, t) AS z1, max_by(l1, t) AS z2, any_value(mu) AS mu, any_value(sd) AS sd FROM w GROUP BY series_id),
ahead(series_id, step, z1, z2) AS (SELECT series_id, 0, z1, z2 FROM last UNION ALL
    SELECT series_id, step + 1, w2 * z2 + w1 * z1 + w0, z1 FROM ahead JOIN model USING (series_id) WHERE step < {YEARLY_HORIZON}),
forecasts AS (SELECT series_id, CAST(last_t + step AS INTEGER) AS t, 'forecast' AS kind, a.z1 * sd + mu AS value FROM ahead a JOIN last USING (series_id) WHERE step > 0)"""


def _recursive(sql: str) -> str:
    return with_fact(sql).replace("WITH ", "WITH RECURSIVE ", 1)


def _yearly_series(spark, sf_dir):
    from ..sources.facts import order_facts

    f = order_facts(spark, sf_dir)
    overall = FC.period_counts(f, F.lit("ALL"), F.col("award_year"), weight="n_items")
    return overall.unionByName(FC.period_counts(f, "category", F.col("award_year"), weight="n_items"))


@query("yearly_prize_forecast", _recursive(f"""WITH {_series_sql(YEARLY_SERIES)}, {AHEAD}
SELECT series_id, t, 'actual' AS kind, value FROM w
UNION ALL SELECT series_id, t, 'fitted', round((w2 * l2 + w1 * l1 + w0) * sd + mu, 6) FROM w JOIN model USING (series_id)
UNION ALL SELECT series_id, t, kind, round(value, 6) FROM forecasts"""))
def q_yearly_forecast(spark, sf_dir):
    """FC1-FC5 on the reference's own series — fact rows per award year — for all
    recipients and for each category at once (one AR model per series)."""
    out = FC.forecast_series(_yearly_series(spark, sf_dir), YEARLY_LAGS, YEARLY_HORIZON, ridge=YEARLY_RIDGE)
    return round_doubles(out)


@query("yearly_trend_verdict", _recursive(f"""WITH {_series_sql(YEARLY_SERIES)}, {AHEAD}
SELECT series_id, round(min_by(value, t), 6) AS first, round(max_by(value, t), 6) AS last,
       CASE WHEN abs(max_by(value, t) - min_by(value, t)) < 3 THEN 'relatively stable' ELSE 'changing' END AS verdict FROM forecasts GROUP BY series_id"""))
def q_yearly_verdict(spark, sf_dir):
    """Trend verdict of the yearly forecasts."""
    return round_doubles(FC.trend_verdict(FC.forecast_series(_yearly_series(spark, sf_dir), YEARLY_LAGS, YEARLY_HORIZON, ridge=YEARLY_RIDGE)))


@query("last_windows", f"""
WITH s AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS t, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
z AS (SELECT *, (value - avg(value) OVER g) / stddev_pop(value) OVER g AS z, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS r, count(*) OVER g AS n FROM s WINDOW g AS (PARTITION BY series_id))
SELECT series_id, {SERIES_LAGS} - r AS place, strftime(t, '%Y-%m-%d') AS t, round(z, 6) AS z FROM z WHERE r <= {SERIES_LAGS} AND n >= {SERIES_LAGS}
""")
def q_last_windows(spark, sf_dir):
    """The window that a forecast starts from, a row a place."""
    last = FC._last_window(W.zscore(_event_series(spark, sf_dir), "series_id", "value", "z"), SERIES_LAGS)
    back = last.select("series_id", "last_t", F.posexplode("last").alias("place", "z"))
    days = _event_series(spark, sf_dir).select("series_id", "t")
    place = (F.lit(SERIES_LAGS) - F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("t")))).alias("place")
    return round_doubles(back.join(days.select("series_id", "t", place), ["series_id", "place"]).select("series_id", "place", F.date_format("t", "yyyy-MM-dd").alias("t"), "z"))


EPOCHS = 60


@query("forecast_loss_history", _recursive(f"""WITH {_series_sql(YEARLY_SERIES)},
steps(series_id, epoch, v2, v1, v0) AS (SELECT series_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM sums UNION ALL
    SELECT series_id, epoch + 1, v2 - (aa * v2 + ab * v1 + a * v0 - qa) / (aa + bb + n), v1 - (ab * v2 + bb * v1 + b * v0 - qb) / (aa + bb + n),
           v0 - (a * v2 + b * v1 + n * v0 - qy) / (aa + bb + n) FROM steps JOIN sums USING (series_id) WHERE epoch < {EPOCHS})
SELECT series_id, epoch, round((yy - 2 * (v2 * qa + v1 * qb + v0 * qy) + v2 * (aa * v2 + ab * v1 + a * v0) + v1 * (ab * v2 + bb * v1 + b * v0) + v0 * (a * v2 + b * v1 + n * v0)) / n, 6) AS loss
FROM steps JOIN sums USING (series_id) WHERE epoch > 0"""))
def q_loss_history(spark, sf_dir):
    """FC5: training loss of the yearly series by epoch."""
    return round_doubles(FC.loss_history(FC.windowed(_yearly_series(spark, sf_dir), YEARLY_LAGS), YEARLY_LAGS, EPOCHS))
