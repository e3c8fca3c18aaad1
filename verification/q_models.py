"""Fitted models. What they learn before fitting and what must hold of any fit has an oracle."""

from functools import cache

from pyspark.sql import functions as F

from placewise import constants as K
from placewise.operators import aggregates as A, charts, exact_trees as X, models as M
from placewise.plans import pipelines as P
from placewise.operators.stats import standardize
from verification.catalog import query, rounded
from verification.standins import Tables

FEATURES = K.NUMERIC_FEATURES
PARTITIONS = 8  # of the training rows here
TABLE = """select ln(1 + cast(user_ratings_total as double)) log_reviews, price_level, population_total, median_age,
  pct_under_18, pct_65_plus, median_household_income, city from enriched_zip where rating is not null"""


def places(t):
    return P.enriched_by_zip(t.places, t.zcta)


@query(f"""with v as ({TABLE}), """ + ", ".join(
    f"m{i} as (select quantile_cont(cast({c} as double), cast(0.5 as double)) m from v)" for i, c in enumerate(FEATURES))
    + " " + " union all ".join(
    f"""select '{c}' feature, round(max(m), 6) median, round(avg(coalesce({c}, m)), 4) mean,
          round(stddev_pop(coalesce({c}, m)), 4) std, cast(null as string) "mode" from v, m{i}"""
    for i, c in enumerate(FEATURES))
    + """ union all select * from (select 'city', null, null, null, city from v where city is not null group by city
          order by count(*) desc, city limit 1) c""")
def feature_stats(t):
    table = M.classifier_table(places(t))
    out = M.feature_stats(table, FEATURES, K.CATEGORICAL_FEATURES)
    return rounded(rounded(out, 6, ["median"]), 4, ["mean", "std"])


def clusters(t):
    rows = places(t).where("median_household_income > 0 and population_total > 1000")
    return M.kmeans_points(rows, partitions=PARTITIONS, key="place_id")


@query()
def kmeans_profile(t):
    return A.profile_groups(clusters(t), "cluster", K.CLUSTER_FEATURES)


@query()
def cluster_points(t):
    return charts.cluster_points(clusters(t))


@query()
def kmeans_embeddings(t):
    return M.kmeans_vectors(t.embeddings, "embedding", k=4, partitions=PARTITIONS, key="vec_id").groupBy("cluster").agg(F.count("*").alias("size"))


@cache
def _classified(spark, sf_dir, model, num_trees):
    """One fit for all queries that ask for it."""
    return P.classify(places(Tables(spark, sf_dir)), model=model, num_trees=num_trees, partitions=PARTITIONS)


def classified(t, model="forest", num_trees=300):
    return _classified(t.spark, t.dir, model, num_trees)


@query()
def logistic_metrics(t):
    return classified(t, "logistic")["metrics"]


@query()
def logistic_report(t):
    return classified(t, "logistic")["report"]


@query()
def forest_threshold_sweep(t):
    return classified(t)["sweep"]


@query()
def forest_chosen_report(t):
    return classified(t)["chosen_report"]


@query()
def forest_report(t):
    return classified(t, num_trees=200)["report"]


@query()
def feature_importance(t):
    return classified(t)["importance"]


# --- what must hold of a fitted model, whatever it learnt

CITY_NAMES = "select distinct city f from v where city is not null"
LEARNT = f"with v as ({TABLE}), f as (select unnest([{', '.join(repr(c) for c in FEATURES)}]) f union all {CITY_NAMES})"


@query(LEARNT + """ select case when f in (select distinct city from v) then 'city_' || f else f end feature,
         true at_optimum from f union all select 'intercept', true""")
def logistic_optimum(t):
    """At the optimum the slope of the penalised loss is zero in every direction, measured by the feature's own size."""
    fitted, train = classified(t, "logistic")["classifier"], classified(t, "logistic")["train"]
    slopes = M.logistic_slopes(fitted, train, "high_rated")
    return slopes.select("feature", (F.abs("slope") <= 1e-3 * F.col("scale")).alias("at_optimum"))


def _split_sizes(label):
    return f"""with v as ({TABLE.replace('select ln', 'select case when rating >= 4.6 then 1 else 0 end high_rated, ln')}),
      c as (select high_rated, count(*) n, sum(count(*)) over () total from v group by 1),
      q as (select *, ceil(total * 0.2) size, floor(n * ceil(total * 0.2) / total) base,
              n * ceil(total * 0.2) - floor(n * ceil(total * 0.2) / total) * total rest from c),
      r as (select *, base + case when row_number() over (order by rest desc, high_rated)
              <= size - sum(base) over () then 1 else 0 end test from q) {label}"""


@query(_split_sizes("select cast(sum(test) as bigint) \"rows\", true unique_ids, true probabilities from r"))
def classifier_scores(t):
    """Every test row is scored once, with a probability."""
    return classified(t)["scored"].agg(
        F.count("*").alias("rows"), (F.count_distinct("place_id") == F.count("*")).alias("unique_ids"),
        F.bool_and(F.col("probability_1").between(0, 1)).alias("probabilities"))


@query(_split_sizes("""select cast(high_rated as varchar) "class", cast(test as bigint) support from r"""))
def report_support(t):
    """The classes of the report have the sizes that the split gives them."""
    return classified(t, "logistic")["report"].where("class in ('0', '1')").select(
        "class", F.col("support").cast("bigint").alias("support"))


@query(LEARNT + """ select least(count(*), 15) "rows", true known_names, true shares
         from (select distinct f from f) x""")
def importance_facts(t):
    """The importances of the named features are shares of one."""
    names = [*FEATURES, *[f"city_{r.city}" for r in t.city_demo.select("city").union(
        t.nation.select("n_name")).distinct().collect()]]
    return classified(t)["importance"].agg(
        F.count("*").alias("rows"), F.bool_and(F.col("feature").isin(names)).alias("known_names"),
        (F.bool_and(F.col("importance").between(0, 1)) & (F.sum("importance") <= 1.000001)).alias("shares"))


# --- facts that a model which has learnt nothing fails: large orders are to be told from small ones

ORDER_FEATURES = ["o_custkey", "o_orderkey", "o_totalprice"]


def order_rows(t):
    price = F.col("o_totalprice")
    return t.orders.select(*ORDER_FEATURES, "o_orderstatus", (price > 150000).cast("int").alias("large"))


def learnt_facts(scored, label="large"):
    """Loss and ranking of ``probability_1`` beside those of the base rate: both must be far better."""
    p = F.least(F.greatest("probability_1", F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col(label)
    sums = scored.agg(F.count("*").alias("rows"), F.avg(y).alias("rate"),
                      F.avg(-y * F.log(p) - (1 - y) * F.log(1 - p)).alias("loss"),
                      F.avg((y == (p > 0.5).cast("int")).cast("double")).alias("right"))
    base = -F.col("rate") * F.log("rate") - (1 - F.col("rate")) * F.log(1 - F.col("rate"))
    return sums.select("rows", (F.col("loss") < 0.5 * base).alias("half_the_loss"), (F.col("right") > 0.9).alias("mostly_right"))


LEARNT_ORDERS = 'select count(*) "rows", true half_the_loss, true mostly_right from orders'


def fitted_orders(t, fit, **options):
    return fit(order_rows(t), "large", ORDER_FEATURES, ["o_orderstatus"], partitions=PARTITIONS, key="o_orderkey", **options)


@query(LEARNT_ORDERS)
def forest_learnt(t):
    return learnt_facts(fitted_orders(t, M.fit_forest, num_trees=20, max_depth=8).score(order_rows(t)))


@query(LEARNT_ORDERS)
def logistic_learnt(t):
    return learnt_facts(fitted_orders(t, M.fit_logistic, c=1e4).score(order_rows(t)))


@query("select 'o_totalprice' feature, true over_half")
def importance_learnt(t):
    """The one feature that decides is found."""
    found = M.feature_importance(fitted_orders(t, M.fit_forest, num_trees=20, max_depth=8), order_rows(t), 1)
    return found.select("feature", (F.col("importance") > 0.5).alias("over_half"))


@query("""select rating, price_level, count(*) "rows", true one_cluster from (
            select cast(rating as double) rating, price_level from enriched_zip where median_household_income > 0
              and population_total > 1000 and """ + " and ".join(f"{c} is not null" for c in K.CLUSTER_FEATURES) + """) x
          group by 1, 2""")
def cluster_points_facts(t):
    """All clustered places are points, and each point is of the cluster whose mean is nearest to its place."""
    rows = clusters(t)
    points = charts.cluster_points(rows).groupBy("rating", "price_level", "cluster").agg(F.count("*").alias("n"))
    scaled = [f"{c}_scaled" for c in K.CLUSTER_FEATURES]
    nearest = _with_nearest(standardize(rows, K.CLUSTER_FEATURES), scaled).groupBy(
        "rating", "price_level", F.col("nearest").alias("cluster")).agg(F.count("*").alias("m"))
    met = points.join(nearest, ["rating", "price_level", "cluster"], "full")
    return met.groupBy("rating", "price_level").agg(
        F.sum("n").alias("rows"), F.bool_and(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("one_cluster"))


def _with_nearest(points, cols, cluster="cluster"):
    """``nearest``: the cluster whose mean is nearest to the row."""
    means = points.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols]).agg(
        F.collect_list(F.struct(F.col(cluster).alias("k"), F.array(*cols).alias("at")))).scalar()
    away = F.array_min(F.transform("_means", lambda m: F.struct(
        sum(((F.col(c) - m["at"][i]) ** 2 for i, c in enumerate(cols)), F.lit(0.0)).alias("d"), m["k"].alias("k"))))
    return points.withColumn("_means", means).withColumn("nearest", away["k"]).drop("_means")


# --- trees without limits

TREE_FEATURES = ["log_reviews", "price_level", "population_total", "median_age", "median_household_income"]
TREE_ROWS = f"""with v as (select place_id, case when rating >= 4.6 then 1 else 0 end y, {{}}
    from (select place_id, rating, ln(1 + cast(user_ratings_total as double)) log_reviews, {', '.join(TREE_FEATURES[1:])}
          from enriched_zip where rating is not null) x where {' and '.join(f'{c} is not null' for c in TREE_FEATURES)})"""


def tree_rows(t):
    return M.classifier_table(places(t)).select("place_id", "high_rated", *TREE_FEATURES).na.drop()


@query("""select cast(sum(n) as bigint) "rows", cast(sum(greatest(n - ones, ones)) as bigint) learnt
          from (select count(*) n, sum(case when s_suppkey % 3 = 0 then 1 else 0 end) ones from supplier
                group by s_acctbal, s_nationkey) g""")
def exact_tree_learns_all(t):
    """A tree without limits separates all rows that differ: it errs only where equal rows have different labels."""
    features = ["s_acctbal", "s_nationkey"]
    rows = t.supplier.select("s_suppkey", *features, (F.col("s_suppkey") % 3 == 0).cast("int").alias("y"))
    scored = X.fit_exact_trees(rows, "y", features, "s_suppkey").score(rows, "s_suppkey")
    groups = rows.join(scored, "s_suppkey").groupBy(*features).agg(
        F.count("*").alias("n"), F.avg("y").alias("own"), F.min("probability_1").alias("p"), F.max("probability_1").alias("most"))
    agreed = (F.abs(F.col("p") - F.col("own")) < 1e-9) & (F.col("p") == F.col("most"))
    right = F.round(F.greatest(F.col("p"), 1 - F.col("p")) * F.col("n"))
    return groups.agg(F.sum("n").alias("rows"), F.sum(F.when(agreed, right).otherwise(0)).cast("long").alias("learnt"))


def _cuts_sql():
    """The first two levels by trying every cut between neighbouring values."""
    values = " union all ".join(f"select node, y, {i} f, cast({c} as double) x from {{0}}" for i, c in enumerate(TREE_FEATURES))
    level = """ l{0} as (""" + values.replace("{0}", "r{0}") + """),
      s{0} as (select *, sum(a) over w l0, sum(b) over w l1, sum(a) over (partition by node, f) t0,
                 sum(b) over (partition by node, f) t1, lead(x) over w nxt
               from (select node, f, x, cast(sum(1 - y) as double) a, cast(sum(y) as double) b from l{0} group by 1, 2, 3) g
               window w as (partition by node, f order by x)),
      c{0} as (select *, x / 2 + nxt / 2 threshold, row_number() over (partition by node order by
                 (l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (t0 - l0 + t1 - l1) desc,
                 f, x) best from s{0} where nxt is not null),
      b{0} as (select * from c{0} where best = 1)"""
    names = "[" + ", ".join(f"'{c}'" for c in TREE_FEATURES) + "]"
    at = "[" + ", ".join(f"cast({c} as double)" for c in TREE_FEATURES) + "]"
    out = """ select {0} "level", node, cast(t0 as bigint) n0, cast(t1 as bigint) n1, """ + names + """[f + 1] feature,
        round(threshold, 6) threshold from b{0}"""
    step = ", r1 as (select r0.* exclude (node), case when " + at + "[b0.f + 1] <= b0.threshold then 2 else 3 end node from r0, b0),"
    return (TREE_ROWS.format(", ".join(TREE_FEATURES)) + ", r0 as (select *, 1 node from v)," + level.replace("{0}", "0") + step
            + level.replace("{0}", "1") + out.replace("{0}", "0") + " union all " + out.replace("{0}", "1"))


@query(_cuts_sql())
def exact_tree_cuts(t):
    """The first two cuts of a tree, out of all values of all features."""
    nodes = X.fit_exact_trees(tree_rows(t), "high_rated", TREE_FEATURES, "place_id", max_levels=2).nodes()
    return nodes.where("feature is not null").select(
        "level", F.col("node").cast("int").alias("node"), "n0", "n1", "feature", F.round("threshold", 6).alias("threshold"))


def _fixed_point(points, cols, cluster="cluster"):
    """Rows, and rows that are nearer to the mean of another cluster than to that of their own."""
    return _with_nearest(points, cols, cluster).agg(
        F.count("*").alias("rows"), F.count_if(F.col("nearest") != F.col(cluster)).alias("nearer_elsewhere"))


@query("""select count(*) "rows", cast(0 as bigint) nearer_elsewhere from enriched_zip where median_household_income > 0
            and population_total > 1000 and """ + " and ".join(f"{c} is not null" for c in K.CLUSTER_FEATURES))
def kmeans_fixed_point(t):
    scaled = [f"{c}_scaled" for c in K.CLUSTER_FEATURES]
    return _fixed_point(standardize(clusters(t), K.CLUSTER_FEATURES), scaled)


@query("select count(*) \"rows\", cast(0 as bigint) nearer_elsewhere from embeddings")
def kmeans_embeddings_fixed_point(t):
    points = M.kmeans_vectors(t.embeddings, "embedding", k=4, partitions=PARTITIONS, key="vec_id")
    size = points.select(F.size("embedding")).first()[0]
    cols = [f"x{i}" for i in range(size)]
    return _fixed_point(points.select("cluster", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols)
