"""Queries about count queries, task utility, facility location, models, generators and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.geo import haversine_km
from veilmark.operators import counts as Q
from veilmark.operators import facility as L
from veilmark.operators import generalize as G
from veilmark.operators import hierarchy as H
from veilmark.operators import models as M
from veilmark.operators import prep, scores, synth
from veilmark.operators.stages import staged
from veilmark.sources.tables import merge_results, table

from .frames import PARTS_SQL, PEOPLE, PEOPLE_SQL, VECTOR, holdout, original, parts, people, people_hierarchies, release

_r = F.round
QID = list(PEOPLE.qid)
N_QUERIES = Q.WORKLOAD
NUMERIC, CATEGORICAL = ["size", "price"], ["brand", "type"]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """``(column, node, leaf)`` of all quasi-identifiers."""
    all_ = [H.leaf_nodes(h).select(F.col("attribute").alias("column"), "node", "leaf") for h in people_hierarchies(spark, d).values()]
    return all_[0].unionByName(all_[1]).unionByName(all_[2])


def _workload(spark: SparkSession, d: str) -> DataFrame:
    """An arithmetic workload: a leaf is asked for if ``(query * 31 + leaf * 17) % 7 < 3``."""
    from pyspark.sql import Window

    leaves = _nodes(spark, d).where("node = leaf").select("column", "leaf").distinct()
    order = F.when(F.col("column") == "band", F.lpad("leaf", 3, "0")).otherwise(F.col("leaf"))
    # one row a leaf of the hierarchies
    placed = leaves.withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy(order)) - 1)
    asked = placed.withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(N_QUERIES - 1)).cast("array<long>")))
    use = F.when(F.col("column") == "nation", F.lit(True)).when(F.col("column") == "segment", F.col("query_id") % 2 == 0).otherwise(F.col("query_id") % 3 == 0)
    return asked.where(use & ((F.col("query_id") * 31 + F.col("i") * 17) % 7 < 3)).select("query_id", "column", "leaf")


def count_queries_exact(spark: SparkSession, d: str) -> DataFrame:
    combos = G.distinct_combinations(people(spark, d).withColumn("band", F.col("band").cast("string")), QID)
    return Q.estimate(combos, QID, _workload(spark, d), _nodes(spark, d)).select("query_id", _r("estimate", 6).alias("estimate"))


def count_queries_estimated(spark: SparkSession, d: str) -> DataFrame:
    g = G.generalize(people(spark, d), people_hierarchies(spark, d), VECTOR)
    return Q.estimate(G.distinct_combinations(g, QID), QID, _workload(spark, d), _nodes(spark, d)).select("query_id", _r("estimate", 6).alias("estimate"))


def count_queries_random(spark: SparkSession, d: str) -> DataFrame:
    """The seeded workload of 2000 queries, counted on the original."""
    combos = G.distinct_combinations(people(spark, d).withColumn("band", F.col("band").cast("string")), QID)
    nodes = _nodes(spark, d).where("node = leaf")
    return Q.estimate(combos, QID, staged(Q.random_workload(nodes.select("column", "leaf")), "workload"), nodes).select("query_id", _r("estimate", 6).alias("estimate"))


def query_relative_error(spark: SparkSession, d: str) -> DataFrame:
    return Q.relative_error(count_queries_exact(spark, d), count_queries_estimated(spark, d)).select(_r("relative_error", 4).alias("relative_error"))


SCOPES = {"qid": QID, "others": ["tier", "digit"], "all": [*QID, "tier", "digit"]}


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    """People with two columns that are no quasi-identifiers: twenty equal tiers of the balance, and the key's last digit."""
    df = people(spark, d)
    return df.withColumn("tier", prep.bucketize(F.col("balance"), -1000.0, 10000.0, 20).cast("string")).withColumn("digit", (F.col("rid") % 10).cast("string"))


def _scope_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all columns; those without a hierarchy are their own leaves."""
    own = [spark.range(n).select(F.lit(c).alias("column"), F.col("id").cast("string").alias("node"), F.col("id").cast("string").alias("leaf")) for c, n in (("tier", 20), ("digit", 10))]
    return _nodes(spark, d).unionByName(own[0]).unionByName(own[1])


def _scope_workload(spark: SparkSession, d: str, scope: str) -> DataFrame:
    """The seeded workload of one scope."""
    nodes = _scope_nodes(spark, d).where("node = leaf").where(F.col("column").isin(SCOPES[scope]))
    return Q.random_workload(nodes.select("column", "leaf"))


def count_queries_scopes(spark: SparkSession, d: str) -> DataFrame:
    """2000 seeded queries in each of three scopes, counted on the original and estimated on the generalised people."""
    rows, nodes = _scoped(spark, d), _scope_nodes(spark, d)
    released = G.generalize(rows, people_hierarchies(spark, d), VECTOR)
    out = None
    for scope, columns in SCOPES.items():
        asked = staged(_scope_workload(spark, d, scope), "workload")  # drawn once, read many times
        real, guess = (Q.estimate(G.distinct_combinations(x.withColumn("band", F.col("band").cast("string")), columns), columns, asked, nodes) for x in (rows, released))
        one = real.withColumnRenamed("estimate", "real").join(guess, "query_id").select(F.lit(scope).alias("scope"), "query_id", _r("real", 4).alias("real"), _r("estimate", 4).alias("estimate"))
        out = one if out is None else out.unionByName(one)
    return out


def query_relative_error_scopes(spark: SparkSession, d: str) -> DataFrame:
    both = count_queries_scopes(spark, d)
    error = F.when(F.col("real") != 0, F.abs(F.col("real") - F.col("estimate")) / F.col("real"))
    return both.groupBy("scope").agg(_r(F.avg(error), 4).alias("relative_error"), F.count_if(F.col("real") == 0).alias("empty_queries"))


def count_predicates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return Q.exact(o, {i: (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000.0 * i) for i in range(120)})


def bucketize(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(prep.bucketize(F.col("o_totalprice"), 10000.0, 300000.0, 40).alias("bucket")).agg(F.count("*").alias("n"))


def patient_weight(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    w = L.patient_weight(k % 2, k % 82 + 1, (k % 3 == 0).cast("int"), k % 200 + 60, k % 30 + 15, F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), (k % 3 + 1).cast("int")), k % 200000)
    return c.select(k.alias("rid"), F.col("c_nationkey").alias("zone"), _r(w, 6).alias("weight"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("zone"), (k * 3 % 50 + 20).cast("double").alias("lat"), (k * 7 % 100 - 120).cast("double").alias("lon"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("site"), (k * 11 % 50 + 20).cast("double").alias("lat"), (k * 13 % 100 - 120).cast("double").alias("lon"))


def haversine_matrix(spark: SparkSession, d: str) -> DataFrame:
    return L.distance_table(_zones(spark, d), _sites(spark, d)).select("zone", "site", _r("km", 6).alias("km"))


def haversine_pair(spark: SparkSession, d: str) -> DataFrame:
    z = _zones(spark, d)
    return z.select("zone", _r(haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0)), 6).alias("km"))


def zone_demand(spark: SparkSession, d: str) -> DataFrame:
    return L.demand(patient_weight(spark, d), "zone", "weight").select("zone", _r("weight", 4).alias("weight"))


def facility_assignment_cost(spark: SparkSession, d: str) -> DataFrame:
    chosen = _sites(spark, d).where("site % 4 = 0")
    return L.assignment_cost(L.demand(patient_weight(spark, d), "zone", "weight"), L.distance_table(_zones(spark, d), _sites(spark, d)), chosen).select(_r("cost", 2).alias("cost"))


def facility_greedy(spark: SparkSession, d: str) -> DataFrame:
    sites, cost = L.choose_sites(L.demand(patient_weight(spark, d), "zone", "weight"), L.distance_table(_zones(spark, d), L.places(_sites(spark, d))))
    return spark.createDataFrame([(s, round(cost, 2)) for s in sites], "site long, cost double")


def facility_median(spark: SparkSession, d: str) -> DataFrame:
    """Ten sites with the cost, the proven lower bound and the gap between them."""
    m = L.p_median(L.demand(patient_weight(spark, d), "zone", "weight"), L.distance_table(_zones(spark, d), L.places(_sites(spark, d))))
    return spark.createDataFrame([(s, round(m.cost, 2), round(m.lower, 2), round(m.gap, 6)) for s in m.sites], "site long, cost double, lower_bound double, gap double")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return p.select("rid", F.col("price").alias("truth"), (F.col("price") + F.col("rid") % 11 - 5).alias("guess"), (F.col("size") % 3).alias("t"), ((F.col("size") + F.when(F.col("rid") % 5 == 0, 1).otherwise(0)) % 3).alias("g"))


def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scores.regression_scores(_predicted(spark, d), "truth", "guess")
    return s.select(*[_r(c, 6).alias(c) for c in s.columns])


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    s = scores.classification_report(_predicted(spark, d), "t", "g")
    return s.select(*[_r(c, 6).alias(c) for c in s.columns if c != "support"], "support")


def _results(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.element_at(F.array(*map(F.lit, ["train", "synth_a", "synth_b", "anon_k5"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    metric = F.element_at(F.array(F.lit("close"), F.lit("aia"), F.lit("median")), (F.col("p_size") % 3 + 1).cast("int"))
    long = p.groupBy(name.alias("release"), metric.alias("metric")).agg(_r(F.avg("p_retailprice"), 6).alias("value"))
    return long.select(F.lit("parts").alias("dataset"), "release", F.lit("all").alias("scope"), F.lit("o").alias("target"), "metric", F.when(F.col("metric") == "aia", "price").otherwise("").alias("attribute"), "value")


def condense_pivot(spark: SparkSession, d: str) -> DataFrame:
    return scores.condense(_results(spark, d), ["aia__price", "close", "median"])


def results_merged(spark: SparkSession, d: str) -> DataFrame:
    new = _results(spark, d).where("release = 'train'").withColumn("value", F.lit(1.5))
    return merge_results(_results(spark, d), new).select("release", "metric", "value")


def relative_cost(spark: SparkSession, d: str) -> DataFrame:
    return scores.relative_cost(_results(spark, d).where("metric = 'close'")).select("dataset", "release", _r("ratio", 6).alias("ratio"))


def synth_marginal(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return synth.marginals(spark, df, ["brand", "type"], df.count(), 5)


def synth_tree(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return synth.tree(spark, df, {"type": None, "brand": "type"}, df.count(), 5)


def synth_network(spark: SparkSession, d: str) -> DataFrame:
    """Sizes given brand and type, which are drawn apart, so that pairs occur which the original does not hold: these back off to the brand."""
    df = parts(spark, d)
    return synth.network(spark, df, {"type": [], "brand": [], "size": ["brand", "type"]}, df.count(), 5)


def synth_learnt(spark: SparkSession, d: str) -> DataFrame:
    """Categories drawn along the network that hill climbing finds in the original."""
    df = original(parts(spark, d)).withColumn("size", F.col("size").cast("string"))
    columns = ["type", "grp", "brand", "size"]
    states = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first().asDict()
    up = M.network_parents(df, columns, states)
    return synth.network(spark, df, {c: sorted(up[c]) for c in columns}, df.count(), 5)


def synth_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and prices with the original's distributions by type and its correlation."""
    df = parts(spark, d)
    return synth.numbers(spark, df, ["size", "price"], df.count(), 5, by="type")


def synth_dependency_tree(spark: SparkSession, d: str) -> DataFrame:
    df = people(spark, d).select("nation", "region", "segment")
    found = synth.dependency_tree(df, ["region", "nation", "segment"])
    return spark.createDataFrame([(c, p or "") for c, p in found.items()], "child string, parent string")


def gmm_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d).select("rid", F.col("size").cast("double").alias("size"), "price")
    model = M.best_mixture(original(df), NUMERIC)
    return spark.createDataFrame([(len(model.weights), model.log_likelihood(release(df), NUMERIC))], "components int, log_likelihood double")


def gmm_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Mean log-likelihood of the release under two given components."""
    model = M.DiagonalMixture([0.25, 0.75], [[10.0, 950.0], [30.0, 1200.0]], [[100.0, 2500.0], [225.0, 90000.0]])
    return spark.createDataFrame([(round(model.log_likelihood(release(parts(spark, d)), NUMERIC), 6),)], "log_likelihood double")


def detection_rate(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return M.detection_rate(original(df), release(df), NUMERIC, CATEGORICAL, "rid")


def _attacks(spark: SparkSession, d: str, attributes: list[str], features) -> DataFrame:
    df = parts(spark, d)
    std, own = (prep.sample_std(x, NUMERIC).first().asDict() for x in (original(df), release(df)))
    return M.attacks(release(df), {"o": original(df), "h": holdout(df)}, attributes, features, NUMERIC, std, own)


def ml_aia_qid(spark: SparkSession, d: str) -> DataFrame:
    """Every sensitive attribute from the quasi-identifiers."""
    return _attacks(spark, d, ["price", "grp"], lambda a: ["size", "type"])


def ml_aia_all(spark: SparkSession, d: str) -> DataFrame:
    """Every attribute from all the others; a group is a function of its brand and no feature of it."""
    return _attacks(spark, d, ["size", "price", "brand", "type"], lambda a: [*NUMERIC, *CATEGORICAL])


def generalization_aia(spark: SparkSession, d: str) -> DataFrame:
    """Every quasi-identifier's node in the release from the other quasi-identifiers, asked of held-out people."""
    h, rows = people_hierarchies(spark, d), people(spark, d)
    named = rows.select("rid", *QID, *[F.col(c).alias(f"true_{c}") for c in QID])
    release_, test = (G.generalize(x, h, VECTOR) for x in (rows.where("rid % 5 <> 0"), named.where("rid % 5 = 0")))
    return M.generalization_attacks(release_, test, {c: f"true_{c}" for c in QID}, {a: H.node_leaves(h[a]) for a in QID}, QID)


def relational_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Networks of the release against those of the original and of the holdout; states are the original's."""
    df = parts(spark, d).withColumn("size", F.col("size").cast("string"))
    columns = ["type", "grp", "brand", "size"]
    states = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first().asDict()
    sized = release(parts(spark, d)).withColumn("size", F.col("size").cast("string"))
    o, p, h = M.side_by_side(lambda x: M.network_edges(x, columns, states), [original(df), sized, holdout(df)])
    return spark.createDataFrame([("o", M.relational_similarity(o, p)), ("h", M.relational_similarity(h, p))], "target string, relational_similarity double")


def ml_utility_regression(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return scores.regression_scores(M.fit_predict(release(df), holdout(df), "price", ["size"], CATEGORICAL, True), "price", "guess")


def _classes(df: DataFrame) -> DataFrame:
    three = prep.banded(F.col("balance"), [2000, 8000], ["low", "middle", "high"])
    return df.withColumn("binary", F.when(F.col("balance") > 5000, "high").otherwise("low")).withColumn("three", three)


def learning_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many people each class of the two targets has."""
    df = _classes(people(spark, d))
    each = [df.groupBy(F.col(t).alias("class")).agg(F.count("*").alias("n")).select(F.lit(t).alias("target"), "class", "n") for t in ("binary", "three")]
    return each[0].unionByName(each[1])


def ml_utility_classification(spark: SparkSession, d: str) -> DataFrame:
    """Two targets learnt from a suppressed release and tried on the holdout, generalised alike or on a release sampled back.

    The band follows from the balance, so it is no feature.
    """
    h, rows = people_hierarchies(spark, d), people(spark, d)
    vector, qid = {"nation": 1, "segment": 0}, ["nation", "segment"]
    held = _classes(rows.where("rid % 5 = 0"))
    g = G.suppress(G.generalize(_classes(rows.where("rid % 5 <> 0")), h, vector), qid, 5).where("not suppressed")
    modes = {"generalize": (g, G.generalize_like(held, g, h, vector, qid)), "sample": (G.sample_to_original(g, h, ["nation"], "rid", 3), held)}

    def one(case: tuple[str, str]) -> DataFrame:
        mode, target = case
        report = scores.classification_report(M.fit_predict(*modes[mode], target, [], qid, False), target, "guess")
        return report.select(F.lit(mode).alias("mode"), F.lit(target).alias("target"), *report.columns)

    first, *others = M.side_by_side(one, [(mode, target) for mode in modes for target in ("binary", "three")])
    for other in others:
        first = first.unionByName(other)
    return first


QUERIES = {
    f.__name__: f
    for f in (
        count_queries_exact, count_queries_estimated, count_queries_random, query_relative_error, count_queries_scopes, query_relative_error_scopes, count_predicates, bucketize, patient_weight, haversine_matrix, haversine_pair, zone_demand, facility_assignment_cost, facility_greedy, facility_median,
        regression_scores, classification_report, condense_pivot, results_merged, relative_cost, synth_marginal, synth_tree, synth_network, synth_learnt, synth_numbers, synth_dependency_tree,
        gmm_log_likelihood, gmm_fixed, detection_rate, ml_aia_qid, ml_aia_all, generalization_aia, relational_similarity, ml_utility_regression, ml_utility_classification, learning_targets,
    )
}

_LEAVES = f"""{PEOPLE_SQL},
leaves AS (SELECT 'nation' AS col, n_name AS leaf, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation
  UNION ALL SELECT 'segment', s, row_number() OVER (ORDER BY s) - 1 FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)
  UNION ALL SELECT 'band', CAST(v AS VARCHAR), v - 1 FROM range(1, 101) t(v)),
asked AS (SELECT q AS query_id, col, leaf FROM leaves, range({N_QUERIES}) t(q) WHERE (q * 31 + i * 17) % 7 < 3 AND (col = 'nation' OR (col = 'segment' AND q % 2 = 0) OR (col = 'band' AND q % 3 = 0))),
ids AS (SELECT DISTINCT query_id FROM asked), uses AS (SELECT DISTINCT query_id, col FROM asked),
nodes AS (SELECT col, leaf AS node, leaf, 0 AS up FROM leaves UNION ALL SELECT 'nation', r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'segment', s, s, 1 FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) UNION ALL SELECT 'band', CAST((v - 1) // 10 AS VARCHAR), CAST(v AS VARCHAR), 1 FROM range(1, 101) t(v)),
shares AS (SELECT i.query_id, n.col, n.node, up, CASE WHEN max(u.col) IS NULL THEN 1.0 ELSE count(a.leaf) / count(*) END AS p FROM ids i CROSS JOIN nodes n
  LEFT JOIN uses u ON u.query_id = i.query_id AND u.col = n.col LEFT JOIN asked a ON a.query_id = i.query_id AND a.col = n.col AND a.leaf = n.leaf GROUP BY 1, 2, 3, 4),
combos AS (SELECT nation AS a, segment AS b, CAST(band AS VARCHAR) AS c, count(*) AS n, 0 AS up FROM people GROUP BY 1, 2, 3
  UNION ALL SELECT region, segment, CAST((band - 1) // 10 AS VARCHAR), count(*), 1 FROM people GROUP BY 1, 2, 3),
summed AS (SELECT x.query_id, m.up, sum(n * x.p * y.p * z.p) AS estimate FROM combos m JOIN shares x ON x.col = 'nation' AND x.node = a AND x.up = m.up AND x.p > 0
  JOIN shares y ON y.col = 'segment' AND y.node = b AND y.up = m.up AND y.query_id = x.query_id AND y.p > 0 JOIN shares z ON z.col = 'band' AND z.node = c AND z.up = m.up AND z.query_id = x.query_id AND z.p > 0 GROUP BY 1, 2),
exact AS (SELECT query_id, CAST(coalesce(estimate, 0) AS DOUBLE) AS estimate FROM ids LEFT JOIN (FROM summed WHERE up = 0) USING (query_id)),
guess AS (SELECT query_id, CAST(coalesce(estimate, 0) AS DOUBLE) AS estimate FROM ids LEFT JOIN (FROM summed WHERE up = 1) USING (query_id))"""
_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_SCOPED = f"""{PEOPLE_SQL}, wide AS (SELECT *, CAST(CASE WHEN balance >= -1000 AND balance < 10011 THEN least(floor((balance + 1000) / 550.0), 19) END AS BIGINT) AS tier, rid % 10 AS digit FROM people),
leaves AS (SELECT 'nation' AS col, n_name AS leaf FROM nation UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM customer UNION ALL SELECT 'band', CAST(v AS VARCHAR) FROM range(1, 101) t(v)
  UNION ALL SELECT 'tier', CAST(v AS VARCHAR) FROM range(20) t(v) UNION ALL SELECT 'digit', CAST(v AS VARCHAR) FROM range(10) t(v)),
scopes AS (SELECT 'qid' AS scope, unnest(['nation', 'segment', 'band']) AS col UNION ALL SELECT 'others', unnest(['tier', 'digit']) UNION ALL SELECT 'all', unnest(['nation', 'segment', 'band', 'tier', 'digit'])),
sizes AS (SELECT col, count(*) AS size FROM leaves GROUP BY 1), widths AS (SELECT scope, count(*) AS width FROM scopes GROUP BY 1),
drawn AS (SELECT scope, q, col, leaf, size, width, dense_rank() OVER (PARTITION BY scope, q ORDER BY {_HASH.format("q || '|' || col || '|69'")}, col) AS rank,
  row_number() OVER (PARTITION BY scope, q, col ORDER BY {_HASH.format("q || '|' || col || '|' || leaf || '|69'")}, leaf) AS nth
  FROM scopes JOIN leaves USING (col) JOIN sizes USING (col) JOIN widths USING (scope), range({N_QUERIES}) t(q)),
asked AS (SELECT scope, q, col, leaf FROM drawn WHERE rank <= {_HASH.format("q || '|columns|69'")} % width + 1 AND nth <= {_HASH.format("q || '|' || col || '|leaves|69'")} % size + 1),
uses AS (SELECT DISTINCT scope, q, col FROM asked), many AS (SELECT scope, q, count(*) AS m FROM uses GROUP BY 1, 2),
nodes AS (SELECT col, leaf AS node, leaf, 0 AS up FROM leaves UNION ALL SELECT 'nation', r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'band', CAST((CAST(leaf AS INT) - 1) // 10 AS VARCHAR), leaf, 1 FROM leaves WHERE col = 'band' UNION ALL SELECT col, leaf, leaf, 1 FROM leaves WHERE col IN ('segment', 'tier', 'digit')),
shares AS (SELECT u.scope, u.q, n.col, n.node, n.up, count(a.leaf) / count(*) AS p FROM uses u JOIN nodes n ON n.col = u.col
  LEFT JOIN asked a ON a.scope = u.scope AND a.q = u.q AND a.leaf = n.leaf AND a.col = n.col GROUP BY 1, 2, 3, 4, 5 HAVING count(a.leaf) > 0),
rows_ AS (SELECT nation, segment, CAST(band AS VARCHAR) AS band, CAST(tier AS VARCHAR) AS tier, CAST(digit AS VARCHAR) AS digit, 0 AS up, count(*) AS n FROM wide GROUP BY ALL
  UNION ALL SELECT region, segment, CAST((band - 1) // 10 AS VARCHAR), CAST(tier AS VARCHAR), CAST(digit AS VARCHAR), 1, count(*) FROM wide GROUP BY ALL),
combos AS (SELECT *, row_number() OVER () AS combo FROM rows_),
cells AS (UNPIVOT (SELECT combo, up, n, nation, segment, band, tier, digit FROM combos) ON nation, segment, band, tier, digit INTO NAME col VALUE node),
hits AS (SELECT scope, q, up, combo, any_value(n) AS n, count(*) AS h, product(p) AS p FROM cells JOIN shares USING (col, node, up) GROUP BY 1, 2, 3, 4),
found AS (SELECT scope, q, up, sum(n * p) AS estimate FROM hits JOIN many USING (scope, q) WHERE h = m GROUP BY 1, 2, 3),
both_ AS (SELECT scope, q AS query_id, round(coalesce(r.estimate, 0), 4)::DOUBLE AS real, round(coalesce(g.estimate, 0), 4)::DOUBLE AS estimate FROM many LEFT JOIN (FROM found WHERE up = 0) r USING (scope, q) LEFT JOIN (FROM found WHERE up = 1) g USING (scope, q))"""
_WEIGHT = """w AS (SELECT c_custkey AS rid, c_nationkey AS zone, round(100 * (0.05 * (k % 2) + 0.15 * (k % 82) / 81 + 0.2 * CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + 0.15 * (k % 200 + 5) / 226.59
  + 0.15 * (k % 30 + 4.7) / 87.3 + 0.1 * (k % 3) / 2 + 0.2 * (k % 200000) / 242857), 6) AS weight FROM (SELECT *, CAST(c_custkey AS DOUBLE) AS kd, c_custkey AS k FROM customer))"""
_GEO = """zones AS (SELECT n_nationkey AS zone, CAST(n_nationkey * 3 % 50 + 20 AS DOUBLE) AS lat, CAST(n_nationkey * 7 % 100 - 120 AS DOUBLE) AS lon FROM nation),
sites AS (SELECT s_suppkey AS site, CAST(s_suppkey * 11 % 50 + 20 AS DOUBLE) AS slat, CAST(s_suppkey * 13 % 100 - 120 AS DOUBLE) AS slon FROM supplier),
km AS (SELECT zone, site, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2)))) AS km FROM zones, sites)"""
_PRED = f"""{PARTS_SQL}, x AS (SELECT rid, price AS truth, price + rid % 11 - 5 AS guess, size % 3 AS t, (size + CASE WHEN rid % 5 = 0 THEN 1 ELSE 0 END) % 3 AS g FROM parts)"""
_RESULTS = """res AS (SELECT ['train', 'synth_a', 'synth_b', 'anon_k5'][p_partkey % 4 + 1] AS release, ['close', 'aia', 'median'][p_size % 3 + 1] AS metric, round(avg(p_retailprice), 6) AS value FROM part GROUP BY 1, 2)"""
_U = "CAST('0x' || substr(md5(rid || '|{c}|5'), 1, 8) AS BIGINT)"

SQL = {
    "learning_targets": f"""WITH {PEOPLE_SQL} SELECT 'binary' AS target, CASE WHEN balance > 5000 THEN 'high' ELSE 'low' END AS class, count(*) AS n FROM people GROUP BY 2
      UNION ALL SELECT 'three', CASE WHEN balance < 2000 THEN 'low' WHEN balance < 8000 THEN 'middle' ELSE 'high' END, count(*) FROM people GROUP BY 2""",
    "count_queries_exact": f"WITH {_LEAVES} SELECT query_id, estimate FROM exact",
    "count_queries_estimated": f"WITH {_LEAVES} SELECT query_id, round(estimate, 6) AS estimate FROM guess",
    "count_queries_random": f"""WITH {_LEAVES.split("asked AS")[0]} per AS (SELECT col, count(*) AS size FROM leaves GROUP BY 1), drawn AS (SELECT q, col, leaf,
        dense_rank() OVER (PARTITION BY q ORDER BY CAST('0x' || substr(md5(q || '|' || col || '|69'), 1, 8) AS BIGINT), col) AS rank,
        row_number() OVER (PARTITION BY q, col ORDER BY CAST('0x' || substr(md5(q || '|' || col || '|' || leaf || '|69'), 1, 8) AS BIGINT), leaf) AS nth FROM leaves, range(2000) t(q)),
      asked AS (SELECT q, col, leaf FROM drawn JOIN per USING (col) WHERE rank <= CAST('0x' || substr(md5(q || '|columns|69'), 1, 8) AS BIGINT) % 3 + 1
        AND nth <= CAST('0x' || substr(md5(q || '|' || col || '|leaves|69'), 1, 8) AS BIGINT) % size + 1),
      many AS (SELECT q, count(DISTINCT col) AS m FROM asked GROUP BY 1),
      combos AS (SELECT nation, segment, CAST(band AS VARCHAR) AS band, count(*) AS n, row_number() OVER () AS combo FROM people GROUP BY 1, 2, 3),
      cells AS (SELECT combo, n, 'nation' AS col, nation AS leaf FROM combos UNION ALL SELECT combo, n, 'segment', segment FROM combos UNION ALL SELECT combo, n, 'band', band FROM combos),
      hits AS (SELECT q, combo, any_value(n) AS n, count(*) AS h FROM cells JOIN asked USING (col, leaf) GROUP BY 1, 2)
      SELECT many.q AS query_id, CAST(coalesce(sum(n), 0) AS DOUBLE) AS estimate FROM many LEFT JOIN hits ON hits.q = many.q AND h = m GROUP BY 1""",
    "query_relative_error": f"WITH {_LEAVES} SELECT round(avg(abs(e.estimate - g.estimate) / e.estimate) FILTER (e.estimate <> 0), 4) AS relative_error FROM exact e JOIN guess g USING (query_id)",
    "count_queries_scopes": f"WITH {_SCOPED} SELECT scope, query_id, real, estimate FROM both_",
    "query_relative_error_scopes": f"WITH {_SCOPED} SELECT scope, round(avg(CASE WHEN real <> 0 THEN abs(real - estimate) / real END), 4) AS relative_error, count(*) FILTER (real = 0) AS empty_queries FROM both_ GROUP BY 1",
    "count_predicates": "SELECT i AS query_id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 * i) AS count FROM range(120) t(i)",
    "bucketize": "SELECT CASE WHEN o_totalprice >= 10000 AND o_totalprice < 300290 THEN CAST(least(floor((o_totalprice - 10000) / 7250.0), 39) AS BIGINT) END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "patient_weight": f"WITH {_WEIGHT} SELECT rid, zone, weight FROM w",
    "haversine_matrix": f"WITH {_GEO} SELECT zone, site, round(km, 6) AS km FROM km",
    "haversine_pair": f"WITH {_GEO} SELECT zone, round(2 * 6371.0088 * asin(sqrt(pow(sin(-radians(lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(-lon) / 2), 2))), 6) AS km FROM zones",
    "zone_demand": f"WITH {_WEIGHT} SELECT zone, round(sum(weight), 4) AS weight FROM w GROUP BY 1",
    "facility_assignment_cost": f"WITH {_WEIGHT}, {_GEO}, near AS (SELECT zone, min(km) AS km FROM km WHERE site % 4 = 0 GROUP BY 1) SELECT round(sum(weight * km), 2) AS cost FROM w JOIN near USING (zone)",
    "regression_scores": f"""WITH {_PRED} SELECT round(avg(pow(truth - guess, 2)), 6) AS mse, round(avg(abs(truth - guess)), 6) AS mae, round(sqrt(avg(pow(truth - guess, 2))), 6) AS rmse,
      round(1 - avg(pow(truth - guess, 2)) / var_pop(truth), 6) AS r2 FROM x""",
    "classification_report": f"""WITH {_PRED}, c AS (SELECT DISTINCT t AS c FROM x UNION SELECT DISTINCT g FROM x),
      s AS (SELECT c, count(*) FILTER (t = c AND g = c) AS tp, count(*) FILTER (t = c) AS sup, count(*) FILTER (g = c) AS said FROM x, c GROUP BY 1),
      m AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS r FROM s)
      SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(p * sup) / sum(sup), 6) AS precision, round(sum(r * sup) / sum(sup), 6) AS recall,
        round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * sup) / sum(sup), 6) AS f1, CAST(sum(sup) AS BIGINT) AS support FROM m""",
    "condense_pivot": f"""WITH {_RESULTS}, f AS (SELECT *, unnest(CASE WHEN release = 'train' THEN ['a', 's'] WHEN release LIKE 'anon%' THEN ['a'] ELSE ['s'] END) AS family FROM res)
      SELECT 'parts' AS dataset, family, 'o' AS target, 'all' AS scope, release, max(value) FILTER (metric = 'aia') AS aia__price, max(value) FILTER (metric = 'close') AS close, max(value) FILTER (metric = 'median') AS median
      FROM f GROUP BY family, release""",
    "results_merged": f"WITH {_RESULTS} SELECT release, metric, CASE WHEN release = 'train' THEN 1.5 ELSE value END AS value FROM res",
    "relative_cost": f"WITH {_RESULTS} SELECT 'parts' AS dataset, release, round(value / (SELECT value FROM res WHERE release = 'train' AND metric = 'close'), 6) AS ratio FROM res WHERE metric = 'close'",
    "gmm_fixed": f"""WITH {PARTS_SQL}, g(w, m1, m2, v1, v2) AS (VALUES (0.25, 10.0, 950.0, 100.0, 2500.0), (0.75, 30.0, 1200.0, 225.0, 90000.0)),
      x AS (SELECT rid, sum(w / (2 * pi() * sqrt(v1 * v2)) * exp(-pow(size - m1, 2) / (2 * v1) - pow(price - m2, 2) / (2 * v2))) AS d FROM p, g GROUP BY 1) SELECT round(avg(ln(d)), 6) AS log_likelihood FROM x""",
    "synth_marginal": f"""WITH {PARTS_SQL}, bc AS (SELECT brand, ceil(sum(count(*)) OVER (ORDER BY brand) / (SELECT count(*) FROM parts) * 4294967296) AS e FROM parts GROUP BY 1),
      tc AS (SELECT type, ceil(sum(count(*)) OVER (ORDER BY type) / (SELECT count(*) FROM parts) * 4294967296) AS e FROM parts GROUP BY 1)
      SELECT rid, (SELECT min(brand) FROM bc WHERE e = (SELECT min(e) FROM bc WHERE e > {_U.format(c="brand")})) AS brand, (SELECT min(type) FROM tc WHERE e = (SELECT min(e) FROM tc WHERE e > {_U.format(c="type")})) AS type FROM (SELECT unnest(range((SELECT count(*) FROM parts))) AS rid)""",
    "synth_tree": f"""WITH {PARTS_SQL}, tc AS (SELECT type, ceil(sum(count(*)) OVER (ORDER BY type) / (SELECT count(*) FROM parts) * 4294967296) AS e FROM parts GROUP BY 1),
      bc AS (SELECT type, brand, ceil(sum(count(*)) OVER (PARTITION BY type ORDER BY brand) / sum(count(*)) OVER (PARTITION BY type) * 4294967296) AS e FROM parts GROUP BY 1, 2),
      ids AS (SELECT unnest(range((SELECT count(*) FROM parts))) AS rid), u AS (SELECT rid, {_U.format(c="type")} AS ut, {_U.format(c="brand")} AS ub FROM ids),
      t AS (SELECT rid, ub, arg_min(type, e) AS type FROM u JOIN tc ON e > ut GROUP BY 1, 2)
      SELECT rid, t.type, arg_min(brand, e) AS brand FROM t JOIN bc ON bc.type = t.type AND e > ub GROUP BY 1, 2""",
    "synth_network": f"""WITH {PARTS_SQL}, tc AS (SELECT type, ceil(sum(count(*)) OVER (ORDER BY type) / (SELECT count(*) FROM parts) * 4294967296) AS e FROM parts GROUP BY 1),
      bc AS (SELECT brand, ceil(sum(count(*)) OVER (ORDER BY brand) / (SELECT count(*) FROM parts) * 4294967296) AS e FROM parts GROUP BY 1),
      s2 AS (SELECT brand, type, size, ceil(sum(count(*)) OVER (PARTITION BY brand, type ORDER BY size) / sum(count(*)) OVER (PARTITION BY brand, type) * 4294967296) AS e FROM parts GROUP BY 1, 2, 3),
      s1 AS (SELECT brand, size, ceil(sum(count(*)) OVER (PARTITION BY brand ORDER BY size) / sum(count(*)) OVER (PARTITION BY brand) * 4294967296) AS e FROM parts GROUP BY 1, 2),
      ids AS (SELECT unnest(range((SELECT count(*) FROM parts))) AS rid), u AS (SELECT rid, {_U.format(c="type")} AS ut, {_U.format(c="brand")} AS ub, {_U.format(c="size")} AS us FROM ids),
      t AS (SELECT rid, ub, us, arg_min(type, e) AS type FROM u JOIN tc ON e > ut GROUP BY 1, 2, 3), b AS (SELECT rid, us, t.type, arg_min(brand, e) AS brand FROM t JOIN bc ON e > ub GROUP BY 1, 2, 3),
      two AS (SELECT rid, arg_min(size, e) AS size FROM b JOIN s2 ON s2.brand = b.brand AND s2.type = b.type AND e > us GROUP BY 1), one AS (SELECT rid, arg_min(size, e) AS size FROM b JOIN s1 ON s1.brand = b.brand AND e > us GROUP BY 1)
      SELECT rid, b.type, b.brand, coalesce(two.size, one.size) AS size FROM b LEFT JOIN two USING (rid) LEFT JOIN one USING (rid)""",
    "synth_dependency_tree": f"""WITH {PEOPLE_SQL},
      j AS (SELECT 'region' AS a, 'nation' AS b, region AS x, nation AS y FROM people UNION ALL SELECT 'region', 'segment', region, segment FROM people UNION ALL SELECT 'nation', 'segment', nation, segment FROM people),
      c AS (SELECT a, b, x, y, count(*) AS n FROM j GROUP BY 1, 2, 3, 4),
      m AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a, b, x) AS nx, sum(n) OVER (PARTITION BY a, b, y) AS ny, sum(n) OVER (PARTITION BY a, b) AS t FROM c),
      mi AS (SELECT a, b, sum(n / t * ln(n * t / (nx * ny))) AS v FROM m GROUP BY 1, 2),
      f AS (SELECT arg_max(b, v) AS child FROM mi WHERE a = 'region'), l AS (SELECT CASE child WHEN 'nation' THEN 'segment' ELSE 'nation' END AS child FROM f),
      p AS (SELECT arg_max(CASE WHEN a = child THEN b ELSE a END, v) AS parent FROM mi, l WHERE child IN (a, b))
      SELECT 'region' AS child, '' AS parent UNION ALL SELECT child, 'region' FROM f UNION ALL SELECT child, parent FROM l, p""",
}
