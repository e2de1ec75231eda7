"""Queries about distances, neighbours, privacy metrics and attribute inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.ranges import interval_text, parse_range
from veilmark.operators import distance as D
from veilmark.operators import evaluate as E
from veilmark.operators import knn, prep
from veilmark.operators import privacy as P
from veilmark.operators import totals as T
from veilmark.operators.dispatch import Distances, domains
from veilmark.operators.generalize import generalize
from veilmark.operators.hierarchy import Hierarchy, first_level, interval_hierarchy, order_hierarchy
from veilmark.operators.models import side_by_side
from veilmark.operators.pruned import Category, Metric, Number

from .frames import PARTS, PARTS_SQL, QID_SQL, SIZE_WIDTH, holdout, original, parts, release

_r = F.round


def _c(name: str) -> tuple[Column, Column]:
    return F.col(f"q_{name}"), F.col(f"c_{name}")


def brand_distance() -> Column:
    root = F.lit("*")
    return D.edge([F.col("q_brand"), F.col("q_grp"), root], [F.col("c_brand"), F.col("c_grp"), root])


def type_distance() -> Column:
    return D.edge([F.col("q_type"), F.lit("*")], [F.col("c_type"), F.lit("*")])


def qid_distance() -> Column:
    return D.record({"size": D.numeric(*_c("size"), SIZE_WIDTH), "brand": brand_distance(), "type": type_distance()})


_BRAND_PART = Category(("brand", "grp"), lambda side: [F.col(f"{side}_brand"), F.col(f"{side}_grp")])
_TYPE_PART = Category(("type",), lambda side: [F.col(f"{side}_type")])


def qid_metric() -> Metric:
    """:func:`qid_distance` with its bounds."""
    return Metric((Number("size", SIZE_WIDTH), _BRAND_PART, _TYPE_PART))


def all_metric(price_width: float) -> Metric:
    return Metric((Number("size", SIZE_WIDTH), _BRAND_PART, _TYPE_PART, Number("price", price_width)))


def _brands(df: DataFrame) -> Hierarchy:
    """Brands below their groups of ten."""
    return order_hierarchy(df, "brand", F.concat(F.lit("group "), F.floor(F.regexp_extract("brand", r"(\d+)$", 1).cast("int") / F.lit(10)).cast("string")))


def _price_width(df: DataFrame) -> float:
    row = df.agg(F.min("price").alias("a"), F.max("price").alias("b")).first()
    return row["b"] - row["a"]


def _combos(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _back(df: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``found`` (by ``q_*`` combination) for every row of ``df``; nulls are values too."""
    same = [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys]
    return df.select("rid", *keys).join(found, same).drop(*keys, *[f"q_{k}" for k in keys])


def _summary(df: DataFrame, cand: DataFrame, d: Column, keys: list[str], cand_keys: list[str] | None = None) -> DataFrame:
    """Sum, least and greatest distance of every row of ``df`` to all rows of ``cand``.

    Distances are computed between distinct combinations only, and count as
    often as the candidate's combination occurs.
    """
    p = knn.pairs(_combos(df, keys).drop("n"), _combos(cand, cand_keys or keys)).groupBy(*[f"q_{k}" for k in keys])
    found = p.agg(_r(F.sum(d * F.col("c_n")), 6).alias("total"), _r(F.min(d), 6).alias("least"), _r(F.max(d), 6).alias("most"))
    return _back(df, keys, found)


def _record_summary(df: DataFrame, cand: DataFrame, metric: Metric) -> DataFrame:
    """:func:`_summary` of a record distance that is told column by column."""
    found = T.summary(df, cand, metric)
    return _back(df, metric.keys, found.withColumns({n: _r(n, 6) for n in ("total", "least", "most")}))


def distance_numeric(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return _summary(df, df, D.numeric(*_c("size"), SIZE_WIDTH), ["size"])


def distance_numeric_generalized(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    value = F.when(F.col("rid") % 3 == 0, "*").otherwise(interval_text(F.col("size"), 10, 1, 51))
    g = df.select("rid", parse_range(value, 1, 50).alias("r"))
    return _summary(df, g, D.numeric_covered(F.col("q_size"), F.col("c_r.lo"), F.col("c_r.hi"), SIZE_WIDTH), ["size"], ["r"])


def distance_numeric_ranges(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d).select("rid", parse_range(interval_text(F.col("size"), 10, 1, 51), 1, 50).alias("r"))
    return _summary(df, df, D.numeric_ranges(F.col("q_r.lo"), F.col("q_r.hi"), F.col("c_r.lo"), F.col("c_r.hi"), SIZE_WIDTH), ["r"])


def distance_categorical_edge(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return _summary(df, df, brand_distance(), ["brand", "grp"])


def distance_categorical_generalized(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    node = df.select("rid", F.when(F.col("rid") % 3 == 0, "*").when(F.col("rid") % 3 == 1, F.col("grp")).otherwise(F.col("brand")).alias("node"))
    return _summary(df, node, D.edge_covered([F.col("q_brand"), F.col("q_grp"), F.lit("*")], F.col("c_node")), ["brand", "grp"], ["node"])


def distance_nodes(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return _summary(df, df, D.nodes(F.col("q_grp"), F.col("c_grp"), 3), ["grp"])


def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distances between types from a given table: the difference of their places in the alphabet over 5."""
    df = parts(spark, d)
    codes = P.value_codes(df, "type")
    a, b = codes.toDF("a", "i"), codes.toDF("b", "j")
    matrix = a.join(b, F.col("i") < F.col("j")).select("a", "b", ((F.col("j") - F.col("i")) / 5).alias("d"))
    types = _combos(df, ["type"])
    p = D.with_matrix(knn.pairs(types.drop("n"), types), matrix, "type")
    return _back(df, ["type"], p.groupBy("q_type").agg(_r(F.sum(F.col("matrix_distance") * F.col("c_n")), 6).alias("total")))


def attribute_kinds(spark: SparkSession, d: str) -> DataFrame:
    return P.attribute_kinds(parts(spark, d), ("size", "price"), ("brand", "type", "grp"))


def record_distance(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return _record_summary(df, df, all_metric(_price_width(df)))


def distance_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Holdout against a release with sizes in fives and every third brand as its group; prices in whole tens.

    All methods are chosen from the specification: ranges, edges, a matrix for types and plain numbers for prices.
    """
    df = parts(spark, d).withColumn("price", F.floor(F.col("price") / 10) * 10)
    codes = P.value_codes(df, "type")
    matrix = codes.toDF("a", "i").join(codes.toDF("b", "j"), F.col("i") < F.col("j")).select("a", "b", ((F.col("j") - F.col("i")) / 5).alias("d"))
    hierarchies = {"size": interval_hierarchy(spark, "size", 1, 50), "brand": _brands(df)}
    how = Distances(PARTS, domains(df, PARTS), hierarchies, {"type": matrix})
    query, cand = holdout(df), generalize(original(df), {"size": hierarchies["size"]}, {"size": 1})
    cand = cand.withColumn("brand", F.when(F.col("rid") % 3 == 0, F.col("grp")).otherwise(F.col("brand")))
    metric = how.metric(how.originals(query), how.originals(cand))
    return _record_summary(how.attach(query), how.attach(cand), metric)


def release_report(spark: SparkSession, d: str) -> DataFrame:
    """Two releases, the original itself and a moved one, measured for both targets and scopes; distances follow from the specification."""
    df = parts(spark, d)
    groups = {"brand": _brands(df)}
    judge = E.Judge({"o": original(df), "h": holdout(df)}, Distances(PARTS, domains(df, PARTS), groups))
    report = E.evaluate(spark, "parts", {"train": original(df), "moved": release(df)}, judge.metrics)
    failed = report.status.where("failed > 0").collect()
    if failed:
        raise RuntimeError("; ".join(r["error"] for r in failed))
    return report.results.withColumn("value", _r("value", 6))


QID = ["size", "brand", "grp", "type"]


def knn_top5_qid(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return knn.top_k(holdout(df), original(df), qid_metric(), 5).withColumn("dist", _r("dist", 6))


def knn_top5_all(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return knn.top_k(holdout(df), release(df), all_metric(_price_width(df)), 5).withColumn("dist", _r("dist", 6))


def knn_self_second(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest_other(holdout(parts(spark, d)), qid_metric()).withColumn("dist", _r("dist", 6))


def knn_self_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest other rows of the holdout."""
    h = holdout(parts(spark, d))
    return knn.top_k(h, h, qid_metric(), 3, exclude_self=True).withColumn("dist", _r("dist", 6))


def nn_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Least distances from the holdout to the release and back, from one grid."""
    df = parts(spark, d)
    there, back = knn.nearest_both_ways(holdout(df), release(df), qid_distance(), QID)
    tagged = [x.select(F.lit(n).alias("direction"), "query_id", _r("dist", 6).alias("dist")) for n, x in (("holdout", there), ("release", back))]
    return tagged[0].unionByName(tagged[1])


def nn_distance_summary(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    s = P.distance_summary(knn.nearest(original(df), release(df), qid_metric()))
    return s.select(*[_r(c, 6).alias(c) for c in s.columns])


def close_value_ratio(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    s = P.close_value_ratio(knn.nearest(holdout(df), release(df), qid_metric()))
    return s.select("threshold", _r("ratio", 6).alias("ratio"), _r("ratio_1090", 6).alias("ratio_1090"))


def similarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    o, p, m = original(parts(spark, d)), release(parts(spark, d)), qid_metric()
    return P.similarity_ratio(*side_by_side(lambda search: search(), (lambda: knn.nearest(o, p, m), lambda: knn.nearest_other(o, m)))).select(_r("similarity_ratio", 6).alias("similarity_ratio"))


def nn_accuracy(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    t, p = holdout(df), release(df)
    m = qid_metric()
    # the four searches are independent; each starts with small jobs
    work = (lambda: knn.nearest(t, p, m), lambda: knn.nearest_other(t, m), lambda: knn.nearest(p, t, m), lambda: knn.nearest_other(p, m))
    return P.adversarial_accuracy(*side_by_side(lambda search: search(), work)).select(_r("nn_accuracy", 6).alias("nn_accuracy"))


def nn_identity(spark: SparkSession, d: str) -> DataFrame:
    """The original released unchanged, against itself: distance 0, every close ratio 1."""
    o = original(parts(spark, d))
    nn = knn.nearest(o, o, qid_metric())
    return nn.agg(F.max("dist").alias("greatest"), F.avg((F.col("dist") < 0.1).cast("double")).alias("close"))


def _aia(spark: SparkSession, d: str, k: int) -> DataFrame:
    df = parts(spark, d)
    t, p = holdout(df), release(df)
    near = knn.top_k(t, p, qid_metric(), k)
    guess = P.neighbour_guess(near, p, "rid", "price", True)
    s1, s2 = (prep.sample_std(x, ["price"]).first()[0] for x in (original(df), p))
    scored = t.join(guess, t["rid"] == guess["query_id"])
    return scored.select("rid", "price", "guess", *[c.alias(n) for n, c in zip(("error", "overlap", "inside"), P.overlap_scores(F.col("price"), F.col("guess"), F.lit(s1), F.lit(s2)))])


def aia_nearest_1(spark: SparkSession, d: str) -> DataFrame:
    return _aia(spark, d, 1).agg(_r(F.avg("error"), 6).alias("match_error"), _r(F.avg("inside"), 6).alias("guess_in_range"))


def aia_nearest_5(spark: SparkSession, d: str) -> DataFrame:
    return _aia(spark, d, 5).agg(_r(F.avg("error"), 6).alias("match_error"), _r(F.avg("inside"), 6).alias("guess_in_range"))


def aia_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _aia(spark, d, 5).select("rid", _r("guess", 6).alias("guess"), _r("overlap", 6).alias("overlap"))


def aia_category(spark: SparkSession, d: str) -> DataFrame:
    """Guess the brand of the holdout from the five nearest released parts by size and type: the largest code."""
    df = parts(spark, d)
    codes = P.value_codes(df, "brand")
    t, p = (x.join(codes, x["brand"] == codes["value"]).drop("value") for x in (holdout(df), release(df)))
    dist = D.record({"size": D.numeric(*_c("size"), SIZE_WIDTH), "type": type_distance()})
    near = knn.top_k(t, p, dist, 5, keys=["size", "type"])
    guess = P.neighbour_guess(near, p, "rid", "code", False).join(codes.select(F.col("code").alias("guess"), F.col("value").alias("guessed")), "guess")
    groups = first_level(_brands(df))
    named = guess.join(groups.select(F.col("leaf").alias("guessed"), F.col("group").alias("guess_grp")), "guessed")
    scored = t.join(named, t["rid"] == named["query_id"]).join(groups.select("leaf", "group_size"), F.col("brand") == F.col("leaf"))
    error, _, inside = P.category_scores(F.col("brand"), F.col("guessed"), F.col("grp"), F.col("guess_grp"), F.col("group_size"))
    return scored.agg(_r(F.avg(error), 6).alias("match_error"), _r(F.avg(inside), 6).alias("guess_in_range"))


def entropy_weights(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    each = [prep.entropy_weights(df, c, c == "price").select(F.lit(c).alias("attribute"), _r("entropy", 6).alias("entropy"), _r("weight", 6).alias("weight")) for c in ("brand", "type", "price")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def numeric_domains(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d)
    return df.agg(F.min("size").alias("size_lo"), F.max("size").alias("size_hi"), F.min("price").alias("price_lo"), F.max("price").alias("price_hi"), _r(F.stddev_samp("price"), 6).alias("price_std"))


def value_codes(spark: SparkSession, d: str) -> DataFrame:
    return P.value_codes(parts(spark, d), "brand")


QUERIES = {
    f.__name__: f
    for f in (
        distance_numeric, distance_numeric_generalized, distance_numeric_ranges, distance_categorical_edge, distance_categorical_generalized, distance_nodes, distance_matrix, distance_dispatch, attribute_kinds, record_distance,
        knn_top5_qid, knn_top5_all, knn_self_second, knn_self_top3, nn_both_ways, nn_distance_summary, close_value_ratio, similarity_ratio, nn_accuracy, nn_identity,
        release_report, aia_nearest_1, aia_nearest_5, aia_range_overlap, aia_category, entropy_weights, numeric_domains, value_codes,
    )
}


def _summary_sql(expression: str, cand: str = "parts", with_: str = "") -> str:
    return f"""WITH {PARTS_SQL}{with_} SELECT q.rid, round(sum(d), 6) AS total, round(min(d), 6) AS least, round(max(d), 6) AS most
      FROM (SELECT q.rid, {expression} AS d FROM parts q, {cand} c) q GROUP BY 1"""


_BRAND = "CASE WHEN q.brand = c.brand THEN 0.0 WHEN q.grp = c.grp THEN 0.5 ELSE 1.0 END"
_TYPE = "CASE WHEN q.type = c.type THEN 0.0 ELSE 1.0 END"
_ALL = f"""sqrt((pow(abs(q.size - c.size) / 49.0, 2) + pow({_BRAND}, 2) + pow({_TYPE}, 2)
  + pow(abs(q.price - c.price) / (SELECT max(price) - min(price) FROM parts), 2)) / 4)"""


def _near_sql(q: str, c: str, other: bool = False) -> str:
    return f"(SELECT q.rid AS query_id, min({QID_SQL}) AS dist FROM {q} q, {c} c{' WHERE q.rid <> c.rid' if other else ''} GROUP BY 1)"


_S10 = "((c.size - 1) // 10) * 10 + 1"
_TOP = """SELECT query_id, CAST(rank AS BIGINT) AS rank, cand_id, round(dist, 6) AS dist FROM (
  SELECT q.rid AS query_id, c.rid AS cand_id, {d} AS dist, row_number() OVER (PARTITION BY q.rid ORDER BY {d}, c.rid) AS rank FROM {q} q, {c} c) WHERE rank <= {k}"""


def _aia_sql(k: int) -> str:
    return f"""WITH {PARTS_SQL}, near AS ({_TOP.format(d=QID_SQL, q="h", c="p", k=k)}),
  g AS (SELECT query_id, avg(p.price) AS guess FROM near JOIN p ON p.rid = cand_id GROUP BY 1),
  e AS (SELECT rid, price, guess, (SELECT stddev_samp(price) FROM o) AS s1, (SELECT stddev_samp(price) FROM p) AS s2 FROM h JOIN g ON rid = query_id),
  f AS (SELECT *, greatest(0, price - s1) AS a1, price + s1 AS b1, greatest(0, guess - s2) AS a2, guess + s2 AS b2 FROM e)"""


_SUMMARY = ("mean", "median", "min", "max", "mean_1090", "median_1090", "min_1090", "max_1090")


def _report_sql() -> str:
    near = lambda name, q, c, tag, where="": f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{s}' AS scope, {tag}, q.rid, min({e}) AS d FROM {q} q, {c} c{where} GROUP BY ALL" for s, e in (("qid", QID_SQL), ("all", f"round({_ALL}, 9)"))) + ")"
    inner = "FILTER (d BETWEEN lo AND hi)"
    return f"""WITH {PARTS_SQL}, x AS (SELECT 'o' AS t, * FROM o UNION ALL SELECT 'h', * FROM h), y AS (SELECT 'train' AS r, * FROM o UNION ALL SELECT 'moved', * FROM p),
  {near("tp", "x", "y", "t, r")}, {near("pt", "y", "x", "t, r")}, {near("tt", "x", "x", "q.t", " WHERE q.t = c.t AND q.rid <> c.rid")}, {near("pp", "y", "y", "q.r", " WHERE q.r = c.r AND q.rid <> c.rid")},
  b AS (SELECT scope, t, r, round(quantile_cont(d, 0.1), 9) AS lo, round(quantile_cont(d, 0.9), 9) AS hi FROM tp GROUP BY ALL),
  w AS (SELECT scope, t, r, avg(d) AS mean, quantile_cont(d, 0.5) AS median, min(d) AS min, max(d) AS max, avg(d) {inner} AS mean_1090, quantile_cont(d, 0.5) {inner} AS median_1090, min(d) {inner} AS min_1090, max(d) {inner} AS max_1090
    FROM tp JOIN b USING (scope, t, r) GROUP BY ALL),
  f AS (SELECT scope, t, r, 'nn_distance' AS metric, attribute, value FROM (UNPIVOT w ON {", ".join(_SUMMARY)} INTO NAME attribute VALUE value)
    UNION ALL SELECT scope, t, r, 'close_value_ratio', CAST(k AS VARCHAR), avg((d < k)::INT) FROM tp, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS k) GROUP BY ALL
    UNION ALL SELECT scope, t, r, 'close_value_ratio', CAST(k AS VARCHAR) || '_1090', avg((d < k)::INT) {inner} FROM tp JOIN b USING (scope, t, r), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS k) GROUP BY ALL
    UNION ALL SELECT scope, t, r, 'similarity_ratio', '', avg((tp.d < tt.d)::INT) FROM tp JOIN tt USING (scope, t, rid) GROUP BY ALL
    UNION ALL SELECT scope, t, r, 'nn_accuracy', '', (a.v + z.v) / 2 FROM (SELECT scope, t, r, avg((tp.d > tt.d)::INT) AS v FROM tp JOIN tt USING (scope, t, rid) GROUP BY ALL) a
      JOIN (SELECT scope, t, r, avg((pt.d > pp.d)::INT) AS v FROM pt JOIN pp USING (scope, r, rid) GROUP BY ALL) z USING (scope, t, r))
  SELECT 'parts' AS dataset, r AS release, scope, t AS target, metric, attribute, round(value, 6) AS value FROM f"""


SQL = {
    "release_report": _report_sql(),
    "distance_numeric": _summary_sql("abs(q.size - c.size) / 49.0"),
    "distance_numeric_generalized": _summary_sql(
        "CASE WHEN q.size BETWEEN lo AND hi THEN ((hi - lo + 1) * (hi - lo + 1) - 1) / (3 * (hi - lo + 1) * 49.0) ELSE 49.0 END",
        "(SELECT c.rid, CASE WHEN c.rid % 3 = 0 THEN 1 ELSE " + _S10 + " END AS lo, CASE WHEN c.rid % 3 = 0 THEN 50 ELSE " + _S10 + " + 9 END AS hi FROM parts c)",
    ),
    "distance_numeric_ranges": _summary_sql("CASE WHEN (q.size - 1) // 10 = (c.size - 1) // 10 THEN 0.0 ELSE 49.0 END"),
    "distance_categorical_edge": _summary_sql(_BRAND),
    "distance_categorical_generalized": _summary_sql(
        "CASE WHEN node = q.brand THEN 0.0 WHEN node = q.grp THEN 0.25 WHEN node = '*' THEN 0.5 ELSE 4.0 END",
        "(SELECT rid, CASE rid % 3 WHEN 0 THEN '*' WHEN 1 THEN grp ELSE brand END AS node FROM parts)",
    ),
    "distance_nodes": _summary_sql("CASE WHEN q.grp = c.grp THEN 0.0 ELSE 4.0 END"),
    "distance_matrix": f"""WITH {PARTS_SQL}, c AS (SELECT type, row_number() OVER (ORDER BY type) AS i FROM (SELECT DISTINCT type FROM parts)),
      x AS (SELECT rid, i FROM parts JOIN c USING (type)) SELECT q.rid, round(sum(abs(q.i - y.i) / 5), 6) AS total FROM x q, x y GROUP BY 1""",
    "attribute_kinds": f"""WITH {PARTS_SQL} SELECT 'size' AS attribute, 'number' AS kind UNION ALL SELECT 'price', 'number' UNION ALL
      SELECT 'brand', CASE WHEN count(DISTINCT brand) > 200 THEN 'other' ELSE 'category' END FROM parts UNION ALL
      SELECT 'type', CASE WHEN count(DISTINCT type) > 200 THEN 'other' ELSE 'category' END FROM parts UNION ALL SELECT 'grp', CASE WHEN count(DISTINCT grp) > 200 THEN 'other' ELSE 'category' END FROM parts""",
    "record_distance": _summary_sql(_ALL),
    "distance_dispatch": f"""WITH {PARTS_SQL}, t AS (SELECT type, row_number() OVER (ORDER BY type) AS i FROM (SELECT DISTINCT type FROM parts)),
      w AS (SELECT max(floor(price / 10) * 10) - min(floor(price / 10) * 10) AS width FROM parts),
      hq AS (SELECT rid, size, brand, grp, i, floor(price / 10) * 10 AS price FROM h JOIN t USING (type)),
      oc AS (SELECT (size - 1) // 5 AS five, CASE WHEN rid % 3 = 0 THEN grp ELSE brand END AS node, i, floor(price / 10) * 10 AS price FROM o JOIN t USING (type)),
      x AS (SELECT rid, sqrt((pow(CASE WHEN (size - 1) // 5 = five THEN 24 / (15 * 49.0) ELSE 49 END, 2) + pow(CASE node WHEN brand THEN 0 WHEN grp THEN 0.25 ELSE 4 END, 2)
        + pow(abs(hq.i - oc.i) / 5, 2) + pow(abs(hq.price - oc.price) / width, 2)) / 4) AS d FROM hq, oc, w)
      SELECT rid, round(sum(d), 6) AS total, round(min(d), 6) AS least, round(max(d), 6) AS most FROM x GROUP BY 1""",
    "knn_top5_qid": f"WITH {PARTS_SQL} {_TOP.format(d=QID_SQL, q='h', c='o', k=5)}",
    "knn_top5_all": f"WITH {PARTS_SQL} {_TOP.format(d=f'round({_ALL}, 9)', q='h', c='p', k=5)}",
    "knn_self_second": f"WITH {PARTS_SQL} SELECT query_id, round(dist, 6) AS dist FROM {_near_sql('h', 'h', True)}",
    "nn_distance_summary": f"""WITH {PARTS_SQL}, nn AS MATERIALIZED {_near_sql("o", "p")}, b AS (SELECT round(quantile_cont(dist, 0.1), 9) AS p10, round(quantile_cont(dist, 0.9), 9) AS p90 FROM nn),
      t AS (SELECT dist, CASE WHEN dist BETWEEN p10 AND p90 THEN dist END AS i FROM nn, b)
      SELECT round(avg(dist), 6) AS mean, round(quantile_cont(dist, 0.5), 6) AS median, round(min(dist), 6) AS min, round(max(dist), 6) AS max,
        round(avg(i), 6) AS mean_1090, round(quantile_cont(i, 0.5), 6) AS median_1090, round(min(i), 6) AS min_1090, round(max(i), 6) AS max_1090 FROM t""",
    "close_value_ratio": f"""WITH {PARTS_SQL}, nn AS MATERIALIZED {_near_sql("h", "p")}, b AS (SELECT round(quantile_cont(dist, 0.1), 9) AS p10, round(quantile_cont(dist, 0.9), 9) AS p90 FROM nn),
      t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS threshold)
      SELECT threshold, round(avg((dist < threshold)::INT), 6) AS ratio, round(avg((dist < threshold)::INT) FILTER (dist BETWEEN p10 AND p90), 6) AS ratio_1090 FROM nn, b, t GROUP BY 1""",
    "similarity_ratio": f"""WITH {PARTS_SQL}, a AS MATERIALIZED {_near_sql("o", "p")}, b AS MATERIALIZED {_near_sql("o", "o", True)}
      SELECT round(avg((a.dist < b.dist)::INT), 6) AS similarity_ratio FROM a JOIN b USING (query_id)""",
    "nn_accuracy": f"""WITH {PARTS_SQL}, tp AS MATERIALIZED {_near_sql("h", "p")}, tt AS MATERIALIZED {_near_sql("h", "h", True)}, pt AS MATERIALIZED {_near_sql("p", "h")}, pp AS MATERIALIZED {_near_sql("p", "p", True)}
      SELECT round(((SELECT avg((tp.dist > tt.dist)::INT) FROM tp JOIN tt USING (query_id)) + (SELECT avg((pt.dist > pp.dist)::INT) FROM pt JOIN pp USING (query_id))) / 2, 6) AS nn_accuracy""",
    "nn_identity": f"WITH {PARTS_SQL}, nn AS MATERIALIZED {_near_sql('o', 'o')} SELECT max(dist) AS greatest, avg((dist < 0.1)::INT) AS close FROM nn",
    "knn_self_top3": f"""WITH {PARTS_SQL} SELECT query_id, CAST(rank AS BIGINT) AS rank, cand_id, round(dist, 6) AS dist FROM (
  SELECT q.rid AS query_id, c.rid AS cand_id, {QID_SQL} AS dist, row_number() OVER (PARTITION BY q.rid ORDER BY {QID_SQL}, c.rid) AS rank FROM h q, h c WHERE q.rid <> c.rid) WHERE rank <= 3""",
    "nn_both_ways": f"""WITH {PARTS_SQL} SELECT 'holdout' AS direction, query_id, round(dist, 6) AS dist FROM {_near_sql('h', 'p')} UNION ALL
      SELECT 'release', query_id, round(dist, 6) FROM {_near_sql('p', 'h')}""",
    "aia_nearest_1": f"{_aia_sql(1)} SELECT round(avg(abs(price - guess)), 6) AS match_error, round(avg((guess BETWEEN a1 AND b1)::INT), 6) AS guess_in_range FROM f",
    "aia_nearest_5": f"{_aia_sql(5)} SELECT round(avg(abs(price - guess)), 6) AS match_error, round(avg((guess BETWEEN a1 AND b1)::INT), 6) AS guess_in_range FROM f",
    "aia_range_overlap": f"{_aia_sql(5)} SELECT rid, round(guess, 6) AS guess, round(greatest(0, least(b1, b2) - greatest(a1, a2)) / greatest(b1 - a1, b2 - a2), 6) AS overlap FROM f",
    "aia_category": f"""WITH {PARTS_SQL}, near AS ({_TOP.format(d=f"round(sqrt((pow(abs(q.size - c.size) / 49.0, 2) + pow({_TYPE}, 2)) / 2), 9)", q="h", c="p", k=5)}),
      g AS (SELECT query_id, max(p.brand) AS guess FROM near JOIN p ON p.rid = cand_id GROUP BY 1), grp AS (SELECT DISTINCT brand, grp FROM parts), n AS (SELECT grp, count(*) AS c FROM grp GROUP BY 1)
      SELECT round(avg((h.brand = guess)::INT), 6) AS match_error, round(avg(CASE WHEN h.grp = gg.grp THEN 1 / n.c ELSE 0 END), 6) AS guess_in_range
      FROM h JOIN g ON rid = query_id JOIN grp gg ON gg.brand = guess JOIN n ON n.grp = h.grp""",
    "entropy_weights": f"""WITH {PARTS_SQL}, v AS (SELECT 'brand' AS attribute, brand AS x, count(*) AS c FROM parts GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM parts GROUP BY 2
      UNION ALL SELECT 'price', CAST(round_even(price, 0) AS VARCHAR), count(*) FROM parts GROUP BY 2),
      s AS (SELECT attribute, c / sum(c) OVER (PARTITION BY attribute) AS p FROM v)
      SELECT attribute, round(-sum(p * ln(p + 1e-16)), 6) AS entropy, round(1 / -sum(p * ln(p + 1e-16)), 6) AS weight FROM s GROUP BY 1""",
    "numeric_domains": f"WITH {PARTS_SQL} SELECT min(size) AS size_lo, max(size) AS size_hi, min(price) AS price_lo, max(price) AS price_hi, round(stddev_samp(price), 6) AS price_std FROM parts",
    "value_codes": f"WITH {PARTS_SQL} SELECT brand AS value, CAST(row_number() OVER (ORDER BY brand) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT brand FROM parts)",
}
