"""Queries about hierarchies, preparation and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.ranges import half_open_midpoint, midpoint, parse_range
from veilmark.operators import generalize as G
from veilmark.operators import hierarchy as H
from veilmark.operators import prep, search
from veilmark.sources.tables import table

from .frames import GENERAL_SQL, K, LATTICE_SQL, PEOPLE, PEOPLE_SQL, VECTOR, interval_sql, people, people_hierarchies

QID = list(PEOPLE.qid)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def hierarchy_interval(spark: SparkSession, d: str) -> DataFrame:
    h = H.interval_hierarchy(spark, "quantity", 1, 50)
    used = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").cast("string").alias("l0")).agg(F.count("*").alias("n"))
    return h.frame.join(used, "l0", "left").select(*h.levels, F.coalesce("n", F.lit(0)).alias("n"))


def hierarchy_redaction(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "customer").select(F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0").alias("zone"))
    return H.redaction_hierarchy(zones, "zone", 5).frame


def hierarchy_order(spark: SparkSession, d: str) -> DataFrame:
    h = H.order_hierarchy(table(spark, d, "orders"), "o_orderpriority", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "soon").otherwise("later"))
    return h.check().frame


def hierarchy_leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    found = [H.node_leaves(h).select(F.lit(a).alias("attribute"), "node", "level", "n_leaves") for a, h in people_hierarchies(spark, d).items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def hierarchy_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents of all nodes above the values that people have, and how many people lie below each."""
    rows, out = people(spark, d), None
    for a, h in people_hierarchies(spark, d).items():
        held = rows.groupBy(F.col(a).cast("string").alias("leaf")).agg(F.count("*").alias("n"))
        each = H.leaf_nodes(h).join(held, "leaf").groupBy("attribute", "level", "node").agg(F.sum("n").alias("people"))
        one = each.join(H.parents(h), ["level", "node"]).select("attribute", "level", "node", "parent", "people")
        out = one if out is None else out.unionByName(one)
    return out


def _mixed_quantity(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    from veilmark.functions.ranges import interval_text

    text = F.when(F.col("l_linenumber") % 4 == 0, q.cast("string")).when(F.col("l_linenumber") % 4 == 1, interval_text(q, 5, 1, 51)).when(F.col("l_linenumber") % 4 == 2, F.concat(F.floor(q / F.lit(10)).cast("string"), F.lit("*"))).otherwise("*")
    return table(spark, d, "lineitem").groupBy(text.alias("value")).agg(F.count("*").alias("n"))


def parse_generalized_range(spark: SparkSession, d: str) -> DataFrame:
    r = parse_range(F.col("value"), 1, 50)
    return _mixed_quantity(spark, d).select("value", "n", r["lo"].alias("lo"), r["hi"].alias("hi"))


def range_midpoint(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_quantity(spark, d).select("value", midpoint(F.col("value"), 1, 50).alias("middle"), half_open_midpoint(F.col("value"), 42).cast("long").alias("whole"))


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("rid"), F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"),
    )


def impute_mode_by_group(spark: SparkSession, d: str) -> DataFrame:
    return prep.impute_mode(_with_nulls(spark, d), ["nation"], "segment").select("rid", "nation", "segment")


def impute_mean_by_group(spark: SparkSession, d: str) -> DataFrame:
    return prep.impute_mean(_with_nulls(spark, d), ["nation"], "balance").select("rid", "nation", _r("balance", 2).alias("balance"))


def crosstab_normalized(spark: SparkSession, d: str) -> DataFrame:
    return prep.crosstab(_with_nulls(spark, d), ["nation"], "segment").select("nation", "segment", _r("share").alias("share"))


def round_to_tens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(prep.tens(F.col("p_size")).cast("long").alias("tens")).agg(F.count("*").alias("n"))


def split_holdout(spark: SparkSession, d: str) -> DataFrame:
    train, held = prep.split_holdout(table(spark, d, "customer"), "c_custkey", 0.8, 1)
    return train.select("c_custkey", F.lit("train").alias("part")).unionByName(held.select("c_custkey", F.lit("holdout").alias("part")))


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return prep.sample_rows(table(spark, d, "orders"), "o_orderkey", 500, 1).select("o_orderkey", "o_totalprice")


def integral_columns(spark: SparkSession, d: str) -> DataFrame:
    return prep.integral_columns(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


def sample_to_original_domain(spark: SparkSession, d: str) -> DataFrame:
    h = people_hierarchies(spark, d)
    return G.sample_to_original(G.generalize(people(spark, d), h, VECTOR), h, ["nation", "band"], "rid", 3).select("rid", *QID)


def generalize_vector(spark: SparkSession, d: str) -> DataFrame:
    return G.generalize(people(spark, d), people_hierarchies(spark, d), VECTOR).select("rid", *QID)


def k_anonymity_suppress(spark: SparkSession, d: str) -> DataFrame:
    return G.suppress(generalize_vector(spark, d), QID, K).select("rid", *QID, "suppressed")


def _classes(spark: SparkSession, d: str, vectors=None, h=None) -> DataFrame:
    h = h or people_hierarchies(spark, d)
    return G.lattice_classes(G.distinct_combinations(people(spark, d), QID), h, QID, vectors)


def k_anonymity_stats(spark: SparkSession, d: str) -> DataFrame:
    return lattice_rows(G.lattice_statistics(_classes(spark, d, [VECTOR]), K))


def lattice_rows(stats: DataFrame) -> DataFrame:
    return stats.select("node", "n_rows", "n_suppressed", "n_classes", "min_class", "max_class", _r("avg_class").alias("avg_class"), "discernibility")


def lattice_sweep(spark: SparkSession, d: str) -> DataFrame:
    return lattice_rows(G.lattice_statistics(_classes(spark, d), K))


def granularity_loss(spark: SparkSession, d: str) -> DataFrame:
    h = people_hierarchies(spark, d)
    return G.information_loss(_classes(spark, d, h=h), h, QID, K).select("node", _r("loss").alias("loss"))


def lattice_optimum(spark: SparkSession, d: str) -> DataFrame:
    return granularity_loss(spark, d).orderBy("loss", "node").limit(1)


def lattice_search(spark: SparkSession, d: str) -> DataFrame:
    """The optimum again, by bounds instead of a sweep."""
    found = search.best_node(people(spark, d), people_hierarchies(spark, d), QID, K)
    return spark.createDataFrame([("_".join(str(found.vector[a]) for a in QID), round(found.loss, 6))], "node string, loss double")


def lattice_selected(spark: SparkSession, d: str) -> DataFrame:
    """Nodes worth publishing: not wholly suppressed, and the first that is."""
    return G.chosen_nodes(lattice_sweep(spark, d)).select("node", "n_suppressed")


def lattice_profile(spark: SparkSession, d: str) -> DataFrame:
    """The full row of statistics of every node, with its levels."""
    p = G.node_profile(people(spark, d), people_hierarchies(spark, d), QID, K, {"band": midpoint(F.col("node"), 1, 100)})
    exact = ["node", "k", "n_rows", "n_suppressed", "n_classes", "min_class", "max_class", "discernibility", "total_level", *[f"level_{a}" for a in QID]]
    return p.select(*exact, *[_r(c, 4).alias(c) for c in ("avg_class", "precision", "loss", "ambiguity", "entropy", "squared_error")])


def granularity_loss_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Suppression counts half, as with a balance of a quarter."""
    h = people_hierarchies(spark, d)
    return G.information_loss(_classes(spark, d, h=h), h, QID, K, 0.25).select("node", _r("loss").alias("loss"))


def split_exact(spark: SparkSession, d: str) -> DataFrame:
    train, held = prep.split_exact(table(spark, d, "customer"), "c_custkey", 0.8, 1)
    return train.select("c_custkey", F.lit("train").alias("part")).unionByName(held.select("c_custkey", F.lit("holdout").alias("part")))


def class_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d, [VECTOR]).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("classes"))


def discernibility(spark: SparkSession, d: str) -> DataFrame:
    return lattice_sweep(spark, d).select("node", "discernibility")


def precision(spark: SparkSession, d: str) -> DataFrame:
    """Sweeney's precision of every node's release, with its suppressed rows."""
    h = people_hierarchies(spark, d)
    return G.table_precision(_classes(spark, d, h=h), h, QID, K).select("node", _r("precision").alias("precision"))


def nonuniform_entropy(spark: SparkSession, d: str) -> DataFrame:
    return G.nonuniform_entropy(people(spark, d), people_hierarchies(spark, d), VECTOR).select("attribute", _r("entropy", 4).alias("entropy"))


def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    h = people_hierarchies(spark, d)
    return G.ambiguity(_classes(spark, d, h=h), h, QID).select("node", _r("ambiguity").alias("ambiguity"))


def record_squared_error(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of the band's midpoint, by nation of the release."""
    g = G.generalize(people(spark, d).withColumn("truth", F.col("band")), people_hierarchies(spark, d), VECTOR)
    e = F.col("truth") - midpoint(F.col("band"), 1, 100)
    return g.groupBy("nation").agg(_r(F.avg(e * e)).alias("squared_error"))


def record_level_error(spark: SparkSession, d: str) -> DataFrame:
    """Squared error by record of every node's release: bands by their middles, other attributes by levels."""
    found = G.record_error(people(spark, d), people_hierarchies(spark, d), QID, K, {"band": midpoint(F.col("node"), 1, 100)}, {"band": 99.0})
    return found.select("node", _r("record_error").alias("record_error"))


def classification_metric(spark: SparkSession, d: str) -> DataFrame:
    h = people_hierarchies(spark, d)
    g = G.generalize(people(spark, d), h, VECTOR)
    two = G.classification_metric(g, QID, F.col("balance") > 5000).select(F.lit("binary").alias("target"), _r("cm").alias("cm"))
    three = F.when(F.col("balance") < 2000, 0).when(F.col("balance") < 8000, 1).otherwise(2)
    return two.unionByName(G.classification_metric(g, QID, three).select(F.lit("multiclass").alias("target"), _r("cm").alias("cm")))


def generalize_holdout(spark: SparkSession, d: str) -> DataFrame:
    h, rows = people_hierarchies(spark, d), people(spark, d)
    train = G.generalize(rows.where("rid % 5 <> 0 and nation <> 'NATION_3' and segment <> 'MACHINERY'"), h, VECTOR)
    return G.generalize_like(rows.where("rid % 5 = 0"), train, h, VECTOR, ["nation", "segment"]).select("rid", *QID)


def drop_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return k_anonymity_suppress(spark, d).where(" or ".join(f"{c} <> '*'" for c in QID)).groupBy("nation").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        hierarchy_interval, hierarchy_redaction, hierarchy_order, hierarchy_leaf_counts, hierarchy_parents, parse_generalized_range, range_midpoint,
        impute_mode_by_group, impute_mean_by_group, crosstab_normalized, round_to_tens, split_holdout, sample_rows, integral_columns, sample_to_original_domain,
        generalize_vector, k_anonymity_suppress, k_anonymity_stats, lattice_sweep, granularity_loss, lattice_optimum, lattice_search, lattice_selected, lattice_profile, granularity_loss_balanced, split_exact, class_size_histogram,
        discernibility, precision, nonuniform_entropy, ambiguity, record_squared_error, record_level_error, classification_metric, generalize_holdout, drop_suppressed,
    )
}

_Q_LEVELS = ", ".join(f"{interval_sql('v', w, 1, 51)} AS l{i}" for i, w in enumerate((5, 10, 20, 40), 1))
_MIXED = f"""mixed AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN {interval_sql("q", 5, 1, 51)}
  WHEN 2 THEN CAST(q // 10 AS VARCHAR) || '*' ELSE '*' END AS value, count(*) AS n
  FROM (SELECT l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1),
parsed AS (SELECT value, n,
  CASE WHEN value = '*' THEN 1.0 WHEN value LIKE '[%' THEN CAST(regexp_extract(value, '^.([0-9]+), ([0-9]+)', 1) AS DOUBLE) ELSE CAST(replace(value, '*', '0') AS DOUBLE) END AS lo,
  CASE WHEN value = '*' THEN 50.0 WHEN value LIKE '[%' THEN CAST(regexp_extract(value, '^.([0-9]+), ([0-9]+)', 2) AS DOUBLE) - 1 ELSE CAST(replace(value, '*', '9') AS DOUBLE) END AS hi
  FROM mixed)"""
_NULLS = """holes AS (SELECT c_custkey AS rid, c_nationkey AS nation, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer)"""
_SUPPRESS = f"""WITH {GENERAL_SQL},
sized AS (SELECT *, count(*) OVER (PARTITION BY nation, segment, band) < {K} AS suppressed FROM general)"""
_STATS = f"""SELECT node, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (n < {K}), 0) AS BIGINT) AS n_suppressed,
  count(*) FILTER (n >= {K}) AS n_classes, min(n) FILTER (n >= {K}) AS min_class, max(n) FILTER (n >= {K}) AS max_class,
  round(avg(n) FILTER (n >= {K}), 6) AS avg_class,
  CAST(coalesce(sum(n * n) FILTER (n >= {K}), 0) + coalesce(sum(n) FILTER (n < {K}), 0) * sum(n) AS BIGINT) AS discernibility
  FROM classes"""
_DRAW = "CAST('0x' || substr(md5(rid || '|{a}|3'), 1, 8) AS BIGINT)"
#: Leaves below a node of each level.
_LEAF = f"""leaf AS (
  SELECT c_mktsegment AS v, 1 AS one FROM customer GROUP BY 1),
bandleaf AS (SELECT CAST(v AS BIGINT) AS v FROM range(1, 101) t(v)),
bandnode AS (SELECT node, list(v ORDER BY CAST(v AS VARCHAR)) AS leaves FROM (SELECT v, {interval_sql("v", 10)} AS node FROM bandleaf) GROUP BY 1),
nationnode AS (SELECT r_name AS node, list(n_name ORDER BY n_name) AS leaves FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"""
_SIZES = """nsize AS (SELECT 0 AS i, n_name AS node, 1 AS c FROM nation UNION ALL SELECT 1, r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 2 UNION ALL SELECT 2, '*', count(*) FROM nation),
ssize AS (SELECT 0 AS j, c_mktsegment AS node, 1 AS c FROM customer GROUP BY 2 UNION ALL SELECT 1, '*', count(DISTINCT c_mktsegment) FROM customer),
bsize AS (SELECT k, node, count(*) AS c FROM (SELECT k, [CAST(v AS VARCHAR), {0}, '*'][k + 1] AS node FROM range(1, 101) t(v), range(6) s(k)) GROUP BY 1, 2),
sized AS (SELECT x.node, x.n, n.c AS cn, s.c AS cs, b.c AS cb, (SELECT max(c) FROM nsize) AS dn, (SELECT max(c) FROM ssize) AS ds
  FROM classes x JOIN nsize n ON n.i = x.i AND n.node = x.nation JOIN ssize s ON s.j = x.j AND s.node = x.segment JOIN bsize b ON b.k = x.k AND b.node = x.band)""".replace(
    "{0}", ", ".join(interval_sql("v", w) for w in (5, 10, 20, 40))
)
_LOSS = f"""SELECT node, round(sum(n * CASE WHEN n < {K} THEN 1 ELSE ((cn - 1) / greatest(dn - 1, 1) + (cs - 1) / greatest(ds - 1, 1) + (cb - 1) / 99) / 3 END) / sum(n), 6) AS loss
  FROM sized GROUP BY node"""

SQL = {
    "hierarchy_interval": f"""WITH used AS (SELECT CAST(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT CAST(v AS VARCHAR) AS l0, {_Q_LEVELS}, '*' AS l5, coalesce(n, 0) AS n FROM (SELECT v, n FROM range(1, 51) t(v) LEFT JOIN used USING (v))""",
    "hierarchy_redaction": """SELECT DISTINCT z AS l0, substr(z, 1, 4) || '*' AS l1, substr(z, 1, 3) || '**' AS l2, substr(z, 1, 2) || '***' AS l3, substr(z, 1, 1) || '****' AS l4, '*' AS l5
      FROM (SELECT lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS z FROM customer)""",
    "hierarchy_order": "SELECT DISTINCT o_orderpriority AS l0, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END AS l1, '*' AS l2 FROM orders",
    "hierarchy_leaf_counts": f"""WITH {LATTICE_SQL}, {_SIZES}
      SELECT 'nation' AS attribute, node, max(i)::INT AS level, arg_max(c, i) AS n_leaves FROM nsize GROUP BY 2
      UNION ALL SELECT 'segment', node, max(j)::INT, arg_max(c, j) FROM ssize GROUP BY 2
      UNION ALL SELECT 'band', node, max(k)::INT, arg_max(c, k) FROM bsize GROUP BY 2""",
    "hierarchy_parents": f"""WITH {PEOPLE_SQL}, b AS (SELECT unnest(['nation', 'segment', 'band']) AS attribute, unnest([[nation, region, '*'], [segment, '*'], [CAST(band AS VARCHAR), {", ".join(interval_sql("band", w) for w in (5, 10, 20, 40))}, '*']]) AS c FROM people)
      SELECT attribute, CAST(i AS INT) AS level, c[i + 1] AS node, c[i + 2] AS parent, count(*) AS people FROM b, range(5) s(i) WHERE i + 2 <= len(c) GROUP BY 1, 2, 3, 4""",
    "parse_generalized_range": f"WITH {_MIXED} SELECT value, n, lo, hi FROM parsed",
    "range_midpoint": f"""WITH {_MIXED} SELECT value, (lo + hi) / 2 AS middle,
      CASE WHEN value = '*' THEN 42 WHEN value LIKE '[%' THEN CAST(floor((lo + hi + 1) / 2) AS BIGINT) WHEN value NOT LIKE '%*' THEN CAST(lo AS BIGINT) END AS whole FROM parsed""",
    "impute_mode_by_group": f"""WITH {_NULLS}, best AS (SELECT nation, segment FROM (SELECT nation, segment, row_number() OVER (PARTITION BY nation ORDER BY count(*) DESC, segment) AS k
      FROM holes WHERE segment IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
      SELECT rid, holes.nation, coalesce(holes.segment, best.segment) AS segment FROM holes LEFT JOIN best USING (nation)""",
    "impute_mean_by_group": f"""WITH {_NULLS}, m AS (SELECT nation, round_even(avg(balance), 1) AS b FROM holes GROUP BY 1)
      SELECT rid, nation, round(coalesce(balance, b), 2) AS balance FROM holes LEFT JOIN m USING (nation)""",
    "crosstab_normalized": f"""WITH {_NULLS} SELECT nation, segment, round(count(*) / sum(count(*)) OVER (PARTITION BY nation), 6) AS share FROM holes WHERE segment IS NOT NULL GROUP BY 1, 2""",
    "round_to_tens": "SELECT CAST(round_even(p_size / 10.0, 0) * 10 AS BIGINT) AS tens, count(*) AS n FROM part GROUP BY 1",
    "split_holdout": "SELECT c_custkey, CASE WHEN CAST('0x' || substr(md5(c_custkey || '|1'), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'holdout' END AS part FROM customer",
    "sample_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CAST('0x' || substr(md5(o_orderkey || '|1'), 1, 8) AS BIGINT), o_orderkey LIMIT 500",
    "integral_columns": "SELECT bool_and(l_quantity % 1 = 0) AS l_quantity, bool_and(l_discount % 1 = 0) AS l_discount, bool_and(l_extendedprice % 1 = 0) AS l_extendedprice FROM lineitem",
    "sample_to_original_domain": f"""WITH {GENERAL_SQL}, {_LEAF}
      SELECT rid, nn.leaves[{_DRAW.format(a="nation")} % len(nn.leaves) + 1] AS nation, segment, CAST(bn.leaves[{_DRAW.format(a="band")} % len(bn.leaves) + 1] AS VARCHAR) AS band
      FROM general JOIN nationnode nn ON nn.node = nation JOIN bandnode bn ON bn.node = band""",
    "generalize_vector": f"WITH {GENERAL_SQL} SELECT rid, nation, segment, band FROM general",
    "k_anonymity_suppress": f"""{_SUPPRESS} SELECT rid, CASE WHEN suppressed THEN '*' ELSE nation END AS nation, CASE WHEN suppressed THEN '*' ELSE segment END AS segment,
      CASE WHEN suppressed THEN '*' ELSE band END AS band, suppressed FROM sized""",
    "k_anonymity_stats": f"WITH {LATTICE_SQL} {_STATS} WHERE node = '1_0_2' GROUP BY node",
    "lattice_sweep": f"WITH {LATTICE_SQL} {_STATS} GROUP BY node",
    "granularity_loss": f"WITH {LATTICE_SQL}, {_SIZES} {_LOSS}",
    "lattice_optimum": f"WITH {LATTICE_SQL}, {_SIZES} SELECT * FROM ({_LOSS}) ORDER BY loss, node LIMIT 1",
    "record_level_error": f"""WITH {LATTICE_SQL}, own AS (SELECT i || '_' || j || '_' || k AS node, i, j, k, w.band AS v, a[i + 1] AS nation, b[j + 1] AS segment, c[k + 1] AS band,
        CASE k WHEN 0 THEN w.band WHEN 5 THEN 50.5 ELSE (((w.band - 1) // (5 * (1 << (k - 1)))) * 5 * (1 << (k - 1)) + 1 + least(((w.band - 1) // (5 * (1 << (k - 1))) + 1) * 5 * (1 << (k - 1)), 100)) / 2 END AS middle
        FROM (SELECT wide.*, people.band FROM wide JOIN people USING (rid)) w, range(3) t1(i), range(2) t2(j), range(6) t3(k)),
      sized AS (SELECT *, count(*) OVER (PARTITION BY node, nation, segment, band) AS n FROM own)
      SELECT node, round(avg(CASE WHEN n < {K} THEN (1 + 1 + pow((v - 50.5) / 99, 2)) / 3 ELSE (pow(i / 2, 2) + pow(j / 1, 2) + pow((v - middle) / 99, 2)) / 3 END), 6) AS record_error FROM sized GROUP BY 1""",
    "lattice_search": f"WITH {LATTICE_SQL}, {_SIZES} SELECT node, round(loss, 6) AS loss FROM ({_LOSS}) ORDER BY loss, node LIMIT 1",
    "lattice_selected": f"WITH {LATTICE_SQL}, st AS ({_STATS} GROUP BY node) SELECT node, n_suppressed FROM st WHERE n_suppressed < n_rows OR node = (SELECT min(node) FROM st WHERE n_suppressed = n_rows)",
    "lattice_profile": f"""WITH {LATTICE_SQL}, {_SIZES}, st AS ({_STATS} GROUP BY node), lo AS ({_LOSS}), am AS (SELECT node, sum(n * cn * cs * cb) / sum(n) AS ambiguity FROM sized GROUP BY 1),
      bl AS (SELECT k, band, c[k + 1] AS node, count(*) AS n FROM (SELECT people.band, c FROM people JOIN wide USING (rid)), range(6) s(k) GROUP BY 1, 2, 3),
      ex AS (SELECT k, n, band, sum(n) OVER (PARTITION BY k, node) AS t,
        CASE WHEN node = '*' THEN 50.5 WHEN node LIKE '[%' THEN (CAST(regexp_extract(node, '^.([0-9]+), ([0-9]+)', 1) AS DOUBLE) + CAST(regexp_extract(node, '^.([0-9]+), ([0-9]+)', 2) AS DOUBLE) - 1) / 2 ELSE CAST(node AS DOUBLE) END AS mid FROM bl),
      eb AS (SELECT k, sum(-n * log2(n / t)) AS e, sum(n * pow(band - mid, 2)) / sum(n) AS q FROM ex GROUP BY 1),
      nl AS (SELECT i, a[1] AS leaf, a[i + 1] AS node, count(*) AS n FROM wide, range(3) s(i) GROUP BY 1, 2, 3), en AS (SELECT i, sum(-n * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY i, node) AS t FROM nl) GROUP BY 1),
      sl AS (SELECT j, b[1] AS leaf, b[j + 1] AS node, count(*) AS n FROM wide, range(2) s(j) GROUP BY 1, 2, 3), es AS (SELECT j, sum(-n * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY j, node) AS t FROM sl) GROUP BY 1),
      ids AS (SELECT DISTINCT node, i, j, k FROM classes)
      SELECT node, {K} AS k, n_rows, n_suppressed, n_classes, min_class, max_class, discernibility, CAST(i + j + k AS INT) AS total_level, CAST(i AS INT) AS level_nation, CAST(j AS INT) AS level_segment, CAST(k AS INT) AS level_band,
        round(avg_class, 4) AS avg_class, round(1 - (i / 2 + j / 1 + k / 5) / 3, 4) AS precision, round(loss, 4) AS loss, round(ambiguity, 4) AS ambiguity, round(en.e + es.e + eb.e, 4) AS entropy, round(eb.q, 4) AS squared_error
      FROM st JOIN lo USING (node) JOIN am USING (node) JOIN ids USING (node) JOIN en USING (i) JOIN es USING (j) JOIN eb USING (k)""",
    "granularity_loss_balanced": f"WITH {LATTICE_SQL}, {_SIZES} {_LOSS.replace('THEN 1 ELSE', 'THEN 0.5 ELSE')}",
    "split_exact": """SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY CAST('0x' || substr(md5(c_custkey || '|1'), 1, 8) AS BIGINT), c_custkey) <= round_even(0.8 * (SELECT count(*) FROM customer), 0) THEN 'train' ELSE 'holdout' END AS part FROM customer""",
    "class_size_histogram": f"WITH {LATTICE_SQL} SELECT n AS size, count(*) AS classes FROM classes WHERE node = '1_0_2' GROUP BY 1",
    "discernibility": f"WITH {LATTICE_SQL} SELECT node, discernibility FROM ({_STATS} GROUP BY node)",
    "precision": f"WITH {LATTICE_SQL} SELECT node, round(1 - sum(n * CASE WHEN n < {K} THEN 1 ELSE (i / 2 + j / 1 + k / 5) / 3 END) / sum(n), 6) AS precision FROM classes GROUP BY node",
    "nonuniform_entropy": f"""WITH {PEOPLE_SQL}, x AS (SELECT 'nation' AS attribute, nation AS leaf, region AS node FROM people UNION ALL SELECT 'segment', segment, segment FROM people
      UNION ALL SELECT 'band', CAST(band AS VARCHAR), {interval_sql("band", 10)} FROM people),
      y AS (SELECT attribute, node, leaf, count(*) AS c FROM x GROUP BY 1, 2, 3), z AS (SELECT *, sum(c) OVER (PARTITION BY attribute, node) AS t FROM y)
      SELECT attribute, round(sum(-c * log2(c / t)), 4) AS entropy FROM z GROUP BY 1""",
    "ambiguity": f"WITH {LATTICE_SQL}, {_SIZES} SELECT node, round(sum(n * cn * cs * cb) / sum(n), 6) AS ambiguity FROM sized GROUP BY 1",
    "record_squared_error": f"""WITH {PEOPLE_SQL} SELECT region AS nation, round(avg(pow(band - (((band - 1) // 10) * 10 + 1 + least(((band - 1) // 10) * 10 + 10, 100)) / 2, 2)), 6) AS squared_error FROM people GROUP BY 1""",
    "classification_metric": f"""WITH {GENERAL_SQL}, t AS (SELECT nation, segment, band, 'binary' AS target, CAST(balance > 5000 AS INT) AS y FROM general
      UNION ALL SELECT nation, segment, band, 'multiclass', CASE WHEN balance < 2000 THEN 0 WHEN balance < 8000 THEN 1 ELSE 2 END FROM general),
      c AS (SELECT target, nation, segment, band, y, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT target, sum(n) - max(n) AS wrong, sum(n) AS n FROM c GROUP BY target, nation, segment, band)
      SELECT target, round(sum(wrong) / sum(n), 6) AS cm FROM s GROUP BY 1""",
    "generalize_holdout": f"""WITH {GENERAL_SQL}, seen AS (SELECT DISTINCT region AS r FROM people WHERE rid % 5 <> 0 AND nation <> 'NATION_3' AND segment <> 'MACHINERY'),
      s2 AS (SELECT DISTINCT segment AS s FROM people WHERE rid % 5 <> 0 AND nation <> 'NATION_3' AND segment <> 'MACHINERY')
      SELECT rid, CASE WHEN nation IN (SELECT r FROM seen) THEN nation ELSE '*' END AS nation, CASE WHEN segment IN (SELECT s FROM s2) THEN segment ELSE '*' END AS segment, band
      FROM general WHERE rid % 5 = 0""",
    "drop_suppressed": f"{_SUPPRESS} SELECT nation, count(*) AS n FROM sized WHERE NOT suppressed GROUP BY 1",
}
