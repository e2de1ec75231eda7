"""The test tables in the roles of micro-data, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.hierarchy import Hierarchy, default_hierarchy, interval_hierarchy
from veilmark.sources.tables import table
from veilmark.spec import DatasetSpec

PEOPLE = DatasetSpec("people", ("nation", "segment", "band", "balance"), ("band", "balance"), ("nation", "segment", "band"), ("balance",), {"band": (1, 100)})
PARTS = DatasetSpec("parts", ("size", "brand", "type", "price"), ("size", "price"), ("size", "brand", "type"), ("price",), {"size": (1, 50)})

#: A level vector in the middle of the lattice.
VECTOR = {"nation": 1, "segment": 0, "band": 2}
K = 5
SIZE_WIDTH = 49.0


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation, region, segment and a band 1..100 of their balance."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    band = F.least(F.greatest(F.floor((F.col("c_acctbal") + 1000) / 110) + 1, F.lit(1)), F.lit(100)).cast("long")
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("c_custkey").alias("rid"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), band.alias("band"), F.col("c_acctbal").alias("balance"))


def people_hierarchies(spark: SparkSession, sf_dir: str) -> dict[str, Hierarchy]:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nation = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("l0"), F.col("r_name").alias("l1"), F.lit("*").alias("l2"))
    return {
        "nation": Hierarchy("nation", nation, 3),
        "segment": default_hierarchy(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")), "segment"),
        "band": interval_hierarchy(spark, "band", 1, 100),
    }


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as micro-data; ``grp`` is the brand's group of ten."""
    p = table(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return p.select(F.col("p_partkey").alias("rid"), F.col("p_size").cast("long").alias("size"), F.col("p_brand").alias("brand"), F.concat(F.lit("group "), F.floor(number / F.lit(10)).cast("string")).alias("grp"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"))


def original(df: DataFrame) -> DataFrame:
    return df.where("rid % 5 <> 0")


def holdout(df: DataFrame) -> DataFrame:
    return df.where("rid % 5 = 0")


def release(df: DataFrame) -> DataFrame:
    """A released version of the parts: sizes moved on by the key, prices by a small amount."""
    return original(df).withColumn("size", (F.col("size") + F.col("rid") % 3 - 1) % 50 + 1).withColumn("price", F.col("price") + F.col("rid") % 7)


def interval_sql(v: str, width: int, lo: int = 1, end: int = 101) -> str:
    start = f"((({v}) - {lo}) // {width}) * {width} + {lo}"
    return f"'[' || CAST({start} AS BIGINT) || ', ' || CAST(least({start} + {width}, {end}) AS BIGINT) || '['"


PEOPLE_SQL = """people AS (
  SELECT c_custkey AS rid, n_name AS nation, r_name AS region, c_mktsegment AS segment,
         CAST(least(greatest(floor((c_acctbal + 1000) / 110) + 1, 1), 100) AS BIGINT) AS band, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

GENERAL_SQL = f"""{PEOPLE_SQL},
general AS (SELECT rid, region AS nation, segment, {interval_sql("band", 10)} AS band, balance FROM people)"""

#: All ancestors of each person's quasi-identifiers.
_BAND = ", ".join(["CAST(band AS VARCHAR)", *[interval_sql("band", w) for w in (5, 10, 20, 40)], "'*'"])
LATTICE_SQL = f"""{PEOPLE_SQL},
wide AS (SELECT rid, [nation, region, '*'] AS a, [segment, '*'] AS b, [{_BAND}] AS c FROM people),
classes AS (
  SELECT i || '_' || j || '_' || k AS node, i, j, k, a[i + 1] AS nation, b[j + 1] AS segment, c[k + 1] AS band, count(*) AS n
  FROM wide, range(3) t1(i), range(2) t2(j), range(6) t3(k)
  GROUP BY 1, 2, 3, 4, 5, 6, 7)"""

PARTS_SQL = """parts AS (
  SELECT p_partkey AS rid, CAST(p_size AS BIGINT) AS size, p_brand AS brand,
         'group ' || CAST(floor(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) / 10) AS INT) AS grp, p_type AS type, p_retailprice AS price
  FROM part),
o AS (SELECT * FROM parts WHERE rid % 5 <> 0),
h AS (SELECT * FROM parts WHERE rid % 5 = 0),
p AS (SELECT rid, (size + rid % 3 - 1) % 50 + 1 AS size, brand, grp, type, price + rid % 7 AS price FROM o)"""

QID_SQL = """round(sqrt((pow(abs(q.size - c.size) / 49.0, 2)
  + pow(CASE WHEN q.brand = c.brand THEN 0 WHEN q.grp = c.grp THEN 0.5 ELSE 1 END, 2)
  + pow(CASE WHEN q.type = c.type THEN 0 ELSE 1 END, 2)) / 3), 9)"""
