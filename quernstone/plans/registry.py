"""Registration of queries with their SQL twins, and the tables and bindings that queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.vectors import dot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, ddl: str, *rows: tuple) -> DataFrame:
        """A small literal table."""
        return self.spark.createDataFrame(list(rows), ddl)

    # Bindings: what stands for the tables of an entity-resolution run.

    @property
    def cust(self) -> DataFrame:
        """Table A: customers with nulls, a constant and a sparse column."""
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("id"), F.col("c_name").alias("name"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"),
            F.when(k % 5 != 0, F.col("c_acctbal").cast("decimal(12,2)")).alias("balance"), F.lit("x").alias("constant"), F.when(k % 40 == 0, F.lit("rare")).alias("sparse"),
        )

    @property
    def supp(self) -> DataFrame:
        """Table B: suppliers."""
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.when(k % 3 != 0, F.col("s_acctbal").cast("decimal(12,2)")).alias("balance"))

    @property
    def parts(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("type"), F.col("p_size").alias("size"))

    def pairs(self) -> DataFrame:
        """(a, b, label, score): labelled pairs of vectors; the label says that their labels agree. A vector meets some twenty others, however many there are."""
        keys = max(97, self.embeddings.count() // 20)
        v = self.embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
        a = v.select(F.col("vec_id").alias("a"), F.col("v").alias("va"), F.col("label").alias("la"), (F.col("vec_id") * 7 % keys).alias("k"))
        b = v.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"), F.col("label").alias("lb"), (F.col("vec_id") % keys).alias("k"))
        met = a.join(b, "k").where("a < b")
        scored = met.select("a", "b", (F.col("la") == F.col("lb")).cast("int").alias("label"), dot(F.col("va"), F.col("vb")).alias("score"))
        return scored.withColumn("score", F.when(F.col("score") < 0, -F.round(-F.col("score"), 6)).otherwise(F.round("score", 6)))  # a zero keeps its sign

    def candidates(self) -> DataFrame:
        """(spec, nom, sim, label, confidence): pairs as a labelling run leaves them; -1 is not labelled."""
        p = self.pairs()
        label = F.when((F.col("a") + F.col("b")) % 5 == 0, -1).otherwise(F.col("label"))
        return p.select(F.col("a").alias("spec"), F.col("b").alias("nom"), F.col("score").alias("sim"), label.alias("label"), F.when(F.col("b") % 4 == 0, "medium").otherwise("high").alias("confidence"))

    @property
    def history(self) -> DataFrame:
        """(user, epoch, loss): a training history for each user, from events in order of time."""
        from pyspark.sql import Window as W

        e = self.events.select(F.col("user_id").alias("user"), "ts", "event_id", F.round("value", 4).alias("loss"))
        return e.select("user", F.row_number().over(W.partitionBy("user").orderBy("ts", "event_id")).alias("epoch"), "loss")


CUST = """cust AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, c_nationkey AS nation,
  CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal::DECIMAL(12,2) END AS balance, 'x' AS constant, CASE WHEN c_custkey % 40 = 0 THEN 'rare' END AS sparse FROM customer)"""
SUPP = """supp AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal::DECIMAL(12,2) END AS balance FROM supplier)"""
PARTS = """parts AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS type, p_size AS size FROM part)"""
PAIRS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
keyed AS MATERIALIZED (SELECT e.*, vec_id * 7 % m AS ka, vec_id % m AS kb FROM e, (SELECT greatest(97, count(*) // 20) AS m FROM e)),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, (x.label = y.label)::INT AS label, round(list_dot_product(x.v, y.v), 6) AS score
  FROM keyed x JOIN keyed y ON x.ka = y.kb AND x.vec_id < y.vec_id)"""
CANDIDATES = PAIRS + """,
cand AS (SELECT a AS spec, b AS nom, score AS sim, CASE WHEN (a + b) % 5 = 0 THEN -1 ELSE label END AS label, CASE WHEN b % 4 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM pairs)"""
HISTORY = """history AS (SELECT user_id AS user, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, round(value, 4) AS loss FROM events)"""


def cells_sql(table: str, columns: list[str], keep_blank: bool = False) -> str:
    """CTE cells (id, col, val) of a CTE."""
    parts = " UNION ALL ".join(f"SELECT id, '{c}' AS col, {c}::VARCHAR AS val FROM {table}" for c in columns)
    return f"cells AS ({parts})" if keep_blank else f"cells AS (SELECT * FROM ({parts}) WHERE val IS NOT NULL AND trim(val) <> '')"


CUST_COLUMNS = ["name", "segment", "nation", "balance", "constant", "sparse"]
CUST_CELLS = CUST + ", " + cells_sql("cust", CUST_COLUMNS)
CUST_ALL = CUST + ", " + cells_sql("cust", CUST_COLUMNS, True)


def u01_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def u32_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::UBIGINT::BIGINT)"


def order_sql(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def query(name: str, sql: str | None = None):
    """Registers f(tables) -> DataFrame under a name; sql gives the same rows in DuckDB."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register
