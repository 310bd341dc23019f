"""Golden set and two prediction runs derived from the driver's TPC-H-style tables.

One golden example per order; two runs (``baseline``, ``candidate``) whose
predictions are deterministic perturbations of the expected record keyed on
``m = orderkey + seed``, so any SQL engine can rebuild the same rows.  One
example in ten is a ``sparse_description`` case with null/empty expectations.

The outputs have the engine's input schemas (``GOLDEN``, ``PREDICTIONS``), so
everything downstream runs the same code a real golden set would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.joins import join_small_side
from fieldmark.schemas import SPARSE_CATEGORY
from fieldmark.sources.tables import read_table

# Fixed values of the fixture: the two runs and their key offsets.
RUNS = [("baseline", 0), ("candidate", 5)]
# Closed domains of the fixture's enum-like fields (order priority, order status).
FIXTURE_DOMAINS = {
    "seniority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "work_mode": ["F", "O", "P"],
}


def empty_list():
    return F.array().cast("array<string>")


# TPC-H fixes nation at 25 rows and region at 5; the join helper still checks.
DIM_ROW_BOUND = 1000


def golden_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_golden``: k, id, category, seg, city and the expected fields e_*."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")

    # Distinct brands per order: partial aggregation runs before the shuffle and
    # a set holds at most the number of distinct brands.
    skills = (lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy("l_orderkey")
              .agg(F.array_sort(F.collect_set("p_brand")).alias("skills")))
    geo = join_small_side(nation, region, F.col("n_regionkey") == F.col("r_regionkey"),
                          max_rows=DIM_ROW_BOUND)
    cust = join_small_side(customer, geo, F.col("c_nationkey") == F.col("n_nationkey"),
                           max_rows=DIM_ROW_BOUND)
    base = (orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(skills, F.col("l_orderkey") == F.col("o_orderkey"), "left"))
    sparse = (F.col("o_orderkey") % 10) == 9
    return base.select(
        F.col("o_orderkey").alias("k"),
        F.concat(F.lit("ex_"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(sparse, F.lit(SPARSE_CATEGORY)).otherwise(F.col("c_mktsegment")).alias("category"),
        F.concat(F.col("c_mktsegment"), F.lit(" account")).alias("e_title"),
        F.col("c_mktsegment").alias("seg"),
        F.col("n_name").alias("city"),
        F.col("o_orderpriority").alias("e_seniority"),
        F.when(~sparse, F.col("o_orderstatus")).alias("e_work_mode"),
        F.when(~sparse, F.concat(F.col("n_name"), F.lit(", "), F.col("r_name"))).alias("e_location"),
        F.when(sparse, empty_list()).otherwise(F.coalesce(F.col("skills"), empty_list())).alias("e_skills"),
    )


def _mod(m: Column, n: int) -> Column:
    return (m % n) == 0


def predictions_flat(golden: DataFrame) -> DataFrame:
    """``fx_pred``: two runs of perturbed predictions, a_* fields per example.

    The run dimension is attached with ``explode`` of a two-element literal,
    a narrow per-row generator rather than a join."""
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(s).alias("seed")) for r, s in RUNS])
    g = golden.withColumn("_r", F.explode(runs)).select(
        "*", F.col("_r.run").alias("run"), (F.col("k") + F.col("_r.seed")).alias("m")).drop("_r")
    m = F.col("m")
    e_skills = F.col("e_skills")
    return g.select(
        "run",
        F.col("id").alias("example_id"),
        "m",
        F.when(_mod(m, 23), F.lit(None).cast("string"))
        .when(_mod(m, 29), F.lit("unknown"))
        .when(_mod(m, 7), F.concat(F.lit("account "), F.col("seg")))
        .when(_mod(m, 11), F.lit("GENERAL account"))
        .otherwise(F.lower("e_title")).alias("a_title"),
        F.when(_mod(m, 10), F.lit("5-LOW"))
        .when(_mod(m, 3), F.lower("e_seniority"))
        .when(_mod(m, 4), F.concat(F.lit(" "), F.col("e_seniority"), F.lit(" ")))
        .otherwise(F.col("e_seniority")).alias("a_seniority"),
        F.when(F.col("e_work_mode").isNull() & _mod(m, 5), F.lit("O"))
        .when(_mod(m, 17), F.lit(None).cast("string"))
        .otherwise(F.lower("e_work_mode")).alias("a_work_mode"),
        F.when(F.col("e_location").isNull() & _mod(m, 7), F.lit("Berlin"))
        .when(_mod(m, 19), F.lit(None).cast("string"))
        .when(F.col("e_location").isNull(), F.lit(None).cast("string"))
        .when(_mod(m, 3), F.col("city"))
        .when(_mod(m, 2), F.upper("e_location"))
        .otherwise(F.col("e_location")).alias("a_location"),
        F.when((F.size(e_skills) == 0) & _mod(m, 7), F.array(F.lit("Brand#0")))
        .when((F.size(e_skills) == 0) | _mod(m, 13), empty_list())
        .when(_mod(m, 4), F.slice(e_skills, F.lit(1), F.size(e_skills) - 1))
        .otherwise(e_skills).alias("a_skills"),
        (F.lit(800) + (m * 37) % 2400).cast("double").alias("latency_ms"),
        (F.lit(200) + (m * 13) % 300).cast("bigint").alias("total_tokens"),
    )


def to_golden(flat: DataFrame) -> DataFrame:
    """Flat fixture rows in the ``GOLDEN`` record layout."""
    return flat.select(
        "id",
        "category",
        F.create_map(
            F.lit("raw_title"), F.col("e_title"),
            F.lit("raw_description"),
            F.concat_ws(" ", F.lit("Account in"), F.col("city"), F.lit("segment"), F.col("seg")),
        ).alias("input"),
        F.struct(
            F.col("e_title").alias("title"),
            F.col("e_seniority").alias("seniority"),
            F.col("e_work_mode").alias("work_mode"),
            F.col("e_location").alias("location"),
            F.col("e_skills").alias("skills"),
        ).alias("expected"),
        F.lit(None).cast("string").alias("notes"),
    )


def to_predictions(flat: DataFrame) -> DataFrame:
    """Flat prediction rows in the ``PREDICTIONS`` record layout."""
    return flat.select(
        "run",
        "example_id",
        F.struct(
            F.col("a_title").alias("title"),
            F.col("a_seniority").alias("seniority"),
            F.col("a_work_mode").alias("work_mode"),
            F.col("a_location").alias("location"),
            F.col("a_skills").alias("skills"),
        ).alias("job_info"),
        "latency_ms",
        "total_tokens",
    )


def fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(golden, predictions) of the fixture in the engine's record layouts."""
    gflat = golden_flat(spark, sf_dir)
    return to_golden(gflat), to_predictions(predictions_flat(gflat))
