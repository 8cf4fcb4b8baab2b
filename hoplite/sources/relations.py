"""A labelled graph over relational tables: one edge per row and foreign key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.schema import EDGE

#: (edge label, table, start prefix, start key, start label, end prefix, end key, end label): fixed values of the example graph.
RELATIONS = (
    ("PLACED", "orders", "c", "o_custkey", "customer", "o", "o_orderkey", "order"),
    ("CONTAINS", "lineitem", "o", "l_orderkey", "order", "p", "l_partkey", "part"),
    ("SUPPLIED_BY", "lineitem", "p", "l_partkey", "part", "s", "l_suppkey", "supplier"),
    ("IN_NATION", "supplier", "s", "s_suppkey", "supplier", "n", "s_nationkey", "nation"),
    ("HAS_CUSTOMER", "customer", "n", "c_nationkey", "nation", "c", "c_custkey", "customer"),
    ("IN_REGION", "nation", "n", "n_nationkey", "nation", "r", "n_regionkey", "region"),
)


#: Line numbers of a relation start at a multiple of this; within it the start key is the number.
LINES_OF_RELATION = 10**12


def edges(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] | None = None, numbered: bool = False) -> DataFrame:
    """Edges of the six relations, or of those with the given edge labels; only the key columns are read. ``numbered`` adds ``line_no``."""
    parts = []
    for i, (label, name, sp, sk, sl, ep, ek, el) in enumerate(RELATIONS):
        if labels is None or label in labels:
            t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            parts.append(t.select(F.concat(F.lit(sp), F.col(sk).cast("string")).alias("start_id"), F.lit(sl).alias("start_label"), F.lit(label).alias("edge_label"), F.concat(F.lit(ep), F.col(ek).cast("string")).alias("end_id"), F.lit(el).alias("end_label"), *[(F.col(sk).cast("long") + i * LINES_OF_RELATION).alias("line_no")] * numbered))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], EDGE)


def edges_sql(labels: tuple[str, ...] | None = None) -> str:
    """The same edges as SQL, always numbered."""
    return " UNION ALL ".join(
        f"SELECT '{sp}' || {sk} AS start_id, '{sl}' AS start_label, '{label}' AS edge_label, '{ep}' || {ek} AS end_id, '{el}' AS end_label, CAST({sk} + {i * LINES_OF_RELATION} AS BIGINT) AS line_no FROM {name}"
        for i, (label, name, sp, sk, sl, ep, ek, el) in enumerate(RELATIONS)
        if labels is None or label in labels
    )
