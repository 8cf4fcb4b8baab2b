"""Edge lists as comma-separated text.

Lines end at LF only; fields are split on every comma, with no quoting, trimming, comments or header, and a CR
stays part of its field. That is why Spark's CSV reader is not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.schema import EDGE


def fields(line: Column) -> Column:
    return F.split(line, ",", -1)


def accepted(line: Column) -> Column:
    """A line counts if it has four fields, the fourth of which may be empty only if another follows."""
    f = fields(line)
    return (F.size(f) > 4) | ((F.size(f) == 4) & (F.get(f, 3) != ""))


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """The five positional fields of accepted lines; a missing fifth is null, further ones are ignored."""
    kept = lines.where(accepted(F.col(line)))
    f = fields(F.col(line))
    others = [c for c in lines.columns if c != line]
    return kept.select(*others, *[F.get(f, i).alias(n) for i, n in enumerate(EDGE.names)])


def endpoints(lines: DataFrame, src_field: int = 0, dst_field: int = 3, line: str = "value") -> DataFrame:
    """``(src_str, dst_str)`` of accepted lines from two field positions."""
    f = fields(F.col(line))
    return lines.where(accepted(F.col(line))).select(F.get(f, src_field).alias("src_str"), F.get(f, dst_field).alias("dst_str"))


def read_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``value`` of each line. With ``header`` the first line of each file is left out, and no other like it.

    A file's first line is the row of the least number among those of its split at byte 0; one row per file meets the scan again.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    if not header:
        return lines
    numbered = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    firsts = numbered.where("_at = 0").groupBy("_file").agg(F.min("_row").alias("_row"))
    return numbered.join(firsts, ["_file", "_row"], "left_anti").select("value")


def read_edges(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return parsed(read_lines(spark, path, header))


def write_lines(edges: DataFrame, path: str) -> None:
    """Edges as such text; a value with a comma or line end can't be written."""
    bad = F.exists(F.array(*EDGE.names), lambda x: x.contains(",") | x.contains("\n"))
    line = F.when(bad, F.raise_error(F.lit("a value holds a comma or a line end"))).otherwise(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in EDGE.names]))
    edges.select(line.cast("string").alias("value")).write.option("lineSep", "\n").text(path)
