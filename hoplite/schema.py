"""Schemas of the graph tables. Ids are LongType: there are no unsigned types."""

from __future__ import annotations

from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("start_id", "start_label", "edge_label", "end_id", "end_label")])
NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("str_id", T.StringType())])
LABELS = T.StructType([T.StructField("label_id", T.LongType()), T.StructField("label", T.StringType())])
ENCODED = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
OFFSETS = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("edge_offset", T.LongType()), T.StructField("byte_offset", T.LongType())])
QUERY = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("length", T.IntegerType()), T.StructField("labels", T.ArrayType(T.StringType()))])

#: What a lookup gives for an unknown node, and the modulus of 32-bit ids (fixed values).
NO_NODE = 4294967295
U32 = 4294967296
