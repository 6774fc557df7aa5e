"""Edge lists, node tables and GraphML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crowdtide.operators.scale import ordered_index
from crowdtide.sources.schemas import EDGE_FILE, EDGES


def _positions(lines: DataFrame) -> DataFrame:
    """Add the place of each line: file, start of its block in the file, line within the block."""
    return lines.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
    )


def read_edgelist(spark: SparkSession, path: str, schema: str = EDGE_FILE) -> DataFrame:
    """CSV with a header row to edges; a repeated pair keeps its last weight."""
    lines = spark.read.csv(path, schema=schema, header=True)
    return (
        _positions(lines)
        .groupBy("source", "target")
        .agg(F.max_by("weight", "_at").alias("weight"))
    )


def read_weighted_edgelist(spark: SparkSession, path: str, directed: bool = True) -> DataFrame:
    """Lines ``source target weight``; undirected reading folds both directions of a pair.

    A repeated pair keeps its last weight.
    """
    lines = _positions(spark.read.csv(path, schema=EDGES, sep=" ", comment="#"))
    if not directed:
        lines = lines.select(
            F.least("source", "target").alias("source"),
            F.greatest("source", "target").alias("target"),
            "weight",
            "_at",
        )
    return lines.groupBy("source", "target").agg(F.max_by("weight", "_at").alias("weight"))


def write_edgelist_csv(edges: DataFrame, path: str) -> None:
    """Edges as CSV files with an ``id`` column counted from 0 along (source, target)."""
    numbered = ordered_index(edges, ["source", "target"], "id")
    numbered.select("id", "source", "target", "weight").write.csv(path, header=True)


def write_weighted_edgelist(edges: DataFrame, path: str) -> None:
    edges.select("source", "target", "weight").write.csv(path, sep=" ")


def write_node_metadata_csv(nodes: DataFrame, path: str, index: str | None = None) -> None:
    """Node attributes as CSV; the column ``index`` becomes ``id`` and comes first."""
    if index is not None:
        others = [c for c in nodes.columns if c not in (index, "id")]
        nodes = nodes.select(F.col(index).alias("id"), *others)
    nodes.write.csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def _xml(value: Column) -> Column:
    text = value.cast("string")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


XML_TYPES = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}


def graphml_lines(nodes: DataFrame, edges: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Lines of a GraphML document as (part, line); part orders header, nodes, edges, footer."""
    spark = nodes.sparkSession
    node_types = dict(nodes.dtypes)
    keys = [
        f'  <key id="d{i}" for="node" attr.name="{c}" attr.type="{XML_TYPES.get(node_types[c], "string")}"/>'
        for i, c in enumerate(attributes)
    ]
    keys.append(f'  <key id="d{len(attributes)}" for="edge" attr.name="weight" attr.type="long"/>')
    header = [
        '<?xml version="1.0" encoding="utf-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        *keys,
        '  <graph edgedefault="directed">',
    ]
    fixed = spark.createDataFrame(
        [(0, "\n".join(header)), (3, "  </graph>\n</graphml>")], "part int, line string"
    )
    values = [
        F.when(
            F.col(c).isNotNull(),
            F.concat(F.lit(f'<data key="d{i}">'), _xml(F.col(c)), F.lit("</data>")),
        ).otherwise("")
        for i, c in enumerate(attributes)
    ]
    node_rows = nodes.select(
        F.lit(1).alias("part"),
        F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('">'), *values, F.lit("</node>")).alias("line"),
    )
    edge_rows = edges.select(
        F.lit(2).alias("part"),
        F.concat(
            F.lit('    <edge source="'), _xml(F.col("source")),
            F.lit('" target="'), _xml(F.col("target")),
            F.lit(f'"><data key="d{len(attributes)}">'), F.col("weight").cast("string"),
            F.lit("</data></edge>"),
        ).alias("line"),
    )
    return fixed.unionByName(node_rows).unionByName(edge_rows)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, attributes: Sequence[str] = ()) -> None:
    """GraphML as part files that make one document when joined in name order."""
    lines = graphml_lines(nodes, edges, attributes)
    lines.orderBy("part", "line").select("line").write.text(path)
