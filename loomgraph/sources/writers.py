"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text, for text formats."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema])


def write_lines(df: DataFrame, path: str, column: str = "sentence", order: list[str] | None = None) -> None:
    """One line of text per row, in order of the columns named."""
    (df.orderBy(*order) if order else df).select(column).write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV or TSV with a header and double quotes doubled inside; lists as JSON."""
    flat(df).write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"')


def _quoted(c: str):
    text = F.col(c).cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return F.concat(F.lit('"'), F.coalesce(text, F.lit("")), F.lit('"'))


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> list[str]:
    """A GEXF graph from nodes(id, label) and edges(a, b, weight), in parts: folders of lines under `path`, one element a line.

    The folders' files, put after each other in the order returned (and by name within each), are the graph's file; every
    folder is written by as many tasks as its table has partitions. The same order is in the folder `manifest`.
    """
    spark = nodes.sparkSession
    fixed = lambda line: spark.createDataFrame([(line,)], "line string")
    node = nodes.select(F.concat(F.lit("<node id="), _quoted("id"), F.lit(" label="), _quoted("label"), F.lit("/>")).alias("line"))
    edge = edges.select(F.concat(F.lit("<edge source="), _quoted("a"), F.lit(" target="), _quoted("b"), F.lit(" weight="), _quoted("weight"), F.lit("/>")).alias("line"))
    parts = {
        "0-head": fixed('<gexf version="1.3"><graph defaultedgetype="%s"><nodes>' % ("directed" if directed else "undirected")),
        "1-nodes": node,
        "2-between": fixed("</nodes><edges>"),
        "3-edges": edge,
        "4-foot": fixed("</edges></graph></gexf>"),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").text(f"{path}/{name}")
    spark.createDataFrame([(name,) for name in parts], "name string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return [f"{path}/{name}" for name in parts]


def report(df: DataFrame, value: str, label: str = "node", n: int = 50) -> list[str]:
    """`label;value` lines of the n rows with the greatest values, ties by label."""
    rows = df.select(F.col(label).cast("string").alias("label"), F.col(value).alias("value")).orderBy(F.desc("value"), "label").limit(n).collect()
    return [f"{r.label};{r.value}" for r in rows]
