"""Text formats of graphs, labels, features and vectors: readers with strict schemas, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph, last_wins, neighbours, symmetrized


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, tok): the tokens of each line; line_no grows in the order of files and lines."""
    text = spark.read.text(path)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return text.select(order.alias("line_no"), F.split(F.trim("value"), r"\s+").alias("tok"), "value")


def _exactly(rows: DataFrame, n: int) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit(f"a line needs {n} tokens: "), F.col("value")))
    return rows.withColumn("tok", F.when(F.size("tok") == n, F.col("tok")).otherwise(wrong))


def read_edgelist(spark: SparkSession, path: str, weighted: bool = False, directed: bool = False) -> PropertyGraph:
    """``src dst [weight]`` lines.  Of repeated arcs the last line's weight counts, for undirected graphs over both directions."""
    rows = _exactly(lines(spark, path), 3 if weighted else 2)
    weight = F.col("tok")[2].cast("double") if weighted else F.lit(1.0)
    arcs = rows.select("line_no", F.col("tok")[0].alias("src"), F.col("tok")[1].alias("dst"), weight.alias("weight"))
    edges = last_wins(arcs) if directed else symmetrized(arcs, "line_no")
    return PropertyGraph.from_edges(edges)


def read_adjlist(spark: SparkSession, path: str, symmetric: bool = False) -> PropertyGraph:
    """``v n1 n2 ...`` lines: arcs from v with weight 1; a lone v is an isolated node."""
    rows = lines(spark, path).where("value rlike '\\\\S'")
    nodes = rows.select(F.explode("tok").alias("id")).distinct()
    arcs = rows.select(F.col("tok")[0].alias("src"), F.explode(F.expr("slice(tok, 2, greatest(size(tok) - 1, 0))")).alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    return PropertyGraph(nodes, symmetrized(arcs) if symmetric else arcs)


def read_node_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).where("value rlike '\\\\S'")
    return rows.select("line_no", F.col("tok")[0].alias("id"), F.expr("slice(tok, 2, greatest(size(tok) - 1, 0))").alias("labels"))


def read_node_features(spark: SparkSession, path: str) -> DataFrame:
    return read_node_labels(spark, path).select("line_no", "id", F.transform("labels", lambda x: x.cast("double")).alias("features"))


def read_node_status(spark: SparkSession, path: str) -> DataFrame:
    return _exactly(lines(spark, path), 2).select("line_no", F.col("tok")[0].alias("id"), F.col("tok")[1].alias("status"))


def read_edge_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path)
    return rows.select("line_no", F.col("tok")[0].alias("src"), F.col("tok")[1].alias("dst"), F.expr("slice(tok, 3, greatest(size(tok) - 2, 0))").alias("labels"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return _exactly(lines(spark, path), 1).select("line_no", F.col("tok")[0].cast("long").alias("idx"))


def read_edge_table(spark: SparkSession, path: str, sep: str = " ", header: bool = False) -> DataFrame:
    """Two id columns, as GeneA and GeneB."""
    return spark.read.csv(path, sep=sep, header=header, schema="GeneA string, GeneB string", ignoreLeadingWhiteSpace=True)


def parsed_vectors(rows: DataFrame) -> DataFrame:
    """(id, vec) from lines (line_no, tok) whose first is ``n d``; other widths or counts than it says are an error."""
    first = rows.agg(F.min("line_no").alias("line_no"))
    head = rows.join(F.broadcast(first), "line_no").select(F.col("tok")[0].cast("long").alias("n"), F.col("tok")[1].cast("int").alias("d"))
    body = rows.join(F.broadcast(first), "line_no", "left_anti")
    count = body.agg(F.count(F.lit(1)).alias("found"))
    bad = F.raise_error(F.lit("the vectors don't fit their header"))
    short = F.when((F.col("found") == 0) & (F.col("n") > 0), bad.cast("long")).otherwise(F.col("found"))  # a header alone has no row to check
    checked = body.join(F.broadcast(head.crossJoin(count).withColumn("found", short)), how="cross")
    return checked.select(
        F.when((F.size("tok") == F.col("d") + 1) & (F.col("found") == F.col("n")), F.col("tok")[0]).otherwise(bad).alias("id"),
        F.transform(F.expr("slice(tok, 2, greatest(size(tok) - 1, 0))"), lambda x: x.cast("double")).alias("vec"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parsed_vectors(lines(spark, path))


def vector_lines(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value): the header ``n d``, and lines ``id v1 ... vd``."""
    head = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).select(F.concat_ws(" ", "n", "d").alias("value"))
    return head, vectors.select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("vec", lambda x: x.cast("string"))).alias("value"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A folder of text parts: the header alone in the first, then the vectors, each of their partitions written by its own task."""
    head, body = vector_lines(vectors)
    head.unionByName(body).write.text(path)


def write_edgelist(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string"))).write.text(path)


def write_adjlist(edges: DataFrame, path: str) -> None:
    """A line for each source: its id and those of its neighbours in order."""
    near = neighbours(edges).select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("nbrs", lambda x: x.cast("string"))))
    near.write.text(path)


def write_projector(vectors: DataFrame, labels: DataFrame, folder: str) -> None:
    """Tab-separated vectors and, in the same order of ids, their labels."""
    ordered = vectors.join(labels, "id").orderBy("id")
    ordered.select(F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t")).write.text(f"{folder}/vectors")
    ordered.select(F.col("label").cast("string")).write.text(f"{folder}/labels")
