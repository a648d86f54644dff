"""``python -m graphloom``: read a graph, embed it, save the vectors, rank labels."""

from __future__ import annotations

import argparse
import ast
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import embed, networks
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.storage import stored
from graphloom.sources import graph_files

#: Options that take a number, with their types and defaults.
NUMBERS = {
    "number-walks": (int, 10), "walk-length": (int, 80), "workers": (int, 8), "representation-size": (int, 128), "window-size": (int, 10),
    "epochs": (int, 5), "p": (float, 1.0), "q": (float, 1.0), "negative-ratio": (int, 5), "clf-ratio": (float, 0.5), "order": (int, 3),
    "dropout": (float, 0.5), "weight-decay": (float, 5e-4), "hidden": (int, 16), "kstep": (int, 4), "lamb": (float, 0.2), "lr": (float, 0.01),
    "alpha": (float, 1e-6), "beta": (float, 5.0), "nu1": (float, 1e-5), "nu2": (float, 1e-4), "bs": (int, 200),
}


def parsed(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("graphloom", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    for name in ("input", "output", "label-file", "feature-file"):
        parser.add_argument(f"--{name}", default="", required=name == "input")
    for name, (kind, default) in NUMBERS.items():
        parser.add_argument(f"--{name}", type=kind, default=default)
    parser.add_argument("--method", choices=[*embed.METHODS, "gcn"], required=True)
    parser.add_argument("--graph-format", choices=["adjlist", "edgelist"], default="adjlist")
    parser.add_argument("--encoder-list", default="[1000, 128]", help="widths of SDNE's layers; the last is that of the vectors")
    for name in ("directed", "weighted", "no-auto-save"):
        parser.add_argument(f"--{name}", action="store_true", help="accepted; all methods save once, at the end" if name == "no-auto-save" else None)
    found = parser.parse_args(arguments)
    if found.method != "gcn" and not found.output:
        parser.error("--output is needed for every method but gcn")
    if found.method in ("gcn", "tadw") and not found.feature_file:
        parser.error(f"{found.method} needs --feature-file")
    if found.method == "gcn" and not found.label_file:
        parser.error("gcn needs --label-file")
    return found


def parameters(options: argparse.Namespace) -> dict:
    """What the chosen method takes of the options; workers and batch sizes are Spark's affair."""
    o, dim = options, {"dim": options.representation_size}
    skip = {"length": o.walk_length, "window": o.window_size}
    return {
        "deepWalk": dim | skip | {"walks": o.number_walks},
        "node2vec": dim | skip | {"walks": o.number_walks, "p": o.p, "q": o.q},
        "line": dim | {"order": o.order, "negatives": o.negative_ratio, "epochs": o.epochs},
        "grarep": dim | {"steps": o.kstep},
        "hope": dim,
        "lap": dim,
        "lle": dim,
        "gf": dim | {"epochs": o.epochs, "rate": o.lr, "decay": o.weight_decay},
        "sdne": {"layers": tuple(ast.literal_eval(o.encoder_list)), "alpha": o.alpha, "beta": o.beta, "nu1": o.nu1, "nu2": o.nu2, "epochs": o.epochs, "rate": o.lr},
        "tadw": dim | {"lamb": o.lamb},
    }.get(o.method, {})


def _named(vectors: DataFrame, book: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("idx"), "vec").join(book, "idx").select("id", "vec")


def run(spark: SparkSession, options: argparse.Namespace) -> dict:
    """Seconds of reading and training, and F1 scores or accuracies if there are labels."""
    began, o = time.time(), options
    if o.graph_format == "adjlist":
        graph = graph_files.read_adjlist(spark, o.input)
    else:
        graph = graph_files.read_edgelist(spark, o.input, o.weighted, o.directed)
    coded = graph.encoded()
    book = stored(coded.nodes.select("id", "idx"), "book")
    numbered = PropertyGraph.from_edges(stored(coded.edges, "edges"), book.select(F.col("idx").alias("id")))
    labels = stored(graph_files.read_node_labels(spark, o.label_file), "labels") if o.label_file else None
    more = parameters(o)
    if o.feature_file:
        features = graph_files.read_node_features(spark, o.feature_file).join(book, "id").select(F.col("idx").alias("id"), "features")
    if o.method == "gcn":
        named = labels.join(book, "id").select("line_no", F.col("idx").alias("id"), "labels")
        ys = stored(networks.label_indicator(named), "ys")
        marks = networks.split_nodes(ys, o.clf_ratio)
        found, history = networks.gcn(numbered.edges, features, marks, ys.agg(F.max("y")).first()[0] + 1, hidden=o.hidden, epochs=o.epochs, rate=o.lr, decay=o.weight_decay, dropout=o.dropout)
        if o.output:
            graph_files.write_vectors(_named(found.select("id", F.col("hidden").alias("vec")), book), o.output)
        return {"seconds": round(time.time() - began, 3)} | history[-1]
    if o.method == "tadw":
        more["features"] = features
    vectors = stored(_named(embed.embed(numbered, o.method, **more), book), "vectors")
    out = {"seconds": round(time.time() - began, 3)}
    graph_files.write_vectors(vectors, o.output)
    if labels is not None:
        out |= networks.rank_labels(vectors, labels, o.clf_ratio).first().asDict()
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    options = parsed(arguments)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    print(json.dumps(run(spark, options)))
