"""The command line on a small graph of two groups, from files to files."""

import functools
import json

import pytest

from graphloom import cli
from graphloom.sources import graph_files

N = 12


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    edges = [(a, b) for a in range(N) for b in range(a + 1, N) if (a < N // 2) == (b < N // 2)] + [(0, N - 1)]
    (folder / "edges").write_text("".join(f"n{a} n{b}\n" for a, b in edges))
    lists = {a: [b for x, b in edges if x == a] + [x for x, b in edges if b == a] for a in range(N)}
    (folder / "lists").write_text("".join(f"n{a} {' '.join(f'n{b}' for b in near)}\n" for a, near in lists.items()) + "alone\n")
    (folder / "labels").write_text("".join(f"n{a} {'left' if a < N // 2 else 'right'}\n" for a in range(N)))
    (folder / "features").write_text("".join(f"n{a} {int(a < N // 2)} {int(a >= N // 2)} {a % 3} 1\n" for a in range(N)))
    return folder


@pytest.fixture(autouse=True)
def short_ranking(monkeypatch):
    monkeypatch.setattr(cli.networks, "rank_labels", functools.partial(cli.networks.rank_labels, epochs=2))


def ran(spark, files, *more):
    options = cli.parsed(["--label-file", f"{files}/labels", *more])
    return cli.run(spark, options)


@pytest.mark.parametrize(
    "method, more",
    [("node2vec", ("--number-walks", "2", "--walk-length", "6", "--window-size", "2", "--p", "0.5")), ("grarep", ("--kstep", "2")), ("lap", ())],
)
def test_edge_list_to_vectors_and_scores(spark, files, method, more):
    out = f"{files}/{method}"
    found = ran(spark, files, "--method", method, "--graph-format", "edgelist", "--input", f"{files}/edges", "--output", out, "--representation-size", "4", *more)
    vectors = {r["id"]: r["vec"] for r in graph_files.read_vectors(spark, out).collect()}
    assert set(vectors) == {f"n{a}" for a in range(N)}
    assert {len(v) for v in vectors.values()} == {4}
    assert {"micro", "macro", "samples", "weighted", "seconds"} <= set(json.loads(json.dumps(found)))


def test_walks_reach_nodes_without_edges(spark, files):
    out = f"{files}/deep"
    options = cli.parsed(["--method", "deepWalk", "--input", f"{files}/lists", "--output", out, "--representation-size", "4", "--number-walks", "2", "--walk-length", "5", "--window-size", "2"])
    cli.run(spark, options)
    assert {r["id"] for r in graph_files.read_vectors(spark, out).collect()} == {f"n{a}" for a in range(N)} | {"alone"}


def test_features_train_a_convolution(spark, files):
    found = ran(spark, files, "--method", "gcn", "--graph-format", "edgelist", "--input", f"{files}/edges", "--feature-file", f"{files}/features", "--epochs", "2", "--hidden", "4")
    assert found["seconds"] > 0 and len(found) > 1


def test_wrong_options_are_refused():
    for wrong in (["--method", "hope", "--input", "x"], ["--method", "gcn", "--input", "x"], ["--method", "tadw", "--input", "x", "--output", "y"], ["--method", "none", "--input", "x", "--output", "y"]):
        with pytest.raises(SystemExit):
            cli.parsed(wrong)
