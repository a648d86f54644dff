"""Queries on graphs derived from the test tables, each with its SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.operators import embed, evaluate, graph, matrix, networks, sampling, structure, text
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.storage import folder as storage_folder
from graphloom.plans.storage import stored
from graphloom.sources import graph_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_HELD: dict[tuple, DataFrame] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _once(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived graph, written once for each application and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _HELD:
        _HELD[key] = stored(make(), name)
    return _HELD[key]


def knn(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, sim: 5 nearest neighbours by cosine."""
    return _once(spark, folder, "knn", lambda: text.nearest_neighbours(_table(spark, folder, "embeddings"), 5).withColumnRenamed("weight", "sim"))


def near(spark: SparkSession, folder: str) -> DataFrame:
    """The same, both ways, weight 1."""
    return _once(spark, folder, "near", lambda: graph.symmetrized(knn(spark, folder).select("src", "dst", F.lit(1.0).alias("weight"))))


def trade(spark: SparkSession, folder: str) -> DataFrame:
    """Customer nation to supplier nation, weight the number of line items; the small tables are joined by Spark's own size check."""

    def make() -> DataFrame:
        t = lambda name: _table(spark, folder, name)
        items = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        items = items.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return items.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))

    return _once(spark, folder, "trade", make)


def coord(spark: SparkSession, folder: str) -> DataFrame:
    """u < v: suppliers that share an order, weight the number of orders they share."""

    def make() -> DataFrame:
        items = _table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("u")).distinct()
        pairs = items.join(items.withColumnRenamed("u", "v"), "l_orderkey").where("u < v")
        return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("weight"))

    return _once(spark, folder, "coord", make)


KNN = """sims as (select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as sim
         from embeddings a join embeddings b on a.vec_id <> b.vec_id),
  knn as (select src, dst, sim from (select *, row_number() over (partition by src order by sim desc, dst) as r from sims) where r <= 5)"""
NEAR = f"{KNN}, near as (select distinct src, dst, 1.0::double as w from (select src, dst from knn union all select dst, src from knn)), nodes as (select distinct src as id from near)"
TRADE = """trade as (select c_nationkey::bigint as src, s_nationkey::bigint as dst, count(*)::double as w from lineitem join orders on l_orderkey = o_orderkey
         join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"""
COORD = """items as (select distinct l_orderkey, l_suppkey as s from lineitem),
  coord as (select a.s as u, b.s as v, count(*)::double as weight from items a join items b on a.l_orderkey = b.l_orderkey and a.s < b.s group by all)"""
VEC = "vec as (select vec_id as id, unnest(range(len(embedding)))::int as k, unnest(cast(embedding as double[])) as x from embeddings)"


def _lcg(a: str, b: str, seed: int = 0) -> str:
    return f"((((((({a})::bigint * 1103515245 + {12345 + seed}) % 2147483648) + ({b})::bigint * 7919) % 2147483648) * 1103515245 + 12345) % 2147483648)"


def _draw(*parts: str) -> str:
    """``numeric.draw`` of these SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::varchar' for p in parts)})), 1, 13))::bigint)"


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: N.r6(F.col(c)) for c in columns})


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


# ---- structure ----


@query(f"with {KNN} select src, dst, round(sim, 6) + 0.0 as sim from knn")
def knn_graph(spark, folder):
    return _rounded(knn(spark, folder), "sim")


@query(f"with {TRADE} select src, dst, max(w) as weight from (select src, dst, w from trade union all select dst, src, w from trade) group by all")
def edges_symmetrized(spark, folder):
    return graph.symmetrized(trade(spark, folder))


@query("""with o as (select o_custkey as src, o_totalprice as w, o_orderkey as n, (o_orderkey % 97)::bigint as dst from orders)
    select src, dst, arg_max(w, n) as weight from o group by all""")
def edges_dedup_last_wins(spark, folder):
    rows = _table(spark, folder, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 97).alias("dst"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("line_no"))
    return graph.last_wins(rows)


@query(f"with {TRADE} select least(src, dst) as u, greatest(src, dst) as v, max(w) as weight from trade where src <> dst group by all")
def edges_canonical(spark, folder):
    return graph.canonical(trade(spark, folder))


@query("""with e as (select event_id as n, 'u' || user_id as src, event_type as dst from events),
    f as (select id, min(place) as place from (select src as id, n * 2 as place from e union all select dst, n * 2 + 1 from e) group by id)
    select id, row_number() over (order by place) - 1 as idx from f""")
def node_encoding(spark, folder):
    rows = _table(spark, folder, "events").select(F.col("event_id").alias("line_no"), F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"))
    return graph.first_appearance(rows)


@query(f"with {NEAR} select src as id, string_agg(dst::varchar, ' ' order by dst) as nbrs from near group by src")
def neighbour_lists(spark, folder):
    return graph.neighbours(near(spark, folder)).select("id", F.concat_ws(" ", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"))


@query(f"with {TRADE} select src as id, count(*) as degree, sum(w) as weighted from trade group by src")
def degree_weighted(spark, folder):
    return graph.degrees(trade(spark, folder))


@query(f"with {COORD}, d as (select u as id from coord union all select v from coord) select id, count(*) as degree from d group by id order by degree desc, id limit 10")
def degree_top_k(spark, folder):
    both = coord(spark, folder).select(F.explode(F.array("u", "v")).alias("id"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(10)


@query(f"""with {TRADE} select (select count(*) from (select src from trade union select dst from trade)) as nodes, count(*) as edges, count(*) filter (src = dst) as loops,
    (select count(*) = 0 from trade a where not exists (select 1 from trade b where b.src = a.dst and b.dst = a.src)) as is_undirected from trade""")
def graph_summary(spark, folder):
    return PropertyGraph.from_edges(trade(spark, folder)).summary()


@query(f"""with recursive {NEAR.replace("with ", "")}, strong as (select src, dst from near n where exists (select 1 from knn k where k.src = n.src and k.dst = n.dst and k.sim > 0.42) or exists (select 1 from knn k where k.src = n.dst and k.dst = n.src and k.sim > 0.42)),
    reach(id, c) as (select id, id from nodes union select s.dst, r.c from reach r join strong s on s.src = r.id)
    select id, min(c) as component from reach group by id""")
def connected_components(spark, folder):
    return structure.connected_components(_strong(spark, folder), _nodes(near(spark, folder)))


def _strong(spark, folder):
    strong = knn(spark, folder).where("sim > 0.42").select("src", "dst", F.lit(1.0).alias("weight"))
    return graph.symmetrized(strong)


@query(f"""with recursive {NEAR}, strong as (select src, dst from knn where sim > 0.42 union select dst, src from knn where sim > 0.42),
    reach(id, c) as (select distinct src, src from strong union select s.dst, r.c from reach r join strong s on s.src = r.id),
    part as (select id, min(c) as component from reach group by id), best as (select component from part group by component order by count(*) desc, component limit 1)
    select src, dst, 1.0::double as weight from strong where src in (select id from part where component in (from best))""")
def largest_component(spark, folder):
    return structure.largest_component(_strong(spark, folder))


# an edge is in the forest if no path of lesser edges, in the order of (weight, u, v), joins its ends
@query(f"""with recursive {KNN}, e as (select least(src, dst) as u, greatest(src, dst) as v, max(round(1.0 - sim, 6) + 0.0) as weight from knn group by all),
    arcs as (select u as a, v as b, * from e union all select v, u, * from e),
    reach(u, v, weight, node) as (select u, v, weight, u from e union select r.u, r.v, r.weight, a.b from reach r join arcs a on a.a = r.node where (a.weight, a.u, a.v) < (r.weight, r.u, r.v))
    select u, v, weight from e where not exists (select 1 from reach r where r.u = e.u and r.v = e.v and r.node = e.v)""")
def minimum_spanning_forest(spark, folder):
    costs = knn(spark, folder).select("src", "dst", N.r6(1.0 - F.col("sim")).alias("weight"))
    return structure.spanning_forest(costs)


@query(f"""with {NEAR}, t as (select sum(w) as m2 from near), p as (select a.label as part, sum(case when a.label = b.label then w else 0 end) as i, sum(w) as s
    from near join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst group by a.label) select round(sum(i / m2 - s * s / (m2 * m2)), 6) + 0.0 as q from p, t""")
def modularity(spark, folder):
    parts = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"))
    return _rounded(structure.modularity(near(spark, folder), parts), "q")


@query()
def louvain(spark, folder):
    return structure.louvain(near(spark, folder))


@query(f"with {COORD}, other as (select * from coord where (u + v) % 3 = 0) select u, v, weight from coord where (u + v) % 3 <> 0")
def edge_difference(spark, folder):
    edges = coord(spark, folder)
    return structure.without_edges(edges, edges.where("(u + v) % 3 = 0").select(F.col("v").alias("u"), F.col("u").alias("v"))).select("u", "v", "weight")


@query(f"with {COORD} select u, v, weight from coord order by {_draw('u', 'v', '7')}, u, v limit 500")
def edge_sample(spark, folder):
    return structure.sampled(coord(spark, folder), 500, 7)


@query()
def edge_split(spark, folder):
    edges = coord(spark, folder).select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight")
    return structure.train_test(edges, 0.8, 1)


# ---- matrices ----


@query(f"with {NEAR} select a.src as i, b.dst as j, sum(a.w * b.w) as v from near a join near b on a.dst = b.src group by all")
def two_hop_common_neighbours(spark, folder):
    a = matrix.matrix(near(spark, folder))
    return matrix.product(a, a)


@query(f"with {NEAR} select count(*) as triangles from near a join near b on a.dst = b.src join near c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.dst < b.dst")
def triangle_count(spark, folder):
    up = near(spark, folder).where("src < dst").select("src", "dst")
    wedge = up.join(up.select(F.col("src").alias("dst"), F.col("dst").alias("third")), "dst")
    closed = wedge.join(up.select("src", F.col("dst").alias("third")), ["src", "third"], "left_semi")
    return closed.agg(F.count(F.lit(1)).alias("triangles"))


@query(f"with {TRADE} select src as i, dst as j, round(w / sum(w) over (partition by dst), 6) + 0.0 as v from trade")
def transition_column_stochastic(spark, folder):
    return _rounded(matrix.column_stochastic(matrix.matrix(trade(spark, folder))), "v")


@query(f"with {TRADE} select src as i, dst as j, round(w / sum(w) over (partition by src), 6) + 0.0 as v from trade")
def transition_row_l1(spark, folder):
    return _rounded(matrix.row_l1(matrix.matrix(trade(spark, folder))), "v")


P1 = f"{NEAR}, p as (select src as i, dst as j, w / sum(w) over (partition by dst) as v from near)"
P2 = f"{P1}, p2 as (select a.i, b.j, sum(a.v * b.v) as v from p a join p b on a.j = b.i group by all)"
P3 = f"{P2}, p3 as (select a.i, b.j, sum(a.v * b.v) as v from p2 a join p b on a.j = b.i group by all)"


def _p(spark, folder):
    return matrix.column_stochastic(matrix.matrix(near(spark, folder)))


@query(f"with {P3} select i, j, round(v, 6) + 0.0 as v from p3")
def kstep_transition(spark, folder):
    return _rounded(matrix.power(_p(spark, folder), 3), "v")


def _log_sql(name: str, ctes: str) -> str:
    return f"""with {ctes}, l as (select i, j, ln(v / sum(v) over (partition by j) * (select count(*) from nodes)) as v from {name})
    select i, j, round(v, 6) + 0.0 as v from l where v > 1e-9"""


def _log(spark, folder, k):
    n = _nodes(near(spark, folder)).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(matrix.positive_log(matrix.power(_p(spark, folder), k), n).where("v > 1e-9"), "v")


@query(_log_sql("p", P1))
def grarep_log_k1(spark, folder):
    return _log(spark, folder, 1)


@query(_log_sql("p2", P2))
def grarep_log_k2(spark, folder):
    return _log(spark, folder, 2)


@query(_log_sql("p3", P3))
def grarep_log_k3(spark, folder):
    return _log(spark, folder, 3)


@query(f"with {P2} select i, j, round(sum(v) / 2, 6) + 0.0 as v from (select * from p union all select * from p2) group by i, j")
def tadw_target(spark, folder):
    return _rounded(matrix.tadw_target(_p(spark, folder)), "v")


@query(f"""with {NEAR}, d as (select src as id, sum(w) as d from near group by src)
    select i, j, round(v, 6) + 0.0 as v from (select id as i, id as j, 1.0::double as v from d union all select src, dst, -w / sqrt(a.d) / sqrt(b.d) from near join d a on a.id = src join d b on b.id = dst)""")
def laplacian_symmetric(spark, folder):
    a = near(spark, folder)
    return _rounded(matrix.laplacian(matrix.matrix(a), _nodes(a)), "v")


@query(f"""with {TRADE}, d as (select src as id, sum(w) as d from trade group by src)
    select dst as i, src as j, round(w / sqrt(a.d) / sqrt(b.d), 6) + 0.0 as v from trade join d a on a.id = src join d b on b.id = dst""")
def gcn_symmetric_norm(spark, folder):
    return _rounded(matrix.symmetric_normalised(matrix.matrix(trade(spark, folder))), "v")


HAT = f"""{NEAR}, looped as (select src, dst, w from near union all select id, id, 1.0 from nodes), d as (select src as id, sum(w) as d from looped group by src),
  hat as (select src as i, dst as j, w / sqrt(a.d) / sqrt(b.d) as v from looped join d a on a.id = src join d b on b.id = dst)"""


def _hat(spark, folder):
    a = near(spark, folder)
    return _once(spark, folder, "hat", lambda: matrix.renormalised(matrix.matrix(a), _nodes(a)))


@query(f"with {HAT} select i, j, round(v, 6) + 0.0 as v from hat")
def gcn_renormalised(spark, folder):
    return _rounded(_hat(spark, folder), "v")


@query(f"with {HAT}, {VEC} select i as id, k, round(sum(v * x), 6) + 0.0 as x from hat join vec on vec.id = j group by all")
def gcn_propagate_features(spark, folder):
    return _rounded(matrix.times_dense(_hat(spark, folder), _vectors(spark, folder)), "x")


@query(f"""with {NEAR}, d as (select src as id, sum(w) as d from near group by src), l as (select src as i, dst as j, -w / sqrt(a.d) / sqrt(b.d) as v from near join d a on a.id = src join d b on b.id = dst),
    t2 as (select i, j, sum(v) as v from (select a.i, b.j, 2 * a.v * b.v as v from l a join l b on a.j = b.i union all select id, id, -1.0 from nodes) group by i, j)
    select i, j, round(v, 6) + 0.0 as v from t2""")
def chebyshev_t2(spark, folder):
    a = near(spark, folder)
    scaled = matrix.scaled_laplacian(matrix.matrix(a), _nodes(a), 2.0).where("abs(v) > 1e-12")
    return _rounded(matrix.chebyshev(scaled, _nodes(a), 2)[2], "v")


@query(f"""with {NEAR}, d as (select src as id, sum(w) as d from near group by src), l as (select src as i, dst as j, -w / sqrt(a.d) / sqrt(b.d) as v from near join d a on a.id = src join d b on b.id = dst),
    t2 as (select i, j, sum(v) as v from (select a.i, b.j, 2 * a.v * b.v as v from l a join l b on a.j = b.i union all select id, id, -1.0 from nodes) group by i, j),
    t3 as (select i, j, sum(v) as v from (select a.i, b.j, 2 * a.v * b.v as v from l a join t2 b on a.j = b.i union all select i, j, -v from l) group by i, j)
    select i, j, round(v, 6) + 0.0 as v from t3""")
def chebyshev_t3(spark, folder):
    a = near(spark, folder)
    scaled = matrix.scaled_laplacian(matrix.matrix(a), _nodes(a), 2.0).where("abs(v) > 1e-12")
    return _rounded(matrix.chebyshev(scaled, _nodes(a), 3)[3], "v")


@query(f"with {HAT}, {VEC}, once as (select i as id, k, sum(v * x) as x from hat join vec on vec.id = j group by all) select i as id, k, round(sum(v * x), 6) + 0.0 as x from hat join once on once.id = j group by all")
def gcn_two_hop_propagate(spark, folder):
    hat = _hat(spark, folder)
    return _rounded(matrix.times_dense(hat, matrix.times_dense(hat, _vectors(spark, folder))), "x")


REST = f"{NEAR}, rest as (select i, j, sum(v) as v from (select id as i, id as j, 1.0::double as v from nodes union all select src, dst, -w / sum(w) over (partition by src) from near) group by i, j)"


def _rest(spark, folder):
    a = near(spark, folder)
    return matrix.combined((1, matrix.identity(_nodes(a))), (-1, matrix.row_l1(matrix.matrix(a))))


@query(f"with {REST} select i, j, round(v, 6) + 0.0 as v from rest")
def lle_i_minus_p(spark, folder):
    return _rounded(_rest(spark, folder), "v")


@query(f"with {REST} select a.j as i, b.j as j, round(sum(a.v * b.v), 6) + 0.0 as v from rest a join rest b on a.i = b.i group by all")
def lle_gram(spark, folder):
    m = _rest(spark, folder)
    return _rounded(matrix.product(matrix.transposed(m), m), "v")


@query("select vec_id as id, round(x / list_sum(list_transform(e, lambda y: abs(y))), 6) + 0.0 as x, k from (select vec_id, cast(embedding as double[]) as e, unnest(range(len(embedding)))::int as k, unnest(list_transform(cast(embedding as double[]), lambda y: abs(y))) as x from embeddings)")
def features_row_normalised(spark, folder):
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), N.l1_normalised(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("f"))
    return _rounded(rows.select("id", F.posexplode("f").alias("k", "x")), "x")


@query("select vec_id as id, k, round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) + 0.0 as x from (select vec_id, cast(embedding as double[]) as e, unnest(range(len(embedding)))::int as k, unnest(cast(embedding as double[])) as x from embeddings)")
def features_l2_normalised(spark, folder):
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), N.l2_normalised(F.col("embedding")).alias("f"))
    return _rounded(rows.select("id", F.posexplode("f").alias("k", "x")), "x")


# ---- sampling ----


@query(f"""with {NEAR}, t as (select a.src as prev, a.dst as cur, b.dst as nxt, case when b.dst = a.src then b.w / 0.25 when exists (select 1 from near c where c.src = b.dst and c.dst = a.src) then b.w else b.w / 4 end as bias
    from near a join near b on a.dst = b.src) select prev, cur, nxt, round(bias / sum(bias) over (partition by prev, cur), 6) + 0.0 as prob from t""")
def node2vec_transitions(spark, folder):
    return _rounded(sampling.transitions(near(spark, folder), 0.25, 4.0), "prob")


@query(f"""with recursive {NEAR}, arcs as (select src, dst, row_number() over (partition by src order by dst) - 1 as pos, count(*) over (partition by src) as deg from near),
    w(start, step, node) as (select id, 0, id from nodes union all select w.start, w.step + 1, a.dst from w join arcs a on a.src = w.node and a.pos = {_draw('w.start', '0', 'w.step + 1', '0', '3', "'n'")} % a.deg where w.step < 5)
    select start, step, node from w""")
def uniform_walks(spark, folder):
    return sampling.uniform_walks(near(spark, folder), 6, 1, 3).select("start", "step", "node")


@query(f"""with recursive {NEAR}, arcs as (select src, dst, row_number() over (partition by src order by dst) - 1 as pos, count(*) over (partition by src) as deg from near),
    w(start, step, node) as (select id, 0, id from nodes union all select w.start, w.step + 1, a.dst from w join arcs a on a.src = w.node and a.pos = {_draw('w.start', '0', 'w.step + 1', '0', '3', "'n'")} % a.deg where w.step < 5)
    select a.node as center, b.node as context, count(*) as n from w a join w b on a.start = b.start and a.step <> b.step and abs(a.step - b.step) <= 2 group by all""")
def skipgram_pairs(spark, folder):
    walks = stored(uniform_walks(spark, folder), "walks")
    return sampling.skipgram_pairs(walks, ["start"], 2)


# draws of a start, step and try don't depend on where the walker is; 400 tries are enough for all to move, as the query tries until they have
@query(f"""with recursive {NEAR}, arcs as (select src, dst, row_number() over (partition by src order by dst) - 1 as pos, count(*) over (partition by src) as deg from near),
    draws as (select id as start, step, t as try, {_draw('id', '0', 'step', 't', '9', "'n'")} as d, {_draw('id', '0', 'step', 't', '9', "'a'")} / {float(1 << 52)} as u
      from nodes, (select unnest(range(1, 6)) as step), (select unnest(range(400)) as t)),
    w(start, step, prev, node) as (select id, 0, -1::bigint, id from nodes union all
      select w.start, w.step + 1, w.node, arg_min(a.dst, d.try) from w join draws d on d.start = w.start and d.step = w.step + 1 join arcs a on a.src = w.node and a.pos = d.d % a.deg
        left join near c on c.src = a.dst and c.dst = w.prev
        where w.step < 5 and d.u < case when w.step = 0 then 1.0 when a.dst = w.prev then 1.0 when c.src is not null then 0.25 else 0.0625 end group by w.start, w.step, w.node)
    select start, step, node from w""")
def biased_walks(spark, folder):
    return sampling.biased_walks(near(spark, folder), 6, 0.25, 4.0, 9).select("start", "step", "node")


@query(f"with {TRADE}, s as (select src as id, pow(sum(w), 0.75) as s from trade group by src) select id, round(s / sum(s) over (), 6) + 0.0 as prob from s")
def line_noise(spark, folder):
    return _rounded(sampling.noise(trade(spark, folder)), "prob")


@query(f"with {TRADE} select src, dst, round(w / sum(w) over (), 6) + 0.0 as prob from trade")
def line_edge_shares(spark, folder):
    return _rounded(sampling.edge_shares(trade(spark, folder)), "prob")


# ---- losses at fixed vectors ----

DOTS = f"""{NEAR}, dots as (select src, dst, w, list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) as d from near join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst)"""


def _dots(spark, folder):
    e = _table(spark, folder, "embeddings")
    a, b = e.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a")), e.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("b"))
    return near(spark, folder).join(a, "src").join(b, "dst").withColumn("d", N.dot(F.col("a"), F.col("b")))


@query(f"with {DOTS} select round(avg(ln(1 + exp(-d))), 6) + 0.0 as loss from dots")
def line_loss(spark, folder):
    return _rounded(_dots(spark, folder).agg((-F.avg(N.log_sigmoid(F.col("d")))).alias("loss")), "loss")


@query(f"with {DOTS} select round(sum((w - d) * (w - d)), 5) + 0.0 as loss from dots")
def factorisation_loss(spark, folder):
    return _dots(spark, folder).agg((F.round(F.sum((F.col("weight") - F.col("d")) ** 2), 5) + 0.0).alias("loss"))


@query(f"""with {NEAR}, e as (select src, dst, unnest(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])), lambda p: p[1] * p[2])) as x, unnest(range(len(a.embedding)))::int as k
    from near join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst where src < dst) select src, dst, k, round(x, 6) + 0.0 as x from e""")
def edge_features_hadamard(spark, folder):
    rows = _dots(spark, folder).where("src < dst").select("src", "dst", F.posexplode(N.hadamard(F.col("a"), F.col("b"))).alias("k", "x"))
    return _rounded(rows, "x")


@query(f"with {DOTS} select src, dst, round(1 / (1 + exp(-d)), 6) + 0.0 as score from dots where src < dst")
def edge_scores(spark, folder):
    return _rounded(_dots(spark, folder).where("src < dst").select("src", "dst", N.sigmoid(F.col("d")).alias("score")), "score")


@query(f"""with {NEAR} select round(sum(w * list_sum(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 5) + 0.0 as loss
    from near join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst""")
def sdne_first_order_loss(spark, folder):
    apart = F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))
    return _dots(spark, folder).agg((F.round(F.sum(F.col("weight") * N.dot(apart, apart)), 5) + 0.0).alias("loss"))


# ---- evaluation ----

LOGITS = "rows as (select label, list_slice(cast(embedding as double[]), 1, 10) as z from embeddings where vec_id % 2 = 0)"


def _logits(spark, folder):
    return _table(spark, folder, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("logits"), F.col("label").alias("y"), (F.col("vec_id") % 2 == 0).alias("mask"))


@query(f"with {LOGITS} select round(avg((list_position(z, list_max(z)) - 1 = label)::int), 6) + 0.0 as accuracy from rows")
def gcn_masked_accuracy(spark, folder):
    return _rounded(evaluate.masked_accuracy(_logits(spark, folder).withColumn("probs", N.softmax(F.col("logits")))), "accuracy")


@query(f"with {LOGITS} select round(avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1]), 6) + 0.0 as loss from rows")
def gcn_masked_cross_entropy(spark, folder):
    return _rounded(evaluate.masked_cross_entropy(_logits(spark, folder)), "loss")


@query()
def label_split(spark, folder):
    """Labels in the order of their documents, half of them for training by numpy's permutation."""
    rows = _table(spark, folder, "labels").select(F.col("doc_id").alias("line_no"), F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return evaluate.permutation_split(rows, 0.5).select("id", "label", "part")


SCORES = f"scores as (select round({_lcg('doc_id', '1', 5)} % 1000 / 1000.0 + quality * 0.2, 6)::double as score, quality as label from labels)"


def _scores(spark, folder):
    draw = (N.lcg(F.col("doc_id"), F.lit(1), 5) % 1000) / 1000.0
    return _table(spark, folder, "labels").select(F.round(draw + F.col("quality") * 0.2, 6).alias("score"), F.col("quality").alias("label"))


@query(f"""with {SCORES}, t as (select score, sum(label) as p, count(*) as n from scores group by score), r as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0 as mid from t)
    select round((sum(mid * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(n - p)), 6) + 0.0 as auc from r""")
def roc_auc(spark, folder):
    return _rounded(evaluate.roc_auc(_scores(spark, folder)), "auc")


@query(f"""with {SCORES}, t as (select score, sum(label) as p, count(*) as n from scores group by score), r as (select p, sum(p) over w / sum(n) over w as prec from t window w as (order by score desc rows between unbounded preceding and current row))
    select round(sum(prec * p) / sum(p), 6) + 0.0 as ap from r""")
def average_precision(spark, folder):
    return _rounded(evaluate.average_precision(_scores(spark, folder)), "ap")


RANK = f"""truth as (select vec_id as id, label from embeddings union select vec_id, (vec_id % 10)::int from embeddings),
  scored as (select e.vec_id as id, l.label, {_lcg('e.vec_id', 'l.label', 11)} as score from embeddings e, (select distinct label from embeddings) l),
  ranked as (select s.id, s.label from (select *, row_number() over (partition by id order by score desc, label) as r from scored) s join (select id, count(*) as k from truth group by id) c on c.id = s.id and r <= k)"""


def _ranking(spark, folder):
    e = _table(spark, folder, "embeddings")
    truth = e.select(F.col("vec_id").alias("id"), "label").union(e.select("vec_id", (F.col("vec_id") % 10).cast("int"))).distinct()
    scored = e.select(F.col("vec_id").alias("id")).crossJoin(F.broadcast(e.select("label").distinct())).withColumn("score", N.lcg(F.col("id"), F.col("label"), 11))
    return truth, evaluate.top_ranked(scored, truth)


@query(f"with {RANK} select id, label from ranked")
def top_k_ranker(spark, folder):
    return _ranking(spark, folder)[1]


@query(f"""with {RANK}, m as (select coalesce(t.id, p.id) as id, coalesce(t.label, p.label) as label, (t.id is not null and p.id is not null)::int as tp, (t.id is null)::int as fp, (p.id is null)::int as fn
      from truth t full join ranked p on t.id = p.id and t.label = p.label),
    l as (select label, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) as f, sum(tp) + sum(fn) as n from m group by label),
    s as (select id, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) as f from m group by id)
    select (select round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) + 0.0 from m)::double as micro, (select round(avg(f), 6) + 0.0 from l)::double as macro,
      (select round(avg(f), 6) + 0.0 from s)::double as samples, (select round(sum(f * n) / sum(n), 6) + 0.0 from l)::double as weighted""")
def f1_scores(spark, folder):
    return _rounded(evaluate.f1_scores(*_ranking(spark, folder)), "micro", "macro", "samples", "weighted")


@query("select label, row_number() over (order by label::varchar) - 1 as label_id from (select distinct label from embeddings)")
def label_index(spark, folder):
    return evaluate.label_index(_table(spark, folder, "embeddings")).select("label", F.col("label_id").cast("long").alias("label_id"))


HISTORY = f"history as (select i as epoch, round(1.0 / (i + 1) + {_lcg('i', '2', 1)} % 100 / 1000.0, 6)::double as val_loss, ({_lcg('i', '3', 1)} % 50)::double as macro from (select unnest(range(60)) as i))"


def _history(spark):
    i = spark.range(60).select(F.col("id").alias("epoch"))
    return i.select("epoch", F.round(1.0 / (F.col("epoch") + 1) + N.lcg(F.col("epoch"), F.lit(2), 1) % 100 / 1000.0, 6).alias("val_loss"), (N.lcg(F.col("epoch"), F.lit(3), 1) % 50).cast("double").alias("macro"))


@query(f"with {HISTORY}, m as (select *, avg(val_loss) over (order by epoch rows between 10 preceding and 1 preceding) as mean from history) select min(epoch) as epoch from m where epoch > 10 and val_loss > mean")
def early_stop_epoch(spark, folder):
    return evaluate.early_stop(_history(spark))


@query(f"with {HISTORY} select epoch from history order by macro desc, epoch limit 1")
def best_epoch(spark, folder):
    return evaluate.best_epoch(_history(spark))


# ---- text and files ----

TFIDF = r"""tok as (select doc_id, unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) as term from documents), tf as (select doc_id, term, count(*) as tf from tok where term <> '' group by all),
  df as (select term, count(*) as df from tf group by term), wt as (select doc_id, term, tf * (ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1.0) as w from tf join df using (term)),
  tfidf as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from wt)"""


@query(f"with {TFIDF} select doc_id, term, round(w, 6) + 0.0 as w from tfidf")
def tfidf(spark, folder):
    return _rounded(text.tfidf(_table(spark, folder, "documents")), "w")


@query("select vec_id::varchar as id, k, x from (select vec_id, unnest(range(len(embedding)))::int as k, unnest(list_transform(embedding, lambda y: round(y::double, 6) + 0.0)) as x from embeddings)")
def vectors_text_roundtrip(spark, folder):
    path = storage_folder(spark, "vectors")
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: N.r6(x.cast("double"))).alias("vec"))
    graph_files.write_vectors(rows, path)
    return graph_files.read_vectors(spark, path).select("id", F.posexplode("vec").alias("k", "x"))


@query(f"with {NEAR} select src::varchar as src, dst::varchar as dst, w as weight from near")
def adjlist_roundtrip(spark, folder):
    path = storage_folder(spark, "adjlist")
    graph_files.write_adjlist(near(spark, folder), path)
    return graph_files.read_adjlist(spark, path).edges


@query(f"with {TRADE} select src::varchar as src, dst::varchar as dst, w as weight from trade")
def edgelist_roundtrip(spark, folder):
    path = storage_folder(spark, "edgelist")
    graph_files.write_edgelist(trade(spark, folder), path)
    return graph_files.read_edgelist(spark, path, weighted=True, directed=True).edges


# ---- embeddings; not expressible in SQL ----


WEIGHTS = "(({k} * 7 + {h} * 3) % 11 - 5) / 10.0"


@query(f"""with {HAT}, {VEC}, a as (select id, h, sum(x * {WEIGHTS.format(k='k', h='h')}) as x from vec, (select unnest(range(4))::int as h) group by all),
    z as (select i as id, h, greatest(sum(v * x), 0) as x from hat join a on a.id = j group by all), b as (select id, c, sum(x * {WEIGHTS.format(k='h', h='c')}) as x from z, (select unnest(range(3))::int as c) group by all),
    o as (select i as id, c, sum(v * x) as x from hat join b on b.id = j group by all) select id, c, round(exp(x - m) / sum(exp(x - m)) over (partition by id), 6) + 0.0 as prob from (select *, max(x) over (partition by id) as m from o)""")
def gcn_forward_fixed_weights(spark, folder):
    """Two convolutions with given weights: (id, c, prob)."""
    hat = _hat(spark, folder)

    def times(rows: DataFrame, wide: int) -> DataFrame:
        weight = ((F.col("k") * 7 + F.col("h") * 3) % 11 - 5) / 10.0
        spread = rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
        return spread.groupBy("id", F.col("h").alias("k2")).agg(F.sum(F.col("x") * weight).alias("x")).withColumnRenamed("k2", "k")

    hidden = matrix.times_dense(hat, times(_vectors(spark, folder), 4)).withColumn("x", F.greatest("x", F.lit(0.0)))
    out = matrix.times_dense(hat, times(hidden, 3)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("z"))
    return _rounded(out.select("id", F.posexplode(N.softmax(F.col("z.x"))).alias("c", "prob")), "prob")


@query(f"""with {DOTS}, g as (select src, unnest(cast(b.embedding as double[])) * (d - w) as x, unnest(range(len(b.embedding)))::int as k from dots join embeddings b on b.vec_id = dst),
    own as (select vec_id as src, unnest(cast(embedding as double[])) * 0.01 as x, unnest(range(len(embedding)))::int as k from embeddings where vec_id in (select src from dots))
    select src as id, k, round(sum(x), 6) + 0.0 as g from (select * from g union all select * from own) group by src, k""")
def gf_gradient(spark, folder):
    """The gradient of graph factorisation at given vectors: (id, k, g)."""
    rows = _dots(spark, folder)
    pulls = rows.withColumn("e", F.col("d") - F.col("weight")).select(F.col("src").alias("id"), F.posexplode(F.transform("b", lambda x: x.cast("double") * F.col("e"))).alias("k", "g"))
    held = _vectors(spark, folder).join(rows.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "k", (F.col("x") * 0.01).alias("g"))
    return _rounded(pulls.unionByName(held).groupBy("id", "k").agg(F.sum("g").alias("g")), "g")


@query(f"""with {TRADE}, sides as (select src, dst, max(w) as w from (select src, dst, w from trade union all select dst, src, w from trade) where src <> dst group by all), d as (select src as id, sum(w) as d from sides group by src),
    l as (select id as i, id as j, 1.0::double as v from d union all select src, dst, -w / sqrt(a.d) / sqrt(b.d) from sides join d a on a.id = src join d b on b.id = dst),
    l2 as (select a.i, b.j, sum(a.v * b.v) as v from l a join l b on a.j = b.i group by all)
    select (select count(*) from d) as n, round((select sum(v) from l where i = j), 5) + 0.0 as first, round((select sum(v) from l2 where i = j), 5) + 0.0 as second, round((select sum(a.v * b.v) from l2 a join l b on a.j = b.i and a.i = b.j), 5) + 0.0 as third""")
def lap_eigenvalues(spark, folder):
    """All eigenvalues of the normalised Laplacian, by the sums of their first three powers, which are traces."""
    both = graph.symmetrized(trade(spark, folder).where("src <> dst"))
    n = _nodes(both).count()
    _, values, _ = embed.top_svd(matrix.laplacian(matrix.matrix(both), _nodes(both)), n)
    sums = [F.lit(round(float((values**p).sum()), 5) + 0.0).alias(name) for p, name in ((1, "first"), (2, "second"), (3, "third"))]
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), *sums)


@query(f"""with {TRADE}, two as (select a.src as i, b.dst as j, sum(a.w * b.w) as v from trade a join trade b on a.dst = b.src group by all), g as (select a.i, b.i as j, sum(a.v * b.v) as v from two a join two b on a.j = b.j group by all)
    select round(ln((select sum(v) from g where i = j)), 6) + 0.0 as second, round(ln((select sum(v * v) from g)), 6) + 0.0 as fourth""")
def hope_singular_values(spark, folder):
    """All singular values of the two-step matrix, by the logarithms of the sums of their second and fourth powers."""
    a = matrix.matrix(trade(spark, folder))
    two = matrix.product(a, a)
    _, values, _ = embed.top_svd(two, two.select(F.explode(F.array("i", "j"))).distinct().count())
    return spark.range(1).select(*[F.lit(round(math.log((values**p).sum()), 6) + 0.0).alias(name) for p, name in ((2, "second"), (4, "fourth"))])


@query(f"""with {NEAR}, book as (select id, row_number() over (order by id) - 1 as x from nodes), n as (select count(*) as n, count(*) * (count(*) - 1) // 2 as every from nodes),
    known as (select distinct b.x * (b.x - 1) // 2 + a.x as pair from near join book a on a.id = src join book b on b.id = dst where src < dst),
    tried as (select distinct {_draw('t', '7', "'pair'")} % every as pair from n, (select unnest(range(64 + 2 * 1000)) as t)),
    chosen as (select pair from tried where pair not in (select pair from known) order by {_draw('pair', '7')}, pair limit 1000)
    select u.id as u, v.id as v from chosen join book v on v.x * (v.x - 1) // 2 <= pair and pair < v.x * (v.x + 1) // 2 join book u on u.x = pair - v.x * (v.x - 1) // 2""")
def negative_edges(spark, folder):
    edges = near(spark, folder).where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return structure.non_edges(edges, 1000, 7)


@query()
def hope_embedding(spark, folder):
    return embed.hope(PropertyGraph.from_edges(near(spark, folder)), 8)


@query()
def laplacian_embedding(spark, folder):
    return embed.laplacian_map(PropertyGraph.from_edges(near(spark, folder)), 4)


@query()
def grarep_embedding(spark, folder):
    return embed.grarep(PropertyGraph.from_edges(near(spark, folder)), 8, 2)


@query()
def deepwalk_embedding(spark, folder):
    return embed.deepwalk(PropertyGraph.from_edges(near(spark, folder)), 16, walks=2, length=10, window=4)


@query()
def node2vec_embedding(spark, folder):
    return embed.node2vec(PropertyGraph.from_edges(near(spark, folder)), 16, walks=2, length=10, p=0.25, q=4.0, window=4)


@query()
def factorisation_embedding(spark, folder):
    return embed.factorised(PropertyGraph.from_edges(near(spark, folder)), 8, epochs=5)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("features"))


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of vectors; one part in five tests, one validates."""
    fifth = F.col("vec_id") % 5
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), F.when(fifth == 0, "test").when(fifth == 1, "val").otherwise("train").alias("part"))


@query()
def line_embedding(spark, folder):
    return embed.embed(PropertyGraph.from_edges(near(spark, folder)), "line", dim=8, order=3, epochs=3)


@query()
def sdne_embedding(spark, folder):
    return embed.embed(PropertyGraph.from_edges(near(spark, folder)), "sdne", layers=(32, 8), epochs=3)


@query()
def tadw_embedding(spark, folder):
    return embed.embed(PropertyGraph.from_edges(near(spark, folder)), "tadw", features=_features(spark, folder), dim=16, rounds=5)


@query()
def lle_embedding(spark, folder):
    edges = graph.symmetrized(trade(spark, folder).where("src <> dst"))
    return embed.embed(PropertyGraph.from_edges(edges), "lle", dim=4)


@query()
def gcn_train(spark, folder):
    return networks.gcn(near(spark, folder), _features(spark, folder), _marks(spark, folder), 10)[0]


@query()
def gcn_chebyshev_train(spark, folder):
    return networks.gcn_chebyshev(near(spark, folder), _features(spark, folder), _marks(spark, folder), 10)[0]


@query()
def mlp_train(spark, folder):
    return networks.mlp(_features(spark, folder), _marks(spark, folder), 10, epochs=3)[0]


@query()
def link_prediction_mlp(spark, folder):
    pairs = structure.train_test(near(spark, folder), 0.8, 2)
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return networks.link_prediction(pairs, vectors, epochs=5)[0]


@query()
def label_ranking(spark, folder):
    rows = _table(spark, folder, "embeddings")
    labels = rows.select(F.col("vec_id").alias("line_no"), F.col("vec_id").alias("id"), F.array(F.col("label").cast("string")).alias("labels"))
    return networks.rank_labels(rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")), labels, 0.5, epochs=5)


@query()
def pca_projection(spark, folder):
    rows = _table(spark, folder, "embeddings")
    return networks.principal_components(rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")), 2)
