from pyspark.sql import functions as F

from tabulon.operators import graph as gr
from tabulon.plans.shared import cut
from tabulon.queries.recommend_q import ratings
from tabulon.queries.registry import R, query, rnd

EDGES = """with r as (select o_custkey as u, l_partkey as i, avg(l_quantity) as rating from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
p as (select u, i from r where rating >= 25.5),
o as (select max(u) + 1 as o from p),
s as (select u as src, i + o as dst from p, o union all select i + o, u from p, o),
d as (select src, count(*) as n from s group by 1),
w as (select s.src, s.dst, 1 / sqrt(a.n * b.n) as w from s join d a on s.src = a.src join d b on s.dst = b.src) """


def edges(spark, sf):
    return gr.positive_edges(ratings(spark, sf), 25.5)


@query("c15_positive_edges", EDGES + """select u as "user", i as item from p""")
def _(spark, sf):
    return edges(spark, sf)


@query("c16_symmetric_edges", EDGES + "select src, dst from s")
def _(spark, sf):
    return gr.symmetrize(edges(spark, sf))


@query("c16_back_to_bipartite", EDGES + """select u as "user", i as item from p""")
def _(spark, sf):
    e = edges(spark, sf)
    return gr.bipartite(gr.symmetrize(e), e.agg(F.max("user") + 1).first()[0])


@query("c17_degree_normalised", EDGES + f"select src, dst, {R('w', 8)} as w from w")
def _(spark, sf):
    return gr.gcn_norm(gr.symmetrize(edges(spark, sf))).withColumn("w", rnd("w", 8))


@query(
    "c18_neighbour_averaging",
    EDGES + f""", e0 as (select distinct src as id, (src % 10) / 10 as x, (src % 7) / 7 as y from s),
    e1 as (select w.dst as id, sum(w * x) as x, sum(w * y) as y from w join e0 on e0.id = w.src group by 1),
    e2 as (select w.dst as id, sum(w * x) as x, sum(w * y) as y from w join e1 on e1.id = w.src group by 1)
    select id, {R('(e0.x + e1.x + e2.x) / 3')} as x, {R('(e0.y + e1.y + e2.y) / 3')} as y from e0 join e1 using (id) join e2 using (id)""",
)
def _(spark, sf):
    sym = cut(gr.symmetrize(edges(spark, sf)))
    emb = sym.select(F.col("src").alias("id")).distinct().select("id", F.array((F.col("id") % 10) / 10, (F.col("id") % 7) / 7).alias("vec"))
    out = gr.propagate(gr.gcn_norm(sym), emb, 2, 2)
    return out.select("id", rnd(F.col("vec")[0]).alias("x"), rnd(F.col("vec")[1]).alias("y"))
