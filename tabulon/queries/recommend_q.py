import datetime

from pyspark.sql import functions as F

from tabulon.operators.features import index_items
from tabulon.operators import ranking as rk, recommend as rc
from tabulon.operators.joins import context_pairs
from tabulon.operators.reshape import levels
from tabulon.plans.shared import cut
from tabulon.queries.features_q import part_terms
from tabulon.queries.registry import H, R, U, query, rnd, table

RATINGS = """with r as (select o_custkey as "user", l_partkey as item, avg(l_quantity) as rating from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
picked as (select distinct "user" from r where "user" % 50 = 0),
c as (select "user", item, rating - avg(rating) over (partition by "user") as rating from r),
mine as (select r.* from r join picked using ("user")),
sim as (select m."user" as target, r."user", count(*) as shared, case when least(var_pop(r.rating), var_pop(m.rating)) > 1e-18 then corr(r.rating, m.rating) end as sim
 from r join mine m using (item) where r."user" <> m."user" group by 1, 2),
near as (select *, row_number() over (partition by target order by round(sim, 6) desc, "user") as rn from sim where round(sim, 6) > 0.3 qualify rn <= 10) """


def ratings(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_quantity")
    return li.join(orders, "l_orderkey").groupBy("user", "item").agg(F.avg("l_quantity").alias("rating"))


def shared_ratings(spark, sf):
    """The ratings written once, for queries that read them many times."""
    return cut(ratings(spark, sf))


def picked(r):
    """The users recommendations are asked for, each against all others: ids divisible by 50."""
    return r.filter(F.col("user") % 50 == 0).select("user").distinct()


@query("c09_centred_ratings", RATINGS + f"""select "user", item, {R('rating')} as rating from c""")
def _(spark, sf):
    return rc.center(ratings(spark, sf)).withColumn("rating", rnd("rating"))


@query("c10_user_correlation", RATINGS + f"""select target, "user", shared, {R('sim')} as sim from sim""")
def _(spark, sf):
    r = shared_ratings(spark, sf)
    return rc.user_corr(r, picked(r)).withColumn("sim", rnd("sim"))


@query(
    "c11_user_cosine",
    RATINGS + f""", norm as (select "user", sqrt(sum(rating * rating)) as n from c group by 1)
    select m."user" as target, x."user", {R('sum(x.rating * m.rating) / nullif(any_value(nx.n) * any_value(nm.n), 0)')} as sim
    from c x join c m using (item) join picked on picked."user" = m."user" join norm nx on nx."user" = x."user" join norm nm on nm."user" = m."user"
    where x."user" <> m."user" group by 1, 2""",
)
def _(spark, sf):
    r = shared_ratings(spark, sf)
    return rc.user_cosine(r, picked(r)).withColumn("sim", rnd("sim"))


def _near(spark, sf, r):
    return rc.neighbours(rc.user_corr(r, picked(r)).withColumn("sim", rnd("sim")), 10, 0.3)


@query("c12_neighbours", RATINGS + f"""select target, "user", {R('sim')} as sim from near""")
def _(spark, sf):
    return _near(spark, sf, shared_ratings(spark, sf)).select("target", "user", "sim")


@query(
    "c13_recommend_by_neighbours",
    RATINGS + f""", s as (select target, item, avg(round(sim, 6) * rating) as score from c join near using ("user") group by 1, 2)
    select target, item, {R('score')} as score, {R('score + m')} as predicted from s join (select "user" as target, avg(rating) as m from mine group by 1) using (target)
    qualify row_number() over (partition by target order by s.score desc, item) <= 10""",
)
def _(spark, sf):
    r = shared_ratings(spark, sf)
    out = rc.recommend_cf(r, _near(spark, sf, r), 10)
    return out.select("target", "item", rnd("score").alias("score"), rnd("predicted").alias("predicted"))


@query("c14_recommend_by_content")
def _(spark, sf):
    r = shared_ratings(spark, sf)
    terms = part_terms(spark, sf).withColumnRenamed("p_partkey", "item")
    vectors, models = rc.content_weights(r, terms, levels(terms, "term"))
    out = rc.recommend_content(r, vectors, models)
    return out.select("user", "item", "rating", rnd("predicted").alias("predicted"))


RATED = 'select distinct o_custkey as "user", l_partkey as item from orders join lineitem on o_orderkey = l_orderkey'


@query(
    "c19_negative_samples",
    f"""with seen as ({RATED}), items as (select distinct item from seen), n as (select count(*) as n from items),
    open as (select u."user", list(i.item order by i.item) as free from (select distinct "user" from seen) u, items i
      where not exists (select 1 from seen s where s."user" = u."user" and s.item = i.item) group by 1)
    select seen."user", seen.item, free[cast({H('seen."user"', 'seen.item', seed=7)} % len(free) as bigint) + 1] as negative from seen join open using ("user")""",
)
def _(spark, sf):
    r = shared_ratings(spark, sf)
    return rc.sample_negatives(r.select("user", "item"), r.select("item").distinct(), 7)


@query(
    "c20_weighted_negative_samples",
    f"""with c as (select l_partkey as item, sqrt(count(*)) as w from lineitem group by 1),
    line as (select item, w, sum(w) over (order by item) as upto from c),
    d as (select id as draw, {U('id', seed=3)} * (select sum(w) from c) as at from range(5000) t(id))
    select draw, item from d asof join (select item, upto - w as begins from line) as l on d.at >= l.begins""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"))
    return rc.sample_weighted(li, "item", 5000, 3)


def user_vectors(spark, sf):
    """Three figures per customer, as its vector."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user")).agg(
        (F.avg("o_totalprice") / 1e5).alias("a"), (F.count("*") / 10).alias("b"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("c")
    )
    return o.select("user", F.array("a", "b", "c").alias("vec"))


def item_vectors(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"),
        F.array((F.col("p_size") / 50).cast("double"), F.col("p_retailprice") / 1000, (F.col("p_partkey") % 7 / 7).cast("double")).alias("vec"),
    )


VECS = """with u as (select o_custkey as "user", avg(o_totalprice) / 1e5 as a, count(*) / 10 as b, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as c from orders group by 1),
i as (select p_partkey as item, p_size / 50 as a, p_retailprice / 1000 as b, (p_partkey % 7) / 7 as c from part),
seen as (select distinct o_custkey as "user", l_partkey as item from orders join lineitem on o_orderkey = l_orderkey) """


@query(
    "c21_bpr_loss",
    VECS.replace("u as (", "u as materialized (").replace("i as (", "i as materialized (").replace("seen as (", "seen as materialized (")
    + f""", n as (select count(*) as n from part),
     triple as (select "user", item, (item * 31 + "user") % n as negative from seen, n),
     t as (select u.a * p.a + u.b * p.b + u.c * p.c as pos, u.a * n.a + u.b * n.b + u.c * n.c as neg,
     u.a * u.a + u.b * u.b + u.c * u.c + p.a * p.a + p.b * p.b + p.c * p.c + n.a * n.a + n.b * n.b + n.c * n.c as sq
     from triple join u on u."user" = triple."user" join i p on p.item = triple.item join i n on n.item = triple.negative)
    select {R('avg(ln(1 + exp(neg - pos)))')} as bpr, {R('avg(sq) * 1e-6', 9)} as penalty, {R('avg(ln(1 + exp(neg - pos))) + avg(sq) * 1e-6')} as loss from t""",
)
def _(spark, sf):
    n = table(spark, sf, "part").count()
    pairs = ratings(spark, sf).select("user", F.col("item").alias("positive"), ((F.col("item") * 31 + F.col("user")) % n).alias("negative"))
    # Users and items share one vector table; item ids are moved past the users.
    shift = 10**9
    tri = pairs.select("user", (F.col("positive") + shift).alias("positive"), (F.col("negative") + shift).alias("negative"))
    vecs = user_vectors(spark, sf).withColumnRenamed("user", "id").unionByName(
        item_vectors(spark, sf).select((F.col("item") + shift).alias("id"), "vec")
    )
    out = rc.bpr_loss(tri, vecs, "id", "vec")
    return out.select(rnd("bpr").alias("bpr"), rnd("penalty", 9).alias("penalty"), rnd("loss").alias("loss"))


@query("c22_matrix_factors")
def _(spark, sf):
    r = shared_ratings(spark, sf)
    # The trainer takes whole numbers of 32 bits, so ids are numbered first, whatever they are.
    of_user, of_item = cut(index_items(r, "user", "u")), cut(index_items(r, "item", "i"))
    coded = r.join(of_user, "user").join(of_item, "item").select(F.col("u").cast("int"), F.col("i").cast("int"), "rating")
    model = rc.fit_als(coded, "u", "i", "rating", rank=8, iterations=3, size=r.count())
    users = model.userFactors.join(of_user, F.col("id") == F.col("u")).select("user", F.col("features").alias("vec"))
    items = model.itemFactors.join(of_item, F.col("id") == F.col("i")).select("item", F.col("features").alias("vec"))
    return rk.topk_products(users, items, 10, "user", "item", "vec", r)


@query(
    "c23_topk_unseen",
    VECS + f""", s as (select "user", i.item, u.a * i.a + u.b * i.b + u.c * i.c as score from u, i),
    k as (select s.* from s anti join seen using ("user", item) qualify row_number() over (partition by "user" order by score desc, item) <= 10)
    select "user", item, {R('score', 5)} as score, row_number() over (partition by "user" order by k.score desc, item) as rank from k""",
)
def _(spark, sf):
    out = rk.topk_products(user_vectors(spark, sf), item_vectors(spark, sf), 10, "user", "item", "vec", ratings(spark, sf))
    return out.select("user", "item", rnd("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


SPLIT = """with r as (select o_custkey as "user", l_partkey as item, o_orderdate < timestamp '2000-01-01' as old, l_quantity as q from orders join lineitem on o_orderkey = l_orderkey),
pop as (select item, row_number() over (order by sum(q) desc, item) as rank from r where old group by 1 qualify rank <= 50),
truth as (select distinct "user", item from r where not old),
h as (select t."user", count(*) as n, count(rank) filter (rank <= 50) as hits, coalesce(sum(1 / log2(rank + 1)), 0) as dcg from truth t left join pop using (item) group by 1) """


def _ranked(spark, sf):
    """The 50 items bought most before a date, ranked, for each user with later purchases."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"), "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_quantity")
    df = li.join(orders, "l_orderkey").withColumn("old", F.col("o_orderdate") < F.lit(datetime.datetime(2000, 1, 1)))
    popular = df.filter("old").groupBy("item").agg(F.sum("l_quantity").alias("q")).orderBy(F.col("q").desc(), "item").limit(50)
    ranks = F.row_number().over(_order())
    truth = df.filter("not old").select("user", "item").distinct()
    ranked = popular.withColumn("rank", ranks).select("item", "rank")
    pred = truth.join(ranked, "item").select("user", "item", "rank")
    return pred, truth


def _order():
    from pyspark.sql import Window as W

    return W.orderBy(F.col("q").desc(), "item")


@query("c24_precision_recall", SPLIT + f"select {R('avg(hits / 50.0)')} as precision, {R('avg(hits / n)')} as recall from h")
def _(spark, sf):
    pred, truth = _ranked(spark, sf)
    df = rk.precision_recall(pred, truth, 50, "user", "item")
    return df.select(rnd("precision").alias("precision"), rnd("recall").alias("recall"))


@query(
    "c25_ndcg",
    SPLIT + f", d as (select dcg, (select sum(1 / log2(i + 1)) from range(1, 51) t(i) where i <= h.n) as ideal from h) select {R('avg(dcg / ideal)')} as ndcg from d",
)
def _(spark, sf):
    pred, truth = _ranked(spark, sf)
    return rk.ndcg(pred, truth, 50, "user", "item").select(rnd("ndcg").alias("ndcg"))


@query(
    "c26_item_context_pairs",
    """with r as (select l_orderkey, p_brand, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos
    from lineitem join part on l_partkey = p_partkey)
    select a.p_brand, b.p_brand as context, count(*) as n from r a join r b on a.l_orderkey = b.l_orderkey and a.pos <> b.pos and abs(a.pos - b.pos) <= 5 group by 1, 2""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").join(part, "l_partkey")
    pairs = context_pairs(li, "l_orderkey", "p_brand", ["l_linenumber", "l_partkey", "l_suppkey"], 5)
    return pairs.groupBy("p_brand", "context").agg(F.count("*").alias("n"))


@query("c27_item_embeddings")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").join(part, "l_partkey")
    out = rc.item2vec(li, "l_orderkey", "p_brand", ["l_linenumber", "l_partkey", "l_suppkey"], size=16)
    return out.select("word", F.col("vector").cast("string").alias("vector"))


@query(
    "c28_nearest_items",
    f"""with e as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v, label from embeddings),
    m as (select label as query, list(a order by pos) as c from (select label, pos, avg(x) as a from (select label, unnest(range(1, 65)) as pos, unnest(embedding::double[]) as x from embeddings) group by 1, 2) group by 1),
    q as (select query, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) as u from m)
    select query, vec_id, {R('list_dot_product(u, v)')} as cosine from q, e qualify row_number() over (partition by query order by list_dot_product(u, v) desc, vec_id) <= 10""",
)
def _(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    out = rk.nearest(emb, rk.label_queries(emb, "label", "vec", 64), 10, "vec_id", "query", "vec")
    return out.select("query", "vec_id", rnd("cosine").alias("cosine"))


@query(
    "c28_nearest_to_each",
    f"""with e as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v from embeddings)
    select q.vec_id as query, e.vec_id, {R('list_dot_product(q.v, e.v)')} as cosine from e as q join e on q.vec_id <> e.vec_id
    qualify row_number() over (partition by q.vec_id order by list_dot_product(q.v, e.v) desc, e.vec_id) <= 5""",
)
def _(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return rk.nearest(emb, emb, 5, "vec_id", "vec_id", "vec").select("query", "vec_id", rnd("cosine").alias("cosine"))


@query(
    "c14_ridge_equations",
    """select count(distinct o_custkey) as users, count(*) as pairs, 0e0 as bias, 0e0 as weights
    from (select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey)""",
)
def _(spark, sf):
    """Each user's fit: residuals add up to nothing, and beside an item's vector to the penalty times the weights."""
    r = shared_ratings(spark, sf)
    terms = part_terms(spark, sf).withColumnRenamed("p_partkey", "item")
    names = levels(terms, "term")
    vectors, models = rc.content_weights(r, terms, names, alpha=0.01)
    rows = rc.recommend_content(r, vectors, models).join(vectors, "item").join(models.select("user", "weights"), "user")
    # One row a user, all columns of the vector at once: the rows lie by user already after the join.
    e = F.col("rating") - F.col("predicted")
    sums = rows.withColumn("e", e).groupBy("user").agg(
        F.array(*[F.sum(F.col("e") * F.col("vec")[j]) for j in range(len(names))]).alias("s"), F.sum(F.abs(F.col("rating"))).alias("size"),
        F.first("weights").alias("w"), F.sum("e").alias("bias"), F.count("*").alias("n"),
    )
    gap = F.array_max(F.zip_with("s", "w", lambda s, w: F.abs(s - 0.01 * w)))
    return sums.agg(
        F.count("user").alias("users"), F.sum("n").alias("pairs"),
        rnd(F.max(F.abs("bias") / F.col("size"))).alias("bias"), rnd(F.max(gap / F.col("size"))).alias("weights"),
    )


@query(
    "c22_user_equations",
    "select count(distinct o_custkey) as users, 0e0 as left_over from orders join lineitem on o_orderkey = l_orderkey",
)
def _(spark, sf):
    """The last half step solves each user's weighted least squares given the items (penalty 0.1 a rating, confidence 1 + rating)."""
    r = shared_ratings(spark, sf)
    of_user, of_item = index_items(r, "user", "u"), index_items(r, "item", "i")
    coded = cut(r.join(of_user, "user").join(of_item, "item").select(F.col("u").cast("int"), F.col("i").cast("int"), "rating"))
    model = rc.fit_als(coded, "u", "i", "rating", rank=6, iterations=2)
    wide = lambda df, name: df.select(F.col("id").alias(name), F.col("features").cast("array<double>").alias(f"f{name}"))
    users, items = wide(model.userFactors, "u"), wide(model.itemFactors, "i")
    gram = items.select([F.sum(F.col("fi")[a] * F.col("fi")[b]).alias(f"{a}_{b}") for a in range(6) for b in range(6)]).first()
    dot = F.aggregate(F.zip_with("fu", "fi", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    met = coded.join(users, "u").join(items, "i").withColumn("d", dot)
    push = [F.sum((F.col("rating") * (F.col("d") - 1) - 1) * F.col("fi")[a]).alias(f"p{a}") for a in range(6)]
    size = F.sum((1 + F.col("rating")) * F.sqrt(F.aggregate("fi", F.lit(0.0), lambda s, v: s + v * v))).alias("size")
    g = met.groupBy("u").agg(*push, size, F.count("*").alias("n"), F.first("fu").alias("fu"))
    whole = [sum(F.lit(gram[f"{a}_{b}"]) * F.col("fu")[b] for b in range(6)) + F.col(f"p{a}") + 0.1 * F.col("n") * F.col("fu")[a] for a in range(6)]
    gap = F.sqrt(sum(v * v for v in whole)) / F.col("size")
    return g.agg(F.count("*").alias("users"), rnd(F.max(gap), 2).alias("left_over"))
