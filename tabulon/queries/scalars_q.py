from pyspark.sql import functions as F

from tabulon.functions import scalars as sc
from tabulon.queries.registry import R, query, rnd, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(KEY)


@query(
    "f01_normalize_text",
    "select doc_id, lower(trim(lang)) as lang, lower(trim(source)) as source, md5(lower(trim(text))) as digest from documents",
)
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    out = sc.normalize_text(df, ["lang", "source", "text"])
    return out.select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("f02_replace_first", "select doc_id, md5(regexp_replace(text, '[aeiou]+', '_')) as digest from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(sc.re_replace_first("text", "[aeiou]+", "_").cast("binary")).alias("digest")
    )


@query(
    "f03_clean_name",
    r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g')) as name
    from pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.clean_name("url").alias("name"))


@query(
    "f04_translate_punctuation",
    r"""select page_id, translate(url, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '                                ') as name from pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.translate_punct("url").alias("name"))


@query("f05_concat", "select p_partkey, p_brand || ' / ' || p_type || ' / ' || p_size as label from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sc.concat_cols(["p_brand", "p_type", "p_size"], " / ").alias("label"))


@query(
    "f06_word_count",
    "select doc_id, case when text = 'No description yet' then 0 else cast(len(string_split(text, ' ')) as integer) end as words from documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.word_count("text", "No description yet").alias("words"))


@query(
    "f07_split_parts",
    """select p_partkey, coalesce(string_split(p_name, ' ')[1], 'none') as a, coalesce(string_split(p_name, ' ')[2], 'none') as b,
    coalesce(string_split(p_name, ' ')[3], 'none') as c from part""",
)
def _(spark, sf):
    a, b, c = sc.split_parts("p_name", " ", 3, "none")
    return table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"))


@query("f08_url_basename", "select page_id, string_split(url, '/')[-1] as file from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.url_basename("url").alias("file"))


@query(
    "f09_date_parts",
    "select o_orderkey, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day from orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").withColumns(sc.time_extract("o_orderdate")).select("o_orderkey", "year", "month", "day")


@query(
    "f10_cyclic_encoding",
    f"""select o_orderkey, {R('sin(2 * pi() * month(o_orderdate) / 12)')} as month_sin, {R('cos(2 * pi() * month(o_orderdate) / 12)')} as month_cos from orders""",
)
def _(spark, sf):
    cyc = sc.time_cycle(F.month("o_orderdate"), 12)
    return table(spark, sf, "orders").select("o_orderkey", rnd(cyc["sin"]).alias("month_sin"), rnd(cyc["cos"]).alias("month_cos"))


@query("f11_month_minus_day", "select o_orderkey, cast(month(o_orderdate) - day(o_orderdate) as integer) as gap from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sc.time_feature("o_orderdate").alias("gap"))


@query(
    "f12_math",
    f"""select o_orderkey, {R('sqrt(o_totalprice)')} as root, {R('ln(o_totalprice)')} as ln, {R('log2(o_totalprice)')} as l2,
    {R('power(o_totalprice / 1e5, 2)')} as square, {R('abs(o_totalprice - 2e5)')} as gap, {R('exp(-o_totalprice / 1e5)')} as decay,
    {R('sign(o_totalprice - 2e5)')} as side, {R('ln(o_totalprice / 1e5)')} as log_ratio from orders""",
)
def _(spark, sf):
    p = F.col("o_totalprice")
    cols = {
        "root": F.sqrt(p), "ln": F.log(p), "l2": F.log2(p), "square": F.pow(p / 1e5, F.lit(2.0)), "gap": F.abs(p - 2e5),
        "decay": F.exp(-p / 1e5), "side": F.signum(p - 2e5), "log_ratio": sc.log_ratio(p, F.lit(1e5)),
    }
    return table(spark, sf, "orders").select("o_orderkey", *[rnd(c).alias(n) for n, c in cols.items()])


@query(
    "f13_percentage_error",
    f"select {KEY_SQL}, {R('l_discount / nullif(l_tax, 0) - 1')} as err from lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(*KEY, rnd(sc.pct_error("l_discount", "l_tax")).alias("err"))


@query("f14_round_half_even", f"select {KEY_SQL}, round_even(l_quantity / 8, 0) as eighth from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(*KEY, sc.round_to(F.col("l_quantity") / 8, 0).alias("eighth"))


@query(
    "f15_cut",
    """select p_partkey, case when p_size > 0 and p_size <= 10 then 'small' when p_size > 10 and p_size <= 30 then 'medium'
    when p_size > 30 and p_size <= 60 then 'large' end as size_class from part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sc.cut("p_size", [0, 10, 30, 60], ["small", "medium", "large"]).alias("size_class"))


@query(
    "f16_digitize",
    """select c_custkey, greatest(1, least(4, cast(c_acctbal >= -500 as integer) + cast(c_acctbal >= 0 as integer) + cast(c_acctbal >= 2500 as integer)
    + cast(c_acctbal >= 5000 as integer) + cast(c_acctbal >= 9000 as integer))) as band from customer""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sc.digitize("c_acctbal", [-500, 0, 2500, 5000, 9000]).alias("band"))


@query(
    "f17_quantile_bins",
    """with e as (select quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from customer)
    select c_custkey, case when c_acctbal <= q[2] then 1 when c_acctbal <= q[3] then 2 when c_acctbal <= q[4] then 3 else 4 end as bin from customer, e""",
)
def _(spark, sf):
    df, _ = sc.qcut(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4)
    return df.drop("c_acctbal")


@query(
    "f18_stars",
    """select c_custkey, case when p < 1e-6 then '***' when p < 1e-3 then '**' when p < 1e-2 then '*' else '' end as stars
    from (select c_custkey, exp(-abs(c_acctbal) / 300) as p from customer)""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sc.stars(F.exp(-F.abs("c_acctbal") / 300)).alias("stars"))


SOFT = f"""with v as (select {KEY_SQL}, [l_discount * 10, l_tax * 10, l_quantity / 50] as z from lineitem),
e as (select *, list_transform(z, lambda x: exp(x - list_max(z))) as e from v),
p as (select *, list_transform(e, lambda x: x / list_sum(e)) as p from e)
select {KEY_SQL}, {R('p[1]')} as p0, {R('p[2]')} as p1, {R('p[3]')} as p2, {R('1 / (1 + exp(-z[1]))')} as sig,
greatest(z[3] - 0.5, 0e0) as relu, {R('-ln(p[3])')} as loss from p"""


@query("f19_softmax_and_loss", SOFT.replace("greatest(z[3] - 0.5, 0e0)", R("greatest(z[3] - 0.5, 0e0)")))
def _(spark, sf):
    z = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    df = table(spark, sf, "lineitem").select(*KEY, z.alias("z")).withColumn("p", sc.softmax("z"))
    y = F.array(F.lit(0), F.lit(0), F.lit(1))
    return df.select(
        *KEY, *[rnd(F.col("p")[i]).alias(f"p{i}") for i in range(3)], rnd(sc.sigmoid(F.col("z")[0])).alias("sig"),
        rnd(sc.relu(F.col("z")[2] - 0.5)).alias("relu"), rnd(sc.cross_entropy(y, "p")).alias("loss"),
    )


@query(
    "f20_one_hot",
    "select vec_id, array_to_string(list_transform(range(10), lambda i: case when i = label then 1 else 0 end), ',') as code from embeddings",
)
def _(spark, sf):
    code = sc.one_hot("label", 10).cast("array<string>")
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(code, ",").alias("code"))


@query("f21_explode", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def _(spark, sf):
    return sc.explode(table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("word")), "word")


@query(
    "f22_flatten",
    "select p_partkey, array_to_string(flatten([string_split(p_name, ' '), [p_brand, p_type]]), '|') as words from part",
)
def _(spark, sf):
    nested = F.array(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(sc.flatten(nested), "|").alias("words"))


@query(
    "f23_map_filter_reduce",
    f"""select vec_id, {R('list_sum(list_filter(list_transform(embedding::double[], lambda x: x * x), lambda x: x > 0.01))')} as energy from embeddings""",
)
def _(spark, sf):
    squares = sc.arr_map(F.col("embedding").cast("array<double>"), lambda x: x * x)
    kept = sc.arr_filter(squares, lambda x: x > 0.01)
    energy = F.when(F.size(kept) > 0, sc.arr_fold(kept, 0.0, lambda a, x: a + x))
    return table(spark, sf, "embeddings").select("vec_id", rnd(energy).alias("energy"))


@query(
    "f24_itemset_label",
    "select p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' + ') as label, cast(len(string_split(p_name, ' ')) as integer) as size from part",
)
def _(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", sc.itemset_label(words).alias("label"), F.size(words).alias("size"))


@query(
    "f25_context_slice",
    f"""select vec_id, {R('list_sum(list_concat(embedding[greatest(1, label + 1 - 2):label], embedding[label + 2:label + 3])::double[])')} as around from embeddings""",
)
def _(spark, sf):
    near = sc.context_slice(F.col("embedding").cast("array<double>"), F.col("label") + 1, 2)
    return table(spark, sf, "embeddings").select("vec_id", rnd(sc.arr_sum(near)).alias("around"))


@query("f26_list_contains", "select p_partkey, list_contains(string_split(p_name, ' '), 'ring') as is_ring from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sc.arr_has(F.split("p_name", " "), "ring").alias("is_ring"))


MAPPED = "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey"


@query("f27_map_lookup", MAPPED)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return sc.map_lookup(df, table(spark, sf, "nation"), "c_nationkey", "n_nationkey", "n_name").drop("c_nationkey")


@query("f27_map_lookup_large", MAPPED)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return sc.map_lookup(df, table(spark, sf, "nation"), "c_nationkey", "n_nationkey", "n_name").drop("c_nationkey")


@query("f28_expand_struct", f"select {KEY_SQL}, l_discount as discount, l_tax as tax from lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*KEY, F.struct(F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).alias("rates"))
    return sc.expand_struct(df, "rates")


@query(
    "f29_map_to_rows",
    "select s_suppkey, 'balance' as key, s_acctbal as value from supplier union all select s_suppkey, 'nation', cast(s_nationkey as double) from supplier",
)
def _(spark, sf):
    m = sc.columns_as_map({"balance": "s_acctbal", "nation": F.col("s_nationkey").cast("double")})
    return sc.map_to_rows(table(spark, sf, "supplier").select("s_suppkey", m.alias("m")), "m")
