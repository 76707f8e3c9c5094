from pyspark.sql import functions as F

from tabulon.plans.shared import scratch_path
from tabulon.queries.registry import R, day, query, rnd, table
from tabulon.sources import files
from tabulon.sources.arrow_files import read_arrow, write_arrow

SUMMARY = f"""select o_orderstatus, count(*) as n, {R('sum(o_totalprice)', 2)} as total,
  cast(max(o_custkey) as bigint) as max_cust from orders group by o_orderstatus"""


def _summary(df):
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        rnd(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_custkey").cast("long").alias("max_cust"),
    )


@query("s01_read_csv", SUMMARY)
def _(spark, sf):
    path = files.write_csv(table(spark, sf, "orders"), scratch_path(spark, "csv"))
    return _summary(files.read_csv(spark, path))


@query(
    "s02_read_csv_dates",
    f"""select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, {R('sum(o_totalprice)', 2)} as total
    from orders group by 1""",
)
def _(spark, sf):
    src = table(spark, sf, "orders").withColumn("o_orderdate", day("o_orderdate"))
    path = files.write_csv(src, scratch_path(spark, "csv"))
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    df = files.read_csv(spark, path, schema=schema, header=True, dates=["o_orderdate"])
    return df.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total")
    )


@query("s03_read_tab_separated", SUMMARY)
def _(spark, sf):
    path = files.write_csv(table(spark, sf, "orders"), scratch_path(spark, "tsv"), sep="\t")
    return _summary(files.read_csv(spark, path, sep="\t"))


@query(
    "s04_read_headerless_latin1",
    """select p_partkey as item_id, p_name as title, p_brand || 'é' as maker, cast(p_size as bigint) as size
    from part""",
)
def _(spark, sf):
    src = table(spark, sf, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit("é")), "p_size")
    path = files.write_csv(src, scratch_path(spark, "psv"), sep="|", header=False, encoding="ISO-8859-1")
    return files.read_csv(
        spark, path, sep="|", schema="item_id long, title string, maker string, size long", encoding="ISO-8859-1"
    )


@query("s05_read_column_subset", "select o_orderkey, o_custkey from orders")
def _(spark, sf):
    path = files.write_csv(table(spark, sf, "orders"), scratch_path(spark, "csv"))
    df = files.read_csv(spark, path, columns=["o_orderkey", "o_custkey"])
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"))


@query("s06_read_drop_stored_index", "select c_name, c_mktsegment, round(c_acctbal, 2) as c_acctbal from customer")
def _(spark, sf):
    src = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    path = files.write_csv(src, scratch_path(spark, "csv"))
    df = files.read_csv(spark, path, drop_first=True)
    return df.withColumn("c_acctbal", F.round(F.col("c_acctbal").cast("double"), 2))


@query(
    "s07_read_columnar",
    f"""select l_returnflag, count(*) as n, {R('sum(l_extendedprice)', 2)} as total
    from lineitem group by l_returnflag""",
)
def _(spark, sf):
    df = files.read_columnar(spark, f"{sf}/lineitem.parquet")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), rnd(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "s08_read_many",
    """select c_mktsegment, count(*) as n, count(case when c_acctbal >= 0 then c_acctbal end) as with_balance
    from customer group by c_mktsegment""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    a = files.write_table(c.filter("c_acctbal >= 0"), scratch_path(spark, "part"))
    b = files.write_table(c.filter("c_acctbal < 0").drop("c_acctbal"), scratch_path(spark, "part"))
    return (
        files.read_many(spark, [a, b])
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_balance"))
    )


@query(
    "s09_sql_on_file",
    f"""select event_type, count(*) as n, {R('avg(value)')} as mean_value from events group by event_type
    having count(*) > 100""",
)
def _(spark, sf):
    result = files.sql_on_file(
        spark, "select event_type, count(*) as n, avg(value) as m from {file} group by event_type",
        f"{sf}/events.parquet",
    )
    return files.sql_on(
        spark, "select event_type, n, round(m, 6) as mean_value from {result} where n > 100", result=result
    )


@query("s10_lazy_scan", "select l_orderkey, l_quantity from lineitem where l_quantity >= 49")
def _(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity >= 49").select("l_orderkey", "l_quantity")


@query(
    "s11_literal_table",
    """with channel(event_type, channel) as (values ('view', 'organic'), ('click', 'ads'), ('purchase', 'ads'),
    ('signup', 'crm')) select channel, count(*) as n from events join channel using (event_type) group by channel""",
)
def _(spark, sf):
    channel = files.literal_table(
        spark, [("view", "organic"), ("click", "ads"), ("purchase", "ads"), ("signup", "crm")],
        "event_type string, channel string",
    )
    return table(spark, sf, "events").join(channel, "event_type").groupBy("channel").agg(F.count("*").alias("n"))


@query("s12_write_parquet", SUMMARY)
def _(spark, sf):
    path = files.write_table(table(spark, sf, "orders"), scratch_path(spark, "orders"))
    return _summary(files.read_columnar(spark, path))


@query(
    "s13_write_columnar_clean",
    "select p_partkey, lower(trim(p_name)) as name, lower(p_type) as kind from part",
)
def _(spark, sf):
    clean = table(spark, sf, "part").select(
        "p_partkey", F.lower(F.trim("p_name")).alias("name"), F.lower("p_type").alias("kind")
    )
    return files.read_columnar(spark, files.write_table(clean, scratch_path(spark, "part")))


@query(
    "s07_read_arrow",
    f"""select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars, {R('avg(length(source))')} as mean_source from documents group by lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    # Four files, and more where the scan has more tasks, so that none grows with the table.
    path = write_arrow(docs.repartition(max(4, docs.rdd.getNumPartitions())), scratch_path(spark, "arrow"))
    df = read_arrow(spark, path, ["lang", "n_chars", "source"])
    return df.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), rnd(F.avg(F.char_length("source"))).alias("mean_source")
    )


@query("s13_write_arrow", "select doc_id, text, lang, source, n_chars from documents")
def _(spark, sf):
    return read_arrow(spark, write_arrow(table(spark, sf, "documents"), scratch_path(spark, "arrow"), compression="zstd"))
