"""The registered queries of the text operators, and their SQL twins."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm.decontamination import contamination
from tabulon.llm.exact_dedup import exact_groups
from tabulon.llm.license_rules import BASE, LEFT, RIGHT, rules
from tabulon.llm.license_scan import scan_licenses
from tabulon.llm.negatives import hard_negatives
from tabulon.llm.packing import pack
from tabulon.llm.passage_dedup import fuzzy_passages
from tabulon.llm.secret_scan import scan_secrets
from tabulon.llm.simhash import simhash_components
from tabulon.llm.spelling import spelling_variants
from tabulon.llm.suffix_dedup import repeated_passages
from tabulon.llm.token_counts import token_counts
from tabulon.llm.toxicity import fit_chain, label_categories, score_toxicity
from tabulon.llm.url_filter import judge_urls
from tabulon.queries.registry import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AZ = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY))


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    chain = fit_chain(docs, table(spark, sf, "labels"), label_categories())
    return score_toxicity(docs, chain, "toxic").withColumnRenamed("rejected", "toxic")


@query("op3_simhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"), size=3, max_bits=3)


@query("op4_secret_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return scan_secrets(table(spark, sf, "documents"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy_passages(table(spark, sf, "documents"))


WORDS = f"regexp_extract_all({AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op6_decontamination",
    f"""with b as (select cast(item_id as varchar) as item, {WORDS} as ws from benchmark),
    wins as (select distinct item, least(len(ws), 13) as n, array_to_string(ws[i:i + 12], ' ') as win
      from (select item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
    d as (select doc_id, {WORDS} as ws from documents),
    places as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
    occ as (select doc_id, i, n, item from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as win
      from places, (select distinct n from wins) as lens where i + n - 1 <= len(ws)) as c join wins using (n, win)),
    hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) as o group by doc_id),
    its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from occ group by doc_id)
    select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from d left join hit using (doc_id) left join its using (doc_id)""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_mark")


@query(
    "op7_exact_dedup",
    f"""with n as (select doc_id, {AZ} as t from documents),
    g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
    select n.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
    from n join g using (t)""",
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(table(spark, sf, "documents"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path(VOCABULARY))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(table(spark, sf, "documents"))


# The rules of the contract, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labelled page outcomes: a page is bad if the label of its id says low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))


def _strength(name: str, source: str) -> str:
    """SQL of prior_strength over (n, bad) of ``source``."""
    return f"""{name}_sums as (select count(*) as g, cast(coalesce(sum(n), 0) as double) as nn, cast(coalesce(sum(bad), 0) as double) as s,
      cast(coalesce(sum(n * n), 0) as double) as n2, coalesce(sum(cast(bad * bad as double) / n), 0) as q from {source}),
    {name}_mean as (select *, (s + 0.5::double) / (nn + 1) as m from {name}_sums),
    {name}_var as (select *, ((q - 2 * m * s + m * m * nn) - (g - 1) * (m * (1 - m))) / greatest(nn - n2 / greatest(nn, 1), 1) as t from {name}_mean),
    {name} as (select m, greatest(1.0::double, case when g < 2 then 10.0::double when t <= m * (1 - m) / 1001 then 1000.0::double else m * (1 - m) / t - 1 end) as k from {name}_var)"""


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query(
    "op10_url_filters",
    f"""with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    seen as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
    rules(rule_host, rule_path, said) as (values {_RULE_ROWS}),
    fits as (select page_id, host, path, max({{'size': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'said': said}}) as best
      from (select distinct * from seen) join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by all),
    out as (select host, case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end as bad
      from seen join labels on page_id = doc_id),
    known as (select host, count(*) as n, sum(bad) as bad from out where bad is not null group by host),
    parts as (select host, string_split(host, '.') as p from (select distinct host from seen)),
    named as (select parts.host, p[-1] as suffix, case when len(p) > 1 then p[-2] || '.' || p[-1] else p[-1] end as domain,
      coalesce(n, 0) as n, coalesce(bad, 0) as bad from parts left join known using (host)),
    ksuf as (select suffix, sum(n) as n, sum(bad) as bad from named where n > 0 group by suffix),
    kdom as (select domain, sum(n) as n, sum(bad) as bad from named where n > 0 group by domain),
    {_strength("ps", "ksuf")},
    {_strength("pd", "kdom")},
    {_strength("ph", "known")},
    suf as (select suffix, sum(n) as sn, sum(bad) as sb from named group by suffix),
    dom as (select domain, suffix, sum(n) as dn, sum(bad) as db from named group by domain, suffix),
    domr as (select domain, dn, db, (ps.m * ps.k + sb - db) / (ps.k + sn - dn) as rate from dom join suf using (suffix), ps),
    hostr as (select host, n, bad, (rate * pd.k + db - bad) / (pd.k + dn - n) as above from named join domr using (domain), pd),
    post as (select host, above * ph.k + bad as a, (1 - above) * ph.k + n - bad as b from hostr, ph),
    rep as (select host, a / (a + b) as mean, sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) as sd from post)
    select seen.page_id, seen.host, seen.path, best.rule as rule, coalesce(best.said, case when mean - 1.645 * sd > 0.5 then 'block' else 'allow' end) as verdict
    from seen left join fits on seen.page_id = fits.page_id and seen.host = fits.host and seen.path = fits.path join rep on seen.host = rep.host""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf, "pages"), rules, page_outcomes(table(spark, sf, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op11_hard_negatives",
    """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
      list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
      cast(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
      from v as a join v as b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    pos as (select anchor_id, other as positive_id, score as positive_score from pairs where same
      qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
    neg as (select anchor_id, positive_id, other as negative_id, positive_score, score as negative_score,
      row_number() over (partition by anchor_id, positive_id order by score desc, other) as place
      from pos join pairs using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score)
    select anchor_id, positive_id, cast(place as int) as rank, negative_id, positive_score, negative_score from neg where place <= 5""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors, x = table(spark, sf, "embeddings"), F.col("embedding")
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.filter(finite).select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("vector")))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


_LICENSE_ROWS = ", ".join(f"('{r.label}', '{r.keyword}', '{r.pattern}', {r.priority}, {r.weight}::double, {k})" for k, r in enumerate(rules()))


@query(
    "license_scan_filled",
    f"""with d as (select row_number() over () as r, doc_id, {WORDS} as ws from documents),
    rules(label, keyword, pattern, priority, weight, place) as (values {_LICENSE_ROWS}),
    words as (select r, unnest(ws) as word, unnest(range(0, len(ws))) as i from d),
    around as (select r, i, word, ' ' || array_to_string(list_transform(ws[greatest(i - {LEFT} + 1, 1):i], lambda w: w || ' '), '') || '@'
        || array_to_string(ws[i + 1:i + {RIGHT} + 1], ' ') || ' ' as win
      from words join d using (r) where word in (select keyword from rules)),
    tried as (select r, i, rules.*, regexp_extract(win, pattern) as m from around join rules on keyword = word),
    cuts as (select *, i - (length(split_part(m, '@', 1)) - length(replace(split_part(m, '@', 1), ' ', ''))) + 1 as start from tried where m <> ''),
    spans as (select *, start + length(m) - length(replace(m, ' ', '')) - 1 as stop from cuts),
    kept as (select * from spans as a where not exists (select 1 from spans as b where b.r = a.r and b.start <= a.start and b.stop >= a.stop
      and b.priority >= a.priority and (b.start < a.start or b.stop > a.stop or b.priority > a.priority or b.place < a.place))),
    base as (select r, count(*) as n_base, min(start) as first_word, max(start) as last_word,
      string_agg(distinct label, ',' order by label) as base_labels from spans where priority = {BASE} group by r),
    every as (select r, string_agg(distinct label, ',' order by label) as labels
      from (select r, label from kept union select r, label from spans where priority = {BASE}) as u group by r),
    best as (select r, max(weight) as score, count(*) as n_detections from kept group by r)
    select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, coalesce(first_word, -1) as first_word,
      coalesce(last_word, -1) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
      coalesce(score, 0::double) as score, coalesce(n_detections, 0) as n_detections
    from d left join base using (r) left join every using (r) left join best using (r)""",
)
def license_scan_filled(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of op13, with -1 where there is no base phrase: engines hand on missing whole numbers in different types."""
    return op13(spark, sf).fillna(-1, ["first_word", "last_word"])


@query("op13_license_scan")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))
