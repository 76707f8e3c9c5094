"""Judge urls by rules and by the reputation of their hosts.

A host's rate of bad pages is shrunk towards that of its registered domain, this towards that of
its suffix and this towards the whole, each through a beta-binomial prior whose strength is
estimated from the spread at that level; its mean leaves out the group itself (the whole does not). A host is blocked when even the lower bound of its
posterior lies above a limit.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.shared import UPPER, stored
from tabulon.plans.sizes import with_scalars

# Strength of a prior, in pages, where the spread says nothing and at most.
PRIOR_PAGES, MOST_PAGES = 10.0, 1000.0
# One-sided 95 % bound of the normal approximation to the posterior.
BOUND_Z = 1.645
MAX_BAD = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring_index(_after(url), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no ://."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    slash = F.locate("/", rest)
    return F.coalesce(F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit("")), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def _level(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def prior_strength(groups: DataFrame) -> DataFrame:
    """One row: mean rate ``m`` and prior strength ``k`` of groups (n, bad), by moments.

    The spread of the group rates beyond binomial noise gives the variance t of the true rates,
    and m (1 - m) / t - 1 pages give a beta prior that variance. The rate is kept off 0 and 1 by
    one page half bad.
    """
    total = groups.agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("N"), F.sum("bad").alias("S"),
        F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("Q"),
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    total = total.select("g", *[zero(c).alias(c) for c in ("N", "S", "N2", "Q")])
    total = total.withColumn("m", (F.col("S") + 0.5) / (F.col("N") + 1.0))
    noise = F.col("m") * (1 - F.col("m"))
    # Sum of n (p - m)^2 over groups, and what it would be by chance alone.
    spread = F.col("Q") - 2 * F.col("m") * F.col("S") + F.col("m") * F.col("m") * F.col("N")
    room = F.col("N") - F.col("N2") / F.greatest(F.col("N"), F.lit(1.0))
    t = (spread - (F.col("g") - 1) * noise) / F.greatest(room, F.lit(1.0))
    k = F.when(F.col("g") < 2, F.lit(PRIOR_PAGES)).when(t <= noise / (MOST_PAGES + 1), F.lit(MOST_PAGES))
    return total.select("m", F.greatest(F.lit(1.0), k.otherwise(noise / t - 1)).alias("k"))


def _shrunk(groups: DataFrame, prior: Column) -> DataFrame:
    """Posterior a, b of each group under prior mean ``prior`` and the strength k of this level."""
    return groups.withColumn("a", prior * F.col("k") + F.col("bad")).withColumn(
        "b", (1 - prior) * F.col("k") + F.col("n") - F.col("bad")
    )


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = BOUND_Z) -> DataFrame:
    """host, mean, low, high: posterior of the bad rate of every host in ``hosts`` (column host).

    ``outcomes`` has one row per labelled page: host and bad (0 or 1); rows that miss either say
    nothing. A host without labelled pages has the prior of its domain; without any labelled page
    at all the prior is one half. The registered domain is the last two labels of a host, the
    suffix the last one.
    """
    seen = outcomes.filter(F.col("host").isNotNull() & F.col("bad").isNotNull())
    counts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    named = hosts.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "bad"])
    named = named.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    # One row per host, read again for each level above.
    named = stored(named, "hosts")
    known = named.filter("n > 0")
    by_suffix, by_domain = _level(known, "suffix"), _level(known, "domain")
    # What a group is shrunk towards is its level above without the group itself, so no page counts twice.
    suffixes = with_scalars(_level(named, "suffix"), prior_strength(by_suffix)).select(
        F.col("key").alias("suffix"), F.col("n").alias("sn"), F.col("bad").alias("sb"), F.col("m").alias("m"), F.col("k").alias("sk")
    )
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    above = (F.col("m") * F.col("sk") + F.col("sb") - F.col("bad")) / (F.col("sk") + F.col("sn") - F.col("n"))
    domains = domains.select("domain", F.col("n").alias("dn"), F.col("bad").alias("db"), above.alias("rate"))
    domains = with_scalars(domains, prior_strength(by_domain).select(F.col("k").alias("dk")))
    near = named.join(domains, "domain")
    above = (F.col("rate") * F.col("dk") + F.col("db") - F.col("bad")) / (F.col("dk") + F.col("dn") - F.col("n"))
    each = _shrunk(with_scalars(near, prior_strength(known.select("n", "bad")).select("k")), above)
    weight = F.col("a") + F.col("b")
    mean = F.col("a") / weight
    half = z * F.sqrt(mean * (1 - mean) / (weight + 1))
    return each.select("host", mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_id: str = "page_id",
    z: float = BOUND_Z,
    max_bad: float = MAX_BAD,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's posterior mean and low bound.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's path
    starts with its own; the longest wins, of equally long ones the last by name. Where none fits,
    the host is blocked if the lower bound of its bad rate exceeds ``max_bad``. ``outcomes`` has an
    id and bad (0 or 1) per labelled page. Null urls and urls without :// have an empty host and
    path and count as one host; repeated pages are judged alike; null ids are kept; no pages give
    no rows. Other columns are not read.
    """
    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    places = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    # Every suffix of the host that starts at a label: bounded by the length of a host.
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("said"))
    fits = places.select("host", "path", F.explode(parents).alias("parent")).join(
        own, (F.col("parent") == F.col("rule_host")) & F.startswith(F.col("path"), F.col("rule_path"))
    )
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.char_length(name).alias("size"), name.alias("rule"), "said")).alias("best"))
    bad = outcomes.select(F.col(outcome_id).alias("id"), "bad")
    labelled = seen.select("id", "host").join(bad, "id").select("host", "bad")
    reputation = host_reputation(places.select("host"), labelled, z)
    ruled = seen.join(best.withColumnsRenamed({"host": "_host", "path": "_path"}), F.expr("host = _host and path = _path"), "left").drop("_host", "_path")
    judged = ruled.join(reputation, "host")
    learnt = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.said", learnt).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"),
    )
