"""Impression logs (order, arm, click 0/1): rates, regret and choice rules."""

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.rows import uniform
from tabulon.plans.ordered import running
from tabulon.plans.sizes import join_groups, small_rows


# Posterior draws made at a time.
DRAW_BLOCK = 10_000


def arm_stats(df: DataFrame, arm: str, click: str) -> DataFrame:
    """Impressions, clicks, click rate and share of all impressions per arm."""
    g = df.groupBy(arm).agg(F.count("*").alias("shown"), F.sum(click).cast("long").alias("clicks"))
    total = g.select(F.sum("shown").cast("double")).scalar()
    return g.withColumn("ctr", F.col("clicks") / F.col("shown")).withColumn("share", F.col("shown") / total)


def regret_curve(df: DataFrame, arm: str, click: str, order: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Running regret: the best arm's rate minus the shown arm's rate, added up in order."""
    rates = df.groupBy(arm).agg(F.avg(F.col(click).cast("double")).alias("_r"))
    best = rates.select(F.max("_r")).scalar()
    loss = join_groups(df, rates, [arm]).withColumn("_loss", best - F.col("_r"))
    return running(loss, [], order, {"regret": ("sum", "_loss")}, group_rows).drop("_loss", "_r")


def ucb1(stats: DataFrame, arm: str, t: Column | None = None) -> DataFrame:
    """Score ctr + sqrt(2 ln t / n) per arm; an arm never shown scores infinity. The best is marked."""
    t = t if t is not None else stats.select(F.sum("shown")).scalar()
    bound = F.col("clicks") / F.col("shown") + F.sqrt(2 * F.log(t.cast("double")) / F.col("shown"))
    scored = stats.withColumn("score", F.when(F.col("shown") > 0, bound).otherwise(F.lit(float("inf"))))
    # Highest score, then the first arm by name or number.
    best = scored.select(F.min(F.struct((-F.col("score")).alias("s"), F.col(arm).alias("arm"))).getField("arm")).scalar()
    return scored.withColumn("chosen", F.col(arm) == best)


def _history(df: DataFrame, arm: str, click: str, order: Sequence[str], arms: Sequence, group_rows: int | None) -> DataFrame:
    """Impressions and clicks of every arm before each row, plus the row's step from 1."""
    flags = {}
    for i, a in enumerate(arms):
        flags[f"_s{i}"] = (F.col(arm) == F.lit(a)).cast("long")
        flags[f"_k{i}"] = F.when(F.col(arm) == F.lit(a), F.col(click)).otherwise(0).cast("long")
    own = df.withColumns(flags)
    sums = {f"_r{n}": ("sum", n) for n in flags}
    out = running(own, [], order, {**sums, "step": ("count", F.lit(1))}, group_rows)
    return out.withColumns({n: F.col(f"_r{n}") - F.col(n) for n in flags}).drop(*sums)


def _argmax(arms: Sequence, scores: Sequence[Column]) -> Column:
    """The arm of highest score, the first one on ties."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(arms[-1])
    for a, s in reversed(list(zip(arms, scores))):
        out = F.when(s == top, F.lit(a)).otherwise(out)
    return out


def arms_of(df: DataFrame, arm: str) -> list:
    return sorted(r[0] for r in small_rows(df.select(arm).distinct(), 100))


def ucb1_steps(
    df: DataFrame, arm: str, click: str, order: Sequence[str], arms: Sequence | None = None, group_rows: int | None = None
) -> DataFrame:
    """UCB1 score of each arm and the choice at every step of the log, from what was seen before it."""
    arms = list(arms or arms_of(df, arm))
    h = _history(df, arm, click, order, arms, group_rows)
    scores = {}
    for i, a in enumerate(arms):
        n = F.col(f"_s{i}")
        bound = F.try_divide(F.col(f"_k{i}"), n) + F.sqrt(F.try_divide(2 * F.log(F.col("step").cast("double")), n))
        scores[f"score_{a}"] = F.when(n > 0, bound).otherwise(F.lit(float("inf")))
    out = h.withColumns(scores)
    return out.withColumn("choice", _argmax(arms, [F.col(c) for c in scores])).drop(*[f"_{x}{i}" for x in "sk" for i in range(len(arms))])


def thompson_steps(
    df: DataFrame, arm: str, click: str, order: Sequence[str], seed: int, arms: Sequence | None = None, group_rows: int | None = None
) -> DataFrame:
    """The arm with the highest posterior draw at every step, from what was seen before it.

    The beta posterior is drawn by its normal approximation, from two hashes of the row's order
    key and the arm, so a step's draws are the same wherever it runs.
    """
    arms = list(arms or arms_of(df, arm))
    h = _history(df, arm, click, order, arms, group_rows)
    scores = []
    for i in range(len(arms)):
        a, b = 1.0 + F.col(f"_k{i}"), 1.0 + F.col(f"_s{i}") - F.col(f"_k{i}")
        u, v = (uniform([*order, F.lit(i)], seed + j) for j in (0, 1))
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
        scores.append(a / (a + b) + normal * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    out = h.withColumns({f"_d{i}": s for i, s in enumerate(scores)})
    out = out.withColumn("choice", _argmax(arms, [F.col(f"_d{i}") for i in range(len(arms))]))
    return out.drop(*[f"_{x}{i}" for x in "skd" for i in range(len(arms))])


def greedy_arm(df: DataFrame, arm: str, click: str, order: Sequence[str], warmup: int) -> DataFrame:
    """The arm of highest click rate over the first ``warmup`` impressions."""
    first = df.orderBy(*order).limit(warmup)
    rates = first.groupBy(arm).agg(F.avg(F.col(click).cast("double")).alias("ctr"))
    top = rates.agg(F.min(F.struct((-F.col("ctr")).alias("s"), F.col(arm).alias("arm"))).alias("top"))
    return top.select(F.col("top.arm").alias(arm), (-F.col("top.s")).alias("ctr"))


def epsilon_choice(df: DataFrame, winner: Column, arms: Sequence, e: float, seed: int, key: Sequence[str]) -> Column:
    """The winner with probability 1 - e, else one of the other arms, by hash of the key."""
    u = uniform(key, seed)
    others = F.array_remove(F.array(*[F.lit(a) for a in arms]), winner)
    pick = F.get(others, F.least(F.floor(uniform(key, seed + 1) * F.size(others)), F.size(others) - 1).cast("int"))
    return F.when(u < 1 - e, winner).otherwise(F.coalesce(pick, winner))


def thompson(stats: DataFrame, arm: str) -> DataFrame:
    """Beta posterior per arm: parameters and mean."""
    a, b = 1 + F.col("clicks"), 1 + F.col("shown") - F.col("clicks")
    return stats.select(arm, a.alias("alpha"), b.alias("beta"), (a / (a + b)).alias("mean"))


# Numbers drawn at a time.
DRAWN = 1_000_000


def thompson_draws(posterior: DataFrame, arm: str, draws: int, seed: int) -> DataFrame:
    """Share of joint posterior draws that each arm wins. Draws are made in tasks, from one row per arm."""
    arms = small_rows(posterior.select(arm, "alpha", "beta"))
    arms = sorted(arms, key=lambda r: r[arm])
    names = [r[arm] for r in arms]
    a, b = np.array([float(r["alpha"]) for r in arms]), np.array([float(r["beta"]) for r in arms])
    kind = dict(posterior.dtypes)[arm]

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wins = np.zeros(len(names))
            for block in batch["id"]:
                # One generator per block of draws, seeded by its number, wherever it runs.
                n = min(DRAW_BLOCK, draws - int(block) * DRAW_BLOCK)
                rng = np.random.default_rng([seed, int(block)])
                # So many draws at a time that they stay small beside any number of arms.
                some = max(1, DRAWN // len(names))
                for done in range(0, n, some):
                    best = rng.beta(a, b, (min(some, n - done), len(names))).argmax(axis=1)
                    wins += np.bincount(best, minlength=len(names))
            yield pd.DataFrame({arm: names, "wins": wins})

    blocks = posterior.sparkSession.range(-(-draws // DRAW_BLOCK))
    drawn = blocks.mapInPandas(sample, f"{arm} {kind}, wins double")
    return drawn.groupBy(arm).agg((F.sum("wins") / F.lit(float(draws))).alias("win_share"))


def replay(df: DataFrame, policies: Mapping[str, Column], arm: str, click: str) -> DataFrame:
    """Value of each policy on a log: rows where its choice is the logged arm, their clicks and regret per row."""
    rates = df.groupBy(arm).agg(F.avg(F.col(click).cast("double")).alias("_r"))
    best = rates.select(F.max("_r")).scalar()
    rows = join_groups(df, rates, [arm])
    # One scan for all policies: sums over the rows where a policy agrees with the log.
    sums, cells = [], []
    for i, (name, choice) in enumerate(policies.items()):
        agrees = choice == F.col(arm)
        sums += [
            F.count(F.when(agrees, 1)).alias(f"_n{i}"), F.sum(F.when(agrees, F.col(click))).cast("long").alias(f"_k{i}"),
            F.avg(F.when(agrees, best - F.col("_r"))).alias(f"_g{i}"),
        ]
        n, k = F.col(f"_n{i}"), F.col(f"_k{i}")
        rate = F.try_divide(k.cast("double"), n.cast("double"))
        cells.append(F.struct(n.alias("matched"), k.alias("reward"), F.col(f"_g{i}").alias("regret"), rate.alias("reward_rate"), F.lit(name).alias("policy")))
    return rows.agg(*sums).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
