from pyspark.sql import functions as F

from tabulon.operators import bandit as bd
from tabulon.queries.registry import R, U, query, rnd, table

LOG = "with l as (select event_id, user_id % 2 as arm, case when event_type = 'click' then 1 else 0 end as click from events) "


def log(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % 2).alias("arm"), (F.col("event_type") == "click").cast("int").alias("click"))


@query(
    "b01_arm_stats",
    LOG + f"select arm, count(*) as shown, cast(sum(click) as bigint) as clicks, {R('avg(click)')} as ctr, {R('count(*) / sum(count(*)) over ()')} as share from l group by 1",
)
def _(spark, sf):
    df = bd.arm_stats(log(spark, sf), "arm", "click")
    return df.withColumn("ctr", rnd("ctr")).withColumn("share", rnd("share"))


REGRET = LOG + f""", r as (select arm, avg(click) as r from l group by 1)
select event_id, arm, {R('sum((select max(r) from r) - r) over (order by event_id)', 5)} as regret from l join r using (arm)"""


@query("b02_regret_curve", REGRET)
def _(spark, sf):
    return bd.regret_curve(log(spark, sf), "arm", "click", ["event_id"]).select("event_id", "arm", rnd("regret", 5).alias("regret"))


@query("b02_regret_curve_hot", REGRET)
def _(spark, sf):
    df = bd.regret_curve(log(spark, sf), "arm", "click", ["event_id"], group_rows=0)
    return df.select("event_id", "arm", rnd("regret", 5).alias("regret"))


@query(
    "b03_ucb1",
    LOG + f""", s as (select arm, count(*) as n, avg(click) + sqrt(2 * ln((select count(*) from l)) / count(*)) as score from l group by 1)
    select arm, n as shown, {R('score')} as score, score = max(score) over () as chosen from s""",
)
def _(spark, sf):
    df = bd.ucb1(bd.arm_stats(log(spark, sf), "arm", "click"), "arm")
    return df.select("arm", "shown", rnd("score").alias("score"), "chosen")


STEPS = LOG + f""", h as (select event_id, row_number() over w as step,
 coalesce(sum(case when arm = 0 then 1 else 0 end) over p, 0) as n0, coalesce(sum(case when arm = 1 then 1 else 0 end) over p, 0) as n1,
 coalesce(sum(case when arm = 0 then click else 0 end) over p, 0) as k0, coalesce(sum(case when arm = 1 then click else 0 end) over p, 0) as k1 from l
 window w as (order by event_id), p as (order by event_id rows between unbounded preceding and 1 preceding)),
s as (select event_id, step, case when n0 > 0 then k0 / n0 + sqrt(2 * ln(step) / n0) else 1e300 end as s0, case when n1 > 0 then k1 / n1 + sqrt(2 * ln(step) / n1) else 1e300 end as s1 from h)
select event_id, step, {R('least(s0, 1e6)')} as s0, {R('least(s1, 1e6)')} as s1, cast(case when s0 >= s1 then 0 else 1 end as bigint) as choice from s"""


@query("b03_ucb1_steps", STEPS)
def _(spark, sf):
    df = bd.ucb1_steps(log(spark, sf), "arm", "click", ["event_id"])
    cap = lambda c: rnd(F.least(F.col(c), F.lit(1e6)))
    return df.select("event_id", "step", cap("score_0").alias("s0"), cap("score_1").alias("s1"), F.col("choice").cast("long").alias("choice"))


@query(
    "b04_greedy_arm",
    LOG + f"""select arm, {R('ctr')} as ctr from (select arm, avg(click) as ctr from (select * from l order by event_id limit 100) group by 1 order by 2 desc, 1 limit 1)""",
)
def _(spark, sf):
    df = bd.greedy_arm(log(spark, sf), "arm", "click", ["event_id"], 100)
    return df.select("arm", rnd("ctr").alias("ctr"))


GREEDY = "(select arm from (select * from l order by event_id limit 100) group by 1 order by avg(click) desc, 1 limit 1)"
EPSILON = f"case when {U('l.event_id', seed=5)} < 0.95 then {GREEDY} else 1 - {GREEDY} end"


@query("b04_epsilon_choices", LOG + f"select event_id, {EPSILON} as choice from l")
def _(spark, sf):
    df = log(spark, sf)
    winner = bd.greedy_arm(df, "arm", "click", ["event_id"], 100).select("arm").scalar()
    return df.select("event_id", bd.epsilon_choice(df, winner, [0, 1], 0.05, 5, ["event_id"]).alias("choice"))


@query(
    "b05_thompson_posterior",
    LOG + f"select arm, 1 + cast(sum(click) as bigint) as alpha, 1 + count(*) - cast(sum(click) as bigint) as beta, {R('(1 + sum(click)) / (2 + count(*))')} as mean from l group by 1",
)
def _(spark, sf):
    return bd.thompson(bd.arm_stats(log(spark, sf), "arm", "click"), "arm").withColumn("mean", rnd("mean"))


@query("b05_thompson_win_share")
def _(spark, sf):
    return bd.thompson_draws(bd.thompson(bd.arm_stats(log(spark, sf), "arm", "click"), "arm"), "arm", 2000, 42)


FIXED = (
    STEPS.replace("select event_id, step, " + R("least(s0, 1e6)"), "select * from (with o as (select event_id, step, " + R("least(s0, 1e6)"), 1)
    + f""" ), w as (select arm, avg(click) as r from l group by 1), win as (select arm from (select * from l order by event_id limit 100) group by 1 order by avg(click) desc, 1 limit 1),
    c as (select 'ucb1' as policy, l.*, o.choice from l join o using (event_id) union all select 'greedy', l.*, (select arm from win) from l)
    select policy, count(*) as matched, cast(sum(click) as bigint) as reward, {R('avg((select max(r) from w) - w.r)')} as regret, {R('sum(click) / count(*)')} as reward_rate
    from c join w using (arm) where choice = arm group by 1)"""
)
# The random policies draw by hash of the row, which SQL can say, too.
FOUR = (
    STEPS.replace("select event_id, step, " + R("least(s0, 1e6)"), "select * from (with o as (select event_id, step, " + R("least(s0, 1e6)"), 1)
    + f""" ), w as (select arm, avg(click) as r from l group by 1), win as (select arm from (select * from l order by event_id limit 100) group by 1 order by avg(click) desc, 1 limit 1),
    c as (select 'ucb1' as policy, l.*, o.choice from l join o using (event_id) union all select 'greedy', l.*, (select arm from win) from l
    union all select 'random', l.*, cast(floor({U('l.event_id', seed=9)} * 2) as bigint) from l union all select 'epsilon_greedy', l.*, {EPSILON} from l)
    select policy, count(*) as matched, cast(sum(click) as bigint) as reward, {R('avg((select max(r) from w) - w.r)')} as regret, {R('sum(click) / count(*)')} as reward_rate
    from c join w using (arm) where choice = arm group by 1)"""
)


@query("b06_replay_fixed_policies", FIXED)
def _(spark, sf):
    df = log(spark, sf)
    steps = bd.ucb1_steps(df, "arm", "click", ["event_id"], [0, 1])
    winner = bd.greedy_arm(df, "arm", "click", ["event_id"], 100).select("arm").scalar()
    out = bd.replay(steps, {"greedy": winner, "ucb1": F.col("choice").cast("long")}, "arm", "click")
    return out.select("policy", "matched", "reward", rnd("regret").alias("regret"), rnd("reward_rate").alias("reward_rate"))


@query("b06_replay_policies", FOUR)
def _(spark, sf):
    df = log(spark, sf)
    steps = bd.ucb1_steps(df, "arm", "click", ["event_id"], [0, 1])
    winner = bd.greedy_arm(df, "arm", "click", ["event_id"], 100).select("arm").scalar()
    best = F.floor(bd.uniform(["event_id"], 9) * 2).cast("long")
    out = bd.replay(
        steps,
        {"random": best, "greedy": winner, "epsilon_greedy": bd.epsilon_choice(df, winner, [0, 1], 0.05, 5, ["event_id"]), "ucb1": F.col("choice").cast("long")},
        "arm", "click",
    )
    return out.select("policy", "matched", "reward", rnd("regret").alias("regret"), rnd("reward_rate").alias("reward_rate"))


def _draw(i: int) -> str:
    """SQL of one posterior draw, as thompson_steps makes it."""
    a, b = f"(1.0::double + k{i})", f"(1.0::double + n{i} - k{i})"
    normal = f"sqrt(-2 * ln(1 - {U('event_id', str(i), seed=21)})) * cos(2 * pi() * {U('event_id', str(i), seed=22)})"
    return f"{a} / ({a} + {b}) + {normal} * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"


@query(
    "b06_replay_thompson",
    STEPS[: STEPS.index("s as (select event_id, step, case")]
    + f"""c as (select event_id, case when {_draw(0)} >= {_draw(1)} then 0 else 1 end as choice from h),
    w as (select arm, avg(click) as r from l group by 1)
    select 'thompson' as policy, count(*) as matched, cast(sum(click) as bigint) as reward, {R('avg((select max(r) from w) - w.r)')} as regret, {R('sum(click) / count(*)')} as reward_rate
    from l join c using (event_id) join w using (arm) where choice = arm""",
)
def _(spark, sf):
    steps = bd.thompson_steps(log(spark, sf), "arm", "click", ["event_id"], 21, [0, 1])
    out = bd.replay(steps, {"thompson": F.col("choice").cast("long")}, "arm", "click")
    return out.select("policy", "matched", "reward", rnd("regret").alias("regret"), rnd("reward_rate").alias("reward_rate"))
