"""Queries on chains: hidden Markov models over event sequences, Kalman filters over their values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from stemma.functions.special import digamma_sql, uniform, uniform_sql
from stemma.operators import blocks, chain, dense
from stemma.plans.registry import longs, query, r, rounded, table

EVENTS = ["click", "error", "purchase", "signup", "view"]
MODEL = chain.HMM((0.6, 0.4), ((0.7, 0.3), (0.2, 0.8)), ((0.1, 0.2, 0.3, 0.15, 0.25), (0.3, 0.25, 0.1, 0.2, 0.15)))
K = MODEL.k

# ---- SQL building blocks --------------------------------------------------------------------------

SEQ = f"select user_id as seq_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t, event_id, value, list_position({EVENTS}, event_type) - 1 as y from events"


def lse_sql(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


def pick(rows, y="y") -> str:
    return "case " + y + "".join(f" when {i} then ln({p!r})" for i, p in enumerate(rows)) + " else 0.0 end"


def like_sql(y="y") -> str:
    return ", ".join(f"{pick(MODEL.e[k], y)} as l{k}" for k in range(K))


LIKE = f"select seq_id, t, event_id, y, {like_sql()} from ({SEQ})"


def ctes(lik: str = LIKE, known: bool = False) -> str:
    """lik, fwd (a0, a1), bwd (b0, b1), z for two states; with ``known``, column k cuts the chain."""
    trans = lambda j, k, x: f"(case when {x}.k is null then ln({MODEL.a[j][k]!r}) when {x}.k = {k} then 0.0 else -1e300 end)" if known else f"ln({MODEL.a[j][k]!r})"
    init = lambda k: f"(case when k is null then ln({MODEL.pi[k]!r}) when k = {k} then 0.0 else -1e300 end)" if known else f"ln({MODEL.pi[k]!r})"
    fwd = ", ".join(f"l.l{k} + {lse_sql(f'f.a0 + {trans(0, k, "l")}', f'f.a1 + {trans(1, k, "l")}')}" for k in range(2))
    bwd = ", ".join(lse_sql(*[f"{trans(j, k, 'l')} + l.l{k} + b.b{k}" for k in range(2)]) for j in range(2))
    return f"""lik as materialized ({lik}),
      len as (select seq_id, max(t) as n from lik group by 1),
      fwd as (select seq_id, t, {init(0)} + l0 as a0, {init(1)} + l1 as a1 from lik where t = 0
              union all select l.seq_id, l.t, {fwd} from fwd f join lik l on l.seq_id = f.seq_id and l.t = f.t + 1),
      bwd as (select seq_id, n as t, 0.0::double as b0, 0.0::double as b1 from len
              union all select l.seq_id, l.t - 1, {bwd} from bwd b join lik l on l.seq_id = b.seq_id and l.t = b.t where l.t > 0),
      z as (select f.seq_id, {lse_sql('a0', 'a1')} as logz from fwd f join len n on n.seq_id = f.seq_id and n.n = f.t)"""


def per_state(expr: str, name: str, source: str, digits: int = 6) -> str:
    """One row per state from expressions with {k}."""
    return " union all ".join(f"select seq_id, t, {k}::bigint as state, round({expr.format(k=k)}, {digits}) + 0.0 as {name} from {source}" for k in range(K))


# ---- inputs ---------------------------------------------------------------------------------------


def coded(spark, d):
    code = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event_type")) - 1
    return table(spark, d, "events").select("user_id", "ts", "event_id", "value", code.alias("y"))


def event_sequences(spark, d, *extra: str):
    return chain.sequences(coded(spark, d), "user_id", ["ts", "event_id"], "y", *extra)


def like(x):
    return chain.categorical(MODEL, x["y"])


def event_messages(spark, d):
    return chain.messages(MODEL, event_sequences(spark, d), like)


def steps_of(f):
    return F.transform("xs", lambda x: F.struct(f(x).alias("like")))


# ---- filters --------------------------------------------------------------------------------------


@query(f"with recursive {ctes()} select seq_id, round(logz, 6) as log_marginal from z")
def hmm_log_marginal(spark, d):
    return event_sequences(spark, d).select("seq_id", r(chain.log_marginal(MODEL, steps_of(like))).alias("log_marginal"))


@query(f"with recursive {ctes()} {per_state('a{k}', 'alpha', 'fwd')}")
def hmm_forward(spark, d):
    m = event_sequences(spark, d).withColumn("alpha", chain.forward(MODEL, steps_of(like)))
    return rounded(chain.exploded(m, F.col("alpha"), "alpha"), "alpha")


def daily(spark, d):
    """Events in blocks of a day, so that no sequence has to fit a row."""
    return blocks.block_table(coded(spark, d), "user_id", ["ts", "event_id"], F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")), "y")


@query(f"with recursive {ctes()} select seq_id, round(logz, 6) as log_marginal from z")
def hmm_log_marginal_blocked(spark, d):
    """The same likelihood from matrices of blocks, which are folded in parallel."""
    return blocks.log_marginal(MODEL, daily(spark, d), like).select("seq_id", r("logz").alias("log_marginal"))


@query(f"with recursive {ctes()} select seq_id, round(a0, 6) as a0, round(a1, 6) as a1, count(*) as n from fwd group by all")
def hmm_forward_blocked(spark, d):
    """The same forward messages, filled in block by block."""
    rows = blocks.forward(MODEL, daily(spark, d), like).select("seq_id", F.explode("alpha").alias("a"))
    return rows.select("seq_id", r(F.col("a")[0]).alias("a0"), r(F.col("a")[1]).alias("a1")).groupBy("seq_id", "a0", "a1").agg(F.count("*").alias("n"))


@query(f"with recursive {ctes()} {per_state('b{k}', 'beta', 'bwd')}")
def hmm_backward_blocked(spark, d):
    m = blocks.steps_of(blocks.backward(MODEL, daily(spark, d), like), "beta", "v")
    return rounded(states(m, "beta"), "beta")


def states(m, name):
    """One row per step and state from arrays v by state."""
    rows = m.select("seq_id", F.col("t").cast("long").alias("t"), F.posexplode("v").alias("state", name))
    return rows.withColumn("state", F.col("state").cast("long"))


@query(f"with recursive {ctes()} {per_state('b{k}', 'beta', 'bwd')}")
def hmm_backward(spark, d):
    m = event_sequences(spark, d).withColumn("beta", chain.backward(MODEL, steps_of(like)))
    return rounded(chain.exploded(m, F.col("beta"), "beta"), "beta")


POST = "(select seq_id, t, exp(a0 + b0 - logz) as g0, exp(a1 + b1 - logz) as g1 from fwd join bwd using (seq_id, t) join z using (seq_id))"


@query(f"with recursive {ctes()} {per_state('g{k}', 'p', POST)}")
def hmm_smoothed_blocked(spark, d):
    m = blocks.smoothed(blocks.messages(MODEL, daily(spark, d), like))
    return rounded(states(blocks.steps_of(m, "p", "v"), "p"), "p")


@query(f"with recursive {ctes()} {per_state('g{k}', 'p', POST)}")
def hmm_smoothed(spark, d):
    m = event_messages(spark, d)
    return rounded(chain.exploded(m, chain.smoothed(m), "p"), "p")


PAIR = (
    f"with recursive {ctes()} "
    + " union all ".join(f"select f.seq_id, f.t, {j}::bigint as src, {k}::bigint as dst, round(exp(f.a{j} + ln({MODEL.a[j][k]!r}) + l.l{k} + b.b{k} - logz), 6) + 0.0 as p from fwd f join bwd b on b.seq_id = f.seq_id and b.t = f.t + 1 join lik l on l.seq_id = f.seq_id and l.t = f.t + 1 join z on z.seq_id = f.seq_id" for j in range(2) for k in range(2))
)


@query(PAIR)
def hmm_pair_joint(spark, d):
    m = event_messages(spark, d)
    rows = m.select("seq_id", F.posexplode(chain.pair_joint(MODEL)).alias("t", "x")).select("seq_id", F.col("t").cast("long").alias("t"), F.posexplode("x").alias("c", "p"))
    return rows.select("seq_id", "t", F.floor(F.col("c") / K).alias("src"), (F.col("c") % K).cast("long").alias("dst"), r("p").alias("p"))


@query(PAIR)
def hmm_pair_joint_blocked(spark, d):
    """The same pairs from blocks, those across the blocks' ends included."""
    m = blocks.pair_joint(MODEL, blocks.messages(MODEL, daily(spark, d), like))
    rows = blocks.steps_of(m, "p", "x").select("seq_id", "t", F.posexplode("x").alias("c", "p"))
    return rows.select("seq_id", F.col("t").cast("long").alias("t"), F.floor(F.col("c") / K).alias("src"), (F.col("c") % K).cast("long").alias("dst"), r("p").alias("p"))


A = [[math.log(p) for p in row] for row in MODEL.a]
VITERBI = f"""with recursive lik as materialized ({LIKE}), len as (select seq_id, max(t) as n from lik group by 1),
  best as (select seq_id, t, ln({MODEL.pi[0]!r}) + l0 as s0, ln({MODEL.pi[1]!r}) + l1 as s1, 0 as p0, 0 as p1 from lik where t = 0
    union all select l.seq_id, l.t, greatest(f.s0 + ({A[0][0]!r}), f.s1 + ({A[1][0]!r})) + l.l0, greatest(f.s0 + ({A[0][1]!r}), f.s1 + ({A[1][1]!r})) + l.l1,
      case when f.s1 + ({A[1][0]!r}) > f.s0 + ({A[0][0]!r}) then 1 else 0 end, case when f.s1 + ({A[1][1]!r}) > f.s0 + ({A[0][1]!r}) then 1 else 0 end
    from best f join lik l on l.seq_id = f.seq_id and l.t = f.t + 1),
  path as (select b.seq_id, b.t, case when s1 > s0 then 1 else 0 end as state from best b join len n on n.seq_id = b.seq_id and n.n = b.t
    union all select p.seq_id, p.t - 1, case when p.state = 1 then b.p1 else b.p0 end from path p join best b on b.seq_id = p.seq_id and b.t = p.t where p.t > 0)
  select seq_id, t, state::bigint as state from path"""


@query(VITERBI)
def hmm_viterbi(spark, d):
    p = event_sequences(spark, d).select("seq_id", F.posexplode(chain.viterbi(MODEL, steps_of(like))).alias("t", "state"))
    return p.select("seq_id", F.col("t").cast("long").alias("t"), F.col("state").cast("long").alias("state"))


@query(VITERBI)
def hmm_viterbi_blocked(spark, d):
    """The same path: each block lists its path for every state that may follow it."""
    p = blocks.steps_of(blocks.viterbi(MODEL, daily(spark, d), like), "path", "state")
    return longs(p, "t", "state")


CUT = "case when event_id % 17 = 3 then event_id % 2 end"


@query(f"with recursive {ctes(f'select seq_id, t, event_id, y, {CUT} as k, {like_sql()} from ({SEQ})', True)} select seq_id, round(logz, 6) as log_marginal from z")
def hmm_known_states(spark, d):
    """Known states cut the chain: the transition into one is certain and there is none to others."""
    known = F.when(F.col("event_id") % 17 == 3, F.col("event_id") % 2)
    seqs = chain.sequences(coded(spark, d).withColumn("known", known), "user_id", ["ts", "event_id"], "y", "known")
    steps = F.transform("xs", lambda x: F.struct(like(x).alias("like"), x["known"].alias("known")))
    return seqs.select("seq_id", r(chain.log_marginal(MODEL, steps, True)).alias("log_marginal"))


@query(f"with recursive {ctes(f'select seq_id, t, event_id, y, {like_sql()} from (select seq_id, t, event_id, case when event_id % 5 = 0 then null else y end as y from ({SEQ}))')} select seq_id, round(logz, 6) as log_marginal from z")
def hmm_missing_obs(spark, d):
    df = coded(spark, d).withColumn("y", F.when(F.col("event_id") % 5 != 0, F.col("y")))
    seqs = chain.sequences(df, "user_id", ["ts", "event_id"], "y")
    return seqs.select("seq_id", r(chain.log_marginal(MODEL, steps_of(like))).alias("log_marginal"))


MULTI = f"select seq_id, t, {', '.join(f'sum(l{k}) as l{k}' for k in range(K))} from (select l_orderkey as seq_id, dense_rank() over (partition by l_orderkey order by l_shipdate) - 1 as t, {', '.join(pick(MODEL.e[k], '(l_quantity::bigint % 5)') + f' as l{k}' for k in range(K))} from lineitem) group by 1, 2"


@query(f"with recursive {ctes(MULTI)} select seq_id, round(logz, 6) as log_marginal from z")
def hmm_multi_measurement(spark, d):
    """Several measurements at a time step: all lines of an order that ship on one day."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.collect_list(F.col("l_quantity").cast("long") % 5).alias("ys"))
    seqs = chain.sequences(rows, "l_orderkey", ["l_shipdate"], "ys")

    def many(x):
        return F.aggregate(x["ys"], chain.vector([0.0] * K), lambda acc, y: F.zip_with(acc, chain.categorical(MODEL, y), lambda a, b: a + b))

    return seqs.select("seq_id", r(chain.log_marginal(MODEL, steps_of(many))).alias("log_marginal"))


# ---- statistics, learning, sampling ---------------------------------------------------------------

GAMMA = f"gam as {POST}, xi as (select " + ", ".join(f"exp(f.a{j} + ln({MODEL.a[j][k]!r}) + l.l{k} + b.b{k} - logz) as x{j}{k}" for j in range(2) for k in range(2)) + " from fwd f join bwd b on b.seq_id = f.seq_id and b.t = f.t + 1 join lik l on l.seq_id = f.seq_id and l.t = f.t + 1 join z on z.seq_id = f.seq_id)"
STATS = (
    "stats as ("
    + " union all ".join(
        [f"select 'initial' as kind, {k}::bigint as i, 0::bigint as j, sum(g{k}) as value from gam where t = 0" for k in range(2)]
        + [f"select 'transition', {j}, {k}, sum(x{j}{k}) from xi" for j in range(2) for k in range(2)]
        + [f"select 'emission', {k}, y, sum(g{k}) from gam join lik using (seq_id, t) group by y" for k in range(2)]
    )
    + ")"
)


def event_stats(spark, d):
    return chain.expected_stats(MODEL, event_messages(spark, d))


@query(f"with recursive {ctes()}, {GAMMA}, {STATS} select kind, i, j, round(value, 4) as value from stats")
def hmm_expected_stats(spark, d):
    return rounded(event_stats(spark, d), "value", digits=4)


def over_row(df, name="p"):
    """Values normalised within (kind, i), the initial ones over all i."""
    from pyspark.sql import Window

    row = F.when(F.col("kind") == "initial", -1).otherwise(F.col("i"))
    return df.withColumn(name, F.col("value") / F.sum("value").over(Window.partitionBy("kind", row)))


@query(f"with recursive {ctes()}, {GAMMA}, {STATS} select kind, i, j, round(value / sum(value) over (partition by kind, case when kind = 'initial' then -1 else i end), 8) as p from stats")
def hmm_em_step(spark, d):
    return rounded(over_row(event_stats(spark, d)).drop("value"), "p", digits=8)


@query(f"with recursive {ctes()}, {GAMMA}, {STATS} select kind, i, j, round(value + 1.0, 4) as alpha from stats")
def hmm_cavi_step(spark, d):
    """Dirichlet parameters after one step: prior 1 plus expected counts (under these tables)."""
    return event_stats(spark, d).select("kind", "i", "j", r(F.col("value") + 1.0, 4).alias("alpha"))


def kl_sql(rows: list[tuple[list[float], list[float]]]) -> float:
    from stemma.operators.learning import dirichlet_kl

    return sum(dirichlet_kl(q, p) for q, p in rows)


#: Posterior Dirichlet rows around the model's tables, a hundred counts each, and flat priors.
ROWS = [[100 * p + 1 for p in row] for row in (MODEL.pi, *MODEL.a, *MODEL.e)]


@query(
    f"with recursive {ctes()}, q(row_, q) as (values {', '.join(f'({i}, {a!r}::double)' for i, row in enumerate(ROWS) for a in row)}), s as (select row_, q, sum(q) over (partition by row_) as t from q), "
    f"kl as (select sum(k) as kl from (select sum(-lgamma(q) + (q - 1.0) * ({{dq}} - {{dt}})) + lgamma(sum(q)) - lgamma(count(*)) as k from s group by row_)) select round((select sum(logz) from z), 4) as log_normaliser, round(kl, 6) as kl, round((select sum(logz) from z) - kl, 4) as elbo from kl".replace("{dq}", digamma_sql("q")).replace("{dt}", digamma_sql("t"))
)
def hmm_elbo(spark, d):
    """Log normaliser minus the divergence of the parameters' posterior from a flat prior."""
    kl = kl_sql([(q, [1.0] * len(q)) for q in ROWS])
    z = event_sequences(spark, d).select(chain.log_marginal(MODEL, steps_of(like)).alias("z")).agg(F.sum("z").alias("z"))
    return z.select(r("z", 4).alias("log_normaliser"), r(F.lit(kl)).alias("kl"), r(F.col("z") - kl, 4).alias("elbo"))


STATE = "(event_id % 2)"


@query(
    f"""with s as (select seq_id, t, y, {STATE} as x, lag({STATE}) over (partition by seq_id order by t) as px from ({SEQ})),
    p as (select seq_id, case when px is null then (case x when 0 then ln({MODEL.pi[0]!r}) else ln({MODEL.pi[1]!r}) end) when px = 0 then (case x when 0 then ln({MODEL.a[0][0]!r}) else ln({MODEL.a[0][1]!r}) end) else (case x when 0 then ln({MODEL.a[1][0]!r}) else ln({MODEL.a[1][1]!r}) end) end
      + case x when 0 then {pick(MODEL.e[0])} else {pick(MODEL.e[1])} end as lp from s) select seq_id, round(sum(lp), 6) as loglik from p group by 1"""
)
def hmm_loglik_complete(spark, d):
    """ln P(x, y) of complete data: looked-up logarithms and a window over adjacent states."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = coded(spark, d).withColumn("x", (F.col("event_id") % 2).cast("int")).withColumn("px", F.lag("x").over(w))
    logs = lambda t: F.array(*[chain.vector([math.log(p) for p in row]) for row in t])
    step = F.when(F.col("px").isNull(), F.get(chain.vector([math.log(p) for p in MODEL.pi]), F.col("x"))).otherwise(F.get(F.get(logs(MODEL.a), F.col("px")), F.col("x")))
    lp = step + F.get(F.get(logs(MODEL.e), F.col("x")), F.col("y").cast("int"))
    return s.select(F.col("user_id").alias("seq_id"), lp.alias("lp")).groupBy("seq_id").agg(r(F.sum("lp")).alias("loglik"))


def draw_sql(w0: str, w1: str, u: str) -> str:
    top = f"greatest({w0}, {w1})"
    return f"case when {u} * (exp(({w0}) - {top}) + exp(({w1}) - {top})) < exp(({w0}) - {top}) then 0 else 1 end"


U_FFBS = uniform_sql("'ffbs'", "seq_id", "t")


FFBS = f"""with recursive {ctes()}, fu as (select f.*, {U_FFBS} as u from fwd f), draw as (
      select f.seq_id, f.t, {draw_sql('a0', 'a1', 'u')} as state from fu f join len n on n.seq_id = f.seq_id and n.n = f.t
      union all select f.seq_id, f.t, {draw_sql(f'f.a0 + case when d.state = 0 then {A[0][0]!r} else {A[0][1]!r} end', f'f.a1 + case when d.state = 0 then {A[1][0]!r} else {A[1][1]!r} end', 'f.u')} from draw d join fu f on f.seq_id = d.seq_id and f.t = d.t - 1)
      select seq_id, t, state::bigint as state from draw"""


@query(FFBS)
def hmm_ffbs_sample(spark, d):
    m = event_sequences(spark, d).withColumn("alpha", chain.forward(MODEL, steps_of(like)))
    us = F.transform(F.sequence(F.lit(0), F.size("alpha") - 1), lambda t: uniform(F.lit("ffbs"), F.col("seq_id"), t))
    return m.withColumn("us", us).select("seq_id", F.posexplode(chain.ffbs(MODEL, F.col("us"))).alias("t", "state")).select("seq_id", F.col("t").cast("long").alias("t"), F.col("state").cast("long").alias("state"))


@query(FFBS)
def hmm_ffbs_sample_blocked(spark, d):
    """The same draws from blocks."""
    p = blocks.ffbs(MODEL, daily(spark, d), like, lambda t: uniform(F.lit("ffbs"), F.col("seq_id"), t))
    return longs(blocks.steps_of(p, "path", "state"), "t", "state")


N_SIM = 12


@query(
    f"""with recursive u as (select n_nationkey::bigint as seq_id, t, {uniform_sql("'sim'", 'n_nationkey', 't')} as u, {uniform_sql("'emit'", 'n_nationkey', 't')} as v from nation, range({N_SIM}) r(t)),
    walk as (select seq_id, t, {draw_sql(f'ln({MODEL.pi[0]!r})', f'ln({MODEL.pi[1]!r})', 'u')} as x from u where t = 0
      union all select u.seq_id, u.t, {draw_sql(f'case when w.x = 0 then {A[0][0]!r} else {A[1][0]!r} end', f'case when w.x = 0 then {A[0][1]!r} else {A[1][1]!r} end', 'u.u')} from walk w join u on u.seq_id = w.seq_id and u.t = w.t + 1),
    e as (select seq_id, t, x, v, {', '.join(f'case when x = 0 then {sum(MODEL.e[0][: i + 1])!r} else {sum(MODEL.e[1][: i + 1])!r} end as c{i}' for i in range(4))} from walk join u using (seq_id, t))
    select seq_id, t, x::bigint as x, (case when v < c0 then 0 when v < c1 then 1 when v < c2 then 2 when v < c3 then 3 else 4 end)::bigint as y from e"""
)
def hmm_simulate(spark, d):
    """States and emissions simulated from the model, one sequence per nation."""
    at = F.sequence(F.lit(0), F.lit(N_SIM - 1))
    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq_id"))
    df = df.withColumn("us", F.transform(at, lambda t: uniform(F.lit("sim"), F.col("seq_id"), t)))
    rows = df.select("seq_id", F.posexplode(chain.simulate(MODEL, F.col("us"))).alias("t", "x"))
    return rows.select("seq_id", F.col("t").cast("long").alias("t"), F.col("x").cast("long").alias("x"), chain.emit(MODEL, F.col("x"), uniform(F.lit("emit"), F.col("seq_id"), F.col("t"))).cast("long").alias("y"))


# ---- continuous emissions -------------------------------------------------------------------------

MEANS, VARS = (2.0, 4.0), (1.0, 0.5)
LOGPDF = "(-0.5 * (power(({x}) - ({m}), 2) / {v!r} + ln({v!r}) + ln(2 * pi())))"
GAUSS = "select seq_id, t, " + ", ".join(LOGPDF.format(x="ln(1 + value)", m=MEANS[k], v=VARS[k]) + f" as l{k}" for k in range(K)) + f" from ({SEQ})"


@query(f"with recursive {ctes(GAUSS)} select seq_id, round(logz, 5) as log_marginal from z")
def gaussian_hmm_log_marginal(spark, d):
    seqs = event_sequences(spark, d, "value")
    return seqs.select("seq_id", r(chain.log_marginal(MODEL, steps_of(lambda x: chain.gaussian(MEANS, VARS, F.ln(1 + x["value"])))), 5).alias("log_marginal"))


SLOPES, BASES = (0.2, 0.7), (3.0, 1.0)
SLDS = "select seq_id, t, " + ", ".join(f"coalesce({LOGPDF.format(x='v', m=f'{SLOPES[k]!r} * pv + {BASES[k]!r}', v=VARS[k])}, 0.0) as l{k}" for k in range(K)) + f" from (select seq_id, t, ln(1 + value) as v, lag(ln(1 + value)) over (partition by seq_id order by t) as pv from ({SEQ}))"


@query(f"with recursive {ctes(SLDS)} select seq_id, round(logz, 5) as log_marginal from z")
def slds_log_marginal(spark, d):
    """Discrete modes given a continuous chain: each mode is a regression on the value before."""
    seqs = event_sequences(spark, d, "value")
    pairs = F.transform("xs", lambda x, i: F.struct(F.ln(1 + x["value"]).alias("v"), F.when(i > 0, F.ln(1 + F.get(F.col("xs"), i - 1)["value"])).alias("pv")))
    steps = F.transform("pairs", lambda p: F.struct(chain.regression(SLOPES, BASES, VARS, p["pv"], p["v"]).alias("like")))
    return seqs.withColumn("pairs", pairs).select("seq_id", r(chain.log_marginal(MODEL, steps), 5).alias("log_marginal"))


# ---- vector emissions with whole covariances ----

CENTRES, COVS = ((2.0, 1.0), (4.0, 2.5)), (((1.0, 0.3), (0.3, 0.8)), ((0.5, -0.2), (-0.2, 1.2)))
TURNS, DRIFTS = (((0.2, 0.1), (0.0, 0.3)), ((0.6, -0.1), (0.2, 0.5))), ((2.5, 1.0), (1.0, 0.5))


def normal2_sql(a: str, b: str, cov) -> str:
    """ln N((a, b); 0, cov) by the inverse of the two by two matrix."""
    (c, e), (_, f) = cov
    det = c * f - e * e
    return f"(-0.5 * (({f!r} * power({a}, 2) - 2 * {e!r} * ({a}) * ({b}) + {c!r} * power({b}, 2)) / {det!r} + ln({det!r}) + 2 * ln(2 * pi())))"


def full_sql(k: int) -> str:
    a, b = f"v - {CENTRES[k][0]!r}", f"w - {CENTRES[k][1]!r}"
    return f"coalesce({normal2_sql(a, b, COVS[k])}, {LOGPDF.format(x='v', m=CENTRES[k][0], v=COVS[k][0][0])}, 0.0) as l{k}"


def turned_sql(k: int) -> str:
    a, b = (f"{x} - ({TURNS[k][i][0]!r} * pv + {TURNS[k][i][1]!r} * pw + {DRIFTS[k][i]!r})" for i, x in enumerate("vw"))
    return f"coalesce({normal2_sql(a, b, COVS[k])}, 0.0) as l{k}"


FULL = f"select seq_id, t, {', '.join(map(full_sql, range(K)))} from (select seq_id, t, ln(1 + value) as v, case when y < 4 then y::double end as w from ({SEQ}))"
TURNED = f"select seq_id, t, {', '.join(map(turned_sql, range(K)))} from (select seq_id, t, v, w, lag(v) over s as pv, lag(w) over s as pw from (select seq_id, t, ln(1 + value) as v, y::double as w from ({SEQ})) window s as (partition by seq_id order by t))"


@query(f"with recursive {ctes(FULL)} select seq_id, round(logz, 5) as log_marginal from z")
def gaussian_hmm_full_covariance(spark, d):
    """Two-dimensional emissions with a whole covariance per state; the second entry is missing at views."""
    both = lambda x: F.array(F.ln(1 + x["value"]), F.when(x["y"] < 4, x["y"].cast("double")))
    steps = steps_of(lambda x: chain.bind(both(x), lambda v: chain.gaussian_full(CENTRES, COVS, v)))
    return event_sequences(spark, d, "value").select("seq_id", r(chain.log_marginal(MODEL, steps), 5).alias("log_marginal"))


@query(f"with recursive {ctes(TURNED)} select seq_id, round(logz, 5) as log_marginal from z")
def slds_vector_log_marginal(spark, d):
    """Modes of a two-dimensional chain: each is a matrix, a drift and a covariance of the noise."""
    both = lambda x: F.array(F.ln(1 + x["value"]), x["y"].cast("double"))
    pairs = F.transform("xs", lambda x, i: F.struct(both(x).alias("v"), F.when(i > 0, both(F.get(F.col("xs"), i - 1))).alias("pv")))
    steps = F.transform("pairs", lambda p: F.struct(chain.regression_full(TURNS, DRIFTS, COVS, p["pv"], p["v"]).alias("like")))
    seqs = event_sequences(spark, d, "value").withColumn("pairs", pairs)
    return seqs.select("seq_id", r(chain.log_marginal(MODEL, steps), 5).alias("log_marginal"))


# ---- scalar Kalman --------------------------------------------------------------------------------

LDS = chain.LDS1(3.0, 2.0, 0.8, 0.5, 1.1, 0.7)
MODES = (0.8, 0.5)


def kalman_ctes(a: str = repr(LDS.a), seq: str = SEQ) -> str:
    """kf: filtered mean m, variance v, predicted variance p and cumulative log-likelihood ll, in order of time."""
    s = f"({LDS.c!r} * {LDS.c!r} * pv + {LDS.r!r})"
    upd = f"pm + {LDS.c!r} * pv / {s} * (o - {LDS.c!r} * pm) as m, pv - {LDS.c!r} * pv / {s} * {LDS.c!r} * pv as v, ll + (-0.5 * (power(o - {LDS.c!r} * pm, 2) / {s} + ln({s}) + ln(2 * pi()))) as ll"
    return f"""obs as materialized (select seq_id, t, event_id, ln(1 + value) as o from ({seq})), len as (select seq_id, max(t) as n from obs group by 1),
      kf as (select seq_id, t, {upd} from (select seq_id, t, o, {LDS.m0!r}::double as pm, {LDS.v0!r}::double as pv, 0.0::double as ll from obs where t = 0)
        union all select seq_id, t, {upd} from (select b.seq_id, b.t, b.o, {a} * k.m as pm, {a} * {a} * k.v + {LDS.q!r} as pv, k.ll from kf k join obs b on b.seq_id = k.seq_id and b.t = k.t + 1))"""


def kalman_steps(spark, d, z=None):
    seqs = event_sequences(spark, d, "value", "event_id")
    step = lambda x: F.struct(F.array(F.ln(1 + x["value"])).alias("ys"), F.lit(None).cast("double").alias("u"), (z(x) if z else F.lit(0)).cast("int").alias("z"))
    return seqs.select("seq_id", F.transform("xs", step).alias("steps"))


@query(f"with recursive {kalman_ctes()} select seq_id, t, round(m, 6) as mean, round(v, 6) as variance from kf")
def kalman1d_filter(spark, d):
    f = kalman_steps(spark, d).select("seq_id", F.posexplode(chain.kalman_filter(F.col("steps"), LDS)).alias("t", "s"))
    return f.select("seq_id", F.col("t").cast("long").alias("t"), r("s.m").alias("mean"), r("s.v").alias("variance"))


def kalman_blocks(spark, d, z=None):
    """Steps in blocks of a day."""
    b = blocks.block_table(coded(spark, d), "user_id", ["ts", "event_id"], F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")), "value", "event_id")
    step = lambda x: F.struct(F.array(F.ln(1 + x["value"])).alias("ys"), F.lit(None).cast("double").alias("u"), (z(x) if z else F.lit(0)).cast("int").alias("z"))
    return b.select("seq_id", "block", F.transform("xs", step).alias("steps"))


@query(f"with recursive {kalman_ctes()} select seq_id, t, round(m, 6) as mean, round(v, 6) as variance from kf")
def kalman1d_filter_blocked(spark, d):
    """The same filter from five numbers for each block."""
    f = blocks.steps_of(blocks.kalman_filtered(LDS, kalman_blocks(spark, d)), "f", "s")
    return f.select("seq_id", F.col("t").cast("long").alias("t"), r("s.m").alias("mean"), r("s.v").alias("variance"))


@query(f"with recursive {kalman_ctes()} select k.seq_id, round(ll, 5) as log_marginal from kf k join len n on n.seq_id = k.seq_id and n.n = k.t")
def kalman1d_log_marginal(spark, d):
    return kalman_steps(spark, d).select("seq_id", r(F.element_at(chain.kalman_filter(F.col("steps"), LDS), -1)["l"], 5).alias("log_marginal"))


@query(f"with recursive {kalman_ctes('(case when b.event_id % 2 = 0 then ' + repr(MODES[0]) + ' else ' + repr(MODES[1]) + ' end)')} select k.seq_id, round(ll, 5) as log_marginal from kf k join len n on n.seq_id = k.seq_id and n.n = k.t")
def switching_kalman1d(spark, d):
    """Dynamics picked by a known mode at each step."""
    steps = kalman_steps(spark, d, lambda x: x["event_id"] % 2)
    return steps.select("seq_id", r(F.element_at(chain.kalman_filter(F.col("steps"), LDS, chain.vector(MODES)), -1)["l"], 5).alias("log_marginal"))


@query(f"with recursive {kalman_ctes('(case when b.event_id % 2 = 0 then ' + repr(MODES[0]) + ' else ' + repr(MODES[1]) + ' end)')} select k.seq_id, round(ll, 5) as log_marginal from kf k join len n on n.seq_id = k.seq_id and n.n = k.t")
def switching_kalman1d_blocked(spark, d):
    """Modes that change inside the blocks and at their ends."""
    b = kalman_blocks(spark, d, lambda x: x["event_id"] % 2)
    return blocks.kalman_log_marginal(LDS, b, chain.vector(MODES)).select("seq_id", r("logz", 5).alias("log_marginal"))


_P = f"({LDS.a!r} * {LDS.a!r} * k.v + {LDS.q!r})"
_G = f"(k.v * {LDS.a!r} / {_P})"
SMOOTH = f""", ks as (select k.seq_id, k.t, k.m, k.v, 0.0::double as c from kf k join len n on n.seq_id = k.seq_id and n.n = k.t
        union all select k.seq_id, k.t, k.m + {_G} * (s.m - {LDS.a!r} * k.m), k.v + {_G} * {_G} * (s.v - {_P}), {_G} * s.v from ks s join kf k on k.seq_id = s.seq_id and k.t = s.t - 1)"""


def smoothed_kalman(spark, d):
    f = kalman_steps(spark, d).withColumn("f", chain.kalman_filter(F.col("steps"), LDS))
    return f.withColumn("smooth", chain.kalman_smoother(F.col("f"), F.col("steps"), LDS))


@query(f"with recursive {kalman_ctes()} {SMOOTH} select seq_id, t, round(m, 6) as mean, round(v, 6) as variance from ks")
def kalman1d_smooth(spark, d):
    s = smoothed_kalman(spark, d).select("seq_id", F.posexplode("smooth").alias("t", "s"))
    return s.select("seq_id", F.col("t").cast("long").alias("t"), r("s.m").alias("mean"), r("s.v").alias("variance"))


@query(f"with recursive {kalman_ctes()} {SMOOTH} select seq_id, t, round(m, 6) as mean, round(v, 6) as variance from ks")
def kalman1d_smooth_blocked(spark, d):
    s = blocks.steps_of(blocks.kalman_smoothed(LDS, kalman_blocks(spark, d)), "s", "s")
    return s.select("seq_id", F.col("t").cast("long").alias("t"), r("s.m").alias("mean"), r("s.v").alias("variance"))


@query(
    f"""with recursive {kalman_ctes()} {SMOOTH}, j as (select a.*, b.m as nm, b.v as nv, o.o from ks a left join ks b on b.seq_id = a.seq_id and b.t = a.t + 1 join obs o on o.seq_id = a.seq_id and o.t = a.t),
    mo as (select sum(case when nm is not null then m * m + v end) as xx, sum(nm * m + c) as xn, sum(nm * nm + nv) as nn, count(nm) as steps, sum(m * m + v) as all_xx, sum(o * m) as yx, sum(o * o) as yy, count(o) as obs from j)
    select round(xn / xx, 6) as a, round((nn - xn / xx * xn) / steps, 6) as q, round(yx / all_xx, 6) as c, round((yy - yx / all_xx * yx) / obs, 6) as r from mo"""
)
def lds1d_em_step(spark, d):
    """One EM step for dynamics and emission from smoothed moments."""
    m = chain.lds_moments(smoothed_kalman(spark, d).select("smooth", "steps"))
    a, c = F.col("xn") / F.col("xx"), F.col("yx") / F.col("all_xx")
    return m.select(r(a).alias("a"), r((F.col("nn") - a * F.col("xn")) / F.col("steps")).alias("q"), r(c).alias("c"), r((F.col("yy") - c * F.col("yx")) / F.col("obs")).alias("r"))


# ---- several dimensions ---------------------------------------------------------------------------

LDS2 = dense.LDS(np.array([3.0, 1.0]), np.eye(2), np.array([[0.8, 0.1], [-0.1, 0.7]]), 0.3 * np.eye(2), np.array([[1.0, 0.0], [0.5, 1.0]]), 0.5 * np.eye(2))


def numbered(spark, d):
    """seq_id, t and the coded event."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return coded(spark, d).select(F.col("user_id").alias("seq_id"), (F.row_number().over(w) - 1).cast("long").alias("t"), "event_id", "value", "y")


def two_dimensional(spark, d):
    """seq_id, t, m, d, y: the value's logarithm and the event's code."""
    rows = numbered(spark, d).select("seq_id", "t", F.array(F.ln(1 + F.col("value")), F.col("y").cast("double")).alias("v"))
    return rows.select("seq_id", "t", F.lit(0).cast("long").alias("m"), F.posexplode("v").alias("d", "y")).withColumn("d", F.col("d").cast("long"))


def products(x, y):
    """Product of two matrices of SQL expressions."""
    return [[" + ".join(f"({x[i][k]}) * ({y[k][j]})" for k in range(2)) for j in range(2)] for i in range(2)]


def numbers(a) -> list[list[str]]:
    return [[repr(float(v)) for v in row] for row in a]


def turned(x):
    return [list(c) for c in zip(*x, strict=True)]


def inverted(x, det: str):
    return [[f"({x[1][1]}) / {det}", f"-({x[0][1]}) / {det}"], [f"-({x[1][0]}) / {det}", f"({x[0][0]}) / {det}"]]


def entries(x, name: str) -> str:
    return ", ".join(f"{x[i][j]} as {name}{i}{j}" for i in range(2) for j in range(2))


def named_matrix(name: str, of: str = ""):
    return [[f"{of}{name}{i}{j}" for j in range(2)] for i in range(2)]


def kalman_nd_sql(modes=None, control: str = "0.0", tail: str = "") -> str:
    """kf (m0, m1, v00.., ll) and ks (smoothed), one two-dimensional measurement a step, modes and a control of the first dimension."""
    c, r_ = numbers(LDS2.c), numbers(LDS2.r)
    pick_ = lambda z: numbers(LDS2.a) if modes is None else [[f"(case {z} when 0 then {modes[0][i][j]!r} else {modes[1][i][j]!r} end)" for j in range(2)] for i in range(2)]

    def predicted(k: str, b: str) -> str:
        a = pick_(f"{b}z")
        v = products(products(a, named_matrix("v", k)), turned(a))
        v = [[f"{v[i][j]} + {float(LDS2.q[i][j])!r}" for j in range(2)] for i in range(2)]
        return ", ".join(f"({a[i][0]}) * {k}m0 + ({a[i][1]}) * {k}m1 + {f'{b}u' if i == 0 else '0.0'} as pm{i}" for i in range(2)) + ", " + entries(v, "p")

    cp = products(c, named_matrix("p"))
    spread = products(cp, turned(c))
    spread = [[f"{spread[i][j]} + {r_[i][j]}" for j in range(2)] for i in range(2)]
    gain = products(products(named_matrix("p"), turned(c)), inverted(named_matrix("s"), "det"))
    si = inverted(named_matrix("s"), "det")
    kcp = products(named_matrix("g"), cp)
    quad = " + ".join(f"e{i} * ({si[i][j]}) * e{j}" for i in range(2) for j in range(2))

    def updated(source: str) -> str:
        one = f"select *, {entries(spread, 's')}, {', '.join(f'o{i} - (({c[i][0]}) * pm0 + ({c[i][1]}) * pm1) as e{i}' for i in range(2))} from ({source})"
        two = f"select *, s00 * s11 - s01 * s10 as det from ({one})"
        three = f"select *, {entries(gain, 'g')} from ({two})"
        return f"select seq_id, t, {', '.join(f'pm{i} + g{i}0 * e0 + g{i}1 * e1 as m{i}' for i in range(2))}, {', '.join(f'p{i}{j} - ({kcp[i][j]}) as v{i}{j}' for i in range(2) for j in range(2))}, ll - 0.5 * ({quad} + ln(det) + 2 * ln(2 * pi())) as ll from ({three})"

    first = ", ".join(f"{float(x)!r}::double as pm{i}" for i, x in enumerate(LDS2.m0)) + ", " + ", ".join(f"{float(LDS2.v0[i][j])!r}::double as p{i}{j}" for i in range(2) for j in range(2))
    obs = f"obs as materialized (select seq_id, t, ln(1 + value) as o0, y::double as o1, (event_id % 2) as z, ({control})::double as u from ({SEQ})), len as (select seq_id, max(t) as n from obs group by 1)"
    kf = f"kf as ({updated(f'select seq_id, t, o0, o1, 0.0::double as ll, {first} from obs where t = 0')} union all {updated(f'select b.seq_id, b.t, b.o0, b.o1, k.ll, {predicted("k.", "b.")} from kf k join obs b on b.seq_id = k.seq_id and b.t = k.t + 1')})"
    a = pick_("z")
    pi = inverted(named_matrix("p"), "det")
    back = products(products(named_matrix("v"), turned(a)), pi)
    gap = [f"(sm{i} - pm{i})" for i in range(2)]
    sv = products(products(named_matrix("g"), [[f"(w{i}{j} - p{i}{j})" for j in range(2)] for i in range(2)]), turned(named_matrix("g")))
    joined = f"select k.seq_id, k.t, k.m0, k.m1, {', '.join(f'k.v{i}{j}' for i in range(2) for j in range(2))}, b.z, {', '.join(f's.m{i} as sm{i}' for i in range(2))}, {', '.join(f's.v{i}{j} as w{i}{j}' for i in range(2) for j in range(2))}, {predicted('k.', 'b.')} from ks s join kf k on k.seq_id = s.seq_id and k.t = s.t - 1 join obs b on b.seq_id = s.seq_id and b.t = s.t"
    gained = f"select *, {entries(back, 'g')} from (select *, p00 * p11 - p01 * p10 as det from ({joined}))"
    step = f"select seq_id, t, {', '.join(f'm{i} + g{i}0 * {gap[0]} + g{i}1 * {gap[1]} as m{i}' for i in range(2))}, {', '.join(f'v{i}{j} + {sv[i][j]} as v{i}{j}' for i in range(2) for j in range(2))} from ({gained})"
    ks = f"ks as (select k.seq_id, k.t, k.m0, k.m1, {', '.join(f'k.v{i}{j}' for i in range(2) for j in range(2))} from kf k join len n on n.seq_id = k.seq_id and n.n = k.t union all {step})"
    tail = tail or f"{SMOOTHED_2D}"
    return f"with recursive {obs}, {kf}, z as (select k.seq_id, k.ll as logz from kf k join len n on n.seq_id = k.seq_id and n.n = k.t), {ks} {tail}"


SMOOTHED_2D = " union all ".join(f"select seq_id, t, {i}::bigint as d, round(m{i}, 6) as mean, round(v{i}{i}, 6) as variance, round(logz, 6) as logz from ks join z using (seq_id)" for i in range(2))


@query(kalman_nd_sql())
def kalman_nd(spark, d):
    """Smoothed two-dimensional states of every sequence, and its log-likelihood."""
    return rounded(dense.kalman(LDS2, two_dimensional(spark, d)), "mean", "variance", "logz")


MODES2 = (((0.8, 0.1), (-0.1, 0.7)), ((0.5, 0.0), (0.2, 0.6)))


@query(kalman_nd_sql(MODES2, "case when event_id % 3 = 0 then 0.25 else 0.0 end"))
def kalman_nd_control(spark, d):
    """The same with dynamics picked by a known mode and a control that is given at some steps only."""
    model = dense.replace(LDS2, modes=tuple(map(np.array, MODES2)))
    rows = numbered(spark, d)
    modes = rows.select("seq_id", "t", (F.col("event_id") % 2).alias("z"))
    controls = rows.filter("event_id % 3 = 0").select("seq_id", "t", F.lit(0).cast("long").alias("d"), F.lit(0.25).alias("u"))
    return rounded(dense.kalman(model, two_dimensional(spark, d), controls, modes), "mean", "variance", "logz")


@query(kalman_nd_sql(tail="select seq_id, round(logz, 6) as log_marginal from z"))
def lds_model_score(spark, d):
    """Log-likelihoods by the model of linear systems."""
    from stemma.operators.facade import LDSModel

    return LDSModel(LDS2).score(dense.packed(two_dimensional(spark, d))).select("seq_id", r("logz").alias("log_marginal"))


@query(VITERBI)
def hmm_model_predict(spark, d):
    """The most probable path by the model of chains."""
    from stemma.operators.facade import HMMModel

    return longs(HMMModel(MODEL).predict(event_sequences(spark, d)), "t", "state")


@query()
def lds_em_nd(spark, d):
    """Log-likelihoods over three EM steps of a two-dimensional system; they never fall."""
    from stemma.operators.facade import LDSModel

    fitted = LDSModel(LDS2).fit(dense.packed(two_dimensional(spark, d)), "em", rounds=3)
    return spark.createDataFrame([(k, round(z, 4)) for k, z in enumerate(fitted.trace)], "iteration long, loglik double")
