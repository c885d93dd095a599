"""Chains too long for one row: every recursion over blocks of time.

A step of a filter is an associative map: a K x K matrix for a hidden Markov chain (in the log semiring,
or with maxima for the best path), five numbers for a scalar Kalman filter.  So each (sequence, block) is
folded to one map on its own, in parallel; the few maps of a sequence are chained in order, from the
front and from the back, which gives what enters each block on either side; and inside the blocks the
messages are filled in, in parallel again.  Paths are traced by giving each block one path for every
state that may follow it, and choosing among them once the chain of blocks is known.  A block is a range
of the order column, so no window over a hot key is needed, and the longest array is a block's or the
list of a sequence's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.special import lse, lse_array
from stemma.operators.chain import HMM, LDS1, NEVER, argmax, at, backwards, bind, draw, factor_of, kalman_filter, ln, rest, scan, smoothed_step, vector
from stemma.sources.scratch import staged

KEY = ["seq_id", "block"]


def block_table(df: DataFrame, seq: str, order: list[str], block: Column, *obs: str) -> DataFrame:
    """seq_id, block, xs: the observations of each block in order."""
    item = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(o) for o in obs])
    rows = df.groupBy(F.col(seq).alias("seq_id"), block.cast("long").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("_x"))
    return rows.select("seq_id", "block", F.transform("_x", lambda x: F.struct(*[x[o].alias(o) for o in obs])).alias("xs"))


def listed(rows: DataFrame, *columns: str) -> DataFrame:
    """seq_id, bs: the blocks of a sequence in order, with some columns."""
    return rows.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("bs"))


def but_last(xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.size(xs) - 1)


def largest(*xs: Column) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def moved(model: HMM, row: list[Column], add=lse) -> list[Column]:
    """A row vector times the transition table."""
    return [add(*[row[j] + ln(model.a[j][k]) for j in range(model.k)]) for k in range(model.k)]


def matrix(model: HMM, likes: Column, add=lse) -> Column:
    """array of K*K: the block's steps from its first observation on, without the transition into it."""
    k = model.k
    first = at(likes, 0)
    start = vector([at(first, j) if i == j else NEVER for i in range(k) for j in range(k)])

    def step(m: Column, like: Column) -> Column:
        rows = [moved(model, [at(m, i * k + j) for j in range(k)], add) for i in range(k)]
        return vector([rows[i][j] + at(like, j) for i in range(k) for j in range(k)])

    return F.aggregate(rest(likes), start, step)


def entering(model: HMM, blocks: DataFrame, like, add=lse) -> DataFrame:
    """seq_id, block, offset (steps before it), enter, after, logz.

    enter stands before the block's first likelihood; after is what follows, by the state of the next
    block's first step (null for the last block); logz is the whole sequence's.
    """
    k = model.k
    folded = blocks.select(*KEY, F.size("xs").cast("long").alias("n"), bind(F.transform("xs", like), lambda ls: matrix(model, ls, add)).alias("m"))
    out = lambda row, m: [add(*[at(row, i) + at(m, i * k + j) for i in range(k)]) for j in range(k)]
    into = lambda m, leave: vector([add(*[at(m, j * k + i) + leave[i] for i in range(k)]) for j in range(k)])

    def front(row: Column, b: Column) -> Column:
        return bind(vector(out(row, b["m"])), lambda r: vector(moved(model, [at(r, j) for j in range(k)], add)))

    def back(r: Column, b: Column) -> Column:
        return into(b["m"], [add(*[ln(model.a[i][j]) + at(r, j) for j in range(k)]) for i in range(k)])

    def chained(bs: Column) -> Column:
        enters = scan(but_last(bs), vector([ln(p) for p in model.pi]), front)
        afters = F.reverse(scan(F.reverse(but_last(bs)), into(F.element_at(bs, -1)["m"], [F.lit(0.0)] * k), back))
        offsets = scan(but_last(bs), F.lit(0).cast("long"), lambda t, b: t + b["n"])
        return F.struct(enters.alias("enters"), afters.alias("afters"), offsets.alias("offsets"), bs.alias("bs"))

    def spread(c: Column) -> Column:
        end = F.size(c["bs"]) - 1
        logz = vector(out(at(c["enters"], end), at(c["bs"], end)["m"]))
        each = lambda i: F.struct(at(c["bs"], i)["block"].alias("block"), at(c["offsets"], i).alias("offset"), at(c["enters"], i).alias("enter"), at(c["afters"], i + 1).alias("after"))
        return F.struct(F.transform(F.sequence(F.lit(0), end), each).alias("all"), bind(logz, lse_array if add is lse else F.array_max).alias("logz"))

    chains = listed(folded, "n", "m").select("seq_id", bind(F.col("bs"), chained).alias("c"))
    done = chains.select("seq_id", bind(F.col("c"), spread).alias("c"))
    return done.select("seq_id", F.explode("c.all").alias("b"), "c.logz").select("seq_id", "b.*", "logz")


def log_marginal(model: HMM, blocks: DataFrame, like) -> DataFrame:
    return entering(model, blocks, like).groupBy("seq_id").agg(F.max("logz").alias("logz"))


def prepared(model: HMM, blocks: DataFrame, like, add=lse) -> DataFrame:
    """Blocks with their likelihoods ls and what enters them."""
    return blocks.join(entering(model, blocks, like, add), KEY).withColumn("ls", F.transform("xs", like))


def alphas(model: HMM, x: Column, add=lse) -> Column:
    """The forward messages of a block (a struct with enter and ls)."""
    k = model.k
    start = vector([at(x["enter"], j) + at(at(x["ls"], 0), j) for j in range(k)])

    def step(row: Column, like: Column) -> Column:
        new = moved(model, [at(row, j) for j in range(k)], add)
        return vector([new[j] + at(like, j) for j in range(k)])

    return scan(rest(x["ls"]), start, step)


def betas(model: HMM, x: Column) -> Column:
    """The backward messages of a block (a struct with after and ls)."""
    ks = range(model.k)
    leave = vector([F.coalesce(lse(*[ln(model.a[j][k]) + at(x["after"], k) for k in ks]), F.lit(0.0)) for j in ks])
    step = lambda b, like: vector([lse(*[ln(model.a[j][k]) + at(like, k) + at(b, k) for k in ks]) for j in ks])
    return F.reverse(scan(F.reverse(rest(x["ls"])), leave, step))


def forward(model: HMM, blocks: DataFrame, like) -> DataFrame:
    """seq_id, block, offset, alpha: the forward messages of every block, in order."""
    return prepared(model, blocks, like).select(*KEY, "offset", bind(F.struct("enter", "ls"), lambda x: alphas(model, x)).alias("alpha"))


def backward(model: HMM, blocks: DataFrame, like) -> DataFrame:
    """seq_id, block, offset, beta: the backward messages of every block, in order."""
    return prepared(model, blocks, like).select(*KEY, "offset", bind(F.struct("after", "ls"), lambda x: betas(model, x)).alias("beta"))


def messages(model: HMM, blocks: DataFrame, like) -> DataFrame:
    """seq_id, block, offset, ls, after, alpha, beta, logz."""
    both = lambda x: F.struct(alphas(model, x).alias("alpha"), betas(model, x).alias("beta"))
    return prepared(model, blocks, like).withColumn("_m", bind(F.struct("enter", "after", "ls"), both)).select(*KEY, "offset", "ls", "after", "_m.alpha", "_m.beta", "logz")


def smoothed(m: DataFrame) -> DataFrame:
    """seq_id, block, offset, p: P(x_t | Y) for the steps of each block."""
    p = lambda x: F.zip_with(x["alpha"], x["beta"], lambda a, b: F.zip_with(a, b, lambda u, v: F.exp(u + v - x["logz"])))
    return m.select(*KEY, "offset", bind(F.struct("alpha", "beta", "logz"), p).alias("p"))


def pair_joint(model: HMM, m: DataFrame) -> DataFrame:
    """seq_id, block, offset, p: P(x_t = j, x_t+1 = k | Y), flat, for each step of the block that has a next one."""
    ks = range(model.k)

    def pairs(x: Column) -> Column:
        # what follows a step, by the next state: inside the block, or from the next block
        tail = F.zip_with(rest(x["ls"]), rest(x["beta"]), lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
        follows = F.concat(tail, F.when(x["after"].isNull(), F.array().cast("array<array<double>>")).otherwise(F.array(x["after"])))
        of = lambda a, f: vector([F.exp(at(a, j) + ln(model.a[j][k]) + at(f, k) - x["logz"]) for j in ks for k in ks])
        return F.zip_with(F.slice(x["alpha"], F.lit(1), F.size(follows)), follows, of)

    return m.select(*KEY, "offset", bind(F.struct("ls", "after", "alpha", "beta", "logz"), pairs).alias("p"))


def traced(filled: DataFrame, k: int, choose) -> DataFrame:
    """seq_id, block, offset, path: one path through all blocks, chosen from the back.

    filled: seq_id, block, offset, x (a struct with an array ``vecs``).  choose(x, i, following) is the
    state at place i given the next one, or None at the end of the sequence.  Each block lists its path
    for every state that may follow, and for the end; the chain of blocks then picks.
    """

    def paths(x: Column) -> Column:
        n = F.size(x["vecs"])
        one = lambda following: F.reverse(scan(backwards(n), choose(x, n - 1, following), lambda nxt, i: choose(x, i, nxt)))
        return F.array(*[one(F.lit(s)) for s in range(k)], one(None))

    done = staged(filled.select(*KEY, "offset", bind(F.col("x"), paths).alias("paths")), "paths")
    firsts = listed(done.select(*KEY, F.transform("paths", lambda p: at(p, 0)).alias("firsts")), "firsts")

    def picked(bs: Column) -> Column:
        after = F.reverse(scan(F.reverse(rest(bs)), F.lit(k), lambda nxt, b: at(b["firsts"], nxt)))
        return F.zip_with(bs, after, lambda b, a: F.struct(b["block"].alias("block"), a.alias("pick")))

    picks = firsts.select("seq_id", F.explode(bind(F.col("bs"), picked)).alias("b")).select("seq_id", "b.*")
    return done.join(picks, KEY).select(*KEY, "offset", at(F.col("paths"), F.col("pick")).alias("path"))


def viterbi(model: HMM, blocks: DataFrame, like) -> DataFrame:
    """seq_id, block, offset, path: the most probable states; ties go to the lower state."""
    ks = range(model.k)
    x = F.struct(bind(F.struct("enter", "ls"), lambda x: alphas(model, x, largest)).alias("vecs"))

    def best(x: Column, i: Column, following: Column | None) -> Column:
        score = [at(at(x["vecs"], i), j) for j in ks]
        return argmax(score if following is None else [s + at(vector([ln(p) for p in model.a[j]]), following) for j, s in zip(ks, score, strict=True)])

    return traced(prepared(model, blocks, like, largest).select(*KEY, "offset", x.alias("x")), model.k, best)


def ffbs(model: HMM, blocks: DataFrame, like, uniforms) -> DataFrame:
    """seq_id, block, offset, path: states drawn from P(x | Y) with the uniforms ``uniforms(t)``, t a step's number in the sequence."""
    ks = range(model.k)
    us = F.transform(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: uniforms(F.col("offset") + i))
    x = F.struct(bind(F.struct("enter", "ls"), lambda x: alphas(model, x)).alias("vecs"), us.alias("us"))

    def drawn(x: Column, i: Column, following: Column | None) -> Column:
        w = [at(at(x["vecs"], i), j) for j in ks]
        return draw(w if following is None else [v + at(vector([ln(p) for p in model.a[j]]), following) for j, v in zip(ks, w, strict=True)], at(x["us"], i))

    return traced(prepared(model, blocks, like).select(*KEY, "offset", x.alias("x")), model.k, drawn)


def steps_of(rows: DataFrame, array: str, name: str) -> DataFrame:
    """seq_id, t and an element for each step of all blocks."""
    return rows.select("seq_id", "offset", F.posexplode(array).alias("_i", name)).select("seq_id", (F.col("offset") + F.col("_i")).alias("t"), name)


# ---- scalar Kalman filters -------------------------------------------------------------------------

FIVE = ("a", "b", "c", "e", "j")


def five(*xs) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).alias(n) for n, x in zip(FIVE, xs, strict=True)])


def composed(x: Column, y: Column) -> Column:
    """x, then y.  A map takes the predicted N(m, p) to the posterior N(a (m + p e) / d + b, a a p / d + c), d = 1 + p j."""
    d = 1 + x["c"] * y["j"]
    return five(y["a"] * x["a"] / d, y["a"] * (x["b"] + x["c"] * y["e"]) / d + y["b"], y["a"] * y["a"] * x["c"] / d + y["c"], x["a"] * (y["e"] - y["j"] * x["b"]) / d + x["e"], x["a"] * x["a"] * y["j"] / d + x["j"])


def kalman_entering(model: LDS1, blocks: DataFrame, a: Column | None = None) -> DataFrame:
    """seq_id, block, offset, m, v (predicted for the block's first step), next_a and next_u (into the next block; null for the last).

    blocks: seq_id, block, steps as in :func:`stemma.operators.chain.kalman_filter`.
    """

    def measured(x: Column) -> Column:
        seen = F.filter(x["ys"], lambda y: y.isNotNull())
        return five(1, 0, 0, F.aggregate(seen, F.lit(0.0), lambda s, y: s + y) * (model.c / model.r), F.size(seen) * (model.c * model.c / model.r))

    into = lambda x: five(factor_of(model, a, x), F.coalesce(x["u"], F.lit(0.0)), model.q, 0, 0)
    step = lambda x: bind(F.struct(into(x).alias("p"), measured(x).alias("m")), lambda s: composed(s["p"], s["m"]))
    fold = lambda steps: F.aggregate(rest(steps), measured(at(steps, 0)), lambda acc, x: bind(step(x), lambda s: composed(acc, s)))
    first = lambda steps: F.struct(factor_of(model, a, at(steps, 0)).alias("a"), F.coalesce(at(steps, 0)["u"], F.lit(0.0)).alias("u"))
    folded = blocks.select(*KEY, F.size("steps").cast("long").alias("n"), bind(F.col("steps"), first).alias("first"), bind(F.col("steps"), fold).alias("map"))

    def chained(bs: Column) -> Column:
        def through(s: Column, i: Column) -> Column:
            """Prediction for block i + 1 from that for block i."""
            x, nxt = at(bs, i)["map"], at(bs, i + 1)["first"]
            d = 1 + s["v"] * x["j"]
            m, v = x["a"] * (s["m"] + s["v"] * x["e"]) / d + x["b"], x["a"] * x["a"] * s["v"] / d + x["c"]
            return F.struct((s["t"] + at(bs, i)["n"]).alias("t"), (nxt["a"] * m + nxt["u"]).alias("m"), (nxt["a"] * nxt["a"] * v + model.q).alias("v"))

        start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(model.m0).alias("m"), F.lit(model.v0).alias("v"))
        inner = F.when(F.size(bs) > 1, F.sequence(F.lit(0), F.size(bs) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(scan(inner, start, through), lambda s, i: F.struct(at(bs, i)["block"].alias("block"), s["t"].alias("offset"), s["m"].alias("m"), s["v"].alias("v"), at(bs, i + 1)["first"]["a"].alias("next_a"), at(bs, i + 1)["first"]["u"].alias("next_u")))

    return listed(folded, "n", "first", "map").select("seq_id", F.explode(bind(F.col("bs"), chained)).alias("b")).select("seq_id", "b.*")


def kalman_filtered(model: LDS1, blocks: DataFrame, a: Column | None = None) -> DataFrame:
    """seq_id, block, offset, f (array of struct(m, v, l), l from the block's start), steps, next_a, next_u."""
    joined = blocks.join(kalman_entering(model, blocks, a), KEY)
    fill = lambda x: kalman_filter(x["steps"], model, a, (x["m"], x["v"]))
    return joined.select(*KEY, "offset", bind(F.struct("steps", "m", "v"), fill).alias("f"), "steps", "next_a", "next_u")


def kalman_log_marginal(model: LDS1, blocks: DataFrame, a: Column | None = None) -> DataFrame:
    return kalman_filtered(model, blocks, a).select("seq_id", F.element_at("f", -1)["l"].alias("l")).groupBy("seq_id").agg(F.sum("l").alias("logz"))


def kalman_smoothed(model: LDS1, blocks: DataFrame, a: Column | None = None) -> DataFrame:
    """seq_id, block, offset, s: array of smoothed struct(m, v, c), c the covariance with the next step (0 for the last).

    Going back over a block is affine in what follows it: mean g m + h, variance g g v + k.
    """
    filtered = staged(kalman_filtered(model, blocks, a), "filtered")
    affine = lambda g, h, k: F.struct(g.alias("g"), h.alias("h"), k.alias("k"))

    def one(f: Column, a_: Column, u: Column) -> Column:
        """The map of one step, that leads to the next by a_ and u."""
        p = a_ * a_ * f["v"] + model.q
        return bind(f["v"] * a_ / p, lambda g: affine(g, f["m"] - g * (a_ * f["m"] + F.coalesce(u, F.lit(0.0))), f["v"] - g * g * p))

    def fold(x: Column) -> Column:
        n = F.size(x["f"])
        last = at(x["f"], n - 1)
        end = F.when(x["next_a"].isNull(), affine(F.lit(0.0), last["m"], last["v"])).otherwise(one(last, x["next_a"], x["next_u"]))
        before = lambda acc, i: bind(one(at(x["f"], i), factor_of(model, a, at(x["steps"], i + 1)), at(x["steps"], i + 1)["u"]), lambda s: affine(s["g"] * acc["g"], s["g"] * acc["h"] + s["h"], s["g"] * s["g"] * acc["k"] + s["k"]))
        return F.aggregate(backwards(n), end, before)

    folded = filtered.select(*KEY, bind(F.struct("f", "steps", "next_a", "next_u"), fold).alias("map"))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))

    def chained(bs: Column) -> Column:
        through = lambda s, b: F.struct((b["map"]["g"] * s["m"] + b["map"]["h"]).alias("m"), (b["map"]["g"] * b["map"]["g"] * s["v"] + b["map"]["k"]).alias("v"))
        follows = F.reverse(scan(F.reverse(rest(bs)), zero, through))
        return F.zip_with(bs, follows, lambda b, s: F.struct(b["block"].alias("block"), s.alias("follows")))

    into = listed(folded, "map").select("seq_id", F.explode(bind(F.col("bs"), chained)).alias("b")).select("seq_id", "b.*")

    def fill(x: Column) -> Column:
        n = F.size(x["f"])
        last = at(x["f"], n - 1)
        end = F.when(x["next_a"].isNull(), F.struct(last["m"].alias("m"), last["v"].alias("v"), F.lit(0.0).alias("c"))).otherwise(smoothed_step(model, last, x["follows"], x["next_a"], x["next_u"]))
        return F.reverse(scan(backwards(n), end, lambda s, i: smoothed_step(model, at(x["f"], i), s, factor_of(model, a, at(x["steps"], i + 1)), at(x["steps"], i + 1)["u"])))

    return filtered.join(into, KEY).select(*KEY, "offset", bind(F.struct("f", "steps", "next_a", "next_u", "follows"), fill).alias("s"))
