"""Queries of the pedigree domain: Mendelian tables, evidence, model comparison, text decoders; and the online filter."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from stemma.functions import mendel
from stemma.functions.special import uniform, uniform_sql
from stemma.operators import evaluation, learning, local
from stemma.operators.factors import cells
from stemma.plans.chains import ctes
from stemma.plans.registry import longs, query, r, table
from stemma.sources import corpus, pedigree
from stemma.sources.scratch import shared_dir, staged

#: Parts of the cross-validation.
FOLDS = 3

# ---- Mendelian tables -----------------------------------------------------------------------------

TABLES = {"autosomal": mendel.autosomal_cpt, "x_female": mendel.x_female_cpt, "x_male": mendel.x_male_cpt, "x_unknown": mendel.x_unknown_cpt}

GAMETES = """with two(state, a, p) as (values (0, 1, 1.0), (1, 1, 0.5), (1, 0, 0.5), (2, 0, 1.0)), one(state, a) as (values (0, 1), (1, 0)),
  auto as (select m.state as x_p1, f.state as x_p2, 2 - m.a - f.a as x_c, sum(m.p * f.p) as p from two m, two f group by 1, 2, 3),
  fem as (select m.state as x_p1, f.state as x_p2, 2 - m.a - f.a as x_c, sum(m.p) as p from two m, one f group by 1, 2, 3),
  mal as (select m.state as x_p1, f.state as x_p2, 1 - m.a as x_c, sum(m.p) as p from two m, one f group by 1, 2, 3)
select name, x_p1::bigint as x_p1, x_p2::bigint as x_p2, x_c::bigint as x_c, p::double as p from (
  select 'autosomal' as name, * from auto union all select 'x_female', * from fem union all select 'x_male', * from mal
  union all select 'x_unknown', x_p1, x_p2, x_c, p / 2 from fem union all select 'x_unknown', x_p1, x_p2, 3 + x_c, p / 2 from mal)"""


@query(GAMETES)
def mendel_cpts(spark, d):
    rows = [(name, *c, p) for name, f in TABLES.items() for c, p in cells(f())]
    return spark.createDataFrame(rows, "name string, x_p1 long, x_p2 long, x_c long, p double")


# ---- pedigrees made of the driver's tables --------------------------------------------------------

FAMILY = "0,1>4 ; 2,3>5 ; 4,5>6,7"
SEX = {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0, 7: 1}
DRAWN = "(select n_nationkey::bigint as graph_id, node::bigint as node, (node % 2)::bigint as grp, {aff} < 0.3 as affected, {car} < 0.1 as carrier from nation, range(8) t(node))".format(aff=uniform_sql("'sick'", "n_nationkey", "node"), car=uniform_sql("'carrier'", "n_nationkey", "node"))


def people(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("graph_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("node"))
    flag = lambda name, p: uniform(F.lit(name), F.col("graph_id"), F.col("node")) < p
    return nodes.select("graph_id", "node", (F.col("node") % 2).alias("grp"), flag("sick", 0.3).alias("affected"), flag("carrier", 0.1).alias("carrier"))


def evidence_rows(spark, d):
    """graph_id, pattern, node, grp, affected, states (null: all), one row per person and hypothesis."""
    p = people(spark, d)
    root = F.col("node") < 4
    shaded = p.filter(root).groupBy("graph_id").agg(F.max("affected").alias("shaded"))
    hyp = p.join(shaded, "graph_id").withColumn("pattern", F.explode(F.array(*map(F.lit, mendel.PATTERNS))))
    group = F.when(F.col("pattern") == "XL", F.col("grp")).otherwise(0)
    return hyp.withColumn("grp", group.cast("long")).withColumn("states", mendel.evidence(F.col("pattern"), F.col("grp"), F.col("affected"), F.col("carrier"), root, F.col("shaded")))


EVIDENCE = f"""with p as (select * from {DRAWN}), s as (select graph_id, bool_or(affected) as shaded from p where node < 4 group by 1),
  h as (select p.graph_id, pattern, node, case when pattern = 'XL' then grp else 0 end as g, affected, carrier, shaded and node < 4 and not affected as freed from p join s using (graph_id), (values ('AD'), ('AR'), ('XL')) t(pattern))
  select graph_id, pattern, node, case when freed then (case when g = 1 then '1' else '2' end) when carrier then (case when g = 1 then '0' else '1' end) when affected then (case when pattern = 'AD' then '1' else '0' end) else 'all' end as states from h"""


@query(EVIDENCE)
def pedigree_evidence(spark, d):
    """Allowed states of every person under each hypothesis; the later rule wins."""
    e = evidence_rows(spark, d)
    return e.select("graph_id", "pattern", "node", F.coalesce(F.array_join("states", ","), F.lit("all")).alias("states"))


def hypotheses(spark, d):
    """Packed graphs, one for each pedigree and pattern: graph_id is pedigree * 3 + pattern."""
    e = evidence_rows(spark, d).withColumn("gid", F.col("graph_id") * 3 + F.array_position(F.array(*map(F.lit, mendel.PATTERNS)), F.col("pattern")) - 1)
    nodes = e.select(F.col("gid").alias("graph_id"), "node", "grp")
    obs = e.select(F.col("gid").alias("graph_id"), "node", F.lit(0).cast("long").alias("m"), F.col("affected").cast("long").alias("y"))
    allowed = e.filter("states is not null").select(F.col("gid").alias("graph_id"), "node", F.explode(F.col("states").cast("array<bigint>")).alias("state"))
    cell = F.array(*[F.struct(F.lit(x).cast("long").alias("edge"), F.lit(role).alias("role"), F.lit(n).cast("long").alias("node"), F.lit(o).cast("long").alias("ord")) for x, role, n, o in corpus.incidence(FAMILY)])
    edges = nodes.select("graph_id").distinct().select("graph_id", F.explode(cell).alias("c")).select("graph_id", "c.*")
    return corpus.pack(edges, obs, nodes, allowed)


#: Tables between the Mendelian ones and ignorance, so every hypothesis keeps some probability.
MEANS = {p: mendel.means(mendel.priors(p, 20.0, 3.0)) for p in mendel.PATTERNS}


def comparison_sql() -> str:
    """ln P(Y, evidence) of every pedigree and hypothesis by enumeration over the eight people."""
    parts = []
    for k, pattern in enumerate(mendel.PATTERNS):
        m = MEANS[pattern]
        g = lambda n, xl=pattern == "XL": SEX[n] if xl else 0
        sizes = {n: len(m.emission[g(n)]) for n in range(8)}
        terms = [f"ln(({m.prior[g(n)]!r})[x{n} + 1])" for n in range(4)]
        terms += [f"ln(({m.cpt[(g(a), g(b), g(c))]!r})[x{a} + 1][x{b} + 1][x{c} + 1])" for a, b, c in ((0, 1, 4), (2, 3, 5), (4, 5, 6), (4, 5, 7))]
        terms += [f"ln(({m.emission[g(n)]!r})[x{n} + 1][y{n} + 1])" for n in range(8)]
        ok = " and ".join(f"(e{n} = 'all' or list_contains(string_split(e{n}, ','), x{n}::varchar))" for n in range(8))
        parts.append(f"select graph_id, '{pattern}' as hypothesis, {' + '.join(terms)} as w from wide, {', '.join(f'range({sizes[n]}) r{n}(x{n})' for n in range(8))} where pattern = '{pattern}' and {ok}")
    wide = ", ".join(f"max(case when node = {n} then states end) as e{n}, max(case when node = {n} then y end) as y{n}" for n in range(8))
    return f"with ev as ({EVIDENCE}), wide as (select graph_id, pattern, {wide} from (select ev.*, affected::bigint as y from ev join {DRAWN} d using (graph_id, node)) group by 1, 2), j as ({' union all '.join(parts)}), z as (select graph_id, hypothesis, ln(sum(exp(w))) as z from j group by 1, 2)"


def log_marginals(spark, d):
    packed = hypotheses(spark, d)

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[:1], "logz": [local.graph_of(pdf, MEANS[mendel.PATTERNS[int(pdf["graph_id"].iloc[0]) % 3]]).log_marginal()]})

    z = local.per_graph(packed, run, "graph_id long, logz double")
    return z.select(F.floor(F.col("graph_id") / 3).alias("pedigree"), F.get(F.array(*map(F.lit, mendel.PATTERNS)), (F.col("graph_id") % 3).cast("int")).alias("hypothesis"), "logz")


@query(f"{comparison_sql()} select graph_id as pedigree, hypothesis, round(exp(z) / sum(exp(z)) over (partition by graph_id), 6) as p, (row_number() over (partition by graph_id order by z desc, hypothesis) = 1)::bigint as is_best from z")
def inheritance_comparison(spark, d):
    """Posterior of the inheritance pattern of each pedigree."""
    c = evaluation.compare_models(log_marginals(spark, d), ["pedigree"], "hypothesis")
    return c.select("pedigree", "hypothesis", r("p").alias("p"), "is_best")


#: Chance of passing the allele on, by state: two alleles, one, none; a male's only one on the X chromosome, or none.
PASSES = {"two": (1.0, 0.5, 0.0), "male": (1.0, 0.0)}


def joint_terms(m, g) -> str:
    """ln of the joint weight of the family in ``wide``, from tables m and each person's group g(n)."""
    terms = [f"ln(({m.prior[g(n)]!r})[x{n} + 1])" for n in range(4)]
    terms += [f"ln(({m.cpt[(g(a), g(b), g(c))]!r})[x{a} + 1][x{b} + 1][x{c} + 1])" for a, b, c in ((0, 1, 4), (2, 3, 5), (4, 5, 6), (4, 5, 7))]
    return " + ".join(terms + [f"ln(({m.emission[g(n)]!r})[x{n} + 1][y{n} + 1])" for n in range(8)])


FITS = " and ".join(f"(e{n} = 'all' or list_contains(string_split(e{n}, ','), x{n}::varchar))" for n in range(8))


def wide_sql() -> str:
    """CTEs up to ``wide``: evidence and observations of each family and hypothesis in one row."""
    base = comparison_sql()
    return base[: base.index(", j as (")]


def carrier_sql() -> str:
    """Chance of passing the allele on, from the enumerated joints of the recessive and the X-linked hypothesis."""
    ctes, parts = [], []
    for pattern in ("AR", "XL"):
        m, g = MEANS[pattern], (lambda n, xl=pattern == "XL": SEX[n] if xl else 0)
        states = ", ".join(f"range({len(m.emission[g(n)])}) r{n}(x{n})" for n in range(8))
        ctes.append(f"j{pattern} as materialized (select graph_id, {', '.join(f'x{n}' for n in range(8))}, exp({joint_terms(m, g)}) as v from wide, {states} where pattern = '{pattern}' and {FITS})")
        for n in range(8):
            passes = PASSES["male" if pattern == "XL" and SEX[n] else "two"]
            parts.append(f"select graph_id as pedigree, '{pattern}' as hypothesis, {n}::bigint as node, round(sum(v * ({list(passes)!r})[x{n} + 1]) / sum(v), 6) + 0.0 as p from j{pattern} group by 1")
    return f"{wide_sql()}, {', '.join(ctes)} " + " union all ".join(parts)


@query(carrier_sql())
def carrier_probability(spark, d):
    """Chance of every person to pass the allele on, by their sex, under the recessive and the X-linked hypothesis."""
    out = None
    for k, pattern in enumerate(mendel.PATTERNS):
        if pattern == "AD":
            continue
        packed = hypotheses(spark, d).filter(F.col("graph_id") % 3 == k)
        post = local.posteriors(packed, MEANS[pattern]).filter("kind = 'node'")
        wide = post.groupBy(F.floor(F.col("graph_id") / 3).alias("pedigree"), "node").agg(F.array(*[F.coalesce(F.max(F.when(F.col("state") == k, F.col("value"))), F.lit(0.0)) for k in range(3)]).alias("p"))
        sex = F.when(F.col("node") % 2 == 1, "male").otherwise("female")
        own = wide.select("pedigree", F.lit(pattern).alias("hypothesis"), "node", r(mendel.carrier_probability(sex, F.col("p"), F.lit(pattern))).alias("p"))
        out = own if out is None else out.unionByName(own)
    return out


DRAWS = learning.prior_draws(mendel.priors("AR", 20.0, 3.0), 8, seed=4)


def prior_mc_sql() -> str:
    """The mean over the draws (fixed tables) of P(Y | draw), each by enumeration."""
    states = ", ".join(f"range(3) r{n}(x{n})" for n in range(8))
    joints = " union all ".join(f"select graph_id, {k} as draw, {joint_terms(m, lambda n: 0)} as w from wide, {states} where pattern = 'AR' and {FITS}" for k, m in enumerate(DRAWS))
    return f"{wide_sql()}, j as ({joints}), z as (select graph_id, draw, sum(exp(w)) as p from j group by 1, 2) select graph_id as pedigree, round(ln(avg(p)), 6) as log_marginal from z group by 1"


@query(prior_mc_sql())
def prior_mc_marginal(spark, d):
    """ln of the mean of P(Y | draw) over eight draws of the recessive prior, for each pedigree."""
    from stemma.functions.special import lse_agg

    z = learning.log_marginals(hypotheses(spark, d).filter("graph_id % 3 = 1"), DRAWS)
    return z.groupBy(F.floor(F.col("graph_id") / 3).alias("pedigree")).agg(r(lse_agg("logz") - F.ln(F.count("*"))).alias("log_marginal"))


GENERATED = 3


@query(
    f"""with g as (select n_nationkey::bigint as graph_id, e, 1 + floor({uniform_sql("9", 'n_nationkey', 'e')} * {GENERATED}) as kids from nation, range(3) t(e))
    select graph_id, count(*) as n_edges, sum(kids)::bigint as n_children from g group by 1"""
)
def pedigree_generate(spark, d):
    """Random pedigrees of three generations; couples and children of each."""
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("graph_id"))
    e = ids.select("graph_id", F.explode(evaluation.generate_pedigree(3, GENERATED, 9, F.col("graph_id"))).alias("c")).select("graph_id", "c.*")
    return e.groupBy("graph_id").agg(F.count_distinct("edge").alias("n_edges"), F.sum((F.col("role") == "c").cast("long")).alias("n_children"))


# ---- pedigree files -------------------------------------------------------------------------------

# A made-up family: an affected proband, parents who are only mentioned for one of them, a half-sibling.
PERSONS = [
    {"Id": "1", "shapeName": "circle", "parents": "", "mateKids": "[2:3,4]", "diagnosis": "", "ageAtVisit": "61", "other": "good vision"},
    {"Id": "2", "shapeName": "square", "parents": "", "mateKids": "[1:3,4~9:8]", "diagnosis": "D1,x,y,false", "ageAtVisit": "60s", "other": "cataract, eye"},
    {"Id": "3", "shapeName": "square", "parents": "1,2", "mateKids": "[5:6]", "diagnosis": "D1,x,y,false", "ageAtVisit": "35.5 years", "proband": "true"},
    {"Id": "4", "shapeName": "diamond", "parents": "1,2", "mateKids": "[]", "diagnosis": "D2,x,y,false", "ageAtVisit": ""},
    {"Id": "5", "shapeName": "circle", "parents": "-7,-6", "mateKids": "[3:6]", "diagnosis": "", "ageAtVisit": "30s", "carrier": "true"},
    {"Id": "6", "shapeName": "circle", "parents": "5,3", "mateKids": "[]", "diagnosis": "D1,x,y,false~~D3,u,v,true", "ageAtVisit": "5"},
    {"Id": "8", "shapeName": "square", "parents": "2,9", "mateKids": "[]", "diagnosis": "", "ageAtVisit": "?"},
    {"Id": "9", "shapeName": "circle", "parents": "", "mateKids": "[2:8]", "diagnosis": "", "ageAtVisit": "50-55"},
]
HEADER = {"pedigreeId": "S1", "ethnicity1": "A/B", "ethnicity2": "", "inheritancePattern": "AR", "other": ""}


def family_files(spark):
    """A folder with one good doubly encoded file and one bad one, written and then read by Spark."""
    good = json.dumps(json.dumps([HEADER, *PERSONS]))
    path = f"{shared_dir(spark)}/pedigree-sample"
    spark.createDataFrame([(good,), ("not json",)], "value string").repartition(2).write.mode("overwrite").text(path)
    return pedigree.scan(spark, path)


VALUES = ", ".join("(" + ", ".join(f"'{p.get(k, '')}'" for k in ("Id", "shapeName", "parents", "mateKids", "diagnosis", "ageAtVisit", "carrier", "other")) + ")" for p in PERSONS)
PEOPLE_SQL = f"""with raw(id, shape, parents, mates, diagnosis, age, carrier, other) as (values {VALUES}), p as (select id::bigint as id, case shape when 'square' then 'male' when 'circle' then 'female' else 'unknown' end as sex,
    case when regexp_extract(age, '([0-9]+([.][0-9]+)?)', 1) = '' then -1.0 else regexp_extract(age, '([0-9]+([.][0-9]+)?)', 1)::double + case when regexp_matches(age, '[0-9][A-Za-z]') then 5 else 0 end end as age,
    (position('D1,' in diagnosis) > 0)::bigint as affected, (carrier = 'true')::bigint as carrier from raw)"""


@query(f"{PEOPLE_SQL} select 'S1' as study_id, id, sex, age, affected, carrier from p union all select 'S1', -7, 'female', -1.0, 0, 0 union all select 'S1', -6, 'male', -1.0, 0, 0")
def pedigree_people(spark, d):
    """People of the sample files, parents that are only mentioned included."""
    p = pedigree.with_implied(pedigree.people(family_files(spark)))
    return longs(p.select("study_id", "id", "sex", "age", "affected", "carrier"), "affected", "carrier")


@query("select * from (values (0::bigint, 'p', -7::bigint, 0::bigint), (0, 'p', -6, 1), (0, 'c', 5, 0), (1, 'p', 1, 0), (1, 'p', 2, 1), (1, 'c', 3, 0), (1, 'c', 4, 1), (2, 'p', 9, 0), (2, 'p', 2, 1), (2, 'c', 8, 0), (3, 'p', 5, 0), (3, 'p', 3, 1), (3, 'c', 6, 0)) t(edge, role, node, ord)")
def pedigree_to_edges(spark, d):
    """One hyperedge per couple, parents ordered female, male, unknown."""
    e = pedigree.hyperedges(pedigree.with_implied(pedigree.people(family_files(spark))))
    return e.select("edge", "role", "node", "ord")


@query("select 1::bigint as n_invalid, 'AR' as inheritance_pattern, 'A/B' as ethnicity1")
def pedigree_headers(spark, d):
    files = family_files(spark)
    n = pedigree.invalid(files).agg(F.count("*").alias("n_invalid"))
    return n.crossJoin(pedigree.headers(files).select("inheritance_pattern", "ethnicity1"))


ANSWERS = [("p1", "true", "2", "AD"), ("p2", "FALSE", "0", "AR"), ("p3", "False", "1", "XL"), ("p4", "true", "3", "other"), ("p5", None, "1", "AD"), ("p6", "true", "4", None)]
COMPLETE = [a for a in ANSWERS if None not in a and a[3] in mendel.PATTERNS]


@query("select * from (values " + ", ".join(f"('{i}', '{int(b.lower() == 'true')}', '{n}', '{p}', {mendel.PATTERNS.index(p)})" for i, b, n, p in COMPLETE) + ") t(id, skipping, n_affected, pattern, label)")
def csv_label_join(spark, d):
    """Answers and labels written as CSV by the sink, read back, joined by patient; complete rows of the three patterns."""
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(i, b, n) for i, b, n, _ in ANSWERS], "`Patient ID` string, skipping string, n_affected string")
    pedigree.write_csv(rows, f"{folder}/answers")
    pedigree.write_csv(spark.createDataFrame([(i, p) for i, *_, p in ANSWERS if p], "`Patient ID` string, `Inheritance Pattern` string"), f"{folder}/labels")
    got = pedigree.labelled_answers(spark, f"{folder}/answers", f"{folder}/labels")
    return got.select(F.col("Patient ID").alias("id"), "skipping", "n_affected", "pattern", F.col("label").cast("int").alias("label"))


@query("select doc_id, " + ", ".join(f"(contains(lower(text), '{k}'))::bigint as has_{k}" for k in pedigree.KEYWORDS) + " from documents")
def keyword_vector(spark, d):
    """Which keywords occur in each whole text."""
    v = table(spark, d, "documents").select("doc_id", pedigree.keyword_vector(F.col("text")).alias("v"))
    return v.select("doc_id", *[F.get("v", F.lit(i)).cast("long").alias(f"has_{k}") for i, k in enumerate(pedigree.KEYWORDS)])


SPELLING, REGION = {"scotch": "scottish"}, {"scottish": "europe", "german": "europe", "chinese": "china"}


@query("select n_nationkey::bigint as id, case when n_nationkey % 2 = 0 then 'china,europe' else 'europe' end as regions from nation")
def ethnicity_regions(spark, d):
    """Free-text ethnicities to regions by lookup tables."""
    text = F.when(F.col("n_nationkey") % 2 == 0, "Scotch / Chi-nese./ other").otherwise("German and SCOTCH")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array_join(pedigree.regions(pedigree.ethnicities(text), SPELLING, REGION), ",").alias("regions"))


@query("select l_returnflag as truth, count(*) as n, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as n_f, round(avg(case when l_linestatus = 'F' then 1.0 else 0.0 end), 9) as share_f from lineitem group by 1")
def group_features(spark, d):
    """Features of a group for a classifier: counts and shares by an attribute."""
    x = (F.col("l_linestatus") == "F").cast("long")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("truth")).agg(F.count("*").alias("n"), F.sum(x).alias("n_f"), r(F.avg(x.cast("double")), 9).alias("share_f"))


@query()
def pattern_classifier(spark, d):
    """A forest on pedigree features against the most probable pattern: accuracy by class on pedigrees of folds it didn't see."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    best = log_marginals(spark, d).groupBy("pedigree").agg(F.max_by("hypothesis", "logz").alias("best"))
    p = people(spark, d).groupBy(F.col("graph_id").alias("pedigree")).agg(F.sum(F.col("affected").cast("int")).alias("n"), F.sum((F.col("affected") & (F.col("grp") == 1)).cast("int")).alias("males"), F.sum((F.col("affected") & (F.col("node") < 4)).cast("int")).alias("roots"))
    rows = p.join(best, "pedigree").withColumn("label", (F.array_position(F.array(*map(F.lit, mendel.PATTERNS)), F.col("best")) - 1).cast("double"))
    data = staged(evaluation.folds(rows, "pedigree", FOLDS), "features")
    assembled = VectorAssembler(inputCols=["n", "males", "roots"], outputCol="features").transform(data)
    forest, out = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1), None
    for k in range(FOLDS):
        own = forest.fit(assembled.filter(F.col("fold") != k)).transform(assembled.filter(F.col("fold") == k)).select("label", "prediction")
        out = own if out is None else out.unionByName(own)
    return evaluation.class_accuracy(out, "label", "prediction").select("truth", "n", r("accuracy").alias("accuracy"))


@query(f"with recursive {ctes()} select seq_id, round(logz, 6) as log_marginal, round(logz, 6) as streamed from z")
def online_filter(spark, d):
    """The stream's final message of every user beside the batch query's log-likelihood; the stream writes to files."""
    from stemma.plans import chains
    from stemma.streaming.online import online_filter as stream_filter

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    code = F.array_position(F.array(*map(F.lit, chains.EVENTS)), F.col("event_type")) - 1
    rows = stream.select("user_id", F.col("ts").cast("timestamp").alias("at"), code.cast("int").alias("y"))
    folder = f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
    q = stream_filter(rows, chains.MODEL, "user_id", "at", "y").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("seq_id").agg(F.max_by("logz", "n").alias("streamed"))
    return chains.hmm_log_marginal(spark, d).join(last, "seq_id", "left").select("seq_id", "log_marginal", r("streamed").alias("streamed"))
