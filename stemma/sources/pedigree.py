"""Pedigree files: doubly encoded JSON, a header and one object per person, decoded with Spark's own functions.

Nothing is parsed on the driver; files that don't decode come back in a table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "array<map<string,string>>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file, study_id and raw (array of string maps, the header first) of each file; raw is null for bad ones."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    # the outer encoding is a JSON string: read it as the only element of an array
    inner = F.from_json(F.concat(F.lit("["), F.trim("value"), F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})[0]
    raw = files.select("file", F.from_json(inner, RAW, {"mode": "PERMISSIVE"}).alias("raw"))
    return raw.withColumn("study_id", F.try_element_at(F.try_element_at("raw", F.lit(1)), F.lit("pedigreeId")))


def invalid(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("study_id").isNull()).select("file")


def headers(scanned: DataFrame) -> DataFrame:
    """study_id, ethnicity1, ethnicity2, inheritance_pattern, other."""
    h = F.col("raw")[0]
    get = lambda k: F.try_element_at(h, F.lit(k))
    return scanned.filter(F.col("study_id").isNotNull()).select("study_id", get("ethnicity1").alias("ethnicity1"), get("ethnicity2").alias("ethnicity2"), get("inheritancePattern").alias("inheritance_pattern"), get("other").alias("other"))


# ---- attribute decoders --------------------------------------------------------------------------


def sex_of(shape: Column) -> Column:
    return F.when(shape == "square", "male").when(shape == "circle", "female").when(shape == "diamond", "unknown")


def id_list(text: Column) -> Column:
    """"a,b" to array<long>; blanks are skipped."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("long") if hasattr(Column, "try_cast") else F.trim(x).cast("long"))


def mate_kids_of(text: Column) -> Column:
    """"[id:k,k~id:k]" to array<struct<mate, kids>>."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[|\]$", ""), "~"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("long").alias("mate"), id_list(F.when(F.instr(x, ":") > 0, F.substring_index(x, ":", -1))).alias("kids")))


def diagnoses_of(text: Column) -> Column:
    """"a,b~~c,d" to array<array<string>>."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "~~"), lambda x: x != ""), lambda x: F.split(x, ","))


def age_of(text: Column) -> Column:
    """The first number of a free text; a decade such as "30s" is its middle; none is -1."""
    t = F.coalesce(text, F.lit(""))
    number = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(number.isNull(), -1.0).otherwise(number + F.when(F.regexp_extract(t, r"\d+(?:\.\d+)?([A-Za-z])", 1) != "", 5.0).otherwise(0.0))


def people(scanned: DataFrame) -> DataFrame:
    """One row per person; affected means sharing the proband's disease."""
    rows = scanned.filter(F.col("study_id").isNotNull()).select("study_id", F.posexplode(F.slice("raw", F.lit(2), F.size("raw"))).alias("pos", "p"))
    get = lambda k: F.try_element_at(F.col("p"), F.lit(k))
    out = rows.select(
        "study_id", get("Id").try_cast("long").alias("id"), sex_of(get("shapeName")).alias("sex"), id_list(get("parents")).alias("parents"), mate_kids_of(get("mateKids")).alias("mate_kids"),
        diagnoses_of(get("diagnosis")).alias("diagnoses"), age_of(get("ageAtVisit")).alias("age"), F.coalesce(get("carrier") == "true", F.lit(False)).alias("carrier"), F.coalesce(get("proband") == "true", F.lit(False)).alias("proband"), F.coalesce(get("other"), F.lit("")).alias("other_info"),
    )
    proband = out.filter("proband").groupBy("study_id").agg(F.flatten(F.collect_list(F.transform("diagnoses", lambda d: d[0]))).alias("_diseases"))
    return out.join(proband, "study_id", "left").withColumn("affected", F.coalesce(F.arrays_overlap(F.transform("diagnoses", lambda d: d[0]), F.col("_diseases")), F.lit(False))).drop("_diseases")


def with_implied(persons: DataFrame) -> DataFrame:
    """Adds the parents that are only mentioned (negative ids), with the sex opposite to their mate's.

    Of two implied parents the lower id is female and the other male.
    """
    p = persons.select("study_id", "id", "sex")
    couples = persons.filter(F.size("parents") == 2).select("study_id", F.sort_array("parents").alias("c")).distinct()
    missing = couples.select("study_id", F.posexplode("c").alias("place", "id"), "c").join(p.select("study_id", "id"), ["study_id", "id"], "left_anti")
    mate = missing.withColumn("mate", F.when(F.col("place") == 0, F.col("c")[1]).otherwise(F.col("c")[0]))
    known = p.select("study_id", F.col("id").alias("mate"), F.col("sex").alias("mate_sex"))
    sexed = mate.join(known, ["study_id", "mate"], "left")
    sex = F.when(F.col("mate_sex").isNull(), F.when(F.col("place") == 0, "female").otherwise("male")).when(F.col("mate_sex") == "female", "male").otherwise("female")
    kids = persons.filter(F.size("parents") == 2).select("study_id", F.sort_array("parents").alias("c"), F.col("id").alias("kid")).groupBy("study_id", "c").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
    own = sexed.withColumn("sex", sex).join(kids, ["study_id", "c"]).groupBy("study_id", "id").agg(F.min("sex").alias("sex"), F.collect_list(F.struct("mate", "kids")).alias("mate_kids"))
    return persons.unionByName(own.withColumns({"affected": F.lit(False), "carrier": F.lit(False), "proband": F.lit(False), "age": F.lit(-1.0), "other_info": F.lit("")}), allowMissingColumns=True)


SEX_ORDER = {"female": 0, "male": 1, "unknown": 2}


def hyperedges(persons: DataFrame) -> DataFrame:
    """edges(graph_id = study_id, edge, role, node, ord): one per couple, parents ordered female, male, unknown."""
    rank = F.when(F.col("sex") == "female", 0).when(F.col("sex") == "male", 1).otherwise(2)
    link = persons.select("study_id", "id", F.explode("mate_kids").alias("m")).select("study_id", "id", F.col("m.mate").alias("mate"), F.col("m.kids").alias("kids"))
    couple = link.select("study_id", F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b"), F.explode("kids").alias("kid")).distinct()
    from pyspark.sql import Window

    numbered = couple.withColumn("edge", (F.dense_rank().over(Window.partitionBy("study_id").orderBy("a", "b")) - 1).cast("long"))
    sexes = persons.select("study_id", F.col("id").alias("node"), rank.alias("r"))
    ps = numbered.select("study_id", "edge", F.explode(F.array("a", "b")).alias("node")).distinct().join(sexes, ["study_id", "node"], "left")
    ps = ps.withColumn("ord", (F.row_number().over(Window.partitionBy("study_id", "edge").orderBy("r", "node")) - 1).cast("long")).select("study_id", "edge", F.lit("p").alias("role"), "node", "ord")
    cs = numbered.withColumn("ord", (F.row_number().over(Window.partitionBy("study_id", "edge").orderBy("kid")) - 1).cast("long")).select("study_id", "edge", F.lit("c").alias("role"), F.col("kid").alias("node"), "ord")
    return ps.unionByName(cs)


def has_affected(persons: DataFrame) -> DataFrame:
    """study_id of pedigrees with an affected person; the others are refused."""
    return persons.groupBy("study_id").agg(F.max("affected").alias("a")).filter("a").select("study_id")


# ---- ethnicity and keywords ----------------------------------------------------------------------

# Keywords looked for in the free text of a person.
KEYWORDS = ("retina", "blind", "affected", "mac", "glaucoma", "vision", "see", "cataract", "eye")
REGIONS = ("african", "asia", "central america", "china", "europe", "india", "middle east", "north america", "russia")


def keyword_vector(text: Column, keywords=KEYWORDS) -> Column:
    return F.array(*[F.when(F.instr(F.lower(F.coalesce(text, F.lit(""))), k) > 0, 1.0).otherwise(0.0) for k in keywords])


def ethnicities(text: Column) -> Column:
    """The names in a free text, lower case, letters only: parted by strokes, commas, semicolons, plus and ampersand signs or the word "and"."""
    named = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[/,;+&]|\band\b")
    return F.filter(F.transform(named, lambda x: F.regexp_replace(x, r"[^\p{L}]+", "")), lambda x: F.length(x) > 0)


def regions(names: Column, spelling: dict[str, str], region_of: dict[str, str]) -> Column:
    """Normalised names to world regions by two lookup tables (given by the user), each region once."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map(F.lit(""), F.lit(""))
    fixed = F.transform(names, lambda x: F.coalesce(F.try_element_at(lookup(spelling), x), x))
    return F.array_sort(F.array_distinct(F.filter(F.transform(fixed, lambda x: F.try_element_at(lookup(region_of), x)), lambda x: x.isNotNull())))


# ---- answers -------------------------------------------------------------------------------------


def labelled_answers(spark: SparkSession, answers_csv: str, labels_csv: str) -> DataFrame:
    """Answers joined to their inheritance pattern by patient, complete rows of the three patterns; label 0, 1, 2."""
    a = spark.read.csv(answers_csv, header=True)
    b = spark.read.csv(labels_csv, header=True).select("Patient ID", "Inheritance Pattern").withColumnRenamed("Inheritance Pattern", "pattern")
    joined = a.join(b, "Patient ID", "left").na.drop().filter(F.col("pattern").isin("AD", "AR", "XL"))
    bools = [F.when(F.lower(F.col(f"`{c}`")) == "true", "1").when(F.lower(F.col(f"`{c}`")) == "false", "0").otherwise(F.col(f"`{c}`")).alias(c) for c in a.columns]
    return joined.select(*bools, "pattern").withColumn("label", F.when(F.col("pattern") == "AD", 0).when(F.col("pattern") == "AR", 1).otherwise(2))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
