"""Preparation of training pairs the reference's way (TRN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, portable_bucket, tokens

# The vocabularies of a concept record.
TYPES = ("method", "metric", "technique", "theory", "tool", "dataset", "result", "definition")
DIFFICULTIES = ("foundational", "intermediate", "advanced", "expert")
RELATIONS = ("contrasts_with", "uses", "extends", "evaluated_by", "variant_of", "part_of")
CONCEPT = "array<struct<concept_name:string,concept_type:string,difficulty:string,summary:string,prerequisites:array<string>,unlocks:array<string>,tags:array<string>>>"
MAX_NAME_WORDS = 6


def instruction_text(instruction: Column) -> Column:
    """TRN-27: the passage after `TEXT:`, without the prompt's last line."""
    t = F.when(F.contains(instruction, F.lit("TEXT:")), F.substr(instruction, F.instr(instruction, "TEXT:") + 5)).otherwise(instruction)
    return F.regexp_replace(F.regexp_replace(t, r"\n+(?:Return ONLY the JSON array|Answer with the JSON array)[^\n]*$", ""), r"^\s+|\s+$", "")


def grounded(name: Column, text: Column) -> Column:
    """TRN-5: at least half of the name's words of three characters or more are in the text; without such words the name itself."""
    low = F.lower(text)
    ws = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    hit = F.size(F.filter(ws, lambda w: F.contains(low, w)))
    return F.when(F.size(ws) == 0, F.contains(low, F.lower(name))).otherwise(hit >= F.greatest(F.lit(1), F.floor((F.size(ws) + 1) / 2)))


def row_failures(rows: DataFrame) -> DataFrame:
    """TRN-2: (pair_id, reason): why a row fails the strict check, each reason once; rows that pass have none.

    An output that is no JSON, or no array, has only that reason.
    """
    v = F.try_parse_json("output")
    r = rows.select("pair_id", instruction_text(F.col("instruction")).alias("text"), F.contains(F.col("instruction"), F.lit("TEXT:")).alias("mark"), v.alias("v"))
    kind = F.schema_of_variant("v")
    r = r.withColumn("kind", F.when(F.col("v").isNull(), "output_not_json").when(~kind.startswith("ARRAY"), "output_not_list"))
    r = r.withColumn("cs", F.when(F.col("kind").isNull(), F.try_variant_get("v", "$", CONCEPT)))

    def per(c: Column) -> Column:
        name = F.trim(F.coalesce(c["concept_name"], F.lit("")))
        own = F.lower(name)
        return F.when(name == "", F.array(F.lit("empty_name"))).otherwise(F.filter(F.array(
            F.when(F.size(tokens(name)) > MAX_NAME_WORDS, "name_too_long"), F.when(~grounded(name, F.col("text")), "ungrounded"), F.when(~F.coalesce(c["concept_type"].isin(*TYPES), F.lit(False)), "bad_type"),
            F.when(~F.coalesce(c["difficulty"].isin(*DIFFICULTIES), F.lit(False)), "bad_difficulty"), F.when(F.length(F.trim(F.coalesce(c["summary"], F.lit("")))) < 15, "summary_too_short"),
            F.when(F.exists(F.concat(F.coalesce(c["prerequisites"], F.array().cast("array<string>")), F.coalesce(c["unlocks"], F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)) == own), "self_ref"),
        ), lambda x: x.isNotNull()))

    reasons = F.concat(
        F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.array().cast("array<string>")), F.when(~F.coalesce("mark", F.lit(False)), F.array(F.lit("instruction_missing_text"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("cs") > 5, F.array(F.lit("too_many_concepts"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform("cs", per)), F.array().cast("array<string>")),
    )
    return r.select("pair_id", F.explode(F.array_distinct(reasons)).alias("reason"))


def leak_free_split(rows: DataFrame, ratio: int = 15, seed: str = "42") -> DataFrame:
    """TRN-1: (pair_id, split): all rows of a (doc_id, chunk_id) together, `ratio` of 100 keys in test by a seeded hash."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_id", F.lit("")))
    return rows.select("pair_id", F.when(portable_bucket(key, 100) < ratio, "test").otherwise("train").alias("split"))


def pool_latest(rows: DataFrame) -> DataFrame:
    """TRN-6: one row per (doc_id, chunk_id): the one with the greatest pair_id."""
    return rows.where("doc_id is not null and chunk_id is not null").groupBy("doc_id", "chunk_id").agg(F.max("pair_id").alias("pair_id"))


def balanced(rows: DataFrame, stratum: Column, quotas: dict[str, int], seed: str = "42") -> DataFrame:
    """TRN-7, TRN-8 and WIN-14: (pair_id, stratum): at most `quotas` rows of each stratum, in the order of a seeded hash; strata without a quota stay whole.

    Rows without a quota are never ranked. For the others a histogram of the hash (4096 rows per stratum) gives the bin in which the quota is
    reached, and only rows up to that bin are ranked, so no window holds a whole stratum.
    """
    if not quotas:
        return rows.select("pair_id", stratum.alias("stratum"))
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    h = F.md5(F.concat(F.lit(seed + ":"), F.col("pair_id").cast("string")))
    r = rows.select("pair_id", stratum.alias("stratum")).withColumn("h", h).withColumn("quota", F.try_element_at(q, F.col("stratum")))
    free = r.where("quota is null").select("pair_id", "stratum")
    r = r.where("quota is not null").withColumn("bin", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    seen = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 4096 rows at most
    bins = r.groupBy("stratum", "quota", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.sum("n").over(seen))
    last = bins.where(F.col("s") - F.col("n") < F.col("quota")).groupBy("stratum").agg(F.max("bin").alias("last"))
    near = r.join(F.broadcast(last), "stratum").where("bin <= last")  # a row per quota
    w = Window.partitionBy("stratum").orderBy("h", "pair_id")  # the quota and one bin more
    return free.unionByName(near.withColumn("n", F.row_number().over(w)).where("n <= quota").select("pair_id", "stratum"))


def first_of_each(rows: DataFrame, group: str, key: str, most: int, seed: str = "42") -> DataFrame:
    """TRN-26: (group, key): of every group the `most` rows with the least seeded hashes, whatever groups there are; each task ranks within buckets of the hash
    first, so a group that holds a third of all rows is never in one window."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    r = rows.select(group, key, h.alias("h")).withColumn("b", F.substring("h", 32, 1))
    inner = Window.partitionBy(group, "b").orderBy("h", key)
    r = r.withColumn("n", F.row_number().over(inner)).where(F.col("n") <= most)
    outer = Window.partitionBy(group).orderBy("h", key)  # 16 x `most` rows
    return r.withColumn("n", F.row_number().over(outer)).where(F.col("n") <= most).select(group, key)


def oversample(rows: DataFrame, weight: Column) -> DataFrame:
    """TRN-11 and TRN-12: every row `weight` times, with the number of its copy."""
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.greatest(weight, F.lit(1)))))


def table_like(text: Column) -> Column:
    """TRN-15: at least three lines, most of them with several wide gaps, bars or numbers."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rows_ = F.filter(lines, lambda x: x.rlike(r"\t|\s{3,}\S+\s{3,}|\|.*\|| & .* & ") | (F.regexp_count(x, F.lit(r"\d+")) >= 3))
    return let(F.struct(F.size(lines).alias("n"), F.size(rows_).alias("k")), lambda s: (s["n"] >= 3) & (s["k"] * 2 > s["n"]))


def window_around(text: Column, name: Column, width: int = 500) -> Column:
    """TRN-17: the stretch of `width` characters around the first place of a name; the beginning if it isn't there."""
    at = F.call_function("instr", F.lower(text), F.lower(name))
    start = F.greatest(F.when(at > 0, at - width // 2).otherwise(F.lit(1)), F.lit(1))
    return F.substr(text, start, F.lit(width))


def eligible(text: Column, kind: Column) -> Column:
    """TRN-23: prose of 40 words or more with at least two sentences."""
    return (kind == "prose") & (F.size(tokens(text)) >= 40) & (F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) >= 2)
