"""Standards and materials as node and edge tables; a lookup is a join for a whole table of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def standards_for_material(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """ids: id; edges: id, standard."""
    return ids.join(edges.hint("merge"), "id").groupBy("id").agg(F.sort_array(F.collect_set("standard")).alias("standards"))


def material_lookup(keys: DataFrame, materials: DataFrame) -> DataFrame:
    """keys: key; materials: id, ord, names array. By id, else by name, the first in order; case is ignored."""
    by_id = materials.select(F.upper("id").alias("k"), F.lit(0).alias("how"), "ord", "id")
    by_name = materials.select(F.explode(F.transform("names", lambda n: F.upper(n))).alias("k"), F.lit(1).alias("how"), "ord", "id")
    j = keys.withColumn("k", F.upper(F.trim("key"))).join(by_id.unionByName(by_name).hint("merge"), "k")
    return j.groupBy("key").agg(F.min(F.struct("how", "ord", "id")).alias("m")).select("key", F.col("m.id").alias("id"))


def requirements_for_family(families: DataFrame, requirements: DataFrame) -> DataFrame:
    """families: family; requirements: requirement, families array."""
    return families.join(requirements.select("requirement", F.explode("families").alias("family")).hint("merge"), "family")


def related_standards(keys: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """keys: key; edges: src, dst, kind ('related' before 'references'), ord. One hop, known targets only, once each."""
    j = keys.join(edges.withColumnRenamed("src", "key"), "key").join(known.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi")
    return j.groupBy("key", "dst").agg(F.min(F.struct(F.when(F.col("kind") == "related", 0).otherwise(1).alias("k"), "ord")).alias("at")).select("key", "dst", F.row_number().over(W.partitionBy("key").orderBy("at", "dst")).alias("place"))


def pren_guidance(name: Column, low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.format_string("%s: PREN %s-%s", name, low.cast("string"), high.cast("string")))


def is_covered(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs: id, standard; edges likewise."""
    return pairs.join(edges.select("id", "standard").distinct().withColumn("c_", F.lit(True)), ["id", "standard"], "left").withColumn("covered", F.coalesce("c_", F.lit(False))).drop("c_")


def knowledge_insights(codes: DataFrame, materials: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines about each code: the material, its PREN range, what covers it. materials: id, name, pren_low, pren_high."""
    m = codes.join(materials, "id", "left").join(standards_for_material(codes, edges), "id", "left")
    lines = F.array_compact(F.array(F.when(F.col("name").isNotNull(), F.concat("id", F.lit(": "), "name")), pren_guidance(F.col("name"), F.col("pren_low"), F.col("pren_high")), F.when(F.size("standards") > 0, F.concat(F.lit("Covered by: "), F.array_join("standards", ", ")))))
    return m.select("id", lines.alias("insights"))
