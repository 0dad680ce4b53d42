"""Best similar street of each row, within blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_similarity, may_reach
from ..functions.standardize import ambiguous_street
from ..plans.stages import ATTEMPTS, STATE_KEYS
from .lattice import dictionary


def best_street(rows: DataFrame, table: DataFrame, block: tuple[str, ...], cutoff: float) -> DataFrame:
    """(state, city, block keys, logradouro, street, similarity) for the different streets of
    ``rows`` that have a similar one in their block.

    Streets are deduplicated before they are scored, a native bound drops pairs that cannot
    reach the cutoff, and the best is an aggregation, which combines before the shuffle.
    Similarity is rounded to three decimals before the strict comparison.
    """
    keys = [*STATE_KEYS, *block]
    asked = rows.where(F.col("logradouro").isNotNull() & ~ambiguous_street(F.col("logradouro"))).select(*keys, "logradouro").distinct()
    known = dictionary(table, block).withColumnRenamed("logradouro", "street")
    pairs = asked.join(known, keys).where(may_reach(F.col("logradouro"), F.col("street"), cutoff))
    scored = pairs.withColumn("similarity", jaro_similarity("logradouro", "street").cast("decimal(5,3)"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("street"))).alias("b")
    return scored.where(F.col("similarity") > cutoff).groupBy(*keys, "logradouro").agg(best).select(*keys, "logradouro", F.col("b.street").alias("street"), (-F.col("b.s")).cast("decimal(5,3)").alias("similarity"))


def settled(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """row_id of the rows that an exact or interpolated stage matches before any fuzzy one:
    those whose street, code and locality are known, with a number if the row has one."""
    keys = [*STATE_KEYS, "logradouro", "cep", "localidade"]
    known = [(tables["T1"].where("numero is not null"), "numero is not null"), (tables["T3"], "numero is null")]
    return reduce(DataFrame.union, [rows.where(which).join(t.select(*keys).distinct(), keys, "left_semi").select("row_id") for t, which in known if set(keys) <= set(t.columns)])


def with_similar_street(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with similar, similaridade and level (1 to 3): the first of the three attempts
    that finds a street. A later attempt never replaces an earlier one, so all three can be
    made up front. Rows that no fuzzy stage can reach are not asked for, where the tables
    tell them (T1 is among them)."""
    asked = rows.join(settled(rows, tables), "row_id", "left_anti") if "T1" in tables else rows
    for k, (name, block, table, cutoff) in enumerate(ATTEMPTS, 1):
        keys = [*STATE_KEYS, *block, "logradouro"]
        found = best_street(asked, tables[table], block, cutoff).withColumnsRenamed({"street": f"_street_{name}", "similarity": f"_sim_{name}"})
        asked = asked.join(found, keys, "left").withColumn(f"_level_{name}", F.when(F.col(f"_street_{name}").isNotNull(), k))
    names = [a[0] for a in ATTEMPTS]
    pick = lambda what: F.coalesce(*[F.col(f"_{what}_{n}") for n in names])
    asked = asked.select("row_id", pick("street").alias("similar"), pick("sim").alias("similaridade"), pick("level").alias("level")).where("similar is not null")
    return rows.join(asked, "row_id", "left")
