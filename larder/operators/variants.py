"""Recipes in nested JSON without Python: variants, exploded some levels at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources import shared_table

#: Keys that make an object a recipe if a script takes their value for true.
RECIPE_KEYS = ["recipeIngredient", "recipeInstructions", "cookTime", "prepTime"]
#: Levels of nesting that one pass goes down before what it found is written.
LEVELS = 4


def _part(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$['{key}']", "variant")


def _schema(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _holds(value: Column) -> Column:
    """Whether a value is a list or an object."""
    return _schema(value).rlike("^(?:ARRAY|OBJECT)<")


def _true(value: Column) -> Column:
    """Whether a script takes a value for true: lists and objects always are."""
    kind, number = _schema(value), F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(1.0))
    false = (kind == "VOID") | (kind == "STRING") & (F.try_variant_get(value, "$", "string") == "") | (kind == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean")
    return ~F.coalesce(false | ~kind.isin("STRING", "BOOLEAN") & ~_holds(value) & (number == 0), F.lit(False))


def is_recipe(value: Column) -> Column:
    """Whether a variant is an object of type Recipe, or one with a part of a recipe."""
    kind = _part(value, "@type")
    one = F.coalesce((_schema(kind) == "STRING") & (F.try_variant_get(kind, "$", "string") == "Recipe"), F.lit(False))
    some = F.coalesce(F.exists(F.try_variant_get(kind, "$", "array<string>"), lambda x: F.lower(x) == "recipe"), F.lit(False))
    parts = [F.coalesce(_part(value, k).isNotNull() & _true(_part(value, k)), F.lit(False)) for k in RECIPE_KEYS]
    return _schema(value).startswith("OBJECT<") & reduce(lambda a, b: a | b, parts, one | some)


def find_recipes(texts: DataFrame, row_id: str = "id", text: str = "raw") -> DataFrame:
    """(row id, recipe) of every JSON text that holds one: the first, depth first, as a variant.

    Lists go in order, an object's ``@graph`` list before its other values, these by key (a
    variant keeps keys sorted). Nodes that are recipes stop at their depth, the others are
    exploded; a node's path is the places on the way to it, so the smallest path is the first
    in depth-first order. A round goes LEVELS deeper in one pass over what is still open and
    is written; there are as many as the deepest text needs.

    A text that is null or no JSON, or deeper than Spark reads, holds none. Rows that share
    an id are one text's parts no more than rows of other ids: each is searched for itself.
    """
    # numbered together with the parse, so that no filter takes the parse below and does it again
    level = texts.select(F.col(row_id).alias("id"), F.monotonically_increasing_id().alias("row"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(text).cast("string")).alias("v"))
    level = level.filter(_holds(F.col("v"))).withColumn("hit", is_recipe(F.col("v")))
    rounds = []
    while not rounds or not level.isEmpty():
        rounds.append(shared_table(reduce(lambda df, _: _deeper(df), range(LEVELS), level), "variants"))
        level = rounds[-1].filter(~F.col("hit"))
    hits = reduce(DataFrame.union, [r.filter("hit") for r in rounds])
    first = hits.groupBy("row").agg(F.min_by(F.struct("id", "v"), F.col("path")).alias("first"))
    return first.select(F.col("first.id").alias(row_id), F.col("first.v").alias("recipe"))


def _deeper(level: DataFrame) -> DataFrame:
    """Nodes (id, row, path, v, hit) with all that are no hits replaced by the lists and objects in them."""
    given = level.withColumn("open", F.when(~F.col("hit"), F.col("v"))).alias("l")
    parts = given.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("l.open").outer()).alias("e"))
    first = (F.col("key") == "@graph") & _schema(F.col("value")).startswith("ARRAY<")
    place = F.when(F.coalesce(first, F.lit(False)), -1).otherwise(F.col("pos"))
    below = F.when(F.col("hit"), F.col("v")).otherwise(F.col("value"))
    kept = parts.filter(F.col("hit") | _holds(F.col("value"))).select("id", "row", F.when(F.col("hit"), F.col("path")).otherwise(F.array_append("path", place)).alias("path"), below.alias("v"), "hit")
    return kept.withColumn("hit", F.col("hit") | is_recipe(F.col("v")))
