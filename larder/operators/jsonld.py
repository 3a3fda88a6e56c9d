"""Recipes in JSON-LD blocks: discovery in key order, lists, image."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from larder.functions import text as t
from larder.operators.jsonread import parse, told

RECIPE = StructType([StructField("found", BooleanType()), StructField("name", StringType()), StructField("ingredients", ArrayType(StringType())), StructField("instructions", ArrayType(StringType())), StructField("image", StringType())])
SPACE = re.compile("[\\s﻿]+")


def _is_recipe(node: dict) -> bool:
    kind = node.get("@type")
    named = kind == "Recipe" or isinstance(kind, list) and any(str(k).lower() == "recipe" for k in kind)
    # an empty list or object is true in a script
    return named or any(isinstance(node.get(k), (list, dict)) or bool(node.get(k)) for k in ("recipeIngredient", "recipeInstructions", "cookTime", "prepTime"))


def find_recipe(root: object) -> dict | None:
    """First recipe, depth first: lists in order, then ``@graph``, then keys in order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            if _is_recipe(node):
                return node
            graph = node.get("@graph")
            first = [graph] if isinstance(graph, list) else []  # not walked again as a value: nothing was in it
            rest = [x for k, x in node.items() if isinstance(x, (list, dict)) and not (first and k == "@graph")]
            stack.extend(reversed(first + rest))
    return None


def steps_of(root: object) -> list[str]:
    """Instruction texts: strings, lists of them, step and section objects, at any depth.

    An object gives the steps of its list, or, if that has none, its text or name.
    """
    out: list[str] = []
    stack: list[tuple[object, int | None]] = [(root, None)]
    while stack:
        node, before = stack.pop()
        if before is not None:
            if len(out) == before:
                stack.append((node.get("text") or node.get("name"), None))
        elif isinstance(node, str):
            out += [clean] if (clean := SPACE.sub(" ", node).strip()) else []
        elif isinstance(node, list):
            stack.extend((item, None) for item in reversed(node))
        elif isinstance(node, dict):
            stack += [(node, len(out)), (node.get("itemListElement") or None, None)]
    return out


def image_of(root: object) -> str:
    """The first address in a string, an object or lists of them at any depth."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
            continue
        if isinstance(node, dict):
            node = node.get("url") or node.get("contentUrl") or node.get("thumbnailUrl")
        if isinstance(node, str) and node:
            return node
    return ""


def _object_at(text: str) -> str:
    """The braces around the first literal recipe type, by a scan that knows strings."""
    at = text.find('"@type":"Recipe"')
    start = text.rfind("{", 0, at + 1) if at >= 0 else -1
    if start < 0:
        return ""
    depth = 0
    for m in re.compile(r'\\.|"(?:\\.|[^"\\])*+(?:"|\Z)|[{}]', re.DOTALL).finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return text[start : m.end()]
    return ""


def read_block(raw: str | None) -> tuple[bool, str | None, list[str], list[str], str]:
    """One block: found, name, ingredients, instructions, image. Never raises."""
    text = (raw or "").strip()
    for old, new in (("\\u003C", "<"), ("\\u003E", ">"), ("\\u0026", "&"), ("\\/", "/")):
        text = text.replace(old, new)
    recipe = None
    try:
        recipe = find_recipe(parse(text))
    except ValueError:
        pass
    if recipe is None and (body := _object_at(text)):
        try:
            recipe = find_recipe(parse(re.sub(r'\\([^"\\/bfnrtu])', r"\1", re.sub(r"[\x00-\x1f]+", " ", body))))
        except ValueError:
            pass
    if recipe is None:
        return False, None, [], [], ""
    given = recipe.get("recipeIngredient")
    name = recipe.get("name")
    return True, name if isinstance(name, str) else None, [x if isinstance(x, str) else told(x) for x in given if x] if isinstance(given, list) else [], steps_of(recipe.get("recipeInstructions")), image_of(recipe.get("image"))


@F.pandas_udf(RECIPE)
def recipe_of(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_block(b) for b in blocks], columns=RECIPE.names)


#: One evaluation for filters and projections above it.
RECIPE_OF = recipe_of.asNondeterministic()


def first_usable_of(blocks: Column) -> Column:
    """The first of a page's read blocks that is more than metadata, cleaned, or null."""
    clean = F.transform(blocks, lambda b: F.struct(t.clean_html_entities(b["name"]).alias("name"), clean_list(b["ingredients"]).alias("ingredients"), clean_list(b["instructions"]).alias("instructions"), b["image"].alias("image")))
    levelled = F.transform(clean, lambda b: F.struct(*(b[c].alias(c) for c in ("name", "ingredients", "instructions", "image")), success_level(F.size(b["ingredients"]), F.size(b["instructions"])).alias("success_level")))
    return F.get(F.filter(levelled, lambda b: b["success_level"] != "metadata-only"), F.lit(0))


def clean_list(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: t.clean_text(t.clean_html_entities(x))), lambda x: x != "")


def success_level(n_ingredients: Column, n_instructions: Column, social: Column | None = None) -> Column:
    """full, partial, or metadata-only (social-metadata-only for pages of social hosts)."""
    both, either = (n_ingredients > 0) & (n_instructions > 0), (n_ingredients > 0) | (n_instructions > 0)
    level = F.when(both, "full").when(either, "partial")
    return level.otherwise("metadata-only") if social is None else level.when(social, "social-metadata-only").otherwise("metadata-only")


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (page_id, ord, raw) with their recipes, cleaned lists and success level.

    A block without a recipe is a success with empty lists.
    """
    read = blocks.withColumn("_r", RECIPE_OF(F.coalesce("raw", F.lit(""))))
    out = read.select("page_id", "ord", F.col("_r.found").alias("found"), t.clean_html_entities(F.col("_r.name")).alias("name"), clean_list(F.col("_r.ingredients")).alias("ingredients"), clean_list(F.col("_r.instructions")).alias("instructions"), F.col("_r.image").alias("image"))
    return out.withColumn("success_level", success_level(F.size("ingredients"), F.size("instructions")))
