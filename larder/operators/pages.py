"""Page extraction: one parse of a page, then column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from larder.functions import text as t
from larder.functions import urls as u
from larder.functions import vocab as v
from larder.operators.jsonld import RECIPE, first_usable_of, read_block, success_level
from larder.operators.selectors import Picker, Selectors

STRINGS = ArrayType(StringType())
LINK = StructType([StructField("href", StringType()), StructField("text", StringType())])
_FIELDS = {
    "title": StringType(), "body": StringType(), "metas": MapType(StringType(), StringType()), "selected": ArrayType(STRINGS), "links": ArrayType(LINK), "n_links": IntegerType(),
    "n_items": IntegerType(), "plugin": ArrayType(STRINGS), "blocks": ArrayType(RECIPE),
}
PIECES = StructType([StructField(name, kind) for name, kind in _FIELDS.items()])
#: Selectors of ingredients and of instructions, tried in this order.
INGREDIENT_SELECTORS = ["[data-ingredient-name='true']", ".mntl-structured-ingredients__list-item", ".ingredients-item-name", "li[class*='ingredient']"]
INSTRUCTION_SELECTORS = [".comp.mntl-sc-block.mntl-sc-block-html", ".mntl-sc-block-group--LI", "li[class*='instruction']", "p[class*='instruction']", "div[class*='direction']"]
#: Selectors of the recipe plugin, all of which are taken.
PLUGIN_SELECTORS = [s for kind in ("ingredient", "instruction") for s in (f".wprm-recipe-{kind}", f".wprm-recipe-{kind}s li", f"[class*='wprm-recipe-{kind}']")]
RECIPE_LINKS = "a[href*='/recipe/']"
OWN, PLUGIN = len(INGREDIENT_SELECTORS) + len(INSTRUCTION_SELECTORS), len(PLUGIN_SELECTORS)
SELECTORS = Selectors([*INGREDIENT_SELECTORS, *INSTRUCTION_SELECTORS, *PLUGIN_SELECTORS, RECIPE_LINKS])


class _Page(Picker):
    """One pass over a page: what selectors meet, title, body, metas, counts, JSON-LD scripts."""

    def __init__(self):
        super().__init__(SELECTORS)
        self.title, self.body, self.metas = [], [], {}
        self.hrefs: list[str] = []
        self.scripts: list[list[str]] = []
        self.n_links = self.n_items = 0
        self.in_json = False

    def met(self, lists, tag, attributes):
        if lists[-1] == OWN + PLUGIN:
            self.hrefs.append(attributes["href"])

    def handle_starttag(self, tag, attrs):
        a = {k: x or "" for k, x in reversed(attrs)}
        if tag == "meta" and (key := a.get("property") or a.get("name")) and key not in self.metas:
            self.metas[key] = a.get("content", "")
        self.n_links += tag == "a"
        self.n_items += tag == "li"
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.in_json = True
            self.scripts.append([])
        self.element(tag, a)

    def handle_endtag(self, tag):
        self.in_json = self.in_json and tag != "script"
        super().handle_endtag(tag)

    def handle_data(self, data):
        super().handle_data(data)
        if self.in_json:
            self.scripts[-1].append(data)
        titled = self.open.last("title") >= 0
        if titled and not self.body:
            self.title.append(data)
        if not titled and self.open.last("head") < 0:
            self.body.append(data)


def read_page(html: str | None) -> dict:
    """Title, body text, metas, selector hits, links to recipes, counts and JSON-LD of one page."""
    p = _Page()
    p.read(html)
    found = p.texts()
    links = [{"href": h, "text": x} for h, x in zip(p.hrefs, found[-1], strict=True)]
    blocks = [dict(zip(RECIPE.names, read_block(raw), strict=True)) for raw in map("".join, p.scripts) if raw.strip()]
    return {"title": "".join(p.title), "body": "".join(p.body), "metas": p.metas, "selected": found[:OWN], "links": links, "n_links": p.n_links, "n_items": p.n_items, "plugin": found[OWN : OWN + PLUGIN], "blocks": blocks}


@F.pandas_udf(PIECES)
def pieces_of(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(x) for x in pages], columns=PIECES.names)


PIECES_OF = pieces_of.asNondeterministic()


def first_selector(lists: Column) -> Column:
    """All texts of the first selector with a hit, each once."""
    clean = F.transform(lists, lambda one: F.filter(F.transform(one, lambda x: t.clean_html_entities(t.clean_text(x))), lambda x: x != ""))
    return F.array_distinct(F.coalesce(F.get(F.filter(clean, lambda one: F.size(one) > 0), F.lit(0)), F.array().cast("array<string>")))


def only_steps(lines: Column) -> Column:
    """Lines with a cooking verb, without promotion and without notes."""
    notes = "|".join(v.STEP_NOISE[i] for i in (0, 1, 3, 4))
    return F.filter(lines, lambda x: x.rlike(f"(?i){'|'.join(v.STEP_VERBS)}") & ~x.rlike(f"(?i){'|'.join(v.STEP_PROMOS)}") & ~x.rlike(f"(?i)^(?:{notes})"))


def is_blocked(title: Column, body: Column, url: Column) -> Column:
    """Whether any sign of a challenge page is there."""
    found = lambda parts: lambda c: reduce(or_, (c.contains(x) for x in parts))
    one = lambda value, parts: t.bind(F.lower(t.clean_text(value)), found(parts))
    return one(title, v.BLOCKED_TITLES) | one(body, v.BLOCKED_BODIES) | found(v.BLOCKED_URLS)(t.text(url))


def first_meta(metas: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.element_at(metas, n), F.lit("")) for n in names), F.lit(""))


def recipe_link(links: Column, title: Column) -> Column:
    """First link to a recipe that says so or shares two longer words with the title."""
    clean = t.trim(F.regexp_replace(F.lower(t.clean_text(title)), rf"(?:(?!{v.WS})[^a-z0-9])", " "))
    words = F.filter(F.split(clean, rf"{v.WS}+"), lambda w: F.length(w) > 3)

    def fits(link: Column) -> Column:
        shown = F.lower(t.clean_text(link["text"]))
        return F.coalesce(link["href"].contains("/recipe/"), F.lit(False)) & (shown.contains("get the recipe") | (F.size(F.filter(words, lambda w: shown.contains(w))) >= 2))

    return F.coalesce(F.get(F.filter(links, fits), F.lit(0))["href"], F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken as directions."""
    parts = F.split(path, "/")
    start = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), start, lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}\z") & (F.size(kept) > 0), "/").otherwise(""))


def absolute(base: Column, href: Column) -> Column:
    """A link as an address, from the page's own; an empty one stays empty.

    Links of any scheme stand for themselves. Others take the base's scheme, host, path or
    query as far as they do not name their own; dot segments are followed.
    """
    of_base = lambda pattern: F.regexp_extract(base, pattern, 1)
    origin, path, query = of_base(r"^(https?://[^/?#]+)"), of_base(r"^https?://[^/?#]+([^?#]*)"), of_base(r"^[^?#]*(\?[^#]*)")
    own, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"([?#][\s\S]*)\z", 1)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*\z", "")), own))
    whole = F.when(merged.contains("/."), _without_dots(merged)).otherwise(merged)
    here = F.concat(origin, F.when(path == "", "/").otherwise(path))
    return (
        F.when(href == "", "").when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(of_base("^(https?:)"), href))
        .when((own == "") & rest.startswith("?"), F.concat(here, rest)).when(own == "", F.concat(here, query, rest)).otherwise(F.concat(origin, whole, rest))
    )


def extract(pages: DataFrame) -> DataFrame:
    """Page pieces and the fallback recipe (page_id, url, html): one parse a page."""
    parsed = pages.withColumn("_p", PIECES_OF(F.coalesce("html", F.lit("")))).select("page_id", "url", "_p.*")
    plugin = F.coalesce(F.col("url").contains("natashaskitchen.com"), F.lit(False))
    flat = lambda a, b: F.array_distinct(F.filter(F.transform(F.flatten(F.slice("plugin", a, b)), lambda x: t.clean_html_entities(t.clean_text(x))), lambda x: x != ""))
    own_ingredients, own_steps = F.slice(flat(1, 3), 1, 80), F.slice(F.filter(flat(4, 3), lambda x: F.length(x) > 10), 1, 40)
    return parsed.select(
        "page_id",
        "url",
        t.clean_text(F.col("title")).alias("title"),
        is_blocked(F.col("title"), F.col("body"), F.col("url")).alias("blocked"),
        first_meta(F.col("metas"), "og:title").alias("og_title"),
        first_meta(F.col("metas"), "og:image", "twitter:image").alias("image"),
        first_meta(F.col("metas"), "og:description", "description", "twitter:description").alias("description"),
        F.when(plugin & (F.size(own_ingredients) > 0), own_ingredients).otherwise(first_selector(F.slice("selected", 1, 4))).alias("ingredients"),
        F.when(plugin & (F.size(own_steps) > 0), own_steps).otherwise(only_steps(first_selector(F.slice("selected", 5, 5)))).alias("instructions"),
        absolute(F.col("url"), recipe_link(F.col("links"), F.col("title"))).alias("linked_recipe_url"),
        "n_links",
        "n_items",
        first_usable_of(F.col("blocks")).alias("json_ld"),
    )


def page_level(pages: DataFrame) -> DataFrame:
    return pages.withColumn("success_level", F.when(F.col("blocked"), "blocked").otherwise(success_level(F.size("ingredients"), F.size("instructions"), u.is_social(F.col("url")))))
