"""Record pipelines: pages to recipes, cleanup, caption rescue, imports of posts and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import urls as u
from larder.functions import vocab as v
from larder.operators import captions, classify, evidence, jsonld, pages

#: A cleanup step between parse and normalisation, e.g. a model behind mapInPandas; rows
#: in and out have the columns of raw recipes. The default changes nothing.
Enricher = Callable[[DataFrame], DataFrame]


def identity(rows: DataFrame) -> DataFrame:
    return rows


def page_recipes(table: DataFrame) -> DataFrame:
    """One recipe row a page (page_id, url, html): JSON-LD first, then selectors. One parse, no join."""
    page = pages.page_level(pages.extract(table))
    from_ld = F.col("json_ld").isNotNull() & ~F.col("blocked")
    pick = lambda c, other: F.when(from_ld, F.col(f"json_ld.{c}")).otherwise(other)
    name = F.coalesce(F.nullif(pick("name", F.lit("")), F.lit("")), F.nullif("og_title", F.lit("")), F.nullif("title", F.lit("")), F.lit("Imported Recipe"))
    out = page.select(
        "page_id",
        u.canonical(F.col("url")).alias("source_url"),
        t.clean_html_entities(name).alias("name"),
        pick("ingredients", jsonld.clean_list(F.col("ingredients"))).alias("ingredients"),
        pick("instructions", jsonld.clean_list(F.col("instructions"))).alias("instructions"),
        F.coalesce(F.nullif(pick("image", F.lit("")), F.lit("")), "image").alias("image"),
        "description",
        "linked_recipe_url",
        pick("success_level", F.col("success_level")).alias("success_level"),
        "blocked",
        "n_links",
        "n_items",
    )
    return out.withColumn("slug", t.recipe_slug(F.col("name"), F.col("page_id")))


def page_results(table: DataFrame) -> DataFrame:
    """Canonical results of pages: page_recipes with success, the address it came from and a
    text to fall back on (name, description and address) where a page has no recipe."""
    found = page_recipes(table.select("page_id", "url", "html"))
    empty = (F.size("ingredients") == 0) & (F.size("instructions") == 0)
    text = F.array_join(F.filter(F.array("name", "description", "source_url"), lambda x: x != ""), "\n\n")
    return found.select("*", (~F.col("blocked")).alias("success"), F.col("source_url").alias("imported_from_url"), F.when(empty, text).otherwise("").alias("fallback_text"))


def recipe_record(name: Column, ingredients: Column, instructions: Column, image: Column, source_url: Column, level: Column, fallback: Column, key: Column) -> Column:
    """The canonical recipe of a result; steps that are not there are at the source."""
    steps = F.when(F.size(instructions) > 0, F.array_join(instructions, "\n")).otherwise(v.SOURCE_STEPS)
    return F.struct(
        name.alias("name"), F.array_join(ingredients, "\n").alias("ingredients"), steps.alias("instructions"), image.alias("photo_url"), t.recipe_slug(name, key).alias("slug"),
        source_url.alias("source_url"), F.lit("normal").alias("effort"), level.alias("import_status"), fallback.alias("fallback_text"),
    )


def rendered_over_fast(fast: DataFrame, rendered: DataFrame) -> DataFrame:
    """The fetched page's result where usable, else the rendered page's."""
    usable = classify.fast_usable(~F.col("f.blocked"), F.lit(True), F.col("f.success_level"))
    joined = fast.alias("f").join(rendered.alias("r"), F.col("f.page_id") == F.col("r.page_id"), "left")
    return joined.select(*(F.when(usable | F.col("r.page_id").isNull(), F.col(f"f.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in fast.columns))


def follow_links(recipes: DataFrame) -> DataFrame:
    """Recipes without ingredients take those of the page they link to, if it is there.

    Of several pages with one address the first by page_id counts. A row that follows
    nothing gets a key of its own, so such rows do not meet in one task.
    """
    first = F.min_by(F.struct("ingredients", "instructions", "success_level"), F.col("page_id"))
    linked = recipes.filter((F.size("ingredients") > 0) & F.col("source_url").isNotNull()).groupBy(F.col("source_url").alias("_to")).agg(first.alias("_l"))
    due = (F.size("ingredients") == 0) & (F.col("linked_recipe_url") != "")
    key = F.when(due, u.canonical(F.col("linked_recipe_url"))).otherwise(F.concat(F.lit("\x00"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = recipes.join(linked, key == F.col("_to"), "left")
    return joined.select(*(F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)).alias(c) if c in ("ingredients", "instructions", "success_level") else F.col(c) for c in recipes.columns))


def _lines(value: Column) -> Column:
    return F.filter(F.split(t.text(value), "\n"), lambda x: t.trim(x) != "")


def clean_ingredients(items: Column) -> Column:
    one = F.transform(items, lambda x: t.broken_words(t.clean_text(t.clean_html_entities(t.secondary_measures(x)))))
    return F.filter(F.flatten(F.transform(one, t.split_each)), lambda x: x != "")


def clean_instructions(items: Column) -> Column:
    steps = F.transform(t.split_long_steps(items), lambda x: t.broken_words(t.cooking_text(t.clean_text(t.clean_html_entities(t.secondary_measures(x))))))
    noise = "|".join(v.STEP_NOISE)
    return F.filter(steps, lambda x: (x != "") & ~x.rlike(f"(?i)^(?:{noise})"))


def cleanup(raw: DataFrame, enrich: Enricher = identity, keep: list[str] | None = None) -> DataFrame:
    """Normalised recipes of raw ones (recipe_id, name, ingredients, instructions, effort,
    tags, is_vegetarian, notes, success_level); full ones that need nothing are passed on.

    The placeholder sentence for missing steps is not taken for a step. Columns named by
    keep (recipe_id and name by default) come first.
    """
    lines = raw.select("*", _lines(F.col("ingredients")).alias("_i"), F.filter(_lines(F.col("instructions")), lambda x: x != v.SOURCE_STEPS).alias("_s"))
    skip = classify.skip_cleanup(F.col("success_level"), F.size("_i"), F.size("_s"), classify.mentions_enough(F.col("ingredients"), F.col("instructions")))
    given = enrich(lines.withColumn("skipped", skip))
    return given.select(
        *(keep or ["recipe_id", "name"]),
        "skipped",
        F.when(F.col("skipped"), F.col("_i")).otherwise(clean_ingredients(F.col("_i"))).alias("ingredients"),
        F.when(F.col("skipped"), F.col("_s")).otherwise(clean_instructions(t.split_single_step(F.col("_s")))).alias("instructions"),
        t.effort(F.col("effort")).alias("effort"),
        classify.recipe_tags(F.col("tags")).alias("tags"),
        t.true_only(F.col("is_vegetarian")).alias("is_vegetarian"),
        t.recipe_notes(F.col("notes")).alias("notes"),
    )


def attach_caption(fallback: Column, caption: Column) -> Column:
    """A user's caption before the fallback text."""
    c = t.trim(t.text(caption))
    return F.when(c == "", fallback).otherwise(F.concat_ws("\n\n", c, F.nullif(t.trim(t.text(fallback)), F.lit(""))))


def rescue_captions(results: DataFrame, posts: DataFrame) -> DataFrame:
    """Results (post_id, success, ingredients, instructions, success_level) that need a
    caption take the sections of their post's rescue text if it looks like a recipe."""
    parts = captions.resolve_posts(posts).select("post_id", "rescue_text", "title_candidate", "fallback_title")
    both = results.join(parts, "post_id", "left")
    need = classify.needs_caption(F.col("success"), F.col("ingredients"), F.col("instructions"), F.col("success_level")) & F.coalesce(classify.looks_like_recipe(F.col("rescue_text")), F.lit(False))
    found = both.withColumn("_c", classify.caption_sections(F.col("rescue_text"))).withColumn("rescued", need & (F.size("_c.ingredients") > 0) & (F.size("_c.instructions") > 0))
    return found.select(
        "post_id",
        "rescued",
        F.when(F.col("rescued"), F.array_join("_c.ingredients", "\n")).otherwise(F.col("ingredients")).alias("ingredients"),
        F.when(F.col("rescued"), F.array_join("_c.instructions", "\n")).otherwise(F.col("instructions")).alias("instructions"),
        F.when(F.col("rescued"), "full").otherwise(F.col("success_level")).alias("success_level"),
        F.coalesce(F.nullif("title_candidate", F.lit("")), "fallback_title").alias("title"),
    )


def import_texts(texts: DataFrame) -> DataFrame:
    """Recipes of pasted texts (doc_id, text) by the rule-based parser; always ``full``."""
    return texts.withColumn("_c", classify.caption_sections(F.col("text"))).select("doc_id", "_c.name", "_c.ingredients", "_c.instructions", F.lit("full").alias("success_level"))


def import_videos(shown: DataFrame, parsed: DataFrame) -> DataFrame:
    """Video evidence with its parsed recipe: full if both lists are there, else partial."""
    e = shown.withColumn("usable", classify.substantive(F.col("has_recipe_content"), F.col("ingredients_appear_complete"), F.col("instructions_appear_complete"), F.col("visible_recipe_text"), F.col("spoken_recipe_text")))
    both = e.join(parsed, "doc_id", "left")
    full = F.col("usable") & (F.size("ingredients") > 0) & (F.size("instructions") > 0)
    return both.select("doc_id", "usable", F.coalesce(F.nullif(t.clean_text(F.col("name")), F.lit("")), t.clean_text(F.col("title"))).alias("name"), "ingredients", "instructions", F.when(~F.col("usable"), "no-recipe-found").when(full, "full").otherwise("partial").alias("success_level"))


def combined_evidence(caption: Column, video: Column) -> Column:
    """A post's caption and what its video shows, labelled, joined by a blank line."""
    part = lambda label, c: F.when(t.text(c) != "", F.concat(F.lit(label + ":\n"), t.text(c)))
    return t.trim(F.concat_ws("\n\n", part("Instagram caption", caption), part("Video evidence", video)))


def parsed_recipe(parsed: Column) -> Column:
    """A parsed recipe's name and lists, cleaned, without empty lines; null is empty."""
    lines = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), t.clean_text), lambda x: x != "")
    return F.struct(t.clean_text(parsed["name"]).alias("name"), lines(parsed["ingredients"]).alias("ingredients"), lines(parsed["instructions"]).alias("instructions"))


def is_full(recipe: Column) -> Column:
    return (F.size(recipe["ingredients"]) > 0) & (F.size(recipe["instructions"]) > 0)


def import_layers(posts: DataFrame) -> DataFrame:
    """Recipes of posts by layers: a full recipe of the caption, else that of caption and video.

    posts: post_id, caption, from_caption (parsed recipe or null), video (text of the
    video's evidence; null where the video could not be had), from_both (parsed recipe or
    null), video_title. Without caption and video evidence the level is no-recipe-found.
    """
    said, seen = t.trim(t.text(F.col("caption"))), t.trim(t.text(F.col("video")))
    had, reached = said != "", F.col("video").isNotNull()
    first = posts.withColumn("_a", parsed_recipe(F.when(had, F.col("from_caption")))).withColumn("_first_full", is_full(F.col("_a")))
    used = first.withColumn("_r", F.when(~F.col("_first_full") & reached & (had | (seen != "")), parsed_recipe(F.col("from_both"))).otherwise(F.col("_a")))
    path = F.when(F.col("_first_full"), "caption-first-full").when(reached & had, "caption-and-video").when(reached, "video-only").when(had, "caption-only-video-unavailable").otherwise("video-unavailable")
    name = F.coalesce(F.nullif("_r.name", F.lit("")), F.nullif(t.clean_text(F.col("video_title")), F.lit("")), F.lit("Imported Video Recipe"))
    level = F.when(~had & (seen == ""), "no-recipe-found").when(is_full(F.col("_r")), "full").otherwise("partial")
    shown = combined_evidence(said, F.when(~F.col("_first_full"), seen))
    return used.select("post_id", path.alias("path"), name.alias("name"), "_r.ingredients", "_r.instructions", level.alias("success_level"), shown.alias("evidence"))


def import_captions(posts: DataFrame) -> DataFrame:
    """Recipes of posts that have a caption only (post_id, caption, from_caption)."""
    used = posts.withColumn("_r", parsed_recipe(F.when(t.trim(t.text(F.col("caption"))) != "", F.col("from_caption"))))
    level = F.when(t.trim(t.text(F.col("caption"))) == "", "no-recipe-found").when(is_full(F.col("_r")), "full").otherwise("partial")
    return used.select("post_id", "_r.name", "_r.ingredients", "_r.instructions", level.alias("success_level"), F.when(is_full(F.col("_r")), "").otherwise("incomplete").alias("warning"))


def import_screenshots(shots: DataFrame) -> DataFrame:
    """Recipes of screenshots (shot_id, visible_title, given_title, parsed, complete_a, complete_b)."""
    used = shots.withColumn("_r", parsed_recipe(F.col("parsed"))).withColumn("_t", evidence.screenshot_title(F.col("visible_title"), F.col("given_title"), F.col("_r.name")))
    level = classify.screenshot_level(F.size("_r.ingredients"), F.size("_r.instructions"), F.col("complete_a"), F.col("complete_b"))
    return used.select("shot_id", "_t.name", F.col("_t.source").alias("title_source"), "_r.ingredients", "_r.instructions", level.alias("success_level"))


def social_titles(results: DataFrame) -> DataFrame:
    """Names of incomplete social results become their caption's title or the platform's.

    results: post_id, success, rescued, name, description, fallback_text, source_url,
    ingredients, instructions (lists). Null lists are empty; others keep their names.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    due = t.true_only(F.col("success")) & F.coalesce(u.is_social(F.col("source_url")), F.lit(False)) & ~t.true_only(F.col("rescued")) & ~((size("ingredients") > 0) & (size("instructions") > 0))
    marked = results.withColumn("due", due)
    parts = captions.resolve_posts(marked.filter("due").select("post_id", F.col("name").alias("raw_name"), "description", "fallback_text", "source_url"))
    both = marked.join(parts.select("post_id", "title_candidate", "fallback_title", "rescue_text"), "post_id", "left")
    name = F.when(F.col("due"), F.coalesce(F.nullif("title_candidate", F.lit("")), "fallback_title")).otherwise(F.col("name"))
    text = F.when(F.col("due"), F.coalesce(F.nullif("rescue_text", F.lit("")), "fallback_text")).otherwise(F.col("fallback_text"))
    return both.select("post_id", name.alias("name"), t.recipe_slug(name, F.col("post_id")).alias("slug"), text.alias("fallback_text"), F.col("due").alias("cleaned"))


# One lineage from a shared link to a clean recipe. Rows are requests; every step adds to
# or replaces their columns, and only the steps that read another table join.


def _needs_caption(result: DataFrame) -> Column:
    none = (F.size("ingredients") == 0) & (F.size("instructions") == 0)
    return F.col("success") & none & F.col("success_level").isin("metadata-only", "social-metadata-only")


def _replaced(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """Columns that take a value where a condition holds."""
    marked = df.withColumn("_when", F.coalesce(when, F.lit(False)))
    return marked.withColumns({c: F.when(F.col("_when"), x).otherwise(F.col(c)) for c, x in values.items()}).drop("_when")


def _first_by(table: DataFrame, url: str, order: str, columns: list[str], name: str) -> DataFrame:
    """One row an address: the first by order, as a struct; rows without an address go."""
    picked = F.min_by(F.struct(*columns), F.col(order)).alias(name)
    return table.filter(F.coalesce(F.col(url), F.lit("")) != "").groupBy(F.col(url).alias(f"{name}_url")).agg(picked)


def rescue_instagram(results: DataFrame, said: DataFrame) -> DataFrame:
    """Instagram results that need a caption, without one of the user's, take that of their
    post (url, caption, image_url) as description, and its image if they have none."""
    post = _first_by(said.withColumn("_o", F.struct("caption", "image_url")), "url", "_o", ["caption", "image_url"], "_post")
    due = _needs_caption(results) & (u.video_platform(F.col("asked_url")) == "instagram") & (F.col("user_caption") == "")
    key = F.when(due, F.col("asked_url")).otherwise(F.concat(F.lit("\x00"), F.col("request_id").cast("string")))
    joined = results.join(post, key == F.col("_post_url"), "left")
    caption = t.trim(t.text(F.col("_post.caption")))
    image = F.coalesce(F.nullif("image", F.lit("")), t.trim(t.text(F.col("_post.image_url"))))
    return _replaced(joined, F.col("_post").isNotNull() & (caption != ""), description=caption, image=image).drop("_post", "_post_url")


PARTS = ["platform", "fallback_title", "raw_caption", "title_candidate", "rescue_text", "caption_evidence"]


def with_parts(results: DataFrame) -> DataFrame:
    """Results with PARTS: their caption's parts, and as caption_evidence the user's caption
    with the address, else what the post's texts give. The steps below share them."""
    posts = results.withColumn("post_id", F.col("request_id")).withColumn("raw_name", F.col("name"))
    parts = captions.resolve_posts(posts, results.columns).drop("account_name", "title_candidates")
    own = F.array_join(F.array_distinct(F.filter(F.array("user_caption", t.trim(F.col("source_url"))), lambda x: x != "")), "\n\n")
    return parts.withColumn("caption_evidence", F.when(F.col("user_caption") != "", own).otherwise(F.col("rescue_text")))


def _social_name(name: Column) -> Column:
    """A rescued name: of a social source the best title of its caption, else the platform's."""
    social = F.coalesce(F.nullif("title_candidate", F.lit("")), F.col("fallback_title"))
    return F.when(u.is_social(F.col("source_url")), F.when((name != "") & ~captions.is_bad_title(name, F.lit("")), name).otherwise(social)).otherwise(name)


def rescue_social(results: DataFrame) -> DataFrame:
    """Results with parts that need a caption take the sections of the caption itself, else of all its evidence.

    A user's caption counts from 80 characters on, another one if it looks like a recipe.
    rescue says what happened: caption, caption-too-short, caption-no-recipe, none.
    """
    both = results.withColumn("_needs", _needs_caption(results)).withColumn("_own", F.col("user_caption") != "")
    text = F.col("caption_evidence")
    short = F.col("_own") & (F.length(t.trim(text)) < 80)
    unlike = ~F.col("_own") & ~F.coalesce(classify.looks_like_recipe(text), F.lit(False))
    due = F.col("_needs") & ~short & ~unlike
    itself = F.when(F.col("_own"), F.col("user_caption")).otherwise(F.col("raw_caption"))
    found = both.withColumn("_a", F.when(due, classify.caption_sections(itself))).withColumn("_b", F.when(due, classify.caption_sections(text)))
    found = found.withColumn("_c", F.when((F.size("_a.ingredients") > 0) & (F.size("_a.instructions") > 0), F.col("_a")).otherwise(F.col("_b")))
    good = F.col("_c").isNotNull() & (F.size("_c.ingredients") > 0) & (F.size("_c.instructions") > 0)
    said = F.when(~F.col("_needs"), "none").when(good, "caption").when(short, "caption-too-short").otherwise("caption-no-recipe")
    name = _social_name(F.coalesce(F.nullif("_c.name", F.lit("")), F.nullif("name", F.lit("")), F.lit("Saved Recipe")))
    out = found.withColumn("rescue", said)
    out = _replaced(out, F.col("rescue") == "caption", name=name, ingredients=jsonld.clean_list(F.col("_c.ingredients")), instructions=jsonld.clean_list(F.col("_c.instructions")), success_level=F.lit("full"), fallback_text=F.lit(""))
    return out.select(*results.columns, "rescue")


def rescue_video(results: DataFrame, shown: DataFrame) -> DataFrame:
    """Facebook results with parts, without both lists, and without a linked recipe, are promoted to full
    by their video's evidence.

    shown: url, the fields of validated evidence, image_url, and parsed (name, ingredients,
    instructions, ingredients_appear_complete, instructions_appear_complete). Evidence must be
    substantive, and both lists there and complete; anything else leaves the result as it is.
    """
    facts = ["has_recipe_content", "title", "visible_recipe_text", "spoken_recipe_text", "combined_recipe_text", "ingredients_appear_complete", "instructions_appear_complete", "image_url", "parsed"]
    video = _first_by(shown.withColumn("_o", F.struct(*facts)), "url", "_o", facts, "_video")
    due = F.col("success") & (u.platform(F.col("source_url")) == "facebook") & ((F.size("ingredients") == 0) | (F.size("instructions") == 0)) & (F.col("linked_recipe_url") == "")
    key = F.when(due, F.col("source_url")).otherwise(F.concat(F.lit("\x00"), F.col("request_id").cast("string")))
    joined = results.join(video, key == F.col("_video_url"), "left")
    e = lambda c: F.col(f"_video.{c}")
    solid = classify.substantive(e("has_recipe_content"), e("ingredients_appear_complete"), e("instructions_appear_complete"), e("visible_recipe_text"), e("spoken_recipe_text")) & (t.trim(t.text(e("combined_recipe_text"))) != "")
    lists = joined.withColumn("_r", parsed_recipe(e("parsed")))
    complete = t.true_only(e("parsed.ingredients_appear_complete")) & t.true_only(e("parsed.instructions_appear_complete")) & is_full(F.col("_r"))
    full = F.coalesce(solid & complete, F.lit(False))
    name = _social_name(F.coalesce(F.nullif("_r.name", F.lit("")), F.nullif(t.clean_text(e("title")), F.lit("")), F.nullif("name", F.lit("")), F.lit("Facebook Recipe")))
    image = F.coalesce(F.nullif("image", F.lit("")), t.text(e("image_url")))
    said = F.when(full, "video").when(F.col("_video").isNotNull(), "video-incomplete").otherwise(F.col("rescue"))
    out = _replaced(lists.withColumn("_full", full), F.col("_full"), name=name, ingredients=F.col("_r.ingredients"), instructions=F.col("_r.instructions"), image=image, success_level=F.lit("full"), fallback_text=F.lit(""))
    return out.withColumn("rescue", said).select(*results.columns)


def fallback_titles(results: DataFrame) -> DataFrame:
    """Social results that no caption made whole are named by their caption or platform and keep its text."""
    due = F.col("success") & u.is_social(F.col("source_url")) & (F.col("rescue") != "caption") & ~((F.size("ingredients") > 0) & (F.size("instructions") > 0))
    name = F.coalesce(F.nullif("title_candidate", F.lit("")), F.col("fallback_title"))
    text = F.coalesce(F.nullif("rescue_text", F.lit("")), F.col("fallback_text"))
    return _replaced(results, due, name=name, fallback_text=text)


def import_recipes(requests: DataFrame, fetched: DataFrame, rendered: DataFrame, pins: DataFrame, said: DataFrame, shown: DataFrame, enrich: Enricher = identity) -> DataFrame:
    """Shared links to clean recipes, whole: one canonical row a request.

    requests: request_id, url, caption_text, shared_text, language. fetched and rendered:
    pages (page_id, url, html) as had without and with a browser. pins: url, resolved_url.
    said, shown: see rescue_instagram and rescue_video. Link, page (rendered where the
    fetched one is too weak), the user's caption, the rescues, titles, the linked recipe and
    cleanup follow each other as in an import of one link. A request without a link is
    bad-url, one whose pin or page is not there fetch-failed; neither has a recipe.
    """
    given = lambda c: F.nullif(t.trim(t.text(F.col(c))), F.lit(""))
    asked = requests.select("request_id", u.import_url(t.text(F.col("url"))).alias("asked_url"), F.coalesce(given("caption_text"), given("shared_text"), F.lit("")).alias("user_caption"), t.route_language(t.trim(t.text(F.col("language")))).alias("language"))
    pin = _first_by(pins, "url", "resolved_url", ["resolved_url"], "_pin")
    is_pin = u.is_pinterest(F.col("asked_url"))
    key = F.when(is_pin, F.col("asked_url")).otherwise(F.concat(F.lit("\x00"), F.col("request_id").cast("string")))
    asked = asked.withColumn("_key", key).withColumn("_pinned", is_pin).join(pin, F.col("_key") == F.col("_pin_url"), "left")
    asked = asked.withColumn("asked_url", F.when(F.col("_pinned"), F.coalesce("_pin.resolved_url", F.lit(""))).otherwise(F.col("asked_url"))).drop("_key", "_pin", "_pin_url")

    facts = ["source_url", "imported_from_url", "success", "success_level", "name", "ingredients", "instructions", "image", "description", "linked_recipe_url", "fallback_text", "blocked"]
    sides = {side: page_results(table.withColumn("url", u.import_url(F.coalesce("url", F.lit(""))))) for side, table in (("fast", fetched), ("slow", rendered))}
    sides = {side: _first_by(found, "source_url", "page_id", facts, f"_{side}") for side, found in sides.items()}
    at = F.when(F.col("asked_url") == "", F.concat(F.lit("\x00"), F.col("request_id").cast("string"))).otherwise(u.canonical(F.col("asked_url")))
    both = asked.withColumn("_at", at).join(sides["fast"], F.col("_at") == F.col("_fast_url"), "left").join(sides["slow"], F.col("_at") == F.col("_slow_url"), "left")
    usable = classify.fast_usable(F.col("_fast.success"), F.lit(True), F.col("_fast.success_level"))
    page = both.withColumn("_r", F.when(usable | F.col("_slow").isNull(), F.col("_fast")).otherwise(F.col("_slow")))
    none = F.array().cast("array<string>")
    missing = F.when((F.col("asked_url") == "") & ~F.col("_pinned"), "bad-url").otherwise("fetch-failed")
    lists = {"ingredients": none, "instructions": none, "success": F.lit(False), "success_level": missing, "source_url": F.col("asked_url")}
    result = page.select("request_id", "language", "user_caption", "asked_url", *(F.coalesce(F.col(f"_r.{c}"), lists.get(c, F.lit(""))).alias(c) for c in facts if c != "blocked"))

    result = _replaced(result, F.col("success"), fallback_text=attach_caption(F.col("fallback_text"), F.col("user_caption")))
    result = fallback_titles(rescue_video(rescue_social(with_parts(rescue_instagram(result, said))), shown)).drop(*PARTS)

    linked = {side: table.select(F.col(f"_{side}_url").alias(f"_l{side}_url"), F.col(f"_{side}").alias(f"_l{side}")) for side, table in sides.items()}
    due = F.col("success") & (F.col("linked_recipe_url") != "") & (F.size("ingredients") == 0)
    key = F.when(due, u.canonical(F.col("linked_recipe_url"))).otherwise(F.concat(F.lit("\x00"), F.col("request_id").cast("string")))
    followed = result.withColumn("_to", key).join(linked["fast"], F.col("_to") == F.col("_lfast_url"), "left").join(linked["slow"], F.col("_to") == F.col("_lslow_url"), "left")
    usable = classify.fast_usable(F.col("_lfast.success"), F.lit(True), F.col("_lfast.success_level"))
    followed = followed.withColumn("_r", F.when(usable | F.col("_lslow").isNull(), F.col("_lfast")).otherwise(F.col("_lslow"))).withColumn("followed", F.col("_r").isNotNull())
    taken = ["success", "success_level", "name", "ingredients", "instructions", "image", "description", "fallback_text"]
    followed = _replaced(followed, F.col("followed"), **{c: F.col(f"_r.{c}") for c in taken}, imported_from_url=F.col("linked_recipe_url"))
    return cleaned_results(followed.select(*result.columns, "followed"), enrich)


def cleaned_results(results: DataFrame, enrich: Enricher = identity) -> DataFrame:
    """Results after cleanup, with their canonical recipe; the other columns stay."""
    kept = [c for c in results.columns if c not in ("ingredients", "instructions")]
    raw = results.withColumns({"ingredients": F.array_join("ingredients", "\n"), "instructions": F.array_join("instructions", "\n"), "effort": F.lit("normal"), "tags": F.array().cast("array<string>"), "is_vegetarian": F.lit(False), "notes": F.lit("")})
    clean = cleanup(raw, enrich, kept)
    record = recipe_record(*(F.col(c) for c in ("name", "ingredients", "instructions", "image", "imported_from_url", "success_level", "fallback_text", "request_id")))
    return clean.withColumn("recipe", F.when(F.col("success"), record))


def import_jsonld(requests: DataFrame, enrich: Enricher = identity) -> DataFrame:
    """JSON-LD that a device sent (request_id, url, json_ld) to clean recipes.

    A request without an address or text is bad-request and has no recipe.
    """
    blocks = requests.select(F.col("request_id").alias("page_id"), F.struct(u.import_url(t.text(F.col("url"))).alias("url"), (t.trim(t.text(F.col("json_ld"))) != "").alias("given")).alias("ord"), F.col("json_ld").alias("raw"))
    good = F.col("ord.given") & (F.col("ord.url") != "")
    found = jsonld.from_blocks(blocks).select(
        F.col("page_id").alias("request_id"), F.col("ord.url").alias("source_url"), F.col("ord.url").alias("imported_from_url"), good.alias("success"), F.when(good, F.col("success_level")).otherwise("bad-request").alias("success_level"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("Imported Recipe")).alias("name"), "ingredients", "instructions", "image", F.lit("").alias("fallback_text"),
    )
    return cleaned_results(found, enrich)
