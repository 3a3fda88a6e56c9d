"""Classification and validation of records, tags and plan requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import vocab as v


def screenshot_level(n_ingredients: Column, n_instructions: Column, complete_a: Column, complete_b: Column) -> Column:
    both = (n_ingredients > 0) & (n_instructions > 0)
    return F.when(both & t.true_only(complete_a) & t.true_only(complete_b), "full").when((n_ingredients > 0) | (n_instructions > 0), "partial").otherwise("metadata-only")


def fast_usable(success: Column, has_recipe: Column, level: Column) -> Column:
    """Whether a fetched page's result is good enough not to render the page."""
    return t.true_only(success) & t.true_only(has_recipe) & ~F.coalesce(level, F.lit("")).isin("blocked", "fetch-failed", "metadata-only", "social-metadata-only")


def needs_caption(success: Column, ingredients: Column, instructions: Column, level: Column) -> Column:
    some = (t.trim(t.text(ingredients)) != "") | ((t.trim(t.text(instructions)) != "") & (t.text(instructions) != v.SOURCE_STEPS))
    return t.true_only(success) & ~some & level.isin("metadata-only", "social-metadata-only")


def looks_like_recipe(value: Column) -> Column:
    """A long caption with an ingredient signal and an instruction signal or cooking word."""
    c = t.text(value)
    ingredients = c.rlike(r"(?i)ingredients?(?:\s*\([^)]*\))?\s*[:~\-]") | c.rlike(r"(?i)what\s+you(?:'|’)?ll\s+need") | c.rlike(r"(?i)what\s+you\s+need")
    steps = c.rlike(r"(?i)(?:instructions?|directions?|method|steps?|how\s+to\s+make)(?:\s*\([^)]*\))?\s*[:~\-]") | c.rlike(rf"{v.B}1\s*[-.)]") | c.rlike("[1-5]\\x{FE0F}\\x{20E3}")
    cooking = c.rlike(rf"(?i){v.B}(?:mix|stir|cook|bake|heat|add|combine|whisk|serve|marinate|drizzle|garnish|assemble|season|simmer|boil|grill|fry|sauté|saute|toss){v.B}")
    return (F.length(c) >= 120) & ingredients & (steps | cooking)


def caption_sections(value: Column) -> Column:
    """{name, ingredients, instructions} of a caption with both headers in order."""
    c = t.trim(F.regexp_replace(F.replace(t.text(value), F.lit("\r"), F.lit("\n")), "\n{3,}", "\n\n"))
    lines = F.filter(F.transform(F.split(c, "\n"), t.clean_text), lambda x: x != "")
    first = r"(?i)^ingredients?(?:\s*\([^)]*\))?\s*[:~\-]?\z"
    second = r"(?i)^(?:instructions?|directions?|method|steps?|how\s+to\s+make)(?:\s*\([^)]*\))?\s*[:~\-]?\z"
    stop = r"(?i)^(?:tips?|notes?|hashtags?|save|follow|like|comment|share|for\s+more)\s*[:~\-]?\z"

    def where(items: Column, pattern: str) -> Column:
        return F.coalesce(F.array_position(F.transform(items, lambda x: x.rlike(pattern)), F.lit(True)), F.lit(0)).cast("int")

    def parts(ls: Column) -> Column:
        a, b = where(ls, first), where(ls, second)
        good = (a > 0) & (b > a)
        name = F.coalesce(F.get(F.filter(F.slice(ls, F.lit(1), F.greatest(a - 1, F.lit(0))), lambda x: (F.length(x) > 2) & ~x.rlike("(?i)^https?://")), F.lit(0)), F.lit("Imported Recipe"))
        between = F.filter(F.slice(ls, a + 1, F.greatest(b - a - 1, F.lit(0))), lambda x: ~x.rlike(stop) & ~x.rlike("^[#@]"))
        after = F.slice(ls, b + 1, F.size(ls))
        end = where(after, f"{stop}|^[#@]")
        steps = F.when(end > 0, F.slice(after, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(after)
        steps = F.filter(F.transform(steps, lambda x: t.trim(F.regexp_replace(F.regexp_replace(x, r"^[0-9]+\s*[).:-]\s*", ""), "^[1-9]\\x{FE0F}\\x{20E3}\\s*", ""))), lambda x: x != "")
        none = F.array().cast("array<string>")
        return F.struct(F.when(good, name).otherwise("").alias("name"), F.when(good, between).otherwise(none).alias("ingredients"), F.when(good, steps).otherwise(none).alias("instructions"))

    return F.element_at(F.transform(F.array(lines), parts), 1)


def mentions_enough(ingredients: Column, instructions: Column) -> Column:
    """Whether steps name enough of the first 20 longer ingredient words."""
    c = F.regexp_replace(F.regexp_replace(F.lower(t.text(ingredients)), r"\([^)\n]*\)", " "), r"[0-9]+/[0-9]+|[0-9]+(?:\.[0-9]+)?", " ")
    c = F.regexp_replace(F.regexp_replace(c, rf"{v.B}(?:{'|'.join(v.MEASURE_WORDS)}){v.B}", " "), rf"(?:(?!{v.WS})[^a-z])", " ")
    words = F.slice(F.array_distinct(F.filter(F.split(c, rf"{v.WS}+"), lambda w: F.length(w) > 3)), 1, 20)
    steps = F.lower(t.text(instructions))
    hit = F.size(F.filter(words, lambda w: steps.contains(w)))
    return (F.size(words) > 0) & (hit >= F.least(F.lit(4), F.ceil(F.size(words) * F.lit(0.35))))


MEASURE = r"[0-9]+(?:\s+[0-9]+/[0-9]+|[./][0-9]+)?\s*(?:cups?|tbsp|tablespoons?|tsp|teaspoons?|oz|ounces?|lbs?|pounds?|grams?|kg|ml|liters?|minutes?|mins?|seconds?|hours?)"
ACTION = "add|mix|stir|cook|bake|fry|saute|sauté|season|heat|combine|place|pour|whisk|simmer|boil|grill|chop|slice|brown|melt|fold|spread|top|serve"


def substantive(content: Column, complete_a: Column, complete_b: Column, visible: Column, spoken: Column) -> Column:
    """Whether a video's evidence says enough to be parsed."""
    a, b = t.text(visible), t.text(spoken)
    measured = a.rlike(rf"(?i){v.B}{MEASURE}{v.B}") | b.rlike(rf"(?i){v.B}{MEASURE}{v.B}")
    section = a.rlike(rf"(?i){v.B}(?:ingredients?|instructions?|directions?|method|steps?)\s*:")
    acts = lambda x: x.rlike(rf"(?i){v.B}(?:{ACTION}){v.B}") & (F.length(x) >= 20)
    return t.true_only(content) & (t.true_only(complete_a) | t.true_only(complete_b) | measured | section | acts(a) | acts(b))


def skip_cleanup(level: Column, n_ingredients: Column, n_instructions: Column, mentioned: Column) -> Column:
    return (level == "full") & (n_ingredients <= 12) & (n_instructions <= 8) & mentioned


def error_status(code: Column) -> Column:
    """{status, level} of an error code of the video routes."""
    rules = [
        (code.isin(*v.INVALID_URL_CODES), 400, "unsupported-video-url"), (code.isin(*v.UNAVAILABLE_CODES), 422, "public-video-unavailable"), (code == "PUBLIC_VIDEO_TOO_LARGE", 413, "public-video-too-large"),
        (code == "TIKTOK_TIMEOUT", 504, "public-video-timeout"), (code == "INVALID_TIKTOK_OEMBED", 502, "public-video-response-error"), (code == "AI_UNAVAILABLE", 503, "ai-unavailable"),
    ]
    status, level = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for c, s, name in rules[1:]:
        status, level = status.when(c, s), level.when(c, name)
    return F.struct(status.otherwise(500).alias("status"), level.otherwise("public-video-import-error").alias("level"))


def allowed_upload(mime: Column, name: Column) -> Column:
    m, ext = F.lower(t.text(mime)), F.regexp_extract(F.lower(t.text(name)), r"\.[a-z0-9]+\z", 0)
    return m.isin("video/mp4", "video/quicktime", "video/webm", "video/x-m4v") | (m.isin("", "application/octet-stream") & ext.isin(".mp4", ".mov", ".webm", ".m4v"))


def recipe_tags(tags: Column) -> Column:
    """Allowed tags in hyphens, each once, eight at most."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.regexp_replace(t.trim(F.lower(t.text(x))), rf"{v.WS}+", "-"))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: x.isin(*v.RECIPE_TAGS))), 1, 8)


def plan_list(values: Column, most: int = 12) -> Column:
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(t.trim(t.text(x)))), lambda x: x != "")
    return F.slice(F.array_distinct(F.transform(clean, lambda x: F.substring(x, 1, 50))), 1, most)


def plan_tags(values: Column) -> Column:
    """Allowed tags of a request; the cut to twelve comes before hyphens and the list."""
    return F.filter(F.transform(plan_list(values), lambda x: F.regexp_replace(x, rf"{v.WS}+", "-")), lambda x: x.isin(*v.PLAN_TAGS))


def plan_constraints(raw: Column) -> Column:
    """Validated constraints of a plan request from its JSON text."""
    kind = "excludedKeywords array<string>, preferredKeywords array<string>, preferredTags array<string>, mostlyQuick string, vegetarianNightCount string, pantryPriority string, budgetPriority string, kidFriendly string, proteinTargets array<struct<keyword:string,count:string>>"
    c = F.from_json(raw, kind)
    clamp = lambda x, low, default: F.coalesce(F.least(F.greatest(F.floor(x.try_cast("double") + 0.5), F.lit(low)), F.lit(7)), F.lit(default)).cast("int")
    targets = F.filter(F.transform(F.coalesce(c["proteinTargets"], F.array().cast("array<struct<keyword:string,count:string>>")), lambda x: F.struct(F.substring(F.lower(t.trim(t.text(x["keyword"]))), 1, 40).alias("keyword"), F.when(t.text(x["count"]) == "", 1).otherwise(clamp(x["count"], 1, 1)).alias("count"))), lambda x: x["keyword"] != "")
    first = F.aggregate(targets, F.filter(targets, lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: y["keyword"] == x["keyword"]), acc).otherwise(F.array_append(acc, x)))
    yes = lambda name: F.coalesce(c[name] == "true", F.lit(False))
    return F.struct(
        plan_list(c["excludedKeywords"]).alias("excluded"), plan_list(c["preferredKeywords"]).alias("preferred"), plan_tags(c["preferredTags"]).alias("tags"), yes("mostlyQuick").alias("mostly_quick"), clamp(c["vegetarianNightCount"], 0, 0).alias("vegetarian_nights"),
        yes("pantryPriority").alias("pantry"), yes("budgetPriority").alias("budget"), yes("kidFriendly").alias("kid_friendly"), F.slice(first, 1, 4).alias("protein_targets"),
    )
