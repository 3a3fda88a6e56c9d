"""Text scalars. Every function takes and returns a column; null counts as empty text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import vocab as v


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def trim(value: Column) -> Column:
    """Trim all white space of scripts, not spaces only."""
    return F.btrim(value, F.lit(v.WS_CHARACTERS))


def bind(value: Column, body) -> Column:
    """Evaluate value once and hand it to body; an expression that a lambda or several
    branches refer to is evaluated again for each."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(value: Column) -> Column:
    """One space for each run of white space: all of it to spaces, then runs of spaces to one."""
    return F.regexp_replace(F.translate(value, v.WS_CHARACTERS, " " * len(v.WS_CHARACTERS)), " {2,}", " ")


def clean_text(value: Column) -> Column:
    """One space for each run of white space, trimmed."""
    return F.trim(collapse(text(value)))


def _chain(value: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1].replace("\\", "\\\\").replace("$", "\\$")), steps, value)


def _character(code: Column) -> Column:
    """The character of a number, which wraps at 16 bits as in scripts, by a JSON escape."""
    unit = F.pmod(F.coalesce(code.try_cast("bigint"), F.lit(65533)), F.lit(65536))
    return F.get(F.from_json(F.concat(F.lit('["\\u'), F.lpad(F.hex(unit), 4, "0"), F.lit('"]')), "array<string>"), F.lit(0))


def decode_numeric(value: Column) -> Column:
    """Generic decimal references to their characters."""
    around, codes = F.split(value, "&#[0-9]+;"), F.regexp_extract_all(value, F.lit("&#([0-9]+);"), 1)
    parts = F.zip_with(around, codes, lambda x, c: F.concat(x, F.when(c.isNull(), "").otherwise(F.coalesce(_character(c), F.lit("\ufffd")))))
    return F.when(value.rlike("&#[0-9]+;"), F.array_join(parts, "")).otherwise(value)


def named_entities(value: Column) -> Column:
    """The listed entities in their order; an escaped ampersand may make a later one."""
    return _chain(text(value), v.ENTITIES)


def clean_html_entities(value: Column) -> Column:
    return trim(decode_numeric(named_entities(value)))


def decode_simple_entities(value: Column) -> Column:
    return decode_numeric(_chain(text(value), v.SIMPLE_ENTITIES))


def clean_note(value: Column) -> Column:
    """Parenthesised notes to ``Note: ``; every closing parenthesis at the end goes."""
    return collapse(_note(clean_text(value)))


def _note(clean: Column) -> Column:
    """clean_note of a text without runs of white space, which it makes none of."""
    c = F.regexp_replace(clean, r"(?i)^\(Note(?:: ?| ?)", "Note: ")
    return F.trim(F.regexp_replace(c, r"\)+\z", ""))


def recipe_notes(value: Column) -> Column:
    return F.substring(clean_text(value), 1, 240)


def slugify(value: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; an empty value is ``recipe``."""
    given = F.when(text(value) == "", F.lit("recipe")).otherwise(text(value))
    kept = F.regexp_replace(trim(F.lower(given)), rf"(?:(?!{v.WS})[^A-Za-z0-9_-])", "")
    return F.regexp_replace(F.regexp_replace(kept, rf"{v.WS}+", "-"), "-+", "-")


def recipe_slug(name: Column, key: Column) -> Column:
    """Slug with the last four digits of a row's number, the same on every run."""
    return F.concat(slugify(name), F.lit("-"), F.lpad(F.pmod(key.cast("long"), F.lit(10000)).cast("string"), 4, "0"))


def cooking_text(value: Column) -> Column:
    """``N degrees`` to ``N°F``, and one sentence in plainer words."""
    c = F.regexp_replace(text(value), rf"(?i)([0-9]+){v.WS}*degrees?{v.B}", "$1°F")
    c = collapse(c)
    c = F.regexp_replace(c, r"(?i)\(Discard the bones\.\)\s*Return it to the soup\.", "Discard the bones, then return the shredded chicken to the soup.")
    return trim(c)


def broken_words(value: Column) -> Column:
    """Repair of words that were split; repaired words are lower-case."""
    return clean_text(_chain(text(value), [(rf"(?i){v.B}{p.replace(chr(92) + 's', v.WS)}{v.B}", r) for p, r in v.BROKEN_WORDS]))


def secondary_measures(value: Column) -> Column:
    """Drop a parenthesis with a metric unit after a US measure."""
    pattern = r"(?i)([0-9][0-9/.\s]*(?:oz|ounces?|cups?|tbsp|tablespoons?|tsp|teaspoons?|lb|lbs|pounds?))\s*\([^)]*(?:g|grams|kg|ml|milliliters?|l|liters?)[^)]*\)"
    return clean_text(F.regexp_replace(text(value), pattern, "$1"))


def split_each(value: Column) -> Column:
    """``A EACH: x, y`` to the lines ``A x`` and ``A y``; any other line alone."""
    pattern = rf"(?i)^(.+?){v.WS}+EACH:{v.WS}+(.+)\z"
    amount = trim(F.regexp_extract(value, pattern, 1))
    items = F.split(F.regexp_extract(value, pattern, 2), ",")
    return F.when(value.rlike(pattern), F.transform(items, lambda x: F.concat(amount, F.lit(" "), trim(x)))).otherwise(F.array(value))


def _sentences(value: Column, clean) -> Column:
    """Sentences of a text without runs of white space, each with a full stop."""
    parts = F.filter(F.transform(F.split(value, "(?<=[.!?]) "), clean), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"[.!?]\z"), x).otherwise(F.concat(x, F.lit("."))))


def split_long_steps(steps: Column) -> Column:
    """Steps of 220 characters or more in sentences, each with a full stop."""

    def one(step: Column) -> Column:
        return bind(_note(clean_text(step)), lambda c: F.when(F.length(c) < 220, F.array(c)).otherwise(_sentences(c, _note)))

    return F.flatten(F.transform(steps, one))


def split_single_step(steps: Column) -> Column:
    """A lone step in sentences, whatever its length."""
    return F.when(F.size(steps) == 1, _sentences(collapse(F.element_at(steps, 1)), F.trim)).otherwise(steps)


def compare_key(value: Column) -> Column:
    """Lower-case letters and digits in words, for comparing."""
    c = F.regexp_replace(F.lower(clean_text(value)), "[’']", "")
    return clean_text(F.regexp_replace(c, rf"(?:(?!{v.WS})[^a-z0-9])", " "))


def strip_quotes(value: Column) -> Column:
    c = F.regexp_replace(trim(text(value)), "^[\"'“”]+", "")
    return trim(F.regexp_replace(c, rf"(?:[\"'“”.]|{v.WS})+\z", ""))


def unwrap_social(value: Column) -> Column:
    """Drop ``who on platform:`` and ``likes, comments - who:`` before a caption."""
    c = text(value)
    for platform in ("Instagram", "TikTok", "Facebook"):
        c = F.regexp_replace(c, rf"(?i)^{v.WS}*.+?{v.WS}+on{v.WS}+{platform}{v.WS}*:{v.WS}*", "")
    c = F.regexp_replace(c, rf"(?i)^{v.WS}*[\d,]+{v.WS}+likes?,{v.WS}*[\d,]+{v.WS}+comments?{v.WS}*-{v.WS}*[^:]+:{v.WS}*", "")
    return trim(F.regexp_replace(c, rf"(?i)^{v.WS}*[\d,]+{v.WS}+likes?{v.WS}*-{v.WS}*[^:]+:{v.WS}*", ""))


def clean_caption(value: Column) -> Column:
    c = F.replace(F.replace(unwrap_social(decode_simple_entities(value)), F.lit("\\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip_quotes(trim(F.regexp_replace(c, "\n{3,}", "\n\n")))


def caption_text(value: Column) -> Column:
    """Unescape what a script's string left in a caption, and tidy its lines."""
    c = text(value)
    for old, new in (("\\n", "\n"), ("\\r", ""), ('\\"', '"')):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = _chain(c, [(r"(?i)\\u0026", "&"), (r"(?i)\\u003c", "<"), (r"(?i)\\u003e", ">"), (r"(?i)\\u2026", "…"), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("\r", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n")])
    return trim(c)


def unwrap_description(value: Column) -> Column:
    """Caption without the wrappers of page descriptions and one pair of quotes."""
    c = F.regexp_replace(caption_text(value), r"(?i)^[\d.,KMB+\s]+likes?,\s*[\d.,KMB+\s]+comments?\s*-\s*", "")
    c = F.regexp_replace(c, r"(?i)^Instagram\s*:\s*", "")
    c = F.regexp_replace(c, r"(?i)^[^:\n]{1,120}\s+on\s+Instagram\s*:\s*", "")
    c = trim(F.regexp_replace(c, r"(?i)^[^:\n]{1,120}\s+on\s+[A-Za-z]+\s+\d{1,2},\s+\d{4}\s*:\s*", ""))
    quoted = (c.startswith('"') & c.endswith('"')) | (c.startswith("“") & c.endswith("”"))
    return F.when(quoted, trim(F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))))).otherwise(c)


def clean_title(value: Column) -> Column:
    """A caption's title: before sections, without links, tags, promotion and emoji."""
    c = F.element_at(F.split(clean_caption(value), v.SECTION), 1)
    steps = [(r"(?i)https?://\S+", " "), (r"(?i)www\.\S+", " "), (r"#[A-Za-z0-9_-]+", " "), (r"@[A-Za-z0-9_]+", " ")]
    steps += [(rf"(?i){v.B}{t}{v.B}.*\z", " ") for t in v.PROMO_TAILS]
    steps += [(r"(?i)^recipe\s*[:\-]\s*", ""), (r"(?i)^title\s*[:\-]\s*", ""), (r"[\x{1F300}-\x{1FAFF}]", " "), ("[★✦✨⭐✅📌📝🍽🥩🍚👩🍳⬆\\x{FE0F}\\x{200D}]", " "), (r"^[^A-Za-z0-9_]+", ""), (rf"(?:(?!{v.WS})[^A-Za-z0-9_&'’/-])+\z", "")]
    return clean_text(_chain(c, steps))


def title_case(value: Column) -> Column:
    return F.initcap(clean_text(value))


def humanize_tag(value: Column) -> Column:
    """A hashtag in words: camel case and known food words apart, title case."""
    c = trim(F.regexp_replace(F.regexp_replace(text(value), "^#", ""), "[_-]+", " "))
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    foods = "veggies|vegetables|shrimp|prawns|chicken|beef|salmon|pasta|rice|tacos|potatoes|mushrooms|cabbage|cups|skillet|casserole|soup|salad|pizza|garlic|butter|roasted|grilled|baked|stuffed"
    return title_case(F.regexp_replace(c, f"(?i)({foods})", " $1 "))


def account_name(value: Column) -> Column:
    found = F.regexp_extract(decode_simple_entities(value), rf"(?i)^{v.WS}*(.+?){v.WS}+on{v.WS}+(?:Instagram|TikTok|Facebook){v.WS}*:", 1)
    return clean_text(F.regexp_replace(found, rf"^(?:@|{v.WS})+", ""))


def fallback_title(platform: Column) -> Column:
    return F.when(platform == "instagram", "Instagram Recipe").when(platform == "tiktok", "TikTok Recipe").when(platform == "facebook", "Facebook Recipe").otherwise("Saved Social Recipe")


def effort(value: Column) -> Column:
    c = trim(F.lower(text(value)))
    return F.when(c.isin("quick", "big"), c).otherwise("normal")


def true_only(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def language(value: Column) -> Column:
    c = F.lower(F.substring(text(value), 1, 2))
    return F.when(c == "", "en").otherwise(c)


def route_language(value: Column) -> Column:
    return F.when(F.lower(F.substring(text(value), 1, 2)) == "es", "es").otherwise("en")


def strip_fence(value: Column) -> Column:
    """Drop a Markdown fence around a JSON reply."""
    return trim(F.regexp_replace(F.regexp_replace(trim(text(value)), r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", ""))
