"""Captions and titles of social posts: scores, ranking, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import urls as u
from larder.functions import vocab as v


def _points(*rules: tuple[Column, int]) -> Column:
    return sum((F.when(c, n).otherwise(0) for c, n in rules[1:]), F.when(rules[0][0], rules[0][1]).otherwise(0))


def _any_part(value: Column, parts: list[str]) -> Column:
    out = value.contains(parts[0])
    for p in parts[1:]:
        out = out | value.contains(p)
    return out


def recipe_signal(value: Column) -> Column:
    c = t.text(value)
    words = lambda x: c.rlike(rf"(?i){v.BEGIN}(?:{x}){v.END}")
    return _points(
        (words("ingredients?|what you(?:'|’)?ll need"), 25),
        (words("instructions?|directions?|method|steps?"), 25),
        (words("cup|cups|tablespoons?|tbsp|teaspoons?|tsp|ounces?|oz|pounds?|lbs?|grams?|ml") | c.rlike(r"(?i)(?<=[A-Za-z0-9_])°[fc](?![A-Za-z0-9_])"), 20),
        (words("bake|cook|stir|mix|whisk|roast|boil|simmer|fry|grill|season|serve|preheat"), 15),
        (c.contains("\n"), 5),
    )


def is_generic_caption(value: Column) -> Column:
    c = F.lower(t.text(value))
    return (c == "") | (c == "instagram") | _any_part(c, v.GENERIC_CAPTIONS)


def caption_score(value: Column, source: Column) -> Column:
    """Score of an unwrapped caption by source, length and recipe signals."""
    base = F.coalesce(F.element_at(F.create_map(*(x for k, w in v.SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(w)))), source), F.lit(10))
    n = F.length(value)
    score = base + F.least(n, F.lit(1200)) / F.lit(40.0) + recipe_signal(value) - F.when(n > 6000, 100).when(n > 3000, 30).otherwise(0)
    return F.when((n < 3) | is_generic_caption(value), F.lit(-1000.0)).otherwise(score.cast("double"))


def dedupe_captions(candidates: DataFrame) -> DataFrame:
    """First of each post's captions that are alike but for case and white space.

    Input (post_id, ord, source, text). Partial aggregation by (post, key), so a common
    caption is combined before the shuffle.
    """
    own = candidates.select("post_id", "ord", "source", t.unwrap_description(F.col("text")).alias("text"))
    keyed = own.withColumn("key", t.clean_text(F.lower("text"))).filter("key <> ''")
    first = keyed.groupBy("post_id", "key").agg(F.min(F.struct("ord", "source", "text")).alias("f")).select("post_id", "f.*")
    return first.withColumn("score", caption_score(F.col("text"), F.col("source")))


def best_caption(candidates: DataFrame) -> DataFrame:
    """Each post's caption: a usable meta caption in source order, else the best score."""
    usable = dedupe_captions(candidates).filter("score > 0")
    place = F.coalesce(F.when(F.col("source") == v.CANONICAL_SOURCES[0], 0).when(F.col("source") == v.CANONICAL_SOURCES[1], 1).when(F.col("source") == v.CANONICAL_SOURCES[2], 2), F.lit(3))
    rank = F.struct(place, -F.col("score"), F.col("ord"))
    return usable.groupBy("post_id").agg(F.min_by(F.struct("source", "text", "score"), rank).alias("b")).select("post_id", "b.*")


def best_of_texts(candidates: Column) -> Column:
    """The best of an array of raw captions by food words, sections and length."""
    cleaned = F.array_distinct(F.filter(F.transform(candidates, t.clean_caption), lambda x: x != ""))

    def score(c: Column) -> Column:
        n = F.length(c)
        return _points((c.rlike(v.FOOD), 2), (c.rlike("(?i)ingredients?:|instructions?:|directions?:|steps?:|you need|what you need"), 6), (n > 80, 2), (n > 400, 1), (_any_part(F.lower(c), ["log in", "sign up"]), -10))

    return _top(cleaned, score)


def _top(items: Column, score) -> Column:
    """The item with the highest score, the earliest of ties; empty text if none."""
    ranked = F.transform(items, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
    return F.coalesce(F.array_min(ranked)["x"], F.lit(""))


def _words(value: Column) -> Column:
    return F.size(F.filter(F.split(value, rf"{v.WS}+"), lambda w: w != ""))


def title_score(value: Column) -> Column:
    c = F.lower(t.clean_text(value))
    n = _words(c)
    return _points((n.between(2, 8), 4), (n.between(9, 12), 1), (c.rlike(v.FOOD), 5), (c.contains("recipe"), 1), (F.length(c) > 70, -2), (c.rlike(v.INSTRUCTION_VERB), -2))


def is_bad_title(value: Column, account: Column) -> Column:
    """Whether a text is no title: wrong size, the account's name, boilerplate, a step."""
    c = F.lower(t.clean_text(value))
    n = _words(c)
    size = (F.length(c) < 4) | (F.length(c) > 90) | (n > 12)
    own = (account != "") & (t.compare_key(c) == t.compare_key(account))
    only_account = (n <= 3) & ~c.rlike(v.FOOD) & c.rlike("(?i)kitchen|recipes?|food|macro")
    step = c.rlike(v.INSTRUCTION_START) | (c.rlike(v.INSTRUCTION_VERB) & c.rlike(v.INSTRUCTION_CONTEXT)) | c.rlike(v.COLON_INSTRUCTION)
    return size | own | c.rlike(v.ENGAGEMENT) | c.isin(*v.GENERIC_TITLES) | _any_part(c, v.BAD_TITLE_PARTS) | only_account | c.rlike(v.MEASURE_START) | c.rlike(v.GENERIC_CATEGORY) | step


def best_title(candidates: Column, account: Column) -> Column:
    cleaned = F.array_distinct(F.filter(F.transform(candidates, t.clean_title), lambda x: x != ""))
    return _top(F.filter(cleaned, lambda x: ~is_bad_title(x, account)), title_score)


def quoted(value: Column) -> Column:
    """Texts in double, curly and single quotes of 4 to 2000 characters."""
    c = t.decode_simple_entities(value)
    found = F.concat(*(F.regexp_extract_all(c, F.lit(p), 1) for p in (r'(?s)"(.{4,2000}?)"', "(?s)“(.{4,2000}?)”", "'([^']{4,2000}?)'")))
    return F.filter(F.transform(found, t.strip_quotes), lambda x: x != "")


def title_candidates(value: Column) -> Column:
    """Candidate titles of a caption: a named recipe, the lead, its pieces, in sentences."""
    before = t.trim(F.element_at(F.split(t.clean_caption(value), v.SECTION), 1))
    named = t.clean_title(F.regexp_extract(before, rf"(?i)(?:^|\|){v.WS}*([^|\n\r]{{4,80}}?{v.B}recipe){v.B}", 1))
    pieces = F.concat(F.array(named, before), F.split(before, r"\n|\r|\||•|◆|✦|⭐|📝|👩‍🍳|🥩|🍚"))
    sentences = F.flatten(F.transform(pieces, lambda p: F.split(p, rf"(?<=[.!?]){v.WS}+")))
    return F.filter(F.transform(sentences, t.clean_title), lambda x: x != "")


def hashtag_score(value: Column) -> Column:
    c = F.lower(t.clean_text(value))
    n = _words(c)
    style = rf"(?i){v.B}(?:roasted|grilled|baked|stuffed|garlic|butter|cheesy|slow cooker|air fryer){v.B}"
    generic = rf"(?i){v.B}(?:recipe|recipes|food|foods|foodie|foodinspo|eating|healthy|comfortfood|yummy|yum){v.B}"
    return _points((n.between(2, 5), 3), (c.rlike(v.FOOD), 5), (c.rlike(style), 3), (c.rlike(generic), -5), (n > 6, -4))


def hashtag_titles(value: Column) -> Column:
    """Hashtags with food in words, by score, then order."""
    tags = F.transform(F.regexp_extract_all(t.text(value), F.lit("#[A-Za-z0-9_-]+"), 0), t.humanize_tag)
    food = F.filter(tags, lambda x: (x != "") & x.rlike(v.FOOD))
    scored = F.filter(F.transform(food, lambda x, i: F.struct((-hashtag_score(x)).alias("s"), i.alias("i"), x.alias("x"))), lambda r: r["s"] < 0)
    return F.transform(F.array_sort(scored), lambda r: r["x"])


def compact_parts(parts: Column) -> Column:
    """Texts that say something new: none equal to, in, or around a kept one (over 40)."""
    keyed = F.filter(F.transform(F.transform(parts, t.clean_caption), lambda x: F.struct(x.alias("x"), t.compare_key(x).alias("k"))), lambda r: r["k"] != "")

    def covers(kept: Column, r: Column) -> Column:
        inside = (F.length(r["k"]) > 40) & kept["k"].contains(r["k"])
        around = (F.length(kept["k"]) > 40) & r["k"].contains(kept["k"])
        return (kept["k"] == r["k"]) | inside | around

    start = F.filter(keyed, lambda r: F.lit(False))
    kept = F.aggregate(keyed, start, lambda acc, r: F.when(F.exists(acc, lambda x: covers(x, r)), acc).otherwise(F.array_append(acc, r)))
    return F.transform(kept, lambda r: r["x"])


def resolve_posts(posts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Caption parts of posts (post_id, raw_name, description, fallback_text, source_url).

    The columns named by keep (post_id alone by default) come first.
    """
    texts = [t.text(F.col(c)) for c in ("raw_name", "description", "fallback_text")]
    account = F.coalesce(F.nullif(t.account_name(texts[0]), F.lit("")), t.account_name(texts[1]))
    one = posts.select("*", u.platform(F.col("source_url")).alias("platform"), account.alias("account_name"), F.concat(*(quoted(x) for x in texts)).alias("_quoted"))
    two = one.withColumn("fallback_title", t.fallback_title(F.col("platform"))).withColumn("raw_caption", best_of_texts(F.concat("_quoted", F.array(*texts))))
    lead, name, desc = F.col("raw_caption"), texts[0], texts[1]
    all_titles = F.filter(F.concat(title_candidates(lead), title_candidates(name), title_candidates(desc), F.transform("_quoted", t.clean_title), hashtag_titles(F.concat_ws("\n\n", lead, desc, name, texts[2]))), lambda x: x != "")
    three = two.withColumn("_titles", all_titles)
    return three.select(
        *(keep or ["post_id"]),
        "platform",
        "fallback_title",
        "account_name",
        "raw_caption",
        best_title(F.col("_titles"), F.col("account_name")).alias("title_candidate"),
        F.array_join(compact_parts(F.array(lead, desc, name, texts[2], t.text(F.col("source_url")))), "\n\n").alias("rescue_text"),
        F.slice(F.array_distinct("_titles"), 1, 8).alias("title_candidates"),
    )


def candidate_priority(url: Column, content_type: Column) -> Column:
    """1 for MP4, 2 for playlists, 3 for other video types, 4 for the rest."""
    a, kind = F.lower(t.text(url)), F.lower(t.text(content_type))
    return F.when(kind.contains("video/mp4") | a.rlike(r"\.mp4(?:[?#]|\z)"), 1).when(kind.contains("mpegurl") | a.rlike(r"\.m3u8(?:[?#]|\z)"), 2).when(kind.startswith("video/"), 3).otherwise(4)


def _earliest(column: str, usable: Column) -> Column:
    """First usable value by ord."""
    return F.min_by(F.when(usable, F.col(column)), F.when(usable, F.col("ord")))


def media_candidates(found: DataFrame) -> DataFrame:
    """Media of posts (post_id, ord, url, source, content_type, status), one row a URL."""
    clean = found.withColumn("url", u.clean_media_url(F.col("url")))
    good = clean.filter((F.col("url") != "") & ~F.col("url").rlike("^(?:blob|data):") & u.looks_like_video(F.col("url"), F.col("content_type")) & u.is_instagram_media(F.col("url")))
    return _merged(good)


def _merged(rows: DataFrame) -> DataFrame:
    names = F.array_sort(F.collect_set(F.struct("ord", "source")))
    typed = F.coalesce(F.col("content_type") != "", F.lit(False))
    return rows.groupBy("post_id", "url").agg(F.min("ord").alias("ord"), F.array_distinct(F.transform(names, lambda x: x["source"])).alias("sources"), _earliest("content_type", typed).alias("content_type"), _earliest("status", F.col("status").isNotNull()).alias("status"))


def media_tracks(found: DataFrame) -> DataFrame:
    """Best video and audio track of each post, by bitrate, then order."""
    ranged = media_candidates(found).withColumn("source", F.explode("sources")).withColumn("url", u.remove_byte_range(F.col("url")))
    merged = _merged(ranged.select("post_id", "ord", "url", "source", "content_type", "status"))
    raw = F.try_url_decode(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("efg")))
    meta = F.from_json(F.try_to_binary(F.translate(raw, "-_", "+/"), F.lit("base64")).cast("string"), "vencode_tag string, bitrate double, duration_s double")
    tag = F.lower(F.coalesce("m.vencode_tag", F.lit("")))
    tracks = merged.withColumn("m", meta).select("post_id", "ord", "url", "sources", F.when(tag.contains("audio"), "audio").otherwise("video").alias("kind"), F.coalesce("m.bitrate", F.lit(0.0)).alias("bitrate"), F.coalesce("m.duration_s", F.lit(0.0)).alias("duration_seconds"))
    first = F.row_number().over(Window.partitionBy("post_id", "kind").orderBy(F.desc("bitrate"), "ord"))
    return tracks.withColumn("_k", first).filter("_k = 1").select("post_id", "kind", "url", F.array_join("sources", ",").alias("sources"), "bitrate", "duration_seconds")
