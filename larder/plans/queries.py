"""Registered queries of the recipe operators, each with SQL where SQL can say it.

Inline rows are the same text in both engines; each set has a hit, a miss, an empty and
a null value. Lists are joined to text, so results hold scalars only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import urls as u
from larder.functions import vocab as v
from larder.operators import captions, classify, evidence, jsonld, pages
from larder.operators.selectors import extract_by_selectors
from larder.plans import recipes
from larder.sources import rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def joined(column: str):
    return F.array_join(column, "\n").alias(column)


CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("clean_text", "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.clean_text(F.col("text")).alias("clean"))


TITLE = "trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))"
DECODED = f"replace(replace(replace({TITLE}, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"')"


@query("slugify_titles", f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim({DECODED})), '[^a-zA-Z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM pages")
def slugify_titles(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", t.slugify(t.clean_html_entities(t.clean_text(title))).alias("slug"))


def _drop_sql(url: str) -> str:
    keys = "|".join(v.TRACKING)
    base = f"regexp_replace({url}, '#.*$', '')"
    kept = f"array_to_string(list_filter(string_split(regexp_extract({base}, '\\?(.*)$', 1), '&'), lambda p: NOT regexp_matches(p, '^({keys})(=|$)')), '&')"
    return f"regexp_replace({base}, '\\?.*$', '') || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


def page_recipes(spark, sf):
    out = recipes.page_recipes(table(spark, sf, "pages"))
    return out.withColumns({c: F.array_join(c, "\n") for c in ("ingredients", "instructions")})


@query("url_canonical", f"SELECT page_id, {_drop_sql('url')} AS canonical FROM pages")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", u.canonical(F.col("url")).alias("canonical"))


@query("url_import", f"SELECT page_id, {_drop_sql('url')} AS canonical FROM pages")
def url_import(spark, sf):
    return table(spark, sf, "pages").select("page_id", u.import_url("url").alias("canonical"))


TEXT = f"lower({CLEAN.format(chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']))})"
SLUG = f"regexp_replace(regexp_replace(regexp_replace(lower(trim({DECODED})), '[^a-zA-Z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') || '-' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0')"
_blocked_page = " OR ".join([f"contains(lower({DECODED}), '{x}')" for x in v.BLOCKED_TITLES] + [f"contains({TEXT}, '{x}')" for x in v.BLOCKED_BODIES] + [f"contains(url, '{x}')" for x in v.BLOCKED_URLS])
_items_sql = "array_to_string(list_distinct(regexp_extract_all(html, '<li[^>]*class=\"[^\"]*{0}[^\"]*\"[^>]*>([^<]*)', 1)), chr(10))"
_ingredients, _steps = _items_sql.format("ingredient"), _items_sql.format("instruction")

query(
    "page_recipes",
    f"""SELECT page_id, {_drop_sql('url')} AS source_url, {DECODED} AS name, {_ingredients} AS ingredients, {_steps} AS instructions, regexp_extract(html, 'property="og:image" content="([^"]*)"', 1) AS image,
    regexp_extract(html, '(?:property="og:|name=")description" content="([^"]*)"', 1) AS description, regexp_extract(html, 'href="([^"]*/recipe/[^"]*)"', 1) AS linked_recipe_url,
    CASE WHEN {_blocked_page} THEN 'blocked' WHEN {_ingredients} <> '' AND {_steps} <> '' THEN 'full' WHEN {_ingredients} <> '' OR {_steps} <> '' THEN 'partial'
    WHEN regexp_matches(lower(url), 'facebook[.]com|fb[.]watch|instagram[.]com|tiktok[.]com|pinterest[.]com') THEN 'social-metadata-only' ELSE 'metadata-only' END AS success_level,
    {_blocked_page} AS blocked, CAST(len(regexp_extract_all(html, '<a[ >]')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS n_items, {SLUG} AS slug FROM pages""",
)(page_recipes)


LINKS = "(1, 'https://www.instagram.com/reel/abc/?x=1#y'), (2, 'https://vm.tiktok.com/Z1'), (3, 'http://m.facebook.com/v'), (4, 'https://www.pinterest.com/pin/12/'), (5, 'https://pin.it/q'), (6, 'https://notinstagram.com/reel/a'), (7, 'ftp://x'), (8, ''), (9, NULL), (10, 'https://fb.watch/a'), (11, 'https://www.tiktok.com/@me/video/77?q=1')"
HOST = "lower(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#:]+)', 1))"


@query(
    "url_host_class",
    f"""SELECT id, CASE WHEN {HOST} = 'tiktok.com' OR {HOST} LIKE '%.tiktok.com' THEN 'tiktok' WHEN {HOST} = 'instagram.com' OR {HOST} LIKE '%.instagram.com' THEN 'instagram' ELSE '' END AS video,
    CASE WHEN coalesce(url, '') LIKE '%instagram.com%' THEN 'instagram' WHEN url LIKE '%tiktok.com%' THEN 'tiktok' WHEN url LIKE '%facebook.com%' OR url LIKE '%fb.watch%' THEN 'facebook' ELSE 'social' END AS platform,
    {HOST} IN ('pinterest.com', 'www.pinterest.com', 'pin.it') OR {HOST} LIKE '%.pinterest.com' AS pinterest, {HOST} = 'pin.it' AS pin_it,
    coalesce(regexp_matches(url, 'facebook\\.com|fb\\.watch|instagram\\.com|tiktok\\.com|pinterest\\.com'), false) AS social FROM (VALUES {LINKS}) AS t(id, url)""",
)
def url_host_class(spark, sf):
    c = F.col("url")
    return rows(spark, LINKS, "id, url").select("id", u.video_platform(c).alias("video"), u.platform(c).alias("platform"), u.is_pinterest(c).alias("pinterest"), u.is_pin_it(c).alias("pin_it"), u.is_social(c).alias("social"))


@query(
    "url_validate",
    f"""SELECT id, CASE WHEN id = 1 THEN 'https://www.instagram.com/reel/abc/?x=1' END AS i_url, CASE WHEN id = 1 THEN NULL WHEN url LIKE 'https://%' THEN 'UNSUPPORTED_PUBLIC_VIDEO_PLATFORM' ELSE 'INVALID_PUBLIC_VIDEO_URL' END AS i_error_code,
    CASE WHEN id = 10 THEN url END AS f_url, CASE WHEN id = 10 THEN NULL WHEN url LIKE 'https://%' THEN 'UNSUPPORTED_FACEBOOK_VIDEO_PLATFORM' ELSE 'INVALID_FACEBOOK_VIDEO_URL' END AS f_error_code,
    CASE WHEN {HOST} LIKE '%tiktok.com' THEN regexp_replace(url, '\\?.*$', '') END AS k_url,
    CASE WHEN {HOST} LIKE '%tiktok.com' THEN NULL WHEN coalesce(url, '') = '' THEN 'INVALID_TIKTOK_URL' WHEN url NOT LIKE 'http%' THEN 'INVALID_TIKTOK_PROTOCOL' ELSE 'UNSUPPORTED_TIKTOK_HOST' END AS k_error_code
    FROM (VALUES {LINKS}) AS t(id, url)""",
)
def url_validate(spark, sf):
    c = F.col("url")
    out = rows(spark, LINKS, "id, url").select("id", u.validate_instagram(c).alias("i"), u.validate_facebook(c).alias("f"), u.validate_tiktok(c).alias("k"))
    return out.select("id", *(F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "ifk" for y in ("url", "error_code")))


ITEMS = "list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))"


@query("html_list_items", f"SELECT page_id, CAST(len({ITEMS}) AS BIGINT) AS n_items, array_to_string({ITEMS}, '|') AS items FROM pages")
def html_list_items(spark, sf):
    found = extract_by_selectors(table(spark, sf, "pages").select("page_id", "html"), ["li"], into="found")
    items = F.transform(F.col("found")[0], t.clean_text)
    return found.select("page_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, "|").alias("items"))


PAGE_ROWS = "(1, 'Just a moment...', 'x', 'https://a.com'), (2, 'Soup', 'Please  enable cookies now', 'https://a.com'), (3, 'Soup', 'hot', 'https://a.com/?solution=1'), (4, 'Soup', 'hot', 'https://a.com'), (5, NULL, '', NULL), (6, 'ACCESS DENIED', NULL, '')"
_blocked_sql = " OR ".join([f"lower({CLEAN.format('coalesce(title, $$$$)')}) LIKE '%{x}%'" for x in v.BLOCKED_TITLES] + [f"lower({CLEAN.format('coalesce(body, $$$$)')}) LIKE '%{x}%'" for x in v.BLOCKED_BODIES] + [f"contains(coalesce(url, ''), '{x}')" for x in v.BLOCKED_URLS]).replace("$$$$", "''")


@query("blocked_page_flag", f"SELECT id, {_blocked_sql} AS blocked FROM (VALUES {PAGE_ROWS}) AS t(id, title, body, url)")
def blocked_page_flag(spark, sf):
    return rows(spark, PAGE_ROWS, "id, title, body, url").select("id", pages.is_blocked(F.col("title"), F.col("body"), F.col("url")).alias("blocked"))


@query("success_level", "SELECT l_orderkey, l_linenumber, CASE WHEN a > 0 AND b > 0 THEN 'full' WHEN a > 0 OR b > 0 THEN 'partial' WHEN s THEN 'social-metadata-only' ELSE 'metadata-only' END AS level FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 3 ELSE 0 END AS a, CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END AS b, l_returnflag = 'R' AS s FROM lineitem)")
def success_level(spark, sf):
    a, b = F.when(F.col("l_quantity") > 25, 3).otherwise(0), F.when(F.col("l_discount") > 0.05, 2).otherwise(0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", jsonld.success_level(a, b, F.col("l_returnflag") == "R").alias("level"))


def _captions(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("post_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "og-description").otherwise("script-caption").alias("source"), "text")


KEYED = "SELECT conv_id AS post_id, turn AS ord, CASE WHEN role = 'user' THEN 'og-description' ELSE 'script-caption' END AS source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, length(trim(text)) AS n FROM conversations"


_word = lambda words: f"CASE WHEN regexp_matches(text, '(?i)\\b(?:{words})\\b') THEN 1 ELSE 0 END"
SIGNAL = f"""25 * {_word("ingredients?|what you(?:''|’)?ll need")} + 25 * {_word("instructions?|directions?|method|steps?")}
    + 20 * greatest({_word("cup|cups|tablespoons?|tbsp|teaspoons?|tsp|ounces?|oz|pounds?|lbs?|grams?|ml")}, CASE WHEN regexp_matches(text, '(?i)[A-Za-z0-9_]°[fc](?:[^A-Za-z0-9_]|$)') THEN 1 ELSE 0 END)
    + 15 * {_word("bake|cook|stir|mix|whisk|roast|boil|simmer|fry|grill|season|serve|preheat")} + 5 * CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END"""
_generic = " OR ".join(["text = 'instagram'", *(f"contains(lower(text), '{x}')" for x in v.GENERIC_CAPTIONS)])
SCORED = f"""SELECT post_id, ord, source, text, CASE WHEN length(text) < 3 OR {_generic} THEN -1000.0 ELSE CAST(CASE source {" ".join(f"WHEN '{k}' THEN {w}" for k, w in v.SOURCE_WEIGHTS.items())} ELSE 10 END AS DOUBLE)
    + CAST(least(length(text), 1200) AS DOUBLE) / 40.0 + {SIGNAL} - CASE WHEN length(text) > 6000 THEN 100 WHEN length(text) > 3000 THEN 30 ELSE 0 END END AS score
    FROM (SELECT post_id, key, min(ord) AS ord, arg_min(source, ord) AS source, arg_min(text, ord) AS text FROM ({KEYED.replace(", length(trim(text)) AS n", ", trim(text) AS text")}) WHERE key <> '' GROUP BY post_id, key)"""


@query("caption_dedupe", SCORED)
def caption_dedupe(spark, sf):
    return captions.dedupe_captions(_captions(spark, sf)).select("post_id", "ord", "source", "text", "score")


_place = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(v.CANONICAL_SOURCES))


@query("caption_best", f"SELECT post_id, source, text, score FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY CASE source {_place} ELSE 3 END, score DESC, ord) AS k FROM ({SCORED}) WHERE score > 0) WHERE k = 1")
def caption_best(spark, sf):
    return captions.best_caption(_captions(spark, sf))


TITLES = "(1, 'Garlic Butter Shrimp | Ingredients: shrimp'), (2, 'Add the onion and stir until golden'), (3, 'Easy Chicken Tacos recipe. Follow for more'), (4, 'instagram'), (5, ''), (6, NULL), (7, '1,204 likes, 33 comments - cook_me: Creamy Mushroom Pasta #pasta #CreamyPasta'), (8, '2 cups rice'), (9, 'Maria''s Kitchen'), (10, 'Cafe Grün')"


@query(
    "title_best",
    """SELECT * FROM (VALUES (1, 'Garlic Butter Shrimp |', true, 'Garlic Butter Shrimp'), (2, 'Add the onion and stir until golden', true, ''), (3, 'Easy Chicken Tacos recipe.', true, 'Easy Chicken Tacos recipe'),
    (4, 'instagram', true, ''), (5, '', true, ''), (6, '', true, ''), (7, 'Creamy Mushroom Pasta', true, 'Creamy Mushroom Pasta'), (8, '2 cups rice', true, ''), (9, 'Maria''s Kitchen', true, ''), (10, 'Cafe Grün', false, 'Cafe Grün')) AS t(id, clean, bad, best)""",
)
def title_best(spark, sf):
    c = F.col("text")
    cand = F.concat(captions.title_candidates(c), captions.hashtag_titles(c))
    return rows(spark, TITLES, "id, text").select("id", t.clean_title(c).alias("clean"), captions.is_bad_title(c, F.lit("")).alias("bad"), captions.best_title(cand, F.lit("")).alias("best"))


@query("social_posts")
def social_posts(spark, sf):
    posts = rows(spark, TITLES, "post_id, description").select("post_id", F.lit("Ana Cooks on Instagram: \"Sheet Pan Salmon\"").alias("raw_name"), "description", F.lit("").alias("fallback_text"), F.lit("https://www.instagram.com/reel/a/").alias("source_url"))
    out = captions.resolve_posts(posts)
    return out.withColumn("title_candidates", F.array_join("title_candidates", "\n"))


PARTS = "(1, 'Soup', 'soup!', 'A long text that says quite a lot about a soup with beans', 'long text'), (2, '', NULL, 'x', 'y')"


@query("rescue_parts_compact", "SELECT * FROM (VALUES (1, 'Soup|A long text that says quite a lot about a soup with beans|long text'), (2, 'x|y')) AS t(id, parts)")
def rescue_parts_compact(spark, sf):
    return rows(spark, PARTS, "id, a, b, c, d").select("id", F.array_join(captions.compact_parts(F.array("a", "b", "c", "d")), "|").alias("parts"))


MEDIA = "(1, 1, 'https://x.cdninstagram.com/a.mp4?bytestart=1&byteend=2', 'script', 'video/mp4', 200), (1, 2, 'https://x.cdninstagram.com/a.mp4', 'network', '', NULL), (1, 3, 'https://evil.com/b.mp4', 'network', 'video/mp4', 200), (2, 1, 'blob:https://x', 'dom', '', 0), (2, 2, 'https://y.fbcdn.net/v/video/c?efg=eyJ2ZW5jb2RlX3RhZyI6ImF1ZGlvIiwiYml0cmF0ZSI6NjQwMDB9', 'script', '', NULL), (3, 1, NULL, NULL, NULL, NULL)"


@query("media_tracks", "SELECT * FROM (VALUES (1, 'video', 'https://x.cdninstagram.com/a.mp4', 'script,network', 0.0, 0.0), (2, 'audio', 'https://y.fbcdn.net/v/video/c?efg=eyJ2ZW5jb2RlX3RhZyI6ImF1ZGlvIiwiYml0cmF0ZSI6NjQwMDB9', 'script', 64000.0, 0.0)) AS t(post_id, kind, url, sources, bitrate, duration_seconds)")
def media_tracks(spark, sf):
    return captions.media_tracks(rows(spark, MEDIA, "post_id, ord, url, source, content_type, status"))


LINES = "(1, '1 cup (large) flour'), (2, '2 tbsp (30 ml) oil'), (3, '1/2 tsp EACH: salt, pepper'), (4, 'th e ch icken wh en fr esh'), (5, 'Bake at 350 degrees for 5 min'), (6, ''), (7, NULL), (8, '(Note: keep warm)')"


@query("ingredient_scalars", "SELECT * FROM (VALUES (1, '1 cup flour', '1 cup (large) flour', '1 cup (large) flour', '1 cup (large) flour', '1 cup (large) flour'), (2, '2 tbsp oil', '2 tbsp (30 ml) oil', '2 tbsp (30 ml) oil', '2 tbsp (30 ml) oil', '2 tbsp (30 ml) oil'), (3, '1/2 tsp EACH: salt, pepper', '1/2 tsp salt|1/2 tsp pepper', '1/2 tsp EACH: salt, pepper', '1/2 tsp EACH: salt, pepper', '1/2 tsp EACH: salt, pepper'), (4, 'th e ch icken wh en fr esh', 'th e ch icken wh en fr esh', 'the chicken when fresh', 'th e ch icken wh en fr esh', 'th e ch icken wh en fr esh'), (5, 'Bake at 350 degrees for 5 min', 'Bake at 350 degrees for 5 min', 'Bake at 350 degrees for 5 min', 'Bake at 350°F for 5 min', 'Bake at 350 degrees for 5 min'), (6, '', '', '', '', ''), (7, '', '', '', '', ''), (8, '(Note: keep warm)', '(Note: keep warm)', '(Note: keep warm)', '(Note: keep warm)', 'Note: keep warm')) AS t(id, measures, each_line, words, cooking, note)")
def ingredient_scalars(spark, sf):
    c = t.text(F.col("line"))
    return rows(spark, LINES, "id, line").select("id", t.secondary_measures(c).alias("measures"), F.array_join(t.split_each(c), "|").alias("each_line"), t.broken_words(c).alias("words"), t.cooking_text(c).alias("cooking"), t.clean_note(c).alias("note"))


@query("long_step_split", "SELECT doc_id, CAST(CASE WHEN length(c) < 220 THEN 1 ELSE 1 + len(regexp_extract_all(c, '[.!?] +[^ ]')) END AS BIGINT) AS n_steps FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '\\)+$', ''), '\\s+', ' ', 'g')) AS c FROM documents)")
def long_step_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(t.split_long_steps(F.array(t.text(F.col("text"))))).cast("long").alias("n_steps"))


MENTIONS = "(1, '1 cup rice\\n2 eggs\\nsalt', 'Cook the rice and add eggs'), (2, '1 cup quinoa\\n2 zucchini\\nparsley', 'Bake it'), (3, '', 'x'), (4, NULL, NULL)"


@query("ingredient_mentions", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) AS t(id, enough)")
def ingredient_mentions(spark, sf):
    return rows(spark, MENTIONS, "id, a, b").select("id", classify.mentions_enough(F.col("a"), F.col("b")).alias("enough"))


CAPTION = "(1, 'Best Soup\\nIngredients:\\n1 cup beans\\n#tag\\nwater\\nInstructions:\\n1. Boil water\\n2) Add beans\\nTips:\\nno'), (2, 'No headers'), (3, ''), (4, NULL), (5, 'Steps\\na\\nIngredients\\nb')"


@query("caption_sections", "SELECT * FROM (VALUES (1, 'Best Soup', '1 cup beans|water', 'Boil water|Add beans'), (2, '', '', ''), (3, '', '', ''), (4, '', '', ''), (5, '', '', '')) AS t(id, name, ingredients, instructions)")
def caption_sections(spark, sf):
    return rows(spark, CAPTION, "id, c").withColumn("s", classify.caption_sections(F.col("c"))).select("id", "s.name", F.array_join("s.ingredients", "|").alias("ingredients"), F.array_join("s.instructions", "|").alias("instructions"))


BLOCKS = """(1, 0, '{"@type":"Thing","name":"x"}'), (1, 1, '{"@graph":[{"@type":["Recipe"],"name":"Stew &amp; Rice","recipeIngredient":["1 cup  rice",""],"recipeInstructions":[{"@type":"HowToStep","text":"Boil."},{"itemListElement":[{"text":"Serve."}]}],"image":[{"url":"http://i/1.jpg"}]}]}'), (2, 0, 'broken {"@type":"Recipe","name":"Pie","recipeIngredient":["flour"]} tail'), (3, 0, ''), (4, 0, NULL)"""


@query("jsonld_recipe", "SELECT * FROM (VALUES (1, 0, false, '', '', '', '', 'metadata-only'), (1, 1, true, 'Stew & Rice', '1 cup rice', 'Boil.|Serve.', 'http://i/1.jpg', 'full'), (2, 0, true, 'Pie', 'flour', '', '', 'partial'), (3, 0, false, '', '', '', '', 'metadata-only'), (4, 0, false, '', '', '', '', 'metadata-only')) AS t(page_id, ord, found, name, ingredients, instructions, image, success_level)")
def jsonld_recipe(spark, sf):
    return jsonld.from_blocks(rows(spark, BLOCKS, "page_id, ord, raw")).withColumns({c: F.array_join(c, "|") for c in ("ingredients", "instructions")})


TAGS = "(1, array('Air Fryer', 'beef', 'BEEF ', 'nope')), (2, array('one pot', 'one-pot', 'quick')), (3, array()), (4, NULL)"


@query("tags_normalize", "SELECT * FROM (VALUES (1, 'air-fryer,beef', 'air-fryer,beef'), (2, 'one-pot,quick', 'one-pot,one-pot,quick'), (3, '', ''), (4, '', '')) AS t(id, recipe, plan)")
def tags_normalize(spark, sf):
    return rows(spark, TAGS, "id, tags").select("id", F.array_join(classify.recipe_tags(F.col("tags")), ",").alias("recipe"), F.array_join(classify.plan_tags(F.col("tags")), ",").alias("plan"))


PLANS = """(1, '{"excludedKeywords":[" Nuts ","nuts"],"preferredTags":["one pot","x"],"mostlyQuick":true,"vegetarianNightCount":9,"proteinTargets":[{"keyword":"Beef","count":2.5},{"keyword":"beef","count":1},{"keyword":"fish","count":"x"}]}'), (2, '{}'), (3, 'bad'), (4, NULL)"""


@query("plan_constraints", "SELECT * FROM (VALUES (1, 'nuts', 'one-pot', true, 7, 'beef:3,fish:1'), (2, '', '', false, 0, ''), (3, '', '', false, 0, ''), (4, '', '', false, 0, '')) AS t(id, excluded, tags, mostly_quick, vegetarian_nights, proteins)")
def plan_constraints(spark, sf):
    c = rows(spark, PLANS, "id, raw").withColumn("p", classify.plan_constraints(F.col("raw")))
    return c.select("id", F.array_join("p.excluded", ",").alias("excluded"), F.array_join("p.tags", ",").alias("tags"), "p.mostly_quick", "p.vegetarian_nights", F.array_join(F.transform("p.protein_targets", lambda x: F.concat(x["keyword"], F.lit(":"), x["count"].cast("string"))), ",").alias("proteins"))


RAW = "(1, 'Stew', '2 cups (500 ml) stock\\n1 tsp EACH: salt, cumin', 'Heat th e stock to 90 degrees. Pro tip: rest.', 'QUICK', array('soup', 'zzz'), true, ' a  b ', 'partial'), (2, 'Rice', 'rice\\nwater', 'Boil rice in water', NULL, NULL, NULL, NULL, 'full'), (3, 'None', '', 'Steps available at source link!', 'huge', array(), false, '', 'metadata-only')"


@query("recipe_cleanup", "SELECT * FROM (VALUES (1, false, '2 cups stock|1 tsp salt|1 tsp cumin', 'Heat the stock to 90°F.', 'quick', 'soup', true, 'a b'), (2, true, 'rice|water', 'Boil rice in water', 'normal', '', false, ''), (3, false, '', '', 'normal', '', false, '')) AS t(recipe_id, skipped, ingredients, instructions, effort, tags, is_vegetarian, notes)")
def recipe_cleanup(spark, sf):
    raw = rows(spark, RAW, "recipe_id, name, ingredients, instructions, effort, tags, is_vegetarian, notes, success_level")
    return recipes.cleanup(raw).drop("name").withColumns({"ingredients": F.array_join("ingredients", "|"), "instructions": F.array_join("instructions", "|"), "tags": F.array_join("tags", ",")})


ERRORS = "(1, 'INVALID_TIKTOK_URL'), (2, 'TIKTOK_OEMBED_FAILED'), (3, 'OTHER'), (4, NULL)"


@query("error_status", "SELECT * FROM (VALUES (1, 400, 'unsupported-video-url'), (2, 422, 'public-video-unavailable'), (3, 500, 'public-video-import-error'), (4, 500, 'public-video-import-error')) AS t(id, status, level)")
def error_status(spark, sf):
    return rows(spark, ERRORS, "id, code").withColumn("e", classify.error_status(F.col("code"))).select("id", "e.status", "e.level")


@query(
    "text_import",
    "SELECT * FROM (VALUES (1, 'Best Soup', '1 cup beans|water', 'Boil water|Add beans', 'full'), (2, '', '', '', 'full'), (3, '', '', '', 'full'), (4, '', '', '', 'full'), (5, '', '', '', 'full')) AS t(doc_id, name, ingredients, instructions, success_level)",
)
def text_import(spark, sf):
    return recipes.import_texts(rows(spark, CAPTION, "doc_id, text")).withColumns({c: F.array_join(c, "|") for c in ("ingredients", "instructions")})


PINS = """(1, 'x "link":"https:\\\\/\\\\/blog.com\\\\/recipe?utm_source=p" href="https://i.pinimg.com/a.jpg"', 'https://a.com'), (2, '"pin_id": "42"', 'https://a.com'), (3, '', 'https://www.pinterest.com/pin/7/'), (4, NULL, NULL)"""


@query("pin_links", "SELECT * FROM (VALUES (1, NULL, 'https://blog.com/recipe'), (2, 'https://www.pinterest.com/pin/42/', NULL), (3, 'https://www.pinterest.com/pin/7/', NULL), (4, NULL, NULL)) AS t(id, pin, best)")
def pin_links(spark, sf):
    return rows(spark, PINS, "id, html, url").select("id", u.pin_url(F.col("html"), F.col("url")).alias("pin"), u.best_external(u.external_candidates(F.col("html"))).alias("best"))


@query("link_evidence", f"SELECT page_id, {DECODED} AS title, '' AS canonical_url, '' AS og_title, '' AS description, '' AS image_url, '' AS oembed_url FROM pages")
def link_evidence(spark, sf):
    return evidence.link_evidence(table(spark, sf, "pages")).withColumn("title", t.clean_text(F.col("title")))


SOCIAL_PAGES = """(1, 'https://x.com/a/b', '<head><meta property="og:description" content="Soup &amp; more"><meta name="description" content=""><meta name="og:video" content="no"><meta property="og:video" content="https://v/1.mp4"><meta name="twitter:player:stream" content="https://v/2"><title>T</title></head>
<body><main>Top<article><p>Stir  well</p><script>var a = {"caption": {"text": "One A"}, "caption_text":"Two", "video_url":"https://v/s.mp4"};</script>Serve</article></main><video src="/c.mp4"><source src="d.mp4" type="video/mp4"></video></body>'),
(2, 'https://x.com/', '<script>{"edge_media_to_caption":{"edges":[{"node":{"text":"Three"}}]}}</script><script>other "caption_text" : "Four"</script>'), (3, 'https://x.com/', ''), (4, NULL, NULL), (5, 'https://x.com/', '<p>nothing</p><script>x</script>')"""


@query(
    "caption_evidence",
    """SELECT * FROM (VALUES (1, 0, 'og-description', 'Soup & more'), (1, 1, 'article-text', 'Stir well|Serve'), (1, 2, 'main-text', 'Top|Stir well|Serve'), (1, 3, 'script-caption', 'One A'),
    (1, 4, 'script-caption-text', 'Two'), (2, 0, 'script-edge-caption', 'Three'), (2, 1, 'script-caption-text', 'Four')) AS t(page_id, ord, source, text)""",
)
def caption_evidence(spark, sf):
    return evidence.caption_candidates(rows(spark, SOCIAL_PAGES, "page_id, url, html")).withColumn("text", F.replace("text", F.lit("\n"), F.lit("|")))


@query(
    "media_evidence",
    """SELECT * FROM (VALUES (1, 0, 'https://v/1.mp4', 'og:video', ''), (1, 1, 'https://v/2', 'twitter:player:stream', ''), (1, 2, 'https://x.com/c.mp4', 'video-1-src', ''),
    (1, 3, 'https://x.com/a/d.mp4', 'video-1-source-1', 'video/mp4'), (1, 4, 'https://v/s.mp4', 'page-script', '')) AS t(page_id, ord, url, source, content_type)""",
)
def media_evidence(spark, sf):
    return evidence.media_evidence(rows(spark, SOCIAL_PAGES, "page_id, url, html"))


REPLIES = """(1, '{"hasRecipeContent":true,"title":" Stew ","titleSource":"spoken","visibleRecipeText":" 1 cup rice","warnings":["a"," ",null],"possibleMissingContent":false}'),
(2, 'Here: {"hasRecipeContent":"yes","titleSource":"guess","ingredientsAppearComplete":true} done'), (3, ''), (4, NULL), (5, 'no json')"""


@query(
    "video_evidence",
    """SELECT * FROM (VALUES (1, true, 'Stew', 'spoken', '1 cup rice', false, false, false, 'a'), (2, false, '', 'unknown', '', true, false, true, ''), (3, false, '', 'unknown', '', false, false, true, ''),
    (4, false, '', 'unknown', '', false, false, true, ''), (5, false, '', 'unknown', '', false, false, true, '')) AS t(id, content, title, title_source, visible, complete_a, complete_b, missing, warnings)""",
)
def video_evidence(spark, sf):
    e = rows(spark, REPLIES, "id, raw").withColumn("e", evidence.video_evidence(F.col("raw")))
    return e.select("id", F.col("e.has_recipe_content").alias("content"), "e.title", "e.title_source", F.col("e.visible_recipe_text").alias("visible"), F.col("e.ingredients_appear_complete").alias("complete_a"), F.col("e.instructions_appear_complete").alias("complete_b"), F.col("e.possible_missing_content").alias("missing"), F.array_join("e.warnings", ",").alias("warnings"))


def parsed(name: str, ingredients: str, instructions: str) -> str:
    return f"named_struct('name', '{name}', 'ingredients', array({ingredients}), 'instructions', array({instructions}))"


SHOTS = f"""(1, 'Seen', 'Given', {parsed("Parsed", "'a '", "'b'")}, true, true), (2, '', 'Given', {parsed("Parsed", "'a'", "''")}, true, true), (3, '', '', {parsed(" Pie", "''", "''")}, NULL, true),
(4, NULL, NULL, {parsed("Recipe", "'a'", "'b'")}, true, false), (5, NULL, NULL, NULL, NULL, NULL)"""


@query(
    "import_screenshots",
    """SELECT * FROM (VALUES (1, 'Seen', 'visible-in-screenshot', 'a', 'b', 'full'), (2, 'Given', 'source-metadata', 'a', '', 'partial'), (3, 'Pie', 'ai-inferred-from-visible-text', '', '', 'metadata-only'),
    (4, 'Screenshot Recipe', 'fallback', 'a', 'b', 'partial'), (5, 'Screenshot Recipe', 'fallback', '', '', 'metadata-only')) AS t(shot_id, name, title_source, ingredients, instructions, success_level)""",
)
def import_screenshots(spark, sf):
    out = recipes.import_screenshots(rows(spark, SHOTS, "shot_id, visible_title, given_title, parsed, complete_a, complete_b"))
    return out.withColumns({c: F.array_join(c, "|") for c in ("ingredients", "instructions")})


LAYERS = f"""(1, 'cap', {parsed("A", "'a'", "'b'")}, NULL, NULL, ''), (2, 'cap', {parsed("A", "'a'", "''")}, 'vid', {parsed("B", "'c'", "'d'")}, 'V'), (3, '', NULL, 'vid', {parsed("", "'c'", "''")}, 'V'),
(4, 'cap', {parsed("A", "'a'", "''")}, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL, NULL), (6, ' ', NULL, '', NULL, NULL)"""


@query(
    "import_layers",
    """SELECT * FROM (VALUES (1, 'caption-first-full', 'A', 'a', 'b', 'full', 'Instagram caption:|cap'), (2, 'caption-and-video', 'B', 'c', 'd', 'full', 'Instagram caption:|cap||Video evidence:|vid'),
    (3, 'video-only', 'V', 'c', '', 'partial', 'Video evidence:|vid'), (4, 'caption-only-video-unavailable', 'A', 'a', '', 'partial', 'Instagram caption:|cap'),
    (5, 'video-unavailable', 'Imported Video Recipe', '', '', 'no-recipe-found', ''), (6, 'video-only', 'Imported Video Recipe', '', '', 'no-recipe-found', '')) AS t(post_id, path, name, ingredients, instructions, success_level, evidence)""",
)
def import_layers(spark, sf):
    out = recipes.import_layers(rows(spark, LAYERS, "post_id, caption, from_caption, video, from_both, video_title"))
    return out.withColumns({c: F.array_join(c, "|") for c in ("ingredients", "instructions")}).withColumn("evidence", F.replace("evidence", F.lit("\n"), F.lit("|")))


@query(
    "import_captions",
    """SELECT * FROM (VALUES (1, 'A', 'a', 'b', 'full', ''), (2, 'A', 'a', '', 'partial', 'incomplete'), (3, '', '', '', 'no-recipe-found', 'incomplete'), (4, 'A', 'a', '', 'partial', 'incomplete'),
    (5, '', '', '', 'no-recipe-found', 'incomplete'), (6, '', '', '', 'no-recipe-found', 'incomplete')) AS t(post_id, name, ingredients, instructions, success_level, warning)""",
)
def import_captions(spark, sf):
    out = recipes.import_captions(rows(spark, LAYERS, "post_id, caption, from_caption, video, from_both, video_title"))
    return out.withColumns({c: F.array_join(c, "|") for c in ("ingredients", "instructions")})


RESULTS = """(1, true, false, 'Ana on Instagram', 'Easy Chicken Tacos recipe. Follow for more', '', 'https://www.instagram.com/p/1/', array('a'), array()), (2, true, true, 'Kept', '', '', 'https://www.instagram.com/p/2/', array(), array()),
(3, true, false, 'Kept too', '', '', 'https://blog.com/x', array(), array()), (4, true, false, 'Full', '', '', 'https://www.tiktok.com/x', array('a'), array('b')), (5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (6, true, NULL, '', '', '', 'https://www.tiktok.com/y', NULL, NULL)"""


@query(
    "social_titles",
    "SELECT * FROM (VALUES (1, 'Easy Chicken Tacos recipe', true), (2, 'Kept', false), (3, 'Kept too', false), (4, 'Full', false), (5, NULL, false), (6, 'TikTok Recipe', true)) AS t(post_id, name, cleaned)",
)
def social_titles(spark, sf):
    found = rows(spark, RESULTS, "post_id, success, rescued, name, description, fallback_text, source_url, ingredients, instructions")
    return recipes.social_titles(found).select("post_id", "name", "cleaned")


UPLOADS = "(1, 'VIDEO/MP4', 'x'), (2, 'application/octet-stream', 'Clip.MOV'), (3, '', 'a.webm'), (4, 'image/png', 'a.mp4'), (5, NULL, NULL)"


@query("upload_types", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, false)) AS t(id, allowed)")
def upload_types(spark, sf):
    return rows(spark, UPLOADS, "id, mime, name").select("id", classify.allowed_upload(F.col("mime"), F.col("name")).alias("allowed"))


@query(
    "page_fallbacks",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'rendered' ELSE 'fast' END AS side, CASE WHEN page_id % 3 = 0 THEN 'partial' ELSE 'full' END AS success_level FROM pages",
)
def page_fallbacks(spark, sf):
    ids = table(spark, sf, "pages").select("page_id", F.lit(False).alias("blocked"))
    fast = ids.select("*", F.lit("fast").alias("side"), F.when(F.col("page_id") % 3 == 0, "metadata-only").otherwise("full").alias("success_level"))
    rendered = ids.select("*", F.lit("rendered").alias("side"), F.lit("partial").alias("success_level"))
    return recipes.rendered_over_fast(fast, rendered).select("page_id", "side", "success_level")


@query("escaped_fields", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' ELSE 'x' END AS field FROM documents")
def escaped_fields(spark, sf):
    html = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.concat(F.lit('{"Owner":"\\u0078","n":1} '), F.replace("text", F.lit('"'), F.lit("")))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", evidence.escaped_json_string(html, "owner").alias("field"))


SCALARS = """(1, '&amp;#39;A&frac12; &#8217;b&nbsp;c', '(Note: keep warm))', 'QUICK', 'ES-mx', 'air-fryer pork'), (2, '', '', '', '', ''), (3, NULL, NULL, NULL, NULL, NULL),
(4, 'Caf&eacute; &#233;', 'plain  note', 'Big', 'fr', 'x'), (5, '"Hi there".', '(Note keep)', 'huge', 'e', 'MIXED case')"""


@query(
    "text_scalars",
    """SELECT * FROM (VALUES (1, '''A½ ''b c', '''A&frac12; ''b c', '&amp;#39;A&frac12; &#8217;b&nbsp;c', 'Note: keep warm', '(Note: keep warm))', 'quick', 'es', 'es', 'Air-fryer Pork', 'amp 39 a frac12 8217 b nbsp c'),
    (2, '', '', '', '', '', 'normal', 'en', 'en', '', ''), (3, '', '', '', '', '', 'normal', 'en', 'en', '', ''),
    (4, 'Caf&eacute; é', 'Caf&eacute; é', 'Caf&eacute; &#233;', 'plain note', 'plain note', 'big', 'fr', 'en', 'X', 'caf eacute 233'),
    (5, '"Hi there".', '"Hi there".', 'Hi there', 'Note: keep', '(Note keep)', 'normal', 'e', 'en', 'Mixed Case', 'hi there')) AS t(id, entities, simple, quotes, note, notes, effort, language, route, title, key)""",
)
def text_scalars(spark, sf):
    a, b = F.col("a"), F.col("b")
    return rows(spark, SCALARS, "id, a, b, effort, lang, words").select(
        "id", t.clean_html_entities(a).alias("entities"), t.decode_simple_entities(a).alias("simple"), t.strip_quotes(a).alias("quotes"), t.clean_note(b).alias("note"), t.recipe_notes(b).alias("notes"),
        t.effort(F.col("effort")).alias("effort"), t.language(F.col("lang")).alias("language"), t.route_language(F.col("lang")).alias("route"), t.title_case(F.col("words")).alias("title"), t.compare_key(a).alias("key"),
    )


URLS = """(1, 'https://www.pinterest.com/pin/12/?utm_source=a&x=1', 'video/mp4', 'A.MP4'), (2, 'https://scontent.cdninstagram.com/v/a.mp4?bytestart=0&byteend=9&k=1', '', 'b.tar.gz'), (3, '//blog.com/soup?fbclid=1', 'text/html', 'noext'),
(4, 'https://x.fbcdn.net/v/1.m3u8', 'application/x-mpegURL', '.x'), (5, 'https://i.pinimg.com/a.jpg', '', ''), (6, 'notaurl', NULL, NULL), (7, NULL, NULL, NULL), (8, '', '', '')"""


@query(
    "url_scalars",
    f"""SELECT t.*, coalesce(u.url, '') AS media, CASE WHEN t.id = 2 THEN replace(u.url, 'bytestart=0&byteend=9&', '') ELSE u.url END AS ranged, coalesce(u.url, '') AS first_link FROM (VALUES {URLS}) AS u(id, url, kind, name) JOIN (VALUES
        (1, true, 'https://www.pinterest.com/pin/12/?x=1', 'https://www.pinterest.com/pin/12/?x=1', true, true, '.mp4', false, false),
        (2, false, 'https://scontent.cdninstagram.com/v/a.mp4?bytestart=0&byteend=9&k=1', 'https://scontent.cdninstagram.com/v/a.mp4?bytestart=0&byteend=9&k=1', true, true, '.gz', true, false),
        (3, false, '//blog.com/soup', 'https://blog.com/soup', false, false, '', false, false),
        (4, false, 'https://x.fbcdn.net/v/1.m3u8', 'https://x.fbcdn.net/v/1.m3u8', false, true, '.x', true, true),
        (5, false, 'https://i.pinimg.com/a.jpg', 'https://i.pinimg.com/a.jpg', true, false, '', false, false),
        (6, false, 'notaurl', NULL, true, false, '', false, false),
        (7, false, NULL, NULL, true, false, '', false, false),
        (8, false, '', NULL, true, false, '', false, false)) AS t(id, pin, untracked, candidate, bad, video, extension, instagram, facebook) ON t.id = u.id""",
)
def url_scalars(spark, sf):
    c = F.col("url")
    return rows(spark, URLS, "id, url, kind, name").select(
        "id", u.is_pin(c).alias("pin"), u.remove_tracking(c).alias("untracked"), u.clean_pin_candidate(c).alias("candidate"), u.is_bad_candidate(c).alias("bad"), u.clean_media_url(c).alias("media"),
        u.looks_like_video(c, F.col("kind")).alias("video"), u.remove_byte_range(c).alias("ranged"), u.is_instagram_media(c).alias("instagram"), u.is_facebook_media(c).alias("facebook"), u.file_extension(F.col("name")).alias("extension"), u.first_link(c).alias("first_link"),
    )


RESCUE = """(1, true, '', '', 'metadata-only'), (2, true, 'x', 'y', 'full'), (3, NULL, NULL, NULL, NULL), (4, true, '', 'Steps available at source link!', 'social-metadata-only')"""
RESCUE_POSTS = r"""(1, '', 'Best Soup\nIngredients:\n1 cup beans\nwater\nInstructions:\n1. Boil the water for ten minutes until it is hot\n2) Add beans and cook them slowly for an hour until tender', '', 'https://www.instagram.com/p/1/'),
(4, 'short', 'no recipe here', '', 'https://www.tiktok.com/x')"""


@query(
    "caption_rescue",
    """SELECT * FROM (VALUES (1, true, '1 cup beans|water', 'Boil the water for ten minutes until it is hot|Add beans and cook them slowly for an hour until tender|https://www.instagram.com/p/1/', 'full', 'Best Soup'),
    (2, false, 'x', 'y', 'full', NULL), (3, false, NULL, NULL, NULL, NULL), (4, false, '', 'Steps available at source link!', 'social-metadata-only', 'short')) AS t(post_id, rescued, ingredients, instructions, success_level, title)""",
)
def caption_rescue(spark, sf):
    out = recipes.rescue_captions(rows(spark, RESCUE, "post_id, success, ingredients, instructions, success_level"), rows(spark, RESCUE_POSTS, "post_id, raw_name, description, fallback_text, source_url"))
    return out.withColumns({c: F.replace(c, F.lit("\n"), F.lit("|")) for c in ("ingredients", "instructions")})


LINKED = """(1, 'https://a.com/list', array(), array(), 'https://a.com/recipe?utm_source=z', 'metadata-only'), (2, 'https://a.com/recipe', array('rice'), array('cook'), '', 'full'), (3, 'https://a.com/other', array('x'), array(), 'https://a.com/recipe', 'partial'), (4, NULL, array(), array(), '', 'metadata-only')"""


@query("linked_recipes", "SELECT * FROM (VALUES (1, 'rice', 'cook', 'full'), (2, 'rice', 'cook', 'full'), (3, 'x', '', 'partial'), (4, '', '', 'metadata-only')) AS t(page_id, ingredients, instructions, success_level)")
def linked_recipes(spark, sf):
    found = recipes.follow_links(rows(spark, LINKED, "page_id, source_url, ingredients, instructions, linked_recipe_url, success_level"))
    return found.select("page_id", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("instructions", "|").alias("instructions"), "success_level")


SHOWN = """(1, true, 'Stew', '1 cup rice', '', false, false), (2, true, '', 'hello', '', true, false), (3, false, 'X', '1 cup rice', '', true, true), (4, NULL, NULL, NULL, NULL, NULL, NULL), (5, true, 'Pie', '', 'Stir the batter for a while', false, false)"""
PARSED = "(1, '', array('rice'), array('cook')), (2, 'Named', array('a'), array()), (3, 'N', array('a'), array('b'))"


@query(
    "video_imports",
    """SELECT * FROM (VALUES (1, true, 'Stew', 'rice', 'cook', 'full'), (2, true, 'Named', 'a', '', 'partial'), (3, false, 'N', 'a', 'b', 'no-recipe-found'), (4, false, '', '', '', 'no-recipe-found'),
    (5, true, 'Pie', '', '', 'partial')) AS t(doc_id, usable, name, ingredients, instructions, success_level)""",
)
def video_imports(spark, sf):
    shown = rows(spark, SHOWN, "doc_id, has_recipe_content, title, visible_recipe_text, spoken_recipe_text, ingredients_appear_complete, instructions_appear_complete")
    out = recipes.import_videos(shown, rows(spark, PARSED, "doc_id, name, ingredients, instructions"))
    return out.withColumns({c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in ("ingredients", "instructions")})


_key = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[''’]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "document_scalars",
    f"""SELECT doc_id, {_key} AS key, substring(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 240) AS notes, coalesce(nullif(lower(substring(lang, 1, 2)), ''), 'en') AS language,
    CASE WHEN lower(substring(lang, 1, 2)) = 'es' THEN 'es' ELSE 'en' END AS route, regexp_extract(lower(coalesce(source, '')), '[.][a-z0-9]+$') AS extension, CASE WHEN lower(trim(source)) IN ('quick', 'big') THEN lower(trim(source)) ELSE 'normal' END AS effort FROM documents""",
)
def document_scalars(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", t.compare_key(c).alias("key"), t.recipe_notes(c).alias("notes"), t.language(F.col("lang")).alias("language"), t.route_language(F.col("lang")).alias("route"), u.file_extension(F.col("source")).alias("extension"), t.effort(F.col("source")).alias("effort")
    )


_page_host = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


@query(
    "page_urls",
    f"""SELECT page_id, CASE WHEN {_page_host} = 'pin.it' OR {_page_host} LIKE '%pinterest.com' THEN true ELSE false END AS pinterest, regexp_replace({_page_host}, '[.]$', '') AS host,
    regexp_matches({_page_host}, '{"|".join(x.replace(".", "[.]") for x in v.BAD_HOST_FRAGMENTS)}') OR regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '[.](?:jpg|jpeg|png|webp|gif|svg)$') AS bad,
    regexp_matches(url, '(?i)[.](?:mp4|m4v|mov|webm|m3u8)(?:[?#]|$)|/video/|video_dashinit|videoplayback') AS video, CASE WHEN regexp_matches(lower(url), '[.]mp4(?:[?#]|$)') THEN 1 WHEN regexp_matches(lower(url), '[.]m3u8(?:[?#]|$)') THEN 2 ELSE 4 END AS priority,
    CASE WHEN url LIKE 'https://%' THEN 'UNSUPPORTED_PUBLIC_VIDEO_PLATFORM' ELSE 'INVALID_PUBLIC_VIDEO_URL' END AS instagram_error, CASE WHEN url LIKE 'https://%' THEN 'UNSUPPORTED_FACEBOOK_VIDEO_PLATFORM' ELSE 'INVALID_FACEBOOK_VIDEO_URL' END AS facebook_error FROM pages""",
)
def page_urls(spark, sf):
    c, none = F.col("url"), F.lit("")
    return table(spark, sf, "pages").select(
        "page_id", u.is_pinterest(c).alias("pinterest"), u.clean_hostname(u.host(c)).alias("host"), u.is_bad_candidate(c).alias("bad"), u.looks_like_video(c, none).alias("video"), captions.candidate_priority(c, none).alias("priority"),
        u.validate_instagram(c)["error_code"].alias("instagram_error"), u.validate_facebook(c)["error_code"].alias("facebook_error"),
    )


@query(
    "html_links_scored",
    f"""SELECT page_id, ord, href, length(shown) AS n, CASE WHEN regexp_matches(href, 'recipe|food|kitchen|cooking|dinner|baking') THEN 1 ELSE 0 END AS score FROM (SELECT page_id, unnest(range(1, len(hrefs) + 1)) AS ord, unnest(hrefs) AS href, unnest(texts) AS shown
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages))""",
)
def html_links_scored(spark, sf):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("href"), F.regexp_extract_all("html", pattern, 2).alias("shown"))
    links = table(spark, sf, "pages").select("page_id", F.posexplode(both).alias("ord", "l"))
    return links.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "l.href", F.length("l.shown").cast("long").alias("n"), F.col("l.href").rlike("recipe|food|kitchen|cooking|dinner|baking").cast("int").alias("score"))


def _flat(results: DataFrame) -> DataFrame:
    shown = results.withColumns({c: F.array_join(c, "\n") for c in ("ingredients", "instructions")})
    return shown.select("request_id", "success", "success_level", "name", "ingredients", "instructions", "source_url", "imported_from_url", "image", "fallback_text", F.col("recipe.slug").alias("slug"), F.col("recipe.instructions").alias("steps"))


@query(
    "import_recipe",
    f"""SELECT page_id AS request_id, true AS success, 'metadata-only' AS success_level, name, '' AS ingredients, '' AS instructions, url AS source_url, url AS imported_from_url, '' AS image,
    CASE WHEN user_caption = '' THEN '' ELSE user_caption || chr(10) || chr(10) END || array_to_string(list_filter([name, url], lambda x: x <> ''), chr(10) || chr(10)) AS fallback_text, {SLUG.replace(DECODED, 'name')} AS slug, '{v.SOURCE_STEPS}' AS steps
    FROM (SELECT page_id, coalesce(nullif({DECODED}, ''), 'Imported Recipe') AS name, {_drop_sql('url')} AS url, CASE WHEN page_id % 2 = 0 THEN 'Seen on ' || page_id ELSE '' END AS user_caption FROM pages) WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY {_drop_sql('url')})""",
)
def import_recipe(spark, sf):
    """Every page's address as a request, every second one with a caption of the user's that is too short to be a recipe."""
    found = table(spark, sf, "pages")
    caption = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Seen on "), F.col("page_id").cast("string")))
    first = found.groupBy(u.canonical(F.col("url"))).agg(F.min("page_id").alias("page_id")).select("page_id")
    asked = found.join(first, "page_id", "left_semi").select(F.col("page_id").alias("request_id"), "url", caption.alias("caption_text"), F.lit(None).cast("string").alias("shared_text"), F.lit("en").alias("language"))
    return _flat(recipes.import_recipes(asked, found, found.limit(0), rows(spark, NO_PINS, "url, resolved_url").limit(0), rows(spark, SAID, "url, caption, image_url"), rows(spark, SHOWN_VIDEOS, SHOWN_COLUMNS)))


NO_PINS = "('https://pin.it/q', 'https://blog.com/pie'), ('https://pin.it/q', 'https://blog.com/zzz')"
SAID = r"""('https://www.instagram.com/reel/a/', 'Best Soup\nIngredients:\n1 cup beans\nwater\nInstructions:\n1. Boil the water for ten minutes until it is hot\n2) Add beans and cook them slowly for an hour until tender', 'https://i/s.jpg')"""
SHOWN_COLUMNS = "url, has_recipe_content, title, visible_recipe_text, spoken_recipe_text, combined_recipe_text, ingredients_appear_complete, instructions_appear_complete, image_url, parsed"
SHOWN_VIDEOS = """('https://www.facebook.com/v/1', true, 'Rice Bowl', '1 cup rice', '', '1 cup rice. Cook it.', false, false, 'https://i/v.jpg', named_struct('name', 'Rice Bowl', 'ingredients', array('1 cup rice'), 'instructions', array('Cook it.'), 'ingredients_appear_complete', true, 'instructions_appear_complete', true)),
('https://www.facebook.com/v/2', true, 'Pie', '1 cup flour', '', '1 cup flour', false, false, '', named_struct('name', 'Pie', 'ingredients', array('1 cup flour'), 'instructions', array('Bake.'), 'ingredients_appear_complete', true, 'instructions_appear_complete', false))"""
IMPORT_PAGES = """(1, 'https://blog.com/pie', '<title>Pie</title><script type="application/ld+json">{"@type":"Recipe","name":"Apple Pie","recipeIngredient":["1 cup flour"],"recipeInstructions":["Bake."]}</script>'),
(2, 'https://blog.com/list', '<title>Ten pies for you</title><a href="/recipe/pie">Get the recipe</a>'), (3, 'https://blog.com/recipe/pie', '<title>Linked</title><ul><li class="ingredient">2 apples</li></ul>'),
(4, 'https://www.instagram.com/reel/a/', '<title>Instagram</title>'), (5, 'https://www.facebook.com/v/1', '<title>Facebook</title>'), (6, 'https://www.facebook.com/v/2', '<title>Facebook</title>'),
(7, 'https://blog.com/weak', '<title>Just a moment</title>'), (8, 'https://www.tiktok.com/x', '<title>TikTok</title>')"""
RENDERED = """(1, 'https://blog.com/weak', '<title>Weak Stew</title><li class="ingredient">1 onion</li><p class="instruction">Cook the onion.</p>')"""
ASKED = r"""(1, 'https://blog.com/pie?utm_source=x', NULL, NULL, 'en'), (2, 'https://blog.com/list', NULL, NULL, 'es'), (3, 'https://www.instagram.com/reel/a/', NULL, NULL, 'en'), (4, 'https://www.facebook.com/v/1', '', NULL, 'en'), (5, 'https://www.facebook.com/v/2', NULL, NULL, 'en'),
(6, 'https://blog.com/weak', NULL, NULL, 'en'), (7, 'https://pin.it/q', NULL, NULL, 'en'), (8, '', NULL, NULL, 'en'), (9, 'https://nowhere.org/', NULL, NULL, 'en'), (10, NULL, NULL, NULL, NULL), (11, 'https://pin.it/none', NULL, NULL, 'en'),
(12, 'https://www.tiktok.com/x', NULL, 'Best Rice\nIngredients:\n1 cup rice\nInstructions:\n1. Boil the rice in water until it is done and tender', 'en')"""


@query(
    "import_cases",
    """SELECT * FROM (VALUES (1, 'full', 'Apple Pie', '1 cup flour', 'Bake.', 'none', false), (2, 'partial', 'Linked', '2 apples', '', 'caption-no-recipe', true),
    (3, 'full', 'Best Soup', '1 cup beans|water', 'Boil the water for ten minutes until it is hot|Add beans and cook them slowly for an hour until tender', 'caption', false), (4, 'full', 'Rice Bowl', '1 cup rice', 'Cook it.', 'video', false),
    (5, 'social-metadata-only', 'Facebook Recipe', '', '', 'video-incomplete', false), (6, 'full', 'Weak Stew', '1 onion', 'Cook the onion.', 'none', false), (7, 'full', 'Apple Pie', '1 cup flour', 'Bake.', 'none', false), (8, 'bad-url', '', '', '', 'none', false),
    (9, 'fetch-failed', '', '', '', 'none', false), (10, 'bad-url', '', '', '', 'none', false), (11, 'fetch-failed', '', '', '', 'none', false),
    (12, 'full', 'Best Rice', '1 cup rice', 'Boil the rice in water until it is done and tender', 'caption', false)) AS t(request_id, success_level, name, ingredients, instructions, rescue, followed)""",
)
def import_cases(spark, sf):
    """One request for every way through an import."""
    asked = rows(spark, ASKED, "request_id, url, caption_text, shared_text, language")
    out = recipes.import_recipes(asked, rows(spark, IMPORT_PAGES, "page_id, url, html"), rows(spark, RENDERED, "page_id, url, html"), rows(spark, NO_PINS, "url, resolved_url"), rows(spark, SAID, "url, caption, image_url"), rows(spark, SHOWN_VIDEOS, SHOWN_COLUMNS))
    return out.select("request_id", "success_level", "name", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("instructions", "|").alias("instructions"), "rescue", "followed")


_quoted = "replace(replace(replace(text, chr(92), ''), '\"', ''), chr(9), ' ')"


@query(
    "import_jsonld",
    f"""SELECT doc_id AS request_id, true AS success, CASE WHEN clean = '' THEN 'metadata-only' ELSE 'partial' END AS success_level, name, clean AS ingredients FROM (SELECT doc_id, 'Dish ' || doc_id AS name,
    trim(regexp_replace(regexp_extract({_quoted}, '^[A-Za-z]+'), '\\s+', ' ', 'g')) AS clean FROM documents WHERE text IS NOT NULL)""",
)
def import_jsonld(spark, sf):
    """The first word of every text as the one ingredient of a recipe."""
    word = F.regexp_extract(F.regexp_replace("text", r'[\\"]', ""), "^[A-Za-z]+", 0)
    raw = F.format_string('{"@type":"Recipe","name":"Dish %s","recipeIngredient":["%s"]}', F.col("doc_id"), word)
    asked = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("request_id"), F.lit("https://a.org/x").alias("url"), raw.alias("json_ld"))
    return recipes.import_jsonld(asked).select("request_id", "success", "success_level", "name", F.array_join("ingredients", "\n").alias("ingredients"))


from larder.plans import table_queries  # noqa: E402, F401  registers its queries
