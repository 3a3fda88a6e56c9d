"""Queries whose inputs are computed from table rows, the same way in Spark and in SQL.

Words are runs of A-Z in a document's text, so what is built from them holds no entity,
quote or white space of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import urls as u
from larder.operators import classify
from larder.operators.containment import contained
from larder.operators.selectors import extract_by_selectors
from larder.operators.variants import find_recipes
from larder.plans import recipes
from larder.plans.queries import query
from larder.plans.video_imports import import_video_urls
from larder.sources import table

#: Selector lists of page_selectors and what they meet, by regular expressions over the tables' pages.
_ALL = "regexp_extract_all(html, '{}', 1)"
_IN_ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
PICKED = {
    "nav > ul > li": _ALL.format("<li>(.*?)</li>"),
    "ul a[href^='/']": _ALL.format('<a href="/[^"]*">(.*?)</a>'),
    "article > h1, footer h1": _ALL.format("<h1>([^<]*)</h1>"),
    "div.ad": _ALL.format('<div class="ad">([^<]*)</div>'),
    "html[lang] title": _ALL.format("<title>([^<]*)</title>"),
    "body > [class~='ad'], body > footer": _ALL.format('<(?:div class="ad"|footer)>([^<]*)</'),
    "article b": _ALL.format("<b>([^<]*)<"),
    "article p": f"string_split({_IN_ARTICLE}, '<p>')[2:]",
    "nav > a, article li, div > div": "[]",
}


def _shown(x: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
    for name, sign in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        clean = f"replace({clean}, '{name}', '{sign}')"
    return clean


@query("page_selectors", "SELECT page_id, s AS selector, len(found) AS n, array_to_string(found, chr(10)) AS texts FROM (" + " UNION ALL ".join(f"SELECT page_id, {chr(39)}{s.replace(chr(39), chr(39) * 2)}{chr(39)} AS s, list_transform({x}, lambda x: {_shown('x')}) AS found FROM pages" for s, x in PICKED.items()) + ")")
def page_selectors(spark, sf):
    """Elements that selectors meet on every page."""
    found = extract_by_selectors(table(spark, sf, "pages").select("page_id", "html"), list(PICKED))
    each = found.select("page_id", F.posexplode("texts").alias("k", "found"))
    names = F.array(*map(F.lit, PICKED))
    return each.select("page_id", F.get(names, F.col("k")).alias("selector"), F.size("found").cast("long").alias("n"), F.array_join(F.transform("found", t.clean_text), "\n").alias("texts"))


#: Layouts of recipe pages made of words w1 to w6: html, then the expected level, name, ingredients, instructions and link.
_LD = '<title>Page of w1</title><script type="application/ld+json">{}</script><li class="ingredient">9 cups unused</li>'
LAYOUTS = [
    ('<title>w1 stew</title><ul><li class="x ingredient y">1 cup w2</li><li class="ingredients-2">2 tbsp <b>w3</b></li><li>w4</li></ul><p class="instruction a">Mix w5.</p><p class="instruction">Nothing else</p>', "full", "w1 stew", ["1 cup w2", "2 tbsp w3"], ["Mix w5."], ""),
    ('<meta property="og:title" content="w1 soup"><div><span data-ingredient-name="true">3 w2</span> <span data-ingredient-name="false">4 w3</span></div><li class="ingredient">5 w4</li><div class="mntl-sc-block comp x mntl-sc-block-html"><p>Stir w5</p> <p>and w6</p></div>', "full", "w1 soup", ["3 w2"], ["Stir w5 and w6"], ""),
    ('<title>w1</title><ul class="mntl-structured-ingredients__list"><li class="mntl-structured-ingredients__list-item"><p>6 w2</p></li><li class="mntl-structured-ingredients__list-item">7 w3<li>w4</ul><ol><li class="mntl-sc-block-group--LI">Bake w5</li><li class="mntl-sc-block-group--LI">Watch the video of baking w6</li></ol>', "full", "w1", ["6 w2", "7 w3"], ["Bake w5"], ""),
    ('<title>w1 pie</title><span class="ingredients-item-name">8 w2</span><ul><li class="instructions-1">Pro tip: add w3</li><li class="instructions-2">Add w4</li></ul>', "full", "w1 pie", ["8 w2"], ["Add w4"], ""),
    ('<title>w1</title><div class="directions">Pour w2 in.</div>', "partial", "w1", [], ["Pour w2 in."], ""),
    (_LD.format('{"@type":"Recipe","name":"w1 cake","recipeIngredient":["1 w2","","2 w3"],"recipeInstructions":"Whisk w4."}'), "full", "w1 cake", ["1 w2", "2 w3"], ["Whisk w4."], ""),
    (_LD.format('{"@context":"x","@graph":[{"@type":"WebPage","name":"w6"},{"@type":["Thing","RECIPE"],"name":"w1","recipeIngredient":["1 w2"],"recipeInstructions":[{"@type":"HowToSection","name":"w6","itemListElement":[{"text":"Boil w3."},{"name":"Serve w4."}]},["Eat w5."]]}]}'), "full", "w1", ["1 w2"], ["Boil w3.", "Serve w4.", "Eat w5."], ""),
    (_LD.format('[{"@type":"Recipe","name":"w1\n\\x pan","recipeIngredient":["5 w2"],},{"@type":"Recipe","name":"lost"}]').replace("],}", "]}"), "partial", "w1 x pan", ["5 w2"], [], ""),
    (_LD.format('{"@type":"Recipe","name":"\\ud800 w1","recipeInstructions":[[[{"text":["Roast w2."]}]]]}'), "partial", "� w1", [], ["Roast w2."], ""),
    (_LD.format("[" * 40 + '"w2"' + "]" * 40) + _LD.format('{"@type":"Recipe"').replace("</script>", "</script >"), "partial", "Page of w1", ["9 cups unused"], [], ""),
    ('<title>Just a moment...</title><li class="ingredient">1 w2</li>', "blocked", "Just a moment...", ["1 w2"], [], ""),
    ('<title>The w1 bread story</title><a href="/about">Get the recipe</a><a href="/recipe/w2"><span>Get the</span> recipe</a><a href="/recipe/w3">w1 bread story</a>', "metadata-only", "The w1 bread story", [], [], "https://kitchen.example/recipe/w2"),
    ("<p>w1 w2 w3</p>", "metadata-only", "Imported Recipe", [], [], ""),
]
_WORDS = "[A-Za-z]+"


def _first_words(text: str):
    """The first six words, which is all that layouts take; none of a text with fewer."""
    lead = F.regexp_extract(text, "^(?:[^A-Za-z]*+[A-Za-z]++){6}", 0)
    return F.regexp_extract_all(lead, F.lit(_WORDS), 0)


def _parts(layout: str) -> list[str]:
    """Plain texts and, at odd places, the numbers of words between them."""
    return re.split(r"\bw([1-6])\b", layout)


def _spliced(layout: str):
    return F.concat(*(F.get("w", F.lit(int(p) - 1)) if i % 2 else F.lit(p) for i, p in enumerate(_parts(layout))))


def _spliced_sql(layout: str) -> str:
    return " || ".join(f"w[{p}]" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(_parts(layout)))


def _case(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN k = {i} THEN {x}" for i, x in enumerate(values)) + " END"


_lists = lambda n: _case([" || chr(10) || ".join(map(_spliced_sql, layout[n])) or "''" for layout in LAYOUTS])


@query(
    "recipe_markup",
    f"""SELECT page_id, {_case([_spliced_sql(x[1]) for x in LAYOUTS])} AS success_level, {_case([_spliced_sql(x[2]) for x in LAYOUTS])} AS name, {_lists(3)} AS ingredients, {_lists(4)} AS instructions, {_case([_spliced_sql(x[5]) for x in LAYOUTS])} AS linked_recipe_url
    FROM (SELECT doc_id AS page_id, CAST(doc_id % {len(LAYOUTS)} AS INTEGER) AS k, regexp_extract_all(text, '{_WORDS}') AS w FROM documents) WHERE len(w) >= 6""",
)
def recipe_markup(spark, sf):
    """Recipes of pages made from documents: every selector list, JSON-LD whole, nested, broken and without a recipe."""
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), _first_words("text").alias("w")).filter(F.size("w") >= 6)
    html = F.coalesce(*(F.when(F.col("page_id") % len(LAYOUTS) == i, _spliced(layout[0])) for i, layout in enumerate(LAYOUTS)))
    pages = found.select("page_id", F.lit("https://kitchen.example/page").alias("url"), html.alias("html"))
    out = recipes.page_recipes(pages)
    return out.select("page_id", "success_level", "name", F.array_join("ingredients", "\n").alias("ingredients"), F.array_join("instructions", "\n").alias("instructions"), "linked_recipe_url")


@query("contained_passages", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def contained_passages(spark, sf):
    """Benchmark passages within documents."""
    return contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TURN = "regexp_extract(text, '([^.]*)[.]', 1)"


@query("contained_sentences", f"SELECT doc_id, conv_id FROM documents d JOIN (SELECT conv_id, {_TURN} AS sentence FROM conversations WHERE turn = 0) c ON sentence <> '' AND contains(d.text, sentence)")
def contained_sentences(spark, sf):
    """First sentences of conversations within documents: from a whole line down to part of a word."""
    asked = table(spark, sf, "conversations").filter("turn = 0").select("conv_id", F.regexp_extract("text", "([^.]*)[.]", 1).alias("sentence"))
    return contained(table(spark, sf, "documents"), asked, passage_id="conv_id", passage="sentence")


#: Nested JSON made of words, and the name of its first recipe; an empty name where it has none.
NESTED = [
    ('{"@type":"Recipe","name":"w1"}', "w1"),
    ('{"a":{"b":[{"@type":"WebPage","name":"w2"},[{"@type":["x","Recipe"],"name":"w3"}]]},"z":{"@type":"Recipe","name":"w4"}}', "w3"),
    ('{"@graph":[{"name":"w2"},{"deep":{"deep":{"cookTime":"w3","name":"w4"}}}],"@context":{"@type":"Recipe","name":"w1"}}', "w4"),
    ('[{"cookTime":"","prepTime":0,"recipeIngredient":null,"name":"w1"},{"recipeInstructions":[],"name":"w2"}]', "w2"),
    ('{"@type":"recipe","name":"w1","items":[1,"Recipe",{"@type":["Thing"],"name":"w2"}]}', ""),
    ('{"name":"w1",', ""),
    ("[" * 12 + '{"prepTime":{},"name":"w5"},{"@type":"Recipe","name":"w6"}' + "]" * 12, "w5"),
]


@query("nested_recipes", f"SELECT * FROM (SELECT doc_id, {_case([_spliced_sql(name) for _, name in NESTED])} AS name FROM (SELECT doc_id, CAST(doc_id % {len(NESTED)} AS INTEGER) AS k, regexp_extract_all(text, '{_WORDS}') AS w FROM documents) WHERE len(w) >= 6) WHERE name <> ''")
def nested_recipes(spark, sf):
    """First recipes of nested JSON made from documents, found as variants."""
    found = table(spark, sf, "documents").select("doc_id", _first_words("text").alias("w")).filter(F.size("w") >= 6)
    raw = F.coalesce(*(F.when(F.col("doc_id") % len(NESTED) == i, _spliced(text)) for i, (text, _) in enumerate(NESTED)))
    return find_recipes(found.select("doc_id", raw.alias("raw")), "doc_id").select("doc_id", F.variant_get("recipe", "$.name", "string").alias("name"))


#: Public videos made of conversations: address, caption, and what the import makes of them.
_FULL = "w1 Stew\nIngredients:\n1 cup w2\n2 tbsp w3\nInstructions:\n1. Mix w2 with w3\n2) Cook it slowly"
_REEL, _TOK = "https://www.instagram.com/reel/c#/", "https://www.tiktok.com/@me/video/#"
_MADE = ("w1 Stew", ["1 cup w2", "2 tbsp w3"], ["Mix w2 with w3", "Cook it slowly"])
VIDEOS = [
    (_REEL, _FULL, None, (200, "full", None, "caption-first-full", *_MADE)),
    (_TOK, _FULL, None, (200, "full", None, "caption-first-full", *_MADE)),
    (_REEL, "w1 and w2 today", None, (200, "partial", None, "caption-only-video-unavailable", "Imported Video Recipe", [], [])),
    (_TOK, "w1 and w2 today", None, (200, "partial", None, "caption-only-video-unavailable", "Imported TikTok Recipe", [], [])),
    (_TOK, None, "w6", (422, "public-video-unavailable", "TIKTOK_CAPTION_UNAVAILABLE", None, "", [], [])),
    ("https://www.instagram.com/user#/", _FULL, None, (400, "unsupported-video-url", "UNSUPPORTED_INSTAGRAM_PATH", None, "", [], [])),
    ("https://blog.example/#", _FULL, None, (400, "unsupported-video-url", "UNSUPPORTED_PUBLIC_VIDEO_PLATFORM", None, "", [], [])),
    (" ", _FULL, None, (400, "missing-video-url", None, None, "", [], [])),
    (_REEL, "w1 and w2 today", "w4", (200, "full", None, "caption-and-video", "w5 Bowl", ["3 cups w4"], ["Boil w4."])),
    (_REEL, None, "w4", (200, "full", None, "video-only", "w5 Bowl", ["3 cups w4"], ["Boil w4."])),
    (_REEL, None, None, (422, "public-video-unavailable", "PUBLIC_VIDEO_NO_RECIPE_FOUND", None, "", [], [])),
]


def _of_video(n: int, quoted=_spliced_sql) -> str:
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else " || chr(10) || ".join(map(quoted, x)) or "''" if isinstance(x, list) else quoted(x)
    return _case([value(v[3][n]) for v in VIDEOS])


_VIDEO_COLUMNS = ["status", "success_level", "error_code", "path", "name", "ingredients", "instructions"]


@query(
    "import_video_url",
    f"""SELECT conv_id AS request_id, {', '.join(f'{_of_video(n)} AS {c}' for n, c in enumerate(_VIDEO_COLUMNS))}, {_case([str(v[3][0] == 200).lower() for v in VIDEOS])} AS in_record
    FROM (SELECT conv_id, CAST(conv_id % {len(VIDEOS)} AS INTEGER) AS k, regexp_extract_all(text, '{_WORDS}') AS w FROM conversations WHERE turn = 0) WHERE len(w) >= 6""",
)
def import_video_url(spark, sf):
    """Addresses of videos made of conversations, through the whole import."""
    said = table(spark, sf, "conversations").filter("turn = 0").select("conv_id", (F.col("conv_id") % len(VIDEOS)).alias("k"), _first_words("text").alias("w")).filter(F.size("w") >= 6)
    pick = lambda n: F.coalesce(*(F.when(F.col("k") == i, _spliced(v[n])) for i, v in enumerate(VIDEOS) if v[n] is not None))
    posts = said.withColumn("url", F.replace(pick(0), F.lit("#"), F.col("conv_id").cast("string"))).withColumn("caption", pick(1)).withColumn("shown", pick(2))
    parsed = F.struct(F.concat(F.get("w", F.lit(4)), F.lit(" Bowl")).alias("name"), F.array(F.concat(F.lit("3 cups "), F.get("w", F.lit(3)))).alias("ingredients"), F.array(F.concat(F.lit("Boil "), F.get("w", F.lit(3)), F.lit("."))).alias("instructions"))
    asked = posts.select(F.col("conv_id").alias("request_id"), "url", F.lit("en").alias("language"))
    # what a page repeats, shorter, and what it says of itself
    candidates = posts.select("url", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("main-text").alias("source"), F.lit("Instagram").alias("text")), F.struct(F.lit(1).alias("ord"), F.lit("og-description").alias("source"), F.col("caption").alias("text")))).alias("c")).select("url", "c.*")
    videos = posts.select("url", F.col("shown").alias("video"), F.lit("").alias("video_title"), parsed.alias("from_both"), F.lit(None).cast("string").alias("error_code")).filter("video is not null")
    out = import_video_urls(asked, candidates, videos)
    shown = lambda c: F.array_join(c, "\n").alias(c)
    whole = F.coalesce((F.col("recipe.name") == F.col("name")) & (F.col("recipe.import_status") == F.col("success_level")) & F.col("recipe.source_url").startswith("https://"), F.lit(False))
    return out.select("request_id", "status", "success_level", "error_code", "path", "name", shown("ingredients"), shown("instructions"), whole.alias("in_record"))


#: Addresses made of a page's number (#) and path ($), one of every kind the rules tell apart, and its own (~).
ADDRESSES = [
    "https://www.instagram.com/reel/#/?x=1#y", "https://instagram.com$", "https://vm.tiktok.com/Z#", "https://www.tiktok.com/@me/video/#?q=1", "http://m.facebook.com$", "https://fb.watch/#",
    "https://www.pinterest.com/pin/#/?utm_source=a&k=1&igshid=#", "https://es.pinterest.com$", "https://pin.it/#", "https://notinstagram.com/reel/#", "https://scontent.cdninstagram.com/v/#.mp4?bytestart=0&byteend=9&k=1",
    "https://x.fbcdn.net/v/#.m3u8", "https://i.pinimg.com/#.jpg", "ftp://www.tiktok.com/#", "", "~",
]
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_UNDER = lambda *names: "(" + " OR ".join(f"host = '{n}' OR host LIKE '%.{n}'" for n in names) + ")"
_KEPT = "list_filter(string_split(regexp_extract(link, '[?]([^#]*)', 1), '&'), lambda p: NOT regexp_matches(p, '^({})(=|$)'))"
_WITHOUT = lambda keys: f"(regexp_extract(link, '^[^?#]*') || CASE WHEN array_to_string({_KEPT.format(keys)}, '&') = '' THEN '' ELSE '?' || array_to_string({_KEPT.format(keys)}, '&') END || regexp_extract(link, '#.*$'))"
_REFUSED = "CASE WHEN link NOT LIKE 'https://%' THEN '{bad}' WHEN {fits} THEN {then} ELSE '{other}' END"


@query(
    "page_addresses",
    f"""SELECT page_id, link, CASE WHEN {_UNDER('tiktok.com')} THEN 'tiktok' WHEN {_UNDER('instagram.com')} THEN 'instagram' ELSE '' END AS video,
    CASE WHEN contains(link, 'instagram.com') THEN 'instagram' WHEN contains(link, 'tiktok.com') THEN 'tiktok' WHEN contains(link, 'facebook.com') OR contains(link, 'fb.watch') THEN 'facebook' ELSE 'social' END AS platform,
    {_UNDER('pinterest.com')} OR host = 'pin.it' AS pinterest, host = 'pin.it' AS pin_it, {_UNDER('pinterest.com')} AND contains(link, '/pin/') AS pin,
    regexp_matches(link, 'facebook[.]com|fb[.]watch|instagram[.]com|tiktok[.]com|pinterest[.]com') AS social, link LIKE 'https://%' AND {_UNDER('cdninstagram.com', 'fbcdn.net')} AS instagram_media, link LIKE 'https://%' AND {_UNDER('fbcdn.net')} AS facebook_media,
    link = '' OR regexp_matches(host, 'pinterest[.]|pinimg[.]com|facebook[.]com|instagram[.]com|tiktok[.]com|youtube[.]com|youtu[.]be') OR regexp_matches(regexp_extract(link, '^[^?#]*'), '[.](jpg|jpeg|png|webp|gif|svg)$') AS bad,
    {_WITHOUT('utm_[^=&]*|fbclid|gclid|mc_cid|mc_eid|igshid|ref')} AS untracked, {_WITHOUT('bytestart|byteend')} AS ranged,
    {_REFUSED.format(bad='INVALID_FACEBOOK_VIDEO_URL', fits=_UNDER('facebook.com', 'fb.watch'), then='NULL', other='UNSUPPORTED_FACEBOOK_VIDEO_PLATFORM')} AS facebook_code,
    {_REFUSED.format(bad='INVALID_PUBLIC_VIDEO_URL', fits="host IN ('instagram.com', 'www.instagram.com')", then="CASE WHEN regexp_matches(link, '^https://[^/]*/(reel|reels|p)/') THEN NULL ELSE 'UNSUPPORTED_INSTAGRAM_PATH' END", other='UNSUPPORTED_PUBLIC_VIDEO_PLATFORM')} AS instagram_code,
    CASE WHEN link = '' THEN 'INVALID_TIKTOK_URL' WHEN link LIKE 'ftp%' THEN 'INVALID_TIKTOK_PROTOCOL' WHEN NOT {_UNDER('tiktok.com')} THEN 'UNSUPPORTED_TIKTOK_HOST' END AS tiktok_code,
    CASE WHEN link LIKE 'http%' AND {_UNDER('tiktok.com')} THEN CASE WHEN contains(link, '/video/') THEN regexp_extract(link, '^[^?#]*') ELSE regexp_extract(link, '^[^#]*') END END AS tiktok_url
    FROM (SELECT page_id, link, regexp_extract(link, '^[a-z]+://([^/?#:]+)', 1) AS host FROM (SELECT page_id, CASE WHEN s = '~' THEN url ELSE replace(replace(replace(s, '#y', '!y'), '#', CAST(page_id AS VARCHAR)), '$', {_PATH}) END AS made, replace(made, '!y', '#y') AS link
    FROM (SELECT page_id, url, unnest([{', '.join(f"'{a}'" for a in ADDRESSES)}]) AS s FROM pages)))""",
)
def page_addresses(spark, sf):
    """What the rules say of addresses of every kind, made of the pages' own."""
    found = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, ADDRESSES))).alias("s"))
    made = F.replace(F.replace(F.replace("s", F.lit("#y"), F.lit("!y")), F.lit("#"), F.col("page_id").cast("string")), F.lit("$"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1))
    c = F.col("link")
    return found.select("page_id", F.when(F.col("s") == "~", F.col("url")).otherwise(F.replace(made, F.lit("!y"), F.lit("#y"))).alias("link")).select(
        "page_id", "link", u.video_platform(c).alias("video"), u.platform(c).alias("platform"), u.is_pinterest(c).alias("pinterest"), u.is_pin_it(c).alias("pin_it"), u.is_pin(c).alias("pin"), u.is_social(c).alias("social"),
        u.is_instagram_media(c).alias("instagram_media"), u.is_facebook_media(c).alias("facebook_media"), u.is_bad_candidate(c).alias("bad"), u.remove_tracking(c).alias("untracked"), u.remove_byte_range(c).alias("ranged"),
        u.validate_facebook(c)["error_code"].alias("facebook_code"), u.validate_instagram(c)["error_code"].alias("instagram_code"), u.validate_tiktok(c)["error_code"].alias("tiktok_code"), u.validate_tiktok(c)["url"].alias("tiktok_url"),
    )


_CAPTIONS = [
    "w1 Soup\r\nIngredients:\n1 cup w2\n#tag\n2 w3\nMethod:\n1. Boil w4\n2) Stir w5\nTips:\nno", "https://x.y/z\nw1 Stew\n\n\n\nINGREDIENTS (for 4) -\nw2\nHow to make\nMix w3 and w4\n#food\nw5",
    "w1 Soup\nIngredients:\n1 cup w2", "Steps:\nw1\nIngredients:\nw2", "w1 w2 w3",
]
_SECTIONS = [("w1 Soup", ["1 cup w2", "2 w3"], ["Boil w4", "Stir w5"]), ("w1 Stew", ["w2"], ["Mix w3 and w4"]), ("", [], []), ("", [], []), ("", [], [])]
_RULES = {
    "quoted": ("“w1 w2.” ", t.strip_quotes, "w1 w2"),
    "fenced": ("```json\n{w1}\n```", t.strip_fence, "{w1}"),
    "account": ("@w1 Cooks on Instagram: w2", t.account_name, "w1 Cooks"),
    "note": ("(Note: w1  w2)", t.clean_note, "Note: w1 w2"),
    "entities": ("w1 &amp; w2&#39;s &frac12; &#233; &quot;w3&quot; ", t.clean_html_entities, "w1 & w2's ½ é \"w3\""),
    "measure": ("1 cup (large) w1 (packed)", t.secondary_measures, "1 cup w1 (packed)"),
    "repaired": ("wh en th e ov er w1", t.broken_words, "when the over w1"),
    "degrees": ("180 degrees C for w1", t.cooking_text, "180°F C for w1"),
    "extension": ("/a/w1.Tar.MP4", u.file_extension, ".mp4"),
}


@query(
    "text_rules",
    f"""SELECT doc_id, {', '.join(f'{_spliced_sql(want)} AS {name}' for name, (_, _, want) in _RULES.items())}, {_case([_spliced_sql(x[0]) for x in _SECTIONS])} AS title, {_case([' || chr(10) || '.join(map(_spliced_sql, x[1])) or "''" for x in _SECTIONS])} AS ingredients,
    {_case([' || chr(10) || '.join(map(_spliced_sql, x[2])) or "''" for x in _SECTIONS])} AS instructions FROM (SELECT doc_id, CAST(doc_id % {len(_CAPTIONS)} AS INTEGER) AS k, regexp_extract_all(text, '{_WORDS}') AS w FROM documents) WHERE len(w) >= 6 AND length(w[1]) > 2""",
)
def text_rules(spark, sf):
    """Text scalars and caption sections on texts made of documents' words."""
    found = table(spark, sf, "documents").select("doc_id", _first_words("text").alias("w")).filter((F.size("w") >= 6) & (F.length(F.get("w", F.lit(0))) > 2))
    caption = F.coalesce(*(F.when(F.col("doc_id") % len(_CAPTIONS) == i, _spliced(c)) for i, c in enumerate(_CAPTIONS)))
    said = found.select("doc_id", "w", caption.alias("caption")).withColumn("s", classify.caption_sections(F.col("caption")))
    return said.select("doc_id", *(f(_spliced(given)).alias(name) for name, (given, f, _) in _RULES.items()), F.col("s.name").alias("title"), F.array_join("s.ingredients", "\n").alias("ingredients"), F.array_join("s.instructions", "\n").alias("instructions"))
