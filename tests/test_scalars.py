"""Expected values worked out by hand."""

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import urls as u
from larder.operators import captions, classify
from larder.operators.jsonld import find_recipe, read_block
from larder.operators.jsonread import parse
from larder.operators.pages import read_page


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (t.clean_text, " a﻿\n\t b ", "a b"),
        (t.clean_text, None, ""),
        (t.clean_html_entities, "&amp;#39;x&#8217;s &frac12; &#233; &#65601;", "'x's ½ é A"),
        (t.clean_html_entities, "&amp;nbsp;", "&nbsp;"),
        (t.slugify, "Crème Brûlée -- à la Mode!", "crme-brle-la-mode"),
        (t.slugify, "", "recipe"),
        (t.cooking_text, "180 degrees C", "180°F C"),
        (t.broken_words, "TH E to matoes and regano", "the tomatoes and oregano"),
        (t.secondary_measures, "1 cup (large) flour (packed)", "1 cup flour (packed)"),
        (t.clean_note, "Bake (30 min)", "Bake (30 min"),
        (t.strip_quotes, "“Hello.” ", "Hello"),
        (t.title_case, "air-fryer  RICE", "Air-fryer Rice"),
        (t.humanize_tag, "#CreamyPasta_bake", "Creamy Pasta Bake"),
        (t.account_name, "@Ana Cooks on Instagram: x", "Ana Cooks"),
        (t.compare_key, "It’s  A-b!", "its a b"),
        (t.effort, " BIG", "big"),
        (t.language, None, "en"),
        (t.strip_fence, "```json\n{}\n```", "{}"),
        (u.file_extension, "A.B.MP4", ".mp4"),
        (u.remove_byte_range, "https://a.b/c?x=1&bytestart=0&byteend=9", "https://a.b/c?x=1"),
        (u.clean_pin_candidate, "//a.com/x?utm_medium=1&q=2&REF=3", "https://a.com/x?q=2"),
        (u.clean_pin_candidate, "ftp://a", None),
        (u.is_bad_candidate, "not a url", True),
        (u.is_instagram_media, "https://evilcdninstagram.com/x", False),
        (u.is_tiktok_host, "VM.TikTok.com.", True),
    ],
)
def test_scalar(spark, function, given, want):
    assert value(spark, function(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("see https://X.com/a now", "https://x.com/a"),
        ("https://x.com?utm_source=a&b=1%202#f", "https://x.com/?b=1+2"),
        ("https://l.com/?u=https%3A%2F%2Fy.org%2Fr%3Fgclid%3D1", "https://y.org/r"),
        ("https://h.com/?url=123", "https://h.com/123"),
        ("https://www.instagram.com/reel/a/?igshid=1#x", "https://www.instagram.com/reel/a/?igshid=1#x"),
        ("nope", "nope"),
        (None, ""),
    ],
)
def test_import_url(raw, want):
    assert u.normalize_url(raw) == want


def test_import_url_of_nested_redirects():
    link = "https://y.org/r"
    for _ in range(12):
        link = "https://l.com/?u=" + quote(link, safe="")
    assert u.normalize_url(link) == "https://y.org/r"
    assert u.normalize_url("https://h.com/?u=%3Fu%3D%2F") == "https://h.com/"


def test_jsonld_order():
    assert find_recipe(parse('{"b":{"cookTime":"1"},"2":{"prepTime":"x"}}')) == {"prepTime": "x"}
    assert read_block('{"a": NaN, "@type":"Recipe"}')[0] is False
    assert read_block("[" * 100000)[0] is False
    assert read_block('x {"@type":"Recipe","name":"a}b","recipeInstructions":"Mix.  It"} y')[1:4] == ("a}b", [], ["Mix. It"])


def test_page_pieces():
    page = read_page('<title>T</title><meta property="og:image" content="i"><li class="my-ingredient">1 <b>cup</b><li class="ingredient-x">salt</li><a href="/recipe/1">Get the <i>recipe</i></a>')
    assert page["title"] == "T" and page["metas"] == {"og:image": "i"}
    assert page["selected"][3] == ["1 cup", "salt"]
    assert page["links"] == [{"href": "/recipe/1", "text": "Get the recipe"}]


def test_caption_choice(spark):
    rows = [(1, 0, "script-caption", "x" * 200), (1, 1, "og-description", "Nice soup"), (1, 2, "main-text", "NICE  soup"), (2, 0, "main-text", ""), (2, 1, None, None), (3, 0, "main-text", "Log in to see photos and videos")]
    best = captions.best_caption(spark.createDataFrame(rows, "post_id int, ord int, source string, text string")).collect()
    assert [(r["post_id"], r["text"]) for r in best] == [(1, "Nice soup")]


def test_tags_are_allowed(spark):
    from larder.functions.vocab import RECIPE_TAGS

    got = value(spark, classify.recipe_tags(F.array(*(F.lit(x) for x in [*RECIPE_TAGS, "x"]))))
    assert len(got) == 8 and set(got) <= set(RECIPE_TAGS)


def test_stream_equals_batch(spark, tmp_path):
    from larder import streaming

    df = spark.createDataFrame([(1, " a  b "), (2, None)], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    op = lambda d: d.select("id", t.clean_text(F.col("text")).alias("text"))
    streaming.run(spark, str(tmp_path / "in"), "id int, text string", op, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, op(df).collect()))


def test_pages_of_any_markup():
    import random
    import time

    from larder.operators.evidence import read_evidence

    began = time.time()
    for page in ("<![x[y]]><p>a", "<![x[", "<div>" * 20000 + "x", "<a href=/recipe/1>" * 20000, "<li class=x>" * 20000, "<ul><li>" * 20000, "<!--" * 100_000, "<a " * 100_000, "<![" * 100_000, "</" * 100_000, "<title>" * 20000, "<article>" * 20000 + "x" * 20):
        read_page(page), read_evidence(page)
    rng = random.Random(2)
    parts = ["<", ">", "!", "[", "]", "--", "/", "a", "li", "p", " ", '"', "=", "&", "#", "script", "title", "video", "?", "\n", "article", ";", "<![", "</", "<!--"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        read_page(page), read_evidence(page)
    assert time.time() - began < 60
    assert read_page("<![x[y]]><title>T</title>")["title"] == read_evidence("<![x[y]]><title>T</title>")["title"] == "T"


def test_links_to_an_address_with_two_pages(spark):
    from larder.plans.recipes import follow_links

    rows = [(1, "https://a.com/r", ["x"], ["y"], "", "full"), (2, "https://a.com/r", ["z"], [], "", "partial"), (3, "https://a.com/l", [], [], "https://a.com/r?utm_source=q", "metadata-only"), (4, None, [], [], None, "metadata-only"), (None, None, ["b"], [], None, "partial")]
    got = follow_links(spark.createDataFrame(rows, "page_id long, source_url string, ingredients array<string>, instructions array<string>, linked_recipe_url string, success_level string")).collect()
    assert len(got) == 5 and next((r["ingredients"], r["success_level"]) for r in got if r["page_id"] == 3) == (["x"], "full")


def test_records(spark):
    from larder.operators import evidence as e

    none = F.lit(None)
    tracks = F.array(F.struct(F.lit("video").alias("kind"), F.lit(2.5).alias("duration_seconds")), F.struct(F.lit("audio").alias("kind"), F.lit(3.0).alias("duration_seconds")))
    got = value(spark, e.resolved_record(tracks, F.lit(9), F.lit(4), none))
    assert (got["available"], got["duration_seconds"], got["size_bytes"], got["has_audio"], got["candidate_count"], got["unique_track_count"]) == (True, 3.0, 9, True, 4, 2)
    got = value(spark, e.resolved_record(none.cast("array<struct<kind:string,duration_seconds:double>>"), F.lit(9), F.lit(4), F.lit("gone")))
    assert (got["available"], got["duration_seconds"], got["size_bytes"], got["has_audio"], got["unique_track_count"], got["error"]) == (False, 0.0, 0, False, 0, "gone")
    got = value(spark, e.prepared_record(none.cast("int"), F.lit(True), F.lit("no")))
    assert (got["available"], got["has_audio"], got["frame_count"], got["error"]) == (False, False, 0, "no")
    got = value(spark, e.caption_record(F.lit(True), F.lit(" x "), none, none, none, none, none))
    assert (got["found"], got["text"], got["score"], got["image_url"]) == (True, "x", 0.0, "")
    got = value(spark, e.video_record(e.video_evidence(F.lit('{"title":" S "}'))))
    assert (got["title"], got["title_source"], got["possible_missing_content"], got["warnings"]) == ("S", "unknown", True, [])
    page = '{"browser_native_sd_url":"https:\\/\\/evil.com\\/a","browser_native_hd_url":"https:\\/\\/x.fbcdn.net\\/b"}'
    assert value(spark, e.linked_media(F.lit(page))) == "https://x.fbcdn.net/b"
    names = ["caption_text", "original_url", "expanded_url", "source_url", "caption_source", "image_url", "author_name", "author_url", "author_unique_id", "video_id", "provider_name", "embed_type", "oembed_version"]
    reply = F.struct(*(F.lit(" c " if n == "caption_text" else None).cast("string").alias(n) for n in names), F.lit(7).alias("image_width"), none.cast("int").alias("image_height"))
    got = value(spark, e.post_record(F.lit(True), reply))
    assert (got["found"], got["caption_text"], got["image_width"], got["image_height"], got["provider_name"], got["embed_type"]) == (True, "c", 7, 0, "TikTok", "video")
    assert [value(spark, captions.candidate_priority(F.lit(a), F.lit(b))) for a, b in (("x.mp4", ""), ("x", "application/x-mpegURL"), ("x", "video/webm"), ("x", None))] == [1, 2, 3, 4]
    assert value(spark, u.canonical_tiktok(F.lit('<blockquote cite="https://www.tiktok.com/@a/video/12">'))) == "https://www.tiktok.com/@a/video/12"
    assert value(spark, u.is_supported(u.validate_instagram(F.lit("https://www.instagram.com/p/1/")))) is True
