"""Caption, media and link evidence of stored social pages, and validated video evidence.

A page is parsed once by the standard library's parser; what candidates it holds, their
order and their limits are said in column expressions. Text of an element is its data
without scripts and styles, with line breaks around blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import text as t
from larder.functions import urls as u
from larder.functions import vocab as v
from larder.functions.markup import VOID, TotalParser
from larder.operators.pages import absolute

_S = T.StringType()
VIDEO = T.StructType().add("url", _S).add("source", _S).add("content_type", _S)
SEEN = T.StructType().add("title", _S).add("metas", T.MapType(_S, _S)).add("article", _S).add("main", _S).add("scripts", T.ArrayType(_S)).add("videos", T.ArrayType(VIDEO)).add("canonical", _S).add("oembed", _S)
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
#: Characters of an element's text that count.
MOST_TEXT = 12_000


class _Seen(TotalParser):
    def __init__(self):
        super().__init__()
        self.title: list[str] | None = None
        self.metas, self.links = {}, {}
        self.text: dict[str, list[str]] = {}
        self.depth = {"article": 0, "main": 0}
        self.scripts: list[list[str]] = []
        self.videos: list[tuple[str, str, str]] = []
        self.video, self.source, self.inside = 0, 0, ""
        self.raw = ""

    def handle_starttag(self, tag, attrs):
        a = {k: x or "" for k, x in reversed(attrs)}
        if tag == "meta":
            for kind in ("property", "name"):
                if kind in a:
                    self.metas.setdefault(f"{kind}={a[kind]}", a.get("content", ""))
        elif tag == "link":
            kind = "oembed" if a.get("rel") == "alternate" and a.get("type") == "application/json+oembed" else a.get("rel", "")
            self.links.setdefault(kind, a.get("href", ""))
        elif tag in ("script", "style", "title"):
            self.raw = tag
            if tag == "script":
                self.scripts.append([])
            elif tag == "title" and self.title is None:
                self.title = []
        elif tag == "video":
            self.video, self.source, self.inside = self.video + 1, 0, "video"
            self.videos.append((a.get("src", ""), f"video-{self.video}-src", ""))
        elif tag == "source" and self.inside:
            self.source += 1
            self.videos.append((a.get("src", ""), f"video-{self.video}-source-{self.source}", a.get("type", "")))
        self._break(tag)
        if tag in self.depth and (tag not in self.text or self.depth[tag]):
            self.text.setdefault(tag, [])
            self.depth[tag] += 1

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = ""
        if tag == "video":
            self.inside = ""
        if self.depth.get(tag):
            self.depth[tag] -= 1
        if tag not in VOID:
            self._break(tag)

    def _break(self, tag):
        if tag in BLOCKS:
            for kind, n in self.depth.items():
                if n:
                    self.text[kind].append("\n")

    def handle_data(self, data):
        if self.raw == "script":
            self.scripts[-1].append(data)
        elif self.raw == "title" and self.title is not None:
            self.title.append(data)
        elif not self.raw:
            for kind, n in self.depth.items():
                if n:
                    self.text[kind].append(data)


def read_evidence(html: str | None) -> dict:
    """What one page shows: title, metas by attribute, texts, scripts, videos and links."""
    p = _Seen()
    p.read(html)
    inner = {k: "\n".join(x for x in (" ".join(y.split()) for y in "".join(parts).split("\n")) if x) for k, parts in p.text.items()}
    return {
        "title": "".join(p.title or []), "metas": p.metas, "article": inner.get("article", ""), "main": inner.get("main", ""), "scripts": ["".join(x) for x in p.scripts],
        "videos": [{"url": a, "source": b, "content_type": c} for a, b, c in p.videos], "canonical": p.links.get("canonical", ""), "oembed": p.links.get("oembed", ""),
    }


@F.pandas_udf(SEEN)
def seen_of(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_evidence(x) for x in pages], columns=SEEN.names)


SEEN_OF = seen_of.asNondeterministic()


def _seen(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", SEEN_OF(F.coalesce("html", F.lit(""))).alias("_e"))


def _meta(key: str) -> Column:
    return F.coalesce(F.element_at("_e.metas", F.lit(key)), F.lit(""))


def _first(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in values), F.lit(""))


def unescaped(value: Column, otherwise: Column) -> Column:
    """A captured JSON string without its escapes, or otherwise if it is none."""
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), value, F.lit('"]')), "array<string>"), F.lit(0)), otherwise)


def escaped_json_string(html: Column, field: str) -> Column:
    """First value of a field in JSON that stands anywhere in a page; empty if none can be read."""
    found = F.regexp_extract(t.text(html), rf'(?i)"{field}":"((?:\\.|[^"])*)"', 1)
    return F.when(found == "", "").otherwise(unescaped(found, F.lit("")))


def caption_candidates(pages: DataFrame) -> DataFrame:
    """Caption candidates (page_id, ord, source, text) of pages (page_id, url, html).

    Metas come first, then article and main text (MOST_TEXT characters of each), then up
    to 15 matches a pattern of each script. Pages without any have no row.
    """
    one = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
    plain = [one(_meta(key), source) for key, source in v.CAPTION_METAS] + [one(F.substring(f"_e.{part}", 1, MOST_TEXT), f"{part}-text") for part in ("article", "main")]
    usable = F.filter("_e.scripts", lambda s: (F.length(s) > 0) & (F.length(s) <= v.LONGEST_CAPTION_SCRIPT) & s.rlike("(?i)caption|edge_media_to_caption"))

    def of(script: Column, source: str, pattern: str) -> Column:
        return F.transform(F.slice(F.regexp_extract_all(script, F.lit(pattern), 1), 1, 15), lambda x: one(unescaped(x, x), source))

    def matches(script: Column) -> Column:
        return F.concat(*(of(script, source, pattern) for source, pattern in v.CAPTION_SCRIPTS))

    found = F.filter(F.concat(F.array(*plain), F.flatten(F.transform(usable, matches))), lambda c: c["text"] != "")
    return _seen(pages).select("page_id", F.posexplode(found).alias("ord", "_c")).select("page_id", "ord", "_c.source", "_c.text")


def media_evidence(pages: DataFrame) -> DataFrame:
    """Media candidates (page_id, ord, url, source, content_type) of pages.

    Four metas, video elements with their sources against the page's URL, and up to 40
    URLs of each script that speaks of video.
    """
    one = lambda url, source, kind: F.struct(url.alias("url"), source.alias("source"), kind.alias("content_type"))
    metas = F.array(*(one(_meta(f"{'name' if m.startswith('twitter') else 'property'}={m}"), F.lit(m), F.lit("")) for m in v.MEDIA_METAS))
    videos = F.transform("_e.videos", lambda x: one(absolute(F.col("url"), x["url"]), x["source"], x["content_type"]))
    usable = F.filter("_e.scripts", lambda s: (F.length(s) > 0) & (F.length(s) <= v.LONGEST_MEDIA_SCRIPT) & s.rlike(r"(?i)video_url|video_versions|\.mp4|\.m3u8"))
    urls = F.transform(F.flatten(F.transform(usable, lambda s: F.slice(F.regexp_extract_all(s, F.lit(v.SCRIPT_URL), 0), 1, 40))), lambda x: one(x, F.lit("page-script"), F.lit("")))
    found = F.filter(F.concat(metas, videos, urls), lambda c: c["url"] != "")
    return _seen(pages).select("page_id", F.posexplode(found).alias("ord", "_c")).select("page_id", "ord", "_c.*")


def linked_media(html: Column) -> Column:
    """The platform's own video address of a page: the standard one, else the high one, else empty."""
    low, high = (escaped_json_string(html, f"browser_native_{k}_url") for k in ("sd", "hd"))
    return F.when(u.is_facebook_media(low), low).when(u.is_facebook_media(high), high).otherwise("")


def video_record(e: Column) -> Column:
    """Metadata of validated video evidence; null evidence gives the empty record."""
    said = lambda name: F.coalesce(e[name], F.lit(""))
    return F.struct(
        *(said(n).alias(n) for n in ("title", "title_source", "visible_recipe_text", "spoken_recipe_text", "combined_recipe_text")),
        *(t.true_only(e[n]).alias(n) for n in ("ingredients_appear_complete", "instructions_appear_complete")),
        F.coalesce(e["possible_missing_content"], F.lit(True)).alias("possible_missing_content"), F.coalesce(e["warnings"], F.array().cast("array<string>")).alias("warnings"),
    )


def prepared_record(frames: Column, has_audio: Column, error: Column) -> Column:
    """Metadata of a prepared video; one without frames was not available."""
    there = frames.isNotNull()
    return F.struct(
        F.when(there, "resolved-instagram-video.mp4").otherwise("").alias("filename"), F.when(there, "video/mp4").otherwise("").alias("mimetype"), F.coalesce(frames, F.lit(0)).alias("frame_count"),
        (there & t.true_only(has_audio)).alias("has_audio"), there.alias("available"), F.when(there, "").otherwise(t.text(error)).alias("error"),
    )


def resolved_record(tracks: Column, size: Column, candidates: Column, error: Column) -> Column:
    """Metadata of a resolved video from its tracks (kind, duration_seconds): null tracks were not had.

    Its duration is that of its longest track.
    """
    there = tracks.isNotNull()
    longest = F.aggregate(F.coalesce(tracks, F.array().cast("array<struct<kind:string,duration_seconds:double>>")), F.lit(0.0), lambda a, x: F.greatest(a, F.coalesce(x["duration_seconds"], F.lit(0.0))))
    return F.struct(
        F.lit("instagram").alias("platform"), there.alias("available"), longest.alias("duration_seconds"), F.when(there, F.coalesce(size, F.lit(0))).otherwise(0).cast("long").alias("size_bytes"),
        F.coalesce(F.exists(tracks, lambda x: x["kind"] == "audio"), F.lit(False)).alias("has_audio"), F.when(there, F.coalesce(candidates, F.lit(0))).otherwise(0).cast("int").alias("candidate_count"),
        F.greatest(F.coalesce(F.size(tracks), F.lit(0)), F.lit(0)).alias("unique_track_count"), F.when(there, "").otherwise(t.text(error)).alias("error"),
    )


def caption_record(success: Column, text: Column, source: Column, score: Column, image: Column, candidates: Column, error: Column) -> Column:
    """Metadata of a resolved caption."""
    return F.struct(
        (t.true_only(success) & (t.text(text) != "")).alias("found"), t.text(source).alias("source"), F.coalesce(score, F.lit(0.0)).alias("score"), t.trim(t.text(text)).alias("text"),
        t.trim(t.text(image)).alias("image_url"), F.coalesce(candidates, F.lit(0)).alias("candidate_count"), t.text(error).alias("error"),
    )


def post_record(success: Column, reply: Column) -> Column:
    """Metadata of a short video's post from its embedding reply, trimmed, with defaults."""
    said = lambda name, default="": F.coalesce(F.nullif(t.trim(t.text(reply[name])), F.lit("")), F.lit(default)).alias(name)
    number = lambda name: F.coalesce(reply[name].cast("int"), F.lit(0)).alias(name)
    return F.struct(
        (t.true_only(success) & (t.text(reply["caption_text"]) != "")).alias("found"), F.lit("tiktok").alias("platform"),
        *(said(n) for n in ("original_url", "expanded_url", "source_url", "caption_source", "caption_text", "image_url")), number("image_width"), number("image_height"),
        *(said(n) for n in ("author_name", "author_url", "author_unique_id", "video_id")), said("provider_name", "TikTok"), said("embed_type", "video"), said("oembed_version"),
    )


def link_evidence(pages: DataFrame) -> DataFrame:
    """Title, description, image, canonical and oEmbed links of pages."""
    return _seen(pages).select(
        "page_id",
        "_e.title",
        _first(F.col("_e.canonical"), _meta("property=og:url")).alias("canonical_url"),
        _meta("property=og:title").alias("og_title"),
        _first(_meta("property=og:description"), _meta("name=description"), _meta("name=twitter:description")).alias("description"),
        _first(_meta("property=og:image"), _meta("name=twitter:image")).alias("image_url"),
        F.col("_e.oembed").alias("oembed_url"),
    )


def video_evidence(raw: Column) -> Column:
    """Validated evidence of a model's JSON reply, fenced or within other text; defaults where it says nothing."""
    kind = "hasRecipeContent string, title string, titleSource string, visibleRecipeText string, spokenRecipeText string, combinedRecipeText string, ingredientsAppearComplete string, instructionsAppearComplete string, possibleMissingContent string, warnings array<string>"
    body = t.trim(t.strip_fence(t.text(raw)))
    c = F.from_json(F.when(~body.startswith("["), F.regexp_extract(body, r"(?s)\{.*\}", 0)), kind)
    yes = lambda name: F.coalesce(c[name] == "true", F.lit(False))
    said = lambda name: t.trim(t.text(c[name]))
    return F.struct(
        yes("hasRecipeContent").alias("has_recipe_content"), said("title").alias("title"), F.when(c["titleSource"].isin(*v.TITLE_SOURCES), c["titleSource"]).otherwise("unknown").alias("title_source"),
        said("visibleRecipeText").alias("visible_recipe_text"), said("spokenRecipeText").alias("spoken_recipe_text"), said("combinedRecipeText").alias("combined_recipe_text"),
        yes("ingredientsAppearComplete").alias("ingredients_appear_complete"), yes("instructionsAppearComplete").alias("instructions_appear_complete"),
        F.coalesce(c["possibleMissingContent"] != "false", F.lit(True)).alias("possible_missing_content"),
        F.filter(F.transform(F.coalesce(c["warnings"], F.array().cast("array<string>")), lambda x: t.trim(t.text(x))), lambda x: x != "").alias("warnings"),
    )


def screenshot_title(visible: Column, given: Column, parsed: Column) -> Column:
    """{name, source}: the visible title, else the given one, else a parsed one that says something."""
    named = t.clean_text(parsed)
    useful = ~F.lower(named).isin(*v.GENERIC_NAMES)
    source = F.when(t.text(visible) != "", "visible-in-screenshot").when(t.text(given) != "", "source-metadata").when(useful, "ai-inferred-from-visible-text").otherwise("fallback")
    name = t.clean_text(_first(t.text(visible), t.text(given), F.when(useful, named), F.lit("Screenshot Recipe")))
    return F.struct(name.alias("name"), source.alias("source"))


