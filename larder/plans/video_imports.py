"""One lineage from the address of a public video to a clean recipe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as t
from larder.functions import urls as u
from larder.operators import captions, classify
from larder.plans.recipes import Enricher, cleaned_results, identity, import_layers


def _asked(requests: DataFrame) -> DataFrame:
    """Requests with their platform, the address to import and, where there is none, why."""
    url = t.trim(t.text(F.col("url")))
    given = requests.select("request_id", url.alias("source_url"), t.route_language(F.col("language")).alias("language"))
    checked = given.withColumn("platform", u.video_platform(F.col("source_url"))).withColumn("_k", u.validate_tiktok(F.col("source_url"))).withColumn("_i", u.validate_instagram(F.col("source_url")))
    own = lambda field: F.when(F.col("platform") == "tiktok", F.col(f"_k.{field}")).when(F.col("platform") == "instagram", F.col(f"_i.{field}"))
    return checked.withColumn("target", own("url")).withColumn("code", own("error_code")).drop("_k", "_i")


def _evidence(targets: DataFrame, candidates: DataFrame, videos: DataFrame, parse: Callable[[Column], Column]) -> DataFrame:
    """What each address has: its best caption with what the parser makes of it, and its video."""
    best = captions.best_caption(candidates.select(F.col("url").alias("post_id"), "ord", "source", "text")).select(F.col("post_id").alias("target"), F.col("text").alias("caption"))
    seen = videos.filter("url is not null").groupBy(F.col("url").alias("target")).agg(F.min_by(F.struct("video", "video_title", "from_both", "error_code"), F.struct(F.col("video").isNull(), "video")).alias("_v"))
    both = targets.join(best, "target", "left").join(seen, "target", "left")
    reel = F.col("platform") == "instagram"  # the other platform's videos are not looked into
    return both.select(F.col("target").alias("post_id"), "platform", "caption", parse(F.col("caption")).alias("from_caption"), F.when(reel, F.col("_v.video")).alias("video"), F.when(reel, F.col("_v.video_title")).otherwise("Imported TikTok Recipe").alias("video_title"), F.col("_v.from_both").alias("from_both"), F.when(reel, F.col("_v.error_code")).alias("video_code"))


def import_video_urls(requests: DataFrame, candidates: DataFrame, videos: DataFrame, parse: Callable[[Column], Column] = classify.caption_sections, enrich: Enricher = identity) -> DataFrame:
    """Requests (request_id, url, language) for public videos to clean recipes and canonical records.

    candidates: captions found on the videos' pages (url, ord, source, text). videos: what
    the videos show (url, video, video_title, from_both, error_code), null ``video`` where one
    could not be had. Both are known by the address that the validators give.

    1. An address is refused, with the status of its error code, if it is missing, of no
       known platform or of no form that the platform has.
    2. Every distinct address is worked on once: best caption, parsed; a reel whose caption
       is no full recipe takes that of caption and video. An address without any evidence
       is unavailable, with its video's own error code if it has one.
    3. Results are cleaned and get their canonical record.

    Every request has one row, whatever else is null, empty or repeated.
    """
    asked = _asked(requests)
    targets = asked.filter("target is not null").select("target", "platform").distinct()
    shown = _evidence(targets, candidates, videos, parse)
    layers = import_layers(shown).join(shown.select("post_id", "video_code"), "post_id")
    found = asked.join(layers.withColumnRenamed("post_id", "target"), "target", "left")
    none = F.when(F.col("platform") == "tiktok", "TIKTOK_CAPTION_UNAVAILABLE").otherwise(F.coalesce("video_code", F.lit("PUBLIC_VIDEO_NO_RECIPE_FOUND")))
    code = F.when(F.col("source_url") == "", "MISSING").when(F.col("platform") == "", "UNSUPPORTED_PUBLIC_VIDEO_PLATFORM").otherwise(F.coalesce("code", F.when(F.col("success_level") == "no-recipe-found", none)))
    told = found.withColumn("error_code", code).withColumn("_e", classify.error_status(F.col("error_code")))
    good, empty = F.col("error_code").isNull(), F.array().cast("array<string>")
    level = F.when(good, F.col("success_level")).when(F.col("error_code") == "MISSING", "missing-video-url").otherwise(F.col("_e.level"))
    status = F.when(good, 200).when(F.col("error_code") == "MISSING", 400).otherwise(F.col("_e.status"))
    kept = lambda c: F.when(good, F.col(c)).otherwise(empty)
    results = told.select(
        "request_id", "platform", "source_url", F.coalesce("target", "source_url").alias("imported_from_url"), good.alias("success"), level.alias("success_level"), status.alias("status"), F.when(F.col("error_code") != "MISSING", F.col("error_code")).alias("error_code"),
        F.when(good, F.col("path")).alias("path"), F.when(good, F.col("name")).otherwise("").alias("name"), kept("ingredients").alias("ingredients"), kept("instructions").alias("instructions"), F.lit("").alias("image"), F.coalesce("evidence", F.lit("")).alias("fallback_text"),
    )
    return cleaned_results(results, enrich)
