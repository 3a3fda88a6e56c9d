"""Edges of the video import: every request gets one row, whatever its columns hold."""

from larder.plans.video_imports import import_video_urls

REEL = "https://www.instagram.com/reel/a/"
FULL = "Best Soup\nIngredients:\n1 cup beans\nInstructions:\n1. Boil the beans\n2. Serve them hot"


def test_every_request_has_a_row(spark):
    asked = spark.createDataFrame([(1, REEL, "en", "x"), (1, REEL, "en", "x"), (2, REEL, None, None), (None, REEL, "es", None), (3, None, None, None), (4, "", "en", ""), (5, "  " + REEL, "en", ""), (6, "https://www.instagram.com/reel/b/", "en", ""), (7, "https://vm.tiktok.com/Z1", "en", ""), (8, "ftp://www.tiktok.com/x", "en", "")], "request_id long, url string, language string, platform string")
    said = spark.createDataFrame([(REEL, 0, "og-description", FULL), (REEL, 1, "og-description", FULL), (REEL, 2, "main-text", None), (None, 0, "main-text", FULL)], "url string, ord int, source string, text string")
    kind = "url string, video string, video_title string, from_both struct<name string, ingredients array<string>, instructions array<string>>, error_code string"
    seen = spark.createDataFrame([("https://www.instagram.com/reel/b/", None, None, None, "PUBLIC_VIDEO_TOO_LARGE"), (None, "v", None, None, None)], kind)
    got = import_video_urls(asked, said, seen).collect()
    shown = sorted((str(r["request_id"]), r["status"], r["success_level"], r["recipe"] is not None) for r in got)
    good, none = (200, "full", True), (400, "missing-video-url", False)
    assert shown == sorted([("1", *good), ("1", *good), ("2", *good), ("None", *good), ("3", *none), ("4", *none), ("5", *good), ("6", 413, "public-video-too-large", False), ("7", 422, "public-video-unavailable", False), ("8", 400, "unsupported-video-url", False)])
    record = next(r["recipe"] for r in got if r["request_id"] == 2)
    assert (record["name"], record["ingredients"], record["import_status"], record["source_url"]) == ("Best Soup", "1 cup beans", "full", REEL)
    assert import_video_urls(asked.limit(0), said, seen).count() == 0
    assert {r["success_level"] for r in import_video_urls(asked, said.limit(0), seen.limit(0)).collect()} == {"missing-video-url", "public-video-unavailable", "unsupported-video-url"}
