"""URL scalars. Unparsable values give false, null or the text given, never an error."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larder.functions import vocab as v
from larder.functions.text import text, trim


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _is_or_under(h: Column, names: list[str]) -> Column:
    c = F.regexp_replace(h, r"\.\z", "")
    out = c.isin(*names)
    for n in names:
        out = out | c.endswith("." + n)
    return F.coalesce(out, F.lit(False))


def is_social(url: Column) -> Column:
    return F.lower(text(url)).rlike("|".join(h.replace(".", r"\.") for h in v.SOCIAL_HOSTS))


def video_platform(url: Column) -> Column:
    h = host(trim(text(url)))
    return F.when(_is_or_under(h, ["tiktok.com"]), "tiktok").when(_is_or_under(h, ["instagram.com"]), "instagram").otherwise("")


def platform(url: Column) -> Column:
    c = F.lower(text(url))
    return F.when(c.contains("instagram.com"), "instagram").when(c.contains("tiktok.com"), "tiktok").when(c.contains("facebook.com") | c.contains("fb.watch"), "facebook").otherwise("social")


def is_pinterest(url: Column) -> Column:
    h = host(url)
    return F.coalesce(h.isin(*v.PINTEREST_HOSTS) | h.endswith(".pinterest.com"), F.lit(False))


def is_pin_it(url: Column) -> Column:
    return F.coalesce(host(url) == "pin.it", F.lit(False))


def is_pin(url: Column) -> Column:
    h = host(url)
    return F.coalesce((h.isin("pinterest.com", "www.pinterest.com") | h.endswith(".pinterest.com")) & F.try_parse_url(url, F.lit("PATH")).contains("/pin/"), F.lit(False))


def decode_pin_text(value: Column) -> Column:
    c = text(value)
    for old, new in (("\\u002F", "/"), ("\\u0026", "&"), ("\\u003D", "="), ("\\u003F", "?"), ("\\/", "/"), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _drop_keys(url: Column, keys: str) -> Column:
    """Remove query pairs whose key matches, by text; the fragment stays."""
    fragment = F.regexp_extract(url, r"(#.*)\z", 1)
    body = F.regexp_replace(url, r"#.*\z", "")
    query = F.regexp_extract(body, r"\?(.*)\z", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(rf"(?i)^(?:{keys})(?:=|\z)"))
    base = F.regexp_replace(body, r"\?.*\z", "")
    joined = F.array_join(kept, "&")
    return F.concat(base, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)), fragment)


def remove_tracking(url: Column) -> Column:
    return _drop_keys(url, "utm_[^=&]*|" + "|".join(v.PIN_TRACKING))


def clean_pin_candidate(value: Column) -> Column:
    c = trim(decode_pin_text(value))
    c = F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)
    return F.when(c.rlike("^https?://"), remove_tracking(c))


def is_bad_candidate(url: Column) -> Column:
    bad_host = host(url).rlike("|".join(f.replace(".", r"\.") for f in v.BAD_HOST_FRAGMENTS))
    return F.coalesce(bad_host | F.lower(F.try_parse_url(url, F.lit("PATH"))).rlike(r"\.(?:jpg|jpeg|png|webp|gif|svg)\z"), F.lit(True))


def clean_media_url(value: Column) -> Column:
    c = trim(text(value))
    for old, new in ((r"(?i)\\u0026", "&"), (r"(?i)\\u003d", "="), (r"(?i)\\u002f", "/"), (r"\\/", "/"), ("&amp;", "&")):
        c = F.regexp_replace(c, old, new)
    return c


def looks_like_video(url: Column, content_type: Column) -> Column:
    t = F.lower(text(content_type))
    u = text(url)
    return t.startswith("video/") | t.contains("mpegurl") | u.rlike(r"(?i)\.(?:mp4|m4v|mov|webm|m3u8)(?:[?#]|\z)") | u.rlike("(?i)/video/|video_dashinit|videoplayback")


def remove_byte_range(url: Column) -> Column:
    return _drop_keys(url, "bytestart|byteend")


def _https_under(url: Column, names: list[str]) -> Column:
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & _is_or_under(host(url), names), F.lit(False))


def is_instagram_media(url: Column) -> Column:
    return _https_under(url, ["cdninstagram.com", "fbcdn.net"])


def is_facebook_media(url: Column) -> Column:
    return _https_under(url, ["fbcdn.net"])


def is_facebook_host(h: Column) -> Column:
    return _is_or_under(F.lower(text(h)), ["facebook.com", "fb.watch"])


def _verdict(url: Column, code: Column) -> Column:
    return F.struct(F.when(code.isNull(), F.regexp_replace(url, r"#.*\z", "")).alias("url"), code.alias("error_code"))


def validate_facebook(url: Column) -> Column:
    """{url, error_code}: an https page of the platform without its fragment, or why not."""
    c = trim(text(url))
    bad = F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))) != "https", F.lit(True))
    return _verdict(c, F.when(bad, "INVALID_FACEBOOK_VIDEO_URL").when(~is_facebook_host(host(c)), "UNSUPPORTED_FACEBOOK_VIDEO_PLATFORM"))


def validate_instagram(url: Column) -> Column:
    c = trim(text(url))
    bad = F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))) != "https", F.lit(True))
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    other = ~F.coalesce(host(c).isin("instagram.com", "www.instagram.com"), F.lit(False))
    return _verdict(c, F.when(bad, "INVALID_PUBLIC_VIDEO_URL").when(other, "UNSUPPORTED_PUBLIC_VIDEO_PLATFORM").when(~path.rlike("(?i)^/(?:reel|reels|p)/"), "UNSUPPORTED_INSTAGRAM_PATH"))


def is_supported(verdict: Column) -> Column:
    return verdict["error_code"].isNull()


def clean_hostname(value: Column) -> Column:
    return F.regexp_replace(F.lower(trim(text(value))), r"\.\z", "")


def is_tiktok_host(h: Column) -> Column:
    c = clean_hostname(h)
    return c.isin(*v.TIKTOK_HOSTS) | c.endswith(".tiktok.com")


def validate_tiktok(url: Column) -> Column:
    """{url, error_code}: a video's address in its canonical form, else without fragment."""
    c = trim(text(url))
    scheme, path = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    code = F.when(scheme.isNull() | host(c).isNull(), "INVALID_TIKTOK_URL").when(~scheme.isin("http", "https"), "INVALID_TIKTOK_PROTOCOL").when(~is_tiktok_host(host(c)), "UNSUPPORTED_TIKTOK_HOST")
    pattern = r"^/@([^/]+)/video/([0-9]+)/?\z"
    direct = F.concat(F.lit("https://www.tiktok.com/@"), F.regexp_extract(path, pattern, 1), F.lit("/video/"), F.regexp_extract(path, pattern, 2))
    return F.struct(F.when(code.isNull(), F.when(path.rlike(pattern), direct).otherwise(F.regexp_replace(c, r"#.*\z", ""))).alias("url"), code.alias("error_code"))


def canonical_tiktok(html: Column) -> Column:
    """The embedded video's address: a ``cite`` attribute, else the first link, else empty."""
    cite = F.regexp_extract(text(html), r"(?i)\bcite=([\"'])(https?://www\.tiktok\.com/@[^\"'<>]+/video/[0-9]+)\1", 2)
    link = F.regexp_extract(text(html), r"(?i)https?://www\.tiktok\.com/@[^\"'<>?\s]+/video/[0-9]+", 0)
    return F.coalesce(validate_tiktok(F.coalesce(F.nullif(cite, F.lit("")), F.nullif(link, F.lit(""))))["url"], F.lit(""))


def pin_url(html: Column, final_url: Column) -> Column:
    decoded = decode_pin_text(html)
    full = F.nullif(F.regexp_extract(decoded, r"(?i)https?://(?:www\.)?pinterest\.[a-z.]+/pin/[0-9]+/?", 0), F.lit(""))
    number = F.coalesce(F.nullif(F.regexp_extract(decoded, r"(?i)\"pin_id\"\s*:\s*\"([0-9]+)\"", 1), F.lit("")), F.nullif(F.regexp_extract(decoded, r"(?i)/pin/([0-9]+)/?", 1), F.lit("")))
    return F.when(is_pin(final_url), final_url).otherwise(F.coalesce(clean_pin_candidate(full), F.concat(F.lit("https://www.pinterest.com/pin/"), number, F.lit("/"))))


# Where pages of pins name their source, in order.
PIN_PATTERNS = [rf'"{k}"\s*:\s*"([^"]+)"' for k in ("destination_url", "dominant_link", "website_url", "domain_url", "link", "url", "canonical_url")] + [
    r'property="og:url"\s+content="([^"]+)"', r'name="twitter:url"\s+content="([^"]+)"', r'href="([^"]+)"',
]


def external_candidates(html: Column) -> Column:
    """Addresses a pin's page names, in pattern then document order, without bad ones."""
    decoded = decode_pin_text(html)
    found = F.flatten(F.array(*(F.regexp_extract_all(decoded, F.lit(p), 1) for p in PIN_PATTERNS)))
    clean = F.transform(found, clean_pin_candidate)
    return F.array_distinct(F.filter(clean, lambda u: u.isNotNull() & ~is_bad_candidate(u)))


def best_external(candidates: Column) -> Column:
    good = F.filter(candidates, lambda u: ~is_bad_candidate(u))
    likely = F.filter(good, lambda u: F.lower(u).rlike("recipe|food|kitchen|cooking|dinner|baking"))
    return F.coalesce(F.get(likely, F.lit(0)), F.get(good, F.lit(0)))


def file_extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(text(name)), r"\.[a-z0-9]+\z", 0)


def first_link(value: Column) -> Column:
    c = trim(text(value))
    found = F.regexp_extract(c, rf"(?i)https?://(?:(?!{v.WS})[^\"'<>])+", 0)
    return F.when(found == "", c).otherwise(found)


def canonical(url: Column) -> Column:
    """SQL form of import_url for plain pages: no fragment, no tracking keys.

    Redirect parameters and the re-spelling of queries are left to import_url.
    """
    c = first_link(url)
    return F.when(is_social(c) | c.contains("pin.it"), c).otherwise(_drop_keys(F.regexp_replace(c, r"#.*\z", ""), "|".join(v.TRACKING)))


def _serialize(parts, query: str | None, fragment: str) -> str:
    netloc = (parts.hostname or "").lower()
    if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)):
        netloc += f":{parts.port}"
    path = quote(parts.path, safe="/:@!$&'()*+,;=-._~%[]") or "/"
    return urlunsplit((parts.scheme, netloc, path, parts.query if query is None else query, fragment))


def normalize_url(raw: str | None) -> str:
    """One shared link to the address to import, as scripts of web pages parse URLs.

    Redirects are unwrapped however deep they nest: each target is shorter than its wrapper.
    """
    import re

    value = (raw or "").strip()
    while True:
        m = re.search(r"https?://[^\s\"'<>]+", value, re.I)
        candidate = m[0] if m else value
        try:
            parts = urlsplit(candidate)
            if not parts.scheme or not parts.hostname:
                return candidate
            pairs = parse_qsl(parts.query, keep_blank_values=True)
            origin = f"{parts.scheme}://{parts.netloc}/"
            given = dict(reversed(pairs))
            target = next((urljoin(origin, given[k]) for k in v.REDIRECTS if given.get(k) and re.match("https?://", urljoin(origin, given[k]), re.I)), None)
            if target and len(target) < len(candidate):
                value = target
                continue
            if any(h in parts.hostname.lower() for h in [*v.SOCIAL_HOSTS, "pin.it"]):
                return _serialize(parts, None, parts.fragment)
            return _serialize(parts, urlencode([(k, x) for k, x in pairs if k not in v.TRACKING], safe="*-._"), "")
        except ValueError:
            return candidate


@F.pandas_udf(StringType())
def import_url(urls: pd.Series) -> pd.Series:
    """normalize_url over a column: redirects unwrapped, tracking and fragment dropped."""
    return urls.map(normalize_url)
