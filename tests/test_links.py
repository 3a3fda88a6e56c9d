"""Links against the standard library's joining of addresses."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from larder.operators.pages import absolute

BASES = ["https://a.com", "https://a.com/", "http://a.com/x", "https://a.com/x/y?q=1#f", "https://a.com/x/y/?q=a/b", "https://a.com:81/x/../y", "https://a.com?q=/z"]
LINKS = ["b", "b/c", "/b", "/b/../c", "../b", "../../../b", "./b", ".", "..", "b/.", "b/..", "b/./c/../d", "/", "?k=1", "?k=a/../b", "#g", "b?k=1#g", "b#g?h", "//c.org/d", "https://c.org/d/../e", "mailto:me", "a.b/..c/.d", "..b", "/../..", "b/../"]


def test_links_as_the_library_joins_them(spark):
    given = [(b, x) for b in BASES for x in LINKS]
    got = spark.createDataFrame(given, "base string, link string").select("base", "link", absolute(F.col("base"), F.col("link")).alias("out")).collect()
    for r in got:
        want = urljoin(r["base"], r["link"])
        if "://" in want and not r["link"].startswith(("https:", "//")):
            host, _, rest = want.split("://", 1)[1].partition("/")
            if "/" not in want.split("://", 1)[1].partition("?")[0].partition("#")[0]:  # browsers always have a path
                at = min((want.index(c, 8) for c in "?#" if c in want[8:]), default=len(want))
                want = want[:at] + "/" + want[at:]
        assert r["out"] == want, (r["base"], r["link"])
    one = spark.range(1).select(absolute(F.lit("https://a.com/x"), F.lit("")).alias("none"), absolute(F.lit("https://a.com/x"), F.lit("b//c")).alias("two")).first()
    assert tuple(one) == ("", "https://a.com/b//c")
