"""Inputs that once cost an article, or time that grew with the square of a text."""

import time

import pytest

PROSE = "Plain words of a paragraph that belong to the article of this page. "
PAIR = f"<p>{PROSE * 4}</p><p>{PROSE * 3}</p>"
TEXT = f"{(PROSE * 4).strip()}\n\n{(PROSE * 3).strip()}"


@pytest.mark.parametrize("name", "social-story share-container related-content notice-text search-results-body post-ad-free promotion-body hidden-xs-wrap newsletter-issue article-comment-content".split())
def test_class_words_do_not_delete_the_text(name):
    from larder.llm.main_text import extract_text

    assert extract_text(f"<h1>Title</h1><div class='{name}'>{PAIR}</div>") == f"Title\n\n{TEXT}"
    assert extract_text(f"<main><div class='{name}'><h2>Head</h2>{PAIR}</div></main>") == f"Head\n\n{TEXT}"
    assert extract_text(f"<div class='{name}'><p>{PROSE * 4}</p></div><div class='{name}'><p>{PROSE * 3}</p></div>") == TEXT


def test_furniture_still_goes():
    from larder.llm.main_text import extract_text

    long = f"<p>{PROSE * 9}</p>"
    for page in (
        f"<article><h1>Title</h1>{PAIR}</article><div class='related'>{long}{long}</div>",
        f"<article><h1>Title</h1>{PAIR}</article><section class='comments'>{long * 9}</section>",
        f"<article><h1>Title</h1>{PAIR}<div class='ad'><p>Buy now.</p></div></article>",
        f"<div class='cookie-notice'><p>{PROSE}</p></div><h1>Title</h1>{PAIR}<div class='comment-list'>{long * 9}</div>",
    ):
        assert extract_text(page) == f"Title\n\n{TEXT}", page
    assert extract_text(f"<div class='ad'><p>{PROSE * 5}</p></div><article><h1>Title</h1><p>Short.</p></article>") == "Title\n\nShort."


def test_license_rules_are_linear():
    from larder.llm.licenses import rules, scan_text

    starts = {r.keyword for r in rules()} | {"spdx-license-identifier:", "spdx-license-identifier: (", "gpl, version", "licensed under the", "php license,", "neither the name of"}
    for start in sorted(starts):
        began = time.thread_time()
        scan_text(start + " " * 300_000)
        assert time.thread_time() - began < 2, start
    for text in ("©" * 50_000 + " all rights reserved", "docs.python.org/" * 20_000 + " license", "spdx-license-identifier: mit or " * 5000, "licensed under the " * 20_000 + " mit license"):
        began = time.thread_time()
        scan_text(text)
        assert time.thread_time() - began < 2, text[:20]


def test_license_tags():
    from larder.llm.licenses import rules, scan_text, tagged

    for text in ("spdx-license-identifier: mit", "spdx-license-identifier:(apache-2.0 or mit)", "x spdx-license-identifier: nope or isc spdx-license-identifier: mit or mit", "xspdx-license-identifier: mit", "spdx-license-identifier: mit-like", "spdx-license-identifier: mit and"):
        want = {(m.start(), m.end(), r) for r in rules() if r.keyword == "spdx" for m in r.pattern.finditer(text)}
        assert set(tagged(text)) == want, text
    assert scan_text("SPDX-License-Identifier:" + " " * 100_000 + "ISC")[5] == "isc"


def test_pipeline_keeps_rows_without_an_id_of_their_own(spark):
    import corpus_pipeline as c

    texts = [f"{word} " + " ".join(f"{word}{i}" for i in range(60)) for word in ("one", "two", "three", "four", "five")]
    given = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (None, texts[4] + " more"), (3, texts[3] + " more"), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in c.near_dedup(spark, docs, "").collect())))
    assert kept == sorted(map(str, [(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[4]), (3, texts[3] + " more"), (5, ""), (6, "")]))


def test_interleave_order_is_the_plain_one(spark):
    import hashlib
    import zlib

    from larder.llm.interleave import interleave, shard_documents

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    docs += [(9001, None, None), (9002, "", "src1"), (9003, "é漢", "src1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    strata = {}
    for i, _, source in docs:
        strata.setdefault("n" if source is None else "s" + source, []).append((hashlib.md5(f"17|{i}".encode()).hexdigest(), i))
    order = sorted(((r + 0.5) / len(own), s, r, i) for s, own in strata.items() for r, (_, i) in enumerate(sorted(own)))
    want = {}
    for place, (_, _, _, i) in enumerate(order):
        shard = place * 7 // len(order)
        want[i] = (shard, place - -(-shard * len(order) // 7))
    got = shard_documents(frame, 7).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
    body = {i: (t or "").encode() for i, t, _ in docs}
    assert all((r["size"], r["text_crc32"]) == (len(body[r["doc_id"]]) + 16, zlib.crc32(body[r["doc_id"]])) for r in got)
    clash = frame.selectExpr("doc_id", "source", "'x' AS _before", "1 AS _n")
    assert sorted((r["doc_id"], r["shard"]) for r in interleave(clash, 7).collect()) == sorted((i, s) for i, (s, _) in want.items())
