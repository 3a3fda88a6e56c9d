"""Operators of the training-data pipeline against brute force, and their edge cases."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, key string, id long, n_words long"
TOKENIZERS = "/opt/tokenizers"
SF = "/root/testdata/sf0.001"


def rows():
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    body = "the cat sat on the mat and then it ran away from the big dog that lived next door to the old house"
    texts = [body, body, body.upper(), body + " today", None, "", "  \n\t ", "Word", "two words", "x " * 3000, "α β γ\n" * 40, "license", body + "\n" + body, "é" * 50, "MIT License. Released under the MIT License.", "1 2 3 !!!"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 0, "a", "b", 7, 9) for i, t in enumerate(texts)]
    return [*out, out[0], (None, body, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def test_katz_is_the_brute_force_model(spark, real):
    from larder.llm.katz import Discount, K, score

    got = {r["doc_id"]: r for r in score(real).collect()}
    texts = {r["doc_id"]: [*words(r["text"]), "\n"] for r in real.collect()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        one.update(texts[i])
        two.update(zip(["<s>", *texts[i]], texts[i], strict=False))
    total, types = sum(one.values()), len(one)
    d1, d2 = (Discount([sum(v == r for v in c.values()) for r in range(K + 2)]) for c in (one, two))
    lost = lambda d, c: float(d.lost(np.array([c]))[0])
    unknown = sum(lost(d1, v) for v in one.values()) / total
    p1 = lambda w: (one[w] - lost(d1, one[w])) / total if w in one else unknown
    after = collections.defaultdict(dict)
    for (h, w), v in two.items():
        after[h][w] = v
    seen = {h: sum(f.values()) for h, f in after.items()}
    weight = {h: sum(lost(d2, v) for v in f.values()) / seen[h] / (1 - sum(map(p1, f))) for h, f in after.items()}
    p = lambda h, w: (after[h][w] - lost(d2, after[h][w])) / seen[h] if w in after.get(h, ()) else weight.get(h, 1) * p1(w)
    assert sum(p("the", w) for w in one) + weight["the"] * unknown == pytest.approx(1)
    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t, strict=False)))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (total + types + 1)) for w in t))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(w in one for w in t), total)


def test_katz_edges(docs, none):
    from larder.llm.katz import score

    got = score(docs).collect()
    assert len(got) == len(rows()) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    assert score(none).count() == 0


def test_quality_counts(spark, docs, none, real):
    from larder.llm.quality import judge

    for table in (docs, real):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in judge(table).collect():
            text = texts[r["doc_id"]]
            w = WORDS.findall(text)
            grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
            lines = [x for x in text.split("\n") if WORDS.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
            assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
            assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
            assert not (r["base_failed"] and r["kept"])
    assert judge(none).count() == 0


def test_quality_rejects_junk_and_keeps_clean(spark, real):
    from larder.llm.quality import judge

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    verdict = [(labels[r["doc_id"]], r["kept"]) for r in judge(real).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert all(kept for good, kept in verdict if good)
    bad = [kept for good, kept in verdict if not good]
    assert sum(bad) <= 0.4 * len(bad)


def test_interleave_law(docs, none, real):
    from larder.llm.interleave import shard_documents

    for table, n in ((docs, len(rows())), (real, 200)):
        got = shard_documents(table, 7).toPandas()
        sizes = got.groupby("shard").size()
        assert len(got) == n and sizes.max() - sizes.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    got = shard_documents(real, 4).toPandas()
    mix = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    assert shard_documents(none, 4).count() == 0


def test_lattice_is_the_brute_force_path(docs, none, real):
    from larder.llm.lattice import encode, pieces, split

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    m = pieces(path)
    for table in (docs, real):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in encode(table, path).collect():
            ids = [x for w in split(texts[r["doc_id"]]) for x in m.spelled(m.fold(w))]
            assert (r["n_pieces"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
            assert m.decode(ids) == texts[r["doc_id"]]
    assert encode(none, path).count() == 0
    word = "▁therein"
    paths = [[]]
    best = max((sum(m.ids[word[a:b]][1] for a, b in zip(cut, cut[1:], strict=False)), cut) for n in range(1 << (len(word) - 1)) for cut in [[0, *(i + 1 for i in range(len(word) - 1) if n >> i & 1), len(word)]] if all(word[a:b] in m.ids for a, b in zip(cut, cut[1:], strict=False)))
    assert paths and sum(dict((i, s) for i, s in m.ids.values())[x] for x in m.fold(word)) == pytest.approx(best[0])


def test_lattice_words_part_only_where_no_piece_crosses():
    import pyarrow as pa

    from larder.llm.lattice import SPACE, pieces, split, split_column

    m = pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    pairs = {p[i : i + 2] for p in m.ids for i in range(len(p) - 1)}
    texts = ["", None, "the  end!!", " x\ny\n\nz ", "漢字 naïve 𝒳𝒳 😀a", "a" * 100 + "%%%", "\n", "  "]
    flat, counts = split_column(m, pa.array(texts))
    words, at = flat.to_pylist(), 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        mine, at = words[at : at + n], at + n
        assert "".join(mine) == "".join(split(text or ""))
        assert not any(a[-1] + b[0] in pairs or a[-1] == b[0] == SPACE for a, b in zip(mine, mine[1:], strict=False))
        assert all(w[i : i + 2] in pairs | {SPACE * 2} for w in mine for i in range(len(w) - 1))
    assert at == len(words)
    none, sizes = split_column(m, pa.array([], pa.string()))
    assert len(none) == 0 and len(sizes) == 0


def test_lattice_counts_words_between_spaces(spark):
    from larder.llm.lattice import decode, encode, pieces, split

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    texts = ["", None, "the  end!!", " x\ny\n\nz ", "漢字 naïve 𝒳𝒳 😀a", "ab" * 100 + "%%%", "\n"]
    table = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    m = pieces(path)
    for r in encode(table, path).collect():
        whole = split(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["n_pieces"], r["round_trip"]) == (len(whole), sum(len(m.spelled(m.fold(w))) for w in whole), True)
    back = decode(encode(table, path, with_ids=True), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    lost = decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path)
    assert {r["doc_id"]: r["text"] for r in lost.collect()} == {1: None, 2: ""}


def test_licenses():
    from larder.llm.licenses import rules, scan_text

    assert len(rules()) > 300 and all(a.priority >= b.priority for a, b in zip(rules(), rules()[1:], strict=False))
    n, base, first, last, labels, every, score = scan_text("x MIT-License, general\npublic license; Apache licenses. mit license")
    assert (n, base, first, last, labels) == (10, 3, 1, 8, "gpl,mit")
    assert scan_text(None) == scan_text("") == (0, 0, None, None, "", "", 0.0)
    assert scan_text("SPDX-License-Identifier: Apache-2.0")[5:] == ("apache-2.0", 1.0)
    assert scan_text("Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc-4.0"
    assert scan_text("licensed under the GNU General Public License, version 3.")[4:6] == ("gpl", "gpl,gpl-3.0")
    assert scan_text("a clean text about cats and their license plates")[5:] == ("", 0.0)


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    from larder.llm.pack import pack

    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    plain = Tokenizer.from_file(path)
    got = sorted(pack(docs, path, 64).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    filled = collections.Counter()
    by_doc = collections.defaultdict(list)
    for r in got:
        assert r["offset"] == filled[r["sequence_id"]] and 0 < r["length"] <= 64
        filled[r["sequence_id"]] += r["length"]
        by_doc[r["doc_id"]].append(r)
    assert all(n == 64 for s, n in filled.items() if s != max(filled))
    for i, text in enumerate(r[1] for r in rows()[:-2]):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = [p for p in by_doc[i]]
        assert sum(p["length"] for p in pieces) == len(ids) * (2 if i == 0 else 1)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids) for p in pieces)
    assert pack(none, path).count() == 0


def components_of(sets, percent):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def test_near_text(docs, none, real):
    from larder.llm.near_text import near_duplicates

    for table in (docs, real):
        sets = {}
        for r in table.filter("doc_id is not null").collect():
            w = words(r["text"])
            sets[r["doc_id"]] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
        want = components_of(sets, 85)
        got = near_duplicates(table).filter("doc_id is not null").collect()
        assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates(none).count() == 0


def test_sketches_merge_and_estimate():
    from larder.llm import setsketch as sk

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(x[:3000]), np.unique(x[500:3500])
    ra, rb, union = sk.registers([a, b, np.union1d(a, b)])
    assert (sk.merge(ra, rb) == union).all()
    n = lambda k: np.array([k])
    assert not sk.may_reach(0.95, ra[None], rb[None], n(3000), n(3000))[0]
    assert sk.may_reach(2500 / 3500, ra[None], rb[None], n(3000), n(3000))[0]


def test_near_vectors(spark):
    from larder.llm.vectors import near_vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 16))
    x[40:60] = x[0] + 0.05 * rng.normal(size=(20, 16))
    x[60:70] = x[1]
    x[80:83] = 2 * x[2]
    given = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [], 1)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    assert [got[i]["n_links"] for i in range(120)] == (near.sum(axis=1) - 1).tolist()
    want = components_of({i: {i} for i in range(120)}, 101)
    for _ in range(120):
        want = {i: min(want[j] for j in np.flatnonzero(near[i]).tolist()) for i in want}
    assert [got[i]["component_id"] for i in range(120)] == [want[i] for i in range(120)]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 205))


def test_language(spark, docs, none, real):
    from larder.llm.langid import identify

    got = identify(real, keep=["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.95
    edge = {r["doc_id"]: r for r in identify(docs).collect()}
    assert {edge[i]["lang_pred"] for i in (4, 5, 6, 15)} == {"und"} and all(0 <= r["score"] <= 1 for r in edge.values())
    assert identify(none).count() == 0


def test_mixture_of_two():
    from larder.llm.langid import BINS, SMOOTHING, mixtures, trigram_bins

    a, b = "the cat and the dog " * 60, "der hund und die katze " * 60
    counts = np.stack([np.bincount(trigram_bins(t), minlength=BINS) for t in (a, b)], axis=1) + SMOOTHING
    (one, both, none), gain = mixtures([a[:400], a[:400] + b[:400], "qxv zjw kpy " * 20], np.log(counts / counts.sum(axis=0)))
    assert [i for i, _ in one] == [0] and sorted(i for i, _ in both) == [0, 1]
    assert none and gain[0] > 1 and gain[1] > 1 and gain[2] < 0


def test_main_text():
    from larder.llm.main_text import extract_text

    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><a>Home</a></header><nav><ul><li><a>x</a></ul></nav><div class='cookie-notice'>We use cookies on this site</div>"
        "<article><h1>A &amp; B</h1><p>First   <b>long</b> paragraph of\nthe article with words.<p>Second.<script>var t='</p>';</script></article><aside>side</aside>"
        "<section class='comments'><p>A reader says something quite long here, really.</p></section><form>Sign up</form><footer>&copy; me</footer></body></html>"
    )
    assert extract_text(page) == "A & B\n\nFirst long paragraph of the article with words.\n\nSecond."
    assert extract_text(None) == extract_text("") == extract_text("<nav>only</nav>") == ""
    assert extract_text("<div><p>" + "plain words in a page without an article " * 5 + "</p></div><div class=ad>buy</div>").startswith("plain words")
    assert extract_text("just text") == "just text"


def test_pipeline_on_edges(spark, tmp_path):
    import corpus_pipeline as c

    table = spark.createDataFrame(rows(), SCHEMA)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in c.STAGES] == ["quality", "language", "near_dedup", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for _, stage in c.STAGES[:-1]:
        before = {r["doc_id"] for r in left.select("doc_id").collect()}
        left = stage(spark, left, str(tmp_path))
        assert left.columns == c.COLUMNS and {r["doc_id"] for r in left.select("doc_id").collect()} <= before
    assert {r["doc_id"] for r in c.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in left.collect()}


@pytest.mark.parametrize("order", [3, 4])
def test_katz_of_longer_histories_is_the_brute_force_model(spark, real, order):
    from larder.llm.katz import Discount, K, score

    got = {r["doc_id"]: r for r in score(real, order=order).collect()}
    texts = {r["doc_id"]: ["<s>", *words(r["text"]), "\n"] for r in real.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    grams = {k: collections.Counter(tuple(t[j - k + 1 : j + 1]) for t in train for j in range(max(k - 1, 1), len(t))) for k in range(1, order + 1)}
    d = {k: Discount([sum(v == r for v in c.values()) for r in range(K + 2)]) for k, c in grams.items()}
    cut = {k: {g: v - float(d[k].lost(np.array([v]))[0]) for g, v in c.items()} for k, c in grams.items()}
    total = sum(grams[1].values())
    after = collections.defaultdict(dict)
    for k in range(2, order + 1):
        for g, v in grams[k].items():
            after[g[:-1]][g[-1]] = v

    def p(h, w):
        if not h:
            return cut[1].get((w,), sum(grams[1].values()) - sum(cut[1].values())) / total
        if h not in after:
            return p(h[1:], w)
        if w in after[h]:
            return cut[len(h) + 1][(*h, w)] / sum(after[h].values())
        return weight(h) * p(h[1:], w)

    cache = {}

    def weight(h):
        if h not in cache:
            left = sum(v - cut[len(h) + 1][(*h, w)] for w, v in after[h].items()) / sum(after[h].values())
            cache[h] = left / (1 - sum(p(h[1:], w) for w in after[h]))
        return cache[h]

    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(tuple(t[max(0, j - order + 1) : j]), t[j])) for j in range(1, len(t))))


def test_license_keywords_are_needed_by_their_patterns():
    from re import _parser

    from larder.llm.licenses import literal_runs, rules, scan_text

    for r in rules():
        branches = [r.pattern.pattern] if r.label != "proprietary" else r.pattern.pattern[3:-1].split("|")
        assert all(any(r.keyword in x for x in literal_runs(_parser.parse(b))) for b in branches), r
    for text, label in [
        ("Redistribution and\nuse in source and binary forms, with or without\n# modification, are permitted", "bsd"),
        ("released into the public\n# domain", "public-domain"),
        ("Permission is\nhereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("under the terms of the GNU General Public License as published by the Free\n * Software  Foundation", "gpl"),
        ("Copyright 2020 me. All rights\nreserved", "all-rights-reserved"),
        ("you may not use this file except in compliance\nwith the Licence", "apache-2.0"),
        ("This software is provided 'as is', without any express or implied warranty. In no event will the authors be held liable", "zlib"),
        ("Apache License 2.0", "apache-2.0"),
        ("see apache.org/license", "apache"),
    ]:
        assert label in scan_text(text)[5].split(","), text


def test_near_vectors_of_several_lengths(spark):
    from larder.llm.vectors import near_vectors

    rng = np.random.default_rng(6)
    given, want = [], {}
    for first, n, dim in ((0, 60, 24), (100, 40, 16), (200, 2, 8), (300, 1, 5)):
        x = rng.normal(size=(n, dim))
        x[n // 2 :] = 3 * x[: n - n // 2] + 0.01 * rng.normal(size=(n - n // 2, dim))
        u = x / np.linalg.norm(x, axis=1)[:, None]
        near = u @ u.T >= 0.95
        given += [(first + i, v.tolist()) for i, v in enumerate(x)]
        want |= {first + i: (int(near[i].sum()) - 1, first + int(np.flatnonzero(near[i])[0])) for i in range(n)}
    got = near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert sum(n for i, (n, _) in want.items() if 100 <= i < 200) >= 40


def test_mixture_of_all_languages():
    from larder.llm.langid import BINS, SMOOTHING, mixtures, trigram_bins

    texts = ["the cat and the dog " * 60, "der hund und die katze " * 60, "el perro con una gata " * 60, "chien avec notre chat " * 60, "кошка или собака " * 60]
    counts = np.stack([np.bincount(trigram_bins(t), minlength=BINS) for t in texts], axis=1) + SMOOTHING
    log_p = np.log(counts / counts.sum(axis=0))
    for n in (1, 4, 5):
        found, _ = mixtures(["word", "".join(texts[:n]), texts[4]], log_p)
        assert sorted(i for i, _ in found[1]) == list(range(n)) and max(v for _, v in found[1]) < 1 / n + 0.1
        assert [i for i, _ in found[2]] == [4]


def test_near_text_of_repeated_ids(spark):
    from larder.llm.near_text import near_duplicates

    a = " ".join(f"w{i}" for i in range(62))
    b = " ".join(f"v{i}" for i in range(62))
    given = [(1, a), (1, b), (2, a + " q"), (3, b + " q"), (4, "x y z u"), (5, None), (1, a), (1, a), (0, b + " r q"), (9, "x y z u"), (9, "")]
    got = near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert len(got) == len(given)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5), (9, 4), (9, 9)}
    same = [(7, a)] * 5 + [(8, a)] * 3 + [(6, b)] * 2
    got = near_duplicates(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(6, 6)] * 2 + [(7, 7)] * 5 + [(8, 7)] * 3


def test_near_vectors_of_any_scale_and_two_levels(spark):
    from larder.llm.vectors import near_vectors

    given = [(1, [1e180, 2e180]), (2, [1e200, 2e200]), (3, [1e-200, 2e-200]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0])]
    got = near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (5, 2, 4), (6, 0, 6), (7, 0, 7), (None, 0, None)}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, a string, id long")).count() == 0
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 12))
    x[600:] = x[:300] + 0.08 * rng.normal(size=(300, 12))
    near = np.array([[np.dot(p, q) / np.linalg.norm(p) / np.linalg.norm(q) for q in x] for p in x]) >= 0.95
    table = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, id string")
    for most in (4096, 5):
        got = {r["vec_id"]: r["n_links"] for r in near_vectors(table, max_lists=most).collect()}
        found, there = sum(got.values()), int(near.sum()) - 900
        assert all(got[i] <= near[i].sum() - 1 for i in got) and found >= 0.95 * there > 300


def test_packing_of_long_runs(spark):
    from tokenizers import Tokenizer

    from larder.llm.pack import pack

    plain = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 1_000_000 + "b", "long and plain text, " * 50_000]
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{TOKENIZERS}/byte_bpe_50k.json").collect()
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


def test_lattice_owns_up_to_marks_in_texts(spark):
    from larder.llm.lattice import LINE, SPACE, encode

    table = spark.createDataFrame([(1, f"a{SPACE}b"), (2, f"a{LINE}b"), (3, "a b\n"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in encode(table, f"{TOKENIZERS}/piece_bpe_32k.model").collect()} == {1: False, 2: False, 3: True, 4: True}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("larder")]


def test_licenses_of_tables_and_long_texts(spark, docs, none):
    from larder.llm.licenses import detections, rules, scan_licenses, scan_text

    assert scan_licenses(none).count() == 0
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (dict((x[0], x[1]) for x in rows())[r["doc_id"]] or "").translate(LOWER))
            places = sorted(i for p in (["mit", "license"], ["apache", "license"], ["general", "public", "license"]) for i in range(len(w)) if w[i : i + len(p)] == p)
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0] if places else None, places[-1] if places else None)
    text = "licensed under the mit license, or the apache license 2.0; general public license version 3. spdx-license-identifier: mit " * 3
    hits = [(m.start(), m.end(), r) for r in rules() for m in r.pattern.finditer(text)]
    kept = []
    for h in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)):
        if not any(a <= h[0] and h[1] <= b for a, b, _ in kept):
            kept.append(h)
    assert detections(text) == sorted(kept, key=lambda h: (h[0], h[1]))
    assert scan_text(text * 3000)[1] == 9 * 3000  # a megabyte


def test_main_text_of_any_markup(spark, none):
    import random

    from larder.llm.main_text import extract_pages, extract_text

    line = "Plain words of a paragraph that belong to the article of this page. "
    body = f"<h1>Title</h1><p>{line * 4}</p><p>Short.</p><p>{line * 3}</p>"
    want = "\n\n".join(["Title", (line * 4).strip(), "Short.", (line * 3).strip()])
    for page in (
        '<div class="content has-sidebar">%s</div>', '<div class="overflow-hidden">%s</div>', '<div class="post comments-open">%s</div>', '<div id="search-article">%s</div>', '<div class="social widget">%s</div>',
        "<div><a>Home</a> <a>News</a> <a>Sports</a></div><div>%s</div>", "<article>%s<ul><li><a href=1>Another</a></li><li><a>One more</a></li></ul></article>", "<![x[y]]>%s", "%s<![x[", "%s<!-- never closed", "%s<a href='",
        "<main>%s</main><div class='comment-list'><p>" + "A reader says a lot. " * 90 + "</p></div>", "<body class='no-sidebar'><div class='site-header'>Name</div>%s<div class='related-posts'><p>" + line + "</p></div>",
    ):
        assert extract_text(page % body) == want, page
    for page in ("<div>" * 20000 + "x", "<p><b class=x>" * 20000, "<!--" * 100_000, "<a " * 100_000, "<![" * 100_000, "<ul><li>" * 20000 + "x", "</" * 100_000, "<" * 100_000):
        extract_text(page)
    rng = random.Random(1)
    parts = ["<", ">", "!", "[", "]", "-", "--", "/", "a", "div", "p", " ", '"', "'", "=", "&", "#", "script", "CDATA", "doctype", "?", "\n", "article", ";", "\x00", "<![", "</", "<!--"]
    for _ in range(3000):
        extract_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))))
    table = spark.createDataFrame([(1, None, None, "x"), (1, "u", f"<article>{body}</article>", "x"), (None, "u", "", "x"), (2, "u", "<nav>only</nav>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_pages(table).collect()) == [(0, "", 0), (1, "", 0), (1, want, len(want)), (2, "", 0)]
    assert extract_pages(table.limit(0)).count() == 0


def minimum_covariance(v):
    """Centre and covariance of rows by the steps that the operator's docstrings tell, in numpy."""
    from larder.llm.quality import LEAST_SD, _chi2_quantile, _consistency

    floor = np.array(LEAST_SD)

    def factor(c):
        low = np.zeros((4, 4))
        for j in range(4):
            low[j, j] = math.sqrt(max(c[j, j] - low[j, :j] @ low[j, :j], floor[j] ** 2))
            for i in range(j + 1, 4):
                low[i, j] = (c[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        return low

    def distance(m, low):
        return (np.linalg.solve(low, (v - m).T) ** 2).sum(axis=0)

    def quantile(bins):  # the least bin at which half of the rows is reached
        return np.sort(bins)[math.ceil(0.5 * len(bins)) - 1]

    median = np.array([(quantile(np.floor(v[:, i] * 2000)) + 0.5) / 2000 for i in range(4)])
    sd = np.array([max(1.4826 * (quantile(np.floor(abs(v[:, i] - median[i]) * 2000)) + 0.5) / 2000, floor[i]) for i in range(4)])
    z = (v - median) / sd
    starts = [np.eye(4)]
    for w in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        p = w.T @ w / len(v)
        d = np.diag(p)
        r = p / np.sqrt(np.maximum(np.outer(d, d), 1e-18))
        np.fill_diagonal(r, 1)
        starts.append(r)

    def concentrate(m, low):
        at = np.minimum(np.floor(np.log1p(distance(m, low)) * 200), 2400)
        inner = v[at <= quantile(at)]
        return inner.mean(axis=0), factor(np.cov(inner.T, bias=True) * _consistency(0.5))

    ends = []
    for r in starts:
        m, low = median, factor(r * np.outer(sd, sd))
        for _ in range(2):
            m, low = concentrate(m, low)
        ends.append((np.diag(low).prod(), len(ends), m, low))
    _, _, m, low = min(ends, key=lambda e: e[:2])
    for _ in range(4):
        m, low = concentrate(m, low)
    inner = v[distance(m, low) <= _chi2_quantile(0.975)]
    return distance(inner.mean(axis=0), factor(np.cov(inner.T, bias=True) * _consistency(0.975)))


def test_quality_verdict_is_the_brute_force_one(spark):
    from larder.llm.quality import CUTOFF, X, _chi2_cdf, judge, text_statistics

    assert 1 - _chi2_cdf(CUTOFF, 4) == pytest.approx(1e-9, rel=0.1)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = judge(table).toPandas().set_index("doc_id")
    stats = text_statistics(table, ["doc_id", "lang", "source"]).toPandas().set_index("doc_id").join(got[["base_failed", "kept", "distance"]])
    good = stats[~stats.base_failed]
    sizes = good.groupby(["lang", "source"], dropna=False).size()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    whole = 0
    for (lang, source), n in sizes.items():
        own = good[(good.lang == lang) & (good.source == source)]
        if n >= 20:
            d = minimum_covariance(own[X].to_numpy())
            assert np.allclose(own.distance, d, rtol=1e-6), (lang, source)
            assert (own.kept == (d <= CUTOFF)).all()
            whole += n
    assert whole > 300 and good.distance.notna().all()
    verdict = [(labels[i], k) for i, k in good.kept.items() if i in labels]
    assert sum(k for q, k in verdict if not q) <= 0.05 * sum(not q for q, _ in verdict)
    assert sum(not k for q, k in verdict if q) <= 0.02 * sum(q for q, _ in verdict)


def test_pipeline_is_the_brute_force_one(spark, real, tmp_path):
    """Base rules and covariances by numpy, letters, all pairs of sets, plain tokens."""
    from tokenizers import Tokenizer

    import corpus_pipeline as c
    from larder.llm.quality import CUTOFF, X, text_statistics

    given = [tuple(r) for r in real.select(*c.COLUMNS).collect()]
    base = next(r for r in given if r[0] == 3)
    copy = base[1].split()
    given += [(9001, " ".join([*copy[:-1], "changed"]), *base[2:]), (9002, None, "en", "s", 0), (9003, "1 2 3 " * 30, "en", "s", 0), (9004, "qxv zjw kpy xqj wzv vkx " * 2 + "qqx jjz wwk vvy xxq zzj ppk yyw qzx jwk vzy kxq wjz pky", "en", "s", 0), given[5], given[5], (None, base[1], *base[2:])]
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    s = text_statistics(table, c.COLUMNS).toPandas()
    s["n_words_again"] = [len(WORDS.findall(x or "")) for x in s.text]
    assert (s.n_words == s.n_words_again).all()
    s = s[(s.n_words >= 20) & (100 * s.n_repeat_words <= 30 * s.n_words)].copy()
    pair = s.groupby(["lang", "source"], dropna=False).doc_id.transform("size")
    small = s[pair < 20]
    by_lang = small.groupby("lang", dropna=False).doc_id.transform("size")
    s["group"] = ["rest"] * len(s)
    s.loc[pair >= 20, "group"] = "p" + s.lang.astype(str) + s.source.astype(str)
    s.loc[by_lang[by_lang >= 20].index, "group"] = "l" + s.lang.astype(str)
    s["d"] = 0.0
    for group, own in s.groupby("group"):
        basis = s if group == "rest" and len(own) < 20 else own
        d = minimum_covariance(basis[X].to_numpy())
        s.loc[own.index, "d"] = [d[list(basis.index).index(i)] for i in own.index]
    s = s[s.d <= CUTOFF]
    s = s[[any(ch.isalpha() for ch in x) for x in s.text] & (s.doc_id != 9004)]
    sets = {}
    for i, text in zip(s.doc_id, s.text, strict=True):
        if i == i:  # a row without an id goes
            w = words(text)
            sets[int(i)] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {i for i, root in components_of(sets, 80).items() if i == root}
    plain = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    texts = {int(i): t for i, t in zip(s.doc_id, s.text, strict=True) if i == i}
    tokens = {i: len(plain.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want}
    got = collections.Counter()
    for r in c.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == tokens and 9001 not in got and len(got) > 100
