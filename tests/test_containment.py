"""Containment against a plain search of every text for every passage."""

import random

import pytest

from larder.operators.containment import BLOCK, COVERED, contained


def pairs(frame, columns=("doc_id", "item_id")):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in frame.collect())))


def plain(docs, passages):
    return sorted(str((d, p)) for d, body in docs for p, sought in passages if body is not None and sought and sought in body)


def test_every_length_of_passage(spark):
    rng = random.Random(1)
    vocabulary = ["a", "bb", "cc", "dé", "e.", "f", "漢", "gg-g"]
    join = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))
    docs = [(i, join(rng.randint(0, 60))) for i in range(60)]
    docs += [docs[3], (7, "another text of id seven"), (None, docs[5][1]), (90, None), (91, ""), (92, "a " * 5000)]
    passages = [(100 + i, body[a : a + n]) for i, (_, body) in enumerate(docs[:60]) for a, n in [(rng.randint(0, max(0, len(body) - 1)), rng.choice([1, 2, 3, 5, 10, 20, 40, 80]))]]
    passages += [(200, None), (200, ""), (201, " "), (202, "a a a a a a a a a a a a a"), (203, "never seen word"), (204, join(COVERED + 2)), passages[0], (205, passages[1][1]), (None, "bb"), (206, "no such words stand anywhere in any of the texts given here")]
    given = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, number int, key string")
    asked = spark.createDataFrame([(*p, 1, "r") for p in passages], "item_id long, text string, whole int, row string")
    want = plain(docs, passages)
    assert len(want) > 300 and pairs(contained(given, asked)) == want
    assert pairs(contained(given.limit(0), asked)) == pairs(contained(given, asked.limit(0))) == []


def test_short_passages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr("larder.operators.containment.MOST_SHORT", 3)
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at most 3"):
        contained(docs, spark.createDataFrame([(1, "ab"), (2, "cd")], "item_id long, text string"))


def test_no_cross_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = contained(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_passages_of_two_words_are_looked_up_by_key(spark, monkeypatch):
    monkeypatch.setattr("larder.operators.containment.MOST_SHORT", 3)
    docs = [(1, "beginning endings"), (2, "ending beginning")]
    passages = [(i, word + rest) for i, (word, rest) in enumerate([("beginning", " end"), ("ginning", " endin"), ("ing", " beginnin"), ("beginnings", " end")])]
    got = pairs(contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")))
    assert got == plain(docs, passages) and len(got) == 3


def test_every_size_of_key_across_blocks(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abé 漢") for _ in range(n))) for i, n in enumerate([10, 60_000, 90_000, 200_000, 0, 3000])]
    docs += [(6, "ab" * 40_000), (7, "\x00" * 20 + "z")]
    passages = [(n, docs[3][1][at : at + n]) for n in range(1, 60) for at in [BLOCK // 2 - n]]
    passages += [(100 + n, docs[2][1][-n:]) for n in (17, 61, 400, 5000)] + [(200 + n, docs[5][1][:n]) for n in (16, 300)] + [(300, "ab" * 30_000 + "a"), (301, "ba" * 20), (302, docs[2][1] + "a"), (303, "\x00z"), (304, "\x00" * 18), (305, "\x00" * 21)]
    got = pairs(contained(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(passages, "item_id long, text string")))
    assert got == plain(docs, passages) and len(got) > 70
