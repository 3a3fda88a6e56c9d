"""Codebooks, byte-level BPE and the filter audit against plain versions, and their edge cases."""

import base64
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VECTORS = "vec_id long, embedding array<float>, label string, v string, x int, code string, _n int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in Python's integers. rows: (vec_id, label, integers)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2])
    cuts = [round(i * width / parts) if width % parts == 0 else int(i * width / parts) for i in range(parts + 1)]
    cut = lambda v: [v[a:b] for a, b in itertools.pairwise(cuts)]
    books = [list(x) for x in zip(*(cut(r[2]) for r in rows[:entries]), strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for r in rows:
                held.setdefault(nearest(cut(r[2])[p], book), []).append(cut(r[2])[p])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else z for e, z in enumerate(book)]
    out = []
    for i, label, v in rows:
        e = [nearest(x, book) for x, book in zip(cut(v), books, strict=True)]
        out.append((i, label, "".join(f"{k:02x}" for k in e), sum(far(x, book[k]) for x, book, k in zip(cut(v), books, e, strict=True))))
    sha = hashlib.sha256(",".join(str(c) for book in books for z in book for c in z).encode()).hexdigest()
    return sorted((str(i), code, error, sum(r[3] for r in out if r[1] == label), sha) for i, label, code, error in out)


def coded(frame, **kw):
    from larder.llm.codebooks import compress

    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in compress(frame, **kw).collect())


def test_tree_assigns_as_brute_force(monkeypatch):
    from larder.llm import codebooks as c

    rng = np.random.default_rng(5)
    for n, width, spread, entries in [(1, 4, 9, 3), (1000, 4, 2, 64), (3000, 3, 300, 64), (500, 1, 4, 20), (2000, 4, 0, 64), (700, 0, 1, 5), (900, 7, 3, 256)]:
        points, book = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (entries, width))
        tree = c.Tree(points)
        owner, sums, counts = tree.assign(book)
        want = ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.array_equal(owner, want[tree.order])
        assert np.array_equal(counts, np.bincount(want, minlength=entries))
        assert all(np.array_equal(sums[e], points[want == e].sum(axis=0)) for e in range(entries))


def test_codes_are_the_plain_ones(spark, monkeypatch):
    rows = [(r["vec_id"], r["label"], [int(np.floor(256 * x)) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert coded(spark.read.parquet(f"{SF}/embeddings.parquet").repartition(5)) == plain_codes(rows)
    monkeypatch.setattr("larder.llm.codebooks.HOT", 4)  # most labels by the shuffle
    assert coded(spark.read.parquet(f"{SF}/embeddings.parquet")) == plain_codes(rows)


@pytest.mark.parametrize("width", [32, 19, 3])
def test_codes_edges(spark, width):
    rng = random.Random(width)
    good = [(i if i != 7 else None, [rng.uniform(-2, 2) for _ in range(width)], ["a", None][i % 2]) for i in range(20)]
    good += [good[3], (3, good[4][1], "a"), (40, good[0][1], "")]
    bad = [(50, None, "a"), (51, [None] * width, "a"), (52, [float("nan")] * width, None), (53, [float("-inf")] * width, "a"), (54, [1e30] * width, "a"), (55, [], "a"), (56, [0.5] * (width + 1), "a")]
    frame = spark.createDataFrame([(*r, "v", 1, "c", 2) for r in good + bad], VECTORS)
    rows = [(i, label, [int(np.floor(256 * np.float32(x))) for x in v]) for i, v, label in good]
    assert coded(frame) == plain_codes(rows)
    assert coded(frame.filter("vec_id = 55")) == [("55", "00" * 16, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert coded(frame.limit(0)) == [] and coded(frame.filter("vec_id = 50")) == []


@pytest.fixture(scope="module")
def coder():
    from larder.llm.bpe_tree import Coder

    with open(RANKS, "rb") as f:
        return Coder(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 7, 300])
def test_bpe_joins_anywhere(coder, library, monkeypatch, leaf):
    monkeypatch.setattr("larder.llm.bpe_tree.LEAF", leaf)
    rng, parts = random.Random(leaf), ["a", "b", "'", "s", " ", " ", "\n", "1", "é", "漢", "!", "l", "L", "\t", "՘", "꟎", " ", "ing", "the ", "ation", "\U0001f600", "...", " " * 8, "\x1c", "\U00010940"]
    for _ in range(400):
        some = rng.sample(parts, rng.randint(1, len(parts)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 150 if leaf < 300 else 1500)))
        node = coder.encode(text)
        assert node.ids.tolist() == library.encode_ordinary(text)
        assert sum(node.sizes) == len(text) and sum(node.counts) == len(node.ids)


@pytest.mark.parametrize("text", ["a" * 400_000, " " * 300_000 + "x", "ab" * 150_000, "\n" * 100_000, "=-" * 100_000 + "x" * 50_000, "'l" * 60_000], ids=lambda t: repr(t[:3]))
def test_bpe_long_matches(coder, library, text):
    node = coder.encode(text)
    assert node.ids.tolist() == library.encode_ordinary(text)
    assert coder.decode(np.array(node.ids, dtype="<u4")) == text.encode()


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_over_rows(spark, library):
    from larder.llm.bpe_tree import decode, encode, round_trip

    rng = random.Random(3)
    words = ["the", "and", "naïve", "x" * 50, "12", "\n\n", "...", "  ", "don't", "we'll", "ß"]
    long = [" ".join(rng.choice(words) for _ in range(n)) for n in (900, 4000, 15_000)]
    texts = [None, "", " ", "a", "'", *long, long[0], "x" * 9000, " " * 5000 + "y"]
    given = [(i if i != 3 else None, t, 1, "r", b"i", "k") for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*given, given[5]], "doc_id long, text string, row int, k string, ids binary, n_tokens string")
    want = sorted((str(i), *digests(library, t)) for i, t, *_ in [*given, given[5]])
    got = lambda f: sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in f.collect())
    assert got(round_trip(frame, RANKS, PATTERN)) == want
    small = encode(frame, RANKS, PATTERN, segment=101)
    assert sorted((str(r["doc_id"]), r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest()) for r in small.collect()) == [w[:3] for w in want]
    assert sorted((r["bytes"].decode() for r in decode(small, RANKS).collect())) == sorted(t or "" for t in [*texts, texts[5]])
    assert round_trip(frame.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_of_the_table(spark, library):
    from larder.llm.bpe_tree import round_trip

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r["doc_id"], *digests(library, r["text"])) for r in docs.collect())
    assert sorted(tuple(r) for r in round_trip(docs, RANKS, PATTERN).collect()) == want


def plain_audit(docs, labels):
    """The audit by its definition: every order is applied to every document."""
    first, marks = {}, {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        if i is not None:
            good, toxic = marks.get(i, (False, False))
            marks[i] = good or q == 1, toxic or t == 1
    rows = []
    for i, text, part in docs:
        body = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", body)) > 2 * len(body), "D": bool(re.search("[#$%&*|]", body)), "E": i is not None and first.get(body, i) < i}
        rows.append((part or "", fails, *marks.get(i, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            kept = own
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in kept if r[1][f]], [r for r in kept if not r[1][f]]
                shapley[f] += len(gone)
                failing = [r for r in own if r[1][f]]
                out[part, order, step] = [len(kept), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_is_the_plain_one(spark):
    from larder.llm.audit import SQL, audit

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = sorted(tuple(r) for r in audit(docs, labels).collect())
    assert got == plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(con.execute(SQL).fetchall()) == got


def test_audit_edges(spark):
    from larder.llm.audit import audit

    body = " ".join(f"w{i}" for i in range(300))
    docs = [(1, body, "a"), (2, body, "a"), (2, body, "a"), (2, body, "b"), (2, "other", "a"), (None, body, "a"), (None, "", None), (3, None, None), (4, "", ""), (5, "A B", "a"), (6, "x|y " * 400, "b"), (7, " \n\t", "a"), (8, "w " * 300_000, "b"), (9, "É" * 300, "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (77, 1, 1), (6, None, 1)]
    frame = spark.createDataFrame([(*d, 5, "w", True) for d in docs], "doc_id long, text string, source string, n int, word string, fails boolean")
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert sorted(tuple(r) for r in audit(frame, marks).collect()) == plain_audit(docs, labels)
    assert audit(frame.limit(0), marks).count() == 0
    assert sorted(tuple(r) for r in audit(frame, marks.limit(0)).collect()) == plain_audit(docs, [])


def test_ranks_file_is_the_one_described():
    with open(RANKS, "rb") as f:
        assert len({base64.b64decode(x.split()[0]) for x in f}) == 50_256
