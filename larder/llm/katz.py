"""Katz backoff language model: learn, normalise and score over chunked documents."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.chunks import bucket_starts, chunk_table, hashes, lists, pack_words, squeeze, squeeze_sorted, squeeze_values, training_flag, unpack_words, unsqueeze, unsqueeze_codes, unsqueeze_sorted, unsqueeze_values
from larder.llm.common import release, remove, staged
from larder.llm.setsketch import _mix
from larder.llm.tokens import words

#: Counts up to K are discounted by Good-Turing; a larger count loses what K loses.
K = 5
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
KEYS_A_BUCKET = 2_000_000


class Discount:
    """Good-Turing discounts d(r) of one order, from its counts of counts.

    For r up to K: Katz's d(r) = (r*/r - q) / (1 - q), r* = (r+1) n(r+1) / n(r),
    q = (K+1) n(K+1) / n(1). Where that is not in (0, 1) (small corpora have gaps in
    their counts of counts) it is (r - D) / r with D = n1 / (n1 + 2 n2), and 0.5 if
    there is no n1. A count beyond K loses as much as K does, 0.001 at least, so that
    every history keeps mass for words not seen after it.
    """

    def __init__(self, n: list[int]):
        n1, n2 = n[1], n[2]
        absolute = n1 / (n1 + 2 * n2) if n1 else 0.5
        absolute = min(max(absolute, 0.001), 0.999)
        q = (K + 1) * n[K + 1] / n1 if n1 else 1.0
        table = [1.0]
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (n[r] * r) - q) / (1 - q) if n[r] and q != 1 else 0.0
            table.append(d if 0 < d < 1 else (r - absolute) / r)
        self.table = np.array(table)
        self.beyond = max(K * (1 - table[K]), 0.001)

    def lost(self, counts: np.ndarray) -> np.ndarray:
        """What a count loses: r (1 - d(r)); 0 for 0."""
        small = np.minimum(counts, K).astype(np.int64)
        return np.where(counts > K, self.beyond, small * (1 - self.table[small]))


class Unigrams:
    """Probabilities of words by their training count; unknown words are one type."""

    def __init__(self, n_tokens: int, n_types: int, n: list[int]):
        self.n_tokens, self.n_types = n_tokens, n_types
        self.discount = Discount(n)
        small = sum(n[r] * float(self.discount.lost(np.array([r]))[0]) for r in range(1, K + 1))
        lost = small + self.discount.beyond * (n_types - sum(n[1 : K + 1]))
        self.unknown = lost / n_tokens if n_tokens else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        if not self.n_tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, (counts - self.discount.lost(counts)) / self.n_tokens, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n_tokens + self.n_types + 1))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in range(K + 2)]


def _sum_by_chunk(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and the place of every given key among them."""
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    distinct, place = np.unique(flat, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts) if counts else None, minlength=len(distinct)).astype(np.int64)
    return distinct, total, place


_MERGED = "kind string, bucket int, chunk long, keys binary, values binary, size long, of_counts array<long>"


def _merged_row(kind, bucket, chunk, keys, values, size, of_counts):
    return {"kind": kind, "bucket": bucket, "chunk": chunk, "keys": keys, "values": values, "size": size, "of_counts": of_counts}


def _merged_table(rows: list[dict]) -> pa.Table:
    kinds = [("kind", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("size", pa.int64()), ("of_counts", pa.list_(pa.int64()))]
    return pa.table({name: pa.array([r[name] for r in rows], kind) for name, kind in kinds})


def _word_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """Training counts of words: a table (kind ``table``) and each chunk's reply."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n_words")[i].as_py()
                own = unpack_words(batch.column("words")[i].as_py(), n)
                codes = unsqueeze_codes(batch.column("codes")[i].as_py())
                train = np.repeat(lists(batch, i, "flags"), lists(batch, i, "sizes"))
                counts = np.bincount(codes[train], minlength=n)
                starts = bucket_starts(hashes(own), buckets)
                chunk = batch.column("chunk")[i].as_py()
                rows = [(b, chunk, pack_words(own[s:e]), squeeze(counts[s:e].astype("<i8")), int(e - s)) for b, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if e > s]
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "words", "counts", "n"), r, strict=True)) for r in rows], schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int32())]))

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        own = [unpack_words(r["words"], r["n"]) for r in rows]
        coded = pa.concat_arrays([pa.array(w, pa.large_string()) for w in own]).dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(place, weights=np.concatenate([unsqueeze(r["counts"], "<i8") for r in rows]), minlength=len(coded.dictionary)).astype(np.int64)
        seen = np.flatnonzero(total)
        kept = coded.dictionary.take(pa.array(seen)).to_pylist()
        out = [_merged_row("table", rows[0]["bucket"], None, pack_words(kept), squeeze(total[seen].astype("<i8")), len(seen), _counts_of_counts(total))]
        at = 0
        for r in rows:
            out.append(_merged_row("reply", r["bucket"], r["chunk"], None, squeeze(total[place[at : at + r["n"]]].astype("<i8")), r["n"], None))
            at += r["n"]
        return _merged_table(out)

    asked = chunks.select("chunk", "flags", "sizes", "codes", "words", "n_words").mapInArrow(ask, "bucket int, chunk long, words binary, counts binary, n int")
    return staged(asked.groupBy("bucket").applyInArrow(merge, _MERGED), "katz-words", ["kind"], "none")


class _Grams:
    """The distinct n-grams of one order in a chunk: places in the sequence, parts, keys, order of keys."""

    def __init__(self, lower: _Grams | None, own: _Chunk, order: int):
        if lower is None:  # words, start and end
            self.place, self.keys = own.sequence, np.concatenate([own.words, np.array([START, END])])
            return
        width = own.n + 2
        self.at = np.flatnonzero(own.depth >= order - 1)
        grams = lower.place[self.at - 1].astype(np.int64) * width + own.sequence[self.at]
        by_gram = np.argsort(grams).astype(np.int32)
        ordered = grams[by_gram]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        distinct = ordered[first]
        self.n = len(distinct)
        self.history, self.word = (distinct // width).astype(np.int32), (distinct % width).astype(np.int32)
        self.suffix = lower.place[self.at[by_gram[first]]]
        self.place = np.full(len(own.sequence), -1, dtype=np.int32)
        self.place[self.at[by_gram]] = np.cumsum(first, dtype=np.int32) - 1
        self.keys = _mix(_mix(lower.keys[self.history] * _PAIR) ^ np.concatenate([own.words, np.array([START, END])])[self.word])
        self.by_key = np.argsort(self.keys).astype(np.int32)


class _Chunk:
    """What every pass over a chunk works out again: words and n-grams up to an order.

    The sequence holds a start mark (n), the words and an end mark (n + 1) of each document;
    depth is the place in the document. An n-gram lies within a document and never ends at
    its start mark, so the first words have shorter histories.
    """

    def __init__(self, row: dict, sizes: np.ndarray, flags: np.ndarray, order: int):
        self.n = row["n_words"]
        self.words = hashes(unpack_words(row["words"], self.n))
        self.sizes, self.flags = sizes, flags
        lengths = sizes.astype(np.int64) + 2
        starts = np.cumsum(lengths) - lengths
        self.sequence = np.empty(int(lengths.sum()), dtype=np.int32)
        body = np.ones(len(self.sequence), dtype=bool)
        body[starts] = body[starts + lengths - 1] = False
        self.sequence[body] = unsqueeze_codes(row["codes"])
        self.sequence[starts], self.sequence[starts + lengths - 1] = self.n, self.n + 1
        self.depth = (np.arange(len(self.sequence)) - np.repeat(starts, lengths)).astype(np.int32)
        self.grams = [None, _Grams(None, self, 1)]
        for k in range(2, order + 1):
            self.grams.append(_Grams(self.grams[-1], self, k))

    def training_counts(self) -> np.ndarray:
        """Of the distinct n-grams of the highest order, in the order of keys."""
        top = self.grams[-1]
        train = np.repeat(self.flags, self.sizes + 2)[top.at]
        return np.bincount(top.place[top.at[train]], minlength=top.n)[top.by_key]


def _gram_counts(chunks: DataFrame, buckets: int, order: int) -> DataFrame:
    """Training counts of n-grams: a table and replies of 2 * count + (chunk is the owner).

    The owner of an n-gram is the first chunk that has it in training; it alone adds the
    n-gram to sums over distinct n-grams.
    """

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("chunk", "codes", "words", "n_words")}
                own = _Chunk(row, lists(batch, i, "sizes"), lists(batch, i, "flags"), order)
                keys, counts = own.grams[-1].keys[own.grams[-1].by_key], own.training_counts()
                starts = bucket_starts(keys, buckets)
                rows = [{"bucket": b, "chunk": row["chunk"], "keys": squeeze_sorted(keys[s:e]), "counts": squeeze(counts[s:e].astype("<i4"))} for b, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if e > s]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [unsqueeze_sorted(r["keys"]) for r in rows]
        counts = [unsqueeze(r["counts"], "<i4") for r in rows]
        distinct, total, place = _sum_by_chunk(keys, counts)
        trained = np.flatnonzero(np.concatenate(counts) > 0)
        owner = np.zeros(len(place), dtype=np.int64)
        owner[trained[np.unique(place[trained], return_index=True)[1]]] = 1
        seen = total > 0
        out = [_merged_row("table", rows[0]["bucket"], None, squeeze_sorted(distinct[seen]), squeeze(total[seen].astype("<i8")), int(seen.sum()), _counts_of_counts(total))]
        at = 0
        for r, k in zip(rows, keys, strict=True):
            out.append(_merged_row("reply", r["bucket"], r["chunk"], None, squeeze((2 * total[place[at : at + len(k)]] + owner[at : at + len(k)]).astype("<i8")), len(k), None))
            at += len(k)
        return _merged_table(out)

    asked = chunks.select("chunk", "flags", "sizes", "codes", "words", "n_words").mapInArrow(ask, "bucket int, chunk long, keys binary, counts binary")
    return staged(asked.groupBy("bucket").applyInArrow(merge, _MERGED), f"katz-grams{order}", ["kind"], "none")


def _summary(merged: DataFrame) -> tuple[int, list[int]]:
    """Types of a merged table and its counts of counts up to K + 1."""
    r = merged.filter("kind = 'table'").agg(F.sum("size").alias("size"), *(F.sum(F.element_at("of_counts", k + 1)).alias(f"n{k}") for k in range(K + 2))).first()
    return int(r["size"] or 0), [int(r[f"n{k}"] or 0) for k in range(K + 2)]


def _in_order(rows: list[dict], what: str) -> np.ndarray:
    own = sorted((r for r in rows if r["what"] == what), key=lambda r: r["bucket"])
    return np.concatenate([unsqueeze(r["values"], "<i8") for r in own]) if own else np.zeros(0, np.int64)


def _chunk_scores(chunks: DataFrame, replies: DataFrame, unigrams: Unigrams, discounts: dict[int, Discount], n_train: int, order: int, buckets: int, with_docs: bool) -> DataFrame:
    """Evaluate every token as far as a chunk can: base, known part of the score, requests.

    Rows of kind ``docs`` (if asked for) hold the documents' sums; rows of kind ``sums`` hold,
    by bucket of histories of n-grams of this order, the chunk's share of each history's left mass
    and of the next lower order's mass of its followers, and which documents need the
    history's backoff weight. What is seen at an order is seen at all
    lower ones, so followers' lower probabilities need no weights.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        batch = left.combine_chunks().to_batches()[0]
        row = {c: batch.column(c)[0].as_py() for c in ("chunk", "codes", "words", "n_words")}
        sizes, flags = lists(batch, 0, "sizes"), lists(batch, 0, "flags")
        own = _Chunk(row, sizes, flags, order)
        rest = right.to_pylist()
        counts = [None, np.concatenate([_in_order(rest, "1"), [n_train, n_train]])]  # start, end
        p, owned = [None, unigrams.p(counts[1])], None
        for k in range(2, order + 1):
            g = own.grams[k]
            answer = np.empty(g.n, dtype=np.int64)
            answer[g.by_key] = _in_order(rest, str(k))
            counts.append(answer >> 1)
            if k == order:
                owned = np.flatnonzero(answer & 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                p.append(np.where(counts[k] > 0, (counts[k] - discounts[k].lost(counts[k])) / counts[k - 1][g.history], 0.0))
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
        if with_docs:
            token = own.depth > 0
            token_counts = counts[1][own.sequence[token]]
            known = np.log10(p[1])[own.sequence]
            for k in range(2, order + 1):
                g = own.grams[k]
                at = g.at[counts[k][g.place[g.at]] > 0]
                known[at] = np.log10(p[k][g.place[at]])
            totals = {"n_known": token_counts > 0, "base": unigrams.base(token_counts), "score": known[token]}
            totals = {c: np.bincount(doc[token], weights=v, minlength=len(sizes)) for c, v in totals.items()}
            out.append({"kind": "docs", "bucket": -1 - row["chunk"], "chunk": row["chunk"], "ids": batch.column("doc_ids")[0].as_py(), "trains": flags.tolist(), "n_tokens": (sizes + 1).tolist(), "n_known": totals["n_known"].astype(np.int64).tolist(), "base": totals["base"].tolist(), "score": totals["score"].tolist()})
        # histories, in the order of their hashes; the start has a hash as well
        g, h_hash = own.grams[order], own.grams[order - 1].keys
        c_h, history = counts[order - 1], g.history[owned]
        lost = discounts[order].lost(counts[order][owned]) / c_h[history]
        mass = np.bincount(history, weights=lost, minlength=len(h_hash))
        seen = np.bincount(history, weights=p[order - 1][g.suffix[owned]], minlength=len(h_hash))
        given = np.flatnonzero(np.bincount(history, minlength=len(h_hash)))
        given = given[np.argsort(h_hash[given])]
        backs_off = (counts[order] == 0) & (c_h[g.history] > 0)
        asks = g.at[backs_off[g.place[g.at]]]
        need = (h_hash[g.history[g.place[asks]]], doc[asks])
        by_need = np.lexsort((need[1], need[0]))
        n_hash, n_doc = need[0][by_need], need[1][by_need]
        new = np.concatenate([[True], (n_hash[1:] != n_hash[:-1]) | (n_doc[1:] != n_doc[:-1])]) if len(by_need) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.concatenate([at, [len(by_need)]]))
        n_hash, n_doc = n_hash[at], n_doc[at]
        gs, ns = bucket_starts(h_hash[given], buckets), bucket_starts(n_hash, buckets)
        for b in range(buckets):
            h, q = given[gs[b] : gs[b + 1]], slice(ns[b], ns[b + 1])
            if len(h) or ns[b + 1] > ns[b]:
                out.append({"kind": "sums", "bucket": b, "chunk": row["chunk"], "keys": squeeze_sorted(h_hash[h]), "mass": squeeze_values(mass[h]), "seen": squeeze_values(seen[h]), "q_keys": squeeze_sorted(n_hash[q]), "q_docs": squeeze(n_doc[q].astype("<i4")), "q_times": squeeze(times[q].astype("<i4"))})
        return pa.Table.from_pylist(out, schema=_SCORED)

    a = chunks.groupBy("chunk")
    b = replies.filter(F.col("what") <= str(order)).groupBy("of_chunk")
    return a.cogroup(b).applyInArrow(run, _SCORED_DDL)


_DOCS = [("ids", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64()))]
_DOCS_DDL = "ids array<long>, trains array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"
_SCORED_DDL = f"kind string, bucket long, chunk long, {_DOCS_DDL}, keys binary, mass binary, seen binary, q_keys binary, q_docs binary, q_times binary"
_SCORED = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), *_DOCS, *((c, pa.binary()) for c in ("keys", "mass", "seen", "q_keys", "q_docs", "q_times"))])


def _backoffs(scored: DataFrame, order: int, with_table: bool) -> DataFrame:
    """Backoff weights of each bucket's histories and what they add to documents' scores.

    A weight is the left mass of a history over the next lower order's mass of words not
    seen after it, both summed over all chunks, so that probabilities after the history sum
    to one. Rows of kind ``docs`` pass through.
    """
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("adds", pa.binary()), *_DOCS])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        if rows[0]["kind"] == "docs":
            return pa.Table.from_pylist(rows, schema=schema)
        keys = np.concatenate([unsqueeze_sorted(r["keys"]) for r in rows])
        distinct, place = np.unique(keys, return_inverse=True)
        mass = np.bincount(place, weights=np.concatenate([unsqueeze_values(r["mass"], "<f8") for r in rows]), minlength=len(distinct))
        seen = np.bincount(place, weights=np.concatenate([unsqueeze_values(r["seen"], "<f8") for r in rows]), minlength=len(distinct))
        weight = np.log10(mass) - np.log10(1 - seen)
        out = [{"kind": "table", "bucket": rows[0]["bucket"], "chunk": None, "keys": squeeze_sorted(distinct), "docs": None, "adds": squeeze(weight)}] if with_table else []
        for r in rows:
            asked = unsqueeze_sorted(r["q_keys"])
            if len(asked):
                docs, times = unsqueeze(r["q_docs"], "<i4"), unsqueeze(r["q_times"], "<i4")
                sums_ = np.bincount(docs, weights=times * weight[np.searchsorted(distinct, asked)])
                found = np.unique(docs)
                out.append({"kind": "reply", "bucket": r["bucket"], "chunk": r["chunk"], "keys": None, "docs": squeeze(found.astype("<i4")), "adds": squeeze(sums_[found])})
        return pa.Table.from_pylist(out, schema=schema)

    ddl = f"kind string, bucket long, chunk long, keys binary, docs binary, adds binary, {_DOCS_DDL}"
    return staged(scored.groupBy("bucket").applyInArrow(run, ddl), f"katz-backoffs{order}", ["kind"], "none")


def score(docs: DataFrame, row_id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Katz n-gram scores of all texts, learnt from those whose crc32(id) mod 7 is not 2.

    A text's tokens are its words and one end; the first has a start mark as history, and
    histories never reach beyond it. Counts are Good-Turing discounted at every order.
    p(w | h) is the discounted count ratio if the n-gram was seen, else weight(h) * p(w | h')
    with h' one word shorter, else (history not seen) p(w | h'); p(w) is the discounted
    unigram, and words not in training share its left mass as one type. Weights are exactly
    normalised. The count tables of words and bigrams and the weights of words as histories
    are written as Parquet partitioned by kind, in buckets of key hashes; those of longer
    n-grams, which nothing reads after, do not stay. Chunks of documents, which lie in
    buckets and so are not exchanged, ask for counts and evaluate the recursion token by token.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Null or empty text is one end token; a null id counts as training; repeated rows
    are learnt and scored each; with no training rows every probability is 1.
    """
    if not 2 <= order <= 9:
        raise ValueError("order: 2 to 9")
    spark = docs.sparkSession
    chunks = chunk_table(docs, words, training_flag(row_id), row_id, text, in_buckets=True)
    totals = chunks.select(
        F.expr("size(filter(flags, x -> x))").cast("long").alias("train_docs"),
        F.expr("aggregate(zip_with(flags, sizes, (f, s) -> if(f, cast(s as bigint), 0L)), 0L, (a, x) -> a + x)").alias("train_words"),
        F.col("n_words").cast("long").alias("words"),
        F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("tokens"),
    )
    t = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train_docs", "train_words", "words", "tokens"))).first()
    n_train, n_tokens = t["train_docs"], t["train_docs"] + t["train_words"]
    word_buckets = max(1, math.ceil(t["words"] / KEYS_A_BUCKET * 2))
    pair_buckets = max(1, math.ceil(t["tokens"] / KEYS_A_BUCKET))
    word_table = _word_counts(chunks, word_buckets)
    n_types, of_words = _summary(word_table)
    if n_train:  # the end is a type of its own
        n_types += 1
        if n_train <= K + 1:
            of_words[n_train] += 1
    release(spark)
    unigrams, discounts, tables = Unigrams(n_tokens, n_types, of_words), {}, {1: word_table}
    for k in range(2, order + 1):
        tables[k] = _gram_counts(chunks, pair_buckets, k)
        discounts[k] = Discount(_summary(tables[k])[1])
        if k > 2:
            remove(tables[k], "kind=table")
        release(spark)
    answers = [m.filter("kind = 'reply'").select(F.col("chunk").alias("of_chunk"), F.lit(str(k)).alias("what"), "bucket", "values") for k, m in tables.items()]
    replies = functools.reduce(DataFrame.union, answers)
    weights = []
    for k in range(2, order + 1):
        scored = _chunk_scores(chunks, replies, unigrams, discounts, n_train, k, word_buckets if k == 2 else pair_buckets, with_docs=k == order)
        weights.append(_backoffs(scored, k, with_table=k == 2))
        del scored
        release(spark)
    remove(chunks)
    for table in tables.values():
        remove(table, "kind=reply")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        d = left.to_pylist()[0]
        total = np.array(d["score"], dtype=float)
        for r in sorted(right.to_pylist(), key=lambda r: (r["round"], r["bucket"])):
            total[unsqueeze(r["docs"], "<i4")] += unsqueeze(r["adds"], "<f8")
        n = len(d["ids"])
        columns = [pa.array(d["ids"], pa.int64()), pa.array([not x for x in d["trains"]]), pa.array(d["n_tokens"], pa.int64()), pa.array(d["n_known"], pa.int64()), pa.array([n_tokens] * n, pa.int64()), pa.array(d["base"], pa.float64()), pa.array(total)]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    documents = weights[-1].filter("kind = 'docs'").select("chunk", "ids", "trains", "n_tokens", "n_known", "base", "score")
    adds = functools.reduce(DataFrame.union, [w.filter("kind = 'reply'").select(F.col("chunk").alias("of_chunk"), F.lit(i).alias("round"), "bucket", "docs", "adds") for i, w in enumerate(weights)])
    return documents.groupBy("chunk").cogroup(adds.groupBy("of_chunk")).applyInArrow(finish, schema)
