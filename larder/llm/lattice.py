"""SentencePiece encoding and decoding over a relational lattice of distinct words.

The words of the lattice are texts cut wherever two neighbouring characters stand together
in no piece. No edge can cross such a place, so the best paths of the parts make up the
best path of the whole, and far fewer distinct words remain than between spaces.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.chunks import chunk_table, dealt, lists, pack_words, squeeze, unpack_words, unsqueeze, unsqueeze_codes
from larder.llm.common import release, staged
from larder.llm.pack import read_bytes

SPACE, LINE = "▁", ""
#: Longer words are folded by the same recursion outside the lattice table.
MAX_WORD = 48
#: What a character without a piece costs beyond the lowest score.
UNKNOWN = 10.0
#: Rank at which the probabilities of a merge model's pieces begin to fall.
SHIFT = 300.0
GRID = 2**30
#: Characters of a text that are cut at once.
WINDOW = 250_000
WORDS_A_BUCKET = 400_000
#: A piece table is broadcast; more pieces than this are refused.
MAX_PIECES = 1_000_000
_WORD = re.compile(f"{LINE}|{SPACE}+[^{SPACE}{LINE}]*|[^{SPACE}{LINE}]+")
#: Characters with a class of their own in the table of pairs; others never part words.
MAX_CLASSES = 8192


def _log_p(scores: list[float]) -> list[float]:
    """Log-probabilities of pieces from a model's scores.

    A unigram model's scores are that. A merge model's are negative ranks (whole
    numbers); a piece of rank r then has probability in proportion to 1 / (r + SHIFT),
    and pieces without a rank (scores under -1e8) that of the last.
    """
    ranks = [-s for s in scores if s > -1e8]
    if any(r != int(r) or r < 0 for r in ranks):
        return scores
    last = max(ranks, default=0.0)
    return [-math.log(SHIFT + (-s if s > -1e8 else last)) for s in scores]


class Pieces:
    """The piece table of a SentencePiece model file's bytes: pieces, scores and byte pieces."""

    def __init__(self, spec: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=spec)
        n = sp.get_piece_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces; at most {MAX_PIECES} are broadcast")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [p.encode("utf-8") for p in self.text]
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.unknown_id = sp.unk_id()
        #: Scores are multiples of 1 / GRID, so sums are exact: ties are ties in any order of adding.
        self.ids = {self.text[i]: (i, round(s * GRID) / GRID) for i, s in zip(own, _log_p([float(sp.get_score(i)) for i in own]), strict=True)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that cross words are not supported")
        self.longest = max(map(len, self.ids))
        self.penalty = min(s for _, s in self.ids.values()) - UNKNOWN
        self.of_char, self.together = self._pairs()

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of every character, and which classes stand together in a piece.

        Class 0 has the characters that are in no pair, the last one all beyond
        MAX_CLASSES. Marks of spaces stay together.
        """
        pairs = {(SPACE, SPACE)} | {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)}
        often = [c for c, _ in Counter(c for pair in pairs for c in pair).most_common()]
        of = {c: min(k + 1, MAX_CLASSES) for k, c in enumerate(often)}
        of_char = np.zeros(0x110000, dtype=np.uint16)
        of_char[[ord(c) for c in of]] = list(of.values())
        together = np.zeros((max(of.values()) + 1,) * 2, dtype=bool)
        together[[of[a] for a, _ in pairs], [of[b] for _, b in pairs]] = True
        together[MAX_CLASSES:, 1:] = together[1:, MAX_CLASSES:] = True
        return of_char, together

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, s) for p, (i, s) in self.ids.items()], "piece string, id int, score double")

    def fold(self, word: str) -> list[int]:
        """The lattice's recursion in plain steps; a character without a piece is -1 - code."""
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + self.penalty, -(end - 1), -1 - ord(word[end - 1]))]
            for start in range(max(0, end - self.longest), end):
                if found := self.ids.get(word[start:end]):
                    options.append((best[start][0] + found[1], -start, found[0]))
            best.append(max(options))
        out, at = [], len(word)
        while at:
            out.append(best[at][2])
            at = -best[at][1]
        return out[::-1]

    def spelled(self, ids: list[int]) -> list[int]:
        """Characters without a piece as their bytes' pieces, or the unknown piece."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            else:
                raw = ("\n" if chr(-1 - i) == LINE else chr(-1 - i)).encode("utf-8")
                out += [self.bytes[b] for b in raw] if self.bytes else [self.unknown_id]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of pieces; runs of byte pieces are read as UTF-8."""
        raw = b"".join(self.raw[i] for i in ids)
        text = raw.decode("utf-8", errors="replace").replace(SPACE, " ")
        return text.removeprefix(" ")


@cache
def pieces_of(spec: bytes) -> Pieces:
    return Pieces(spec)


def pieces(path: str) -> Pieces:
    return pieces_of(read_bytes(path))


def split(text: str) -> list[str]:
    """Words between spaces, uncut: what n_words counts, and what split_column must agree with."""
    return _WORD.findall(SPACE + text.replace(" ", SPACE).replace("\n", LINE)) if text else []


def split_column(model: Pieces, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lattice words of texts, and how many each has.

    Spaces are marks before words, and one is added in front. Null or empty text has none.
    """
    marked = [SPACE + x.replace(" ", SPACE).replace("\n", LINE) if x else "" for x in texts.to_pylist()]
    ends = np.cumsum([len(x) for x in marked]).astype(np.int64)
    heads = np.concatenate([[0], ends])[:-1][np.diff(ends, prepend=0) > 0]
    joined = "".join(marked)
    del marked
    before, n_bytes, starts, offsets = np.zeros(1, np.uint16), 0, [], []
    for at in range(0, len(joined), WINDOW):
        points = np.frombuffer(joined[at : at + WINDOW].encode("utf-32-le"), dtype="<u4")
        kinds = np.concatenate([before, model.of_char[points]])
        first = ~model.together[kinds[:-1], kinds[1:]]
        first[heads[(heads >= at) & (heads < at + WINDOW)] - at] = True
        widths = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        own = np.flatnonzero(first)
        starts.append(own + at)
        offsets.append((np.cumsum(widths) - widths)[own] + n_bytes)
        before, n_bytes = kinds[-1:], n_bytes + int(widths.sum())
    starts = np.concatenate([np.zeros(0, np.int64), *starts])
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate([*offsets, [n_bytes]]).astype(np.int64)), pa.py_buffer(joined.encode("utf-8"))])
    return flat, np.diff(np.searchsorted(starts, ends), prepend=0)


def lattice(words: DataFrame, table: DataFrame, penalty: float, longest: int, partitions: int) -> DataFrame:
    """Best pieces of every word (bucket, place, word): bucket, place, ids.

    Substrings up to the longest piece are exploded and joined with the broadcast piece
    table; matches are the edges of a word's lattice. Words are dealt by their key first,
    so grouping edges needs no further shuffle. A fold over end positions keeps the best
    score to each and the edge it came by; ties go to the longer last piece. A second
    fold follows the edges back.
    """
    dealt = words.repartition(partitions, "bucket", "place").withColumn("n", F.length("word"))
    starts = dealt.withColumn("start", F.explode(F.expr("sequence(0, n - 1)")))
    spans = starts.withColumn("length", F.explode(F.expr(f"sequence(1, least({longest}, n - start))")))
    edges = spans.withColumn("piece", F.expr("substring(word, start + 1, length)")).join(F.broadcast(table), "piece", "left").filter("id is not null or length = 1")
    edge = F.struct((F.col("start") + F.col("length")).alias("e"), F.col("start").alias("b"), "id", "score")
    grouped = edges.groupBy("bucket", "place").agg(F.first("word").alias("word"), F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    best = f"""
        aggregate(sequence(1, n), array(named_struct('s', 0D, 'b', 0, 'id', 0)), (acc, e) -> array_append(acc,
            array_max(transform(filter(edges, x -> x.e = e), x ->
                named_struct('s', acc[x.b].s + coalesce(x.score, {penalty}D), 'b', -x.b, 'id', coalesce(x.id, -1 - ascii(substring(word, e, 1))))))))
    """
    back = """
        aggregate(sequence(1, n), named_struct('at', n, 'ids', cast(array() as array<int>)),
            (acc, i) -> if(acc.at = 0, acc, named_struct('at', -best[acc.at].b, 'ids', array_append(acc.ids, best[acc.at].id))),
            acc -> reverse(acc.ids))
    """
    return grouped.withColumn("best", F.expr(best)).select("bucket", "place", F.expr(back).alias("ids"))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all runs, one run after the other."""
    lengths = lengths.astype(np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def texts_of(model: Pieces) -> pa.Array:
    return pa.array(model.text, pa.large_string())


def _merged(rows: list[dict]) -> tuple[list[dict], list[str], np.ndarray]:
    """A bucket's requests in order, its distinct words, and each request word's place."""
    rows = sorted(rows, key=lambda r: r["chunk"])
    coded = pa.concat_arrays([pa.array(unpack_words(r["words"], r["n"]), pa.large_string()) for r in rows]).dictionary_encode()
    return rows, coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, model_path: str, row_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text: doc_id, n_words, n_pieces, n_bytes, ids_crc32, round_trip.

    Distinct words of all documents form one lattice table; chunks of documents get
    their words' pieces back. n_bytes counts byte pieces; ids_crc32 is over unsigned
    32-bit little-endian ids; round_trip tells whether decoding gives the text again.
    The best path is by summed log-probabilities of pieces (of a merge model, by their
    ranks: see _log_p), with characters that have no piece spelled in bytes. Null or empty text has
    no pieces; a null id stays; repeated rows repeat. with_ids adds the ids themselves.
    A text that holds one of the two marks itself decodes to a space or line feed there,
    so its round_trip is false.
    """
    model = pieces(model_path)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_bytes(model_path))
    unmarked = ~F.coalesce(F.col(text).cast("string").rlike(f"[{SPACE}{LINE}]"), F.lit(False))
    chunks = chunk_table(docs, lambda texts: split_column(pieces_of(shipped.value), texts), unmarked.alias("_flag"), row_id, text, by_chunk=True)
    total = chunks.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(total / WORDS_A_BUCKET))

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n_words")[i].as_py()
                own = unpack_words(batch.column("words")[i].as_py(), n)
                order, starts = dealt(own, buckets)
                own = [own[k] for k in order.tolist()]
                chunk = batch.column("chunk")[i].as_py()
                rows = [{"bucket": b, "chunk": chunk, "words": pack_words(own[s:e]), "n": int(e - s)} for b, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if e > s]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("n", pa.int32())]))

    asked = chunks.select("chunk", "words", "n_words").mapInArrow(ask, "bucket int, chunk long, words binary, n int")

    def distinct(table: pa.Table) -> pa.Table:
        rows, own, _ = _merged(table.to_pylist())
        keep = [i for i, w in enumerate(own) if len(w) <= MAX_WORD]
        return pa.table({"bucket": pa.array([rows[0]["bucket"]] * len(keep), pa.int32()), "place": pa.array(keep, pa.int32()), "word": pa.array([own[i] for i in keep], pa.string())})

    words = asked.groupBy("bucket").applyInArrow(distinct, "bucket int, place int, word string")
    best = staged(lattice(words, model.table(spark), model.penalty, model.longest, max(8, 4 * buckets)), "lattice")

    release(spark)

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, own, place = _merged(left.to_pylist())
        sizes = np.full(len(own), -1, dtype=np.int32)
        found = right["ids"].combine_chunks()
        at = right["place"].to_numpy()
        lengths = np.diff(found.offsets.to_numpy())
        sizes[at] = lengths
        flat, offset = found.values.to_numpy(), np.zeros(len(own), dtype=np.int64)
        offset[at] = found.offsets.to_numpy()[:-1]
        out, start = [], 0
        for r in rows:
            mine = place[start : start + r["n"]]
            start += r["n"]
            index = runs(offset[mine], np.maximum(sizes[mine], 0))
            out.append({"to": r["chunk"], "bucket": r["bucket"], "sizes": squeeze(sizes[mine].astype("<i4")), "ids": squeeze(flat[index].astype("<i4"))})
        return pa.Table.from_pylist(out, schema=pa.schema([("to", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())]))

    right = best.select(F.col("bucket").alias("_b"), "place", "ids")
    replies = asked.groupBy("bucket").cogroup(right.groupBy("_b")).applyInArrow(reply, "to long, bucket int, sizes binary, ids binary")
    schema = "doc_id long, n_words long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        m = pieces_of(shipped.value)
        batch = left.combine_chunks().to_batches()[0]
        n = batch.column("n_words")[0].as_py()
        own = unpack_words(batch.column("words")[0].as_py(), n)
        rest = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        none = np.zeros(0, np.int32)
        sizes = np.concatenate([none, *(unsqueeze(r["sizes"], "<i4") for r in rest)])
        flat = np.concatenate([none, *(unsqueeze(r["ids"], "<i4") for r in rest)])
        bytes_of = set(m.bytes.values())
        order, _ = dealt(own, buckets)
        lengths = np.maximum(sizes, 0).astype(np.int64)
        ends = np.cumsum(lengths)
        held, begin, odd, good = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        held[order], begin[order], odd[order] = lengths, ends - lengths, sizes < 0
        odd[np.repeat(order, lengths)[flat < 0]] = True
        plain = np.flatnonzero(~odd)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), texts_of(m).take(pa.array(np.maximum(flat, 0)))), pa.scalar("", pa.large_string()))
        good[order] = pc.equal(joined, pa.array(own, pa.large_string()).take(pa.array(order))).to_numpy(zero_copy_only=False)
        count, byte_count, spelled = held.copy(), np.zeros(n, np.int64), {}
        for i in np.flatnonzero(odd).tolist():
            ids = m.spelled(flat[begin[i] : begin[i] + held[i]].tolist() or m.fold(own[i]))
            spelled[i], count[i] = ids, len(ids)
            byte_count[i] = sum(x in bytes_of for x in ids)
            good[i] = m.decode(ids) == own[i].replace(LINE, "\n").replace(SPACE, " ").removeprefix(" ")
        first = np.cumsum(count) - count
        long_ids = np.zeros(int(count.sum()), dtype="<u4")
        long_ids[runs(first[plain], held[plain])] = flat[runs(begin[plain], held[plain])]
        for i, ids in spelled.items():
            long_ids[first[i] : first[i] + count[i]] = ids
        codes = unsqueeze_codes(batch.column("codes")[0].as_py())
        doc_ids = batch.column("doc_ids")[0].as_py()
        line, mark = (np.array([w.startswith(c) for w in own], dtype=bool) for c in (LINE, SPACE))
        at, rows, kept = 0, [], []
        for k, is_unmarked in zip(lists(batch, 0, "sizes").tolist(), lists(batch, 0, "flags").tolist(), strict=True):
            mine = codes[at : at + k]
            at += k
            many = count[mine]
            heads = line[mine] | mark[mine]
            heads[1:] |= line[mine[:-1]]
            ids = long_ids[runs(first[mine], many)]
            rows.append((int(heads.sum()), len(ids), int(byte_count[mine].sum()), zlib.crc32(ids.tobytes()), bool(is_unmarked and good[mine].all())))
            if with_ids:
                kept.append(ids)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        out = [pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_())]
        if with_ids:
            out.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, kept)], dtype=np.int32), np.concatenate([np.zeros(0, "<u4"), *kept]).astype(np.int32)))
        return pa.Table.from_arrays(out, names=[f.split()[0] for f in schema.split(", ")])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("to")).applyInArrow(finish, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of a column of ids as column out; the other columns stay.

    Null ids give null, no ids an empty text. Ids outside the model are an error.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def texts(column: pa.Array) -> pa.Array:
        m = pieces_of(shipped.value)
        return pa.array([None if x is None else m.decode(x) for x in column.to_pylist()], pa.string())

    texts = F.arrow_udf(texts, "string")
    return encoded.withColumn(out, texts(F.col(ids)))
