"""Byte-level BPE by a monoid tree: halves are encoded apart and joined at their border.

Two joins make it exact.

*Matches.* A pattern without look-behind decides a match by the text from its start on. The
matches of a left half stand except those that end within PEEK characters of its end, as far
as the pattern looks. Matching goes on from there across the border; where it ends a match
at a place where the right half had a border too, all later matches of the right half stand.

*Tokens of one long match.* Merging by rank never crosses a border that is left in the end, so
a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the
encoding of theirs. Halves are joined by encoding a window over their border anew; once both
borders of the window hold by that rule, no token outside can change. Else the window grows.

Decoding is a homomorphism already: the bytes of halves are concatenated up the tree.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import staged
from larder.llm.pack import read_bytes
from larder.llm.tokens import slices

#: Characters of a leaf within a task, and of the parts of a text that are rows of their own.
LEAF, SEGMENT = 4096, 65_536
#: How far a pattern may look to decide a match, beyond where it ends (``'ll`` and ``(?!\\S)``).
PEEK = 3
#: Distinct matches whose tokens a task remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 64
#: Classes a pattern may use, each with a character that all Unicode versions put into it.
CLASSES = {r"\s": " ", r"\p{L}": "x", r"\p{N}": "1"}

_CODERS: dict[int, Coder] = {}


class Node:
    """A text with its matches: characters and tokens of each, and all tokens in order."""

    __slots__ = ("text", "sizes", "counts", "ids")

    def __init__(self, text: str, sizes: array, counts: array, ids: array):
        self.text, self.sizes, self.counts, self.ids = text, sizes, counts, ids


class Decoder:
    """The bytes of the tokens of a ranks file."""

    def __init__(self, spec: bytes):
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, spec.splitlines())}

    def decode(self, ids: np.ndarray) -> bytes:
        """By halves, as bytes of neighbours are concatenated."""
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Coder(Decoder):
    """Ranks and pattern of a byte-level BPE; tiktoken merges leaves and windows."""

    def __init__(self, spec: bytes, pattern: str):
        import regex
        import tiktoken

        super().__init__(spec)
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        self.longest = max(map(len, self.ranks))
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.cut = regex.compile(pattern)
        self.odd, self.stand_in = self._differing(regex, tiktoken)
        self.seen: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _differing(regex, tiktoken):
        """Characters whose classes differ between the Unicode versions of the two libraries."""
        every, single = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))), {bytes([b]): b for b in range(256)}
        theirs, ours = {}, {}
        for c in CLASSES:
            coder = tiktoken.Encoding("class", pat_str=c, mergeable_ranks=single, special_tokens={})
            theirs[c], ours[c] = set(bytes(coder.encode_ordinary(every)).decode()), set(regex.findall(c, every))
        table = {ord(x): next((stand for c, stand in CLASSES.items() if x in theirs[c]), "!") for c in CLASSES for x in theirs[c] ^ ours[c]}
        return frozenset(map(chr, table)), table

    def matches(self, text: str) -> list[str]:
        """The pattern's matches, by the classes that tiktoken knows."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.cut.findall(text)
        return [text[m.start() : m.end()] for m in self.cut.finditer(text.translate(self.stand_in))]

    def codes(self, match: str) -> tuple[int, ...]:
        found = self.seen.get(match)
        if found is None:
            found = tuple(self.whole(match.encode()))
            if len(match) <= REMEMBERED_CHARS:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[match] = found
        return found

    def whole(self, body: bytes) -> list[int]:
        """Tokens of one match: by halves where it is long."""
        if len(body) <= max(LEAF, 2 * self.longest):
            return self.merge(body)
        half = len(body) // 2
        return self.joined(self.whole(body[:half]), self.whole(body[half:]))

    def _stay(self, a: int, b: int) -> bool:
        both = self.tokens[a] + self.tokens[b]
        return both not in self.ranks and self.merge(both) == [a, b]

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of two halves of one match, each of more bytes than any token."""
        k = 8
        while True:
            body = b"".join(self.tokens[t] for t in chain(a[-k:], b[:k]))
            whole = k >= len(a) and k >= len(b)
            if whole or len(body) > self.longest:  # a shorter window might be a token of its own
                window = self.merge(body)
                if whole or (k >= len(a) or self._stay(a[-k - 1], window[0])) and (k >= len(b) or self._stay(window[-1], b[k])):
                    return a[:-k] + window + b[k:]
            k *= 2

    def leaf(self, text: str) -> Node:
        found = self.matches(text)
        codes = [self.codes(m) for m in found]
        return Node(text, array("I", map(len, found)), array("I", map(len, codes)), array("I", chain.from_iterable(codes)))

    def encode(self, text: str) -> Node:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def join(self, left: Node, right: Node) -> Node:
        """The node of both texts; left is used up."""
        if not left.sizes or not right.sizes:
            return left if left.sizes else right
        at, first, n_ids, old = len(left.text), len(left.sizes), len(left.ids), []
        while first and at > len(left.text) - PEEK:  # undo matches that might go on
            first -= 1
            at -= left.sizes[first]
            n_ids -= left.counts[first]
            old.append((left.sizes[first], left.ids[n_ids : n_ids + left.counts[first]]))
        rest = left.text[at:]
        new, place, taken = self._across(rest, right)
        codes = [self._known(m, old[::-1], rest, right) for m in new]
        left_out = sum(right.counts[:taken])
        del left.sizes[first:], left.counts[first:], left.ids[n_ids:]
        left.sizes.extend(map(len, new))
        left.counts.extend(map(len, codes))
        left.ids.extend(chain.from_iterable(codes))
        left.sizes.extend(right.sizes[taken:])
        left.counts.extend(right.counts[taken:])
        left.ids.extend(right.ids[left_out:])
        left.text += right.text
        return left

    def _across(self, rest: str, right: Node) -> tuple[list[str], int, int]:
        """Matches from rest on until one ends at a border of right, there, and how many of right's it covers."""
        reach = 256
        while True:
            window = rest + right.text[:reach]
            sure = len(window) if reach >= len(right.text) else len(window) - PEEK
            new, end, taken, border = [], 0, 0, len(rest)
            for m in self.matches(window):
                end += len(m)
                if end > sure:
                    break
                new.append(m)
                while border < end and taken < len(right.sizes):
                    border += right.sizes[taken]
                    taken += 1
                if border == end:
                    return new, end, taken
            reach *= 4

    def _known(self, match: str, old: list, rest: str, right: Node) -> tuple[int, ...] | list[int]:
        """Tokens of a match across the border; a long one joins those of its halves."""
        if len(match) > LEAF and match.startswith(rest) and len(match) == len(rest) + right.sizes[0] and len(old) == 1 and min(len(rest), right.sizes[0]) > self.longest:
            return self.joined(old[0][1].tolist(), right.ids[: right.counts[0]].tolist())
        return self.codes(match)


def coder(spec: bytes, pattern: str) -> Coder:
    key = zlib.crc32(spec + pattern.encode())
    if key not in _CODERS:
        _CODERS[key] = Coder(spec, pattern)
    return _CODERS[key]


def _blob(values: array) -> bytes:
    return np.frombuffer(values, dtype=np.uintc).astype("<u4").tobytes() if values else b""


def _array(blob: bytes) -> array:
    return array("I", np.frombuffer(blob, dtype="<u4").astype(np.uintc).tobytes())


def encode(docs: DataFrame, ranks_path: str, pattern: str, row_id: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Tokens of every row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Rows of up to ``segment`` characters are encoded where they lie. Longer ones become rows
    of that many characters each, encoded apart and written; their nodes are then joined by
    neighbours of equal height, in order, so that a task holds one text and its tokens.
    ``pattern`` must cover every text, look no further than PEEK, not look behind, and use
    no other classes than CLASSES. A null text is empty and has no tokens; repeated rows and
    null ids stay rows of their own; an empty table gives none.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_bytes(ranks_path))
    base = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids binary"
    out = lambda ids, nodes: pa.RecordBatch.from_arrays([ids, pa.array([len(n.ids) for n in nodes], pa.int64()), pa.array([_blob(n.ids) for n in nodes], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    def short(batches):
        own = coder(shipped.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                yield out(part.column(0), [own.encode(x) for x in part.column(1).to_pylist()])

    def cut(batches):
        for batch in batches:
            for row, doc, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                body = body.as_py()
                for k, start in enumerate(range(0, len(body), segment)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([doc.as_py()], pa.int64()), pa.array([k], pa.int64()), pa.array([body[start : start + segment]], pa.string())], names=["row", "doc_id", "k", "text"])

    def node(batches):
        own = coder(shipped.value, pattern)
        for batch in batches:
            for part in slices(batch, 3):
                nodes = [own.encode(x) for x in part.column(3).to_pylist()]
                blobs = [pa.array([_blob(getattr(n, c)) for n in nodes], pa.binary()) for c in ("sizes", "counts", "ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, *blobs], names=[*part.schema.names, "sizes", "counts", "ids"])

    def fold(batches):
        own = coder(shipped.value, pattern)
        row = doc = None
        stack: list[tuple[int, Node]] = []

        def joined(all_of: bool):
            while len(stack) > 1 and (all_of or stack[-1][0] == stack[-2][0]):
                (_, right), (height, left) = stack.pop(), stack.pop()
                stack.append((height + 1, own.join(left, right)))

        def ended():
            joined(True)
            return out(pa.array([doc], pa.int64()), [stack.pop()[1]])

        for batch in batches:
            for i in range(batch.num_rows):
                at, doc_at, _, body, *blobs = (c[i].as_py() for c in batch.columns)
                if stack and at != row:
                    yield ended()
                row, doc = at, doc_at
                stack.append((0, Node(body, *map(_array, blobs))))
                joined(False)
        if stack:
            yield ended()

    fits = F.length("text") <= segment
    long_rows = base.filter(~fits).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, "row long, doc_id long, k long, text string")
    nodes = long_rows.repartition("row", "k").mapInArrow(node, "row long, doc_id long, k long, text string, sizes binary, counts binary, ids binary")
    nodes = staged(nodes, "bpe-nodes", compression="zstd")
    return base.filter(fits).mapInArrow(short, schema).union(nodes.repartition("row").sortWithinPartitions("row", "k").mapInArrow(fold, schema))


def decode(tokens: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes that ids stand for: the kept columns and ``bytes``; null ids are none."""
    spark = tokens.sparkSession
    shipped = spark.sparkContext.broadcast(read_bytes(ranks_path))
    given = tokens.select(*keep, F.coalesce("ids", F.lit(b"")).alias("ids"))
    schema = given.drop("ids").withColumn("bytes", F.lit(b"")).schema

    def run(batches):
        own = Decoder(shipped.value)
        for batch in batches:
            for part in slices(batch, len(keep)):
                found = [own.decode(np.frombuffer(x, dtype="<u4")) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.binary())], names=[*keep, "bytes"])

    return given.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of every row's tokens and of what they decode to, as encode and decode give them."""
    tokens = encode(docs, ranks_path, pattern).withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(tokens, ranks_path, ("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
