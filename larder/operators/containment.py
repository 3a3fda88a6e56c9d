"""Which texts hold which passages: exact keys of passages' starts, looked up at every byte of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from larder.sources import shared_table

#: Bytes that one integer of a key covers; two of them are the bytes themselves.
COVERED = 8
EXACT = 2 * COVERED
#: Bits of a filter of keys; there is one for each size, the same for any number of passages.
FILTER_BITS = 22
#: Bytes of texts that a task looks at together.
BLOCK = 1 << 17
#: Bytes of all the passages together that are so short that they stand in most texts.
MOST_SHORT = 4_000_000
KEY = ["size", "a", "b"]
_KEY_FIELDS = [StructField("size", IntegerType()), StructField("a", LongType()), StructField("b", LongType())]
#: Numbers of filters: of the first two bytes, of the first EXACT bytes of longer keys, and of a size the size above this.
_STARTS, _LEADS, _SIZES = 0, 1, 1
_ONE, _TWO, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def sizes_of(longest: int) -> list[int]:
    """Sizes of keys: every one up to EXACT, then half as much again each."""
    sizes = list(range(1, EXACT + 1))
    while (more := sizes[-1] * 3 // 2) <= longest:
        sizes.append(more)
    return sizes


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ONE + (b ^ b >> np.uint64(31)) * _TWO
    return (x ^ x >> np.uint64(32)) * _THREE


def _slots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's two places in a filter."""
    x = _mixed(a, b)
    return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (x & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _later(x: np.ndarray, by: int) -> np.ndarray:
    """What stands so much later; zeros beyond the end."""
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


class Keys:
    """Keys of the bytes that follow each place of a block.

    Up to EXACT bytes a key is those bytes, as one or two integers. Beyond, it is a hash of
    the keys of the next smaller size at both ends, made for all places when first asked for.
    """

    def __init__(self, block: bytes):
        x = np.frombuffer(block, np.uint8).astype(np.uint64)
        for by in (1, 2, 4):
            x = x | _later(x, by) << np.uint64(8 * by)
        self.eight = x
        self.hashes: dict[int, np.ndarray] = {}

    def _hashed(self, size: int) -> np.ndarray:
        if size not in self.hashes:
            whole, had = self.eight, COVERED
            for more in sizes_of(size)[EXACT - 1 :]:
                if more not in self.hashes:
                    self.hashes[more] = _mixed(whole, _later(whole, more - had))
                whole, had = self.hashes[more], more
        return self.hashes[size]

    def at(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Both integers of the keys at places where so many bytes follow."""
        if size > EXACT:
            return self._hashed(size)[places], np.zeros(len(places), np.uint64)
        if size > COVERED:
            return self.eight[places], self.eight[places + (size - COVERED)]
        return self.eight[places] & np.uint64((1 << 8 * size) - 1), np.zeros(len(places), np.uint64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages (item, sought) with the keys of their starts and what filters shall let through."""
    for batch in batches:
        rows = []
        for sought in batch.column("sought").to_pylist():
            size = max(s for s in sizes_of(len(sought)) if s <= len(sought))
            keys, here = Keys(sought[:size]), np.zeros(1, np.int64)
            key = keys.at(here, size)
            after = [sought[1]] if size > 1 else range(256)
            passed = [(_STARTS, sought[0] | x << 8) for x in after] + [(size + _SIZES, int(x[0])) for x in _slots(*key)]
            if size > EXACT:
                passed += [(_LEADS, int(x[0])) for x in _slots(*keys.at(here, EXACT))]
            rows.append((size, *(int(x.view(np.int64)[0]) for x in key), [n << FILTER_BITS | x for n, x in passed]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        made = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("sought"), *made], ["item", "sought", *KEY, "passed"])


class Filters:
    """Which first two bytes and which keys of each size some passage has, and perhaps a few more."""

    def __init__(self, filters: dict[int, np.ndarray]):
        self.filters = filters
        self.starts = np.unpackbits(filters[_STARTS], bitorder="little").astype(bool)
        self.sizes = sorted(n - _SIZES for n in filters if n > _SIZES)

    def _passing(self, number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the keys a filter lets through, by number."""
        bits = self.filters[number]
        on = np.arange(len(a))
        for x in _slots(a, b):
            x = x[on]
            on = on[(bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)]
        return on

    def found(self, block: bytes, ends: np.ndarray, owners: np.ndarray) -> Iterator[pd.DataFrame]:
        """Keys (owner, size, a, b) of a block of texts, which end at ends, that passages may have."""
        keys = Keys(block)
        places = np.flatnonzero(self.starts[keys.eight & np.uint64(0xFFFF)])
        text = np.searchsorted(ends, places, "right")
        left = ends[text] - places
        led = False
        for size in self.sizes:
            if size > EXACT and not led:  # few texts hold the first bytes of such a passage
                on = np.flatnonzero(left > EXACT)
                on = on[self._passing(_LEADS, *keys.at(places[on], EXACT))]
                places, text, left, led = places[on], text[on], left[on], True
            fits = np.flatnonzero(left >= size)
            if not len(fits):
                return
            a, b = keys.at(places[fits], size)
            on = self._passing(size + _SIZES, a, b)
            if len(on):
                yield pd.DataFrame({"owner": owners[text[fits[on]]], "size": np.int32(size), "a": a[on].view(np.int64), "b": b[on].view(np.int64)}).drop_duplicates()


def _blocks(bodies: pa.Array, longest: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts side by side, where they end, and whose they are; long ones in parts that overlap by a key."""
    step = max(BLOCK, longest)
    parts, owners, total = [], [], 0
    for owner, body in enumerate(bodies):
        body = body.as_py()
        for at in range(0, len(body), step):
            parts.append(body[at : at + step + longest - 1])
            owners.append(owner)
            total += len(parts[-1])
            if total >= BLOCK:
                yield b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(owners)
                parts, owners, total = [], [], 0
    if parts:
        yield b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(owners)


def _filters(asked: DataFrame) -> dict[int, np.ndarray]:
    """The filters by number: FILTER_BITS bits each, made in Spark, so small for any number of passages."""
    slot = F.explode("passed").alias("slot")
    made = asked.select(slot).select((F.col("slot") + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for r in made.collect():
        at = (r["bucket"] - 1) * len(r["bits"])
        number, place = divmod(at, 1 << FILTER_BITS - 3)
        out.setdefault(number, np.zeros(1 << FILTER_BITS - 3, np.uint8))[place : place + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def contained(texts: DataFrame, passages: DataFrame, row_id: str = "doc_id", text: str = "text", passage_id: str = "item_id", passage: str = "text") -> DataFrame:
    """(row id, passage id) of every text that holds a passage, character by character.

    A passage's key stands for its first bytes: all of them up to EXACT, else at least two
    thirds. Texts are read once for the keys at every byte that filters of all passages' keys
    let through; both sides meet on the keys. Up to EXACT bytes that is the answer; beyond,
    the texts that share a key are compared. So the work goes by the texts and by the pairs
    that are there, not by texts times passages.

    Null texts and null or empty passages are in no pair. Repeated rows pair each for
    themselves; ids may be null or repeat. Neither table is collected or crossed. Passages of
    up to COVERED bytes stand in most texts; beyond MOST_SHORT bytes of them are refused.
    """
    spark = texts.sparkSession
    docs = texts.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("body")).filter("body is not null").withColumn("row", F.monotonically_increasing_id())
    docs = shared_table(docs, "contained-texts")
    asked = passages.select(F.col(passage_id).alias("item"), F.col(passage).cast("string").cast("binary").alias("sought")).filter("sought <> X''")
    item = StructType([asked.schema["item"], asked.schema["sought"], *_KEY_FIELDS, StructField("passed", ArrayType(LongType()))])
    asked = shared_table(asked.mapInArrow(_keyed, item), "contained-passages")
    size = asked.filter(F.col("size") <= COVERED).agg(F.sum("size")).first()[0] or 0
    if size > MOST_SHORT:
        raise ValueError(f"passages of up to {COVERED} bytes have {size} together; at most {MOST_SHORT} are taken")
    filters = _filters(asked)
    sent = spark.sparkContext.broadcast(filters)
    longest = max(filters, default=0) - _SIZES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Filters(sent.value)
        for batch in batches:
            hits = [found for block in _blocks(batch.column("body"), longest) for found in wanted.found(*block)]
            if hits:
                hit = pd.concat(hits).drop_duplicates()
                owner = pa.array(hit["owner"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), batch.column("row").take(owner), *(pa.array(hit[k].to_numpy()) for k in KEY)], ["id", "row", *KEY])

    kind = StructType([docs.schema["id"], docs.schema["row"], *_KEY_FIELDS])
    hits = docs.select("id", "row", F.col("body").cast("binary").alias("body")).mapInArrow(run, kind) if filters else spark.createDataFrame([], kind)
    hits = shared_table(hits, "contained-keys")
    wanted, whole = asked.drop("passed"), F.octet_length("sought") <= EXACT
    short = hits.join(wanted.filter(whole), KEY).select("id", "item")
    likely = hits.drop("id").join(wanted.filter(~whole), KEY).select("row", "item", F.col("sought").cast("string").alias("sought"))
    long = likely.join(docs, "row").filter(F.contains("body", "sought")).select("id", "item")
    return short.union(long).select(F.col("id").alias(row_id), F.col("item").alias(passage_id))
