"""Corpus chunks with local dictionaries, and exchanges of numbers keyed by hash.

A chunk is what one task reads (up to CHUNK_TOKENS tokens). Its distinct words are sorted
by a 64-bit hash, so a bucket (a range of hashes) is a run of them. A request sends each
bucket's run once per chunk, however often a word occurs, and a reply returns one number
for each place of the run: the chunk knows the order and needs no keys back. Per chunk a
key is one entry, so no word, however common, weighs on one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bucketed, crc_mod, staged
from larder.llm.tokens import slices

CHUNK_TOKENS = 1_200_000
#: Text that is split at once; workers keep their peak of memory for later stages.
SLICE_BYTES = 1_000_000

CHUNK_SCHEMA = "chunk long, doc_ids array<long>, flags array<boolean>, sizes array<int>, codes binary, words binary, n_words int"


def squeeze(x: np.ndarray) -> bytes:
    """Compressed bytes of an array; bytes of equal rank stand together, which packs better."""
    raw = np.ascontiguousarray(x)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T if len(raw) else raw.view(np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueeze(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def squeeze_codes(codes: np.ndarray, n: int) -> bytes:
    """Word codes: one byte for the 255 most common, the others apart from them."""
    common = np.argsort(-np.bincount(codes, minlength=n), kind="stable")[:255].astype("<i4")
    short = np.full(n, 255, dtype=np.uint8)
    short[common] = np.arange(len(common), dtype=np.uint8)
    first = short[codes]
    parts = [common.tobytes(), zstandard.compress(first.tobytes(), 1), squeeze(codes[first == 255].astype("<i4"))]
    return np.array([len(x) for x in parts], dtype="<i8").tobytes() + b"".join(parts)


def unsqueeze_codes(blob: bytes) -> np.ndarray:
    a, b, c = np.frombuffer(blob[:24], dtype="<i8").tolist()
    common = np.concatenate([np.frombuffer(blob[24 : 24 + a], dtype="<i4"), np.zeros(256, "<i4")])
    first = np.frombuffer(zstandard.decompress(blob[24 + a : 24 + a + b]), dtype=np.uint8)
    codes = common[first]
    codes[first == 255] = unsqueeze(blob[24 + a + b : 24 + a + b + c], "<i4")
    return codes


def squeeze_values(x: np.ndarray) -> bytes:
    """Numbers of which many repeat."""
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def unsqueeze_values(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype=dtype)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, "<u8"), dtype=np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def pack_words(words: list[str]) -> bytes:
    """Words joined by a character that none holds."""
    return zstandard.compress("\n".join(words).encode("utf-8"), 6)


def unpack_words(blob: bytes, n: int) -> list[str]:
    return zstandard.decompress(blob).decode("utf-8").split("\n") if n else []


def bucket_starts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run begins in sorted keys, with the end as last entry."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def dealt(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words bucket by bucket, in their order within each, and where buckets begin."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    owner = np.searchsorted(edges, hashes(words), side="right")
    return np.argsort(owner, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=buckets))]).astype(np.int64)


def chunk_table(docs: DataFrame, words_of: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], flag, row_id: str = "doc_id", text: str = "text", by_chunk: bool = False, in_buckets: bool = False) -> DataFrame:
    """Encoded documents: a row a chunk, written once; if by_chunk or in_buckets in buckets
    of chunks, if by_chunk with words in order of their letters, which packs better than that
    of hashes.

    words_of gives the words of an Arrow text column and each text's count; words may
    not hold line feeds. flag is a boolean column kept for each document.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, flags, sizes, flats, held = [], [], [], [], 0

        def flush():
            nonlocal ids, flags, sizes, flats, held, number
            flat = pa.concat_arrays(flats)
            coded = flat.dictionary_encode()
            own = coded.dictionary.to_pylist()
            order = pc.sort_indices(coded.dictionary).to_numpy() if by_chunk else np.argsort(hashes(own), kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int32)
            row = [[(part << 32) + number], [ids], [flags], [np.concatenate(sizes).tolist()], [squeeze_codes(codes, len(own))], [pack_words([own[i] for i in order])], [len(own)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32()]
            ids, flags, sizes, flats, held = [], [], [], [], 0
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in CHUNK_SCHEMA.split(", ")])

        for batch in batches:
            for s in slices(batch, 1, SLICE_BYTES):
                flat, counts = words_of(s.column(1))
                ids += s.column(0).to_pylist()
                flags += s.column(2).to_pylist()
                sizes.append(counts)
                flats.append(flat)
                held += len(flat)
                if held >= CHUNK_TOKENS:
                    yield flush()
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()

    chunks = docs.select(F.col(row_id).cast("long"), F.col(text).cast("string"), flag).mapInArrow(run, CHUNK_SCHEMA)
    return bucketed(chunks, "chunk", "chunks") if by_chunk or in_buckets else staged(chunks, "chunks", compression="none")


def training_flag(row_id: str = "doc_id"):
    return (crc_mod(F.col(row_id), 7) != 2).alias("_train")


def lists(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    """One row's list column as an array (null ids are not looked at)."""
    return pc.fill_null(batch.column(name)[i].values, False if pa.types.is_boolean(batch.column(name).type.value_type) else 0).to_numpy(zero_copy_only=False)
