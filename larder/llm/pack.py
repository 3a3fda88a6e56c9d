"""Concatenate and cut: pack token streams into fixed windows with two prefix sums."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import staged

#: The most bytes a tokenizer file may have to be broadcast.
MAX_TOKENIZER_BYTES = 64_000_000

_ENCODERS: dict[int, object] = {}


class ByteBpe:
    """Byte-level BPE of a tokenizers JSON file.

    tiktoken runs the file's own vocabulary: with byte-level BPE a merge's rank and the
    id of its product rise together, so ids serve as ranks (checked on loading; else,
    and for texts that hold an added token's string or runs of white space that tiktoken's
    matcher gives up on, the tokenizers library encodes). Both give the same ids; tests
    compare them.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(spec.decode("utf-8"))
        parsed = json.loads(spec)
        self.added = [t["content"] for t in parsed.get("added_tokens", [])]
        self.fast = self._fast(parsed)

    def _fast(self, parsed: dict):
        import tiktoken

        model = parsed["model"]
        if model.get("type") != "BPE" or (parsed.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or parsed["pre_tokenizer"].get("add_prefix_space") or parsed.get("normalizer"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = set(self.added)
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            return None
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except ValueError:  # "Max stack size exceeded", from about 600,000 blanks on
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def read_bytes(path: str) -> bytes:
    """A tokenizer file, to be broadcast; a larger one than MAX_TOKENIZER_BYTES is refused."""
    size = os.path.getsize(path)
    if size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file of {size} bytes; at most {MAX_TOKENIZER_BYTES} are broadcast")
    with open(path, "rb") as f:
        return f.read()


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every row, with its place in the stream of its partition.

    First pass. Columns: part (writing task), local_start (ids before it in the part),
    doc_id, n_tokens, ids (little-endian; two bytes an id where all fit). The table is
    written to the shared folder: its committed files fix the order of the stream.
    Null text counts as empty; every row ends with end_id, so none is without tokens.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_bytes(tokenizer_path))
    schema = "part int, local_start long, doc_id long, n_tokens long, width int, ids binary"

    def encode(batches):
        spec = shipped.value
        key = zlib.crc32(spec)
        bpe = _ENCODERS.get(key)
        if bpe is None:
            bpe = _ENCODERS[key] = ByteBpe(spec)
        part, start = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            starts, counts, widths, blobs = [], [], [], []
            for value in batch.column(1):
                body = value.as_py()
                ids = np.concatenate([bpe.encode(body), end]) if body else end
                width = 2 if int(ids.max()) < 65536 else 4
                starts.append(start)
                counts.append(len(ids))
                widths.append(width)
                blobs.append(ids.astype(f"<u{width}").tobytes())
                start += len(ids)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(widths, pa.int32()), pa.array(blobs, pa.binary())],
                names=["part", "local_start", "doc_id", "n_tokens", "width", "ids"],
            )

    return staged(docs.select(F.col(row_id).cast("long"), F.col(text).cast("string")).mapInArrow(encode, schema), "tokens", compression="zstd")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Cut the concatenated stream of all rows into windows of ``length`` ids.

    Two prefix sums place every row: the first pass numbers ids within a partition, the
    second adds the totals of earlier partitions (one row a partition, so its size is
    that of the task list). A row that crosses a window's end becomes several pieces,
    the boundary records: doc_id, start (ids of the row before the piece), length,
    ids_crc32 (of unsigned 32-bit little-endian ids), doc_tokens, sequence_id, offset.
    Only the last window is not full. Repeated rows are packed each for itself; a null
    id is kept; an empty table gives no pieces.
    """
    tokens = token_table(docs, tokenizer_path, end_id)
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("at"), "n_tokens", "width", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches):
        for batch in batches:
            ids_of, rows = batch.column("doc_id"), []
            source, at, widths, blobs = [], batch.column("at").to_pylist(), batch.column("width").to_pylist(), batch.column("ids")
            for i, first in enumerate(at):
                ids = memoryview(np.frombuffer(blobs[i].as_py(), dtype=f"<u{widths[i]}").astype("<u4")).cast("B")
                n, start = len(ids) // 4, 0
                while start < n:
                    where = first + start
                    take = min(n - start, length - where % length)
                    rows.append((start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), n, where // length, where % length))
                    source.append(i)
                    start += take
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=[f.split()[0] for f in schema.split(", ")])

    return placed.mapInArrow(cut, schema)
