"""Product codes of integer vectors by filtering Lloyd: kd-trees assign whole subtrees at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import staged

#: Components beyond this (as integers) count as not finite, so that no sum of squares overflows.
LIMIT = 1 << 24
#: Components of a block of rows that has trees of its own, points of a kd-tree's leaf, cells of one step.
BLOCK, LEAF, STEP = 1 << 22, 16, 1 << 20
#: Labels with more than this share of the rows (1 in HOT) have their total sent to every row.
HOT = 1000


class Tree:
    """A balanced kd-tree over integer points; each level's boxes, and sums by prefix."""

    def __init__(self, points: np.ndarray):
        self.order, bounds, self.levels = np.arange(len(points)), np.array([0, len(points)]), []
        while True:
            starts, node = bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
            self.levels.append((bounds, low, high))
            if not points.shape[1] or len(points) < 2 * LEAF * (len(bounds) - 1):
                break
            along = (high - low).argmax(axis=1)[node]
            turn = np.lexsort((points[np.arange(len(points)), along], node))
            points, self.order = points[turn], self.order[turn]
            bounds = np.sort(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2]))
        self.points = points
        self.before = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), points.cumsum(axis=0)])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every point in the tree's order, and sums and counts of the entries.

        An entry leaves a box if the box's centre has a nearer one that is nearer to the corner
        most in its favour too (as near, with a lower index): then to every point of the box. A
        box with one entry left goes to it whole; leaves compare their points with what is left.
        """
        owner, sums, counts = np.zeros(len(self.points), dtype=np.int64), np.zeros_like(book), np.zeros(len(book), dtype=np.int64)
        nodes, left = np.array([0]), np.ones((1, len(book)), dtype=bool)
        for depth, (bounds, low, high) in enumerate(self.levels):
            step = max(1, STEP // max(1, book.size))
            left = np.concatenate([self._nearer(book, low[nodes[s : s + step]], high[nodes[s : s + step]], left[s : s + step]) for s in range(0, len(nodes), step)])
            one = left.sum(axis=1) == 1
            done, entry = nodes[one], left[one].argmax(axis=1)
            starts, ends = bounds[done], bounds[done + 1]
            for a, b, e in zip(starts.tolist(), ends.tolist(), entry.tolist(), strict=True):
                owner[a:b] = e
            np.add.at(sums, entry, self.before[ends] - self.before[starts])
            np.add.at(counts, entry, ends - starts)
            nodes, left = nodes[~one], left[~one]
            if not len(nodes):
                break
            if depth + 1 < len(self.levels):
                nodes, left = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, axis=0)
                continue
            sizes = bounds[nodes + 1] - bounds[nodes]
            at, mask = np.repeat(bounds[nodes] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes) + np.arange(sizes.sum()), np.repeat(left, sizes, axis=0)
            for s in range(0, len(at), step):
                part = at[s : s + step]
                best = np.where(mask[s : s + step], squared(self.points[part], book), np.iinfo(np.int64).max).argmin(axis=1)
                owner[part] = best
                np.add.at(sums, best, self.points[part])
                np.add.at(counts, best, 1)
        return owner, sums, counts

    @staticmethod
    def _nearer(book: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> np.ndarray:
        centre = np.where(left, squared(low + high, 2 * book), np.iinfo(np.int64).max).argmin(axis=1)
        best = book[centre][:, None, :]
        corner = np.where(book[None] > best, high[:, None, :], low[:, None, :])
        lead = ((book[None] - best) * (book[None] + best - 2 * corner)).sum(axis=2)
        worse = (lead > 0) | (lead == 0) & (centre[:, None] < np.arange(len(book))[None])
        return left & ~worse


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return sum(((points[:, j, None] - book[None, :, j]) ** 2 for j in range(book.shape[1])), np.zeros((len(points), len(book)), dtype=np.int64))


def integers(vectors: DataFrame, row_id: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): vectors as floor(256 x), without those that have no such integers."""
    doubles = vectors.select(F.col(row_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("x")).filter("x is not null")
    usable = doubles.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < LIMIT)))
    return usable.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * 256).cast("int")).alias("v"))


def blocks(batches, width: int) -> Iterator[pa.Table]:
    """Batches gathered until they hold BLOCK components."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * max(width, 1) >= BLOCK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _next(rows: DataFrame, books: list[np.ndarray], cuts: np.ndarray) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of its parts; unused ones stay."""
    shipped, width, most = rows.sparkSession.sparkContext.broadcast(books), int(cuts[-1]), int(np.diff(cuts).max())

    def run(batches):
        for block in blocks(batches, width):
            v, out = _matrix(block["v"], width), []
            for p, book in enumerate(shipped.value):
                _, sums, counts = Tree(v[:, cuts[p] : cuts[p + 1]]).assign(book)
                for e in np.flatnonzero(counts).tolist():
                    out.append((p, e, int(counts[e]), *sums[e].tolist(), *[0] * (most - sums.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["part", "entry", "n", *(f"s{j}" for j in range(most))]
    found = rows.select("v").mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))
    new = [book.copy() for book in books]
    for r in found.collect():  # a row an entry at most
        book = new[r["part"]]
        book[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(book.shape[1])]
    return new


def codebooks(rows: DataFrame, width: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Codebooks of integer vectors of one width, and where their parts are cut."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    cuts = np.linspace(0, width, parts + 1).astype(int) if width % parts else np.arange(parts + 1) * (width // parts)
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), width)
    books = [start[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(rounds):
        books = _next(rows, books, cuts)
    return books, cuts


def assigned(rows: DataFrame, books: list[np.ndarray], cuts: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): entries of all parts in hex, and their squared distances."""
    shipped, width = rows.sparkSession.sparkContext.broadcast(books), int(cuts[-1])
    schema = rows.select("vec_id", "label").withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")).schema
    hexes = np.array([f"{e:02x}" for e in range(256)], dtype="S2")

    def run(batches):
        for block in blocks(batches, width):
            v = _matrix(block["v"], width)
            codes, error = np.zeros((len(v), len(shipped.value)), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
            for p, book in enumerate(shipped.value):
                tree = Tree(v[:, cuts[p] : cuts[p + 1]])
                owner, _, _ = tree.assign(book)
                codes[tree.order, p] = owner
                error[tree.order] += ((tree.points - book[owner]) ** 2).sum(axis=1)
            texts = hexes[codes].view(f"S{2 * codes.shape[1]}").ravel().astype(str)
            whole = pa.Table.from_arrays([block["vec_id"], block["label"], pa.array(texts.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
            yield from whole.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Rows with the error summed over their label (nulls together).

    Totals of labels with a share of 1 / HOT or more of the rows (HOT of them at most) go to
    every task; the other labels, none of which is large, are joined by a shuffle.
    """
    totals = staged(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    least = (totals.agg(F.sum("_n")).first()[0] or 0) / HOT
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot, rest = F.broadcast(totals.filter(F.col("_n") >= least)), totals.filter(F.col("_n") < least)
    return rows.join(hot, same).union(rows.join(hot, same, "left_anti").join(rest, same)).drop("_label", "_n")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, row_id: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Product codes of all usable vectors: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components go (so do those with a
    component of 2^16 or more in size). All sums are of integers, so neither the blocks nor
    the order of rows matter. The codebooks start as the rows with the smallest ids, null
    ids last, equal ids by their components; with fewer rows they are shorter. Repeated rows
    count each. Vectors of another length than the smallest id's belong to no codebook and
    go too. Where parts do not divide the length they differ by one component. An empty
    table gives no rows.
    """
    rows = staged(integers(vectors, row_id, column, label), "integers")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    rows = rows.filter(F.size("v") == width)
    books, cuts = codebooks(rows, width, parts, entries, rounds)
    told = ",".join(str(x) for book in books for x in book.ravel().tolist())
    coded = with_label_error(staged(assigned(rows, books, cuts), "codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in SQL: every part against every entry."""
    steps = [
        f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT vec_id, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS j, v[i] AS x
  FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)
), starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
), book0 AS (
  SELECT p, e, j, x AS z FROM cells JOIN starts USING (vec_id) WHERE e < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""far{k} AS (
  SELECT vec_id, p, e, sum((x - z) * (x - z))::BIGINT AS d FROM cells JOIN book{k} USING (p, j) GROUP BY vec_id, p, e
), near{k} AS (
  SELECT vec_id, p, min(d) AS d, min(d * {entries} + e) % {entries} AS e FROM far{k} GROUP BY vec_id, p
)""")
        if k < rounds:
            steps.append(f"""means{k} AS (
  SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM cells JOIN near{k} USING (vec_id, p) GROUP BY p, e, j
), book{k + 1} AS (
  SELECT p, e, j, CASE WHEN n IS NULL THEN z ELSE (s - ((s % n) + n) % n) // n END AS z FROM book{k} LEFT JOIN means{k} USING (p, e, j)
)""")
    steps.append(f"""codes AS (
  SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
), told AS (
  SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), told""")
    return ", ".join(steps)


SQL = _sql()
