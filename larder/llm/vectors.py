"""Near-duplicate embeddings: inverted lists, product-quantised residuals, exact rerank."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import staged
from larder.llm.components import Forest, components

#: Bounded sample the index is fitted on; every row is indexed.
FIT_ROWS = 20_000
SUBSPACES, CODEWORDS = 16, 256
#: Centres of one level. Where the square root of the rows is larger, every list is divided
#: by a second level of centres, fitted on residuals, so that lists grow with the rows.
MAX_LISTS = 4096
#: A list is probed if a link can make up for its centre's being farther than the nearest
#: one, at this many deviations.
PROBE_DEVIATIONS = 3.0
BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        n = np.bincount(best, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre of each row and its squared distance, in slices."""
    half = (centres**2).sum(axis=1) / 2
    best, dist = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for s in range(0, len(x), 4096):
        part = x[s : s + 4096]
        score = part @ centres.T - half
        best[s : s + 4096] = b = score.argmax(axis=1)
        dist[s : s + 4096] = (part**2).sum(axis=1) - 2 * score[np.arange(len(part)), b]
    return best, np.maximum(dist, 0)


class Index:
    """Coarse centres, a second level of centres where lists are many, and residual codebooks."""

    def __init__(self, sample: np.ndarray, n_lists: int, cosine: float, max_lists: int = MAX_LISTS):
        rng = np.random.default_rng(11)
        self.dim = sample.shape[1]
        self.width = math.ceil(self.dim / SUBSPACES)
        self.radius = math.sqrt(2 - 2 * cosine)
        self.centres = _kmeans(sample, min(n_lists, max_lists, len(sample)), 8, rng)
        rest = sample - self.centres[nearest(sample, self.centres)[0]]
        self.fine = np.zeros((1, self.dim))
        if n_lists > max_lists:
            self.fine = _kmeans(rest, min(math.ceil(n_lists / max_lists), max_lists, len(sample)), 8, rng)
        rest = self._split(rest - self.fine[nearest(rest, self.fine)[0]])
        k = min(CODEWORDS, len(sample))
        self.books = np.stack([_kmeans(rest[:, s], k, 5, rng) for s in range(SUBSPACES)])
        self.lists = len(self.centres) * len(self.fine)

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.width * SUBSPACES))
        padded[:, : self.dim] = x
        return padded.reshape(len(x), SUBSPACES, self.width)

    def _centre(self, lists) -> np.ndarray:
        return self.centres[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def _near(self, x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre of each row, and which centres a link of it may be nearest to.

        A linked vector lies at most ``radius`` away. Moving a row by e changes the
        difference of its distances to two centres by e . (u - v), u and v the unit
        vectors from the centres to the row; over directions of e that has deviation
        radius * |u - v| / sqrt(dim).
        """
        cross, norm = x @ centres.T, (x**2).sum(axis=1)
        away = np.sqrt(np.maximum(norm[:, None] + (centres**2).sum(axis=1) - 2 * cross, 1e-18))
        best, i = away.argmin(axis=1), np.arange(len(x))
        own = centres[best]
        inner = norm[:, None] - cross - cross[i, best][:, None] + own @ centres.T
        turned = np.sqrt(np.maximum(2 - 2 * inner / (away * away[i, best][:, None]), 0))
        return best, away - away[i, best][:, None] <= PROBE_DEVIATIONS * self.radius / math.sqrt(self.dim) * turned + 1e-9

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own list of each row, and the lists its search comes to, in order.

        On the second level the same holds for what is left of row and link about a centre.
        """
        home, found, k = np.empty(len(x), dtype=np.int64), [], len(self.fine)
        for s in range(0, len(x), 512):
            part = x[s : s + 512]
            best, near = self._near(part, self.centres)
            if k == 1:
                home[s : s + 512] = best
                found += [np.flatnonzero(row) for row in near]
                continue
            for i in range(len(part)):
                coarse = np.flatnonzero(near[i])
                own, fine = self._near(part[i] - self.centres[coarse], self.fine)
                home[s + i] = best[i] * k + own[np.searchsorted(coarse, best[i])]
                at, inner = np.nonzero(fine)
                found.append(coarse[at] * k + inner)
        return home, found

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes (bytes) and the distance of each row to what they stand for."""
        parts = self._split(x - self._centre(lists))
        codes, error = np.empty((len(x), SUBSPACES), dtype=np.uint8), np.zeros(len(x))
        for s in range(SUBSPACES):
            codes[:, s], d = nearest(parts[:, s], self.books[s])
            error += d
        return codes, np.sqrt(error)

    def lookup(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded rows of list ``at``, by table look-up."""
        parts = self._split(queries - self._centre(at))
        total = np.zeros((len(queries), len(codes)))
        for s in range(SUBSPACES):
            book = self.books[s]
            table = (parts[:, s] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * parts[:, s] @ book.T
            total += table[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def _valid(vectors: DataFrame, row_id: str, column: str) -> DataFrame:
    """vec_id, digest and bytes of each vector, in the column's own width; null where it cannot link."""
    schema = "vec_id long, vec_key binary, unit binary"
    kind = _width(vectors, column)

    def run(batches):
        for batch in batches:
            keys, bodies = [], []
            for value in batch.column(1):
                row = value.as_py()
                x = np.array(row, dtype=np.float64) if row and None not in row else None
                good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                own = x.astype(kind).tobytes() if good else None
                keys.append(xxhash.xxh3_128_digest(own) if good else None)
                bodies.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["vec_id", "vec_key", "unit"])

    return staged(vectors.select(F.col(row_id).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, schema), "vectors")


def _width(vectors: DataFrame, column: str) -> str:
    return "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"


def _units(column, kind: str) -> np.ndarray:
    """Unit vectors in doubles, from the bytes of given vectors.

    Divided by the largest component first, so that no square overflows or vanishes.
    """
    x = np.stack([np.frombuffer(v.as_py(), dtype=kind) for v in column]).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _search(keyed: DataFrame, queries: DataFrame, shipped, cosine: float, kind_of: str) -> DataFrame:
    """Per block: link counts of ids (kind 0: a, n) and a forest of its links (kind 1: a, b)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, n, kind = [], [], [], []
        if left.num_rows and right.num_rows:
            offset, index = pickle.loads(shipped.value)[len(left["unit"][0].as_py())]
            at = left["list"][0].as_py() - offset
            rows, qs = _units(left["unit"], kind_of), _units(right["q_unit"], kind_of)
            ids, q_ids = left["id"].to_numpy(), right["q_id"].to_numpy()
            mult, q_mult, home = left["mult"].to_numpy(), right["q_mult"].to_numpy(), right["q_home"].to_numpy() - offset
            codes = np.stack([np.frombuffer(c.as_py(), dtype=np.uint8) for c in left["codes"]])
            reach = index.radius + left["error"].to_numpy() + 1e-9
            asks = left["probes"].combine_chunks()  # (row, list) as one number, in order
            asks = np.repeat(np.arange(len(rows)), np.diff(asks.offsets.to_numpy())) * index.lists + asks.values.to_numpy()[asks.offsets[0].as_py() :] - offset
            row_sum, forest = np.zeros(len(rows), dtype=np.int64), Forest()
            for s in range(0, len(qs), 256):
                part = qs[s : s + 256]
                qi, ri = np.nonzero(index.lookup(part, at, codes) <= reach)
                cos = np.concatenate([np.einsum("ij,ij->i", part[qi[k : k + 20000]], rows[ri[k : k + 20000]]) for k in range(0, max(len(qi), 1), 20000)])
                good = (cos >= cosine) & (q_ids[s + qi] != ids[ri])
                qi, ri = qi[good] + s, ri[good]
                sums = np.bincount(qi - s, weights=mult[ri], minlength=len(part)).astype(np.int64)
                for i in np.flatnonzero(sums):
                    kind.append(0), a.append(int(q_ids[s + i])), b.append(0), n.append(int(sums[i]))
                # a row whose own search does not come to the query's list learns of the link here
                one_way = ~np.isin(ri * index.lists + home[qi], asks)
                np.add.at(row_sum, ri[one_way], q_mult[qi[one_way]])
                for x, y in zip(q_ids[qi].tolist(), ids[ri].tolist(), strict=True):
                    if forest.join(x, y):
                        kind.append(1), a.append(x), b.append(y), n.append(0)
            for i in np.flatnonzero(row_sum):
                kind.append(0), a.append(int(ids[i])), b.append(0), n.append(int(row_sum[i]))
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    key = ["list", "q_block", "r_block"]
    return keyed.groupBy(*key).cogroup(queries.groupBy("q_list", "q_q_block", "q_r_block")).applyInArrow(run, "kind int, a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, row_id: str = "vec_id", column: str = "embedding", max_lists: int = MAX_LISTS) -> DataFrame:
    """Near-duplicate classes of vectors: vec_id, n_links, component_id, kept.

    Equal vectors are one class with a multiplicity. Unit vectors go to their nearest
    coarse centre with the codes of their residual. Every class searches the lists near
    it: table look-ups give approximate distances, a row stays if its distance less its
    own coding error may be within reach (the triangle inequality, so this step loses
    nothing), and the exact cosine in doubles decides. A pair that only one side's
    search meets counts for both. Lists and searches are dealt over blocks of BLOCK rows.

    Null, zero and non-finite vectors link with nothing and are kept; a null id has no
    component and is not kept; an empty table gives no rows. Each length has an index of
    its own, whose lists are numbered after those of shorter ones; vectors of different
    lengths have no cosine and do not link. There are as many lists as the square root of
    the rows, in two levels beyond max_lists, so lists and their searches grow with it.
    """
    kind = _width(vectors, column)
    table = _valid(vectors, row_id, column)
    good = table.filter("vec_key is not null and vec_id is not null")
    classes = staged(good.groupBy("vec_key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("unit").alias("unit")), "vector-classes")
    empty = good.select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("found"), F.col("vec_id").alias("component")).limit(0)
    found, labels = empty.select("id", "found"), empty.select("id", "component")
    n_bytes = F.length("unit").alias("bytes")
    sizes = classes.groupBy(n_bytes).count().filter("count > 1").orderBy("bytes").collect()  # one row a length
    if sizes:
        spark = vectors.sparkSession
        usual = classes.join(F.broadcast(spark.createDataFrame([(x["bytes"],) for x in sizes], "bytes int")), n_bytes == F.col("bytes"), "left_semi")
        unit_hash = F.pmod(F.xxhash64("vec_key"), F.lit(1_000_000)) / 1_000_000
        indexes, offset = {}, 0
        for x in sizes:
            share = min(1.0, FIT_ROWS / x["count"])
            sample = _units(classes.filter((n_bytes == x["bytes"]) & (unit_hash < share)).select("unit").toArrow()["unit"], kind)
            indexes[x["bytes"]] = offset, Index(sample, max(1, round(math.sqrt(x["count"]))), cosine, max_lists)
            offset += indexes[x["bytes"]][1].lists
        # at most max_lists centres a level and the codebooks a length, however many rows there are
        shipped = spark.sparkContext.broadcast(pickle.dumps(indexes))

        def index_rows(batches):
            own: dict[int, tuple[int, Index]] = pickle.loads(shipped.value)
            for batch in batches:
                lengths = pc.binary_length(batch.column(2)).to_numpy()
                for length in np.unique(lengths).tolist():
                    part, (first, index) = batch.filter(pa.array(lengths == length)), own[length]
                    x = _units(part.column(2), kind)
                    home, found = index.probes(x)
                    codes, error = index.encode(x, home)
                    probes = [lists + first for lists in found]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.array(home + first, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int64()))],
                        names=["id", "mult", "unit", "home", "codes", "error", "probes"],
                    )

        indexed = staged(usual.select("id", "mult", "unit").mapInArrow(index_rows, "id long, mult long, unit binary, home long, codes binary, error double, probes array<long>"), "vector-index")
        asked = indexed.select("id", F.explode("probes").alias("list"))
        list_rows = indexed.groupBy(F.col("home").alias("list")).agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("r_blocks"))
        list_asks = asked.groupBy("list").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("q_blocks"))
        plan = F.broadcast(staged(list_rows.join(list_asks, "list"), "vector-lists"))  # one row a list
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        rows = indexed.withColumnRenamed("home", "list").join(plan, "list").withColumn("r_block", deal("r_blocks")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        rows = rows.select("list", "q_block", "r_block", "id", "mult", "unit", "codes", "error", "probes")
        queries = indexed.select("id", "mult", "unit", "home", F.explode("probes").alias("list")).join(plan, "list").withColumn("q_block", deal("q_blocks")).withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
        queries = queries.select(F.col("list").alias("q_list"), F.col("q_block").alias("q_q_block"), F.col("r_block").alias("q_r_block"), F.col("id").alias("q_id"), F.col("mult").alias("q_mult"), F.col("unit").alias("q_unit"), F.col("home").alias("q_home"))
        result = staged(_search(rows, queries, shipped, cosine, kind), "vector-links")
        found = result.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("found"))
        labels = components(result.filter("kind = 1").select("a", "b"))
    merged = classes.select("vec_key", "id", "mult").join(found, "id", "left").join(labels, "id", "left")
    merged = staged(merged.select("vec_key", (F.coalesce("found", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-result")
    rest = table.filter("vec_key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "vec_key").join(merged, "vec_key").select("vec_id", "n_links", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
