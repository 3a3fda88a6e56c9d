"""Near-duplicate texts: SetSketch bands, likelihood estimates and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import setsketch as sk
from larder.llm.common import staged
from larder.llm.components import Forest, components
from larder.llm.tokens import slices

#: Members of a bucket that one block of comparisons takes from either side.
BLOCK = 1024
#: Rows of small blocks and stars that are worked on together.
GROUP_ROWS = 4_000


def _set_table(docs: DataFrame, size: int, row_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty) and registers."""
    schema = "doc_id long, n_shingles long, set_key binary, regs binary"

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = sk.shingle_sets(part.column(1), size)
                regs = sk.registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "regs"],
                )

    return staged(docs.select(F.col(row_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema), "sets")


def _bands(vertices: DataFrame) -> DataFrame:
    """One row of (bkey, id, n) for each band of each vertex."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([np.frombuffer(x.as_py(), dtype=np.uint16) for x in batch.column(2)])
            keys = sk.band_keys(regs)
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), sk.BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(repeat), batch.column(1).take(repeat)], names=["bkey", "id", "n"])

    return vertices.select("id", "n", "regs").mapInArrow(run, "bkey long, id long, n long")


def _hashes(blob) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Written rows with ``deal``: whole keys dealt over groups of about GROUP_ROWS rows."""
    rows = staged(rows, "dealt")
    groups = max(1, rows.count() // GROUP_ROWS)
    return rows.withColumn("deal", F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int"))


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), sk.REGISTERS)


def _may_link(percent: int, regs: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows may link by likelihood, in slices of bounded memory."""
    parts = [sk.may_reach(percent / 100, regs[a[s : s + 20_000]], regs[b[s : s + 20_000]], n[a[s : s + 20_000]], n[b[s : s + 20_000]]) for s in range(0, len(a), 20_000)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _star_links(stars: DataFrame, percent: int) -> DataFrame:
    """Links between each star's leader and members: estimated by likelihood, then exact."""

    def run(table: pa.Table) -> pa.Table:
        ids, n, leader, salt = (table[c].to_numpy() for c in ("id", "n", "leader", "salt"))
        leads = table["leads"].to_numpy()
        regs, bodies = _registers(table["regs"]), table["hashes"].to_pylist()
        centre = {(x, y): i for i, x, y in zip(np.flatnonzero(leads).tolist(), leader[leads].tolist(), salt[leads].tolist(), strict=True)}
        own = np.flatnonzero(~leads)
        first = np.array([centre[k] for k in zip(leader[own].tolist(), salt[own].tolist(), strict=True)], dtype=np.int64)
        may = _may_link(percent, regs, n, first, own)
        good = [(i, j) for i, j in zip(own[may].tolist(), first[may].tolist(), strict=True) if _linked(_hashes(bodies[i]), _hashes(bodies[j]), percent)]
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in good], pa.int64()), "b": pa.array([int(ids[j]) for _, j in good], pa.int64())})

    return stars.groupBy("deal").applyInArrow(run, "a long, b long")


def _candidates(ids, labels, n, sides, block, keys, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one block in different components, of fit sizes, whose first band this is."""
    band = np.argmax(keys == block[0], axis=1)
    left, right = np.flatnonzero(sides == block[1]), np.flatnonzero(sides == block[2])
    a, b = [], []
    for i in left:
        other = right[right > i] if block[1] == block[2] else right
        other = other[(labels[other] != labels[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
        if len(other):
            other = other[np.argmax(keys[other] == keys[i], axis=1) == band[i]]
            a.append(np.full(len(other), i))
            b.append(other)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_BLOCK_PAIRS = pa.schema([("bkey", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket block that may be links and are in different components so far.

    A pair is taken only in the first band in which its registers agree, so it comes
    once. One row a block, with the pairs as arrays.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bkey", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("id", "ascending")])
        bkey, lo, hi, ids, labels, n, sides = (table[c].to_numpy() for c in ("bkey", "lo", "hi", "id", "label", "n", "side"))
        regs = _registers(table["regs"])
        keys = sk.band_keys(regs)
        new = np.flatnonzero(np.concatenate([[True], (bkey[1:] != bkey[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        ends = np.append(new[1:], len(bkey))
        a, b = [], []
        for s, e in zip(new.tolist(), ends.tolist(), strict=True):
            x, y = _candidates(ids[s:e], labels[s:e], n[s:e], sides[s:e], (bkey[s], lo[s], hi[s]), keys[s:e], percent)
            a.append(x + s)
            b.append(y + s)
        a, b = np.concatenate(a), np.concatenate(b)
        may = _may_link(percent, regs, n, a, b)
        a, b = a[may], b[may]
        out = []
        at = np.searchsorted(new, a, side="right") - 1
        for block in np.unique(at).tolist():
            of = at == block
            s = new[block]
            out.append({"bkey": int(bkey[s]), "lo": int(lo[s]), "hi": int(hi[s]), "a": ids[a[of]].tolist(), "b": ids[b[of]].tolist()})
        return pa.Table.from_pylist(out, schema=_BLOCK_PAIRS)

    return rows.groupBy("deal").applyInArrow(run, "bkey long, lo int, hi int, a array<long>, b array<long>")


def _block_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links of block pairs; links that join nothing new in the block are left out."""
    needs = pairs.select(F.col("bkey").alias("_bkey"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.array_union("a", "b")).alias("id"))
    bodies = needs.join(sets.select("id", "hashes"), "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bodies = {i: _hashes(h) for i, h in zip(right["id"].to_pylist(), right["hashes"].to_pylist(), strict=True)}
        forest, a, b = Forest(), [], []
        for row in left.to_pylist():
            for x, y in zip(row["a"], row["b"], strict=True):
                if forest.root(x) != forest.root(y) and _linked(bodies[x], bodies[y], percent):
                    forest.join(x, y)
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("bkey", "lo", "hi").cogroup(bodies.groupBy("_bkey", "_lo", "_hi")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate classes of texts: doc_id, n_shingles, component_id, kept.

    A row's set is its distinct shingles of ``size`` words; rows link if 100 * common >=
    percent * union, and a component is what links reach.

    1. Equal sets become one vertex, by partial aggregation (copies are never paired).
    2. SetSketch registers are banded; each bucket's members are compared with its
       smallest id: a likelihood estimate first, then full sets. A leader's members are
       dealt over blocks.
    3. Where a bucket still holds several components, all pairs of different components
       are estimated in blocks (each in the first band they share), and those that may
       be links are verified on full sets. So every pair that shares a band is settled.

    Defined cases: null or wordless text has the empty set and links with nothing; a
    null id gets no component and is not kept; rows that share an id count as one
    document in the graph, whose texts are linked; an empty table gives no rows.
    Vertices are known by their smallest doc_id, by numbers of their own where one
    doc_id has several texts.
    """
    table = _set_table(docs, size, row_id, text)
    filled = table.filter("set_key is not null and doc_id is not null")
    key = F.xxhash64("set_key")
    repeats = staged(filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), (F.min(key) != F.max(key)).alias("differ")).filter("k > 1"), "repeats")
    repeated, differ = not repeats.isEmpty(), not repeats.filter("differ").isEmpty()
    vertices = filled.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    vertices = staged(vertices.withColumn("id", F.monotonically_increasing_id() if differ else F.col("doc_id")), "vertices")
    dealt = _bands(vertices).repartition("bkey")
    buckets = dealt.groupBy("bkey").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    multi = staged(dealt.join(buckets, "bkey"), "buckets")

    involved = multi.select("id").distinct()
    if differ:
        involved = involved.join(vertices.select("id", "doc_id"), "id").select(F.col("doc_id").alias("id")).distinct()
    schema = "doc_id long, set_key binary, hashes binary"

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = sk.shingle_sets(part.column(1), size)
                hashes = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in hashes], pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "set_key", "hashes"])

    source = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    bodies = source.join(involved.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(sets_of, schema)
    sets = bodies.join(vertices, ["doc_id", "set_key"])
    if repeated:  # a row and its repeats are one
        sets = sets.groupBy("doc_id", "set_key", "id", "n").agg(F.first("hashes").alias("hashes"), F.first("regs").alias("regs"))
    sets = staged(sets.select("id", "hashes", "n", "regs"), "bodies")

    pairs = multi.filter("id <> leader").select("leader", "id", "n").distinct()
    leaders = vertices.select(F.col("id").alias("leader"), F.col("n").alias("ln"))
    pairs = pairs.join(leaders, "leader").filter(100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")).select("leader", "id")
    counts = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("m"))
    pairs = pairs.join(counts, "leader").select("leader", F.pmod(F.xxhash64("id"), F.floor(F.col("m") / BLOCK).cast("long") + 1).cast("int").alias("salt"), "id")
    stars = pairs.withColumn("leads", F.lit(False)).union(pairs.select("leader", "salt", F.col("leader").alias("id"), F.lit(True).alias("leads")).distinct())
    stars = _dealt(stars, ["leader", "salt"]).join(sets, "id")
    links = _star_links(stars, percent)
    if differ:
        at = filled.join(repeats.filter("differ").select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").distinct()
        at = staged(at.join(vertices.select("set_key", "id"), "set_key").select("doc_id", "id"), "shared-ids")
        links = links.union(at.join(at.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b"))
    links = staged(links, "star-links")
    labels = components(links)

    at = multi.select("bkey", "id", "n", "k").join(labels, "id", "left").select("bkey", "id", "n", "k", F.coalesce("component", "id").alias("label"))
    at = staged(at, "labelled")
    open_ = at.groupBy("bkey").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("bkey")
    blocks = F.floor(F.col("k") / BLOCK).cast("int") + 1
    side = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = at.join(open_, "bkey", "left_semi").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bkey", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "id", "n", "label")
    rows = _dealt(rows, ["bkey", "lo", "hi"]).join(vertices.select("id", "regs"), "id")
    near = staged(_block_pairs(rows, percent), "pairs")
    more = staged(_block_links(near, sets, percent), "block-links")
    labels = components(links.union(more))

    classes = vertices.select("set_key", "doc_id", "id").join(labels, "id", "left").select("set_key", "doc_id", F.coalesce("component", "id").alias("component_id"))
    classes = staged(classes, "classes")
    if differ:
        least = classes.groupBy("component_id").agg(F.min("doc_id").alias("_least"))
        classes = staged(classes.join(least, "component_id").select("set_key", "doc_id", F.col("_least").alias("component_id")), "classes")
    classes = classes.drop("doc_id")
    rest = table.filter("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = filled.select("doc_id", "n_shingles", "set_key").join(classes, "set_key").select("doc_id", "n_shingles", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
