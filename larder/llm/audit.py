"""Filter interaction audit: which filters remove what, alone, in every order, and on average."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import SPACE_CLASS, staged

#: Filters in the order of their bits; every set of failed filters is a number below 32.
FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, version, total, distinct) of the words of texts, by exploding them.

    Rows are dealt by document before they are exploded, so that words themselves are never
    shuffled: both aggregates stay within the task that holds the document. Repeated rows of
    a document add up in ``total``; texts without words have no row.
    """
    dealt = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").repartition("doc_id", "version")
    words = dealt.select("doc_id", "version", F.explode(F.split("text", SPACE_CLASS)).alias("word")).filter("word <> ''")
    each = words.groupBy("doc_id", "version", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id", "version").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))


def flagged(docs: DataFrame, labels: DataFrame, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 2, symbols: str = "#$%&*|") -> DataFrame:
    """(part, n, fails, good, toxic): documents of a part, with the set of filters they fail.

    The flags that need a text only (C, D) are written once with a digest of the text. The
    smallest id of each digest is its first document (E); it joins back by id, not by digest,
    so that copies never meet in a task. Word counts and labels join the same way.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    own = docs.select(
        "doc_id", F.xxhash64("text").alias("version"), F.sha2("text", 256).alias("digest"), "part",
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > upper_percent * F.length("text")).alias("c"),
        F.col("text").rlike(f"[{symbols}]").alias("d"),
    )
    own = staged(own, "audit-flags")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.min("version").alias("_version")).filter("_first is not null").withColumnRenamed("digest", "_digest")
    rows = own.groupBy("doc_id", "version", "digest", "part", "c", "d").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copies", F.sum("n").over(Window.partitionBy("doc_id", "version", "digest")))
    words = word_counts(docs).select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), "total", "distinct")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))

    rows = rows.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v")), "left")
    rows = rows.join(first, (F.col("doc_id") == F.col("_first")) & (F.col("version") == F.col("_version")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.join(marks, F.col("doc_id") == F.col("_labelled"), "left")
    total = F.coalesce(F.col("total") / F.col("copies"), F.lit(0)).cast("long")
    tests = [total < min_words, 100 * F.coalesce("distinct", F.lit(0)) < distinct_percent * total, F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("_first").isNull()]
    fails = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("part", "n", fails.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interactions(flags: DataFrame) -> DataFrame:
    """The report of (part, n, fails, good, toxic): a row a part, order and step.

    One aggregate counts each of the 32 sets of failed filters (all, good and toxic
    documents); every figure of the report is a sum of such counts.
    """
    kinds = {"all": "true", "good": "good", "toxic": "toxic"}
    wide = flags.groupBy("part").agg(*(F.expr(f"sum(if(fails = {s} and {kind}, n, 0)) as {name}_{s}") for name, kind in kinds.items() for s in range(SETS)))
    by_set = wide.select("part", *(F.array(*(f"{name}_{s}" for s in range(SETS))).alias(name) for name in kinds))
    steps = by_set.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))))
    bit = lambda i: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {i}, 1)) - 1)")
    before = sum((F.when(F.col("step") > i, bit(i)).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))
    steps = steps.withColumn("own", bit("step")).withColumn("before", before)

    def total(kind: str, holds, weight=lambda s: F.lit(1)) -> Column:
        sets = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), holds)
        return F.aggregate(sets, F.lit(0).cast("long"), lambda a, s: a + F.get(F.col(kind), s) * weight(s))

    own, earlier = lambda s: s.bitwiseAND(F.col("own")) != 0, lambda s: s.bitwiseAND(F.col("before")) != 0
    removed = lambda s: own(s) & ~earlier(s)
    return steps.select(
        "part", "filter_order", "step",
        total("all", lambda s: ~own(s) & ~earlier(s)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda s: own(s) & earlier(s)).alias("redundant"),
        total("all", lambda s: s == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # a set of k failed filters falls to each of them in 120 / k of the orders
        total("all", own, lambda s: (F.lit(len(ORDERS)) / F.bit_count(s)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Interactions of five filters over documents (doc_id, text, source) and labels.

    A null text is empty, a null source the empty part. Repeated rows count each; a row
    without an id has no labels and neither is nor has an earlier copy. A repeated id in
    labels is good or toxic if any of its rows says so. An empty table has no parts.
    """
    return interactions(flagged(docs, labels))


#: The same report in SQL.
SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS part FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM texts
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body))::INT
    + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * (words.doc_id > min(words.doc_id) OVER (PARTITION BY body))::INT AS fails
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.b | w.b | x.b | y.b | z.b = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1]) AS sofar FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), masks AS (
  SELECT filter_order, step, own, coalesce(sofar, 0)::INT AS earlier FROM steps
)
SELECT part, filter_order, step,
  sum(n * (fails & (own | earlier) = 0)::INT)::BIGINT AS kept,
  sum(n * (fails & own <> 0 AND fails & earlier = 0)::INT)::BIGINT AS removed,
  sum(n * (fails & own <> 0 AND fails & earlier <> 0)::INT)::BIGINT AS redundant,
  sum(n * (fails = own)::INT)::BIGINT AS unique_fails,
  sum(good * (fails & own <> 0 AND fails & earlier = 0)::INT)::BIGINT AS good_lost,
  sum(toxic * (fails & own <> 0 AND fails & earlier = 0)::INT)::BIGINT AS toxic_lost,
  sum(CASE WHEN fails & own <> 0 THEN n * (120 // bit_count(fails::INT)) ELSE 0 END)::BIGINT AS shapley
FROM sets, masks GROUP BY part, filter_order, step
"""
