"""Quality rules: robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import SPACE_CLASS, bound, split_words, staged

#: Symbols counted by the base rules (fixed values of the contract).
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Share of a group's rows that the estimate rests on; steps taken from every start, and
#: those from the start that is then best.
SUPPORT, FIRST_STEPS, STEPS = 0.5, 2, 4
#: Rows within this quantile of the first estimate make up the final one.
REWEIGHT = 0.975
#: Rows are rejected beyond this squared distance: the chi-square quantile of 4 degrees of
#: freedom at 1 - 1e-9, as tails of text statistics are heavier than those of a normal.
CUTOFF = 47.9
#: Smaller groups are pooled, by language first, then all together.
LEAST_ROWS = 20
#: A direction is degenerate below these deviations (given the statistics before it), and
#: gets them: rates that are zero in nearly all texts do not make one symbol an outlier.
LEAST_SD = (0.03, 0.005, 0.005, 0.01)
#: Estimates are broadcast to rows if there are no more groups than this (some 300 bytes each).
MAX_BROADCAST = 50_000
#: Characters (words) of prior that rates (word lengths) of short texts are drawn to.
PRIOR_CHARS, PRIOR_WORDS = 200.0, 50.0
#: Prior means of: symbols, upper-case letters and punctuation a character; word length.
PRIORS = (0.0, 0.02, 0.03, 5.5)
DIM = 4
#: Bins of statistics and of log distances, a unit, by which quantiles are counted.
VALUE_BINS, DISTANCE_BINS, MOST_BINS = 2000, 200, 2400
STARTS = 3


def _chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, dof // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def _chi2_quantile(share: float) -> float:
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, DIM) < share else (low, mid)
    return low


def _consistency(share: float) -> float:
    """What the covariance of the inner ``share`` of a normal sample is multiplied by."""
    return share / _chi2_cdf(_chi2_quantile(share), DIM + 2)


def repeated_words(words: Column) -> Column:
    """Words of ``words`` that lie in a window of 8 which occurs twice or more.

    Hashes of all windows decide whether any may repeat; only then the windows
    themselves are sorted and equal neighbours found. With the repeated windows' starts
    in order, each start adds the words up to the next one, at most 8.
    """
    size = F.size(words)
    starts = F.when(size >= WINDOW, F.sequence(F.lit(1), size - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))

    def of_sorted(s: Column) -> Column:
        n = F.size(s)

        def repeats(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(s, k - 1)["w"] == x["w"])
            after = (k < n - 1) & (F.get(s, k + 1)["w"] == x["w"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.array_sort(F.transform(F.filter(s, repeats), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.get(p, k + 1) - x, F.lit(WINDOW))).otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), "\n").alias("w"), i.alias("i")))
    exact = bound(bound(F.array_sort(windows), of_sorted), covered)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), exact).otherwise(F.lit(0)).cast("long")


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base counts and transformed statistics of every row; ``keep`` columns stay.

    Statistics x0..x3: arcsine square roots of the rates of symbols, upper-case letters
    and other punctuation a character, and the log of the mean word length, each drawn
    to a prior so that short texts vary no more than long ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, SPACE_CLASS, "") != "")
    counted = docs.select(*keep, text.alias("_text"), split_words(text).alias("_words")).select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).alias("_upper"),
        (F.length("_text") - F.length(F.translate("_text", "!?.,;:-_()[]{}\"'`~^+=@/\\", ""))).alias("_punct"),
    )

    def rate(part: Column, prior: float) -> Column:
        return F.asin(F.sqrt((part + PRIOR_CHARS * prior) / (F.col("word_chars") + PRIOR_CHARS)))

    length = (F.col("word_chars") + PRIOR_WORDS * PRIORS[3]) / (F.col("n_words") + PRIOR_WORDS)
    return counted.withColumns({"x0": rate(F.col("n_symbols"), PRIORS[0]), "x1": rate(F.col("_upper"), PRIORS[1]), "x2": rate(F.col("_punct"), PRIORS[2]), "x3": F.log(length)}).drop("_upper", "_punct")


X = [f"x{i}" for i in range(DIM)]
#: The group of all pairs that are too small for one of their own.
REST = "rest"


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _with_cholesky(groups: DataFrame, keys: list[str]) -> DataFrame:
    """From columns m_i and c_i_j of a covariance: columns l_i_j of its lower factor, and det."""
    out = groups
    for j in range(DIM):
        own = F.col(f"c_{j}_{j}")
        for k in range(j):
            own = own - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(LEAST_SD[j] ** 2))))
        for i in range(j + 1, DIM):
            low = F.col(f"c_{j}_{i}")
            for k in range(j):
                low = low - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", low / F.col(f"l_{j}_{j}"))
    det = F.col("l_0_0")
    for j in range(1, DIM):
        det = det * F.col(f"l_{j}_{j}")
    return out.select(*keys, *(f"m_{i}" for i in range(DIM)), *(f"l_{i}_{j}" for i in range(DIM) for j in range(i + 1)), det.alias("det"))


def _met(rows: DataFrame, groups: DataFrame, on: list[str], small: bool, how: str = "inner") -> DataFrame:
    """Rows with their group's columns; few groups are broadcast, so rows stay where they are."""
    return rows.join(F.broadcast(groups) if small else groups, on, how)


def _distance() -> tuple[list[tuple[str, Column]], Column]:
    """Forward substitution: columns _y0.. in order, and the squared distance over them."""
    steps = []
    for i in range(DIM):
        y = F.col(X[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        steps.append((f"_y{i}", y / F.col(f"l_{i}_{i}")))
    return steps, sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, DIM)), F.col("_y0") * F.col("_y0"))


def _with_distance(met: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance of rows that have met their groups."""
    steps, total = _distance()
    for name, y in steps:
        met = met.withColumn(name, y)
    return met.withColumn("distance", total)


def _within(rows: DataFrame, by: list[str], value: Column, share: float) -> DataFrame:
    """The least bin at which a group's exact bin counts reach a share of its rows."""
    bins = rows.select(*by, value.alias("_bin")).groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_k"))
    order = Window.partitionBy(*by).orderBy("_bin")
    summed = bins.select(*by, "_bin", F.sum("_k").over(order).alias("_upto"), F.sum("_k").over(Window.partitionBy(*by)).alias("_all"))
    return summed.filter(F.col("_upto") >= F.lit(share) * F.col("_all")).groupBy(*by).agg(F.min("_bin").alias("_bin"))


def _moments(inner: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means and scaled covariances of rows, by partial sums."""
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(X)] + [(F.covar_pop(X[i], X[j]) * scale).alias(f"c_{i}_{j}") for i, j in PAIRS]
    return inner.groupBy(*keys).agg(*sums)


def _step(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool, name: str) -> DataFrame:
    """One concentration: estimates of the rows within the bin of distances that reaches SUPPORT."""
    at = F.least(F.floor(F.log1p("distance") * DISTANCE_BINS), F.lit(MOST_BINS)).cast("int")
    measured = _with_distance(_met(rows, groups, ["_group"], small)).select(*keys, *X, at.alias("_at"))
    border = _within(measured, keys, F.col("_at"), SUPPORT).withColumnRenamed("_bin", "_border")
    inner = _met(measured, border, keys, small).filter(F.col("_at") <= F.col("_border"))
    return staged(_with_cholesky(_moments(inner, keys, _consistency(SUPPORT)), keys), name)


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """Three starts a group about its medians: independent statistics with deviations by the
    median absolute one, and with correlations of tanh scores and of spatial signs."""
    values = [F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(X)]
    long = rows.select("_group", F.explode(F.array(*values)).alias("s")).select("_group", "s.i", "s.v")
    centre = lambda c: (F.col(c) + 0.5) / VALUE_BINS
    medians = staged(_within(long, ["_group", "i"], F.floor(F.col("v") * VALUE_BINS).cast("int"), 0.5).select("_group", "i", centre("_bin").alias("median")), "mcd-medians")
    away = F.floor(F.abs(F.col("v") - F.col("median")) * VALUE_BINS).cast("int")
    spread = _within(_met(long, medians, ["_group", "i"], small), ["_group", "i"], away, 0.5)
    floor = F.element_at(F.array(*map(F.lit, LEAST_SD)), F.col("i") + 1)
    sides = medians.join(spread, ["_group", "i"]).select("_group", "i", "median", F.greatest(1.4826 * centre("_bin"), floor).alias("sd"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = staged(sides.groupBy("_group").agg(*(of(i, c).alias(f"{n}_{i}") for i in range(DIM) for n, c in (("m", "median"), ("s", "sd")))), "mcd-scales")
    z = [(F.col(x) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, x in enumerate(X)]
    scored = _met(rows, wide, ["_group"], small).select("_group", *(c.alias(f"z{i}") for i, c in enumerate(z)))
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIM)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    kinds = {1: lambda i: F.tanh(F.col(f"z{i}")), 2: lambda i: F.col(f"z{i}") / norm}
    products = scored.groupBy("_group").agg(*(F.avg(f(i) * f(j)).alias(f"p{k}_{i}_{j}") for k, f in kinds.items() for i, j in PAIRS))

    def correlation(k: int, i: int, j: int) -> Column:
        if k == 0 or i == j:
            return F.lit(1.0 if i == j else 0.0)
        return F.col(f"p{k}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"p{k}_{i}_{i}") * F.col(f"p{k}_{j}_{j}"), F.lit(1e-18)))

    own = [F.struct(F.lit(k).alias("_start"), *((correlation(k, i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in PAIRS)) for k in range(STARTS)]
    both = wide.join(products, "_group").withColumn("_s", F.explode(F.array(*own)))
    return staged(_with_cholesky(both.select("_group", *(f"m_{i}" for i in range(DIM)), "_s.*"), ["_group", "_start"]), "mcd-start")


def robust_groups(rows: DataFrame, small: bool) -> DataFrame:
    """Minimum covariance determinant estimate of every ``_group`` of rows.

    From each of STARTS starts FIRST_STEPS concentrations are made; the one with the least
    determinant goes on for STEPS more. The rows within REWEIGHT of it make up the final
    centre and covariance; both are scaled to be consistent for normal rows. Counts of bins
    and moments are partial sums, so a group of any size is never in one task. Each step's
    estimates (one row a group and start) are written, which cuts the lineage.
    """
    groups, keys = _starts(rows, small), ["_group", "_start"]
    for k in range(FIRST_STEPS):
        groups = _step(rows, groups, keys, small, f"mcd-first{k}")
    rest = [c for c in groups.columns if c not in keys]
    best = groups.groupBy("_group").agg(F.min_by(F.struct(*rest), F.struct("det", "_start")).alias("b"))
    groups = staged(best.select("_group", "b.*"), "mcd-best")
    for k in range(STEPS):
        groups = _step(rows, groups, ["_group"], small, f"mcd-{k}")
    inner = _with_distance(_met(rows, groups, ["_group"], small)).filter(F.col("distance") <= _chi2_quantile(REWEIGHT))
    return staged(_with_cholesky(_moments(inner, ["_group"], _consistency(REWEIGHT)), ["_group"]), "mcd-last")


def _groups_of(rows: DataFrame) -> DataFrame:
    """(_pair, _group, _n): a pair of language and source, or what its rows are pooled with.

    Pairs under LEAST_ROWS are pooled by language, languages that are then still too
    small all together. One row a pair.
    """
    sizes = rows.groupBy("_pair", "_lang").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < LEAST_ROWS
    pooled = F.sum(F.when(small, F.col("_n"))).over(Window.partitionBy("_lang"))
    group = F.when(~small, F.concat(F.lit("p"), "_pair")).when(pooled >= LEAST_ROWS, F.concat(F.lit("l"), "_lang")).otherwise(REST)
    return staged(sizes.select("_pair", group.alias("_group"), "_n"), "quality-groups")


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Base counts, base verdict, robust distance and verdict of every row.

    Groups are pairs of language and source (see _groups_of for small ones); null is a
    value of its own. If the pool of all small ones is itself under LEAST_ROWS, it is
    judged by an estimate of all rows. Estimates rest on rows that pass the base rules.
    base_failed: fewer than 20 words, or more than 30 % of words in repeated windows.
    kept: not base_failed and within CUTOFF of the group's robust estimate. Repetition and
    repeated lines are no part of the vector: clean texts have them, and the base rules
    judge them. Null text counts as empty and fails; repeated rows are judged alike; an
    empty table gives no rows. A kept column named like one of the results is an error.
    """
    keep = keep or ["doc_id"]
    lang, source = (F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in ("lang", "source"))
    rows = staged(text_statistics(docs.withColumn("_lang", lang).withColumn("_pair", F.concat_ws("\x01", lang, source)), [*keep, "_lang", "_pair"]), "quality")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    passed = rows.filter(~F.col("base_failed"))
    pairs = _groups_of(passed)
    facts = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_group") == REST, F.col("_n"))).alias("rest")).first()
    small = facts["n"] <= MAX_BROADCAST
    grouped = lambda table, how: _met(table, pairs.select("_pair", "_group"), ["_pair"], small, how)
    basis = grouped(passed, "inner").select("_group", *X)
    if facts["rest"] and facts["rest"] < LEAST_ROWS:
        basis = basis.filter(F.col("_group") != REST).union(passed.select(F.lit(REST).alias("_group"), *X))
    measured = _with_distance(_met(grouped(rows, "left"), robust_groups(basis, small), ["_group"], small, "left"))
    return measured.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
