"""Language ID: mixtures of languages by expectation-maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import crc_mod

#: Hash bins of byte trigrams, and their additive smoothing.
BINS, SMOOTHING = 1 << 15, 0.5
#: Training texts a language at about which the sample is bounded: a language with more
#: rows gives those whose id hash falls under bound / rows.
SAMPLE_ROWS = 2000
ROUNDS = 8
#: Log-likelihood a further language must add, in units of log(n).
PENALTY = 12.0
SLICE_BYTES = 400_000
#: The model is collected and broadcast: BINS numbers a language, so 64 MB at this many
#: languages. More distinct values than that are refused.
MAX_LANGUAGES = 500


def trigram_bins(text: str) -> np.ndarray:
    """Hash bins of the byte trigrams of the lower-cased text, padded by spaces."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8") + b" ", dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - (BINS.bit_length() - 1))


def learn(docs: DataFrame, row_id: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of bins [BINS, languages].

    Learns from the rows given (null text or language left out) by a bounded sample:
    about SAMPLE_ROWS rows a language. Each task sums what it has of the sample; what the
    driver gets is one row a language and bin.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    sizes = {r["lang"]: r["n"] for r in found}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BINS, 0))
    share = F.element_at(F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, SAMPLE_ROWS / sizes[k]))))), F.col("lang"))
    unit = F.conv(F.substring(F.md5(F.col(row_id).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    sample = rows.filter(F.coalesce(unit, F.lit(0.0)) < share).select("lang", F.col("text").cast("string").alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                own += np.bincount(trigram_bins(text.as_py()), minlength=BINS)
        for lang, own in sums.items():
            bins = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(own[bins])], names=["lang", "bin", "n"])

    totals = np.zeros((BINS, len(langs)))
    summed = sample.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    place = {k: i for i, k in enumerate(langs)}
    totals[summed["bin"].to_numpy(), [place[k] for k in summed["lang"].to_pylist()]] = summed["n"].to_numpy()
    smooth = totals + SMOOTHING
    return langs, np.log(smooth / smooth.sum(axis=0))


def _em(p: np.ndarray, counts: np.ndarray, rows: np.ndarray, starts: np.ndarray, mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [texts, languages] within each text's mask, and log-likelihoods."""
    share = mask / mask.sum(axis=1, keepdims=True)
    n = np.add.reduceat(counts, starts)
    for _ in range(rounds):
        joint = p * share[rows]
        joint *= (counts / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / n[:, None]
    mixed = (p * share[rows]).sum(axis=1)
    return share, np.add.reduceat(counts * np.log(mixed), starts)


def mixtures(texts: list[str], log_p: np.ndarray) -> tuple[list[list[tuple[int, float]]], np.ndarray]:
    """Languages (by index) and proportions of each non-empty text, the largest first; and
    how much likelier each text is under them than under even bins, in nats a trigram.

    EM over all languages orders them; EM within the first 1, 2, .. of that order gives
    likelihoods, and the set with the best one after its penalty stays. A text goes on to k
    languages only if the likelihood with each n-gram's best language, which no mixture
    exceeds, would win after that penalty; this loses nothing.
    """
    n_langs = log_p.shape[1]
    table = np.exp(log_p)
    bins, counts, sizes = [], [], []
    for t in texts:
        c = np.bincount(trigram_bins(t), minlength=BINS)
        found = np.flatnonzero(c)
        bins.append(found)
        counts.append(c[found])
        sizes.append(len(found))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rows = np.repeat(np.arange(len(texts)), sizes)
    p, c = table[np.concatenate(bins)], np.concatenate(counts).astype(float)
    share, _ = _em(p, c, rows, starts, np.ones((len(texts), n_langs)), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    log_n = np.log(np.add.reduceat(c, starts) + 1)
    best = np.full(len(texts), -np.inf)
    chosen, fits = np.zeros((len(texts), n_langs)), np.zeros(len(texts))
    most = np.add.reduceat(c * np.log(p.max(axis=1)), starts)
    for k in range(1, n_langs + 1):
        open_ = most - PENALTY * (k - 1) * log_n > best
        live = np.flatnonzero(open_)
        if not len(live):
            break
        part, own_sizes = open_[rows], np.array(sizes)[live]
        mask = np.zeros((len(live), n_langs))
        np.put_along_axis(mask, order[live, :k], 1.0, axis=1)
        own, fit = _em(p[part], c[part], np.repeat(np.arange(len(live)), own_sizes), np.cumsum(own_sizes) - own_sizes, mask, ROUNDS if k > 1 else 0)
        judged = fit - PENALTY * (k - 1) * log_n[live]
        better = judged > best[live]
        best[live[better]], chosen[live[better]], fits[live[better]] = judged[better], own[better], fit[better]
    out = []
    for own in chosen:
        top = [int(i) for i in np.argsort(-own, kind="stable") if own[i] > 0]
        out.append([(i, float(own[i])) for i in top])
    return out, fits / np.add.reduceat(c, starts) + np.log(BINS)


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score, langs and gain of every row, from its whole text alone.

    lang_pred is the language with the largest proportion of the chosen set, score that
    proportion, langs all of the set with their proportions. gain tells how well they
    explain the text: nats a trigram over even bins, below 0 for what is in none of them.
    Null text, or one without a letter, is ``und`` with score and gain 0, and so is
    everything if nothing was learned.
    """
    keep = keep or ["doc_id"]
    # BINS numbers a learned language; half precision of logs would do, float32 is sent
    shipped = docs.sparkSession.sparkContext.broadcast(log_p.astype(np.float32).tobytes())
    source = docs.select(*keep, F.col("text").cast("string").alias("_lid_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "lang_pred string", "score double", "langs string", "gain double"])
    n_langs = len(langs)

    def run(batches):
        model = np.frombuffer(shipped.value, dtype=np.float32).reshape(BINS, n_langs).astype(float)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            pred, score, sets, gains = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts), [0.0] * len(texts)
            pending: list[tuple[int, str]] = []
            held = 0

            def settle():
                for (i, _), found, gain in zip(pending, *mixtures([t for _, t in pending], model), strict=True):
                    pred[i], score[i], gains[i] = langs[found[0][0]], min(1.0, found[0][1]), float(gain)
                    sets[i] = ",".join(f"{langs[j]}:{v:.3f}" for j, v in found)
                pending.clear()

            for i, value in enumerate(texts):
                text = value.as_py()
                if not n_langs or not text or not any(ch.isalpha() for ch in text):
                    continue
                pending.append((i, text))
                held += len(text)
                if held > SLICE_BYTES:
                    settle()
                    held = 0
            if pending:
                settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string()), pa.array(gains, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score", "langs", "gain"])

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from rows whose crc32(doc_id as text) mod 4 is not 2 and predict all rows."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    langs, log_p = learn(docs.filter(~held_out))
    return predict(docs.withColumn("_lid_held", held_out), langs, log_p, [*(keep or ["doc_id"]), "_lid_held"]).withColumnRenamed("_lid_held", "held_out")
