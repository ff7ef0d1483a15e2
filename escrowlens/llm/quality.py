"""Quality classifier by importance resampling (operator 9).

Two generative models over hashed n-grams: the target one from rows that are
labelled good, the raw one from all rows.  N-grams are the character trigrams
of the lower-cased text and its word bigrams, in which a word that repeats the
word before is replaced by a mark, so that repetition is one n-gram and not as
many as there are words.  A row's weight is the log ratio of the two models over
its n-grams, per ``PER_GRAMS`` of them, so that not the length of a text decides;
adding Gumbel noise, drawn from a hash of the id, makes taking the
k largest keys a draw without replacement by those weights.

The k-th largest key is found by histograms that split only the bucket holding
it, never by a sort, and rows are kept by comparing with it.  k is a given share
of the rows or, without one, as many rows as reach the key that best parts good
labels from bad ones, so that good text is not thinned out.

The raw counts cover all rows; the target model is fitted on at most ``FIT_ROWS``
labelled rows.  Either is a vector of ``SLOTS`` sums, whatever the corpus.

Defined results
* a null or empty text has no n-grams and weight 0, the neutral weight;
* rows whose keys are equal (to 1e-6) go together; where the k-th is among
  them, all of them stay;
* labels with a null id or a null quality are ignored; several labels of one id
  count as good only if all are; without good or without bad labels, all
  rows stay;
* repeated rows have equal keys; an empty table gives an empty result; extra
  columns are ignored by ``scored`` and carried by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.chars import code_points, trigram_slots
from escrowlens.llm.common import bounded_batches, staged, whole_row
from escrowlens.llm.shingles import mixed, word_hashes, word_list

TRIGRAM_BITS, BIGRAM_BITS = 16, 12
SLOTS = (1 << TRIGRAM_BITS) + (1 << BIGRAM_BITS)
PER_GRAMS = 100  # weights are log ratios per so many n-grams
SMOOTHING = 1.0
KEY_STEP = 1e-6
FIT_ROWS = 20_000
_LEVELS, _LEVEL_BITS = 5, 10  # keys of up to 50 bits in KEY_STEPs
_MIDDLE = 1 << (_LEVELS * _LEVEL_BITS - 1)  # the key of weight 0
_NATS = 100  # calibration looks at weights from -100 to 100
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def ngram_slots(text: str | None) -> np.ndarray:
    """Slots of all n-grams of a text (with repeats)."""
    if not text:
        return np.empty(0, np.int64)
    low = text.lower()
    grams = trigram_slots(code_points(low), TRIGRAM_BITS)
    words = word_hashes(word_list(low, lower=False))
    if len(words) < 2:
        return grams
    second = np.where(words[1:] == words[:-1], _REPEAT, words[1:])
    first = np.where(words[1:] == words[:-1], _REPEAT, words[:-1])
    pair = mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - BIGRAM_BITS)
    return np.concatenate([grams, pair.astype(np.int64) + (1 << TRIGRAM_BITS)])


def weigh(text: str | None, ratio: np.ndarray) -> tuple[int, float]:
    """Number of n-grams and log weight of a text."""
    found = ngram_slots(text)
    return len(found), float(ratio[found].sum()) * PER_GRAMS / max(1, len(found))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray | None:
    """Log ratio target / raw of every slot; None without good or without bad labels.

    The target model is fitted on at most ``fit_rows`` good labels, those with
    the smallest hash of the id; the raw model counts every row of ``docs``.
    """
    known = labelled(labels)
    ends = known.agg(F.min("good").alias("lo"), F.max("good").alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return None
    sample = (known.filter("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
              .select("doc_id", F.lit(True).alias("target")))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")  # at most fit_rows

    def run(batches):
        sums = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1), strict=True):
                found = ngram_slots(text.as_py())
                np.add.at(sums[0], found, 1)
                if target.as_py():
                    np.add.at(sums[1], found, 1)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])],
            names=["slot", "raw", "target"])

    counts = (rows.select("text", "target").mapInArrow(run, "slot int, raw long, target long")
              .groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
              .toArrow())  # at most SLOTS rows
    table = np.full((2, SLOTS), SMOOTHING)
    for k, name in enumerate(("raw", "target")):
        table[k, counts.column("slot").to_numpy()] += counts.column(name).to_numpy()
    half = 1 << TRIGRAM_BITS  # trigrams and word bigrams are distributions of their own
    log_p = np.concatenate([np.log(t / t.sum(axis=1, keepdims=True))
                            for t in (table[:, :half], table[:, half:])], axis=1)
    return log_p[1] - log_p[0]


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good (1 or 0)."""
    return (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good")))


def gumbel(doc_id: str = "doc_id") -> Column:
    """Standard Gumbel noise from a hash of the id: the same in every run."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    unit = (F.pmod(F.xxhash64(name), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, key (in KEY_STEPs)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # SLOTS numbers

    def run(batches):
        for batch in batches:
            # text by text: the n-grams of a whole batch would be many times its size
            found = [weigh(t.as_py(), shared.value) for t in batch.column(1)]
            weight = np.array([w for _, w in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(weight),
                 pa.array(_key(weight, batch.column(2).to_numpy(zero_copy_only=False)))],
                names=["doc_id", "n_grams", "log_weight", "key"])

    return (docs.select("doc_id", "text", gumbel().alias("_noise"))
            .mapInArrow(run, "doc_id long, n_grams long, log_weight double, key long"))


def _key(weight: np.ndarray, noise: np.ndarray) -> np.ndarray:
    steps = np.floor((weight + noise) / KEY_STEP) + _MIDDLE
    return np.clip(steps, 0, 2 * _MIDDLE - 1).astype(np.int64)


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest ``key`` (0 if there are fewer, above all keys if k is 0);
    at most 1,024 bucket counts come to the driver for each ten bits."""
    if k <= 0:
        return 2 * _MIDDLE
    path, left = 0, k
    for level in range(1, _LEVELS + 1):
        shift = (_LEVELS - level) * _LEVEL_BITS
        inside = keys.filter(F.expr(f"shiftright(key, {shift + _LEVEL_BITS})") == path)
        counts = inside.groupBy(F.expr(f"shiftright(key, {shift})").alias("b")).count().collect()
        for b, n in sorted(((r["b"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                path = b
                break
            left -= n
        else:
            return 0
    return path


def calibrated(keys: DataFrame, labels: DataFrame) -> int:
    """The key that best parts good from bad labels (equal weight to each kind),
    in whole nats; amid several equally good ones, the middle.  A few hundred
    counts come to the driver."""
    nats = F.greatest(F.lit(-_NATS), F.least(F.lit(_NATS), F.floor((F.col("key") - _MIDDLE) * KEY_STEP)))
    rows = (keys.join(labelled(labels), "doc_id").groupBy(nats.cast("int").alias("b"))
            .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect())
    total = np.zeros((2, 2 * _NATS + 2))
    for r in rows:
        total[:, r["b"] + _NATS] = r["good"], r["bad"]
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1)
    lost = np.cumsum(total[0]) - total[0]  # good ones below each cut
    let_in = 1 - (np.cumsum(total[1]) - total[1])  # bad ones at or above it
    error = np.round(lost + let_in, 9)
    best = np.flatnonzero(error == error.min())
    return int(round((best[len(best) // 2] - _NATS) / KEY_STEP)) + _MIDDLE


def resample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
             share: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, selected."""
    _, cut, thin = _model_and_cut(docs, labels, fit_rows, share)
    return thin.select("doc_id", "n_grams", "log_weight", (F.col("key") >= cut).alias("selected"))


def _model_and_cut(docs, labels, fit_rows, share) -> tuple[np.ndarray, int, DataFrame]:
    bounded_batches(docs.sparkSession)
    ratio = fit(docs, labels, fit_rows)
    if ratio is None:
        ratio = np.zeros(SLOTS)
        return ratio, 0, scored(docs, ratio)
    thin = staged(scored(docs, ratio), "quality-scores")
    if share is None:
        k = thin.filter(F.col("key") >= calibrated(thin, labels)).count()
    else:
        k = round(thin.count() * share)
    return ratio, kth_largest(thin, k), thin


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
              share: float | None = None) -> DataFrame:
    """The selected rows of ``docs``, all columns."""
    ratio, cut, _ = _model_and_cut(docs, labels, fit_rows, share)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = docs.columns

    def run(batches):
        for batch in batches:
            weight = np.array([weigh(t.as_py(), shared.value)[1] for t in batch.column(1)])
            key = _key(weight, batch.column(2).to_numpy(zero_copy_only=False))
            kept = batch.column(0).filter(pa.array(key >= cut))
            yield pa.RecordBatch.from_arrays(kept.flatten(), names=names)

    return (docs.select(whole_row(docs).alias("_row"), F.col("text"), gumbel().alias("_noise"))
            .mapInArrow(run, docs.schema))
