"""Language ID with spans (operator 7).

Training counts, for every language, hashed character trigrams (one around each
letter, blanks at word ends) and letters by script; both are sums over all
training rows, aggregated in each task before they are shuffled.  The model is a
table of languages x ``2**SLOT_BITS`` log probabilities, so its size does not
depend on the corpus.

Prediction scores each word under each language.  Script ranges narrow the
candidates first: a word's script rules out the languages that use it for less
than ``LEAST_SHARE`` of their letters (unless all do).  Viterbi over the words,
with a penalty for each switch, labels spans; many texts of like length go
through it side by side.  The language of a text is the one whose spans have
most letters; the score is its share of the letters.

Defined results
* a null text or one without a letter is ``und`` with score 0 and no spans, as is
  any text if nothing was learned; marks count as letters in trigrams and shares,
  but a text of marks alone has no letter;
* equal shares go to the first language in code-point order;
* training ignores rows with a null text or language; extra columns are ignored;
* repeated rows count and come out as often as they are given; an empty table
  gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.chars import (SCRIPT_NAMES, code_points, letter_table, mark_table,
                                  script_table, trigram_slots)

SLOT_BITS = 16
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
LEAST_SHARE = 0.001
UNKNOWN = "und"
RULED_OUT = -50.0  # a word's score under a language that lacks its script
SLICE_CHARS = 1_000_000
SIDE_BY_SIDE = 256
GRID_WORDS = 200_000  # texts side by side x words of the longest


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x slots
    uses: np.ndarray  # languages x scripts: share of the letters


def _letter_slots(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the letters, their trigram slots and scripts."""
    codes = code_points(text.lower())
    letters = letter_table()[codes]
    slots = trigram_slots(np.where(letters, codes, 0), SLOT_BITS)
    place = np.flatnonzero(letters)
    return place, slots[place], script_table()[codes[place]]


def fit(rows: DataFrame) -> Model:
    """Model from ``text`` and ``lang`` of all rows."""
    slots, scripts = 1 << SLOT_BITS, len(SCRIPT_NAMES)

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                     pa.array(total[at])], names=["lang", "slot", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                _, found, script = _letter_slots(text.as_py())
                total = sums.setdefault(lang.as_py(), np.zeros(slots + scripts, np.int64))
                np.add.at(total, found, 1)
                np.add.at(total, script.astype(np.int64) + slots, 1)
            if len(sums) > 64:  # bounds a task's memory with very many languages
                yield from flush()
        yield from flush()

    counts = (rows.filter("text is not null and lang is not null").select("text", "lang")
              .mapInArrow(run, "lang string, slot int, n long")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((len(langs), slots + scripts))
    row = np.array([langs.index(x) for x in counts.column("lang").to_pylist()], np.int64)
    table[row, counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    grams, letters = table[:, :slots] + SMOOTHING, table[:, slots:]
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)),
                 letters / np.maximum(letters.sum(axis=1, keepdims=True), 1))


def word_scores(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (words x languages) and letters of each word, and whether not all are marks."""
    n, langs = len(words), len(model.languages)
    text = " ".join(words)
    place, slots, scripts = _letter_slots(text)
    ends = np.cumsum([len(w.lower()) + 1 for w in words])
    owner = np.searchsorted(ends, place, side="right")
    letters = np.bincount(owner, minlength=n)
    marks = mark_table()[code_points(text.lower())[place]]
    real = np.bincount(owner[~marks], minlength=n) > 0
    scores = np.empty((n, langs))
    for k in range(langs):
        scores[:, k] = np.bincount(owner, weights=model.log_p[k, slots], minlength=n)
    first = np.full(n, -1)
    first[owner[::-1]] = scripts[::-1]  # a word's first letter has its script
    fits = np.concatenate([model.uses >= LEAST_SHARE, np.ones((langs, 1), bool)], axis=1).T[first]
    fits |= ~fits.any(axis=1, keepdims=True)
    return np.where(fits, scores, scores + RULED_OUT), letters, real


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """Best language of every word of every text (arrays words x languages)."""
    longest, langs = max(map(len, scores)), scores[0].shape[1]
    grid = np.zeros((longest, len(scores), langs))
    for k, s in enumerate(scores):
        grid[:len(s), k] = s
    size = np.array([len(s) for s in scores])
    each = np.arange(len(scores))
    came = np.empty((longest, len(scores), langs), np.int16)
    best = grid[0]
    stay = np.arange(langs, dtype=np.int16)
    for t in range(1, longest):
        top = best.argmax(axis=1)
        cost = best[each, top] - penalty
        switch = cost[:, None] > best
        came[t] = np.where(switch, top[:, None], stay)
        nxt = np.where(switch, cost[:, None], best) + grid[t]
        best = np.where((t < size)[:, None], nxt, best)  # texts that have ended wait
    path = np.zeros((longest, len(scores)), np.int64)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        path[t] = now
        if t:
            now = np.where(t < size, came[t, each, now], now)
    return [path[:n, k] for k, n in enumerate(size)]


def _side_by_side(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs (first, end) of ascending sizes whose number times their largest stays
    within ``GRID_WORDS``; a text beyond that goes alone."""
    runs, first = [], 0
    for k, n in enumerate(sizes):
        if k > first and (k - first == SIDE_BY_SIDE or (k - first + 1) * n > GRID_WORDS):
            runs.append((first, k))
            first = k
    return [*runs, (first, len(sizes))] if sizes else []


def _labelled(model: Model, texts: list[str | None]) -> list[tuple]:
    """lang_pred, score, spans of each text."""
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    if not model.languages:
        return out
    seen: dict[str, int] = {}
    where = [np.fromiter((seen.setdefault(w, len(seen)) for w in t.split()), np.int64)
             if t else np.empty(0, np.int64) for t in texts]
    if not seen:
        return out
    scores, letters, real = word_scores(model, list(seen))
    todo = sorted((k for k in range(len(texts)) if real[where[k]].any()), key=lambda k: len(where[k]))
    for first, end in _side_by_side([len(where[k]) for k in todo]):
        group = todo[first:end]
        for k, path in zip(group, viterbi([scores[where[k]] for k in group]), strict=True):
            weight = np.bincount(path, weights=letters[where[k]], minlength=len(model.languages))
            top = int(weight.argmax())
            cut = np.flatnonzero(np.diff(path)) + 1
            starts = np.concatenate([[0], cut])
            spans = [{"first_word": int(a), "words": int(b - a), "lang": model.languages[path[a]]}
                     for a, b in zip(starts, np.concatenate([cut, [len(path)]]), strict=True)]
            out[k] = (model.languages[top], float(weight[top] / weight.sum()), spans)
    return out


SPANS = "array<struct<first_word: int, words: int, lang: string>>"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, spans (by words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x slots, whatever the corpus
    kinds = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def made(ids, texts):
        rows = _labelled(shared.value, texts)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.string()),
             pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kinds)],
            names=["doc_id", "lang_pred", "score", "spans"])

    def run(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > SLICE_CHARS:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, lang_pred string, score double, spans {SPANS}")
