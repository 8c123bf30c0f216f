"""Toxicity: a convolutional text classifier over hashed word embeddings.

A text's words (lower-cased runs of letters, digits and bytes over 0x7F) are
hashed to rows of an embedding table, and so are their first ``STEM`` bytes; a
word is the sum of both rows, so inflected and compound forms share what is
learned.  Filters of widths 1, 2 and 3 slide over the words, each filter keeps
its largest value over the whole text, and a logistic layer makes one logit.
Embeddings, filters and weights start at small random values (rows that fewer
than two training texts hold stay 0) and are trained in plain numpy on a
bounded sample; nothing is set from the labels beforehand.

Thresholds are calibrated by language on rows kept apart from the fit.  The
language is guessed from the text's words by a small model, so a score depends
on the text alone; the logit is shifted so that the threshold falls on 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import labelled, tables

WIDTHS = (1, 2, 3)
DIMS, FILTERS = 8, 8
ROWS_LOG2, LANGUAGE_ROWS = 20, 4096
STEM = 6
DROP = 0.2
_STEM_SEED = np.uint64(0xD6E8FEB86659FD93)
_BREAK = np.ones(256, dtype=bool)
_BREAK[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)] = False
_BREAK[0x80:] = False


@dataclass
class Model:
    table: np.ndarray  # rows x DIMS
    filters: dict[int, np.ndarray]  # width -> width x DIMS x FILTERS
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float = 0.0
    languages: list[str] = field(default_factory=list)
    words_by_language: np.ndarray = field(default_factory=lambda: np.zeros((LANGUAGE_ROWS, 1), np.float32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(1))


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word and its stem, and the index of each document's first word."""
    starts, ends, first = K.word_bounds(data, offsets, _BREAK)
    word = K.word_hashes(data, starts, ends)
    stem = K.mix(K.word_hashes(data, starts, np.minimum(ends, starts + STEM)) ^ _STEM_SEED)
    return (np.stack([word, stem], 1) >> K.U64(64 - ROWS_LOG2)).astype(np.int64), first


def _rows_of(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, data, offsets in K.text_slices(iter([pa.record_batch({"text": pa.array(texts, pa.large_string())})])):
        rows, first = word_rows(data, offsets)
        out += [rows[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


def _segment_max(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Largest value of each column over each document's windows; 0 where it has none, or below 0."""
    n = len(first) - 1
    out = np.zeros((n, values.shape[1]), np.float32)
    ends = np.minimum(first[1:] - width + 1, len(values))
    has = np.flatnonzero(ends > first[:-1])
    if len(has):
        cuts = np.stack([first[:-1][has], ends[has]], 1).reshape(-1)
        padded = np.concatenate([values, np.zeros((1, values.shape[1]), np.float32)])
        out[has] = np.maximum.reduceat(padded, cuts, axis=0)[::2]
    return np.maximum(out, 0)


def logits(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    e = model.table[rows[:, 0]] + model.table[rows[:, 1]]
    parts = []
    for w in WIDTHS:
        n = max(0, len(e) - w + 1)
        c = np.broadcast_to(model.bias[w], (n, FILTERS)).astype(np.float32)
        for k in range(w):
            c = c + e[k : k + n] @ model.filters[w][k]
        parts.append(_segment_max(c, first, w))
    return np.concatenate(parts, 1) @ model.weight + model.offset


def guessed_language(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    scores = np.zeros((len(rows) + 1, model.words_by_language.shape[1]), np.float64)
    np.cumsum(model.words_by_language[rows[:, 0] & (LANGUAGE_ROWS - 1)], axis=0, out=scores[1:])
    return np.argmax(scores[first[1:]] - scores[first[:-1]], axis=1)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, first = word_rows(data, offsets)
    shift = model.threshold[guessed_language(model, rows, first)]
    return 1 / (1 + np.exp(-np.clip(logits(model, rows, first) - shift, -30, 30)))


def _pooling(c: np.ndarray, sharp: float | None) -> np.ndarray:
    """The weight of each window in each filter's value: all on the largest, or softmax of ``sharp`` times them."""
    if sharp is None:
        q = np.zeros_like(c)
        q[c.argmax(0), np.arange(c.shape[1])] = 1
        return q
    q = np.exp(sharp * (c - c.max(0)))
    return q / q.sum(0)


def _fit(docs: list[np.ndarray], y: np.ndarray, epochs: int, rng: np.random.Generator) -> Model:
    """Adam on filters and weights, Adagrad on the table.

    While it learns, a filter's value is the softmax-weighted mean of its
    windows, sharper with each epoch, so that all words are tried; the last
    third of the epochs takes the largest value, as scoring does.  A word is
    left out of a text with probability ``DROP``, so that no rare word will do."""
    size = 1 << ROWS_LOG2
    seen = np.zeros(size, np.int64)
    for rows in docs:
        seen[np.unique(rows)] += 1
    known = np.flatnonzero(seen >= 2)
    table = np.zeros((size, DIMS), np.float32)
    table[known] = rng.normal(0, 0.1, (len(known), DIMS))
    filters = {w: rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
    model = Model(table, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32), -1.0)
    model.weight[1::2] *= -1
    dense = [*model.filters.values(), *model.bias.values(), model.weight]
    first_moment, second_moment = [np.zeros_like(d) for d in dense], [np.zeros_like(d) for d in dense]
    squares = np.full(size, 1e-3, np.float32)
    step, batch, soft = 0, 32, max(1, 2 * epochs // 3)
    for epoch in range(epochs):
        sharp = 2.0 * 8.0 ** (epoch / soft) if epoch < soft else None
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(d) for d in dense]
            offset_grad, touched, pushes = 0.0, [], []
            own = order[at : at + batch]
            for d in own:
                rows = docs[d][rng.random(len(docs[d])) >= DROP]
                if not len(rows):
                    continue
                e = model.table[rows[:, 0]] + model.table[rows[:, 1]]
                pooled, weights = np.zeros(len(WIDTHS) * FILTERS, np.float32), []
                for i, w in enumerate(WIDTHS):
                    n = len(e) - w + 1
                    if n < 1:
                        weights.append(None)
                        continue
                    c = sum(e[k : k + n] @ model.filters[w][k] for k in range(w)) + model.bias[w]
                    weights.append(_pooling(c, sharp))
                    pooled[i * FILTERS : (i + 1) * FILTERS] = np.maximum((weights[-1] * c).sum(0), 0)
                z = float(pooled @ model.weight + model.offset)
                error = (1 / (1 + np.exp(-z)) - y[d]) / len(own)
                grads[-1] += error * pooled
                offset_grad += error
                back = error * model.weight * (pooled > 0)
                push = np.zeros_like(e)
                for i, w in enumerate(WIDTHS):
                    if weights[i] is None:
                        continue
                    g = weights[i] * back[i * FILTERS : (i + 1) * FILTERS]
                    grads[len(WIDTHS) + i] += g.sum(0)
                    for k in range(w):
                        grads[i][k] += e[k : k + len(g)].T @ g
                        push[k : k + len(g)] += g @ model.filters[w][k].T
                moved = push.any(1)
                touched += [rows[moved, 0], rows[moved, 1]]
                pushes += [push[moved], push[moved]]
            step += 1
            for j, (d, g) in enumerate(zip(dense, grads)):
                first_moment[j] = 0.9 * first_moment[j] + 0.1 * g
                second_moment[j] = 0.999 * second_moment[j] + 0.001 * g * g
                d -= 0.01 * (first_moment[j] / (1 - 0.9**step)) / (np.sqrt(second_moment[j] / (1 - 0.999**step)) + 1e-8)
            model.offset -= 0.3 * offset_grad
            if touched:
                at_rows, push = np.concatenate(touched), np.concatenate(pushes)
                some = seen[at_rows] >= 2
                uniq, inverse = np.unique(at_rows[some], return_inverse=True)
                total = np.zeros((len(uniq), DIMS), np.float32)
                np.add.at(total, inverse, push[some])
                squares[uniq] += (total * total).sum(1)
                model.table[uniq] -= 0.1 * total / np.sqrt(squares[uniq])[:, None]
    return model


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors; in the middle of the widest such gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + ((1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gaps = edges[1:] - edges[:-1]
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def _nothing_learned() -> Model:
    """Scores every text as 0: with labels of one kind, or none, nothing can be told apart."""
    empty = {w: np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS}
    return Model(np.zeros((1 << ROWS_LOG2, DIMS), np.float32), empty, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(len(WIDTHS) * FILTERS, np.float32), -30.0)


def train(rows: pd.DataFrame, epochs: int | None = None, seed: int = 11, least: int = 20) -> Model:
    """A model from ``rows`` with text, y and lang.

    8 epochs, and up to 24 on fewer rows.  A language with fewer than ``least``
    toxic or clean calibration rows uses the cut of all languages.  Rows of one
    label, or none, give a model that scores every text as 0."""
    rng = np.random.default_rng(seed)
    docs, y = _rows_of(rows["text"].tolist()), rows["y"].to_numpy(np.int64)
    if len(y) == 0 or y.min() == y.max():
        return _nothing_learned()
    epochs = min(24, max(8, 16_000 // len(y))) if epochs is None else epochs
    apart = rng.random(len(y)) < 0.25
    fit = np.flatnonzero(~apart)
    model = _fit([docs[i] for i in fit], y[fit], epochs, rng)
    lang = rows["lang"].fillna("").astype(str).to_numpy()
    model.languages = sorted(set(lang.tolist()))
    counts = np.full((LANGUAGE_ROWS, len(model.languages)), 0.5)
    for own, name in zip(docs, lang):
        counts[:, model.languages.index(name)] += np.bincount(own[:, 0] & (LANGUAGE_ROWS - 1), minlength=LANGUAGE_ROWS)
    model.words_by_language = np.log(counts / counts.sum(0)).astype(np.float32)
    check = np.flatnonzero(apart)
    flat = np.concatenate([docs[i] for i in check]) if len(check) else np.zeros((0, 2), np.int64)
    first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in check])]).astype(np.int64)
    z, guess, truth = logits(model, flat, first), guessed_language(model, flat, first), y[check]
    overall = _best_cut(z, truth) if len(check) and truth.min() != truth.max() else 0.0
    model.threshold = np.full(len(model.languages), overall)
    for k in range(len(model.languages)):
        own = guess == k
        if min((truth[own] == 1).sum(), (truth[own] == 0).sum()) >= least:
            model.threshold[k] = _best_cut(z[own], truth[own])
    return model


def train_from(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (4000, 2500), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = labelled.sample(docs, labels, "toxic", per_class, [lang_col], id_col, text_col)
    model = train(rows.rename(columns={lang_col: "lang"}))
    K.release()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row; null and empty texts get the score of no words.

    Null ids, repeated rows and empty tables pass through as they are.  The
    model is broadcast; its size is fixed by its parameters (about 34 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in K.text_slices(batches):
            p = scores(own, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"_id {kinds[id_col]}, score double, predicted int").withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches 0.5; columns stay as they are.

    One pass and no shuffle: a row's verdict depends on its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in K.text_slices(batches, text_col):
            yield rows.filter(pa.array(scores(own, data, offsets) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_from(docs, tables.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", tables.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
