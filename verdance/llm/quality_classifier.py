"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded in a few dimensions.  Filters of ``WIDTH`` bytes slide over
a document in steps of ``STRIDE``; over each chunk of ``CHUNK`` steps, half of
which the next chunk shares, a filter keeps its largest value.  A document has
the largest and the mean of its chunks' values, and a logistic layer combines
them into one probability.  Chunks cover the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import labelled, tables

DIMS, WIDTH, STRIDE, FILTERS, CHUNK = 4, 12, 3, 16, 128
_HALF = CHUNK // 2


@dataclass
class Model:
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # 2 * FILTERS
    offset: float
    shift: float = 0.0


def _windows(model: Model, data: np.ndarray) -> np.ndarray:
    """The embedded windows of one buffer, one row for each step."""
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    e = model.embed[padded].reshape(-1)
    n = (len(data) + STRIDE - 1) // STRIDE
    return np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIMS), (STRIDE * DIMS * 4, 4))


def _features(values: np.ndarray) -> np.ndarray:
    """Chunk maxima (chunks x FILTERS) of one document."""
    halves = np.maximum.reduceat(values, np.arange(0, len(values), _HALF), axis=0)
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


def _peaks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, value) of each chunk's largest value of each filter, over all chunks of a document."""
    halves = -(-len(values) // _HALF)
    padded = np.full((halves * _HALF, values.shape[1]), -1, np.float32)
    padded[: len(values)] = values
    padded = padded.reshape(halves, _HALF, -1)
    at = padded.argmax(1)
    best = np.take_along_axis(padded, at[:, None], 1)[:, 0]
    at = at + np.arange(halves)[:, None] * _HALF
    if halves == 1:
        return at, best
    first = best[:-1] >= best[1:]
    return np.where(first, at[:-1], at[1:]), np.where(first, best[:-1], best[1:])


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One logit for each document of a slice; windows that reach past a
    document's end see zero bytes there, as at the end of a buffer."""
    out = np.full(len(offsets) - 1, model.offset, np.float64)
    # Documents are laid out with gaps of WIDTH zero bytes, at multiples of STRIDE.
    sizes = np.diff(offsets)
    room = (sizes + WIDTH + STRIDE - 1) // STRIDE * STRIDE
    at = np.concatenate([[0], np.cumsum(room)])
    laid = np.zeros(int(at[-1]), np.uint8)
    move = np.repeat(at[:-1] - offsets[:-1], sizes)
    laid[np.arange(len(data)) + move] = data
    values = np.maximum(_windows(model, laid) @ model.filters + model.bias, 0)
    steps, has = (sizes + STRIDE - 1) // STRIDE, sizes > 0
    for d in np.flatnonzero(has).tolist():
        s = int(at[d]) // STRIDE
        chunks = _features(values[s : s + int(steps[d])])
        out[d] += chunks.max(0) @ model.weight[:FILTERS] + chunks.mean(0) @ model.weight[FILTERS:]
    return out


def probability(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(model, data, offsets) - model.shift, -30, 30)))


def _fit(docs: list[np.ndarray], y: np.ndarray, epochs: int, rng: np.random.Generator) -> Model:
    model = Model(
        rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
        rng.normal(0, 0.2, (WIDTH * DIMS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    dense = [model.embed, model.filters, model.bias, model.weight]
    first, second, step, batch = [np.zeros_like(d) for d in dense], [np.zeros_like(d) for d in dense], 0, 16
    for epoch in range(epochs):
        rate = 0.01 / (1 + epoch)
        order = rng.permutation(len(docs))
        for start in range(0, len(order), batch):
            grads = [np.zeros_like(d) for d in dense]
            offset_grad, own = 0.0, order[start : start + batch]
            for d in own:
                data = docs[d]
                if not len(data):
                    continue
                x = _windows(model, data)
                v = np.maximum(x @ model.filters + model.bias, 0)
                rows, chunks = _peaks(v)
                n = len(chunks)
                top = chunks.argmax(0)
                mean = chunks.mean(0)
                peak = chunks[top, np.arange(FILTERS)]
                z = float(peak @ model.weight[:FILTERS] + mean @ model.weight[FILTERS:] + model.offset)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) / len(own)
                grads[3][:FILTERS] += error * peak
                grads[3][FILTERS:] += error * mean
                offset_grad += error
                back = np.repeat((error * model.weight[FILTERS:] / n)[None], n, 0)
                back[top, np.arange(FILTERS)] += error * model.weight[:FILTERS]
                back *= chunks > 0
                grads[2] += back.sum(0)
                for f in range(FILTERS):
                    grads[1][:, f] += back[:, f] @ x[rows[:, f]]
                push = back[:, :, None, None] * model.filters.T.reshape(FILTERS, WIDTH, DIMS)
                where = rows[:, :, None] * STRIDE + np.arange(WIDTH)
                inside = where < len(data)
                at, push = data[where[inside]], push[inside]
                for k in range(DIMS):
                    grads[0][:, k] += np.bincount(at, push[:, k], 256)
            step += 1
            for j, (d, g) in enumerate(zip(dense, grads)):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                d -= rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
            model.offset -= rate * 10 * offset_grad
    return model


def train(rows: pd.DataFrame, epochs: int = 3, seed: int = 5, threshold: float = 0.3) -> Model:
    """A model from ``rows`` with text and y; calibrated on a quarter of them
    so that ``threshold`` is where it errs least, each label weighing the same.

    Every chunk of every text has its part in each step.  Rows of one label, or
    none, give a model that scores every text as 0."""
    rng = np.random.default_rng(seed)
    docs = [np.frombuffer(t.encode(), np.uint8) for t in rows["text"]]
    y = rows["y"].to_numpy(np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros((256, DIMS), np.float32), np.zeros((WIDTH * DIMS, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), -30.0)
    apart = rng.random(len(y)) < 0.25
    model = _fit([docs[i] for i in np.flatnonzero(~apart)], y[~apart], epochs, rng)
    check = np.flatnonzero(apart)
    z = np.array([logits(model, docs[i], np.array([0, len(docs[i])]))[0] for i in check])
    truth = y[check]
    if len(check) and truth.min() != truth.max():
        order = np.argsort(z, kind="stable")
        z, truth = z[order], truth[order]
        lost = np.concatenate([[0], np.cumsum(truth) / truth.sum()]) + 1 - np.concatenate([[0], np.cumsum(1 - truth) / (1 - truth).sum()])
        edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
        best = np.flatnonzero(lost <= lost.min() + 1e-12)
        k = best[np.argmax((edges[1:] - edges[:-1])[best])]
        model.shift = float((edges[k] + edges[k + 1]) / 2 - np.log(threshold / (1 - threshold)))
    return model


def train_from(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2000, 2000), id_col: str = "doc_id", text_col: str = "text") -> Model:
    model = train(labelled.sample(docs, labels, "quality", per_class, None, id_col, text_col))
    K.release()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row; null and empty texts get the score of no chunk.

    Null ids, repeated rows and empty tables pass through as they are."""
    kinds = dict(docs.dtypes)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.text_slices(batches, limit=K.SLICE_BYTES // 2):
            p = probability(model, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"_id {kinds[id_col]}, score double, predicted int").withColumnRenamed("_id", id_col)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_from(docs, tables.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", tables.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
