"""Language identification with a bidirectional gated recurrent network over bytes, trained here in numpy.

Text is cut into segments of a fixed number of bytes. In each direction a gated recurrent unit reads the segment; the
two states at a position give the probabilities of each language there, so every byte gets a label, and a document's
probabilities are the mean over its bytes. Training is back-propagation through time with Adam, on a bounded sample of
labelled rows (``ROWS_PER_LABEL`` per language, ``SAMPLE_CHARS`` characters of each); prediction reads every whole text.

Gates use the hard sigmoid clip(x / 5 + 1/2, 0, 1), in training and prediction alike.

Nulls and ties: a text that is null or has no letter is ``und`` with score 0; equal probabilities go to the first
language in alphabetical order; without any labelled row everything is ``und``. Repeated rows are predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import free_name
from gleanery.llm.common import blocks, text_bytes

UNKNOWN = "und"
ROWS_PER_LABEL = 400
SAMPLE_CHARS = 512
SEGMENT = 64
HIDDEN = 8
STEPS = 260
BATCH = 128
COLUMNS = 4096  # segments that prediction advances together
HELD_OUT = 2


@dataclass
class Model:
    labels: list[str]
    weights: dict[str, np.ndarray]  # per direction W* (3H x 256), U* (3H x H), c* (3H); V* (labels x H); bias


def initial(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"bias": np.zeros((len(labels), 1))}
    for d in "fb":
        w["W" + d] = rng.normal(0, 0.3, (3 * hidden, 256))
        w["U" + d] = rng.normal(0, 0.5 / hidden**0.5, (3 * hidden, hidden))
        w["c" + d] = np.concatenate([np.ones(hidden), np.zeros(2 * hidden)])[:, None]
        w["V" + d] = rng.normal(0, 0.3, (len(labels), hidden))
    return Model(labels, w)


def _states(w: dict, d: str, x: np.ndarray, live: np.ndarray):
    """States of one direction over bytes x (T x B); where ``live`` is 0 the state is 0. Keeps what the gradient needs."""
    steps, width = x.shape
    hidden = w["U" + d].shape[1]
    h, kept = np.zeros((hidden, width)), [None] * steps
    for t in range(steps) if d == "f" else reversed(range(steps)):
        a = w["U" + d] @ h
        i = w["W" + d][:, x[t]] + w["c" + d]
        zr_in = (i[:2 * hidden] + a[:2 * hidden]) * 0.2 + 0.5
        zr = np.clip(zr_in, 0, 1)
        z, r = zr[:hidden], zr[hidden:]
        n = np.tanh(i[2 * hidden:] + r * a[2 * hidden:])
        new = (n + z * (h - n)) * live[t]
        kept[t] = (h, a, z, r, n, (zr_in > 0) & (zr_in < 1), new)
        h = new
    return kept


def loss_and_gradient(model: Model, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over live positions and its gradient, by back-propagation through time in both directions."""
    w = model.weights
    kept = {d: _states(w, d, x, live) for d in "fb"}
    total = live.sum()
    g = {k: np.zeros_like(v) for k, v in w.items()}
    steps, loss = len(x), 0.0
    d_logits = [None] * steps
    for t in range(steps):
        logits = sum(w["V" + d] @ kept[d][t][6] for d in "fb") + w["bias"]
        logits -= logits.max(axis=0)
        p = np.exp(logits)
        p /= p.sum(axis=0)
        loss -= (np.log(p[y, np.arange(len(y))]) * live[t]).sum() / total
        p[y, np.arange(len(y))] -= 1
        d_logits[t] = p * live[t] / total
        g["bias"] += d_logits[t].sum(axis=1, keepdims=True)
        for d in "fb":
            g["V" + d] += d_logits[t] @ kept[d][t][6].T
    hidden = w["Uf"].shape[1]
    for d in "fb":
        dh = np.zeros((hidden, x.shape[1]))
        for t in reversed(range(steps)) if d == "f" else range(steps):
            h, a, z, r, n, open_, _ = kept[d][t]
            dh = (dh + w["V" + d].T @ d_logits[t]) * live[t]
            dn = dh * (1 - z) * (1 - n * n)
            dzr = np.concatenate([dh * (h - n), dn * a[2 * hidden:]]) * open_ * 0.2
            da = np.concatenate([dzr, dn * r])
            di = np.concatenate([dzr, dn])
            g["U" + d] += da @ h.T
            g["c" + d] += di.sum(axis=1, keepdims=True)
            np.add.at(g["W" + d].T, x[t], di.T)
            dh = dh * z + w["U" + d].T @ da
    return loss, g


def segments(data: np.ndarray, offsets: np.ndarray, length: int = SEGMENT):
    """Start, size and row of every segment of the texts."""
    sizes = np.diff(offsets)
    each = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[:-1][row] + nth * length
    return start, np.minimum(length, offsets[1:][row] - start), row


def train(texts: list[str], labels: list[str], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, seed: int = 7) -> Model:
    """A model fitted to labelled texts; the same rows give the same model."""
    names = sorted(set(labels))
    model = initial(names, hidden, seed)
    if not names:
        return model
    rows = pa.array(texts, pa.string())
    data, offsets = text_bytes(rows)
    start, size, row = segments(data, offsets)
    target = np.searchsorted(np.array(names), np.array(labels))[row]
    by_label = [np.flatnonzero(target == k) for k in range(len(names))]
    by_label = [(k, v) for k, v in enumerate(by_label) if len(v)]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    padded = np.append(data, np.zeros(SEGMENT, np.uint8))
    for step in range(1, steps + 1):
        which = [by_label[j] for j in rng.integers(0, len(by_label), batch)]
        pick = np.array([v[rng.integers(len(v))] for _, v in which])
        at = start[pick] + np.arange(SEGMENT)[:, None]
        live = (np.arange(SEGMENT)[:, None] < size[pick]).astype(float)
        _, g = loss_and_gradient(model, padded[at], live, target[pick])
        rate = 0.03 * (1 - step / (steps + 1)) + 0.001
        for k, v in model.weights.items():
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] ** 2 - second[k])
            v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _prepared(model: Model) -> dict:
    """Single-precision weights with the gates' slope and offset folded in."""
    w, out = model.weights, {"bias": model.weights["bias"].astype(np.float32)}
    hidden = w["Uf"].shape[1]
    slope = np.concatenate([np.full(2 * hidden, 0.2), np.ones(hidden)])[:, None]
    offset = np.concatenate([np.full(2 * hidden, 0.5), np.zeros(hidden)])[:, None]
    for d in "fb":
        out["W" + d] = np.ascontiguousarray((w["W" + d] + w["c" + d]) * slope + offset, np.float32)
        out["U" + d] = np.ascontiguousarray(w["U" + d] * slope, np.float32)
        out["V" + d] = np.ascontiguousarray(w["V" + d], np.float32)
    return out


def _position_logits(w: dict, x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Logits (T x labels x B) of bytes x (T x B); columns are ordered so that the first live[t] are alive at step t."""
    steps, width = x.shape
    hidden = w["Uf"].shape[1]
    out = np.empty((steps, len(w["bias"]), width), np.float32)
    out[:] = w["bias"]
    i, a = np.empty((3 * hidden, width), np.float32), np.empty((3 * hidden, width), np.float32)
    for d in "fb":
        h = np.zeros((hidden, width), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            m = int(live[t])
            if not m:
                continue
            whole = m == width
            it, at = (i, a) if whole else (np.empty((3 * hidden, m), np.float32), np.empty((3 * hidden, m), np.float32))
            ht = h if whole else np.ascontiguousarray(h[:, :m])
            np.take(w["W" + d], x[t, :m], axis=1, out=it, mode="clip")
            np.matmul(w["U" + d], ht, out=at)
            zr, n = it[:2 * hidden], it[2 * hidden:]
            zr += at[:2 * hidden]
            np.clip(zr, 0, 1, out=zr)
            at[2 * hidden:] *= zr[hidden:]
            n += at[2 * hidden:]
            np.tanh(n, out=n)
            ht -= n
            ht *= zr[:hidden]
            ht += n
            if not whole:
                h[:, :m] = ht
            out[t, :, :m] += w["V" + d] @ ht
    return out


def position_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray, columns: int = COLUMNS):
    """(segment starts, sizes, rows, probabilities T x labels x B) for groups of segments, until all bytes are labelled."""
    w = _prepared(model)
    start, size, row = segments(data, offsets)
    order = np.argsort(-size, kind="stable")
    padded = np.append(data, np.zeros(SEGMENT, np.uint8))
    for k in range(0, len(order), columns):
        pick = order[k:k + columns]
        steps = int(size[pick[0]])
        x = padded[start[pick] + np.arange(steps)[:, None]]
        live = (np.arange(steps)[:, None] < size[pick]).sum(axis=1)
        p = _position_logits(w, x, live)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        yield start[pick], size[pick], row[pick], p


def label_positions(model: Model, text: str) -> list[str]:
    """The language of every byte of one text."""
    data, offsets = text_bytes(pa.array([text]))
    found = np.zeros(len(data), np.int64)
    for start, size, _, p in position_probabilities(model, data, offsets):
        best = p.argmax(axis=1)
        for j, (s, n) in enumerate(zip(start, size)):
            found[s:s + n] = best[:n, j]
    return [model.labels[k] for k in found]


def document_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of the bytes of each text (texts x labels); zero for an empty text."""
    pooled = np.zeros((len(offsets) - 1, len(model.labels)))
    for _, size, row, p in position_probabilities(model, data, offsets):
        p *= np.arange(len(p))[:, None, None] < size
        sums = p.sum(axis=0, dtype=np.float64)
        for k in range(len(model.labels)):
            pooled[:, k] += np.bincount(row, sums[k], len(pooled))
    return pooled / np.maximum(np.diff(offsets), 1)[:, None]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(labelled: DataFrame, rows_per_label: int = ROWS_PER_LABEL, sample_chars: int = SAMPLE_CHARS, **options) -> Model:
    """Train on at most ``rows_per_label`` rows of each language of (text, lang), chosen by a hash of the text.

    The labels are few and the sample's size is fixed by the parameters, so it is trained on the driver.
    """
    h = F.xxhash64("text")
    part = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    room = F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1
    part = part.select("lang", h.alias("h"), F.substring(F.col("text"), (F.pmod(h, room) + 1).cast("int"), F.lit(sample_chars)).alias("text"))
    ranked = part.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    rows = sorted((r["lang"], r["text"]) for r in ranked.where(F.col("n") <= rows_per_label).collect())
    return train([t for _, t in rows], [lang for lang, _ in rows], **options)


def predict(documents: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` (any columns with text) with two more columns, by default lang_pred and score.

    A column of ``documents`` that has one of these names is replaced; all others pass through. A model without labels
    answers ``und`` for every row.
    """
    columns = [c for c in documents.columns if c.lower() not in (lang_pred.lower(), score.lower())]
    lettered = free_name(documents, "_letters")
    source = documents.withColumn(lettered, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([*(documents.schema[c] for c in columns), T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def label(batches):
        names = np.array([*model.labels, UNKNOWN], object)
        for part in blocks(batches):
            letters = part.column(lettered).to_numpy(zero_copy_only=False)
            if model.labels:
                p = document_probabilities(model, *text_bytes(part.column("text")))
                best, sure = p.argmax(axis=1), p.max(axis=1)
            else:
                best, sure = np.zeros(len(letters), int), np.zeros(len(letters))
                letters = np.zeros(len(letters), bool)
            best, sure = np.where(letters, best, len(names) - 1), np.where(letters, np.clip(sure, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(names[best], pa.string()), pa.array(sure)],
                                             names=schema.names)

    return source.mapInArrow(label, schema)


def identified(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rows that are not held out."""
    known = documents.where(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang")
    model = fit(known, **options)
    found = predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
