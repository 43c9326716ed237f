"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes. Over each, one recurrent layer
runs forwards and one backwards; from both states every byte gets a probability
for each language. A document's probabilities are the mean over all its bytes,
whatever its length. Many segments advance in step, so that numpy works on
matrices. The network is trained on the driver by backpropagation through time,
with Adam, on segments of a bounded sample (``sample`` texts of each language, of
a longer text ``TEXT_SEGMENTS`` segments at even distances: documented parameters)
of labelled documents outside the fold. All languages of the labels are learned;
over ``samples.MOST_LABELS`` are an error. The weights are a few thousand numbers,
which are broadcast.

Special cases: a text that is null or has no letters is ``und`` with score 0;
without any labelled row all are ``und``; ties go to the first language in
alphabetic order; texts of any length are read whole when they are judged; a row
that is repeated is learned once and gets a row each time; a null id is held out;
an empty table gives an empty result; extra columns, whatever their names, are
kept if named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from . import text as T
from .blocks import lean

SEGMENT = 64
HIDDEN = 12
SAMPLE = 400
STEPS = 300
BATCH = 128
#: Segments of one text in the sample, and of all of a language's that training may draw from.
TEXT_SEGMENTS, SEGMENTS = 64, 6000
SLICE_BYTES = 1 << 20
ASCII_LETTERS = T.byte_set((0x41, 0x5A), (0x61, 0x7A))


def initial(n_langs: int, rng: np.random.RandomState) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32)
    p["w"] = rng.normal(0, 0.3, (2 * HIDDEN, n_langs)).astype(np.float32)
    p["c"] = np.zeros(n_langs, np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_layer(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, segment, hidden) of one direction for bytes x (time, segment)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape, HIDDEN), np.float32)
    k = HIDDEN
    for t in range(len(x)):
        a, b = table[x[t]], h @ u
        gates = sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
        if keep is not None:
            keep.append((h, z, r, n, b[:, 2 * k :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def layer_gradient(x: np.ndarray, u: np.ndarray, kept: list, grad_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the byte table and the recurrent weights."""
    k = HIDDEN
    g_table = np.zeros((256, 3 * k), np.float32)
    g_u = np.zeros_like(u)
    g_h = np.zeros((x.shape[1], k), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, bn = kept[t]
        g_h = g_h + grad_out[t]
        g_n = g_h * (1 - z) * (1 - n * n)
        g_z = g_h * (h - n) * z * (1 - z)
        g_r = g_n * bn * r * (1 - r)
        g_a = np.concatenate((g_z, g_r, g_n), 1)
        g_b = np.concatenate((g_z, g_r, g_n * r), 1)
        np.add.at(g_table, x[t], g_a)
        g_u += h.T @ g_b
        g_h = g_h * z + g_b @ u.T
    return g_table, g_u


def position_probabilities(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(time, segment, language)"""
    both = np.concatenate((run_layer(x, p["xf"], p["uf"]), run_layer(x[::-1], p["xb"], p["ub"])[::-1]), 2)
    e = np.exp(both @ p["w"] + p["c"])
    return e / e.sum(2, keepdims=True)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all labelled positions, and its gradients."""
    kept_f: list = []
    kept_b: list = []
    both = np.concatenate((run_layer(x, p["xf"], p["uf"], kept_f), run_layer(x[::-1], p["xb"], p["ub"], kept_b)[::-1]), 2)
    logits = both @ p["w"] + p["c"]
    logits -= logits.max(2, keepdims=True)
    e = np.exp(logits)
    prob = e / e.sum(2, keepdims=True)
    n = mask.sum()
    loss = -float((np.log(prob[:, np.arange(len(y)), y] + 1e-9) * mask).sum() / n)
    prob[:, np.arange(len(y)), y] -= 1
    delta = (prob * (mask / n)[:, :, None]).astype(np.float32)
    flat = delta.reshape(-1, delta.shape[2])
    g = {"w": both.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0)}
    back = delta @ p["w"].T
    g["xf"], g["uf"] = layer_gradient(x, p["uf"], kept_f, back[:, :, :HIDDEN])
    g["xb"], g["ub"] = layer_gradient(x[::-1], p["ub"], kept_b, back[::-1, :, HIDDEN:])
    return loss, g


def segments(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, bytes, document) of each segment; the last of a document may have fewer bytes than others."""
    size = np.diff(off)
    per = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = off[doc] + nth * SEGMENT
    return start, np.minimum(off[doc + 1] - start, SEGMENT), doc


def bytes_of(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (time, segment), used (time, segment)); short segments are padded by blanks."""
    at = start[None, :] + np.arange(SEGMENT)[:, None]
    used = np.arange(SEGMENT)[:, None] < n[None, :]
    return np.where(used, raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else 0, T.SPACE).astype(np.uint8), used


def train(rows: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> tuple[list[str], dict[str, np.ndarray]]:
    langs = sorted({r[0] for r in rows})
    rng = np.random.RandomState(seed)
    xs, ms, ys = [], [], []
    for k, lang in enumerate(langs):
        raw, off, _ = T.buffers(pa.array([t for v, t in rows if v == lang], pa.large_binary()))
        start, n, _ = segments(off)
        pick = rng.permutation(len(start))[:SEGMENTS]
        x, used = bytes_of(raw, start[pick], n[pick])
        xs.append(x)
        ms.append(used)
        ys.append(np.full(len(pick), k))
    x, mask = np.concatenate(xs, 1), np.concatenate(ms, 1).astype(np.float32)
    by = [len(y) for y in ys]
    base = np.cumsum([0, *by[:-1]])
    p = initial(len(langs), rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    live = [k for k in range(len(langs)) if by[k]]
    for t in range(1, steps + 1 if len(live) > 1 else 1):
        y = rng.choice(live, BATCH)
        pick = base[y] + (rng.rand(BATCH) * np.array(by)[y]).astype(int)
        _, g = gradients(p, x[:, pick], y, mask[:, pick])
        rate = 0.02 * (1 - t / (steps + 1)) + 1e-3
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return langs, p


def document_probabilities(p: dict[str, np.ndarray], raw: np.ndarray, off: np.ndarray, step: int = 2048) -> np.ndarray:
    start, n, doc = segments(off)
    sums = np.zeros((len(off) - 1, len(p["c"])))
    for at in range(0, len(start), step):
        x, used = bytes_of(raw, start[at : at + step], n[at : at + step])
        prob = (position_probabilities(p, x) * used[:, :, None]).sum(0)
        for k in range(prob.shape[1]):
            sums[:, k] += np.bincount(doc[at : at + step], prob[:, k], minlength=len(sums))
    return sums / np.maximum(np.diff(off), 1)[:, None]


def has_letters(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """By ASCII letters first; only texts without one are looked at by character."""
    out = np.zeros(len(off) - 1, bool)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.logical_or.reduceat(ASCII_LETTERS[raw], off[some])
    for k in np.flatnonzero(~out).tolist():
        out[k] = any(map(str.isalpha, raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, rest: int = 1, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) and the columns ``carry``, learned from labelled rows outside the fold."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    known = known.filter("text is not null and label is not null").filter(samples.out_of_fold("id", modulus, rest))
    rows = samples.per_class(known, "label", sample, SEGMENT, TEXT_SEGMENTS)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows) if rows else ([], {}))
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *carry)
    out = inner.drop("_text").schema.add("_lang", "string").add("_score", "double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = shared.value
        for batch in batches:
            for part in T.slices(batch, "_text", SLICE_BYTES):
                raw, off, _ = T.buffers(part.column("_text"))
                rest_ = part.drop_columns(["_text"])
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if langs:
                    prob = document_probabilities(p, raw, off)
                    ok = has_letters(raw, off)
                    lang[ok] = np.array(langs, object)[prob.argmax(1)[ok]]
                    score[ok] = np.clip(prob.max(1)[ok], 0, 1)
                yield pa.RecordBatch.from_arrays([*rest_.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*rest_.schema.names, "_lang", "_score"])

    got = inner.mapInArrow(run, out)
    held = F.coalesce(~samples.out_of_fold("_id", modulus, rest), F.lit(True))
    return got.select(F.col("_id").alias("doc_id"), held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), *[c for c in carry if c != "doc_id"])
