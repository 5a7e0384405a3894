"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad.  A line's features are measures of its own text
and of the lines before and after; the chain adds start and transition weights.
Trained by maximum likelihood on documents whose lines all bear the document's label.
A document's quality is the mean of its lines' forward-backward marginals, weighted
by line length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns, materialize, remainder
from lamina.llm.segment import slices

#: Classes of a text's bytes: Upper and lower letters (all beyond ASCII count as
#: lower), Digits, Signs, white space.
_CLASS = bytes(
    85 if 65 <= b <= 90 else 76 if 97 <= b <= 122 or b >= 128 else 68 if 48 <= b <= 57 else 32 if b in b" \t\n\r\v\f" else 83
    for b in range(256)
)
N_OWN = 14


def line_measures(line: str) -> tuple[list[float], int]:
    """The measures of one line and its length in bytes (1 at least)."""
    kinds = line.encode().translate(_CLASS)
    words = line.split()
    n, k = len(kinds), len(words)
    if not k:
        return [1.0] + [0.0] * (N_OWN - 1), 1
    upper, lower, digit, sign = kinds.count(b"U"), kinds.count(b"L"), kinds.count(b"D"), kinds.count(b"S")
    letters = upper + lower
    ends = kinds.count(b"SS ") + kinds.endswith(b"SS")
    bare = sum(1 for w in kinds.split() if b"L" not in w and b"U" not in w)
    return [
        0.0,
        math.log1p(n),
        math.log1p(k),
        sign / n,
        digit / n,
        upper / letters if letters else 0.0,
        letters / k / 10,
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        bare / k,
        ends / k,
        float(line.rstrip()[-1:] in ".!?"),
        float(kinds.lstrip()[:1] == b"U"),
        math.log1p(k / len(set(words))),
    ], n


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x 3 N_OWN + 2: own, previous, next, at the start, at the end) and
    line lengths.  A null or empty text is one empty line."""
    rows, sizes = zip(*map(line_measures, (text or "").split("\n")))
    own = np.array(rows, np.float32)
    t = len(own)
    out = np.zeros((t, 3 * N_OWN + 2), np.float32)
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
    out[0, -2] = out[-1, -1] = 1
    return out, np.array(sizes, np.float64)


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per-document score vectors as one array (documents x lines) and the lengths."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(initial=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def forward_backward(score: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 (documents x lines), expected transitions (2 x 2, summed) and
    log partition of each document.  score: what label 1 has over label 0 at a line."""
    d, t = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    alpha, beta = np.zeros((t, d, 2)), np.zeros((t, d, 2))
    alpha[0] = start + emit[:, 0]
    for i in range(1, t):
        new = np.logaddexp(alpha[i - 1][:, :1] + step[0], alpha[i - 1][:, 1:] + step[1]) + emit[:, i]
        alpha[i] = np.where((i < lengths)[:, None], new, alpha[i - 1])
    z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    for i in range(t - 2, -1, -1):
        after = emit[:, i + 1] + beta[i + 1]
        new = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
        beta[i] = np.where((i + 1 < lengths)[:, None], new, 0.0)
    both = np.exp(alpha + beta - z[None, :, None])
    moves = np.zeros((2, 2))
    for i in range(t - 1):
        live = i + 1 < lengths
        if live.any():
            after = emit[live, i + 1] + beta[i + 1][live]
            moves += np.exp(alpha[i][live][:, :, None] + step + after[:, None, :] - z[live][:, None, None]).sum(axis=0)
    return both[:, :, 1].T, moves, z


def _groups(lengths: list[int], most: int = 256, area: int = 200_000) -> Iterator[range]:
    """Ranges of documents, given by ascending length, whose padded array stays small: a
    very long document is a group of its own."""
    start = 0
    for i in range(1, len(lengths) + 1):
        if i == len(lengths) or i - start == most or (i + 1 - start) * lengths[i] > area:
            yield range(start, i)
            start = i


class LineCRF:
    """Weights, and the mean and spread that features are scaled by."""

    def __init__(self, size: int = 3 * N_OWN + 2):
        self.mean, self.spread = np.zeros(size), np.ones(size)
        self.weights, self.bias = np.zeros(size), 0.0
        self.start, self.step = np.zeros(2), np.zeros((2, 2))

    def fit(self, docs: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> LineCRF:
        """Gradient ascent with running moments on the mean log-likelihood of a line,
        less ``ridge`` times the squared weights."""
        if not docs:
            return self
        order = np.argsort([len(d) for d in docs], kind="stable")
        docs, y = [docs[i] for i in order], np.array([labels[i] for i in order], float)
        x = np.concatenate(docs).astype(np.float64)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.spread
        ends = np.cumsum([len(d) for d in docs])
        starts = ends - [len(d) for d in docs]
        per_line = np.repeat(y, ends - starts)
        groups = list(_groups([len(d) for d in docs], 500))
        p = np.zeros(x.shape[1] + 1 + 2 + 4)
        m, v = np.zeros_like(p), np.zeros_like(p)
        k = x.shape[1]
        same = np.array([[sum(((ends - starts) - 1)[y == 0]), 0], [0, sum(((ends - starts) - 1)[y == 1])]], float)
        first = np.array([np.sum(y == 0), np.sum(y == 1)], float)
        for r in range(1, rounds + 1):
            score = x @ p[:k] + p[k]
            start, step = p[k + 1 : k + 3], p[k + 3 :].reshape(2, 2)
            marginal = np.empty(len(x))
            moves, starting = np.zeros((2, 2)), np.zeros(2)
            for g in groups:
                padded, lengths = _pad([score[starts[i] : ends[i]] for i in g])
                one, mv, _ = forward_backward(padded, lengths, start, step)
                moves += mv
                starting += [np.sum(1 - one[:, 0]), np.sum(one[:, 0])]
                for row, i in zip(one, g):
                    marginal[starts[i] : ends[i]] = row[: ends[i] - starts[i]]
            off = per_line - marginal
            grad = np.concatenate((x.T @ off, [off.sum()], first - starting, (same - moves).ravel())) / len(x) - 2 * ridge * p
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            p = p + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        self.weights, self.bias = p[:k], float(p[k])
        self.start, self.step = p[k + 1 : k + 3], p[k + 3 :].reshape(2, 2)
        return self

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """The length-weighted mean marginal of each text, 0 to 1."""
        out = np.empty(len(texts))
        made = [document_features(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: len(made[i][1]))
        w = (self.weights / self.spread).astype(np.float64)
        base = self.bias - float(self.mean @ w)
        for g in _groups([len(made[i][1]) for i in order]):
            group = [order[k] for k in g]
            padded, lengths = _pad([made[i][0] @ w + base for i in group])
            one, _, _ = forward_backward(padded, lengths, self.start, self.step)
            for row, i in zip(one, group):
                size = made[i][1]
                out[i] = float(row[: len(size)] @ size / size.sum())
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", mod: int = 4, held: int = 2, sample: int = 4000, most_lines: int = 200_000) -> LineCRF:
    """Fit on ``sample`` labelled rows at most, those of the smallest id hash, among ids
    whose crc32 mod ``mod`` is not ``held``, and of these, in that order, on as many as have
    ``most_lines`` lines together (a longer document than there is room for is passed
    over), which bounds what the driver gets.  Rows with a null id or label are not
    learned from; an id labelled twice counts twice.  Lines' features are made on the
    executors."""
    check_columns(docs, doc_id, text)
    check_columns(labels, label_id, label)
    order = F.xxhash64("__id")
    chosen = (
        labels.select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(F.col("__label").isin(0, 1) & (remainder("__id", mod) != held))
        .orderBy(order, "__label")
        .limit(sample)
    )
    chosen = materialize(chosen, "chosen")
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    lines = F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1
    sizes = rows.groupBy("__id", "__label").agg(F.sum(F.coalesce(lines, F.lit(1))).alias("n")).orderBy(order, "__label").collect()  # sample rows
    room, fit = most_lines, set()
    for r in sizes:
        if r.n <= room:
            fit.add((r[0], r[1]))
            room -= r.n
    kept = docs.sparkSession.createDataFrame(sorted(fit, key=str), chosen.schema)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen.join(F.broadcast(kept), ["__id", "__label"], "left_semi")), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_features(t.as_py())[0].tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], ["x", "y"])

    got = rows.select("__text", "__label").mapInArrow(run, "x binary, y int").toArrow().to_pylist()
    got.sort(key=lambda r: (r["x"], r["y"]))
    width = 3 * N_OWN + 2
    return LineCRF().fit([np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in got], [r["y"] for r in got])


def with_quality(docs: DataFrame, model: LineCRF, text: str = "text", name: str = "score", least: float | None = None) -> DataFrame:
    """All columns of ``docs`` and the score (no column if ``name`` is empty; one of that name
    gives way to it), in one pass without a shuffle; with ``least``, only rows that score
    so much.  A null or empty text is scored as one empty line."""
    docs = docs.drop(name) if name in docs.columns and name != text else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    fields = [T.StructField(i, docs.schema[n].dataType) for i, n in zip(inner, names)]
    schema = T.StructType([*fields, T.StructField("__score", T.DoubleType())])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                score = pa.array(shared.value.quality(part.column(at).to_pylist()))
                out = pa.RecordBatch.from_arrays([*part.columns, score], schema.names)
                yield out if least is None else out.filter(pc.greater_equal(score, least))

    scored = docs.toDF(*inner).mapInArrow(run, schema)
    return scored.toDF(*names, name) if name else scored.drop("__score").toDF(*names)


def document_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.7, mod: int = 4, held: int = 2, sample: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    A null or empty text is scored as one empty line.  A null id is never learned from
    and not held out.  Without usable labels every score is 0.5.  Repeated rows score
    alike.  Other columns are not looked at.
    """
    model = train(docs, labels, doc_id, text, mod=mod, held=held, sample=sample)
    scored = with_quality(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
