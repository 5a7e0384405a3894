"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3, words' edges
included) by falling count.  A document takes the language whose profile its own is
least out of place against: the sum over its n-grams of the distance of ranks, or of
the profile's size where the language's profile lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns, remainder
from lamina.llm.segment import slices

_PAD = np.uint64(0x1FFFFF)  # beyond any code point
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams, three code points of 21 bits each, ascending, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    a = np.zeros(len(points) + 2, np.uint64)
    a[1:-1] = np.where(_letters()[points], points, 0)
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    a = a[keep]
    if len(a) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s1, s2 = np.uint64(21), np.uint64(42)
    one = a[a != 0] | _PAD << s1 | _PAD << s2
    two = a[:-1] | a[1:] << s1 | _PAD << s2
    three = (a[:-2] | a[1:-1] << s1 | a[2:] << s2)[a[1:-1] != 0]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The languages' ranks, as one table over all their n-grams."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.languages = size, sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.uint64))
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -1, np.int64)
        for i, name in enumerate(self.languages):
            at = np.searchsorted(self.keys, np.array(profiles[name], np.uint64))
            self.ranks[i, at] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the share of the greatest distance possible.
        ``und`` and 0 for a text without letters or without any learned language."""
        keys, counts = ngrams(text)
        if not len(keys) or not self.languages:
            return "und", 0.0
        mine = top(keys, counts, self.size)
        at = np.searchsorted(self.keys, mine)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != mine)] = len(self.keys)
        theirs = self.ranks[:, at]
        off = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        best = int(np.argmin(off))
        return self.languages[best], 1.0 - float(off[best]) / (self.size * len(mine))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 5, held: int = 0, size: int = 300, sample: int = 2000) -> Profiles:
    """Profiles from ``sample`` documents at most of each language, those of the smallest
    id hash, with a language and an id whose crc32 mod ``mod`` is not ``held``.  The
    ids are chosen first, without the texts: only those whose hash is under a bound that
    some more than ``sample`` of the language's rows are expected to meet are ordered.
    Counts are summed before the shuffle."""
    check_columns(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    able = rows.where(F.col("__lang").isNotNull() & (remainder("__id", mod) != held))
    sizes = able.groupBy("__lang").agg(F.count(F.lit(1)).alias("__all"))  # a row a language
    share = F.least(F.lit(1.0), (sample * 1.25 + 200) / F.col("__all"))
    near = able.select("__lang", "__id").join(F.broadcast(sizes), "__lang").where(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) <= share * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)), "__id"))
    chosen = near.select("__lang", "__id").distinct().withColumn("__n", rank).where(F.col("__n") <= sample).select("__lang", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            made: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made.setdefault(name, []).append(ngrams(t))
            for name, parts in made.items():
                keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(back, np.concatenate([p[1] for p in parts]).astype(float), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(total)], ["l", "g", "n"])

    counts = able.join(F.broadcast(chosen), ["__lang", "__id"]).select("__text", "__lang").mapInArrow(run, "l string, g long, n long")
    counts = counts.groupBy("l", "g").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("l").orderBy(F.col("n").desc(), "g"))
    best = counts.withColumn("r", order).where(F.col("r") <= size).select("l", "g", "r").collect()
    found: dict[str, list[int]] = {}
    for row in sorted(best, key=lambda x: (x.l, x.r)):
        found.setdefault(row.l, []).append(row.g)
    return Profiles(found, size)


def predict_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 5, held: int = 0, size: int = 300, sample: int = 2000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``.

    Texts that are null, empty or without letters are ``und`` with score 0, and so is
    all if no language can be learned.  Equal distances go to the smaller name.  A null
    id is neither learned from nor held out.  Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, doc_id, text, lang, mod, held, size, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column(2)]  # a text at a time
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(doc_id, mod) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([out.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return out.mapInArrow(run, schema)
