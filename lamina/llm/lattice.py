"""Language-model scores from a subword lattice.

A word's probability is its marginal over all segmentations into vocabulary pieces, by a
log-space forward recursion over the lattice of the pieces' occurrences, weighted by the
vocabulary's scores, re-estimated once by forward and backward recursion over the words
learned from.  Whole words that were learned are further arcs of the same lattice, from
a word's beginning to its end: one with the word's share in a language, one with its
share in all languages, so that unseen words keep the subword paths.  A document's words
are drawn from a distribution of its own, spread around the lattice's (a Dirichlet one of
weight ``spread``), so a word it has used comes again more easily; that distribution and
the language are summed out.  A text needs no language label to be scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.common import check_columns, discard, materialize, remainder
from lamina.llm.segment import slices
from lamina.llm.unigram import SPACE

#: What holds before anything is learned, as if seen ``PRIOR`` times: shares of tokens that end a text, of pieces that end a
#: word, of pieces that spell a character by its bytes, of a language's new words that another language has.
END_SHARE, WORD_END, BYTE_SHARE, POOL_SHARE, PRIOR = 0.01, 0.35, 0.002, 0.1, 50.0
LN10 = math.log(10)


def rank_weights(pieces: dict[str, float], shift: float = 30.0) -> dict[str, float]:
    """Weights of a vocabulary whose scores are negative merge ranks: a piece's share
    falls as one over its rank.  Scores that are log-probabilities need no such step:
    use their exponentials."""
    return {p: 1.0 / (shift - s) for p, s in pieces.items() if s > -1e8}


class Trie:
    """Strings by their characters.  ``step`` goes from nodes by characters, many at once; the
    edges are a hash table of (node, character) with linear probing."""

    def __init__(self, strings: list[str]):
        edges: dict[int, int] = {}
        ends, n = [], 1
        for s in strings:
            at = 0
            for ch in s:
                key = at << 21 | ord(ch)
                at = edges.get(key, 0)
                if not at:
                    at = edges[key] = n
                    n += 1
            ends.append(at)
        #: The number of the string that ends at each node, or -1.
        self.string = np.full(n, -1, np.int64)
        self.string[ends] = np.arange(len(strings))
        bits = max(4, (4 * len(edges)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo, at = np.fromiter(edges, np.int64, len(edges)), None
        child = np.fromiter(edges.values(), np.int64, len(edges))
        at = self._place(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.next[at[won]] = todo[won], child[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, child, at = todo[left], child[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes below, -1 where there is none."""
        keys = nodes << 21 | chars
        at = self._place(keys)
        got = self.keys[at]
        lost = np.flatnonzero((got != keys) & (got >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & self.mask
            got[lost] = self.keys[at[lost]]
            lost = lost[(got[lost] != keys[lost]) & (got[lost] >= 0)]
        return np.where(got == keys, self.next[at], -1)


class Lattice:
    """Subword probability of a word, as a distribution over all words.

    The first piece is drawn from those that begin a word, further ones from the rest,
    and after each the word ends with probability ``word_end``.  A character that is no
    piece is spelled in bytes.  Words are worked on many at a time.
    """

    def __init__(self, weights: dict[str, float], word_end: float = WORD_END, byte_share: float = BYTE_SHARE):
        first = {p: w for p, w in weights.items() if p.startswith(SPACE) and SPACE not in p[1:]}
        rest = {p: w for p, w in weights.items() if p and SPACE not in p}
        a, b = sum(first.values()), sum(rest.values())
        self.first = {p: math.log(w / a) for p, w in first.items()}
        inner = math.log(1 - byte_share)
        self.rest = {p: math.log(w / b) + inner for p, w in rest.items()}
        self.word_end, self.byte_share = word_end, byte_share
        self._start()

    def _start(self) -> None:
        self.pieces = [*self.first, *self.rest]
        self.score = np.array([*self.first.values(), *self.rest.values(), 0.0])
        self.trie = Trie(self.pieces)
        self.go, self.stop = math.log(1 - self.word_end), math.log(self.word_end)
        self.byte = math.log(self.byte_share / 256)

    def __getstate__(self):
        return self.first, self.rest, self.word_end, self.byte_share

    def __setstate__(self, state):
        self.first, self.rest, self.word_end, self.byte_share = state
        self._start()

    def _arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(start, end, weight, piece, place of the end in its word, place of the start from
        its word's end) of all arcs of all words, and each word's first and last slot.  A slot
        is a place between characters; spelled characters have piece -1."""
        text = SPACE + SPACE.join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size  # of each word's characters
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(points)) - begin[word]
        slot = np.arange(len(points)) + word  # a word has a slot more than characters
        left = size[word] - place
        starts, ends, pieces = [], [], []
        single = np.zeros(len(points), bool)
        at, node, length = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        while len(at):
            node = self.trie.step(node, points[at + length])
            keep = np.flatnonzero(node >= 0)
            at, node, length = at[keep], node[keep], length + 1
            piece = self.trie.string[node]
            hit = np.flatnonzero(piece >= 0)
            starts.append(at[hit])
            ends.append(slot[at[hit]] + length)
            pieces.append(piece[hit])
            if length == 1:
                single[at[hit]] = True
            on = np.flatnonzero(left[at] > length)
            at, node = at[on], node[on]
        alone = np.flatnonzero(~single)
        starts.append(alone)
        ends.append(slot[alone] + 1)
        pieces.append(np.full(len(alone), -1))
        start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces))
        weight = self.score[piece] + np.where(place[start] > 0, self.go, 0.0)
        if len(alone):
            code = points[alone]
            width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            weight[len(weight) - len(alone) :] = np.where(place[alone] > 0, (self.go + self.byte) * width, 0.0)
        first = begin + np.arange(len(words))
        from_end = left[start]
        return slot[start], end, weight, piece, place[start] + end - slot[start], from_end, first, first + size

    @staticmethod
    def _spread(order_by: np.ndarray, to: np.ndarray, source: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """out[to] = log sum of out[source] + weight, place after place in the words."""
        order = np.lexsort((to, order_by))
        to, source, weight, order_by = to[order], source[order], weight[order], order_by[order]
        bounds = np.flatnonzero(np.diff(order_by)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(to)]):
            terms = out[source[a:b]] + weight[a:b]
            runs = np.flatnonzero(np.diff(to[a:b], prepend=-1))
            out[to[a:b][runs]] = np.logaddexp.reduceat(terms, runs)

    def _forward(self, words: list[str]):
        arcs = self._arcs(words)
        start, end, weight, _, place, _, first, last = arcs
        alpha = np.full(int(last[-1]) + 1, -np.inf)
        alpha[first] = 0.0
        self._spread(place, end, start, weight, alpha)
        return alpha, arcs

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 of each word's marginal probability."""
        if not words:
            return np.zeros(0)
        alpha, arcs = self._forward(words)
        return (alpha[arcs[7]] + self.stop) / LN10

    def expect(self, words: list[str]) -> tuple[np.ndarray, float, float]:
        """Expected numbers over all segmentations of all words: of each piece (in the order of
        ``pieces``), of characters spelled after a word's first place, and of steps on
        from a piece."""
        if not words:
            return np.zeros(len(self.pieces)), 0.0, 0.0
        alpha, (start, end, weight, piece, _, from_end, _, last) = self._forward(words)
        beta = np.full(len(alpha), -np.inf)
        beta[last] = 0.0
        self._spread(from_end, start, end, weight, beta)
        word = np.searchsorted(last, end)
        share = np.exp(alpha[start] + weight + beta[end] - alpha[last][word])
        spelled = piece < 0
        inside = end < last[word]
        counts = np.bincount(piece[~spelled], share[~spelled], len(self.pieces))
        return counts, float(share[spelled & (weight < 0)].sum()), float(share[inside].sum())

    def learned(self, counts: np.ndarray, spelled: float, words: float, prior: float = PRIOR) -> Lattice:
        """The lattice of expected counts, with this one's own shares as ``prior`` pieces more."""
        if not words:
            return self
        new = {p: c + prior * math.exp(s) for p, c, s in zip(self.pieces, counts, self.score)}
        inner = sum(c for p, c in zip(self.pieces, counts) if p in self.rest)
        pieces = counts.sum() + spelled
        return Lattice(new, min(0.99, (words + prior * self.word_end) / (pieces + prior)), (spelled + prior * self.byte_share) / (inner + spelled + prior))


def rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of x (x + 1) ... (x + n - 1)."""

    def log_gamma(z: np.ndarray) -> np.ndarray:
        low = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7)
        z = z + 8
        return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - np.log(low)

    out = np.log10(x)
    more = np.flatnonzero(n > 1)
    if len(more):
        y, m = x[more], n[more].astype(np.float64)
        m = m.reshape(-1, *[1] * (x.ndim - 1))
        out[more] += np.where(m == 2, np.log1p(y), log_gamma(y + m) - log_gamma(y + 1)) / LN10
    return out


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, each word's number in order, and the number of
    words before each text and after the last.  A-Z are lowered; nulls have no words."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[0] < bounds[-1] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    dark = ~_WHITE[raw]
    start = dark.copy()
    start[1:] &= ~dark[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[begins] = dark[begins]
    places = np.flatnonzero(start)
    at = np.append((np.cumsum(dark, dtype=np.int32) - 1)[places], np.int32(np.count_nonzero(dark)))
    packed = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(at), pa.py_buffer(np.compress(dark, _LOWER[raw]))])
    coded = packed.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(places, bounds)


def _counted(part: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and by text and word: the text, the word's number, how often; last the
    texts' numbers of words."""
    own, codes, at = words_of(part)
    size = np.diff(at)
    both, times = np.unique(np.repeat(np.arange(len(size)), size) * max(1, len(own)) + codes, return_counts=True)
    return own, both // max(1, len(own)), both % max(1, len(own)), times, size


def _count(docs: DataFrame) -> DataFrame:
    """``w binary, c int, n long``: words of (text, class) by class, summed within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                own, codes, at = words_of(part.column(0))
                kind = np.repeat(part.column(1).to_numpy().astype(np.int64) + 1, np.diff(at))
                both, times = np.unique(kind * max(1, len(own)) + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(both % max(1, len(own)))), pa.array((both // max(1, len(own)) - 1).astype(np.int32)), pa.array(times.astype(np.int64))], ["w", "c", "n"]
                )

    return docs.mapInArrow(run, "w binary, c int, n long")


def _text(words: pa.Array) -> list[str]:
    return words.cast(pa.string()).to_pylist()


def _learn(counted: DataFrame, weights: dict[str, float]) -> Lattice:
    """A lattice whose weights are the expected piece counts under the vocabulary's own
    weights, over all distinct words learned from.  Distinct words count once each: unseen
    words are like rare ones.  A task leaves one row, so the driver gets as many."""
    before = Lattice(weights)
    shared = counted.sparkSession.sparkContext.broadcast(before)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words = np.zeros(len(shared.value.pieces) + 1), 0
        for batch in batches:
            for k in range(0, len(batch), 8192):
                own = _text(batch.column(0).slice(k, 8192))
                counts, spelled, _ = shared.value.expect(own)
                sums[:-1] += counts
                sums[-1] += spelled
                words += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.where(np.arange(len(sums)) == 0, words, 0))], ["p", "n", "w"])

    seen = counted.where(F.exists("c", lambda x: x > 0)).select("w")
    rows = seen.mapInArrow(expect, "p long, n double, w long").groupBy("p").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()
    sums = np.zeros(len(before.pieces) + 1)
    for r in rows:
        sums[r.p] = r.n
    return before.learned(sums[:-1], float(sums[-1]), float(sum(r.w for r in rows)))


def _frequent(words: DataFrame, head: int) -> list:
    """The most frequent words, ``head`` at most, without an order over the table: counts fall
    into steps of a sixteenth of a doubling, and the driver gets the words of the highest
    steps that ``head`` has room for.  A step is whole or absent."""
    step = F.floor(F.log2("n") * 16)
    seen = words.where("n > 0")
    least, room = None, head
    for r in sorted(seen.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        if r["count"] > room:
            break
        least, room = r.s, room - r["count"]
    return [] if least is None else sorted(seen.where(step >= least).collect(), key=lambda r: bytes(r.w))


class Model:
    """Totals that turn a word's counts and its subword probability into probabilities."""

    def __init__(self, ends: list[int], totals: list[int], kinds: list[int], n: int, v: int, pool: float, spread: float):
        self.ends, self.n, self.spread = ends, n, spread
        self.n_of, self.v_of = np.array(totals, float), np.maximum(1, np.array(kinds, float))
        self.pool = pool if n else 0.0
        docs = sum(ends)
        self.share = np.array([math.log10(e / docs) if e else -math.inf for e in ends]) if docs else np.zeros(1)
        self.base = -math.log10(n + v + 1)

    def words(self, counts: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """(words x classes) probabilities: the sum of the arc of the class's count, the arc of
        all classes' counts, and the subword paths (``sub``, log10)."""
        pooled = self.pool * counts.sum(axis=1) / max(self.n, 1) + (1 - self.pool) * np.power(10.0, np.maximum(sub, -300.0))
        return (counts + self.v_of * pooled[:, None]) / (self.n_of + self.v_of)

    def drawn(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """log10 of drawing words so often, but for what depends on the number of words only."""
        return rising(self.spread * p, times)

    def text(self, sums: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """log10 of texts from their classes' sums: classes are summed out."""
        each = sums + self.share - rising(np.full(len(tokens), self.spread), tokens)[:, None]
        best = each.max(axis=1)
        return best + np.log10(np.power(10.0, each - best[:, None]).sum(axis=1))


def score_documents(
    docs: DataFrame,
    weights: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    mod: int = 7,
    held: int = 2,
    head_cells: int = 500_000,
    spread: float = 3000.0,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Learns from rows whose id's crc32 mod ``mod`` is not ``held`` (rows without an id are
    not learned from, nor held out).  Every language learned from has counts of its own,
    and so have the rows without one.  All words are counted, summed before the shuffle;
    the vocabulary's weights are re-estimated once over all distinct words, and each
    distinct word's lattice is then computed once.  The most frequent words, of which
    ``head_cells`` counts by language are kept, are broadcast, and only the others, none of
    which is frequent, are joined to the table of words, which may be of any size.

    Null and empty texts are the end token alone.  Repeated rows count and are scored
    each.  Without rows to learn from base_score is 0 and the score is the lattice's.
    An empty table gives no rows.
    """
    check_columns(docs, doc_id, text)
    spark = docs.sparkSession
    learned = F.coalesce(remainder("doc_id", mod) != held, F.lit(False))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).cast("string").alias("lang")
    ).withColumn("learn", learned)
    sizes = {r.lang: r.n for r in rows.where("learn").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    names = sorted(sizes, key=lambda x: (x is None, x)) or [None]
    ends, k = [sizes.get(n, 0) for n in names], len(names)
    all_docs = sum(ends)
    of = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "lang string, c int")
    by_lang = rows.select("text", "lang", "learn").join(F.broadcast(of.withColumnRenamed("lang", "__l")), F.col("lang").eqNullSafe(F.col("__l")), "left")
    by_class = _count(by_lang.select("text", F.when(F.col("learn"), F.col("c")).otherwise(F.lit(-1)).alias("c")))
    sums = [F.sum(F.when(F.col("c") == i, F.col("n")).otherwise(F.lit(0))).alias(f"c{i}") for i in range(k)]
    counted = by_class.groupBy("w").agg(*sums).select("w", F.array(*(f"c{i}" for i in range(k))).alias("c"))
    counted = materialize(counted, "counts")
    lattice = spark.sparkContext.broadcast(_learn(counted, weights))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = math.log10(1 - END_SHARE)
        for batch in batches:
            for s in range(0, len(batch), 8192):
                part = batch.slice(s, 8192)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lattice.value.log10(_text(part.column(0))) + keep)], ["w", "c", "sub"])

    words = materialize(counted.mapInArrow(weigh, "w binary, c array<long>, sub double"), "words")
    discard(counted)
    words = words.withColumn("n", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x))
    each = [F.element_at("c", i + 1) for i in range(k)]
    sums = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count_if(F.col("n") > 0),
        *(F.coalesce(F.sum(c), F.lit(0)) for c in each),
        *(F.count_if(c > 0) for c in each),
        *(F.count_if(c == 1) for c in each),
        *(F.count_if((c == 1) & (F.col("n") > 1)) for c in each),
    ).first()
    end = int(all_docs > 0)
    once, elsewhere = sum(sums[2 + 2 * k : 2 + 3 * k]), sum(sums[2 + 3 * k : 2 + 4 * k])
    pool = (elsewhere + PRIOR * POOL_SHARE) / (once + PRIOR)  # of a language's rarest words, those that others have
    totals, kinds = [sums[2 + i] + ends[i] for i in range(k)], [sums[2 + k + i] + (ends[i] > 0) for i in range(k)]
    model = Model(ends, totals, kinds, sums[0] + all_docs, sums[1] + end, pool, spread)
    top = _frequent(words, head_cells // k)
    table = spark.sparkContext.broadcast(
        (
            {bytes(r.w): i for i, r in enumerate(top)},
            model.words(np.array([r.c for r in top], float).reshape(-1, k), np.array([r["sub"] for r in top], float)),
            np.log10(np.array([r.n for r in top], float) + 1),
        )
    )
    of_end = model.drawn(model.words(np.array([ends], float), np.array([math.log10(END_SHARE)])), np.ones(1, int))[0]
    end_base = math.log10(all_docs + 1)
    sum_names = [f"s{i}" for i in range(k)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its frequent words add, and one for each other word."""
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        place, shares, base = table.value
        for batch in batches:
            for part in slices(batch, 2, 3 << 20):
                own, doc, word, times, size = _counted(part.column(2))
                n = len(size)
                spot = np.fromiter(map(place.get, own.to_pylist(), repeat(-1)), np.int64, len(own))[word]
                hit = np.flatnonzero(spot >= 0)
                at, t, d = spot[hit], times[hit], doc[hit]
                drawn = model.drawn(shares[at], t)
                sums = [np.bincount(d, drawn[:, i], n) + of_end[i] for i in range(k)]
                lost = np.flatnonzero(spot < 0)
                m = len(lost)
                cells = [
                    pa.array(np.concatenate((key + np.arange(n), key + doc[lost]))),
                    pa.concat_arrays([part.column(0), pa.nulls(m, part.column(0).type)]),
                    pa.concat_arrays([part.column(1), pa.nulls(m, pa.bool_())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), own.take(pa.array(word[lost]))]),
                    pa.array(np.concatenate((size + 1, times[lost])).astype(np.int64)),
                    pa.array(np.concatenate((np.bincount(d, t, n).astype(np.int64) + end, np.zeros(m, np.int64)))),
                    pa.array(np.concatenate((np.bincount(d, t * base[at], n) + end_base, np.zeros(m)))),
                    *(pa.array(np.concatenate((s, np.zeros(m)))) for s in sums),
                ]
                key += n
                yield pa.RecordBatch.from_arrays(cells, schema.names)

    source = rows.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "text")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("w", T.BinaryType())])
    schema = schema.add("times", T.LongType()).add("known", T.LongType()).add("base", T.DoubleType())
    for name in sum_names:
        schema = schema.add(name, T.DoubleType())
    partial = materialize(source.mapInArrow(score, schema), "scored")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, n = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            counts = np.array(batch.column(2).flatten().to_numpy(), float).reshape(-1, k)
            drawn = model.drawn(model.words(counts, batch.column(4).to_numpy()), times)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(n > 0, times, 0)), pa.array(times * np.log10(n + 1.0)), *(pa.array(drawn[:, i].copy()) for i in range(k))], rare_type.names)

    rare_type = T.StructType([T.StructField("key", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), *(T.StructField(s, T.DoubleType()) for s in sum_names)])
    joined = partial.where("w is not null").select("key", "w", "times").join(words, "w").select("key", "times", "c", "n", "sub")
    added = joined.mapInArrow(rare, rare_type)
    more = added.groupBy("key").agg(*(F.sum(c).alias(f"__{c}") for c in ("known", "base", *sum_names)))
    whole = partial.where("w is null").drop("w").join(more, "key", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.stack([batch.column(5 + i).to_numpy() for i in range(k)], axis=1) if len(batch) else np.zeros((0, k))
            tokens = batch.column(2).to_numpy()
            cells = [*batch.columns[:4], pa.array(np.full(len(tokens), model.n, np.int64)), pa.array(batch.column(4).to_numpy() + tokens * model.base), pa.array(model.text(sums, tokens))]
            yield pa.RecordBatch.from_arrays(cells, out.names)

    out = T.StructType([schema["doc_id"], schema["held_out"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())])
    out = out.add("train_tokens", T.LongType()).add("base_score", T.DoubleType()).add("score", T.DoubleType())
    added_to = lambda c, zero: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(zero))
    last = whole.select("doc_id", "held_out", F.col("times").alias("n_tokens"), added_to("known", 0).alias("n_known"), added_to("base", 0.0).alias("base"), *(added_to(s, 0.0).alias(s) for s in sum_names))
    return last.mapInArrow(finish, out)
