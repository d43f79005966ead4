"""Toxicity scores from the nearest labelled examples.

Examples are a bounded sample of labelled documents. Every word counts: weights are TF-IDF, (1 + ln tf) * idf, times the
word's lean, to unit length over the whole text. idf is over all documents; a word that no example holds has that of a
word of fewer than one document in as many as there are examples. lean raises words that go with the label: ``floor``
for a word without any association, up to 1 for the strongest (phi coefficient over the examples); a floor of 1 is plain
TF-IDF. Which floor is used is decided by the log-loss on further labelled documents.

The examples lie in an inverted index. A word's postings are cut into blocks of examples, each with its greatest weight,
so that the blocks' greatest cosines with a document are known before any posting is read. The blocks of greatest bound
are read first, of the others those that can hold one of the k nearest; these are exact. Their labels, weighted by cosine, are the
vote, and a logistic curve, fitted on the further labelled documents, makes a probability of it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thawline.llm import textbytes as tb
from thawline.llm.common import add_columns, small_batches

#: Examples in a block, and postings read at once.
BLOCK = 64
POSTINGS = 1 << 20


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... ``size[0]`` numbers, then those of first[1] and so on."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Index(NamedTuple):
    """Postings (example, weight) by word, then example; runs of a word and block: their first posting, block and greatest weight.

    The runs of word w are of[w] to of[w + 1], the postings of run r are first[r] to first[r + 1].
    """

    of: np.ndarray
    first: np.ndarray
    block: np.ndarray
    top: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    n_examples: int

    @classmethod
    def build(cls, word: np.ndarray, example: np.ndarray, weight: np.ndarray, n_words: int, n_examples: int) -> Index:
        order = np.lexsort((example, word))
        word, example, weight = word[order], example[order].astype(np.int32), weight[order]
        block = (example // BLOCK).astype(np.int32)
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        top = np.maximum.reduceat(weight, at) if len(at) else np.zeros(0)
        return cls(np.searchsorted(word[at], np.arange(n_words + 1)), np.append(at, len(word)), block[at], top, example, weight, n_examples)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (of cosine over 0), best first, ties by place."""
        size = self.of[terms + 1] - self.of[terms]
        run, weights = _ranges(self.of[terms], size), np.repeat(weights, size)
        block, cosines = self.block[run], np.zeros(self.n_examples)
        bound = np.bincount(block, self.top[run] * weights, -(-self.n_examples // BLOCK))
        first = np.zeros(len(bound), bool)
        first[np.argsort(-bound, kind="stable")[: 1 + k // BLOCK]] = True  # enough blocks to hold k
        least = 0.0
        for read in (first, ~first):
            here = (read & (bound > 0) & (bound >= least))[block]  # of blocks that can hold one as near
            self._add(cosines, run[here], weights[here])
            known = cosines[cosines > 0]
            least = np.partition(known, len(known) - k)[len(known) - k] * (1 - 1e-9) if len(known) >= k else 0.0
        found = np.flatnonzero(cosines > 0)
        if len(found) > k:
            found = found[cosines[found] >= np.partition(cosines[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((found, -cosines[found]))][:k]
        return found, cosines[found]

    def _add(self, cosines: np.ndarray, run: np.ndarray, weights: np.ndarray) -> None:
        size = self.first[run + 1] - self.first[run]
        ends = np.cumsum(size)
        a = 0
        while a < len(run):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, "right")))
            at = _ranges(self.first[run[a:b]], size[a:b])
            cosines += np.bincount(self.example[at], self.weight[at] * np.repeat(weights[a:b], size[a:b]), len(cosines))
            a = b


class Model(NamedTuple):
    """words: sorted hashes; factor: idf * lean of each, and of other words; ids (ascending) and labels of examples; their index."""

    words: np.ndarray
    factor: np.ndarray
    other: float
    ids: np.ndarray
    labels: np.ndarray
    index: Index
    curve: tuple[float, float]
    base: float
    k: int
    floor: float


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, times) of each distinct word of each row, in order."""
    w = tb.scan(*tb.buffers(column), tb.ALNUM)
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def places(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place in ``words`` of each hash, or -1."""
    if not len(words):
        return np.full(len(h), -1)
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    return np.where(words[at] == h, at, -1)


def unit(words_at: np.ndarray, times: np.ndarray, factor: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    """Words of the examples in a text and their weights, to unit length over all its words (``words_at`` -1: another)."""
    w = (1 + np.log(times)) * np.where(words_at >= 0, factor[words_at] if len(factor) else 0.0, other)
    ok = words_at >= 0
    return words_at[ok], w[ok] / max(1e-12, np.sqrt((w * w).sum()))


def vote(model: Model, words_at: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of label 1 among the nearest by cosine, drawn to the base rate where there is little; their places and cosines."""
    terms, w = unit(words_at, times, model.factor, model.other)
    if not len(terms):
        return model.base, terms, np.zeros(0)
    found, cosines = model.index.nearest(terms, w, model.k)
    return float((cosines @ model.labels[found] + 0.5 * model.base) / (cosines.sum() + 0.5)), found, cosines


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on x by Newton's method, with a weak pull to zero."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.01 * a, (weight * (p - y)).sum() + 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _log_loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, curve: tuple[float, float]) -> float:
    z = np.clip(curve[0] * x + curve[1], -30, 30)
    return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum())


class Counts(NamedTuple):
    """Distinct words of documents, one document's after the other: n+1 offsets, word and times; doc_id and label of each."""

    cut: np.ndarray
    word: np.ndarray
    times: np.ndarray
    ids: np.ndarray
    y: np.ndarray

    def rows(self):
        return ((self.word[a:b], self.times[a:b]) for a, b in zip(self.cut[:-1], self.cut[1:], strict=True))


def _counts(t: pa.Table) -> Counts:
    t = t.sort_by("doc_id").combine_chunks()
    flat = lambda c, kind: np.frombuffer(b"".join(x.as_buffer() for x in t.column(c)), kind)
    words, times = flat("words", np.uint64), flat("times", np.int32)
    cut = np.concatenate(([0], np.cumsum(t.column("size").to_numpy()))).astype(np.int64)
    return Counts(cut, words, times, t.column("doc_id").to_numpy(), t.column("y").to_numpy().astype(float))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    examples: tuple[int, int] = (2000, 1000),
    checks: tuple[int, int] = (1200, 400),
    k: int = 15,
    floors: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03),
) -> Model:
    """Model from ``labels`` (doc_id, label 0 or 1), already restricted to rows that may be learned from.

    At most ``examples`` documents of label 0 and 1 are indexed and ``checks`` more choose the floor and fit the curve,
    drawn by hash of doc_id, in that proportion where there are fewer; these bound what the driver holds. Rows without
    id, label or text are left out; a document labelled twice counts as 1 if any of its labels is; of the rows that share
    a doc_id the least text is the example. idf counts all rows of ``docs``. Without labels of both kinds the score is
    the rate of label 1, or 0. Without further documents of both kinds the curve is fitted on the examples and the
    middle one of ``floors`` is taken.
    """
    spark = docs.sparkSession
    given = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().where("y in (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = total.get(1, 0) / max(1, sum(total.values()))
    none = np.zeros(0, np.int64)
    empty = Model(
        np.zeros(0, np.uint64), np.zeros(0), 1.0, none, np.zeros(0), Index.build(none, none, np.zeros(0), 0, 0),
        (0.0, -30.0 if not base else float(np.log(base / max(1e-9, 1 - base)))), base, k, 1.0,
    )
    if not total.get(0) or not total.get(1):
        return empty
    drawn = [given.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples[y] + checks[y]) for y in (0, 1)]
    shares = [min(examples[y], -(-total[y] * examples[y] // (examples[y] + checks[y]))) for y in (0, 1)]
    ids = [(r["doc_id"], y, i >= shares[y]) for y in (0, 1) for i, r in enumerate(drawn[y].collect())]

    def count(batches):
        for big in batches:
            for batch in tb.slices(big, "text"):
                doc, h, n = word_counts(batch.column(0))
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                lists = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (h, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(cut)), *lists], names=["doc_id", "y", "check", "size", "words", "times"])

    sample = spark.createDataFrame(ids, "doc_id long, y int, check boolean")  # of bounded size
    texts = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id")).where("text is not null")
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y", "check").agg(F.min("text").alias("text")).select("text", "doc_id", "y", "check")
    with small_batches(spark):
        rows = rows.mapInArrow(count, "doc_id long, y int, check boolean, size long, words binary, times binary").toArrow()
    held = rows.column("check").to_numpy()
    shown, checked = (_counts(rows.filter(pa.array(x))) for x in (~held, held))
    del rows
    if not 0 < shown.y.sum() < len(shown.y):
        return empty
    doc = np.repeat(np.arange(len(shown.ids), dtype=np.int32), np.diff(shown.cut))
    words, at = np.unique(shown.word, return_inverse=True)
    df = np.bincount(at, minlength=len(words))
    n, n1 = float(len(shown.y)), shown.y.sum()
    with1 = np.bincount(at, shown.y[doc], len(words))
    phi = np.abs(n * with1 - df * n1) / np.sqrt(np.maximum(1e-9, n1 * (n - n1) * df * (n - df)))
    phi[df == n] = 0
    phi /= max(1e-12, phi.max(initial=0))

    shared = spark.sparkContext.broadcast(words)

    def frequencies(batches):
        df, seen = np.zeros(len(shared.value) + 1, np.int64), 0
        for big in batches:
            for batch in tb.slices(big, "text"):
                i = places(shared.value, word_counts(batch.column(0))[1])
                df[:-1] += np.bincount(i[i >= 0], minlength=len(df) - 1)
                seen += batch.num_rows
        df[-1] = seen
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["word", "n"])

    docs_with = np.zeros(len(words) + 1)
    with small_batches(spark):
        totals = docs.select(F.col(text).alias("text")).mapInArrow(frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    docs_with[totals["word"].to_numpy()] = totals["n"].to_numpy()
    idf = np.log((1 + docs_with[-1]) / (1 + docs_with[:-1]))

    def model_of(floor: float) -> Model:
        factor, other = idf * (floor + (1 - floor) * phi), float(np.log(1 + n) * floor)
        cuts = zip(shown.cut[:-1], shown.cut[1:], strict=True)
        weight = np.concatenate([unit(at[a:b], shown.times[a:b], factor, other)[1] for a, b in cuts])
        return Model(words, factor, other, shown.ids, shown.y, Index.build(at, doc, weight, len(words), len(shown.ids)), (1.0, 0.0), base, k, floor)

    both = 0 < checked.y.sum() < len(checked.y)
    known = checked if both else shown
    share = np.array([1 - base, base]) * len(known.y) / np.maximum(1, [(known.y == 0).sum(), (known.y == 1).sum()])
    weight = share[known.y.astype(int)]
    best = None
    for floor in floors if both else floors[len(floors) // 2 :][:1]:
        model = model_of(floor)
        x = np.array([vote(model, places(words, w), times)[0] for w, times in known.rows()])
        curve = _curve(x, known.y, weight)
        loss = _log_loss(x, known.y, weight, curve)
        if best is None or loss < best[0]:
            best = loss, model._replace(curve=curve)
    return best[1]


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, evidence: int = 5, keep_text: bool = False) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (1 at ``threshold`` or more) and ``evidence`` to every row of ``docs``.

    evidence: nearest examples as (doc_id, label, cosine); of equal cosines the smaller doc_id is nearer. Null and empty
    texts, and those without any word of the examples, have no neighbour and the score of the base rate; long texts count
    whole. Other columns stay, whatever their names (``text`` with ``keep_text``), of the same name are replaced;
    repeated rows are treated alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def make(column: pa.Array) -> list[pa.Array]:
        m = shared.value
        doc, h, times = word_counts(column)
        at = places(m.words, h)
        cut = np.searchsorted(doc, np.arange(len(column) + 1))
        votes, told = np.empty(len(column)), []
        for r in range(len(column)):
            s = slice(cut[r], cut[r + 1])
            votes[r], found, cosines = vote(m, at[s], times[s])
            told.append([{"doc_id": int(m.ids[p]), "label": int(m.labels[p]), "cosine": float(c)} for p, c in zip(found[:evidence], cosines, strict=False)])
        p = 1 / (1 + np.exp(-np.clip(m.curve[0] * votes + m.curve[1], -30, 30)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(told, kind)]

    return add_columns(docs, text, make, "score double, predicted int, evidence array<struct<doc_id:long,label:int,cosine:double>>", keep_text)


def may_learn(labels: DataFrame, learn: Column) -> DataFrame:
    return labels.where(F.coalesce(learn, F.lit(False)))
