"""Repeated passages across documents by sparse suffix arrays.

A passage is ``least`` words or more that stand, word for word, in two documents. Suffixes are retained only at
content-selected places: of every ``window`` consecutive word 8-grams, the one of least hash (its minimiser). Every
passage of ``least`` words holds such a place in its first ``window`` words, the same in each copy, with at least
``right = least - window + 1`` words after it. So:

1. retained suffixes, cut at ``right`` words (16 bits of hash a word), are sorted over the cluster by range of
   suffix and place, so that a suffix that a third of all documents hold is spread over tasks; equal neighbours
   (also over the ends of two tasks' ranges) are repeated;
2. repeated places are extended left and right: each ``least``-word stretch that holds the place within its first
   ``window`` words is hashed whole, and stretches found in two documents are kept;
3. stretches that touch become spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thawline.llm import textbytes as tb
from thawline.llm.common import free, materialize, noting, shuffle_parts, spread

GRAM = 8
#: Bits of a hash that give way to the place.
PLACE_BITS = 20
#: Makes other word hashes for a stretch's second number.
OTHER = np.uint64(0x3C6EF372FE94F82B)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def minimisers(h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places, ascending, of the least 8-gram hash in each ``window`` consecutive 8-grams of a document."""
    g = tb.grams(h, GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    most = int(low) + 1 - window  # windows at once, so that places don't wrap and of equal hashes the first is taken
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(g) - window + 1, most):
        part = g[a : a + most + window - 1]
        n = len(part) - window + 1
        m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < window:
            m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
        end = a + window + GRAM - 2
        i = np.flatnonzero(doc[a : a + n] == doc[end : end + n])
        found.append(a + (m[i] & low).astype(np.int64))
    return np.unique(np.concatenate(found))


def suffixes(docs: DataFrame, least: int, window: int) -> DataFrame:
    """(suffix, doc_id, place) at the minimisers; place counts words from 0."""
    right = least - window + 1

    def work(batches):
        for big in batches:
            for batch in tb.slices(big, "text"):
                data, offsets = tb.buffers(_column(batch, "text"))
                words = tb.scan(data, offsets, tb.ALNUM)
                at = minimisers(words.hash, words.doc, window)
                at = at[at + right <= len(words.doc)]
                at = at[words.doc[at] == words.doc[at + right - 1]]
                short = (words.hash >> np.uint64(48)).astype(">u2")
                keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(short, right)[at]) if len(at) else np.zeros((0, right), ">u2")
                first = np.searchsorted(words.doc, np.arange(batch.num_rows))
                doc = words.doc[at]
                suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * right), len(at), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([suffix, _column(batch, "doc_id").take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32))], names=["suffix", "doc_id", "place"])

    return docs.mapInArrow(work, "suffix binary, doc_id long, place int")


def repeated(rows: DataFrame, parts: int) -> DataFrame:
    """Places (doc_id, place) whose suffix stands elsewhere too: sort, compare neighbours."""
    ranged = rows.repartitionByRange(parts, "suffix", "doc_id", "place").sortWithinPartitions("suffix", "doc_id", "place")

    def work(batches):
        """Of a run the rows, if two or more; else, at either end of the task's range, the row as an edge."""
        part, held, begun = TaskContext.get().partitionId(), None, False
        schema = ["part", "edge", "suffix", "doc_id", "place"]

        def out(rows, edge):
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.bool_()), *rows.columns], names=schema)

        for batch in batches:
            t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = t.num_rows
            if n == 0:
                continue
            keys = _column(t, "suffix")
            same = keys[1:].to_numpy(zero_copy_only=False) == keys[:-1].to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
            again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            known = np.zeros(n, bool)
            if held is not None:
                known[0] = last_known  # noqa: F821
            emit = again & ~known
            emit[-1] = False
            if not begun:
                begun = True
                yield out(t.slice(0, 1), True)
            if emit.any():
                yield out(t.filter(pa.array(emit)), False)
            held = t.slice(n - 1, 1)
            last_known = bool(again[-1] and known[-1])
            if again[-1] and not known[-1]:
                yield out(held, False)
                last_known = True
        if held is not None:
            yield out(held, True)

    marked = materialize(ranged.mapInArrow(work, "part int, edge boolean, suffix binary, doc_id long, place int"), "repeats")
    edges = marked.where("edge").select("part", "suffix").collect()  # two a task
    at: dict[bytes, set] = {}
    for r in edges:
        at.setdefault(bytes(r["suffix"]), set()).add(r["part"])
    split = [(k,) for k, parts_of in at.items() if len(parts_of) > 1]
    over = marked.sparkSession.createDataFrame(split, "suffix binary")
    return marked.where("not edge").select("doc_id", "place").unionByName(marked.where("edge").join(F.broadcast(over), "suffix", "left_semi").select("doc_id", "place")).distinct()


def stretches(docs: DataFrame, places: DataFrame, least: int, window: int) -> DataFrame:
    """(hash, other, doc_id, start) of every stretch around a repeated place; a stretch is known by two 64-bit numbers."""
    by_doc = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    rows = docs.join(by_doc, "doc_id").select("doc_id", "places", "text")

    def work(batches):
        for big in batches:
            for batch in tb.slices(big, "text"):
                data, offsets = tb.buffers(_column(batch, "text"))
                words = tb.scan(data, offsets, tb.ALNUM)
                count = np.bincount(words.doc, minlength=batch.num_rows)
                first = np.cumsum(count) - count
                lists = _column(batch, "places")
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                place = lists.flatten().to_numpy().astype(np.int64)
                doc, place = doc[place < count[doc]], place[place < count[doc]]
                cover = np.zeros(len(words.doc) + 1, np.int64)
                np.add.at(cover, first[doc] + np.maximum(0, place - window + 1), 1)
                np.add.at(cover, first[doc] + place + 1, -1)
                start = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                start = start[start + least <= len(words.doc)]
                start = start[words.doc[start] == words.doc[start + least - 1]]
                h, other = (tb.grams(x, least)[start] for x in (words.hash, tb.mix(words.hash ^ OTHER)))
                d = words.doc[start]
                known = [pa.array(x.view(np.int64)) for x in (h, other)]
                yield pa.RecordBatch.from_arrays([*known, _column(batch, "doc_id").take(pa.array(d)), pa.array((start - first[d]).astype(np.int32))], names=["hash", "other", "doc_id", "start"])

    return rows.mapInArrow(work, "hash long, other long, doc_id long, start int")


def shared_stretches(found: DataFrame) -> DataFrame:
    """(doc_id, start, first_doc_id) of the stretches that two documents hold; first_doc_id: the least of these.

    Stretches go by their first number, so that half of the key moves; where unlike ones share it, of 10^10 about three
    pairs, all go by both.
    """
    least = [F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.min("other").alias("one"), F.max("other").alias("two")]
    of = lambda *keys: materialize(found.groupBy(*keys).agg(*least).where("first_doc_id < last").drop("last"), "shared")
    keys, shared = ["hash"], of("hash")
    if not shared.where("one < two").isEmpty():
        keys = ["hash", "other"]
        shared = of(*keys)
    free(found.sparkSession, [])
    kept = found.select(*keys, "doc_id", "start").join(shared.drop("one", "two"), keys)  # of a frequent stretch the left rows are split by AQE
    return kept.select("doc_id", "start", "first_doc_id")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50, window: int = 36) -> DataFrame:
    """Maximal spans of passages that other documents hold too: (doc_id, start_word, end_word, n_words, first_doc_id).

    Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased, counted from 0; end_word is
    exclusive. Every span is made of stretches of ``least`` words found in two documents or more; first_doc_id is the
    least id of a document that holds one of them, so a span whose first_doc_id is its own doc_id is a first copy.
    Repeats within one document alone don't count, nor do rows of one doc_id between them. Null, empty and short
    texts and rows without doc_id have no span; long texts count whole. Other columns are left out, whatever their names;
    an empty table gives an empty result.
    """
    parts = shuffle_parts(docs.sparkSession)
    docs = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"))
    with noting(written := []):  # each table goes once the next is there
        places = repeated(materialize(suffixes(docs, least, window), "suffixes"), parts)
        free(docs.sparkSession, [written.pop(0)])
        found = materialize(stretches(docs, places, least, window), "stretches")
        free(docs.sparkSession, [written.pop(0)])
        kept = shared_stretches(found)
    kept = materialize(kept, "kept")
    free(docs.sparkSession, written)
    order = Window.partitionBy("doc_id").orderBy("start")
    kept = kept.withColumn("new", F.coalesce((F.col("start") > F.lag("start").over(order) + least).cast("int"), F.lit(1)))
    kept = kept.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = kept.groupBy("doc_id", "span").agg(
        F.min("start").alias("start_word"), (F.max("start") + least).alias("end_word"), F.min("first_doc_id").alias("first_doc_id")
    )
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")
