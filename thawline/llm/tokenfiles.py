"""Token ids in ORC files.

Layout: one row a document, ``(shard, doc_id, first, n_tokens, ids)``, in ascending doc_id within a shard and over
shards; first: ids of the shard before it.
ORC's writer run-length encodes the integers, ends a stripe by size, keeps a row index entry (minimum, maximum) for
every ``index_stride`` rows and a Bloom filter on doc_id. A reader takes stripes in parallel, and a filter on doc_id
skips stripes and row groups by that metadata alone.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thawline.llm import textbytes as tb
from thawline.llm.common import materialize, shuffle_parts, small_batches

#: Pieces a Python worker remembers with their ids; others are encoded again.
CACHE_PIECES = 1 << 20
#: Bytes of text that a worker encodes at once.
SLICE = 1 << 20
_workers: dict[str, "_Encoder"] = {}
SCHEMA = "shard int, doc_id long, first long, n_tokens int, ids array<int>"

_LETTER = tb.byte_set((0x41, 0x5A), (0x61, 0x7A))
_OTHER = tb.byte_set((0x00, 0x7F)) & ~_LETTER & tb.NOT_SPACE & (np.arange(256) != ord("'"))


def _splits(seg: np.ndarray) -> np.ndarray:
    """Between an ASCII letter and another ASCII character, but an apostrophe, the tokenizer always splits."""
    letter, other, out = _LETTER[seg], _OTHER[seg], np.zeros(len(seg), bool)
    out[1:] = (letter[:-1] & other[1:]) | (other[:-1] & letter[1:])
    return out


#: What a tokenizer's file says where texts can be encoded piece by piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class _Encoder:
    """Encodes texts piece by piece. The tokenizer never joins over white space, nor where ``_splits`` does, and
    lower-cases, so that equal pieces have equal ids and are encoded once. Pieces are known by their 64-bit hash.
    Tokenizers that don't say so in their file encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        self.by_piece = (
            told.get("normalizer") == NORMALIZER and (kind.get("pretokenizers") or [kind])[0] == SPLIT
            and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Known pieces: hashes in order, the place of each one's ids and their number."""
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and their numbers."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes

    def _encode_letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of letters alone: many in a text, told apart by the ids that end a word."""
        ids, _ = self._encode([" ".join(pieces[a : a + 100]) for a in range(0, len(pieces), 100)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return self._encode(pieces)
        return ids, np.diff(np.concatenate(([0], ends)))

    def add(self, at: np.ndarray, hashes: np.ndarray, pieces: list[str]) -> None:
        """New pieces, whose hashes belong at ``at`` in the order of the known."""
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
        for letters, encode in ((True, self._encode_letters), (False, self._encode)):
            own = [i for i, p in enumerate(pieces) if p.isalpha() == letters]
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                ids, sizes = encode([pieces[i] for i in part])
                if self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate((self.ids, np.zeros(max(len(ids), len(self.ids) // 2), np.int32)))
                self.ids[self.used : self.used + len(ids)] = ids
                first[part], size[part] = self.used + np.cumsum(sizes) - sizes, sizes
                self.used += len(ids)
        self.keys, self.first, self.size = np.insert(self.keys, at, hashes), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's with its end id."""
        if not self.by_piece:
            got = [[*self.tokenizer.encode(x.as_py() or "", add_special_tokens=False).ids, end_id] for x in column]
            return np.fromiter(chain.from_iterable(got), np.int32), np.array([len(x) for x in got], np.int64)
        if len(self.keys) > CACHE_PIECES:
            self.forget()
        data, offsets = tb.buffers(column)
        rows = len(offsets) - 1
        words = tb.scan(data, offsets, tb.NOT_SPACE, split=_splits)
        unique, sample, at = np.unique(words.hash, return_index=True, return_inverse=True)
        to = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = np.flatnonzero(to < len(self.keys))
        known[inside] = self.keys[to[inside]] == unique[inside]
        if len(fresh := np.flatnonzero(~known)):
            start, end = words.start[sample[fresh]].tolist(), words.end[sample[fresh]].tolist()
            self.add(to[fresh], unique[fresh], [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)])
        at = np.searchsorted(self.keys, unique)[at]
        n = self.size[at].astype(np.int64)
        done = np.concatenate(([0], np.cumsum(n)))
        total = int(done[-1])
        ends = done[np.cumsum(np.bincount(words.doc, minlength=rows))]
        sizes = np.diff(np.concatenate(([0], ends))) + 1
        # each piece's ids move on by the end ids of the rows before it
        out = np.full(total + rows, end_id, np.int32)
        place = np.ones(total, np.int64)
        if total:
            some = np.flatnonzero(n)
            place[done[some]] = self.first[at[some]] - np.concatenate(([0], (self.first[at[some]] + n[some] - 1)[:-1]))
            to = np.ones(total + rows, bool)
            to[np.cumsum(sizes) - 1] = False
            out[to] = self.ids[np.cumsum(place)]
        odd = np.unique(np.searchsorted(offsets, _find(data, b"<|"), "right") - 1)
        if len(odd):  # may hold special tokens, which know no pieces
            parts = np.split(out, np.cumsum(sizes)[:-1])
            for i in odd:
                parts[i] = np.array([*self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, end_id], np.int32)
            out, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, sizes


def _find(data: np.ndarray, what: bytes) -> np.ndarray:
    raw, at, out = data.tobytes(), -1, []
    while (at := raw.find(what, at + 1)) >= 0:
        out.append(at)
    return np.array(out, np.int64)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
    stripe_bytes: int = 16 << 20,
    index_stride: int = 1000,
) -> None:
    """Encode every text (null: empty), append ``end_id``, write ORC under ``path``.

    Documents are dealt to shards by range of doc_id, so that a shuffle of the texts is the only one, and sorted by
    doc_id within (null first; rows of equal doc_id by text). Long texts are encoded whole. Other columns are left out,
    whatever their names. An empty table gives a file set without rows. ``tokenizer``: a file of the tokenizers library;
    the lower-casing one with word ends is fast, others encode text by text.
    """
    file = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    shards = shards or shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def work(batches):
        encoder = _workers.get(file) or _workers.setdefault(file, _Encoder(file))
        before = 0
        for big in batches:
            for batch in tb.slices(big, "text", SLICE):
                ids, n = encoder.encode(batch.column(2), end_id)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                first = before + offsets[:-1].astype(np.int64)
                before += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(first), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    names=["shard", "doc_id", "first", "n_tokens", "ids"],
                )

    encoded = rows.mapInArrow(work, SCHEMA)
    options = {
        "compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_stride,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01,
    }
    with small_batches(docs.sparkSession):
        encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id reach the stripes' metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A shard's start is the sum of the shards before it, from a row a shard. The files are read when this is called, and
    what is known of each document goes to the shared folder.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, offsets = ids.flatten().to_numpy().astype("<i4", copy=False), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path).select("shard", "doc_id", "first", "ids")
    with small_batches(spark):
        rows = materialize(rows.mapInArrow(work, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long"), "index")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
