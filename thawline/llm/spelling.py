"""Spelling variants by a dictionary of pairs of trie nodes.

Words are numbered in two tries, of the words and of the words reversed; a node stands for one prefix (or suffix), so
that a pair (prefix node, suffix node) with one character skipped between them stands for exactly one string with a gap. Two
words that share such a pair differ in the gap's character (replaced); a word that has the pair with nothing between
differs by a character inserted there. So neighbours are joined on two integers, exactly, without verification. A pair
has no more words than there are characters in the alphabet, and one with nothing between.

The tries are built without being held: words are sorted over the cluster by range, a word's nodes are those of its
longest common prefix with the word before, then new ones; what a range's first word shares with the word before the range is
renumbered by a small table. A task holds one word's nodes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thawline.llm.common import materialize, shuffle_parts, spread

#: Letters of words: of the ASCII range and U+00C0 to U+00FF.
LETTERS = r"[A-Za-z\x{C0}-\x{FF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A range's nodes are numbered from its own number times this.
SPAN = 1 << 40


def runs_of(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc_id, run) of every maximal run of at least ``least`` letters, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.explode(runs).alias("run"))
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    return rows.withColumn("run", low)


def with_typos(runs: DataFrame, every: int = 31) -> Column:
    """The run, without its character h % length (from 0) where ``every`` divides h, the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return F.when(h % every == 0, less).otherwise(F.col("run"))


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trie_nodes(words: DataFrame, column: str, parts: int) -> DataFrame:
    """``words`` with rank (ascending with ``column``) and nodes: of each prefix, the empty one (0) first, the node's number.

    Every prefix has one number over the whole table.
    """
    others = [c for c in words.columns if c != column]
    schema = T.StructType([*words.select(column, *others).schema.fields, *T.StructType.fromDDL("rank long, part int, nodes array<long>").fields])
    ranged = words.select(column, *others).repartitionByRange(parts, column).sortWithinPartitions(column)

    def work(batches):
        part = TaskContext.get().partitionId()
        start = part * SPAN
        before, nodes, used, rank = "", np.zeros(1, np.int64), start, start
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows, lists = batch.slice(a, 1000), []
                for word in rows.column(0).to_pylist():
                    c = _shared(before, word)
                    fresh = len(word) - c
                    nodes = np.concatenate((nodes[: c + 1], np.arange(used + 1, used + fresh + 1)))
                    used += fresh
                    before = word
                    lists.append(nodes)
                size = np.array([len(x) for x in lists])
                flat = pa.array(np.concatenate(lists))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat)
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(rank + 1 + np.arange(n)), pa.array(np.full(n, part), pa.int32()), listed], names=schema.names)
                rank += n

    numbered = materialize(ranged.mapInArrow(work, schema), "nodes")
    ends = numbered.groupBy("part").agg(F.min_by(F.struct(column, "nodes"), "rank").alias("first"), F.max_by(F.struct(column, "nodes"), "rank").alias("last"))
    old, new = _renumbered(ends.orderBy("part").collect(), column)  # two words a range
    if not len(old):
        return numbered.drop("part")
    held = words.sparkSession.sparkContext.broadcast((old, new))

    def renumber(batches):
        old, new = held.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(old, flat), len(old) - 1)
            flat = np.where(old[at] == flat, new[at], flat)
            size = lists.value_lengths().to_numpy()
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed], names=batch.schema.names)

    return numbered.mapInArrow(renumber, schema).drop("part")


def _renumbered(ends: list, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, of prefixes that an earlier range numbered too, and that earlier number."""
    known: dict[int, int] = {}
    for before, here in zip(ends[:-1], ends[1:], strict=True):
        last, first = before["last"], here["first"]
        c = _shared(last[column], first[column])
        for a, b in zip(first["nodes"][1 : c + 1], last["nodes"][1 : c + 1], strict=True):
            known[a] = known.get(b, b)
    old = np.array(sorted(known), np.int64)
    return old, np.array([known[x] for x in old.tolist()], np.int64)


def pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, skipped, first, rank, n): each word's node pairs with one character skipped or none between.

    ``words``: rank, n, word, nodes, ends (of the reversed word). first: whether the skipped character starts a run of equal
    ones, so that a word that lacks one of them is met once.
    """
    schema = "prefix long, suffix long, skipped boolean, first boolean, rank long, n long"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            size = col("nodes").value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            nodes, ends = (col(c).flatten().to_numpy() for c in ("nodes", "ends"))
            letters = np.frombuffer("".join(col("word").to_pylist()).encode("utf-32-le"), np.uint32)
            for a, b in _cuts(size):
                row = np.repeat(np.arange(a, b), size[a:b])
                i = np.arange(begin[a], begin[b - 1] + size[b - 1]) - begin[row]  # letters before
                long = size[row] - 1
                suffix_at = begin[row] + long - i
                gap = i < long
                at = begin[row[gap]] - row[gap] + i[gap]
                first = (i[gap] == 0) | (letters[at] != letters[at - 1])
                prefix = nodes[begin[row] + i]
                rank, n = col("rank").to_numpy()[row], col("n").to_numpy()[row]
                none = np.zeros(len(row), bool)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prefix, ends[suffix_at], none, none, rank, n)], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prefix[gap], ends[suffix_at[gap] - 1], ~none[gap], first, rank[gap], n[gap])], names=names)

    return words.select("rank", "n", "word", "nodes", "ends").mapInArrow(work, schema)


def _cuts(size: np.ndarray, most: int = 100_000):
    """Ranges of rows of about ``most`` pairs."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best) of words with neighbours; best: (n, -rank) of the most frequent neighbour, ties to the first in order.

    ``words`` as of :func:`pairs`.
    """
    member = F.struct("n", (-F.col("rank")).alias("minus"), "skipped", "first")
    met = pairs(words).groupBy("prefix", "suffix").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)  # bounded by the alphabet

    def seen_by(x: Column) -> Column:
        """Members that differ from x by the pair's one character."""
        return F.filter("all", lambda y: (y["minus"] != x["minus"]) & ((x["skipped"] & y["skipped"]) | (x["skipped"] & x["first"] & ~y["skipped"]) | (y["skipped"] & y["first"] & ~x["skipped"])))

    told = F.transform("all", lambda x: F.struct((-x["minus"]).alias("rank"), F.transform(seen_by(x), lambda y: F.struct(y["n"].alias("n"), y["minus"].alias("minus"))).alias("near")))
    rows = met.select(F.explode(told).alias("t")).where(F.size("t.near") > 0)
    return rows.groupBy("t.rank").agg(F.sum(F.size("t.near")).cast("long").alias("n_near"), F.max(F.array_max("t.near")).alias("best"))


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_n: int = 2, ratio: int = 10, every: int | None = 31
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row each word of the corpus.

    Words are maximal runs of letters (ASCII and U+00C0 to U+00FF), A-Z lower-cased, of ``least_length`` or more
    characters and ``least_n`` occurrences in all texts. With ``every``, where it divides the crc32 of ``<doc_id>:<run>`` the
    run's character crc32 % length is deleted first (None: nowhere). Two words are near if they differ by one inserted, deleted
    or replaced character. form: the near word of greatest n (ties: the first in code-point order), if that is
    ``ratio`` times the word's n or more, else null; root: the last of the chain of forms, or the word itself.
    Null and empty texts hold no word; of rows without doc_id nothing is deleted; repeated rows count each; long texts
    and long words count whole. Other columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    runs = runs_of(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "doc_id", "text", least_length)
    word = F.coalesce(with_typos(runs, every), F.col("run")) if every else F.col("run")
    counted = runs.groupBy(word.alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= least_n) & (F.length("word") >= least_length))
    counted = materialize(counted, "words")
    parts = shuffle_parts(spark)
    words = materialize(trie_nodes(counted, "word", parts), "words")
    ends = trie_nodes(words.select(F.reverse("word").alias("back"), F.col("rank").alias("of")), "back", parts).select(F.col("of").alias("rank"), F.col("nodes").alias("ends"))
    near = materialize(near_words(words.join(ends, "rank")), "near")
    plain = words.select("rank", "word", "n").join(near, "rank", "left")
    has_form = F.col("best.n") >= ratio * F.col("n")
    plain = materialize(
        plain.select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.n")).alias("form_n"), F.when(has_form, -F.col("best.minus")).alias("form_rank")
        ),
        "forms",
    )
    roots = last_of(plain.where("form_rank is not null").select(F.col("rank").alias("node"), F.col("form_rank").alias("to")))
    named = plain.select(F.col("rank"), F.col("word"))
    by_rank = lambda r, w: named.select(F.col("rank").alias(r), F.col("word").alias(w))
    out = plain.join(roots.select(F.col("node").alias("rank"), F.col("to").alias("root_rank")), "rank", "left")
    out = out.join(by_rank("form_rank", "form"), "form_rank", "left").join(by_rank("root_rank", "root"), "root_rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_of(steps: DataFrame) -> DataFrame:
    """(node, to): where following ``steps`` (node, to), which have no circle, ends. Each round doubles the steps taken."""
    steps = materialize(steps, "steps")
    while True:
        further = steps.select(F.col("node").alias("to"), F.col("to").alias("last"))
        longer = materialize(steps.join(further, "to", "left").select("node", F.coalesce("last", "to").alias("to"), F.col("last").isNotNull().alias("moved")), "steps")
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        steps = longer.drop("moved")
