"""N-gram Jaccard join: documents whose word-shingle sets are alike, and the groups that these links form.

Rare-first prefix filtering: shingles are ordered by how many documents have them (a count sketch over all
documents, then the hash). Two sets whose overlap must be o share a shingle among their first n - o + 1 in that
order, so only those prefixes are shuffled. Equal sets are one node. The rows of a prefix shingle form a run, in
order of set size:

1. Each row is paired with the row before it and with the first of its run. Rows with the fewest rare shingles of
   their own come first, in a group of near copies those nearest to its centre, so that these few pairs a row join
   nearly all of the group. Length and positional filters, then a suffix filter (sizes of 64 hash ranges bound the
   overlap), leave pairs that are verified on their whole sets.
2. Runs of more than two rows that still hold several components give the other pairs across components, each row
   outside the run's most frequent component with the rest. These are all pairs that can still change a component.
   Where many rows are outside, they are dealt to several tasks, each with a copy of the rest.

So no link between components is lost, no pair is verified twice, and a group of copies never gives all its pairs.
A frequent shingle's run is dealt to several tasks by salt; its first row over all tasks is found by aggregation, and
step 2 meets all of it again through a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thawline.llm import textbytes as tb
from thawline.llm.common import materialize, shuffle_parts, spread
from thawline.llm.components import components

SKETCH_BITS = 22
BLOCK_BITS = 16
RANGES = 64
#: Rows of a run that one task gets, by the sketch.
RUN_ROWS = 1000
#: Parts that the rows of a frequent shingle are dealt to where they meet its first row.
SHARES = 16
_SEEN = 1 << 20
#: Bytes of texts, and of compressed ones, that a task holds as words and shingles at once: some 25 bytes each.
SLICE = 1 << 20
PACKED_SLICE = 1 << 18


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and n+1 offsets of the rows."""
    data, offsets = tb.buffers(column)
    words, rows = tb.scan(data, offsets, tb.NOT_SPACE), len(offsets) - 1
    g = tb.grams(words.hash, k)
    inside = words.doc[: len(g)] == words.doc[k - 1 :] if len(g) else np.zeros(0, bool)
    doc, g = words.doc[: len(g)][inside], g[inside]
    count = np.bincount(words.doc, minlength=rows)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = [tb.grams(words.hash[first[r] : first[r] + count[r]], int(count[r]))[0] for r in short]
        doc, g = np.concatenate((doc, short)), np.concatenate((g, np.array(whole, np.uint64)))
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[new], g[new]
    return g, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=rows))))


def _signature(g: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix(g ^ np.uint64(seed)), dtype=np.uint64)))
    n = np.diff(offsets).astype(np.uint64)
    return tb.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ (n << np.uint64(32))).view(np.int64)


def signatures(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each row's set, the same whenever the set is."""
    return _signature(g, offsets, 0xA5A5A5A5A5A5A5A5), _signature(g, offsets, 0x3C6EF372FE94F82B)


def _resolved(g: np.ndarray, offsets: np.ndarray, shared: list[int]) -> np.ndarray:
    """The first number, or the second where unlike sets share the first."""
    sig, other = signatures(g, offsets)
    return np.where(np.isin(sig, shared), other, sig) if shared else sig


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """A row (doc_id, n, sig, other) a document, and a task's counts of shingles by hash range (block, part, data)."""

    names = ["doc_id", "n", "sig", "other", "block", "part", "data"]

    def work(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for big in batches:
            for batch in tb.slices(big, "text", SLICE):
                g, offsets = shingle_sets(_column(batch, "text"), k)
                np.add.at(counts, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                n = np.diff(offsets)
                rows = len(n)
                none = lambda t: pa.nulls(rows, t)  # noqa: B023, E731
                told = [pa.array(x, mask=n == 0) for x in signatures(g, offsets)]
                yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(n), *told, none(pa.int32()), none(pa.int32()), none(pa.binary())], names=names)
        part = TaskContext.get().partitionId()
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(1))
        data = [_pack(blocks[b]) for b in used]
        m = len(used)
        if m:
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int32()), pa.array([part] * m, pa.int32()), pa.array(data, pa.binary())], names=names)

    return docs.mapInArrow(work, "doc_id long, n long, sig long, other long, block int, part int, data binary")


def _pack(counts: np.ndarray) -> bytes:
    """Non-zero counts as (place, count) or, if they are many, all, in as few bytes each as the greatest needs."""
    at = np.flatnonzero(counts)
    some = 4 * len(at) < len(counts)
    values = counts[at] if some else counts
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(values.max(initial=0)) <= np.iinfo(k).max)
    return (b"s" if some else b"d") + kind[1:].encode() + (at.astype("<u2").tobytes() if some else b"") + values.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    kind, body = f"<{data[1:3].decode()}", data[3:]
    if data[:1] == b"d":
        return np.frombuffer(body, kind).astype(np.uint64)
    n = len(body) // (2 + np.dtype(kind).itemsize)
    out = np.zeros(1 << BLOCK_BITS, np.uint64)
    out[np.frombuffer(body, "<u2", n)] = np.frombuffer(body, kind, n, 2 * n)
    return out


def sketch(described: DataFrame) -> np.ndarray:
    """Counts of all documents by hash range: 2^22 numbers, whatever the input. Tasks' counts are added 256 at a time."""

    def add(key, table):
        total = sum(_unpack(x.as_py()) for x in table.column("data"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([_pack(total)], pa.binary())})

    rows = described.where("block is not null").select("block", "part", "data")
    for _ in range(2):
        rows = rows.withColumn("part", F.expr("cast(part div 256 as int)")).groupBy("block", "part").applyInArrow(add, "block int, part int, data binary")
    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint64)
    for r in rows.toLocalIterator():
        out[r["block"]] += _unpack(bytes(r["data"]))
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def prefixes(docs: DataFrame, shared, usual: float, k: int, num: int, den: int, doubtful: list[int]) -> DataFrame:
    """Rows (token, salt, own, sig, n, pos) of every set's prefix; equal sets of a task once. own: its rare shingles.

    shared: the sketch's counts, broadcast; usual: their median.
    """
    rare = usual + max(2, 6 * usual**0.5)
    hot = usual + max(RUN_ROWS, 6 * usual**0.5)

    def work(batches):
        counts, seen = shared.value, set()
        for big in batches:
            for batch in tb.slices(big, "text", SLICE):
                g, offsets = shingle_sets(_column(batch, "text"), k)
                sig, n = _resolved(g, offsets, doubtful), np.diff(offsets)
                df = counts[g >> np.uint64(64 - SKETCH_BITS)]
                doc = np.repeat(np.arange(len(n)), n)
                own = np.bincount(doc[df <= rare], minlength=len(n))
                order = np.lexsort((g, df, doc))
                pos = np.arange(len(g)) - offsets[doc]
                fresh = np.zeros(len(n), bool)
                for r, s in enumerate(sig.tolist()):
                    if n[r] and s not in seen:
                        fresh[r] = True
                        if len(seen) < _SEEN:
                            seen.add(s)
                most = n - -(-n * num // den) + 1
                keep = (pos < most[doc]) & fresh[doc]
                at, doc, pos = order[keep], doc[keep], pos[keep]
                token, over = g[at], df[at].astype(float)
                salts = np.where(over > hot, np.ceil((over - usual) / RUN_ROWS), 1).astype(np.int64)
                salt = np.where(salts > 1, 1 + (sig[doc] & 0x7FFFFFFF) % salts, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(salt, pa.int32()), pa.array(own[doc], pa.int32()), pa.array(sig[doc]), pa.array(n[doc], pa.int32()), pa.array(pos, pa.int32())],
                    names=["token", "salt", "own", "sig", "n", "pos"],
                )

    return docs.mapInArrow(work, "token long, salt int, own int, sig long, n int, pos int")


def _can_link(n1, p1, n2, p2, num: int, den: int):
    """Length and positional filters for a shared token at p1 and p2."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    return (den * low >= num * high) & ((den + num) * np.minimum(n1 - p1, n2 - p2) >= num * (n1 + n2))


def runs(rows: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Rows of runs of two and more: (token, own, sig, n, pos, whole, size, before, head), the last two where they pass the filters.

    whole: the run isn't dealt to several tasks.
    """
    dealt = rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "own", "n", "sig")

    def work(batches):
        held = None
        for batch in _with_end(batches):
            now = None if batch is None else [_column(batch, c).to_numpy() for c in ("token", "salt", "own", "sig", "n", "pos")]
            if held is not None:
                now = held if now is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if now is None or not len(now[0]):
                continue
            if batch is not None:
                last = np.searchsorted(now[0], now[0][-1], "left")
                held, now = [x[last:] for x in now], [x[:last] for x in now]
            else:
                held = None
            token, salt, own, sig, n, pos = now
            if not len(token):
                continue
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            token, salt, own, sig, n, pos = (x[once] for x in (token, salt, own, sig, n, pos))
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(token)))
            head, size = np.repeat(start, size), np.repeat(size, size)
            i = np.flatnonzero((size > 1) | (salt > 0))
            prev = np.maximum(i - 1, head[i])
            ok_prev = (prev != i) & _can_link(n[i], pos[i], n[prev], pos[prev], num, den)
            h = head[i]
            ok_head = (h != i) & (h != prev) & _can_link(n[i], pos[i], n[h], pos[h], num, den)
            for a in range(0, len(i), 50_000):
                s = slice(a, a + 50_000)
                j = i[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(token[j]), pa.array(own[j]), pa.array(sig[j]), pa.array(n[j]), pa.array(pos[j]), pa.array(salt[j] == 0), pa.array(size[j], pa.int64()),
                        pa.array(sig[prev[s]], mask=~ok_prev[s]), pa.array(sig[h[s]], mask=~ok_head[s]),
                    ],
                    names=["token", "own", "sig", "n", "pos", "whole", "size", "before", "head"],
                )

    return dealt.mapInArrow(work, "token long, own int, sig long, n int, pos int, whole boolean, size long, before long, head long")


def _with_end(batches):
    yield from batches
    yield None


def candidate_sets(docs: DataFrame, ids: DataFrame, k: int, doubtful: list[int], few: bool = False) -> DataFrame:
    """(sig, n, sizes of hash ranges, text compressed) of the documents with ``ids``; compressed texts are what is shuffled.

    ``few``: ids may be few enough to be sent to the texts instead; Spark decides by their size.
    """

    def pack(batches):
        press = zstandard.ZstdCompressor(3).compress
        for big in batches:
            for batch in tb.slices(big, "text", SLICE):
                packed = [press(x.as_buffer()) if x.is_valid else press(b"") for x in _column(batch, "text")]
                yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    def work(batches):
        for big in batches:
            for batch in tb.slices(big, "packed", PACKED_SLICE):
                g, offsets = shingle_sets(_texts(_column(batch, "packed")), k)
                n = np.diff(offsets)
                doc = np.repeat(np.arange(len(n)), n)
                sizes = np.bincount(doc * RANGES + (g >> np.uint64(58)).astype(np.int64), minlength=len(n) * RANGES)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * RANGES), pa.array(sizes, pa.int32()))
                out = [pa.array(_resolved(g, offsets, doubtful)), pa.array(n, pa.int32()), lists, _column(batch, "packed")]
                yield pa.RecordBatch.from_arrays(out, names=["sig", "n", "sizes", "packed"]).filter(pa.array(n > 0))

    texts = docs.select("doc_id", "text").mapInArrow(pack, "doc_id long, packed binary")
    return (texts if few else texts.hint("shuffle_merge")).join(ids, "doc_id", "left_semi").mapInArrow(work, "sig long, n int, sizes array<int>, packed binary")


def _texts(packed: pa.Array) -> pa.Array:
    unpress = zstandard.ZstdDecompressor().decompress
    return pa.array([unpress(x.as_buffer()) for x in packed], pa.binary())


def verify(pairs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by suffix filter and then on whole sets."""
    small = lambda x: sets.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("sizes").alias(f"s{x}"))
    apart = F.expr("aggregate(zip_with(sa, sb, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)")
    total = F.col("na") + F.col("nb")
    near = pairs.join(small("a"), "a").join(small("b"), "b").where((total - apart) * (den + num) >= 2 * num * total)
    near = near.select("a", "b").distinct()
    full = lambda x: sets.select(F.col("sig").alias(x), F.col("packed").alias(f"p{x}"))

    def work(batches):
        for big in batches:
            for batch in tb.slices(big, "pa", PACKED_SLICE):
                (p, at), (q, to) = (shingle_sets(_texts(_column(batch, c)), k) for c in ("pa", "pb"))
                keep = []
                for r in range(batch.num_rows):
                    x, y = p[at[r] : at[r + 1]], q[to[r] : to[r + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "pa", "pb").mapInArrow(work, "a long, b long").distinct()


def _ordered(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs of all but white space, A-Z lower-cased. A set is the distinct k-word shingles of a whole text,
    or the text's word sequence if it has fewer; null, empty and blank texts have none and link with nothing. Two
    documents link when den * intersection >= num * union. component_id: least doc_id reachable by links, itself
    included. A repeated doc_id stands for each of its rows, which keep their own sets. A row without doc_id takes
    the component of an equal set, if there is one, else null, and carries no links on. Long texts count whole. Sets
    are known by two 64-bit numbers, shingles by one. Other columns are left out, whatever their names; an empty table
    gives an empty result.
    """
    parts = shuffle_parts(docs.sparkSession)
    docs = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    named = docs.where("doc_id is not null")
    described = materialize(describe(docs, k), "sets")
    rows = described.where("block is null").select("doc_id", "n", "sig", "other")
    least = [F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), (F.min("other") < F.max("other")).alias("doubtful")]
    classes = materialize(rows.where("sig is not null").groupBy("sig").agg(*least), "classes")
    # unlike sets of one number, of 10^11 sets some hundreds: those are known by their second number
    doubtful = sorted(r["sig"] for r in classes.where("doubtful").select("sig").collect())
    rows = rows.withColumn("sig", F.when(F.col("sig").isin(doubtful), F.col("other")).otherwise(F.col("sig"))).drop("other") if doubtful else rows.drop("other")
    if doubtful:
        classes = materialize(rows.where("sig is not null").groupBy("sig").agg(*least[:2]), "classes")
    classes = classes.where("rep is not null").select("sig", "rep", "last")
    counts = sketch(described)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    live = materialize(runs(prefixes(named, shared, float(np.median(counts)), k, num, den, doubtful), num, den, parts), "runs")
    shared.destroy()

    # the first row of a frequent shingle's run over all its tasks
    dealt = live.where("not whole").withColumn("share", F.pmod(F.col("sig"), F.lit(SHARES)))
    lead = materialize(dealt.groupBy("token").agg(F.min(F.struct("own", "n", "sig", "pos")).alias("lead")), "lead")
    lead = lead.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    ok = f"{den} * least(n, lead.n) >= {num} * greatest(n, lead.n) and {den + num} * least(n - pos, lead.n - lead.pos) >= {num} * (n + lead.n)"
    led = dealt.join(lead, ["token", "share"]).where(f"sig <> lead.sig and {ok}").select("sig", F.col("lead.sig").alias("other"))
    pairs = live.select("sig", F.explode(F.array("before", "head")).alias("other")).where("other is not null").unionByName(led)
    pairs = materialize(pairs.select(*_ordered("sig", "other")).distinct(), "pairs")
    sigs = lambda p: p.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    ids = lambda s: s.join(classes, "sig").select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(candidate_sets(named, ids(sigs(pairs)), k, doubtful), "candidates")
    links = materialize(verify(pairs, sets, k, num, den), "links")
    one = components(_by_rep(links, classes))

    label = classes.join(one.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("label"))
    rest = live.where("size > 2 or not whole").select("token", "sig", "n", "pos").distinct().join(label, "sig")
    by_label = rest.groupBy("token", "label").agg(F.count("*").alias("m"))
    mixed = by_label.groupBy("token").agg(F.max_by("label", "m").alias("main"), F.max("m").alias("most"), F.sum("m").alias("m"), F.count("*").alias("labels"))
    shares = F.ceil((F.col("m") - F.col("most")) / RUN_ROWS).alias("shares")  # tasks that a run's rows outside its main component are dealt to
    mixed = materialize(mixed.where("labels > 1").select("token", "main", shares), "mixed")
    open_rows = materialize(rest.join(mixed, "token"), "open")
    x = open_rows.where("label <> main").withColumn("share", F.pmod(F.xxhash64("sig"), F.col("shares"))).alias("x")
    y = open_rows.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).alias("y")
    both = F.expr(
        f"x.token = y.token and x.share = y.share and x.label <> y.label and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) "
        f"and {den + num} * least(x.n - x.pos, y.n - y.pos) >= {num} * (x.n + y.n)"
    )
    more = x.join(y, both).select(*_ordered("x.sig", "y.sig")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        missing = materialize(sigs(more).join(sets, "sig", "left_anti"), "missing")
        if not missing.isEmpty():
            sets = sets.unionByName(materialize(candidate_sets(named, materialize(ids(missing), "ids"), k, doubtful, few=True), "candidates"))
        links = links.unionByName(materialize(verify(more, sets, k, num, den), "links"))
        one = components(_by_rep(links, classes))

    moved = classes.join(one.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig", F.coalesce("component", "rep").alias("component"), (F.col("component").isNotNull() | (F.col("last") > F.col("rep"))).alias("grouped")
    )
    out = rows.join(materialize(moved.where("grouped").drop("grouped"), "moved"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _by_rep(links: DataFrame, classes: DataFrame) -> DataFrame:
    of = lambda c: classes.select(F.col("sig").alias(c), F.col("rep").alias(f"r{c}"))
    return links.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
