"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text becomes an array of words; each ``gram`` consecutive words get a hash, and of every ``span - gram + 1``
consecutive hashes the least is kept, with its place. Any ``span`` words that two texts share then share a kept
hash. The benchmark's distinct windows (``span`` words; a shorter item is one window) have the hash that winnowing
keeps in them. Documents' kept hashes are joined with those, and each hit is extended left and right to the few windows
of the document that hold it, which are joined with the benchmark's word for word. A hash that many windows share so
gives no more rows than it has places in documents. For items shorter than ``span``, which winnowing can miss, all
hashes of documents are joined; that costs more, and only where there are such items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thawline.llm.common import materialize, spread

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Places are kept modulo this, in the low bits of a hash.
PLACES = 1 << 24


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; none for null."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _part(x: str, start: int, fewer: int) -> Column:
    """x from ``start`` (0 is the first) on, shorter by ``fewer`` than x."""
    return F.slice(x, start + 1, F.greatest(F.size(x) - fewer, F.lit(0)))


def with_hashes(df: DataFrame, words: str, gram: int, out: str) -> DataFrame:
    """Add the hashes of ``gram`` consecutive words, the low bits replaced by the place (from 0)."""
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    acc = _part("_h", 0, gram - 1)
    for k in range(1, gram):
        acc = F.zip_with(acc, _part("_h", k, gram - 1), lambda a, b: F.xxhash64(a, b))
    marked = F.transform(acc, lambda h, i: h.bitwiseAND(F.lit(-PLACES)).bitwiseOR((i % PLACES).cast("long")))
    return df.withColumn(out, marked).drop("_h")


def with_least(df: DataFrame, hashes: str, width: int, out: str) -> DataFrame:
    """Add the least of every ``width`` consecutive hashes, each once."""
    df, size = df.withColumn("_m1", F.col(hashes)), 1
    while 2 * size <= width:
        m = f"_m{size}"
        df = df.withColumn(f"_m{2 * size}", F.zip_with(_part(m, 0, size), _part(m, size, size), lambda a, b: F.least(a, b)))
        size *= 2
    m, rest = f"_m{size}", width - size
    least = F.zip_with(_part(m, 0, rest), _part(m, rest, rest), lambda a, b: F.least(a, b)) if rest else F.col(m)
    return df.withColumn(out, F.array_distinct(least)).drop(*[c for c in df.columns if c.startswith("_m")])


def _told(marks: str, g: int) -> Column:
    return F.transform(marks, lambda m: F.struct(F.lit(g).alias("g"), m.alias("mark")))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """(item_id, words) of every window of every item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("all")).where(F.size("all") > 0)
    n = F.size("all")
    windows = F.when(n <= span, F.array("all")).otherwise(F.transform(F.sequence(F.lit(1), n - (span - 1)), lambda i: F.slice("all", i, span)))
    return items.select("item_id", F.explode(windows).alias("words"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 10,
    gram: int = 4,
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated), a row for every row of ``docs``.

    A word is hit if it lies in an occurrence of a benchmark window. items: the ids, as sorted strings, of items
    with an occurring window. Null and empty texts have no words; long ones are searched whole; null and empty items
    have no windows; an item without id hits words but isn't listed. Repeated rows get equal rows each. Rows are known by
    doc_id (null too) and text_hash. Other columns are left out, whatever their names; empty tables give no rows, or no
    hits.

    The joins with the benchmark's hashes and windows, and that with the documents that hold any, are broadcasts only
    where Spark finds the written tables small enough; else rows are shuffled, and AQE splits what is hot.
    """
    width = span - gram + 1
    key = (F.col("mark").bitwiseAND(F.lit(-PLACES))).alias("key")
    place = (F.col("mark").bitwiseAND(F.lit(PLACES - 1))).cast("int")

    windows = materialize(benchmark_windows(benchmark, item_id, item_text, span), "windows")
    distinct = materialize(windows.select("words").distinct(), "distinct")
    full = with_least(with_hashes(distinct.where(F.size("words") == span), "words", gram, "h"), "h", width, "kept")
    prints = full.select(F.explode("kept").alias("mark"), F.lit(0).alias("g"))
    short = sorted(r[0] for r in windows.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    grams = sorted({min(m, gram) for m in short})
    for g in grams:
        fits = F.size("words").between(g, span - 1) if g == gram else F.size("words") == g
        own = with_hashes(distinct.where(fits), "words", g, "h")
        prints = prints.unionByName(own.select(F.element_at("h", 1).alias("mark"), F.lit(g).alias("g")))
    keys = materialize(prints.select("g", key).distinct(), "keys").withColumn("known", F.lit(True))

    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    split = with_least(with_hashes(rows.withColumn("words", words_of(F.col("text"))), "words", gram, "h"), "h", width, "kept")
    none = F.array(F.struct(F.lit(-1).alias("g"), F.size("words").cast("long").alias("mark")))
    parts = [none, _told("kept", 0)]
    for g in grams:
        if g != gram:
            split = with_hashes(split, "words", g, f"h{g}")
        parts.append(_told("h" if g == gram else f"h{g}", g))
    marks = split.select("doc_id", "text_hash", F.explode(F.concat(*parts)).alias("m")).select("doc_id", "text_hash", "m.g", "m.mark")
    marks = marks.withColumn("key", key).join(keys, ["g", "key"], "left").where("known or g = -1")
    marks = materialize(marks.select("doc_id", "text_hash", "g", "mark"), "marks")

    counted = marks.where("g = -1").select("doc_id", "text_hash", F.col("mark").alias("n_words"))
    held = marks.where("g >= 0").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("g", place.alias("place"))).alias("marks"))
    held = materialize(held.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}), "held")
    some = rows.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    some = some.select("doc_id", "text_hash", "marks", words_of(F.col("text")).alias("words"))
    n = F.size("words")

    def places(m: Column) -> Column:
        """A place is known modulo PLACES; longer texts are tried at each."""
        return F.sequence(m.place.cast("long"), F.greatest(m.place.cast("long"), n.cast("long")), F.lit(PLACES).cast("long"))

    def around(m: Column) -> Column:
        """(start, size) of the windows that a mark can lie in."""
        found = lambda p, a, b, size: F.when(a <= b, F.transform(F.sequence(a, b), lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"))))
        none = F.array().cast("array<struct<start:int,size:int>>")
        kinds = [(0, span, span - gram)] + [(min(x, gram), x, 0) for x in short]
        each = [F.when(m.g == g, F.flatten(F.transform(places(m), lambda p: F.coalesce(  # noqa: B023
            found(p, F.greatest(p.cast("int") - before, F.lit(0)), F.least(p.cast("int"), n - size), size), none)))) for g, size, before in kinds]  # fmt: skip  # noqa: B023
        return F.concat(*[F.coalesce(x, none) for x in each])

    near = F.array_distinct(F.flatten(F.transform("marks", around)))
    near = F.transform(near, lambda x: F.struct(x.start.alias("start"), F.slice("words", x.start + 1, x["size"]).alias("words")))
    tried = some.select("doc_id", "text_hash", F.explode(near).alias("x")).select("doc_id", "text_hash", "x.start", "x.words")
    hits = materialize(tried.join(distinct, "words").select("doc_id", "text_hash", "start", "words"), "hits")

    spans = F.array_sort(F.collect_set(F.struct("start", F.size("words").alias("size"))))
    begun = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    to = lambda x: F.greatest(x.start + x["size"], F.lit(0))
    more = lambda s, x: F.struct(F.greatest(s.end, to(x)).alias("end"), (s.n + F.greatest(to(x) - F.greatest(s.end, x.start), F.lit(0))).alias("n"))
    once = hits.groupBy("doc_id", "text_hash").agg(F.aggregate(spans, begun, more, lambda s: s.n).alias("n_hit"))
    listed = hits.select("doc_id", "text_hash", "words").distinct().join(windows, "words")
    listed = listed.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    a, b, c = counted.alias("a"), once.alias("b"), listed.alias("c")
    on = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}.text_hash") == F.col(f"{y}.text_hash"))
    told = materialize(b.join(c, on("b", "c"), "left").select("b.*", "c.items"), "found").alias("b")
    out = a.join(told, on("a", "b"), "left")
    return out.select(
        "a.doc_id", "a.text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
