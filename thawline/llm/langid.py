"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to 3 letters, words padded by a boundary) in order. A
document's own most frequent n-grams are compared with each profile by out-of-place distance: the sum over them of
the difference in rank, or the profile's length for one that the profile lacks.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thawline.llm import textbytes as tb
from thawline.llm.common import add_columns

UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for code points of letters."""
    out = np.zeros(0x110000, bool)
    out[:0x30000] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x30000)]
    out[0x30000:0x32000] = True
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, and their counts. A boundary is 1, so that no two are one number; three code points fit 63 bits."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 1)
    c = np.concatenate(([1], c, [1]))
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    three = three[c[1:-1] != 1]
    return np.unique(np.concatenate((c[c != 1], two, three)), return_counts=True)


def top_grams(text: str, size: int) -> np.ndarray:
    """A text's most frequent n-grams in order; ties by number."""
    g, n = gram_counts(text)
    return g[np.argsort(-n, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400, salts: int = 16) -> DataFrame:
    """Profiles (lang, gram, rank) from all rows with a text and a language; ``size`` n-grams each.

    Tasks count first, so a shuffled row is a task's count of an n-gram, and the ranking goes over ``salts`` shares
    of each language before the last one, so that no task gets all n-grams of a language.
    """

    def count(batches):
        held: dict[str, list] = {}
        for big in batches:
            for batch in tb.slices(big, "text"):
                for t, k in zip(batch.column(0), batch.column(1), strict=True):
                    g, n = gram_counts(t.as_py())
                    held.setdefault(k.as_py(), []).append((g, n))
                for k, parts in held.items():
                    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    held[k] = [(g, np.bincount(at, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64))]
        for k, ((g, n),) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.pmod(F.xxhash64("gram"), F.lit(salts))
    order = [F.col("n").desc(), "gram"]
    part = F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))
    last = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (
        sums.withColumn("r", part).where(F.col("r") <= size).withColumn("rank", last - 1)
        .where(F.col("rank") < size).select("lang", "gram", F.col("rank").cast("int").alias("rank"))
    )


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = 400) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; other columns stay, of the same name are replaced.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; long texts are counted whole.
    score: the language's share of the similarities 1 - distance / greatest distance. Ties go to the first language in
    alphabetical order; repeated rows are treated alike; an empty table gives an empty result. The profiles (languages
    times ``size`` rows) are collected to be sent to the tasks.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int64)
    at = {g: i for i, g in enumerate(grams.tolist())}
    for r in rows:
        ranks[at[r["gram"]], langs.index(r["lang"])] = r["rank"]
    def one(t: str | None) -> tuple[str, float]:
        top = top_grams(t, size) if t and langs else ()
        if not len(top):
            return UNDETERMINED, 0.0
        i = np.searchsorted(grams, top)
        i[i == len(grams)] = 0
        r = ranks[np.where(grams[i] == top, i, len(grams))]
        away = np.where(r < 0, size, np.abs(r - np.arange(len(top))[:, None])).sum(0)
        like = 1 - away / (size * len(top))
        best = int(np.argmin(away))
        return langs[best], float(like[best] / like.sum()) if like.sum() > 0 else 1 / len(langs)

    def make(column: pa.Array) -> list[pa.Array]:
        out = [one(x.as_py()) for x in column]
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

    return add_columns(docs, text, make, "lang_pred string, score double")
