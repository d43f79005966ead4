"""A corpus from raw documents to token files: each stage works on all that the one before kept."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thawline.llm import decontam, jaccard, mixing, queries, tokenfiles
from thawline.llm.common import free, materialize, noting, remove, shared_dir, small_batches, table

_left: list[str] = []


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns named by place, so that they clash with none of a stage's own."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def stage(work: Callable) -> Callable:
    """A stage that first removes what earlier stages wrote on their way; tables that ``docs`` is still read from stay.

    Spark removes shuffle files and broadcasts once the driver has collected what refers to them as garbage, so that is
    asked for as well, once a stage.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = docs.inputFiles()
            done = [path for path in _left if not any(path.split("/thawline/")[-1] in x for x in read)]
            free(spark, done)
            _left[:] = [path for path in _left if path not in done]
        with noting(_left):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject, at 0.7.

    Null and empty texts have the score of the base rate and stay; repeated rows stay or go together, rows without doc_id
    are scored like others. Columns keep their names and order, also one named as the score's are.
    """
    plain = _plain(docs)
    scored = queries.toxicity_scores(spark, plain, sf_dir, keep_text=True)
    with small_batches(spark):  # texts are scored while they are written
        return materialize(scored.where("predicted = 0").select(*plain.columns), "clean").toDF(*docs.columns)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id; a repeated row once. Rows without doc_id stay.

    Rows are known by doc_id and text, so unlike texts of one doc_id are documents of their own. Null and empty texts are
    in no group and stay. Of repeated rows that differ in other columns alone one stays, any of them.
    """
    text = F.coalesce("text", F.lit(""))
    one, other = F.xxhash64("doc_id", text), F.xxhash64(F.lit("other"), text, "doc_id")
    rows = materialize(docs.where("doc_id is not null").select(one.alias("one"), other.alias("other"), "doc_id").distinct(), "rows")
    # unlike rows of one number, of 10^11 rows some hundreds: those are known by their second number
    doubtful = sorted(r["one"] for r in rows.groupBy("one").agg((F.min("other") < F.max("other")).alias("x")).where("x").select("one").collect())
    known_by = lambda x, y: F.when(x.isin(doubtful), y).otherwise(x) if doubtful else x
    key = F.when(F.col("doc_id").isNotNull(), known_by(one, other))
    groups = materialize(jaccard.jaccard_components(docs.select(key.alias("doc_id"), "text")), "groups")
    groups = groups.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("component"))
    kept = rows.select(known_by(F.col("one"), F.col("other")).alias("_key"), "doc_id").join(groups, "_key")
    kept = materialize(kept.groupBy("component").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key"), "kept")
    plain = _plain(docs)
    keyed = plain.withColumn("_key", key)
    out = keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"])  # one exchange of the texts
    return out.unionByName(keyed.where("doc_id is null")).select(*plain.columns).toDF(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; repeated rows go together."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = materialize(found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_t"))
    plain = _plain(docs)
    return plain.join(found, same, "left_anti").toDF(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, each once at least: domains are raised to their weights, none is cut.

    Null and empty texts have no tokens and the rate of the prior; repeated rows, which share doc_id and text, are drawn alike.
    """
    labels = queries.domains_of(table(spark, sf_dir, "labels"))
    plain = _plain(docs)
    mixed = mixing.mix(plain, labels, {"high": 0.9, "low": 0.1}, least=1.0)
    return mixing.drawn(mixed, "doc_id", "text").select(*plain.columns).toDF(*docs.columns)


@stage
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and their index as read back: a row a document, null texts with the end id alone, null doc_ids first."""
    path = f"{shared_dir(spark)}/thawline/{uuid.uuid4().hex}/tokens.orc"
    tokenfiles.write_tokens(docs, path)
    with noting([]):  # the index stays as the files do, since the result is read from it
        return tokenfiles.token_index(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_ids),
]
#: SQL can't express the classifiers or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    for name, work in STAGES[:-1]:
        now: list[str] = []
        with noting(now):
            docs = materialize(work(spark, docs, sf_dir), name)
        remove(spark, written)  # what the stage before gave
        written = now
    return STAGES[-1][1](spark, docs, sf_dir)
