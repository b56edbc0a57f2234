"""The corpus pipeline: from raw documents to a training mixture.

Stages, in order: toxicity, language identification, SimHash near-dedup,
benchmark decontamination, mixing sources to target weights. Each stage takes
what its predecessor kept; all but the last return the columns of documents.

Every stage takes nulls in any column, blank and very long texts, repeated
rows, empty tables and further columns; what each does with them is said where
the operators are defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladelake.llm import decontamination, language_id, mixing, shared, simhash, toxicity

#: Learned models, a byte n-gram classifier and XXH64 fingerprints are not SQL: a test holds run() against decisions taken apart and joined by id.
ORACLE_SQL = None


def kept(docs: DataFrame, judge: Callable[[DataFrame, str, list[str]], DataFrame], rule: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` marks to hold ``rule``, with their own columns, whatever the names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return judge(plain, names[docs.columns.index("text")], names).where(rule).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go.

    Learned from the labels of documents of this stage's input whose
    crc32(doc_id) mod 4 is not 2, as in the query.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~shared.is_remainder("doc_id", 4, 2))
    model = toxicity.train(docs, labels)
    return kept(docs, lambda rows, text, names: toxicity.score(rows, model, text, names), "predicted = 0")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, blank, no letter) go.

    Ambiguous ones stay: ambiguity between languages that are all wanted is no
    reason to lose a clean document. If no row to learn from has a language,
    all texts with a letter stay.
    """
    model = language_id.train(docs.where(~shared.is_remainder("doc_id", 4, 2) & F.col("doc_id").isNotNull()))
    if model is None:
        return language_id.with_letter(docs)
    return kept(docs, lambda rows, text, names: language_id.identify(rows, model, text, names), f"lang_pred <> '{language_id.UND}'")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays.

    Where ids tell documents apart, only ids of documents that go are joined
    with the texts. Ids that repeat or are absent are no keys: there each
    component keeps its smallest id (none comes last) and, of its rows with
    that id, the one with the smallest fingerprint, then the smallest values.
    """
    found = shared.materialize(simhash.near_duplicates(docs), "dedup")
    if found.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        go = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(go, "doc_id", "left_anti").select(*docs.columns)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "simhash"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias("id_"), F.col("first.simhash").alias("fp_"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    marked = simhash.fingerprints(docs.toDF(*names), place["text"], names)
    rows = marked.join(kept, F.col(place["doc_id"]).eqNullSafe(F.col("id_")) & (F.col("simhash") == F.col("fp_")))
    ordered = [n for n, f in zip(names, docs.schema, strict=True) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one = rows.groupBy("id_", "fp_").agg(F.min_by(F.struct(*names), F.struct(*ordered)).alias("row"))
    return one.select(*[F.col(f"row.{n}").alias(c) for c, n in place.items()])


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten words, or a whole shorter item, of the benchmark go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept(docs, lambda rows, text, names: decontamination.search(rows, bench, text_col=text, keep=names), "not contaminated")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix of sources, 0 to 3."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", stage_toxicity),
    ("language_id", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.materialize(docs, f"stage-{name}")
    return docs
