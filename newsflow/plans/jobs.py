"""Whole jobs on a stored message table: load, dump, enrich, list."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.operators.select import by_source, skip_processed
from newsflow.plans import enrich
from newsflow.schema import KEY
from newsflow.scratch import materialise, scoped, scratch_path, temporary
from newsflow.sources import jsonl, store

#: Steps by rules that need no lexicon; each takes and returns messages.
RULES = {
    "clean_ner": enrich.clean_ner_by_rules,
    "summary": enrich.summary_by_rules,
    "embeddings": enrich.embeddings_by_rules,
}
FIELDS = enrich.FIELDS


def load_files(spark: SparkSession, folder: str, path: str, pattern: str = "*.json*",
               recursive: bool = True, rejects: str | None = None) -> int:
    """Import JSONL files and dumps; returns the number of lines that cannot be read.

    Identical texts of import files are one message, from whichever source they
    come; dumped messages keep their keys. Unreadable lines go to the folder
    ``rejects``, if one is named.
    """
    with temporary(spark) as keep:
        # parsed once: imports, dumps and rejects are read from the staged lines
        lines = keep(jsonl.staged(jsonl.scan_jsonl(spark, folder, pattern, recursive)), "lines")
        for state, key in (("import", ("message_id",)), ("dump", KEY)):
            part = lines.filter(F.col("state") == state).select("message.*")
            if not part.isEmpty():
                store.write_messages(spark, path, part, key_cols=key,
                                     order_cols=("publish_date", "source"))
        bad = lines.filter(F.col("state") == "rejected").select("line.*")
        if rejects:
            bad.write.mode("append").json(rejects)
        return bad.count()


def dump_files(spark: SparkSession, path: str, folder: str, source: str | None = None) -> None:
    jsonl.dump_by_source(store.scan_store(spark, path), folder, source)


def rule_steps(tonality_lexicon: DataFrame, category_lexicon: DataFrame) -> dict[str, Callable]:
    """All steps by rules."""
    return {**RULES,
            "tonality": lambda m: enrich.tonality_by_rules(m, tonality_lexicon),
            "category": lambda m: enrich.category_by_rules(m, category_lexicon)}


def run_step(spark: SparkSession, path: str, name: str, step: Callable[[DataFrame], DataFrame],
             source: str | None = None, reprocess: bool = True) -> None:
    """Enrich the stored messages of one source, or of all, by one step and merge the result.

    Without ``reprocess`` only those that lack one of the step's fields.
    """
    messages = store.scan_store(spark, path).drop("publish_day")
    chosen = messages if source is None else by_source(messages, source)
    done = step(skip_processed(chosen, reprocess, FIELDS[name]))
    store.write_messages(spark, path, done.select(*KEY, "publish_date", *FIELDS[name]),
                         fixed_dates=True, unique=True)


def run_model_steps(spark: SparkSession, path: str, batch_fns: dict, source: str | None = None,
                    reprocess: bool = True, **options) -> DataFrame:
    """The same by a model, for all steps in ``batch_fns``; returns what failed.

    Without ``reprocess`` a message that lacks a field of any of the steps goes through all of them.
    """
    with scoped(spark):
        done = _model_steps(spark, path, batch_fns, source, reprocess, options)
        errors = [c for c in done.columns if c.endswith("_error")]
        store.write_messages(spark, path, enrich.message_columns(done), fixed_dates=True,
                             unique=True)
        failed = done.select(*KEY, *errors).dropna(how="all", subset=errors)
        out = scratch_path(spark, "failed")
        failed.write.parquet(out)
    return spark.read.schema(failed.schema).parquet(out)


def _model_steps(spark, path, batch_fns, source, reprocess, options) -> DataFrame:
    messages = store.scan_store(spark, path).drop("publish_day")
    chosen = messages if source is None else by_source(messages, source)
    fields = [field for step in batch_fns for field in FIELDS.get(step, ())]
    asked = skip_processed(chosen, reprocess, fields)
    # written before the table changes, which both the result and the report read
    return materialise(
        enrich.keep_stored(enrich.enrich_by_model(asked, batch_fns, **options), asked), "done")
