"""The enrichment steps, by rules or by a model, alone and as one chain."""

from functools import reduce

from pyspark.ml.feature import Binarizer, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from newsflow.functions import rules, text
from newsflow.operators import batches, scoring
from newsflow.operators.ledger import score_once
from newsflow.operators.merge import join_on_key
from newsflow.operators.select import by_source
from newsflow.schema import CATEGORIES, KEY, MESSAGE, TONALITIES
from newsflow.scratch import materialise


# The generation options of the steps, the order of a full run,
# the width of the vectors and the label given where no word of a lexicon hits.
LOW = {"temperature": 0.4, "top_p": 0.95, "top_k": 40}
HIGH = {"temperature": 0.8, "top_p": 0.8}
STEP_SETUPS = {"clean_ner": LOW, "summary": HIGH, "tonality": HIGH, "category": HIGH}
CHAIN = ("tonality", "category", "summary", "clean_ner", "embeddings")
FIELDS = {"clean_ner": ("cleared_text", "named_entities"), "summary": ("summary",),
          "tonality": ("tonality",), "category": ("category",),
          "embeddings": ("embedding_sts", "embedding_clf")}
ALLOWED = {"tonality": TONALITIES, "category": CATEGORIES}
DIMENSIONS = 768
DEFAULT_TONALITY = "нейтральна"
DEFAULT_CATEGORY = "соціальні питання"


# --- rules ------------------------------------------------------------------

def clean_ner_by_rules(messages: DataFrame) -> DataFrame:
    return (messages.withColumn("cleared_text", rules.clean(F.col("initial_text")))
            .withColumn("named_entities", rules.entities(F.col("cleared_text"))))


def summary_by_rules(messages: DataFrame) -> DataFrame:
    return (messages.withColumn("_cleaned", rules.clean(F.col("initial_text")))
            .withColumn("summary", rules.summary(F.col("_cleaned"))).drop("_cleaned"))


def tonality_by_rules(messages: DataFrame, lexicon: DataFrame, default: str = DEFAULT_TONALITY,
                      tokens: Column | None = None) -> DataFrame:
    return rules.label_by_lexicon(messages, lexicon, TONALITIES, default, "tonality", tokens)


def category_by_rules(messages: DataFrame, lexicon: DataFrame, default: str = DEFAULT_CATEGORY,
                      tokens: Column | None = None) -> DataFrame:
    return rules.label_by_lexicon(messages, lexicon, CATEGORIES, default, "category", tokens)


def embeddings_by_rules(messages: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Hashed word counts as vectors of length one: counts for similarity, presence for classes."""
    worded = messages.withColumn("_words", text.words(F.coalesce("cleared_text", F.lit(""))))
    # presence follows from the counts, so words are hashed once
    counted = HashingTF(numFeatures=dimensions, inputCol="_words",
                        outputCol="_counts").transform(worded)
    counted = Binarizer(threshold=0.0, inputCol="_counts", outputCol="_present").transform(counted)
    for name, weights in (("embedding_sts", "_counts"), ("embedding_clf", "_present")):
        unit = Normalizer(p=2.0, inputCol=weights, outputCol="_unit").transform(counted)
        vector = vector_to_array("_unit", "float32")
        counted = unit.withColumn(name, F.when(F.col("cleared_text").isNotNull(), vector)) \
            .drop("_unit")
    return counted.drop("_words", "_counts", "_present")


def enrich_all_by_rules(messages: DataFrame, tonality_lexicon: DataFrame,
                        category_lexicon: DataFrame, embeddings: bool = True,
                        dimensions: int = DIMENSIONS) -> DataFrame:
    """Every step in one pass over the messages; nothing is shuffled."""
    # both labels score the same words, so a text is split once
    tokens = F.col("_tokens")
    done = messages.withColumn("_tokens", text.words(F.col("initial_text")))
    done = tonality_by_rules(done, tonality_lexicon, tokens=tokens)
    done = category_by_rules(done, category_lexicon, tokens=tokens).drop("_tokens")
    done = clean_ner_by_rules(done)
    done = done.withColumn("summary", rules.summary(F.col("cleared_text")))
    return embeddings_by_rules(done, dimensions) if embeddings else done


# --- model ------------------------------------------------------------------

def model_step(chunked: DataFrame, requests: DataFrame, step: str, batch_fn,
               template: str = "{texts}", setup: dict | None = None, ledger: str | None = None,
               **pace) -> DataFrame:
    """One text step by a model, as rows ``(source, message_id, <fields>, <step>_error)``.

    ``batch_fn`` gets the requests and the setup's options with the step's name under ``step``.

    The replies are written once before they are parsed: they cost money and
    would differ on a second call. With a ``ledger`` (a folder) they outlive the job, and a request
    that it answers is not asked again.
    """
    answers = _replies(requests, step, batch_fn, template, setup, ledger, **pace)
    fields = [*FIELDS[step], f"{step}_error"]
    return _aligned(chunked.select(*KEY, "batch_id", "n"), answers, step).select(*KEY, *fields)


def _replies(requests: DataFrame, step: str, batch_fn, template: str = "{texts}",
             setup: dict | None = None, ledger: str | None = None, **pace) -> DataFrame:
    """The written replies of a step, one per batch."""
    setup = {**(STEP_SETUPS[step] if setup is None else setup), "step": step}
    work = requests.transform(batches.to_prompt, template)

    def ask(asked, _):
        return batch_fn(asked, setup)

    return materialise(score_once(work, ask, ledger, step, setup, **pace) if ledger
                       else scoring.score_batches(work, ask, **pace), "answers")


def _aligned(placed: DataFrame, answers: DataFrame, step: str) -> DataFrame:
    """``placed`` (keys, ``batch_id``, ``n``, fields of other steps) with the fields of this step.

    Steps that follow each other join by batch and number, so rows once dealt by these stay."""
    if step == "clean_ner":
        aligned = batches.align_answers(placed, batches.parse_clean_ner(answers), answers)
        values = [F.col("cleared_text"), F.col("named_entities")]
        found, problem = F.col("cleared_text"), F.lit(None).cast("string")
    else:
        aligned = batches.align_answers(placed, batches.parse_single(answers), answers)
        value, problem = F.col("value"), F.lit(None).cast("string")
        if step in ALLOWED:
            known = F.col("value").isin(list(ALLOWED[step]))
            value = F.when(known, F.col("value"))
            problem = F.when(~known, F.concat(F.lit("unknown value: "), F.col("value")))
        values, found = [value.alias(step)], F.col("value")
    return aligned.select(*placed.columns, *values, F.coalesce(
        "error", problem, F.when(found.isNull(), "not answered")).alias(f"{step}_error"))


def embeddings_step(messages: DataFrame, embed_fn, **pace) -> DataFrame:
    """Both vectors by a model, as rows ``(source, message_id, <vectors>, embeddings_error)``."""
    return materialise(
        scoring.embed_texts(messages, embed_fn, **pace)
        .withColumnRenamed("error", "embeddings_error"), "vectors")


def _texts_to_embed(result: DataFrame, messages: DataFrame) -> DataFrame:
    """Keys and the cleared text that each message will have: the new one, or where its step
    failed or was not asked the one that ``messages`` holds."""
    if "cleared_text" not in result.columns:
        return messages.select(*KEY, "cleared_text")
    if "cleared_text" not in messages.columns:
        return result.select(*KEY, "cleared_text")
    both = join_on_key(result.select(*KEY, "cleared_text"), messages.select(
        *KEY, F.col("cleared_text").alias("_stored")), KEY, "left")
    return both.select(*KEY, F.coalesce(
        F.nullif("cleared_text", F.lit("")), "_stored").alias("cleared_text"))


def _name_missing_vectors(texts: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` for every message of ``texts``; where a vector is missing, the error says why."""
    rows = join_on_key(texts, made, KEY, "left")
    no_text = F.coalesce("cleared_text", F.lit("")) == ""
    missing = F.col("embedding_sts").isNull() | F.col("embedding_clf").isNull()
    return rows.select(*KEY, "embedding_sts", "embedding_clf", F.coalesce(
        "embeddings_error", F.when(no_text, "no cleared text"),
        F.when(missing, "not answered")).alias("embeddings_error"))


def enrich_by_model(messages: DataFrame, batch_fns: dict, templates: dict | None = None,
                    setups: dict | None = None, batch: int = batches.BATCH,
                    ledger: str | None = None, **pace) -> DataFrame:
    """The steps named in ``batch_fns`` (an ``embeddings`` entry takes ``(texts, kind)``).

    A ``ledger`` keeps the replies of the text steps. Returns keys and new fields only, ready for a merge by key. The batches are
    cut once and serve every text step.
    """
    unknown = set(batch_fns) - set(CHAIN)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    # only keys are numbered and aligned; texts join them for the requests
    chunked = materialise(batches.chunk(messages.select(*KEY, "publish_date"), batch), "chunked")
    result, cleared = chunked.select(*KEY, "publish_date", "batch_id", "n"), None
    requests = batches.batch_texts(
        join_on_key(chunked, messages.select(*KEY, "initial_text"), KEY))
    if len(set(batch_fns) - {"embeddings"}) > 1:
        requests = materialise(requests, "requests")
    for step in CHAIN:
        if step not in batch_fns:
            continue
        if step == "embeddings":
            # the other steps are not aligned for it
            texts = _texts_to_embed(result if cleared is None else cleared, messages)
            # a call takes a batch of texts, so call_size is for the text steps
            made = embeddings_step(texts, batch_fns[step],
                                   **{k: v for k, v in pace.items()
                                      if k not in ("call_size", "rounds")})
            result = join_on_key(result, _name_missing_vectors(texts, made), KEY, "left")
        else:
            answers = _replies(requests, step, batch_fns[step],
                               (templates or {}).get(step, "{texts}"),
                               (setups or {}).get(step), ledger, **pace)
            result = _aligned(result, answers, step)
            if step == "clean_ner":
                cleared = _aligned(chunked.select(*KEY, "batch_id", "n"), answers, step)
    return result.drop("batch_id", "n")


def setup_comparison(messages: DataFrame, batch_fn, setups, text_col: str = "initial_text",
                     **pace) -> DataFrame:
    """Each message's answer under every setup: a column per setup, null where it failed, and
    what went wrong then in ``<setup>_error``."""
    names = [str(setup["setup"]) for setup in setups]
    grid = batches.setup_grid(messages.select(*KEY, F.col(text_col).alias("request")), setups)
    scored = scoring.score_batches(grid, batch_fn, id_cols=KEY,
                                   setup_cols=list(setups[0]), **pace)
    failed = F.coalesce(text.answer_failed(F.col("answer")), F.lit(False))
    told = scored.select(*KEY, "setup", F.when(~failed, F.col("answer")).alias("answer"),
                         F.coalesce("error", F.when(failed, F.col("answer"))).alias("error"))
    wide = told.groupBy(*KEY).pivot("setup", names).agg(
        F.max("answer").alias("answer"), F.max("error").alias("error"))
    return wide.select(*KEY, *[F.col(f"`{n}_answer`").alias(n) for n in names],
                       *[F.col(f"`{n}_error`") for n in names])


def enrich_by_source(messages: DataFrame, enrich, source: str | None = None) -> DataFrame:
    """Run ``enrich`` on one source's messages, or on all sources as one job."""
    return enrich(messages if source is None else by_source(messages, source))


def keep_stored(done: DataFrame, messages: DataFrame, first: bool = False) -> DataFrame:
    """``done`` with the fields of ``messages`` where a step failed.

    A step's failure shows in its ``<step>_error``. With ``first``, a field that
    ``messages`` has already stays whatever the step says now.
    """
    told = [s for s in CHAIN if f"{s}_error" in done.columns]
    fields = {f: s for s in (CHAIN if first else told) for f in FIELDS[s]
              if f in done.columns and f in messages.columns}
    if not fields:
        return done
    def before_in(field, prefix=""):
        before = F.col(prefix + field)
        if field in ("named_entities", "cleared_text"):
            before = F.when(F.coalesce(F.col(prefix + "cleared_text"), F.lit("")) != "", before)
        return before

    if messages.filter(reduce(Column.__or__, [before_in(f).isNotNull() for f in fields])).isEmpty():
        return done  # nothing to keep, so no join
    old = messages.select(*KEY, *[F.col(f).alias(f"_old_{f}") for f in fields])
    both = join_on_key(done, old, KEY, "left")
    for field, step in fields.items():
        before = before_in(field, "_old_")
        if first:
            both = both.withColumn(field, F.coalesce(before, F.col(field)))
        else:
            both = both.withColumn(field, F.when(F.col(f"{step}_error").isNotNull(), F.coalesce(
                F.col(field), before)).otherwise(F.col(field)))
    return both.drop(*[f"_old_{f}" for f in fields])


def message_columns(df: DataFrame) -> DataFrame:
    """``df`` cut to the columns of the message table."""
    return df.select(*[f.name for f in MESSAGE.fields if f.name in df.columns])
