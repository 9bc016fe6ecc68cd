"""Every operator as a query over the sample tables."""

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.functions import rules, text
from newsflow.operators import (batches, ledger, merge, network, report, scoring, search, select, train)
from newsflow.plans import enrich
from newsflow.plans.tables import (CATEGORY_WORDS, CHANNELS, EPOCH_2024, TONALITY_WORDS,
                                   event_messages, lexicon, part_processed, table, text_feed, text_messages,
                                   turns, vectors)
from newsflow.schema import CATEGORIES, KEY, TONALITIES
from newsflow.scratch import materialise, scratch_path
from newsflow.sources import day_sketches, feed, jsonl, pages, store, word_index
from newsflow.streaming import flows

NOW = datetime.datetime(2024, 1, 31, 10, 0)
DEPTH = 10
SETUPS = [{"setup": "cold", "temperature": 0.0}, {"setup": "warm", "temperature": 0.4},
          {"setup": "hot", "temperature": 1.0}]
SEARCH = ["the", "nicht", "mail5", "que"]
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _ts(column="publish_date", name="publish_date"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def _long(column, name=None):
    return F.col(column).cast("long").alias(name or column)


def _joined(column, name=None):
    return F.array_join(column, ";").alias(name or column)


def _events(spark, sf):
    return event_messages(table(spark, sf, "events"))


def _event_stream(spark, sf, repeats=False):
    """``events`` as they come: in four portions, newest first, one file at a time.

    With ``repeats`` a portion brings some messages of the one before again.
    """
    folder, events = scratch_path(spark, "events"), table(spark, sf, "events")
    first, last = events.agg(F.min("ts").cast("timestamp").cast("long"),
                             F.max("ts").cast("timestamp").cast("long")).first()
    portion = F.least(F.lit(3), F.floor(
        (F.lit(last) - F.col("ts").cast("timestamp").cast("long")) * 4 / max(1, last - first)))
    for i in range(4):
        delivered = portion == i
        if repeats:
            delivered |= (portion == i - 1) & (F.col("event_type") == "purchase")
        events.filter(delivered).write.mode("append").parquet(folder)
    return feed.live_source(spark, folder, schema=EVENTS, fmt="parquet", maxFilesPerTrigger=1)


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over what there is and read its output."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    (stream.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, label + "-checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


# --- sources and sinks ---------------------------------------------------------

def _import_files(spark, sf) -> str:
    """``documents`` as JSONL import files; unlabelled quality leaves a text empty."""
    path = scratch_path(spark, "import")
    text_feed(spark, sf).select(
        F.date_format(F.timestamp_seconds(F.col("message_id") * 60), "yyyy-MM-dd'T'HH:mm:ssXXX")
        .alias("publish_date"), "source", "text").write.json(path)
    return path


def scan_jsonl(spark, sf):
    lines = jsonl.scan_jsonl(spark, _import_files(spark, sf), "*.json")
    return lines.select("publish_date", "source", "text")


def parse_message(spark, sf):
    lines = jsonl.scan_jsonl(spark, _import_files(spark, sf), "*.json")
    return jsonl.parse_message(lines).select("message_id", _ts(), "source", "initial_text")


def _filled_store(spark, sf) -> str:
    path = scratch_path(spark, "store")
    store.ensure_store(spark, path)
    store.write_messages(spark, path, part_processed(spark, sf))
    return path


def scan_store(spark, sf):
    return store.scan_store(spark, _filled_store(spark, sf)).select(
        "message_id", _ts(), "source", "initial_text", "cleared_text",
        F.size("named_entities").cast("long").alias("entities"),
        F.col("publish_day").cast("string").alias("publish_day"))


def dump_by_source(spark, sf):
    folder = scratch_path(spark, "dump")
    jsonl.dump_by_source(part_processed(spark, sf), folder)
    return jsonl.parse_message(jsonl.scan_dump(spark, folder)).select(
        "message_id", _ts(), "source", "initial_text", "cleared_text")


def rejected_lines(spark, sf):
    """``documents`` as import lines of which two thirds cannot be read."""
    path, n = scratch_path(spark, "bad-import"), F.col("doc_id")
    line = F.when(n % 3 == 0, F.concat(F.lit("no json: "), n)).when(
        n % 3 == 1, F.concat(F.lit('{"publish_date":17,"source":"s","text":["'), n, F.lit('"]}'))
    ).otherwise(F.to_json(F.struct(F.lit("2024-03-23T12:40:27+00:00").alias("publish_date"),
                                   "source", "text")))
    table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    lines = jsonl.scan_jsonl(spark, path, "*.txt")
    return jsonl.rejected(lines).select(F.coalesce(
        F.col(jsonl.CORRUPT), F.concat_ws(" ", "publish_date", "text")).alias("line"))


def live_source(spark, sf):
    stream = select.monitored(event_messages(_event_stream(spark, sf)), CHANNELS)
    return _drain(stream, "live").select("message_id", _ts(), "source", "initial_text")


def backfill(spark, sf):
    return select.backfill(_events(spark, sf), NOW, DEPTH).select("message_id", _ts(), "source")


PAGE = 500


def _paged(events: DataFrame, folder: str):
    """``events`` as pages, a channel per event type."""
    return pages.write_pages(events.select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("channel_id"),
        F.col("ts").cast("timestamp").alias("publish_date"), F.col("event_type").alias("source"),
        F.col("props").alias("text"), F.lit("").alias("message")), folder, PAGE)


def paged_feed(spark, sf):
    """The backfill from a feed of pages; none that ends before the cutoff is asked for."""
    client = _paged(table(spark, sf, "events"), scratch_path(spark, "pages"))
    pages.register_pages(spark, client, "event_pages", span=PAGE * 8)
    cutoff = datetime.datetime.combine(NOW.date() - datetime.timedelta(days=DEPTH), datetime.time())
    return pages.paged_feed(spark, "event_pages", cutoff).select(
        F.col("message_id").cast("string").alias("message_id"), _ts(), "source",
        F.col("text").alias("initial_text"))


def paged_feed_stream(spark, sf):
    """The stream of pages: half of the messages, a restart, then those that came since."""
    folder, out, checkpoint = (scratch_path(spark, label) for label in
                               ("pages", "read", "read-checkpoint"))
    events = table(spark, sf, "events")
    middle = events.agg(F.floor(F.avg("event_id")).alias("id")).first().id or 0
    for part in (F.col("event_id") < middle, F.col("event_id") >= middle):
        client = _paged(events.filter(part), folder)
        pages.register_pages(spark, client, "event_pages_live", span=PAGE * 8)
        stream = pages.paged_feed(spark, "event_pages_live", stream=True)
        (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out).select(
        F.col("message_id").cast("string").alias("message_id"), _ts(), "source",
        F.col("text").alias("initial_text"))


def ensure_store(spark, sf):
    path = _filled_store(spark, sf)
    store.ensure_store(spark, path)
    return report.count_by_source(store.scan_store(spark, path))


def source_catalogue(spark, sf):
    return feed.source_catalogue(text_messages(spark, sf))


# --- projections and filters ----------------------------------------------------

def non_empty_text(spark, sf):
    return select.non_empty_text(text_feed(spark, sf)).select(
        "message_id", "source", "message_text")


def by_source(spark, sf):
    return select.by_source(text_messages(spark, sf), "src7").select(
        "message_id", _ts(), "initial_text")


def by_date_range(spark, sf):
    return select.by_date_range(_events(spark, sf), datetime.date(2024, 1, 5),
                                datetime.date(2024, 1, 12)).select("message_id", _ts(), "source")


def unprocessed(spark, sf):
    return select.unprocessed(part_processed(spark, sf), 1000).select(
        "message_id", _ts(), "source", "initial_text")


def skip_processed(spark, sf):
    return select.skip_processed(part_processed(spark, sf)).select("message_id", "source")


def monitored(spark, sf):
    return select.monitored(_events(spark, sf), CHANNELS).select(
        "message_id", _ts(), "source", "channel_id")


def to_body(spark, sf):
    records = table(spark, sf, "pages").select(
        F.col("page_id").alias("message_id"),
        F.timestamp_seconds(F.col("page_id") * 60).alias("publish_date"),
        F.col("url").alias("source"), F.col("html").alias("message_text"))
    return select.to_body(records).select("message_id", _ts(), "source", "initial_text")


def from_stored(spark, sf):
    stored = table(spark, sf, "documents").join(
        table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    documents = stored.select(F.col("doc_id").alias("_id"), F.to_json(F.struct(
        F.date_format(F.timestamp_seconds(F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ssXX")
        .alias("publish_date"), "source", F.col("text").alias("initial_text"),
        F.array("lang", "source").alias("named_entities"),
        F.col("embedding").alias("embedding_sts"))).alias("_source"))
    total = F.aggregate("embedding_sts", F.lit(0.0), lambda sum, v: sum + v)
    return select.from_stored(documents).select(
        "message_id", _ts(), "source", "initial_text", _joined("named_entities"),
        F.coalesce(F.size("embedding_sts"), F.lit(0)).cast("long").alias("dims"),
        F.coalesce(F.round(total, 4), F.lit(0.0)).alias("total"))


def training_columns(spark, sf):
    trained = text_messages(spark, sf).join(vectors(spark, sf), "message_id") \
        .withColumn("cleared_text", text.clean_text(F.col("initial_text")))
    total = F.aggregate("embedding_clf", F.lit(0.0), lambda sum, v: sum + v)
    return select.training_columns(trained).select(
        "cleared_text", "tonality", F.size("embedding_clf").cast("long").alias("dims"),
        F.round(total, 4).alias("total"))


def limit_chunk(spark, sf):
    return select.limit_chunk(_events(spark, sf), 1000).select("message_id", _ts(), "source")


def newest_first(spark, sf):
    return select.newest_first(_events(spark, sf), NOW, DEPTH).select(
        "message_id", _ts(), "source")


# --- keyed writes -----------------------------------------------------------------

def _old_and_new(spark, sf):
    """Stored: system and user turns, enriched. Arriving: user turns edited, and the answers."""
    all_turns = turns(spark, sf)
    old = all_turns.filter(F.col("role") != "assistant") \
        .withColumn("cleared_text", text.clean_text(F.col("initial_text"))).drop("role")
    new = all_turns.filter(F.col("role") != "system") \
        .withColumn("initial_text", F.concat("role", F.lit(": "), "initial_text")).drop("role")
    return old, new


def upsert_merge(spark, sf):
    return merge.upsert_merge(*_old_and_new(spark, sf)).select(
        "source", "message_id", _ts(), "initial_text", "cleared_text")


def upsert_replace(spark, sf):
    return merge.upsert_replace(*_old_and_new(spark, sf)).select(
        "source", "message_id", _ts(), "initial_text", "cleared_text")


def backfill_union_live(spark, sf):
    events = _events(spark, sf)
    early = select.by_date_range(events, datetime.date(2024, 1, 1), datetime.date(2024, 1, 20))
    late = select.by_date_range(events, datetime.date(2024, 1, 11), datetime.date(2024, 1, 31))
    return merge.backfill_union_live(early, late).select(
        "message_id", _ts(), "source", "initial_text")


def dedup_exact(spark, sf):
    return merge.dedup_exact(text_messages(spark, sf)).select(
        "content_id", "message_id", _ts(), "source", "initial_text")


# --- batches ------------------------------------------------------------------------

def _chunked(spark, sf):
    return batches.chunk(text_messages(spark, sf))


def chunk(spark, sf):
    return batches.chunk(text_messages(spark, sf).drop("initial_text")).select(
        "source", "message_id", "batch_id", _long("n"))


def batch_texts(spark, sf):
    return batches.batch_texts(_chunked(spark, sf)).select(
        "source", "batch_id", _long("texts"), "request")


def _echoed(spark, sf, chunked):
    """Replies that repeat the texts of each batch, without those of messages in ``labels``."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("message_id"))
    answered = chunked.join(labels, "message_id", "left_anti")
    return batches.batch_texts(answered).withColumnRenamed("request", "answer") \
        .withColumn("error", F.lit(None).cast("string"))


def split_answers(spark, sf):
    answers = _echoed(spark, sf, _chunked(spark, sf))
    return batches.parse_single(answers).select("source", "batch_id", _long("n"), "value")


def _blocks(spark, sf):
    """Per source and batch a reply of blocks: the cleaned text, then its capitalised words."""
    chunked = enrich.clean_ner_by_rules(_chunked(spark, sf))
    block = F.concat(F.lit("|||Текст #"), F.col("n"), F.lit("\nДія 1: "), F.col("cleared_text"),
                     F.lit("\nДія 2: "), F.array_join("named_entities", "; "), F.lit("\n\n"))
    return (chunked.groupBy("source", "batch_id")
            .agg(F.sort_array(F.collect_list(F.struct("n", block.alias("block")))).alias("b"))
            .select("source", "batch_id", F.concat(F.lit(" \n"), F.array_join(
                F.transform("b", lambda x: x["block"]), "")).alias("answer")))


def split_blocks(spark, sf):
    return _blocks(spark, sf).select(
        "source", "batch_id", F.inline(text.split_blocks(F.col("answer")))).select(
        "source", "batch_id", _long("n"), "block")


def _one_block(spark, sf):
    messages = enrich.clean_ner_by_rules(text_messages(spark, sf))
    return messages.withColumn("block", F.concat(
        F.lit("Текст #1\nДія 1: "), F.col("cleared_text"), F.lit("\nДія 2: "),
        F.array_join("named_entities", ";"), F.lit(" ; a; ab;\n")))


def split_actions(spark, sf):
    return _one_block(spark, sf).withColumn("parts", text.split_actions(F.col("block"))).select(
        "message_id", "parts.cleared_text", "parts.entities")


def entity_list(spark, sf):
    parts = _one_block(spark, sf).withColumn("parts", text.split_actions(F.col("block")))
    return parts.select("message_id", _joined(text.entity_list(F.col("parts.entities")),
                                              "named_entities"))


def answer_failed(spark, sf):
    """Replies by label: the two failure texts for some, the text itself for the others."""
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("message_id"), "quality", "toxic")
    answer = (F.when(F.col("toxic") == 1, "\nSorry, no answer was found.")
              .when(F.col("quality") == 0, "model failed to answer. Error: 400 bad request")
              .otherwise(F.col("initial_text")))
    return text_messages(spark, sf).join(labels, "message_id", "left").select(
        "message_id", text.answer_failed(answer).cast("int").cast("long").alias("failed"))


def align_answers(spark, sf):
    chunked = _chunked(spark, sf)
    parsed = batches.parse_single(_echoed(spark, sf, chunked))
    return batches.align_answers(chunked, parsed).select(
        "message_id", "source", "batch_id", _long("n"), "value")


def setup_grid(spark, sf):
    return batches.setup_grid(text_messages(spark, sf), SETUPS).select(
        "message_id", "source", "setup", "temperature")


# --- reports --------------------------------------------------------------------------

def _lexicons(spark):
    return lexicon(spark, TONALITY_WORDS), lexicon(spark, CATEGORY_WORDS)


def unique_sources(spark, sf):
    return report.unique_sources(_events(spark, sf))


def count_by_source(spark, sf):
    """From feed to report: texts, cleaned, one row per identical text, counted by source.

    Only ids take part in the comparison; no text is shuffled.
    """
    messages = select.non_empty_text(text_feed(spark, sf)).select(
        F.col("message_id").cast("string").alias("message_id"), "source",
        text.content_id(text.clean_text(F.col("message_text"))).alias("content_id"))
    return report.count_by_source(
        merge.latest_per_key(messages, ("content_id",), ("source", "message_id")))


def category_distribution(spark, sf):
    done = enrich.category_by_rules(text_messages(spark, sf), _lexicons(spark)[1])
    return report.category_distribution(done).select(
        "category", "messages", F.round("share", 6).alias("share"))


def tonality_distribution(spark, sf):
    done = enrich.tonality_by_rules(text_messages(spark, sf), _lexicons(spark)[0])
    return report.tonality_distribution(done).select(
        "source", "tonality", "messages", F.round("share", 6).alias("share"))


def top_entities(spark, sf):
    return report.top_entities(enrich.clean_ner_by_rules(text_messages(spark, sf)), 20)


FIRST, LAST = datetime.date(2024, 1, 5), datetime.date(2024, 1, 20)


def _sketched(spark, sf) -> str:
    """Day sketches of ``documents`` over thirty days, of which half the sources came later."""
    path, folder = scratch_path(spark, "store"), scratch_path(spark, "days")
    messages = enrich.clean_ner_by_rules(text_messages(spark, sf).withColumn(
        "publish_date", F.timestamp_seconds(
            F.lit(EPOCH_2024) + F.col("message_id").cast("long") % 720 * 3600)))
    late = F.col("source").isin("src1", "src3", "src5")
    for part in (~late, late):
        days = store.write_messages(spark, path, messages.filter(part))
        day_sketches.update(spark, path, folder, days)
    return folder


def top_entities_by_days(spark, sf):
    """The entities named most often on some days, from the days' sketches."""
    return day_sketches.top_entities(spark, _sketched(spark, sf), 20, FIRST, LAST).select(
        "entity", "mentions")


def count_by_day(spark, sf):
    """Messages per day and source of some days, from the days' counts."""
    return day_sketches.count_by_day(spark, _sketched(spark, sf), FIRST, LAST).select(
        F.col("day").cast("string").alias("day"), "source", "messages")


def date_histogram(spark, sf):
    return report.date_histogram(_events(spark, sf)).select(
        F.col("day").cast("string").alias("day"), "source", "messages")


def _judged(spark, sf):
    """True label: ``quality``. Prediction: whether the text is long."""
    labels = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("label"))
    long_text = F.length(text.clean_text(F.col("text"))) >= 1000
    return table(spark, sf, "documents").join(labels, "doc_id").select(
        "label", F.when(long_text, "1").otherwise("0").alias("predicted"))


def confusion_matrix(spark, sf):
    matrix = train.confusion_matrix(_judged(spark, sf), ["0", "1"], "label")
    return matrix.select("label", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


def accuracy(spark, sf):
    return train.accuracy(_judged(spark, sf), "label").select(
        "messages", F.round("accuracy", 6).alias("accuracy"))


# --- functions --------------------------------------------------------------------------

def clean_text(spark, sf):
    return text_messages(spark, sf).select(
        "message_id", text.clean_text(F.col("initial_text")).alias("cleared"))


def clean_text_spaced(spark, sf):
    return text_messages(spark, sf).select(
        "message_id", text.clean_text_spaced(F.col("initial_text")).alias("cleared"))


def sanitize_name(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.sanitize_name(F.col("url")).alias("name"))


def content_id(spark, sf):
    return text_messages(spark, sf).select(
        "message_id", text.content_id(F.col("initial_text")).alias("content_id"))


def parse_ts(spark, sf):
    """Event times as text, in a form that depends on the event type."""
    written = F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss")
    value = (F.when(F.col("source") == "click", F.concat(written, F.lit("+02:00")))
             .when(F.col("source") == "view", F.concat(written, F.lit("-0330")))
             .when(F.col("source") == "purchase", F.concat(written, F.lit("Z")))
             .when(F.col("source") == "error", F.concat(written, F.lit(".5+00:00")))
             .otherwise(written))
    return _events(spark, sf).select("message_id", _ts(text.parse_ts(value), "parsed"))


def kyiv_hms(spark, sf):
    return _events(spark, sf).select(
        "message_id", text.kyiv_hms(F.unix_timestamp("publish_date")).alias("hms"))


# --- enrichment ----------------------------------------------------------------------------

def extract_noise(spark, sf):
    return text_messages(spark, sf).select(
        "message_id", rules.extract_noise(F.col("initial_text")).alias("noise"))


def enrich_clean_ner(spark, sf):
    return enrich.clean_ner_by_rules(text_messages(spark, sf)).select(
        "message_id", "cleared_text", _joined("named_entities"))


def enrich_summary(spark, sf):
    return enrich.summary_by_rules(text_messages(spark, sf)).select("message_id", "summary")


def enrich_tonality(spark, sf):
    return enrich.tonality_by_rules(text_messages(spark, sf), _lexicons(spark)[0]).select(
        "message_id", "tonality")


def tonality_by_join(spark, sf):
    """The path of large lexicons, on the small one."""
    words = _lexicons(spark)[0]
    done = rules.label_by_lexicon(text_messages(spark, sf), words, TONALITIES,
                                  enrich.DEFAULT_TONALITY, "tonality", inline_limit=0)
    return done.select("message_id", "tonality")


def enrich_category(spark, sf):
    return enrich.category_by_rules(text_messages(spark, sf), _lexicons(spark)[1]).select(
        "message_id", "category")


def enrich_embeddings(spark, sf):
    return _norms(enrich.embeddings_by_rules(enrich.clean_ner_by_rules(text_messages(spark, sf))))


def _norms(done):
    def norm(vector):
        return F.round(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda sum, v: sum + v * v)), 4)
    return done.select("message_id", F.size("embedding_sts").cast("long").alias("dims"),
                       norm("embedding_sts").alias("norm_sts"),
                       norm("embedding_clf").alias("norm_clf"))


def _texts(done):
    return done.select("message_id", "source", "tonality", "category", "summary", "cleared_text",
                       _joined("named_entities"))


def _all_steps(messages):
    """All five steps, written with the vectors: a plan would skip columns that nobody reads."""
    return materialise(enrich.enrich_all_by_rules(
        messages, *_lexicons(messages.sparkSession)), "enriched")


def enrich_all(spark, sf):
    return _texts(_all_steps(text_messages(spark, sf)))


def enrich_all_vectors(spark, sf):
    return _norms(_all_steps(text_messages(spark, sf)))


def enrich_by_source(spark, sf):
    return _texts(enrich.enrich_by_source(text_messages(spark, sf), _all_steps, "src7"))


def enrich_by_source_vectors(spark, sf):
    return _norms(enrich.enrich_by_source(text_messages(spark, sf), _all_steps, "src7"))


def score_batches(spark, sf):
    """Each message is answered with its length by a stand-in for a model."""
    def measure(requests, _):
        return ["\n".join(f"Текст #{number}: {len(body.strip())}" for number, body in
                          (part.split(": ", 1) for part in request.split("Текст #")[1:]))
                for request in requests]

    chunked = _chunked(spark, sf)
    answers = materialise(
        scoring.score_batches(batches.batch_texts(chunked), measure, call_size=16), "answers")
    aligned = batches.align_answers(chunked, batches.parse_single(answers), answers)
    return aligned.select("message_id", "source", F.col("value").alias("answer"))


def reply_ledger(spark, sf):
    """A first run in which a third of the lengths fails, a second that is asked those only, and a
    third that has nothing to ask: its model only fails."""
    path, asked = scratch_path(spark, "ledger"), text_messages(spark, sf).select(
        *KEY, F.col("initial_text").alias("request"))

    def model(name, fails):
        return lambda requests, setup: ["Error: 400" if fails(len(r)) else f"{name}:{len(r)}"
                                        for r in requests]

    for run in (model("first", lambda n: n % 3 == 0), model("second", lambda n: False),
                model("third", lambda n: True)):
        told = ledger.score_once(asked, run, path, "length", id_cols=KEY, call_size=64)
    return told.select(*KEY, "answer", "error")


def setup_comparison(spark, sf):
    """Each message is answered with its length, under three temperatures."""
    def measure(requests, setup):
        return [f"{setup['temperature']:.1f}/{len(request)}" for request in requests]

    told = enrich.setup_comparison(text_messages(spark, sf), measure, SETUPS, call_size=64)
    return told.select(*KEY, *[setup["setup"] for setup in SETUPS])


def _by_model(spark, sf):
    """All five steps by a stand-in for a model: batches out, replies back to their messages."""
    def numbered(requests, reply):
        return ["".join(reply(number, body.strip()) for number, body in
                        (part.split(": ", 1) for part in request.split("Текст #")[1:]))
                for request in requests]

    def answer(reply):
        return lambda requests, setup: numbered(requests, reply)

    def embed(texts, kind):
        """From ``<n> знаків``: n and the length, or n's remainder and 1."""
        counts = [float(body.split(" ")[0]) for body in texts]
        if kind == "similarity":
            return [[n, float(len(body))] for n, body in zip(counts, texts)]
        return [[n % 7, 1.0] for n in counts]

    return enrich.enrich_by_model(text_messages(spark, sf), {
        "tonality": answer(lambda n, body: f"Текст #{n}: "
                           f"{'Позитивна' if len(body) >= 1000 else 'невідома'}\n"),
        "category": answer(lambda n, body: f"Текст {n} : "
                           f"{'спорт' if body.endswith('.') else 'освіта'}\n"),
        "summary": answer(lambda n, body: f"Текст #{n}: Разом {len(body)}\n"),
        "clean_ner": answer(lambda n, body: f"|||Текст #{n}\nДія 1: {len(body)} знаків\n"
                                            f"Дія 2: {body[:1]}; Київ; {body[-3:]}\n\n"),
        "embeddings": embed,
    }, call_size=16)


def enrich_by_model(spark, sf):
    return _by_model(spark, sf).select(
        "message_id", "source", "tonality", "tonality_error", "category", "summary",
        "cleared_text", _joined("named_entities"))


def enrich_by_model_vectors(spark, sf):
    def listed(vector):
        return _joined(F.col(vector).cast("array<long>").cast("array<string>"), vector)
    return _by_model(spark, sf).select(
        "message_id", "source", listed("embedding_sts"), listed("embedding_clf"))


# --- search ------------------------------------------------------------------------------

def similar_topk(spark, sf):
    """The messages nearest to the centre of each label (as many queries as labels)."""
    embeddings = table(spark, sf, "embeddings")
    centres = (embeddings.select("label", F.posexplode("embedding").alias("place", "value"))
               .groupBy("label", "place").agg(F.avg("value").alias("value"))
               .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "value")))
                                     .alias("centre"))
               .select(F.col("label").cast("string").alias("query"),
                       F.transform("centre", lambda c: c["value"]).alias("vector")))
    messages = embeddings.select(F.col("vec_id").alias("message_id"),
                                 F.col("embedding").alias("embedding_sts"))
    return search.similar_topk(messages, centres, 10, id_cols=["message_id"]).select(
        "query", "message_id", F.round("score", 6).alias("score"), _long("rank"))


def similar_to_each(spark, sf):
    """How near the three messages nearest to each message are: as many queries as messages."""
    embeddings = table(spark, sf, "embeddings")
    queries = embeddings.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    messages = embeddings.select(F.col("vec_id").alias("message_id"),
                                 F.col("embedding").alias("embedding_sts"))
    return search.similar_topk(messages, queries, 3, id_cols=["message_id"]).select(
        "query", F.round("score", 6).alias("score"), _long("rank"))


def text_search_index(spark, sf):
    """The same search as :func:`text_search` by a word index, of which half came later."""
    path, index = scratch_path(spark, "store"), scratch_path(spark, "words")
    messages = text_messages(spark, sf).drop("cleared_text")
    late = F.col("source").isin("src1", "src3", "src5")
    store.write_messages(spark, path, messages.filter(~late))
    word_index.build(spark, path, index)
    word_index.update(spark, path, index, store.write_messages(spark, path, messages.filter(late)))
    return word_index.search(spark, index, SEARCH, 20).select(
        "message_id", "source", F.round("score", 6).alias("score"))


def text_search(spark, sf):
    return search.text_search(text_messages(spark, sf), SEARCH, 20).select(
        "message_id", "source", F.round("score", 6).alias("score"))


# --- streams -----------------------------------------------------------------------------

def _event_feed(spark, sf):
    return event_messages(_event_stream(spark, sf, repeats=True)).select(
        "message_id", "publish_date", "source", F.col("initial_text").alias("text"),
        F.lit("").alias("message"))


def stream_ingest(spark, sf):
    path = scratch_path(spark, "store")
    flows.stream_ingest(_event_feed(spark, sf), path,
                        scratch_path(spark, "ingest-checkpoint")).awaitTermination()
    return store.scan_store(spark, path).select("message_id", _ts(), "source", "initial_text")


def enrich_incremental(spark, sf):
    path = _filled_store(spark, sf)
    flows.enrich_incremental(spark, path, enrich.clean_ner_by_rules)
    return store.scan_store(spark, path).select(
        "message_id", "source", "cleared_text", _joined("named_entities"))


def model_retry(spark, sf):
    """A step that fails for labelled messages in a first round and for none in the second."""
    path = scratch_path(spark, "store")
    store.write_messages(spark, path, text_messages(spark, sf))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("_id"))

    def failing(messages):
        done = enrich.clean_ner_by_rules(messages).join(
            labelled.distinct(), F.col("message_id") == F.col("_id"), "left")
        failed = F.col("_id").isNotNull()
        return (done.withColumn("clean_ner_error", F.when(failed, "no answer"))
                .withColumn("cleared_text", F.when(~failed, F.col("cleared_text")))
                .withColumn("named_entities", F.when(~failed, F.col("named_entities"))))

    flows.enrich_incremental(spark, path, failing)
    flows.enrich_incremental(spark, path, enrich.clean_ner_by_rules)
    return store.scan_store(spark, path).select(
        "message_id", "cleared_text", _joined("named_entities"))


def stream_dedup(spark, sf):
    """History and live feed deliver the same events."""
    stream, folder = event_messages(_event_stream(spark, sf, repeats=True)), scratch_path(spark, "once")
    flows.stream_dedup(stream, folder, scratch_path(spark, "dedup-checkpoint")).awaitTermination()
    return flows.read_once(spark, folder, stream.schema).select(
        "message_id", _ts(), "source", "initial_text")


def stream_histogram(spark, sf):
    folder = scratch_path(spark, "histogram")
    flows.stream_histogram(event_messages(_event_stream(spark, sf)), folder,
                           scratch_path(spark, "histogram-checkpoint")).awaitTermination()
    return flows.read_histogram(spark, folder).select(
        F.col("day").cast("string").alias("day"), "source", "messages")


# --- training ------------------------------------------------------------------------------

def label_index(spark, sf):
    labelled = vectors(spark, sf)
    return train.label_index(labelled).transform(labelled).select(
        "message_id", "tonality", _long("label"))


def split(spark, sf):
    training, validation = train.split(vectors(spark, sf), ["message_id"])
    return training.select("message_id", F.lit("training").alias("part")).unionByName(
        validation.select("message_id", F.lit("validation").alias("part")))


def _fitted(spark, sf):
    training, validation = train.split(vectors(spark, sf), ["message_id"])
    return training, validation, network.train_network(training, validation)


def train_classifier(spark, sf):
    training, validation, fitted = _fitted(spark, sf)
    known = F.col("predicted").isin(fitted.classes) & F.col("probability").between(0, 1)
    return network.predict_by_network(fitted, training.withColumn("part", F.lit("training"))
                                      .unionByName(validation.withColumn("part", F.lit("validation")))
                                      ).groupBy("part").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(known).alias("predicted"))


def training_curve(spark, sf):
    training, _, fitted = _fitted(spark, sf)
    share = training.groupBy("tonality").count().agg((F.max("count") / F.sum("count")).alias("share"))
    curve = fitted.curve_table(spark).agg(
        F.min_by("loss", "epoch").alias("first"), F.max_by("loss", "epoch").alias("last"),
        F.max("accuracy").alias("best"), F.count_if("kept").alias("kept_epochs"))
    return curve.select(
        (F.col("last") < F.col("first")).cast("int").cast("long").alias("loss_falls"),
        (F.col("best") > F.lit(share.first().share)).cast("int").cast("long")
        .alias("beats_majority"), "kept_epochs")


def predict(spark, sf):
    training, validation = train.split(vectors(spark, sf), ["message_id"])
    model = train.train_classifier(training, linear=True)
    known = [row[0] for row in training.select("tonality").distinct().collect()]  # the classes
    return train.predict(model, validation).select(
        "message_id", "tonality", F.col("predicted").isin(known).cast("int").cast("long")
        .alias("known"))


QUERIES = {f.__name__: f for f in (
    rejected_lines, model_retry, tonality_by_join,
    scan_jsonl, parse_message, scan_store, dump_by_source, live_source, backfill, ensure_store,
    paged_feed, paged_feed_stream,
    source_catalogue, non_empty_text, by_source, by_date_range, unprocessed, skip_processed,
    monitored, to_body, from_stored, training_columns, limit_chunk, newest_first, upsert_merge,
    upsert_replace, backfill_union_live, dedup_exact, chunk, batch_texts, split_answers,
    split_blocks, split_actions, entity_list, answer_failed, align_answers, setup_grid,
    unique_sources, count_by_source, category_distribution, tonality_distribution, top_entities,
    top_entities_by_days, count_by_day, date_histogram, confusion_matrix, accuracy, clean_text, clean_text_spaced, sanitize_name,
    content_id, parse_ts, kyiv_hms, extract_noise, enrich_clean_ner, enrich_summary,
    enrich_tonality, enrich_category, enrich_embeddings, enrich_all, enrich_by_source,
    enrich_all_vectors, enrich_by_source_vectors, enrich_by_model_vectors,
    score_batches, reply_ledger, enrich_by_model, setup_comparison, similar_topk,
    similar_to_each, text_search, text_search_index, stream_ingest, enrich_incremental,
    stream_dedup, stream_histogram, label_index, split, train_classifier,
    training_curve, predict)}


def in_utc(query):
    """Times are compared as text, so every query runs in one time zone."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)
    return run
