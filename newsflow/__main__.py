"""Commands over a stored message table: ``spark-submit ... newsflow/__main__.py <command>``."""

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from newsflow.operators.report import unique_sources
from newsflow.plans import enrich, jobs
from newsflow.scratch import drop_scratch
from newsflow.sources import feed, store
from newsflow.streaming import flows


def _function(name: str):
    """The object that ``module:name`` refers to."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _lexicon(spark: SparkSession, path: str):
    return spark.read.schema("word string, value string, weight int").csv(path, header=True)


def _model_options(command: argparse.ArgumentParser) -> None:
    command.add_argument("--model", help="module:function instead of the rules")
    command.add_argument("--templates", help="JSON file {step: template with {count} and {texts}}")
    command.add_argument("--setups", help="JSON file {step: {option: value}}")
    command.add_argument("--ledger", help="folder of replies: what it answers is not asked again")
    command.add_argument("--requests-per-minute", type=float)
    command.add_argument("--tasks", type=int, help="how many calls there may be at once, at most")
    command.add_argument("--call-size", type=int, help="requests that a call gets")
    command.add_argument("--batch", type=int, help="messages per request")


def _json(path: str | None):
    if path is None:
        return None
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _model_settings(args: argparse.Namespace) -> dict:
    """What was given on how to ask the model."""
    given = {"templates": _json(args.templates), "setups": _json(args.setups),
             "ledger": args.ledger, "requests_per_minute": args.requests_per_minute,
             "tasks": args.tasks, "call_size": args.call_size, "batch": args.batch}
    for name in ("templates", "setups"):
        unknown = set(given[name] or {}) - set(enrich.STEP_SETUPS)
        if unknown:
            raise SystemExit(f"{name} for unknown steps: {', '.join(sorted(unknown))}")
    return {name: value for name, value in given.items() if value is not None}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="newsflow", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, **options):
        added = commands.add_parser(name, **options)
        added.add_argument("store", help="path of the message table")
        return added

    listed = command("list-channels", help="list the sources that have messages")
    listed.add_argument("--output", help="folder to write the list to instead")
    load = command("load-data", help="import JSONL files")
    load.add_argument("folder")
    load.add_argument("--rejects", help="folder for lines that cannot be read")
    dump = command("dump", help="write the table to JSONL files by source")
    dump.add_argument("folder")
    dump.add_argument("--source")
    read = command("read", help="write a feed of JSON files to the table")
    read.add_argument("folder")
    read.add_argument("checkpoint")
    read.add_argument("--channels", help="JSON file {worker: [channel, ...]}")
    read.add_argument("--interval", help="keep on reading, e.g. '10 seconds'")
    step = command("enrich", help="run one step, or all, on one source or all")
    step.add_argument("step", choices=["all", *enrich.CHAIN])
    step.add_argument("--source")
    step.add_argument("--new-only", action="store_true",
                      help="leave out messages that have what the step gives")
    _model_options(step)
    step.add_argument("--tonality-lexicon", help="CSV file word,value,weight")
    step.add_argument("--category-lexicon", help="CSV file word,value,weight")
    process = command("process", help="enrich new messages at intervals")
    process.add_argument("checkpoint")
    _model_options(process)
    process.add_argument("--tonality-lexicon", help="CSV file word,value,weight")
    process.add_argument("--category-lexicon", help="CSV file word,value,weight")
    process.add_argument("--interval", default=flows.IDLE)
    process.add_argument("--limit", type=int, help="messages per round; each round is stored")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "list-channels":
        sources = unique_sources(store.scan_store(spark, args.store))
        if args.output:
            sources.write.json(args.output)
        else:
            for row in sources.toLocalIterator():
                print(row.source)
    elif args.command == "load-data":
        bad = jobs.load_files(spark, args.folder, args.store, rejects=args.rejects)
        print(f"{bad} lines could not be read", file=sys.stderr)
    elif args.command == "dump":
        jobs.dump_files(spark, args.store, args.folder, args.source)
    elif args.command == "read":
        stream = feed.live_source(spark, args.folder, _json(args.channels))
        flows.stream_ingest(stream, args.store, args.checkpoint, args.interval).awaitTermination()
    elif args.command == "enrich":
        _enrich(spark, args)
    elif args.command == "process":
        flows.enrich_forever(spark, args.store, _chain(spark, args), args.checkpoint,
                             args.interval, args.limit, WANTED).awaitTermination()


#: Fields without which ``process`` takes a message up again.
WANTED = ("cleared_text", "summary", "tonality", "category", "embedding_sts")


def _by_step(function, names) -> dict:
    """The model function for each step; it is told the step, and the kind of an embedding."""
    steps = {name: function for name in names}
    if "embeddings" in steps:
        steps["embeddings"] = lambda texts, kind: function(
            texts, {"step": "embeddings", "kind": kind})
    return steps


def _chain(spark: SparkSession, args: argparse.Namespace):
    """All steps as one function of messages."""
    if args.model:
        function, settings = _function(args.model), _model_settings(args)
        return lambda m: enrich.enrich_by_model(m, _by_step(function, enrich.CHAIN), **settings)
    if not (args.tonality_lexicon and args.category_lexicon):
        raise SystemExit("give both lexicons, or a model")
    lexicons = _lexicon(spark, args.tonality_lexicon), _lexicon(spark, args.category_lexicon)
    return lambda m: enrich.enrich_all_by_rules(m, *lexicons)


def _enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    names = list(enrich.CHAIN) if args.step == "all" else [args.step]
    if "embeddings" in names:  # the only step that builds on another, so it comes last
        names = [n for n in names if n != "embeddings"] + ["embeddings"]
    if args.model:
        function = _function(args.model)
        failed = jobs.run_model_steps(spark, args.store, _by_step(function, names), args.source,
                                      not args.new_only, **_model_settings(args))
        print(f"{failed.count()} messages with failed steps")
        return
    steps = dict(jobs.RULES)
    if args.tonality_lexicon:
        words = _lexicon(spark, args.tonality_lexicon)
        steps["tonality"] = lambda m: enrich.tonality_by_rules(m, words)
    if args.category_lexicon:
        topics = _lexicon(spark, args.category_lexicon)
        steps["category"] = lambda m: enrich.category_by_rules(m, topics)
    missing = [n for n in names if n not in steps]
    if missing:
        raise SystemExit(f"give a lexicon or a model for: {', '.join(missing)}")
    for name in names:
        jobs.run_step(spark, args.store, name, steps[name], args.source, not args.new_only)


def main() -> None:
    args = parser().parse_args()
    spark = (SparkSession.builder.appName(f"newsflow {args.command}")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    try:
        run(spark, args)
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    main()
