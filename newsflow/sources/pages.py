"""A feed that hands out its messages in pages, newest first, as a data source of Spark.

What is behind a client (any object that can be pickled) has channels, and in each channel messages
whose ids rise with their dates:

* ``channels() -> list[str]``
* ``newest(channel) -> int | None``: the largest id there is
* ``page(channel, before) -> list[dict]``: some messages with ids below ``before``, the largest ids
  first; no message means that there are none

A channel is read in spans of ids, a task each or a few neighbours to a task, so a channel with a
third of all messages is many tasks. A task asks for pages from the top of a span down and stops at the
span's end or at the first message before the cutoff, so of an old span one page is read. Tasks ask by id alone: one that runs
again after a loss asks for the same messages.
"""

import datetime
import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition)
from pyspark.sql.pandas.types import to_arrow_schema

from newsflow.schema import FEED

#: Ids of a span.
SPAN = 100_000
#: Tasks that a reading is cut into; where there are more spans, a task reads several in turn.
MOST_TASKS = 2000
ID, DATE, CHANNEL = "message_id", "publish_date", "source"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Span:
    """Ids from ``low`` up to, and without, ``high`` of one channel."""

    def __init__(self, channel: str, low: int, high: int):
        self.channel, self.low, self.high = channel, low, high


def _spans(channel: str, low: int, high: int, size: int) -> list[Span]:
    """Cut at multiples of ``size``, whatever the ends are."""
    cuts = [low, *range((low // size + 1) * size, high, size), high] if low < high else []
    return [Span(channel, a, b) for a, b in zip(cuts, cuts[1:])]


class Spans(InputPartition):
    """What a task reads."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def _tasks(spans: list[Span]) -> list[Spans]:
    """Neighbouring spans, as many to a task as :data:`MOST_TASKS` asks for."""
    each = -(-len(spans) // MOST_TASKS)
    return [Spans(spans[i:i + each]) for i in range(0, len(spans), each or 1)]


def _utc(moment: datetime.datetime) -> datetime.datetime:
    """A time without a zone is in UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=datetime.timezone.utc)
    return moment.astimezone(datetime.timezone.utc)


def _records(client, span: Span, since: datetime.datetime | None) -> Iterator[list[dict]]:
    """The span's messages from ``since`` on, page by page."""
    before = span.high
    while before > span.low:
        page = client.page(span.channel, before)
        kept = [m for m in page if m[ID] >= span.low
                and (since is None or _utc(m[DATE]) >= since)]
        if kept:
            yield kept
        if len(kept) < len(page) or not page:
            return
        if page[-1][ID] >= before:
            raise ValueError(f"the page before {before} of {span.channel} does not go back")
        before = page[-1][ID]


class _Reading:
    """What reading at rest and reading on have in common."""

    def __init__(self, client, schema: T.StructType, span: int, since):
        self.client, self.schema, self.span = client, schema, span
        self.since = None if since is None else _utc(since)

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        layout = to_arrow_schema(self.schema)
        for span in partition.spans:
            for records in _records(self.client, span, self.since):
                rows = [{**m, DATE: _utc(m[DATE])} for m in records]
                yield pa.RecordBatch.from_pylist(rows, schema=layout)


class PageReader(_Reading, DataSourceReader):
    """All messages there are now."""

    only: set | None = None

    def partitions(self) -> list[Spans]:
        spans = []
        for channel in self.client.channels():
            newest = self.client.newest(channel)
            if newest is not None and (self.only is None or channel in self.only):
                spans += _spans(channel, 0, newest + 1, self.span)
        # a source without any message still has to have a partition
        return _tasks(spans) or [Spans([])]


class PushedReader(PageReader):
    """The same, where conditions on date and channel limit what is asked for."""

    def pushFilters(self, filters):
        """Spark tests every condition again: these only spare pages and channels."""
        for condition in filters:
            if isinstance(condition, (GreaterThan, GreaterThanOrEqual)) \
                    and condition.attribute == (DATE,):
                start = _utc(condition.value)
                self.since = start if self.since is None else max(self.since, start)
            elif isinstance(condition, (EqualTo, In)) and condition.attribute == (CHANNEL,):
                named = {condition.value} if isinstance(condition, EqualTo) else set(condition.value)
                self.only = named if self.only is None else self.only & named
            yield condition


class PageStream(_Reading, DataSourceStreamReader):
    """The history, then what is new. An offset is, by channel, the first id not read yet."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        newest = {channel: self.client.newest(channel) for channel in self.client.channels()}
        return {channel: last + 1 for channel, last in newest.items() if last is not None}

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        return _tasks([span for channel, high in sorted(end.items())
                       for span in _spans(channel, start.get(channel, 0), high, self.span)])


def register_pages(spark: SparkSession, client, name: str = "pages",
                   schema: T.StructType = FEED, span: int = SPAN) -> None:
    """Make ``client`` a format of ``spark.read`` and ``spark.readStream``.

    The option ``since`` (an ISO time) is the cutoff. Where the session has
    ``spark.sql.python.filterPushdown.enabled`` set by now, a condition on ``publish_date`` is one
    too, and conditions on ``source`` leave out channels; both in reading at rest only.
    """
    missing = {ID, DATE, CHANNEL} - set(schema.names)
    if missing:
        raise ValueError(f"not in the schema: {sorted(missing)}")
    short_name, layout = name, schema
    # Spark refuses a reader that takes conditions where the setting is off
    kind = PushedReader if spark.conf.get(PUSHDOWN, "false") == "true" else PageReader

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return short_name

        def schema(self):
            return layout

        def _since(self):
            text = self.options.get("since")
            return datetime.datetime.fromisoformat(text) if text else None

        def reader(self, schema):
            return kind(client, schema, span, self._since())

        def streamReader(self, schema):
            return PageStream(client, schema, span, self._since())

    spark.dataSource.register(Pages)


def paged_feed(spark: SparkSession, name: str = "pages", since: datetime.datetime | None = None,
               stream: bool = False) -> DataFrame:
    """The messages of a registered feed from ``since`` on, at rest or as a stream."""
    reader = (spark.readStream if stream else spark.read).format(name)
    if since is not None:
        reader = reader.option("since", since.isoformat())
    return reader.load()


def _files(path: str):
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: Pages that lie together in a folder.
BLOCK_PAGES = 64


class FolderClient:
    """Pages that lie as JSON lines in ``<folder>/source=<channel>/block=<n>``, one page a line.

    Page ``n`` holds the messages with ids from ``n * size`` on, ``size`` of them at most; a block
    holds :data:`BLOCK_PAGES` pages. What was added at several times is on several lines. A page is
    looked for where its number says; other blocks are listed only where there is a gap.
    """

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size
        self._forget()

    def _forget(self) -> None:
        self._places, self._held = {}, (None, {})

    def __getstate__(self):
        # each task reads for itself, so what was read does not travel
        return {k: v for k, v in self.__dict__.items() if k not in ("_places", "_held")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _names(self, folder: str, prefix: str) -> list[str]:
        files, root = _files(folder)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f.base_name[len(prefix):] for f in found if f.base_name.startswith(prefix)]

    def _place(self, channel: str) -> str:
        if channel not in self._places:
            names = {unquote(name): name for name in self._names(self.folder, "source=")}
            self._places[channel] = f"{self.folder}/source={names[channel]}"
        return self._places[channel]

    def _blocks(self, channel: str) -> list[int]:
        return sorted(map(int, self._names(self._place(channel), "block=")), reverse=True)

    def _block(self, channel: str, number: int) -> dict[int, list[bytes]]:
        """Lines of a block by page; the last block is kept."""
        if self._held[0] != (channel, number):
            files, root = _files(f"{self._place(channel)}/block={number}")
            lines = {}
            for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name.startswith(("_", ".")):
                    continue
                with files.open_input_stream(info.path) as stream:
                    # by "\n" alone: texts may hold other line ends
                    for line in stream.read().split(b"\n"):
                        if line:
                            page = int(line[:40].split(b":", 1)[1].split(b",", 1)[0])
                            lines.setdefault(page, []).append(line)
            self._held = (channel, number), lines
        return self._held[1]

    def _page(self, channel: str, lines: list[bytes]) -> list[dict]:
        messages = [m for line in lines for m in json.loads(line)["messages"]]
        for message in messages:
            message[CHANNEL] = channel
            message[DATE] = datetime.datetime.fromisoformat(message[DATE])
        return sorted(messages, key=lambda m: -m[ID])

    def _below(self, channel: str, number: int, before: int) -> list[dict]:
        """The block's last page that has messages below ``before``: these messages."""
        lines = self._block(channel, number)
        for page in sorted(lines, reverse=True):
            if page * self.size < before:
                found = [m for m in self._page(channel, lines[page]) if m[ID] < before]
                if found:
                    return found
        return []

    def channels(self) -> list[str]:
        return sorted(unquote(name) for name in self._names(self.folder, "source="))

    def newest(self, channel: str) -> int | None:
        self._forget()  # there may be new pages
        for number in self._blocks(channel)[:1]:
            lines = self._block(channel, number)
            return self._page(channel, lines[max(lines)])[0][ID]
        return None

    def page(self, channel: str, before: int) -> list[dict]:
        own = (before - 1) // (self.size * BLOCK_PAGES)
        found = self._below(channel, own, before)
        for number in [] if found else self._blocks(channel):
            if number < own:
                found = self._below(channel, number, before)
                if found:
                    break
        return found


def write_pages(messages: DataFrame, folder: str, size: int) -> FolderClient:
    """Add messages, each with an id, a date and a channel, to a folder of pages; its client."""
    dated = messages.withColumn(DATE, F.date_format(DATE, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    placed = dated.withColumn("page", F.floor(F.col(ID) / size).cast("long")) \
        .withColumn("block", F.floor(F.col("page") / BLOCK_PAGES).cast("long"))
    # the page comes first on its line, which is how it is found; a page holds ``size`` messages at most
    (placed.repartition(CHANNEL, "block").groupBy(CHANNEL, "block", "page")
     .agg(F.collect_list(F.struct(*[c for c in messages.columns if c != CHANNEL])).alias("messages"))
     .select("page", "messages", CHANNEL, "block")
     .write.mode("append").partitionBy(CHANNEL, "block").json(folder))
    return FolderClient(folder, size)
