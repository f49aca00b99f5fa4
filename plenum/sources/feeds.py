"""Feeds of publishing platforms, read from responses that a fetcher saved.

A fetcher writes JSON lines (:func:`publish`) and commits each batch of files to a log, so
readers see whole batches in order. :class:`SavedResponses` is a Spark data source
over that folder, for batches and streams: a stream's offset is the number of log entries
read, a task reads one file. Each platform has its own parser (:data:`PARSERS`) from
responses to meetings and items; what can't be read goes to quarantine with the reasons.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from plenum.operators.keyed import latest_per_key
from plenum.sources.commits import CommitLog
from plenum.sources.tables import quarantine

RESPONSE = "vendor string, city string, kind string, url string, fetched_at string, body string"
READ = f"{RESPONSE}, file string, line int, problem string"
FIELDS = [f.split()[0] for f in RESPONSE.split(", ")]


def publish(spark: SparkSession, path: str, responses: DataFrame, rows_per_file: int = 2000) -> int:
    """Save ``responses`` (columns of :data:`RESPONSE`) as one batch, and return its number in the log."""
    name = f"batch-{uuid.uuid4().hex}"
    text = responses.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in FIELDS]), {"ignoreNullFields": "false"}).alias("value"))
    text.write.option("maxRecordsPerFile", rows_per_file).text(f"{path}/{name}")
    return add_files(spark, path, name)


def add_files(spark: SparkSession, path: str, name: str) -> int:
    """Commit the files of folder ``name`` under ``path`` as one batch."""
    log = CommitLog(spark, f"{path}/log")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = sorted(f"{name}/{s.getPath().getName()}" for s in log.fs.listStatus(folder) if not s.getPath().getName().startswith(("_", ".")))
    log.transact(lambda entries: {"files": files, "number": len(entries)})
    return log.latest()


class FilePartition(InputPartition):
    def __init__(self, file: str) -> None:
        super().__init__(file)
        self.file = file


def store_of(path: str):
    """File system and folder of ``path`` for code that runs without a JVM: local or shared folders, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Folder:
    """The log and files of one folder of saved responses, as seen by the data source."""

    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("saved_responses needs the option path")
        self.path = options["path"].rstrip("/").replace("file:///", "/").replace("file:/", "/")

    def entries(self) -> int:
        """Number of batches committed so far."""
        from pyarrow import fs

        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
        return sum(1 for f in found if f.base_name.endswith(".json"))

    def files(self, start: int, end: int) -> list[str]:
        store, root = store_of(self.path)
        out: list[str] = []
        for number in range(start, end):
            with store.open_input_stream(f"{root}/log/{number:020d}.json") as f:
                out += json.loads(f.read())["files"]
        return out

    def rows(self, file: str) -> Iterator[tuple]:
        """One row a line. A line that is no JSON object gives a row with its text as body and a ``problem``."""
        store, root = store_of(self.path)
        with store.open_input_stream(f"{root}/{file}", compression=None) as raw:
            held, number = b"", 0
            while True:
                more = raw.read(1 << 20)
                *lines, held = (held + more).split(b"\n")
                if not more and held:
                    lines, held = [*lines, held], b""
                for line in lines:
                    number += 1
                    if line.strip():
                        yield (*self.parsed(line), file, number, *self.problem(line))
                if not more:
                    return

    @staticmethod
    def parsed(line: bytes) -> tuple:
        try:
            record = json.loads(line)
            return tuple(None if record.get(c) is None else str(record[c]) for c in FIELDS)
        except (ValueError, AttributeError):
            return (*[None] * 5, line.decode("utf-8", "replace"))

    @staticmethod
    def problem(line: bytes) -> tuple:
        try:
            return (None if isinstance(json.loads(line), dict) else "no_object",)
        except ValueError:
            return ("no_json",)


class BatchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f) for f in self.folder.files(0, self.folder.entries())] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition.file:
            yield from self.folder.rows(partition.file)


class StreamReader(DataSourceStreamReader):
    """Offsets count log entries. ``maxBatches`` limits how many enter one micro-batch.

    What was read is kept in memory, and with the option ``reader`` (a name) in the folder
    too, so that the limit holds after a restart as well; without it the first
    micro-batch after a restart takes all that came meanwhile.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.most, self.name = Folder(options), int(options.get("maxbatches", options.get("maxBatches", 0))), options.get("reader")
        self.at: int | None = None

    def _progress(self) -> str:
        return f"{store_of(self.folder.path)[1]}/readers/{self.name}.json"

    def _known(self) -> int | None:
        if self.at is None and self.name:
            from pyarrow import fs

            store, _ = store_of(self.folder.path)
            self.at = 0  # nothing was committed yet
            if store.get_file_info(self._progress()).type == fs.FileType.File:
                with store.open_input_stream(self._progress()) as f:
                    self.at = json.loads(f.read())["entry"]
        return self.at

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entry": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        newest, known = self.folder.entries(), self._known()
        self.at = newest if known is None or not self.most else max(known, min(newest, known + self.most))
        return {"entry": self.at}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        self.at = max(self.at or 0, end["entry"])
        return [FilePartition(f) for f in self.folder.files(start["entry"], end["entry"])]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        yield from self.folder.rows(partition.file)

    def commit(self, end: dict) -> None:
        if self.name:
            store, _ = store_of(self.folder.path)
            store.create_dir(self._progress().rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{self._progress()}.new") as f:
                f.write(json.dumps(end).encode())
            store.move(f"{self._progress()}.new", self._progress())


class SavedResponses(DataSource):
    """``spark.read.format("saved_responses").option("path", folder)``, or ``readStream``; rows as :data:`READ`."""

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def responses(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SavedResponses)
    return spark.read.format("saved_responses").option("path", path).load()


def response_stream(spark: SparkSession, path: str, reader: str | None = None, most: int = 0) -> DataFrame:
    spark.dataSource.register(SavedResponses)
    stream = spark.readStream.format("saved_responses").option("path", path).option("maxBatches", most)
    return (stream.option("reader", reader) if reader else stream).load()


# Parsers ---------------------------------------------------------------------

KEY = ["vendor", "city", "fetched_at", "file", "line"]  # where a record came from
# Shapes of printed times and the formats that read them; a shape is tested first, since a failed parse is slow.
CLOCK = r" \d{1,2}:\d\d [AaPp][Mm]$"
START_FORMATS = [
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\p{L}{3} \d{1,2}, \d{4} -" + CLOCK, "MMM d, yyyy - h:mm a"),
    (r"^\p{L}{3} \d{1,2}, \d{4}" + CLOCK, "MMM d, yyyy h:mm a"),
    (r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\p{L}{4,} \d{1,2}, \d{4} -" + CLOCK, "MMMM d, yyyy - h:mm a"),
    (r"^\p{L}{4,} \d{1,2}, \d{4}" + CLOCK, "MMMM d, yyyy h:mm a"),
    (r"^\p{L}{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}" + CLOCK, "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
]


def start_of(text: Column) -> Column:
    """Local time that a platform prints, with or without a zone that is ignored; null if no format fits."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s\u00A0]+", " "), r"(?<=\d)(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)$", ""))
    read = F.lit(None).cast("timestamp")
    for shape, form in reversed(START_FORMATS):
        read = F.when(tidy.rlike(shape), F.try_to_timestamp(tidy, F.lit(form))).otherwise(read)
    return read


def text_of(value: Column) -> Column:
    """Trimmed, null if empty."""
    return F.nullif(F.trim(value), F.lit(""))


def checked(meetings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meetings with an id, a title and a readable start, and the others with the checks they fail."""
    tests = {"readable": F.col("problem").isNull(), "vendor_id": F.col("vendor_id").isNotNull(), "title": F.col("title").isNotNull(), "start": F.col("start").isNotNull()}
    good, bad = quarantine(meetings, tests)
    unread = F.when(F.array_contains("failed", "readable"), F.array(F.coalesce("problem", F.lit("readable")))).otherwise(F.col("failed"))
    return good.drop("problem"), bad.withColumn("failed", unread).drop("problem")


def read_or_problem(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """``rows`` with a parsed body; a body that can't be parsed is a problem of its own."""
    out = rows.withColumn(name, F.when(F.col("problem").isNull(), value))
    return out.withColumn("problem", F.coalesce("problem", F.when(F.col(name).isNull(), "unreadable_body")))


def each(rows: DataFrame, elements: Column, name: str = "e") -> DataFrame:
    """A row an element; rows with a problem stay, with a null element."""
    listed = F.when(F.col("problem").isNull(), F.transform(elements, lambda x: F.struct(x.alias("x")))).otherwise(F.array(F.lit(None)))
    return rows.withColumn(name, F.explode(listed)).withColumn(name, F.col(f"{name}.x"))


MEETING = ["vendor_id", "title", "start", "status", "location", "agenda_url", "packet_url", "minutes_url", "web_url"]

EVENT = ["EventId", "EventBodyName", "EventDate", "EventTime", "EventLocation", "EventAgendaStatusName", "EventAgendaFile", "EventMinutesFile", "EventInSiteURL"]
EVENT_ITEM = ["EventItemId", "EventItemEventId", "EventItemAgendaSequence", "EventItemAgendaNumber", "EventItemTitle", "EventItemMatterName", "EventItemMatterFile", "EventItemMatterType"]
ATTACHED = ("EventItemMatterAttachments", "array<struct<MatterAttachmentName: string, MatterAttachmentHyperlink: string>>")


def legistar_records(rows: DataFrame, element: str, fields: list[str], nested: tuple[str, str] | None = None) -> DataFrame:
    """Records of a list in JSON, or in XML as elements of one list or as properties of feed entries; ``nested`` (name and type) comes in JSON only."""
    body = F.trim(F.regexp_replace("body", "^\ufeff", ""))
    flat = ", ".join(f"{f}: string" for f in fields)
    whole = flat + (f", {nested[0]}: {nested[1]}" if nested else "")
    tree = F.from_xml(F.when(body.startswith("<"), body), f"{element} array<struct<{flat}>>, entry array<struct<content: struct<properties: struct<{flat}>>>>", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    listed = F.from_json(F.when(body.startswith("["), body), f"array<struct<{whole}>>", {"mode": "PERMISSIVE"})
    rows = rows.withColumn("tree", tree).withColumn("listed", listed)

    def widened(e: Column) -> Column:
        more = [F.lit(None).cast(nested[1]).alias(nested[0])] if nested else []
        return F.struct(*[e[f].alias(f) for f in fields], *more)

    nothing = F.array().cast(f"array<struct<{whole}>>")
    parts = [F.transform(F.col(f"tree.{element}"), widened), F.transform(F.col("tree.entry"), lambda x: widened(x["content"]["properties"]))]
    from_tree = F.when(parts[0].isNotNull() | parts[1].isNotNull(), F.concat(*[F.coalesce(p, nothing) for p in parts]))
    return read_or_problem(rows, F.coalesce("listed", from_tree))


def legistar(rows: DataFrame) -> DataFrame:
    """Events of the platform's web API (kind ``events``), JSON or XML: the day and the printed time make the start."""
    found = each(legistar_records(rows.where("kind = 'events'"), "GranicusEvent", EVENT), F.col("value"))
    day, clock = F.to_date(F.try_to_timestamp(F.substring("e.EventDate", 1, 10), F.lit("yyyy-MM-dd"))), F.upper(text_of(F.col("e.EventTime")))
    start = F.when(clock.isNull(), day.cast("timestamp")).otherwise(F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd h:mm a")))
    text = lambda n: text_of(F.col(f"e.{n}"))
    minutes = text("EventMinutesFile")
    return found.select(
        *KEY, "problem", text("EventId").alias("vendor_id"), text("EventBodyName").alias("title"), F.coalesce(start, day.cast("timestamp")).alias("start"), text("EventAgendaStatusName").alias("status"),
        text("EventLocation").alias("location"), text("EventAgendaFile").alias("agenda_url"), F.lit(None).cast("string").alias("packet_url"), minutes.alias("minutes_url"), text("EventInSiteURL").alias("web_url"),
    )


def legistar_items(rows: DataFrame) -> DataFrame:
    """Items of events (kind ``event_items``): title, or else the matter's name; an element without either is no item."""
    found = each(legistar_records(rows.where("kind = 'event_items'"), "GranicusEventItem", EVENT_ITEM, ATTACHED), F.col("value"))
    text = lambda n: text_of(F.col(f"e.{n}"))
    files = F.transform(F.filter(F.coalesce("e.EventItemMatterAttachments", F.array()), lambda a: a["MatterAttachmentHyperlink"].rlike("^https?://")), lambda a: F.struct(text_of(a["MatterAttachmentName"]).alias("name"), a["MatterAttachmentHyperlink"].alias("url")))
    out = found.select(
        *KEY, "problem", text("EventItemEventId").alias("meeting_id"), text("EventItemId").alias("item_id"), F.coalesce(text("EventItemTitle"), text("EventItemMatterName")).alias("title"),
        text("EventItemAgendaNumber").alias("agenda_number"), text("EventItemAgendaSequence").try_cast("int").alias("sequence"), text("EventItemMatterFile").alias("matter_file"), files.alias("attachments"),
    )
    return out.where("problem is not null or title is not null")


FILE = "struct<fileId: string, type: string, name: string, url: string, isDeleted: boolean, isPublished: boolean>"
CLERK = f"struct<value: array<struct<id: string, eventName: string, startDateTime: string, eventLocation: struct<address1: string, address2: string, city: string>, isDeleted: boolean, publishedFiles: array<{FILE}>>>>"


def civicclerk(rows: DataFrame) -> DataFrame:
    """Pages of events (kind ``events``). Of published files, the agenda, the packet, and minutes that are no draft if there are any."""
    parsed = F.from_json("body", CLERK)["value"]
    found = each(read_or_problem(rows.where("kind = 'events'"), parsed), F.col("value"))
    files = F.filter(F.coalesce("e.publishedFiles", F.array()), lambda f: ~F.coalesce(f["isDeleted"], F.lit(False)) & F.coalesce(f["isPublished"], F.lit(True)) & f["url"].isNotNull())
    first = lambda test: F.get(F.filter("files", test), 0)["url"]
    kind = lambda f: F.lower(F.trim(f["type"]))
    minutes = F.coalesce(first(lambda f: kind(f).contains("minutes") & ~kind(f).contains("draft")), first(lambda f: kind(f).contains("minutes")))
    text = lambda n: text_of(F.col(f"e.{n}"))
    place = text_of(F.concat_ws(", ", text("eventLocation.address1"), text("eventLocation.address2"), text("eventLocation.city")))
    return found.withColumn("files", files).select(
        *KEY, "problem", text("id").alias("vendor_id"), text("eventName").alias("title"), start_of(F.col("e.startDateTime")).alias("start"), F.when(F.col("e.isDeleted"), "cancelled").alias("status"),
        place.alias("location"), first(lambda f: kind(f) == "agenda").alias("agenda_url"), first(lambda f: kind(f) == "agenda packet").alias("packet_url"), minutes.alias("minutes_url"), F.lit(None).cast("string").alias("web_url"),
    )


CLERK_ITEM = "array<struct<item_id: string, title: string, agenda_number: string, sequence: int, section: string, attachments: array<struct<name: string, url: string>>>>"


def clerk_tree(body: str) -> list[dict] | None:
    """Items of an agenda tree in order, sections dissolved; null if it is no such tree."""
    try:
        top = json.loads(body)["items"]
        stack = [(x, None) for x in reversed(top)]
    except (ValueError, KeyError, TypeError):
        return None
    out: list[dict] = []
    while stack:
        item, section = stack.pop()
        if not isinstance(item, dict):
            continue
        title = str(item.get("agendaObjectItemName") or "").strip()
        inside = item.get("childItems") or []
        stack += [(x, title or section if item.get("isSection") else section) for x in reversed(inside)]
        if title and not item.get("isSection"):
            files = [a for a in item.get("attachmentsList") or [] if isinstance(a, dict) and a.get("isPublished", True) and not a.get("isDeleted")]
            listed = [{"name": a.get("fileName"), "url": a.get("pdfVersionFullPath") or a.get("mediaFullPath")} for a in files]
            number = item.get("agendaObjectItemNumber")
            out.append({"item_id": str(item.get("id") or "") or None, "title": title, "agenda_number": None if number is None else str(number), "sequence": len(out) + 1, "section": section, "attachments": [x for x in listed if x["url"]]})
    return out


def clerk_items(body: Column | str) -> Column:
    """:func:`clerk_tree` as a column."""

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else clerk_tree(b))

    return F.pandas_udf(run, CLERK_ITEM)(body)


def civicclerk_items(rows: DataFrame) -> DataFrame:
    """Items of agendas (kind ``agenda``, the meeting's id being the last number of the url)."""
    found = each(read_or_problem(rows.where("kind = 'agenda'"), clerk_items("body")), F.col("value"))
    return found.select(*KEY, "problem", F.regexp_extract("url", r"(\d+)\D*$", 1).alias("meeting_id"), "e.item_id", "e.title", "e.agenda_number", "e.sequence", F.lit(None).cast("string").alias("matter_file"), "e.attachments")


ROW = "array<struct<section: string, cells: array<string>, links: array<struct<href: string, text: string>>>>"


class ListingParser(HTMLParser):
    """Rows of a listing page: table rows or list rows with their cells, links (and options of menus), and the tab above."""

    CELLS = {"listitem", "listeditem", "table-cell"}

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.row: dict | None = None
        self.cell: list[str] | None = None
        self.closes: tuple[str, int] = ("", 0)  # tag of the open cell, and how many of that tag are open in it
        self.link: dict | None = None
        self.tab: list[str] | None = None
        self.section: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        if self.cell is not None and tag == self.closes[0]:
            self.closes = (tag, self.closes[1] + 1)
            if tag == "td":  # cells of a table follow each other, closed or not
                self.cell = None
        names = set(values.get("class", "").lower().split())
        if tag == "tr" or (tag == "li" and "table-row" in names and "table-row--head" not in names):
            self.row, self.cell, self.link = {"section": self.section, "cells": [], "links": []}, None, None
        elif "collapsiblepaneltab" in names:
            self.tab = []
        elif self.row is not None and (tag == "td" or tag == "div") and names & self.CELLS:
            self.cell, self.closes = [], (tag, 1)
            self.row["cells"].append(self.cell)
        elif self.row is not None and tag in ("a", "option"):
            href = values.get("href" if tag == "a" else "value")
            if href:
                self.link = {"href": href, "text": []}
                self.row["links"].append(self.link)

    def handle_endtag(self, tag: str) -> None:
        if self.cell is not None and tag == self.closes[0]:
            self.closes = (tag, self.closes[1] - 1)
            if not self.closes[1]:
                self.cell = None
        if tag in ("a", "option"):
            self.link = None
        elif tag == "div" and self.tab is not None:
            self.section, self.tab = " ".join("".join(self.tab).split()) or None, None
        elif tag in ("tr", "li") and self.row is not None:
            if len(self.row["cells"]) > 1:
                tidy = lambda parts: " ".join("".join(parts).split())
                links = [{"href": x["href"], "text": tidy(x["text"])} for x in self.row["links"]]
                self.rows.append({"section": self.row["section"], "cells": [tidy(c) for c in self.row["cells"]], "links": links})
            self.row, self.cell = None, None

    def handle_data(self, data: str) -> None:
        if self.tab is not None:
            self.tab.append(data)
        if self.link is not None:
            self.link["text"].append(data)
        if self.cell is not None:
            self.cell.append(data)


def listing_rows(html: str) -> list[dict]:
    parser = ListingParser()
    parser.feed(html)
    parser.close()
    return parser.rows


def listing(body: Column | str) -> Column:
    """:func:`listing_rows` as a column."""

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else listing_rows(b))

    return F.pandas_udf(run, ROW)(body)


def granicus(rows: DataFrame) -> DataFrame:
    """Rows of listing pages (kind ``listing``): name and date, in either order; documents by their links.

    The id is the clip or event of the agenda's link, or else a hash of title and date. A row
    without a name takes that of the tab above. A link without a host belongs to the page's.
    """
    found = each(read_or_problem(rows.where("kind = 'listing'"), listing("body")), F.col("value"))
    found = found.withColumn("name", F.get("e.cells", 0)).withColumn("when", F.get("e.cells", 1))
    found = found.withColumn("name_start", start_of(F.col("name"))).withColumn("when_start", start_of(F.col("when")))
    turned = F.col("when_start").isNull() & F.col("name_start").isNotNull()
    title = F.when(turned, F.when(F.lower("when") != "agenda", F.col("when"))).otherwise(F.col("name"))
    start = F.coalesce("when_start", "name_start")
    found = found.withColumn("title", F.coalesce(text_of(title), F.col("e.section"))).withColumn("start", start)

    def link(test: Callable[[Column], Column]) -> Column:
        href = F.get(F.filter("e.links", test), 0)["href"]
        host, scheme = F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.regexp_extract("url", r"^(https?:)", 1)
        return F.when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).when(href.rlike("^https?:"), href).when(href.isNotNull(), F.concat(host, F.lit("/"), href))

    low = lambda x: F.lower(x["href"])
    is_minutes = lambda x: F.lower(x["text"]).contains("minutes") | low(x).contains("minutesviewer")
    out = found.select(
        *KEY, "problem", "title", "start", F.when(F.lower("title").contains("cancel"), "cancelled").alias("status"), F.lit(None).cast("string").alias("location"),
        link(lambda x: low(x).contains("agendaviewer")).alias("agenda_url"), link(lambda x: low(x).contains(".pdf") & ~is_minutes(x)).alias("packet_url"),
        link(is_minutes).alias("minutes_url"), link(lambda x: low(x).contains("mediaplayer")).alias("web_url"),
    )
    clip = F.nullif(F.regexp_extract(F.coalesce("agenda_url", "web_url", F.lit("")), r"(?i)[?&](?:clip_id|event_id)=(\d+)", 1), F.lit(""))
    made = F.when(F.col("title").isNotNull() & F.col("start").isNotNull(), F.substring(F.sha2(F.concat_ws("|", "city", "title", F.col("start").cast("string")), 256), 1, 16))
    return out.withColumn("vendor_id", F.coalesce(clip, made)).select(*KEY, "problem", *MEETING)


#: Meetings, and items where the platform lists them, from responses.
PARSERS = {"legistar": (legistar, legistar_items), "civicclerk": (civicclerk, civicclerk_items), "granicus": (granicus, None)}


def meetings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meetings of all responses and what is held in quarantine; works on batches and streams alike.

    Lines that are no response, and responses of a platform without a parser, are held too.
    """
    out = None
    for vendor, (parse, _) in PARSERS.items():
        part = parse(rows.where((F.col("vendor") == vendor) & F.col("problem").isNull()))
        part = part.select(*KEY, "problem", *MEETING)
        out = part if out is None else out.unionByName(part)
    problem = F.coalesce("problem", F.lit("unknown_vendor"))
    rest = rows.where(F.col("problem").isNotNull() | ~F.coalesce(F.col("vendor").isin(*PARSERS), F.lit(False))).withColumn("problem", problem)
    none = [F.lit(None).cast("timestamp" if c == "start" else "string").alias(c) for c in MEETING]
    return checked(out.unionByName(rest.select(*KEY, "problem", *none)))


def current(found: DataFrame) -> DataFrame:
    """The newest record of each meeting (vendor, city, id), by the time it was fetched, then file and line."""
    order = [F.col(c).desc() for c in ("fetched_at", "file", "line")]
    return latest_per_key(found, ["vendor", "city", "vendor_id"], order)


def ingest(spark: SparkSession, path: str, good: str, bad: str, checkpoint: str, reader: str | None = None, most: int = 0):
    """A stream writer that appends new meetings under ``good`` and held records under ``bad``; a batch that runs again replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        for frame, folder in zip(meetings(held), (good, bad)):
            frame.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        held.unpersist()

    return response_stream(spark, path, reader, most).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
