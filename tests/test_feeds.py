"""Saved responses as a data source, and the parsers of three platforms."""

import json

import pytest
from pyspark.sql import functions as F

from plenum.sources import feeds

EVENTS = [
    {"EventId": 11, "EventBodyName": " City Council ", "EventDate": "2025-03-04T00:00:00", "EventTime": "6:30 PM", "EventLocation": "Hall", "EventAgendaStatusName": "Final", "EventAgendaFile": "https://x/a.pdf", "EventMinutesFile": None, "EventInSiteURL": "https://x/11"},
    {"EventId": 12, "EventBodyName": "Board", "EventDate": "2025-03-05T00:00:00", "EventTime": None},
    {"EventId": 13, "EventBodyName": "", "EventDate": "2025-03-05T00:00:00"},
    {"EventId": 14, "EventBodyName": "No day", "EventDate": "soon"},
    {"EventBodyName": "No id", "EventDate": "2025-03-05T00:00:00"},
]
XML = """<?xml version="1.0"?><ArrayOfGranicusEvent xmlns="http://schemas.example/x"><GranicusEvent><EventId>21</EventId><EventBodyName>Parks &amp; Trees</EventBodyName>
<EventDate>2025-04-01T00:00:00</EventDate><EventTime>9:00 AM</EventTime></GranicusEvent><GranicusEvent><EventId>22</EventId><EventBodyName>Zoning</EventBodyName><EventDate>2025-04-02T00:00:00</EventDate></GranicusEvent></ArrayOfGranicusEvent>"""
FEED = """<feed xmlns="http://a" xmlns:m="http://m" xmlns:d="http://d"><entry><content><m:properties><d:EventId>31</d:EventId><d:EventBodyName>Library</d:EventBodyName><d:EventDate>2025-05-01T00:00:00</d:EventDate></m:properties></content></entry></feed>"""
ITEMS = [
    {"EventItemId": 1, "EventItemEventId": 11, "EventItemTitle": "", "EventItemMatterName": "Budget", "EventItemAgendaSequence": 4, "EventItemAgendaNumber": "4.a", "EventItemMatterFile": "25-1", "EventItemMatterAttachments": [{"MatterAttachmentName": "Memo", "MatterAttachmentHyperlink": "https://x/m.pdf"}, {"MatterAttachmentName": "Bad", "MatterAttachmentHyperlink": "m.pdf"}]},
    {"EventItemId": 2, "EventItemEventId": 11, "EventItemTitle": None},
]
CLERK = {
    "value": [
        {"id": 5, "eventName": "Council", "startDateTime": "2025-03-04T18:30:00Z", "eventLocation": {"address1": "1 Main", "city": "Oak"}, "publishedFiles": [
            {"fileId": 1, "type": "Agenda", "url": "https://c/a"}, {"fileId": 2, "type": "Agenda Packet", "url": "https://c/p"}, {"fileId": 3, "type": "Draft Minutes", "url": "https://c/d"},
            {"fileId": 4, "type": "Minutes", "url": "https://c/m"}, {"fileId": 5, "type": "Agenda", "url": "https://c/gone", "isDeleted": True}]},
        {"id": 6, "eventName": "Old", "startDateTime": "never"},
    ]
}
TREE = {"items": [{"id": 1, "isSection": 1, "agendaObjectItemName": "Consent", "childItems": [
    {"id": 2, "agendaObjectItemName": "Minutes of May", "agendaObjectItemNumber": "A.1", "attachmentsList": [{"fileName": "m", "pdfVersionFullPath": "https://c/1"}, {"fileName": "x", "mediaFullPath": "https://c/2", "isDeleted": True}], "childItems": [{"id": 3, "agendaObjectItemName": "Inner"}]}]},
    {"id": 4, "agendaObjectItemName": " Hearing "}, {"id": 5, "agendaObjectItemName": ""}]}
LISTING = """<div class="CollapsiblePanelTab">Planning Board</div><div class="CollapsiblePanelContent"><table class="listingTable">
<tr class="listingRow"><td class="listItem">City Council</td><td class="listItem">March 4, 2025 - 06:30 PM</td><td><a href="//g.com/AgendaViewer.php?view_id=1&amp;clip_id=77">Agenda</a>
<a href="/files/minutes.pdf">Minutes</a><a href="https://g.com/packet.PDF">Packet</a></td></tr>
<tr class="odd"><td class="listedItem">Jan 7, 2025</td><td class="listedItem">Agenda</td></tr>
<tr><td class="listItem">Workshop (cancelled)</td><td class="listItem">3/9/2025</td><td><select><option value="AgendaViewer.php?event_id=8">Agenda</option></select></td></tr>
<tr><td class="listItem">Undated</td><td class="listItem">To be announced</td></tr><tr><th>Name</th><th>Date</th></tr></table></div>
<ul><li class="table-row table-row--head"><div class="table-cell">Name</div><div class="table-cell">Date</div></li><li class="table-row"><div class="table-cell">Metro Board</div><div class="table-cell">April 2, 2025</div></li></ul>"""


def response(vendor, kind, body, at="2025-01-01T00:00:00", city="oak", url="https://g.com/x/9"):
    return (vendor, city, kind, url, at, body if isinstance(body, str) or body is None else json.dumps(body))


def saved(spark, path, *rows):
    return feeds.publish(spark, str(path), spark.createDataFrame(list(rows), feeds.RESPONSE))


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feeds") / "in"
    saved(spark, path, response("legistar", "events", EVENTS), response("legistar", "events", XML), response("legistar", "events", FEED), response("legistar", "event_items", ITEMS))
    saved(spark, path, response("civicclerk", "events", CLERK), response("civicclerk", "agenda", TREE), response("granicus", "listing", LISTING), response("granicus", "listing", "<p>nothing"))
    (path / "odd").mkdir()
    (path / "odd" / "a.json").write_text('no json\n[1]\n\n{"vendor": "nobody", "body": "x"}\n' + json.dumps({"vendor": "legistar", "kind": "events", "city": "elm", "body": "{broken"}) + "\n" + json.dumps({"vendor": "civicclerk", "kind": "events", "city": "elm", "body": None}))
    feeds.add_files(spark, str(path), "odd")
    rows = feeds.responses(spark, str(path))
    return path, rows, *feeds.meetings(rows)


def by_id(df, vendor, *columns):
    return {r["vendor_id"]: tuple(r[c] for c in columns) for r in df.where(F.col("vendor") == vendor).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")).collect()}


def test_legistar_json_and_xml(read):
    _, rows, good, bad = read
    got = by_id(good, "legistar", "title", "start", "agenda_url")
    assert got == {
        "11": ("City Council", "2025-03-04 18:30", "https://x/a.pdf"), "12": ("Board", "2025-03-05 00:00", None), "21": ("Parks & Trees", "2025-04-01 09:00", None),
        "22": ("Zoning", "2025-04-02 00:00", None), "31": ("Library", "2025-05-01 00:00", None),
    }
    held = sorted((r["vendor_id"] or "", r["title"] or "", *r["failed"]) for r in bad.where("vendor = 'legistar' and city = 'oak'").collect())
    assert held == [("", "No id", "vendor_id"), ("13", "", "title"), ("14", "No day", "start")]
    items = feeds.legistar_items(rows.where("vendor = 'legistar' and city = 'oak'")).collect()
    assert [(r["item_id"], r["title"], r["sequence"], r["matter_file"], [tuple(a) for a in r["attachments"]]) for r in items] == [("1", "Budget", 4, "25-1", [("Memo", "https://x/m.pdf")])]


def test_civicclerk(read):
    _, rows, good, bad = read
    got = by_id(good, "civicclerk", "title", "start", "location", "agenda_url", "packet_url", "minutes_url")
    assert got == {"5": ("Council", "2025-03-04 18:30", "1 Main, Oak", "https://c/a", "https://c/p", "https://c/m")}
    assert [r["failed"] for r in bad.where("vendor = 'civicclerk' and city = 'oak'").collect()] == [["start"]]
    items = feeds.civicclerk_items(rows.where("vendor = 'civicclerk' and city = 'oak'")).orderBy("sequence").collect()
    assert [(r["meeting_id"], r["item_id"], r["title"], r["agenda_number"], [tuple(a) for a in r["attachments"]]) for r in items] == [("9", "2", "Minutes of May", "A.1", [("m", "https://c/1")]), ("9", "3", "Inner", None, []), ("9", "4", "Hearing", None, [])]


def test_granicus(read):
    _, _, good, bad = read
    got = sorted(by_id(good, "granicus", "title", "start", "status", "agenda_url", "packet_url", "minutes_url").values())
    assert got == [
        ("City Council", "2025-03-04 18:30", None, "https://g.com/AgendaViewer.php?view_id=1&clip_id=77", "https://g.com/packet.PDF", "https://g.com/files/minutes.pdf"),
        ("Metro Board", "2025-04-02 00:00", None, None, None, None),
        ("Planning Board", "2025-01-07 00:00", None, None, None, None),
        ("Workshop (cancelled)", "2025-03-09 00:00", "cancelled", "https://g.com/AgendaViewer.php?event_id=8", None, None),
    ]
    assert {"77", "8"} <= set(by_id(good, "granicus", "title"))
    assert [(r["title"], r["failed"]) for r in bad.where("vendor = 'granicus'").collect()] == [("Undated", ["vendor_id", "start"])]


def test_what_is_no_response_is_held(read):
    _, rows, _, bad = read
    held = sorted((r["line"], *r["failed"]) for r in bad.where("vendor is null or vendor = 'nobody' or city = 'elm'").collect())
    assert held == [(1, "no_json"), (2, "no_object"), (4, "unknown_vendor"), (5, "unreadable_body"), (6, "unreadable_body")]
    assert rows.count() == 13


def test_newest_record_wins(spark, tmp_path):
    event = lambda name: [{"EventId": 1, "EventBodyName": name, "EventDate": "2025-01-01T00:00:00"}]
    saved(spark, tmp_path, response("legistar", "events", event("newer"), "2025-02-02"), response("legistar", "events", event("older"), "2025-02-01"), response("legistar", "events", event("elsewhere"), city="elm"))
    good, _ = feeds.meetings(feeds.responses(spark, str(tmp_path)))
    assert sorted(r["title"] for r in feeds.current(good).collect()) == ["elsewhere", "newer"]


def test_no_batches(spark, tmp_path):
    good, bad = feeds.meetings(feeds.responses(spark, str(tmp_path / "none")))
    assert good.count() == bad.count() == 0


def test_a_stream_resumes_within_its_limit(spark, tmp_path):
    event = lambda i: [{"EventId": i, "EventBodyName": f"Body {i}", "EventDate": "2025-01-01T00:00:00"}, {"EventId": i}]
    for i in range(3):
        saved(spark, tmp_path / "in", response("legistar", "events", event(i)))

    def run():
        args = [str(tmp_path / x) for x in ("in", "good", "bad", "ck")]
        query = feeds.ingest(spark, *args, reader="r", most=2).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        names = lambda folder: {int(p.name.split("=")[1]): sorted(r["vendor_id"] for r in spark.read.parquet(str(p)).collect()) for p in sorted((tmp_path / folder).glob("batch=*"))}
        return names("good"), names("bad")

    assert run() == ({0: ["0", "1"], 1: ["2"]}, {0: ["0", "1"], 1: ["2"]})
    for i in range(3, 8):
        saved(spark, tmp_path / "in", response("legistar", "events", event(i)))
    good, bad = run()
    assert sorted(x for v in good.values() for x in v) == sorted(x for v in bad.values() for x in v) == [str(i) for i in range(8)]
    assert max(map(len, good.values())) == 2  # the limit holds after the restart, and nothing is read twice
