"""The mail source over recorded pages, and messages of nested parts."""

import base64
import json

import pytest

from ledgerloom.sources import mail
from ledgerloom.streaming import pipeline as p


def coded(text):
    raw = text if isinstance(text, bytes) else text.encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def part(kind, text=None, parts=None, **more):
    return {"mimeType": kind, "body": {"data": coded(text)} if text is not None else {}, **({"parts": parts} if parts else {}), **more}


class Recorder:
    """Writes what a mailbox would answer."""

    def __init__(self, path):
        self.path = path
        for d in ("search", "history", "messages"):
            (path / d).mkdir(parents=True)
        self.ids = []

    def put(self, name, value):
        (self.path / f"{name}.json").write_text(json.dumps(value))

    def add(self, *ids, at):
        for i in ids:
            self.put(f"messages/{i}", {"id": i, "threadId": "t", "historyId": str(at), "internalDate": "1700000000000", "snippet": "s", "payload": part("text/plain", f"body of {i}")})
            self.ids.append(i)
        self.put("profile", {"historyId": str(at)})

    def search(self, size):
        pages = [self.ids[k : k + size] for k in range(0, len(self.ids), size)]
        for k, page in enumerate(pages):
            self.put(f"search/{k or 'first'}", {"messages": [{"id": i} for i in page]} | ({"nextPageToken": str(k + 1)} if k + 1 < len(pages) else {}))

    def history(self, start, *pages):
        for k, page in enumerate(pages):
            records = [{"id": str(at), "messagesAdded": [{"message": {"id": i}} for i in ids]} for at, ids in page]
            self.put(f"history/{start}" + (f"-{k}" if k else ""), {"history": records} | ({"nextPageToken": str(k + 1)} if k + 1 < len(pages) else {}))


@pytest.fixture
def box(spark, tmp_path):
    spark.dataSource.register(mail.MailSource)
    return Recorder(tmp_path / "box")


def options(reader, box):
    return reader.format("mail").option("path", str(box.path)).option("unitsPerSecond", 100_000)


def test_a_search_is_a_partition_for_each_page(spark, box):
    box.add(*(f"m{k}" for k in range(25)), at=100)
    box.search(10)
    df = options(spark.read, box).load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted(r.id for r in rows) == sorted(box.ids) and {(r.thread_id, r.history_id, r.internal_date) for r in rows} == {("t", 100, 1700000000000)}
    assert sorted(r.text for r in mail.read_bodies(df).collect()) == sorted(f"body of {i}" for i in box.ids)
    (box.path / "messages/m3.json").unlink()  # deleted between the page and the message
    assert options(spark.read, box).load().count() == 24


def test_a_search_ends_at_the_page_limit(spark, box):
    box.add(*(f"m{k}" for k in range(25)), at=100)
    box.search(5)
    with pytest.warns(UserWarning, match="more than 2 pages"):
        assert len(mail._Pages({"path": str(box.path), "maxpages": "2"}).search_pages(0)) == 2


def test_an_empty_mailbox(spark, box):
    assert options(spark.read, box).load().count() == 0


def poll(spark, box, tmp_path):
    stream = options(spark.readStream, box).load().select("id", "payload")
    p.backfill(stream, p.append_once(f"{tmp_path}/out", ["id"]), f"{tmp_path}/ck").awaitTermination()
    return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_history_is_read_from_the_last_id_and_an_unknown_id_starts_over(spark, box, tmp_path):
    box.add("a", "b", "c", at=100)
    box.search(2)
    assert poll(spark, box, tmp_path) == ["a", "b", "c"]
    # What comes later is read from the history of 100, page by page; the same id twice counts once.
    box.add("d", "e", at=110)
    box.history(100, [(105, ["d"]), (106, ["d"])], [(110, ["e"]), (120, ["z"])])
    (box.path / "search").rename(box.path / "no-search")
    assert poll(spark, box, tmp_path) == ["a", "b", "c", "d", "e"]
    assert poll(spark, box, tmp_path) == ["a", "b", "c", "d", "e"]  # nothing new
    # The mailbox has forgotten 110: the search is read again, and nothing comes twice.
    (box.path / "no-search").rename(box.path / "search")
    box.add("f", "g", at=130)
    box.search(2)
    assert poll(spark, box, tmp_path) == ["a", "b", "c", "d", "e", "f", "g"]
    # From there the history goes on.
    box.add("h", at=140)
    box.history(130, [(140, ["h"])])
    assert poll(spark, box, tmp_path) == ["a", "b", "c", "d", "e", "f", "g", "h"]


def test_a_batch_gives_the_same_pages_again(box):
    box.add("a", "b", at=10)
    box.history(5, [(6, ["a"])], [(10, ["b"]), (11, ["c"])])
    stream = mail._Stream({"path": str(box.path), "unitspersecond": "1e6"})
    for _ in range(2):
        pages = stream.partitions({"history": 5}, {"history": 10})
        assert [r[0] for page in pages for r in stream.read(page)] == ["a", "b"]
    assert stream.partitions({"history": 10}, {"history": 10}) == []


def test_the_quota_waits():
    now, slept = [0.0], []
    quota = mail.Quota(10, clock=lambda: now[0], sleep=slept.append)
    quota.take(5)
    quota.take(5)
    assert slept == []
    quota.take(5)
    assert slept == [0.5]
    now[0] = 10
    quota.take(10)
    assert slept == [0.5]


NESTED = part("multipart/mixed", parts=[
    part("multipart/alternative", parts=[part("text/html", "<div>This is HTML</div>"), part("multipart/related", parts=[part("text/plain", "first plain"), part("text/plain", "second")])]),
    part("application/pdf", None, filename="invoice.pdf", body={"attachmentId": "att1"}), part("application/octet-stream", b"%PDF-1.4", filename="B.PDF"), part("application/pdf", None),
    part("image/png", "x", filename="x.png"),
])


def test_parts_are_walked_to_any_depth():
    out = mail.walk_parts(json.dumps(NESTED))
    assert (out["plain"], out["html"], out["skipped"]) == ("first plain", "<div>This is HTML</div>", ["statement.pdf"])
    assert out["pdfs"] == [{"filename": "invoice.pdf", "attachment_id": "att1", "content": None}, {"filename": "B.PDF", "attachment_id": None, "content": b"%PDF-1.4"}]
    deep = part("text/plain", "deep")
    for _ in range(200):
        deep = part("multipart/mixed", parts=[deep])
    assert mail.walk_parts(json.dumps(deep))["plain"] == "deep"
    for bad in (None, "", "null", "[]", "{", '"x"', '{"parts": [1, null, {"mimeType": "text/plain", "body": {"data": "?"}}]}', "[" * 100_000):
        assert mail.walk_parts(bad) == {"plain": None, "html": None, "pdfs": [], "skipped": []}


def test_bodies(spark):
    html = "<html><head><style>.hidden { display: none; }</style><script>alert('hi');</script></head><body><div>Merchant: <span>Amazon</span></div><br><p>Total: $12.99</p></body></html>"
    cases = {
        "both": (NESTED, "first plain"), "quote": (part("text/plain", "Hello\n\n> This is a quote\n> another line\nMore body text"), "Hello\n\nMore body text"),
        "signature": (part("text/plain", "Hello\n\nBody content\n-- \nJohn Doe\n555-1234"), "Hello\n\nBody content"), "none": (part("multipart/mixed"), None), "null": (None, None),
    }
    blank = part("multipart/alternative", parts=[part("text/plain", " \n\t "), part("text/html", html)])
    rows = [(k, json.dumps(v[0])) for k, v in cases.items()] + [("blank", json.dumps(blank)), ("html", json.dumps(part("text/html", html)))]
    got = {r.id: r.text for r in mail.read_bodies(spark.createDataFrame(rows, "id string, payload string")).collect()}
    assert {k: got[k] for k in cases} == {k: v[1] for k, v in cases.items()}
    for k in ("blank", "html"):
        assert "Merchant: Amazon" in got[k] and "Total: $12.99" in got[k] and "alert" not in got[k] and ".hidden" not in got[k]
    assert mail.read_bodies(spark.createDataFrame([], "id string, payload string")).collect() == []
