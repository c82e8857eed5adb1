"""The paged source against a server of its own: order of pages, end, fallback, retries, budget, resuming."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lakeloom.sources import paged
from lakeloom.sources.readers import payload_rows

ROWS, SIZE = 47, 5


class Api(BaseHTTPRequestHandler):
    seen: Counter = Counter()
    rows = ROWS
    ends_with = "empty"

    def do_GET(self):
        parts = self.path.strip("/").split("/")
        version, endpoint, offset = parts[0], parts[1], int(parts[3]) if len(parts) > 3 else 0
        self.seen[version, endpoint, offset] += 1
        n = self.seen[version, endpoint, offset]
        status, body = 200, {"meta": {"results-max": str(SIZE), "pages-total": "2"}, "success": "1", endpoint: {f"r{i}": {"id": i} for i in range(offset, min(offset + SIZE, self.rows))}}
        if version == "v4" and endpoint == "down":
            status = 503
        if endpoint == "busy" and offset == 10 and n < 3:
            status = 429
        if endpoint == "gone":
            status = 404
        if endpoint == "refused":
            body = {"success": "0", "error": {"message": "OUT_OF_CALLS", "detail": "later"}}
        if endpoint == "named" and offset >= self.rows:
            body = {"error": "NO_DATA"}
        text = json.dumps(body)
        if endpoint == "torn" and n == 1:
            text = text[:20]
        self.send_response(status)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def api(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    paged.register(spark)
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def ask(spark, api, endpoint, **options):
    o = {"endpoint": endpoint, "base": f"{api}/v4", "fallback": f"{api}/v3", "readers": "3", "wait": "0.01", "calls_per_hour": "1000000"} | options
    return spark.read.format("paged_json").options(**o).load()


def ids(df):
    return sorted(r["id"] for r in payload_rows(df.select("page", "response"), "response", "struct<id:int>").select("row.id").collect())


@pytest.mark.parametrize("endpoint", ["plain", "down", "busy", "torn", "named"])
def test_all_pages_are_read(spark, api, endpoint):
    df = ask(spark, api, endpoint)
    rows = df.collect()
    assert sorted(r["page"] for r in rows) == list(range(-(-ROWS // SIZE))) and {r["range"] for r in rows} == {""}
    assert ids(spark.createDataFrame(rows, df.schema)) == list(range(ROWS))
    beyond = [k for k in Api.seen if k[1] == endpoint and k[2] >= ROWS]
    assert len({k[2] for k in beyond}) <= 3  # a call a reader beyond the end
    if endpoint == "down":
        assert all(n <= 6 for (v, e, _), n in Api.seen.items() if e == "down" and v == "v4") and not any(k[0] == "v4" and k[2] > 3 * SIZE for k in Api.seen if k[1] == "down")


def test_landed_pages_are_not_asked_for(spark, api):
    landed = json.dumps([["2026", p] for p in range(8)])
    rows = ask(spark, api, "later", ranges="2026", page_size=str(SIZE), landed=landed).collect()
    assert sorted(r["page"] for r in rows) == [8, 9] and all(k[2] >= 8 * SIZE for k in Api.seen if k[1] == "later")
    assert {r["range"] for r in rows} == {"2026"}


def test_errors_end_the_read(spark, api):
    for endpoint, said in (("gone", "404"), ("refused", "OUT_OF_CALLS")):
        with pytest.raises(Exception, match=said):
            ask(spark, api, endpoint, page_size=str(SIZE)).collect()
    with pytest.raises(Exception, match="max_pages"):
        ask(spark, api, "plain", page_size=str(SIZE), max_pages="4").collect()


def test_stream_goes_on_where_it_ended(spark, api, tmp_path):
    o = {"endpoint": "fresh", "base": f"{api}/v4", "page_size": str(SIZE), "calls_per_hour": "1000000", "pages_per_batch": "4"}

    def run(rows):
        Api.rows = rows
        try:
            q = spark.readStream.format("paged_json").options(**o).load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "t"))
            q.processAllAvailable()
            q.stop()
        finally:
            Api.rows = ROWS
        return sorted(r["page"] for r in spark.read.parquet(str(tmp_path / "t")).collect())

    assert run(30) == list(range(6))
    assert run(50) == list(range(10))
    assert max(n for k, n in Api.seen.items() if k[1] == "fresh" and k[2] < 30) <= 2


def test_budget_waits():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    b = paged.Budget(3600, lambda: now[0], sleep)
    b.left = 2.0
    for _ in range(5):
        b.take()
    assert waits == pytest.approx([1.0, 1.0, 1.0])


def test_urls_and_bodies():
    c = paged.Client(["http://a/KEY", "http://b"], paged.Budget(10))
    assert [c.url("teams", None, 0), c.url("games", "2026,DUKE", 0), c.url("players", None, 100), c.url("games;playbyplay,lineups", "2026-03-15", 200)] == ["http://a/KEY/teams", "http://a/KEY/games/2026,DUKE", "http://a/KEY/players/_/100", "http://a/KEY/games;playbyplay,lineups/2026-03-15/200"]
    empty = [{"meta": {"page": 1}, "user": {}, "success": "1"}, {"meta": {}, "elo": {}}, {"rows": []}, {"rows": None}, [], {}]
    assert all(map(paged.is_empty, empty)) and not paged.is_empty({"meta": {}, "elo": {"t": 1}})
    assert paged.page_size({"meta": {"results-max": "100"}}) == paged.page_size({"meta": {"results-max": 100}}) == 100 and paged.calls_left({"user": {"ratelimit-remaining": "423"}}) == 423
    with pytest.raises(paged.ApiError, match="OUT_OF_CALLS"):
        paged.checked({"error": {"message": "OUT_OF_CALLS"}})
    with pytest.raises(paged.ApiError, match="API_ERROR: why"):
        paged.checked({"success": 0, "meta": {"description": "why"}})


def test_waits_double():
    waits = []
    c = paged.Client(["http://a"], paged.Budget(1e9), retries=3, wait=1.0, get=lambda *_: (429, ""), sleep=waits.append)
    with pytest.raises(OSError, match="in vain"):
        c.page("x", None, 0)
    assert waits == [1, 2, 4, 8]

