"""The web source over a made-up transport, service readers and the streams."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pagewright.sources import web
from pagewright.streaming import usage

SITE = {
    "https://a.com/": web.Response(200, {"content-type": "text/html", "etag": "e"}, b"<p>hi"), "https://a.com/r": web.Response(301, {"location": "https://www.a.com/x"}), "https://www.a.com/x": web.Response(200, {"content-type": "text/calendar"}, b"BEGIN"),
    "https://a.com/off": web.Response(302, {"location": "https://b.com/"}), "https://a.com/loop": web.Response(302, {"location": "/loop"}), "https://a.com/png": web.Response(200, {"content-type": "image/png"}), "https://a.com/304": web.Response(304),
}


def offline(url: str, headers: dict[str, str]) -> web.Response:
    return SITE.get(url) or web.Response(404, {"content-type": "text/html"})


def test_fetch_and_outcomes(spark):
    rows = [web.fetch(u, offline) for u in [*SITE, "https://a.com/none", "http://a.com/", "https://10.0.0.1/"]]
    names = [c.split()[0] for c in web.SCHEMA.split(", ")]
    got = {r.url: r for r in web.outcomes(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], web.SCHEMA)).collect()}
    told = {u.split("//")[1]: (r.outcome, r.reason, r["class"], r.kind) for u, r in got.items() if u.startswith("https")}
    assert told["a.com/"] == ("ok", None, None, "html") and told["a.com/r"][:2] == ("ok", None) and got["https://a.com/r"].final_url == "https://www.a.com/x"
    assert told["a.com/off"][:3] == ("failed", "blocked", "structural") and told["a.com/loop"][:3] == ("failed", "unreachable", "transient") and told["a.com/none"][:3] == ("failed", "unreachable", "structural")
    assert told["a.com/png"][:3] == ("failed", "empty", "structural") and told["a.com/304"][0] == "not_modified" and told["10.0.0.1/"][1] == got["http://a.com/"].reason == "blocked"


def test_source_keeps_hosts_together(spark):
    spark.dataSource.register(web.WebPages)
    got = spark.read.format("web_pages").option("urls", "https://10.0.0.1/a\nhttps://10.0.0.1/b\nhttp://c.com/").option("partitions", 2).load()
    assert got.count() == 3 and got.filter("error like 'blocked%'").count() == 3
    assert sorted(len(p.requests) for p in web._Reader([{"url": u} for u in ("https://a/1", "https://b/1", "https://a/2")], {"partitions": "2"}).partitions()) == [1, 2]


def picky(url: str, headers: dict[str, str]) -> web.Response:
    """Answers 304 to a known validator and tells which headers came."""
    if headers.get("if-none-match") == "e1" or headers.get("if-modified-since"):
        return web.Response(304, {"etag": "e1"})
    return web.Response(200, {"content-type": "text/plain", "etag": "e1"}, " ".join(f"{k}={v}" for k, v in sorted(headers.items())).encode())


def names_only(host: str) -> list[str]:
    return {"a.com": ["93.184.216.34"], "www.a.com": ["93.184.216.34", "10.0.0.7"], "six.com": ["2606:2800:220:1::1"], "mapped.com": ["::ffff:127.0.0.1"], "odd.com": ["not an address"]}.get(host, [])


def test_validators_and_headers_go_out(spark):
    asked = [("https://a.com/1", None, None, {"Cookie": "x=1", "Host": "evil", "User-Agent": "no"}), ("https://a.com/2", "e1", None, None), ("https://a.com/3", None, "Thu, 01 Jan 2026 00:00:00 GMT", {}), (None, None, None, None), ("https://six.com/", "old", None, None), ("https://mapped.com/", None, None, None), ("https://none.com/", None, None, None)]
    rows = spark.createDataFrame(asked, "url string, etag string, last_modified string, headers map<string,string>")
    got = {r.url: r for r in web.fetch_pages(rows, "tests.test_sources:picky", "tests.test_sources:names_only").collect()}
    sent = bytes(got["https://a.com/1"].body).decode()
    assert "cookie=x=1" in sent and "evil" not in sent and "user-agent=no" not in sent and got["https://a.com/2"].status == got["https://a.com/3"].status == 304
    assert got[None].error.startswith("blocked") and got["https://six.com/"].status == 200
    assert all("DNS" in got[f"https://{h}/"].error for h in ("mapped.com", "none.com")) and len(got) == 7
    spark.dataSource.register(web.WebPages)
    read = spark.read.format("web_pages").option("requests", json.dumps({"url": "https://a.com/x", "etag": "e1"})).option("transport", "tests.test_sources:picky").load()
    assert [r.status for r in read.collect()] == [304]


def test_addresses_are_looked_up_on_every_hop():
    assert web.fetch("https://a.com/r", offline, resolver=names_only)["error"].startswith("blocked: DNS")
    assert web.fetch("https://a.com/", offline, resolver=names_only)["status"] == 200
    assert not web.resolves_publicly("odd.com", names_only)


def test_failures_that_may_pass_are_tried_again():
    def flaky(answers):
        left = iter(answers)

        def send(url, headers):
            x = next(left)
            if isinstance(x, Exception):
                raise x
            return x

        return send

    waits: list[float] = []
    ok, busy = web.Response(200), web.Response(503, {"retry-after": "7"})
    assert web.fetch_again("https://a.com/", flaky([busy, TimeoutError("slow"), ok]), sleep=waits.append)["status"] == 200 and waits == [7.0, 1.0]
    assert web.fetch_again("https://a.com/", flaky([busy, busy, busy]), sleep=waits.append)["status"] == 503
    assert web.fetch_again("https://a.com/", flaky([web.Response(404)]), sleep=waits.append)["status"] == 404
    assert web.fetch_again("http://a.com/", flaky([]))["error"].startswith("blocked")
    assert "slow" in web.fetch_again("https://a.com/", flaky([TimeoutError("slow")] * 2), retries=1, sleep=waits.append)["error"]


ROBOTS = {
    "https://a.com/robots.txt": web.Response(200, {}, b"User-agent: *"), "https://b.com/robots.txt": web.Response(301, {"location": "https://c.com/robots.txt"}), "https://c.com/robots.txt": web.Response(403), "https://d.com/robots.txt": web.Response(429),
    "https://e.com/robots.txt": web.Response(302, {"location": "ftp://e.com/x"}), "https://f.com/robots.txt": web.Response(302, {"location": "/robots.txt"}), "https://g.com/robots.txt": web.Response(302, {"location": "https://10.0.0.1/"}), "https://h.com/robots.txt": web.Response(302, {}),
}


def test_robots_are_followed():
    def send(url, headers):
        if url not in ROBOTS:
            raise TimeoutError
        return ROBOTS[url]

    got = {h: web.fetch_robots(f"https://{h}.com/p?q", send) for h in "abcdefghi"}
    assert got["a"]["policy"] is None and got["a"]["body"] == "User-agent: *" and got["b"]["policy"] == got["c"]["policy"] == "allow" and got["b"]["moved_to"] == "c.com" and got["c"]["moved_to"] is None
    assert {got[h]["policy"] for h in "defghi"} == {"unknown"} and len({got[h]["reason"] for h in "defgi"}) == 5 and got["f"]["reason"] == got["h"]["reason"]
    assert web.fetch_robots("mailto:x", send)["policy"] == web.fetch_robots("https://127.0.0.1/", send)["policy"] == "unknown"
    assert web.fetch_robots("https://a.com/", send, lambda h: ["10.1.1.1"])["reason"] == "no public address"


def test_archive_and_files(spark, tmp_path):
    rows = [("u", "20260101000000", 200), ("u", "20260301000000", 404), ("u", "20260201000000", 200), ("v", "20200101000000", 200)]
    caps = spark.createDataFrame(rows, "url string, stamp string, status int")
    assert [(r.url, r.captured_at) for r in web.newest_capture(caps, 60, "2026-03-01").collect()] == [("u", "2026-02-01T00:00:00Z")]
    (tmp_path / "x.ics").write_text("BEGIN:VCALENDAR")
    r = web.read_bodies(spark, str(tmp_path), "text/plain").first()
    assert (r.text, r.content_kind) == ("BEGIN:VCALENDAR", "calendar")


def _stream(spark, folder, rows, schema):
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(map(json.dumps, rows)))
    return spark.readStream.schema(schema).json(str(folder))


def _drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [{"ts": (t0 + timedelta(minutes=20 * k)).isoformat(), "kind": "a", "ok": k % 2 == 0, "url": f"u{k % 2}"} for k in range(6)]
    events = _stream(spark, tmp_path / "in", rows, "ts timestamp, kind string, ok boolean, url string")
    got = _drain(usage.windowed_rollup(events), "rolled", "complete", tmp_path)
    assert sorted((r.n, r.failures) for r in got) == [(3, 1), (3, 2)]
    assert len(_drain(usage.first_sightings(events.select("ts", "url")), "seen", "append", tmp_path)) == 2
    rungs = [{"host": "h", "event_id": k, "at_ms": at, "rung": r, "won": w} for k, (at, r, w) in enumerate([(0, "reader", True), (1_799_999, "reader", True), (2_000_000, "x", False), (3_000_000, "reader", False), (3_600_000, "y", True)])]
    memory = usage.rung_memory(_stream(spark, tmp_path / "rungs", rungs, "host string, event_id long, at_ms long, rung string, won boolean"))
    assert [r.remembered for r in sorted(_drain(memory, "rungs", "append", tmp_path), key=lambda r: r.event_id)] == [None, "reader", "reader", "reader", None]


def test_streams_with_state_that_ends(spark, tmp_path):
    asked = [{"url": "u", "request_id": k, "at_ms": at} for k, at in enumerate((0, 50, 100, 149, 250))] + [{"url": "v", "request_id": 9, "at_ms": 10}]
    got = _drain(usage.cached(_stream(spark, tmp_path / "asked", asked, "url string, request_id long, at_ms long"), 100), "cached", "append", tmp_path)
    assert {r.request_id: r.hit for r in got} == {0: False, 1: True, 2: False, 3: True, 4: False, 9: False}
    found = [{"host": "h", "event_id": k, "at_ms": at, "found": f} for k, (at, f) in enumerate([(0, None), (299_999, "allow"), (300_000, "allow"), (300_000 + 21_599_999, "disallow"), (300_000 + 21_600_000, "disallow")])]
    got = _drain(usage.robots_posture(_stream(spark, tmp_path / "found", found, "host string, event_id long, at_ms long, found string")), "posture", "append", tmp_path)
    assert [(r.policy, r.ask) for r in sorted(got, key=lambda r: r.event_id)] == [("unknown", True), ("unknown", False), ("allow", True), ("allow", False), ("disallow", True)]


def test_validator_versions(spark, tmp_path):
    row = lambda at, e: ("t", "u", at, e, None, "r", "x")
    names = "target string, url string, at_ms long, etag string, last_modified string, content_region_sha256 string, text_sha256 string"
    for batch in ([row(1, "a"), row(2, "b")], [row(3, "c")]):
        usage.append_validators(spark.createDataFrame(batch, names), str(tmp_path / "v"))
    assert [(r.etag, r.at_ms) for r in usage.current_validators(spark.read.parquet(str(tmp_path / "v"))).collect()] == [("c", 3)]
