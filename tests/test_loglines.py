"""Log lines to entries, on small files of every layout."""

from datetime import date, datetime

from pyspark.sql import functions as F

from sightline.operators.loglines import found_form, level_name, parse_entries, valid_address

AT = datetime(2026, 1, 13, 11)
FILES = [("java", None, None, date(2026, 5, 1)), ("py", None, "Asia/Tokyo", date(2026, 5, 1)), ("glog", None, "Europe/Berlin", date(2026, 12, 30)), ("sys", None, None, date(2026, 2, 3)), ("tab", None, "Asia/Tokyo", date(2026, 9, 17)), ("odd", None, None, date(2026, 1, 1)), ("json", None, None, None)]
LINES = {
    "java": ["stray", "[2026-05-01T10:00:00.500+02:00] [Warning] [cache.tier] slow", "java.lang.X: boom", "\tat a.b(C.java:1)", "# rotated", "\t... 3 more", "[2026-05-01T10:00:01.000+02:00] [SEVERE] [edge] ok"],
    "py": ["2026-05-01 09:00:00 - cache.tier - FATAL - died", "Traceback (most recent call last):", "  File \"x\", line 1", "ValueError: bad", "2026-05-01 09:00:01,123 notice   robots.reload: fine", "2026-05-01 09:00:02 - INFO - edge.router - swapped"],
    "glog": ["W1231 23:59:59.000001   458 cidr_match.cc:596] over", "*** Check failure stack trace: ***", "    @ 0x1f step()", "I0101 00:00:01.000000 1 a.cc:2] new year"],
    "sys": ["<133>Feb  3 03:29:36 node-16 botguardd[5599]: hello", "<136>Feb 13 04:00:00 node robotsd: x", "not an entry"],
    "tab": ["#Version: 1.0", "#Fields: c-ip date time cs(User-Agent) cs-uri-stem", "192.0.2.1\t2026-09-17\t08:00:00\tA%20b\t/x", "not a request", "#Fields: date time c-ip", "2026-09-17\t09:00:00\tfe80::1%eth0", "too\tfew"],
    "json": ['{"Timestamp": 1771105009, "Client-IP": "203.0.113.193", "User-Agent": "A \\"q\\""}', "{", '  "timestamp": "14/Feb/2026:15:48:01 -0600",', '  "clientIp": "2001:db8::1"', "}", "EOF", '203.0.113.5 - svc [12/May/2026:19:25:33 +0000] "GET /x HTTP/1.1" 200 5 "-" "U \\"x\\" 1"', '999.1.1.1 - - [12/May/2026:19:25:34 +0000] "GET / HTTP/1.1" 200 5', 'lvl=err ts="2026-08-12 02:11:06 +0300" msg="a b" ip=198.51.100.75 comp=robots.reload'],
    "odd": [
        "[2026-05-01T10:00:00Z] [cidr.match] [ERROR] x", "2026-05-01 10:00:01 - 40 - cidr.match - y", "[2026-05-01T10:00:02Z] [30] [a.b:77] z", 'ts=2026-05-01T10:00:03Z lvl=30 msg="a comp=zz ip=9.9.9.9" src_ip=192.0.2.1 module=a.b',
        '{"time": "2026-05-01T10:00:04Z", "level": 50, "msg": "say \\"ip\\": \\"9.9.9.9\\" {", "remote_ip": "192.0.2.9", "logger": "x.y"}', '2001:0db8:8a2e:a3f1:1c9e:8a2e:3f7b:7a4c - John von Long Name [01/May/2026:10:00:05 +0000] "GET / HTTP/1.1" 200 5',
        "<134>1 2026-05-01T10:00:06Z host appd 12 - - hi", "May  1 10:00:07 host cron[3]: tick", "W0501 10:00:08.000001 7 /very/long/source/path/of/some/module/that/goes/on/file.cc:12] q", "2026-05-01 10:00:09 [edge.router] [WARN] ww", "[2026-05-01T10:00:10Z] [notice] one slot",
    ],
}
WANT = [
    ("odd", 1, 1, "2026-05-01 10:00:00", "ERROR", "cidr.match", ""), ("odd", 2, 2, "2026-05-01 10:00:01", "ERROR", "cidr.match", ""), ("odd", 3, 3, "2026-05-01 10:00:02", "WARN", "a.b", ""), ("odd", 4, 4, "2026-05-01 10:00:03", "WARN", "a.b", "192.0.2.1"),
    ("odd", 5, 5, "2026-05-01 10:00:04", "ERROR", "x.y", "192.0.2.9"), ("odd", 6, 6, "2026-05-01 10:00:05", "", "", "2001:0db8:8a2e:a3f1:1c9e:8a2e:3f7b:7a4c"), ("odd", 7, 7, "2026-05-01 10:00:06", "INFO", "appd", ""), ("odd", 8, 8, "2026-05-01 10:00:07", "", "cron", ""),
    ("odd", 9, 9, "2026-05-01 10:00:08", "WARN", "/very/long/source/path/of/some/module/that/goes/on/file.cc", ""), ("odd", 10, 10, "2026-05-01 10:00:09", "WARN", "edge.router", ""), ("odd", 11, 11, "2026-05-01 10:00:10", "INFO", "", ""),
    ("java", 2, 6, "2026-05-01 08:00:00", "WARN", "cache.tier", ""), ("java", 7, 7, "2026-05-01 08:00:01", "ERROR", "edge", ""),
    ("py", 1, 4, "2026-05-01 00:00:00", "FATAL", "cache.tier", ""), ("py", 5, 5, "2026-05-01 00:00:01", "INFO", "robots.reload", ""), ("py", 6, 6, "2026-05-01 00:00:02", "INFO", "edge.router", ""),
    ("glog", 1, 3, "2026-12-31 22:59:59", "WARN", "cidr_match.cc", ""), ("glog", 4, 4, "2026-12-31 23:00:01", "INFO", "a.cc", ""),
    ("sys", 1, 1, "2026-02-03 03:29:36", "INFO", "botguardd", ""), ("sys", 2, 2, "2026-02-13 04:00:00", "FATAL", "robotsd", ""),
    ("tab", 3, 3, "2026-09-17 08:00:00", "", "", "192.0.2.1"), ("tab", 6, 6, "2026-09-17 09:00:00", "", "", ""),
    ("json", 1, 1, "2026-02-14 21:36:49", "", "", "203.0.113.193"), ("json", 2, 5, "2026-02-14 21:48:01", "", "", "2001:db8::1"),
    ("json", 7, 7, "2026-05-12 19:25:33", "", "", "203.0.113.5"), ("json", 8, 8, "2026-05-12 19:25:34", "", "", ""), ("json", 9, 9, "2026-08-11 23:11:06", "ERROR", "robots.reload", "198.51.100.75"),
]


def _tables(spark):
    rows = [(f, n, line, AT, "extra") for f, lines in LINES.items() for n, line in enumerate(lines, 1)]
    lines = spark.createDataFrame(rows + rows[::3] + [("java", 99, None, AT, "x"), ("java", 98, "", AT, "x"), (None, 1, "x", None, None), ("java", None, "x", AT, None)], "log_file STRING, line_no BIGINT, raw_line STRING, received_at TIMESTAMP, layout STRING")
    return lines, spark.createDataFrame(FILES, "log_file STRING, layout_hint STRING, zone_name STRING, opened_on DATE")


def test_every_layout(spark):
    lines, files = _tables(spark)
    assert sorted(map(tuple, found_form(parse_entries(lines, files)).collect())) == sorted(WANT)


def test_agents_and_messages(spark):
    got = {(r.log_file, r.first_line_no): (r.user_agent, r.message) for r in parse_entries(*_tables(spark)).collect()}
    assert got["json", 7] == ('U \\"x\\" 1', "GET /x HTTP/1.1") and got["json", 1][0] == 'A "q"' and got["json", 9][1] == "a b" and got["tab", 3][0] == "A b" and got["java", 2][1] == "slow"


def test_continuations_cross_blocks(spark, monkeypatch):
    import sightline.operators.loglines as module

    monkeypatch.setattr(module, "_BLOCK", 2)
    lines, files = _tables(spark)
    assert sorted(map(tuple, found_form(parse_entries(lines, files)).collect())) == sorted(WANT)


def test_empty_and_long(spark):
    lines, files = _tables(spark)
    assert parse_entries(lines.limit(0), files.limit(0)).count() == 0
    long = spark.createDataFrame([("f", 1, "[2026-05-01T10:00:00Z] [info] [x] " + "y" * 200_000, AT)], "log_file STRING, line_no BIGINT, raw_line STRING, received_at TIMESTAMP")
    assert len(parse_entries(long, files).first().message) == 200_000


def test_long_fields_before_the_deciding_symbols(spark):
    addresses = ["2001:0db8:85a3:08d3:1319:8a2e:0370:7344", "2a02:26f7:c9c4:6a3e:0:f1a2:b3c4:d5e6"]
    raw = [f'{a} - svc [13/Jan/2026:10:00:00 +0000] "GET /x HTTP/1.1" 200 5 "-" "U"' for a in addresses]
    raw += ['192.0.2.1 - a.b-c.d-e.f-g.h-i.j-k.l-m.n-o.p [13/Jan/2026:10:00:00 +0000] "GET / HTTP/1.1" 200 5', "W0113 10:00:00.000001   458 a/b-c/d.e/f-g/h.i/j-k/l.m/n-o/p.q/r.cc:596] over", "more"]
    lines = spark.createDataFrame([("f", n, t, AT) for n, t in enumerate(raw, 1)], "log_file STRING, line_no BIGINT, raw_line STRING, received_at TIMESTAMP")
    files = spark.createDataFrame([("f", None, date(2026, 1, 1))], "log_file STRING, zone_name STRING, opened_on DATE")
    got = sorted((r.first_line_no, r.last_line_no, r.client_ip, r.component) for r in parse_entries(lines, files).collect())
    assert got == [(1, 1, addresses[0], ""), (2, 2, addresses[1], ""), (3, 3, "192.0.2.1", ""), (4, 5, "", "a/b-c/d.e/f-g/h.i/j-k/l.m/n-o/p.q/r.cc")]


def test_addresses_and_levels(spark):
    import ipaddress

    texts = ["1.2.3.4", "01.2.3.4", "1.2.3", "::", "::1", "1::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "12345::", "", "x", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]

    def ok(t):
        try:
            return "%" not in t and bool(ipaddress.ip_address(t))
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r.t: r.v for r in df.select("t", valid_address(F.col("t")).alias("v")).collect()} == {t: ok(t) for t in texts}
    words = spark.createDataFrame([("Panic",), ("W",), ("Information",), ("what",), (None,)], "w STRING")
    assert [r[0] for r in words.select(level_name(F.col("w"))).collect()] == ["FATAL", "WARN", "INFO", None, None]
