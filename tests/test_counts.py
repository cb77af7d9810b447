from __future__ import annotations

import random
from collections import Counter

import pytest

from clftally import (
    avg_size_by_status,
    ip_counts,
    parse_access_log,
    parse_quality,
    request_counts,
    status_counts,
    status_share,
    top_ips,
    top_requests,
)
from clftally.plans.report import (
    register_view,
    report,
    report_table,
    section_counts,
    slice_report,
)
from tests.samples import LINES, line, rows
from tests.test_plans import plan_of

TILE, FEED = "GET /maps/tile?z=3 HTTP/1.1", "GET /feed.xml HTTP/1.0"


@pytest.fixture(scope="module")
def sample(spark):
    import pyarrow as pa

    return parse_access_log(spark.createDataFrame(pa.table({"value": LINES})))


def test_status_counts(sample):
    assert rows(status_counts(sample)) == [(204, 1), (206, 4), (304, 2), (403, 1), (503, 1)]
    by_count = [(206, 4), (304, 2), (204, 1), (403, 1), (503, 1)]
    assert rows(status_counts(sample, by_count=True)) == by_count
    with_malformed = [by_count[0], (None, 2), *by_count[1:]]
    assert rows(status_counts(sample, keep_malformed=True, by_count=True)) == with_malformed


def test_status_share(sample):
    share = status_share(sample)
    counted = [(204, 1), (206, 4), (304, 2), (403, 1), (503, 1)]
    label = {1: "11.1%", 2: "22.2%", 4: "44.4%"}
    got = [(r.status, r.status_label, r["count"], r.percent_label) for r in share.collect()]
    assert got == [(status, str(status), n, label[n]) for status, n in counted]
    assert [r.percent for r in share.collect()] == pytest.approx([n / 9 * 100 for _, n in counted])
    assert [r.scale for r in share.collect()] == pytest.approx([n / 4 for _, n in counted])
    assert dict(share.dtypes)["percent"] == "double"
    assert sum(row["percent"] for row in share.collect()) == pytest.approx(100)


def test_labels_round_halves_to_even(lines_of):
    """As formatting does elsewhere: 6.25 % is 6.2 %, 18.75 % is 18.8 %."""
    texts = [line(status=status) for status, n in (("200", 12), ("404", 1), ("500", 3)) for _ in range(n)]
    got = {r.status: r.percent_label for r in status_share(parse_access_log(lines_of(texts))).collect()}
    assert got == {200: "75.0%", 404: f"{6.25:.1f}%", 500: f"{18.75:.1f}%"} == {200: "75.0%", 404: "6.2%", 500: "18.8%"}


def test_ip_and_request_counts_with_ties_by_key(sample):
    ips = [("198.51.100.7", 4), ("198.51.100.9", 2), ("203.0.113.20", 2), ("192.0.2.133", 1)]
    assert rows(ip_counts(sample)) == ips
    assert rows(ip_counts(sample, keep_malformed=True)) == [ips[0], ("", 2), *ips[1:]]
    assert rows(top_ips(sample, 3)) == ips[:3]
    requests = rows(request_counts(sample))
    assert requests[:2] == [(TILE, 3), (FEED, 2)]
    assert requests[2:] == sorted(requests[2:]) and [n for _, n in requests[2:]] == [1] * 4
    assert rows(top_requests(sample, 3)) == requests[:3]
    assert rows(top_requests(sample, 3, keep_malformed=True)) == [(TILE, 3), ("", 2), (FEED, 2)]


def test_ties_by_first_occurrence(spark):
    """Like Python's ``Counter.most_common``, which lists equal counts as they first came."""
    pick = random.Random(7)
    keys = [f"10.0.0.{pick.randrange(60)}" for _ in range(400)]
    log = spark.createDataFrame([(i, line(ip=ip, request=f"GET /{ip} HTTP/1.1", status=str(200 + i % 7))) for i, ip in enumerate(keys)], "line_number long, value string")
    parsed = parse_access_log(log.repartition(5, "value"))
    want = Counter(keys).most_common(25)
    assert rows(top_ips(parsed, 25, position="line_number")) == want
    assert rows(top_requests(parsed, 25, position="line_number")) == [(f"GET /{ip} HTTP/1.1", n) for ip, n in want]
    assert rows(report(parsed, 25, ("top_ips",), position="line_number")["top_ips"]) == want
    table = report_table(parsed, 25, position="line_number")
    assert rows(table.filter("section = 'ip'").select("key", "count", "first")) == [(ip, n, keys.index(ip)) for ip, n in want]
    statuses = Counter(200 + i % 7 for i in range(400)).most_common()
    assert rows(table.filter("section = 'status'").select("key", "count")) == [(str(k), n) for k, n in statuses]
    assert "TakeOrderedAndProject" in plan_of(top_ips(parsed, 25, position="line_number"))


def test_mean_size(sample):
    valid = [(206, 686.25), (403, 77.0), (304, 15.0), (503, 5.0), (204, 0.0)]
    assert rows(avg_size_by_status(sample)) == valid
    assert rows(avg_size_by_status(sample, keep_malformed=True)) == [*valid, (None, None)]


def test_unknown_sizes_do_not_count_and_dash_counts_as_zero(lines_of):
    parsed = parse_access_log(lines_of([line(size=s) for s in ("10", "-", "x", "5000000000")]))
    assert rows(avg_size_by_status(parsed)) == [(200, (10 + 0 + 5_000_000_000) / 3)]


def test_quality(sample, lines_of):
    assert rows(parse_quality(sample)) == [(11, 9, 9, 9, 9)]
    odd = [line(stamp="x"), line(size="x"), line(), "junk", ""]
    assert rows(parse_quality(parse_access_log(lines_of(odd)))) == [(5, 3, 2, 3, 2)]
    assert rows(parse_quality(parse_access_log(lines_of([])))) == [(0, 0, 0, 0, 0)]


def test_empty_log(lines_of):
    parsed = parse_access_log(lines_of(["junk"]))
    for result in (status_counts, status_share, ip_counts, top_requests, avg_size_by_status):
        assert rows(result(parsed)) == []


def test_report_tables(sample):
    tables = report(sample, top_n=2)
    assert list(tables) == ["status_counts", "top_ips", "top_requests"]
    assert rows(tables["status_counts"]) == rows(status_counts(sample, by_count=True))
    assert rows(tables["top_ips"]) == [("198.51.100.7", 4), ("198.51.100.9", 2)]
    tables = report(
        sample, sections=("status_counts", "ip_counts", "avg_sizes"), keep_malformed=True
    )
    assert rows(tables["ip_counts"]) == rows(ip_counts(sample, keep_malformed=True))
    assert rows(tables["avg_sizes"]) == rows(avg_size_by_status(sample, keep_malformed=True))
    with pytest.raises(ValueError, match="pie"):
        report(sample, sections=("pie",))


def test_report_in_one_pass_equals_the_separate_tables(sample):
    for keep in (False, True):
        got = rows(report_table(sample, top_n=2, keep_malformed=keep))
        want = [
            (section, key if key is None else str(key), count)
            for section, table in (
                ("ip", top_ips(sample, 2, keep)),
                ("request", top_requests(sample, 2, keep)),
                ("status", status_counts(sample, keep, by_count=True)),
            )
            for key, count in rows(table)
        ]
        assert got == want
    sections = section_counts(sample).groupBy("section").sum("count")
    assert sorted(rows(sections)) == [("ip", 9), ("request", 9), ("status", 9)]


def test_more_statuses_than_the_top_lists_are_long(lines_of):
    texts = [line(ip=f"10.0.0.{n}", status=str(n)) for n in range(100, 130)]
    table = report_table(parse_access_log(lines_of(texts)), top_n=3)
    assert rows(table.groupBy("section").count().orderBy("section")) == [
        ("ip", 3), ("request", 1), ("status", 30),
    ]


def test_slice_report(sample):
    whole = slice_report(sample)
    assert list(whole) == ["volume", "status_share", "top_ips", "top_requests"]
    assert [row["requests"] for row in whole["volume"].collect()] == [9]
    part = slice_report(sample, "2031-03-17 21:40:15", "2031-03-17T21:40:21+00:00", top_n=1)
    assert rows(part["status_share"].select("status", "count")) == [(204, 1), (206, 1), (304, 1)]
    assert rows(part["top_ips"]) == [("198.51.100.7", 1)]


def test_sql_on_the_view(spark, sample):
    register_view(sample, "access_log_test")
    query = "SELECT ip, count(*) AS n FROM access_log_test WHERE ok GROUP BY ip ORDER BY n DESC LIMIT 1"
    assert rows(spark.sql(query)) == [("198.51.100.7", 4)]
