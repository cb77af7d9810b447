"""Log lines with known results."""

# The line pattern, and the names of its groups in order.
PATTERN = r'(\S+) (\S+) (\S+) \[(.*?)\] "(.*?)" (\d{3}) (\S+)'
GROUPS = ("ip", "client", "user", "ts_raw", "request", "status", "size")

STAMP = "[17/Mar/2031:21:40:{:02d} +0000]"

# Eleven lines: nine records, an empty line and a remark.
RECORDS = [
    ("198.51.100.7", 14, "GET /maps/tile?z=3 HTTP/1.1", 206, 900),
    ("198.51.100.9", 15, "PUT /notes/41 HTTP/2", 204, 0),
    ("198.51.100.7", 15, "GET /maps/tile?z=3 HTTP/1.1", 206, 300),
    ("203.0.113.20", 21, "GET /feed.xml HTTP/1.0", 304, 12),
    ("198.51.100.9", 22, "DELETE /notes/40 HTTP/2", 403, 77),
    ("198.51.100.7", 30, "GET /maps/tile?z=3 HTTP/1.1", 206, 1500),
    ("192.0.2.133", 31, "GET /notes/41 HTTP/2", 206, 45),
    ("203.0.113.20", 44, "GET /feed.xml HTTP/1.0", 304, 18),
    ("198.51.100.7", 59, "HEAD /health HTTP/1.1", 503, 5),
]
LINES = [
    f'{ip} - - {STAMP.format(second)} "{request}" {status} {size}'
    for ip, second, request, status, size in RECORDS
] + ["", "# a remark"]


def line(
    ip="1.1.1.1",
    client="-",
    user="-",
    stamp="08/Nov/2025:00:00:01 +0000",
    request="GET / HTTP/1.1",
    status="200",
    size="5",
):
    return f'{ip} {client} {user} [{stamp}] "{request}" {status} {size}'


def rows(frame):
    return [tuple(row) for row in frame.collect()]
