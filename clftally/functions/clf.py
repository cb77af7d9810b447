"""Column expressions for one line of Common Log Format text.

The regex runs once per line and gives the whole record; the fields are then cut out of the record with
plain string functions. This is exact because a record has a fixed frame:

    ip client user [ts_raw] "request" status size

The first three fields and the last two hold no space. ``ts_raw`` ends at the first ``] "`` after its
bracket. Whatever is left between that and the end of the record's frame is the request.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the stamp format, as read after `instant` has brought a stamp into shape.
STAMP_FORMAT = "d/MMM/yyyy:H:m:s Z"

# A record in a form that takes linear time on lines that do not match: words and the stamp are never given back
# once matched. A shorter word or a later end of the stamp cannot help, since the word is followed by a space and
# the request may hold whatever the stamp could have held.
_FRAME = r"\S++ \S++ \S++ \["
_RECORD = _FRAME + r'(?>.*?\] ").*?" \d{3} \S++'
_AT_START = "^" + _RECORD
# A record found inside a line starts with a word, never in the middle of one. If the first three words and bracket
# of a stretch without line ends begin no record, then no later bracket of that stretch does, as it has less of the
# stretch before it. The second choice takes such a stretch in one step, but for its last words: these may go with a
# bracket in the next stretch, as a word may hold line ends of the rarer kinds. Without it every bracket would search
# the whole stretch again.
_IN_STRETCH = r"[^\s\x{85}\x{2028}\x{2029}]++ "
_ANYWHERE = rf"(?<!\S)(?:({_RECORD})|(?={_FRAME})(?:.* (?={_IN_STRETCH}{_IN_STRETCH}\S)|\S++))"

# The usual stamps, which are read as they are.
_USUAL_STAMP = r"^\d{1,2}/\p{Alpha}{3}/\d{4}:\d\d:\d\d:\d\d [+-](?:0\d|1[0-7])[0-5]\d$"
# All stamps that can be read: a clock whose parts have one digit or two, and no offset, a `Z`, or hours, minutes and
# perhaps seconds, with or without colons. The groups are the clock, and the sign and parts of the offset.
_STAMP = (
    r"^((?: ?\d|\d\d)/\p{Alpha}{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2})"
    r"(?:\s+(?:Z|([+-])([01]\d|2[0-3]):?([0-5]\d)(?::?([0-5]\d))?))?$"
)

_STAMP_END = '] "'
# Length of the text around the size at the end of a record: `" `, three digits, a space.
_STATUS_FRAME = len('" 200 ')


def matches_line(value: Column, anchored: bool = True) -> Column:
    """Whether the text holds a log record, at its start or anywhere in it; never NULL."""
    if anchored:
        return F.coalesce(value.rlike(_AT_START), F.lit(False))
    return record_of(value, anchored=False) != ""


def record_of(value: Column, anchored: bool = True) -> Column:
    """The log record in a line, without what comes before or after it; empty when there is none."""
    if anchored:
        return F.coalesce(F.regexp_extract(value, _AT_START, 0), F.lit(""))
    found = F.regexp_extract_all(value, F.lit(_ANYWHERE), F.lit(1))
    return F.coalesce(F.get(F.array_remove(found, ""), F.lit(0)), F.lit(""))


def record_fields(record: Column) -> dict[str, Column]:
    """The text of every field of a record, by name; all empty for an empty record."""

    def word(n: int) -> Column:
        return F.substring_index(F.substring_index(record, " ", n), " ", -1)

    size = F.substring_index(record, " ", -1)
    # The record from behind the opening bracket on.
    rest = F.substring(record, F.length(F.substring_index(record, " ", 3)) + 3, F.length(record))
    ts_raw = F.substring_index(rest, _STAMP_END, 1)
    behind_stamp = F.length(ts_raw) + len(_STAMP_END)
    request_length = F.length(rest) - behind_stamp - _STATUS_FRAME - F.length(size)
    return {
        "ip": F.substring_index(record, " ", 1),
        "client": word(2),
        "user": word(3),
        "ts_raw": ts_raw,
        "request": F.substring(rest, behind_stamp + 1, request_length),
        "status": F.substring_index(F.substring_index(record, " ", -2), " ", 1),
        "size": size,
    }


def status_code(text: Column) -> Column:
    """Status as int, NULL when it is not a number."""
    return text.try_cast("int")


def size_in_bytes(text: Column) -> Column:
    """Response size: ``-`` is 0, plain digits are the number, anything else is NULL."""
    return F.when(text == "-", F.lit(0).cast("bigint")).when(
        text.rlike(r"^[0-9]+$"), text.try_cast("bigint")
    )


def instant(stamp: Column) -> Column:
    """Log stamp to timestamp; NULL when it cannot be read.

    A stamp without an offset is taken as UTC. A usual stamp is parsed as it is; of any other its clock is, and the
    offset is taken off. A failing parse is slow, so stamps of another shape are not tried.
    """
    usual = stamp.rlike(_USUAL_STAMP)
    # The clock, and the offset as a sign and up to six digits.
    shape = F.regexp_replace(stamp, _STAMP, r"$1|$2$3$4$5")
    clock = F.concat(F.ltrim(F.substring_index(shape, "|", 1)), F.lit(" +0000"))
    shift = F.substring_index(shape, "|", -1)
    number = lambda at: F.coalesce(F.substring(shift, at, 2).try_cast("int"), F.lit(0))
    seconds = number(2) * 3600 + number(4) * 60 + number(6)
    offset = F.when(usual, 0).when(shift.startswith("-"), -seconds).otherwise(seconds)
    read = F.try_to_timestamp(F.when(usual, stamp).when(stamp.rlike(_STAMP), clock), F.lit(STAMP_FORMAT))
    return F.timestamp_add("SECOND", -offset, read)
