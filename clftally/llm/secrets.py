"""Secrets in text: fixed patterns, and literals that are assigned to names which tell of a secret.

The second part reads assignments of source and configuration syntax into pairs of a name and what it gets:
literals, and references to other names. Constants are followed through references, forwards and backwards, so
``x = "..."`` counts when ``password = x`` stands anywhere in the text. A literal is scored by its own shape and by
the most telling name that it reaches.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.llm import common

# The base patterns, in the order of their kinds, and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "value")

# How much a name tells, by its words or neighbouring words.
NAME_WEIGHTS = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "mnemonic": 1.0,
    "seed words": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "credential": 0.9,
    "credentials": 0.9,
    "apikey": 1.0,
    "api key": 1.0,
    "access key": 1.0,
    "private key": 1.0,
    "secret key": 1.0,
    "signing key": 1.0,
    "encryption key": 1.0,
    "auth key": 0.9,
    "bearer": 0.8,
    "auth": 0.6,
    "key": 0.5,
    "salt": 0.5,
}
# Texts that stand where a secret would.
PLACEHOLDERS = ("changeme", "change_me", "example", "placeholder", "your", "xxxx", "****", "todo", "dummy", "redacted")
MIN_VALUE_CHARS = 6
# Bits of a literal, by the frequencies of its characters, that count in full, under a name of half the weight.
FULL_BITS = 60
MIN_PHRASE_WORDS = 3
MIN_SCORE = 0.45

_OPERATOR = re.compile(r"(?<![=!<>:])(?::=|=>|\+=|=(?![=~])|:(?!:))")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BLANK = re.compile(r"[ \t]*")
_QUOTED = re.compile(
    r"""[rRbBuUfF]{0,2}(?:\"\"\"(?P<a>[\s\S]*?)\"\"\"|'''(?P<b>[\s\S]*?)'''"""
    r"""|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`\n]*)`)"""
)
_REFERENCE = re.compile(r"\$\{\s*([A-Za-z_][\w.\-]*)\s*\}|\{\{\s*([A-Za-z_][\w.\-]*)\s*\}\}|\$([A-Za-z_]\w*)", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-][\w$]+)*", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;=:(){}\[\]<>]+={0,2}""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.(?=[ \t]*[\"'$]))\s*|[ \t]+(?=[\"'])")
_PHRASE_NAME = re.compile(r"phrase|mnemonic|seed[_\-. ]?words", re.IGNORECASE)
_PHRASE_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
_PATH_START = re.compile(r"~?/|\.{1,2}/")
# Words of one case with a short number at most, between marks.
_PLAIN = re.compile(r"[._\-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[0-9]{0,3}(?:[._\-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[0-9]{0,3})*")
_DOTTED = re.compile(r"[._]")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")

Span = tuple[str, int, int, float]


def base_spans(text: str) -> list[Span]:
    """The matches of the fixed patterns, by kind; positions are code points, ends exclusive.

    Matches too short are dropped after matching, as what they cover cannot start another match of their kind. For
    the two kinds whose matches end where their characters do, asking for the length at once gives the same.
    """
    spans = [
        ("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS
    ]
    spans += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text) if len(m.group()) >= ACCESS_CHARS]
    spans += [("hex", m.start(), m.end(), 1.0) for m in _LONG_HEX.finditer(text)]
    return spans


class Assignments:
    """Names of a text with the literals and the other names that they get."""

    def __init__(self, text: str):
        self.text = text
        self.literals: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.sources: dict[str, set[str]] = defaultdict(set)
        for operator in _OPERATOR.finditer(text):
            names = self._names_before(operator.start())
            if names:
                self._read_value(names, operator.end())

    def reaching(self, names: Iterable[str]) -> dict[tuple[int, int], str]:
        """Each literal that ends up in one of the names, with the first of these.

        A name is looked at once, from the first that leads to it, so this takes time in step with the text.
        """
        found, seen = {}, set()
        for target in names:
            stack = [target]
            while stack:
                name = stack.pop()
                if name in seen:
                    continue
                seen.add(name)
                for span in self.literals.get(name, ()):
                    found.setdefault(span, target)
                stack.extend(self.sources.get(name, ()))
        return found

    def _names_before(self, end: int) -> list[str]:
        """The name in front of an operator, and the one in front of its annotation."""
        names, text = [], self.text
        while len(names) < 2:
            at = end
            while at and text[at - 1] in " \t":
                at -= 1
            if at and text[at - 1] == "]":
                at -= 1
            if at and text[at - 1] in "\"'`":
                at -= 1
            start = at
            while start and text[start - 1] in _NAME_CHARS:
                start -= 1
            name = text[start:at].lstrip(".-0123456789")
            if not name:
                break
            names.append(name)
            while start and text[start - 1] in " \t":
                start -= 1
            if not start or text[start - 1] != ":":
                break
            end = start - 1
        return names

    def _read_value(self, names: list[str], at: int) -> None:
        text = self.text
        at = _BLANK.match(text, at).end()
        while True:
            if quoted := _QUOTED.match(text, at):
                group = quoted.lastgroup
                self._add(names, quoted.start(group), quoted.end(group))
                at = quoted.end()
            elif reference := _REFERENCE.match(text, at):
                self._refer(names, next(g for g in reference.groups() if g))
                at = reference.end()
            elif bare := _BARE.match(text, at):
                name = _NAME.fullmatch(bare.group())
                at = bare.end()
                if name:
                    self._refer(names, name.group())
                if text[at : at + 1] in ("(", "["):
                    return
                self._add(names, bare.start(), at)
            else:
                return
            join = _JOIN.match(text, at)
            if not join:
                return
            at = join.end()

    def _add(self, names: list[str], start: int, end: int) -> None:
        for reference in _REFERENCE.finditer(self.text, start, end):
            self._refer(names, next(g for g in reference.groups() if g))
        for name in names:
            self.literals[name].append((start, end))

    def _refer(self, names: list[str], other: str) -> None:
        for name in names:
            if name != other:
                self.sources[name].add(other)


def name_weight(name: str) -> float:
    """How much a name tells of a secret, from 0 to 1; a name that ends in such a word tells most."""
    words = [w.lower() for w in _WORD.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    best = max((NAME_WEIGHTS.get(w, 0.0) for w in words + pairs), default=0.0)
    last = max((NAME_WEIGHTS.get(w, 0.0) for w in words[-1:] + pairs[-1:]), default=0.0)
    return max(last, 0.5 * best)


def value_quality(value: str, weight: float = 0.5, phrase: bool = False, quoted: bool = True) -> float:
    """How much a literal looks like a secret, from 0 to 1.

    Under names that tell much (``weight``) fewer bits are asked of literals with letters and digits, but not of those
    without quotes that read as a name. Blanks are for literals of names that ask for a ``phrase`` of words.
    """
    lowered = value.lower()
    if len(value) < MIN_VALUE_CHARS or any(p in lowered for p in PLACEHOLDERS):
        return 0.0
    if any(c.isspace() for c in value) and not (phrase and _is_phrase(value)):
        return 0.0
    if _REFERENCE.search(value) or lowered.startswith(("http:", "https:", "<")) or _is_path(value):
        return 0.0
    counts, length = Counter(value), len(value)
    bits = sum(n * math.log2(length / n) for n in counts.values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    asked = FULL_BITS * (1.5 - weight) if mixed and (quoted or not _DOTTED.search(value)) else FULL_BITS
    # A lone word without digits or marks is rather a word than a secret.
    return min(1.0, bits / min(asked, FULL_BITS)) * (0.5 if value.isalpha() else 1.0)


def _is_phrase(value: str) -> bool:
    """Some words between single blanks, none of which tells of a secret, as in a prompt."""
    words = value.split(" ")
    return len(words) >= MIN_PHRASE_WORDS and all(_PHRASE_WORD.fullmatch(w) and not name_weight(w) for w in words)


def _is_path(value: str) -> bool:
    """Starts like a path, and plain words make up half of it or more."""
    if not _PATH_START.match(value):
        return False
    segments = [segment for segment in value.split("/") if segment]
    plain = sum(len(segment) for segment in segments if _PLAIN.fullmatch(segment))
    return 2 * plain >= sum(map(len, segments))


def find(text: str) -> list[Span]:
    """All spans of a text in order of start and kind. Literals that a base span overlaps are not added again."""
    spans = base_spans(text)
    if "=" in text or ":" in text:
        taken = sorted((start, end) for _, start, end, _ in spans)
        assignments = Assignments(text)
        weights = {name: name_weight(name) for name in {*assignments.literals, *assignments.sources}}
        telling = sorted((name for name, weight in weights.items() if weight), key=lambda n: (-weights[n], n))
        phrases = assignments.reaching(name for name in telling if _PHRASE_NAME.search(name))
        added = []
        for span, name in assignments.reaching(telling).items():
            quoted = text[span[0] - 1 : span[0]] in ("'", '"', "`")
            if not quoted and text[slice(*span)] in weights:
                continue  # a name, which has been followed
            score = weights[name] * value_quality(text[slice(*span)], weights[name], span in phrases, quoted)
            if score >= MIN_SCORE:
                added.append(("value", *span, round(score, 3)))
        spans += _apart(sorted(added, key=lambda s: s[1]), taken)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _apart(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap none of the taken ones; both sorted by start."""
    free, i, reach = [], 0, 0
    for span in spans:
        while i < len(taken) and taken[i][0] < span[2]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= span[1]:
            free.append(span)
    return free


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add the spans of every text as an array; the text is dropped and the other columns stay.

    A NULL text counts as empty. A column named like ``into`` is replaced. Nothing is shuffled.
    """
    schema = common.schema_with(docs, [text], [T.StructField(into, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "score"), s)) for s in find(t.as_py() or "")]
                for t in batch.column(text)
            ]
            columns = [pa.array(spans, _ARROW_SPANS) if f == into else batch.column(f) for f in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return common.for_python(docs).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
