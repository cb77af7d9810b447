"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can be the last one of the prefix's
encoding. `PrefixTable` stores that token per prefix. The encoding of the whole is read off backwards, bytes can
be appended at the cost of the new bytes only, and cutting back to a prefix is free, so a change near the end of
a text touches what lies behind it and nothing else.

Which token is the last one follows from two facts. A prefix of an encoding is the encoding of that prefix. And
two tokens may stand side by side exactly if no merge across their border would come before the merges that
built them, which the merge histories of the two tokens tell.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clftally.llm import common

_NEVER = 1 << 60
# Entries kept in each memo of a worker before it is emptied.
_MEMO = 150_000
# A match can depend on characters up to this far behind its end.
_LOOKAHEAD = 2


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 text and rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """A ranked vocabulary with what is derived from it, all of it on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._lengths = {rank: len(token) for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._longest = max(map(len, ranks))
        # Every beginning of a token; those seen as endings of a text are numbered, and the steps between them kept.
        self._prefixes: set[bytes] = set()
        self._states: list[bytes] = [b""]
        self._numbers: dict[bytes, int] = {b"": 0}
        self._steps: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._packed = _PackedPieces(self)

    # Pieces

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.last_tokens(piece, last)
        return self.read_back(last)

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding of a prefix from the last tokens of all its prefixes."""
        found, at, lengths = [], len(last), self._lengths
        while at:
            rank = last[at - 1]
            found.append(rank)
            at -= lengths[rank]
        found.reverse()
        return found

    def last_tokens(self, data: bytes, last: list[int]) -> None:
        """Extend ``last``, the last token of each prefix of ``data``, to all of its prefixes."""
        if not self._prefixes:
            self._prefixes.update(token[:n] for token in self.ranks for n in range(1, len(token) + 1))
        fits, pairs, steps = self.fits, self._pairs, self._steps
        at = len(last)
        state = self._state_of(data[:at]) if at else 0
        for byte in data[at:]:
            at += 1
            known = steps.get(state << 8 | byte)
            if known is None:
                known = self._step(state, byte)
            state, endings = known
            for rank, length in endings:
                if length == at:
                    break
                before = last[at - length - 1]
                fit = pairs.get(before << 32 | rank)
                if fit is None:
                    fit = fits(before, rank)
                if fit:
                    break
            else:
                raise ValueError("the vocabulary has tokens that its own merges do not build")
            last.append(rank)

    def _state_of(self, data: bytes) -> int:
        """The longest ending of some bytes that a token starts with, by number."""
        start = max(0, len(data) - self._longest)
        while data[start:] and data[start:] not in self._prefixes:
            start += 1
        return self._number(data[start:])

    def _step(self, state: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        """The state behind one more byte, and the tokens that end there, longest first, with their lengths."""
        ending = self._states[state] + bytes([byte])
        while ending not in self._prefixes:
            ending = ending[1:]
        tails = (ending[start:] for start in range(len(ending)))
        found = [(self.ranks[t], len(t)) for t in tails if t in self.ranks]
        if len(self._steps) >= 4 * _MEMO:
            self._steps.clear()
        step = self._steps[state << 8 | byte] = (self._number(ending), found)
        return step

    def _number(self, ending: bytes) -> int:
        number = self._numbers.setdefault(ending, len(self._states))
        if number == len(self._states):
            self._states.append(ending)
        return number

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours in an encoding."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= _MEMO:
                self._pairs.clear()
            known = self._pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Replays the merges on both sides of the border in order of rank.

        Of two merges of one rank the one further left comes first.
        """
        before, after = self._spine(left, last=True), self._spine(right, last=False)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = before[i], after[j]
            across = self.ranks.get(a + b, _NEVER)
            if across < a_until and across <= b_until and across != _NEVER:
                return False
            if a_until == b_until == _NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _spine(self, token: int, last: bool) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token while it is built, and the rank of the merge that ends it."""
        key = (token, last)
        spine = self._spines.get(key)
        if spine is None:
            edge, until, spine = self.bytes_of[token], _NEVER, []
            while len(edge) > 1:
                spine.append((edge, until))
                until = self.ranks[edge]
                edge = self._halves(edge)[last]
            spine.append((edge, until))
            spine.reverse()
            self._spines[key] = spine
        return spine

    def _halves(self, token: bytes) -> list[bytes]:
        """The two parts whose merge makes a token: its encoding by the merges that come before it."""
        limit = self.ranks[token]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= limit:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            raise ValueError("the vocabulary has tokens that its own merges do not build")
        return parts

    # Texts

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> bytes:
        """Token ids as packed little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


class _PackedPieces(dict):
    """Packed ids by piece, filled as pieces are asked for.

    Holds two generations: when the newer is full it becomes the older one, so pieces in use stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary, self._older = vocabulary, {}
        self._packed_id = {rank: rank.to_bytes(4, "little") for rank in vocabulary.bytes_of}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _MEMO:
            self._older = dict(self)
            self.clear()
        packed = self._older.get(piece)
        if packed is None:
            ids = self._vocabulary.encode_piece(piece.encode())
            packed = b"".join([self._packed_id[i] for i in ids])
        self[piece] = packed
        return packed


class PrefixTable:
    """The last token of each prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self._vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.data += more
        self._vocabulary.last_tokens(self.data, self.last)

    def cut(self, length: int) -> None:
        """Keep the first ``length`` bytes."""
        self.data = self.data[:length]
        del self.last[length:]

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of the bytes from ``start`` to ``end``; what is before them stays."""
        behind = self.data[end:]
        self.cut(start)
        self.append(new + behind)

    def tokens(self) -> list[int]:
        return self._vocabulary.read_back(self.last)


class EncodedText:
    """A text with the ids of each of its pieces, for edits that leave most of them alone."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self._vocabulary, self.text = vocabulary, text
        self.pieces = vocabulary.split(text)
        self.ids = [vocabulary.encode_piece(p.encode()) for p in self.pieces]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of the characters from ``start`` to ``end``; returns how many pieces were encoded.

        Pieces that end well before the edit stay. Behind it, splitting stops as soon as it meets a border of the
        old pieces, since how a text goes on does not depend on what came before a border.
        """
        old_ends, at = [], 0
        for piece in self.pieces:
            at += len(piece)
            old_ends.append(at)
        kept = 0
        while kept < len(old_ends) and old_ends[kept] + _LOOKAHEAD <= start:
            kept += 1
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        old_starts = {e + shift: i + 1 for i, e in enumerate(old_ends) if e >= end}
        begin = old_ends[kept - 1] if kept else 0
        fresh, rest = [], len(self.pieces)
        for match in self._vocabulary.pattern.finditer(self.text, begin):
            if match.start() >= start + len(new) and match.start() in old_starts:
                rest = old_starts[match.start()]
                break
            fresh.append(match.group())
        ids = [self._vocabulary.encode_piece(p.encode()) for p in fresh]
        self.pieces[kept:rest] = fresh
        self.ids[kept:rest] = ids
        return len(fresh)

    def tokens(self) -> list[int]:
        return [i for ids in self.ids for i in ids]


def encode(
    docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", into: str = "ids"
) -> DataFrame:
    """Encode a text column; a NULL text counts as empty, which has no tokens.

    Adds ``into``, the ids as packed little-endian unsigned 32-bit integers, and drops the text; all other columns
    stay, but for one named like ``into``, which is replaced. Rows keep their place: nothing is shuffled. The
    vocabulary is sent to the workers once; its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))
    schema = common.schema_with(docs, [text], [T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _worker_vocabulary(shared.value)
        for part in (part for batch in batches for part in common.slices(batch, text)):
            packed = [vocabulary.encode(t.as_py() or "") for t in part.column(text)]
            yield _with_column(part, schema, into, packed)

    return common.for_python(docs).mapInArrow(run, schema)


def decode(
    docs: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", into: str = "decoded"
) -> DataFrame:
    """The bytes that packed ids stand for, in column ``into``; NULL ids count as none. Other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))
    schema = common.schema_with(docs, [], [T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _worker_vocabulary(shared.value)
        for part in (part for batch in batches for part in common.slices(batch, ids)):
            texts = [vocabulary.decode(i.as_py() or b"") for i in part.column(ids)]
            yield _with_column(part, schema, into, texts)

    return common.for_python(docs).mapInArrow(run, schema)


def round_trip(
    docs: DataFrame,
    rank_file: bytes,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    release: bool = False,
) -> DataFrame:
    """`encode` and then `decode` of what it gave, in one pass through the workers; the text is dropped.

    ``release`` makes each task give its vocabulary and memos back at its end, for jobs whose other stages need the
    memory of the same workers. It costs each task the making of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))
    fields = [T.StructField(name, T.BinaryType()) for name in (ids, decoded)]
    schema = common.schema_with(docs, [text], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _worker_vocabulary(shared.value)
        for part in (part for batch in batches for part in common.slices(batch, text)):
            packed = [vocabulary.encode(t.as_py() or "") for t in part.column(text)]
            new = {ids: packed, decoded: list(map(vocabulary.decode, packed))}
            columns = [
                pa.array(new[name], pa.binary()) if name in new else part.column(name) for name in schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        if release:
            # A vocabulary and its memo hold each other.
            del vocabulary
            _loaded.clear()
            gc.collect()

    return common.for_python(docs).mapInArrow(run, schema)


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _worker_vocabulary(shared: tuple[bytes, str]) -> Vocabulary:
    """The vocabulary, built once per Python worker."""
    key = (hash(shared[0]), shared[1])
    if key not in _loaded:
        _loaded[key] = Vocabulary(parse_ranks(shared[0]), shared[1])
    return _loaded[key]


def _with_column(
    batch: pa.RecordBatch, schema: T.StructType, name: str, values: list[bytes]
) -> pa.RecordBatch:
    columns = [
        pa.array(values, pa.binary()) if field == name else batch.column(field) for field in schema.names
    ]
    return pa.RecordBatch.from_arrays(columns, schema.names)
