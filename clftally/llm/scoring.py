"""Language-model scores of documents.

Words are counted over the whole training part of the corpus. The most frequent ones are symbols of their own, all
others share one symbol, and a log-bilinear model predicts each symbol from the two before it: the context vectors,
each turned by a matrix of its place, add up to a predicted vector, and a symbol's score is that vector times its
own, plus a bias. It is trained by noise-contrastive estimation on the counts of all symbol triples of the training
part. Scores are then normalised over all symbols, for all contexts at once by one matrix product.

The words that share a symbol are told apart by two more models of the same kind, over classes that every word has by
its bytes: one predicts the class of a word's beginning from the beginnings of the two words before, the other the
class of its ending from that beginning and the ending before. A word's probability is that of the shared symbol, of
its beginning and of its ending, times its own add-one share among the words of both classes. So the probabilities of
all words, with one unknown word in each pair of classes, sum to one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clftally.llm import common

SYMBOLS = 128
DIMENSIONS = 24
NOISE = 12
BATCH = 2048
STEPS = 800
RATE = 0.02
SEED = 7

# Bytes of text that are looked up against the word counts at a time. Sets the number of groups, no result.
CHUNK_BYTES = 12_000_000
# Distinct words a worker counts before it hands them on.
FLUSH = 300_000

# The end of a text as a word; no word holds a line feed. Other words share the first symbol.
END = b"\n"
_OTHER, _END = 0, 1
# Symbols in each of the three tables of triples.
_TABLE = SYMBOLS**3

# Fixed value: bytes at either end of a word that its classes depend on.
_PART = 2

_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass
class Classes:
    """log10 probabilities of beginnings and endings by triple code, and log10 of the shares by both classes."""

    beginnings: np.ndarray
    endings: np.ndarray
    shares: np.ndarray


@dataclass
class Model:
    """Word counts of symbols, totals, and log10 probability of each symbol after each two.

    Without classes all words that share a symbol have one share in common.
    """

    symbols: dict[bytes, int]
    counts: dict[bytes, int]
    tokens: int
    kinds: int
    other_tokens: int
    other_kinds: int
    table: np.ndarray
    classes: Classes | None = None


def class_of(part: bytes) -> int:
    """The class of a beginning or an ending: any symbol but that of the end."""
    found = zlib.crc32(part) % (SYMBOLS - 1)
    return found + (found >= _END)


_classes: np.ndarray | None = None


def _class_of_parts() -> np.ndarray:
    """`class_of` each first byte (row) alone (column 0) and with each second one."""
    global _classes
    if _classes is None:
        parts = ((bytes((a, b - 1)) if b else bytes((a,))) for a in range(256) for b in range(257))
        _classes = np.array([class_of(part) for part in parts], np.int64).reshape(256, 257)
    return _classes


def word_classes(lowered: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the beginnings and of the endings of a text's words; the end has its own symbol in both."""
    codes = np.frombuffer(lowered + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[codes]))))
    starts, last = edges[::2], edges[1::2] - 1
    single, classes = starts == last, _class_of_parts()
    behind = lambda at: np.where(single, 0, codes[at].astype(np.int64) + 1)
    beginnings = classes[codes[starts], behind(starts + 1)]
    endings = classes[codes[np.where(single, last, last - 1)], behind(last)]
    return np.append(beginnings, _END), np.append(endings, _END)


def lowered_bytes(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; white space is the six ASCII characters."""
    return lowered_bytes(text).split()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(common.crc_of_id(doc_id), F.lit(7)) == 2


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each word stands in all texts, and how many texts end: ``(word, n)``, words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(words_of(t.as_py()))
                counts[END] += 1
                if len(counts) >= FLUSH:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return common.for_python(docs.select(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"]
    )


def train(training: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    """The model of the training documents, of which ``counts`` are the `word_counts`.

    The driver holds the most frequent words, the counts of triples and the totals by pair of classes, all bounded by
    `SYMBOLS`.
    """
    tokens, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(SYMBOLS - 2).collect()
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    frequent = {bytes(r.word): r.n for r in top}
    symbols = {END: _END} | {word: i for i, word in enumerate(frequent, 2)}
    known = frequent | ({END: ends.n} if ends else {})
    table, beginnings, endings = _triple_counts(training, symbols, text)
    return Model(
        symbols,
        known,
        tokens or 0,
        kinds or 0,
        (tokens or 0) - sum(known.values()),
        (kinds or 0) - len(known),
        log_table(*fit(*table)),
        Classes(_class_table(*beginnings), _class_table(*endings), _shares(counts, known)),
    )


def _class_table(codes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """log10 probability of classes by triple code; no word has the class of an end."""
    *vectors, bias = fit(codes, number)
    bias[_END] = -np.inf
    return log_table(*vectors, bias)


def _shares(counts: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """log10 of one in how many each pair of classes is shared: its tokens and words without those ``known``, and one."""
    totals = counts.groupBy(
        _class_column(F.substring("word", 1, _PART)).alias("beginning"),
        _class_column(F.substring("word", -_PART, _PART)).alias("ending"),
    ).agg((F.sum("n") + F.count("*")).alias("total"))
    shared = np.ones(SYMBOLS**2, np.int64)
    for row in totals.collect():
        shared[row.beginning * SYMBOLS + row.ending] += row.total
    for word, n in known.items():
        shared[class_of(word[:_PART]) * SYMBOLS + class_of(word[-_PART:])] -= n + 1
    return -np.log10(shared)


def _class_column(part: Column) -> Column:
    """`class_of` as a column."""
    found = F.pmod(F.crc32(part), F.lit(SYMBOLS - 1))
    return found + (found >= _END).cast("int")


def _triple_counts(docs: DataFrame, symbols: dict[bytes, int], text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes of the triples that occur, in order, and how often: of symbols, of beginnings, of endings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(3 * _TABLE, np.int64)
        for batch in batches:
            for t in batch.column(0):
                lowered = lowered_bytes(t.as_py())
                ids = symbol_ids(lowered.split(), symbols)
                for place, codes in enumerate(all_triples(ids, *word_classes(lowered))):
                    np.add.at(found, codes + place * _TABLE, 1)
        kept = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(found[kept])], ["code", "n"])

    table = (
        common.for_python(docs.select(text)).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    )
    codes, number = table["code"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(codes)
    codes, number = codes[order], number[order]
    cuts = np.searchsorted(codes, [_TABLE, 2 * _TABLE])
    return [(c % _TABLE, n) for c, n in zip(np.split(codes, cuts), np.split(number, cuts))]


def symbol_ids(words: list[bytes], symbols: dict[bytes, int]) -> np.ndarray:
    """Symbols of a text's words and its end."""
    get = symbols.get
    return np.array([*[get(w, _OTHER) for w in words], _END], np.int64)


def all_triples(ids: np.ndarray, beginnings: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triple codes of all symbols, and those of the beginnings and endings of words that share a symbol."""
    other = ids == _OTHER
    before = np.concatenate(([_END], endings[:-1]))
    return (
        triple_codes(ids),
        triple_codes(beginnings)[other],
        ((before * SYMBOLS + beginnings) * SYMBOLS + endings)[other],
    )


def triple_codes(ids: np.ndarray) -> np.ndarray:
    """Each symbol with the two before it as one number; ends stand before the first."""
    padded = np.concatenate(([_END, _END], ids))
    return (padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:]


def fit(codes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parameters of the log-bilinear model, by noise-contrastive estimation with Adam.

    Triples are drawn by their counts. Noise symbols are drawn by their frequencies in the same counts.
    """
    rng = np.random.default_rng(SEED)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    context, target = small(SYMBOLS, DIMENSIONS), small(SYMBOLS, DIMENSIONS)
    turns = np.stack([np.eye(DIMENSIONS, dtype=np.float32) * 0.5 + small(DIMENSIONS, DIMENSIONS) for _ in range(2)])
    frequency = np.bincount(codes % SYMBOLS, weights=number, minlength=SYMBOLS) + 1.0
    noise = frequency / frequency.sum()
    bias = np.log(noise).astype(np.float32)
    parameters = [context, target, turns, bias]
    if not len(codes):
        return tuple(parameters)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    drawn, drawn_noise = np.cumsum(number) / number.sum(), np.cumsum(noise)
    log_noise = (np.log(noise) + np.log(NOISE)).astype(np.float32)
    rows = np.arange(BATCH)[:, None]
    for step in range(1, STEPS + 1):
        picked = codes[np.minimum(np.searchsorted(drawn, rng.random(BATCH)), len(codes) - 1)]
        first, second, true = picked // SYMBOLS**2, picked // SYMBOLS % SYMBOLS, picked % SYMBOLS
        false = np.minimum(np.searchsorted(drawn_noise, rng.random((BATCH, NOISE))), SYMBOLS - 1)
        shown = np.concatenate((true[:, None], false), axis=1)
        predicted = context[first] @ turns[0] + context[second] @ turns[1]
        scores = (predicted @ target.T + bias)[rows, shown] - log_noise[shown]
        errors = 1 / (1 + np.exp(-scores))
        errors[:, 0] -= 1
        # The errors of a batch by row and symbol; a symbol may be drawn more than once in a row.
        dense = np.bincount((rows * SYMBOLS + shown).ravel(), errors.ravel(), BATCH * SYMBOLS)
        dense = (dense.reshape(BATCH, SYMBOLS) / BATCH).astype(np.float32)
        back = dense @ target
        gradient_context = np.zeros_like(context)
        for place, at in enumerate((first, second)):
            hot = np.zeros((BATCH, SYMBOLS), np.float32)
            hot[np.arange(BATCH), at] = 1
            gradient_context += hot.T @ (back @ turns[place].T)
        gradients = [
            gradient_context,
            dense.T @ predicted,
            np.stack([context[at].T @ back for at in (first, second)]),
            dense.sum(axis=0),
        ]
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, (mean, square) in zip(parameters, gradients, moments):
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return tuple(parameters)


def log_table(context: np.ndarray, target: np.ndarray, turns: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log10 probability by triple code: one product for all contexts, normalised over the symbols."""
    predicted = (context @ turns[0])[:, None, :] + (context @ turns[1])[None, :, :]
    scores = predicted.reshape(-1, DIMENSIONS) @ target.T + bias
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return (scores / np.log(10)).astype(np.float32).ravel()


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every document: its id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Texts are dealt into groups of about `CHUNK_BYTES` by a hash of id and text. The distinct words of each group
    meet the counts in a join by word, where the few frequent words, which the model holds, take no part. So a word
    is looked up once per group, no group or word gathers more than its share, and the counts are never held whole.
    A NULL text counts as empty: one token, its end.
    """
    size = common.for_python(docs).agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = 1 + size // CHUNK_BYTES
    dealt = docs.select(
        F.col(doc_id),
        F.col(text).alias("_text"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(groups)).alias("_chunk"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vocabulary(rows: pa.Table) -> pa.Table:
        known, found = shared.value.counts, set()
        for t in rows["_text"]:
            found.update(words_of(t.as_py()))
        words = pa.array(found.difference(known), pa.binary())
        chunk = pa.repeat(rows["_chunk"][0], len(words))
        return pa.table({"_chunk": chunk, "word": words})

    def scores(rows: pa.Table, looked_up: pa.Table) -> pa.Table:
        model = shared.value
        known = dict(zip(looked_up["word"].to_pylist(), looked_up["n"].to_pylist()))
        known.update(model.counts)
        found = [score_text(model, known, t.as_py()) for t in rows["_text"]]
        columns = zip(*found) if found else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        values = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        return pa.table([rows[doc_id], *values], names=[doc_id, "n_tokens", "n_known", "base_score", "score"])

    words = dealt.groupBy("_chunk").applyInArrow(vocabulary, "_chunk long, word binary")
    looked_up = words.join(counts, "word").select("_chunk", "word", "n")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("_chunk").cogroup(looked_up.groupBy("_chunk")).applyInArrow(scores, schema)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def score_text(model: Model, known: dict[bytes, int], text: str | None) -> tuple[int, int, float, float]:
    """Tokens, known tokens, base score and model score of one text, with the counts of its words."""
    lowered = lowered_bytes(text)
    words = lowered.split()
    get = known.get
    seen = np.array([*[get(w, 0) for w in words], get(END, 0)], np.float64)
    logs = np.log10(seen + 1)
    base = logs.sum() - len(seen) * np.log10(model.tokens + model.kinds + 1)
    ids, (beginnings, endings) = symbol_ids(words, model.symbols), word_classes(lowered)
    triples, first, second = all_triples(ids, beginnings, endings)
    other = ids == _OTHER
    total = model.table[triples].sum(dtype=np.float64) + logs[other].sum()
    if model.classes is None:
        total -= other.sum() * np.log10(model.other_tokens + model.other_kinds + 1)
    else:
        total += model.classes.beginnings[first].sum(dtype=np.float64) + model.classes.endings[second].sum(dtype=np.float64)
        total += model.classes.shares[(beginnings * SYMBOLS + endings)[other]].sum()
    return len(seen), int((seen > 0).sum()), float(base), float(total)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents that are not held out, and score all; adds ``held_out``."""
    training = docs.filter(~held_out(doc_id))
    counts = common.checkpointed(word_counts(training, text))
    model = train(training, counts, text)
    return score(docs, model, counts, doc_id, text).withColumn("held_out", held_out(doc_id))
