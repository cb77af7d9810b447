"""Language identification by character language models.

One interpolated Kneser-Ney model per language, over code points in lower case with runs of anything that is no
letter as one blank. A text gets the language whose model gives it the lowest cross-entropy per character.

The models are kept together: for each order one sorted array of 64-bit n-gram hashes, with one row of log
probabilities and one of back-off weights per n-gram and a column per language, so a text is scored for all
languages by one binary search per character and order that is needed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clftally.llm import common

ORDER = 4
# The models are fitted on so many different blocks of text of each language at most, those of the least hashes. A
# block is a whole text, or a part of so many characters of a longer one.
SAMPLE = 400
SAMPLE_CHARS = 1 << 17
# Blocks whose n-grams are counted together.
COUNTED_BLOCKS = 25
# Every so many-th block sets the rejection limits instead; a language with fewer blocks keeps the usual limits.
CALIBRATION = 5
# Languages and the hashes of chosen blocks are broadcast up to this many rows, and meet by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
# A text is rejected if its cross-entropy lies so many deviations above the usual one of its language.
REJECT_DEVIATIONS = 6.0
# Texts of fewer characters than this are too noisy to be rejected.
REJECT_CHARS = 200
# Characters to which the differences of cross-entropy are scaled for the score.
SCORE_CHARS = 50
# Characters that are scored at a time.
BLOCK = 1 << 18

UNKNOWN = "und"
_BLANK = 32
_MARK = np.uint32(1 << 31)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Models:
    """Sorted hashes, log probabilities and back-off weights by order; everything else by language."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    backoffs: list[np.ndarray]
    unseen: np.ndarray
    usual: np.ndarray
    deviation: np.ndarray


_fold: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point to the lower-case letter it counts as, to itself with `_MARK` set for a mark, or to a blank."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, _BLANK, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            kind = unicodedata.category(char)
            if kind[0] == "L":
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
            elif kind == "Mn":
                table[code] = code | _MARK
        _fold = table
    return _fold


def symbols(text: str) -> np.ndarray:
    """The text as numbers of letters and single blanks, with one blank at each end; empty without letters.

    Marks behind a letter stay with it; all others are blanks.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold_table()[codes]
    marks = folded >= _MARK
    if marks.any():
        bearer = np.maximum.accumulate(np.where(marks, -1, np.arange(len(folded))))
        borne = (bearer >= 0) & (folded[bearer] != _BLANK)
        folded = np.where(marks, np.where(borne, folded & ~_MARK, _BLANK), folded)
    if not (folded != _BLANK).any():
        return np.empty(0, np.uint32)
    padded = np.concatenate(([_BLANK], folded, [_BLANK])).astype(np.uint32)
    blank = padded == _BLANK
    return padded[~(blank & np.concatenate(([False], blank[:-1])))]


def gram_hashes(sequence: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of each run of ``order`` symbols, by where it starts; exact for up to three."""
    values = sequence.astype(np.uint64)
    count = len(values) - order + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found = values[:count].copy()
    for step in range(1, order):
        if step < 3:
            found = (found << np.uint64(21)) | values[step : step + count]
        else:
            found = (found ^ (found >> np.uint64(29))) * _MIX + values[step : step + count]
    return found


def _count_grams(texts: Iterator[tuple[str, str]]) -> pd.DataFrame:
    """N-grams of every order with their counts and their parts: all but the last symbol, all but the first."""
    parts = []
    for lang, text in texts:
        sequence = symbols(text)
        for order in range(1, ORDER + 1):
            kept, first, number = np.unique(gram_hashes(sequence, order), return_index=True, return_counts=True)
            if len(kept):
                below = gram_hashes(sequence, order - 1) if order > 1 else np.zeros(len(sequence) + 1, np.uint64)
                parts.append((lang, order, kept, below[first], below[first + 1], number))
    if not parts:
        return pd.DataFrame({c: [] for c in ("lang", "n", "gram", "context", "shorter", "count")})
    frame = pd.concat(
        pd.DataFrame(
            {
                "lang": lang,
                "n": order,
                "gram": kept.view(np.int64),
                "context": context.view(np.int64),
                "shorter": shorter.view(np.int64),
                "count": number,
            }
        )
        for lang, order, kept, context, shorter, number in parts
    )
    return frame.groupby(["lang", "n", "gram", "context", "shorter"], as_index=False)["count"].sum()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Models:
    """Fit models on a bounded sample of the rows that have a text and a language.

    Each language is learned from its ``sample`` different blocks of least hash, or all if it has fewer; equal ones
    count once, so copies do not crowd out other texts. There is no bound on languages; the tables have a column for
    each. N-grams are counted on the executors; the driver gets the counts of the sample.
    """
    rows = common.for_python(labelled).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    whole = F.length(text) <= SAMPLE_CHARS
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SAMPLE_CHARS}}}"), F.lit(0))
    blocks = rows.select(
        F.col(lang).cast("string").alias("lang"),
        F.explode(F.when(whole, F.array(text)).otherwise(parts)).alias("text"),
    )
    blocks = blocks.select("lang", "text", F.xxhash64("text", F.lit("sample")).alias("place"))
    # Hashes are uniform, so few more than twice the sample lie below the limit, however many blocks there are; the
    # estimate would have to be half the truth for the limit to leave out one of the sample.
    share = F.lit(2.0 * sample + 100) / F.approx_count_distinct("place", 0.02)
    limits = blocks.groupBy("lang").agg(F.when(share < 1, share * 2.0**64 - 2.0**63).alias("limit"))
    below = F.col("limit").isNull() | (F.col("place").cast("double") < F.col("limit"))
    least = Window.partitionBy("lang").orderBy("place")
    candidates = _meet(blocks.select("lang", "place"), limits, ["lang"]).filter(below).select("lang", "place").distinct()
    places = candidates.withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= sample)
    chosen = (
        _meet(blocks, places, ["lang", "place"])
        .groupBy("lang", "place", "rank")
        .agg(F.any_value("text").alias("text"))
    )
    calibrate = F.col("rank") % CALIBRATION == 0
    group = F.floor(F.col("rank") / COUNTED_BLOCKS)
    chosen = common.checkpointed(chosen.select("lang", "text", calibrate.alias("calibrate"), group.alias("group")))
    counts = (
        _group_counts(chosen.filter(~F.col("calibrate")))
        .groupBy("lang", "n", "gram")
        .agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("count").alias("count"))
        .toArrow()
        .to_pandas()
    )
    models = _fit(counts)
    if models.languages:
        _calibrate(models, chosen.filter("calibrate"))
    return models


def _group_counts(blocks: DataFrame) -> DataFrame:
    """N-gram counts of each group of blocks of a language; their number does not depend on how the rows are dealt."""
    return blocks.groupBy("lang", "group").applyInPandas(
        lambda frame: _count_grams(zip(frame["lang"], frame["text"])),
        "lang string, n long, gram long, context long, shorter long, count long",
    )


def _meet(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the table has, with its columns; the rows stay where they are if the table is small."""
    table = common.checkpointed(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, keys)


def _fit(counts: pd.DataFrame) -> Models:
    """Interpolated Kneser-Ney estimates from n-gram counts.

    The highest order uses counts; lower ones use the number of different symbols seen in front. The discount of
    an order is n1 / (n1 + 2 n2) by how many of its n-grams were seen once and twice.
    """
    languages = sorted(counts["lang"].unique())
    hashes, logs, backoffs = [], [], []
    unseen = np.full(len(languages), -30.0)
    grams = {
        n: np.sort(counts.loc[counts["n"] == n, "gram"].to_numpy(np.int64).view(np.uint64)) for n in range(1, ORDER + 1)
    }
    for order in range(1, ORDER + 1):
        hashes.append(np.unique(grams[order]))
        logs.append(np.full((len(hashes[-1]), len(languages)), np.nan, np.float32))
        backoffs.append(np.zeros((len(hashes[-1]), len(languages)), np.float32))
    for column, lang in enumerate(languages):
        own = {n: part for n, part in counts[counts["lang"] == lang].groupby("n")}
        below: dict[int, float] = {}
        for order in range(1, ORDER + 1):
            if order not in own:
                break
            table = own[order].copy()
            if order < ORDER and order + 1 in own:
                fronts = own[order + 1].groupby("shorter").size()
                table["count"] = table["gram"].map(fronts).fillna(0)
                table = table[table["count"] > 0]
            ones, twos = (table["count"] == 1).sum(), (table["count"] == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            if order == 1:
                total, kinds = table["count"].sum(), len(table)
                # What discounting leaves is shared by one symbol more than were seen.
                spare = discount * kinds / total / (kinds + 1)
                table["p"] = (table["count"] - discount) / total + spare
                unseen[column] = np.log(spare)
            else:
                context = table.groupby("context")["count"].agg(["sum", "size"])
                sums, kinds = table["context"].map(context["sum"]), table["context"].map(context["size"])
                weight = discount * kinds / sums
                lower = table["shorter"].map(below).fillna(np.exp(unseen[column]))
                table["p"] = (table["count"] - discount) / sums + weight * lower
                at = np.searchsorted(hashes[order - 2], context.index.to_numpy(np.int64).view(np.uint64))
                backoffs[order - 2][at, column] = np.log(discount * context["size"] / context["sum"])
            at = np.searchsorted(hashes[order - 1], table["gram"].to_numpy(np.int64).view(np.uint64))
            logs[order - 1][at, column] = np.log(table["p"])
            below = dict(zip(table["gram"], table["p"]))
    _complete(counts, hashes, logs, backoffs, unseen)
    ones = np.ones(len(languages))
    return Models(languages, hashes, logs, backoffs, unseen.astype(np.float32), ones * 3.0, ones)


def _complete(counts: pd.DataFrame, hashes, logs, backoffs, unseen: np.ndarray) -> None:
    """Fill in, order by order, what a language gives to n-grams that only others have, by backing off."""
    logs[0][:] = np.where(np.isnan(logs[0]), unseen, logs[0])
    for order in range(2, ORDER + 1):
        table = counts[counts["n"] == order].drop_duplicates("gram")
        place = lambda name, n: np.searchsorted(hashes[n - 1], table[name].to_numpy(np.int64).view(np.uint64))
        at, values = place("gram", order), logs[order - 1]
        lower = backoffs[order - 2][place("context", order - 1)] + logs[order - 2][place("shorter", order - 1)]
        values[at] = np.where(np.isnan(values[at]), lower, values[at])


def cross_entropies(models: Models, text: str) -> tuple[np.ndarray, int] | None:
    """Nats per symbol for each language, and the number of symbols; None without letters."""
    sequence = symbols(text)
    if not len(sequence):
        return None
    total, count = np.zeros(len(models.languages)), len(sequence) - 1
    for start in range(1, len(sequence), BLOCK):
        begin = max(0, start - ORDER + 1)
        total += _log_likelihood(models, sequence[begin : start + BLOCK], start - begin)
    return -total / count, count


def _log_likelihood(models: Models, sequence: np.ndarray, first: int) -> np.ndarray:
    """Sum of log probabilities of the symbols from ``first`` on, for each language."""
    total = np.zeros(len(models.languages))
    places = np.arange(first, len(sequence))
    for order in range(ORDER, 0, -1):
        table, below = models.hashes[order - 1], models.hashes[order - 2]
        enough = places >= order - 1
        inside = places[enough] - (order - 1)
        if len(inside) and len(table):
            at, known = _look_up(table, gram_hashes(sequence, order)[inside])
            total += models.logs[order - 1][at if known.all() else at[known]].sum(axis=0, dtype=np.float64)
            inside = inside[~known]
        # What no language has at this order goes to the next one, at the cost of its context's back-off weight.
        if order > 1 and len(inside) and len(below):
            at, known = _look_up(below, gram_hashes(sequence, order - 1)[inside])
            total += models.backoffs[order - 2][at[known]].sum(axis=0, dtype=np.float64)
        places = np.concatenate((places[~enough], inside + (order - 1)))
        if not len(places):
            break
    return total + len(places) * models.unseen


def _look_up(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


def _calibrate(models: Models, held: DataFrame) -> None:
    """Usual cross-entropy and its deviation per language, from labelled texts that were not counted."""
    rows = held.mapInPandas(
        lambda frames: (_own_entropies(models, frame) for frame in frames), "lang string, entropy double, n long"
    ).filter(F.col("n") >= REJECT_CHARS)
    found = rows.groupBy("lang").agg(F.percentile("entropy", 0.5), F.percentile("entropy", 0.84))
    for lang, middle, high in found.collect():
        if lang in models.languages:
            at = models.languages.index(lang)
            models.usual[at], models.deviation[at] = middle, max(high - middle, 0.02)


def _own_entropies(models: Models, frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for lang, text in zip(frame["lang"], frame["text"]):
        found = cross_entropies(models, text)
        if found and lang in models.languages:
            rows.append((lang, float(found[0][models.languages.index(lang)]), found[1]))
    return pd.DataFrame(rows, columns=["lang", "entropy", "n"]).astype({"entropy": float, "n": int})


def identify_text(models: Models, text: str | None) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether the text is unlike all languages."""
    found = cross_entropies(models, text) if text and models.languages else None
    if found is None:
        return UNKNOWN, 0.0, False
    entropies, count = found
    best = int(entropies.argmin())
    odds = np.exp(-(entropies - entropies[best]) * min(count, SCORE_CHARS))
    above = (entropies[best] - models.usual[best]) / models.deviation[best]
    rejected = bool(above > REJECT_DEVIATIONS) and count >= REJECT_CHARS
    score = float(odds[best] / odds.sum())
    return models.languages[best], score / 2 if rejected else score, rejected


def identify(docs: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``; the text is dropped, or only the columns ``keep`` stay.

    ``lang_pred`` is `UNKNOWN` for a NULL text and one without letters. A rejected text, which is unlike any
    language learned, still gets the nearest one, with at most half the score. Nothing is shuffled; the models,
    whose size the training sample bounds, go to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    chosen = docs if keep is None else docs.select(*keep, text)
    schema = common.schema_with(chosen, [text], added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identify_text(shared.value, t.as_py()) for t in batch.column(text)]
            new = dict(zip(("lang_pred", "score", "rejected"), zip(*found))) if found else {}
            kinds = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
            columns = [
                pa.array(new.get(f, ()), kinds[f]) if f in kinds else batch.column(f) for f in schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return common.for_python(chosen).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(common.crc_of_id(doc_id), F.lit(4)) == 2
