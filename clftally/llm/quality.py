"""Quality rules: counts of a text, and how far its histograms are from those of its language.

A document's histogram of character classes and its histogram of common words are compared with the mean
histograms of all documents of its language by Jensen-Shannon distance (base 2, so from 0 to 1). Text made of
symbols, capitals or word salad lies far off; prose does not. How far words may be off follows from how far they are
in the texts of that language. Short texts have noisy histograms, so each test has a length below which it does not
reject.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clftally.llm import common
from clftally.operators.parse import evaluate_once

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Above these distances a text is rejected, unless it is shorter than the guard.
MAX_CLASS_DISTANCE = 0.25
MIN_CLASS_CHARS = 100
# Words may be off by so many deviations above the mean of their language, and by that distance at least, but not by
# this part of the distance at which a text without any common word lies.
WORD_DEVIATIONS = 3
LEAST_WORD_LIMIT = 0.2
WORDLESS_PART = 0.95
MIN_WORD_WORDS = 80
# Where the common words make up less than this, their absence tells nothing.
MIN_COMMON = 0.1
# References of up to so many languages are broadcast; rows are shuffled to meet those of more.
BROADCAST_LANGUAGES = 10_000

CLASSES = ("lower", "blank", "upper", "number", "other")

# Frequent words of some languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "est"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se"),
}

# Shares are kept as whole parts of this, so that their sums do not depend on the order of adding.
_UNIT = 1_000_000_000
# The same for distances.
_DISTANCE_UNIT = 1_000_000

_BLANKS = f"[{common.BLANKS}]+"
_OUTPUTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "class_distance",
    "word_distance",
    "kept",
)


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    common_words: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the counts, the two distances and the verdict ``kept`` to the columns ``keep`` (default: all but the text).

    The references are the mean histograms per value of ``lang`` over the documents that pass the base rules; a
    NULL language is a group like any other. A document of a language without such documents has NULL distances,
    which reject nothing. Words are judged only in languages that use the common ones. A NULL text counts as empty. Input columns named like
    new ones, in any case, are replaced; other names are free.
    """
    aside = common.Aside(docs)
    keep = [c for c in docs.columns if aside.name(c) != aside.name(text)] if keep is None else keep
    inside = list(dict.fromkeys(map(aside.name, keep)))
    return aside.back(_judged(aside.rows, aside.name(text), aside.name(lang), common_words, inside), _OUTPUTS, keep)


def _judged(
    docs: DataFrame, text: str, lang: str, common_words: Sequence[str] | None, kept: list[str]
) -> DataFrame:
    words = list(common_words or dict.fromkeys(w for of in COMMON_WORDS.values() for w in of))
    counted = common.checkpointed(_counts(docs, text, lang, words, kept))
    references = common.checkpointed(_references(counted, len(words) + 1))
    limits = _word_limits(_beside(counted, references))
    same_language = F.col("_ref_lang").eqNullSafe(F.col("_limit_lang"))
    references = common.checkpointed(references.join(limits, same_language, "left").drop("_limit_lang"))
    rows = _beside(counted, references)
    class_distance = distance(F.col("_classes"), F.col("_classes_ref"))
    rejected = (
        F.col("base_failed")
        | _far(class_distance, F.lit(MAX_CLASS_DISTANCE), F.col("_chars") >= MIN_CLASS_CHARS)
        | _far(_word_distance(), F.col("_word_limit"), F.col("n_words") >= MIN_WORD_WORDS)
    )
    return rows.select(
        *kept,
        *_OUTPUTS[:6],
        class_distance.alias("class_distance"),
        _word_distance().alias("word_distance"),
        (~rejected).alias("kept"),
    )


def _far(distance: Column, limit: Column, long_enough: Column) -> Column:
    return F.coalesce((distance > limit) & long_enough, F.lit(False))


def _counts(
    docs: DataFrame, text: str, lang: str, common_words: list[str], keep: list[str]
) -> DataFrame:
    """Counts per document, with its histograms as shares; the text itself is left behind.

    Each step that several others use goes through `evaluate_once`, or Spark would run it once per use, and
    within a lambda once per word.
    """
    rows = docs.select(*keep, F.col(lang).cast("string").alias("_lang"), common.text_or_empty(text).alias("_text"))
    # What is left of the text as one class after the other is taken out.
    rows = evaluate_once(rows, F.regexp_replace("_text", r"\p{Ll}+", ""), "_no_lower")
    rows = evaluate_once(rows, F.regexp_replace("_no_lower", _BLANKS, ""), "_no_blank")
    rows = evaluate_once(rows, F.regexp_replace("_no_blank", r"\p{Lu}+", ""), "_no_upper")
    rows = evaluate_once(rows, F.regexp_replace("_no_upper", r"\p{N}+", ""), "_rest")
    steps = ["_text", "_no_lower", "_no_blank", "_no_upper", "_rest"]
    lengths = [F.length(name) for name in steps]
    classes = [before - after for before, after in zip(lengths, lengths[1:])] + [lengths[-1]]
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{common.BLANKS}]"))
    rows = rows.select(
        *keep,
        "_lang",
        "_text",
        F.length("_text").alias("_chars"),
        F.array(*classes).alias("_class_counts"),
        (lengths[0] - classes[1]).cast("bigint").alias("word_chars"),
        F.regexp_count("_rest", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    rows = evaluate_once(rows, lines, "_lines")
    rows = evaluate_once(rows, _words(F.col("_text")), "_words")
    repeats = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")
    rows = rows.withColumn("n_dup_lines", repeats).drop("_text", "_lines")
    rows = evaluate_once(rows, _joined(F.filter("_words", lambda w: w.isin(common_words))), "_common")
    uses = [_uses(F.col("_common"), word) for word in common_words]
    n_words = F.size("_words").cast("bigint")
    rows = rows.withColumns({"n_words": n_words, "_word_counts": F.array(*uses)}).drop("_common")
    rows = _with_repeats(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return rows.select(
        *keep,
        "_lang",
        "_chars",
        *_OUTPUTS[:5],
        failed.alias("base_failed"),
        _shares("_class_counts", F.col("_chars"), rest=False).alias("_classes"),
        _shares("_word_counts", F.col("n_words"), rest=True).alias("_word_shares"),
    )


def _words(text: Column) -> Column:
    """The words of a text; splitting at one plain character needs no regex."""
    spaced = reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    return F.array_remove(F.split(spaced, " "), "")


def _joined(words: Column) -> Column:
    """Words in one text, each between spaces of its own."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def _uses(joined: Column, word: str) -> Column:
    left = F.length(F.replace(joined, F.lit(f" {word} "), F.lit("")))
    return ((F.length(joined) - left) / (len(word) + 2)).cast("int")


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words`` from ``_words``: words within windows of eight that the text has twice or more.

    Windows are compared by 64-bit hashes within one text. Only texts with equal ones are looked at further: their
    windows are sorted by hash, those equal to a neighbour are put back in order, and each adds the words up to
    the next one, eight at most.
    """
    count = F.size("_words") - (WINDOW - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    rows = evaluate_once(rows, hashes, "_hashes").drop("_words")
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = evaluate_once(rows, F.when(repeated, F.array_sort(pairs)), "_sorted").drop("_hashes")

    def like_neighbour(pair: Column, i: Column) -> Column:
        beside = [F.get("_sorted", i + step)["h"] for step in (-1, 1)]
        return F.coalesce(pair["h"] == beside[0], F.lit(False)) | F.coalesce(pair["h"] == beside[1], F.lit(False))

    found = F.filter("_sorted", like_neighbour)
    rows = evaluate_once(rows, F.array_sort(F.transform(found, lambda p: p["i"])), "_at").drop("_sorted")
    covered = F.aggregate(
        F.transform("_at", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - at, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_at")


def _shares(counts: str, total: Column, rest: bool) -> Column:
    """Counts as parts of `_UNIT`, optionally with a last one for what they leave of the total; 0 for no text."""
    all_of_it = F.greatest(total, F.lit(1)).cast("bigint")
    shares = F.transform(counts, lambda n: F.floor(n.cast("bigint") * _UNIT / all_of_it))
    if not rest:
        return shares
    used = F.aggregate(counts, F.lit(0).cast("bigint"), lambda sum_, n: sum_ + n)
    return F.concat(shares, F.array(F.floor((total - used) * _UNIT / all_of_it)))


def _references(counted: DataFrame, n_words: int) -> DataFrame:
    """Sums of the shares per language, as two arrays of which the second has ``n_words``; one row per language."""
    sample = counted.filter(~F.col("base_failed"))
    sizes = {"_classes": len(CLASSES), "_word_shares": n_words}
    sums = {
        name: [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for i in range(n)] for name, n in sizes.items()
    }
    by_lang = sample.groupBy("_lang").agg(*[s for of in sums.values() for s in of])
    arrays = [F.array(*[f"{name}{i}" for i in range(n)]).alias(f"{name}_ref") for name, n in sizes.items()]
    return by_lang.select(F.col("_lang").alias("_ref_lang"), *arrays)


def _beside(counted: DataFrame, references: DataFrame) -> DataFrame:
    """Rows with their language's references; they stay where they are if the references are few."""
    if references.count() <= BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    return counted.join(references, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")


def _word_distance() -> Column:
    return distance(F.col("_word_shares"), F.col("_word_shares_ref"))


def _word_limits(rows: DataFrame) -> DataFrame:
    """The distance beyond which the words of a long enough text are unlike its language, or NULL for none."""
    judged = rows.filter(~F.col("base_failed") & (F.col("n_words") >= MIN_WORD_WORDS))
    usual = F.col("_word_shares_ref")
    off = F.floor(_word_distance() * _DISTANCE_UNIT).alias("_off")
    spread = judged.select("_lang", usual.alias("_usual"), off).groupBy("_lang").agg(
        F.any_value("_usual").alias("_usual"),
        F.count("_off").alias("_n"),
        F.sum("_off").alias("_sum"),
        F.sum((F.col("_off") * F.col("_off")).cast("decimal(20,0)")).cast("double").alias("_squares"),
    )
    usual, size = F.col("_usual"), F.size("_usual")
    mean = F.col("_sum") / F.col("_n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") / F.col("_n") - mean * mean))
    by_spread = F.greatest((mean + WORD_DEVIATIONS * deviation) / _DISTANCE_UNIT, F.lit(LEAST_WORD_LIMIT))
    wordless = F.transform(usual, lambda _, i: F.when(i == size - 1, 1).otherwise(0))
    total = F.aggregate(usual, F.lit(0).cast("bigint"), lambda sum_, n: sum_ + n)
    limit = F.least(by_spread, WORDLESS_PART * distance(wordless, usual))
    tells = (total - F.element_at(usual, -1)) >= MIN_COMMON * total
    return spread.select(F.col("_lang").alias("_limit_lang"), F.when(tells, limit).alias("_word_limit"))


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms, each scaled to sum 1; NULL if one is NULL or all zero."""

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda sum_, n: sum_ + n)

    def part(p: Column, other: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + other))).otherwise(F.lit(0.0))

    def divergence(pairs: Column, left_total: Column, right_total: Column) -> Column:
        def add(sum_: Column, pair: Column) -> Column:
            p, q = pair["l"] / left_total, pair["r"] / right_total
            return sum_ + part(p, q) + part(q, p)

        return F.aggregate(pairs, F.lit(0.0), add) / 2

    pairs = F.zip_with(left, right, lambda l, r: F.struct(l.cast("double").alias("l"), r.cast("double").alias("r")))
    left_total, right_total = total(left), total(right)
    usable = (left_total > 0) & (right_total > 0)
    return F.when(usable, F.sqrt(F.greatest(F.lit(0.0), divergence(pairs, left_total, right_total))))


def sql(common_words: Sequence[str] | None = None) -> str:
    """DuckDB SQL for the counts and the verdict over ``documents``."""
    words = list(common_words or dict.fromkeys(w for of in COMMON_WORDS.values() for w in of))
    left = lambda kept: f"length(regexp_replace(t, '[^{kept}]+', '', 'g'))"
    uses = ", ".join(f"len(list_filter(ws, lambda w: w = '{word}'))" for word in words)
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    def far(mine: str, usual: str, size: int) -> str:
        p, q = (f"({of}[k] / list_sum({of}))" for of in (mine, usual))
        part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        parts = f"list_transform(range(1, {size + 1}), lambda k: {part(p, q)} + {part(q, p)})"
        return f"CASE WHEN list_sum({mine}) > 0 AND list_sum({usual}) > 0 THEN sqrt(greatest(0, list_sum({parts}) / 2)) END"

    wordless = str([0] * len(words) + [1])
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^{common.BLANKS}]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{common.BLANKS}]')) AS ls
  FROM texts
),
places AS (SELECT row, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM split),
again AS (
  SELECT row, i FROM (SELECT row, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM places)
  QUALIFY count(*) OVER (PARTITION BY row, win) > 1
),
repeats AS (
  SELECT row, CAST(sum(least({WINDOW}, coalesce(behind - i, {WINDOW}))) AS BIGINT) AS n
  FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS behind FROM again) GROUP BY row
),
counted AS (
  SELECT split.row, doc_id, lang, length(t) AS chars, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    {left("#*$%&|<>")} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    [{left("\\p{Ll}")}, {left(common.BLANKS)}, {left("\\p{Lu}")}, {left("\\p{N}")}] AS cs, [{uses}] AS us
  FROM split LEFT JOIN repeats USING (row)
),
shares AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    list_transform(list_append(cs, chars - list_sum(cs)),
      lambda n: CAST(n AS BIGINT) * {_UNIT} // greatest(chars, 1)) AS classes,
    list_transform(list_append(us, n_words - list_sum(us)),
      lambda n: CAST(n AS BIGINT) * {_UNIT} // greatest(n_words, 1)) AS words
  FROM counted
),
usual AS (
  SELECT lang, {sums("classes", len(CLASSES))} AS all_classes, {sums("words", len(words) + 1)} AS all_words
  FROM shares WHERE NOT base_failed GROUP BY lang
),
judged AS (
  SELECT shares.*, all_words, {far("classes", "all_classes", len(CLASSES))} AS class_distance,
    {far("words", "all_words", len(words) + 1)} AS word_distance
  FROM shares LEFT JOIN usual ON shares.lang IS NOT DISTINCT FROM usual.lang
),
spread AS (
  SELECT lang, any_value(all_words) AS all_words, avg(off) AS mean, sqrt(greatest(0, avg(off * off) - avg(off) * avg(off))) AS deviation
  FROM (SELECT *, floor(word_distance * {_DISTANCE_UNIT}) AS off FROM judged)
  WHERE NOT base_failed AND n_words >= {MIN_WORD_WORDS} GROUP BY lang
),
limits AS (
  SELECT lang, CASE WHEN list_sum(all_words) - all_words[-1] >= {MIN_COMMON} * list_sum(all_words) THEN
    least(greatest((mean + {WORD_DEVIATIONS} * deviation) / {_DISTANCE_UNIT}, {LEAST_WORD_LIMIT}),
      {WORDLESS_PART} * {far(wordless, "all_words", len(words) + 1)}) END AS word_limit
  FROM spread
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(chars >= {MIN_CLASS_CHARS} AND class_distance > {MAX_CLASS_DISTANCE}, false)
    OR coalesce(n_words >= {MIN_WORD_WORDS} AND word_distance > word_limit, false)) AS kept
FROM judged LEFT JOIN limits ON judged.lang IS NOT DISTINCT FROM limits.lang
"""
