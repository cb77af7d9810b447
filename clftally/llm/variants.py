"""Spelling variants: words that one inserted, deleted or replaced code point makes out of more frequent ones.

Every word is marked at its end and all rotations of it are taken. In a rotation whose last letter is skipped, what is
left is the word without that letter and says where it stood. Words that differ by one replaced letter leave the same
rest, and a word that lacks the letter altogether has that rest as a rotation of its own. So a group of equal rests
holds all words that differ at one place: it is a prefix range of the sorted rotations. No group is larger than the
alphabet and one, and it is scanned as it is sorted, without a pair being made: a word needs only the group's size and
its most frequent word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clftally.llm import common, shingles
from clftally.llm.prefix_trie import CRC_SQL
from clftally.operators import numbering

# Fixed value: what words are made of, as a character class.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
# A form occurs at least so many times as often as its variant.
RATIO = 10
# One run in so many is typed badly on purpose, to have variants whose root is known.
ONE_IN = 31

# Words with more letters than this are known by hashes.
LONG = 64
# Rows of such words that are handed on at once.
_ROWS = 1 << 16

# Marks the end of a word; no letter.
_END = "$"


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    one_in: int | None = None,
) -> DataFrame:
    """``word`` and ``n`` of the words of all texts, with A-Z in lower case; other letters keep theirs.

    With ``one_in`` a run is changed if that number divides the CRC-32 h of ``<id>:<run>``: it loses its code point
    number h modulo its length. A NULL text has no words; a NULL id is empty text.
    """
    # A run shorter than a word cannot become one.
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_length},}}+"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", lower.alias("word"))
    if one_in:
        rows = rows.select("word", F.crc32(F.concat_ws(":", "id", "word")).alias("h"))
        place = F.col("h") % F.length("word")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
        rows = rows.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("word")).alias("word"))
    return (
        rows.filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def neighbours(words: DataFrame, long: int = LONG) -> DataFrame:
    """``word``, ``n``, ``n_near`` (words at one edit) and ``best`` (``n`` and ``word`` of the most frequent of these).

    ``best`` may be NULL or less frequent than the word's true best where no neighbour is more frequent than it.
    """
    length = F.length("word")
    # A word just over the limit has its shorter neighbours among the one kind, its others among the other.
    short = _scan(_rotations(words.filter(length <= long + 1)), ["rest"], F.length("me") <= long)
    found = short.unionByName(_long_neighbours(words.filter(length > long)))
    found = found.groupBy("me").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return words.join(found.withColumnRenamed("me", "word"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("n"), F.col("best.me").alias("word"))).alias("best"),
    )


def _rotations(words: DataFrame) -> DataFrame:
    """Two rows per rotation: as it is, the rest of longer words; without its last letter, the rest of its own word.

    ``rest``, ``me`` (the word), ``n``, ``longer`` (whether a letter is skipped) and ``first``: a letter behind its like
    can be taken out in several places with one result, of which the first counts.
    """
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("place"))
    behind = F.substring(F.col("word"), F.col("place") + 1, F.length("word"))
    rotation = F.concat(behind, F.lit(_END), F.substring(F.col("word"), F.lit(1), F.col("place")))
    turned = turned.select("n", rotation.alias("rotation"))
    whole = F.struct(F.col("rotation").alias("rest"), F.lit("").alias("skipped"))
    less = F.struct(F.left("rotation", F.length("rotation") - 1).alias("rest"), F.right("rotation", F.lit(1)).alias("skipped"))
    rows = turned.select("n", F.inline(F.array(whole, less))).filter(F.col("skipped") != _END)
    return rows.select(
        "rest",
        _word(F.col("rest"), F.col("skipped")).alias("me"),
        "n",
        (F.col("skipped") != "").alias("longer"),
        (F.col("skipped") != F.right("rest", F.lit(1))).alias("first"),
    )


def _scan(rows: DataFrame, rest: list[str], alike: Column | None = None) -> DataFrame:
    """``me``, ``near`` and ``best`` of each word in each range of equal rests that holds another word.

    Where ``alike`` is false, words of one length are not counted as near.
    """
    group = Window.partitionBy(*rest)
    count = lambda which: F.count(F.when(which, 1)).over(group)
    ranged = rows.select(
        "me", "n", "longer", "first",
        count(F.col("longer")).alias("of_one"),
        count(F.col("longer") & F.col("first")).alias("firsts"),
        count(~F.col("longer")).alias("lacking"),
        F.min(F.struct((-F.col("n")).alias("less"), "me")).over(group).alias("best"),
    ).filter(F.col("of_one") + F.col("lacking") > 1)
    others = F.col("of_one") - 1
    if alike is not None:
        others = F.when(alike, others).otherwise(0)
    near = F.when(F.col("longer"), others + F.when(F.col("first"), F.col("lacking")).otherwise(0)).otherwise(F.col("firsts"))
    return ranged.select("me", near.alias("near"), F.when(F.col("best.me") != F.col("me"), F.col("best")).alias("best"))


def _long_neighbours(words: DataFrame) -> DataFrame:
    """The same for words so long that the text of all their rotations would grow out of hand.

    Rests are known by the hashes of their two parts, and words by their place in code-point order.
    """
    placed = common.checkpointed(numbering.in_blocks(words, ["word"]))
    numbered = common.checkpointed(numbering.numbered(placed, [], ["word"], "number").select("number", "word", "n"))
    schema = "ahead long, behind long, me long, n long, longer boolean, first boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, word, n in zip(batch["number"], batch["word"], batch["n"]):
                letters = np.array(list(word))
                edges = np.concatenate(([0], np.cumsum([len(letter.encode()) for letter in letters])))
                data = np.frombuffer(word.encode(), np.uint8)
                start, end = np.zeros(len(edges), np.int64), np.full(len(edges), edges[-1])
                ahead = shingles.stretch_hashes(data, start, edges).view(np.int64)
                behind = shingles.stretch_hashes(data, edges, end).view(np.int64)
                first = np.concatenate(([True], letters[1:] != letters[:-1]))
                for longer, a, b, f in ((False, ahead, behind, True), (True, ahead[:-1], behind[1:], first)):
                    rows = {"ahead": a, "behind": b, "me": number, "n": n, "longer": longer, "first": f}
                    for at in range(0, len(a), _ROWS):
                        yield pd.DataFrame({k: v[at : at + _ROWS] if np.ndim(v) else v for k, v in rows.items()})

    found = _scan(common.for_python(numbered).mapInPandas(run, schema), ["ahead", "behind"])
    found = found.groupBy("me").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    me, other = (numbered.select(F.col("number").alias(a), F.col("word").alias(b)) for a, b in (("me", "mine"), ("of_best", "its")))
    named = found.withColumn("of_best", F.col("best.me")).join(me, "me").join(other, "of_best", "left")
    best = F.when(F.col("best").isNotNull(), F.struct(F.col("best.less").alias("less"), F.col("its").alias("me")))
    return named.select(F.col("mine").alias("me"), "near", best.alias("best"))


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word.

    ``form`` is the most frequent word at one edit (ties: the first by code points) if it occurs at least ``ratio``
    times as often, and ``root`` is where forms lead. ``words`` has distinct words and their counts, none NULL.
    Each step multiplies the count by ``ratio``, so ways are short; they are halved each round.
    """
    found = neighbours(common.checkpointed(words))
    fits = F.col("best.n") >= ratio * F.col("n")
    formed = common.checkpointed(
        found.select(
            "word", F.when(fits, F.col("best.word")).alias("form"), "n", "n_near", F.when(fits, F.col("best.n")).alias("form_n")
        )
    )
    ways = common.checkpointed(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        longer = common.checkpointed(longer)
        if longer.filter("moved").isEmpty():
            break
        ways = longer.drop("moved")
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _word(rest: Column, skipped: Column) -> Column:
    """The word of a rotation: what stands behind the mark comes first."""
    return F.concat(F.substring_index(rest, _END, -1), skipped, F.substring_index(rest, _END, 1))


SQL = f"""
WITH runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS times
  FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{MIN_LENGTH},}}')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
  ) GROUP BY ALL
),
drawn AS (
  SELECT run, times, CAST({CRC_SQL.format(blob="encode(id || ':' || run)")} AS BIGINT) AS h FROM runs
),
typed AS (
  SELECT times, CASE WHEN h % {ONE_IN} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word
  FROM drawn
),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM typed WHERE length(word) >= {MIN_LENGTH}
  GROUP BY word HAVING sum(times) >= {MIN_COUNT}
),
cuts AS (
  SELECT word, n, i, word[: i] AS before, word[i + 2 :] AS behind
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM cuts a JOIN cuts b ON a.i = b.i AND a.before = b.before AND a.behind = b.behind AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.before || c.behind
  UNION
  SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.before || c.behind
),
bests AS (
  SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM pairs GROUP BY word
),
firsts AS (
  SELECT p.word, any_value(n_near) AS n_near, any_value(best_n) AS best_n, min(near) AS best
  FROM pairs p JOIN bests b ON b.word = p.word AND b.best_n = p.near_n GROUP BY p.word
),
formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
  FROM words w LEFT JOIN firsts USING (word)
),
ways AS (
  WITH RECURSIVE way(word, reached, step) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL
    SELECT way.word, f.form, step + 1 FROM way JOIN formed f ON f.word = way.reached WHERE f.form IS NOT NULL
  )
  SELECT word, arg_max(reached, step) AS root FROM way GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed JOIN ways USING (word)
"""
