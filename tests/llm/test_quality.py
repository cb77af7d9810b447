from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from statistics import mean, pstdev

import pytest

from clftally.llm import quality, registry
from tests.llm.compare import duckdb_rows, spark_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
COMMON = list(dict.fromkeys(w for of in quality.COMMON_WORDS.values() for w in of))


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def histograms(text):
    text = text or ""
    classes = Counter()
    for c in text:
        category = unicodedata.category(c)
        blank = c in " \t\n\x0b\f\r"
        kind = "blank" if blank else {"Ll": "lower", "Lu": "upper"}.get(category, "number" if category[0] == "N" else "other")
        classes[kind] += 1
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(words)
    used = [times[w] for w in COMMON]
    share = lambda ns, n: [k * quality._UNIT // max(n, 1) for k in ns]
    return (
        share([classes[c] for c in quality.CLASSES], len(text)),
        share([*used, len(words) - sum(used)], len(words)),
        len(text),
        len(words),
    )


def distance(left, right):
    if not sum(left) or not sum(right):
        return 0.0
    p, q = ([x / sum(of) for x in of] for of in (left, right))
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def judged_by_hand(rows):
    """``kept`` by id, for rows of id, text, language."""
    shapes = {d: histograms(t) for d, t, _ in rows}
    failed = {d: base(t)["base_failed"] for d, t, _ in rows}
    sums = defaultdict(lambda: None)
    for d, _, lang in rows:
        if not failed[d]:
            own = shapes[d][:2]
            sums[lang] = own if sums[lang] is None else tuple([a + b for a, b in zip(x, y)] for x, y in zip(sums[lang], own))
    limits = {}
    for lang, (_, usual) in sums.items():
        off = [distance(shapes[d][1], usual) for d, _, of in rows if of == lang and not failed[d] and shapes[d][3] >= 80]
        if off and sum(usual[:-1]) >= 0.1 * sum(usual):
            wordless = distance([0] * len(COMMON) + [1], usual)
            limits[lang] = min(max(mean(off) + 3 * pstdev(off), 0.2), 0.95 * wordless)
    kept = {}
    for d, _, lang in rows:
        classes, words, chars, count = shapes[d]
        kept[d] = not failed[d] and not (
            (chars >= quality.MIN_CLASS_CHARS and distance(classes, sums[lang][0]) > quality.MAX_CLASS_DISTANCE)
            or (count >= 80 and distance(words, sums[lang][1]) > limits.get(lang, 1))
        )
    return kept


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_plain_python(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = judged_by_hand(rows)
    got = {r.doc_id: r.asDict() for r in registry.op5_quality(spark, sf).collect()}
    for doc_id, text, _ in rows:
        assert got[doc_id] == {"doc_id": doc_id, **base(text), "kept": kept[doc_id]}
    assert 0 < sum(kept.values()) < len(kept)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, sf):
    assert spark_rows(registry.op5_quality(spark, sf)) == duckdb_rows(quality.sql(), sf)


def test_odd_texts(spark):
    same = "one two three four five six seven eight "
    texts = [None, "", " \n\t", same, same * 2, same * 3, "a " * 5000, "x", "\n".join(["l"] * 9), "é中 " * 30, "z" * 70_000]
    texts += ["one two\x0bthree\x85four five"] * 2 + [" ".join(map(str, range(9000)))]
    docs = spark.createDataFrame([(i if i else None, t, "q" if i % 2 else None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id or 0: r.asDict() for r in quality.judge(docs).collect()}
    for i, text in enumerate(texts):
        assert {k: got[i][k] for k in base(text)} == base(text), i


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", kept int, extra string")
    got = quality.judge(empty)
    assert got.columns[:3] == ["doc_id", "lang", "extra"] and got.columns.count("kept") == 1 and got.collect() == []
    only = quality.judge(spark.createDataFrame([(1, "a b", "en")], SCHEMA)).first()
    assert only.class_distance is None and only.base_failed and not only.kept


def test_junk_is_rejected_and_prose_kept(spark):
    prose = "the rain in spain is of no use to a man that was in it for long and so on it goes in town number {} or so "
    rows = [(i, " ".join(prose.format(i * 7 + k) for k in range(4)), "en") for i in range(40)]
    junk = [(100, " ".join(f"#{k}*$%&|<>" for k in range(60)), "en"), (101, " ".join(f"LOUD{k}!!" for k in range(80)), "en")]
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.judge(spark.createDataFrame(rows + junk, SCHEMA)).collect()}
    assert not kept[100][0] and not kept[100][1] and not kept[101][0] and not kept[101][1]
    assert all(k for i, (k, failed) in kept.items() if i < 100 and not failed)


def prose_and_salad():
    """Prose of two languages, word salad and menus without common words, and a language that the list does not know."""
    rnd, rows = random.Random(3), []
    for lang in ("en", "fr"):
        common, own = quality.COMMON_WORDS[lang], [f"{lang}word{i}" for i in range(500)]
        say = lambda n, often, own=own, common=common: " ".join(
            rnd.choice(common) if rnd.random() < often else rnd.choice(own) for _ in range(n)
        )
        rows += [(len(rows) + i, say(rnd.randrange(80, 600), 0.35), lang) for i in range(150)]
        rows += [(1000 + len(rows) + i, say(rnd.randrange(80, 600), 0), lang) for i in range(12)]
        rows += [(1000 + len(rows) + i, say(150, 0).replace(" ", " | "), lang) for i in range(6)]
    rows += [(500 + i, " ".join(f"mot{rnd.randrange(400)}" for _ in range(200)), "xx") for i in range(20)]
    return rows + [(600, rows[0][1], "yy"), (601, rows[0][1], None)]


def test_word_salad_goes_and_prose_stays(spark, monkeypatch):
    rows = prose_and_salad()
    docs = spark.createDataFrame(rows, SCHEMA)
    for few in (quality.BROADCAST_LANGUAGES, 0):
        monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", few)
        got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
        assert got == {d: d < 1000 for d, _, _ in rows} == judged_by_hand(rows)


def test_documents_stay_where_they_are(spark):
    plan = quality.judge(spark.createDataFrame(prose_and_salad(), SCHEMA))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_distance(spark):
    from pyspark.sql import functions as F

    one = lambda *a: F.array(*[F.lit(x) for x in a])
    d = lambda a, b: quality.distance(one(*a), one(*b))
    row = spark.range(1).select(d((1, 0), (0, 3)), d((2, 2), (5, 5)), d((1, 0), (1, 1)), d((0, 0), (1, 1))).first()
    assert row[0] == pytest.approx(1) and row[1] == pytest.approx(0)
    assert row[2] == pytest.approx(distance([1, 0], [1, 1])) and row[3] is None
