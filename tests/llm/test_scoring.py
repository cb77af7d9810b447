from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clftally.llm import registry, scoring

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def expected(rows):
    counts = Counter(w for doc_id, text in rows if fold(doc_id) != 2 for w in tokens_of(text))
    total, kinds = sum(counts.values()), len(counts)
    for doc_id, text in rows:
        words = tokens_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        yield doc_id, fold(doc_id) == 2, len(words), sum(counts[w] > 0 for w in words), total, base


def check(found, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    for got, want in zip(found, sorted(expected(rows), key=key), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], rel=1e-9)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = registry.op10_scoring(spark, SF).collect()
    check(found, rows)
    assert all(r.score < 0 for r in found)


def test_odd_rows_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 500)
    rows = [(i, f"The word w{i % 9}\x0bÉtude  the\x85end W{i}") for i in range(200)]
    rows += [(None, None), (None, None), (1, ""), (3, "x " * 20_000), (3, "x " * 20_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = scoring.score_documents(docs).collect()
    check(found, rows)
    again = scoring.score_documents(docs.repartition(3)).collect()
    by = lambda rs: sorted((str(r.doc_id), r.n_tokens, round(r.score, 4)) for r in rs)
    assert by(found) == by(again)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert scoring.score_documents(docs).collect() == []
    held = next(i for i in range(99) if fold(i) == 2)
    only = scoring.score_documents(spark.createDataFrame([(held, "a b")], SCHEMA)).collect()
    check(only, [(held, "a b")])


@pytest.fixture(scope="module")
def triples():
    rng = np.random.default_rng(0)
    ids = [2]
    for _ in range(60_000):  # the next symbol mostly follows from the last one
        ids.append((ids[-1] * 7 + 3) % 11 if rng.random() < 0.8 else int(rng.integers(11)))
    codes = scoring.triple_codes(np.array(ids))
    return codes, *np.unique(codes, return_counts=True)


def test_the_model_is_normalised_and_learns(triples):
    codes, kept, number = triples
    table = scoring.log_table(*scoring.fit(kept, number))
    assert np.allclose(np.power(10.0, table.reshape(-1, scoring.SYMBOLS)).sum(axis=1), 1, atol=1e-4)
    frequency = np.bincount(codes % scoring.SYMBOLS) / len(codes)
    unigram = np.log10(frequency[codes % scoring.SYMBOLS]).mean()
    assert table[codes].mean() > unigram + 0.3


def test_word_shares_sum_to_one(triples):
    """Known other words and one unknown word share the probability of the symbol they have in common."""
    _, kept, number = triples
    counts = {b"rare%d" % i: i for i in range(1, 6)}
    table = scoring.log_table(*scoring.fit(kept, number))
    model = scoring.Model({scoring.END: 1}, {scoring.END: 3}, 18, 6, 15, 5, table)
    of = lambda text: scoring.score_text(model, counts | model.counts, text)[3]
    end_after = lambda ids: table[scoring.triple_codes(np.array(ids))].sum()
    total = sum(10 ** (of(w.decode()) - end_after([0, 1])) for w in [*counts, b"unknown"])
    assert total == pytest.approx(1, rel=1e-3)


def test_scores_use_the_frequent_words(spark):
    rows = [(i, "a b c d " * 50) for i in range(40)]
    found = scoring.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.score > r.base_score for r in found)


def test_words_beyond_the_frequent_ones_are_predicted_from_their_context(spark):
    """200 words of equal counts, none of them a symbol of its own: one kind always follows on the other."""
    rng = np.random.default_rng(1)
    frequent = " ".join(f"{chr(97 + i % 26)}{i}" for i in range(scoring.SYMBOLS)) + " "
    pair = lambda: f"ka{rng.integers(10)}{rng.integers(10)}ra zu{rng.integers(10)}{rng.integers(10)}mo"
    rows = [(i, " ".join(pair() for _ in range(200)) if i % 2 else frequent * 30) for i in range(100)]
    rows += [(200, "ka11ra zu22mo ka33ra zu44mo"), (201, "ka11ra ka33ra zu44mo zu22mo"), (202, "zu22mo zu44mo ka33ra ka11ra")]
    found = {r.doc_id: r for r in scoring.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[200].base_score == pytest.approx(found[201].base_score) == pytest.approx(found[202].base_score)
    assert found[200].score > max(found[201].score, found[202].score) + 1


def test_words_of_all_classes_sum_to_one(spark):
    """All known words after the beginning, and one unknown word of each pair of classes."""
    words = [f"{a}{b}{c}" for a in "abcdefghijkl" for b in "ä中xyz" for c in "mnopqé"] + ["x", "é", "中"]
    rows = [(i, " ".join(words[i % 7 :: 1 + i % 5])) for i in range(60)]
    training = spark.createDataFrame(rows, SCHEMA)
    counts = scoring.word_counts(training)
    model = scoring.train(training, counts)
    known = {bytes(r.word): r.n for r in counts.collect()}
    totals = Counter()
    for word in known.keys() - model.counts.keys():
        totals[scoring.class_of(word[:2]), scoring.class_of(word[-2:])] += known[word] + 1
    assert len(totals) > 20
    size, classes = scoring.SYMBOLS, model.classes
    shares = classes.shares.reshape(size, size)
    for first in range(size):
        assert shares[first] == pytest.approx([-math.log10(totals[first, last] + 1) for last in range(size)])
    start, end = scoring.triple_codes(np.array([1]))[0] // size * size, lambda s: model.table[(size + s) * size + 1]
    after = {w: end(model.symbols.get(w, 0)) for w in known if w != scoring.END}
    total = sum(10 ** (scoring.score_text(model, known, w.decode())[3] - after[w]) for w in after)
    total += 10 ** model.table[start + 1]
    endings = classes.endings.reshape(size, size, size)[1]
    unknown = classes.beginnings[start : start + size][:, None] + endings + shares
    total += 10 ** model.table[start] * (10**unknown).sum()
    assert total == pytest.approx(1, rel=1e-3)


def test_classes_of_words():
    text = "Ab c  \x0bé 中文\x85x\tlonger\n"
    words = scoring.words_of(text)
    beginnings, endings = scoring.word_classes(scoring.lowered_bytes(text))
    assert beginnings.tolist() == [*[scoring.class_of(w[:2]) for w in words], 1]
    assert endings.tolist() == [*[scoring.class_of(w[-2:]) for w in words], 1]
    assert [c.tolist() for c in scoring.word_classes(b"")] == [c.tolist() for c in scoring.word_classes(b" \n")] == [[1], [1]]
