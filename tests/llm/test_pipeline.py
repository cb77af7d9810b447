from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from clftally.llm import bpe, lines, mixing, quality, registry
from tests.llm.test_lines import brute_force as lines_by_hand
from tests.llm.test_mixing import targets_of
from tests.llm.test_near_dedup import brute_force as classes_by_hand
from tests.llm.test_quality import judged_by_hand

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def mixed_by_hand(docs):
    sizes = defaultdict(int)
    for _, source, text in docs:
        sizes[source] += len(words(text))
    key = lambda d: (hashlib.md5(f"mix:{d[0]}".encode()).hexdigest(), d[0])
    for source, target in targets_of(sizes).items():
        own = sorted((d for d in docs if d[1] == source), key=key)
        left = int(target + 0.5)
        while left > 0:
            for doc_id, _, text in own:
                n = len(words(text))
                if 0 < left < n:
                    text = re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % left, text).group()
                if left > 0 and n:
                    yield doc_id, text
                left -= min(n, left)


def test_run_against_plain_python(spark):
    docs = [(r.doc_id, r.source, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = judged_by_hand([(d, t, lang) for d, _, t, lang in docs])
    docs = [(d, s, t) for d, s, t, _ in docs if kept[d]]
    docs = [row[:3] for row in lines_by_hand(docs, lines.MIN_SITES)]
    named = dict(classes_by_hand([(d, t) for d, _, t in docs])[0])
    docs = [row for row in docs if named[row[0]] == row[0]]
    ranks = bpe.parse_ranks(open(public_tokenizers.path(registry.RANKS), "rb").read())
    standard = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = Counter()
    for doc_id, text in mixed_by_hand(docs):
        ids = standard.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    prose = "The rain in the valley is a thing that was of use to all and it ran for days in the old town by the river. "
    rows = [(i, prose + f"Doc {i} of it, " * (i % 3), "en", f"s{i % 4}" if i else None, 9) for i in range(30)]
    rows += [(None, None, None, None, None), (1, "", "en", "s1", 0), (2, prose, None, "s1", 1), (2, prose, None, "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, SF), stage(spark, empty, SF)
        assert docs.columns == empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert empty.count() == 0 and docs.count() > 0
    assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()


def test_constants_are_the_operators_own():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_copies", "source_mix", "encode",
    ]
    assert mixing.LIMIT == 3 and quality.MIN_WORDS == 20
