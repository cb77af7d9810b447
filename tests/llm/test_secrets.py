from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from clftally.llm import registry, secrets

SF = "/root/testdata/sf0.001"


def plain_base(text):
    """The patterns as they are written, with the failing matches dropped."""
    spans = [
        ("assign", m.start(), m.end())
        for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            text,
            re.I | re.A,
        )
        if len(m.group(2)) >= 6
    ]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def base(text):
    return [s[:3] for s in secrets.find(text) if s[0] in secrets.BASE_KINDS]


def values(text):
    return [text[s[1] : s[2]] for s in secrets.find(text) if s[0] == "value"]


def test_base_equals_the_plain_patterns():
    rnd = random.Random(5)
    parts = ["password", "Token", "ſecret", "api_key", "apiKEY", "AKIA", "AKIAAKIA", "=", ":", " ", '"', "'", "abc"]
    parts += ["0123456789abcdef", "é", "ABCDEFGH12345", "=x", "--", "\n", "toKen"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(20)))
        assert base(text) == plain_base(text), text


def test_a_failing_match_uses_up_its_text():
    assert base("secret: token=abcdefgh") == [("assign", 0, 22)]
    assert base("secret: token:abcdefgh") == []


SECRET = "q7Zp2vK9xT4mB1nL"


@pytest.mark.parametrize(
    "text",
    [
        f'x = "{SECRET}"\nlogin(user)\ndb_pwd = x',
        f'db_pwd = x\nx = "{SECRET}"',
        f'a = "{SECRET}"; b = a; client.privateKey = b',
        f'{{"access-key": "{SECRET}"}}',
        f'accessKey: str = "{SECRET}"',
        f"DB_PASS_WORDS=1\nSIGNING_KEY={SECRET}",
        f'const signingKey = `{SECRET}`;',
        f'config["passphrase"] = r"{SECRET}"',
        f"K={SECRET}\ncredentials: ${{K}}",
        f"bearer := '''{SECRET}'''",
    ],
)
def test_assigned_literals(text):
    assert values(text) == [SECRET]


def test_parts_of_a_sum_are_found_each():
    assert values('passphrase = "q7Zp2vK9xT4mB" + "1nLw8RcY5uH3s"') == ["q7Zp2vK9xT4mB", "1nLw8RcY5uH3s"]


@pytest.mark.parametrize(
    "text",
    [
        "The key: it was never found again.",
        'passphrase = "changeme-now-123"',
        "credentials = os.environ['DB_CREDENTIALS']",
        f'title = "{SECRET}"',
        'pwd = "short"',
        "auth: enabled",
        "pwd = pwd",
        'a = b\nb = a\npassphrase = a',
    ],
)
def test_nothing_to_find(text):
    assert values(text) == []


@pytest.mark.parametrize(
    "text, value",
    [
        ('aws_access_key = "/q7Zp2vK9xT4mB1nL8wRc/5uH3s+Ye6"', "/q7Zp2vK9xT4mB1nL8wRc/5uH3s+Ye6"),
        ('passphrase = "walnut river candle orbit"', "walnut river candle orbit"),
        ("words = 'walnut river candle orbit'\nwallet.mnemonic = words", "walnut river candle orbit"),
        ('db_pwd = "S3cr3t99"', "S3cr3t99"),
        ("DB_PWD=S3cr3t99", "S3cr3t99"),
    ],
)
def test_slashes_phrases_and_short_values(text, value):
    assert values(text) == [value]


@pytest.mark.parametrize(
    "text",
    [
        'private_key = "/etc/ssl/private/server.key"',
        'private_key = "~/.ssh/id_rsa2"',
        'credentials = "../conf/app/Users.json"',
        'passphrase = "Enter the passphrase again"',
        'title = "walnut river candle orbit"',
        'credentials = "walnut river candle orbit"',
        "private_key = key_2048",
        "pwd = var123",
        'signing_key = "settings"',
    ],
)
def test_paths_prompts_and_names_stay(text):
    assert values(text) == []


def pairs_of(assignments):
    """The heaviest weight that each literal ends up in, by walking from every name."""
    best = {}
    for target in {*assignments.literals, *assignments.sources}:
        reached = {target}
        while more := {o for name in reached for o in assignments.sources.get(name, ())} - reached:
            reached |= more
        for name in reached:
            for span in assignments.literals.get(name, ()):
                best[span] = max(best.get(span, 0), secrets.name_weight(target))
    return {span: weight for span, weight in best.items() if weight}


def test_constants_reach_the_most_telling_name():
    rnd = random.Random(9)
    names = ["a", "b", "c", "d", "e", "salt", "auth", "pwd", "passphrase", "my.key", "key_of"]
    for _ in range(300):
        parts = [f"{rnd.choice(names)} = {rnd.choice([*names, repr(str(rnd.random()))])}" for _ in range(14)]
        found = secrets.Assignments("\n".join(parts))
        order = sorted({*found.literals, *found.sources}, key=lambda n: -secrets.name_weight(n))
        got = found.reaching(name for name in order if secrets.name_weight(name))
        assert {span: secrets.name_weight(name) for span, name in got.items()} == pairs_of(found)


def test_a_long_chain_takes_linear_time():
    links = "\n".join(f"password{i} = password{i - 1}" for i in range(1, 40_000))
    text = f"password0 = '{SECRET}'\n{links}"
    assert len(text) > 1_000_000
    start = time.perf_counter()
    assert values(text) == [SECRET]
    assert time.perf_counter() - start < 10


def test_no_second_span_for_a_base_one():
    found = secrets.find(f'password = "{SECRET}"')
    assert [s[0] for s in found] == ["assign"]


@pytest.mark.parametrize("text", ["a=" * 200_000, "a:" * 200_000, 'x="' * 100_000, "a.b-" * 100_000 + "=1", "token " * 99_999])
def test_long_texts(text):
    secrets.find(text)


def test_rows(spark):
    rows = [(None, None, "old"), (1, "", None), (1, "", None), (2, f"pwd = '{SECRET}'", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = secrets.find_secrets(docs)
    assert got.columns == ["doc_id", "secrets"]
    assert sorted(len(r.secrets) for r in got.collect()) == [0, 0, 0, 1]
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op2_secrets(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain_base(docs[r.doc_id])
        joined = ",".join(":".join(map(str, s)) for s in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in secrets.BASE_KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(","))
