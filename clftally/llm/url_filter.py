"""URL rules, and the reputation of hosts for what no rule decides, by empirical Bayes.

Pages that a rule decides are labelled outcomes. A host's share of blocked pages is shrunk towards that of its
registered domain, that towards its suffix's, and that towards the overall share: at each level the parent's mean is
a beta prior, worth as many pages as the spread between the children calls for (a beta-binomial model fitted by
moments). A page of a host is blocked if a lower bound of the host's posterior is over the limit.

Only DataFrame functions are used. A host with much of all rows is counted before any shuffle, and its pages are dealt
over many tasks when they meet its verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clftally.llm import common
from clftally.operators.parse import evaluate_once

# (verdict, host, path)
Rule = tuple[str, str, str]
ALLOW, BLOCK = "allow", "block"

# A page is blocked if the posterior mean of its host's blocked share, less so many standard deviations, is more than
# this share.
DEVIATIONS, MAX_BLOCKED = 1.645, 1 / 3
# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
# What is believed of all pages before any label is seen: a blocked share, and how many pages that is worth.
PRIOR_SHARE, PRIOR_WORTH = 0.1, 10.0
# Bounds of the worth of a prior, in pages; both hold where the spread gives no answer.
LEAST_WORTH, MOST_WORTH = 1.0, 1000.0
# A host with more than one in so many rows has its rows dealt over several tasks.
SHARES = 1000
# Rules that one query takes; they are part of its plan.
MAX_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IP = r"^(\d+\.\d+\.\d+\.\d+|\[.*\])(:\d+)?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is NULL or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Host and path of the longest rule that fits as one text, and its verdict; NULL if none does.

    A rule fits its host and its subdomains where the path starts with the rule's. Of rules of one length that with
    the longer host comes first, and of equal rules ``block``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    longest = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2], r[0] != BLOCK))
    named = verdicts = None
    for verdict, at, start in longest:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a verdict is {ALLOW} or {BLOCK}, not {verdict!r}")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        named = F.when(fits, at + start) if named is None else named.when(fits, at + start)
        verdicts = F.when(fits, verdict) if verdicts is None else verdicts.when(fits, verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if named is None else (named, verdicts)


def registered_domain(host: Column) -> tuple[Column, Column]:
    """The registered domain of a host, and the suffix it is registered under.

    The suffix is the last label, or the last two if these are in `TWO_LABEL_SUFFIXES`. An address or a single label
    is its own domain and suffix.
    """
    two = F.substring_index(host, ".", -2)
    is_two = two.isin(*TWO_LABEL_SUFFIXES)
    alone = host.rlike(_IP) | ~host.contains(".")
    suffix = F.when(alone, host).when(is_two, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(alone, host).when(is_two, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def reputations(
    outcomes: DataFrame, deviations: float = DEVIATIONS, max_blocked: float = MAX_BLOCKED
) -> DataFrame:
    """One row per host: ``host``, ``domain``, ``suffix``, ``posterior``, ``bound`` and ``blocked``.

    ``outcomes`` has ``host``, ``labelled`` (its labelled pages) and ``bad`` (how many of them are blocked), one row
    per host. Hosts without labels stand at their prior, which without any label is `PRIOR_SHARE`.
    """
    domain, suffix = registered_domain(F.col("host"))
    hosts = common.checkpointed(
        outcomes.select("host", "labelled", "bad", domain.alias("domain"), suffix.alias("suffix"))
    )
    domains = _summed(hosts, ["domain", "suffix"])
    suffixes = _summed(domains, ["suffix"])
    overall = _summed(suffixes, [])
    worths = (
        _spread(hosts, "host")
        .crossJoin(_spread(domains, "domain"))
        .crossJoin(_spread(suffixes, "suffix"))
        .crossJoin(_spread(overall, "overall"))
        .select(
            (
                (F.col("overall_bad") + PRIOR_SHARE * PRIOR_WORTH) / (F.col("overall_labelled") + PRIOR_WORTH)
            ).alias("overall_mean"),
            _worth("host", "domain").alias("host_worth"),
            _worth("domain", "suffix").alias("domain_worth"),
            _worth("suffix", "overall").alias("suffix_worth"),
        )
    )
    # One row, so it goes to every task.
    suffix_means = suffixes.crossJoin(F.broadcast(worths)).select(
        "suffix", "host_worth", "domain_worth", _shrunk("overall_mean", "suffix_worth").alias("suffix_mean")
    )
    domain_means = _dealt_join(domains, suffix_means, "suffix").select(
        "domain", "host_worth", _shrunk("suffix_mean", "domain_worth").alias("domain_mean")
    )
    shrunk = _dealt_join(hosts, domain_means, "domain")
    mean = _shrunk("domain_mean", "host_worth")
    variance = mean * (1 - mean) / (F.col("labelled") + F.col("host_worth") + 1)
    posterior = shrunk.select("host", "domain", "suffix", mean.alias("posterior"), F.sqrt(variance).alias("deviation"))
    bound = F.round(F.greatest(F.col("posterior") - deviations * F.col("deviation"), F.lit(0.0)), 9)
    return posterior.select("host", "domain", "suffix", "posterior", bound.alias("bound")).withColumn(
        "blocked", F.col("bound") > max_blocked
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    deviations: float = DEVIATIONS,
    max_blocked: float = MAX_BLOCKED,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``bound`` (NULL where a rule decides) to all rows.

    A NULL URL or one without ``://`` has an empty host and path; the empty host is a host like any other. Repeated
    rows are judged alike, and each counts as an outcome. Columns named like new ones are replaced, in any case.
    """
    new = ("host", "path", "rule", "verdict", "bound")
    names = [c for c in pages.columns if c.lower() not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = pages.select(row, F.col(f"`{url}`").alias("url"))
    rows = evaluate_once(rows, F.struct(*[c.alias(n) for c, n in zip(split_url(F.col("url")), ("host", "path"))]), "at")
    rule, verdict = matching_rule(F.col("at.host"), F.col("at.path"), rules)
    rows = rows.select("row", "at.host", "at.path", rule.alias("rule"), verdict.alias("verdict"))
    counts = common.checkpointed(
        rows.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count("verdict").alias("labelled"),
            F.count(F.when(F.col("verdict") == BLOCK, 1)).alias("bad"),
        )
    )
    known = reputations(counts.drop("pages"), deviations, max_blocked).select("host", "bound", "blocked")
    judged = _dealt_join(rows, known, "host", counts.select("host", F.col("pages").alias("number")))
    open_ = F.col("verdict").isNull()
    return judged.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        "host",
        "path",
        "rule",
        F.when(~open_, F.col("verdict")).when(F.col("blocked"), BLOCK).otherwise(ALLOW).alias("verdict"),
        F.when(open_, F.col("bound")).alias("bound"),
    )


def _dealt_join(
    rows: DataFrame, table: DataFrame, key: str, numbers: DataFrame | None = None
) -> DataFrame:
    """Join rows with a table of one row per key; ``numbers`` has the ``number`` of rows of each key if known.

    A key with more than one in `SHARES` of all rows has its rows dealt over parts of that size, each of which gets
    the table's row. There are fewer than `SHARES` such keys, whatever the number of rows, so they go to every task.
    """
    if numbers is None:
        numbers = rows.groupBy(key).agg(F.count("*").alias("number"))
    total = numbers.agg(F.sum("number").alias("total"))
    hot = common.checkpointed(
        numbers.crossJoin(F.broadcast(total))
        .filter(F.col("number") * SHARES > F.col("total"))
        .select(key, F.ceil(F.col("number") * SHARES / F.col("total")).cast("bigint").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("part", part).drop("parts")
    copied = table.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return dealt.join(copied.drop("parts"), [key, "part"]).drop("part")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with the labels of their members, and the squares of these for the fit."""
    return common.checkpointed(
        rows.groupBy(*keys).agg(
            F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
            _exact_sum(F.col("labelled").cast("double") * F.col("labelled")).alias("squares"),
        )
    )


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of adding: values are rounded first. NULLs count as 0."""
    return F.coalesce(F.sum(F.round(value, 9).cast("decimal(38,9)")).cast("double"), F.lit(0.0))


def _spread(rows: DataFrame, level: str) -> DataFrame:
    """What the fits of a level and of the one below need, in one row."""
    labelled, bad = F.col("labelled").cast("double"), F.col("bad").cast("double")
    some = lambda value: F.when(F.col("labelled") > 0, value)
    return rows.agg(
        F.count(some(F.lit(1))).cast("double").alias(f"{level}_groups"),
        F.coalesce(F.sum("labelled"), F.lit(0)).cast("double").alias(f"{level}_labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias(f"{level}_bad"),
        _exact_sum(some(bad * bad / labelled)).alias(f"{level}_explained"),
        *([_exact_sum(some(F.col("squares") / labelled)).alias(f"{level}_squares")] if "squares" in rows.columns else []),
    )


def _worth(level: str, parent: str) -> Column:
    """How many pages a parent's mean is worth, from the spread of its children's shares by analysis of variance."""
    column = lambda name, at=level: F.col(f"{at}_{name}")
    freedom = column("groups") - column("groups", parent)
    left = column("labelled") - column("groups")
    between = (column("explained") - column("explained", parent)) / freedom
    within = (column("bad") - column("explained")) / left
    size = (column("labelled") - column("squares", parent)) / freedom
    alike = (between - within) / (between + (size - 1) * within)
    worth = F.round((1 - alike) / alike, 6)
    return (
        F.when((freedom <= 0) | (left <= 0), F.lit(MOST_WORTH))
        .when(between <= within, F.lit(MOST_WORTH))
        .otherwise(F.greatest(F.lit(LEAST_WORTH), F.least(F.lit(MOST_WORTH), worth)))
    )


def _shrunk(prior: str, worth: str) -> Column:
    return (F.col("bad") + F.col(worth) * F.col(prior)) / (F.col("labelled") + F.col(worth))


def sql(rules: Sequence[Rule]) -> str:
    """The same verdicts in DuckDB's SQL."""
    lines = ",\n  ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    two = ", ".join(f"'{suffix}'" for suffix in TWO_LABEL_SUFFIXES)

    def summed(source: str, keys: str) -> str:
        group = f"GROUP BY {keys}" if keys else ""
        return f"""SELECT {keys + ", " if keys else ""}coalesce(sum(labelled), 0) AS labelled, coalesce(sum(bad), 0) AS bad,
    coalesce(sum(labelled * labelled), 0) AS squares FROM {source} {group}"""

    def spread(source: str, squares: bool = True) -> str:
        square = "coalesce(sum(squares / labelled) FILTER (WHERE labelled > 0), 0)" if squares else "0"
        return f"""SELECT CAST(count(*) FILTER (WHERE labelled > 0) AS DOUBLE) AS n, CAST(coalesce(sum(labelled), 0) AS DOUBLE) AS labelled,
    CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad,
    coalesce(sum(bad * bad / labelled) FILTER (WHERE labelled > 0), 0) AS explained, {square} AS squares FROM {source}"""

    def worth(level: str, parent: str) -> str:
        return f"""SELECT CASE WHEN freedom <= 0 OR rest <= 0 OR b <= w THEN {MOST_WORTH}
    ELSE greatest({LEAST_WORTH}, least({MOST_WORTH}, (b + (size - 1) * w) / (b - w) - 1)) END AS k
  FROM (
    SELECT freedom, rest, (c.explained - p.explained) / freedom AS b, (c.bad - c.explained) / rest AS w,
      (c.labelled - p.squares) / freedom AS size
    FROM (SELECT *, n - (SELECT n FROM {parent}) AS freedom, labelled - n AS rest FROM {level}) c, {parent} p
  )"""

    return f"""
WITH rules(verdict, host, path) AS (VALUES
  {lines}),
split AS (
  SELECT page_id, row_number() OVER () AS row,
    CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages
),
hosted AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
parts AS (
  SELECT page_id, row, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest[length(raw) + 1 :], '^[^?#]*') AS path FROM hosted
),
ruled AS (
  SELECT p.row, any_value(p.page_id) AS page_id, any_value(p.host) AS host, any_value(p.path) AS path,
    arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row
),
counts AS (
  SELECT host, CAST(count(verdict) AS DOUBLE) AS labelled, CAST(count(*) FILTER (WHERE verdict = 'block') AS DOUBLE) AS bad,
    string_split(host, '.') AS labels FROM ruled GROUP BY host
),
named AS (
  SELECT *, NOT contains(host, '.') OR regexp_matches(host, '{_IP}') AS alone,
    array_to_string(labels[-2:], '.') IN ({two}) AS is_two FROM counts
),
hosts AS (
  SELECT host, labelled, bad,
    CASE WHEN alone THEN host ELSE array_to_string(labels[-(CASE WHEN is_two THEN 3 ELSE 2 END):], '.') END AS domain,
    CASE WHEN alone THEN host ELSE array_to_string(labels[-(CASE WHEN is_two THEN 2 ELSE 1 END):], '.') END AS suffix
  FROM named
),
domains AS ({summed("hosts", "domain, suffix")}),
suffixes AS ({summed("domains", "suffix")}),
overall AS ({summed("suffixes", "")}),
host_spread AS ({spread("hosts", squares=False)}),
domain_spread AS ({spread("domains")}),
suffix_spread AS ({spread("suffixes")}),
overall_spread AS ({spread("overall")}),
host_worth AS ({worth("host_spread", "domain_spread")}),
domain_worth AS ({worth("domain_spread", "suffix_spread")}),
suffix_worth AS ({worth("suffix_spread", "overall_spread")}),
suffix_means AS (
  SELECT suffix, (s.bad + k * ((o.bad + {PRIOR_SHARE * PRIOR_WORTH}) / (o.labelled + {PRIOR_WORTH}))) / (s.labelled + k) AS mean
  FROM suffixes s, suffix_worth, overall o
),
domain_means AS (
  SELECT domain, suffix, (d.bad + k * s.mean) / (d.labelled + k) AS mean
  FROM domains d JOIN suffix_means s USING (suffix), domain_worth
),
posteriors AS (
  SELECT host, labelled, k, (h.bad + k * d.mean) / (h.labelled + k) AS mean
  FROM hosts h JOIN domain_means d USING (domain, suffix), host_worth
),
bounds AS (
  SELECT host, round(greatest(mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (labelled + k + 1)), 0), 9) AS bound
  FROM posteriors
)
SELECT page_id, host, path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN bound > {MAX_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN bounds USING (host)
"""
