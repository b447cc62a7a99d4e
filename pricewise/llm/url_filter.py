"""URL filter: prefix rules and an exact Bloom filter cascade (DataFrame functions only).

Level 0 of the cascade encodes the listed keys; level 1 the keys of the
universe that pass level 0 without being listed; level 2 the listed keys that
pass level 1 too, and so on until a level has no false positives. A key of the
universe is listed if the first level that rejects it has an odd number (or
no level rejects it and the number of levels is odd). For the universe - here
every host of the corpus and all its parent domains - the answer is exact, so
lookups need no join: the bit sets come in as scalar subqueries.

Each level is one row of 64-bit words, built by a bitwise-or aggregation. Its
size is checked against ``MAX_BITS`` before it is used; a larger list is
looked up by an exact shuffle join instead.

A null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed. Repeated rows are judged row by row; an empty table gives an
empty result; an empty list allows everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewise.llm.bloom import MAX_BITS, bit_set, passes
from pricewise.llm.common import ASCII_LOWER, ASCII_UPPER, read, written

#: (verdict, host, path); the rule's name is host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: A domain is listed if a hyphen-separated part of its first label is one of these.
LISTED_TERMS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def suffixes(host: Column) -> Column:
    """The host and all its parent domains; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


@dataclass
class Cascade:
    """Levels as (one-row table of words, bits, number of hashes)."""
    levels: list[tuple[DataFrame, int, int]] = field(default_factory=list)
    exact: DataFrame | None = None

    def with_filters(self, df: DataFrame) -> DataFrame:
        """``df`` with the bit sets as columns, for ``contains``."""
        for i, (words, _, _) in enumerate(self.levels):
            df = df.withColumn(f"__level{i}", words.scalar())
        return df

    def _passes(self, key: Column, i: int) -> Column:
        _, bits, hashes = self.levels[i]
        return passes(F.col(f"__level{i}"), key, bits, hashes, i)

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self._passes(key, i), F.lit(i % 2 == 1)).otherwise(out)
        return out


def cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """The cascade of the distinct, non-null values of column ``key``.

    Both sides are written once; the loop ends when a level has no false
    positives (each level halves them at least, on average)."""
    universe = written(universe.select("key").dropna().distinct(), "url-universe")
    yes = written(listed.select("key").dropna().distinct().join(universe, "key", "left_semi"), "url-listed")
    no = universe.join(yes, "key", "left_anti")
    n_yes, n_all = yes.count(), universe.count()
    out = Cascade()
    keys, other, n, n_other = yes, no, n_yes, n_all - n_yes
    while n:
        level = len(out.levels)
        share = min(0.5, n / (math.sqrt(2) * n_other)) if level == 0 and n_other else 0.5
        hashes = max(1, round(-math.log2(share)))
        bits = max(64, -(-int(n * hashes / math.log(2)) // 64) * 64)
        if bits > max_bits:
            return Cascade(exact=yes)
        out.levels.append((written(bit_set(keys, bits, hashes, level), f"url-level{level}"), bits, hashes))
        # What the new level lets through by mistake is what the next one encodes.
        one = Cascade(out.levels)
        wrong = written(one.with_filters(other).filter(one._passes(F.col("key"), level)).select("key"), f"url-wrong{level}")
        keys, other, n, n_other = wrong, keys, wrong.count(), n
    return out


def corpus_keys(hosts: DataFrame) -> DataFrame:
    """All domains under which a lookup may be made: distinct hosts first, then
    their parents."""
    return hosts.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()


def listed_by_term(keys: DataFrame, terms: tuple[str, ...] = LISTED_TERMS) -> DataFrame:
    parts = F.split(F.substring_index("key", ".", 1), "-")
    return keys.filter(F.arrays_overlap(parts, F.array(*[F.lit(t) for t in terms])))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, url: str = "url", rules=RULES, listed=listed_by_term, max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with the struct ``__url`` of host, path, rule and verdict."""
    host, path = host_and_path(F.col(url))
    hosts = pages.select(host.alias("host"))
    keys = written(corpus_keys(hosts), "url-keys")
    found = cascade(listed(keys), keys, max_bits)
    columns = [F.col(f"`{c}`") for c in pages.columns]
    out = pages.select(*columns, host.alias("__host"), path.alias("__path"))
    if found.exact is not None:  # beyond the size bound: an exact join on the distinct hosts
        bad = (hosts.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
               .join(found.exact, "key", "left_semi").select(F.col("host").alias("__host"), F.lit(True).alias("__listed")).distinct())
        out = out.join(bad, "__host", "left")
        is_listed = F.coalesce("__listed", F.lit(False))
    else:
        out = found.with_filters(out)
        is_listed = F.exists(suffixes(F.col("__host")), found.contains)
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    method = F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*columns, F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"),
                                         F.coalesce(verdict, method).alias("verdict")).alias("__url"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "__url.*")


OP3_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN len(list_filter(string_split(host, '.'), lambda l: list_has_any(string_split(l, '-'),
             ['ads', 'adult', 'bets', 'casino', 'pills', 'porn', 'spam', 'xxx']))) > 0 THEN 'block'
    ELSE 'allow' END AS verdict
FROM k
"""
