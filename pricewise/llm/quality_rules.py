"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule rejects a document by one cheap statistic of its whole text. On a
bounded sample every rule is timed and its rejected share is counted; rules
then run in descending order of rejected share per cost, and a row stops at
the first rule that rejects it. The order only changes the work, never the
verdict, which is "no rule rejects".

Nulls count as empty texts; an empty text has no words and fails the length
rule. Repeated rows are judged row by row. Columns of the input are kept by
``judge``; measure columns live in one struct, so no name can clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewise.llm.common import let, read, sql_words

#: Rows of the sample on which cost and rejected share are estimated.
SAMPLE_ROWS = 2000

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 20
DUP_LINE_PERCENT = 50
WORD_CHARS = (2, 20)
SHOUT_PERCENT = 50


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("long")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.rlike(x, F.lit("[^ \\x09-\\x0D]")))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_shouted(text: Column) -> Column:
    """Words that end in two exclamation marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("!!(?=[ \\x09-\\x0D]|$)")).cast("long")


def _repeat_positions(tri: Column) -> Column:
    """Ascending starts of the windows whose hash occurs twice or more: sort
    (hash, start) and keep those with an equal neighbour."""
    pairs = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def kept(p: Column) -> Column:
        same = lambda i, j: p[i]["h"] == p[j]["h"]
        hit = F.filter(F.sequence(F.lit(0), F.size(p) - 1),
                       lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < F.size(p) - 1, same(k, k + 1)).otherwise(False))
        return F.array_sort(F.transform(hit, lambda k: p[k]["i"]))

    return let(pairs, kept)


def n_repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside ``size``-word windows that occur twice or more in the text.

    Texts whose window hashes are all distinct stop there, the others sort
    (hash, start) pairs: n log n in the length of a text. The coverage is a
    running sum over the sorted starts. Every array is a lambda variable, so it
    is computed once wherever the optimizer moves the expression."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + j] for j in range(size)]))

    def covered(tri: Column) -> Column:
        pos = F.when(F.size(F.array_distinct(tri)) < F.size(tri), _repeat_positions(tri)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("covered"))
        return F.aggregate(pos, start, lambda a, p: F.struct(p.alias("last"), (a["covered"] + F.least(F.lit(size), p - a["last"])).alias("covered")), lambda a: a["covered"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < size, F.lit(0)).otherwise(let(windows(h), covered))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition on the measures struct; ``needs`` names the
    measures that it reads."""
    name: str
    needs: tuple[str, ...]
    sql: str


#: All ratios are integer comparisons, so every engine agrees on ties.
RULES = (
    Rule("few_words", ("n_words",), f"n_words < {MIN_WORDS}"),
    Rule("repetition", ("n_words", "n_repeat_words"), f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), f"100 * n_symbols > {SYMBOL_PERCENT} * n_words"),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), f"100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), f"word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words"),
    Rule("shouting", ("n_words", "n_shouted"), f"100 * n_shouted > {SHOUT_PERCENT} * n_words"),
)
BASE = ("few_words", "repetition")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted")


def measured(df: DataFrame, text: str = "text", wanted: tuple[str, ...] = MEASURES) -> DataFrame:
    """``df`` with the wanted measures in the struct ``__m``."""
    plain = {"n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_shouted": n_shouted}
    df = df.withColumn("__w", sql_words(F.col(text)))
    w = F.col("__w")
    value = {"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_repeat_words": n_repeat_words(w)}
    fields = [(value[m] if m in value else plain[m](F.col(text))).alias(m) for m in wanted]
    return df.withColumn("__m", F.struct(*fields)).drop("__w")


def _condition(rule: Rule, m: str = "__m") -> Column:
    sql = rule.sql
    for name in rule.needs:
        sql = sql.replace(name, f"{m}.{name}")
    return F.expr(f"({sql})")


def ordered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules with cost (seconds on the sample) and rejected share, best first.

    An empty sample leaves the given order."""
    def sampled(df: DataFrame) -> tuple[list, float]:
        # The limit stands above the projection, so Spark reads partitions one
        # by one until it has the rows, and only the conditions reach the driver.
        took = []
        for _ in range(2):
            t = time.perf_counter()
            rows = df.limit(sample_rows).collect()
            took.append(time.perf_counter() - t)
        return rows, min(took)

    texts = docs.select(F.col(text).alias("text"))
    scan = sampled(texts.select(F.length("text")))[1]
    found = []
    for r in rules:
        rows, took = sampled(measured(texts, wanted=r.needs).select(_condition(r)))
        cost = max(took - scan, 1e-3)
        share = sum(bool(x[0]) for x in rows) / max(1, len(rows))
        found.append({"rule": r, "cost_s": cost, "rejected": share, "per_cost": share / cost})
    return sorted(found, key=lambda x: -x["per_cost"])


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the struct ``__m`` of measures and ``__rejected_by``: the
    first rule of the cascade that rejects the row, null if none does."""
    order = order or [x["rule"] for x in ordered(docs, text, rules)]
    case = F
    for r in order:
        case = case.when(_condition(r), F.lit(r.name))
    return measured(docs, text).withColumn("__rejected_by", case)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Filter form: the rows that no rule rejects, with the input's columns.

    One filter per rule, in cascade order, so a rule's measures are computed
    only for rows that passed the rules before it."""
    columns = docs.columns
    for x in ordered(docs, text, rules):
        r = x["rule"]
        docs = measured(docs, text, r.needs).filter(~_condition(r)).select(*[F.col(f"`{c}`") for c in columns])
    return docs


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = next(_condition(r) for r in RULES if r.name == BASE[0])
    for r in RULES:
        if r.name in BASE[1:]:
            base = base | _condition(r)
    return d.select("doc_id", *[F.col(f"__m.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    base.alias("base_failed"), F.col("__rejected_by").isNull().alias("kept"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT row_number() OVER () AS rid, * FROM w),
win AS (SELECT rid, i, list_slice(ws, i, i + 2)::VARCHAR AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM tri WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(ws, lambda x: x LIKE '%!!')) AS BIGINT) AS n_shouted
      FROM tri LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_shouted > 50 * n_words) AS kept
FROM m
"""
