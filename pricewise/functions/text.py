"""Column expressions for listing text.

All of these are native Spark expressions (whole-stage codegen where Spark
supports it, JVM higher-order functions otherwise), but for two that look at many
texts at once on Arrow batches: the keyword counts (``keywords.py``) and the
collapsing of whitespace (``whitespace.py``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .keywords import keyword_counts
from .whitespace import WS_CHARS, collapsed

WS_CLASS = "[\\s\\x1c-\\x1f]"          # with (?U): Python's str.isspace()
WS_RUN = "(?U)" + WS_CLASS + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', s).strip()``."""
    return F.trim(collapsed(_c(c)))


def drop_rm(c: Column) -> Column:
    """Without literal ``[rm]``; only texts that hold it go through the pattern."""
    return F.when(F.contains(c, F.lit(K.RM_TOKEN)), F.regexp_replace(c, "\\[rm\\]", "")).otherwise(c)


def clean_name(c) -> Column:
    """null -> ''; drop literal ``[rm]`` (case-sensitive, before lowering);
    lower; collapse whitespace; strip."""
    base = F.coalesce(_c(c), F.lit(""))
    return collapse_ws(F.lower(drop_rm(base)))


def clean_description(c) -> Column:
    """As :func:`clean_name`, after mapping the exact value
    ``'No description yet'`` to ''."""
    col = _c(c)
    base = F.when(col == F.lit(K.NO_DESCRIPTION), F.lit("")).otherwise(F.coalesce(col, F.lit("")))
    return collapse_ws(F.lower(drop_rm(base)))


def word_count(c) -> Column:
    """Number of whitespace-separated words (``len(s.split())``); null -> 0."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), WS_RUN)
    return F.size(F.filter(parts, lambda t: t != F.lit(""))).cast("int")


def word_count_clean(c) -> Column:
    """Word count of text already collapsed and trimmed: its single spaces and one."""
    x = F.coalesce(_c(c), F.lit(""))
    spaces = F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    return F.when(x == "", F.lit(0)).otherwise(spaces + 1).cast("int")


def split_category(c) -> tuple[Column, Column, Column, Column]:
    """Return (category_name filled, cat_main, cat_sub1, cat_sub2).

    At most three levels: the remainder stays in level three; an absent level
    becomes 'unknown'; a present-but-empty level stays ''.
    """
    filled = F.coalesce(_c(c), F.lit(f"{K.UNKNOWN}/{K.UNKNOWN}/{K.UNKNOWN}"))
    parts = F.split(filled, "/", 3)
    levels = [F.coalesce(F.get(parts, i), F.lit(K.UNKNOWN)) for i in range(3)]
    return (filled, *levels)


def normalize_text(c) -> Column:
    """lower; every char outside [a-z0-9] and whitespace -> ' '; collapse; strip.

    Every maximal run of characters outside [a-z0-9] ends up as one space
    (non-whitespace becomes a space, whitespace is kept, then runs collapse),
    so a single ASCII regex pass plus a space trim is exact.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+", " "))


def raw_tokens(text) -> Column:
    """Tokens of two or more [a-z0-9] characters of the normalised text.

    They are the maximal [a-z0-9] runs of the lowered text, so the text does
    not have to be normalised first."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]{2,}"), 0)


def combine_text(*cols) -> Column:
    """null -> '', join with one space, strip."""
    return py_strip(F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in cols]))


def keyword_count(text, keywords: Iterable[str]) -> Column:
    """How many keywords occur in the lowered text as substrings (each
    counted once)."""
    return keyword_counts(F.lower(F.coalesce(_c(text), F.lit(""))), {"n": keywords})["n"]


def keyword_features(text) -> dict[str, Column]:
    """The nine keyword features, in feature order, from one look at the text."""
    groups = K.QUALITY_KEYWORDS | K.VALUE_KEYWORDS
    n = keyword_counts(F.lower(F.coalesce(_c(text), F.lit(""))), groups)
    exc, good, fair, poor, lux, bud = (n[g] for g in ("excellent", "good", "fair", "poor", "luxury", "budget"))
    score = (exc * 1.0 + good * 0.5) - (fair * 0.5 + poor * 1.0)
    return {
        "kw_excellent": exc, "kw_good": good, "kw_fair": fair, "kw_poor": poor,
        "kw_luxury": lux, "kw_budget": bud,
        "quality_score": score.cast("double"),
        "has_quality_keywords": ((exc + good + fair + poor) > 0).cast("int"),
        "has_luxury_keywords": (lux > 0).cast("int"),
    }


def condition_phrase(cond) -> Column:
    m = F.create_map(*[x for k, v in K.CONDITION_PHRASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(cond).cast("int")), F.lit(""))


def enrich_listing(name, description, brand, main, sub, condition, cleaned: bool = False) -> tuple[Column, Column]:
    """Scoring-time enrichment: returns (enriched name, enriched description).
    ``cleaned`` names and descriptions are lowered and stripped already."""
    plain = (lambda c: c) if cleaned else (lambda c: F.lower(py_strip(c)))
    b = _c(brand)
    brand_text = F.when(b.isNotNull() & (b != "") & (b != K.UNKNOWN), F.lower(b)).otherwise(F.lit(""))
    category_text = F.lower(F.concat(F.coalesce(_c(main), F.lit("")), F.lit(" "), F.coalesce(_c(sub), F.lit(""))))
    base_name = plain(F.coalesce(_c(name), F.lit("")))
    ename = F.when((brand_text != "") & ~F.contains(base_name, brand_text),
                   F.concat(brand_text, F.lit(" "), base_name)).otherwise(base_name)
    desc = plain(F.coalesce(_c(description), F.lit("")))
    first = F.when(desc != "", desc).otherwise(ename)
    cat_part = F.when(~F.contains(F.concat(desc, ename), category_text), category_text)
    brand_part = F.when((brand_text != "") & ~F.contains(desc, brand_text), brand_text)
    edesc = F.concat_ws(" ", first, cat_part, brand_part, condition_phrase(condition))
    return ename, edesc


def meaningful_words(name, description, cleaned: bool = False) -> Column:
    """Words longer than two characters in ``f"{name} {description}".lower()``. In
    ``cleaned`` texts the only whitespace is the space, so a plain split is exact."""
    text = F.lower(F.concat(F.coalesce(_c(name), F.lit("")), F.lit(" "), F.coalesce(_c(description), F.lit(""))))
    parts = F.split(text, " " if cleaned else WS_RUN)
    return F.size(F.filter(parts, lambda w: F.length(w) > 2)).cast("int")
