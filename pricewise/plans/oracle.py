"""Independent DuckDB SQL for every SQL-expressible registered query.

Each statement runs on the raw test tables (views ``orders``, ``part``,
``customer``, ``documents`` ...) and rebuilds the listings view and the
cleaning chain itself. It shares the fixed lists of ``constants`` and the label
dictionary with the Spark side (a test pins their hashes), and no logic.
"""

from __future__ import annotations

from .. import constants as K

WS = K.RE2_WS
WSP = WS + "+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


LISTINGS = """
listings AS (
  SELECT o.o_orderkey AS train_id,
    CASE WHEN o.o_orderkey % 11 = 0 THEN '  ' || upper(p.p_name) || '  [rm]' ELSE p.p_name END AS name,
    CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS item_condition_id,
    CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
         WHEN o.o_orderkey % 13 = 0 THEN c.c_mktsegment
         WHEN o.o_orderkey % 23 = 5 THEN concat_ws('/',
           CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Men' WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'FURNITURE' THEN 'Women' ELSE 'Other' END,
           CASE WHEN o.o_orderkey % 2 = 1 THEN p.p_type WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Bedding' ELSE 'Jeans' END,
           'lot ' || o.o_orderkey)
         WHEN o.o_orderkey % 17 = 0 THEN concat_ws('/', c.c_mktsegment, p.p_type, p.p_brand, 'Extra')
         ELSE concat_ws('/', c.c_mktsegment, p.p_type, p.p_name) END AS category_name,
    CASE WHEN o.o_orderkey % 5 < 2 THEN NULL ELSE p.p_brand END AS brand_name,
    CASE WHEN o.o_orderkey % 50 = 0 THEN 0.0 ELSE o.o_totalprice / 200.0 END AS price,
    CAST(o.o_orderkey % 2 AS INTEGER) AS shipping,
    CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
         WHEN o.o_orderkey % 19 = 0 THEN 'No description yet'
         WHEN o.o_orderkey % 7 = 0 THEN 'NWT  Brand New [rm] ' || d.text
         WHEN o.o_orderkey % 7 = 1 THEN 'gently used, minor wear. ' || d.text
         WHEN o.o_orderkey % 7 = 2 THEN 'Authentic vintage; small STAIN. ' || d.text
         ELSE d.text END AS item_description
  FROM orders o
  LEFT JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
)"""


def clean_text_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(replace(coalesce({expr}, ''), '[rm]', '')), '{WSP}', ' ', 'g'))"


def word_count_sql(expr: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(coalesce({expr}, ''), '{WSP}'), lambda t: t <> '')) AS INTEGER)"


def normalize_sql(expr: str) -> str:
    kept = f"regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9{WS[1:-1]}]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, '{WSP}', ' ', 'g'))"


def keyword_count_sql(expr: str, words) -> str:
    return f"CAST(len(list_filter({_list(words)}, lambda k: contains(lower(coalesce({expr}, '')), k))) AS INTEGER)"


def cleaned_ctes(min_price=K.DEFAULT_MIN_PRICE, max_price=K.DEFAULT_MAX_PRICE, top_n=K.TOP_BRANDS_N,
                 features=True) -> str:
    """CTEs ``listings``, ``cleaned`` (and the helpers) = clean_listings()."""
    lv = f"""
filtered AS (
  SELECT * FROM listings WHERE price >= {float(min_price)} AND price <= {float(max_price)} AND NOT isnan(price)
),
catsplit AS (
  SELECT *, string_split(coalesce(category_name, 'unknown/unknown/unknown'), '/') AS _parts
  FROM filtered
),
cleaned0 AS (
  SELECT train_id, item_condition_id, price, shipping,
    coalesce(brand_name, 'unknown') AS brand_name,
    coalesce(category_name, 'unknown/unknown/unknown') AS category_name,
    coalesce(_parts[1], 'unknown') AS cat_main,
    coalesce(_parts[2], 'unknown') AS cat_sub1,
    CASE WHEN len(_parts) >= 3 THEN array_to_string(_parts[3:], '/') ELSE 'unknown' END AS cat_sub2,
    {clean_text_sql('name')} AS name,
    {clean_text_sql("CASE WHEN item_description = 'No description yet' THEN '' ELSE item_description END")} AS item_description
  FROM catsplit
)"""
    if not features:
        return "WITH " + LISTINGS.strip() + "," + lv + ",\ncleaned AS (SELECT * FROM cleaned0)\n"
    feat = f""",
topb AS (
  SELECT brand_name FROM cleaned0 WHERE brand_name <> 'unknown'
  GROUP BY brand_name ORDER BY count(*) DESC, brand_name LIMIT {int(top_n)}
),
cleaned AS (
  SELECT c.*,
    {word_count_sql('c.name')} AS name_len,
    {word_count_sql('c.item_description')} AS desc_len,
    CAST({word_count_sql('c.item_description')} > 0 AS INTEGER) AS has_description,
    CASE WHEN c.brand_name IN (SELECT brand_name FROM topb) THEN 1 ELSE 0 END AS is_top_brand
  FROM cleaned0 c
)
"""
    return "WITH " + LISTINGS.strip() + "," + lv + feat


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# --------------------------------------------------------------------------
# Flagship: clean -> text features -> top-brand flag -> brand target encoding
# --------------------------------------------------------------------------
register("listing_brand_encoding", cleaned_ctes(top_n=10) + """,
tgt AS (SELECT brand_name AS category, count(*) AS n, sum(ln(1 + price)) AS s FROM cleaned GROUP BY 1),
g AS (SELECT sum(s) / sum(n) AS g FROM tgt)
SELECT c.train_id, c.cat_main, c.brand_name, c.name_len, c.desc_len, c.is_top_brand,
  round(CASE WHEN t.n < 5 THEN (SELECT g FROM g) ELSE (t.s + 10.0 * (SELECT g FROM g)) / (t.n + 10.0) END, 6)
    AS brand_encoded
FROM cleaned c LEFT JOIN tgt t ON t.category = c.brand_name
""")


# ------------------------------------------------------------ sources ------
register("scan_head_n", "WITH " + LISTINGS.strip() + "\nSELECT * FROM listings ORDER BY train_id LIMIT 100")

# ------------------------------------------------- projections/filters -----
register("price_range_filter", "WITH " + LISTINGS.strip() + """
SELECT train_id, price FROM listings WHERE price >= 1.0 AND price <= 2000.0 AND NOT isnan(price)""")

register("fill_missing_brand", "WITH " + LISTINGS.strip() + """
SELECT train_id, coalesce(brand_name, 'unknown') AS brand_name FROM listings""")

register("split_category", "WITH " + LISTINGS.strip() + """,
s AS (SELECT train_id, coalesce(category_name, 'unknown/unknown/unknown') AS category_name,
             string_split(coalesce(category_name, 'unknown/unknown/unknown'), '/') AS p FROM listings)
SELECT train_id, category_name, coalesce(p[1], 'unknown') AS cat_main, coalesce(p[2], 'unknown') AS cat_sub1,
  CASE WHEN len(p) >= 3 THEN array_to_string(p[3:], '/') ELSE 'unknown' END AS cat_sub2 FROM s""")

register("clean_name", "WITH " + LISTINGS.strip() + f"""
SELECT train_id, {clean_text_sql('name')} AS name FROM listings""")

register("clean_description", "WITH " + LISTINGS.strip() + f"""
SELECT train_id,
  {clean_text_sql("CASE WHEN item_description = 'No description yet' THEN '' ELSE item_description END")} AS item_description
FROM listings""")

register("clean_listings", cleaned_ctes() + """
SELECT train_id, name, item_condition_id, category_name, brand_name, price, shipping, item_description,
  cat_main, cat_sub1, cat_sub2, name_len, desc_len, has_description, is_top_brand FROM cleaned""")

register("listing_text_features", cleaned_ctes() + """
SELECT train_id, name_len, desc_len, has_description FROM cleaned""")

register("top_brand_flag", cleaned_ctes(top_n=10) + """
SELECT train_id, brand_name, is_top_brand FROM cleaned""")

register("passthrough_numeric", cleaned_ctes() + """
SELECT train_id, item_condition_id, shipping FROM cleaned""")

# --------------------------------------------------------- aggregates ------
_PROFILE_COLS = [("train_id", "bigint", 8), ("name", "string", None), ("item_condition_id", "int", 4),
                 ("category_name", "string", None), ("brand_name", "string", None), ("price", "double", 8),
                 ("shipping", "int", 4), ("item_description", "string", None)]


def _profile_sql() -> str:
    parts = []
    for i, (c, t, w) in enumerate(_PROFILE_COLS):
        miss = f"({c} IS NULL OR isnan({c}))" if t == "double" else f"{c} IS NULL"
        nmiss = f"sum(CASE WHEN {miss} THEN 1 ELSE 0 END)"
        size = f"coalesce(sum(strlen({c})), 0)" if w is None else f"(count(*) - {nmiss}) * {w}"
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, '{t}' AS dtype, count(*) AS n_rows,
  CAST({nmiss} AS BIGINT) AS n_missing,
  round(CASE WHEN count(*) > 0 THEN {nmiss} * 100.0 / count(*) END, 2) AS pct_missing,
  CAST({size} AS BIGINT) AS approx_bytes FROM listings""")
    return "WITH " + LISTINGS.strip() + "\n" + "\nUNION ALL\n".join(parts)


register("table_profile", _profile_sql())

register("clean_stats", cleaned_ctes() + """
SELECT count(*) AS n_rows, CAST(15 AS BIGINT) AS n_cols, min(price) AS price_min, max(price) AS price_max,
  round(avg(price), 6) AS price_mean, round(median(price), 6) AS price_median,
  count(DISTINCT cat_main) AS n_categories_main, count(DISTINCT brand_name) AS n_brands,
  round(avg(CASE WHEN brand_name = 'unknown' THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_unknown_brand,
  round(avg(name_len), 6) AS avg_name_len, round(avg(desc_len), 6) AS avg_desc_len
FROM cleaned""")

register("category_level_counts", cleaned_ctes(features=False) + """
SELECT count(DISTINCT cat_main) AS n_cat_main, count(DISTINCT cat_sub1) AS n_cat_sub1,
  count(DISTINCT cat_sub2) AS n_cat_sub2 FROM cleaned""")

_LONG_VALUES = """,
lv AS (
  SELECT 'cat_main' AS "column", cat_main AS value FROM cleaned
  UNION ALL SELECT 'cat_sub1', cat_sub1 FROM cleaned
  UNION ALL SELECT 'cat_sub2', cat_sub2 FROM cleaned
  UNION ALL SELECT 'brand_name', brand_name FROM cleaned
  UNION ALL SELECT 'item_condition_id', CAST(item_condition_id AS VARCHAR) FROM cleaned
  UNION ALL SELECT 'shipping', CAST(shipping AS VARCHAR) FROM cleaned
)"""

register("category_stats", cleaned_ctes(features=False) + _LONG_VALUES + """
SELECT "column", count(DISTINCT value) AS n_unique, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM lv GROUP BY "column\"""")

register("top_k_values", cleaned_ctes(features=False) + _LONG_VALUES + """,
vc AS (SELECT "column", value, count(*) AS n FROM lv WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM vc)
SELECT "column", value, n, rank FROM r WHERE rank <= 5""")

register("brand_value_counts", cleaned_ctes(features=False) + """
SELECT brand_name, count(*) AS n_listings FROM cleaned WHERE brand_name <> 'unknown' GROUP BY brand_name""")

register("top_k_brands", cleaned_ctes(features=False) + """,
bc AS (SELECT brand_name, count(*) AS n_listings FROM cleaned WHERE brand_name <> 'unknown' GROUP BY brand_name)
SELECT brand_name, n_listings, CAST(row_number() OVER (ORDER BY n_listings DESC, brand_name) AS INTEGER) AS rank
FROM bc ORDER BY n_listings DESC, brand_name LIMIT 10""")


def _kw_any(expr: str, groups) -> str:
    return " + ".join(keyword_count_sql(expr, K.QUALITY_KEYWORDS[g]) for g in groups)


register("removal_report", cleaned_ctes() + f""",
b AS (SELECT count(*) AS n_before FROM listings),
a AS (SELECT count(*) AS n_after,
        sum(CASE WHEN brand_name = 'unknown' THEN 1 ELSE 0 END) AS n_unknown_brand,
        sum(is_top_brand) AS n_top_brand,
        sum(CASE WHEN ({_kw_any('item_description', ['excellent', 'good', 'fair', 'poor'])}) > 0 THEN 1 ELSE 0 END) AS n_quality_keywords,
        sum(CASE WHEN {keyword_count_sql('item_description', K.VALUE_KEYWORDS['luxury'])} > 0 THEN 1 ELSE 0 END) AS n_luxury_keywords,
        avg(name_len) AS avg_name_len, avg(desc_len) AS avg_desc_len FROM cleaned)
SELECT n_before, n_after, n_before - n_after AS n_removed,
  CASE WHEN n_before > 0 THEN round((n_before - n_after) * 100.0 / n_before, 4) ELSE 0.0 END AS pct_removed,
  CAST(n_unknown_brand AS BIGINT) AS n_unknown_brand, CAST(n_top_brand AS BIGINT) AS n_top_brand,
  CAST(n_quality_keywords AS BIGINT) AS n_quality_keywords, CAST(n_luxury_keywords AS BIGINT) AS n_luxury_keywords,
  round(avg_name_len, 6) AS avg_name_len, round(avg_desc_len, 6) AS avg_desc_len
FROM b, a""")

# ------------------------------------------------ sampling and splits ------


def split_ctes(test_size=K.SPLIT_TEST_SIZE, seed=K.SPLIT_SEED) -> str:
    """CTE ``split`` (cleaned columns + split) after cleaned_ctes()."""
    return f""",
sb AS (SELECT *, cat_main AS _s, md5(CAST(train_id AS VARCHAR) || '|{seed}') AS _h FROM cleaned),
cnt AS (SELECT _s, count(*) AS c FROM sb GROUP BY _s),
tot AS (SELECT sum(c) AS n, sum(c) - ceil({float(test_size)} * sum(c)) AS ntr FROM cnt),
q0 AS (SELECT _s, c, ntr, n, floor(c * ntr / n) AS base, c * ntr - floor(c * ntr / n) * n AS rem FROM cnt, tot),
q1 AS (SELECT _s, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, _s) <= ntr - sum(base) OVER () THEN 1 ELSE 0 END
         AS quota FROM q0),
split AS (
  SELECT sb.*, CASE WHEN row_number() OVER (PARTITION BY sb._s ORDER BY sb._h, sb.train_id) - 1 < q1.quota
                    THEN 'train' ELSE 'val' END AS split
  FROM sb JOIN q1 ON sb._s = q1._s
)"""


register("exact_sample", "WITH " + LISTINGS.strip() + """,
r AS (SELECT train_id, price, row_number() OVER (ORDER BY md5(CAST(train_id AS VARCHAR) || '|42'), train_id) AS rn
      FROM listings)
SELECT train_id, price FROM r WHERE rn <= 10000""")

register("train_val_split", cleaned_ctes() + split_ctes() + """
SELECT train_id, cat_main, split FROM split""")

register("kfold_assign", cleaned_ctes() + split_ctes() + """,
kf AS (SELECT train_id, row_number() OVER (ORDER BY _h, train_id) - 1 AS r, count(*) OVER () AS n
       FROM split WHERE split = 'train'),
kq AS (SELECT train_id, r, n // 5 AS q, n % 5 AS rem FROM kf)
SELECT train_id, CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END
                      AS INTEGER) AS fold FROM kq""")

register("target_summary", cleaned_ctes() + split_ctes() + """
SELECT min(price) AS price_min, max(price) AS price_max, round(median(price), 6) AS price_median,
  round(min(ln(1 + price)), 6) AS log_price_min, round(max(ln(1 + price)), 6) AS log_price_max
FROM split WHERE split = 'train'""")


# ------------------------------------------------------------ scalars ------
def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WSP}|{WSP}$', '', 'g')"


def combine_sql(a: str = "name", b: str = "item_description") -> str:
    return strip_sql(f"concat_ws(' ', coalesce({a}, ''), coalesce({b}, ''))")


register("combine_text", "WITH " + LISTINGS.strip() + f"""
SELECT train_id, {combine_sql()} AS text FROM listings""")

register("normalize_text", cleaned_ctes(features=False) + f"""
SELECT train_id, {normalize_sql(combine_sql())} AS text FROM cleaned""")

register("keyword_count", "WITH " + LISTINGS.strip() + f"""
SELECT train_id, {keyword_count_sql('item_description', K.QUALITY_KEYWORDS['poor'])} AS kw_poor FROM listings""")


def _kw_cols(expr: str) -> str:
    q, v = K.QUALITY_KEYWORDS, K.VALUE_KEYWORDS
    return f"""{keyword_count_sql(expr, q['excellent'])} AS kw_excellent,
  {keyword_count_sql(expr, q['good'])} AS kw_good,
  {keyword_count_sql(expr, q['fair'])} AS kw_fair,
  {keyword_count_sql(expr, q['poor'])} AS kw_poor,
  {keyword_count_sql(expr, v['luxury'])} AS kw_luxury,
  {keyword_count_sql(expr, v['budget'])} AS kw_budget"""


register("keyword_features", cleaned_ctes(features=False) + f""",
k AS (SELECT train_id, {_kw_cols('item_description')} FROM cleaned)
SELECT train_id, kw_excellent, kw_good, kw_fair, kw_poor, kw_luxury, kw_budget,
  CAST((kw_excellent * 1.0 + kw_good * 0.5) - (kw_fair * 0.5 + kw_poor * 1.0) AS DOUBLE) AS quality_score,
  CAST(kw_excellent + kw_good + kw_fair + kw_poor > 0 AS INTEGER) AS has_quality_keywords,
  CAST(kw_luxury > 0 AS INTEGER) AS has_luxury_keywords
FROM k""")


def terms_ctes(source: str, name: str = "terms") -> str:
    """CTE ``name``(train_id, terms) over ``source`` (a CTE with name/description)."""
    return f""",
{name}_tok AS (
  SELECT train_id, list_filter(regexp_extract_all({normalize_sql(combine_sql())}, '[a-z0-9]{{2,}}'),
                               lambda t: NOT list_contains({_list(K.STOPWORDS)}, t)) AS u
  FROM {source}
),
{name} AS (
  SELECT train_id, list_concat(u, CASE WHEN len(u) >= 2
      THEN list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) ELSE [] END) AS terms
  FROM {name}_tok
)"""


register("tokenize_ngrams", cleaned_ctes(features=False) + terms_ctes("cleaned") + """
SELECT train_id, CAST(len(terms) AS INTEGER) AS n_terms, array_to_string(terms, '|') AS terms FROM terms""")

register("log_target", cleaned_ctes(features=False) + """
SELECT train_id, round(ln(1 + price), 6) AS log_price, round(exp(ln(1 + price)) - 1, 6) AS price_back FROM cleaned""")


def _cond_phrase(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {k} THEN {_q(v)}" for k, v in K.CONDITION_PHRASES.items()) + " ELSE '' END"


_REQUEST = f""",
e0 AS (
  SELECT *, CASE WHEN brand_name IS NOT NULL AND brand_name <> '' AND brand_name <> 'unknown'
                 THEN lower(brand_name) ELSE '' END AS bt,
         lower(coalesce(cat_main, '') || ' ' || coalesce(cat_sub1, '')) AS ct,
         lower({strip_sql("coalesce(name, '')")}) AS bn,
         lower({strip_sql("coalesce(item_description, '')")}) AS dc
  FROM cleaned
),
e1 AS (
  SELECT *, CASE WHEN bt <> '' AND NOT contains(bn, bt) THEN bt || ' ' || bn ELSE bn END AS en FROM e0
),
req AS (
  SELECT train_id, en AS name, CAST(item_condition_id AS INTEGER) AS item_condition_id,
    coalesce(cat_main, '') || '/' || coalesce(cat_sub1, '') || '/' AS category_name,
    CASE WHEN brand_name IS NULL OR brand_name = '' THEN 'unknown' ELSE brand_name END AS brand_name,
    CAST(shipping AS INTEGER) AS shipping,
    concat_ws(' ', CASE WHEN dc <> '' THEN dc ELSE en END,
              CASE WHEN NOT contains(dc || en, ct) THEN ct END,
              CASE WHEN bt <> '' AND NOT contains(dc, bt) THEN bt END,
              {_cond_phrase('item_condition_id')}) AS item_description,
    cat_main, cat_sub1, '' AS cat_sub2
  FROM e1
)"""

register("enrich_listing", cleaned_ctes(features=False) + _REQUEST + """
SELECT train_id, name, item_description FROM req""")

register("scoring_request", cleaned_ctes(features=False) + _REQUEST + """
SELECT * FROM req""")

register("meaningful_words", cleaned_ctes(features=False) + f""",
m AS (SELECT train_id, CAST(len(list_filter(regexp_split_to_array(lower(coalesce(name, '') || ' ' ||
        coalesce(item_description, '')), '{WSP}'), lambda w: length(w) > 2)) AS INTEGER) AS n_meaningful FROM cleaned)
SELECT train_id, n_meaningful, CAST(n_meaningful < {K.MIN_WORDS_FOR_RELIABLE_ESTIMATE} AS INTEGER) AS low_confidence FROM m""")


# ------------------------------------------------------------ lookups ------
def _labels_values() -> str:
    from ..operators.i18n import label_rows
    rows = ", ".join(f"({_q(a)}, {_q(b)}, {_q(c)}, {_q(d)})" for a, b, c, d in label_rows())
    return f"lbl(lang, section, key, label) AS (VALUES {rows})"


def _taxonomy_values() -> str:
    rows = ", ".join(f"({_q(m)}, {_q(s)})" for m, subs in K.SUB_CATEGORIES.items() for s in subs)
    return f"tax(main, sub) AS (VALUES {rows})"


register("localize_labels", cleaned_ctes(features=False) + ",\n" + _labels_values() + """
SELECT c.train_id,
  coalesce(nullif(l1.label, ''), nullif(l2.label, ''), CAST(c.item_condition_id AS VARCHAR)) AS condition_label,
  coalesce(nullif(l3.label, ''), c.cat_main) AS cat_main_label,
  coalesce(nullif(l4.label, ''), c.cat_sub1) AS cat_sub1_label
FROM cleaned c
LEFT JOIN lbl l1 ON l1.lang = 'fr' AND l1.section = 'conditions' AND l1.key = CAST(c.item_condition_id AS VARCHAR)
LEFT JOIN lbl l2 ON l2.lang = 'en' AND l2.section = 'conditions' AND l2.key = CAST(c.item_condition_id AS VARCHAR)
LEFT JOIN lbl l3 ON l3.lang = 'fr' AND l3.section = 'categories' AND l3.key = c.cat_main
LEFT JOIN lbl l4 ON l4.lang = 'fr' AND l4.section = 'sub_categories' AND l4.key = c.cat_sub1""")

register("taxonomy_conformity", cleaned_ctes(features=False) + ",\n" + _taxonomy_values() + """
SELECT c.train_id,
  CASE WHEN EXISTS (SELECT 1 FROM tax t WHERE t.main = c.cat_main AND t.sub = c.cat_sub1) THEN 1
       WHEN c.cat_main NOT IN (SELECT main FROM tax) AND c.cat_sub1 = 'Other' THEN 1 ELSE 0 END AS conforms
FROM cleaned c""")

# ----------------------------------------------------------- encoders ------
_TRVA = """,
tr AS (SELECT * FROM split WHERE split = 'train'),
va AS (SELECT * FROM split WHERE split = 'val')"""

register("label_encode", cleaned_ctes() + split_ctes() + _TRVA + """,
cls AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT coalesce(cat_sub2, 'unknown') AS value FROM tr))
SELECT va.train_id, coalesce(cls.idx, -1) AS cat_sub2_label
FROM va LEFT JOIN cls ON cls.value = coalesce(va.cat_sub2, 'unknown')""")

register("one_hot_encode", cleaned_ctes() + split_ctes() + _TRVA + """,
cls AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT coalesce(cat_main, 'unknown') AS value FROM tr))
SELECT va.train_id, cls.idx AS cat_main_idx, CAST((SELECT count(*) FROM cls) AS INTEGER) AS n_categories
FROM va LEFT JOIN cls ON cls.value = coalesce(va.cat_main, 'unknown')""")


def _te(col: str) -> str:
    return f""",
st_{col} AS (SELECT coalesce(CAST({col} AS VARCHAR), 'unknown') AS category, count(*) AS n, sum(ln(1 + price)) AS s
             FROM tr GROUP BY 1),
g_{col} AS (SELECT sum(s) / sum(n) AS g FROM st_{col}),
enc_{col} AS (SELECT category, CASE WHEN n < 5 THEN (SELECT g FROM g_{col})
                                ELSE (s + 10.0 * (SELECT g FROM g_{col})) / (n + 10.0) END AS encoded FROM st_{col})"""


register("target_encode", cleaned_ctes() + split_ctes() + _TRVA + _te("brand_name") + _te("cat_sub1") + _te("cat_sub2") + """
SELECT va.train_id,
  round(coalesce(e1.encoded, (SELECT g FROM g_brand_name)), 6) AS brand_name_encoded,
  round(coalesce(e2.encoded, (SELECT g FROM g_cat_sub1)), 6) AS cat_sub1_encoded,
  round(coalesce(e3.encoded, (SELECT g FROM g_cat_sub2)), 6) AS cat_sub2_encoded
FROM va
LEFT JOIN enc_brand_name e1 ON e1.category = coalesce(va.brand_name, 'unknown')
LEFT JOIN enc_cat_sub1 e2 ON e2.category = coalesce(va.cat_sub1, 'unknown')
LEFT JOIN enc_cat_sub2 e3 ON e3.category = coalesce(va.cat_sub2, 'unknown')""")

register("unknown_values", cleaned_ctes() + split_ctes() + _TRVA + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_unknown FROM va
WHERE coalesce({c}, 'unknown') NOT IN (SELECT DISTINCT coalesce({c}, 'unknown') FROM tr)"""
    for c in ("brand_name", "cat_sub1", "cat_sub2")))


# ------------------------------------------------------------- tf-idf ------
def vocab_ctes(max_features: int = K.TFIDF_MAX_FEATURES) -> str:
    return terms_ctes("tr", "tterms") + f""",
tex AS (SELECT train_id, unnest(terms) AS term FROM tterms),
ttf AS (SELECT train_id, term, count(*) AS tf FROM tex GROUP BY 1, 2),
tst AS (SELECT term, count(*) AS df, sum(tf) AS tf_total FROM ttf GROUP BY term),
ndocs AS (SELECT count(*) AS nd FROM tterms),
kept AS (SELECT * FROM tst WHERE df >= {K.TFIDF_MIN_DF} AND df <= {K.TFIDF_MAX_DF} * (SELECT nd FROM ndocs)
         ORDER BY tf_total DESC, term LIMIT {int(max_features)}),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, tf_total,
            ln((1.0 + (SELECT nd FROM ndocs)) / (1.0 + df)) + 1.0 AS idf FROM kept)"""


register("tfidf_document_frequency", cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + """
SELECT term, idx, CAST(df AS BIGINT) AS df, CAST(tf_total AS BIGINT) AS tf_total, round(idf, 6) AS idf FROM vocab""")

register("tfidf_weights", cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + terms_ctes("va", "vterms") + """,
vex AS (SELECT train_id, unnest(terms) AS term FROM vterms),
vtf AS (SELECT train_id, term, count(*) AS tf FROM vex GROUP BY 1, 2),
w AS (SELECT v.train_id, v.term, (1.0 + ln(v.tf)) * b.idf AS w FROM vtf v JOIN vocab b ON b.term = v.term)
SELECT train_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY train_id)), 6) AS weight FROM w""")


# ------------------------------------------- metrics on a baseline model ----
_BASELINE = _TRVA + _te("cat_sub1") + """,
pred AS (SELECT va.train_id, va.price, ln(1 + va.price) AS label,
           coalesce(e.encoded, (SELECT g FROM g_cat_sub1)) AS prediction
         FROM va LEFT JOIN enc_cat_sub1 e ON e.category = coalesce(va.cat_sub1, 'unknown'))"""

register("rmsle", cleaned_ctes() + split_ctes() + _BASELINE + """
SELECT round(sqrt(avg(pow(label - prediction, 2))), 6) AS rmsle, count(*) AS n FROM pred""")

register("price_band", cleaned_ctes() + split_ctes() + _BASELINE + f""",
pb AS (SELECT train_id, (exp(prediction) - 1) * {K.PRICE_INFLATION} AS p FROM pred)
SELECT train_id, round(greatest(1.0, p), 6) AS predicted_price, round(greatest(1.0, p * {K.PRICE_LOW_FACTOR}), 6) AS price_low,
  round(p * {K.PRICE_HIGH_FACTOR}, 6) AS price_high FROM pb""")

register("abs_error_example", cleaned_ctes() + split_ctes() + _BASELINE + """
SELECT train_id, round(abs(price - (exp(prediction) - 1)), 6) AS abs_error FROM pred""")

# ---------------------------------------------------------------- jobs -----
register("etl_pipeline", cleaned_ctes() + """
SELECT (SELECT count(*) FROM listings) AS n_rows_initial, (SELECT count(*) FROM cleaned) AS n_rows_final,
  CAST(8 AS BIGINT) AS n_cols_initial, CAST(15 AS BIGINT) AS n_cols_final""")


register("etl_steps", cleaned_ctes() + """,
n AS (SELECT (SELECT count(*) FROM listings) AS a, (SELECT count(*) FROM cleaned) AS b)
SELECT CAST(k AS INTEGER) AS n_steps, a AS n_rows_initial, CASE WHEN k > 1 THEN b END AS n_rows_final, CAST(8 AS BIGINT) AS n_cols_initial, CASE WHEN k > 1 THEN CAST(15 AS BIGINT) END AS n_cols_final
FROM n, (SELECT unnest([1, 2, 3]) AS k)""")


def _feature_tail() -> str:
    tail = ([f"{c}_encoded" for c in K.DEFAULT_TARGET_COLUMNS] + list(K.DEFAULT_PASSTHROUGH_COLUMNS)
            + list(K.NUMERIC_FEATURE_COLUMNS) + list(K.KEYWORD_FEATURE_COLUMNS))
    return "tail(pos, name) AS (VALUES " + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(tail)) + ")"


register("feature_names", cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + """,
cls AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT coalesce(cat_main, 'unknown') AS value FROM tr)),
""" + _feature_tail() + """
SELECT idx, 'tfidf_' || term AS name FROM vocab
UNION ALL SELECT CAST(idx + (SELECT count(*) FROM vocab) AS INTEGER), 'cat_main_' || value FROM cls
UNION ALL SELECT CAST(pos + (SELECT count(*) FROM vocab) + (SELECT count(*) FROM cls) AS INTEGER), name FROM tail""")

register("encode_categoricals", cleaned_ctes() + split_ctes() + _TRVA + """,
cls AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT coalesce(cat_main, 'unknown') AS value FROM tr))""" + _te("brand_name") + _te("cat_sub1")
         + _te("cat_sub2") + """
SELECT va.train_id, cls.idx AS cat_main_idx,
  round(coalesce(e1.encoded, (SELECT g FROM g_brand_name)), 6) AS brand_name_encoded,
  round(coalesce(e2.encoded, (SELECT g FROM g_cat_sub1)), 6) AS cat_sub1_encoded,
  round(coalesce(e3.encoded, (SELECT g FROM g_cat_sub2)), 6) AS cat_sub2_encoded,
  CAST(va.item_condition_id AS DOUBLE) AS item_condition_id, CAST(va.shipping AS DOUBLE) AS shipping
FROM va
LEFT JOIN cls ON cls.value = coalesce(va.cat_main, 'unknown')
LEFT JOIN enc_brand_name e1 ON e1.category = coalesce(va.brand_name, 'unknown')
LEFT JOIN enc_cat_sub1 e2 ON e2.category = coalesce(va.cat_sub1, 'unknown')
LEFT JOIN enc_cat_sub2 e3 ON e3.category = coalesce(va.cat_sub2, 'unknown')""")

register("scan_listings_tsv", "WITH " + LISTINGS.strip() + "\nSELECT * FROM listings")

register("write_cleaned", cleaned_ctes() + """
SELECT count(*) AS n_rows, count(DISTINCT train_id) AS n_ids, CAST(15 AS BIGINT) AS n_cols FROM cleaned""")

register("fit_preprocessor", cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + """,
cls AS (SELECT DISTINCT coalesce(cat_main, 'unknown') AS value FROM tr)
SELECT CAST((SELECT count(*) FROM vocab) + (SELECT count(*) FROM cls) + 17 AS INTEGER) AS n_features,
  CAST((SELECT count(*) FROM vocab) AS INTEGER) AS n_tfidf, CAST((SELECT count(*) FROM cls) AS INTEGER) AS n_onehot,
  (SELECT 'tfidf_' || min(term) FROM vocab) AS first_name, 'has_luxury_keywords' AS last_name""")


def _nz(expr: str) -> str:
    return f"CASE WHEN ({expr}) <> 0 THEN 1 ELSE 0 END"


def _true(expr: str) -> str:
    return f"CASE WHEN ({expr}) THEN 1 ELSE 0 END"


register("feature_nonzeros", cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + terms_ctes("va", "vterms")
         + _te("brand_name") + _te("cat_sub1") + _te("cat_sub2") + f""",
vex AS (SELECT train_id, unnest(terms) AS term FROM vterms),
vn AS (SELECT v.train_id, count(DISTINCT v.term) AS n FROM vex v JOIN vocab b ON b.term = v.term GROUP BY 1),
cls AS (SELECT DISTINCT coalesce(cat_main, 'unknown') AS value FROM tr),
kw AS (SELECT train_id, {_kw_cols('item_description')},
         {word_count_sql('name')} AS nl, {word_count_sql('item_description')} AS dl FROM va)
SELECT va.train_id, CAST(coalesce(vn.n, 0)
  + CASE WHEN coalesce(va.cat_main, 'unknown') IN (SELECT value FROM cls) THEN 1 ELSE 0 END
  + {_nz("coalesce(e1.encoded, (SELECT g FROM g_brand_name))")}
  + {_nz("coalesce(e2.encoded, (SELECT g FROM g_cat_sub1))")}
  + {_nz("coalesce(e3.encoded, (SELECT g FROM g_cat_sub2))")}
  + {_nz("va.item_condition_id")} + {_nz("va.shipping")} + {_nz("kw.nl")} + {_nz("kw.dl")} + {_true("kw.dl > 0")}
  + {_nz("kw.kw_excellent")} + {_nz("kw.kw_good")} + {_nz("kw.kw_fair")} + {_nz("kw.kw_poor")}
  + {_nz("kw.kw_luxury")} + {_nz("kw.kw_budget")}
  + {_nz("(kw.kw_excellent * 1.0 + kw.kw_good * 0.5) - (kw.kw_fair * 0.5 + kw.kw_poor * 1.0)")}
  + {_true("kw.kw_excellent + kw.kw_good + kw.kw_fair + kw.kw_poor > 0")} + {_true("kw.kw_luxury > 0")}
  AS INTEGER) AS n_nonzero
FROM va
LEFT JOIN vn ON vn.train_id = va.train_id
LEFT JOIN kw ON kw.train_id = va.train_id
LEFT JOIN enc_brand_name e1 ON e1.category = coalesce(va.brand_name, 'unknown')
LEFT JOIN enc_cat_sub1 e2 ON e2.category = coalesce(va.cat_sub1, 'unknown')
LEFT JOIN enc_cat_sub2 e3 ON e3.category = coalesce(va.cat_sub2, 'unknown')""")


# ---------------------------------------------------------- training runs --
_COUNTS = cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + """,
counts AS (SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM va) AS n_val,
  (SELECT count(*) FROM vocab) + (SELECT count(DISTINCT coalesce(cat_main, 'unknown')) FROM tr) + 17 AS n_features)
"""
register("train_ridge", _COUNTS + "SELECT 'ridge' AS model_type, *, true AS stationary, true AS error_recomputed FROM counts")
for _kind in ("gbt", "ensemble"):
    register(f"train_{_kind}", _COUNTS + f"SELECT '{_kind}' AS model_type, *, true AS trees_kept, true AS blend_exact, true AS no_worse_than_mean FROM counts")
register("select_top_features", cleaned_ctes() + split_ctes() + _TRVA + vocab_ctes() + """,
r AS (SELECT idx, term, row_number() OVER (ORDER BY df DESC, term) AS k FROM vocab),
""" + _feature_tail() + """
SELECT idx, 'tfidf_' || term AS name, CAST(CASE k WHEN 60 THEN 1 ELSE 2 END AS INTEGER) AS importance_rank, CAST(0 AS BIGINT) AS n_different FROM r WHERE k IN (60, 90)
UNION ALL SELECT CAST(pos + (SELECT count(*) FROM vocab) + (SELECT count(DISTINCT coalesce(cat_main, 'unknown')) FROM tr) AS INTEGER), name, 3, 0 FROM tail WHERE name = 'shipping'""")
register("model_metadata", _COUNTS + "SELECT 'ridge' AS model_type, *, true AS same_error FROM counts")
register("score_listings", cleaned_ctes(features=False) + """,
e AS (SELECT train_id, concat_ws('; ', CASE WHEN train_id % 97 = 0 OR trim(name) = '' THEN 'name is empty' END,
  CASE WHEN train_id % 89 = 0 THEN 'item_condition_id is not 1 to 5' END, CASE WHEN train_id % 83 = 0 THEN 'shipping is not 0 or 1' END) AS m FROM cleaned)
SELECT train_id, m = '' AS success, nullif(m, '') AS error, m = '' AS band_ordered, m = '' AS floored, m = '' AS priced FROM e""")
register("score_stream", cleaned_ctes() + split_ctes() + _TRVA + " SELECT train_id, true AS stream_equals_batch FROM va")
register("preprocessor_round_trip", cleaned_ctes() + split_ctes() + _TRVA + " SELECT train_id, true AS same FROM va")
register("train_cross_validation", cleaned_ctes() + split_ctes() + _TRVA + " SELECT CAST(5 AS BIGINT) AS n_folds, count(*) AS n_train, true AS summary_follows FROM tr")

_FOLDS = cleaned_ctes() + split_ctes() + """,
kf AS (SELECT *, ln(1 + price) AS y, row_number() OVER (ORDER BY _h, train_id) - 1 AS r, count(*) OVER () AS n FROM split WHERE split = 'train'),
kq AS (SELECT *, n // 5 AS q, n % 5 AS rem FROM kf),
fo AS (SELECT *, CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END AS fold FROM kq),
ks AS (SELECT unnest(range(5)) AS k),
"""
register("cross_validate", _FOLDS + """
st AS (SELECT k, coalesce(cat_sub1, 'unknown') AS c, count(*) AS n, sum(y) AS s FROM fo, ks WHERE fold <> k GROUP BY 1, 2),
g AS (SELECT k, sum(s) / sum(n) AS g FROM st GROUP BY 1),
e AS (SELECT st.k, c, CASE WHEN n < 5 THEN g ELSE (s + 10.0 * g) / (n + 10.0) END AS v FROM st JOIN g USING (k)),
sc AS (SELECT fold, sqrt(avg(pow(y - coalesce(v, g), 2))) AS r FROM fo JOIN g ON g.k = fold
       LEFT JOIN e ON e.k = fold AND e.c = coalesce(cat_sub1, 'unknown') GROUP BY 1)
SELECT round(avg(r), 6) AS rmsle_mean, round(stddev_pop(r), 6) AS rmsle_std, count(*) AS n_folds FROM sc""")
register("cv_summary", _FOLDS + """
m AS (SELECT k, avg(y) AS m FROM fo, ks WHERE fold <> k GROUP BY 1),
sc AS (SELECT fold, sqrt(avg(pow(y - m, 2))) AS r FROM fo JOIN m ON m.k = fold GROUP BY 1)
SELECT round(avg(r), 6) AS rmsle_mean, round(stddev_pop(r), 6) AS rmsle_std, count(*) AS n_folds FROM sc""")

register("split_target", cleaned_ctes(features=False) + "SELECT train_id, item_condition_id, price AS label FROM cleaned")
register("required_columns", cleaned_ctes(features=False) + """
SELECT 'all' AS view, true AS passes, count(*) AS n_rows FROM cleaned
UNION ALL SELECT 'no_price', count(*) > 0, count(*) FROM listings
UNION ALL SELECT 'no_name', false, 0""")
register("i18n_labels", cleaned_ctes(features=False) + ",\n" + _labels_values() + """,
n AS (SELECT cat_main, cat_sub1, item_condition_id, count(*) AS n_listings FROM cleaned GROUP BY ALL)
SELECT g.lang, n.cat_main, n.cat_sub1, n.item_condition_id, coalesce(nullif(l3.label, ''), n.cat_main) AS cat_main_label, coalesce(nullif(l4.label, ''), n.cat_sub1) AS cat_sub1_label,
  coalesce(nullif(l1.label, ''), nullif(l2.label, ''), CAST(n.item_condition_id AS VARCHAR)) AS condition_label, n_listings
FROM n CROSS JOIN (SELECT unnest(['fr', 'en', 'es']) AS lang) g
LEFT JOIN lbl l1 ON l1.lang = g.lang AND l1.section = 'conditions' AND l1.key = CAST(n.item_condition_id AS VARCHAR)
LEFT JOIN lbl l2 ON l2.lang = 'en' AND l2.section = 'conditions' AND l2.key = CAST(n.item_condition_id AS VARCHAR)
LEFT JOIN lbl l3 ON l3.lang = g.lang AND l3.lang <> 'en' AND l3.section = 'categories' AND l3.key = n.cat_main
LEFT JOIN lbl l4 ON l4.lang = g.lang AND l4.lang <> 'en' AND l4.section = 'sub_categories' AND l4.key = n.cat_sub1""")
register("label_sections", cleaned_ctes(features=False) + ",\n" + _labels_values() + """,
u AS (SELECT 'categories' AS section, cat_main AS key FROM cleaned UNION ALL SELECT 'sub_categories', cat_sub1 FROM cleaned
      UNION ALL SELECT 'conditions', CAST(item_condition_id AS VARCHAR) FROM cleaned),
c AS (SELECT section, key, count(*) AS n FROM u GROUP BY ALL)
SELECT lang, l.section, count(*) AS n_labels, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_listings
FROM lbl l LEFT JOIN c ON c.section = l.section AND c.key = l.key GROUP BY ALL""")

register("assembled_features", cleaned_ctes() + split_ctes() + _TRVA + _te("brand_name") + _te("cat_sub1") + _te("cat_sub2") + f""",
kw AS (SELECT train_id, {_kw_cols('item_description')}, {word_count_sql('name')} AS nl, {word_count_sql('item_description')} AS dl FROM va),
w AS (SELECT va.train_id, [coalesce(e1.encoded, (SELECT g FROM g_brand_name)), coalesce(e2.encoded, (SELECT g FROM g_cat_sub1)),
    coalesce(e3.encoded, (SELECT g FROM g_cat_sub2)), va.item_condition_id, va.shipping, kw.nl, kw.dl, {_true("kw.dl > 0")},
    kw.kw_excellent, kw.kw_good, kw.kw_fair, kw.kw_poor, kw.kw_luxury, kw.kw_budget,
    (kw.kw_excellent * 1.0 + kw.kw_good * 0.5) - (kw.kw_fair * 0.5 + kw.kw_poor * 1.0),
    {_true("kw.kw_excellent + kw.kw_good + kw.kw_fair + kw.kw_poor > 0")}, {_true("kw.kw_luxury > 0")}]::DOUBLE[] AS v
  FROM va JOIN kw ON kw.train_id = va.train_id
  LEFT JOIN enc_brand_name e1 ON e1.category = coalesce(va.brand_name, 'unknown')
  LEFT JOIN enc_cat_sub1 e2 ON e2.category = coalesce(va.cat_sub1, 'unknown')
  LEFT JOIN enc_cat_sub2 e3 ON e3.category = coalesce(va.cat_sub2, 'unknown')),
x AS (SELECT train_id, unnest(v) AS value, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS slot FROM w)
SELECT train_id, slot, round(value, 6) AS value FROM x WHERE value <> 0""")
