"""Fixed values that must equal the reference behaviour for identical results.

Everything in the block below is data, not logic: keyword lists, stop words,
condition phrases, the category taxonomy, default parameters. They are kept
in their natural order and spelled out as text so they can be read and
checked against the behaviour they reproduce.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (must match the reference's results)
# --------------------------------------------------------------------------

DEFAULT_MIN_PRICE = 1.0
DEFAULT_MAX_PRICE = 2000.0
UNKNOWN = "unknown"
NO_DESCRIPTION = "No description yet"
RM_TOKEN = "[rm]"
TOP_BRANDS_N = 100

QUALITY_KEYWORDS = {
    "excellent": ["new", "brand new", "bnwt", "bnib", "nwt", "nib", "mint",
                  "perfect", "excellent", "pristine", "unworn", "unused"],
    "good": ["good", "great", "nice", "clean", "gently used", "like new",
             "barely used", "lightly used", "worn once", "used once"],
    "fair": ["fair", "okay", "ok", "decent", "average", "normal wear",
             "some wear", "minor", "small"],
    "poor": ["worn", "used", "damaged", "broken", "stain", "stained",
             "hole", "tear", "rip", "flaw", "defect", "scratch", "scratched",
             "crack", "cracked", "missing"],
}

VALUE_KEYWORDS = {
    "luxury": ["authentic", "genuine", "real", "original", "designer",
               "luxury", "premium", "rare", "limited edition", "vintage",
               "collector", "exclusive"],
    "budget": ["cheap", "budget", "affordable", "bargain", "deal",
               "discount", "sale", "clearance", "bundle", "lot"],
}

STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "my", "your", "his", "her", "its", "our", "their", "me", "him", "us",
    "them", "what", "which", "who", "whom", "when", "where", "why", "how",
    "all", "each", "every", "both", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "just", "also", "now", "here", "there", "then", "once", "if",
]

# Phrases appended to a scoring request's description, by condition id.
CONDITION_PHRASES = {
    1: "brand new with tags nwt unused sealed",
    2: "brand new without tags nwot unused mint condition",
    3: "excellent condition like new barely used",
    4: "good condition gently used minor wear",
    5: "fair condition used visible wear",
}

MIN_WORDS_FOR_RELIABLE_ESTIMATE = 8
PRICE_INFLATION = 1.30
PRICE_LOW_FACTOR = 0.65
PRICE_HIGH_FACTOR = 1.55

MAIN_CATEGORIES = ["Women", "Men", "Beauty", "Electronics", "Kids", "Home",
                   "Sports & Outdoors", "Handmade", "Vintage & Collectibles", "Other"]

SUB_CATEGORIES = {
    "Women": ["Tops & Blouses", "Dresses", "Jeans", "Shoes", "Bags & Purses", "Jewelry",
              "Accessories", "Athletic Apparel", "Coats & Jackets", "Other"],
    "Men": ["Tops", "Shirts", "Jeans", "Shoes", "Accessories", "Coats & Jackets",
            "Athletic Apparel", "Suits", "Other"],
    "Beauty": ["Makeup", "Skin Care", "Hair Care", "Fragrance", "Tools & Accessories",
               "Bath & Body", "Nails", "Other"],
    "Electronics": ["Cell Phones & Accessories", "Computers & Tablets", "Video Games & Consoles",
                    "Cameras & Photography", "TV & Audio", "Other"],
    "Kids": ["Toys", "Girls Clothing", "Boys Clothing", "Baby Gear", "Shoes", "Other"],
    "Home": ["Kitchen & Dining", "Bedding", "Bath", "Home Décor", "Furniture", "Storage", "Other"],
    "Sports & Outdoors": ["Exercise & Fitness", "Outdoor Recreation", "Sports", "Cycling", "Other"],
    "Handmade": ["Art", "Jewelry", "Knitting", "Bags & Purses", "Other"],
    "Vintage & Collectibles": ["Antiques", "Collectibles", "Art", "Other"],
    "Other": ["Other"],
}
TAXONOMY_FALLBACK = ["Other"]

# Default feature strategy of the preprocessor.
DEFAULT_ONEHOT_COLUMNS = ["cat_main"]
DEFAULT_TARGET_COLUMNS = ["brand_name", "cat_sub1", "cat_sub2"]
DEFAULT_PASSTHROUGH_COLUMNS = ["item_condition_id", "shipping"]
REQUIRED_COLUMNS = ["name", "item_description", "item_condition_id",
                    "category_name", "brand_name", "shipping"]
CATEGORY_STATS_COLUMNS = ["cat_main", "cat_sub1", "cat_sub2", "brand_name",
                          "item_condition_id", "shipping"]
KEYWORD_FEATURE_COLUMNS = ["kw_excellent", "kw_good", "kw_fair", "kw_poor",
                           "kw_luxury", "kw_budget", "quality_score",
                           "has_quality_keywords", "has_luxury_keywords"]
NUMERIC_FEATURE_COLUMNS = ["name_len", "desc_len", "has_description"]

# Encoders / vectoriser / models.
TARGET_SMOOTHING = 10.0
TARGET_MIN_SAMPLES = 5
TFIDF_MAX_FEATURES = 10000
TFIDF_MIN_DF = 5
TFIDF_MAX_DF = 0.95
RIDGE_ALPHA = 1.0
GBT_PARAMS = {
    "n_estimators": 1000,
    "learning_rate": 0.07,
    "max_depth": 8,
    "num_leaves": 127,
    "min_child_samples": 30,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "random_state": 42,
}
EARLY_STOPPING_ROUNDS = 50
ENSEMBLE_WEIGHTS = (0.3, 0.7)
SPLIT_TEST_SIZE = 0.2
SPLIT_SEED = 42
SAMPLE_SIZE = 10000
CV_FOLDS = 5
TOP_N_FEATURES = 1000

# Tokens the reference's TSV reader treats as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]

# --------------------------------------------------------------------------
# Engine-side patterns (ours, not the reference's)
# --------------------------------------------------------------------------

# Unicode whitespace as Python's str.isspace() sees it, for DuckDB/RE2 (used only
# in oracle SQL).
RE2_WS = ("[\\s\\x1c-\\x1f\\x0b\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}"
          "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
