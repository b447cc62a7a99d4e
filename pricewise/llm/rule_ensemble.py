"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are DataFrame expressions. A random forest is
fitted on a bounded sample of labelled rows (``SAMPLE``); every path from a
root to a node becomes a conjunctive rule. A logistic regression with a lasso
penalty gives most rules weight zero. What is left is compiled into one column
expression: a weighted sum of conditions, put through the logistic function.

Scores depend on the text only. Null counts as empty text; empty texts get a
score like any other. Repeated labels of a document count once (the smallest);
labels without a document are ignored. Without labels of both kinds the score
is the share of label 1, or 0.5 without any. An empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewise.llm.common import read, written
from pricewise.llm.quality_rules import measured

#: Most labelled rows that the model is fitted on, chosen by a hash of the id.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.002
FOLDS, THRESHOLD = 5, 0.3


def fold(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


STATISTICS = ("words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "shout_share", "upper_share", "digit_share", "distinct_share", "stop_share", "words_per_line")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the struct ``__s`` of statistics; shares lie in 0 to 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = measured(df.withColumn("__u", F.regexp_count(t, F.lit("[A-Z]"))).withColumn("__d", F.regexp_count(t, F.lit("[0-9]")))
                  .withColumn("__p", F.regexp_count(t, F.lit("[.,;:!?]"))).withColumn("__c", _distinct(text)), text)
    m = lambda name: F.col(f"__m.{name}").cast("double")
    n, chars, lines = F.greatest(m("n_words"), F.lit(1.0)), F.greatest(m("word_chars"), F.lit(1.0)), F.greatest(m("n_lines"), F.lit(1.0))
    values = (m("n_words"), m("word_chars") / n, F.least(m("n_symbols") / n, F.lit(1.0)), m("n_dup_lines") / lines, m("n_repeat_words") / n, m("n_shouted") / n,
              F.col("__u") / chars, F.col("__d") / chars, F.col("__c") / n, F.col("__p") / chars, n / lines)
    return df.withColumn("__s", F.struct(*[v.cast("double").alias(s) for v, s in zip(values, STATISTICS, strict=True)])).drop("__m", "__u", "__d", "__p", "__c")


def _distinct(text: str) -> Column:
    from pricewise.llm.common import sql_words
    return F.size(F.array_distinct(sql_words(F.col(text))))


Rule = tuple[tuple[int, bool, float], ...]


def paths(model) -> list[Rule]:
    """Conditions (statistic, whether at most, threshold) of every path from a root."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict) -> None:
        if path:
            found[tuple(sorted((f, low, t) for (f, low), t in path.items()))] = None
        if node.subtreeDepth() == 0:
            return
        f, t = node.split().featureIndex(), node.split().threshold()
        for low, child in ((True, node.leftChild()), (False, node.rightChild())):
            old = path.get((f, low))
            walk(child, path | {(f, low): t if old is None else min(old, t) if low else max(old, t)})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def condition(rule: Rule, s: str = "__s") -> Column:
    out = F.lit(True)
    for f, low, t in rule:
        c = F.col(f"{s}.{STATISTICS[f]}")
        out = out & (c <= t if low else c > t)
    return out


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, s: str = "__s") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, s), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame, seed: int = 11) -> RuleEnsemble:
    """From (``__s``, ``label`` 0/1)."""
    data = written(labelled.select(array_to_vector(F.array(*[F.col(f"__s.{x}") for x in STATISTICS])).alias("features"), "__s", F.col("label").cast("double").alias("label")), "labelled")
    n, ones = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        import math
        p = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleEnsemble([], math.log(p / (1 - p)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.6", minInstancesPerNode=max(2, int(n) // 500), seed=seed).fit(data)
    rules = paths(forest)
    bits = data.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"))
    bits = written(bits, "rule-bits")
    line = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=200, tol=1e-6).fit(bits)
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, line.coefficients.toArray(), strict=True) if w], float(line.intercept))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled rows outside the held-out fold, with statistics."""
    one = labels.filter(F.col(label).isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.min(label).alias("label"))
    some = one.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).drop("h")
    return with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, read(spark, sf_dir, "labels"), "quality"))
    scored = with_statistics(docs).withColumn("score", model.score())
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
