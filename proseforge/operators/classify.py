"""Binary text classification and its reports.

The classifier is count-based (naive Bayes) or linear (Spark ML); its scores
are not comparable with those of a neural model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseforge.functions import prompts as P
from proseforge.functions.text import tokens
from proseforge.operators.sampling import balanced
from proseforge.session import cut_lineage


MAX_BROADCAST_WEIGHTS = 1_000_000


def train_naive_bayes(df: DataFrame, text: str, label: str, counts: bool = False) -> DataFrame:
    """(token, weight): log-odds of label 1, with Laplace smoothing.

    Every token of the training texts is a feature.  The row with a null
    token is the log prior.  With ``counts``, ``n`` tells how often a token occurs.
    """
    more = ["n"] if counts else []
    words = df.select(F.explode(tokens(F.col(text))).alias("token"), F.col(label).alias("y"))
    n1, n0 = F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.sum(F.when(F.col("y") == 1, 0).otherwise(1))
    seen = words.groupBy("token").agg(n1.alias("n1"), n0.alias("n0")).withColumn("n", F.col("n1") + F.col("n0"))
    totals = seen.agg(
        F.struct(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count(F.lit(1)).alias("v")).alias("t")
    ).scalar()
    weighted = seen.select(
        "token",
        (
            F.log((F.col("n1") + 1.0) / (totals["t1"] + totals["v"]))
            - F.log((F.col("n0") + 1.0) / (totals["t0"] + totals["v"]))
        ).alias("weight"),
        *more,
    )
    prior = df.agg(
        (F.log(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)) + 1.0)
         - F.log(F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)) + 1.0)).alias("weight")
    ).select(F.lit(None).cast("string").alias("token"), "weight", *[F.lit(None).cast("long").alias(c) for c in more])
    return weighted.unionByName(prior)


def score_naive_bayes(df: DataFrame, keys: Sequence[str], text: str, model: DataFrame, out: str = "score") -> DataFrame:
    """(keys, out): summed log-odds of label 1 for each row's whole text.

    Tokens do not travel: a model of up to ``MAX_BROADCAST_WEIGHTS`` tokens is broadcast.  Of a larger one that
    has counts, the most frequent ones are, and only tokens that are none of them meet the others in a shuffle; a
    larger one without counts is left to the planner.  Sums are rounded, as their order is not fixed.
    """
    words = df.select(*keys, F.explode_outer(tokens(F.col(text))).alias("token"))
    weights = model.filter(F.col("token").isNotNull())
    prior = model.filter(F.col("token").isNull()).select("weight")
    total = F.sum(F.coalesce("weight", F.lit(0.0))).alias("_sum")
    if weights.count() <= MAX_BROADCAST_WEIGHTS:
        summed = words.join(F.broadcast(weights.select("token", "weight")), "token", "left").groupBy(*keys).agg(total)
    elif "n" not in model.columns:
        summed = words.join(weights, "token", "left").groupBy(*keys).agg(total)
    else:
        # One row per distinct count, so the window is small.
        reach = weights.groupBy("n").agg(F.count(F.lit(1)).alias("_m")).withColumn("_reach", F.sum("_m").over(Window.orderBy(F.desc("n"))))
        least = reach.filter(F.col("_reach") <= MAX_BROADCAST_WEIGHTS).agg(F.min("n")).first()[0]
        often = F.lit(False) if least is None else F.col("n") >= least
        near, rest = (weights.filter(part).select("token", "weight") for part in (often, ~often))
        known = words.join(F.broadcast(near), "token", "left").groupBy(*keys).agg(total)
        others = words.join(F.broadcast(near.select("token")), "token", "left_anti").join(rest, "token").groupBy(*keys).agg(total)
        summed = known.unionByName(others).groupBy(*keys).agg(F.sum("_sum").alias("_sum"))
    return summed.select(*keys, F.round(F.col("_sum") + prior.scalar(), 6).alias(out))


def predicted(score: Column) -> Column:
    return F.when(score > 0, 1).otherwise(0)


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def report(df: DataFrame, label: str, pred: str, names: dict[int, str]) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages.

    Undefined ratios count as 0, and a class missing from the data is listed.
    """
    # The confusion table has a row per pair of classes; three results are read from it.
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    pairs = cut_lineage(pairs, "confusion")
    classes = list(names)
    sums = pairs.agg(*[
        F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"{kind}{c}")
        for c in classes
        for kind, test in (
            ("hit", (F.col("y") == c) & (F.col("p") == c)),
            ("true", F.col("y") == c),
            ("said", F.col("p") == c),
        )
    ])
    rows = F.array(*[
        F.struct(
            F.lit(names[c]).alias("class"),
            F.col(f"hit{c}").alias("hit"), F.col(f"true{c}").alias("support"), F.col(f"said{c}").alias("said"),
        )
        for c in classes
    ])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class = (
        sums.select(F.inline(rows))
        .withColumn("precision", ratio(F.col("hit").cast("double"), F.col("said").cast("double")))
        .withColumn("recall", ratio(F.col("hit").cast("double"), F.col("support").cast("double")))
        .withColumn("f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select("class", "precision", "recall", "f1", "support")
    )
    scores = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(s) * F.col("support")), F.sum("support").cast("double")).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    return (
        per_class
        .unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def tag(df: DataFrame, keys: Sequence[str], text: str, label: str, model: DataFrame) -> DataFrame:
    """Name both attributes: sentiment from the label, formality from the model."""
    scores = score_naive_bayes(df, keys, text, model)
    return df.join(scores, list(keys)).select(
        *keys,
        text,
        P.sentiment_name(F.col(label)).alias("sentiment"),
        P.formality_name(predicted(F.col("score"))).alias("formality"),
    )


def tag_and_balance(df: DataFrame, keys: Sequence[str], text: str, label: str, model: DataFrame, seed: int) -> DataFrame:
    """Tag the rows, prefix their control prompt and balance the four classes."""
    tagged = cut_lineage(tag(df, keys, text, label, model), "tagged")
    return balanced(tagged, ["sentiment", "formality"], seed, keys)


def train_linear(df: DataFrame, text: str, label: str, features: int = 1 << 18):
    """Hashed TF-IDF and logistic regression as a Spark ML pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    tokens_col, tf, tfidf = "_tokens", "_tf", "_tfidf"
    stages = [
        HashingTF(inputCol=tokens_col, outputCol=tf, numFeatures=features),
        IDF(inputCol=tf, outputCol=tfidf),
        LogisticRegression(featuresCol=tfidf, labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(df.withColumn(tokens_col, tokens(F.col(text))))


def predict_linear(df: DataFrame, text: str, model) -> DataFrame:
    out = model.transform(df.withColumn("_tokens", tokens(F.col(text))))
    return out.withColumn("pred", F.col("prediction").cast("int")).drop(
        "_tokens", "_tf", "_tfidf", "rawPrediction", "probability", "prediction"
    )
