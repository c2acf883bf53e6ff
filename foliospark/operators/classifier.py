"""The trained stage of classification: character and word n-grams, inverse document frequencies, logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def input_text(tokens: Column, text: Column, most: int = 4000) -> Column:
    """Context tokens and the text with single spaces."""
    return F.substring(F.concat_ws(" ", F.array_join(tokens, " "), F.regexp_replace(text, r"\s+", " ")), 1, most)


def with_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """Weights that balance the classes."""
    counts = samples.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return samples.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def pipeline(features: int = 1 << 16) -> Pipeline:
    """Words, word pairs and character 3-grams."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", minTokenLength=1)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    chars = RegexTokenizer(inputCol="text", outputCol="chars", pattern=r"(?=(.))", gaps=True, minTokenLength=1)
    triples = NGram(n=3, inputCol="chars", outputCol="triples")
    tf = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features) for c in ("words", "pairs", "triples")]
    idf = [IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf", minDocFreq=2) for c in ("words", "pairs", "triples")]
    join = VectorAssembler(inputCols=["words_idf", "pairs_idf", "triples_idf"], outputCol="features")
    return Pipeline(stages=[words, pairs, chars, triples, *tf, *idf, join, StringIndexer(inputCol="label", outputCol="target", handleInvalid="skip"), LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", regParam=0.01, maxIter=30)])


def fitted(samples: DataFrame, features: int = 1 << 16) -> PipelineModel:
    """``pipeline`` fitted on weighted samples, whose texts are read once: their term frequencies are kept in the shared folder,
    as each document frequency and each sum over the samples would count the n-grams anew."""
    stages = pipeline(features).getStages()
    counting = PipelineModel([s for s in stages if isinstance(s, Transformer) and not isinstance(s, VectorAssembler)])
    counted = written(counting.transform(samples).select("label", "weight", *(s.getOutputCol() for s in stages if isinstance(s, HashingTF))), "frequencies")
    rest = Pipeline(stages=stages[len(counting.stages) :]).fit(counted)
    return PipelineModel(counting.stages + rest.stages)


def macro_f1(predicted: DataFrame) -> float:
    """Mean F1 of the classes."""
    hit = F.count_if(F.col("target") == F.col("prediction"))
    by = predicted.groupBy("target").agg(F.count("*").alias("n"), hit.alias("tp")).join(predicted.groupBy(F.col("prediction").alias("target")).agg(F.count("*").alias("p")), "target", "left")
    return by.agg(F.avg(2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0))))).first()[0] or 0.0


def train(samples: DataFrame, folds: int = 3) -> tuple[PipelineModel, float]:
    """``samples`` (id, text, label) to a model and its cross-validated macro F1."""
    dealt = with_weights(samples).withColumn("__fold", F.pmod(F.xxhash64("id"), F.lit(folds)))
    scores = [macro_f1(fitted(dealt.where(F.col("__fold") != k)).transform(dealt.where(F.col("__fold") == k))) for k in range(folds)]
    return fitted(dealt), sum(scores) / folds


def may_activate(new: float, active: float | None, tolerance: float = 0.02) -> bool:
    """E22."""
    return active is None or new >= active - tolerance


def predict(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """Top label, its probability, the gap to the second and the five best labels."""
    labels = model.stages[-2].labels
    from pyspark.ml.functions import vector_to_array

    names = F.array(*map(F.lit, labels))
    ranked = F.reverse(F.array_sort(F.transform(F.arrays_zip(vector_to_array("probability").alias("p"), names.alias("label")), lambda x: F.struct(x["p"].alias("p"), x["label"].alias("label")))))
    scored = model.transform(docs.withColumns({"label": F.lit(labels[0]), "weight": F.lit(1.0)})).withColumn("best", F.slice(ranked, 1, 5))
    return scored.select(*docs.columns, F.col("best")[0]["label"].alias("top"), F.col("best")[0]["p"].alias("p"), (F.col("best")[0]["p"] - F.coalesce(F.try_element_at("best", F.lit(2))["p"], F.lit(0.0))).alias("gap"), "best")


def synthetic(templates: dict[str, list[str]], words: dict[str, list[str]], variants: int, seed: int) -> list[tuple[str, str, str]]:
    """Samples (id, text, label) from templates, the same for the same seed."""
    import random

    rng = random.Random(seed)
    return [(f"{label}-{k}-{n}", t.format(**{w: rng.choice(v) for w, v in words.items()}), label) for label, ts in sorted(templates.items()) for k, t in enumerate(ts) for n in range(variants)]
