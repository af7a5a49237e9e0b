"""Scores of pairs: a fixed rule, logistic regression and boosted trees of pyspark.ml, averages, and a second stage."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.similarity import unit
from tessella.operators.blocking import PAIR
from tessella.operators.contracts import ContractError

S1 = PAIR[0]


@dataclass(frozen=True)
class RuleWeights:
    """Evidence for and against a match, by feature."""

    name_exact: float = 0.30
    name_jaro_winkler: float = 0.25
    name_tfidf_cosine: float = 0.10
    address_exact: float = 0.12
    address_char_ngram_similarity: float = 0.12
    address_tfidf_cosine: float = 0.05
    country_match: float = 0.03
    postal_match: float = 0.08
    numeric_disagreement: float = -0.18
    country_disagreement: float = -0.20
    postal_disagreement: float = -0.20


BLANK_PENALTY, METHOD = 0.20, "deterministic_lexical_v1_raw"
BLANK = ["source1_name_missing", "candidate_name_missing", "source1_address_missing", "candidate_address_missing"]


def rule_score(features: DataFrame, weights: RuleWeights | None = None) -> DataFrame:
    """(pair, raw_match_score, scoring_method): a weighted sum in [0, 1], which is no probability."""
    terms = [F.lit(w) * F.col(c) for c, w in asdict(weights or RuleWeights()).items()]
    total: Column = sum(terms[1:], terms[0])
    blank = sum((F.col(c) for c in BLANK[1:]), F.col(BLANK[0])) == len(BLANK)
    score = unit(total - F.when(blank, F.lit(BLANK_PENALTY)).otherwise(F.lit(0.0)))
    return features.select(*PAIR, F.round(score, 6).alias("raw_match_score"), F.lit(METHOD).alias("scoring_method"))


def _both(training: DataFrame, label: str) -> int:
    counts = {r[0]: r["count"] for r in training.groupBy(label).count().collect()}  # two classes
    if set(counts) != {0, 1}:
        raise ContractError(f"training needs labels 0 and 1, not {sorted(counts, key=str)}")
    return sum(counts.values())


def fit_logistic(training: DataFrame, features: list[str], label: str = "label", c: float = 1.0, iterations: int = 500, weight: str | None = None) -> PipelineModel:
    """L2-regularised logistic regression on standardised features."""
    n = _both(training, label)
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    stages.append(LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, **({"weightCol": weight} if weight else {})))
    return Pipeline(stages=stages).fit(filled(training, features))


def fit_boosted(training: DataFrame, features: list[str], label: str = "label", iterations: int = 20, step: float = 0.08, depth: int = 5, least: int = 20, weight: str | None = None, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees; missing features are -1."""
    _both(training, label)
    tree = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=iterations, stepSize=step, maxDepth=depth, minInstancesPerNode=least, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), tree]).fit(filled(training, features))


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Null and NaN features as -1."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(-1.0)) for c in features})


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """df and the probability of a match."""
    out = model.transform(filled(df, features))
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def save_fitted(model: PipelineModel, features: list[str], path: str) -> None:
    """A fitted model with its feature schema, in a folder all executors see; one that is there is replaced."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(i, c) for i, c in enumerate(features)], "at int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/schema")


def load_fitted(path: str, features: list[str] | None = None) -> tuple[PipelineModel, list[str]]:
    """What save_fitted() wrote; an error if the features expected differ in name or order."""
    rows = SparkSession.active().read.schema("at int, feature string").json(f"{path}/schema").orderBy("at").collect()  # one row a feature
    known = [r["feature"] for r in rows]
    if features is not None and features != known:
        raise ContractError(f"features differ: saved {known}, expected {features}")
    return PipelineModel.load(f"{path}/model"), known


def averaged(df: DataFrame, columns: list[str], name: str = "p") -> DataFrame:
    """The mean of several models' probabilities beside them."""
    return df.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))


def pruned(df: DataFrame, least: float = 0.01, p: str = "p") -> DataFrame:
    return df.where(F.col(p) >= least)


def hard_negatives(pairs: DataFrame, fraction: float, deep: int = 100, label: str = "label", seed: str = "negatives") -> DataFrame:
    """All pairs to rank `deep` and all true pairs; of the others a hashed fraction, with weight 1 / fraction."""
    far = (F.col("rank") > deep) & (F.col(label) == 0)
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *PAIR), 256), 1, 13), 16, 10).cast("double") / float(2**52)
    return pairs.where(~far | (u < fraction)).withColumn("weight", F.when(far, F.lit(1 / fraction)).otherwise(F.lit(1.0)))


def second_stage(context: DataFrame, features: list[str], used: DataFrame, held_out: DataFrame, label: str = "label", **how) -> PipelineModel:
    """Fitted on S1 that neither the first stage saw nor validation has."""
    fresh = context.join(used.select(S1).distinct(), S1, "left_anti").join(held_out.select(S1).distinct(), S1, "left_anti")
    return fit_boosted(fresh, features, label, **how)
