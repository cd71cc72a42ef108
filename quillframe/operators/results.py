"""Outcome of a match as a struct column, and what can be said of it; learned similarities."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import rx, similarity as S
from ..runtime import ship

LEVELS = ((0.9999, "perfect"), (0.90, "high"), (0.75, "medium"))


def match_result(query: Column | str, candidates: Column | str, best: Column | str, score: Column | str, threshold: float = 0.0, algorithm: str = "levenshtein") -> Column:
    """Struct of query, candidates, best candidate (NULL below the threshold), score and level."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is from 0 to 1")
    s = F.coalesce(rx.col(score), F.lit(0.0))
    ok = (s >= threshold) & rx.col(best).isNotNull()
    return F.struct(ok.alias("is_match"), s.alias("score"), F.when(ok, rx.col(best)).alias("best_candidate"), rx.col(query).alias("query"), rx.col(candidates).alias("candidates"), F.lit(threshold).alias("threshold"), F.when(ok, confidence_level(s)).otherwise("no_match").alias("confidence"), F.lit(algorithm).alias("algorithm_used"))


def confidence_level(score: Column | str) -> Column:
    out = F.when(rx.col(score).isNull(), F.lit("no_match"))
    for low, name in LEVELS:
        out = out.when(rx.col(score) >= low, F.lit(name))
    return out.otherwise("low")


def no_match(query: Column | str, candidates: Column | str, threshold: float = 0.0, algorithm: str = "levenshtein") -> Column:
    """The result of a search that found nothing."""
    return match_result(query, candidates, F.lit(None).cast("string"), F.lit(0.0), threshold, algorithm)


def is_level(result: Column | str, level: str) -> Column:
    """Whether a result is a match of the level: perfect, high (0.90 up), medium (0.75 up) or low; a
    perfect match is of high confidence too."""
    if level not in ("perfect", "high", "medium", "low"):
        raise ValueError("level is perfect, high, medium or low")
    kind = rx.col(result)["confidence"]
    return kind.isin("perfect", "high") if level == "high" else kind == level


def explain(result: Column | str) -> Column:
    r = rx.col(result)
    return F.when(r["is_match"], F.format_string("'%s' matches '%s' with score %.4f (%s)", r["query"], r["best_candidate"], r["score"], r["confidence"])).otherwise(F.format_string("'%s' has no match of %.2f", r["query"], r["threshold"]))


class SimilarityModel(ABC):
    """A learned similarity of two texts: features as a column, prediction over Arrow batches."""

    @abstractmethod
    def features(self, a: Column | str, b: Column | str) -> Column: ...

    @abstractmethod
    def predict(self, a: Column | str, b: Column | str) -> Column: ...

    def feature_names(self) -> list[str]:
        return []

    def info(self) -> dict:
        return {"type": type(self).__name__, "features": self.feature_names()}


class ProbabilityModel(SimilarityModel):
    """Any model with predict_proba(features) -> probabilities by class; sent to the workers once."""

    NAMES = ["levenshtein", "jaro_winkler", "length_difference", "length_ratio", "common_prefix", "common_suffix"]

    def __init__(self, model, threshold: float = 0.5):
        if not hasattr(model, "predict_proba"):
            raise TypeError("the model has no predict_proba")
        if not 0 <= threshold <= 1:
            raise ValueError("threshold is from 0 to 1")
        self.model, self.threshold = model, threshold

    def feature_names(self) -> list[str]:
        return list(self.NAMES)

    def features(self, a: Column | str, b: Column | str) -> Column:
        a, b = rx.col(a), rx.col(b)
        n, m = F.length(a), F.length(b)
        longest = F.greatest(n, m, F.lit(1))

        def prefix(x: Column, y: Column) -> Column:
            same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
            return F.coalesce(F.array_position(same, False) - 1, F.size(same)) / longest

        return F.array(S.levenshtein_score(a, b), S.jaro_winkler_score(a, b), F.abs(n - m).cast("double"), F.least(n, m) / longest, prefix(a, b), prefix(F.reverse(a), F.reverse(b)))

    def predict(self, a: Column | str, b: Column | str) -> Column:
        """Probability of class 1 (or the highest, with one class)."""
        ship()
        model = self.model

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            import numpy as np

            p = np.asarray(model.predict_proba(np.stack(x.to_list()) if len(x) else np.empty((0, 6))))
            return pd.Series(p[:, 1] if p.ndim > 1 and p.shape[1] > 1 else p.max(-1))

        return run(self.features(a, b))
