"""Model-backed scores: any batch scorer as a column, and light pair classifiers.

``score_with_model`` runs a user scorer through an iterator pandas UDF: the
model is loaded once per Python worker and sees Arrow batches. It is a scalar
column, so pruning the column prunes the model call.
``train_pair_classifier`` re-aims the neural contradiction / paraphrase
trainers as a class-weighted logistic regression on the lexical pair features,
fitted out of fold on group folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ensure_checkpoint_dir


def score_with_model(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]], a: Column | str,
                     b: Column | str, clip: bool = True, digits: int | None = 4, only: Column | None = None) -> Column:
    """A double column from ``load()(a, b)``; ``load`` runs once per worker process.

    With ``only`` the model sees the rows for which it is true, packed together within each batch; the others get
    null and their texts never leave the JVM. All in the one pass over the table.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if only is None:
        @pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for x, y in batches:
                yield model(x, y).astype("float64")

        c = score(x, y)
    else:
        @pandas_udf("double")
        def score_some(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = None
            for x, y, flag in batches:
                at = flag.to_numpy(dtype=bool).nonzero()[0]
                out = np.full(len(flag), np.nan)
                if len(at):
                    model = model or load()
                    out[at] = model(x.iloc[at].reset_index(drop=True), y.iloc[at].reset_index(drop=True)).to_numpy("float64", na_value=np.nan)
                yield pd.Series(out)

        only = F.coalesce(only, F.lit(False))
        c = score_some(F.when(only, x), F.when(only, y), only)
    c = F.when(c.isNotNull() & ~F.isnan(c), c)  # a failed score stays missing
    if clip:
        c = F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return F.round(c, digits) if digits is not None else c


def overlap_scorer() -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A deterministic stand-in scorer: distinct shared whitespace tokens / max distinct tokens."""
    def run(mt: pd.Series, ref: pd.Series) -> pd.Series:
        out = []
        for m, r in zip(mt, ref):
            sm = set(m.split()) if isinstance(m, str) else set()
            sr = set(r.split()) if isinstance(r, str) else set()
            out.append(len(sm & sr) / max(len(sm), len(sr), 1))
        return pd.Series(out, dtype="float64")

    return run


def train_pair_classifier(df: DataFrame, features: Sequence[str], label: str = "y", fold: str = "fold",
                          out: str = "prob", max_iter: int = 50) -> DataFrame:
    """Out-of-fold P(label = 1) from a class-weighted logistic regression per fold.

    A fold's model learns from the labelled rows of the other folds alone, with weights N / count(class)
    over those rows; every row, labelled or not, is scored by the model that did not see its fold. A
    fold whose training rows hold fewer than two classes gets the share of positives there (null if there are none).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()  # read by the weights, every fold's fit and its scores: what the features cost is paid once
    vec = VectorAssembler(inputCols=list(features), outputCol="__f", handleInvalid="keep").transform(df)
    weights = fold_class_weights(df, label, fold).collect()  # folds x classes
    res = None
    for i in sorted({r["fold"] for r in weights}):
        mine = {r["y"]: r["weight"] for r in weights if r["fold"] == i and r["weight"] is not None}
        part = vec.where(F.col(fold) == i)
        if len(mine) < 2:
            part = part.withColumn(out, F.lit(float(next(iter(mine))) if mine else None).cast("double"))
        else:
            w = F.when(F.col(label) == 1, float(mine[1])).otherwise(float(mine[0]))
            train = vec.where((F.col(fold) != i) & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")).withColumn("__w", w)
            lr = LogisticRegression(featuresCol="__f", labelCol=label, weightCol="__w", maxIter=max_iter)
            part = lr.fit(train).transform(part).withColumn(out, vector_to_array("probability")[1])
        part = part.select(*df.columns, out)
        res = part if res is None else res.unionByName(part)
    return df.withColumn(out, F.lit(None).cast("double")) if res is None else res


def fold_class_weights(df: DataFrame, label: str = "y", fold: str = "fold") -> DataFrame:
    """(fold, y, n_train, weight): per fold the labelled rows of the other folds by class, and N / count(class).

    A fold without training rows of any class stands with null class and weight.
    """
    counts = df.groupBy(F.col(fold).alias("fold"), F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col("y").isNotNull()).select(F.col("fold").alias("other"), "y", "n")
    pairs = counts.select("fold").distinct().join(F.broadcast(known), F.col("fold") != F.col("other"), "left")
    per = pairs.groupBy("fold", "y").agg(F.sum("n").alias("n_train"))
    total = per.groupBy(F.col("fold").alias("f2")).agg(F.sum("n_train").alias("total"))
    return per.join(total, F.col("fold") == F.col("f2")).select("fold", "y", "n_train", (F.col("total") / F.col("n_train")).alias("weight"))
