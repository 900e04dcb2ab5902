"""Models over vectors: composition by least squares, ridge maps, clustering, probing and pluggable inference.

Fits of a few coefficients aggregate sums in Spark and solve small systems on the driver; their size depends on the vector width only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import vectors as V


def global_minimum(df: DataFrame, columns: list[str]) -> float:
    """The smallest entry of all vectors of the columns."""
    return float(df.agg(F.min(F.least(*[F.array_min(c) for c in columns]) if len(columns) > 1 else F.array_min(columns[0]))).first()[0])


def log_scale(df: DataFrame, column: str, lowest: float | None = None, shift: float = 1e-6) -> DataFrame:
    """log(x - min + shift), with the minimum over the whole column."""
    low = global_minimum(df, [column]) if lowest is None else lowest
    return df.withColumn(column, F.transform(column, lambda a: F.log(a.cast("double") - F.lit(low) + F.lit(shift))))


def compose_sum(df: DataFrame, parts: list[str], name: str = "composed") -> DataFrame:
    return df.withColumn(name, V.add(*[F.col(p) for p in parts]))


def compose_product(df: DataFrame, parts: list[str], name: str = "composed") -> DataFrame:
    return df.withColumn(name, V.multiply(*[F.col(p) for p in parts]))


def fit_weights(df: DataFrame, target: str, parts: list[str]) -> np.ndarray:
    """Coefficients of target = sum of weight * part over all rows and entries, without intercept, by normal equations."""
    cols = [*parts, target]
    sums = [F.sum(V.dot(F.col(a), F.col(b))).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    row = df.agg(*sums).first()
    k = len(parts)
    gram = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.lstsq(gram, np.array([row[f"s{i}_{k}"] for i in range(k)], float), rcond=None)[0]


def apply_weights(df: DataFrame, parts: list[str], weights: np.ndarray, name: str = "composed", product: bool = False) -> DataFrame:
    """Sum of weight * part, or product of part ** weight."""
    scaled = [V.power(F.col(p), float(w)) if product else V.scale(F.col(p), float(w)) for p, w in zip(parts, weights, strict=True)]
    return df.withColumn(name, V.multiply(*scaled) if product else V.add(*scaled))


def gram_blocks(df: DataFrame, x: str, y: str, folds: int, key: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """X'X, X'Y, sum of Y squared and rows by fold; each task adds its rows up, so only matrices of the vectors' width travel."""
    dims = df.select(F.size(x).alias("a"), F.size(y).alias("b")).first()
    d, e = dims.a, dims.b

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for part in batches:
            for fold, rows in part.groupby("fold"):
                a, b = np.stack(rows["x"]).astype(float), np.stack(rows["y"]).astype(float)
                s = sums.setdefault(int(fold), [np.zeros((d, d)), np.zeros((d, e)), np.zeros(e), 0])
                s[0] += a.T @ a
                s[1] += a.T @ b
                s[2] += (b * b).sum(0)
                s[3] += len(rows)
        for fold, (p, q, r, n) in sums.items():
            yield pd.DataFrame({"fold": [fold], "v": [np.concatenate([p.ravel(), q.ravel(), r, [n]])]})

    rows = df.select(F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"), F.col(x).alias("x"), F.col(y).alias("y"))
    parts = rows.mapInPandas(partial, "fold int, v array<double>").select("fold", F.posexplode("v").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():  # folds * (d * (d + e) + e + 1) numbers
        out.setdefault(r.fold, np.zeros(d * d + d * e + e + 1))[r.i] = r.v
    cut = (d * d, d * d + d * e, d * d + d * e + e)
    return {f: (v[: cut[0]].reshape(d, d), v[cut[0] : cut[1]].reshape(d, e), v[cut[1] : cut[2]], int(v[-1])) for f, v in out.items()}


def fit_ridge(df: DataFrame, x: str, y: str, key: str, alphas: np.ndarray | None = None, folds: int = 5) -> tuple[np.ndarray, float]:
    """(map, alpha) of a ridge regression with several outputs, without intercept; alpha by cross-validation over folds of the key."""
    alphas = np.logspace(-6, 3, 10) if alphas is None else alphas
    parts = gram_blocks(df, x, y, folds, key)
    whole = [sum(p[i] for p in parts.values()) for i in range(3)]
    solve = lambda g, b, a: np.linalg.solve(g + a * np.eye(len(g)), b)

    def error(alpha: float) -> float:
        total = 0.0
        for g, b, yy, _ in parts.values():
            w = solve(whole[0] - g, whole[1] - b, alpha)
            total += float(yy.sum() - 2 * (w * b).sum() + (w * (g @ w)).sum())
        return total

    best = min(alphas, key=error) if len(parts) > 1 else alphas[0]
    return solve(whole[0], whole[1], best), float(best)


def apply_map(df: DataFrame, x: str, matrix: np.ndarray, name: str = "mapped") -> DataFrame:
    """Vectors times a matrix, in Arrow batches."""
    m = np.asarray(matrix, float)

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v).astype(float) @ m)) if len(v) else v

    return df.withColumn(name, run(F.col(x)))


def frobenius(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Frobenius norm of the matrix of each group's vectors."""
    return df.groupBy(group).agg(F.sqrt(F.sum(V.dot(F.col(vector), F.col(vector)))).alias("norm"))


def _vectors(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(name, array_to_vector(F.transform(column, lambda a: a.cast("double"))))


def pca(df: DataFrame, column: str, k: int, name: str = "reduced") -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(df, column, "__v")
    fitted = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows)
    return fitted.withColumn(name, vector_to_array("__p")).drop("__v", "__p")


def kmeans(df: DataFrame, column: str, k: int, seed: int = 42, name: str = "found") -> DataFrame:
    from pyspark.ml.clustering import KMeans

    rows = _vectors(df, column, "__v")
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=name).fit(rows).transform(rows).drop("__v")


def probe(train: DataFrame, test: DataFrame, column: str, label: str, steps: int = 1000) -> DataFrame:
    """test with `found`: one logistic regression for each class against the rest; two classes share one."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest

    classes = train.select(label).distinct().count()
    lr = LogisticRegression(featuresCol="__v", labelCol=label, predictionCol="found", maxIter=steps)
    model = lr if classes <= 2 else OneVsRest(classifier=lr, featuresCol="__v", labelCol=label, predictionCol="found")
    fitted = model.fit(_vectors(train, column, "__v"))
    return fitted.transform(_vectors(test, column, "__v")).drop("__v", "rawPrediction", "probability")


def heads(classes: int) -> str:
    """One logit for two classes, else one for each."""
    return "binary" if classes == 2 else "multiclass"


def encode_sequences(df: DataFrame, column: str, load: Callable[[], Callable[[list], np.ndarray]], length: int, name: str = "embeddings", batch: int = 256) -> DataFrame:
    """Inference word by word: df with `name`, the vectors of the first `length` words of an array column, padded with zero vectors to `length`, and
    `name`_mask, 1 for words and 0 for padding. load() is as for encode; a batch's distinct words are encoded once. A null array is all padding."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{name}` array<array<float>>", f"`{name}_mask` array<int>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                words = [[] if w is None else list(w)[:length] for w in rows[column]]
                known = sorted({w for ws in words for w in ws if w is not None})
                vectors = dict(zip(known, np.asarray(model(known), np.float32), strict=True)) if known else {}
                zero = np.zeros(len(next(iter(vectors.values()))) if vectors else 0, np.float32)
                out = [[vectors.get(w, zero) for w in ws] + [zero] * (length - len(ws)) for ws in words]
                yield rows.assign(**{name: out, f"{name}_mask": [[1] * len(ws) + [0] * (length - len(ws)) for ws in words]})

    return df.mapInPandas(run, schema)


def encode(df: DataFrame, column: str, load: Callable[[], Callable[[list], np.ndarray]], name: str = "embedding", batch: int = 256) -> DataFrame:
    """Inference hook: load() gives a function from a list of values to a matrix, once for each Python worker; batches stay lazy."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{name}` array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                yield rows.assign(**{name: list(np.asarray(model(rows[column].tolist()), np.float32))})

    return df.mapInPandas(run, schema)
