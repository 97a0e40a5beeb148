"""Learned projections as ML estimators.

Each ``fit`` is one or a few aggregates over the table; only d x d numbers reach
the driver.  Each ``transform`` adds plain Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidform.functions.formulas import sanitize
from lucidform.operators.moments import gram
from lucidform.operators.ranking import hash_order


def _fix_signs(w: np.ndarray) -> np.ndarray:
    """Largest absolute loading of each component made positive."""
    if w.size == 0:
        return w
    top = w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])]
    return w * np.where(top < 0, -1.0, 1.0)


def moments_of(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred second moments (sums) of the columns.

    A first pass finds the means so that the second sums centred products.
    """
    n_, *means = df.agg(F.count(F.lit(1)), *[F.avg(F.col(c).cast("double")) for c in columns]).first()
    mean = np.array([m or 0.0 for m in means])
    g = gram(df, columns, mean)
    n = max(int(n_), 1)
    return n, mean, g[:-1, :-1] - np.outer(g[:-1, -1], g[-1, :-1]) / n


INLINE_TERMS = 256  # larger maps run as matrix products on Arrow batches


def batch_map(df: DataFrame, features: Sequence[str], names: Sequence[str], fn) -> DataFrame:
    """Adds ``names`` = columns of ``fn(rows x features matrix)``, batch by batch."""

    @F.pandas_udf("array<double>")
    def call(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(features)))
        return pd.Series(list(fn(m)))

    wide = df.withColumn("_m", call(F.array(*[F.col(f).cast("double") for f in features])))
    return wide.select(*df.columns, *[F.col("_m")[i].alias(n) for i, n in enumerate(names)])


class SavedModel(Model, MLWritable, MLReadable):
    """A fitted projection that ML's writers and readers keep: ``FIELDS`` are its constructor's arguments and its
    attributes.  A file holds a row for each field of the model and of the models inside it."""

    FIELDS: tuple[str, ...] = ()

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


def _rows_of(model: SavedModel, at: str = "") -> list[tuple]:
    """(path, kind, shape, numbers, texts) of the model's fields, models inside it included."""
    rows = [(at, "model", [], [], [type(model).__name__])]
    for name in model.FIELDS:
        value, path = getattr(model, name), f"{at}/{name}"
        if isinstance(value, SavedModel):
            rows += _rows_of(value, path)
        elif isinstance(value, str):
            rows.append((path, "text", [], [], [value]))
        elif isinstance(value, (list, tuple)) and value and isinstance(value[0], SavedModel):
            rows.append((path, "models", [len(value)], [], []))
            rows += [r for k, m in enumerate(value) for r in _rows_of(m, f"{path}/{k}")]
        elif isinstance(value, (list, tuple)):
            rows.append((path, "texts", [], [], list(value)))
        else:
            array = np.asarray(value)
            kind = "number" if array.ndim == 0 else "integers" if array.dtype.kind == "i" else "numbers"
            rows.append((path, kind, list(array.shape), array.astype(float).ravel().tolist(), []))
    return rows


def _model_from(rows: dict[str, tuple], at: str = "") -> SavedModel:
    cls = next(c for c in SavedModel.__subclasses__() if c.__name__ == rows[at][4][0])

    def value(path: str):
        _, kind, shape, numbers, texts = rows[path]
        if kind == "model":
            return _model_from(rows, path)
        if kind == "models":
            return [_model_from(rows, f"{path}/{k}") for k in range(shape[0])]
        if kind in ("text", "texts"):
            return texts[0] if kind == "text" else list(texts)
        array = np.array(numbers).reshape(shape)
        return float(array) if kind == "number" else array.astype(int) if kind == "integers" else array

    return cls(*[value(f"{at}/{name}") for name in cls.FIELDS])


class _ModelWriter(MLWriter):
    def __init__(self, model: SavedModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        schema = "path string, kind string, shape array<int>, numbers array<double>, texts array<string>"
        self.sparkSession.createDataFrame(_rows_of(self.model), schema).coalesce(1).write.parquet(path)


class _ModelReader(MLReader):
    def load(self, path: str) -> SavedModel:
        return _model_from({r["path"]: tuple(r) for r in self.sparkSession.read.parquet(path).collect()})  # one row a field


class Chain(SavedModel):
    """Fitted projections applied one after the other."""

    FIELDS = ("models",)

    def __init__(self, models: Sequence[SavedModel]):
        super().__init__()
        self.models = list(models)

    @property
    def names(self) -> list[str]:
        return [n for m in self.models for n in m.names]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for m in self.models:
            dataset = m.transform(dataset)
        return dataset


class LinearModel(SavedModel):
    """Adds ``(x - mean) / scale @ weights`` as columns."""

    FIELDS = ("features", "mean", "scale", "weights", "prefix")

    def __init__(self, features: Sequence[str], mean, scale, weights, prefix: str):
        super().__init__()
        self.features = list(features)
        self.mean, self.scale, self.weights = np.asarray(mean), np.asarray(scale), np.asarray(weights)
        self.prefix = prefix

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(self.weights.shape[1])]

    def columns(self) -> dict[str, Column]:
        out = {}
        for k, name in enumerate(self.names):
            terms = [
                (F.col(f) - F.lit(float(m))) * F.lit(float(w / s))
                for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights[:, k])
                if w != 0.0
            ]
            total = F.lit(0.0)
            for t in terms:
                total = total + t
            out[name] = total
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.weights.size <= INLINE_TERMS:
            return dataset.withColumns(self.columns())
        mean, w = self.mean, self.weights / self.scale[:, None]
        return batch_map(dataset, self.features, self.names, lambda x: (x - mean) @ w)

    def to_json(self) -> str:
        return json.dumps(
            {
                "features": self.features,
                "mean": self.mean.tolist(),
                "scale": self.scale.tolist(),
                "weights": self.weights.tolist(),
                "prefix": self.prefix,
            }
        )

    @staticmethod
    def from_json(text: str) -> LinearModel:
        d = json.loads(text)
        return LinearModel(d["features"], d["mean"], d["scale"], np.array(d["weights"]), d["prefix"])


class Projection(Estimator):
    """Base: ``fit(df)`` reads ``features`` and, if supervised, ``label``."""

    prefix = "p"

    def __init__(self, features: Sequence[str], k: int = 8, label: str = "y"):
        super().__init__()
        self.features, self.k, self.label = list(features), k, label

    def set_labels(self, label: str) -> Projection:
        self.label = label
        return self


class PCA(Projection):
    """Principal components of the centred columns; ``share`` picks k by explained variance."""

    prefix = "pca"

    def __init__(self, features, k: int = 8, label: str = "y", share: float | None = None):
        super().__init__(features, k, label)
        self.share = share

    def _fit(self, dataset: DataFrame) -> LinearModel:
        _, mean, s = moments_of(dataset, self.features)
        w, v = np.linalg.eigh(s)
        order = np.argsort(w)[::-1]
        w, v = np.maximum(w[order], 0.0), v[:, order]
        k = min(self.k, len(w))
        if self.share is not None:
            k = int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), self.share) + 1)
        return LinearModel(self.features, mean, np.ones(len(mean)), _fix_signs(v[:, :k]), self.prefix)


def pls_rotations(s: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Rotations of one-response partial least squares from second moments.

    ``s`` are second moments of standardised columns and ``c`` their
    cross moments with the centred response.
    """
    s, c = s.copy(), c.copy()
    weights, loads = [], []
    for _ in range(k):
        size = np.linalg.norm(c)
        if size < 1e-12:
            break
        w = c / size
        var = w @ s @ w
        if var < 1e-30:
            break
        p = s @ w / var
        q = c @ w / var
        s = s - var * np.outer(p, p)
        c = c - var * q * p
        weights.append(w)
        loads.append(p)
    if not weights:
        return np.zeros((len(c), 0))
    wm, pm = np.array(weights).T, np.array(loads).T
    return wm @ np.linalg.pinv(pm.T @ wm)


class PLS(Projection):
    """Supervised components; columns are standardised, two passes in total."""

    prefix = "pls"

    def _fit(self, dataset: DataFrame) -> LinearModel:
        n, mean, m = moments_of(dataset, [*self.features, self.label])
        return pls_model(self.features, n, mean, m, self.k, self.prefix)


def pls_model(features, n: int, mean: np.ndarray, m: np.ndarray, k: int, prefix: str) -> LinearModel:
    d = len(features)
    std = np.sqrt(np.maximum(np.diag(m)[:d] / max(n - 1, 1), 0.0))
    std[std == 0] = 1.0
    s, c = m[:d, :d] / np.outer(std, std), m[:d, d] / std
    r = pls_rotations(s, c, max(1, min(k, d, n - 1)))
    return LinearModel(features, mean[:d], std, _fix_signs(r), prefix)


class SparsePCA(Projection):
    """Components with soft-thresholded loadings from the covariance matrix."""

    prefix = "spca"

    def __init__(self, features, k: int = 8, label: str = "y", alpha: float = 0.2, rounds: int = 200):
        super().__init__(features, k, label)
        self.alpha, self.rounds = alpha, rounds

    def _fit(self, dataset: DataFrame) -> LinearModel:
        n, mean, m = moments_of(dataset, self.features)
        std = np.sqrt(np.maximum(np.diag(m) / n, 0.0))
        std[std == 0] = 1.0
        cov = m / n / np.outer(std, std)
        out = []
        for _ in range(min(self.k, len(mean))):
            v = np.linalg.eigh(cov)[1][:, -1]
            for _ in range(self.rounds):
                u = cov @ v
                cut = self.alpha * np.abs(u).max()
                u = np.sign(u) * np.maximum(np.abs(u) - cut, 0.0)
                size = np.linalg.norm(u)
                if size < 1e-15:
                    break
                u /= size
                if np.abs(u - v).max() < 1e-12:
                    v = u
                    break
                v = u
            out.append(v)
            lam = v @ cov @ v
            cov = cov - lam * np.outer(v, v)
        return LinearModel(self.features, mean, std, _fix_signs(np.array(out).T), self.prefix)


#: Up to so many products the driver holds their moment matrix; beyond that a block of a few columns.
GRAM_PRODUCTS = 4096


def product_moments(df: DataFrame, features: Sequence[str], left: np.ndarray, right: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred second moments of products of two features.

    Tasks add up matrices of their rows; Spark sums them row by row of the matrix.
    """
    wide = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("_m"))

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, len(features))
        return x[:, left] * x[:, right]

    def summed(shift: np.ndarray | None) -> dict[int, np.ndarray]:
        """Row 0 of the result sums ones and products; with a shift, all rows of the Gram matrix follow."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 if shift is None else len(left), len(left) + (shift is None)))
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    z = products(batch.slice(lo, 1000))
                    if shift is None:
                        total[0, 0] += len(z)
                        total[0, 1:] += z.sum(0)
                    else:
                        z -= shift
                        total += z.T @ z
            for lo in range(0, len(total), 256):
                part = total[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array([r.tobytes() for r in part], pa.binary())], names=["i", "v"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

        rows = wide.mapInArrow(run, "i bigint, v binary").groupBy("i").applyInPandas(add, "i bigint, v binary").collect()
        return {r["i"]: np.frombuffer(r["v"]) for r in rows}

    first = summed(None)[0]
    n = max(int(first[0]), 1)
    mean = first[1:] / n
    got = summed(mean)
    return n, mean, np.array([got[i] for i in range(len(left))])


def product_directions(df: DataFrame, features: Sequence[str], left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the products and the ``k`` leading directions of the centred ones, by block power iterations.

    A round is one pass in which every task sends products times a few columns, summed in blocks of rows.
    """
    from lucidform.operators.tensors import leading_directions

    wide = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("_m"))

    def times(v: np.ndarray | None, mean: np.ndarray | None) -> np.ndarray:
        """Sums of the products and their number, or X'Xv of the centred products X."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(left) + 1, 1) if v is None else v.shape)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    x = np.asarray(part.column(0).flatten()).reshape(part.num_rows, len(features))
                    z = x[:, left] * x[:, right]
                    if v is None:
                        total[:-1, 0] += z.sum(0)
                        total[-1, 0] += len(z)
                    else:
                        z -= mean
                        total += z.T @ (z @ v)
            for b, lo in enumerate(range(0, len(total), 4096)):
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([total[lo : lo + 4096].tobytes()], pa.binary())], names=["b", "v"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"b": pdf["b"].iloc[:1], "v": [np.sum([np.frombuffer(x) for x in pdf["v"]], axis=0).tobytes()]})

        rows = wide.mapInArrow(run, "b bigint, v binary").groupBy("b").applyInPandas(add, "b bigint, v binary").collect()
        flat = np.concatenate([np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: r["b"])])
        return flat if v is None else flat.reshape(v.shape)

    first = times(None, None)
    mean = first[:-1] / max(first[-1], 1.0)
    _, vectors = leading_directions(lambda v: times(v, mean), len(left), min(k + 8, len(left)))
    return mean, vectors[:, :k]


class InteractionModel(SavedModel):
    """Pair products, then a linear map."""

    FIELDS = ("features", "left", "right", "inner")

    def __init__(self, features: Sequence[str], left: np.ndarray, right: np.ndarray, inner: LinearModel):
        super().__init__()
        self.features, self.left, self.right, self.inner = list(features), left, right, inner

    @property
    def names(self) -> list[str]:
        return self.inner.names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        left, right, mean, w = self.left, self.right, self.inner.mean, self.inner.weights
        return batch_map(dataset, self.features, self.names, lambda x: (x[:, left] * x[:, right] - mean) @ w)


class InteractionSVD(Projection):
    """Leading directions of all pair products; ``pairs`` limits them to so many drawn at random."""

    prefix = "tkr"

    def __init__(self, features, k: int = 8, label: str = "y", pairs: int | None = None):
        super().__init__(features, k, label)
        self.pairs = pairs

    def _fit(self, dataset: DataFrame) -> InteractionModel:
        left, right = np.triu_indices(len(self.features))
        if self.pairs is not None and self.pairs < len(left):
            some = np.sort(np.random.default_rng(42).choice(len(left), self.pairs, replace=False))
            left, right = left[some], right[some]
        if len(left) > GRAM_PRODUCTS:
            mean, top = product_directions(dataset, self.features, left, right, self.k)
        else:
            _, mean, s = product_moments(dataset, self.features, left, right)
            w, v = np.linalg.eigh(s)
            top = v[:, np.argsort(w)[::-1][: min(self.k, len(w))]]
        top = _fix_signs(top)
        inner = LinearModel([f"{self.features[i]}*{self.features[j]}" for i, j in zip(left, right)], mean, np.ones(len(mean)), top, self.prefix)
        return InteractionModel(self.features, left, right, inner)


class FourierModel(SavedModel):
    FIELDS = ("features", "w", "b", "prefix")

    def __init__(self, features, w: np.ndarray, b: np.ndarray, prefix: str):
        super().__init__()
        self.features, self.w, self.b, self.prefix = list(features), w, b, prefix

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(len(self.b))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = {}
        for k, name in enumerate(self.names):
            dot = F.lit(float(self.b[k]))
            for f, w in zip(self.features, self.w[:, k]):
                dot = dot + F.col(f) * F.lit(float(w))
            out[name] = F.lit(float(np.sqrt(2.0 / len(self.b)))) * F.cos(dot)
        return dataset.withColumns(out)


class RandomFourier(Projection):
    """Random cosine features of a Gaussian kernel; nothing is learned from rows."""

    prefix = "rff"

    def __init__(self, features, k: int = 8, label: str = "y", gamma: float | None = None, seed: int = 42):
        super().__init__(features, k, label)
        self.gamma, self.seed = gamma or 1.0 / len(features), seed

    def _fit(self, dataset: DataFrame) -> FourierModel:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, np.sqrt(2.0 * self.gamma), (len(self.features), self.k))
        return FourierModel(self.features, w, rng.uniform(0.0, 2.0 * np.pi, self.k), self.prefix)


class KernelModel(SavedModel):
    FIELDS = ("features", "landmarks", "gamma", "inner")

    def __init__(self, features, landmarks: np.ndarray, gamma: float, inner: LinearModel):
        super().__init__()
        self.features, self.landmarks, self.gamma, self.inner = list(features), landmarks, gamma, inner

    @property
    def names(self) -> list[str]:
        return self.inner.names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wide = _kernel_table(dataset, self.features, self.landmarks, self.gamma)
        return self.inner.transform(wide).drop(*[f"_k{i}" for i in range(len(self.landmarks))])


def _kernel_table(df: DataFrame, features, landmarks: np.ndarray, gamma: float) -> DataFrame:
    """Gaussian similarity to each landmark as columns ``_k0..``."""
    sq = (landmarks * landmarks).sum(axis=1)

    def similar(x: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(axis=1)[:, None] + sq - 2.0 * (x @ landmarks.T)
        return np.exp(-gamma * np.maximum(d2, 0.0))

    return batch_map(df, features, [f"_k{i}" for i in range(len(landmarks))], similar)


class NystromKPCA(Projection):
    """Kernel components from a fixed number of landmark rows."""

    prefix = "kpca"

    def __init__(self, features, k: int = 8, label: str = "y", landmarks: int = 32, gamma: float | None = None, rid: str = "rid"):
        super().__init__(features, k, label)
        self.landmarks, self.gamma, self.rid = landmarks, gamma or 1.0 / len(features), rid

    def _fit(self, dataset: DataFrame) -> KernelModel:
        rows = dataset.select(*self.features, hash_order(42, self.rid).alias("_h")).orderBy("_h", *self.features).limit(self.landmarks).drop("_h").collect()
        z = np.array([list(r) for r in rows], dtype=float)
        wide = _kernel_table(dataset.select(*self.features), self.features, z, self.gamma)
        inner = PCA([f"_k{i}" for i in range(len(z))], self.k).fit(wide)
        inner.prefix = self.prefix
        return KernelModel(self.features, z, self.gamma, inner)


class NeuralModel(SavedModel):
    FIELDS = ("features", "mean", "scale", "w", "b", "prefix")

    def __init__(self, features, mean, scale, w, b, prefix: str):
        super().__init__()
        self.features, self.mean, self.scale, self.w, self.b, self.prefix = list(features), mean, scale, w, b, prefix

    @property
    def names(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(len(self.b))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lin = LinearModel(self.features, self.mean, self.scale, self.w, self.prefix).transform(dataset)
        return lin.withColumns({n: F.greatest(F.col(n) + F.lit(float(b)), F.lit(0.0)) for n, b in zip(self.names, self.b)})


class NeuralProjection(Projection):
    """Hidden layer of a small ReLU classifier, full-batch gradient descent.

    Every epoch is one pass whose tasks each send one gradient.
    """

    prefix = "nn"

    def __init__(self, features, k: int = 8, label: str = "y", epochs: int = 50, lr: float = 0.01, seed: int = 42):
        super().__init__(features, k, label)
        self.epochs, self.lr, self.seed = epochs, lr, seed

    def _fit(self, dataset: DataFrame) -> NeuralModel:
        n, mean, m = moments_of(dataset, self.features)
        std = np.sqrt(np.diag(m) / n)
        std[std == 0] = 1.0
        d, k = len(self.features), self.k
        rng = np.random.default_rng(self.seed)
        w1, b1 = rng.normal(0, np.sqrt(2.0 / d), (d, k)), np.zeros(k)
        w2, b2 = rng.normal(0, np.sqrt(2.0 / k), k), 0.0
        src = dataset.select(*[sanitize(F.col(f).cast("double")).alias(f) for f in self.features], F.col(self.label).cast("double").alias("_y"))
        for _ in range(self.epochs):
            g = np.zeros(d * k + k + k + 1)
            task = _gradient_task(mean, std, w1, b1, w2, b2)
            for r in src.mapInArrow(task, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
                g[r["i"]] = r["s"] / n
            w1, b1 = w1 - self.lr * g[: d * k].reshape(d, k), b1 - self.lr * g[d * k : d * k + k]
            w2, b2 = w2 - self.lr * g[d * k + k : d * k + 2 * k], b2 - self.lr * g[-1]
        return NeuralModel(self.features, mean, std, w1, b1, self.prefix)


def _gradient_task(mean, std, w1, b1, w2, b2):
    d, k = w1.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(d * k + 2 * k + 1)
        for b in batches:
            x = (np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)]) - mean) / std
            y = b.column(d).to_numpy(zero_copy_only=False)
            h = x @ w1 + b1
            a = np.maximum(h, 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(a @ w2 + b2, -500, 500)))
            e = p - y
            back = np.outer(e, w2) * (h > 0)
            g += np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), a.T @ e, [e.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)], names=["i", "s"])

    return run


PROJECTIONS = {
    "pca": PCA,
    "pls": PLS,
    "tucker": InteractionSVD,
    "rff": RandomFourier,
    "kernel_pca": NystromKPCA,
    "neural": NeuralProjection,
    "sparse_pca": SparsePCA,
}


def augment(lab, kinds: Sequence[str], k: int = 8):
    """The table with raw and projected features, and the fitted models."""
    from dataclasses import replace

    df, models, names = lab.df, [], list(lab.features)
    for kind in kinds:
        if kind not in PROJECTIONS:
            raise ValueError(f"unknown projection {kind}; known are {sorted(PROJECTIONS)}")
        model = PROJECTIONS[kind](lab.features, k, lab.label).fit(lab.df)
        df = model.transform(df)
        names += model.names
        models.append(model)
    return replace(lab, df=df, features=tuple(names)), models


def top_pair_products(lab, k: int = 4):
    """(formula, f1): best products of two different features."""
    from lucidform.functions.traces import binary, leaf, text
    from lucidform.operators.screening import search_scores

    d = len(lab.features)
    traces = [binary(leaf(i), "*", j) for i in range(d) for j in range(i + 1, d)]
    got = search_scores(lab, traces, keep=k)
    return sorted(((text(s.trace, lab.features), s.f1, s.trace) for s in got), key=lambda r: (-r[1], r[0]))[:k]
