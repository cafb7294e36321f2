"""Linear-algebra and learning operators: sparse autoencoder steps, geometry of classes, probes under cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .ranking import mann_whitney


@dataclass(frozen=True)
class Autoencoder:
    """Encoder [d, n], its bias, decoder [n, d] and the bias that is taken off and put back."""

    encoder: np.ndarray
    encoder_bias: np.ndarray
    decoder: np.ndarray
    decoder_bias: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.decoder_bias) @ self.encoder + self.encoder_bias, 0)

    def decode(self, h: np.ndarray) -> np.ndarray:
        return h @ self.decoder + self.decoder_bias

    def unit_rows(self) -> Autoencoder:
        """With decoder rows of length 1."""
        norm = np.maximum(np.linalg.norm(self.decoder, axis=1, keepdims=True), 1e-8)
        return Autoencoder(self.encoder, self.encoder_bias, self.decoder / norm, self.decoder_bias)

    def resampled(self, residuals: np.ndarray, dead: np.ndarray) -> Autoencoder:
        """Dead features take the directions of badly reconstructed rows, at the mean length of live encoder columns."""
        n = min(len(residuals), len(dead))
        unit = residuals[:n] / np.maximum(np.linalg.norm(residuals[:n], axis=1, keepdims=True), 1e-8)
        alive = np.setdiff1d(np.arange(self.encoder.shape[1]), dead)
        size = np.linalg.norm(self.encoder[:, alive], axis=0).mean() if len(alive) else 0.2
        encoder, bias, decoder = self.encoder.copy(), self.encoder_bias.copy(), self.decoder.copy()
        decoder[dead[:n]], encoder[:, dead[:n]], bias[dead[:n]] = unit, unit.T * size, 0
        return Autoencoder(encoder, bias, decoder, self.decoder_bias)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column, without an object for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def encoded(df: DataFrame, keys: list[str], vector: str, model: Autoencoder) -> DataFrame:
    """(keys..., features): one matrix product for each Arrow batch; the weights, of fixed size, are sent once."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            x = _matrix(batch.column(len(keys)), m.encoder.shape[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(m.encode(x))], [*keys, "features"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, vector).mapInArrow(run, f"{fields}, features array<double>")


def decoded(df: DataFrame, keys: list[str], features: str, model: Autoencoder) -> DataFrame:
    """(keys..., vector): reconstructions."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            h = _matrix(batch.column(len(keys)), m.decoder.shape[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(m.decode(h))], [*keys, "vector"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, features).mapInArrow(run, f"{fields}, vector array<double>")


def worst_losses(df: DataFrame, vector: str, predicted: str, n: int, order: list[str | Column] | None = None) -> DataFrame:
    """(columns of ``df``, residual, loss) of the n rows of the largest squared residual, ties by ``order`` or else by hash: a top list."""
    residual = F.zip_with(vector, predicted, lambda a, b: a.cast("double") - b)
    loss = F.aggregate(F.col("residual"), F.lit(0.0), lambda s, x: s + x * x)
    return df.withColumn("residual", residual).withColumn("loss", loss).orderBy(F.desc("loss"), *(order or [F.xxhash64("residual")])).limit(n)


def worst_rows(df: DataFrame, vector: str, predicted: str, features: int, most: int = 256, seed: int = 0) -> DataFrame:
    """Residuals for resampling: of the 4n rows of the largest loss, n by hash, where n = min(features, most)."""
    n = min(features, most)
    return worst_losses(df, vector, predicted, 4 * n).select("residual", "loss").orderBy(F.xxhash64("residual", F.lit(seed))).limit(n)


def top_coefficients(train: DataFrame, features: str, label: str, n: int = 15, signed: bool = False) -> list[tuple[int, float]]:
    """(feature, coefficient) of the balanced logistic model of standardized features: the n largest in size, or with ``signed`` the n highest.

    As many coefficients as there are features come to the driver, which puts
    them in order; ties go to the lower feature.
    """
    scaled, _ = _standardized(train, train, features)
    weights = balanced_logistic(scaled, features, label).coefficients.toArray()
    order = np.lexsort((np.arange(len(weights)), -weights if signed else -np.abs(weights)))[:n]
    return [(int(i), float(weights[i])) for i in order]


@dataclass(frozen=True)
class Geometry:
    """Spectra of the total scatter, of the class means in its basis, and what they sum up to.

    Where only the leading components were found, ``total`` and
    ``class_total`` are the traces of all.
    """

    variance: np.ndarray
    between: np.ndarray  # the class scatter in the basis of the components
    total: float
    class_total: float
    width: int

    @property
    def class_mass(self) -> np.ndarray:
        """What each component has of the class scatter."""
        return np.diag(self.between).copy()

    @property
    def eta(self) -> float:
        return self.class_total / self.total if self.total > 0 else 0.0

    def reach(self, share: float, of_class: bool = False) -> int:
        """Components needed for a share of the sum; all of them if those at hand do not reach it."""
        x, total = (self.class_mass, self.class_total) if of_class else (self.variance, self.total)
        if total <= 0:
            return self.width
        found = int(np.searchsorted(np.cumsum(x), share * total * (1 - 1e-12))) + 1
        return found if found <= len(x) else self.width

    def top_share(self, n: int) -> float:
        return float(self.variance[:n].sum() / self.total) if self.total > 0 else 0.0

    def whitened(self, floor: float = 1e-3) -> np.ndarray:
        """The spectrum of the class scatter after each component is scaled to variance 1; those at or below ``floor`` of the mean variance are dropped."""
        keep = self.variance > floor * self.total / self.width
        scale = 1 / np.sqrt(self.variance[keep])
        return np.maximum(np.sort(np.linalg.eigvalsh(self.between[np.ix_(keep, keep)] * np.outer(scale, scale)))[::-1], 0)


#: Up to this width the scatter itself is summed and taken apart; beyond, its leading components are found in blocks of vectors.
EXACT_WIDTH = 768
#: Further directions that the range finder carries, and its rounds over the rows.
SPARE, ROUNDS = 16, 3


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows' vectors x of part(x), which is a matrix for any number of rows.

    A task adds up its batches and gives a row for each of the matrix's rows;
    Spark adds these, and the driver gets the matrix.
    """

    def run(batches):
        total = 0
        for batch in batches:
            total = total + part(_matrix(batch.column(0), width))
        if np.ndim(total):
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), _lists(total)], ["i", "x"])

    sums = rows.mapInArrow(run, "i int, x array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("x")).alias("x")).orderBy("i").select(vector_to_array("x").alias("x")).toArrow()
    return np.stack(sums.column("x").to_numpy()) if sums.num_rows else np.zeros((0, 0))


def class_geometry(df: DataFrame, vector: str, label: str, components: int | None = None) -> Geometry:
    """Scatter of vectors and of their class means.

    Sums of products of centred rows are made by tasks and added up in Spark.
    The driver gets d x d numbers at most and takes their eigenvectors; these
    are sent back, and the class means, which stay distributed whatever their
    number, are summed in their basis. With ``components``, or beyond a width
    of EXACT_WIDTH (then 64), the leading components are found by a blocked
    random range finder: a few rounds multiply the scatter with as many
    directions as are asked for and some more, so the driver gets that many
    times d numbers. Null vectors and labels take no part.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("y"))
    if rows.isEmpty():
        return Geometry(np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    v = array_to_vector("x")
    whole = rows.agg(Summarizer.mean(v).alias("m"), Summarizer.variance(v).alias("v"), F.count(F.lit(1)).alias("n")).first()
    mean, width = whole["m"].toArray(), len(whole["m"])
    total = float(whole["v"].toArray().sum() * (whole["n"] - 1))
    if components is None and width > EXACT_WIDTH:
        components = 64
    x = rows.select("x")
    if components is None or components + SPARE >= width:
        values, basis = np.linalg.eigh(_summed(x, width, lambda a: (a - mean).T @ (a - mean)))
    else:
        directions = np.random.default_rng(0).standard_normal((width, components + SPARE))
        for _ in range(ROUNDS):
            directions, _ = np.linalg.qr(directions)
            directions = _summed(x, width, lambda a, d=directions: (a - mean).T @ ((a - mean) @ d))
        directions, _ = np.linalg.qr(directions)
        values, turned = np.linalg.eigh(_summed(x, width, lambda a: ((a - mean) @ directions).T @ ((a - mean) @ directions)))
        basis = directions @ turned
    order = np.argsort(-values)[:components]
    basis = basis[:, order]
    means = rows.groupBy("y").agg(Summarizer.mean(v).alias("m"), F.count(F.lit(1)).alias("n"))
    weighted = means.select(F.transform(F.zip_with(vector_to_array("m"), F.lit([float(a) for a in mean]), lambda a, b: a - b), lambda a: a * F.sqrt("n")).alias("x"))
    # One more column and row for the class means' whole length.
    between = _summed(weighted, width, lambda a: np.pad((a @ basis).T @ (a @ basis), (0, 1)) + np.pad([[(a * a).sum()]], (basis.shape[1], 0)))
    return Geometry(np.maximum(values[order], 0), between[:-1, :-1], total, float(between[-1, -1]), width)


def _standardized(train: DataFrame, test: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
    """Both sides less the training mean, over the population deviation of the training side."""
    s = train.agg(Summarizer.mean(F.col(features)).alias("m"), Summarizer.variance(F.col(features)).alias("v"), F.count(F.lit(1)).alias("n")).first()
    mean = s["m"].toArray()
    scale = np.sqrt(s["v"].toArray() * (s["n"] - 1) / s["n"])
    scale[scale == 0] = 1
    values = vector_to_array(features)
    shifted = F.zip_with(F.zip_with(values, F.lit([float(x) for x in mean]), lambda a, b: a - b), F.lit([float(x) for x in scale]), lambda a, b: a / b)
    return tuple(df.withColumn(features, array_to_vector(shifted)) for df in (train, test))


def balanced_logistic(train: DataFrame, features: str, label: str, strength: float = 1.0):
    """L2 logistic regression with class weights n / (2 n_c), the penalty being 1 / (strength x total weight)."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2 * counts.get(1, n))).otherwise(n / (2 * counts.get(0, n)))
    fit = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", regParam=1 / (strength * n), standardization=False, maxIter=200, tol=1e-8)
    return fit.fit(train.withColumn("_w", weight))


def out_of_fold(df: DataFrame, features: str, label: str, fold: str = "fold", folds: int = 5) -> DataFrame:
    """``df`` with each row's probability under the model of the other folds; folds whose training rows are of one class are left out."""
    df = written(df)  # read several times in each fold
    out = None
    for i in range(folds):
        train, test = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        if train.select(label).distinct().limit(2).count() < 2:
            continue
        a, b = _standardized(train, test, features)
        part = balanced_logistic(a, features, label).transform(b).withColumn("p", F.element_at(vector_to_array("probability"), 2)).select(*df.columns, "p")
        out = part if out is None else out.unionByName(part)
    return out


def softmax_probe(train: DataFrame, test: DataFrame, features: str, label: str, strength: float = 1e4) -> DataFrame:
    """``test`` with its prediction, class probabilities and ``above``: how many classes are likelier than the true one.

    A multinomial model on features less the training mean, over its
    deviation; a class that training lacks has probability 0.
    """
    a, b = _standardized(train, test, features)
    model = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=1 / strength, standardization=False, maxIter=60)
    found = model.fit(a).transform(b).withColumn("probability", vector_to_array("probability"))
    own = F.coalesce(F.get("probability", F.col(label)), F.lit(0.0))
    return found.withColumn("above", F.size(_likelier(F.col("probability"), own)))


def _likelier(probability: Column, own: Column) -> Column:
    return F.filter(probability, lambda x: x > own)


def transferred(train: DataFrame, others: DataFrame, features: str, label: str) -> DataFrame:
    """``others`` with ``p`` under a balanced model of ``train``, whose scaling it keeps."""
    a, b = _standardized(train, others, features)
    return balanced_logistic(a, features, label).transform(b).withColumn("p", F.element_at(vector_to_array("probability"), 2)).select(*others.columns, "p")


def fold_aucs(predicted: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """AUC of each fold with both classes."""
    return mann_whitney(predicted, "p", F.col(label) == 1, [fold]).where(F.col("auc").isNotNull()).select(fold, "n_pos", "n_neg", "auc")


def assembled(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)
