"""Document quality by naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, crc_mod, cut, slices
from .hashing import Words, mix

#: Indicators are hashed to so many dimensions.
BITS = 20
#: The model is fitted on at most so many labelled documents of each class, those of the lowest hashes of id.
PER_CLASS = 3000
#: Texts of more bytes come after all others, and a class's texts end where they have PER_CLASS times so many.
FIT_BYTES = 1 << 16
#: Of them this share calibrates scores and is not fitted.
CALIBRATION = 5
#: Added to the counts of each class.
SMOOTHING = 1.0
#: Upper bound of the dual variables, and passes of coordinate descent at most.
COST, PASSES = 1.0, 30
THRESHOLD = 0.3
HELD_OUT = 5
#: An indicator that every text without a word has, and one for three equal words in a row.
_EMPTY, _THRICE = np.uint64(1), np.uint64(2)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each pair once: words, pairs of words, the last three bytes of words, and words said thrice."""
    words = Words(texts, lower=False)
    h, row = words.hash, words.row
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(h) else np.zeros(0, np.int64)
    thrice = pair[:-1][(np.diff(pair) == 1)] if len(pair) else pair
    thrice = thrice[(h[thrice] == h[thrice + 1]) & (h[thrice] == h[thrice + 2])]
    end = words.end
    ending = np.zeros(len(h), np.uint64)
    for i in range(3):
        at = end - 1 - i
        ending = ending << np.uint64(8) | np.where(at >= words.start, words.raw[np.maximum(at, 0)], 0).astype(np.uint64)
    empty = np.flatnonzero(words.count == 0)
    rows = np.concatenate((row, row[pair], row, row[thrice], empty))
    values = np.concatenate((h, mix(h[pair] * np.uint64(3) + h[pair + 1]), mix(ending + np.uint64(1 << 40)), np.full(len(thrice), mix(np.array([_THRICE]))[0]), np.full(len(empty), mix(np.array([_EMPTY]))[0])))
    keys = np.unique(rows.astype(np.int64) << BITS | (values >> np.uint64(64 - BITS)).astype(np.int64))
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), the margin being the mean direction of a text's scaled indicators."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        r = self.ratio[feature].astype(np.float64)
        length = np.sqrt(np.bincount(row, r * r, rows))
        return np.bincount(row, r * self.weight[feature], rows) / np.maximum(length, 1e-12) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feature = indicators(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(row, feature, len(texts)) + self.offset, -500, 500)))


def log_ratios(features: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """For each feature the log of its share among good texts' indicators over that among bad ones'."""
    counts = [np.full(1 << BITS, SMOOTHING) for _ in range(2)]
    for f, y in zip(features, good.tolist(), strict=True):
        counts[0 if y == 1 else 1][f] += 1  # a text has each feature once
    seen = counts[0] + counts[1] > 2 * SMOOTHING
    return np.where(seen, np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum()), 0.0)


def hinge_fit(features: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, by dual coordinate descent.

    Each text is the unit vector along its scaled indicators, and a constant.
    Both classes have the same total cost.
    """
    y = np.where(good == 1, 1.0, -1.0)
    limit = COST * len(y) / 2 / np.where(good == 1, max(1, (good == 1).sum()), max(1, (good == 0).sum()))
    values = []
    for f in features:
        r = ratio[f]
        values.append((r / max(np.sqrt(r @ r), 1e-12)).astype(np.float32))
    norm = np.array([v @ v + 1 for v in values])
    weight, bias, alpha, random = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(PASSES):
        worst = 0.0
        for i in random.permutation(len(y)).tolist():
            f, v = features[i], values[i]
            gradient = y[i] * (weight[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            if step := new - alpha[i]:
                worst = max(worst, abs(step) * norm[i])
                alpha[i] = new
                weight[f] += step * y[i] * v
                bias += step * y[i]
        if worst < 1e-3:
            break
    return weight, bias


def calibrate(margin: np.ndarray, good: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held margins, smoothed targets weighted to ``share`` of good texts."""
    n1, n0 = (good == 1).sum(), (good == 0).sum()
    if not n1 or not n0:
        return 4.0, 0.0
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good == 1, share / n1, (1 - share) / n0) * (n0 + n1)
    x, theta = np.stack((margin, np.ones_like(margin)), 1), np.array([2.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta = theta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.5)), float(theta[1])


def fit(features: list[np.ndarray], good: np.ndarray, held: np.ndarray, share: float) -> Model:
    """The model of a bounded sample; ``held`` rows calibrate it only."""
    own = [f for f, h in zip(features, held.tolist(), strict=True) if not h]
    ratio = log_ratios(own, good[~held])
    weight, bias = hinge_fit(own, good[~held], ratio)
    model = Model(weight, ratio, bias, 1.0, 0.0)
    # Text by text: all features in one array would be several times the sample.
    margin = np.array([model.margins(np.zeros(len(f), np.int64), f, 1)[0] for f in features])
    use = held if len(set(good[held].tolist())) == 2 else np.ones(len(good), bool)
    model.slope, model.offset = calibrate(margin[use], good[use], share)
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_class: int = PER_CLASS):
    """A broadcast Model, or a constant score where the labels have not both classes.

    Learns from labelled rows whose id's crc32 is not divisible by HELD_OUT.
    Of these, ``per_class`` of each class are fitted, in one task: those of the
    lowest hashes of id among texts of FIT_BYTES at most, then, where a class
    has too few, the longer ones, until its texts have ``per_class`` times
    FIT_BYTES; a class has one text at least, whatever its length. A fitted
    model is 2^BITS weights, so what the driver passes on is bounded too.
    """
    spark = docs.sparkSession
    marks = (
        labels.where(F.col("quality").isNotNull() & (crc_mod(id_column, HELD_OUT) != 0))
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min("quality").cast("int").alias("_good"))
    )
    totals = {r["_good"]: r["count"] for r in marks.groupBy("_good").count().collect()}
    if len(totals) < 2:
        n1, n = totals.get(1, 0), sum(totals.values())
        return (n1 + 1) / (n + 2)
    order = F.xxhash64("_id")
    texts = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    # Sizes decide before rows are chosen; of the rows of one id that of the lowest hash counts.
    sized = texts.select("_id", F.struct("_h", F.octet_length("text").alias("_bytes")).alias("_x")).join(marks, "_id").groupBy("_id", "_good").agg(F.min("_x").alias("_x")).select("_id", "_good", "_x.*")
    sized = cut(sized.withColumns({"_late": F.col("_bytes") > FIT_BYTES, "_order": order}))
    upto = Window.partitionBy("_good").orderBy("_late", "_order", "_id").rowsBetween(Window.unboundedPreceding, -1)  # per_class rows at most
    chosen = reduce(DataFrame.unionByName, [sized.where(F.col("_good") == label).orderBy("_late", "_order", "_id").limit(per_class) for label in (0, 1)])
    chosen = chosen.withColumn("_before", F.coalesce(F.sum("_bytes").over(upto), F.lit(0))).where(F.col("_before") < per_class * FIT_BYTES)
    chosen = chosen.select("_id", "_h", "_good", (F.pmod(F.shiftright("_order", 7), F.lit(CALIBRATION)) == 0).alias("_held"))
    # At most 2 x per_class ids; a repeated id brings one row.
    rows = texts.join(F.broadcast(chosen), ["_id", "_h"]).groupBy("_id", "_good", "_held").agg(F.min("text").alias("text")).select("_id", "text", "_good", "_held")

    def featured(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                row, feature = indicators(part.column("text"))
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
                yield pa.record_batch([pa.array(np.zeros(part.num_rows, np.int32)), part.column("_good"), part.column("_held"), lists], ["sample", "good", "held", "features"])

    share = totals[1] / (totals[0] + totals[1])

    def fitted(rows: pa.Table) -> pa.Table:
        features = [np.asarray(f, np.int32) for f in rows.column("features").to_numpy()]
        # An order of the rows' own, whatever order they came in.
        order = sorted(range(len(features)), key=lambda i: (len(features[i]), zlib.crc32(np.ascontiguousarray(features[i]))))
        good, held = (rows.column(c).to_numpy(zero_copy_only=False)[order] for c in ("good", "held"))
        m = fit([features[i] for i in order], good, held, share)
        body = [x.astype("<f4").tobytes() for x in (m.weight, m.ratio)]
        return pa.table({"weight": [body[0]], "ratio": [body[1]], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    sample = rows.mapInArrow(featured, "sample int, good int, held boolean, features array<int>")
    found = cut(sample.groupBy("sample").applyInArrow(fitted, "weight binary, ratio binary, bias double, slope double, offset double")).collect()
    if not found:
        return (totals[1] + 1) / (sum(totals.values()) + 2)
    r = found[0]
    return spark.sparkContext.broadcast(Model(np.frombuffer(r["weight"], "<f4"), np.frombuffer(r["ratio"], "<f4"), r["bias"], r["slope"], r["offset"]))


def _scores(model, texts: pa.Array) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    return model.value.scores(texts)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Scores every whole text: id, held_out, score (0 to 1, higher for good) and predicted.

    Null and empty texts have one indicator of their own. Equal texts have
    equal scores; repeated rows stay. Without labels of both classes the score
    is the smoothed share of good ones. Further columns are not read.
    """
    model = train(docs, labels, id_column, text_column)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                score = _scores(model, part.column("text"))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_column, "held_out", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column), (crc_mod(id_column, HELD_OUT) == 0).alias("held_out"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, score double, predicted int")


def keep_predicted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, training: DataFrame | None = None) -> DataFrame:
    """The documents predicted good, with the columns they came with; no join is needed.

    ``training`` holds the labelled texts if ``docs`` is no fair sample of
    them: after another filter, few or no bad ones may be left to learn from.
    """
    model = train(docs if training is None else training, labels, id_column, text_column)
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            for a, b in slices(texts, BATCH_BYTES):
                yield batch.slice(a, b - a).filter(pa.array(_scores(model, texts.slice(a, b - a)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
