"""Compression classifier: two zstandard dictionaries, trained on good and on bad labelled text, compress a whole text in
pieces; the difference of the compressed sizes as a share of the text's bytes becomes a calibrated probability."""

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, small_batches, whole_sample


@dataclass(frozen=True)
class Settings:
    """Bounds of what is learned from: labelled whole texts of each class (the smallest hashes of ids), a third of which
    calibrate, and their characters together."""

    texts: int = 1500
    characters: int = 32_000_000
    piece_bytes: int = 1024
    dictionary_bytes: int = 400_000
    #: Bytes added to a text's size before its difference is shared out, so that short texts' whole bytes weigh less.
    shrink: int = 50
    level: int = 3
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries (None where a class had too little text) and the logistic curve of the size difference."""

    bad: bytes | None
    good: bytes | None
    slope: float
    offset: float
    settings: Settings = Settings()


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


@cache
def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (model.bad, model.good):
        if data is None:
            trained = None
        else:
            trained = zstandard.ZstdCompressionDict(data)
            trained.precompute_compress(level=model.settings.level)
        out.append(
            zstandard.ZstdCompressor(
                level=model.settings.level, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return out


def size_difference(model: Model, text: str | None) -> float:
    """Compressed bytes with the bad dictionary less those with the good one, by the text's bytes and `shrink` more; 0 for empty
    texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    bad, good = (c.compress for c in _compressors(model))
    return sum(len(bad(p)) - len(good(p)) for p in pieces(data, model.settings.piece_bytes)) / (len(data) + model.settings.shrink)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression, lightly held to zero, by Newton's method."""
    theta, design = np.zeros(2), np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + np.array([1e-4, 1e-3]) * theta
        curve = design.T @ (design * (weight * p * (1 - p))[:, None]) + np.diag([1e-4, 1e-3])
        step = np.linalg.solve(curve, gradient)
        theta -= step * min(1, 40 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Learns from documents whose label is 0 or 1 and whose id's crc32 modulo 5 is not 0.

    The driver gets the texts that are not for calibration, 2 x characters at most, and a number for each of the others.
    Labels without a text, null labels and null ids are passed over before the bounds are applied; of contradicting labels
    the lower holds. Without labelled text of one class the score is the same for all texts.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("y"))
    )
    number = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(number) != {0, 1}:
        return _constant(number, settings)
    rows = docs.where("text is not null and text <> ''").select("doc_id", "text")
    texts = whole_sample(rows, known, number, "y", settings.texts, settings.characters)
    texts = texts.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(3)) == 0)
    gathered = sorted(texts.where("not calibrates").select("doc_id", "y", "text").collect(), key=lambda r: r["doc_id"])
    trained: list[bytes | None] = []
    for y in (0, 1):
        samples = [p for r in gathered if r["y"] == y for p in pieces(r["text"].encode("utf-8", "surrogatepass"), settings.piece_bytes)]
        size = min(settings.dictionary_bytes, sum(map(len, samples)) // 4)
        trained.append(zstandard.train_dictionary(size, samples).as_bytes() if size >= 1024 and len(samples) >= 16 else None)
    if None in trained:
        return _constant(number, settings)
    raw = Model(trained[0], trained[1], 0.0, 0.0, settings)
    measured = texts.where("calibrates").select("y", _difference(docs, raw)("text").alias("x")).collect()
    y = np.array([r["y"] for r in measured], float)
    x = np.array([r["x"] for r in measured], float)
    weight = np.array([number[int(v)] / max(1, int((y == v).sum())) for v in y])
    slope, offset = _logistic(x, y, weight / weight.sum() * len(y)) if len(set(y.tolist())) == 2 else (0.0, 0.0)
    return Model(trained[0], trained[1], max(slope, 0.0), offset, settings)


def _constant(number: dict[int, int], settings: Settings) -> Model:
    """The model that gives every text the share of label 1, where there is too little to learn from."""
    share = (number.get(1, 0) + 1) / (sum(number.values()) + 2)
    return Model(None, None, 0.0, float(np.log(share / (1 - share))), settings)


def _difference(docs: DataFrame, model: Model):
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def difference(texts: pd.Series) -> pd.Series:
        return pd.Series([size_difference(shipped.value, x) for x in texts], dtype=float)

    return difference


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (probability of label 1; empty and null texts get that of no difference) and predicted. Repeated rows
    are judged alike, an empty table gives no rows; other columns stay, whatever their names, but score and predicted."""
    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    x = _difference(docs, model)(F.col(f"`{text_col}`"))
    scored = docs.select(*rest, x.alias("score")).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("score") * model.slope + model.offset)))
    )
    return scored.withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, score, predicted), a row for each row of docs; an empty table gives none."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, settings))
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
