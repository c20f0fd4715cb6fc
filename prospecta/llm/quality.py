"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed in pieces
of ``PIECE`` characters, each with either dictionary, so that a long text doesn't outgrow them; the difference of
the two sums over their total, and the size over the text's, are turned into a probability by a logistic fit on
labelled rows that no dictionary has seen.

Learning reads ``PER_LABEL`` labelled rows of each label at most, in expectation, drawn by a hash of their id;
half of them build dictionaries, half calibrate. Prediction sees the text alone, all of it.

Defined results: a null text counts as empty; an empty text gets the calibrated score of a zero difference; with
labels of one kind only, or none, all scores are 0.5. Labels repeated for one id count once; ids
may be of any type, and rows that share one share its labels. Equal texts get
equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, uniform, written

PIECE, PER_LABEL, DICT_BYTES, LEAST_DICT_BYTES, LEVEL = 2048, 3000, 65_536, 256, 3
#: What training takes together, and the shortest repeat it looks for, in bytes.
SEGMENT, MATCH = 64, 6


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(text: str | None) -> list[bytes]:
    text = text or ""
    return [text[i : i + PIECE].encode("utf-8", "replace") for i in range(0, len(text), PIECE)]


def build_dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on all pieces of ``texts``; where they are too few for its size, one of half that size, and so on.

    Texts of a few hundred bytes in all, which nothing can be trained on, are a dictionary as they are.
    """
    samples, size = [p for t in texts for p in pieces(t)], DICT_BYTES
    while size >= LEAST_DICT_BYTES:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(samples)[-DICT_BYTES:]


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None):
        self.dicts, self.weights, self._made = (good, bad), weights, None

    def __getstate__(self):
        return {"dicts": self.dicts, "weights": self.weights, "_made": None}

    def measures(self, text: str | None) -> tuple[float, float]:
        """The difference of the compressed sizes over their sum, and their mean over the text's bytes."""
        if self._made is None:
            self._made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in self.dicts]
        cut = pieces(text)
        if not cut:
            return 0.0, 0.5
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self._made)
        return (bad - good) / (bad + good), (good + bad) / 2 / sum(map(len, cut))

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(design(np.array([self.measures(text)])) @ self.weights, -30, 30)[0])))


def design(m: np.ndarray) -> np.ndarray:
    """Columns of the logistic fit: 1, the difference, the ratio and its square, both scaled to order 1."""
    d, r = m[:, 0] * 10, np.clip(m[:, 1], 0, 1.5)
    return np.stack([np.ones_like(d), d, r, r * r, d * r], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method, each label with half the weight."""
    w, share = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Scorer:
    """Learns from the labelled rows that aren't held out."""
    usable = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id")).distinct()
    held = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    if len(held) < 2:
        return Scorer(b"", b"")
    rate = F.coalesce(*[F.when(F.col("_label") == k, F.lit(min(1.0, per_label / n))) for k, n in held.items()])
    drawn = uniform("quality-1", F.col("_id"))
    # 2 * per_label rows in expectation; sent to all tasks after a check of its size, so that no text moves but those it names.
    chosen = checked(written(usable.filter(drawn < rate).select("_id", "_label", (uniform("quality-2", F.col("_id")) < 0.5).alias("_build")), "quality-labels"))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")).join(chosen, "_id").select("_id", "_label", "_build", "_text").persist()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_text")
        return pd.DataFrame([(int(pdf["_label"].iloc[0]), build_dictionary(list(pdf["_text"])))], columns=["_label", "dict"])

    built = {r["_label"]: r["dict"] for r in texts.filter("_build").groupBy("_label").applyInPandas(build, "_label int, dict binary").collect()}
    if len(built) < 2:
        return Scorer(b"", b"")
    plain = Scorer(built[1], built[0])

    def measure(batches):
        for pdf in batches:
            found = [plain.measures(t) for t in pdf["_text"]]
            yield pd.DataFrame({"y": pdf["_label"].astype("int32"), "d": [f[0] for f in found], "r": [f[1] for f in found]})

    rows = texts.filter("not _build").mapInPandas(measure, "y int, d double, r double").toPandas().sort_values(["d", "r", "y"])
    texts.unpersist()
    if rows["y"].nunique() < 2:
        return plain
    return Scorer(built[1], built[0], logistic(design(rows[["d", "r"]].to_numpy()), rows["y"].to_numpy()))


def predict(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col(f"`{text_col}`"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scorer = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    return predict(rows, scorer, "_text").select(id_col, "held_out", "score", "predicted")
