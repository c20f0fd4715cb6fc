"""Hierarchical language identification: family first, then the language within the family.

Features are hashed byte trigrams of the whole lower-cased text (``DIMS`` buckets, square roots of counts, unit
length). One linear support vector machine is trained for each pair of families, and within a family one for each
pair of languages; every machine is a group of one Spark job. A text's family is the one that wins most of the
family machines (margins break ties), its language the one that wins most machines of that family.

Training reads ``PER_LANGUAGE`` rows of each language at most, in expectation: rows are drawn by a hash of their
id (of their text, where that is null) at the rate PER_LANGUAGE / rows of that language. Prediction sees the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training rows every text
is ``und``; with one language all texts get it. Extra columns are ignored. Repeated rows get equal rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.shared import uniform

DIMS, PER_LANGUAGE, EPOCHS, UNDETERMINED = 4096, 1000, 12, "und"
#: Language codes by family; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "nb", "nn", "is", "fy", "af", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "indo-aryan": ("hi", "bn", "mr", "gu", "pa", "ur", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
    "austronesian": ("id", "ms", "tl", "jv"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Letters and the bytes of all other scripts stand for themselves; the rest separates words.
_BYTES = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint32)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte trigrams of the whole text."""
    b = _BYTES[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    gram = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[(b[1:-1] != 32) | (b[:-2] != 32)]
    counts = np.sqrt(np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS).astype(np.float32))
    return counts / max(float(np.sqrt((counts * counts).sum())), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent. Rows are read one by one and may be half floats."""
    w, bias, alpha, rng = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(len(x)), np.random.default_rng(7)
    norm = [float(np.square(row.astype(np.float32)).sum()) + 1 + 0.5 / cost for row in x]
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            row = x[i].astype(np.float32)
            grad = y[i] * (float(row @ w) + bias) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - grad / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * row
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


class Model:
    """The machines, by level: ``family`` or the name of a family."""

    def __init__(self, languages: list[str], machines: list[tuple[str, str, str, np.ndarray]]):
        self.by_family: dict[str, list[str]] = {}
        for lang in sorted(languages):
            self.by_family.setdefault(family_of(lang), []).append(lang)
        self.levels: dict[str, tuple[list[tuple[str, str]], np.ndarray]] = {}
        for level in {m[0] for m in machines}:
            own = sorted((m for m in machines if m[0] == level), key=lambda m: m[1:3])
            self.levels[level] = [m[1:3] for m in own], np.array([m[3] for m in own])

    def _vote(self, level: str, names: list[str], x: np.ndarray) -> tuple[str, float]:
        if len(names) == 1 or level not in self.levels:
            return names[0], 1.0
        pairs, weights = self.levels[level]
        margins = weights[:, :-1] @ x + weights[:, -1]
        votes = dict.fromkeys(names, 0.0)
        for (a, b), m in zip(pairs, margins, strict=True):
            votes[a if m > 0 else b] += 1 + 1e-3 * min(abs(float(m)), 9)
        best = max(names, key=lambda n: votes[n])
        against = [float(m) if a == best else -float(m) for (a, b), m in zip(pairs, margins, strict=True) if best in (a, b)]
        return best, float(1 / (1 + np.exp(-3 * min(against))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.by_family or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        x = features(text)
        family, sure = self._vote("family", sorted(self.by_family), x)
        lang, surer = self._vote(f"in {family}", self.by_family[family], x)
        return lang, sure * surer


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from all rows of ``train`` that have a language, ``per_language`` of each language at most."""
    rows = train.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).filter("_text is not null and _lang is not null")
    held = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # one row per language
    if not held:
        return Model([], [])
    rate = F.coalesce(*[F.when(F.col("_lang") == k, F.lit(min(1.0, per_language / n))) for k, n in held.items()])
    # Rows without an id draw by their text, so that they are bounded too.
    sample = rows.filter(uniform("lang-1", F.coalesce(F.col("_id").cast("string"), F.md5("_text"))) < rate)
    families = sorted({family_of(k) for k in held})
    machines = [("family", a, b) for i, a in enumerate(families) for b in families[i + 1 :]]
    for f in families:
        own = sorted(k for k in held if family_of(k) == f)
        machines += [(f"in {f}", a, b) for i, a in enumerate(own) for b in own[i + 1 :]]

    def vectors(batches):
        columns = ["level", "a", "b", "y", "x"]
        for pdf in batches:
            out = []
            for t, k in zip(pdf["_text"], pdf["_lang"], strict=True):
                x, family = features(t).astype(np.float16).tobytes(), family_of(k)
                out += [(level, a, b, 1.0 if a in (k, family) else -1.0, x) for level, a, b in machines if (family if level == "family" else k) in (a, b)]
                if len(out) >= 512:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    def train_one(pdf: pd.DataFrame) -> pd.DataFrame:
        # The rows' order doesn't matter to the result; half floats keep a machine's rows small.
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        x, y = np.frombuffer(b"".join(pdf["x"]), dtype=np.float16).reshape(len(pdf), -1), pdf["y"].to_numpy()
        return pd.DataFrame([(pdf["level"][0], pdf["a"][0], pdf["b"][0], train_svm(x, y).tobytes())], columns=["level", "a", "b", "w"])

    found = []
    if machines:
        listed = sample.select("_text", "_lang").mapInPandas(vectors, "level string, a string, b string, y double, x binary")
        found = [(r["level"], r["a"], r["b"], np.frombuffer(r["w"], dtype=np.float32)) for r in listed.groupBy("level", "a", "b").applyInPandas(train_one, "level string, a string, b string, w binary").collect()]
    return Model(list(held), found)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_guess", guess(F.col(f"`{text_col}`"))).withColumns({"lang_pred": F.col("_guess.lang_pred"), "score": F.col("_guess.score")}).drop("_guess")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the rows that aren't held out and predicts all: id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    return predict(rows, model, "_text").select(id_col, "held_out", "lang_pred", "score")
