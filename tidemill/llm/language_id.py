"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text is described by the hashed bytes of its lower-cased letters, in runs of
one to four, with square roots of their counts. A linear model per family
(one against the rest) chooses the family; for each pair of languages of a
family a linear support vector machine votes, margins break ties.

Models are fitted on the driver from a bounded sample: at most ``PER_LANG``
rows per language and ``MOST_ROWS`` rows of all languages, those with the
smallest hashes of their ids. Tasks turn their whole texts into vectors, of
which the driver gets the places that aren't zero and lays out a few rows at a
time. Predictions read whole texts in one pass without an exchange.

Defined results: ``und`` with score 0 for a null text, one without a letter
(a character of Unicode's category L), or if nothing could be learned; languages outside ``FAMILIES`` are families
of their own; repeated rows are judged one by one; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import map_batches

#: Languages by family: fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

PER_LANG = 1_500
MOST_ROWS = 12_000
DIMENSIONS = 1 << 14
_OTHERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte runs."""
    raw = np.frombuffer((" " + _OTHERS.sub(" ", text.lower()) + " ").encode(), np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS)
    run = np.zeros(len(raw), np.uint32)
    for size in range(1, 5):
        run = run[: len(raw) - size + 1] * np.uint32(0x01000193) ^ raw[size - 1 :]
        if not len(run):
            break
        mixed = (run + np.uint32(size)) * np.uint32(0x9E3779B1)
        total += np.bincount(mixed >> np.uint32(18), minlength=DIMENSIONS)
    total = np.sqrt(total)
    return total / max(np.linalg.norm(total), 1e-9)


class Vectors:
    """Unit vectors, as the places that aren't zero and their values; rows are laid out when they are asked for."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.places = [np.frombuffer(p, np.uint16) for p, _ in rows]
        self.values = [np.frombuffer(v, np.float32) for _, v in rows]

    @classmethod
    def of(cls, texts: list[str]) -> Vectors:
        return cls([packed(features(t)) for t in texts])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, row in enumerate(rows):
            out[i, self.places[row]] = self.values[row]
        return out


def packed(vector: np.ndarray) -> tuple[bytes, bytes]:
    places = np.flatnonzero(vector)
    return places.astype(np.uint16).tobytes(), vector[places].astype(np.float32).tobytes()


def fit_svm(x: Vectors, rows: np.ndarray, y: np.ndarray, epochs: int = 12, strength: float = 1e-4) -> np.ndarray:
    """Weights of a linear SVM for labels of 1 and -1 of some rows of ``x``, by averaged sub-gradient steps in a fixed order."""
    weights, mean, step = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0
    order = np.random.default_rng(7)
    share = {1: len(y) / max(1, 2 * (y > 0).sum()), -1: len(y) / max(1, 2 * (y < 0).sum())}
    balance = np.where(y > 0, share[1], share[-1])
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            rate = 1 / (strength * (step + 1000))
            some = x[rows[part]]
            missed = y[part] * (some @ weights) < 1
            wrong = part[missed]
            weights *= 1 - rate * strength
            if len(wrong):
                weights += rate / len(part) * ((y[wrong] * balance[wrong]) @ some[missed])
            mean += (weights - mean) / step
    return mean


@dataclass
class LanguageModel:
    families: list[tuple[str, list[str]]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        x = features(text)
        margins = self.family_weights @ x
        best = int(margins.argmax())
        langs = self.families[best][1]
        votes = dict.fromkeys(langs, 0.0)
        sums = dict.fromkeys(langs, 0.0)
        for (one, other), weights in self.pair_weights.items():
            if one in votes and other in votes:
                margin = float(weights @ x)
                votes[one if margin >= 0 else other] += 1
                sums[one], sums[other] = sums[one] + margin, sums[other] - margin
        lang = max(langs, key=lambda k: (votes[k], sums[k], k))
        sure = [margins[best]] if len(self.families) > 1 else []
        sure += [sums[lang] / (len(langs) - 1)] if len(langs) > 1 else []
        return lang, float(1 / (1 + np.exp(-3 * min(sure)))) if sure else 1.0


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model of (text, lang) rows."""
    return fitted(Vectors.of([t for t, _ in rows]), [lang for _, lang in rows])


def fitted(x: Vectors, labels: list[str]) -> LanguageModel:
    """A model of vectors with their languages."""
    grouped: dict[str, list[str]] = {}
    for lang in sorted(set(labels)):
        grouped.setdefault(FAMILY.get(lang, lang), []).append(lang)
    families = sorted(grouped.items())
    every, known = np.arange(len(labels)), np.array(labels)
    ones = [fit_svm(x, every, np.where(np.isin(known, members), 1, -1)) for _, members in families] if len(families) > 1 else [np.zeros(DIMENSIONS)] * len(families)
    pairs = {}
    for _, members in families:
        for i, one in enumerate(members):
            for other in members[i + 1 :]:
                here = np.flatnonzero(np.isin(known, (one, other)))
                pairs[one, other] = fit_svm(x, here, np.where(known[here] == one, 1, -1))
    return LanguageModel(families, np.array(ones) if ones else np.zeros((0, DIMENSIONS)), pairs)


def training_sample(labelled: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS) -> tuple[Vectors, list[str]]:
    """Vectors and languages of at most ``per_lang`` rows of each language and ``most_rows`` of all, those with the smallest hashes of their ids; of rows with one id, one.

    Rows are counted first, so that only hashes under a bound leave the scan:
    a quarter more than are wanted, whatever the size of the corpus.
    """
    rows = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Vectors([]), []
    wanted = max(2, min(per_lang, most_rows // len(counts)))
    shares = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.25 * wanted / n + 20 / n))))
    rank = F.xxhash64("doc_id", F.lit(1))
    some = rows.where(F.shiftrightunsigned(rank, 1) <= F.try_element_at(shares, F.col("lang")) * float(1 << 63))
    some = some.select("lang", "text", rank.alias("_rank")).groupBy("lang", "_rank").agg(F.min("text").alias("text"))
    within = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("_rank", 1), "_rank")
    some = some.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= wanted).select("lang", "text")

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, *packed(features(t))) for lang, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True) if has_letter(t)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "places", "values"])

    vectors = map_batches(some, made, "lang string, places binary, values binary").collect()  # about 10 KB a row
    vectors.sort(key=lambda r: (r["lang"], bytes(r["places"]), bytes(r["values"])))
    return Vectors([(bytes(r["places"]), bytes(r["values"])) for r in vectors]), [r["lang"] for r in vectors]


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (``doc_id, text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dimensions x pairs, fixed

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
        langs, scores = zip(*found, strict=True)
        columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows kept from training: a remainder of 1 of the id's CRC-32. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Learn from the rows that aren't held out, predict all."""
    labelled = docs.where(~held_out() & F.col("doc_id").isNotNull())
    model = fitted(*training_sample(labelled.select("doc_id", "text", "lang"), per_lang))
    found = predict_languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
