"""Quality rules by tokeniser fertility.

Every whole text is split into words, the words are encoded with a public
vocabulary, and three figures of the tokens are held against a band:
characters per token, the share of byte-fallback tokens, and the entropy of
the token distribution in bits. Counting rules on words come first.

Bands are fitted to the corpus, for each language, or for the script where a
language has fewer than ``LEAST_ROWS`` rows, and within it for short, middle
and long texts (``LENGTHS`` in tokens), since entropy grows with length. A band
is the median and ``REACH`` robust deviations (quartile range / 1.349) on
either side; of all rows that pass the counting rules, none is left out.
Figures are rounded to thousandths first, so the exact quartiles of any number
of rows need a bounded state. Where the script has too few rows too, ``BANDS``
holds, wide limits that only tell text from noise.

1. One pass makes the figures of every row; they are written, and the texts
   with them only if the caller wants the rows back.
2. An aggregation of a few rows per language gives the bands.
3. They are joined to the figures by a broadcast, if they are as few as that.

Defined results: a null text counts as no words; a text without words fails
the base rules and is left out of the bands; null languages are judged by
script; repeated rows are judged one by one; an empty table gives an empty
result; other columns are returned by ``quality_filter`` as they are, whatever
their names, and not looked at otherwise.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import byte_lengths, documents, numbered, of_arrays, shielded, slices, small_enough, staged
from tidemill.llm.wordcache import WordCache, kept

TOKENIZER = "piece_bpe_32k.model"
#: Tokens from which on a text is of middle length, and long.
LENGTHS = (256, 1024)
LEAST_ROWS = 30
REACH = 4.0
#: Least deviation of each figure, so that a corpus without any spread rejects nothing by rounding.
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.01, "token_entropy": 0.05}


@dataclass(frozen=True)
class Band:
    """Limits outside of which a text is rejected."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float


#: Where nothing can be fitted. Scripts that a wide-coverage vocabulary spells with few characters a token have wider bands.
BANDS = {
    "latin": Band((1.25, 8.0), 0.20, 3.5),
    "cyrillic": Band((0.9, 7.0), 0.25, 3.5),
    "greek": Band((0.6, 6.0), 0.35, 3.5),
    "cjk": Band((0.25, 3.0), 0.80, 3.5),
    "other": Band((0.2, 6.0), 0.95, 3.0),
}

#: In the order of the numbers that _byte_classes() gives to first bytes of letters.
_SCRIPTS = ("latin", "cyrillic", "greek", "cjk", "other")

_FIGURES = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("script", pa.string()),
    ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()),
]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def _byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.ones(256, bool)
    starts[0x80:0xC0] = False  # continuation bytes are no code points of their own
    starts[[0x20, *range(0x09, 0x0E)]] = False  # nor are these word characters
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in "#*$%&|<>"]] = True
    script = np.full(256, -1, np.int8)
    script[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = 0
    script[[*range(0xD0, 0xD4)]] = 1
    script[[0xCD, 0xCE, 0xCF]] = 2
    script[[*range(0xE3, 0xEE)]] = 3
    script[[*range(0xD4, 0xE3), *range(0xEE, 0xF5)]] = 4
    return starts, symbols, script


_STARTS, _SYMBOLS, _SCRIPT = _byte_classes()


def repeated_words(numbers: np.ndarray, size: int) -> int:
    """Words that stand in a window of three which the text has twice or more."""
    if len(numbers) < 4:
        return 0
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    if size < 1 << 21:
        windows = (a * size + b) * size + c
    else:
        pairs = np.unique(a * size + b, return_inverse=True)[1]
        windows = pairs * size + c
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[place] > 1
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])

    def encode(words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        return [array("i", ids).tobytes() for ids in model.encode(texts, num_threads=1)]

    return encode, is_byte


def _figures(model_path: str):
    """A column function: the figures of a text, a struct of _SCHEMA."""

    def figures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, is_byte = kept((__name__, model_path), lambda: _encoder(model_path))
        words = WordCache(encode)  # of this task
        for batch in batches:
            parts = []
            for lo, hi in slices(byte_lengths(batch), 2_000_000):
                texts = [t or b"" for t in batch.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                words.trim()
                found = [[words[w] for w in t.split()] for t in texts]
                words.fill()
                rows = [_of_text(text, numbers, words, is_byte) for text, numbers in zip(texts, found, strict=True)]
                columns = [pa.array(list(c), k) for c, (_, k) in zip(zip(*rows, strict=True), _FIGURES, strict=True)]
                parts.append(pa.StructArray.from_arrays(columns, [n for n, _ in _FIGURES]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_FIGURES))

    return of_arrays(figures, _SCHEMA)


def _of_text(text: bytes, numbers: list[int], words: WordCache, is_byte: np.ndarray) -> tuple:
    raw = np.frombuffer(text, np.uint8)
    chars = int(_STARTS[raw].sum())
    lines = [x for x in text.split(b"\n") if x.strip()] if text else []
    repeats = repeated_words(np.asarray(numbers, np.int64), len(words))
    kinds = _SCRIPT[raw]
    script = _SCRIPTS[int(np.bincount(kinds[kinds >= 0], minlength=5).argmax())] if numbers else None
    tokens = np.frombuffer(b"".join([words.ids[i] for i in numbers]), np.int32)
    per_token = byte_share = entropy = 0.0
    if len(tokens):
        tokens = np.sort(tokens)
        ends = np.append(np.flatnonzero(tokens[1:] != tokens[:-1]), len(tokens) - 1)
        share = np.diff(ends, prepend=-1) / len(tokens)
        entropy = float(-(share * np.log2(share)).sum())
        per_token = chars / len(tokens)
        byte_share = float(is_byte[tokens].mean())
    return len(numbers), chars, int(_SYMBOLS[raw].sum()), len(lines) - len(set(lines)), repeats, script, len(tokens), per_token, byte_share, entropy


def _model_path(tokenizer: str | None) -> str:
    from public_tokenizers import path

    return tokenizer or path(TOKENIZER)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _length_class(n_tokens: Column) -> Column:
    return sum((F.when(n_tokens >= n, 1).otherwise(0) for n in LENGTHS), F.lit(0))


def fertility_bands(figures: DataFrame) -> DataFrame:
    """``kind, name, length, n`` and the limits ``low_cpt, high_cpt, high_bytes, low_entropy``, for languages and scripts with rows enough.

    ``figures`` has the columns of ``quality_features`` before judgement and ``lang``.
    """
    names = F.array(
        F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("name")), F.struct(F.lit("script").alias("kind"), F.col("script").alias("name"))
    )
    rows = figures.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = rows.select(*LEAST_SPREAD, _length_class(F.col("n_tokens")).alias("length"), F.inline(names)).where("name is not null")
    quartiles = [F.percentile(F.round(c, 3), [0.25, 0.5, 0.75]).alias(c) for c in LEAST_SPREAD]
    fitted = rows.groupBy("kind", "name", "length").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= LEAST_ROWS)
    reach = {c: REACH * F.greatest((F.get(F.col(c), F.lit(2)) - F.get(F.col(c), F.lit(0))) / 1.349, F.lit(least)) for c, least in LEAST_SPREAD.items()}
    middle = {c: F.get(F.col(c), F.lit(1)) for c in LEAST_SPREAD}
    return fitted.select(
        "kind", "name", "length", "n",
        (middle["chars_per_token"] - reach["chars_per_token"]).alias("low_cpt"), (middle["chars_per_token"] + reach["chars_per_token"]).alias("high_cpt"),
        (middle["byte_share"] + reach["byte_share"]).alias("high_bytes"), (middle["token_entropy"] - reach["token_entropy"]).alias("low_entropy"),
    )


_LIMITS = ("low_cpt", "high_cpt", "high_bytes", "low_entropy")


def _judged(figures: DataFrame, bands: dict[str, Band] | None) -> DataFrame:
    """``figures`` with ``base_failed``, ``failed`` (names of the figures outside their band) and ``kept``."""
    fixed = bands or BANDS
    default = {s: fixed.get(s, fixed["other"]) for s in _SCRIPTS}

    def limit(of) -> Column:
        out = F.lit(of(default["other"]))
        for script, band in default.items():
            out = F.when(F.col("script") == script, F.lit(of(band))).otherwise(out)
        return out

    wide = {
        "low_cpt": limit(lambda b: b.chars_per_token[0]), "high_cpt": limit(lambda b: b.chars_per_token[1]),
        "high_bytes": limit(lambda b: b.byte_share), "low_entropy": limit(lambda b: b.entropy),
    }
    rows = figures.withColumn("_tm_length", _length_class(F.col("n_tokens")))
    chosen = wide
    if bands is None:
        fitted = staged(fertility_bands(figures), "bands")
        for kind in ("lang", "script"):
            own = fitted.where(F.col("kind") == kind).select(F.col("name").alias(f"_tm_{kind}"), F.col("length").alias("_tm_l"), *(F.col(c).alias(f"_tm_{kind}_{c}") for c in _LIMITS))
            rows = rows.join(small_enough(own), (F.col(kind) == F.col(f"_tm_{kind}")) & (F.col("_tm_length") == F.col("_tm_l")), "left").drop(f"_tm_{kind}", "_tm_l")
        chosen = {c: F.coalesce(f"_tm_lang_{c}", f"_tm_script_{c}", wide[c]) for c in _LIMITS}
    outside = F.array_compact(F.array(
        F.when(~F.col("chars_per_token").between(chosen["low_cpt"], chosen["high_cpt"]), "chars_per_token"),
        F.when(F.col("byte_share") > chosen["high_bytes"], "byte_share"),
        F.when(F.col("token_entropy") < chosen["low_entropy"], "token_entropy"),
    ))
    rows = rows.withColumns({"base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words")), "failed": outside})
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return rows.drop(*(c for c in rows.columns if c.startswith("_tm_") and c != "_tm_row"))


_COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy",
)


def quality_features(docs: DataFrame, tokenizer: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """One row per document with every figure, ``base_failed``, ``kept`` and ``failed`` (figures outside their band, comma-joined).

    ``docs`` needs ``doc_id, text, lang``. ``tokenizer`` is the path of a
    SentencePiece model with byte fallback; ``bands`` by script replace the fitted ones.
    """
    rows = documents(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), "lang", _figures(_model_path(tokenizer))("text").alias("_tm_f"))
    figures = staged(rows.select("doc_id", "lang", "_tm_f.*"), "figures")
    return _judged(figures, bands).select(*_COLUMNS, F.array_join("failed", ",").alias("failed"))


def quality_filter(docs: DataFrame, tokenizer: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    own, names = shielded(docs)
    rows = staged(numbered(own, "_tm_row").withColumn("_tm_f", _figures(_model_path(tokenizer))("text")), "quality")
    figures = rows.select("_tm_row", "lang", "_tm_f.*")
    gone = staged(_judged(figures, bands).where("not kept").select("_tm_row"), "rejected")
    return rows.drop("_tm_f").join(small_enough(gone), "_tm_row", "left_anti").drop("_tm_row").withColumnsRenamed(names)
