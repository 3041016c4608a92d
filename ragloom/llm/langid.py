"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, found by its code point. A letter trigram is the product of its letters' vectors, rotated by two, one and no places
(binding by permutation); a text is the sum of its trigrams' vectors (bundling); a language's prototype is the sum over its training
documents. A document gets the language whose prototype has the highest cosine with it, after the mean of the unit
prototypes, which all languages share, has been taken off both sides.

Training reads every labelled document: each task bundles its own rows into one integer vector per language, and Spark adds these
up by language and dimension (integers, so the order of tasks doesn't matter). What reaches the driver is one vector
for each language, at most ``MAX_LANGUAGES``. A task holds counts for ``HELD`` languages at a time and passes its sums on when there are more.

``keep_identified`` rejects texts that are in none of the learned languages: the cosine of a text in another one with every prototype (before the mean is taken off)
is what chance gives, near 0, so a text of ``LEAST_TRIGRAMS`` or more whose best is under ``LEAST_COSINE`` goes. Shorter texts stay, as they can't be told from chance.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if no document could be learned from;
equal texts get equal predictions; a null doc_id is not held out and not learned from; a null lang is not learned from; an empty table gives an
empty result. Only doc_id, text and lang are read. Whole texts are used, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.session import fresh

DIMENSIONS = 512
SEED = 20
# Letters beyond a-z with symbols of their own; they are the common ones of Western European languages.
ACCENTED = "\u00e0\u00e1\u00e2\u00e4\u00e7\u00e8\u00e9\u00ea\u00eb\u00ed\u00ee\u00ef\u00f1\u00f3\u00f4\u00f6\u00fa\u00fb\u00fc\u00df\u0153"
#: Symbols: 0 for what is no letter, 1-26 for a-z, then the accented letters, whose trigrams have a table of vectors; all further letters share the rest by a hash of the code point.
TABLED, SYMBOLS = 27 + len(ACCENTED), 1 << 12
MAX_LANGUAGES = 1024
HELD = 64
CHUNK = 1 << 20
#: Distinct trigrams whose vectors are made at a time.
SLICE = 1 << 12
LEAST_COSINE, LEAST_TRIGRAMS = 0.08, 40


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The symbol of every code point."""
    table = np.zeros(0x110000, dtype=np.int64)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], dtype=np.int64)
    table[letters] = TABLED + (letters * 2654435761 >> 7) % (SYMBOLS - TABLED)
    table[np.arange(ord("a"), ord("z") + 1)] = np.arange(1, 27)
    table[[ord(c) for c in ACCENTED]] = np.arange(27, TABLED)
    return table


@lru_cache(maxsize=1)
def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols' vectors as first, second and third letter of a trigram."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


@lru_cache(maxsize=1)
def _tabled_vectors() -> np.ndarray:
    first, second, third = (x[:TABLED] for x in _letter_vectors())
    return (first[:, None, None] * second[None, :, None] * third[None, None]).reshape(-1, DIMENSIONS)


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """The trigram codes of a text, a chunk at a time; runs of other characters count as one gap."""
    if not text:
        return
    last = np.zeros(1, dtype=np.int64)
    for low in range(0, len(text), CHUNK):
        codes = _symbols()[np.frombuffer(text[low : low + CHUNK].lower().encode("utf-32-le", "replace"), dtype="<u4")]
        ends = [0] if low + CHUNK >= len(text) else []
        codes = np.concatenate((last, codes, np.array(ends, dtype=np.int64)))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        if len(codes) > 2:
            yield (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]
        last = codes[-2:]


def _letters_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS


def _table_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which trigrams have a tabled vector, and the places of these in the table."""
    a, b, c = _letters_of(codes)
    tabled = (a < TABLED) & (b < TABLED) & (c < TABLED)
    return tabled, ((a * TABLED + b) * TABLED + c)[tabled]


def _vectors_of(codes: np.ndarray) -> np.ndarray:
    first, second, third = _letter_vectors()
    a, b, c = _letters_of(codes)
    return first[a] * second[b] * third[c]


def _bundled(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of distinct trigrams, each as often as it is counted; exact, as all partial sums are integers under 2^53."""
    total = np.zeros(DIMENSIONS)
    tabled, places = _table_places(codes)
    for rows, times, vectors in ((places, counts[tabled], _tabled_vectors().__getitem__), (codes[~tabled], counts[~tabled], _vectors_of)):
        for low in range(0, len(rows), SLICE):
            part = slice(low, low + SLICE)
            # Sums of up to 2^24 are exact in single precision, and a chunk has 2^20 trigrams.
            total += times[part].astype(np.float32) @ vectors(rows[part]).astype(np.float32)
    return total


def bundle(text: str | None) -> tuple[np.ndarray, int] | None:
    """The hyperdimensional vector of a text and its number of trigrams, None without a letter."""
    total, size = np.zeros(DIMENSIONS), 0
    letters = False
    for chunk in trigrams(text):
        codes, counts = np.unique(chunk, return_counts=True)
        letters = letters or bool(codes.any())
        total += _bundled(codes, counts)
        size += len(chunk)
    return (total, size) if letters else None


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, folds: int = 5, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each language, from the documents outside fold 0."""
    labelled = docs.where((fold(F.col("doc_id"), folds) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # counts of tabled trigrams, and the sum of the others' vectors

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (own, rest) in held.items():
                total = rest.astype(np.int64)
                used = np.flatnonzero(own)
                for low in range(0, len(used), SLICE):
                    part = used[low : low + SLICE]
                    total += own[part] @ _tabled_vectors()[part].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()])], names=["lang", "v"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held and len(held) >= HELD:
                    yield from passed_on()
                own, rest = held.setdefault(lang, (np.zeros(TABLED**3, dtype=np.int64), np.zeros(DIMENSIONS)))
                for codes in trigrams(text.as_py()):
                    tabled, places = _table_places(codes)
                    own += np.bincount(places, minlength=len(own))
                    own[0] = 0
                    if len(places) < len(codes):
                        rest += _bundled(*np.unique(codes[~tabled], return_counts=True))
        yield from passed_on()

    parts = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(gather, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = sums.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    if len(found) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    prototypes: dict[str, np.ndarray] = {}
    for row in found:
        prototypes.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["k"]] = row["x"]
    return {lang: prototypes[lang] for lang in sorted(prototypes) if prototypes[lang].any()}


class Profiles:
    """Prototypes ready for comparison."""

    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.langs = list(prototypes)
        units = np.array([v / np.linalg.norm(v) for v in prototypes.values()]).reshape(len(self.langs), DIMENSIONS)
        self.plain = units
        self.mean = units.mean(axis=0) if len(self.langs) > 1 else np.zeros(DIMENSIONS)
        centred = units - self.mean
        self.units = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, cosine with the nearest prototype, and the text's number of trigrams."""
        found = bundle(text) if self.langs else None
        if found is None:
            return "und", 0.0, 0.0, 0
        vector, size = found
        unit = vector / max(float(np.linalg.norm(vector)), 1e-12)
        plain = float((self.plain @ unit).max())
        unit = unit - self.mean
        cosines = self.units @ (unit / max(float(np.linalg.norm(unit)), 1e-12))
        best = int(np.argmax(cosines))
        return self.langs[best], min(1.0, max(0.0, (1.0 + float(cosines[best])) / 2.0)), plain, size


def predictor(prototypes: dict[str, np.ndarray]):
    """A column function: text -> struct<lang, score, cosine, size>."""
    profiles = Profiles(prototypes)

    @F.arrow_udf("lang string, score double, cosine double, size long")
    def identify(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t.as_py()) for t in texts]
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["lang", "score", "cosine", "size"])

    return identify


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``: a row for each row of ``docs``."""
    guess = predictor(train(docs, folds))
    found = docs.select("doc_id", guess(F.col("text").cast("string")).alias("x"))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def keep_identified(docs: DataFrame, least_cosine: float = LEAST_COSINE, least_trigrams: int = LEAST_TRIGRAMS, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages: not ``und``, and not a text of ``least_trigrams`` or more without a cosine of ``least_cosine`` to any."""
    guess = predictor(train(docs, folds))
    name = fresh("language", docs)
    found = docs.withColumn(name, guess(F.col("text").cast("string")))
    known = (F.col(f"{name}.cosine") >= least_cosine) | (F.col(f"{name}.size") < least_trigrams)
    return found.where((F.col(f"{name}.lang") != "und") & known).select(*docs.columns)
