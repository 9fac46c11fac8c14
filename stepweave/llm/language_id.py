"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound into
one vector as the product of its letters' vectors, the second rotated by one
place and the third by two; runs of other characters count as one boundary
letter. A document is the bundle (sum) of its trigrams' vectors, a language the
bundle of its training documents' unit vectors, and a document is given the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _base

DIMENSIONS = 1024
SEED = 20240607
#: Training documents of each language, about: its prototype is fitted on a sample of its labelled rows of this size.
TRAIN_ROWS = 5_000
MAX_LANGUAGES = 1024
CHUNK_CHARS = 400_000
#: Distinct trigrams that are bound at a time, counts that are held at a time, and letters whose vectors are kept.
KINDS_AT_ONCE = 4096
COUNTS_AT_ONCE = 1 << 20
LETTERS_KEPT = 20_000
#: Rows of an Arrow batch that are bundled at a time.
ROWS_AT_ONCE = 1024
UNKNOWN = "und"
#: A text of so many letters whose cosine is within so many standard deviations of a random one resembles no language.
LEAST_LETTERS = 100
SIGMAS = 4.0

_SCALE = 1 << 24
_BOUNDARY = 10
_letters: dict[str, np.ndarray] = {}
_vectors: dict[tuple[int, int], np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "is" not in _letters:
        _letters["is"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters["is"]


def _letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    if len(_vectors) > LETTERS_KEPT:
        _vectors.clear()
    out = np.zeros((len(points), dimensions), np.int8)
    for i, p in enumerate(points.tolist()):
        if (p, dimensions) not in _vectors:
            _vectors[p, dimensions] = np.random.Generator(np.random.PCG64([SEED, p])).integers(0, 2, dimensions, np.int8) * 2 - 1
        out[i] = _vectors[p, dimensions]
    return out


def _bound(kinds: np.ndarray, present: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigrams, each given as a number with its letters' codes for digits."""
    k = len(present)
    digits = kinds // (k * k), kinds // k % k, kinds % k
    used = np.unique(np.concatenate(digits))
    letters = _letter_vectors(present[used], dimensions)
    first, second, third = (np.searchsorted(used, d) for d in digits)
    out = letters[first]
    out *= np.roll(letters, 1, axis=1)[second]
    out *= np.roll(letters, 2, axis=1)[third]
    return out.astype(np.float32)


def _bundled(symbols: np.ndarray, owner: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The sums of the vectors of all runs of three symbols with one owner; trigrams are bound a slice at a time."""
    out = np.zeros((n, dimensions), np.float32)
    present = np.unique(symbols) if symbols.size < 4096 else np.flatnonzero(np.bincount(symbols))
    place = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    place[present] = np.arange(len(present))
    code, k = place[symbols], len(present)
    trigram = (code[:-2] * k + code[1:-1]) * k + code[2:]
    inside = owner[:-2] == owner[2:]
    trigram, owner = trigram[inside], owner[:-2][inside]
    if not len(trigram):
        return out
    if k**3 <= 1 << 22:
        kinds = np.flatnonzero(np.bincount(trigram, minlength=1))
        column = np.zeros(k**3 + 1, np.int64)
        column[kinds] = np.arange(len(kinds))
        trigram = column[trigram]
    else:
        kinds, trigram = np.unique(trigram, return_inverse=True)
    for begin in range(0, len(kinds), KINDS_AT_ONCE):
        own = kinds[begin : begin + KINDS_AT_ONCE]
        bound = _bound(own, present, dimensions)
        if len(own) == len(kinds):
            who, which = owner, trigram
        else:
            here = (trigram >= begin) & (trigram < begin + len(own))
            who, which = owner[here], trigram[here] - begin
        step = max(1, COUNTS_AT_ONCE // len(own))
        cuts = np.searchsorted(who, np.arange(0, n + step, step))
        for b, low in enumerate(range(0, n, step)):
            rows = min(step, n - low)
            part = slice(cuts[b], cuts[b + 1])
            counts = np.bincount((who[part] - low) * len(own) + which[part], minlength=rows * len(own))
            out[low : low + rows] += counts.astype(np.float32).reshape(rows, -1) @ bound
    return out


def bundle(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each text: the sum of its trigrams' vectors, all zero where it has no letters."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n\n".join(lower) + "\n").encode("utf-32-le"), np.uint32)
    lead = np.cumsum([0] + [len(t) + 2 for t in lower[:-1]]) if lower else np.zeros(0, np.int64)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[lead] = True
    at = np.flatnonzero(keep)
    owner = np.searchsorted(lead, at, side="right") - 1
    out = _bundled(np.where(letter[at], points[at], _BOUNDARY), owner, len(texts), dimensions)
    has = np.bincount(np.searchsorted(lead, np.flatnonzero(letter), side="right") - 1, minlength=len(texts)) > 0
    out[~has] = 0
    return out


def _long_bundle(text: str, dimensions: int) -> np.ndarray:
    """The bundle of one text, piece by piece: the last two symbols of a piece begin the next."""
    total, carried, after_letter, any_letter = np.zeros(dimensions), np.array([_BOUNDARY]), False, False
    lower = text.lower()
    for low in range(0, len(lower), CHUNK_CHARS):
        points = np.frombuffer(lower[low : low + CHUNK_CHARS].encode("utf-32-le"), np.uint32)
        letter = _is_letter()[points]
        keep = letter | np.r_[after_letter, letter[:-1]]
        symbols = np.r_[carried, np.where(letter, points, _BOUNDARY)[keep]].astype(np.int64)
        after_letter, any_letter = bool(letter[-1]), any_letter or bool(letter.any())
        if low + CHUNK_CHARS >= len(lower) and after_letter:
            symbols = np.r_[symbols, _BOUNDARY]
        total += _bundled(symbols, np.zeros(len(symbols), np.int64), 1, dimensions)[0]
        carried = symbols[-2:]
    return (total if any_letter else np.zeros(dimensions)).astype(np.float32)


def _bundles(texts: list[str | None], dimensions: int) -> np.ndarray:
    """In chunks of a bounded number of characters; a longer text in pieces of that size."""
    done, low, size = [], 0, 0

    def close(high: int) -> None:
        if high > low:
            done.append(bundle([t or "" for t in texts[low:high]], dimensions))

    for i, t in enumerate(texts):
        n = len(t or "")
        if size + n > CHUNK_CHARS:
            close(i)
            low, size = i, 0
            if n > CHUNK_CHARS:
                done.append(_long_bundle(t, dimensions)[None])
                low = i + 1
                continue
        size += n + 1
    close(len(texts))
    return np.concatenate(done) if done else np.zeros((0, dimensions), np.float32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(low, ROWS_AT_ONCE)


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        vectors = _bundles(texts, self.prototypes.shape[1])
        norm = np.linalg.norm(vectors, axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = (vectors @ self.prototypes.T.astype(np.float32)) / np.maximum(norm, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        known = norm > 0
        score = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], score.astype(np.float64)

    def resembles(self, texts: list[str | None], least_letters: int = LEAST_LETTERS, sigmas: float = SIGMAS) -> np.ndarray:
        """Whether each text may be of a known language: it has letters, and is short or has a cosine that chance doesn't explain; without languages, whether it has letters."""
        names, score = self.predict(texts)
        floor = sigmas / math.sqrt(self.prototypes.shape[1])
        letters = lambda t: sum(map(str.isalpha, t or ""))
        if not self.languages:
            return np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        return np.array([name != UNKNOWN and (s >= floor or letters(t) < least_letters) for name, s, t in zip(names, score.tolist(), texts)], bool)


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id) if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, train_rows: int = TRAIN_ROWS, key: str = "doc_id") -> Profiles:
    """Prototypes from rows with a non-null language; ``und`` is none.

    train_rows bounds the sample of each language (in expectation; rows are
    taken by a hash of the key, all of them if there are fewer). Sums are of
    integers, so the prototypes don't depend on the order of rows. Rows without
    letters and empty tables add nothing; without any language the profiles
    predict ``und``. The model holds a prototype for each language: more than
    MAX_LANGUAGES are an error.
    """
    _base.require(docs, text, lang, key)
    name = F.col(lang).cast("string")
    labelled = docs.where(name.isNotNull() & (name != UNKNOWN) & F.col(text).isNotNull()).select(F.col(text).alias("text"), name.alias("lang"), F.xxhash64(F.lit(SEED), key).alias("at"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    many = {x: int((1 << 30) * train_rows / n) for x, n in sizes.items() if n > train_rows}
    if many:
        limit = F.create_map(*[F.lit(v) for pair in many.items() for v in pair])
        labelled = labelled.where(F.pmod("at", F.lit(1 << 30)) < F.coalesce(limit[F.col("lang")], F.lit(1 << 30)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in _slices(batches):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            vectors = _bundles(texts, dimensions)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
            for name in set(langs):
                total[name] = total.get(name, 0) + np.rint(vectors[langs == name] * _SCALE).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["language", "vector"])

    parts = labelled.select("text", "lang").mapInArrow(sums, "language string, vector array<long>")
    # One row for each language and dimension, added where it lies.
    rows = parts.select("language", F.posexplode("vector").alias("place", "v")).groupBy("language", "place").agg(F.sum("v").alias("v")).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("vector")).collect()
    found = {r["language"]: np.array([x["v"] for x in r["vector"]], np.float64) for r in rows}
    names = tuple(sorted(x for x, v in found.items() if np.any(v)))
    unit = [found[x] / np.linalg.norm(found[x]) for x in names]
    return Profiles(names, np.stack(unit) if unit else np.zeros((0, dimensions)))


def identify_language(docs: DataFrame, profiles: Profiles, text: str = "text", output: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns in ``output`` (all by default); columns of these names are replaced.

    A text that is null or has no letters gives ``und`` and score 0. Rows stay
    as they are in number and place; an empty table gives an empty result.
    """
    _base.require(docs, text)
    kept = [c for c in (docs.columns if output is None else output) if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    source = docs.select(*kept, F.col(text).alias(_base.fresh(docs, "its_text")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, score = profiles.predict(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(predict, schema)


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text", least_letters: int = LEAST_LETTERS, sigmas: float = SIGMAS) -> DataFrame:
    """The rows that may be of a known language, with all their columns, whatever these are named.

    Rows go whose text is null or has no letters, and those of least_letters
    letters or more whose best cosine is under sigmas / sqrt(dimensions), that
    is, no larger than that of random letters may be. Short texts stay, and
    without any known language all that have a letter do. Repeated rows go or
    stay together; an empty table gives an empty result.
    """
    _base.require(docs, text)
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield batch.filter(pa.array(profiles.resembles(batch.column(place).to_pylist(), least_letters, sigmas), pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; profiles are fitted on the documents that aren't held out."""
    docs = _base.table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id").cast("string")))
    profiles = fit_profiles(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify_language(docs, profiles, output=["doc_id", "held_out"])
