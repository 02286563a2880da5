"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. The vector of an n-gram binds (multiplies) its letters'
vectors, each permuted (rotated) once more than the letter after it; the vectors of all n-grams of a text
are bundled (added) into its profile. A language's prototype is the bundle of its learning texts'
normalised profiles, and a text has the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import blocks

DIMENSIONS, GRAM = 1024, 3
#: Most texts that a language's prototype is learned from; a hash of the id picks them.
MOST_TEXTS = 4_000
#: Language of a text without letters.
NO_LANGUAGE = "und"
#: Texts profiled together, and n-grams whose vectors are held at once.
TEXTS, GRAMS = 256, 4096


@lru_cache(maxsize=8192)
def _letter(code: int, dimensions: int) -> np.ndarray:
    return np.where(np.random.default_rng([code, 77]).random(dimensions) < 0.5, np.float32(-1), np.float32(1))


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of n-grams given as rows of code points: rotated letters' vectors, multiplied."""
    out = np.ones((len(grams), dimensions), np.float32)
    for k, column in enumerate(grams.T):
        codes, place = np.unique(column, return_inverse=True)
        vectors = np.stack([np.roll(_letter(int(c), dimensions), grams.shape[1] - 1 - k) for c in codes])
        out *= vectors[place]
    return out



class _Spaces(dict):
    """Maps a character that is no letter to a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


_TO_LETTERS = _Spaces()


def profiles(texts: list[str], dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Profiles of texts, each of length 1, and whether a text has a letter (else its profile is 0)."""
    out = np.zeros((len(texts), dimensions), np.float32)
    plain = [" ".join(t.lower().translate(_TO_LETTERS).split()) for t in texts]
    some = np.array([bool(p) for p in plain], bool)
    if not some.any():
        return out, some
    joined = "\n".join(f" {p} " for p in plain)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.cumsum(codes == 10)
    alphabet, small = np.unique(codes, return_inverse=True)
    if len(alphabet) > 0xFFFF:
        small = small.astype(np.uint64)
    n = len(codes) - gram + 1
    key = np.zeros(n, np.uint64)
    clean = np.ones(n, bool)
    for k in range(gram):
        key = key * np.uint64(len(alphabet)) + small[k : k + n].astype(np.uint64)
        clean &= codes[k : k + n] != 10
    key, owner = key[clean], owner[:n][clean]
    kinds, place = np.unique(key, return_inverse=True)
    for low in range(0, len(kinds), GRAMS):
        part = kinds[low : low + GRAMS]
        grams = np.stack([(part // np.uint64(len(alphabet) ** (gram - 1 - k))) % np.uint64(len(alphabet)) for k in range(gram)], 1)
        vectors = gram_vectors(alphabet[grams.astype(np.int64)], dimensions)
        here = (place >= low) & (place < low + GRAMS)
        counts = np.bincount(owner[here] * len(part) + (place[here] - low), minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ vectors
    sizes = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(sizes > 0, sizes, 1), some


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        for at in range(0, block.num_rows, TEXTS):
            yield block.slice(at, TEXTS)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, most: int = MOST_TEXTS) -> dict[str, np.ndarray]:
    """Prototype of each language in ``labelled`` (doc_id, text, lang), from at most about ``most`` texts of each.

    Rows without text or language teach nothing. The driver gets one vector for each language and task
    of a bounded sample.
    """
    known = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most / n))])
    chosen = known.filter(
        F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in _groups(batches):
            found, _ = profiles(block.column("text").to_pylist(), dimensions)
            langs = np.array(block.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + found[langs == lang].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()])], ["lang", "bundle"]
            )

    total: dict[str, np.ndarray] = {}
    for row in chosen.mapInArrow(run, "lang string, bundle binary").toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["bundle"], np.float64)
    return {k: (v / n).astype(np.float32) for k, v in sorted(total.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """Language of each text of ``docs`` (doc_id, text): doc_id, lang_pred, score (cosine, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    Of equal cosines the language first in order wins. Other columns are ignored, rows are kept.
    """
    langs = np.array([*prototypes, NO_LANGUAGE], object)
    matrix = np.stack(list(prototypes.values()), 1) if prototypes else np.zeros((dimensions, 0), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches):
            found, some = profiles(block.column("text").fill_null("").to_pylist(), dimensions)
            cosine = np.concatenate([(found @ matrix).astype(np.float64), np.full((len(found), 1), -2.0)], 1)
            best = np.where(some, cosine.argmax(1), len(langs) - 1)
            score = np.where(best < len(langs) - 1, cosine[np.arange(len(found)), best].clip(0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(langs[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
