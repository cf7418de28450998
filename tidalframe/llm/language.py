"""Language identification by bitmask n-gram filters.

Training counts the letter trigrams of every labelled text, keeps for each
language those that it uses often (at least RARE of its trigrams, and at least
SHARED of the share that they have in the language that uses them most), and puts
them into one Bloom filter that holds a bitmask of languages in every slot: slot by
slot, bit l is the Bloom filter of language l.  Looking a trigram up reads
its PROBES slots and ANDs them: the bits left are all languages that contain it.
A text is decided by how many of its trigrams each language contains, less the
part that the filter's own false positives explain.

A language keeps at most 1 / RARE trigrams, which bounds what the driver collects
and what each task holds; everything else is one map over the texts and a sum by
(language, trigram).

Defined cases: a null text, or one without a letter, is `und` with score 0; a null
language trains nothing; ties go to the smaller language; with nothing learned
everything is `und`; a null id belongs to the held-out part (the CRC of the empty
text is 0); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import chunks, mix

RARE = 1e-5
SHARED = 0.1
PROBES = 3
SLOTS = 1 << 20
#: Characters worked on at once; the arrays for them take about 60 bytes a character.
CHUNK = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams, the text of each, whether each text has a letter).

    Texts are lower-cased, what is no letter counts as a space, and runs of them as one; a
    trigram is its three code points in 63 bits, and holds at least two letters.
    """
    joined = "".join(f" {t.lower()} " if t else "  " for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 if t else 2 for t in texts])
    letter = _letters()[cps]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cps, owner, letter = np.where(letter, cps, 32)[keep], owner[keep], letter[keep]
    if len(cps) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), has
    grams = (cps[:-2] << 42) | (cps[1:-1] << 21) | cps[2:]
    good = (owner[:-2] == owner[2:]) & (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2)
    return grams[good], owner[:-2][good], has


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    slots: np.ndarray  # (number of slots, words of 64 languages) of masks
    false: np.ndarray  # each language's chance that a trigram it lacks passes

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each trigram the bitmask of all languages that contain it."""
        out = None
        for p in probes(grams, len(self.slots)):
            out = self.slots[p] if out is None else out & self.slots[p]
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts = [self._decide(texts[lo:hi]) for lo, hi in chunks(texts, CHUNK)]
        return [x for p in parts for x in p[0]], np.concatenate([np.zeros(0), *(p[1] for p in parts)])

    def _decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, owner, has = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        masks = self.masks(grams)
        hits = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(owner, weights=bit.astype(np.float64), minlength=len(texts))
        sure = np.maximum(0, (hits - n[:, None] * self.false) / (1 - self.false)) if len(self.languages) else hits
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = sure.argmax(1)
        total = sure.sum(1)
        score = np.where(has & (total > 0), sure.max(1) / np.maximum(total, 1e-9), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score


def probes(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = mix(grams.view(np.uint64) if grams.dtype == np.int64 else grams)
    step = (h >> np.uint64(40)) | np.uint64(1)
    for _ in range(PROBES):
        yield (h & np.uint64(slots - 1)).astype(np.int64)
        h = h + step


def build(kept: pd.DataFrame, slots: int = SLOTS) -> Model:
    """kept: lang, gram."""
    languages = tuple(sorted(kept["lang"].unique()))
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    filled = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        own = np.zeros(slots, dtype=bool)
        for p in probes(kept.loc[kept["lang"] == lang, "gram"].to_numpy(dtype=np.int64), slots):
            own[p] = True
        table[own, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        filled[i] = own.mean()
    return Model(languages, table, np.minimum(filled**PROBES, 0.99))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(common.id_text(key).cast("binary")) % 5 == 0


def learn(docs: DataFrame, rare: float = RARE, shared: float = SHARED, slots: int = SLOTS) -> Model:
    """From the text and lang of every row of docs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[pd.Series]] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                texts, old = part["text"].tolist(), held.setdefault(lang, [])
                for lo, hi in chunks(texts, CHUNK):
                    grams, times = np.unique(trigrams(texts[lo:hi])[0], return_counts=True)
                    old.append(pd.Series(times, index=grams))
                    if sum(map(len, old)) > 500_000:
                        old[:] = [pd.concat(old).groupby(level=0).sum()]
        for lang, parts in held.items():
            s = pd.concat(parts).groupby(level=0).sum()
            yield pd.DataFrame({"lang": lang, "gram": s.index.to_numpy(dtype=np.int64), "c": s.to_numpy(dtype=np.int64)})

    used = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = common.stored(used.mapInPandas(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), "trigrams", narrow=True)
    totals = common.small(sums.groupBy("lang").agg(F.sum("c").alias("total")))
    often = sums.join(totals, "lang").select("lang", "gram", (F.col("c") / F.col("total")).alias("p")).where(F.col("p") >= rare)
    most = often.groupBy("gram").agg(F.max("p").alias("most"))
    kept = often.join(most, "gram").where(F.col("p") >= shared * F.col("most")).select("lang", "gram")
    return build(kept.toPandas(), slots)


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column of struct<lang_pred, score> over docs' text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    @F.pandas_udf("lang_pred string, score double")
    def decided(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = shipped.value.decide([None if t is None else t for t in b])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return decided(docs[text])


def op7_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), predict(docs, model).alias("_p")).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


QUERIES = {"op7_language_filters": op7_language_filters}
ORACLES: dict[str, str] = {}
