"""Cost-balanced packing of documents into token sequences.

A document is its token ids and an end id.  What fills a whole sequence is cut
off first; the rest of each document, in groups of about GROUP documents,
goes in descending length to the sequence of lowest cost with room for it, where
a piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention).  A group
opens just as many sequences as its tokens need; a piece that no longer fits
anywhere is cut at the room of the cheapest sequence.  So a group wastes less
than one sequence.

Only lengths and checksums of whole cuts travel for full sequences; the ids of the
rests travel to their group (2 bytes an id for vocabularies under 65,536).

A document's group comes from a hash of its row's number in the table, so repeated rows and null
ids are spread like any others, and one table gives one packing.

Defined cases: a null text is an empty text, whose one id is the end id; repeated
rows are separate documents; pieces of one length are taken by id, start and checksum; a
long text is tokenized as a whole and leaves as many full sequences as it fills; an empty
table gives an empty result; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 1
GROUP = 1024
LINEAR = 1.0
QUADRATIC = 1.0 / CAPACITY

#: Stands for a null id.
_NONE = -(1 << 63)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> ids of the byte-level BPE tokenizer in `path` (a tokenizers file).

    Ordinary texts take a faster implementation of the same merges; texts that name an added token, and
    any that it refuses, take the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        return plain
    # The byte-level alphabet (printable bytes stand for themselves, the others follow from 256) and the usual word pattern.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # it panics on white space of millions of characters
            return plain(text)

    return encode


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def tokenized(docs: DataFrame, path: str, capacity: int, end_id: int, groups: int) -> DataFrame:
    """A row for each full cut (its checksum) and for each rest (its ids)."""
    dtype = "<u2" if max(_vocabulary(path), end_id + 1) <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                rows = []
                for doc_id, text, group in batch.iloc[lo : lo + 500].itertuples(index=False, name=None):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    n = len(ids)
                    for start in range(0, n, capacity):
                        part = ids[start : start + capacity]
                        full = len(part) == capacity
                        rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), n, b"" if full else part.astype(dtype).tobytes(), group))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "grp"])

    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp")
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id")  # whole numbers stay whole in pandas
    return docs.select(named, "text", group).mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, grp long")


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for items of descending length under capacity."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    room = np.full(n, capacity, dtype=np.int64)
    cost = np.zeros(n)
    out = []
    for i, length in enumerate(lengths.tolist()):
        start = 0
        while length:
            fits = room >= length
            s = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(length, int(room[s]))
            out.append((i, start, take, s, capacity - int(room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start, length = start + take, length - take
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = GROUP) -> DataFrame:
    """PIECES for every document of docs (doc_id, text)."""
    path = tokenizer or default_tokenizer()
    dtype = "<u2" if max(_vocabulary(path), end_id + 1) <= 1 << 16 else "<u4"
    groups = max(1, -(-docs.count() // group_rows))

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        base = int(g["grp"].iloc[0]) << 32
        n_full = int((g["length"] == capacity).sum())
        full, rest = g.iloc[:n_full], g.iloc[n_full:]
        whole = full[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=base + np.arange(n_full), offset=0)
        at = assign(rest["length"].to_numpy(), capacity)
        i, start, take, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, dtype=np.int64),) * 5
        part = rest.iloc[i]
        crc = [
            old if take_ == length else zlib.crc32(np.frombuffer(ids, dtype=dtype)[s : s + take_].astype("<u4").tobytes())
            for old, length, ids, s, take_ in zip(part["ids_crc32"], part["length"], part["ids"], start, take, strict=True)
        ]
        cut = part[["doc_id", "start", "doc_tokens"]].assign(start=part["start"].to_numpy() + start, length=take, ids_crc32=crc, sequence_id=base + n_full + seq, offset=offset)
        return pd.concat([whole, cut])[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    out = tokenized(docs, path, capacity, end_id, groups).groupBy("grp").applyInPandas(fill, PIECES)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NONE)))


def op9_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))


QUERIES = {"op9_cost_packing": op9_cost_packing}
ORACLES: dict[str, str] = {}
