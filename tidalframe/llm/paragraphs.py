"""Substring dedup: repeated paragraphs of whole texts by MinHash banding.

Paragraphs are cut by content, not by line breaks, so that a passage gives the same ones
wherever it stands.  A shingle (5 words) whose hash is the least of WINDOW neighbours is an
anchor; the LENGTH words about it are a paragraph.  Every run of more than LENGTH words
holds an anchor whose paragraph reaches at most OUT words out of the run, so the paragraphs
of two documents that share the run have a Jaccard similarity of 0.75 or more.  Then

1.  paragraphs of one anchor meet by the bands of their MinHash; bands() picks the number
    of bands for the recall asked for at the threshold.  Those that meet no other go.
    The shingles of the rest are taken from one text each, which comes to its paragraphs
    by a key noted at first: a task gets no table of all of them;
2.  exact Jaccard similarity of their shingles decides, and components of links are
    clusters; equal paragraphs are one from the start.  Paragraphs of different anchors never
    meet, so an anchor's clusters are found where its candidates are gathered.  Those that
    link have one of their rarest shingles in common: so a passage with ever other
    surroundings, whose paragraphs share just too little, gives no pairs.  An
    anchor of more than GROUP candidates is linked in many tasks (setjoin);
3.  paragraphs of clusters over two documents or more are put together where they overlap.
    In each cluster the first occurrence (smallest document, then place) stays, all others
    are removals.

So a span can reach OUT words out of what two documents share, or fall as short of it, and
documents that share LENGTH - OUT words can meet already.

Defined cases: every row is a document; null, empty and short texts (under LENGTH - OUT
words) have no paragraphs; repeated rows are copies of each other, of which any one
stays; null ids come last; a text is worked on as a whole, in some 60 bytes a character;
ties between places go by id, row, then place; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, setjoin
from .collocations import _stored
from .jaccard import WORDS, _lists
from .setjoin import DEN, NUM
from .shingles import _R, _SPACE, _powers, distinct_sets, mix, shingle_hashes, signatures, text_chunks, word_hashes

LENGTH = 50
SHINGLES = LENGTH - WORDS + 1
#: So many words may differ at one end of two paragraphs that link.
OUT = SHINGLES * (DEN - NUM) // (NUM + DEN)
FEWEST = SHINGLES - OUT
#: Places of a paragraph in a run of LENGTH + 1 words, out of it by at most OUT words.
WINDOW = 2 * OUT + 2
BEFORE = SHINGLES // 2 - 1
ROWS = 2
RECALL = 0.98
SEED = 29
#: Paragraphs that a task of the first pass holds, that a task gathers to let them meet, and candidates that a task links, on average.
HELD, TASK_ROWS, LINK_ROWS = 400_000, 1_000_000, 100_000
#: Candidates of an anchor that are linked in one task.
GROUP = 200_000
#: Bits of the table of known paragraphs that every task gets (4 MB). The fuller it is, the more narrow rows are shuffled for the exact join after it, up to one a paragraph.
FILTER_BITS = 1 << 25
_PLACE = np.uint64((1 << 26) - 1)


def bands(threshold: float = NUM / DEN, rows: int = ROWS, recall: float = RECALL) -> int:
    """So many bands of that many rows find a pair at the threshold with that chance or better."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


@lru_cache(maxsize=4)
def _powers_and_inverses(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and their inverses, modulo 2^64."""
    x = _powers(n)
    y = x * np.uint64(3) ^ np.uint64(2)  # right in 5 bits, then in twice as many
    for _ in range(4):
        y = y * (np.uint64(2) - x * y)
    return x, y


class Paragraphs:
    """Paragraphs of a batch of texts, in order: owner (text), anchor (hash), id (hash of anchor and shingles, even), first (word) and words."""

    def __init__(self, texts: list[str | None]):
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        words, counts, self.starts = word_hashes(self.raw)
        long = counts >= FEWEST + WORDS - 1
        of_text, self.word0 = np.flatnonzero(long), (np.cumsum(counts) - counts)[long]
        self.h, n = shingle_hashes(words[np.repeat(long, counts)], counts[long], WORDS)
        base = np.cumsum(n) - n
        self.owner = self.first = self.words = self.lo = self.hi = np.zeros(0, dtype=np.int64)
        self.anchor = self.id = np.zeros(0, dtype=np.uint64)
        if not len(n):
            return
        low = (self.h & ~_PLACE) | np.arange(len(self.h), dtype=np.uint64)
        step = 1
        while step * 2 <= WINDOW:  # low: the least of so many shingles
            low, step = np.minimum(low[:-step], low[step:]), step * 2
        per = n - WINDOW + 1
        at = np.repeat(base - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        p = (np.minimum(low[at], low[at + WINDOW - step]) & _PLACE).astype(np.int64)
        p = p[np.append(True, p[1:] != p[:-1])]
        k = np.searchsorted(base, p, side="right") - 1
        lo, hi = np.maximum(base[k], p - BEFORE), np.minimum(base[k] + n[k], p - BEFORE + SHINGLES)
        ok = hi - lo >= FEWEST
        p, k, self.lo, self.hi = p[ok], k[ok], lo[ok], hi[ok]
        power, inverse = _powers_and_inverses(1 << (len(self.h) + 1).bit_length())
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.h * power[: len(self.h)])])
        self.id = mix((sums[self.hi] - sums[self.lo]) * inverse[self.lo] + mix(self.h[p]) + (self.hi - self.lo).astype(np.uint64)) & ~np.uint64(1)
        self.anchor, self.owner = self.h[p], of_text[k]
        self.first = self.lo - base[k]
        self.words = self.hi - self.lo + WORDS - 1
        self.at = self.word0[k] + self.first  # its first word among those of all texts

    def bands(self, rows: np.ndarray, n_bands: int, per_band: int, seed: int = SEED) -> np.ndarray:
        """(rows, n_bands) 32-bit keys of these paragraphs."""
        lo, hi = self.lo[rows], self.hi[rows]
        out = np.empty((len(rows), n_bands), dtype=np.uint32)
        odd = mix(np.arange(1, n_bands * per_band + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
        for b in range(n_bands):
            key = np.full(len(rows), b + 1, dtype=np.uint64)
            for r in range(per_band):
                v, step = ((self.h * odd[b * per_band + r]) >> np.uint64(32)).astype(np.uint32), 1
                while step * 2 <= FEWEST:
                    v, step = np.minimum(v[:-step], v[step:]), step * 2
                key = mix(key + np.minimum(v[lo], v[hi - step]))
            out[:, b] = key >> np.uint64(32)
        return out

    def sets(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ascending 31-bit shingles of each of these paragraphs, number of each)."""
        n = self.hi[rows] - self.lo[rows]
        at = np.repeat(self.lo[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        x, n = distinct_sets(self.h[at] >> np.uint64(33), n)
        return x, n

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, end, line) of these paragraphs in their texts."""
        raw = np.frombuffer(b"\n".join(self.raw) + b"\n", dtype=np.uint8)
        blank = np.flatnonzero(_SPACE[raw])
        head, last = self.starts[self.at[rows]], self.starts[self.at[rows] + self.words[rows] - 1]
        end = blank[np.searchsorted(blank, last)]
        size = np.fromiter((len(t) + 1 for t in self.raw), dtype=np.int64, count=len(self.raw))
        base = (np.cumsum(size) - size)[self.owner[rows]]
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        lines = np.concatenate([[0], np.cumsum(raw == 10)])
        return chars[head] - chars[base], chars[end] - chars[base], lines[head] - lines[base]


def _first_pass(buckets: int, n_bands: int, per_band: int):
    """Rows (text, doc) -> rows (bucket, a, id, band, doc): what a task has for a bucket of anchors, as arrays. A paragraph comes once a task and flush, of one of its texts; its id is odd if two texts have it."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, ids, keys, docs, copies = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at, inv = np.unique(ids, return_index=True, return_inverse=True)
        ids = ids | (np.bincount(inv, weights=copies) > 1).astype(np.uint64)
        bucket = (anchor[at] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        n = np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        n, at = n[some], at[order]
        a = (anchor[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), _lists(a, n), _lists(ids[order].view(np.int64), n), _lists(keys[at].view(np.int32).ravel(), n * n_bands), _lists(docs[at], n)],
            names=["bucket", "a", "id", "band", "doc"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            docs = b.column(1).to_numpy()
            for lo, hi, texts in text_chunks(b.column(0)):
                p = Paragraphs(texts)
                if not len(p.id):
                    continue
                ids, first, inv = np.unique(p.id, return_index=True, return_inverse=True)
                owners = np.unique(inv * len(texts) + p.owner) // len(texts)
                held.append((p.anchor[first], ids, p.bands(first, n_bands, per_band), docs[lo:hi][p.owner[first]], np.bincount(owners)))
                rows += len(first)
                if rows >= HELD:
                    yield from flush(held)
                    held, rows = [], 0
        if held:
            yield from flush(held)

    return cut


def _tokens(anchors: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A hash of anchor, band and key for each of the keys (paragraphs, bands), row by row."""
    n = keys.shape[1]
    return mix(np.repeat(mix(anchors + _R), n) + keys.astype(np.uint64).ravel() + (np.tile(np.arange(n, dtype=np.uint64), len(keys)) << np.uint64(32)))


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy()


def _meet(n_bands: int):
    """Rows (bucket, a, id, band, doc) of a partition -> (id, kind, doc): 0 for a paragraph that two documents have, 1 for one that shares anchor and band with another, 2 for such a one of an anchor of many."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _held(batches)
        if t is None:
            return
        n = t.column("a").combine_chunks().value_lengths().to_numpy()
        key = np.repeat(t.column("bucket").to_numpy().astype(np.uint64), n) << np.uint64(32) | _flat(t, "a").view(np.uint32)
        ids, keys, docs = _flat(t, "id").view(np.uint64), _flat(t, "band").reshape(-1, n_bands), _flat(t, "doc")
        same = [ids[(ids & np.uint64(1)).astype(bool)] & ~np.uint64(1)]
        ids = ids & ~np.uint64(1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        alone = new & np.append(new[1:], True)
        key, at = key[~alone], order[~alone]
        order = np.lexsort((docs[at], ids[at], key))
        key, at = key[order], at[order]
        ids, keys, docs = ids[at], keys[at].view(np.uint32), docs[at]
        again = np.append(False, ids[1:] == ids[:-1])[: len(ids)]
        same = np.unique(np.concatenate([*same, ids[again]]))
        key, ids, keys, docs = key[~again], ids[~again], keys[~again], docs[~again]
        token = _tokens(key, keys)
        order = np.argsort(token, kind="stable")
        token = token[order]
        tie = np.append(False, token[1:] == token[:-1])[: len(token)]
        tie[:-1] |= tie[1:]
        met = np.zeros(len(ids), dtype=bool)
        met[order[tie] // n_bands] = True
        key, ids, docs = key[met], ids[met], docs[met]
        _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        kind = np.where(n[inv] > GROUP, 2, 1) if len(key) else np.zeros(0, dtype=np.int64)
        both, none = np.concatenate([same, ids]).view(np.int64), np.zeros(len(same), dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"id": pa.array(both), "kind": pa.array(np.concatenate([none, kind]).astype(np.int32)), "doc": pa.array(np.concatenate([none, docs]))})

    return meet


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, ids) -> (anchor, id, x) of the paragraphs of the texts that have these ids."""
    for b in batches:
        for lo, hi, texts in text_chunks(b.column(0)):
            p = Paragraphs(texts)
            rows = np.flatnonzero(np.isin(p.id, b.column(1).slice(lo, hi - lo).flatten().to_numpy().view(np.uint64)))
            rows = rows[np.unique(p.id[rows], return_index=True)[1]]
            if len(rows):
                x, n = p.sets(rows)
                yield pa.RecordBatch.from_arrays([*[pa.array(v[rows].view(np.int64)) for v in (p.anchor, p.id)], _lists(x.astype(np.int32), n)], names=["anchor", "id", "x"])


def _merge(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """parent (the least member of each one's component) after links p, q."""
    while True:
        a, b = parent[p], parent[q]
        far = a != b
        if not far.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[far], np.minimum(a, b)[far])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _alike(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether rows p and q of x (sets, ascending, filled up with -1) have enough in common."""
    out = np.zeros(len(p), dtype=bool)
    for lo in range(0, len(p), 1 << 14):
        i, j = p[lo : lo + (1 << 14)], q[lo : lo + (1 << 14)]
        both = np.sort(np.concatenate([x[i], x[j]], axis=1), axis=1)
        inter = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(1)
        out[lo : lo + len(i)] = setjoin.enough(inter, n[i], n[j])
    return out


def link(anchors: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least member of each paragraph's component, of links between paragraphs (rows of x, filled up with -1) of one anchor."""
    parent = np.arange(len(n))
    if not len(n):
        return parent
    # Of each set the rarest shingles among those of its anchor: sets that link share one of so many.
    token = mix(mix(anchors)[:, None] + x.astype(np.uint64))
    _, inv, c = np.unique(token, return_inverse=True, return_counts=True)
    rare = np.where(x < 0, np.int64(1) << 62, (c[inv.reshape(x.shape)].astype(np.int64) << 31) | x)
    row, col = np.nonzero(np.arange(x.shape[1]) < setjoin.prefix_length(n)[:, None])
    order = np.argsort(rare, axis=1)[row, col]
    many = c[inv.reshape(x.shape)[row, order]] > 1
    token, row = token[row, order][many], row[many]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    if not len(row):
        return parent

    def tried(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal parent
        p, q = np.divmod(np.unique(np.minimum(p, q) * len(n) + np.maximum(p, q)), len(n))
        ok = _alike(x, n, p, q)
        parent = _merge(parent, p[ok], q[ok])

    first = np.append(True, token[1:] != token[:-1])
    head = row[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]
    tried(head[~first], row[~first])
    # Then the pairs across components in what still holds several.
    step = 1
    while True:
        if step & (step - 1) == 0:
            comp, at = parent[row], np.flatnonzero(first)
            apart = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
            keep = np.repeat(apart, np.diff(np.append(at, len(row))))
            token, row, first = token[keep], row[keep], first[keep]
        i = np.flatnonzero(token[:-step] == token[step:]) if step < len(row) else np.zeros(0, dtype=np.int64)
        if not len(i):
            return parent
        far = parent[row[i]] != parent[row[i + step]]
        if far.any():
            tried(row[i[far]], row[i[far] + step])
        step += 1


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, id, x) of a partition -> (id, comp) of those that link with another."""
    t = _held(batches)
    if t is None:
        return
    ids, at = np.unique(t.column("id").to_numpy(), return_index=True)
    n = t.column("x").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    x = np.full((len(n), SHINGLES), -1, dtype=np.int32)
    x[np.arange(SHINGLES) < n[:, None]] = _flat(t, "x")
    parent = link(t.column("anchor").to_numpy()[at].view(np.uint64), x[at], n[at])
    some = np.flatnonzero(np.bincount(parent, minlength=len(ids))[parent] > 1)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids[some]), "comp": pa.array(ids[parent[some]])})


class _Among:
    """Which of some ids may be among those of a table: a bit table of fixed size, by an id's lower bits, that every task gets."""

    def __init__(self, ids: DataFrame):
        slot = F.shiftright("id", 1).bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int")
        words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, s & 63))").alias("bits")).toArrow()
        table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
        table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = (x >> np.uint64(1)) & np.uint64(FILTER_BITS - 1)
        return (self.table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def clusters(docs: DataFrame, per_band: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A stored table (id, comp) of paragraphs that link with another one or stand in two documents, and maybe of others."""
    spark = docs.sparkSession
    n_bands = bands(rows=per_band, recall=recall)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (6 * WINDOW // 2 * TASK_ROWS))
    # Equal keys of different texts do no harm: a task looks for ids in a few more texts.
    keyed = docs.select("text", F.hash("doc_id", "text").alias("doc"))
    cut = keyed.mapInArrow(_first_pass(16 * parts, n_bands, per_band), "bucket int, a array<int>, id array<long>, band array<int>, doc array<int>")
    met = _stored(cut.repartition(parts, "bucket").mapInArrow(_meet(n_bands), "id long, kind int, doc int"), "paragraphs-met")
    n = {r["kind"]: r["n"] for r in met.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}

    def candidates(kind: int) -> DataFrame:
        """(anchor, id, x) of the paragraphs of that kind, from the one text that was noted of each; repeats are possible."""
        wanted = met.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list("id").alias("ids"))
        return keyed.join(wanted.hint("shuffle_hash"), "doc").select("text", "ids").mapInArrow(_wanted, "anchor long, id long, x array<int>")

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n.get(1, 0) // LINK_ROWS)
    linked = candidates(1).repartition(spread, "anchor").mapInArrow(_links, "id long, comp long")
    linked = _stored(linked, "paragraph-links", narrow=True)
    if n.get(2):
        linked = linked.unionByName(_linked_apart(candidates(2)))
    rest = met.where("kind = 0").select("id").join(linked.select("id"), "id", "left_anti")
    return _stored(linked.unionByName(rest.select("id", F.col("id").alias("comp"))), "paragraph-clusters", narrow=True)


def _linked_apart(found: DataFrame) -> DataFrame:
    """(id, comp) of candidates of anchors that have many, by tiles cut into blocks."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.column(1).value_lengths().to_numpy().astype(np.int64)
                sig, width = signatures(b.column(1).flatten().to_numpy().astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), _lists(sig, width)], names=["id", "n", "sig"])

    found = common.stored(found.dropDuplicates(["id"]), "paragraph-sets")
    each = found.select("id", "anchor", F.size("x").alias("n"), F.explode("x").alias("s"))
    often = each.groupBy("anchor", "s").agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(W.partitionBy("id").orderBy("c", "s")) - 1
    rare = each.join(often, ["anchor", "s"]).withColumn("pos", place).where((F.col("pos") <= F.col("n") - F.ceil(F.col("n") * NUM / DEN)) & (F.col("c") > 1))
    tokens = rare.select(F.xxhash64("anchor", "s").alias("token"), "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "c")
    tokens = common.stored(tokens, "paragraph-tokens")
    heavy = tokens.where(F.col("c") > setjoin.HEAVY).select("token", "c").distinct()
    sets = common.stored(found.select("id", "x").mapInArrow(signed, "id long, n long, sig array<long>"), "paragraph-signatures")
    return setjoin.linked(tokens.drop("c"), tokens.count(), sets, lambda ids: ids.join(found, "id").select("id", "x"), heavy)


def repeated(docs: DataFrame, per_band: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A row for every stretch of overlapping paragraphs that stand in two documents or more, and of one document first.

    doc_id, line, start, length (characters), words, cluster_doc (of the first occurrence),
    copies (occurrences of its commonest paragraph), removed (not the first occurrence).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = clusters(docs, per_band, recall)
    among = _Among(known.select("id"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_chunks(b.column(2)):
                p = Paragraphs(texts)
                rows = np.flatnonzero(among(p.id))
                if len(rows):
                    row = b.slice(lo, hi - lo).select(["doc_id", "u"]).take(pa.array(p.owner[rows]))
                    head, end, line = p.places(rows)
                    numbers = [pa.array(v) for v in (p.id[rows].view(np.int64), p.first[rows], p.words[rows], head, end, line)]
                    yield pa.RecordBatch.from_arrays([*row.columns, *numbers], names=["doc_id", "u", "id", "first", "words", "head", "end", "line"])

    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("u"), "text")
    places = keyed.mapInArrow(placed, "doc_id long, u long, id long, first long, words long, head long, end long, line long")
    places = _stored(places.join(known, "id").drop("id"), "paragraph-places")
    c = F.col
    # Of each cluster the first occurrence, by (named, doc_id, row, word).
    key = F.struct(c("doc_id").isNull().alias("unnamed"), c("doc_id").alias("doc"), "u", "first")
    groups = places.groupBy("comp").agg(F.min(key).alias("lead"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.count(F.lit(1)).alias("copies"))
    groups = _stored(groups.where("lo <> hi").select("comp", "lead", "copies"), "paragraph-groups", narrow=True)
    hit = places.join(common.small(groups), "comp")
    hit = hit.withColumn("removed", ~((c("u") == c("lead.u")) & (c("first") == c("lead.first")))).withColumn("lead_u", c("lead.u"))
    order = W.partitionBy("u").orderBy("first")
    until = F.max(c("first") + c("words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    other = ~c("removed").eqNullSafe(F.lag("removed").over(order)) | (c("removed") & (c("lead_u") != F.lag("lead_u").over(order)))
    cut = F.when((c("first") <= c("until")) & ~c("other"), 0).otherwise(1)
    runs = hit.withColumns({"until": until, "other": other})
    runs = runs.withColumn("run", F.sum(cut).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("u", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("line").alias("line"), F.min("head").alias("start"), (F.max("end") - F.min("head")).alias("length"),
        (F.max(c("first") + c("words")) - F.min("first")).alias("words"), F.first("lead.doc").alias("cluster_doc"), F.max("copies").alias("copies"), F.first("removed").alias("removed"),
    )
    return runs.drop("u", "run")


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(common.documents(spark, sf_dir))


QUERIES = {"op3_paragraph_dedup": op3_paragraph_dedup}
ORACLES: dict[str, str] = {}
