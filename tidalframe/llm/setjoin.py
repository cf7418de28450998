"""Exact similarity links between distinct sets, from tiles of sets that may be alike.

A tile is a key that sets share (a shingle of their prefixes).  Sets of a tile are put
in order of size and cut where the next size is too large for any link: size-banded
tiles.  Then

1.  the sets of a size band have one leader, and every set is tried against the leader
    that it shares most tiles with, so that a large group of near copies costs as
    many tries as it has members;
2.  tiles whose members the links found so far do not all connect are open.  In waves,
    their sets meet across components, by sizes and by signatures: the bits in which two
    parity bitmaps differ bound the overlap from above.  A task gives only the likeliest
    pairs of each component that it sees, so never more than a multiple of its rows, and
    of the tiles that hold a pair only the least one gives it;
3.  pairs are decided by intersecting the sorted sets, links merge components, and pairs
    that do not link are remembered with their tile.

Waves end when no task has left out a pair that is untried and that a bound allows,
so components are those of all links, whatever the order of work, while pairs inside a
component are not listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import bits_apart, mix

#: A pair links when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Rows of a tile that meet at once in the full search; larger tiles are cut into pairs of blocks.
BLOCK = 2_048
#: Rows of a task that gathers its whole partition; a token of more rows than HEAVY is dealt to several tasks.
TASK_ROWS, HEAVY = 750_000, 250_000
#: In the first wave a task gives so many pairs for each component that it sees, in every further one GROW times as many.
BEST, GROW = 2, 256
#: Places are looked at between a row of a tile and so many next ones.
NEAR = 64
#: Bits of the filter of wanted ids (131,072 rows when full).
FILTER_BITS = 1 << 23


def enough(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return inter * (NUM + DEN) >= NUM * (a + b)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Of any order of elements that all sets share: two sets that link have a common element among so many first ones of each."""
    return np.where(n > 0, n + (-NUM * n) // DEN + 1, 0)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})


def _leaders(group: np.ndarray, sid: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The smallest id of each group and size band; groups stand together, in order of n."""
    band = np.floor(np.log(n) / np.log(DEN / NUM)).astype(np.int64)
    edge = np.append(True, (group[1:] != group[:-1]) | (band[1:] != band[:-1]))
    return np.minimum.reduceat(sid, np.flatnonzero(edge))[np.cumsum(edge) - 1]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, id, n, pos) of a partition -> rows (tile, id, leader) of tiles with two sets that sizes and places allow to link.

    pos is the token's place in its set's order; of a token that is dealt to several tasks it is
    negative, and all of its rows stay.   Two sets that link have a first common
    token, before which they share nothing: what follows it has to hold the whole overlap.
    """
    t = _table(batches)
    if t is None:
        return
    token, sid, n, pos = _ints(t, "token"), _ints(t, "id"), _ints(t, "n").astype(np.int64), _ints(t, "pos").astype(np.int64)
    order = np.lexsort((sid, n, token))
    token, sid, n, pos = token[order], sid[order], n[order], pos[order]
    dealt = pos < 0
    if dealt.any():
        own = token[dealt]
        yield _batch(tile=mix(own.view(np.uint64)).view(np.int64), id=sid[dealt], leader=_leaders(own, sid[dealt], n[dealt]))
        token, sid, n, pos = token[~dealt], sid[~dealt], n[~dealt], pos[~dealt]
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid, n, pos = token[keep], sid[keep], n[keep], pos[keep]
    rest = n - pos
    tied = np.zeros(len(token), dtype=bool)
    i, step = np.arange(len(token)), 1
    while True:
        i = i[i + step < len(token)]
        i = i[(token[i] == token[i + step]) & (n[i] * DEN >= NUM * n[i + step])]
        if not len(i):
            break
        if step == NEAR:  # the tiles that are this large stay whole
            tied |= np.isin(token, token[i])
            break
        j = i + step
        ok = enough(np.minimum(rest[i], rest[j]), n[i], n[j])
        tied[i[ok]] = tied[j[ok]] = True
        step += 1
    token, sid, n = token[tied], sid[tied], n[tied]
    if not len(token):
        return
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (n[:-1] * DEN < NUM * n[1:])
    # A tile is named by its sets: where several tokens bring the same ones together, one tile is enough.
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(sid)))
    names = mix(np.add.reduceat(mix(sid.view(np.uint64)), first) + size.astype(np.uint64))
    fresh = np.zeros(len(first), dtype=bool)
    fresh[np.unique(names, return_index=True)[1]] = True
    fresh &= size > 1
    seg = np.cumsum(new) - 1
    keep = fresh[seg]
    if not keep.any():
        return
    tile = names[seg][keep].view(np.int64)
    yield _batch(tile=tile, id=sid[keep], leader=_leaders(seg[keep], sid[keep], n[keep]))


def _signed(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offset of each row, number of words of each row) of a column of signatures."""
    c = t.column(name).combine_chunks()
    words = c.value_lengths().to_numpy().astype(np.int64)
    return c.flatten().to_numpy(), np.cumsum(words) - words, words


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (id, leader, na, nb, sa, sb) that sizes and signatures allow to link."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            na, nb = _ints(t, "na"), _ints(t, "nb")
            rows = np.arange(len(na))
            apart = bits_apart(*_signed(t, "sa"), rows, rows, *_signed(t, "sb"))
            ok = enough(np.minimum(np.minimum(na, nb), (na + nb - apart) // 2), na, nb)
            yield _batch(id=_ints(t, "id")[ok], leader=_ints(t, "leader")[ok])


def _likeliest(rows: np.ndarray, best: int) -> np.ndarray:
    """rows: (negative overlap share, component, other component, ...). Those that are among the best ones of one of their components."""
    keep = np.zeros(len(rows), dtype=bool)
    for side in (1, 2):
        order = np.lexsort((rows[:, 0], rows[:, side]))
        comp = rows[order, side]
        at = np.arange(len(rows))
        new = np.append(True, comp[1:] != comp[:-1])
        keep[order[at - np.maximum.accumulate(np.where(new, at, 0)) < best]] = True
    return rows[keep]


def _across(best: int):
    """Rows (tile, grp, part, crossed, id, n, comp, sig, others, tried) of a partition -> pairs (tile, a, b, cut) of two components that may link; cut: the task has left some out.

    Rows of one tile and grp meet; where crossed is set, only those of different parts.
    others: the set's tiles; tried: the larger ids of pairs of this tile that are known not to link.
    """

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        key = mix(_ints(t, "tile").view(np.uint64) ^ mix(_ints(t, "grp").view(np.uint64)))
        n = _ints(t, "n").astype(np.int64)
        order = np.lexsort((n, key))
        key, n, sid, comp, tile, part, crossed = (x[order] for x in (key, n, _ints(t, "id"), _ints(t, "comp"), _ints(t, "tile"), _ints(t, "part"), _ints(t, "crossed")))
        flat, offset, words = _signed(t, "sig")
        offset, words = offset[order], words[order]
        others, tried = t.column("others").combine_chunks(), t.column("tried").combine_chunks()
        before: dict[int, tuple[frozenset, frozenset]] = {}

        def known(r: int) -> tuple[frozenset, frozenset]:
            if r not in before:
                k, here = int(order[r]), int(tile[r])
                before[r] = frozenset(x for x in others[k].as_py() if x < here), frozenset(tried[k].as_py() or ())
            return before[r]

        def untried(p: int, q: int) -> bool:
            (tp, xp), (tq, xq) = known(p), known(q)
            return tp.isdisjoint(tq) and (sid[q] not in xp if sid[p] < sid[q] else sid[p] not in xq)

        i, step, found, held, seen = np.arange(len(key)), 1, [], 0, 0
        while True:
            i = i[i + step < len(key)]
            j = i + step
            i = i[(key[i] == key[j]) & (n[i] * DEN >= NUM * n[j])]
            if not len(i):
                break
            j = i + step
            far = (comp[i] != comp[j]) & ((crossed[i] == 0) | (part[i] != part[j]))
            p, q = i[far], j[far]
            overlap = np.minimum(n[p], (n[p] + n[q] - bits_apart(flat, offset, words, p, q)) // 2)
            ok = enough(overlap, n[p], n[q])
            if ok.any():
                p, q, overlap = p[ok], q[ok], overlap[ok]
                ok = np.fromiter((untried(*x) for x in zip(p.tolist(), q.tolist(), strict=True)), dtype=bool, count=len(p))
                p, q, overlap = p[ok], q[ok], overlap[ok]
                a, b = sid[p], sid[q]
                found.append(np.stack([-(overlap << 20) // (n[p] + n[q]), comp[p], comp[q], np.minimum(a, b), np.maximum(a, b), tile[p]], 1))
                held, seen = held + len(a), seen + len(a)
                if held > 1 << 19:
                    found = [_likeliest(np.concatenate(found), best)]
                    held = len(found[0])
            step += 1
        if held:
            rows = _likeliest(np.concatenate(found), best)
            yield _batch(tile=rows[:, 5], a=rows[:, 3], b=rows[:, 4], cut=np.full(len(rows), held < seen or len(rows) < held))

    return across


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, xa, xb) that link, by the intersection of their sorted sets."""
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        xa, xb = t.column("xa").combine_chunks(), t.column("xb").combine_chunks()
        va, vb = xa.flatten().to_numpy(), xb.flatten().to_numpy()
        oa, ob = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in (xa, xb))
        ok = np.zeros(b.num_rows, dtype=bool)
        for i in range(b.num_rows):
            p, q = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            inter = int((q[at] == p).sum()) if len(q) else 0
            ok[i] = inter * (NUM + DEN) >= NUM * (len(p) + len(q))
        yield _batch(a=_ints(t, "a")[ok], b=_ints(t, "b")[ok])


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose key may be among wanted's (a column of that name): all that are, and some others, by a broadcast bit table of fixed size."""
    slot = lambda: F.pmod(F.xxhash64(common.id_text(key)), F.lit(FILTER_BITS))
    bits = wanted.select(slot().alias("_s")).groupBy(F.shiftright("_s", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_s & 63 AS int)))").alias("_bits"))
    marked = rows.withColumns({"_slot": slot()}).withColumn("_w", F.shiftright("_slot", 6))
    hit = marked.join(F.broadcast(bits), "_w").where(F.expr("(shiftright(_bits, cast(_slot & 63 AS int)) & 1) = 1"))
    return hit.select(*rows.columns)


def linked(tokens: DataFrame, n_tokens: int, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame], heavy: DataFrame | None = None) -> DataFrame:
    """(id, comp) for every set that links with another: the smallest id of its component.

    tokens: (token, id, n, pos), about n_tokens rows, in which two sets that link share a
    token; repeated rows do no harm.  pos: the token's place in an order of elements that
    all sets share, or 0.  sets: a stored table (id, n, sig) with a row for
    each id.  fetch: from a table of ids to (id, x: sorted distinct elements), for at
    least these ids, repeats allowed.  heavy: (token, c) of tokens of about c rows, more than
    HEAVY, few enough for a broadcast.
    """
    spark = tokens.sparkSession
    parts = lambda n: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    tokens = tokens.withColumn("salt", F.lit(0))
    if heavy is not None and not heavy.isEmpty():
        apart = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / HEAVY)).cast("int")
        tokens = tokens.join(F.broadcast(heavy), "token", "left").select("token", "id", "n", F.when(F.col("c").isNull(), F.col("pos")).otherwise(-1).alias("pos"), F.coalesce(apart, F.lit(0)).alias("salt"))
    tiles = tokens.repartition(parts(n_tokens), "token", "salt").mapInArrow(_tiles, "tile long, id long, leader long")
    return linked_tiles(common.stored(tiles, "tiles"), sets, fetch)


def linked_tiles(tiles: DataFrame, sets: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """linked() from a stored table of tiles (tile, id, leader) that holds every two sets that link in a tile."""
    spark = tiles.sparkSession
    parts = lambda n: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        x = common.stored(fetch(ids).dropDuplicates(["id"]), "sets")
        both = pairs.join(x.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(x.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
        return common.stored(both.select("a", "b", "xa", "xb").mapInArrow(_decided, "a long, b long"), "links", narrow=True)

    # Each set tries the leader that it shares most tiles with, if their signatures allow a link.
    often = tiles.where("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("often"))
    first = _starred(often.groupBy("id").agg(F.max_by("leader", F.struct("often", -F.col("leader"))).alias("leader")), sets)
    links = verified(first)
    comps = components(links)
    known, rejected, best = None, None, BEST
    while True:
        open_ = common.stored(_open(tiles, comps), "open-tiles", narrow=True)
        if open_.isEmpty():
            return comps
        if known is None:  # later waves have fewer open tiles and no other sets
            ids = open_.select("id").distinct()
            others = tiles.join(ids, "id", "left_semi").groupBy("id").agg(F.collect_set("tile").alias("others"))
            known = common.stored(sets.join(others, "id").select("id", "n", "sig", "others"), "open-sets")
            end = lambda c: known.select(F.col("id").alias(c), F.col("others").alias(f"t_{c}"))
            both = first.join(links, ["a", "b"], "left_anti").join(end("a"), "a").join(end("b"), "b")
            rejected = common.stored(both.select(F.array_min(F.array_intersect("t_a", "t_b")).alias("tile"), "a", "b").where("tile is not null"), "rejected", narrow=True)
        fresh = common.stored(_rest(open_, known, rejected, parts, best), "tried-next", narrow=True)
        if fresh.isEmpty():
            return comps
        links = verified(fresh.select("a", "b"))
        rejected = common.stored(rejected.unionByName(fresh.join(links, ["a", "b"], "left_anti").select("tile", "a", "b")), "rejected", narrow=True)
        if not links.isEmpty():
            comps = components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(links))
        if fresh.where("cut").isEmpty():
            return comps
        tiles, best = open_.select("tile", "id"), best * GROW


def _starred(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) for those pairs (id, leader) that sizes and signatures allow."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"s_{c}"))
    both = pairs.join(side("id"), "id").join(side("leader"), "leader")
    both = both.select("id", "leader", F.col("n_id").alias("na"), F.col("n_leader").alias("nb"), F.col("s_id").alias("sa"), F.col("s_leader").alias("sb"))
    best = both.mapInArrow(_bounded, "id long, leader long")
    return common.stored(best.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "tried", narrow=True)


def _open(tiles: DataFrame, comps: DataFrame) -> DataFrame:
    """(tile, id, comp) of the tiles whose sets are in more than one component."""
    named = tiles.select("tile", "id").distinct().join(comps, "id", "left").select("tile", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = named.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tile")
    return named.join(open_, "tile")


def _rest(tiles: DataFrame, sets: DataFrame, rejected: DataFrame, parts: Callable[[int], int], best: int) -> DataFrame:
    """Pairs (tile, a, b, cut) of open tiles across components that sizes and signatures allow, without rejected ones: of each component that a task sees the best.

    A tile of more than BLOCK rows is cut into blocks: those of its largest component, which need not meet
    each other, and those of all others, which are copied to every block.
    """
    c = F.col
    per = tiles.groupBy("tile", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("tile").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "comp")).alias("top"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    large = c("rows") > BLOCK
    per = per.select("tile", c("rows"), c("top.c").alias("top_rows"), c("top.comp").alias("top"), F.when(large, blocks(c("top.c"))).otherwise(0).alias("mains"), F.when(large, F.greatest(F.lit(1), blocks(c("rows") - c("top.c")))).otherwise(1).alias("rests"))
    per = common.stored(per, "tile-blocks", narrow=True)
    n_rows = per.agg(F.sum(F.when(c("mains") == 0, c("rows")).otherwise(c("top_rows") * c("rests") + (c("rows") - c("top_rows")) * (c("mains") + c("rests"))))).first()[0] or 0
    tried = rejected.groupBy("tile", c("a").alias("id")).agg(F.collect_list("b").alias("tried"))
    rows = tiles.join(per, "tile").join(sets, "id").join(tried, ["tile", "id"], "left")
    main = (c("mains") > 0) & (c("comp") == c("top"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.when(main, c("mains")).otherwise(c("rests"))))
    place = lambda grp, part, crossed: F.struct(grp.cast("long").alias("grp"), part.cast("int").alias("part"), crossed.cast("int").alias("crossed"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    to_rests = each(c("rests"), lambda j: place(c("k") * c("rests") + j, F.lit(0), F.lit(1)))
    to_mains = F.when(c("mains") > 0, each(c("mains"), lambda i: place(i * c("rests") + c("k"), F.lit(1), F.lit(1)))).otherwise(F.array().cast("array<struct<grp:bigint,part:int,crossed:int>>"))
    lo, hi = lambda j: F.least(c("k"), j), lambda j: F.greatest(c("k"), j)
    to_own = each(c("rests"), lambda j: place(c("mains") * c("rests") + lo(j) * c("rests") + hi(j), c("k") > j, c("k") != j))
    rows = rows.withColumn("p", F.explode(F.when(main, to_rests).otherwise(F.concat(to_mains, to_own))))
    rows = rows.select("tile", "p.*", "id", "n", "comp", "sig", "others", "tried")
    return rows.repartition(parts(n_rows), "tile", "grp").mapInArrow(_across(best), "tile long, a long, b long, cut boolean")
