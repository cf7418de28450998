"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, long ones in stretches of about a sentence), and
every different paragraph has a 64-bit digest.  A
sketch is a table of cells in three parts; each digest is added to one cell of
every part (count, XOR of digests, XOR of check sums of digests).  Two sketches subtract cell by cell: what both
versions hold cancels, and peeling cells that hold a single digest recovers the
digests that only one version has.

The fingerprint is the sketch of CELLS cells.  Where a difference of fingerprints does
not peel, larger sketches take both versions: their cells are rows (only those in
use), grouped by document and cell, and each round of peeling takes the single
digests of one part out of the other parts and groups again.  All of that runs
within the partitions of one narrow shuffle of digests.  Pairs that still fail retry in sketches
twice as large with other places.

Main path: DataFrame functions alone.  Neighbours in descending id are found in
buckets of ids of about BUCKET_ROWS rows, each with a copy of the row that follows
its last; texts are shuffled once.

Defined cases: a null text is an empty text, without paragraphs; a text is cut and sketched as a whole, in memory that grows with its own length; two texts without
paragraphs are alike (1.0); a paragraph that a text repeats counts once; ids that
repeat are ordered by their text, null ids come last; a single row follows itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: A paragraph: 60 to 140 characters of a line up to a sentence end, else 60 or more up to a space, else the rest of the line.
PARAGRAPH = r"[^\n]{60,140}?[.!?](?=[\x20\n]|$)|[^\n]{60,}?(?=\x20)|[^\n]+"
CELLS = 12
#: Cells of a part of a larger sketch, for each digest of both versions; unused cells take no room.
SPARSE = 8
#: The parts that are peeled one after another.
PEELS = (0, 1, 2, 0, 1, 2)
TRIES = 6
BUCKET_ROWS = 1024
#: Quantiles of ids that the driver reads at most; each range between two is cut evenly if more buckets are needed.
QUANTILES = 1024

CELL = "struct<n:int,k:bigint,c:bigint>"
_CHECK = 23


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _check(k: Column) -> Column:
    """The check sum of a digest."""
    return F.xxhash64(F.lit(_CHECK), k)


def digests(text: Column) -> Column:
    """The different digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _in_cell(k: Column, i: int) -> Column:
    """Whether cell i of a fingerprint takes the digest: two of its bits choose one of a part's four cells."""
    part, slot = divmod(i, CELLS // 3)
    return F.shiftright(k, 24 + 2 * part).bitwiseAND(F.lit(CELLS // 3 - 1)) == slot


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("bigint").alias("k"), c.cast("bigint").alias("c"))


def _less(x: Column, y: Column) -> Column:
    """Cell x without what cell y holds."""
    return _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"]))


def _xor(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseXOR(k))


def sketch(keys: Column) -> Column:
    """The CELLS cells of all keys."""

    def cell(i: int) -> Column:
        return _let(F.filter(keys, lambda k: _in_cell(k, i)), lambda own: _cell(F.size(own), _xor(own), _xor(F.transform(own, _check))))

    return F.array(*map(cell, range(CELLS)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _less)


def peel(cells: Column) -> Column:
    """The digests of a difference of fingerprints as array<struct<n, k, c>> (n = 1: only the first has it, -1: only the second), or null if it does not peel."""

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))))

        def less(cell: Column, i: int, p: Column) -> Column:
            own = F.filter(p, lambda x: _in_cell(x["k"], i))
            return F.aggregate(own, cell, _less)

        def take(p: Column) -> Column:
            rest = F.array(*[less(F.get(state["cells"], F.lit(i)), i, p) for i in range(CELLS)])
            return F.struct(rest.alias("cells"), F.concat(state["got"], p).alias("got"), (F.size(p) > 0).alias("live"))

        return F.when(state["live"], _let(pure, lambda p: F.when(F.size(p) > 0, take(p)).otherwise(F.struct(state["cells"].alias("cells"), state["got"].alias("got"), F.lit(False).alias("live"))))).otherwise(state)

    none = F.array().cast(f"array<{CELL}>")
    begin = F.struct(cells.alias("cells"), none.alias("got"), F.lit(True).alias("live"))
    done = lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0)), s["got"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(CELLS)), begin, step, done)


def _slot(k: Column, part: Column | int, width: Column, salt: int) -> Column:
    """The number of the cell that takes the digest in a part of a larger sketch."""
    return F.pmod(F.xxhash64(k, F.lit(salt), F.lit(part) if isinstance(part, int) else part), width) + width * part


def differences(pairs: DataFrame, by: str, salt: int = 0) -> DataFrame:
    """pairs (by, who, a, b: key arrays), already partitioned by `by`: rows (by, who, n, k).

    n = 1: only a has the digest k; -1: only b. n = 0: the pair did not peel.
    """
    width = (F.size("a") + F.size("b")).cast("bigint") * (SPARSE << salt)
    signed = lambda keys, n: F.transform(keys, lambda k: F.struct(F.lit(n).alias("n"), k.alias("k")))
    rows = pairs.select(by, "who", width.alias("width"), F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("x"))
    k, w = F.col("x.k"), F.col("width")
    rows = rows.select(by, "who", "width", F.col("x.n").cast("bigint").alias("n"), k.alias("k"), _check(k).alias("c"), F.explode(F.array(*[_slot(k, j, w, salt) for j in range(3)])).alias("cell"))
    keys = [by, "who", "width", "cell"]
    put = lambda r: r.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("bit_xor(k)").alias("k"), F.expr("bit_xor(c)").alias("c")).where("n <> 0 or k <> 0 or c <> 0")
    cells = put(rows)
    for part in PEELS:
        k, n, w, cell = F.col("k"), F.col("n"), F.col("width"), F.col("cell")
        pure = (cell >= w * part) & (cell < w * (part + 1)) & (F.abs(n) == 1) & (F.col("c") == _check(k)) & (_slot(k, part, w, salt) == cell)
        row = lambda at, n: F.struct(at.alias("cell"), n.alias("n"), k.alias("k"), F.col("c").alias("c"))  # noqa: E731, B023
        # A digest that is found leaves its other two cells and stays as a row of its own, with a negative cell.
        found = F.array(row(-1 - F.shiftrightunsigned(k, 1), n), *[row(_slot(k, j, w, salt), -n) for j in range(3) if j != part])
        cells = put(cells.select(by, "who", "width", F.explode(F.when(pure, found).otherwise(F.array(row(cell, n)))).alias("x")).select(by, "who", "width", "x.*"))
    return cells.select(by, "who", F.when(F.col("cell") < 0, F.col("n")).otherwise(F.lit(0)).alias("n"), "k")


def recovered(pairs: DataFrame, by: str, salt: int = 0) -> DataFrame:
    """(by, who, apart): how many digests differ, or null if the pair did not peel."""
    d = differences(pairs, by, salt).groupBy(by, "who").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("n") == 0).alias("left"))
    return d.select(by, "who", F.when(F.col("left") == 0, F.col("found")).alias("apart"))


def likeness(both: Column, apart: Column) -> Column:
    """Jaccard likeness of two sets from the sum of their sizes and the number of differing elements."""
    return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart))


def shown(cells: Column) -> Column:
    """A sketch as text: count:digest:check of every cell."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"], F.lower(F.hex(c["k"])), F.lower(F.hex(c["c"])))), ",")


def _search(bounds: Column, x: Column, n: int) -> Column:
    """How many of n ascending bounds are at most x, by bisection."""
    state = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(bounds, mid) <= x
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), state, half, lambda s: s["lo"])


def bucketed(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, text) with bucket, a number that never falls as doc_id grows, and halo: true for copies of the row that follows a bucket's last in descending doc_id."""
    n = docs.count()
    want = max(1, -(-n // rows))
    q = min(want, QUANTILES)
    fine = -(-want // q)
    cuts = [i / q for i in range(1, q)]
    r = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", cuts or [0.5], 20 * QUANTILES), F.max("doc_id")).first()
    bounds = sorted({r[0], *(r[1] if cuts and r[1] else []), r[2]}) if r[0] is not None else [0]
    bounds = bounds if len(bounds) > 1 else bounds * 2
    b = F.lit(bounds).cast("array<long>")
    i = F.least(_search(b, F.col("doc_id"), len(bounds)), F.lit(len(bounds) - 1)) - 1
    lo, hi = F.get(b, F.col("_i")), F.get(b, F.col("_i") + 1)
    # In doubles, which never fall as ids grow: differences of ids of both signs pass 64 bits.
    real = lambda x: x.cast("double")
    inner = F.coalesce(F.floor((real(F.col("doc_id")) - real(lo)) / F.nullif(real(hi) - real(lo), F.lit(0.0)) * fine), F.lit(0))
    at = F.coalesce(F.col("_i") * fine + F.least(inner, F.lit(fine - 1)), F.lit(-1).cast("long"))
    rowed = docs.withColumn("_i", i).withColumn("bucket", at).drop("_i")
    # One narrow row a bucket: the id that comes first in it, and the bucket above that needs a copy of it.
    heads = rowed.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    up = F.coalesce(F.lead("bucket").over(W.orderBy("bucket")), F.min("bucket").over(W.partitionBy()))
    heads = common.stored(heads.select("bucket", "head", up.alias("above")), "id-buckets", narrow=True)
    joined = rowed.join(common.small(heads), "bucket")
    home = F.struct(F.col("bucket"), F.lit(False).alias("halo"))
    copy = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("halo"))
    both = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(home, copy)).otherwise(F.array(home)))
    return joined.select("doc_id", "text", both.alias("_b")).select("doc_id", "text", "_b.bucket", "_b.halo")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, halo, place, doc_id, text, keys, cells of every row of the buckets and text and cells of the one that follows it, as `next`."""
    body = F.coalesce("text", F.lit(""))
    rows = bucketed(docs.select("doc_id", body.alias("text"))).repartition("bucket")
    rows = rows.withColumn("keys", digests(F.col("text")))
    rows = rows.withColumn("cells", sketch(F.col("keys")))
    order = W.partitionBy("bucket").orderBy("halo", F.desc_nulls_last("doc_id"), "text")
    following = F.lead(F.struct("text", "cells", F.size("keys").alias("size"))).over(order)
    return rows.withColumns({"next": following, "place": F.row_number().over(order)})


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    The edited text of a row is its own with the last half replaced by as much of the next row's.
    """
    c = F.col
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(c("next.text"), F.lit(1), half))
    d = with_next(docs).select("bucket", "halo", "place", "doc_id", n.cast("long").alias("n_chars"), "keys", "cells", "next", F.when(~c("halo"), edited).alias("edited"))
    d = d.withColumn("e_keys", digests(c("edited")))
    # Fingerprints are made again from the keys at the end: as text, or as cells, they are several times larger.
    d = d.select(
        "bucket", "halo", "place", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_hash"), "keys", "e_keys", F.col("next.size").alias("n_size"),
        F.size(peel(subtract(c("cells"), sketch(c("e_keys"))))).alias("e_apart"), F.size(peel(subtract(c("cells"), c("next.cells")))).alias("n_apart"),
    )
    d = common.stored(d, "fingerprints")
    # What the fingerprints alone do not tell: pairs (keys, edited keys) as 2 * place, (keys, next keys) as 2 * place + 1.
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // (2 * BUCKET_ROWS)))
    order = W.partitionBy("bucket").orderBy("place")
    pair = lambda odd, b, known: F.when(c(known).isNull(), F.struct((c("place") * 2 + odd).cast("bigint").alias("who"), c("keys").alias("a"), c(b).alias("b")))

    def paired(rows: DataFrame) -> DataFrame:
        held = rows.select("bucket", "halo", "place", "keys", "e_keys", "e_apart", "n_apart").repartition(parts, "bucket")
        held = held.withColumn("n_keys", F.lead("keys").over(order)).where("not halo")
        return held.select("bucket", F.explode(F.array(pair(0, "e_keys", "e_apart"), pair(1, "n_keys", "n_apart"))).alias("p")).where("p is not null").select("bucket", "p.*")

    got = common.stored(recovered(paired(d), "bucket"), "recovered")
    for salt in range(1, TRIES + 1):
        failed = got.where("apart is null").select("bucket", "who")
        if failed.isEmpty():
            break
        if salt == TRIES:
            raise RuntimeError(f"{failed.count()} differences do not peel in sketches of {SPARSE << (TRIES - 1)} cells a digest")
        # Few pairs fail: only their buckets are shuffled again.
        of = d.join(common.small(failed.select("bucket").distinct()), "bucket", "left_semi")
        again = paired(of).join(common.small(failed), ["bucket", "who"], "left_semi").repartition("bucket")
        got = common.stored(got.where("apart is not null").unionByName(recovered(again, "bucket", salt)), "recovered")
    wide = got.groupBy("bucket", F.shiftright("who", 1).cast("int").alias("place")).agg(F.max(F.when(c("who") % 2 == 0, c("apart"))).alias("e"), F.max(F.when(c("who") % 2 == 1, c("apart"))).alias("x"))
    # A pair that differs in nothing has no rows left; it counts as 0 apart.
    out = d.where("not halo").join(wide.hint("shuffle_hash"), ["bucket", "place"], "left")
    near = lambda size, known, found: likeness(F.size("keys") + size, F.coalesce(c(known).cast("bigint"), c(found), F.lit(0)))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_hash")).alias("edited_sha256"),
        shown(sketch(c("keys"))).alias("fingerprint"), shown(sketch(c("e_keys"))).alias("edited_fingerprint"),
        near(F.size("e_keys"), "e_apart", "e").alias("near_edited"), near(c("n_size"), "n_apart", "x").alias("near_next"),
    )


def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(common.documents(spark, sf_dir))


QUERIES = {"op2_iblt_fingerprints": op2_iblt_fingerprints}
ORACLES: dict[str, str] = {}
