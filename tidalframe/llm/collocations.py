"""Phrase collocations by hierarchical pair naming.

Words that are frequent in their language get numbers.  A frequent phrase of k words is named
by the pair of its two phrases of k - 1 words (all but the last word, all but the first), so a level replaces
adjacent numbers by the number of their pair: pairs are counted over all texts, and the frequent
ones are numbered in every chunk of text that holds them.  The two members of a
pair are its parent pointers.  Each name inherits the counts of its leading parts from one parent and those
of its trailing parts from the other, which is all that its cuts need; and a phrase is
subsumed by a longer one exactly if it is a parent of a name of the same count
(counts fall with length, so a longer phrase of the same count has a chain of such names below it).

A chunk is some 32 MB of texts of one language, held as an array of numbers of its own; only
its different words and pairs, each with its count in the chunk, are shuffled, so the commonest word has a row a chunk.
Each level's arrays hold the places where two frequent phrases meet, with one zero for every gap.
Names are joined to the pairs made of them by broadcast only if they are counted to be small, else by a shuffle.

Defined cases: a null text is empty, a null language is `und`, a language may have any name; a word is any run without space
and tab inside a piece, its case changed for A-Z alone; repeated rows count again; ties of the
ranking go by count, then by the phrase's bytes; a long text is one stretch of one chunk; an empty table gives an
empty result; ids are not used, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LEAST = 100
LONGEST = 5
TOP = 2000
CHUNK_BYTES = 32 << 20
#: Names (numbers and bytes) of a level that may be broadcast to the pairs made of them; larger tables are joined by a shuffle.
NAMES, NAME_BYTES = 250_000, 8 << 20
#: The best of a language are first sought in so many shares of its phrases.
SHARES = 32

# Fixed values of the contract: what ends a piece, and what stands between words.
ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"

_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + ENDS.encode() + BLANKS.encode(),
    bytes(range(97, 123)) + b"\n" * len(ENDS) + b" " * len(BLANKS),
)
WORDS = "chunk long, lid int, lang string, word binary, n long, tokens binary"
PAIRS = "chunk long, lid int, left long, right long, n long, tokens binary"


#: Arrays are stored and shuffled packed; n of their row is their length in bytes.
PACKED = "zstd"
#: Texts (bytes) and arrays (numbers) of a chunk are worked on in stretches, so that a task holds little beside them.
STRETCH = 1 << 19


def _ranked(counts: np.ndarray) -> np.ndarray:
    """Numbers from 1, the commonest first: small numbers pack better."""
    rank = np.empty(len(counts), dtype=np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(1, len(counts) + 1, dtype=np.int32)
    return rank


def _counts(code: np.ndarray, size: int) -> np.ndarray:
    """How often each number below size is in code."""
    out = np.zeros(size, dtype=np.int64)
    for lo in range(0, len(code), STRETCH):
        out += np.bincount(code[lo : lo + STRETCH], minlength=size)
    return out


def _encoded(text: bytearray) -> Iterator[pa.Array]:
    """The parts of text between blanks as numbers of a dictionary, a stretch at a time."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + STRETCH)
        hi = len(text) if hi < 0 else hi
        part = pa.array([bytes(memoryview(text)[lo:hi])], pa.large_binary())
        yield pc.split_pattern(part, b" ").flatten().dictionary_encode()
        lo = hi + 1


def _numbered(text: bytearray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A text of _plain as an array of word numbers (0 ends a piece), the different words by number - 1, and their counts; text is emptied."""
    parts = pa.chunked_array(list(_encoded(text))).unify_dictionaries()
    text.clear()
    known = parts.chunk(0).dictionary
    special = np.array([known.index(pa.scalar(x, known.type)).as_py() for x in (b"", b"\n")])
    code = [c.indices.to_numpy(zero_copy_only=False) for c in parts.chunks]
    del parts
    code = np.concatenate([c[c != special[0]] for c in code])
    count = _counts(code, len(known))
    words = np.setdiff1d(np.arange(len(known)), special)
    number = np.zeros(len(known), dtype=np.int32)
    number[words] = _ranked(count[words])
    order = words[np.argsort(number[words])]
    return _closed(number[code]), known.take(pa.array(order)).cast(pa.binary()), count[order]


def _plain(text: bytes) -> bytes:
    """text in lower case, a newline between blanks for every end of a piece."""
    return text.translate(_TABLE).replace(b"\n", b" \n ") + b" \n "


def _closed(a: np.ndarray) -> np.ndarray:
    """a with one zero for each run of zeros."""
    return a[(a > 0) | np.concatenate([[True], a[:-1] > 0])] if len(a) else a


def _rows(chunk: int, tokens: np.ndarray | None, columns: dict[str, pa.Array | str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The array with lid -1, then a row for each different word or pair (lid from 1)."""
    if tokens is not None and len(tokens):
        raw = pa.py_buffer(tokens.astype("<i4", copy=False))
        one = {"chunk": chunk, "lid": -1, "n": raw.size, "tokens": pa.compress(raw, codec=PACKED, asbytes=True)}
        del raw, tokens
        yield pa.RecordBatch.from_arrays([pa.array([one.pop(f.name, None)], f.type) for f in schema], schema=schema)
    for lo in range(0, len(columns["n"]), 65_536):
        part = {k: v if isinstance(v, str) else v[lo : lo + 65_536] for k, v in columns.items()}
        n = len(part["n"])
        part |= {"chunk": pa.repeat(chunk, n), "tokens": pa.nulls(n, pa.binary())}
        yield pa.RecordBatch.from_arrays([(pa.repeat(v, n) if isinstance(v := part[f.name], str) else v).cast(f.type) for f in schema], schema=schema)


_WORDS = pa.schema([("chunk", pa.int64()), ("lid", pa.int32()), ("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary())])
_PAIRS = pa.schema([("chunk", pa.int64()), ("lid", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def _gathered(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs in tasks of about two chunks of text, or one a core: in tasks of small files or splits, chunks would be small and repeat the same words and pairs."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (2 * chunk_bytes))))


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """WORDS: for each chunk its array and its different words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: dict[str, bytearray] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal at
            at += 1
            tokens, words, n = _numbered(held.pop(lang))
            size.pop(lang)
            columns = {"lid": pa.array(np.arange(1, len(n) + 1)), "lang": lang, "word": words, "n": pa.array(n)}
            rows = _rows(at, tokens, columns, _WORDS)
            del tokens
            yield from rows

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                raw = text.as_py()
                held.setdefault(lang, bytearray()).extend(_plain(raw))
                size[lang] = size.get(lang, 0) + len(raw)
                if size[lang] >= chunk_bytes:
                    yield from flush(lang)
                elif sum(size.values()) >= 4 * chunk_bytes:  # many languages
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    some = docs.where(F.length("text") > 0)
    return _gathered(some.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), chunk_bytes).mapInArrow(run, WORDS)


def _parts(values: np.ndarray) -> Iterator[np.ndarray]:
    """Places of values in parts of about a stretch; values of a later part are larger."""
    some = np.sort(values[:: max(1, STRETCH // 1024)])
    bounds = np.unique(some[1024::1024])
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        yield np.flatnonzero((True if lo is None else values >= lo) & (np.ones(len(values), bool) if hi is None else values < hi))


def _paired(tokens: np.ndarray, lids: np.ndarray, ids: np.ndarray, last: bool = False) -> tuple[np.ndarray | None, ...]:
    """(array of pair numbers unless it is the last level; numbers, left ids, right ids and counts of the pairs) where frequent phrases meet; lids of the chunk are known by ids elsewhere."""
    order = np.argsort(ids)  # rows in the order of ids are close together in a shuffle
    lids, ids = lids[order], ids[order]
    place = np.zeros(max(int(tokens.max()), int(lids.max())) + 1, dtype=np.int32)
    place[lids] = np.arange(1, len(lids) + 1)
    x = place[tokens]
    del tokens
    meet = (x[:-1] > 0) & (x[1:] > 0)
    base = len(lids) + 1
    both = x[:-1][meet].astype(np.int64)
    both *= base
    both += x[1:][meet]
    del x
    at, pair, n, size = np.zeros(0 if last else len(both), dtype=np.int32), [], [], 0
    for where in _parts(both):
        some, code, count = np.unique(both[where], return_inverse=True, return_counts=True)
        if not last:
            at[where] = code + size
        pair, n, size = [*pair, some], [*n, count], size + len(some)
    del both
    pair, n = np.concatenate(pair), np.concatenate(n)
    rank = _ranked(n)
    out = None
    if not last:
        out = np.zeros(len(meet), dtype=np.int32)
        out[meet] = rank[at]
        del at
        out = _closed(out)
    return out, rank, ids[pair // base - 1], ids[pair % base - 1], n


def paired(arrays: DataFrame, last: bool) -> DataFrame:
    """PAIRS of arrays (chunk, n, tokens, held: lid and id of its frequent phrases); the last level needs no arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                held = b.column(3)[i].values
                # nothing here names the arrays, so that each goes as soon as it is used
                tokens, *columns = _paired(np.frombuffer(pa.decompress(b.column(2)[i].as_buffer(), n, codec=PACKED), dtype="<i4"), held.field(0).to_numpy(), held.field(1).to_numpy(), last)
                rows = _rows(chunk, tokens, dict(zip(("lid", "left", "right", "n"), map(pa.array, columns), strict=True)), _PAIRS)
                del tokens, columns
                yield from rows
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    return arrays.mapInArrow(run, PAIRS)


def _hits(rows: DataFrame, on: list[str], least: int) -> DataFrame:
    """chunk, lid, on, f and id of the words or pairs of a chunk that are frequent over all; first marks one row of each.

    One shuffle counts them, names them and finds their chunks; a word or pair has at most one row a chunk.
    """
    same = W.partitionBy(*on)
    found = rows.where("lid > 0").select("chunk", "lid", *on, F.sum("n").over(same).alias("f")).where(F.col("f") >= least)
    found = found.withColumn("_at", F.monotonically_increasing_id()).withColumn("id", F.min("_at").over(same))
    return found.select("chunk", "lid", *on, "f", "id", (F.col("id") == F.col("_at")).alias("first"))


def _few(names: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint if names are counted to be few and short, else nothing."""
    n, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    return F.broadcast if n <= NAMES and size <= NAME_BYTES else lambda df: df


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str, narrow: bool = False, path: str | None = None) -> DataFrame:
    """common.stored; its shuffle files go as soon as it is written, not when the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return common.stored(df, name, narrow, path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def names(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """n of each language, and for each level the stored names.

    A name has id, lang, phrase, last (its last word), f, heads and tails (counts of its leading and
    trailing parts by length), and from the second level on left and right, the ids of its parents a level below.
    A level's rows are deleted once those of the next are stored.
    """
    at = common.scratch(docs.sparkSession, "words")
    rows = _stored(chunked(docs, chunk_bytes), "words", path=at)
    n = _stored(rows.where("lid > 0").groupBy("lang").agg(F.sum("n").alias("n")), "counts", narrow=True)
    none = F.array().cast("array<bigint>")
    levels, on = [], ["lang", "word"]
    while True:
        found = common.scratch(docs.sparkSession, "hits")
        hits = _stored(_hits(rows, on, least), "hits", path=found)
        named = hits.where("first").select("id", *on, "f")
        if not levels:
            word = F.col("word").cast("string")
            named = named.select("id", "lang", word.alias("phrase"), word.alias("last"), "f", none.alias("heads"), none.alias("tails"))
        else:
            below = levels[-1]
            a = below.select(F.col("id").alias("left"), "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
            b = below.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
            few = _few(below)
            named = named.join(few(a), "left").join(few(b), "right")
            named = named.select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "heads", "tails")
        levels.append(_stored(named, "names", narrow=True))
        if len(levels) == longest:
            break
        held = hits.groupBy("chunk").agg(F.collect_list(F.struct("lid", "id")).alias("held"))
        arrays = rows.where("lid = -1").select("chunk", "n", "tokens").join(held.hint("shuffle_hash"), "chunk")
        then = common.scratch(docs.sparkSession, "pairs")
        pairs = _stored(paired(arrays, len(levels) + 1 == longest), "pairs", path=then)
        common.emptied(hits, found)
        common.emptied(rows, at)
        rows, at, on = pairs, then, ["left", "right"]
    common.emptied(hits, found)
    common.emptied(rows, at)
    return n, levels


def _score(k: int) -> Column:
    """(score, place of the cut, l, r) of the lowest-scoring cut of a name of k words; whole numbers of up to 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    over = (F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(16,0)")).cast("decimal(19,0)") * big(F.col("n"))
    cuts = []
    for j in range(1, k):
        part, rest = F.get("heads", F.lit(j - 1)), F.get("tails", F.lit(k - j - 1))
        cuts.append(F.struct(F.call_function("div", over, big(part) * big(rest)).alias("score"), F.lit(j).alias("cut"), part.alias("l"), rest.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language that no longer one of the same count contains."""
    n, levels = names(docs, least, longest, chunk_bytes)
    kept = None
    for k in range(2, longest + 1):
        here = levels[k - 1]
        if k < longest:
            longer = levels[k]
            within = longer.select(F.col("left").alias("id"), F.col("f").alias("_f")).unionByName(longer.select(F.col("right").alias("id"), F.col("f").alias("_f")))
            here = here.join(within.groupBy("id").agg(F.max("_f").alias("_f")), "id", "left").where("_f is null or _f < f")
        scored = here.select("lang", "phrase", "f", "heads", "tails").join(n, "lang").withColumn("_s", _score(k))
        scored = scored.select("lang", "phrase", F.col("f").alias("a"), "_s.l", "_s.r", "n", F.col("_s.score").cast("long").alias("score"))
        kept = scored if kept is None else kept.unionByName(scored)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = kept.withColumn("_place", F.row_number().over(W.partitionBy("lang", share).orderBy(*best))).where(F.col("_place") <= top)
    out = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


def _oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """DuckDB: every phrase of every piece, counted as it stands."""
    ends = "[" + "".join({"\n": "\\n", "\x0b": "\\x0b", "\x0c": "\\x0c", "\r": "\\r"}.get(c, c) for c in ENDS) + "]"
    of = lambda k: f"SELECT lang, {k} AS k, {" || ' ' || ".join(f"w{j}" for j in range(k))} AS p FROM runs WHERE w{k - 1} IS NOT NULL"
    cut = lambda k, j: f"SELECT lang, k, p, f, {j} AS j, lang || chr(10) || list_aggregate(s[1:{j}], 'string_agg', ' ') AS x, lang || chr(10) || list_aggregate(s[{j + 1}:], 'string_agg', ' ') AS y FROM cand WHERE k = {k}"
    sub = lambda kj: f"SELECT lang, f, unnest(list_transform(range(1, {kj[0] - kj[1] + 2}), lambda i: list_aggregate(s[i:i+{kj[1] - 1}], 'string_agg', ' '))) AS p FROM cand WHERE k = {kj[0]}"
    return f"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ends}')) AS piece FROM documents)),
words AS (SELECT lang, pid, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (SELECT lang, w0, {", ".join(f"lead(w0, {j}) OVER (PARTITION BY pid ORDER BY i) AS w{j}" for j in range(1, longest))} FROM words),
f AS (SELECT lang, k, p, lang || chr(10) || p AS id, count(*) AS f FROM ({" UNION ALL ".join(map(of, range(1, longest + 1)))}) GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, f, string_split(p, ' ') AS s FROM f WHERE k >= 2 AND f >= {least}),
cuts AS ({" UNION ALL ".join(cut(k, j) for k in range(2, longest + 1) for j in range(1, k))}),
scored AS (
  SELECT c.lang, c.k, c.p, c.f, a.f AS l, b.f AS r, t.n, c.j, (1000::HUGEINT * c.f * t.n) // (a.f::HUGEINT * b.f) AS score
  FROM cuts c JOIN t USING (lang) JOIN f a ON a.id = c.x JOIN f b ON b.id = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, p ORDER BY score, j) = 1),
inside AS ({" UNION ALL ".join(map(sub, [(k, j) for k in range(3, longest + 1) for j in range(2, k)]))}),
held AS (SELECT lang, p, max(f) AS most FROM inside GROUP BY lang, p),
whole AS (SELECT x.* FROM lowest x LEFT JOIN held h ON h.lang = x.lang AND h.p = x.p WHERE h.most IS NULL OR 100 * h.most < 100 * x.f)
SELECT lang, rank, p AS phrase, f AS a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(p)) AS rank FROM whole) WHERE rank <= {top}"""


QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
ORACLES = {"op11_phrase_collocations": _oracle()}
