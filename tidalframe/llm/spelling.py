"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form that each goes back to.

Of two such words, the shorter of m letters, either the first or the last half of m letters is the same in
both, so each word is dealt to a forward key (its first half) and a backward key (its last half), for m its
own length and one less.  The words of a key have that half exactly in common.  What is left of them becomes a minimal
acyclic automaton, of the reversed words for backward keys, whose transitions carry word numbers
(how many words come before, so that a path's sum is the word's place in the sorted list); each word's rest is then completed
in it with exactly one error.  A pair that both keys hold counts in the forward one: the backward one leaves out pairs whose first
half is the same, which each side sees for itself.

A key with more than GROUP words is split: what is left between the common ends is halved once more, again forward
and backward, until the groups are small or two letters are left, so no task meets a large group and no pair is lost.

Defined cases: a null text has no words, a null id is an empty one in the checksum; repeated rows count again; the largest n wins,
ties go to the smallest in code-point order; a word may be of any length; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST = 7
LEAST = 2
#: One in so many runs loses a letter.
MISSPELT = 31
#: A form has at least so many times the word's occurrences.
TIMES = 10
#: Words of one key in a task.
GROUP = 4_096
_ANY = (1 << 31) - 1


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: the distinct words of all texts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(0))
    runs = docs.select(common.id_text("doc_id").alias("id"), F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.col("h") % F.length("run")
    short = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
    word = F.when(F.col("h") % MISSPELT == 0, short).otherwise(F.col("run"))
    counted = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= shortest)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _dealt(rows: DataFrame, options: Column) -> DataFrame:
    """A row for each of options (m, pre, suf, most): the key of a word's first pre and last suf letters; pairs with `most` first letters in common are left out."""
    each = rows.select("word", "n", F.explode(options).alias("o")).select("word", "n", "o.*")
    ends = (F.substr("word", F.lit(1), F.col("pre")), F.substr("word", F.length("word") - F.col("suf") + 1))
    return each.withColumn("key", F.xxhash64("m", "pre", "suf", "most", *ends))


def _option(m: Column, pre: Column, suf: Column, most: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), pre.cast("int").alias("pre"), suf.cast("int").alias("suf"), most.cast("int").alias("most"))


def keyed(vocabulary: DataFrame, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """word, n and m, pre, suf, most, key: rows whose keys have at most `group` words, but for those with two letters or less between their ends."""
    n, none, zero = F.length("word"), F.lit(_ANY), F.lit(0)
    both = lambda m: [_option(m, F.floor(m / 2), zero, none), _option(m, zero, F.floor(m / 2), F.floor(m / 2))]
    rows = _dealt(vocabulary, F.filter(F.array(*both(n), *both(n - 1)), lambda o: o["m"] >= shortest))
    done = None
    while True:
        many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group)
        many = common.stored(many.select("key"), "large-keys", narrow=True)
        if many.isEmpty():
            return rows if done is None else done.unionByName(rows)
        many = common.small(many)
        left = F.col("m") - F.col("pre") - F.col("suf")
        ready = rows.join(many, "key", "left_anti").unionByName(rows.join(many, "key", "left_semi").where(left < 2))
        done = ready if done is None else done.unionByName(ready)
        m, pre, suf, most, half = F.col("m"), F.col("pre"), F.col("suf"), F.col("most"), F.floor(left / 2)
        halves = F.array(_option(m, pre + half, suf, most), _option(m, pre, suf + half, F.least(most, (pre + half).cast("int"))))
        rows = common.stored(_dealt(rows.join(many, "key", "left_semi").where(left >= 2).withColumn("_o", halves).select("word", "n", "_o"), F.col("_o")), "keys")


class Automaton:
    """A minimal acyclic automaton of sorted different words; each transition has the state it leads to and how many words come before."""

    def __init__(self, sorted_words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = [{}]
        self.final = [False]
        self.words = [0]
        known: dict[tuple, int] = {}
        path, last = [0], ""
        to: list[dict[str, int]] = [{}]

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                s = path.pop()
                self._number(s, to[s])
                same = known.setdefault((self.final[s], tuple(to[s].items())), s)
                to[path[-1]][last[len(path) - 1]] = same

        for w in sorted_words:
            p, most = 0, min(len(last), len(w))
            while p < most and last[p] == w[p]:
                p += 1
            close(p)
            for c in w[p:]:
                self.edges.append({})
                self.final.append(False)
                self.words.append(0)
                to.append({})
                to[path[-1]][c] = len(to) - 1
                path.append(len(to) - 1)
            self.final[path[-1]] = True
            last = w
        close(0)
        self._number(0, to[0])

    def _number(self, s: int, to: dict[str, int]) -> None:
        before = int(self.final[s])
        for c, t in to.items():
            self.edges[s][c] = (t, before)
            before += self.words[t]
        self.words[s] = before

    def place(self, word: str, at: int = 0, state: int = 0, before: int = 0) -> int:
        """The number of word[at:] from a state on, -1 if it is not there."""
        edges = self.edges
        for c in word[at:]:
            step = edges[state].get(c)
            if step is None:
                return -1
            state, before = step[0], before + step[1]
        return before if self.final[state] else -1

    def near(self, word: str, replaced: bool = True, inserted: bool = True, deleted: bool = True) -> set[int]:
        """Numbers of the words with exactly one letter replaced, one more, or one less."""
        out: set[int] = set()
        state = before = 0
        for i in range(len(word) + 1):
            c = word[i] if i < len(word) else None
            if deleted and c is not None:
                out.add(self.place(word, i + 1, state, before))
            for d, (t, k) in self.edges[state].items():
                if inserted:
                    out.add(self.place(word, i, t, before + k))
                if replaced and c is not None and d != c:
                    out.add(self.place(word, i + 1, t, before + k))
            step = self.edges[state].get(c) if c is not None else None
            if step is None:
                break
            state, before = step[0], before + step[1]
        out.discard(-1)
        own = self.place(word)
        out.discard(own)
        return out


def _near_of_key(m: int, pre: int, suf: int, most: int, held: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the best one's n, the best one) for the words of one key that have any: pairs of m letters, or m and m + 1."""
    back = suf > pre
    rest = {}
    for w, n in held:
        x = w[pre : len(w) - suf]
        rest[x[::-1] if back else x] = (w, n)
    order = sorted(rest)
    automaton = Automaton(order)
    whole = [rest[x] for x in order]
    found: dict[str, list] = defaultdict(lambda: [0, 0, ""])

    def note(w: str, other: str, n: int) -> None:
        f = found[w]
        f[0] += 1
        if n > f[1] or (n == f[1] and other < f[2]):
            f[1], f[2] = n, other

    for x, (w, n) in zip(order, whole, strict=True):
        if len(w) != m:
            continue
        for i in automaton.near(x, deleted=False):
            v, k = whole[i]
            if v[:most] == w[:most]:
                continue
            note(w, v, k)
            if len(v) > m:  # words of m + 1 letters do not search here
                note(v, w, n)
    for w, f in found.items():
        yield (w, *f)


def near_words(vocabulary: DataFrame, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """word, near, best_n, best: a row for each word and key that holds near words of it; each pair counts in one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for lo in range(0, b.num_rows, 8192) for r in zip(*(c.to_pylist() for c in b.slice(lo, 8192).columns), strict=True))
        made = []
        for _, same in groupby(rows, key=itemgetter(0)):
            same = list(same)
            if len(same) < 2:
                continue
            exact = defaultdict(list)  # keys are hashes
            for _, m, pre, suf, most, w, n in same:
                exact[m, pre, suf, most, w[:pre], w[len(w) - suf :]].append((w, n))
            for (m, pre, suf, most, *_), held in exact.items():
                if len(held) > 1:
                    made += _near_of_key(m, pre, suf, most, held)
            if len(made) >= 16_384:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

    rows = keyed(vocabulary, shortest, group).select("key", "m", "pre", "suf", "most", "word", "n")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near long, best_n long, best string")


def variants(vocabulary: DataFrame, times: int = TIMES, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of vocabulary (word, n), a stored table."""
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("b"))
    best = F.struct((-F.col("best_n")).alias("less"), "best")
    near = near_words(vocabulary, shortest, group).select("word", F.lit(None).cast("long").alias("n"), "near", best.alias("b"))
    found = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b"))
    stands = -F.col("b.less") >= times * F.col("n")
    found = common.stored(found.select("word", "n", "n_near", F.when(stands, F.col("b.best")).alias("form"), F.when(stands, -F.col("b.less")).alias("form_n")), "forms")
    # Forms grow by `times` a step, so a few doublings reach every root.
    to = common.stored(found.where("form is not null").select("word", F.col("form").alias("root")), "roots", narrow=True)
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = common.stored(to.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots", narrow=True)
        to = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.stored(words(common.documents(spark, sf_dir)), "vocabulary"))


def _oracle() -> str:
    """DuckDB: the checksum bit by bit, near words by equal remains after one letter is taken out."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= {SHORTEST} GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: {bits}), 4294967295) AS h FROM u),
m AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substring(w, 1, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT AS n FROM m WHERE length(w) >= {SHORTEST} GROUP BY w HAVING sum(n) >= {LEAST}),
i AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
d AS (SELECT w, n, i, substring(w, 1, i - 1) || substring(w, i + 1) AS d FROM i),
p AS (SELECT a.w, b.w AS x, b.n FROM d a JOIN d b ON a.d = b.d AND a.i = b.i AND a.w <> b.w
  UNION SELECT d.w, v.w, v.n FROM d JOIN v ON d.d = v.w
  UNION SELECT v.w, d.w, d.n FROM d JOIN v ON d.d = v.w),
q AS (SELECT w, count(*) AS n_near, max(n) AS n FROM p GROUP BY w),
b AS (SELECT w, x, n FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, encode(x)) = 1),
f AS (SELECT v.w, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN b.n >= {TIMES} * v.n THEN b.x END AS form, CASE WHEN b.n >= {TIMES} * v.n THEN b.n END AS form_n
  FROM v LEFT JOIN q USING (w) LEFT JOIN b ON b.w = v.w),
g AS (SELECT w, w AS r, 0 AS k FROM f UNION ALL SELECT g.w, f.form, g.k + 1 FROM g JOIN f ON f.w = g.r WHERE f.form IS NOT NULL),
z AS (SELECT w, max_by(r, k) AS root FROM g GROUP BY w)
SELECT f.w AS word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z USING (w)"""


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op12_spelling_variants": _oracle()}
