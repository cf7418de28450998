"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is known by the SHA-256 of its text (its blob).  The
ledger is a table with one row for each blob and scan: which rule versions ran
over the blob and what they found.  A scan reads the ledger, works out which
(blob, rule version) pairs it has not seen, runs just those rules over one
body of each such blob, appends the outcome, and joins the findings
of the current rule versions back to every path that ever held the blob.

Main path: DataFrame functions alone.  A blob that a third of all rows share is
read once for each row (to hash it), put together within tasks before the shuffle,
scanned once, and joined back by a join that AQE may split.

Defined cases: a null text is an empty text; an empty table gives an empty
result; repeated rows each get the findings of their blob, which is scanned once; a
null id is a path like any other; spans that start together are in the order of the
rules; a text is scanned as a whole, in memory that grows with its own length; columns
beyond the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression whose matches are never empty.

    A match counts if the given group has least characters or more; a match that
    fails still uses up its characters.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values of the contract: kinds, patterns and least lengths, in this order.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    # A maximal run of 32 or more is the same span as `[0-9a-f]+` kept at 32 or more.
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Further kinds of high precision; they only add spans.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + MORE


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule, in code points: lengths of what lies between matches and of the matches, added up."""
    long = lambda c: F.transform(c, F.length)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    # gaps has one element more than there are matches; the fold drops the pad again
    items = F.arrays_zip(long(gaps).alias("gap"), long(whole).alias("hit"), long(held).alias("held"))
    none = F.array().cast(SPAN)

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["out"], F.array(span)).cast(SPAN)).otherwise(acc["out"]).alias("out"))

    # An array that grows by one element is copied each time: runs of about the square root of all matches are folded on their own.
    run = lambda v: F.ceil(F.sqrt(F.size(v))).cast("int")
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), run(v)), lambda i: F.slice(v, i, run(v)))
    runs = F.flatten(F.transform(F.array(items), cut))

    def many(acc: Column, part: Column) -> Column:
        before = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(part, F.struct(before.alias("at"), none.alias("out")), one)))

    folded = F.aggregate(runs, F.array().cast(f"array<struct<at:int,out:{SPAN}>>"), many)
    step = F.flatten(F.transform(folded, lambda f: f["out"]))
    return F.when(text.rlike(rule.pattern), step).otherwise(none)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(
        F.lit(b"").alias("blob"), F.array(F.lit("")).alias("scanned"), F.array().cast(SPAN).alias("spans")
    )


def _addressed(versions: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(key).alias("path"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("blob"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows: one for each blob that some current rule version has not read yet."""
    v = _addressed(versions, key, text)
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        todo = v.groupBy("blob").agg(F.min("path").alias("first")).join(seen, "blob", "left")
        todo = todo.select(F.col("blob").alias("want"), "first", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        # The build side is the narrow one; texts are hashed by path, so copies of one blob do not meet in a task.
        v = v.join(todo.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("want")))
    else:
        v = v.withColumn("todo", every)
    # One body a blob: equal ones are put together before the shuffle.
    rows = v.groupBy("blob").agg(F.any_value("body").alias("body"), F.any_value("todo").alias("todo"))
    found = [
        F.when(F.array_contains("todo", r.key), _spans(F.col("body"), r, i)).otherwise(F.array().cast(SPAN))
        for i, r in enumerate(rules)
    ]
    return rows.select("blob", F.col("todo").alias("scanned"), F.concat(*found).alias("spans"))


def _different(ordered: Column) -> Column:
    """A sorted array without repeats, by a look at the element before."""
    once = lambda v: F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1) != x))
    return F.flatten(F.transform(F.array(ordered), once))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, spans) for every row of versions: spans of the current rule versions, by start, then kind in the order of rules."""
    kinds = [r.kind for r in rules]
    current = F.array(*[F.lit(r.key) for r in rules])
    hits = ledger.where((F.size("spans") > 0) & F.arrays_overlap("scanned", current))
    # A kind counts only from scans by its current version; its place in `rules` ranks it.
    fresh = F.filter(
        "spans",
        lambda s: F.exists("scanned", lambda k: F.array_contains(current, k) & (F.substring_index(k, "@", 1) == s["kind"])),
    )
    ranked = F.transform(
        fresh,
        lambda s: F.struct(s["start"].alias("start"), (F.array_position(F.array(*map(F.lit, kinds)), s["kind"]) - 1).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    by_blob = (
        hits.select("blob", ranked.alias("spans"))
        .groupBy("blob")
        .agg(_different(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    paths = _addressed(versions, key, text).select("path", "blob")
    return paths.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """findings() of versions after bringing the ledger at ledger_path up to date.

    Without a path the ledger is a new one in the shared scratch folder: every blob is unseen.
    """
    spark = versions.sparkSession
    old = None
    if ledger_path is None:
        ledger_path = common.scratch(spark, "secret-ledger")
    else:
        try:
            old = spark.read.schema(empty_ledger(spark).schema).parquet(ledger_path)
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    scan_unseen(versions, old, rules, key, text).write.mode("append").parquet(ledger_path)
    return findings(versions, spark.read.schema(empty_ledger(spark).schema).parquet(ledger_path), rules, key, text)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with every stretch that spans cover replaced by mark; overlapping spans make one stretch."""
    none = F.array().cast("array<string>")
    end = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        )

    parts = F.aggregate(spans, end, step, lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))))
    return F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(text)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """DuckDB: every span from what lies between the matches and the matches themselves, by brute force."""

    def kind(i: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""
  SELECT rid, {i} AS rank, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{
      'ok': length(held[i]) >= {r.least},
      's': list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::BIGINT,
      'n': length(hits[i])}}), lambda x: x.ok)) AS m
  FROM (SELECT rid, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {r.group}) AS held
        FROM d WHERE regexp_matches(t, '{p}'))"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(kind(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT rid, rank, kind, m.s AS s, kind || ':' || m.s || ':' || (m.s + m.n) AS span FROM f),
h AS (SELECT rid, string_agg(span, ',' ORDER BY s, rank) AS spans, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
      {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)} FROM g GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (rid)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": _oracle()}
