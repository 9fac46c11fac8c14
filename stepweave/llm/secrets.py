"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every text. Their values' hashes are
aggregated over the corpus by distinct repository and distinct owner: a value
that many owners or many repositories have is a widely copied example; one that
looks random and stays with one owner is taken for live, with a few owners for
shared. The findings come back as further spans over the value, beside the
patterns' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base

#: Kinds in the order that breaks ties; the last three are added by ownership.
KINDS = ("assign", "access", "hex", "live", "shared", "example")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Words that mark a value as a stand-in where they stand alone or make up half of it.
PLACEHOLDERS = ("example", "sample", "changeme", "placeholder", "your", "dummy", "xxxx", "test", "redacted")
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 10
LIVE_ENTROPY = 2.5

_WORDS = "|".join(PLACEHOLDERS)
ALONE = f"(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)"
_KEY = ["doc_id", "text_key"]


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Of each match: its kind and number, the length of what lies before it, its own, and its value (null: too short)."""
    between, matches = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else matches
    each = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))

    def made(m: Column, i: Column) -> Column:
        value = F.when(F.length(m["value"]) >= LEAST[kind], m["value"])
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("n"), value.alias("value"))

    empty = F.array().cast("array<struct<rank:int,i:int,gap:int,n:int,value:string>>")
    return F.coalesce(F.when(F.regexp_like(text, F.lit(pattern)), F.transform(each, made)), empty)


def _live_looking(value: Column) -> Column:
    """Letters and digits both, no stand-in word, and enough entropy for each character."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda total, c: F.when(F.length(c) == 0, total).otherwise(total - share(c) * F.log2(share(c))))
    low = F.lower(value)
    stand_in = low.rlike(ALONE) | (2 * F.length(F.regexp_replace(low, _WORDS, "")) <= F.length(low))
    return (entropy >= LIVE_ENTROPY) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~stand_in


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, text_key, owner, repository and ``hits``, all pattern matches of each row's text."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(F.col("doc_id"), F.xxhash64(body).alias("text_key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), body.alias("body"))
    # Runs that are too short can't hide others of these two kinds, so the length goes into the pattern.
    access = ACCESS.replace("+", "{%d,}" % (LEAST["access"] - 4))
    long_hex = HEX.replace("+", "{%d,}" % LEAST["hex"])
    return one.select(*_KEY, "owner", "repository", F.concat(_found(F.col("body"), ASSIGN, "assign"), _found(F.col("body"), access, "access"), _found(F.col("body"), long_hex, "hex")).alias("hits"))


def base_spans(found: DataFrame) -> DataFrame:
    """doc_id, text_key, rank, start, end, value: a row for each match that is long enough, once for each document and text.

    Offsets are running sums over the lengths of a text's matches and of what
    lies between them, in one sorted pass.
    """
    once = found.where(F.size("hits") > 0).groupBy(*_KEY).agg(F.first("hits").alias("hits"))
    each = once.select(*_KEY, F.explode("hits").alias("h")).select(*_KEY, "h.*")
    so_far = Window.partitionBy(*_KEY, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far))
    return placed.where(F.col("value").isNotNull()).select(*_KEY, "rank", (F.col("end") - F.col("n")).alias("start"), "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_rows, n_repositories, n_owners, live_looking over all candidates; aggregated map-side at each of three levels."""
    values = found.select("owner", "repository", F.explode("hits").alias("c")).where(F.col("c.value").isNotNull()).select(F.sha2("c.value", 256).alias("value_hash"), "owner", "repository", F.col("c.value").alias("value"))
    by_repository = values.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    of_owners = by_repository.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.first("value").alias("value")).groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.count("owner").alias("n_owners"), F.first("value").alias("value"))
    # A repository may have several owners and counts once.
    of_repositories = by_repository.where("repository is not null").groupBy("value_hash", "repository").count().groupBy("value_hash").agg(F.count("*").alias("n_repositories"))
    total = of_owners.join(of_repositories, "value_hash", "left")
    return total.select("value_hash", "n_rows", F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"), "n_owners", _live_looking(F.col("value")).alias("live_looking"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_SPAN = "array<struct<kind:string,rank:int,start:bigint,end:bigint,value:string>>"


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Spans of secrets in each document: doc_id, base and added (arrays of kind, rank, start, end, value), max_repositories, max_owners.

    base has the patterns' matches of 12 (assign: of its value), 18 (access) and
    16 (hex) characters at least, leftmost and non-overlapping for each kind;
    shorter matches are passed over. added has, over the value, ``example``
    where at least copied_owners distinct owners or copied_repositories distinct
    repositories have it; else, if it looks random, ``live`` where one owner at
    most has it and ``shared`` where more do; other values have none. The
    numbers are of the document's most widespread value, 0 without any. Offsets
    are code points, end exclusive.

    Null text is empty and has no spans. A null owner is no owner, a null
    repository no repository. Repeated rows each have a result row; their values
    are those of one document. Other columns are ignored; an empty table gives
    an empty result.
    """
    _base.require(docs, "doc_id", text, owner, repository)
    found = _base.checkpoint(candidates(docs, text, owner, repository))
    known = _base.checkpoint(ownership(found))
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    spans = base_spans(found).withColumn("value_hash", F.sha2("value", 256))
    judged = _base.spread_join(spans, known, ["value_hash"], "n_rows")
    rank = F.when(copied, KINDS.index("example")).when(F.col("live_looking"), F.when(F.col("n_owners") <= 1, KINDS.index("live")).otherwise(KINDS.index("shared")))
    name = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r + 1)
    span = lambda r, start: F.struct(name(r).alias("kind"), r.alias("rank"), start.alias("start"), F.col("end").alias("end"), F.col("value").alias("value"))
    added = F.when(F.col("new").isNotNull(), span(F.col("new"), F.col("end") - F.length("value")))
    of = (
        judged.withColumn("new", rank)
        .groupBy(*_KEY)
        .agg(F.collect_list(span(F.col("rank"), F.col("start"))).alias("base"), F.collect_set(added).alias("added"), F.max("n_repositories").alias("max_repositories"), F.max("n_owners").alias("max_owners"))
    )
    # Rows without matches need no join, so no key gathers them.
    has = F.size("hits") > 0
    named = of.withColumnsRenamed({"doc_id": "its_id", "text_key": "its_key"})
    rows = found.where(has).select(*_KEY).join(named, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left").drop("text_key", "its_id", "its_key")
    without = found.where(~has).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("base", _SPAN), ("added", _SPAN), ("max_repositories", "bigint"), ("max_owners", "bigint"))])
    empty = F.array().cast(_SPAN)
    return rows.unionByName(without).select("doc_id", *[F.coalesce(c, empty).alias(c) for c in ("base", "added")], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("max_repositories", "max_owners")])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example, max_repositories, max_owners; owners are sources, repositories documents."""
    out = scan_secrets(_base.table(spark, sf_dir, "documents"))
    n = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(n("base", k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        *(n("added", k).alias(f"n_{k}") for k in KINDS[3:]),
        "max_repositories",
        "max_owners",
    )


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text; for tests."""
    import re

    found = []
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                found.append((m.start(), KINDS.index(kind), kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]
