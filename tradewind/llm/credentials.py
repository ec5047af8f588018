"""Secret scan with corpus-wide ownership of every candidate, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewind.llm.common import stored


@dataclass(frozen=True)
class Kind:
    """Pattern of a candidate, the group that holds its value, and what a match must satisfy."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    mixed: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The given kinds. Runs that are too short can hide no longer one, so hex and access carry their least
#: length in the pattern; a short assign may hold the start of another one and is dropped after matching.
BASE = (
    Kind("assign", "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: What the scan adds where one owner alone has the value.
MORE = (
    Kind("login", r"://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/@]+)@", 1, 6),
    Kind("issued", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}"),
    Kind("mixed", r"[A-Za-z0-9+/_-]{20,}", mixed=True),
)
KINDS = BASE + MORE


def _parts(text: Column, number: int, kind: Kind) -> Column:
    """A struct per match of the text: length of what stands before it, of itself, and its value; none without a match."""
    pattern = F.lit(kind.pattern)
    parts = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"))
    rows = F.transform(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["match"]).cast("long").alias("length"), p["value"].alias("value")))
    return F.when(text.rlike(kind.pattern), F.struct(F.lit(number).alias("kind"), rows.alias("parts")))


def _holds(value: Column, kind: Kind) -> Column:
    """Whether a match counts: its value is long enough, and a mixed one has a digit, a letter and ten different characters."""
    enough = F.length(value) >= kind.least
    if kind.mixed:
        enough &= value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
    return enough


def candidates(docs: DataFrame, doc_id: str, text: str, repository: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a stored row number and id of every document, and every candidate of every document by that number.

    Places come from running sums over what stands between the matches, so the
    work is linear in the matches of a text. The texts are read once; what is
    stored holds no more of them than the candidates' values.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.filter(F.array(*(_parts(whole, n, k) for n, k in enumerate(KINDS))), lambda k: k.isNotNull()).alias("found")), "secret-candidates")
    parts = rows.select("row", "repository", "owner", F.explode("found").alias("f")).select(
        "row", "repository", "owner", F.col("f.kind").alias("kind"), F.posexplode("f.parts").alias("at", "part"))
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holds = F.lit(False)
    for n, k in enumerate(KINDS):
        holds = F.when(F.col("kind") == n, _holds(F.col("value"), k)).otherwise(holds)
    spans = parts.select("row", "repository", "owner", "kind", "at", F.col("part.length").alias("length"), F.col("part.value").alias("value"),
                         F.sum(F.col("part.gap") + F.col("part.length")).over(before).alias("end"))
    return rows, spans.filter(holds).select(
        "row", "repository", "owner", "kind", (F.col("end") - F.col("length")).alias("start"), "end", F.unhex(F.sha2("value", 256)).alias("value_hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners): how many distinct ones hold each value; a null is one of them.

    Repeats go before the shuffle, and the counts of a value are added up from
    partial ones: a value that is everywhere is no more work for its task than another.
    """
    def named(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("none"))

    who = spans.select("value_hash", F.lit(False).alias("owner"), named("repository").alias("who")).union(
        spans.select("value_hash", F.lit(True), named("owner"))).distinct()
    return who.groupBy("value_hash").agg(F.count_if(~F.col("owner")).alias("repositories"), F.count_if("owner").alias("owners"))


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "repository", owner: str = "owner",
             common_repositories: int = 10, common_owners: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every document with its row number, and every candidate with place, counts and standing.

    A span has kind (a number in KINDS), start and end (code points, end
    exclusive), the SHA-256 of its value, the number of distinct repositories
    and owners that hold the value anywhere, whether its kind is a base one, and
    its standing: ``example`` from ``common_owners`` owners or
    ``common_repositories`` repositories on, ``live`` with one owner below that,
    else ``shared``. Null texts have no span. A null repository or owner counts
    as one of its own. Repeated rows and ids are documents of their own, in the
    counts they are the same repository. No rows: no spans. Candidates of a value that is
    everywhere meet its counts in a join whose large partitions Spark splits.
    """
    rows, spans = candidates(docs, doc_id, text, repository, owner)
    standing = F.when((F.col("owners") >= common_owners) | (F.col("repositories") >= common_repositories), "example").when(F.col("owners") == 1, "live").otherwise("shared")
    return rows.select("row", "doc_id"), (
        spans.join(ownership(spans), "value_hash")
        .select("row", "kind", "start", "end", "value_hash", "repositories", "owners", (F.col("kind") < len(BASE)).alias("base"), standing.alias("standing")))


def reported(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document.

    All base spans, and of the other kinds those with standing ``live`` that lie
    in no earlier span. Ordered by start, then kind; a document without spans
    has zeros and empty texts.
    """
    order = Window.partitionBy("row").orderBy("start", "kind")
    names = F.array(*(F.lit(k.name) for k in KINDS))
    kept = (
        spans.filter("base or standing = 'live'")
        .withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("base or reached is null or reached < end")
        .withColumn("name", F.concat_ws(":", F.element_at(names, F.col("kind") + 1), "start", "end"))
    )
    of = [F.count_if(F.col("kind") == n).alias(f"n_{k.name}") for n, k in enumerate(BASE)]
    sorted_names = F.sort_array(F.collect_list(F.struct("start", "kind", "base", "name")))
    texts = kept.groupBy("row").agg(*of, sorted_names.alias("all"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: s["name"]))
    texts = texts.select("row", *(f"n_{k.name}" for k in BASE), joined(F.filter("all", lambda s: s["base"])).alias("b"), joined(F.col("all")).alias("s"))
    return rows.join(texts, "row", "left").select(
        "doc_id", *(F.coalesce(f"n_{k.name}", F.lit(0).cast("long")).alias(f"n_{k.name}") for k in BASE),
        F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("s", F.lit("")).alias("spans"))
