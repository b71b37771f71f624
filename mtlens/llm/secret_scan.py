"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern in every whole text. What a candidate is worth shows in who has it: a value
that several owners carry is a copied example, one that a single owner keeps and that looks random is
live-looking. Candidate hashes are aggregated by distinct owners and repositories over the corpus (first
per owner and repository, then per owner, then per hash, so that a value which everyone carries
is a few partial rows), and the verdict goes back to the spans.

Base spans (``assign``, ``access``, ``hex``) always stand. The method adds ``vendor`` spans (key formats of known
issuers) and those ``opaque`` spans (long mixed runs) that touch no other span and turn out live-looking.

Everything is DataFrame expressions. Positions come from splitting a text at its matches:
the pieces and matches before a match add up to its start, summed per text and kind over rows
of candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# fixed values: the base patterns
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of 16 or more starts where any shorter reading would
HEX = r"[0-9a-f]{32,}"
# added by the method
VENDOR = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("vendor", VENDOR), ("opaque", OPAQUE))
BASE = 3  # the first kinds are the base
OWNERS = 3  # so many owners make a value a copied example,
REPOS = 10  # and so do so many repositories, whoever owns them
PLACEHOLDER = r"(?i)example|changeme|placeholder|your|dummy|sample|xxxx|1234567|abcdef0|0{8}"


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    """(row_key, owner, repo, kind, i, start, end, value): every match, kinds by number, ends exclusive, code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(_row_key(docs, owner, repo), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), text.alias("t"))
    per_kind = []
    for k, (name, pattern) in enumerate(KINDS):
        found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all("t", F.lit(pattern), F.lit(2)) if name == "assign" else found
        pieces = F.split("t", pattern, -1)
        # only texts with a match are split
        rows = F.zip_with(F.slice(pieces, 1, F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")), lambda p, x: F.struct(
            F.char_length(p).alias("gap"), F.char_length(x["m"]).alias("size"), x["v"].alias("value")))
        empty = F.array().cast("array<struct<gap:int,size:int,value:string>>")
        per_kind.append(F.when(F.col("t").rlike(pattern), rows).otherwise(empty).alias(f"k{k}"))
    arrays = keyed.select("row_key", "owner", "repo", *per_kind)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("found")) for k in range(len(KINDS))])
    # outer: an inferred filter on the arrays' sizes would run the patterns twice
    stacked = arrays.select("row_key", "owner", "repo", F.explode_outer(kinds).alias("x")).where("size(x.found) > 0").select("row_key", "owner", "repo", "x.kind", F.posexplode("x.found").alias("i", "m"))
    one = materialize(stacked.select("row_key", "owner", "repo", "kind", "i", "m.gap", "m.size", "m.value").distinct(), "candidates")
    upto = Window.partitionBy("row_key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    spans = one.select("row_key", "owner", "repo", "kind", "i", (end - F.col("size")).alias("start"), end.alias("end"), "value")
    return spans.where((F.col("kind") != 0) | (F.char_length("value") >= 8))


def _row_key(docs: DataFrame, owner: str, repo: str) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col(owner), F.col(repo)).alias("row_key")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos): distinct owners and repositories of each value; null counts as one of its own."""
    each = spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def live_looking(value: Column) -> Column:
    """Random rather than written: letters and digits, many different characters, no placeholder."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= 8) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """(row_key, spans): spans per row with any, an array of (start, kind, end, verdict, n_owners, n_repos), sorted.

    ``verdict``: example (``owners`` or more owners or ``repos`` or more repositories have the value), live (fewer, and it
    looks random), unclear. Null and empty texts have no spans, texts may be of any length; rows equal in id, text, owner
    and repository share a key and count once. Other columns, whatever their names, are not read.
    """
    found = candidates(docs, owner, repo).withColumn("hash", F.sha2("value", 256))
    found = materialize(found, "spans")
    asked = found.join(ownership(found), "hash")
    verdict = F.when((F.col("n_owners") >= owners) | (F.col("n_repos") >= repos), "example").when(live_looking(F.col("value")), "live").otherwise("unclear")
    asked = asked.withColumn("verdict", verdict)
    # opaque spans stand alone: no other span reaches in from before, none starts before their end
    row = Window.partitionBy("row_key").orderBy("start", "end", "kind")
    solid = F.col("kind") < len(KINDS) - 1
    before = F.max(F.when(solid, F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(solid, F.col("start"))).over(row.rowsBetween(1, Window.unboundedFollowing))
    asked = asked.withColumn("before", before).withColumn("after", after)
    alone = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
    asked = asked.where(solid | (alone & (F.col("verdict") == "live")))
    span = F.struct("start", "kind", "end", "verdict", "n_owners", "n_repos")
    return asked.groupBy("row_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(name) for name, _ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live."""
    spans = scan(docs, owner, repo)
    rows = docs.select(F.col("doc_id"), _row_key(docs, owner, repo))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string,n_owners:bigint,n_repos:bigint>>")
    rows = rows.join(spans, "row_key", "left").select("doc_id", F.coalesce("spans", empty).alias("all"))

    def number(test) -> Column:
        return F.size(F.filter("all", test)).cast("long")

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [number(of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    base = F.filter("all", lambda s: s["kind"] < BASE)
    return rows.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("all")).alias("spans"),
        number(lambda s: s["verdict"] == "example").alias("n_example"), number(lambda s: s["verdict"] == "live").alias("n_live"),
    )
