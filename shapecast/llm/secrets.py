"""Secret scans with corpus-wide ownership frequency.

Patterns give candidate spans in each text. The values' hashes are then counted over the whole corpus by distinct owners
and repositories: a value that many owners have was copied from an example, one that a single owner has looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: (kind, quick test, pattern, shortest value). A match's value is its last group if it has two, else all of it.
#: The patterns of the first three kinds.
KINDS = [
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 18),
    ("hex", "[0-9a-f]{16}", "[0-9a-f]{16,}", 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{30}", "gh[pousr]_[A-Za-z0-9]{30,}", 34),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28),
    ("pem", "-----BEGIN", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\n\r]*", 30),
]


def _spans(text: Column, kind: int) -> Column:
    """array<(start, end, kind, name, value)> of one pattern in code points: what splitting leaves between the matches has the lengths from which their places follow."""
    name, quick, pattern, least = KINDS[kind]
    groups = 2 if name == "assign" else 0
    gap = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)) if groups else whole
    parts = F.transform(F.arrays_zip(F.slice(gap, 1, F.size(gap) - 1).alias("g"), whole.alias("w"), value.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["w"]).alias("w"), x["v"].alias("v")))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,kind:int,name:string,value:string>>").alias("all"))

    def put(a, x):
        start = a["end"] + x["g"]
        return F.struct((start + x["w"]).alias("end"), F.when(F.length(x["v"]) >= least, F.array_append(a["all"], F.struct(start.alias("start"), (start + x["w"]).alias("end"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), x["v"].alias("value")))).otherwise(a["all"]).alias("all"))

    found = F.aggregate(parts, empty, put, lambda a: a["all"])
    return F.when(text.rlike(quick), found).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,name:string,value:string>>"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, example_owners: int = 3) -> DataFrame:
    """One row per document: id, spans (array of start, end, kind, name, value_hash, owners, repos, copied, live), in code points, end exclusive.

    owners and repos say in how many distinct owners and repositories the value occurs; copied: in example_owners owners
    or more, as examples are; live: in one owner only, so the owner's own. Where repo_col is None a document is its own repository; a null owner is an owner. Within a kind matches are
    leftmost and do not overlap, also where a match is dropped for its length; spans are whole, however long. Null and empty
    texts have none, an empty table gives no rows. Repeated rows stay repeated, and are the same owner's. Other columns are
    not looked at, whatever their names. Only the values' SHA-256 leaves the scan. The frequencies are joined to the candidates in two parts: values
    with more than a thousandth of all candidates, of which there are at most a thousand, are broadcast; the rest shuffles.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col(owner_col).cast("string") if owner_col else F.lit("")
    repo = F.col(repo_col).cast("string") if repo_col else F.col(id_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), F.concat(*[_spans(text, k) for k in range(len(KINDS))]).alias("found"))
    d = d.withColumn("row", F.when(F.size("found") > 0, F.monotonically_increasing_id()))
    scanned = written(d.select("id", "row", "owner", "repo", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["name"].alias("name"), F.sha2(x["value"], 256).alias("value_hash"))).alias("found")), "candidates")
    each = scanned.where("row is not null").select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    by = each.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by = by.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    freq = written(by.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n")), "owners")
    total = freq.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * 1000 > F.lit(total)
    hot = freq.where(often).select("value_hash", F.col("owners").alias("o"), F.col("repos").alias("r"))
    cold = freq.where(~often).select("value_hash", "owners", "repos")
    marked = each.join(F.broadcast(hot), "value_hash", "left")
    columns = ["row", "start", "end", "kind", "name", "value_hash"]
    rest = marked.where("o is null").select(*columns).join(cold, "value_hash").select(*columns, "owners", "repos")
    known = marked.where("o is not null").select(*columns, F.col("o").alias("owners"), F.col("r").alias("repos")).unionByName(rest)
    per_doc = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "name", "value_hash", "owners", "repos", (F.col("owners") >= example_owners).alias("copied"), (F.col("owners") == 1).alias("live")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string,value_hash:string,owners:bigint,repos:bigint,copied:boolean,live:boolean>>")
    have = scanned.where("row is not null").select("id", "row").join(per_doc, "row")
    return have.select(F.col("id").alias(id_col), "spans").unionByName(scanned.where("row is null").select(F.col("id").alias(id_col), none.alias("spans")))


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
