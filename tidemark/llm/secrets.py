"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_copies, table, text_or_empty
from tidemark.llm.spans import count_of, matches, spans, written

BASE = ("assign", "access", "hex")
KEYWORDS = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?"""
PATTERNS = {
    "assign": KEYWORDS + r"[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "forge": r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
}
ASSIGN = "^" + KEYWORDS + r"([A-Za-z0-9+/_.=-]+)$"
#: A secret found with this many owners or more is a copied example.
SHARED_OWNERS = 3


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with found: array of (s, rank, kind, e, v, c) over each whole text, v being the secret itself.

    Null and empty texts have none. A column named found in the input is replaced.
    """
    text = text_or_empty(text_col)
    kinds = []
    for k, p in PATTERNS.items():
        found = matches(text, p)
        if k == "assign":
            found = F.filter(F.transform(found, lambda x: x.withField("v", F.regexp_extract(x["v"], ASSIGN, 1))), lambda x: F.length(x["v"]) >= 6)
        kinds.append((k, found))
    return df.drop("found").withColumn("found", spans(kinds))


def ownership(candidates: DataFrame) -> DataFrame:
    """(secret, n_rows, n_repos, n_owners) of candidates (secret, repo, owner).

    Copies of a secret in one repository are counted map-side first, so a secret in a third of all rows moves one row
    a task and repository. A null repository or owner counts as one of its own.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = candidates.select("secret", name("repo"), name("owner")).groupBy("secret", "repo", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("secret").agg(F.sum("n").alias("n_rows"), F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_shared, owners.

    n_owned counts spans whose secret has one owner in the corpus (live-looking), n_shared those with SHARED_OWNERS
    or more (copied examples), owners lists kind:start:end:owners. Repeated rows and ids give repeated results; every
    span string covers the whole text. Null text has no spans, a null id stays null, a null repository or owner counts as one
    of its own; other columns are left out, so their names cannot clash.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    rows = find(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), col(repo).alias("repo"), col(owner).alias("owner")), "text").drop("text")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "repo", "owner",
        *[count_of("found", k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
        F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["e"].alias("e"), F.sha2(x["v"].cast("binary"), 256).alias("secret"))).alias("found"),
    )
    rows = table(rows)
    each = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("x")).select("row", "repo", "owner", "x.*")
    owners = table(ownership(each).select("secret", "n_owners", F.col("n_rows").alias("copies")))
    marked = join_copies(each, owners, "secret").select("row", F.struct("s", "rank", "kind", "e", "n_owners").alias("x"))
    by_row = marked.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    out = rows.drop("repo", "owner", "found").join(by_row, "row", "left").drop("row")
    xs = F.coalesce("xs", F.array().cast("array<struct<s:int,rank:int,kind:string,e:int,n_owners:bigint>>"))
    return out.select(
        F.col("id").alias(id_col), *[f"n_{k}" for k in BASE], "base_sha256", "spans",
        F.size(F.filter(xs, lambda x: x["n_owners"] == 1)).cast("long").alias("n_owned"), F.size(F.filter(xs, lambda x: x["n_owners"] >= SHARED_OWNERS)).cast("long").alias("n_shared"),
        F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"), x["n_owners"].cast("string")))).alias("owners"),
    )
