"""Secret scans with corpus-wide ownership frequency, in Spark's functions only.

Base kinds are found by pattern. Further candidates are opaque tokens (letters and digits
mixed, at least ``OPAQUE`` characters). The hash of every candidate value is counted over
all documents by distinct repositories and owners: a value that more than ``max_owners``
owners or ``max_repos`` repositories hold is a widely copied example, any other looks live.
Base spans stay whatever their count; opaque tokens become spans only if they look live.

Everywhere, null texts are empty, null owners (and null repositories of one owner) count as
one, rows of equal id (null or not) and text are treated alike, an empty table gives an empty
one, and columns other than those named are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .spans import found, joined, rewritten

#: Kind, pattern, group of the secret, its least length. ``found`` gives all matches; short ones are dropped afterwards, so they still use up their text.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OPAQUE = 20
_OPAQUE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{OPAQUE},}}"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | Column = "source", repo_col: str | Column | None = None) -> DataFrame:
    """id, version (hash of the text), owner, repo, base and opaque spans of each document; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col(owner_col) if isinstance(owner_col, str) else owner_col
    repo = owner if repo_col is None else F.col(repo_col) if isinstance(repo_col, str) else repo_col
    long_enough = lambda spans, least: F.filter(spans, lambda s: F.length(s.value) >= least)
    base = F.concat(*(long_enough(found(F.col("t"), p, kind, rank, group), least) for rank, (kind, p, group, least) in enumerate(BASE)))
    opaque = F.filter(found(F.col("t"), _OPAQUE, "opaque", len(BASE)), lambda s: s.value.rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9]") & s.value.rlike("[A-Za-z]"))
    rows = docs.select(F.col(id_col).alias("id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), text.alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("version"), "owner", "repo", F.array_sort(base).alias("base"), opaque.alias("opaque"))
    free = F.filter("opaque", lambda o: ~F.exists(F.col("base"), lambda b: (b.start < o.end) & (o.start < b.end)))
    return rows.withColumn("opaque", F.when(F.size("opaque") > 0, free).otherwise(F.col("opaque")))


def ownership(found_rows: DataFrame) -> DataFrame:
    """Per candidate hash: distinct owners and repositories over the whole corpus. A repository is told by its owner and name."""
    one = found_rows.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode(F.concat("base", "opaque")).alias("s")).select(F.sha2("s.value", 256).alias("hash"), "owner", "repo")
    repos = one.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return repos.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | Column = "source", repo_col: str | Column | None = None, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """Per document: id, version, base spans, spans (base and live opaque ones, by start then kind) and live (of these, those that look live)."""
    rows = scratch.cut(scan(docs, id_col, text_col, owner_col, repo_col), "scan")
    # As a struct the key of a document may hold a null id.
    any_found = rows.filter(F.size("base") + F.size("opaque") > 0).withColumn("doc", F.struct("id", "version"))
    held = any_found.select("doc", F.explode(F.concat("base", "opaque")).alias("s")).select("doc", F.sha2("s.value", 256).alias("hash")).distinct()
    # A table of its own: only then can the join split a value that many documents hold.
    few = scratch.cut(ownership(any_found).filter((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("hash"), "owned")
    live = held.join(few, "hash").groupBy("doc").agg(F.collect_set("hash").alias("hashes"))
    with_live = any_found.join(live, "doc", "left").withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>")))
    is_live = lambda s: F.array_contains(F.col("hashes"), F.sha2(s.value, 256))
    spans = F.array_sort(F.concat("base", F.filter("opaque", is_live)))
    done = with_live.withColumn("spans", spans).select("id", "version", "base", "spans", F.filter("spans", is_live).alias("live"))
    return rows.filter(F.size("base") + F.size("opaque") == 0).select("id", "version", "base", F.col("base").alias("spans"), F.col("base").alias("live")).union(done)


def summary(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what classified() gives."""
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("id").alias(id_col), *(count(kind) for kind, *_ in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"), (F.size("spans") - F.size("live")).cast("long").alias("n_example"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | Column | None = None, max_owners: int = 2, max_repos: int = 4, mark: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking secret's span replaced by mark; all else as it was."""
    live = classified(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repos).filter(F.size("live") > 0)
    # Overlapping spans become one.
    start = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        one = F.struct(s.start.alias("start"), s.end.alias("end"))
        wider = F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))
        return F.when(s.start < last.end, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), wider)).otherwise(F.array_append(acc, one))

    marks = live.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.transform(F.aggregate("live", start, merge), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(mark).alias("new"))).alias("_marks")).dropDuplicates(["_id", "_version"])
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    both = keyed.join(marks, (keyed[id_col].eqNullSafe(marks["_id"])) & (keyed["_key"] == marks["_version"]), "left")
    text = F.when(F.col("_marks").isNotNull(), rewritten(F.col(text_col), F.col("_marks"))).otherwise(F.col(text_col))
    return both.withColumn(text_col, text).select(docs.columns)
