"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every version of a document is a blob, addressed by the SHA-256 of its text. The ledger has one row for each blob and
rule version scanned, with the spans found. A scan takes only the pairs that the ledger lacks, each distinct blob once
however many paths share it, appends what it finds, and joins findings back to all paths. The ledger is a Parquet table of
its own, which later scans are given; op10 starts one for each run, as its tables are given without any history.

Defined cases: a null text is an empty blob; rows with equal texts share a scan and each gets its findings; repeated rows
stay repeated; an empty table gives an empty result; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, scratch_path

#: Kind, version, pattern, least length, and the group whose length counts. A pattern matches leftmost and without
#: overlaps, and matches that are too short are dropped only then, so that what they cover stays taken.
RULES = (
    ("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", 1, r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", 1, r"[0-9a-f]+", 24, 0),
)
#: The same matches as of the patterns above with their least lengths, found faster: a run that is too short cannot hold a long one.
_LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, kind: str, pattern: str, least: int, group: int) -> Column:
    """Start and end code points of the matches, from what stands between them; matches and gaps alternate."""
    found = _LONG.get(kind, pattern)
    lit = F.lit(found)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    gaps = F.split(text, found, -1)
    sized = F.transform(F.regexp_extract_all(text, lit, F.lit(group)), F.length) if found == pattern else F.transform(whole, F.length)
    rows = F.transform(F.sequence(F.lit(0), F.size(whole) - 1), lambda i: F.struct(F.length(gaps[i]).alias("gap"), F.length(whole[i]).alias("len"), sized[i].alias("sized")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"]
        out = F.when(x["sized"] >= least, F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.when(text.rlike(found), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPANS))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rule"), F.lit(0).alias("version"), F.array().cast(_SPANS).alias("spans"))


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """Ledger rows for the (blob, rule, version) triples of blobs (blob, text; distinct) that the ledger lacks."""
    if ledger is None:
        todo = blobs.withColumn("_todo", F.array(*[F.lit(k) for k, *_ in rules]))
    else:
        known = ledger.where(F.concat_ws(":", "rule", "version").isin([f"{k}:{v}" for k, v, *_ in rules])).groupBy("blob").agg(F.collect_set("rule").alias("_known"))
        todo = blobs.join(known, "blob", "left").withColumn("_todo", F.array_except(F.array(*[F.lit(k) for k, *_ in rules]), F.coalesce("_known", F.array().cast("array<string>"))))
        todo = todo.where(F.size("_todo") > 0)
    found = F.array(*[F.when(F.array_contains("_todo", k), F.struct(F.lit(k).alias("rule"), F.lit(v).cast("int").alias("version"), spans(F.col("text"), k, p, n, g).alias("spans"))) for k, v, p, n, g in rules])
    return todo.select("blob", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.version", "x.spans")


def with_blob(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, paths with findings): the rows to append to the ledger, and doc_id, blob and findings of every path.

    Findings are (start, place of the kind, kind, end) in order."""
    kept = with_blob(docs)
    blobs = kept.groupBy("blob").agg(F.first("text").alias("text"))
    fresh = materialize(scan_unseen(blobs, ledger, rules), "findings")
    return fresh, join_back(kept, fresh, ledger, rules)


def join_back(kept: DataFrame, fresh: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """doc_id, blob and findings (items) of every path, from the rows of fresh and of the ledger."""
    valid = (fresh if ledger is None else fresh.union(ledger.select(fresh.columns))).where(F.concat_ws(":", "rule", "version").isin([f"{k}:{v}" for k, v, *_ in rules]))
    place = F.array_position(F.array(*[F.lit(k) for k, *_ in rules]), F.col("rule")).cast("int")
    items = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), F.col("rule").alias("rule"), s["end"].alias("end")))
    hits = valid.where(F.size("spans") > 0).withColumn("place", place).select("blob", items.alias("items")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return kept.select("doc_id", "blob").join(hits, "blob", "left")


def scan_into(docs: DataFrame, path: str, rules=RULES) -> DataFrame:
    """As scan(), with the ledger in the table at path, to which new rows are appended; doc_id, blob and items of every path.

    Appending is one commit, so that a scan that fails leaves the ledger as it was."""
    spark = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = empty_ledger(spark).schema
    known = spark.read.schema(old).parquet(path) if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place) else None
    kept = with_blob(docs)
    scan_unseen(kept.groupBy("blob").agg(F.first("text").alias("text")), known, rules).write.mode("append").parquet(path)
    return join_back(kept, spark.read.schema(old).parquet(path), None, rules)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = scan_into(read_table(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger"))
    items = F.coalesce("items", F.array().cast("array<struct<start:int,place:int,rule:string,end:int>>"))
    of = lambda kind: F.size(F.filter(items, lambda x: x["rule"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return paths.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def _sql_kind(kind: str, place: int, pattern: str, least: int, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
k{place} AS (SELECT doc_id, rid, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS s, regexp_split_to_array(text, '{p}') AS g FROM d),
e{place} AS (SELECT rid, i, len(m[i]) AS mlen, len(s[i]) AS slen, len(g[i]) AS glen FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k{place})),
f{place} AS (SELECT rid, slen, CAST(sum(glen + mlen) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS til, mlen FROM e{place}),
h{place} AS (SELECT rid, {place} AS place, '{kind}' AS kind, til - mlen AS start, til AS til FROM f{place} WHERE slen >= {least})"""


SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),"
    + ",".join(_sql_kind(k, i, p, n, g) for i, (k, _, p, n, g) in enumerate(RULES))
    + ", h AS ("
    + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(len(RULES)))
    + """), a AS (SELECT rid, CAST(count(*) FILTER (WHERE place = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE place = 1) AS BIGINT) AS n_access,
  CAST(count(*) FILTER (WHERE place = 2) AS BIGINT) AS n_hex, string_agg(concat(kind, ':', start, ':', til), ',' ORDER BY start, place) AS spans FROM h GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""
)
