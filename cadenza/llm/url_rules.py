"""URL filters by a sort-merge range join.

A host becomes a key of its labels in reverse, each with a dot (blog.example.org: ``org.example.blog.``), so that a rule's
host is a prefix and covers one interval of keys.  URLs and rules go to the buckets of a range partitioning, a rule to each
bucket that its interval meets; each bucket is sorted and swept once, with a stack of the rules whose intervals are
open.  The bounds come from a sample of the URLs' keys of a fixed size and break ties by path and a hash, so a host with
a third of all rows is spread over many buckets.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import col, range_bounds, range_count

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def match_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """urls with host, path, rule and verdict.

    rules: (host, path, verdict).  A rule fits its host and all subdomains if the path starts with the rule's; the longest
    host + path wins, then the longer host; of rules with equal host and path, block wins.  `default` is the verdict
    where none fits.  A null URL, or one without ://, has an empty host and path, which no rule fits.  Rules with a null
    part or an empty host are left out.  Repeated rows stay; columns of the new names are replaced.
    """
    spark = urls.sparkSession
    n = buckets or range_count(urls, F.lit(100) + F.coalesce(F.octet_length(col(url_col)), F.lit(0)))
    new = {"host", "path", "rule", "verdict"}
    kept = [f for f in urls.schema.fields if f.name.lower() not in new]
    rows = urls.select(host_of(col(url_col)).alias("_host"), path_of(col(url_col)).alias("_path"), F.struct(*[col(f.name) for f in kept]).alias("_row"))
    rows = rows.withColumn("_sort", F.concat(key_of(F.col("_host")), F.col("_path"), F.lit(" "), F.hex(F.xxhash64("_row"))))
    bounds = range_bounds(rows.select("_sort"), n)

    def place(batches):
        for batch in batches:
            at = [bisect.bisect_right(bounds, s) for s in batch.column(batch.schema.get_field_index("_sort")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "_bucket"])

    def open_in(batches):
        for batch in batches:
            out = []
            for host, path, verdict, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = bisect.bisect_right(bounds, key), bisect.bisect_right(bounds, key + "\U0010ffff")
                out += [(k, key, host, path, verdict) for k in range(a, b + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32() if i == 0 else pa.string()) for i in range(5)], ["_bucket", "_sort", "_rhost", "_rpath", "_rverdict"])

    placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())]))
    clean = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).where("host <> '' and path is not null and verdict is not null")
    opened = clean.withColumn("key", key_of(F.col("host"))).mapInArrow(open_in, "_bucket int, _sort string, _rhost string, _rpath string, _rverdict string")
    both = placed.withColumn("_kind", F.lit(1)).unionByName(opened.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = both.select("_bucket", "_sort", "_kind", "_rhost", "_rpath", "_rverdict", "_host", "_path", "_row").repartition(n, "_bucket").sortWithinPartitions("_bucket", "_sort", "_kind")

    def sweep(batches):
        stack, bucket = [], None  # (key, host, {path: verdict}, lengths of paths, longest first)
        for batch in batches:
            b, s, kind, rh, rp, rv, hosts, paths = (batch.column(i).to_pylist() for i in range(8))
            rule, verdict, rows_ = [], [], []
            for i in range(batch.num_rows):
                if b[i] != bucket:
                    stack, bucket = [], b[i]
                while stack and not s[i].startswith(stack[-1][0]):
                    stack.pop()
                if kind[i] == 0:
                    if not stack or stack[-1][0] != s[i]:
                        stack.append((s[i], rh[i], {}, []))
                    by = stack[-1][2]
                    if by.get(rp[i]) != "block":
                        by[rp[i]] = rv[i]
                    stack[-1][3][:] = sorted({len(p) for p in by}, reverse=True)
                    continue
                best = None
                for _, host, by, sizes in reversed(stack):
                    for size in sizes:
                        p = paths[i][:size]
                        if len(p) == size and p in by:
                            if best is None or len(host) + size > best[0]:
                                best = (len(host) + size, host + p, by[p])
                            break
                rows_.append(i)
                rule.append(best[1] if best else None)
                verdict.append(best[2] if best else default)
            took = batch.take(pa.array(rows_, pa.int64()))
            row = took.column(8)
            yield pa.RecordBatch.from_arrays([*[row.field(k) for k in range(len(kept))], took.column(6), took.column(7), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*[f.name for f in kept], "host", "path", "rule", "verdict"])

    out = T.StructType([*kept, *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return both.mapInArrow(sweep, out)


#: The rules of the query: fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return match_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP7_SQL = f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {_RULES}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
