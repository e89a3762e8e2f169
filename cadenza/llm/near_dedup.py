"""Near-duplicate documents by circulant MinHash.

A signature needs two permutations of the shingle universe and no more: sigma scatters the shingles once, and coordinate
k is the minimum of pi over the scattered values shifted circularly by k.  Signatures are cut into bands; documents that
share a band are candidates, and links are confirmed on the full shingle sets.

* Documents of equal shingle sets collapse first to one node (with a map-side minimum), so that a group of exact copies
  of any size is one node from then on.
* The sets of nodes that share a bucket are written once, by shard, to the shared folder and memory-mapped by the
  tasks that compare; candidates carry keys alone.
* A round of stars: every member of a bucket is compared with one pivot, the member that shares most buckets with others.
  Confirmed links form components by large-star/small-star rounds, so that a bucket of m near copies costs m
  comparisons first, not m squared.
* Then the members that are still outside their pivot's component are compared with the rest of their bucket, in blocks of
  bounded size whose intersections are counted by one matrix product; a block pair sends a spanning forest
  of the links it found.  Pairs inside a component are never compared: they are linked already.  Everything else
  that lies in a bucket is confirmed or refuted, with no cap on partners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .frames import binary, col, every_shard, joined, shard_count, spread, top_shard
from .graph import components, stored
from .shared import mapped, new_folder, write

_SIGMA = np.uint64(0xA0761D6478BD642F)


def permute(x: np.ndarray, out: np.ndarray, temp: np.ndarray) -> np.ndarray:
    """pi: a bijection of uint32."""
    np.multiply(x, np.uint32(0x9E3779B1), out=out)
    np.right_shift(out, 15, out=temp)
    np.bitwise_xor(out, temp, out=out)
    np.multiply(out, np.uint32(0x85EBCA77), out=out)
    np.right_shift(out, 13, out=temp)
    np.bitwise_xor(out, temp, out=out)
    np.multiply(out, np.uint32(0xC2B2AE3D), out=out)
    return out


def signatures(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of each run of shingle hashes (no run is empty): runs x size, uint32."""
    scattered = (K.mix(h ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)  # sigma
    out = np.empty((size, len(first)), np.uint32)
    a, b, c = (np.empty(len(h), np.uint32) for _ in range(3))
    for k in range(size):
        np.add(scattered, np.uint32(k), out=a)  # the circular shift, modulo 2**32
        out[k] = np.minimum.reduceat(permute(a, b, c), first)
    return out.T


def shingle_sets(at: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, with the index of each row's first (rows + 1)."""
    low = K.lower(data)
    s, e, first = K.spans(K.WORD[low], at)
    h = K.span_hash(low, s, e)
    g = K.grams(h, words)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    cut = np.append(0, np.cumsum(count))
    out, keep = np.empty(cut[-1], np.uint64), np.ones(cut[-1], bool)
    for i in range(len(n)):
        if n[i] >= words:
            part = out[cut[i] : cut[i + 1]]
            part[:] = g[first[i] : first[i] + count[i]]
            part.sort()
        elif n[i]:
            out[cut[i]] = K.grams(h[first[i] : first[i + 1]], int(n[i]))[0] ^ np.uint64(n[i])
    keep[1:] = out[1:] != out[:-1]
    keep[cut[:-1][count > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[cut]


def set_key(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set (of an empty one: 0)."""
    total = np.append(np.uint64(0), np.cumsum(K.mix(sets ^ np.uint64(0xD6E8FEB86659FD93))))
    n = np.diff(cut).astype(np.uint64)
    return np.where(n > 0, K.mix(total[cut[1:]] - total[cut[:-1]] + n), np.uint64(0)).view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, key_col: str | None = None) -> DataFrame:
    """(id, n, node, buckets, and key if named) of each document; node is null and buckets empty where there is no word."""

    def run(batches):
        for batch in batches:
            n, node, found = [], [], []
            for _, _, at, data in K.blocks(batch.column(1)):
                sets, cut = shingle_sets(at, data, words)
                size = np.diff(cut)
                some = np.flatnonzero(size)
                n.append(size)
                node.append(set_key(sets, cut))
                packed: list = [b""] * len(size)
                if len(some):
                    sig = signatures(sets, cut[some], bands * rows).astype(np.uint64).reshape(len(some), bands, rows)
                    key = np.zeros((len(some), bands), np.uint64)
                    for r in range(rows):
                        key = K.mix(key ^ sig[:, :, r] + np.uint64(r + 1))
                    key = K.mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    for i, x in zip(some.tolist(), key.view(np.int64)):
                        packed[i] = x
                found += packed
            n, node = np.concatenate(n), np.concatenate(node)
            flat = np.concatenate([x for x in found if len(x)]) if n.any() else np.zeros(0, np.int64)
            cut = np.append(0, np.cumsum(np.where(n > 0, bands, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=n == 0), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), *batch.columns[2:]], ["id", "n", "node", "buckets", "key"][: 2 + batch.num_columns])

    ids_ = docs.select(col(id_col).alias("id"), col(text_col).alias("t"), *([col(key_col).alias("key")] if key_col else []))
    return ids_.mapInArrow(run, f"id {ids_.schema['id'].dataType.simpleString()}, n long, node long, buckets array<long>" + ", key long" * bool(key_col))


class Sets:
    """The shingle sets of nodes, in memory-mapped shards."""

    def __init__(self, uri: str, shards: int):
        self.uri, self.shards = uri, shards

    def get(self, nodes: np.ndarray) -> list[np.ndarray]:
        key, out = nodes.view(np.uint64), [np.zeros(0, np.uint64)] * len(nodes)
        shard = top_shard(key, self.shards)
        for i in range(len(key)):
            x, _ = mapped(f"{self.uri}-{int(shard[i])}")
            k = int(np.searchsorted(x["node"], key[i]))
            out[i] = x["sets"][x["cut"][k] : x["cut"][k + 1]]
        return out


def key_files(keys: DataFrame, folder: str, name: str, shards: int) -> str:
    """Write the distinct longs of a one-column table as sorted arrays by shard."""
    uri = f"{folder}/{name}"

    def pack(batches):
        for batch in batches:
            h = np.sort(np.asarray(batch.column(0)).view(np.uint64))
            cut = np.searchsorted(top_shard(h, shards), np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), binary([h[cut[k] : cut[k + 1]] for k in full])], ["shard", "h"])

    def keep(table):
        h = np.sort(joined(table["h"], np.uint64))
        write(f"{uri}-{table['shard'][0].as_py()}", {"h": h})
        return pa.table({"shard": table["shard"][:1]})

    every_shard(keys.mapInArrow(pack, "shard int, h binary"), shards).groupBy("shard").applyInArrow(keep, "shard int").count()
    return uri


def among(uri: str, shards: int, keys: np.ndarray) -> np.ndarray:
    """Which keys the files of key_files hold."""
    h, out = keys.view(np.uint64), np.zeros(len(keys), bool)
    shard = top_shard(h, shards)
    for k in np.unique(shard).tolist():
        at = np.flatnonzero(shard == k)
        x = mapped(f"{uri}-{k}")[0]["h"]
        if len(x):
            out[at] = x[np.minimum(np.searchsorted(x, h[at]), len(x) - 1)] == h[at]
    return out


def write_sets(docs: DataFrame, need: DataFrame, text_col: str, words: int, folder: str) -> Sets:
    """Write the sets of the nodes in `need` (a table of keys): one more pass over the texts."""
    shards = shard_count(docs, text_col)
    uri, out = key_files(need, folder, "need", shards), f"{folder}/sets"

    def cut_out(batches):
        for batch in batches:
            for _, _, at, data in K.blocks(batch.column(0)):
                sets, cut = shingle_sets(at, data, words)
                key = set_key(sets, cut)
                at = np.flatnonzero((np.diff(cut) > 0) & among(uri, shards, key))
                at = at[np.unique(key[at], return_index=True)[1]]
                shard = top_shard(key[at].view(np.uint64), shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(key[at]), binary([sets[cut[i] : cut[i + 1]] for i in at])], ["shard", "node", "set"])

    def keep(table):
        key = np.asarray(table["node"].combine_chunks()).view(np.uint64)
        order = np.argsort(key)
        found = table["set"].combine_chunks()
        sets = [np.frombuffer(found[int(i)].as_buffer(), np.uint64) for i in order]
        write(f"{out}-{table['shard'][0].as_py()}", {"node": key[order], "cut": np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64), "sets": np.concatenate(sets)})
        return pa.table({"shard": table["shard"][:1]})

    rows = docs.select(col(text_col).alias("t")).mapInArrow(cut_out, "shard int, node long, set binary")
    one = rows.groupBy("shard", "node").agg(F.min("set").alias("set"))  # copies collapse on the map side
    one.groupBy("shard").applyInArrow(keep, "shard int").count()
    return Sets(out, shards)


def confirm(pairs: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have at least percent/100 of their union in common."""

    def same(batches):
        for batch in batches:
            good = []
            a, b = (np.asarray(batch.column(i)) for i in range(2))
            for x, y in zip(sets.get(a), sets.get(b), strict=True):
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                good.append(100 * common >= percent * (len(z) - common))
            yield batch.filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(same, "a long, b long")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b."""
    out = np.zeros((len(a), len(b)), np.float64)
    ha, hb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(ha, hb)
    ia, ib = np.searchsorted(both, ha), np.searchsorted(both, hb)
    ok = ia < len(both)
    ok[ok] = both[ia[ok]] == ha[ok]
    ra, ia = ra[ok], ia[ok]
    ok = ib < len(both)
    ok[ok] = both[ib[ok]] == hb[ok]
    rb, ib = rb[ok], ib[ok]
    for start in range(0, len(both), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        at = (ia >= start) & (ia < start + width)
        x[ra[at], ia[at] - start] = 1
        at = (ib >= start) & (ib < start + width)
        y[rb[at], ib[at] - start] = 1
        out += x @ y.T
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links (pairs of roots)."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def link_blocks(blocks: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (a, b) between roots, from rows of two blocks: nodes and their roots (na, ra, nb, rb)."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                na, ra, nb, rb = (np.array(batch.column(c)[i].as_py(), np.int64) for c in range(4))
                if len(np.unique(np.concatenate([ra, rb]))) < 2:
                    continue
                a, b = sets.get(na), sets.get(nb)
                size = np.add.outer([len(x) for x in a], [len(x) for x in b])
                common = common_counts(a, b)
                x, y = np.nonzero((100 * common >= percent * (size - common)) & (ra[:, None] != rb[None, :]))
                if len(x):
                    out += forest(np.unique(np.stack([np.minimum(ra[x], rb[y]), np.maximum(ra[x], rb[y])], 1), axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], ["a", "b"])

    return blocks.select("na", "ra", "nb", "rb").mapInArrow(run, "a long, b long")


def block_pairs(member: DataFrame, label: DataFrame, most: int = 256, shingles: int = 40_000) -> DataFrame:
    """Block pairs of the buckets whose members are in two components or more.

    A bucket's members inside its pivot's component, and those outside, are cut into blocks of about `most` members and
    `shingles` shingles; the outer blocks meet all blocks of the bucket.
    """
    other = label.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    placed = member.join(label, "node", "left").join(other, "pivot", "left").withColumn("root", F.coalesce("root", "node")).withColumn("inner", F.col("root") == F.coalesce("pivot_root", "pivot"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / shingles)).cast("int").alias("cuts")).where("r1 <> r2").select("bucket", "cuts")
    part = placed.join(split, "bucket").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    part = part.repartition("bucket", "inner", "cut")  # else the grouping would reuse the join's partitions, a whole bucket in one
    blocks = part.groupBy("bucket", "inner", "cut").agg(F.collect_list(F.struct("node", "root")).alias("m")).select("bucket", "inner", "cut", F.col("m.node").alias("n"), F.col("m.root").alias("r"))
    left = blocks.where(~F.col("inner")).select("bucket", F.col("cut").alias("c"), F.col("n").alias("na"), F.col("r").alias("ra"))
    return left.join(blocks.withColumnsRenamed({"n": "nb", "r": "rb"}), "bucket").where(F.col("inner") | (F.col("c") <= F.col("cut")))


def linked(docs: DataFrame, folder: str, id_col: str, text_col: str, words: int, percent: int, bands: int = 30, rows: int = 5, key_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signed documents; node, least id and root of every node)."""
    signed = stored(sign(docs, id_col, text_col, words, bands, rows, key_col), folder, "signed")
    nodes = stored(signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("buckets").alias("buckets")), folder, "nodes")
    member = nodes.select("node", "n", F.posexplode("buckets").alias("band", "bucket"))
    crowd = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = stored(member.join(crowd, "bucket"), folder, "crowded")
    central = member.groupBy("node").agg(F.sum("size").alias("central"))
    pivots = member.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node"))["node"].alias("pivot"))
    member = stored(member.join(pivots, "bucket"), folder, "member")
    sets = write_sets(docs, member.select("node").distinct(), text_col, words, folder)

    size = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("m"))
    star = member.where("node <> pivot").select("node", "pivot", "n").distinct().join(size, "pivot").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    links = stored(confirm(star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), sets, percent), folder, "star")
    label = components(links, folder, "cc-star")
    for k, some in enumerate((F.col("band") < 3, F.col("band") >= 3)):
        found = stored(link_blocks(block_pairs(member.where(some), label), sets, percent), folder, f"links-{k}")
        links = links.unionByName(found)
        label = components(links, folder, f"cc-{k}")
    return signed, nodes.select("node", "least").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept.

    Documents are linked if their sets of `words`-word shingles (A-Z lower-cased) have a Jaccard similarity of at least
    percent/100; component_id is the smallest id reachable, and kept is id = component_id.  At the default bands a pair
    at 0.8 is missed with a chance of 7e-6, and links of a group support each other.

    Texts of fewer words have one shingle, the whole sequence.  Null, empty or wordless texts have none and stand alone.
    Documents of null id join their component but are never kept, and if a component has no other, its component_id
    is null.  Rows that repeat an id get a row each.
    """
    signed, named = linked(docs, new_folder(docs.sparkSession, "near"), id_col, text_col, words, percent, bands, rows)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id")
    out = signed.select("id", "n", "node").join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: one of the smallest id.  Rows of null id go if another row is kept.

    Rows are told apart by a key that is written with them, so repeated rows go but for one, and a row goes for its own
    text, whatever others have its id.  Rows without words stay.
    """
    folder, key = new_folder(docs.sparkSession, "near"), "near_key"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), folder, "rows")
    signed, named = linked(keyed, folder, id_col, text_col, words, percent, key_col=key)
    rows = signed.where("node is not null").select("node", "key", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("row"))
    best = rows.groupBy("node").agg(F.min("row").alias("row")).join(named, "node").groupBy("root").agg(F.min("row").alias("row"))
    gone = rows.select("key").join(best.select(F.col("row.key").alias("key")), "key", "left_anti").withColumnRenamed("key", "gone_key")
    return keyed.join(gone, col(key) == F.col("gone_key"), "left_anti").drop(key)


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    return near_duplicates(docs, words=4)


_SET = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
def near_dedup_sql(table: str = "documents", words: int = 5) -> str:
    """The result of near_duplicates at 0.8 in DuckDB's SQL."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_SET}, []) AS w FROM {table}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), {words}) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM {table} UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM {table} d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


OP5_SQL = near_dedup_sql(words=4)
