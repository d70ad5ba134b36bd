"""Queries over scans, header fields, keys and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corelog.functions import text as T
from corelog.operators.common import kept
from corelog.plans.shared import shared_dir
from corelog.registry import query, table
from corelog.sources import tables as S
from corelog.sources import xml as X


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.05")
def projected_scan(s, d):
    """A scan of the needed columns with pushed filters."""
    return S.read(s, f"{d}/lineitem.parquet").where("l_shipdate >= TIMESTAMP_NTZ'1995-01-01 00:00:00' AND l_discount > 0.05").select("l_orderkey", "l_quantity")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
list_aggregate(string_split(replace(url, chr(92), '/'), '/'), 'last') AS base FROM pages""")
def header_fields(s, d):
    """First matches of header tags, and the base name as a key."""
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), T.base_name(F.col("url")).alias("base"))


_NATION = """s AS (SELECT s_nationkey AS k, s_suppkey, s_name, CAST(floor(s_acctbal) AS BIGINT) AS bal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)"""


def _files(s, d):
    """One XML file for each nation, of its suppliers as layers and measurements, read back as binary files."""
    rows = table(s, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", F.floor("s_acctbal").alias("bal")))).alias("a"))
    layer = F.transform("a", lambda x, i: F.format_string("<layer><from>%d</from><to>%d</to><text> %s\n&amp; co </text></layer>", i * 10, i * 10 + 10, x["s_name"]))
    probe = F.transform("a", lambda x, i: F.format_string("<probe><at>%d</at><a>0</a><b>0</b><c>%d</c><d>1</d></probe>", i * 10 + 5, x["bal"] % 100))
    xml = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE hole SYSTEM "x.dtd"><hole><!-- <layer> --><empty/>'), F.array_join(layer, ""), F.array_join(probe, ""), F.lit("</hole>"))
    path = f"{shared_dir(s)}/xml-{uuid.uuid4().hex}"
    rows.select("s_nationkey", xml.alias("x")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return s.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)


def _key():
    return F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("bigint").alias("k")


@query(f"WITH {_NATION} SELECT k, CAST(i AS INT) AS place, i * 10e0 AS top, i * 10e0 + 10 AS bottom, s_name || ' & co' AS text FROM s")
def xml_layers(s, d):
    """Files scanned as binary, parsed by a real parser (comments, entities, DOCTYPE) into layer rows."""
    return X.layers(_files(s, d), "layer", "text", "from", "to").select(_key(), "place", "top", "bottom", "text")


@query(f"WITH {_NATION} SELECT k, CAST(count(*) AS INT) AS n_layers, string_agg(s_name || ' & co', ' || ' ORDER BY s_suppkey) AS text FROM s GROUP BY k")
def xml_records(s, d):
    """One record a file, layers joined by ' || '."""
    return X.records(_files(s, d), "layer", "text").select(_key(), "n_layers", "text")


@query(f"WITH {_NATION} SELECT k, i * 10e0 + 5 AS depth, bal % 100 + 1e0 AS n, s_name || ' & co' AS text FROM s WHERE bal % 100 + 1 > 0 AND bal % 100 + 1 <= 100 AND (bal % 100 <> 0 OR 1 = 1)")
def xml_measurements(s, d):
    """Counts from the first family of tags that isn't all zero, with the text of the layer that holds the depth."""
    f = kept(_files(s, d).select("path", "content"), "files")
    return X.measurements(f, "probe", "at", [["a", "b"], ["c", "d"]], X.layers(f, "layer", "text", "from", "to")).select(_key(), "depth", "n", "text")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders")
def csv_union(s, d):
    """Gzip CSV files of two layouts written, then read by globs under one schema; what a layout lacks is NULL."""
    root = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    w = {"header": True, "compression": "gzip"}
    o.where("o_orderkey % 2 = 0").write.options(**w).csv(f"{root}/even")
    o.where("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey", "o_orderstatus").write.options(**w).csv(f"{root}/odd")
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return S.union_files(s, [f"csv:{root}/even/*.csv.gz", f"csv:{root}/odd/*.csv.gz", f"csv:{root}/none/*.csv.gz"], schema, tolerant=True)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(s, d):
    """JSON lines written and read under a declared schema."""
    path = f"{shared_dir(s)}/json-{uuid.uuid4().hex}"
    c = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    S.write(c, path, "json")
    return S.read(s, f"json:{path}", c.schema)


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def partitioned_round_trip(s, d):
    """Partitioned zstd Parquet, overwritten as a whole, then one partition read (the others are pruned)."""
    path = f"{shared_dir(s)}/parts-{uuid.uuid4().hex}"
    li = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    S.write(li.where("l_quantity < 3"), path, by=["l_returnflag"])
    S.write(li, path, by=["l_returnflag"])
    return S.read(s, f"parquet:{path}").where("l_returnflag = 'R'").select("l_orderkey", "l_quantity", "l_returnflag")


@query("""SELECT c_custkey, c_acctbal AS balance, coalesce(n, 0) AS orders, n_name AS nation FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def covariate_registry(s, d):
    """Named covariates of one key sampled side by side."""
    nation = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("value"))
    count = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    r = S.Registry([
        ("balance", "continuous", lambda p: p.select("c_custkey", F.col("c_acctbal").alias("value"))),
        ("orders", "continuous", lambda p: p.select("c_custkey").join(count, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("value"))),
        ("nation", "categorical", lambda p: p.join(nation, "c_nationkey", "left").select("c_custkey", "value")),
    ])
    c = table(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return r.sample(c, "c_custkey").select("c_custkey", *r.names())


@query("SELECT 'part ' || page_id AS path, CASE page_id % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'missing' ELSE 'unlisted' END AS why FROM pages")
def manifest_check(s, d):
    """What stands on disk against what a manifest lists: digests, sizes, names."""
    p = table(s, d, "pages").select(F.concat(F.lit("part "), "page_id").alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"), "page_id").withColumn("length", F.octet_length("content").cast("bigint"))
    listed = S.manifest(p.where("page_id % 3 <> 2")).unionByName(S.manifest(p.limit(0)))
    now = p.where("page_id % 3 <> 1").withColumn("content", F.when(F.col("page_id") % 3 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")))
    return S.manifest_differences(now.select("path", "content", F.octet_length("content").cast("bigint").alias("length")), listed)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def combined_shards(s, d):
    """Shards written apart are combined; a table that isn't a shard is passed over, a key in two shards is refused."""
    root = f"{shared_dir(s)}/shards-{uuid.uuid4().hex}"
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    for i in range(3):
        o.where(f"o_orderkey % 3 = {i}").write.parquet(f"{root}/{i}")
    shards = [s.read.parquet(f"{root}/{i}") for i in range(3)] + [table(s, d, "nation")]
    return S.combine_shards(shards, ["o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, coalesce(strlen(text), 0) AS size FROM documents""")
def content_manifest(s, d):
    """Digest and size in bytes of every text."""
    return table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))


@query("SELECT sha256(string_agg(coalesce(text, ''), chr(0) ORDER BY doc_id))[:16] AS key FROM (SELECT DISTINCT doc_id, text FROM documents)")
def content_cache_key(s, d):
    """One key for a whole table of texts, the digest of all of them joined by NUL."""
    return S.content_key(table(s, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


@query("SELECT r_regionkey, r_name FROM region")
def first_source(s, d):
    """Of several candidate paths the first that exists is read."""
    path = S.first_existing(s, [f"{d}/no such table.parquet", f"{d}/region.parquet", f"{d}/nation.parquet"])
    return s.read.parquet(path).select("r_regionkey", "r_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, printf('%.7f', l_extendedprice / 7) AS price, printf('%.3f', l_discount) AS discount FROM lineitem""")
def fixed_decimals(s, d):
    """Columns as text of fixed decimals, as a CSV sink writes them."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.format_string("%.7f", F.col("l_extendedprice") / 7).alias("price"), F.format_string("%.3f", "l_discount").alias("discount"))
