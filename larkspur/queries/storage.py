"""Sinks, read back, and file sources, in the shared folder of the session."""

from __future__ import annotations

import uuid

from larkspur.queries.registry import query
from larkspur.runtime import shared_folder


def _folder(ctx) -> str:
    return f"{shared_folder(ctx.spark)}/sinks/{uuid.uuid4().hex}"


@query("w1_write_parquet", "SELECT * FROM customer WHERE c_nationkey < 5")
def _(ctx):
    path = _folder(ctx)
    ctx.sql("SELECT * FROM customer WHERE c_nationkey < 5").write_parquet(path, compression="zstd(3)")
    ctx.register_parquet("customers_written", path)
    return ctx.table("customers_written")


@query("w2_write_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(ctx):
    path = _folder(ctx)
    ctx.table("nation").write_csv(path)
    ctx.register_csv("nation_csv", path)
    return ctx.table("nation_csv")


@query("w3_write_json", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def _(ctx):
    path = _folder(ctx)
    ctx.table("region").write_json(path)
    ctx.register_json("region_json", path)
    return ctx.sql("SELECT r_regionkey, r_name FROM region_json")


@query("w12_copy_to", "SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 100")
def _(ctx):
    path = _folder(ctx)
    ctx.sql(f"COPY (SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 100) TO '{path}' STORED AS PARQUET")
    ctx.register_parquet("copied", path)
    return ctx.table("copied")


@query("s17_external_table", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation")
def _(ctx):
    path = _folder(ctx)
    ctx.table("nation").select_columns("n_nationkey", "n_name").write_csv(path)
    ctx.sql(f"CREATE EXTERNAL TABLE nation_external (n_nationkey INT, n_name STRING) STORED AS CSV WITH HEADER ROW LOCATION '{path}'")
    return ctx.table("nation_external")


@query("s2_csv_quoted_lines", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name || chr(10) || n_regionkey AS t FROM nation")
def _(ctx):
    path = _folder(ctx)
    ctx.sql("SELECT n_nationkey, n_name || chr(10) || n_regionkey AS t FROM nation").write_csv(path)
    ctx.register_csv("nation_lines", path)
    return ctx.table("nation_lines")


@query("s3_csv_compressed", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM nation")
def _(ctx):
    path = _folder(ctx)
    ctx.table("nation").select_columns("n_nationkey", "n_name").df.write.option("header", True).option("compression", "gzip").csv(path)
    ctx.register_csv("nation_packed", path, file_compression_type="gzip")
    return ctx.table("nation_packed")


@query("w5_collect_partitioned", "SELECT r_regionkey, r_name FROM region")
def _(ctx):
    batches = [b for p in ctx.table("region").repartition(3).collect_partitioned() for b in p]
    ctx.register_record_batches("region_partitions", [batches])
    return ctx.table("region_partitions")


@query("w9_streams", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _(ctx):
    frame = ctx.table("region").repartition(2)
    batches = [b.to_pyarrow() for b in frame.execute_stream()] + [b.to_pyarrow() for s in frame.execute_stream_partitioned() for b in s]
    ctx.register_record_batches("region_streams", [batches])
    return ctx.table("region_streams")
