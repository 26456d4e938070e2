"""Sources, sinks, pushdown and user-defined functions."""

from __future__ import annotations

import gzip
import lzma
import sys

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pytest

from pyspark import cloudpickle

from larkspur import AbstractTableProvider, Accumulator, SessionContext, WindowEvaluator, WindowFrame, col, udaf, udf, udwf
from larkspur.sources.object_stores import hadoop_options, hadoop_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
IRIS = "sepal_length,sepal_width,petal_length,petal_width,species\n5.1,3.5,1.4,.2,Setosa\n4.9,3,1.4,.2,Setosa\n6.3,3.3,6,2.5,Virginica"


def test_csv(ctx, tmp_path):
    (tmp_path / "iris.csv").write_text(IRIS)
    ctx.register_csv("iris", str(tmp_path / "iris.csv"))
    assert ctx.sql("SELECT sepal_length FROM iris LIMIT 10").count() == 3
    assert [str(t) for t in ctx.table("iris").schema().types] == ["double"] * 4 + ["string"]
    for name, pack in (("a.csv.gz", gzip.compress), ("b.csv.xz", lzma.compress)):
        (tmp_path / name).write_bytes(pack(IRIS.encode()))
    ctx.register_csv("packed", str(tmp_path / "a.csv.gz"), file_compression_type="gzip")
    ctx.register_csv("packed_xz", str(tmp_path / "b.csv.xz"), file_compression_type="xz")
    assert ctx.table("packed").count() == ctx.table("packed_xz").count() == 3
    for bad in ({"delimiter": "||"}, {"file_compression_type": "rar"}):
        with pytest.raises(ValueError):
            ctx.register_csv("x", str(tmp_path / "iris.csv"), **bad)


def test_csv_errors_instead_of_nulls(ctx, tmp_path):
    """Values beyond the lines that types come from, quoted line ends, and ragged lines."""
    (tmp_path / "late.csv").write_text("a,b\n" + "1,x\n" * 1500 + "oops,y\n")
    ctx.register_csv("late", str(tmp_path / "late.csv"))
    with pytest.raises(Exception, match="MALFORMED|oops|Malformed"):
        ctx.table("late").to_pylist()
    ctx.register_csv("late_text", str(tmp_path / "late.csv"), schema=pa.schema([("a", pa.string()), ("b", pa.string())]))
    assert ctx.table("late_text").to_pylist()[-1] == {"a": "oops", "b": "y"} and ctx.table("late_text").count() == 1501
    (tmp_path / "quoted.csv").write_text('a,b\n1,"two\nlines, quoted"\n2,plain\n')
    ctx.register_csv("quoted", str(tmp_path / "quoted.csv"))
    assert ctx.table("quoted").to_pylist() == [{"a": 1, "b": "two\nlines, quoted"}, {"a": 2, "b": "plain"}]
    (tmp_path / "later.csv").write_text("a,b\n" + "1,x\n" * 1200 + '2,"p\nq"\n')
    ctx.register_csv("later", str(tmp_path / "later.csv"), newlines_in_values=True)
    assert ctx.table("later").to_pylist()[-1] == {"a": 2, "b": "p\nq"}
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    ctx.register_csv("ragged", str(tmp_path / "ragged.csv"), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        ctx.table("ragged").to_pylist()


def test_xz_lines(ctx, tmp_path):
    """Only line ends end a line; streams one after the other, and folders, by any path."""
    lines = ["a,b", "1,x\u2028y", "2,p\x0bq", "3,\x1c"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.csv.xz").write_bytes(lzma.compress("\r\n".join(lines[:2]).encode() + b"\r\n") + lzma.compress("\n".join(lines[2:]).encode()))
    (tmp_path / "d" / "other.txt").write_text("no")
    ctx.register_csv("xz", f"file://{tmp_path}/d", file_compression_type="xz")
    assert ctx.table("xz").to_pylist() == [{"a": 1, "b": "x\u2028y"}, {"a": 2, "b": "p\x0bq"}, {"a": 3, "b": "\x1c"}]


def test_extensions_by_any_path(ctx, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x\n1\n")
    (tmp_path / "d" / "b.tsv").write_text("x\n2\n")
    for folder in (f"{tmp_path}/d", f"file://{tmp_path}/d"):
        ctx.register_csv("by_extension", folder, file_extension=".tsv")
        assert ctx.table("by_extension").to_pylist() == [{"x": 2}]
    ctx.sql("SELECT id FROM range(3)").write_parquet(f"{tmp_path}/p")
    ctx.register_parquet("unpruned", f"file://{tmp_path}/p", parquet_pruning=False)
    assert ctx.sql("SELECT id FROM unpruned WHERE id = 1").count() == 1
    with pytest.raises(Exception):
        ctx.register_parquet("none", f"file://{tmp_path}/p", file_extension=".none")


def test_http(ctx, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "iris.csv").write_text(IRIS)
    ctx.sql("SELECT id FROM range(3)").df.coalesce(1).write.parquet(f"{tmp_path}/p")
    name = next(f.name for f in (tmp_path / "p").iterdir() if f.name.endswith(".parquet"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        ctx.register_csv("web", f"{base}/iris.csv?v=1")
        ctx.register_parquet("web_parquet", f"{base}/p/{name}")
        assert ctx.table("web").count() == 3 and ctx.table("web_parquet").count() == 3
        with pytest.raises(ValueError):
            ctx.register_json("x", f"{base}/x.json", storage_options={"aws.region": "r"})
    finally:
        server.shutdown()


def test_credentials_stay_with_their_reader(ctx):
    from larkspur.sources.files import _located

    target, options = _located(ctx.spark, "s3://b/k", {"aws.access_key_id": "i", "aws.secret_access_key": "s"})
    assert target == "s3a://b/k" and options["fs.s3a.access.key"] == "i" and options["fs.s3a.impl.disable.cache"] == "true"
    assert ctx.spark._jsc.hadoopConfiguration().get("fs.s3a.access.key") is None


def test_streams_by_partition(ctx):
    """Each partition runs once, empty ones have a place, nested values keep their types."""
    frame = ctx.sql("SELECT id, struct(id AS x, array(CAST(id AS STRING)) AS y) AS s FROM range(6)").repartition(3)
    frame = type(frame)(frame.df.where("id < 2").repartition(4, "id"))
    whole = frame.collect_partitioned()
    assert len(whole) == 4 and sum(b.num_rows for p in whole for b in p) == 2 and any(not p for p in whole)
    streams = frame.execute_stream_partitioned()
    rows = [r for s in streams for b in s for r in b.to_pyarrow().to_pylist()]
    assert len(streams) == 4 and sorted(r["s"]["y"][0] for r in rows) == ["0", "1"]
    assert sorted(r["id"] for b in frame.execute_stream(batch_rows=1) for r in b.to_pyarrow().to_pylist()) == [0, 1]


def test_parquet_partitions(ctx, tmp_path):
    ctx.sql("SELECT id, CAST(id % 2 AS STRING) AS p FROM range(4)").df.write.partitionBy("p").parquet(str(tmp_path / "d"))
    ctx.register_parquet("d", str(tmp_path / "d"), table_partition_cols=[("p", "string")], schema=pa.schema([("id", pa.int64())]))
    assert ctx.sql("SELECT id FROM d WHERE p = '1'").count() == 2 and ctx.table("d").schema().field("p").type == pa.string()
    with pytest.raises(ValueError):
        ctx.register_parquet("d", str(tmp_path / "d"), table_partition_cols=[("p", "int")])


def test_sinks(ctx, tmp_path):
    df = ctx.sql("SELECT id, 'x' AS s FROM range(3)")
    for codec in ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw", "zstd(5)"):
        path = str(tmp_path / codec.strip(")").replace("(", "_"))
        df.write_parquet(path, compression=codec)
        ctx.register_parquet("again", path)
        assert ctx.table("again").count() == 3
    df.write_json(str(tmp_path / "j"))
    ctx.register_json("j", str(tmp_path / "j"))
    assert ctx.table("j").count() == 3
    ctx.sql(f"COPY (SELECT id FROM range(5)) TO '{tmp_path}/c' STORED AS CSV")
    ctx.sql(f"CREATE EXTERNAL TABLE ext STORED AS CSV WITH HEADER ROW LOCATION '{tmp_path}/c'")
    assert ctx.sql("SELECT sum(id) AS s FROM ext").to_pylist() == [{"s": 10}]


def test_arrow_types(ctx):
    table = pa.table({"u8": pa.array([1, None], pa.uint8()), "u64": pa.array([2**64 - 1, 0], pa.uint64()), "d64": pa.array([0, None], pa.date64()), "d": pa.array(["a", "b"]).dictionary_encode(), "n": pa.array([1, 2], pa.timestamp("ns"))})
    ctx.register_record_batches("t", [table.to_batches()])
    assert [f.dataType.simpleString() for f in ctx.spark.table("t").schema] == ["smallint", "decimal(20,0)", "date", "string", "timestamp_ntz"]
    assert int(ctx.table("t").to_pylist()[0]["u64"]) == 2**64 - 1
    with pytest.raises(ValueError):
        ctx.register_record_batches("empty", [])


def test_reader_is_read_again(ctx):
    reader = pa.table({"a": [3, 1, 2]}).to_reader()
    ctx.register_record_batch_reader("r", reader, [col("a").sort(), col("absent").sort()])
    assert sorted(ctx.table("r").to_pydict()["a"]) == [1, 2, 3] and ctx.table("r").count() == 3
    with pytest.raises(ValueError):
        ctx.register_record_batch_reader("r", pa.table({"a": [1]}).to_reader(), [3])


def test_dataset(ctx, tmp_path):
    pads.write_dataset(pa.table({"k": [1, 2, 3], "p": ["a", "b", "b"]}), tmp_path / "ds", format="feather", partitioning=["p"], partitioning_flavor="hive")
    ctx.register_dataset("ds", pads.dataset(tmp_path / "ds", format="feather", partitioning="hive"))
    assert ctx.sql("SELECT sum(k) AS s FROM ds WHERE p = 'b' AND k > 2").to_pylist() == [{"s": 3}]
    with pytest.raises(ValueError):
        ctx.register_dataset("x", "not a dataset")


class Counting(AbstractTableProvider):
    """Adds a column with the number of filters that reached it."""

    def schema(self):
        return pa.schema([("a", pa.int64()), ("filters", pa.int64())])

    def scan(self, filters=None):
        t = pa.table({"a": pa.array([1, 2, 3, None])})
        for f in filters or ():
            t = t.filter(f)
        return t.append_column("filters", pa.array([len(filters or ())] * t.num_rows, pa.int64()))


@pytest.mark.parametrize(("where", "want"), [("a IN (1, 3)", [1, 3]), ("a NOT IN (1, 3)", [2]), ("a BETWEEN 2 AND 3", [2, 3]), ("a IS NULL", [None]), ("NOT a = 2", [1, 3]), ("a % 2 = 1", [1, 3]), ("a > 1 AND a < 3", [2])])
def test_provider_pushdown(ctx, where, want):
    ctx.register_table_provider("p", Counting())
    rows = ctx.sql(f"SELECT * FROM p WHERE {where}").to_pylist()
    assert [r["a"] for r in rows] == want and all(r["filters"] > 0 for r in rows)


def test_provider_error_is_raised(ctx):
    class Failing(Counting):
        def scan(self, filters=None):
            yield pa.record_batch({"a": [1], "filters": [0]})
            raise RuntimeError("broken source")

    ctx.register_table_provider("broken", Failing())
    with pytest.raises(Exception, match="broken source"):
        ctx.table("broken").count()


def test_object_store_options():
    assert hadoop_path("s3://b/k") == "s3a://b/k" and hadoop_path("/x") == "/x"
    out = hadoop_options("s3://b/k", {"aws.access_key_id": "a", "aws.secret_access_key": "b", "aws.region": "r"})
    assert out["fs.s3a.access.key"] == "a" and "Simple" in out["fs.s3a.aws.credentials.provider"]
    assert "Chain" in hadoop_options("s3://b/k", {})["fs.s3a.aws.credentials.provider"]
    with pytest.raises(ValueError):
        hadoop_options("s3://b/k", {"aws.endpoint": "http://x"})
    assert hadoop_options("s3://b/k", {"aws.endpoint": "http://x", "aws.allow_http": "true"})["fs.s3a.connection.ssl.enabled"] == "false"
    with pytest.raises(ValueError):
        hadoop_options("gs://b", {"nonsense": "1"})
    assert hadoop_options("gs://b", {"gcp.service_account_path": "/k"})["fs.gs.auth.service.account.json.keyfile"] == "/k"


class Mean(Accumulator):
    def __init__(self):
        self.s, self.n = 0.0, 0

    def state(self):
        return [pa.scalar({"s": self.s, "n": self.n})]

    def update(self, values):
        self.s += pc.sum(values).as_py() or 0.0
        self.n += pc.count(values).as_py()

    def merge(self, states):
        for v in states.to_pylist():
            self.s, self.n = self.s + v["s"], self.n + v["n"]

    def evaluate(self):
        return pa.scalar(self.s / self.n if self.n else None, pa.float64())


def test_functions_of_users(ctx: SessionContext):
    ctx.register_record_batches("t", [[pa.record_batch({"g": ["a", "a", "b"], "x": [1.0, 3.0, None]})]])
    ctx.register_udf(udf(lambda x, y: pc.add(x, y), [pa.float64(), pa.float64()], pa.float64(), "immutable", "plus"))
    assert ctx.sql("SELECT plus(x, 1D) AS y FROM t").to_pydict() == {"y": [2.0, 4.0, None]}
    mean = udaf(Mean, pa.float64(), pa.float64(), [pa.struct([("s", pa.float64()), ("n", pa.int64())])], "stable", "my_mean")
    ctx.register_udaf(mean)
    want = [{"g": "a", "m": 2.0}, {"g": "b", "m": None}]
    assert ctx.sql("SELECT g, my_mean(x) AS m FROM t GROUP BY g ORDER BY g").to_pylist() == want
    assert [r.asDict() for r in mean.aggregate(ctx.spark.table("t"), ["g"], ["x"], "m").orderBy("g").collect()] == want

    class Bounded(WindowEvaluator):
        def supports_bounded_execution(self):
            return True

        def get_range(self, idx, num_rows):
            return max(0, idx - 1), idx + 1

        def evaluate(self, values, eval_range):
            return pc.sum(values[0].slice(eval_range[0], eval_range[1] - eval_range[0]))

    fn = udwf(Bounded(), pa.float64(), pa.float64(), "immutable", "pair_sum")
    out = fn(col("x")).over([], [col("x").sort(True, False)], WindowFrame("rows", 1, 0)).apply(ctx.spark.table("t"), "s")
    assert [r.s for r in out.collect()] == [1.0, 4.0, 3.0]
    for bad in (lambda: udf(3, [], pa.int64(), "stable"), lambda: udwf(object(), pa.int64(), pa.int64(), "stable"), lambda: udaf(int, pa.int64(), pa.int64(), [], "stable")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        udf(lambda x: x, [pa.int64()], pa.int64(), "sometimes", "f")


def test_window_frames_by_definition(ctx):
    """RANGE, ROWS and GROUPS frames, rising and falling, with nulls and ties, against Spark's own windows."""
    from larkspur.expr import SortExpr
    from larkspur.queries.functions_of_users import framed

    rows = [(i % 3, [None, 5, 1, 1, 9, 4, 5, None, 2][i % 9], i) for i in range(40)]
    df = ctx.spark.createDataFrame(rows, "p int, o long, v long")
    df.createOrReplaceTempView("frames")
    for asc in (True, False):
        for first in (True, False):
            way = f"{'ASC' if asc else 'DESC'} NULLS {'FIRST' if first else 'LAST'}"
            for units, lo, hi in (("range", 2, 1), ("range", None, 0), ("range", 0, None), ("groups", 1, 1)):
                end = lambda n, side: "UNBOUNDED " + side if n is None else "CURRENT ROW" if n == 0 else f"{n} {side}"
                frame = f"{units} BETWEEN {end(lo, 'PRECEDING')} AND {end(hi, 'FOLLOWING')}"
                got = framed().append(df, framed()(col("v")).over([col("p")], [SortExpr(col("o"), asc, first)], WindowFrame(units, lo, hi)), "s")
                want = ctx.sql(f"SELECT v, sum(v) OVER (PARTITION BY p ORDER BY o {way} {frame}) AS s FROM frames")
                assert {r.v: r.s for r in got.collect()} == {r["v"]: r["s"] for r in want.to_pylist()}, (way, frame)


def test_aggregate_in_two_phases(ctx):
    from larkspur.queries.functions_of_users import total

    df = ctx.spark.createDataFrame([(None if i % 7 == 0 else i % 5, f"k{i % 2}", i) for i in range(1000)], "a int, b string, v long")
    got = {(r.a, r.b): r.t for r in total().aggregate(df, ["a", "b"], ["v"], "t").collect()}
    assert got == {(r.a, r.b): r.t for r in df.groupBy("a", "b").agg({"v": "sum"}).toDF("a", "b", "t").collect()}
    assert [r.t for r in total().aggregate(df, [], ["v"], "t").collect()] == [499500]
