"""Graph and partition files: binary graphs, label and id tables, GML, edge lists, sparse archives."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkweave.functions.scratch import scratch, stored
from sparkweave.graph import EDGES, MOST_NODES, Graph, GraphError
from sparkweave.operators import partition, transform

# The binary format. The header is 32 bytes, a record 8, or 16 with a weight; little-endian.
MAGIC, HEADER = b"CDGRPH1\0", struct.Struct("<8sQQB7x")


# The club that each member went to after the split (Zachary 1977), by the member's number.
KARATE = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0,
    0, 1, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1,
)


def uri_of(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri_of(uri))


def resolved(path: str, base: str) -> str:
    """A path of a configuration, whose relative ones are in the base folder."""
    return path if "://" in path or os.path.isabs(path) else posixpath.join(base, path)


def relative(path: str, base: str) -> str:
    """The path within the base folder, or as it is if it lies elsewhere."""
    inside = base.rstrip("/") + "/"
    return path[len(inside) :] if path.startswith(inside) else path


def exists(uri: str) -> bool:
    fs, path = store(uri)
    return fs.get_file_info(path).type == pyarrow.fs.FileType.File


def create_folder(uri: str) -> None:
    fs, path = store(uri)
    fs.create_dir(path, recursive=True)


def read_text(uri: str) -> str:
    fs, path = store(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read().decode("utf-8", "replace")


def write_text(uri: str, text: str) -> None:
    """The file gets its name when it is whole."""
    fs, path = store(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path + ".part", compression=None) as f:
        f.write(text.encode())
    fs.move(path + ".part", path)


def sha256(uri: str) -> str:
    fs, path = store(uri)
    digest = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as f:
        while block := f.read(8 << 20):
            digest.update(block)
    return digest.hexdigest()


def file_record(uri: str, base: str) -> dict:
    fs, path = store(uri)
    return {"path": relative(uri, base), "size_bytes": fs.get_file_info(path).size, "sha256": sha256(uri)}


# binary graphs


def header(uri: str) -> tuple[int, int, bool]:
    """Nodes, edges, and whether there are weights."""
    fs, path = store(uri)
    with fs.open_input_file(path) as f:
        start, size = f.read(HEADER.size), f.size()
    if len(start) < HEADER.size or start[:8] != MAGIC:
        raise GraphError("not a binary graph")
    _, n, m, weighted = HEADER.unpack(start)
    if weighted > 1 or n >= MOST_NODES or size < HEADER.size + m * (16 if weighted else 8):
        raise GraphError("the binary graph's header is wrong, or the file ends early")
    return n, m, bool(weighted)


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class BinaryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.records = options["path"], int(options.get("records", 1 << 22))
        self.n, self.m, self.weighted = header(self.uri)

    def partitions(self) -> list[InputPartition]:
        return [_Range(k, min(self.records, self.m - k)) for k in range(0, self.m, self.records)] or [_Range(0, 0)]

    def read(self, part: _Range):
        import numpy as np

        kind = np.dtype([("u", "<u4"), ("v", "<u4")] + [("w", "<f8")] * self.weighted)
        fs, path = store(self.uri)
        before = min(1, part.first)  # the record before shows that the order goes on
        with fs.open_input_file(path) as f:
            f.seek(HEADER.size + (part.first - before) * kind.itemsize)
            rows = np.frombuffer(f.read((part.count + before) * kind.itemsize), kind)
        u, v = rows["u"].astype(np.int64), rows["v"].astype(np.int64)
        w = rows["w"] if self.weighted else np.ones(len(rows))
        if ((u > v) | (v >= self.n)).any() or not (np.isfinite(w) & (w > 0)).all() or not ((u[1:] > u[:-1]) | (u[1:] == u[:-1]) & (v[1:] > v[:-1])).all():
            raise GraphError("a record of the binary graph is out of order or range")
        yield pa.RecordBatch.from_arrays([pa.array(x[before:]) for x in (u, v, np.ascontiguousarray(w))], ["u", "v", "weight"])


class BinaryGraphSource(DataSource):
    """``spark.read.format("binary_graph").load(path)``: edges, by ranges of records."""

    @classmethod
    def name(cls) -> str:
        return "binary_graph"

    def schema(self) -> str:
        return EDGES

    def reader(self, schema) -> BinaryReader:
        return BinaryReader(self.options)


def read_binary(spark: SparkSession, uri: str, records: int = 1 << 22) -> Graph:
    n, _, weighted = header(uri)
    spark.dataSource.register(BinaryGraphSource)
    return Graph(Graph.empty(spark, n).vertices, spark.read.format("binary_graph").option("records", records).load(uri), weighted)


def write_binary(graph: Graph, uri: str) -> int:
    """One file, whose nodes must be 0 .. n-1, in the order of its records; how many there are.

    Rows come to the driver one partition at a time and the file gets its name when it is whole.
    """
    n, m, weighted = graph.num_nodes(), graph.num_edges(), graph.is_weighted()
    last = graph.vertices.agg(F.max("node")).first()[0]
    if n >= MOST_NODES or (n and last != n - 1):
        raise GraphError("a binary graph needs the nodes 0 .. n-1")
    fs, path = store(uri)
    with fs.open_output_stream(path + ".part") as out:
        out.write(HEADER.pack(MAGIC, n, m, weighted))
        for r in graph.edges.orderBy("u", "v").toLocalIterator():
            out.write(struct.pack("<IId", r.u, r.v, r.weight) if weighted else struct.pack("<II", r.u, r.v))
    fs.move(path + ".part", path)
    return m


# labels and ids


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, begin, at): the lines, and two numbers that sort them as in the file."""
    text = F.trim(F.regexp_replace("value", "\\s+", " ")).alias("text")
    return spark.read.text(uri_of(path)).select(text, F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))


def read_labels(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(node, label) from ``label`` lines or ``node label`` lines; blank lines, comments and headers are passed over.

    A line with a label alone is for the next node after those of such lines before it.
    """
    words = _lines(spark, path).select(F.split("text", " ").alias("w"), "begin", "at").where("w[0] <> '' AND NOT startswith(w[0], '#') AND NOT w[0] IN ('node_id', 'node')")
    words = stored(words, "labels-lines")
    named = words.where("size(w) > 1").select(F.expr("try_cast(w[0] AS BIGINT)").alias("node"), F.expr("try_cast(w[1] AS INT)").alias("label"))
    bare = partition.dense_ids(words.where("size(w) = 1").select("begin", "at", F.expr("try_cast(w[0] AS INT)").alias("label")), ["begin", "at"]).select(F.col("id").alias("node"), "label")
    found = stored(named.unionByName(bare), "labels-read")
    told = found.agg(F.count(F.lit(1)), F.countDistinct("node"), F.count_if(F.expr(f"label IS NULL OR node IS NULL OR node < 0 OR node >= {n}"))).first()
    if told[2]:
        raise GraphError("a label or node is no number, or a node is out of range")
    if told[0] != told[1]:
        raise GraphError("a node comes twice")
    if told[0] != n:
        raise GraphError("the labels don't cover all nodes")
    return partition.normalize(found)


def read_partitions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(job_id, node, label) of many partition files with headers, by path and job."""
    return _of_jobs(spark, paths, "node_id long, label int", "\t").withColumnRenamed("node_id", "node")


def read_communities(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(job_id, community table) of many files, by path and job."""
    return _of_jobs(spark, paths, "community int, size long, internal_edges long, internal_weight double, boundary_weight double, volume double, density double, conductance double", ",")


def _of_jobs(spark: SparkSession, paths: dict[str, str], schema: str, sep: str) -> DataFrame:
    """Paths may serve several jobs."""
    uris = {j: uri_of(p) for j, p in paths.items()}
    rows = spark.read.schema(schema).csv(sorted(set(uris.values())), sep=sep, header=True, enforceSchema=False)
    rows = rows.select("*", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias("_path"))
    named = spark.createDataFrame([(j, re.sub("^file:/+", "file:///", u)) for j, u in uris.items()], "job_id string, _path string")
    return rows.join(F.broadcast(named), "_path").drop("_path").select("job_id", *(f.split()[0] for f in schema.split(", ")))


def write_table(rows: DataFrame, path: str, order: list[str], sep: str = "\t", null: str = "NA") -> None:
    """One file with a header, in this order, under its name when it is whole.

    Tasks write sorted parts to the shared folder; the driver only strings them together. Tabs and line ends in
    texts become spaces where the separator is a tab, else a text with marks is quoted.
    """
    spark = rows.sparkSession
    for c, kind in rows.dtypes:
        if kind == "string" and sep == "\t":
            rows = rows.withColumn(c, F.regexp_replace(F.col(c), "[\\t\\r\\n]", " "))
    parts = scratch(spark, "table")
    settings = {"quote": ""} if sep == "\t" else {"quote": '"', "escape": '"'}
    rows.orderBy(*order).write.csv(parts, sep=sep, nullValue=null, emptyValue="", **settings)
    fs, to = store(path)
    held, at = store(parts)
    fs.create_dir(posixpath.dirname(to), recursive=True)
    with fs.open_output_stream(to + ".part", compression=None) as out:
        out.write((sep.join(rows.columns) + "\n").encode())
        for f in sorted(held.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda f: f.path):
            if f.base_name.startswith("part-"):
                with held.open_input_stream(f.path, compression=None) as part:
                    while block := part.read(8 << 20):
                        out.write(block)
    fs.move(to + ".part", to)
    held.delete_dir(at)


def write_labels(labels: DataFrame, path: str) -> None:
    write_table(labels.select(F.col("node").alias("node_id"), "label"), path, ["node_id"])


def write_node_ids(ids: DataFrame, path: str) -> None:
    write_table(ids.select(F.col("node").alias("node_id"), "original_id"), path, ["node_id"])


def write_communities(table: DataFrame, path: str) -> None:
    """CSV of the community table; undefined values are blank."""
    write_table(table, path, ["community"], sep=",", null="")


# GML, edge lists, sparse archives: each gives (graph, ids, reference)


#: A key and its value: quoted, with escaped marks, or bare.
ATTRIBUTE = r'([A-Za-z_]\w*)\s+(?:"((?:\\.|[^"])*)"|([^\s\]]+))'


def read_gml(spark: SparkSession, path: str, reference_attributes: tuple[str, ...] = ("value", "club"), reference: str | None = None) -> tuple[Graph, DataFrame, DataFrame | None]:
    """Of a key that comes twice the last value counts. The reference is the first of the attributes that all nodes have, or the built-in one."""
    text = spark.read.text(uri_of(path), wholetext=True)
    parts = lambda kind: text.select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1))).alias("body"))
    pieces = F.arrays_zip(*(F.regexp_extract_all("body", F.lit(ATTRIBUTE), F.lit(i)).alias(n) for i, n in enumerate(("key", "quoted", "bare"), 1)))
    block = lambda kind: parts(kind).select(pieces.alias("pieces"))

    def value(key: str):
        last = F.try_element_at(F.filter("pieces", lambda x: x["key"] == key), F.lit(-1))
        return F.when(last["bare"] != "", last["bare"]).otherwise(last["quoted"])

    nodes = stored(block("node").select(value("id").alias("original_id"), *(value(a).alias(f"r_{a}") for a in reference_attributes)), "gml-nodes")
    edges = block("edge").select(value("source").alias("a"), value("target").alias("b"))
    if nodes.isEmpty() or edges.isEmpty():
        raise GraphError("the file has no nodes or no edges")
    if not nodes.where("original_id IS NULL").isEmpty() or not nodes.groupBy("original_id").count().where("count > 1").isEmpty():
        raise GraphError("a node has no id, or one comes twice")
    graph, ids = _of_texts(nodes.select("original_id"), edges)
    n = nodes.count()
    if reference == "builtin_karate":
        named = sorted(int(r.original_id) if r.original_id.isdigit() else -1 for r in ids.limit(len(KARATE) + 1).collect())
        if named not in (list(range(34)), list(range(1, 35))):
            raise GraphError("the built-in reference is for 34 nodes, from 0 or from 1 on")
        return graph, ids, spark.createDataFrame(list(enumerate(KARATE)), "node long, label int")
    for a in reference_attributes:
        if nodes.where(F.col(f"r_{a}").isNotNull()).count() == n:
            values = nodes.join(ids, "original_id").select("node", F.col(f"r_{a}").alias("value"))
            return graph, ids, transform.normalize_reference(values)
    return graph, ids, None


def read_edge_list(spark: SparkSession, path: str, comments: tuple[str, ...] = ("#", "%")) -> tuple[Graph, DataFrame, None]:
    """Two columns of text, plain or gzip; loops are left out before nodes are told."""
    lines = _lines(spark, path).select(F.col("text").alias("t")).where("t <> ''")
    for c in comments:
        lines = lines.where(~F.startswith("t", F.lit(c)))
    pairs = lines.select(F.split("t", " ").alias("w"), "t")
    bad = pairs.where("size(w) < 2").first()
    if bad:
        raise GraphError(f"a line has no two columns: {bad.t[:80]!r}")
    edges = pairs.select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).where("a <> b")
    return *_of_texts(edges.select(F.explode(F.array("a", "b")).alias("original_id")).distinct(), edges), None


def _of_texts(names: DataFrame, edges: DataFrame) -> tuple[Graph, DataFrame]:
    ids = transform.numbered(names, "original_id")
    a = ids.select(F.col("original_id").alias("a"), F.col("node").alias("u"))
    b = ids.select(F.col("original_id").alias("b"), F.col("node").alias("v"))
    joined = edges.join(a, "a", "left").join(b, "b", "left").select("u", "v")
    if not joined.where("u IS NULL OR v IS NULL").isEmpty():
        raise GraphError("an edge has an end that isn't a node")
    return transform.sanitize(ids, joined), ids


#: Entries of a sparse matrix that a task reads.
ENTRIES = 1 << 22


def _member(archive: zipfile.ZipFile, name: str):
    """An array of the archive, open at its values, with its type and length."""
    f = archive.open(f"{name}.npy")
    version = np.lib.format.read_magic(f)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject:
        raise GraphError("the archive has objects")
    return f, kind, int(np.prod(shape))


def _array(archive: zipfile.ZipFile, name: str, begin: int = 0, end: int | None = None) -> np.ndarray:
    f, kind, size = _member(archive, name)
    with f:
        f.seek(begin * kind.itemsize, 1)
        count = (size if end is None else min(end, size)) - begin
        return np.frombuffer(f.read(count * kind.itemsize), kind)


def read_sparse_archive(spark: SparkSession, root: str, matrix: str = "adj_full.npz", classes: str = "class_map.json") -> tuple[Graph, DataFrame, DataFrame | None]:
    """A sparse matrix as data, indices, indptr and shape, and classes by node if the file is there.

    ``root`` is a folder, or the matrix itself. Tasks read ranges of entries; each holds indptr, a number a node.
    """
    whole = root if root.endswith(".npz") else f"{root}/{matrix}"
    folder = posixpath.dirname(whole)
    fs, path = store(whole)
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
        if not {"data.npy", "indices.npy", "indptr.npy", "shape.npy"} <= set(archive.namelist()):
            raise GraphError("the archive is no sparse matrix")
        shape, count = _array(archive, "shape"), _member(archive, "indices")[2]
    if shape[0] != shape[1]:
        raise GraphError("the matrix isn't square")
    n = int(shape[0])

    def entries(batches):
        fs, path = store(whole)
        for batch in batches:
            for begin in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                    indptr = _array(archive, "indptr")
                    v, weight = (_array(archive, x, begin, begin + ENTRIES) for x in ("indices", "data"))
                u = np.searchsorted(indptr, np.arange(begin, begin + len(v)), side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(weight.astype(float))], ["u", "v", "weight"])

    frame = spark.range(0, count, ENTRIES, max(1, -(-count // ENTRIES))).mapInArrow(entries, EDGES)
    graph = transform.sanitize(Graph.empty(spark, n).vertices, frame)
    ids = graph.vertices.select("node", F.col("node").cast("string").alias("original_id"))
    if not exists(f"{folder}/{classes}"):
        return graph, ids, None
    told = spark.read.text(uri_of(f"{folder}/{classes}"), wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("node", "value"))
    marks = F.from_json("value", "array<double>")
    hits = F.filter(F.transform(marks, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    told = stored(told.select(F.col("node").try_cast("long").alias("node"), F.coalesce(F.col("value").try_cast("long"), F.when(F.size(hits) == 1, hits[0].cast("long"))).alias("value")), "classes")
    if not told.where("value IS NULL OR value < 0").isEmpty():
        raise GraphError("a node has not just one class")
    if not told.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("node").alias("nodes"), F.min("node").alias("low"), F.max("node").alias("high")).where(F.expr(f"rows <> {n} OR nodes <> {n} OR low <> 0 OR high <> {n - 1}")).isEmpty():
        raise GraphError("the classes don't cover all nodes")
    return graph, ids, transform.normalize_reference(told)


def load(spark: SparkSession, spec: dict, base: str = "") -> tuple[Graph, DataFrame, DataFrame | None, str, list[str]]:
    """The graph, ids and reference that a dataset's entry names, the format's name, and the files read."""
    kind, at = spec["format"], resolved(spec.get("root", spec.get("path", "")), base)
    if kind == "gml":
        return *read_gml(spark, at, tuple(spec.get("reference_attributes", ("value", "club"))), spec.get("reference")), "gml", [at]
    if kind == "edge_list":
        return *read_edge_list(spark, at, tuple(spec.get("comment_prefixes", ("#", "%")))), "edge_list", [at]
    if kind in ("graphsaint", "reddit2"):
        matrix = at if at.endswith(".npz") else f"{at}/adj_full.npz"
        classes = spec.get("class_map", "class_map.json")
        told = f"{posixpath.dirname(matrix)}/{classes}"
        return *read_sparse_archive(spark, at, classes=classes), "graphsaint_reddit2", [matrix, *([told] if exists(told) else [])]
    raise GraphError(f"no such format: {kind}")


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise GraphError(f"{name!r} isn't a safe name")
    return name
