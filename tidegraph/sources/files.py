"""File sources: lines with their physical numbers, hashes, configurations, saved results, arrays and static graphs.

Defined results: a path without files gives an empty table; blank lines keep their number and are dropped only by feed();
a compressed file is one block; missing required columns, non-square graphs and configurations that are no mapping raise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes read at once while a file is hashed.
CHUNK = 1 << 20
#: Fixed value: nodes of the static shop graph without labels, at its start.
UNLABELLED_PREFIX = 3305


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every physical line of text or .gz files, numbered from 0 within its file.

    Files are read in blocks by many tasks. A line's number is its place in its block plus the lines of the file's blocks
    before it; only one count for each block is shuffled.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.text(path).select("value", meta("file_path").alias("path"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def feed(spark: SparkSession, path: str, fmt: Column | str | None = None) -> DataFrame:
    """(source_file, source_row, format, raw, source_file_hash) of the non-blank lines; the format follows the file's name unless given."""
    x = lines(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    guess = F.when(F.regexp_like("path", F.lit(r"(?i)\.csv(\.gz)?$")), "csv").otherwise("jsonl")
    hashes = file_hashes(spark, [r.path for r in x.select("path").distinct().collect()])  # one row a file
    kept = x.filter(F.trim(F.col("value")) != "")
    return kept.join(F.broadcast(hashes), "path").select(name.alias("source_file"), F.col("line").alias("source_row"), (F.lit(fmt) if isinstance(fmt, str) else guess if fmt is None else fmt).alias("format"), F.col("value").alias("raw"), F.col("sha256").alias("source_file_hash"))


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of whole files, one task a file, CHUNK bytes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                uri = "file://" + p.removeprefix("file:") if p.startswith("file:/") and "://" not in p else p
                system, at = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), p)
                digest = hashlib.sha256()
                with system.open_input_stream(at, compression=None) as f:
                    while part := f.read(CHUNK):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "sha256"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "path string, sha256 string")


# -- configurations and saved results --------------------------------------------------------------------------------


def deep_merge(base: dict, over: dict) -> dict:
    """A new mapping in which `over` wins; mappings inside are merged, all else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(*paths: str) -> dict:
    """YAML (or JSON) files merged from left to right; each must hold a mapping."""
    out: dict = {}
    for p in paths:
        text = Path(p).read_text()
        if p.endswith(".json"):
            got = json.loads(text)
        else:
            import yaml  # only where a YAML file is read

            got = yaml.safe_load(text)
        if not isinstance(got, dict):
            raise ValueError(f"{p} holds no mapping")
        out = deep_merge(out, got)
    return out


def resolve_paths(config: dict, root: str, keys: tuple[str, ...] = ("paths",)) -> dict:
    """The configuration with the relative entries of the given sections made absolute against root."""
    fixed = {k: {n: str(Path(root, v)) if isinstance(v, str) else v for n, v in config[k].items()} for k in keys if isinstance(config.get(k), dict)}
    return config | fixed


def inspect_config(config: dict, keys: tuple[str, ...] = ("paths",)) -> list[tuple[str, str, bool]]:
    """(name, path, exists) of each configured path."""
    return [(f"{k}.{n}", v, Path(v).exists()) for k in keys for n, v in sorted((config.get(k) or {}).items()) if isinstance(v, str)]


def summaries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The summary.json of each run folder as rows, with the run's folder name."""
    found = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/summary.json")
    return found.withColumn("run_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/summary\.json$", 1))


def evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evidence cards written by sinks.upsert_cards()."""
    return spark.read.schema(schema).json(path)


def array_rows(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(row, values) of a .npy array, or of one array of a .npz file, of one or two dimensions.

    The file is opened by the tasks, each for its rows, without being read whole where it is a plain .npy file.
    """
    import numpy as np

    shape = (np.load(path, mmap_mode="r") if path.endswith(".npy") else np.load(path)[name]).shape
    tasks = max(1, min(1000, shape[0] // 50_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(path, mmap_mode="r") if path.endswith(".npy") else np.load(path)[name]
        for batch in batches:
            at = batch.column(0).to_numpy()
            got = np.asarray(data[at], dtype=np.float64).reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(got), pa.list_(pa.float64()))], names=["row", "values"])

    return spark.range(0, shape[0], 1, tasks).mapInArrow(run, "row bigint, values array<double>")


# -- static graphs ---------------------------------------------------------------------------------------------------


def check_static_graph(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...]) -> None:
    """Raise unless the nodes are 0..N-1 with one feature length and 0/1 labels, and each relation is there with ends among them."""
    need = {"node_idx", "features", "label"} - set(nodes.columns) | {"src", "dst", "relation"} - set(edges.columns)
    if need:
        raise ValueError(f"missing columns: {sorted(need)}")
    n = nodes.agg(F.count("*").alias("n"), F.count_distinct("node_idx").alias("d"), F.min("node_idx").alias("lo"), F.max("node_idx").alias("hi"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad")).first()
    if not n.n or n.n != n.d or n.lo != 0 or n.hi != n.n - 1 or n.a != n.b or n.bad:
        raise ValueError(f"nodes aren't 0..N-1 with equal features and 0/1 labels: {n.asDict()}")
    e = {r.relation: r for r in edges.groupBy("relation").agg(F.min(F.least("src", "dst")).alias("lo"), F.max(F.greatest("src", "dst")).alias("hi"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("nulls")).collect()}  # one row a relation
    for r in relations:
        if r not in e or e[r].nulls or e[r].lo < 0 or e[r].hi >= n.n:
            raise ValueError(f"relation {r} is missing or not square")


def static_graph(spark: SparkSession, nodes_path: str, edges_path: str, relations: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph extracted to Parquet: directed edges kept by relation, all nodes labelled."""
    nodes, edges = spark.read.parquet(nodes_path), spark.read.parquet(edges_path).filter(F.col("relation").isin(*relations))
    check_static_graph(nodes, edges, relations)
    return nodes, edges.select("relation", "src", "dst")


def mask_unlabelled_prefix(nodes: DataFrame, prefix: int = UNLABELLED_PREFIX) -> DataFrame:
    """Nodes with `labelled`; raises if a node of the unlabelled prefix has a positive label."""
    if nodes.filter((F.col("node_idx") < prefix) & (F.col("label") == 1)).limit(1).count():
        raise ValueError("the unlabelled prefix holds a positive label")
    return nodes.withColumn("labelled", F.col("node_idx") >= prefix)


def load_weights(path: str) -> dict[str, Any]:
    """Weights saved by sinks.save_weights(): arrays by name; the layer sizes follow from their shapes."""
    import numpy as np

    got = json.loads(Path(path).read_text())
    out = {k: np.array(v, dtype=np.float64) for k, v in got.items()}
    if not any(k.startswith("w") for k in out):
        raise ValueError(f"{path} holds no expert")
    return out


def layer_sizes(weights: dict[str, Any]) -> list[int]:
    """Input, hidden and output sizes of a stack of layers w0, w1, ..."""
    ws = [weights[k] for k in sorted((k for k in weights if k[0] == "w" and k[1:].isdigit()), key=lambda k: int(k[1:]))]
    return [ws[0].shape[0], *(w.shape[1] for w in ws)]
