"""Readers: wide CSV, zipped CSV, analysis documents, trace graphs, correlation reports, and discovery of files."""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import finite, time_column, time_seconds, with_sortie_tags
from ..operators.events import first_wins
from ..operators.store import stored
from .cells import LONG, csv_members, long_batches


#: Files up to this size are read whole for their first line.
SMALL_FILE = 8 << 20


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, header): the first line of each file, in one job.

    Small files are gone through by Spark's reader. For large ones a session of its own deals each file's splits to tasks of
    their own, and a task stops after its first line, so what is read does not grow with them. Files without a line
    are left out.
    """
    lazy = spark.newSession()
    lazy.conf.set("spark.sql.files.openCostInBytes", lazy.conf.get("spark.sql.files.maxPartitionBytes"))
    lazy.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    meta = lambda x: F.col(f"_metadata.{x}")

    def line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b["start"][0].as_py() == 0:
                yield b.select(["path", "header"])
            return

    large = lazy.read.text(path).where(meta("file_size") > SMALL_FILE).select(meta("file_path").alias("path"), F.col("value").alias("header"), meta("file_block_start").alias("start"))
    small = spark.read.text(path).where((meta("file_size") <= SMALL_FILE) & (meta("file_block_start") == 0)).select(meta("file_path").alias("path"), F.col("value").alias("header"), F.monotonically_increasing_id().alias("at"))
    found = [small.groupBy("path").agg(F.min_by("header", "at").alias("header"))]
    # The large files' session is another one, so their few headers come over by the driver.
    if rows := large.mapInArrow(line, "path string, header string").collect():
        found.append(spark.createDataFrame(rows, "path string, header string"))
    return reduce(DataFrame.unionByName, found)


def _columns(header: str) -> list[str]:
    return next(csv.reader([header]), [])


def read_telemetry_csv(spark: SparkSession, path: str | list[str], time_col: str | None = None, time_rule: str = "strict") -> DataFrame:
    """Wide CSV as text, with source, path, ord and the time t in seconds (SRC-1).

    path is a file, a folder, a pattern, or a list of such. Files with one header are read together, and the groups are
    united by name, so the order of columns does not matter and a column that a file lacks is null. ord ascends with the
    rows of a file, across its blocks. One job reads the headers, and the driver gets each different one with its files; a
    file without a time column raises ValueError.
    """
    groups = csv_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.col("paths")[0]).collect()
    if not groups:
        raise ValueError(f"no file at {path}")
    # A block's rows are no more than its bytes, so twice its start leaves room for the number of a row in its task.
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    found = []
    for g in groups:
        header = _columns(g["header"])
        names = spark.createDataFrame([], ", ".join(f"`{c.replace('`', '``')}` string" for c in header)).schema if len(set(header)) == len(header) else None
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        raw = (reader.schema(names) if names else reader).csv(g["paths"])
        t = time_col or time_column(raw.columns, time_rule)
        found.append(raw.select("*", F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path"), (2 * F.col("_metadata.file_block_start") + in_task).alias("ord"), time_seconds(F.col(f"`{t}`")).alias("t")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def header_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, signal, col_ord): which file has which column, from headers alone."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, c.strip(), i) for p, h in zip(b["path"].to_pylist(), b["header"].to_pylist(), strict=True) for i, c in enumerate(_columns(h))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["path", "signal", "col_ord"])

    return csv_headers(spark, path).mapInArrow(split, "path string, signal string, col_ord int")


def csv_to_long(raw: DataFrame, keep: list[str] | None = None, ids: tuple[str, ...] = ()) -> DataFrame:
    """(source, path, ord, col_ord, signal, t, v) of the finite cells; keep: only these headers are read.

    ids: columns of raw that go along with each cell of their row, in front, as they are, and are no signals.
    """
    extra = {"source", "path", "ord", "t", *ids}
    columns = [c for c in raw.columns if c not in extra and (keep is None or c in keep)]
    cells = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("signal"), finite(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(columns)])
    return raw.where("t is not null").select(*ids, "source", "path", "ord", "t", F.explode(cells).alias("x")).select(*ids, "source", "path", "ord", "x.col_ord", "x.signal", "t", "x.v").where("v is not null")


class _Member(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


class _ZipReader(DataSourceReader):
    """One partition for each CSV member; rows stream out in long form, in Arrow batches."""

    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.every = options.get("members", "first") == "all"
        self.columns = json.loads(options["columns"]) if options.get("columns") else None

    def partitions(self):
        return [_Member(p, n) for p in self.paths for n in csv_members(p, self.every)]

    def read(self, part):
        with zipfile.ZipFile(part.path) as z, z.open(part.member) as f:
            yield from long_batches(f, os.path.basename(part.path), part.member, self.columns)


class TelemetryZip(DataSource):
    """spark.read.format("telemetry_zip") with the options members (first or all) and columns (a JSON list), paths joined by commas (SRC-2)."""

    @classmethod
    def name(cls):
        return "telemetry_zip"

    def schema(self):
        return LONG

    def reader(self, schema):
        return _ZipReader(self.options)


def read_telemetry_archives(spark: SparkSession, paths: str | list[str], members: str = "first", columns: list[str] | None = None, mounted: bool = False) -> DataFrame:
    """The finite cells of zipped CSV members in long form (SRC-2): the first member of each archive, or all.

    columns: only headers whose whole name or suffix is in it are parsed. Archives come through Spark's file system, one a
    task, whole, so up to the 2 GB that Spark's reader of binary files takes; with mounted they are opened by their
    path on every machine, streamed, one member a task, whatever their size.
    """
    if mounted:
        spark.dataSource.register(TelemetryZip)
        reader = spark.read.format("telemetry_zip").option("members", members)
        return (reader if columns is None else reader.option("columns", json.dumps(columns))).load(",".join([paths] if isinstance(paths, str) else paths))
    # A batch of one row: a task holds one archive at a time.
    lone = spark.read.format("binaryFile").load(paths).select("path", "content")
    return archives_to_long(lone, members, columns)


def archives_to_long(archives: DataFrame, members: str = "first", columns: list[str] | None = None) -> DataFrame:
    """read_telemetry_archives on a table (path, content). Null or broken archives and members without a time column raise."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                held = io.BytesIO(content.as_buffer())
                for name in csv_members(held, members == "all"):
                    with zipfile.ZipFile(held) as z, z.open(name) as f:
                        yield from long_batches(f, path.as_py().rsplit("/", 1)[-1], name, columns)

    return archives.select("path", "content").mapInArrow(read, LONG)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(sortie, path, kind, mtime, size) of documents and archives below a folder, in the natural order of sorties (SRC-3)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"^analysis_.*_hires\.json$"), "hires").when(name.rlike(r"^analysis_.*\.json$"), "analysis").when(name.rlike(r"(?i)\.zip$"), "archive")
    tags = with_sortie_tags(files.withColumn("source", F.col("path")))
    # A document bears the label of its sortie, an archive the tag that makes it.
    named = F.upper(F.nullif(F.regexp_extract(name, r"(?i)^analysis_([SG]\d{2,5}(?:_\d+)?)", 1), F.lit("")))
    files, sortie = tags, F.coalesce(named, F.col("sortie"))
    found = files.select(sortie.alias("sortie"), "path", kind.alias("kind"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where("kind is not null")
    return found.orderBy(F.substring("sortie", 1, 1), F.regexp_extract("sortie", r"([0-9]+)", 1).try_cast("int"), F.regexp_extract("sortie", r"_([0-9]+)$", 1).try_cast("int"), F.desc("size"), "path")


def latest_documents(files: DataFrame) -> DataFrame:
    return files.where("kind = 'analysis'").groupBy("sortie").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


_TR = "array<struct<signal:string,time:string,`from`:double,`to`:double,row_idx:bigint>>"
BOOLS = "array<struct<name:string,active_count:bigint,total_count:bigint,active_pct:double>>"
_PLOTS = "map<string,array<array<double>>>"
#: All that a document may hold; fields that one lacks are null.
DOCUMENT = (
    "filename string, total_rows bigint, time_col string, duration_s double, rec_start_s double, tail_number string, trace_graph string, processing_time_s double, trigger_fallback boolean, "
    f"trigger struct<signal:string,`from`:double,`to`:double>, data_gaps array<struct<t_start:double,t_end:double,duration_s:double>>, transitions {_TR}, mode_transitions {_TR}, sysNotEngage {_TR}, "
    "torque_stats array<struct<signal:string,peak:double,peak_time:double,modes:map<string,double>>>, "
    f"episodes array<struct<episode:int,start_time:string,end_time:string,duration_s:double,transitions:{_TR},plots:{_PLOTS}>>, flight_plots {_PLOTS}, takeoff_plots {_PLOTS}, "
    f"bool_channels {BOOLS}, enum_channels array<struct<name:string,values:array<bigint>>>, num_channels array<struct<name:string,min:double,max:double,mean:double>>, "
    "sample_rows array<struct<row_idx:bigint,part:string,cells:map<string,double>>>, context_rows array<struct<row_idx:bigint,cells:map<string,double>>>"
)
HIRES = f"flight_plots {_PLOTS}, takeoff_plots {_PLOTS}"
ANALYSIS = f"{DOCUMENT}, _corrupt_record string"


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(sortie, document) of documents that were written packed, many to a file."""
    head = F.substring_index("value", "\t", 1)
    return spark.read.text(path).select(F.from_json(head, "array<string>")[0].alias("sortie"), F.substr("value", F.length(head) + 2).alias("document"))


def read_analysis(spark: SparkSession, path: str, packed: bool = False) -> dict[str, DataFrame]:
    """The tables in analysis documents (SRC-5, UPS-7).

    documents, corrupt, gaps, episodes, episode_transitions, mode_transitions, torque, bool_channels, enum_channels,
    num_channels, sample_rows, context_rows and points; each has the document's path, or with packed, where many
    documents are in a file, its sortie instead. Parts that it lacks have no rows.
    """
    if packed:
        tables = _analysis_tables(read_packed(spark, path).select(F.col("sortie").alias("path"), F.col("document").alias("value")))
        return {name: t.withColumnRenamed("path", "sortie") for name, t in tables.items()}
    return _analysis_tables(spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def _analysis_tables(texts: DataFrame) -> dict[str, DataFrame]:
    # Parsed as a column, so that asking for the corrupt ones alone is allowed.
    whole = texts.select("path", F.from_json("value", ANALYSIS, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    # Parsed once and kept as columns; each table then reads its own part.
    docs = stored(whole.select("path", "d.*"), "documents")
    good = docs.where("_corrupt_record is null")
    eps = good.select("path", F.explode("episodes").alias("e"))
    moves = eps.select("path", F.col("e.episode").alias("episode"), time_seconds(F.col("e.start_time")).alias("start_t"), F.posexplode("e.transitions").alias("ord", "x"))
    return {
        "documents": good.drop("_corrupt_record"), "corrupt": docs.where("_corrupt_record is not null").select("path"),
        "gaps": good.select("path", F.inline("data_gaps")), "mode_transitions": good.select("path", F.inline("mode_transitions")), "torque": good.select("path", F.inline("torque_stats")),
        "bool_channels": good.select("path", F.inline("bool_channels")), "enum_channels": good.select("path", F.inline("enum_channels")), "num_channels": good.select("path", F.inline("num_channels")),
        "sample_rows": good.select("path", F.inline("sample_rows")), "context_rows": good.select("path", F.inline("context_rows")),
        "points": good.select("path", F.explode(F.map_from_arrays(F.array(F.lit("flight"), F.lit("takeoff")), F.array("flight_plots", "takeoff_plots"))).alias("scope", "plots")).select("path", "scope", F.explode("plots").alias("signal", "p")).select("path", "scope", "signal", F.explode("p").alias("p")).select("path", "scope", "signal", F.col("p")[0].alias("t"), F.col("p")[1].alias("v")),
        "episodes": eps.select("path", "e.episode", time_seconds(F.col("e.start_time")).alias("start_t"), time_seconds(F.col("e.end_time")).alias("end_t"), "e.duration_s"),
        "episode_transitions": moves.select("path", "episode", "ord", "x.signal", time_seconds(F.col("x.time")).alias("t"), (time_seconds(F.col("x.time")) - F.col("start_t")).alias("dt"), F.col("x.from").alias("from_v"), F.col("x.to").alias("to_v")),
    }


def latest_trace_graph(spark: SparkSession, root: str) -> str | None:
    """The trace graph below a folder whose name comes last; None if there is none (SRC-6)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "traceData*.json").load(root).select("path")
    last = files.orderBy(F.element_at(F.split("path", "/"), -1).desc(), F.desc("path")).limit(1).collect()
    return last[0]["path"] if last else None


def read_trace_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a trace graph; of nodes with one key the last counts (SRC-6)."""
    form = "nodes array<struct<key:string,blockName:string,blockType:string,model:string,isTestPoint:boolean,testPointName:string>>, edges array<struct<srcKey:string,dstKey:string>>"
    doc = spark.read.schema(form).option("multiLine", True).json(path)
    nodes = first_wins(doc.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*"), ["key"], [F.desc("pos")]).drop("pos")
    return nodes, doc.select(F.inline("edges"))


def read_correlations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a correlation report; of rows for one signal the last counts (SRC-8)."""
    form = "correlations array<struct<signal:string,model:string,key:string,score:double,frequency:double,n_episodes:bigint,n_sorties:bigint,mean_dt_s:double,std_dt_s:double,common_from:double,common_to:double>>"
    rows = spark.read.schema(form).option("multiLine", True).json(path).select(F.posexplode("correlations").alias("pos", "c")).select("pos", "c.*")
    return first_wins(rows, ["signal"], [F.desc("pos")]).drop("pos")


def signal_catalog(samples: DataFrame) -> DataFrame:
    return samples.groupBy("source", "signal").agg(F.min("col_ord").alias("col_ord"))
