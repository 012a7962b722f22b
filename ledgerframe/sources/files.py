"""Sources and sinks of receipts, sessions and ledgers."""

from __future__ import annotations

import posixpath
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict_json import canonical, loads
from ..operators import outcomes, sessions
from ..operators.integrity import require_empty
from ..operators.trial import hashed


def read_documents(spark: SparkSession, path: str, glob: str = "*.json", max_bytes: int = 1 << 20) -> DataFrame:
    """(path, length, raw, sha256) of whole files; a file over the limit fails the read.

    Sizes are checked from the listing, before any content is read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    require_empty(files.select("path", "length").filter(F.col("length") > max_bytes), "file_size_limit_exceeded")
    return files.select("path", "length", F.col("content").alias("raw"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, glob: str = "*.json", kind: str = "object", max_bytes: int = 1 << 20) -> DataFrame:
    """(path, sha256, canonical) of strict JSON documents; one that is no ``kind`` (object or array) fails the read."""
    rows = read_documents(spark, path, glob, max_bytes).select("path", "sha256", canonical("raw").alias("c")).select("path", "sha256", "c.*")
    wrong = F.coalesce("error", F.when(~F.col("canonical").startswith({"object": "{", "array": "["}[kind]), F.lit(f"json_{kind}_required")))
    require_empty(rows.select("path", wrong.alias("error")).filter("error IS NOT NULL"), "json_document_invalid")
    return rows.drop("error")


def read_artifacts(spark: SparkSession, manifest: str, max_files: int = 512, max_bytes: int = 8 << 20, max_total: int = 32 << 20) -> DataFrame:
    """(index, evidence_id, content) of the files that a JSON object of ids and relative paths names, in its order.

    Paths must be text and stay below the manifest's folder; a broken limit fails the
    read before any content is looked at.
    """
    folder, names = _manifest(spark, manifest, dict)
    files = _named(spark, folder, [(k, k, v) for k, v in names.items()], "evidence", "evidence_manifest", max_files, max_bytes, max_total)
    return files.select("index", F.col("key").alias("evidence_id"), F.col("raw").alias("content"))


def read_lines(spark: SparkSession, path: str, schema: str, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, line, row) of JSON-lines files of bounded size: one object a line, blank lines skipped.

    A line that does not parse fails the read with its number.
    """
    files = read_documents(spark, path, "*", max_bytes).select("path", F.posexplode(F.split(F.col("raw").cast("string"), "\n")).alias("at", "text"))
    rows = files.filter(F.trim("text") != "").select("path", (F.col("at") + 1).alias("line"), "text", canonical("text").alias("c"))
    bad = F.coalesce("c.error", F.when(~F.col("c.canonical").startswith("{"), F.lit("json_object_required")))
    require_empty(rows.select("path", "line", bad.alias("error")).filter("error IS NOT NULL"), "json_line_invalid")
    return rows.select("path", "line", F.from_json("text", schema).alias("row"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file by a fixed schema; blank lines are skipped, ``_bad`` holds lines that do not parse."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def _checked(files: DataFrame, error: Column, label: str, parts: list[Column], sha256: Column) -> DataFrame:
    """The parts of valid documents, each session once; an invalid document or a repeated session fails the read."""
    require_empty(files.select("path", error.alias("error")).filter("error IS NOT NULL"), f"{label}_invalid")
    rows = files.select(*parts, "path", sha256.alias("sha256"))
    require_empty(rows.groupBy("session_id").count().filter("count > 1"), f"{label}_duplicate")
    return rows


def read_sessions(spark: SparkSession, path: str, max_bytes: int = 8 << 20) -> DataFrame:
    """Valid sessions of a folder of JSON documents, with the hash of each file."""
    files, raw = read_documents(spark, path, "*.json", max_bytes), F.col("raw").cast("string")
    return _checked(files, sessions.session_error(raw), "session", sessions.session_columns(raw), F.col("sha256"))


def read_continuations(spark: SparkSession, path: str, max_bytes: int = 8 << 20) -> DataFrame:
    """Valid continuations of a folder of JSON documents, with the hash of each object."""
    files, raw = read_documents(spark, path, "*.json", max_bytes), F.col("raw").cast("string")
    return _checked(files, sessions.continuation_error(raw), "continuation", sessions.continuation_columns(raw), hashed(raw, "")["whole"])


def read_outcomes(spark: SparkSession, path: str, continuations: DataFrame, kinds: tuple[str, ...], window: int, phase: str, unlock_sha256: str | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """Valid outcome rows (line and fields) of one JSON-lines file, each session once; blank lines are skipped.

    The earliest line that breaks a rule fails the read, with the first rule it breaks.
    """
    folder, name = path.rsplit("/", 1)
    lines = read_documents(spark, folder, _literal(name), max_bytes).select(F.posexplode(F.split(F.col("raw").cast("string"), "\n")).alias("at", "raw"))
    rows = lines.filter(F.trim("raw") != "").select((F.col("at") + 1).alias("line"), "raw")
    require_empty(outcomes.outcome_faults(rows, continuations, kinds, window, phase, unlock_sha256).orderBy("line"), "outcome_invalid")
    return rows.select("line", *outcomes.outcome_columns(F.col("raw")))


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Append rows to a Parquet ledger; a key that is there already fails the append.

    For one writer; several extend a ledger by ``commits.commit``.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        require_empty(rows.join(spark.read.parquet(path).select(key), key, "left_semi").select(key), "duplicate_key")
    rows.write.mode("append").parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    rows.write.mode("errorifexists").parquet(path)


def read_manifest(spark: SparkSession, manifest: str, max_files: int = 512, max_bytes: int = 1 << 20, max_total: int = 16 << 20) -> DataFrame:
    """(index, name, raw) of the files a JSON array of relative paths names, in its order.

    Paths must be text and stay below the manifest's folder; every file must exist; a
    broken limit fails the read before any content is looked at.
    """
    folder, names = _manifest(spark, manifest, list)
    files = _named(spark, folder, [(str(i), x if isinstance(x, str) else "", x) for i, x in enumerate(names)], "file_manifest", "file_manifest", max_files, max_bytes, max_total)
    return files.select("index", F.col("key").alias("name"), "raw")


def _manifest(spark: SparkSession, manifest: str, kind: type) -> tuple[str, Any]:
    """A manifest's folder and value: one document of bounded size, read by the driver."""
    folder, name = manifest.rsplit("/", 1)
    found = read_documents(spark, folder, _literal(name)).select("raw").limit(1).collect()
    if not found:
        raise ValueError(f"manifest_missing:{name}")
    value = loads(bytes(found[0].raw))
    if not isinstance(value, kind):
        raise ValueError("json_object_required" if kind is dict else "json_array_required")
    return folder, value


def _literal(name: str) -> str:
    """A name whose marks of patterns stand for themselves."""
    return re.sub(r"([*?\[\]{}\\,^])", r"\\\1", name)


def _named(spark: SparkSession, folder: str, entries: list[tuple[str, str, Any]], label: str, kind: str, max_files: int, max_bytes: int, max_total: int) -> DataFrame:
    """(index, key, raw) of entries (name in messages, key, relative path) after all limits hold; every file must exist."""
    if len(entries) > max_files:
        raise ValueError(f"{kind}_count_limit_exceeded")
    paths = []
    for shown, _, path in entries:
        if not isinstance(path, str):
            raise ValueError(f"{kind}_invalid:{shown}")
        below = posixpath.normpath(path)
        # A colon would begin a scheme; "." is the folder itself.
        if below in (".", "..") or below.startswith(("/", "../")) or ":" in below:
            raise ValueError(f"{label}_path_escape:{shown}")
        paths.append(f"{folder}/{below}")
    local = lambda p: re.sub("^[a-z]+:/+", "/", p)
    names = spark.createDataFrame([(i, key, local(p)) for i, ((_, key, _), p) in enumerate(zip(entries, paths, strict=True))], "index int, key string, _p string")
    if not paths:
        return names.select("index", "key", F.lit(None).cast("binary").alias("raw"))
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(sorted({_literal(p) for p in paths}))
    own = F.regexp_replace("path", "^[a-z]+:/+", "/")
    sizes = names.join(files.select(own.alias("_p"), "length"), "_p").agg(F.max("length"), F.sum("length")).first()
    if (sizes[0] or 0) > max_bytes:
        raise ValueError("file_size_limit_exceeded")
    if (sizes[1] or 0) > max_total:
        raise ValueError(f"{label}_total_size_limit_exceeded")
    return names.join(files.select(own.alias("_p"), F.col("content").alias("raw")), "_p").drop("_p")
