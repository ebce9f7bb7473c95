"""Session files: discovery, exclusion, raw lines and the incremental cursor."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import encode_project, session_of

_SCHEMA = "path string, modificationTime timestamp, length long"


def discover(spark: SparkSession, root: str, exclude: list[str] | tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(path, key, project, session, aside, mtime, size), oldest first.

    Sessions are <project>/<session>.jsonl; asides are files
    agent-aside_question*.jsonl in <project>/<session>/subagents.  ``exclude``
    lists project paths, compared in their encoded form.  The limit cuts before
    any later filter.
    """
    root = root.rstrip("/")
    listing = lambda pattern: spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")
    parts = []
    for pattern, aside in ((f"{root}/*/*.jsonl", False), (f"{root}/*/*/subagents/agent-aside_question*.jsonl", True)):
        if _matches(spark, pattern):
            parts.append(listing(pattern).withColumn("aside", F.lit(aside)))
    if not parts:
        return spark.createDataFrame([], "path string, key string, project string, session string, aside boolean, mtime timestamp, size long")
    files = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    up = F.when(F.col("aside"), F.element_at(F.split("path", "/"), -4)).otherwise(F.element_at(F.split("path", "/"), -2))
    files = files.withColumn("project", up)
    gone = [p.replace("/", "-") for p in exclude]
    if gone:
        files = files.where(~F.col("project").isin(gone))
    depth = F.when(F.col("aside"), 4).otherwise(2)
    key = F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/")
    files = files.select("path", key.alias("key"), "project", session_of("path").alias("session"), "aside", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    ordered = files.orderBy("mtime", "path")
    return ordered if limit is None else ordered.limit(limit)


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found is not None and len(found))


def per_project(files: DataFrame) -> DataFrame:
    """(project, sessions, asides), most sessions first."""
    return files.groupBy("project").agg(F.count("*").alias("sessions"), F.count_if("aside").alias("asides")).orderBy(F.desc("sessions"), "project")


def excluded_projects(projects: DataFrame, exclude: DataFrame) -> DataFrame:
    """The projects whose encoded name is that of an excluded path (column path)."""
    return projects.join(exclude.select(encode_project("path").alias("project")).distinct(), "project", "left_semi")


def raw_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(project, session, aside, line_no, value) of the files; blank lines go.

    Large files are split among tasks; lines are numbered from 0 by the start of
    their split and their place in it.  Where ``files`` has a column offset, as
    ``needs_processing`` gives it, only what follows that byte is read, and lines
    are numbered from there; such files are read whole by a task each.
    """
    resumes = "offset" in files.columns
    paths: dict[bool, list[str]] = {True: [], False: []}
    for r in files.select("path", (F.col("offset") > 0).alias("resumed") if resumes else F.lit(False).alias("resumed")).toLocalIterator():
        paths[r.resumed].append(r.path)
    named = files.select(_same("path").alias("p"), "project", "session", "aside", *(["offset"] if resumes else []))
    parts = []
    if paths[False]:
        text = spark.read.text(paths[False]).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value")
        order = F.row_number().over(Window.partitionBy("path").orderBy("start", "place"))
        numbered = text.withColumn("line_no", order.cast("long") - 1)
        parts.append(numbered.join(named, _same("path") == F.col("p")))
    if paths[True]:
        whole = spark.read.format("binaryFile").load(paths[True]).select("path", "content").join(named, _same("path") == F.col("p"))
        rest = F.split(F.expr("substring(content, cast(offset as int) + 1)").cast("string"), "\n")
        parts.append(whole.select("project", "session", "aside", F.posexplode(rest).alias("line_no", "value")))
    if not parts:
        return spark.createDataFrame([], "project string, session string, aside boolean, line_no long, value string")
    each = [p.where("trim(value) <> ''").select("project", "session", "aside", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value")) for p in parts]
    return each[0] if len(each) == 1 else each[0].unionByName(each[1])


def session_lines(lines: DataFrame) -> DataFrame:
    """(project, session, aside, line_no, value) of lines (path, offset, value), by where their files lie.

    Files are those that ``discover`` finds: <project>/<session>.jsonl, and asides
    in <project>/<session>/subagents; of that folder other files are left out.
    """
    parts = F.split("path", "/")
    inside = F.element_at(parts, -2) == "subagents"
    aside = F.coalesce(inside & F.element_at(parts, -1).startswith("agent-aside_question"), F.lit(False))
    return lines.where(~inside | aside).select(F.when(aside, F.element_at(parts, -4)).otherwise(F.element_at(parts, -2)).alias("project"), session_of("path").alias("session"), aside.alias("aside"), F.col("offset").alias("line_no"), "value")


def read_ends(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, mtime, offset) where reading ended: the end of the file, or the start of a last line that isn't JSON yet."""
    last = lines.groupBy("session").agg(F.max_by("value", "line_no").alias("last"))
    wanting = F.when(F.try_parse_json("last").isNull(), F.octet_length("last")).otherwise(0)
    return files.join(last, "session", "left").select("key", F.col("mtime").cast("long").alias("mtime"), (F.col("size") - F.coalesce(wanting, F.lit(0))).alias("offset"))


def _same(path: str):
    """Spark writes one path as file:/x or file:///x."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_cursor(spark: SparkSession, text: str) -> DataFrame:
    """(key, mtime, offset) of a saved cursor: {key: [mtime, offset]} or {key: {mtime, offset}}, or, as once, {key: mtime}."""
    rows = []
    for key, v in json.loads(text.strip() or "{}").items():
        if isinstance(v, dict):
            rows.append((key, int(v.get("mtime", 0)), int(v.get("offset", v.get("byte_offset", 0)))))
        elif isinstance(v, list):
            rows.append((key, int(v[0]), int(v[1])))
        else:
            rows.append((key, int(v), 0))
    return spark.createDataFrame(rows, "key string, mtime long, offset long")


def save_cursor(cursor: DataFrame) -> str:
    return json.dumps({r.key: [r.mtime, r.offset] for r in cursor.orderBy("key").collect()})


def load_cursor(spark: SparkSession, path: str) -> DataFrame:
    """The cursor saved at a path of any of Hadoop's file systems; empty where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return read_cursor(spark, spark.read.text(path, wholetext=True).first().value if found else "")


def store_cursor(spark: SparkSession, path: str, cursor: DataFrame) -> None:
    """Saves the cursor in one rename, so that a reader sees the old one or the new one."""
    text = save_cursor(cursor)
    new, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(there, False)
    if not fs.rename(new, there):
        raise OSError(f"{path} can't be written")


def needs_processing(files: DataFrame, cursor: DataFrame) -> DataFrame:
    """The files that are new, newer or longer than the cursor has them, with the offset to resume at."""
    c = cursor.select(F.col("key").alias("__key"), F.col("mtime").alias("__mtime"), "offset")
    joined = files.join(c, files["key"] == F.col("__key"), "left")
    seconds = F.col("mtime").cast("long") if dict(files.dtypes)["mtime"].startswith("timestamp") else F.col("mtime")
    new = F.col("__key").isNull() | (seconds > F.col("__mtime")) | (F.col("size") > F.col("offset"))
    return joined.where(new).withColumn("offset", F.coalesce("offset", F.lit(0))).drop("__key", "__mtime")


def mark_processed(cursor: DataFrame, done: DataFrame) -> DataFrame:
    """The cursor after ``done`` (key, mtime, offset), whose offsets are those at which reading ended."""
    both = cursor.select("key", "mtime", "offset", F.lit(0).alias("rank")).union(done.select("key", F.col("mtime").cast("long"), "offset", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rank")))
    return both.withColumn("n", last).where("n = 1").select("key", "mtime", "offset")
