"""Reading a source tree as a ``files`` table, and the path rules that go with it."""

from __future__ import annotations

import re
from collections.abc import Collection

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graspmeter import constants as K
from graspmeter.functions.text import clean_text, line_count


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' if there is none; a leading dot is not one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)\z", 1))


def language_of(path: Column) -> Column:
    entries = [F.lit(x) for pair in K.LANGUAGE_BY_EXTENSION.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), extension(path)), F.lit("unknown"))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*K.LANGUAGE_BY_EXTENSION)


def in_skipped_dir(relative_path: Column) -> Column:
    """True if a directory of the path is on the skip list or hidden; the file name does not count."""
    parts = F.split(relative_path, "/", -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(dirs, lambda d: d.isin(*K.SKIPPED_DIRS) | d.startswith("."))


def in_priority_dir(relative_path: Column) -> Column:
    return relative_path.rlike(rf"\A(?:{'|'.join(K.PRIORITY_DIRS)})/")


def relative_to(path: Column, root: Column | str) -> Column:
    """Path below ``root`` with ``/`` separators."""
    root = F.lit(root) if isinstance(root, str) else root
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(slashed, base), F.substring(slashed, F.length(base) + 1, F.length(slashed))
    ).otherwise(slashed)


def select_files(listing: DataFrame, root: Column | str, limit: int | None = None) -> DataFrame:
    """Supported files outside skipped directories, with relative path and language.

    ``limit`` keeps the first files by path, the reference's own cap; off by default.
    """
    out = (
        listing.withColumn("relative_path", relative_to(F.col("path"), root))
        .where(is_supported(F.col("path")) & ~in_skipped_dir(F.col("relative_path")))
        .withColumn("language", language_of(F.col("path")))
    )
    return out.orderBy("path").limit(limit) if limit else out


#: An entry of a listing as text.
_ENTRY = re.compile(r"path=(.*?); isDirectory=(true|false)(?:; length=(\d+))?")


def list_tree(spark: SparkSession, root: str, endings: Collection[str] = tuple(K.LANGUAGE_BY_EXTENSION)) -> tuple[list[tuple[str, int]], list[str]]:
    """Path and length of every file with one of the endings below ``root``, and the folders that were listed.

    Skipped folders are not entered, so what lies in them is neither listed nor read. Folders
    that can't be listed are passed over. Folder by folder on the driver, which holds a path
    for each file, as any file source of Spark does.
    """
    jvm = spark.sparkContext._jvm
    path_of, text_of = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.lang3.ArrayUtils
    start = path_of(root)
    store = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, listed, waiting = [], [], [store.makeQualified(start).toString()]
    while waiting:
        folder = waiting.pop()
        try:
            # One text for all entries, instead of three calls for each.
            entries = text_of.toString(store.listStatus(path_of(folder)))
        except Py4JJavaError:
            continue
        listed.append(folder)
        for path, is_folder, length in _ENTRY.findall(entries):
            name = path.rsplit("/", 1)[-1]
            if is_folder == "false":
                if re.search(r"[^.]\.[^.]*$", name) and "." + name.rsplit(".", 1)[-1].lower() in endings:
                    files.append((path, int(length)))
            elif name not in K.SKIPPED_DIRS and not name.startswith("."):
                waiting.append(path)
    return sorted(files), sorted(listed)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path and cleaned text of the named files; Spark packs them into partitions by their lengths.

    Files that vanish or cannot be read are skipped, and broken UTF-8 gives replacement characters.
    """
    # A path is taken for a pattern unless its signs are escaped.
    exact = [re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in paths]
    if not exact:
        return spark.createDataFrame([], "path string, content string")
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(exact)
    text = clean_text(F.make_valid_utf8(F.col("content").cast("string")))
    return raw.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), text.alias("content"))


def read_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Path and cleaned text of every file below ``root`` whose name matches ``glob``.

    The name is matched while listing; files that vanish or cannot be read are skipped, and
    broken UTF-8 gives replacement characters.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .load(root)
    )
    text = clean_text(F.make_valid_utf8(F.col("content").cast("string")))
    return raw.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), text.alias("content"))


def scan_corpus(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Read a source tree: one row per supported file with its text and line count.

    Skipped folders are not entered, and only files of the languages are opened.
    Land the result once as a table: many small files are slow to read again.
    """
    below = root[len("file:") :] if root.startswith("file:") else root
    found, _ = list_tree(spark, root)
    files = select_files(read_files(spark, [path for path, _ in found]), below, limit)
    return files.select(
        F.col("path").alias("file_id"), "path", "relative_path", "language", "content"
    ).withColumn("line_count", line_count(F.col("content")))


def land(files: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Write the corpus once, spread by file, and read it back."""
    out = files.repartition(partitions, "file_id") if partitions else files
    out.write.mode("overwrite").parquet(folder)
    return files.sparkSession.read.parquet(folder)
