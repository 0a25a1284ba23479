"""Reading script files, archives and external CSV tables."""

from __future__ import annotations

import codecs
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.base import as_col
from dialoom.operators.ordering import number_rows
from dialoom.session import materialize, parallelism

GLOB_CHARS = "*?["
# Archive members to keep; the test is case-sensitive.
ARCHIVE_SUFFIXES = (".sql", ".bteq")


def _regex(pattern: str) -> str:
    """A path pattern as a regular expression over whole paths; what lies below a match counts too."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    # The reader names files with their storage, also where the pattern does not.
    storage = "(?:[a-z][a-z0-9+.-]*:(?://[^/]*)?)?" if pattern.startswith("/") else ""
    return rf"(?s)\A{storage}{out.rstrip('/')}(?:/.*)?\z"


def _whole(path: str) -> str:
    """A local path without its scheme and from the root; other paths as given."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path) else os.path.abspath(path) + "/" * path.endswith("/")


def _has_glob(text: str) -> bool:
    return any(ch in text for ch in GLOB_CHARS)


def _load_root(pattern: str) -> str:
    """Folder to list for a pattern: before a ``**``, else above a last part with glob characters."""
    if "**" in pattern:
        first = min(pattern.index(ch) for ch in GLOB_CHARS if ch in pattern)
        return pattern[: pattern.rindex("/", 0, first) + 1]
    parent, _, last = pattern.rpartition("/")
    return parent + "/" if _has_glob(last) else pattern


#: Columns of a listing; ``folder`` entries are listed in turn.
LISTED = "path string, modificationTime timestamp, length long, folder boolean"
# Entries that leave a listing task at once, and bytes and files that a task reads.
LISTED_ROWS = 10_000
READ_BYTES, READ_FILES = 32 << 20, 10_000


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over below the folder they are given."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of folders, as they are met: a folder of any size takes the memory of one batch."""
    kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in LISTED.split(", ")]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            with os.scandir("/" + folder.removeprefix("file:").lstrip("/")) as found:
                for entry in found:
                    if _hidden(entry.name):
                        continue
                    about, inner = entry.stat(), entry.is_dir()
                    rows.append((f"{folder.rstrip('/')}/{entry.name}", about.st_mtime_ns // 1_000_000 * 1000, about.st_size, inner))
                    if len(rows) >= LISTED_ROWS:
                        yield frame(rows)
                        rows = []
    if rows:
        yield frame(rows)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime and length of the files below a local folder, listed by tasks into a written table.

    One round per level of folders; the folders of a level are dealt over the tasks. Nothing comes
    to the driver, whatever the number of files. As Spark's readers do, it leaves out hidden names
    and empty files.
    """
    level, found = spark.range(1).select(F.lit("file:" + folder.rstrip("/")).alias("path")), None
    while True:
        entries = materialize(level.mapInArrow(_entries, LISTED))
        files = entries.filter("NOT folder AND length > 0").drop("folder")
        found = files if found is None else found.unionByName(files)
        folders = entries.filter("folder").select("path")
        if folders.isEmpty():
            return found
        level = folders.repartition(parallelism(spark), "path")


@F.arrow_udf(T.BinaryType())
def _contents(paths: pa.Array) -> pa.Array:
    def whole(path: str) -> bytes:
        with open_binary(path) as file:
            return file.read()

    return pa.array((whole(p.as_py()) for p in paths), pa.binary())


# Marked so that it runs once, above every filter on the listing; who does not select it does not read a file.
_contents = _contents.asNondeterministic()


def _with_contents(files: DataFrame, number: str | None = None) -> DataFrame:
    """Listed files, numbered or not, with their bytes, read by tasks of a bounded number of bytes and files."""
    size = files.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    tasks = max((size["bytes"] or 0) // READ_BYTES + 1, size["files"] // READ_FILES + 1)
    tasks = max(tasks, min(parallelism(files.sparkSession), size["files"]))
    if number:
        # All that a listing holds goes through the sort, so that no numbers have to be joined back.
        files = number_rows(files, ["path"], number).withColumn(number, F.col(number).cast("int"))
    # By a key of its own: an exchange that deals by path already would stand in for this one and be joined by its bytes.
    return files.repartition(tasks, F.xxhash64("path")).withColumn("content", _contents("path"))


def _read_by_spark(spark: SparkSession, pattern: str) -> DataFrame:
    def reader(**options):
        binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return binary.options(**options).load(_load_root(pattern))

    root, last = _load_root(pattern), pattern.rstrip("/").rpartition("/")[2]
    if root == pattern:
        return reader()
    matches = F.col("path").rlike(_regex(pattern))
    if last == "**":
        return reader().filter(matches)
    # A test of the path comes too late to save reading a file, a name filter does not. It is the
    # same as long as no folder has a matching name, which a listing without contents tells.
    by_name = F.regexp_extract("path", r"([^/]*)\z", 1).rlike(_regex(last))
    if reader().select("path").filter(matches & ~by_name).isEmpty():
        return reader(pathGlobFilter=last).filter(matches)
    return reader().filter(matches)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The local folder whose files a path, as it was given, chooses among; None for other storages, single files and globs of folders."""
    # Without a scheme a path is the driver's own, unless the tasks run there and files are the default storage.
    if not path.startswith("file:"):
        storage = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
        if not storage.startswith("file:") or not spark.sparkContext.master.startswith("local"):
            return None
    root = _load_root(_whole(path))
    return None if not root.startswith("/") or _has_glob(root) or not os.path.isdir(root) else root.rstrip("/") or "/"


def read_scripts(spark: SparkSession, paths: str | Sequence[str], number: str | None = None) -> DataFrame:
    """Files below comma-separated folders, files and globs (``* ? [ ] **``), each file once.

    Result: path, modificationTime, length, content (bytes). Select what is needed: the bytes are
    only read when ``content`` is. A file that several paths name is kept from the first of them,
    by a test of its path. Local folders, on a cluster those given with ``file:``, are listed by
    tasks, each folder once; the listing is a written table, and its paths are dealt over the tasks
    that read them. Other storages go through Spark's reader, which lists at the driver. ``number``
    names a column with the files' numbers (``number_files``); where all files are listed by tasks,
    they get them before they are read.
    """
    given = [p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths) if p.strip()]
    if not given:
        raise ValueError("no input path given")
    out, earlier, listings, listed = [], [], {}, None
    for path in given:
        whole = _whole(path)
        folder = _local_folder(spark, path)
        if folder is None:
            found = _read_by_spark(spark, whole)
        else:
            if folder not in listings:
                listings[folder] = list_files(spark, folder)
            found = listings[folder]
            if _load_root(whole) != whole:
                found = found.filter(F.col("path").rlike(_regex(whole)))
        for before in earlier:
            found = found.filter(~F.col("path").rlike(before))
        earlier.append(_regex(whole))
        if folder is None:
            out.append(found)
        else:
            listed = found if listed is None else listed.unionByName(found)
    early = number if not out else None
    if listed is not None:
        out.append(_with_contents(listed, early))
    first, *rest = out
    for found in rest:
        first = first.unionByName(found)
    return number_files(first, name=number) if number and not early else first


def plain_path(path: Column | str) -> Column:
    """Path without the ``file:`` scheme that the reader puts before local paths."""
    return F.regexp_replace(as_col(path), r"\Afile:/*", "/")


def number_files(df: DataFrame, path: str = "path", name: str = "input_file_number") -> DataFrame:
    """1-based file numbers in path order.

    Only the paths are sorted and numbered; the numbers are joined back, so file contents are
    not moved through the sort.
    """
    numbers = number_rows(df.select(path), [path], name).withColumn(name, F.col(name).cast("int"))
    return df.join(numbers, path)


def _decode_in_python(raw: Column, encoding: str) -> Column:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else b.decode(encoding, errors="replace"))

    return run.asNondeterministic()(raw)


def _utf8(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def decode_content(df: DataFrame, raw: str = "content", encoding: str | None = None) -> DataFrame:
    """Bytes to (input_file_content, input_file_encoding); bytes that do not fit become U+FFFD.

    Without ``encoding``: a byte-order mark decides, else UTF-8, else ISO-8859-1. UTF-8 and
    ISO-8859-1 are decoded without Python; other encodings go through it, and when the encoding
    is found per row only the rows concerned carry their bytes there.
    """
    data = F.col(raw)
    if encoding is None:
        marked8 = F.substring(data, 1, 3) == F.lit(codecs.BOM_UTF8)
        marked16 = F.substring(data, 1, 2).isin(codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
        valid = F.try_validate_utf8(data.cast("string"))
        df = df.withColumn("_wide", _decode_in_python(F.when(marked16, data), "utf-16")).withColumn("_valid", valid)
        text = (
            F.when(marked8, _utf8(F.substr(data, F.lit(4))))
            .when(marked16, F.col("_wide"))
            .otherwise(F.coalesce("_valid", F.decode(data, "ISO-8859-1")))
        )
        name = (
            F.when(marked8, "utf-8-sig")
            .when(marked16, "utf-16")
            .when(F.col("_valid").isNotNull(), "utf-8")
            .when(data.isNotNull(), "iso-8859-1")
        )
    else:
        known = codecs.lookup(encoding).name
        if known == "utf-8":
            text = _utf8(data)
        elif known == "iso8859-1":
            text = F.decode(data, "ISO-8859-1")
        else:
            text = _decode_in_python(data, known)
        name = F.lit(encoding)
    kept = [c for c in df.columns if c not in (raw, "_wide", "_valid")]
    return df.select(*kept, text.alias("input_file_content"), name.alias("input_file_encoding"))


DIRECTORY_SCHEMA = "archive string, member string, place long, packed long, size long, method int, crc long, error string"
MEMBER_SCHEMA = "archive string, member string, name string, content binary, error string"
# Unpacked members leave a task in batches of at most this size.
MEMBER_BATCH_BYTES, MEMBER_BATCH_ROWS = 32 << 20, 2000
#: Fixed values of the zip format: size and signature of a member's header, where its name and extra lengths stand.
_HEADER, _SIGNATURE, _LENGTHS = 30, b"PK\x03\x04", slice(26, 30)
_STORED, _DEFLATED, _ENCRYPTED = 0, 8, 1


def open_binary(path: str):
    """A seekable file of any storage that Arrow knows; only what is read is fetched."""
    from pyarrow import fs

    if path.startswith("file:") or ":" not in path.split("/", 1)[0]:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115 - closed by the caller
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def archive_directory(paths: DataFrame, suffixes: Sequence[str] = ARCHIVE_SUFFIXES, opened: Callable = open_binary) -> DataFrame:
    """One row per member with a wanted suffix: where its bytes lie in the archive. Only directories are read."""
    wanted = tuple(suffixes)

    def entries(path: str) -> Iterator[tuple]:
        try:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                for m in archive.infolist():
                    if m.filename.endswith(wanted):
                        fault = "the member is encrypted" if m.flag_bits & _ENCRYPTED else None
                        yield path, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, fault
        except Exception as error:  # noqa: BLE001 - an archive's fault is its row's
            yield path, None, None, None, None, None, None, str(error) or type(error).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path in batch["path"] for row in entries(path)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DIRECTORY_SCHEMA.split(", ")])
            yield frame.astype({"place": "Int64", "packed": "Int64", "size": "Int64", "method": "Int32", "crc": "Int64"})

    return paths.select("path").mapInPandas(run, DIRECTORY_SCHEMA)


def _unpacked(file, place: int, packed: int, size: int, method: int, crc: int) -> bytes:
    """A member from its own range of the archive."""
    file.seek(place)
    header = file.read(_HEADER)
    if header[:4] != _SIGNATURE or len(header) < _HEADER:
        raise zipfile.BadZipFile("no member begins at its place")
    # The lengths here may differ from the directory's.
    file.seek(place + _HEADER + sum(struct.unpack("<HH", header[_LENGTHS])))
    data = file.read(packed)
    if method == _DEFLATED:
        data = zlib.decompress(data, -15, max(size, 1))
    elif method != _STORED:
        raise NotImplementedError(f"compression method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("the member's checksum differs")
    return data


def read_archive_members(
    paths: DataFrame, suffixes: Sequence[str] = ARCHIVE_SUFFIXES, opened: Callable = open_binary
) -> DataFrame:
    """Zip files in ``path`` -> one row per member with a wanted suffix.

    First the directories of all archives, then the members dealt over the tasks, each read by its
    own range: no row holds an archive, whatever its size, and the members of one archive spread.
    The member's folder separators become underscores in ``name``. An archive or a member that
    cannot be read gives a row with ``error`` and no content. ``opened`` opens a path for seeking.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, at, out, held = None, None, [], 0
        frame = lambda: pd.DataFrame(out, columns=[c.split()[0] for c in MEMBER_SCHEMA.split(", ")])
        try:
            for batch in batches:
                for path, member, place, packed, size, method, crc, fault in batch.itertuples(index=False):
                    content, error = None, fault
                    if error is None:
                        try:
                            if path != at:
                                if file is not None:
                                    file.close()
                                file, at = None, None
                                file, at = opened(path), path
                            content = _unpacked(file, int(place), int(packed), int(size), int(method), int(crc))
                        except Exception as found:  # noqa: BLE001 - a member's fault is its row's
                            error = str(found) or type(found).__name__
                    out.append((path, member, None if member is None else member.replace("/", "_"), content, error))
                    held += len(content or b"")
                    if held > MEMBER_BATCH_BYTES or len(out) >= MEMBER_BATCH_ROWS:
                        yield frame()
                        out, held = [], 0
            if out:
                yield frame()
        finally:
            if file is not None:
                file.close()

    # Written, so that no directory is read twice; neighbours in an archive share its open file.
    found = materialize(archive_directory(paths, suffixes, opened))
    dealt = found.repartition(parallelism(paths.sparkSession), "archive", F.floor(F.coalesce("place", F.lit(0)) / MEMBER_BATCH_BYTES))
    return dealt.sortWithinPartitions("archive", "place").mapInPandas(members, MEMBER_SCHEMA)


def read_external_csv(spark: SparkSession, location: str, schema: T.StructType | str) -> DataFrame:
    """CSV files as an external table: no header, declared types, nothing inferred."""
    return spark.read.schema(schema).csv(location, header=False, mode="PERMISSIVE")
