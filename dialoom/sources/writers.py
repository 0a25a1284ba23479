"""One text file per row, written by the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import output_file_path

STATUS_SCHEMA = (
    "input_file_path string, export_output_path string, export_status string, "
    "export_error string, export_content_size_bytes long"
)


def write_text_files(
    df: DataFrame,
    directory: str,
    extension: str,
    path: str = "input_file_path",
    content: str = "result_content",
    output: str | None = None,
) -> DataFrame:
    """Write ``content`` of every row that has one and return one status row per file.

    The result is lazy: evaluate it once, for instance by writing it as a version. Each file is
    written aside and then moved into place, so a task that runs again leaves the same file; on a
    local storage a task has a hidden folder of its own for that, as tasks wait for each other
    where they make files in one folder.
    ``output`` names a column with ready-made output paths; otherwise they follow from ``path``.
    ``directory`` must be one all executors share, given with its scheme; a path without one is
    taken in a local session only. A row that cannot be written, for whatever reason, is reported
    as ``export_failed`` and never ends the job. ``content`` may be text or bytes.
    """
    target = F.col(output) if output else output_file_path(path, directory, extension)
    rows = df.filter(F.col(content).isNotNull()).select(
        F.col(path).alias("input_file_path"), target.alias("target"), F.col(content).alias("content")
    )

    local = df.sparkSession.sparkContext.master.startswith("local")

    def plain(where: str) -> str:
        return "/" + where.removeprefix("file:").lstrip("/") if where.startswith("file:") else where

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        made = set()
        top, own = plain(directory).rstrip("/"), f"._{uuid.uuid4().hex}"
        try:
            yield from statuses(batches, made, f"{top}/", f"{top}/{own}")
        finally:
            if f"{top}/{own}" in made:
                fs.LocalFileSystem().delete_dir(f"{top}/{own}")

    def statuses(batches: Iterator[pd.DataFrame], made: set, top: str, own: str) -> Iterator[pd.DataFrame]:
        import re
        import uuid

        from pyarrow import fs

        for batch in batches:
            out = []
            for source, where, text in batch.itertuples(index=False):
                data = text.encode("utf-8") if isinstance(text, str) else bytes(text)
                try:
                    if not local and not re.match("[A-Za-z][A-Za-z0-9+.-]*:", where):
                        raise ValueError(f"a path without a scheme is another folder on each machine: {where}")
                    remote = ":" in where.split("/", 1)[0] and not where.startswith("file:")
                    system, name = fs.FileSystem.from_uri(where) if remote else (fs.LocalFileSystem(), plain(where))
                    parent = name.rsplit("/", 1)[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    if not remote and name.startswith(top):
                        if own not in made:
                            system.create_dir(own, recursive=True)
                            made.add(own)
                        aside = f"{own}/{uuid.uuid4().hex}"
                    else:
                        aside = f"{parent}/._{uuid.uuid4().hex}"
                    with system.open_output_stream(aside) as stream:
                        stream.write(data)
                    system.move(aside, name)
                    out.append((source, where, "exported", None, len(data)))
                except Exception as error:  # noqa: BLE001 - every row gets its status
                    out.append((source, None, "export_failed", str(error), len(data)))
            yield pd.DataFrame(
                out,
                columns=[
                    "input_file_path",
                    "export_output_path",
                    "export_status",
                    "export_error",
                    "export_content_size_bytes",
                ],
            )

    return rows.mapInPandas(write, STATUS_SCHEMA)
