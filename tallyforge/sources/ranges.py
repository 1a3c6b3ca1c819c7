"""Files of any size, read by ranges: hashes, zip members, and archives written by tasks.

Nothing here holds a file: a hash is carried through a file's blocks, a zip is read from its directory and then member by
member.  Files are opened where the tasks run, by path (``file:``) or by ``pyarrow.fs`` (hdfs, s3, gs, abfs); a path of
another scheme is read whole by Spark's own reader, which ends at 2 GB a file.
"""

from __future__ import annotations

import bz2
import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
import zlib
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import written

BLOCK = 8 << 20
#: Packed bytes that one task reads of archives, about.
SHARE = 32 << 20
STORED, DEFLATED, BZIP2 = 0, 8, 12


def _scheme(path: str) -> str:
    return path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"


def can_open(path: str) -> bool:
    return _scheme(path) in ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _other(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


def opened(path: str):
    """A file that can be read from any place."""
    if _scheme(path) == "file":
        return open(_local(path), "rb")
    system, name = _other(path)
    return system.open_input_file(name)


def created(path: str):
    if _scheme(path) == "file":
        os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
        return open(_local(path), "wb")
    system, name = _other(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def files(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(path, length, content): all files under ``path``; the content is null, and never read, where tasks open files themselves.
    ``options`` are those of Spark's reader of files."""
    found = spark.read.format("binaryFile").options(**options).load(path)
    if all(map(can_open, [path] if isinstance(path, str) else path)):
        return found.select("path", "length", F.lit(None).cast("binary").alias("content"))
    return found.select("path", "length", "content")


def _source(path: str, content):
    return opened(path) if content is None else io.BytesIO(content)


def file_hashes(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(path, bytes, sha256, md5) of every file, its state carried through blocks of ``BLOCK`` bytes.

    Files are dealt to tasks by their lengths; one file is one task's work, as both hashes are sequential.
    """

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content, strict=True):
                n, sha, md5 = 0, hashlib.sha256(), hashlib.md5()
                with _source(p, c) as f:
                    while block := f.read(BLOCK):
                        n += len(block)
                        sha.update(block)
                        md5.update(block)
                yield pd.DataFrame({"path": [p], "bytes": [n], "sha256": [sha.hexdigest()], "md5": [md5.hexdigest()]})

    hashed = files(spark, path, **options).select("path", "content").mapInPandas(run, "path string, bytes long, sha256 string, md5 string")
    # Spark's scans leave out empty files; its listing, which the driver holds anyway, has them
    found = spark.read.format("binaryFile").options(**options).load(path)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()], "path string")
    empty = listed.join(found.select("path"), "path", "left_anti")
    nothing = F.lit("").cast("binary")
    return hashed.unionByName(empty.select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(nothing, 256).alias("sha256"), F.md5(nothing).alias("md5")))


_ENTRY = "archive string, member string, at long, packed long, size long, crc long, method int"


def zip_entries(spark: SparkSession, path: str | list[str], suffix: str = ".json") -> DataFrame:
    """(archive, member, at, packed, size, crc, method): the entries of zip archives, from each central directory.

    The last of equal names counts.  Folders and encrypted entries aren't listed; ``suffix`` in either case.  A file without a
    whole directory (cut short, no zip) raises with its path.
    """

    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content, strict=True):
                try:
                    with _source(p, c) as f, zipfile.ZipFile(f) as z:
                        last = {i.filename: i for i in z.infolist() if not i.is_dir() and not i.flag_bits & 1 and i.filename.lower().endswith(suffix)}
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{p} is not a whole zip archive: {e}") from e
                rows = [(p, n, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for n, i in last.items()]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ENTRY.split(", ")])

    return files(spark, path).select("path", "content").mapInPandas(run, _ENTRY)


def unpacked(f, at: int, packed: int, size: int, crc: int, method: int) -> bytes | None:
    """The bytes of one entry, read from its own range; null if they aren't what the directory says."""
    f.seek(at)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        return None
    f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = f.read(packed)
    try:
        if method == DEFLATED:
            raw = zlib.decompressobj(-15).decompress(raw, size + 1)
        elif method == BZIP2:
            raw = bz2.BZ2Decompressor().decompress(raw, size + 1)
        elif method != STORED:
            return None
    except (zlib.error, OSError):
        return None
    return raw if len(raw) == size and zlib.crc32(raw) == crc else None


def zip_texts(spark: SparkSession, path: str | list[str], members: DataFrame | None = None, suffix: str = ".json") -> DataFrame:
    """(archive, member, value): the members' texts; ``members`` (member) restricts them before anything is unpacked.

    Entries are dealt by (archive, place) to as many tasks as their packed bytes need, so a large archive is read by many
    tasks and neighbours by the same one.  Members that are damaged, packed by another method than stored, deflate and bzip2,
    or not UTF-8 are left out.
    """
    schema = "archive string, member string, value string"
    entries = zip_entries(spark, path, suffix)
    if members is not None:
        wanted = members.select("member").distinct()
        entries = entries.join(wanted, "member", "left_semi").select(*[x.split()[0] for x in _ENTRY.split(", ")])
    if not all(map(can_open, [path] if isinstance(path, str) else path)):
        # such a file is one value: each is read in one piece, and all of its entries in one task
        held = files(spark, path).select(F.col("path").alias("archive"), "content")
        by = entries.groupBy("archive").agg(F.collect_list(F.struct("member", "at", "packed", "size", "crc", "method")).alias("e"))

        def run_whole(batches):
            for pdf in batches:
                for p, c, e in zip(pdf.archive, pdf.content, pdf.e, strict=True):
                    yield from _texts(((p, *r.values()) for r in e), lambda _: io.BytesIO(c))  # noqa: B023  used up before the next

        return held.join(by, "archive").mapInPandas(run_whole, schema)
    entries = written(entries)
    n = max(1, (entries.agg(F.sum("packed")).first()[0] or 0) // SHARE, min(entries.count(), spark.sparkContext.defaultParallelism))
    entries = entries.repartitionByRange(int(n), "archive", "at").sortWithinPartitions("archive", "at")

    def run(batches):
        yield from _texts((r for pdf in batches for r in pdf.itertuples(index=False, name=None)), opened)

    return entries.mapInPandas(run, schema)


def _texts(entries, source):
    """Frames of texts, about a block of bytes each, from entries in order of their archives."""
    name, f, rows, held = None, None, [], 0
    frame = lambda: pd.DataFrame(rows, columns=["archive", "member", "value"])
    try:
        for archive, member, *place in entries:
            if archive != name:
                if f:
                    f.close()
                name, f = archive, source(archive)
            raw = unpacked(f, *place)
            try:
                if raw is not None:
                    rows.append((archive, member, raw.decode("utf-8")))
                    held += len(raw)
            except UnicodeDecodeError:
                continue
            if held > BLOCK:
                yield frame()
                rows, held = [], 0
        yield frame()
    finally:
        if f:
            f.close()


def shared_folder(spark: SparkSession) -> str:
    """A new folder of this run's own where ``spark.checkpoint.dir`` is; beside it, only a session of one process has another place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def write_archives(df: DataFrame, folder: str, member: str = "member", value: str = "value") -> DataFrame:
    """(archive, members): one zip a partition of ``df`` under ``folder``, written member by member.

    Rows with a null name or value are no members.  A task that is repeated writes another archive; only those returned are whole
    and wanted.
    """
    if not can_open(folder):
        raise ValueError(f"tasks can't write to {folder}")

    def run(batches):
        path, n = f"{folder}/{uuid.uuid4().hex}.zip", 0
        with created(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for pdf in batches:
                for name, text in zip(pdf["m"], pdf["v"], strict=True):
                    z.writestr(name, text)
                    n += 1
        yield pd.DataFrame({"archive": [path], "members": [n]})

    rows = df.select(F.col(member).cast("string").alias("m"), F.col(value).cast("string").alias("v")).where("m is not null and v is not null")
    return written(rows.mapInPandas(run, "archive string, members long"))
