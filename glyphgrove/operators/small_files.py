"""Consolidation of very many small files by byte-level concatenation.

Three steps, each usable alone:

1. :func:`inventory`   listing rows -> one row per file, whatever way its path was written
2. :func:`plan_packs`  every small document of a crowded folder -> one place in one pack
3. :func:`write_packs` append the bytes, and :func:`verify_packs` read them back

Content is never parsed. Newline-delimited members are joined at their boundaries (a missing final
newline is added, byte order marks and repeated header lines after the first member are dropped);
zstandard members are appended as the complete frames they are, because a sequence of frames is a valid
stream. Lengths and checksums of every segment are kept in a manifest and checked after writing.

A folder may hold a third of all files: its files are spread over hash buckets whose number follows from
the folder's total size and number of files, so that no offset window and no writer ever sees more than one bucket.
The join that gives files their folder's number of buckets is one that adaptive execution can split.

Paths without a scheme are places of a file system that all executors share, mounted at one place.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.functions.paths import canonical_path_column
from glyphgrove.runtime import apart, durable, spread

#: Endings of document names.
DOCUMENT_ENDINGS = ("mml", "mathml", "xhtml", "html", "tex")

MANIFEST = "file string, pack string, offset bigint, length bigint, source_length bigint, crc bigint, status string"


def inventory(listing: DataFrame, root: str, *, path: str = "path", size: str = "n_bytes", ident: str = "doc_id") -> DataFrame:
    """One row per file: ``file, folder, name, file_id, n_bytes, n_listings``.

    ``file_id`` is the smallest id of the file's listings. The size is known if any listing has it; should
    listings contradict each other, the largest holds, so that a file is never taken for smaller than it may
    be. Files outside ``root`` and rows without a path are left out. Other columns of ``listing`` are ignored.
    """
    rows = spread(listing.select(ident, size, path), ident).select(F.col(ident).alias("file_id"), F.col(size).cast("bigint").alias("n_bytes"), canonical_path_column(F.col(path), root).alias("file"))
    return (
        rows.filter(F.col("file").startswith(f"{root}/"))
        .groupBy("file")
        .agg(F.min("file_id").alias("file_id"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_listings"))
        .withColumn("name", F.substring_index("file", "/", -1))
        .withColumn("folder", F.expr("left(file, length(file) - length(name) - 1)"))
    )


def is_document(name: Column) -> Column:
    """Whether a file name is one of a document: a known ending, no leading dot or underscore."""
    return F.lower(name).rlike(rf"\.({'|'.join(DOCUMENT_ENDINGS)})\z") & ~name.rlike(r"\A[._]")


def plan_packs(files: DataFrame, *, small_below: int = 8192, least_files: int = 20, target_bytes: int = 256 << 20, packs_per_bucket: int = 8, files_per_bucket: int = 1_000_000) -> DataFrame:
    """Assign every small document of a crowded folder to a pack.

    Result: ``folder, file, file_id, n_bytes, pack, planned_offset``; a file occurs exactly once. Packs end at
    about ``target_bytes`` (one separator byte is reckoned for each member), and a pack holds files of one
    folder only. A folder is crowded if at least ``least_files`` small documents lie directly in it. Files of
    unknown, zero or negative size are not small. A bucket holds about ``packs_per_bucket`` packs or ``files_per_bucket``
    files, whichever is reached first. An empty input gives an empty plan.

    The small documents are kept in the checkpoint folder, so that paths are read once.
    """
    small = files.filter(is_document(F.col("name")) & (F.col("n_bytes") > 0) & (F.col("n_bytes") < small_below))
    small = durable(small.select("folder", "name", "file_id", "n_bytes"))
    buckets = F.greatest(F.ceil(F.col("folder_bytes") / F.lit(target_bytes * packs_per_bucket)), F.ceil(F.col("n_small") / F.lit(files_per_bucket)))
    crowded = (
        small.groupBy("folder")
        .agg(F.count("*").alias("n_small"), F.sum(F.col("n_bytes") + 1).alias("folder_bytes"))
        .filter(F.col("n_small") >= least_files)
        .select("folder", buckets.alias("n_buckets"))
    )
    file = F.concat_ws("/", "folder", "name").alias("file")
    # the shuffle by bucket is explicit: the window could do with the join's partitions, where a hot folder is one task
    placed = small.join(apart(crowded, "folder"), "folder").select("folder", file, "file_id", "n_bytes", F.pmod(F.xxhash64("name"), F.col("n_buckets")).alias("bucket")).repartition("folder", "bucket")
    before = Window.partitionBy("folder", "bucket").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n_bytes") + 1).over(before), F.lit(0))
    return (
        placed.withColumn("start", start)
        .withColumn("seq", F.floor(F.col("start") / F.lit(target_bytes)))
        .select("folder", "file", "file_id", "n_bytes", F.format_string("%s/pack-%05d-%05d", "folder", "bucket", "seq").alias("pack"), F.col("start").alias("planned_offset"))
    )


def zstd_complete(data: bytes) -> bool:
    """Whether ``data`` is a whole number of zstandard frames, judged by headers and block sizes alone."""
    import zstandard

    at = 0
    while at < len(data):
        magic = data[at : at + 4]
        if len(magic) == 4 and magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:  # skippable frame
            if at + 8 > len(data):
                return False
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        try:
            header = zstandard.get_frame_parameters(data[at : at + 18])
            at += zstandard.frame_header_size(data[at : at + 18])
        except zstandard.ZstdError:
            return False
        if header.dict_id:
            return False
        last = False
        while not last:
            block = data[at : at + 3]
            if len(block) < 3:
                return False
            word = int.from_bytes(block, "little")
            last, kind = bool(word & 1), word >> 1 & 3
            if kind == 3:
                return False
            at += 3 + (1 if kind == 1 else word >> 3)
        at += 4 * header.has_checksum
    return at == len(data) and at > 0


class _Joiner:
    """Boundary rules of one pack: what of a member's bytes goes in, and what goes before it."""

    def __init__(self, kind: str, header_lines: int) -> None:
        self.kind, self.header_lines, self.header, self.first = kind, header_lines, b"", True

    def accept(self, data: bytes) -> tuple[bytes, str]:
        if self.kind == "zstd":
            return (data, "ok") if zstd_complete(data) else (b"", "not whole frames")
        if not self.first and data.startswith(b"\xef\xbb\xbf"):
            data = data[3:]
        if data and not data.endswith(b"\n"):
            data += b"\n"
        if self.header_lines:
            at = 0
            for _ in range(self.header_lines):
                at = data.find(b"\n", at) + 1
                if not at:
                    return b"", "header too short"
            head, body = data[:at].replace(b"\r\n", b"\n"), data[at:]
            if self.first:
                self.header = head.removeprefix(b"\xef\xbb\xbf")
            elif head != self.header:
                return b"", "other header"
            else:
                data = body
        self.first = False
        return data, "ok"


def _open_fs(uri: str):
    from pyarrow import fs

    uri = re.sub(r"\Afile:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+]+://", uri) else (fs.LocalFileSystem(), uri)


def _read_bytes(uri: str) -> bytes | None:
    """Content of a file; null if it isn't there or can't be read."""
    try:
        fs, place = _open_fs(uri)
        with fs.open_input_stream(place) as f:
            return f.read()
    except OSError:
        return None


def write_members(docs: DataFrame, target: str, *, folder: str, name: str, content: str) -> DataFrame:
    """Write each row's ``content`` as a file of its own, ``target/folder/name``, and return the listing ``path, n_bytes``.

    Null contents have no file. A repeated attempt writes the same files again. The listing is lazy: write it to make
    the files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(target)
        made: set[str] = set()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.folder not in made:
                    fs.create_dir(f"{base}/{r.folder}", recursive=True)
                    made.add(r.folder)
                data = r.content.encode()
                with fs.open_output_stream(f"{base}/{r.folder}/{r.name}") as f:
                    f.write(data)
                rows.append((f"{base}/{r.folder}/{r.name}", len(data)))
            yield pd.DataFrame(rows, columns=["path", "n_bytes"])

    named = docs.select(F.col(folder).alias("folder"), F.col(name).alias("name"), F.col(content).alias("content")).filter("folder IS NOT NULL AND name IS NOT NULL AND content IS NOT NULL")
    return spread(named, "folder", "name").mapInPandas(write, "path string, n_bytes bigint")


def write_packs(plan: DataFrame, target: str, *, kind: str = "lines", header_lines: int = 0, ending: str = "") -> DataFrame:
    """Write the packs of ``plan`` under the shared folder ``target`` and return their manifest.

    ``kind`` is ``lines`` or ``zstd``. Each pack is written by one task under a name of its attempt and put in
    place by a rename, so a retried task leaves neither a torn nor a doubled pack. A member that can't be
    joined (incomplete frame, other header), that can't be read or whose length is not the planned one keeps its own
    file and gets a status other than ``ok``; no bytes of it are in the pack. The manifest is lazy: write it to make
    the packs.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(target)
        pack = joiner = out = part = None
        offset = 0

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(part, f"{base}{pack}{ending}")

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.pack != pack:
                    close()
                    pack, joiner, offset = r.pack, _Joiner(kind, header_lines), 0
                    part = f"{base}{pack}{ending}.{TaskContext.get().taskAttemptId()}"
                    fs.create_dir(os.path.dirname(part), recursive=True)
                    out = fs.open_output_stream(part)
                raw = _read_bytes(r.file)
                if raw is None:
                    data, status = b"", "not there"
                else:
                    data, status = joiner.accept(raw) if len(raw) == r.n_bytes else (b"", "other length")
                out.write(data)
                rows.append((r.file, pack, offset, len(data), len(raw or b""), zlib.crc32(data), status))
                offset += len(data)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])
        close()

    ordered = plan.select("pack", "planned_offset", "file", "n_bytes").repartition("pack").sortWithinPartitions("pack", "planned_offset")
    return ordered.mapInPandas(write, MANIFEST)


def verify_packs(manifest: DataFrame, target: str, *, ending: str = "") -> DataFrame:
    """Read the packs back: one row per pack with ``length_ok``, ``gapless`` and ``n_bad`` segments.

    Segments are checked where the pack lies, one pack at a time in blocks of its segments.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(target)
        pack, f, end, bad, gapless, n = None, None, 0, 0, True, 0

        def result() -> pd.DataFrame:
            size = fs.get_file_info(f"{base}{pack}{ending}").size
            f.close()
            return pd.DataFrame({"pack": [pack], "n_files": [n], "bytes": [end], "length_ok": [size == end], "gapless": [gapless], "n_bad": [bad]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.pack != pack:
                    if pack is not None:
                        yield result()
                    pack, end, bad, gapless, n = r.pack, 0, 0, True, 0
                    f = fs.open_input_file(f"{base}{pack}{ending}")
                gapless &= r.offset == end
                bad += zlib.crc32(f.read_at(r.length, r.offset)) != r.crc
                end, n = r.offset + r.length, n + 1
        if pack is not None:
            yield result()

    kept = manifest.filter("status = 'ok'").repartition("pack").sortWithinPartitions("pack", "offset")
    return kept.select("pack", "offset", "length", "crc").mapInPandas(check, "pack string, n_files bigint, bytes bigint, length_ok boolean, gapless boolean, n_bad bigint")
