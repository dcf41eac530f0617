"""File sources: recursive listing, header profile, checksums."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

AUDIO_GLOB = "*.[wW][aA][vV]"
PROFILE = "path string, samplerate int, channels int, subtype string, frames bigint, duration double, error string"


def list_files(
    spark: SparkSession, root: str, groups: Sequence[str] | None = None, glob: str = AUDIO_GLOB
) -> DataFrame:
    """``path, length`` of every matching file below ``root`` or its group folders.

    A missing folder or an empty result is an error. File content is not read.
    Files of length zero are not listed: Spark skips them.
    """
    roots = [f"{root}/{g}" for g in groups] if groups else [root]
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .load(roots)
            .select("path", "length")
        )
    except AnalysisException as exc:
        raise FileNotFoundError(f"missing folder among {roots}") from exc
    if files.isEmpty():
        raise FileNotFoundError(f"no file matches {glob} under {roots}")
    return files


#: Read of a file at first; a header that goes on is followed chunk by chunk.
HEAD_BYTES = 4096


def wav_header(read: Callable[[int, int], bytes]) -> tuple:
    """Rate, channels, subtype, frames and seconds; ``read(at, n)`` reads a part of the file.

    RIFF chunks are walked up to the audio data; samples are neither read nor decoded.
    """
    head = read(0, HEAD_BYTES)

    def part(at: int, n: int) -> bytes:
        return head[at:at + n] if at + n <= len(head) or len(head) < HEAD_BYTES else read(at, n)

    if part(0, 4) != b"RIFF" or part(8, 4) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while True:
        chunk = part(at, 8)
        if len(chunk) < 8:
            raise ValueError("no audio data chunk")
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", part(at + 8, 16))
        elif name == b"data" and fmt:
            code, channels, rate, _, align, bits = fmt
            kind = {1: "PCM_U8" if bits == 8 else f"PCM_{bits}", 3: "FLOAT" if bits == 32 else "DOUBLE"}
            frames = size // align
            return rate, channels, kind.get(code, f"FORMAT_{code}"), frames, frames / rate
        at += 8 + size + (size & 1)


def _located(place: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path as Spark tells it, with or without a scheme."""
    scheme = place.split("/", 1)[0]
    if not scheme.endswith(":"):
        return fs.LocalFileSystem(), place
    return fs.FileSystem.from_uri(quote(place, safe="/:@"))


def _open(uri: str) -> Callable[[int, int], bytes]:
    """Reader of parts of one file, on any file system that Arrow knows."""
    system, path = _located(uri)
    file = system.open_input_file(path)
    return lambda at, n: file.read_at(n, at)


def header_profile(files: DataFrame, files_per_task: int = 1000) -> DataFrame:
    """Header fields of the files of ``path``; unreadable files carry ``error``.

    A task opens a group of files and reads the first kilobytes of each, whatever their
    length; file content is no column of any table.
    """

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, *wav_header(_open(path)), None))
                except (OSError, ValueError, struct.error, ZeroDivisionError) as exc:
                    rows.append((path, None, None, None, None, None, str(exc)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])

    paths = files.select("path")
    tasks = max(1, -(-paths.count() // files_per_task))
    return paths.repartition(tasks, "path").mapInPandas(profile, PROFILE)


def write_contents(df: DataFrame, root: str) -> int:
    """Write ``content`` to ``root/path`` for every row; how many files. Repeated tasks rewrite the same files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _located(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    written = df.select("path", "content").mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0]
    return int(written or 0)


def checksums(files: DataFrame, key: str, content: str) -> DataFrame:
    return files.select(key, F.sha2(F.col(content), 256).alias("sha256"))
