"""What the archive sources share: file systems, committed parts and byte ranges.

Tasks write files under names of their own; the driver's commit lists the files of the tasks that succeeded in one
manifest, so what a lost or repeated task has left is never read. Readers plan byte ranges of the listed files, or of
all files with the suffix where there is no manifest.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

MANIFEST = "_manifest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


def part_name(suffix: str) -> str:
    return f"part-{uuid.uuid4().hex}{suffix}"


def commit(folder: str, messages: Iterable[Written | None]) -> None:
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
        out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())


def discard(folder: str, messages: Iterable[Written | None]) -> None:
    system, path = file_system(folder)
    for m in messages:
        for f in m.files if m else ():
            with contextlib.suppress(OSError):
                system.delete_file(f"{path}/{f}")


def ranges(folder: str, suffix: str, split_bytes: int) -> list[ByteRange]:
    system, path = file_system(folder)
    there = {i.base_name: i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File}
    manifests, names = [n for n in there if n.startswith(MANIFEST)], []
    for n in manifests:
        with system.open_input_file(f"{path}/{n}") as f:
            names += json.loads(f.read())
    if not manifests:
        names = sorted(n for n in there if n.endswith(suffix))
    return [ByteRange(n, at, min(at + split_bytes, there[n].size)) for n in names for at in range(0, there[n].size, split_bytes)]
