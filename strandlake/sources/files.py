"""Files by URI, for driver and workers alike."""

from __future__ import annotations

import re

from pyarrow import fs


def system_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def files_of(uri: str) -> list[tuple[str, fs.FileInfo]]:
    """The file, or the files of a folder in order of name, as Spark writes them."""
    system, path = system_of(uri)
    info = system.get_file_info(path)
    if info.type != fs.FileType.Directory:
        return [(uri, info)]
    inside = (i for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name[0] not in "._" and i.size)
    return [(f"{uri.rstrip('/')}/{i.base_name}", i) for i in sorted(inside, key=lambda i: i.base_name)]
