"""Opening files of the shared folder inside tasks, by URI."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) and the path inside it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A new file for writing; folders above it are made."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def open_file(uri: str):
    """A file for reading at any offset."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def names(uri: str, ending: str) -> list[str]:
    """URIs of the files of a folder with an ending, sorted."""
    system, path = filesystem(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f"{uri.rstrip('/')}/{f.base_name}" for f in found if f.is_file and f.base_name.endswith(ending))
