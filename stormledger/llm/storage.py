"""Files that tasks write to and read from the shared folder, through pyarrow's filesystems."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs
from pyspark import TaskContext


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a URI (or local path) and the path in it; Hadoop's names of S3 are S3."""
    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def committed(uri: str) -> Iterator[NativeFile]:
    """A stream whose file appears under ``uri`` only when complete: a repeated task replaces it, a failed one leaves none."""
    store, path = locate(uri)
    task = TaskContext.get()
    draft = f"{path}.{task.taskAttemptId() if task else 0}.draft"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with store.open_output_stream(draft) as out:
            yield out
        store.move(draft, path)
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise


@contextmanager
def reading(uri: str) -> Iterator[NativeFile]:
    store, path = locate(uri)
    with store.open_input_file(path) as f:
        yield f
