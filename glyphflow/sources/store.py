"""Files that tasks write by themselves into a folder all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs

#: Where files of a folder are written before they get their names.
PENDING = "_pending"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; a path without a scheme is a mounted one."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Pending:
    """A file under a name of its own until ``commit`` gives it the final one, in one step.

    An attempt that dies leaves a file below PENDING that nobody reads; one that is repeated puts the same bytes in
    the place of the others.
    """

    def __init__(self, folder: str, name: str, job: str = "") -> None:
        """job: tells the temporary files of jobs apart that write to one folder at a time."""
        self.files, root = store(folder)
        pending = f"{root}/{PENDING}/{job}".rstrip("/")
        self.final, self.temporary = f"{root}/{name}", f"{pending}/{uuid.uuid4().hex}"
        self.files.create_dir(pending, recursive=True)
        self.stream = self.files.open_output_stream(self.temporary, compression=None)
        self.n_bytes = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.files.create_dir(self.final.rpartition("/")[0], recursive=True)
        self.files.move(self.temporary, self.final)

    def abort(self) -> None:
        self.stream.close()
        self.files.delete_file(self.temporary)
