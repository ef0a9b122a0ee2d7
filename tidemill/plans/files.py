"""Small files in a folder that driver and executors share, by whatever file system its path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self._jvm, self._gateway = context._jvm, context._gateway
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path(path)
        self._conf = context._jsc.hadoopConfiguration()
        self._files = self._path.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(self._path, name)

    def names(self) -> list[str]:
        """Names in the folder, in order; none if it isn't there."""
        if not self._files.exists(self._path):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path))

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file and move it to its name in one step; False, and nothing is changed, if the name is taken."""
        self._files.mkdirs(self._path)
        draft = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(text.encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        # no option to overwrite, so the move fails where the name exists
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = lambda p: p.makeQualified(self._files.getUri(), self._files.getWorkingDirectory())
        try:
            context.rename(qualified(draft), qualified(self._at(name)), options)
            return True
        except Exception as error:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)
