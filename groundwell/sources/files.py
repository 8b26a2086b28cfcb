"""Files fetched once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


def fetch_once(spark: SparkSession, path: str, chunks: Callable[[], Iterable[bytes]]) -> bool:
    """Writes what ``chunks()`` gives to ``path``, unless there is a file already; whether it was written.

    The bytes go to a file beside it that is renamed when it is whole, so that a
    broken download is never taken for a file. How they are got is the caller's.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        return False
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    try:
        for chunk in chunks():
            out.write(bytearray(chunk))
    finally:
        out.close()
    return bool(fs.rename(part, p))
