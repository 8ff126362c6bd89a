"""Helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.session import new_folder

#: The six ASCII white space characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a pattern of Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ARROW_BYTES = 16 << 20


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once under the shared folder and go on from the files.

    What follows reads the files, so a lost executor never repeats the work above.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once everything that reads them is stored itself."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bound what one Arrow batch brings to a Python worker, for tables of very long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (0 is held out); a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def row_bytes(text: str | None) -> bytes:
    """UTF-8 of a text as it came from Spark; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
