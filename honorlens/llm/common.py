"""Small helpers that the operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table

#: A character outside of ASCII and of some blocks that hold no upper-case letter (Latin-1 marks and small letters,
#: punctuation, kana, CJK ideographs).
MAYBE_UPPER = r"[^\x00-\x7F\u00A0-\u00BF\u00DF-\u00FF\u2000-\u206F\u3040-\u30FF\u4E00-\u9FFF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (the folder can be set with PUBLIC_TOKENIZERS)."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    ship_package(spark)
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(*frames: DataFrame) -> None:
    """Deletes the files of ``staged`` frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "staged_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def lower_ascii(col):
    """A-Z lower-cased, every other character as it is.

    ``lower`` does the same, and is much faster than ``translate``, where there can be no other upper-case character."""
    same = (F.length(col) == F.octet_length(col)) | ~F.rlike(col, F.lit(MAYBE_UPPER))
    return F.when(same, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", columns or None)
