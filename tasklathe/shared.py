"""Tables in the shared folder, used where lineage is cut.

The folder is the one the session names in ``spark.checkpoint.dir`` (or, without
it, the one its context was given by ``setCheckpointDir``).  Only a
session on a local master that names none gets a temporary folder of its own
(tests); on a cluster a missing setting is an error, because a machine-local
folder would not outlive the machine.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors share."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tasklathe-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    It cuts the lineage like ``checkpoint()`` does, but column-wise and
    compressed, so that a lost executor costs a re-read and not a recompute.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_own(spark: SparkSession) -> None:
    """Delete all tables this application wrote to the shared folder; results still to be read from them are lost."""
    drop_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; of several writers of one path, all but one get FileExistsError.

    It is written aside and then put in place in one step that fails where the
    path exists: a hard link on a local or mounted file system, elsewhere the
    rename of the file system (which must refuse an existing target, as that of
    HDFS does).
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(temp.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            raise
        except OSError:  # no links here: create the file itself, which must not exist
            with open(target.toUri().getPath(), "x") as f:
                f.write(text)
        finally:
            fs.delete(temp, False)
    elif fs.exists(target) or not fs.rename(temp, target):
        fs.delete(temp, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
