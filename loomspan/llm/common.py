"""What the operators share: tables in the shared folder, free names, joins on hot keys, uniform hashes."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.tables import table as table  # for the operators' queries

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than one row in so many; there are at most so many hot keys.
HOT_SHARE = 256

_private: dict[str, str] = {}
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a private one; a cluster is refused, as
    its executors cannot read the driver's folders.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _private.setdefault(app, "") or tempfile.mkdtemp(prefix="loomspan-")
        _private[app] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loomspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = _places.pop(df, None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def yielding(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names an operator's own columns take, whatever their case."""
    own = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in own))


def join_copies(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows joined to keyed (key, once each, how many rows bear it as ``copies``, and more) on key.

    Keys of more than one row in HOT_SHARE, which are fewer than HOT_SHARE, are sent to all
    tasks, so their rows stay where they are; all other keys meet in a shuffle.
    """
    total = keyed.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).collect()[0]["n"]
    is_hot = F.col("copies") * HOT_SHARE > total
    hot = keyed.where(is_hot & (F.col("copies") > 1))
    cold = keyed.where(~(is_hot & (F.col("copies") > 1)))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def uniform(key: Column | str, seed: str) -> Column:
    """A number in [0, 1) from an MD5 of key and seed; the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def slices(spark: SparkSession, factor: int = 4) -> int:
    """Into how many salted slices a hot key is dealt: some for each shuffle partition."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
