"""Connected components by repeated hooking and contraction, as DataFrame joins.

Each round hooks every node to its least neighbour, follows those pointers to their
roots, and contracts the edges onto the roots; the edge table shrinks every round and
is empty in the end. All aggregates are minima with map-side combining, so a hub node
does not gather its neighbours in one task. Rounds are cut by tables written to the
folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scratch_folder(spark) -> str:
    """``spark.checkpoint.dir``; in local mode, where that setting may be absent, a local folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = getattr(sc, "_tracewright_scratch", None)
    if made is None:
        made = sc._tracewright_scratch = tempfile.mkdtemp(prefix="tracewright-scratch-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def ship_package(spark) -> None:
    """Make this package importable by the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="tracewright-"))
    target = folder / "tracewright_workers.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, str(source.relative_to(package.parent)))
    sc.addPyFile(str(target))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._tracewright_shipped = True


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the scratch folder once and read it back without its lineage."""
    path = f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, label: str) -> DataFrame:
    """``cut`` for large tables: compressed well, and the shuffle files that made it go before the next step."""
    out = cut(df, label, compression="zstd")
    forget(df.sparkSession)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`cut` made, once nothing reads it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def forget(spark) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge; component is the least node reachable.

    Null endpoints and self-loops link nothing; a node with only a self-loop still is its
    own component. Repeated edges count once.
    """
    pair = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = pair.where("a = b").select(F.col("a").alias("node")).distinct()
    links = cut(pair.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping: DataFrame | None = None
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        before = links
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "hooks")
        for _ in range(max_rounds):  # pointer jumping halves the depth each time
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = up.join(step, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            jumped = cut(jumped, "jumps")
            discard(up)
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "root")
            if not moved:
                break
        else:
            raise RuntimeError(f"pointers still move after {max_rounds} rounds")
        left, right = up.toDF("a", "ra"), up.toDF("b", "rb")
        onto = links.join(left, "a").join(right, "b").where("ra <> rb")
        links = cut(onto.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(before)
        if mapping is None:
            mapping = up
        else:
            over, old = up.toDF("root", "above"), mapping
            mapping = cut(mapping.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            discard(old)
            discard(up)
    else:
        if not links.isEmpty():
            raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    alone = loops.select("node", F.col("node").alias("component"))
    if mapping is None:
        return alone
    found = mapping.select("node", F.col("root").alias("component"))
    return found.unionAll(alone.join(found.select("node"), "node", "left_anti"))
