"""The coded particle store: parquet slabs by brick x-plane, with a manifest written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.config import Geometry
from meshtide.functions.lattice import div

SCHEMA = "meshtide-state-1"
ROW = ("bx int, brick int, bucket long, off_x short, off_y short, off_z short, "
       "w_x short, w_y short, w_z short")
MANIFEST = "manifest.json"


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    p, fs = _path(spark, name)
    return fs.exists(p)


def delete(spark: SparkSession, name: str) -> None:
    p, fs = _path(spark, name)
    if fs.exists(p):
        fs.delete(p, True)


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a small document on the job's file system, replacing an older one whole."""
    tmp, fs = _path(spark, name + ".part")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = _path(spark, name)
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(tmp, final):
        raise OSError(f"could not publish {name}")


def read_text(spark: SparkSession, name: str) -> str:
    return "\n".join(r.value for r in spark.read.text(name, wholetext=True).collect())


def _crc(columns: list[str]):
    """Order-free checksum of rows: crc32 of every row, added up."""
    return F.sum(F.crc32(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)))).alias("crc")


def write_state(coded: DataFrame, scales: DataFrame, g: Geometry, where: str, provenance: dict | None = None
                ) -> dict:
    """Write slabs, scales and slab index, then the manifest.  A torn write has no manifest."""
    spark = coded.sparkSession
    delete(spark, f"{where}/{MANIFEST}")
    nb2 = g.bricks**2
    rows = coded.withColumn("bx", div(F.col("brick"), nb2).cast("int"))
    rows = rows.select(F.col("bx"), F.col("brick").cast("int"), F.col("bucket").cast("long"),
                       *(F.col(f"off_{a}").cast("short") for a in "xyz"),
                       *(F.col(f"w_{a}").cast("short") for a in "xyz"))
    # range partitioning splits a crowded slab over several files, each sorted by bucket
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange("bx", "brick", "bucket", "_tie").sortWithinPartitions("bx", "bucket")
    placed.drop("_tie").write.mode("overwrite").partitionBy("bx").parquet(f"{where}/slabs")
    scales.select(F.col("brick").cast("int"), "vel_scale", F.col("n").cast("long")).write.mode(
        "overwrite").parquet(f"{where}/bricks")
    stored = spark.read.parquet(f"{where}/slabs")
    index = stored.groupBy("bx").agg(F.count(F.lit(1)).alias("n"), _crc(_columns()))
    slabs = {int(r.bx): {"n": r.n, "crc": r.crc} for r in index.collect()}  # one row per brick plane
    man = dict(schema=SCHEMA, n_particles=sum(s["n"] for s in slabs.values()), box_size=g.box,
               n_part=g.n_part, bucket_cells=g.bucket_cells, bricks_per_side=g.bricks,
               slabs={str(k): v for k, v in sorted(slabs.items())}, provenance=provenance or {})
    write_text(spark, f"{where}/{MANIFEST}", json.dumps(man, default=float))
    return man


def _columns() -> list[str]:
    return [c.split()[0] for c in ROW.split(", ")][1:]


def try_manifest(spark: SparkSession, where: str) -> dict | None:
    name = f"{where}/{MANIFEST}"
    return json.loads(read_text(spark, name)) if exists(spark, name) else None


def read_manifest(spark: SparkSession, where: str) -> dict:
    man = try_manifest(spark, where)
    if man is None:
        raise FileNotFoundError(f"{where} has no manifest: an incomplete write")
    if man.get("schema") != SCHEMA:
        raise ValueError(f"unknown state schema {man.get('schema')!r}")
    return man


def load_state(spark: SparkSession, where: str, g: Geometry, slabs: tuple[int, int] | None = None,
               verify: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(coded, scales, manifest); ``slabs`` = [lo, hi) prunes to brick x-planes by partition."""
    man = read_manifest(spark, where)
    same = (man["box_size"], man["n_part"], man["bucket_cells"], man["bricks_per_side"])
    if same != (g.box, g.n_part, g.bucket_cells, g.bricks):
        raise ValueError("the state's lattice differs from the run's")
    lo, hi = slabs or (0, g.bricks)
    rows = spark.read.schema(ROW).parquet(f"{where}/slabs")
    rows = rows.filter((F.col("bx") >= lo) & (F.col("bx") < hi))
    scales = spark.read.schema("brick int, vel_scale double, n long").parquet(f"{where}/bricks")
    scales = scales.filter((div(F.col("brick"), g.bricks**2) >= lo) & (div(F.col("brick"), g.bricks**2) < hi))
    if verify:
        got = {int(r.bx): (r.n, r.crc) for r in
               rows.groupBy("bx").agg(F.count(F.lit(1)).alias("n"), _crc(_columns())).collect()}
        want = {int(k): (v["n"], v["crc"]) for k, v in man["slabs"].items() if lo <= int(k) < hi}
        if got != want:
            raise ValueError(f"slabs {sorted(k for k in set(got) | set(want) if got.get(k) != want.get(k))} "
                             "do not match the manifest's counts and checksums")
    wide = [F.col(c).cast("long") for c in _columns()]
    return rows.select(*wide), scales.select(F.col("brick").cast("long"), "vel_scale", "n"), man
