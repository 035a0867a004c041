"""Session settings, table access and code shipping shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that an application should start with; operators never depend on them for right results.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_shipped: set[str] = set()


#: The intermediate tables that are written on the way to the result of the innermost ``tidy`` function.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f``, which makes a DataFrame; of the intermediate tables that it writes only those stay that the DataFrame still reads."""

    @wraps(f)
    def tidied(*args, **kwargs) -> DataFrame:
        own: list[str] = []
        before = _owned.set(own)
        try:
            out = f(*args, **kwargs)
        finally:
            _owned.reset(before)
        read = {part for file in (out.inputFiles() if own else []) for part in file.split("/")}
        kept = [at for at in own if at.rsplit("/", 1)[-1] in read]
        delete(out.sparkSession, [at for at in own if at not in kept])
        if (outer := _owned.get()) is not None:
            outer += kept
        return out

    return tidied


def delete(spark: SparkSession, folders: list[str]) -> None:
    for at in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query that is written go when the query ends, and not only when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(master).config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python operators import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="lumenkb-code-"), "lumenkb.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"lumenkb/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.environ.setdefault("LUMENKB_SHARED", "file://" + tempfile.mkdtemp(prefix="lumenkb-shared-"))
    return at.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a folder in the shared one that nothing else uses."""
    return f"{shared_dir(spark)}/lumenkb/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    at = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(at)
    if (own := _owned.get()) is not None:
        own.append(at)
    return spark.read.schema(df.schema).parquet(at)
