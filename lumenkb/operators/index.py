"""An index of notes that batches keep in step: several tables, which one manifest commits at once.

A batch writes a segment: for each note that it adds or changes the rows of all tables, and a row for each note that it
touches, gone ones too. Nothing reads a segment before a manifest names it, and a manifest appears whole or not at all,
so a reader sees all of a batch or nothing, and what a killed batch has left is never read. A source's batches have
rising numbers; one that is committed already is passed over, so a batch can be run again. Of a note in several segments
the latest counts. Segments are merged when there are many.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenkb.functions.text import indexed, tokens

#: What the tables' rows are made by; a change of ``derive`` must change it, so that older rows count as stale.
MADE_BY = "1"
#: Segments beyond which a batch merges all.
MOST_SEGMENTS = 8

TABLES = {
    "documents": "doc_id long, path string, title string, content_hash string, mtime long, n_tokens int, made_by string",
    "postings": "doc_id long, term string, tf long",
    "links": "doc_id long, pos int, target string",
    "tags": "doc_id long, tag string",
    "sections": "doc_id long, ord int, text_hash string",
}
TOUCHED = "doc_id long, gone boolean"


def derive(notes: DataFrame) -> dict[str, DataFrame]:
    """The rows of every table. ``notes``: doc_id, path, title, tags, links (texts), body, mtime; nulls count as empty.

    A note is found by the words of its title, its tags and its body. Its sections are its lines.
    """
    text = indexed(F.concat_ws("\n", "title", F.array_join("tags", " "), "body"))
    notes = notes.withColumn("_text", text)
    words = tokens(F.col("_text"))
    hashed = F.md5(F.concat_ws("\x1f", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","), F.array_join(F.coalesce("links", F.array().cast("array<string>")), ","), F.coalesce("body", F.lit(""))))
    return {
        "documents": notes.select("doc_id", "path", "title", hashed.alias("content_hash"), "mtime", F.size(words).alias("n_tokens"), F.lit(MADE_BY).alias("made_by")),
        "postings": notes.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")),
        "links": notes.select("doc_id", F.posexplode("links").alias("pos", "target")),
        "tags": notes.select("doc_id", F.explode("tags").alias("tag")).distinct(),
        "sections": notes.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("ord", "line")).select("doc_id", "ord", F.md5("line").alias("text_hash")),
    }


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; the batch can be run again."""


class NoteIndex:
    """The index in a folder that all executors share; doc_id names a note and isn't null."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        path, fs = self._path("manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def state(self) -> dict:
        """The latest manifest: number, segments from old to new (id, seq) and each source's last batch."""
        jvm = self.spark.sparkContext._jvm
        for name in reversed(self._manifests()):
            path, fs = self._path("manifests", name)
            stream = fs.open(path)
            try:
                return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
            except ValueError:
                continue  # its writer was killed before the end
            finally:
                stream.close()
        return {"number": 0, "segments": [], "batches": {}}

    def _commit(self, was: dict, segments: list[dict], batches: dict) -> None:
        """Make the next manifest, unless another one came since ``was``."""
        if self.state()["number"] != was["number"]:
            raise Conflict(f"{self.root} has changed since manifest {was['number']}")
        names = self._manifests()
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        path, fs = self._path("manifests", f"{number:020d}.json")
        java = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if isinstance(e, java.FileAlreadyExistsException) or "AlreadyExists" in str(e):
                raise Conflict(f"{self.root}: manifest {number} is taken") from e
            raise
        stream.write(bytearray(json.dumps({"number": number, "segments": segments, "batches": batches}).encode()))
        stream.close()

    def _write(self, tables: dict[str, DataFrame], touched: DataFrame) -> str:
        name = uuid.uuid4().hex
        for table, df in {**tables, "touched": touched}.items():
            df.write.option("compression", "zstd").parquet(f"{self.root}/segments/{name}/{table}")
        return name

    def _rows(self, state: dict, table: str, schema: str) -> DataFrame:
        """The rows of a table in all segments, with their segment's place."""
        read = lambda s: self.spark.read.schema(schema).parquet(f"{self.root}/segments/{s['id']}/{table}").withColumn("seq", F.lit(s["seq"]))
        segments = [read(s) for s in state["segments"]]
        return reduce(DataFrame.unionByName, segments) if segments else self.spark.createDataFrame([], f"{schema}, seq int")

    def _read(self, state: dict, table: str) -> DataFrame:
        rows = self._rows(state, table, TABLES[table])
        if len(state["segments"]) < 2 and not any(s["gone"] for s in state["segments"]):
            return rows.drop("seq")
        last = self._rows(state, "touched", TOUCHED).groupBy("doc_id").agg(F.max(F.struct("seq", "gone")).alias("x"))
        return rows.join(last.where("not x.gone").select("doc_id", F.col("x.seq").alias("seq")), ["doc_id", "seq"], "left_semi").drop("seq")

    def read(self, table: str) -> DataFrame:
        """A table's rows as of the latest manifest; later batches don't change what it reads."""
        return self._read(self.state(), table)

    def apply(self, source: str, number: int, changed: DataFrame, deleted: DataFrame | None = None) -> bool:
        """Commit a batch: notes that are new or ``changed`` (see ``derive``), and the doc_id of ``deleted`` ones.

        False if the source's batch of that number, or a later one, is committed already. A note that is both changed
        and deleted stays. A doc_id must not repeat within ``changed``.
        """
        was = self.state()
        if number <= was["batches"].get(source, -1):
            return False
        touched = changed.select("doc_id", F.lit(False).alias("gone"))
        if deleted is not None:
            touched = touched.unionByName(deleted.select("doc_id", F.lit(True).alias("gone"))).groupBy("doc_id").agg(F.min("gone").alias("gone"))
        seq = max([s["seq"] for s in was["segments"]], default=0) + 1
        segments = [*was["segments"], {"id": self._write(derive(changed), touched), "seq": seq, "gone": deleted is not None}]
        self._commit(was, segments, was["batches"] | {source: number})
        if len(segments) > MOST_SEGMENTS:
            self.merge()
        return True

    def merge(self) -> None:
        """Write all that counts as one segment. Readers of older manifests keep theirs until ``clean``."""
        was = self.state()
        tables = {t: self._read(was, t) for t in TABLES}
        name = self._write(tables, tables["documents"].select("doc_id", F.lit(False).alias("gone")))
        self._commit(was, [{"id": name, "seq": max(s["seq"] for s in was["segments"]), "gone": False}], was["batches"])

    def clean(self) -> int:
        """Delete segments that the latest manifest doesn't name; no batch may be running. How many they were."""
        path, fs = self._path("segments")
        keep = {s["id"] for s in self.state()["segments"]}
        old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in keep] if fs.exists(path) else []
        for p in old:
            fs.delete(p, True)
        return len(old)

    def stale(self) -> DataFrame:
        """doc_id of notes whose rows an older ``derive`` has made."""
        return self.read("documents").where(F.col("made_by") != MADE_BY).select("doc_id")

    def repair(self, notes: DataFrame, number: int, budget: int) -> int:
        """Make the rows of at most ``budget`` stale notes anew, the smallest doc_id first; those no longer in ``notes`` go. How many are left."""
        some = self.stale().orderBy("doc_id").limit(budget)
        self.apply("repair", number, notes.join(some, "doc_id", "left_semi"), some.join(notes.select("doc_id"), "doc_id", "left_anti"))
        return self.stale().count()

    def follow(self, stream: DataFrame, source: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply each micro-batch of a stream of notes with ``gone`` (null: false). A batch that runs again after a restart counts once."""

        def batch(df: DataFrame, number: int) -> None:
            gone = F.coalesce("gone", F.lit(False))
            last = df.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "doc_id"]), "mtime").alias("x")).select("doc_id", "x.*")
            self.apply(source, number, last.where(~gone).drop("gone"), last.where(gone).select("doc_id"))

        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).foreachBatch(batch).start()
