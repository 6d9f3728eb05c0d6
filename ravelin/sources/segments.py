"""Stored tables that change: numbered versions, rows replaced and deleted by id, and an index that follows its files.

A version is a small JSON file that names the Parquet folders it is made of. It is created only if no
other writer has created that number, so two writers never lose each other's work, and what a
version names is never changed: a reader that has opened one sees it to the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType
from pyspark.sql.window import Window

from ravelin.functions.text import tokens
from ravelin.operators import retrieval as R


class Versions:
    """The versions of a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()[1:-5]) for x in self._fs.listStatus(folder) if x.getPath().getName().endswith(".json"))

    def read(self, number: int | None = None) -> dict | None:
        """A version, the last whole one by default; None if there is none."""
        for n in [number] if number is not None else reversed(self.numbers()):
            stream = self._fs.open(self._fs_path(self._file(n)))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):  # else its writer has not finished
                return json.loads(text) | {"version": n}
        return None

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/v{number:09d}.json"

    def publish(self, change: Callable[[dict | None], dict]) -> dict:
        """The next version, change() of the last one; tried again on what another writer has published meanwhile."""
        while True:
            last, numbers = self.read(), self.numbers()
            made = change(last)
            number = (numbers[-1] if numbers else 0) + 1
            try:
                out = self._fs.create(self._fs_path(self._file(number)), False)
            except Exception as e:  # only a version of this number is another writer's
                if not self._fs.exists(self._fs_path(self._file(number))):
                    raise
                del e
                continue
            try:
                out.write(bytearray((json.dumps({k: v for k, v in made.items() if k != "version"}) + "\n").encode()))
            finally:
                out.close()
            return made | {"version": number}

    def fresh(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def partitions(self, folder: str, by: str) -> list[int]:
        """The numbers of a folder's partitions by a column."""
        p = self._fs_path(folder)
        return sorted(int(x.getPath().getName().split("=")[1]) for x in self._fs.listStatus(p) if x.getPath().getName().startswith(f"{by}="))

    def sweep(self, keep: int = 1) -> int:
        """Delete all folders and versions that none of the last versions names; how many. No reader may be on an older one."""
        numbers = self.numbers()
        held = {x for n in numbers[-keep:] for x in _folders(self.read(n) or {})}
        gone = [f"{self.path}/{x.getPath().getName()}" for x in self._fs.listStatus(self._fs_path(self.path)) if x.getPath().getName() != "versions"]
        gone = [x for x in gone if x not in held] + [self._file(n) for n in numbers[:-keep]]
        return sum(self._fs.delete(self._fs_path(x), True) for x in gone)


def _folders(x) -> list[str]:
    if isinstance(x, dict):
        return [f for y in x.values() for f in _folders(y)]
    if isinstance(x, list):
        return [f for y in x for f in _folders(y)]
    return [x] if isinstance(x, str) else []


class Segments:
    """A table of rows by id. Rows lie in buckets by the hash of their id; each write is a segment of the buckets that it touches.

    In a bucket of one segment rows are read as they are; in others the last segment that has an id
    wins, and a row marked as deleted hides it. A bucket of more than most segments is merged into one by
    the write that finds it so; no other bucket is read or written.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, most: int = 4):
        self.versions, self.spark, self.key, self.buckets, self.most = Versions(spark, path), spark, key, buckets, most

    def _bucket(self, state: dict | None) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(state["buckets"] if state else self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        folder = self.versions.fresh("segment")
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        return folder, self.versions.partitions(folder, "_bucket")

    def _append(self, rows: DataFrame, deleted: bool) -> dict:
        state = self.versions.read()
        schema = json.loads(rows.schema.json()) if state is None else state["schema"]
        if state is not None and not deleted:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromJson(schema).fields])
        if state is None and deleted:
            raise ValueError("nothing is stored yet")
        # of rows that share an id one counts, the same one each time
        first = Window.partitionBy(self.key).orderBy(F.xxhash64(*rows.columns).desc())
        one = rows.where(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        folder, touched = self._write(one.withColumns({"_deleted": F.lit(deleted), "_bucket": self._bucket(state)}))
        add = lambda s: {"key": self.key, "buckets": self.buckets, "schema": schema, "segments": []} | (s or {}) | {"segments": [*(s or {"segments": []})["segments"], {"folder": folder, "buckets": touched}]}
        made = self.versions.publish(add)
        full = [b for b in touched if sum(b in s["buckets"] for s in made["segments"]) > self.most]
        return self.merge(full) if full else made

    def upsert(self, rows: DataFrame) -> dict:
        """Rows replace those of their id or are added. Rows without an id are left out."""
        return self._append(rows, False)

    def delete(self, ids: DataFrame) -> dict:
        """Rows of ids(key) go; ids that are not stored do nothing."""
        return self._append(ids.select(self.key), True)

    def _rows(self, state: dict, only: list[int] | None = None) -> DataFrame:
        """All stored rows of the buckets, those hidden left out, with _bucket."""
        schema = StructType.fromJson(state["schema"]).add("_deleted", BooleanType()).add("_bucket", IntegerType())
        count: dict[int, int] = {}
        for s in state["segments"]:
            for b in s["buckets"]:
                count[b] = count.get(b, 0) + 1
        parts: dict[bool, DataFrame | None] = {False: None, True: None}
        for n, s in enumerate(state["segments"]):
            for several in (False, True):
                own = [b for b in s["buckets"] if (count[b] > 1) == several and (only is None or b in only)]
                if own:
                    rows = self.spark.read.schema(schema).parquet(s["folder"]).where(F.col("_bucket").isin(own)).withColumn("_seq", F.lit(n))
                    parts[several] = rows if parts[several] is None else parts[several].unionByName(rows)
        names = [f.name for f in schema.fields]
        if parts[True] is not None:
            last = Window.partitionBy("_bucket", self.key).orderBy(F.desc("_seq"))
            parts[True] = parts[True].withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        found = [x for x in parts.values() if x is not None] or [self.spark.createDataFrame([], schema).withColumn("_seq", F.lit(0))]
        out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return out.where(~F.col("_deleted")).select(*names)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        state = self.versions.read(version)
        if state is None:
            raise FileNotFoundError(f"nothing is stored at {self.versions.path}")
        return self._rows(state).drop("_deleted", "_bucket")

    def merge(self, buckets: list[int]) -> dict:
        """The segments of these buckets become one. Left undone if another writer has merged one of them meanwhile; what was added meanwhile stays behind it."""
        state = self.versions.read()
        folder, touched = self._write(self._rows(state, buckets))
        merged = [s["folder"] for s in state["segments"]]

        def change(now: dict) -> dict:
            names = [s["folder"] for s in now["segments"]]
            before = {s["folder"]: s["buckets"] for s in state["segments"]}
            if names[: len(merged)] != merged or any(set(buckets) & set(before[s["folder"]]) != set(buckets) & set(s["buckets"]) for s in now["segments"][: len(merged)]):
                return now
            left = [s | {"buckets": [b for b in s["buckets"] if b not in buckets]} for s in now["segments"][: len(merged)]]
            return now | {"segments": [s for s in left if s["buckets"]] + [{"folder": folder, "buckets": touched}] + now["segments"][len(merged) :]}

        return self.versions.publish(change)


class FileIndex:
    """The BM25 index of a folder of Parquet files, in generations: a refresh reads the files that are new or have changed, and no other.

    Every generation keeps the terms of chunks and the numbers of documents by file, so what a file has added can be
    taken off again. Document frequencies of all files, their number of rows and of words are sums
    that a refresh adds to and takes from. Rows of files that have gone are filtered out until generations are merged.
    """

    def __init__(self, spark: SparkSession, path: str, files: str, select: Callable[[DataFrame], DataFrame], tokenize: Callable[[Column], Column] = tokens, most: int = 8):
        """select turns the rows of files into (chunk_id, pos, text[, ...])."""
        self.versions, self.spark, self.files, self.select, self.tokenize, self.most = Versions(spark, path), spark, files, select, tokenize, most

    def _listing(self) -> DataFrame:
        """(path, mtime, length) of the present files; their contents are not read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.files)
        return found.select("path", F.col("modificationTime").cast("double").alias("mtime"), "length").withColumn("file", F.xxhash64("path", "mtime", "length"))

    def _open(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(folder)

    def _live(self, generations: list[dict], what: str, files: DataFrame) -> DataFrame:
        """A table of all generations without the rows of files that are no more."""
        out = None
        for g in generations:
            rows = self._open(f"{g['folder']}/{what}")
            rows = rows if not g["stale"] else rows.join(files.where(F.col("generation") == g["folder"]).select("file"), "file", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return out

    def refresh(self) -> dict:
        """Bring the index up to its files; the version, with the numbers of files read and gone."""
        state = self.versions.read()
        known = self._open(state["files"]) if state else self.spark.createDataFrame([], "path string, mtime double, length long, file long, generation string")
        listing = self.versions.fresh("listing")
        self._listing().write.parquet(listing)  # as it was at one time
        now = self._open(listing)
        new = [r.path for r in now.join(known.select("file"), "file", "left_anti").select("path").collect()]  # Spark's reader holds the paths it reads on the driver as well
        gone = known.join(now.select("file"), "file", "left_anti")
        n_gone = gone.count()
        if state and not new and not n_gone:
            return state | {"read": 0, "gone": 0}
        state = state or {"generations": [], "n": 0, "words": 0}
        folder = self.versions.fresh("generation")
        generations = [g | {"stale": g["stale"] or bool(n_gone)} for g in state["generations"]]
        parts = []
        if new:
            named = now.select(F.col("path"), "file")
            rows = self.spark.read.parquet(*new)
            own = self.select(rows.withColumn("_path", F.col("_metadata.file_path"))) if "_path" not in rows.columns else None
            if own is None or "_path" not in own.columns:
                raise ValueError("select must keep the column _path, which files must not have")
            plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  listings and scans spell local paths differently
            own = own.join(named.select(plain(F.col("path")).alias("_p"), "file"), plain(F.col("_path")) == F.col("_p")).drop("_path", "_p")
            R.counted(own, self.tokenize).write.parquet(f"{folder}/docs")
            R.seen_terms(self._open(f"{folder}/docs"), "file").write.parquet(f"{folder}/terms")
            generations = [*generations, {"folder": folder, "stale": False}]
            parts.append(self._open(f"{folder}/terms").select("term", "df"))
        files = self.versions.fresh("files")
        known.join(now.select("file"), "file", "left_semi").unionByName(now.join(known.select("file"), "file", "left_anti").withColumn("generation", F.lit(folder))).write.parquet(files)
        dead_sizes = None
        if n_gone:
            for g in state["generations"]:
                lost = gone.where(F.col("generation") == g["folder"]).select("file")
                parts.append(self._open(f"{g['folder']}/terms").join(lost, "file", "left_semi").select("term", (-F.col("df")).alias("df")))
                sizes = self._open(f"{g['folder']}/docs").join(lost, "file", "left_semi").select("dl")
                dead_sizes = sizes if dead_sizes is None else dead_sizes.unionByName(sizes)
        if "df" in state:
            parts.append(self._open(state["df"]).select("term", "df"))
        total = parts[0]
        for x in parts[1:]:
            total = total.unionByName(x)
        count = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first() if d is not None else None
        more, less = count(self._open(f"{folder}/docs")) if new else None, count(dead_sizes)
        n = state["n"] + (more.n if more else 0) - (less.n if less else 0)
        words = state["words"] + (more.words if more else 0) - (less.words if less else 0)
        df = self.versions.fresh("df")
        total.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(df)
        mean = self._open(df).agg(F.avg(R.raw_idf(F.lit(n), F.col("df")))).first()[0]
        if len(generations) > self.most:
            generations = [self._merged(generations, self._open(files), files := self.versions.fresh("files"))]
        made = {"files": files, "df": df, "n": n, "words": words, "mean_idf": mean, "generations": generations}
        base = state.get("version")

        def change(last: dict | None) -> dict:
            if (last or {}).get("version") != base:
                raise RuntimeError("another writer has refreshed the index meanwhile; refresh again")
            return made

        return self.versions.publish(change) | {"read": len(new), "gone": n_gone}

    def _merged(self, generations: list[dict], files: DataFrame, into: str) -> dict:
        """One generation of what is live in all; nothing is tokenised again. The files are written anew under it."""
        folder = self.versions.fresh("generation")
        for what in ("docs", "terms"):
            self._live(generations, what, files).write.parquet(f"{folder}/{what}")
        files.withColumn("generation", F.lit(folder)).write.parquet(into)
        return {"folder": folder, "stale": False}

    def index(self, version: int | None = None) -> R.Index:
        """The index of a version for R.bm25() and what else searches one."""
        state = self.versions.read(version)
        if state is None or not state["generations"]:
            raise FileNotFoundError(f"no index at {self.versions.path}")
        files = self._open(state["files"])
        stats = self.spark.range(1).select(F.lit(state["n"]).cast("long").alias("n"), F.lit(state["words"] / state["n"] if state["n"] else None).cast("double").alias("avgdl"), F.lit(state["mean_idf"]).cast("double").alias("mean_idf"))
        raw = R.raw_idf(F.lit(state["n"]), F.col("df"))
        idf = self._open(state["df"]).select("term", "df", F.when(raw >= 0, raw).otherwise(R.EPSILON * F.lit(state["mean_idf"])).alias("idf"))
        return R.Index(self._live(state["generations"], "docs", files).drop("file"), idf, stats, self.tokenize)
