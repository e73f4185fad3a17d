"""Tables kept between sessions: retrieval index, selection cache, runs, import sessions, judged queries.

Every table is a folder of versions; a write makes a new version and then
writes the pointer CURRENT anew, so readers never see half a table or none and a
table can be rewritten from itself. Files go through Hadoop's file system, so any
storage that Spark reads will do.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.retrieval import bm25_terms


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        """Whole or not at all: each value is a file of its own, named by number, and a rename that finds no such file makes it appear at once. The greatest number holds; older ones go afterwards."""
        folder = self.Path(f"{path}.d")
        self.fs.mkdirs(folder)
        side = self.Path(f"{path}.d/_{uuid.uuid4().hex}")
        out = self.fs.create(side, True)
        out.write(bytearray(text.encode()))
        out.close()
        numbers = self._numbers(path)
        n = max(numbers, default=0) + 1
        while not self.fs.rename(side, self.Path(f"{path}.d/{n:012d}")):
            n += 1
        for old in sorted(numbers)[:-1]:
            self.fs.delete(self.Path(f"{path}.d/{old:012d}"), False)

    def _numbers(self, path: str) -> list[int]:
        folder = self.Path(f"{path}.d")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return [int(n) for n in names if n.isdigit()]

    def _get(self, path: str) -> str | None:
        numbers = self._numbers(path)
        if not numbers:
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{path}.d/{max(numbers):012d}").collect())

    def current(self, name: str) -> str | None:
        version = self._get(f"{self.root}/{name}/CURRENT")
        return f"{self.root}/{name}/{version.strip()}" if version else None

    def within(self, path: str) -> bool:
        """Whether a path lies inside the root, whatever dots it has."""
        root, asked = (self.fs.makeQualified(self.Path(p)).toUri().normalize().getPath().rstrip("/") for p in (self.root, path))
        return asked == root or asked.startswith(root + "/")

    def write(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        version = f"v{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(partition) if partition else df.write
        writer.parquet(f"{self.root}/{name}/{version}")
        self._put(f"{self.root}/{name}/CURRENT", version)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to the current version; readers see a write's files when it commits."""
        where = self.current(name)
        if where is None:
            self.write(name, df)
        else:
            df.write.mode("append").parquet(where)

    def read(self, name: str) -> DataFrame | None:
        where = self.current(name)
        return self.spark.read.parquet(where) if where else None

    def clear(self, name: str = "") -> None:
        self.fs.delete(self.Path(f"{self.root}/{name}" if name else self.root), True)


class RetrievalIndex:
    """Postings, document lengths, idf and vectors by section, fresh as long as the fingerprint stands."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def fingerprint(self, corpus: DataFrame, parameters: str) -> str:
        """Of the corpus' content in any order, and of the parameters."""
        row = corpus.select(F.xxhash64(*corpus.columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).collect()[0]
        return f"{row.s}:{row.n}:{parameters}"

    def is_fresh(self, fingerprint: str) -> bool:
        return self.tables._get(f"{self.tables.root}/INDEX") == fingerprint

    def build(self, corpus: DataFrame, fingerprint: str, terms: str = "tokens") -> None:
        idf, stats = bm25_terms(corpus, terms)
        postings = corpus.select("section", "doc_id", F.explode(terms).alias("term")).groupBy("section", "term", "doc_id").agg(F.count("*").alias("tf"))
        self.tables.write("postings", postings.repartition("section").sortWithinPartitions("section", "term"), "section")
        self.tables.write("documents", corpus.select("section", "doc_id", F.size(terms).alias("dl")), "section")
        self.tables.write("idf", idf.join(stats, "section"), "section")
        if "embedding" in corpus.columns:
            self.tables.write("vectors", corpus.select("section", "doc_id", "embedding"), "section")
        self.tables._put(f"{self.tables.root}/INDEX", fingerprint)

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """bm25_scores of the stored corpus: queries (query_id, tokens) meet the postings alone, no text is read."""
        asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        postings, lengths, idf = (self.tables.read(n) for n in ("postings", "documents", "idf"))
        hit = postings.join(asked, "term").join(idf.select("section", "term", "idf", "avgdl"), ["section", "term"]).join(lengths, ["section", "doc_id"])
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return hit.groupBy("query_id", "section", "doc_id").agg(F.sum(part * F.col("times")).alias("score"))

    def clear(self) -> None:
        """Index and cached selections."""
        self.tables.clear()


class SelectionCache:
    """Results by key, with a time to live (none at 0 or less); what can't be read is a miss."""

    def __init__(self, tables: Tables, hours: float = 24.0):
        self.tables, self.hours = tables, hours

    def get(self, key: str, now: float | None = None) -> DataFrame | None:
        try:
            where = self.tables.current(f"cache/{key}")
            if where is None:
                return None
            age = (now or time.time()) - self.tables.fs.getFileStatus(self.tables.Path(where)).getModificationTime() / 1000
            return None if 0 < self.hours * 3600 < age else self.tables.spark.read.parquet(where)
        except Exception:  # a broken entry is built again
            return None

    def put(self, key: str, df: DataFrame) -> None:
        self.tables.write(f"cache/{key}", df)

    def clear(self) -> None:
        self.tables.clear("cache")


class RunTexts:
    """The document of each run, by its id."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def put(self, run_id: str, text: str) -> None:
        row = self.tables.spark.createDataFrame([(run_id, text)], "run_id string, text string")
        old = self.tables.read("run_texts")
        self.tables.write("run_texts", row if old is None else old.where(F.col("run_id") != run_id).unionByName(row), "run_id")

    def get(self, run_id: str) -> str | None:
        all_ = self.tables.read("run_texts")
        found = [] if all_ is None else all_.where(F.col("run_id") == run_id).select("text").collect()
        return found[0].text if found else None

    def delete(self, run_id: str) -> bool:
        all_ = self.tables.read("run_texts")
        if all_ is None or all_.where(F.col("run_id") == run_id).isEmpty():
            return False
        self.tables.write("run_texts", all_.where(F.col("run_id") != run_id), "run_id")
        return True


class Sessions:
    """Import sessions under review: bullets, clusters and resolutions as three tables."""

    NAMES = ("import_bullets", "import_clusters", "import_resolutions")

    def __init__(self, tables: Tables):
        self.tables = tables

    def save(self, session_id: str, bullets: DataFrame, clusters: DataFrame, resolutions: DataFrame) -> None:
        for name, df in zip(self.NAMES, (bullets, clusters, resolutions), strict=True):
            old = self.tables.read(name)
            self.tables.write(name, df if old is None else old.where(F.col("session_id") != session_id).unionByName(df, allowMissingColumns=True))

    def load(self, session_id: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """The three frames of a session; none where it is unknown or can't be read."""
        try:
            found = [self.tables.read(name) for name in self.NAMES]
            if any(df is None for df in found):
                return None
            mine = tuple(df.where(F.col("session_id") == session_id) for df in found)
            return None if mine[0].isEmpty() else mine
        except Exception:  # a session that can't be read is begun again
            return None


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> str | None:
    """The path of the newest matching file below a folder, by its modification time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    return found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).collect()[0].path


def read_runs(spark: SparkSession, path: str, schema: str, aside: str | None = None) -> DataFrame:
    """Runs of JSON files (lists of runs, or single ones). Files that can't be read give none; aside: they are moved there."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    good = F.try_parse_json("value").isNotNull()
    if aside is not None:
        jvm = spark.sparkContext._jvm
        for row in raw.where(~good).select("file").toLocalIterator():
            source = jvm.org.apache.hadoop.fs.Path(row.file)
            fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(aside))
            fs.rename(source, jvm.org.apache.hadoop.fs.Path(f"{aside}/{source.getName()}.bak"))
        raw = spark.read.text(path, wholetext=True)
    # a single run reads as a list of one
    return raw.where(good).select(F.inline(F.from_json("value", T.ArrayType(T.StructType.fromDDL(schema)))))


def read_cases(spark: SparkSession, *folders: str) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, text) and qrels (query_id, doc_id) of JSON case files; none is an error."""
    cases = spark.read.schema("id string, job_description string, relevant_bullets array<string>, note string").json(list(folders), multiLine=True)
    if cases.isEmpty():
        raise FileNotFoundError("no judged cases")
    return cases.select(F.col("id").alias("query_id"), F.col("job_description").alias("text")), cases.select(F.col("id").alias("query_id"), F.explode("relevant_bullets").alias("doc_id"))
