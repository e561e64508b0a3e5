"""Line dedup: levelled sorted runs of line hashes (native DataFrame code throughout).

The index is a folder of runs and a manifest.  A run is a Parquet table (key, total), bucketed by key and sorted by key in every bucket:
the 128-bit hash of a line's key, and the number of documents that hold it, of that run's batches and all before.  Each new
batch merge-anti-joins the runs: its keys, counted before their one shuffle, meet the buckets in order, without the runs being shuffled or
sorted again; keys that earlier batches have settled (total of min_docs or more) drop out, and the others go into the batch's own run, at
level 0, with their new totals.  When a level has FANOUT runs they are compacted into one run of the next level, bucket
by bucket, so there are O(FANOUT * log batches) runs and a key is rewritten O(log batches) times.  The hot keys are
those with a total of min_docs or more in some run; each is in one run only.

The manifest names the runs and the batches in them, and is replaced after each batch as a whole: runs are opened again
from it after a restart, a batch that it names changes nothing when it is added again, and what a lost driver left beside it is deleted.
One driver at a time may add to a folder.

A line's key is the line with white space stripped at both ends and A-Z lower-cased.  `dedup` adds all documents, in batches, and then
drops the lines of hot keys in every document; `dedup_batch` adds one new batch and drops its lines that are hot by then.

Hot lines: a document's keys are made distinct inside its row, counts are aggregated before the shuffle, and the join
on keys moves only (key, document, place) rows, where adaptive execution splits a hot key; texts move once, by document, and are cut
at the places of their hot lines, in linear time.

Edge cases: a null or empty text is one empty line; keys shorter than `min_chars` code points are never hot; repeated
rows are documents of their own and are treated alike; empty tables give empty results; other columns pass through.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, aside, drop_path, file_names, let, new_path, restored, strip_white, write_text, written

FANOUT = 4


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(strip_white(line))


def key_hash(line: Column, min_chars: int) -> Column:
    """16 bytes; null for a key that is too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


class LineRuns:
    """The levelled runs in a folder, new or opened again; a key is hot from min_docs documents on."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 2, fanout: int = FANOUT):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # buckets of one file are known to be sorted
        manifests = sorted(int(x[9:-5]) for x in file_names(spark, self.path) if x.startswith("manifest-") and x.endswith(".json"))
        if manifests:
            text = spark.read.text(f"{self.path}/manifest-{manifests[-1]}.json", wholetext=True).head()[0]
            self.state = json.loads(text)
        else:
            self.state = {"version": 0, "min_docs": min_docs, "fanout": fanout, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [], "batches": []}
        if self.state["min_docs"] != min_docs:
            raise ValueError(f"these runs count up to {self.state['min_docs']} documents, not {min_docs}")
        for level in (x for x in file_names(spark, self.path) if x.startswith("level-")):
            for run in file_names(spark, f"{self.path}/{level}"):
                if f"{level}/{run}" not in self.runs:
                    drop_path(spark, f"{self.path}/{level}/{run}")

    @property
    def runs(self) -> list[str]:
        return [run for level in self.state["levels"] for run in level]

    def _name(self, run: str) -> str:
        return "line_runs_" + run.rpartition("/")[2].replace("-", "_")

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed and sorted table of the session's catalog, which is made from the folder where it isn't known."""
        buckets = f"USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.state['buckets']} BUCKETS"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(run)} (key BINARY, total BIGINT) {buckets} LOCATION '{self.path}/{run}'")
        return self.spark.table(self._name(run))

    def _write(self, rows: DataFrame, level: int) -> str:
        run = f"level-{level}/{uuid.uuid4()}"
        self.table(run)
        rows.select("key", "total").repartition(self.state["buckets"], "key").write.insertInto(self._name(run))
        self.spark.catalog.refreshTable(self._name(run))
        return run

    def _forget(self, runs: list[str], files: bool) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            if files:
                drop_path(self.spark, f"{self.path}/{run}")

    def added(self, counts: DataFrame) -> DataFrame:
        """(key, total) of a batch's keys that are not settled yet; counts(key, n): one merge join for each run."""
        rows, before = counts, F.lit(0).cast("long")
        for k, run in enumerate(self.runs):
            rows = rows.join(self.table(run).withColumnRenamed("total", f"t{k}").hint("merge"), "key", "left")
            before = F.greatest(before, F.coalesce(F.col(f"t{k}"), F.lit(0).cast("long")))
        return rows.select("key", (before + F.col("n")).alias("total"), before.alias("before")).where(F.col("before") < self.state["min_docs"])

    def add(self, keyed: DataFrame, batch_id: str) -> None:
        """Add a batch of documents, with_keys(); nothing happens if it has been added before."""
        if batch_id in self.state["batches"]:
            return
        keys = keyed.select(F.explode(F.array_compact(F.array_distinct("keys"))).alias("key"))
        run = self._write(self.added(keys.groupBy("key").agg(F.count("*").alias("n"))), 0)
        levels, gone = [list(x) for x in self.state["levels"]], []
        for level in range(len(levels) + 1):
            levels += [[]] * (level == len(levels))
            levels[level].append(run)
            if len(levels[level]) < self.state["fanout"]:
                break
            gone += levels[level]
            levels[level] = []
            whole = f"{self._name(run)}_level"
            run = self._write(self.compacted(level, whole), level + 1)
            self.spark.sql(f"DROP TABLE {whole}")
        self.state = self.state | {"version": self.state["version"] + 1, "levels": levels, "batches": [*self.state["batches"], batch_id]}
        write_text(self.spark, f"{self.path}/manifest-{self.state['version']}.json", json.dumps(self.state))
        self._forget(gone, files=True)

    def compacted(self, level: int, name: str) -> DataFrame:
        """The last total of each key of a level, whose runs are read as one table, bucket by bucket: nothing is shuffled."""
        buckets = f"USING parquet OPTIONS (recursiveFileLookup 'true') CLUSTERED BY (key) INTO {self.state['buckets']} BUCKETS"
        self.spark.sql(f"CREATE TABLE {name} (key BINARY, total BIGINT) {buckets} LOCATION '{self.path}/level-{level}'")
        return self.spark.table(name).groupBy("key").agg(F.max("total").alias("total"))

    def hot(self) -> DataFrame:
        """(key) of all hot keys, written, so that a join with them can be split at a hot key."""
        rows = self.spark.createDataFrame([], "key binary, total bigint")
        for run in self.runs:
            rows = rows.unionByName(self.table(run))
        return written(rows.where(F.col("total") >= self.state["min_docs"]).select("key"), "hot-keys")

    def close(self, delete: bool = False) -> None:
        """Take the runs out of the session's catalog; the files stay unless they are to be deleted."""
        self._forget(self.runs, files=False)
        if delete:
            drop_path(self.spark, self.path)


def text_sum(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def with_keys(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 1, batches: int = 1) -> DataFrame:
    """id, sum (the text's hash), the key of each line, and a batch number: all that is counted, without the texts; written once, read for every step."""
    keys = F.transform(lines_of(F.col(text)), lambda x: key_hash(x, min_chars))
    rows = docs.select(F.col(id_col).alias("id"), text_sum(text).alias("sum"), keys.alias("keys"), F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch"))
    path = new_path(docs.sparkSession, "line-keys")
    rows.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def drop_hot_lines(docs: DataFrame, keyed: DataFrame, hot: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with columns n_lines, n_dropped and kept_text: lines whose key is in hot(key) are gone; keyed is with_keys(docs)."""
    docs = docs.withColumns({"__id": F.col(id_col), "__sum": text_sum(text)})
    lines = keyed.select("id", "sum", F.posexplode("keys").alias("at", "key")).where(F.col("key").isNotNull())
    hits = lines.join(hot, "key", "left_semi").groupBy("id", "sum").agg(F.array_sort(F.collect_set("at")).alias("__at"))
    hits = hits.select(F.col("id").alias("__hid"), F.col("sum").alias("__hsum"), "__at")
    out = docs.join(hits, F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__sum") == F.col("__hsum")), "left")

    def between(v: Column) -> Column:
        """The lines between the places that go, each stretch in one slice."""
        edges = F.concat(F.array(F.lit(-1)), v["at"], F.array(F.size(v["lines"])))
        stretch = lambda e: F.flatten(F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda a, k: F.slice(v["lines"], a + 2, F.get(e, k + 1) - a - 1)))
        return F.when(v["at"].isNull(), v["lines"]).otherwise(let(edges, stretch))

    found = let(F.struct(lines_of(F.col(text)).alias("lines"), F.col("__at").alias("at")), lambda v: F.struct(F.size(v["lines"]).cast("long").alias("n"), F.array_join(between(v), "\n").alias("kept")))
    out = out.withColumn("__found", found)
    out = out.withColumns({"n_lines": F.col("__found.n"), "n_dropped": F.coalesce(F.size("__at"), F.lit(0)).cast("long"), "kept_text": F.col("__found.kept")})
    return out.drop("__id", "__sum", "__hid", "__hsum", "__at", "__found")


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = FANOUT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Two passes over all documents: every document goes into the runs, in `batches` batches, then hot lines are dropped."""
    runs = LineRuns(docs.sparkSession, new_path(docs.sparkSession, "line-runs"), min_docs)
    keyed = with_keys(docs, id_col, text, min_chars, batches)
    for i in range(batches):  # the batches together are all documents
        runs.add(keyed.where(F.col("batch") == i), str(i))
    hot = runs.hot()
    runs.close(delete=True)
    return drop_hot_lines(docs, keyed, hot, id_col, text)


def remove_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """dedup() in place: docs with all their columns, hot lines gone from the text."""
    rows, names = aside(docs)
    out = dedup(rows, min_docs, min_chars, id_col=names[id_col], text=names[text])
    return restored(out.withColumn(names[text], F.col("kept_text")), names)


def dedup_batch(runs: LineRuns, batch: DataFrame, batch_id: str, min_chars: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One step of a stream: the batch merge-anti-joins the runs and adds its own; then its lines that are hot by now go.

    A batch that is given again adds nothing, and has the lines dropped that are hot by then.
    """
    keyed = with_keys(batch, id_col, text, min_chars)
    runs.add(keyed, batch_id)
    return drop_hot_lines(batch, keyed, runs.hot(), id_col, text)
