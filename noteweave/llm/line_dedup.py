"""Corpus-wide line dedup over levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents), sorted by hash, in shared storage.
A batch of documents is reduced to such a run of its own; it is anti-joined with the
settled runs (hashes already known to be in `threshold` documents) and what is left is
added at level 0.  When a level has `fanout` runs they are compacted: counts are summed,
hashes that reach the threshold move to a settled run, the others to one run on the next
level.  Only DataFrame functions are used.  Only hashes are shuffled to find frequent
lines; texts move once, to meet the positions of their own lines that go.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, scratch_path

BLANKS = " \t\n\u000b\f\r"
#: Settled hashes are broadcast up to this many rows of 16 bytes; beyond it they are
#: joined by shuffle, with each hash dealt to SALTS tasks.
BROADCAST_ROWS = 400_000
SALTS = 16


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes: together they tell apart as many lines as exist."""
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g")]


@dataclass
class LineRuns:
    """The runs of one corpus; see the module."""

    spark: SparkSession
    path: str
    threshold: int
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    settled: list[str] = field(default_factory=list)
    written: int = 0

    def _name(self) -> str:
        self.written += 1
        return f"{self.path}/run{self.written}"

    def settled_keys(self) -> DataFrame:
        if not self.settled:
            return self.spark.createDataFrame([], "h long, g long")
        return self.spark.read.schema("h long, g long, n long").parquet(*self.settled).select("h", "g")

    def add(self, batch: DataFrame) -> None:
        """Add a batch: rows of h, g and n, one for each distinct line of the batch."""
        if self.settled:
            batch = batch.join(self.settled_keys().hint("merge"), ["h", "g"], "left_anti")
        batch.select("h", "g", "n").sortWithinPartitions("h", "g").write.parquet(name := self._name())
        self._push(0, name)

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._compact(runs, level + 1)

    def _compact(self, runs: list[str], level: int) -> None:
        rows = self.spark.read.schema("h long, g long, n long").parquet(*runs)
        merged = rows.groupBy("h", "g").agg(F.sum("n").alias("n")).withColumn("settled", F.col("n") >= self.threshold)
        merged.sortWithinPartitions("settled", "h", "g").write.partitionBy("settled").parquet(name := self._name())
        for settled, keep in (("true", self.settled.append), ("false", lambda run: self._push(level, run))):
            if self._written(run := f"{name}/settled={settled}"):
                keep(run)

    def _written(self, path: str) -> bool:
        """Whether a compaction wrote rows of a kind: without them there is no folder."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def finish(self) -> DataFrame:
        """Compact all levels into one and return the settled hashes (h, g)."""
        runs = [r for level in self.levels for r in level]
        self.levels = []
        if runs:
            fanout, self.fanout = self.fanout, len(runs) + 2
            self._compact(runs, 0)
            self.fanout = fanout
        return self.settled_keys()


def batch_runs(docs: DataFrame, batches: int, min_chars: int, path: str) -> list[DataFrame]:
    """Distinct line hashes and document counts of each batch, from one scan of docs."""
    keys = F.array_distinct(F.filter(F.transform(text_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars))
    lines = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key"))
    runs = lines.select("batch", *key_hashes(F.col("key"))).groupBy("batch", "h", "g").agg(F.count("*").alias("n"))
    runs.write.partitionBy("batch").parquet(path)
    spark = docs.sparkSession
    schema = "h long, g long, n long, batch int"
    return [spark.read.schema(schema).parquet(path).where(F.col("batch") == b) for b in range(batches)]


def dedup_lines(docs: DataFrame, threshold: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop all lines whose key is in at least `threshold` documents, from every document.

    docs needs doc_id and text; other columns, whatever their names but for the new ones,
    are kept.  A key is the line without ASCII white space at its ends, A-Z lower-cased;
    keys shorter than min_chars code points stay.  A null or empty text is one empty
    line.  Each row is a document of its own, so repeated rows count one by one, also
    with a null doc_id.  An empty table gives an empty table.  Adds n_lines, n_dropped
    and kept_text.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "line-runs")
    store = LineRuns(spark, path, threshold, fanout)
    for batch in batch_runs(docs, batches, min_chars, f"{path}/batches"):
        store.add(batch)
    settled = store.finish()
    text = F.coalesce("text", F.lit(""))
    # Rows that agree in doc_id and text have the same lines, so that pair is key enough.
    row_key = [F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_text")]
    lines = docs.select(*row_key, F.posexplode(F.transform(text_lines(F.col("text")), line_key)).alias("_pos", "_key"))
    lines = lines.select("_id", "_text", "_pos", *key_hashes(F.col("_key")))
    if settled.count() <= BROADCAST_ROWS:
        hits = lines.join(F.broadcast(settled), ["h", "g"], "left_semi")
    else:
        dealt = settled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS)).cast("int"))
        hits = salted.join(dealt, ["h", "g", "salt"], "left_semi")
    gone = hits.groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_gone"))
    rows = docs.withColumn("_row", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text")))
    same = F.col("_row.id").eqNullSafe(F.col("_id")) & (F.col("_row.text") == F.col("_text"))
    joined = rows.join(gone, same, "left").withColumn("_lines", text_lines(F.col("text")))
    n_lines, n_dropped = F.size("_lines"), F.coalesce(F.size("_gone"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda p: F.get(F.col("_lines"), p)), "\n")
    return joined.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(n_dropped).cast("long"),
            "kept_text": F.when(F.col("_gone").isNull(), text).otherwise(kept),
        }
    ).drop("_row", "_id", "_text", "_gone", "_lines")
