"""Audio of reports: data and its description as a pair that is either whole or not there, found by content, dropped by age.

A clip's data goes to data/date=D/sha=S and only then its description to meta/date=D/sha=S, each a Parquet table of a row. A description counts if the
data beside it has its size and checksum; whatever a dead writer left is never current and goes with the next save of the same report, or by
age. Several writers of one pair write the same.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days for which audio is kept, and characters of a text's digest.
KEEP_DAYS, SHA_CHARS = 14, 16
META = "duration double, sections array<struct<title:string,start:double>>, model string, voice string, boundary string"
_KEPT = f"bytes bigint, audio_sha256 string, {META}"


def source_sha(text: Column) -> Column:
    """Digest that ties audio to the text it reads."""
    return F.substring(F.sha2(text, 256), 1, SHA_CHARS)


class AudioStore:
    """Clips in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{folder}"))

    def _dates(self, kind: str) -> list[str]:
        return sorted(f.getPath().getName()[5:] for f in self._fs.listStatus(self._path(f"{self.root}/{kind}")) if f.getPath().getName().startswith("date=")) if self._there(kind) else []

    def _written(self, clips: DataFrame, kind: str) -> None:
        clips.write.partitionBy("date", "sha").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/{kind}")

    def save(self, clips: DataFrame) -> None:
        """Write clips (date string, sha string, audio binary and columns of META), a row a report; those of the same date and digest are replaced.

        Rows without a date, digest or data go. What is beside a clip's date but of another digest is superseded: its description goes first.
        """
        whole = clips.where("date IS NOT NULL AND sha IS NOT NULL AND octet_length(audio) > 0").withColumns({"bytes": F.octet_length("audio").cast("long"), "audio_sha256": F.sha2(F.col("audio"), 256)})
        days = [r.date for r in whole.select("date").distinct().collect()]
        for day in days:
            self._fs.delete(self._path(f"{self.root}/meta/date={day}"), True)
        self._written(whole.select("date", "sha", "audio"), "data")
        self._written(whole.select("date", "sha", *[c.split()[0] for c in _columns(_KEPT)]), "meta")

    def clips(self) -> DataFrame:
        """(date, sha, bytes, audio_sha256, columns of META, audio): pairs that are whole."""
        if not self._dates("meta") or not self._dates("data"):
            return self.spark.createDataFrame([], f"date string, sha string, {_KEPT}, audio binary")
        read = lambda kind, columns: self.spark.read.schema(f"{columns}, date string, sha string").parquet(f"{self.root}/{kind}")
        both = read("meta", _KEPT).join(read("data", "audio binary"), ["date", "sha"])
        return both.where((F.octet_length("audio") == F.col("bytes")) & (F.sha2(F.col("audio"), 256) == F.col("audio_sha256")))

    def wanting(self, reports: DataFrame) -> DataFrame:
        """Reports (date, summary_md, ...) whose text, as it is now, no whole clip reads."""
        named = reports.withColumn("sha", source_sha(F.col("summary_md")))
        return named.join(self.clips().select("date", "sha"), ["date", "sha"], "left_anti").drop("sha")

    def public(self, reports: DataFrame, base: str) -> DataFrame:
        """(date, url, duration, sections, model, voice) for reports with a current clip. Sections are none if one has no start from 0 on; times have
        two digits, an unknown or endless duration is 0."""
        named = reports.select("date", source_sha(F.col("summary_md")).alias("sha"))
        found = named.join(self.clips(), ["date", "sha"])
        good = F.coalesce(F.forall("sections", lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < float("inf")), F.lit(False))), F.lit(False))
        shown = F.transform("sections", lambda s: F.struct(F.coalesce(s["title"], F.lit("")).alias("title"), F.round(s["start"], 2).alias("start")))
        finite = F.coalesce((F.abs("duration") < float("inf")) & ~F.isnan("duration"), F.lit(False))
        url = F.concat(F.lit(f"{base}/audio/"), F.col("date"), F.lit(".mp3?v="), F.substring("sha", 1, 8))
        return found.select("date", url.alias("url"), F.when(finite, F.round("duration", 2)).otherwise(0.0).alias("duration"), F.when(good, shown).otherwise(F.slice(shown, 1, 0)).alias("sections"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("voice", F.lit("")).alias("voice"))

    def prune(self, today: date, keep_days: int = KEEP_DAYS) -> list[str]:
        """Delete what is of days before the last keep_days, descriptions first; returns those days. Folders that aren't of a day stay."""
        cutoff = (today - timedelta(days=keep_days - 1)).isoformat()
        old = sorted({d for kind in ("meta", "data") for d in self._dates(kind) if len(d) == 10 and d < cutoff})
        for kind in ("meta", "data"):
            for day in old:
                self._fs.delete(self._path(f"{self.root}/{kind}/date={day}"), True)
        return old


def _columns(ddl: str) -> list[str]:
    """Top-level columns of a schema."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]
