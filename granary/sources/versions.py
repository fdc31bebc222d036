"""Days stored in versions: a reader sees the whole of one version, old or new, and a writer never touches files that somebody reads.

A day's rows lie under ``day=<day>/v=<n>``. A version counts once Spark's writer has marked it whole, with the last file that it makes; that mark is the
swap, on any file system. Readers take each day's highest whole version. A day may so be written from what it held before. ``clean`` drops versions that
newer ones have replaced for a while.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import Stages
from .landed import strict_day


class Days:
    """Days under ``base``; ``schema`` (with day) where nothing has been stored."""

    def __init__(self, spark: SparkSession, base: str, schema: str):
        self._spark, self._base, self._schema, self._files = spark, base.rstrip("/"), schema, Stages(spark, base)

    def _versions(self, mark: str = "/_SUCCESS", day: str = "*") -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for name in self._files.names(f"day={day}/v=*{mark}"):
            day_part, version = name.removesuffix(mark).split("/")[-2:]
            found.setdefault(day_part.removeprefix("day="), []).append(int(version.removeprefix("v=")))
        return found

    def write(self, df: DataFrame, day: str) -> int:
        """Store ``df`` as the day's next version; returns its number. Two writers at once get versions of their own; the higher one counts."""
        begun = self._versions("", strict_day(day)).get(day, [-1])
        version = max(begun) + 1
        while not self._files.claim(f"claims/{day}-{version}"):
            version += 1
        df.write.mode("overwrite").parquet(f"{self._base}/day={day}/v={version}")
        return version

    def read(self, day: str | None = None) -> DataFrame:
        """A day, or all, each as its highest whole version; columns that older days lack are null."""
        whole = self._versions(day=strict_day(day) if day else "*")
        if not whole:
            return self._spark.createDataFrame([], self._schema)
        paths = [f"{self._base}/day={d}/v={max(vs)}" for d, vs in sorted(whole.items())]
        return self._spark.read.option("basePath", self._base).option("mergeSchema", "true").parquet(*paths).drop("v")

    def clean(self, keep: int = 2) -> int:
        """Drop whole versions of each day but the last ``keep``, which readers may still hold; returns how many."""
        old = [f"day={d}/v={v}" for d, vs in self._versions().items() for v in sorted(vs)[:-keep]]
        for name in old:
            self._files.drop(name)
        return len(old)
