"""Landed answers of searches as a Spark data source, ``landed_queries``: one partition a search, in batch and on streams.

A landing zone holds ``batch=<n>/search=<id>/*.parquet`` with a column ``payload``: what each search of a source answered in each round of
collection (``land`` writes it). The reader takes the searches from its options, opens the files of each in one task, and gives the first ``count``
entries of each answer, in order. Comparisons of source, region_scope and keyword with literals are pushed down: partitions of other
searches are not planned. A stream's offset is the number of rounds that have landed whole; each micro-batch reads the rounds since the last.

The zone must lie where Arrow's file systems reach (local and shared folders, HDFS, object stores); elsewhere ``landed.search_results`` reads
answers that Spark has loaded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import landed

SCHEMA = "source string, region_scope string, keyword string, label string, batch int, position int, payload string"
_PUSHED = ("source", "region_scope", "keyword")


class _Search(InputPartition):
    def __init__(self, search: tuple, number: int, batches: tuple[int, int]):
        self.search, self.number, self.batches = search, number, batches


def _zone(path: str):  # noqa: ANN202
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


def _rounds(path: str) -> int:
    """Rounds that have landed whole: Spark's writer marks them when all files of one are in place."""
    import pyarrow.fs as fs

    files, root = _zone(path)
    n = 0
    while files.get_file_info(f"{root}/batch={n}/_SUCCESS").type == fs.FileType.File:
        n += 1
    return n


def _entries(path: str, part: _Search, count: int) -> Iterator[tuple]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    files, root = _zone(path)
    source, scope, keyword, label = part.search
    for batch in range(*part.batches):
        folder = f"{root}/batch={batch}/search={part.number}"
        if files.get_file_info(folder).type != fs.FileType.Directory:
            continue
        names = sorted(i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".parquet"))
        position = 0
        for name in names:
            for payload in pq.ParquetFile(files.open_input_file(name)).read(["payload"]).column("payload").to_pylist():
                try:
                    data = json.loads(payload or "")
                except ValueError:
                    continue
                for entry in (data.get("data") if isinstance(data, dict) else None) or []:
                    if position == count:
                        break
                    yield source, scope, keyword, label, batch, position, json.dumps({"data": [entry]}, ensure_ascii=False)
                    position += 1


def _searches(options: dict) -> list[tuple[int, tuple]]:
    return [(i, tuple(s)) for i, s in enumerate(json.loads(options["searches"]))]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count, self.searches = options["path"], int(options.get("count", 10)), _searches(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Searches that a filter leaves out are never planned. Filters on anything else stay with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else ""
            if column not in _PUSHED:
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            at = _PUSHED.index(column)
            self.searches = [(i, s) for i, s in self.searches if s[at] in wanted]

    def partitions(self) -> list[InputPartition]:
        n = _rounds(self.path)
        return [_Search(s, i, (0, n)) for i, s in self.searches]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _entries(self.path, partition, self.count)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.count, self.searches = options["path"], int(options.get("count", 10)), _searches(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rounds": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rounds": _rounds(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Search(s, i, (start["rounds"], end["rounds"])) for i, s in self.searches]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _entries(self.path, partition, self.count)


class LandedQueries(DataSource):
    """Options: path; searches, a JSON list of [source, region_scope, keyword, label]; count, entries of an answer at most (10)."""

    @classmethod
    def name(cls) -> str:
        return "landed_queries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedQueries)


def search_list(searches: DataFrame) -> str:
    """The searches of ``specs.query_table`` as the option that the source takes, in their order; they are a registry's, a few dozen."""
    return json.dumps([[r.source, r.region_scope, r.keyword, r.label] for r in searches.collect()], ensure_ascii=False)


def land(answers: DataFrame, path: str, batch: int) -> None:
    """Write a round's answers (search, the number of the search in the list; payload) to the zone."""
    answers.select("search", "payload").repartition("search").write.mode("overwrite").partitionBy("search").parquet(f"{path.rstrip('/')}/batch={batch}")


def articles(entries: DataFrame) -> DataFrame:
    """Entries, of a batch or a stream, as articles that carry their source's name and scope."""
    return landed.search_results(entries).withColumnRenamed("source", "skill_name").drop("_i")
