"""A data source of recorded responses, and the policy by which live ones are asked for.

`spark.read.format("recorded")` reads JSON lines of responses in `path`, a partition a file, so that a run can be
replayed without a network. Asking live is a function that a caller brings; attempts are made as `attempts`
says and their rows have the same columns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import keys
from ..session import ship

SCHEMA = "key string, method string, url string, status int, headers string, body string, recorded_at double"
MISS = 504


def request_key(method: str, url: str, body: bytes = b"") -> str:
    return hashlib.sha256("\0".join((method.upper(), url, hashlib.sha256(body).hexdigest())).encode()).hexdigest()


@dataclass
class _File(InputPartition):
    lines: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.lines = json.loads(options["lines"])
        self.size = int(options.get("linesapart", 500))

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(tuple(self.lines[i : i + self.size])) for i in range(0, len(self.lines), self.size)] or [_File(())]

    def read(self, partition: _File) -> Iterator[tuple]:
        for line in partition.lines:
            r = json.loads(line)
            yield (r["key"], r["method"], r["url"], r["status"], json.dumps(r.get("headers", {}), sort_keys=True), r.get("body", ""), float(r.get("recorded_at", 0)))


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fixtures(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A recording from rows at hand, for tests and small portals."""
    ship(spark)
    spark.dataSource.register(Recorded)
    lines = [json.dumps({"key": request_key(r["method"], r["url"])} | r) for r in rows]
    return spark.read.format("recorded").option("lines", json.dumps(lines)).load()


def recording(spark: SparkSession, path: str) -> DataFrame:
    """A recording in files."""
    return spark.read.schema(SCHEMA).json(path)


@dataclass(frozen=True)
class Answer:
    status: int
    body: str
    via: str = "http"


Ask = Callable[[str], Answer]


def attempts(ask: Ask, url: str, render: Ask | None = None, retries: int = 2) -> Answer:
    """Ask again after a transport error or a server's error; ask a browser after a refusal."""
    last = Answer(0, "")
    for _ in range(retries + 1):
        try:
            last = ask(url)
        except OSError:
            continue
        if last.status in (403, 429) and render is not None:
            return render(url)
        if last.status < 500 or last.status == MISS:
            return last
    return last


def fetched(requests: DataFrame, ask: Callable[[], Ask], render: Callable[[], Ask] | None = None, host_tasks: int = 64) -> DataFrame:
    """(url, status, body, via) of distinct addresses; a host's are asked one after the other, in one task."""
    urls = requests.select("url").distinct().withColumn("host", keys.host(F.col("url")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live, browser = ask(), render() if render else None
        for b in batches:
            got = [attempts(live, u, browser) for u in b["url"]]
            yield pd.DataFrame({"url": b["url"], "status": [a.status for a in got], "body": [a.body for a in got], "via": [a.via for a in got]})

    ship(requests.sparkSession)
    dealt = urls.repartition(host_tasks, "host").sortWithinPartitions("host", "url")
    return dealt.mapInPandas(run, "url string, status int, body string, via string")


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """What a recording answers to (method, url); a miss is MISS."""
    key = F.sha2(F.concat_ws("\0", F.upper("method"), "url", F.lit(hashlib.sha256(b"").hexdigest())).cast("binary"), 256)
    got = requests.withColumn("key", key).join(recorded.select("key", "status", "body", "recorded_at"), "key", "left")
    return got.withColumn("miss", F.col("status").isNull()).withColumn("status", F.coalesce("status", F.lit(MISS)))


def kept(responses: DataFrame) -> DataFrame:
    """Answers that are kept: found, and not empty."""
    return responses.where(F.col("status").between(200, 299) & (F.length(F.trim(F.coalesce("body", F.lit("")))) > 0))
