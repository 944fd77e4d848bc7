"""What services answered, kept between runs: each DOI is asked for once.

The store is a folder of runs. A run is a table of answers (doi, source, priority, asked_at,
state, attempt, body); it counts once Spark has committed it, so that a run that broke off is
as if it had not been. What is known of a DOI and a source is the best of all rows: an answer
counts more than a failure, a later answer more than an earlier one, and of answers of
one time the one that knows more. That is a maximum: it does not depend on the order in which
answers arrive, and rows that arrive twice change nothing.

States: ``known`` (with a body), ``unknown`` (the service has no such work) and ``failed``
(the service could not be asked); a failure is asked again after a while, and not for ever.

Asking is spread over tasks, on distinct DOIs; what is known already is left out by
anti-joins, so a second run asks for nothing. A source is asked only for what no better one
knows. Nothing passes through the driver but the names of the runs.
"""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import hadoop_path
from ..operators.records import doi_key
from . import registries

ANSWER = "doi string, source string, priority int, asked_at timestamp, state string, attempt int, body string"
#: How the bodies of a source become records.
READERS = {"crossref": registries.crossref, "openalex": registries.openalex}


@dataclass(frozen=True)
class Service:
    """A source by name; ``get`` gives a DOI's body, None if there is no such work, and
    raises where the service cannot be asked. Smaller priorities are asked first."""

    source: str
    priority: int
    get: Callable[[str], str | None]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> list[str]:
        """Folders of the runs that were committed."""
        files, top = hadoop_path(self.spark, self.path)
        if not files.exists(top):
            return []
        found = [entry.getPath().toString() for entry in files.listStatus(top) if entry.isDirectory()]
        return sorted(p for p in found if files.exists(hadoop_path(self.spark, f"{p}/_SUCCESS")[1]))

    def _append(self, rows: DataFrame) -> DataFrame:
        folder = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(ANSWER).parquet(folder)

    def log(self) -> DataFrame:
        runs = self._runs()
        return self.spark.read.schema(ANSWER).parquet(*runs) if runs else self.spark.createDataFrame([], ANSWER)

    def states(self) -> DataFrame:
        """One row for each DOI and source: its state, body, when that was said and attempts that failed."""
        rank = F.struct((F.col("state") != "failed").alias("answered"), "asked_at", (F.col("state") == "known").alias("known"), F.coalesce("body", F.lit("")).alias("body"))
        best = self.log().groupBy("doi", "source").agg(F.max(F.struct(rank.alias("rank"), "priority", "state", "asked_at", "body")).alias("b"), F.max("attempt").alias("attempts"), F.max("asked_at").alias("last_asked"))
        return best.select("doi", "source", "b.priority", "b.state", "b.asked_at", "attempts", "last_asked", "b.body")

    def pending(self, dois: DataFrame, service: Service, now: datetime.datetime, retry_after: float, attempts: int) -> DataFrame:
        """doi, attempts of those of ``dois`` that the service is to be asked for."""
        held = self.states().withColumnRenamed("doi", "_doi")
        better = held.filter((F.col("state") == "known") & ((F.col("priority") < service.priority) | (F.col("source") == service.source)))
        said = held.filter((F.col("source") == service.source) & (F.col("state") == "unknown"))
        waits = F.col("last_asked") > F.lit(now - datetime.timedelta(seconds=retry_after))
        off = held.filter((F.col("source") == service.source) & (F.col("state") == "failed") & (waits | (F.col("attempts") >= attempts)))
        closed = better.select("_doi").union(said.select("_doi")).union(off.select("_doi")).distinct()
        failed = held.filter((F.col("source") == service.source) & (F.col("state") == "failed")).select(F.col("_doi").alias("doi"), "attempts")
        return dois.join(closed, dois["doi"] == closed["_doi"], "left_anti").join(failed, "doi", "left").select("doi", F.coalesce("attempts", F.lit(0)).alias("attempts"))

    def fill(self, refs: DataFrame, services: Sequence[Service], now: datetime.datetime | None = None, retry_after: float = 3600, attempts: int = 5, tasks: int = 8, pause: float = 0) -> dict[str, int]:
        """Asks the services, the best first, for the references' DOIs that they still have to be
        asked for, by at most ``tasks`` tasks, each with a ``pause`` between two questions; the
        number of questions by source."""
        now = now or datetime.datetime.now()
        dois = refs.select(doi_key(F.col("doi")).alias("doi")).filter("doi IS NOT NULL").distinct()
        asked = {}
        for service in sorted(services, key=lambda s: (s.priority, s.source)):

            def run(batches: Iterator[pd.DataFrame], service=service) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    rows = []
                    for doi, before in zip(batch["doi"], batch["attempts"], strict=True):
                        try:
                            body = service.get(doi)
                            rows.append(("unknown" if body is None else "known", 0, body))
                        except Exception:  # the service's trouble; it is asked again later
                            rows.append(("failed", before + 1, None))
                        time.sleep(pause)
                    out = pd.DataFrame(rows, columns=["state", "attempt", "body"]).astype({"attempt": "int32"})
                    yield out.assign(doi=batch["doi"].values, source=service.source, priority=service.priority, asked_at=now)[[f.split()[0] for f in ANSWER.split(", ")]]

            wanted = self.pending(dois, service, now, retry_after, attempts).repartition(tasks, "doi")
            asked[service.source] = self._append(wanted.mapInPandas(run, ANSWER)).count()
        return asked

    def merge(self, answers: DataFrame) -> None:
        """Adds answers from elsewhere, however late: doi, source, priority, asked_at, body (null: unknown)."""
        rows = answers.withColumn("doi", doi_key(F.col("doi"))).filter("doi IS NOT NULL").withColumn("state", F.when(F.col("body").isNull(), "unknown").otherwise("known")).withColumn("attempt", F.lit(0))
        self._append(rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in ANSWER.split(", ")]))

    def compact(self) -> None:
        """One run of the states in the place of all. They are written before the others go; a
        reader in between sees both, which tell the same."""
        before = self._runs()
        if len(before) > 1:
            self._append(self.states().withColumn("attempt", F.col("attempts")).withColumn("asked_at", F.when(F.col("state") == "failed", F.col("last_asked")).otherwise(F.col("asked_at"))).select(*[f.split()[0] for f in ANSWER.split(", ")]))
            for folder in before:
                files, place = hadoop_path(self.spark, folder)
                files.delete(place, True)

    def registry(self, readers: dict[str, Callable] | None = None) -> DataFrame:
        """The records of all known bodies, as ``records.resolve`` reads them."""
        known, out = self.states().filter("state = 'known'"), None
        for source, reader in (readers or READERS).items():
            rows = reader(known.filter(F.col("source") == source).select("doi", "body"), source=source)
            out = rows if out is None else out.unionByName(rows)
        return out
