"""Registry records from the JSON that bibliographic services answer with.

``answers`` asks a service once for each distinct DOI; ``crossref`` and ``openalex`` turn
answers into the columns that ``records.resolve`` reads, with Catalyst's JSON reader:
a value of another shape than stated is null, and what is no JSON gives no record.
Several services are a union of their records; ``priority`` says which goes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_page
from ..operators.records import doi_key

# Where the services answer.
CROSSREF = "https://api.crossref.org/works/"
OPENALEX = "https://api.openalex.org/works/doi:"

# The parts of the services' formats that are read.
_MESSAGE = "message struct<title: array<string>, author: array<struct<given: string, family: string, literal: string>>, issued: struct<`date-parts`: array<array<int>>>, volume: string, page: string>"
_WORK = "id string, display_name string, publication_year int, authorships array<struct<author: struct<display_name: string>>>, biblio struct<volume: string, first_page: string>"


def address(base: str, doi: str, mailto: str | None = None) -> str:
    """Where a service tells of a DOI; slashes stay, other signs are quoted."""
    return base + quote(doi) + (f"?mailto={quote(mailto)}" if mailto else "")


def asker(base: str, mailto: str | None = None, seconds: float = 30) -> Callable[[str], str]:
    """A function from a DOI to a service's answer, for ``answers``."""

    def get(doi: str) -> str:
        agent = f"quillon (+{mailto})" if mailto else "quillon"
        with urlopen(Request(address(base, doi, mailto), headers={"User-Agent": agent}), timeout=seconds) as answer:
            return answer.read().decode("utf-8", "replace")

    return get


def answers(refs: DataFrame, get: Callable[[str], str | None]) -> DataFrame:
    """doi, body for each distinct DOI that ``get`` has an answer for; a DOI that it
    raises on is unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doi in batch["doi"]:
                try:
                    rows.append((doi, get(doi)))
                except Exception:  # whatever a service does, the DOI is unknown
                    rows.append((doi, None))
            rows = [r for r in rows if r[1] is not None]
            if rows:
                yield pd.DataFrame(rows, columns=["doi", "body"])

    return refs.select(doi_key(F.col("doi")).alias("doi")).filter("doi IS NOT NULL").distinct().mapInPandas(run, "doi string, body string")


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _records(rows: DataFrame, source: str, priority: int, title: Column, names: Column, year: Column, volume: Column, page: Column) -> DataFrame:
    authors = F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))
    return rows.select(
        F.lit(source).alias("source"),
        F.lit(priority).alias("priority"),
        "doi",
        F.coalesce(title, F.lit("")).alias("title"),
        authors.alias("authors"),
        year.alias("year"),
        _filled(volume).alias("volume"),
        _filled(first_page(page)).alias("first_page"),
    )


def crossref(bodies: DataFrame, source: str = "crossref", priority: int = 0) -> DataFrame:
    """Records of Crossref's answers (doi, body). An author without given or family name
    goes by the literal one; the first title and the first date count."""
    rows = bodies.select("doi", F.from_json("body", _MESSAGE)["message"].alias("m")).filter("m IS NOT NULL")
    name = lambda a: F.concat_ws(" ", _filled(a["given"]), F.coalesce(_filled(a["family"]), _filled(a["literal"])))
    year = F.get(F.get(F.col("m")["issued"]["date-parts"], 0), 0)
    return _records(rows, source, priority, F.get("m.title", 0), F.transform("m.author", name), year, F.col("m.volume"), F.col("m.page"))


def openalex(bodies: DataFrame, source: str = "openalex", priority: int = 1) -> DataFrame:
    """Records of OpenAlex's answers (doi, body); what has no id is no work."""
    rows = bodies.select("doi", F.from_json("body", _WORK).alias("m")).filter("m.id IS NOT NULL")
    names = F.transform("m.authorships", lambda a: F.coalesce(a["author"]["display_name"], F.lit("")))
    return _records(rows, source, priority, F.col("m.display_name"), names, F.col("m.publication_year"), F.col("m.biblio.volume"), F.col("m.biblio.first_page"))
