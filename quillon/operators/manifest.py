"""What a README names against the files that are there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of files that a README should document.
SUFFIXES = (".py", ".csv", ".tsv", ".json", ".dat", ".tdb", ".ipynb", ".r", ".sh")
# Files of a project's set-up.
SETUP = ("readme.md", "license", "license.txt", "license.md", "requirements.txt", "environment.yml", "pyproject.toml", "setup.py", "setup.cfg", "conftest.py", "__init__.py", ".gitignore")
_TOKEN = r"[A-Za-z0-9_./-]+\.[A-Za-z0-9]+"
_FENCE = r"(?s)```.*?```"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def is_artifact(path: Column) -> Column:
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")
    return _suffix(path).isin(*SUFFIXES) & ~F.lower(basename(path)).isin(*SETUP) & ~stem.endswith("_results")


def _mentions(readme: Column) -> Column:
    """Names in backticks, then those inside fenced blocks, as often as they stand there."""
    quoted = F.regexp_extract_all(readme, F.lit(f"`({_TOKEN})`"), F.lit(1))
    fenced = F.flatten(F.transform(F.regexp_extract_all(readme, F.lit(_FENCE), F.lit(0)), lambda b: F.regexp_extract_all(b, F.lit(_TOKEN), F.lit(0))))
    return F.when(F.contains(readme, F.lit("```")), F.concat(quoted, fenced)).otherwise(quoted)


def referenced(readme: Column) -> Column:
    """Paths that a README names: in backticks, then inside fenced blocks; distinct, in order."""
    return F.array_distinct(F.filter(_mentions(readme), lambda t: _suffix(t).isin(*SUFFIXES)))


def missing(readmes: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, token, ord, kind, n: names without a file, by their first mention, and how often the
    README has each. ``dangling`` if the name has
    a folder or stands in a fenced block, else ``mentioned``. A name with a folder
    needs that path, a bare one any file of that name. readmes: repo_id,
    readme_text; files: repo_id, rel_path."""
    text = F.coalesce(F.col("readme_text"), F.lit(""))
    named = readmes.select("repo_id", F.posexplode(_mentions(text)).alias("ord", "token")).filter(_suffix(F.col("token")).isin(*SUFFIXES))
    named = named.groupBy("repo_id", "token").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    # a name with a folder equals paths alone, a bare one names alone
    there = files.select("repo_id", F.explode(F.array("rel_path", basename(F.col("rel_path")))).alias("token")).distinct()
    gone = named.join(there, ["repo_id", "token"], "left_anti")
    code = F.array_join(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(0)), "\n")
    fenced = readmes.filter(F.contains(text, F.lit("```"))).select("repo_id", code.alias("_code")).filter("_code <> ''")
    strong = F.contains("token", F.lit("/")) | F.contains("_code", F.col("token")) | F.contains("_code", basename(F.col("token")))
    return gone.join(fenced, "repo_id", "left").select("repo_id", "token", "ord", F.when(strong, "dangling").otherwise("mentioned").alias("kind"), "n")


#: Files of a project that one automaton looks for.
NAMES = 10_000


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repo_id and paths of the files of which a README holds neither path nor name: one pass over
    its text for all names of a block."""
    import ahocorasick

    for batch in batches:
        at, paths = [], []
        for i, (files, text) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            names = files.as_py()
            made = ahocorasick.Automaton()
            for f in names:
                made.add_word(f["path"], f["path"])
                made.add_word(f["name"], f["name"])
            made.make_automaton()
            seen = {word for _, word in made.iter(text.as_py() or "")}
            left = [f["path"] for f in names if f["path"] not in seen and f["name"] not in seen]
            at += [i] * len(left)
            paths += left
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string())], ["repo_id", "rel_path"])


def uncatalogued(readmes: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, rel_path: artifacts that the README, if there is one, does not hold. Files meet their
    README in blocks of about :data:`NAMES`, so its text is read once a block and copied to no file;
    a project with very many files is many blocks."""
    rows = files.filter(is_artifact(F.col("rel_path")) & F.col("repo_id").isNotNull()).select("repo_id", "rel_path").distinct()
    blocks = rows.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / NAMES).cast("int").alias("_n"))
    dealt = rows.join(blocks, "repo_id").groupBy("repo_id", F.pmod(F.xxhash64("rel_path"), F.col("_n")).alias("_b"))
    held = dealt.agg(F.collect_list(F.struct(F.col("rel_path").alias("path"), basename(F.col("rel_path")).alias("name"))).alias("files"))
    met = held.join(readmes.select("repo_id", "readme_text"), "repo_id", "left").select("repo_id", "files", "readme_text")
    return met.mapInArrow(_left_over, rows.schema).distinct()
