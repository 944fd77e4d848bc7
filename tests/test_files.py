"""Folders, registry answers, and files that hold nothing."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import manifest, records
from quillon.sources import bibliography, registries, trees, word


def test_all_files_of_a_folder(spark, tmp_path):
    """Hidden, underscored and empty files are files; links and pruned folders are not looked into."""
    for name in ("README.md", "_run.py", ".gitignore", "code/__init__.py", "code/a b+c%.py", "code/deep/.env", ".git/config", "code/venv/x.py", "gone/é.csv", ".a.crc"):
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if name == "gone/é.csv" else "x `_run.py` `code/a.py`")
    os.symlink(tmp_path / "p" / "code", tmp_path / "p" / "again")
    os.symlink(tmp_path / "p" / "_run.py", tmp_path / "p" / "alias.py")
    (tmp_path / "empty").mkdir()
    rows = trees.files(spark, str(tmp_path / "p"))
    want = {"README.md", "_run.py", ".gitignore", "code/__init__.py", "code/a b+c%.py", "code/deep/.env", "gone/é.csv", ".a.crc"}
    assert {r["rel_path"] for r in rows.collect()} == want
    assert {r["rel_path"] for r in trees.files(spark, f"file://{tmp_path}/p").collect()} == want
    assert trees.files(spark, str(tmp_path / "empty")).count() == 0
    gone = manifest.missing(trees.readme(spark, str(tmp_path / "p")), rows).collect()
    assert [(r["token"], r["kind"]) for r in gone] == [("code/a.py", "dangling")]


def test_answers_of_services(spark):
    crossref = {
        "10.1/a": '{"message": {"title": ["One", "Two"], "author": [{"given": "Ana", "family": "Li"}, {"family": "", "literal": "Group"}, {}], "issued": {"date-parts": [[2001, 5]]}, "volume": "12", "page": "e5-9"}}',
        "10.1/b": '{"message": {"title": [], "author": "odd", "issued": {"date-parts": [[null]]}, "page": null}}',
        "10.1/c": "no json",
        "10.1/d": '{"message": {}}',
    }
    openalex = {"10.1/c": '{"id": "W1", "display_name": null, "publication_year": 1999, "authorships": [{"author": {"display_name": "Bo"}}, {"author": null}, {}], "biblio": null}', "10.1/d": '{"id": null, "display_name": "x"}', "10.1/f": "{}"}
    asked = []

    def get(doi):
        asked.append(doi)
        return crossref[doi]  # raises for others

    refs = spark.createDataFrame([(d,) for d in ("10.1/A", "10.1/a ", "10.1/b", "10.1/c", "10.1/d", "10.1/e", None, "")], "doi string")
    bodies = registries.answers(refs, get)
    assert {r["doi"] for r in bodies.collect()} == set(crossref)
    got = {r["doi"]: tuple(r)[3:] for r in registries.crossref(bodies).collect()}
    assert got == {"10.1/a": ("One", ["Ana Li", "Group"], 2001, "12", "e5"), "10.1/b": ("", [], None, None, None), "10.1/d": ("", [], None, None, None)}
    works = registries.openalex(spark.createDataFrame(list(openalex.items()), "doi string, body string"))
    assert [tuple(r) for r in works.collect()] == [("openalex", 1, "10.1/c", "", ["Bo"], 1999, None, None)]
    both = records.resolve(refs, registries.crossref(bodies).unionByName(works))
    assert {r["doi"]: r["source"] for r in both.collect()} == {"10.1/A": "crossref", "10.1/a ": "crossref", "10.1/b": "crossref", "10.1/c": "openalex", "10.1/d": "crossref", "10.1/e": "", None: "", "": ""}
    assert registries.answers(refs.limit(0), get).count() == 0
    assert registries.address(registries.CROSSREF, "10.1/a b<c>", "me@x.org") == "https://api.crossref.org/works/10.1/a%20b%3Cc%3E?mailto=me%40x.org"


def test_files_that_hold_nothing(spark):
    files = spark.createDataFrame([("a.bib", ""), ("b.json", "[]"), ("c.bib", None)], "path string, text string")
    assert bibliography.parse(files).count() == 0
    many = spark.range(12_000).select(F.concat("id", F.lit(".json")).alias("path"), F.lit('[{"title": "x"}, {"title": "y"}]').alias("text")).coalesce(1)
    assert bibliography.parse(many).groupBy("title").agg(F.countDistinct("path"), F.min("ref_ord"), F.max("ref_ord")).orderBy("title").collect() == [("x", 12_000, 0, 0), ("y", 12_000, 1, 1)]
    assert word.citations(spark.createDataFrame([("a", None), ("b", "<w:p/>")], "doc_id string, xml string")).count() == 0
    assert records.fetched(spark.createDataFrame([("10.1/a",)], "doi string"), lambda doi: None, "s", 0).count() == 0


def test_references_without_doi_are_spread(spark):
    """They meet no record, whatever other columns they have; none is lost, repeated ones stay."""
    rows = spark.range(40).selectExpr("CASE WHEN id % 4 = 0 THEN ' 10.1/A' WHEN id % 4 = 1 THEN '' END AS doi", "map('a', id) AS `odd name`", "id % 3 AS source_id").withColumn("n", F.struct(F.create_map(F.lit("a"), F.lit(1)).alias("m")))
    known = spark.createDataFrame([("s", 0, d, "t", ["x"], 1, "v", "p") for d in ("10.1/a", None, "")], records.RECORD)
    got = records.resolve(rows, known).groupBy("source").count().collect()
    assert sorted(tuple(r) for r in got) == [("", 30), ("s", 10)]


def test_broken_files_are_rows_and_no_failed_job(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Salt</w:t></w:p>")
    with zipfile.ZipFile(tmp_path / "other.docx", "w") as z:
        z.writestr("mimetype", "x")
    (tmp_path / "cut.docx").write_bytes((tmp_path / "good.docx").read_bytes()[:40])
    got = {r["doc_id"].rpartition("/")[2]: (r["xml"], r["error"]) for r in word.load(spark, f"{tmp_path}/*.docx").collect()}
    assert got.pop("good.docx") == ("<w:p><w:t>Salt</w:t></w:p>", None)
    assert set(got) == {"other.docx", "cut.docx"} and all(x is None and e for x, e in got.values())
    rows = spark.createDataFrame([("a.json", '[{"id": "x", "title": "T"}]'), ("b.json", '[{"id"'), ("c.bib", "@article{k, title = {A}"), ("d.json", "3")], "path string, text string")
    found = {(r["path"], r["key"], r["error"] is None) for r in bibliography.parse(rows, errors=True).collect()}
    assert found == {("a.json", "x", True), ("b.json", None, False), ("d.json", None, False)}


def test_bibtex_values(spark):
    text = """@string{j = {Journal}} stray } brace
@Article{k1, Title = "The " # {{LiF} salt} # " melt", author={Berg, Ana and Bo Kole and others}, year = 2001 , pages="3--9", title2 = x}
@comment{ @book{in, title = {Inside}} }
@book{k2}
@misc(k3, title={no})
@article{open, title = {never closed
@article{k4, title = {Last}, title = {Wins}, , doi = {10.1000/X}, 7 = broken, volume = {9}}"""
    got = {r["key"]: (r["title"], r["authors"], r["year"], r["doi"], r["volume"], r["first_page"], r["truncated"]) for r in bibliography.parse(spark.createDataFrame([("a.bib", text)], "path string, text string")).collect()}
    assert got == {"k1": ("The LiF salt melt", ["Ana Berg", "Bo Kole"], 2001, None, None, "3", True), "in": ("Inside", [], None, None, None, None, False), "k2": ("", [], None, None, None, None, False), "k4": ("Wins", [], None, "10.1000/X", None, None, False)}


def test_names_that_a_readme_does_not_hold(spark, monkeypatch):
    """Against the plain test of each file, in one block and in several."""
    import random

    rng = random.Random(4)
    words = [f"run{i}.py" for i in range(30)] + ["a b.csv", "é.json", "code/run3.py", "x.txt", "Run1.py"]
    texts = {i: None if i == 3 else " ".join(rng.choices(words, k=12)) + " xrun5.py run7.pyc" for i in range(6)}
    files = [(i, rng.choice(["", "code/", "deep/er/"]) + rng.choice(words)) for i in range(8) for _ in range(25)]
    rows, readmes = spark.createDataFrame(files, "repo_id int, rel_path string"), spark.createDataFrame(list(texts.items()), "repo_id int, readme_text string")
    want = {(i, f) for i, f in files if f.endswith((".py", ".csv", ".json")) and f not in (texts.get(i) or "") and f.rpartition("/")[2] not in (texts.get(i) or "")}
    for names in (10_000, 4):
        monkeypatch.setattr(manifest, "NAMES", names)
        got = [tuple(r) for r in manifest.uncatalogued(readmes, rows).collect()]
        assert set(got) == want and len(got) == len(want)
    assert manifest.uncatalogued(readmes, rows.limit(0)).count() == 0


def test_many_small_files_are_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i}.md").write_text("" if i == 7 else f"é\r\ntext {i}\n", newline="")
    names = spark.range(300).select(F.concat(F.lit(f"file://{tmp_path}/"), F.col("id").cast("string"), F.lit(".md")).alias("path")).union(spark.createDataFrame([(None,)], "path string")).coalesce(2)
    read = trees.texts(names)
    assert read.rdd.getNumPartitions() == 2
    want = {f"file://{tmp_path}/{i}.md": "" if i == 7 else f"é\r\ntext {i}\n" for i in range(300)}
    assert {r["path"]: r["text"] for r in read.collect()} == want
    monkeypatch.setattr(trees, "BYTES", 40)  # texts are handed on in parts
    parts = list(trees._texts(iter([pa.RecordBatch.from_arrays([pa.array(sorted(want))], ["path"])])))
    assert len(parts) > 50 and {k: v for p in parts for k, v in zip(*p.to_pydict().values(), strict=True)} == want
    with pytest.raises(Exception, match="(?i)no such file|not.*found"):
        trees.texts(names.limit(1).select(F.concat("path", F.lit("x")).alias("path"))).collect()
