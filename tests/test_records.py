"""References, registries, bibliography files and Word documents."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import fields, records
from quillon.sources import bibliography, trees, word
from quillon.streaming import arrivals

REF = "key string, title string, authors array<string>, year int, doi string, volume string, first_page string, truncated boolean"


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        ("beta", 1, "10.1000/A", "A study of <i>Li</i><sub>7</sub> garnets", ["Ada Müller", "Bo Chen", "Cy Ng"], 2020, "12", "100-110"),
        ("alpha", 0, "10.1000/b", "Other work", ["Di Rossi"], 2001, "3", "7"),
        ("beta", 1, "10.1000/B", "Worse record", ["Nobody"], 1900, None, None),
    ]
    return spark.createDataFrame(rows, records.RECORD)


def test_check(spark, registry):
    rows = [
        ("same", "A study of Li 7 garnets", ["A. Muller", "Bo Chen", "Cy Ng"], 2021, "10.1000/a", " 12", "100", False),
        ("swap", "A study of Li 7 garnets", ["Ada Müller", "Eve Stone", "Cy Ng"], 2020, "10.1000/A", "12", "100", False),
        ("short", "A study of Li 7 garnets", ["Ada Müller", "et al."], 2020, "10.1000/A", None, None, False),
        ("facts", "Something else entirely", ["Eva Rossi"], 2004, "10.1000/B", "4", "8-9", False),
        ("none", "x", [], None, "", None, None, None),
        ("lost", "x", [], None, "10.9000/z", None, None, None),
    ]
    got = {r["key"]: r for r in records.check(spark.createDataFrame(rows, REF), registry).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"same": "ok", "swap": "suspect", "short": "ok", "facts": "suspect", "none": "no-doi", "lost": "broken"}
    assert got["facts"]["source"] == "alpha" and len(got["facts"]["issues"]) == 5
    assert [i for i in got["swap"]["issues"] if "stone" in i] and [i for i in got["swap"]["issues"] if "chen" in i]


def test_fold_and_similar(spark):
    names = ["Müller, J.", "<b>Ünal</b>  Ó", "Møller", "ﬁne", "plain Text-9", "", None]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", T.norm(F.col("n")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: T.fold(n) for i, n in enumerate(names)}
    pairs = [("smith", "smyth"), ("smith", "smithson"), ("", ""), ("abcdef", "abcxef")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()
    assert {(r["a"], r["b"]): r["s"] for r in got} == {pairs[0]: True, pairs[1]: False, pairs[2]: True, pairs[3]: True}


def test_live_registry_is_asked_once(spark):
    rows = spark.createDataFrame([("k", "T", ["A B"], 2000, d, None, None, False) for d in ("10.1000/X", "10.1000/x", None, "10.1000/bad", "10.1000/none")], REF)

    def fetch(doi):
        if doi == "10.1000/bad":
            raise OSError("no network")
        return None if doi == "10.1000/none" else {"title": "T", "authors": ["A B"], "year": 2000, "volume": None, "first_page": None}

    got = records.fetched(rows, fetch, "live", 0).collect()
    assert [(r["doi"], r["title"], r["source"]) for r in got] == [("10.1000/x", "T", "live")]


def test_entry_audit(spark, registry):
    entries = [(1, 0, "Muller A., A study of Li 7 garnets, 2020"), (1, 1, "Rossi, Other work, doi 10.1000/B."), (1, 2, "Garnets study by someone else, 1999"), (1, 3, "https://doi.org/10.9000/none"), (1, 4, "10.1000/A"), (1, 201, "beyond the cap, not seen")]
    rows = spark.createDataFrame(entries, "doc_id int, ord int, entry string")
    first = {0: "match", 1: "match", 2: "check", 3: "no-match", 4: "match"}
    assert {r["ord"]: r["verdict"] for r in records.audit_entries(rows, registry, most=200).collect()} == first
    assert {r["ord"]: r["verdict"] for r in records.audit_entries(rows, registry).collect()} == {**first, 201: "no-match"}


def test_every_entry_of_a_long_list_is_judged(spark, monkeypatch):
    from quillon.plans import queries

    line = lambda i: (1, i, "Adams, B. First long title about lattices of salts" if i % 2 else f"Number {i} of no record")
    entries = spark.createDataFrame([line(i) for i in range(450)], "doc_id int, ord int, entry string")
    monkeypatch.setattr(queries, "ref_entries", lambda spark, sf_dir: entries)
    got = {r["ord"]: r["verdict"] for r in queries.entry_verdict(spark, "").collect()}
    assert got == {i: "match" if i % 2 else "no-match" for i in range(450)}


def test_csl():
    items = [{"id": "a", "title": "T", "author": [{"given": "Ann", "family": "Lee"}, {"literal": "Group"}, {"family": "Others"}, "junk"], "issued": {"date-parts": [["2019"]]}, "page": "5–9", "DOI": "10.1000/x", "volume": 7}, "stray", None, {"author": "bare", "issued": {"date-parts": [["n.d."]]}}]
    a, b = bibliography.parse_csl(json.dumps(items))
    assert (a["authors"], a["truncated"], a["year"], a["first_page"], a["volume"]) == (["Ann Lee", "Group"], True, 2019, "5", "7")
    assert (b["key"], b["authors"], b["year"], b["doi"]) == ("?", [], None, None)
    assert len(bibliography.parse_csl('{"title": "one"}')) == 1
    with pytest.raises(ValueError):
        bibliography.parse_csl("3")
    with pytest.raises(ValueError):
        bibliography.parse_csl("{broken")


BIB = r"""@comment{x} @string{y = "z"}
@article{k1, title = {On {N}ested {\"u}ber}, author = {M{\"u}ller, J. and Ann Lee and others}, year = "May 2018", pages = {10--20}, volume = 3, doi={10.1000/q}}
@misc{nocomma}
@book{k2, title = "Quoted, with comma", date = {c. 1999}, author = {{\O}stby, K{\aa}re}, title = {Last wins}}
@broken{k3, title = {never closed"""


def test_bibtex():
    k1, none, k2 = bibliography.parse_bibtex(BIB)
    assert (k1["key"], k1["title"], k1["authors"], k1["truncated"], k1["year"], k1["first_page"], k1["volume"], k1["doi"]) == ("k1", "On Nested uber", ["J. Muller", "Ann Lee"], True, 2018, "10", "3", "10.1000/q")
    assert none["key"] == "nocomma" and (k2["title"], k2["year"], k2["authors"]) == ("Last wins", 1999, ["Kare Ostby"])


def test_files(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.json").write_text('[{"id": "j", "title": "T"}]')
    (tmp_path / "c.txt").write_text('  @misc{t, title = {X}}')
    got = bibliography.load(spark, str(tmp_path)).collect()
    assert sorted(r["key"] for r in got) == ["j", "k1", "k2", "nocomma", "t"]
    modes = spark.createDataFrame([("@x",), ("[1] text",), ("[ {",), (" {",), ("plain",)], "t string").select(bibliography.mode_of(F.col("t")).alias("m")).collect()
    assert [m["m"] for m in modes] == ["structured", "audit", "structured", "structured", "audit"]
    repo = tmp_path / "repo"
    for p in ("code/a b.py", ".git/config", "README.md", "README.txt", "x/venv/y.py"):
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(p)
    assert sorted(r["rel_path"] for r in trees.files(spark, str(repo)).collect()) == ["README.md", "README.txt", "code/a b.py"]
    assert trees.readme(spark, str(repo)).first()["readme_text"] == "README.md"


def run(text, raised=None):
    return "<w:r>" + (f'<w:vertAlign w:val="{raised}"/>' if raised else "") + f"<w:t>{text}</w:t></w:r>"


def test_word_text(spark, tmp_path):
    code = "<w:instrText>ADDIN ZOTERO_ITEM CSL_CITATION {}</w:instrText>"
    xml = f"<w:p>{code}{run('shown')}{run('3,5', 'superscript')}</w:p><w:p>{run('10')}{run('6', 'superscript')} {run('x')}{run('i', 'subscript')}{run('2', 'superscript')} {run('cos')}{run('3', 'superscript')} {run('γ')}{run('3', 'superscript')}</w:p><w:p>{run('1', 'superscript')}{run('a &amp; b,¹ m⁻² 10³')}</w:p>"
    with zipfile.ZipFile(tmp_path / "m.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    docs = word.load(spark, str(tmp_path / "m.docx"))
    r = docs.select(word.visible_text(F.col("xml")).alias("v"), word.ordering_text(F.col("xml")).alias("o"), word.field_count(F.col("xml")).alias("n")).first()
    assert r["v"] == "shown3,5\n106 xi2 cos3 γ3\n1a & b,¹ m⁻² 10³\n" and r["n"] == 1
    assert r["o"] == "shown[3,5]\n106 xi2 cos3 γ3\n[1]a & b,[1] m⁻² 10³\n"


def test_managed_citations(spark, registry):
    def code(keys, printed):
        items = [{"uris": [f"http://z/items/{k}"] if k else [], "itemData": {"id": k, "title": "Other work", "author": [{"given": "Di", "family": "Rossi"}], "DOI": "10.1000/b" if k != "CCC" else None}} for k in keys]
        return "ADDIN ZOTERO_ITEM CSL_CITATION " + json.dumps({"citationItems": items, "properties": {"formattedCitation": printed}})

    one = code(["AAA"], "<sup>[1]</sup>").replace('"', "&quot;")
    xml = f"<w:instrText>{one[:60]}</w:instrText><w:instrText xml:space='p'>{one[60:]}</w:instrText>" + f"<w:instrText>ADDIN ZOTERO_ITEM CSL_CITATION {{bad}}</w:instrText><w:instrText>{code(['BBB', 'CCC', ''], '[2, 5]').replace('<', '&lt;')}</w:instrText>"
    cites = word.citations(spark.createDataFrame([("d", xml)], "doc_id string, xml string"))
    assert [(r["ord"], r["printed"], r["numbers"]) for r in cites.orderBy("ord").collect()] == [(0, "[1]", [1]), (1, "[2, 5]", [2, 5])]
    refs, docs = fields.audit(cites, registry, bibliography.references)
    got = {r["item_key"]: r for r in refs.collect()}
    assert {k: (r["canonical_number"], r["printed_numbers"], r["number_ok"], r["metadata_status"]) for k, r in got.items()} == {"AAA": (1, [1], True, "ok"), "BBB": (2, [2], True, "ok"), "CCC": (3, [5], False, "no-doi")}
    r = docs.first()
    assert (r["missing"], r["extra"], r["status"]) == ([3], [5], "suspect")


def test_an_audit_parses_each_document_once(spark, registry):
    cite = lambda n, keys, numbers: (n, [{"key": k, "item": json.dumps({"title": f"{k}{n}"})} for k in keys], numbers)
    rows = [("d", *c) for c in (cite(0, ["B", "", "A"], [2, 1]), cite(1, ["A", "C"], [3]), cite(2, ["B"], [2]), cite(3, ["E"], []))]
    given = spark.createDataFrame(rows, "doc_id string, ord int, items array<struct<key:string,item:string>>, numbers array<int>").repartition(3)
    refs, _ = fields.audit(given, registry, bibliography.references)
    got = {r["item_key"]: (r["canonical_number"], r["title"], r["printed_numbers"], r["number_ok"]) for r in refs.collect()}
    assert got == {"B": (1, "B0", [2], False), "A": (2, "A0", [1, 3], False), "C": (3, "C1", [3], True), "E": (4, "E3", [], True)}
    refs, _ = fields.audit(word.citations(spark.createDataFrame([("d", "")], "doc_id string, xml string")), registry, bibliography.references)
    assert refs._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 2  # documents, and items


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("Rates of 10^6 here.\r\nmore")
    from quillon.operators import wording

    q = arrivals.audit(arrivals.manuscripts(spark, str(tmp_path / "in")), wording.check_typography, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [r["token"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["^6"]


def test_zipped_bytes_without_a_document(spark):
    data = io.BytesIO()
    zipfile.ZipFile(data, "w").close()
    rows = spark.createDataFrame([(0, None), (1, data.getvalue())], "i int, content binary").select("i", word._document("content").alias("x")).select("i", "x.*")
    none, empty = sorted(rows.collect())
    assert (none["xml"], none["error"]) == (None, None) and empty["xml"] is None and "KeyError" in empty["error"]
