"""The table of findings, its order and its files; texts that are replaced in place."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.operators import declarations, numbering, report, segments, wording
from quillon.plans import fixtures
from quillon.sources import writers

PAPER = """Study

We report 250.5 kJ/mol and 12.5 ± 0.4.

1 Introduction
See [2] and [9], Figure 1 and Section 4. But Cp at 25 oC, a behaviour of 10^6 and Li7La3Zr2O12 — so.
Table 2: Numbers.
2 Methods
Kept at 40 degC and 310 K.

Conflict of interest: none.

References
[1] Adams B. First long title about lattices of salts, 10^5 of them, 2001.
[2] Baker C. Second long title about melts of glass, 2002.
[2] Cole D. Third long title about flows in pores, 2003.
"""


def papers(spark):
    long_ = "1 Introduction\n" + " ".join(["word"] * 45) + ".\n" + "And so on. " * 3 + "\n"
    return spark.createDataFrame([(3, PAPER, "x", 0), (1, PAPER.replace("[9]", "[1]"), "x", 0), (2, None, "x", 0), (4, "", "x", 0), (5, long_, "x", 0)], "doc_id long, text string, kind string, line int")


def test_the_table_has_what_the_checks_find(spark):
    df = papers(spark)
    rows = report.findings(df).collect()
    of = lambda check: sorted((r["doc_id"], r["line"], r["pos"], r["kind"], r["token"], r["suggestion"], r["snippet"], r["severity"]) for r in rows if r["check"] == check)
    shape = ("doc_id", "line", "pos", "kind", "token", "suggestion", "snippet", "severity")
    for check, found in (("typography", wording.check_typography(df)), ("editorial", wording.check_editorial(df))):
        assert of(check) == sorted(map(tuple, found.select(*shape).collect()))
    texts = {3: PAPER, 1: PAPER.replace("[9]", "[1]")}
    cites = {(r["doc_id"], k, str(n)) for r in numbering.check_citations(df).collect() for k, c in (("missing-entry", "missing"), ("uncited-entry", "orphans"), ("gap", "gaps"), ("duplicate", "duplicates")) for n in r[c] if r["cited"] and r["listed"]}
    assert {(r["doc_id"], r["kind"], r["token"]) for r in rows if r["check"] == "citations" and r["token"]} == cites and texts
    floats = {(r["doc_id"], f"{r['kind']}-without-caption", str(n)) for r in numbering.check_floats(segments.split_manuscript(df)).collect() for n in r["missing_captions"]}
    assert {(r["doc_id"], r["kind"], r["token"]) for r in rows if r["kind"].endswith("caption")} == floats
    said = declarations.check_statements(df).collect()
    assert {(r["doc_id"], s["key"], s["line"], m) for r in said for s in r["statements"] for m in s["issues"]} == {(r["doc_id"], r["token"], r["line"], r["message"].partition(": ")[2]) for r in rows if r["check"] == "statements"}
    values = {(r["doc_id"], m["text"]) for r in wording.check_consistency(df).collect() for m in r["mismatches"]}
    assert {(r["doc_id"], r["token"]) for r in rows if r["check"] == "consistency"} == values and values
    assert {r["severity"] for r in rows} <= {"error", "warning", "note"}
    bad = {(r["doc_id"], r["check"]) for r in rows if r["severity"] == "error"}
    state = report.status(report.findings(df), df).collect()
    assert len(state) == 5 * len(report.CHECKS) and {(r["doc_id"], r["check"]) for r in state if r["status"] == "suspect"} == bad
    assert report.findings(df.limit(0)).count() == 0


def test_files_of_findings_are_in_order_after_one_read(spark, tmp_path):
    given = fixtures.sql(spark, "/root/testdata/sf0.001", fixtures.MS, "documents") if os.path.exists("/root/testdata/sf0.001") else papers(spark)
    given.write.parquet(f"file://{tmp_path}/ms")
    found = report.findings(spark.read.parquet(f"file://{tmp_path}/ms"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    report.write(found, f"file://{tmp_path}/out", partitions=3)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".json")
    assert len(files) > 1
    rows = [json.loads(line) for p in files for line in p.read_text().splitlines()]
    place = lambda r: (r["doc_id"], report.CHECKS.index(r["check"]), r["line"], ("error", "warning", "note").index(r["severity"]))
    assert [place(r) for r in rows] == sorted(place(r) for r in rows) and len(rows) == found.count() > 100


# -- files ---------------------------------------------------------------------------


def test_only_changed_files_are_replaced(spark, tmp_path):
    good = PAPER.replace("[9]", "[1]").replace("[2] and [1]", "[1] and [2]").replace("[2] Cole", "[3] Cole")
    for name, text in (("a.md", PAPER), ("b/c.md", good), ("d.docx", PAPER)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = [(f"file://{tmp_path}/{n}", (tmp_path / n).read_text()) for n in ("a.md", "b/c.md", "d.docx")]
    times = os.stat(tmp_path / "b/c.md").st_mtime_ns
    df = spark.createDataFrame(rows, "path string, text string")
    want = {r["path"]: r["renumbered"] for r in numbering.renumber(df).collect()}
    done = writers.renumber_files(df, f"file://{tmp_path}").collect()
    assert [r["path"] for r in done] == [rows[0][0]]
    assert (tmp_path / "a.md").read_text() == want[rows[0][0]] != PAPER
    assert (tmp_path / "b/c.md").read_text() == good and os.stat(tmp_path / "b/c.md").st_mtime_ns == times
    assert (tmp_path / "d.docx").read_text() == PAPER
    assert not [p for p in os.listdir(tmp_path) if p.startswith(".staged")]


def test_a_failed_task_leaves_old_texts_or_new_ones(spark, tmp_path, monkeypatch):
    names = [f"{i}.txt" for i in range(12)]
    for n in names:
        (tmp_path / n).write_text(f"old {n}")
    df = spark.createDataFrame([(f"file://{tmp_path}/{n}", f"new {n}") for n in names] + [(None, "x"), (f"file://{tmp_path}/deep/er/n.txt", None)], "path string, text string")
    # while the texts are staged
    with pytest.raises(Exception, match="(?i)division|zero"):
        writers.replace_texts(df.withColumn("text", F.when(F.col("path").endswith("/7.txt"), F.raise_error(F.lit("division by zero"))).otherwise(F.col("text"))), f"file://{tmp_path}")
    assert all((tmp_path / n).read_text() == f"old {n}" for n in names)
    # while they are moved: the second file's move fails
    moved = writers._moved

    def broken(batches):
        import pyarrow.fs as pafs

        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                if i == 1:
                    raise OSError("lost")
                list(moved(iter([batch.slice(i, 1)])))
            yield batch
        assert pafs

    monkeypatch.setattr(writers, "_moved", broken)
    with pytest.raises(Exception, match="lost"):
        writers.replace_texts(df.coalesce(1), f"file://{tmp_path}")
    states = {(tmp_path / n).read_text() for n in names}
    assert states <= {f"{age} {n}" for n in names for age in ("old", "new")}
    monkeypatch.undo()
    assert writers.replace_texts(df, f"file://{tmp_path}").count() == 13
    assert all((tmp_path / n).read_text() == f"new {n}" for n in names) and (tmp_path / "deep/er/n.txt").read_text() == ""
    # a move that is made twice is made once
    batch = __import__("pyarrow").RecordBatch.from_pylist([{"path": f"file://{tmp_path}/0.txt", "staged": f"file://{tmp_path}/gone", "digest": __import__("hashlib").sha256(b"new 0.txt").hexdigest(), "bytes": 9}])
    assert len(list(writers._moved(iter([batch])))) == 1


def test_texts_that_are_written_are_not_shuffled(spark, tmp_path, monkeypatch):
    plans, put = [], writers.Scratch.put

    def seen(self, name, df, *by, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, name, df, *by, **how)

    monkeypatch.setattr(writers.Scratch, "put", seen)
    monkeypatch.setattr(writers, "AT_A_TIME", 2)
    rows = [(f"file://{tmp_path}/{n}.txt", t) for n, t in (("a", "z"), ("a", "b"), ("a", None), ("b", "é"), ("b", "é"), ("c", "x"), ("d", "y"), ("e", "w"))]
    done = writers.replace_texts(spark.createDataFrame(rows, "path string, text string"), f"file://{tmp_path}")
    assert {r["path"][-5]: r["bytes"] for r in done.collect()} == {"a": 0, "b": 2, "c": 1, "d": 1, "e": 1}
    assert [(tmp_path / f"{n}.txt").read_text() for n in "abcde"] == ["", "é", "x", "y", "w"]
    assert len(plans) == 3 and "Exchange" not in plans[0] and "text" not in plans[1]
    assert not [p for p in os.listdir(tmp_path) if p.startswith(".staged")]
