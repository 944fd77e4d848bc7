"""Citation, float and section numbers on small manuscripts with planted defects."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.functions.scan import blanked, lines, spans
from quillon.operators import numbering as N
from quillon.operators import segments as S


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over one text."""
    return lambda text, make: spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_scan_keeps_positions(one):
    got = one("é🙂 a1 bb22\n", lambda t: spans(t, r"[a-z]+\d+"))
    assert [(s["start"], s["end"], s["m"]) for s in got] == [(3, 5, "a1"), (6, 10, "bb22")]
    assert one("x ~ab~ y", lambda t: blanked(t, r"~[^~]+~")) == "x      y"
    assert one("a\r\nb c\n", lines) == ["a", "b", "c"]
    assert one(None, lambda t: spans(t, "a")) == []


def test_anchors(one):
    got = one("See [3, 1] and [4-6], not [a] or [7–5]; [2,4-5] [1-2-3].", N.anchors)
    assert [(a["pos"], a["numbers"]) for a in got] == [(4, [3, 1]), (15, [4, 5, 6]), (40, [2, 4, 5])]
    assert one("[2] [1, 2] [3]", N.cited) == [2, 1, 3]
    assert one(None, N.cited) == []


MS = "Title\n\nAbstract with [9].\n\n# 1. Introduction\nFirst [2], then [1, 3].\n\nFigure 1. A\n\n**References**\n[1] Alpha beta gamma delta epsilon.\n[2] Beta gamma delta epsilon zeta.\n[2] Again gamma delta epsilon zeta.\n[5] Delta epsilon zeta eta theta.\nAppendix\n[8] not listed"


def test_segments(spark):
    r = S.split_manuscript(spark.createDataFrame([(MS,), (None,), ("No list. Introductions too",)], "text string")).collect()
    assert r[0]["front"] == "Title\n\nAbstract with [9].\n\n" and r[0]["body"].startswith("# 1. Introduction") and r[0]["body"].endswith("**References**")
    assert r[0]["section"].strip().endswith("theta.")
    assert r[1]["body"] == "" and r[2]["list_at"] is None and r[2]["section"] == r[2]["prose"]


def test_citations_against_list(spark):
    auto = "Introduction\n[1] [2] [4]\nReferences\n" + "".join(f"Author {i} wrote a long title in {i}.\n" for i in (1, 2, 3))
    rows = spark.createDataFrame([(1, MS), (2, auto), (3, "Introduction\nnone\nReferences\n[1] Something that is long enough."), (4, "Introduction [1]\nReferences\n")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in N.check_citations(rows).collect()}
    assert (got[1]["cited"], got[1]["missing"], got[1]["orphans"], got[1]["gaps"], got[1]["duplicates"], got[1]["out_of_order"], got[1]["status"]) == ([2, 1, 3], [3], [5], [3, 4], [2], True, "suspect")
    assert got[1]["remap"] == {2: 1, 1: 2, 3: 3}
    assert got[2]["inferred"] and got[2]["missing"] == [4] and got[2]["orphans"] == [3] and not got[2]["out_of_order"]
    assert got[3]["status"] == "no markers" and got[4]["status"] == "no list"


def test_floats(spark):
    text = "Figs. 1-3 and Table 2; their Table 7.\nFigure 5 shows it. Configuration 4.\n*Figure 1.* One\nFigure 2: Two\nFigure 2. Twice\nTable 1. T\nTabs 1 and 2 to 4"
    got = {r["kind"]: r for r in N.check_floats(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id int, body string")).collect()}
    f, t = got["figure"], got["table"]
    assert (f["captions"], f["referenced"], f["missing_captions"], f["duplicates"], f["gaps"], f["uncited"], f["status"]) == ([2, 2], [1, 2, 3, 5], [1, 3, 5], [2], [1], [], "suspect") or f["captions"] == [1, 2, 2]
    assert t["captions"] == [1] and t["referenced"] == [2, 1, 3, 4]
    assert len(got) == 2


def test_sections(spark):
    text = "## 1 Intro\n### 1.2 More\n# 3. Next\nSee Section 1.2, Sections 3 and 4, sec. 9.1; their section 7. Table s3, Figures S1, Eq. S2, table S3"
    rows = spark.createDataFrame([(1, text, text), (2, "plain", "Section 4")], "doc_id int, prose string, body string")
    got = {r["doc_id"]: r for r in N.check_sections(rows).collect()}
    assert got[1]["dangling"] == ["4", "9.1"] and got[1]["si_floats"] == ["Eq S2", "Figure S1", "Table S3"]
    assert got[2]["dangling"] == [] and got[2]["status"] == "ok"


def test_renumber(spark):
    text = "Abstract [9].\nIntroduction\nA [3], B [1-3], C [7, 9].\nReferences\n[1] one\nnote\n[2] two\n[3] three\n[8] eight"
    r = N.renumber(spark.createDataFrame([(text,)], "text string")).first()
    assert r["renumbered"] == "Abstract [5].\nIntroduction\nA [1], B [1-3], C [4,5].\nReferences\n[1] three\nnote\n[2] one\n[3] two\n[8] eight"
    assert r["changed"] and any("8" in w for w in r["warnings"])
    again = N.renumber(spark.createDataFrame([(r["renumbered"],)], "text string")).first()
    assert again["renumbered"] == r["renumbered"] and not again["changed"]
    assert spark.range(1).select(N.collapse(F.array(*[F.lit(n) for n in (5, 1, 2, 3, 3, 8, 9)])).alias("x")).first()["x"] == "1-3,5,8,9"


def test_a_filter_on_changed_searches_no_text_again(spark):
    texts = spark.createDataFrame([("Introduction\nA [3], B [1].\nReferences\n[1] one\n[3] three",), ("Introduction\nA [1].",)], "text string")
    out = N.renumber(texts).select("renumbered", "changed")
    only = out.filter("changed")
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert searches(only) == searches(out) > 0
    assert [r["renumbered"] for r in only.collect()] == ["Introduction\nA [1], B [2].\nReferences\n[1] three\n[2] one"]


def test_entries(one):
    assert one("\n1. First entry that is\n long enough here.\n[2] Second entry that is long too.\n(3) Third entry is long enough, yes.\n4. short", S.entries) == ["First entry that is long enough here.", "Second entry that is long too.", "Third entry is long enough, yes."]
    assert len(one("One entry long enough to be kept.\n\nTwo entries long enough to keep.\n\nThree entries long enough to go.", S.entries)) == 3


def test_blank_runs_stay_linear(one):
    began = time.time()
    assert one((" " * 4400 + "\n") * 3 + "x", S.reference_list) is not None
    assert time.time() - began < 20


def test_floats_equal_the_plain_patterns(spark):
    """One search for both kinds finds what a search each for captions and mentions does."""
    import random
    import re

    words = ["Figure 1", "Fig. 2", "figs 3-5", "Table 2", "tab. 4", "TABLES 1 to 3", "their ", "Lee's ", ". ", ": ", "\n", "\n**", " _", " ", "and 7", "prefigure 2", "Figure\n9:", "Figures 1 and 2."]
    rng = random.Random(5)
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    got = {(r["doc_id"], r["kind"]): (r["captions"], r["referenced"]) for r in N.check_floats(rows).collect()}
    names = {"figure": r"(?:Figures?|Figs?\.?)", "table": r"(?:Tables?|Tabs?\.?)"}
    want = {}
    for i, t in enumerate(texts):
        for kind, name in names.items():
            heads = list(re.finditer(rf"(?m)^[ \t]*[*_]{{0,2}}[ \t]*\b({name}\s*(\d{{1,3}})\s*[.:])", t))
            found = re.finditer(rf"(?i)(?<!their )(?<!'s )\b{name}\s*\d{{1,3}}(?:\s*(?:and|to|[-–—,&])\s*\d{{1,3}})*", t)
            numbers = []
            for m in found:
                if m.start() in {h.start(1) for h in heads}:
                    continue
                last = None
                for n in re.finditer(r"\d{1,3}", m[0]):
                    gap, k = m[0][(last or n).end() if last else 0 : n.start()], int(n[0])
                    low = int(last[0]) if last else None
                    numbers += range(low + 1, k + 1) if last and re.search(r"(?i)[-–—]|\bto\b", gap) and low < k else [k]
                    last = n
            if heads or numbers:
                want[i, kind] = ([int(h[2]) for h in heads], list(dict.fromkeys(numbers)))
    assert got == want
