"""Rules from tables: terms, statements, and the cost of many of them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import declarations, numbering, policy, rules, wording

WORD = r"[^\W]"
MODES = {"word": r"(?<!\w){}(?!\w)", "stem": r"(?<!\w){}\w*", "within": "{}"}


def table(spark, rows):
    return spark.createDataFrame(rows, rules.RULES)


def plain(texts, rows):
    out = []
    for i, text in texts:
        for n, line in enumerate((text or "").splitlines(), 1):
            for number, term, mode, kind, severity, better in rows:
                if term:
                    for m in re.finditer(MODES[mode].format(re.escape(term)), line, re.I):
                        out.append((i, n, number, m.start(), kind, m[0], better + m[0][len(term) :] if mode == "stem" else better, severity))
    return sorted(out)


ROWS = [(1, "this work", "word", "phrase", "warning", "the present work"), (2, "behaviour", "stem", "spelling", "warning", "behavior"), (3, "über", "word", "phrase", "error", "over"), (4, "a", "within", "letter", "note", "b"), (5, "aa", "within", "letters", "note", "c"), (6, "", "word", "none", "error", ""), (7, None, "word", "none", "error", ""), (8, "C++", "word", "sign", "warning", "Cpp"), (9, "this work", "within", "phrase", "error", "x"), (10, "work", "stem", "w", "warning", "labour")]
TEXTS = [(1, "This work and this workflow, the thisxthis work. THIS WORK"), (2, "behaviours Behaviourist misbehaviour behaviour_x\nbehaviour"), (3, "Über über. ÜBERALL x-über"), (4, "aaaaa Aa\r\nbaab"), (5, None), (6, ""), (7, "C++ C+++ xC++ C++x (C++)"), (8, "this\nwork this  work"), (9, "é this work’s end\x0bthis work"), (1, "this work")]


def test_terms_against_patterns(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, body string")
    for most in (rules.LEXICON_BYTES, 150):  # one automaton, and several slices
        got = rules.check_rules(df, table(spark, ROWS), "body", whole=True, most=most).collect()
        assert sorted((r["doc_id"], r["line"], r["rule"], r["pos"], r["kind"], r["token"], r["suggestion"], r["severity"]) for r in got) == plain(TEXTS, ROWS)
    assert len(list(rules.lexicons(table(spark, ROWS), 150))) > 3
    assert rules.check_rules(df, table(spark, []), "body").count() == 0
    assert rules.check_rules(df.limit(0), table(spark, ROWS), "body").count() == 0
    seen = {r["snippet"] for r in got if r["rule"] == 2 and r["line"] == 2}
    assert seen == {"behaviour"}


def test_the_table_of_fixed_rules_finds_what_the_patterns_find(spark):
    rng = random.Random(3)
    words = [w for pair in wording.SPELLINGS for w in pair] + [p for p, _ in wording.PHRASES] + ["This", "work", "colours", "xcolour", "labelled_", "Organisations", "minimise", "é", "step", "\n", "References\n", "the same workflow"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for variant in ("American", "British"):
        got = rules.check_rules(df, rules.editorial_rules(spark, variant))
        want = wording.check_editorial(df, variant=variant, kinds=("banned-phrase", f"spelling-{variant.lower()}"))
        shape = lambda x: sorted(map(tuple, x.select("doc_id", "line", "pos", "kind", "token", "suggestion", "snippet", "severity").collect()))
        assert shape(got) == shape(want) and got.count() > 500


def test_a_thousand_rules_cost_less_than_twice_ten(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1000)]
    vocabulary = ["the", "of", "and", "rate", "salt", "phase", *made[:10]]
    texts = [(i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(60))) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2).cache()
    df.count()

    def seconds(n):
        given = table(spark, [(i, t, "word", "k", "warning", "s") for i, t in enumerate(made[:n])])
        best = []
        for _ in range(3):
            began = time.time()
            rules.check_rules(df, given, whole=True).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        return min(best)

    few, many = seconds(10), seconds(1000)
    df.unpersist()
    assert many < 2 * few, (few, many)


# -- statements ------------------------------------------------------------------------


def judged(text, rule):
    """(present, line, issues) of one rule by the plain reading of its words."""
    blocks, line = [], 1
    for part in re.split(r"(\n\s*\n)", text or ""):
        if part.strip():
            blocks.append((part, line))
        line += part.count("\n")
    holds = lambda t, xs: any(x.lower() in t.lower() for x in xs)
    hint = f" ({rule[5]})" if rule[5] else ""
    for i, (part, line) in enumerate(blocks):
        if holds(part, rule[2]):
            whole = part + ("\n" + blocks[i + 1][0] if len(part.strip()) < 60 and i + 1 < len(blocks) else "")
            wants = [f"does not mention {' / '.join(g)}{hint}" for g in rule[3] if not holds(whole, g)]
            return True, line, wants + [f"must not say {b}{hint}" for b in rule[4] if holds(whole, [b])]
    return False, 0, ["missing" + hint]


STATEMENTS = [
    ("conflict", "Conflict", ["conflict of interest", "competing interest"], [["interest"], ["no ", "none"]], [], "name them"),
    ("data", "Data", ["data availability"], [["archive", "repository"]], ["on request"], ""),
    ("funding", "Funding", ["funding", "grant"], [], ["private"], "say who"),
    ("ethics", "Ethics", ["ethics"], [["board"], []], [], None),
]
REQUIRED = [("a", 2, "data"), ("a", 1, "conflict"), ("b", 1, "funding"), ("b", 2, "ethics"), ("b", 3, "nowhere"), ("", 1, "data"), (None, 2, "conflict")]
PAPERS = [
    "Conflict of interest\n\nThe authors declare none.\n\nData availability: all is in the archive, on Request.",
    "x\n\n\n  \nFunding\n\nA private grant, from here to there.\n\nEthics: the board agreed to all of it, and wrote so in a long letter to us all.",
    "Competing Interest: no conflict of any kind is known to any of the authors of this.\n\nno more",
    "Data availability",
    "", None, "ETHICS\n \n\nBoard\n\ndata availability is a thing that this long paragraph says nothing more about, at all",
]


@pytest.mark.parametrize("most", [rules.LEXICON_BYTES, 200])
def test_statements_from_a_table(spark, most):
    made = spark.createDataFrame(STATEMENTS, declarations.STATEMENT_ROWS)
    asked = spark.createDataFrame(REQUIRED, declarations.REQUIRED_ROWS)
    docs = [(i * 10 + j, t, journal) for i, t in enumerate(PAPERS) for j, journal in enumerate(["a", "b", "", "unknown", None])]
    df = spark.createDataFrame(docs, "doc_id long, text string, journal string")
    got = {(r["doc_id"], r["key"]): (r["ord"], r["journal"], r["present"], r["line"], r["issues"]) for r in declarations.check_statement_rules(df, made, asked, most=most).collect()}
    want, by_key = {}, {r[0]: r for r in STATEMENTS}
    for i, t, journal in docs:
        journal = journal if journal in ("a", "b") else ""
        for j, n, key in REQUIRED:
            if (j or "") == journal and key in by_key:
                want[i, key] = (n, journal, *judged(t, by_key[key]))
    assert got == want
    assert declarations.check_statement_rules(df, made.limit(0), asked).count() == 0
    assert declarations.check_statement_rules(df.limit(0), made, asked).count() == 0


def test_a_table_of_statements_judges_as_columns_do(spark):
    rows = [(s.key, s.label, list(s.cues), [list(g) for g in s.needs], list(s.forbids), s.hint) for s in policy.STATEMENTS.values()]
    made = spark.createDataFrame(rows, declarations.STATEMENT_ROWS)
    asked = spark.createDataFrame([("", i, s) for i, s in enumerate(policy.STATEMENTS)], declarations.REQUIRED_ROWS)
    df = spark.createDataFrame(list(enumerate(PAPERS)), "doc_id long, text string").withColumn("journal", F.lit("x"))
    got = sorted((r["doc_id"], r["key"], r["label"], r["present"], r["line"], r["issues"]) for r in declarations.check_statement_rules(df, made, asked).collect())
    want = declarations.check_statements(df).select("doc_id", F.explode("statements").alias("s")).select("doc_id", "s.*")
    assert got == sorted((r["doc_id"], r["key"], r["label"], r["present"], r["line"], r["issues"]) for r in want.collect())


# -- time ----------------------------------------------------------------------------


@pytest.mark.parametrize("what", ["blocks", "renumber"])
def test_long_documents_take_linear_time(spark, what):
    def run(n):
        if what == "blocks":
            df = spark.createDataFrame([("\n\n".join(f"Paragraph {i}" for i in range(n)),)], "text string")
            ask = df.select(F.element_at(declarations.blocks(F.col("text")), -1)["line"].alias("x"))
        else:
            body = "1 Introduction\nSee [2] and [1].\n\nReferences\n" + "\n".join(f"[{i % 900 + 1}] Adams, a title, 2001." for i in range(n))
            df = spark.createDataFrame([(body,)], "text string")
            ask = numbering.renumber(df).select(F.length("renumbered").alias("x"))
        began = time.time()
        assert ask.first()["x"] > n
        return time.time() - began

    run(500)
    small, large = run(4000), run(64000)
    assert large < 48 * max(small, 0.5), (small, large)
