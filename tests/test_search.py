"""The bibliographic index against scoring every record."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import storage
from quillon.operators import records, search

REG = "source string, priority int, doi string, title string, authors array<string>, year int, volume string, first_page string"
WORDS = ["study", "phase", "salts", "glass", "irons", "pores", "films", "melts", "rings", "flows", "waves", "grain", "layer", "steam", "ester"]


def library(spark, rng, n):
    rows = []
    for i in range(n):
        title = " ".join(["study", *rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(0, 8))])
        rows.append(("s", 0, None if i % 9 == 0 else f"10.1000/{rng.randint(0, n)}", title.capitalize(), [f"Ann {rng.choice(['Berg', 'Kole'])}"], 2000, None, None))
    rows += [("s", 0, "10.1000/none", "Of the in", ["X Y"], 2000, None, None), ("s", 0, None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, REG), rows


def plain(entry, rows):
    words = set((entry or "").lower().replace(",", " ").split())
    best = None
    for _, _, doi, title, authors, *_ in {(*r[:4], tuple(r[4] or ()), *r[5:]) for r in rows}:
        telling = {w for w in (title or "").lower().split() if len(w) > 3 and w not in records.STOPWORDS}
        if telling & words:
            name = (authors[0] if authors else "").lower()
            rank = (-len(telling & words) / len(telling), -len(title), doi is None, doi or "", title, name)
            best = min(best, rank) if best else rank
    return None if best is None else (-best[0], best[3] or None, best[4], best[5])


@pytest.mark.parametrize(("block", "asked"), [(1024, 50_000), (3, 4)])
def test_search_is_that_of_all_records(spark, tmp_path, monkeypatch, block, asked):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "ASKED", asked)
    rng = random.Random(block)
    registry, rows = library(spark, rng, 150)
    entries = [(i, 0, "Berg A, " + ", ".join(rng.choices([*WORDS, "other", "words"], k=rng.randint(1, 12)))) for i in range(200)]
    entries += [(300, 0, "study"), (301, 0, None), (302, 0, ""), (303, 0, "nothing known here"), (1, 0, entries[1][2]), (None, None, "glass study")]
    df = spark.createDataFrame(entries, "doc_id long, ord int, entry string")
    index = search.build(registry, f"file://{tmp_path}/index")
    got = sorted(((r["doc_id"], r["ord"], r["share"], r["doi"], r["title"], r["first"]) for r in search.search(df, index).collect()), key=str)
    want = []
    for i, n, entry in entries:
        p = plain(entry, rows)
        want.append((i, n, *(p if p else (0.0, None, None, None))))
    assert got == sorted(want, key=str)
    again = search.Index.open(spark, f"file://{tmp_path}/index")
    assert search.search(df, again).count() == len(entries) and search.search(df.limit(0), again).count() == 0
    empty = search.build(registry.limit(0), f"file://{tmp_path}/empty")
    assert {r["share"] for r in search.search(df, empty).collect()} == {0.0}


def test_answered_entries_read_no_frequent_word(spark, tmp_path, monkeypatch):
    """A word of every title has bounds of 1 / n, and what a rare word answers never asks for it."""
    rows = [("s", 0, f"10.1000/{i}", f"study salts phase special{i}", ["A B"], 2000, None, None) for i in range(300)]
    index = search.build(spark.createDataFrame(rows, REG), f"file://{tmp_path}/index")
    frequent = index.words.filter("word = 'study'").first()
    assert frequent["df"] == 300
    bands = index.stats.filter(F.col("w") == frequent["id"]).collect()
    assert [r["band"] for r in bands] == [search.BANDS - 2] and index.blocks.filter(F.col("w") == frequent["id"]).agg(F.max("best")).first()[0] == 0.25
    made, put = [], storage.Scratch.put
    monkeypatch.setattr(storage.Scratch, "put", lambda self, name, *rest: made.append(name) or put(self, name, *rest))
    entries = spark.createDataFrame([(i, 0, f"study salts phase special{i}") for i in range(300)], "doc_id long, ord int, entry string")
    assert search.search(entries, index).filter("share = 1").count() == 300
    assert [n for n in made if n.startswith("state")] == ["state0", "state1"]


def test_entries_are_all_judged(spark):
    rows = [("s", 0, "10.1000/a", "Flows of salt in pores", ["Bo Adams"], 2001, None, None), ("s", 0, "10.1000/b", "Melts of glass", ["Cy Baker"], 2002, None, None)]
    entries = [(1, i, f"Adams B. Flows of salt in pores, no. {i}") for i in range(250)] + [(2, 0, "Dunn E. Melts of glass, 2002"), (2, 1, "Eads F. Other things altogether"), (2, 2, "doi 10.1000/B"), (2, 3, "Zed, melts, 10.1000/zz"), (2, 4, "Melts of nothing")]
    df = spark.createDataFrame(entries, "doc_id long, ord int, entry string")
    got = {(r["doc_id"], r["ord"]): (r["verdict"], r["title"]) for r in records.audit_entries(df, spark.createDataFrame(rows, REG)).collect()}
    assert len(got) == 255 and all(got[1, i] == ("match", "Flows of salt in pores") for i in range(250))
    assert [got[2, i] for i in range(5)] == [("check", "Melts of glass"), ("no-match", None), ("match", "Melts of glass"), ("no-match", None), ("no-match", "Melts of glass")]
    assert records.audit_entries(df, spark.createDataFrame(rows, REG), most=200).count() == 205


def test_equal_sets_of_words_are_one_posting_and_one_question(spark, tmp_path, monkeypatch):
    """Copies of a title under other DOIs and entries of the same words do not meet in pairs."""
    rows = [("s", 0, f"10.1000/{i:04}", f"Study of {'the ' * (i % 3)}salts", ["A B"], 2000, None, None) for i in range(300)]
    index = search.build(spark.createDataFrame(rows, REG), f"file://{tmp_path}/index")
    assert index.blocks.select(F.explode("postings")).count() == 2
    sizes, put = {}, storage.Scratch.put

    def kept(self, name, *rest):
        out = put(self, name, *rest)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(storage.Scratch, "put", kept)
    entries = spark.createDataFrame([(i, 0, f"{i} on salts and study") for i in range(400)], "doc_id long, ord int, entry string")
    assert {(r["share"], r["doi"]) for r in search.search(entries, index).collect()} == {(1.0, "10.1000/0002")}
    assert (sizes["state0"], sizes["state1"]) == (1, 1)
