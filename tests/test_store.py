"""The store of answers: nothing is asked twice, failures and late answers find their place."""

import datetime
import json
import random
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.operators import records
from quillon.sources.store import ANSWER, Service, Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no test modules
T0 = datetime.datetime(2024, 5, 1, 12)
REF = "key string, title string, authors array<string>, year int, doi string, volume string, first_page string, truncated boolean"


def hours(n):
    return T0 + datetime.timedelta(hours=n)


def refs(spark, dois):
    return spark.createDataFrame([(f"k{i}", f"Work {d}", ["Ana Berg"], 2001, d, None, None, False) for i, d in enumerate(dois)], REF)


def first(doi):
    if doi.endswith("bad"):
        raise OSError("no answer")
    return None if doi.endswith("none") else json.dumps({"message": {"title": [f"Work {doi}"], "author": [{"given": "Ana", "family": "Berg"}], "issued": {"date-parts": [[2001]]}}})


def second(doi):
    return None if doi.endswith("x-none") else json.dumps({"id": "W1", "display_name": f"Second {doi}", "publication_year": 2001})


def broken(doi):
    raise AssertionError("asked again")


def test_a_second_run_asks_for_nothing(spark, tmp_path):
    dois = ["10.1000/A", "10.1000/a", " 10.1000/b", "10.1000/none", "10.1000/x-none", "10.1000/bad", None, ""]
    store, given = Store(spark, f"file://{tmp_path}/s"), refs(spark, dois)
    assert store.states().count() == 0 and store.registry().count() == 0
    assert store.fill(given, [Service("openalex", 1, second), Service("crossref", 0, first)], hours(0)) == {"crossref": 5, "openalex": 3}
    got = {(r["doi"].split("/")[1], r["source"]): (r["state"], r["attempts"]) for r in store.states().collect()}
    assert got == {("a", "crossref"): ("known", 0), ("b", "crossref"): ("known", 0), ("none", "crossref"): ("unknown", 0), ("x-none", "crossref"): ("unknown", 0), ("bad", "crossref"): ("failed", 1), ("none", "openalex"): ("known", 0), ("x-none", "openalex"): ("unknown", 0), ("bad", "openalex"): ("known", 0)}
    again = [Service("crossref", 0, broken), Service("openalex", 1, broken)]
    assert store.fill(given, again, hours(0.5)) == {"crossref": 0, "openalex": 0}
    # the failure is asked again when its time has come, new references at once
    more = refs(spark, [*dois, "10.1000/new"])
    assert store.fill(more, [Service("crossref", 0, first), Service("openalex", 1, broken)], hours(2)) == {"crossref": 2, "openalex": 0}
    assert store.states().filter("state = 'failed'").first()["attempts"] == 2
    assert store.fill(more, [Service("crossref", 0, lambda d: first("ok"))], hours(4)) == {"crossref": 1}
    assert store.states().filter("state = 'failed'").count() == 0
    checked = {r["doi"]: (r["source"], r["status"]) for r in records.check(refs(spark, ["10.1000/A", "10.1000/none", "10.1000/x-none"]), store.registry()).collect()}
    assert checked == {"10.1000/A": ("crossref", "ok"), "10.1000/none": ("openalex", "suspect"), "10.1000/x-none": ("", "broken")}


def test_failures_are_not_asked_for_ever(spark, tmp_path):
    store, given = Store(spark, f"file://{tmp_path}/s"), refs(spark, ["10.1000/bad"])
    counts = [store.fill(given, [Service("crossref", 0, first)], hours(2 * i), attempts=3)["crossref"] for i in range(5)]
    assert counts == [1, 1, 1, 0, 0]


def test_late_answers_in_any_order(spark, tmp_path):
    """What is known does not depend on the order or the repetition of answers."""
    rng = random.Random(2)
    rows = []
    for i in range(120):
        state = rng.choice(["known", "unknown", "failed"])
        rows.append((f"10.1000/{rng.randint(0, 15)}", rng.choice(["crossref", "openalex"]), 0, hours(rng.randint(0, 9)), state, rng.randint(1, 4) if state == "failed" else 0, f"body {i}" if state == "known" else None))
    best = {}
    for doi, source, _, at, state, attempt, body in rows:
        rank = (state != "failed", at, state == "known", body or "")
        old = best.get((doi, source), (None, 0))
        best[doi, source] = (max(old[0], (rank, state, body)) if old[0] else (rank, state, body), max(old[1], attempt))
    want = {k: (v[0][1], v[0][2], v[1]) for k, v in best.items()}
    for turn in range(2):
        rng.shuffle(rows)
        store = Store(spark, f"file://{tmp_path}/s{turn}")
        for part in (rows[:50], rows[50:], rows[:30]):
            store._append(spark.createDataFrame(part, ANSWER))
        read = lambda: {(r["doi"], r["source"]): (r["state"], r["body"], r["attempts"]) for r in store.states().collect()}
        assert read() == want
        store.compact()
        assert len(store._runs()) == 1 and read() == want and store.log().count() == len(want)
        store.merge(spark.createDataFrame([("10.1000/0", "crossref", 0, hours(-1), "too old"), ("10.1000/1", "crossref", 0, hours(99), None), (" ", "crossref", 0, hours(1), "x")], "doi string, source string, priority int, asked_at timestamp, body string"))
        now = read()
        assert now["10.1000/1", "crossref"][0] == "unknown"
        assert now["10.1000/0", "crossref"] == want["10.1000/0", "crossref"] or want["10.1000/0", "crossref"][0] == "failed"


def test_a_run_that_broke_off_is_none(spark, tmp_path):
    store, given = Store(spark, f"file://{tmp_path}/s"), refs(spark, ["10.1000/a", "10.1000/b"])
    store.fill(given, [Service("crossref", 0, first)], hours(0))
    half = tmp_path / "s" / "run-half"
    spark.createDataFrame([("10.1000/c", "crossref", 0, hours(0), "known", 0, "x")], ANSWER).write.parquet(f"file://{half}")
    (half / "_SUCCESS").unlink()
    assert store.states().count() == 2 and store.states().filter(F.col("doi") == "10.1000/c").count() == 0
