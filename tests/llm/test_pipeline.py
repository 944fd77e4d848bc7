"""The pipeline's stages on a small table, and what __spark_entry__ registers."""

import zlib

import corpus_pipeline as P
import __spark_entry__ as entry
from quillon.llm.queries import ORACLES, QUERIES

EN = "the of and to in that was his with for on are"
DE = "der die und zu den das nicht von sie ist des sich"


def documents(spark):
    text = lambda words, i: " ".join(words.split()[(i * 7 + j * (1 + i % 5)) % 12] + ("" if j % 9 else str(i)) for j in range(60 + i))
    rows = [(i, text(EN, i), "en", f"s{i % 3}", 0) for i in range(40)] + [(100 + i, text(DE, i), "de", None, 0) for i in range(40)]
    rows += [(200, text(EN, 3), "en", "s0", 0), (201, text(EN, 3).upper() + " more", "en", "s1", 0), (202, None, "en", "s0", 0), (203, "12 34", "en", "s0", 0), (3, text(EN, 3), "en", "s0", 0), (300, text(EN, 9) + " write to a.b@c.de or +1 555 555 5555", "en", "s2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = documents(spark)
    kept = P.language(spark, docs, "")
    assert kept.columns == list(P.COLUMNS)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in (202, 203))
    single = P.near_duplicates(spark, kept, "")
    left = sorted(r["doc_id"] for r in single.collect())
    assert left == sorted(set(ids) - {200, 201, 300})
    clean = P.personal_data(spark, kept, "")
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[300]["text"].endswith("write to [EMAIL] or [PHONE]") and texts[300]["n_chars"] == len(texts[300]["text"])
    mix = P.mixed(spark, single, "")
    total = sum(len(r["text"].split()) for r in single.collect())
    assert abs(sum(len(r["text"].split()) for r in mix.collect()) - 1.5 * total) < 120
    out = P.tokens(spark, mix, "")
    assert out.count() == mix.count() and out.filter("n_tokens = 0").count() == 0
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_edge_cases(spark):
    """Null ids, ids that repeat with other texts, null and very long texts, columns of clashing names."""
    text = lambda s: " ".join(f"{w}{s}" for w in EN.split() * 3)
    rows = [(1, text("a"), "s"), (1, text("b"), "s"), (1, text("b"), "s"), (None, text("b") + " more", "s"), (None, text("c"), None), (None, text("c"), None), (None, text("d"), "s"), (2, None, "s"), (2, None, "s"), (3, "word " * 40_000 + "x@y.zz", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, size long, mark string")
    single = P.near_duplicates(spark, docs, "")
    assert single.columns == list(P.COLUMNS)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in single.collect()], key=key) == sorted([(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (2, None), (2, None), (3, rows[-1][1])], key=key)
    clean = P.personal_data(spark, docs, "").collect()
    assert len(clean) == len(rows) and next(r for r in clean if r["doc_id"] == 3)["text"].endswith("word [EMAIL]") and sum(r["text"] is None for r in clean) == 2
    mix = [(r["doc_id"], r["text"]) for r in P.mixed(spark, single, "").collect()]
    assert set(mix) <= {(r["doc_id"], r["text"]) for r in single.collect()} and max(mix.count(x) for x in mix) <= 2 and (None, text("d")) in mix or (None, text("c")) in mix
    assert P.tokens(spark, docs, "").count() == len(rows)


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert zlib.crc32(b"12") % 3 in (0, 1, 2)
