"""The operators that use Arrow: held against brute force, held-out rows and round trips."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, extract, jaccard, langid, quality, sptokens, topk, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "é", "a\x85b\xa0c  d", "Ein ÄÖ Ü ß", "x " * 30_000, "🙂 A a\r\nB"]


def test_words_of_batches():
    texts = pa.array(ODD)
    data, at = common.bytes_of(texts)
    starts, ends, upto = common.word_spans(data, at)
    for i, t in enumerate(ODD):
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[upto[i] : upto[i + 1]], ends[upto[i] : upto[i + 1]], strict=True)]
        assert got == WORDS.findall(t or "")
    every = sorted({w for t in ODD for w in WORDS.findall(t or "")} | {f"{a}{b}" for a, b in itertools.product("abcdefghij" * 3, range(300))})
    data, at = common.bytes_of(pa.array(every))
    starts, ends, _ = common.word_spans(data, at)
    assert len(set(common.word_hashes(data, starts, ends, exact=True).tolist())) == len(every)


# -- Jaccard join ------------------------------------------------------------------


def shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    label = {k: i for k, (i, _) in enumerate(sets)}
    links = [(a, b) for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted((i, len(s), label[k]) for k, (i, s) in enumerate(sets))


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary, 40))
    texts = []
    for g in range(25):  # groups of near copies, chains, a passage that many share
        words = rng.choice(vocabulary, rng.integers(5, 120)).tolist()
        for _ in range(rng.integers(1, 9)):
            if rng.random() < 0.7:
                words = list(words)
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words) + (" " + passage if rng.random() < 0.3 else ""))
    texts += [None, "", " ", "a b", "A b", "a b c", passage, passage, "x " * 20_000]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rows.append(rows[4])
    docs = spark.createDataFrame([(i, t, "set", 1) for i, t in rows], "doc_id long, text string, `set` string, id int")
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs.repartition(5)).collect())
    assert got == components(rows)
    assert jaccard.join(docs.limit(0)).count() == 0
    bare = jaccard.join(docs, links=False)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in bare.collect()) == got and bare.filter("n_links IS NOT NULL").count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_links_inside_components_are_all_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "y"])]  # each linked with both others
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 40, 4)]  # a component whose ends are not linked
    for g in range(6):
        start = [f"g{g}_{i}" for i in rng.integers(0, 90, 80)]
        for _ in range(14):
            copy = list(start)
            for i in rng.integers(0, 80, rng.integers(0, 4)):
                copy[i] = f"n{rng.integers(1000)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[5], "alone in the whole table here", None]
    each = [shingles(t) for t in texts]
    classes = {frozenset(s) for s in each if s}
    degree = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in classes) for a in classes}
    got = {r["id"]: r["n_links"] for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert [got[i] for i in range(3)] == [2, 2, 2]
    assert got == {i: degree.get(frozenset(s), 0) for i, s in enumerate(each)}


@pytest.mark.parametrize("links", [1 << 20, 6])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(jaccard, "LINKS", links)
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(100, 118)] + [(900, i) for i in range(910, 925)] + [tuple(int(x) for x in e) for e in rng.integers(1000, 1040, (20, 2))] + [(5, 5)]
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert sorted(map(tuple, got)) == sorted((n, label[n]) for n in linked)


@pytest.mark.parametrize("long_", [1 << 18, 4])
def test_lists(monkeypatch, long_):
    """Lists do not depend on batches, and no entry is closed that has a partner."""
    monkeypatch.setattr(jaccard, "LONG", long_)
    rng = np.random.default_rng(1)
    size = {b: int(rng.integers(8, 40)) for b in range(30)}
    rows = sorted({(a, -1 if a % 3 else b % 2, size[b], int(p), b) for a, b, p in ((int(x), int(y), rng.integers(0, 9)) for x, y in rng.integers(0, 30, (300, 2)) // [3, 1])}, key=lambda r: r)
    seen, unique = set(), []
    for r in rows:  # a set is in a list once
        if (r[0], r[4]) not in seen:
            seen.add((r[0], r[4]))
            unique.append(r)
    rows = sorted([*unique, *unique[::5]])  # but copies may come from several tasks
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kinds[i]) for i in (0, 1, 4, 2, 3)], ["shingle", "part", "set", "n", "pos"])
    for step in (1, 2, 7, len(rows)):
        out = [tuple(r.values()) for b in jaccard._lists(80)([batch(rows[i : i + step]) for i in range(0, len(rows), step)]) for r in b.to_pylist()]
        listed = {}
        for a, p, n, pos, b in unique:
            listed.setdefault((a, p), []).append((b, n, pos))
        want = sorted((a, b, n, pos) for (a, p), v in listed.items() for b, n, pos in v if len(v) > 1 or p >= 0)
        if long_ > len(rows):
            assert sorted(r[:4] for r in out) == want
        assert set(want) <= {r[:4] for r in out}
        open_ = {r[:2] for r in out if r[4]}
        for (a, _), v in listed.items():
            for (x, n, i), (y, m, j) in itertools.permutations(v, 2):
                if 100 * n >= 80 * m and 100 * m >= 80 * n and 180 * (min(n - i, m - j) + min(n, m) // jaccard.MORE) >= 80 * (n + m):
                    assert (a, x) in open_
        assert long_ == 4 or len(open_) < len(want)


@pytest.mark.parametrize("small", [False, True])
def test_join_of_groups(spark, monkeypatch, small):
    """Groups of near copies, close groups that are not linked, common passages and
    chains, with the limits of the method in use and lowered so that all of it runs."""
    if small:
        for name, value in {"PART": 5, "LOCAL": 1, "HEAVY": 40, "MORE": 10, "BLOCK": 4, "BLOCK_SHINGLES": 400, "LONG": 6, "FEW": 3, "LINKS": 30}.items():
            monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(45)]
    texts = []
    for g in range(8):
        start = [f"g{g}_{i}" for i in range(int(rng.integers(30, 120)))]
        if g % 2:
            start += passage
        for _ in range(24):
            copy = list(start)
            for i in rng.integers(0, len(copy), rng.integers(0, 6)):
                copy[i] = f"n{rng.integers(60)}"
            texts.append(" ".join(copy))
        texts += [" ".join(start[: len(start) - c]) for c in (6, 12, 25)]
    texts += [" ".join([f"u{i}_{j}" for j in range(12)] + passage) for i in range(60)]
    texts += [texts[1], texts[40], None, "", "one two"]
    rows = list(enumerate(texts))
    each = [shingles(t) for t in texts]
    classes = {frozenset(s) for s in each if s}
    degree = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in classes) for a in classes}
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows)
    assert {r["id"]: r["n_links"] for r in got} == {i: degree.get(frozenset(s), 0) for i, s in enumerate(each)}


# -- top k ---------------------------------------------------------------------------


@pytest.mark.parametrize("wave", [4096, 2])
def test_top_k_against_brute_force(spark, wave):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(230)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)]  # ties
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (None, vectors[0][1]), (500, [1.0, 2.0]), (600, []), (601, [3.0, -1.0])]
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {}
    for r in topk.top_k(rows, F.col("vec_id") % 100 == 0, k=10, wave=wave).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in good:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:10]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) <= {q for q, _ in good if q % 100 == 0}
    assert topk.top_k(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**40, 3.0]])
    assert topk.products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]
    # the bound on a large component does not decide, the score does
    assert topk.products(np.array([[2.0**50, 1.0, 0.0]]), np.array([[0.0, 5.0, 2.0**50], [8.0, 1.0, 0.0]])).tolist() == [[5, 2**53 + 1]]
    with pytest.raises(OverflowError):
        topk.products(a, np.array([[2.0**40, 1.0]]))


# -- language ------------------------------------------------------------------------


def test_language(spark):
    make = lambda seed, words, n: [" ".join(np.random.default_rng(seed + i).choice(words, 40)) for i in range(n)]
    one, two = "the of and to in that was his with".split(), "der die und zu den das nicht von sie".split()
    rows = [(i, t, "en") for i, t in enumerate(make(0, one, 30))] + [(100 + i, t, "de") for i, t in enumerate(make(50, two, 30))] + [(200, None, "en"), (201, "12 !!", "en"), (202, "", None), (203, "the of " * 9000, None)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.learn(docs.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, t, lang in rows[:60])
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "und", "en"] and not got[200]["lang_ok"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) == {} and langid.identify(docs.limit(0), model).count() == 0


def test_language_against_plain_compression(spark):
    """Every guess is that of one compressor a language over the whole text in pieces."""
    import zstandard

    rng = np.random.default_rng(3)
    words = {"en": "the of and to in that was his with as".split(), "de": "der die und zu den das nicht von sie ist".split(), "fr": "le de et la les des en un du dans".split()}
    rows = [(i, " ".join(rng.choice(words[x], rng.integers(1, 60))), x) for i, x in enumerate(str(rng.choice(list(words))) for _ in range(300))]
    rows += [(400, "the der " * 9000, "en"), (401, "½", "de"), (402, "² ³ 12", None), (403, "É", None), (404, rows[0][1], None), (405, rows[0][1], "en"), (406, None, "en"), (None, "le de et", "fr")]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double")
    learnt = langid.learn(docs.filter(langid.remainder(F.col("doc_id")) != 1))
    got = [r.asDict() for r in langid.identify(docs, learnt).collect()]

    def size(data, name):
        made = zstandard.ZstdCompressionDict(learnt[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(press.compress(data[i : i + langid.PIECE] + langid.FILL)) for i in range(0, len(data), langid.PIECE))

    for r in got:
        if r["doc_id"] in (401, 402, 406):
            assert (r["lang_pred"], r["score"], r["lang_ok"]) == ("und", 0.0, False)
            continue
        sizes = [size(langid.plain(r["text"]), name) for name in learnt]
        assert r["lang_pred"] == list(learnt)[sizes.index(min(sizes))]  # of equal sizes the more frequent language
        assert r["lang_ok"] == ((sorted(sizes)[1] - min(sizes)) / sorted(sizes)[1] >= langid.NARROW)
    of = {r["doc_id"]: (r["lang_pred"], r["score"], r["lang_ok"]) for r in got}
    assert of[0] == of[404] == of[405]
    # a prediction depends on the text alone
    other = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert {r["doc_id"]: (r["lang_pred"], r["score"], r["lang_ok"]) for r in langid.identify(other, learnt).collect()} == of


def test_held_out_rows_teach_nothing(spark, tmp_path):
    import zlib

    rows = [(i, "wort zahl haus" if zlib.crc32(str(i).encode()) % 3 == 1 else "word number house", "de" if zlib.crc32(str(i).encode()) % 3 == 1 else "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op9_langid(spark, str(tmp_path)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["lang_pred"] == "en" for r in got) and len(got) == 60


# -- quality -------------------------------------------------------------------------


def counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit)


def test_quality_counts_against_brute_force(spark):
    texts = [*[t for t in ODD if len(t or "") < 1000], "a b c a b c a", "Ab\nab\nAb\n\n \nab", "x\r\nx\nx\r", "# | <é>\n# | <é>", "\n".join(["one two three"] * 9), "a b\n" * 300 + "end"]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    field = quality.Field(np.zeros(len(quality.FEATURES)), np.zeros((2, 2)))
    for r in quality.judge(rows, field).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert quality.judge(rows.limit(0), field).count() == 0


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(30):
        field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
        x = rng.normal(size=(7, 3))
        value = lambda y: sum((x[t] @ field.weights) * y[t] for t in range(7)) + sum(field.moves[y[t], y[t + 1]] for t in range(6))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=7), key=value)
        assert field.content(x).astype(int).tolist() == list(best)


def by_differences(loss, at, step=1e-6):
    return [(loss(at + step * e) - loss(at - step * e)) / (2 * step) for e in np.eye(len(at))]


def test_field_likelihood_against_all_labellings():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(4, 5, 3)), rng.integers(0, 2, (4, 5))
    mask = np.arange(5)[None, :] < np.array([5, 3, 1, 4])[:, None]
    theta, ridge = rng.normal(size=7), 0.1
    moves = theta[3:].reshape(2, 2)
    value = lambda n, own: sum((x[n, t] @ theta[:3]) * own[t] for t in range(len(own))) + sum(moves[a, b] for a, b in itertools.pairwise(own))
    loss = 0.0
    for n in range(4):
        k = mask[n].sum()
        loss += np.log(sum(np.exp(value(n, own)) for own in itertools.product((0, 1), repeat=k))) - value(n, y[n, :k])
    got, grad = quality.slopes(theta, x, y, mask, ridge)
    assert got == pytest.approx(loss / mask.sum() + ridge / 2 * theta @ theta)
    assert grad == pytest.approx(by_differences(lambda at: quality.slopes(at, x, y, mask, ridge)[0], theta), abs=1e-6)


def test_very_long_and_repeated_texts_are_labelled_whole(spark):
    field = quality.Field(np.eye(len(quality.FEATURES))[5] * -9 + np.eye(len(quality.FEATURES))[0], np.eye(2))
    text = "\n".join([*[f"Line {i} of the text, and a few more words, all told." for i in range(20000)], *["a | b | c | d"] * 30000])
    rows = spark.createDataFrame([(1, text, 7), (2, None, 7), (1, text, 7), (3, "", 7)], "doc_id long, text string, kept int")
    got = quality.judge(rows, field)
    assert got.columns == ["doc_id", "text", *quality.NEW]
    by_id = {r["doc_id"]: r for r in got.collect()}
    content = sum(len(w) for i in range(20000) for w in f"Line {i} of the text, and a few more words, all told.".split())
    assert got.count() == 4 and by_id[1]["content_share"] == pytest.approx(content / (content + 7 * 30000))
    assert by_id[2]["base_failed"] and by_id[3]["base_failed"]


def test_quality_learns_junk_lines(spark):
    rng = np.random.default_rng(0)
    good = ["\n".join(" ".join(f"word{n}" for n in rng.integers(0, 500, 9)) + "." for _ in range(20)) for _ in range(40)]
    bad = ["\n".join(f"AB| {j} ### | $$$ {i} |||" for j in range(20)) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(0, 80, 2)] + [(1, None), (None, 1), (999, 0)], "doc_id long, quality int")
    field = quality.train(rows, labels)
    assert {r["doc_id"]: r["kept"] for r in quality.judge(rows, field).collect()} == {i: i < 40 for i in range(80)}
    assert quality.train(rows, labels.filter("quality = 1")).moves.tolist() == [[0, 0], [0, 0]]


# -- toxicity ------------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    calm = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join([*rng.choice(calm, 60), *["vile", "foul", "mean"][:n]])
    rows = [(i, text(0 if i < 200 else 1 + i % 3)) for i in range(300)] + [(900, None), (901, ""), (902, "VILE. " * 9000)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, toxic boolean")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(300) if i % 4] + [(5000, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["toxic"] == (i >= 200) for i in range(300))
    assert not got[900]["toxic"] and not got[901]["toxic"] and got[902]["toxic"]
    by_hits = [np.mean([got[i]["severity"] for i in range(200, 300) if 1 + i % 3 == n]) for n in (1, 2, 3)]
    assert by_hits == sorted(by_hits)
    assert set(toxicity.train(docs, labels.filter("toxic = 0")).thresholds) == {np.inf}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ordinal_likelihood_and_gradient():
    rng = np.random.default_rng(4)
    rows, columns = np.repeat(np.arange(12), 3), rng.integers(0, 4, 36)
    grades = np.r_[0, 1, 2, 3, rng.integers(0, 4, 8)]
    w, t, ridge = rng.normal(size=4), np.array([0.3, -0.5, 0.2]), 0.05
    theta = np.array([0.3, 0.3 + np.exp(-0.5), 0.3 + np.exp(-0.5) + np.exp(0.2)])
    loss = 0.0
    for n in range(12):
        z = sum(w[c] for r, c in zip(rows, columns, strict=True) if r == n)
        upto = [0.0, *(1 / (1 + np.exp(z - theta))), 1.0]
        loss -= np.log(upto[grades[n] + 1] - upto[grades[n]]) / 12
    got, grad = toxicity.slopes(w, t, rows, columns, grades, ridge)
    assert got == pytest.approx(loss + ridge / 2 * w @ w)
    assert grad == pytest.approx(by_differences(lambda at: toxicity.slopes(at[:4], at[4:], rows, columns, grades, ridge)[0], np.r_[w, t]), abs=1e-6)


def heads_and_words(text):
    """Each word and each head of a longer word, with the number of words that have it."""
    words = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")}
    heads = [(w[:k], k) for w in words for k in toxicity.HEADS if len(w) > k]
    return {(w, 0): 1 for w in words} | {h: min(heads.count(h), toxicity.TIMES) for h in heads}


def test_severity_against_plain_words():
    texts = [*ODD, "Achlichung achlichte, ACHLICHTE achlichen achlichst!", "\u00e9t\u00e9s-\u00e9t\u00e9s \u00e9t\u00e9sien", "idiots" * 3, "abc\u00df " * 4000, "abcd abcde"]
    key = lambda h: int(common.mix(common.word_hashes(*spans(h[0])) + np.uint64(h[1]))[0]) if h[1] else int(common.word_hashes(*spans(h[0]))[0])
    spans = lambda w: (np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(w.encode())]))
    known = {key(h): h for text in texts for h in heads_and_words(text)}
    words = np.array(sorted(known)[::2], np.uint64)
    model = toxicity.Ordinal(words, np.random.default_rng(5).normal(size=len(words)), np.array([0.1, 0.9, 1.5]))
    weight = {known[int(h)]: w for h, w in zip(words, model.weights, strict=True)}
    with np.errstate(over="ignore"):
        got = model.score(pa.array(texts))
    for text, s in zip(texts, got, strict=True):
        z = sum(weight.get(h, 0.0) * n for h, n in heads_and_words(text).items())
        assert s == pytest.approx(sum(1 / (1 + np.exp(t - z)) for t in model.thresholds)), text


def test_grades_that_labels_have_are_learned(spark):
    rng = np.random.default_rng(6)
    words = ["calmly", "rudeness", "nastiest", "vilest"]
    rows = [(i, " ".join([*(f"word{n}" for n in rng.integers(0, 60, 30)), words[i % 4]]), "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:8]], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, i % 4 if i % 8 != 7 else 9) for i in range(400) if i % 5] + [(1, -3), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.columns == ["doc_id", "text", "severity", "grade", "toxic"] and got.count() == 408
    assert all(r["grade"] == r["doc_id"] % 4 for r in got.collect())


def test_graded_by_the_other_half():
    """A word that one document alone has lifts no grade; thirds are by log odds."""
    bad = np.arange(600) < 120
    own = [[*range(i % 3 + 1), 10 + i] for i in range(120)] + [[5]] * 480
    row = np.repeat(np.arange(600), [len(x) for x in own])
    grades = toxicity.graded(row, np.concatenate(own), bad, 200)
    assert (grades[~bad] == 0).all() and set(grades[bad]) <= {1, 2, 3}
    by_words = [grades[:120][np.arange(120) % 3 == k] for k in range(3)]
    assert all(len(set(g)) == 1 for g in by_words) and [g[0] for g in by_words] == sorted(g[0] for g in by_words)


# -- pages ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) { document.write("<p>no</p>") }</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies, and more cookies, and again cookies, as you know.</p></div>
<div id="page"><article class="post"><h1>Title &amp; more</h1><p>First paragraph, with <b>bold <i>words</i> and a
 line&nbsp;break<br>here, and more of it, so that it counts.<p>Second one, unclosed, with a <a href="x">link</a> in it, long enough to count.
<div class="ad">Buy now, cheap, cheap, cheap things for all of you!</div><form><p>Subscribe here, please, do it now, friend.</p></form>
<ul class="related"><li><a href="a">Another article, linked</a></li></ul><blockquote>A quote, of some length, that stays in the text.</blockquote></article>
<aside><p>Aside, aside, aside, aside, with many, many, commas, indeed.</p></aside>
<section id="comments"><p>I think, dear reader, that this comment, long as it is, must go.</p></section></div>
<footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE).split("\n\n") == [
        "Title & more",
        "First paragraph, with bold words and a line break here, and more of it, so that it counts.",
        "Second one, unclosed, with a link in it, long enough to count.",
        "A quote, of some length, that stays in the text.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<<<>>><", "<<<>>><"),
        ("just text", "just text"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div><p>a &lt;b&gt; &#233;&#x1F642; &unknown;</p></div><!-- open", "a <b> é🙂 &unknown;"),
        ("<body><nav><p>menu</p></nav></body>", ""),
        ("<script>x", ""),
        ("<main><div><div><p>deep, deep text of an article, here</p></div><div><p>another part, of the same article</p></div></div></main>", "deep, deep text of an article, here\n\nanother part, of the same article"),
        ("<table><tr><td>one<td>two</table>", "one\n\ntwo"),
    ],
)
def test_odd_pages(page, text):
    if page == "<<<>>><":
        extract.main_text(page)
    else:
        assert extract.main_text(page) == text


def test_text_beside_the_best_container_is_kept():
    ten = "".join(f"<p>Paragraph {i}, with some words, and more of them.</p>" for i in range(10))
    page = f"<html><body><div id=page><ul><li><a href=x>Home</a></li></ul><h1>Title</h1><p>Lead.</p><div class=text>{ten}</div><div><h2>Last part</h2><p>A short section.</p></div><p><a href=y>More of this.</a></p><p>End.</p><h3>Links</h3></div></body></html>"
    got = extract.main_text(page).split("\n\n")
    assert got == ["Title", "Lead.", *[f"Paragraph {i}, with some words, and more of them." for i in range(10)], "Last part", "A short section.", "End."]


def test_names_inside_an_article_are_weighed_against_its_text():
    long = "A sentence of the paper, with some words, that goes on for a while and then comes to its end."
    page = f"<body><article><h2 id='how-to-search'>How to search</h2><p>{long}</p><section id='discussion'><h2 id='tools'>Tools</h2><p>{long}</p></section><section id=related-work><p>{long}</p></section><p id='notice'>Mind <a class='social' href=x>this</a> word.</p>"
    page += "<div class=share><a href=a>One</a> <a href=b>Two</a></div><div class=tags>alpha beta</div><div class=ad><p>" + long + "</p></div><div class='related'><ul><li><a href=c>Other page</a></li></ul></div></article></body>"
    assert extract.main_text(page).split("\n\n") == ["How to search", long, "Tools", long, long, "Mind this word."]


def test_long_pages_stay_linear():
    assert len(extract.main_text("<b>" * 100_000 + "<p>x</i>" * 100_000)) > 100_000
    assert extract.main_text("<div " + 'a="' * 100_000) is not None
    assert len(extract.main_text("<article>" + "<p>word, word</p>" * 50_000 + "</article>").split("\n\n")) == 50_000


def test_extract_table(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", 1), (2, None, 2), (1, "<p>a</p>", 1)], "page_id long, html string, text int")
    assert sorted((r["page_id"], r["text"]) for r in extract.extract(rows).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert extract.extract(rows.limit(0)).count() == 0


# -- pieces ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    try:
        with open(sptokens.MODEL, "rb") as f:
            return f.read()
    except OSError:
        pytest.skip("no model file here")


def test_parity_with_sentencepiece(model):
    rng = np.random.default_rng(4)
    alphabet = list("abcdefgh  \n\tüß日🙂▁<>0129.,'") + ["ing", "tion", " the "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(3000)] + list(sptokens.PROBES) + ["x" * 20_000, " " * 500]
    assert sptokens.differences(model, texts) == []


def test_unigram_models_are_rebuilt():
    """A file made by hand: unigram scores, byte fallback, squeezed spaces."""
    import struct

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload

    def piece(text, score, kind):
        data = text.encode()
        body = field(1, 2, bytes([len(data)]) + data) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁ab", -3.5, 1), ("▁a", -4.0, 1)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    trainer = field(3, 0, b"\x01") + b"\x98\x02\x01"
    data = b"".join(piece(*p) for p in pieces) + field(2, 2, bytes([len(trainer)]) + trainer)
    assert sptokens.parse(data).byte_fallback and sptokens.parse(data).kind == sptokens.UNIGRAM
    assert sptokens.differences(data, ["ab", "aab ab", "  a  b ", "abba é", ""]) == []


def test_round_trip(spark, model):
    texts = [t for t in ODD if "▁" not in (t or "")] + ["</s>[INST] ok [/INST]", "  lead", "trail  "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = sptokens.encode(docs)
    back = {r["doc_id"]: r["text"] for r in sptokens.decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert coded.filter("size(ids) = 0").count() == 2
    assert sptokens.encode(docs.limit(0)).count() == 0 and sptokens.decode(coded.limit(0)).count() == 0


def test_long_texts_are_cut_without_a_trace(model, monkeypatch):
    rng = np.random.default_rng(9)
    made, pieces = sptokens.build(model), sptokens.Pieces(model)
    texts = ["".join(rng.choice(["ab", " ", "  ", "\n", "x.", "▁", "ß"], 3000)) for _ in range(20)] + ["no-space" * 500, "a b" * 400]
    monkeypatch.setattr(sptokens, "PART", 50)
    assert any(len(pieces.cut(t, 50)) > 10 for t in texts)
    ids, upto = sptokens._encoded(made, pieces, texts)
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def test_decoding_is_the_library_s(model):
    rng = np.random.default_rng(10)
    made, pieces = sptokens.build(model), sptokens.Pieces(model)
    lists = [rng.integers(0, len(pieces.lens), rng.integers(0, 12)).tolist() for _ in range(400)] + [rng.integers(0, 300, 9).tolist() for _ in range(400)] + [[], [0], [1, 2]]
    upto = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = pieces.decode(np.concatenate([np.array(x, np.int64) for x in lists]), upto, made).to_pylist()
    assert got == made.decode_batch(lists, skip_special_tokens=False)


def test_parity_over_a_documents_table(spark, model):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no tables here")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sptokens.differences(model, [r["text"] or "" for r in rows]) == []
    got = {r["doc_id"]: r for r in sptokens.op4_sentencepiece(spark, folder).collect()}
    assert len(got) == len(rows) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_round_trip_flag_and_columns(spark, model):
    docs = spark.createDataFrame([(1, "a ▁ b", "x", 1), (2, None, "y", 2), (2, None, "y", 2), (3, "word " * 200_000, "z", 3)], "doc_id long, text string, back string, ids int")
    got = sptokens.encode(docs, back="back", drop=("text",))
    assert got.columns == ["doc_id", "ids", "back"]
    assert sorted((r["doc_id"], r["back"], bool(r["ids"])) for r in got.collect()) == [(1, False, True), (2, True, False), (2, True, False), (3, True, True)]


@pytest.mark.parametrize(
    "part",
    [
        '<p title="hidden costs of oil">KEEP one, and two.</p>',
        '<p>See <a href="/p?id=tags">KEEP</a> here, as one says.</p>',
        '<p data-id="login">KEEP in, one needs a name.</p>',
        '<section class="share-prices"><p>KEEP fell.</p></section>',
        '<h2 id="related">KEEP</h2>',
        '<h2 id="comments-and-tools">KEEP</h2>',
        "<ul><li><a href=x>KEEP</a></li></ul>",
        "<div class='related-work'><p>KEEP</p></div>",
        "<p onclick='hidden' alt=\"class='ad'\">KEEP</p>",
    ],
)
def test_look_alike_attributes_lose_no_text(part):
    page = "<html><body><nav><a href=q>Home</a></nav><article><p>First, a long enough paragraph of the article, with commas, and more.</p>" + part + "</article><div class='cookie-notice'>DROP</div><div hidden>DROP</div><div class=shareButtons>DROP</div><footer>DROP</footer></body></html>"
    got = extract.main_text(page)
    assert "KEEP" in got and "DROP" not in got and "Home" not in got


@pytest.mark.parametrize(
    "part",
    [
        '<section id="comments"><div class="comment"><p>DROP, says a reader, and goes on, at length, about it.</p></div></section>',
        '<div id="comments"><p>DROP, says a reader, and goes on, at length, about all of it.</p></div>',
        '<div class="sidebar"><p>DROP beside it, a long note, that is no part, of the text, at all.</p></div>',
        '<div class="newsletter"><p>DROP: sign up now, for news, each week, by mail, and for free.</p></div>',
        '<div class="notice"><p>DROP, this page, it says, will move, to another place, soon.</p></div>',
        '<div class="site-notice"><p>DROP, this page, it says, will move.</p></div>',
        '<aside><p>DROP it, all of it, here.</p></aside><ul class="share"><li>DROP on x.</li></ul>',
        '<form><p>DROP your name, and more.</p></form><ol class="commentlist"><li>DROP, says one.</li></ol>',
        '<div class="related-articles"><p>DROP: another text, about oil, and its price, is here.</p></div>',
    ],
)
@pytest.mark.parametrize("home", ["<main>{0}</main>", "<article>{0}</article>", "<main><article>{1}</article>{2}</main>", '<div itemprop="articleBody">{0}</div>'])
def test_furniture_inside_the_article_goes(part, home):
    text = "<p>First, a long enough paragraph of the article, with commas, and more.</p><p>KEEP the second, please, as well.</p>"
    page = "<html><body><nav><a href=q>Home</a></nav>" + home.format(text + part, text, part) + "<footer>DROP</footer></body></html>"
    assert extract.main_text(page) == "First, a long enough paragraph of the article, with commas, and more.\n\nKEEP the second, please, as well."


def test_sources_of_an_article_without_its_element_stay():
    page = "<html><body><ul><li><a href=a>Menu one</a></li><li><a href=b>Menu two</a></li></ul><div><p>First, a long enough paragraph of the article, with commas, and more, and a full stop.</p><h2>Sources</h2><ul><li><a href=x>KEEP one</a></li><li><a href=y>KEEP two</a></li></ul></div></body></html>"
    got = extract.main_text(page)
    assert got.endswith("Sources\n\nKEEP one\n\nKEEP two") and "Menu" not in got


def test_extraction_against_plain_pages():
    """Generated pages: blocks of an article between furniture, outside and inside of it,
    come out as they went in."""
    rng = np.random.default_rng(31)
    words = "oil costs, say some, rise and fall. hidden login tags share".split()
    names = ["comments", "sidebar", "notice", "newsletter", "ad", "cookie-notice", "sponsored"]
    for _ in range(200):
        blocks = [" ".join(rng.choice(words, rng.integers(12, 60))) + "." for _ in range(rng.integers(2, 9))]
        tags = [str(rng.choice(["p", "p", "p", "h2", "blockquote", "pre"])) for _ in blocks]
        body = ""
        for t, b in zip(tags, blocks):
            body += f"<{t} id='{rng.choice(words).strip('.,')}'>{b}</{t}>"
            if rng.random() < 0.4:
                body += f"<{(box := str(rng.choice(['div', 'section', 'ul'])))} class='{rng.choice(names)}'>" + "".join(f"<p>{' '.join(rng.choice(words, rng.integers(3, 80)))}.</p>" for _ in range(rng.integers(1, 5))) + f"</{box}>"
        side = "<div class='notice'><p>A notice, in main, of some length, and with commas, too.</p></div>" if rng.random() < 0.5 else ""
        page = f"<html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><header>Top</header><nav><ul><li><a href=a>Menu</a></li></ul></nav><main><article>{body}</article>{side}</main><aside>Side</aside><div class='comments'><p>Reader says, well, a lot of things, really.</p></div><footer>Foot</footer></body></html>"
        assert extract.main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)
