"""Centroid clustering, filter interaction and archives against brute force."""

import base64
import hashlib
import itertools
import math
import re
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillon.llm import interplay, warc, yinyang

# -- clustering ------------------------------------------------------------------


def plain_clusters(rows, k, rounds, length, scale, seed=1):
    """(id, vector) rows by the contract, all distances each time."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v], v))
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centroids = [r[1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v, _), c in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *reversed(nearest(v))) for i, v, _ in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, c, d in found]


VECTORS = "vec_id long, embedding array<double>, cluster string, distance string, v int"


def clusters_of(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS)
    return [tuple(r) for r in yinyang.cluster(df, **more)[0].collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_are_those_of_all_distances(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (7, 5))
    rows = [(int(i), [float(x) for x in centres[rng.integers(7)] + rng.normal(0, 0.4, 5)]) for i in rng.permutation(300)]
    rows += [(1000 + i, [float(x) for x in rng.integers(-1, 2, 5)]) for i in range(60)]  # ties
    rows += rows[:20] + [(rows[0][0], rows[1][1]), (None, rows[2][1]), (None, None), (5000, None), (5001, [1.0] * 4), (5002, []), (5003, [1.0, None, 1.0, 1.0, 1.0]), (5004, [math.nan] + [0.0] * 4), (5005, [-math.inf] + [0.0] * 4)]
    for k, rounds in ((6, 3), (16, 3), (3, 0)):
        got = clusters_of(spark, rows, k=k, rounds=rounds, length=5, scale=8, seed=seed)
        assert ordered(got) == ordered(plain_clusters(rows, k, rounds, 5, 8, seed))


def test_few_vectors_and_large_components(spark):
    few = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [9.0, 9.0])]
    assert ordered(clusters_of(spark, few, k=16, length=2)) == ordered(plain_clusters(few, 16, 3, 2, 64))
    assert clusters_of(spark, few, k=16, length=3) == [] and clusters_of(spark, [], k=2, length=2) == []
    for large in (3e5, 3e6, 1e7):  # doubles, longs and Python's numbers
        rows = [(i, [large * math.sin(i), large * math.cos(3 * i), 0.1 * i]) for i in range(40)]
        assert ordered(clusters_of(spark, rows, k=5, length=3)) == ordered(plain_clusters(rows, 5, 3, 3, 64))
    with pytest.raises(Exception, match="(?i)overflow|too large|int too big|64 bits|out of bounds"):
        clusters_of(spark, [(1, [0.0, 0.0]), (2, [1e30, 0.0])], k=1, length=2)


def test_bounds_spare_distances_and_stay_bounds():
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (12, 8))
    v = centres[rng.integers(12, size=3000)] + rng.integers(-9, 10, (3000, 8))
    centroids = centres + rng.integers(-30, 31, centres.shape)
    group = yinyang.grouped(centroids, 3)
    first = yinyang.Round(centroids, group, None)
    cluster, upper, lower, _ = first.first(v)
    for _ in range(4):
        moved = np.stack([v[cluster == c].sum(0) // max((cluster == c).sum(), 1) if (cluster == c).any() else centroids[c] for c in range(12)])
        step = yinyang.Round(moved, group, np.sqrt(((moved - centroids) ** 2).sum(1).astype(float)))
        cluster, upper, lower, distance = step.move(v, cluster, upper, lower, exact=True)
        every = ((v[:, None, :] - moved[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert (upper >= np.sqrt(distance)).all()
        for g in range(3):
            others = np.where((group == g)[None] & (np.arange(12)[None] != cluster[:, None]), np.sqrt(every), np.inf).min(1)
            assert (lower[:, g] <= others).all()
        centroids = moved
    assert step.scanned < 0.3 * every.size


# -- filters ---------------------------------------------------------------------


def plain_orders(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    said = {}
    for i, q, x in labels:
        old = said.get(i, (False, False))
        said[i] = (old[0] or q == 1, old[1] or x == 1)
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = word.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((part or "", fails, *(said.get(i, (False, False)) if i is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed = [r for r in rows if r[0] == part], {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed[order, f] = len(here)
                out.append([part, "".join(order), step, len(left), len(here), sum(r[1][f] for r in mine) - len(here), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in here), sum(r[3] for r in here), f])
        for row in out:
            if row[0] == part:
                row[-1] = sum(n for (_, f), n in removed.items() if f == row[-1]) if isinstance(row[-1], str) else row[-1]
    return sorted(map(tuple, out))


DOCS = "doc_id long, text string, source string, n string, good int, mask int"
LABELS = "doc_id long, quality int, toxic int, text string"
LONG = " ".join(f"w{i}" for i in range(250))


def orders_of(spark, docs, labels):
    found = interplay.cells(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS), spark.createDataFrame([(*x, "t") for x in labels], LABELS))
    return sorted(tuple(r) for r in interplay.orders(found).collect())


def test_orders_against_all_rows(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", " ", LONG, LONG, LONG + " #", "A " * 210, "A B C " * 100, "word " * 300, LONG.upper(), "ß" * 40 + " | A", "\t\n", " x" * 199, "x y " * 100, "very " * 60_000]
    parts = ["a", "b", None, ""]
    docs = [(int(i), texts[rng.integers(len(texts))], parts[rng.integers(4)]) for i in rng.integers(0, 60, 160)]
    docs += [(None, LONG, "a"), (None, LONG, "a"), (None, None, "b"), (7, LONG, "a"), (7, LONG, "a"), (7, LONG, "b")]
    labels = [(int(i), *(None if x > 1 else int(x) for x in rng.integers(0, 3, 2))) for i in rng.integers(0, 80, 70)] + [(None, 1, 1), (7, 0, 1), (7, 1, 0)]
    got = orders_of(spark, docs, labels)
    assert len(got) == 600 * 3 and got == plain_orders(docs, labels)
    assert orders_of(spark, [], labels) == [] and orders_of(spark, docs[:9], []) == plain_orders(docs[:9], [])


def test_one_text_is_a_third_of_all_rows(spark):
    docs = [(i, LONG if i % 3 else f"{LONG} {i}", "hot" if i % 5 else "cold") for i in range(400)]
    assert orders_of(spark, docs, [(1, 1, 1), (2, 1, 0)]) == plain_orders(docs, [(1, 1, 1), (2, 1, 0)])


# -- archives --------------------------------------------------------------------

PAGES = "page_id long, url string, html string, size int, first string, digest string"


def plain_records(pages, least=0):
    out, seen = [], {}
    for i, u, t in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")):
        data = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = data in seen and len(data) >= least
        out.append((i, len(data), digest, "revisit" if again else "response", seen.get(data) if again else None))
        seen.setdefault(data, i)
    return ordered(out)


def archived(spark, pages, folder, **more):
    df = spark.createDataFrame([(*p, 1, "f", "d") for p in pages], PAGES).repartition(3)
    return warc.write(df, folder, **more)


def shown(rows):
    long = lambda x: None if x is None else int(x)
    return ordered([(long(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], long(r["refers_to"])) for r in rows])


SOME = [(i, f"http://x/{i}", f"<html><body><p>Page {i % 40} holds words, and more words.</p></body></html>") for i in range(300)]
ODD = [(900, None, None), (901, "http://x/ä b\r\nWARC-Type: no", ""), (902, "u", "é🙂\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "only"), (None, "m", "only"), (903, "l", "only"), (5, "http://x/5", SOME[5][2]), (0, "http://x/0", SOME[0][2]), (0, "http://x/0", SOME[0][2]), (0, "http://w/0", SOME[0][2]), (904, "big", "long page " * 300_000), (905, "big", "long page " * 300_000)]


@pytest.mark.parametrize(("least", "hot"), [(0, 1000), (0, 3), (70, 1), (10**9, 2)])
def test_archives_read_back(spark, tmp_path, monkeypatch, least, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    pages = SOME + ODD
    rows = warc.read(archived(spark, pages, f"file://{tmp_path}/a", least=least)).collect()
    assert shown(rows) == plain_records(pages, least)
    held = {(t or "").encode() for _, _, t in pages}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) in held) for r in rows)
    assert {bytes(r["payload"]) for r in rows if r["payload"] is not None} == held


def test_empty_table_and_rolled_archives(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.read(warc.write(none, f"file://{tmp_path}/none")).count() == 0
    pages = [(i, "u", f"{i} " + " ".join(hashlib.sha256(f"{i}-{j}".encode()).hexdigest() for j in range(900))) for i in range(200)]
    manifest = archived(spark, pages, f"file://{tmp_path}/many", most=1 << 20).collect()
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == 200
    assert shown(warc.read(archived(spark, pages, f"file://{tmp_path}/more", most=1 << 20)).collect()) == plain_records(pages)


def frames(data):
    """The frames behind the leading skippable one, by the format alone, and the dictionary."""
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    made = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    data = data[8 + size :]
    while data:
        one = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
        yield one.decompress(data), made
        data = one.unused_data


def test_format_of_archives(spark, tmp_path):
    folder = tmp_path / "b"
    pages = [(i, f"http://x/{i}", f"<html><title>{i}</title><p>{' '.join(hashlib.md5(str(i).encode()).hexdigest())} the same furniture on each page</p></html>") for i in range(400)]
    manifest = archived(spark, pages + pages[:50], f"file://{folder}").collect()
    assert sorted(m["file"] for m in manifest) == sorted(f"file://{p}" for p in folder.glob("*.warc.zst"))
    n, ids = 0, set()
    for m in manifest:
        data = open(m["file"].removeprefix("file://"), "rb").read()
        assert len(data) == m["stored_bytes"] and m["dictionary_bytes"] > 0
        every = [r for r, _ in frames(data)]
        assert len(every) == m["records"] + 1 and every[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for r in every:  # one whole record a frame
            head, _, rest = r.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= set(fields) and fields["WARC-Record-ID"] not in ids
            ids.add(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Refers-To-Target-URI"].startswith("http://x/") and fields["WARC-Profile"] == warc.REVISIT_PROFILE
        n += m["records"]
        plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in every)
        assert len(data) < 0.9 * plain
    assert n == 450


def test_damage_is_found(spark, tmp_path):
    manifest = archived(spark, SOME, f"file://{tmp_path}/c")
    file = manifest.first()["file"].removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    for cut in (data[:-30], data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 255]) + data[len(data) // 2 + 1 :]):
        open(file, "wb").write(cut)
        with pytest.raises(Exception):
            warc.read(manifest).collect()
    fields = {"warc-type": "response", "warc-payload-digest": "sha1:" + "A" * 32, "warc-record-id": "x", "warc-target-uri": "u"}
    with pytest.raises(ValueError, match="not what was archived"):
        warc._page("f", fields, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx", True)
    assert spark.range(1).select(F.lit(1)).count() == 1
