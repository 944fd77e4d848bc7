"""Exact n-gram Jaccard join by set relations.

Documents become sets of hashed word shingles; two sets are linked when their
Jaccard similarity is at least :data:`PERCENT` per cent. The result is one row
per document with its class, its component and the number of its links, never a list of
all pairs.

* Equal sets are one class, named by a hash of the set; only classes are joined.
* Prefix index: in a global order of shingles, similar sets share at least l of
  their first n - ceil(t n) + l, for any l; here l is 1 + n / :data:`MORE` of the
  smaller set. Frequent shingles come last in the order, so common passages leave
  the prefixes, and a passage that is no more than a part of both sets does not
  make l common entries. Each entry holds its position and the set's size: the
  first common entry at i, j bounds the overlap by min(n - i, m - j), and pairs
  below what the similarity needs are skipped.
* Index-level skipping: the entries of a shingle lie together in one list, in order
  of size and position and in blocks of like size. A block whose sizes and best
  position leave an entry no room for the overlap is skipped as one, and an entry that
  skips all blocks of its list is out of the search across components. The same bound
  stands in the join of the lists, so that pairs without room are not made.
* Pivots: each list is led by the most central of its sets. Step one verifies
  every set against the one pivot that it meets most often: k members give k - 1
  pairs, not all of them, and with their pivot make a star.
* Answer-level skipping, across components: Jaccard distance is a metric, so a
  member a of pivot p can be linked to a member b of q only if
  d(p, q) - d(a, p) - d(b, q) <= 1 - t: the answers of a follow from those of the
  highly similar p. Pivots are asked first; of stars that this leaves open, and that
  other links have not joined, the members that could reach each other meet in blocks.
* Answer-level derivation, inside components: links are not transitive, so a component
  does not tell which of its pairs link, and all are counted. Each class is kept as
  its difference D from one base p of the component, to which its answer is known;
  x and y share |p| - |p - x| - |p - y| + |D(x) & D(y)| shingles. Where the first terms
  suffice, and among near copies they mostly do, no pair is intersected. Classes are
  dealt into blocks of even hash and bounded size; each pair of blocks is a task's
  work, and rows leave it once a class, not once a pair.

The order of shingles is by frequency as the tasks meet it: each sends the shingles
that it has met :data:`LOCAL` times or more in a window of 4 million, and those that make
up at least 1 / :data:`HEAVY` of all shingles, of which there can be no more than HEAVY,
form the broadcast list. All documents count; a passage that no window holds twice counts
as rare. The order decides only the effort, never the result.

Skew: copies of a document fall into one class within each task already; lists
of heavy shingles are dealt out by (shingle, part of the set hash) and streamed, not
gathered. Joins of lists on a shingle are plain joins, whose large partitions Spark
splits; joins on set hashes are even. Components come from min-label contraction with
tables of links. Tables between the steps are deleted once read for the last time.

Shingle hashes have 64 bits and set names 64: with n classes a false merge has
probability below n^2 / 2^65.

Defined results: null, empty and word-free texts have no shingles, are linked
with nothing and are their own component; a null id is the smallest id of its
class only if all are null; repeated rows are copies; an empty table gives an
empty table. Very long texts are cut into shingles whole, one text at a time. Only the
columns of id and text are read, whatever others there are and however they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, bytes_of, lean, mix, parts, table, windows, word_hashes, word_spans

SHINGLE, PERCENT = 5, 80
LOCAL, HEAVY = 2, 1 << 21
#: A set of n has 1 + n // MORE entries more than the shortest prefix.
MORE = 25
#: Members of a heavy list that are kept together, and entries of a list that are weighed as one.
PART, LONG = 20_000, 1 << 18
#: Growth of the sizes from one block of a list to the next.
STEP = 1.1


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, n in parts(texts):
        data, at = bytes_of(texts.slice(first, n))
        starts, ends, upto = word_spans(data, at)
        words = word_hashes(data, starts, ends)
        runs = windows(words, k)
        for a, b in zip(upto[:-1], upto[1:], strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:  # the whole sequence, marked by its length
                yield windows(words[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def name_of(s: np.ndarray) -> int:
    """A set's 64-bit name."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) + s.sum() * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100): the overlap without which a set of n has no partner."""
    return -(-percent * n // 100)


def _survey(k: int):
    """Per document its set's size and name, and the shingles that a task meets often."""
    names_ = ["kind", "id", "mark", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def often():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            few = n >= LOCAL
            m = int(few.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), *[pa.nulls(m, pa.int64())] * 2, pa.array(value[few].view(np.int64)), pa.array(n[few].astype(np.int64))], names_)

        met: set[int] = set()
        for batch in batches:
            names, sizes = [], []
            for s in sets(batch.column(1), k):
                name = name_of(s) if len(s) else 0
                names.append(name)
                sizes.append(len(s))
                if name not in met:
                    if len(met) >= 1 << 20:
                        met.clear()
                    met.add(name)
                    held.append(s)
                    size += len(s)
                    if size > 1 << 22:
                        yield often()
                        held, size = [], 0
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(2), pa.array(np.array(names, np.int64)), pa.array(np.array(sizes, np.int64))], names_)
        if held:
            yield often()

    return run


class Order:
    """The global order: shingles by frequency class, then by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.counts = counts[order]
        self.rank = np.log2(np.maximum(self.counts, 1)).astype(np.int64) + 1

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and count (0: not heavy) of each shingle."""
        if not len(self.shingles):
            return np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        place = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        hit = self.shingles[place] == s
        return np.where(hit, self.rank[place], 0), np.where(hit, self.counts[place], 0)


def _index(k: int, percent: int, order, at: int):
    """Prefix entries: shingle, part, set, size, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in sets(batch.column(at), k):
                if not len(s):
                    continue
                name = name_of(s)
                if name in met:  # copies within a task give one set of entries
                    continue
                if len(met) >= 1 << 20:
                    met.clear()
                met.add(name)
                rank, count = order.value.of(s)
                n = len(s)
                reach = min(n, n - int(_least(n, percent)) + 1 + n // MORE)
                first = np.lexsort((s, rank))[:reach] if rank.any() else np.arange(reach)
                split = count[first] // PART + 1
                out[0].append(s[first].view(np.int64))
                out[1].append(np.where(split > 1, (name & 0x7FFFFFFF) % split, -1).astype(np.int32))
                out[2].append(np.full(reach, name))
                out[3].append(np.full(reach, n, np.int32))
                out[4].append(np.arange(reach, dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["shingle", "part", "set", "n", "pos"])

    return run


def _weighed(cols: list[np.ndarray], percent: int, more: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of complete lists, in order of (shingle, part, n, pos, set): which entries are
    in a list with others, each set once, and which of them can have a partner there. A list
    is cut into blocks of like size; a block whose sizes or best position cannot meet an
    entry's is skipped as one."""
    shingle, part, set_, n, pos = cols
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])
    fresh = new.copy()
    fresh[1:] |= set_[1:] != set_[:-1]
    if whole:  # a piece of a longer list: the rest of it is not here
        return fresh, fresh
    rest = n.astype(np.int64) - pos
    key = np.cumsum(new) * 4096 + np.floor(np.log(np.maximum(n, 1)) / np.log(STEP)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    keys, many = key[starts], np.add.reduceat(fresh, starts)
    low, high, best = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts), np.maximum.reduceat(rest, starts)
    keep = part >= 0  # a part of a split list: its partners may be in others
    near = int(np.ceil(np.log(100 / percent) / np.log(STEP)))
    for step in range(-near, near + 1):
        at = np.minimum(np.searchsorted(keys, key + step), len(keys) - 1)
        ok = (keys[at] == key + step) & (100 * high[at] >= percent * n) & (100 * n >= percent * low[at])
        if step == 0:
            ok &= many[at] > 1
        bound = np.minimum(rest, best[at]) + np.minimum(n, high[at]) // more
        keep |= ok & ((100 + percent) * bound >= percent * (n + low[at]))
    lists = np.flatnonzero(new)
    alone = np.repeat(np.add.reduceat(fresh, lists) < 2, np.diff(np.append(lists, len(new))))
    return fresh & (~alone | (part >= 0)), keep


def _lists(percent: int):
    """Passes on the lists with two sets or more, in the memory of a batch and
    :data:`LONG` entries; ``open`` are the entries that can have a partner."""
    names = ["shingle", "set", "n", "pos", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_ = None, None  # entries of a list that may go on; the list of which some have gone out already

        def out(cols: list[np.ndarray], whole: bool):
            keep, can = _weighed(cols, percent, MORE, whole)
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (cols[0], cols[2], cols[3], cols[4], can)], names)

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if long_ is not None:
                on = int(np.argmin(np.append((cols[0] == long_[0]) & (cols[1] == long_[1]), False)))
                if on:
                    yield out([c[:on] for c in cols], True)
                    cols = [c[on:] for c in cols]
                if not len(cols[0]):
                    held = None
                    continue
                long_ = None
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield out([c[:cut] for c in cols], False)
            held = [c[cut:] for c in cols]
            if len(held[0]) > LONG:
                yield out(held, True)
                held, long_ = None, (held[0][-1], held[1][-1])
        if held is not None:
            yield out(held, False)

    return run


def _slots(ids: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _members(k: int, wanted):
    """Whole sets of the texts whose id is wanted, as far as a filter of fixed size can tell; all without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            texts = batch.column(1)
            if wanted is not None:
                ids, bits = batch.column(0), wanted.value
                texts = texts.filter(pa.array(bits[_slots(ids.fill_null(0).to_numpy(zero_copy_only=False), len(bits))] | np.asarray(ids.is_null())))
            names, each = [], []
            for s in sets(texts, k):
                if not len(s):
                    continue
                name = name_of(s)
                if name in met:
                    continue
                if len(met) >= 1 << 20:
                    met.clear()
                met.add(name)
                names.append(name)
                each.append(s.view(np.int64))
            if names:
                upto = np.concatenate([[0], np.cumsum([len(s) for s in each])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(each)))], ["set", "s"])

    return run


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task -> every node with the smallest node that those links reach."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


#: Classes, and shingles of them, in a block of a component.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19


def _common(lists: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right rows."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what one row alone holds is in no intersection
    row, column = np.repeat(np.arange(len(n)), n)[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 1 << 12):
        a, b = np.searchsorted(column, [c, c + (1 << 12)])
        held = np.zeros((len(n), 1 << 12), np.float32)
        held[row[a:b], column[a:b] - c] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def _degrees(percent: int):
    """Two blocks of a component, or one with itself -> links of each class between
    them, derived from the answers for the component's base p: with D the difference
    of a set from p and r what of p it lacks, two sets x, y share
    |p| - r(x) - r(y) + |D(x) & D(y)| shingles. Where the first three terms suffice,
    nothing is intersected."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        names, block, n, lacks, base = (group.column(c).to_numpy() for c in ("set", "block", "n", "lacks", "base_n"))
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        linked = np.zeros((len(left), len(right)), bool)
        if len(left) and len(right):
            known = base[0] - lacks[left][:, None] - lacks[right]
            needs = percent * (n[left][:, None] + n[right]) - (100 + percent) * known
            linked = needs <= 0
            open_left, open_right = np.flatnonzero(~linked.all(1)), np.flatnonzero(~linked.all(0))
            if len(open_left):
                rows = np.unique(np.concatenate([left[open_left], right[open_right]]))
                lists = group.column("differs").combine_chunks().take(pa.array(rows))
                got = _common(lists, np.searchsorted(rows, left[open_left]), np.searchsorted(rows, right[open_right]))
                at = np.ix_(open_left, open_right)
                linked[at] |= (100 + percent) * got >= needs[at]
        if lo == hi:
            np.fill_diagonal(linked, False)
            return pa.table({"set": names[left], "n_links": linked.sum(1)})
        return pa.table({"set": np.concatenate([names[left], names[right]]), "n_links": np.concatenate([linked.sum(1), linked.sum(0)])})

    return run


def _joined(percent: int):
    """A block of one star's sets and a block of its near stars' sets -> (a, b): each set that is
    linked across, with the first set that those links reach."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        names, side = group.column("set").to_numpy(), group.column("side").to_numpy()
        lists = group.column("s").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        linked = (100 + percent) * _common(lists, left, right) >= percent * (n[left][:, None] + n[right])
        x, y = np.arange(len(left)), len(left) + np.arange(len(right))
        while True:  # labels go along the links until none changes
            new_y = np.minimum(y, np.where(linked, x[:, None], len(names)).min(0))
            new_x = np.minimum(x, np.where(linked, new_y, len(names)).min(1))
            if (new_x == x).all() and (new_y == y).all():
                break
            x, y = new_x, new_y
        node, label = np.concatenate([names[left], names[right]]), np.concatenate([x, y])
        moved = label != np.arange(len(label))
        return pa.table({"a": node[moved], "b": node[label[moved]]})

    return run


#: Links that a task contracts by itself.
LINKS = 1 << 20


def components(links: DataFrame, shelf: Shelf | None = None, name: str = "components", a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of all nodes with a link; comp is the smallest node that is
    reachable. Tasks first contract the links that they hold, about LINKS each;
    where those are several tasks, rounds of alternating star contraction between
    them link every node's larger neighbours to its smallest one until nothing
    changes. Tables only, and no list of neighbours. The result is on the shelf as ``name``."""
    shelf = shelf or Shelf(links.sparkSession)
    edges = shelf.put("edges0", links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen, at = None, 0

    def next_(df: DataFrame) -> DataFrame:
        nonlocal at
        new = shelf.put(f"edges{at + 1}", df)
        shelf.drop(f"edges{at}")
        at += 1
        return new

    while True:
        tasks = edges.count() // LINKS + 1
        edges = next_(edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long"))
        found = edges.toDF("node", "comp") if tasks == 1 else None
        if found is None:
            both = edges.filter("u <> v").union(edges.filter("u <> v").select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            small = large.groupBy("u").agg(F.min("v").alias("m"))
            edges = next_(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
            now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
            if now == seen:
                found = edges.toDF("node", "comp").union(edges.select("v", "v").distinct())
            seen = now
        if found is not None:
            found = shelf.put(name, found)
            shelf.drop(f"edges{at}")
            return found


#: Ids that the filter below can hold and still tell apart most others.
FEW = 1 << 22


def _bits(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size (16 million flags) over the column ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << 24, bool)
        for batch in batches:
            flags[_slots(batch.column(0).to_numpy(), len(flags))] = True
        packed = np.packbits(flags).reshape(-1, 1 << 13)
        used = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["block", "bits"])

    out = np.zeros((1 << 8, 1 << 13), np.uint8)
    few = ids.filter("id IS NOT NULL").coalesce(64)  # so that no more than 64 filters come back
    for r in few.mapInArrow(lean(run), "block long, bits binary").toLocalIterator():
        out[r["block"]] |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def _degree(final: DataFrame, owners: DataFrame, known: DataFrame, fetched, shelf: Shelf, percent: int) -> DataFrame:
    """set, n_links: links inside components. Two classes have one; of three and more all pairs are
    counted by blocks, from the classes' differences from one base, the set that most know best."""
    sizes = final.join(owners.filter("n > 0").groupBy("set").agg(F.first("n").alias("n")), "set").groupBy("comp").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"))
    sizes = sizes.select("comp", "many", F.greatest(F.floor(F.col("many") / BLOCK), F.floor(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("last"))
    led_by = known.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).join(final, F.col("rep") == F.col("set")).groupBy("comp").agg(F.max(F.struct("c", "rep"))["rep"].alias("base"))
    placed = final.join(sizes, "comp").join(led_by, "comp", "left").select("set", "comp", "many", "last", F.coalesce("base", "comp").alias("base"), F.pmod(F.xxhash64("set"), F.col("last") + 1).cast("int").alias("block"))
    placed = shelf.put("placed", placed)
    open_ = placed.filter("many > 2")
    whole = fetched(open_.select("set"), "open_sets")
    bases = open_.select("base").distinct().join(whole.select(F.col("set").alias("base"), F.col("s").alias("p")), "base")
    lacks, adds = F.array_except("p", "s"), F.array_except("s", "p")
    apart = open_.join(whole, "set").join(bases, "base").select("comp", "last", "block", "set", F.size("s").cast("long").alias("n"), F.size("p").cast("long").alias("base_n"), F.size(lacks).cast("long").alias("lacks"), F.concat(lacks, adds).alias("differs"))
    dealt = shelf.put("apart", apart).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    shelf.drop("open_sets")
    dealt = dealt.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "block", "n", "base_n", "lacks", "differs")
    counted = dealt.groupBy("comp", "lo", "hi").applyInArrow(_degrees(percent), "set long, n_links long").groupBy("set").agg(F.sum("n_links").alias("n_links"))
    return counted.union(placed.filter("many = 2").select("set", F.lit(1).cast("long")))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """id, mark (xxhash64 of the text), n_shingles, set (the class), class_id (its smallest id),
    group (a number of the component, null without words), component_id and n_links for every
    row of the table; n_links counts all other classes that the row's class is linked with.
    Who needs the components alone leaves the ``links`` uncounted: n_links is null then."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    survey = shelf.put("survey", rows.withColumn("mark", F.xxhash64("text")).mapInArrow(lean(_survey(k)), "kind int, id long, mark long, a long, b long"), "kind")
    owners = survey.filter("kind = 0").select("id", "mark", F.col("a").alias("set"), F.col("b").alias("n"))
    total = owners.agg(F.sum("n")).first()[0] or 0
    heavy = survey.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).filter(F.col("n") >= max(32, total // HEAVY)).toArrow()
    order = spark.sparkContext.broadcast(Order(heavy.column("a").to_numpy().view(np.uint64), heavy.column("n").to_numpy()))  # no more than HEAVY entries

    entries = rows.select("text").mapInArrow(lean(_index(k, percent, order, 0)), "shingle long, part int, set long, n int, pos int")
    dealt = entries.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "shingle", "part").sortWithinPartitions("shingle", "part", "n", "pos", "set")
    lists = shelf.put("lists", dealt.mapInArrow(lean(_lists(percent)), "shingle long, set long, n int, pos int, open boolean"))

    enough = lambda o, n, m: (100 + percent) * o >= percent * (n + m)
    fits = lambda n, m: (100 * n >= percent * m) & (100 * m >= percent * n)
    needed = lambda n, m: 1 + F.floor(F.least(n, m) / MORE)
    first_id = owners.filter("n > 0").groupBy("set").agg(F.min("id").alias("id"))

    def fetched(asked: DataFrame, name: str) -> DataFrame:
        """Whole sets of the asked classes, and some others, on the shelf as ``name``."""
        ids = shelf.put("ids", asked.join(first_id, "set").select("id"))
        if ids.count() > FEW:  # a filter of fixed size would let all through
            some = rows.join(ids.distinct(), "id", "left_semi").union(rows.filter("id IS NULL"))
            wanted = None
        else:
            some, wanted = rows, spark.sparkContext.broadcast(_bits(ids))
        whole = shelf.put(name, some.mapInArrow(lean(_members(k, wanted)), "set long, s array<long>").dropDuplicates(["set"]))
        shelf.drop("ids")
        if wanted is not None:
            wanted.destroy()
        return whole

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """a, b with their exact overlap and sizes; only sets in pairs are fetched."""
        whole = fetched(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), f"{name}_sets")
        one = whole.select(F.col("set").alias("a"), F.col("s").alias("sa"))
        two = whole.select(F.col("set").alias("b"), F.col("s").alias("sb"))
        got = pairs.join(one, "a").join(two, "b")
        out = shelf.put(name, got.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).alias("o"), F.size("sa").alias("na"), F.size("sb").alias("nb")))
        shelf.drop(f"{name}_sets")
        return out.withColumn("d", 1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o")))

    # step one: every set against the one central set that leads most of its lists.
    # Central is what shares most of its prefix: an original, rather than its copies,
    # which have shingles of their own
    size = F.first("n")
    central = shelf.put("central", lists.groupBy("set").agg(size.alias("n"), (F.count(F.lit(1)) / F.least(size, size - F.ceil(size * percent / 100) + 1 + F.floor(size / MORE))).alias("share")))
    shared = lists.select("shingle", "set").join(central, "set")
    heads = shared.groupBy("shingle").agg(F.max(F.struct("share", "set", "n")).alias("head"))
    led = shared.join(heads, "shingle").select(F.col("set").alias("a"), "n", F.col("head.set").alias("b"), F.col("head.n").alias("pn")).filter((F.col("a") != F.col("b")) & fits(F.col("n"), F.col("pn")))
    led = led.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("pn").alias("pn"))
    led = led.filter(2 * F.col("c") >= needed(F.col("n"), F.col("pn"))).groupBy("a").agg(F.max(F.struct("c", "b")).alias("most")).select("a", F.col("most.b").alias("b"))
    first = verified(shelf.put("led", led), "first").filter(enough(F.col("o"), F.col("na"), F.col("nb")))
    comps = components(first, shelf, "comps")

    # each class of a component with the pivot that knows it best
    pivot = first.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select(F.col("a").alias("set"), F.col("best.b").alias("rep"), F.col("best.d").alias("d"))
    known = shelf.put("known", comps.withColumnRenamed("node", "set").join(pivot, "set", "left").select("set", "comp", F.coalesce("rep", "set").alias("rep"), F.coalesce("d", F.lit(0.0)).alias("d")))
    members = lists.filter("open").join(known, "set", "left").select("shingle", "set", "n", "pos", F.coalesce("comp", "set").alias("comp"), F.coalesce("rep", "set").alias("rep"), F.coalesce("d", F.lit(0.0)).alias("d"))

    # step two: pivots against pivots of other components, where sizes and positions
    # leave room for some pair of their members, with the best that these could reach
    asked = members.groupBy("shingle", "comp", "rep").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("d").alias("far"))
    x, y = asked.alias("x"), asked.alias("y")
    room = F.least("x.rest", "y.rest") + F.floor(F.least("x.hi", "y.hi") / MORE)
    met = (
        x.join(
            y,
            (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.rep") < F.col("y.rep"))
            & (F.col("x.comp") != F.col("y.comp"))
            & (100 * F.col("x.hi") >= percent * F.col("y.lo"))
            & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
            & enough(room, F.col("x.lo"), F.col("y.lo")),
        )
        .groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .agg(F.max("x.far").alias("fa"), F.max("y.far").alias("fb"), F.count(F.lit(1)).alias("c"), F.min("x.lo").alias("n"), F.min("y.lo").alias("m"), F.max(F.least("x.rest", "y.rest")).alias("rest"))
        .filter((F.col("c") >= needed(F.col("n"), F.col("m"))) & enough(F.col("rest"), F.col("n"), F.col("m")))
        .select("a", "b", "fa", "fb")
    )
    second = verified(shelf.put("asked", met), "second")
    shelf.drop("lists", "led", "asked")
    linked = enough(F.col("o"), F.col("na"), F.col("nb"))
    edges = first.select("a", "b").union(second.filter(linked).select("a", "b"))
    merged = components(edges, shelf, "merged")

    # step three: stars still apart whose pivots leave open whether some members are
    # linked. A member takes part if it is far enough from its own pivot to reach the
    # other star; what a pivot's near stars have of such members meets in blocks
    limit = 1 - percent / 100 + 1e-9
    at_a, at_b = (merged.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
    near = second.filter(~linked & (F.col("fa") + F.col("fb") > 0) & (F.col("d") - F.col("fa") - F.col("fb") <= limit)).join(at_a, "a", "left").join(at_b, "b", "left")
    near = near.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "fa", "fb", F.col("d").alias("between"))
    # the larger star of a pair is its first: it meets all its near stars at once
    stars = known.groupBy("rep").agg(F.count(F.lit(1)).alias("many"))
    of_a, of_b = (stars.select(F.col("rep").alias(c), F.col("many").alias(f"m{c}")) for c in "ab")
    near = near.join(of_a, "a", "left").join(of_b, "b", "left").withColumn("turn", F.coalesce("mb", F.lit(0)) > F.coalesce("ma", F.lit(0)))
    turned = lambda x, y: F.when(F.col("turn"), F.col(y)).otherwise(F.col(x)).alias(x)
    near = shelf.put("near", near.select(turned("a", "b"), turned("b", "a"), turned("fa", "fb"), turned("fb", "fa"), "between"))
    pivots = near.select(F.col("a").alias("set")).union(near.select("b")).distinct().join(known, "set", "left_anti")
    sized = known.select("set", "rep", "d").union(pivots.select("set", "set", F.lit(0.0))).join(central.select("set", "n"), "set")
    loosest = near.groupBy("a").agg(F.min(F.col("between") - F.col("fb")).alias("least"))
    own = sized.join(loosest, F.col("rep") == F.col("a")).filter(F.col("least") - F.col("d") <= limit).select("a", F.lit(0).alias("side"), "set", "n")
    others = sized.join(near, F.col("rep") == F.col("b")).filter(F.col("between") - F.col("fa") - F.col("d") <= limit).select("a", F.lit(1).alias("side"), "set", "n").distinct()
    sides = shelf.put("sides", own.union(others))
    side = lambda i, f: f(F.when(F.col("side") == i, F.col("n")))
    last = lambda i: F.greatest(F.floor(side(i, F.count) / BLOCK), F.floor(F.coalesce(side(i, F.sum), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = sides.groupBy("a").agg(last(0).alias("last0"), last(1).alias("last1"))
    block = F.pmod(F.xxhash64("set"), F.when(F.col("side") == 0, F.col("last0")).otherwise(F.col("last1")) + 1).cast("int")
    dealt = sides.join(blocks, "a").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("last1")).otherwise(F.col("last0")))))
    dealt = dealt.join(fetched(sides.select("set").distinct(), "sides_sets"), "set")
    dealt = dealt.select("a", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")).alias("lo"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block")).alias("hi"), "side", "set", "s")
    third = shelf.put("third", dealt.groupBy("a", "lo", "hi").applyInArrow(_joined(percent), "a long, b long"))
    final = components(edges.union(third), shelf, "final").withColumnRenamed("node", "set")
    shelf.drop("near", "sides", "sides_sets", "merged", "central", "comps")

    degree = _degree(final, owners, known, fetched, shelf, percent) if links else None
    classes = owners.filter("n > 0").groupBy("set").agg(F.min("id").alias("first"))
    classes = classes.join(final, "set", "left")
    classes = classes.join(degree, "set", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))) if links else classes.withColumn("n_links", F.lit(None).cast("long"))
    named = shelf.put("named", classes.withColumn("comp", F.coalesce("comp", "set")))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "comp").select("set", F.col("first").alias("class_id"), F.col("comp").alias("group"), "component_id", "n_links")
    whole_rows = owners.withColumn("set", F.when(F.col("n") > 0, F.col("set"))).join(by_class, "set", "left")
    out = shelf.put("out", whole_rows.select("id", "mark", F.col("n").alias("n_shingles"), "set", F.coalesce("class_id", "id").alias("class_id"), "group", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links") if links else "n_links"))
    order.destroy()
    shelf.clear("out")
    return out


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links")


ORACLE = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5_number(array_to_string(w[i:i + 4], ' ')))
                                        WHEN len(w) > 0 THEN [md5_number(array_to_string(w, ' '))] ELSE [] END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
x AS (SELECT id, n, unnest(s) AS h FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id AS node, id AS lab FROM c UNION SELECT e.b, r.lab FROM r JOIN e ON e.a = r.node WHERE r.lab < e.b),
m AS (SELECT node, min(lab) AS comp FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id, coalesce(c.id, s.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.node = c.id LEFT JOIN l ON l.a = c.id
"""
