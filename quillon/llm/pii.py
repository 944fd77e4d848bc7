"""Personal data by candidate gradient boosting, by DataFrame operations only.

Fixed patterns give the base spans, which always stay. High-recall generators
propose further, overlapping candidates: written-out addresses, numbers without
a plus, other separators, and what looked like a base form but failed its check.
Which candidates a text proposes depends on no other part of it: a generator's gate
accepts whatever its pattern does. Boosted trees score each candidate on its format and
its context, and a threshold calibrated on held-out candidates decides which are added.
Of added spans that overlap, the one with the better score stays, then the earlier, the
longer, and the kind that is listed first; none overlaps a base span.

Everything runs in the row that holds the text: no shuffle, no join, no Python.
The trees are fitted once per session on a bounded table of made-up texts
(:data:`TRAIN_ROWS` rows, a parameter), whose features the same expressions compute; the
corpus is never sampled. A made-up candidate is true only if it has the span and the kind
of what was planted. A third of the texts, in words and contexts that the trees have not
seen, calibrates the thresholds.

Offsets are code points, ends exclusive. Defined results: null or empty text has
no spans; repeated rows are treated alike; an empty table gives an empty table.
Texts are scanned whole, by patterns without nested backtracking, so that very long runs
of digits or letters stay linear; positions and overlaps are running folds in blocks (module
``arrays``), so that time grows little more than in proportion to the matches of one
text. Only accepted candidates that overlap each other in one unbroken run are compared in
pairs. Columns of the table named ``base_spans`` or ``spans`` are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import blocks, highest, let, sums
from .boost import Boosted, fit
from .common import table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive loops and the anchors before them find the same
#: leftmost matches as the plain forms and never try a run of characters twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text must pass before the pattern is run.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: What an address has from its at on, in all forms. The loose pattern ends in it, so as a gate it loses none.
_HOST = r"(?:[(\[{]at[)\]}]|\x20at\x20|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{]dot[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++)"
#: Further generators: (kind, gate, pattern). A gate is a part that every match of its pattern has.
LOOSE = (
    ("email", rf"(?i){_HOST}", rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?{_HOST}{{1,4}}"),
    ("ip", r"[0-9][(\[]?\.[)\]]?[0-9]", r"(?<![0-9.])[0-9]{1,3}(?:[(\[]?\.[)\]]?[0-9]{1,3}){3}(?![0-9.])"),
    ("card", r"[0-9]{4}[\x20./_-][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[\x20./_-][0-9]{4}){2}[\x20./_-][0-9]{1,7}(?![0-9])"),
    ("phone", r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}", r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.])"),
)
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|pay|account)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|dial)\b",
}
DECOY = r"(?i)\b(?:version|order|invoice|isbn|serial|part|item|ticket|build|no|ref|sku|code|lot|page|table)\b"
#: Frequent ends of host names.
ENDS = r"(?i)[\x20.)\]}](?:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|eu|uk|de|fr|es|it|nl|be|ch|at|dk|se|no|fi|pl|cz|pt|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|kr|ru|tr|za)$"
BEFORE, AFTER = 24, 12
BIG = 2**31 - 1  # beyond all positions
TRAIN_ROWS, TRAIN_PRECISION = 4096, 0.995


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 2) | F.forall(F.split(m, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255"))
    digits = F.length(_digits(m))
    if kind == "card":
        return F.when(digits.between(13, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)
    return digits.between(9, 15)


def scan(text: Column, pattern: str, gate: str, keep) -> Column:
    """All matches that ``keep`` accepts, as array<struct<start, end, m, b, a>>
    with some context before and after. The text is cut at the matches once; positions are
    running sums of the lengths of pieces and matches."""
    zipped = lambda gaps: F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(gaps, 2, F.lit(2**30)).alias("z"))
    rows = let(F.split(text, pattern, -1), zipped)

    def row(x: Column, at: Column) -> Column:
        start = at + F.length(x["g"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), F.right(x["g"], F.lit(BEFORE)).alias("b"), F.left(x["z"], F.lit(AFTER)).alias("a"))

    def placed(rows: Column) -> Column:
        starts = sums(F.transform(rows, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        return F.filter(F.zip_with(rows, starts, row), lambda s: F.when(s["m"].isNotNull(), keep(s["m"])).otherwise(False))

    none = F.array().cast("array<struct<start:int,end:int,m:string,b:string,a:string>>")
    return F.when(F.contains(text, F.lit(gate)) if gate == "@" else text.rlike(gate), let(rows, placed)).otherwise(none)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``; both have start and end. Both are swept
    in order of their starts: the furthest end of the others before a span, and the
    nearest start of those behind it, tell whether it meets one."""
    shape = lambda own: lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), i.alias("i"))
    every = F.sort_array(F.concat(F.transform(spans, shape(1)), F.transform(others, shape(0))))

    def swept(rows: Column) -> Column:
        reach = highest(F.transform(rows, lambda r: F.when(r["own"] == 0, r["end"]).otherwise(0)))
        ahead = F.reverse(highest(F.reverse(F.transform(rows, lambda r: F.when(r["own"] == 0, BIG - r["start"]).otherwise(0)))))
        seen = F.zip_with(F.zip_with(rows, reach, lambda r, x: F.struct(r.alias("r"), x.alias("reach"))), ahead, lambda p, y: F.struct(p["r"].alias("r"), p["reach"].alias("reach"), y.alias("ahead")))
        free = F.filter(seen, lambda p: (p["r"]["own"] == 1) & (p["reach"] <= p["r"]["start"]) & (BIG - p["ahead"] >= p["r"]["end"]))
        return let(F.array_sort(F.transform(free, lambda p: p["r"]["i"])), lambda at: F.transform(at, lambda i: F.get(spans, i)))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(every, swept))


def best_apart(rows: Column) -> Column:
    """Of rows (p, start, past, k, end) those that overlap none that comes before
    them in this order. Rows are compared only within runs of overlapping ones, which a sweep
    in order of their starts tells apart."""
    order = lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["p"].alias("p"), r["past"].alias("past"), r["k"].alias("k"))
    meets = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    first = lambda d, c: F.struct(d["p"], d["start"], d["past"], d["k"]) < F.struct(c["p"], c["start"], c["past"], c["k"])

    def cut(every: Column) -> Column:
        reach = highest(F.transform(every, lambda r: r["end"]))
        begins = F.filter(F.zip_with(F.transform(every, lambda r, i: F.struct(r["start"].alias("start"), i.alias("i"))), reach, lambda r, x: F.when(r["start"] >= x, r["i"])), lambda i: i.isNotNull())

        def runs(at: Column) -> Column:
            each = F.transform(at, lambda i, j: F.slice(every, i + 1, F.coalesce(F.get(at, j + 1), F.size(every)) - i))
            return F.flatten(F.transform(each, lambda run: F.when(F.size(run) == 1, run).otherwise(F.filter(run, lambda c: ~F.exists(run, lambda d: meets(c, d) & first(d, c))))))

        return let(begins, runs)

    once = lambda every: F.filter(every, lambda r, i: (i == 0) | (r != F.get(every, i - 1)))
    return F.when(F.size(rows) <= 1, F.transform(rows, order)).otherwise(let(let(F.sort_array(F.transform(rows, order)), once), cut))


def features(kind: Column, m: Column, b: Column, a: Column) -> dict[str, Column]:
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    digits = _digits(m)
    cue = F.lit(False)
    for k, pattern in CUES.items():
        cue = F.when(kind == k, b.rlike(pattern)).otherwise(cue)
    code = F.lit(-1.0)
    for i, k in enumerate(KINDS):
        code = F.when(kind == k, F.lit(float(i))).otherwise(code)
    return {
        "kind": code,
        "length": F.length(m).cast("double"),
        "digits": F.length(digits).cast("double"),
        "luhn": F.when(F.length(digits).between(13, 19), flag(F.call_function("luhn_check", digits))).otherwise(0.0),
        "octets": flag(m.rlike(r"^[^A-Za-z]*$") & F.forall(F.filter(F.split(m, r"[^0-9]+"), lambda x: x != ""), lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))),
        "spelt": flag(m.rlike(r"(?i)[(\[{\x20](?:at|dot)[)\]}\x20]")),
        "both": flag(m.rlike(r"(?i)[(\[{\x20]at[)\]}\x20].*(?:[(\[{\x20]dot[)\]}\x20]|[a-z0-9]\.[a-z]{2,})")),
        "end": flag(m.rlike(ENDS)),
        "sign": flag(F.contains(m, F.lit("@"))),
        "broken": flag(m.rlike(r"\.\x20|\x20\.|[.@]$")),  # a full stop between words
        "bracket": flag(m.rlike(r"[(\[{]")),
        "dots": F.length(F.regexp_replace(m, r"[^.]", "")).cast("double"),
        "groups": F.size(F.split(m, r"[^0-9]+")).cast("double"),
        "repeat": flag(digits.rlike(r"^(?:([0-9])\1*)$")),
        "cue": flag(cue),
        "decoy": flag(b.rlike(DECOY)),
        "joined": flag(b.rlike(r"[A-Za-z0-9/.,-]$") | a.rlike(r"^[A-Za-z0-9/-]|^[.,][0-9]")),
    }


def proposals(text: Column) -> Column:
    """All further candidates: array<struct<kind, start, end, m, b, a>>."""
    failed = lambda k, least: lambda m: (F.length(_digits(m)) >= least) & ~valid(k, m)
    sources = [(k, GATE[k], BASE[k], failed(k, least)) for k, least in (("card", 13), ("phone", 7))]
    octets = lambda m: valid("ip", F.regexp_replace(m, r"[^0-9.]", ""))
    sources += [(k, g, p, octets if k == "ip" else lambda m: F.lit(True)) for k, g, p in LOOSE]

    def named(k: str):  # transform() counts a lambda's parameters, so k is bound here
        return lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), s["b"].alias("b"), s["a"].alias("a"))

    return F.concat(*[F.transform(scan(text, p, g, keep), named(k)) for k, g, p, keep in sources])


def _made_up(spark: SparkSession, rows: int) -> DataFrame:
    """(id, held, text, kind, start, end): personal data in unusual forms and
    look-alikes, in contexts; kind is null without personal data, else it has the span."""
    pick = lambda salt, *options: F.get(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))).cast("int"))
    number = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low)) + low).cast("string")
    join = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    held = F.col("id") % 3 == 0
    either = lambda salt, seen, unseen: F.when(held, pick(salt, *unseen)).otherwise(pick(salt, *seen))
    name = either("n", ("anna", "j.doe", "max_m", "info", "r2d2", "sales"), ("petra.k", "office", "li-wei", "b12"))
    host = either("h", ("mail", "example", "post-box", "acme"), ("web9", "firma", "uni-x"))
    end = either("e", ("com", "org", "net", "de"), ("fr", "io", "co"))
    q = lambda i: number(f"q{i}", 1000, 9999)
    body = F.concat(F.lit("4"), number("c1", 10**6, 10**7 - 1), number("c2", 10**6, 10**7 - 1))
    card = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda c: F.call_function("luhn_check", c)), 0)
    cut = lambda sep: join(F.substring(card, 1, 4), sep, F.substring(card, 5, 4), sep, F.substring(card, 9, 4), sep, F.substring(card, 13, 4))
    o = lambda i: number(f"o{i}", 1, 255)
    a3, b3, d4 = number("a3", 200, 999), number("b3", 200, 999), number("d4", 1000, 9999)
    good = pick("good", join(name, " (at) ", host, " (dot) ", end), join(name, "[at]", host, "[dot]", end), join(name, " at ", host, " dot ", end), join(name, " (at) ", host, ".", end), join(o(1), "[.]", o(2), "[.]", o(3), "[.]", o(4)), join(o(1), "(.)", o(2), "(.)", o(3), "(.)", o(4)), cut("."), cut("/"), cut("_"), join("(", a3, ") ", b3, "-", d4), join(a3, "-", b3, "-", d4), join(name, " at ", host, ".", end), join(name, " @ ", host, ".", end), join(name, "@", host, " dot ", end), join(name, " at ", host, " (dot) ", end), join(name, "@", host, "(dot)", end))
    bad = pick("bad", join(number("x", 300, 999), ".", o(2), ".", o(3), ".", o(4)), join("1.2.", number("x", 256, 4000), ".7"), join(q(1), q(2), q(3), q(4)), join(q(1), " ", q(2), " ", q(3), " ", q(4)), join(q(1), "/", q(2), "/", q(3), "/", q(4)), join(q(1), ".", q(2), ".", q(3), ".", q(4)), join("look at ", host, " dot"), join("met at ", host, ". Then"), join("stay at ", host, ".It was"), join("two @ ", host, ". They"), join("met at ", host, ". ", pick("word", "It", "In", "At", "No", "So", "Is", "Be", "Us")), join("by at ", pick("word2", "and", "the", "home", "work"), ". ", pick("word", "It", "In", "At", "No")), join("us at ", host, ".com"), join(a3, " ", b3, " ", d4), join(a3, ".", b3, ".", d4), join(a3, "-", b3, "-", d4), join("+1 ", number("s", 100, 999), " 22"), join(q(1), number("y", 10**9, 10**10 - 1)), join("0000 0000 0000 0000"))
    kinds = F.array(*[F.lit(k) for k in ["email"] * 4 + ["ip"] * 2 + ["card"] * 3 + ["phone"] * 2 + ["email"] * 5])  # of the forms in good
    near = either("near", ("Please call ", "phone: ", "contact ", "mail ", "card ", "host ", "", "and then the ", "of ", "server "), ("write to ", "dial ", "my card is ", "login from ", "so ", "you reach "))
    far = either("far", ("order ", "version ", "ISBN ", "the ", "no ", "part ", "", "total of ", "ref ", "code x"), ("invoice ", "build ", "lot ", "page ", "and ", "sum of "))
    positive = F.pmod(F.xxhash64("id", F.lit("label")), F.lit(2)) == 1
    form = F.pmod(F.xxhash64("id", F.lit("good")), F.lit(16)).cast("int")
    # a ten-digit number without a plus or brackets is a telephone number only after a word that says so
    said = either("said", ("phone: ", "Please call ", "tel ", "mobile "), ("dial ", "my cell is ", "fax "))
    lead = F.concat(F.lit("Then "), F.when(positive & (form == 10), said).when(positive, near).otherwise(far))
    made = spark.range(rows).withColumn("_lead", lead).withColumn("_good", good).withColumn("_bad", bad)
    text = F.concat("_lead", F.when(positive, F.col("_good")).otherwise(F.col("_bad")), either("tail", (" and more.", ".", " for them", ", so"), (" today", "; then", " (thanks)")))
    return made.select("id", held.alias("held"), text.alias("text"), F.when(positive, F.get(kinds, form)).alias("kind"), F.length("_lead").alias("start"), (F.length("_lead") + F.length("_good")).alias("end"))


@functools.lru_cache(maxsize=8)
def _fitted(spark: SparkSession, rows: int, precision: float) -> tuple[Boosted, dict[str, float]]:
    made = _made_up(spark, rows).withColumn("c", F.explode(proposals(F.col("text"))))
    cols = features(F.col("c.kind"), F.col("c.m"), F.col("c.b"), F.col("c.a"))
    true = F.coalesce((F.col("c.kind") == F.col("kind")) & (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end")), F.lit(False))
    got = made.select("id", "held", true.cast("double").alias("label"), F.col("c.kind").alias("k"), *[c.alias(f"f_{n}") for n, c in cols.items()]).orderBy("id", "k", *[f"f_{n}" for n in cols]).collect()
    # a made-up number that passes the check by chance is no look-alike
    got = [r for r in got if r["label"] or r["k"] != "card" or not r["f_luhn"] or r["f_repeat"]]
    x = np.array([[r[f"f_{n}"] for n in cols] for r in got], float)
    y, held, kind = np.array([r["label"] for r in got]), np.array([r["held"] for r in got]), np.array([r["k"] for r in got])
    model = fit(x[~held], y[~held], list(cols))
    margin, limits = model.margin(x), {}
    for k in KINDS:  # the lowest threshold that keeps the precision on held-out candidates, midway to the next of them
        rows_k = held & (kind == k)
        score = -np.sort(-margin[rows_k])
        order = np.argsort(-margin[rows_k], kind="stable")
        last = np.append(score[1:] < score[:-1], True)  # equal scores are on one side
        hits = np.cumsum(y[rows_k][order]) / np.arange(1, rows_k.sum() + 1)
        good = np.flatnonzero((hits >= precision) & last)
        if len(good):
            low = score[good[-1] + 1] if good[-1] + 1 < len(score) else 0.0
            limits[k] = max(0.5, float(1 / (1 + np.exp(-(score[good[-1]] + min(low, score[good[-1]])) / 2))))
        else:
            limits[k] = 1.1
    return model, limits


SPAN = "array<struct<k:int,start:int,end:int>>"


def detect(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS, precision: float = TRAIN_PRECISION) -> DataFrame:
    """Adds ``base_spans`` and ``spans``: arrays of (kind number, start, end), by
    kind as in :data:`KINDS`, then start. Columns of the table with these two
    names are replaced; others are kept."""
    model, limits = _fitted(docs.sparkSession, train_rows, precision)
    body = F.coalesce(F.col(text), F.lit(""))

    def numbered(i: int):
        return lambda s: F.struct(F.lit(i).alias("k"), s["start"].alias("start"), s["end"].alias("end"))

    base = F.concat(*[F.transform(scan(body, BASE[k], GATE[k], functools.partial(valid, k)), numbered(i)) for i, k in enumerate(KINDS)])
    seen = docs.withColumn("base_spans", base).withColumn("__proposed", proposals(body))
    number = lambda k: functools.reduce(lambda rest, i: F.when(k == KINDS[i], F.lit(i)).otherwise(rest), range(len(KINDS)), F.lit(-1))
    seen = seen.withColumn("__proposed", apart(F.col("__proposed"), F.col("base_spans")))
    weighed = F.transform("__proposed", lambda c: F.struct(c["kind"].alias("of"), number(c["kind"]).alias("k"), c["start"].alias("start"), c["end"].alias("end"), *[v.alias(f"f_{n}") for n, v in features(c["kind"], c["m"], c["b"], c["a"]).items()]))
    seen = seen.withColumn("__weighed", weighed)  # a candidate's features are made once, then all trees read them
    least = " ".join(f"WHEN c.of = '{k}' THEN {limits[k]!r}D" for k in KINDS)
    probability = model.sql(lambda name: f"c.f_{name}")
    scored = F.expr(f"transform(__weighed, c -> named_struct('p', -({probability}), 'start', c.start, 'past', -c.end, 'k', c.k, 'end', c.end, 'least', CASE {least} ELSE 1.1D END))")
    seen = seen.withColumn("__scored", F.filter(scored, lambda c: -c["p"] >= c["least"]))
    added = F.transform(best_apart(F.col("__scored")), lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end")))
    every = F.when(F.size("__proposed") == 0, F.col("base_spans")).otherwise(F.sort_array(F.concat("base_spans", added)))
    return seen.withColumn("spans", every.cast(SPAN)).drop("__proposed", "__weighed", "__scored")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces what ``spans`` holds by [EMAIL], [IP], [CARD] and [PHONE]; of
    overlapping spans the first in the text names the gap. Null stays null. The text is
    cut into one part for each block of spans, so that no position is counted from its beginning."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    body = F.col(text)

    def fresh(rows: Column) -> Column:
        reach = highest(F.transform(rows, lambda s: s["end"]))
        return F.filter(F.zip_with(rows, reach, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["k"].alias("k"))), lambda s: s["start"] >= s["at"])

    def block(low: Column, rows: Column, names: Column) -> Column:
        part = F.substring(body, low + 1, F.element_at(rows, -1)["start"] - low)
        piece = lambda part: lambda s: F.concat(F.substring(part, s["at"] - low + 1, s["start"] - s["at"]), F.get(names, s["k"]))
        return let(part, lambda part: F.array_join(F.transform(rows, piece(part)), ""))

    pieces = let(names, lambda n: let(let(by_start, fresh), lambda rows: F.array_join(F.transform(blocks(rows), lambda r: block(F.get(r, 0)["at"], r, n)), "")))
    end = F.aggregate("spans", F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
    clean = F.concat(pieces, F.substring(body, end + 1, F.lit(2**31 - 1)))
    return docs.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(body))


def digest(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *[count(i) for i in range(4)], F.sha2(digest(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
