"""Required statements: present, saying what they must, not saying what they must not."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import let, sums
from .policy import BYLINE, FACILITY, STATEMENTS, Byline, Journal, Statement, required
from .rules import LEXICON_BYTES, lexicons

GAP = r"(?U)\n\s*\n"


def blocks(text: Column) -> Column:
    """Paragraphs with their first line: array<struct<text, line>>. A paragraph's line is one
    more than the line feeds before it, which are running sums over the cut text."""
    feeds = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    rows = F.arrays_zip(F.split(text, GAP, -1).alias("t"), F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(GAP), F.lit(0))).alias("gap"))

    def placed(rows: Column) -> Column:
        before = sums(F.transform(rows, lambda x: feeds(x["gap"]) + feeds(x["t"])))
        each = F.zip_with(rows, before, lambda x, n: F.struct(x["t"].alias("text"), (n + feeds(x["gap"]) + 1).alias("line")))
        return F.filter(each, lambda b: b["text"].rlike(r"(?U)\S"))

    return let(rows, placed)


def _holds(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def _judge(rule: Statement, held: Column) -> Column:
    """key, label, present, line, issues for one rule over the blocks ``held``."""
    places = F.filter(F.transform(held, lambda b, i: F.when(_holds(b["text"], rule.cues), i)), lambda i: i.isNotNull())
    at = F.get(places, 0)
    own, after = F.get(held, at), F.get(held, at + 1)
    # a short block is a heading: what follows is the statement
    text = F.when((F.length(F.regexp_replace(own["text"], r"(?U)^\s+|\s+$", "")) < 60) & after.isNotNull(), F.concat(own["text"], F.lit("\n"), after["text"])).otherwise(own["text"])
    hint = f" ({rule.hint})" if rule.hint else ""
    wants = [F.when(~_holds(text, group), F.lit(f"does not mention {' / '.join(group)}{hint}")) for group in rule.needs]
    bars = [F.when(_holds(text, (bad,)), F.lit(f"must not say {bad}{hint}")) for bad in rule.forbids]
    issues = F.when(at.isNull(), F.array(F.lit("missing" + hint))).otherwise(F.array_compact(F.array(*wants, *bars)).cast("array<string>") if wants or bars else F.array().cast("array<string>"))
    return F.struct(F.lit(rule.key).alias("key"), F.lit(rule.label).alias("label"), at.isNotNull().alias("present"), F.coalesce(own["line"], F.lit(0)).alias("line"), issues.alias("issues"))


def check_statements(df: DataFrame, text: str = "text", journal: Journal | None = None, rules: dict[str, Statement] | None = None) -> DataFrame:
    """Adds statements (array of findings), extra_issues and status. ``rules`` adds to
    the statements that are known, or replaces some."""
    known = {**STATEMENTS, **(rules or {})}
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_blocks", blocks(t)).withColumn("statements", F.array(*[_judge(known[k], F.col("_blocks")) for k in required(journal)])).drop("_blocks")
    cues, doi = FACILITY
    extra = F.when(_holds(t, cues) & ~F.contains(t, F.lit(doi)), F.array(F.lit(f"names the facility without citing {doi}"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("extra_issues", extra)
    good = F.forall("statements", lambda s: s["present"] & (F.size(s["issues"]) == 0))
    return out.withColumn("status", F.when(good & (F.size("extra_issues") == 0), "ok").otherwise("suspect"))


# -- rules from a table --------------------------------------------------------------

#: Statements as rows, and which journal asks for which, in which order; the journal ''
#: says what is asked for where a document's journal is null or in no row.
STATEMENT_ROWS = "key string, label string, cues array<string>, needs array<array<string>>, forbids array<string>, hint string"
REQUIRED_ROWS = "journal string, ord int, key string"


def _hits(df: DataFrame, terms: DataFrame, keep: Sequence[str], most: int) -> DataFrame:
    """``keep`` and ``hits``, array<struct<term, block>>: which terms the blocks hold, by one pass
    of an automaton over each block for each slice of the terms."""
    rows = df.select(*keep, F.col("_texts"), F.array().cast("array<struct<term:bigint,block:int>>").alias("hits"))
    for lexicon in lexicons(terms, most):
        held = df.sparkSession.sparkContext.broadcast(lexicon)  # below the measured bound

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for texts, before in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True):
                    new = {(n, i) for i, t in enumerate(texts.as_py() or []) for n, _, _ in held.value.find(t)}
                    found.append((before.as_py() or []) + [{"term": n, "block": i} for n, i in sorted(new)])
                hits = pa.array(found, pa.list_(pa.struct([("term", pa.int64()), ("block", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], hits], batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.drop("_texts")


def check_statement_rules(df: DataFrame, rules: DataFrame, required: DataFrame, text: str = "text", journal: str = "journal", keys: Sequence[str] = ("doc_id",), most: int = LEXICON_BYTES) -> DataFrame:
    """keys, journal, ord, key, label, present, line, issues: one row for each document and
    statement that its journal asks for. ``rules`` (:data:`STATEMENT_ROWS`) and ``required``
    (:data:`REQUIRED_ROWS`) are tables of any size; a key that no rule has is not asked for.

    All cues, needed and barred phrases are one lexicon, so a document is scanned once however
    many rules there are. Terms go by a hash (two that share one raise); documents meet the rules of
    their journal by an equi-join, and what is judged there are numbers of terms and blocks, not
    texts. A block under 60 characters is a heading, and the next one is read with it. Phrases do
    not count over the gap between two blocks. Of rules with the same key the first by label holds.
    """
    one = rules.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("label", "cues", "needs", "forbids", "hint")).alias("r"))
    none = F.array().cast("array<string>")
    phrases = F.concat(F.coalesce("r.cues", none), F.flatten(F.coalesce("r.needs", F.array().cast("array<array<string>>"))), F.coalesce("r.forbids", none))
    named = lambda term: F.xxhash64(term)
    names = one.select(F.explode(phrases).alias("term")).filter("term <> ''").distinct().select(named("term").alias("rule"), "term", F.lit("within").alias("mode"))
    of = lambda phrases: F.transform(F.coalesce(phrases, none), named)
    needs = F.coalesce("r.needs", F.array().cast("array<array<string>>"))
    coded = one.select(
        "key",
        F.struct("key", F.col("r.label").alias("label"), F.when(F.length("r.hint") > 0, F.concat(F.lit(" ("), F.col("r.hint"), F.lit(")"))).otherwise("").alias("hint"), of(F.col("r.cues")).alias("cues"), needs.alias("needs"), F.transform(needs, of).alias("need_terms"), F.coalesce("r.forbids", none).alias("forbids"), of(F.col("r.forbids")).alias("forbid_terms")).alias("rule"),
    )
    asked = required.groupBy(F.coalesce("journal", F.lit("")).alias("_j"), "key").agg(F.min("ord").alias("ord")).join(coded, "key").drop("key")
    known = asked.select("_j").distinct().withColumn("_known", F.lit(True))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = df.select(*keys, F.coalesce(F.col(journal), F.lit("")).alias("_j"), blocks(F.coalesce(F.col(text), F.lit(""))).alias("_blocks"))
    rows = rows.join(known, "_j", "left").withColumn("journal", F.when(F.col("_known"), F.col("_j")).otherwise(""))
    rows = rows.select(*keys, "journal", F.transform("_blocks", lambda b: b["text"]).alias("_texts"), F.transform("_blocks", lambda b: b["line"]).alias("_at"), F.transform("_blocks", lambda b: F.length(trim(b["text"])) < 60).alias("_short"))
    found = _hits(rows, names, [*keys, "journal", "_at", "_short"], most)
    each = found.join(asked.withColumnRenamed("_j", "journal"), "journal")
    here = F.array_min(F.transform(F.filter("hits", lambda h: F.array_contains("rule.cues", h["term"])), lambda h: h["block"]))
    each = each.withColumn("_b", here).withColumn("_next", F.when(F.get("_short", F.col("_b")), F.col("_b") + 1).otherwise(F.col("_b")))
    inside = F.transform(F.filter("hits", lambda h: (h["block"] == F.col("_b")) | (h["block"] == F.col("_next"))), lambda h: h["term"])
    each = each.withColumn("_in", inside)
    want = lambda group, i: F.when(~F.arrays_overlap(F.get("rule.need_terms", i), F.col("_in")), F.concat(F.lit("does not mention "), F.array_join(group, " / "), F.col("rule.hint")))
    bar = lambda bad, i: F.when(F.array_contains("_in", F.get("rule.forbid_terms", i)), F.concat(F.lit("must not say "), bad, F.col("rule.hint")))
    issues = F.when(F.col("_b").isNull(), F.array(F.concat(F.lit("missing"), F.col("rule.hint")))).otherwise(F.array_compact(F.concat(F.transform("rule.needs", want), F.transform("rule.forbids", bar))))
    return each.select(*keys, "journal", "ord", "rule.key", "rule.label", F.col("_b").isNotNull().alias("present"), F.coalesce(F.get("_at", F.col("_b")), F.lit(0)).alias("line"), issues.alias("issues"))


def byline_warnings(text: Column, byline: Byline = BYLINE) -> Column:
    """Drift of company, city and corresponding author; never a failure."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    named = F.contains(low, F.lit(byline.word.lower()))
    return F.array_compact(
        F.array(
            F.when(named & ~F.contains(low, F.lit(byline.company.lower())), F.lit(f"company not written {byline.company}")),
            F.when(named & low.rlike(rf"(?U)\b{byline.other_city.lower()}\b"), F.lit(f"{byline.other_city} is not the company's city")),
            F.when(t.rlike(rf"(?U)\b{byline.surname}\b") & ~F.contains(t, F.lit(byline.full_name)), F.lit(f"corresponding author not written {byline.full_name}")),
        )
    )
