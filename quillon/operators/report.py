"""One table of findings for all checks of a text, in one pass, and where it goes.

Every check's findings get the same columns: keys, ``check``, ``kind``, ``severity``, ``line``
(0: the whole document), ``token``, ``suggestion``, ``snippet``, ``message``, and the numbers by
which they are ordered: ``rank`` of the check, ``rule``, ``part``, ``pos``. The manuscripts are
read once: a document is cut into its parts, judged as a whole, and exploded into its
lines and one row for the whole; the rules run on the lines, and nothing is shuffled.

Order: by keys, check, line, errors first, then rule, part and place: :func:`in_order` deals the
rows by ranges of all of these, so that a document with very many findings is cut too.
:func:`write` keeps that order in files of JSON lines.

Severities: ``error`` makes a document suspect, ``warning`` and ``note`` do not. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import lines, spans
from . import declarations, numbering, wording
from .policy import Journal
from .segments import split_manuscript

CHECKS = ("citations", "floats", "sections", "typography", "editorial", "units", "consistency", "statements")
FINDING = "check string, rank int, line int, rule int, part int, pos int, kind string, severity string, token string, suggestion string, snippet string, message string"
_ARRAY = "array<struct<" + ",".join(f.replace(" ", ":") for f in FINDING.split(", ")) + ">>"
_SEVERITY = ("error", "warning", "note")


def _finding(check: str, kind, severity, token, message, line=0, rule=0, part=0, pos=0, suggestion="", snippet="") -> Column:
    as_column = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    given = {"check": check, "rank": CHECKS.index(check), "line": line, "rule": rule, "part": part, "pos": pos, "kind": kind, "severity": severity, "token": token, "suggestion": suggestion, "snippet": snippet, "message": message}
    return F.struct(*[as_column(given[name], kind).alias(name) for name, kind in (f.split() for f in FINDING.split(", "))])


def _each(check: str, rule: int, values: Column, kind: str, severity: str, message: str) -> Column:
    """A finding for each value; ``message`` has its place for it."""
    before, after = message.split("{}")
    return F.transform(values, lambda v, i: _finding(check, kind, severity, v.cast("string"), F.concat(F.lit(before), v.cast("string"), F.lit(after)), rule=rule, pos=i))


def _once(check: str, rule: int, when: Column, kind: str, severity: str, message: str, part: int = 0) -> Column:
    return F.when(when, F.array(_finding(check, kind, severity, "", message, rule=rule, part=part))).otherwise(F.array().cast(_ARRAY))


def _citations() -> Column:
    """Of columns of ``numbering.check_citations``; nothing to say without markers or a list."""
    judged = F.concat(
        _each("citations", 0, F.col("missing"), "missing-entry", "error", "[{}] is cited and not listed"),
        _each("citations", 1, F.col("orphans"), "uncited-entry", "error", "[{}] is listed and not cited"),
        _each("citations", 2, F.col("gaps"), "gap", "error", "the list lacks [{}]"),
        _each("citations", 3, F.col("duplicates"), "duplicate", "error", "[{}] is listed twice"),
        _once("citations", 4, F.col("out_of_order"), "order", "error", "the list does not follow the order of citation"),
    )
    return F.when(F.size("cited") == 0, F.array().cast(_ARRAY)).when(F.size("listed") == 0, F.array(_finding("citations", "no-list", "error", "", "citations without a list"))).otherwise(judged)


def _floats(found: Column) -> Column:
    out = []
    for i, kind in enumerate(("table", "figure")):
        heads, named = numbering.captions(found, kind), numbering.mentions(found, kind)
        once = F.array_distinct(heads)
        one = (
            _each("floats", 5 * i, numbering.absent(named, heads), f"{kind}-without-caption", "error", f"{kind} {{}} is mentioned and has no caption"),
            _each("floats", 5 * i + 1, numbering.absent(once, named), f"{kind}-not-mentioned", "warning", f"{kind} {{}} is mentioned nowhere"),
            _each("floats", 5 * i + 2, numbering.gaps(heads), f"{kind}-gap", "error", f"there is no {kind} {{}}"),
            _each("floats", 5 * i + 3, numbering.duplicates(heads), f"{kind}-twice", "error", f"{kind} {{}} has two captions"),
            _once("floats", 5 * i + 4, once != F.array_sort(once), f"{kind}-order", "error", f"the {kind}s are not in order"),
        )
        out.append(F.when(F.size(heads) + F.size(named) > 0, F.concat(*one)).otherwise(F.array().cast(_ARRAY)))
    return F.concat(*out)


def _whole(df: DataFrame, text: str, journal: Journal | None, rules: dict | None) -> DataFrame:
    """Adds ``_whole``, the findings on documents as wholes, to split manuscripts."""
    rows = numbering.check_citations(df, text, split=False).withColumn("_citations", _citations())
    rows = rows.withColumn("_found", numbering.floats(F.col("body"))).withColumn("_floats", _floats(F.col("_found")))
    rows = numbering.check_sections(rows)
    sections = F.concat(_each("sections", 0, F.col("dangling"), "no-heading", "error", "section {} has no heading"), _each("sections", 1, F.col("si_floats"), "supplement", "note", "refers to {}"))
    rows = wording.check_units(rows.withColumn("_sections", sections), text, journal, split=False)
    rows = rows.withColumn("_units", F.transform("findings", lambda f, i: _finding("units", f["kind"], f["severity"], "", f["message"], rule=i)))
    rows = wording.check_consistency(rows, text, split=False)
    rows = rows.withColumn("_values", F.transform("mismatches", lambda q, i: _finding("consistency", "no-such-value", "error", q["text"], F.concat(F.lit("the main text does not have "), q["text"]), pos=i)))
    rows = declarations.check_statements(rows, text, journal, rules)
    said = F.flatten(F.transform("statements", lambda s, i: F.transform(s["issues"], lambda m, j: _finding("statements", F.when(s["present"], "wording").otherwise("missing"), "error", s["key"], F.concat(s["label"], F.lit(": "), m), line=s["line"], rule=i, pos=j))))
    extra = F.transform("extra_issues", lambda m, j: _finding("statements", "facility", "error", "", m, rule=1000, pos=j))
    return rows.withColumn("_whole", F.concat("_citations", "_floats", "_sections", "_units", "_values", said, extra))


def _sentences(prose: Column, limit: int = 40) -> Column:
    def of(line: Column, i: Column) -> Column:
        long_ = F.filter(spans(line, wording._RUN), lambda s: wording.is_long(s["m"], limit))
        return F.transform(long_, lambda s: _finding("editorial", "long-sentence", "warning", F.concat(wording.n_words(s["m"]).cast("string"), F.lit(" words")), "", line=i + 1, rule=8, pos=s["start"], suggestion=wording.TOO_LONG, snippet=F.trim(F.substring(wording.trimmed(s["m"]), 1, 60))))

    return F.flatten(F.transform(F.split(prose, "\n", -1), lambda line, i: F.when(F.length(line) > 2 * limit, of(line, i)).otherwise(F.array().cast(_ARRAY))))


def findings(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), journal: Journal | None = None, rules: dict | None = None, severity: str | None = None, apart: bool = False) -> DataFrame:
    """keys and the columns of :data:`FINDING`, of all checks, by one read of ``df``. With a ``severity``
    rules over lines of any other are not run, and findings of any other left out;
    ``apart`` as in ``wording.INITIAL``."""
    body = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    parts = _whole(split_manuscript(body, "_t"), "_t", journal, rules)
    asked = lambda s: severity in (None, s)
    whole = F.concat("_whole", _sentences(F.col("prose"))) if asked("warning") else F.col("_whole")
    whole = F.filter(whole, lambda f: f["severity"] == severity) if severity else whole
    parts = parts.select(*keys, "_t", whole.alias("_whole"), F.size(lines(F.col("prose"))).alias("_n"))
    one = "struct<line:int,t:string>"
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.lit(None).cast("string").alias("t")).cast(one)), F.transform(lines(F.col("_t")), lambda t, i: F.struct(i.alias("line"), t.alias("t")).cast(one)))
    rows = parts.select(*keys, "_n", F.explode(units).alias("u"), "_whole").select(*keys, "_n", "u.line", F.col("u.t").alias("_l"), F.when(F.col("u.line") < 0, F.col("_whole")).alias("_whole"))
    variant = journal.spelling if journal else "American"
    chosen = lambda rules: wording._chosen(rules, None, severity)
    typo, rest = (chosen([r for r in wording.TYPOGRAPHY if (r[0] == 0) == first]) for first in (True, False))
    wordy = chosen(wording.editorial_rules(variant, apart))
    low, at = F.col("_low"), F.col("line") + 1
    # lines on which no rule can match go before any rule is tried
    mixes = wording.mixes_units(F.col("_l")) if asked("warning") else F.lit(False)
    rows = rows.withColumn("_low", F.lower(F.upper(F.col("_l")))).filter((F.col("line") < 0) | wording.may_match(F.col("_l"), [*typo, *rest, *wordy], low) | (F.contains(F.col("_l"), F.lit("K")) & mixes))

    def named(check: str, found: Column) -> Column:
        return F.transform(found, lambda x: _finding(check, x["kind"], x["severity"], x["token"], "", line=at, rule=x["rule"], part=x["part"], pos=x["pos"], suggestion=x["suggestion"], snippet=x["snippet"]))

    mixed = F.when(F.contains(F.col("_l"), F.lit("K")) & mixes, F.array(_finding("editorial", "unit-mix", "warning", "degC + K", "", line=at, rule=7, suggestion=wording.ONE_UNIT, snippet=F.substring(wording.trimmed(F.col("_l")), 1, 60)))).otherwise(F.array().cast(_ARRAY))
    issues = lambda check, chosen: named(check, wording.line_issues(F.col("_l"), chosen, low)) if chosen else F.array().cast(_ARRAY)
    warned = F.concat(issues("typography", rest), issues("editorial", wordy), mixed)
    every = F.when(F.col("line") < 0, F.col("_whole")).otherwise(F.concat(issues("typography", typo), F.when(F.col("line") < F.col("_n"), warned).otherwise(F.array().cast(_ARRAY))))
    return rows.select(*keys, F.explode(every).alias("f")).select(*keys, "f.*")


def _by(keys: Sequence[str]) -> list[Column]:
    severity = F.array_position(F.array(*[F.lit(s) for s in _SEVERITY]), F.col("severity"))
    return [*[F.col(k) for k in keys], F.col("rank"), F.col("line"), severity, F.col("rule"), F.col("part"), F.col("pos")]


def in_order(found: DataFrame, keys: Sequence[str] = ("doc_id",), partitions: int | None = None) -> DataFrame:
    """The findings in their order, over all partitions."""
    by = _by(keys)
    return (found.repartitionByRange(partitions, *by) if partitions else found.repartitionByRange(*by)).sortWithinPartitions(*by)


def write(found: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), partitions: int | None = None) -> None:
    """Files of JSON lines; read one after the other they are in order."""
    in_order(found, keys, partitions).drop("rank", "rule", "part", "pos").write.json(path)


def status(found: DataFrame, documents: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys, check, status for every document and check: suspect with an error, else ok."""
    every = documents.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    bad = found.filter("severity = 'error'").select(*keys, "check").distinct().withColumn("_bad", F.lit(True))
    return every.join(bad, [*keys, "check"], "left").select(*keys, "check", F.when(F.col("_bad"), "suspect").otherwise("ok").alias("status"))
