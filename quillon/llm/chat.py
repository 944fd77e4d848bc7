"""Chat formatting with typed content parts, by DataFrame operations only.

A visitor goes over a turn's content parts: text stays, an image, audio or
document part becomes a numbered placeholder, and each attachment is recorded
with its reference and the tokens that it will expand to. A plain text is the one
part of its turn. Turns are framed by the template below; control strings inside
texts and roles are escaped in a way that :func:`unescape` undoes exactly. They are
sought in a turn's joined texts, so that parts cannot make one between them.

    <|begin|><|turn|>ROLE\\nCONTENT<|end|>\\n ...

Turns are rendered row by row before anything is grouped. One shuffle by
conversation then orders and joins them: a conversation's output is one value,
so its turns must meet; conversations themselves spread freely.

Defined results: null text and null role are empty; a null conversation id is a
conversation of its own; null turns come first; equal turns are ordered by role,
then content, and repeated rows are repeated turns; an empty table gives no
rows; a null list of parts and a null part are empty. Texts are whole however long: a
conversation must fit into one value of Spark's, 2 GB. Only the named columns are read,
whatever others are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BEGIN, TURN, END = "<|begin|>", "<|turn|>", "<|end|>"
#: Control strings of this and of common templates; none is left in a rendered text.
CONTROL = ("<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def _code(char: str) -> str:
    return f"%{ord(char):02X}"


#: How a placeholder stands in a text until control strings are escaped: no text has
#: a % that 25 does not follow by then.
_MARK = r"%#([a-z]+:[0-9]+)#"


def _percent(text: Column) -> Column:
    return F.replace(text, F.lit("%"), F.lit("%25"))


def _closed(text: Column) -> Column:
    """Percent-encodes the first character of each control string, then puts the placeholders in."""
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(_code(control[0]) + control[1:]))
    return F.regexp_replace(text, _MARK, "<|$1|>")


def escape(text: Column) -> Column:
    """Percent-encode each % and the first character of each control string."""
    return _closed(_percent(text))


def unescape(text: Column) -> Column:
    for char in dict.fromkeys([c[0] for c in CONTROL] + ["\n", "%"]):
        text = F.replace(text, F.lit(_code(char)), F.lit(char))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("%0A"))


# -- the visitor: what each type of part expands to, in tokens ----------------


def _image(part: Column) -> Column:
    side = lambda n: F.ceil(F.coalesce(n, F.lit(PATCH)) / PATCH)
    return F.greatest(side(part["width"]) * side(part["height"]), F.lit(1)).cast("long")


def _audio(part: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)).cast("long")


def _document(part: Column) -> Column:
    return F.greatest(F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS, F.lit(1)).cast("long")


VISITOR: dict[str, Callable[[Column], Column]] = {"image": _image, "audio": _audio, "document": _document}


def text_part(text: Column) -> Column:
    """A plain text as the one part of its turn."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()]))


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")).isin(*VISITOR)


def visit(parts: Column, before: Column) -> Column:
    """Parts in order -> array<struct<text, attachment>>; :func:`body` joins the
    texts. ``before``: attachments of the conversation ahead of this turn. An unknown
    type counts as text; a null part is empty."""
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (before + F.size(F.filter(F.slice(parts, 1, i), _attached)) + 1).alias("n")))

    def one(x: Column) -> Column:
        p, n = x["p"], x["n"]
        tokens = F.lit(0).cast("long")
        for kind, count in VISITOR.items():
            tokens = F.when(p["type"] == kind, count(p)).otherwise(tokens)
        held = F.struct(n.cast("int").alias("n"), p["type"].alias("type"), p["ref"].alias("ref"), tokens.alias("tokens"))
        mark = F.concat(F.lit("%#"), p["type"], F.lit(":"), n.cast("string"), F.lit("#"))
        return F.struct(F.when(_attached(p), mark).otherwise(_percent(F.coalesce(p["text"], F.lit("")))).alias("text"), F.when(_attached(p), held).alias("attachment"))

    return F.transform(numbered, one)


def body(seen: Column) -> Column:
    """The text of a turn whose parts have been visited."""
    return _closed(F.array_join(F.transform(seen, lambda x: x["text"]), ""))


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` (string), ``mask``
    (array<struct<turn, start, length, at>>: the spans to learn from, ``start``
    in code points of the whole, ``at`` of the turn's own text), ``attachments``
    (array<struct<n, type, ref, tokens>>) and ``attachment_tokens``. ``content``
    is a string or an array of parts (:data:`PARTS`)."""
    base = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), rows[role].alias("role"), rows[content].alias("content"))
    order = W.partitionBy("conv").orderBy("turn", "role", "content")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    if dict(rows.dtypes)[content] == "string":  # a plain text attaches nothing
        base = base.withColumn("_seen", visit(text_part(F.col("content")), F.lit(0)))
    else:
        parts = F.coalesce(F.col("content"), F.array().cast(PARTS))
        base = base.withColumn("_ahead", F.coalesce(F.sum(F.size(F.filter(parts, _attached))).over(earlier), F.lit(0)))
        base = base.withColumn("_seen", visit(parts, F.col("_ahead")))
    held = F.filter(F.transform("_seen", lambda x: x["attachment"]), lambda x: x.isNotNull())
    framed = (
        base.withColumn("_role", _role(F.col("role")))
        .withColumn("_body", body(F.col("_seen")))
        .withColumn("_held", held)
        .withColumn("_turn", F.concat(F.lit(TURN), "_role", F.lit("\n"), "_body", F.lit(END + "\n")))
        .withColumn("_start", F.coalesce(F.sum(F.length("_turn")).over(earlier), F.lit(0)) + len(BEGIN))
        .withColumn("_n", F.row_number().over(order))
        .withColumn("_at", F.length("_role") + 1)
    )
    span = F.struct(F.col("_n").alias("turn"), (F.col("_start") + len(TURN) + F.col("_at")).cast("long").alias("start"), F.length("_body").cast("long").alias("length"), F.col("_at").alias("at"))
    return (
        framed.groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("_n", F.col("_turn").alias("text"), F.when(F.coalesce(F.col("role"), F.lit("")).isin(*learn), span).alias("span"), F.col("_held").alias("held")))).alias("_all"))
        .select(
            F.col("conv").alias(conv),
            F.concat(F.lit(BEGIN), F.array_join(F.transform("_all", lambda x: x["text"]), "")).alias("formatted"),
            F.filter(F.transform("_all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("mask"),
            F.flatten(F.transform("_all", lambda x: x["held"])).alias("attachments"),
        )
        .withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text: array<struct<role, body>>, still escaped."""
    inner = lambda b: F.substring_index(b, END, 1)
    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 2**30), lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), inner(b).alias("body")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    turns = format_chat(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(F.substring(t["body"], F.length(t["role"]) + 2, F.lit(2**31 - 1))), F.lit("\n")))
    learnt = F.transform("mask", lambda m: unescape(F.substring(F.get("turns", m["turn"] - 1)["body"], (m["at"] + 1).cast("int"), m["length"].cast("int"))))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.array_join(learnt, "").alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


_escaped = "replace({}, '%', '%25')"
for _c in CONTROL:
    _escaped = f"replace({_escaped}, '{_c}', '{_code(_c[0]) + _c[1:]}')"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, text, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said,
         coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') AS loss,
         {len(BEGIN)} + sum({len(TURN) + len(END) + 2} + length({_escaped.format("r")}) + 2 * (length(r) - length(replace(r, chr(10), ''))) + length({_escaped.format("t")})) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
