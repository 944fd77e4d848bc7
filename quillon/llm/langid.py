"""Language identification by compression.

Each language is a raw-content dictionary for zstandard, filled with text of
that language. A text is encoded with every dictionary, and the one that makes
it smallest names its language; a narrow margin over the second best rejects it.

The dictionaries are filled from a bounded sample of labelled rows: whole texts in the
order of the hash of the id, whatever their length, at most :data:`PER_LANG` documents a
language, until :data:`DICT_BYTES` bytes are full; what goes beyond them is cut off.
Everything else covers whole texts: they are encoded in pieces of :data:`PIECE` bytes, so
that the dictionary matters to the end of a long text and memory does not grow with it.
One pass, no shuffle of texts.

Defined results: a text that is null or has no letter is ``und`` with score 0
and is rejected; ties go to the language with most labelled rows, then by name; with one
known language every other text is of it, with score 1; with none all are
``und``. Repeated rows are treated alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, table

PER_LANG, DICT_BYTES = 240, 110_000
PIECE, LEVEL = 8192, 5
#: zstandard stores a tiny text as it is; these zero bytes after every piece make
#: every text worth encoding. All dictionaries and all pieces pay alike.
FILL = bytes(256)
#: Share of the second best size that separates it from the best, below which a
#: text is rejected.
NARROW = 0.004


def has_letter(text: str) -> bool:
    """Whether any character is a letter by its category: digits, fractions and powers are none."""
    return any(map(str.isalpha, text))


_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces between words."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split())


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> dict[str, bytes]:
    """language -> dictionary, most frequent language first. Labelled rows are taken in order of a hash of
    their ids, whole texts, until they fill a dictionary, at most ``per_lang`` a language; the
    limit is applied within tasks before rows are dealt out. Texts are read and reduced to letters in
    tasks; of each, what a dictionary can hold goes to the driver."""
    rank = W.partitionBy("lang").orderBy("h", "id", "bytes")
    rows = docs.select(docs[key].alias("id"), docs[lang].alias("lang"), docs[text].alias("text")).filter("lang IS NOT NULL AND id IS NOT NULL")
    size = F.octet_length("text")
    ids = rows.filter(size > 0).select("id", "lang", size.alias("bytes"), F.xxhash64("id", F.lit("langid")).alias("h"))
    ids = ids.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_lang)
    chosen, room = {}, {}
    for r in sorted(ids.select("lang", "r", "id", "bytes").collect()):
        if room.setdefault(r["lang"], 2 * DICT_BYTES) > 0:  # what is no letter goes, so up to twice the bytes are read
            room[r["lang"]] -= r["bytes"]
            chosen.setdefault(r["id"], r["r"])

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            each = [plain(t)[:DICT_BYTES] if t and has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(each, pa.binary())], ["id", "lang", "plain"])

    out: dict[str, list] = {}
    some = rows.filter(F.col("id").isin(list(chosen))).mapInArrow(lean(letters), rows.select("id", "lang").schema.add("plain", "binary")) if chosen else None
    for r in some.collect() if some else []:
        if r["plain"] is not None:
            out.setdefault(r["lang"], []).append((chosen[r["id"]], r["id"], bytes(r["plain"])))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()} if out else {}
    return {k: b" ".join(x[2] for x in sorted(v))[:DICT_BYTES] for k, v in sorted(out.items(), key=lambda x: (-counts[x[0]], x[0]))}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.each = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, max(len(data), 1), PIECE)]
        return np.array([sum(len(c.compress(p + FILL)) for p in pieces) for c in self.each])

    def guess(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """language, score, accepted. The score is one half at the narrow margin."""
        if not self.each or not text or not has_letter(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        second = np.partition(sizes, 1)[1]
        margin = float(second - sizes[best]) / float(second)
        return self.names[best], margin / (margin + narrow), margin >= narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", narrow: float = NARROW) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``lang_ok``; columns of those names are replaced."""
    new = ("lang_pred", "score", "lang_ok")
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double").add("lang_ok", "boolean")
    at = kept.index(text)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most DICT_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(held.value)
        for batch in batches:
            found = [model.guess(t.as_py(), narrow) for t in batch.column(at)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *new])

    return docs.select(kept).mapInArrow(lean(run), schema)


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn(docs.filter(remainder(F.col("doc_id")) != 1))
    rows = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return identify(rows, dictionaries).select("doc_id", "held_out", "lang_pred", "score", F.col("lang_ok").alias("accepted"))
