"""SentencePiece models on the tokenizers library.

The model file is read by a small protobuf reader; from its pieces and options a
tokenizers pipeline is rebuilt: the normaliser with the metaspace marker, the
unigram scores or the pair merges that the scores imply, byte fallback, and the
decoder. Batches are encoded with several threads. Ids are decoded for a whole batch
at once, from a table of the pieces' bytes that is rebuilt from the same file; ids whose
byte pieces are no UTF-8 go through the library's decoder one by one.

Parity is verified where the pipeline is used: each worker encodes
:data:`PROBES` with the rebuilt pipeline and with the sentencepiece library and
fails if an id differs, and decodes them by the table and by the library's decoder.
A test compares the ids of a whole documents table. Models with user-defined pieces
are refused.

The model's bytes are read once on the driver and broadcast: their size is the
vocabulary's and does not grow with the data. One pass, no shuffle. Encodings are made
for :data:`PART` bytes of text at a time; a longer text is cut at single spaces, where the
model's words are independent of each other, so that memory does not grow with it.

Defined results: null and empty texts have no ids and decode to the empty text; null
ids decode to the empty text; repeated rows are treated alike; a text that holds the
metaspace character itself decodes with a space in its place, as it does with the
sentencepiece library, and so does not return; an empty table gives an empty table.
Columns of the table named like a new one are replaced, all others are kept unless
dropped by name.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import lean, parts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: Bytes of text that are encoded at once.
PART = 1 << 19
SPACE = "▁"
_SINGLE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
#: Types of pieces and of models in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = ("", " ", "a", "Hello world", "  two  spaces ", "tab\tand\nline\n\n", "naïve café Straße ñandú", "日本語 텍스트 🙂", "<s>[INST] x </s> <0x0A> <unk>", "1234567890 3.14", "internationalization of antidisestablishmentarianism", "▁x", "thndonthe ererth anininin ndndnd lyly tiontion")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value = data[at : at + 8]
            at += 8
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        elif kind == 5:
            value = struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            raise ValueError(f"no model file: field kind {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list = field(default_factory=list)  # (text, score, type)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece.get(1, b"").decode("utf-8"), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            options = dict(_fields(value))
            model.kind, model.byte_fallback = options.get(3, UNIGRAM), bool(options.get(35, 0))
            if options.get(24):
                raise ValueError("models that treat the marker as a suffix are not supported")
        elif number == 3:
            options = dict(_fields(value))
            model.charsmap = options.get(2, b"")
            model.prefix, model.squeeze, model.escape = (bool(options.get(i, 1)) for i in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.kind} is not supported")
    if any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The pairs that may be joined, best first: a pair is as good as the score of what it makes."""
    ids = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    ranked = []
    for text, i in ids.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in ids and right in ids:
                ranked.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(ranked)]


def _separate(model: Model) -> bool:
    """Whether no piece goes on into a next word."""
    return model.escape and not any(SPACE in t.lstrip(SPACE) for t, _, kind in model.pieces if kind == NORMAL)


class Pieces:
    """The bytes of all pieces, and where texts may be cut."""

    def __init__(self, data: bytes):
        model = parse(data)
        each = [bytes([int(t[1:-1], 16)]) if kind == BYTE else t.replace(SPACE, " ").encode() for t, _, kind in model.pieces]
        self.lens = np.array([len(x) for x in each], np.int64)
        self.at = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(each), np.uint8)
        self.prefix = model.prefix
        self.cuts = model.prefix and not model.squeeze and not model.charsmap and _separate(model)

    def cut(self, text: str, most: int) -> list[str]:
        """Parts whose ids, in a row, are the text's: each later part gets for its
        prefix the marker of the space before it."""
        out = []
        while self.cuts and len(text) > most:
            found = _SINGLE.search(text, most)
            if found is None:
                break
            out.append(text[: found.start()])
            text = text[found.end() :]
        return [*out, text]

    def decode(self, ids: np.ndarray, upto: np.ndarray, other) -> pa.Array:
        """Texts of lists of ids; ``other`` decodes lists that this table cannot."""
        n = self.lens[ids]
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        data = self.bytes[place + np.repeat(self.at[ids], n)]
        at = np.concatenate([[0], ends])[upto]
        if self.prefix and len(data):
            first = at[:-1][at[1:] > at[:-1]]
            first = first[data[first] == 32]
            data = np.delete(data, first)
            at = at - np.searchsorted(first, at)
        got = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            got.validate(full=True)
            return got.cast(pa.string())
        except pa.ArrowInvalid:
            raw, texts = data.tobytes(), []
            for i in range(len(at) - 1):
                try:
                    texts.append(raw[at[i] : at[i + 1]].decode())
                except UnicodeDecodeError:
                    texts.append(other.decode(ids[upto[i] : upto[i + 1]].tolist(), skip_special_tokens=False))
            return pa.array(texts, pa.string())


def build(data: bytes):
    """A tokenizers.Tokenizer that encodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse(data)
    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        core = models.BPE({t: i for i, (t, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    made.normalizer = normalizers.Sequence(steps)
    if _separate(model):
        # no piece goes on into a next word, so words can be encoded, and cached, one by one
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    made.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.prefix else [])])
    return made


def differences(data: bytes, texts: list[str]) -> list[int]:
    """Numbers of the texts whose ids are not those of the sentencepiece library."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = build(data).encode_batch(texts, add_special_tokens=False)
    return [i for i, (a, b) in enumerate(zip(ours, other.encode(texts), strict=True)) if a.ids != b]


_made: dict[int, tuple] = {}


def _worker(data: bytes) -> tuple:
    """The pipeline and the table of pieces of this process, verified when they are made."""
    key = hash(data)
    if key not in _made:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        if bad := differences(data, list(PROBES)):
            raise RuntimeError(f"ids differ from the sentencepiece library for {[PROBES[i] for i in bad]}")
        made, pieces = build(data), Pieces(data)
        ids, upto = _encoded(made, pieces, list(PROBES))
        each = [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)]
        if pieces.decode(ids, upto, made).to_pylist() != made.decode_batch(each, skip_special_tokens=False):
            raise RuntimeError("the table of pieces decodes otherwise than the library")
        _made[key] = made, pieces
    return _made[key]


def _encoded(made, pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the n + 1 offsets of the texts' own."""
    cuts = [pieces.cut(t, PART) for t in texts]
    got = []
    for group in cuts:  # a long text part by part, all short ones at once
        if len(group) > 1:
            got.append(np.concatenate([np.array(made.encode(x, add_special_tokens=False).ids, np.int32) for x in group]))
    several = iter(got)
    short = iter(made.encode_batch_fast([group[0] for group in cuts if len(group) == 1], add_special_tokens=False))
    each = [next(several) if len(group) > 1 else np.array(next(short).ids, np.int32) for group in cuts]
    return np.concatenate([np.zeros(0, np.int32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, of the driver's file system or any that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", ids: str = "ids", back: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ids``, an array of int, and, if ``back`` names it, whether they decode to
    the text again. Columns in ``drop``, the text for one, do not come back."""
    new = [ids, *([back] if back else [])]
    read = [c for c in docs.columns if c not in new or c == text]
    kept = [c for c in read if c not in (*drop, *new)]
    at, places = read.index(text), [read.index(c) for c in kept]
    data = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, path))
    schema = docs.select(kept).schema.add(ids, ArrayType(IntegerType()))
    if back:
        schema = schema.add(back, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pieces = _worker(data.value)
        for batch in batches:
            for first, n in parts(batch.column(at), PART):
                part = batch.slice(first, n)
                texts = part.column(at)
                got, upto = _encoded(made, pieces, [t or "" for t in texts.to_pylist()])
                out = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(got))]
                if back:
                    out.append(pc.equal(pieces.decode(got, upto, made), texts.fill_null("")))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in places], *out], [*kept, *new])

    return docs.select(read).mapInArrow(lean(run), schema)


def decode(docs: DataFrame, path: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``text`` made from ``ids``; a column of that name is replaced; null ids make an empty text."""
    kept = [c for c in docs.columns if c != text]
    at = kept.index(ids)
    data = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pieces = _worker(data.value)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                lists = part.column(at)
                flat = lists.flatten()
                if flat.null_count:
                    raise ValueError("an id is null")
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = pieces.decode(flat.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]), made)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*kept, text])

    return docs.select(kept).mapInArrow(lean(run), docs.select(kept).schema.add(text, "string"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, back="round_trip", drop=("text",)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
