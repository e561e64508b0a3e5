"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here, field by field, and its parts are rebuilt: the normaliser (the compiled
character map, extra white space, dummy prefix), the metaspace marker, the pieces with their unigram scores or, for a
BPE model, the merges that these scores rank, user-defined pieces, and byte fallback.  Batches are encoded with the
library's threads.  `parity` compares ids with the sentencepiece library on given texts.

Texts are cut where the model cannot join pieces: no piece of such a model holds a marker after another character, so a
text's encoding is the concatenation of its words' encodings.  The cuts are checked against the vocabulary, and
the whole normalised text is encoded where a piece breaks the rule.  Each Arrow batch encodes its distinct words
once and then gathers.  The model's bytes are broadcast: they have a fixed size, and executors need no file.  A Python worker builds a model's
codec once.

`encode` checks the round trip: in a batch that is encoded by words, each distinct word is decoded, with a decoder that keeps leading spaces,
and a text is right if all its words are, as a text's decoding is theirs, one after the other; in a batch encoded as
whole texts, each text is decoded.  `decode` decodes whole rows.

Edge cases: a null text has null ids, and decodes to null; an empty one has none; texts of any length are taken whole;
repeated rows get equal ids; an empty table gives an empty result; other columns pass through, and the output columns replace
existing ones of their names.
"""
from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_arrow

MARK = "\u2581"
#: Kinds of pieces and of models, by the numbers of the public protobuf schema (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct words encoded at once.
WORDS = 16_384


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        n = varint() if n is None else n
        yield tag >> 3, data[at : at + n]
        at += n


def parse_model(data: bytes) -> dict:
    """pieces [(piece, score, kind)], model type, normaliser and trainer settings that encoding needs."""
    model: dict = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "dummy_prefix": True, "strip_extra": True, "escape": True, "suffix": False}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model |= {"type": trainer.get(3, UNIGRAM), "suffix": bool(trainer.get(24, 0)), "byte_fallback": bool(trainer.get(35, 0)), "unk_id": trainer.get(40, 0)}
        elif number == 3:
            normal = dict(_fields(value))
            model |= {"charsmap": normal.get(2, b""), "dummy_prefix": bool(normal.get(3, 1)), "strip_extra": bool(normal.get(4, 1)), "escape": bool(normal.get(5, 1))}
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores stand for: every way to join two pieces into a third, best score first."""
    joinable = {p: s for p, s, kind in pieces if kind in (NORMAL, USER, UNUSED)}
    order = {p: i for i, (p, _, _) in enumerate(pieces)}
    out = []
    for piece, score in joinable.items():
        halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in joinable and piece[k:] in joinable]
        out += [(-score, order[a], order[b], a, b) for a, b in halves]
    return [(a, b) for _, _, _, a, b in sorted(out)]


def build(m: dict, merges: list[tuple[str, str]]):
    """The tokenizers backend of a parsed model; merges are a BPE model's."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if m["suffix"]:
        raise ValueError("models with white space as suffix are not supported")
    pieces = m["pieces"]
    unk = pieces[m["unk_id"]][0]
    if m["type"] == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, merges, unk_token=unk, fuse_unk=True, byte_fallback=m["byte_fallback"], cache_capacity=0)
    elif m["type"] == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=m["unk_id"], byte_fallback=m["byte_fallback"])
    else:
        raise ValueError(f"model type {m['type']} is not supported")
    out = Tokenizer(model)
    steps = []
    if m["charsmap"]:
        steps.append(normalizers.Precompiled(m["charsmap"]))
    if m["strip_extra"]:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])])
    if user := [AddedToken(p, normalized=False, special=False) for p, _, kind in pieces if kind == USER]:
        out.add_tokens(user)
    return out


def cuttable(model: dict) -> bool:
    """Whether words, each with the markers before it, can be encoded one by one."""
    return model["escape"] and not any(kind == USER or MARK in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind in (NORMAL, USER, UNUSED))


class Codec:
    """A model ready to encode and decode Arrow arrays of strings."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model = parse_model(data)
        merges = _merges(self.model["pieces"]) if self.model["type"] == BPE else []
        self.whole = build(self.model, merges)
        self.words = None
        if cuttable(self.model):
            from tokenizers import decoders, normalizers

            self.words = build(self.model, merges)
            self.words.normalizer = normalizers.Sequence([])
            self.words.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        kinds = [kind for _, _, kind in self.model["pieces"]]
        self.n_pieces = len(kinds)

    def normalised(self, texts: list[str]) -> list[str]:
        normal = self.whole.normalizer.normalize_str
        return [normal(x) if x else "" for x in texts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the place after each text's last, and whether decoding gives each normalised text back."""
        flat = self.normalised(texts)
        if self.words is None or any("\x00" in x for x in flat):
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            back = self.whole.decode_batch(ids, skip_special_tokens=False)
            right = [x == self.plain(y) for x, y in zip(back, flat)]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([len(x) for x in ids], dtype=np.int64), np.array(right, bool)
        # A word is a run of markers and what follows up to the next: cut before each marker that has no marker before it.
        cut = pc.replace_substring(pa.array(flat, pa.large_string()), MARK, "\x00" + MARK)
        for _ in range(2):  # runs of any length are whole after two passes over pairs
            cut = pc.replace_substring(cut, MARK + "\x00" + MARK, MARK + MARK)
        cut = pc.split_pattern(cut, "\x00")
        coded = pc.list_flatten(cut).dictionary_encode()
        sizes, pool, wrong = (np.concatenate(x) for x in zip(*self._words(coded.dictionary)))
        first = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = sizes[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[word] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = cut.offsets.to_numpy()
        errors = np.concatenate([[0], np.cumsum(wrong[word])])[offsets]
        return ids, ends[offsets[1:]], errors[1:] == errors[:-1]

    def _words(self, distinct: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of ids, ids, and faults of distinct words, some thousands at a time: the library's encodings are large.

        Words are decoded without what only a text's start loses; a text's decoding is theirs, one after the other.
        """
        for at in range(0, max(1, len(distinct)), WORDS):
            words = distinct.slice(at, WORDS).to_pylist()
            each = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
            back = self.words.decode_batch(each, skip_special_tokens=False)
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            pool = np.fromiter(chain.from_iterable(each), np.int32, int(sizes.sum()))
            yield sizes, pool, np.fromiter((x.replace(MARK, " ") != y for x, y in zip(words, back)), bool, len(words))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return self.whole.decode_batch([ids[a:b].tolist() for a, b in zip(starts, ends)], skip_special_tokens=False)

    def plain(self, normalised: str) -> str:
        """What decoding must give."""
        out = normalised.replace(MARK, " ")
        return out[1:] if self.model["dummy_prefix"] else out


@lru_cache(maxsize=1)
def codec_of(data: bytes, threads: int) -> Codec:
    """The codec of a model, kept by the Python worker."""
    return Codec(data, threads)


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes, read by the driver: from its own disk, or from any place that Spark reads."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])


def _replacing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


def encode(df: DataFrame, model_path: str, text: str = "text", threads: int = 2, ids: str = "ids", check: bool = True) -> DataFrame:
    """df with ids array<int>, n_tokens bigint and, if check, round_trip boolean: decoding gives the normalised text back."""
    df = df if text == ids else _replacing(df, [ids, "n_tokens", "round_trip"])
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model_bytes(df.sparkSession, model_path))
    more = f"{ids} array<int>, n_tokens bigint" + ", round_trip boolean" * check
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, threads)
        for batch in batches:
            for part in _bounded(batch, at):
                texts = part.column(at).to_pylist()
                filled = [x or "" for x in texts]
                found, ends, right = codec.encode(filled)
                null = np.array([x is None for x in texts], bool)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(null, False))
                n = np.diff(np.concatenate([[0], ends]))
                cols = [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())), pa.array(n.astype(np.int64), mask=null)]
                if check:
                    cols.append(pa.array(right, mask=null))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_arrow(df, run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """df with the texts of its ids; ids outside the vocabulary raise an error."""
    df = _replacing(df, [text])
    at = df.columns.index(ids)
    shared = df.sparkSession.sparkContext.broadcast(model_bytes(df.sparkSession, model_path))
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, threads)
        for batch in batches:
            given = batch.column(at).to_pylist()
            if any(not 0 <= i < codec.n_pieces for x in given if x for i in x):
                raise ValueError("an id is outside the vocabulary")
            out = codec.whole.decode_batch([x or [] for x in given], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else y for x, y in zip(given, out)], pa.string())], names=schema.names)

    return map_arrow(df, run, schema)


def _bounded(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def parity(data: bytes, texts: list[str]) -> list[str]:
    """Texts whose ids differ from the sentencepiece library's."""
    import sentencepiece

    codec, other = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, ends, _ = codec.encode(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return [x for x, a, b in zip(texts, starts, ends) if ids[a:b].tolist() != other.encode(x)]
