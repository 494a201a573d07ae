"""SentencePiece models run by the tokenizers library.

The model's protobuf is read here, field by field, and turned into a tokenizers
pipeline: the stored character map, the metaspace marker, pieces with their scores
(a unigram lattice, or a merge order for BPE models) and bytes for unknown characters.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import map_arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id bigint, ids array<int>, n_tokens int"
ROUND_TRIP = f"{SCHEMA}, text string, same boolean"
#: Texts on which a model's ids must be those of the sentencepiece library before it is used.
PROBES = ("", " ", "Hello, world!", "two  blanks ", " front", "line\none\ttab", "Größe, été, año, Привет, γεια", "日本語 テスト", "😀 \u200b \x00", "<s></s><unk><0x0A>", "▁ a▁b", "3.14159 42 1,000", "camelCase snake_case", "é", "a" * 300, "word " * 50)
MARK = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6
#: Characters handed to the encoder's threads at once, and threads of a worker (an executor's cores share the work already).
BATCH_CHARS = 2_000_000
THREADS = 2
#: Words whose pieces a worker remembers; when there are more, it starts anew.
CACHE_WORDS = 250_000
#: Unseen words are handed to the library in texts of so many, and so many of these texts at once.
JOINED, LEARNED = 256, 16


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        value |= (b & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if b < 0x80:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def parse(data: bytes) -> Model:
    """The parts of a model file that encoding and decoding need."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(_fields(value))
            m.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback, m.unknown, m.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if m.kind not in (UNIGRAM, BPE) or not m.escape or m.suffix:
        raise ValueError("only unigram and BPE models with a leading metaspace marker can be run")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """A BPE model's merges, best first: every way to make a piece of two others, at the rank of the piece's score."""
    score = {p: s for p, s, kind in m.pieces if kind in (1, USER)}
    found = []
    for order, (piece, s, kind) in enumerate(m.pieces):
        if kind == 1:
            found += [(-s, order, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in score and piece[k:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def build(data: bytes) -> Tokenizer:
    """A tokenizer equal to the model in data."""
    m = parse(data)
    unknown = m.pieces[m.unknown][0]
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=unknown, fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    normal = [p for p, _, kind in m.pieces if kind == 1]
    if m.kind == BPE and not any(MARK in p.lstrip(MARK) for p in normal):
        # No piece holds a marker after anything else, so nothing merges across these cuts; the cache then works by word.
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in m.pieces if kind == USER]
    if own:
        t.add_tokens(own)
    after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        after.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(after)
    return t


def splits_at_blanks(m: Model) -> bool:
    """Whether a text without runs of blanks is coded as its words are, one by one."""
    plain = m.kind == BPE and m.dummy_prefix and not m.charsmap and not m.squeeze
    return plain and not any(kind == USER or kind == 1 and MARK in p.lstrip(MARK) for p, _, kind in m.pieces)


def _joined(parts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of parts (large binaries) one after the other as they lie in Arrow's buffer, and where each begins, the end being last."""
    ends = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    return memoryview(parts.buffers()[2] or b"")[: ends[-1]], ends


class Coder:
    """A tokenizer and the words it has coded."""

    def __init__(self, data: bytes):
        self.tokenizer, self.by_word = build(data), splits_at_blanks(parse(data))
        self.known: dict[str, bytes] = {}
        if self.by_word:
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            self.opens = np.array([p.startswith(MARK) for p, _, _ in parse(data).pieces])
        m = parse(data)
        # What each id stands for in a text; none for those whose decoding is the library's business.
        plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind == 1 else None for p, _, kind in m.pieces]
        self.strip, self.plain = m.dummy_prefix, np.array([x is not None for x in plain])
        self.pieces = pa.array([x or b"" for x in plain], pa.large_binary())

    def _learn(self, words: list[str]) -> None:
        """Adds words to known: marked and joined into long texts; each opens with the only marked piece it has."""
        plain = [w for w in words if w and MARK not in w]
        if len(plain) < len(words):
            rest = [w for w in words if not w or MARK in w]
            self.known.update(zip(rest, self._whole(rest)))
        for k in range(0, len(plain), JOINED * LEARNED):
            some = plain[k : k + JOINED * LEARNED]
            texts = [MARK + f" {MARK}".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
            ids = np.concatenate([np.array(c.ids, np.int32) for c in self.words.encode_batch_fast(texts, add_special_tokens=False)])
            cuts = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4).tolist()
            raw = ids.tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(c.ids, np.int32).tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; a null text has none. Words stay in Arrow's buffers but for those that are new."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        if not self.by_word:
            coded = self._whole(column.to_pylist())
            return np.frombuffer(b"".join(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        odd = pc.or_(pc.match_substring(column, "  "), pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")))
        plain = pc.and_not(pc.greater(pc.binary_length(column), 0), odd)
        words = pc.split_pattern(column.filter(plain), " ")
        count = np.zeros(len(column), np.int64)
        count[plain.to_numpy(zero_copy_only=False)] = words.value_lengths().to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        del words
        unique = coded.dictionary.to_pylist()
        if len(self.known) + len(unique) > CACHE_WORDS:
            self.known.clear()
        self._learn([w for w in unique if w not in self.known])
        ids, ends = _joined(pa.array([self.known[w] for w in unique], pa.large_binary()).take(coded.indices))
        ids, ends = np.frombuffer(ids, np.int32), ends // 4
        stop = np.cumsum(count)
        sizes = ends[stop] - ends[stop - count]
        special = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if special:
            whole = dict(zip(special, self._whole(column.filter(odd).to_pylist())))
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            parts = [np.frombuffer(whole[i], np.int32) if i in whole else ids[cuts[i] : cuts[i + 1]] for i in range(len(column))]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids, of which each has so many: the pieces' bytes one after the other, or where these are not a text's, what the library makes of them."""
        stop = np.cumsum(sizes)
        data, ends = _joined(self.pieces.take(pa.array(ids)))
        cuts = ends[np.concatenate(([0], stop))]
        odd = np.concatenate(([0], np.cumsum(~self.plain[ids], dtype=np.int32)))
        out = []
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            begin = int(stop[k] - sizes[k])
            text = None
            if odd[stop[k]] == odd[begin]:
                try:
                    text = str(data[a:b], "utf-8")
                except UnicodeDecodeError:
                    pass  # bytes that make no character
            if text is None:
                text = self.tokenizer.decode(ids[begin : stop[k]].tolist(), skip_special_tokens=False)
            elif self.strip and text[:1] == " ":
                text = text[1:]
            out.append(text)
        return out


_built: dict[str, Coder] = {}


def load(path: str) -> Coder:
    """The coder of a model file, once for each process."""
    if path not in _built:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            _built[path] = Coder(f.read())
    return _built[path]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    first = total = 0
    size = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    for i, n in enumerate(size):
        if total and total + n > BATCH_CHARS:
            yield first, i
            first, total = i, 0
        total += n + 1
    if first < len(size):
        yield first, len(size)


def _encode_column(coder: Coder, texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    for a, b in _runs(texts):
        part = texts.slice(a, b - a)
        ids, sizes = coder.encode(part)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(part.is_null().to_numpy(zero_copy_only=False), False) if part.null_count else None)
        yield a, b, pa.ListArray.from_arrays(offsets, pa.array(ids))


def verify(model: str, texts: tuple[str, ...] = PROBES) -> None:
    """ValueError if the ids of texts, or the texts of these ids, are not those of the sentencepiece library."""
    import sentencepiece

    coder, other = load(model), sentencepiece.SentencePieceProcessor(model_file=model)
    ids, sizes = coder.encode(list(texts))
    want = other.encode(list(texts))
    if [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] != want or coder.decode(ids, sizes) != other.decode(want):
        raise ValueError(f"{model} can't be run as the sentencepiece library runs it")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and n_tokens for each row of docs; the whole text, however long, no special tokens.

    A null text has null ids and n_tokens; an empty one has no ids. Text that looks like a control piece is ordinary text.
    Repeated rows get equal results; other columns, whatever their names, are ignored. An empty table gives an empty one. model is a path that the driver and all executors
    can read; it is verified first.
    """
    verify(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        for a, b, ids in _encode_column(coder, batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(a, b - a), ids, ids.value_lengths()], names=["doc_id", "ids", "n_tokens"])

    return map_arrow(_input(docs), run, SCHEMA)


def _decode_column(coder: Coder, ids: pa.ListArray) -> pa.Array:
    size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = coder.decode(ids.flatten().to_numpy(zero_copy_only=False), size)
    return pa.array([t if there else None for t, there in zip(texts, ids.is_valid().to_pylist())], pa.string())


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for each row of encode()'s result (doc_id, ids); null ids give a null text, no ids an empty one. Repeated rows get equal results; other columns are ignored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), _decode_column(load(model), batch.column(1))], names=["doc_id", "text"])

    return map_arrow(tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """encode()'s columns and text, what decode() makes of the ids, and same, whether that is the text (metaspace markers in a text count as blanks). A null text has nulls."""
    verify(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder, texts = load(model), batch.column(1)
        for a, b, ids in _encode_column(coder, texts):
            back = _decode_column(coder, ids)
            same = pc.equal(pc.replace_substring(texts.slice(a, b - a), MARK, " "), back)
            yield pa.record_batch([batch.column(0).slice(a, b - a), ids, ids.value_lengths(), back, same], names=["doc_id", "ids", "n_tokens", "text", "same"])

    return map_arrow(_input(docs), run, ROUND_TRIP)
