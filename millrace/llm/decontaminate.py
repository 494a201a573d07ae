"""Benchmark decontamination: an FM-index of each training shard, searched for the test items' phrases.

A shard is a run of documents of some two million characters, or one longer document, and all its words are indexed: its text is the sequence of the numbers its words
have in the shard's own vocabulary, a document's end being an end that no phrase goes across.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, chunks, free, map_batches, quoted

#: Words of a phrase; shorter items are searched whole, from MIN_WORDS on.
PHRASE, MIN_WORDS = 8, 1
#: Distance of sampled suffix positions; characters of a shard.
SAMPLE, SHARD_CHARS = 16, 2_000_000
#: Bytes of benchmark text that the driver and a task hold at once; a larger benchmark is searched in parts, each over all documents.
PART_BYTES = 16_000_000
_WORD = 64


class Rank:
    """Bits with counts of ones before any position."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % _WORD + _WORD, bool)
        self.words = np.packbits(np.concatenate((bits, pad)), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at // _WORD
        below = (np.uint64(1) << (at % _WORD).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Ranks of symbols in a sequence, a level for each bit of a symbol (levels are kept whole, zeros before ones)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Rank, int]] = []
        now = symbols
        for d in range(self.depth - 1, -1, -1):
            bit = (now >> d & 1).astype(bool)
            self.levels.append((Rank(bit), int(len(bit) - bit.sum())))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position, plus its start in the last level's order."""
        for d, (level, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            one = level.ones(at)
            at = np.where(symbol >> d & 1, zeros + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and rank() of each there."""
        symbol = np.zeros_like(at)
        for d, (level, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            one, up = level.ones(at), level.ones(at + 1)
            bit = up > one
            symbol |= bit.astype(symbol.dtype) << d
            at = np.where(bit, zeros + one, at - one)
        return symbol, at


def suffix_array(text: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text, where a position that is final ends a segment and sorts by its place, before all else.

    The first symbols of a suffix, as many as fit a number, are sorted at once; then by prefix doubling only suffixes that are still tied.
    """
    n, ends = len(text), int(final.sum())
    symbol = text.astype(np.int64) + ends
    symbol[final] = np.arange(ends)
    bits = max(1, int(symbol.max()).bit_length())
    width = max(1, min(n, 62 // bits))
    key = symbol.copy()
    for k in range(1, width):
        # What comes after an end doesn't matter: no two ends are equal.
        key <<= bits
        key[: n - k] |= symbol[k:]
    order = np.argsort(key)
    fresh = np.ones(n, bool)
    sorted_keys = key[order]
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        # A tied suffix has no end within width, so at + width is in the text.
        pair = rank[at] * n + rank[at + width]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        fresh[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        width *= 2


class FMIndex:
    """Counts and places of phrases in a sequence of symbols 1..sigma - 1; 0 ends a segment, also the last one."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.size = len(text)
        final = text == 0
        order = suffix_array(text, final)
        begins = np.append(True, final[:-1])  # a walk back stops at a segment's begin at the latest
        bwt = np.where(begins[order], 0, text[order - 1])
        self.tree = WaveletTree(bwt, sigma)
        total = np.bincount(text, minlength=sigma)
        self.start = np.cumsum(total) - total
        # start of each symbol in the wavelet tree's last order
        self.base = self.tree.rank(np.arange(sigma), np.zeros(sigma, np.int64))
        marked = begins[order] | (order % sample == 0)
        self.marked, self.places = Rank(marked), order[marked]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin with each phrase (rows of phrases x length), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, k]
            shift = self.start[s] - self.base[s]
            low[live] = shift + self.tree.rank(s, low[live])
            high[live] = shift + self.tree.rank(s, high[live])
            some = low[live] < high[live]
            high[live[~some]] = low[live[~some]]
            live = live[some]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, from the nearest sampled position before each."""
        found = np.empty(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            before = self.marked.ones(at)
            hit = self.marked.ones(at + 1) > before
            found[live[hit]] = self.places[before[hit]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            steps[live] += 1
            symbol, rank = self.tree.access(at)
            at = self.start[symbol] - self.base[symbol] + rank
        return found


class Phrases:
    """Test items as arrays: the hashes of their words, one item after the other, and each item's number, begin and end."""

    def __init__(self, items: Iterable[tuple[int, str | None]], phrase: int = PHRASE, least: int = MIN_WORDS):
        self.phrase, items = phrase, list(items)
        parts = [(first, Tokens(run)) for first, run in chunks([t for _, t in items])]
        self.words = np.concatenate([np.zeros(0, np.uint64), *(t.hash for _, t in parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(np.bincount(t.doc, minlength=len(t.bounds) - 1) for _, t in parts)])[: len(items)]
        end = np.cumsum(count)
        some = count >= max(1, least)
        self.items, self.begin, self.end = np.array([i for i, _ in items], np.int64)[some], (end - count)[some], end[some]

    def rows(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, phrases in these numbers of the words, item of each); phrases with a word of number 0, which a shard doesn't have, are left out."""
        size = np.minimum(self.end - self.begin, self.phrase)
        for n in np.unique(size).tolist():
            of = np.flatnonzero(size == n)
            many = self.end[of] - self.begin[of] - n + 1
            first = np.repeat(self.begin[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            table, item = np.lib.stride_tricks.sliding_window_view(numbers, n)[first], np.repeat(self.items[of], many)
            there = (table > 0).all(axis=1)
            yield n, table[there], item[there]


def shard_text(parts: list[Tokens]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a shard, a word's being its place in the vocabulary plus 1 and 0 a document's end; of each symbol its token (-1 for an end); the vocabulary, hashes in order."""
    words = np.concatenate([t.hash for t in parts])
    known, number = np.unique(words, return_inverse=True)
    ends, before = [], 0
    for t in parts:
        last = t.bounds[1:][np.diff(t.bounds) > 0]
        ends.append(last + before)
        before += len(t.hash)
    at = np.concatenate(ends)
    return np.insert(number + 1, at, 0), np.insert(np.arange(len(words)), at, -1), known


def find(texts: list[str | None], phrases: Phrases) -> list[list[tuple[int, int, list[int]]]]:
    """For each text of a shard the merged spans (start, end, items) that the phrases cover, in characters."""
    out: list[list[tuple[int, int, list[int]]]] = [[] for _ in texts]
    parts = [(first, Tokens(run)) for first, run in chunks(texts)]
    for _, t in parts:
        t.cp = t.inside = None  # only words are needed from here on
    if not sum(len(t.hash) for _, t in parts) or not len(phrases.items):
        return out
    text, token, known = shard_text([t for _, t in parts])
    index = FMIndex(text, len(known) + 1)
    place = np.minimum(np.searchsorted(known, phrases.words), len(known) - 1)
    numbers = np.where(known[place] == phrases.words, place + 1, 0)
    doc, start, end = (np.concatenate([x + f if name == "doc" else x for f, t in parts for x in (getattr(t, name),)]) for name in ("doc", "start", "end"))
    hits: list[tuple[int, int, int, int]] = []
    for n, table, items in phrases.rows(numbers):
        low, high = index.ranges(table)
        some = np.flatnonzero(high > low)
        rows = np.concatenate([np.arange(low[p], high[p]) for p in some]) if len(some) else np.zeros(0, np.int64)
        which = np.repeat(some, (high - low)[some])
        first = token[index.locate(rows)]
        hits += zip(doc[first].tolist(), start[first].tolist(), end[first + n - 1].tolist(), items[which].tolist())
    for d, a, b, item in sorted(hits):
        spans = out[d]
        if spans and a <= spans[-1][1]:
            x, y, old = spans[-1]
            old.add(item)
            spans[-1] = (x, max(y, b), old)
        else:
            spans.append((a, b, {item}))
    return [[(a, b, sorted(items)) for a, b, items in spans] for spans in out]


def cut(text: str, spans: list[tuple[int, int, list[int]]]) -> str:
    """text without the spans."""
    kept, at = [], 0
    for a, b, _ in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def merge(spans: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, list[int]]]:
    out: list[tuple[int, int, list[int]]] = []
    for a, b, items in sorted(spans):
        if out and a <= out[-1][1]:
            x, y, old = out[-1]
            out[-1] = (x, max(y, b), sorted({*old, *items}))
        else:
            out.append((a, b, list(items)))
    return out


SPANS = "array<struct<start:int,end:int,items:array<bigint>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("items", pa.list_(pa.int64()))]))


def _parts(benchmark: DataFrame, part_bytes: int, phrase: int) -> Iterator[Phrases]:
    """The items, in parts of so many bytes each or a single item; one part is with the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    for k in range(n):
        yield Phrases([(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()], phrase)


def with_spans(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, shard_chars: int = SHARD_CHARS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: what the benchmark's phrases cover of text (null: nothing), and the text without it. No shuffle."""
    spans, left = free(docs, "spans", "cut")
    out = docs.select(*quoted(*docs.columns), F.lit(None).cast(SPANS).alias(spans), F.lit(None).cast("string").alias(left))
    for phrases in _parts(benchmark, part_bytes, phrase):
        handle = docs.sparkSession.sparkContext.broadcast(phrases)
        out = map_batches(out, _search(handle, docs.columns.index("text"), shard_chars), out.schema)
    return out, spans, left


def _search(handle, column: int, shard_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = handle.value
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            for piece in _pieces(batch, column, shard_chars):
                n = piece.column(column).nbytes
                if held and chars + n > shard_chars:
                    yield from _flush(held, column, phrases)
                    held, chars = [], 0
                held.append(piece)
                chars += n
        if held:
            yield from _flush(held, column, phrases)

    return run


def _pieces(batch: pa.RecordBatch, column: int, shard_chars: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(batch.num_rows * shard_chars / max(1, batch.column(column).nbytes)))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _flush(held: list[pa.RecordBatch], column: int, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    texts = [t for b in held for t in b.column(column).to_pylist()]
    found, at = find(texts, phrases), 0
    for b in held:
        here = slice(at, at + b.num_rows)
        at += b.num_rows
        before = b.column(b.num_columns - 2)
        spans = found[here]
        if before.null_count < b.num_rows:
            spans = [merge([(s["start"], s["end"], s["items"]) for s in old or []] + new) if old else new for old, new in zip(before.to_pylist(), spans)]
        rows = pa.array([[{"start": x, "end": y, "items": i} for x, y, i in s] or None for s in spans], _SPANS)
        left = pa.array([cut(t, s) if s else None for t, s in zip(texts[here], spans)], pa.string())
        yield pa.record_batch([*b.columns[:-2], rows, left], names=b.schema.names)


def contaminated(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """doc_id, items, spans and text (what is left) of each row of docs that holds a phrase of the benchmark.

    A phrase is a run of `phrase` words of an item, or a whole item of fewer words, MIN_WORDS at least; case and what
    stands between words don't count. Overlapping and touching spans are one. Null and empty texts and items
    match nothing, nor do items with a null item_id; equal items are all named. Very long texts are a shard of their own. Repeated rows each give a row. Other columns, whatever
    their names, are ignored. An empty table, of documents or of items, gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, spans, left = with_spans(docs, benchmark, phrase)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: s["items"]))))
    return out.where(F.col(spans).isNotNull()).select("doc_id", items.alias("items"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"), F.col(left).alias("text"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """docs, all columns, with the benchmark's phrases cut from text and n_chars (if there is such a column) set anew; rows of which no word is left go. See contaminated().

    Rows without a phrase are as they were, null and empty texts too. Other columns may have any names. An empty table gives an empty one.
    """
    out, spans, left = with_spans(docs, benchmark, phrase)
    out = out.where(F.col(spans).isNull() | F.col(left).rlike(r"[\p{L}\p{N}]"))
    changed = F.col(spans).isNotNull()
    new = {"text": F.when(changed, F.col(left)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else quoted(c)[0] for c in docs.columns])
