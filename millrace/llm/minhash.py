"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, chunks, free, map_arrow, mix, numbered, quoted, shingles, small, stored, text_key
from .grouping import bands, group_keys

#: Words of a shingle; components of a signature; least Jaccard similarity.
WIDTH, SIZE, THRESHOLD = 3, 200, 0.5
#: Pairs at the threshold that bands must find, at least; standard deviations of the estimate below it from which on a pair isn't verified.
SHARED, DEVIATIONS = 0.95, 4.0
_STEP = 0x9E3779B97F4A7C15


def super_minhash(doc: np.ndarray, element: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """Signatures (docs x size) of sets, given as (doc, element hash) rows sorted by doc.

    In step j every element draws r in [0, 1) and the next entry of its own random permutation of the
    components, and offers j + r to that component, which keeps the least offer. A document stops
    when all its components are below the next step's offers. Without elements all is inf.
    """
    h = np.full(docs * size, np.inf)
    live, perm = element, None
    owner = doc.astype(np.int64)
    for j in range(size):
        if not len(live):
            break
        draw = mix(live + np.uint64(_STEP * (2 * j + 1) % 2**64))
        offer = j + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = (j + mix(live + np.uint64(_STEP * (2 * j + 2) % 2**64)) % np.uint64(size - j)).astype(np.int64)
        if j == 0:
            place, first = k, k
        else:
            at = np.arange(len(live))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
            perm[at, j] = place
        np.minimum.at(h, owner * size + place, offer)
        open_docs = h.reshape(docs, size).max(axis=1) >= j + 1
        keep = open_docs[owner]
        if j == 0:
            live, owner, first = live[keep], owner[keep], first[keep]
            if len(live):
                perm = np.tile(np.arange(size, dtype=np.uint16 if size > 256 else np.uint8), (len(live), 1))
                at = np.arange(len(live))
                perm[at, first] = 0
                perm[at, 0] = first
        elif not keep.all():
            live, owner, perm = live[keep], owner[keep], perm[keep]
    return h.reshape(docs, size)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return shingles(Tokens(texts), WIDTH)


def band_rows(threshold: float, size: int = SIZE) -> int:
    """Components of a band: as many as still let pairs at the threshold share a band with probability SHARED (one, if none do)."""
    return max([r for r in range(1, size + 1) if 1 - (1 - threshold**r) ** (size // r) >= SHARED], default=1)


def estimate_floor(threshold: float, size: int = SIZE) -> float:
    """The estimate that a pair at the threshold falls short of by no more than chance in some 30,000 (a signature's components being at worst independent)."""
    return max(0.0, threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / size))


def _sketch(batch: pa.RecordBatch, rows: int):
    texts = batch.column(1).to_pylist()
    for first, run in chunks(texts):
        doc, element = shingle_sets(run)
        signature = super_minhash(doc, element, len(run))
        some = np.isfinite(signature[:, 0])
        whole = mix(signature.view(np.uint64).reshape(signature.shape))
        band = bands(whole, rows)
        short = (whole & np.uint64(0xFFFF)).astype(np.uint16)
        keep = np.flatnonzero(some)
        offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * band.shape[1])
        yield pa.record_batch(
            [
                batch.column(0).slice(first, len(run)).take(pa.array(keep)),
                pa.ListArray.from_arrays(offsets, pa.array(band[keep].astype(np.int64).ravel())),
                pa.array([short[i].tobytes() for i in keep], pa.binary()),
            ],
            names=["key", "bands", "sketch"],
        )


def _content(batch: pa.RecordBatch):
    texts = batch.column(1).to_pylist()
    for first, run in chunks(texts):
        doc, element = shingle_sets(run)
        cuts = np.searchsorted(doc, np.arange(len(run) + 1))
        sets = [np.unique(element[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.record_batch([batch.column(0).slice(first, len(run)), pa.array(sets, pa.binary())], names=["key", "content"])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components of rows of signatures."""
    return (a == b).mean(axis=1)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _roots(docs: DataFrame, threshold: float) -> DataFrame:
    """key, root (a number) of the texts that resemble another text."""
    rows = band_rows(threshold)
    texts = docs.where("text IS NOT NULL").select(text_key().alias("key"), "text")
    known = numbered(map_arrow(texts, lambda batch: _sketch(batch, rows), "key binary, bands array<bigint>, sketch binary").dropDuplicates(["key"]))
    sketches = known.select(F.col("number").alias("key"), "bands", "sketch")

    def content(numbers: DataFrame) -> DataFrame:
        asked = stored(known.select("key", "number").join(small(numbers.withColumnRenamed("key", "number")), "number"))
        some = texts.join(small(asked), "key").select("number", "text").dropDuplicates(["number"])
        return map_arrow(some, _content, "key bigint, content binary")

    roots = group_keys(sketches, content, np.uint16, SIZE, estimate, estimate_floor(threshold), jaccard, lambda score: score >= threshold)
    return known.select("key", "number").join(roots.withColumnRenamed("key", "number"), "number").select("key", "root")


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, key, root, n: the distinct pairs of doc_id and text with the text's group; n rows are such."""
    ids = stored(docs.where("text IS NOT NULL").select("doc_id", text_key().alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n")))
    # Texts that resemble no other are groups of their own.
    own = F.struct(F.col("root"), F.when(F.col("root").isNull(), F.col("key")).alias("key"))
    return ids.join(_roots(docs, threshold), "key", "left").select("doc_id", "key", own.alias("root"), "n")


def _members(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, key, n, group_id, keep of the distinct pairs of doc_id and text that are in a group."""
    pair = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(_grouped(pair, threshold))
    groups = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("kept"), F.sum("n").alias("size")).where("size > 1")
    keep = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key"))
    return rows.join(groups, "root").select("doc_id", "key", "n", F.col("kept.doc_id").alias("group_id"), keep.alias("keep"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id, keep for each distinct document of a group of two or more rows; group_id is the group's smallest doc_id.

    Texts are alike from the threshold of Jaccard similarity of their sets of three-word shingles on (case and
    punctuation don't count), and groups are the connected components. Of pairs at the threshold itself, bands find at least SHARED (so
    many of those that no third text joins), of more similar ones more. Equal texts, those without words (empty ones) among them,
    are always one group; null texts are in none. Very long texts count whole. Rows equal in doc_id and text give one row. keep marks the smallest
    doc_id (null comes last), and of several texts with it, the one with the least MD5. group_id is null where all doc_ids are. Other columns, whatever
    their names, are ignored. An empty table gives an empty one.
    """
    return _members(docs, threshold).select("doc_id", "group_id", "keep")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each group of near_duplicates(): the one that is kept, of repeated rows any one.

    Rows with null text stay. Other columns may have any names. An empty table gives an empty one.
    """
    by_id, by_key, row_key, n, keep = free(docs, "id", "key", "text_key", "n", "keep")
    action = stored(_members(docs, threshold).where("n > 1 OR NOT keep").select(F.col("doc_id").alias(by_id), F.col("key").alias(by_key), F.col("keep").alias(keep), F.col("n").alias(n)))
    names = quoted(*docs.columns)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(by_id)) & (F.col(row_key) == F.col(by_key))
    marked = docs.withColumn(row_key, text_key(F.col("text").cast("string"))).join(small(action), same, "left")
    out = marked.where(F.col(keep).isNull()).select(*names)
    if action.where(F.col(keep)).isEmpty():
        return out
    once = marked.where(F.col(keep)).dropDuplicates([by_id, by_key]).select(*names)
    return out.unionByName(once)
