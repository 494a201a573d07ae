"""Quality by importance resampling: hashed n-gram models of good and of all text weigh documents, a Gumbel top-k samples them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, bounded_sample, chunks, map_batches, mix, stored

#: Buckets of the hashed words, word pairs and signs; added to each count.
BUCKETS, SMOOTHING = 10_000, 1.0
#: Bound of the fit: labelled good documents of which the target model is made.
TARGET_DOCUMENTS = 20_000
SEED = 17
#: Cells of a pass that looks for the k-th key, and rows of a cell that may be sorted.
CELLS, SORTED_ROWS = 4_096, 100_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, bucket) of every word as it is written, every pair of neighbouring words and every sign with the one after it, if there is one."""
    t = Tokens(texts, fold=False)
    if not len(t.cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    together = t.doc[:-1] == t.doc[1:]
    pair = mix(t.hash[:-1] * np.uint64(0x100000001B3) + t.hash[1:])[together]
    sign = np.flatnonzero((t.inside == 0) & (t.cp > 32) & (t.cp != 0xA0))
    after = np.append(np.where((t.inside[1:] != 0) | (t.cp[1:] <= 32), 0, t.cp[1:]), 0)[sign]
    marks = mix(t.cp[sign].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64))
    doc = np.concatenate((t.doc, t.doc[:-1][together], np.searchsorted(t.offset, sign, side="right") - 1))
    return doc, (np.concatenate((t.hash, pair, marks)) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of all texts of docs (text, target), and of those that are target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = np.array(batch.column(1).to_pylist(), bool)
            for first, part in chunks(batch.column(0).to_pylist()):
                doc, bucket = features(part)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[target[first + doc]], minlength=BUCKETS)
        yield pa.record_batch([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "n", "good"])

    rows = map_batches(docs, run, "bucket int, n bigint, good bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        out[:, r.bucket] = r.n, r.good
    return out[0], out[1]


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id, sound, good for each labelled document: sound if no label says bad, good if none says toxic either. Null labels say nothing."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.coalesce(F.min("quality"), F.lit(0)) == 1).alias("q"), (F.coalesce(F.max("toxic"), F.lit(0)) == 0).alias("t")).select("doc_id", F.col("q").alias("sound"), (F.col("q") & F.col("t")).alias("good"))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target and raw model by bucket. The raw model counts all documents, the target model a bounded number of good ones."""
    good = bounded_sample(clean_labels(labels).where("good").select("doc_id"), TARGET_DOCUMENTS, "doc_id")
    marked = docs.where("text IS NOT NULL").join(F.broadcast(good.select("doc_id", F.lit(True).alias("__good"))), "doc_id", "left").select("text", F.coalesce("__good", F.lit(False)).alias("target"))
    raw, target = _counts(marked)
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))


def weighted(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, noise_key, log_weight of each row of docs; log_weight is null for null texts and those with nothing but white space."""
    table = ratio.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, part in chunks(batch.column(2).to_pylist()):
                doc, bucket = features(part)
                n = np.bincount(doc, minlength=len(part))
                parts.append(np.where(n > 0, np.bincount(doc, table[bucket], minlength=len(part)), np.nan))
            w = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(w, mask=np.isnan(w))], names=["doc_id", "noise_key", "log_weight"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("noise_key"), F.col("text").cast("string").alias("text"))
    return map_batches(keyed, run, "doc_id bigint, noise_key bigint, log_weight double")


def gumbel(noise: str) -> Column:
    """Standard Gumbel noise of a 64-bit hash."""
    u = (F.shiftrightunsigned(F.col(noise), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return -F.ln(-F.ln(u))


def top_k(df: DataFrame, k: int, key: str, *ties: str) -> DataFrame:
    """The k rows of df, a stored table, with the greatest key (ties: the smallest other columns). No sort of more than a narrow cell."""
    if k <= 0:
        return df.limit(0)
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return df
    above, rest = F.lit(False), k
    within = F.lit(True)
    while n > SORTED_ROWS and high > low:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col(key) - low) / width), F.lit(CELLS - 1)).cast("int")
        stats = sorted((r for r in df.where(within).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()), key=lambda r: -r.c)
        for r in stats:
            if r.n >= rest:
                break
            rest -= r.n
        above, within = F.col(key) > r.high, (F.col(key) >= r.low) & (F.col(key) <= r.high)
        if r.n == n and r.low == low and r.high == high:
            break
        low, high, n = r.low, r.high, r.n
    return df.where(above).unionByName(df.where(within).orderBy(F.desc(key), *ties).limit(rest))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key of the rows of docs that are drawn, a share of those with text in proportion to their weights and without replacement.

    share is by default the share of sound documents among the labelled ones (1 without any). A document's weight is the ratio of the
    probabilities of its words, word pairs and signs under the target and the raw model; sample_key adds Gumbel noise, fixed by seed,
    doc_id and text, to its logarithm. Null texts and those with nothing but white space are never drawn. Equal keys go by doc_id (null first);
    rows equal in doc_id and text have equal keys. Other columns are ignored.
    """
    if share is None:
        sound, n = clean_labels(labels).agg(F.count_if("sound"), F.count("*")).first()
        share = sound / n if n else 1.0
    scored = stored(weighted(docs, fit(docs, labels)).where("log_weight IS NOT NULL").withColumn("sample_key", F.col("log_weight") + gumbel("noise_key")))
    k = round(share * scored.count())
    return top_k(scored, k, "sample_key", "doc_id", "noise_key").select("doc_id", "log_weight", "sample_key")
