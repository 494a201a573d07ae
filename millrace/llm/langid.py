"""Language by compression: the dictionary that shortens a text most names its language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches

#: Bounds of the fit: labelled documents of a language, and bytes of dictionary.
SAMPLE_DOCUMENTS = 256
DICTIONARY_BYTES = 65_536
OVERSAMPLE = 2
#: Texts are compressed in blocks of so many bytes, lest a long text become its own dictionary.
BLOCK_BYTES = 4_096
#: The runner-up must be longer by this share; frames' headers don't count.
MARGIN = 0.005
#: Short matches tell languages apart.
CODER = {"window_log": 17, "chain_log": 17, "hash_log": 16, "search_log": 4, "min_match": 3, "target_length": 32, "strategy": zstandard.STRATEGY_BTLAZY2}
_NOT_LETTERS = re.compile(r"[\W\d_]+")
SCHEMA = "doc_id bigint, language string, margin double, accepted boolean"


def fit(docs: DataFrame, languages: list[str] | None = None, sample: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw dictionary by language, from the sample distinct texts of each label in lang whose hash is smallest.

    Each gives a window of the same length, at a place of the whole text that a hash chooses, so that neither one long text nor what many
    texts begin with fills the dictionary. Rows without label or text are passed over; repeated texts count once. An empty table gives no dictionary.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND length(trim(text)) > 0")
    counts = {r[0]: max(1, r[1]) for r in docs.groupBy("lang").agg(F.approx_count_distinct("text")).collect() if languages is None or r[0] in languages}
    # Hashes below a bound that some OVERSAMPLE times the sample passes: what comes to the driver doesn't grow with the table.
    passes, share = F.lit(False), F.lit(0)
    for lang, n in counts.items():
        here = F.col("lang") == lang
        passes = passes | here & (F.col("h") <= int(min(1.0, OVERSAMPLE * sample / n) * 2**53))
        share = F.when(here, max(1, size // min(sample, n))).otherwise(share)
    room = F.greatest(F.length("text") - share, F.lit(0)) + 1
    window = F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(1), "text"), room) + 1).cast("int"), share)
    picked = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 11)).where(passes).select("lang", "h", window.alias("window")).distinct().collect()
    model = {}
    for lang in sorted(counts):
        rows = sorted((r.h, r.window) for r in picked if r.lang == lang)[:sample]
        if data := b" ".join(_NOT_LETTERS.sub(" ", t.lower()).encode("utf-8", "replace") for _, t in rows)[:size]:
            model[lang] = data
    return model


class Classifier:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, model: dict[str, bytes]):
        self.languages = sorted(model)
        self.coders = [self._coder(model[x], CODER) for x in self.languages]

    @staticmethod
    def _coder(raw: bytes, settings: dict) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **settings)
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    @staticmethod
    def blocks(text: str) -> list[bytes]:
        data = _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")
        return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]

    @staticmethod
    def _best(coders: list, blocks: list[bytes]) -> tuple[int, float]:
        """Index of the smallest size and by how much it is smaller than the next; 0 for a tie."""
        header = 3 * len(blocks)
        size = [sum(len(c.compress(b)) for b in blocks) - header for c in coders]
        order = np.argsort(size, kind="stable")
        best, second = size[order[0]], size[order[1]] if len(order) > 1 else 2 * size[order[0]] + 1
        return int(order[0]), 1.0 - best / second if second > 0 else 0.0

    def classify(self, text: str | None, margin: float = MARGIN) -> tuple[str | None, float | None, bool]:
        blocks = self.blocks(text or "")
        if not blocks or not self.languages:
            return None, None, False
        best, gap = self._best(self.coders, blocks)
        sure = gap > 0 and gap >= margin
        return self.languages[best] if sure else None, gap, sure


def classify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, language, margin and accepted for each row of docs.

    A text is lower-cased, runs of anything but letters become blanks, and the whole of it, however long, is compressed in blocks.
    language is null and accepted false for null texts, empty ones and those without letters (margin null then), for ties and for narrow margins, which a few
    words have more often than a long text. Repeated rows get equal results; other columns, whatever their names, are ignored. An empty table gives an empty one, a model without dictionaries accepts nothing.
    """
    return _run(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), model, margin)


def accepted(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs, all columns, whose language is accepted; see classify(). So rows with null or empty text go.

    Repeated rows stay or go together. Other columns may have any names. An empty table gives an empty one.
    """
    fields, names = docs.schema, docs.columns

    def run(batches):
        coder = Classifier(model)
        for batch in batches:
            keep = [coder.classify(t, margin)[2] for t in batch.column(names.index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, fields)


def _run(docs: DataFrame, model: dict[str, bytes], margin: float) -> DataFrame:
    coders: list[Classifier] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not coders:
            coders.append(Classifier(model))
        found = [coders[0].classify(t, margin) for t in batch.column(1).to_pylist()]
        return pa.record_batch(
            [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
            names=["doc_id", "language", "margin", "accepted"],
        )

    return map_arrow(docs, run, SCHEMA)
