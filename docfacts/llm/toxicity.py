"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence marks of words, their stems (first ``STEMS`` bytes), word pairs and pairs with one word
left out, hashed to ``2 ** BITS`` places. The learner keeps two sums for each place, ``z`` and ``n``; its step is
``ALPHA / (BETA + sqrt(n))`` there, and the weight is zero until ``|z|`` exceeds ``L1``. Hence few weights
differ from zero: they are broadcast as a short list, at most ``2 ** BITS`` of them.

Learning uses at most ``TRAIN_ROWS`` labelled ids (those with the smallest hash) and one text of each, as many as have ``TRAIN_BYTES`` of
features, in the order in which they are learnt. They may be dealt
over ``SHARDS`` tasks whose weights are averaged; one learns best and holds the bounded rows. Scoring covers every document and its whole text in one
pass without a shuffle.

Defined cases: a null or empty text has the constant feature alone; without labels every score is that of
``NO_LABELS``; several labels of one id count as toxic if one of them is; null labels are left out; a null id counts as
the empty text for the held-out rule; repeated rows get equal scores; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docfacts.llm.common import SLICE_BYTES, joined_bytes, lower_ascii, mix, rolling, slices, thrifty, words_of, written

BITS = 20
#: Bounds of the sample that is learnt from: ids, and bytes of their features (4 for each), which one task holds.
TRAIN_ROWS, TRAIN_BYTES = 16_000, 256 << 20
SHARDS, EPOCHS = 1, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
#: The constant's weight where nothing could be learned: a score of about 0.007.
NO_LABELS = -5.0
FOLDS = 5
#: The score's column beside all columns of a table.
SCORE = "__toxicity_score"
STEMS = (4, 5)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEEDS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of every feature of joined texts, repeats included."""
    data, offsets = joined_bytes(texts)
    starts, ends, first = words_of(data, offsets, ~_LETTER)
    powers = rolling()
    sums = powers.sums(lower_ascii(data))
    word = mix(powers.ranges(sums, starts, ends))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out_text, out_place = [text], [word * _SEEDS[0]]
    for bytes_kept in STEMS:
        long = ends - starts > bytes_kept
        out_text.append(text[long])
        out_place.append(mix(powers.ranges(sums, starts[long], starts[long] + bytes_kept) ^ _SEEDS[bytes_kept % 3]))
    for apart in (1, 2):
        same = text[:-apart] == text[apart:] if len(text) > apart else np.zeros(0, bool)
        left, right = word[: len(same)][same], word[len(word) - len(same) :][same]
        out_text.append(text[: len(same)][same])
        out_place.append(mix(left * _SEEDS[apart] + right))
    place = np.concatenate(out_place) >> np.uint64(64 - BITS)
    return np.concatenate(out_text), place.astype(np.int64)


class Ftrl:
    """Follow the regularised leader, one document at a time."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places: np.ndarray, label: int) -> None:
        weights = self.weights(places)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
        n = self.n[places]
        self.z[places] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * weights
        self.n[places] = n + gradient * gradient


CONSTANT = 1 << BITS


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of the labelled ids to learn from, with their texts. The chosen ids are at most ``rows``, so they are broadcast."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The places and weights that differ from zero."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 2):
            text, place = features(batch.column("text"))
            keys = np.unique(text << BITS | place)
            cut = np.searchsorted(keys, np.arange(batch.num_rows + 1) << BITS)
            packed = [(keys[a:b] & (CONSTANT - 1)).astype("<i4").tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(packed, pa.binary())], ["doc_id", "toxic", "places"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, held = Ftrl(), [], 0
        for batch in batches:
            for label, places in zip(batch.column("toxic").to_pylist(), batch.column("places")):
                held += len(places.as_buffer())
                if held <= train_bytes:
                    seen.append((np.append(np.frombuffer(places.as_buffer(), "<i4"), np.int32(CONSTANT)), label))
        for _ in range(EPOCHS):
            for places, label in seen:
                model.learn(places, label)
        used = np.flatnonzero(np.abs(model.z) > L1)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(model.weights(used))], ["place", "weight"])

    marked = training_rows(documents, labels, rows).mapInArrow(thrifty(extract), "doc_id long, toxic int, places binary")
    # One text for each id, whatever the number of its rows; one that has features before one that has none.
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("places").alias("places"))
    marked = marked.withColumns({"order": F.xxhash64("doc_id", F.lit(7)), "shard": F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(SHARDS))})
    dealt = marked.repartition(SHARDS, "shard").sortWithinPartitions("order").select("toxic", "places")
    learned = written(dealt.mapInArrow(thrifty(train), "place long, weight double"), "toxicity")
    shards = F.lit(float(SHARDS))
    summed = learned.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).orderBy("place").toPandas()
    if summed.empty:
        return np.array([CONSTANT]), np.array([NO_LABELS])
    return summed["place"].to_numpy(), summed["weight"].to_numpy()


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of every document: columns ``doc_id, held_out, score, predicted``."""
    scored = with_scores(documents.select("doc_id", "text"), documents, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def with_scores(rows: DataFrame, documents: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """``rows`` with a ``score``; the texts go along only with ``keep``."""
    model = rows.sparkSession.sparkContext.broadcast(learn(documents, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = model.value
        dense = np.zeros(CONSTANT + 1)
        dense[places] = values
        used = dense != 0
        for batch in slices(batches, "text", SLICE_BYTES // 2):
            text, place = features(batch.column("text"))
            hit = used[place]
            keys = np.unique(text[hit] << BITS | place[hit])
            total = np.bincount(keys >> BITS, weights=dense[keys & (CONSTANT - 1)], minlength=batch.num_rows) + dense[CONSTANT]
            result = pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))), pa.float64())
            names = [n for n in batch.schema.names if keep or n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), result], [*names, SCORE if keep else "score"])

    fields = [f for f in rows.schema.fields if keep or f.name != "text"]
    return rows.mapInArrow(thrifty(score), StructType([*fields, StructField(SCORE if keep else "score", DoubleType())]))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept."""
    return with_scores(documents, documents, labels, keep=True).where(f"{SCORE} < 0.5").select(*documents.columns)
