"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing breaks a sequence into phrases with the help of a
few neighbouring symbols only: each symbol is relabelled by the lowest bit in
which it differs from its left neighbour, three times over, which leaves labels
below 8 with no two neighbours alike; local maxima of the labels begin phrases. A
phrase's name is the hash of its symbols, names are parsed again, and so on:
each level's phrases are about three times as long. Equal substrings are cut
alike but for a few symbols at their ends, whatever their offset, so they share
the names of their interior phrases. A fingerprint keeps, for each of ``BINS``
ranges of hashes, eight bits of the smallest name of two levels; the share of equal
bins estimates the share of common phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import partitions, stored, text_key
from skerry.llm.grams import mixed, spans_hash

BINS = 128
#: Levels whose phrases are compared: about 27 and 81 bytes long.
LEVELS = (3, 4)
_LOWEST = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _relabel(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * position of the lowest bit that differs from the left neighbour, plus that bit; x: small numbers."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    bit = _LOWEST[x ^ left]
    return 2 * bit + (x >> bit & 1)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8, no two neighbours of one text alike; names of neighbours differ. first: where texts begin."""
    if names.dtype == np.uint8:
        x = names
    else:
        left = np.empty_like(names)
        left[1:] = names[:-1]
        left[first] = ~names[first]
        differ = names ^ left
        low = differ & (~differ + np.uint64(1))
        bit = (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint64)
        x = (2 * bit + (names >> bit & np.uint64(1))).astype(np.uint8)
    for _ in range(2 + (names.dtype == np.uint8)):
        x = _relabel(x, first)
    return x


def parse_level(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level of each text, and their offsets. Runs of one symbol become one symbol first."""
    if not len(names):
        return np.zeros(0, np.uint64), offsets
    is_first = np.zeros(len(names), bool)
    is_first[offsets[:-1][np.diff(offsets) > 0]] = True
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | is_first[1:]
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(names)))
    x, first = names[begin], np.flatnonzero(is_first[begin])
    label = _labels(x, first).astype(np.int16)
    label = label + 0
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[first] = -1
    right[np.append(first[1:], len(x)) - 1] = 99  # a last symbol alone begins no phrase
    start = (label > left) & (label > right)
    start[first] = True
    phrase = np.flatnonzero(start)
    symbols = x.astype(np.uint64)
    several = runs > 1
    symbols[several] = mixed(symbols[several] ^ (runs[several].astype(np.uint64) << np.uint64(32)) ^ np.uint64(0x5851F42D4C957F2D))
    named = spans_hash(symbols + np.uint64(0x9E3779B97F4A7C15), phrase, np.append(phrase[1:], len(x)))
    at = np.searchsorted(begin[phrase], offsets)
    return named, at


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """len(texts) x BINS bytes: 0 for an empty bin, else 1 to 255."""
    names = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    low = np.full((len(texts), BINS), np.iinfo(np.uint64).max, np.uint64)
    for level in range(1, max(LEVELS) + 1):
        names, offsets = parse_level(names, offsets)
        if level in LEVELS and len(names):
            salted = mixed(names ^ np.uint64(level))
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            np.minimum.at(low, (doc, (salted >> np.uint64(57)).astype(np.int64)), salted & np.uint64((1 << 57) - 1))
    return np.where(low == np.iinfo(np.uint64).max, 0, 1 + low % np.uint64(255)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common phrases of each pair of fingerprints, 0 to 1; two without phrases are alike."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    chance = 1 / 255
    raw = (same / np.maximum(used, 1) - chance) / (1 - chance)
    return np.where(used == 0, 1.0, np.where(same == used, 1.0, np.clip(raw, 0, 1)))


def fingerprint_of(text: Column) -> Column:
    """Fingerprint of a text column in hex; null counts as empty."""
    from pyspark.sql.pandas.functions import arrow_udf

    from skerry.llm.common import chunks

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for _, texts in chunks([pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])], "text"):
                out += [x.tobytes().hex() for x in fingerprints(texts)]
            yield pa.array(out, pa.string())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "string")(text)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the beginning of the next document.

    The next document has the next smaller doc_id; the smallest is followed by the
    largest. Null doc_ids come last; rows of one doc_id follow each other by a
    hash of their text. Null texts count as empty. A single document follows
    itself. Texts are dealt out by ranges of doc_id, an identifier that holds many
    rows by ranges of that hash as well, and each range also gets the first
    document of the range after it: nothing is gathered in one place.
    """
    from pyspark.sql.pandas.functions import arrow_udf

    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(named.alias("doc_id"), text.alias("text"), F.coalesce(named, F.lit(-(2**63))).alias("key"), text_key(text).alias("mark"))
    ranges = 4 * partitions(spark)
    cuts = rows.agg(F.approx_percentile("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    cuts = np.array(cuts or [], np.int64)  # an identifier with many rows stands there several times

    def place(key: pa.Array, mark: pa.Array) -> pa.Array:
        key, mark = (x.to_numpy(zero_copy_only=False) for x in (key, mark))
        low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
        share = (mark.astype(np.float64) + 2.0**63) / 2.0**64  # rises with the mark
        return pa.array(len(cuts) - (high - np.minimum((share * (high - low + 1)).astype(np.int64), high - low)))

    place.__annotations__ = {"key": pa.Array, "mark": pa.Array, "return": pa.Array}
    part = arrow_udf(place, "long")
    placed = rows.withColumn("part", part("key", "mark"))
    first = F.min(F.struct(F.bitwise_not("key").alias("down"), "mark")).alias("head")  # ~ turns the order of numbers round
    heads = stored(placed.select("key", "mark", "part").groupBy("part").agg(first), "heads")
    order = sorted(r["part"] for r in heads.select("part").collect())  # a row for each range
    before = spark.createDataFrame([(p, order[i - 1]) for i, p in enumerate(order)], "part long, to long")
    wanted = heads.join(F.broadcast(before), "part").select("to", F.bitwise_not("head.down").alias("key"), F.col("head.mark").alias("mark"))
    extra = rows.join(F.broadcast(wanted), ["key", "mark"]).dropDuplicates(["to"]).select("doc_id", "text", "key", "mark", F.col("to").alias("part"), F.lit(1).alias("extra"))
    dealt = placed.withColumn("extra", F.lit(0)).unionByName(extra)
    dealt = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "extra", F.col("doc_id").isNull(), F.desc("key"), "mark").select("doc_id", "text", "part", "extra")
    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[dict]) -> pa.RecordBatch | None:
            """Rows that stand together; the last is only there to follow."""
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a["extra"] and a["part"] == b["part"]]
            if not pairs:
                return None
            own = fingerprints([r["text"].encode() for r in rows])
            index = {id(r): i for i, r in enumerate(rows)}
            changed, lengths = [], []
            for a, b in pairs:
                n = len(a["text"])
                add = b["text"][: n // 2]
                lengths.append(n)
                changed.append((a["text"][: n - n // 2] + add).encode())
            new = fingerprints(changed)
            mine, others = own[[index[id(a)] for a, _ in pairs]], own[[index[id(b)] for _, b in pairs]]
            columns = ([a["doc_id"] for a, _ in pairs], lengths, [hashlib.sha256(x).hexdigest() for x in changed], [x.tobytes().hex() for x in mine], [x.tobytes().hex() for x in new], likeness(mine, new), likeness(mine, others))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["text"])
                if size > 1_500_000 and len(held) > 1:
                    if (out := of(held)) is not None:
                        yield out
                    held, size = held[-1:], len(row["text"])
        if (out := of(held)) is not None:
            yield out

    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
