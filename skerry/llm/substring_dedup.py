"""Substring deduplication by Relative Lempel-Ziv parsing against all documents with smaller identifiers.

The reference is indexed by content-defined blocks: every window of ``window``
words takes the smallest hash among its ``gram``-word sequences as its anchor,
and each maximal run of windows with one anchor is a block, listed under that
anchor. Equal windows have equal anchors wherever they stand, so a document is
matched with the reference blocks under its own anchors only:

1. blocks whose anchor occurs in one document only are literals;
2. a block with the words of a reference block matches as a whole;
3. blocks that share an anchor but differ (a passage's borders, edits) are
   matched window by window.

Each match says where in the reference the words stand, always in the document
with the smallest identifier that holds them. ``parse`` then factors a document
greedily from the left: matches that go on in one place of the reference are one
run, and the run that reaches furthest is the next factor (reference document,
place, length). Runs are at least a window long. At its boundaries a factor is
checked: its words and those of the reference between the same boundaries must
have one digest. Checked factors are the duplicate spans, and their words go.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import chunks, forget, keyed, spread_join, stored
from skerry.llm.grams import ngrams, sliding_min, spans, words

_ROW = [("none", pa.bool_()), ("id", pa.int64()), ("sig", pa.int64())]
_ROW_SQL = "none boolean, id long, sig long"


def blocks_of(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a batch of texts: text, first window (counted from its text), number of windows, anchor."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none.astype(np.uint64)
    low = sliding_min(ngrams(hashes, gram), window - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    inside = np.arange(len(low)) + window <= offsets[text + 1]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new & inside)
    if not len(begin):
        return none, none, none, none.astype(np.uint64)
    text_of = text[begin]
    limit = np.minimum(np.append(np.flatnonzero(new), len(low))[np.searchsorted(np.flatnonzero(new), begin, "right")], offsets[text_of + 1] - window + 1)
    return text_of, begin - offsets[text_of], limit - begin, low[begin]


def parse(matches: list[tuple[int, int, tuple, int]]) -> list[tuple[int, int, tuple, int]]:
    """Greedy parse of matches (begin, end, reference, place there) into factors of the same form.

    Matches that touch or overlap on one diagonal of one reference are one run.
    From the left, the factor at each place is the run that reaches furthest; the
    next one is sought at its end. Factors cover exactly the words that matches cover.
    """
    lines = defaultdict(list)
    for begin, end, ref, at in matches:
        lines[ref, at - begin].append((begin, end))
    runs = []
    for (ref, shift), found in lines.items():
        found.sort()
        begin, end = found[0]
        for b, e in found[1:]:
            if b > end:
                runs.append((begin, end, ref, begin + shift))
                begin = b
            end = max(end, e)
        runs.append((begin, end, ref, begin + shift))
    runs.sort()
    out, i, reach, best = [], 0, -1, None
    while i < len(runs):
        if runs[i][0] > reach:  # a gap, or the start
            reach = runs[i][0]
        best = None
        while i < len(runs) and runs[i][0] <= reach:
            if best is None or runs[i][1] > best[1]:
                best = runs[i]
            i += 1
        if best[1] > reach:
            out.append(best)
            reach = best[1]
    return out


def digest(parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(parts), digest_size=16).digest()


def _cut(window: int, gram: int):
    """Texts in, lists of their blocks out."""
    lists = [("anchors", pa.int64()), ("begins", pa.int32()), ("lengths", pa.int32()), ("firsts", pa.int64()), ("seconds", pa.int64())]
    kind = pa.schema(_ROW + [(c, pa.list_(t)) for c, t in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            lanes, offsets = words(texts)
            text, begin, length, anchor = blocks_of(lanes[0], offsets, window, gram)
            if not len(text):
                continue
            first = offsets[text] + begin
            contents = [spans(lane, first, first + length + window - 1) for lane in lanes]
            have, at = np.unique(text, return_index=True)
            ends = pa.array(np.append(at, len(text)).astype(np.int32))
            values = (anchor.view(np.int64), begin.astype(np.int32), length.astype(np.int32), contents[0].view(np.int64), contents[1].view(np.int64))
            columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in values]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(have)) for i in range(3)] + columns, schema=kind)

    return run, _ROW_SQL + ", anchors array<long>, begins array<int>, lengths array<int>, firsts array<long>, seconds array<long>"


def _windows(window: int):
    """Texts with the blocks asked for in, the 128-bit keys of all windows of those blocks out."""
    kind = pa.schema(_ROW + [("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            lanes, offsets = words(texts)
            every = [ngrams(lane, window) for lane in lanes]
            asked = batch.column(batch.schema.get_field_index("asked"))
            flat, count = asked.flatten(), np.diff(asked.offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            begin, length, anchor = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            ends = np.cumsum(length)
            step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
            at, row = np.repeat(begin, length) + step, np.repeat(row, length)
            keys = [pa.array(x[offsets[row] + at].view(np.int64)) for x in every]
            who = [batch.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*who, pa.array(np.repeat(anchor, length)), *keys, pa.array(at.astype(np.int32))], schema=kind)

    return run, _ROW_SQL + ", anchor long, k1 long, k2 long, at int"


def matches(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Matches of keyed() rows with smaller documents: none, id, sig, begin, end (in words, end exclusive), ref (none, id, sig), place."""
    cut = stored(docs.mapInArrow(*_cut(window, gram)), "blocks")
    zipped = F.explode(F.arrays_zip("anchors", "begins", "lengths", "firsts", "seconds")).alias("b")
    names = {"anchors": "anchor", "begins": "begin", "lengths": "length", "firsts": "c1", "seconds": "c2"}
    runs = cut.select("none", "id", "sig", zipped).select("none", "id", "sig", *[F.col(f"b.{c}").alias(n) for c, n in names.items()])
    who = F.struct("none", "id")
    content = F.struct("c1", "c2")
    per_anchor = runs.groupBy("anchor").agg(F.min(who).alias("low"), F.max(who).alias("high"), (F.min(content) != F.max(content)).alias("differ"), F.count("*").alias("n"))
    shared = stored(per_anchor.where("low < high").select("anchor", "differ", "n"), "anchors")
    here = stored(spread_join(runs, shared, ["anchor"]).drop("n"), "shared")
    variants = here.groupBy("anchor", "c1", "c2").agg(F.min(F.struct("none", "id", "sig", "begin")).alias("first"), F.count("*").alias("n"))
    variants = stored(variants, "variants")
    compared = spread_join(here, variants, ["anchor", "c1", "c2"])
    first = F.struct("first.none", "first.id")
    end = F.col("begin") + F.col("length") + window - 1
    ref = F.struct("first.none", "first.id", "first.sig").alias("ref")
    equal = compared.where(who > first).select("none", "id", "sig", "begin", end.alias("end"), ref, F.col("first.begin").alias("place"))
    # Differing blocks are compared window by window; of equal ones, those of the smallest document.
    wanted = compared.where(F.col("differ") & (who == first)).groupBy("none", "id", "sig").agg(F.collect_list(F.struct("begin", "length", "anchor")).alias("asked"))
    # Texts are always dealt by document, at every size: what is wanted of them grows with the input.
    texts = docs.join(wanted.hint("merge"), ["none", "id", "sig"]).select("none", "id", "sig", "text", "asked").dropDuplicates(["none", "id", "sig"])
    each = stored(texts.mapInArrow(*_windows(window)), "windows")
    lowest = each.groupBy("anchor", "k1", "k2").agg(F.min(F.struct("none", "id", "sig", "at")).alias("first"), F.max(who).alias("high"), F.count("*").alias("n"))
    lowest = stored(lowest.where(F.struct("first.none", "first.id") < F.col("high")).drop("high"), "lowest")
    border = spread_join(each, lowest, ["anchor", "k1", "k2"]).where(who > first)
    border = border.select("none", "id", "sig", F.col("at").alias("begin"), (F.col("at") + window).alias("end"), ref, F.col("first.at").alias("place"))
    found = stored(equal.unionByName(border), "matches")
    forget(cut, shared, here, variants, each, lowest)
    return found


def factors(docs: DataFrame, window: int = 50, gram: int = 25) -> DataFrame:
    """Factors of keyed() rows: none, id, sig, begin, end, ref, place, proof (digest of the reference's words)."""
    found = matches(docs, window, gram)
    by_doc = found.groupBy("none", "id", "sig").agg(F.collect_set(F.struct("begin", "end", "ref", "place")).alias("found"))
    kind = pa.schema(_ROW + [("begin", pa.int32()), ("end", pa.int32()), ("ref", pa.struct(_ROW)), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one document's matches at a time
                got = batch.column(3)[i].as_py()
                out = parse([(m["begin"], m["end"], tuple(m["ref"].values()), m["place"]) for m in got])
                who = [pa.array([batch.column(j)[i].as_py()] * len(out), t) for j, (_, t) in enumerate(_ROW)]
                begin, end, ref, place = zip(*out)
                refs = pa.StructArray.from_arrays([pa.array([r[j] for r in ref], t) for j, (_, t) in enumerate(_ROW)], names=[c for c, _ in _ROW])
                yield pa.RecordBatch.from_arrays([*who, pa.array(begin, pa.int32()), pa.array(end, pa.int32()), refs, pa.array(place, pa.int32())], schema=kind)

    parsed = stored(by_doc.mapInArrow(run, f"{_ROW_SQL}, begin int, end int, ref struct<none:boolean,id:long,sig:long>, place int"), "parsed")
    asked = stored(parsed.groupBy("ref", "place", (F.col("end") - F.col("begin")).alias("length")).agg(F.count("*").alias("n")), "asked")
    by_ref = asked.select("ref.*", "place", "length").groupBy("none", "id", "sig").agg(F.collect_list(F.struct("place", "length")).alias("asked"))
    texts = docs.join(by_ref.hint("merge"), ["none", "id", "sig"]).select("none", "id", "sig", "text", "asked").dropDuplicates(["none", "id", "sig"])
    answer = pa.schema(_ROW + [("place", pa.int32()), ("length", pa.int32()), ("proof", pa.binary())])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            out: list[list] = [[] for _ in answer]
            for i, text in enumerate(texts):
                parts = text.split()
                who = [batch.column(j)[i].as_py() for j in range(3)]
                for a in batch.column(4)[i].as_py():
                    proof = digest(parts[a["place"] : a["place"] + a["length"]])
                    for column, value in zip(out, (*who, a["place"], a["length"], proof)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, answer)], schema=answer)

    proofs = texts.mapInArrow(prove, f"{_ROW_SQL}, place int, length int, proof binary").select(F.struct("none", "id", "sig").alias("ref"), "place", "length", "proof")
    proven = stored(proofs.join(asked, ["ref", "place", "length"]), "proofs")
    out = stored(spread_join(parsed.withColumn("length", F.col("end") - F.col("begin")), proven, ["ref", "place", "length"]).drop("n", "length"), "factors")
    forget(found, parsed, asked, proven)
    return out


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left, words joined by one space), n_words, n_removed, spans, kept_sha256, factors.

    Words covered by a window of ``window`` words that also starts in a document
    with a smaller doc_id go; windows are judged on the input. ``factors`` are the
    parse: begin, end, ref_id, place (all in words). Null and empty texts have no
    words. A null doc_id counts as larger than any other. Rows with equal doc_ids
    never remove from one another; each is returned. Texts shorter than a window
    keep all words. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    entry = F.struct("begin", "end", F.when(~F.col("ref.none"), F.col("ref.id")).alias("ref_id"), "place", "proof")
    found = factors(rows, window, gram).groupBy("none", "id", "sig").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    joined = rows.join(found.hint("merge"), ["none", "id", "sig"], "left").select("none", "id", "text", "found")
    piece = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ref_id", pa.int64()), ("place", pa.int32())])
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept_sha256", pa.string()), ("factors", pa.list_(piece))])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            out: list[list] = [[] for _ in kind]
            for none, doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
                parts = text.split()
                checked = [f for f in found or () if digest(parts[f["begin"] : f["end"]]) == f.pop("proof")]
                merged: list[list[int]] = []
                for f in checked:
                    if merged and f["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], f["end"])
                    else:
                        merged.append([f["begin"], f["end"]])
                n = len(parts)
                for begin, end in reversed(merged):
                    del parts[begin:end]
                left = b" ".join(parts)
                for column, value in zip(out, (None if none else doc_id, left.decode(), n, n - len(parts), merged, hashlib.sha256(left).hexdigest(), checked)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

    fields = "factors array<struct<begin:int,end:int,ref_id:long,place:int>>"
    return joined.mapInArrow(strip, f"doc_id long, text string, n_words long, n_removed long, spans array<array<int>>, kept_sha256 string, {fields}")
