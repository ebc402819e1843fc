"""Language identification by multilingual mixture inference.

A text is a mixture of languages. Its character trigrams are scored under each
language's trigram model, summed over short segments of consecutive trigrams,
and expectation-maximisation estimates the languages' proportions from the
segments' likelihoods. The set of languages is the one whose likelihood, less
a penalty for each further language, is highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import chunks, packed

#: Cells of the hashed trigram tables.
CELLS = 1 << 16
#: Trigrams that are looked up at once.
STEP = 200_000


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # CELLS x languages: log likelihood of a trigram


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with white space, digits and ASCII punctuation folded to a space, and a space at each end."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, np.where((x >= 97) & (x <= 122), x, 32), x).astype(np.uint32)


def trigrams(x: np.ndarray) -> np.ndarray:
    """Cell of each three consecutive code points."""
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h = h ^ (h >> np.uint32(15))
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)


def cells_of(x: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """trigrams(x), step of them at a time."""
    for a in range(0, max(len(x) - 2, 0), step):
        yield trigrams(x[a : a + step + 2])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", learn: Column | None = None, per_language: int = 400, seed: int = 5, most_languages: int = 1000) -> Model:
    """Fit trigram models on about ``per_language`` whole texts of each language (a documented bound), drawn by a seeded hash.

    The model is a table of CELLS x languages that every task holds: a column
    with more than ``most_languages`` values is not one of languages and is an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows if learn is None else rows.where(learn)
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    sample = rows.where(draw < rate[F.col(lang_col)])
    order = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(order), CELLS), np.int64)
        for batch, texts in chunks(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                for cells in cells_of(code_points(text.decode("utf-8", "replace")), STEP):
                    sums[order[lang]] += np.bincount(cells, minlength=CELLS)
        at, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cell), pa.array(sums[at, cell])], names=["lang", "cell", "n"])

    sums = np.zeros((CELLS, len(languages)))
    found = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang int, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    sums[found["cell"], found["lang"]] = found["n"]
    smooth = (sums + 0.1) / (sums.sum(0) + 0.1 * CELLS)
    return Model(languages, np.log(smooth).astype(np.float32))


def proportions(like: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once. like: segments x languages, log; doc: text of each segment, sorted; allowed: texts x languages.

    Returns each text's proportions and log likelihood.
    """
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    top = like.max(1, keepdims=True)
    weight = np.exp(like - top)
    for _ in range(rounds):
        joint = share[doc] * weight
        total = joint.sum(1, keepdims=True)
        new = np.zeros_like(share)
        np.add.at(new, doc, joint / np.maximum(total, 1e-300))
        share = new / np.maximum(new.sum(1, keepdims=True), 1e-300)
    total = np.maximum((share[doc] * weight).sum(1), 1e-300)
    return share, np.bincount(doc, np.log(total) + top[:, 0], minlength=n)


def infer(texts: list[str], model: Model, segment: int = 24, penalty: float = 6.0) -> list[tuple[str, float, dict[str, float]]]:
    """For each text: the leading language, its proportion, and all proportions. ``und`` without letters or languages."""
    import regex

    letter = regex.compile(r"\p{L}")
    has = [bool(model.languages) and bool(letter.search(t)) for t in texts]
    if not any(has):
        return [("und", 0.0, {}) for _ in texts]
    seg_like, seg_doc = [], []
    live = [t for t, h in zip(texts, has) if h]
    for i, t in enumerate(live):
        for cells in cells_of(code_points(t), STEP // segment * segment):  # scores of a long text's trigrams are summed a stretch at a time
            starts = np.arange(0, len(cells), segment)
            seg_like.append(np.add.reduceat(model.table[cells], starts, axis=0, dtype=np.float64))
            seg_doc.append(np.full(len(starts), i))
    like, doc = np.concatenate(seg_like), np.concatenate(seg_doc)
    n, k = len(live), len(model.languages)
    share, full = proportions(like, doc, n, np.ones((n, k)))
    order = np.argsort(-share, axis=1, kind="stable")
    size = np.bincount(doc, minlength=n)
    best, best_score = np.zeros((n, k)), np.full(n, -np.inf)
    for m in range(1, k + 1):  # all nested sets of the leading languages, so that no text's answer hangs on its neighbours
        allowed = np.zeros((n, k))
        np.put_along_axis(allowed, order[:, :m], 1, axis=1)
        some, loglike = proportions(like, doc, n, allowed) if m < k else (share, full)
        score = loglike - penalty * m * np.log(size + 1)
        better = score > best_score
        best[better], best_score[better] = some[better], score[better]
    lead = best.argmax(1)
    answers = iter([(model.languages[j], float(min(1.0, row[j])), {model.languages[i]: float(row[i]) for i in np.flatnonzero(row > 1e-6)}) for j, row in zip(lead, best)])
    return [next(answers) if h else ("und", 0.0, {}) for h in has]


def identify(docs: DataFrame, model: Model, text_col: str = "text", **how) -> DataFrame:
    """docs with lang_pred, score (share of that language) and languages (map of shares).

    Null texts and texts without a letter are ``und`` with score 0. Whole texts
    are scored, whatever their length. Rows are handled one by one, so repeated
    rows and clashing extra columns pass through unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x most_languages at the most

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])
        for column in batches:
            out = []
            for _, texts in chunks([pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])], "text"):
                out += infer([t.decode("utf-8", "replace") for t in texts], shared.value, **how)
            yield pa.array([{"lang_pred": a, "score": b, "languages": list(c.items())} for a, b, c in out], kind)

    from pyspark.sql.pandas.functions import arrow_udf

    found = arrow_udf(_typed(score), "struct<lang_pred:string,score:double,languages:map<string,double>>")
    new = ("lang_pred", "score", "languages")
    return packed(docs, found=found(F.col(f"`{text_col}`"))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in new], "found.*")


def _typed(score):
    def run(batches):
        yield from score(batches)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
