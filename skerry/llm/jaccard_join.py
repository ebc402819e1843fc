"""Exact n-gram Jaccard join with prefix trees.

1. Documents with equal n-gram sets form a class, told by a 128-bit digest of the
   set; classes are joined, not documents.
2. Sets are ordered by n-gram hash. If two sets are as similar as asked, the
   first ``n - need(n) + quota(n)`` n-grams of each hold ``quota`` common ones, so
   a set whose prefix holds fewer n-grams that any other set's prefix also holds
   can't link. Only the prefixes are exchanged, as rows that are counted by partial
   aggregates; the rows of a frequent n-gram are dealt over several tasks.
3. Of the others, each keeps the rarest of its shared prefix n-grams (a second
   prefix, now in order of frequency), which surely hold a common one with any
   partner. Sets connected through those form blocks; no link leaves a block.
4. A block's whole sets are stored in a trie in global order. Walking the trie
   adds each edge's n-grams to the overlaps with all sets of the block at once, so
   sets that share a path share the work, and subtrees whose remaining length
   can't reach the needed overlap are skipped. A large block is cut into chunks by
   the sets' rarest n-grams, and each pair of chunks that share an n-gram of a
   second prefix is a task; other pairs can't hold a link.
5. Links give components; only a spanning forest of each task's links leaves it.

N-gram hashes have 64 bits and rest on digests of the words' bytes; two n-grams of
one pair of documents that collide would count as equal.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import chunks, forget, keyed, named, partitions, spread_join, stored
from skerry.llm.components import components
from skerry.llm.grams import ngrams, spans, words

#: A prefix holds 1 n-gram in QUOTA more than a plain prefix filter needs, so that a link needs that many common ones.
QUOTA = 10
#: Sets and n-grams of one chunk of a block.
CHUNK_SETS, CHUNK_GRAMS = 1500, 600_000


def need(n, percent: int):
    """Least overlap that a set of n n-grams can have with a similar one."""
    return -(-percent * n // 100)


def quota(n):
    return 1 + n // QUOTA


def gram_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, lower-cased in ASCII; of fewer words the whole sequence is one."""
    lanes, offsets = words(texts, lower=True)
    grams = ngrams(lanes[0], n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield spans(lanes[0][a:b], np.array([0]), np.array([b - a]))
        else:
            yield np.zeros(0, np.uint64)


def signature(grams: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """128-bit BLAKE2b digest of a set, as two numbers."""
    return struct.unpack("<qq", hashlib.blake2b(grams.tobytes(), digest_size=16, key=seed.to_bytes(4, "little")).digest())


def _sketch(n: int, percent: int, seed: int):
    """Texts in; each row's set size and signature out, with the prefix of the set where the batch has not shown it yet."""
    kind = pa.schema([("none", pa.bool_()), ("id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            sizes, first, second, seen, prefixes = [], [], [], set(), []
            for x in gram_sets(texts, n):
                h = signature(x, seed) if len(x) else (0, 0)
                sizes.append(len(x))
                first.append(h[0])
                second.append(h[1])
                fresh = len(x) > 0 and h not in seen
                seen.add(h)
                prefixes.append(x[: len(x) - need(len(x), percent) + quota(len(x))].view(np.int64) if fresh else None)
            columns = [pa.array(x, f.type) for x, f in zip((sizes, first, second, prefixes), list(kind)[3:])]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + columns, schema=kind)

    return run, "none boolean, id long, sig long, n int, h1 long, h2 long, prefix array<long>"


class PrefixTree:
    """Sets in a trie in global order, joined with queries by one walk."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = sets
        self.common = [0]
        for i, j in zip(self.order, self.order[1:]):
            m = min(len(sets[i]), len(sets[j]))
            differ = np.flatnonzero(sets[i][:m] != sets[j][:m])
            self.common.append(int(differ[0]) if len(differ) else m)

    def join(self, queries: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each stored set, the queries that are similar to it."""
        sizes = np.array([len(q) for q in queries])
        flat = np.concatenate(queries)
        order = np.argsort(flat, kind="stable")
        vocabulary, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        holder = np.repeat(np.arange(len(queries)), sizes)[order]

        def overlaps(grams: np.ndarray) -> np.ndarray:
            at = np.searchsorted(vocabulary, grams)
            at[at == len(vocabulary)] = 0
            at = at[vocabulary[at] == grams]
            n = count[at]
            ends = np.cumsum(n)
            if not len(ends):
                return np.zeros(len(queries), np.int64)
            index = np.arange(ends[-1]) - np.repeat(ends - n - first[at], n)
            return np.bincount(holder[index], minlength=len(queries))

        least, longest = min(map(len, self.sets)), max(map(len, self.sets))
        path: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(queries), np.int64))]  # depth, overlaps of the path so far
        skip = None
        for k, i in enumerate(self.order):
            shared, x = self.common[k], self.sets[i]
            if skip is not None and shared >= skip:
                continue
            skip = None
            while path[-1][0] > shared:
                path.pop()
            depth, over = path[-1]
            following = self.common[k + 1] if k + 1 < len(self.order) else 0
            for stop in sorted({shared, max(shared, following)}):
                if stop > depth:
                    over = over + overlaps(x[depth:stop])
                    depth = stop
                    path.append((depth, over))
                    reach = over + np.minimum(longest - depth, sizes - over)
                    if not (reach * (100 + percent) >= percent * (least + sizes)).any():
                        skip = depth
                        break
            if skip is not None:
                continue
            over = over + overlaps(x[depth:])
            yield i, np.flatnonzero(100 * over >= percent * (len(x) + sizes - over))


def _links(percent: int):
    """Cells of blocks in, links out: (a, b, n): an edge of the spanning forest if a <> b, else n links of a."""

    def of(rows: list[dict]) -> pa.RecordBatch:
        rows = list({(r["h1"], r["chunk"]): r for r in rows}.values())
        sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        left = [i for i, r in enumerate(rows) if r["chunk"] == r["ci"]]
        right = [i for i, r in enumerate(rows) if r["chunk"] == r["cj"]]
        a, b, n = [], [], []
        if left and right and len(rows) > 1:
            label, right = np.arange(len(rows)), np.array(right)
            weight = np.array([r["copies"] for r in rows])
            total = np.zeros(len(rows), np.int64)
            inner = rows[0]["ci"] == rows[0]["cj"]
            for i, found in PrefixTree([sets[i] for i in left]).join([sets[j] for j in right], percent):
                x, found = left[i], right[found]
                found = found[found != x]
                total[x] += weight[found].sum()
                if not inner:
                    total[found] += weight[x]
                labels, some = np.unique(label[found], return_index=True)
                for l, j in zip(labels, found[some]):
                    if l != label[x]:
                        a.append(rows[x]["h1"])
                        b.append(rows[j]["h1"])
                        n.append(0)
                        label[label == l] = label[x]
            for i in np.flatnonzero(total):
                a.append(rows[i]["h1"])
                b.append(rows[i]["h1"])
                n.append(int(total[i]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            key = (row["block"], row["ci"], row["cj"])
            if key != at and rows:
                yield of(rows)
                rows = []
            at = key
            rows.append(row)
        if rows:
            yield of(rows)

    return run


def _classes(rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Sketches of all rows, the classes of equal sets by h1, and the seed by which no two classes share h1."""
    seed = 0
    while True:
        sketch = stored(rows.mapInArrow(*_sketch(n, percent, seed)), "sketch")
        groups = sketch.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("none", "id", "sig")).alias("first"), F.count("*").alias("copies"))
        classes = stored(groups, "classes")
        if classes.groupBy("h1").count().where("count > 1").isEmpty():
            return sketch, classes, seed
        forget(sketch, classes)
        seed += 1


def _postings(sketch: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """h1, gram, home: the second prefix of each set that can link (n-grams it shares, rarest first) and the rarest of them.

    N-grams are counted by partial aggregates, and the rows of a frequent one are dealt over several tasks.
    """
    prefix = sketch.where("prefix is not null").select("h1", F.explode("prefix").alias("gram"))
    counted = prefix.groupBy("gram").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n"))
    grams = stored(counted.where("low < high").select("gram", "n"), "grams")
    held = spread_join(prefix, grams, ["gram"]).groupBy("h1").agg(F.sort_array(F.collect_set(F.struct(F.col("n").alias("df"), "gram"))).alias("held"))
    least = F.expr(f"1 + ceil({percent} * n / 100) div {QUOTA}").cast("int")
    able = held.join(classes.select("h1", "n"), "h1").where(F.size("held") >= least)
    rare = able.select("h1", F.slice("held", F.lit(1), F.size("held") - least + 1).alias("held"))
    out = stored(rare.select("h1", F.explode("held.gram").alias("gram"), F.col("held")[0]["gram"].alias("home")), "postings")
    forget(grams)
    return out


def _placed(postings: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of blocks with their chunk (block, chunk, h1, first, copies), and the pairs of chunks that share an n-gram of a second prefix.

    A block is what is connected through second prefixes. Sets with one rarest
    n-gram go to one chunk while it has room, so that few pairs of chunks share any.
    """
    low = stored(postings.groupBy("gram").agg(F.min("h1").alias("b"), F.max("h1").alias("last"), F.count("*").alias("n")).where("b < last").drop("last"), "low")
    blocks = components(spread_join(postings, low, ["gram"]).select(F.col("h1").alias("a"), "b"))
    homes = postings.groupBy("h1").agg(F.first("home").alias("home"))
    members = blocks.select(F.col("node").alias("h1"), F.col("root").alias("block")).join(classes, "h1").join(homes, "h1")
    members = stored(members.select("block", "h1", "first", "copies", "n", "home"), "members")
    parts = lambda: F.greatest(F.ceil(F.count("*") / F.lit(CHUNK_SETS)), F.ceil(F.sum("n") / F.lit(CHUNK_GRAMS)))
    rows = members.select("*", F.col("n").alias("grams")).drop("n")
    sizes = stored(members.groupBy("block").agg(parts().alias("k"), F.count("*").alias("n")), "sizes")
    bins = spread_join(rows, sizes, ["block"]).drop("n").withColumn("bin", F.pmod(F.xxhash64("home"), F.col("k")))
    fill = bins.withColumnRenamed("grams", "n").groupBy("block", "bin").agg(parts().alias("m"), F.count("*").alias("rows"))
    fill = stored(fill.withColumnRenamed("rows", "n"), "fill")
    chunk = F.col("bin") * (1 << 31) + F.pmod(F.xxhash64("h1"), F.col("m"))
    placed = stored(spread_join(bins, fill, ["block", "bin"]).select("block", chunk.alias("chunk"), "h1", "first", "copies", ((F.col("k") > 1) | (F.col("m") > 1)).alias("cut")), "placed")
    held = spread_join(postings.select("h1", "gram"), low.select("gram", "n"), ["gram"]).drop("n").join(placed.where("cut").select("h1", "block", "chunk"), "h1")
    lists = held.groupBy("gram", "block").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))
    later = F.transform("chunks", lambda x, i: F.transform(F.slice(F.col("chunks"), i + 1, F.size("chunks")), lambda y: F.struct(x.alias("ci"), y.alias("cj"))))
    pairs = lists.select("block", F.explode(F.flatten(later)).alias("p")).select("block", "p.*").distinct()
    return placed, stored(pairs, "pairs")


def _joined(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (none, id, sig, n, h1, h2) and classes with their root and component: the work behind jaccard_join."""
    rows = keyed(docs, id_col, text_col)
    sketch, classes, seed = _classes(rows, n, percent)
    postings = _postings(sketch, classes, percent)
    placed, pairs = _placed(postings, classes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("block", pa.int64()), ("h1", pa.int64()), ("copies", pa.int64()), ("chunk", pa.int64()), ("cut", pa.bool_()), ("grams", pa.binary())])
        for batch, texts in chunks(batches, "text"):
            wanted = batch.column(batch.schema.get_field_index("h1")).to_pylist()
            grams = [x.tobytes() if len(x) and signature(x, seed)[0] == h else None for x, h in zip(gram_sets(texts, n), wanted)]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kind.names[:-1]] + [pa.array(grams, pa.binary())], schema=kind)
            yield out.filter(out.column(5).is_valid())

    # Texts are always dealt by document, at every size: what is wanted of them grows with the input.
    wanted = placed.select("first.none", "first.id", "first.sig", "h1", "block", "copies", "chunk", "cut").hint("merge")
    full = stored(rows.join(wanted, ["none", "id", "sig"]).mapInArrow(sets, "block long, h1 long, copies long, chunk long, cut boolean, grams binary"), "sets")
    whole = full.where("not cut").withColumn("ci", F.col("chunk")).withColumn("cj", F.col("chunk"))
    sides = pairs.select("block", F.col("ci").alias("chunk"), "ci", "cj").unionByName(pairs.where("ci < cj").select("block", F.col("cj").alias("chunk"), "ci", "cj"))
    cells = whole.unionByName(full.where("cut").join(sides.hint("merge"), ["block", "chunk"])).drop("cut")
    buckets = partitions(docs.sparkSession)
    links = cells.repartition(buckets, "block", "ci", "cj").sortWithinPartitions("block", "ci", "cj").mapInArrow(_links(percent), "a long, b long, n long")
    links = stored(links, "links")
    roots = components(links.select("a", "b"))
    linked = links.groupBy(F.col("a").alias("h1")).agg(F.sum("n").alias("linked"))
    all_of = classes.join(roots.withColumnRenamed("node", "h1"), "h1", "left").join(linked, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    all_of = stored(all_of, "linked")
    smallest = stored(all_of.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "smallest")
    answers = spread_join(all_of.withColumnRenamed("n", "grams"), smallest, ["root"]).drop("n")
    answers = stored(answers.select("h1", "h2", "root", "component", F.col("copies").alias("n"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links")), "answers")
    forget(postings, placed, pairs, full, links, all_of, smallest, classes)
    return sketch.select("none", "id", "sig", F.col("n").alias("grams"), "h1", "h2"), answers


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links, copies.

    Documents link when ``100 * intersection >= percent * union`` of their n-gram
    sets; ``component_id`` is the smallest doc_id reachable, ``n_links`` the
    number of documents linked with it. Texts without words (null ones too) link
    with nothing and are their own component. Null doc_ids count as larger than
    any other, whatever its value. Repeated rows link with one another. An empty
    table gives an empty result; other columns are ignored. Whole texts count,
    whatever their length, and no link is left out, whatever a block's size.
    """
    rows, answers = _joined(docs, n, percent, id_col, text_col)
    joined = rows.where("grams > 0").transform(lambda r: spread_join(r, answers, ["h1", "h2"]))
    linked = joined.select(named(F.col("none"), F.col("id")).alias("doc_id"), F.col("grams").cast("long").alias("n_shingles"), named(F.col("component.none"), F.col("component.id")).alias("component_id"), F.col("links").alias("n_links"), F.col("n").alias("copies"))
    own = named(F.col("none"), F.col("id"))
    alone = rows.where("grams = 0").select(own.alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), own.alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return linked.unionByName(alone)


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """none, id, sig, n: the rows that stand for their group of linked texts, n times in docs: the smallest doc_id, then the smallest sig.

    Rows without words belong to no group and are not listed.
    """
    rows, answers = _joined(docs, n, percent, id_col, text_col)
    kept = rows.where("grams > 0").join(answers.select("component.*").distinct().hint("merge"), ["none", "id", "sig"], "left_semi")
    return kept.groupBy("none", "id", "sig").agg(F.count("*").alias("n"))
