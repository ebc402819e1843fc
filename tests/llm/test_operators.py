"""Each operator against a brute-force version, and on rows that try it: nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import exact_dedup, fingerprint, jaccard_join, language, mixing, packing, personal_data, quality, queries, stages, substring_dedup, token_counts
from skerry.llm.common import intermediates, spread_join, stored
from skerry.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, score string, kept string, part int, copies int, bucket int, row string, key string, n int, none string, sig string, text_sha256 string, pattern string, place string, label string, known string, found string, words string, sources string, _id string, _salt string"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows(spark):
    """Real documents and odd ones: (doc_id, text, lang, source)."""
    found = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    long = " ".join(f"w{i * i % 7919}" for i in range(30_000))
    base = " ".join(f"x{i}" for i in range(120))
    odd = [
        (1000, None, None, None), (1001, "", "en", None), (1002, " \t\n ", None, "src1"), (1003, long, "en", "src2"), (1004, long + " tail", "en", "src2"),
        (1005, base, "en", "src3"), (1006, base.upper(), "en", "src3"), (1006, base.upper(), "en", "src3"), (1007, base.replace("x7 ", "y7 "), "en", "src4"), (1008, base.replace(" ", "  \n"), "en", "src4"),
        (1009, "one", None, "src5"), (1010, "two words", "xx", "src5"), (1011, "12 34 !!", "en", "src5"), (1012, " nbsp\u0085x \U0001f600 é İΣ", "en", "src5"), (1013, "same " * 200, "en", "src6"), (1014, "same " * 300, "en", "src6"),
        (1015, "mail a.b@c.de,x@y.zz_q@r.st 1.2.3.4 256.1.1.1 4111 1111 1111 1111 +49 (30) 1234-567 +1", "en", "src7"), (None, base, "en", "src7"), (None, "no name here", None, None),
        (2**63 - 1, base + " the largest", "en", "src7"), (2**63 - 1, "two " * 60, "en", "src7"), (1010, "two " * 61, "en", "src8"), (1006, base.upper() + "  ", "en", "src3"),
    ]
    return found + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 4, 1, 1, 1, "c", "c", 1, *["c"] * 12) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def big(doc_id):
    return 2**63 if doc_id is None else doc_id


def test_substring_dedup(docs, rows, none):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, 2**64), big(i))
    want = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = bytearray(len(w))
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < big(i):
                gone[a : a + 50] = b"\1" * 50
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((big(i), len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    got = [(big(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 0
    assert substring_dedup.remove_repeats(none).count() == 0


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_made_to_collide_are_told_apart(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64, whatever its base."""
    one = thue_morse(10)
    two = one.translate(str.maketrans("ab", "ba"))
    side = " ".join(f"s{i}" for i in range(49))
    apart = spark.createDataFrame([(1, f"{one} {side}"), (2, f"{two} {side}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(apart).collect()] == [0, 0]
    assert {r.component_id for r in jaccard_join.jaccard_join(apart, 50, 85).collect()} == {1, 2}
    letters = [" ".join(w) for w in (one, two)]
    apart = spark.createDataFrame([(1, letters[0]), (2, letters[1])], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_join(apart, 1024, 85).collect()} == {1, 2}


def test_factors_are_runs_of_the_reference(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {1: words[:200], 2: words[150:400], 3: ["new"] + words[100:180] + ["x"] + words[160:300] + ["y"] * 70}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    found = {(f.begin, f.end, f.ref_id, f.place) for f in got[3].factors}
    assert (1, 81, 1, 100) in found and any(ref == 2 and end == 222 for _, end, ref, _ in found)
    for i in (2, 3):
        for f in got[i].factors:
            assert f.end - f.begin >= 50 and f.ref_id < i and texts[i][f.begin : f.end] == texts[f.ref_id][f.place : f.place + f.end - f.begin]
    assert got[2].spans == [[0, 50]] and got[3].spans == [[1, 81], [82, 222]]


def test_greedy_parse_covers_what_matches_cover():
    rng = np.random.default_rng(4)
    for _ in range(300):
        found = [(int(b), int(b + 5 + n), "xyz"[int(r)], int(b) + int(r) * 100 + int(s)) for b, n, r, s in zip(rng.integers(0, 60, 12), rng.integers(0, 9, 12), rng.integers(0, 3, 12), rng.integers(0, 2, 12))]
        out = substring_dedup.parse(found)
        cover = lambda spans: {i for b, e, *_ in spans for i in range(b, e)}
        assert cover(out) == cover(found) and all(a[1] < b[1] and a[0] <= b[0] for a, b in zip(out, out[1:]))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, rows, none, n, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 2**64), big(r[0]))
    want = sorted((big(r[0]), len(sets[i]), low[find(i)], links[i]) for i, r in enumerate(rows))
    got = jaccard_join.jaccard_join(docs, n, percent).collect()
    assert sorted((big(r.doc_id), r.n_shingles, big(r.component_id), r.n_links) for r in got) == want
    if n == 4:
        assert jaccard_join.jaccard_join(none).count() == 0


def test_prefix_tree_prunes_nothing_it_needs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    found = {(i, j) for i, js in jaccard_join.PrefixTree(sets).join(sets, 60) for j in js}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))}
    assert found == want


def test_large_blocks_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 7)
    base = [f"w{i}" for i in range(80)]
    data = [(i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(60)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), 1, 90).collect()
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {59}


def test_pairs_of_chunks_lose_no_link(spark, monkeypatch):
    """Families that boilerplate connects into one block, cut into many chunks, against brute force."""
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 5)
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(30)]
    sets, data = [], []
    for family in range(12):
        own = [f"f{family}_{i}" for i in range(40)]
        for _ in range(8):
            words = common + own
            for at in rng.integers(0, len(words), 4):
                words[at] = f"x{rng.integers(0, 10**9)}"
            sets.append(set(words))
            data.append((len(data), " ".join(rng.permutation(words))))
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), 1, 80).collect()}
    want = {i: sum(100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert got == want and sum(want.values()) > 100


@pytest.mark.parametrize("gather", [0, 500_000])
def test_components(spark, monkeypatch, gather):
    from skerry.llm import components as module

    monkeypatch.setattr(module, "GATHER", gather)
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, rows, none):
    got = fingerprint.edited_fingerprints(docs).collect()
    texts = collections.Counter(t or "" for _, t, *_ in rows)
    assert len(got) == len(rows)
    order = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    single = {i: t or "" for i, t, *_ in rows}
    by_id = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:]):
        if not {a, b} & {1006, 1010, 2**63 - 1}:
            t, n = single[a], len(single[a])
            edited = t[: n - n // 2] + single[b][: n // 2]
            assert by_id[a].n_chars == n and by_id[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    for t in texts:
        assert len({r.fingerprint for r in got if r.n_chars == len(t) and single.get(r.doc_id) == t}) <= 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited for r in got]) > 0.2 > np.mean([r.near_next for r in got])
    assert fingerprint.edited_fingerprints(none).count() == 0


def test_fingerprints_of_one_heavy_identifier(spark):
    """A third of all rows under one identifier, and null ones: each row has its successor once, in the stated order."""
    data = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"{i} " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = fingerprint.edited_fingerprints(docs).collect()
    key = {r.text: r.k for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    want = collections.Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(2)
    middle = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    names = []
    for before in (b"", b"q", b"zzzz and more"):
        x, at = np.frombuffer(before + middle, np.uint8), np.array([0, len(before) + len(middle)])
        for _ in range(3):
            x, at = fingerprint.parse_level(x, at)
        names.append(set(x.tolist()))
    assert len(names[0] & names[1] & names[2]) > 0.9 * len(names[0])
    a, b, c = fingerprint.fingerprints([middle, middle[:2000] + b"0" * 20 + middle[2000:], bytes(rng.integers(97, 123, 3000).astype(np.uint8))])
    assert fingerprint.likeness(a[None], b[None])[0] > 0.8 and fingerprint.likeness(a[None], c[None])[0] < 0.2


def water_level(sizes, weights, budget):
    """Targets by bisection of the level at which sources are full, exact at the end; shares no code with the operator."""
    breaks = sorted({Fraction(2 * sizes[s], weights[s]) for s in sizes})
    used = lambda level: sum(min(Fraction(2 * sizes[s]), level * weights[s]) for s in sizes)
    below = max([x for x in breaks if used(x) <= budget], default=Fraction(0))
    free = [s for s in sizes if Fraction(2 * sizes[s], weights[s]) > below]
    level = below + (budget - used(below)) / sum(weights[s] for s in free) if free else below
    return {s: min(Fraction(2 * sizes[s]), level * weights[s]) for s in sizes}


def test_mixing_by_tasks_is_the_same(docs, none):
    both = F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 0, F.array("source", "lang")).when(F.col("doc_id") % 11 == 5, F.array().cast("array<string>")).otherwise(F.array("source"))
    size = F.coalesce(F.length("text"), F.lit(0))
    runs = [mixing.mix(docs, both, size, tell_apart=["text"], limit=n).select("doc_id", "text", F.col("size").alias("z"), "source_size", F.round("target", 3).alias("t"), "copies") for n in (1000, 0)]
    assert sorted(map(repr, runs[0].collect())) == sorted(map(repr, runs[1].collect()))
    assert mixing.mix(none, F.array("source"), F.lit(1), limit=0).count() == 0


def test_rows_of_null_identifiers_have_places_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"a b c d{i}", "s") for i in range(100)] + [(i, "x y z t", "r") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix_by_source(docs, weights=(1, 9)).where("source = 's'").groupBy().agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).first()
    assert abs(got.n - got.t) <= 4


def test_mixing(docs, rows, none):
    got = mixing.mix_by_source(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, Fraction(3, 2) * sum(sizes.values()))
    assert sum(want.values()) == Fraction(3, 2) * sum(sizes.values()) and all(want[s] <= 2 * sizes[s] for s in names)
    for s in names:
        mine = [r for r in got if r.source == s]
        taken = sum(r["size"] * r.copies for r in mine)
        assert {r.source_size for r in mine} == {sizes[s]}
        assert abs(mine[0].target - float(want[s])) < 1e-6
        assert abs(taken - want[s]) <= max(r["size"] for r in mine) / 2 + 1
        assert all(0 <= r.copies <= 2 for r in mine)
    again = mixing.mix_by_source(docs.repartition(5)).select("doc_id", "size", "copies").collect()
    assert sorted((big(r.doc_id), r["size"], r.copies) for r in again) == sorted((big(r.doc_id), r["size"], r.copies) for r in got)
    assert mixing.mix_by_source(none).count() == 0


def test_flow_reroutes_between_overlapping_sources():
    capacity = {("a", "b"): 10, ("a",): 4}
    flow = mixing.min_cost_flow(capacity, {p: p for p in capacity}, {"a": 10, "b": 4}, 1)
    by_source = collections.Counter()
    for (_, _, s), n in flow.items():
        by_source[s] += n
    assert by_source == {"a": 10, "b": 4}


def test_flow_reroutes_across_copies():
    capacity = {("A", "B"): 100, ("A",): 1000}
    flow = mixing.min_cost_flow(capacity, {p: p for p in capacity}, {"A": 1450, "B": 200}, 2)
    assert sum(n for (_, _, s), n in flow.items() if s == "A") == 1450 and sum(n for (_, _, s), n in flow.items() if s == "B") == 200


def test_flow_against_brute_force():
    import itertools
    import random

    draw = random.Random(5)
    for _ in range(300):
        names = "ABC"[: draw.randint(2, 3)]
        sets = [p for k in range(1, len(names) + 1) for p in itertools.combinations(names, k)]
        capacity = {p: draw.randint(0, 4) for p in draw.sample(sets, draw.randint(1, 3))}
        demand = {s: draw.randint(0, 6) for s in names}
        flow = mixing.min_cost_flow(capacity, {p: p for p in capacity}, demand, 2)
        taken, got = collections.Counter(), collections.Counter()
        for (p, c, s), n in flow.items():
            assert s in p and n >= 0
            taken[p, c] += n
            got[s] += n
        assert all(n <= capacity[p] for (p, _), n in taken.items()) and all(n <= demand[s] for s, n in got.items())
        # By Hall's condition, words x of the patterns can all be placed if no group of patterns gives more than its sources want.
        best = (0, 0)
        for x in itertools.product(*[range(2 * n + 1) for n in capacity.values()]):
            by = dict(zip(capacity, x))
            groups = (g for k in range(1, len(by) + 1) for g in itertools.combinations(by, k))
            if all(sum(by[p] for p in g) <= sum(demand[s] for s in set().union(*g)) for g in groups):
                best = min(best, (-sum(x), sum(max(0, n - capacity[p]) for p, n in by.items())))
        assert (-sum(taken.values()), sum(n for (_, c), n in taken.items() if c == 1)) == best


def test_quality(spark, docs, rows, none):
    good = [f"This is a plain sentence number {i} and it reads well enough for anybody." for i in range(60)]
    bad = [f"THI!! IS!! BAD!! {i}!! $$$%% &&& ***" for i in range(60)]
    known = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(120)] + [(5, 1, None), (7, None, None), (None, 0, None)], "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 3 != 0
    net = quality.train(known, labels, learn)
    out = {r.doc_id: r for r in quality.score(known, net).collect()}
    held = [i for i in range(120) if i % 3 == 0]
    assert np.mean([out[i].predicted == (i < 60) for i in held]) > 0.95
    all_rows = quality.score(docs, net)
    assert all_rows.count() == len(rows) and all_rows.where("score between 0 and 1").count() == len(rows)
    one, two = quality.scores(net, [good[0].encode() * 40, b""]), quality.scores(net, [b"", good[0].encode() * 40])
    assert np.allclose(one, two[::-1], atol=1e-5)
    assert quality.score(none, net).count() == 0
    assert {r.score for r in quality.score(known, quality.train(none, labels)).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 100 and (got["predicted"] == got["quality"]).mean() > 0.95
    assert queries.op5_quality(spark, "/root/testdata/sf0.01").count() == docs.count()


def test_the_sample_of_texts_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("good text " if i % 2 else "B!A!D ") * 50) for i in range(40)] + [(99, "good " * 10**6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, quality int")
    net = quality.train(docs, labels, sample_bytes=10**5)
    out = {r.doc_id: r.predicted for r in quality.score(docs, net).collect()}
    assert all(out[i] == i % 2 for i in range(40))


def test_every_place_of_a_long_text_counts():
    net = quality.fit([b"plain words here " * 30] * 20 + [b"plain words here " * 15 + b"#$%^&*" * 30] * 20, np.array([1] * 20 + [0] * 20, np.float32))
    clean = b"plain words here " * 400
    inside = clean[:5000] + b"#$%^&*" * 200 + clean[5000:]
    assert quality.scores(net, [clean])[0] > quality.scores(net, [inside])[0]


def test_exact_dedup(docs, rows, none):
    norm = [re.sub(f"[{SPACE}]", "", t or "") for _, t, *_ in rows]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    want = []
    for t, members in groups.items():
        keep = min(members, key=lambda i: (-len(rows[i][1] or ""), big(rows[i][0])))
        for i in members:
            want.append((big(rows[i][0]), big(rows[keep][0]), len(members), rows[i][:2] == rows[keep][:2], hashlib.sha256(t.encode()).hexdigest()))
    got = [(big(r.doc_id), big(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.find_copies(docs).collect()]
    assert sorted(got) == sorted(want)
    assert exact_dedup.find_copies(none).count() == 0


def test_merge_index(spark, docs, tmp_path):
    index = exact_dedup.MergeIndex(spark, f"file://{tmp_path}", fan_in=3)
    rows = exact_dedup.digests(docs)
    for i in range(4):
        index.insert(rows.where(F.pmod(F.xxhash64("id", "sig"), F.lit(4)) == i), flushes=2)
    assert [len(runs) for runs in index.levels] == [2, 2]  # eight flushes: 2 of level 0 are left, 6 were merged into 2
    whole = exact_dedup.memtable(rows)
    assert sorted(map(repr, index.entries().collect())) == sorted(map(repr, whole.collect()))
    one = whole.where("n > 1").first()
    assert index.lookup(bytes(one.digest)).first().n == one.n
    assert index.lookup(b"no such digest").count() == 0


def test_runs_are_sorted_and_have_filters(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    index = exact_dedup.MergeIndex(spark, f"file://{tmp_path}")
    index.insert(exact_dedup.digests(docs), flushes=2)
    for run in index.levels[0]:
        for file in __import__("pathlib").Path(run.removeprefix("file:")).glob("*.parquet"):
            got = pq.read_table(file).column("digest").to_pylist()
            assert got == sorted(got)


def test_texts_that_share_a_digest_are_told_apart(spark):
    texts = ["aa", "a a", "ab", "ab ", "cc", "cd", "cd", "e"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    short = lambda body: F.substring(body, 1, 1).cast("binary")  # noqa: E731  a digest that collides
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(docs, digest=short).collect()}
    assert got == {0: (1, 2, False), 1: (1, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}


def test_personal_data(docs, rows, none):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    want = []
    for i, t, *_ in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, t or "") if holds(k, m.group())]
        want.append((big(i), ",".join(spans)))
    got = personal_data.find(docs).select("doc_id", personal_data.described(F.col("base")).alias("b")).collect()
    assert sorted((big(r.doc_id), r.b) for r in got) == sorted(want)
    assert personal_data.find(none).count() == 0


def test_telling_terms_and_sanitised_text(spark):
    filler = [(100 + i, f"write to person{i}@mail.org about common matters") for i in range(200)]
    told = [(i, "the hermit zebulon answers at zeb@cave.net always") for i in range(5)]
    data = spark.createDataFrame(filler + told, "doc_id long, text string")
    data = data.withColumn("text", F.concat("text", F.lit(" "), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")))
    clean = {r.doc_id: r.text for r in personal_data.sanitise(data).collect()}
    assert "zebulon" not in clean[0] and "[TERM]" in clean[0] and "[EMAIL]" in clean[0]
    assert clean[150] == "write to [EMAIL] about common matters bfa"


def test_terms_count_over_whole_texts_of_all_documents(spark):
    import regex

    far = " ".join(f"pad{'abcdefghij'[i % 10]}" for i in range(60))
    told = [(i, f"Zebulon wrote. {far} zeb@cave.net answers. {far} Greetings, ZEBULON. common {i}") for i in range(4)]
    other = [(100 + i, f"common matters {far} person{i}@mail.org") for i in range(100)] + [(300 + i, f"common matters answers {i}") for i in range(100)] + [(500, "é " * 300 + "zeb@cave.net\U0001f600zebulon"), (501, None)]
    data = spark.createDataFrame(told + other, "doc_id long, text string")
    got = {r.doc_id: [tuple(t)[1:3] for t in r.terms] for r in personal_data.find(data).select("doc_id", "terms").collect()}
    texts = dict(told + other)
    for i, t in texts.items():  # name in the header, e-mail further on: every place; common words: nowhere
        want = [m.span() for m in regex.finditer("zebulon|wrote|greetings", (t or "").lower())] if "zeb@cave.net" in (t or "") else []
        assert got[i] == want, i
    clean = {r.doc_id: r.text for r in personal_data.sanitise(data).collect()}
    assert "zebulon" not in clean[0].lower() and clean[0].count("common") == 1


def test_telling_terms_against_plain_counts(docs):
    import regex

    min_docs, min_share, min_bits = 2, 0.3, 1.0
    more = docs.sparkSession.createDataFrame([(3000 + i, f"the hermit zebulon {i} answers at zeb@cave.net or {i % 2}.2.3.4 always, he of the caves") for i in range(6)], "doc_id long, text string")
    got = personal_data.find(docs.select("doc_id", "text").unionByName(more), min_docs, min_share, min_bits, keep_text=True).select("doc_id", "text", "base", "terms").collect()
    masks, ents, words = [], [], []
    for r in got:
        t = list(r.text)
        for s in r.base:
            t[s.start : s.end] = " " * (s.end - s.start)
        ents.append({r.text[s.start : s.end].lower() for s in r.base})
        masks.append([(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}{3,}", "".join(t))])
        words.append({w for _, _, w in masks[-1]})
    n_ent, n_term, n_both = (collections.Counter() for _ in range(3))
    lead = {r.text: i for i, r in enumerate(got)}.values()  # each distinct text counts once
    for e, w in ((ents[i], words[i]) for i in lead):
        n_ent.update(e), n_term.update(w), n_both.update((x, y) for x in e for y in w)
    telling = {k for k, n in n_both.items() if n >= min_docs and n / n_term[k[1]] >= min_share and np.log2(n / n_term[k[1]] * len(lead) / n_ent[k[0]]) >= min_bits}
    assert telling
    for r, e, m in zip(got, ents, masks):
        assert [(t.start, t.end) for t in r.terms] == [(a, b) for a, b, w in m if any((x, w) in telling for x in e)]


def test_secrets_against_plain_search(spark):
    import random

    draw = random.Random(3)
    key = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    often = "a1b2c3d4e5f6a7b8c9"
    texts = [f"plain words {i} covid19vaccine {'x' * 30} {'7' * 20}" for i in range(60)] + [f"password={key(18)} é \U0001f600 token = \"{key(40)}\"" for _ in range(10)] + [f"{often} {i}" for i in range(30)] + [f"mail {key(20)}@x.org", "", None]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in personal_data.find(data).collect()}
    for i, t in enumerate(texts):
        found = [m for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}", t or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and "@" not in t]
        assert got[i] == [m.span() for m in found if m[0] != often], i
    assert sum(map(len, got.values())) == 20
    clean = {r.doc_id: r.text for r in personal_data.sanitise(data).collect()}
    assert clean[60] == 'password=[SECRET] é \U0001f600 token = "[SECRET]"'


def test_spans_of_many_matches(spark):
    text = "a.b " * 1000 + "é1.2.3.4 "
    row = spark.createDataFrame([(text,)], "text string").select(personal_data.spans_of(F.col("text"), "[ab]").alias("s")).first()
    assert [(s.start, s.end, s.match) for s in row.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("[ab]", text)]


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_file())
    pieces = packing.pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in pieces)
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for n in packing.cut(len(ids), 4096):
            want[(i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids))] += 1
            at += n
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    assert packing.pack(none).count() == 0
    assert packing.cut(10_000, 4096) == [4096, 4096, 1024, 512, 256, 16] and packing.cut(5, 1) == [1] * 5


def test_packing_bounds_memory(spark, monkeypatch):
    """The pipeline's stage hands small batches to Python, and idle workers keep no words."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, real, key = packing.tokenizer_file(), packing.chunks, "spark.sql.execution.arrow.maxBytesPerBatch"

    def checked(batches, column):
        def small():
            for batch in batches:
                assert batch.nbytes < 6_000_000, batch.nbytes
                yield batch

        return real(small(), column)

    def kept(batches):
        encoder = packing.encoder_of(path)
        yield pa.RecordBatch.from_arrays([pa.array([len(encoder.known) + len(encoder.pieces)])], names=["n"])

    monkeypatch.setattr(packing, "chunks", checked)
    docs, before = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 400) AS text"), spark.conf.get(key)  # 12 MB in one task
    tk = Tokenizer.from_file(path)
    tokens = sum(400 * len(tk.encode(f"word{i}", add_special_tokens=False).ids) + 1 for i in range(4000))
    assert stages.pack_sequences(spark, docs, "").agg(F.sum("length")).first()[0] == tokens
    assert spark.conf.get(key) == before
    assert spark.range(0, 64, 1, 32).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0


def test_buckets_hold_one_length_each(docs, tmp_path):
    packing.write_buckets(packing.pack(docs, with_ids=True), f"file://{tmp_path}/out")
    back = docs.sparkSession.read.parquet(f"file://{tmp_path}/out")
    assert back.where("length <> shiftleft(1, bucket) or size(ids) <> length").count() == 0
    assert back.count() == packing.pack(docs).count()


@pytest.mark.parametrize("text", ["It's DON'T we'LL", "\u00bd \u00b2x \u00aab \u00b5m \u00c0\u00c9\u00df \u00ff", "a b\u0085c \x1cx", "\u0391\u03a3 \u0130I e\u0301", "<|endoftext|> hi", "#$%'s''t", "\u65e5\u672c\u8a9e \U0001f600!", "\u00ad soft\u00adhyphen", "\x7f\x80 a", "x" * 3000])
def test_word_encoder(text):
    e = packing.encoder_of(packing.tokenizer_file())
    assert list(e.encode(text.encode())) == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_file())
    lengths = [len(tk.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    got = {r.length: r for r in token_counts.sums(token_counts.histogram(docs)).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.docs == lengths.count(n) and r.tokens == n * r.docs
        assert r.docs_beyond == sum(x > n for x in lengths) and r.tokens_beyond == sum(x for x in lengths if x > n)
        assert r.docs_up_to == len(lengths) - r.docs_beyond and r.tokens_up_to == sum(lengths) - r.tokens_beyond
        assert r.tokens_if_cut == sum(min(x, n) for x in lengths) and abs(r.quantile - r.docs_up_to / len(lengths)) < 1e-12
    assert token_counts.sums(token_counts.histogram(none)).count() == 0


def test_language(spark, docs, rows, none):
    model = language.train(docs, learn=queries.remainder(4) != 2)
    out = language.identify(docs, model).select("doc_id", "lang", "lang_pred", F.col("score").alias("s"), "text", (queries.remainder(4) == 2).alias("held"))
    got = out.collect()
    real = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 1000]
    assert len(got) == len(rows) and np.mean([r.lang == r.lang_pred for r in real]) > 0.95
    for r in got:
        assert 0 <= r.s <= 1
        if r.doc_id in (1000, 1001, 1002, 1011):
            assert r.lang_pred == "und" and r.s == 0
    assert language.identify(none, model).count() == 0
    assert language.train(none).languages == []


def test_mixtures_of_languages(docs, rows):
    model = language.train(docs.where("doc_id < 1000"))
    text = {l: next(t for i, t, x, _ in rows if x == l and len(t) > 1500) for l in ("en", "fr")}
    (lead, share, all_shares), = language.infer([text["en"][:1500] + " " + text["fr"][:700]], model)
    assert lead == "en" and 0.5 < share < 0.85 and 0.15 < all_shares["fr"] < 0.5


def test_languages_do_not_hang_on_neighbours():
    table = np.zeros((language.CELLS, 3), np.float32)
    for letter, row in {"a": (0, -5, -20), "b": (-0.1, 0, -20), "c": (-20, -20, 0)}.items():
        table[language.trigrams(language.code_points(letter * 40))[5]] = row
    model = language.Model(["A", "B", "C"], table)
    text = "a" * 480 + "b" * 288 + "c" * 192  # two languages score below one, three above
    alone, = language.infer([text], model)
    beside = language.infer([text, "a" * 480 + "c" * 480], model)[0]
    assert alone == beside and 0.1 < alone[2]["C"] < 0.3


def as_rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_exact_copies_stage(spark, docs):
    rows, groups = list(as_rows(docs).elements()), collections.defaultdict(list)
    key = {r.text: r.k for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    for r in rows:
        groups[re.sub(f"[{SPACE}]", "", r[1] or "")].append(r)
    want = collections.Counter(min(g, key=lambda r: (-len(r[1] or ""), big(r[0]), key[r[1]])) for g in groups.values())
    assert as_rows(stages.drop_exact_copies(spark, docs, "")) == want


def test_near_copies_stage(spark, docs):
    rows = list(as_rows(docs).elements())
    key = {r.text: r.k for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for r in rows:
        w = (r[1] or "").encode().translate(lower).split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = collections.Counter(rows[i] for i in range(len(rows)) if not sets[i])
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g and sets[i]]
        if members:
            want[min(members, key=lambda r: (big(r[0]), key[r[1]]))] += 1
    assert as_rows(stages.drop_near_copies(spark, docs, "")) == want


def test_near_copies_of_one_identifier(spark):
    base = [f"w{i}" for i in range(100)]
    near = base[:50] + ["new"] + base[51:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (2, "some other text of its own words"), (2, "some other text of its own words"), (None, ""), (None, "")], "doc_id long, text string")
    got = sorted(map(repr, stages.drop_near_copies(spark, docs, "").collect()))
    assert got == sorted(map(repr, docs.collect()[:1] + docs.collect()[2:3] + docs.collect()[4:]))


def test_mix_and_quality_stages(spark, docs):
    sf = "/root/testdata/sf0.001"
    copies = collections.Counter()
    for r in mixing.mix_by_source(docs.select("doc_id", "text", "source", "lang")).collect():
        copies[r.doc_id, r.text, r.source, r.lang] += r.copies
    got = collections.Counter((r.doc_id, r.text, r.source, r.lang) for r in stages.mix_sources(spark, docs, sf).collect())
    assert got == +copies
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    want = collections.Counter((r.doc_id, r.text) for r in scored.where("predicted = 1").collect())
    assert collections.Counter((r.doc_id, r.text) for r in stages.drop_low_quality(spark, docs, sf).collect()) == want


def test_stages(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    for stage in (stages.drop_low_quality, stages.drop_exact_copies, stages.drop_near_copies, stages.mix_sources):
        for table in (docs, none):
            out = stage(spark, table, sf)
            assert out.columns == docs.columns
            assert (out.count() > 0) == (table is docs)
    assert stages.pack_sequences(spark, none, sf).count() == 0


def test_heavy_keys_are_dealt_over_tasks(spark):
    many = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit(-1)).when(F.col("id") < 3005, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    few = stored(many.groupBy("k").agg(F.count("*").alias("n")), "few")
    joined = spread_join(many, few, ["k"])
    assert joined.count() == 8995 and joined.select("x").distinct().count() == 8995 and dict(joined.groupBy("k").agg(F.max("n")).collect())[-1] == 3000
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put small partitions together again
    joined = spread_join(many, few, ["k"])
    most = max(r[0] for r in joined.groupBy(F.spark_partition_id()).agg(F.sum((F.col("k") == -1).cast("int"))).select("sum(CAST((k = -1) AS INT))").collect())
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 2500


def test_settings_stay_and_intermediates_go(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    had = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with intermediates(spark) as keep:
        one = keep(stored(spark.range(5), "one"))
        stored(spark.range(5), "two")
    assert one.count() == 5 and len(set(os.listdir(folder)) - had) == 1
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 500
