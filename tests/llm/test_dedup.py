import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup as exact_dedup_module
from veilspark.llm import simhash
from veilspark.llm.exact_dedup import drop_copies, exact_dedup
from veilspark.llm.simhash import components, drop_near_copies, fingerprint, links, simhash_components

from .conftest import ROWS, ascii_lower


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    out = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            out[(i, keep, len(ids), i == keep and left > 0)] += 1
            left -= i == keep
    return out


@pytest.mark.parametrize("digest", [None, lambda _: b"x"], ids=["sha256", "all digests collide"])
def test_exact_matches_brute_force(docs, digest):
    found = exact_dedup(docs, **({"digest": digest} if digest else {})).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute_exact(ROWS)


def test_hot_groups_are_salted_and_merged(spark):
    rows = [(i, "Same Text" if i % 3 else f"other {i % 50}") for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute_exact(rows)


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0 and simhash_components(empty).count() == 0 and drop_near_copies(empty).count() == 0


def test_drop_copies_keeps_one_row_of_each_text_with_its_columns(docs):
    kept = drop_copies(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    assert Counter(ascii_lower(r.text) for r in rows) == Counter({ascii_lower(t): 1 for _, t in ROWS})
    assert {r.doc_id for r in rows if r.text == "one"} == {10}


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", ascii_lower(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(codes):
    """codes: (id, fingerprint) of rows; the least reachable id of each row."""
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i][1] ^ codes[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(codes):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, f"{c:016x}", least.get(find(i))) for i, (k, c) in enumerate(codes))


def test_fingerprints_and_components_match_brute_force(docs):
    codes = [(i, brute_fingerprint(t)) for i, t in ROWS if len(t or "") < 1000] + [(i, fingerprint(t.encode())) for i, t in ROWS if len(t or "") >= 1000]
    found = simhash_components(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == brute_components(codes)


@pytest.mark.parametrize("refine", [4096, 1, 3])
def test_links_connect_all_within_three_bits(spark, refine):
    rng = random.Random(refine)
    codes = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        codes.add(base)
        for _ in range(12):
            flipped = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                flipped ^= 1 << b
            codes.add(flipped)
    codes = sorted(codes)
    frame = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    edges = links(frame, refine=refine)
    pairs = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in edges.collect()]
    assert all(a != b for a, b in pairs)
    roots = {r.node: r.root for r in components(edges).collect()}
    signed = lambda c: int(np.uint64(c).view(np.int64))
    own = {}
    for c in codes:
        own.setdefault(roots.get(signed(c), signed(c)), set()).add(c)
    brute = {}
    for k, _, least in brute_components(list(enumerate(codes))):
        brute.setdefault(least, set()).add(codes[k])
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_near_copies_leave_one_document(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(reversed(base)))]
    assert [r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 3]


def test_near_copies_go_at_four_fifths_of_their_shingles_and_not_below(spark):
    rng = random.Random(5)
    rows, gone = [], set()
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        other = list(words)
        for k in rng.sample(range(10, 110, 10), 2 if i % 2 else 4):  # each word changed takes five shingles of 116 with it
            other[k] = "x"
        a, b = ({tuple(w[j : j + 5]) for j in range(116)} for w in (words, other))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if len(a & b) / len(a | b) >= 0.8:
            gone.add(2 * i + 1)
    assert gone == set(range(3, 120, 4))
    found = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(120)) - gone


def brute_near(rows):
    """rows: (id, text); places of those that stay: of each group linked by shingle similarity, the least id, null last, then the text's digest."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else frozenset() for w in words]
    alike = lambda a, b: (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest())
    best = {}
    for i in range(len(rows)):
        best[group[i]] = min(order(i), best.get(group[i], order(i)))
    return [i for i in range(len(rows)) if order(i) == best[group[i]]]


def test_near_copies_with_repeated_and_null_ids_and_clashing_columns(spark):
    base = [f"w{i}" for i in range(100)]
    near, third = " ".join([*base[:-1], "other"]), " ".join([*base[:-1], "third"])
    rows = [(7, " ".join(base)), (7, near), (7, "all alone here"), (8, "all alone here by itself now and then"), (None, third), (None, "a row without an id"), (9, None), (10, " "), (11, ""), (6, "one"), (12, "ONE")]
    extra = ["__gone", "__name", "name", "node", "root", "keys", "group", "fp"]
    frame = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    found = drop_near_copies(frame)
    assert found.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(rows[i] for i in brute_near(rows))
    assert (8, "all alone here by itself now and then") in {(r.doc_id, r.text) for r in found.collect()}


def test_the_fingerprint_index_proposes_close_sets(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "y")]
    named = simhash._named(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    nodes = {r.doc_id: r.node for r in simhash._signatures(named).collect()}
    unbanded = simhash._signatures(named).withColumn("keys", F.array(F.col("node")))  # no two sets share a band
    assert {r.node for r in simhash._proposed(unbanded).collect()} == {nodes[1], nodes[2]}


def test_the_proof_of_one_content_stands_in_every_plan(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    hot = exact_dedup_module.hot_digests(rows, digest=lambda _: b"x")
    won = exact_dedup_module.winners(rows, hot, digest=lambda _: b"x")
    assert "raise_error" in won.select("digest", "other", "keep_id")._jdf.queryExecution().optimizedPlan().toString()
