"""Decontamination, near-dedup, sharding, reputation, mixing, WARC."""

from __future__ import annotations

import gzip
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.helpers import ROWS, SCHEMA, docs, edge, empty
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, mixing, near_dedup, queries, sharding, url_reputation, warc
from gleanery.llm.common import WordHash, hash_words, materialise, shared_dir, shingle_hashes, unused, words

ITEMS = "item_id bigint, text string"


def vocabulary(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)]


# ---- decontamination


def brute_covered(text: list[str], item: list[str], min_run: int = 10, min_identity: float = 0.7, penalty: float = 2.0) -> set[int]:
    """The operator's own rule on words: positions of the item in runs on diagonals that a mask hits."""
    got: set[int] = set()
    masks = [[k for k, x in enumerate(m) if x == "1"] for m in decontaminate.MASKS]
    for d in range(-len(item), len(text)):
        both = [(p, p + d) for p in range(len(item)) if 0 <= p + d < len(text)]
        same = [item[p] == text[q] for p, q in both]
        if not any(all(same[k + x] for x in m) for m in masks for k in range(len(same) - decontaminate.SPAN + 1)):
            continue

        def maximal(a: int, b: int) -> list[tuple[int, int]]:
            """By definition: the best run, shortest first, then those left and right of it."""
            best = max(
                ((sum(1 if x else -penalty for x in same[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,)
            )
            if best[0] <= 0:
                return []
            return [*maximal(a, best[3]), (best[3], best[4]), *maximal(best[4], b)]

        for a, b in maximal(0, len(same)):
            if b - a >= min_run and sum(same[a:b]) >= min_identity * (b - a):
                got |= {both[k][0] for k in range(a, b) if same[k]}
    return got


def test_contamination_by_brute_force(spark, sf_dir):
    """Every pair that shares three words in a row with an item, judged by the rule itself."""
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: words(r.text) for r in b.collect()}
    index = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 2):
            index[tuple(w[k : k + 3])].add(i)
    want = {}
    for r in d.collect():
        w = words(r.text)
        near = Counter(i for k in range(len(w) - 2) for i in index.get(tuple(w[k : k + 3]), ()))
        for i in near:
            n = len(brute_covered(w, items[i]))
            if n >= 0.5 * len(items[i]) or n >= 50:
                want[r.doc_id, i] = (len(items[i]), n)
    got = {(r.doc_id, r.item_id): (r.item_tokens, r.covered) for r in decontaminate.contamination(d, b).collect()}
    assert want and got == want


def test_every_run_of_a_diagonal_counts(spark):
    v = vocabulary(random.Random(31), 500)
    item = v[:27]
    text = v[100:140] + item[:12] + v[200:205] + item[17:] + v[150:190]
    (row,) = decontaminate.contamination(docs(spark, [" ".join(text)]), spark.createDataFrame([(5, " ".join(item))], ITEMS)).collect()
    assert (row.item_tokens, row.covered) == (27, 22)
    assert decontaminate.maximal_runs(np.array([1] * 12 + [0] * 5 + [1] * 10, bool), 2.0) == [(0, 12), (17, 27)]


def test_texts_of_one_item_id(spark):
    v = vocabulary(random.Random(32), 500)
    one, other = " ".join(v[:30]), " ".join(v[50:90])
    items = spark.createDataFrame([(1, one), (1, other), (2, one)], ITEMS)
    texts = spark.createDataFrame([("a", "so " + one), ("b", other + " it"), (None, one), ("c", " ".join(v[200:300]))], "doc_id string, text string")
    got = {(r.doc_id, r.item_id, r.item_tokens) for r in decontaminate.contamination(texts, items).collect()}
    assert got == {("a", 1, 30), ("a", 2, 30), ("b", 1, 40)}
    # Rows are judged by their text: the null id goes, too.
    assert [r.doc_id for r in decontaminate.remove_contaminated(texts, items).collect()] == ["c"]


def test_substitutions_are_tolerated(spark):
    rng = random.Random(3)
    v = vocabulary(rng, 3000)
    items, texts, planted = [], [], set()
    for i in range(40):
        item = rng.sample(v, 30)
        items.append((i, " ".join(item)))
        copy = list(item)
        for at in rng.sample(range(2, 28), 4):  # four words replaced
            copy[at] = rng.choice(v)
        texts.append(" ".join(rng.choices(v, k=80) + copy + rng.choices(v, k=80)))
        planted.add((i, i))
    texts += [" ".join(rng.choices(v, k=300)) for _ in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs(spark, texts), spark.createDataFrame(items, ITEMS)).collect()}
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_contamination_edges(spark):
    items = spark.createDataFrame([(1, ROWS[0][1]), (1, ROWS[0][1]), (None, "x"), (2, None), (3, ""), (4, "short")], ITEMS).withColumns(
        {c: F.lit(1) for c in ("hash", "tokens", "segment")}
    )
    rows = decontaminate.contamination(edge(spark), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1)} and len(rows) == 1
    kept = decontaminate.remove_contaminated(edge(spark), items)
    assert kept.columns == edge(spark).columns and kept.count() == len(ROWS) - 2
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert decontaminate.contamination(edge(spark), spark.createDataFrame([], ITEMS)).count() == 0


# ---- near duplicates


def brute_pairs(rows: list[tuple[int, str]]) -> tuple[list[tuple[int, int, int, int, float]], dict[int, int]]:
    memo, sets = WordHash(), {}
    for i, t in rows:
        w = words(t)
        if w:
            sets[i] = set(np.unique(shingle_hashes(hash_words(w, memo), 5)).tolist())
    where, common = defaultdict(list), Counter()
    for i, s in sorted(sets.items()):
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    size = {i: len(s) for i, s in sets.items()}
    return [(a, b, min(size[a], size[b]), max(size[a], size[b]), c / min(size[a], size[b])) for (a, b), c in common.items()], size


def lost(found) -> dict:
    return {r.doc_id: r.kept_doc_id for r in found.collect() if r.doc_id != r.kept_doc_id}


def test_near_duplicates_by_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs, size = brute_pairs([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    copies = [(a, b) for a, b, m, n, c in pairs if c >= 0.6 and n <= 1.6 * m]
    inside = [(a, b) for a, b, m, n, c in pairs if m >= 16 and c >= 0.8 and n > 1.6 * m]
    rows = near_dedup.near_duplicates(table).collect()
    group = {r.doc_id: r.kept_doc_id for r in rows}
    assert len(group) == len(rows)
    assert copies and sum(a in group and group[a] == group.get(b) for a, b in copies) >= 0.97 * len(copies)
    assert all(group.get(min(a, b, key=size.get), -1) != min(a, b, key=size.get) for a, b in inside)
    assert set(group) == {x for a, b in copies + inside for x in (a, b)} & set(group)  # nothing clean
    assert set(group.values()) <= {i for i, k in group.items() if i == k}
    most = {x: max(c for a, b, _, _, c in pairs if x in (a, b)) for x in group}
    assert all(r.links >= 1 and abs(r.containment - most[r.doc_id]) < 0.4 for r in rows)


def test_hits_leave_a_bucket_in_bounded_parts():
    """However many pairs the holders of a shingle make, no part holds all of them; the sums are the same."""
    n = 1500
    ids, rows = np.arange(n, dtype=np.int64) * 3, np.arange(n)
    parts = list(near_dedup.counted(ids, near_dedup.spans(np.tile(rows, 2), np.tile(rows + 1, 2), np.full(2 * n, n))))
    assert len(parts) > 1 and max(len(a) for a, _, _ in parts) <= 4 * near_dedup.PORTION
    hits = {}
    for part in parts:
        for a, b, k in zip(*(x.tolist() for x in part)):
            hits[a, b] = hits.get((a, b), 0) + k
    assert len(hits) == n * (n - 1) // 2 and set(hits.values()) == {2}


def test_likeliest_pairs_first_lose_nothing(spark, monkeypatch):
    """A group that grows by edits of edits, and strangers with its passage: the same classes whether pairs are taken at once or in rounds."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    held = [[word() for _ in range(120)]]
    for _ in range(60):
        t = list(rnd.choice(held))
        for k in rnd.sample(range(len(t)), 5):
            t[k] = word()
        held.append(t)
    held += [held[0][:30] + [word() for _ in range(60)] for _ in range(12)]
    table = docs(spark, [" ".join(t) for t in held])
    checked, overlaps = [], near_dedup.overlaps
    monkeypatch.setattr(near_dedup, "overlaps", lambda d, pairs: checked.append(pairs.count()) or overlaps(d, pairs))
    found = lambda: {(r.doc_id, r.kept_doc_id, r.links) for r in near_dedup.near_duplicates(table).collect()}
    at_once = found()
    checked.clear()
    for name, value in (("HELD_AT_ONCE", 0), ("CHECKED_AT_ONCE", 0), ("ROUNDS", (1, 4, None))):
        monkeypatch.setattr(near_dedup, name, value)
    assert found() == at_once and len(at_once) > 50
    assert len(checked) > 3


def test_a_large_group_and_edited_copies(spark):
    rng = random.Random(8)
    v = vocabulary(rng, 4000)
    base, texts = rng.choices(v, k=200), []
    for _ in range(400):
        t = list(base)
        for at in rng.sample(range(200), 4):
            t[at] = rng.choice(v)
        texts.append(" ".join(t))
    clean = [" ".join(rng.choices(v, k=200)) for _ in range(100)]
    kept = near_dedup.keep_one(docs(spark, texts + clean))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len([i for i in ids if i < 400]) == 1 and len([i for i in ids if i >= 400]) == 100


def test_every_copy_is_found(spark):
    """Pairs just at the threshold, and pairs whose common shingles all have 42 holders of sizes between theirs."""
    rng = random.Random(21)
    v = vocabulary(rng, 9000)
    texts, want = [], {}
    for _ in range(300):
        small = rng.choices(v, k=104)
        want[len(texts)] = len(texts) + 1
        texts += [small, small[20:84] + rng.choices(v, k=95)]
    for _ in range(6):
        one, two = rng.choices(v, k=60), rng.choices(v, k=60)
        want[len(texts)] = len(texts) + 1
        texts += [one + two + rng.choices(v, k=60), one + two + rng.choices(v, k=140)]
        texts += [part + rng.choices(v, k=rng.randint(130, 190)) for part in (one, two) for _ in range(40)]
    rows = near_dedup.near_duplicates(docs(spark, [" ".join(t) for t in texts])).collect()
    assert {r.doc_id: r.kept_doc_id for r in rows} == want | {i: i for i in want.values()}
    assert {r.links for r in rows} == {1}


def test_shingles_are_counted_over_all_documents(spark):
    """6,000 documents; a sample of about 4,000 would leave some out."""
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k % 3}" for k in range(6000)]
    got = near_dedup.shingle_counts(near_dedup.described(docs(spark, texts).select(F.col("doc_id").alias("id"), "text")))
    sets = np.concatenate(near_dedup.shingle_sets(texts, near_dedup.WIDTH))
    assert got.sum() == len(sets) == 12000
    assert (got == np.bincount(near_dedup.slots(sets), minlength=len(got))).all()


def test_texts_sharing_few_phrases_are_not_sent(spark, monkeypatch):
    """60 texts, every two of which share 4 rare shingles, and 10 pairs of copies: the copies alone are checked."""
    rng = random.Random(33)
    v = vocabulary(rng, 9000)
    texts = [rng.choices(v, k=400) for _ in range(60)]
    for a in range(60):
        for b in range(a):
            if (a + b) % 7 == 0:
                phrase = rng.choices(v, k=8)
                texts[a], texts[b] = texts[a] + phrase, texts[b] + phrase
    texts += [t[:300] + rng.choices(v, k=60) for t in texts[:10]]
    checked, sent = [], []
    overlaps, among = near_dedup.overlaps, near_dedup.among
    monkeypatch.setattr(near_dedup, "overlaps", lambda d, p: checked.extend((r.a, r.b) for r in p.collect()) or overlaps(d, p))
    monkeypatch.setattr(near_dedup, "among", lambda d, i: sent.append(among(d, i)) or sent[-1])
    gone = lost(near_dedup.near_duplicates(docs(spark, [" ".join(t) for t in texts])))
    assert {frozenset(x) for x in gone.items()} == {frozenset((k, 60 + k)) for k in range(10)}
    assert {frozenset(x) for x in checked} == {frozenset((k, 60 + k)) for k in range(10)} and len(checked) == 10
    assert {r.id for r in sent[0].select("id").collect()} == {*range(10), *range(60, 70)}


def test_hits_of_rare_and_frequent_shingles_add_up(spark):
    """Pairs at the threshold whose rarest common shingles are theirs alone in part, and in part of 42 others, larger ones among them."""
    rng = random.Random(34)
    v = vocabulary(rng, 9000)
    texts, want = [], {}
    for k in range(8):
        one, two = rng.choices(v, k=40), rng.choices(v, k=64 + k % 4)
        small = int((len(one + two) - 4) / 0.6) + 4 - k % 3
        want[len(texts)] = len(texts) + 1
        texts += [one + two + rng.choices(v, k=small - len(one + two)), one + two + rng.choices(v, k=int(1.3 * small) - len(one + two))]
        texts += [part + rng.choices(v, k=rng.choice([130, 170, 200])) for part in (one, two) for _ in range(42)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    pairs, size = brute_pairs(rows)
    copies = {(a, b) for a, b, m, n, c in pairs if c >= 0.6 and n <= 1.6 * m}
    assert copies == set(want.items())
    assert lost(near_dedup.near_duplicates(docs(spark, [t for _, t in rows]))) == want


def test_copies_among_holders_of_a_passage(spark):
    """Each of 60 pairs shares its buckets with 1,500 larger and equal texts that hold the same passage."""
    rng = random.Random(14)
    v = vocabulary(rng, 9000)
    passage = rng.choices(v, k=60)
    texts = []
    for k in range(60):
        t = passage + rng.choices(v, k=120 + k)
        texts += [t, t[:150] + rng.choices(v, k=20) + t[150:]]
    texts += [passage + rng.choices(v, k=rng.choice([130, 160, 200, 260])) for _ in range(1500)]
    gone = lost(near_dedup.near_duplicates(docs(spark, [" ".join(t) for t in texts])))
    assert set(gone) <= set(range(120))
    assert sum(gone.get(2 * k) == 2 * k + 1 for k in range(60)) >= 57


@pytest.mark.parametrize("ratio", [2, 3.5, 5, 12])
def test_containers_of_any_ratio(spark, ratio):
    """30 texts wholly inside larger ones, and 10 of which a tenth is not; a giant quotes them all."""
    rng = random.Random(int(ratio * 10))
    v = vocabulary(rng, 9000)
    texts, giant = [], []
    for k in range(40):
        n = rng.choice([22, 40, 90, 200])
        whole = rng.choices(v, k=int((n - 4) * ratio) + 4)
        short = list(whole[3 : 3 + n])
        giant += short[: n // 3]
        if k >= 30 and n > 40:
            short[n // 2] = "edited"
        texts += [short, whole]
    texts.append(giant)
    gone = lost(near_dedup.near_duplicates(docs(spark, [" ".join(t) for t in texts])))
    assert gone == {2 * k: 2 * k + 1 for k in range(40)}


def test_a_short_text_in_one_of_any_size(spark):
    rng = random.Random(13)
    v = vocabulary(rng, 9000)
    texts, want = [], {}
    for n in (60, 150, 400, 1000, 3000):
        whole = rng.choices(v, k=n * 5)
        for size, edits in ((25, 0), (n, 0), (n, n // 60)):
            short = whole[n : n + size]
            for k in range(edits):
                short[k * 40] = "edited"
            want[len(texts)] = n
            texts.append(" ".join(short))
        texts.append(" ".join(whole))
    gone = lost(near_dedup.near_duplicates(docs(spark, texts)))
    assert gone == {i: i // 4 * 4 + 3 for i in want}


def test_copies_of_short_texts(spark):
    rng = random.Random(15)
    v = vocabulary(rng, 3000)
    texts, want = [], {}
    for n in range(7, 26):
        t = rng.sample(v, n)
        texts += [" ".join(t), " ".join(t[:-1] + ["other"]), " ".join(rng.sample(v, n))]
        want[len(texts) - 2] = len(texts) - 3
    texts += ["only four words here", "Only four, words HERE!", "only four words there"]
    want[len(texts) - 2] = len(texts) - 3
    assert lost(near_dedup.near_duplicates(docs(spark, texts))) == want


def test_near_duplicate_edges(spark):
    rows = [tuple(r) for r in near_dedup.near_duplicates(edge(spark)).collect()]
    # Ids are repeated and null, so rows are numbered; a repeated row is a copy.
    assert sorted((r[0], r[1]) for r in rows) == [(1, 1), (1, 1), (6, 6), (7, 6)]
    assert {r[2:] for r in rows} == {(1, 1.0)}
    kept = near_dedup.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns and kept.count() == len(ROWS) - 2
    assert Counter(r.doc_id for r in kept.collect())[1] == 1
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    strings = edge(spark).withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    assert {(r.doc_id, r.kept_doc_id) for r in near_dedup.near_duplicates(strings).collect()} == {("x1", "x1"), ("x6", "x6"), ("x7", "x6")}
    nulls = edge(spark).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert near_dedup.keep_one(nulls).count() == len(ROWS) - 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


def test_thresholds():
    assert near_dedup.jaccard_threshold(1.0, 1.0) == 1.0
    for t in (0.3, 0.5, 0.9):
        rows, bands = near_dedup.tune(t, 0.95, 192)
        assert 1 - (1 - t**rows) ** bands >= 0.95 and rows * bands <= 192


# ---- sharding


def test_shuffle_keeps_rows_and_is_deterministic(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.shard(table, bucket_bytes=100_000)
    again = sharding.shard(table.repartition(7), bucket_bytes=100_000)
    key = lambda df: sorted((r.shard, r.position, r.doc_id) for r in df.collect())
    assert key(got) == key(again)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in table.collect())
    for n, lo, hi, parts in got.groupBy("shard").agg(F.count("*"), F.min("position"), F.max("position"), F.count_distinct("position")).drop("shard").collect():
        assert (lo, hi, parts) == (0, n - 1, n)


def brute_shards(table, n: int, seed: int = 42) -> dict[int, tuple[int, int]]:
    """doc_id -> (shard, position) of a table without repeated rows, row by row in plain Python."""
    flat = [table[c] for c in table.columns]
    marks = table.select("doc_id", F.xxhash64(*flat, F.lit(seed)).alias("m"), F.hash(*flat).alias("s")).collect()
    wide, out = (1 << 64) - 1, {}

    def mixed(x: int) -> int:
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & wide
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & wide
        return x ^ x >> 31

    buckets = defaultdict(list)
    for r in marks:
        key = mixed(mixed((r.m + 2 * seed + 1) & wide))
        buckets[key % n].append((key - (key >> 63 << 64), r.s, r.doc_id))
    for b, rows in buckets.items():
        order = [i for *_, i in sorted(rows)]
        draw = random.Random(seed * 1_000_003 + b).random
        for i in range(len(order) - 1, 0, -1):
            j = int(draw() * (i + 1))
            order[i], order[j] = order[j], order[i]
        out |= {i: (b, k) for k, i in enumerate(order)}
    return out


def test_shards_by_brute_force(spark, sf_dir):
    """The registered query, which writes its shards and reads them back."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.QUERIES["op5_sharding"](spark, sf_dir)
    assert {r.doc_id: (r.shard, r.position) for r in got.collect()} == brute_shards(table, sharding.bucket_count(table, 64 << 20))
    small = sharding.shard(table, bucket_bytes=50_000)
    n = sharding.bucket_count(table, 50_000)
    assert n > 5 and {r.doc_id: (r.shard, r.position) for r in small.collect()} == brute_shards(table, n)


def test_equal_rows_are_spread(spark):
    same = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("one text for all " * 10).alias("text")).repartition(6)
    out = sharding.shard(same, bucket_bytes=20_000)
    n = sharding.bucket_count(same, 20_000)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    mean = 5000 / n
    assert n > 40 and len(sizes) == n and sum(sizes) == 5000
    assert max(sizes) < mean + 6 * mean**0.5 and min(sizes) > mean - 6 * mean**0.5
    marks = np.array([7, 7, 3, 7, 3], np.int64)
    seen = {7: 2}
    assert sharding.occurrences(marks, seen).tolist() == [2, 3, 0, 4, 1] and seen == {7: 5, 3: 2}


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s)) for s in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())


def test_sharding_edges(spark, tmp_path):
    out = sharding.shard(edge(spark))
    assert out.columns == [*edge(spark).columns, "_shard", "_position"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and Counter(r.text for r in rows) == Counter(t for _, t, *_ in ROWS)
    assert sharding.shard(empty(spark)).count() == 0
    assert sharding.write_shards(empty(spark), str(tmp_path / "none")).count() == 0
    clash = edge(spark)  # has columns named shard and position
    back = sharding.write_shards(clash, str(tmp_path / "s"), bucket_bytes=100_000)
    assert back.columns == [*clash.columns, "_shard", "_position"] and back.count() == len(ROWS)
    folders = {f.name for f in (tmp_path / "s").iterdir() if f.is_dir()}
    assert folders == {f"_shard={r._shard}" for r in back.collect()} and len(folders) > 1
    assert {r.shard for r in back.collect()} == {"clash shard"}
    for folder in folders:  # one file a shard, in order of position
        (file,) = (tmp_path / "s" / folder).glob("*.parquet")
        at = [r[0] for r in spark.read.parquet(str(file)).select("_position").collect()]
        assert at == list(range(len(at)))
    nested = edge(spark, clashes=False).withColumns({"a": F.array("text", "text"), "m": F.create_map(F.lit("k"), "text"), "s": F.struct("text")})
    assert sharding.shard(nested, bucket_bytes=100_000).count() == len(ROWS)
    assert sharding.bucket_count(nested, 1000) > 3 * sharding.bucket_count(edge(spark, clashes=False), 1000)


# ---- reputation


def test_reputation_shrinks_by_level(spark):
    urls = [f"http://good{i}.example.com/p" for i in range(20)] + ["http://bad.evil.org/x"] * 10 + ["http://new.evil.org/y", "http://fresh.example.com/", None, "nothing", "HTTPS://u@Good1.Example.com:80/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({c: F.lit(0) for c in ("host", "bad", "a", "s")})
    lab = spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)] + [(5, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = {r.page_id: r for r in url_reputation.judge_pages(pages, lab).collect()}
    assert len(rows) == len(urls)
    assert rows[30].mean > rows[31].mean  # an unlabelled host takes after its domain
    assert rows[0].mean < 0.35 < rows[20].mean and rows[20].upper > rows[20].mean
    assert rows[32].host is None and not rows[33].keep and rows[34].host == "good1.example.com"
    none = lab.where("false")
    assert url_reputation.judge_pages(pages, none).count() == len(urls)
    assert url_reputation.judge_pages(pages.where("false"), lab).count() == 0
    assert url_reputation.filter_pages(pages, lab).columns == pages.columns


def test_hosts_suffixes_and_domains(spark):
    want = {
        "http://[2001:db8::1]:80/x": ("[2001:db8::1]", "[2001:db8::1]", "(address)"),
        "http://1.2.3.10/": ("1.2.3.10", "1.2.3.10", "(address)"),
        "https://a.b.com.sg/": ("a.b.com.sg", "b.com.sg", "com.sg"),
        "https://me.github.io": ("me.github.io", "me.github.io", "github.io"),
        "ftp://u:p@X.Y.Example.co.uk.:21/": ("x.y.example.co.uk", "example.co.uk", "co.uk"),
        "http://localhost/": ("localhost", "localhost", "localhost"),
        "http://h.org/" + "q" * 200_000: ("h.org", "h.org", "org"),
        "http://": (None, None, None),
        "": (None, None, None),
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string").withColumn("host", url_reputation.host_of(F.col("url")))
    got = {r[0]: tuple(r[1:]) for r in rows.select("url", "host", url_reputation.domain_of(F.col("host")), url_reputation.suffix_of(F.col("host"))).collect()}
    assert got == want


def test_reputation_of_repeated_pages_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1")] * 3 + [(2, "http://b.org/1"), (None, "http://b.org/2")], "page_id bigint, url string")
    lab = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = url_reputation.judge_pages(pages, lab).collect()
    assert Counter((r.page_id, r.host, r.labelled, r.bad) for r in rows) == Counter({(1, "a.org", 3, 3): 3, (2, "b.org", 1, 0): 1, (None, "b.org", 1, 0): 1})
    plan = url_reputation.judge_pages(pages, lab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 15


# ---- mixing


def brute_mix(rows: list[tuple], weights: dict | None, seed: int = 7) -> Counter:
    """rows (id, source, size[, weight]): copies of each id."""
    import hashlib

    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    rows = [(r + (1.0,))[:4] for r in rows]
    total: dict = defaultdict(float)
    for _, s, n, w in rows:
        total[s] += max(n or 0, 0) * w
    goal = {s: ((weights or {}).get(s, 0.0 if weights else 1.0) if t > 0 else 0.0) for s, t in total.items()}
    everything, out = float(sum(total.values())), Counter()
    for s in total:
        if not goal[s]:
            continue
        rate = int(np.floor(goal[s] / sum(goal.values()) * everything / total[s] * mixing.UNIT + 0.5))
        at = int(md5(f"{seed}:{'<null>' if s is None else s}")[:5], 16) << 10
        for i, _, _, w in sorted((r for r in rows if r[1] == s), key=lambda r: (int(md5(r[0])[:15], 16), r[0])):
            step = rate * int(w * 1024 + 0.5)
            out[i] += ((at + step) >> 30) - (at >> 30)
            at += step
    return +out


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_mixing_by_brute_force(spark, weights):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(1, 500)) for i in range(3000)]
    df = spark.createDataFrame([(i, "t", "en", s, n) for i, s, n in rows], SCHEMA)
    got = mixing.mix(df, weights=weights)
    assert Counter(r.doc_id for r in got.collect()) == brute_mix(rows, weights)
    assert got.where("copy < 1").count() == 0


@pytest.mark.parametrize("block_rows", [7, 100, 1 << 20])
def test_blocks_weights_and_text_ids(spark, block_rows):
    rng = random.Random(10)
    rows = [(f"id-{i}", rng.choice(["a", "a", "a", "b", None]), rng.randint(1, 500), rng.choice([0.25, 1.0, 3.5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id string, source string, n_chars int, w double")
    got = mixing.mix(df, weight_col="w", weights={"a": 1.0, "b": 2.0}, block_rows=block_rows)
    assert Counter(r.doc_id for r in got.collect()) == brute_mix(rows, {"a": 1.0, "b": 2.0})


def test_mixing_edges(spark):
    out = mixing.mix(edge(spark))
    assert out.columns == [*edge(spark).columns, "_copy"]
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(edge(spark), copy_col=None).columns == edge(spark).columns
    even = mixing.mix(edge(spark, clashes=False), size_col=None, weights={"a": 1.0, "b": 1.0, "c": 1.0})
    n = Counter(r.source for r in even.collect())
    assert n[None] == 0 and all(abs(n[s] - len(ROWS) / 3) <= 1 for s in "abc")
    nulls = spark.range(1000).select(F.lit(None).cast("string").alias("doc_id"), F.lit("s").alias("source"))
    assert mixing.mix(nulls, size_col=None, total=2500).count() in (2499, 2500, 2501)
    spread = nulls.select(mixing.place(F.col("doc_id")).alias("at")).distinct()
    assert spread.count() == 1000  # no block holds all null ids


# ---- WARC


def monolith(records: list[tuple[str, bytes]]) -> bytes:
    raw = b"".join(warc.record_header("resource", f"urn:row:{i}", f"http://h/{i}", len(b), "text/html") + b + warc.END for i, b in records)
    return gzip.compress(raw)


def normal(data: bytes) -> tuple[list[tuple], bytes]:
    out = io.BytesIO()
    return list(warc.rewrite(warc.inflate(io.BytesIO(data).read), out.write, 6)), out.getvalue()


def test_every_record_is_a_member():
    rng = random.Random(2)
    blocks = [(str(i), rng.randbytes(rng.choice([0, 1, 50, 5000, 3 << 20]))) for i in range(12)] + [("x", b"\r\n\r\nWARC/1.0\r\n\r\n")]
    index, out = normal(monolith(blocks))
    assert [r[4] for r in index] == [f"urn:row:{i}" for i, _ in blocks] and all(r[7] and r[8] is None for r in index)
    for (_, start, length, *_), (_, block) in zip(index, blocks):
        raw = gzip.decompress(out[start : start + length])
        assert raw.split(warc.END, 1)[1] == block + warc.END
    assert index[-1][1] + index[-1][2] == len(out)
    again, same = normal(out)  # many members in: the same out
    assert same == out and again == index


def test_damaged_streams():
    data = monolith([("0", b"a" * 1000), ("1", random.Random(1).randbytes(90_000))])
    index, out = normal(data[:-30_000])
    assert index[0][7] and not index[1][7] and 0 < index[1][6] < 90_000 and "EOF" in index[-1][8]
    gzip.decompress(out)
    assert normal(b"") == ([], b"")
    assert normal(b"no gzip")[0][-1][8]
    assert normal(gzip.compress(b"not a warc"))[0][-1][8] == "no record header"
    assert zlib.decompress(data, 31).startswith(b"WARC/1.0")


def test_what_stands_between_records_is_passed_over():
    record = lambda i, b: warc.record_header("resource", f"urn:row:{i}", None, len(b), "text/html") + b + warc.END
    junk = b"junk without an end of line"
    raw = record(0, b"a") + junk + record(1, b"b") + b"WARC/1.0\r\nContent-Length: none\r\n\r\n" + record(2, b"c") + b"\r\n" * 5
    index, out = normal(gzip.compress(raw))
    good = [r for r in index if r[8] is None]
    assert [r[4] for r in good] == ["urn:row:0", "urn:row:1", "urn:row:2"] and all(r[7] for r in good)
    assert [r[0] for r in index] == list(range(len(index))) and f"{len(junk)} bytes of no record" in [r[8] for r in index]
    for _, start, length, *_ in good:
        gzip.decompress(out[start : start + length])
    long = warc.record_header("resource", "urn:row:9", "http://h/" + "u" * (3 << 20), 1, "text/html") + b"z" + warc.END
    index, _ = normal(gzip.compress(b"x" * (5 << 20) + long + record(1, b"b")))
    assert [r[4] for r in index] == [None, "urn:row:9", "urn:row:1"]


def test_warc_round_trip_and_edges(spark, sf_dir):
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<p>x</p>"), (1, "http://a/1", "<p>x</p>"), (None, None, None), (2, "http://a/\n2", ""), (3, "http://ü/3", "é\r\n\r\n" * 400_000)],
        "page_id bigint, url string, html string",
    ).withColumns({c: F.lit("clash") for c in ("id", "body", "file", "offset", "number")})
    rows = warc.pages_through_warc(pages, shared_dir(spark, "warc"), materialise=materialise).collect()
    assert Counter((r.page_id, r.url, r.n_bytes) for r in rows) == Counter(
        [(1, "http://a/1", 8), (1, "http://a/1", 8), (None, None, 0), (2, "http://a/%0A2", 0), (3, "http://ü/3", 2_400_000)]
    )
    assert warc.pages_through_warc(pages.where("false"), shared_dir(spark, "warc"), materialise=materialise).count() == 0


def test_sidecar_names_the_offsets(spark, sf_dir):
    folder = shared_dir(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    materialise(warc.export_monolithic(pages, f"{folder}/in", file_bytes=50_000), "files")
    index = materialise(warc.normalise(spark, f"{folder}/in", f"{folder}/out"), "index").collect()
    path = index[0].file
    lines = open(path.removeprefix("file://") + ".idx").read().splitlines()
    mine = sorted((r for r in index if r.file == path), key=lambda r: r.number)
    assert [tuple(map(int, x.split()[:3])) for x in lines] == [(r.number, r.offset, r.length) for r in mine]
    assert len({r.file for r in index}) > 1


def test_names_stay_apart():
    assert unused(["Copy", "_copy"], "copy", "copy") == ["__copy", "___copy"]
