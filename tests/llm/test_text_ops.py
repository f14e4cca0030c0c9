"""Divergence, token counts, language identification, toxicity."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import LONG, ROWS, SOLID, docs, edge, empty
from pyspark.sql import functions as F

from gleanery.llm import divergence, langid, queries, token_counts, toxicity
from gleanery.llm.common import words


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    only_spark, only_sql, n = differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)
    assert not only_spark and not only_sql and n > 0


# ---- divergence


def test_divergence_edges(spark):
    rows = divergence.divergence(edge(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].char_jsd is None and by[2].keep and by[3].n_chars == 0 and by[3].keep
    assert by[6].word_jsd is None  # shorter than the guards
    assert divergence.divergence(empty(spark)).count() == 0
    kept = divergence.keep_close(edge(spark))
    assert kept.columns == edge(spark).columns and kept.where("doc_id is null").count() == 1


def test_words_are_hashed_as_they_are_found():
    """hash_texts tells apart what words() tells apart, for any text."""
    from gleanery.llm.common import hash_texts, words

    rng = random.Random(6)
    signs = "abzAZ09_ \n.,-ÄäßéñΣЖж日本ー\u0301\u0939\u093f\U00020001\U0001f600"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", LONG, SOLID, "a" * 1024, "a" * 1025, "word " * 600_000]
    texts = [t.replace("Σ", "") if t else t for t in texts]  # its lower case depends on its place
    name: dict[str, int] = {}
    for t, h in zip(texts, hash_texts(texts)):
        found = words(t)
        assert len(found) == len(h)
        assert all(name.setdefault(w, x) == x for w, x in zip(found, h.tolist()))
    assert len(set(name.values())) == len(name)


def test_jensen_shannon():
    assert divergence.js_distance(np.array([1, 0]), np.array([0, 1])) == 1.0
    assert divergence.js_distance(np.array([2, 2]), np.array([5, 5])) == 0.0


def test_divergence_rejects_foreign_text(spark):
    plain = "the cat sat on the mat and the dog lay by the door of the house in the sun " * 5
    junk = "#### 1234 //// %%%% 9999 &&&& @@@@ 5678 " * 20
    rows = divergence.divergence(docs(spark, [plain] * 30 + [junk])).collect()
    assert [r.keep for r in sorted(rows, key=lambda r: r.doc_id)] == [True] * 30 + [False]


def test_divergence_rejects_gibberish_and_other_languages(spark, sf_dir):
    """No good text goes, most poor ones do, and texts that are few among those of a language that isn't theirs."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    rng = random.Random(4)
    good = [r for r in table.where("quality = 1 and n_chars > 600").collect()]
    other = {"en": "de", "de": "fr", "fr": "es", "es": "en"}
    held = [(10**6 + k, r.text, other[r.lang]) for k, r in enumerate(rng.sample(good, 16))]
    held += [(2 * 10**6 + k, " ".join("".join(rng.choices("aeiourstnl", k=rng.randint(3, 9))) for _ in range(80)), "en") for k in range(30)]
    more = spark.createDataFrame(held, "doc_id bigint, text string, lang string")
    rows = divergence.divergence(table.select("doc_id", "text", "lang").union(more)).join(table.select("doc_id", "quality"), "doc_id", "left").collect()
    judged = [r for r in rows if r.word_jsd is not None or r.char_jsd is not None]
    rejected = lambda rs: sum(not r.keep for r in rs) / len(rs)
    assert rejected([r for r in judged if r.quality == 1]) == 0
    assert rejected([r for r in judged if r.quality == 0]) > 0.7
    assert rejected([r for r in judged if r.doc_id >= 2 * 10**6]) == 1
    assert rejected([r for r in judged if 10**6 <= r.doc_id < 2 * 10**6]) > 0.9


# ---- token counts


def test_token_counts_are_exact(spark):
    enc = token_counts.encoder(f"{token_counts.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    rows = token_counts.token_counts(edge(spark), piece_chars=1000).collect()
    assert len(rows) == len(ROWS)
    want = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, *_ in ROWS}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert token_counts.token_counts(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n\t.,'ß 　日", max_size=300), st.integers(1, 40))
def test_pieces_don_t_change_the_count(text, size):
    enc = token_counts.encoder(f"{token_counts.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    assert "".join(token_counts.safe_pieces(text, size)) == text
    assert token_counts.count_tokens(enc, [text, None, text], size).tolist() == [len(enc.encode_ordinary(text)), 0, len(enc.encode_ordinary(text))]


@pytest.mark.parametrize("unit", ["\u65e5\u672c\u8a9e\u3067\u3059\u3002", "line\n", "aGVsbG8gd29ybGQ9PT0+", "x  y\t", "a.b"])
def test_texts_without_lone_blanks_are_cut(unit):
    enc = token_counts.encoder(f"{token_counts.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    text = unit * 500
    pieces = list(token_counts.safe_pieces(text, 50))
    assert max(map(len, pieces)) < 50 + 2 * len(unit) and "".join(pieces) == text
    assert sum(len(enc.encode_ordinary(p)) for p in pieces) == len(enc.encode_ordinary(text))


# ---- languages


def test_one_label_only_where_it_is_optimal():
    rng = np.random.default_rng(5)
    whole = mixed = 0
    for _ in range(3000):
        n = int(rng.integers(2, 30))
        s = -rng.integers(0, 7, (n, 3)).astype(float)
        s[: n // 2, 0] /= rng.choice([1, 4])
        s[n // 2 :, 1] /= rng.choice([1, 4])
        found = langid.label_words(s, 10.0)
        value = sum(s[a:b, k].sum() for a, b, k in found) - 10.0 * (len(found) - 1)
        path = langid.viterbi(s.tolist(), 10.0)
        best = sum(r[k] for r, k in zip(s.tolist(), path)) - 10.0 * sum(x != y for x, y in itertools.pairwise(path))
        assert abs(value - best) < 1e-9
        whole, mixed = whole + (len(found) == 1), mixed + (len(found) > 1)
    assert whole > 100 and mixed > 100
    # Two spans with a third label, between them in every word, that has the best total.
    s = np.array([[-2.0, 0.0, -6.0]] * 4 + [[-2.0, -6.0, 0.0]] * 4)
    assert langid.label_words(s, 10.0) == [(0, 4, 1), (4, 8, 2)]


def brute_path(s: np.ndarray, penalty: float) -> float:
    n, k = s.shape
    best = -1e18
    for path in itertools.product(range(k), repeat=n):
        v = sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))
        best = max(best, v)
    return best


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s = -rng.exponential(3, (rng.integers(1, 7), 3))
        penalty = float(rng.uniform(0.5, 6))
        spans = langid.label_words(s, penalty)
        assert spans[0][0] == 0 and spans[-1][1] == len(s) and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
        got = sum(s[a:b, k].sum() for a, b, k in spans) - penalty * (len(spans) - 1)
        assert got == pytest.approx(brute_path(s, penalty))


def test_one_language_needs_no_search():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = -rng.exponential(2, (40, 4))
        s[:, 1] += 1
        path = langid.viterbi(s.tolist(), 5.0)
        spans = langid.label_words(s, 5.0)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 5.0 * sum(a != b for a, b in itertools.pairwise(p))
        assert value(path) == pytest.approx(value([k for a, b, k in spans for _ in range(b - a)]))


def test_language_accuracy_held_out(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(table.where("doc_id % 2 = 0"))
    found = langid.identify(table, model).where("doc_id % 2 = 1 and n_words >= 20").join(table.select("doc_id", "lang"), "doc_id")
    hits, n = found.agg(F.count_if(F.col("lang") == F.col("lang_id")), F.count("*")).first()
    assert hits / n > 0.97


def test_mixed_text_gets_spans(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(table)
    pick = {r.lang: " ".join(r.text.split()[:40]) for r in table.where("n_chars > 2000").orderBy("doc_id").collect()}
    text = f"{pick['de']} {pick['es']} Ελληνικά κείμενα εδώ {pick['fr']}"
    (r,) = langid.identify(docs(spark, [text]), model).collect()
    assert [s.lang for s in r.spans] == ["de", "es", "el", "fr"]
    for s, size in zip(r.spans, [len(langid._letters(pick["de"]))]):
        assert abs(s.end - size) <= 3


def test_language_edges(spark):
    model = langid.train(empty(spark))
    assert model.languages == ()
    rows = {r.doc_id: r for r in langid.identify(edge(spark), model).collect()}
    assert rows[1].lang_id == "und-Latn" and rows[2].lang_id is None and rows[3].spans == []
    assert {s.lang for s in rows[9].spans} >= {"und-Cyrl", "el"} or len(rows[9].spans) == 1
    model = langid.train(edge(spark))
    assert langid.identify(edge(spark), model).count() == len(ROWS)
    assert langid.identify(empty(spark), model).count() == 0


def test_scripts():
    assert [langid.script_of(c) for c in "aéЖαא日あ한ก"] == ["Latn", "Latn", "Cyrl", "Grek", "Hebr", "Hani", "Kana", "Hang", "Thai"]


# ---- toxicity


def brute_segments(scores: list[float]) -> set[tuple[int, int]]:
    """By definition: cut out the best segment, then both sides again."""
    out: set[tuple[int, int]] = set()

    def cut(lo: int, hi: int) -> None:
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return
        out.add((best[3], best[4]))
        cut(lo, best[3])
        cut(best[4], hi)

    cut(0, len(scores))
    return out


def test_maximal_segments_by_definition():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 14)
        scores = [rng.choice([3.1, 1.7, 5.3]) + rng.random() if rng.random() < 0.4 else -1.0 for _ in range(n)]
        pos = [i for i, s in enumerate(scores) if s > 0]
        got = {(a, b) for a, b, _ in toxicity.maximal_segments(pos, [scores[i] for i in pos], 1.0)}
        assert got == brute_segments(scores)


def test_lambda_solves_its_equation():
    v, p = np.array([2.0, -0.5]), np.array([0.01, 0.99])
    lam = toxicity.solve_lambda(v, p)
    assert float((p * np.exp(lam * v)).sum()) == pytest.approx(1, abs=1e-6)


def labelled(spark, rng: random.Random, n: int, first: int):
    words = [f"word{i}" for i in range(300)]
    bad = [f"vile{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(first, first + n):
        text = rng.choices(words, k=rng.randint(40, 400))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(3, 8)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        elif rng.random() < 0.03:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    from llm.helpers import SCHEMA

    rng = random.Random(5)
    rows, labels = labelled(spark, rng, 600, 0)
    more, truth = labelled(spark, rng, 400, 600)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, SCHEMA), lab)
    found = {r.doc_id: r for r in toxicity.detect(spark.createDataFrame(more, SCHEMA), model).collect()}
    bad = {i for i, _, t in truth if t}
    assert sum(found[i].toxic for i in bad) / len(bad) >= 0.9
    assert sum(r.toxic for i, r in found.items() if i not in bad) / (400 - len(bad)) <= 0.01
    kept = toxicity.remove_toxic(spark.createDataFrame(more, SCHEMA), model)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in found.items() if not r.toxic}


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(edge(spark), lab)
    rows = toxicity.detect(edge(spark), model).collect()
    assert len(rows) == len(ROWS)
    assert not any(r.toxic for r in rows if r.doc_id in (2, 3, 8))
    none = toxicity.train(empty(spark), lab)
    assert none.empty and toxicity.remove_toxic(edge(spark), none).count() == len(ROWS)
    assert toxicity.detect(empty(spark), model).count() == 0
    one = toxicity.ToxicityModel({"lorem": 3.0}, 0.2, 2.0, 0.5)
    kept = toxicity.remove_toxic(edge(spark), one)
    assert kept.columns == edge(spark).columns and kept.where("doc_id = 4").count() == 0
    long = {r.doc_id: r for r in toxicity.detect(edge(spark), one).collect()}[4]
    assert long.n_tokens == len(LONG.split()) and len(SOLID) == 300_000


# ---- registered queries by brute force


def test_token_counts_of_all_documents(spark, sf_dir):
    enc = token_counts.encoder(f"{token_counts.TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    want = {r.doc_id: (len(enc.encode_ordinary(r.text)), len(r.text.encode()), len(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.n_chars) for r in queries.QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    assert got == want


def test_languages_of_all_documents(spark, sf_dir):
    """Spans of the query against an exhaustive dynamic programme over the same word scores."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(table)
    scorer = langid.Scorer(model, 6.0)
    rows = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        words = langid._letters(text.lower())
        assert rows[i].n_words == len(words)
        if not words:
            assert rows[i].spans == [] and rows[i].lang_id is None
            continue
        scorer.learn(set(words))
        s = scorer.scores(words)
        best = s[0].copy()
        for row in s[1:]:
            best = row + np.maximum(best, (best[None, :] - 10.0 * (1 - np.eye(len(best)))).max(axis=1))
        spans = [(x.start, x.end, model.labels.index(x.lang)) for x in rows[i].spans]
        assert [a for a, *_ in spans] == [0, *(b for _, b, _ in spans[:-1])] and spans[-1][1] == len(words)
        value = sum(s[a:b, k].sum() for a, b, k in spans) - 10.0 * (len(spans) - 1)
        assert abs(value - best.max()) < 1e-6
        size = Counter()
        for a, b, k in spans:
            size[model.labels[k]] += b - a
        top = min(size, key=lambda x: (-size[x], x))
        assert (rows[i].lang_id, rows[i].share) == (top, round(size[top] / len(words), 6))


def test_toxic_documents_by_definition(spark, sf_dir):
    """The query's rows from the model's token scores alone: segments, expectations and p-values by their definitions."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def segments(scores: list[float], a: int, b: int) -> list[tuple[int, int, float]]:
        """The best run of a..b, shortest first, then those on both sides of it."""
        low = low_at = total = 0.0
        best, low_at = (0.0, 0, 0, 0), a
        for j in range(a, b):
            total += scores[j]
            best = max(best, (round(total - low, 9), low_at - j, low_at, j + 1))
            if total <= low:
                low, low_at = total, j + 1
        if best[0] <= 0:
            return []
        return [*segments(scores, a, best[2]), (best[2], best[3], best[0]), *segments(scores, best[3], b)]

    want = {}
    for r in table.collect():
        toks = words(r.text)
        found = segments([model.scores.get(t, 0.0) - model.drift for t in toks], 0, len(toks))
        e = sorted(model.k * len(toks) * math.exp(-model.lam * x) for *_, x in found)
        p = min([1.0, *((2 * v) ** k / math.factorial(k) for k, v in enumerate(e, 1) if k < 100)])
        if p <= 1e-3:
            want[r.doc_id] = [(a, b) for a, b, x in found if model.k * len(toks) * math.exp(-model.lam * x) <= 0.05]
    got = {r.doc_id: [(x.start, x.end) for x in r.segments] for r in queries.QUERIES["op10_toxicity"](spark, sf_dir).collect()}
    assert want and got == want


def test_log_odds_and_extreme_values():
    toxic, other = Counter(bad=30, good=5, rare=1), Counter(bad=3, good=500, fine=400)
    got = toxicity.dirichlet_log_odds(toxic, other, 0.1, 3.0, 8.0)
    n1, n0 = 36, 903
    a, mass = 0.1 * 33, 0.1 * (n1 + n0)
    delta = math.log((30 + a) / (n1 + mass - 30 - a)) - math.log((3 + a) / (n0 + mass - 3 - a))
    assert set(got) == {"bad"} and abs(got["bad"] - delta) < 1e-12
    values, probs = np.array([2.0, -1.0]), np.array([0.2, 0.8])
    lam = toxicity.solve_lambda(values, probs)
    assert abs(float(np.dot(probs, np.exp(lam * values))) - 1) < 1e-6
    # The law itself: maxima of random sequences exceed x about as often as it says.
    rng, n = np.random.default_rng(1), 400
    top = []
    for _ in range(3000):
        s = np.cumsum(rng.choice(values, n, p=probs))
        top.append((s - np.minimum.accumulate(np.minimum(s, 0))).max())
    top = np.array(top)
    u = np.median(top)
    k = ((top >= u).sum() + 1) / (n * np.exp(-lam * np.maximum(top, u))).sum()
    for x in (12, 15):
        said = 1 - math.exp(-k * n * math.exp(-lam * x))
        assert 0.5 < (top >= x).mean() / said < 2
