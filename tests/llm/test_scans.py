import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm.eliasfano import EliasFano
from veilspark.llm.ngram import DISCOUNT, STEPS, Text, lm_score, train
from veilspark.llm.secrets import Span, base_spans, redact, redact_secrets, scan_secrets, scan_text, spans_text

from .conftest import ROWS, ascii_lower

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY = "AK" + "IA" + "ABCDEFGH12345678"


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [Span(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["pass" + "word", "API_KEY", "token", "ſecret", "toKen", "=", ": ", '"', "'", " ", "abcdef0123456789", "abcdefgh", "XYZ", KEY, "AK" + "IA", "é", "\U0001f600", "\n"]), max_size=14).map("".join))
def test_base_spans_match_the_patterns(text):
    assert base_spans(text) == brute_spans(text)


def test_weak_parts_need_their_complement():
    secret, ident, point = "Zx9" + "k" * 20 + "7Q", "client_id=svc-reader", "https://api.example.invalid/v1"
    kinds = lambda text: [s.kind for s in scan_text(text)]
    assert kinds(secret) == kinds(ident) == kinds(point) == kinds(f"{ident} at {point}") == []
    assert kinds(f"{ident} {secret}") == ["weak_id", "weak_secret"]
    assert kinds(f"{secret} for {point}") == ["weak_secret", "weak_endpoint"]
    assert kinds(f"{KEY} {secret}") == ["access", "weak_secret"]
    assert kinds(f"{ident}\n\n{secret}") == []  # scopes end at blank lines
    assert kinds(f"{ident} {'word ' * 60}{secret}") == []  # and parts lie near each other
    assert kinds(f"{point} 0123456789abcdef0123") == ["weak_endpoint", "hex"]


def test_long_values_are_whole():
    for n in (20, 128, 129, 300, 100_000):
        secret = "Zx9" + "k" * (n - 3)
        assert redact(f"{KEY} {secret}.", scan_text(f"{KEY} {secret}.")) == "[SECRET:access] [SECRET:weak_secret]."
        text = f"client_id={secret} password=abcdefghijkl"
        assert redact(text, scan_text(text)) == "[SECRET:weak_id] [SECRET:assign]"
    assert scan_text(f"{KEY} {'k' * 300} {'-7' * 150}") == [Span("access", 0, 20)]


def test_many_candidates_stay_cheap():
    text = "client_id=a1b2c3 " * 20_000
    assert scan_text(text) == [] and len(scan_text(text + " Zx9" + "k" * 20 + "7Q")) > 1


def test_scan_rows(docs, empty):
    found = scan_secrets(docs).collect()
    assert len(found) == len(ROWS) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in found)
    assert scan_secrets(empty).count() == 0 and redact_secrets(empty).count() == 0


def test_redaction_takes_overlaps_together_and_keeps_the_rest(spark):
    text = f"é token = abcdef0123456789abcdef and {KEY}."
    rows = [(1, text, 3, None), (2, "clean", 5, 1), (3, None, None, 2)]
    found = redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, extra int")).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, "é [SECRET:assign] and [SECRET:access].", 38, None), rows[1], rows[2]]
    assert redact("abcdef", [Span("hex", 1, 4), Span("hex", 2, 5)]) == "a[SECRET:hex]f" and spans_text([Span("hex", 1, 4)]) == "hex:1:4"


# ---- the n-gram trie


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.integers(2**40 + 1, 2**62), st.lists(st.integers(0, 2**41), max_size=50))
def test_elias_fano(values, universe, others):
    values = np.unique(np.array(values, np.uint64))
    built = EliasFano.of(EliasFano.build(values, universe).arrays())
    assert (built.access(np.arange(len(values))) == values).all()
    first, second = built.access_two(np.arange(max(0, len(values) - 1)))
    assert (first == values[:-1]).all() and (second == values[1:]).all()
    place = {int(v): i for i, v in enumerate(values)}
    asked = np.concatenate([values, np.array(others, np.uint64)])
    assert built.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def test_pairs_begin_and_end_with_each_text():
    text = Text.of([b"a b", b"", b"b"])
    context, token = text.pairs(8, 9)
    assert (context.tolist(), token.tolist()) == ([8, 0, 1, 8, 8, 1], [0, 1, 9, 9, 1, 9])


class Model:
    """The same model, plainly."""

    def __init__(self, texts):
        self.single, self.pair, self.context, self.follow = Counter(), Counter(), Counter(), defaultdict(set)
        for w in texts:
            self.single.update(w)
            for a, b in zip([0, *w], w):
                self.pair[a, b] += 1
                self.context[a] += 1
                self.follow[a].add(b)
        self.n, self.v = sum(self.single.values()), len(self.single)

    def one(self, w):
        return (self.single[w] + 1) / (self.n + self.v + 1)

    def two(self, a, b):
        c = self.context[a]
        return self.one(b) if not c else max(self.pair[a, b] - DISCOUNT, 0) / c + DISCOUNT * len(self.follow[a]) / c * self.one(b)


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", ascii_lower(text)), None]


def test_scores_match_the_plain_model(spark, docs):
    found = lm_score(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = Model([tokens(t) for i, t in ROWS if not held(i)])
    expected = Counter()
    for i, t in ROWS:
        w = tokens(t)
        expected[(i, held(i), len(w), sum(model.single[x] > 0 for x in w), model.n, round(sum(log10(model.one(x)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    for r in found:
        w = next(tokens(t) for i, t in ROWS if i == r.doc_id and len(tokens(t)) == r.n_tokens)
        assert abs(r.score - sum(log10(model.two(a, b)) for a, b in zip([0, *w], w))) <= len(w) / STEPS


def test_probabilities_of_a_context_sum_to_one(spark):
    frame = spark.createDataFrame([(f"a b c a b {i % 5} x{i}",) for i in range(40)], "text string")
    model = train(frame)
    words = [b"a", b"b", b"c", *[str(i).encode() for i in range(5)], *[f"x{i}".encode() for i in range(40)]]
    ids = np.concatenate([model.word_ids(words), [model.end]])
    assert (ids >= 0).all() and len(ids) == model.types
    for context in [*ids[:4], model.begin]:
        back = model.back_off(np.array([context]))[0]
        single = (model.counts(ids) + 1) / (model.tokens + model.types + 1)
        unknown = back / (model.tokens + model.types + 1)
        assert abs((model.bigrams(np.full(len(ids), context), ids) + back * single).sum() + unknown - 1) < 2e-3


def test_trie_pointers_delimit_runs():
    from veilspark.llm.ngram import Trie

    context, token = np.array([2, 2, 5, 9, 9, 9]), np.array([1, 7, 0, 0, 3, 8])
    trie = Trie.of(Trie.build(context, token, np.full(6, 0.5), 10).arrays())
    assert trie.find(np.array([9, 2, 5, 4, 2]), np.array([3, 7, 1, 0, 1])).tolist() == [4, 1, -1, -1, 0]
    begin, end = trie.run(np.arange(3))
    assert begin.tolist() == [0, 2, 3] and end.tolist() == [2, 3, 6]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 20)), min_size=1, max_size=120))
def test_trie_finds_its_pairs_only(pairs):
    from veilspark.llm.ngram import Trie

    context, token = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    trie = Trie.of(Trie.build(context, token, np.full(len(pairs), 0.5), 13).arrays())
    place = {p: i for i, p in enumerate(sorted(pairs))}
    asked = [(a, b) for a in range(13) for b in range(22)]
    assert trie.find(*(np.array(x) for x in zip(*asked, strict=True))).tolist() == [place.get(p, -1) for p in asked]


@pytest.mark.parametrize("rows", [[], [(5, "x")]])  # 5: crc32("5") % 7 decides the fold
def test_without_or_with_one_training_row(spark, rows):
    found = lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(np.isfinite(r.score) for r in found)
