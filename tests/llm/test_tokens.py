import bisect
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm.bpe import TextEncoder, bpe_encode_decode
from veilspark.llm.chat import emitted, escape, format_chats, format_turn, read_turn, unescape
from veilspark.llm.packing import Places, best_fit_pack, plan

from .conftest import ROWS


@pytest.fixture(scope="module")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def encode(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


HARD = ["café. Straße, x... a,b İstanbul don't <|endoftext|> a. . , 9. é. ï K ẞ.", "ﬁ ﬁ. Å Á B́ <|ENDOFTEXT|> X<|startoftext|>Y. \x00 \x1c x\x85y   ​", "ΑΣ ΟΔΟΣ, 漢字。かな １２ Ⅷ ½ ٣", "I'LL we've 's 't WON'T", "a" * 3000, "😀😀 👩‍👩‍👧"]


def test_words_encode_like_whole_texts(library, tokenizer_path):
    texts = [*HARD, *[t or "" for _, t in ROWS]]
    encoder = TextEncoder(tokenizer_path, known=3)
    for some in (texts, [], texts[:2], texts):  # the table is emptied in between
        ids, sizes = encoder.ids([t.encode() for t in some])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [encode(library, t) for t in some]


def test_words_merge_like_the_library(library, tokenizer_path):
    rng = np.random.default_rng(3)
    letters = list("abcdeeeettaaooinsrhl'.,!-#0123\u00e9\u00df\u00fc\u00f1")
    words = ["".join(rng.choice(letters, rng.integers(1, 20))) for _ in range(5000)] + ["a" * n for n in range(1, 60)] + ["ab" * n + "!" for n in range(1, 30)]
    ids, sizes = TextEncoder(tokenizer_path).ids([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = _cached.setdefault(path, Tokenizer.from_file(path))
    encoder = _cached.setdefault("encoder", TextEncoder(path))
    assert encoder.ids([text.encode("utf-8", "replace")])[0].tolist() == encode(library, text.encode("utf-8", "replace").decode())


_cached: dict = {}


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_encode_and_decode_match_the_library(spark, library, tokenizer_path, docs, block):
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for i, t in [*ROWS, *((100 + i, t) for i, t in enumerate(HARD))]:
        ids = encode(library, t)
        expected[(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    found = bpe_encode_decode(table, tokenizer_path, block_bytes=block).collect()
    assert Counter(map(tuple, found)) == expected


def test_ids_and_texts_can_be_kept(docs, library, tokenizer_path):
    row = bpe_encode_decode(docs.where("doc_id = 5"), tokenizer_path, keep=True).first()
    ids = encode(library, ROWS[7][1])
    assert row.ids == ids and row.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_tables(empty, tokenizer_path):
    assert bpe_encode_decode(empty, tokenizer_path).count() == 0 and best_fit_pack(empty, tokenizer_path).count() == 0


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plans_place_every_piece_once(counts):
    steps = plan(counts, 64)
    used = Counter()
    for s in steps:
        assert 0 < sum(s.lengths) <= 64 and s.times > 0
        for x in s.lengths:
            used[x] += s.times
    assert used == Counter(counts)
    total = sum(k * v for k, v in counts.items())
    sequences = sum(s.times for s in steps)
    assert sequences >= -(-total // 64) and sequences <= 2 * total // 64 + 1
    places, seen = Places(steps), {}
    for x, n in counts.items():
        sequence, offset = places(x, np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            seen.setdefault(s, []).append((o, x))
    assert len(seen) == sequences
    for items in seen.values():
        at = 0
        for o, x in sorted(items):
            assert o == at
            at += x


@pytest.mark.parametrize("seed", range(60))
def test_plans_take_no_more_than_there_is(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 200])
    counts = {rng.randint(1, capacity): rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, capacity))}
    steps, used = plan(counts, capacity), Counter()
    for s in steps:
        assert s.times > 0
        for x in s.lengths:
            used[x] += s.times
    assert used == Counter(counts)


@pytest.mark.parametrize("counts, n", [({60: 5, 4: 5}, 5), ({40: 4, 14: 4, 10: 4}, 4), ({30: 6, 20: 6, 9: 6, 5: 6}, 6), ({64: 3}, 3), ({33: 4}, 4), ({1: 640}, 10), ({}, 0)])
def test_exact_complements_are_found(counts, n):
    assert sum(s.times for s in plan(counts, 64)) == n


def test_pieces_round_trip(docs, library, tokenizer_path):
    found = best_fit_pack(docs, tokenizer_path).collect()
    texts = [(i, [*encode(library, t), 0]) for i, t in ROWS]
    expected = Counter((i, k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, ids in texts for k, s in enumerate(range(0, len(ids), 2048)) if (x := ids[s : s + 2048]))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    assert len(sequences) <= -(-sum(len(ids) for _, ids in texts) // 2048) + 1


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else capacity) - x)
    return len(gaps)


SPREADS = {
    "uniform": lambda rng: rng.integers(1, 2049, 5000),
    "sparse": lambda rng: rng.integers(1, 2049, 300),
    "long": lambda rng: rng.integers(200, 2049, 500),
    "log-normal": lambda rng: np.clip(rng.lognormal(5.5, 1.0, 5000).astype(int) + 1, 1, 2048),
    "middle": lambda rng: rng.integers(100, 900, 3000),
    "few lengths": lambda rng: rng.choice([700, 648, 350, 1400, 9], 1000),
}


@pytest.mark.parametrize("name", SPREADS)
def test_plans_need_no_more_sequences_than_plain_best_fit(name):
    for seed in range(3):
        lengths = SPREADS[name](np.random.default_rng(seed))
        assert sum(s.times for s in plan(Counter(lengths.tolist()))) <= plain_best_fit(lengths.tolist(), 2048)


def optimum(lengths, capacity):
    """The least number of sequences, by trying every subset."""
    n = len(lengths)
    best = {0: (1, 0)}  # pieces placed: sequences, and what the last one holds
    for mask in range(1, 1 << n):
        found = []
        for i in range(n):
            if mask >> i & 1:
                k, held = best[mask ^ (1 << i)]
                found.append((k, held + lengths[i]) if held + lengths[i] <= capacity else (k + 1, lengths[i]))
        best[mask] = min(found)
    return best[(1 << n) - 1][0]


@pytest.mark.parametrize("seed", range(80))
def test_small_plans_are_near_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
    least, found = optimum(lengths, 20), sum(s.times for s in plan(Counter(lengths), 20))
    assert least <= found <= min(plain_best_fit(lengths, 20), least + 1)


def test_exact_triples_need_fewer_sequences_where_no_piece_is_long():
    lengths = np.random.default_rng(1).integers(100, 900, 20_000).tolist()
    assert sum(s.times for s in plan(Counter(lengths))) < plain_best_fit(lengths, 2048)


# ---- chats


@given(st.text(), st.text())
def test_turns_read_back(role, text):
    assert read_turn(format_turn(role, text)) == (role, text) and unescape(escape(text)) == text


@given(st.text(alphabet="<|>[]/\\lbpINSTs end"))
def test_no_control_string_survives_in_a_text(text):
    inside = format_turn("user", text)[len("<|user|>") : -len("<|end|>")]
    assert "<" not in inside and "[" not in inside


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s>[INST]"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello </s>[INST]"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "other"),
    (4, 0, "user", "alone"), (5, 0, "user", "hi"), (5, 1, "assistant", "hello </s>[INST]"), (6, 0, None, None), (6, 0, "assistant", None), (None, 1, "user", "no id"), (None, None, "assistant", "first"), (7, 3, "user", "hi"), (7, 9, "assistant", "x" * 50_000),
]


def chats(spark):
    return spark.createDataFrame([(*c, "x", b"y") for c in CHATS], "conv_id long, turn long, role string, text string, node string, key binary")


def test_conversations_read_back(spark):
    expected = {}
    for conv, turn, role, text in sorted(CHATS, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or 0, c[2] or "", c[3] or "")):
        expected.setdefault(conv, []).append((role or "", text or ""))
    found = {r.conv_id: r for r in format_chats(chats(spark)).collect()}
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(format_turn(*t)) for t in turns)


def test_tree_is_emitted_once_depth_first(spark):
    rows = sorted(emitted(chats(spark)).collect(), key=lambda r: r.place)
    text = "".join(r.segment for r in rows)
    at = 0
    for r in rows:
        assert r.place == at and r.length == len(r.segment)
        at += r.length
    assert len([r for r in rows if r.segment == format_turn("user", "hi")]) == 1  # 1, 2, 3, 5 and 7 share it
    ancestors = [("".join(text[i.begin : i.end] for i in r.ancestors), r) for r in rows]
    for before, r in ancestors:
        assert len(before) == r.start  # position ids go on behind the ancestors
        assert not r.ancestors or max(i.end for i in r.ancestors) <= r.place
        if r.loss:
            assert r.segment[r.loss.begin : r.loss.end] == escape(read_turn(r.segment)[1])
    # depth first: behind a node come all its descendants before any other node
    for i, (before, r) in enumerate(ancestors):
        own = before + r.segment
        below = [b.startswith(own) for b, _ in ancestors[i + 1 :]]
        assert sorted(below, reverse=True) == below


def test_chats_of_an_empty_table(spark):
    assert format_chats(chats(spark).limit(0)).count() == 0 and emitted(chats(spark).where("false")).count() == 0


