"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the words: their hashes as an Elias-Fano sequence, exact counts, and the quantised weight
that each gives to the lower order. Level 2 holds the bigrams in shards by a hash of (context, word), so a
frequent context spreads over all shards. A shard is a small trie: its contexts, monotone pointers to
where each one's successors begin, and the successors, where a word is kept relative to the end of the run
before its context's. All three are Elias-Fano sequences; each bigram has a quantised discounted
probability. A bigram is looked up by the rank of its context, the two pointers that delimit the context's
run, and a successor search relative to the run's base. Levels are flat files in the shared folder, which
scoring tasks map into memory; a worker keeps those of one model open.

The model interpolates: P(w | v) = max(c(vw) - D, 0) / c(v) + D * followers(v) / c(v) * P(w) with
P(w) = (c(w) + 1) / (N + V + 1); a context that was never seen leaves P(w). Quantised terms are kept
in steps of 1 / STEPS of log10.

Counts travel as sorted, compressed arrays: a task merges what it has read before it sends a shard its part.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, shared_path, sliced, text_bytes
from .eliasfano import EliasFano

#: Absolute discount of a bigram's count.
DISCOUNT = 0.75
STEPS = 4096
#: Training tokens for each shard of bigrams, and bytes of text that a task handles at once.
SHARD_TOKENS, BLOCK_BYTES = 4_000_000, 12 << 20
#: Entries of counts that a task gathers before it sends them.
GATHER = 6_000_000

Blob = "shard int, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        squeezed = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        parts += [json.dumps([a.dtype.str, len(planes), len(squeezed)]).encode().ljust(64), squeezed]
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(data):
        kind, size, squeezed = json.loads(data[at : at + 64])
        planes = np.frombuffer(pa.decompress(data[at + 64 : at + 64 + squeezed], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
        found.append(np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel())
        at += 64 + squeezed
    return found


def _save(uri: str, arrays: list[np.ndarray]) -> None:
    """One file of flat arrays, each at a multiple of 64 bytes; put in its place whole, so a repeated task does no harm."""
    head = json.dumps([[a.dtype.str, a.nbytes] for a in arrays]).encode()
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{np.random.SeedSequence().entropy:x}"
    with store.open_output_stream(own) as out:
        for part in (len(head).to_bytes(8, "little") + head, *(np.ascontiguousarray(a) for a in arrays)):
            data = memoryview(part).cast("B") if not isinstance(part, np.ndarray) or part.nbytes else b""
            out.write(data)
            out.write(bytes(-len(data) % 64))
    store.move(own, path)


def _open(uri: str) -> list[np.ndarray]:
    """The arrays of a file: memory-mapped where the folder is a local or mounted one, else read."""
    store, path = fs.FileSystem.from_uri(uri)
    data = np.memmap(path, np.uint8, "r") if store.type_name == "local" else np.frombuffer(store.open_input_file(path).read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    at, found = 8 + size + -(8 + size) % 64, []
    for kind, n in json.loads(data[8 : 8 + size].tobytes()):
        found.append(data[at : at + n].view(kind))
        at += n + -n % 64
    return found


_opened: dict[str, dict[str, object]] = {}


def _once(folder: str, name: str, make):
    """What a worker opened of the model in ``folder``; those of other models are let go."""
    if folder not in _opened:
        _opened.clear()
        _opened[folder] = {}
    known = _opened[folder]
    if name not in known:
        known[name] = make()
    return known[name]


def _coded(p: np.ndarray) -> np.ndarray:
    """Probabilities in 16 bits."""
    return np.minimum(np.round(-np.log10(p) * STEPS), 65535).astype(np.uint16)


def _decoded(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes / -STEPS)


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name and an unrelated 32-bit check of each word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words)), np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


@dataclass
class Text:
    """Some texts as numbers of their words: all words in a row, the words of each text, the distinct words."""

    flat: np.ndarray
    sizes: np.ndarray
    words: list[bytes]

    @staticmethod
    def of(texts: list[bytes]) -> Text:
        number: defaultdict = defaultdict(count().__next__)
        split = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.concatenate([np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in split]) if split else np.zeros(0, np.int64)
        return Text(flat, sizes, list(number))

    def pairs(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and tokens of each text in a row: begin before the first word, end behind the last."""
        n = len(self.flat) + len(self.sizes)
        ends = np.cumsum(self.sizes + 1) - 1
        token = np.full(n, end, np.int64)
        word = np.ones(n, bool)
        word[ends] = False
        token[word] = self.flat
        context = np.concatenate([[begin], token[:-1]]) if n else token
        context[ends[:-1] + 1] = begin
        return context, token


def _blocks(batches: Iterator[pa.RecordBatch], keep: str | None = None) -> Iterator[tuple[Text, list]]:
    texts, kept, size = [], [], 0
    for batch in sliced(batches):
        others = batch.select([keep] if isinstance(keep, str) else keep or []).to_pylist()
        for t, other in zip(batch.column("text").to_pylist(), others or [None] * batch.num_rows, strict=True):
            if texts and size + len(t) > BLOCK_BYTES:
                yield Text.of(texts), kept
                texts, kept, size = [], [], 0
            texts.append(t)
            kept.append(other)
            size += len(t)
    if texts:
        yield Text.of(texts), kept


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _batch(shard: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])


def _by_shard(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[order[a]]), [x[order[a:b]] for x in arrays]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The parts of each shard; rows come sorted by shard."""
    at, parts = None, []
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if shard != at:
                if parts:
                    yield at, parts
                at, parts = shard, []
            parts.append(_unpack(data))
    if parts:
        yield at, parts


@dataclass
class Model:
    """What a task needs to open the levels; its size is that of the list of word shards."""

    folder: str
    bits: int  # words are dealt by the highest bits of their hash
    bases: np.ndarray  # first id of each word shard, and the number of words
    texts: int  # training texts
    tokens: int  # N: training words and ends
    shards: int  # of bigrams

    @property
    def words(self) -> int:
        return int(self.bases[-1])

    @property
    def end(self) -> int:
        return self.words

    @property
    def begin(self) -> int:
        return self.words + 1

    @property
    def types(self) -> int:
        """V: the distinct training tokens, the end among them."""
        return self.words + (self.texts > 0)

    def _level(self, kind: str, shard: int) -> list[np.ndarray]:
        return _once(self.folder, f"{kind}-{shard}", lambda: _open(f"{self.folder}/{kind}-{shard}"))

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, -1 for those that training lacks."""
        names, checks = _hashes(words)
        found = np.full(len(words), -1, np.int64)
        shard = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        for s, (at,) in _by_shard(shard, np.arange(len(words))):
            if self.bases[s] == self.bases[s + 1]:
                continue
            arrays = self._level("words", s)
            sequence = _once(self.folder, f"sequence-{s}", lambda a=arrays: EliasFano.of(a[:5]))
            i = sequence.find(names[at] & np.uint64((1 << (64 - self.bits)) - 1))
            known = (i >= 0) & (arrays[5][np.maximum(i, 0)] == checks[at])
            found[at[known]] = i[known] + self.bases[s]
        return found

    def _by_id(self, kind: str, place: int, ids: np.ndarray) -> np.ndarray:
        found = np.zeros(len(ids), np.int64)
        at = np.flatnonzero((ids >= 0) & (ids < self.words))
        shard = np.searchsorted(self.bases, ids[at], side="right") - 1
        for s, (own,) in _by_shard(shard, at):
            found[own] = self._level(kind, s)[place][ids[own] - self.bases[s]]
        return found

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """c of tokens; of the end the number of texts."""
        return np.where((ids == self.end) | (ids == self.begin), self.texts, self._by_id("words", 6, ids))

    def back_off(self, ids: np.ndarray) -> np.ndarray:
        """The weight that each context gives to the lower order: D * followers / c, 1 where it was never seen."""
        found = np.ones(len(ids))
        known = (ids >= 0) & (ids < self.words)
        found[known] = _decoded(self._by_id("back-off", 0, ids[known]))
        if self.texts and (ids == self.begin).any():
            found[ids == self.begin] = _decoded(self._level("back-off", len(self.bases) - 1)[0])
        return found

    def shard_of(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        mixed = (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (token.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.shards)).astype(np.int64)

    def bigrams(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The discounted term of P(token | context) of each pair, 0 for pairs that training lacks."""
        found = np.zeros(len(context))
        at = np.flatnonzero((context >= 0) & (token >= 0))
        if not self.texts or not len(at):
            return found
        for s, (own,) in _by_shard(self.shard_of(context[at], token[at]), at):
            trie = _once(self.folder, f"trie-{s}", lambda s=s: Trie.of(self._level("bigrams", s)))
            i = trie.find(context[own], token[own])
            hit = i >= 0
            found[own[hit]] = _decoded(trie.codes[i[hit]])
        return found


class Trie:
    """One shard of level 2."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray) -> None:
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @staticmethod
    def build(context: np.ndarray, token: np.ndarray, term: np.ndarray, universe: int) -> Trie:
        """Of distinct pairs, sorted by context and token, and their discounted terms."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        ends = np.concatenate([first[1:], [len(context)]])
        # Each run starts above the last number of the run before it.
        spans = token[ends - 1] + 1
        base = np.cumsum(spans) - spans
        return Trie(
            EliasFano.build(context[first].astype(np.uint64), universe),
            EliasFano.build(np.concatenate([first, [len(context)]]).astype(np.uint64), len(context) + 1),
            EliasFano.build((token + np.repeat(base, ends - first)).astype(np.uint64), int(spans.sum())),
            _coded(term),
        )

    def arrays(self) -> list[np.ndarray]:
        return [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.codes]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> Trie:
        return Trie(*(EliasFano.of(arrays[i : i + 5]) for i in (0, 5, 10)), arrays[15])

    def find(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 if it is not there."""
        distinct, place = np.unique(context, return_inverse=True)
        rank = self.contexts.find(distinct.astype(np.uint64))
        known = np.flatnonzero(rank >= 0)
        begin, end, base = (np.zeros(len(distinct), np.int64) for _ in range(3))
        begin[known], end[known] = self.run(rank[known])
        later = known[begin[known] > 0]
        base[later] = self.successors.access(begin[later] - 1).astype(np.int64) + 1
        at = np.flatnonzero(rank[place] >= 0)
        place = place[at]
        i = self.successors.find((base[place] + token[at]).astype(np.uint64))
        found = np.full(len(context), -1, np.int64)
        found[at] = np.where((i >= begin[place]) & (i < end[place]), i, -1)
        return found

    def run(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the successors of the contexts with these ranks."""
        begin, end = self.pointers.access_two(rank)
        return begin.astype(np.int64), end.astype(np.int64)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Builds the levels from all rows of ``docs``."""
    spark = docs.sparkSession
    folder = shared_path(spark, "ngrams")
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    texts = docs.select(text_bytes(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []
        checks: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows = tokens = 0

        def send() -> Iterator[pa.RecordBatch]:
            name, check, n = np.concatenate(names), np.concatenate(checks), np.concatenate(counts)
            for shard, (a, b, c) in _by_shard((name >> np.uint64(64 - bits)).astype(np.int64), name, check, n):
                a, b, c = _words_merged(a, b, c)
                yield _batch([shard], [_pack(np.diff(a, prepend=np.uint64(0)), b, c)])

        for text, _ in _blocks(batches):
            rows, tokens = rows + len(text.sizes), tokens + len(text.flat)
            a, b = _hashes(text.words)
            names.append(a)
            checks.append(b)
            counts.append(np.bincount(text.flat, minlength=len(text.words)).astype(np.int64))
            if sum(map(len, names)) > GATHER:
                yield from send()
                names, checks, counts = [], [], []
        if names:
            yield from send()
        yield _batch([-1], [_pack(np.array([rows, tokens], np.int64))])

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _gathered(batches):
            if shard < 0:
                yield _batch([shard], [_pack(np.sum([p[0] for p in parts], axis=0))])
                continue
            name, check, n = _words_merged(*(np.concatenate([np.cumsum(p[i]) if i == 0 else p[i] for p in parts]) for i in range(3)))
            sequence = EliasFano.build(name & np.uint64((1 << (64 - bits)) - 1), 1 << (64 - bits))
            _save(f"{folder}/words-{shard}", [*sequence.arrays(), check, n])
            yield _batch([shard], [_pack(np.array([len(name)], np.int64))])

    found = texts.mapInArrow(count_words, Blob).repartition("shard").sortWithinPartitions("shard").mapInArrow(save_words, Blob).collect()  # a number per shard
    sizes, rows, words = np.zeros(1 << bits, np.int64), 0, 0
    for row in found:
        value = _unpack(bytes(row.data))[0]
        if row.shard < 0:
            rows, words = rows + int(value[0]), words + int(value[1])
        else:
            sizes[row.shard] = value[0]
    bases = np.concatenate([[0], np.cumsum(sizes)])
    model = Model(folder, bits, bases, rows, words + rows, max(1, -(-(words + rows) // SHARD_TOKENS)))
    if model.begin >= 1 << 32:
        raise ValueError("ids of words need more than 32 bits")
    if not rows:
        return model

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            key, n = _merged(keys, counts)
            context, token = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for shard, (k, c) in _by_shard(model.shard_of(context, token), key, n):
                yield _batch([shard], [_pack(np.diff(k, prepend=np.uint64(0)), c.astype(np.uint32))])

        for text, _ in _blocks(batches):
            ids = np.concatenate([model.word_ids(text.words), [model.end, model.begin]]).astype(np.uint64)
            context, token = text.pairs(len(text.words) + 1, len(text.words))
            # 32 bits name a word; numbers of the block's own words sort faster than ids.
            key, n = np.unique(context * len(ids) + token, return_counts=True)
            keys.append((ids[key // len(ids)] << np.uint64(32)) | ids[key % len(ids)])
            counts.append(n)
            if sum(map(len, keys)) > GATHER:
                yield from send()
                keys, counts = [], []
        if keys:
            yield from send()

    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _gathered(batches):
            key, n = _merged([np.cumsum(p[0], dtype=np.uint64) for p in parts], [p[1].astype(np.int64) for p in parts])
            context, token = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            distinct, place, followers = np.unique(context, return_inverse=True, return_counts=True)
            term = (n - DISCOUNT) / model.counts(distinct)[place]
            _save(f"{folder}/bigrams-{shard}", Trie.build(context, token, term, model.words + 2).arrays())
            to = np.where(distinct < model.words, np.searchsorted(bases, distinct, side="right") - 1, len(bases) - 1)
            for other, (k, c) in _by_shard(to, distinct, followers):
                yield _batch([other], [_pack(np.diff(k, prepend=0), c.astype(np.uint32))])

    def save_back_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _gathered(batches):
            key, n = _merged([np.cumsum(p[0]) for p in parts], [p[1].astype(np.int64) for p in parts])
            if shard == len(bases) - 1:  # the begin mark alone
                codes = _coded(DISCOUNT * n / model.texts)
            else:  # every word has a follower, the end at least
                codes = np.zeros(int(sizes[shard]), np.uint16)
                codes[key - bases[shard]] = _coded(DISCOUNT * n / model.counts(key))
            _save(f"{folder}/back-off-{shard}", [codes])
            yield _batch([shard], [b""])

    pairs = texts.mapInArrow(count_pairs, Blob).repartition("shard").sortWithinPartitions("shard").mapInArrow(save_pairs, Blob)
    pairs.repartition("shard").sortWithinPartitions("shard").mapInArrow(save_back_off, Blob).agg(F.count(F.lit(1))).collect()
    return model


def _words_merged(name: np.ndarray, check: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by name, sorted, with their counts. Two words of one name would be told apart by the check: that fails."""
    order = np.argsort(name, kind="stable")
    name, check, n = name[order], check[order], n[order]
    same = name[1:] == name[:-1]
    if (check[1:][same] != check[:-1][same]).any():
        raise ValueError("two words share a 64-bit hash")
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(name) else np.zeros(0, np.int64)
    return name[first], check[first], np.add.reduceat(n, first) if len(name) else n


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row under the model."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, kept in _blocks(batches, ["doc_id", "held_out"]):
            ids = np.concatenate([model.word_ids(text.words), [model.end, model.begin]])
            counts = model.counts(ids)
            single = (counts + 1) / (model.tokens + model.types + 1)
            back = model.back_off(ids)
            end, begin = len(text.words), len(text.words) + 1
            context, token = text.pairs(begin, end)
            key, place = np.unique(context * len(ids) + token, return_inverse=True)
            a, b = key // len(ids), key % len(ids)
            pair = np.log10(model.bigrams(ids[a], ids[b]) + back[a] * single[b])
            starts = np.concatenate([[0], np.cumsum(text.sizes + 1)[:-1]])
            sums = [np.add.reduceat(x, starts) for x in ((counts[token] > 0).astype(np.int64), np.log10(single)[token], pair[place])]
            columns = [[k["doc_id"] for k in kept], [k["held_out"] for k in kept], text.sizes + 1, sums[0], np.full(len(kept), model.tokens), sums[1], sums[2]]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(held_out) if held_out else F.lit(False)).alias("held_out"), text_bytes(text_col).alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores every row.

    Null and empty texts are one end token. A null id counts as the empty text for the fold. Ids may repeat, each
    row counts and is scored by itself. Without training rows every token has the probability of an unknown one.
    An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, folds) == held).alias("held_out"))
    return score(rows, train(rows.where(~F.col("held_out"))), held_out="held_out")
