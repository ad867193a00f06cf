"""BPE encoding and decoding over a distinct-word table.

A *word* here is a run of bytes without white space \\x20, \\x09-\\x0D. The tokenizer removes white
space and never merges across it, so a text's ids are its words' ids in a row.

1. Split: a task cuts its rows into blocks of bounded size, numbers each block's distinct words
   (frequent ones first) and keeps each text as the numbers of its words, by position.
2. Encode: the blocks' words meet by a hash of the word; each distinct word is encoded once.
3. Join: a block's word numbers meet the ids of its words, which gives each text's ids by position;
   decoding looks each id up in the table of pieces and joins them.

Words and texts of a block travel packed, so the exchange moves a few bytes a word and no task
holds more than one block or one bucket of distinct words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_threaded, sliced, text_bytes

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 24 << 20
#: Buckets of distinct words for each shuffle partition.
BUCKETS_EACH = 4

_loaded: dict[str, object] = {}

#: What this module knows of the tokenizer file, as its normalizer and pre-tokenizer say it; others are refused.
# Fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS, PRE_TOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def load(path: str):
    """The tokenizer, once for each worker; truncation and padding are off."""
    if path not in _loaded:
        single_threaded()
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        normal, split = (json.loads(x.__getstate__()) for x in (found.normalizer, found.pre_tokenizer))
        own = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in split.get("pretokenizers", [])]
        if own != (NORMALIZERS, PRE_TOKENIZERS) or split["pretokenizers"][0]["pattern"] != {"Regex": SPLIT}:
            raise ValueError("the tokenizer must drop white space, lower-case and split as this module does")
        _loaded[path] = found
    return _loaded[path]


#: A word of printable ASCII in the tokenizer's own parts; marks, which are one part behind letters.
_PARTS, _PRINTABLE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"), re.compile(rb"[!-~]+")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for a byte within the model: its own if that can be seen, else one from 256 on, in order.
_CHARS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PLAIN)))}
#: Letters up to U+024F are composed already and stay so lower-cased; these lie above.
_ABOVE = re.compile("[\u0250-\U0010ffff]")
#: Bytes of a word that is merged in arrays; the library encodes longer ones.
LONGEST = 48


def parts_of(word: bytes) -> list[str] | None:
    """The parts of a word that the tokenizer encodes by themselves, lower-cased; None where only it can tell."""
    return None if b"<|" in word or len(word) > LONGEST or not _PRINTABLE.fullmatch(word) else _PARTS.findall(word.decode().lower())


def gathered(index: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that ``index`` names, in a row."""
    n = sizes[index]
    return flat[np.repeat(starts[index] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _runs(sizes: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes."""
    sizes = np.asarray(sizes, np.int64)
    return np.cumsum(sizes) - sizes, sizes


class Encoder:
    """Encodes many words at once: all parts are merged together, in arrays, a step of each part at a time.

    In a step each part merges its pair of the lowest rank wherever it stands. A merge that uses the merged piece
    ranks later, so this is the order of the library, which merges one place at a time.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        if len(np.unique(self.merged)) != len(merges):
            raise ValueError("two merges of the tokenizer make one piece")
        key = (left << 32) | right
        self.rank = np.argsort(key).astype(np.int32)
        self.keys = key[self.rank]
        chars = [chr(_CHARS[b]) for b in range(256)]
        # Symbols of a part at first: by byte, and by 256 + byte for the last one.
        self.symbols = np.array([vocab[c] for c in chars] + [vocab[f"{c}</w>"] for c in chars], np.int32)
        self.first = self._ranks(np.repeat(self.symbols, 512), np.tile(self.symbols, 512)).reshape(512, 512)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each has. No part is empty."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        code = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        code[np.cumsum(n) - 1] += 256
        part = np.repeat(np.arange(len(parts)), n)
        symbol, rank = self.symbols[code], np.full(len(code), self.NONE, np.int32)
        inside = part[1:] == part[:-1]
        rank[:-1][inside] = self.first[code[:-1][inside], code[1:][inside]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sizes = np.diff(starts, append=len(part))
            best = np.minimum.reduceat(rank, starts)
            least = np.repeat(best, sizes)
            open_ = least != self.NONE
            if not open_.all():
                done.append((part[~open_], symbol[~open_]))
                part, symbol, rank, least = part[open_], symbol[open_], rank[open_], least[open_]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            # Of a run of overlapping places every other one merges.
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            if not run.all():
                order = np.arange(len(hit))
                hit = hit[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            part, symbol, rank = part[keep], symbol[keep], rank[keep]
            at = hit - np.arange(len(hit))
            for where in (at, at[at > 0] - 1):
                rank[where] = self.NONE
                where = where[where + 1 < len(part)]
                where = where[part[where] == part[where + 1]]
                rank[where] = self._ranks(symbol[where], symbol[where + 1])
        part, symbol = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        return symbol[np.argsort(part, kind="stable")].astype(np.uint32), np.bincount(part, minlength=len(parts))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; invalid UTF-8 is replaced as Spark shows it.

        Letters with and without a mark share their encoding.
        """
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        number: defaultdict = defaultdict(count().__next__)
        get = number.__getitem__
        # Letters with or without marks, which most words are, go by whole lists.
        behind = [w.rstrip(_MARKS) for w in words]
        joined = b"\n".join(behind).decode("utf-8", "replace").lower()
        stems = joined.split("\n")
        plain = np.fromiter(map(str.isalpha, stems), bool, len(words))
        length, size = (np.fromiter(map(len, x), np.int64, len(words)) for x in (words, behind))
        plain &= length <= LONGEST
        if _ABOVE.search(joined):
            plain &= np.fromiter((_ABOVE.search(s) is None for s in stems), bool, len(words))
        marked = plain & (length > size)
        rest = np.flatnonzero(~plain)
        found = [parts_of(words[i]) for i in rest.tolist()]
        other = {i: words[i] for i, f in zip(rest.tolist(), found, strict=True) if f is None}
        own = plain.astype(np.int64) + marked
        own[rest] = [len(f or ()) for f in found]
        at, index = np.cumsum(own) - own, np.zeros(own.sum(), np.int64)
        index[at[plain]] = list(map(get, compress(stems, plain)))
        index[at[marked] + 1] = [get(w[n:].decode()) for w, n in zip(compress(words, marked), size[marked].tolist(), strict=True)]
        index[np.repeat(~plain, own)] = [get(p) for f in found if f for p in f]
        flat, sizes = self.merge("\n".join(number).encode().split(b"\n") if number else [])
        starts, sizes = _runs(sizes)
        ids = gathered(index, flat, starts, sizes)
        totals = np.bincount(np.repeat(np.arange(len(words)), own), sizes[index], len(words)).astype(np.int64)
        if other:
            some = [w.decode("utf-8", "replace") for w in other.values()]
            found = [np.array(e.ids, np.uint32) for k in range(0, len(some), 4096) for e in self.tokenizer.encode_batch_fast(some[k : k + 4096], add_special_tokens=False)]
            places = np.repeat(np.cumsum(totals)[list(other)], [len(x) for x in found])
            ids = np.insert(ids, places, np.concatenate(found))
            totals[list(other)] = [len(x) for x in found]
        return ids, totals


def encoder(path: str) -> Encoder:
    """That of this worker; its size is that of the vocabulary."""
    if (key := f"encoder of {path}") not in _loaded:
        _loaded[key] = Encoder(path)
    return _loaded[key]


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word, as uint32 bytes."""
    ids, sizes = encoder(path).words(words)
    data, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def words_of(text: bytes) -> list[bytes]:
    """The words of a text. A-Z are lower-cased, as the tokenizer does, unless a special token may be in it."""
    return (text if b"<|" in text else text.lower()).split()


def pieces(path: str) -> list[str]:
    """The id-to-piece table; its size is that of the vocabulary file."""
    t = load(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


#: Words that a worker knows before it starts anew, and the bytes of their text.
KNOWN, KNOWN_BYTES = 150_000, 8 << 20


class TextEncoder:
    """Encodes blocks of whole texts over a table of distinct words, each of which is encoded once.

    The table is emptied between two blocks when it is full, so it holds a bounded part of any corpus.
    """

    def __init__(self, path: str, known: int = KNOWN, known_bytes: int = KNOWN_BYTES) -> None:
        self.encoder, self.known, self.known_bytes = encoder(path), known, known_bytes
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict = defaultdict(count().__next__)
        self.flat, self.sizes, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.number) > self.known or self.size > self.known_bytes:
            self.clear()
        split = [words_of(t) for t in texts]
        get = self.number.__getitem__
        before = len(self.number)
        index = np.fromiter(map(get, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        new = list(islice(self.number, before, None))
        if new:
            self.size += sum(map(len, new))
            ids, sizes = self.encoder.words(new)
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        starts, sizes = _runs(self.sizes)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        total = np.concatenate([[0], np.cumsum(sizes[index])])
        return gathered(index, self.flat, starts, sizes), np.diff(total[ends], prepend=0)


def _squeeze(numbers: np.ndarray) -> bytes:
    """uint32 numbers by byte planes, compressed: the higher planes are nearly empty."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


#: route: a bucket of words (0 and up) or a block (below 0); bucket: -1 for the row with a block's texts.
ROUTED = "route long, block string, bucket int, ids array<bigint>, sizes array<int>, data binary"
_ROUTED = pa.schema([("route", pa.int64()), ("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])


def _route(block: str) -> int:
    return -1 - (int.from_bytes(hashlib.blake2b(block.encode(), digest_size=8).digest(), "little") >> 2)


def _row(route: int, block: str, bucket: int, ids: list | None, sizes: list | None, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((route, block, bucket, ids, sizes, data), _ROUTED, strict=True)], schema=_ROUTED)


def _bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) % buckets for w in words), np.int32, len(words))


def _split(block: str, ids: list, texts: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    split = [words_of(t) for t in texts]
    count: Counter = Counter()
    for words in split:
        count.update(words)
    words = sorted(count, key=count.__getitem__, reverse=True)
    # Numbers go by bucket within the block only when packed; in texts they are ranks by frequency.
    number = {w: i for i, w in enumerate(words)}
    flat = np.fromiter((number[w] for ws in split for w in ws), np.uint32, sum(map(len, split)))
    yield _row(_route(block), block, -1, ids, [len(ws) for ws in split], _squeeze(flat))
    bucket = _bucket_of(words, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield _row(int(bucket[order[a]]), block, int(bucket[order[a]]), None, order[a:b].tolist(), b" ".join([words[i] for i in order[a:b]]))


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids and decoded.

    ids_sha256 is the hex digest of the decimal ids joined by a space, decoded_sha256 that of the decoded
    text. Null and white-space texts have no ids and decode to the empty text. Ids may be null or repeat,
    each row stands for itself; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_EACH

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in sliced(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and size + len(t) > block_bytes:
                    yield from _split(f"{part}-{k}", ids, texts, buckets)
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield from _split(f"{part}-{k}", ids, texts, buckets)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] < 0:
                    continue
                if row["route"] != at:  # rows come sorted by bucket
                    at, known = row["route"], {}
                words = row["data"].split(b" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_words(tokenizer_path, new), strict=True))
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                data = _squeeze(np.concatenate([np.array([len(found)], np.uint32), np.array(row["sizes"], np.uint32), sizes, np.frombuffer(b"".join(found), np.uint32)]))
                yield _row(_route(row["block"]), row["block"], row["bucket"], None, None, data)

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep else {})
        piece = pieces(tokenizer_path) if words.num_rows else []
        for row in texts.to_pylist():
            if row["bucket"] >= 0:
                continue
            numbers = _unsqueeze(row["data"])
            n = int(numbers.max()) + 1 if len(numbers) else 0
            as_ids, as_text, count = [""] * n, [""] * n, np.zeros(n, np.int64)
            for block, data in zip(words.column("block").to_pylist(), words.column("data").to_pylist(), strict=True):
                if block != row["block"]:
                    continue
                packed = _unsqueeze(data)
                m = int(packed[0])
                at, sizes, ids = packed[1 : m + 1], packed[m + 1 : 2 * m + 1], packed[2 * m + 1 :].tolist()
                count[at] = sizes
                end = np.cumsum(sizes).tolist()
                start = 0
                for i, e in zip(at.tolist(), end, strict=True):
                    own = ids[start:e]
                    as_ids[i], as_text[i] = " ".join(map(str, own)), " ".join([piece[x] for x in own])
                    start = e
            start = 0
            empty = bool(n) and not count.all()  # words that the tokenizer drops whole
            for doc_id, size in zip(row["ids"], row["sizes"], strict=True):
                own = numbers[start : start + size]
                start += size
                if empty:
                    own = own[count[own] > 0]
                places = own.tolist()
                said, text = " ".join([as_ids[i] for i in places]), " ".join([as_text[i] for i in places])
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(int(count[own].sum()))
                out["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if keep:
                    out["ids"].append([int(x) for x in said.split()])
                    out["decoded"].append(text)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=False)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    routed = rows.mapInArrow(split, ROUTED).repartition("route")
    encoded = routed.sortWithinPartitions("route", "block").mapInArrow(encode, ROUTED)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if keep else "")
    return routed.groupBy("route").cogroup(encoded.groupBy("route")).applyInArrow(join, schema)
