"""Toxicity: a convolutional text classifier, trained in numpy.

A word's vector joins hashed embeddings of itself and of its first three, four and five letters. Filters
of several widths run over the whole text; each keeps its largest activation (max pooling), and a logistic
layer reads those. Training reads every labelled row outside the held-out fold, whole texts, on the executors:

1. The labelled rows are dealt over tasks by their ids and written once.
2. Document frequencies of all buckets are counted; their log-odds start the embeddings.
3. In each of ``ROUNDS`` rounds every task runs chains of gradient steps over its rows (at most ``CHAIN_ROWS`` rows
   and about ``CHAIN_BYTES`` of text in a chain's memory, as many chains as it takes) from the round's model, and the
   next model is the mean of all chains by rows; an embedding's is over the chains that have moved it.
4. A fifth of the rows is kept out of 2 and 3; all of it calibrates the thresholds.

What tasks send is of fixed size for a task, and what reaches the driver is of fixed size. Scoring runs over whole
texts with a model of fixed size.

Thresholds are calibrated by language. As the language column must not reach a score, the language is
read off the text's function words (``FUNCTION_WORDS``; other languages, and texts without any, count as the
first); one with too few labelled texts of either class gets the threshold of all together. A score is shifted in log-odds so that its language's threshold
lands on ``CUT``; so ``score >= CUT`` is the calibrated decision.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, sliced, text_bytes

#: Buckets of each feature and numbers for a bucket; a word's vector is its features' in a row.
BUCKETS, FEATURES, SUB, WIDTHS, FILTERS = 1 << 15, 4, 4, (1, 2, 3), 8
DIM = FEATURES * SUB
#: Rows of either class that ``training_rows`` draws, for trials with ``train`` on one machine. No query learns from them.
SAMPLE = 2500
#: Rounds after which the chains' models are averaged, and rows and bytes of text that a chain holds at once.
ROUNDS, CHAIN_ROWS, CHAIN_BYTES = 2, 4096, 16 << 20
#: One row in ``HELD`` calibrates, if there are ``HELD_LEAST`` labelled rows. Logits are counted to a multiple of ``GRAIN`` up to ``FAR``.
HELD, HELD_LEAST, GRAIN, FAR = 5, 50, 2.0**-8, 64.0
#: Parts into which figures of all buckets are cut to be summed.
PARTS = 64
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 500, 64, 0.05, 11
CUT = 0.7
#: Words kept with their projections by a task, bytes of text that it scores at once, and words convolved at once.
CACHE_WORDS, BLOCK_BYTES, BLOCK_WORDS = 150_000, 1 << 20, 1 << 15

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that with was for",
    "de": "der die und das zu den von ist nicht mit",
    "fr": "le les des et une dans qui pas est du",
    "es": "el los que y las por una con se del",
}
_LANG_OF = {w.encode(): i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
_EDGE = re.compile(r"^\W+|\W+$")


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself and its first three, four and five letters."""
    text = word.decode("utf-8", "replace").lower()
    if not text.isalnum():
        text = _EDGE.sub("", text)
    return [k * BUCKETS + xxhash.xxh32_intdigest(part.encode()) % BUCKETS for k, part in enumerate((text, text[:3], text[:4], text[:5]))]


def language(words: list[bytes]) -> int:
    """The language whose function words are the most frequent; the first if none occurs."""
    votes = [0] * len(FUNCTION_WORDS)
    for w in words:
        i = _LANG_OF.get(w)
        if i is not None:
            votes[i] += 1
    return votes.index(max(votes))


@dataclass
class Model:
    embed: np.ndarray  # FEATURES * BUCKETS x SUB
    filters: np.ndarray  # DIM x (sum(WIDTHS) * FILTERS): a block for each width and place
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray  # len(WIDTHS) * FILTERS
    base: float
    thresholds: np.ndarray  # log-odds by language

    def score(self, logit: float, lang: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit - self.thresholds[lang] + np.log(CUT / (1 - CUT)), -30, 30))))


_PLACES = [(w, i) for w in WIDTHS for i in range(w)]


def _largest(table: np.ndarray, numbers: np.ndarray, owner: np.ndarray, texts: int, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Largest activation, before the bias, of each filter in each text, and if asked the first place that has it.

    ``table`` has the projections of words, ``numbers`` the words of all texts in a row, ``owner`` the text of each.
    A text without words gets minus infinity.
    """
    size, over = len(WIDTHS) * FILTERS, max(WIDTHS) - 1
    best, found = np.full((texts, size), -np.inf, np.float32), np.zeros((texts, size), np.int64)
    for a in range(0, len(numbers), BLOCK_WORDS):
        n = min(BLOCK_WORDS, len(numbers) - a)
        rows, own = table[numbers[a : a + n + over]], owner[a : a + n + over]
        act, at = np.zeros((n, size), np.float32), 0
        # A window ends with its text: the places whose i-th next word is another text's.
        beyond = [np.flatnonzero(own[i : i + n] != own[: min(n, len(own) - i)]) for i in range(max(WIDTHS))]
        for k, width in enumerate(WIDTHS):
            for i in range(width):
                part = rows[i : i + n, at : at + FILTERS]
                sums = act[: len(part), k * FILTERS : (k + 1) * FILTERS]
                kept = sums[beyond[i]]
                sums += part
                sums[beyond[i]] = kept
                at += FILTERS
        starts = np.flatnonzero(np.diff(own[:n], prepend=-1))
        top, to = np.maximum.reduceat(act, starts), own[starts]
        if places:
            group = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
            column, place = np.nonzero((act == top[group]).T)
            first = np.flatnonzero(np.diff(column * len(starts) + group[place], prepend=-1))
            found[to] = np.where(top > best[to], place[first].reshape(size, -1).T + a, found[to])
        best[to] = np.maximum(best[to], top)
    return best, found


class Words:
    """Numbers of words, in the order in which they come, and the buckets of each."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self._buckets = np.zeros((1024, FEATURES), np.int32)

    def __len__(self) -> int:
        return len(self.number)

    @property
    def buckets(self) -> np.ndarray:
        return self._buckets[: len(self.number)]

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        before, after = len(self.number), len(self.number) + len(new)
        if after > len(self._buckets):
            self._buckets = np.concatenate([self._buckets, np.zeros((max(after, len(self._buckets)), FEATURES), np.int32)])
        if new:
            self._buckets[before:after] = [features(w) for w in new]
            self.number.update(zip(new, range(before, after), strict=True))
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))


def _vectors(embed: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return embed[buckets].reshape(len(buckets), DIM)


Rows = Iterator[tuple[bytes, int]]  #: texts with their labels


def frequencies(rows: Rows) -> np.ndarray:
    """By bucket: the texts of label 0 and of label 1 that hold it."""
    seen, words = np.zeros((FEATURES * BUCKETS, 2), np.int64), Words()
    for text, label in rows:
        if len(words) > CACHE_WORDS:
            words = Words()
        numbers = np.unique(words.of(text.lower().split()))
        seen[np.unique(words.buckets[numbers]), label] += 1
    return seen


@dataclass
class Steps:
    """Parameters in training, with the sums of squared gradients that size their steps."""

    params: list[np.ndarray]  # embed, filters, bias, out, base
    squares: list[np.ndarray]  # of all but base
    share: list[float]  # a row's weight by label: both classes weigh the same
    epochs: int  # of a round

    def model(self) -> Model:
        embed, filters, bias, out, base = self.params
        return Model(embed, filters, bias, out, float(base[0]), np.zeros(len(FUNCTION_WORDS)))

    def fresh(self) -> Steps:
        return Steps([x.copy() for x in self.params], [x.copy() for x in self.squares], self.share, self.epochs)


def begin(seen: np.ndarray, n0: int, n1: int) -> Steps:
    """A bucket's first number starts as its smoothed log-odds by document frequency, the others at random."""
    rng = np.random.default_rng(SEED)
    size = len(WIDTHS) * FILTERS
    odds = np.log((seen[:, 1] + 0.5) / (n1 + 1)) - np.log((seen[:, 0] + 0.5) / (n0 + 1))
    embed = rng.normal(0, 0.05, (FEATURES * BUCKETS, SUB)).astype(np.float32)
    embed[:, 0] = np.where(seen.sum(axis=1) > 2, np.clip(odds, -2, 4) / 4, 0)
    filters = rng.normal(0, 0.2, (DIM, len(_PLACES) * FILTERS)).astype(np.float32)
    filters[::SUB] = np.abs(filters[::SUB]) + 0.2
    params = [embed, filters, np.zeros(size, np.float32), np.full(size, 0.3, np.float32), np.full(1, -1.0, np.float32)]
    n = n0 + n1
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, n)))
    return Steps(params, [np.full_like(x, 1e-2) for x in params[:-1]], [n / (2 * max(n0, 1)), n / (2 * max(n1, 1))], -(-epochs // ROUNDS))


def run_chain(at: Steps, docs: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray, rng: np.random.Generator) -> None:
    """A round's epochs over the texts of one chain; ``docs`` has the word numbers of each."""
    embed, filters, bias, out, base = at.params
    size = len(bias)
    weight = np.where(toxic == 1, at.share[1], at.share[0])
    order = np.flatnonzero(np.fromiter(map(len, docs), np.int64, len(docs)))  # texts without words move nothing

    def step(x: np.ndarray, s: np.ndarray, grad: np.ndarray) -> None:
        s += grad * grad
        x -= (RATE * grad / np.sqrt(s)).astype(np.float32)

    for _ in range(at.epochs):
        rng.shuffle(order)
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            lengths = np.fromiter((len(docs[d]) for d in batch), np.int64, len(batch))
            used, place = np.unique(np.concatenate([docs[d] for d in batch]), return_inverse=True)
            vectors = _vectors(embed, buckets[used])
            best, where = _largest(vectors @ filters, place, np.repeat(np.arange(len(batch)), lengths), len(batch), True)
            pooled = np.maximum(best + bias, 0)
            z = pooled @ out + base[0]
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[batch]) * weight[batch] / len(batch)).astype(np.float32)
            down = g[:, None] * out * (best + bias > 0)
            ends = np.cumsum(lengths)[:, None]
            cells, values, column = [], [], 0
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for i in range(width):
                    ok = (where[:, own] + i < ends) & (down[:, own] != 0)
                    cells.append((place[(where[:, own] + i)[ok]], column + np.nonzero(ok)[1]))
                    values.append(down[:, own][ok])
                    column += FILTERS
            hit, row = np.unique(np.concatenate([x for x, _ in cells]), return_inverse=True)
            cell = row * column + np.concatenate([x for _, x in cells])
            g_proj = np.bincount(cell, np.concatenate(values), len(hit) * column).reshape(-1, column).astype(np.float32)
            g_filters = vectors[hit].T @ g_proj
            rows, to = np.unique(buckets[used[hit]].ravel(), return_inverse=True)
            g_vectors = (g_proj @ filters.T).reshape(-1, SUB)
            g_embed = np.stack([np.bincount(to.ravel(), g_vectors[:, i], len(rows)) for i in range(SUB)], axis=1).astype(np.float32)
            at.squares[0][rows] += g_embed**2
            embed[rows] -= RATE * g_embed / np.sqrt(at.squares[0][rows])
            step(filters, at.squares[1], g_filters)
            step(bias, at.squares[2], down.sum(axis=0))
            step(out, at.squares[3], g @ pooled)
            base -= np.float32(RATE * g.sum())


#: Figures of a bucket that a chain sends: changes of its embedding and squares, and the rows of chains that moved it.
MOVED = 2 * SUB + 1


def chains(at: Steps, rows: Rows, chain_rows: int, chain_bytes: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Runs the rows in chains; the changes by bucket, and those of all else with the number of rows, each times its chain's rows."""
    moved, dense = np.zeros((FEATURES * BUCKETS, MOVED)), 0.0
    rest = iter(rows)
    for k in count():
        words, docs, toxic, held = Words(), [], [], 0
        for text, label in rest:
            docs.append(words.of(text.lower().split()))
            toxic.append(label)
            held += len(text)
            if len(docs) == chain_rows or held >= chain_bytes:
                break
        if not docs:
            return moved, np.zeros(sum(x.size for x in at.params[1:] + at.squares[1:]) + 1) + dense
        mine, n = at.fresh(), len(docs)
        run_chain(mine, docs, np.array(toxic, np.float32), words.buckets, np.random.default_rng([*seed, k]))
        square = mine.squares[0] - at.squares[0]
        moved[:, :SUB] += n * (mine.params[0] - at.params[0])
        moved[:, SUB:-1] += n * square
        moved[:, -1] += n * (square.max(axis=1) > 0)
        changes = [(x - y).ravel() for x, y in zip(mine.params[1:] + mine.squares[1:], at.params[1:] + at.squares[1:], strict=True)]
        dense = dense + n * np.concatenate([*changes, [1.0]])


def averaged(at: Steps, moved: np.ndarray, dense: np.ndarray) -> Steps:
    """The mean of the chains by rows, of an embedding over those that moved it."""
    new = at.fresh()
    mean = moved[:, :-1] / np.maximum(moved[:, -1:], 1)
    new.params[0] += mean[:, :SUB].astype(np.float32)
    new.squares[0] += mean[:, SUB:].astype(np.float32)
    place = 0
    for x in new.params[1:] + new.squares[1:]:
        x += (dense[place : place + x.size] / max(dense[-1], 1)).reshape(x.shape).astype(np.float32)
        place += x.size
    return new


def calibrated(model: Model, found: Iterator[tuple[int, int, float, int]]) -> Model:
    """Sets the thresholds from (language, label, logit, number of rows)."""
    lang, toxic, logits, times = (np.array(x) for x in zip(*found, strict=True))
    every = _threshold(logits, toxic, 0.0, times=times)
    own = [lang == i for i in range(len(FUNCTION_WORDS))]
    model.thresholds = np.array([_threshold(logits[x], toxic[x], every, times=times[x]) for x in own])
    return model


def _grained(logits: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logits, -FAR, FAR) / GRAIN).astype(np.int64)


def _flat(n0: int, n1: int) -> Model:
    """Nothing to tell apart: every text gets the share of label 1 as its score."""
    size = len(WIDTHS) * FILTERS
    share = float(np.clip(n1 / (n0 + n1) if n0 + n1 else 0.0, 1e-3, 1 - 1e-3))
    flat = np.full(len(FUNCTION_WORDS), np.log(CUT / (1 - CUT)))
    return Model(np.zeros((FEATURES * BUCKETS, SUB), np.float32), np.zeros((DIM, len(_PLACES) * FILTERS), np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32), float(np.log(share / (1 - share))), flat)


def train(texts: list[bytes], labels: list[int]) -> Model:
    """The training on one machine, over lists: for trials. A fifth of the rows, dealt evenly, is kept for calibration."""
    toxic = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return _flat(int((toxic == 0).sum()), int((toxic == 1).sum()))
    order = np.concatenate([np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)])
    held = np.zeros(len(texts), bool)
    held[order[::HELD]] = len(texts) >= HELD_LEAST
    fit = [(texts[i], labels[i]) for i in np.flatnonzero(~held)]
    n1 = sum(label for _, label in fit)
    at = begin(frequencies(iter(fit)), len(fit) - n1, n1)
    for k in range(ROUNDS):
        at = averaged(at, *chains(at, iter(fit), CHAIN_ROWS, CHAIN_BYTES, [SEED, k]))
    rows = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    logits, langs = Scorer(at.model()).logits([texts[i] for i in rows])
    return calibrated(at.model(), zip(langs, toxic[rows], _grained(logits) * GRAIN, np.ones(len(rows), np.int64), strict=True))


def _threshold(logits: np.ndarray, toxic: np.ndarray, other: float, least: int = 5, times: np.ndarray | None = None) -> float:
    """The log-odds with the best balanced accuracy, in the middle of its gap; ``other`` if a class has too few rows.

    ``times``: rows that each figure stands for; 1 if left out.
    """
    times = np.ones(len(logits), np.int64) if times is None else times
    n1, n0 = times[toxic == 1].sum(), times[toxic == 0].sum()
    if n1 < least or n0 < least:
        return other
    x, place = np.unique(logits, return_inverse=True)
    ones, noughts = np.bincount(place, times * (toxic == 1)), np.bincount(place, times * (toxic == 0))
    # A cut before place i: the rows from i on count as toxic.
    hit = np.concatenate([[n1], n1 - np.cumsum(ones)]) / n1
    right = np.concatenate([[0], np.cumsum(noughts)]) / n0
    best = np.flatnonzero(np.isclose(hit + right, (hit + right).max()))
    i = int(best[len(best) // 2])
    low, high = x[i - 1] if i else x[0] - 1, x[i] if i < len(x) else x[-1] + 1
    return float((low + high) / 2)


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row (id, label, h) for each labelled id outside the held-out fold.

    Rows without an id or label, or with a label other than 0 and 1, are left out; of several labels of an id the largest counts.
    """
    found = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return found.where((fold("id", 3) != 1) & F.col("label").isin(0, 1)).withColumn("h", F.xxhash64("id", F.lit(SEED)))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[bytes], list[int]]:
    """For trials with ``train``: of either class the ``SAMPLE`` labelled ids with the least hash. ``learn`` does not use it."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    known = known_labels(labels, id_col, label_col)
    chosen = [known.where(F.col("label") == k).orderBy("h", "id").limit(SAMPLE) for k in (1, 0)]
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").groupBy("id", "label", "h").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.h, r.id))
    return [bytes(r.text) for r in rows], [r.label for r in rows]


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """Every row (text, label, held) that may be learned from, whole, dealt over tasks by id and written once.

    A task has about ``chain_rows`` rows, or fewer where a sorted join raises the tasks to ``spark.sql.shuffle.partitions``.
    """
    known = known_labels(labels, id_col, label_col)
    tasks = max(1, -(-known.count() // chain_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).where(F.col("id").isNotNull() & (fold("id", 3) != 1))
    dealt = texts.repartition(tasks, "id").join(known.repartition(tasks, "id"), "id")
    return cut(dealt.sortWithinPartitions("h", "id", "text").select("text", "label", (F.pmod("h", F.lit(HELD)) == 0).alias("held")))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Rows:
    for batch in batches:
        for part in sliced([batch], BLOCK_BYTES):
            yield from zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True)


def _summed(rows: DataFrame, figures: Callable[[int, Rows], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums over all tasks of what ``figures`` makes of a task's number and rows: arrays of fixed shapes.

    Arrays are cut into ``PARTS`` parts; each part is summed by one task in the order of the tasks, so that sums repeat.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        pairs = _pairs(batches)
        first = next(pairs, None)
        if first is None:
            return
        for k, array in enumerate(figures(task, chain([first], pairs))):
            for i, part in enumerate(np.array_split(array, PARTS)):
                yield pa.RecordBatch.from_pydict({"part": [k * PARTS + i], "task": [task], "figures": [part.astype(np.float32).tobytes()]}, _SENT)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("figures"), strict=True):
                new = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
                sums[part] = sums[part] + new if part in sums else new
        for part, total in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "task": [0], "figures": [total.tobytes()]}, _SENT)

    schema = "part int, task int, figures binary"
    found = rows.mapInArrow(sent, schema).repartition(PARTS, "part").sortWithinPartitions("part", "task").mapInArrow(added, schema).collect()
    by_array: dict[int, list[np.ndarray]] = {}
    for r in sorted(found, key=lambda r: r.part):
        by_array.setdefault(r.part // PARTS, []).append(np.frombuffer(bytes(r.figures)))
    return [np.concatenate(parts) for parts in by_array.values()]


_SENT = pa.schema([("part", pa.int32()), ("task", pa.int32()), ("figures", pa.binary())])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", chain_rows: int = CHAIN_ROWS, chain_bytes: int = CHAIN_BYTES) -> Model:
    """Fits filters, embeddings and thresholds on every labelled row outside the held-out fold; repeated ids count by row."""
    rows = labelled_rows(docs, labels, id_col, text_col, label_col, chain_rows)
    counts = {(r.label, r.held): r.n for r in rows.groupBy("label", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = (sum(n for (label, _), n in counts.items() if label == k) for k in (0, 1))
    if not n0 or not n1:
        return _flat(n0, n1)
    apart = n0 + n1 >= HELD_LEAST and (0, False) in counts and (1, False) in counts and any(held for _, held in counts)
    fit, held = (rows.where(~F.col("held")), rows.where("held")) if apart else (rows, rows)
    if apart:
        n0, n1 = counts[0, False], counts[1, False]
    context = docs.sparkSession.sparkContext

    (seen,) = _summed(fit, lambda task, pairs: [frequencies(pairs)])
    at = begin(seen.reshape(-1, 2), n0, n1)
    for k in range(ROUNDS):
        shared = context.broadcast(at)
        found = _summed(fit, lambda task, pairs, k=k, shared=shared: list(chains(shared.value, pairs, chain_rows, chain_bytes, [SEED, k, task])))
        at = averaged(at, found[0].reshape(-1, MOVED), found[1])
        shared.unpersist()

    model = context.broadcast(at.model())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found = Scorer(model.value), Counter()
        for batch in batches:
            for part in sliced([batch], BLOCK_BYTES):
                logits, langs = scorer.logits(part.column("text").to_pylist())
                found.update(zip(langs.tolist(), part.column("label").to_pylist(), _grained(logits).tolist(), strict=True))
        if found:
            lang, label, grain = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(label, pa.int32()), pa.array(grain, pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "label", "grain", "n"])

    sums = held.mapInArrow(counted, "lang int, label int, grain long, n long").groupBy("lang", "label", "grain").agg(F.sum("n").alias("n")).collect()
    return calibrated(at.model(), ((r.lang, r.label, r.grain * GRAIN, r.n) for r in sums))


class Scorer:
    """Scores whole texts, many at once; keeps the projections of recent words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict = defaultdict(count().__next__)
        self.table, self.lang = np.zeros((0, self.model.filters.shape[1]), np.float32), np.zeros(0, np.int64)

    def _numbers(self, split: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words in a row; new ones get their projections and languages."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        before = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        new = list(islice(self.number, before, None))
        if new:
            vectors = _vectors(self.model.embed, np.array([features(w) for w in new]))
            self.table = np.concatenate([self.table, vectors @ self.model.filters])
            self.lang = np.concatenate([self.lang, [_LANG_OF.get(w, len(FUNCTION_WORDS)) for w in new]])
        return numbers

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text, and the number of its language."""
        m = self.model
        split = [t.lower().split() for t in texts]
        numbers = self._numbers(split)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        best, _ = _largest(self.table, numbers, owner, len(texts))
        pooled = np.maximum(np.where(np.isinf(best), 0, best) + m.bias, 0)
        kinds = len(FUNCTION_WORDS) + 1
        votes = np.bincount(owner * kinds + self.lang[numbers], minlength=len(texts) * kinds).reshape(-1, kinds)[:, :-1]
        return pooled @ m.out + m.base, votes.argmax(axis=1)

    def scores(self, texts: list[bytes]) -> list[float]:
        logits, langs = self.logits(texts)
        return [self.model.score(z, lang) for z, lang in zip(logits.tolist(), langs.tolist(), strict=True)]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.7).

    Null and empty texts have no words and get the score of padding; ids may be null or repeat, each row is
    scored by itself; an empty table gives no rows. Without labels of both classes every score is the share
    of label 1. Other columns are not read.
    """
    model = learn(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches, BLOCK_BYTES):
            scores = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 3) == 1).alias("held_out"), text_bytes(text_col).alias("text")).mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches, BLOCK_BYTES, text_col):
            scores = scorer.scores([(t or "").encode() for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array([s < CUT for s in scores], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
