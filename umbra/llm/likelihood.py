"""Masked pseudo-likelihood: how probable a bidirectional window network finds each word of a text.

The network's vocabulary are the most frequent words of the whole corpus; other words share
buckets by their ending and length. Counts of all words, a distributed table that grows with
the corpus, say how probable a word is within its bucket: its count over the bucket's and
one, which is left for words that the corpus lacks. Every word is predicted from ``WINDOW``
words on both sides: their embeddings, scaled by place, add up to a hidden layer, and a softmax
over classes and one within the class give the probability of its word or bucket.

Texts become numbers once. A hash deals documents, whatever partition they come from, to
learners and rounds; in a round every learner starts from the same weights and runs Adagrad over
its documents of that round in the order of their hashes, predicting every place; the learners'
weights are averaged by the places that they saw, in two levels. So every place is a target
once, and the scores do not depend on how the table is partitioned. A text's score is the sum of
the conditional log-probabilities of its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import sub_batches
from .quality import line_hashes, words_of
from .shared import cut

CLASSES, PER_CLASS, BUCKETS = 64, 64, 256
WIDTH, WINDOW = 16, 3
BATCH, RATE = 4096, 0.1
SUB_BATCH, CHUNK = 2_000_000, 32_768
#: Rounds of averaging; words that a learner is meant for, and learners at most (beyond, each has more words).
ROUNDS, LEARNER_WORDS, MOST_LEARNERS = 3, 2_000_000, 4096
#: Words beside the vocabulary, the most frequent ones, whose counts every worker holds at 16 bytes each; the others' are joined.
HELD = 400_000
SEED = 5


class Network:
    """Weights in one flat vector, so that they can be averaged."""

    def __init__(self, weights: np.ndarray | None = None):
        self.size = CLASSES * PER_CLASS
        shapes = {"embed": (self.size + 1, WIDTH), "place": (2 * WINDOW, WIDTH), "bias": (WIDTH,), "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,), "to_word": (CLASSES, WIDTH, PER_CLASS), "word_bias": (CLASSES, PER_CLASS)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        if weights is None:
            rng = np.random.default_rng(SEED)
            weights = (rng.standard_normal(ends[-1]) * 0.1).astype(np.float32)
        self.weights = weights
        for (name, shape), end in zip(shapes.items(), ends, strict=True):
            setattr(self, name, weights[end - int(np.prod(shape)) : end].reshape(shape))

    @classmethod
    def start(cls) -> Network:
        net = cls()
        net.place += 1.0
        net.embed[-1] = 0  # beyond either end of a text
        return net

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.broadcast_to(self.bias, (len(around), WIDTH)).copy()
        for k in range(2 * WINDOW):
            total += self.embed[around[:, k]] * self.place[k]
        return np.tanh(total)

    def log_probs(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word given the ``2 * WINDOW`` words around it."""
        return self._logs(self.hidden(around), words)

    def log_probs_run(self, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same for the places ``at`` of a run of ids, as in :meth:`train_run`."""
        return self._logs(np.tanh(self._sums(run)[0][at - WINDOW]), run[at])

    def _sums(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """What enters the hidden layer at each place of a run but the first and last ``WINDOW``, the run's embeddings, and the steps around."""
        last, embedded, steps = len(run) - 2 * WINDOW, self.embed[run], [k + (k >= WINDOW) for k in range(2 * WINDOW)]
        total = np.broadcast_to(self.bias, (last, WIDTH)).copy()
        for k, a in enumerate(steps):
            total += embedded[a : a + last] * self.place[k]
        return total, embedded, steps

    def _logs(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        class_, inner = np.divmod(words, PER_CLASS)
        out = _log_softmax(h @ self.to_class + self.class_bias, class_)
        for c, rows in _by_class(class_):
            out[rows] += _log_softmax(h[rows] @ self.to_word[c] + self.word_bias[c], inner[rows])
        return out

    def train(self, around: np.ndarray, words: np.ndarray, seen: np.ndarray) -> None:
        """One Adagrad step; ``seen`` are the sums of squares so far, like the weights."""
        grad = Network(np.zeros_like(self.weights))
        back = self._errors(self.hidden(around), words, grad)
        for k in range(2 * WINDOW):
            grad.place[k] = (back * self.embed[around[:, k]]).sum(0)
        self._descend(grad, around.ravel(), (back[:, None, :] * self.place).reshape(-1, WIDTH), len(words), seen)

    def train_run(self, run: np.ndarray, at: np.ndarray, seen: np.ndarray) -> None:
        """The same step for the places ``at`` of a run of ids, which has ``WINDOW`` ids before the first and after the last of them; looks up each id once."""
        grad, n, last = Network(np.zeros_like(self.weights)), len(at), len(run) - 2 * WINDOW
        total, embedded, steps = self._sums(run)
        back = np.zeros_like(total)
        back[at - WINDOW] = self._errors(np.tanh(total[at - WINDOW]), run[at], grad)
        spread = np.zeros_like(embedded)
        for k, a in enumerate(steps):
            grad.place[k] = np.einsum("ij,ij->j", back, embedded[a : a + last])
            spread[a : a + last] += back * self.place[k]
        self._descend(grad, run, spread, n, seen)

    def _errors(self, h: np.ndarray, words: np.ndarray, grad: Network) -> np.ndarray:
        """What the hidden layers' sums get back; ``grad`` gets all but the places' and the embeddings' share."""
        n, (class_, inner) = len(words), np.divmod(words, PER_CLASS)
        wrong = _softmax(h @ self.to_class + self.class_bias)
        wrong[np.arange(n), class_] -= 1
        grad.to_class[:], grad.class_bias[:] = h.T @ wrong, wrong.sum(0)
        back = wrong @ self.to_class.T
        for c, rows in _by_class(class_):
            own = h[rows]
            wrong = _softmax(own @ self.to_word[c] + self.word_bias[c])
            wrong[np.arange(len(rows)), inner[rows]] -= 1
            grad.to_word[c], grad.word_bias[c] = own.T @ wrong, wrong.sum(0)
            back[rows] += wrong @ self.to_word[c].T
        back *= 1 - h * h
        grad.bias[:] = back.sum(0)
        return back

    def _descend(self, grad: Network, ids: np.ndarray, spread: np.ndarray, n: int, seen: np.ndarray) -> None:
        for d in range(WIDTH):
            grad.embed[:, d] = np.bincount(ids, spread[:, d], self.size + 1)
        grad.embed[-1] = 0
        step = grad.weights / np.float32(n)
        seen += step * step
        self.weights -= np.float32(RATE) * step / (np.sqrt(seen) + np.float32(1e-6))


def _by_class(class_: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The classes that occur, and the places of each."""
    order = np.argsort(class_.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(class_[order], np.arange(CLASSES + 1)).tolist()
    return ((c, order[a:b]) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of rows less a number, and that number: one for all rows where none can then vanish or overflow, else each row's largest."""
    top = float(np.abs(x).max(initial=0))
    shift = 0.0 if top < 40 else x.max(1, keepdims=True)
    return np.exp(x - shift if top >= 40 else x), shift


def _softmax(x: np.ndarray) -> np.ndarray:
    e, _ = _exp(x)
    e /= (e @ np.ones(x.shape[1], x.dtype))[:, None]
    return e


def _log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    e, shift = _exp(x)
    return (x - shift)[np.arange(len(x)), at] - np.log(e @ np.ones(x.shape[1], x.dtype))


class Vocabulary:
    """Ids of words: the frequent ones by frequency, then buckets. ``held``: sorted hashes of further words, and the logarithms of their counts."""

    def __init__(self, words: list[str], held: tuple[np.ndarray, np.ndarray] | None = None):
        codes = line_hashes(pa.array(words, pa.large_string())).view(np.int64)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.held = held or (np.zeros(0, np.int64), np.zeros(0))

    def number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the number of words of each text."""
        return self.look_up(texts)[:2]

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """As :meth:`number`; and for each text the sum of the logarithms of the held words' counts, and the hashes of its words that are in buckets and not held."""
        numbers, known, sizes = words_of(pc.ascii_lower(texts))
        codes = line_hashes(known).view(np.int64)
        at, is_known = _find(self.codes, codes)
        ids = np.where(is_known, self.order[at] if len(self.order) else 0, 0).astype(np.int64)
        if not is_known.all():
            ids[~is_known] = bucket_ids(known.filter(pa.array(~is_known)))
        at, is_held = _find(self.held[0], codes)
        is_held &= ~is_known
        logs = np.where(is_held, self.held[1][at] if len(self.held[1]) else 0.0, 0.0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0.0], np.cumsum(logs[numbers])])[ends]
        left = (~is_known & ~is_held)[numbers]
        offsets = np.concatenate([[0], np.cumsum(left)])[ends].astype(np.int32)
        return ids[numbers], sizes, np.diff(sums), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[numbers[left]]))


def _find(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array, and whether it is."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def bucket_ids(words: pa.Array) -> np.ndarray:
    """The id of each word's bucket, by its last two characters and its length (from 12 on alike)."""
    size = pc.min_element_wise(pc.utf8_length(words), 12).cast(pa.large_string())
    kinds = pc.binary_join_element_wise(size, pc.utf8_slice_codeunits(words.cast(pa.large_string()), -2), pa.scalar("", pa.large_string())).dictionary_encode()
    return (CLASSES * PER_CLASS - 1 - (line_hashes(kinds.dictionary) % np.uint64(BUCKETS)).astype(np.int64))[kinds.indices.to_numpy()]


def windows(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids around the places ``at``; past either end of a text an id of its own."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    out = np.full((len(at), 2 * WINDOW), CLASSES * PER_CLASS, np.int64)
    for k, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        there = at + step
        ok = (there >= 0) & (there < len(ids))
        ok[ok] = owner[there[ok]] == owner[at[ok]]
        out[ok, k] = ids[there[ok]]
    return out


def spaced(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``WINDOW`` ids of a text's end after each text that has words, and where in that the words are."""
    sizes = sizes[sizes > 0]
    at = np.arange(len(ids)) + WINDOW * np.repeat(np.arange(len(sizes)), sizes)
    out = np.full(len(ids) + WINDOW * len(sizes), CLASSES * PER_CLASS, np.int64)
    out[at] = ids
    return out, at


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, in lower case, and ``n`` of every word of all texts (``__text``)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in sub_batches(batch, 0, SUB_BATCH):
                numbers, known, _ = words_of(pc.ascii_lower(part))
                yield pa.RecordBatch.from_arrays([known.cast(pa.string()), pa.array(np.bincount(numbers, minlength=len(known)))], ["word", "n"])

    return texts.select("__text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, most: int = CLASSES * PER_CLASS - BUCKETS, counts: DataFrame | None = None) -> list[str]:
    """The ``most`` most frequent words of all texts (``__text``), in lower case; the count covers every word."""
    counts = word_counts(texts) if counts is None else counts
    # a plain limit would send every partition's candidates to the driver; ranks within parts leave a fixed number
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "word"))
    ranked = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(16))).withColumn("rank", rank).filter(F.col("rank") <= most)
    return [r["word"] for r in ranked.select("word", "n").orderBy(F.desc("n"), "word").limit(most).collect()]


def bucket_counts(counts: DataFrame, words: list[str]) -> tuple[DataFrame, np.ndarray]:
    """``__word`` (hash) and ``n`` of the words beside ``words`` that occur twice or more, and the sum of all words' counts in each bucket."""
    known = F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in words], "word string"))  # as many as the network has
    others = counts.join(known, "word", "left_anti")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(line_hashes(batch.column(0)).view(np.int64)), pa.array(bucket_ids(batch.column(0))), batch.column(1)], ["__word", "bucket", "n"])

    shares, total = cut(others.mapInArrow(hashed, "__word long, bucket long, n long")), np.zeros(BUCKETS, np.int64)
    for r in shares.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many as there are buckets
        total[CLASSES * PER_CLASS - 1 - r["bucket"]] = r["n"]
    return shares.filter("n > 1").select("__word", "n"), total


def held_counts(shares: DataFrame, most: int = HELD) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """``shares`` (``__word``, ``n``) without its most frequent words, about ``most`` and no more; and those, sorted, with the logarithms of their counts."""
    step = F.floor(F.log2("n") * 8).cast("int")
    limit, total = 1 << 30, 0
    for r in sorted(shares.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):  # at most 8 * 64
        total += r["words"]
        if total > most:
            break
        limit = r["step"]
    table = shares.filter(step >= limit).toArrow()
    codes, n = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(codes, kind="stable")
    return shares.filter(step < limit), (codes[order], np.log(n[order]))


def number(docs: DataFrame, words: list[str], learners: int, held: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Of ``docs`` (``__id``, ``__text``), cut: ``__id``, ``__learner``, ``__round``, ``__at`` (a hash), ``__n`` words, ``__ids``, ``__sum`` and ``__words`` as in :meth:`Vocabulary.look_up`.

    A row's hash is that of its id and text; rows with a null id are dealt out by their place in the table, so that copies do not all have one learner.
    """
    shared = docs.sparkSession.sparkContext.broadcast(held or (np.zeros(0, np.int64), np.zeros(0)))
    names = ["__id", "__hash", "__at", "__n", "__ids", "__sum", "__words"]
    kinds = [docs.schema["__id"].dataType, T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.DoubleType(), T.ArrayType(T.LongType())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words, shared.value)
        for batch in batches:
            for rows, texts in sub_batches(batch, 3, SUB_BATCH):
                ids, sizes, sums, rest = vocabulary.look_up(texts)
                ends = np.concatenate([[0], np.cumsum(sizes * 2)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(sizes), packed, pa.array(sums), rest], names)

    key = F.coalesce(F.col("__id").cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
    hashed = docs.select("__id", F.xxhash64("__text", key).alias("__hash"), F.xxhash64("__text").alias("__at"), "__text")
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    done = hashed.mapInArrow(run, schema)
    done = done.withColumn("__learner", F.pmod("__hash", F.lit(learners))).withColumn("__round", F.pmod(F.shiftright("__hash", 32), F.lit(rounds)).cast("int"))
    return cut(done.repartition(learners, "__learner").sortWithinPartitions("__learner", "__at").drop("__hash"))


def _ids(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and how many each row has."""
    packed = batch.column(column).cast(pa.large_binary())
    sizes = pc.binary_length(packed).to_numpy() // 2
    raw = packed.buffers()[2]
    begin = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset] if len(packed) else 0
    return (np.frombuffer(raw, "<u2")[begin // 2 : begin // 2 + sizes.sum()] if raw else np.zeros(0, "<u2")).astype(np.int64), sizes


class _Learner:
    """Trains on the texts it is given, a batch of places at a time."""

    def __init__(self, start: np.ndarray):
        half = len(start) // 2
        self.net, self.seen = Network(start[:half].copy()), start[half:].copy()
        self.run, self.at, self.places = np.full(WINDOW, self.net.size), np.zeros(0, np.int64), 0

    def learn(self, ids: np.ndarray, sizes: np.ndarray, last: bool = False) -> None:
        more, there = spaced(ids, sizes)
        run, at = np.concatenate([self.run, more]), np.concatenate([self.at, there + len(self.run)])
        whole = len(at) if last else len(at) // BATCH * BATCH
        for a in range(0, whole, BATCH):
            here = at[a : min(a + BATCH, whole)]
            self.net.train_run(run[here[0] - WINDOW : here[-1] + WINDOW + 1], here - here[0] + WINDOW, self.seen)
        begin = (at[whole] if whole < len(at) else len(run)) - WINDOW
        self.run, self.at, self.places = run[begin:], at[whole:] - begin, self.places + whole

    def state(self) -> np.ndarray:
        self.learn(np.zeros(0, np.int64), np.zeros(0, np.int64), last=True)
        return np.concatenate([self.net.weights, self.seen])


def fit(numbered: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The network's weights after ``rounds`` rounds over ``numbered``, each over the documents of that round."""
    blocks, schema = 64, "block long, learner long, places long, weights array<float>"
    start = Network.start().weights
    state = np.concatenate([start, np.zeros_like(start)])

    def learn(given: np.ndarray):
        def told(learner: int, one: _Learner) -> pa.RecordBatch:
            parts = np.array_split(one.state(), blocks)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), pa.array([learner] * blocks), pa.array([one.places] * blocks), pa.array(parts, pa.list_(pa.float32()))], ["block", "learner", "places", "weights"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learner, one = None, None
            for batch in batches:
                owners = batch.column(0).to_numpy()
                edges = np.flatnonzero(owners[1:] != owners[:-1]) + 1
                for a, b in zip([0, *edges], [*edges, len(owners)], strict=True):
                    if a == b:
                        continue
                    if owners[a] != learner:
                        if one:
                            yield told(learner, one)
                        learner, one = int(owners[a]), _Learner(given.value)
                    for c in range(a, b, 2000):
                        one.learn(*_ids(batch.slice(c, min(b, c + 2000) - c), 1))
            if one:
                yield told(learner, one)

        return run

    def average(group: pa.Table) -> pa.Table:
        group = group.sort_by("learner")
        places = group.column("places").to_numpy().astype(np.float64)
        weights = np.stack([np.asarray(w.values) for w in group.column("weights").combine_chunks()])
        mean = (weights * places[:, None]).sum(0) / places.sum()
        return pa.table({"block": group.column("block")[:1], "learner": group.column("learner")[:1], "places": pa.array([int(places.sum())]), "weights": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})

    for k in range(rounds):
        given = numbered.sparkSession.sparkContext.broadcast(state)
        learnt = numbered.filter((F.col("__round") == k) & (F.col("__n") > 0)).select("__learner", "__ids").mapInArrow(learn(given), schema)
        means = learnt.groupBy("block", F.pmod("learner", F.lit(64))).applyInArrow(average, schema).groupBy("block").applyInArrow(average, schema)
        rows = {r["block"]: r["weights"] for r in means.collect()}  # as many weights as the network has
        if rows:
            state = np.concatenate([np.array(rows[b], np.float32) for b in range(blocks)])
    return state[: len(start)]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained_on: DataFrame | None = None, held: int = HELD) -> DataFrame:
    """``id_col``, ``n_words``, ``log_likelihood`` (natural log, summed) and ``per_word`` of every whole text.

    The network learns from ``trained_on`` (a table with both columns), or from ``df`` itself. A
    null or empty text has no words, the sum 0 and no mean. Repeated rows give repeated rows, with
    equal scores; other columns are left out; an empty table gives an empty table. Scores do not
    depend on the partitioning, but for null ids, whose rows are dealt to learners by their place.
    """

    def docs(table: DataFrame) -> DataFrame:
        return table.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))

    corpus = docs(df if trained_on is None else trained_on)
    counts = cut(word_counts(corpus))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = frequent_words(corpus, counts=counts)
    shares, in_buckets = bucket_counts(counts, words)
    rest, known = held_counts(shares, held)
    learners = min(MOST_LEARNERS, max(1, ceil(total / LEARNER_WORDS)))
    numbered = number(docs(df), words, learners, known)
    taught = numbered if trained_on is None else number(corpus, words, learners)
    weights = df.sparkSession.sparkContext.broadcast(fit(taught))
    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("__base", T.DoubleType())])
    rows = numbered.withColumn("__row", F.monotonically_increasing_id())  # of a cut table: the same whenever asked for

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, end = Network(weights.value.copy()), np.full(WINDOW, CLASSES * PER_CLASS)
        within = np.zeros(net.size)
        within[net.size - BUCKETS :] = -np.log(in_buckets + 1.0)[::-1]
        for whole in batches:
            for c in range(0, whole.num_rows, 1000):
                batch = whole.slice(c, 1000)
                ids, sizes = _ids(batch, 3)
                more, there = spaced(ids, sizes)
                text, there = np.concatenate([end, more]), there + WINDOW
                logs = [net.log_probs_run(text[at[0] - WINDOW : at[-1] + WINDOW + 1], at - at[0] + WINDOW) for a in range(0, len(there), CHUNK) if len(at := there[a : a + CHUNK])]
                sums = np.concatenate([[0.0], np.cumsum(np.concatenate([*logs, np.zeros(0)]).astype(np.float64) + within[ids])])
                ends = np.cumsum(sizes)
                base = sums[ends] - sums[ends - sizes] + batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(base)], schema.names)

    scored = rows.select("__row", "__id", "__sum", "__ids").mapInArrow(run, schema)
    # a word that occurs once adds log 1, as one that the corpus lacks
    seen = rows.select("__row", F.explode("__words").alias("__word")).join(rest, "__word").groupBy("__row").agg(F.sum(F.log("n")).alias("__seen"))
    done = scored.join(seen, "__row", "left").select(id_col, "n_words", (F.col("__base") + F.coalesce("__seen", F.lit(0.0))).alias("log_likelihood"))
    return done.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
