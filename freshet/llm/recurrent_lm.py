"""Scores of whole documents under a gated recurrent language model trained here, in numpy.

The model reads all words above a count in the training documents; any other word is one
unknown word to it, whose own probability is its smoothed share among the unknown ones. Its output is factored into
classes of words. Training is truncated backpropagation through time: whole documents run
through lanes, window after window, and the state is carried from window to window, from
the first word of a document to its end. Every window of every training document is read.
Tasks train on their own documents from the same parameters, which are then averaged.

Counts cover all words of all training documents. The base score and the unknown words
need the count of every word: the most frequent ones are sent to all tasks, a bounded
table, and the rest are looked up by a join.
"""

from __future__ import annotations

import heapq
import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .bytes_table import WordTable, flat_texts, rows_per_text, slices
from .common import crc32_of, session_of, staged, starts_of, with_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The model's words are those with this count and this share of the training words, and the
#: most frequent ones up to a small least number, with the unknown word and the end.
LEAST_COUNT = 5
LEAST_SHARE = 1e-6
VOCABULARY = 1024
#: Words sent to all tasks with their counts, at least.
SENT_WORDS = 1 << 17
HIDDEN = 24
EMBEDDED = 24
#: Documents side by side in training, steps of a window, windows scored at once.
LANES = 512
WINDOW = 16
#: Each training document is read in one of so many rounds, by a hash of its row; parameters are averaged after each.
ROUNDS = 2
RATE_LEARNING = 0.01
#: Steps of the optimizer that each task makes in a round, at least; small data are read again.
LEAST_STEPS = 120
#: Numbers that a step of the optimizer changes at a time, so that they stay in the processor's cache.
UPDATED = 1 << 14
#: Words whose probabilities are found together.
SCORED = 1 << 15
#: Words that a task holds before it counts or scores them.
HELD = 1 << 21
#: Words that a task holds before it trains on them: the longest documents end in windows of few lanes, once each time.
TRAINED = 1 << 23
END = np.uint64(0xA24BAED4963EE407)
#: Tasks' parameters are added up in pieces of so many numbers, by so many tasks.
PIECE = 1 << 16
GROUPS = 16


class Shape:
    """Where each parameter lies in one flat vector.

    A word's probability is that of its class and of its place in the class, and each of
    the two is found in two steps: the group of classes, the class in it, the group of
    places, the place in it. A step is a softmax at a node; ``out0`` to ``out3`` hold the
    weights of the nodes of each step, their last row is the bias.
    """

    def __init__(self, words: int) -> None:
        # class 0 is the unknown word, class 1 the end; the others follow by frequency
        self.words = words
        self.inner = max(math.isqrt(max(words - 3, 0)) + 1, 1)  # words of a class: the root of their number
        self.classes = 2 + -(-max(words - 2, 0) // self.inner)
        self.wide, self.near = math.isqrt(self.classes - 1) + 1, math.isqrt(self.inner - 1) + 1  # of a group
        groups, parts = -(-self.classes // self.wide), -(-self.inner // self.near)
        self.place_groups = parts
        self.parts, at = {}, 0
        for name, shape in {
            "embed": (words, EMBEDDED), "wx": (EMBEDDED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
            "out0": (1, HIDDEN + 1, groups), "out1": (groups, HIDDEN + 1, self.wide),
            "out2": (self.classes, HIDDEN + 1, parts), "out3": (self.classes * parts, HIDDEN + 1, self.near),
        }.items():
            size = int(np.prod(shape))
            self.parts[name] = (slice(at, at + size), shape)
            at += size
        self.size = at

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[part].reshape(shape) for name, (part, shape) in self.parts.items()}

    def class_of(self, word: np.ndarray) -> np.ndarray:
        return np.where(word < 2, word, 2 + (word - 2) // self.inner)

    def place_of(self, word: np.ndarray) -> np.ndarray:
        return np.where(word < 2, 0, (word - 2) % self.inner)

    def steps(self, word: np.ndarray):
        """(parameters, first word, node, branch) of each step to sorted words; the unknown word and the end take two."""
        kind, deep = self.class_of(word), int(np.searchsorted(word, 2))
        group = kind // self.wide
        yield "out0", 0, np.zeros(len(word), dtype=kind.dtype), group
        yield "out1", 0, group, kind - group * self.wide
        if deep < len(word):
            kind, place = kind[deep:], self.place_of(word[deep:])
            part = place // self.near
            yield "out2", deep, kind, part
            yield "out3", deep, kind * self.place_groups + part, place - part * self.near


def initial(shape: Shape, counts: np.ndarray) -> np.ndarray:
    """Small random weights; the output starts at the words' shares."""
    rng = np.random.default_rng(11)
    flat = (rng.normal(size=shape.size) * 0.1).astype(np.float32)
    p = shape.views(flat)
    for name, _, node, branch in shape.steps(np.arange(shape.words)):
        p[name][:] = 0
        mass = np.zeros((p[name].shape[0], p[name].shape[2]))
        np.add.at(mass, (node, branch), counts[-len(node):] + 0.5)
        share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 0.5)
        p[name][:, HIDDEN] = np.log(np.maximum(share, 1e-13))
    p["b"][:] = 0
    p["b"][HIDDEN : 2 * HIDDEN] = -1.0
    return flat


def step(p: dict, x: np.ndarray, h: np.ndarray):
    """One step of the gated unit: reset and update gates, candidate, new state."""
    H = HIDDEN
    u = h @ p["wh"]
    gates = x[:, : 2 * H] + u[:, : 2 * H]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    r, z = gates[:, :H], gates[:, H:]
    c = r * u[:, 2 * H :]
    c += x[:, 2 * H :]
    np.tanh(c, out=c)
    after = c - h
    after *= z
    after += h
    return r, z, c, u[:, 2 * H :], after


class Node:
    """Rows of sorted nodes in blocks of ``size`` rows of one node, which are multiplied together."""

    def __init__(self, node: np.ndarray, size: int) -> None:
        first = starts_of(node)
        self.single = len(first) == 1 and size >= len(node)  # one block holds the rows as they are
        count = np.diff(np.append(first, len(node)))
        blocks = -(-count // size)
        self.met, self.first = node[first], np.cumsum(blocks) - blocks
        more = np.flatnonzero(blocks > 1)
        self.more = list(zip(more.tolist(), first[more].tolist(), (first + count)[more].tolist()))
        run = np.repeat(np.arange(len(first)), blocks)
        begin = first[run] + size * (np.arange(len(run)) - self.first[run])
        place = begin[:, None] + np.arange(size)
        there = place < (first + count)[run][:, None]
        self.node, self.place, self.rows = self.met[run], np.where(there, place, 0), np.flatnonzero(there)
        self.shape = place.shape

    def taken(self, rows: np.ndarray) -> np.ndarray:
        """Rows in blocks; the rest of a block is any row."""
        return rows[None] if self.single else rows[self.place]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Rows in blocks; the rest of a block is zero."""
        if self.single:
            return x[None]
        out = np.zeros((self.shape[0] * self.shape[1], x.shape[1]), dtype=x.dtype)
        out[self.rows] = x
        return out.reshape(*self.shape, -1)

    def flat(self, x: np.ndarray) -> np.ndarray:
        return x[0] if self.single else x.reshape(-1, x.shape[2])[self.rows]

    def products(self, own: np.ndarray, d: np.ndarray, rows: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of each node met, the product of its rows of two matrices, which are given in blocks and whole."""
        out = own[self.first].transpose(0, 2, 1) @ d[self.first]
        for i, a, b in self.more:
            out[i] = rows[a:b].T @ e[a:b]
        return out


def block_size(name: str, rows: int) -> int:
    """Rows of a block by step: nodes of the later steps are many and have few rows."""
    return {"out0": max(rows, 1), "out1": 64, "out2": 16, "out3": 8}[name]


def shares(x: np.ndarray, branch: np.ndarray):
    """Exponentials and their sum by row, and the log of the share of each row's branch."""
    chosen = x[np.arange(len(x)), branch]
    e = np.exp(x)
    total = e @ np.ones(x.shape[1], dtype=x.dtype)
    if not (np.isfinite(total) & (total > 1e-30)).all():  # out of range: from the greatest on
        top = x.max(axis=1)
        chosen = chosen - top
        e = np.exp(x - top[:, None])
        total = e.sum(axis=1)
    return e, total, chosen - np.log(total)


def with_bias(h: np.ndarray) -> np.ndarray:
    out = np.empty((len(h), HIDDEN + 1), dtype=h.dtype)
    out[:, :HIDDEN], out[:, HIDDEN] = h, 1
    return out


def word_log(p: dict, shape: Shape, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log probability of each next word given the state before it."""
    order = np.argsort(word, kind="stable")
    word, h = word[order], with_bias(h[order])
    logs = np.zeros(len(word))
    for name, first, node, branch in shape.steps(word):
        blocks = Node(node, block_size(name, len(word)))
        logs[first:] += shares(blocks.flat(blocks.taken(h[first:]) @ p[name][blocks.node]), branch)[2]
    out = np.empty(len(word))
    out[order] = logs
    return out


def scored(p: dict, shape: Shape, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence of words; the state runs through all of it."""
    n = len(ends) - 1
    length = np.diff(ends)
    order = np.argsort(-length, kind="stable")
    first, length = ends[:-1][order], length[order]
    out = np.zeros(n)
    table = p["embed"] @ p["wx"] + p["b"]
    live, t = n, 0
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    states, nexts, owners, held = [], [], [], 0
    while live and length[0] > t:
        live = int(np.searchsorted(-length, -t, "left"))  # sequences longer than t
        word = words[first[:live] + t]
        states.append(h[:live])
        nexts.append(word)
        owners.append(np.arange(live))
        held += live
        if held > SCORED or t + 1 == length[0]:
            who = np.concatenate(owners)
            out += np.bincount(who, weights=word_log(p, shape, np.concatenate(states), np.concatenate(nexts)), minlength=n)
            states, nexts, owners, held = [], [], [], 0
        h = step(p, table[word], h[:live])[-1]
        t += 1
    back = np.empty(n)
    back[order] = out
    return back


def gradients(p: dict, g: dict, shape: Shape, words: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """Puts the gradients of one window (steps x lanes) into ``g``; returns the state after it.

    ``words`` go in, ``targets`` are the next words (-1: none), and ``fresh`` marks steps
    where a document begins, before which the state is cleared. Only the rows of words
    read and of nodes met are put.
    """
    H, (steps, lanes) = HIDDEN, words.shape
    kept = []
    inputs = p["embed"][words]
    x = inputs @ p["wx"] + p["b"]
    out = np.empty((steps, lanes, H), dtype=x.dtype)
    for t in range(steps):
        if fresh[t].any():
            h = np.where(fresh[t][:, None], 0, h)
        kept.append((h.astype(x.dtype, copy=False), *step(p, x[t], h)))
        h = out[t] = kept[-1][-1]
    last = h
    order = np.flatnonzero(targets.ravel() >= 0)
    order = order[np.argsort(targets.ravel()[order], kind="stable")]
    word, rows = targets.ravel()[order], with_bias(out.reshape(-1, H)[order])
    count, dh_live = max(len(word), 1), np.zeros((len(word), H), dtype=x.dtype)
    for name, first, node, branch in shape.steps(word):
        blocks = Node(node, block_size(name, len(word)))
        w, own = p[name][blocks.node], blocks.taken(rows[first:])
        e, total, _ = shares(blocks.flat(own @ w), branch)
        e *= (1 / (total * count))[:, None]
        e[np.arange(len(e)), branch] -= 1 / count
        d = blocks.spread(e)
        g[name][blocks.met] = blocks.products(own, d, rows[first:], e)
        dh_live[first:] += blocks.flat(d @ w[:, :H].transpose(0, 2, 1))
    dout = np.zeros((steps * lanes, H), dtype=x.dtype)
    dout[order] = dh_live
    dout = dout.reshape(steps, lanes, H)
    dh = np.zeros((lanes, H), dtype=x.dtype)
    dx, du = (np.empty((steps, lanes, 3 * H), dtype=x.dtype) for _ in range(2))
    back = np.ascontiguousarray(p["wh"].T)
    for t in range(steps - 1, -1, -1):
        h0, r, z, c, uc, _ = kept[t]
        dh += dout[t]
        dc = dh * z
        dc *= 1 - c * c
        dx[t, :, :H] = dc * uc * r * (1 - r)
        dx[t, :, H : 2 * H] = dh * (c - h0) * z * (1 - z)
        dx[t, :, 2 * H :] = dc
        du[t, :, : 2 * H] = dx[t, :, : 2 * H]
        np.multiply(dc, r, out=du[t, :, 2 * H :])
        dh *= 1 - z
        dh += du[t] @ back
        if fresh[t].any():
            dh[fresh[t]] = 0
    flat_dx, before = dx.reshape(-1, 3 * H), np.concatenate([k[0] for k in kept])
    g["wh"][:] = before.T @ du.reshape(-1, 3 * H)
    g["wx"][:] = inputs.reshape(-1, EMBEDDED).T @ flat_dx
    g["b"][:] = np.ones(len(flat_dx), dtype=x.dtype) @ flat_dx
    order = np.argsort(words.ravel(), kind="stable")
    read = words.ravel()[order]
    first = starts_of(read)
    g["embed"][read[first]] = np.add.reduceat((flat_dx @ p["wx"].T)[order], first, axis=0)
    return last


class Put:
    """Rows of a parameter and their gradients, as they were put."""

    rows, value = slice(0), None

    def __setitem__(self, rows, value: np.ndarray) -> None:
        self.rows, self.value = rows, value


class Trainer:
    """Adam on windows of documents that run side by side."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat = shape, flat.copy()
        self.m, self.v, self.t = np.zeros_like(flat), np.zeros_like(flat), 0
        self.views = [shape.views(x) for x in (self.flat, self.m, self.v)]

    def update(self, gradient: dict[str, Put]) -> None:
        """A step along the gradient; only rows of the words read and the nodes met have changed."""
        parts = [(name, put.rows, put.value) for name, put in gradient.items() if put.value is not None]
        size = np.sqrt(sum(float(np.vdot(g, g)) for _, _, g in parts))
        self.t += 1
        rate = RATE_LEARNING * min(1.0, 30 / max(self.t, 1) ** 0.5 * 0.2)
        first, second = 1 - 0.9**self.t, 1 - 0.99**self.t
        shrink, pace = np.float32(1 / max(size, 1)), np.float32(rate / first)
        for name, rows, grown in parts:
            flat, m, v = (x[name] for x in self.views)
            many = len(grown) if isinstance(rows, slice) else max(UPDATED * len(grown) // grown.size, 1)
            for k in range(0, len(grown), many):
                g = grown[k : k + many] * shrink
                at = rows if isinstance(rows, slice) else rows[k : k + many]
                m_at, v_at = m[at], v[at]
                m_at = m_at + np.float32(0.1) * (g - m_at)
                g *= g
                g -= v_at
                g *= np.float32(0.01)
                g += v_at
                m[at], v[at] = m_at, g
                g *= np.float32(1 / second)
                np.sqrt(g, out=g)
                g += np.float32(1e-8)
                m_at *= pace
                m_at /= g
                flat[at] -= m_at

    def run(self, words: np.ndarray, ends: np.ndarray, least: int) -> int:
        """One pass, or as many as make ``least`` updates, over whole documents dealt to lanes."""
        total = len(words)
        lanes = int(min(LANES, max(1, total // (4 * WINDOW)), len(ends) - 1))
        length = np.diff(ends)
        # the longest documents first, each to the lane with the fewest words
        heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-length, kind="stable"):
            have, k = heapq.heappop(heap)
            own[k].append(i)
            heapq.heappush(heap, (have + int(length[i]), k))
        own = [own[k] for have, k in sorted(heap, key=lambda e: -e[0])]
        flow = np.concatenate([words[ends[i] : ends[i + 1]] for lane in own for i in lane])
        size = np.array([sum(int(length[i]) for i in lane) for lane in own])
        first = np.cumsum(size) - size
        begins = np.zeros(total, dtype=bool)
        begins[np.cumsum([0, *(length[i] for lane in own for i in lane)])[:-1]] = True
        done = 0
        while done < max(least, 1):
            h = np.zeros((lanes, HIDDEN), dtype=np.float32)
            for t in range(0, int(size[0]), WINDOW):
                live = int(np.searchsorted(-size, -t, "left"))  # lanes longer than t
                place = np.arange(t, min(t + WINDOW, int(size[0])))[:, None]
                there = place < size[:live]
                at = np.where(there, first[:live] + place, 0)
                # a document's first word is predicted from the cleared state: the end goes in before it
                fresh = begins[at] & there
                into = np.where(fresh | ~there, 1, flow[at - 1])
                target = np.where(there, flow[at], -1)
                gradient = {name: Put() for name in self.shape.parts}
                h = gradients(self.views[0], gradient, self.shape, into, target, fresh, h[:live])
                self.update(gradient)
                done += 1
        return total


def tokenized(batches, columns, known: np.ndarray | None = None):
    """(batch, first, last, text of each word, code of each word) with the ends as words."""
    words = WordTable()
    for batch in batches:
        data, bounds = flat_texts(batch.column("text"))
        for first, last in slices(bounds):
            _, _, text, codes = words(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            n = last - first
            at = rows_per_text(text, n)[1:]
            yield batch, first, last, np.insert(text, at, np.arange(n)), np.insert(codes, at, END)


class Places:
    """Places of codes in a sorted table, or its length; hashes are found by their first bits."""

    def __init__(self, codes: np.ndarray) -> None:
        bits = len(codes).bit_length() + 2
        self.codes, self.shift = np.append(codes, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        self.first = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.first[codes >> self.shift]
        there = self.codes[at]
        late = np.flatnonzero(there < codes)
        while len(late):
            at[late] += 1
            there[late] = self.codes[at[late]]
            late = late[there[late] < codes[late]]
        at[there != codes] = len(self.codes) - 1
        return at


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of all words and ends; every task adds up its own before they are shuffled."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def report():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["code", "n"])

        for _, _, _, _, codes in tokenized(batches, None):
            held.append(codes)
            n += len(codes)
            if n >= HELD:
                yield report()
                held, n = [], 0
        if held:
            yield report()

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> DataFrame:
    """The first ``words`` rows of (code, n) by count; rows of counts that cannot be among them are not sorted."""
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()
    enough = np.flatnonzero(np.cumsum(levels["words"].to_numpy()) >= words)
    if len(enough):
        counts = counts.where(F.col("n") >= int(levels["n"][int(enough[0])].as_py()))
    return counts.orderBy(F.desc("n"), "code").limit(words)


def trained(docs: DataFrame, shape: Shape, flat: np.ndarray, codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, int]:
    """Parameters after all rounds of training on ``docs`` (row, text), and the number of words read."""
    spark = docs.sparkSession
    read = 0

    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((flat, codes, words))

        def run(batches, sent=sent):
            import pyarrow as pa

            flat, codes, values = sent.value
            place_of, word_at = Places(codes), np.append(values, 0).astype(np.int32)
            trainer, held, n, total = Trainer(shape, flat), [], 0, 0

            def learn(least: int):
                nonlocal held, n, total
                if held:
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in held])])
                    total += trainer.run(np.concatenate(held), ends, least)
                held, n = [], 0

            for batch, first, last, text, code in tokenized(batches, None):
                word = word_at[place_of(code)]
                at = rows_per_text(text, last - first)
                held.extend(word[at[i] : at[i + 1]] for i in range(last - first))
                n += len(word)
                if n >= TRAINED:
                    learn(0)
            learn(LEAST_STEPS - trainer.t)
            # in pieces, so that no task or driver holds the vectors of several tasks
            for k in range(0, shape.size if total else 0, PIECE):
                vector = trainer.flat[k : k + PIECE].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([total], pa.int64()), pa.array([vector], pa.binary())], ["g", "n", "v"])

        def add(batches):
            import pyarrow as pa

            sums: dict[int, list] = {}
            for batch in batches:
                for g, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                    have = sums.setdefault(g, [0, 0.0])
                    have[0] += n
                    have[1] = have[1] + n * np.frombuffer(v, np.float32).astype(np.float64)
            for g, (n, v) in sums.items():
                mean = (v / n).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int64()), pa.array([n], pa.int64()), pa.array([mean], pa.binary())], ["g", "n", "v"])

        kind = "g long, n long, v binary"
        own = docs.where(F.pmod(F.xxhash64(F.col("row"), F.lit("round")), F.lit(ROUNDS)) == number)
        # a model per core and not per piece of a file, so that what the models take on disk does not grow with the documents
        own = own.coalesce(spark.sparkContext.defaultParallelism)
        parts = own.mapInArrow(run, kind).repartition(GROUPS, "g").mapInArrow(add, kind).collect()
        if parts:
            flat = flat.copy()
            for r in parts:
                flat[r.g : r.g + PIECE] = np.frombuffer(r.v, np.float32)
            read += parts[0].n
        sent.destroy()  # its copies lie on the disks of the driver and all executors
    return flat, read


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """Log probabilities of whole documents under a model learned from the other folds.

    A document is held out if crc32 of its id as text leaves the remainder ``fold`` by
    ``folds``. Tokens are words between ASCII white space in lower case (A-Z), then one end.
    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (log10 under smoothed word shares) and score (log10 under the model).

    Null and empty texts are the end alone. Rows with a null id belong to the fold of the
    empty id text; repeated rows are scored each. Other columns are ignored. Without
    training documents the model is uniform over the end and the unknown word. An empty
    table gives an empty result.
    """
    spark = session_of(docs)
    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    held_out = crc32_of("doc_id") % folds == fold
    learn = rows.where(~held_out).select("row", "text")
    counts = staged(word_counts(learn), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where((F.col("n") >= LEAST_COUNT) & (F.col("n") >= LEAST_SHARE * total)).count()
    size = max(VOCABULARY - 2, frequent)
    top = most_frequent(counts, max(SENT_WORDS, size + 1)).toArrow()
    top_code, top_n = top["code"].to_numpy().view(np.uint64), top["n"].to_numpy()
    plain = top_code != END
    model_code = np.concatenate([[END], top_code[plain][:size]]).astype(np.uint64)
    model_n = np.concatenate([top_n[~plain][:1] if (~plain).any() else [0], top_n[plain][:size]])
    unknown_n, unknown_kinds = total - int(model_n.sum()), max(distinct - int((model_n > 0).sum()), 0)
    shape = Shape(len(model_code) + 1)
    order = np.argsort(model_code)
    model = (model_code[order], order + 1)
    flat = initial(shape, np.concatenate([[unknown_n], model_n]))
    if total:
        flat, _ = trained(learn, shape, flat, *model)
    # the words of the model and the most frequent ones, which have nearly all of them, as one table
    codes = np.union1d(model_code, top_code)
    word_at, n_at = np.zeros(len(codes) + 1, dtype=np.int32), np.full(len(codes) + 1, -1)
    word_at[np.searchsorted(codes, model_code)] = np.arange(1, len(model_code) + 1)
    n_at[np.searchsorted(codes, top_code)] = top_n
    sent = spark.sparkContext.broadcast((flat, codes, word_at, n_at))

    def run(batches):
        import pyarrow as pa

        flat, codes, word_at, n_at = sent.value
        p, place_of = shape.views(flat), Places(codes)
        names = ["row", "code", "tf", "doc_id", "n_tokens", "known", "logs", "unknown", "unknown_logs", "model"]
        held: list = []
        n = 0

        def finish():
            ends = np.concatenate([[0], np.cumsum([len(h[-1]) for h in held])])
            logs = scored(p, shape, np.concatenate([h[-1] for h in held]).astype(np.int64), ends) / np.log(10)
            rows, ids, *numbers_ = zip(*(h[:-1] for h in held))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
            none = pa.nulls(len(held), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), none, none, pa.array(ids, pa.int64()),
                 *(pa.array(c, k) for c, k in zip(numbers_, kinds)), pa.array(logs)], names)

        for batch, first, last, text, code in tokenized(batches, None):
            m = last - first
            row, ids = batch.column("row").to_numpy()[first:last], batch.column("doc_id").to_pylist()[first:last]
            place = place_of(code)
            word, count = word_at[place], n_at[place]
            sent_here, unknown = count >= 0, word == 0
            logs = np.where(sent_here, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            size = np.bincount(text, minlength=m)
            sums = [np.bincount(text, weights=w, minlength=m) for w in (sent_here, logs, unknown, np.where(unknown, logs, 0.0))]
            at = rows_per_text(text, m)
            for i in range(m):
                held.append((row[i], ids[i], size[i], int(sums[0][i]), sums[1][i], int(sums[2][i]), sums[3][i], word[at[i] : at[i + 1]]))
            n += len(word)
            rare = ~sent_here
            order = np.lexsort((code[rare], text[rare]))
            t, c = text[rare][order], code[rare][order]
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])[: len(t)])
            tf = np.diff(np.append(new, len(t)))
            none = pa.nulls(len(new))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[t[new]], pa.int64()), pa.array(c[new].view(np.int64)), pa.array(tf.astype(np.int64)),
                 *(none.cast(k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()))], names)
            if n >= HELD:
                yield finish()
                held, n = [], 0
        if held:
            yield finish()

    found = staged(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, code long, tf long, doc_id long, n_tokens long, known long, logs double, unknown long, "
             "unknown_logs double, model double"), "scored")
    rare = found.where("code is not null").select("row", "code", "tf").join(counts, "code", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"))
    out = found.where("code is null").join(rare, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    score = F.col("model") + F.col("unknown_logs") + rare_logs - F.col("unknown") * float(
        np.log10(unknown_n + 0.5 * (unknown_kinds + 1)))
    return out.select(
        "doc_id", (crc32_of("doc_id") % folds == fold).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
