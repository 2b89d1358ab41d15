"""Exact removal of long repeated byte strings, by column-wise construction of a collection's BWT.

A string of ``length`` bytes that starts at two places must hold the same anchor: the
place in it whose 32 bytes have the smallest hash. So the corpus is cut into fragments,
maximal runs of windows with one anchor, and only fragments with equal anchors can share
a window; they share it in the same column, counted from the anchor.

Each collection of fragments with one anchor then grows its Burrows-Wheeler transform
column by column, from the right, as Bauer, Cox and Rosone do for sets of reads: a round
inserts one symbol in front of every fragment and updates the order of the suffixes and
the common prefixes of neighbours. Because fragments are aligned, a round needs the
suffixes of one column only, so it reads and writes one symbol per fragment. Columns come
from a file that is read in sequence, and the common prefixes of each column go to
another. A window is repeated if its suffix has ``length`` bytes in common with a
neighbour.

Equal fragments are counted before any text moves, so copies cost one row each.
"""

from __future__ import annotations

import hashlib
import sys
import tempfile

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .bytes_table import BASE, BYTE_CODES, U, flat_texts, mixed
from .common import bitmap, discard, in_bitmap, keyed_runs, session_of, staged, starts_of, texts, with_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 32
#: Bytes hashed at a time. Positions within take 20 bits of a sort key.
CHUNK = 1 << 19
POSITION_BITS = 20
#: Fragments handled together; a collection of more is handled alone, column by column.
FRAGMENTS = 8192
#: Collections of more fragments are cut into blocks of window columns with equal cores; blocks
#: of more different pieces are halved until none has more.
LARGE_COLLECTION = 4096
CORE_COLUMNS = 64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each position, by doubling."""
    h, width = BYTE_CODES[data], 1
    while width < GRAM:
        h = h[: len(h) - width] * U(pow(int(BASE), width, 1 << 64)) + h[width:]
        width *= 2
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    h *= U(0x94D049BB133111EB)
    return h


def prefix_sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers[: len(data)], out=out[1:])
    return out


def fragments(data: np.ndarray, bounds: np.ndarray, length: int, powers: np.ndarray, inverse: np.ndarray):
    """(text, first window, last window, anchor position, anchor hash, content hash) of all fragments.

    Positions count from the start of ``data``, the concatenated texts.
    """
    reach = length - GRAM + 1  # gram positions in a window
    out = []
    at = 0
    while len(data) - at >= length:
        part = data[at : at + CHUNK + length - 1]
        h = gram_hashes(part)
        packed = (h >> U(POSITION_BITS + 1) << U(POSITION_BITS + 1)) | np.arange(len(h), dtype=np.uint64)
        low, width = packed, 1
        while 2 * width <= reach:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[: len(packed) - reach + 1], low[reach - width :])
        anchor = (low & U((1 << (POSITION_BITS + 1)) - 1)).astype(np.int64)
        first = np.arange(len(anchor)) + at
        text = np.searchsorted(bounds, first, "right") - 1
        inside = first + length <= bounds[text + 1]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        new &= inside
        begins = np.flatnonzero(new)
        if len(begins):
            stops = np.concatenate([[0], np.cumsum(inside)])
            # the last window of a run: before the next beginning, within the text
            last = np.append(begins[1:], len(anchor)) - 1
            last = begins + (stops[last + 1] - stops[begins]) - 1
            sums = prefix_sums(part, powers)
            span = last - begins + length
            content = (sums[begins + span] - sums[begins]) * inverse[begins]
            content = mixed(content ^ mixed(span.astype(np.uint64)))
            out.append((text[begins], begins + at, last + at, anchor[begins] + at, h[anchor[begins]], content))
        at += CHUNK
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def fragment_rows(docs: DataFrame, length: int) -> DataFrame:
    """anchor, content, row, doc_id, start, windows, shift (anchor from start) of all fragments."""

    def run(batches):
        import pyarrow as pa

        size = CHUNK + length
        step = U(0xD6E8FEB86659FD93)
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, step, np.uint64)]))
        back = U(pow(int(step), -1, 1 << 64))
        inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, back, np.uint64)]))
        for batch in batches:
            data, bounds = flat_texts(batch.column("text"))
            text, first, last, anchor, gram, content = fragments(data, bounds, length, powers, inverse)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), batch.column("row").take(pa.array(text)),
                 pa.array((first - bounds[text]).astype(np.int64)), pa.array((last - first + 1).astype(np.int32)),
                 pa.array((anchor - first).astype(np.int32))],
                ["anchor", "content", "row", "start", "windows", "shift"])

    return docs.mapInArrow(run, "anchor long, content long, row long, start long, windows int, shift int")


class Columns:
    """Bytes of aligned fragments, column by column, in a file that rounds read in sequence."""

    ROWS = 4096

    def __init__(self, width: int) -> None:
        self.width, self.file, self.counts = width, tempfile.TemporaryFile(), []

    def add(self, block: np.ndarray) -> None:
        for i in range(0, len(block), self.ROWS):
            part = block[i : i + self.ROWS]
            self.file.write(np.ascontiguousarray(part.T).tobytes())
            self.counts.append(len(part))

    def column(self, k: int) -> np.ndarray:
        out, at = [], 0
        for n in self.counts:
            self.file.seek(at + k * n)
            out.append(np.frombuffer(self.file.read(n), dtype=np.uint8))
            at += n * self.width
        return np.concatenate(out)


def repeated_windows(columns: Columns, group: np.ndarray, left: np.ndarray, right: np.ndarray, length: int):
    """(fragment, first column, last column) of runs of repeated windows of aligned fragments.

    Fragment i has its windows in columns left[i]..right[i] - length, and its bytes up to
    right[i]; fragments of a group are neighbours. ``order`` lists fragments by group and
    suffix, and ``common`` is the column where a suffix first differs from the one before
    it, so that a round changes it only where the order changes.
    """
    n = len(group)
    order = np.arange(n)
    common = np.full(n + 1, columns.width, dtype=np.int64)  # empty suffixes differ where they end
    open_from = np.full(n, -1, dtype=np.int64)
    found = []
    rank_group = group  # groups stay in place; only the order within them changes
    heads = np.zeros(n, dtype=bool)
    heads[starts_of(rank_group)] = True
    for k in range(columns.width - 1, -1, -1):
        symbol = columns.column(k)[order].astype(np.int64) + 1
        symbol[(right[order] <= k) | (left[order] > k)] = 0  # not begun yet, or at an end
        change = np.zeros(n, dtype=bool)
        change[1:] = symbol[1:] != symbol[:-1]
        change &= ~heads
        if change.any():
            key = rank_group * 257 + symbol
            moved = np.argsort(key, kind="stable")
            symbol = symbol[moved]
            fresh = np.empty(n + 1, dtype=np.int64)
            fresh[n] = 0
            fresh[:n] = common[moved]
            apart = np.zeros(n, dtype=bool)
            apart[1:] = symbol[1:] != symbol[:-1]
            before = np.empty(n, dtype=np.int64)
            before[0], before[1:] = -1, moved[:-1]
            jumped = np.flatnonzero(~apart & ~heads & (before != moved - 1))
            if len(jumped):
                pairs = np.stack([before[jumped] + 1, moved[jumped] + 1], axis=1)
                by = np.argsort(pairs[:, 0], kind="stable")
                least = np.minimum.reduceat(common, pairs[by].ravel())[::2]
                fresh[jumped[by]] = least
            fresh[:n][apart] = k
            order, common = order[moved], fresh
        common[:n][heads | (symbol == 0)] = k
        far = common >= k + length
        window = (left[order] <= k) & (k + length <= right[order])
        hit = window & (far[:n] | (far[1:] & ~np.append(heads[1:], True)))
        now = np.zeros(n, dtype=bool)
        now[order[hit]] = True
        begins, stops = now & (open_from < 0), ~now & (open_from >= 0)
        open_from[begins] = k
        if stops.any():
            rows = np.flatnonzero(stops)
            found.append((rows, np.full(len(rows), k + 1), open_from[rows]))
            open_from[rows] = -1
    rows = np.flatnonzero(open_from >= 0)
    found.append((rows, np.zeros(len(rows), dtype=np.int64), open_from[rows]))
    return tuple(np.concatenate(c) for c in zip(*found))


def shared_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, content, first, last): windows, from the fragment's first, that others share."""
    width = 2 * length

    def run(batches):
        import pyarrow as pa

        for table in keyed_runs(batches, ["key"], FRAGMENTS):
            keys = table["key"].to_numpy()
            shift, cut = table["shift"].to_numpy().astype(np.int64), table["cut"].to_numpy().astype(np.int64)
            columns, left, right = Columns(width), [], []
            for i in range(0, len(keys), Columns.ROWS):
                data = table["bytes"].slice(i, Columns.ROWS).to_pylist()
                block = np.zeros((len(data), width), dtype=np.uint8)
                for j, own in enumerate(data):
                    at = length - shift[i + j]
                    block[j, at : at + len(own)] = np.frombuffer(own, np.uint8)
                    left.append(at)
                    right.append(at + len(own))
                columns.add(block)
            group = np.repeat(np.arange(len(starts_of(keys))), np.diff(np.append(starts_of(keys), len(keys))))
            left, right = np.array(left), np.array(right)
            rows, first, last = repeated_windows(columns, group, left, right, length)
            columns.file.close()
            base = left[rows] - cut[rows]
            yield pa.RecordBatch.from_arrays(
                [table["anchor"].combine_chunks().take(pa.array(rows)), table["content"].combine_chunks().take(pa.array(rows)),
                 pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                ["anchor", "content", "first", "last"])

    dealt = pieces.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "anchor long, content long, first int, last int")


def blocks_of(own: bytes, shift: int, key: int, length: int, width: int):
    """(key, column, cut, bytes) of a fragment's blocks of ``width`` window columns.

    The bytes common to all windows of a block are its core, and only pieces with equal
    cores can share a window of the block.
    """
    column, end = -shift, len(own) - length + 1 - shift  # of the windows, from the anchor
    while column < end:
        block = column // width
        stop = min((block + 1) * width, end)
        core = own[(block + 1) * width - 1 + shift : block * width + shift + length]
        code = hashlib.blake2b(core + b"%d %d" % (key, block), digest_size=8).digest()
        yield int.from_bytes(code, "little", signed=True), column, column + shift, own[column + shift : stop + shift + length - 1]
        column = stop


PIECES = "key long, anchor long, content long, shift int, cut int, bytes binary"


def piece_batch(out: list):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*out) if out else ([],) * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "anchor", "content", "shift", "cut", "bytes"])


def cut_pieces(docs: DataFrame, wanted: DataFrame, length: int, width: int | None = None) -> DataFrame:
    """The bytes of the wanted fragments, whole or in blocks of ``width`` columns."""

    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)
                for f in wanted:
                    own = data[f["start"] : f["start"] + f["windows"] + length - 1]
                    if width is None:
                        out.append((f["anchor"], f["anchor"], f["content"], f["shift"], 0, own))
                        continue
                    for key, column, cut, piece in blocks_of(own, f["shift"], f["anchor"], length, width):
                        out.append((key, f["anchor"], f["content"], -column, cut, piece))
            yield piece_batch(out)

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "shift", "anchor", "content")).alias("wanted"))
    may = in_bitmap(docs.sparkSession, bitmap(wanted.select("row")), "row")
    return may(docs.select("row", "text")).join(lists, "row").select("text", "wanted").mapInArrow(run, PIECES)


def halved(kinds: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces of pieces (key, piece, shift, bytes), in blocks of ``width`` columns."""

    def run(batches):
        for batch in batches:
            out = []
            for key, piece, shift, own in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "shift", "bytes"))):
                for code, column, cut, part in blocks_of(own, shift, key, length, width):
                    out.append((code, key, piece, -column, cut, part))
            yield piece_batch(out)

    return kinds.select("key", "piece", "shift", "bytes").mapInArrow(run, PIECES)


def shared_in_blocks(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """As ``shared_spans``, of pieces in blocks of ``width`` columns, many of which may have one key.

    Pieces of equal bytes are one row; their owners share all of it. A key with more than
    ``LARGE_COLLECTION`` different pieces is cut into blocks of half the width, and so on:
    a block of one column is its own core, so that it has one piece.
    """
    pieces = staged(pieces.withColumn("piece", F.xxhash64("bytes", "shift")), "pieces")
    owners = pieces.select("key", "piece", "anchor", "content", "cut")
    kinds = staged(pieces.groupBy("key", "piece").agg(
        F.count("*").alias("owners"), F.first("shift").alias("shift"), F.first("bytes").alias("bytes")), "pieces")
    full = staged(kinds.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_COLLECTION).select("key"), "full")
    own = kinds.join(full, "key", "left_anti").select(
        "key", F.col("key").alias("anchor"), F.col("piece").alias("content"), "shift", F.lit(0).alias("cut"), "bytes")
    shared = shared_spans(own, length)
    if width > 1 and not full.isEmpty():
        shared = shared.union(shared_in_blocks(halved(kinds.join(full, "key", "left_semi"), length, width // 2), length, width // 2))
    whole = kinds.where("owners > 1").select("key", "piece", F.lit(0).alias("first"), (F.length("bytes") - length).alias("last"))
    spans = shared.toDF("key", "piece", "first", "last").union(whole)
    return owners.join(spans, ["key", "piece"]).select(
        "anchor", "content", (F.col("first") + F.col("cut")).alias("first"), (F.col("last") + F.col("cut")).alias("last"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(row, spans): the byte ranges of each text that strings starting elsewhere cover."""
    every = staged(fragment_rows(docs, length), "fragments")
    # a fragment whose anchor no other has shares nothing
    anchors = staged(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    may = in_bitmap(docs.sparkSession, bitmap(anchors), "anchor")
    found = staged(may(every).join(anchors, "anchor", "left_semi"), "found")
    discard(every, anchors)
    kinds = found.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("row", "start", "windows", "shift")).alias("one"))
    kinds = staged(kinds, "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = staged(kinds.join(several, "anchor").select("one.*", "anchor", "content", "n"), "wanted")
    shared = shared_spans(cut_pieces(docs, wanted.where(F.col("n") <= LARGE_COLLECTION), length), length)
    large = wanted.where(F.col("n") > LARGE_COLLECTION)
    if not large.isEmpty():
        shared = shared.union(shared_in_blocks(cut_pieces(docs, large, length, CORE_COLUMNS), length, CORE_COLUMNS))
    whole = kinds.where("copies > 1").select("anchor", "content", F.lit(0).alias("first"), (F.col("one.windows") - 1).alias("last"))
    covered = shared.union(whole)
    spans = found.join(covered, ["anchor", "content"]).select(
        "row", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b"))
    return spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   digest: bool = False) -> DataFrame:
    """Texts without the bytes that a repeated string of ``length`` bytes covers.

    Texts are UTF-8 bytes; matches lie within one text, may overlap, and are judged on
    the input: both places of a repeat are removed. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept (the remaining bytes) and the given text's other
    columns; with ``digest``, kept_sha256 in place of kept, text (the remaining bytes
    without those of characters that a cut has split) and no other columns.

    Null and empty texts have nothing to remove: ``kept`` is empty, or null for a null
    text, whose digest is that of no bytes. A text that occurs twice, also as a repeated
    row, is removed wholly if it is long enough. Ids may be null or repeated. An empty
    table gives an empty result.
    """
    session_of(docs)
    new = {"n_bytes", "n_removed", "n_spans", "kept"}
    others = [] if digest else [c for c in docs.columns if c not in {id_col, text_col, "row", "spans", "doc_id", "text"} | new]
    numbered = texts(docs, id_col, text_col) if digest else docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others)
    numbered = with_row(numbered)
    spans = repeated_spans(numbered.select("row", "text"), length)
    rows = numbered.join(spans, "row", "left")
    tail = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(*others).schema] if others else []
    last = "kept_sha256 string, text string" if digest else "kept binary"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_bytes, n_removed, n_spans, kept, left = [], [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = merged(spans or [])
                n_bytes.append(len(data))
                n_removed.append(sum(b - a for a, b in runs))
                n_spans.append(len(runs))
                edges = [0, *(x for r in runs for x in r), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else None if text is None else rest)
                if digest:
                    left.append(None if text is None else rest.decode("utf-8", "ignore"))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)),
                       pa.array(kept, pa.string() if digest else pa.binary()), *(batch.column(c) for c in others)]
            if digest:
                columns.append(pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256", "text"] if digest else ["kept", *others])])

    kind = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long", last, *tail])
    return rows.select("doc_id", "text", "spans", *others).mapInArrow(run, kind)


def whole_characters(column: str) -> Column:
    """UTF-8 bytes as text, without the bytes of characters that a cut has split."""
    import pandas as pd

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(v).decode("utf-8", "ignore"))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(column)
