"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

A plan for any number of documents needs only the count of each length, at most
``capacity`` numbers. The plan says how many sequences of which make-up there are;
documents then take the planned slots by their rank among those of equal length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib

import numpy as np
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .common import session_of, staged, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = 0
RANK_BITS = 42
# The published pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(tokenizer_json: bytes) -> dict[bytes, int]:
    """Merge ranks of a byte-level BPE file whose ids follow its merges."""
    model = json.loads(tokenizer_json)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {bytes(back[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in back for c in token)
            and not token.startswith("<|")}


def encoder(tokenizer_json: bytes):
    """A function from texts to lists of ids; the file's added tokens are found in the text first."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_ranks(tokenizer_json), special_tokens={})
    added = {t["content"]: t for t in json.loads(tokenizer_json).get("added_tokens") or []}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values()):
        raise ValueError("added tokens that depend on what surrounds them")
    if not added:
        return own.encode_ordinary
    found = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        first, *rest = found.split(text)
        ids = own.encode_ordinary(first)
        for token, part in zip(rest[::2], rest[1::2]):
            ids.append(added[token]["id"])
            ids.extend(own.encode_ordinary(part))
        return ids

    return encode


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool) -> DataFrame:
    """A row for each piece, with its place among the equally long pieces of its task."""
    with open(tokenizer_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        import pyarrow as pa

        encode = encoder(sent.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, int(seen[b - a]),
                                 ids[a:b].astype(np.int32) if with_ids else None))
                    seen[b - a] += 1
            doc, piece, start, length, crc, tasks, local, ids = zip(*rows) if rows else ([],) * 8
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(tasks, pa.int32()),
                   pa.array(local, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
    return docs.mapInArrow(run, kind + (", ids array<int>" if with_ids else ""))


def best_fit_plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, their make-up of (length, times)): best-fit decreasing on counts.

    The longest pieces come first; each takes the fullest open sequence that has room.
    All sequences of one make-up are one entry, so that the work depends on the number
    of lengths and not on the number of pieces.
    """
    by_room: dict[int, list[tuple[int, list]]] = {}
    rooms: list[int] = []  # sorted

    def put(room: int, count: int, makeup: list) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        by_room[room].append((count, makeup))

    for length in sorted((x for x in lengths if lengths[x]), reverse=True):
        left = lengths[length]
        moved = []
        while left:
            k = int(np.searchsorted(rooms, length))
            if k == len(rooms):
                fit = capacity // length
                whole, rest = divmod(left, fit)
                if whole:
                    moved.append((capacity - fit * length, whole, [(length, fit)]))
                if rest:
                    moved.append((capacity - rest * length, 1, [(length, rest)]))
                break
            room = rooms[k]
            count, makeup = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            fit = room // length
            whole = min(count, left // fit)
            if whole:
                moved.append((room - fit * length, whole, [*makeup, (length, fit)]))
            left -= whole * fit
            if whole < count:
                if 0 < left < fit:
                    moved.append((room - left * length, 1, [*makeup, (length, left)]))
                    left, whole = 0, whole + 1
                if whole < count:
                    put(room, count - whole, makeup)
        for room, count, makeup in moved:
            put(room, count, makeup)
    return [entry for room in rooms for entry in by_room[room]]


def slot_table(plan: list, capacity: int) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length, and the sequences and offsets they take."""
    rows, used, sequence = [], {}, 0
    for count, makeup in plan:
        offset = 0
        for length, times in makeup:
            first = used.get(length, 0)
            rows.append(((length << RANK_BITS) + first, times, sequence, offset, first))
            used[length] = first + count * times
            offset += length * times
        sequence += count
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "times", "sequence", "offset", "first"), columns.T))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``capacity`` tokens.

    A document is its ids and one end id 0; a null or empty text is the end id alone.
    A longer document is cut into pieces of ``capacity`` tokens, the first being the
    shorter one. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids if asked for); the pieces of a sequence follow each other without gaps.
    Repeated rows and ids are packed as often as they occur, null ids as null; other
    columns are ignored; an empty table gives an empty result.
    """
    session_of(docs)
    pieces = staged(pieces_of(texts(docs, id_col, text_col), tokenizer_path, capacity, with_ids), "pieces")
    counts = staged(pieces.groupBy("task", "length").count(), "lengths")
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    sent = pieces.sparkSession.sparkContext.broadcast(slot_table(best_fit_plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(counts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def take(batches):
        import pyarrow as pa

        plan = sent.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(plan["key"], (length << RANK_BITS) + rank, "right") - 1
            nth = rank - plan["first"][at]
            times = plan["times"][at]
            sequence = plan["sequence"][at] + nth // times
            offset = plan["offset"][at] + nth % times * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return ranked.select(*kept, "rank").mapInArrow(take, f"{kind}, sequence_id long, offset long")
