"""Removing passages that came before: exact repeats of ``LENGTH`` bytes across documents.

A text is cut into pieces that any two occurrences of a repeated string share: each window of ``LENGTH`` bytes
belongs to the piece of its rarest ``ANCHOR`` bytes (least hash, leftmost), and a piece holds the neighbouring windows with
one anchor. Equal windows have equal anchors at the same place, so pieces travel to the fragment of their anchor's
hash and every fragment is searched for itself.

A fragment merges equal pieces (one string, its smallest document, its occurrences) and leaves out those whose
surroundings of the anchor occur nowhere else. The others form a collection, for which the Burrows-Wheeler transform and
the longest common prefixes are built column by column: round ``r`` inserts the ``r``-th symbol from the right of every
piece at once, at the place that the symbols so far give by their ranks, and takes its common prefixes from the least
one between neighbours with the same symbol. Transform and prefixes of a large collection lie in sequential files of the
task's own folder and are rewritten once a round. In the finished order, windows that are equal stand together (common prefix of at least
``LENGTH``), and the smallest document of a stand keeps its copy.

Collections are cut at anchors, so their size is bounded by one anchor's distinct strings, and hot anchors (a line that a third of all
documents hold) arrive merged: of equal pieces in a slice of a task only the smallest document's travels, the others are known to be repeats.

Defined cases: a null text is empty; a text under ``LENGTH`` bytes loses nothing; documents with a null id lose nothing and are nobody's
earlier copy; rows with one id do not repeat each other, and each row is returned with its own text's result; other columns are ignored; an empty
table gives an empty result. Bytes are removed; where the cut splits a character, the text form drops its remains.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from docfacts.llm.common import groups_for, joined_bytes, mix, partitions, rolling, slices, thrifty, thrifty_group, written

LENGTH = 50
ANCHOR = 12
#: Distinct pieces that one collection takes on, whole anchors apart.
COLLECTION = 8_000
#: Symbols from which on a collection lies in files.
IN_FILES = 32_000_000
#: Slots of the list of documents that lost something; more documents than slots only make the list say yes more often.
SLOTS = 1 << 20
#: Fragments for each shuffle partition: a task holds one fragment at a time.
FRAGMENTS = 2
#: Bytes of text whose pieces one fragment takes, where the session has fewer shuffle partitions than that gives.
FRAGMENT_BYTES, MOST_FRAGMENTS = 8 << 20, 32_767


def _windowed_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    least, size = values, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    rest = width - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


_PLACE = np.uint64((1 << 28) - 1)
#: Windows whose anchors are sought at a time.
_WINDOWS = 1 << 17


def cut_pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Start, size, anchor place and anchor hash of every piece of joined texts, and its text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none
    powers = rolling()
    sums = powers.sums(data)
    anchor = np.empty(len(data) - length + 1, np.int32)
    for begin in range(0, len(anchor), _WINDOWS):
        end = min(begin + _WINDOWS, len(anchor))
        at = np.arange(begin, end + length - ANCHOR)
        ranked = mix(powers.ranges(sums, at, at + ANCHOR))
        ranked &= ~_PLACE
        ranked |= at.astype(np.uint64)
        anchor[begin:end] = _windowed_least(ranked, length - ANCHOR + 1) & _PLACE
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = text[: len(anchor)] == text[length - 1 :]
    changed = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(inside & np.r_[True, changed | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[changed | ~inside[1:], True])
    place = anchor[first].astype(np.int64)
    # Anchors have small hashes by choice; mixed again they spread evenly.
    return first, last - first + length, place - first, mix(mix(powers.ranges(sums, place, place + ANCHOR))), text[first].astype(np.int64)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after another."""
    total = int(sizes.sum())
    before = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
    return data[np.repeat(starts - before, sizes) + np.arange(total)]


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether two ranges of equal sizes hold equal bytes, some ranges at a time."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        equal = _gathered(data, a[part], sizes[part]) == _gathered(data, b[part], sizes[part])
        out[part] = np.logical_and.reduceat(equal, np.r_[0, np.cumsum(sizes[part])[:-1]])
    return out


def _leaders(data: np.ndarray, key: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order_by: tuple) -> np.ndarray:
    """For each range the index of the first range (in ``order_by``) with the same bytes; ``key`` is a hash of the bytes."""
    order = np.lexsort((*reversed(order_by), key))
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else 0
    other = np.flatnonzero((leader != np.arange(len(leader))))
    fits = sizes[other] == sizes[leader[other]]
    fits[fits] = _same(data, starts[other][fits], starts[leader[other]][fits], sizes[other][fits])
    leader[other[~fits]] = other[~fits]
    return leader


#: Ranges that are hashed or compared at a time.
_AT_ONCE = 8_000


def _piece_keys(data: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """Hashes of each piece, of its anchor, and of the anchor with the bytes to its left and right (0 where they are missing)."""
    whole, anchor, left, right = (np.zeros(len(at), np.uint64) for _ in range(4))
    powers = rolling()
    for begin in range(0, len(at), _AT_ONCE):
        part = slice(begin, begin + _AT_ONCE)
        low = at[part] - at[begin]
        n, p = size[part], place[part]
        sums = powers.sums(data[at[begin] : at[begin] + low[-1] + n[-1]])
        whole[part] = mix(powers.ranges(sums, low, low + n) + n.astype(np.uint64))
        anchor[part] = mix(powers.ranges(sums, low + p, low + p + ANCHOR))
        has = p >= side
        left[part][has] = mix(powers.ranges(sums, (low + p)[has] - side, (low + p)[has] + ANCHOR)) | np.uint64(1)
        has = p + ANCHOR + side <= n
        right[part][has] = mix(powers.ranges(sums, (low + p)[has], (low + p)[has] + ANCHOR + side)) | np.uint64(1)
    return whole, anchor, left, right


_PIECES = ["ids", "marks", "owner", "start", "size", "place", "body"]
_RANGES = ["r_ids", "r_marks", "r_start", "r_stop"]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).astype(kind, copy=False).tobytes())


def _unpack(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    return [np.frombuffer(open_.decompress(x), kind) if x is not None else np.zeros(0, kind) for x in column.to_pylist()]


def _sent_pieces(documents: DataFrame, fragments: int, length: int) -> DataFrame:
    """Pieces packed for each fragment; the ranges known to be repeats go along with one of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            marks = np.array(batch.column("mark").to_pylist(), np.int64)
            data, offsets = joined_bytes(batch.column("text"))
            start, size, place, hashes, text = cut_pieces(data, offsets, length)
            if not len(start):
                continue
            key = mix(rolling().ranges(rolling().sums(data), start, start + size) + size.astype(np.uint64))
            leader = _leaders(data, key, start, size, (ids[text], text))
            repeat = ids[text] != ids[text[leader]]
            where = ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            known = np.flatnonzero(repeat)
            rows = {name: [] for name in ["fragment", *_PIECES, *_RANGES]}
            kept = np.flatnonzero(~repeat)
            kept = kept[np.argsort(where[kept], kind="stable")]
            cut = np.searchsorted(where[kept], np.arange(fragments + 1))
            for f in np.unique(where[kept]):
                k = kept[cut[f] : cut[f + 1]]
                own, owner = np.unique(text[k], return_inverse=True)
                rows["fragment"].append(int(f))
                for name, values, kind in (("ids", ids[own], "<i8"), ("marks", marks[own], "<i8"), ("owner", owner, "<u4"), ("start", np.diff(start[k] - offsets[text[k]], prepend=0), "<i4"), ("size", size[k], "u1"), ("place", place[k], "u1"), ("body", _gathered(data, start[k], size[k]), "u1")):
                    rows[name].append(_pack(values, kind))
                for name, values in zip(_RANGES, (ids[text[known]], marks[text[known]], start[known] - offsets[text[known]], (start + size)[known] - offsets[text[known]])):
                    rows[name].append(_pack(values, "<i8"))
                known = known[:0]
            yield pa.RecordBatch.from_arrays([pa.array(rows["fragment"], pa.int32()), *(pa.array(rows[n], pa.binary()) for n in [*_PIECES, *_RANGES])], ["fragment", *_PIECES, *_RANGES])

    marked = documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    schema = "fragment int, " + ", ".join(f"{c} binary" for c in [*_PIECES, *_RANGES])
    return marked.mapInArrow(thrifty(send), schema)


class Scratch:
    """Arrays in memory, or, where they are large, in files of the task's own folder that go with it."""

    def empty(self, count: int, kind: type) -> np.ndarray:
        if count < IN_FILES:
            return np.empty(count, kind)
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(count,))


def _least_between(prefixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``prefixes[low + 1 .. high]`` for many ranges: doubled minima, one level after another."""
    out = np.zeros(len(low), prefixes.dtype)
    span = high - low
    level = np.frexp(span.astype(float))[1] - 1
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max()) + 2 if len(level) else 1))
    table = prefixes
    for j in range(len(bounds) - 1):
        if j:
            half = 1 << (j - 1)
            table = np.minimum(table[:-half], table[half:])
        asked = order[bounds[j] : bounds[j + 1]]
        if len(asked):
            out[asked] = np.minimum(table[low[asked] + 1], table[high[asked] - (1 << j) + 1])
    return out


def collection_transform(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and common prefixes of all suffixes of a collection of strings.

    ``symbols`` are numbers from 1; 0 is the end of a string, smaller than all, ends in order of their strings. Entry ``i``
    of the prefixes is what suffix ``i`` has in common with the one before it.
    """
    strings = len(starts)
    ends = starts + sizes
    before = lambda which, taken: np.where(sizes[which] > taken, symbols[np.maximum(ends[which] - taken - 1, starts[which])], 0).astype(np.uint8)
    transform, prefixes = before(np.arange(strings), 0), np.zeros(strings, np.uint8)
    place = np.arange(strings)
    for taken in range(1, int(sizes.max()) + 1):
        active = np.flatnonzero(sizes >= taken)
        order = np.argsort(transform, kind="stable")
        rank = scratch.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        closed = int(np.searchsorted(transform[order[: strings + 1]], 1)) if len(order) > strings else int((transform == 0).sum())
        mine = rank[place[active]]
        target = strings + mine - closed
        # What the new suffixes have in common with those before and after them.
        shared = []
        for low, high in ((mine - 1, mine), (mine, mine + 1)):
            value = np.zeros(len(mine), np.uint8)
            valid = (low >= 0) & (high < len(order))
            valid[valid] = transform[order[low[valid]]] == transform[order[high[valid]]]
            value[valid] = 1 + _least_between(prefixes, order[low[valid]], order[high[valid]])
            shared.append(value)
        total = len(transform) + len(active)
        old = np.ones(total, bool)
        old[target] = False
        next_transform, next_prefixes = scratch.empty(total, np.uint8), scratch.empty(total, np.uint8)
        next_transform[old], next_prefixes[old] = transform, prefixes
        next_transform[target] = before(active, taken)
        follows = target + 1 < total
        next_prefixes[target[follows] + 1] = shared[1][follows]
        next_prefixes[target] = shared[0]
        transform, prefixes = next_transform, next_prefixes
        place[active] = target
    return transform, prefixes


def suffix_places(transform: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, start and place in the order of all suffixes of at least ``least`` symbols, walked by the transform."""
    strings = len(sizes)
    order = np.argsort(transform, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    closed = int((transform == 0).sum())
    place, found = np.arange(strings), []
    for taken in range(1, int(sizes.max()) + 1):
        active = np.flatnonzero(sizes >= taken)
        place[active] = strings + rank[place[active]] - closed
        if taken >= least:
            found.append((active, sizes[active] - taken, place[active].copy()))
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of every window that also is in a piece of a smaller document."""
    body = _gathered(data, starts, sizes)
    used = np.zeros(256, bool)
    used[body] = True
    codes = np.cumsum(used).astype(np.uint8)  # UTF-8 leaves some byte values unused, so numbers from 1 suffice
    own = np.r_[0, np.cumsum(sizes)[:-1]]
    transform, prefixes = collection_transform(codes[body], own, sizes, Scratch())
    piece, offset, place = suffix_places(transform, sizes, length)
    order = np.argsort(place)
    piece, offset, place = piece[order], offset[order], place[order]
    # Suffixes shorter than a window cannot have so long a common prefix: a stand is unbroken in the full order.
    stand = np.cumsum(prefixes < length)[place]
    new = np.flatnonzero(np.r_[True, stand[1:] != stand[:-1]])
    least = np.minimum.reduceat(docs[piece], new)
    earlier = np.repeat(least, np.diff(np.r_[new, len(piece)])) < docs[piece]
    return piece[earlier], offset[earlier]


def _searched(pieces: DataFrame, buckets: int, length: int) -> DataFrame:
    """The repeated ranges of each fragment, packed for buckets of documents."""
    side = (length - ANCHOR) // 2

    def search(key: tuple, table: pa.Table) -> pa.Table:
        columns = {name: _unpack(table.column(name), kind) for name, kind in (("ids", "<i8"), ("marks", "<i8"), ("owner", "<u4"), ("start", "<i4"), ("size", "u1"), ("place", "u1"), ("body", "u1"))}
        shift = np.cumsum([0, *map(len, columns["ids"][:-1])])
        owner = np.concatenate([o.astype(np.int64) + s for o, s in zip(columns["owner"], shift)])
        start = np.concatenate([np.cumsum(x, dtype=np.int64) for x in columns["start"]])  # kept as differences
        ids, marks, size, place, data = (np.concatenate(columns[n]) for n in ("ids", "marks", "size", "place", "body"))
        del columns["body"]
        size, place = size.astype(np.int64), place.astype(np.int64)
        doc = ids[owner]
        at = np.r_[0, np.cumsum(size)[:-1]]
        whole_key, anchor_key, *half_keys = _piece_keys(data, at, size, place, side)
        leader = _leaders(data, whole_key, at, size, (doc,))
        # Equal pieces: all but those of the smallest document are repeats as they are.
        whole = np.flatnonzero(doc != doc[leader])
        out = [(owner[whole], start[whole], start[whole] + size[whole])]
        lead = np.flatnonzero(leader == np.arange(len(leader)))
        # A window holds the anchor and all of one half of the rest, so a repeat needs one of these halves elsewhere.
        near = np.zeros(len(lead), bool)
        for keys in half_keys:
            _, inverse, count = np.unique(keys[lead], return_inverse=True, return_counts=True)
            near |= (count[inverse] > 1) & (keys[lead] != 0)
        lead = lead[near]
        anchor = anchor_key[lead]
        order = np.argsort(anchor, kind="stable")
        lead, anchor = lead[order], anchor[order]
        ends = np.flatnonzero(np.r_[anchor[1:] != anchor[:-1], True]) + 1 if len(lead) else np.zeros(0, np.int64)
        begin = 0
        twins = np.flatnonzero((doc == doc[leader]))
        twins = twins[np.argsort(leader[twins], kind="stable")]
        while begin < len(lead):
            stop = int(ends[min(np.searchsorted(ends, begin + COLLECTION), len(ends) - 1)])
            some = lead[begin:stop]
            begin = stop
            if len(some) < 2:
                continue
            piece, offset = repeated_windows(data, at[some], size[some], doc[some], length)
            if not len(piece):
                continue
            order = np.lexsort((offset, piece))
            piece, offset = piece[order], offset[order]
            new = np.r_[True, (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(piece) - 1]
            lead_of, low, high = some[piece[new]], offset[new], offset[last] + length
            # The smallest document may hold the piece several times.
            a, b = np.searchsorted(leader[twins], lead_of), np.searchsorted(leader[twins], lead_of, side="right")
            repeat = np.repeat(np.arange(len(lead_of)), b - a)
            each = twins[np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange(len(repeat))]
            out.append((owner[each], start[each] + low[repeat], start[each] + high[repeat]))
        owner_, low, high = (np.concatenate(x) for x in zip(*out))
        found = [ids[owner_], marks[owner_], low, high]
        for i, name in enumerate(_RANGES):
            found[i] = np.concatenate([found[i], *_unpack(table.column(name), "<i8")])
        bucket = (mix(found[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((found[2], found[0], bucket))
        found, bucket = [x[order] for x in found], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.unique(bucket)
        packed = [[_pack(x[cut[b] : cut[b + 1]], "<i8") for b in used] for x in found]
        return pa.table([pa.array(used, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", *_RANGES])

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in _RANGES)
    return pieces.groupBy("fragment").applyInArrow(thrifty_group(search), schema)


def _merged(ranges: DataFrame) -> DataFrame:
    """The maximal removed runs of each document: ``doc_id, mark, starts, stops``."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        ids, marks, low, high = (np.concatenate(_unpack(table.column(n), "<i8")) for n in _RANGES)
        order = np.lexsort((low, marks, ids))
        ids, marks, low, high = ids[order], marks[order], low[order], high[order]
        text = np.cumsum(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]) - 1 if len(ids) else ids
        room = int(high.max()) + 2 if len(high) else 1
        reach = np.maximum.accumulate(high + text * room)
        new = np.r_[True, low[1:] + text[1:] * room > reach[:-1]] if len(low) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(low) - 1] if len(first) else first
        stops = reach[last] - text[last] * room
        border = np.flatnonzero(np.r_[True, text[first][1:] != text[first][:-1]]) if len(first) else first
        offsets = pa.array(np.r_[border, len(first)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (low[first], stops)]
        return pa.table([pa.array(ids[first][border]), pa.array(marks[first][border]), *lists], ["doc_id", "mark", "starts", "stops"])

    return ranges.groupBy("bucket").applyInArrow(thrifty_group(merge), "doc_id long, mark long, starts array<long>, stops array<long>")


def repeated_ranges(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Which bytes of which documents came before: ``doc_id, mark`` (hash of the text), ``starts, stops`` of the maximal runs."""
    fragments = groups_for(documents, FRAGMENT_BYTES, FRAGMENTS * partitions(documents.sparkSession), MOST_FRAGMENTS)
    return written(_merged(_searched(_sent_pieces(documents, fragments, length), fragments, length)), "repeats")


def remaining(raw: bytes, starts: list[int], stops: list[int]) -> bytes:
    kept, at = [], 0
    for low, high in zip(starts, stops):
        kept.append(raw[at:low])
        at = high
    return b"".join([*kept, raw[at:]])


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS)).cast("int")


def _with_runs(documents: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that may lose something, with their runs in ``__span_starts, __span_stops`` (null for those that do not), and the others.

    The two are told apart by a list of hashed ids with at most ``SLOTS`` entries, so that most texts that
    lose nothing are not shuffled. The list is sent to all tasks; its size has that bound.
    """
    slots = F.broadcast(found.select(_slot(F.col("doc_id")).alias("__span_slot")).distinct())
    listed = _slot(documents["doc_id"]) == slots["__span_slot"]
    runs = found.select(F.col("doc_id").alias("__span_doc"), F.col("mark").alias("__span_mark"), F.col("starts").alias("__span_starts"), F.col("stops").alias("__span_stops"))
    some = documents.join(slots, listed, "left_semi")
    joined = some.join(runs, (some["doc_id"] == runs["__span_doc"]) & (F.xxhash64(some["text"]) == runs["__span_mark"]), "left")
    return joined.select(*(some[c] for c in documents.columns), runs["__span_doc"], runs["__span_mark"], runs["__span_starts"], runs["__span_stops"]), documents.join(slots, listed, "left_anti")


def removed_bytes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    found = repeated_ranges(documents.select("doc_id", "text"), length)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, starts, stops = (batch.column(c).to_pylist() for c in ("text", "__span_starts", "__span_stops"))
            digests = [hashlib.sha256(remaining(t.encode(), a, b)).hexdigest() for t, a, b in zip(texts, starts, stops)]
            lost = [sum(b) - sum(a) for a, b in zip(starts, stops)]
            values = [batch.column("__span_doc"), batch.column("__span_mark"), pa.array(lost, pa.int64()), pa.array(list(map(len, starts)), pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(values, ["__span_doc", "__span_mark", "removed", "spans", "digest"])

    some, _ = _with_runs(documents.select("doc_id", "text"), found)
    losers = some.where("__span_starts is not null").select("text", "__span_doc", "__span_mark", "__span_starts", "__span_stops")
    lost = losers.mapInArrow(thrifty(digest), "__span_doc long, __span_mark long, removed long, spans long, digest string").distinct()
    text = F.coalesce("text", F.lit(""))
    every = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), F.xxhash64("text").alias("mark"))
    joined = every.join(lost, (F.col("doc_id") == F.col("__span_doc")) & (F.col("mark") == F.col("__span_mark")), "left")
    nothing = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("removed", nothing).alias("n_removed"), F.coalesce("spans", nothing).alias("n_spans"), F.coalesce("digest", "whole").alias("kept_sha256"))


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated passages cut out of their texts, all columns kept; ``n_chars`` follows the text."""
    found = repeated_ranges(documents.select("doc_id", "text"), length)
    names = documents.columns

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("text", "__span_starts", "__span_stops"))
            texts = [t if a is None else remaining(t.encode(), a, b).decode("utf-8", "ignore") for t, a, b in zip(*columns)]
            values = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(values, names)

    some, others = _with_runs(documents, found)
    out = others.unionByName(some.drop("__span_doc", "__span_mark").mapInArrow(thrifty(shorten), documents.schema))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out
