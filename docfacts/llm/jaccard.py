"""Set similarity join over word n-grams with vertical partitioning.

The order of all n-grams (by hash) is cut into fragments. Every distinct set of n-grams sends each fragment its
segment there; a fragment task sorts the n-grams of all segments, so it knows how many sets hold
each of them, and gives back those held by more than one. A set whose shared n-grams, summed over the fragments,
cannot reach the threshold with anything is done: most are.

The others look for partners by their rarest shared n-grams, as many as a partner must hit at
least once. For each n-gram the set with the smallest id is paired with the others (as many pairs as rows, whatever the
group's size), pairs that cannot overlap enough by length, position or shared count left out. The pairs are counted
fragment by fragment and summed; the links give components. A second round pairs all sets of *different* components that
share a rare n-gram and may still overlap enough, components first by their best values, so that
members of a large component are looked at only if one of them may be a partner. After it no link between components is
left out, and links within a component do not change it.

Equal sets are one unit throughout (named by their smallest id and a 128-bit digest), so exact copies make no pairs; a task
sends a set it has already sent only once. Nothing is collected, broadcast by hint, or grouped without bound: the largest group
is a fragment, and their number follows the bytes of all texts.

Defined cases: a null or blank text has no n-gram, is linked with nothing and is its own component; a text with fewer words than
``WORDS`` is one n-gram; a null id never links and has a null component; rows with equal id but different texts are documents of
their own, one row is returned for each; other columns are ignored; an empty table gives an empty result.

N-grams are told apart by hashes of 48 bits and their fragment, sets by 128 bits; equality is equality of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docfacts.llm.common import groups_for, joined_bytes, lower_ascii, mix, partitions, slices, thrifty, thrifty_group, word_hashes, words_of, written
from docfacts.llm.graph import components

WORDS = 5
#: Least similarity, as a fraction of whole numbers: ``OVER * intersection >= UNDER * union``.
OVER, UNDER = 100, 80
#: Parts in which the overlap of a pair is counted.
PARTS = 4
#: Sets that one task remembers as sent.
REMEMBERED = 500_000
#: Bytes of text whose n-grams one fragment takes, where the session has fewer shuffle partitions than that gives.
FRAGMENT_BYTES, MOST_FRAGMENTS = 16 << 20, 32_767

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_DIGESTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344)]


def ngram_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct n-grams of each text, sorted by both."""
    data, offsets = joined_bytes(texts)
    starts, ends, first = words_of(data, offsets)
    word = word_hashes(lower_ascii(data), starts, ends)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(word)) - first[text]
    # Sums of the next k words with factors; a text shorter than n closes its sum early.
    length = np.minimum(sizes, n)[text]
    begins = position <= sizes[text] - length
    total = np.zeros(len(word), np.uint64)
    for k in range(n):
        ahead = np.minimum(np.arange(len(word)) + k, max(len(word) - 1, 0))
        total += np.where(k < length, word[ahead] * _FACTORS[k % len(_FACTORS)] + np.uint64(k), np.uint64(0)) if len(word) else total
    total = mix(total + length.astype(np.uint64))
    text, total = text[begins], total[begins]
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    return text[fresh], total[fresh]


def _digests(text: np.ndarray, grams: np.ndarray, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Set size and two digests for each text."""
    cut = np.searchsorted(text, np.arange(count + 1))
    out = []
    for seed in _DIGESTS:
        sums = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ seed), dtype=np.uint64, out=sums[1:])
        out.append((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64))
    return np.diff(cut), out


def describe_sets(documents: DataFrame) -> DataFrame:
    """For each document the size and digests of its set: ``doc_id, n, d1, d2``."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, grams = ngram_sets(batch.column("text"))
            n, (d1, d2) = _digests(text, grams, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2)], ["doc_id", "n", "d1", "d2"])

    return documents.select("doc_id", "text").mapInArrow(thrifty(describe), "doc_id long, n long, d1 long, d2 long")


_SEGMENT = ["d1", "d2", "n", "counts", "grams"]


def _segments(documents: DataFrame, fragments: int) -> DataFrame:
    """The segments of the distinct sets, packed for each fragment."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in slices(batches, "text"):
            text, grams = ngram_sets(batch.column("text"))
            n, (d1, d2) = _digests(text, grams, batch.num_rows)
            new = np.zeros(batch.num_rows, bool)
            for i, key in enumerate(map(bytes, np.stack([d1, d2], 1).view("u1").reshape(batch.num_rows, 16))):
                if n[i] and key not in sent:
                    sent.add(key)
                    new[i] = True
            if len(sent) > REMEMBERED:
                sent.clear()
            chosen = new[text]
            text, grams = text[chosen], grams[chosen]
            at = _fragment(grams, fragments)
            order = np.argsort(at, kind="stable")
            text, grams, at = text[order], grams[order], at[order]
            low = np.ascontiguousarray(grams).view("u1").reshape(-1, 8)[:, :6]
            border = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[border, len(at)]).astype("<u4")
            owner, where = text[border], at[border]
            cut = np.searchsorted(where, np.arange(fragments + 1))
            ends = np.r_[border, len(at)]
            rows = {name: [] for name in ["fragment", *_SEGMENT]}
            for f in np.unique(where):
                a, b = cut[f], cut[f + 1]
                rows["fragment"].append(int(f))
                rows["d1"].append(d1[owner[a:b]].tobytes())
                rows["d2"].append(d2[owner[a:b]].tobytes())
                rows["n"].append(n[owner[a:b]].astype("<u4").tobytes())
                rows["counts"].append(counts[a:b].tobytes())
                rows["grams"].append(low[ends[a] : ends[b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["fragment"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in _SEGMENT)], ["fragment", *_SEGMENT])

    schema = "fragment int, " + ", ".join(f"{c} binary" for c in _SEGMENT)
    return documents.select("doc_id", "text").mapInArrow(thrifty(send), schema)


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _shared(segments: DataFrame, buckets: int) -> DataFrame:
    """What each fragment knows of its segments: the n-grams held by several sets, and by how many."""
    names = ["bucket", *_SEGMENT, "held"]

    def count(key: tuple, table: pa.Table) -> pa.Table:
        d1, d2, n, counts = (_column(table, c, k) for c, k in zip(_SEGMENT, ("<i8", "<i8", "<u4", "<u4")))
        raw = _column(table, "grams", "u1").reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        low = wide.view("<u8").ravel()
        segment = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        del raw, wide
        order = np.lexsort((d1[segment], low))
        low, segment = low[order], segment[order]
        del order
        same = np.r_[False, low[1:] == low[:-1]]
        again = same & np.r_[False, (d1[segment][1:] == d1[segment][:-1]) & (d2[segment][1:] == d2[segment][:-1])]
        low, segment, same = low[~again], segment[~again], same[~again]
        run = np.cumsum(~same) - 1
        held = np.bincount(run)[run] if len(run) else run
        several = held > 1
        low, segment, held = low[several], segment[several], held[several]
        bucket = d1[segment].view("<u8") % np.uint64(buckets)
        order = np.lexsort((d2[segment], d1[segment], bucket))
        low, segment, held, bucket = low[order], segment[order], held[order], bucket[order]
        keys = low | np.uint64(key[0].as_py()) << np.uint64(48)
        one, two = d1[segment], d2[segment]
        border = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, np.int64)
        ends = np.r_[border, len(one)]
        owner = segment[border]
        cut = np.searchsorted(bucket[border], np.arange(buckets + 1, dtype=np.uint64))
        rows = {name: [] for name in names}
        for b in np.unique(bucket).astype(int):
            i, j = cut[b], cut[b + 1]
            own = owner[i:j]
            rows["bucket"].append(b)
            rows["d1"].append(d1[own].tobytes())
            rows["d2"].append(d2[own].tobytes())
            rows["n"].append(n[own].tobytes())
            rows["counts"].append(np.diff(ends[i : j + 1]).astype("<u4").tobytes())
            rows["grams"].append(keys[ends[i] : ends[j]].tobytes())
            rows["held"].append(np.minimum(held[ends[i] : ends[j]], 65_535).astype("<u2").tobytes())
        return pa.table([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in names[1:])], names)

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in names[1:])
    return segments.groupBy("fragment").applyInArrow(thrifty_group(count), schema)


def _needed(n):
    """The least overlap that a set of ``n`` can have with any partner."""
    return -(-UNDER * n // OVER)


def _hopeful(shared: DataFrame) -> DataFrame:
    """The sets whose shared n-grams can reach the threshold: ``d1, d2, n, grams`` (rarest first), ``rare`` (how many to look with)."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        d1, d2, n, counts = (_column(table, c, k) for c, k in zip(_SEGMENT, ("<i8", "<i8", "<u4", "<u4")))
        grams, held = _column(table, "grams", "<u8"), _column(table, "held", "<u2")
        order = np.lexsort((d2, d1))
        rank = np.empty(len(order), np.int64)
        border = np.r_[True, (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])]
        rank[order] = np.cumsum(border) - 1
        first = order[border]
        unit = np.repeat(rank, counts)
        total = np.bincount(unit, minlength=len(first))
        n = n[first].astype(np.int64)
        rare = total - _needed(n) + 1  # n-grams that no other set holds come first in the order and find nothing
        chosen = rare > 0
        inside = chosen[unit]
        unit, grams, held = unit[inside], grams[inside], held[inside]
        order = np.lexsort((grams, held, unit))
        offsets = np.r_[0, np.cumsum(total[chosen])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[order].view("<i8")))
        return pa.table([pa.array(d1[first][chosen]), pa.array(d2[first][chosen]), pa.array(n[chosen]), lists, pa.array(rare[chosen].astype(np.int32))], ["d1", "d2", "n", "grams", "rare"])

    return shared.groupBy("bucket").applyInArrow(thrifty_group(add), "d1 long, d2 long, n long, grams array<long>, rare int")


def _may_overlap(room: Column, other_room: Column, n: Column, other_n: Column) -> Column:
    """Whether sets of ``n`` and ``other_n`` that overlap in at most the smaller room can reach the threshold."""
    most = F.least(room, other_room)
    return ((OVER + UNDER) * most >= UNDER * (n + other_n)) & (OVER * F.least(n, other_n) >= UNDER * F.greatest(n, other_n))


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs that reach the threshold. Overlaps are counted in ``PARTS`` parts of the n-gram order and summed."""
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    parted = F.transform(every, lambda v: F.filter("grams", lambda g: F.pmod(F.shiftright(g, 48), F.lit(PARTS)) == v))
    parts = units.select("u", "n", F.posexplode(parted).alias("part", "piece"))
    left = pairs.join(parts.select(F.col("u").alias("a"), F.col("n").alias("n_a"), "part", F.col("piece").alias("piece_a")), "a")
    both = left.join(parts.select(F.col("u").alias("b"), F.col("n").alias("n_b"), "part", F.col("piece").alias("piece_b")), ["b", "part"])
    counted = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("piece_a", "piece_b")).alias("common"))
    summed = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return summed.where(OVER * F.col("common") >= UNDER * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _star_pairs(rare: DataFrame) -> DataFrame:
    """For each n-gram its smallest set with each other one that it may be linked with."""
    pivots = rare.groupBy("gram").agg(F.min(F.struct("u", "n", "room")).alias("p"))
    met = rare.join(pivots, "gram").where((F.col("u") != F.col("p.u")) & _may_overlap(F.col("room"), F.col("p.room"), F.col("n"), F.col("p.n")))
    return met.select(F.col("p.u").alias("a"), F.col("u").alias("b")).distinct()


def _cross_pairs(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """All sets of different components that share a rare n-gram and may be linked.

    The smaller set of a linked pair must have room for ``2 * UNDER / (OVER + UNDER)`` of itself: it is called strong. Components are compared
    first, by the best that a strong member of one and any member of the other could reach at an n-gram; only where that is
    enough are the members themselves paired. So an n-gram of a large group costs its components, not its pairs.
    """
    named = rare.join(labels, rare["u.d1"] == labels["node"], "left").select("gram", "u", "n", "room", F.coalesce("component", F.col("u.d1")).alias("label"))
    named = written(named, "rare")
    several = named.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gram")
    mixed = written(named.join(several, "gram"), "mixed")
    strong = mixed.where((OVER + UNDER) * F.col("room") >= 2 * UNDER * F.col("n"))

    def best(rows: DataFrame, side: str) -> DataFrame:
        found = rows.groupBy("gram", "label").agg(F.max("room").alias(f"{side}_room"), F.min("n").alias(f"{side}_least"), F.max("n").alias(f"{side}_most"))
        return found.withColumnRenamed("label", f"{side}_label")

    least_other = F.greatest("g_least", "s_least")
    feasible = best(strong, "s").join(best(mixed, "g"), "gram").where(
        (F.col("s_label") != F.col("g_label"))
        & ((OVER + UNDER) * F.least("s_room", "g_room") >= UNDER * (F.col("s_least") + least_other))
        & (F.col("g_most") >= F.col("s_least"))
        & (OVER * F.col("s_most") >= UNDER * least_other)
    )
    feasible = feasible.select("gram", F.col("s_label").alias("label"), "g_label")
    other = mixed.select("gram", F.col("label").alias("g_label"), F.col("u").alias("o_u"), F.col("n").alias("o_n"), F.col("room").alias("o_room"))
    met = strong.join(feasible, ["gram", "label"]).join(other, ["gram", "g_label"])
    fits = (F.col("n") <= F.col("o_n")) & _may_overlap(F.col("room"), F.col("o_room"), F.col("n"), F.col("o_n"))
    return met.where(fits).select(F.least("u", "o_u").alias("a"), F.greatest("u", "o_u").alias("b")).distinct()


def _units(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The set of each row, the classes of equal sets, those that may have partners, and the n-grams by which they look for them."""
    fragments = groups_for(documents, FRAGMENT_BYTES, partitions(documents.sparkSession), MOST_FRAGMENTS)
    sets = written(describe_sets(documents), "sets")
    classes = written(sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    hopeful = _hopeful(_shared(_segments(documents, fragments), fragments))
    units = written(hopeful.join(classes.drop("n"), ["d1", "d2"]).select(F.struct("rep", "d1").alias("u"), "n", "grams", "rare"), "units")
    # The overlap of two sets is at most what follows their first common n-gram, and what each shares at all.
    rare = units.select("u", "n", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", 1, F.col("rare"))).alias("at", "gram")).select("gram", "u", "n", (F.col("shared") - F.col("at")).alias("room"))
    return sets, classes, units, rare


def _named_sets(documents: DataFrame) -> DataFrame:
    """For each document row its set (``n, d1, d2``), the smallest id of its class and of its component."""
    sets, classes, units, rare = _units(documents)
    first = written(_verified(_star_pairs(rare), units), "links")
    # Classes are nodes by their digest, so that two with one smallest id stay apart.
    nodes = lambda links: links.select(F.col("a.d1").alias("a"), F.col("b.d1").alias("b"))
    labels = written(components(nodes(first)), "labels")
    second = _verified(written(_cross_pairs(rare, labels), "pairs"), units)
    final = written(components(nodes(first).union(nodes(second))), "components")
    linked = classes.join(final, classes["d1"] == final["node"]).select("d1", "d2", "rep", F.col("component").alias("label"))
    smallest = linked.groupBy("label").agg(F.min("rep").alias("component"))
    reached = linked.join(smallest, "label").select("d1", "d2", "component")
    named = classes.join(reached, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    return sets.join(named, ["d1", "d2"], "left")


def linked_components(documents: DataFrame) -> DataFrame:
    """For each document the size of its set and the smallest id that its links reach: ``doc_id, n_shingles, component_id``."""
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return _named_sets(documents).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _every_pair(rare: DataFrame) -> DataFrame:
    """All different sets that share a rare n-gram and may be linked, each pair once."""
    other = rare.select("gram", F.col("u").alias("o_u"), F.col("n").alias("o_n"), F.col("room").alias("o_room"))
    met = rare.join(other, "gram").where((F.col("u") < F.col("o_u")) & _may_overlap(F.col("room"), F.col("o_room"), F.col("n"), F.col("o_n")))
    return met.select(F.col("u").alias("a"), F.col("o_u").alias("b")).distinct()


def links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and which documents hold which set: ``a, b`` and ``doc_id, n_shingles, class_id``.

    ``a``, ``b`` and ``class_id`` name a class of equal sets by its smallest id and a digest (``rep, d1``); copies are not expanded into pairs. Linked sets
    share one of their rarest n-grams, so pairs are sought only there, and only where length and position leave room. The work follows the number
    of links: of g near copies that differ from each other all g * (g - 1) / 2 are listed. Use ``linked_components`` where groups are enough.
    A row without words or with a null id is linked with nothing and has a null class.
    """
    sets, classes, units, rare = _units(documents)
    named = classes.select("d1", "d2", F.struct("rep", "d1").alias("class_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    membership = sets.join(named, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("class_id"))
    return written(_verified(written(_every_pair(rare), "pairs"), units), "links"), membership


def link_counts(documents: DataFrame) -> DataFrame:
    """For each document the number of other rows linked with it, copies of one set counted each: ``doc_id, n_shingles, n_links``.

    Rows are added up by class before classes are joined with links, so copies make no pairs. A null id or a text without words has 0.
    """
    pairs, membership = links(documents)
    rows = written(membership.where("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")), "copies")
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionAll(pairs.select("b", "a"))
    reached = both.join(rows.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("reached"))
    counted = rows.join(reached, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("reached", F.lit(0))).alias("n_links"))
    return membership.join(counted, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_near_copies(documents: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id, all columns kept.

    Texts without words and rows with a null id stay, all of them. Other rows are told apart by id and set: of rows with one id and different texts each is
    kept or goes by its own links, and of rows with one id and one set the first stays.
    """
    named = written(_named_sets(documents), "named")
    kept = named.where("n > 0 and doc_id is not null and component >= doc_id").select("doc_id", "d1", "d2").distinct()
    going = named.where("n > 0 and doc_id is not null and component < doc_id").select("doc_id").distinct()
    # Ids with more than one row that have words are looked at row by row; for all others the id decides.
    several = written(named.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "several")
    simple = documents.join(written(going.union(several).distinct(), "going"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
    columns = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "doc_id", "text")
    mixed = written(columns.join(several, "doc_id", "left_semi"), "mixed")
    described = _with_sets(mixed)
    blank = described.where("n = 0").select("row.*")
    chosen = described.where("n > 0").join(kept, ["doc_id", "d1", "d2"], "left_semi").groupBy("doc_id", "d1", "d2").agg(F.first("row").alias("row")).select("row.*")
    return simple.unionAll(blank.select(*simple.columns)).unionAll(chosen.select(*simple.columns))


def _with_sets(rows: DataFrame) -> DataFrame:
    """``rows`` (``row, doc_id, text``) with the size and digests of their sets in place of the text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, grams = ngram_sets(batch.column("text"))
            n, (d1, d2) = _digests(text, grams, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2)], ["row", "doc_id", "n", "d1", "d2"])

    kind = dict(rows.dtypes)["row"]
    return rows.mapInArrow(thrifty(describe), f"row {kind}, doc_id long, n long, d1 long, d2 long")
