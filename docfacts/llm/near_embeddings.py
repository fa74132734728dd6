"""Near-duplicate embeddings by an inverted multi-index.

Equal vectors are one unit throughout, with the number of their copies, so copies make no pairs. Vectors are scaled to length 1 and cut in
halves; each half has its own codebook, and the pairs of codes form a grid of cells. A vector visits the cells in order of the least squared distance
that a member could have (multi-sequence traversal of the two sorted lists of halves), until ``target_recall`` is reached. The least
distance for a half is that to the plane midway between the vector's own centre and the cell's.

Where to stop is measured. A sample of at most ``QUERIES`` vectors is compared with *all* vectors, and the bound that
each true link needs goes into a histogram: so the bound follows where partners really lie, in the data's own span. Where fewer than ``ENOUGH`` such links were seen,
partners at exactly the threshold are made for sampled rows, in random directions of the whole space and of the data's span, and
the larger bound holds. Both take the bound that
finds the target share; it never exceeds ``2 - 2 * least``, beyond which no partner can lie. ``target_recall=1`` goes on to that: the exact way.

Pairs in visited cells are verified in double precision, block by block. A block gives a link count and one root for each vector, never its
pairs; large cells are dealt over many blocks, so a hot cell is spread over many tasks.

The codebooks are fitted on at most ``SAMPLE`` vectors (those with the smallest hash of their id) and indexed are all.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null id, link with
nothing; vectors of different length do not link; of several rows with one id the smallest vector counts and one row is
returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docfacts.llm.common import thrifty, written
from docfacts.llm.graph import components

LEAST_COSINE = 0.95
SAMPLE = 8192
CELL_ROWS = 256
MOST_CODES = 512
BLOCK = 1024
TARGET_RECALL = 0.999
#: Vectors compared with all others to measure where true partners lie, and the steps in which the bound is measured.
QUERIES = 1024
STEPS = 2_000
#: True links across cells that decide alone where to stop; fewer are joined by made partners.
ENOUGH = 1_000
#: Partners made to measure the stopping bound, beside the true ones.
TRIALS = 5_000
#: Rounding room of the distance bound.
ROOM = 1e-6


def codebook(rows: np.ndarray, codes: int, steps: int = 8) -> np.ndarray:
    """Centres of ``rows`` by Lloyd's iteration from evenly spaced rows."""
    centres = rows[np.linspace(0, len(rows) - 1, min(codes, len(rows))).astype(int)]
    for _ in range(steps):
        nearest = squared(rows, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        sizes = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return np.unique(centres, axis=0)


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1), 0)


def least_squared(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its code, and for each code the least squared distance to anything that has this code."""
    to = squared(rows, centres)
    own = to.argmin(1)
    apart = np.sqrt(squared(centres, centres))[own]
    plane = (to - to[np.arange(len(rows)), own][:, None]) / np.maximum(2 * apart, 1e-12)
    plane[np.arange(len(rows)), own] = 0
    return own, np.maximum(plane, 0) ** 2


def nearest_cells(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells in order of the sum of their halves' bounds, as long as it does not exceed ``most``."""
    one, two = first.argsort(), second.argsort()
    heap = [(first[one[0]] + second[two[0]], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > most:
            return
        yield int(one[i]), int(two[j])
        if j + 1 < len(two):
            heapq.heappush(heap, (first[one[i]] + second[two[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (first[one[i + 1]] + second[two[0]], i + 1, 0))


Books = tuple[np.ndarray, np.ndarray]


def made_bound(unit: np.ndarray, books: Books, least: float, target: float) -> float:
    """The sum of bounds up to which cells are visited to find ``target`` of the partners at cosine ``least``.

    Their directions are random: once in the whole space and once, as differences of sampled rows, in the span of the data.
    """
    rng = np.random.default_rng(0)
    half, worst = books[0].shape[1], 0.0
    rows = unit[rng.integers(0, len(unit), TRIALS)]
    spanned = unit[rng.integers(0, len(unit), TRIALS)] - unit[rng.integers(0, len(unit), TRIALS)]
    for aside in (rng.normal(size=rows.shape), spanned):
        aside = aside - (aside * rows).sum(1)[:, None] * rows
        length = np.sqrt((aside**2).sum(1))
        some = length > 1e-9
        if not some.any():
            continue
        partners = least * rows[some] + np.sqrt(1 - least**2) * aside[some] / length[some][:, None]
        needed = 0.0
        for part, centres in ((slice(0, half), books[0]), (slice(half, None), books[1])):
            _, bounds = least_squared(rows[some][:, part], centres)
            needed = needed + bounds[np.arange(len(partners)), squared(partners[:, part], centres).argmin(1)]
        worst = max(worst, float(np.quantile(needed, target)))
    return worst


class Grid:
    """Codes and bounds of some unit vectors under two codebooks."""

    def __init__(self, unit: np.ndarray, books: Books):
        half = books[0].shape[1]
        self.unit = unit
        self.one, self.first = least_squared(unit[:, :half], books[0])
        self.two, self.second = least_squared(unit[:, half:], books[1])
        self.cell = self.one * len(books[1]) + self.two


def needed_bounds(rows: Grid, others: Grid, linked: np.ndarray) -> np.ndarray:
    """The bounds up to which cells must be visited to meet the linked pairs: the vector of the smaller cell visits the other's."""
    i, j = np.nonzero(linked)
    forth = rows.first[i, others.one[j]] + rows.second[i, others.two[j]]
    back = others.first[j, rows.one[i]] + others.second[j, rows.two[i]]
    return np.where(rows.cell[i] == others.cell[j], 0.0, np.where(rows.cell[i] < others.cell[j], forth, back))


def _measured_bounds(vectors: DataFrame, books: dict[int, Books], queries: dict[int, np.ndarray], kind: str, least: float, target: float) -> dict[int, tuple[float, int]]:
    """For each vector length the bound that finds ``target`` of the true links of the query vectors with all vectors, and how many of these cross cells."""
    most = 2 - 2 * least
    shared = vectors.sparkSession.sparkContext.broadcast((books, queries))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = shared.value
        asked = {size: Grid(unit, known[size]) for size, unit in asked.items()}
        for batch in batches:
            for size, group in batch.to_pandas().groupby("size"):
                if size not in asked:
                    continue
                for at in range(0, len(group), BLOCK):
                    rows = Grid(_unit(list(group["packed"].iloc[at : at + BLOCK]), kind), known[size])
                    bounds = needed_bounds(rows, asked[size], rows.unit @ asked[size].unit.T >= least)
                    steps, counts = np.unique(np.ceil(np.minimum(bounds / most, 1) * STEPS).astype(np.int64), return_counts=True)
                    sizes = pa.array([int(size)] * len(steps), pa.int32())
                    yield pa.RecordBatch.from_arrays([sizes, pa.array(steps), pa.array(counts.astype(np.int64))], ["size", "step", "n"])

    found = vectors.select("size", "packed").mapInArrow(thrifty(measure), "size int, step long, n long")
    seen = found.where("step > 0").groupBy("size", "step").agg(F.sum("n").alias("n")).toPandas()  # at most STEPS rows for each length
    bounds = {}
    for size, group in seen.sort_values("step").groupby("size"):
        # Among the links that cross cells, so that links inside cells do not hide the others.
        total = group["n"].cumsum().to_numpy()
        reached = int(np.searchsorted(total, target * total[-1]))
        bounds[int(size)] = float(group["step"].iloc[min(reached, len(total) - 1)]) / STEPS * most, int(total[-1])
    return bounds


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    return rows / np.sqrt((rows**2).sum(1))[:, None]


def _valid(embeddings: DataFrame, vec_id: str, embedding: str, kind: str) -> DataFrame:
    """Ids, lengths and packed values of the vectors that can link, one for each id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, packed = [], [], []
            for i, vector in zip(batch.column("id").to_pylist(), batch.column("v")):
                values = vector.values
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                numbers = values.to_numpy(zero_copy_only=False).astype("<f8")
                top = np.abs(numbers).max()
                if np.isfinite(top) and top > 0:
                    ids.append(i)
                    sizes.append(len(numbers))
                    packed.append((numbers if kind == "<f4" else numbers / top).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "size", "packed"])

    one = embeddings.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    return one.mapInArrow(thrifty(pack), "vec_id long, size int, packed binary")


def _codebooks(vectors: DataFrame, rows: int, kind: str, least: float, target: float) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Two codebooks and the stopping bound for each vector length in a bounded sample."""
    codes = int(np.clip(round((rows / CELL_ROWS) ** 0.5), 1, MOST_CODES))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("size", "packed").toPandas()
    units = {int(size): _unit(list(group["packed"]), kind) for size, group in sample.groupby("size")}
    books = {}
    for size, unit in units.items():
        half = (size + 1) // 2
        books[size] = codebook(unit[:, :half], codes), codebook(unit[:, half:], codes) if size > 1 else np.zeros((1, 0))
    most = 2 - 2 * least
    if target >= 1 or not books:
        return {size: (*pair, most + ROOM) for size, pair in books.items()}
    share = max(1, QUERIES // len(units))
    true = _measured_bounds(vectors, books, {size: unit[:share] for size, unit in units.items()}, kind, least, target)
    for size, pair in books.items():
        bound, seen = true.get(size, (0.0, 0))
        if seen < ENOUGH:
            bound = max(bound, made_bound(units[size], pair, least, target))
        books[size] = (*pair, min(bound, most) + ROOM)
    return books


class Block:
    """Vectors of a block with their ids and numbers of copies."""

    def __init__(self, frame: pd.DataFrame, kind: str):
        self.ids, self.copies = frame["vec_id"].to_numpy(), frame["copies"].to_numpy()
        self.unit = _unit(list(frame["packed"]), kind)


def block_links(left: Block, right: Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, partner counts (copies counted) and roots of the vectors that are linked within a pair of blocks."""
    linked = left.unit @ right.unit.T >= least
    linked &= left.ids[:, None] != right.ids[None, :]
    rows, columns = np.nonzero(linked)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    everyone = np.unique(np.concatenate([left.ids[rows], right.ids[columns]]))
    a, b = np.searchsorted(everyone, left.ids[rows]), np.searchsorted(everyone, right.ids[columns])
    root = np.arange(len(everyone))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    count = np.zeros(len(everyone), np.int64)
    np.add.at(count, a, right.copies[columns])
    if left is not right:
        np.add.at(count, b, left.copies[rows])
    return everyone, count, everyone[root]


def near_duplicates(
    embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """For each vector the number of vectors it links with and the smallest id that its links reach."""
    spark = embeddings.sparkSession
    kind = "<f4" if dict(embeddings.dtypes)[embedding] == "array<float>" else "<f8"
    valid = written(_valid(embeddings, vec_id, embedding, kind), "vectors")
    # Equal vectors are one, named by their smallest id.
    vectors = written(valid.groupBy("size", "packed").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "classes")
    books = spark.sparkContext.broadcast(_codebooks(vectors, vectors.count(), kind, least, target_recall))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for size, group in frame.groupby("size"):
                for at in range(0, len(group), 1000):
                    yield _visits(group.iloc[at : at + 1000], int(size))

    def _visits(group: pd.DataFrame, size: int) -> pa.RecordBatch:
        half = (size + 1) // 2
        one, two, most = books.value.get(size, (np.zeros((1, half)), np.zeros((1, size - half)), 2.0))
        grid = Grid(_unit(list(group["packed"]), kind), (one, two))
        at, cells, member = [], [], []
        for k, own in enumerate(grid.cell.tolist()):
            at.append(k), cells.append(own), member.append(True)
            for x, y in nearest_cells(grid.first[k], grid.second[k], most):
                # Each pair of cells is met from one side only.
                if (cell := x * len(two) + y) > own:
                    at.append(k), cells.append(cell), member.append(False)
        seen = group.iloc[at]
        columns = [
            pa.array(seen["vec_id"], pa.int64()), pa.array([size] * len(at), pa.int32()), pa.array(cells, pa.int64()), pa.array(member, pa.bool_()),
            pa.array(seen["packed"].tolist(), pa.binary()), pa.array(seen["copies"], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "size", "cell", "member", "packed", "copies"])

    visits = written(vectors.mapInArrow(thrifty(visit), "vec_id long, size int, cell long, member boolean, packed binary, copies long"), "visits")
    counts = visits.groupBy("size", "cell").agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("guests"))
    parted = visits.join(counts.where("members > 0"), ["size", "cell"])
    blocks, guest_blocks = F.ceil(F.col("members") / BLOCK), F.ceil(F.col("guests") / BLOCK)
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("member"), blocks).otherwise(guest_blocks))
    # A block of members meets itself and every later block of members, and every block of guests.
    met = parted.withColumns({"own": own.cast("long"), "blocks": blocks.cast("long"), "guest_blocks": guest_blocks.cast("long")})
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    range_to = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<long>"))
    side = lambda kind, left, right, role: F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), F.lit(role).alias("role"))
    as_left = F.transform(F.sequence(F.col("own"), F.col("blocks") - one), lambda k: side("m", F.col("own"), k, "left"))
    as_right = F.transform(range_to(F.col("own")), lambda k: side("m", k, F.col("own"), "right"))
    for_guests = F.transform(range_to(F.col("guest_blocks")), lambda k: side("g", F.col("own"), k, "left"))
    as_guest = F.transform(range_to(F.col("blocks")), lambda k: side("g", k, F.col("own"), "right"))
    places = F.when(F.col("member"), F.concat(as_left, as_right, for_guests)).otherwise(as_guest)
    dealt = met.select("size", "cell", "vec_id", "packed", "copies", F.inline(places))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["role"] == "left"], group[group["role"] == "right"]
        same = group["kind"].iloc[0] == "m" and group["left"].iloc[0] == group["right"].iloc[0]
        if left.empty or (right.empty and not same):
            return pd.DataFrame({"vec_id": [], "n": [], "root": []}).astype("int64")
        one = Block(left, kind)
        return pd.DataFrame(dict(zip(("vec_id", "n", "root"), block_links(one, one if same else Block(right, kind), least))))

    links = written(dealt.groupBy("size", "cell", "kind", "left", "right").applyInPandas(verify, "vec_id long, n long, root long"), "links")
    counted = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    reached = components(links.select("vec_id", "root")).withColumnRenamed("node", "vec_id")
    classes = vectors.join(counted, "vec_id", "left").join(reached, "vec_id", "left")
    others = F.col("copies") - 1 + F.coalesce("n", F.lit(0))
    classes = classes.select("size", "packed", others.alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    found = valid.join(classes, ["size", "packed"]).select("vec_id", "n_links", "component")
    joined = embeddings.select(F.col(vec_id).alias("vec_id")).distinct().join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
