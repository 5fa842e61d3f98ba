"""Product codes of vectors, with exact codebooks: shortlists of entries per block of neighbouring parts.

Components become integers and each vector is cut into equal parts. Within chunks of rows the parts of a position are
sorted along a Hilbert curve and cut into flat blocks; a block stores its points, the box around them and their sum. In
each round the distances from an entry to the box decide which entries can be nearest to any point inside; a block with
one such entry is assigned as a whole by its stored sum, the others are compared with their shortlist in integers. A
shortlist never loses the nearest entry or an equally near one, so codes and codebooks are those of a full comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import pin
from riskloom.llm.vectors import finite, lengths, lists, matrix
from riskloom.session import broadcast_if_small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A vector's component times this, rounded down, is its integer.
SCALE = 256
#: Rows sorted together, a power of two; points of a block.
CHUNK_ROWS, BLOCK_POINTS = 16_384, 64
#: Shortlisted (block, entry) pairs compared in one step.
PAIRS = 8_192

BLOCKS = "chunk bigint, part int, points array<bigint>, places array<int>, low array<bigint>, high array<bigint>, total array<bigint>"
BLOCK_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("part", pa.int32()), ("points", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.int64())) for c in ("low", "high", "total")]
)


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Order of integer points along a Hilbert curve through their bounding box; ties keep their order."""
    if not len(points):
        return np.zeros(0, int)
    axes = points[:, :62].T - points[:, :62].min(axis=0)[:, None]
    dims = len(axes)
    bits = max(1, 62 // dims)
    spare = max(0, int(axes.max()).bit_length() - bits)
    x = [a >> spare for a in axes]
    # the coordinates are turned and mirrored, from the coarsest bit down, into the frame of the curve's own cell
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            swap = np.where(x[i] & bit, 0, (x[0] ^ x[i]) & (bit - 1))
            x[0] = np.where(x[i] & bit, x[0] ^ (bit - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turned = np.zeros_like(x[0])
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        turned = np.where(x[-1] & bit, turned ^ (bit - 1), turned)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ turned) >> b) & 1)
    return np.argsort(key, kind="stable")


def _blocks_of(part: pa.Table) -> pa.Table:
    """Blocks of one chunk of rows, position after position."""
    place = part["row"].to_numpy() & (CHUNK_ROWS - 1)
    by_place = np.argsort(place)
    place = place[by_place].astype(np.int32)
    x = matrix(part["x"])[by_place].reshape(len(place), PARTS, -1)
    n, width = len(x), x.shape[2]
    cuts = np.arange(0, n, BLOCK_POINTS)
    sizes = np.diff(np.r_[cuts, n])
    out = []
    for p in range(PARTS):
        order = hilbert_order(x[:, p])
        points = np.ascontiguousarray(x[order, p])
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        out.append(pa.table([
            pa.array(np.full(len(cuts), part["chunk"][0].as_py())), pa.array(np.full(len(cuts), p, np.int32)),
            pa.ListArray.from_arrays(ends * np.int32(width), points.reshape(-1)), pa.ListArray.from_arrays(ends, place[order]),
            *(lists(f.reduceat(points, cuts, axis=0), pa.int64()) for f in (np.minimum, np.maximum, np.add)),
        ], BLOCK_SCHEMA))
    return pa.concat_tables(out)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(box, entry): whether the entry can be nearest to a point of the box, ties included."""
    under, over = low[:, None, :] - book, book - high[:, None, :]
    least = np.maximum(np.maximum(under, over), 0)
    most = np.maximum(-under, -over)  # to the farther side of the box
    return (least * least).sum(axis=2) <= (most * most).sum(axis=2).min(axis=1)[:, None]


def assigned(points: np.ndarray, starts: np.ndarray, possible: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point; block b holds the points from starts[b] on. All in integers."""
    best, ends = np.empty(len(points), np.int64), np.r_[starts[1:], len(points)]
    held = possible.sum(axis=1)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(held[at:]), PAIRS, side="right")) + at)
        block, entry = np.nonzero(possible[at:upto])
        sizes = (ends - starts)[at:upto]
        slots = np.minimum(np.arange(sizes.max()), (sizes - 1)[:, None])  # short blocks repeat their last point
        cube = points[starts[at:upto, None] + slots]
        away = cube[block] - book[entry][:, None, :]
        # the entry's number in the lowest digits makes ties go to the lower one
        key = (away * away).sum(axis=2) * ENTRIES + entry[:, None]
        least = np.minimum.reduceat(key, np.r_[0, np.cumsum(held[at:upto])[:-1]], axis=0)
        best[starts[at] : ends[upto - 1]] = least[np.arange(sizes.max()) < sizes[:, None]]
        at = upto
    return best % ENTRIES, best // ENTRIES


def _by_part(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    part = table["part"].to_numpy()
    for p in np.unique(part):
        yield int(p), table.filter(pa.array(part == p))


def _flat(blocks: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of some blocks under one another, and where each block starts."""
    points = blocks["points"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    sizes = pc.list_value_length(blocks["places"]).to_numpy()
    return points, np.cumsum(sizes) - sizes


def entry_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, axis, total, n): sums over the points nearest to each entry of the codebooks (part, entry, axis)."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        books = sent.value
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for p, own in _by_part(pa.Table.from_batches([batch])):
                low, high = matrix(own["low"]), matrix(own["high"])
                possible = shortlists(low, high, books[p])
                sole = possible.sum(axis=1) == 1
                if sole.any():
                    entry = possible[sole].argmax(axis=1)
                    sums = matrix(own["total"])[sole]
                    np.add.at(total[p], entry, sums)
                    np.add.at(n[p], entry, pc.list_value_length(own["places"]).to_numpy()[sole])
                if not sole.all():
                    points, starts = _flat(own.filter(pa.array(~sole)), books.shape[2])
                    entry, _ = assigned(points, starts, possible[~sole], books[p])
                    np.add.at(total[p], entry, points)
                    np.add.at(n[p], entry, 1)
        part, entry = np.nonzero(n)
        axis = np.tile(np.arange(books.shape[2]), len(part))
        part, entry = np.repeat(part, books.shape[2]), np.repeat(entry, books.shape[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(axis, pa.int32()),
             pa.array(total[part, entry, axis]), pa.array(n[part, entry])],
            ["part", "entry", "axis", "total", "n"],
        )

    partial = blocks.mapInArrow(add, "part int, entry int, axis int, total bigint, n bigint")
    return partial.groupBy("part", "entry", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Codebooks after a round: means rounded down; an entry nothing is nearest to stays. One row per book component
    reaches the driver."""
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"], r["axis"]] = r["total"] // r["n"]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _codes(rows: DataFrame, blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the final assignment. Rows and blocks meet chunk by chunk."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def code(own: pa.Table, blocks: pa.Table) -> pa.Table:
        books, place = sent.value, own["row"].to_numpy() & (CHUNK_ROWS - 1)
        entries, error = np.zeros((CHUNK_ROWS, PARTS), np.uint8), np.zeros(CHUNK_ROWS, np.int64)
        for p, some in _by_part(blocks):
            points, starts = _flat(some, books.shape[2])
            entry, gap = assigned(points, starts, shortlists(matrix(some["low"]), matrix(some["high"]), books[p]), books[p])
            at = some["places"].combine_chunks().flatten().to_numpy()
            entries[at, p] = entry
            error[at] += gap
        text = [bytes(e).hex() for e in entries[place]]
        return own.select(["vec_id", "label"]).append_column("code", pa.array(text)).append_column("error", pa.array(error[place]))

    label = rows.schema["label"].dataType.simpleString()
    return (
        rows.select("chunk", "row", "vec_id", "label").groupBy("chunk").cogroup(blocks.groupBy("chunk"))
        .applyInArrow(code, f"vec_id bigint, label {label}, code string, error bigint")
    )


def compress(rows: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of pinned ``rows`` (row, chunk, vec_id, label, x) of one length."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").toArrow()
    books = np.ascontiguousarray(matrix(first["x"]).reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    blocks = pin(rows.select("chunk", "row", "x").groupBy("chunk").applyInArrow(_blocks_of, BLOCKS), "blocks")
    for _ in range(ROUNDS):
        books = moved(books, entry_sums(blocks, books))
    return _codes(rows, blocks, books).withColumn("codebooks_sha256", F.lit(digest(books)))


def integer_rows(df: DataFrame) -> DataFrame:
    """(row, chunk, size, vec_id, label, x), pinned: the vectors that take part, as integers, padded with zeros to equal parts."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    width = F.greatest(F.lit(1), F.ceil(F.size("embedding") / PARTS)) * PARTS
    padded = F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), (width - F.size("embedding")).cast("int")))
    number = F.monotonically_increasing_id()
    rows = df.filter(finite("embedding")).select(
        number.alias("row"), F.shiftright(number, CHUNK_ROWS.bit_length() - 1).alias("chunk"),
        F.size("embedding").alias("size"), F.col("vec_id").cast("bigint").alias("vec_id"), "label", padded.alias("x"),
    )
    return pin(rows, "integers")


def vector_codes(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a vector of finite components.

    Other rows are dropped; a table without any gives no rows. A null id or label is kept; null labels are one label. The
    first codebooks come from the smallest ids, nulls last, rows of one id by their components; fewer rows than entries
    make smaller books. Repeated rows are rows of their own. Vectors of different lengths have codebooks of their own; a
    length that is no multiple of the parts is filled up with zeros. Components beyond 2**18 are too large for exact
    64-bit distances and raise an error.
    """
    rows = integer_rows(df)
    largest = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    if largest and largest > SCALE << 18:
        raise ValueError(f"a component of {largest / SCALE} is too large for exact codes")
    done = None
    for size in lengths(rows, F.col("size")):
        part = compress(rows.filter(F.col("size") == size))
        done = part if done is None else done.unionByName(part)
    if done is None:
        return rows.select("vec_id", *(F.lit(None).cast(k).alias(c) for c, k in (
            ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string"))))
    done = pin(done, "codes")
    sums = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    return done.join(broadcast_if_small(sums), same).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
