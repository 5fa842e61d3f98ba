"""Repeated byte strings by suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier is removed. All LENGTH-byte strings of the corpus
fall under an anchor: the least hashed GRAM in them. At least HALF bytes more lie left or right of it, so strings are keyed
by the anchor and the HALF bytes on that side. Equal strings have equal keys, so strings are dealt to shards
by key, and only those whose key occurs again; by chance that is far rarer than for an anchor alone. A shard sorts its strings with a suffix array (Larsson and
Sadakane's refinement in numpy), takes common prefixes with Kasai's algorithm, and finds the first start of each class
of equal strings; of places whose strings are all equal it sorts the first only. A key with very many places is cut into parts; the first strings of the parts are dealt
by a digest of the whole string and compared with the first of their digest only, so that no task holds the strings of
a key. Documents that equal an earlier one as a whole are removed as a whole and not dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import mix, pin, pin_dealt, shuffle_partitions, slices

#: Bytes of a string that counts, and of an anchor.
LENGTH, GRAM = 100, 40
#: Bytes that any string has on one side of its anchor.
HALF = (LENGTH - GRAM) // 2
#: Places of a key that are sorted together, and bytes of a shard (with one more part it must stay below 2**21).
PART, SHARD_BYTES = 2048, 1 << 20
PLACE = np.uint64((1 << 28) - 1)
FACTOR = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each GRAM-byte string, from hashes of 1, 2, 4, ... bytes."""
    def power(k):
        return np.uint64(pow(FACTOR, k, 1 << 64))

    by_length, n = {1: _BYTES[data]}, 1
    while 2 * n <= GRAM:
        h = by_length[n]
        by_length[2 * n] = h[:-n] * power(n) + h[n:]
        n *= 2
    out, done = by_length[n], n
    while done < GRAM:
        n = max(k for k in by_length if k <= GRAM - done)
        more = by_length[n][done:]
        out = out[: len(more)] * power(n) + more[: len(out)]
        done += n
    return mix(out)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, number of starts) for each run of starts that share an anchor and the side of its longer rest."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
    width, n = LENGTH - GRAM + 1, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < width:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    at = (low & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    at, stop = at[first], np.append(first[1:], len(at))
    middle = np.clip(at - HALF + 1, first, stop)  # starts below it have HALF bytes or more before the anchor
    left, right = np.flatnonzero(first < middle), np.flatnonzero(middle < stop)
    # two overlapping grams stand for the anchor and HALF bytes beside it
    keys = np.concatenate([_pair(h[at[left] - HALF], h[at[left]]), _pair(h[at[right]], h[at[right] + HALF])])
    begin = np.concatenate([first[left], middle[right]])
    count = np.concatenate([middle[left], stop[right]]) - begin
    return keys, begin, count


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(FACTOR) + b)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of fewer than 2**21 bytes: sort by four bytes, then refine the unsorted groups by doubling.

    A negative value ends a piece; the last piece ends so too, or there is one piece without. Every end is below any
    byte and differs from every other, earlier ones are smaller; so a suffix is settled once its end is reached, and
    copies laid side by side cost no further rounds.
    """
    n = len(data)
    ends = np.append(np.flatnonzero(data.astype(np.int64) < 0), n)
    rest = np.repeat(ends, np.diff(ends, prepend=-1))[:n] - np.arange(n)
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(4, np.int64)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key = (key << np.uint64(9)) | np.where(j < rest, padded[j : n + j], np.uint64(0))
    packed = np.sort((key << np.uint64(21)) | np.arange(n, dtype=np.uint64))
    low = np.uint64((1 << 21) - 1)
    sa = (packed & low).astype(np.int64)
    start = np.flatnonzero((np.diff(packed >> np.uint64(21), prepend=np.uint64(2**64 - 1)) != 0) | (rest[sa] < 4))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n)))
    rank[n] = -1
    h, spots = 4, np.arange(n)
    while True:
        group = rank[sa[spots]]
        size = np.bincount(group, minlength=n)
        spots = spots[size[group] > 1]
        if not len(spots):
            return sa
        own = sa[spots]
        later = rank[own + h] + 1
        packed = np.sort((rank[own].astype(np.uint64) << np.uint64(42)) | (later.astype(np.uint64) << np.uint64(21)) | own.astype(np.uint64))
        sa[spots] = (packed & low).astype(np.int64)
        settled = rest[sa[spots]] < 2 * h
        new = np.flatnonzero((np.diff(packed >> np.uint64(21), prepend=np.uint64(2**64 - 1)) != 0) | settled)
        rank[sa[spots]] = np.repeat(spots[new], np.diff(np.append(new, len(spots))))
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int = LENGTH, chain: int = 64) -> np.ndarray:
    """Kasai's algorithm, up to ``most`` bytes and the end of a piece: prefix that each suffix shares with the one before
    it in ``sa``.

    Positions are walked in order, so a prefix shrinks by one byte at most from one to the next; chains of positions
    are walked side by side.
    """
    n = len(data)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    ends = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    out, heads = np.zeros(n, np.int64), np.arange(0, n, chain)
    length = np.zeros(len(heads), np.int64)
    for step in range(chain):
        at = heads + step
        live = at < n
        at, length = at[live], length[: int(live.sum())]
        other = before[at]
        length = np.where(other >= 0, np.maximum(length - 1, 0), 0)
        grow = np.flatnonzero((other >= 0) & (length < most))
        while len(grow):
            a, b, k = at[grow], other[grow], length[grow]
            same = (ends[a + k] == ends[b + k]) & (ends[b + k] >= 0)
            grow = grow[same]
            length[grow] += 1
            grow = grow[length[grow] < most]
        out[at] = length
        heads = heads[: len(at)]
    return out[sa]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, 1):
            hashes, ids, places = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, first, count = anchors(np.frombuffer(text, np.uint8))
                hashes.append(h.view(np.int64))
                ids.append(np.full(len(h), i))
                places.append(first << 7 | count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, places)], ["h", "doc", "place"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a table sorted by h whose h occurs again, with the part of the group they belong to (-1: it is whole).

    Only a group's first PART rows are ever held.
    """
    held, passed = np.zeros((0, 3), np.int64), 0  # rows of the open group; how many of it were passed on
    for batch in _chain(batches):
        rows = np.concatenate([held, batch])
        if not len(rows):
            continue
        start = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
        size = np.diff(np.append(start, len(rows)))
        whole = np.repeat(size, size)
        rank = np.arange(len(rows)) - np.repeat(start, size)
        if passed and rows[0, 0] == open_hash:
            whole[: size[0]] += passed
            rank[: size[0]] += passed
        last = int(start[-1])
        keep_open = whole[-1] <= PART
        done = last if keep_open else len(rows)
        if done:
            take = np.flatnonzero(whole[:done] > 1)
            part = np.where(whole[take] > PART, rank[take] // PART, -1)
            yield _repeat_batch(rows[take], part)
        open_hash, passed = rows[-1, 0], 0 if keep_open else int(rank[-1]) + 1
        held = rows[last:] if keep_open else rows[:0]
    if len(held) > 1:
        yield _repeat_batch(held, np.full(len(held), -1))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.stack([c.to_numpy() for c in batch.columns], 1)


def _repeat_batch(rows: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(rows[:, j]) for j in range(3)), pa.array(part.astype(np.int32))], ["h", "doc", "place", "part"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each repeated anchor: all strings under it, so its starts and LENGTH - 1 bytes more."""
    for big in batches:
        for batch in slices(big, 2):
            h, part, ids, keys, starts, counts, bytes_ = [], [], [], [], [], [], []
            for i, key, text, places in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text", "places"))):
                grams = gram_anchor_lookup(text)
                for p in places:
                    start, count = p["place"] >> 7, p["place"] & 127
                    if grams.get(start) != (p["h"], count):
                        continue  # of another document with the same hash
                    h.append(p["h"])
                    part.append(p["part"])
                    ids.append(i)
                    keys.append(key)
                    starts.append(start)
                    counts.append(count)
                    bytes_.append(text[start : start + count + LENGTH - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(counts, pa.int32()), pa.array(bytes_, pa.binary())],
                ["h", "part", "id", "key", "start", "count", "bytes"],
            )


def gram_anchor_lookup(text: bytes) -> dict[int, tuple[int, int]]:
    h, first, count = anchors(np.frombuffer(text, np.uint8))
    return dict(zip(first.tolist(), zip(h.view(np.int64).tolist(), count.tolist())))


def _order(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Dense numbers of (id, key) in ascending order."""
    order = np.lexsort((keys, ids))
    changed = (np.diff(ids[order], prepend=ids[order[:1]] - 1) != 0) | (np.diff(keys[order], prepend=keys[order[:1]]) != 0)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(changed)
    return out


REMOVED = "id long, key long, start long, stop long, bytes binary"


def _removed_rows(ids, keys, starts, stops, pieces=None) -> pa.RecordBatch:
    tail = pa.nulls(len(ids), pa.binary()) if pieces is None else pa.array(pieces, pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, keys, starts, stops)), tail], ["id", "key", "start", "stop", "bytes"])


def sort_shard(ids, keys, starts, counts, parts, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Removed runs of a shard, and the first strings of its cut anchors."""
    sizes = np.array([len(piece) for piece in pieces])
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.full(int(sizes.sum()) + len(pieces), -1, np.int16)  # an end behind each piece
    data[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(pieces)), sizes)] = np.frombuffer(b"".join(pieces), np.uint8)
    sa = suffix_array(data)
    prefix = common_prefixes(data, sa)
    owner = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = begin[owner] + within  # of every start, in the shard
    class_of = np.empty(len(data), np.int64)
    class_of[sa] = np.cumsum(prefix < LENGTH)
    rank = _order(ids, keys)[owner] << 32 | (starts[owner] + within)
    by_class = np.argsort(class_of[spot], kind="stable")
    edges = np.flatnonzero(np.diff(class_of[spot][by_class], prepend=-1))
    least = np.empty(len(spot), np.int64)
    least[by_class] = np.repeat(np.minimum.reduceat(rank[by_class], edges), np.diff(np.append(edges, len(spot))))
    gone = np.flatnonzero(rank > least)
    if len(gone):
        new = np.flatnonzero((np.diff(owner[gone], prepend=-1) != 0) | (np.diff(within[gone], prepend=-2) != 1))
        last = np.append(new[1:], len(gone)) - 1
        o = owner[gone[new]]
        yield _removed_rows(ids[o], keys[o], starts[o] + within[gone[new]], starts[o] + within[gone[last]] + LENGTH)
    first = np.flatnonzero((rank == least) & (parts[owner] >= 0))
    if len(first):
        new = np.flatnonzero((np.diff(owner[first], prepend=-1) != 0) | (np.diff(within[first], prepend=-2) != 1))
        last = np.append(new[1:], len(first)) - 1
        rows = []
        for a, b in zip(first[new].tolist(), first[last].tolist()):
            o, w = int(owner[a]), int(within[a])
            run = pieces[o][w : int(within[b]) + LENGTH]
            rows.append((ids[o], keys[o], starts[o] + w, starts[o] + w + len(run), run))
        yield _removed_rows(*zip(*rows))


def _unlike(rows: pa.Table, ids, keys, starts, counts, parts) -> tuple[np.ndarray, np.ndarray]:
    """(rows to sort, copies) of a shard. Of equal bytes under a key only the first place is sorted, the others go whole.

    Strings that share an anchor at one place are unlike, so bytes without unlike ones beside them under their key need
    no sorting, unless their key was cut.
    """
    h, same = rows.column("h").to_numpy(), rows.column("bytes").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((starts, keys, ids, same, parts, h))
    of_key = (np.diff(h[order], prepend=h[order[:1]]) != 0) | (np.diff(parts[order], prepend=-2) != 0)
    of_key[0] = True
    first = of_key | (np.diff(same[order], prepend=-1) != 0)
    key = np.cumsum(of_key) - 1
    alone = np.bincount(key[first], minlength=key[-1] + 1) == 1
    return order[first & ~(alone[key] & (parts[order] < 0))], order[~first]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts rows sorted by (h, part) into shards at group ends and sorts each."""
    held: list[pa.RecordBatch] = []

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [rows.column(c).to_numpy().astype(np.int64) for c in ("id", "key", "start", "count", "part")]
        rest, copies = _unlike(rows, *columns)
        ids, keys, starts, counts, _ = (c[copies] for c in columns)
        if len(copies):
            yield _removed_rows(ids, keys, starts, starts + counts + LENGTH - 1)
        if len(rest):
            yield from sort_shard(*(c[rest] for c in columns), rows.column("bytes").take(pa.array(rest)).to_pylist())

    size = 0
    for big in batches:
        for batch in slices(big, 6, SHARD_BYTES // 4):
            group = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)], 1)
            if size >= SHARD_BYTES:
                tail = held[-1]
                end = (tail.column(0)[-1].as_py(), tail.column(1)[-1].as_py())
                same = np.flatnonzero((group != end).any(1))
                cut = int(same[0]) if len(same) else len(group)
                if cut:
                    held.append(batch.slice(0, cut))
                if len(same):
                    yield from run(pa.Table.from_batches(held))
                    held, size = [], 0
                    batch = batch.slice(cut)
                else:
                    continue
            held.append(batch)
            size += batch.nbytes
    if held:
        yield from run(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and place of each LENGTH-byte string in runs of first strings."""
    for big in batches:
        for batch in slices(big, 3, SHARD_BYTES // 4):
            ids, keys, starts, runs = (batch.column(c) for c in range(4))
            runs = runs.to_pylist()
            counts = np.array([len(run) - LENGTH + 1 for run in runs])
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            digests = [hashlib.blake2b(run[w : w + LENGTH], digest_size=16).digest() for run in runs for w in range(len(run) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), *(pa.array(np.repeat(c.to_numpy(), counts)) for c in (ids, keys)),
                 pa.array(np.repeat(starts.to_numpy(), counts) + within)], ["digest", "id", "key", "start"],
            )


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in the order of digest and place: those that are not at the first place of their digest go.

    Only that place is held. A repeated row is at the same place and stays.
    """
    digest, head = None, None
    for batch in batches:
        rows = []
        for d, *place in zip(*(c.to_pylist() for c in batch.columns)):
            if d != digest:
                digest, head = d, place
            elif place != head:
                rows.append((*place, place[2] + LENGTH))
        if rows:
            yield _removed_rows(*zip(*rows))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, 1):
            rows = []
            for text, copy, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "runs"))):
                n = len(text)
                if copy and n >= LENGTH:
                    runs = [{"start": 0, "stop": n}]
                change = np.zeros(n + 1, np.int32)
                for r in runs or []:
                    change[r["start"]] += 1
                    change[r["stop"]] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((n, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)


def _among(found: str, *names: str) -> Column:
    """Whether an array of structs, or null, holds the values that the row has under ``names``."""
    return F.coalesce(F.array_contains(found, F.struct(*names)), F.lit(False))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` spans and kept (bytes).

    A byte goes if a LENGTH-byte string over it also starts earlier: under a smaller doc_id, or earlier in the same
    document. Matches never cross documents. Null texts are empty; texts under LENGTH bytes never lose anything. A
    null doc_id is before all others; rows that share a doc_id count as documents in the order of a hash of their
    texts; repeated rows are one document and get the same answer. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("sha")
    )
    # texts are moved here only: all that is found of a document comes to its bucket
    base = pin_dealt(base.withColumn("doc", F.xxhash64("id", "key")), "texts", "doc")
    # whole copies and repeated rows: only ids and digests are moved to find them
    digests = base.groupBy("id", "key", "sha", "doc").agg(F.count(F.lit(1)).alias("n"))
    heads = digests.groupBy("sha").agg(F.min(F.struct("id", "key")).alias("head"), F.sum("n").alias("all")).filter("all > 1")
    marks = digests.join(heads, "sha").select("doc", "id", "sha", (F.col("id") != F.col("head.id")).alias("copy"), (F.col("n") > 1).alias("again"))
    marks = pin(marks.filter("copy or again").distinct(), "copies")
    # documents may share the hash, so they are told apart inside the row
    of_doc = marks.filter("copy").groupBy("doc").agg(F.collect_list(F.struct("id", "sha")).alias("copies"))
    own = base.join(of_doc, "doc", "left").filter(~_among("copies", "id", "sha")).select("doc", "id", "key", "text")
    searched = base.select("doc", "id", "key", "text")
    if not marks.filter("again and not copy").isEmpty():  # repeated rows are searched once
        own = searched = own.dropDuplicates(["doc", "id", "key"])
    places = own.select("doc", "text").mapInArrow(_anchor_rows, "h long, doc long, place long")
    repeated = places.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_repeated, "h long, doc long, place long, part int")
    by_doc = pin(repeated, "places").groupBy("doc").agg(F.collect_list(F.struct("h", "place", "part")).alias("places"))
    # copies have ids of their own, so none of the places is theirs
    contexts = searched.join(by_doc, "doc").select("id", "key", "text", "places").mapInArrow(
        _contexts, "h long, part int, id long, key long, start long, count int, bytes binary"
    )
    dealt = contexts.repartition(n, "h", "part").sortWithinPartitions("h", "part")
    found = pin(dealt.mapInArrow(_shards, REMOVED), "repeats")
    firsts = found.filter("bytes is not null").select("id", "key", "start", "bytes").mapInArrow(
        _strings, "digest binary, id long, key long, start long"
    )
    firsts = firsts.repartition(n, "digest").sortWithinPartitions("digest", "id", "key", "start")
    gone = found.filter("bytes is null").select("id", "key", "start", "stop").union(
        firsts.mapInArrow(_later, REMOVED).select("id", "key", "start", "stop")
    )
    # what is known of a document comes in one table, so that its text is joined once
    known = gone.select(F.xxhash64("id", "key").alias("doc"), F.struct("id", "key", "start", "stop").alias("run"), F.lit(None).cast("struct<id:long,sha:string>").alias("copy")).union(
        marks.filter("copy").select("doc", F.lit(None).cast("struct<id:long,key:long,start:long,stop:long>"), F.struct("id", "sha"))
    )
    runs = known.groupBy("doc").agg(F.collect_list("run").alias("runs"), F.collect_list("copy").alias("copies"))
    its = F.filter("runs", lambda r: (r["id"] == F.col("id")) & (r["key"] == F.col("key")))
    its = F.transform(its, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    every = base.join(runs, "doc", "left").select("doc_id", "text", _among("copies", "id", "sha").alias("copy"), its.alias("runs"))
    out = every.mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,stop:long>>, kept binary",
    )
    return out if with_text else out.drop("spans", "kept")
