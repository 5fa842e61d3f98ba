"""Token ids in fixed-width bit packing, with block offsets for vectorised unpacking and random access.

A shard image is one self-contained byte string, little-endian:

    magic "TPK1" | width u32 | n_docs u64 | n_ids u64 | n_blocks u64
    doc ids   i64[n_docs]   | doc id present u8[n_docs]
    doc starts u64[n_docs + 1], in ids
    block offsets u64[n_blocks + 1], in bytes from the payload's start
    payload: blocks of BLOCK ids of ``width`` bits each, the last one shorter

Images are rows of a Parquet table (part, seq, first_id, n_ids, image), so Spark's committer makes a lost task harmless.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import BATCH_BYTES, forget, kept, local_offsets, pin, shuffle_partitions, slices, text_bytes
from riskloom.session import scratch_path

#: Ids of a block (a multiple of 8, so that blocks start on bytes) and ids after which an image is closed.
BLOCK, IMAGE_IDS = 4096, 1 << 20
MAGIC, HEADER = b"TPK1", np.dtype([("width", "<u4"), ("n_docs", "<u8"), ("n_ids", "<u8"), ("n_blocks", "<u8")])
#: Widths whose fields are machine integers.
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}
#: Pieces a worker remembers.
MEMO_PIECES = 1_000_000

VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def width_of(vocabulary_size: int) -> int:
    """Fewest bits that hold every id."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive ``width``-bit little-endian fields; eight ids fill ``width`` bytes."""
    if width in WHOLE:
        return ids.astype(WHOLE[width]).tobytes()
    lanes = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), width), np.uint8)
    for byte in range(width):
        value = np.zeros(len(lanes), np.uint64)
        for lane in range(8):
            shift = lane * width - byte * 8
            if -width < shift < 8:
                value |= lanes[:, lane] << np.uint64(shift) if shift >= 0 else lanes[:, lane] >> np.uint64(-shift)
        out[:, byte] = value.astype(np.uint8)
    return out.tobytes()[: (len(ids) * width + 7) // 8]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if width in WHOLE:
        return np.frombuffer(data, WHOLE[width], n).astype(np.uint32)
    groups = -(-n // 8)
    raw = np.zeros(groups * width, np.uint8)
    raw[: min(len(data), len(raw))] = np.frombuffer(data, np.uint8)[: len(raw)]
    raw = raw.reshape(groups, width).astype(np.uint64)
    out = np.zeros((groups, 8), np.uint64)
    for lane in range(8):
        for byte in range(lane * width // 8, (lane * width + width - 1) // 8 + 1):
            shift = byte * 8 - lane * width
            out[:, lane] |= raw[:, byte] << np.uint64(shift) if shift >= 0 else raw[:, byte] >> np.uint64(-shift)
    return (out & np.uint64((1 << width) - 1)).ravel()[:n].astype(np.uint32)


def write_image(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[i : i + BLOCK], width) for i in range(0, len(flat), BLOCK)]
    head = np.array([(width, len(ids), len(flat), len(blocks))], HEADER)
    starts = np.cumsum([0, *map(len, ids)]).astype("<u8")
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([
        MAGIC, head.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(), starts.tobytes(), offsets.tobytes(), *blocks,
    ])


class Image:
    """Reads an image: its documents, or any run of ids without touching other blocks."""

    def __init__(self, data: bytes | memoryview):
        if data[:4] != MAGIC:
            raise ValueError("not a token image")
        self.data = data
        at = 4 + HEADER.itemsize
        self.width, n, self.n_ids, blocks = (int(x) for x in np.frombuffer(data, HEADER, 1, 4)[0])
        ids = np.frombuffer(data, "<i8", n, at)
        present = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(i) if p else None for i, p in zip(ids, present)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // BLOCK, -(-stop // BLOCK)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = self.payload + self.offsets[first], self.payload + self.offsets[last]
        have = min(last * BLOCK, self.n_ids) - first * BLOCK
        return unpack(self.data[a:b], have, self.width)[start - first * BLOCK : stop - first * BLOCK]


#: A text falls into pieces (white space and what follows) that the pre-tokenizer never joins.
PIECE = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Other white space: such texts are given to the library whole.
ODD_ASCII = [chr(c) for c in range(0x1C, 0x20)]
ODD_SPACE = re.compile("[%s]" % "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))
SPACES = " \t\n\r\x0b\x0c"
#: Found in texts whose pieces are not what stands between single spaces and line feeds.
UNPLAIN = r"[\x00\t\r\x0b\x0c%s]|\A[ \n]|[ \n]\z|[ \n][ \n]" % "".join(rf"\x{{{ord(c):x}}}" for c in ODD_SPACE.pattern[1:-1])


def _key(piece: str) -> str:
    """Pieces after one space go by what follows it, after one line feed as they are, others with a zero in front."""
    if piece[0] == " " and len(piece) > 1 and piece[1] not in SPACES:
        return piece[1:]
    return piece if piece[0] == "\n" and piece[-1] not in SPACES and piece[1] not in SPACES else "\0" + piece


def _piece(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def piece_keys(text: str) -> list[str] | None:
    """Keys of a text's pieces; None if it has to be encoded whole."""
    if not text:
        return []
    if "\0" in text or (any(c in text for c in ODD_ASCII) if text.isascii() else ODD_SPACE.search(text)):
        return None
    return [_key(p) for p in PIECE.findall(text)]


class Encoder:
    """Encodes texts with the library, each distinct piece once."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)  # one character of the byte alphabet per byte
        self.memo: dict[str, bytes] = {}
        self.marks = {c: self.whole(c) for c in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, keys: list[str], into: dict[str, bytes]) -> None:
        """Encodes many pieces in a few calls; token lengths in bytes tell where each piece ends."""
        # a letter or digit and the mark that ends a piece are never joined: such pieces follow from what is before it
        ended = {k: k[:-1] for k in keys if k[-1] in self.marks and k[-2:-1].isalnum() and k[0] != "\0"}
        stems = set(ended.values()) - self.memo.keys()
        joined = [k for k in {*keys, *stems} if k[0] != "\0" and k not in ended]
        for i in range(0, len(joined), 64 * 256):
            runs = [joined[j : j + 256] for j in range(i, min(i + 64 * 256, len(joined)), 256)]
            pieces = [list(map(_piece, run)) for run in runs]
            found = self.library.encode_batch_fast(list(map("".join, pieces)), add_special_tokens=False)
            for run, own, code in zip(runs, pieces, found):
                ids = np.array(code.ids, "<u4")
                ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in own])
                cuts = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 4).tolist()
                data = ids.tobytes()
                into.update((k, data[a:b]) for k, a, b in zip(run, [0, *cuts], cuts))
        for k in keys:
            if k in ended:
                into[k] = (into.get(ended[k]) or self.memo[ended[k]]) + self.marks[k[-1]]
            elif k[0] == "\0":
                into[k] = self.whole(_piece(k))

    def _distinct(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one behind the other, and their numbers."""
        found = list(map(self.memo.get, keys))
        new = [k for k, ids in zip(keys, found) if ids is None]
        if new:
            into = self.memo if len(self.memo) + len(new) <= MEMO_PIECES else {}
            self._learn(new, into)
            found = [into[k] if ids is None else ids for k, ids in zip(keys, found)]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text. Pieces are told apart and numbered by Arrow; a distinct one is looked up once a call."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = np.asarray(pc.or_(pc.match_substring_regex(texts, UNPLAIN), pc.equal(pc.binary_length(texts), 0)))
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        # single spaces and line feeds only: plain splitting finds the same pieces
        split = pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), ""), " ")
        others = texts.take(pa.array(rest)).to_pylist()
        cut = [piece_keys(t) for t in others]
        pieces = pa.concat_arrays([split.flatten(), pa.array([k for keys in cut for k in keys or ()], pa.string())]).dictionary_encode()
        ids, counts = self._distinct(pieces.dictionary.to_pylist())
        own = pieces.indices.to_numpy()
        n = counts[own]
        ends = np.append(0, np.cumsum(n))
        flat = ids[np.repeat((np.cumsum(counts) - counts)[own] - ends[:-1], n) + np.arange(ends[-1])]
        n_pieces = np.append(np.asarray(pc.list_value_length(split)), [len(keys or ()) for keys in cut]).astype(np.int64)
        stops = ends[np.cumsum(n_pieces)].tolist()
        out: list[np.ndarray] = [None] * len(texts)
        for at, a, b in zip([*plain.tolist(), *rest.tolist()], [0, *stops], stops):
            out[at] = flat[a:b]
        for at, text, keys in zip(rest.tolist(), others, cut):
            if keys is None:
                out[at] = np.frombuffer(self.whole(text), "<u4")
        return out


def encoder(vocabulary: str) -> Encoder:
    """One per worker process."""
    return kept(f"encoder {vocabulary}", lambda: Encoder(vocabulary))


IMAGES = "part int, seq int, first_id long, n_ids long, n_docs long, image binary"


def _images(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        width, part = width_of(max(own.size, end_id + 1)), TaskContext.get().partitionId()
        names, docs, held, first, seq = [], [], 0, 0, 0

        def close():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_id": [first],
                "n_ids": [held], "n_docs": [len(names)], "image": [write_image(names, docs, width)],
            })

        for big in batches:
            for batch in slices(big, 1, 2 * BATCH_BYTES):
                for name, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1))):
                    names.append(name)
                    docs.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= IMAGE_IDS:
                        yield close()
                        names, docs, first, held, seq = [], [], first + held, 0, seq + 1
        if names:
            yield close()
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encodes the texts of ``docs`` (doc_id, text) and writes images in ascending doc_id order, nulls first.

    Null texts count as empty: just the end id. Rows that share a doc_id follow each other in the order of their
    texts. An empty table writes no image. Other columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
    dealt = keyed.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    dealt.select("doc_id", "text").mapInArrow(_images(vocabulary, end_id), IMAGES).write.parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()  # the encoder of the writing tasks
    for batch in batches:
        for part, first, data in zip(*(batch.column(c) for c in ("part", "first_id", "image"))):
            part, first, image = part.as_py(), first.as_py(), Image(memoryview(data.as_buffer()))  # not copied
            ids = image.ids(0, image.n_ids).astype("<u4", copy=False)
            spans = list(zip(image.starts[:-1].tolist(), image.starts[1:].tolist()))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(spans), pa.int32()), "doc_id": pa.array(image.doc_ids, pa.int64()),
                "local": pa.array([first + a for a, _ in spans], pa.int64()),
                "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()),
            })


def read_digests(images: DataFrame) -> DataFrame:
    """Per document of written images: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as u32)."""
    offsets = local_offsets(images, [], "part", F.sum("n_ids"))  # one row per written partition
    rows = images.select("part", "first_id", "image").mapInArrow(
        _digests, "part int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("_before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes the images of ``docs`` to the shared folder and returns what the written files say of each document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_digests(spark.read.schema(IMAGES).parquet(path))
