"""Token ids as independent zstandard frames with a trailing seek table (operator 1).

A shard file follows the public seekable zstandard layout. In order:

* a skippable frame with a JSON header: ``{"ids": "<u2" or "<u4", "end_id": ...}``;
* one zstandard frame a document with its ids, little-endian; a document above ``frame_ids`` ids
  takes several frames. A reader decompresses only the frames of the documents it wants;
* a skippable frame with the shard's documents: count, then per document its id, whether that id
  is null, the number of its first frame, and its number of ids;
* the seek table, a skippable frame: sizes of every frame above and the low 32 bits of the xxh64
  of what it decompresses to, then the number of frames, a descriptor and the magic number.

Writing ranges the documents by (doc_id, hash of the text), so shards hold ascending ids. Each
task attempt writes a file of its own name; only names that come back with a finished task are in
the manifest, so a lost executor leaves nothing but an unused file. Files are opened through
pyarrow's file systems, by the URI of the shared folder.

Defined results: a null text is an empty one; an empty text has just the end id; repeated rows
are documents of their own next to each other; null ids come first; an empty table makes no shard
and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, batches, restored, scratch, texts_of, tokenizer

HEADER, DOCS, SEEK, SEEKABLE = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
SHARDS = "file string, first_id long, first_hash long, n_docs long, n_ids long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Frames of one shard, then its documents and seek table."""

    def __init__(self, uri: str, dtype: np.dtype, end_id: int, level: int, frame_ids: int) -> None:
        import xxhash
        import zstandard

        system, path = _open(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.dtype, self.frame_ids = system.open_output_stream(path, compression=None), dtype, frame_ids
        self.sum64, self.squeeze = xxhash.xxh64_intdigest, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int]] = []
        self.bytes = 0
        self._skippable(HEADER, json.dumps({"ids": dtype.str, "end_id": end_id}).encode())

    def _put(self, frame: bytes, plain: bytes) -> None:
        self.out.write(frame)
        self.bytes += len(frame)
        self.table.append((len(frame), len(plain), self.sum64(plain) & 0xFFFFFFFF))

    def _skippable(self, magic: int, body: bytes) -> None:
        self._put(struct.pack("<II", magic, len(body)) + body, b"")

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, doc_id == NULL_ID, len(self.table), len(ids)))
        for i in range(0, max(len(ids), 1), self.frame_ids):
            plain = ids[i : i + self.frame_ids].astype(self.dtype, copy=False).tobytes()
            self._put(self.squeeze(plain), plain)

    def close(self) -> None:
        cols = [np.array([d[i] for d in self.docs], t) for i, t in enumerate(("<i8", "u1", "<u4", "<u8"))]
        self._skippable(DOCS, struct.pack("<I", len(self.docs)) + b"".join(c.tobytes() for c in cols))
        body = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        tail = struct.pack("<II", SEEK, len(body)) + body
        self.out.write(tail)
        self.bytes += len(tail)
        self.out.close()


class ShardReader:
    """Documents of one shard; only the frames asked for are read and decompressed.

    A reader of the whole shard reads ahead in large blocks instead of once a document.
    """

    AHEAD = 8 << 20

    def __init__(self, uri: str, whole: bool = False) -> None:
        import zstandard

        system, path = _open(uri)
        self.file, self.unpack = system.open_input_file(path), zstandard.ZstdDecompressor().decompress
        self.whole, self.block, self.block_at = whole, b"", 0
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri}: no seek table at its end")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        head = json.loads(self._frame(0)[8:])
        self.dtype, self.end_id = np.dtype(head["ids"]), head["end_id"]
        body = self._frame(n - 1)[8:]
        (k,) = struct.unpack_from("<I", body)
        at, cols = 4, []
        for t in ("<i8", "u1", "<u4", "<u8"):
            cols.append(np.frombuffer(body, t, k, at))
            at += k * np.dtype(t).itemsize
        self.ids, self.null, self.first, self.count = cols
        self.stop = np.concatenate([self.first[1:], [n - 1]]) if k else self.first

    def _at(self, where: int, n: int) -> bytes:
        if not self.whole:
            self.file.seek(where)
            return self.file.read(n)
        if not self.block_at <= where <= where + n <= self.block_at + len(self.block):
            self.file.seek(where)
            self.block, self.block_at = self.file.read(max(n, self.AHEAD)), where
        return self.block[where - self.block_at : where - self.block_at + n]

    def _frame(self, i: int) -> bytes:
        return self._at(int(self.offset[i]), int(self.table[i, 0]))

    def tokens(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, checked against the seek table."""
        import xxhash

        a, b = int(self.first[k]), int(self.stop[k])
        raw, at, parts = self._at(int(self.offset[a]), int(self.offset[b] - self.offset[a])), 0, []
        for i in range(a, b):
            plain = self.unpack(raw[at : at + int(self.table[i, 0])], max_output_size=max(1, int(self.table[i, 1])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[i, 2]:
                raise ValueError(f"frame {i}: its checksum doesn't match")
            at += int(self.table[i, 0])
            parts.append(plain)
        return np.frombuffer(b"".join(parts), self.dtype)


def write(docs: DataFrame, path: str, vocabulary: str, kind: str = "words", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 1, frame_ids: int = 1 << 20) -> list[dict]:
    """Encodes every text, writes shards below path, and returns the manifest in ascending order.

    The manifest has one entry a shard (a task's output), never one a document; it is also written
    as ``manifest.json`` beside the shards.
    """

    def shard(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(vocabulary, kind)
        out, name, first, n_ids = None, f"{path}/ids-{uuid.uuid4().hex}.zst", None, 0
        for pdf in parts:
            texts, keys, hashes = pdf["text"].tolist(), pdf["doc_id"].tolist(), pdf["h"].tolist()
            for a, b in batches(texts):
                if out is None:
                    out, first = ShardWriter(name, t.dtype, end_id, level, frame_ids), (keys[a], int(hashes[a]))
                ids, ends = t.encode_ended(texts[a:b], end_id)
                n_ids += len(ids)
                for key, x, y in zip(keys[a:b], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out.add(key, ids[x:y])
        t.rest()
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "first_id": [first[0]], "first_hash": [first[1]], "n_docs": [len(out.docs)], "n_ids": [n_ids], "bytes": [out.bytes]})

    keyed = texts_of(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    found = [r.asDict() for r in ranged.mapInPandas(shard, SHARDS).collect()]
    found.sort(key=lambda r: (r["first_id"], r["first_hash"]))
    start = 0
    for r in found:
        r["start"], start = start, start + r["n_ids"]
    system, root = _open(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(found).encode())
    return found


def read(spark: SparkSession, manifest: list[dict], doc_ids: set[int] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the shards; with doc_ids, of those only."""
    schema = READ + (", ids array<long>" if with_ids else "")

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for uri, start in zip(pdf["file"], pdf["start"], strict=True):
                r = ShardReader(uri, whole=doc_ids is None)
                starts = int(start) + np.concatenate([[0], np.cumsum(r.count[:-1], dtype=np.int64)]) if len(r.count) else r.count
                wanted = range(len(r.ids)) if doc_ids is None else [k for k in range(len(r.ids)) if int(r.ids[k]) in doc_ids]
                rows = []
                for k in wanted:
                    ids = r.tokens(k)
                    rows.append((int(r.ids[k]), int(starts[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    files = spark.createDataFrame([(r["file"], r["start"]) for r in manifest], "file string, start long")
    return restored(files.repartition(max(1, len(manifest))).mapInPandas(load, schema))


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(docs, scratch(spark, "token-frames"), public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, manifest)
