"""Token-id files: one zstandard frame for each document and a trailing seek table.

File layout
1. a frame for each document, in ascending doc_id order: its ids, little-endian, ``width`` bytes each;
2. one frame with the index: a JSON line {"documents", "width", "end_id"}, then doc_ids (int64), a flag for a
   null doc_id (uint8) and the numbers of ids (int64), little-endian;
3. the seek table, a skippable frame: compressed size, size and checksum (low 32 bits of XXH64 of
   the content) of every frame before it, then the number of frames, a descriptor and a magic number.

This is the public seekable zstandard layout, so any zstandard tool reads the files, and a reader that
wants a few documents reads the table and the index and decompresses those documents' frames only.

Writing: documents are range-partitioned and sorted by doc_id, each task writes one file under a name of its
own in the shared folder and returns a manifest row.  A retried task writes another file; only files named in
the manifest count.

Defined results
* null or empty text: just the end id; very long texts are one frame, encoded whole;
* a null doc_id comes first; equal doc_ids follow each other, ordered by a hash of their texts;
* an empty table: no files and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK, ODD_SPACE, cut, fresh_path
from lodestone.llm.wordpiece import split_chunk

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Encoded chunks a worker remembers before it starts anew: bounds its memory.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 64

#: The splitting pattern of byte-level tokenizers.  Fixed value.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Encoder:
    """Ids of whole texts by a tokenizer of the ``tokenizers`` library, as packed little-endian bytes.

    A byte-level splitting pattern never joins a character to white space after it.  So a text is cut
    before each run of white space, and each distinct chunk is split and each distinct piece of it goes through
    the library's model once.  Letters beyond the Latin blocks are split by the library itself.  With ``added``
    a text that holds the content of an added token goes through the library whole, so that the token gets its own id;
    without, such content is spelled out like any other.
    """

    def __init__(self, tokenizer_json: str, added: bool = False):
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(tokenizer_json)
        self.library_split, self.merge = whole.pre_tokenizer.pre_tokenize_str, whole.model.tokenize
        self.find, self.letters = regex.compile(_PATTERN).findall, byte_letters()
        self.whole, tokens = whole.encode, whole.get_added_tokens_decoder().values() if added else ()
        # a token that is matched in normalised text may be spelled otherwise in the text itself
        odd = any(t.normalized for t in tokens) and whole.normalizer is not None
        self.added = [""] if odd else [t.content for t in tokens]
        self.width = 2 if whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, spelled: str) -> bytes:
        return b"".join(t.id.to_bytes(self.width, "little") for t in self.merge(spelled))

    def chunk(self, text: str) -> bytes:
        if max(text) >= "\u0250":
            return b"".join(self.piece(piece) for piece, _ in self.library_split(text))
        out = []
        for raw in split_chunk(text, self.find):
            ids = self.pieces.get(raw)
            if ids is None:
                ids = self.piece(raw.encode().decode("latin-1").translate(self.letters))
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                if len(raw) <= REMEMBERED_CHARS:
                    self.pieces[raw] = ids
            out.append(ids)
        return b"".join(out)

    def _known(self, known: dict[str, bytes], keys: list[str], lead: bool) -> bytes:
        found = list(map(known.get, keys))
        k = -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            key = keys[k]
            found[k] = ids = self.chunk(" " + key if lead and key[:1] != "\n" else key)
            if len(key) <= REMEMBERED_CHARS:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = ids
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(content in text for content in self.added):
            ids = self.whole(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(self.width, "little") for i in ids)
        plain = not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or ODD_SPACE.search(text))
        if not plain:
            return self._known(self.chunks, CHUNK.findall(text), False)
        # single spaces and line ends only: a part stands for itself with the space before it
        parts = text.replace("\n", " \n").split(" ")
        first = parts.pop(0)
        return (self._known(self.chunks, [first], False) if first else b"") + self._known(self.parts, parts, True)


#: The encoder of a worker, which goes on from task to task with what it remembers.
_kept: dict[tuple, Encoder] = {}


def worker_encoder(tokenizer_json: str, added: bool) -> Encoder:
    key = zlib.crc32(tokenizer_json.encode()), len(tokenizer_json), added
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(tokenizer_json, added)
    return _kept[key]


class FrameWriter:
    """Writes frames to a binary file and, at the end, the seek table."""

    def __init__(self, file, level: int = 3):
        import zstandard

        self.file, self.table = file, []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def frame(self, content: bytes) -> None:
        import xxhash

        packed = self.pack(content)
        self.file.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, uri: str):
        import numpy as np
        import zstandard

        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        head = size - 9 - 12 * frames - 8
        if struct.unpack("<II", self._at(head, 8)) != (SKIPPABLE, 12 * frames + 9):
            raise ValueError(f"{uri}: damaged seek table")
        self.table = np.frombuffer(self._at(head + 8, 12 * frames), "<u4").reshape(frames, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        line, rest = self.frame(frames - 1).split(b"\n", 1)
        self.about = json.loads(line)
        n = self.about["documents"]
        self.doc_ids = np.frombuffer(rest, "<i8", n)
        self.nulls = np.frombuffer(rest, "u1", n, 8 * n)
        self.counts = np.frombuffer(rest, "<i8", n, 9 * n)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        content = self.unpack(self._at(int(self.begins[k]), int(self.table[k, 0])))
        if len(content) != self.table[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return content

    def ids(self, k: int):
        """Ids of the file's k-th document, as little-endian unsigned 32-bit integers."""
        import numpy as np

        return np.frombuffer(self.frame(k), f"<u{self.about['width']}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        """Places of a document; none if the file has no such document."""
        import numpy as np

        return [int(k) for k in np.flatnonzero((self.doc_ids == doc_id) & (self.nulls == 0))]

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, added: bool = False
) -> DataFrame:
    """Encode and write all documents; the manifest: part, uri, documents, ids, start.

    ``added`` gives the tokenizer's added tokens in a text their ids, as the library's own ``encode`` does.
    ``start`` counts the ids in the files before.  The tokenizer's file is broadcast; its size is fixed.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, out, doc_ids, counts = None, None, [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if out is None:
                    encoder = worker_encoder(shared.value, added)
                    end = end_id.to_bytes(encoder.width, "little")
                    uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                    store, path = FileSystem.from_uri(uri)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    file = store.open_output_stream(path, compression=None)
                    out = FrameWriter(file)
                content = encoder.encode(text.as_py() or "") + end
                out.frame(content)
                doc_ids.append(doc_id)
                counts.append(len(content) // encoder.width)
        if out is None:
            return
        about = {"documents": len(doc_ids), "width": encoder.width, "end_id": end_id}
        nulls = np.array([d is None for d in doc_ids], "u1")
        index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + nulls.tobytes()
        out.frame(json.dumps(about).encode() + b"\n" + index + np.array(counts, "<i8").tobytes())
        out.close()
        file.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "uri": [uri], "documents": [len(counts)], "ids": [sum(counts)]},
            schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]),
        )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    manifest = cut(
        ordered.select("doc_id", "text").mapInArrow(run, "part int, uri string, documents long, ids long"),
        "token-manifest",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files of a manifest."""
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(uri)
                n = len(file.counts)
                crcs = []
                for k in range(n):
                    ids = file.ids(k)
                    if len(ids) != file.counts[k]:
                        raise ValueError(f"{uri}: document {k} has {len(ids)} ids, not {file.counts[k]}")
                    crcs.append(zlib.crc32(ids.tobytes()))
                file.close()
                starts = start + np.concatenate([[0], np.cumsum(file.counts)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, pa.int64(), mask=file.nulls.astype(bool)),
                        pa.array(starts, pa.int64()),
                        pa.array(file.counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    schema=schema,
                )

    files = max(1, manifest.count())
    dealt = manifest.select("part", "uri", "start").repartition(files, "part")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
