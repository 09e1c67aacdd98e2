"""Token ids in Arrow files of equal-length sequences with masks.

Texts are encoded with a word-level BPE tokenizer, an end id follows each document, and
the ids of ascending doc_ids form one stream. Each range of doc_ids becomes one shard
file in Arrow's random-access format: record batches of ``fixed_size_list<uint16>[L]`` ids
(uint32 where the vocabulary needs it) and ``fixed_size_list<bool>[L]`` masks (true: an id,
false: padding after the last id of the shard), one bit each. A reader maps the file and
gets any sequence and its mask as views of it, without a copy.

Words are encoded once: text is cut at ASCII white space, which no token of the tokenizer
spans, and each distinct word (ASCII letters in lower case, since the tokenizer lowers
them anyway) is encoded by the library and kept in the Python worker, in two halves of which the
older goes when the younger has ``TABLE_ENTRIES``. A task writes under a temporary name and renames, so a repeated
task leaves the same file. Texts are shuffled once, by ranges of doc_id (even under a hot
source; a doc_id repeated very often stays in one range). Offsets across shards are sums
of one number per shard.

Null and empty texts hold the end id only. Null doc_ids come first, equal ones by text.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import new_path, quiet_tokenizers, stored, tokenizer_file

TOKENIZER, END_ID = "word_bpe_49k.json", 2
LENGTH, SEQUENCES = 512, 256  #: ids in a sequence, sequences in a record batch
TABLE_ENTRIES, LONG, JOINED = 450_000, 64, 128
MARKS = ".,!?;:%&*$#|"  #: trailing characters that end a group of letters
_workers: dict[str, WordTable] = {}


class WordTable:
    """Distinct words of one tokenizer: word -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.specials = any(True for _ in self.tok.get_added_tokens_decoder())
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for p, i in self.tok.get_vocab().items() if p.endswith("</w>")]] = True
        self.table: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def plain(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, many to one call: each ends at its end-of-word id."""
        out: list[bytes] = []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self.plain([" ".join(g) for g in groups])):
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 4).tolist()
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                out += [ids[a:b] for a, b in zip([0, *cuts], cuts)]
            else:
                out += self.plain(group)
        return out

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words missing from the table; trailing punctuation is a token group of its own."""
        texts = [w.decode("utf-8", "replace") for w in words]
        pure, split, rest = {s for s in texts if s.isalpha()}, {}, []
        for s in texts:
            if s not in pure:
                stem = s.rstrip(MARKS)
                if stem.isalpha():
                    split[s] = stem, s[len(stem) :]
                else:
                    rest.append(s)
        table = self.table
        stems = [*pure, *(x for x in {x for x, _ in split.values()} - pure if x.encode() not in table)]
        rest += [m for m in {m for _, m in split.values()} if m.encode() not in table]
        new = dict(zip((s.encode() for s in stems), self.letters(stems)))
        new.update(zip((s.encode() for s in rest), self.plain(rest)))
        at = {**{s: table.get(s.encode()) for s, _ in split.values()}, **{m: table.get(m.encode()) for _, m in split.values()}}
        at = {s: i if i is not None else new[s.encode()] for s, i in at.items()}
        new.update((w.encode(), at[s] + at[m]) for w, (s, m) in split.items())
        return new

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of every text."""
        texts = [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]
        parts = [(t if self.specials and b"<|" in t else t.lower()).split() for t in texts]
        if len(self.table) > TABLE_ENTRIES:
            self.old, self.table = self.table, {}
        missing = set().union(*parts).difference(self.table)
        back = missing.intersection(self.old)
        self.table.update((w, self.old[w]) for w in back)
        new = self.learn([*missing.difference(back)])
        at = self.table
        if max(map(len, new), default=0) > LONG:
            at.update((w, i) for w, i in new.items() if len(w) <= LONG)
            at = {w: at[w] if w in at else new[w] for p in parts for w in p}
        else:
            at.update(new)
        return [b"".join(map(at.__getitem__, p)) for p in parts]


def table_of(path: str) -> WordTable:
    if path not in _workers:
        _workers[path] = WordTable(path)
    return _workers[path]


def file_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into equal-length sequences and writes them batch by batch."""

    def __init__(self, folder: str, name: str, length: int = LENGTH, sequences: int = SEQUENCES, wide: bool = False):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.part = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.length, self.sequences = length, sequences
        self.schema, self.dtype = file_schema(length, wide), np.dtype("<u4" if wide else "<u2")
        self.sink = self.fs.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.dtype))
        self.held += len(ids)
        full = self.length * self.sequences
        if self.held >= full:
            flat = np.concatenate(self.rest)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i : i + full], full)
            self.rest = [flat[len(flat) // full * full :]]
            self.held = len(self.rest[0])

    def _write(self, ids: np.ndarray, real: int) -> None:
        cols = [pa.array(ids), pa.array(np.arange(len(ids)) < real)]
        cols = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in cols]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.held:
            pad = np.zeros(-self.held % self.length, self.dtype)
            self._write(np.concatenate([*self.rest, pad]), self.held)
        self.out.close()
        self.sink.close()
        self.fs.move(self.part, self.final)


class SequenceFile:
    """Random access to the sequences of one shard; local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{root}/{name}") if local else fs.open_input_file(f"{root}/{name}")
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if not n else (n - 1) * self.first + self.file.get_batch(n - 1).num_rows

    def __getitem__(self, k: int):
        """Sequence ``k``: views of its ids (numpy) and of its mask (Arrow bits)."""
        batch, at = self.file.get_batch(k // self.first), k % self.first * self.length
        ids, mask = (c.flatten().slice(at, self.length) for c in batch.columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, count: int):
        """Pieces of the ids ``start`` to ``start + count``, one view for each batch they lie in."""
        per, out = self.first * self.length, []
        while count:
            flat = self.file.get_batch(start // per).column(0).flatten().to_numpy(zero_copy_only=True)
            piece = flat[start % per : start % per + count]
            out.append(piece)
            start, count = start + len(piece), count - len(piece)
        return out


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the file system that Spark would take for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def write(docs: DataFrame, text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None, length: int = LENGTH) -> tuple[str, DataFrame]:
    """Write the shards; returns their folder and the stored index (doc_id, shard, at, n_tokens)."""
    path = tokenizer or tokenizer_file(TOKENIZER)
    folder = folder or new_path(docs.sparkSession, "token-ids")
    folder = qualified(docs.sparkSession, folder)
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        from pyspark import TaskContext

        shard, out, at = TaskContext.get().partitionId(), None, 0
        table, end = table_of(path), array("I", [end_id]).tobytes()
        wide = table.tok.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        for b in batches:
            if not b.num_rows:
                continue
            out = out or SequenceWriter(folder, f"shard-{shard:06d}.arrow", length, wide=wide)
            starts, counts = [], []
            for ids in table.encode([x or b"" for x in b.column(1).to_pylist()]):
                out.add(np.frombuffer(ids + end, "<u4"))
                starts.append(at)
                counts.append(len(ids) // 4 + 1)
                at += counts[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shard] * b.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "shard", "at", "n_tokens"],
            )
        if out:
            out.close()

    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string("shard int, at bigint, n_tokens bigint")])
    ranged = (
        docs.select("doc_id", F.col(text).cast("binary").alias("__text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__text")
    )
    return folder, stored(ranged.mapInArrow(run, schema), "token-index")


def read(folder: str, index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    spark = index.sparkSession
    # one row per shard: as many as tasks wrote
    totals = sorted((r.shard, r.n) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = [], 0
    for shard, n in totals:
        bases.append((shard, base))
        base += n

    def run(batches):
        files: dict[int, SequenceFile] = {}
        for b in batches:
            doc, shard, at, n = b.columns[:4]
            crcs = []
            for s, a, k in zip(shard.to_pylist(), at.to_pylist(), n.to_pylist()):
                if s not in files:
                    files = {s: SequenceFile(folder, f"shard-{s:06d}.arrow")}
                crc = 0
                for piece in files[s].ids(a, k):
                    crc = zlib.crc32(piece.astype("<u4"), crc)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    schema = T.StructType([*index.schema, T.StructField("ids_crc32", T.LongType())])
    checked = index.mapInArrow(run, schema)
    offsets = F.broadcast(spark.createDataFrame(bases, "shard int, base bigint"))
    return checked.join(offsets, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
