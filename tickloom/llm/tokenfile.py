"""Token ids in files: canonical length-limited Huffman codes from global counts, blocks with bit-offset checkpoints."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Shared, staged
from tickloom.session import scratch_path

MAX_BITS = 16
STEP = 256
BLOCK_IDS = 1 << 17
CACHE_PIECES = 350_000
HEAD_CHARS = 32
END_ID = 2
SPACE = chr(256 + 32)  # the byte 32 is the 33rd of the hidden ones

BLOCK = ("part int, first long, doc_ids array<long>, lengths array<long>, n_ids long, "
         "checkpoints array<long>, payload binary")


class Cached:
    """The tokenizers library behind a table of pieces that it has already encoded.

    The file's pattern starts a new piece at every single space and line feed and between letters and a full stop or
    comma, so there the library's answer does not depend on the context. Texts with other white space go to the library
    whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.known: dict[str, bytes] = {}
        d = json.loads(spec)
        plain = d["normalizer"] is None and d["pre_tokenizer"]["type"] == "ByteLevel" and d["pre_tokenizer"]["use_regex"]
        self.symbols = byte_symbols() if plain and not d["pre_tokenizer"]["add_prefix_space"] else None
        self.stops = dict(zip(".,\n", self._encoded([".", ",", "\n"])))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _word(self, letters: str, line: bool) -> bytes:
        """Ids of letters after a space, or after a line feed: one piece, so the library's model may have it directly."""
        if letters.isascii():  # whose bytes stand for themselves
            piece = letters if line else SPACE + letters
        else:
            piece = (letters if line else " " + letters).encode("utf-8").decode("latin-1").translate(self.symbols)
        ids = array("I", [t.id for t in self.library.model.tokenize(piece)]).tobytes()
        return self.stops["\n"] + ids if line else ids

    def _learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces: "\nword" begins a line, "word" follows a space, "." and "," may follow the letters."""
        known, stops, others = self.known, self.stops, []
        for p in pieces:
            core = p[:-1] if p[-1] in ".," else p
            line = core[:1] == "\n"
            letters = core[1:] if line else core
            # letters of old scripts are the same in every version of Unicode
            if self.symbols is None or not letters.isalpha() or not (letters.isascii() or max(letters) < "\u0530"):
                others.append(p)
                continue
            ids = known.get(core)
            if ids is None:
                ids = known[core] = self._word(letters, line)
            if core is not p:
                known[p] = ids + stops[p[-1]]
        for start in range(0, len(others), 5_000):
            part = others[start:start + 5_000]
            known.update(zip(part, self._encoded([p if p[:1] == "\n" else " " + p for p in part])))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, cut = self.known, []
        for t in texts:
            line = t.replace("\n", " ")
            # printable characters have no white space but the space
            if t and line.isprintable() and "  " not in line and line[0] != " " != line[-1]:
                cut.append(("\n" + t).replace("\n", " \n")[1:].split(" "))
            else:
                cut.append(None)
        self._learn(set().union(*[c for c in cut if c]) - known.keys())
        out = []
        for t, c in zip(texts, cut):
            if c is None:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4"))
            else:  # less the line feed that stands before the text
                out.append(np.frombuffer(b"".join(map(known.__getitem__, c)), dtype="<u4")[1:])
        return out


def byte_symbols() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones of Latin-1 for themselves, the rest
    counted up from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def slices(batch: pa.RecordBatch, size: int = 2_000_000):
    """Parts of a batch with whole texts, a few MB at a time; a part is a view, nothing is copied."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, before + size)) + 1, len(ends))
        yield batch.slice(start, stop - start)
        start = stop


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Package-merge: the optimal prefix code among those with at most ``most`` bits a symbol."""
    order = sorted(counts, key=lambda s: (counts[s], s))
    n = len(order)
    if n < 2:
        return dict.fromkeys(order, 1)
    if n > 1 << most:
        raise ValueError(f"{n} symbols need more than {most} bits")
    weight = np.array([counts[s] for s in order], dtype=np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(most):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)  # which entries of the sorted list are single symbols
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    bits, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for single in reversed(levels):
        used = int(single[:take].sum())
        bits[:used] += 1
        take = 2 * (take - used)
    return {s: int(b) for s, b in zip(order, bits)}


class Code:
    """Canonical codes: shorter first, then by id; with the table that a decoder indexes by the next bits."""

    def __init__(self, lengths: dict[int, int]):
        self.most = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.bits, self.word = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint64)
        self.symbol = np.zeros(1 << self.most, dtype=np.uint32)
        code = last = 0
        for s, b in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
            code <<= b - last
            last = b
            self.bits[s], self.word[s] = b, code
            low = code << (self.most - b)
            self.symbol[low:low + (1 << (self.most - b))] = s
            code += 1

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' codes one after another, and the bit offset of every STEP-th id."""
        if not len(ids):
            return b"", np.empty(0, dtype=np.int64)
        size = self.bits[ids]
        start = np.concatenate([[0], np.cumsum(size)])
        at, total = start[:-1], int(start[-1])
        # every code lies in one 64-bit frame of two 32-bit words; codes share no bit, so adding them sets them
        frame = self.word[ids] << (64 - size - (at & 31)).astype(np.uint64)
        n = total // 32 + 2
        words = np.bincount(at >> 5, (frame >> np.uint64(32)).astype(np.float64), n)
        words += np.bincount((at >> 5) + 1, (frame & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return words.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::STEP]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """Decodes all stretches between checkpoints side by side, one id of each per step."""
        out = np.zeros((len(checkpoints), STEP), dtype="<u4")
        data = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, last = np.asarray(checkpoints, dtype=np.int64).copy(), (len(payload) + 4) * 8
        for k in range(STEP):
            ahead = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.most)
            out[:, k] = self.symbol[ahead]
            at = np.minimum(at + self.bits[out[:, k]], last)  # the last stretch may end early
        return out.reshape(-1)[:n]


def _spec(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def planes(ids: np.ndarray) -> bytes:
    """Little-endian 32-bit ids with all first bytes first, then all second ones, ...: a form that compresses well."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(payload: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(payload, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, head, row, ids, counts): the ids of each text as ``planes``, in the order of the scan, so texts do not
    move. ``head`` has the text's first characters.

    A task's last row has no ids but how often each id occurred in the task, as 64-bit integers.
    """
    shared = Shared(docs.sparkSession, "encoder", _spec(path), Cached)

    def encode(batches):
        encoder, total, doc_id = shared.get(), np.zeros(1, dtype=np.int64), None
        for batch in batches:
            for part in slices(batch):
                doc_id, texts = part.column("doc_id"), part.column("text").to_pylist()
                found = [np.append(ids, np.uint32(end_id)) for ids in encoder([t or "" for t in texts])]
                count = np.bincount(np.concatenate(found), minlength=len(total))
                count[: len(total)] += total
                total = count
                yield pa.RecordBatch.from_arrays(
                    [doc_id, part.column("head"), part.column("row"), pa.array([planes(ids) for ids in found], pa.binary()),
                     pa.nulls(len(found), pa.binary())], names=names)
        if doc_id is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, doc_id.type), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([total.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "head", "row", "ids", "counts"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    head = F.substring("text", 1, HEAD_CHARS).alias("head")
    return docs.select("doc_id", head, F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        encode, f"doc_id {kind}, head string, row long, ids binary, counts binary")


def id_counts(plain: DataFrame) -> dict[int, int]:
    """How often each id occurs: the driver gets a row per id, at most a vocabulary's worth."""

    def entries(batches):
        for pdf in batches:
            for payload in pdf.counts:
                total = np.frombuffer(payload, dtype=np.int64)
                used = np.flatnonzero(total)
                yield pd.DataFrame({"id": used, "n": total[used]})

    rows = plain.where(F.col("counts").isNotNull()).select("counts").mapInPandas(entries, "id long, n long")
    return {r.id: r.n for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes (doc_id, text) and writes ``folder``/blocks and ``folder``/code, in ascending order of doc_id.

    Texts are encoded where they are read; what moves for the order are compressed ids. A block holds whole documents,
    about BLOCK_IDS ids; it can be decoded without any other and has the bit offset of every STEP-th id. Files are
    written by Spark's committer, so a lost executor leaves no half block.

    A null text counts as empty; its document still has the end id. A null doc_id comes first; documents with the same
    doc_id follow one another by their first characters, then as they were read, and are spread over tasks. A very long text is one
    block with 64-bit offsets. Other columns are not read. An empty table gives an empty folder of blocks. Up to 2^16
    different ids may occur, as codes have 16 bits at most.
    """
    spark = docs.sparkSession
    plain = staged(encoded(docs.select("doc_id", "text"), path, end_id), "plain-ids")
    lengths = code_lengths(id_counts(plain))
    spark.createDataFrame([(int(s), b) for s, b in lengths.items()], "id long, bits int").coalesce(1).write.parquet(
        f"{folder}/code")
    code = Shared(spark, "code", lengths, Code)

    def blocks(batches):
        from pyspark import TaskContext

        table, part, first, names, waiting, size = code.get(), TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            ids = np.concatenate(waiting)
            payload, marks = table.pack(ids)
            return pd.DataFrame([{
                "part": part, "first": first, "doc_ids": names, "lengths": [len(i) for i in waiting], "n_ids": len(ids),
                "checkpoints": marks.tolist(), "payload": payload}])

        for pdf in batches:
            for name, payload in zip(pdf.doc_id.astype(object).where(pdf.doc_id.notna(), None), pdf.ids):
                names.append(None if name is None else int(name))
                waiting.append(unplaned(payload))
                size += len(waiting[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    first, names, waiting, size = first + size, [], [], 0
        if waiting:
            yield block()

    order = ["doc_id", "head", "row"]
    (plain.where(F.col("counts").isNull()).select(*order, "ids")
     .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
     .mapInPandas(blocks, BLOCK).write.option("compression", "uncompressed").parquet(f"{folder}/blocks"))


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before it), n_tokens, and ids or their crc32."""
    code = Shared(spark, "code", {r.id: r.bits for r in spark.read.parquet(f"{folder}/code").collect()}, Code)
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    # one row per written partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))
    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens")] + [last])

    def documents(batches):
        table = code.get()
        for pdf in batches:
            for r in pdf.itertuples():
                ids = table.unpack(bytes(r.payload), r.checkpoints, r.n_ids)
                ends = np.cumsum(r.lengths)
                starts = ends - r.lengths
                runs = [ids[a:b] for a, b in zip(starts, ends)]
                yield pd.DataFrame({
                    "doc_id": pd.array([None if d is None or d != d else int(d) for d in r.doc_ids], dtype="Int64"),
                    "start": r.base + r.first + starts, "n_tokens": np.asarray(r.lengths, dtype="int64"),
                    last.name: [zlib.crc32(x.tobytes()) if digest else x.tolist() for x in runs]})

    return blocks.join(parts, "part").mapInPandas(documents, shape)


def stored_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents to a folder below spark.checkpoint.dir and reads their places and checksums back."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, folder, path)
    return read_ids(docs.sparkSession, folder, digest=True)
