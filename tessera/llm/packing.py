"""Packing into training windows by lexical retrieval.

1. Every text is tokenised once; tasks also count in how many documents each vocabulary id occurs. The
   counts of all documents are one vector as long as the vocabulary, added up in Spark.
2. Documents are range-partitioned by a weighted min-wise sample of their ids, so that documents
   that share rare ids lie close together. The key ends in the row's number, so copies by the
   thousand spread like any other rows.
3. Each partition is cut into shards of about ``SHARD_TOKENS`` tokens. A shard has an inverted index of
   its documents' ids with BM25 weights (inverse document frequencies and the mean length are those
   of the whole corpus). A document fills its whole windows itself; the rest of it is a seed: the
   index returns all unused documents of the shard by falling score, and they fill the seed's window
   in that order. The one that does not fit is cut and its rest is the next seed, so every window
   is full but the shard's last, which is cut into powers of two and needs no padding either.

Terms are the tokenizer's ids, not words: their number is fixed, so counts are exact at any corpus size.

Defined cases: null text is the empty text, which is the end id alone; texts are encoded whole, of
any length; ties in score go by the shard's order; equal rows are documents of their own; null keys
are kept; an empty table gives no pieces; columns other than the key and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tessera.llm.common import quote, stage

WINDOW = 2048
#: The id that ends every document.
END = 1
SHARD_TOKENS = 1 << 20
#: Shards that one task packs at most, one after the other.
SHARDS_PER_TASK = 64
K1, B = 1.2, 0.75
#: Characters from which on a text goes through the tokenizer itself.
LONG = 1_000_000
#: Tasks that add up the document counts.
ADDERS = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ tokenising
def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of the pieces' bytes, if the tokenizer is a plain byte-level BPE whose ids follow its merges:
    then the pieces of every text follow from the ranks alone. None for any other tokenizer."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
    if not (plain and split and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))):
        return None
    # byte-level models write the printable bytes of Latin-1 as themselves, the others from U+0100 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or len(vocabulary) != 256 + len(pairs):
        return None
    return {bytes(letters[c] for c in k): v for k, v in vocabulary.items()}


class Encoder:
    """Ids of whole texts by a tokenizer file, as packed little-endian integers of ``dtype``.

    Texts of Latin letters go through the ranks of a plain byte-level BPE, which is several times faster
    and gives the same ids; other scripts, whose character classes depend on the Unicode version that a
    library was built with, and other tokenizers go through the tokenizer itself."""

    #: FIXED VALUE: the pattern of byte-level pre-tokenizers.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]").search

    def __init__(self, model: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(model)
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(self.size, end + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = end
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = byte_ranks(spec)
        self.ranks = ranks and tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text and the end id."""
        slow = [self.ranks is None or len(t) > LONG or self.OTHER(t) is not None or any(a in t for a in self.added) for t in texts]
        others = (x for at in range(0, len(texts), 256) for x in self.tokenizer.encode_batch_fast(
            [t for t, s in zip(texts[at : at + 256], slow[at : at + 256]) if s], add_special_tokens=False))
        for text, other in zip(texts, slow):
            ids = next(others).ids if other else self.ranks.encode_ordinary(text)
            ids.append(self.end)
            yield self._packed(ids)

    def _packed(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()


def near_costs(size: int) -> np.ndarray:
    """Exponential costs of the vocabulary's ids for min-wise sampling. Later ids come from later merges,
    so they are rarer and weigh more; a text's cheapest id is then a likely rare one."""
    u = np.random.default_rng(2048).random(size)
    return -np.log(1 - u) / (np.arange(size) + 1.0) ** 2


def tokenised(docs: DataFrame, key: str, text: str, model: str, end: int) -> DataFrame:
    """key, ids, n, near of every row, and one row per task that holds ``df`` alone."""
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(kept.value, end)
        costs, df = near_costs(enc.size), np.zeros(enc.size, np.int64)
        names, keys = ["key", "ids", "n", "near", "df"], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, n, near = batch.column(0), [], [], []
            for packed in enc.encode([t or "" for t in batch.column(1).to_pylist()]):
                seen = np.unique(np.frombuffer(packed, enc.dtype)[:-1])
                df[seen] += 1
                ids.append(packed)
                n.append(len(packed) // enc.dtype.itemsize)
                near.append(int(seen[costs[seen].argmin()]) if len(seen) else -1)
            cols = [keys, pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(near, pa.int64()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if keys is not None:
            none = pa.nulls(1, pa.int64())
            cols = [pa.nulls(1, keys.type), pa.nulls(1, pa.binary()), none, none, pa.array([df.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, t) for c, t in (("ids", T.BinaryType()), ("n", T.LongType()), ("near", T.LongType()), ("df", T.BinaryType()))]])
    return docs.select(F.col(quote(key)).alias("key"), F.col(quote(text)).cast("string").alias("text")).mapInArrow(run, schema)


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each id: the tasks' vectors, added up in a few tasks and then here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["df"])

    parts = rows.filter("df IS NOT NULL").select("df").repartition(ADDERS).mapInArrow(add, "df binary").collect()
    return sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(size, np.int64))


# ------------------------------------------------------------------ one shard
class Index:
    """Inverted index of a shard's documents: for each id, the documents that hold it and their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = K1, b: float = B):
        found = [np.unique(d[:-1], return_counts=True) for d in docs]
        self.terms = [f[0] for f in found]
        sizes = np.array([len(t) for t in self.terms])
        terms, tf = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.float64)
        doc = np.repeat(np.arange(len(docs)), sizes)
        length = np.array([len(d) - 1 for d in docs], np.float64)[doc]
        weight = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        order = np.argsort(terms, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(idf)))])
        self.n = len(docs)

    def keep(self, wanted: np.ndarray) -> None:
        """Leave only the postings of the wanted documents; their scores stay as they are."""
        kept = wanted[self.doc]
        self.starts = np.concatenate([[0], np.cumsum(kept)])[self.starts]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def scores(self, query: int) -> np.ndarray:
        """BM25 of every document of the shard for the ids of one of them."""
        first, n = self.starts[self.terms[query]], self.starts[self.terms[query].astype(np.int64) + 1] - self.starts[self.terms[query]]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def powers(n: int) -> list[int]:
    """The powers of two that make up ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_shard(docs: list[np.ndarray], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id once."""
    sequences = [[(d, at, window)] for d, ids in enumerate(docs) for at in range(0, len(ids) - window + 1, window)]
    start = np.array([len(d) // window * window for d in docs])
    left = np.array([len(d) for d in docs]) - start
    unused = left > 0
    seeds = iter(np.argsort(-left, kind="stable").tolist())
    rest = None  # of the document that was cut last: (document, start, length)
    indexed = len(docs)
    while True:
        if rest is None:
            seed = next((d for d in seeds if unused[d]), None)
            if seed is None:
                return sequences
            rest = (seed, int(start[seed]), int(left[seed]))
            unused[seed] = False
        pieces, rest, room = [rest], None, window - rest[2]
        waiting = np.flatnonzero(unused)
        if len(waiting) < 0.7 * indexed:
            index.keep(unused)
            indexed = len(waiting)
        ranked = waiting[np.argsort(-index.scores(pieces[0][0])[waiting], kind="stable")]
        ends = np.cumsum(left[ranked])
        whole = int(np.searchsorted(ends, room, side="right"))
        pieces += [(int(d), int(start[d]), int(left[d])) for d in ranked[:whole]]
        unused[ranked[:whole]] = False
        room -= int(ends[whole - 1]) if whole else 0
        if room and whole < len(ranked):
            d = int(ranked[whole])
            unused[d] = False
            pieces.append((d, int(start[d]), room))
            rest, room = (d, int(start[d]) + room, int(left[d]) - room), 0
        if not room:
            sequences.append(pieces)
            continue
        for size in powers(window - room):  # the shard is used up
            sequences.append([])
            while size:
                d, at, n = pieces.pop(0)
                sequences[-1].append((d, at, min(n, size)))
                if n > size:
                    pieces.insert(0, (d, at + size, n - size))
                size -= min(n, size)
        return sequences


# ------------------------------------------------------------------ all shards
PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
         ("sequence_id", T.LongType()), ("offset", T.LongType())]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END,
         window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens (with
    the end id), sequence_id, offset."""
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        model = f.read()
    enc = Encoder(model, end)
    size, dtype = enc.size, enc.dtype
    rows = stage(tokenised(docs, key, text, model, end), "packing-tokens")
    df = document_counts(rows, size)
    rows = rows.filter("n IS NOT NULL").drop("df")
    n_docs, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    stats = spark.sparkContext.broadcast((idf, max(1.0, (tokens - n_docs) / max(1, n_docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        fields = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number
            keys = pa.concat_arrays([h[0] for h in held])
            ids = [h[1] for h in held]
            held.clear()
            out, at = [], []
            for sequence in pack_shard(ids, Index(ids, *stats.value), window):
                offset = 0
                for d, start, n in sequence:
                    at.append(d)
                    out.append((start, n, ids[d][start : start + n].astype("<u4").tobytes(), len(ids[d]), number, offset))
                    offset += n
                number += 1
                if len(out) >= 512:
                    yield batch_of(keys, at, out)
                    out, at = [], []
            if out:
                yield batch_of(keys, at, out)

        def batch_of(keys: pa.Array, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out), fields)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *cols], names=["key", *fields.names])

        waiting = 0
        for batch in batches:
            for i, packed in enumerate(batch.column(1)):
                ids = np.frombuffer(packed.as_py(), dtype)
                held.append((batch.column(0).slice(i, 1), ids))
                waiting += len(ids)
                if waiting >= shard_tokens:
                    yield from shard()
                    waiting = 0
        if held:
            yield from shard()

    shards = -(-tokens // shard_tokens)
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, shards), -(-shards // SHARDS_PER_TASK))
    order = ["near", "copy", "key", "tie"]
    keyed = rows.select("key", "ids", "near", F.xxhash64("ids").alias("copy"), F.monotonically_increasing_id().alias("tie"))
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = T.StructType([rows.schema["key"], *[T.StructField(c, t) for c, t in PIECE]])
    return dealt.select("key", "ids").mapInArrow(run, schema).withColumnRenamed("key", key)


def packed_windows(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    out = pack(docs.select("doc_id", "text"), **kw)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
