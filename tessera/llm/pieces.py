"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

The pieces and their log scores come from a public model file (its path is a parameter). The
driver reads it, packs the pieces' UTF-8 bytes into a double-array trie and broadcasts the arrays:
their size is that of the vocabulary and does not depend on the corpus.

Encoding: a leading marker is added, blanks become the marker U+2581, and the best segmentation
is found by Viterbi. A character that no piece starts with alone scores below every piece and
becomes its UTF-8 bytes' pieces. No piece continues past a character before a marker, nor
across a line feed, nor from a letter into closing punctuation (``_closers`` asks the vocabulary); so a text is cut there without changing the optimum, and equal parts are encoded
once per worker (a cache of bounded size).

Decoding joins the pieces' bytes, turns markers into blanks and drops the leading one. A marker
character that the text itself holds is encoded as bytes, so decoding returns every text exactly.

Defined cases: null text has null ids and decodes to null; the empty text has no ids; texts of any
length are encoded whole; ties take the longer first piece; repeated rows are encoded alike.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, quote

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes that a worker's cached words and parts may take, and those of an entry besides its text and ids.
CACHE_BYTES, ENTRY = 80 << 20, 230
#: Bytes of the parts that are encoded together and kept in the cache.
LONG = 72
#: Texts, and about how many of their bytes, that are encoded together.
ROWS, ROW_BYTES = 1024, 2 << 20
#: Parts whose steps run over one set of arrays.
MANY = 32_768
CANDIDATE_CLOSERS = ",.;:!?*%$#&|)\"'"


def zipf_scores(scores: list[float]) -> list[float]:
    """Log scores of pieces whose file ranks them: log p = -log(rank + 1) - log(sum of 1/(rank + 1)).

    The file of a merge model holds minus the merge rank, which is no log probability; frequency
    falls about as the inverse of the rank. Ranks far beyond the vocabulary mark pieces not to be
    used and stay far below all others.
    """
    total = math.log(sum(1 / (1 - s) for s in scores))
    return [-math.log(1 - s) - total if s > -10 * len(scores) else -1e6 for s in scores]


def read_pieces(path: str = MODEL) -> dict:
    """Pieces, log scores, byte ids and normal pieces of a model file.

    Scores that are all whole numbers are ranks (a merge model) and become log scores by
    ``zipf_scores``; those of a unigram model are taken as they are.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    scores = [sp.get_score(i) for i in range(n)]
    if all(s == int(s) for s, ok in zip(scores, normal) if ok):
        scores = zipf_scores(scores)
    return {"pieces": pieces, "scores": scores, "normal": normal, "byte_ids": byte_ids}


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: child ``c`` of node ``s`` is ``base[s] + c`` if its check is ``s``."""
    tree: list[dict] = [{}]
    ends = [-1]
    for key, value in zip(keys, values):
        at = 0
        for c in key:
            nxt = tree[at].get(c)
            if nxt is None:
                nxt = tree[at][c] = len(tree)
                tree.append({})
                ends.append(-1)
            at = nxt
        ends[at] = value
    size = 2 * len(tree) + 512
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    value[0] = ends[0]
    floor: dict[int, int] = {}  # where the search for so many children last ended
    queue = [(0, 0)]
    for node, slot in queue:
        codes = sorted(tree[node])
        if not codes:
            continue
        start = floor.get(len(codes), 1)
        while any(check[start + c] >= 0 for c in codes):
            start += 1
            if start + 512 >= len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
        floor[len(codes)] = start
        base[slot] = start
        for c in codes:
            check[start + c] = slot
            value[start + c] = ends[tree[node][c]]
            queue.append((tree[node][c], start + c))
    last = max(i for i, c in enumerate(check) if c >= 0) + 257
    return tuple(np.array((x + [-1 if x is not base else 0] * 512)[:last], np.int32) for x in (base, check, value))


def _closers(pieces: list[str]) -> str:
    """Punctuation that no piece has right behind a letter."""
    inside = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
    return "".join(sorted(set(CANDIDATE_CLOSERS) - inside))


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: dict, trie: tuple | None = None):
        self.pieces, self.scores = vocabulary["pieces"], vocabulary["scores"]
        known = [i for i, ok in enumerate(vocabulary["normal"]) if ok and self.pieces[i]]
        self.trie = trie or double_array([self.pieces[i].encode() for i in known], known)
        self.base, self.check, self.value = (array("i", a.tobytes()) for a in self.trie)
        self.score_array = np.array(self.scores)
        self.unknown = min(self.scores[i] for i in known) - UNKNOWN_PENALTY
        self.byte_ids = [vocabulary["byte_ids"][b] for b in range(256)]
        raw = {i: bytes([b]) for b, i in vocabulary["byte_ids"].items()}
        ok = set(known)
        self.bytes_of = [raw.get(i, p.replace(MARK, " ").encode() if i in ok else b"") for i, p in enumerate(self.pieces)]
        texts = [self.pieces[i] for i in known]
        stop = "" if any("\n" in p for p in texts) else "\n"
        q = re.escape(_closers(texts))
        behind_letter = r"(?<![^\W\d_])"
        runs = f"(?:[^{MARK}{stop}{q}]+|{behind_letter}[{q}]+)*" if q else f"[^{MARK}{stop}]*"
        self.parts = re.compile((f"{stop}|" if stop else "") + f"{MARK}*" + (f"[{q}]*" if q else "") + runs)
        self.mark_ids = [self.byte_ids[b] for b in MARK.encode()]
        self.cache: dict[str | None, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def viterbi(self, part: str) -> list[int]:
        """Ids of the best segmentation."""
        s = part.encode()
        n = len(s)
        base, check, value, scores = self.base, self.check, self.value, self.scores
        best: list = [None] * (n + 1)
        back = [(0, 0)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            c = s[i]
            char_end = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            single = False
            node = 0
            for j in range(i, n):
                nxt = base[node] + s[j]
                if check[nxt] != node or nxt == 0:
                    break
                node = nxt
                v = value[node]
                if v >= 0:
                    score = here + scores[v]
                    end = j + 1
                    if end == char_end:
                        single = True
                    old = best[end]
                    if old is None or score > old:
                        best[end] = score
                        back[end] = (i, v)
                if base[node] == 0:
                    break
            if not single:
                score = here + self.unknown
                old = best[char_end]
                if old is None or score > old:
                    best[char_end] = score
                    back[char_end] = (i, -1)
        out = []
        at = n
        while at:
            start, v = back[at]
            if v >= 0:
                out.append(v)
            else:
                out += [self.byte_ids[b] for b in reversed(s[start:at])]
            at = start
        out.reverse()
        return out

    def viterbi_many(self, parts: list[str]) -> list[bytes]:
        """``viterbi`` of many short parts, as packed int32: every step of the trie walk runs over all parts at once."""
        out: list = [None] * len(parts)
        raw = [x.encode() for x in parts]
        buckets: dict[int, list[int]] = {}
        for k, x in enumerate(raw):
            buckets.setdefault(len(x) // 6, []).append(k)
        base, check, value = self.trie
        scores = self.score_array
        for members in (b[at : at + MANY] for b in buckets.values() for at in range(0, len(b), MANY)):
            n = np.array([len(raw[k]) for k in members])
            width = int(n.max())
            if width > LONG:
                for k in members:
                    out[k] = np.array(self.viterbi(parts[k]), np.int32).tobytes()
                continue
            s = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in members), np.uint8).reshape(-1, width).astype(np.int64)
            best = np.full((len(members), width + 1), -np.inf)
            best[:, 0] = 0.0
            start = np.zeros((len(members), width + 1), np.int64)
            piece = np.full((len(members), width + 1), -1, np.int64)
            for i in range(width):
                rows = np.flatnonzero((best[:, i] > -np.inf) & (i < n))
                if not len(rows):
                    continue
                lead = s[rows, i]
                char_end = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                single = np.zeros(len(members), bool)
                ends = np.zeros(len(members), np.int64)
                ends[rows] = char_end
                walk, node = rows, np.zeros(len(rows), np.int64)
                for j in range(i, width):
                    nxt = base[node] + s[walk, j]
                    ok = (check[nxt] == node) & (nxt != 0) & (j < n[walk])
                    walk, node = walk[ok], nxt[ok]
                    if not len(walk):
                        break
                    v = value[node]
                    term = v >= 0
                    r, v = walk[term], v[term]
                    single[r[ends[r] == j + 1]] = True
                    score = best[r, i] + scores[v]
                    better = score > best[r, j + 1]
                    r = r[better]
                    best[r, j + 1] = score[better]
                    start[r, j + 1] = i
                    piece[r, j + 1] = v[better]
                r = rows[~single[rows]]
                if len(r):
                    e = ends[r]
                    score = best[r, i] + self.unknown
                    better = score > best[r, e]
                    r, e = r[better], e[better]
                    best[r, e] = score[better]
                    start[r, e] = i
                    piece[r, e] = -1
            at, found, spans = n.copy(), [], []
            every = np.arange(len(members))
            while at.any():
                ids, before = piece[every, at], start[every, at]
                found.append(np.where(at > 0, ids, -2))
                spans.append((before, at))
                at = np.where(at > 0, before, 0)
            path = np.stack(found[::-1], axis=1)  # a row for each part, -2 before its first piece
            known = path >= 0
            flat, ends = path[known].astype(np.int32).tobytes(), 4 * np.cumsum(known.sum(1))
            for k, a, b in zip(members, [0, *ends[:-1].tolist()], ends.tolist()):
                out[k] = flat[a:b]
            for r in np.flatnonzero((path == -1).any(1)).tolist():  # with characters that become bytes
                k, ids = members[r], []
                for v, (before, end) in zip(path[r].tolist(), spans[::-1]):
                    if v >= 0:
                        ids.append(v)
                    elif v == -1:
                        ids += [self.byte_ids[c] for c in raw[k][before[r] : end[r]]]
                out[k] = np.array(ids, np.int32).tobytes()
        return out

    def _cut(self, text: str) -> list:
        """Parts of any text, and None for a marker that the text itself holds."""
        out: list = []
        for k, piece in enumerate((" " + text).split(MARK)):
            out += ([None] if k else []) + self.parts.findall(piece.replace(" ", MARK))
        return out

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text. Texts with single blanks are looked up word by word; new words and all
        other texts are cut into parts, and the parts not seen before are encoded together. Looked-up
        ids are kept and joined as packed int32."""
        words, cache = self.words, self.cache
        if self.held > CACHE_BYTES:
            words.clear()
            cache.clear()
            self.held = 0
        plain = [t.split(" ") if t and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        fresh = {w: self.parts.findall(MARK + w) for w in set().union(*[p for p in plain if p]).difference(words)}
        odd = [self._cut(t) if t and p is None else [] for t, p in zip(texts, plain)]
        need = {x for c in fresh.values() for x in c}
        need.update(*odd)
        need = list(need.difference(cache, ("", None)))
        cache.update(zip(need, self.viterbi_many(need)))
        cache[None], cache[""] = np.array(self.mark_ids, np.int32).tobytes(), b""
        words.update((w, b"".join(map(cache.__getitem__, parts))) for w, parts in fresh.items())
        out = [
            None if t is None else np.frombuffer(b"".join(map(words.__getitem__, p) if p else map(cache.__getitem__, c)), np.int32)
            for t, p, c in zip(texts, plain, odd)
        ]
        for table, keys in ((words, fresh), (cache, need)):
            for x in keys:
                if len(x) > LONG:
                    del table[x]
                else:
                    self.held += ENTRY + len(x) + len(table[x])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_LOADED: dict[str, Unigram] = {}


def _loaded(shared: tuple) -> Unigram:
    """One encoder per worker process and broadcast: its cache outlives a task."""
    token, model = shared
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = Unigram(*model.value)
    return _LOADED[token]


def _broadcast(spark: SparkSession, path: str) -> tuple:
    vocabulary = read_pieces(path)
    return uuid.uuid4().hex, spark.sparkContext.broadcast((vocabulary, Unigram(vocabulary).trie))


def _list_array(lists: list[np.ndarray | None]) -> pa.ListArray:
    arrays = [np.zeros(0, np.int32) if x is None else x for x in lists]
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in lists], pa.bool_()))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of blocks that are encoded together."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)) + 1
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0.0
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, before + ROW_BYTES, side="right"))))
        yield at, to - at
        at = to


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, ids: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of every whole text in column ``ids`` (a column of that name gives way).
    Rows leave a task block by block, so that it holds the ids of one block at a time."""
    model = _broadcast(docs.sparkSession, path)
    kept = [f for f in docs.schema.fields if f.name.lower() != ids.lower()]
    names = [f.name for f in kept]
    rows = docs.select(*[F.col(quote(c)) for c in names], F.col(quote(text)).cast("string").alias(free_name(names, "encoded")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(model)
        for whole in batches:
            for at, n in _blocks(whole.column(len(names))):
                part = whole.slice(at, n)
                lists = encoder.encode_many(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], _list_array(lists)], [*names, ids])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, ids: str = "ids", path: str = MODEL, text: str = "text") -> DataFrame:
    """``tokens`` with the text of the ids in column ``text``."""
    model = _broadcast(tokens.sparkSession, path)

    @F.arrow_udf("string")
    def batch(lists: pa.Array) -> pa.Array:
        decoder = _loaded(model)
        return pa.array([None if x is None else decoder.decode(x) for x in lists.to_pylist()], pa.string())

    return tokens.withColumn(text, batch(F.col(quote(ids))))


def tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, round_trip (decoding gives the text) of every row."""
    spark = docs.sparkSession
    model = _broadcast(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(model)
        is_byte = np.zeros(len(coder.pieces), bool)
        is_byte[coder.byte_ids] = True
        for whole in batches:
            for at, n in _blocks(whole.column(1)):
                rows = whole.slice(at, n)
                texts = rows.column(1).to_pylist()
                lists = coder.encode_many(texts)
                sizes = [0 if x is None else len(x) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), _list_array(lists),
                        pa.array(sizes, pa.int64()),
                        pa.array([0 if x is None else int(is_byte[x].sum()) for x in lists], pa.int64()),
                        pa.array([None if t is None else coder.decode(x.tolist()) == t for t, x in zip(texts, lists)], pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_pieces", "n_byte_pieces", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")


def with_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows of documents with a further column of piece ids (``ids``, or the next free name)."""
    return encode(docs, path=path, ids=free_name(docs.columns, "ids"))
