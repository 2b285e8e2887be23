"""Operator 13, cross-tokenizer alignment by inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B).  Byte offsets where tokens of both
end cut the tokens into groups; a link is a pair of A and B tokens whose byte ranges overlap.  How often two ids are
linked in the whole corpus scores the links of a document.

Neither tokenizer joins text across a single space between two other characters, so texts are cut there and each
distinct unit is encoded and aligned once per task (with a bounded memory); a vocabulary that breaks this rule makes
every text one unit.

Postings: documents are numbered within chunks.  A chunk holds, per id pair, the bitmap of its documents (a sorted list
of numbers when sparse, bits when dense) and planes for the binary digits of the further links of each document.
Bitmaps of a chunk's slices are OR-merged; popcounts of the bitmap give the pair's documents, and those of the planes,
weighted by powers of two, its links.  Chunks hold different documents, so their counts add up: one row per chunk and
pair goes through the shuffle, whatever the number of documents.  Totals come back to the chunk, whose postings return
them to their documents.

Cases: null and empty texts, and texts whose joined A or B bytes differ from space + text, have no tokens: zeros and an
empty string; special tokens' strings are plain text; repeated rows count each; an empty table gives no rows; a null
doc_id stays null; other columns are ignored.  Memory follows CHUNK_ENTRIES and the longest single text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import Scratch, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: A chunk is closed at this many documents or entries (pair, document).
CHUNK_DOCS, CHUNK_ENTRIES = 8192, 1 << 21
#: Bytes of text handled at a time, units that a task remembers, and units encoded together.
SLICE_BYTES, UNITS, BLOCK = 2 << 20, 400_000, 1024
#: What stands between ids: in a side of a group, between its sides, between groups, after the last one.
SEPARATORS = (",", "|", ";", "")

_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_symbols() -> dict[str, int]:
    """The byte for each symbol of a byte-level vocabulary: printable Latin-1 stands for itself, the rest is moved up."""
    same = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbols = _byte_symbols()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(symbols.get(c, 0) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.splits = all("▁" not in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.size = max(len(self.a_bytes), len(self.b_bytes))
        #: Ids as text with what may follow them: at SEPARATORS[k] * size + id.
        self.written = [str(i) + sep for sep in SEPARATORS for i in range(self.size)]

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.splits else [text]

    def encode(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens of space + unit by A and by B, and the unit of each; none where their bytes differ from it.

        Units that begin and end with a character are encoded many at a time, with spaces between them.
        """
        size = np.array([len(u.encode()) + 1 for u in units], np.int64)
        plain = [i for i, u in enumerate(units) if self.splits and not u[0].isspace() and not u[-1].isspace()]
        todo = [plain[i:i + BLOCK] for i in range(0, len(plain), BLOCK)]
        todo += [[i] for i in sorted(set(range(len(units))).difference(plain))]
        out = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in "ab"]
        while todo:
            texts, failed = [" ".join([units[i] for i in block]) for block in todo], []
            a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            for block, text, *ids in zip(todo, texts, a, self.b.encode(texts, num_threads=1)):
                raw = b" " + text.encode()
                if all(b"".join([t[i] for i in x]) == raw for t, x in zip((self.a_bytes, self.b_bytes), ids)):
                    owner, upto = np.array(block), np.cumsum(size[block])
                    for side, x, length in zip(out, ids, (self.a_len, self.b_len)):
                        x = np.array(x, np.int64)
                        side.append((x, owner[np.searchsorted(upto, np.cumsum(length[x]))]))
                elif len(block) > 1:
                    failed += [[i] for i in block]
            todo = failed
        return [tuple(map(np.concatenate, zip(*side))) for side in out]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


class Units:
    """The units of a task: their groups as text, their counts, and their linked id pairs with multiplicities."""

    def __init__(self, voc: Vocabularies):
        self.voc = voc
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((4, 0), np.int64)  # A tokens, B tokens, groups, links
        self.at = np.zeros(1, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str, new: list[str]) -> list[int]:
        """Numbers of a text's units; unknown ones get the next numbers and join ``new``."""
        out, known = [], self.known
        for u in self.voc.units(text):
            code = known.get(u)
            if code is None:
                code = known[u] = len(known)
                new.append(u)
            out.append(code)
        return out

    def add(self, units: list[str]) -> None:
        if not units:
            return
        n, (a_len, b_len) = len(units), (self.voc.a_len, self.voc.b_len)
        (a, a_unit), (b, b_unit) = self.voc.encode(units)
        # units one after the other on one axis of bytes: both encodings of a unit end together
        a_end, b_end = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        low = np.searchsorted(b_end, a_end - a_len[a], "right")
        linked = np.searchsorted(b_end - b_len[b], a_end, "left") - low
        i = np.repeat(np.arange(len(a)), linked)
        j = np.arange(len(i)) - np.repeat(np.cumsum(linked) - linked, linked) + low[i]
        pairs = len(a_len) * len(b_len)
        key, times = np.unique(a_unit[i] * pairs + a[i] * len(b_len) + b[j], return_counts=True)
        unit, pair = np.divmod(key, pairs)
        group_unit = a_unit[np.searchsorted(a_end, ends)]
        counts = np.stack([np.bincount(x, minlength=n) for x in (a_unit, b_unit, group_unit, a_unit[i])])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(np.bincount(unit, minlength=n))]
        self.pair, self.times = np.r_[self.pair, pair], np.r_[self.times, times]
        # the groups of each unit as text: A tokens, then B tokens, group by group
        side = np.r_[2 * a_group, 2 * b_group + 1]
        order = np.argsort(side, kind="stable")
        side, unit = side[order], np.r_[a_unit, b_unit][order]
        last = np.ones(len(side), dtype=bool)
        last[:-1] = unit[1:] != unit[:-1]
        after = np.where(side & 1, 2, 1)
        after[:-1][side[1:] == side[:-1]] = 0
        after[last] = 3
        written = [self.voc.written[k] for k in (after * self.voc.size + np.r_[a, b][order]).tolist()]
        text, at = [""] * n, 0
        for u, end in zip(unit[last].tolist(), (np.flatnonzero(last) + 1).tolist()):
            text[u] = "".join(written[at:end])
            at = end
        self.text += text


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value[order], first) if len(first) else value


class Chunk:
    """Documents numbered from 0, and their entries (pair, number, links)."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = 0

    def add(self, units: Units, texts: list[str | None], ids: list, groups: bool) -> None:
        new: list[str] = []
        found = [units.codes(t, new) if t else [] for t in texts]
        units.add(new)
        codes, docs = [], []
        for doc_id, mine in zip(ids, found):
            n = units.counts[:, mine].sum(axis=1)
            if mine and not units.counts[0, mine].all():
                mine, n = [], n * 0
            joined = ";".join([units.text[u] for u in mine])
            docs.append((doc_id, *n.tolist(), hashlib.sha256(joined.encode()).hexdigest() if mine else "",
                         joined if groups else None))
            codes.append(mine)
        number = np.repeat(np.arange(len(codes)) + len(self.docs), [len(c) for c in codes])
        code = np.array([u for c in codes for u in c], np.int64)
        key, times = np.unique(code * CHUNK_DOCS + number, return_counts=True)
        code, number = np.divmod(key, CHUNK_DOCS)
        n = units.at[code + 1] - units.at[code]
        row = np.repeat(units.at[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.parts.append(_summed(units.pair[row] * CHUNK_DOCS + np.repeat(number, n),
                                  np.repeat(times, n) * units.times[row]))
        self.entries += len(self.parts[-1][0])
        self.docs += docs


def _containers(pair: np.ndarray, number: np.ndarray, n_docs: int) -> tuple[bytes, bytes, bytes, bytes]:
    """Bitmaps of entries sorted by pair and number: pairs, their sizes, lists (sparse) and bits (dense)."""
    if not len(pair):
        return b"", b"", b"", b""
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    size = np.diff(np.r_[first, len(pair)])
    width = -(-n_docs // 8)
    dense = 2 * size > width
    in_dense = np.repeat(dense, size)
    bits = np.zeros((np.count_nonzero(dense), width * 8), np.uint8)
    bits[np.repeat(np.cumsum(dense) - 1, size)[in_dense], number[in_dense]] = 1
    return (pair[first].tobytes(), size.astype(np.uint32).tobytes(), number[~in_dense].astype(np.uint16).tobytes(),
            np.packbits(bits, axis=1).tobytes())


class Bitmaps:
    """The bitmaps that ``_containers`` wrote."""

    def __init__(self, cells: tuple[bytes, bytes, bytes, bytes], n_docs: int):
        self.pair, self.size = np.frombuffer(cells[0], np.int64), np.frombuffer(cells[1], np.uint32).astype(np.int64)
        self.lists, self.width = np.frombuffer(cells[2], np.uint16), -(-n_docs // 8)
        self.dense = 2 * self.size > self.width
        self.bits = np.frombuffer(cells[3], np.uint8).reshape(np.count_nonzero(self.dense), max(1, self.width))

    def popcount(self) -> np.ndarray:
        """Documents of each pair: the length of a list, the popcount of bits."""
        out = self.size.copy()
        out[self.dense] = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of pairs, and document numbers."""
        sparse = np.flatnonzero(~self.dense)
        row, number = np.nonzero(np.unpackbits(self.bits, axis=1))
        return (np.r_[np.repeat(sparse, self.size[sparse]), np.flatnonzero(self.dense)[row]],
                np.r_[self.lists.astype(np.int64), number])


_PARTS = ("pairs", "sizes", "lists", "bits")
_DOCS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
         "groups_sha256": pa.string(), "groups": pa.string()}
_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, groups array<string>, " + ", ".join(f"{p} array<binary>" for p in _PARTS))


def _written(number: int, chunk: Chunk) -> pa.RecordBatch:
    """The row of a chunk; bitmaps first, then the planes of the further links, least digit first."""
    keys, links = _summed(*(np.concatenate(x) for x in zip(*chunk.parts)))  # OR-merge: slices hold different documents
    pair, doc = np.divmod(keys, CHUNK_DOCS)
    planes, more = [_containers(pair, doc, len(chunk.docs))], links - 1
    while more.any():
        on = (more & 1).astype(bool)
        planes.append(_containers(pair[on], doc[on], len(chunk.docs)))
        more = more >> 1
    cols = {"chunk": pa.array([number], pa.int64())}
    cols |= {c: pa.array([list(v)], pa.list_(t)) for (c, t), v in zip(_DOCS.items(), zip(*chunk.docs))}
    cols |= {c: pa.array([list(v)], pa.list_(pa.binary())) for c, v in zip(_PARTS, zip(*planes))}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _index(a_path: str, b_path: str, groups: bool) -> Callable:
    """Chunk rows of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(a_path, b_path)
        units, chunk, number = Units(voc), Chunk(), TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1, SLICE_BYTES):
            for start in range(0, batch.num_rows, CHUNK_DOCS):
                rows = batch.slice(start, CHUNK_DOCS)
                if chunk.docs and (len(chunk.docs) + rows.num_rows > CHUNK_DOCS or chunk.entries > CHUNK_ENTRIES):
                    yield _written(number, chunk)
                    chunk, number = Chunk(), number + 1
                if len(units.text) > UNITS:
                    units = Units(voc)
                chunk.add(units, rows.column(1).to_pylist(), rows.column(0).to_pylist(), groups)
        if chunk.docs:
            yield _written(number, chunk)
    return run


def _planes(row: pa.RecordBatch | pa.Table, n_docs: int) -> list[Bitmaps]:
    cells = [row.column(c)[0].as_py() for c in _PARTS]
    return [Bitmaps(x, n_docs) for x in zip(*cells)]


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, docs, links) of every pair of a chunk."""
    for rows in batches:
        for i in range(rows.num_rows):
            row = rows.slice(i, 1)
            planes = _planes(row, row.column("n_docs")[0].as_py())
            pair, docs = planes[0].pair, planes[0].popcount()
            links = docs.copy()
            for k, plane in enumerate(planes[1:]):
                links[np.searchsorted(pair, plane.pair)] += plane.popcount() << k
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pair), row.column("chunk")[0].as_py(), np.int64)), pa.array(pair), pa.array(docs),
                 pa.array(links)], ["chunk", "pair", "docs", "links"])


def _returned(chunk: pa.Table, scores: pa.Table) -> pa.Table:
    """The documents of a chunk, with the scores that its postings return."""
    n = len(chunk.column("doc_id")[0])
    pair = scores.column("pair").to_numpy()
    order = np.argsort(pair)
    pair = pair[order]
    total = np.zeros((2, n), np.int64)
    for k, plane in enumerate(_planes(chunk, n)):
        weight = 1 << max(0, k - 1)  # bitmaps, then digits 1, 2, 4, ... of the further links
        at, number = plane.entries()
        score = order[np.searchsorted(pair, plane.pair)]
        for row, column in enumerate(("count", "best")):
            np.add.at(total[row], number, weight * scores.column(column).to_numpy()[score][at])
    cols = {c: chunk.column(c)[0].values for c in _DOCS}
    return pa.table(cols | {"n_best": pa.array(total[1]), "count_sum": pa.array(total[0])})


def _scored(index: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (chunk, pair, docs, links), and for each pair its documents, its count and whether it is its B id's best."""
    scratch = Scratch(index.sparkSession)
    rows = (index.select("chunk", F.size("doc_id").cast("long").alias("n_docs"), *_PARTS)
            .mapInArrow(_popcounts, "chunk long, pair long, docs long, links long"))
    pairs = scratch.save(rows.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("count"))
                         .withColumn("b_id", F.col("pair") % size))
    most = pairs.groupBy("b_id").agg(F.max("count").alias("most"))
    return rows, pairs.join(most, "b_id").withColumn("best", (F.col("count") == F.col("most")).cast("long"))


def _indexed(docs: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    return Scratch(docs.sparkSession).save(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _index(a_path, b_path, groups), _CHUNK))


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    With ``groups`` also the groups themselves, as ``a1,a2|b1;a3|b2,b3``.
    """
    index = _indexed(docs, a_path, b_path, groups)
    rows, scores = _scored(index, len(vocabularies(a_path, b_path).b_bytes))
    back = rows.select("chunk", "pair").join(scores.select("pair", "count", "best"), "pair")
    out = (index.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        _returned, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
                   "n_best long, count_sum long"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                      *(["groups"] if groups else []))


def id_pairs(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """a_id, b_id, n_docs, n_links and best (for its B id) of every id pair that is linked somewhere in ``docs``."""
    size = len(vocabularies(a_path, b_path).b_bytes)
    _, scores = _scored(_indexed(docs, a_path, b_path, False), size)
    return scores.select(F.floor(F.col("pair") / size).alias("a_id"), "b_id", F.col("docs").alias("n_docs"),
                         F.col("count").alias("n_links"), (F.col("best") == 1).alias("best"))
