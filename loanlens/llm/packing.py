"""Operator 6: best-fit packing with bound-certified repacking.

Documents are tokenised, end with one end id and are cut only where longer than a
sequence. Full pieces are sequences of their own. The others are dealt into groups
of about ``ITEMS`` pieces and each group is packed best-fit decreasing. Dual
feasible functions bound from below how many sequences the group needs; a group
that meets its bound is certified and gives back only its emptiest sequence, a
group with a gap gives back every sequence that isn't full. What was given back is
exchanged (dealt anew into fewer groups) and packed again, round after round, until
one group is left, all given back is optimal, or a round saves nothing.

Tokens: ids of a word are cached per Python worker, since the tokenizer splits at
white space and never looks across it. The cache is cleared when full, which bounds
memory and changes nothing.

Defined results: null and empty texts are one end id; repeated rows are packed
like any other rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, table, text_of

CAPACITY, END = 4096, 1
ITEMS, ROUNDS = 50_000, 8
CACHE = 300_000
# The tokenizer's own cut of a word, for ASCII.
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
PIECE = "doc_id long, piece int, start long, length int, ids binary"
PLACED = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int, open boolean, gap int"


class WordIds(dict):
    """Word (bytes) -> its ids as little-endian uint32, found when first asked for.

    The tokenizer normalises, lower-cases and cuts a word into letters, digits
    and other signs, each tokenised alone. Words of ASCII signs or of letters are cut
    here and only their parts go to the model; any other word, and any that could hold
    a special token's text, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.part = self.tokenizer.model.tokenize
        # the model reads bytes as printable characters
        seen = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ascii_ = {b: seen.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        high = {}
        for cp in range(0x80, 0x800):
            for byte, char in zip(chr(cp).encode(), seen.pre_tokenize_str(chr(cp))[0][0]):
                high[byte] = char
        self.printable = ascii_ | high
        self.parts: dict[str, bytes] = {}

    def _part(self, text: str) -> bytes:
        """Ids of one run of letters, digit or run of signs, lower case."""
        ids = self.parts.get(text)
        if ids is None:
            raw = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(self.printable)
            ids = self.parts[text] = array("I", [t.id for t in self.part(raw)]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids, text = None, word.decode("utf-8", "replace")
        if b"<|" in word or "\0" in text:
            pass
        elif word.isascii():
            ids = b"".join(map(self._part, ASCII_PARTS.findall(text.lower())))
        else:
            stem, tail = (text[:-1], text[-1]) if text[-1] in ".," else (text, "")
            low = stem.lower()
            # Python lower-cases a final sigma by its place, the tokenizer does not
            if low.isalpha() and stem.isalpha() and "\u03a3" not in stem and is_normalized("NFC", low) \
                    and max(stem) < "\u0800":
                ids = self._part(low) + (self._part(tail) if tail else b"")
        if ids is None:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self) > CACHE:
                self.clear()
            if len(self.parts) > CACHE:
                self.parts.clear()
            out.append(b"".join(map(self.__getitem__, t.split())))
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian uint32) of every piece."""
    end = np.array([END], "<u4").tobytes()
    size = 4 * capacity

    def run(batches):
        tok = word_ids(tokenizer)
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lo in range(0, b.num_rows, 1000):
                row, piece, ids = [], [], []
                for i, raw in enumerate(tok.encode([t or b"" for t in texts.slice(lo, 1000).to_pylist()]), lo):
                    raw += end
                    for k in range(0, len(raw), size):
                        row.append(i)
                        piece.append(k // size)
                        ids.append(raw[k:k + size])
                p = np.array(piece, np.int32)
                yield pa.record_batch([
                    b.column(0).take(pa.array(row, pa.int64())), pa.array(p), pa.array(p.astype(np.int64) * capacity),
                    pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins by the dual feasible functions that, for each e, count items
    above capacity - e as whole bins, items below e as nothing and others as they are."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = np.cumsum(count * np.arange(capacity + 1))       # of items up to a length
    above = count.sum() - np.cumsum(count)                  # items longer than a length
    e = np.arange(0, capacity // 2 + 1)
    big = above[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    return int((big + -(-middle // capacity)).max())


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing of lengths sorted from long to short: bin and offset of
    each item, free room of each bin. A bit mask tells which free rooms occur."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - n
        if r - n:
            free[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def _pack_group(capacity: int, stage: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        if len(room) >= 1 << 24:
            raise OverflowError("more sequences in a group than ids for them")
        gap = len(room) - lower_bound(lengths, capacity)
        back = room > 0
        if gap == 0:
            back = np.zeros(len(room), bool)
            back[room.argmax()] = room.max() > 0
        pdf["sequence_id"] = (np.int64(stage + 1) << 56) + (np.int64(key[0]) << 24) + bins
        pdf["offset"] = offsets.astype(np.int32)
        pdf["open"] = back[bins]
        pdf["gap"] = np.int32(gap)
        return pdf.drop(columns="g")
    return run


def place(items: DataFrame, capacity: int = CAPACITY, group_items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), written once -> with sequence_id and offset."""
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = (items.where(F.col("length") == capacity)
            .withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0)))
    out, todo, held = [full], items.where(F.col("length") < capacity), None
    for stage in range(rounds):
        groups = max(1, -(-todo.count() // group_items))
        # by place in the written rows, not by content: rows that are equal spread too
        g = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(stage)), F.lit(groups))
        packed = table(todo.select(*cols, g.alias("g")).groupBy("g").applyInPandas(_pack_group(capacity, stage), PLACED))
        used, back = packed.agg(F.countDistinct("sequence_id"),
                                F.countDistinct(F.when(F.col("open"), F.col("sequence_id")))).first()
        if held is not None and used >= held[1]:
            break                               # the exchange saved nothing: what was given back stays as it was
        if held is not None:
            held = None
        last = groups == 1 or back <= 1 or stage == rounds - 1
        out.append(packed if last else packed.where(~F.col("open")))
        if last:
            break
        held = (packed.where("open"), back)
        todo = held[0]
    if held is not None:
        out.append(held[0])
    keep = [*cols, "sequence_id", "offset"]
    result = out[0].select(*keep)
    for o in out[1:]:
        result = result.unionByName(o.select(*keep))
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Placement of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, tokenizer, capacity)
    items = table(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return place(items, capacity).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id",
        F.col("offset").cast("long").alias("offset"))


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. found: rows of ``pieces``
    of documents with distinct ids; a sequence gathers at most its capacity of ids."""
    both = found.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate(
        "p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
