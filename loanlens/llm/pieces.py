"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

No piece of the model has a word mark behind another character, so texts fall into
units (marks, then a word) that encode on their own; line breaks, which no piece
holds, are units too. The distinct units of a batch that the worker has not met
are joined into one text and encoded together: the text's suffixes are sorted up to
the longest piece's length, a binary search finds every piece's range of occurrences,
the occurrences are edges, sorted by position, and relaxed from left to right.

The model merges the best pair first (byte-pair encoding), so relaxing does not
add scores: of the pieces that end at a position one can follow the encoding of the text
before it, namely the one that merging would not join across the border with the
piece before. Two pieces stay apart if at no time of their own merges the symbols
on both sides of the border form a piece that is merged earlier. Characters without a
piece become bytes. The result is what the SentencePiece library returns, and tests
hold it against that.

Defined results: null texts count as empty; empty texts have no pieces; repeated rows are
encoded each. Decoding turns word marks into blanks and drops the first, so texts that
hold the word mark character itself come back with a blank in its place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read_table, text_of

MARK = "▁"
CACHE, CHARS, SLICE = 200_000, 100_000, 400
#: Pairs of pieces whose border was judged: slots of a direct-mapped table.
SLOTS = 1 << 21
NEVER = np.int64(1) << 40
_UNIT = re.compile(r" *[^ \n]+| +|\n")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "<u4")
        self.surface = [b"" if special[i] else self.names[i].encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.surface[i] = bytes([b])
        own = {p: i for i, p in enumerate(self.names) if not special[i]}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in own):
            raise ValueError("pieces across word marks or line breaks are not supported")
        rank = {p: k for k, p in enumerate(sorted((p for p in own if len(p) > 1), key=lambda p: -sp.get_score(own[p])))}
        self.size, self.unknown, self.start = n, n, n + 1
        self._trees(own, rank)
        self._index(own)
        self.units: dict[str, bytes] = {}
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_value = np.zeros(SLOTS, bool)

    def _trees(self, own, rank):
        """Merge trees of the pieces that merging can reach, and the symbols along their borders."""
        best = len(rank)
        self.reached = np.zeros(self.size, bool)
        left, right = {}, {}
        for p, i in own.items():
            symbols, trees = list(p), list(p)
            while len(symbols) > 1:
                k = min(range(len(symbols) - 1), key=lambda j: rank.get(symbols[j] + symbols[j + 1], best))
                joined = symbols[k] + symbols[k + 1]
                if joined not in rank:
                    break
                trees[k:k + 2] = [(trees[k], trees[k + 1])]
                symbols[k:k + 2] = [joined]
            if len(symbols) == 1:
                self.reached[i] = True
                left[p], right[p] = self._border(trees[0], 0), self._border(trees[0], 1)
        deep = max([1, *map(len, left.values()), *map(len, right.values())])
        # symbols at the border from the character up, with the rank at which each came to be
        self.left = np.full((self.size + 2, deep), -1, np.int64)
        self.right = np.full((self.size + 2, deep), -1, np.int64)
        self.left_rank = np.full((self.size + 2, deep + 1), NEVER)
        self.right_rank = np.full((self.size + 2, deep + 1), NEVER)
        char = {c: self.size + 2 + k for k, c in enumerate(sorted({c for p in own for c in p} - own.keys()))}
        self.symbol = own | char

        for spines, ids, ranks in ((left, self.left, self.left_rank), (right, self.right, self.right_rank)):
            for p, spine in spines.items():
                i = own[p]
                ids[i, :len(spine)] = [self.symbol[s] for s in spine]
                ranks[i, :len(spine)] = [rank.get(s, -1) for s in spine]
        pairs = {}
        for p, k in rank.items():
            for c in range(1, len(p)):
                a, b = self.symbol.get(p[:c]), self.symbol.get(p[c:])
                if a is not None and b is not None:
                    pairs[a * (1 << 24) + b] = k
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)

    @staticmethod
    def _border(tree, side):
        """Symbols of one border, the character first."""
        out = []
        while True:
            out.append(_flat(tree))
            if isinstance(tree, str):
                return out[::-1]
            tree = tree[side]

    def _index(self, own):
        pieces = [p for p, i in own.items() if self.reached[i]]
        self.longest = max(map(len, pieces))
        chars = sorted({c for p in pieces for c in p})
        # 1: between units, 2: any character of no piece
        self.code = np.full(0x110000, 2, ">u2")
        self.code[[ord(c) for c in chars]] = np.arange(3, 3 + len(chars))
        width = 2 * self.longest
        raw = [self.code[[ord(c) for c in p]].tobytes() for p in pieces]
        self.low = np.array(raw, f"S{width}")
        self.high = np.array([r + b"\xff" * (width - len(r)) for r in raw], f"S{width}")
        self.piece = np.array([own[p] for p in pieces], np.int64)
        self.length = np.ones(self.size + 2, np.int64)
        self.length[self.piece] = [len(p) for p in pieces]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merging the text of pieces a, b ends in a, b."""
        out = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        last = self.left.shape[1] - 1
        while len(live):
            x, y, u, v = a[live], b[live], i[live], j[live]
            x_end, y_end = self.right_rank[x, u + 1], self.left_rank[y, v + 1]
            key = self.right[x, u] * (1 << 24) + self.left[y, v]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            joint = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            # equal ranks: the merge further left comes first
            cut = (joint < x_end) & (joint <= y_end)
            out[live[cut]] = False
            first = x_end <= y_end
            done = cut | ((x_end == NEVER) & (y_end == NEVER))
            i[live] = np.minimum(u + first, last)
            j[live] = np.minimum(v + ~first, last)
            live = live[~done]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` with what is known of pairs; text starts and characters without piece never merge."""
        out = (a >= self.unknown) | (b >= self.unknown)
        ask = np.flatnonzero(~out)
        key = a[ask] * (1 << 24) + b[ask]
        slot = ((key * 0x9E3779B1) >> 7) & (SLOTS - 1)
        known = self.slot_key[slot] == key
        out[ask[known]] = self.slot_value[slot[known]]
        new, back = np.unique(key[~known], return_inverse=True)
        if len(new):
            value = self.apart(new >> 24, new & 0xFFFFFF)
            out[ask[~known]] = value[back]
            s = ((new * 0x9E3779B1) >> 7) & (SLOTS - 1)
            self.slot_key[s] = new
            held = self.slot_key[s] == new      # of pairs that share a slot, one is held
            self.slot_value[s[held]] = value[held]
        return out

    def learn(self, units: list[str]) -> None:
        """Encode distinct units together and remember their ids."""
        text = "".join([u.replace(" ", MARK) + "\0" for u in units])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(u) for u in units], np.int64)
        stops = np.cumsum(sizes + 1) - 1                # place of each unit's separator
        starts = stops - sizes
        code = self.code[points]
        code[stops] = 1
        n = len(code)
        padded = np.concatenate([code, np.ones(self.longest - 1, ">u2")]).astype(">u2")
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)).view(
            f"S{2 * self.longest}").ravel()
        order = np.argsort(keys, kind="stable")
        suffixes = keys[order]
        lo = np.searchsorted(suffixes, self.low, "left")
        count = np.searchsorted(suffixes, self.high, "right") - lo
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count - lo, count)]
        piece = self.piece[which]
        single = np.zeros(n, bool)                      # characters that are pieces
        single[at[self.length[piece] == 1]] = True
        single[stops] = True
        rest = np.flatnonzero(~single)
        at, piece = np.concatenate([at, rest]), np.concatenate([piece, np.full(len(rest), self.unknown)])
        unit_start = np.repeat(starts, sizes + 1)
        end = at + self.length[piece]
        level = end - unit_start[at]
        by = np.argsort(level, kind="stable")
        at, piece, end, level = at[by], piece[by], end[by], level[by]
        last = np.full(n + 1, -1, np.int64)             # the piece that ends at a place
        last[starts] = self.start
        borders = np.flatnonzero(np.diff(level, prepend=0, append=level[-1] + 1 if len(level) else 1))
        for s, e in zip(borders[:-1], borders[1:]):
            before = last[at[s:e]]
            ok = (before >= 0)
            ok[ok] = self.follows(before[ok], piece[s:e][ok])
            last[end[s:e][ok]] = piece[s:e][ok]
        # walk back from every unit's end
        place, steps = stops.copy(), []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            p = last[place[live]]
            steps.append((live, p, place[live] - self.length[p]))
            place[live] -= self.length[p]
            live = live[place[live] > starts[live]]
        if steps:
            unit = np.concatenate([s[0] for s in steps])
            p, pos = np.concatenate([s[1] for s in steps]), np.concatenate([s[2] for s in steps])
            o = np.lexsort((pos, unit))
            unit, p, pos = unit[o], p[o], pos[o]
            cut = np.searchsorted(unit, np.arange(len(units) + 1))
            raw, odd = p.astype("<u4").tobytes(), np.zeros(len(units), bool)
            odd[unit[p == self.unknown]] = True
            for k, u in enumerate(units):
                if odd[k]:
                    parts = []
                    for x, y in zip(p[cut[k]:cut[k + 1]].tolist(), pos[cut[k]:cut[k + 1]].tolist()):
                        parts.append(self.byte_ids[list(chr(points[y]).encode("utf-8", "replace"))].tobytes()
                                     if x == self.unknown else int(x).to_bytes(4, "little"))
                    self.units[u] = b"".join(parts)
                else:
                    self.units[u] = raw[4 * cut[k]:4 * cut[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        if len(self.units) > CACHE:
            self.units.clear()
        split = [_UNIT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new: set[str] = set()
        for units in split:
            new.update(units)
        todo, size = [], 0
        for u in new - self.units.keys():
            todo.append(u)
            size += len(u) + 1
            if size > CHARS:
                self.learn(todo)
                todo, size = [], 0
        if todo:
            self.learn(todo)
        get = self.units.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


def _flat(tree) -> str:
    return tree if isinstance(tree, str) else _flat(tree[0]) + _flat(tree[1])


_LOADED: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column of little-endian uint32 ids of ``text`` (null: none)."""
    [ids] = fresh(docs, ids)
    at = docs.columns.index("text")

    def run(batches):
        model = piece_model(path)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                found = model.encode([t or "" for t in part.column(at).to_pylist()])
                yield pa.record_batch([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with a column of the text that its ids spell."""
    [text], at = fresh(coded, text), coded.columns.index(ids)

    def run(batches):
        model = piece_model(path)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                found = [model.decode(i or b"") for i in part.column(at).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(found, pa.string())], [*part.schema.names, text])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(text, T.StringType())]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    coded = decode(encode(docs, model_path()), model_path())
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.replace(F.col("text"), F.lit(MARK), F.lit(" "))).alias("round_trip"))
