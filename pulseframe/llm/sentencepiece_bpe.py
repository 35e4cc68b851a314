"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into units, a run of spaces with the word after it; no piece of the vocabulary holds a space
after another character, so no merge crosses a unit's end. The distinct units of a slab are merged together:
their symbols lie in one flat array, each round finds the best pair of every unit (segmented minimum rank),
merges its leftmost occurrences at once, compacts the arrays, and drops units in which no pair is left.
Results equal the sentencepiece library's for models of type BPE with identity normalisation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textnp import column, gather, owner, piece_hash, slabs, tidy

SLAB = 2 << 20
KEEP_UNITS = 150_000
NONE = np.iinfo(np.int32).max
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """A model's tables: symbols of single characters, ranks of pairs, the bytes of each piece."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        if any(ok and any(b == MARK and a != MARK for a, b in zip(p, p[1:])) for p, ok in zip(pieces, plain)):
            raise ValueError("a piece of this model holds a space after another character")
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.n, self.unk = n, sp.unk_id()
        self.char = np.full(0x110000, -1, np.int32)  # -1: no piece, spelt in bytes
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        one = set(map(chr, np.flatnonzero(self.char >= 0)))
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (a in ids or a in one) and (b in ids or b in one):
                    pairs[ids[a] << 32 | ids[b]] = (rank[i], i)
        keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int32)
        self.made = np.array([pairs[k][1] for k in keys.tolist()] + [-1], np.int32)
        bits = max(1, int(np.ceil(np.log2(len(keys) * 8))))
        self.mask = (1 << bits) - 1
        self.slot = np.full(1 << bits, len(keys), np.int32)
        self.keys = np.concatenate([keys, [-1]])
        self.far = 0
        where = self._home(keys)
        for k, w in enumerate(where.tolist()):
            d = 0
            while self.slot[w + d & self.mask] != len(keys):
                d += 1
            self.slot[w + d & self.mask] = k
            self.far = max(self.far, d)
        self.byte = [byte.get(b, self.unk) for b in range(256)]
        self.text = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in byte.items():
            self.text[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.text[i] = b""
        self.text[self.unk] = " ⁇ ".encode()
        self.number = [str(i) for i in range(n)]
        self.seen: dict[int, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.seen, self.ids, self.out, self.count = {}, [], [], []

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of symbols, its place in rank and made; the last place for no pair."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        at = self._home(key)
        none = len(self.keys) - 1
        found = self.slot[at]
        hit = self.keys[found] == key
        res = np.where(hit, found, none)
        todo = np.flatnonzero(~hit & (found != none))
        d = 1
        while len(todo) and d <= self.far:
            f = self.slot[at[todo] + d & self.mask]
            good = self.keys[f] == key[todo]
            res[todo[good]] = f[good]
            todo = todo[~good & (f != none)]
            d += 1
        return res

    def merge(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all units and their units; unit is ascending."""
        done_s, done_u = [], []
        tag = np.arange(len(sym))  # keeps the order of symbols that leave early
        done_t = []
        pair = self._pairs(sym, unit)
        while len(sym):
            r = self.rank[pair]
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(r, first)
            size = np.diff(np.append(first, len(sym)))
            live = best != NONE
            if not live.all():
                out = ~np.repeat(live, size)
                done_s.append(sym[out])
                done_u.append(unit[out])
                done_t.append(tag[out])
                sym, unit, tag, pair, r = (x[~out] for x in (sym, unit, tag, pair, r))
                best, size = best[live], size[live]
                if not len(sym):
                    break
            at = np.flatnonzero(r == np.repeat(best, size))
            # of overlapping occurrences (x x x), every second from the left
            start = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
            begin = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            lead = np.concatenate([[True], unit[at[1:]] != unit[at[:-1]]])
            if not lead.all():
                # a new pair at least as good as this one would come before the next occurrence: only the leftmost then
                m, n = self.made[pair[at]], len(sym)
                left, right = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
                lr = np.where((at > 0) & (unit[left] == unit[at]), self.rank[self.lookup(sym[left], m)], NONE)
                rr = np.where((at + 2 < n) & (unit[right] == unit[at]), self.rank[self.lookup(m, sym[right])], NONE)
                mm = self.rank[self.lookup(m, m)]
                bad = np.minimum(np.minimum(lr, rr), mm) <= r[at]
                which = np.cumsum(lead) - 1
                risky = np.bincount(which, bad) > 0
                at = at[lead | ~risky[which]]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, unit, tag, pair = sym[keep], unit[keep], tag[keep], pair[keep]
            p = moved[at]
            touched = np.zeros(len(sym), bool)
            touched[p] = True
            touched[p[p > 0] - 1] = True
            redo = np.flatnonzero(touched)
            pair[redo] = self._pairs(sym, unit, redo)
        if not done_s:
            return sym, unit
        s, u, t = map(np.concatenate, (done_s, done_u, done_t))
        o = np.argsort(t, kind="stable")
        return s[o], u[o]

    def _pairs(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(sym)) if at is None else at
        nxt = np.minimum(at + 1, len(sym) - 1)
        out = self.lookup(sym[at], sym[nxt])
        out[(unit[nxt] != unit[at]) | (at + 1 >= len(sym))] = len(self.keys) - 1
        return out

    def encode_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        """The ids of all units end to end and where each unit's begin; units are UTF-8 bytes with spaces."""
        flat, first, _ = gather(data, starts, ends)
        cp = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.add.reduceat(((flat & 0xC0) != 0x80).astype(np.int64), first)
        cp[cp == 0x20] = 0x2581
        unit = np.repeat(np.arange(len(starts)), chars)
        sym = self.char[cp]
        odd = sym < 0
        sym = np.where(odd, -1 - cp, sym).astype(np.int64)
        s, u = self.merge(sym, unit)
        bound = np.searchsorted(u, np.arange(len(starts) + 1))
        if odd.any():
            spelt = [[b for b in chr(-1 - x).encode()] if x < 0 else (x,) for x in s.tolist()]
            more = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])
            flat_ids = [self.byte[y] if x < 0 else y for x, ys in zip(s.tolist(), spelt) for y in ys]
            return flat_ids, more[bound].tolist()
        return s.tolist(), bound.tolist()

    def units(self, a: pa.Array):
        """(ids as text, decoded bytes, number of ids) of each known unit, the units of all rows, and where each row's begin."""
        data, off = column(a)
        if len(data) > 2 and (m := (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():
            at = np.flatnonzero(m)  # the library takes this character for a space
            data = data.copy()
            data[at] = 0x20
            gone = np.zeros(len(data), bool)
            gone[at + 1] = gone[at + 2] = True
            off = off - np.concatenate([[0], np.cumsum(gone)])[off]
            data = data[~gone]
        full = np.flatnonzero(np.diff(off) > 0)
        new = np.insert(data, off[full], 0x20)  # the dummy prefix
        off2 = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
        sp = new == 0x20
        head = sp.copy()
        head[1:] &= ~sp[:-1]
        head[off2[full]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(new))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        h = piece_hash(new, starts, ends)
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen) > KEEP_UNITS:
            self._clear()
        get = self.seen.get
        place = np.array([get(x, -1) for x in uniq.tolist()], np.int64)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            got, bound = self.encode_units(new, starts[at[miss]], ends[at[miss]])
            base = len(self.ids)
            num, txt = [self.number[i] for i in got], [self.text[i] for i in got]
            self.ids += [",".join(num[i:j]) for i, j in zip(bound, bound[1:])]
            self.out += [b"".join(txt[i:j]) for i, j in zip(bound, bound[1:])]
            self.count += [j - i for i, j in zip(bound, bound[1:])]
            place[miss] = np.arange(base, base + len(miss))
            self.seen.update(zip(uniq[miss].tolist(), range(base, base + len(miss))))
        rows = np.concatenate([[0], np.cumsum(np.bincount(owner(off2, starts), minlength=len(off) - 1))])
        return place[inv], rows

    def digests(self, a: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Of each row: how many ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        n, ids, dec = [], [], []
        off = column(a)[1]
        for i, j in slabs(off, SLAB):
            place, rows = self.units(a.slice(i, j - i))
            count = np.concatenate([[0], np.cumsum(np.array(self.count, np.int64)[place])]) if len(place) else np.zeros(1, np.int64)
            n.append(count[rows[1:]] - count[rows[:-1]])
            pl = place.tolist()
            t, o = [self.ids[k] for k in pl], [self.out[k] for k in pl]
            r = rows.tolist()
            for x, y in zip(r, r[1:]):
                ids.append(hashlib.sha256(",".join(t[x:y]).encode()).hexdigest())
                dec.append(hashlib.sha256(b"".join(o[x:y])[1:]).hexdigest())
        return np.concatenate(n) if n else np.zeros(0, np.int64), ids, dec

    def encode(self, a: pa.Array) -> list[list[int]]:
        place, rows = self.units(a)
        t, r = [self.ids[k] for k in place.tolist()], rows.tolist()
        return [[int(i) for u in t[x:y] for i in u.split(",") if i] for x, y in zip(r, r[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one leading space is the dummy prefix and goes."""
        b = b"".join([self.text[i] for i in ids])
        return (b[1:] if b[:1] == b" " else b).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def encode(df: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """All columns and `out`, the ids of the whole text as array<int>.

    A null or empty text has no ids. Repeated rows stay; `out` replaces a column of that name.
    """
    model = model or default_model()
    small_batches(df.sparkSession)
    base = df.drop(out)

    @tidy
    def run(batches):
        c = codec(model)
        c._clear()
        for b in batches:
            ids = c.encode(b.column(names.index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, out])
        c._clear()

    names = base.columns
    schema = base.select("*", F.lit(None).cast("array<int>").alias(out)).schema
    return base.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """All columns and `out`, the text of the ids; null ids count as none and give an empty text."""
    model = model or default_model()
    base = df.drop(out)
    names = base.columns

    def run(batches):
        c = codec(model)
        for b in batches:
            got = [c.decode(x or []) for x in b.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return base.mapInArrow(run, base.select("*", F.lit(None).cast("string").alias(out)).schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, its ids decoded, both as digests.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows give repeated results; other columns are not read.
    """
    model = model or default_model()
    small_batches(df.sparkSession)

    @tidy
    def run(batches):
        c = codec(model)
        c._clear()
        for b in batches:
            n, ids, dec = c.digests(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        c._clear()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
