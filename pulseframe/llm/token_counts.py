"""Token counts of a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

The model takes the pieces of a SentencePiece vocabulary with scores by their rank, log p = -log(rank + 2) (Zipf's
law; neither the vocabulary nor its scores are trained, as tokenizers aren't trained here). A text's pre-tokens are its words, each with a leading mark; no piece
holds a mark after another character. The distinct pre-tokens of a slab are put in a trie, level by level; a node's
forward score, the best of any split of its prefix, is computed once however many pre-tokens share it, from its
ancestors' scores, and a pre-token's count is stored at its terminal node. A character that no piece spells costs
one token for each of its UTF-8 bytes at the score UNKNOWN each. Of splits with equal scores the one with fewer
tokens counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_bpe import MARK, default_model
from .shared import small_batches
from .textnp import SPACE, column, gather, mix, owner, piece_hash, runs, slabs, tidy

SLAB = 8 << 20
KEEP_WORDS = 500_000
LONG, PART = 256, 1 << 16  # longer pre-tokens, which share little, are scored one by one, so many characters at a time
UNKNOWN = -14.0
_STEP = np.uint64(0x9FB21C651E98DF25)


class Unigram:
    def __init__(self, pieces: dict[str, float]):
        """pieces: their scores."""
        self.longest = max(map(len, pieces), default=1)
        self.tables = {}
        by: dict[int, list] = {}
        for p, s in pieces.items():
            by.setdefault(len(p), []).append((p, s))
        for n, ps in by.items():
            h = np.zeros(len(ps), np.uint64)
            for i in range(n):
                h = h * _STEP + self._code(np.array([ord(p[i]) for p, _ in ps], np.int64))
            o = np.argsort(h)
            self.tables[n] = (h[o], np.array([s for _, s in ps])[o])
        self.clear()

    def clear(self) -> None:
        self.seen: dict[int, int] = {}
        self.count = np.zeros(1024, np.int32)

    @staticmethod
    def _code(cp: np.ndarray) -> np.ndarray:
        return mix(cp.astype(np.uint64) + np.uint64(0xABCD))

    def words(self, cps: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The token counts of words given as code points end to end."""
        far = lens > LONG
        first = np.cumsum(lens) - lens
        out = np.zeros(len(lens), np.int64)
        for w in np.flatnonzero(far).tolist():
            out[w] = self._long(cps[first[w] : first[w] + lens[w]])
        out[~far] = self._trie(cps[np.repeat(~far, lens)], lens[~far])
        return out

    def _long(self, cps: np.ndarray) -> int:
        """One word's token count: all pieces of PART characters are looked up at once, scores go on from part to part."""
        n = len(cps)
        best, toks = [0.0], [0]  # of the last `longest` places, the newest last
        for a in range(0, n, PART):
            b = min(n, a + PART)
            from_ = max(0, a - self.longest + 1)
            code = self._code(cps[from_:b])
            size = np.where(cps[a:b] < 0x80, 1, np.where(cps[a:b] < 0x800, 2, np.where(cps[a:b] < 0x10000, 3, 4))).tolist()
            ends, widths, scores, h = [], [], [], np.zeros(0, np.uint64)
            for k in range(1, min(self.longest, b - from_) + 1):
                # hashes of the k characters before each end; the first end is at from_ + k
                h = code if k == 1 else h[:-1] * _STEP + code[k - 1 :]
                if k not in self.tables:
                    continue
                keys, s = self.tables[k]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                hit = hit[hit + from_ + k > a]
                ends.append(hit + from_ + k - a)
                widths.append(np.full(len(hit), k))
                scores.append(s[at[hit]])
            end, width, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, widths, scores))
            o = np.lexsort((width, end))
            cuts = np.searchsorted(end[o], np.arange(1, b - a + 2)).tolist()
            width, score = width[o].tolist(), score[o].tolist()
            for i in range(b - a):
                top, cost = -np.inf, 0
                lo, hi = cuts[i], cuts[i + 1]
                if lo == hi or width[lo] > 1:
                    top, cost = best[-1] + UNKNOWN * size[i], toks[-1] + size[i]
                for j in range(lo, hi):
                    new, more = best[-width[j]] + score[j], toks[-width[j]] + 1
                    if new > top + 1e-9 or (abs(new - top) <= 1e-9 and more < cost):
                        top, cost = new, more
                best.append(top)
                toks.append(cost)
            del best[: -self.longest], toks[: -self.longest]
        return toks[-1]

    def _trie(self, cps: np.ndarray, lens: np.ndarray) -> np.ndarray:
        first = np.cumsum(lens) - lens
        node = np.zeros(len(lens), np.int64)  # each word's node at the level before
        alive = np.arange(len(lens))
        total = np.zeros(len(lens), np.int64)
        # level 0 is the root: a node's score, tokens, hash of the path, ancestors (a ring of the last levels)
        score, toks, path = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        parents: list[np.ndarray] = [np.zeros(1, np.int64)]
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, _STEP, np.uint64)]), dtype=np.uint64)
        depth = 0
        while len(alive):
            depth += 1
            c = cps[first[alive] + depth - 1]
            uniq, where = np.unique(node[alive] << 21 | c, return_inverse=True)
            up, ch = uniq >> 21, uniq & 0x1FFFFF
            h = path[-1][up] * _STEP + self._code(ch)
            best, cost = np.full(len(uniq), -np.inf), np.zeros(len(uniq), np.int64)
            anc = up
            for n in range(1, min(depth, self.longest) + 1):
                if n in self.tables:
                    keys, s = self.tables[n]
                    sub = h - path[-n][anc] * power[n]
                    at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                    hit = keys[at] == sub
                    new, more = np.where(hit, score[-n][anc] + s[at], -np.inf), toks[-n][anc] + 1
                else:
                    hit = np.zeros(len(uniq), bool)
                    new, more = np.full(len(uniq), -np.inf), toks[-n][anc] + 1
                if n == 1:
                    size = np.where(ch < 0x80, 1, np.where(ch < 0x800, 2, np.where(ch < 0x10000, 3, 4)))
                    new, more = np.where(hit, new, score[-1][anc] + UNKNOWN * size), np.where(hit, more, toks[-1][anc] + size)
                better = (new > best + 1e-9) | ((np.abs(new - best) <= 1e-9) & (more < cost))
                best, cost = np.where(better, new, best), np.where(better, more, cost)
                if n < min(depth, self.longest):
                    anc = parents[-n][anc]
            score.append(best)
            toks.append(cost)
            path.append(h)
            parents.append(up)
            for ring in (score, toks, path, parents):
                if len(ring) > self.longest:
                    del ring[0]
            node[alive] = where
            done = lens[alive] == depth
            total[alive[done]] = cost[where[done]]
            alive = alive[~done]
        return total

    def counts(self, a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: tokens and pre-tokens."""
        out, pre = [], []
        off = column(a)[1]
        for i, j in slabs(off, SLAB):
            x, y = self._slab(a.slice(i, j - i))
            out.append(x)
            pre.append(y)
        return (np.concatenate(out), np.concatenate(pre)) if out else (np.zeros(0, np.int64),) * 2

    def _slab(self, a: pa.Array):
        data, off = column(a)
        n = len(off) - 1
        s, e = runs(~SPACE[data], off)
        if not len(s):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        h, row = piece_hash(data, s, e), owner(off, s)
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.seen) > KEEP_WORDS:
            self.clear()
        place = np.array([self.seen.get(x, -1) for x in uniq.tolist()], np.int64)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            ms, me = s[at[miss]], e[at[miss]]
            flat, first, _ = gather(data, ms, me)
            cp = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
            chars = np.add.reduceat(((flat & 0xC0) != 0x80).astype(np.int64), first)
            start = np.cumsum(chars) - chars
            cps = np.insert(cp, start, ord(MARK))
            base = len(self.seen)
            if base + len(miss) > len(self.count):
                self.count = np.concatenate([self.count, np.zeros(base + len(miss), np.int32)])
            self.count[base : base + len(miss)] = self.words(cps, chars + 1)
            place[miss] = np.arange(base, base + len(miss))
            self.seen.update(zip(uniq[miss].tolist(), range(base, base + len(miss))))
        tok = np.bincount(row, self.count[place[inv]], minlength=n)
        return tok.astype(np.int64), np.bincount(row, minlength=n).astype(np.int64)


def zipf_pieces(model: str) -> dict[str, float]:
    """The vocabulary's ordinary pieces with scores by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    n.sort(key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -float(np.log(r + 2)) for r, i in enumerate(n)}


@lru_cache(maxsize=2)
def unigram(model: str) -> Unigram:
    return Unigram(zipf_pieces(model))


def count_tokens(df: DataFrame, text: str = "text", model: str | None = None, tokens: str = "n_tokens", pre_tokens: str = "n_pretokens") -> DataFrame:
    """All columns and the numbers of tokens and pre-tokens of each whole text.

    Null and empty texts, and texts of white space, have none. Repeated rows stay; columns named as the outputs are replaced.
    """
    model = model or default_model()
    small_batches(df.sparkSession)
    base = df.drop(tokens, pre_tokens)
    names = base.columns

    @tidy
    def run(batches):
        m = unigram(model)
        m.clear()
        for b in batches:
            n, p = m.counts(b.column(names.index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(p, pa.int64())], [*b.schema.names, tokens, pre_tokens])
        m.clear()

    return base.mapInArrow(run, base.select("*", F.lit(0).cast("long").alias(tokens), F.lit(0).cast("long").alias(pre_tokens)).schema)
