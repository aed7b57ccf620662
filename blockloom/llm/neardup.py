"""Near-duplicate texts: an exact join under the Jaccard distance of bags of words.

This is a prefix join, not the join with pivots in a metric space that was asked for: documents as pivots cannot cut
these collections, because nearly all distances between texts of one language are between 0.8 and 1, so that a window
of twice the wanted distance (0.6) holds every document in every region (figures in the README). What it shares with
that plan are regions, replication of documents to every region where a partner may be, recursive cutting of large
regions, and an exact join inside each.

A text is an array of tokens, the hash of a word together with how often it came before in the text, in a common order
(rarest first). Partners of similarity t share a token among the first n - ceil(t n) + 1 in that order, and the shorter
of them has it among its first n - ceil(2t/(1+t) n) + 1. So a region is named by a token, and a document goes to the
regions of its first tokens.

The steps are
1. copies: equal texts become one class, and the text of a class is turned into tokens once;
2. counts of tokens in a table of fixed size, which give the common order;
3. rows (region, document, size, position, parity sketch). A region of a frequent token is cut by a second, third and
   fourth one; what is still large is cut into blocks, and each pair of blocks is a region of its own, so that no region
   is expected to hold more than twice REGION rows;
4. the join of each region: windows of size and position, then the parity sketch, a lower bound of the difference;
5. the exact check of what is left, on the tokens.
No step drops a pair of the wanted similarity.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18  # size of the table of counts, whatever the data
REGION = 20_000  # a region expected to hold more documents is cut again
DEPTH = 4  # most tokens that name a region
ROWS = 200_000  # rows of regions that one task holds
PAIRS = 1 << 20  # pairs looked at closely in one step
SMALL, BLOCK, WIDE = 24, 64, 2048  # rows of a small region; rectangles of a large one
LONG, MOST = 80, 64  # tokens of a document that needs a wider sketch; most words of 64 bits of one
BYTES = 5  # of a token
_U = np.uint64


_BLANKED = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    low = text.lower()
    return low.translate(_BLANKED).split() if low.isascii() else WORD.findall(low)


def similarity(a: Counter, b: Counter) -> float:
    """Common words over all words, both counted as often as they occur; 0 where both are empty."""
    common = sum(min(n, b[w]) for w, n in a.items() if w in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Hashes(dict):
    """48-bit hashes of words; a cache only."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFFFFFF
        return h


def _tokens(texts: list[str | None], least: int, known: _Hashes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Numbers of words of fewer than 2^16 texts, how many tokens each has (none below ``least`` words), the tokens."""
    flat: list[int] = []
    n_words = []
    for t in texts:
        ws = words(t) if t else ()
        n_words.append(len(ws))
        if len(ws) >= least:
            flat.extend(map(known.__getitem__, ws))
    n = np.array(n_words, dtype=np.int64)
    size = np.where(n >= least, n, 0)
    own = np.repeat(np.arange(len(n), dtype=np.uint64), size) << _U(48)
    both = np.sort(own | np.fromiter(flat, np.uint64, len(flat)))  # equal words of a text stand together
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    at = np.arange(len(both))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return n_words, size, _mix((both & _U(0xFFFFFFFFFFFF)) + nth * _U(0x9E3779B97F4A7C15)) >> _U(64 - 8 * BYTES)


def _as_binary(size: np.ndarray, data: np.ndarray, width: int) -> pa.Array:
    """One value per row, of ``size`` items of ``width`` bytes; ``data`` has the items as rows of bytes."""
    offsets = np.concatenate([[0], np.cumsum(size * width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _from_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens per row, and the tokens."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].reshape(-1, BYTES) if data is not None and at[-1] > at[0] else np.zeros((0, BYTES), np.uint8)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :BYTES] = raw
    return np.diff(at) // BYTES, wide.view(np.uint64).ravel()


HEADS = "item_table string, h0 long, h1 int, id long, n_words int, tokens binary"


def _encode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                n, size, tokens = _tokens(b.column(4).to_pylist(), least, known)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int32()), _as_binary(size, tokens.view(np.uint8).reshape(-1, 8)[:, :BYTES], BYTES)], names=[x.split()[0] for x in HEADS.split(", ")])

    return run


def classes(items: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts with their tokens, and members.

    ``items`` has ``item_table``, ``id`` and ``text``. A class has its least id as name. Its text is carried once per
    task, so that a text that a third of all rows hold does not gather anywhere, and is turned into tokens once, if it
    has at least ``least`` words. Null texts belong to no class.
    """
    named = items.where("text is not null").select("item_table", F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("h0"), F.hash("text").alias("h1"))
    heads = named.groupBy("item_table", "h0", "h1").agg(F.min("id").alias("id"), F.min("text").alias("text")).mapInArrow(_encode(least), HEADS)
    members = named.groupBy("item_table", "h0", "h1", "id").agg(F.lit(1).alias("one")).select("item_table", "h0", "h1", "id")
    return heads, members


def _lengths(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a document can be the first shared one: with any partner, and with a partner no shorter."""
    p, q = t.numerator, t.denominator
    return n + (-p * n) // q + 1, n + (-2 * p * n) // (p + q) + 1


def _sketches(tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Parities of the tokens in 128 bits, and in more bits for long documents.

    Two documents differ in at least as many tokens as their sketches differ in bits. A wider sketch folds to a
    narrower one by XOR of its halves.
    """
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    place = tokens >> _U(28)
    one = _U(1) << (place & _U(63))
    odd = (place >> _U(6)) & _U(1) == 1
    if not len(size):
        return np.zeros((0, 2), dtype=np.uint64), {}
    sk = np.stack([np.bitwise_xor.reduceat(np.where(odd, _U(0), one), starts), np.bitwise_xor.reduceat(np.where(odd, one, _U(0)), starts)], axis=1)
    more = {}
    for i in np.nonzero(size > LONG)[0]:
        wide = np.zeros(min(2 << math.ceil(math.log2(size[i] / LONG)), MOST), dtype=np.uint64)
        own = slice(starts[i], starts[i] + size[i])
        np.bitwise_xor.at(wide, (place[own] >> _U(6)) & _U(len(wide) - 1), one[own])
        more[int(i)] = wide
    return sk, more


def _levels(filled: pa.Array, width: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: where the sketch of a row is, and the sketches of all rows that are as wide or wider, folded."""
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[filled.offset : filled.offset + len(filled)].astype(np.int64) // 8
    data = np.frombuffer(data, dtype=np.uint64, count=int(at[-1] + width[-1]))
    found, above, rows = {}, np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
    for w in sorted(np.unique(width), reverse=True):
        while above.shape[1] > w:
            half = above.shape[1] // 2
            above = above[:, :half] ^ above[:, half:]
        own = np.nonzero(width == w)[0]
        mine = data[at[own][:, None] + np.arange(w)]
        above, rows = np.concatenate([above, mine]) if len(above) else mine, np.concatenate([rows, own])
        place = np.full(len(width), -1, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        found[int(w)] = (place, above)
    return found


def _count_tokens(kinds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((len(kinds), BUCKETS), dtype=np.int64), np.zeros(len(kinds), dtype=np.int64)
        for b in batches:
            kind = np.array([kinds.index(x) for x in b.column(0).to_pylist()], dtype=np.int64)
            size, tokens = _from_binary(b.column(1))
            at = np.repeat(kind, size) * BUCKETS + (tokens & _U(BUCKETS - 1)).astype(np.int64)
            counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
            docs += np.bincount(kind[size > 0], minlength=len(kinds))
        k, i = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, np.arange(len(kinds))]), pa.int32()), pa.array(np.concatenate([i, np.full(len(kinds), -1)]), pa.int32()), pa.array(np.concatenate([counts[k, i], docs]), pa.int64())], names=["kind", "bucket", "n"])

    return run


ROW = "key long, id long, facts long, s0 long, s1 long, more binary"


def _rows(kind: np.ndarray, ids: np.ndarray, size: np.ndarray, tokens: np.ndarray, counts: np.ndarray, docs: np.ndarray, t: Fraction, region: int) -> tuple[np.ndarray, ...]:
    """Rows of regions of documents that have tokens: document, name of the region, position, role, side.

    Role 1 may meet a shorter partner, 2 a partner no shorter, 3 both. Sides 1 and 2 are the two blocks of a region made
    of a pair of blocks, whose rows meet those of the other side only.
    """
    doc = np.repeat(np.arange(len(size)), size)
    count = counts[kind[doc], (tokens & _U(BUCKETS - 1)).astype(np.int64)]
    octave = np.minimum(np.floor(4 * np.log2(np.maximum(count, 1))), 127).astype(np.uint64)
    order = np.argsort((doc.astype(np.uint64) << _U(47)) | (octave << _U(40)) | tokens)
    tokens, count = tokens[order], count[order].astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    pos = np.arange(len(tokens)) - starts[doc]
    px, py = _lengths(size, t)
    n_docs = np.maximum(docs[kind], 1).astype(np.float64)
    use = (pos < px[doc]) & (count > 1)  # a count of 1 is shared by nobody
    d, first, last = doc[use], pos[use], pos[use]
    name, expected = _mix(tokens[use] * _U(64) + kind[d].astype(np.uint64)), count[use]
    found: list[tuple[np.ndarray, ...]] = []
    for depth in range(1, DEPTH + 1):
        done = (expected <= region) | (depth == DEPTH)
        role = np.where((first < py[d]) & (last < py[d] + depth - 1), 3, 1)
        plain = done & (expected <= region)
        found.append((d[plain], name[plain], (last - depth + 1)[plain], role[plain], np.zeros(plain.sum(), np.int64)))
        large = np.nonzero(done & ~plain)[0]
        if len(large):
            blocks = np.ceil(expected[large] / region).astype(np.int64)
            mine = (_mix(ids[d[large]].astype(np.uint64) + _U(0x9E3779B97F4A7C15)) % blocks.astype(np.uint64)).astype(np.int64)
            r = np.repeat(np.arange(len(large)), blocks)
            other = np.arange(len(r)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            low, high = np.minimum(mine[r], other), np.maximum(mine[r], other)
            x = large[r]
            side = np.where(low == high, 0, np.where(mine[r] == low, 1, 2))
            found.append((d[x], _mix(name[x] + ((low * blocks[r] + high + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15))), (last - depth + 1)[x], role[x], side))
        rest = np.nonzero(~done)[0]
        if not len(rest):
            break
        n_next = np.maximum(np.minimum(px[d[rest]] + depth, size[d[rest]]) - last[rest] - 1, 0)
        r = np.repeat(rest, n_next)
        j = last[r] + 1 + np.arange(len(r)) - np.repeat(np.cumsum(n_next) - n_next, n_next)
        at = starts[d[r]] + j
        name, expected = _mix(name[r] * _U(3) + tokens[at]), expected[r] * count[at] / n_docs[d[r]]
        d, first, last = d[r], first[r], j
    return tuple(np.concatenate(c) for c in zip(*found))


def _emit(kinds: list[str], t: Fraction, table, region: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = table.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # few, as a document may go to many regions
                yield from part(whole.slice(at, 1024), counts, docs)

    def part(b: pa.RecordBatch, counts: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, tokens = _from_binary(b.column(2))
        kept = np.nonzero(size)[0]
        if not len(kept):
            return
        kind = np.array([kinds.index(x) for x in b.column(0).to_pylist()], dtype=np.int64)[kept]
        ids, size = b.column(1).to_numpy()[kept], size[kept]
        sk, more = _sketches(tokens, size)
        d, name, pos, role, side = _rows(kind, ids, size, tokens, counts, docs, t, region)
        key = ((name & ~_U(0xFFFF)) & _U((1 << 56) - 1)) | np.minimum(size, 0xFFFF).astype(np.uint64)[d]
        beyond = np.where(size >= 0xFFFF, size, 0)  # sizes that a key cannot hold
        facts = (beyond[d] << 36) | (pos << 10) | (side << 8) | (role << 6) | kind[d]
        is_long = size > LONG
        for z in (np.nonzero(~is_long[d])[0], np.nonzero(is_long[d])[0]):
            if len(z):
                dz = d[z]
                if is_long[dz[0]]:
                    width = np.array([len(more[i]) if i in more else 0 for i in range(len(size))])
                    wide = _as_binary(width[dz], np.concatenate([more[i] for i in dz]).view(np.uint8), 8)
                else:
                    wide = pa.nulls(len(z), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[z].view(np.int64)), pa.array(ids[dz]), pa.array(facts[z]), pa.array(sk[dz, 0].view(np.int64)), pa.array(sk[dz, 1].view(np.int64)), wide], names=[x.split()[0] for x in ROW.split(", ")])

    return run


def _join_regions(t: Fraction):
    p, q = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # about ROWS, see links
        if not held:
            return
        col = pa.Table.from_batches(held)
        key = col.column(0).to_numpy().view(np.uint64)
        order = np.argsort(key)  # by region, then by size
        key, ids, facts, s0, s1 = key[order], *(col.column(i).to_numpy()[order] for i in (1, 2, 3, 4))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        shown = (key & _U(0xFFFF)).astype(np.int64)
        n, pos, side, role, kind = np.where(shown == 0xFFFF, facts >> 36, shown), (facts >> 10) & 0x3FFFFFF, (facts >> 8) & 3, (facts >> 6) & 3, facts & 63
        more = col.column(5).combine_chunks()
        wide_of = np.full(len(key), -1, dtype=np.int64)
        has = np.nonzero(more.is_valid().to_numpy(zero_copy_only=False))[0]
        filled = more.drop_null()
        width = np.array([len(x) // 8 for x in filled.to_pylist()] or [2], dtype=np.int64)
        levels = _levels(filled, width) if len(filled) else {}
        del col, held
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        wide_of[back[has]] = np.arange(len(has))
        found: list[np.ndarray] = []
        held_pairs: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle() -> None:
            """Exact bounds for the pairs that passed the first look."""
            nonlocal waiting
            if not held_pairs:
                return
            i, j = (np.concatenate(x) for x in zip(*held_pairs))
            held_pairs.clear()
            waiting = 0
            ok = (role[j] & 1 > 0) & (ids[i] != ids[j]) & ((side[i] == 0) | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            swap = n[i] > n[j]  # only where sizes are beyond what a key holds
            both = n[i] + n[j]
            need = -((-p * both) // (p + q))
            most = both - 2 * need
            ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) | swap
            ok &= np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j]) <= most
            i, j, most = i[ok], j[ok], most[ok]
            a_, b_ = wide_of[i], wide_of[j]
            long_ = np.nonzero((a_ >= 0) & (b_ >= 0))[0]
            if len(long_):
                keep = np.ones(len(i), dtype=bool)
                w = np.minimum(width[a_[long_]], width[b_[long_]])
                for x in np.unique(w):
                    z = long_[w == x]
                    for c in range(0, len(z), 1 << 17):
                        zz = z[c : c + (1 << 17)]
                        at, sketches = levels[int(x)]
                        keep[zz] = np.bitwise_count(sketches[at[a_[zz]]] ^ sketches[at[b_[zz]]]).sum(axis=1) <= most[zz]
                i, j = i[keep], j[keep]
            if len(i):
                found.append(np.stack([kind[i], np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
                if len(found) > 64:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]

        def hold(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal waiting
            if len(i):
                held_pairs.append((i, j))
                waiting += len(i)
                if waiting > PAIRS:
                    settle()

        # A row meets the rows after it in its region that are not too long for it. Small regions are paired by offset,
        # all of them at once; large ones in blocks, where whole rectangles of sketches are compared.
        longest = np.where(shown == 0xFFFF, 0xFFFF, shown * q // p)
        slack = np.where(shown == 0xFFFF, 1 << 20, (q - p) * (n + longest) // (p + q))  # most differing tokens with any such partner
        is_y = role & 2 > 0
        edge = np.concatenate([[0], np.nonzero(np.diff(key >> _U(16)))[0] + 1, [len(key)]])
        length = np.diff(edge)
        small = length <= SMALL
        rest = np.repeat(edge[1:], length) - np.arange(len(key)) - 1  # rows after this one
        i = np.nonzero(np.repeat(small, length) & is_y)[0]
        for step in range(1, SMALL):
            i = i[rest[i] >= step]
            if not len(i):
                break
            j = i + step
            ok = (shown[j] <= longest[i]) & (np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j]) <= slack[i])
            hold(i[ok], j[ok])
        mixed, ones, others = np.empty((BLOCK, WIDE), dtype=np.uint64), np.empty((BLOCK, WIDE), dtype=np.uint8), np.empty((BLOCK, WIDE), dtype=np.uint8)
        for r in np.nonzero(~small)[0]:
            lo, hi = int(edge[r]), int(edge[r + 1])
            y = lo + np.nonzero(is_y[lo:hi])[0]
            for c in range(0, len(y), BLOCK):
                ys = y[c : c + BLOCK]
                far = lo + int(np.searchsorted(shown[lo:hi], longest[ys].max(), side="right"))
                limit = np.minimum(slack[ys], 255).astype(np.uint8)[:, None]
                y0, y1 = s0[ys, None], s1[ys, None]
                for a in range(int(ys[0]) + 1, far, WIDE):
                    b = min(a + WIDE, far)
                    x, bits, more_bits = (z[: len(ys), : b - a] for z in (mixed, ones, others))
                    np.bitwise_count(np.bitwise_xor(y0, s0[None, a:b], out=x), out=bits)
                    np.bitwise_count(np.bitwise_xor(y1, s1[None, a:b], out=x), out=more_bits)
                    bits += more_bits
                    padded = -(-(b - a) // 8) * 8
                    near = np.zeros((len(ys), padded), dtype=bool)
                    np.less_equal(bits, limit, out=near[:, : b - a])
                    eights = np.flatnonzero(near.reshape(-1).view(np.uint64))  # few are near: look at eight at a time
                    if not len(eights):
                        continue
                    which, byte = np.nonzero(near.reshape(-1, 8)[eights])
                    u, v = np.divmod(eights[which] * 8 + byte, padded)
                    i, j = ys[u], a + v
                    ok = (j > i) & (shown[j] <= longest[i])
                    hold(i[ok], j[ok])
        settle()
        if found:
            all_ = np.unique(np.concatenate(found), axis=0)
            for a in range(0, len(all_), 200_000):
                z = all_[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(z[:, 0], pa.int32()), pa.array(z[:, 1]), pa.array(z[:, 2])], names=["kind", "a", "b"])

    return run


LINK = "item_table string, a long, b long, similarity double"


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (n_a, a), (n_b, c) = _from_binary(b.column(3)), _from_binary(b.column(4))
            pair = np.arange(b.num_rows, dtype=np.uint64) << _U(8 * BYTES)
            both = np.sort(np.concatenate([np.repeat(pair, n_a) | a, np.repeat(pair, n_b) | c]))
            shared = both[1:][both[1:] == both[:-1]] >> _U(8 * BYTES)
            common = np.bincount(shared.astype(np.int64), minlength=b.num_rows)
            total = n_a + n_b - common
            ok = common * t.denominator >= total * t.numerator
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(pa.array(ok)) for i in range(3)), pa.array((common / np.maximum(total, 1))[ok])], names=[x.split()[0] for x in LINK.split(", ")])

    return run


def links(heads: DataFrame, threshold: float = 0.7, region: int = REGION) -> DataFrame:
    """Pairs of classes of one table whose similarity is at least ``threshold``, with the similarity.

    ``heads`` comes from :func:`classes`; it is read several times, so pass a stored table. Texts without tokens have no
    partner. The result is exact but for words of equal hash (48 bits) and tokens of equal hash (40 bits).
    """
    spark = heads.sparkSession
    t = Fraction(str(threshold))
    if not 0 < t < 1:
        raise ValueError("the threshold lies between 0 and 1")
    heads = heads.where("n_words > 0").select("item_table", "id", "tokens")
    kinds = [r[0] for r in heads.select("item_table").distinct().orderBy("item_table").collect()]  # names of tables
    if len(kinds) > 64:
        raise ValueError("at most 64 tables at a time")
    rows = heads.select("item_table", "tokens").mapInArrow(_count_tokens(kinds), "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    counts, docs = np.zeros((max(len(kinds), 1), BUCKETS), dtype=np.int64), np.zeros(max(len(kinds), 1), dtype=np.int64)
    for r in rows.toLocalIterator(prefetchPartitions=True):  # at most BUCKETS rows a table
        if r["bucket"] < 0:
            docs[r["kind"]] = r["n"]
        else:
            counts[r["kind"], r["bucket"]] = r["n"]
    table = spark.sparkContext.broadcast((counts, docs))
    emitted = heads.mapInArrow(_emit(kinds, t, table, region), ROW)
    # how many rows a document has is seen from a few; it decides about the number of tasks and nothing else
    few = heads.limit(1000)
    per = few.mapInArrow(_emit(kinds, t, table, region), ROW).count() / max(few.count(), 1)
    tasks = max(math.ceil(per * int(docs.sum()) / ROWS), spark.sparkContext.defaultParallelism)
    pairs = emitted.repartition(tasks, F.shiftright("key", 16)).mapInArrow(_join_regions(t), "kind int, a long, b long").distinct()
    named = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "kind int, item_table string")
    pairs = stored(pairs.join(F.broadcast(named), "kind").select("item_table", "a", "b"), "pairs")  # the rows of regions can go
    left = heads.select("item_table", F.col("id").alias("a"), F.col("tokens").alias("tokens_a"))
    right = heads.select("item_table", F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(left, ["item_table", "a"]).join(right, ["item_table", "b"])
    return both.select("item_table", "a", "b", "tokens_a", "tokens_b").mapInArrow(_verify(t), LINK)
