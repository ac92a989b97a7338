"""Near-duplicate records with small edits by a grouped prefix join.

A text is the set of its distinct 8-character substrings, n of them; equal plain
forms are one text.  The substrings are put in one global order, rare ones
first, by a hashed table of frequency classes counted over all texts.  Two sets
with a likeness of at least ``T`` share at least ``t = T / (1 + T) * (n + m)``
substrings; so their first ``n - t + K`` and ``m - t + K`` in the order share
at least K, for any K up to t.  Therefore a text keeps the prefix that its
smallest possible partner needs, ``n - T n + K``, and each substring carries the
largest partner for which it still counts (later ones only serve small partners).

Texts with identical prefix and size are one group, and only groups are joined.
The tokens of a prefix are dealt by hash to PARTS parts, and the groups of a side
by hash to blocks; a task joins all tokens of one part in one pair of blocks.  So a
group pair is met in one task a part, which counts all that it shares there, and if
it shares what it needs in all, some part has a PARTS-th of that.  Smaller counts are
dropped where they arise: pairs that share a few frequent substrings by chance,
whose number grows faster than the input, never leave their task.  The counts
that remain are summed over the parts, and a part not heard of counts with the
most that it may have dropped; neither this filter nor the candidates depend on
the number of blocks.  With many blocks the tasks are run in waves, so that only
COPIES copies of the prefixes are shuffled at once.
Group pairs that pass are expanded to their members, which are verified on the full
texts, exactly.  Verified links are expanded to records over both columns, and
linked records are consolidated by graph contraction.

A token that more than ``RUN`` groups of a task hold (a large family of near copies)
is not paired out: its groups are only chained, in order of size, and the token is
set aside.  Tokens of very high frequency go to one task a part and block, are
chained there and always set aside.  Likewise the members of large groups are linked with
their group's least member only.  Once the records linked so far have been
consolidated, a second pass seeks the pairs that are not in one group yet, so that
a family costs about its size, not its square, and no link between groups is
lost.  As a pair may share its K tokens on either side of this division, the first
pass asks for half of them and the second for the other half, by a prefix filter
over the tokens set aside alone.
"""

from __future__ import annotations

import gc
import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm.contraction import contract
from twinloom.llm.plain import key, plain, record_keys
from twinloom.runtime import discard, stash
from twinloom.sources.tables import table

WIDTH = 8
THRESHOLD = 0.6
OVERLAP = 96  # K at most
STEP = 12  # substrings of a text for each of its K
PARTS = 6  # token parts; a pair has at least a PARTS-th of its shared tokens in one of them
RUN = 256  # groups with one token in a task that are paired out
HOT = 100_000  # occurrences above four times the mean slot from which a token is always set aside
SLOT_BITS = (16, 25)  # frequency table: from 2**16 to 2**25 classes of one byte
BLOCK_TOKENS = 3_000_000  # of one part and block; a task has two blocks at most
COPIES = 2  # copies of all prefixes that are shuffled at once
PAIRS = 16_000_000  # pairs by token that are looked at in one block, at most
TEXTS = 2_000  # texts hashed at once
MEMBERS = 64  # member pairs of two groups that are expanded at once
_CHUNK = 1 << 16
_SINGLE = 1
_CERTAIN = 1 << 20  # count of a pair that is verified whatever it shares
_OWNERS = 1 << 24


def hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all substrings of the given width (8 or less); injective for width 8."""
    if len(text) < width:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(text + bytes(8 - width), np.uint8)
    x = np.lib.stride_tricks.sliding_window_view(buf, 8).copy().view(np.uint64).ravel()
    if width < 8:
        x &= np.uint64((1 << 8 * width) - 1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def least_shared(n: int, threshold: float) -> int:
    """Substrings shared with the smallest partner, of size threshold * n, at least."""
    return math.ceil(threshold * n - 1e-9)


def batch_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes at all positions of a batch's texts laid end to end, and each text's first position and number of substrings."""
    data, lengths = flat(texts)
    first = np.cumsum(lengths) - lengths
    return hashes(data.tobytes() + bytes(WIDTH - 1)), first, np.maximum(lengths - (WIDTH - 1), 0)


def pieces(batches):
    """Batches in pieces of TEXTS rows."""
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield b.slice(at, TEXTS)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, end to end, and the values' lengths."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, np.diff(at).astype(np.int64)


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of the stretches of an array between the cuts."""
    offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values[cuts[0] : cuts[-1]]).tobytes())])


def least_overlap(n):
    """K for a text of n substrings; that of a pair is its smaller text's."""
    return np.clip(np.asarray(n) // STEP, 1, OVERLAP)


def part_least(n):
    """Of the tokens that a pair must share in the first pass, those that some part has at least; n is the smaller size."""
    return -(-(-(-least_overlap(n) // 2)) // PARTS)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """Classes 0 to 255 of counts, in their order: exact below 16, then six an octave."""
    f = np.maximum(counts.astype(np.float64), 16)
    return np.where(counts < 16, counts, np.minimum(255, 16 + np.floor(6 * np.log2(f / 16)))).astype(np.uint8)


def class_count(c: np.ndarray) -> np.ndarray:
    """Least count of a class."""
    return np.where(c < 16, c, 16 * 2.0 ** ((c - 16.0) / 6)).astype(np.int64)


def prefix(x: np.ndarray, classes: np.ndarray, threshold: float = THRESHOLD) -> tuple[int, np.ndarray]:
    """Number of distinct hashes, and the sorted prefix in the global order as (frequency class << 56 | hash bits).

    The code is the same for all texts.
    """
    x = _distinct(x)
    n = len(x)
    bits = len(classes).bit_length() - 1
    order = (classes[(x >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (x & np.uint64((1 << 56) - 1))
    m = min(n, n - least_shared(n, threshold) + int(least_overlap(n)))
    return n, np.sort(order if m == n else np.partition(order, m - 1)[:m])


def partner_limits(n: np.ndarray, pos: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """For a token at place pos of a text of n: the largest partner it counts for, in 128ths of n, rounded up."""
    share = threshold / (1 + threshold)
    most = (n * (1 - share) + least_overlap(n) - pos) / share
    return np.clip(np.ceil(most / n * 128 + 1e-6), 0, 255).astype(np.uint8)


def _texts(source: DataFrame) -> DataFrame:
    """``(side, k, text)``: every distinct plain form of each side once."""

    def emit(batches):
        seen: set[bytes] = set()
        for b in batches:
            out = []
            for h, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, m = plain(h), plain(m)
                if h and m:
                    for side, p in ((0, h), (1, m)):
                        k = key(p)
                        if (sk := k + bytes([side])) not in seen and len(p) >= WIDTH:
                            seen.add(sk)
                            out.append((side, k, p))
            if len(seen) > 2_000_000:  # only saves shuffle; what comes twice is dropped below
                seen.clear()
            s, k, p = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(p, pa.binary())], ["side", "k", "text"])

    return source.select("human_src", "llm_src").mapInArrow(emit, "side int, k binary, text binary").repartition("side", "k").dropDuplicates(["side", "k"])


def frequency_classes(texts: DataFrame, bits: int) -> np.ndarray:
    """Frequency class of the substrings by hash slot, counted over all texts; 2**bits bytes however many texts there are."""

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for b in pieces(batches):
            x, first, n = batch_hashes(b.column(0))
            valid = np.zeros(len(x) + 1, np.int8)  # +1 where a text's substrings begin, -1 where they end
            np.add.at(valid, first[n > 0], 1)
            np.add.at(valid, (first + n)[n > 0], -1)
            np.add.at(total, (x[np.cumsum(valid[:-1]).astype(bool)] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        cut = total.reshape(-1, min(_CHUNK, 1 << bits))
        for at in range(0, len(cut), 16):  # a byte a slot, and what exceeds it apart
            ids, low, more = [], [], []
            for i in range(at, min(at + 16, len(cut))):
                if cut[i].any():
                    over = np.flatnonzero(cut[i] > 255)
                    ids.append(i)
                    low.append(np.minimum(cut[i], 255).astype(np.uint8).tobytes())
                    more.append(np.stack((over, cut[i][over] - 255)).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(low, pa.binary()), pa.array(more, pa.binary())], ["i", "low", "more"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, low, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(low, np.uint8).astype(np.int64)
                at, n = np.frombuffer(more, np.int64).reshape(2, -1)
                x[at] += n
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([frequency_class(v).tobytes() for v in total.values()], pa.binary())], ["i", "c"])

    out = np.zeros(1 << bits, np.uint8)
    wide = min(_CHUNK, 1 << bits)
    for r in texts.select("text").mapInArrow(count, "i int, low binary, more binary").repartition("i").mapInArrow(merge, "i int, c binary").collect():  # 2**bits bytes in all
        out[r.i * wide : (r.i + 1) * wide] = np.frombuffer(r.c, np.uint8)
    return out


def _mixed(o: np.ndarray) -> np.ndarray:
    o = o * np.uint64(0xBF58476D1CE4E5B9)
    return o ^ (o >> np.uint64(29))


def block_pairs(blocks: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of blocks, i <= j."""
    return [(i, j) for i in range(blocks) for j in range(i, blocks)]


def _packed(to: list[list[int]], keys: np.ndarray, **cols: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A row for each stretch between the cuts, sent to the tasks of its key; columns not given are null."""
    given = {f: binary(values, cuts) for f, (values, cuts) in cols.items()}
    names = [f.split()[0] for f in _PREFIX.split(", ")]
    full = [pa.array([to[i] for i in keys.tolist()], pa.list_(pa.int32())), *(given.get(f, pa.nulls(len(keys), pa.binary())) for f in names[1:])]
    return pa.RecordBatch.from_arrays(full, names)


_PREFIX = "to array<int>, g binary, n binary, lengths binary, tokens binary, limits binary, k binary"


def _prefix_rows(texts: DataFrame, classes, blocks: dict[int, int], threshold: float) -> DataFrame:
    """``(to, g, n, lengths, tokens, limits, k)``: the prefixes of many groups in one row, by token part and block, and the tasks that it goes to.

    Rows without limits hold tokens of very high frequency, rows with k the members of groups; both go to one task.
    Tokens that occur once in all texts are left out.
    """

    def emit(batches):
        table_ = classes.value
        known = class_count(np.arange(256))
        mean = int(np.bincount(table_, minlength=256) @ known) // len(table_)
        hot_class = int(frequency_class(np.array([HOT + 4 * mean]))[0])
        base, every, own = 0, [], []  # tasks of a (side, block, part): those of all its block pairs, and that of the block with itself
        first_cell = {}
        for side in (0, 1):
            first_cell[side] = len(every)
            pairs = block_pairs(blocks[side])
            for block in range(blocks[side]):
                for part in range(PARTS):
                    every.append([base + part * len(pairs) + i for i, pair in enumerate(pairs) if block in pair])
                    own.append([base + part * len(pairs) + pairs.index((block, block))])
            base += PARTS * len(pairs)
        seen: set[int] = set()
        for b in pieces(batches):
            x, first, count = batch_hashes(b.column(2))
            sides = b.column(0).to_numpy().astype(np.int64)
            codes, places, sizes, groups, fresh = [], [], [], [], []
            for side, at, m in zip(sides.tolist(), first.tolist(), count.tolist(), strict=True):
                n, o = prefix(x[at : at + m], table_, threshold)
                g = int.from_bytes(hashlib.blake2b(o.tobytes(), digest_size=8, salt=n.to_bytes(8, "little"), person=bytes([side])).digest(), "little", signed=True)
                often = np.flatnonzero((o >> np.uint64(56)) != _SINGLE)
                codes.append(o[often])
                places.append(often)
                sizes.append(n)
                groups.append(g)
                fresh.append(g not in seen)
                seen.add(g)
            if len(seen) > 1_000_000:  # only saves shuffle: a group that comes again is collapsed in its tasks
                seen.clear()
            if not codes:
                continue
            n, g, fresh = np.array(sizes, np.int64), np.array(groups, np.int64), np.array(fresh, bool)
            cell = np.array([first_cell[0], first_cell[1]])[sides] + PARTS * (_mixed(g.view(np.uint64)) % np.array([blocks[0], blocks[1]], np.uint64)[sides]).astype(np.int64)
            lengths = np.array([len(o) for o in codes], np.int64)
            some = np.flatnonzero(lengths > 0)
            order = some[np.argsort(cell[some], kind="stable")]
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            if len(order):
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), "S16")
                cuts = np.append(starts, len(order))
                yield _packed(own, cell[order][starts], g=(g[order], cuts), k=(keys[order], cuts))
            text = np.repeat(np.arange(len(codes)), lengths)
            o, pos = np.concatenate(codes), np.concatenate(places)
            limits = partner_limits(n[text], pos, threshold)
            hot = (o >> np.uint64(56)).astype(np.int64) >= hot_class
            o = _mixed(o)
            cell = cell[text] + ((o >> np.uint64(32)) % np.uint64(PARTS)).astype(np.int64)
            for kind, to in ((~hot, every), (hot, own)):
                mine = np.flatnonzero(kind & fresh[text])
                if not len(mine):
                    continue
                mine = mine[np.lexsort((text[mine], cell[mine]))]
                cell_, text_ = cell[mine], text[mine]
                heads = np.flatnonzero((np.diff(cell_, prepend=-1) != 0) | (np.diff(text_, prepend=-1) != 0))  # one a group and cell
                rows = np.flatnonzero(np.diff(cell_[heads], prepend=-1))
                group_cuts, token_cuts = np.append(rows, len(heads)), np.append(heads[rows], len(mine))
                tokens = (o[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                cols = {"g": (g[text_[heads]], group_cuts), "n": (n[text_[heads]].astype(np.int32), group_cuts), "lengths": (np.diff(np.append(heads, len(mine))).astype(np.int32), group_cuts), "tokens": (tokens, token_cuts)}
                yield _packed(to, cell_[heads][rows], **cols, **({"limits": (limits[mine], token_cuts)} if to is every else {}))

    return texts.select("side", "k", "text").mapInArrow(emit, _PREFIX)


def _chained(tokens: np.ndarray, owner: np.ndarray, size: int, fits) -> np.ndarray:
    """Codes of the neighbours among the owners of each token that fit; both arrays sorted by token, then owner."""
    next_ = np.flatnonzero(tokens[1:] == tokens[:-1])
    a, b = owner[next_].astype(np.int64), owner[next_ + 1].astype(np.int64)
    return np.unique((a * size + b)[(a != b) & fits(a, b)])


def shard_pairs(n: np.ndarray, tokens: np.ndarray, owner: np.ndarray, limits: np.ndarray, second: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one task as codes ``i * len(n) + j``, i < j, with their numbers of shared tokens, and the (token, owner) set aside.

    Owners are numbered in order of size n, fewer than 2**24.  Where second tells the
    owners of the second block, pairs within a block are left to other tasks.  Tokens of
    up to RUN owners are paired out, others chained; chained pairs count as certain.
    """
    entries = (tokens.astype(np.uint64) << np.uint64(32)) | (owner.astype(np.uint64) << np.uint64(8)) | limits.astype(np.uint64)
    entries.sort()
    tokens, owner, limits = (entries >> np.uint64(32)).astype(np.uint32), ((entries >> np.uint64(8)) & np.uint64(_OWNERS - 1)).astype(np.int32), (entries & np.uint64(255)).astype(np.uint8)
    del entries
    fits = (lambda a, b: a != b) if second is None else (lambda a, b: second[a] != second[b])
    size = np.int64(max(1, len(n)))
    again = tokens[1:] == tokens[:-1]  # entry i + 1 has the token of entry i
    starts = np.flatnonzero(np.concatenate(([True], ~again))) if len(tokens) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(tokens)))
    aside = np.repeat(lengths > RUN, lengths)
    short = lengths[lengths <= RUN]
    blocks = max(1, -(-int((short * (short - 1) // 2).sum()) // PAIRS))
    del starts, lengths, short
    chain = _chained(tokens[aside], owner[aside], size, fits)
    base = np.flatnonzero(again & ~aside[1:]) if len(tokens) else np.empty(0, np.int64)
    out, counts = [chain], [np.full(len(chain), _CERTAIN, np.int64)]
    least = part_least(n)
    for block in range(blocks):  # the pairs of one text fall into one block
        held, d = [], 1
        active = base[owner[base] % blocks == block] if blocks > 1 else base
        while len(active):  # pairs of equal tokens at distance d, for growing d
            a, b = owner[active], owner[active + d]
            na, nb = n[a], n[b]  # na <= nb
            near = (nb * 128 <= limits[active] * na) & (na >= threshold * nb - 1e-9)  # beyond it all are too large
            good = near & (na * 128 <= limits[active + d] * nb) & fits(a, b)
            held.append(a[good] * size + b[good])
            d += 1
            active = active[near]
            active = active[active + d < len(tokens)]
            active = active[tokens[active] == tokens[active + d]]
        codes, shared = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
        enough = shared >= least[codes // size]
        out.append(codes[enough])
        counts.append(shared[enough])
    return np.concatenate(out), np.concatenate(counts), tokens[aside].astype(np.int64), owner[aside].astype(np.int64)


_FOUND = "side int, a bigint, b bigint, n int, shared int, k binary, token bigint"
_FOUND_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]


def _collapsed(g: np.ndarray, n: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which groups are kept, each once; equal ids of unlike content (a hash collision) stay apart."""
    order = np.argsort(g, kind="stable")
    ends = np.cumsum(lengths)
    keep = np.ones(len(g), bool)
    for at in np.flatnonzero(g[order][1:] == g[order][:-1]).tolist():
        i, before = int(order[at + 1]), at
        while before >= 0 and g[order[before]] == g[i] and keep[i]:
            j = int(order[before])
            keep[i] = not (keep[j] and n[i] == n[j] and np.array_equal(tokens[ends[i] - lengths[i] : ends[i]], tokens[ends[j] - lengths[j] : ends[j]]))
            before -= 1
    return keep


def _shared(rows: DataFrame, blocks: dict[int, int], width: int, threshold: float) -> DataFrame:
    """Of each task: counts ``(side, a, b, n, shared)``, tokens set aside ``(side, a, n, token)``, members ``(side, a, k)``; rows have their task as ``task``, with width partitions."""
    tasks = [(side, part, i, j) for side in (0, 1) for part in range(PARTS) for i, j in block_pairs(blocks[side])]

    def batch(m: int, side: int, **cols):
        full = [pa.array(np.full(m, side, np.int32)) if f == "side" else pa.nulls(m, t) if f not in cols else cols[f] if isinstance(cols[f], pa.Array) else pa.array(cols[f], t) for f, t in zip([f.split()[0] for f in _FOUND.split(", ")], _FOUND_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(full, [f.split()[0] for f in _FOUND.split(", ")])

    def set_aside(side: int, part: int, g: np.ndarray, n: np.ndarray, token: np.ndarray, who: np.ndarray):
        for at in range(0, len(token), 50_000):
            w = who[at : at + 50_000]
            yield batch(len(w), side, a=g[w], n=n[w].astype(np.int32), token=token[at : at + 50_000].astype(np.int64) | np.int64(part) << np.int64(32))

    def counted(side: int, g: np.ndarray, n: np.ndarray, codes: np.ndarray, shared: np.ndarray):
        for at in range(0, len(codes), 50_000):
            a, b = np.divmod(codes[at : at + 50_000], max(1, len(n)))
            yield batch(len(a), side, a=np.minimum(g[a], g[b]), b=np.maximum(g[a], g[b]), n=n[a].astype(np.int32), shared=shared[at : at + 50_000].astype(np.int32))

    def joined(got: list[tuple]) -> tuple:
        """Groups in order of size, and their tokens, owners and limits."""
        g, n, lengths, tokens, limits = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        keep = _collapsed(g, n, lengths, tokens)
        if not keep.all():
            held = np.repeat(keep, lengths)
            g, n, lengths, tokens, limits = g[keep], n[keep], lengths[keep], tokens[held], limits[held] if len(limits) else limits
        order = np.argsort(n, kind="stable")
        rank = np.empty(len(n), np.int32)
        rank[order] = np.arange(len(n))
        return g[order], n[order].astype(np.int64), tokens, np.repeat(rank, lengths), limits

    def work(task: int, held: list[pa.RecordBatch]):
        side, part, i, j = tasks[task]
        cold, hot = [], []
        for b in held:
            g, n, lengths, tokens, limits, k = b.columns[1:]
            members = pa.compute.is_valid(k)
            if pa.compute.any(members).as_py():
                a, keys = flat(g.filter(members))[0].view(np.int64), flat(k.filter(members))[0].tobytes()
                yield batch(len(a), side, a=a, k=pa.array([keys[at : at + 16] for at in range(0, len(keys), 16)], pa.binary()))
            ordinary = pa.compute.is_valid(limits)
            for to, mine in ((cold, ordinary), (hot, pa.compute.invert(pa.compute.or_(ordinary, members)))):
                if pa.compute.any(mine).as_py():
                    to.append((flat(g.filter(mine))[0].view(np.int64), flat(n.filter(mine))[0].view(np.int32), flat(lengths.filter(mine))[0].view(np.int32), flat(tokens.filter(mine))[0].view(np.uint32), flat(limits.filter(mine))[0] if to is cold else np.empty(0, np.uint8)))
        held.clear()
        if hot:
            g, n, tokens, owner, _ = joined(hot)
            order = np.lexsort((owner, tokens))
            chain = _chained(tokens[order], owner[order], max(1, len(n)), lambda a, b: a != b)
            yield from counted(side, g, n, chain, np.full(len(chain), _CERTAIN))
            yield from set_aside(side, part, g, n, tokens, owner)
        if cold:
            g, n, tokens, owner, limits = joined(cold)
            if len(n) >= _OWNERS:
                raise ValueError(f"{len(n)} groups in one task")
            second = None if i == j else (_mixed(g.view(np.uint64)) % np.uint64(blocks[side])).astype(np.int64) == j
            codes, shared, token, who = shard_pairs(n, tokens, owner, limits, second, threshold)
            yield from counted(side, g, n, codes, shared)
            yield from set_aside(side, part, g, n, token, who)

    def run(batches):
        task, held = None, []
        for b in batches:
            s = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(s)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(s)], strict=True):
                if hi > lo:
                    if s[lo] != task and held:
                        yield from work(task, held)
                    task = int(s[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from work(task, held)

    return rows.repartitionById(width, F.col("task") % width).mapInArrow(run, _FOUND)


def _need(n, of: float = 2.0):
    """Tokens that a pair with the smaller size n must share among those not set aside."""
    return F.ceil(F.greatest(F.lit(1), F.least(F.lit(OVERLAP), F.floor(n / STEP))) / of)


def likeness(a: bytes, b: bytes) -> tuple[int, int]:
    """Substrings that both plain forms contain, and that either contains."""
    x, y = _distinct(hashes(a)), _distinct(hashes(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for b in batches:
            keep = [i for i, (x, y) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)) if (s := likeness(x, y))[0] >= threshold * s[1] - 1e-9]
            yield b.take(pa.array(keep, pa.int64())).select([0, 1, 2])

    left = texts.select("side", F.col("k").alias("a"), F.col("text").alias("ta"))
    right = texts.select("side", F.col("k").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, ["side", "a"]).join(right, ["side", "b"]).select("side", "a", "b", "ta", "tb")
    return joined.mapInArrow(run, "side int, a binary, b binary")


def shard_counts(load: dict[int, float]) -> dict[int, int]:
    """Blocks of groups of each side; neither candidates nor results depend on their number."""
    return {side: max(math.ceil(load.get(side, 0) / PARTS / BLOCK_TOKENS), 1) for side in (0, 1)}


def shared_counts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of group pairs, tokens set aside and members of groups over ``texts(side, k, text)``; see ``_shared``."""
    spark = texts.sparkSession
    chars = {r.side: r.chars for r in texts.groupBy("side").agg(F.sum(F.length("text")).alias("chars")).collect()}
    bits = min(SLOT_BITS[1], max(SLOT_BITS[0], math.ceil(math.log2(sum(chars.values()) / 16 + 1))))
    blocks = shard_counts({side: n * (1 - threshold) for side, n in chars.items()})
    classes = spark.sparkContext.broadcast(frequency_classes(texts, bits))
    rows = _prefix_rows(texts, classes, blocks, threshold)
    tasks = PARTS * sum(len(block_pairs(n)) for n in blocks.values())
    waves = math.ceil(max(blocks.values()) / COPIES)  # a block goes to as many tasks of a part as there are blocks
    rows = stash(rows, "prefixes") if waves > 1 else rows
    sent = rows.select(F.explode("to").alias("task"), *[f.split()[0] for f in _PREFIX.split(", ")][1:])
    out = []
    for wave in range(waves):
        lo, hi = tasks * wave // waves, tasks * (wave + 1) // waves
        out.append(stash(_shared(sent.where(F.col("task").between(lo, hi - 1)), blocks, max(1, hi - lo), threshold), "shared"))
        if waves > 1:  # the wave's shuffle files go only once the driver collects its garbage
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    if waves > 1:
        discard(rows)
    return reduce(DataFrame.unionByName, out)


def group_pairs(found: DataFrame) -> DataFrame:
    """``(side, a, b)``: pairs of groups whose counts may reach what they need; a part not heard of has less than its least."""
    total = found.where("b is not null").groupBy("side", "a", "b").agg(F.sum("shared").alias("shared"), F.count("*").alias("heard"), F.min("n").alias("n"))
    need = _need(F.col("n"))
    rest = (PARTS - F.col("heard")) * (F.ceil(need / PARTS) - 1)
    return total.where(F.col("shared") + F.greatest(F.lit(0), rest) >= need).select("side", "a", "b")


def member_pairs(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text pairs ``(side, a, b)`` of group pairs and groups, and the group pairs that are only covered by their least members."""
    sized = stash(members.groupBy("side", "g").agg(F.count("*").alias("m"), F.min("k").alias("rep")), "groups")
    end = lambda c: sized.select("side", F.col("g").alias(c), F.col("m").alias(f"m{c}"), F.col("rep").alias(f"r{c}"))
    own = sized.where("m > 1").select("side", F.col("g").alias("a"), F.col("g").alias("b"))
    both = stash(pairs.where("a <> b").unionByName(own).join(end("a"), ["side", "a"]).join(end("b"), ["side", "b"]), "group-pairs")
    single = both.where("ma = 1 and mb = 1").select("side", F.col("ra").alias("a"), F.col("rb").alias("b"))
    member = lambda c: members.select("side", F.col("g").alias(c), F.col("k").alias(f"k{c}"))
    few = both.where(f"ma * mb between 2 and {MEMBERS}").join(member("a"), ["side", "a"]).join(member("b"), ["side", "b"]).select("side", F.col("ka").alias("a"), F.col("kb").alias("b"))
    large = both.where(f"ma * mb > {MEMBERS}")
    star = large.where("a = b").join(member("a"), ["side", "a"]).select("side", F.col("ra").alias("a"), F.col("ka").alias("b"))
    reps = large.where("a <> b").select("side", F.col("ra").alias("a"), F.col("rb").alias("b"))
    out = single.unionByName(few).unionByName(star).unionByName(reps).where("a <> b")
    return out.select("side", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), large.select("side", "a", "b")


_APART = "la is null or lb is null or la <> lb"


def _set_aside_pairs(aside: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``(side, a, b)``: group pairs that share enough tokens set aside, and whose records aren't in one group yet.

    ``labels(side, g, label)`` is a group's class of records, null if they lie in
    several.  Tokens whose groups are all of one class drop out in an aggregation.
    A pair must share ``c`` of the others, so it shares one of the first ``h - c + 1``
    of each end's h tokens, rare ones first; groups with fewer than c drop out.  The
    rest is an equi-join on the token, which AQE splits where it is skewed.
    """
    entries = aside.distinct().join(labels, ["side", "g"])
    by = ["side", "token"]
    mixed = entries.groupBy(*by).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if(F.isnull("label")).alias("several"), F.count("*").alias("often"))
    alive = entries.join(mixed.where("often > 1 and (several > 0 or lo <> hi)").select(*by, "often"), by)
    lists = alive.groupBy("side", "g", "n", "label").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("ts"))  # a text's prefix at most
    least = _need(F.col("n") * F.lit(threshold) - 1, 2.0)  # of the smallest partner; the first pass asks for half, rounded up
    least = F.greatest(F.lit(1), least)
    first = lists.where(F.size("ts") >= least).select("side", "g", "n", "label", F.explode(F.slice("ts", F.lit(1), (F.size("ts") - least + 1).cast("int"))).alias("t"))
    held = stash(first.select("side", "t.token", "g", "n", "label"), "set-aside")
    left = held.select(*by, F.col("g").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = held.select(*by, F.col("g").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    return left.join(right, by).where((F.col("a") < F.col("b")) & F.expr(_APART) & fits).select("side", "a", "b").distinct()


def _expand(units: DataFrame, links: DataFrame) -> DataFrame:
    """``(a, b)``: unit pairs whose human texts are equal or linked and whose llm texts are too."""
    both = lambda side: links.where(F.col("side") == side).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    human = units.join(both(0).withColumnRenamed("a", "hk"), "hk").select(F.col("b").alias("hk"), "lk", "rep")
    by_human = units.select("hk", "lk", "rep").unionByName(human)
    llm = by_human.join(both(1).withColumnRenamed("a", "lk"), "lk").select("hk", F.col("b").alias("lk"), "rep")
    reach = by_human.unionByName(llm)
    other = units.select("hk", "lk", F.col("rep").alias("b"))
    return reach.join(other, ["hk", "lk"]).where("rep < b").select(F.col("rep").alias("a"), "b")


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(group_id, record_id)`` for every record in a group of two or more.

    Records of ``records(record_id, human_src, llm_src)`` are linked when both
    columns' plain forms have likeness of at least threshold.  Null or empty
    plain forms take no part; forms under 8 characters have no substring and are
    like nothing; ties are settled by the smallest record_id; repeated rows with
    one record_id count as one record; other columns are ignored.
    """
    source = records.select("record_id", "human_src", "llm_src")
    keys = stash(record_keys(source), "keys")
    texts = stash(_texts(source), "texts")
    found = shared_counts(texts, threshold)
    members = found.where("k is not null").select("side", F.col("a").alias("g"), "k")
    close = stash(group_pairs(found), "close")
    pairs, large = member_pairs(close, members)
    links = stash(_verified(pairs, texts, threshold), "links")
    long = texts.select("side", "k")
    units = keys.distinct().groupBy("hk", "lk").agg(F.min("record_id").alias("rep"), F.count("*").alias("copies"))
    for side, c in ((0, "hk"), (1, "lk")):
        units = units.join(long.where(F.col("side") == side).select(F.col("k").alias(c)), c, "left_semi")
    units = stash(units, "units")
    roots = stash(contract(_expand(units, links)), "roots")
    aside = found.where("token is not null").select("side", F.col("a").alias("g"), "n", "token")
    if aside.limit(1).count() or large.limit(1).count():
        rooted = units.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("hk", "lk", F.coalesce("root", "rep").alias("root"))
        ends = rooted.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("hk").alias("k"), "root"), F.struct(F.lit(1).alias("side"), F.col("lk").alias("k"), "root"))).alias("e")).select("e.*")
        one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label")
        bounds = [F.min("root").alias("lo"), F.max("root").alias("hi")]
        by_text = stash(members.join(ends, ["side", "k"]), "labels")
        labels = by_text.groupBy("side", "g").agg(*bounds).select("side", "g", one)
        text_labels = by_text.groupBy("side", "g", "k").agg(*bounds).select("side", "g", "k", one)
        wide = _set_aside_pairs(aside, labels, threshold).unionByName(large).distinct()
        end = lambda c: text_labels.select("side", F.col("g").alias(c), F.col("k").alias(f"k{c}"), F.col("label").alias(f"l{c}"))
        more = wide.join(end("a"), ["side", "a"]).join(end("b"), ["side", "b"]).where(f"ka <> kb and ({_APART})")
        more = more.select("side", F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct().join(links, ["side", "a", "b"], "left_anti")
        links = links.unionByName(stash(_verified(more, texts, threshold), "links"))
        roots = stash(contract(_expand(units, links)), "roots")
    placed = units.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("rep").alias("group_id"), F.sum("copies").alias("size")).where("size > 1")
    grouped = placed.join(least, "root").select("hk", "lk", "group_id")
    return keys.join(grouped, ["hk", "lk"]).select("group_id", "record_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "task1"))


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of near-duplicate groups by size."""
    return p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("records")).groupBy("records").agg(F.count("*").alias("n_groups"))
