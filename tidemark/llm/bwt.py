"""Burrows-Wheeler transforms of shards and their merge by iterative interleave refinement.

Shards are merged without sorting their suffixes together. The interleave holds the suffixes of all shards in blocks of
a common prefix; each pass moves every entry, in order, to the bucket of the symbol before it, which is the place of the
suffix one longer, so after d passes the blocks are the sets of suffixes whose first d symbols are equal. A block of one
shard only can never again meet another shard: it is settled and no later pass touches it. What is left after `depth`
passes are the repeated intervals between shards; those inside a shard are read off its own order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The symbol after each text; bytes count from 1.
END = 0
#: Symbols that fit a key of 63 bits: their passes are made at once.
PACKED = 7
#: Passes between two removals of settled blocks.
SETTLE_EVERY = 3


def symbols(texts: list[bytes]) -> np.ndarray:
    """Texts one after the other, END after each."""
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    data[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
    return data


@dataclass
class Transform:
    """The transform of a shard: symbols before each suffix in order, where the suffix one longer stands, and the order itself."""

    last: np.ndarray
    longer: np.ndarray
    order: np.ndarray
    key: np.ndarray  # first PACKED symbols of each suffix in order; -1 if END is among them
    name: np.ndarray  # by place: equal just if the first `depth` symbols are


def transform(text: np.ndarray, depth: int) -> Transform:
    """Sorts a shard's suffixes to `depth` symbols: by packed keys, then only ties, by doubled prefixes."""
    n, done = len(text), min(PACKED, depth)
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(done):
        key <<= 9
        left = max(0, n - k)
        key[:left] |= text[k:]
        ended[:left] |= text[k:] == END
        ended[left:] = True
    order = np.argsort(key, kind="stable")
    first = key[order]
    at = np.arange(n)
    head = np.concatenate([[True], first[1:] != first[:-1]])
    start = np.maximum.accumulate(np.where(head, at, 0))
    name = np.empty(n + depth + 1, np.int64)
    name[n:] = -1
    name[order] = start
    while done < depth:
        step = min(done, depth - done)
        tied = np.nonzero(~(head & np.append(head[1:], True)))[0]
        if not len(tied):
            break
        place = order[tied]
        both = start[tied] * (n + 2) + name[place + step] + 1
        o = np.argsort(both, kind="stable")
        both, place = both[o], place[o]
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        order[tied], head[tied] = place, fresh
        start[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        name[place] = start[tied]
        done += step
    rank = np.empty(n, np.int64)
    rank[order] = at
    return Transform(text[order - 1], rank[order - 1], order, np.where(ended[order], -1, first), name[:n])


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, block): the entries of all shards, numbered through, whose first `depth` symbols, without END, stand in
    more than one shard, and the blocks of those that are equal."""
    base = np.cumsum([0, *(len(s.order) for s in shards)])
    last, longer = np.concatenate([s.last for s in shards]), np.concatenate([s.longer + b for s, b in zip(shards, base, strict=False)]).astype(np.int32)
    shard = np.repeat(np.arange(len(shards), dtype=np.int16), np.diff(base))
    key = np.concatenate([s.key for s in shards])
    entry = np.nonzero(key >= 0)[0]
    entry = entry[np.argsort(key[entry], kind="stable")].astype(np.int32)
    fresh = np.diff(key[entry], prepend=-1) != 0

    def unsettled(entry: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(entry):
            return entry, np.zeros(0, np.int32)
        begin = np.nonzero(fresh)[0]
        of = shard[entry]
        mixed = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
        block = np.cumsum(fresh, dtype=np.int32) - 1
        keep = mixed[block]
        return entry[keep], block[keep]

    entry, block = unsettled(entry, fresh)
    for d in range(min(PACKED, depth), depth):
        symbol = last[entry]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        order = order[np.searchsorted(symbol, END, side="right") :]  # what begins with END is no part of a text
        symbol, block, entry = symbol[len(symbol) - len(order) :], block[order], longer[entry[order]]
        fresh = np.ones(len(entry), bool)
        np.not_equal(block[1:], block[:-1], out=fresh[1:])
        fresh[1:] |= symbol[1:] != symbol[:-1]
        if (d + 1 - depth) % SETTLE_EVERY == 0:
            entry, block = unsettled(entry, fresh)
        else:
            block = np.cumsum(fresh, dtype=np.int32)
        if not len(entry):
            break
    return entry, block


def classes(texts: list[bytes], depth: int, shard_symbols: int = 1 << 18) -> np.ndarray:
    """For each place of `symbols(texts)` the class of its suffix: places whose next `depth` bytes lie inside their texts
    have equal classes just if those bytes are equal. Texts are cut into shards of about `shard_symbols`."""
    size = np.array([len(t) + 1 for t in texts])
    cut = np.nonzero(np.diff((np.cumsum(size) - size) // shard_symbols))[0] + 1
    parts = [texts[a:b] for a, b in zip([0, *cut], [*cut, len(texts)], strict=True)]
    shards = [transform(symbols(p), depth) for p in parts]
    base = np.cumsum([0, *(len(s.order) for s in shards)])
    out = np.concatenate([s.name + b for s, b in zip(shards, base, strict=False)])
    if len(shards) > 1:
        entry, block = merge(shards, depth)
        place = np.concatenate([s.order + b for s, b in zip(shards, base, strict=False)])
        out[place[entry]] = base[-1] + block
    return out
