"""Exact removal of repeated substrings, with suffix arrays.

A window is a string of `window` bytes.  A byte goes if a window over it also starts in a
document with a smaller id.  Four steps keep the work near the repeated parts:

1. Exact copies: whole texts are compared by hash; of equal texts only the smallest id
   goes on, the others are removed whole.
2. Shards by content: the smallest hash of the n-grams inside a window depends on the
   window alone, so equal windows agree in it.  Consecutive windows with one such hash
   are a segment.  Only hashes, ids and places are shuffled, as sorted runs, to find
   hashes that more than one document has.
3. Bytes of those segments alone go to the bucket of their hash.  A shard builds a suffix
   array over them (prefix doubling in numpy that only goes on with groups which are
   not yet single, after Larsson and Sadakane, to the depth of a window), takes common
   prefixes of neighbours, and reads off groups of equal windows with their smallest id.
   A bucket holds several shards.  They are cut in the order of the hashes and, where that
   can be, between two of them: then no window is in both.  Only where segments of one hash
   fill several shards are these merged, all at once: windows whose hashes meet are compared
   by their bytes.
4. Spans meet their text, once.

Whatever repeats inside a block of documents is decided there and sent once, so that a
passage which a third of all documents share costs a shard one entry for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, binary_column, give_back, materialize, mix64, ranges, runs_of, shuffle_partitions, text_bytes

GRAM = 20
CHUNK_BYTES = 1 << 18
BLOCK_BYTES = 8 << 20
#: Bytes of one suffix array; a bucket of segments holds several.
SHARD_BYTES = 1 << 17
#: Exact copies are anti-joined by broadcast up to so many rows of 24 bytes, else by shuffle.
BROADCAST_ROWS = 1_000_000
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_SHARED = 0xFFFFFFFF
SALTS = 32


#: Made once in each worker: making one takes longer than to compress a short row.
_FAST, _DENSE, _BACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def packed(raw: np.ndarray) -> bytes:
    return _DENSE.compress(raw)


def unpacked(data: bytes) -> bytes:
    return _BACK.decompress(data)


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    return _FAST.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(unpacked(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[i : i + width]) for each i where that is inside h, by doubling."""
    have, out = 1, h
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def segments(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """hash, text number, start (in raw) and number of windows of each segment.  Equal
    windows have equal hashes; different ones may, which only makes more to compare."""
    rolling = RollingHash(_BYTE_VALUE[raw])
    none = np.zeros(0, np.int64)
    n = len(raw) - window + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    low = sliding_min(rolling.grams(gram), window - gram + 1)
    new = np.ones(n, bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    # Windows begin in [start, end) of a text; those over two texts are none.
    end = np.maximum(offsets[1:] - window + 1, offsets[:-1])
    some = np.flatnonzero(end > offsets[:-1])
    start, stop = offsets[some], end[some]
    new[start] = True
    new[ranges(np.append(0, stop), np.append(start, n) - np.append(0, stop))] = False
    first = np.flatnonzero(new)
    owner = np.searchsorted(offsets, first, side="right") - 1
    return low[first], owner, first, np.minimum(np.append(first[1:], n), end[owner]) - first


def suffix_array(text: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Suffix array of bytes.  `rank` is a group number for each place; after each round,
    groups hold suffixes that agree in twice as many bytes; single ones are done.  With a
    limit, suffixes that agree in so many bytes are neighbours in any order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    # Zero bytes and the end of the text look alike in a key: let doubling tell them apart.
    rank = np.zeros(n + 1, np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n))) + 1
    tail = np.arange(max(0, n - 8), n)
    if len(tail) and (text[tail] == 0).any():
        key = text.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n))) + 1
        depth = 1
    else:
        depth = 8
    while True:
        single = new & np.append(new[1:], True)
        left = np.flatnonzero(~single)
        if not len(left) or (limit is not None and depth >= limit):
            return order
        places = order[left]
        pair = rank[places] * (n + 1) + rank[np.minimum(places + depth, n)]
        sub = np.argsort(pair)
        places, pair = places[sub], pair[sub]
        order[left] = places
        again = np.ones(len(left), bool)
        again[1:] = pair[1:] != pair[:-1]
        new[left] = again
        heads = np.flatnonzero(again)
        rank[places] = np.repeat(left[heads], np.diff(np.append(heads, len(left)))) + 1
        depth *= 2


def agree(text: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each place equals the one at the place before it in `places`:
    eight bytes a round, of those that agreed so far."""
    n, step = len(text), min(8, window)
    words = np.zeros(max(0, n - step + 1), np.uint64)
    for k in range(step):
        words = (words << np.uint64(8)) | text[k : n - step + 1 + k]
    live = np.arange(1, len(places))
    for k in [*range(0, window - step, step), window - step]:
        live = live[words[places[live] + k] == words[places[live - 1] + k]]
    out = np.zeros(len(places), bool)
    out[live] = True
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` with the one before it.

    Going through the text, the common prefix shrinks by one at most (Kasai).  So it is
    counted only at places whose left neighbours differ; the others continue these.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)  # the suffix that precedes, by place
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    starts = (place == 0) | (before <= 0)
    rest = np.flatnonzero(~starts)
    starts[rest] = text[rest - 1] != text[before[rest] - 1]
    # A place also starts anew where its left neighbour had nothing before it.
    starts[1:] |= before[:-1] < 0
    own = np.flatnonzero(starts & (before >= 0))
    length = np.zeros(n, np.int64)
    a, b = own.copy(), before[own]
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.zeros(n + 1, np.uint64)
    for k in range(8):
        words[:n] = (words[:n] << np.uint64(8)) | padded[k : k + n]
    live = np.arange(len(own))
    while len(live):
        i, j = a[live], b[live]
        room = n - np.maximum(i, j)
        diff = words[np.minimum(i, n)] ^ words[np.minimum(j, n)]
        # The highest set bit says which byte differs first.
        same = np.full(len(live), 8, np.int64)
        odd = diff != 0
        top = np.zeros(int(odd.sum()), np.int64)
        x = diff[odd].copy()
        for s in (32, 16, 8):
            big = x >= (np.uint64(1) << np.uint64(s))
            top[big] += s
            x[big] >>= np.uint64(s)
        same[odd] = 7 - top // 8
        same = np.minimum(same, room)
        length[own[live]] += same
        go = same == 8
        live = live[go]
        a[live] += 8
        b[live] += 8
    reach = np.where(starts, length + place, 0)
    out = np.maximum.accumulate(reach) - place
    out = np.where(before >= 0, np.maximum(out, 0), 0)
    return out[order]


def window_groups(text: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of windows in sorted order, number of the group of equal windows of each)."""
    order = suffix_array(text, window)
    order = order[valid[order]]
    return order, np.cumsum(~agree(text, order, window))


def _windows(text: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """The windows at places, as byte strings that compare like them."""
    key = np.zeros((len(places), window + 1), np.uint8)
    key[:, :window] = np.lib.stride_tricks.sliding_window_view(text, window)[places]
    key[:, window] = 1  # so that no key ends in a zero byte
    return key.view(f"S{window + 1}").reshape(-1)


def _merged(raw: np.ndarray, at: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """The smallest `least` of all equal windows, for the window at each place of raw."""
    h = RollingHash(_BYTE_VALUE[raw]).slices(at, at + window)
    order = np.argsort(h)
    same = np.append(False, h[order[1:]] == h[order[:-1]])
    order = order[same | np.append(same[1:], False)]
    run = np.cumsum(~same[same | np.append(same[1:], False)])
    if not len(order):
        return least
    # Of windows with one hash all are equal, or else they are sorted by their bytes.
    odd = ~agree(raw, at[order], window) & np.append(False, run[1:] == run[:-1])
    if odd.any():
        mixed = np.isin(run, run[odd])
        others = order[mixed]
        order = np.concatenate((order[~mixed], others[np.argsort(_windows(raw, at[others], window))]))
    heads = np.flatnonzero(~agree(raw, at[order], window))
    out = least.copy()
    out[order] = np.repeat(np.minimum.reduceat(least[order], heads), np.diff(np.append(heads, len(order))))
    return out


def smallest_ids(raw: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int, shard_bytes: int = SHARD_BYTES, keys: np.ndarray | None = None) -> np.ndarray:
    """For every window of the segments (end to end in raw), the smallest id of a segment
    that has it; windows in the order of the segments.

    keys: ascending, one for each segment, such that segments with equal windows have one
    key; without them, all have.
    """
    counts = lengths - window + 1
    out = np.repeat(ids, counts)
    starts = np.cumsum(lengths) - lengths
    places = ranges(starts, counts)
    base = np.concatenate(([0], np.cumsum(counts)))
    keys = np.zeros(len(lengths), np.uint32) if keys is None else keys
    bounds = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
    sizes = np.add.reduceat(lengths, bounds[:-1]) if len(keys) else lengths
    for first, last in runs_of(sizes, shard_bytes):
        family = slice(int(bounds[first]), int(bounds[last]))
        origin = int(starts[family.start])
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in runs_of(lengths[family], shard_bytes):
            a, b = a + family.start, b + family.start
            lo, hi = int(starts[a]), int(starts[b - 1] + lengths[b - 1])
            number = np.full(hi - lo, -1, np.int64)
            number[places[base[a] : base[b]] - lo] = np.arange(base[a], base[b])
            at, group = window_groups(raw[lo:hi], number >= 0, window)
            if not len(at):
                continue
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            numbers = number[at]
            least = np.minimum.reduceat(out[numbers], heads)
            out[numbers] = np.repeat(least, np.diff(np.append(heads, len(at))))
            found.append((at[heads] + (lo - origin), least, numbers, np.diff(np.append(heads, len(at)))))
        if len(found) > 1:
            at, least = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            end = int(starts[family.stop - 1] + lengths[family.stop - 1])
            numbers, repeats = (np.concatenate([f[k] for f in found]) for k in (2, 3))
            out[numbers] = np.repeat(_merged(raw[origin:end], at, least, window), repeats)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    for batch in batches:
        sizes = np.diff(binary_column(batch.column(text_column))[1])
        for a, b in runs_of(sizes, BLOCK_BYTES):
            yield batch, a, b


def _cut(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """segments() of chunks of texts: text number, start in the text, hash, windows, start
    in raw."""
    for a, b in runs_of(np.diff(offsets), CHUNK_BYTES):
        lo = int(offsets[a])
        h, owner, start, count = segments(raw[lo : offsets[b]], offsets[a : b + 1] - lo, window, gram)
        if len(h):
            yield owner + a, start - (offsets[owner + a] - lo), h, count, start + lo


def _same(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each segment of raw, equal where the bytes are (by cryptographic
    digests of 128 bits)."""
    data = raw.tobytes()
    digests = b"".join([blake2b(data[a : a + n], digest_size=16).digest() for a, n in zip(at.tolist(), size.tolist(), strict=True)])
    return np.unique(np.frombuffer(digests, np.dtype((np.void, 16))), return_inverse=True)[1].reshape(-1)


def _ordered_groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (first, second), heads of groups of equal first, and their sizes."""
    order = np.argsort(first)
    f = first[order]
    same = f[1:] == f[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    order[tied] = order[tied][np.lexsort((second[order[tied]], f[tied]))]
    heads = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else order
    return order, heads, np.diff(np.append(heads, len(f)))


def _runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """value, begin and end of each run of equal values."""
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else ordered
    return zip(ordered[heads].tolist(), heads.tolist(), np.append(heads[1:], len(ordered)).tolist(), strict=len(heads) > 0)


def bucket_edges(buckets: int, width: int) -> np.ndarray:
    """Where buckets of hashes end, all but the last.  The smallest of `width` hashes falls
    into each bucket equally often."""
    part = np.arange(1, buckets) / buckets
    return (-np.expm1(np.log1p(-part) / width) * 2.0**64).astype(np.uint64)


def shared_segments(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """doc_id and start of segments whose hash more than one document has."""
    edges = bucket_edges(buckets, window - gram + 1)
    names = ["bucket", "hashes", "ids", "starts"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch, a, b in _blocks(batches, 1):
            raw, offsets = binary_column(batch.column(1).slice(a, b - a))
            ids = np.asarray(batch.column(0).slice(a, b - a))
            got = list(_cut(raw, offsets, window, gram))
            if not got:
                continue
            owner, start, h = (np.concatenate([g[k] for g in got]) for k in range(3))
            doc = ids[owner]
            order, heads, sizes = _ordered_groups(h, doc)
            h, doc, start = h[order], doc[order], start[order].astype(np.uint32)
            shared = doc[heads] < doc[heads + sizes - 1]
            here = np.repeat(shared, sizes)
            send = ~here
            send[heads[shared]] = True  # one entry stands for all of the block
            place = np.where(here, np.uint32(_SHARED), start)[send]
            sent, sent_doc = h[send], doc[send]
            rows = []
            for k, x, y in _runs(np.searchsorted(edges, sent, side="right")):
                steps = np.diff(sent[x:y], prepend=np.uint64(0))
                rows.append((k, squeeze(steps), squeeze(sent_doc[x:y]), squeeze(place[x:y])))
            if here.any():
                turn += 1
                rows.append((int(h[0] ^ np.uint64(turn)) % buckets, b"", squeeze(doc[here]), squeeze(start[here])))
            yield emit(rows)
            give_back()

    def meet(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        columns = [table.column(c).to_pylist() for c in names[1:]]
        for h, ids, starts in zip(*columns, strict=True):
            known = 0 if h else 3
            if h:
                parts[0].append(np.cumsum(unsqueeze(h, "<u8"), dtype=np.uint64))
            parts[known + (1 if h else 0)].append(unsqueeze(ids, "<i8"))
            parts[known + (2 if h else 1)].append(unsqueeze(starts, "<u4"))
        kinds = (np.uint64, np.int64, np.uint32, np.int64, np.uint32)
        h, doc, start, done, done_start = (np.concatenate(p or [np.zeros(0, k)]) for p, k in zip(parts, kinds, strict=True))
        order, heads, sizes = _ordered_groups(h, doc)
        doc, start = doc[order], start[order]
        if len(heads):
            shared = doc[heads] < doc[heads + sizes - 1]
            shared |= np.maximum.reduceat(start, heads) == _SHARED
            out = np.repeat(shared, sizes) & (start != _SHARED)
            doc, start = doc[out], start[out]
        return pa.table({"doc_id": np.concatenate((doc, done)), "start": np.concatenate((start, done_start)).astype(np.int64)})

    sent = docs.select("doc_id", "text").mapInArrow(runs, "bucket int, hashes binary, ids binary, starts binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, start long")


def repeated_spans(marked: DataFrame, window: int, gram: int, buckets: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, row, low and high of spans that repeat a document with a smaller id.

    marked: doc_id, row (tells rows of one doc_id apart), text and starts of its shared
    segments.  Spans may overlap.
    """
    names = ["bucket", "kind", "data", "sizes", "ids", "rows", "starts", "keys"]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
    edges = bucket_edges(buckets, window - gram + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch, a, b in _blocks(batches, 2):
            raw, offsets = binary_column(batch.column(2).slice(a, b - a))
            lists = batch.column(3).slice(a, b - a)
            if not len(lists.flatten()):
                continue
            ids, keys = (np.asarray(batch.column(k).fill_null(0).slice(a, b - a)) for k in (0, 1))
            wanted = np.asarray(lists.flatten(), np.int64) + np.repeat(offsets[:-1], np.asarray(lists.value_lengths(), np.int64))
            got = list(_cut(raw, offsets, window, gram))
            if not got:
                continue
            owner, start, h, count, at = (np.concatenate([g[k] for g in got]) for k in range(5))
            mine = np.isin(at, wanted)
            owner, start, h, count, at = (x[mine] for x in (owner, start, h, count, at))
            doc = ids[owner]
            order, heads, sizes = _ordered_groups(_same(raw, at, count + window - 1), doc)
            later = np.zeros(len(doc), bool)
            later[order] = doc[order] > np.repeat(doc[order][heads], sizes)
            size, row = count + window - 1, keys[owner]
            bucket, key = np.searchsorted(edges, h, side="right"), h >> np.uint64(32)
            rows = []
            for kind, pick in ((0, np.flatnonzero(~later)), (1, np.flatnonzero(later))):
                if kind == 0:
                    pick = pick[np.argsort(h[pick], kind="stable")]
                    groups = [(k, pick[x:y]) for k, x, y in _runs(bucket[pick])]
                else:
                    turn += 1
                    groups = [((turn * 7919 + int(ids[0] & 0xFFFF)) % buckets, pick)] if len(pick) else []
                for k, p in groups:
                    data = packed(raw[ranges(at[p], size[p])]) if kind == 0 else b""
                    steps = squeeze(np.diff(key[p], prepend=np.uint64(0)).astype(np.uint32)) if kind == 0 else b""
                    rows.append((k, kind, data, squeeze(size[p].astype(np.uint32)), squeeze(doc[p]), squeeze(row[p]), squeeze(start[p].astype(np.uint32)), steps))
            give_back()
            columns = zip(*rows, strict=True) if rows else ((),) * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def resolve(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        raw = np.frombuffer(b"".join(unpacked(x) for x in table.column("data").to_pylist() if x), np.uint8)

        def column(name: str, form: str, of: int) -> np.ndarray:
            own = [unsqueeze(x, form) for x, k in zip(table.column(name).to_pylist(), kind, strict=True) if k == of]
            return np.concatenate(own or [np.zeros(0, form)])

        forms = {"sizes": "<u4", "ids": "<i8", "rows": "<i8", "starts": "<u4"}
        size, doc, row, start = (column(c, f, 0) for c, f in forms.items())
        size, start = size.astype(np.int64), start.astype(np.int64)
        done_size, done_doc, done_row, done_start = (column(c, f, 1) for c, f in forms.items())
        out = [(done_doc, done_row, done_start.astype(np.int64), done_start.astype(np.int64) + done_size.astype(np.int64))]
        if len(size):
            at = np.cumsum(size) - size
            order, heads, n = _ordered_groups(_same(raw, at, size), doc)
            least = np.zeros(len(doc), np.int64)
            least[order] = np.repeat(doc[order][heads], n)
            later = doc > least
            out.append((doc[later], row[later], start[later], (start + size)[later]))
            # One suffix each of what is distinct; its owners are those with the smallest id.
            keys = np.concatenate([np.cumsum(unsqueeze(x, "<u4"), dtype=np.uint32) for x in table.column("keys").to_pylist() if x])
            by = np.argsort(keys[order[heads]], kind="stable")
            first = order[heads][by]
            ids = smallest_ids(raw[ranges(at[first], size[first])], size[first], doc[first], window, shard_bytes, keys[first])
            repeats = ids < np.repeat(doc[first], size[first] - window + 1)
            place, group = (np.zeros(k, np.int64) for k in (len(heads), len(doc)))
            place[by] = np.arange(len(heads))
            group[order] = np.repeat(place, n)
            owners = np.flatnonzero(~later)
            counts = size[first] - window + 1
            base = np.cumsum(counts) - counts
            hit = np.add.reduceat(repeats.astype(np.int64), base) > 0
            owners = owners[hit[group[owners]]]
            c = counts[group[owners]]
            which = repeats[ranges(base[group[owners]], c)]
            holder = np.repeat(np.arange(len(owners)), c)
            local = ranges(np.zeros(len(owners), np.int64), c)
            begin = which & np.append(True, ~which[:-1] | (holder[1:] != holder[:-1]))
            end = which & np.append(~which[1:] | (holder[1:] != holder[:-1]), True)
            o = owners[holder[begin]]
            out.append((doc[o], row[o], start[o] + local[begin], start[o] + local[end] + window))
        give_back()
        names_out = ("doc_id", "row", "low", "high")
        return pa.table({k: np.concatenate([x[i] for x in out]).astype(np.int64) for i, k in enumerate(names_out)})

    sent = marked.select("doc_id", "row", "text", "starts").mapInArrow(
        cut, "bucket int, kind int, data binary, sizes binary, ids binary, rows binary, starts binary, keys binary"
    )
    return sent.groupBy("bucket").applyInArrow(resolve, "doc_id long, row long, low long, high long")


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove each byte covered by a string of `window` bytes that also starts in a
    document with a smaller doc_id, judged on the input.

    docs needs doc_id and text; other columns are ignored.  Texts are UTF-8 bytes, null
    is empty; matches never cross documents.  Rows with one doc_id never count for each
    other.  Rows with a null doc_id stay whole and count for none.  An empty table gives
    an empty result.  Returns doc_id, n_bytes, spans (array of low and high, maximal, in
    order) and kept (the bytes that stay, end to end).
    """
    partitions = shuffle_partitions(docs.sparkSession)
    # Rows that travel are one for each block of texts and bucket, so buckets are few and alike.
    buckets = max(64, 2 * partitions)
    text = text_bytes()
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("row"))
    # 1. Exact copies.
    keyed = rows.where("doc_id is not null").select("doc_id", "row", F.xxhash64(F.lit(1), "text").alias("other"), F.octet_length("text").alias("size"))
    keyed = keyed.where(F.col("size") >= window)
    firsts = keyed.groupBy("row", "other", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # A group of copies may hold a third of all rows: each text's row meets them in SALTS places.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = keyed.join(firsts, ["row", "other", "size", "salt"]).where("doc_id > first").select("doc_id", "row", "size").distinct()
    copies = materialize(copies)
    small = copies.count() <= BROADCAST_ROWS
    held = copies.select("doc_id", "row")
    live = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window))
    live = live.join(F.broadcast(held) if small else held, ["doc_id", "row"], "left_anti")
    # 2. Segments that documents share.
    shared = shared_segments(live, window, gram, buckets).groupBy("doc_id").agg(F.collect_list(F.col("start").cast("int")).alias("starts"))
    # 3. Spans.  Texts are dealt out by doc_id once, and meet the starts here and the spans
    # below; both are left joins without filters, which would make two exchanges of one.
    dealt = rows.repartition(partitions, "doc_id")
    none = F.array().cast("array<int>")
    marked = dealt.join(shared, "doc_id", "left").select("doc_id", "row", "text", F.coalesce("starts", none).alias("starts"))
    spans = repeated_spans(marked, window, gram, buckets, shard_bytes)
    whole = copies.select("doc_id", "row", F.lit(0).cast("long").alias("low"), F.col("size").cast("long").alias("high"))
    found = F.array_sort(F.collect_list(F.struct("row", "low", "high")))
    by_doc = spans.unionByName(whole).groupBy("doc_id").agg(found.alias("found"))

    # 4. Spans meet their text.
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch, a, b in _blocks(batches, 1):
            batch = whole_batch.slice(a, b - a)
            spans_out, kept_out, sizes = [], [], []
            for raw, row, found in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data, merged, values = raw.as_py(), [], found.values
                own = np.asarray(values.field("row")) == row.as_py() if values is not None else np.zeros(0, bool)
                if own.any():
                    low, high = (np.asarray(values.field(k))[own] for k in ("low", "high"))
                    top = np.maximum.accumulate(high)
                    new = np.append(True, low[1:] > top[:-1])
                    merged = list(zip(low[new].tolist(), top[np.append(new[1:], True)].tolist(), strict=True))
                kept, at = [], 0
                for x, y in merged:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                sizes.append(len(data))
                kept_out.append(b"".join(kept))
                spans_out.append([{"low": x, "high": y} for x, y in merged])
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans_out, kind), pa.array(kept_out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])
            give_back()

    joined = dealt.join(by_doc, "doc_id", "left").select("doc_id", "text", "row", "found")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<low: long, high: long>>, kept binary")
