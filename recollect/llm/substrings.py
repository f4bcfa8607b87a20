"""Repeated substrings across documents by suffix arrays and common-prefix interval trees.

A string of `length` bytes holds exactly one minimiser (its 24-byte word of least hash, leftmost on ties), and equal strings
hold equal ones. So the strings around one minimiser, a segment of at most 2 * length - 24 bytes, travel together:

1. every document sends its minimisers' hashes, packed, to a task chosen by the hash; the task answers which of them other
   documents have too. What two documents of one batch have is known there, and two of them stand for all, so a passage of a
   third of the corpus loads no task. Nothing else of a text travels for what is unique;
2. documents cut the segments of shared minimisers. Equal segments of one batch are merged before they travel: they keep
   the least document, and all later ones are repeats already. A group of thousands of copies shrinks to a few per batch;
3. a task builds, for the distinct segments around equal minimisers, a suffix array with common-prefix lengths, scans it
   with a stack for the intervals of the prefix tree of at least `length` bytes, and keeps an interval when its occurrences
   have different bytes (or an edge) on the left. Each is a maximal repeat group within its segments, with all its
   occurrences. Every string of `length` bytes that occurs twice lies, with all its occurrences, in one of them.

In a group every occurrence outside the least document is a repeat. Texts move twice in packed, narrow form and once whole,
by doc_id; documents' own exchange serves both passes.

Defined results: a null text is empty; texts shorter than `length` bytes have no repeats; a document never repeats itself;
a null doc_id neither takes part nor loses bytes; rows that repeat a doc_id should repeat its text, and each is returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import width

WORD = 24
#: Bytes handled at a time; a longer document is handled alone.
PIECE = 6 << 20
LOW = np.uint64((1 << 40) - 1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the WORD bytes from each position, by doubling: 8 bytes, then 24."""
    h = raw.astype(np.uint64)
    h = h[:-1] | (h[1:] << np.uint64(8))
    h = h[:-2] | (h[2:] << np.uint64(16))
    h = h[:-4] | (h[4:] << np.uint64(32))
    m = _mix(h * M1)
    return _mix((m[:-16] * M1 + m[8:-8]) * M2 + m[16:])


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum over each `span` neighbours."""
    step, out = 1, values
    while step * 2 <= span:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = span - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For joined texts: document index, minimiser hash, first byte and size (bytes) of each segment, relative to the document."""
    empty = tuple(np.zeros(0, dtype=d) for d in (np.int64, np.uint64, np.int64, np.int64))
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(lengths.sum())
    if total < length:
        return empty
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hashes = _word_hashes(raw)
    # the position in the low bits settles ties and is read back; the hash proper is looked up by it
    packed = (hashes & ~np.uint64(0x7FFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    at = (_least(packed, length - WORD + 1) & np.uint64(0x7FFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(at)]
    inside = np.arange(len(at)) + length <= (starts + lengths)[doc]
    change = np.ones(len(at), dtype=bool)
    change[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    if not len(first):
        return empty
    # a run ends where the next change or the first string across an edge begins
    stop = np.flatnonzero(np.append(change | ~inside, True))
    after = stop[np.searchsorted(stop, first, side="right")]
    own = doc[first]
    return own, hashes[at[first]], first - starts[own], after - first + length - 1


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list]]:
    """(doc ids, texts as bytes, third column) of bounded size."""
    ids, texts, extra, size = [], [], [], 0
    for batch in batches:
        third = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
        for key, text, other in zip(batch.column(0), batch.column(1), third):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            ids.append(key.as_py())
            texts.append(raw)
            extra.append(other.as_py() if other is not None else None)
            size += len(raw)
            if size >= PIECE:
                yield ids, texts, extra
                ids, texts, extra, size = [], [], [], 0
    if ids:
        yield ids, texts, extra


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    shape, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for num, size in shape.reshape(-1, 2).tolist():
        kind = KINDS[num]
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


KINDS = {np.dtype(k).num: np.dtype(k) for k in ("u1", "<u2", "<u4", "<i8", "<u8")}


def _planes(hashes: np.ndarray) -> np.ndarray:
    """The low five bytes of hashes in ascending order, byte by byte; the bucket stands for the rest."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :5].T).ravel()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(planes) // 5, 8), dtype=np.uint8)
    wide[:, :5] = planes.reshape(5, -1).T
    return wide.view("<u8").ravel()


def _by_bucket(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of each bucket's hashes, in order of their low bytes from the highest."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(n)
    order = np.lexsort((hashes & LOW, bucket))
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def _send_hashes(length: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in _batched(batches):
            own, hashes, _, _ = segments(texts, length)
            keys = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
            known = np.array([i is not None for i in ids], dtype=bool)[own]
            h, d = hashes[known], keys[own[known]]
            # one entry for a document and hash
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
            h, d = h[new], d[new]
            # what two documents of the batch have is shared: they are told at once, and only two of them go on to stand for the rest
            first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=bool)
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            met = np.diff(np.append(start, len(h)))[group] > 1
            ahead = ~met | (np.arange(len(h)) - start[group] < 2)
            out = []
            for b, at in _by_bucket(h[ahead], n):
                out.append((b, _entries(h[ahead][at], d[ahead][at])))
            out += [(-1 - shard, blob) for shard, blob in _by_shard(h[met], d[met], n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "blob"])

    return run


def _entries(h: np.ndarray, d: np.ndarray) -> bytes:
    """Hashes with their documents, packed."""
    uniq, place = np.unique(d, return_inverse=True)
    return _pack(_planes(h), place.astype("<u2" if len(uniq) < 65536 else "<u4"), uniq)


def _by_shard(h: np.ndarray, d: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """Entries by a shard of the document."""
    if not len(h):
        return
    shard = _shard(d, n)
    # stable: hashes ascend within a shard, so that equal ones pack well
    order = np.argsort(shard, kind="stable")
    h, d, shard = h[order], d[order], shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))).tolist()
    for x, y in zip(cuts[:-1], cuts[1:]):
        yield int(shard[x]), _entries(h[x:y], d[x:y])


def _answer(n: int):
    """The hashes of a bucket that two documents or more have, packed with their documents by a shard of the document.

    A hash that many documents have comes with two of each batch, however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])
        for batch in batches:
            known = []
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b < 0:
                    known.append((-1 - b, blob))
                else:
                    held.setdefault(b, []).append(blob)
            if known:
                yield told(known)
        for b in sorted(held):
            hashes, docs = [], []
            for blob in held.pop(b):
                planes, place, keys = _unpack(blob)
                hashes.append(_from_planes(planes))
                docs.append(keys[place])
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            # shared: some neighbour of the same hash is of another document
            same = h[1:] == h[:-1]
            differ = same & (d[1:] != d[:-1])
            group = np.concatenate(([0], np.cumsum(~same)))
            mixed = np.zeros(group[-1] + 1, dtype=bool)
            mixed[group[1:][differ]] = True
            keep = mixed[group]
            if keep.any():
                yield told(list(_by_shard(h[keep], d[keep], n)))

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of the partition's shards: its shared hashes, five bytes each."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(b, []).append(blob)
    for b in sorted(held):
        parts = [_unpack(x) for x in held.pop(b)]
        d = np.concatenate([p[2][p[1]] for p in parts])
        h = np.concatenate([p[0].reshape(5, -1).T for p in parts])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1], [True]))).tolist()
        for at in range(0, len(cuts) - 1, 4096):
            pairs = list(zip(cuts[at:], cuts[at + 1 :]))[:4096]
            yield pa.RecordBatch.from_arrays([pa.array([int(d[x]) for x, _ in pairs], pa.int64()), pa.array([h[x:y].tobytes() for x, y in pairs], pa.binary())], ["doc_id", "shared"])


def _wide(five: bytes) -> np.ndarray:
    flat = np.frombuffer(five, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(flat), 8), dtype=np.uint8)
    wide[:, :5] = flat
    return wide.view("<u8").ravel()



def _send_segments(length: int, n: int):
    """Segments of shared minimisers; bucket -1 carries repeats that are known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, shared in _batched(batches):
            own, hashes, first, size = segments(texts, length)
            cuts = np.searchsorted(own, np.arange(len(texts) + 1))
            held: dict[bytes, list[int]] = {}
            keep = []
            for i, answers in enumerate(shared):
                if ids[i] is None or not answers or cuts[i] == cuts[i + 1]:
                    continue
                wanted = np.unique(_wide(answers))
                mine = hashes[cuts[i] : cuts[i + 1]] & LOW
                at = np.searchsorted(wanted, mine)
                keep.append(cuts[i] + np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == mine))
            if not keep:
                continue
            keep = np.concatenate(keep)
            o, f, s = own[keep].tolist(), first[keep].tolist(), size[keep].tolist()
            for j in range(len(o)):
                held.setdefault(texts[o[j]][f[j] : f[j] + s[j]], []).append(j)
            gone: dict[int, list] = {}
            sent, sent_bytes = [], []
            for content, js in held.items():
                least = min(ids[o[j]] for j in js)
                for j in js:
                    if ids[o[j]] == least:
                        sent.append(j)
                        sent_bytes.append(content)
                    else:
                        gone.setdefault(ids[o[j]], []).append((f[j], f[j] + s[j]))
            out = [(-1, _pack(np.array([(k, a, b) for k, v in gone.items() for a, b in v], dtype="<i8").ravel()))] if gone else []
            pick = np.array(sent)
            h = hashes[keep[pick]]
            key, start, many = np.array([ids[x] for x in own[keep[pick]]], dtype="<i8"), first[keep[pick]], size[keep[pick]]
            for b, at in _by_bucket(h, n):
                uniq, place = np.unique(key[at], return_inverse=True)
                wide = start[at].max() >= 2**32
                out.append((b, _pack(_planes(h[at]), place.astype("<u2" if len(uniq) < 65536 else "<u4"), uniq, start[at].astype("<i8" if wide else "<u4"), many[at].astype("<u2" if length <= 4096 else "<u4"), np.frombuffer(b"".join([sent_bytes[x] for x in at.tolist()]), np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "blob"])

    return run


def interval_groups(contents: list[bytes], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups (common length, [(content, offset)]) of at least `length` bytes among distinct contents."""
    longest = max(map(len, contents))
    columns = -(-longest // 8) * 8
    raw = np.zeros(sum(map(len, contents)) + columns, dtype=np.uint8)
    raw[: len(raw) - columns] = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    many = sizes - length + 1
    which = np.repeat(np.arange(len(contents)), many)
    offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    left = sizes[which] - offset
    window = np.lib.stride_tricks.sliding_window_view(raw, columns)[base[which] + offset].copy()
    window[np.arange(columns)[None, :] >= left[:, None]] = 0
    words = window.view(">u8").astype(np.uint64)
    # the suffix array of the distinct contents, on suffixes long enough to matter
    order = np.lexsort([left, *words.T[::-1]])
    window, which, offset, left = window[order], which[order], offset[order], left[order]
    differ = window[1:] != window[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), columns)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    before = np.where(offset > 0, raw[base[which] + offset - 1].astype(np.int16), -1 - which.astype(np.int64))
    lcp = [0, *common.tolist(), 0]
    stack: list[tuple[int, int]] = []
    # the stack holds (common length, left end) of open intervals
    for i in range(1, len(lcp)):
        start = i - 1
        while stack and stack[-1][0] > lcp[i]:
            depth, start = stack.pop()
            # occurrences start..i-1; left-extension diversity makes the group maximal
            lefts = before[start:i]
            if (lefts != lefts[0]).any() or lefts[0] < 0:
                yield depth, list(zip(which[start:i].tolist(), offset[start:i].tolist()))
        if lcp[i] >= length and (not stack or stack[-1][0] < lcp[i]):
            stack.append((lcp[i], start))


def _groups(length: int, n: int):
    """Repeats of the buckets in a partition, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b < 0:
                    yield _dealt(_unpack(blob)[0].reshape(-1, 3), n)
                else:
                    held.setdefault(b, []).append(blob)
        for b in sorted(held):
            parts = [_unpack(x) for x in held.pop(b)]
            h, key = np.concatenate([_from_planes(p[0]) for p in parts]), np.concatenate([p[2][p[1]] for p in parts])
            start, many = (np.concatenate([p[k].astype(np.int64) for p in parts]) for k in (3, 4))
            text = np.concatenate([p[5] for p in parts]).tobytes()
            place = np.concatenate(([0], np.cumsum(many)[:-1]))
            order = np.argsort(h, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1], [True])))
            found: list[tuple[int, int, int]] = []
            waiting: list[dict] = []
            load = 0

            def scan() -> None:
                # minimisers differ between groups, so one suffix array serves many of them
                contents = [c for g in waiting for c in g]
                owners = [v for g in waiting for v in g.values()]
                for depth, at in interval_groups(contents, length):
                    least = min(owners[c][0] for c, _ in at)
                    for c, off in at:
                        doc, starts = owners[c]
                        if doc != least:
                            found.extend((doc, s + off, s + off + depth) for s in starts)
                waiting.clear()

            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if y - x < 2:
                    continue
                group: dict[bytes, tuple[int, list[int]]] = {}
                for j in order[x:y].tolist():
                    p, size, doc, s = int(place[j]), int(many[j]), int(key[j]), int(start[j])
                    content = text[p : p + size]
                    if (old := group.get(content)) is None:
                        group[content] = (doc, [s])
                    elif doc == old[0]:
                        old[1].append(s)
                    elif doc > old[0]:
                        found.append((doc, s, s + size))
                    else:
                        found.extend((old[0], z, z + size) for z in old[1])
                        group[content] = (doc, [s])
                if len(group) > 1:
                    waiting.append(group)
                    load += len(group)
                    if load >= 3000:
                        scan()
                        load = 0
            if waiting:
                scan()
            if found:
                yield _dealt(np.array(found, dtype=np.int64), n)

    return run


def _shard(docs: np.ndarray, n: int) -> np.ndarray:
    return ((docs.astype(np.uint64) * M1) >> np.uint64(32)) % np.uint64(n)


def _dealt(rows: np.ndarray, n: int) -> pa.RecordBatch:
    """(doc, start, end) rows packed by a shard of the document, so that their number follows tasks and not documents."""
    shard = _shard(rows[:, 0], n)
    order = np.lexsort((rows[:, 1], rows[:, 0], shard))
    rows, shard = rows[order], shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))).tolist()
    blobs = [_pack(*(np.ascontiguousarray(rows[x:y, k]) for k in range(3))) for x, y in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of the partition's shards: its spans, joined where they meet."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(b, []).append(blob)
    for b in sorted(held):
        parts = [_unpack(x) for x in held.pop(b)]
        doc, start, end = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))).tolist()
        for at in range(0, len(cuts) - 1, 4096):
            pairs = list(zip(cuts[at:], cuts[at + 1 :]))[:4096]
            yield pa.RecordBatch.from_arrays([pa.array([int(doc[x]) for x, _ in pairs], pa.int64()), pa.array([merged(start[x:y], end[x:y]).astype("<i8").tobytes() for x, y in pairs], pa.binary())], ["doc_id", "spans"])


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint (start, end) pairs that cover the given spans; touching spans are one. Starts ascend."""
    top = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > top[:-1]))
    at = np.flatnonzero(new)
    return np.stack([start[at], np.append(top[at[1:] - 1], top[-1])], axis=1)


def _dealt_key():
    """What is known at once stays spread; the rest meets by bucket."""
    return F.when(F.col("bucket") < 0, F.xxhash64("blob")).otherwise(F.col("bucket").cast("bigint"))


def repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (packed little-endian int64 pairs): bytes covered by a `length`-byte string that an earlier document has."""
    n = width(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    hashes = texts.mapInArrow(_send_hashes(length, n), "bucket int, blob binary")
    answers = hashes.repartition(n, _dealt_key()).mapInArrow(_answer(n), "shard int, blob binary")
    by_doc = answers.repartition(n, "shard").mapInArrow(_by_document, "doc_id bigint, shared binary")
    asked = texts.join(by_doc, F.col("key") == F.col("doc_id")).select("key", "body", "shared")
    cut = asked.mapInArrow(_send_segments(length, n), "bucket int, blob binary")
    dealt = cut.repartition(n, _dealt_key()).mapInArrow(_groups(length, n), "shard int, blob binary")
    return dealt.repartition(n, "shard").mapInArrow(_gather, "doc_id bigint, spans binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The one exchange of whole texts with an id; all passes use it. New names, so that all passes plan it alike."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("body")).repartition(width(docs.sparkSession), "key")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    return _removed(docs, length, id_col, text_col, digest=False)


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spans = repeats(docs, length, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, own in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, pairs = raw, np.zeros((0, 2), dtype=np.int64)
                if own.as_py():
                    pairs = np.minimum(np.frombuffer(own.as_py(), "<i8").reshape(-1, 2), len(raw))
                    edges = np.concatenate(([0], pairs.ravel(), [len(raw)])).tolist()
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key.as_py(), len(raw), len(raw) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest() if digest else kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    texts = _texts(docs, id_col, text_col)
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("spans"))
    joined = texts.join(spans, F.col("key") == F.col("doc_id"), "left").select("key", "body", "spans").unionAll(nameless)
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary"))


def substring_digest(docs: DataFrame) -> DataFrame:
    return _removed(docs, 50, "doc_id", "text", digest=True)
