"""SentencePiece encoding and decoding with seeded merge-dropout.

Encoding runs the merge agenda of a SentencePiece BPE model: symbols start as characters, adjacent pairs whose join is a
piece wait in a priority queue, the best one (highest score, then leftmost) is merged next. With dropout, each merge taken
from the agenda is skipped at the dropout rate, drawn anew for every occurrence of a unit: the draws are a hash keyed by
seed, document id and the unit's place in the text. The same seed gives the same segmentation on every machine and in
every retry; other seeds, documents and places give others. A rate of zero gives the model's own segmentation.

No piece of such models goes on past a space inside it, so the agenda of a text falls apart into those of its units (spaces
and the characters up to the next space, cut at characters that join no other) without changing the result. Draws are made as
gaps: the number of merges that go through before the next one skipped. A unit and its gaps so far fix the segmentation up to the next skip, so
results are kept per task in a bounded cache by unit and gaps; the cache saves work and has no effect on what is drawn.

Decoding joins the pieces' bytes, so it is lossless for every text: characters outside the vocabulary, and the space mark
itself where a text contains it, are spelled in byte pieces.

Defined results: a null text gives null ids and decodes to null; an empty text gives no ids; rows that repeat a doc_id are
each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Segmentations that a task keeps (some 150 MB at most, with what a call needs), those after KEPT skips or fewer; they end with the task, as idle workers hold memory.
CACHE, KEPT = 450_000, 2
SPREAD = 64
#: Characters below NEAR have a table of their pairs.
NEAR = 256
#: Gaps are drawn up to GAPS and then on; FAR is beyond any.
GAPS, GAP_BITS, FAR = 256, 9, 1 << 40
GOLD = 0x9E3779B97F4A7C15
#: Lengths that fewer than FEW units a character have are run together, if those are enough; units of LONG characters or more run one by one: the result is the same.
LONG, FEW, TOGETHER = 40, 5, 1 << 16
#: Characters of text whose new units are segmented together.
GROUP = 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(model: str) -> tuple[list[str], list[float]]:
    """Pieces and scores of a model file, read on the driver."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    size = processor.get_piece_size()
    return [processor.id_to_piece(i) for i in range(size)], [processor.get_score(i) for i in range(size)]


def load_tables(pieces: list[str], scores: list[float]) -> dict[str, np.ndarray]:
    """What the agenda reads of a vocabulary, as arrays, made once on the driver.

    A symbol is a piece (its id) or a character that stands in pieces without being one (ids from the vocabulary's size
    on); the id after those is any other character, which joins nothing. Pairs of symbols whose join is a piece are kept in
    an open-addressing table.
    """
    size = len(pieces)
    special = {i for i, p in enumerate(pieces) if i < 3 or re.fullmatch("<0x[0-9A-F]{2}>", p)}
    # units are kept with plain spaces; the space mark of a text itself never reaches them
    ids = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if i not in special}
    symbols = dict(ids)
    for c in sorted({c for p in ids for c in p} - ids.keys()):
        symbols[c] = size + len(symbols) - len(ids)
    other = size + len(symbols) - len(ids)
    of_char = np.full(0x110000, other, dtype=np.int32)
    for s, i in symbols.items():
        if len(s) == 1:
            of_char[ord(s)] = i
    pairs = {l << 32 | r: i for p, i in ids.items() for k in range(1, len(p)) if (l := symbols.get(p[:k])) is not None and (r := symbols.get(p[k:])) is not None}
    keys, joins = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
    bits = max(10, 2 + len(pairs).bit_length())
    slots, values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
    at = _slot(keys, bits)
    while len(keys):
        free = slots[at] < 0
        slots[at[free]] = keys[free]
        placed = slots[at] == keys
        values[at[placed]] = joins[placed]
        keys, joins, at = keys[~placed], joins[~placed], (at[~placed] + 1) & ((1 << bits) - 1)
    # equal scores have equal ranks, so that the leftmost goes first
    ranks = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int64)
    # the piece of a rank, where only one has it, or -1
    single = np.bincount(ranks, minlength=1) == 1
    of_rank = np.full(len(single), -1, dtype=np.int32)
    of_rank[ranks[single[ranks]]] = np.flatnonzero(single[ranks])
    # pairs of frequent characters by themselves, as few bytes stay near the processor
    near = np.full(NEAR * NEAR, -1, dtype=np.int32)
    for p, i in ids.items():
        if len(p) == 2 and max(map(ord, p)) < NEAR:
            near[ord(p[0]) * NEAR + ord(p[1])] = i
    return {"of_char": of_char, "slots": slots, "values": values, "ranks": ranks, "of_rank": of_rank, "near": near}


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(GOLD)) >> np.uint64(64 - bits)).astype(np.int64)


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


#: Of units: the number of merges after the last skip, and where in an array of little-endian int32 their ids are.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Codec:
    def __init__(self, pieces: list[str], scores: list[float], dropout: float = 0.0, seed: int = 0, tables: dict[str, np.ndarray] | None = None):
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        special = set(self.byte_ids.values()) | {0, 1, 2}
        self.ids = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if i not in special}
        self.ranks = {p: -scores[i] for p, i in self.ids.items()}
        self.size, self.tables = len(pieces), load_tables(pieces, scores) if tables is None else tables
        self.bits = len(self.tables["slots"]).bit_length() - 1
        self.spelled = [b"" if i < 3 else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]
        for byte, i in self.byte_ids.items():
            self.spelled[i] = bytes([byte])
        self.limit, self.seed = int(dropout * 2**32), seed
        # chances of a gap of k or more, as integers so that every machine draws the same
        chances = [1 << 64]
        for _ in range(GAPS):
            chances.append(chances[-1] * (2**32 - self.limit) >> 32)
        self.chances = np.array([min(c, 2**64 - 1) for c in chances[:0:-1]], dtype=np.uint64)
        # the rank of each piece with room for a start, in as few bytes as hold it; a symbol that no table has fills up short units
        places = self.tables["ranks"] * SPREAD
        self.places = places.astype(np.int32) if places.max(initial=0) + SPREAD < 1 << 31 else places
        self.never, self.fill = np.iinfo(self.places.dtype).max, int(self.tables["of_char"].max()) + 1
        self.mark_ids = np.array([self.byte_ids[b] for b in MARK.encode("utf-8")], dtype="<i4")
        self._forget()
        joiners = "".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {" "}))
        self.units = re.compile(f" *[{re.escape(joiners)}]+| +|[^ ]" if joiners else " +|[^ ]", re.S).findall

    def _keys(self, doc: object, n: int) -> np.ndarray:
        """Keys of the first `n` places of a document."""
        return _mixed(np.uint64(xxhash.xxh64_intdigest(str(doc).encode("utf-8", "surrogatepass"), self.seed)) + np.arange(n, dtype=np.uint64) * np.uint64(GOLD))

    def _key(self, doc: object, place: int) -> int:
        return int(self._keys(doc, place + 1)[place]) if self.limit else 0

    def _gaps(self, keys: np.ndarray, drawn: np.ndarray | int) -> np.ndarray:
        """The gap that each key draws after `drawn` others; GAPS stands for that and more."""
        draws = _mixed(keys + (np.atleast_1d(drawn).astype(np.uint64) + np.uint64(1)) * np.uint64(GOLD))
        return GAPS - np.searchsorted(self.chances, draws, side="right")

    def _spell(self, unit: str, bounds: list[int]) -> bytes:
        out: list[int] = []
        for a, b in zip(bounds, bounds[1:]):
            if (i := self.ids.get(unit[a:b])) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[x] for x in unit[a:b].encode("utf-8", "surrogatepass"))
        return np.array(out, dtype="<i4").tobytes()

    def _unit(self, unit: str, place: int) -> bytes:
        """A unit by itself, keyed as if it were the document."""
        return self._agenda(unit, self._key(unit, place))[1]

    def _agenda(self, unit: str, key: int, skips: int = FAR) -> tuple[int, bytes]:
        """The agenda of one unit with the first `skips` skips of its key, as a heap: for long units and for a few. Returns the merges after the last skip, and the ids as little-endian int32."""
        n, rank = len(unit), self.ranks.get
        # a symbol is the span from a start to stop[start]; start_of[end] is the start of the symbol that ends there
        stop, start_of = list(range(1, n + 1)), list(range(-1, n))
        agenda = [(r, k, k + 2) for k in range(n - 1) if (r := rank(unit[k : k + 2])) is not None]
        heapq.heapify(agenda)
        skips, drawn, taken, keys = skips if self.limit else 0, 0, 0, np.array([key], dtype=np.uint64)
        gap = int(self._gaps(keys, 0)[0]) if skips else FAR
        while agenda:
            _, left, end = heapq.heappop(agenda)
            if not (middle := stop[left]) or middle >= n or stop[middle] != end:
                continue
            skipped = False
            while taken == gap and not skipped:
                skipped, drawn, taken = gap < GAPS, drawn + 1, 0
                gap = int(self._gaps(keys, drawn)[0]) if drawn < skips else FAR
            if skipped:
                continue
            taken += 1
            stop[left], stop[middle], start_of[end] = end, 0, left
            if left and (r := rank(unit[(first := start_of[left]) : end])) is not None:
                heapq.heappush(agenda, (r, first, end))
            if end < n and (r := rank(unit[left : (last := stop[end])])) is not None:
                heapq.heappush(agenda, (r, left, last))
        bounds = [0]
        while bounds[-1] < n:
            bounds.append(stop[bounds[-1]])
        return taken, self._spell(unit, bounds)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        slots, values = self.tables["slots"], self.tables["values"]
        keys = left.astype(np.int64) << 32 | right
        at = _slot(keys, self.bits)
        out, rest = np.full(len(keys), -1, dtype=np.int32), None
        while len(keys):
            held = slots[at]
            hit = np.flatnonzero(held == keys)
            out[hit if rest is None else rest[hit]] = values[at[hit]]
            more = np.flatnonzero((held >= 0) & (held != keys))
            rest, keys, at = more if rest is None else rest[more], keys[more], (at[more] + 1) & (len(slots) - 1)
        return out

    def _first(self, points: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The pieces that neighbouring characters make, or -1, by code points (NEAR and more for none) and symbols."""
        left, right = points[:-1].ravel(), points[1:].ravel()
        near = (left | right) < NEAR
        joined = self.tables["near"][np.where(near, left * NEAR + right, 0)]
        far = np.flatnonzero(~near)
        joined[far] = self._joined(symbol[:-1].ravel()[far], symbol[1:].ravel()[far])
        return joined

    def _candidates(self, joined: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Rank and start of the merges on the agenda; the greatest number where there is none."""
        found = np.flatnonzero(joined >= 0)
        out = np.full(len(joined), self.never, dtype=self.places.dtype)
        out[found] = self.places[joined[found]] + start[found]
        return out

    def _together(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of units of one length, by `_agendas`."""
        _, at, sizes, ids = self._agendas(units, keys)
        return [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), sizes.tolist())]

    def _agendas(self, units: list[str], keys: np.ndarray, skips: int = FAR) -> Found:
        """The agendas of units shorter than SPREAD, a merge of each at a time, with the first `skips` skips that their keys draw.

        Columns are units, shorter ones filled up with a symbol that joins none. A merge takes one row off each, so units that
        go on stay of one length; a skip takes a merge off the agenda and the next best is tried.
        """
        many, lengths = len(units), np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        n, never, fill = int(lengths.max()), self.never, self.fill
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<i4")
        if even := bool((lengths == n).all()):
            points = points.reshape(many, n).T.copy()
        else:
            whole = np.full((many, n), len(self.tables["of_char"]) - 1, dtype=np.int32)
            whole[held := np.arange(n) < lengths[:, None]] = points
            points = whole.T.copy()
        symbol = self.tables["of_char"][points]
        if not even:
            symbol[~held.T] = fill
        bound = np.repeat(np.arange(n + 1, dtype=np.int8)[:, None], many, axis=1)
        agenda = np.full((0, many), never) if n < 2 else self._candidates(self._first(points, symbol), bound[:-2].ravel()).reshape(n - 1, many)
        rows = np.arange(many)
        skips = skips if self.limit else 0
        taken, drawn = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64)
        gap = self._gaps(keys, 0) if skips else np.full(many, FAR)
        since, at, sizes, out, filled = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64), [], 0
        while len(rows):
            best = agenda.min(axis=0, initial=never)
            due = np.flatnonzero((taken == gap) & (best < never)) if skips else rows[:0]
            while len(due):
                agenda[(agenda[:, due] == best[due]).argmax(axis=0), due] = never
                best[due] = agenda[:, due].min(axis=0)
                taken[due] = 0
                drawn[due] += 1
                gap[due] = np.where(drawn[due] < skips, self._gaps(keys[due], drawn[due]), FAR)
                due = due[(gap[due] == 0) & (best[due] < never)]
            going = best < never
            if not going.all():
                ended = ~going
                last, which = symbol[:, ended].T.astype("<i4", order="C"), rows[ended]
                since[which] = taken[ended]
                sizes[which] = len(symbol) if even else (last != fill).sum(axis=1)
                at[which] = filled + np.cumsum(sizes[which]) - sizes[which]
                out.append(last.ravel() if even else last[last != fill])
                filled += len(out[-1])
                odd = np.flatnonzero(((last >= self.size) & (last != fill)).any(axis=1))
                for j, edges in zip(which[odd].tolist(), bound[:, ended][:, odd].T.tolist()):
                    out.append(np.frombuffer(self._spell(units[j], edges[: sizes[j] + 1]), "<i4"))
                    at[j], sizes[j] = filled, len(out[-1])
                    filled += len(out[-1])
                symbol, bound, agenda, rows, keys, best = symbol[:, going], bound[:, going], agenda[:, going], rows[going], keys[going], best[going]
                taken, drawn, gap = taken[going], drawn[going], gap[going]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            taken += 1
            after = np.logical_or.accumulate(agenda == best, axis=0)
            place = len(after) - after.sum(axis=0)
            joined = self.tables["of_rank"][best // SPREAD]
            if len(shared := np.flatnonzero(joined < 0)):
                joined[shared] = self._joined(symbol[place[shared], shared], symbol[place[shared] + 1, shared])
            symbol = np.where(after, symbol[1:], symbol[:-1])
            symbol[place, every] = joined
            bound = np.concatenate((bound[:1], np.where(after, bound[2:], bound[1:-1])))
            agenda = np.where(after[:-1], agenda[1:], agenda[:-1])
            for shift, j in ((-1, np.flatnonzero(place > 0)), (0, np.flatnonzero(place < len(agenda)))):
                c = place[j] + shift
                agenda[c, j] = self._candidates(self._joined(symbol[c, j], symbol[c + 1, j]), bound[c, j])
        return since, at, sizes, np.concatenate(out)

    def _segmented(self, units: list[str], keys: np.ndarray, skips: int) -> Found:
        """As `_agendas` for units of any lengths: those of one length together, and those of rare lengths together."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        frequent = np.bincount(lengths) >= FEW * np.arange(lengths.max() + 1)
        frequent[LONG:] = False
        order = np.argsort(np.where(frequent[lengths], lengths, 0), kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order] * frequent[lengths[order]])) + 1
        since, at, sizes, out, filled = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64), [], 0
        runs: list[np.ndarray] = []
        alone: list[int] = []
        for own in np.split(order, cuts):
            if not frequent[lengths[own[0]]]:
                short = own[lengths[own] < LONG]
                if len(short) < FEW * lengths[short].max(initial=1):
                    short = short[:0]
                alone += np.setdiff1d(own, short).tolist()
                own = short
            runs += [own[start : start + TOGETHER] for start in range(0, len(own), TOGETHER)]
        for own in runs:
            since[own], found, sizes[own], ids = self._agendas([units[j] for j in own.tolist()], keys[own], skips)
            at[own] = found + filled
            out.append(ids)
            filled += len(ids)
        for j in alone:
            since[j], packed = self._agenda(units[j], int(keys[j]), skips)
            out.append(np.frombuffer(packed, "<i4"))
            at[j], sizes[j] = filled, len(out[-1])
            filled += len(out[-1])
        return since, at, sizes, np.concatenate(out)

    def _forget(self) -> None:
        """Empty the cache. Its nodes are segmentations: a unit's own, and by a node and a gap the one with a skip more. Node 0 is the space mark."""
        self.roots: dict[str, int] = {MARK: 0}
        self.skipped: dict[int, int] = {}
        self.many = self.filled = 0
        self.since, self.at, self.sizes, self.flat = (np.zeros(1 << 12, dtype=kind) for kind in (np.int32, np.int64, np.int32, "<i4"))
        self._add(np.zeros(1), np.zeros(1), np.full(1, len(self.mark_ids)), self.mark_ids)

    def _add(self, since: np.ndarray, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> int:
        """New nodes; the number of the first."""
        first, base = self.many, self.filled
        self.many, self.filled = first + len(since), base + len(ids)
        if self.many > len(self.since):
            self.since, self.at, self.sizes = (np.concatenate((x[:first], np.zeros(self.many, dtype=x.dtype))) for x in (self.since, self.at, self.sizes))
        if self.filled > len(self.flat):
            self.flat = np.concatenate((self.flat[:base], np.zeros(self.filled, dtype="<i4")))
        self.since[first : self.many], self.at[first : self.many], self.sizes[first : self.many], self.flat[base : self.filled] = since, at + base, sizes, ids
        return first

    def _nodes(self, units: list[str], keys: np.ndarray) -> np.ndarray:
        """The node of each unit, with the skips that its key draws; those after the number of nodes kept are for this call alone."""
        if self.many > CACHE:
            self._forget()
        nodes = np.fromiter(map(self.roots.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        new = np.flatnonzero(nodes < 0)
        met = [units[i] for i in new.tolist()]
        fresh = {unit: i for unit, i in dict(zip(met, new.tolist())).items() if len(unit) < LONG}
        if fresh:
            first = self._add(*self._segmented(list(fresh), keys[list(fresh.values())], 0))
            self.roots.update(zip(fresh, range(first, self.many)))
            nodes[new] = np.fromiter(map(self.roots.get, met, repeat(-1)), dtype=np.int64, count=len(met))
        # a long unit has too many gaps to be met again with the same ones: every occurrence runs its own agenda
        own = np.flatnonzero(nodes < 0)
        nodes[own] = 0
        if self.limit:
            gaps = self._gaps(keys, 0)
            open_ = np.flatnonzero(gaps < self.since[nodes])
            for skips in range(1, KEPT + 1):
                names = nodes[open_] << GAP_BITS | gaps[open_]
                found = np.fromiter(map(self.skipped.get, names.tolist(), repeat(-1)), dtype=np.int64, count=len(names))
                new = np.flatnonzero(found < 0)
                if len(new):
                    some, where, which = np.unique(names[new], return_index=True, return_inverse=True)
                    places = open_[new[where]]
                    first = self._add(*self._segmented([units[i] for i in places.tolist()], keys[places], skips))
                    self.skipped.update(zip(some.tolist(), range(first, self.many)))
                    found[new] = first + which
                nodes[open_] = found
                gaps[open_] = self._gaps(keys[open_], skips)
                open_ = open_[gaps[open_] < self.since[found]]
            own = np.concatenate((own, open_))
        self.kept = self.many, self.filled
        if len(own):
            first = self._add(*self._segmented([units[i] for i in own.tolist()], keys[own], FAR))
            nodes[own] = np.arange(first, self.many)
        return nodes

    def _spelled_out(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, one after the other, and where each ends."""
        nodes = self._nodes(units, keys)
        sizes = self.sizes[nodes].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[nodes] - ends + sizes, sizes) + np.arange(ends[-1])]
        self.many, self.filled = self.kept
        return ids, ends

    def _pieces(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of each unit, with the skips that its key draws."""
        ids, ends = self._spelled_out(units, keys)
        return [part.tobytes() for part in np.split(ids, ends[:-1])]

    def encode_many(self, texts: list[str | None], docs: list) -> list[np.ndarray | None]:
        """The ids of each text; null for null."""
        units: list[str] = []
        keys: list[np.ndarray] = []
        cut: list[int] = [0]
        for text, doc in zip(texts, docs):
            # the model's own leading space goes before the text, and only there; a space mark has no place among the units
            marks = []
            for k, part in enumerate(text.split(MARK) if text else []):
                if k:
                    marks.append(len(units) - cut[-1] - len(marks))
                    units.append(MARK)
                units += self.units(part if k else " " + part)
            cut.append(len(units))
            n = cut[-1] - cut[-2]
            keys.append(np.insert(self._keys(doc, n - len(marks)), marks, 0) if self.limit else np.zeros(n, dtype=np.uint64))
        ids, ends = self._spelled_out(units, np.concatenate(keys)) if units else (np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64))
        edges = np.concatenate(([0], ends))[cut].tolist()
        return [None if text is None else ids[a:b] for text, a, b in zip(texts, edges, edges[1:])]

    def encode(self, text: str, doc: object = 0) -> list[int]:
        return self.encode_many([text or ""], [doc])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "surrogatepass") if len(ids) else ""


def _groups(batch: pa.RecordBatch, key: int, at: int) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Slices of a batch of some GROUP characters, with their ids and texts."""
    start, size, keys, texts = 0, 0, [], []
    for k in range(batch.num_rows):
        keys.append(batch.column(key)[k].as_py())
        texts.append(batch.column(at)[k].as_py())
        size += len(texts[-1] or "")
        if size >= GROUP or k + 1 == batch.num_rows:
            yield batch.slice(start, len(texts)), keys, texts
            start, size, keys, texts = k + 1, 0, [], []


def _codec(docs: DataFrame, model: str | None, dropout: float, seed: int):
    pieces, scores = load_pieces(model or default_model())
    shared = docs.sparkSession.sparkContext.broadcast((pieces, scores, load_tables(pieces, scores)))  # the vocabulary: fixed size
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            pieces, scores, tables = shared.value
            made.append(Codec(pieces, scores, dropout, seed, tables))
        return made[0]

    return codec


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", model: str | None = None, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """`docs` with `out_col`, the ids of the text's pieces (array<int>). A column of that name is replaced."""
    codec = _codec(docs, model, dropout, seed)
    kept = docs.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    names = [*kept.columns, out_col]
    at, key = names.index(text_col), names.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for part, keys, texts in _groups(batch, key, at):
                ids = pa.array(own.encode_many(texts, keys), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=names)

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """`rows` with `out_col`, the text that the ids spell."""
    codec = _codec(rows, model, 0.0, 0)
    kept = rows.drop(out_col)
    names = [*kept.columns, out_col]
    at = names.index(ids_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = pa.array([None if x.as_py() is None else own.decode(x.as_py()) for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return kept.mapInArrow(run, schema)


def tokens_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (ids as little-endian int32), decoded_sha256, round_trip: encoded and decoded in one pass."""
    codec = _codec(docs, model, dropout, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            rows = []
            for _, keys, texts in _groups(batch, 0, 1):
                for key, text, ids in zip(keys, texts, own.encode_many(texts, keys)):
                    if text is None:
                        rows.append((key, None, None, None, None, None))
                        continue
                    back = own.decode(ids.tolist())
                    rows.append((key, len(ids), int(((ids >= 3) & (ids < 259)).sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
