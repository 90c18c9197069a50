"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation by the sum of piece scores is searched from left to right. Only a window as long as the longest
piece can still be extended, and once all surviving paths of the window agree on a boundary, the ids before it are committed. Where
no piece holds two neighbouring characters together, all paths converge for certain: a block of text is cut there, and
its distinct stretches are streamed side by side, a character of all of them in a few array operations. Both forms of the search,
for many stretches and for one, hold a window and commit on convergence, whatever a stretch's length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import blocks, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
BLANK = "▁"
PENALTY = 10.0
#: At most so many stretches are searched side by side, with so many letters; so few are better searched one by one.
LANES, CELLS, FEW = 1 << 15, 1 << 19, 8


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A model file's pieces as a trie: edges in a hash table, scores and ids at the nodes."""

    def __init__(self, model: bytes):
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.prefix = True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        normal = [s for s, k in zip(scores, self.kinds) if k == NORMAL]
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_score = min(normal) - PENALTY
        self.byte_ids = np.full(256, self.unknown, dtype=np.int32)
        self._lists(scores)

    def _lists(self, scores: list[float]) -> None:
        used = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        letters = sorted({c for i in used for c in self.names[i]})
        self.letter = np.zeros(0x110000, dtype=np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest = max(len(self.names[i]) for i in used)
        edges: dict[tuple[int, int], int] = {}
        ids, best = [-1], [-np.inf]
        together = set()
        for i in used:
            node = 0
            codes = self.letter[[ord(c) for c in self.names[i]]].tolist()
            together.update(zip(codes, codes[1:]))
            for code in codes:
                if (node, code) not in edges:
                    edges[node, code] = len(ids)
                    ids.append(-1)
                    best.append(-np.inf)
                node = edges[node, code]
            ids[node], best[node] = i, scores[i]
        self.edges = edges
        self.ids, self.scores = np.array(ids, dtype=np.int32), np.array(best)
        n = len(letters) + 1
        self.width = np.int64(n)
        self.together = np.zeros(n * n, dtype=bool)
        self.together[[a * n + b for a, b in together]] = True
        keys = np.array([a << 16 | c for a, c in edges], dtype=np.int64)
        self.mask = np.uint64((1 << 20) - 1)
        self.keys, self.next = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=np.int32)
        for key, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), edges.values()):
            while self.keys[slot] >= 0:
                slot = slot + 1 & int(self.mask)
            self.keys[slot], self.next[slot] = key, node
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.names[i][3:5], 16)] = i
        surface = [bytes([int(x[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else x.replace(BLANK, " ").encode() for x, k in zip(self.names, self.kinds)]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = np.append(0, np.cumsum([len(x) for x in surface]))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node along a letter, or 0."""
        keys = nodes.astype(np.int64) << 16 | codes
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.next[slots], 0)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = slots[left] + 1 & int(self.mask)
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.next[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def spelled(self, ids: list[tuple[int, str]]) -> list[int]:
        """Ids, with the bytes of what no piece covers."""
        return [x for i, s in ids for x in ([i] if i != self.unknown else self.byte_ids[list(s.replace(BLANK, " ").encode() if s == " " else s.encode())].tolist())]


class StreamingViterbi:
    """Search over characters that come one by one. push() and close() return what is decided: (id, characters)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # from the last committed boundary
        self.score: list[float] = [0.0]  # best of each boundary from there; a boundary out of reach has -inf
        self.back: list[tuple[int, int]] = [(0, -1)]
        self.root = [0]  # the first boundary after the committed one on the best path
        self.open: list[tuple[int, int]] = []  # start and trie node of pieces that may still grow
        self.held = 0

    def push(self, c: str) -> list[tuple[int, str]]:
        pieces, end = self.pieces, len(self.text)
        self.text += c
        code = int(pieces.letter[ord(c)])
        self.open.append((end, 0))
        best, back, grown, alone = -np.inf, (end, pieces.unknown), [], False
        for start, node in self.open:
            child = pieces.edges.get((node, code), 0) if code else 0
            if child:
                grown.append((start, child))
                if pieces.ids[child] >= 0:
                    alone |= start == end
                    if (s := self.score[start] + float(pieces.scores[child])) > best:
                        best, back = s, (start, int(pieces.ids[child]))
        if not alone and (s := self.score[end] + float(pieces.unknown_score)) > best:
            best, back = s, (end, pieces.unknown)
        self.open = grown
        self.score.append(best)
        self.back.append(back)
        self.root.append(self.root[back[0]] or end + 1)
        # Surviving paths end at this boundary or at the start of a piece that may still grow.
        ends = [end + 1, *(s for s, _ in grown)]
        roots = {self.root[x] for x in ends}
        return self._commit(ends) if len(roots) == 1 and 0 not in roots else []

    def _commit(self, ends: list[int]) -> list[tuple[int, str]]:
        """All pieces up to the last boundary that lies on every surviving path."""
        shared: set[int] | None = None
        for x in ends:
            on = {x}
            while x:
                x = self.back[x][0]
                on.add(x)
            shared = on if shared is None else shared & on
        cut = max(shared)
        out, x = [], cut
        while x:
            start, i = self.back[x]
            out.append((i, self.text[start:x]))
            x = start
        self.text = self.text[cut:]
        self.score = [s - self.score[cut] for s in self.score[cut:]]
        self.back = [(max(0, a - cut), i) for a, i in self.back[cut:]]
        self.open = [(s - cut, node) for s, node in self.open]
        self.root = [0]
        for x in range(1, len(self.score)):
            self.root.append(self.root[self.back[x][0]] or x)
        self.held = max(self.held, len(self.text))
        return out[::-1]

    def close(self) -> list[tuple[int, str]]:
        return self._commit([len(self.text)]) if self.text else []


def stream(pieces: Pieces, text: str) -> list[int]:
    """Ids of a normalised text."""
    search, out = StreamingViterbi(pieces), []
    for c in text:
        out += search.push(c)
    return pieces.spelled(out + search.close())


def normalised(text: str, prefix: bool = True) -> str:
    return (BLANK if prefix and text else "") + text.replace(" ", BLANK)


class Lanes:
    """The same search over many stretches side by side, a step of all of them being a few array operations.

    Of each lane only a window is held: boundaries since the last committed one, in a ring of slots that all lanes
    share. Pieces are committed, one in a step, when the paths to all boundaries that can still be extended agree
    on the first boundary ahead; what a lane has left at its end lies on one path. `early` counts characters committed
    before their stretch's end, `widest` the largest ring.
    """

    def __init__(self, pieces: Pieces, codes: np.ndarray, lengths: np.ndarray):
        """codes has a row of letters for each stretch, filled up with 0xFFFF, which is in no piece; lengths ascend."""
        self.pieces, self.codes, self.lengths = pieces, codes, lengths
        n = len(codes)
        self.slots = 1 << int(pieces.longest + 1).bit_length()
        self.score = np.full((self.slots, n), -np.inf)
        self.score[0] = 0
        self.back, self.ids, self.root = (np.zeros((self.slots, n), dtype=np.int32) for _ in range(3))
        self.done, self.count = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.open: list[tuple[int, np.ndarray, np.ndarray]] = []  # start of pieces that may still grow, lanes, trie nodes
        self.out: list[tuple[np.ndarray, ...]] = []
        self.early = 0
        self.widest = self.slots

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lane, first character and id of all pieces, by lane and place."""
        size = int(self.lengths.max())
        ends = np.searchsorted(self.lengths, np.arange(size + 2))  # lanes from ends[t] on have t characters or more
        for t in range(size):
            live = np.arange(ends[t + 1], len(self.lengths))
            if t + 1 - int(self.done[live[0] :].min()) >= self.slots:
                self._widen(t)
            self._advance(t, live)
            self._converge(t + 1, live)
            self._finish(t + 1, np.arange(ends[t + 1], ends[t + 2]))
        lane, number, begin, ids = (np.concatenate(x) for x in zip(*self.out))
        order = np.lexsort((number, lane))
        return lane[order], begin[order], ids[order]

    def _widen(self, last: int) -> None:
        """Twice as many slots; the boundaries up to `last` keep their values."""
        held = np.arange(max(0, last - self.slots + 1), last + 1)
        for name in ("score", "back", "ids", "root"):
            old = getattr(self, name)
            new = np.zeros((2 * self.slots, old.shape[1]), dtype=old.dtype)
            new[held % (2 * self.slots)] = old[held % self.slots]
            setattr(self, name, new)
        self.slots *= 2
        self.widest = self.slots

    def _advance(self, t: int, live: np.ndarray) -> None:
        """Reads character t: the best path to the boundary behind it. Ties go to the longer last piece."""
        pieces, slot, n = self.pieces, (t + 1) % self.slots, self.slots
        best, back, ids = self.score[slot], self.back[slot], self.ids[slot]
        best[:] = -np.inf
        alone, grown = np.zeros(len(best), dtype=bool), []
        for start, rows, nodes in [*self.open, (t, live, np.zeros(len(live), dtype=np.int32))]:
            nodes = pieces.step(nodes, self.codes[rows, t])
            keep = nodes > 0
            rows, nodes = rows[keep], nodes[keep]
            if not len(rows):
                continue
            grown.append((start, rows, nodes))
            found = pieces.ids[nodes] >= 0
            hit, node = rows[found], nodes[found]
            if start == t:
                alone[hit] = True
            value = self.score[start % n, hit] + pieces.scores[node]
            better = value > best[hit]
            hit, node = hit[better], node[better]
            best[hit], back[hit], ids[hit] = value[better], start, pieces.ids[node]
        rest = live[~alone[live]]
        value = self.score[t % n, rest] + pieces.unknown_score
        better = value > best[rest]
        rest = rest[better]
        best[rest], back[rest], ids[rest] = value[better], t, pieces.unknown
        self.open = grown
        b = back[live]
        self.root[slot, live] = np.where(b == self.done[live], t + 1, self.root[b % n, live])

    def _converge(self, end: int, live: np.ndarray) -> None:
        """Commits one piece of each lane whose surviving paths, to `end` and to where a piece is still open, share it."""
        n = self.slots
        first = self.root[end % n]
        agree = np.zeros(len(first), dtype=bool)
        agree[live] = True
        for start, rows, _ in self.open:
            agree[rows] &= (start > self.done[rows]) & (self.root[start % n, rows] == first[rows])
        who = np.flatnonzero(agree)
        if not len(who):
            return
        to = first[who].copy()
        self._emit(who, self.count[who], self.done[who], self.ids[to % n, who])
        self.early += int((to - self.done[who])[self.lengths[who] > end].sum())
        self.count[who] += 1
        self.done[who] = to
        for p in range(int(to.min()) + 1, end + 1):
            b = self.back[p % n, who]
            self.root[p % n, who] = np.where(b == to, p, self.root[b % n, who])

    def _finish(self, end: int, who: np.ndarray) -> None:
        """Commits what is left of lanes that end here."""
        place, steps = np.full(len(who), end, dtype=np.int32), []
        while len(on := np.flatnonzero(place > self.done[who])):
            slot = place[on] % self.slots
            before = self.back[slot, who[on]]
            steps.append((on, before, self.ids[slot, who[on]]))
            place[on] = before
        left = np.zeros(len(who), dtype=np.int32)
        for on, *_ in steps:
            left[on] += 1
        for on, before, ids in steps:
            left[on] -= 1
            self._emit(who[on], self.count[who[on]] + left[on], before, ids)

    def _emit(self, lane: np.ndarray, number: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> None:
        self.out.append((lane, number, begin, ids))


def encode_block(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's begin (one more at the end)."""
    whole = [normalised(t, pieces.prefix) for t in texts]
    joined = "".join(whole)
    bounds = np.append(0, np.cumsum([len(t) for t in whole]))
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    codes = pieces.letter[points]
    cut = np.ones(len(points), dtype=bool)
    cut[1:] = ~pieces.together[codes[:-1].astype(np.int64) * pieces.width + codes[1:]]
    cut[bounds[:-1][bounds[:-1] < len(points)]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(points)))
    inside = np.arange(len(points)) - np.repeat(start, size)
    value = mix(points.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inside]
    _, first, which = np.unique(mix(np.add.reduceat(value, start) + size.astype(np.uint64)), return_index=True, return_inverse=True)
    del inside, value
    n_ids = np.zeros(len(first), dtype=np.int64)
    order = np.argsort(size[first], kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []  # stretches and their ids, in order of place
    at = 0
    while at < len(order):
        # So many side by side that their letters, filled up to the longest, stay below a bound.
        ahead = size[first[order[at : at + LANES]]]
        lanes = order[at : at + max(1, int(((np.arange(len(ahead)) + 1) * ahead <= CELLS).sum()))]
        at += len(lanes)
        lengths, begin = size[first[lanes]], start[first[lanes]]
        if len(lanes) <= FEW:
            parts = [np.array(stream(pieces, joined[a : a + n]), dtype=np.int32) for a, n in zip(begin.tolist(), lengths.tolist())]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        else:
            grid = np.arange(int(lengths.max()))
            block = np.where(grid < lengths[:, None], codes[np.minimum(begin[:, None] + grid, len(codes) - 1)], np.uint16(0xFFFF))
            lane, place, ids = Lanes(pieces, block, lengths).run()
            ids, times = _with_bytes(pieces, ids, points[begin[lane] + place])
            counts = np.bincount(lane, weights=times, minlength=len(lanes)).astype(np.int64)
        n_ids[lanes] = counts
        found.append((lanes, ids))
    base = np.append(0, np.cumsum(n_ids))
    table = np.zeros(int(base[-1]), dtype=np.int32)
    for lanes, ids in found:
        count = n_ids[lanes]
        table[np.repeat(base[lanes] - np.cumsum(count) + count, count) + np.arange(len(ids))] = ids
    count = n_ids[which]
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out = table[np.repeat(base[which], count) + inside]
    at = np.append(0, np.cumsum(count))[np.searchsorted(start, bounds)]
    return out, at


def _with_bytes(pieces: Pieces, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, those of characters that no piece covers replaced by their bytes' ids; how many each has become."""
    times = np.ones(len(ids), dtype=np.int64)
    unknown = np.flatnonzero(ids == pieces.unknown)
    raw = [chr(c).encode() for c in points[unknown].tolist()]
    times[unknown] = [len(x) for x in raw]
    out = np.repeat(ids, times)
    place = (np.cumsum(times) - times)[unknown]
    for a, x in zip(place.tolist(), raw):
        out[a : a + len(x)] = pieces.byte_ids[list(x)]
    return out, times


def decode_block(pieces: Pieces, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after another, and where each begins (one more at the end)."""
    size = np.diff(pieces.surface_at)[ids]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data = pieces.surface[np.repeat(pieces.surface_at[ids], size) + inside]
    bounds = np.append(0, np.cumsum(size))[at]
    if not pieces.prefix:
        return data, bounds
    first = bounds[:-1][np.diff(bounds) > 0]
    first = first[data[first] == 32]
    keep = np.ones(len(data), dtype=bool)
    keep[first] = False
    return data[keep], bounds - np.searchsorted(first, bounds, side="left")


def encode_exactly(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As encode_block, with whether each text decodes to itself. One that doesn't is streamed once more, as stretches
    are told apart by a hash; it then differs only if it holds U+2581, which stands for a blank.
    """
    ids, at = encode_block(pieces, texts)
    same = _same(pieces, ids, at, texts)
    if not same.all():
        parts = [np.array(stream(pieces, normalised(t, pieces.prefix)), dtype=np.int32) if not ok and BLANK not in t else ids[a:b] for t, ok, a, b in zip(texts, same, at, at[1:])]
        ids, at = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        same = _same(pieces, ids, at, texts)
    return ids, at, same


def _same(pieces: Pieces, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> np.ndarray:
    data, bounds = decode_block(pieces, ids, at)
    raw = data.tobytes()
    return np.array([raw[a:b] == t.encode() for t, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist())], dtype=bool)


_held: dict[int, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One table for each Python worker."""
    key = hash(model)
    if key not in _held:
        _held[key] = Pieces(model)
    return _held[key]


def read_model(path: str = MODEL) -> bytes:
    """The driver reads the file (some hundred kB) and sends it along; executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def free_name(taken: list[str], name: str) -> str:
    """The name, or with underscores before it if a column has it (in any case) already."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of docs, and ids (the pieces of text), n_ids, round_trip (whether they decode to the text).

    A blank is put before each text, as the model asks, and taken away again when decoding; an empty or null text has no
    ids. Characters that no piece has become byte pieces. Ties go to the longer last piece. A text of any length goes
    through a window of bounded size; it is in memory as one value, like its ids. If docs has columns of these
    names, the new ones get underscores before; all others, null ids among them, are kept. Each row, repeated ones too, gives a row; an empty table
    gives an empty one.
    """
    data = read_model(model)
    ids, n_ids, trip = (free_name(docs.columns, x) for x in ("ids", "n_ids", "round_trip"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(data)
        for block in blocks(batches):
            found, at, same = encode_exactly(pieces, [t or "" for t in block.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.columns, lists, pa.array(np.diff(at)), pa.array(same)], names=[*block.schema.names, ids, n_ids, trip])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"{fields}, `{ids}` array<int>, `{n_ids}` long, `{trip}` boolean")


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """doc_id, text of rows with doc_id and a list of ids; null lists give empty texts, bytes that are no UTF-8 become U+FFFD."""
    data = read_model(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(data)
        for batch in batches:
            column = batch.column("ids")
            at = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            raw, bounds = decode_block(pieces, column.flatten().to_numpy(zero_copy_only=False), at)
            texts = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(each, "doc_id long, text string")
