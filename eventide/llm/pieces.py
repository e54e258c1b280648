"""Sampled segmentations of texts into the pieces of a SentencePiece model, and back.

Of all ways to write a text in pieces, one is drawn with probability proportional to the product of its pieces' weights
to the power ``theta``. Forward filtering sums up, for each place of the lattice, the weights of all ways that lead there;
backward sampling then draws the last piece, the one before it, and so on. A piece's weight falls with its rank in the
model (1 / (rank + 1)); the model itself is never trained. Draws come from a counter-based generator seeded by the row's
key, so the same row has the same pieces on every run, in any task.

The lattice is cut into units only where no piece of the model goes across: two neighbouring characters that no piece has
side by side. So the draw is that from the lattice of the whole text. A unit of more than ``LONG`` characters is filtered
in blocks; the places before each block are kept, and going back a block is filtered again, so that memory stays bounded.
Characters that no piece has are written as byte pieces, a literal U+2581 too, so that decoding gives every text back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from .common import as_text, bounded_batches

#: Units of more characters are looked at for further cuts; still longer ones are filtered block by block.
FINER, LONG = 64, 4096
#: Characters that are filtered at once, and arcs that are remembered from text to text.
AT_ONCE, ARCS = 1 << 18, 20_000_000
SPACE = "▁"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def uniform(seeds: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each seed and counter: splitmix64."""
    x = seeds + np.atleast_1d(counters.astype(np.uint64) + np.uint64(1)) * MIX[0]
    x = (x ^ x >> np.uint64(30)) * MIX[1]
    x = (x ^ x >> np.uint64(27)) * MIX[2]
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class PieceModel:
    """Pieces by their characters (a space for the model's space sign), their log weights, and the bytes that each stands for."""

    def __init__(self, path: str, theta: float):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        weights = np.full(n, -theta * np.log(n + 1.0))
        pieces: dict[str, int] = {}
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not own.is_control(i) and not own.is_unknown(i) and not own.is_unused(i):
                text = piece.replace(SPACE, " ")
                self.bytes[i] = text.encode()
                weights[i] = -theta * np.log(1.0 - own.get_score(i) + 1.0)
                pieces[text] = i
        self.weights, self.longest = weights, max(map(len, pieces))
        side_by_side = {a + b for t in pieces for a, b in zip(t, t[1:])}
        self.inside = np.array(sorted(ord(x[0]) << 21 | ord(x[1]) for x in side_by_side), np.int64)
        #: Whether a space starts a unit wherever none is before it, and a line end is a unit.
        self.plain = not any(b == " " != a or "\n" in a + b for a, b in side_by_side)
        codes = _hashes_of(list(pieces))
        order = np.argsort(codes)
        self.hashes, self.ids = codes[order], np.array(list(pieces.values()))[order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)  # most strings are no piece: one look tells
        self.maybe[(codes * MIX[0]) >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; -1 where there is none."""
        out = np.full(len(hashes), -1)
        some = np.flatnonzero(self.maybe[(hashes * MIX[0]) >> self.shift])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        out[some] = np.where(self.hashes[at] == hashes[some], self.ids[at], -1)
        return out

    def units(self, text: str) -> list[str]:
        """``text`` cut where no piece goes across; joined, the units give it back."""
        if not self.plain:
            parts = [text]
        elif "\0" in text:
            parts = [x for i, y in enumerate(text.split("\0")) for x in (["\0"] * (i > 0) + self.units(y))]
        else:
            marked = text.replace(" ", "\0 ")
            if "  " in text:
                marked = marked.replace(" \0", " ")  # a run of spaces has pieces of its own
            parts = marked.replace("\n", "\0\n\0").split("\0")
        if len(text) > FINER and max(map(len, parts)) > FINER:
            parts = [x for p in parts for x in (self._finer(p) if len(p) > FINER else (p,))]
        return parts

    def _finer(self, part: str) -> list[str]:
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        cuts = (np.flatnonzero(~np.isin(codes[:-1] << 21 | codes[1:], self.inside)) + 1).tolist()
        return [part[a:e] for a, e in zip([0, *cuts], [*cuts, len(part)])]

    def log_weights(self, pieces: np.ndarray) -> np.ndarray:
        """Of pieces, or of characters in bytes (-1 - code point)."""
        out = self.weights[np.maximum(pieces, 0)]
        odd = np.flatnonzero(pieces < 0)
        if len(odd):
            code = -1 - pieces[odd]
            out[odd] = self.weights[self.byte_ids[0]] * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])


def _extend(hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    x = (hashes ^ (chars.astype(np.uint64) + np.uint64(1))) * MIX[1]
    return x ^ x >> np.uint64(29)


def _hashes_of(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for i in range(max(map(len, texts))):
        own = [j for j, t in enumerate(texts) if len(t) > i]
        out[own] = _extend(out[own], np.array([ord(texts[j][i]) for j in own]))
    return out


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.n, self.data = 0, np.zeros(1 << 16, kind)

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(need, 2 * len(self.data)) - self.n, self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


class Lattices:
    """Filtered lattices of distinct units: for each place, the pieces that may end there with their running probability."""

    def __init__(self, model: PieceModel, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = _Units()
        self.ends, self.starts = Grown(np.int64), Grown(np.int64)  # of each unit: its last and first place
        self.total = Grown(np.float64)  # of each unit: log of the summed weights of all its segmentations
        self.first = Grown(np.int64)  # of each place: its first arc
        self.running = Grown(np.float32)  # of each arc: probability of it and of those before that end there
        self.back = Grown(np.int32)  # of each arc: characters that it spans
        self.piece = Grown(np.int32)  # of each arc: piece, or -1 - code point of a character in bytes

    def numbers(self, units: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        new, self.units.new = self.units.new, []
        sizes = np.cumsum([len(u) for u in new])
        i = 0
        while i < len(new):
            end = max(int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + AT_ONCE, side="right")), i + 1)
            self._add(new[i:end])
            i = end
        return at

    def _arcs(self, chars: np.ndarray, left: np.ndarray, from_: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that match: first character, number of characters, piece. ``left``: characters up to the end of each one's unit.

        Only those that end after the character ``from_``.
        """
        model = self.model
        hashes, at = np.zeros(len(chars), np.uint64), np.arange(len(chars))
        froms, widths, pieces = [], [], []
        for n in range(1, model.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            hashes[at] = _extend(hashes[at], chars[at + n - 1])
            own = at[at + n > from_]
            found = model.find(hashes[own])
            if n == 1:
                found = np.where(found < 0, -1 - chars[own].astype(np.int64), found)
                hit = np.arange(len(own))
            else:
                hit = np.flatnonzero(found >= 0)
            froms.append(own[hit])
            widths.append(np.full(len(hit), n))
            pieces.append(found[hit])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, widths, pieces))

    def _add(self, new: list[str]) -> None:
        model = self.model
        lengths = np.array([len(u) for u in new], np.int64)
        chars = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(lengths) - lengths
        # a unit of n characters has n + 1 places
        start_place = np.cumsum(lengths + 1) - (lengths + 1)
        place = np.arange(len(chars)) + np.repeat(start_place - first, lengths)
        at, width, piece = self._arcs(chars, np.repeat(first + lengths, lengths) - np.arange(len(chars)))
        back = place[at]
        to = back + width
        order = np.argsort(to * (model.longest + 1) + back - to + model.longest)  # by end, the longest first
        back, to, piece = back[order], to[order], piece[order]
        log = model.log_weights(piece)
        n_places = int((lengths + 1).sum())
        alpha = np.zeros(n_places)
        depth = to - np.repeat(start_place, lengths + 1)[to]
        running = np.zeros(len(to))
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):  # forward filtering, place by place of all units at once
            own = by_depth[a:b]
            if not len(own):
                continue
            value = alpha[back[own]] + log[own]
            heads = np.flatnonzero(np.concatenate([[True], to[own][1:] != to[own][:-1]]))
            best = np.maximum.reduceat(value, heads)
            sizes = np.diff(np.append(heads, len(own)))
            share = np.exp(value - np.repeat(best, sizes))
            sums = np.add.reduceat(share, heads)
            alpha[to[own][heads]] = best + np.log(sums)
            upto = np.cumsum(share)
            running[own] = (upto - np.repeat(upto[heads] - share[heads], sizes)) / np.repeat(sums, sizes)
        last = np.append(to[1:] != to[:-1], True) if len(to) else np.zeros(0, bool)
        running[last] = 1.0
        places, arcs = self.first.n, self.running.n
        self.first.add(arcs + np.searchsorted(to, np.arange(n_places)))
        self.running.add(running)
        self.back.add(to - back)
        self.piece.add(piece)
        self.starts.add(places + start_place)
        self.ends.add(places + start_place + lengths)
        self.total.add(alpha[start_place + lengths])

    def _block(self, chars: np.ndarray, start: int, end: int, alpha: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Filter the places after ``start`` up to ``end`` of a long unit; ``alpha``: log weights of the ``longest`` places up to ``start``.

        Returns those up to ``end``, and of each place its arcs: running probability, characters, piece.
        """
        most = self.model.longest
        low = max(start - most, 0)
        own = chars[low:end]
        at, width, piece = self._arcs(own, len(own) - np.arange(len(own)), start - low)
        order = np.lexsort((at, at + width))
        at, width, piece = at[order], width[order], piece[order]
        log = self.model.log_weights(piece)
        here = np.concatenate([alpha[len(alpha) - 1 - (start - low) :], np.zeros(end - start)])
        cuts = np.searchsorted(at + width, np.arange(start - low + 1, end - low + 2))
        arcs = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), start - low + 1):
            value = here[at[a:b]] + log[a:b]
            best = value.max()
            upto = np.cumsum(np.exp(value - best))
            here[i] = best + np.log(upto[-1])
            running = (upto / upto[-1]).astype(np.float32)
            running[-1] = 1.0
            arcs.append((running, width[a:b], piece[a:b]))
        return here[-most - 1 :], arcs

    def sample_long(self, unit: str, seed: np.uint64) -> tuple[np.ndarray, float]:
        """Pieces (or characters in bytes) drawn for one long unit, and the log of their probability."""
        chars = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = range(0, len(chars), LONG)
        kept, alpha = [], np.zeros(1)
        for s in starts:
            kept.append(alpha)
            alpha, _ = self._block(chars, s, min(s + LONG, len(chars)), alpha)
        total, drawn, place, step = float(alpha[-1]), [], len(chars), 0
        for s, before in zip(reversed(starts), reversed(kept)):
            _, arcs = self._block(chars, s, min(s + LONG, len(chars)), before)
            while place > s:
                running, width, piece = arcs[place - s - 1]
                i = int(np.searchsorted(running, uniform(np.array([seed]), np.array([step]))[0], side="right"))
                drawn.append(int(piece[i]))
                place -= int(width[i])
                step += 1
        ids = np.array(drawn[::-1], np.int64)
        return ids, float(self.model.log_weights(ids).sum()) - total

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[tuple[np.ndarray, float]]:
        """For each text the ids of a drawn segmentation, and the log of its probability."""
        if len(self.units) > self.limit or self.running.n > ARCS:
            self.clear()
        counts, units = [], []
        for t in texts:
            own = self.model.units(t)
            counts.append(len(own))
            units += own
        long_units = {i: u for i, u in enumerate(units) if len(u) > LONG}
        for i in long_units:
            units[i] = ""
        at = self.numbers(units)
        counts = np.array(counts, np.int64)
        in_text = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = np.repeat(seeds, counts) + in_text.astype(np.uint64) * MIX[2]
        place, stop = self.ends.data[at], self.starts.data[at]
        n_pieces = np.zeros(len(at), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        open_ = np.flatnonzero(place > stop)
        step = 0
        while len(open_):  # backward sampling, one piece of every unit at once
            here = place[open_]
            arc, draw = self.first.data[here], uniform(seed[open_], np.uint64(step))
            late = np.flatnonzero(self.running.data[arc] <= draw)
            while len(late):  # the last arc's running probability is 1
                arc[late] += 1
                late = late[self.running.data[arc[late]] <= draw[late]]
            drawn.append((open_, arc))
            place[open_] = here - self.back.data[arc]
            n_pieces[open_] += 1
            step += 1
            open_ = open_[place[open_] > stop[open_]]
        ends = np.cumsum(n_pieces)
        arcs = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for i, (own, arc) in enumerate(drawn):
            arcs[ends[own] - 1 - i] = arc
        ids = self.piece.data[arcs].astype(np.int64)
        before = np.concatenate([[0], ends])
        logs = np.concatenate([[0.0], np.cumsum(self.model.log_weights(ids))])
        totals = np.concatenate([[0.0], np.cumsum(self.total.data[at])])
        blocked = {i: self.sample_long(u, seed[i]) for i, u in long_units.items()}
        out, first = [], 0
        for n in counts.tolist():
            last = first + n
            a, e = int(before[first]), int(before[last])
            log = float(logs[e] - logs[a] - totals[last] + totals[first])
            own = [i for i in blocked if first <= i < last] if blocked else []
            if own:
                parts, start = [], a
                for i in own:
                    parts += [ids[start : before[i]], blocked[i][0]]
                    start = int(before[i])
                    log += blocked[i][1]
                found = np.concatenate([*parts, ids[start:e]])
            else:
                found = ids[a:e]
            out.append((self._with_bytes(found), log))
            first = last
        return out

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype("<u4")
        raw = [chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass") for i in odd]
        sizes = np.ones(len(ids), np.int64)
        sizes[odd] = [len(x) for x in raw]
        out = np.repeat(ids, sizes)
        at = np.cumsum(sizes) - sizes
        value = np.frombuffer(b"".join(raw), np.uint8)
        width = sizes[odd]
        spots = np.repeat(at[odd] - (np.cumsum(width) - width), width) + np.arange(len(value))
        out[spots] = self.model.byte_ids[value]
        return out.astype("<u4")


class _Units(dict):
    """Numbers of units in the order of their first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n


_LATTICES: dict[tuple[str, float], Lattices] = {}


def _lattices(path: str, theta: float) -> Lattices:
    """One for each Python worker, kept from task to task."""
    if (path, theta) not in _LATTICES:
        _LATTICES[path, theta] = Lattices(PieceModel(path, theta))
    return _LATTICES[path, theta]


def row_seed(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id), seed)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, at most 256 of about ``AT_ONCE`` bytes (or one) at a time."""
    sizes = np.cumsum([len(x or "") for x in batch.column(1).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * AT_ONCE, side="right"))
        end = max(min(end, at + 256), at + 1)
        yield batch.slice(at, end - at)
        at = end


RESULT = "doc_id long, n_pieces long, log_probability double, ids_crc32 long, decoded string, ids binary"


def sampled_pieces(docs: DataFrame, model_path: str, theta: float = 0.3, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, log_probability, ids_crc32, decoded, ids) for every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit ids of one drawn segmentation of the whole text, ``decoded`` the text that they
    give back. Null and empty texts have no pieces and decode to an empty text. The draw depends on doc_id, ``seed`` and the
    text alone: repeated rows get equal pieces; null ids share a seed. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(model_path, theta)
        for batch in batches:
            for b in _slices(batch):
                doc_ids, texts = b.column(0).to_pylist(), as_text(b.column(1))
                found = lattices.sample(texts, np.array([row_seed(d, seed) for d in doc_ids], np.uint64))
                raw = [ids.tobytes() for ids, _ in found]
                decoded = [lattices.model.decode(ids).decode() for ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(ids) for ids, _ in found], pa.int64()), pa.array([p for _, p in found], pa.float64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(decoded, pa.string()), pa.array(raw, pa.binary())],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
