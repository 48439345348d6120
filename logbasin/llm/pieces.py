"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text is cut before each space that follows another character and around line ends,
where no piece of the vocabulary crosses; the chunks are independent. For each
different chunk the forward pass sums the weights of all segmentations that end at a
position. Backward sampling then draws, from the end, the piece that leads to each
position in proportion to those sums. All chunks of a batch are sampled together, in
numpy, one piece a step. A chunk's forward sums are kept while a task runs, within
``CACHE_NODES`` positions, and found again by a hash of the chunk, which then is
compared character by character. Cumulative shares are whole multiples of 2 ** -52, so that
they come out the same whichever chunks are summed together.

Weights: a piece of rank r (its place in the vocabulary) has weight
(r + 3) ** -alpha, Zipf's law with alpha as inverse temperature: a large alpha
prefers few, frequent pieces. A character without a piece goes as its UTF-8 bytes
(byte fallback), and so does the literal U+2581, which otherwise stands for a space.

Draws are a counter-based hash of the seed, the row's key and the place of the chunk
and step in the text, so a row's pieces depend on nothing else: not on batches,
partitions or reruns.

Defined results: null text: null ids, decoded to null; empty text: no ids. No
normalisation takes place, so decoding gives back every code point. Rows with equal
key and text have equal pieces. Extra columns pass through; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logbasin.llm.common import fresh_name, ship

ship(__name__)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED, FLUSH, CACHE_NODES, BLOCK, PART_BYTES = 1.0, 1, 100_000, 4_000_000, 4_000, 1 << 20
SPACE = "▁"
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def rolled(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The hash of texts that go on by one character."""
    return h * U(0x9E3779B97F4A7C15) + points.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(1)


def model_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes]:
    """What each id stands for; control and unknown pieces for nothing."""
    m, out = model_of(path), []
    for i in range(m.vocab_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else piece.replace(SPACE, " ").encode())
    return out


class Vocabulary:
    """Pieces of the model by length, for lookup by a rolling hash, and their log weights."""

    def __init__(self, model: str, alpha: float):
        m = model_of(model)
        self.pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        self.byte_ids = np.zeros(256, np.int32)
        texts: list[tuple[str, int]] = []
        for i, p in enumerate(self.pieces):
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                texts.append((p.replace(SPACE, " "), i))
        rank = np.arange(len(self.pieces), dtype=float)
        self.weight = -alpha * np.log(rank + 3)
        # A fallback character weighs as its bytes, each like a piece at the end of the vocabulary.
        self.byte_weight = float(-alpha * np.log(len(self.pieces) + 3))
        self.longest = max(len(t) for t, _ in texts)
        # For each length the hashes of all beginnings of pieces, and the piece that ends there, or -1.
        self.tables = {}
        h = np.zeros(len(texts), U)
        sizes = np.array([len(t) for t, _ in texts])
        ids = np.array([i for _, i in texts], np.int32)
        points = np.array([t for t, _ in texts]).view(np.uint32).reshape(len(texts), self.longest)
        for k in range(1, self.longest + 1):
            long = sizes >= k
            h, sizes, ids, points = h[long], sizes[long], ids[long], points[long]
            h = rolled(h, points[:, k - 1])
            known, place = np.unique(h, return_inverse=True)
            piece = np.full(len(known), -1, np.int32)
            piece[place[sizes == k]] = ids[sizes == k]
            self.tables[k] = known, piece


def longer(a: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, a.dtype)
    out[: len(a)] = a
    return out


class Lattice:
    """Forward sums of the chunks met so far: for each position the pieces that end there, with cumulative shares."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.zeros(0, U), np.zeros(0, np.int64)  # of the chunks, in order of the hash
        self.begin = self.end = np.zeros(0, np.int64)  # first and last node of a chunk, by its number
        self.nodes = 0
        self.first = np.zeros(1 << 16, np.int64)  # first edge of a node
        self.point = np.zeros(1 << 16, np.uint32)  # its character
        self.edges = 0
        self.share = np.zeros(1 << 18)  # cumulative over the edges of a node
        self.length = np.zeros(1 << 18, np.int8)
        self.piece = np.zeros(1 << 18, np.int32)  # a piece, or ~code point for a fallback

    def _room(self, nodes: int, edges: int) -> None:
        if self.nodes + nodes + 1 > len(self.first):
            n = 3 * (self.nodes + nodes + 1) // 2
            self.first, self.point = longer(self.first, n), longer(self.point, n)
        if self.edges + edges > len(self.share):
            n = 3 * (self.edges + edges) // 2
            self.share, self.length, self.piece = (longer(a, n) for a in (self.share, self.length, self.piece))

    def add(self, points: np.ndarray, sizes: np.ndarray) -> None:
        """Forward pass over new chunks, all at once: position by position over those that are long enough."""
        starts = np.cumsum(sizes) - sizes
        n = len(points)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)  # characters to the end of the chunk
        begin, piece, length, weight = [], [], [], []
        single = np.zeros(n, bool)
        alive, h = np.arange(n), np.zeros(n, U)
        for k in range(1, self.v.longest + 1):
            # Only beginnings of pieces go on.
            if k > 1:
                on = left[alive] >= k
                alive, h = alive[on], h[on]
            if not len(alive):
                break
            h = rolled(h, points[alive + (k - 1)])
            known, ids = self.v.tables[k]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            on = known[at] == h
            alive, h, found = alive[on], h[on], ids[at[on]]
            whole = found >= 0
            hit, found = alive[whole], found[whole]
            if k == 1:
                single[hit] = True
            begin.append(hit)
            piece.append(found)
            length.append(np.full(len(hit), k, np.int8))
            weight.append(self.v.weight[found])
        lost = np.flatnonzero(~single)
        n_bytes = 1 + (points[lost] > 0x7F).astype(int) + (points[lost] > 0x7FF) + (points[lost] > 0xFFFF)
        begin.append(lost)
        piece.append(~points[lost].astype(np.int32))
        length.append(np.ones(len(lost), np.int8))
        weight.append(n_bytes * self.v.byte_weight)
        begin, piece, length, weight = map(np.concatenate, (begin, piece, length, weight))
        # A node is a position behind a character; edges lie together by the node where they end.
        end = begin + length - 1
        order = np.argsort(end, kind="stable")
        begin, piece, length, weight, end = (a[order] for a in (begin, piece, length, weight, end))
        at_node = np.searchsorted(end, np.arange(n + 1))
        counts = np.diff(at_node)
        forward = np.full(n, -np.inf)
        inside = np.arange(n) - np.repeat(starts, sizes)
        initial = inside[begin] == 0
        before_edge = np.where(initial, 0, begin - 1)
        by_place = np.argsort(inside, kind="stable")
        ends = np.cumsum(np.bincount(inside))
        total = np.empty(len(weight))
        done = 0
        for upto in ends.tolist():
            node = by_place[done:upto]
            done = upto
            # The edges into these nodes, node after node.
            many = counts[node]
            offset = np.cumsum(many) - many
            e = np.repeat(at_node[node] - offset, many) + np.arange(many.sum())
            here = weight[e] + np.where(initial[e], 0.0, forward[before_edge[e]])
            top = np.maximum.reduceat(here, offset)
            scaled = np.exp(here - np.repeat(top, many))
            s = np.add.reduceat(scaled, offset)
            forward[node] = top + np.log(s)
            total[e] = scaled / np.repeat(s, many)
        running = np.cumsum(np.rint(total * 2.0**52).astype(np.int64))  # may wrap around; differences hold
        before_node = np.concatenate([[0], running])[at_node[:-1]]
        cumulative = (running - np.repeat(before_node, counts)) * 2.0**-52
        self._room(n, len(piece))
        self.first[self.nodes : self.nodes + n] = self.edges + at_node[:-1]
        self.point[self.nodes : self.nodes + n] = points
        part = slice(self.edges, self.edges + len(piece))
        self.share[part] = np.minimum(cumulative, 1.0)
        self.length[part], self.piece[part] = length, piece
        self.begin = np.concatenate([self.begin, self.nodes + starts])
        self.end = np.concatenate([self.end, self.nodes + starts + sizes - 1])
        self.nodes += n
        self.edges += len(piece)
        self.first[self.nodes] = self.edges

    def _added(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new chunks, summed a block of like length at a time."""
        numbers = np.empty(len(starts), np.int64)
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(order), BLOCK):
            block = order[i : i + BLOCK]
            n = sizes[block]
            where = np.repeat(starts[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
            numbers[block] = len(self.begin) + np.arange(len(block))
            self.add(points[where], n)
        return numbers

    def numbered(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of each chunk; the chunks follow each other without gaps."""
        if self.nodes > CACHE_NODES:
            self.clear()
        hashes, at, inverse = np.unique(chunk_hashes(points, starts, sizes), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        new = np.append(self.hashes, U(0))[place] != hashes
        new[place == len(self.hashes)] = True
        numbers = np.append(self.numbers, 0)[place]
        numbers[new] = self._added(points, starts[at[new]], sizes[at[new]])
        self.hashes = np.insert(self.hashes, place[new], hashes[new])
        self.numbers = np.insert(self.numbers, place[new], numbers[new])
        number = numbers[inverse]
        # Another chunk with the same hash is summed by itself.
        where = np.repeat(self.begin[number] - starts, sizes) + np.arange(len(points))
        differs = self.point[np.minimum(where, self.nodes - 1)] != points
        other = np.logical_or.reduceat(differs, starts) | (self.end[number] - self.begin[number] + 1 != sizes)
        if other.any():
            number[other] = self._added(points, starts[other], sizes[other])
        return number

    def sample(self, points: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all chunks in order, and how many each has. ``keys`` seed the chunks."""
        number = self.numbered(points, starts, np.diff(starts, append=len(points)))
        base, node = self.begin[number], self.end[number]
        live = np.arange(len(starts))
        steps, step = [], 0
        while len(live):
            draw = (mixed(keys[live] + U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(float) * 2.0**-53
            at, last = self.first[node], self.first[node + 1] - 1
            edge = at.copy()
            # At most ``longest`` pieces end at a position: walk to the first whose cumulative share is above the draw.
            open_ = np.flatnonzero(edge < last)
            while len(open_):
                open_ = open_[draw[open_] >= self.share[edge[open_]]]
                edge[open_] += 1
                open_ = open_[edge[open_] < last[open_]]
            steps.append((live, self.piece[edge]))
            node = node - self.length[edge]
            more = node >= base[live]
            live, node = live[more], node[more]
            step += 1
        # Steps go from a chunk's end to its start: each piece has its place from behind.
        counts = np.zeros(len(starts), np.int64)
        for live, _ in steps:
            counts[live] += 1
        ends = np.cumsum(counts)
        piece = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (live, found) in enumerate(steps):
            piece[ends[live] - 1 - step] = found
        return self._bytes(np.repeat(np.arange(len(starts)), counts), piece, len(starts))

    def _bytes(self, owner: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fallback characters as the ids of their bytes."""
        fallback = np.flatnonzero(piece < 0)
        if len(fallback):
            as_bytes = [chr(~c).encode("utf-8", "surrogatepass") for c in piece[fallback].tolist()]
            width = np.ones(len(piece), np.int64)
            width[fallback] = [len(b) for b in as_bytes]
            owner, start = np.repeat(owner, width), np.cumsum(width) - width
            out = np.repeat(piece, width)
            ids = self.v.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
            where = np.repeat(start[fallback], width[fallback]) + np.arange(len(ids)) - np.repeat(np.cumsum(width[fallback]) - width[fallback], width[fallback])
            out[where] = ids
            piece = out
        return piece.astype(np.int32), np.bincount(owner, minlength=n)


def chunk_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A chunk is a run of line ends, or spaces with the run of other characters behind them; none crosses texts."""
    space, line = points == 32, points == 10
    start = np.ones(len(points), bool)
    same = (space[1:] == space[:-1]) & (line[1:] == line[:-1])
    start[1:] = ~same & ~(space[:-1] & ~line[1:])
    start[begins[begins < len(points)]] = True
    return np.flatnonzero(start)


def chunk_hashes(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Polynomials of the characters, as differences of running sums; the odd base has an inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    powers = [np.full(len(points), b, U) for b in (base, pow(base, -1, 1 << 64))]
    up, down = (np.multiply.accumulate(p) for p in powers)
    running = np.concatenate([[U(0)], np.cumsum(mixed(points.astype(U) + U(1)) * up, dtype=U)])
    return mixed((running[starts + sizes] - running[starts]) * down[starts] + sizes.astype(U))


def sample_texts(lattice: Lattice, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray | None]:
    """Ids of each text. Chunks are sampled ``FLUSH`` at a time, across texts and within long ones."""
    points = np.frombuffer("".join([t or "" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(t or "") for t in texts)])
    starts = chunk_starts(points, begins[:-1])
    first = np.searchsorted(starts, begins)  # chunk of each text, and the end
    out, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i in range(0, len(starts), FLUSH):
        part = starts[i : i + FLUSH]
        upto = starts[i + FLUSH] if i + FLUSH < len(starts) else len(points)
        number = np.arange(i, i + len(part))
        owner = np.searchsorted(first, number, "right") - 1
        seeds = mixed(keys[owner] + mixed((number - first[owner] + 1).astype(U)))
        ids, many = lattice.sample(points[part[0] : upto], part - part[0], seeds)
        out.append(ids)
        counts.append(many)
    ids, ends = np.concatenate(out), np.cumsum(np.concatenate(counts))[first]
    return [None if t is None else ids[a:b] for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]


def parts(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold ``PART_BYTES`` and at most one row beyond it."""
    place = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def decode_ids(pieces: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Texts of lists of ids: the bytes of all pieces lie behind each other, cut where the lists end."""
    taken = pieces.take(ids.flatten())
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)]).astype(np.int64))
    cuts = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
    offsets = cuts[ends]
    valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    texts = pa.Array.from_buffers(pa.binary(), len(ids), [mask, pa.py_buffer(offsets.tobytes()), taken.buffers()[2]])
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # ids that don't come from a text
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def encode(docs: DataFrame, key: str = "doc_id", column: str = "ids", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Adds the sampled ids. The model file must lie at the same path on all executors."""
    hashed = fresh_name(docs, "row_key")
    keyed = docs.withColumn(hashed, F.xxhash64(F.lit(seed), F.col(key)))
    names = keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Vocabulary(model, alpha))
        for b in batches:
            for part in parts(b, pc.binary_length(b.column(names.index("text")))):
                texts = part.column(names.index("text")).to_pylist()
                seeds = part.column(names.index(hashed)).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                ids = sample_texts(lattice, texts, seeds)
                offsets = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
                flat = [x for x in ids if x is not None]
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()),
                    mask=pa.array([x is None for x in ids]),
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*names[:-1], column])

    fields = [*docs.schema.fields, StructField(column, ArrayType(IntegerType()))]
    return keyed.mapInArrow(run, StructType(fields))


def decode(encoded: DataFrame, column: str = "ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text that ids stand for."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(piece_bytes(model), pa.binary())
        for b in batches:
            for part in parts(b, pc.multiply(pc.list_value_length(b.column(names.index(column))), 4)):
                yield pa.RecordBatch.from_arrays([*part.columns, decode_ids(pieces, part.column(names.index(column)))], [*names, to])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(to, StringType())]))
