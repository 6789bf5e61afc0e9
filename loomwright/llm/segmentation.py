"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

All segmentations of a text form a lattice over its characters. Forward: each place gets the summed
weight of all ways to reach it. Backward: from the end, one incoming piece is drawn in
proportion to its share, until the start. That is an exact sample. Draws come from the row key, so
a row has the same segmentation in every run and on every worker.

No piece has a word mark inside, so the lattice falls apart at words. Forward weights are
computed once per distinct word of a chunk, and all words of the chunk are drawn side by side.
Longer words, as text without blanks has, fall apart at every place that no piece crosses: all
paths meet there, so the parts are drawn apart with the same result. What is still long is
walked alone, place by place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomwright.llm.common import mix, narrow, register, text_chunks
from loomwright.queries.base import table

MARK = 0x2581  # stands for a space in pieces
LITERAL_MARK = 0x110000  # a MARK of the text itself: no piece has it, so its bytes are used
NEWLINE = 10
SHARPNESS = 1.0
SEED = 7
CUT = 48  # words of more characters are cut where no piece crosses
SIDE_BY_SIDE = 192  # parts of more characters are walked alone

_BASE = np.uint64(0xD6E8FEB86659FD93)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The model's pieces by hash, their log weights, and the bytes each one decodes to.

    Merge ranks carry no probabilities; a piece of rank r weighs (r + 2) ** -sharpness, which
    prefers few and frequent pieces. Bytes, for characters without a piece, weigh as the last rank.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts, ids, ranks = [], [], []
        self.decoded: list[bytes] = [b""] * size
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.decoded[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                texts.append(np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64))
                ids.append(i)
                ranks.append(min(-model.get_score(i), float(size)))
                self.decoded[i] = piece.replace(chr(MARK), " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot be lossless")
        self.longest = max(map(len, texts))
        self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, _BASE)])
        starts = [np.cumsum((t + np.uint64(1)) * self.powers[: len(t)], dtype=np.uint64) for t in texts]
        hashes = np.array([s[-1] for s in starts])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids)[order]
        self.weights = -sharpness * np.log(np.array(ranks)[order] + 2)
        self.byte_weight = -sharpness * np.log(size + 2.0)
        # Coarse tests before the search: may it be a piece, may it be the start of one.
        self.present, self.starts = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.present[self.slots(self.hashes)] = True
        self.starts[self.slots(np.concatenate(starts))] = True
        self.newline_apart = not any((t == NEWLINE).any() for t in texts)

    @staticmethod
    def slots(hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where there is no such piece."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.present[slots])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == hashes[maybe], at, -1)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids of one document, without the space that encoding puts in front."""
        return b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")[1:]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(seeds: np.ndarray) -> np.ndarray:
    return (mix(seeds) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _walk(
    total: np.ndarray, target: np.ndarray, source: np.ndarray, weight: np.ndarray,
    heads: np.ndarray, ends: np.ndarray,
) -> None:
    """Forward weights of the nodes of one part, in turn; their edges lie between heads and ends."""
    low, high, start = int(heads[0]), int(ends[-1]), int(target[heads[0]]) - 1
    sources, weights = (source[low:high] - start).tolist(), weight[low:high].tolist()
    reached = [0.0]
    for a, b in zip((heads - low).tolist(), (ends - low).tolist()):
        values = [reached[sources[e]] + weights[e] for e in range(a, b)]
        if len(values) == 1:
            reached.append(values[0])
            continue
        most = max(values)
        reached.append(most + math.log(sum([math.exp(v - most) for v in values])))
    total[start:start + len(reached)] = reached


class Lattices:
    """Lattices of words laid end to end, cut into parts; node = character place + number of the part.

    Part ``first_part[w]`` and the ``parts[w]`` - 1 after it are those of word w.
    """

    def __init__(self, chars: np.ndarray, first: np.ndarray, last: np.ndarray, pieces: Pieces):
        left = np.repeat(last, last - first) - np.arange(len(chars))
        hashes = np.zeros(len(chars), np.uint64)
        at = np.arange(len(chars))
        begin, end, code, weight = [], [], [], []
        for size in range(1, pieces.longest + 1):
            at = at[left[at] >= size]
            if not len(at):
                break
            hashes[at] += (chars[at + size - 1] + np.uint64(1)) * pieces.powers[size - 1]
            slots = pieces.slots(hashes[at])
            found = pieces.find(hashes[at], slots)
            hit = found >= 0
            begin.append(at[hit])
            end.append(at[hit] + size)
            code.append(pieces.ids[found[hit]])
            weight.append(pieces.weights[found[hit]])
            if size == 1:  # characters without a piece of their own, as bytes
                none = at[~hit]
                many = 1 + sum((chars[none] >= t).astype(np.int64) for t in (0x80, 0x800, 0x10000))
                many[chars[none] == LITERAL_MARK] = 3
                begin.append(none)
                end.append(none + 1)
                code.append(-1 - chars[none].astype(np.int64))
                weight.append(many * pieces.byte_weight)
            at = at[pieces.starts[slots]]
        begin, end, code, weight = map(np.concatenate, (begin, end, code, weight))
        first, last = self._cut(first, last, begin, end)
        part = np.repeat(np.arange(len(first)), last - first)
        self.start_node = first + np.arange(len(first))
        self.end_node = last + np.arange(len(first))
        # Those that are walked alone come after all others, by node.
        alone = last - first > SIDE_BY_SIDE
        owner = part[begin]
        depth, source, target = end - first[owner], begin + owner, end + owner
        if alone.any():
            depth[alone[owner]] = SIDE_BY_SIDE + 1
        # One key instead of three: by depth, then by node; in a node by the length of the piece.
        order = np.argsort(depth * (len(chars) + len(first) + 1) + target, kind="stable")
        source, target, weight = source[order], target[order], weight[order]
        self.code, self.source = code[order], source
        total = np.zeros(len(chars) + len(first))
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        levels = np.searchsorted(
            depth[order], np.arange(1, min(int(depth.max(initial=0)), SIDE_BY_SIDE) + 2))
        groups = np.searchsorted(heads, levels)
        for a, b, g, h in zip(levels, levels[1:], groups, groups[1:]):
            here = heads[g:h] - a
            value = total[source[a:b]] + weight[a:b]
            sizes = np.diff(np.r_[here, b - a])
            most = np.maximum.reduceat(value, here)
            total[target[heads[g:h] + 0]] = most + np.log(
                np.add.reduceat(np.exp(value - np.repeat(most, sizes)), here))
        ends = np.r_[heads[1:], len(target)]
        at = np.searchsorted(heads, levels[-1])  # the first node of those walked alone
        for size in (last - first)[alone].tolist():
            _walk(total, target, source, weight, heads[at:at + size], ends[at:at + size])
            at += size
        share = np.exp(total[source] + weight - total[target])
        run = np.cumsum(share)
        self.lists: dict[int, tuple] = {}
        self.upto = run - np.repeat(run[heads] - share[heads], ends - heads)
        self.first_edge = np.zeros(len(total), np.int64)
        self.last_edge = np.zeros(len(total), np.int64)
        self.first_edge[target[heads]] = heads
        self.last_edge[target[heads]] = ends - 1

    def _cut(
        self, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the parts: long words are cut at the places that no piece crosses."""
        size = last - first
        self.first_part, self.parts = np.arange(len(first)), np.ones(len(first), np.int64)
        if not (size > CUT).any():
            return first, last
        wide = end - begin > 1
        n = int(last[-1])
        crossing = np.cumsum(
            np.bincount(begin[wide] + 1, minlength=n + 1) - np.bincount(end[wide], minlength=n + 1))[:n]
        cut = (crossing == 0) & np.repeat(size > CUT, size)
        cut[first] = True
        bounds = np.flatnonzero(cut)
        self.first_part = np.searchsorted(bounds, first)
        self.parts = np.diff(self.first_part, append=len(bounds))
        return bounds, np.r_[bounds[1:], n]

    def _draw_alone(self, part: int, key: np.uint64) -> list[int]:
        """Piece codes of one sample of one part, from its end."""
        stop, node = int(self.start_node[part]), int(self.end_node[part])
        u = _uniform(key + np.arange(node - stop, dtype=np.uint64) * _STEP).tolist()
        if part not in self.lists:  # lists, as single values of arrays are slow to reach
            low, high = self.first_edge[stop + 1], self.last_edge[node] + 1
            self.lists[part] = low, *(
                x.tolist() for x in (self.first_edge[stop:node + 1] - low, self.last_edge[stop:node + 1] - low,
                                     self.upto[low:high], self.source[low:high] - stop, self.code[low:high]))
        _, heads, tails, upto, source, code = self.lists[part]
        out, here = [], node - stop
        while here:
            edge, tail, x = heads[here], tails[here], u[len(out)]
            while edge < tail and x >= upto[edge]:
                edge += 1
            out.append(code[edge])
            here = source[edge]
        return out

    def draw(self, part: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece codes of one sample of each part in turn, and the number of pieces of each."""
        node = self.end_node[part]
        stop = self.start_node[part]
        side = node - stop <= SIDE_BY_SIDE
        active = np.flatnonzero(side)
        alone = [(i, self._draw_alone(part[i], keys[i])) for i in np.flatnonzero(~side).tolist()]
        owners, codes, step = [], [], 0
        while len(active):
            here = node[active]
            u = _uniform(keys[active] + np.uint64(step * int(_STEP) % (1 << 64)))
            edge, last_one = self.first_edge[here], self.last_edge[here]
            going = np.arange(len(edge))
            while len(going):  # a node has few incoming pieces, so walking beats a search among all
                going = going[(u[going] >= self.upto[edge[going]]) & (edge[going] < last_one[going])]
                edge[going] += 1
            owners.append(active)
            codes.append(self.code[edge])
            node[active] = self.source[edge]
            active = active[node[active] != stop[active]]
            step += 1
        counts = np.zeros(len(part), np.int64)
        for o in owners:
            counts[o] += 1
        for i, drawn in alone:
            counts[i] = len(drawn)
        last = np.cumsum(counts) - 1
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (o, c) in enumerate(zip(owners, codes)):
            out[last[o] - k] = c
        for i, drawn in alone:
            out[last[i] - len(drawn) + 1:last[i] + 1] = drawn[::-1]
        return out, counts


def _with_bytes(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids, with each byte code replaced by the ids of its character's bytes; ids per code."""
    special = np.flatnonzero(codes < 0)
    if not len(special):
        return codes, np.ones(len(codes), np.int64)
    points = -1 - codes[special]
    points[points == LITERAL_MARK] = MARK
    size = 1 + sum((points >= t).astype(np.int64) for t in (0x80, 0x800, 0x10000))
    many = np.ones(len(codes), np.int64)
    many[special] = size
    first = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.int64)
    out[first] = np.maximum(codes, 0)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])  # first bits of a character of so many bytes
    for k in range(4):  # byte k of each character that has one
        has = size > k
        bits = points[has] >> 6 * (size[has] - 1 - k)
        byte = lead[size[has]] | bits if k == 0 else 0x80 | bits & 0x3F
        out[first[special[has]] + k] = pieces.byte_ids[byte]
    return out, many


def encode_chunk(
    data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces
) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts and the number of each text's ids."""
    n = len(offsets) - 1
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    bounds = lead[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.uint64)
    chars = np.where(chars == MARK, np.uint64(LITERAL_MARK), chars)
    chars[chars == 32] = MARK
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(filled):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    chars = np.insert(chars, bounds[filled], np.uint64(MARK))
    doc_start = bounds[filled] + np.arange(len(filled))

    begins = chars == MARK
    begins[1:] &= chars[:-1] != MARK
    if pieces.newline_apart:
        begins |= chars == NEWLINE
        begins[1:] |= chars[:-1] == NEWLINE
    begins[doc_start] = True
    first = np.flatnonzero(begins)
    sizes = np.diff(first, append=len(chars))
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(sizes.max()), _BASE)])
    hashes = np.add.reduceat((chars + np.uint64(1)) * powers[place], first)
    _, example, word = np.unique(mix(hashes) ^ sizes.astype(np.uint64), return_index=True, return_inverse=True)

    long = sizes[example]
    ends = np.cumsum(long)
    starts = ends - long
    distinct = chars[np.repeat(first[example] - starts, long) + np.arange(int(long.sum()))]
    lattices = Lattices(distinct, starts, ends, pieces)

    at = np.searchsorted(first, doc_start)
    part = word
    if len(lattices.start_node) > len(starts):
        parts = lattices.parts[word]
        upto = np.r_[0, np.cumsum(parts)]
        part = np.repeat(lattices.first_part[word] - upto[:-1], parts) + np.arange(int(upto[-1]))
        at = upto[at]
    per_doc = np.diff(np.r_[at, len(part)])
    number = np.arange(len(part)) - np.repeat(at, per_doc)
    seeds = mix(np.repeat(keys[filled], per_doc) + mix(number.astype(np.uint64) + np.uint64(1)))
    codes, counts = lattices.draw(part, seeds)
    ids, many = _with_bytes(codes, pieces)
    upto = np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum(counts)]]
    out = np.zeros(n, np.int64)
    out[filled] = np.diff(upto[np.r_[at, len(part)]])
    return ids, out


ENCODED = "ids array<int>, n_pieces long, lossless boolean"


def sample_segmentations(
    docs: DataFrame,
    key: Column,
    model: str | None = None,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, ids, n_pieces and lossless of each input row.

    ``key`` seeds a row's draws: equal keys and texts give equal ids. ``lossless`` says that
    the ids decode to the text, which is checked for every row. Null or empty text: no ids.
    A null key is a key. Columns other than doc_id, text and the key are not read.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, sharpness)
        for batch, data, offsets in text_chunks(batches):
            keys = mix(batch["_key"].to_numpy().view(np.uint64) + np.uint64(seed))
            ids, counts = encode_chunk(data, offsets, keys, pieces)
            upto = np.r_[0, np.cumsum(counts)]
            same = []
            raw = data.tobytes()
            for i, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
                back = pieces.decode(ids[a:b].tolist())
                same.append(back.encode() == raw[offsets[i]:offsets[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(
                    pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))),
                 pa.array(counts), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_pieces", "lossless"],
            )

    source = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(key).alias("_key"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, " + ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with ``ids``; null or no ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, 1.0)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9(spark, sf_dir) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sample_segmentations(docs, F.col("doc_id"))


register("op9_segmentation", op9)
