"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces of a ``.model`` file and their scores, taken as log scores, form a double-array trie over
bytes. A text gets a blank in front, blanks are the marker U+2581, and the segmentation with the
highest sum of scores is taken (equal sums: the last piece is the longest). A character that is no
piece itself costs the lowest score less 10 and is written as its bytes' pieces. Decoding joins the
pieces, turns markers into blanks and drops the blank in front, so every text comes back exactly; a
literal U+2581 in a text is written as bytes, to tell it from a blank. Text is not normalised.

No piece of such vocabularies has a marker after another character, and characters without a piece
stand alone, so the best path splits there: a block of texts is cut into these segments, and the
Viterbi search runs over its distinct segments side by side, place by place. A vocabulary with
markers inside pieces is searched text by text instead. Tasks share nothing and there is no shuffle.

Rows: a null or empty text has no pieces and decodes to an empty text. Repeated rows are each
encoded. A file without byte pieces is refused.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Rolling, blocks

MARKER = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
LONG = 64


@dataclasses.dataclass(frozen=True)
class Pieces:
    """What is sent to the tasks: piece bytes (marker as blank) with ids and scores, and byte ids."""

    texts: tuple[bytes, ...]  # by id; empty for control pieces
    ids: tuple[int, ...]  # ids of the pieces that the search may use
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def load(model: str = MODEL) -> Pieces:
    """Read the pieces of a model file, on the driver."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=model)
    texts, ids, scores, byte_ids = [], [], [], {}
    for i in range(file.get_piece_size()):
        piece = file.id_to_piece(i)
        if file.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif file.is_control(i) or file.is_unknown(i) or file.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(MARKER, " ").encode())
            ids.append(i)
            scores.append(file.get_score(i))
    if len(byte_ids) < 256:
        raise ValueError("the model has no byte pieces")
    return Pieces(tuple(texts), tuple(ids), tuple(scores), tuple(byte_ids[b] for b in range(256)))


class Trie:
    """Double array: the child of state s by byte c is base[s] + c, if check there is s."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = k
        used = bytearray(len(children) + 2048)
        used[0] = 1
        states = [(0, 0)]
        base, parent = {}, {}
        free = spot = 257  # first free place; where places for several children are looked for
        for node, state in states:
            kids = sorted(children[node])
            if not kids:
                continue
            while used[free]:
                free += 1
            at = max((free if len(kids) == 1 else max(free, spot)) - kids[0], 1)
            tries = 0
            while any(used[at + c] for c in kids):
                at += 1
                tries += 1
                if at + 512 > len(used):
                    used.extend(bytes(len(used)))
            if tries > 64 and len(kids) > 1:
                spot = at + kids[0]
            base[state] = at
            for c in kids:
                used[at + c] = 1
                parent[at + c] = state
                states.append((children[node][c], at + c))
            if free + 512 > len(used) or at + 768 > len(used):
                used.extend(bytes(len(used)))
        top = max(base.values(), default=0) + 256
        self.base, self.check, self.value = np.zeros(top, np.int32), np.full(top, -1, np.int32), np.full(top, -1, np.int32)
        self.base[list(base)] = list(base.values())
        self.check[list(parent)] = list(parent.values())
        for node, state in states:
            self.value[state] = value[node]


class Encoder:
    def __init__(self, pieces: Pieces):
        usable = [pieces.texts[i] for i in pieces.ids]
        self.trie = Trie(usable)
        self.scores = np.array(pieces.scores)
        self.ids = np.array(pieces.ids, np.int32)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.byte_ids = np.array(pieces.byte_ids, np.int32)
        self.splits = not any(re.search(rb"[^ ] ", p) for p in usable)
        inside = set(b"".join(usable))
        self.alone = np.array([c < 128 and c not in inside for c in range(256)])
        self.flat = np.frombuffer(b"".join(pieces.texts), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in pieces.texts])])

    # -- segments ---------------------------------------------------------------------------

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, offsets of the rows)."""
        sizes = np.diff(offsets)
        some = (sizes > 0).astype(np.int64)
        at = np.arange(len(data)) + np.repeat(np.cumsum(some), sizes)
        text = np.full(len(data) + int(some.sum()), 32, np.uint8)
        text[at] = data
        rows = offsets + np.concatenate([[0], np.cumsum(some)])
        cut = np.zeros(len(text) + 1, bool)
        cut[rows] = True
        if self.splits:
            blank = text == 32
            cut[1:-1] |= blank[1:] & ~blank[:-1]
            alone = self.alone[text]
            cut[:-1] |= alone
            cut[1:] |= alone
        starts = np.flatnonzero(cut[:-1])
        ends = np.flatnonzero(cut[1:]) + 1
        hashes = Rolling(text).at(starts, ends)
        _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
        ids, bounds = self.search(text, starts[pick], ends[pick])
        size = np.diff(bounds)[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(bounds[which], size) + np.arange(upto[-1]) - np.repeat(upto[:-1], size)
        return ids[flat], upto[np.searchsorted(starts, rows)]

    def search(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment text[start:end], one after another, and their offsets."""
        length = ends - starts
        segment, place, piece = [], [], []
        order = np.argsort(length, kind="stable")
        low = 0
        for limit in (4, 8, 12, 16, 24, 32, LONG):
            high = int(np.searchsorted(length[order], limit, "right"))
            if high > low:
                some = order[low:high]
                s, p, k = self._side_by_side(text, starts[some], length[some])
                segment.append(some[s]), place.append(p), piece.append(k)
            low = high
        for i in order[low:].tolist():
            p, k = self._one(text[starts[i] : ends[i]].tobytes())
            segment.append(np.full(len(p), i)), place.append(p), piece.append(k)
        segment, place, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (segment, place, piece))
        order = np.lexsort((place, segment))
        segment, piece, place = segment[order], piece[order], place[order]
        ids = np.where(piece >= 0, self.ids[piece], self.byte_ids[text[starts[segment] + place]])
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=len(starts)))])

    def _side_by_side(self, text: np.ndarray, starts: np.ndarray, length: np.ndarray):
        """Viterbi over many short segments: (segment, place, piece or -1 for a byte)."""
        n, width = len(starts), int(length.max())
        place = np.arange(width)
        m = np.where(place < length[:, None], text[np.minimum(starts[:, None] + place, len(text) - 1)], 0).astype(np.int32)
        lead = (m >= 128).astype(np.int8) + (m >= 192) + (m >= 224) + (m >= 240)  # 0 ASCII, 1 inside, 2-4 first of so many
        chars = np.where(lead < 2, 1, lead).astype(np.int64)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int16)
        with_ = np.full((n, width + 1), -1, np.int32)
        trie = self.trie
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (length > i))
            if not len(rows):
                continue
            base, end = best[:, i], chars[:, i]
            single = np.zeros(n, bool)
            live, state, j = rows, np.zeros(len(rows), np.int32), i
            while len(live):
                child = trie.base[state] + m[live, j]
                good = (trie.check[child] == state) & (trie.base[state] > 0)
                live, state = live[good], child[good]
                j += 1
                value = trie.value[state]
                hit = value >= 0
                r, v = live[hit], value[hit]
                single[r[end[r] == j - i]] = True
                total = base[r] + self.scores[v]
                better = total > best[r, j]
                r, v = r[better], v[better]
                best[r, j], back[r, j], with_[r, j] = total[better], i, v
                more = length[live] > j
                live, state = live[more], state[more]
            r = rows[~single[rows]]
            to = np.minimum(i + end[r], length[r])
            total = base[r] + self.unknown
            better = total > best[r, to]
            r, to = r[better], to[better]
            best[r, to], back[r, to], with_[r, to] = total[better], i, -1
        segment, where, piece = [], [], []
        rows, at = np.arange(n), length.astype(np.int64)
        while len(rows):
            start, v = back[rows, at].astype(np.int64), with_[rows, at]
            known = v >= 0
            segment.append(rows[known]), where.append(start[known]), piece.append(v[known])
            size = (at - start)[~known]
            each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            segment.append(np.repeat(rows[~known], size)), where.append(np.repeat(start[~known], size) + each)
            piece.append(np.full(len(each), -1, np.int32))
            rows, at = rows[start > 0], start[start > 0]
        return np.concatenate(segment), np.concatenate(where), np.concatenate(piece)

    def _one(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over one long segment: (place, piece or -1 for a byte)."""
        base, check, value, score = self._tables
        n = len(data)
        best, back, with_ = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            char = 1 if c < 192 else 2 if c < 224 else 3 if c < 240 else 4
            state, j, single, own = 0, i, False, best[i]
            while j < n:
                if not base[state]:
                    break
                child = base[state] + data[j]
                if check[child] != state:
                    break
                state, j = child, j + 1
                v = value[state]
                if v >= 0:
                    single = single or j - i == char
                    if own + score[v] > best[j]:
                        best[j], back[j], with_[j] = own + score[v], i, v
            if not single and own + self.unknown > best[i + char]:
                best[i + char], back[i + char], with_[i + char] = own + self.unknown, i, -1
            i += char
        places, found = [], []
        while n:
            at, v = back[n], with_[n]
            for p in range(n - 1, at - 1, -1) if v < 0 else (at,):
                places.append(p)
                found.append(v)
            n = at
        return np.array(places[::-1]), np.array(found[::-1])

    @functools.cached_property
    def _tables(self):
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, offsets) from ids and their offsets by row."""
        size = np.diff(self.first)[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.first[ids], size) + np.arange(upto[-1]) - np.repeat(upto[:-1], size)]
        bounds = upto[rows]
        full = np.diff(bounds) > 0
        kept = np.ones(len(flat), bool)
        kept[bounds[:-1][full]] = flat[bounds[:-1][full]] != 32
        sums = np.concatenate([[0], np.cumsum(kept)])
        return flat[kept], sums[bounds]


@functools.lru_cache(maxsize=1)
def encoder(pieces: Pieces) -> Encoder:
    return Encoder(pieces)


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, ids array<int>, round_trip): the ids, and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary file

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("text")):
                ids, rows = tool.encode(data, offsets)
                back, places = tool.decode(ids, rows)
                same = np.diff(places) == np.diff(offsets)
                if not (same.all() and np.array_equal(back, data)):
                    same &= [back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(places[:-1], places[1:], offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(same),
                ], ["doc_id", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``; bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = [x or [] for x in part.column("ids").to_pylist()]
                rows = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                data, places = tool.decode(np.array([i for x in lists for i in x], np.int64), rows)
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(places[:-1], places[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(apply, "doc_id long, text string")
