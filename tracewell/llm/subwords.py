"""SentencePiece vocabularies: best segmentation by a max-plus scan, and back to text.

A text's ids are its segmentation with the highest sum of piece scores (the Viterbi path); scores
are those of the vocabulary file, and a fixed small weight per piece parts nearly all ties.
Characters that no piece has are written as byte pieces, so decoding gives every text back exactly.

Texts up to twice the chunk length are one chunk. Longer ones are cut into chunks anywhere:

1. each chunk gives a transfer matrix: the best score from every state at its left border to every
   state at its right border, a state being how far a piece reaches over the border;
2. matrices of up to FANOUT neighbours are multiplied (in max-plus, an associative product), and
   those of up to FANOUT such blocks again, until one is left per text;
3. downwards, every block's two border states fix those of its parts;
4. every chunk, its borders known, is segmented on its own.

Steps 1 and 4 spread over all tasks; steps 2 and 3 move matrices of a fixed size, and no group has
more than FANOUT of them, however long a text is.

Defined results: null and empty texts have no ids and one row; repeated rows give repeated
rows; where the same pieces score the same in another order, as in a row of equal signs, a text
without chunks takes the shortest pieces last, and borders of chunks take the nearest piece
border; a text's own U+2581 is written as bytes and comes back as it was. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.memory import IdMemory
from tracewell.llm.text import pieces, remembered, strings, tidy
from tracewell.session import cut_lineage

CHUNK = 16_384
FANOUT = 64
#: weights are score * SCALE + a fixed number below SCALE / 4 per piece
SCALE = 4096
NEVER = -(1 << 60)


class Vocabulary:
    """Pieces as plain text (blanks for U+2581) with weights, and the pieces of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [-1] * 256
        #: weights of pieces, NEVER for what only begins a piece
        self.weight: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        found: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.bytes_of[i] = text.encode()
                found.append((text, i, model.get_score(i)))
        for text, i, score in found:
            self.weight[text] = round(score * SCALE) + (i * 2654435761 >> 7) % (SCALE // 4)
            self.ids[text] = i
        self.unknown = round((min(s for _, _, s in found if s > -1e6) - 10) * SCALE)
        self.longest = max(len(text) for text, _, _ in found)
        for text, _, _ in found:  # what pieces begin with: a search ends where nothing goes on
            for k in range(1, len(text)):
                self.weight.setdefault(text[:k], NEVER)
        # a text may be cut before a blank that follows another character, and around line ends
        self.cuttable = not any("\n" in t or " " in t.lstrip(" ") for t, _, _ in found)
        self.grow_tree()
        self.memory = IdMemory(self.encode_words)

    def search(self, text: str, start: int) -> tuple[list[int], list[int]]:
        """Best score from `start` to every position (NEVER where no path leads), and whence."""
        weight, known, longest, n = self.weight.get, self.ids, self.longest, len(text)
        best, back = [NEVER] * (n + 1), [0] * (n + 1)
        best[start] = 0
        for i in range(start, n):
            here = best[i]
            if here == NEVER:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                score = weight(text[i:j])
                if score is None:
                    break
                score += here
                if score > best[j]:
                    best[j], back[j] = score, i
            if text[i] not in known and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
        return best, back

    def forward(self, text: str, start: int) -> list[int]:
        return self.search(text, start)[0]

    def encode_word(self, text: str) -> list[int]:
        _, back = self.search(text, 0)
        n, out = len(text), []
        while n:
            part = text[back[n] : n]
            piece = self.ids.get(part)
            out += [self.byte_id[b] for b in reversed(part.encode())] if piece is None else [piece]
            n = back[n]
        return out[::-1]

    def grow_tree(self) -> None:
        """The tree of all beginnings of pieces: children by (node, character), weight and id per node."""
        node = {"": 0} | {text: k for k, text in enumerate(self.weight, 1)}
        parent = np.array([node[text[:-1]] for text in self.weight], np.int64)
        last = np.array([ord(text[-1]) for text in self.weight], np.int64)
        key = parent << 21 | last
        order = np.argsort(key)
        self.child_key, self.child = key[order], order + 1
        self.node_weight = np.array([NEVER, *self.weight.values()], np.int64)
        self.node_id = np.array([-1, *(self.ids.get(text, -1) for text in self.weight)], np.int64)
        self.first_child = np.full(1 << 21, -1, np.int32)
        at_root = key < 1 << 21
        self.first_child[key[at_root]] = np.flatnonzero(at_root) + 1

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has; as encode_word, for many words in step."""
        texts = [w.decode() for w in words]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(length) - length
        strange = np.flatnonzero(self.node_id[self.first_child[codes]] < 0)
        easy = (length > 0) & (length <= 64)
        easy[np.searchsorted(first, strange, side="right") - 1] = False
        found: list = [None] * len(texts)
        order = np.flatnonzero(easy)
        order = order[np.argsort(length[order], kind="stable")]
        for k in range(0, len(order), 8192):
            at = order[k : k + 8192]
            for word, ids in zip(at.tolist(), self.in_step(codes, first[at], length[at])):
                found[word] = ids
        for word in np.flatnonzero(~easy).tolist():
            found[word] = np.array(self.encode_word(texts[word]), np.uint32)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def in_step(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Ids of words without strange characters: the search of all of them, place by place."""
        n, width = len(first), int(length.max())
        best = np.full((n, width + 1), NEVER, np.int64)
        back, piece = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        best[:, 0] = 0
        for i in range(width):
            rows = np.flatnonzero(length > i)
            node = self.first_child[codes[first[rows] + i]].astype(np.int64)
            here = best[rows, i]
            for j in range(i + 1, min(width, i + self.longest) + 1):
                weight = self.node_weight[node]
                score = here + weight
                better = (weight > NEVER) & (score > best[rows, j])
                to = rows[better]
                best[to, j], back[to, j], piece[to, j] = score[better], i, self.node_id[node[better]]
                on = length[rows] > j
                rows, node, here = rows[on], node[on], here[on]
                if not len(rows):
                    break
                key = node << 21 | codes[first[rows] + j]
                at = np.minimum(np.searchsorted(self.child_key, key), len(self.child_key) - 1)
                on = self.child_key[at] == key
                rows, node, here = rows[on], self.child[at[on]], here[on]
        out, count = np.zeros((n, width), np.uint32), np.zeros(n, np.int64)
        place, rows = length.copy(), np.arange(n)
        while len(rows):  # from the ends of the words back
            out[rows, width - 1 - count[rows]] = piece[rows, place[rows]]
            count[rows] += 1
            place[rows] = back[rows, place[rows]]
            rows = rows[place[rows] > 0]
        return [ids[width - k :] for ids, k in zip(out, count.tolist())]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and the total)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        if self.cuttable:
            blank, line = data == 0x20, data == 0x0A
            cut[1:-1] = blank[1:] & ~blank[:-1]
            cut[:-1] |= line
            cut[1:] |= line
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        ids, at = self.memory(strings(data, bounds))
        return ids, at[np.searchsorted(bounds, offs)]

    def transfer(self, part: str, n: int) -> np.ndarray:
        """Best scores from every state at the left border to every state at the right one.

        The chunk is part[:n]; what follows is as much of the next chunk as a piece can reach.
        Between two places where the text may be cut all paths are one.
        """
        states = self.longest
        out = np.full((states, states), NEVER, np.int64)
        left = next((q for q in range(states - 1, n) if self.cut_before(part, q)), None)
        right = next((q for q in range(n, 0, -1) if q < len(part) and self.cut_before(part, q)), None)
        if left is None or right is None or right < left:
            for s in range(states):
                reached = self.forward(part, s)[n : n + states]
                out[s, : len(reached)] = reached
            return out
        middle = self.forward(part[left:right], 0)[-1]
        after = self.forward(part[right:], 0)[n - right : n - right + states]
        for s in range(states):
            out[s, : len(after)] = np.array(after, np.int64) + (self.forward(part[:left], s)[left] + middle)
        return np.maximum(out, NEVER)

    def cut_before(self, text: str, q: int) -> bool:
        if not self.cuttable:
            return False
        return (text[q] == " " and text[q - 1] != " ") or text[q] == "\n" or text[q - 1] == "\n"

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, its largest entry brought to 0 so that sums stay small."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.maximum(out - out.max(), NEVER)


def vocabulary(path: str) -> Vocabulary:
    return remembered(("pieces", path), lambda: Vocabulary(path))


def square(values) -> np.ndarray:
    flat = np.asarray(values, dtype=np.int64)
    side = int(round(len(flat) ** 0.5))
    return flat.reshape(side, side)


CHUNKS = "row long, doc_id long, chunk int, n_chunks int, part string, size int"


def split_long(docs: DataFrame, chunk: int, look: int, prefix: str) -> DataFrame:
    """The chunks of long texts with what a piece may reach of the next one."""

    @tidy
    def run(batches):
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = prefix + text
                n = len(text) // chunk  # the last chunk takes the rest
                for first in range(0, n, 64):
                    some = range(first, min(n, first + 64))
                    size = [chunk if c < n - 1 else len(text) - c * chunk for c in some]
                    yield pa.record_batch(
                        [
                            pa.array([row] * len(some), pa.int64()), pa.array([doc] * len(some), pa.int64()),
                            pa.array(list(some), pa.int32()), pa.array([n] * len(some), pa.int32()),
                            pa.array([text[c * chunk : c * chunk + s + (look if c < n - 1 else 0)] for c, s in zip(some, size)], pa.string()),
                            pa.array(size, pa.int32()),
                        ],
                        ["row", "doc_id", "chunk", "n_chunks", "part", "size"],
                    )

    # chunks of one text go to all tasks
    return docs.mapInArrow(run, CHUNKS).repartition("row", "chunk")


def matrices(chunks: DataFrame, path: str) -> DataFrame:
    @tidy
    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            found = [
                words.transfer(part.as_py(), size.as_py()).ravel().tolist()
                for part, size in zip(batch.column(2), batch.column(3))
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["row", "place", "matrix"]
            )

    chosen = chunks.select("row", "chunk", "part", "size")
    return chosen.mapInArrow(run, "row long, place int, matrix array<long>")


def combined(level: DataFrame) -> DataFrame:
    """One matrix for every FANOUT neighbours."""

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [square(m) for m in rows.sort_values("place")["matrix"]]
        total = parts[0]
        for part in parts[1:]:
            total = product(total, part)
        return pd.DataFrame({"row": [key[0]], "place": [key[1]], "matrix": [total.ravel().tolist()]})

    block = F.floor(F.col("place") / FANOUT).cast("int").alias("block")
    return level.groupBy("row", block).applyInPandas(multiply, "row long, place int, matrix array<long>")


def inner_states(level: DataFrame, outer: DataFrame) -> DataFrame:
    """Border states of the parts of blocks whose own border states are known."""

    def trace(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        parts = [square(m) for m in rows["matrix"]]
        start, end = int(known["enter"].iloc[0]), int(known["leave"].iloc[0])
        score = np.full(len(parts[0]), NEVER, np.int64)
        score[start] = 0
        ahead = [score]
        for part in parts:
            score = (score[:, None] + part).max(axis=0)
            score = np.maximum(score - score.max(), NEVER)
            ahead.append(score)
        states = [end]
        for k in range(len(parts) - 1, 0, -1):
            states.append(int((ahead[k] + parts[k][:, states[-1]]).argmax()))
        states.append(start)
        states.reverse()
        return pd.DataFrame(
            {"row": key[0], "place": rows["place"].to_numpy(), "enter": states[:-1], "leave": states[1:]}
        )

    lower = level.withColumn("block", F.floor(F.col("place") / FANOUT).cast("int"))
    upper = outer.withColumnRenamed("place", "block")
    return lower.groupBy("row", "block").cogroup(upper.groupBy("row", "block")).applyInPandas(
        trace, "row long, place int, enter int, leave int"
    )


def border_states(level: DataFrame, longest: int) -> DataFrame:
    """row, place, enter, leave of every chunk; levels follow the logarithm of the longest text."""
    levels = [level]
    while longest > 1:
        levels.append(cut_lineage(combined(levels[-1])))
        longest = -(-longest // FANOUT)
    zero = F.lit(0)
    states = levels[-1].select("row", "place", zero.alias("enter"), zero.alias("leave"))
    for below in reversed(levels[:-1]):
        states = cut_lineage(inner_states(below, states))
    return states


ENCODED = "doc_id long, chunk int, n_chunks int, n_tokens int, ids array<int>, text_crc32 long"


def id_batch(doc, chunk, n_chunks, ids: np.ndarray, at: np.ndarray, crc: list[int]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
    count = pa.array(np.diff(at).astype(np.int32))
    return pa.record_batch(
        [doc, chunk, n_chunks, count, lists, pa.array(crc, pa.int64())],
        ["doc_id", "chunk", "n_chunks", "n_tokens", "ids", "text_crc32"],
    )


def encode_whole(docs: DataFrame, path: str, prefix: bool) -> DataFrame:
    @tidy
    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for row, end, data, offs in pieces(batch.column(1)):
                raw = data.tobytes()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                if prefix:  # a blank before every text that is not empty
                    front = offs[:-1][np.diff(offs) > 0]
                    data = np.insert(data, front, 0x20)
                    offs = offs + np.concatenate([[0], np.cumsum(np.diff(offs) > 0)])
                ids, at = words.encode(data, offs)
                n = end - row
                yield id_batch(
                    batch.column(0).slice(row, n), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), ids, at, crc
                )

    return docs.mapInArrow(run, ENCODED)


def encode_chunks(chunks: DataFrame, states: DataFrame, path: str, prefix: bool) -> DataFrame:
    joined = chunks.join(states.withColumnRenamed("place", "chunk"), ["row", "chunk"]).select(
        "doc_id", "chunk", "n_chunks", "part", "size", "enter", "leave"
    )

    @tidy
    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for doc, chunk, n, part, size, enter, leave in zip(*batch.columns):
                mine = part.as_py()[enter.as_py() : size.as_py() + leave.as_py()].encode()
                data = np.frombuffer(mine, np.uint8)
                ids, at = words.encode(data, np.array([0, len(data)]))
                crc = zlib.crc32(mine[1:] if prefix and chunk.as_py() == 0 else mine)
                one = lambda v, kind: pa.array([v.as_py()], kind)
                yield id_batch(one(doc, pa.int64()), one(chunk, pa.int32()), one(n, pa.int32()), ids, at, [crc])

    return joined.mapInArrow(run, ENCODED)


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    longest_piece: int = 16,
    prefix: bool = True,
) -> DataFrame:
    """doc_id, chunk, n_chunks, n_tokens, ids, text_crc32: one row per text, or per chunk of it.

    A chunk's ids cover the text between two of its piece borders, so each row decodes alone and
    a text's rows in the order of `chunk` give its ids. `prefix` sets a blank before the text, as
    the vocabulary was made with.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    short = encode_whole(chosen.where(F.char_length("text") < 2 * chunk), path, prefix)
    # rows are numbered where they are read and written down at once, so numbers stay
    long = chosen.where(F.char_length("text") >= 2 * chunk).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text"
    )
    chunks = cut_lineage(split_long(long, chunk, longest_piece, " " if prefix else ""))
    longest = chunks.agg(F.max("n_chunks")).first()[0]
    if longest is None:
        return short
    states = border_states(cut_lineage(matrices(chunks, path)), longest)
    return short.union(encode_chunks(chunks, states, path, prefix))


def decode(encoded: DataFrame, path: str, prefix: bool = True) -> DataFrame:
    """The encoded rows with `text`: what their ids spell."""
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    place, chunk = names.index("ids"), names.index("chunk")

    @tidy
    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            column = batch.column(place)
            ids, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
            texts = [words.decode(ids[a:b]) for a, b in zip(at, at[1:])]
            first = batch.column(chunk).to_pylist()
            texts = [t[1:] if prefix and c == 0 else t for t, c in zip(texts, first)]
            yield pa.record_batch([*batch.columns, pa.array([t.decode() for t in texts], pa.string())], [*names, "text"])

    return encoded.mapInArrow(run, schema)
