"""SentencePiece encoding and decoding by a max-plus parallel scan.

For a BPE model a segmentation is the merges' result just where each two neighbouring pieces are: where encoding the two
as one string gives them back.  So encoding is a search for a path through pieces, in which a step is allowed if the
last two pieces fit together; from any start one path at most is left to each end.  A state is where the last piece
ends and how long it is.

A text longer than a chunk is cut at fixed places.  The states at a cut are the pieces that end there or cross it.  For
each chunk a max-plus matrix is computed: from each state at its start to each at its end, minus the number of pieces
between, or minus infinity.  Each chunk is backtraced on its own, for each pair of states that a path joins; the text is not
needed after that.  Matrices combine associatively: groups of chunks are folded to one matrix each, a scan over a
document's groups gives the states between these, a scan within each group those between chunks, which say what path
of each chunk is taken.  A task holds one group's chunks, or one matrix for each group of a text, and a row's result.
The ids are those that the library gives for the whole text, wherever it is cut.

Where two characters stand in no piece side by side, no piece crosses: of a chunk, only what lies before its first and
after its last word start is searched state by state, the middle is encoded once for all.

Defined results: null and empty texts have no tokens; characters without a piece are encoded as bytes; decoding gives back the
text, but U+2581, which the model uses for blanks, becomes a blank; a text is normalised as the model does without change
(identity, a blank put before it), other normalisers and models of other kinds than BPE are refused; rows that repeat a
doc_id are encoded each.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, map_rows, squeeze, table, unsqueeze

CHUNK, GROUP, KNOWN = 1 << 15, 64, 1 << 18
NEVER = -(1 << 40)
GAP = "▁"
WORD_START = re.compile(f"(?<=[^{GAP}]){GAP}")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Model:
    def __init__(self, path: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that normalise by identity, with a blank put before the text")
        if proto.trainer_spec.model_type != 2 or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only BPE models without pieces of the user's")
        self.bytes_of: list[bytes] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:  # a byte
                self.byte[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.bytes_of.append(p.piece.replace(GAP, " ").encode())
            else:
                self.bytes_of.append(b"")
        self.longest = max(map(len, self.score))
        self.starts = {p[:n] for p in self.score for n in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.apart = all(GAP not in p.lstrip(GAP) for p in self.score)
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string by merging the best pair, the leftmost of equal ones, again and again."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces can follow each other; each a piece of its own if left is empty."""
        key = (left, right)
        hit = self.known.get(key)
        if hit is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            if left and left[-1] + right[0] not in self.pairs:
                hit = self.fits("", left) and self.fits("", right)
            else:
                hit = self.merged(left + right) == ([left, right] if left else [right])
            self.known[key] = hit
        return hit

    def plain(self, text: str) -> list[int]:
        """The library's ids of a text that starts with a blank."""
        return self.library.encode(text[1:].replace(GAP, " "), num_threads=1)

    def encode(self, text: str) -> bytes:
        """Ids (little-endian 32-bit) of a text, in one go."""
        return np.array(self.library.encode(text, num_threads=1) if text else [], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The text's UTF-8."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]

    def walk(self, text: str, at: int, last: str, stop: int) -> dict[int, tuple[int, int]]:
        """{end: length of the last piece} of the paths whose pieces start in [at, stop), after `last`."""
        reach, n, starts, score, longest = {at: len(last)}, len(text), self.starts, self.score, self.longest
        for i in range(at, stop):
            here = reach.get(i)
            if here is None:
                continue
            left = text[i - here : i] if i > at else last
            for e in range(i + 1, min(i + longest, n) + 1):
                piece = text[i:e]
                if (piece in score or e == i + 1) and self.fits(left, piece):
                    reach[e] = e - i
                if piece not in starts:
                    break
        return reach

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return out

    def back(self, text: str, reach: dict, start: int, end: int) -> list[int]:
        found = []
        while end > start:
            found.append(text[end - reach[end] : end])
            end -= len(found[-1])
        return self.ids_of(found[::-1])

    # A chunk is its own n characters from place `at` on, with up to `longest` of the text on either side.

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """(end, length) of the pieces that end at a place or cross it; at either end of the text the place alone."""
        if cut in (0, len(text)):
            return [(cut, 0)]
        found = [(e, n) for e in range(cut, min(cut + self.longest, len(text) + 1)) for n in range(max(1, e - cut + 1), min(e, self.longest) + 1) if self.piece(text[e - n : e])]
        return found

    def piece(self, x: str) -> bool:
        return (x in self.score or len(x) == 1) and self.fits("", x)

    def middle(self, text: str, at: int, n: int) -> tuple[int, int] | None:
        """The first and last word start that all paths through the chunk meet."""
        if not self.apart:
            return None
        found = [m.start() for m in WORD_START.finditer(text, at + self.longest, at + n)]
        return (found[0], found[-1]) if found else None

    def _tails(self, text: str, reach: dict, start: int, ends: list[tuple[int, int]]) -> dict[int, list[int]]:
        """Ids of the paths from start to each end state that is reached; a length of 0 means any."""
        return {b: self.back(text, reach, start, e) for b, (e, n) in enumerate(ends) if e in reach and e > start and n in (0, reach[e])}

    def measure(self, text: str, at: int, n: int) -> tuple[np.ndarray, tuple]:
        """(matrix, paths) of a chunk: heads by state at its start, the middle, tails by state at its end; or tails by both."""
        begins, ends, cut = self.states(text, at), self.states(text, at + n), self.middle(text, at, n)
        out = np.full((len(begins), len(ends)), NEVER, np.int64)
        heads, middle, tails, pairs = {}, [], {}, {}
        if cut:
            first, last = cut
            tails = self._tails(text, self.walk(text, last, "", at + n), last, ends)
            middle = self.plain(text[first:last])
        for a, (e, size) in enumerate(begins):
            left = text[e - size : e]
            if e >= at + n:  # a piece that crosses the whole chunk
                found = {b: [] for b, x in enumerate(ends) if x in ((e, size), (e, 0))}
            elif not cut:
                found = self._tails(text, self.walk(text, e, left, at + n), e, ends)
            else:
                reach = self.walk(text[:first], e, left, first)
                if first in reach:
                    heads[a] = self.back(text, reach, e, first)
                    for b, ids in tails.items():
                        out[a, b] = -len(heads[a]) - len(middle) - len(ids)
                continue
            for b, ids in found.items():
                out[a, b], pairs[a, b] = -len(ids), np.array(ids, "<u4").tobytes()
        return out, (heads, np.array(middle, "<u4").tobytes(), tails, pairs)


def taken(paths: tuple, a: int, b: int) -> bytes:
    """Ids (little-endian 32-bit) of a chunk's path from state a to state b."""
    heads, middle, tails, pairs = paths
    if a in heads:
        return np.array(heads[a], "<u4").tobytes() + middle + np.array(tails[b], "<u4").tobytes()
    return pairs[a, b]


_models: dict[str | None, Model] = {}


def model_of(path: str | None) -> Model:
    """The worker's own, which keeps the pairs it knows between tasks."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    out = np.full((x.shape[0], y.shape[1]), NEVER, np.int64)
    for k in range(y.shape[0]):
        np.maximum(out, x[:, k, None] + y[k], out=out)
    return np.maximum(out, NEVER)


def fold(matrices) -> np.ndarray:
    out = None
    for m in matrices:
        out = m if out is None else combine(out, m)
    return out


def states(matrices: list[np.ndarray], a: int, b: int) -> list[int]:
    """The state at each cut on the best path from state a before the first matrix to state b after the last one."""
    ahead = [matrices[0][a]]
    for m in matrices[1:]:
        ahead.append(np.maximum((ahead[-1][:, None] + m).max(0), NEVER))
    at = [b]
    for k in range(len(matrices) - 1, 0, -1):
        at.append(int(np.argmax(ahead[k - 1] + matrices[k][:, at[-1]])))
    return [a, *at[::-1]]


def chunks(text: str, longest: int, size: int) -> list[tuple[str, int, int]]:
    """(text with what stands around, place of the chunk in it, its length)."""
    text = GAP + text.replace(" ", GAP)
    return [(text[max(0, i - longest) : i + size + longest], min(i, longest), min(size, len(text) - i)) for i in range(0, len(text), size)]


ENCODED = [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]


def encoded(docs: DataFrame, path: str | None = None, size: int = CHUNK, group: int = GROUP, digest=None, fields=ENCODED, ddl: str = "doc_id long, ids binary, decoded binary") -> DataFrame:
    """doc_id, ids (little-endian 32-bit) and the decoded text of each row; or what digest makes of these."""
    digest = digest or (lambda *x: x)
    docs = documents(docs).withColumn("long", F.length(F.col("text").cast("string")) >= size)

    def short(found):
        m = model_of(path)
        for doc_id, text in found:
            ids = m.encode(text.decode())
            yield digest(doc_id, ids, m.decode(ids))

    def cut(found):
        m, uid = model_of(path), TaskContext.get().partitionId() << 33
        for doc_id, text in found:
            for k, c in enumerate(chunks(text.decode(), m.longest, size)):
                yield uid, doc_id, k // group, k, *c
            uid += 1

    def measured(found):
        m = model_of(path)
        for uid, doc_id, g, k, text, at, n in found:
            yield uid, doc_id, g, k, *map(squeeze, m.measure(text, at, n))

    def folded(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        return pa.table({"uid": t.column("uid")[:1], "g": t.column("g")[:1], "t": pa.array([squeeze(fold(unsqueeze(x.as_py()) for x in t.column("t")))])})

    def between_groups(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        at = states([unsqueeze(x.as_py()) for x in t.column("t")], 0, 0)
        return pa.table({"uid": t.column("uid"), "g": t.column("g"), "a": pa.array(at[:-1], pa.int32()), "b": pa.array(at[1:], pa.int32())})

    def within_group(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        at = states([unsqueeze(x.as_py()) for x in t.column("t")], t.column("a")[0].as_py(), t.column("b")[0].as_py())
        ids = b"".join([taken(unsqueeze(x.as_py()), a, b) for x, a, b in zip(t.column("paths"), at, at[1:], strict=False)])
        return pa.table({"uid": t.column("uid")[:1], "doc_id": t.column("doc_id")[:1], "g": t.column("g")[:1], "ids": pa.array([ids], pa.binary())})

    out = pa.schema(fields)

    def joined(t: pa.Table) -> pa.Table:
        m, t = model_of(path), t.sort_by("g")
        ids = b"".join(t.column("ids").to_pylist())
        row = digest(t.column("doc_id")[0].as_py(), ids, m.decode(ids))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

    plain = map_rows(docs.where("not long").select("doc_id", "text"), short, fields, ddl)
    place = [("uid", pa.int64()), ("doc_id", pa.int64()), ("g", pa.int32()), ("k", pa.int32())]
    parts = map_rows(docs.where("long").select("doc_id", "text"), cut, [*place, ("text", pa.string()), ("at", pa.int32()), ("n", pa.int32())], "uid long, doc_id long, g int, k int, text string, at int, n int", 64)
    made = checkpointed(map_rows(parts.repartition("uid", "k"), measured, [*place, ("t", pa.binary()), ("paths", pa.binary())], "uid long, doc_id long, g int, k int, t binary, paths binary", 64), release=True)
    of_group = made.select("uid", "g", "k", "t").groupBy("uid", "g").applyInArrow(folded, "uid long, g int, t binary").groupBy("uid").applyInArrow(between_groups, "uid long, g int, a int, b int")
    ids = made.join(of_group, ["uid", "g"]).groupBy("uid", "g").applyInArrow(within_group, "uid long, doc_id long, g int, ids binary")
    return plain.unionByName(ids.groupBy("uid").applyInArrow(joined, ddl))


def op5(spark, sf_dir: str) -> DataFrame:
    def digest(doc_id, ids, decoded):
        return doc_id, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return encoded(table(spark, sf_dir, "documents"), digest=digest, fields=fields, ddl="doc_id long, n_tokens long, ids_crc32 long, ids_sha256 string, decoded_sha256 string")
