"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model file is one of byte-pair merges, whose encoding isn't the path with the best sum of scores: it is the one path
on which each two neighbouring pieces are what the merges make of the two. So the search runs over (place, last piece)
with a step allowed or not by the pair, and each place has one survivor. Survivors are kept for a window no longer than the
longest piece; as soon as all their backpointer paths pass one boundary, the ids before it are committed and forgotten.
A boundary that no piece can cross (before a space that follows something else) always is one; what lies between two
such is looked up in a memo first.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.shared import col, slices, type_of

SPACE = "▁"
MODEL = os.environ.get("QUARRY_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Memo entries, and characters of the longest segment that is remembered; beyond them work is repeated, nothing else.
MEMO, MEMO_CHARS = 300_000, 64


class Pieces:
    """Vocabulary and merges of a model file with byte fallback, an identity normaliser and a space put before the text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model with the identity normaliser and a dummy prefix is expected")
        kind = {"normal": 1, "unknown": 2, "control": 3, "user": 4, "byte": 6}
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind["normal"]}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kind["normal"]}
        self.byte = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == kind["byte"]:
                self.byte[int(p.piece[3:5], 16)] = i
        self.is_byte = {i: b for b, i in enumerate(self.byte)}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kind["control"]}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind["unknown"])
        self.longest = max(map(len, self.ids))
        # no piece may cross a boundary before a space that follows another character
        self.spaces_lead = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.split: dict[str, tuple[str, str]] = {}  # the last merge that makes a piece
        self.rank = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: (-self.score[p], self.ids[p])))}
        self.tied = {p for p in self.ids if SPACE * 2 in p}  # runs of spaces have one score
        self.stable = {p for p in self.ids if self.merge(p) == [p]}
        self.shared = list(range(len(self.text)))  # one object for each id
        self.pair: dict[int, bool] = {}
        self.alphabet = frozenset(p for p in self.ids if len(p) == 1)
        if not self.alphabet.issuperset("".join(self.ids)):
            raise ValueError("each character of a piece must be a piece")
        self.automaton = ahocorasick.Automaton()
        for p in self.stable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        ends: dict[str, set[int]] = {}
        for p in self.stable:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: tuple(sorted(n, reverse=True)) for c, n in ends.items()}

    def merge(self, text: str) -> list[str]:
        """What the merges make of a text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            split = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                self.split[text] = split
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: the merges leave the two apart. A character in no piece merges with nothing."""
        i, j = self.ids.get(a), self.ids.get(b)
        return i is None or j is None or self.fits_ids(i, j)

    def fits_ids(self, i: int, j: int) -> bool:
        found = self.pair.get(key := i << 20 | j)
        if found is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            a, b = self.text[i], self.text[j]
            found = self.pair[key] = self.merge(a + b) == [a, b] if a in self.tied or b in self.tied or a == b == SPACE else self._apart(a, b)
        return found

    def _apart(self, a: str, b: str) -> bool:
        """As merge(a + b) == [a, b], by undoing both pieces' merges at the boundary from the last to the first.

        Two parts that met there would have merged if their merge ranks before the one that ended one of them; of equal
        ranks the leftmost goes first.
        """
        rank, split = self.rank, self.split
        limit = 1 << 40
        while True:
            both = rank.get(a + b)
            if both is not None and both < limit:
                return False
            x, y = split.get(a), split.get(b)
            if x is None and y is None:
                return True
            # the later of the two merges is undone
            if y is None or (x is not None and rank[a] > rank[b]):
                limit, a = rank[a], x[1]
            else:
                limit, b = rank[b] + 1, y[0]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class StreamingViterbi:
    """Feed characters, take committed ids; the state is a window of survivors that the longest piece bounds."""

    def __init__(self, model: Pieces):
        self.m, self.tail, self.last, self.back, self.out = model, "", [None], [-1], []
        self.widest = 1  #: the largest window so far

    def push(self, text: str) -> None:
        m, ends, stable, fits = self.m, self.m.ends, self.m.stable, self.m.fits
        last, back = self.last, self.back
        for c in text:
            self.tail += c
            n = len(self.tail)
            for size in ends.get(c, (1,)):
                # survivors reach back over the window; index 0 is the committed boundary
                if size > n:
                    continue
                piece = self.tail[n - size :]
                if size > 1 and piece not in stable:
                    continue
                before = last[n - size]
                if before is False or (before is not None and not fits(before, piece)):
                    continue
                last.append(piece)
                back.append(n - size)
                break
            else:
                last.append(False)
                back.append(-1)
            if n >= 2 * m.longest:
                self._commit(n)
                last, back = self.last, self.back

    def _commit(self, n: int) -> None:
        """Walk back from each place that a later piece can still start at, until the paths are one."""
        back = self.back
        at = {i for i in range(n + 1 - self.m.longest, n + 1) if self.last[i] is not False}
        self.widest = max(self.widest, n)
        while len(at) > 1:
            top = max(at)
            at.discard(top)
            at.add(back[top])
        self._emit(at.pop())

    def _emit(self, end: int) -> None:
        if end <= 0:
            return
        found, i = [], end
        while i > 0:
            found.append(self.last[i])
            i = self.back[i]
        m = self.m
        for p in reversed(found):
            if (k := m.ids.get(p)) is not None:
                self.out.append(k)
            else:
                self.out.extend(m.byte[b] for b in p.encode())
        # the piece that ends at the boundary stays as what the next must fit
        self.tail = self.tail[end:]
        self.last = [self.last[end], *self.last[end + 1 :]]
        self.back = [-1, *(b - end for b in self.back[end + 1 :])]

    def end(self) -> list[int]:
        self._emit(len(self.tail))
        return self.out


def encode_short(m: Pieces, text: str) -> tuple[int, ...]:
    """The same search over a text that is itself no longer than a window; an automaton finds the pieces, longest first at each place."""
    if not m.alphabet.issuperset(text):
        return tuple(chain.from_iterable(encode_short(m, run) if known else (m.shared[m.byte[b]] for b in run.encode()) for known, run in _runs(m, text)))
    n = len(text)
    pair, fits = m.pair, m.fits_ids
    last: list[int | None] = [None] * (n + 1)
    back = [0] * (n + 1)
    last[0] = -1
    for end, (size, k) in m.automaton.iter(text):
        end += 1
        if last[end] is None and (a := last[end - size]) is not None:
            if a >= 0:
                ok = pair.get(a << 20 | k)
                if ok is None:
                    ok = fits(a, k)
                if not ok:
                    continue
            last[end] = k
            back[end] = end - size
    out, shared = [], m.shared
    while n > 0:
        out.append(shared[last[n]])
        n = back[n]
    out.reverse()
    return tuple(out)


def _runs(m: Pieces, text: str) -> Iterator[tuple[bool, str]]:
    """Runs of characters that pieces have or lack; no piece crosses from one to the next."""
    for known, run in groupby(text, m.alphabet.__contains__):
        yield known, "".join(run)


def encode_segment(model: Pieces, text: str, short: bool = True) -> list[int] | tuple[int, ...]:
    if short and len(text) <= MEMO_CHARS:
        return encode_short(model, text)
    v = StreamingViterbi(model)
    step = model.longest
    for i in range(0, len(text), step):
        v.push(text[i : i + step])
    return v.end()


class Encoder:
    """Whole texts, segment by segment, with a memo."""

    def __init__(self, path: str = MODEL):
        self.m, self.memo, self.old = pieces(path), {}, {}

    def _word(self, w: str) -> list[int] | tuple[int, ...]:
        """A word after one space, remembered without it; of the words once remembered the more recent half is kept."""
        found = self.old.get(w)
        if found is None:
            found = encode_segment(self.m, SPACE + w)
        if len(w) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            self.memo[w] = found
        return found

    def encode(self, text: str | None) -> list[int] | None:
        if text is None:
            return None
        if not text:
            return []
        if not self.m.spaces_lead:
            return encode_segment(self.m, SPACE + text.replace(" ", SPACE))
        out: list[int] = []
        get, add = self.memo.get, out.extend
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            for w in words:
                add(get(w) or self._word(w))
            return out
        run = 0
        for w in words:  # runs of spaces belong to the word after them
            if w:
                if run:
                    add(encode_segment(self.m, SPACE * (run + 1) + w))
                    run = 0
                else:
                    add(get(w) or self._word(w))
            else:
                run += 1
        if run:
            add(encode_segment(self.m, SPACE * run))
        return out


def decode_ids(model: Pieces, ids: list[int] | None) -> str | None:
    """The text of ids: bytes joined, control ids silent, the first space dropped. Broken UTF-8 becomes U+FFFD."""
    if ids is None:
        return None
    out, raw = [], bytearray()
    for i in ids:
        if (b := model.is_byte.get(i)) is not None:
            raw.append(b)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        if i not in model.silent:
            out.append(" ⁇ " if i == model.unknown else model.text[i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for own in slices(b, 1):
                part = own.column(1).to_pylist()
                ids = [e.encode(t) for t in part]
                size = np.array([0 if x is None else len(x) for x in ids], np.int32)
                flat = np.fromiter((k for x in ids if x for k in x), np.int32, int(size.sum()))
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                null = np.array([x is None for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
                columns = [own.column(0), lists, pa.array([None if x is None else len(x) for x in ids], pa.int32())]
                if check:
                    decoded = [decode_ids(e.m, x) for x in ids]
                    columns.append(pa.array(decoded, pa.string()))
                    columns.append(pa.array([None if t is None else d == t.replace(SPACE, " ") for d, t in zip(decoded, part)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_ids", "decoded", "round_trip"][: len(columns)])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids) of every row, the ids that the model's merges give its whole text.

    A null text has null ids and null n_ids, an empty one no ids and n_ids 0. Repeated rows are encoded each; null ids of
    documents stay null, ids keep their type. Texts of any length are read whole. An empty table gives an empty result. Extra columns are not read.
    """
    return docs.select(col(id_col).alias("doc_id"), col(text).alias("text")).mapInArrow(_encode(model, False), f"doc_id {type_of(docs, id_col)}, ids array<int>, n_ids int")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, decoded, round_trip): as :func:`encode_documents`, with the text that each row's ids decode to and whether it is the row's own.

    U+2581 comes back as a space, which counts as its own. A null text has nulls.
    """
    return docs.select(col(id_col).alias("doc_id"), col(text).alias("text")).mapInArrow(_encode(model, True), f"doc_id {type_of(docs, id_col)}, ids array<int>, n_ids int, decoded string, round_trip boolean")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text, no ids an empty one. U+2581 comes back as a space, as the model has them alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(m, x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(col(id_col).alias("doc_id"), col(ids).alias("ids")).mapInArrow(run, f"doc_id {type_of(encoded, id_col)}, text string")
