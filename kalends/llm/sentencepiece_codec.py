"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

The automaton holds the model's pieces. One pass over a word visits each end
position's pieces by its output links, the longest first, and relaxes the best
way to reach that position:

* in a unigram model, the way of the greatest score (Viterbi);
* in a BPE model, the way whose last piece may follow the piece before it. Two
  neighbours may stand together if merging their joint text gives just these
  two back; a segmentation in which all neighbours may is the one that merging
  gives, and each position has exactly one. (Adding up BPE scores, which are
  merge ranks, would give other ids than the library's.)

Pieces don't reach over the start of a run of word marks, so words are encoded
one by one, and those met before are looked up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_text, slices
from .encoder import WordStore, packed

MARK = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Neighbour checks kept at most.
MAX_CHECKS = 1_000_000
WORDS = regex.compile(rf"(?:^|{MARK})(?:{MARK}*)[^{MARK}]*")


class Codec(WordStore):
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        spec = proto.normalizer_spec
        self.plain = spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = [0] * 256
        self.scores, self.id_of = {}, {}
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            elif p.type in (NORMAL, USER_DEFINED, UNUSED):
                self.scores[p.piece], self.id_of[p.piece] = p.score, i
                if not (self.kind == UNIGRAM and p.type == UNUSED):
                    automaton.add_word(p.piece, (i, len(p.piece), p.score))
        automaton.make_automaton()
        self.pairs = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        self.automaton = automaton
        self.fallback = proto.trainer_spec.byte_fallback
        self.worst = min((p.score for p in proto.pieces if p.type == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.fallback else {}
        # ids that decode to their piece, and those pieces with blanks for word marks
        self.ordinary = np.array([t in (NORMAL, USER_DEFINED, UNUSED) for t in self.types])
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.checks: dict[str | tuple[str, str], bool] = {}
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.segments: dict[str, list[tuple[str, int | None]]] = {}

    # encoding

    def word(self, word: str) -> bytes:
        if self.plain and not word.startswith(MARK):
            word = MARK + word  # words of ordinary texts are kept without their mark
        out: list[int] = []
        for piece, i in self._parts(word):
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
        return packed(out)

    def _parts(self, word: str) -> list[tuple[str, int | None]]:
        """A word's pieces; where two characters stand together in no piece, no piece reaches over, and the word is cut."""
        pairs, segments, out, start = self.pairs, self.segments, [], 0
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in pairs:
                part = word[start:k]
                found = segments.get(part)
                if found is None:
                    found = segments[part] = self._viterbi(part) if self.kind == UNIGRAM else self._merged(part)
                out += found
                start = k
        return out

    def _viterbi(self, word: str) -> list[tuple[str, int | None]]:
        n, single = len(word), np.float32
        best: list = [None] * (n + 1)
        best[0] = (single(0), 0, None)
        reached = 0  # characters without a piece of their own are relaxed up to here

        def unknown_to(stop: int) -> None:
            nonlocal reached
            while reached < stop:
                if word[reached] not in self.scores and best[reached] is not None:
                    score = single(best[reached][0] + single(self.worst))
                    if best[reached + 1] is None or score > best[reached + 1][0]:
                        best[reached + 1] = (score, reached, None)
                reached += 1

        for end, (i, length, piece_score) in self.automaton.iter(word):
            unknown_to(end)
            start = end + 1 - length
            if best[start] is not None:
                score = single(best[start][0] + single(piece_score))
                if best[end + 1] is None or score > best[end + 1][0]:
                    best[end + 1] = (score, start, i)
        unknown_to(n)
        out, at = [], n
        while at:
            _, start, i = best[at]
            out.append((word[start:at], i))
            at = start
        return out[::-1]

    def _merged(self, word: str) -> list[tuple[str, int | None]]:
        n, checks, together = len(word), self.checks, self._together
        before = [0] * (n + 1)  # where the last piece of each prefix starts
        last: list = [None] * (n + 1)
        last[0] = ""
        done = 0
        for end, (_, length, _) in self.automaton.iter(word):
            while done < end:
                done += 1
                if last[done] is None:  # no piece ends here, so a character without one does
                    before[done], last[done] = done - 1, word[done - 1]
            if last[end + 1] is None and (prior := last[end + 1 - length]) is not None:
                piece = word[end + 1 - length : end + 1]
                ok = checks.get((prior, piece))
                if together(prior, piece) if ok is None else ok:
                    before[end + 1], last[end + 1] = end + 1 - length, piece
        while done < n:
            done += 1
            if last[done] is None:
                before[done], last[done] = done - 1, word[done - 1]
        out, at, id_of = [], n, self.id_of
        while at:
            out.append((last[at], id_of.get(last[at])))
            at = before[at]
        return out[::-1]

    def _together(self, a: str, b: str) -> bool:
        key = (a, b)
        got = self.checks.get(key)
        if got is None:
            if len(self.checks) > MAX_CHECKS:
                self.checks.clear()
            got = self.checks[key] = self._merge(a + b) == ([a, b] if a else [b])
        return got

    def _merge(self, text: str) -> list[str]:
        """Merging by definition, for two pieces' texts: the best-scored neighbours first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each)."""
        if not self.plain:
            texts = pa.array([self.library.normalize(t) for t in texts.to_pylist()], pa.string())
            return self.gather(pa.array([WORDS.findall(t) for t in texts.to_pylist()], pa.list_(pa.string())))
        # in a text of single blanks alone, the words are what is between them
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |{MARK}"), pc.equal(texts, ""))
        if not pc.any(odd).as_py():
            return self.gather(pc.split_pattern(texts, " "))
        own = [WORDS.findall(MARK + t.replace(" ", MARK)) if t and o else t.split(" ") if t else [] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        return self.gather(pa.array(own, pa.list_(pa.string())))

    # decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD one by one."""
        if self.ordinary[ids].all():
            shown = self.shown
            return "".join([shown[i] for i in ids]).removeprefix(" ")
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(characters(run))
                run = bytearray()
            if self.types[i] in (NORMAL, USER_DEFINED, UNUSED):
                out.append(self.pieces[i])
            elif i == self.unknown:
                out.append(" \u2047 ")
        if run:
            out.append(characters(run))
        text = "".join(out)
        return text.removeprefix(MARK).replace(MARK, " ")


def characters(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("\ufffd")
                at += 1
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row, as the model's library encodes it without extra options.

    Null and empty texts have no ids; repeated rows and null ids are kept; no
    rows give none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches):
            ids, counts = own.encode(batch.column(1))
            offsets = pa.array(np.concatenate([[0], counts.cumsum()]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32, same): each text encoded and decoded again in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches):
            ids, counts = own.encode(batch.column(1))
            raw, out, end = memoryview(ids).cast("B"), [], 0
            for text, n in zip(batch.column(1).to_pylist(), counts.tolist(), strict=True):
                back = own.decode(ids[end : end + n].tolist())
                out.append((n, zlib.crc32(raw[4 * end : 4 * (end + n)]), zlib.crc32(back.encode()), back == text))
                end += n
            n, crc, text_crc, same = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "same"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, same boolean")
