"""Encoding and decoding with a SentencePiece model by shortest paths in a weighted finite-state transducer.

The model's normaliser, its pieces and the byte fallback are compiled into a transducer. An arc reads the characters of
a piece, writes its id and weighs its score with the sign changed; a character without a piece has an arc that writes its
bytes and weighs FALLBACK. Of a unigram model the path of least weight is the segmentation, and nothing more is needed.
A model that merges pairs by score has another: the least sum of weights of arcs alone isn't it; so they are composed with an acceptor of neighbouring pieces: a piece may follow another only if the merges
of the two texts end in just those two pieces. A path of such arcs is the model's own segmentation: the first merge that
crossed a border between two pieces would cross it in the text of these two alone too. The acceptor leaves such a model
one path for each text, so that there its weights don't decide. The composition with a text is
relaxed place by place in the tropical semiring: sums along paths, the least where paths meet.

No piece holds U+2581 after another character, so merges never cross such borders: texts fall into parts U+2581+ other*.
Nor does a piece of the model at hand join Latin letters to other ASCII, so a part falls into sections there. Parts and
sections that come again are composed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rasterloom.llm.common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Weight of a character that is written as bytes.
FALLBACK = 1e9
#: Entries of the caches of parts and of neighbours; they are emptied when full.
PARTS, NEIGHBOURS = 600_000, 1_000_000
_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ſ]", r"[\x00-@\[-`{-\x7f]"
#: Borders between Latin letters and other ASCII.
_BORDER = re.compile(f"(?<={_LETTER})(?={_MARK})|(?<={_MARK})(?={_LETTER})")




def normaliser(normalize) -> tuple[str, dict[int, str]]:
    """The text put before others, and what each changed character becomes, read off a model's own normaliser.

    A normaliser that drops or joins spaces or looks at more than one character has no such table: that raises an error.
    """
    prefix = normalize("a")[:-1]
    one = lambda c: normalize(f"a{c}a")[len(prefix) + 1 : -1]
    changed = {i: out for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (out := one(chr(i))) != chr(i)}
    if normalize(" a  b e\u0301 ") != prefix + " a  b e\u0301 ".translate(changed):
        raise ValueError("the model's normaliser isn't a table of single characters")
    return prefix, changed


class Transducer:
    def __init__(self, pieces: list[tuple[str, float, int]], bytes_: list[int], prefix: str = SPACE, changed: dict[int, str] | None = None, merging: bool = True):
        """pieces: (text, score, id); bytes_: the id of each of the 256 bytes; prefix and changed: the normaliser's; merging: whether pairs are merged by score."""
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
            raise ValueError("a piece holds U+2581 after another character")
        self.pieces, self.bytes, self.prefix, self.changed, self.merging = pieces, bytes_, prefix, changed or {32: SPACE}, merging
        #: What a character without a piece weighs; of a unigram model ten more than its rarest piece.
        self.fallback = FALLBACK if merging or not pieces else 10 - min(s for _, s, _ in pieces)
        #: Whether no piece stands across a _BORDER.
        self.bordered = not any(_BORDER.search(p) for p, _, _ in pieces)
        self.score = {p: s for p, s, _ in pieces}
        self.ids = {p: i for p, _, i in pieces}
        self.text = {i: p.replace(SPACE, " ").encode() for p, _, i in pieces} | {i: bytes([b]) for b, i in enumerate(bytes_)}
        #: What an arc writes, as 32-bit numbers.
        self.written = _Written({p: np.int32(i).tobytes() for p, i in self.ids.items()}, bytes_)
        #: Lengths of the arcs that may begin with some four characters (or, where no piece does, three or two), the longest first.
        starts: dict[str, set[int]] = {}
        for p, _, _ in pieces:
            for j in range(2, min(len(p), 4) + 1):
                starts.setdefault(p[:j], {1}).update(k for k in range(2, j + 1) if p[:k] in self.score)
            if len(p) > 4:
                starts[p[:4]].add(len(p))
        self.starts = _Starts({k: tuple(sorted(v, reverse=True)) for k, v in starts.items()})
        #: By the piece before: the weight of an arc, or None if the acceptor refuses it.
        self.composed = _Composed(self)
        self.known = 0
        self.merges: dict[str, tuple[list, list, list, bool]] = {}
        self.parts, self.sections = _Parts(self), _Sections(self)

    @classmethod
    def load(cls, path: str = MODEL) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in n]
        pieces = [(names[i], model.get_score(i), i) for i in n if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        place = {p: i for i, p in enumerate(names)}
        # Scores of merges are their ranks; those of unigrams are logarithms.
        merging = all(float(s).is_integer() for _, s, _ in pieces)
        return cls(pieces, [place[f"<0x{b:02X}>"] for b in range(256)], *normaliser(model.normalize), merging)

    def __reduce__(self):
        return Transducer, (self.pieces, self.bytes, self.prefix, self.changed, self.merging)

    def merges_of(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """The merges that make a piece of its characters: their scores, the first and last parts before and after each, and whether one part is left.

        Again and again the best-scored neighbours are merged, the leftmost first.
        """
        if piece not in self.merges:
            s, scores = list(piece), []
            first, last = [s[0]], [s[-1]]
            while len(s) > 1:
                best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.score), default=None)
                if best is None:
                    break
                i = -best[1]
                s[i : i + 2] = [s[i] + s[i + 1]]
                scores.append(best[0])
                first.append(s[0])
                last.append(s[-1])
            if len(self.merges) >= NEIGHBOURS:
                self.merges.clear()
            self.merges[piece] = scores, first, last, len(s) == 1
        return self.merges[piece]

    def weight(self, last: str, arc: str) -> float | None:
        """The weight of an arc after a piece in the composition; None if there is no such arc or the acceptor refuses it."""
        score = self.score.get(arc)
        if score is None and len(arc) > 1 or self.merging and not self._stay_apart(last, arc):
            return None
        return self.fallback if score is None else -score

    def _stay_apart(self, a: str, b: str) -> bool:
        scores_b, first, _, whole = self.merges_of(b)
        if not whole:
            return False
        if not a:
            return True
        scores_a, _, last, _ = self.merges_of(a)
        i, j, n, m, none = 0, 0, len(scores_a), len(scores_b), float("-inf")
        while True:
            across = self.score.get(last[i] + first[j], none)
            next_a = scores_a[i] if i < n else none
            next_b = scores_b[j] if j < m else none
            if across > next_a and across >= next_b and across > none:
                return False
            if i == n and j == m:
                return True
            if next_a >= next_b and i < n:
                i += 1
            else:
                j += 1

    def shortest_path(self, part: str) -> list[str]:
        """The pieces (or single characters without a piece) on the path of least weight through a part.

        A state is a place in the part and, if pairs are merged, the piece that ends there. The segmentation of a text begins with that of each
        text that it begins with up to a border, so the acceptor leaves one piece for each place, and a place is a state.
        """
        n, score, starts, composed, merging = len(part), self.score, self.starts, self.composed, self.merging
        least: list[float | None] = [None] * (n + 1)
        arcs = [""] * (n + 1)
        least[0] = 0.0
        for at in range(n):
            sum_ = least[at]
            if sum_ is None:
                continue
            last = arcs[at] if merging else ""
            after = composed[last]
            for k in starts[part[at : at + 4]]:
                to = at + k
                if to > n:
                    continue
                arc = part[at:to]
                w = after[arc]
                if w is not None:
                    w += sum_
                    old = least[to]
                    if old is None or w < old:
                        least[to], arcs[to] = w, arc
        out, at = [], n
        while at:
            out.append(arcs[at])
            at -= len(arcs[at])
        return out[::-1]

    def section(self, text: str) -> bytes:
        return b"".join(map(self.written.__getitem__, self.shortest_path(text)))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(" ", SPACE) if len(self.changed) == 1 and self.changed.get(32) == SPACE else text.translate(self.changed)
        parts = _PARTS.findall(self.prefix + text)
        return np.frombuffer(b"".join(map(self.parts.__getitem__, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text: what went in, with U+2581 turned to spaces."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode(errors="replace")[len(self.prefix) :]


class _Written(dict):
    """What arcs write; a character without a piece writes its bytes."""

    def __init__(self, pieces: dict[str, bytes], bytes_: list[int]):
        super().__init__(pieces)
        self.bytes = bytes_

    def __missing__(self, c: str) -> bytes:
        return np.array([self.bytes[b] for b in c.encode()], np.int32).tobytes()


class _Starts(dict):
    """Lengths of arcs by the next four characters; those of the model's own beginnings are given, others are remembered."""

    def __init__(self, given: dict[str, tuple[int, ...]]):
        super().__init__(given)
        self.given = given

    def __missing__(self, key: str) -> tuple[int, ...]:
        if len(self) >= NEIGHBOURS:
            self.clear()
        out = self[key] = self.given.get(key) or self.given.get(key[:3]) or self.given.get(key[:2], (1,))
        return out


class _Composed(dict):
    """Weights of arcs by the piece before."""

    def __init__(self, of: Transducer):
        self.of = of

    def __missing__(self, last: str) -> _After:
        out = self[last] = _After(self.of, last)
        return out


class _After(dict):
    """Weights of arcs after one piece."""

    def __init__(self, of: Transducer, last: str):
        self.of, self.last = of, last

    def __missing__(self, arc: str) -> float | None:
        of = self.of
        if of.known >= NEIGHBOURS:
            of.composed.clear()
            of.known = 0
        of.known += 1
        out = self[arc] = of.weight(self.last, arc)
        return out


class _Parts(dict):
    """Ids of the parts met so far."""

    def __init__(self, of: Transducer):
        self.of = of

    def __missing__(self, part: str) -> bytes:
        if len(self) >= PARTS:
            self.clear()
        # Letters alone have no border.
        sections = _BORDER.split(part) if self.of.bordered and not part.lstrip(SPACE).isalpha() else [part]
        out = self[part] = self.of.section(part) if len(sections) == 1 else b"".join(map(self.of.sections.__getitem__, sections))
        return out


class _Sections(_Parts):
    """Ids of the sections of parts with more than one."""

    def __missing__(self, section: str) -> bytes:
        if len(self) >= PARTS:
            self.clear()
        out = self[section] = self.of.section(section)
        return out


def encode(docs: DataFrame, transducer: Transducer | None = None) -> DataFrame:
    """docs (all its columns, of which text is read) with ids (array of int) and round_trip (whether the ids decode to the text).

    A null or empty text has no ids. In round_trip, U+2581 in a text counts as the space it decodes to. An empty
    table gives no rows. Columns of the names ids and round_trip are replaced. The compiled model is sent to the
    executors once; its size is that of the vocabulary.
    """
    rest = [c for c in docs.columns if c not in ("ids", "round_trip")]
    sent = docs.sparkSession.sparkContext.broadcast(transducer or Transducer.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            ids, same = [], []
            for text in batch.column("__text"):
                text = text.as_py() or ""
                x = t.encode(text)
                ids.append(x)
                same.append(t.decode(x) == text.replace(SPACE, " "))
            ends = np.cumsum([0, *map(len, ids)])
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(same, pa.bool_())], names=[*rest, "ids", "round_trip"])

    schema = docs.select(*rest).schema.add("ids", ArrayType(IntegerType())).add("round_trip", "boolean")
    return docs.select(*rest, F.col("text").alias("__text")).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the number of its ids, a hash of them in order, and whether they decode to its text."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = encode(d)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
