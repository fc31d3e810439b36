"""SentencePiece encoding and decoding of merge-type vocabularies.

A text is cut where a word mark follows another character: no piece of such a vocabulary holds a mark after something
else (checked when a vocabulary is loaded), so merges never cross these cuts. Each distinct chunk is merged by a
score-ordered agenda of adjacent symbol pairs: for many short chunks at once as rows of an array (each step merges every
row's best pair, the leftmost of equals), for long chunks or unknown characters with a heap. Every chunk that a worker learns,
and so every part of every text, is compared with the sentencepiece library; a difference fails the task. As no merge crosses a
cut, what holds for the chunks holds for the text.

Defined results: null text is empty, which gives no ids and decodes to the empty text; repeated rows are each encoded;
an empty table gives an empty table; characters without a piece become byte pieces.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, texts_of

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks that a worker remembers, none of them longer than _LONG characters: in scripts without spaces a chunk may be a
#: paragraph, which hardly comes again, so it is forgotten with its batch.
REMEMBERED = 600_000
_LONG, _NONE = 40, np.float32(-np.inf)


class _Chars(dict):
    """Piece ids of characters; one without a piece is -2 - its code point, which merges with nothing."""

    def __missing__(self, c: str) -> int:
        return -2 - ord(c)


class Codec:
    """One vocabulary: ids of chunks and texts of ids."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only merge-type vocabularies without normalisation are handled")
        self.text = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece crosses a word mark")
        if any(p.type == 4 for p in model.pieces) or MARK not in self.id:
            raise ValueError("a vocabulary with symbols of the user, or without the word mark")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.value = {i: b for b, i in self.byte.items()}
        self.decimal = [str(i) for i in range(len(self.text))]
        self.size = len(self.text)
        table = sorted((self.id[p[:k]] * self.size + self.id[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        self.pair = np.array([k for k, _ in table], np.int64)
        self.merged = np.array([i for _, i in table], np.int32)
        scores = np.array([p.score for p in model.pieces], np.float32)
        self.pair_score = scores[self.merged]
        self.char = _Chars((p, i) for p, i in self.id.items() if len(p) == 1)
        self.said = [p.replace(MARK, " ") for p in self.text]
        # chunks as decimals and as text; the older half of what is remembered is forgotten first
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the merged pair; -inf where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        ok = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_score[at], _NONE), self.merged[at]

    def rows(self, chunks: list[str]) -> list[list[int]]:
        """The agenda over many chunks: every step merges each row's best pair. Characters without a piece stay negative."""
        lens = np.array([len(c) for c in chunks])
        n, width = len(chunks), int(lens.max())
        ids = np.full((n, width + 1), -1, np.int32)
        flat = np.fromiter(map(self.char.__getitem__, "".join(chunks)), np.int32, int(lens.sum()))
        ids[:, :width][np.arange(width) < lens[:, None]] = flat
        score, into = self.look(ids[:, :-1], ids[:, 1:])
        out = ids.copy()
        row = np.arange(n)
        cols = np.arange(width + 1)
        while len(row):
            best = score.argmax(1)
            open_ = score[np.arange(len(row)), best] > _NONE
            if not open_.all():
                out[row[~open_]] = ids[~open_]
                row, ids, score, into, best = row[open_], ids[open_], score[open_], into[open_], best[open_]
                if not len(row):
                    break
            r = np.arange(len(row))
            ids[r, best] = into[r, best]
            take = np.minimum(cols + (cols > best[:, None]), width)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, width] = -1
            score = np.take_along_axis(score, np.minimum(take[:, :-1], width - 1), 1)
            into = np.take_along_axis(into, np.minimum(take[:, :-1], width - 1), 1)
            score[:, width - 1] = _NONE
            for at in (best, np.maximum(best - 1, 0)):
                s, m = self.look(ids[r, at], ids[r, np.minimum(at + 1, width)])
                ok = at < width
                score[r[ok], at[ok]], into[r[ok], at[ok]] = s[ok], m[ok]
        return [x[:k] for x, k in zip(out.tolist(), (out != -1).sum(1).tolist(), strict=True)]

    def heap(self, chunk: str) -> list[int]:
        """The agenda for one chunk of any length: linked symbols and a heap of pairs."""
        sym: list[str | None] = list(chunk)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := nxt[i]) >= 0 and (s := self.score.get(both := sym[i] + sym[j])) is not None:
                heapq.heappush(agenda, (-s, i, both))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            if sym[i] is None or (j := nxt[i]) < 0 or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j], nxt[i] = both, None, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        ids: list[int] = []
        for s in sym:
            if s is not None:
                ids += [self.id[s]] if s in self.id else [self.byte[b] for b in s.encode()]
        return ids

    def spoken(self, ids: list[int]) -> str:
        """Text of ids, with marks as spaces; runs of byte pieces are UTF-8."""
        raw = b"".join(bytes([self.value[i]]) if i in self.value else self.text[i].replace(MARK, " ").encode() for i in ids)
        return raw.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.spoken(ids).removeprefix(" ")

    def learn(self, chunks: set[str]) -> None:
        """Remembers the ids (as decimals joined by commas) and the decoded text of chunks."""
        by_width: dict[int, list[str]] = {}
        new = []
        for c in chunks:
            if c in self.older:
                self.ids_of[c], self.text_of[c] = self.older[c]
                continue
            new.append(c)
            if len(c) <= _LONG:
                by_width.setdefault((len(c) + 3) // 4, []).append(c)
            else:
                self._tell(c, self.heap(c))
        decimal, said = self.decimal, self.said
        for own in by_width.values():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                for c, ids in zip(part, self.rows(part), strict=True):
                    if min(ids) >= 0:
                        self.ids_of[c], self.text_of[c] = ",".join([decimal[i] for i in ids]), "".join([said[i] for i in ids])
                    else:
                        self._tell(c, [j for i in ids for j in ([i] if i >= 0 else [self.byte[b] for b in chr(-2 - i).encode()])])
        for at in range(0, len(new), 8192):
            self.compare(new[at : at + 8192])

    def compare(self, chunks: list[str]) -> None:
        """Fails where what is remembered of a chunk is not what the library says. The library puts the first mark before a
        text itself, but says nothing of the empty text: a mark alone is compared as the end of a text."""
        lone = [MARK] if MARK in chunks else []
        chunks = [c for c in chunks if c != MARK]
        want = self.library.encode([c[1:] for c in chunks] + ["a "] * len(lone), num_threads=1)
        if lone:
            chunks, head = chunks + lone, self.library.encode("a")
            if want[-1][: len(head)] != head or len(want[-1]) != len(head) + 1:
                raise ValueError("a mark at the end of a text is not a piece of its own")
            want[-1] = want[-1][len(head) :]
        decimal = self.decimal
        for c, ids, text in zip(chunks, want, self.library.decode(want, num_threads=1), strict=True):
            if self.ids_of[c] != ",".join([decimal[i] for i in ids]) or self.text_of[c].removeprefix(" ") != text:
                raise ValueError("the agenda and the sentencepiece library differ")

    def _tell(self, chunk: str, ids: list[int]) -> None:
        self.ids_of[chunk], self.text_of[chunk] = ",".join([self.decimal[i] for i in ids]), self.spoken(ids)

    def encoded(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids as decimals joined by commas, their number, decoded text) of each text."""
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids_of) > REMEMBERED // 2:
            self.older = {c: (i, self.text_of[c]) for c, i in self.ids_of.items()}
            self.ids_of, self.text_of = {}, {}
        every = set().union(*cut)
        self.learn(every.difference(self.ids_of))
        ids, text = self.ids_of.__getitem__, self.text_of.__getitem__
        out = []
        for own in cut:
            listed = ",".join(map(ids, own))
            out.append((listed, listed.count(",") + 1 if own else 0, "".join(map(text, own))[1:]))
        for c in [c for c in every if len(c) > _LONG]:
            del self.ids_of[c], self.text_of[c]
        return out


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        gc.set_threshold(100_000, 10, 10)  # millions of short-lived lists, none of them in a cycle
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids as decimals, n_tokens, decoded text) of each document."""
    return _mapped(docs, model_file, id_col, text, digest=False)


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each document: only digests leave the worker."""
    return _mapped(docs, model_file, id_col, text, digest=True)


def _mapped(docs: DataFrame, model_file: str, id_col: str, text: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in slices(batches, 1024):
            texts = texts_of(batch)
            got = c.encoded(texts)
            sha = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else (lambda s: s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([sha(g[0]) for g in got]), pa.array([sha(g[2]) for g in got])], names=["doc_id", "n_tokens", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    ids, back = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string").withColumnsRenamed({"ids": ids, "decoded": back})
