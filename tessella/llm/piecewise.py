"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model at hand is a BPE model, so the best path is not that of the largest
sum of scores but the one that the merges give. It has the same form: a token
sequence is the encoding exactly if each two neighbours are, so every prefix
has one last token, found from the last tokens of shorter prefixes. The pass
takes a text in bounded chunks, keeps a backpointer for each place of a window
of the longest piece, and commits ids whenever the paths of all places of the
window meet in one boundary. Where no piece can cross (text, then the space
mark, or two characters that stand side by side in no piece) all paths meet at
once, so the pass starts afresh there; what it gave for a short stretch between
two such boundaries is remembered, in tables of bounded size.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import release, small_batches

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters of a text that are taken at a time.
CHUNK = 1 << 16
#: First characters of a stretch whose paths are remembered by themselves.
HEAD = 5
#: Characters of the longest remembered stretch, and about the bytes that all tables of a worker may hold.
SHORT, TABLE_BYTES = 64, 256 << 20
_loaded: dict[str, "PieceModel"] = {}


class Recent:
    """A table of bounded size: when its newer half is full, the older half goes, and what is asked for stays new."""

    def __init__(self, entries: int):
        self.half, self.new, self.old = max(1, entries // 2), {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PieceModel:
    """Pieces, scores and byte pieces of a BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.ident, self.piece = {}, {}, []
        self.byte = [-1] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.piece.append(b"")
            if sp.is_byte(i):
                b = int(p[1:-1], 16)
                self.byte[b], self.piece[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ident[p], self.rank[p] = i, -sp.get_score(i)
                self.piece[i] = p.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ident))
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ident)
        self.pairs = {p[k : k + 2] for p in self.ident for k in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        """Empty all tables."""
        self.agree: dict[str, dict[str, bool]] = {}
        self.agreed = 0
        # by about 120, 500, 500, 200 and 250 bytes for an entry
        self.most_agreed, self.traces = TABLE_BYTES // 8 // 120, Recent(TABLE_BYTES // 32 // 500)
        self.heads = Recent(3 * TABLE_BYTES // 32 // 500)
        self.known, self.words = Recent(TABLE_BYTES // 4 // 200), Recent(TABLE_BYTES // 2 // 250)

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((self.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _trace(self, token: str, left: bool) -> list[tuple[float, str]]:
        """Merges that make a token by itself: rank of each, and the part at its inner edge before it; the end has no rank."""
        got = self.traces.get((token, left))
        if got is None:
            parts, got = list(token), []
            while True:
                edge = parts[-1] if left else parts[0]
                best = min(((self.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank), default=None)
                if best is None:
                    got.append((float("inf"), edge))
                    break
                got.append((best[0], edge))
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.traces.put((token, left), got)
        return got

    def neighbours(self, a: str, b: str) -> bool:
        """Whether a and b are the encoding of a + b: no merge over their border is ever the best one."""
        left, right, i, j = self._trace(a, True), self._trace(b, False), 0, 0
        while True:
            x, y = left[i][0], right[j][0]
            across = self.rank.get(left[i][1] + right[j][1])
            if across is not None and across < x and across <= y:
                return False
            if x == y == float("inf"):
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def _agree(self, before: str, token: str) -> bool:
        """neighbours(), remembered by the left token; a text's first token has no neighbour."""
        if self.agreed >= self.most_agreed:
            self.agree, self.agreed = {}, 0
        self.agreed += 1
        ok = self._after(before)[token] = not before or self.neighbours(before, token)
        return ok

    def _after(self, token: str) -> dict[str, bool]:
        """What is remembered of the tokens to the right of one."""
        row = self.agree.get(token)
        if row is None:
            if self.agreed >= self.most_agreed:
                self.agree, self.agreed = {}, 0
            self.agreed += 1
            row = self.agree[token] = {}
        return row

    def stream(self, chunks):
        """Ids of a normalised text that arrives in chunks, as soon as every surviving path agrees on them.

        ``last[i]`` is the last token of the prefix that ends i characters
        after the committed boundary: the only piece at its end that agrees
        with the last token before it.
        """
        text, last, due = "", [""], 2 * self.longest
        for chunk in chunks:
            text += chunk
            while len(last) <= len(text):
                self._fill(text, last, min(len(text), due))
                if len(last) > due:
                    cut, ids = self._meeting(last, due)
                    yield from ids
                    # what follows keeps its last tokens: they are fixed by the whole prefix
                    text, last = text[cut:], ["" if not k else last[cut + k] for k in range(due - cut + 1)]
                    due += self.longest - cut
        yield from self._path(last, len(text))

    def _fill(self, text: str, last: list[str], end: int) -> None:
        """Last tokens of the prefixes up to ``end``."""
        ident, known, after = self.ident, self.agree.get, self._after
        rows = [known(t) or after(t) for t in last]
        for i in range(len(last), end + 1):
            k = i - 1
            token = text[k:i]
            ok = rows[k].get(token)
            if ok is None:
                ok = self._agree(last[k], token)
            while not ok:
                k -= 1
                token = text[k:i]
                ok = rows[k].get(token)
                if ok is None and token in ident:
                    ok = self._agree(last[k], token)
            last.append(token)
            rows.append(known(token) or after(token))

    def _head(self, s: str) -> list[str]:
        """Last tokens of the prefixes of a stretch's first characters, which many stretches share."""
        got = self.heads.get(s)
        if got is None:
            got = [""]
            self._fill(s, got, len(s))
            self.heads.put(s, tuple(got))
        return list(got)

    def _path(self, last: list[str], end: int) -> list[int]:
        """Ids along the backpointers from a place."""
        tokens, out, ident = [], [], self.ident
        while end:
            tokens.append(last[end])
            end -= len(last[end])
        for t in reversed(tokens):
            i = ident.get(t)
            if i is None:
                out += [self.byte[b] for b in t.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def _meeting(self, last: list[str], n: int):
        """The last boundary that the paths from all of the window's ends share, and the ids up to it."""
        live = set(range(n - self.longest + 1, n + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - len(last[far]))
        cut = live.pop()
        return cut, self._path(last, cut)

    def _part(self, s: str) -> bytes:
        """Ids of a stretch between two boundaries that nothing crosses, as int32."""
        got = self.known.get(s)
        if got is None:
            if len(s) <= self.longest:  # ends within the first window
                last = self._head(s[:HEAD]) if len(s) > HEAD else [""]
                self._fill(s, last, len(s))
                got = array("i", self._path(last, len(s))).tobytes()
            else:
                got = array("i", self.stream([s])).tobytes()
            if len(s) <= SHORT:
                self.known.put(s, got)
        return got

    def _segment(self, s: str) -> bytes:
        """Ids of space marks and what follows them."""
        pairs = self.pairs
        cuts = [0, *[k for k in range(1, len(s)) if s[k - 1 : k + 1] not in pairs], len(s)]
        return b"".join([self._part(s[i:j]) for i, j in zip(cuts, cuts[1:])])

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self._segment(SPACE + word)
            if len(word) <= SHORT:
                self.words.put(word, got)
        return got

    def _chunks(self, text: str):
        """Pieces of a text of about CHUNK characters, cut in front of a space that follows another character; the first gets the mark that begins every text."""
        at = 0
        while at < len(text):
            to = at + CHUNK
            while 0 < (to := text.find(" ", to)) and text[to - 1] in (" ", SPACE):
                to += 1
            to = len(text) if to < 0 else to
            yield at, text[at:to]
            at = to

    def encode(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids as the library gives them, and whether the round trip is exact."""
        if self.crossing:
            ids = np.fromiter(self.stream(c.replace(" ", SPACE) if at else SPACE + c.replace(" ", SPACE) for at, c in self._chunks(text)), dtype="<i4")
            return ids, self.decode(ids.tolist()) == text
        out = []
        for at, chunk in self._chunks(text):
            # a chunk that is not the first begins with the space that _word stands for
            chunk, new = chunk[1:] if at else chunk, self.words.new.get
            if SPACE in chunk or "  " in chunk or chunk[:1] in ("", " ") or chunk[-1] == " ":  # marks in runs
                out += [self._segment(s) for s in _SEGMENT.findall(SPACE + chunk.replace(" ", SPACE))]
            else:
                out += [new(w) or self._word(w) for w in chunk.split(" ")]
        ids = np.frombuffer(b"".join(out), dtype="<i4")
        return ids, self.decode(ids.tolist()) == text

    def decode(self, ids) -> str:
        text = b"".join([self.piece[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text  # the mark that begins every text


def model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _encode(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            ids, good = [], []
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                a, ok = m.encode(text)
                ids.append(a)
                good.append(ok)
            sizes = np.array([len(a) for a in ids], dtype=np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), column, pa.array(good, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])
        m.forget()
        release()

    return run


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) for each row, by the BPE model file at ``path``, without begin and end ids.

    round_trip tells whether decode(ids) is the text; it is false for texts
    with the space mark itself. Null and empty texts have no ids; repeated
    rows are encoded each; an empty table gives an empty table; other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_encode(path), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def _decode(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [m.decode(x) if x is not None else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded documents; null ids: an empty text."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode(path), "doc_id long, text string")
