"""Token counts of whole documents with bounded encoder input.

Overlap resynchronisation: a text is encoded in overlapping chunks with
offsets. Two neighbouring chunks are spliced at a boundary that both encodings
have inside their overlap and that is stable: a character that is not white
space followed by white space. The byte-level splitting pattern never joins
these two and looks only ahead, so the tokens on each side of such a place do
not depend on the other side. If an overlap has no such boundary it is
doubled, up to the whole rest of the text. Every text takes this path; one of a
single chunk has nothing to splice. The last chunks of a batch's texts, which
need no offsets, are encoded together.
"""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import release, small_batches

CHUNK, OVERLAP = 1 << 15, 256
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = _loaded[path] = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _loaded[path]


def _stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n\t\r" and not text[at - 1].isspace()


def spliced(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """The ids of ``text`` in lists, up to its last proven boundary, then the rest of the text, not encoded yet.

    ``encode(part)`` gives (ids, end offsets in characters of part). Memory is
    that of a chunk and the overlap that proved its boundary.
    """
    start = 0
    while True:
        stop, width = start + chunk, overlap
        while True:
            if stop >= len(text):
                yield text[start:]
                return
            left, ends = encode(text[start:stop])
            low = max(start, stop - width)
            # the right chunk starts inside the left one; both must cut at the same stable place
            right = {low + e for e in encode(text[low : stop + width])[1]}
            cut = next((k for k in range(len(ends) - 1, -1, -1) if low < start + ends[k] < stop and start + ends[k] in right and _stable(text, start + ends[k]) and (k + 1 == len(ends) or ends[k + 1] > ends[k])), None)
            if cut is not None:
                break
            width *= 2
            stop += width
        yield left[: cut + 1]
        start += ends[cut]


def encoder(path: str):
    t = tokenizer(path)

    def encode(part: str):
        e = t.encode(part, add_special_tokens=False)
        return e.ids, [b for _, b in e.offsets]

    return encode


def counts_of(path: str, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token count of each text."""
    t, encode, counts, rests = tokenizer(path), encoder(path), [], []
    for text in texts:
        *done, rest = spliced(encode, text, chunk, overlap)
        counts.append(sum(map(len, done)))
        rests.append(rest)
    last = getattr(t, "encode_batch_fast", t.encode_batch)
    at = 0
    while at < len(rests):  # about a chunk's worth of texts at a time
        to, size = at, 0
        while to < len(rests) and (to == at or size + len(rests[to]) <= 8 * chunk):
            size += len(rests[to])
            to += 1
        for i, e in enumerate(last(rests[at:to], add_special_tokens=False), at):
            counts[i] += len(e)
        at = to
    return counts


def _count(path: str, chunk: int, overlap: int, limit: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_bytes = pc.binary_length(texts.cast(pa.large_string()))
            counts = counts_of(path, texts.to_pylist(), chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        release()

    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, by the byte-level BPE file at ``path``.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a
    text count as the library's default does. Repeated rows are counted each;
    an empty table gives an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_count(path, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
