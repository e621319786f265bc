"""Token counts without ids: distinct pre-tokens are counted once and weighted by frequency.

A pre-token is a run of white space with the letters and digits after it, or what follows up to
the next white space. The library always cuts where white space begins, and where punctuation
follows a letter or digit, so the pieces of a text are the pieces of its pre-tokens. Texts are
read in chunks. A chunk holds its distinct pre-tokens once, and per document the numbers of its
pre-tokens with their frequencies, packed. The pre-tokens of all chunks meet by value, each
distinct one is counted once, and the counts go back to their chunk, where frequencies weigh them.
So what moves is a row per chunk and distinct pre-token, however often a document repeats it,
and a very common pre-token is one row per chunk.

Defined cases: a null or empty text has no bytes and no tokens; special strings in a text are
taken as the library takes them by default; repeated rows are counted each on its own; a null
doc_id stays null; empty tables give no rows; other columns are ignored.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, load_tokenizer, stored, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
CHUNK_BYTES = 32 << 20

# Fixed value: the characters Unicode calls white space
WHITE_SPACE = (
    "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
# Letters and digits that a mark of ASCII punctuation surely ends
PLAIN = "A-Za-z0-9\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
MARKS = "!-/:-@\\[-`{-~"
PRE_TOKEN = re.compile(
    f"[{WHITE_SPACE}]*+[{PLAIN}]++(?![^{WHITE_SPACE}{MARKS}])"
    f"|[{WHITE_SPACE}]*+[^{WHITE_SPACE}]++|[{WHITE_SPACE}]++"
)

_CHUNK = (
    "chunk long, doc_ids array<long>, n_bytes array<long>, lengths array<int>,"
    " numbers binary, times binary, pretokens array<string>"
)


class Chunk:
    """Documents read so far, over a vocabulary of their own."""

    def __init__(self):
        self.doc_ids, self.n_bytes, self.vocabulary = [], [], {}
        self.numbers, self.times = [], []

    def add(self, doc_id, text):
        found = Counter(PRE_TOKEN.findall(text))
        place = self.vocabulary.setdefault
        numbers = np.array([place(t, len(self.vocabulary)) for t in found], dtype=np.int64)
        times = np.array(list(found.values()), dtype=np.int64)
        order = np.argsort(numbers)
        self.numbers.append(np.diff(numbers[order], prepend=0))
        self.times.append(times[order])
        self.doc_ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))

    def batch(self, number):
        values = [
            number, self.doc_ids, self.n_bytes, [len(n) for n in self.numbers],
            packed(self.numbers), packed(self.times), list(self.vocabulary),
        ]
        types = [
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
            pa.binary(), pa.binary(), pa.list_(pa.string()),
        ]
        names = [field.split()[0] for field in _CHUNK.split(", ")]
        return pa.record_batch(
            [pa.array([v], type=t) for v, t in zip(values, types)], names=names
        )


def packed(parts):
    """Small integers as compressed bytes."""
    values = np.concatenate(parts) if parts else np.zeros(0)
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def unpacked(data):
    return np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64)


def chunked(docs, chunk_bytes=CHUNK_BYTES):
    """One row per chunk of documents."""

    def read(batches):
        number = TaskContext.get().partitionId() << 32
        chunk, size = Chunk(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                chunk.add(doc_id, text)
                size += len(text) + 16
                if size >= chunk_bytes:
                    yield chunk.batch(number)
                    chunk, size, number = Chunk(), 0, number + 1
        if chunk.doc_ids:
            yield chunk.batch(number)

    return documents_columns(docs).mapInArrow(read, _CHUNK)


def piece_counts(pretokens, path):
    """(chunk, place, pieces); rows of equal pretoken lie together, each value counted once."""

    def count(batches):
        tokenizer = load_tokenizer(path)
        last, pieces = None, 0
        for batch in batches:
            texts = batch.column("pretoken").to_pylist()
            new = list(dict.fromkeys(t for t in texts if t != last))
            found = tokenizer.encode_batch_fast(new, add_special_tokens=False)
            known = {t: len(e.ids) for t, e in zip(new, found)}
            known[last] = pieces
            if texts:
                last, pieces = texts[-1], known[texts[-1]]
            yield pa.record_batch(
                [
                    batch.column("chunk"), batch.column("place"),
                    pa.array([known[t] for t in texts], type=pa.int32()),
                ],
                names=["chunk", "place", "pieces"],
            )

    dealt = pretokens.repartition("pretoken").sortWithinPartitions("pretoken")
    return dealt.mapInArrow(count, "chunk long, place int, pieces int")


def weigh(chunks, counts):
    """Token sums of the documents of one chunk."""
    if not chunks.num_rows:
        return _documents([], [], [])
    pieces = np.zeros(counts.num_rows, dtype=np.int64)
    pieces[counts.column("place").to_numpy()] = counts.column("pieces").to_numpy()
    row = chunks.to_pylist()[0]
    lengths = np.array(row["lengths"], dtype=np.int64)
    steps, times = unpacked(row["numbers"]), unpacked(row["times"])
    ends = np.cumsum(lengths)
    sums = np.zeros(len(lengths), dtype=np.int64)
    for i, (start, end) in enumerate(zip(ends - lengths, ends)):
        if end > start:
            sums[i] = (pieces[np.cumsum(steps[start:end])] * times[start:end]).sum()
    return _documents(row["doc_ids"], row["n_bytes"], sums)


def _documents(doc_ids, n_bytes, n_tokens):
    return pa.table(
        [pa.array(c, type=pa.int64()) for c in (doc_ids, n_bytes, n_tokens)],
        names=["doc_id", "n_bytes", "n_tokens"],
    )


def token_counts(docs, path=None, limit=TOKEN_LIMIT, chunk_bytes=CHUNK_BYTES):
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    path = path or vocabulary_path(VOCABULARY)
    chunks = stored(chunked(docs, chunk_bytes))
    pretokens = chunks.select("chunk", F.posexplode("pretokens").alias("place", "pretoken"))
    counts = piece_counts(pretokens, path)
    weighed = (
        chunks.drop("pretokens").groupBy("chunk")
        .cogroup(counts.groupBy("chunk"))
        .applyInArrow(weigh, "doc_id long, n_bytes long, n_tokens long")
    )
    return weighed.withColumn("over_limit", F.col("n_tokens") > limit)
