"""Packing token ids into sequences by first-fit decreasing.

Texts become ids (and one end id per document), cut into pieces of at most the sequence length.
Pieces are dealt into groups of about ``group_pieces`` by a hash, and each group is packed on its
own: pieces by falling length, each into the first sequence with room, which a tournament tree
over the free places finds in logarithmic time. A group leaves about one sequence part-empty.

The tokenizer drops white space and never joins across it, nor across the end of a run of letters,
so ids are found once per distinct word of a block of texts: from caches of bounded size, or else
by the tokenizer, whose model alone takes runs of Latin letters.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each on its own;
a null doc_id stays null; empty tables give no rows; other columns are ignored. ``docs`` must be a
scan or a stored table, so that a task that runs again sees the same rows in the same order.
"""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from pricemill.llm.common import documents_columns, load_tokenizer, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
SEQUENCE_LENGTH = 2048
END_ID = 1
GROUP_PIECES = 1024
# Latin letters up to a mark of ASCII punctuation or the end: the tokenizer cuts there too
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
PARTS = (
    f"^(?s:(?P<letters>[{_LETTER}]+)(?P<marks>(?:[!-/:-@\\[-`{{-~].*)?)|(?P<other>.*))$"
)
_CACHED_PARTS = 1 << 19
_BLOCK_BYTES = 4 << 20
_BINS_PER_GROUP = 1 << 24


def binaries(ids, ends):
    """Lists of ids, one after the other in ``ids`` up to each of ``ends``, as binary values."""
    offsets = 4 * np.array([0, *ends], dtype=np.int64)
    data = np.array(ids, dtype="<u4").tobytes()
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    )


class PartIds:
    """Little-endian ids of parts of words, those of earlier blocks from a cache of bounded size."""

    def __init__(self, encoded):
        self.encoded = encoded
        self.parts = pa.array([], type=pa.large_string())
        self.ids = pa.array([], type=pa.large_binary())

    def of(self, parts):
        parts = parts.dictionary_encode()
        place = pc.index_in(parts.dictionary, value_set=self.parts)
        new = parts.dictionary.filter(place.is_null())
        places = place.fill_null(-1).to_numpy().copy()
        places[places < 0] = np.arange(len(self.parts), len(self.parts) + len(new))
        encoded = self.encoded(new.to_numpy(zero_copy_only=False).tolist())
        self.parts = pa.concat_arrays([self.parts, new])
        self.ids = pa.concat_arrays([self.ids, encoded])
        ids = self.ids.take(pa.array(places))
        if len(self.parts) > _CACHED_PARTS:
            self.parts, self.ids = parts.dictionary, ids
        return ids.take(parts.indices)


class WordIds:
    """Little-endian ids of the words of many texts.

    Texts are split, and equal words are found, by Arrow. Only the distinct words of a block of
    texts are taken apart, and only the parts that the caches lack meet the tokenizer.
    """

    def __init__(self, path):
        self.tokenizer = load_tokenizer(path)
        from tokenizers.pre_tokenizers import ByteLevel

        in_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = {chr(c).lower() for c in range(0xc0, 0x250)}
        self.in_bytes = {ord(c): in_bytes(c)[0][0] for c in letters if len(c) == 1}
        self.letters, self.others = PartIds(self.encoded_letters), PartIds(self.encoded)

    def encoded(self, texts):
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [encoding.ids for encoding in found]
        return binaries(list(itertools.chain(*ids)), list(itertools.accumulate(map(len, ids))))

    def encoded_letters(self, words):
        """Ids of small letters only: one word to the tokenizer's model, its letters in bytes."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], []
        for word in words:
            if not word.isascii():
                word = word.translate(self.in_bytes)
            ids += [token.id for token in tokenize(word)]
            ends.append(len(ids))
        return binaries(ids, ends)

    def word_ids(self, words):
        """The ids of each of the distinct words: of its letters, and of what follows them."""
        found = pc.extract_regex(words, PARTS)
        letters, marks, other = (pc.struct_field(found, [i]) for i in range(3))
        others = pc.binary_join_element_wise(marks, other, pa.scalar("", pa.large_string()))
        return pc.binary_join_element_wise(
            self.letters.of(pc.utf8_lower(letters)), self.others.of(others),
            pa.scalar(b"", pa.large_binary()),
        )

    def of(self, texts):
        """The ids of each text with the end id, as bytes."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = self.word_ids(words.dictionary).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])
        stops = ends[split.offsets.to_numpy()].tolist()
        data, end = memoryview(ids.buffers()[2] or b""), END_ID.to_bytes(4, "little")
        return [bytes(data[start:stop]) + end for start, stop in itertools.pairwise(stops)]


def blocks(batch, column, most_bytes=_BLOCK_BYTES):
    """Slices of a batch whose texts have ``most_bytes`` and one text more at the utmost."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.nonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most_bytes))[0] + 1
    for start, stop in itertools.pairwise([0, *ends.tolist(), batch.num_rows]):
        yield batch.slice(start, stop - start)


def token_pieces(docs, path=None, length=SEQUENCE_LENGTH, with_ids=False):
    """doc_id, start, length, ids_crc32, doc_tokens, salt (and ids) of each piece."""
    path = path or vocabulary_path(VOCABULARY)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
    names = [field.split()[0] for field in schema.split(", ")] + ["ids"] * with_ids

    def cut(batches):
        words = WordIds(path)
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in blocks(batch, 1):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), words.of(part.column(1))):
                    salt += 1
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        piece = ids[4 * start:4 * (start + length)]
                        row = (doc, start, len(piece) // 4, zlib.crc32(piece), total, salt)
                        rows.append(row + (packed_ids(piece),) * with_ids)
                columns = list(zip(*rows)) if rows else [()] * len(names)
                arrays = [pa.array(c, type=pa.int64()) for c in columns[:6]]
                arrays += [pa.array(c, type=pa.binary()) for c in columns[6:]]
                yield pa.record_batch(arrays, names=names)

    return documents_columns(docs).mapInArrow(cut, schema + ", ids binary" * with_ids)


def packed_ids(ids):
    """Little-endian ids of four bytes in two bytes each, if all are small enough."""
    values = np.frombuffer(ids, dtype="<u4")
    return values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else ids


def unpacked(data, length):
    """The ids of a piece of ``length`` ids in four bytes each."""
    return data if len(data) == 4 * length else np.frombuffer(data, "<u2").astype("<u4").tobytes()


class TournamentTree:
    """Free places of the sequences; every inner node knows the most free place below it."""

    def __init__(self, bins, capacity):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size):
        """The first bin with room for ``size``; takes the room and gives (bin, offset before)."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.most[node] < size:
                node += 1
        free = self.most[node]
        self.most[node] = free - size
        bin_number = node - self.leaves
        while node > 1:
            node //= 2
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])
        return bin_number, free


def first_fit_decreasing(lengths, capacity):
    """(bin, offset) of each piece; ``lengths`` in falling order."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    found = [tree.place(int(size)) for size in lengths]
    return [b for b, _ in found], [capacity - free for _, free in found]


def pack_group(part, group, capacity):
    """One group's Arrow table with sequence_id and offset."""
    lengths = part.column("length").to_numpy()
    keys = [part.column(c).to_numpy() for c in ("start", "salt")]
    order = np.lexsort((keys[0], keys[1], -lengths))
    bins, offsets = first_fit_decreasing(lengths[order], capacity)
    ordered = part.take(pa.array(order)).drop_columns(["grp", "salt"])
    first = group * _BINS_PER_GROUP
    return ordered.append_column(
        "sequence_id", pa.array(np.asarray(bins, dtype=np.int64) + first)
    ).append_column("offset", pa.array(offsets, type=pa.int64()))


def grouped_pieces(docs, path, length, group_pieces, with_ids=False):
    """The pieces of all documents, dealt into groups of about ``group_pieces``."""
    size = documents_columns(docs).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    # four bytes a token on average: only the size of groups hangs on it
    pieces = size["n"] + (size["bytes"] or 0) // (4 * length)
    groups = max(1, -(-pieces // group_pieces))
    return token_pieces(docs, path, length, with_ids).withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups))
    ).groupBy("grp")


def pack(docs, path=None, length=SEQUENCE_LENGTH, group_pieces=GROUP_PIECES):
    """The pieces of all documents with their places: sequence_id and offset."""

    def packed(key, part):
        return pack_group(part, key[0].as_py(), length)

    return grouped_pieces(docs, path, length, group_pieces).applyInArrow(
        packed,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long",
    )


def joined_pieces(placed):
    """One row per sequence from the placed pieces of a group, ids in the order of their offsets."""
    rows = sorted(
        zip(*(placed.column(c).to_pylist() for c in (
            "sequence_id", "offset", "doc_id", "start", "length", "ids"))),
        key=lambda row: row[:2],
    )
    sequence_ids, lengths, ids, pieces = [], [], [], []
    for sequence, members in itertools.groupby(rows, key=lambda row: row[0]):
        members = list(members)
        sequence_ids.append(sequence)
        lengths.append(sum(m[4] for m in members))
        ids.append(b"".join(unpacked(m[5], m[4]) for m in members))
        pieces.append([
            {"doc_id": m[2], "start": m[3], "length": m[4], "offset": m[1]} for m in members
        ])
    piece = pa.struct([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())
    ])
    return pa.table({
        "sequence_id": pa.array(sequence_ids, pa.int64()),
        "n_tokens": pa.array(lengths, pa.int32()),
        "ids": pa.array(ids, pa.binary()),
        "pieces": pa.array(pieces, pa.list_(piece)),
    })


def sequences(docs, path=None, length=SEQUENCE_LENGTH, group_pieces=GROUP_PIECES):
    """One row per sequence: its ids and the pieces they come from, in order.

    All pieces of a sequence are in one group, so ids are shuffled once. Repeated rows are packed
    each on its own; without documents there are no sequences.
    """

    def packed(key, part):
        return joined_pieces(pack_group(part, key[0].as_py(), length))

    return grouped_pieces(docs, path, length, group_pieces, with_ids=True).applyInArrow(
        packed,
        "sequence_id long, n_tokens int, ids binary,"
        " pieces array<struct<doc_id: long, start: long, length: long, offset: long>>",
    )
