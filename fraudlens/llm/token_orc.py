"""Token ids in ORC files, ordered by document id.

Documents are range-partitioned by id and sorted inside each partition; every
partition is tokenised in Arrow batches and becomes one run of ORC stripes.
ORC stores the integers with run-length encoding and keeps row indexes and, on
doc_id, Bloom filters. Readers split a file between its stripes, and
``lookup_tokens`` reads only the stripes and row groups that an id may be in.

The ids of a pre-token do not depend on its neighbours (the tokenizer drops white
space and never merges across pre-tokens), so texts are cut into them in numpy, each
task keeps a bounded table from pre-tokens to their ids, and unknown ones are encoded
in batches. Texts are taken in slices of bounded bytes, and longer ones cut at blanks.

Defined cases: null text is empty and gets the end id alone; null ids sort
first; rows that repeat an id stay separate rows, ordered by a hash of the text and dealt
over as many ranges as they fill; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens.llm.storage import cut, shared_folder

END_ID = 2
#: Pre-tokens and odd words that a task remembers.
TABLE_WORDS = 350_000
#: Most rows and bytes of texts that are looked up together, and bytes that are cut at once.
ROWS_A_BATCH, BYTES_A_BATCH, BYTES_A_CUT = 2048, 8 << 20, 512 << 10
#: Bytes of a stripe, the unit of parallel reads, and rows of an index entry, the unit that a lookup skips.
STRIPE_BYTES, STRIDE_ROWS = 64 << 20, 10_000
#: Columns of the files; ``tie`` orders rows of one id.
TOKENS = "doc_id long, tie long, part int, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Bounded(dict):
    """A table that is begun anew when it would hold more than ``most`` names."""

    def __init__(self, most: int):
        self.most = most

    def missing(self, names: set[str]) -> set[str]:
        """The names to be learned, with room made for them."""
        unknown = names.difference(self)
        if len(self) + len(unknown) > self.most:
            self.clear()
            return names
        return unknown


#: Kinds of characters below U+0180. What is odd goes to the tokenizer with the whole word it is in: characters
#: from U+0180 on, whose normalisation depends on tables, U+0130, whose lower case is two characters, controls
#: that are blanks to some libraries only, and what may begin a special token.
LETTER, NUMBER, OTHER, BLANK, ODD = range(5)


def _kind(c: str) -> int:
    if c == "\u0130" or "\x1c" <= c <= "\x1f":
        return ODD
    return BLANK if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


_KINDS = np.array([_kind(chr(i)) for i in range(0x180)], np.uint8)
_LOWER = np.array([ord(chr(i).lower()[0]) for i in range(0x180)], np.uint16)
_BYTE_KINDS = np.concatenate([_KINDS[:128], np.full(128, ODD, np.uint8)])
_BYTE_LOWER = bytes(range(256)).lower()
_BLANK = re.compile(rb"[\x20\x09-\x0d]").search


def slices(texts: pa.StringArray, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of at most ``rows`` rows and ``size`` bytes, or of one row."""
    ends, at = np.cumsum([0, *pc.binary_length(texts).to_pylist()]), 0
    while at < len(texts):
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1), len(texts))
        yield at, to - at
        at = to


def at_blanks(text: pa.StringArray, size: int) -> list[pa.StringArray]:
    """The one text cut after the first blank behind every ``size`` bytes; no pre-token and no odd word crosses one."""
    raw = text.cast(pa.binary())[0].as_buffer()
    ends = [0]
    while ends[-1] + size < len(raw) and (found := _BLANK(raw, ends[-1] + size)):
        ends.append(found.end())
    if len(ends) == 1 or ends[-1] < len(raw):
        ends.append(len(raw))
    parts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.array(ends, np.int32)), raw)
    return [parts.slice(at, 1) for at in range(len(parts))]


def cut_texts(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(the tokenizer's own pre-tokens in lower case, and odd words as they are, of all texts on end;
    where each text begins among them and the last one ends). The bytes of all texts are cut at once."""
    rows = texts.cast(pa.binary()).to_pylist()
    raw = bytearray(b"\n").join([*rows, b""])
    chars = np.frombuffer(raw.translate(_BYTE_LOWER), np.uint8)
    kinds = _BYTE_KINDS[chars]
    pairs = np.flatnonzero((chars >= 0xC2) & (chars <= 0xC5))  # characters of two bytes below U+0180
    if len(pairs):
        code = (chars[pairs] & 31).astype(np.uint16) << 6 | chars[pairs + 1] & 63
        kinds[pairs] = kinds[pairs + 1] = _KINDS[code]
        chars[pairs], chars[pairs + 1] = 0xC0 | _LOWER[code] >> 6, 0x80 | _LOWER[code] & 63
    special = np.flatnonzero(chars == ord("<"))
    kinds[special[chars[special + 1] == ord("|")]] = ODD
    blank = kinds == BLANK
    odd = kinds == ODD
    if odd.any():
        first = ~blank
        first[1:] &= blank[:-1]
        word = np.cumsum(first, dtype=np.int32)
        whole = np.zeros(word[-1] + 1, bool)
        whole[word[odd]] = True
        odd = whole[word] & ~blank
        kinds[odd] = ODD
        chars[odd] = np.frombuffer(raw, np.uint8)[odd]
    starts = kinds == NUMBER  # each by itself
    starts[0] = True
    starts[1:] |= kinds[1:] != kinds[:-1]
    starts[pairs + 1] = False
    quotes = np.flatnonzero((chars == ord("'")) & (kinds == OTHER) & starts)
    if len(quotes):  # 's 't 'm 'd 're 've 'll
        a, b = chars[quotes + 1], chars[np.minimum(quotes + 2, len(chars) - 1)]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        three = np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        starts[quotes[two | three] + 1] = False
        starts[quotes[two] + 2] = starts[quotes[three] + 3] = True
    at = np.flatnonzero(starts)
    sizes, kept = np.diff(at, append=len(chars)), ~blank[at]
    at, offsets = at[kept], np.zeros(np.count_nonzero(kept) + 1, np.int32)
    np.cumsum(sizes[kept], out=offsets[1:])
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(chars[~blank]))
    return units, np.searchsorted(at, np.cumsum([0, *(len(row) + 1 for row in rows)]))


class WordTable:
    """Ids of pre-tokens as little-endian unsigned 32-bit integers.

    Many words share a pre-token, and merges never leave one, so new ones are encoded many
    together and told apart by the end-of-word mark of their last id. Odd words
    (see ``cut_texts``) go to the tokenizer as they are."""

    def __init__(self, path: str, most: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # for pre-tokens, which are normalised and cut already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.path, self.ids = path, Bounded(most)
        self.odd = re.compile("[\u0180-\U0010ffff\u0130\x1c-\x1f]|<\\|").search
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, names: set[str]) -> None:
        odd = list(filter(self.odd, names))
        for at in range(0, len(odd), 1000):
            for word, coded in zip(some := odd[at : at + 1000], self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.ids[word] = np.array(coded.ids, dtype="<u4").tobytes()
        pieces = list(names.difference(odd)) if odd else list(names)
        for first in range(0, len(pieces), 10_000):
            some = [pieces[at : at + 100] for at in range(first, min(first + 10_000, len(pieces)), 100)]
            for each, coded in zip(some, self.plain.encode_batch_fast(list(map(" ".join, some)), add_special_tokens=False)):
                ids = np.array(coded.ids, dtype="<u4")
                ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(ends) != len(each):
                    raise ValueError("pre-tokens and end marks differ in number")
                raw = ids.tobytes()
                self.ids.update(zip(each, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text begins and the last one ends).

        Arrow numbers the distinct pre-tokens; only those are looked up here,
        and their ids are gathered by number."""
        units, rows, n = [pa.array([], pa.string())], [np.zeros(1, np.int64)], 0
        for at, many in slices(texts, len(texts), BYTES_A_CUT):
            some = texts.slice(at, many)
            for part in [some] if many > 1 else at_blanks(some, BYTES_A_CUT):
                found, ends = cut_texts(part)
                units.append(found)
                ends = ends + n
                n = ends[-1]
            rows.append(ends[1:])
        numbered, rows = pa.concat_arrays(units).dictionary_encode(), np.concatenate(rows)
        del units
        names = numbered.dictionary.to_pylist()
        unknown = self.ids.missing(set(names))
        if unknown:
            self._learn(unknown)
        coded = list(map(self.ids.__getitem__, names))
        ends = np.zeros(len(coded) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, coded), np.int32, len(coded)) // 4, out=ends[1:])
        pool = np.frombuffer(b"".join(coded), "<u4")
        each = pa.ListArray.from_arrays(pa.array(ends), pa.array(pool)).take(numbered.indices)
        ids, ends = each.flatten().to_numpy(), each.offsets.to_numpy()
        return ids, (ends - ends[0])[rows]


#: Tables outlive a task where Spark keeps its Python workers.
_TABLES: dict[tuple[str, int], WordTable] = {}


def word_table(path: str, most: int) -> WordTable:
    if (path, most) not in _TABLES:
        _TABLES[path, most] = WordTable(path, most)
    return _TABLES[path, most]


def encode_partition(path: str, end_id: int, most: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = word_table(path, most)
            for at, many in slices(batch["text"], ROWS_A_BATCH, BYTES_A_BATCH):
                rows = batch.slice(at, many)
                found, ends = table.encode(rows["text"])
                values = np.insert(found, ends[1:], end_id).view("<i4")
                ids = pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["tie"], rows["part"], ids], names=["doc_id", "tie", "part", "ids"])

    return encode


def write_token_orc(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, most_words: int = TABLE_WORDS, stripe_bytes: int = STRIPE_BYTES, stride_rows: int = STRIDE_ROWS) -> None:
    """Write (doc_id, tie, part, ids) in ascending id order; ``part`` is the range a document is in.

    Rows of one id are ordered, and dealt over ranges, by a hash of the text; equal rows, which
    may stand in any order, by a number of each row. Both are computed before the exchange, so no
    id, null or repeated, has to fit into one range."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    order = ("doc_id", "tie", "_row")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "tie", F.spark_partition_id().alias("part"), "text")
    ids = ordered.mapInArrow(encode_partition(path, end_id, most_words), TOKENS)
    indexed = {"orc.create.index": "true", "orc.row.index.stride": stride_rows, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": stripe_bytes}
    ids.write.options(compression="zstd", **indexed).orc(folder)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        view = memoryview(np.ascontiguousarray(values)).cast("B")
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        lengths = np.diff(ends).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], batch["part"], pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "tie", "part", "n_tokens", "ids_crc32"])


def read_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TOKENS).orc(folder)


def lookup_tokens(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents. The condition reaches the ORC reader,
    which tests it against each stripe's range, row index and Bloom filter."""
    return read_token_orc(spark, folder).filter(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files.

    Running sums inside each range, then the ranges' own offsets: one row for
    each range of documents, the only rows that meet in one task."""
    rows = cut(tokens.mapInArrow(_checksums, "doc_id long, tie long, part int, n_tokens long, ids_crc32 long"), "token_index")  # used twice below
    inside = Window.partitionBy("part").orderBy("doc_id", "tie", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_from"))
    return rows.join(parts, "part").select("doc_id", (F.col("_from") + F.col("_ahead")).alias("start"), "n_tokens", "ids_crc32")


def tokens_through_orc(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    folder = shared_folder(spark) + "/token_orc"
    write_token_orc(docs, folder, id_col, text_col, tokenizer, end_id)
    return token_index(read_token_orc(spark, folder))
