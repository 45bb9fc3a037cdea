"""SentencePiece encoding and decoding by a distinct-chunk table.

The model marks white space: a blank becomes the marker U+2581, and one stands
before the text. No piece of the model has a marker after another character, so
no merge crosses into a marker run and every chunk, a marker run with what
follows it, is segmented alike wherever it stands. A task therefore keeps a
table of distinct chunks, segments each new one once and joins the ids back by
position. The table is bounded and begun anew when full, so memory does not
grow with the data, nothing is shuffled, and a lost task is simply run again.

``encode_by_table`` keeps one table for the whole cluster instead: the distinct
chunks are shuffled, segmented once, and joined back to their places by another
shuffle. It gives the same ids; what it costs is in the README.

Defined cases: null text is empty (no ids, empty decoding); a literal U+2581 is
a marker, as in the library; rows keep their number and ids of documents may
repeat or be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.storage import cut, numbered

MARK = "▁"
#: Chunks a task remembers before it starts a new table; those of one batch are always held, however many.
TABLE_CHUNKS = 400_000
ROWS_A_BATCH = 256
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*").findall


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of chunks. A chunk is named by its text without the first marker."""

    def __init__(self, path: str, most: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.ids, self.told = most, {}, {}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("pieces of this model cross white-space markers")

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return words
        return [x[1:].replace(MARK, " ") for x in _CHUNK(MARK + text.replace(" ", MARK))]

    def _missing(self, chunks: set[str]) -> set[str]:
        """The chunks to be learned, with room made for them: all of them if the table is begun anew."""
        unknown = chunks.difference(self.ids)
        if unknown and len(self.ids) + len(unknown) > self.most:
            self.ids.clear()
            self.told.clear()
            return chunks
        return unknown

    def _learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1)):
            ids = ids or [self.model.piece_to_id(MARK)]
            self.ids[chunk] = ids
            self.told[chunk] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of them in the table."""
        split = [self.chunks(text) for text in texts]
        unknown = self._missing(set().union(*split))
        if unknown:
            self._learn(unknown)
        return split


_TABLES: dict[tuple[str, int], ChunkTable] = {}


def chunk_table(path: str, most: int = TABLE_CHUNKS) -> ChunkTable:
    if (path, most) not in _TABLES:
        _TABLES[path, most] = ChunkTable(path, most)
    return _TABLES[path, most]


def _encode(path: str, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = chunk_table(path, most)
            for at in range(0, batch.num_rows, ROWS_A_BATCH):
                rows = batch.slice(at, ROWS_A_BATCH)
                split = table.encode(rows["text"].to_pylist())
                ids = [list(chain.from_iterable(map(table.ids.__getitem__, x))) for x in split]
                if with_ids:
                    out = [pa.array(ids, pa.list_(pa.int32()))]
                    names = ["ids"]
                else:
                    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                    told = [sha(",".join(map(table.told.__getitem__, x))) for x in split]
                    decoded = [sha(table.model.decode(x)) if x else sha("") for x in ids]
                    out = [pa.array(map(len, ids), pa.int64()), pa.array(told), pa.array(decoded)]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], *out], names=["doc_id", *names])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, most: int = TABLE_CHUNKS) -> DataFrame:
    """doc_id and ids of each document."""
    return _texts(docs, id_col, text_col).mapInArrow(_encode(model or default_model(), most, True), "doc_id long, ids array<int>")


def _places(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = chunk_table(path).chunks
            rows, names, places = [], [], []
            for row, text in zip(batch["_row"].to_pylist(), batch["text"].to_pylist()):
                found: dict[str, list[int]] = {}
                for place, chunk in enumerate(split(text)):
                    found.setdefault(chunk, []).append(place)
                rows.extend([row] * len(found))
                names.extend(found)
                places.extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["_row", "chunk", "places"])

    return run


def _segmented(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = chunk_table(path).model
            mark = model.piece_to_id(MARK)
            ids = [x or [mark] for x in model.encode(batch["chunk"].to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "ids"])

    return run


def _joined_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for met in batch["met"].to_pylist():
            at = {place: x["ids"] for x in met or () for place in x["places"]}
            out.append(list(chain.from_iterable(at[k] for k in range(len(at)))))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode_by_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id and ids of each document by one chunk table of the whole cluster."""
    path = model or default_model()
    rows = numbered(_texts(docs, id_col, text_col), "sentencepiece_rows")
    places = cut(rows.select("_row", "text").mapInArrow(_places(path), "_row long, chunk string, places array<int>"), "chunk_places")
    table = cut(places.select("chunk").distinct().mapInArrow(_segmented(path), "chunk string, ids array<int>"), "chunk_table")
    met = places.join(table, "chunk").groupBy("_row").agg(F.collect_list(F.struct("places", "ids")).alias("met"))
    return rows.select("_row", "doc_id").join(met, "_row", "left").select("doc_id", "met").mapInArrow(_joined_back, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and decoded text of (doc_id, ids)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            processor = chunk_table(path).model
            texts = [processor.decode(ids) if ids else "" for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, most: int = TABLE_CHUNKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 in one pass."""
    return _texts(docs, id_col, text_col).mapInArrow(_encode(model or default_model(), most, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
