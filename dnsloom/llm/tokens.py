"""Token-id output in Parquet lists, written for selective reads.

A file holds documents in ascending id order, one row each: doc_id, n_tokens,
part and place (the file's and the row's order), ids (a list column). Files
cover disjoint id ranges, row groups and pages are small, and the footers and
page indexes carry the bounds of doc_id and place, so a reader of a few
documents opens a few pages only, and a reader of the metadata never touches
ids. Format version 2 gives delta packing to doc_id, place and n_tokens, where a
dictionary does not pay; ids are dictionary-coded. A small index beside the rows
says how many ids come before each file.

Units: the vocabulary splits at white space and between letters, digits and
signs, so each distinct unit is encoded once per worker by the tokenizers
library and remembered; a text's ids are its units' ids in turn (a test holds
this against encoding whole texts). A vocabulary that splits otherwise is
noticed, and its texts go to the library whole.

Null text: empty, only the end id. Null ids sort first; of equal ids the order
is by text. Repeated rows are documents of their own. A very long text is one
row, held whole by one task. Of other columns none is read, whatever their
names. An empty table gives files with no rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import few_rows_within, flat_bytes, portions, run_hashes, settle, shared_dir, spread

#: Options of the Parquet writer: row groups and pages that a selective read can skip.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: A worker forgets its units beyond so many.
REMEMBER = 1_600_000
PUNCTUATION = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
#: Bytes of text in a file, about.
FILE_BYTES = 16 << 20
ROWS = "doc_id long, n_tokens long, part int, place long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """Ids by 64-bit key: open addressing over arrays, so that many keys are looked up at once."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.keys, self.entry = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)
        self.begin, self.size = np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int64)
        self.ids = np.zeros(1 << 12, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), keys & mask
        while len(todo):
            here = self.keys[slot]
            same = here == keys[todo]
            out[todo[same]] = self.entry[slot[same]]
            on = ~same & (here != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.entry[slot[won]] = keys[won], entries[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, entries, slot = keys[left], entries[left], (slot[left] + np.uint64(1)) & mask

    def add(self, ids: list[np.ndarray], keys: np.ndarray | None = None) -> np.ndarray:
        """Stores lists of ids, under ``keys`` if given (new ones, not 0), and returns their entries."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        entries = np.arange(self.n, self.n + len(ids))
        while self.n + len(ids) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.begin[entries] = self.used + np.cumsum(sizes) - sizes
        self.size[entries] = sizes
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(ids)
        self.n, self.used = self.n + len(ids), self.used + total
        if keys is not None:
            if 2 * self.n > len(self.keys):
                old = self.keys != 0
                held, named = self.keys[old], self.entry[old]
                while 2 * self.n > len(self.keys):
                    self.keys = np.zeros(2 * len(self.keys), np.uint64)
                self.entry = np.zeros(len(self.keys), np.int32)
                self._place(held, named)
            self._place(keys, entries.astype(np.int32))
        return entries

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in turn, and where each entry's begin (one more than entries)."""
        sizes = self.size[entries]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.begin[entries] - ends[:-1], sizes)], ends


class UnitEncoder:
    """Encodes texts of a tokenizer that lower-cases and never joins across white space, unit by unit.

    A unit is a run of ASCII letters, one digit or a run of other ASCII signs
    within a white-space word: the vocabulary's own pre-tokens. A word with an
    apostrophe or with any byte beyond ASCII is one unit, whatever is in it.
    The library encodes each unit once per worker; it is remembered by a 64-bit
    hash of its bytes, ASCII letters in lower case. Texts where the library's
    idea of white space or lower case depends on more than a unit (information
    separators, capital sigma) and texts that hold a special token go to the
    library whole. ``sound`` tells whether the vocabulary is of this kind; with
    any other one all texts go to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.sound = self._splits_so()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])
        special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", "\u03a3".encode(), *special]
        self.end_id = end_id
        self._forget()

    def _splits_so(self) -> bool:
        """Whether the tokenizer normalises and splits as units need it: tried on texts of all kinds of neighbours."""
        tries = ["aB c1d22e ,.x!y", "x--y(z) 3,5 a's b're", "Q\t\nq  %%% a.b.", "é.É, naïve!? 1é2"]
        cut = re.compile(r"[a-zA-Z]+|[0-9]|[^\sa-zA-Z0-9]+")
        split = lambda w: [w] if "'" in w or not w.isascii() else cut.findall(w)
        return all(self._whole(t).tolist() == [i for w in t.split() for u in split(w) for i in self._whole(u.lower()).tolist()] for t in tries)

    def _forget(self) -> None:
        self.known = Remembered()
        self.end = self.known.add([np.array([self.end_id], np.int32)])[0]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def _ids_of(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of each unit. Letters are encoded many to a call and told apart by the end-of-word tokens."""
        texts = [u.decode() for u in units]
        core = [t.rstrip(PUNCTUATION) for t in texts]
        letters = sorted({c for c in core if c.isalpha() and c.lower().isalpha()})
        got: dict[str, np.ndarray] = {}
        for at in range(0, len(letters), 256):
            some = letters[at : at + 256]
            ids = self._whole(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                begin = [0, *cuts.tolist()]
                got.update((w, ids[x:y]) for w, x, y in zip(some, begin, begin[1:], strict=False))
            else:
                got.update((w, self._whole(w)) for w in some)
        tails = {t[len(c) :] for t, c in zip(texts, core, strict=True)}
        tail = {t: self._whole(t) for t in tails}
        return [(got[c] if len(c) == len(t) else np.concatenate([got[c], tail[t[len(c) :]]])) if c in got else self._whole(t) for t, c in zip(texts, core, strict=True)]

    def batch(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes ``raw``, texts beginning at ``at``), the end id after each, and where each text's ids begin."""
        data = raw.tobytes()
        n = len(at) - 1
        if not self.sound:
            odd = np.arange(n)
        else:
            some = [x for x in self.odd if x in data]
            ranges = zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if some else ()
            odd = np.flatnonzero([any(data.find(x, a, b) >= 0 for x in some) for a, b in ranges])
        keys, begin, span = unit_hashes(data, at)
        entry = self.known.find(keys)
        if (entry < 0).any():
            fresh, first = np.unique(keys[entry < 0], return_index=True)
            if self.known.n + len(fresh) > REMEMBER:
                self._forget()
                fresh, first = np.unique(keys, return_index=True)
                where = first
            else:
                where = np.flatnonzero(entry < 0)[first]
            low = data.translate(_LOWER)
            self.known.add(self._ids_of([low[a:b] for a, b in span[where].tolist()]), fresh)
            entry = self.known.find(keys)
        if len(odd):
            whole = self.known.add([self._whole(data[at[i] : at[i + 1]].decode()) for i in odd.tolist()])
            sizes = np.diff(begin)
            keep = np.ones(n, bool)
            keep[odd] = False
            entry = entry[np.repeat(keep, sizes)]
            sizes[odd] = 0
            begin = np.concatenate([[0], np.cumsum(sizes)])
            entry = np.insert(entry, begin[odd], whole)
            sizes[odd] = 1
            begin = np.concatenate([[0], np.cumsum(sizes)])
        ids, ends = self.known.gather(np.insert(entry, begin[1:], self.end))
        return ids, ends[begin + np.arange(n + 1)]


#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 signs, 4 the apostrophe, 5 beyond ASCII.
_KIND = bytes(0 if c == 32 or 9 <= c <= 13 else 5 if c > 127 else 2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 or 97 <= c <= 122 else 4 if c == 39 else 3 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def unit_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the units of every text (see ``UnitEncoder``), where each text's units begin, and each unit's first byte and the byte after it (n x 2)."""
    kind = np.frombuffer(data.translate(_KIND), np.uint8)
    edge = at[:-1][at[:-1] < len(kind)]
    before = np.zeros(len(kind), np.uint8)
    before[1:] = kind[:-1]
    before[edge] = 0
    solid = kind != 0
    word = solid & (before == 0)
    opens = solid & ((kind != before) | (kind == 2))
    odd = np.flatnonzero(kind >= 4)
    if len(odd):
        w = np.flatnonzero(word)
        mine = np.unique(np.searchsorted(w, odd, "right") - 1)
        step = np.zeros(len(kind) + 1, np.int8)
        step[w[mine] + 1] += 1
        step[np.append(w, len(kind))[mine + 1]] -= 1
        opens &= word | (np.cumsum(step[:-1], dtype=np.int8) == 0)
    u = np.flatnonzero(opens)
    begin = np.searchsorted(u, at, "left")
    if not len(u):
        return np.zeros(0, np.uint64), begin, np.zeros((0, 2), np.int64)
    low = np.frombuffer(data.translate(_LOWER), np.uint8)
    keys, size = run_hashes(low[u[0] :], solid[u[0] :], u - u[0])
    keys[keys == 0] = 1
    return keys, begin, np.stack([u, u + size], axis=1)


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, end_id: int) -> UnitEncoder:
    """This process's encoder: tasks that follow one another in a worker share what it has learnt."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = UnitEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def _encode(path: str, end_id: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
        enc = encoder(path, end_id)
        for batch in batches:
            raw, at = flat_bytes(batch.column(1))
            for a, b in portions(np.diff(at), 512 << 10):
                ids, ends = enc.batch(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), column], schema=schema)

    return run


def write_token_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, file_bytes: int = FILE_BYTES) -> str:
    """Encode ``docs`` and write them below ``path``: /rows with the ids, /index with each file's place in the whole. Returns ``path``.

    Texts are put in order first and encoded where they end up, each once. Ids
    before a file are a running sum over files (a row per file, not per document).
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    files = spread(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, file_bytes, 12)
    order = [F.col("doc_id").asc_nulls_first()]
    placed = source.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    encoded = placed.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), "doc_id long, n_tokens long, ids array<int>")
    rows = encoded.select("doc_id", "n_tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "ids")
    with few_rows_within(spark):
        rows.write.options(**LAYOUT).parquet(f"{path}/rows")
    per_file = spark.read.schema(ROWS).parquet(f"{path}/rows").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_file.select("part", before.alias("part_start")).coalesce(1).write.parquet(f"{path}/index")
    return path


def read_token_ids(spark, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The written documents; only the pages of ``columns`` are read. ``start`` is worked out from the file index."""
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    if "start" not in columns:
        return rows.select(*columns)
    needed = dict.fromkeys([*(c for c in columns if c != "start"), "n_tokens", "part", "place"])
    return _started(spark, path, rows.select(*needed)).select(*columns)


def _started(spark, path: str, rows: DataFrame) -> DataFrame:
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    index = spark.read.schema("part int, part_start long").parquet(f"{path}/index")
    placed = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(index, "part").withColumn("start", F.col("part_start") + F.col("_in"))


def _checksums(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64()), batch.column("part"), batch.column("place")], schema=schema)


def digest(spark, path: str) -> DataFrame:
    """From the written files: doc_id, start, n_tokens and ids_crc32 (little-endian unsigned 32-bit ids)."""
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows").select("doc_id", "ids", "part", "place")
    with few_rows_within(spark):  # the lists are read here; what is settled has none
        summed = settle(rows.mapInArrow(_checksums, "doc_id long, n_tokens long, ids_crc32 long, part int, place long"), "summed")
    return _started(spark, path, summed).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(spark, write_token_ids(docs, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"))
