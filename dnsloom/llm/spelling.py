"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted over all documents, with partial counts in each task. For
each word, edits are generated whose result could be another word: every
deletion, and every replacement by a letter that comes later in code-point
order. Of two near words of one length the one with the smaller letter generates
the other; of two whose lengths differ by one the longer generates the shorter
by a deletion. So each near pair comes up exactly once, and insertions need not
be generated.

An edit's hash follows from its word's hash by arithmetic, so edits are arrays of
numbers. They are probed against Bloom filters of the vocabulary: one filter per
length, cut into parts of at most ``PART_WORDS`` words, each filter an array of
64-bit blocks of which a key sets four bits in one. Only edits that a filter
admits become text and shuffle, to an exact join with the vocabulary, which
removes false positives. Filters are broadcast in passes of at most ``SENT``
bytes, so what is broadcast is bounded whatever the vocabulary.

A form has at least ``ratio`` times the occurrences of its word, so chains of
forms are short; roots are found by pointer doubling, a join per doubling.

Null and blank texts have no words. A null id counts as an empty text before the
colon. Repeated rows count each time. Ties between forms go to the smaller word
in code-point order. Very long texts are read by pieces of their matches; words of
any length take part (those of ``LENGTHS`` code points or more share a filter).
Empty tables give an empty result; other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import FOLD_AZ, M64, arrow_rows, mix64, scratch, settle

#: Distinct words that a task counts before it hands them on.
HELD = 500_000
#: Words of a part of a filter, bits for each, bytes of filters broadcast at once, lengths told apart.
PART_WORDS, BITS, SENT, LENGTHS = 1_000_000, 16, 64 << 20, 64
#: Letters of words handled at once.
CELLS = 1 << 18
#: Texts from so many characters on are searched match by match.
LONG = 1 << 20
P = np.uint64(0x9E3779B97F4A7C15)
LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def occurrences(doc_id, text: str, least: int, every: int) -> Counter:
    """Words of a text: lower-cased runs of letters, some of them with a letter less, of ``least`` letters or more."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    low = text.encode().translate(FOLD_AZ).decode()
    runs = Counter(run.findall(low) if len(low) < LONG else (m.group() for m in run.finditer(low)))
    head = zlib.crc32(("" if doc_id is None else f"{doc_id}").encode() + b":")
    out: Counter = Counter()
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), head)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        out[word] += n
    return out


def _counted(least: int, every: int):
    def run(batches):
        held: dict[str, int] = {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in occurrences(doc_id, text, least, every).items() if text else ():
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield rows()
                    held = {}
        yield rows()

    return run


def vocabulary(docs: DataFrame, *, least: int = 6, often: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of ``least`` letters and ``often`` occurrences, counted over all documents."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def by_length(words: list[str]):
    """Places of the words of each length, and their letters as numbers (words by letters), ``CELLS`` letters at once."""
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size).tolist():
        places = np.flatnonzero(size == length)
        step = max(1, CELLS // length)
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, np.array([words[i] for i in some.tolist()], f"<U{length}").view(np.uint32).reshape(-1, length)


def _weights(length: int) -> np.ndarray:
    """What the letter at each place of a word of this length is multiplied by."""
    powers = np.ones(length, np.uint64)
    powers[1:] = P
    return np.cumprod(powers, dtype=np.uint64)[::-1]


def keys(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix64(hashes + np.uint64(length * 0xA0761D6478BD642F & M64))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(33)) % np.uint64(parts)


def _bits(key: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    out = one << (key & np.uint64(63))
    for shift in (6, 12, 18):
        out |= one << ((key >> np.uint64(shift)) & np.uint64(63))
    return out


def bloom(key: np.ndarray) -> np.ndarray:
    """A filter of 64-bit blocks that admits every key."""
    blocks = np.zeros(max(1, len(key) * BITS // 64), np.uint64)
    np.bitwise_or.at(blocks, _block(key, len(blocks)), _bits(key))
    return blocks


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def admits(blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = _bits(key)
    return (blocks[_block(key, len(blocks))] & bits) == bits


def shard_of(length: int) -> int:
    return min(length, LENGTHS)


def _shard_keys(parts: dict[int, int]):
    def run(batches):
        for batch in batches:
            for _, codes in by_length(batch.column("word").to_pylist()):
                length = codes.shape[1]
                key = keys((LETTER[codes & 255] * _weights(length)).sum(axis=1, dtype=np.uint64), length)
                shard = shard_of(length)
                part = part_of(key, parts[shard]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), shard, np.int32)), pa.array(part), pa.array(key.view(np.int64))], ["shard", "part", "key"])

    return run


def edits(codes: np.ndarray, alphabet: np.ndarray, least: int):
    """Of words of one length: (length, hashes, rows, places, letter) of every deletion (letter None) and of replacements by later letters."""
    length = codes.shape[1]
    weight = _weights(length)
    own = LETTER[codes & 255]
    term = own * weight
    whole = term.sum(axis=1, dtype=np.uint64)
    if length > least:
        before = np.zeros_like(term)
        before[:, 1:] = np.cumsum(own[:, :-1] * weight[1:], axis=1, dtype=np.uint64)  # a letter before the gap moves one place on
        after = whole[:, None] - np.cumsum(term, axis=1, dtype=np.uint64)
        fresh = np.ones(codes.shape, bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of a run of one letter, deleting any gives the same word
        rows, places = np.nonzero(fresh)
        yield length - 1, (before + after)[rows, places], rows, places, None
    for letter in alphabet.tolist():
        rows, places = np.nonzero(codes < letter)
        yield length, whole[rows] + (LETTER[letter & 255] - own[rows, places]) * weight[places], rows, places, letter


def written(codes: np.ndarray, rows: np.ndarray, places: np.ndarray, letter: int | None) -> list[str]:
    """The edited words."""
    out = codes[rows]
    if letter is None:
        kept = np.arange(out.shape[1])[None, :] != places[:, None]
        out = out[kept].reshape(len(rows), -1)
    else:
        out[np.arange(len(rows)), places] = letter
    return np.ascontiguousarray(out).view(f"<U{out.shape[1]}").ravel().tolist()


def _probe(sent, parts: dict[int, int], alphabet: np.ndarray, least: int):
    """word, n, near: the edits of words that a filter of this pass admits."""

    def run(batches):
        filters = {k: np.frombuffer(b, np.uint64) for k, b in sent.value.items()}
        for batch in batches:
            count = batch.column("n").to_numpy(zero_copy_only=False)
            words = batch.column("word").to_pylist()
            for some, codes in by_length(words):
                for length, hashes, rows, places, letter in edits(codes, alphabet, least):
                    shard = shard_of(length)
                    key = keys(hashes, length)
                    part = part_of(key, parts[shard]) if parts.get(shard, 0) > 1 else None
                    for p in range(parts.get(shard, 0)):
                        if (shard, p) in filters:
                            own = np.arange(len(key)) if part is None else np.flatnonzero(part == p)
                            hit = own[admits(filters[shard, p], key[own])]
                            if len(hit):
                                at = some[rows[hit]]
                                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(at)), pa.array(count[at]), pa.array(written(codes, rows[hit], places[hit], letter), pa.string())], ["word", "n", "near"])

    return run


def _filter(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "part": [frame["part"].iloc[0]], "blocks": [bloom(frame["key"].to_numpy().view(np.uint64)).tobytes()]})


def _letters(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set("".join(batch.column("word").to_pylist()))), pa.string())], ["letter"])


def near_pairs(vocab: DataFrame, *, least: int = 6, part_words: int | None = None, most_sent: int | None = None) -> DataFrame:
    """word, n, near, near_n: every pair of words that differ by one inserted, deleted or replaced code point, once. ``vocab``: word (letters of
    code points below 256), n; a stored table, as it is read several times."""
    spark = vocab.sparkSession
    shard = F.least(F.length("word"), F.lit(LENGTHS)).alias("shard")
    parts = {r[0]: -(-r[1] // (part_words or PART_WORDS)) for r in vocab.groupBy(shard).count().collect()}  # a row per length
    alphabet = np.array(sorted(ord(r[0]) for r in vocab.mapInArrow(_letters, "letter string").distinct().collect()), np.uint32)  # 256 at most
    made = settle(vocab.mapInArrow(_shard_keys(parts), "shard int, part int, key long").groupBy("shard", "part").applyInPandas(_filter, "shard int, part int, blocks binary"), "filters")
    passes, room = [[]], most_sent or SENT
    for key in sorted((r.shard, r.part, r.size) for r in made.select("shard", "part", F.octet_length("blocks").alias("size")).collect()):
        if passes[-1] and room < key[2]:
            passes.append([])
            room = most_sent or SENT
        passes[-1].append(key)
        room -= key[2]
    confirmed = None
    for some in passes:
        wanted = made.filter(F.struct("shard", "part").isin([F.struct(F.lit(s), F.lit(p)) for s, p, _ in some])) if len(passes) > 1 else made
        sent = spark.sparkContext.broadcast({(r.shard, r.part): bytes(r.blocks) for r in wanted.collect()})
        positives = settle(vocab.mapInArrow(_probe(sent, parts, alphabet, least), "word string, n long, near string"), "positives")
        sent.destroy()
        exact = positives.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
        confirmed = exact if confirmed is None else confirmed.unionByName(exact)
    return confirmed


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n: each word's most frequent near word, if it is ``ratio`` times as frequent."""
    side = lambda w, n, o, m: F.struct(F.col(w).alias("word"), F.struct((-F.col(m)).alias("less"), F.col(o).alias("word")).alias("other"))
    both = pairs.select(F.explode(F.array(side("word", "n", "near", "near_n"), side("near", "near_n", "word", "n"))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    found = vocab.join(best, "word", "left").withColumn("_m", -F.col("best.less"))
    good = F.col("_m") >= F.lit(ratio) * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, F.col("_m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``formed`` with root: the last word along the forms; the word itself without one."""
    now = settle(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = settle(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = step.drop("_moved")
        if not step.filter("_moved").take(1):
            return formed.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, *, least: int = 6, often: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents. Call it within ``scratch``, or delete its tables yourself."""
    with arrow_rows(docs.sparkSession, 1000):
        vocab = settle(vocabulary(docs, least=least, often=often, every=every, id_col=id_col, text_col=text_col), "vocabulary")
    formed = settle(forms(vocab, near_pairs(vocab, least=least), ratio), "forms")
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return settle(group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet")), "variants", keep=True)


# A crc32 is the exclusive or of what each byte gives at its distance from the end, and of what the length alone gives.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT b::BIGINT AS b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)),
top AS (SELECT max(strlen(text)) + 32 AS most FROM documents),
runs AS (SELECT doc_id, w, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
byt AS (SELECT row_number() OVER () AS rid, w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs),
far AS (SELECT max(length(h)) // 2 AS m FROM byt),
c AS (SELECT 0 AS k, b, v FROM t UNION ALL SELECT k + 1, c.b, xor(c.v >> 8, t.v) FROM c JOIN t ON t.b = c.v & 255 WHERE k < (SELECT m FROM far)),
z AS (SELECT 0 AS k, 4294967295::BIGINT AS v UNION ALL SELECT k + 1, xor(z.v >> 8, t.v) FROM z JOIN t ON t.b = z.v & 255 WHERE k < (SELECT m FROM far)),
x AS (SELECT rid, bit_xor(c.v) AS v FROM (SELECT rid, length(h) // 2 - i AS k, ('0x' || substr(h, 2 * i - 1, 2))::BIGINT AS b FROM (SELECT rid, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM byt)) p JOIN c ON c.k = p.k AND c.b = p.b GROUP BY rid),
hs AS (SELECT w, n, xor(xor(x.v, z.v), 4294967295::BIGINT) AS h FROM byt JOIN x USING (rid) JOIN z ON z.k = length(byt.h) // 2),
ed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hs),
v AS (SELECT word, sum(n)::BIGINT AS n FROM ed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
pl AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
mk AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM pl),
near AS (SELECT p.word, p.n, q.word AS near, q.n AS m FROM mk p JOIN mk q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND p.word <> q.word
  UNION SELECT p.word, p.n, q.word, q.n FROM mk p JOIN v q ON q.word = p.a || p.z UNION SELECT q.word, q.n, p.word, p.n FROM mk p JOIN v q ON q.word = p.a || p.z),
nb AS (SELECT word, n, count(*)::BIGINT AS n_near, (array_agg(near ORDER BY m DESC, near))[1] AS near, max(m) AS m FROM near GROUP BY word, n),
fm AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN nb ON nb.word = v.word),
walk AS (SELECT word, word AS at FROM fm UNION ALL SELECT walk.word, fm.form FROM walk JOIN fm ON fm.word = walk.at WHERE fm.form IS NOT NULL)
SELECT fm.word, fm.form, walk.at AS root, fm.n, fm.n_near, fm.form_n FROM fm JOIN walk ON walk.word = fm.word JOIN fm l ON l.word = walk.at AND l.form IS NULL
"""
