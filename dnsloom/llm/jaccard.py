"""Exact Jaccard self-join over word n-grams with a token-group matrix.

A document's set holds the hashes (64 bits) of its distinct word n-grams; equal
sets are one class. Two sets link when num * |union| <= den * |intersection|.

Partition. A set's tokens fall into m parts by hash. Linked sets differ in at
most d tokens, d following from their sizes, and m exceeds d, so at least one
part is the same in both (m is chosen per class of sizes, each set takes part
in its own class and in the next smaller one, empty parts are allowed for, and
a set with more empty parts than that also shares the part of such sets). A set
that shares a part with another one belongs to the group of its most
frequent part; a group is cut into cells of bounded members and tokens.

Matrix. A group is stored as one row: the union of its members' tokens, and for
each member its columns in that union.

Search. Two groups can hold a link only if they have enough parts in common (a
set with few empty parts shares several with any linked one). For such a pair
each member's overlap with the other group's union is counted, which
bounds its overlap with any member there. A group is opened only for members
whose bound reaches the threshold; what is opened is compared exactly, as a
product of 0-1 matrices. The links of an opened pair are returned as a forest.

Order of work. Groups are opened by themselves and against the next group along
each part, which joins most of what belongs together; then only pairs of groups
that are not of one component yet are opened. Groups are dealt to tasks in
pairs, and a group that meets many others goes to several tasks.

Null, empty or blank texts: empty set, linked with nothing. Texts of fewer
words than n: the whole sequence is the one n-gram. A very long text is a
group of its own, or one with few others. Repeated rows and ids are documents
of their own, linked by their texts. A null id takes part in links but names no
component; a component of null ids only has none. Other columns are not read,
whatever their names (``keep_one`` passes them through; it uses names with
``_nj_``). Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import HOT, HOT_KEYS, arrow_rows, flat_bytes, hot_join, mix64, portions, release, scratch, settle, word_hashes
from dnsloom.llm.graph import components

#: Members of a cell of a large group, and tokens of a member there on average at most.
CELL, CELL_TOKENS = 256, 512
#: Numbers in a strip of the 0-1 matrices; pairs for which one task gets a group.
STRIP_CELLS, MEETS = 1 << 22, 64
#: Equal sets that a task remembers, and the share of sets that tells frequent parts.
SEEN, GLANCE = 1_000_000, 64
#: Members of groups that are broadcast to find their texts, at most.
LISTED = 2_000_000


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a row's word n-grams; of the whole row if it has fewer words."""
    k = min(n, len(words))
    if not k:
        return words
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : len(words) - k + 1 + j]
    return np.unique(mix64(total + np.uint64(k)))


class Sizes:
    """Classes of set sizes for a threshold num/den, and what a class needs."""

    def __init__(self, num: int, den: int, longest: int = 1 << 34):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < longest:
            self.low.append(self.low[-1] * den // num + 1)
        self._low = np.array(self.low)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self._low, n, "right")) - 1

    def parts(self, cls: int) -> tuple[int, int]:
        """Number of parts, and how many of them may be empty."""
        d = (self.den - self.num) * (self.low[cls + 1] - 1) // self.num
        mean = self.num / (self.den - self.num) * 0.75  # tokens a part has at least, about
        spare = 3 + int(d * np.exp(-mean) * 1.5)
        return d + 1 + spare, spare


def part_keys(tokens: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, int]:
    """Keys of a set's parts, and how many of them any linked set has at least. Tokens are scrambled already."""
    own, keys, need = sizes.of(len(tokens)), [], []
    for cls in (own, own - 1):
        if cls < 0:
            continue
        m, spare = sizes.parts(cls)
        part = (tokens % np.uint64(m)).astype(np.int64)
        count = np.bincount(part, minlength=m)
        total = np.zeros(m, np.uint64)
        np.add.at(total, part, mix64(tokens))
        full = np.flatnonzero(count)
        salt = np.uint64((cls * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        keys.append(mix64(total[full] + full.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + salt))
        # At most m - 1 - spare parts differ; of the others some may be empty.
        need.append(1 + spare - (m - len(full)))
        if need[-1] < 1:
            keys.append(mix64(np.array([salt ^ np.uint64(0x5851F42D4C957F2D)])))
    return np.concatenate(keys), max(1, min(need))


def _sets(batch_texts: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each text, in order."""
    raw, at = flat_bytes(batch_texts)
    for a, b in portions(np.diff(at), 512 << 10):
        words, begin, _ = word_hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a], lower=True)
        for i in range(b - a):
            yield ngrams(words[begin[i] : begin[i + 1]], n)


def fingerprint(tokens: np.ndarray) -> int:
    return int((mix64(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))).view(np.int64)) if len(tokens) else 0


def sketches(docs: DataFrame, n: int, sizes: Sizes, id_col: str, text_col: str) -> DataFrame:
    """id, tid (hash of the text), size, print (of the set; 0 if empty), keys of its parts and how many a linked set shares at least (once per task for equal sets, so copies do not multiply them; else none and 0). Tokens are not kept: they are made anew from the few texts that are compared."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            size, prints, keys, need, begin = [], [], [], [], 0
            if len(seen) > SEEN:
                seen.clear()

            def out(upto):
                cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                cols = [*(batch.column(c).slice(begin, upto - begin) for c in (0, 1)), pa.array(size, pa.int64()), pa.array(prints, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), pa.array(need, pa.int32())]  # noqa: B023
                return pa.RecordBatch.from_arrays(cols, ["id", "tid", "size", "print", "keys", "need"])

            for i, tokens in enumerate(_sets(batch.column(2), n), 1):
                size.append(len(tokens))
                prints.append(fingerprint(tokens))
                fresh = len(tokens) > 0 and prints[-1] not in seen
                found = part_keys(tokens, sizes) if fresh else (tokens[:0], 0)
                keys.append(found[0])
                need.append(found[1])
                seen.add(prints[-1])
                if len(size) == 256:
                    yield out(i)
                    size, prints, keys, need, begin = [], [], [], [], i
            if size:
                yield out(len(batch))

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, tid long, size long, print long, keys array<long>, need int")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def _token_sets(members: DataFrame, docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """g, print and tokens of ``members`` (g, print, id, tid), made from one document of each class. The join goes by id and text, so copies of a text do not meet in one task."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                sets = pa.array([t.tobytes() for t in _sets(some.column(2), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), sets], ["g", "print", "tokens"])

    same = (F.col("t.tid") == F.col("m.tid")) & F.col("t.id").eqNullSafe(F.col("m.id"))
    # A list of at most LISTED rows (32 bytes each) goes to all tasks; beyond it, texts are shuffled to it.
    few = F.broadcast(members) if members.limit(LISTED + 1).count() <= LISTED else members
    wanted = _texts(docs, id_col, text_col).alias("t").join(few.alias("m"), same).select("m.g", "m.print", "t.text")
    return wanted.mapInArrow(run, "g long, print long, tokens binary").dropDuplicates(["print"])


GROUP = "g long, members binary, sizes binary, union binary, columns binary"


def _pack(batches):
    """From g, print, tokens, in order of g: a row per group with its token union and, per member, which of the union's tokens it has."""

    def row(g, prints, sets):
        union, columns = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.fromiter(map(len, sets), np.int32, len(sets))
        return [g, np.array(prints, np.int64).tobytes(), sizes.tobytes(), union.tobytes(), columns.astype(np.int32).tobytes()]

    def out(rows):
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["g", "members", "sizes", "union", "columns"])

    now, prints, sets = None, [], []
    for batch in batches:
        rows = []
        for g, one, tokens in zip(*(batch.column(c).to_pylist() for c in ("g", "print", "tokens")), strict=True):
            if g != now and sets:
                rows.append(row(now, prints, sets))
                prints, sets = [], []
            now = g
            prints.append(one)
            sets.append(np.frombuffer(tokens, np.uint64))
        if rows:
            yield out(rows)
    if sets:
        yield out([row(now, prints, sets)])


class Group:
    """A row of the token-group matrix: members, their set sizes, the union of their tokens, and each member's columns in it."""

    def __init__(self, members: bytes, sizes: bytes, union: bytes, columns: bytes):
        self.members, self.sizes = np.frombuffer(members, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.union, self.columns = np.frombuffer(union, np.uint64), np.frombuffer(columns, np.int32)
        self.row = np.repeat(np.arange(len(self.members)), self.sizes)


def _in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values that two sorted arrays share stand in each."""
    if len(a) > len(b):
        y, x = _in_order(b, a)
        return x, y
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
    return same, at[same]


def opened(a: Group, b: Group, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member of a, member of b, tokens in common) of the linked pairs.

    A member's overlap with the other group's union bounds its overlap with each
    member there; a group is opened only for members whose bound suffices, and
    only those of its members are looked at whose own bound does.
    """
    none = np.zeros(0, np.int64)
    if a is b:  # tokens that one member alone has are in no overlap
        in_a = in_b = np.flatnonzero(np.bincount(a.columns, minlength=len(a.union)) > 1)
    else:
        in_a, in_b = _in_order(a.union, b.union)
    if not len(in_a):
        return none, none, none
    sides = []
    for group, shared in ((a, in_a),) if a is b else ((a, in_a), (b, in_b)):
        column = np.full(len(group.union), -1, np.int64)
        column[shared] = np.arange(len(shared))
        column = column[group.columns]
        bound = np.bincount(group.row[column >= 0], minlength=len(group.members))
        fit = den * bound >= num * group.sizes
        sides.append((np.flatnonzero(fit), np.cumsum(fit) - 1, (column >= 0) & fit[group.row], column))
    sides = (sides * 2)[:2]
    (qa, pa_, ka, ca), (qb, pb, kb, cb) = sides
    if not len(qa) or not len(qb):
        return none, none, none
    ra, xa, rb, xb = pa_[a.row[ka]], ca[ka], pb[b.row[kb]], cb[kb]
    common = np.zeros((len(qa), len(qb)))
    strip = min(len(in_a), max(256, STRIP_CELLS // (len(qa) + len(qb))))
    for at in range(0, len(in_a), strip):
        # Products of 0 and 1: exact in float32 up to 2^24 columns.
        left, right = np.zeros((len(qa), strip), np.float32), np.zeros((len(qb), strip), np.float32)
        ia, ib = (xa >= at) & (xa < at + strip), (xb >= at) & (xb < at + strip)
        left[ra[ia], xa[ia] - at] = 1
        if a is not b:
            right[rb[ib], xb[ib] - at] = 1
        common += left @ (left if a is b else right).T
    sa, sb = a.sizes[qa][:, None], b.sizes[qb][None, :]
    x, y = np.nonzero(den * common >= num * (sa + sb - common))
    return qa[x], qb[y], common[x, y].astype(np.int64)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as the links given, one for each node but the smallest of a component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = flat[: len(u)], flat[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = low.copy()
        np.minimum.at(least, x, low[y])
        np.minimum.at(least, y, low[x])
        least = least[least]
        if (least == low).all():
            break
        low = least
    rest = low != np.arange(len(nodes))
    return nodes[rest], nodes[low[rest]]


def _links_between(num: int, den: int):
    """From rows of two groups each (a_..., b_...; of one group only, where g equals h): links (u > v) that connect what is linked."""
    fields = ("members", "sizes", "union", "columns")

    def run(batches):
        for batch in batches:
            us, vs = [], []
            side = lambda s: zip(*(batch.column(f"{s}_{f}") for f in fields), strict=True)  # noqa: B023, E731
            for a, b in zip(side("a"), side("b"), strict=True):
                one = Group(*(x.as_buffer() for x in a))
                two = Group(*(x.as_buffer() for x in b)) if b[0].is_valid else one
                x, y, _ = opened(one, two, num, den)
                u, v = one.members[x], two.members[y]
                if (u != v).any():
                    u, v = _forest(u[u != v], v[u != v])
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _open(pairs: DataFrame, groups: DataFrame, sizes: Sizes) -> DataFrame:
    """Links between the groups of each pair (g, h). A group that meets many others is sent to several tasks."""
    pairs = settle(pairs, "pairs")
    row = lambda s: groups.select(F.col("g").alias({"a": "g", "b": "h"}[s]), *[F.col(c).alias(f"{s}_{c}") for c in groups.columns[1:]])

    def attach(left: DataFrame, key: str, side: str) -> DataFrame:
        # A part of MEETS pairs each, so what one task reads of a group's rows is bounded.
        parts = F.ceil(F.col("n") / MEETS).cast("int")
        counts = settle(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, parts.alias("parts")), "counts")
        dealt = left.join(counts, key).withColumn("part", F.pmod(F.xxhash64("g", "h"), F.col("parts")).cast("int")).drop("parts")
        wide = row(side).join(counts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return dealt.join(wide, [key, "part"]).drop("part")

    both = attach(attach(pairs, "g", "a"), "h", "b")
    with arrow_rows(groups.sparkSession, 32):
        return settle(both.mapInArrow(_links_between(sizes.num, sizes.den), "u long, v long"), "links")


def classes(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """Per row of ``docs``: id, size (distinct n-grams), component (smallest id reachable by links, its own included)."""
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, 2000):
        found = _classes(docs, n, Sizes(num, den), id_col, text_col, cell)
        return settle(found.select(F.col("id").alias(id_col), "size", "component"), "classes", keep=True)


def _classes(docs: DataFrame, n: int, sizes: Sizes, id_col: str, text_col: str, cell: int) -> DataFrame:
    """id, tid, size, root (a component's name among prints; null for empty sets), component."""
    spark = docs.sparkSession
    table = settle(sketches(docs, n, sizes, id_col, text_col), "sketches")
    some = table.filter("size > 0")
    # One document stands for all of equal sets; nulls come last among ids.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("first")
    heads = some.groupBy("print").agg(first, F.min("size").alias("size"), F.max("need").alias("need"), F.count(F.lit(1)).alias("_n"))
    heads = settle(heads.select("print", "first.id", "first.tid", "size", "need", "_n"), "heads")

    shared = settle(_shared_parts(some), "shared")
    release(spark)

    # Each such set belongs to one group: that of its most frequent part, cut into cells of bounded members and tokens.
    own = shared.groupBy("print").agg(F.max_by("key", F.struct("rows", "key")).alias("part"), F.count(F.lit(1)).alias("parts"))
    own = settle(own.join(heads, "print").filter("parts >= need"), "own")
    fit = own.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum("size") / (cell * CELL_TOKENS))).cast("int").alias("cells"), F.count(F.lit(1)).alias("_n"))
    members = hot_join(own.drop("_n"), settle(fit, "fit"), ["part"]).withColumn("g", F.xxhash64("part", F.pmod(F.xxhash64("print"), F.col("cells"))))
    members = settle(members.select("g", "print", "id", "tid", "size", "need"), "members")
    sets = _token_sets(members.select("g", "print", "id", "tid"), docs, n, id_col, text_col)
    groups = settle(sets.repartition("g").sortWithinPartitions("g").mapInArrow(_pack, GROUP), "groups")

    # First every group by itself, and along each part the groups that follow one another.
    empty = [F.lit(None).cast("binary").alias(f"b_{c}") for c in groups.columns[1:]]
    alone = groups.filter(F.octet_length("members") > 8).select(*[F.col(c).alias(f"a_{c}") for c in groups.columns[1:]], *empty)
    with arrow_rows(spark, 32):
        inside = settle(alone.mapInArrow(_links_between(sizes.num, sizes.den), "u long, v long"), "inside")
    at = settle(shared.join(members.select("print", "g"), "print").select("key", "g").distinct(), "at")
    chain = at.select("g", F.lag("g").over(Window.partitionBy("key").orderBy("g")).alias("h")).filter("h is not null")
    extent = settle(members.groupBy("g").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("tokens"), F.min("need").alias("need")), "extent")
    chain = settle(_fitting(chain, extent, sizes), "chain")
    links = inside.unionByName(_open(chain, groups, sizes))
    roots = components(links)

    # Then all pairs of groups that share a part and are not of one component yet.
    named = members.join(roots, members["print"] == roots["node"], "left").groupBy("g").agg(F.min(F.coalesce("root", "print")).alias("a"), F.max(F.coalesce("root", "print")).alias("b"))
    where = at.join(named, "g")
    apart = where.groupBy("key").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.count(F.lit(1)).alias("groups")).filter("lo < hi and groups > 1").select("key")
    # All parts that two groups share count, so groups that have an open part keep the others too.
    where = settle(where.join(where.join(apart, "key").select("g").distinct(), "g"), "where")
    x, y = where.select("key", "g", "a", "b"), where.select("key", F.col("g").alias("h"), F.col("a").alias("c"), F.col("b").alias("d"))
    rest = x.join(y, "key").filter("h < g and not (a = b and c = d and a = c)").select("g", "h")
    done = chain.select(F.greatest("g", "h").alias("g"), F.least("g", "h").alias("h"))
    rest = _fitting(rest.join(done, ["g", "h"], "left_anti"), extent, sizes)
    late = _open(rest, groups, sizes)
    if not late.isEmpty():
        roots = components(links.unionByName(late))

    # From classes of equal sets back to documents.
    named = heads.join(roots, heads["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "id", "_n")
    lowest = named.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("_m"))
    of_class = settle(named.join(lowest, "root").select("print", "root", "component", "_n"), "of_class")
    rows = table.select("id", "tid", "size", "print")
    full = hot_join(rows.filter("size > 0"), of_class, ["print"])
    bare = rows.filter("size = 0").select("*", F.lit(None).cast("long").alias("root"), F.col("id").alias("component"))
    return full.unionByName(bare).select("id", "tid", "size", "root", F.coalesce("component", "id").alias("component"))


def _shared_parts(some: DataFrame) -> DataFrame:
    """key, print, rows: the parts that at least two different sets have, who has them, and how many rows a part has, about.

    Parts meet in one exchange. Parts of very many sets are told beforehand from one document in ``GLANCE`` (which settles
    only how rows are dealt) and go to several tasks each; such a part is shared, whatever meets in one of these.
    """
    glance = some.filter(F.pmod(F.xxhash64("print"), F.lit(GLANCE)) == 0).select(F.explode("keys").alias("key"), "print")
    seen = glance.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("print").alias("lo"), F.max("print").alias("hi")).filter(f"lo < hi and _n > {HOT // GLANCE}")
    seen = settle(seen.select("key", "_n"), "seen")
    total = seen.agg(F.sum("_n")).first()[0] or 0
    # At most HOT_KEYS parts are above this share of the rows.
    hot = seen.filter(F.col("_n") > total // HOT_KEYS).select("key", (F.col("_n") * GLANCE).alias("about"))
    parts = some.select(F.explode("keys").alias("key"), "print").join(F.broadcast(hot), "key", "left")
    parts = parts.withColumn("deal", F.coalesce(F.pmod(F.xxhash64("print"), F.ceil(F.col("about") / HOT)), F.lit(0)))
    mine = Window.partitionBy("key", "deal")
    met = parts.select("key", "deal", "print", "about", F.min("print").over(mine).alias("lo"), F.max("print").over(mine).alias("hi"), F.count(F.lit(1)).over(mine).alias("n"))
    met = met.filter("about is not null or lo < hi").dropDuplicates(["key", "deal", "print"])
    return met.select("key", "print", F.coalesce("about", "n").alias("rows"))


def _fitting(pairs: DataFrame, extent: DataFrame, sizes: Sizes) -> DataFrame:
    """Pairs of groups, from a row for each part that two groups share, whose set sizes and number of shared parts let
    members link: (g, h), the one with fewer tokens first."""
    side = lambda key, n: extent.select(F.col("g").alias(key), *[F.col(c).alias(f"{c}{n}") for c in extent.columns[1:]])
    both = pairs.groupBy("g", "h").agg(F.count(F.lit(1)).alias("parts")).join(side("g", 1), "g").join(side("h", 2), "h")
    fit = both.filter((sizes.den * F.col("most1") >= sizes.num * F.col("least2")) & (sizes.den * F.col("most2") >= sizes.num * F.col("least1")) & (F.col("parts") >= F.greatest("need1", "need2")))
    less = F.col("tokens1") <= F.col("tokens2")
    return fit.select(F.when(less, F.col("g")).otherwise(F.col("h")).alias("g"), F.when(less, F.col("h")).otherwise(F.col("g")).alias("h"))


def keep_one(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id (nulls last), of equal ids the first by
    hash of the text, then of the row. Rows without words all stay."""
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, 2000):
        rows = settle(_classes(docs, n, Sizes(num, den), id_col, text_col, CELL), "classes", keep=True)
    rows = rows.filter("root is not null")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "tid")
    stays = rows.groupBy("root").agg(F.min(first).alias("first"))
    each = rows.groupBy("root", "id", "tid").agg(F.count(F.lit(1)).alias("n"))
    judged = each.join(stays, "root").select("id", "tid", "n", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tid") == F.col("first.tid"))).alias("stays"))
    judged = settle(judged.filter("not stays or n > 1").select(F.col("id").alias("_nj_id"), F.col("tid").alias("_nj_tid"), "stays"), "judged", keep=True)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_nj_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_nj_tid"))
    left = docs.join(judged.filter("not stays"), same, "left_anti")
    again = judged.filter("stays")
    if again.isEmpty():
        return left
    order = Window.partitionBy("_nj_id", "_nj_tid").orderBy(F.xxhash64(*docs.columns))
    once = left.join(again, same).withColumn("_nj_k", F.row_number().over(order)).filter("_nj_k = 1").select(*docs.columns)
    return left.join(again, same, "left_anti").unionByName(once)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classes(docs, n=3, num=90, den=100)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, j, j + least(len(w), 3) - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
g AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT g.v, r.root FROM r JOIN g ON g.u = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
