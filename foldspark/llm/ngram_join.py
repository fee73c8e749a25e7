"""N-gram Jaccard self-join: size-aware heavy-light join, exact, down to components.

A document's set is its distinct shingles of five words (as 64-bit hashes); two
documents link when 100 |A & B| >= 80 |A | B|. Equal sets are one class, taken as
one node from the start, so copies cost a row each and no pairs.

1. Elimination. A class of n shingles needs ceil(0.8 n) of them in any partner,
   so more than n - ceil(0.8 n) shingles that no other class has rule out every
   link. That is tested on the shingles in a fixed part of the hash space (the
   same for all classes, so "no other class" is exact there); what is left goes
   on with all its shingles.
2. Shingles are ordered by frequency among the classes left, and each class keeps
   the first ones of that order: two linked classes share at least t shingles
   among their first n - ceil(0.8 n) + t.
3. Light classes, of size up to a boundary, are joined with each other on fixed-
   size subsets: all pairs out of their first n - ceil(0.8 n) + 2 shingles. Heavy
   classes scan the inverted lists of their first n - ceil(0.8 n) + 1 shingles,
   which hold light classes too. The boundary is the size at which the number of
   subsets plus the length of the lists scanned is least, added up by Spark for
   each size.
4. Lists longer than ``long_list`` (near copies by the thousand) give no pairs.
   The classes of lists that overlap form a group, whose components matter, not
   its links. Two rounds put classes with one min-hash (then one max-hash) into
   blocks of about ``block`` sets, which are compared within, and with a few
   pivots of their min-hash and of their group: near copies end in one component
   with rows in proportion to the group. Exactness comes last: the classes that
   aren't in their group's largest component are compared with all others of the
   group in blocks, except where sizes, or distances from the group's pivot (a
   metric), rule a link out. Blocks are compared by counting shared shingles in
   matrices and return spanning forests, at most one row a class. (What those
   last classes cost grows with their number times the group's size, in blocks.)
5. Pairs that could reach the threshold by their sizes and unshared shingles are
   verified on the whole sets, and components are found by star contractions.

A class is named by 128 bits. Its first 64 are its node among the links; should
two sets agree in these, the one with the smallest id is the node, and the other,
told apart by the rest, is a component of its own: no document is joined with an
unrelated one. (Links of that other one are then lost: one expected set among
10^10.) Shingles are told apart by 64 bits.

Defined results: null or empty text, or white space alone, has an empty set and
is its own component; with fewer than five words the whole sequence is the one
shingle; texts of any length are read whole; a null id links with nothing and its
component is null; rows that repeat an id and text agree in everything, rows that
repeat an id with other texts are separate nodes under that id; ids may be text;
other columns aren't read, may have any name, and stay where one of each group is
kept; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, cached, compact, held, map_texts, quoted
from .components import components, forest

WORDS = 5
#: The part of the hash space in which elimination looks for shingles of one class.
SAMPLE = 0.3
LONG_LIST = 64
BLOCK = 512
MOST_BROADCAST = 2_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(WORDS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits in which every bit depends on all."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA3B195354A39B70D)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _word_hashes() -> Memo:
    return held(("word hashes",), lambda: Memo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), 150_000))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as unsigned 64-bit integers."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        total = np.array([len(words)], np.uint64)
        for i in range(len(words)):
            total = _mixed(total + each[i : i + 1] * _STEP[i])
        return total
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total = _mixed(total + each[i : i + n] * _STEP[i])
    return np.unique(total)


def class_key(hashes: np.ndarray) -> tuple[int, int]:
    """The 128 bits that name a set, as two whole numbers."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def needed(n: Column) -> Column:
    """What a set of n must share with any partner: ceil(0.8 n)."""
    return F.ceil(n * F.lit(4) / F.lit(5)).cast("int")


def _hashed(docs: DataFrame, id_col: str, text_col: str, sample: float | None) -> DataFrame:
    """doc_id, key, check (the further bits of the key), n and shingles: those in the sampled part of the hash space, or all."""
    most = np.uint64(int(sample * 2.0**64)) if sample else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            keys, sizes = np.array([class_key(s) for s in sets], np.int64).reshape(-1, 2), [len(s) for s in sets]
            if most is not None:
                sets = [s[: np.searchsorted(s, most)] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "key", "check", "n", "shingles"])

    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("__text"))
    return map_texts(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, check long, n int, shingles array<long>")


def _only(docs: DataFrame, ids: DataFrame, n: int, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose id is (or, with left_anti, isn't) among n ids; ids are broadcast only if they are few."""
    wanted = ids.select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(F.broadcast(wanted) if n <= MOST_BROADCAST else wanted, id_col, how)


def _pairs(lists: DataFrame, light_with_light: bool) -> DataFrame:
    """Pairs of members of lists of bounded length that could link."""
    member = lists.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("key", "n", "own", "light"))).alias("m")).filter(F.size("m") > 1)
    first = member.select("m", F.posexplode("m").alias("i", "a"))
    later = F.slice("m", F.col("i") + 2, F.size("m"))
    both = first.select("a", F.explode(F.filter(later, lambda b: (9 * F.least(F.col("a.n") - F.col("a.own"), b["n"] - b["own"]) >= 4 * (F.col("a.n") + b["n"])) & (b["key"] != F.col("a.key")))).alias("b"))
    if not light_with_light:
        both = both.filter(~(F.col("a.light") & F.col("b.light")))
    return both.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def links_of(sets: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links between the sets left and the sets right."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1  # shingles of one set alone share nothing
    shared = counts[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place = np.full(len(sets), -1)
    place[left] = np.arange(len(left))
    across = np.full(len(sets), -1)
    across[right] = np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(counts[counts > 1].size), columns):
        a, b = np.searchsorted(column, [at, at + columns])
        r, c = row[a:b], column[a:b] - at
        x, y = np.zeros((len(left), columns), np.float32), np.zeros((columns, len(right)), np.float32)
        x[place[r[place[r] >= 0]], c[place[r] >= 0]] = 1
        y[c[across[r] >= 0], across[r[across[r] >= 0]]] = 1
        total += x @ y
    inter = total.astype(np.int64)
    i, j = np.nonzero(100 * inter >= 80 * (n[left][:, None] + n[right][None] - inter))
    return forest(left[i], right[j]) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Pivots of a group, and of each of its min-hashes.
PIVOTS = 4
#: Widths of bins: sizes of linked sets are in the same or in neighbouring ones, distances from a pivot at most FAR_BINS apart.
SIZE_BIN, FAR_BIN, FAR_BINS = 0.2311, 0.051, 4


def _numbers(lists: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x) for x in lists.combine_chunks().to_numpy(zero_copy_only=False)]


def _keyed(table: pa.Table, u: np.ndarray, v: np.ndarray) -> pa.Table:
    keys = table.column("key").to_numpy()
    return pa.table({"a": pa.array(keys[u], pa.int64()), "b": pa.array(keys[v], pa.int64())})


def _pivots(keys: list[str], what: str, members: DataFrame) -> DataFrame:
    """For each group of members: blocks, that its size asks for, and a few keys that hashes choose."""
    chosen = [F.min(F.struct(F.xxhash64(F.lit(what), F.lit(i), "key"), "key"))["key"] for i in range(PIVOTS)]
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.array_distinct(F.array(*chosen)).alias("pivots"))


def _blocks(block: int) -> Column:
    """Blocks of bounded size in rows and in shingles."""
    return F.ceil(F.greatest(F.col("rows") / F.lit(block), F.col("size") / F.lit(block * 1000))).cast("int")


def _round(members: DataFrame, sets: DataFrame, end: int, block: int) -> DataFrame:
    """Links, as forests, within blocks of classes with one min-hash (end 1) or max-hash (end -1), and with pivots.

    members has key, n, g and both hashes, low and high.
    """
    groups = _pivots(["g"], "group", members).withColumn("blocks", _blocks(block))
    placed = members.join(groups.select("g", "blocks"), "g").withColumn("bucket", F.pmod(F.xxhash64("low" if end > 0 else "high"), F.col("blocks")).cast("int"))
    buckets = _pivots(["g", "bucket"], "bucket", placed).withColumn("subs", _blocks(block)).drop("rows", "size")
    own = placed.join(buckets.select("g", "bucket", "subs"), ["g", "bucket"]).select("key", "g", "bucket", F.pmod(F.xxhash64(F.lit("sub"), "key"), F.col("subs")).cast("int").alias("sub"), F.lit(True).alias("own"))
    both = buckets.join(groups.select("g", F.col("pivots").alias("more"), "blocks"), "g").filter("blocks > 1 or subs > 1")
    each = both.select("g", "bucket", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.explode(F.array_distinct(F.concat("pivots", "more"))).alias("key"))
    dealt = own.unionByName(each.select("key", "g", "bucket", "sub", F.lit(False).alias("own")))

    def compare(table: pa.Table) -> pa.Table:
        held = _numbers(table.column("shingles"))
        own_ = table.column("own").to_numpy()
        return _keyed(table, *links_of(held, np.array([len(x) for x in held]), np.flatnonzero(own_), np.arange(len(held))))

    return dealt.join(sets.select("key", "shingles"), "key").groupBy("g", "bucket", "sub").applyInArrow(compare, "a long, b long").filter("a <> b")


def _rest(members: DataFrame, links: DataFrame, sets: DataFrame, block: int) -> DataFrame | None:
    """Links, as forests, between classes outside their group's largest component and all others of the group; None if there is no such class.

    Only groups of more than one block: blocks were compared whole.
    """
    groups = _pivots(["g"], "group", members).withColumn("blocks", _blocks(block)).filter("blocks > 1").select("g", F.col("pivots")[0].alias("pivot"))
    some = members.join(groups, "g")
    parts = components(links)
    labelled = compact(some.join(parts, some["key"] == parts["node"], "left").select("key", "n", "g", "pivot", F.coalesce("component", "key").alias("c")))
    counts = labelled.groupBy("g", "c").agg(F.count(F.lit(1)).alias("rows"))
    main = counts.groupBy("g").agg(F.max(F.struct("rows", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("g", "main")
    split = labelled.join(main, "g").withColumn("other", F.col("c") != F.col("main"))
    if not split.limit(1).count():
        return None
    # Distances from the group's pivot, and the cells of like size and distance.
    centre = sets.select(F.col("key").alias("pivot"), F.col("n").alias("n_p"), F.col("shingles").alias("s_p"))
    pivoted = split.select("pivot").distinct().join(centre, "pivot")
    common = F.size(F.array_intersect("shingles", "s_p"))
    far = 1 - common / (F.col("n") + F.col("n_p") - common)
    cells = ["g", "other", "s", "q"]
    placed = compact(split.join(sets.select("key", "shingles"), "key").join(pivoted, "pivot").select("key", "n", "g", "other", F.floor(F.log("n") / SIZE_BIN).cast("int").alias("s"), F.floor(far / FAR_BIN).cast("int").alias("q")))
    sized = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size")).withColumn("subs", _blocks(block)).select(*cells, "subs")
    name = F.concat_ws(":", *cells, "sub")
    blocks = sized.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select("g", "other", "s", "q", name.alias("at"))
    near_s, near_q = (F.explode(F.sequence(F.col(c) - w, F.col(c) + w)).alias(c) for c, w in (("s", 1), ("q", FAR_BINS)))
    a = blocks.filter("other").select("g", near_s, "q", F.col("at").alias("a")).select("g", "s", near_q, "a")
    pairs = compact(a.join(blocks.select("g", "s", "q", "other", F.col("at").alias("b")), ["g", "s", "q"]).filter("not other or a <= b").select("a", "b"))
    housed = placed.join(sized, cells).withColumn("sub", F.pmod(F.xxhash64(F.lit("rest"), "key"), F.col("subs")).cast("int")).select("key", name.alias("at"))
    left = housed.join(pairs, housed["at"] == pairs["a"]).select("key", "a", "b", F.lit(True).alias("left"))
    right = housed.join(pairs.filter("a <> b"), housed["at"] == pairs["b"]).select("key", "a", "b", F.lit(False).alias("left"))

    def compare(table: pa.Table) -> pa.Table:
        held = _numbers(table.column("shingles"))
        on_left = table.column("left").to_numpy()
        one, two = np.flatnonzero(on_left), np.flatnonzero(~on_left)
        alone = table.column("a")[0] == table.column("b")[0]
        if not len(one) or not (alone or len(two)):  # a block may be empty
            return _keyed(table, np.zeros(0, np.int64), np.zeros(0, np.int64))
        return _keyed(table, *links_of(held, np.array([len(x) for x in held]), one, one if alone else two))

    dealt = left.unionByName(right).join(sets.select("key", "shingles"), "key")
    return dealt.groupBy("a", "b").applyInArrow(compare, "a long, b long").filter("a <> b")


def _grouped(hot: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links, as forests, among classes that share a long list: hot has sig, key and n."""
    # Lists are nodes as well: odd numbers, classes even ones; both keep 63 bits of their hash.
    node = F.col("key").bitwiseAND(F.lit(-2))
    listed = F.col("sig").bitwiseOR(F.lit(1))
    parts = components(hot.select(node.alias("a"), listed.alias("b")))
    named = hot.select("key", "n", node.alias("node")).distinct().join(parts, "node").select("key", "n", F.col("component").alias("g"))
    ends = sets.select("key", F.element_at("shingles", 1).alias("low"), F.element_at("shingles", -1).alias("high"))
    members = compact(named.join(ends, "key"))
    links = compact(_round(members, sets, 1, block).unionByName(_round(members, sets, -1, block)))
    rest = _rest(members, links, sets, block)
    return links if rest is None else links.unionByName(compact(rest))


def boundary(costs: list[tuple[int, float, float]]) -> int:
    """The size up to which subsets are cheaper: costs are (size, subsets, list lengths) by size."""
    at, total = 0, sum(lists for _, _, lists in costs)
    best = total
    for size, subsets, lists in sorted(costs):
        total += subsets - lists
        if total < best:
            best, at = total, size
    return at


def classes_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: float = SAMPLE, long_list: int = LONG_LIST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, check, n of every row; links a, b between keys of different sets; key and check of the sets that are nodes)."""
    sketch = cached(_hashed(docs, id_col, text_col, sample))
    named = sketch.filter("doc_id is not null and n > 0")
    # 1. Elimination.
    owned = named.select(F.explode("shingles").alias("h"), "key").groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("last")).filter("key = last").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    classes = named.groupBy("key").agg(F.min(F.struct("doc_id", "n", "check")).alias("m")).select("key", "m.*")
    left = classes.join(owned, "key", "left").filter(F.coalesce("own", F.lit(0)) <= F.col("n") - needed(F.col("n")))
    left = compact(left.select("key", "doc_id", "n", "check"))
    count = left.count()
    texts = _only(docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias(text_col)).filter(F.col(quoted(id_col)).isNotNull()), left, count, id_col)
    sets = cached(_hashed(texts, id_col, text_col, None).filter("n > 0").select("key", "n", "shingles").dropDuplicates(["key"]))
    # 2. Frequencies, and the first shingles of each class.
    each = sets.select(F.explode("shingles").alias("h"), "key", "n")
    often = each.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1")
    counted = each.join(often.hint("shuffle_hash"), "h")
    ordered = counted.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    room = F.col("n") - needed(F.col("n")) + 2 - F.col("own")
    first = compact(ordered.withColumn("own", F.col("n") - F.size("shared")).filter(room > 1).select("key", "n", "own", F.slice("shared", F.lit(1), room.cast("int")).alias("first")))
    # 3. The boundary between light and heavy.
    m = F.size("first")
    cold = F.filter("first", lambda x: x["df"] <= long_list)
    ones = F.filter(F.slice("first", F.lit(1), F.greatest(m - 1, F.lit(0))), lambda x: x["df"] <= long_list)
    # What long lists cost doesn't depend on the boundary: only cold shingles count.
    subsets = F.size(cold) * (2 * m - F.size(cold) - 1) / 2
    scanned = F.aggregate(ones, F.lit(0).cast("long"), lambda s, x: s + x["df"])
    size = F.when(F.col("n") < 64, F.col("n")).otherwise((F.floor(F.log2("n") * 8)).cast("int") + 1000)
    costs = first.groupBy(size.alias("bucket")).agg(F.max("n").alias("n"), F.sum(subsets.cast("double")).alias("subsets"), F.sum(scanned.cast("double")).alias("lists")).collect()
    light_to = boundary([(r["n"], r["subsets"], r["lists"]) for r in costs])
    rows = first.withColumn("light", F.col("n") <= light_to)
    # Two of the first shingles, the rarer one cold: that bounds the list.
    twos = F.flatten(F.transform(cold, lambda x: F.transform(F.filter("first", lambda y: (y["df"] > x["df"]) | ((y["df"] == x["df"]) & (y["h"] > x["h"]))), lambda y: F.xxhash64(x["h"], y["h"]))))
    light = rows.filter("light").select(F.explode(twos).alias("sig"), "key", "n", "own", "light")
    # A heavy class leaves its last shingle out; so does a light one that a heavy one may meet.
    heavy = rows.filter(5 * F.col("n") >= 4 * (light_to + 1)).select(F.explode(F.transform(ones, lambda x: x["h"])).alias("sig"), "key", "n", "own", "light")
    pairs = _pairs(light, True).unionByName(_pairs(heavy, False)).distinct()
    # 5. Verification on the whole sets.
    one, two = (sets.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("shingles").alias(f"s_{k}")) for k in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    checked = pairs.join(one, "a").join(two, "b").filter(100 * common >= 80 * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")
    # 4. Long lists.
    hot = compact(rows.select(F.explode(F.filter("first", lambda x: x["df"] > long_list)).alias("x"), "key", "n").select(F.col("x.h").alias("sig"), "key", "n"))
    links = compact(checked)
    if hot.limit(1).count():
        links = links.unionByName(_grouped(hot, sets, block))
    return sketch.select("doc_id", "key", "check", "n"), links, left.select("key", "check")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_shingles, component_id and copies (rows of the same set) of every row."""
    rows, links, nodes = classes_linked(docs, id_col, text_col, **options)
    named = rows.filter("doc_id is not null and n > 0")
    classes = named.groupBy("key", "check").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    parts = components(links)
    parts = nodes.join(parts, nodes["key"] == parts["node"]).select("key", "check", "component")
    placed = classes.join(parts, ["key", "check"], "left").select("key", "check", "least", "copies", "component")
    smallest = placed.filter("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    named_classes = placed.join(smallest, "component", "left").select(F.col("key").alias("k"), F.col("check").alias("k2"), F.coalesce("smallest", "least").alias("smallest"), "copies")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = rows.join(named_classes, (rows["key"] == named_classes["k"]) & (rows["check"] == named_classes["k2"]) & linked, "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that aren't the smallest id of their component.

    Null ids stay; rows that repeat an id stay together if one of them is to stay.
    """
    own = join(docs, id_col, text_col).filter(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("doc_id"))
    gone = compact(own.agg(F.max(F.col(quoted(id_col)) == F.col("component_id")).alias("stays")).filter("not stays").select("doc_id"))
    return _only(docs, gone, gone.count(), id_col, "left_anti").select(*map(quoted, docs.columns))


def duckdb_sql() -> str:
    """join() over the table documents, without null or repeated ids, for DuckDB: all pairs that share a shingle."""
    return r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_distinct([array_to_string(ws[i:i+4], ' ') for i in generate_series(1, len(ws) - 4)]) end as sh from w),
x as (select doc_id, len(sh) as n, unnest(sh) as h from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
k as (select a as doc_id, min(b) as component_id from r group by 1),
c as (select doc_id, case when len(sh) = 0 then 1 else count(*) over (partition by md5(array_to_string(list_sort(sh), chr(10)))) end as copies from s)
select doc_id, cast(len(sh) as bigint) as n_shingles, component_id, copies from s join k using (doc_id) join c using (doc_id)"""
