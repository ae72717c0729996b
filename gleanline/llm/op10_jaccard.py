"""Jaccard join of five-word shingle sets through prefix trees, and the components of its links.

Only documents that may have a partner reach the join, by bounds that lose no link:

1. Equal sets are one class from here on (their documents are linked anyway).
2. Each task sorts its shingle hashes and ships them as packed runs by hash range; the tasks of a range
   count in how many classes each shingle stands. A shingle of one class alone can be in no overlap.
3. A class of n shingles, L of them shared, can only reach the similarity if L >= 80 % of n. For the
   few classes left, the globally ordered list of shared shingles (rarest first) gives the prefix: any
   partner must share one of its first L - ceil(0.8 n) + 1 shingles. Overlaps are exact from these lists.
4. Hubs: classes that have a least hash in common meet the one of them whose shingles are the most
   frequent, which in a group of near copies is the one that most others are close to. Their overlap
   is taken, and classes that link carry one label from here on: a large group costs a few rows a class.
5. A prefix shingle all of whose classes carry one label can tell nothing new and is left out. What the
   other shingles connect are families: linked classes are in one family, so each class is shipped once,
   to its family's task. A family beyond PART_BYTES is dealt over several tasks by its shingles.
6. A task keeps its prefixes in a trie: sequences share nodes as long as they agree, and what holds for
   a node (its label, sizes, places, what remains behind it) holds for all records below. Each record
   visits the nodes of its shingles but those of its own label; subtrees are cut by size and by what
   overlap the remaining lengths leave. Records are cut by the same bounds, by bitmaps of both lists,
   which bound their overlap from above, and at last by the exact overlap. Links join labels at once,
   so that a task returns at most one link a record.

Classes linked to each other, directly or not, form a component; its id is the least doc_id.

Hashes: sets and their sizes are told apart by 64 bits, overlaps by 48 bits; two texts of 1000 shingles
each have an overlap that is too large by one with odds of 1 to 280 million.

Edge cases: a null or wordless text has no shingles and no link; a text of 1-4 words is one shingle;
repeated rows are copies; a null doc_id gets its class's component; an empty table gives an empty
result; texts are read in whole; further columns are left out of the report and kept by stage().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm import textbatch
from gleanline.llm.common import cut, documents
from gleanline.operators import graph

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles of a range, entries of a class bucket, bytes of lists of a part.
RANGE, BUCKET, PART_BYTES = 3_000_000, 1_000_000, 8_000_000
#: Text that a task gathers before it ships its runs.
GATHER_BYTES = 32_000_000
#: Bits of a class's bitmap.
BITMAP = 2048
#: Exact overlaps that are taken at once; links found by them spare the rest.
STEP = 64
#: Least hashes by which hubs are found.
SEEDS = (0x51ED270B, 0xA24BAED5, 0x9FB21C65, 0x3C6EF372, 0x1B873593, 0xCC9E2D51)
_U = np.uint64


def need(n):
    """The least overlap of a set of n with any partner: ceil(0.8 n)."""
    return -(-PERCENT * n // 100)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """48-bit shingle hashes by text, the text of each, each text's number of distinct shingles and class key (0 without words)."""
    t = textbatch.segment(texts)
    hashes, whole = t.windows(WORDS)
    doc = t.doc_of_word()
    n_words = t.n_words
    at = np.nonzero(whole)[0]
    few = np.nonzero((n_words > 0) & (n_words < WORDS))[0]
    short = np.array([textbatch.mix(np.add.reduce(t.hashes[a:b] * (_U(0x9E3779B97F4A7C15) ** np.arange(b - a, dtype=_U) + _U(2)), dtype=_U, keepdims=True))[0] for a, b in zip(t.words[few], t.words[few + 1], strict=True)], dtype=_U)
    h = np.concatenate([hashes[at], short])
    d = np.concatenate([doc[at], few.astype(np.int32)])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[fresh], d[fresh]
    n = np.bincount(d, minlength=len(texts))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(textbatch.mix(h + _U(0x1234567)), dtype=_U)])
    ends = np.cumsum(n)
    keys = textbatch.mix((total[ends] - total[ends - n]) ^ textbatch.mix(n.astype(_U) + _U(0x77)))
    return h >> _U(16), d, n, np.where(n > 0, keys | _U(1), _U(0)).view(np.int64)


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n): each document's class (null without words) and number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in textbatch.slices(b)):
            _, _, n, keys = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, mask=keys == 0), pa.array(n.astype(np.int64))], ["doc_id", "cls", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, cls long, n long")


def _runs(h: np.ndarray, c: np.ndarray, keys: np.ndarray, sizes: np.ndarray, n_ranges: int) -> pa.RecordBatch:
    """Packed runs of (hash, class) by hash range: sorted hashes as differences, classes as numbers in a table."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    edges = np.searchsorted(h, (np.arange(n_ranges + 1, dtype=object) * (1 << 48) // n_ranges).astype(_U))
    edges[-1] = len(h)
    rows = []
    for k in range(n_ranges):
        a, b = edges[k], edges[k + 1]
        if a == b:
            continue
        step = np.diff(h[a:b])
        wide = len(step) and step.max() >= 1 << 32
        used, index = np.unique(c[a:b], return_inverse=True)
        rows.append((k, int(h[a]), step.astype("<u8" if wide else "<u4").tobytes(), bool(wide), index.astype("<u2" if len(used) <= 65536 else "<u4").tobytes(), len(used) > 65536, keys[used].astype("<i8").tobytes(), sizes[used].astype("<u4").tobytes()))
    names = ["range", "first", "steps", "wide", "index", "long", "keys", "sizes"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names)


def shared(docs: DataFrame, n_ranges: int, n_buckets: int) -> DataFrame:
    """(bucket, cls, n, hash, df) of every shingle that stands in df >= 2 classes."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, keys, sizes, read = [], {}, [], [], 0

        def gathered() -> pa.RecordBatch:
            return _runs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(keys, np.int64), np.array(sizes, np.int64), n_ranges)

        for batch in (s for b in batches for s in textbatch.slices(b)):
            h, d, n, found = shingle_sets(batch.column("text"))
            number = np.full(len(n), -1, dtype=np.int64)
            for k, key in enumerate(found.tolist()):
                if key and key not in known:  # a copy within the task is shipped once
                    number[k] = known[key] = len(keys)
                    keys.append(key)
                    sizes.append(int(n[k]))
            mine = number[d]
            parts.append((h[mine >= 0], mine[mine >= 0]))
            read += batch.column("text").nbytes
            if read >= GATHER_BYTES:
                yield gathered()
                parts, known, keys, sizes, read = [], {}, [], [], 0
        if parts:
            yield gathered()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        hs, cs, ns = [], [], []
        for first, steps, wide, index, long, keys, sizes in zip(*(table.column(c).to_pylist() for c in ("first", "steps", "wide", "index", "long", "keys", "sizes")), strict=True):
            at = np.frombuffer(index, "<u4" if long else "<u2")
            hs.append(np.concatenate([[_U(first)], _U(first) + np.cumsum(np.frombuffer(steps, "<u8" if wide else "<u4"), dtype=_U)]))
            cs.append(np.frombuffer(keys, "<i8")[at])
            ns.append(np.frombuffer(sizes, "<u4")[at])
        h, c, n = np.concatenate(hs), np.concatenate(cs), np.concatenate(ns)
        del hs, cs, ns
        order = np.argsort(h, kind="stable")
        h = h[order]
        many = np.zeros(len(h), dtype=bool)  # hashes that come up once are most of them: out at once
        many[1:] = h[1:] == h[:-1]
        many[:-1] |= many[1:]
        h, c, n = h[many], c[order[many]], n[order[many]]
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n = h[fresh], c[fresh], n[fresh]
        _, which, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[which]
        keep = df >= 2
        c = c[keep]
        bucket = (textbatch.mix(c.view(_U)) % _U(n_buckets)).astype(np.int32)
        return pa.table([pa.array(bucket), pa.array(c), pa.array(n[keep].astype(np.int32)), pa.array(h[keep].astype(np.int64)), pa.array(df[keep].astype(np.int32))], ["bucket", "cls", "n", "hash", "df"])

    runs = docs.select("doc_id", "text").mapInArrow(ship, "range int, first long, steps binary, wide boolean, index binary, long boolean, keys binary, sizes binary")
    return runs.groupBy("range").applyInArrow(count, "bucket int, cls long, n int, hash long, df int")


def pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.concatenate([six, np.zeros((len(six), 2), np.uint8)], axis=1).view("<u8").ravel()


def bitmap(own: np.ndarray) -> bytes:
    """BITMAP bits that say which low bits the hashes have."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(own & _U(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def survivors(entries: DataFrame) -> DataFrame:
    """(cls, n, shared, list, prefix, center, bits, minima): classes with enough shared shingles to have a partner.

    list: their shared shingles, sorted by hash; prefix: the rarest, in the global order; center: how
    frequent its shingles are; bits: a bitmap of the list; minima: least hashes.
    """
    token = pa.struct([("df", pa.int32()), ("hash", pa.int64())])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        c, n, h, df = (table.column(x).to_numpy() for x in ("cls", "n", "hash", "df"))
        order = np.lexsort((h, df, c))
        c, n, h, df = c[order], n[order], h[order].astype(_U), df[order]
        starts = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0] if len(c) else np.zeros(0, np.int64)
        rows, ranges = [], [np.zeros(0, np.int64)]
        for a, b in zip(starts, np.append(starts[1:], len(c)), strict=True):
            p = (b - a) - need(int(n[a])) + 1
            if p > 0:
                own = h[a:b]
                rows.append((int(c[a]), int(n[a]), int(b - a), pack48(np.sort(own)), float(np.minimum(df[a:b], 1 << 20).sum() / n[a]), bitmap(own), [int(textbatch.mix(own ^ _U(s)).min() >> _U(1)) for s in SEEDS]))
                ranges.append(np.arange(a, a + p))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
        names = ["cls", "n", "shared", "list", "center", "bits", "minima"]
        at = np.concatenate(ranges)
        tokens = pa.StructArray.from_arrays([pa.array(df[at].astype(np.int32)), pa.array(h[at].astype(np.int64))], fields=list(token))
        prefix = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in ranges]), pa.int32()), tokens)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)] + [prefix], [*names, "prefix"])

    return entries.groupBy("bucket").applyInArrow(gather, "cls long, n int, shared int, list binary, center double, bits binary, minima array<long>, prefix array<struct<df: int, hash: long>>")


def hub_links(lists: DataFrame) -> DataFrame:
    """(a, b): links between a class and the hubs of its least hashes."""
    each = lists.select("cls", "center", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(SEEDS))).alias("seed"), F.col("minima").alias("least"))).alias("m")).select("cls", "center", "m.*")
    hubs = each.groupBy("seed", "least").agg(F.max(F.struct("center", "cls")).alias("hub"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("seed", "least", F.col("hub.cls").alias("b"))
    pairs = each.join(hubs, ["seed", "least"]).select(F.col("cls").alias("a"), "b").filter("a != b").distinct()
    own = lists.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("list").alias("list_a"))
    hub = lists.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("list").alias("list_b"))
    fits = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * PERCENT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (unpack48(batch.column(c)[k].as_py()) for c in ("list_a", "list_b"))
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                total = batch.column("n_a")[k].as_py() + batch.column("n_b")[k].as_py()
                if 100 * both >= PERCENT * (total - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(own, "a").join(hub, "b").filter(fits).select("a", "b", "n_a", "n_b", "list_a", "list_b").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for the vertices of edges (a, b): the least vertex of each component."""
    return graph.components(edges.filter("a <> b")).withColumnRenamed("component", "label")


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges lo..hi - 1 one after another, and from which range each comes."""
    counts = np.maximum(hi - lo, 0)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(lo)), counts)
    return np.arange(ends[-1] if len(ends) else 0) - (ends - counts)[of] + lo[of], of


def trie_links(tokens: list[tuple[int, ...]], places: list[np.ndarray], n: np.ndarray, size: np.ndarray, label: np.ndarray, bits: np.ndarray, lists: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between records of different labels that share a token, as many as join all labels that any of them join.

    tokens: each record's tokens as numbers in the global order; places: where each stands in the
    record's whole list; n, size: each record's numbers of shingles and of shared ones; bits: bitmaps;
    lists: the shared shingles.
    """
    if len(tokens) < 2:
        return []
    order = sorted(range(len(tokens)), key=tokens.__getitem__)
    n, size, bits = n[order], size[order], bits[order]
    _, root = np.unique(label[order], return_inverse=True)
    label = root.copy()
    # the trie: a node is a token and the range of (sorted) records whose sequences run through it
    node_token, node_lo, node_hi, node_depth = [], [], [], []
    path: list[int] = []
    before: tuple = ()
    for k, i in enumerate(order):
        seq, same = tokens[i], 0
        while same < len(before) and same < len(seq) and before[same] == seq[same]:
            same += 1
        del path[same:]
        for x in path:
            node_hi[x] = k + 1
        for depth in range(same, len(seq)):
            path.append(len(node_token))
            node_token.append(seq[depth])
            node_lo.append(k)
            node_hi.append(k + 1)
            node_depth.append(depth)
        before = seq
    token, lo, hi, depth = (np.array(x, np.int64) for x in (node_token, node_lo, node_hi, node_depth))
    length = np.array([len(tokens[i]) for i in order], np.int64)
    base = np.cumsum(length) - length
    flat_token = np.concatenate([np.array(tokens[i], np.int64) for i in order])
    flat_place = np.concatenate([places[i] for i in order]).astype(np.int64)
    # of each subtree: least and greatest label and number of shingles, greatest place of the token and rest behind it
    below, of = spans(lo, hi)
    first = np.cumsum(hi - lo) - (hi - lo)
    at = flat_place[base[below] + depth[of]]
    bottom, top = np.minimum.reduceat(n[below], first), np.maximum.reduceat(n[below], first)
    far, rest = np.maximum.reduceat(at, first), np.maximum.reduceat(size[below] - at - 1, first)
    least, most = np.minimum.reduceat(label[below], first), np.maximum.reduceat(label[below], first)
    uniform = np.where(least == most, least + 1, 0)
    # the nodes by token, and of a token by label, so that a record leaves out those of its own
    width = int(label.max()) + 2
    key = token * width + uniform
    by = np.argsort(key, kind="stable")
    key = key[by]
    _, flat_list = np.unique(np.concatenate([lists[i] for i in order]), return_inverse=True)
    list_end = np.cumsum([len(lists[i]) for i in order])
    list_lo = list_end - np.array([len(lists[i]) for i in order])
    mark = np.zeros(int(flat_list.max()) + 1, bool)
    out = []
    for j in range(1, len(order)):
        own = slice(base[j], base[j] + length[j])
        mine, place = flat_token[own] * width, flat_place[own]
        cuts = [np.searchsorted(key, mine), np.searchsorted(key, mine + label[j] + 1), np.searchsorted(key, mine + label[j] + 1, "right"), np.searchsorted(key, mine + width)]
        node, which = spans(np.concatenate([cuts[0], cuts[2]]), np.concatenate([cuts[1], cuts[3]]))
        v, at_j = by[node], np.concatenate([place, place])[which]
        keep = (lo[v] < j) & (100 * top[v] >= PERCENT * n[j]) & (PERCENT * bottom[v] <= 100 * n[j])
        # shared at most: what precedes the token in both, itself, what follows it in both
        keep &= 9 * (np.minimum(far[v], at_j) + 1 + np.minimum(rest[v], size[j] - at_j - 1)) >= 4 * (bottom[v] + n[j])
        v, at_j = v[keep], at_j[keep]
        a, of = spans(lo[v], np.minimum(hi[v], j))
        if not len(a):
            continue
        at, at_j = flat_place[base[a] + depth[v][of]], at_j[of]
        keep = (root[a] != root[j]) & (100 * n[a] >= PERCENT * n[j]) & (PERCENT * n[a] <= 100 * n[j])
        keep &= 9 * (np.minimum(at, at_j) + 1 + np.minimum(size[a] - at - 1, size[j] - at_j - 1)) >= 4 * (n[a] + n[j])
        a = np.unique(a[keep])
        # the bits that differ are no more than the shingles that do
        apart = np.bitwise_count(bits[a] ^ bits[j]).sum(axis=1, dtype=np.int64)
        keep = 9 * (size[a] + size[j] - apart) >= 8 * (n[a] + n[j])
        a = a[keep][np.argsort(apart[keep], kind="stable")]
        if not len(a):
            continue
        mark[flat_list[list_lo[j] : list_end[j]]] = True
        while len(a):
            now, a = a[:STEP], a[STEP:]
            at, of = spans(list_lo[now], list_end[now])
            both = np.bincount(of[mark[flat_list[at]]], minlength=len(now))
            for x in now[100 * both >= PERCENT * (n[now] + n[j] - both)]:
                if root[x] != root[j]:
                    out.append((order[x], order[j]))
                    root[root == root[x]] = root[j]
            a = a[root[a] != root[j]]
        mark[flat_list[list_lo[j] : list_end[j]]] = False
    return out


def family_links(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): links between classes of different labels that connect all that have any."""
    labelled = lists.select("cls", "prefix").join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), F.posexplode("prefix").alias("place", "t")).select("cls", "label", "place", "t.*")
    mixed = labelled.groupBy("hash").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("hash", "lo")
    met = cut(labelled.join(mixed, "hash"))
    families = components(met.select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct())
    of_class = met.select("cls", "label").distinct().join(families.select(F.col("v").alias("label"), F.col("label").alias("family")), "label")
    weighed = of_class.join(lists.select("cls", F.octet_length("list").alias("bytes")), "cls")
    tasks = weighed.groupBy("family").agg(F.sum("bytes").alias("bytes")).withColumn("tasks", F.ceil(F.col("bytes") / PART_BYTES))
    families = cut(families.select(F.col("v").alias("label"), F.col("label").alias("family")).join(tasks, "family"))
    total = families.select("family", "bytes").distinct().agg(F.sum("bytes")).first()[0]
    parts = max(1, -(-(total or 0) // PART_BYTES))
    part = F.when(F.col("tasks") == 1, F.pmod(F.xxhash64("family"), F.lit(parts))).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("hash"), F.col("tasks"))))
    dealt = met.join(families.select("label", "family", "tasks"), "label").groupBy(part.alias("part"), "cls", "label").agg(F.array_sort(F.collect_list(F.struct("place", "df", "hash"))).alias("tokens"))
    rows = dealt.join(lists.select("cls", "n", "shared", "list", "bits"), "cls")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").combine_chunks()
        ends = np.asarray(tokens.offsets)
        place, df, h = (np.asarray(x) for x in tokens.values.flatten())
        by_order = np.lexsort((h, df))
        fresh = np.concatenate([[0], h[by_order][1:] != h[by_order][:-1]])
        number = np.empty(len(h), np.int64)
        number[by_order] = np.cumsum(fresh)
        cls, n, size, label = (table.column(c).to_numpy() for c in ("cls", "n", "shared", "label"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(cls), -1)
        runs = [slice(a, b) for a, b in zip(ends, ends[1:])]
        links = trie_links([tuple(number[r].tolist()) for r in runs], [place[r] for r in runs], n.astype(np.int64), size.astype(np.int64), label, bits, [unpack48(x) for x in table.column("list").to_pylist()])
        return pa.table([pa.array([int(cls[x[k]]) for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.select("part", "cls", "label", "n", "shared", "list", "bits", "tokens").groupBy("part").applyInArrow(joined, "a long, b long")


def class_labels(docs: DataFrame) -> DataFrame:
    """(cls, label): the classes that link with another one, and of each component the least class."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    entries = total // 6  # about the number of words
    n_ranges, n_buckets = max(1, -(-entries // RANGE)), max(1, -(-entries // (4 * BUCKET)))
    lists = cut(survivors(shared(docs, n_ranges, n_buckets)))
    labels = components(hub_links(lists))
    met = cut(family_links(lists, labels))
    known = lambda v, name: F.coalesce(F.col(name), F.col(v))
    low, high = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    joined = components(met.join(low, "a", "left").join(high, "b", "left").select(known("a", "la").alias("a"), known("b", "lb").alias("b")))
    ends = met.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    every = labels.select(F.col("v").alias("cls"), "label").unionByName(ends.join(labels.select(F.col("v").alias("cls")), "cls", "left_anti").withColumn("label", F.col("cls")))
    return every.join(joined.select(F.col("v").alias("label"), F.col("label").alias("joined")), "label", "left").select("cls", F.coalesce("joined", "label").alias("label"))


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    labels = class_labels(docs)
    members = cut(memberships(docs))
    classes = members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    of_class = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    of_label = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    found = of_class.select("cls", "label").join(of_label, "label").select("cls", "component_id")
    return members.join(found, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each component the document with the least doc_id; all documents without shingles."""
    kept = linked(docs.select("doc_id", "text")).filter(F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select(*docs.columns)
