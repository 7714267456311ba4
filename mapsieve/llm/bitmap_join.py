"""N-gram Jaccard self-join in size-banded tiles with hashed bitmap signatures.

1. A document's set is its distinct WIDTH-word shingles as 64-bit hashes.  Documents with equal
   sets fall into one class, represented by the smallest doc_id; classes are what is joined.
2. The shingles of all classes are counted: chunks send them, counted once already, to hash buckets,
   which answer with the number of classes that hold each (counts above 64 in steps).  Every set is put in one order,
   rarest shingles first, ties by hash.  Of two sets with similarity 0.8 or more, the heads of
   ``n - ceil(0.8 n) + 1`` shingles share one; so every class is dealt to a tile for each shingle of
   its head that another class holds too, and no link can be lost.  A text of which a fifth is its
   own is dealt to none.
3. In a tile, classes are sorted by size.  Only sizes within the band that the threshold allows
   meet, and every pair in the band is bounded by its signatures: the parity bitmaps of two sets
   differ in at most as many bits as the sets differ in shingles, so the overlap is at most
   ``(|x| + |y| - popcount(x ^ y)) / 2``.  A bitmap has between 0.6 and 1.2 bits a shingle (in a tile
   MOST_BITS at most), folded to the shorter of two.  Pairs whose bound falls short are no links.
   A shingle of more than HOT classes has no tile: its classes are taken as one candidate group, so
   that no task gathers them, and are compared in step 4.
4. A bucket of tiles returns the trees of its candidate links.  Components of these gather the classes that may be linked; within each, classes in order of size
   are compared with sorted-array intersections, again within the band and below the bitmap bound,
   and pairs that are already connected are skipped.
5. A component's name goes back to all documents of its classes.

Every link joins two classes of one gathered component, so none is lost.  A component of more than
WIDE classes or so is compared in several tasks; see _exact.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than WIDTH words
make one shingle; a null, empty or blank text has the empty set and links with nothing; a null
doc_id is a document with a null component unless it shares one with known ids; rows of a
repeated doc_id are documents of their own with that id; an empty table gives no rows; extra columns
are ignored.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsieve.llm import common as c
from mapsieve.llm.components import components

WIDTH = 5
NUM, DEN = 80, 100
LEAST_BITS, MOST_BITS = 128, 512
#: Classes that share a shingle and still meet in one tile, and the size of tiles whose pairs are all taken at once.
HOT, SMALL = 16_384, 8
#: Classes of a gathered component that are compared in one task (one of many shingles counts for several, one for each
#: HEAVY shingles), and those of them that stand in every task.
WIDE, HEAVY, LEADERS = 2048, 1024, 16
_NO_ID = (1 << 63) - 1
_SHORT = np.uint64(0x5B07)
_STEP = np.uint64(0xA24BAED4963EE407)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, joined, and where each document's begin (with the end)."""
    hashes, first = c.word_hashes(data, offsets)
    n = len(hashes)
    rolled = np.zeros(max(n - WIDTH + 1, 0), dtype=np.uint64)
    for i in range(WIDTH):
        rolled = rolled * _STEP + hashes[i : i + len(rolled)]
    rolled = c.mix(rolled)
    sets, sizes = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            own = np.sort(rolled[a : b - WIDTH + 1])
            if (own[1:] == own[:-1]).any():
                own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            x = np.array([b - a], dtype=np.uint64) + _SHORT
            for k in range(a, b):
                x = x * _STEP + hashes[k : k + 1]
            own = c.mix(x)
        else:
            own = hashes[:0]
        sets.append(own)
        sizes.append(len(own))
    return (np.concatenate(sets) if sets else hashes[:0]), np.append(0, np.cumsum(sizes)).astype(np.int64)


def bitmap_bits(size: int) -> int:
    return max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1.0, 0.6 * size)))))


def bitmap(own: np.ndarray) -> bytes:
    """Parity bitmap: a bit is the number of shingles that hash to it, modulo 2."""
    bits = bitmap_bits(len(own))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (n, words of 64 bits) folded to fewer bits; parities add up."""
    while words.shape[1] * 64 > bits:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def overlap_needed(a, b):
    """The least overlap with 100 * overlap >= 80 * (a + b - overlap)."""
    return -(-NUM * (a + b) // (DEN + NUM))


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("chunk", pa.int64()), ("place", pa.int32())])
_SETS_DDL = "doc_id long, n long, set_a long, set_b long, chunk long, place int"


def _describe(batches):
    for row in c.rows_of(batches):
        ids, known, offsets, data = c.unpacked(row)
        sets, at = shingle_sets(data, offsets)
        size = np.diff(at)
        full = np.flatnonzero(size)
        begin = at[:-1][full]
        a, b = np.zeros(len(ids), dtype=np.uint64), np.zeros(len(ids), dtype=np.uint64)
        if len(full):
            a[full] = c.mix(np.add.reduceat(sets, begin))
            b[full] = c.mix(np.bitwise_xor.reduceat(c.mix(sets ^ _STEP), begin) + size[full].astype(np.uint64))
        yield c.table(_SETS, doc_id=c.ids_column(ids, known), n=size, set_a=a.view(np.int64), set_b=b.view(np.int64), chunk=np.full(len(ids), row["chunk"]), place=np.arange(len(ids), dtype=np.int32))


_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
_MESSAGE_DDL = "bucket int, chunk long, body binary"


def _own_classes(row: dict):
    """Names of the classes that a chunk stands for, their sets, joined, and where each begins; the other replies by their tag."""
    told, answers = np.zeros(0, dtype=np.int64), {}
    for x in row["replies"]:
        tag = int(np.frombuffer(x, dtype=np.int64, count=1)[0])
        if tag < 0:  # -1 reads the same from both ends
            told = np.concatenate([told, c.numbers_of(x, 8)])
        else:
            answers[tag] = np.frombuffer(x, dtype=np.uint8, offset=8)
    told = told.reshape(-1, 2)
    told = told[np.argsort(told[:, 0])]
    _, _, offsets, data = c.unpacked(row)
    sets, at = shingle_sets(data, offsets)
    size = np.diff(at)[told[:, 0]]
    begin = np.append(0, np.cumsum(size))
    return told[:, 1], sets[np.arange(int(begin[-1])) - np.repeat(begin[:-1], size) + np.repeat(at[told[:, 0]], size)], begin, answers


def _short(sets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles by the 32 bits that follow their bucket's: each such name once, in order, with the buckets there are and where
    they begin (with the end), and for every shingle the place of its name."""
    order = np.argsort(sets, kind="stable")
    name = sets[order] >> np.uint64(32 - bits)
    new = np.append(True, name[1:] != name[:-1])[: len(name)]
    back = np.empty(len(sets), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    name = name[new]
    there, at = np.unique((name >> np.uint64(32)).astype(np.int64), return_index=True)
    return name, there, np.append(at, len(name)), back


def _ask(bits: int):
    """The shingles of a chunk's classes: names, each once, and the places and counts of those that several classes hold."""

    def run(batches):
        for row in c.rows_of(batches):
            if row["replies"]:
                _, sets, _, _ = _own_classes(row)
                name, there, at, back = _short(sets, bits)
                held = np.bincount(back, minlength=len(name)).astype(np.uint32)
                bodies = []
                for i, j in zip(at[:-1], at[1:], strict=True):
                    more = np.flatnonzero(held[i:j] > 1)
                    bodies.append(np.int64(j - i).tobytes() + name[i:j].astype(np.uint32).tobytes() + more.astype(np.uint32).tobytes() + held[i:j][more].tobytes())
                yield c.table(_MESSAGE, bucket=there.astype(np.int32), chunk=[row["chunk"]] * len(there), body=bodies)

    return run


def step_of(count: np.ndarray) -> np.ndarray:
    """Counts up to 64 as they are, then eight steps for each doubling, in one byte."""
    return np.where(count <= 64, count, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(count, 64) / 64) + 1e-9))).astype(np.uint8)


def _count(key, messages):
    """How many classes hold each shingle of a bucket, told to every chunk in the order in which it asked."""
    names, held = [], []
    for x in messages.column("body"):
        x = x.as_buffer()
        n = int(np.frombuffer(x, dtype=np.int64, count=1)[0])
        names.append(np.frombuffer(x, dtype=np.uint32, offset=8, count=n))
        held.append(np.ones(n, dtype=np.int64))
        place, many = np.frombuffer(x, dtype=np.uint32, offset=8 + 4 * n).reshape(2, -1)
        held[-1][place] = many
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    steps, tag = step_of(np.bincount(back, weights=np.concatenate(held)).astype(np.int64))[back], np.int64(key[0].as_py()).tobytes()
    ends = np.cumsum([len(x) for x in names])
    return pa.table({"chunk": messages.column("chunk"), "reply": pa.array([tag + steps[e - len(x) : e].tobytes() for e, x in zip(ends, names, strict=True)], type=pa.binary())})


def heads(sets: np.ndarray, begin: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles that a set must be found by, and the sets they are of: those of its head that others hold too."""
    places, own = [], []
    size = np.diff(begin)
    alone = np.add.reduceat((steps == 1).astype(np.int64), begin[:-1]) if len(size) else size
    short = size - -(-NUM * size // DEN) + 1 - alone
    for k in np.flatnonzero(short > 0).tolist():
        at = begin[k] + np.flatnonzero(steps[begin[k] : begin[k + 1]] > 1)
        at = at[np.lexsort((sets[at], steps[at]))][: int(short[k])]
        places.append(at)
        own.append(np.full(len(at), k))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(places), np.concatenate(own)) if places else (none, none)


def tile_bits(size: int) -> int:
    return min(MOST_BITS, bitmap_bits(size))


def _post(bits: int, hot: int):
    """Classes to tiles: messages (bucket, body) with keys, class numbers, sizes and bitmaps; those of hot keys to bucket -1, without more."""
    limit = int(step_of(np.array([hot]))[0])

    def run(batches):
        for row in c.rows_of(batches):
            if not row["replies"]:
                continue
            names, sets, begin, answers = _own_classes(row)
            _, there, _, back = _short(sets, bits)
            steps = np.concatenate([answers[b] for b in there.tolist()])[back] if len(there) else np.zeros(0, dtype=np.uint8)
            place, own = heads(sets, begin, steps)
            warm = steps[place] > limit
            bodies = [(-1, np.stack([names[own[warm]], sets[place[warm]].view(np.int64)], 1).tobytes())] if warm.any() else []
            place, own = place[~warm], own[~warm]
            size = np.diff(begin)
            maps = {k: folded(np.frombuffer(bitmap(sets[begin[k] : begin[k + 1]]), dtype=np.uint64)[None, :], MOST_BITS).tobytes() for k in np.unique(own).tolist()}
            order, there, at = c.by_bucket(sets[place], bits)
            for b, i, j in zip(there.tolist(), at[:-1], at[1:], strict=True):
                members, back = np.unique(own[order[i:j]], return_inverse=True)
                head = np.array([len(members), j - i], dtype=np.int64).tobytes()
                bodies.append((b, head + names[members].tobytes() + size[members].astype(np.int64).tobytes() + sets[place[order[i:j]]].tobytes() + back.astype(np.int64).tobytes() + b"".join(maps[k] for k in members.tolist())))
            yield c.table(_MESSAGE, bucket=[b for b, _ in bodies], chunk=[row["chunk"]] * len(bodies), body=[x for _, x in bodies])

    return run


def _hot_edges(batches):
    """Classes and the hot shingles that they stand for, as edges."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for x in batch.column("body"):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(-1, 2).T
            yield c.table(out, a=a, b=b)


def near_pairs(sizes: np.ndarray, maps: list[np.ndarray], accept, tree: np.ndarray | None = None) -> np.ndarray:
    """Tree number of each set (tree: those known already), when the pairs in the band whose bitmap bound holds and that accept(i, j) confirms are joined.

    sizes ascend.  Each set is held against the latest of the greatest tree, then against the smaller
    ones of its band at once; sets of its own tree are left out, before and after every pair that
    joins two trees.
    """
    tree = np.arange(len(sizes)) if tree is None else np.unique(tree, return_inverse=True)[1]
    stacks: dict[int, np.ndarray] = {}
    place = np.zeros(len(sizes), dtype=np.int64)
    widths = np.array([len(m) * 64 for m in maps])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        stacks[width] = np.stack([maps[i] for i in own.tolist()])
        place[own] = np.arange(len(own))
    many = np.bincount(tree, minlength=len(sizes)) if len(tree) else np.zeros(0, dtype=np.int64)
    latest, leader = 0, int(tree[0]) if len(tree) else 0

    def may_be(i, j):
        least = int(min(widths[i], widths[j]))
        differ = int(np.bitwise_count(folded(maps[i][None, :], least) ^ folded(maps[j][None, :], least)).sum())
        total = int(sizes[i] + sizes[j])
        return total - differ >= 2 * overlap_needed(total, 0)

    def united(i, j):
        nonlocal leader, latest
        gone = int(tree[j])
        many[tree[i]] += many[gone]
        tree[tree == gone] = tree[i]
        if many[tree[i]] >= many[leader] or leader == gone:
            leader = int(tree[i])
        latest = j if tree[j] == leader else latest

    for j in range(1, len(sizes)):
        low = int(np.searchsorted(sizes[:j], -(-NUM * int(sizes[j]) // DEN)))
        if low <= latest < j and tree[latest] != tree[j] and may_be(latest, j) and accept(latest, j):
            united(latest, j)
        band = low + np.flatnonzero(tree[low:j] != tree[j])
        if not len(band):
            continue
        left = []
        for width in np.unique(widths[band]).tolist():
            own = band[widths[band] == width]
            least = min(width, int(widths[j]))
            differ = np.bitwise_count(folded(stacks[width][place[own]], least) ^ folded(maps[j][None, :], least)).sum(1, dtype=np.int64)
            total = sizes[own] + sizes[j]
            left.append(own[total - differ >= 2 * overlap_needed(total, 0)])
        left = np.concatenate(left)
        while len(left):
            i, left = int(left[0]), left[1:]
            if accept(i, j):
                united(i, j)
                left = left[tree[left] != tree[j]]
    return tree


def _pairs_of_small(cut: np.ndarray, many: np.ndarray, member: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs within the band and the bitmap bound, of all tiles of at most SMALL members."""
    left, right = [], []
    for m in range(2, SMALL + 1):
        tiles = member[cut[many == m][:, None] + np.arange(m)[None, :]]
        i, j = np.triu_indices(m, 1)
        left.append(tiles[:, i].ravel())
        right.append(tiles[:, j].ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    near = sizes[left] * DEN >= NUM * sizes[right]
    pairs = np.unique(left[near] * np.int64(len(sizes)) + right[near])
    left, right = pairs // max(1, len(sizes)), pairs % max(1, len(sizes))
    widths = np.array([len(x) * 64 for x in maps], dtype=np.int64)
    keep = np.zeros(len(pairs), dtype=bool)
    for a, b in set(zip(widths[left].tolist(), widths[right].tolist(), strict=True)):
        own = np.flatnonzero((widths[left] == a) & (widths[right] == b))
        for low in range(0, len(own), 1 << 16):
            some = own[low : low + (1 << 16)]
            x, y = (folded(np.stack([maps[k] for k in side[some].tolist()]), min(a, b)) for side in (left, right))
            total = sizes[left[some]] + sizes[right[some]]
            keep[some] = total - np.bitwise_count(x ^ y).sum(1, dtype=np.int64) >= 2 * overlap_needed(total, 0)
    return left[keep], right[keep]


def _tile(key, messages):
    """Trees of the pairs that may be links in the tiles of a bucket, as edges to the smallest class of each."""
    keys, member, names, sizes, maps, before = [], [], [], [], [], 0
    for x in messages.column("body"):
        x = x.as_buffer()
        n, k = np.frombuffer(x, dtype=np.int64, count=2).tolist()
        names.append(np.frombuffer(x, dtype=np.int64, offset=16, count=n))
        sizes.append(np.frombuffer(x, dtype=np.int64, offset=16 + 8 * n, count=n))
        keys.append(np.frombuffer(x, dtype=np.uint64, offset=16 + 16 * n, count=k))
        member.append(np.frombuffer(x, dtype=np.int64, offset=16 + 16 * n + 8 * k, count=k) + before)
        at, before = 16 + 16 * n + 16 * k, before + n
        for s in sizes[-1].tolist():
            w = tile_bits(s) // 64
            maps.append(np.frombuffer(x, dtype=np.uint64, offset=at, count=w))
            at += 8 * w
    keys, member, names, sizes = (np.concatenate(x) for x in (keys, member, names, sizes))
    order = np.lexsort((names[member], sizes[member], keys))
    keys, member = keys[order], member[order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    many = np.diff(np.append(cut, len(keys)))
    a, b = _pairs_of_small(cut, many, member, sizes, maps)
    out_a, out_b = [a], [b]
    for i, m in zip(cut[many > SMALL].tolist(), many[many > SMALL].tolist(), strict=True):
        own = member[i : i + m]
        pairs: list[tuple[int, int]] = []

        def keep(x, y, pairs=pairs):
            pairs.append((x, y))
            return True

        near_pairs(sizes[own], [maps[k] for k in own.tolist()], keep)
        x, y = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        out_a.append(own[x])
        out_b.append(own[y])
    root = roots(len(names), np.concatenate(out_a), np.concatenate(out_b))
    low = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(low, root, names)
    far = np.flatnonzero(names != low[root])
    return pa.table({"a": pa.array(names[far]), "b": pa.array(low[root[far]])})


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tree of each of n nodes under the edges a - b, as the number of a node in it."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _send_texts(batches):
    """Texts of the classes that a chunk is asked for: rows (tile, class, tree, text)."""
    out = pa.schema([("tile", pa.int64()), ("class", pa.int64()), ("tree", pa.int64()), ("text", pa.binary())])
    for row in c.rows_of(batches):
        if not row["replies"]:
            continue
        _, _, offsets, data = c.unpacked(row)
        told = np.concatenate([c.numbers_of(x) for x in row["replies"]]).reshape(-1, 4)
        for i in range(0, len(told), 1024):
            place, name, tile, tree = told[i : i + 1024].T
            yield c.table(out, tile=tile, tree=tree, **{"class": name}, text=[data[offsets[p] : offsets[p + 1]].tobytes() for p in place])


def sets_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of sorted arrays, the shorter one searched for in the longer."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _link(key, rows):
    """Exact links within the tiles of one bucket, as edges (class, root): root is the smallest class of the tree."""
    tile, name, tree = (rows.column(x).to_numpy() for x in ("tile", "class", "tree"))
    texts = rows.column("text").to_pylist()
    order = np.lexsort((name, tile))
    order = order[np.append(True, (tile[order][1:] != tile[order][:-1]) | (name[order][1:] != name[order][:-1]))]
    cut = np.flatnonzero(np.append(True, tile[order][1:] != tile[order][:-1]))
    found = {"class": [], "root": []}
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        own = order[i:j]
        parts = [texts[k] for k in own.tolist()]
        sets, at = shingle_sets(np.frombuffer(b"".join(parts), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in parts])))
        size = np.diff(at)
        by = np.lexsort((name[own], size))
        each = [sets[at[k] : at[k + 1]] for k in by.tolist()]

        def linked(x, y, each=each):
            return DEN * (o := sets_overlap(each[x], each[y])) >= NUM * (len(each[x]) + len(each[y]) - o)

        roots = near_pairs(size[by], [np.frombuffer(bitmap(s), dtype=np.uint64) for s in each], linked, tree[own][by])
        names = name[own][by]
        low = np.full(int(roots.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, roots, names)
        found["class"].append(names)
        found["root"].append(low[roots])
    return pa.table({k: np.concatenate(v) for k, v in found.items()})


def _linked(corpus: c.Corpus, places: DataFrame, tiles: DataFrame, parts: int) -> DataFrame:
    """Edges (class, root) of tiles (node, tile, tree); places: (node, chunk, place, n) of the classes."""
    wanted = tiles.join(places, "node")
    asks = wanted.groupBy("chunk").agg(c.as_bytes(F.flatten(F.collect_list(F.array("place", "node", "tile", "tree")))).alias("reply"))
    texts = c.with_replies(corpus, asks).mapInArrow(_send_texts, "tile long, class long, tree long, text binary")
    return texts.groupBy(F.pmod(F.xxhash64("tile"), F.lit(4 * parts)).alias("bucket")).applyInArrow(_link, "class long, root long")


def _exact(corpus: c.Corpus, places: DataFrame, gathered: DataFrame, parts: int, wide: int) -> DataFrame:
    """(node, component) of the exact links within gathered components (node, component).

    Components of a weight over ``wide`` (about their classes) are cut into tiles by hash; some leaders stand in every
    tile, so that most of what belongs together is joined through them.  What is not yet in the
    largest tree of its component then meets every tile once more, a block of it at a time, with
    the trees so far; so every pair that is not joined has been compared.
    """
    heavy = gathered.join(places.select("node", (1 + F.floor(F.col("n") / HEAVY)).alias("weight")), "node")
    sizes = heavy.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("size"))
    large = c.stored(sizes.filter(F.col("size") > wide))
    few = F.ceil(F.col("size") / wide).cast("int")
    share = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    sized = c.hot_join(gathered, large, ["component"])
    small = sized.filter("size is null").select("node", F.col("component").alias("tile"), F.col("node").alias("tree"))
    if large.isEmpty():
        return _linked(corpus, places, small, parts).select(F.col("class").alias("node"), F.col("root").alias("component"))
    of_large = c.stored(sized.filter("size is not null").select("node", "component", "size", share(1, few).alias("salt")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), few.cast("long") - 1))
    leaders = of_large.filter(share(2, F.ceil(F.col("size") / LEADERS)) == 0).withColumn("salt", every)
    tile = F.xxhash64("component", "salt")
    first = of_large.unionByName(leaders).select("node", tile.alias("tile"), F.col("node").alias("tree"))
    edges = c.stored(_linked(corpus, places, small.unionByName(first), parts).select(F.col("class").alias("a"), F.col("root").alias("b")))
    trees = c.stored(_trees(of_large, edges))
    counts = trees.groupBy("component", "tree").agg(F.count("*").alias("k"))
    biggest = counts.groupBy("component").agg(F.max_by("tree", F.struct("k", -F.col("tree"))).alias("biggest"), (F.sum("k") - F.max("k")).alias("left"))
    # the rest of a component is what its greatest tree leaves; it is cut into blocks of at most wide classes or so
    biggest = biggest.filter(F.col("left") > 0).select("component", "biggest", F.ceil(F.col("left") / wide).cast("long").alias("blocks"))
    told = c.split_join(trees, biggest, ["component"])
    rest = told.filter("tree <> biggest").withColumn("block", share(3, F.col("blocks"))).withColumn("salt", every)
    members = told.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("component", "salt", "block")
    again = members.unionByName(rest.select(*members.columns)).select("node", tile.alias("tile"), "tree")
    more = _linked(corpus, places, again, parts).select(F.col("class").alias("a"), F.col("root").alias("b"))
    joined = edges.unionByName(more).unionByName(trees.select(F.col("node").alias("a"), F.col("tree").alias("b")))
    found = components(joined)
    return gathered.select("node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = components(edges).withColumnRenamed("component", "tree")
    return nodes.join(found, "node", "left").withColumn("tree", F.coalesce("tree", "node"))


def _solve(corpus: c.Corpus, wide: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """All rows described, and the classes (set_a, set_b, copies, low, chunk, place) with their component's number."""
    bits = corpus.message_bits()
    parts = max(int(corpus.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << bits)
    all_docs = c.stored(corpus.rows.mapInArrow(_describe, _SETS_DDL))
    # a class is named after its row: unique even where doc_ids repeat or are null
    own = F.struct(F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("low"), "chunk", "place", "n")
    classes = all_docs.filter("n > 0").groupBy("set_a", "set_b").agg(F.min(own).alias("x"), F.count("*").alias("copies"))
    classes = c.stored(classes.select("set_a", "set_b", "copies", "x.*").withColumn("class", F.xxhash64("chunk", "place")))
    places = classes.select(F.col("class").alias("node"), "chunk", F.col("place").cast("long").alias("place"), "n")
    pairs = F.flatten(F.concat(F.array(F.array(F.lit(-1).cast("long"))), F.collect_list(F.array("place", "node"))))
    told = c.stored(places.groupBy("chunk").agg(c.as_bytes(pairs).alias("reply")))
    asked = corpus.dealt(c.with_replies(corpus, told).mapInArrow(_ask(bits), _MESSAGE_DDL), bits, "bucket")
    counts = asked.groupBy("bucket").applyInArrow(_count, "chunk long, reply binary")
    dealt = c.stored(c.with_replies(corpus, told.unionByName(counts)).mapInArrow(_post(bits, hot), _MESSAGE_DDL))
    tiles = corpus.dealt(dealt.filter("bucket >= 0"), bits, "bucket")
    forest = tiles.groupBy("bucket").applyInArrow(_tile, "a long, b long")
    glued = dealt.filter("bucket < 0")
    if glued.isEmpty():
        gathered = c.stored(components(forest))
    else:
        found = components(forest.unionByName(glued.select("body").mapInArrow(_hot_edges, "a long, b long")))
        gathered = c.stored(found.join(places.select("node"), "node", "left_semi"))
    linked = _exact(corpus, places, gathered, parts, wide).withColumnRenamed("node", "class")
    names = classes.select("class", "set_a", "set_b", "copies", "low", "chunk", "place").join(linked, "class", "left")
    return all_docs, c.stored(names.withColumn("component", F.coalesce("component", "class")))


def join(docs: DataFrame, wide: int = WIDE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    all_docs, names = _solve(c.packed(docs), wide, hot)
    lowest = names.groupBy("component").agg(F.min("low").alias("component_id"))
    answer = c.stored(c.split_join(names, lowest, ["component"]).select("set_a", "set_b", "component_id", F.col("copies").alias("n")))
    out = c.hot_join(all_docs.select("doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b"), answer, ["set_a", "set_b"])
    none = (F.col("n_shingles") == 0) | (F.col("component_id") == _NO_ID)
    return out.select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, wide: int = WIDE, hot: int = HOT) -> DataFrame:
    """The rows of docs, with all their columns, less all but one row of every component (that of the smallest doc_id)."""
    corpus = c.packed(docs, whole=True)
    all_docs, names = _solve(corpus, wide, hot)
    first = names.groupBy("component").agg(F.min(F.struct("low", "chunk", "place")).alias("x")).select("x.chunk", "x.place")
    stay = first.unionByName(all_docs.filter("n = 0").select("chunk", "place"))
    told = stay.groupBy("chunk").agg(c.as_bytes(F.collect_list(F.col("place").cast("long"))).alias("reply"))
    return c.unpacked_rows(c.with_replies(corpus, told).mapInArrow(_keep, c.ROWS_DDL), docs.schema)


def _keep(batches):
    for row in c.rows_of(batches):
        if row["replies"]:
            yield c.rows_at(row, np.sort(np.concatenate([c.numbers_of(x) for x in row["replies"]])))
