"""N-gram Jaccard join: groups of texts whose word-shingle sets are similar, exactly.

Equal sets are one node, named by a fingerprint. Of two sets with similarity t or more, each shares at least
t of its own elements with the other, so among their first (1 - t) n + m elements in any common order, at least m are
common. The order puts frequent shingles last, so that a passage which many texts share seldom decides.

1. `frequent`: shingles that come often among the first elements, found by counts that combine before the shuffle;
2. every text sends its first elements, each with the set's size, to buckets by hash. A set of which fewer than
   m first elements meet another set of fitting size has no partner, and is done: this settles most texts;
3. the sets that are left send fewer first elements, and those that meet are tied into clusters of possible links;
4. each set travels once, to its cluster. A cluster is cut into tiles of bounded size, and pairs of tiles meet.
   A tile is searched breadth first, comparing a set only with sets not reached yet: a group of near copies costs
   about as many comparisons as it has members, and gives a spanning tree of links instead of all pairs. Partners
   of a set lie in a band of sizes and share one of its rarest elements; hashed bitmaps bound the overlap from above by
   bit counts, and what passes is decided by intersecting the sorted sets;
5. connected components of the trees are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.components import components, labels
from cloudloom.llm.tables import attach, bucket_count, joined, lean, pack, row_key, runs, unpack
from cloudloom.llm.words import Words, mix, slices, split_words, window_codes
from cloudloom.session import cut_lineage

SHINGLE, THRESHOLD = 5, 80  # words, per cent
HEAD_BYTES = 5  # of an element's hash that travel; a false meeting only makes a cluster larger
HOT_LOCAL, HOT_TOTAL, HOT_KEEP = 3, 30, 1 << 16  # counted in a task from, frequent from, kept for the order
HOT_SLOTS = 1 << 22
MORE = 10  # per cent of a set's elements, beyond the least, that step 2 looks at
TILE_SETS, TILE_ELEMENTS = 16384, 1 << 23
FLUSH = 1 << 20
SCALE = 1000  # sizes travel as SCALE * log(size)


def shingle_sets(words: Words, size: int):
    """Sorted distinct shingle hashes of each text: runs of `size` words, or all words of a shorter text."""
    codes = window_codes(words.code, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            s = np.sort(codes[a : b - size + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield mix(window_codes(words.code[a:b], b - a) + np.uint64(b - a))
        else:
            yield codes[:0]


def sets_of(batch: pa.RecordBatch, size: int):
    """(row, set) of every text of a batch."""
    for row, data, offsets in slices(batch.column("_text")):
        for i, s in enumerate(shingle_sets(split_words(data, offsets, lower=True), size)):
            yield row + i, s


def _slots(codes: np.ndarray) -> np.ndarray:
    hot = np.zeros(HOT_SLOTS, bool)
    hot[(codes & np.uint64(HOT_SLOTS - 1)).astype(np.int64)] = True
    return hot


def _first(s: np.ndarray, threshold: int, more: int, hot: np.ndarray | None) -> np.ndarray:
    """The first elements of a set in the common order: frequent ones last, else by hash."""
    n = len(s)
    take = min(n, n - -(-threshold * n // 100) + more * n // 100 + 1) if n else 0
    if hot is None:
        return s[:take]
    late = hot[(s & np.uint64(HOT_SLOTS - 1)).astype(np.int64)]
    rare = s[~late]
    return rare[:take] if len(rare) >= take else np.concatenate([rare, s[late][: take - len(rare)]])


def _needed(n: str, threshold: int, more: int):
    """First elements that a set of n elements has in common with any partner, at least: the partner may be smaller."""
    smallest = F.ceil(F.col(n) * threshold / 100)
    return F.floor(smallest * more / 100) + 1


def frequent(base: DataFrame, size: int, threshold: int) -> np.ndarray:
    """Shingles to put last: the most frequent among first elements, a bounded number of them."""

    def count(batches):
        def flush(parts):
            code, n = np.unique(joined(parts, np.uint64), return_counts=True)
            many = n >= HOT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(code[many].view(np.int64)), pa.array(n[many])], ["code", "n"])

        parts, held = [], 0
        for batch in batches:
            for _, s in sets_of(batch, size):
                parts.append(_first(s, threshold, MORE, None))
                held += len(parts[-1])
                if held >= 2 * FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        yield flush(parts)

    counted = base.select("_text").mapInArrow(lean(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    most = counted.filter(F.col("n") >= HOT_TOTAL).orderBy(F.desc("n"), "code").limit(HOT_KEEP)
    return np.array([r["code"] for r in most.select("code").collect()], np.int64).view(np.uint64)


def _slack(threshold: int) -> int:
    """How far apart the scaled sizes of partners are at most."""
    return int(np.ceil(SCALE * np.log(100 / threshold))) + 1


def _chains(code, low, high, slack):
    """Order of entries by code and size, the chain of each (entries with one code whose size ranges touch) and where chains begin."""
    order = np.lexsort((low, code))
    code, low, high = code[order], low[order].astype(np.int64), high[order].astype(np.int64)
    new_code = np.concatenate([[True], code[1:] != code[:-1]])
    group = np.cumsum(new_code) - 1
    reach = np.maximum.accumulate((group << 20) + high)
    begins = new_code.copy()
    begins[1:] |= low[1:] - (reach[:-1] - (group[:-1] << 20)) > slack
    at = np.flatnonzero(begins)
    ranges = code[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
    return order, np.cumsum(begins) - 1, at, ranges


def _stars(chain, begin, node):
    """Nodes (in chain order) that share a chain, directly or by others, as star edges (root, node)."""
    names, index = np.unique(node, return_inverse=True)
    tied = np.flatnonzero(np.concatenate([[False], chain[1:] == chain[:-1]]))
    label = labels(index[tied - 1], index[tied], len(names))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[label[moved]], names[moved]


_PART = pa.schema([("route", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_SENT = "route int, kind int, a binary, b binary, c binary, d binary"
ENTRY, MANY, TIED, MEMBER = range(4)  # kinds of rows


def _parts(route, kind, *columns):
    """Rows of bytes, one per route."""
    order = np.argsort(route, kind="stable")
    begin, count = runs(route[order])
    out = {name: [] for name in _PART.names}
    for s, n in zip(begin, count):
        at = order[s : s + n]
        out["route"].append(int(route[at[0]]))
        out["kind"].append(kind)
        for name, values in zip("abcd", (*columns, *[None] * (4 - len(columns)))):
            packed = kind in (ENTRY, MANY) and name == "a"
            out[name].append(None if values is None else pack(values[at], HEAD_BYTES) if packed else values[at].tobytes())
    return pa.RecordBatch.from_pydict(out, schema=_PART)


def _spread(name, n_buckets):
    return (mix(name.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def _send(heads, owner, size, name, n_buckets, slack, tie):
    """First elements of sets, for the buckets. What meets within this task is told once (`MANY`), by one of its
    sets; the sets themselves are counted (or, with `tie`, tied) here and need not travel."""
    code = joined(heads, np.uint64)
    if not len(code):
        return
    who = np.repeat(np.arange(len(name)), owner)
    scale = SCALE * np.log(size[who])
    order, chain, begin, (c, low, high) = _chains(code, np.floor(scale), np.ceil(scale), slack)
    node = name[who][order]
    alone = np.diff(np.append(begin, len(code))) == 1
    route = ((c >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)
    for kind, these in ((ENTRY, alone), (MANY, ~alone)):
        yield _parts(route[these], kind, c[these], low[these].astype(np.uint16), high[these].astype(np.uint16), node[begin][these])
    if tie:
        a, b = _stars(chain, begin, node)
    else:
        a, b = np.unique(node[~alone[chain]], return_counts=True)
        b = b.astype(np.int64)
    yield _parts(_spread(a, n_buckets), TIED, a, b)


def _first_pass(size, threshold, hot_codes, n_buckets):
    """mapInArrow function over texts: members (row key, size, fingerprint, id) and entries of step 2."""

    def flush(members, heads, owner):
        key, n, name, ids, known = (np.array(x) for x in zip(*members))
        key, n, name, ids = key.astype(np.int64), n.astype(np.int64), name.astype(np.uint64).view(np.int64), ids.astype(np.int64)
        yield _parts(_spread(key, n_buckets), MEMBER, key, n, name, np.where(known, ids, np.iinfo(np.int64).min))
        yield from _send(heads, owner, np.maximum(n, 1), name, n_buckets, _slack(threshold), tie=False)

    def fn(batches):
        hot = _slots(hot_codes)
        members, heads, owner, held, seen = [], [], [], 0, set()
        for batch in batches:
            key, ids = batch.column("_key").to_pylist(), batch.column("_id").to_pylist()
            for row, s in sets_of(batch, size):
                name = int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]) if len(s) else 0
                members.append((key[row], len(s), name, ids[row] or 0, ids[row] is not None))
                heads.append(s[:0] if name in seen else _first(s, threshold, MORE, hot))
                seen.add(name)
                owner.append(len(heads[-1]))
                held += owner[-1] + 1
                if held >= FLUSH:
                    yield from flush(members, heads, owner)
                    members, heads, owner, held, seen = [], [], [], 0, set()
        if members:
            yield from flush(members, heads, owner)

    return fn


def _second_pass(threshold, hot_codes, n_buckets):
    """mapInArrow function over sets: entries of step 3."""

    def fn(batches):
        hot = _slots(hot_codes)
        for batch in batches:
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("elements").to_pylist()]
            heads = [_first(s, threshold, 0, hot) for s in sets]
            name = batch.column("name").to_numpy(zero_copy_only=False)
            size = np.array([len(s) for s in sets])
            yield from _send(heads, [len(h) for h in heads], size, name, n_buckets, _slack(threshold), tie=True)

    return fn


def _meet(threshold, n_buckets, tie):
    """In a bucket: members as they came (kind MEMBER), and sets that meet others (kind TIED): with the number of
    first elements that do (a: set, b: number), or tied (a: root, b: set). Both leave by set, as rows of bytes."""
    slack = _slack(threshold)

    def fn(table: pa.Table) -> pa.Table:
        rows = {k: [] for k in (ENTRY, MANY, TIED, MEMBER)}
        for kind, *cols in zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "c", "d"))):
            rows[kind].append(cols)
        take = lambda kind, i, dtype=np.int64: joined([np.frombuffer(r[i], dtype) for r in rows[kind]], dtype)
        both = lambda i, dtype: np.concatenate([take(ENTRY, i, dtype), take(MANY, i, dtype)])
        code = np.concatenate([joined([unpack(r[0], HEAD_BYTES) for r in rows[k]], np.uint64) for k in (ENTRY, MANY)])
        low, high, node = both(1, np.uint16), both(2, np.uint16), both(3, np.int64)
        many = np.arange(len(code)) >= len(take(ENTRY, 3))
        # copies of one set in several tasks are no partners of each other
        order = np.lexsort((node, code, many))
        new = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (node[order][1:] != node[order][:-1])]) if len(code) else order[:0]
        keep = order[np.flatnonzero(new | many[order]) if len(code) else order]
        code, low, high, node, many = code[keep], low[keep], high[keep], node[keep], many[keep]
        a, b = take(TIED, 0), take(TIED, 1)
        if len(code):
            order, chain, begin, _ = _chains(code, low, high, slack)
            node, many = node[order], many[order]
            if tie:
                x, y = _stars(chain, begin, node)
            else:
                met = np.diff(np.append(begin, len(code)))[chain] > 1
                x, y = np.unique(node[met & ~many], return_counts=True)
            a, b = np.concatenate([a, x]), np.concatenate([b, y])
        out = [_parts(_spread(a, n_buckets), TIED, a, b)]
        if rows[MEMBER]:
            columns = [take(MEMBER, i) for i in range(4)]
            out.append(_parts(_spread(columns[0], n_buckets), MEMBER, *columns))
        return pa.Table.from_batches(out)

    return fn


def _gather(tie):
    """Rows of numbers out of what the buckets found: members, and counts added up by set or distinct ties."""

    def fn(table: pa.Table) -> pa.Table:
        take = lambda kind, c: joined([np.frombuffer(x, np.int64) for k, x in zip(kinds, table[c].to_pylist()) if k == kind], np.int64)
        kinds = table["kind"].to_pylist()
        a, b = take(TIED, "a"), take(TIED, "b")
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if tie:
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
            a, b = a[new], b[new]
        elif len(a):
            begin, _ = runs(a)
            a, b = a[begin], np.add.reduceat(b, begin)
        m, e = len(take(MEMBER, "a")), len(a)
        pad = np.zeros(e, np.int64)
        columns = [np.concatenate([take(MEMBER, c), x]) for c, x in zip("abcd", (a, b, pad, pad))]
        none = np.concatenate([columns[3][:m] == np.iinfo(np.int64).min, np.ones(e, bool)])
        return pa.table(
            [pa.array(np.repeat([MEMBER, TIED], [m, e]), pa.int32()), *(pa.array(c) for c in columns[:3]), pa.array(columns[3], mask=none)],
            names=["kind", "a", "b", "c", "d"],
        )

    return fn


def _meeting(sent: DataFrame, threshold: int, n_buckets: int, tie: bool) -> DataFrame:
    met = sent.groupBy("route").applyInArrow(_meet(threshold, n_buckets, tie), _SENT)
    return met.groupBy("route").applyInArrow(_gather(tie), "kind int, a long, b long, c long, d long")


def _sets(size):
    def fn(batches):
        for batch in batches:
            found = [s for _, s in sets_of(batch, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_name"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                names=["name", "n", "elements"],
            )

    return fn


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One hashed bitmap per set."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        row = np.zeros(bits, bool)
        row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        out[i] = np.packbits(row).view(np.uint64)
    return out


def _rare_first(sets, size, threshold):
    """The elements by which a tile's sets are found: of each set its rarest ones, numbered, without those it has alone."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((number, count[number], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    take = size - -(-threshold * size // 100) + 1
    picked = order[place < np.repeat(take, size)]
    picked = picked[count[number[picked]] > 1]
    return number[picked], owner[picked]


def link_tile(threshold: int):
    """Breadth-first search over the sets of one tile (or pair of tiles): a spanning forest of its links."""

    def fn(table: pa.Table) -> pa.Table:
        names = table["name"].to_numpy()
        _, at = np.unique(names, return_index=True)
        sets = [np.frombuffer(table["elements"][int(i)].as_py(), np.uint64) for i in at]
        size = np.array([len(s) for s in sets])
        order = np.argsort(size, kind="stable")
        names, sets, size = names[at][order], [sets[i] for i in order], size[order]
        element, owner = _rare_first(sets, size, threshold)
        bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
        by_element = np.argsort(element, kind="stable")
        begin, count = runs(element[by_element])
        lists = {int(element[by_element[s]]): owner[by_element[s : s + n]] for s, n in zip(begin, count)}
        band = np.ceil(np.log2(4 * size)).astype(np.int64)  # sizes of one band share a width of bitmap
        maps, row = {}, np.zeros(len(sets), np.int64)
        for w in np.unique(band):
            these = np.flatnonzero(band == w)
            row[these] = np.arange(len(these))
            maps[int(w)] = bitmaps([sets[i] for i in these], max(64, min(1 << int(w), 1 << 14)))
        waiting, edges = np.ones(len(sets), bool), []
        for seed in range(len(sets)):
            if not waiting[seed]:
                continue
            waiting[seed] = False
            stack = [seed]
            while stack:
                x = stack.pop()
                n = size[x]
                near = []
                for e in element[bounds[x] : bounds[x + 1]].tolist():
                    left = lists[e]
                    if len(left):
                        left = left[waiting[left]]  # lists shrink as sets are reached
                        lists[e] = left
                        near.append(left)
                near = np.unique(np.concatenate(near)) if near else bounds[:0]
                # the band of sizes in which links are possible
                near = near[(100 * size[near] >= threshold * n) & (threshold * size[near] <= 100 * n)]
                same = near[band[near] == band[x]]
                if len(same):
                    m, own, other = size[same], maps[int(band[x])][row[x]], maps[int(band[x])][row[same]]
                    most = np.minimum(m - np.bitwise_count(other & ~own).sum(1), n - np.bitwise_count(own & ~other).sum(1))
                    near = np.concatenate([same[100 * most >= threshold * (m + n - most)], near[band[near] != band[x]]])
                if not len(near):
                    continue
                m = size[near]
                flat = np.concatenate([sets[y] for y in near])
                place = np.minimum(np.searchsorted(sets[x], flat), n - 1)
                both = np.add.reduceat((sets[x][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(m)[:-1]]))
                linked = near[100 * both >= threshold * (m + n - both)]
                waiting[linked] = False
                stack.extend(linked.tolist())
                edges.extend((x, y) for y in linked.tolist())
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": names[e[:, 0]], "b": names[e[:, 1]]})

    return fn


def ngram_jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """One row per row of `docs`: `id_col` (an integer), n_shingles, component_id.

    Two texts link when 100 * |intersection| >= threshold * |union| of their sets of lower-cased (A-Z) `size`-word
    shingles. `component_id` is the smallest id reachable by links, the row's own included. Texts without words
    (null, empty, blanks) have 0 shingles and link with nothing. Equal texts and repeated rows link. A null id takes
    part but is never the smallest, unless its group has no other. No rows give no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_key"))
    n_buckets = bucket_count(docs, text_col)
    hot = frequent(base, size, threshold)
    sent = base.mapInArrow(lean(_first_pass(size, threshold, hot, n_buckets)), _SENT)
    met = cut_lineage(_meeting(sent, threshold, n_buckets, tie=False))
    members = met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("n"), F.col("c").alias("name"), F.col("d").alias("id"))
    counts = met.filter(F.col("kind") == TIED).groupBy(F.col("a").alias("name")).agg(F.sum("b").alias("common"))
    reps = members.filter("n > 0").groupBy("name").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    reps = reps.join(counts, "name").filter(F.col("common") >= _needed("n", threshold, MORE))
    reps = cut_lineage(reps.select(F.col("key").alias("_key"), F.col("name").alias("_name")))

    sets = cut_lineage(base.join(reps, "_key").select("_name", "_text").mapInArrow(lean(_sets(size)), "name long, n long, elements binary"))
    sent = sets.select("name", "elements").mapInArrow(lean(_second_pass(threshold, hot, n_buckets), "elements"), _SENT)
    tied = _meeting(sent, threshold, n_buckets, tie=True)
    clusters = components(tied.select("a", "b")).select(F.col("node").alias("name"), F.col("root").alias("cluster"))

    found = attach(sets, clusters, ["name"]).filter("cluster IS NOT NULL")
    tiles = cut_lineage(
        attach(sets.select("name", "n"), clusters, ["name"])
        .filter("cluster IS NOT NULL")
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
        .select("cluster", F.ceil(F.greatest(F.col("sets") / TILE_SETS, F.col("elements") / TILE_ELEMENTS)).cast("int").alias("tiles"))
        .filter("tiles > 1")
    )
    found = attach(found, tiles, ["cluster"]).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("tiles")).cast("int")
    pairs = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "name", "elements")
    links = pairs.groupBy("cluster", "p", "q").applyInArrow(link_tile(threshold), "a long, b long")
    groups = components(links)

    linked = attach(members, groups.select(F.col("node").alias("name"), "root"), ["name"])
    linked = cut_lineage(linked.select("n", "id", F.coalesce("root", "name").alias("root")))
    least = cut_lineage(linked.filter("n > 0").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    return attach(linked, least, ["root"]).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"),
    )
