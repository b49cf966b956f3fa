"""Operator 8, n-gram Jaccard join: an exact metric-space join of shingle sets, and its connected components.

Jaccard distance d is a metric, and linked documents lie within r = 1 - percent/100. Equal sets are one point from the
start. Most texts lie at distance 1 from each other, so pivots are taken where points are near each other:

1. The space of element hashes is cut into T + 1 + slack parts, T being the largest D = |x ^ y| that a link may have among
   sets of that size. D is the sum of its parts, so linked sets agree wholly in 1 + slack parts at least (sizes near the
   border of a size class go to both classes; a set with very many empty parts has keys for those as well). The slack is
   half of T in all but small sets, so that many parts have to agree. A part
   that several points hold alike is an element below. Points that share fewer than linked sets do with all others
   together link with nothing and are left out; so are texts that have but a passage in common.
2. Pivots: a shared element names the point of its list whose elements have the longest lists (their logarithms summed),
   the middle of a group of copies. Voronoi cells: a point measures its distance to the pivots that most of its elements
   name (NEAREST at most) and belongs to the nearest, pivots left out that FEW times fewer points measure than another
   one within CLOSE.
   Links to pivots join points into groups. Only links between groups matter from here on, so what all points of a list
   have in one group is no element any more.
3. Windows: a link (x, y) with x of p's cell needs y to share as many elements with p's cell as links do and, by the triangle
   inequality, d(y, p) <= radius(p) + r, the radius being the greatest distance in the cell. Such points y of other cells
   are replicated into p's region; of two cells only the one with fewer such points, so a link between cells lies in one
   of both regions. An element found in more
   than CELLS cells doesn't replicate: its points join the region of the pivot that it names if such elements are all
   that they may share with some.
4. In a region, points within the limit link to the pivot and so belong together; none of their mutual distances matter
   any more. Left are links with a point x beyond the limit. Seen from p a point is the difference x ^ p, which keeps all
   distances D = |x ^ y|. By the triangle inequality a link (x, y) needs |x ^ p| and |y ^ p| to lie in a window and to
   overlap so much that the first few elements of both (those outside p first) have some in common. Points that share
   such an element form a subregion. One of few points (SMALL) is joined by itself: its points meet those in their
   window, and of the pairs that share enough those are measured whose sketches don't differ in more than a link may. A larger one is a region again, with a pivot of its own, and is
   joined recursively (to DEPTH levels; what is left then is joined by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm import common

SALT = np.uint64(0xA24BAED4963EE407)
#: Pivots that a point measures, cells that an element may replicate into, points of a subregion that is joined by itself,
#: and levels of regions. They bound work, not results.
NEAREST, CELLS, SMALL, DEPTH = 2, 32, 64, 5
#: Pivots that few measure would split a group of copies into cells that replicate each other.
FEW, CLOSE = 8, 0.7
#: So many sets at most does a task remember so as to send the keys of equal sets once.
REMEMBERED = 100_000
#: Classes with T from LARGE on have T / 2 parts beyond T + 1 (SLACK and one for SPREAD of T where that is more, or where T / 2
#: gains no keys), the others FEW_PARTS. Linked sets agree in one more than that. Of these parts as many may be empty as the
#: least sets of the class seldom exceed (four standard deviations), but SHARED are not; in small classes one isn't. Sets
#: below the largest of the class agree in more parts and may have more empty ones. A set with yet more empty parts has keys
#: for those too; all such sets share them, so they have to be few. So larger linked sets share many keys, unlike texts with
#: but a passage in common.
LARGE, SLACK, SPREAD, FEW_PARTS, SHARED = 6, 10, 20, 2, 5
#: More than there are size classes.
CLASSES = 128
#: Bits of a set's sketch.
SKETCH = 1024


def _filled(first: int, most: int, slack: int) -> int:
    """So many of slack + 1 parts aren't empty, as a rule, in sets of `first` elements that are cut into most + 1 + slack parts."""
    usual = (most + 1 + slack) * np.exp(-first / (most + 1 + slack))
    return slack + 1 - int(np.ceil(usual + 4 * np.sqrt(usual)))


def size_classes(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size classes, the parts that each is cut into, how many may be empty, and the keys shared at least."""
    low, parts, slack, least = [1], [], [], []
    while low[-1] < top:
        first = low[-1]
        low.append(max(first + 1, int(first * 1.4)))
        most = (100 - percent) * 2 * (low[-1] - 1) // (100 + percent)
        few = SLACK + most // SPREAD if most >= LARGE else FEW_PARTS
        slack.append(most // 2 if most // 2 > few and _filled(first, most, most // 2) > SHARED else few)
        parts.append(most + 1 + slack[-1] if most else 1)
        least.append(max(SHARED, _filled(first, most, slack[-1])) if most >= LARGE else 1)
    least = np.minimum.accumulate(least[::-1])[::-1]  # larger sets don't share fewer
    return tuple(np.array(x, np.int64) for x in (low[:-1], parts, np.array(slack) + 1 - least, least))


def _may_be_empty(n: int, c: int, percent: int, classes: tuple[np.ndarray, ...]) -> int:
    """So many parts of a set of n elements may be empty in size class c, and it still shares `least` others with what it links with there.

    A partner has 100 / percent as many elements at most, and is of the class or smaller; so fewer parts differ than in
    the largest sets of the class, for which the parts are made.
    """
    low, parts, _, least = classes
    partner = 100 * n // percent
    if c + 1 < len(low):
        partner = min(partner, int(low[c + 1]) - 1)
    return int(parts[c]) - (100 - percent) * (n + partner) // (100 + percent) - int(least[c])


def _class_of(key):
    """Number of the size class, which the key's last bits hold."""
    return key.bitwiseAND(CLASSES - 1).cast("int")


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text of a batch."""
    for first, stop, data, at in common.text_blocks(batch, "__text"):
        starts, ends, doc = common.words_of(data, at)
        h, of = common.shingle_hashes(common.word_hashes(data, starts, ends), doc, stop - first, words)
        edges = np.searchsorted(of, np.arange(stop - first + 1)).tolist()
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            s = np.sort(h[a:b])
            yield first + i, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def mark(s: np.ndarray) -> int:
    """Fingerprint of a set."""
    return int((common.mixed(s ^ SALT).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)) if len(s) else 0


def placed(docs: DataFrame) -> DataFrame:
    """docs with at, a hash of the text where doc_id is null (else null): (doc_id, at) names a row's document, compared null-safe."""
    return docs.withColumn("at", F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))))


def points(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, at (see placed), n (the set's size), f (its fingerprint; 0 for the empty set)."""
    source = placed(docs).select("doc_id", "at", F.col("text").cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f = [], []
            for _, s in _sets(batch, words):
                n.append(len(s))
                f.append(mark(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), pa.array(n, pa.int64()), pa.array(f, pa.int64())], names=["doc_id", "at", "n", "f"])

    return source.mapInArrow(run, f"doc_id {kind}, at long, n long, f long")


def agreements(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, f): one row for each part of each point's set, in its size class and in the next where a link may reach (see _class_of)."""
    source = docs.select(F.col("text").cast("string").alias("__text"))
    classes = low, parts, _, _ = size_classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, marks, rows = [], [], 0
            for _, s in _sets(batch, words):
                if not len(s):
                    continue
                f = mark(s)
                if f in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(f)
                total = np.zeros(len(s) + 1, np.uint64)
                np.cumsum(common.mixed(s ^ SALT), out=total[1:])
                own = int(np.searchsorted(low, len(s), "right")) - 1
                reach = int(np.searchsorted(low, 100 * len(s) // percent, "right")) - 1
                for c in range(own, reach + 1):
                    m = int(parts[c])
                    if m == 1:
                        continue  # no differing sets link here
                    part = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                    edge = np.searchsorted(part, np.arange(m + 1))
                    use = np.flatnonzero(edge[1:] > edge[:-1])
                    if m - len(use) > _may_be_empty(len(s), c, percent, classes):
                        use = np.arange(m)
                    v = (total[edge[1:]] - total[edge[:-1]])[use] + use.astype(np.uint64) * common.MIX_1 + np.uint64(c * int(common.MIX_2) & 0xFFFFFFFFFFFFFFFF)
                    keys.append((common.mixed(v) & ~np.uint64(CLASSES - 1) | np.uint64(c)).astype(np.int64))
                    marks.append(np.full(len(use), f, np.int64))
                    rows += len(use)
                if rows > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks))], names=["key", "f"])
                    keys, marks, rows = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks))], names=["key", "f"])

    return source.mapInArrow(run, "key long, f long")


def sketch(s: np.ndarray) -> np.ndarray:
    """For each value of the hashes' last bits whether an odd number of elements has it, as longs: two sketches differ in
    no more bits than their sets in elements."""
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(f, elements, sketch) of every text with a word."""
    source = docs.select(F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, parts, sketches, size = [], [], [], 0
            for _, s in _sets(batch, words):
                if len(s):
                    f.append(mark(s))
                    parts.append(s.astype(np.int64))
                    sketches.append(sketch(s))
                    size += len(s)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), _lists(parts), _lists(sketches)], names=["f", "elements", "sketch"])
                    f, parts, sketches, size = [], [], [], 0
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), _lists(parts), _lists(sketches)], names=["f", "elements", "sketch"])

    return source.mapInArrow(run, "f long, elements array<long>, sketch array<long>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts)))


def measured(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The columns of edges (p, x and others), size (of x), far and d (the distances D and d), link (d <= r), added (how many
    elements x has outside p), head and least: of the elements of x ^ p, those outside p first and each part ascending,
    so many that a link beyond the pivot shares `least` of them with the head of x's partner (the lesser of both counts)."""
    both = edges.join(sets.select(F.col("f").alias("x"), F.col("elements").alias("xs")), "x").join(sets.select(F.col("f").alias("p"), F.col("elements").alias("ps")), "p")
    both = both.select(*edges.columns, F.size("xs").alias("size"), F.size("ps").alias("own_size"), F.array_except("xs", "ps").alias("more"), F.array_except("ps", "xs").alias("less"))
    union = F.col("own_size") + F.size("more")
    out = both.withColumn("added", F.size("more")).withColumn("far", F.col("added") + F.size("less")).withColumn("d", F.col("far") / union).withColumn("link", 100 * (F.col("size") - F.col("added")) >= percent * union)
    # Partners overlap outside p in all of x's elements there but `apart` of them: that is most of them where x is far from p.
    apart = F.floor((100 - percent) * F.col("size") / F.lit(percent) + 1e-9)
    distant = F.col("added") > apart
    least = F.when(distant, F.least(F.col("added") - apart, F.greatest(F.lit(1), F.ceil((100 - percent) * F.col("size") / F.lit(200))))).otherwise(1)
    # Else one shared element will do. A link (x, y) with x beyond the limit: overlap > far * percent / (100 + percent) for y, and >= far - apart for x.
    near = F.when(F.col("link"), F.col("far") - F.floor(F.col("far") * percent / F.lit(100 + percent) - 1e-9)).otherwise(F.least(F.col("far"), apart + 1))
    first = F.when(distant, apart + least).otherwise(near).cast("int")
    head = F.slice(F.concat(F.sort_array("more"), F.sort_array("less")), F.lit(1), first)
    return out.select(*edges.columns, "size", "far", "d", "link", "added", head.alias("head"), least.cast("int").alias("least"))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The distinct (key, f) whose key several points have; one shuffle serves both the count and the rows.

    It is by far the largest, so its tasks get a quarter of the usual share.
    """
    dealt = keyed.repartition(4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    several = dealt.groupBy("key").agg(F.min("f").alias("low"), F.max("f").alias("high")).filter("low < high").select("key")
    return dealt.join(several, "key").distinct()


def named_pivots(shared: DataFrame, *by: str) -> DataFrame:
    """(*by, p): of the points (f, score) that have the same `by` the one with the greatest score, the least on ties."""
    return shared.groupBy(*by).agg(F.min(F.struct(-F.col("score"), "f"))["f"].alias("p"))


def near_keys(shared: DataFrame, percent: int) -> DataFrame:
    """(key, f, need, keys, score) of the shared keys, in size classes in which a point has enough of them: need is how many
    a link takes at least, keys their number, score how long their lists are."""
    _, _, _, least = size_classes(percent)
    kind = _class_of(F.col("key")).alias("kind")
    lists = shared.groupBy("key").agg(F.count("*").alias("met"))
    enough = shared.join(lists, "key").groupBy("f", kind).agg(F.count("*").alias("keys"), F.sum(F.floor(16 * F.log2("met"))).alias("score"))
    enough = enough.withColumn("need", F.element_at(F.array(*map(F.lit, least.tolist())), F.col("kind") + 1)).filter("keys >= need")
    enough = common.materialize(enough, "enough")
    total = enough.groupBy("f").agg(F.min("need").alias("need"), F.sum("keys").alias("keys"), F.sum("score").alias("score"))
    near = shared.select("key", "f", kind).join(enough.select("f", "kind"), ["f", "kind"]).join(total, "f")
    return common.materialize(near.select("key", "f", "need", "keys", "score"), "near_keys")


def sets_needed(docs: DataFrame, classes: DataFrame, used: DataFrame, words: int) -> DataFrame:
    """(f, elements, sketch) of the points in used (f)."""
    ids = common.materialize(classes.join(used, "f", "left_semi").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.at").alias("rep_at")), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & F.col("at").eqNullSafe(F.col("rep_at"))
    return common.materialize(sets_of(placed(docs.select("doc_id", "text")).join(ids, same, "left_semi"), words).dropDuplicates(["f"]), "sets")


def subregions(near: DataFrame) -> DataFrame:
    """(g, e, x, group, size, far, link, own, least, other, n, outer): points of region g by an element e of their heads, where
    such a list has n > 1 points, of several groups, and `outer` > 0 beyond the limit. other: may be the far end of an outer
    point's link.

    A point y with at least as many elements outside p as it lacks of p (that is, not smaller than p) must share one of
    the former with x: the overlap exceeds what y lacks. So what points lack of p, the only thing that copies with
    unrelated edits have in common, is a key of y only where y is smaller than p.
    """
    one = near.select("g", "x", "group", "size", "far", "link", "own", "added", "least", F.posexplode("head").alias("i", "e"))
    one = one.withColumn("other", (F.col("i") < F.col("added")) | (2 * F.col("added") < F.col("far"))).filter("other or not link").drop("i", "added").repartition("g", "e")
    lists = one.groupBy("g", "e").agg(F.count("*").alias("n"), F.count_if(~F.col("link")).alias("outer"), F.max("own").alias("any"), F.min("group").alias("low"), F.max("group").alias("high"))
    return one.join(lists.filter("n > 1 and outer > 0 and any and low < high").drop("any", "low", "high"), ["g", "e"])


def joined(small: DataFrame, large: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): the links between groups with a point beyond the limit in the subregions of small, each of few points. Elements in
    large subregions count as shared here; pairs that share no others meet there."""
    if large is not None:
        small = small.join(large.groupBy("g", "x").agg(F.count("*").alias("besides")), ["g", "x"], "left").withColumn("least", F.col("least") - F.coalesce("besides", F.lit(0)))
    x = small.filter("not link").select("g", "e", "x", "group", "size", "far", "own", "least")
    y = small.filter("other").select("g", "e", F.col("x").alias("y"), F.col("group").alias("group_y"), F.col("size").alias("size_y"), F.col("link").alias("link_y"), F.col("far").alias("far_y"), F.col("own").alias("own_y"), F.col("least").alias("least_y"))
    windows = f"""group <> group_y and (link_y or x < y) and (own or own_y) and 100 * least(size, size_y) >= {percent} * greatest(size, size_y)
        and abs(far - far_y) * {100 + percent} <= {100 - percent} * (size + size_y)"""
    apart = F.floor((100 - percent) * (F.col("size") + F.col("size_y")) / F.lit(100 + percent) + 1e-9)
    pairs = x.join(y, ["g", "e"]).filter(windows).groupBy("g", "x", "y").agg(F.count("*").alias("met"), F.min(F.least("least", "least_y")).alias("least"), F.first(apart).alias("apart"))
    pairs = common.materialize(pairs.filter("met >= least").select("x", "y", "apart").distinct(), "met_pairs")
    # sketches first: they are far shorter than sets, and in a large group of copies most pairs have many edits between them
    drawn = pairs.join(sets.select(F.col("f").alias("x"), F.col("sketch").alias("sx")), "x").join(sets.select(F.col("f").alias("y"), F.col("sketch").alias("sy")), "y")
    differ = F.aggregate(F.zip_with("sx", "sy", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, b: n + b)
    pairs = common.materialize(drawn.filter(differ <= F.col("apart")).select("x", "y"), "pairs")
    both = pairs.join(sets.select(F.col("f").alias("x"), F.col("elements").alias("xs")), "x").join(sets.select(F.col("f").alias("y"), F.col("elements").alias("ys")), "y")
    shared = F.size(F.array_intersect("xs", "ys"))
    return both.filter(100 * shared >= percent * (F.size("xs") + F.size("ys") - shared)).select(F.col("x").alias("u"), F.col("y").alias("v"))


def settled(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links enough to connect whatever links connect in the regions of near: measured points (g, p, x, own, group),
    where g names the region and one end of a link at least must be its own. Points of one group are connected already."""
    found = None
    for level in range(1, DEPTH + 1):
        direct = near.filter("link and p <> x").select(F.col("p").alias("u"), F.col("x").alias("v"))
        busy = common.materialize(subregions(near), "busy")
        small = F.lit(True) if level == DEPTH else F.col("n") * F.col("outer") <= SMALL * SMALL
        large = busy.filter(~small)
        last = level == DEPTH or large.isEmpty()
        met = common.materialize(direct.union(joined(busy.filter(small), None if last else large, sets, percent)).distinct(), "met")
        found = met if found is None else found.union(met)
        if last:
            return found
        # the middle differs from the pivot in what most points differ from it in, and in little else
        score = large.groupBy("g", "x").agg((F.sum(F.log2("n")) / F.first("far")).cast("float").alias("score"))
        pivots = named_pivots(large.join(score, ["g", "x"]).withColumnRenamed("x", "f"), "g", "e")
        edges = large.join(pivots, ["g", "e"]).select(F.xxhash64("g", "p").alias("g"), "p", "x", "group", (~F.col("link")).alias("own")).distinct()
        near = common.materialize(measured(common.materialize(edges, "edges"), sets, percent), "near")
        common.discard(busy)


def one_way(border: DataFrame) -> DataFrame:
    """Of the border points (p, x, home) of two cells those of the cell that has fewer of them.

    Both ends of a link between two cells are border points, each of the other's cell, so one of them in the other's
    region is enough.
    """
    ways = border.groupBy("home", "p").agg(F.count("*").alias("there"))
    back = ways.select(F.col("p").alias("home"), F.col("home").alias("p"), F.col("there").alias("back"))
    taken = ways.join(back, ["home", "p"], "left").filter("back is null or there < back or (there = back and home < p)")
    return border.join(taken.select("home", "p"), ["home", "p"], "left_semi")


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v) fingerprints of linked points: links enough to connect whatever links connect."""
    shared = common.materialize(shared_keys(agreements(docs, words, percent)), "shared")
    mine = near_keys(shared, percent)
    pivots = common.materialize(named_pivots(mine, "key"), "pivots")
    sets = sets_needed(docs, classes, mine.select("f").distinct(), words)
    common.discard(shared)

    # cells
    met = mine.join(pivots, "key").groupBy(F.col("f").alias("x"), "p").agg(F.count("*").alias("named"), F.first("keys").alias("keys"))
    met = met.filter("p <> x or 2 * named >= keys").withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("named"), "p"))).filter(F.col("rank") <= NEAREST)
    met = common.materialize(met.select("p", "x"), "met")
    tried = common.materialize(measured(met, sets, percent), "tried")
    others = Window.partitionBy("x")
    ranked = tried.join(met.groupBy("p").agg(F.count("*").alias("named")), "p").select("x", "p", "d", F.when(F.col("d") <= CLOSE, F.col("named")).otherwise(0).alias("named"))
    ranked = ranked.withColumn("few", FEW * F.col("named") < F.max("named").over(others))
    home = ranked.groupBy("x").agg(F.min(F.struct("few", "d", "p")).alias("home")).select("x", F.col("home.p").alias("p"), F.col("home.d").alias("d"))
    direct = common.materialize(tried.filter("link and p <> x").select(F.col("p").alias("u"), F.col("x").alias("v")), "direct")
    group = components(direct, classes).select(F.col("f").alias("x"), F.col("label.f").alias("group"))
    home = common.materialize(home.join(group, "x", "left").withColumn("group", F.coalesce("group", "x")), "home")
    own = tried.join(home.select("p", "x", "group"), ["p", "x"]).withColumn("own", F.lit(True))
    common.discard(met)

    # borders: who shares enough elements with another cell, of those elements that points of several groups have
    at = mine.join(home.select(F.col("x").alias("f"), F.col("p").alias("home"), "group"), "f").select("key", F.col("f").alias("x"), "need", "home", "group")
    at = common.materialize(at, "at")
    mixed = at.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("key")
    dealt, at = at, at.join(mixed, "key")
    enough = at.groupBy("x").agg(F.count("*").alias("keys"), F.first("need").alias("need")).filter("keys >= need").select("x")
    at = common.materialize(at.join(enough, "x", "left_semi").drop("group"), "at")
    common.discard(mine, dealt)
    cells = common.materialize(at.select("key", F.col("home").alias("p")).distinct(), "cells")
    crowded = common.materialize(cells.groupBy("key").count().filter(F.col("count") > CELLS).select("key"), "crowded")
    across = at.join(cells.join(crowded, "key", "left_anti"), "key").filter("p <> home").groupBy("x", "p").agg(F.count("*").alias("met"), F.first("need").alias("need"), F.first("home").alias("home"))
    in_crowds = at.join(crowded, "key", "left_semi")
    more = in_crowds.groupBy("x").agg(F.count("*").alias("more"), F.first("need").alias("least"))
    border = across.join(more, "x", "left").filter(F.col("met") + F.coalesce("more", F.lit(0)) >= F.col("need")).select("p", "x", "home")
    border = one_way(common.materialize(border, "border")).select("p", "x", F.lit(False).alias("own"))
    # pairs of which one has fewer crowded elements than links share have others in common, and meet at a border
    crowds = in_crowds.join(more, "x").filter("more >= least").select("key", "x").join(pivots, "key").select("p", "x", F.lit(True).alias("own")).distinct()
    edges = border.union(crowds).groupBy("p", "x").agg(F.max("own").alias("own")).join(home.select("p", "x"), ["p", "x"], "left_anti")
    radius = home.groupBy("p").agg(F.max("d").alias("radius"))
    edges = edges.join(home.select("x", "group"), "x")
    others = measured(common.materialize(edges, "edges"), sets, percent).join(radius, "p", "left")
    others = others.filter(F.col("own") | (F.col("d") <= F.col("radius") + (100 - percent) / 100 + 1e-9)).drop("radius")
    near = common.materialize(own.unionByName(others).withColumn("g", F.col("p")), "near")
    common.discard(tried, at, cells)
    return direct.union(settled(near, sets, percent))


def links_by_keys(docs: DataFrame, classes: DataFrame, words: int, percent: int, keyed: DataFrame) -> DataFrame:
    """(u, v) fingerprints of linked points, enough to connect whatever links connect points that share a key of keyed (key, f)."""
    shared = common.materialize(shared_keys(keyed), "shared")
    score = shared.groupBy("f").agg(F.count("*").alias("score"))
    pivots = named_pivots(shared.join(score, "f"), "key")
    edges = shared.join(pivots, "key").select(F.col("p").alias("g"), "p", F.col("f").alias("x"), F.col("f").alias("group"), F.lit(True).alias("own")).filter("p <> x").distinct()
    edges = common.materialize(edges, "edges")
    sets = sets_needed(docs, classes, shared.select("f"), words)
    return settled(common.materialize(measured(edges, sets, percent), "near"), sets, percent)


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(f, label): the least rep of each point's connected component, for the points that edges (u, v) name.

    Labels sink along edges and then jump to the label of the point that lent theirs, until none changes.
    """
    both = common.materialize(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    now = common.materialize(both.select(F.col("u").alias("f")).distinct().join(labels.select("f", F.col("rep").alias("label")), "f"), "label")
    while True:
        seen = both.join(now.select(F.col("f").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = now.join(seen.select(F.col("u").alias("f"), "near"), "f").select("f", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        low = common.materialize(low.withColumn("owner", F.col("label.f")), "low")
        jumped = low.join(low.select(F.col("f").alias("owner"), F.col("label").alias("next")), "owner", "left")
        after = common.materialize(jumped.select("f", "was", F.least("label", "next").alias("label")), "label")
        if after.filter("label < was").isEmpty():
            return after.select("f", "label")
        now = after.select("f", "label")


def labelled(docs: DataFrame, words: int, percent: int, keyed: DataFrame | None = None) -> DataFrame:
    """doc_id, at, n and label (null for the empty set) of every document, over all links, or those between points that share a key of keyed.

    A label is the rep of the component's first point: none (no row of it has an id), the least doc_id, the least at
    where none, and its fingerprint. So a point without an id has a label too, and comes after those with one.
    """
    docs = docs.select("doc_id", "text")
    known = common.materialize(points(docs, words), "points")
    first = F.min("doc_id")
    rep = F.struct(first.isNull().alias("none"), first.alias("doc_id"), F.when(first.isNull(), F.min("at")).alias("at"), F.col("f").alias("f"))
    classes = common.materialize(known.filter("n > 0").groupBy("f").agg(rep.alias("rep"), F.max("n").alias("n")), "classes")
    linked = links(docs, classes, words, percent) if keyed is None else links_by_keys(docs, classes, words, percent, keyed)
    label = components(linked, classes)
    named = common.materialize(classes.join(label, "f", "left").select("f", F.coalesce("label", "rep").alias("label")), "named")
    return known.join(named, "f", "left").select("doc_id", "at", "n", "label")


def classes_of(docs: DataFrame, words: int, percent: int, keyed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, over all links, or those between points that share a key of keyed."""
    found = labelled(docs, words, percent, keyed)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("label.doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every document.

    Sets of distinct `words`-word shingles over lower-cased words; shorter texts count as one shingle; null texts and
    texts without a word are empty and link with nothing. Rows that repeat a doc_id are each returned, under the
    component of their text; an empty table gives no rows; other columns are left out. Rows with a null doc_id link
    and are measured like others, but lend no id: their component_id is the least doc_id that links reach, and null
    only where no row of the component has one.
    """
    common.bound_batches(docs.sparkSession)
    return classes_of(docs, words, percent)


def first_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that hold the first document of their component: the one with the least doc_id.

    Components without an id keep one row, with the least hash of its text among the rows of one of their sets (the
    least row on ties). Texts without a word are all kept.
    """
    common.bound_batches(docs.sparkSession)
    found = labelled(docs, words, percent)
    later = ~(F.col("doc_id").eqNullSafe(F.col("label.doc_id")) & F.col("at").eqNullSafe(F.col("label.at")))
    gone = common.materialize(found.filter(F.col("label").isNotNull() & later).select(F.col("doc_id").alias("gone_id"), F.col("at").alias("gone_at")).distinct(), "gone")
    named = docs.filter("doc_id is not null").join(gone.filter("gone_id is not null"), F.col("doc_id") == F.col("gone_id"), "left_anti")
    nameless = docs.filter("doc_id is null")
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = placed(nameless.filter(worded)).join(gone.filter("gone_id is null"), F.col("at") == F.col("gone_at"), "left_anti").groupBy("at").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return named.unionByName(nameless.filter(~worded)).unionByName(single.select("row.*"))
