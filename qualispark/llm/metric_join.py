"""Similar documents as a join in the metric space of word sets.

A document is the set of its distinct word shingles (five words); the Jaccard
distance of two sets is a metric, and a link is a distance of 0.2 or less.
Pivots cut the space into regions, and regions are joined on their own:

* The first pivots are sets of one shingle. A document is closer than 1 to the
  pivots whose shingle it has, and at 1 from all others, so its region is a
  ball. Since documents are at distance 1 from nearly everything, the triangle
  inequality could not keep a document out of any ball; the overlap that a link
  needs can: two linked documents meet in the ball of a rare shingle of both
  (the first ``size - needed + 1`` in order of rarity), so a document goes to
  the balls of these alone.
* Inside a ball distances spread, and the pivots are documents. A document's
  home is the Voronoi cell of its nearest pivot. If x (home i) and y (home j)
  are within t of each other, then d(y, i) <= d(x, i) + t <= d(x, j) + t <=
  d(y, j) + 2t: so y is also a guest in cell i when it is that close to the
  border. Pairs of different homes are found in the cell of the lower number,
  pairs of guests in the cells that are their homes.
* The first document pivot of a ball is its smallest point by a hash, so balls
  of nearly the same points share it and each point meets it once. Balls whose
  points this pivot's links join to one component are done.
* A cell is cut again in the same way. A small one (``REGION`` documents) is
  joined by one task, which goes on cutting it until few documents are left or
  the pivots no longer separate them; there every pair that the distances to
  the pivots allow (they never differ by more than t) is compared. A large one
  that pivots don't separate meets block by block, without a limit.

Texts of the same words are one point, and a pair is compared only while no
chain of links joins its points: links leave as a spanning set of each
component, so a family of near copies costs rows in proportion to its members.
Distances are exact fractions of integers; bounds are widened by a billionth,
which adds comparisons and changes no link. Shingles are compared by 46 bits of
a hash, so that a set travels as steps of five bytes or so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.llm import line_dedup as lines
from qualispark.llm.common import arrow_map, raw_texts, written
from qualispark.llm.near_documents import _parities, _width, texts_of
from qualispark.llm.simhash import components

#: Documents of a region that one task joins.
REGION = 512
#: Documents that are compared without further pivots.
LEAF = 24
PIVOTS = 4
#: Greatest distance of a link: similarity is a fraction n / d.
RADIUS = 1 - lines.SIMILARITY[0] / lines.SIMILARITY[1]
_SLACK = 1e-9
_KEY = ["region", "one", "two"]
_HASH = (1 << 46) - 1
#: Rows whose sets a task unpacks at a time.
_SLICE = 256


def packed(tokens: np.ndarray) -> bytes:
    """A set as the steps between its sorted hashes, each in as many bytes as the widest needs."""
    steps = np.diff(np.unique(tokens & _HASH), prepend=0).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, : data[0]] = steps
    return np.cumsum(wide.view("<u8").ravel().astype(np.int64))


def _linked(shared, a, b):
    """Whether sets of sizes a and b with so many common shingles are within the radius."""
    n, d = lines.SIMILARITY
    return d * shared >= n * (a + b - shared)


class Region:
    """Points of one region, joined by recursive Voronoi cells."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        self.names, self.sets = names, sets
        self.size = np.array([len(s) for s in sets])
        self.root = np.arange(len(sets))
        self.compared = 0

    def _shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Common shingles of the pivot with each other point."""
        mine = self.sets[pivot]
        every = np.concatenate([self.sets[i] for i in others])
        at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        starts = np.concatenate(([0], np.cumsum(self.size[others])[:-1]))
        self.compared += len(others)
        return np.add.reduceat((mine[at] == every).astype(np.int64), starts)

    def _meet(self, pivot: int, others: np.ndarray, found: list) -> np.ndarray:
        """Distances to the pivot; links go to ``found`` unless known."""
        shared = self._shared(pivot, others)
        a, b = self.size[pivot], self.size[others]
        for i in others[_linked(shared, a, b)].tolist():
            if self.root[i] != self.root[pivot]:
                self.root[self.root == self.root[i]] = self.root[pivot]
                found.append((self.names[pivot], self.names[i]))
        return 1 - shared / (a + b - shared)

    def _settled(self, points: np.ndarray) -> bool:
        return len(points) < 2 or bool((self.root[points] == self.root[points[0]]).all())

    def join(self, own: np.ndarray, guests: np.ndarray) -> list[tuple[int, int]]:
        """Links that join all points of ``own`` to those of ``own`` and ``guests`` that they are linked to."""
        found: list[tuple[int, int]] = []
        self._join(own, guests, found)
        return found

    def _join(self, own: np.ndarray, guests: np.ndarray, found: list) -> None:
        every = np.concatenate((own, guests))
        if not len(own) or self._settled(every):
            return
        if len(every) <= LEAF:
            return self._pairs(own, every, np.zeros((0, len(every))), found)
        far, pivots = [], [0]
        while len(pivots) <= PIVOTS:  # each next pivot is the own point farthest from the others
            far.append(self._meet(every[pivots[-1]], every, found))
            farthest = int(np.min(far, axis=0)[: len(own)].argmax())
            if len(pivots) == PIVOTS or np.min(far, axis=0)[farthest] <= RADIUS:
                break
            pivots.append(farthest)
        if self._settled(every):
            return None
        far = np.array(far)
        home, nearest = far.argmin(axis=0), far.min(axis=0)
        mine = np.arange(len(every)) < len(own)
        for k in range(len(far)):
            here = mine & (home == k)
            if not here.any():
                continue
            reach = far[k, here].max() + RADIUS
            near = (far[k] <= nearest + 2 * RADIUS + _SLACK) & (far[k] <= reach + _SLACK)
            beside = near & ~here & (~mine | (home > k))
            if here.sum() + beside.sum() <= 0.8 * len(every):
                self._join(every[here], every[beside], found)
            else:
                both = np.concatenate((np.flatnonzero(here), np.flatnonzero(beside)))
                self._pairs(every[here], every[both], far[:, both], found)
        return None

    def _pairs(self, own: np.ndarray, every: np.ndarray, far: np.ndarray, found: list) -> None:
        """Each own point (the first of ``every``) with the later ones that sizes and pivots allow."""
        n, d = lines.SIMILARITY
        for i, x in enumerate(own.tolist()):
            rest = every[i + 1 :]
            a, b = self.size[x], self.size[rest]
            fits = (self.root[rest] != self.root[x]) & (n * np.maximum(a, b) <= d * np.minimum(a, b))
            if len(far):
                fits &= (np.abs(far[:, i + 1 :] - far[:, i : i + 1]) <= RADIUS + _SLACK).all(axis=0)
            if fits.any():
                self._meet(x, rest[fits], found)


def _groups(batches, *columns: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Keys and rows of whole groups of consecutive rows; of a point's rows the first (not a guest) counts."""
    last, held, names = None, [], set()
    for b in (whole.slice(at, _SLICE) for whole in batches for at in range(0, whole.num_rows, _SLICE)):
        keys = zip(*(b.column(k).to_pylist() for k in _KEY), strict=True)
        rows = zip(*(b.column(k).to_pylist() for k in ("cls", "guest", *columns)), strict=True)
        for key, row in zip(keys, rows, strict=True):
            if key != last:
                if len(held) > 1:
                    yield last, held
                last, held, names = key, [], set()
            if row[0] not in names:
                names.add(row[0])
                held.append(row)
    if len(held) > 1:
        yield last, held


def _possible(members: list[tuple]) -> list[tuple]:
    """The members that sizes and parities let be linked to another that is no guest with it.

    A row is cls, guest, size, parities: the number of bits in which two maps
    differ is a lower bound of the sets' difference.
    """
    n, d = lines.SIMILARITY
    size = np.array([m[2] for m in members])
    own = ~np.array([m[1] for m in members])
    width = np.array([_width(s) for s in size.tolist()])
    stays = np.zeros(len(members), bool)
    for w in np.unique(width).tolist():
        like, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        maps = [np.frombuffer(members[i][3], np.uint64) for i in like.tolist()]
        for i in wide.tolist():
            m = np.frombuffer(members[i][3], np.uint64)
            maps.append(m[: len(m) // 2] ^ m[len(m) // 2 :])
        maps, both = np.array(maps), np.concatenate((like, wide))
        for k, i in enumerate(like.tolist()):
            a, b = size[i], size[both]
            least = -(-n * (a + b) // (n + d))
            fits = (own[i] | own[both]) & (n * np.maximum(a, b) <= d * np.minimum(a, b))
            fits[: k + 1] = False
            if fits.any():
                apart = np.bitwise_count(maps[fits] ^ maps[k]).sum(axis=1)
                near = both[fits][apart <= (a + b - 2 * least)[fits]]
                if len(near):
                    stays[i] = stays[near] = True
    return [m for m, stay in zip(members, stays.tolist(), strict=True) if stay]


def _words(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, cls (a name for the text's words, null without words), n_shingles of every row."""

    def rows(batches):
        for b in lines._batches(batches):
            raw = [_words(t) for t in raw_texts(b.column("text"))]
            full = [w for w in raw if w]
            counts = []
            if full:
                token, size = lines.shingles(full)
                ends = np.cumsum(size)
                counts = [len(np.unique(token[e - n : e])) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            name, number = iter(lines.classes(full).tolist()), iter(counts)
            cls = [next(name) if w else None for w in raw]
            yield {"doc_id": b.column("doc_id"), "cls": cls, "n_shingles": [next(number) if w else 0 for w in raw]}

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_map(own, rows, "doc_id long, cls long, n_shingles long")


class _Join:
    """The steps of one join over the texts of ``own``."""

    def __init__(self, docs: DataFrame, text_col: str):
        flat = F.translate(F.col(f"`{text_col}`"), "\n", " ")
        self.own = docs.select(flat.alias("text"))
        self.sketch = lines.rarity_sketch(self.own)

    def made(self, texts: DataFrame, make) -> DataFrame:
        """cls, size and what ``make`` makes of the ordered shingles of each text, once a class."""
        sketch = self.sketch

        def rows(batches):
            rarity = sketch.value
            for b in lines._batches(batches):
                raw = list(dict.fromkeys(lines.line_words(lines._texts(b))[2]))
                if raw:
                    token, size = lines.ordered(raw, rarity)
                    ends = np.cumsum(size).tolist()
                    cut = [make(token[e - n : e]) for e, n in zip(ends, size.tolist(), strict=True)]
                    yield {"cls": pa.array(lines.classes(raw)), "size": size, "made": pa.array(cut, pa.binary())}

        once = arrow_map(texts, rows, "cls long, size int, made binary").groupBy("cls").agg(F.first(F.struct("size", "made")).alias("x"))
        return once.select("cls", "x.size", "x.made")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """cls, made: the whole sets of the points that ``wanted`` names."""
        return self.made(texts_of(self.own, wanted), packed).select("cls", "made")

    def grouped(self, members: DataFrame, more: DataFrame) -> DataFrame:
        return members.join(more, "cls").repartition(*_KEY).sortWithinPartitions(*_KEY, "guest")

    def possible(self, members: DataFrame) -> DataFrame:
        """Of groups ``members`` (region, one, two, cls, guest) the points that sizes and parities let be linked."""

        def thin(batches):
            for group, rows in _groups(batches, "size", "made"):
                stay = _possible(rows)
                if stay:
                    cls, guest = zip(*(m[:2] for m in stay), strict=True)
                    yield {k: [v] * len(stay) for k, v in zip(_KEY, group, strict=True)} | {"cls": cls, "guest": guest}

        maps = self.made(self.own, _parities)
        return written(arrow_map(self.grouped(members, maps), thin, "region long, one int, two int, cls long, guest boolean"), "possible")

    def joined(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b: the links within groups of ``members``."""

        def join(batches):
            for _, rows in _groups(batches, "made"):
                own = sum(not m[1] for m in rows)  # these come first
                region = Region([m[0] for m in rows], [unpacked(m[2]) for m in rows])
                found = region.join(np.arange(own), np.arange(own, len(rows)))
                yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

        return arrow_map(self.grouped(members, sets), join, "a long, b long")

    def measured(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pivot, cls, size_pivot, size, shared of distinct pairs (pivot, cls), a pivot's points dealt to several tasks."""
        deals = written(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / REGION).cast("int").alias("deals")), "deals")
        dealt = pairs.join(deals, "pivot").select(F.col("pivot").alias("region"), F.pmod(F.hash("cls"), "deals").alias("one"), F.lit(0).alias("two"), "cls", F.lit(True).alias("guest"))
        hubs = deals.select(F.col("pivot").alias("region"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("one"))
        hubs = hubs.select("region", "one", F.lit(0).alias("two"), F.col("region").alias("cls"), F.lit(False).alias("guest"))

        def measure(batches):
            for (pivot, _, _), rows in _groups(batches, "made"):
                region = Region([m[0] for m in rows], [unpacked(m[2]) for m in rows])
                others = np.arange(1, len(rows))
                yield {
                    "pivot": [pivot] * len(others),
                    "cls": region.names[1:],
                    "size_pivot": [len(region.sets[0])] * len(others),
                    "size": region.size[1:],
                    "shared": region._shared(0, others),
                }

        members = self.grouped(dealt.unionByName(hubs), sets)
        return written(arrow_map(members, measure, "pivot long, cls long, size_pivot long, size long, shared long"), "distances")


def _close(distances: DataFrame) -> DataFrame:
    ok = _linked(F.col("shared"), F.col("size_pivot"), F.col("size"))
    return distances.filter(ok).select(F.col("pivot").alias("a"), F.col("cls").alias("b"))


def _open(regions: DataFrame, links: DataFrame) -> DataFrame:
    """region, cls, guest, root, top, n, outside: the regions whose points are in several components, the largest on top."""
    known = components(links)
    placed = written(regions.join(known, F.col("cls") == F.col("node"), "left").select("region", "cls", "guest", F.coalesce("root", "cls").alias("root")), "placed")
    parts = placed.groupBy("region", "root").agg(F.count("*").alias("n"))
    tops = parts.groupBy("region").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside"))
    tops = written(tops.filter("outside > 0").select("region", F.col("top.root").alias("top"), "n", "outside"), "tops")
    return written(placed.join(tops, "region"), "open")


def _blocks(regions: DataFrame) -> DataFrame:
    """Groups of regions that pivots don't separate: points outside the largest part (dealt out) against every block of all."""
    deals, blocks = F.ceil(F.col("outside") / REGION).cast("int"), F.ceil(F.col("n") / REGION).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    few = regions.filter("root <> top").select("region", F.pmod(F.hash("cls"), deals).alias("one"), each(blocks).alias("two"), "cls", F.lit(False).alias("guest"))
    many = regions.select("region", each(deals).alias("one"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("two"), "cls", F.lit(True).alias("guest"))
    return few.unionByName(many).withColumn("one", -F.col("one") - 1)


def _cells(regions: DataFrame, pivots: DataFrame, distances: DataFrame, level: int) -> DataFrame:
    """region, cls, guest, of: the Voronoi cells of each region, borders included."""
    each = regions.join(pivots, "region").select("region", "cls", "guest", "n", F.posexplode("pivots").alias("k", "pivot"))
    d = F.when(F.col("cls") == F.col("pivot"), 0.0).otherwise(1 - F.col("shared") / (F.col("size_pivot") + F.col("size") - F.col("shared")))
    far = each.join(distances, ["pivot", "cls"], "left").groupBy("region", "cls").agg(F.min("guest").alias("guest"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", d.alias("d")))).alias("far"))
    nearest = F.array_min(F.transform("far", lambda e: F.struct(e["d"], e["k"])))
    homed = far.withColumns({"home": nearest["k"], "least": nearest["d"]})
    goes = F.filter("far", lambda e: (e["k"] == F.col("home")) | ((F.col("guest") | (e["k"] < F.col("home"))) & (e["d"] <= F.col("least") + 2 * RADIUS + _SLACK)))
    dealt = homed.select("region", "cls", "guest", "home", "n", F.explode(F.transform(goes, lambda e: e["k"])).alias("k"))
    return dealt.select(
        F.xxhash64(F.lit(level), "region", "k").alias("region"), "cls", (F.col("guest") | (F.col("k") != F.col("home"))).alias("guest"), F.col("n").alias("of")
    )


def links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """a, b: links whose components are those of all linked pairs of points."""
    work = _Join(docs, text_col)
    found = lines.runs(lines._postings(work.own.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("dhash"), "text"), work.sketch), REGION)
    zero, never = F.lit(0), F.lit(False)
    small = found.filter("gid is not null").select(F.col("gid").alias("region"), zero.alias("one"), zero.alias("two"), "cls", never.alias("guest")).distinct()
    large = found.filter("gid is null").select(F.col("token").alias("region"), "cls", never.alias("guest"))
    regions = work.possible(small).select("region", "cls", "guest").unionByName(large)
    sets = written(work.sets(regions), "sets")
    # One pivot for each ball, the same one for balls of nearly the same points: what it links needs no more pairs.
    first = written(regions.groupBy("region").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("x")).select("region", F.col("x.cls").alias("pivot")), "pivots")
    stars = _close(work.measured(regions.join(first, "region").filter("cls <> pivot").select("pivot", "cls").distinct(), sets))
    members = None
    regions, level = _open(regions, stars), 0
    while True:
        level += 1
        small = regions.filter(F.col("n") <= REGION)
        small = small.select("region", F.lit(level).alias("one"), zero.alias("two"), "cls", "guest")
        members = members.unionByName(small) if members else small
        regions = regions.filter(F.col("n") > REGION)
        if regions.isEmpty():
            # Spark's size of blocks does not count how often their points are in them: they are never to be broadcast
            return stars.unionByName(work.joined(members if level == 1 else members.hint("merge"), sets))
        salted = [F.min(F.when(F.col("root") != F.col("top"), F.struct(F.xxhash64(F.lit(level * PIVOTS + k), "cls").alias("h"), "cls"))) for k in range(PIVOTS - 1)]
        on_top = F.min(F.when(F.col("root") == F.col("top"), F.struct(F.xxhash64(F.lit(level), "cls").alias("h"), "cls")))
        chosen = regions.groupBy("region").agg(*(x.alias(f"x{k}") for k, x in enumerate([on_top, *salted])))
        pivots = written(chosen.select("region", F.array_distinct(F.array(*(F.col(f"x{k}.cls") for k in range(PIVOTS)))).alias("pivots")), "pivots")
        pairs = regions.join(pivots, "region").select(F.explode("pivots").alias("pivot"), "cls").filter("cls <> pivot").distinct()
        distances = work.measured(pairs, sets)
        stars = written(stars.unionByName(_close(distances)), "links")
        cells = _open_cells(regions, pivots, distances, level, stars)
        stuck = cells.filter(2 * F.col("n") > F.col("of"))
        members = members.unionByName(_blocks(stuck.filter(F.col("n") > REGION)))
        regions = cells.filter((2 * F.col("n") <= F.col("of")) | (F.col("n") <= REGION))


def _open_cells(regions, pivots, distances, level, stars) -> DataFrame:
    """The cells that still hold several components, with the size of the region that they came from."""
    cells = written(_cells(regions, pivots, distances, level), "cells")
    of = cells.groupBy("region").agg(F.max("of").alias("of"))
    return written(_open(cells.drop("of"), stars).join(written(of, "of"), "region"), "cells")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest doc_id reachable over links, the row's own
    included. A text without words (null, empty or blanks) has no shingles and
    is linked with nothing, not even with another such text; fewer than five
    words are one shingle. Texts of the same words are linked, repeated rows
    too. A null id keeps its row and never names a component unless all its
    ids are null; two rows with one id and different texts are two points. An
    empty table gives no rows; other columns are not read.
    """
    marked = written(points(docs, id_col, text_col), "points")
    least = written(marked.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first")), "firsts")
    rooted = components(links(docs, text_col))
    named = written(least.join(rooted, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root")), "named")
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    members = written(named.join(smallest, "root").select("cls", "component"), "members")
    lone = marked.filter("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return marked.filter("cls is not null").join(members, "cls").select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(lone)
