"""Near-duplicate detection by bottom-k sketches from one hash function.

Each document's set of distinct word shingles is hashed once.  Documents of the
same text form a class; all else is done per class.

* Candidates: inverted lists of retained values.  Values are retained in one
  order for all documents, rarer shingles first and by hash within a level, so a
  passage in many documents does not fill the lists.  Two sets whose similarity
  is at least `least` share a value among the first n - ceil(least * n) + 1 of
  each (surely), and among the first k of each with a chance of missing one of
  at most 1e-9; k follows from the set's levels.
* First every class is compared with the most central class of each of its lists,
  which joins large groups of copies without their pairs.  Edits make shingles
  rare, so the class of the commonest shingles counts as most central; class
  numbers ascend in that order.  While lists that still hold several components
  would give over `crowded` pairs a row, other classes are tried as centres, until
  a round gives under the share `worth` of the most links (or `rounds` are over).
  Then what lists still hold several components give all pairs across components,
  so rounds only save work.
* Pairs are filtered at their shared value by set sizes, by what can still be
  shared from there on, and by one bit of the least hash in each of 64 bins; then
  by the union sketch: of the `sketch` least
  plain hashes of both sets together, the number found in both estimates the
  similarity; the bound keeps a true pair but for a chance below 1e-9.
* Exact similarity on the full sets of words confirms each link, and components
  of links are found by label propagation.

Defined cases: null or word-less text has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the set; repeated
rows are one class; null ids are smallest of nothing (a component's id is its
least non-null id); an empty table gives no row; other columns, whatever their
names, are ignored (link) or passed through (one_of_each).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, chunks, doc_view, last_written, space_words, unused, written
from .components import connected
from .hashing import mix, word_hashes

#: Shingles that a task counts at a time.
COUNTED = 500_000
#: Spokes that are compared with one centre in one group of rows.
SPOKES = 256
#: Bits of a class's number below those of its place in the order of centrality.
NUMBER_BITS = 54
#: ln of the chance that a true pair is missed.
MISS = math.log(1e-9)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, starts = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s = mix(s + h[j : j + n] + np.uint64(j))
    out = []
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(s[a : z - words + 1]))
        elif z > a:
            one = np.zeros(1, np.uint64)
            for j in range(a, z):
                one = mix(one + h[j : j + 1] + np.uint64(j - a + 1000))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def levels_of(hashes: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The level of each hash, 0 for one that is not frequent."""
    if not len(frequent) or not len(hashes):
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[place] == hashes, level[place], 0)


def retained(hashes: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """The values of a set (sorted by hash) that go into the inverted lists, rarer levels (`own`) first and then by hash."""
    n = len(hashes)
    exact = n - math.ceil(least * n - 1e-9) + 1
    order = np.argsort(own, kind="stable")
    # At most (1 / least - 1) * n values of a linked union are not shared.  If none of the rarer levels is, the rest of
    # those values lie among the others, in random order within a level.
    k, before, spare = exact, 0, (1 / least - 1) * n
    for size in np.bincount(own)[: 64 if n else 0].tolist():
        if size and before < exact:
            share = max(spare - before, 1e-9) / size
            if share < 0.9 and (more := math.ceil(MISS / math.log(share))) <= size:
                k = min(k, before + more)
        before += size
    return hashes[order][:k]


def bins(hashes: np.ndarray) -> int:
    """A bit for each of 64 bins of the plain hash: that of the least value in it, 0 where empty."""
    if not len(hashes):
        return 0
    h = np.sort(mix(hashes))
    top, first = np.unique(h >> np.uint64(58), return_index=True)
    bits = (h[first] >> np.uint64(3)) & np.uint64(1)
    return int(np.bitwise_or.reduce(bits << top).view(np.int64))


#: Differing bits that a pair of similarity 0.8 exceeds with a chance below 1e-9 (each differs with at most half the chance of a foreign least value).
def most_differing(least: float) -> int:
    p, total, k = (1 - least) / 2, 0.0, 65
    while k and total < 1e-9:
        k -= 1
        total += math.comb(64, k) * p**k * (1 - p) ** (64 - k)
    return k


def frequent_shingles(view: DataFrame, words: int, local: int, total: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and levels of shingles in at least `total` documents, as counted where a task has `local` of them; any set gives right results."""

    def run(batches):
        kept, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for c in chunks(b, "text", 1 << 20):
                k, n = np.unique(np.concatenate(shingle_sets([x or b"" for x in c.column("text").to_pylist()], words)), return_counts=True)
                both = np.concatenate((kept, k))
                kept, inverse = np.unique(both, return_inverse=True)
                count = np.bincount(inverse, np.concatenate((count, n)), len(kept)).astype(np.int64)
                least_kept = 2
                while len(kept) > COUNTED:  # bounded memory: the rarest are let go
                    many = count >= least_kept
                    kept, count = kept[many], count[many]
                    least_kept += 1
        many = count >= local
        yield pa.RecordBatch.from_arrays([pa.array(kept[many].view(np.int64)), pa.array(count[many])], ["h", "n"])

    found = view.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= total)
    # the most frequent `limit` of them: 16 bytes each
    table = found.orderBy(F.desc("n"), "h").limit(limit).toArrow()
    hashes = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    levels = 1 + np.floor(2 * np.log2(np.maximum(table.column("n").to_numpy(), 1))).astype(np.int64)
    return hashes[order], np.minimum(levels[order], 63)


def sketched(view: DataFrame, words: int, least: float, sketch: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, own, n, place (0 for the most central), keys, sketch, bins of every row."""
    shared = view.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", 1 << 20):
                sets = shingle_sets([x or b"" for x in b.column("text").to_pylist()], words)
                levels = [levels_of(s, *shared.value) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        b.column("own"),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([255 - min(255, int(8 * v.mean())) if len(v) else 255 for v in levels], pa.int32()),
                        pa.array([retained(s, v, least).view(np.int64) for s, v in zip(sets, levels, strict=True)], pa.list_(pa.int64())),
                        pa.array([np.sort(mix(s))[:sketch].view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([bins(s) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "own", "n", "place", "keys", "sketch", "bins"],
                )

    kind = view.schema["doc_id"].dataType.simpleString()
    return view.select("doc_id", "own", "text").mapInArrow(run, f"doc_id {kind}, own binary, n int, place int, keys array<bigint>, sketch array<bigint>, bins bigint")


def shingles(text: bytes, words: int) -> set:
    w = space_words(text)
    return set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else {tuple(w)}


def confirmed(pairs: DataFrame, n_pairs: int, view: DataFrame, named: DataFrame, n_named: int, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least `least`; named: (cls, own, rep) of the classes they stand for, and perhaps more.

    A centre `a` of many pairs is dealt in groups of about `SPOKES`, each a stream of a's text and then those of its b.
    """
    need = beside(named.select("cls", F.col("own").alias("its"), F.col("rep").alias("id")), n_named)
    texts = written(view.join(need, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("its"))).select("cls", "text"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("parts"))
    spokes = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    of_spokes = texts.join(beside(spokes, n_pairs), F.col("cls") == F.col("b")).select("a", "part", "b", "text")
    of_centres = texts.join(beside(centres, n_pairs), F.col("cls") == F.col("a")).select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")

    def check(batches):
        key, x, last = None, set(), None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for some in chunks(batch, "text", 1 << 20):
                for a, part, b, text in zip(*(some.column(c).to_pylist() for c in ("a", "part", "b", "text")), strict=True):
                    if b is None:
                        if key != (a, part):  # a repeated row has its text again
                            key, x, last = (a, part), shingles(text, words), None
                    elif b != last:
                        last, y = b, shingles(text, words)
                        both = len(x & y)
                        if both >= least * (len(x) + len(y) - both) - 1e-9:
                            found[0].append(a)
                            found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    rows = of_spokes.unionByName(of_centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(check, "a bigint, b bigint")


def plausible(pairs: DataFrame, sketches: DataFrame, least: float, sketch: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule a link out; sketches: (cls, sketch) of their classes."""
    few = 0
    chance = (1 - least) ** sketch
    while chance < 1e-9:
        few += 1
        chance += math.comb(sketch, few) * least**few * (1 - least) ** (sketch - few)
    side = lambda c: sketches.select(F.col("cls").alias(c), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    # smaller unions are whole, and then the count is exact
    bound = F.when(F.size(F.array_union("sa", "sb")) < sketch, F.ceil(F.lit(least) * F.size(union) - 1e-9)).otherwise(F.lit(few))
    return both.where(shared >= bound).select("a", "b")


class Links:
    """Confirmed links, their components and the pairs examined so far."""

    def __init__(self, view: DataFrame, classes: DataFrame, words: int, least: float, sketch: int):
        self.view, self.classes, self.words, self.least, self.sketch = view, classes, words, least, sketch
        self.links = self.examined = view.sparkSession.createDataFrame([], "a bigint, b bigint")
        self.roots = view.sparkSession.createDataFrame([], "node bigint, root bigint")
        self.n_roots = self.n_examined = 0

    def add(self, pairs: DataFrame) -> int:
        """The number of new links among pairs (a, b)."""
        pairs = written(pairs.join(beside(self.examined, self.n_examined), ["a", "b"], "left_anti") if self.n_examined else pairs)
        ids = written(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
        if not (n_ids := ids.count()):
            return 0
        inside = self.classes.join(beside(ids, n_ids), "cls", "left_semi")
        likely = written(plausible(pairs, inside.select("cls", "sketch"), self.least, self.sketch))
        if not (n_likely := likely.count()):
            return 0
        self.examined = likely if not self.n_examined else self.examined.unionByName(likely)
        self.n_examined += n_likely
        found = written(confirmed(likely, n_likely, self.view, inside.select("cls", "own", "rep"), n_ids, self.words, self.least))
        if new := found.count():
            self.links = self.links.unionByName(found) if self.n_roots else found
            self.roots = connected(self.links)
            self.n_roots = self.roots.count()
        return new

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows of classes with their components."""
        if not self.n_roots:
            return rows.withColumn("root", F.col("cls"))
        roots = beside(self.roots.withColumnRenamed("node", "cls"), self.n_roots)
        return rows.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def link(docs: DataFrame, *, words: int = 5, least: float = 0.8, sketch: int = 32, id_col: str = "doc_id", text_col: str = "text", frequent_local: int = 8, frequent_total: int = 48, frequent_limit: int = 2_000_000, rounds: int = 4, worth: float = 0.05, crowded: float = 64.0) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id of its component) of every document."""

    def make() -> DataFrame:
        view = text_view(docs, id_col, text_col)
        own = components(view, words, least, sketch, frequent_local, frequent_total, frequent_limit, rounds, worth, crowded)
        rows = view.select("doc_id", "own").join(own.select("own", "n", "component_id"), "own")
        return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

    return last_written(docs.sparkSession, make)


def text_view(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text as bytes (empty for null), and own, the text's digest."""
    view = doc_view(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(b"")))
    return view.withColumn("own", F.unhex(F.md5("text")))


def components(view: DataFrame, words: int = 5, least: float = 0.8, sketch: int = 32, frequent_local: int = 8, frequent_total: int = 48, frequent_limit: int = 2_000_000, rounds: int = 4, worth: float = 0.05, crowded: float = 64.0) -> DataFrame:
    """own, n, root, component_id of every distinct text of a text_view()."""
    frequent = frequent_shingles(view, words, frequent_local, frequent_total, frequent_limit)
    each = sketched(view, words, least, sketch, frequent)
    whole = each.groupBy("own").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "place", "keys", "sketch", "bins")])
    number = F.shiftleft(F.col("place").cast("bigint"), NUMBER_BITS) + F.monotonically_increasing_id()
    classes = written(whole.select("own", "rep", "n", number.alias("cls"), "keys", "sketch", "bins"))
    most = most_differing(least)

    def close(x: str, y: str) -> Column:
        """What a linked pair meets at its first common value: sizes, what can still be shared from there on, and bins."""
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        room = F.least(n - F.col(f"{x}at"), m - F.col(f"{y}at"))
        return (n >= m * least - 1e-9) & (m >= n * least - 1e-9) & (room >= (n + m) * (least / (1 + least)) - 1e-9) & (F.bit_count(F.col(f"{x}bins").bitwiseXOR(F.col(f"{y}bins"))) <= most)

    facts = ("cls", "n", "at", "bins")
    links = Links(view, classes, words, least, sketch)
    # every class against the most central class of each of its lists
    lists = classes.select(F.posexplode("keys").alias("at", "v"), "cls", "n", "bins")
    hubs = lists.groupBy("v").agg(F.count("*").alias("held"), F.min(F.struct(*facts)).alias("hub")).where("held > 1")
    rows = written(lists.join(hubs.select("v", "hub"), "v"))
    new = most_new = links.add(rows.where((F.col("hub.cls") < F.col("cls")) & close("hub.", "")).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct())
    for k in range(1, rounds + 1):
        now = links.named(rows.select("v", *facts))
        several = now.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held")).where("lo <> hi")
        rows = written(now.join(several.select("v", "held"), "v"))
        size = rows.agg(F.count("*").alias("rows"), (F.sum("held") / 2).alias("pairs")).first()
        if k == rounds or new <= worth * most_new or (size["pairs"] or 0) <= crowded * size["rows"]:
            break
        # against other classes, by another order each time
        hubs = rows.groupBy("v").agg(F.min_by(F.struct(*facts, "root"), F.xxhash64("cls", F.lit(k))).alias("hub"))
        spokes = rows.join(hubs, "v").where((F.col("hub.root") != F.col("root")) & close("hub.", ""))
        new = links.add(spokes.select(F.least("hub.cls", "cls").alias("a"), F.greatest("hub.cls", "cls").alias("b")).distinct())
        most_new = max(most_new, new)
    # what is left: lists that hold several components, across components
    side = lambda c: rows.select("v", F.struct(*facts, "root").alias(c))
    across = side("x").join(side("y"), "v").where((F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & close("x.", "y."))
    links.add(across.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())

    ids = classes.select("own", "n", "cls", "rep")
    # a component of several classes has a row for each in roots; of any other its own id is the least
    several = written(links.roots.withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls"))
    least_id = several.groupBy("root").agg(F.min("rep").alias("component_id"))
    return links.named(ids).join(least_id, "root", "left").select("own", "n", "root", F.when(F.col("component_id").isNull() & F.col("rep").isNotNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, exactly one row of each component whatever its ids; rows without words stay.

    It is that of the least id (null last), then of the least digest of the text; of rows alike in both any one.
    """
    own, key, stays = unused(docs, "own", "key", "stays")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))

    def make() -> DataFrame:
        view = text_view(docs, id_col, text_col)
        names = components(view, words, least).where("n > 0").select("own", "root")
        rows = written(view.groupBy("own", "doc_id").agg(F.count("*").alias("many")).join(names, "own"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("w")
        crowd = rows.groupBy("root").agg(first, F.sum("many").alias("all")).where(F.col("all") > 1).select("root", "w")
        marked = rows.join(crowd, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("own") == F.col("w.own")))
        return marked.where("NOT stays OR many > 1").select("doc_id", "own", "stays")

    apart = last_written(docs.sparkSession, make).select(F.col("doc_id").alias(key), F.col("own").alias(own), F.col("stays").alias(stays))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (digest == F.col(own))
    n = apart.count()
    once = docs.join(beside(apart, n), same, "left_anti")
    # rows alike in id and text: one of them
    again = docs.join(beside(apart.where(F.col(stays)), n), same).dropDuplicates([own, key]).select(*docs.columns)
    return once.unionByName(again)
