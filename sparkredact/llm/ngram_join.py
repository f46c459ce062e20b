"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact, by T-occurrence search, and without all pairs of a group of copies:

1. Each text becomes a sorted set of 64-bit shingle hashes; rows with the same set are one class.
2. Prefix filter: linked sets share a fifth of their lowest two fifths of hashes, see ``need``. These
   prefixes meet by hash, and classes without so many shared hashes drop out. A task first merges the
   hashes that it holds twice itself, so the hash of a passage in very many documents travels once a task.
3. What stays is counted again, among itself, and put in order from rare to frequent. Linked sets share one
   of the first ``size - need + 1`` of these: such a hash leads a class to the cells it has to search.
   A cell holds classes of one length band with the same lowest hash, so near copies lie in few cells.
   A class searches its own band and the next only, for classes of its size or larger.
4. Cells are cut to blocks by size, and the classes that search a block to portions. A task builds the
   inverted lists of a block over whole sets, and each class is searched for by DivideSkip: a heap merges
   the short lists, the long ones are probed, and those reaching the overlap are links. All links come from
   here. A block sums up the links of each class, and sends on those that connect what it holds only.
5. Components of these, brought back to every row by its class.

A row's number of links counts copies too. Pairs come out as links between class representatives that
connect all components (``links``), with the membership in ``near_duplicates``. Hashes and the numbers of
classes have 64 bits: two shingles of one comparison, or two sets, that differ but share one would be taken
as equal.

Defined cases: null text and texts without words have an empty set and link with nothing; every row is a
document of its own, also with a repeated or a null id, and a component's id is the smallest id in it, null
if there is none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ROW_BYTES, give_back, materialize, slices, small, table
from .divide_skip import divide_skip_arrays as divide_skip
from .graph import components
from .shingles import class_number, shingle_set

#: Shingles and classes whose prefixes a task merges at once, and rows that it sends on at once.
LOCAL_SHINGLES, LOCAL_CLASSES, SENT_ROWS = 500_000, 40_000, 50_000
#: Ratio of a length band; above 1.25, the greatest ratio of linked sizes, so that these differ by one band at most.
BAND = 1.26
#: Shingles and classes of a block, and those of a portion that searches it.
BLOCK_SHINGLES, BLOCK_CLASSES = 300_000, 512
PORTION_SHINGLES, PORTION_CLASSES = 100_000, 128
CELL = ["home", "band"]
FOUND = "a long, b long, n_links long"
VISIT = "struct<home:long,band:int,block:int,portion:int,asks:boolean>"
#: Bytes of a visit in a broadcast, beside those of its class.
VISIT_BYTES = 64


def linked(inter, n_x, n_y):
    """100 * intersection >= 80 * union."""
    return 9 * inter >= 4 * (n_x + n_y)


def prefix_size(n):
    """Two fifths of a set, rounded up."""
    return (2 * n + 4) // 5


def need(n: Column) -> Column:
    """Hashes of the prefix of a set of ``n`` that the prefix of any linked set has too: a fifth, rounded up.

    Linked sets of n and m share 4/9 (n + m) or more. Of the hashes below which both prefixes lie, at most
    3/5 max(n, m) are above, so 4/9 (n + m) - 3/5 max(n, m) are shared below; m is between 4/5 n and 5/4 n.
    """
    return F.ceil(n / 5).cast("int")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def shingle_meta(rows: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n, class)`` of every row: set size and the number of its class, null without words."""

    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches):
            out = [(len(s), class_number(s) if len(s) else None) for s in (shingle_set(t.as_py()) for t in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in out], type=pa.int64()) for k in range(2))], names=["doc_id", "text_hash", "n", "class"])

    return rows.mapInArrow(meta, "doc_id long, text_hash long, n long, class long")


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.nonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))[0] if len(sorted_) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_)))


def _merged(classes: dict[int, tuple[int, np.ndarray]], own: int) -> Iterator[pa.RecordBatch]:
    """Rows (tok, class, n, own) of the prefixes of some classes.

    A hash of one class is to meet its like (``own`` 0). One of several classes is known to be shared: it
    goes to the others as a row without class, and its classes have rows of their own that needn't meet.
    """
    sizes = np.array([len(p) for _, p in classes.values()])
    toks, at = np.concatenate([p for _, p in classes.values()]).view(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(toks, kind="stable")
    toks, at = toks[order], at[order]
    starts, lens = _runs(toks)
    several = np.repeat(lens > 1, lens)
    marks = toks[starts[lens > 1]]
    back = np.argsort(order[~several])  # class by class, as alike rows in a row take less when they travel
    single, whose_single = toks[~several][back], at[~several][back]
    number, n = np.array(list(classes), np.int64), np.array([n for n, _ in classes.values()], np.int64)
    for t, c, o in [(single, whose_single, 0), (marks, None, 0), (toks[several], at[several], own)]:
        for k in range(0, len(t), SENT_ROWS):
            part, some = t[k : k + SENT_ROWS], None if c is None else c[k : k + SENT_ROWS]
            whose = pa.nulls(len(part), pa.int64()) if some is None else pa.array(number[some])
            size = np.zeros(len(part), np.int64) if some is None else n[some]
            yield pa.RecordBatch.from_arrays([pa.array(part), whose, pa.array(size), pa.array(np.full(len(part), o))], names=["tok", "class", "n", "own"])


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """``(class, n, toks)``: classes of ``rows`` with ``need(n)`` hashes of their prefix in those of others, and these hashes.

    What a task merges depends on the order of its rows, so they must come from files or sorted; then a
    task that is run again sends the same.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, shingles, turn = {}, 0, 0
        first = (TaskContext.get().partitionId() << 32) + 1
        for b in slices(batches):
            for text in b.column(0):
                s = shingle_set(text.as_py())
                if len(s) and (number := class_number(s)) not in held:
                    held[number] = len(s), s[: prefix_size(len(s))].copy()
                    shingles += len(held[number][1])
                if shingles >= LOCAL_SHINGLES or len(held) >= LOCAL_CLASSES:
                    yield from _merged(held, first + turn)
                    held, shingles, turn = {}, 0, turn + 1
        if held:
            yield from _merged(held, first + turn)

    dealt = rows.select("text").mapInArrow(deal, "tok long, class long, n long, own long")
    like = W.partitionBy("tok", "own")
    met = dealt.select("*", F.min("class").over(like).alias("lo"), F.max("class").over(like).alias("hi"), F.count("class").over(like).alias("known"), F.count("*").over(like).alias("rows"))
    shared = met.filter(F.col("class").isNotNull() & ((F.col("own") > 0) | (F.col("lo") < F.col("hi")) | (F.col("known") < F.col("rows"))))
    return shared.groupBy("class", "n").agg(F.collect_set("tok").alias("toks")).filter(F.size("toks") >= need(F.col("n")))


def search_plan(prefixes: DataFrame) -> DataFrame:
    """``(class, n, home, band, lead)``: each class's cell, and the hashes that lead to and from it, from ``shared_prefixes``."""
    rows = prefixes.select("class", "n", F.explode("toks").alias("tok"))
    often = rows.groupBy("tok").agg(F.count("*").alias("often")).filter("often > 1")
    ranked = rows.join(often, "tok").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("often", "tok"))).alias("toks"))
    known = ranked.filter(F.size("toks") >= need(F.col("n")))
    lead = F.transform(F.slice("toks", F.lit(1), F.size("toks") - need(F.col("n")) + 1), lambda t: t["tok"])
    home = F.array_min(F.transform("toks", lambda t: t["tok"]))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    return known.select("class", "n", home.alias("home"), band.alias("band"), lead.alias("lead"))


def routes(plan: DataFrame) -> DataFrame:
    """``(class, n, home, band)``: the cells that each class has to search."""
    lead = plan.select("class", "n", "home", "band", F.explode("lead").alias("tok"))
    cells = lead.groupBy("tok", "band", "home").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    asks = lead.select("class", "n", "tok", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    found = asks.join(cells, ["tok", "band"]).filter((F.col("most") >= F.col("n")) & (4 * F.col("least") <= 5 * F.col("n")) & ((F.col("lo") != F.col("class")) | (F.col("hi") != F.col("class"))))
    return found.select("class", "n", "home", "band").distinct()


def visits(plan: DataFrame, asked: DataFrame) -> DataFrame:
    """``(class, home, band, block, portion, asks)``: what each task of the search holds (asks False) and searches it for (True)."""
    parts = lambda shingles, classes: F.ceil(F.greatest(F.sum("n") / shingles, F.count("*") / classes)).cast("int")
    held = plan.groupBy(CELL).agg(parts(BLOCK_SHINGLES, BLOCK_CLASSES).alias("blocks"))
    cells = held.join(asked.groupBy(CELL).agg(parts(PORTION_SHINGLES, PORTION_CLASSES).alias("portions")), CELL)
    cells = small(materialize(cells, "cells"))
    own = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    holds = plan.join(cells, CELL).select("class", *CELL, own(F.col("blocks")).alias("block"), every("portions").alias("portion"), F.lit(False).alias("asks"))
    asks = asked.join(cells, CELL).select("class", *CELL, every("blocks").alias("block"), own(F.col("portions")).alias("portion"), F.lit(True).alias("asks"))
    return holds.union(asks)


class Block:
    """Inverted lists of some classes, in order of their size."""

    def __init__(self, classes: list[int], sizes: list[int], weights: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(classes)), key=lambda i: (sizes[i], classes[i]))
        self.classes, self.sizes = np.array(classes, np.int64)[order], np.array(sizes, np.int64)[order]
        self.weights, self.n_links = np.array(weights, np.int64)[order], np.zeros(len(order), np.int64)
        self.label = np.arange(len(order))  # of what is connected so far
        toks, places = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
        by_tok = np.argsort(toks, kind="stable")
        toks, self.places = toks[by_tok], places[by_tok]
        starts, lens = _runs(toks)
        self.toks = toks[starts]
        self.keys = np.repeat(np.arange(len(starts)), lens) * len(order) + self.places  # (list, place) in order

    def search(self, number: int, n: int, toks: np.ndarray) -> np.ndarray:
        """Places of the classes linked with a class that come after it by (size, number)."""
        lo = int(np.searchsorted(self.sizes, n))
        while lo < len(self.sizes) and self.sizes[lo] == n and self.classes[lo] <= number:
            lo += 1
        hi = int(np.searchsorted(self.sizes, 5 * n // 4, side="right"))
        if lo >= hi:
            return np.zeros(0, np.int64)
        least = -(-4 * (n + int(self.sizes[lo])) // 9)
        at = np.searchsorted(self.toks, toks)
        at = at[self.toks[np.minimum(at, len(self.toks) - 1)] == toks]
        if len(at) < least:
            return np.zeros(0, np.int64)
        starts, ends = np.searchsorted(self.keys, at * len(self.sizes) + lo), np.searchsorted(self.keys, at * len(self.sizes) + hi)
        lists = [self.places[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if a < b]
        places, inter = divide_skip(lists, least)
        return places[linked(inter, n, self.sizes[places])]

    def ask(self, number: int, n: int, weight: int, toks: np.ndarray) -> tuple[int, np.ndarray]:
        """How many rows of the block link with the class, and one class of each part that it connects."""
        places = self.search(number, n, toks)
        if not len(places):
            return 0, places
        self.n_links[places] += weight
        parts, first = np.unique(self.label[places], return_index=True)
        if len(parts) > 1:
            self.label[np.isin(self.label, parts)] = parts[0]
        return int(self.weights[places].sum()), self.classes[places[first]]


def block_links(rows: DataFrame) -> DataFrame:
    """``(a, b, n_links)`` from ``whole_sets``: links (a, b) that connect, and numbers of links of a, to be added up."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        cell, held, block = None, [], None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "n_links"])

        def sums() -> Iterator[pa.RecordBatch]:
            if block is not None and block.n_links.any():
                some = block.n_links > 0
                yield batch_of([(c, None, n) for c, n in zip(block.classes[some].tolist(), block.n_links[some].tolist(), strict=True)])

        for b in slices(batches):
            keys = list(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
            asks, number, n, weight = (b.column(k).to_pylist() for k in range(4, 8))
            lists = b.column(8)
            at, flat, out = lists.offsets.to_numpy(), lists.values.to_numpy(), []
            for i, key in enumerate(keys):
                if key != cell:
                    yield from sums()
                    cell, held, block = key, [], None
                toks = flat[at[i] : at[i + 1]]
                if not asks[i]:
                    held.append((number[i], n[i], weight[i], toks.copy()))
                elif held or block is not None:
                    if block is None:
                        block, held = Block(*map(list, zip(*held, strict=True))), []
                    links, with_ = block.ask(number[i], n[i], weight[i], toks)
                    if links:
                        out.append((number[i], None, links))
                        out += [(number[i], c, None) for c in with_.tolist()]
            if out:
                yield batch_of(out)
        yield from sums()

    key = [*CELL, "block", "portion"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visited = rows.select("class", "n", "weight", "toks", F.explode("visits").alias("v"))
    placed = visited.select(*[f"v.{k}" for k in (*key, "asks")], "class", "n", "weight", "toks").repartition(parts, *key).sortWithinPartitions(*key, "asks")
    return placed.mapInArrow(search, FOUND)


def whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(class, n, weight, toks, visits)`` of the classes of ``wanted(doc_id, text_hash, weight, visits)``; a row for each of ``rows`` that is one of these.

    The visits come along, so that sets, which are large, travel only once: to the blocks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches):
            for i, (text, weight) in enumerate(zip(b.column(0), b.column(1).to_pylist(), strict=True)):
                s = shingle_set(text.as_py())
                toks = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(np.sort(s.view(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array([class_number(s)]), pa.array([len(s)]), pa.array([weight]), toks, b.column(2).slice(i, 1)], names=["class", "n", "weight", "toks", "visits"])

    n, n_visits = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("visits")), F.lit(0))).first()
    size = n * ROW_BYTES + n_visits * VISIT_BYTES
    keys = small(wanted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "weight", "visits"), 1, size)
    own = rows.join(keys, rows["doc_id"].eqNullSafe(keys["id"]) & (F.col("text_hash") == F.col("hash")))
    return own.select("text", "weight", "visits").mapInArrow(sets, f"class long, n long, weight long, toks array<long>, visits array<{VISIT}>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, n_shingles, class_id, component_id, n_links, group)`` of every row, and ``links(a, b)`` between class ids.

    ``text_hash`` is Spark's xxhash64 of the text; ``group`` is the component's number, also for rows without an id.
    """
    rows = _rows(docs, id_col, text_col)
    meta = materialize(shingle_meta(rows), "shingle-meta")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = meta.filter("n > 0").groupBy("class").agg(first.alias("first"), F.count("*").alias("weight"))
    classes = materialize(classes.select("class", "first.doc_id", "first.text_hash", "weight"), "shingle-classes")
    plan = materialize(search_plan(materialize(shared_prefixes(rows), "shared-prefixes")), "search-plan")
    asked = materialize(routes(plan), "search-routes")
    visited = materialize(visits(plan, asked), "search-visits")
    wanted = classes.join(visited.groupBy("class").agg(F.collect_list(F.struct(*CELL, "block", "portion", "asks")).alias("visits")), "class")
    sets = whole_sets(rows, materialize(wanted, "searched-classes"))
    if not meta.filter("n > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():  # rows alike in all
        sets = sets.dropDuplicates(["class"])
    sets = materialize(sets, "shingle-sets")
    found = materialize(block_links(sets), "block-links")
    edges = found.filter("b is not null").select("a", "b")
    nodes = materialize(components(edges), "components")
    n_links = found.filter("b is null").groupBy("a").agg(F.sum("n_links").alias("near"))
    info = classes.join(nodes.withColumnRenamed("node", "class"), "class", "left").join(n_links.withColumnRenamed("a", "class"), "class", "left")
    info = info.filter("weight > 1 or component is not null").select("class", F.col("doc_id").alias("rep"), (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("group"))
    info = materialize(info, "class-info")
    names = materialize(info.groupBy("group").agg(F.min("rep").alias("name")), "component-names")
    info = materialize(info.join(small(names), "group"), "class-names")
    out = meta.join(small(info), "class", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("name").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("name", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "class").alias("group"),
    )
    ids = info.select(F.col("class"), "rep")
    links = edges.join(ids.select(F.col("class").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("class").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return out, links


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT s FROM s GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT doc_id, s FROM s WHERE s IN (SELECT s FROM d)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
q AS (SELECT a, b, x.n AS n, o, y.n AS m FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM q),
k AS (SELECT a AS v, min(b) AS class_id FROM q WHERE n = o AND m = o GROUP BY 1),
l AS (SELECT a AS v, count(*) AS n_links FROM e GROUP BY 1),
r AS (SELECT doc_id AS v, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id,
  least(w.doc_id, coalesce(k.class_id, w.doc_id)) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT v, min(root) AS c FROM r GROUP BY 1) m ON m.v = w.doc_id
LEFT JOIN k ON k.v = w.doc_id LEFT JOIN l ON l.v = w.doc_id
"""
