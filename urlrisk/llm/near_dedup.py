"""Near-duplicate classes: ProbMinHash sketches, banding, exact verification.

A text is a weighted set: its shingles of five words with their counts.  Words
are runs of letters and digits of the lower-cased text.  The similarity of two
texts is the probability Jaccard similarity of these sets (for shingles that
don't repeat it is the plain Jaccard similarity); at 0.8 or more they are linked.
A class is what links and equal texts connect; its id is its smallest doc_id.

* **Sketch.**  Every shingle is a Poisson process whose rate is its weight; each
  arrival falls on one register, and a register keeps the shingle that arrived
  first.  A shingle is dropped as soon as its next arrival is later than the
  latest first arrival of all registers.  Two registers agree with a
  probability that is the similarity.
* **Bands.**  Six registers make a bucket key; 28 bands miss a pair of
  similarity 0.8 with probability 0.0002.
* **Pairs.**  Equal texts are one node.  Every node is first compared with one
  other node: of the hubs of its buckets (their members that meet most nodes) the
  greatest one.  A bucket of n copies costs n pairs.  Afterwards only buckets that
  still hold several classes are open.  Their members outside the largest class
  meet the members of other classes in blocks of at most about 128; whole
  sketches are compared, each pair in its first common bucket, and what agrees in
  0.72 of the registers (3.5 standard deviations below 0.8) is a pair.  The best
  pair of each node is verified first; with the classes that follow, all pairs
  that still lie between classes are.
* **Verification** computes the similarity from the whole texts.

Defined cases: texts of one to four words have one shingle, all their words.  An
empty text is linked with equal texts only.  A row whose doc_id or text is null
takes no part: its class is its own doc_id.  Rows that repeat a doc_id with another
text have the class of their text; each class keeps a row of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, mix64, stored
from .words import STEP, Hasher

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 28, 6
REGISTERS = 2 * BANDS * ROWS  # of a sketch; the first half makes the buckets, all of them the estimate
BLOCK = 128  # members of a bucket that meet at a time


def sketches(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The first shingle of every register, one line per set; all sets at once."""
    sizes = np.array([len(s[0]) for s in sets])
    first = np.full((len(sets), registers), np.inf)
    who = np.zeros((len(sets), registers), np.uint64)
    if not sizes.sum():
        return who
    item = np.concatenate([s[0] for s in sets])
    rate = np.concatenate([s[1] for s in sets]).astype(np.float64)
    line = np.repeat(np.arange(len(sets)), sizes)
    at, flat, flat_who = np.zeros(len(item)), first.reshape(-1), who.reshape(-1)
    latest = np.full(len(sets), np.inf)
    turn = 0
    while len(item):
        turn += 1
        random = mix64(item + np.uint64(turn * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        early = at < latest[line]
        if not early.all():
            item, rate, line, at, random = item[early], rate[early], line[early], at[early], random[early]
        place = line * registers + ((mix64(random) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, place, at)
        won = flat[place] == at
        flat_who[place[won]] = item[won]
        alive = np.unique(line)
        latest[alive] = first[alive].max(axis=1)
    return who


def band_keys(who: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.repeat(mix64(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(who), axis=0)
    for r in range(rows):
        key = mix64(key ^ who[:, r::rows][:, :bands]) + STEP
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    # Keys of a smaller or equal ratio y/x than key i count with x, the others with y.
    left, right = np.cumsum(x), y.sum() - np.cumsum(y)
    both = (x > 0) & (y > 0)
    ratio = np.divide(y, x, out=np.zeros_like(x), where=both)
    last = np.searchsorted(np.where(x > 0, np.divide(y, x, out=np.full_like(x, np.inf), where=x > 0), np.inf), ratio[both], side="right") - 1
    return float((1.0 / (left[last] / x[both] + right[last] / y[both])).sum())


def _sketch_batch(bands: int, rows: int, registers: int):
    hasher = []

    def run(ids, texts):
        if not hasher:
            hasher.append(Hasher())
        sets = [hasher[0].shingles(t, WORDS) for t in texts]
        who = sketches(sets, registers)
        keys, marks = band_keys(who, bands, rows), mix64(who).astype(np.uint8)
        return {"doc_id": pa.array(ids, pa.int64()), "bands": [k if len(s[0]) else [] for k, s in zip(keys, sets)], "marks": [m.tobytes() for m in marks]}
    return run


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``bands`` (bucket keys), ``marks`` (a byte per register), of all rows with both columns; one narrow pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("bands", pa.list_(pa.int64())), ("marks", pa.binary())])
    make = _sketch_batch(bands, rows, max(registers, bands * rows))
    run = batches(["doc_id", "text", "digest"], schema, lambda ids, texts, digests: {**make(ids, texts), "digest": digests})
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
            .withColumn("digest", F.md5("text")).mapInArrow(run, "doc_id long, digest string, bands array<long>, marks binary"))


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    hasher = []

    def run(a, b, left, right):
        if not hasher:
            hasher.append(Hasher())
        known: dict[int, tuple] = {}  # of this batch: a leader's text stands in many pairs

        def of(node, text):
            if node not in known:
                known[node] = hasher[0].shingles(text, WORDS)
            return known[node]

        good = [probability_jaccard(of(i, s), of(j, t)) >= similar - 1e-9 for i, j, s, t in zip(a, b, left, right)]
        return {"a": [i for i, g in zip(a, good) if g], "b": [j for j, g in zip(b, good) if g]}

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b"))
    return both.select("a", "b", "left", "right").mapInArrow(batches(["a", "b", "left", "right"], schema, run, 500), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node it is connected with) of all nodes of the links (a, b).

    Every node points to its smallest neighbour; pointers are doubled until they
    rest; then links are drawn between what they point to, and so on.  All tables
    are written, never collected.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                       .select("node", F.least("node", "label").alias("label")), "pointers")
        while True:
            far = point.select(F.col("node").alias("label"), F.col("label").alias("far"))
            point = stored(point.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "pointers")
            moved = not point.where("moved").isEmpty()
            point = point.drop("moved")
            if not moved:
                break
        labels = point if labels is None else stored(relabelled(labels, point), "labels")
        ends = links
        for name in ("a", "b"):
            ends = ends.join(point.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label")), name)
        links = stored(ends.where("a_label <> b_label").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def relabelled(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels after one more step from label to label; labels the step doesn't know stay."""
    step = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """For every node the greatest hub of its buckets: pairs (a, b) with a the hub; hubs of all their buckets have none."""
    met = stored(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    ranked = members.select("bucket", "node").join(met, "node").select("bucket", F.struct("met", (-F.col("node")).alias("minus")).alias("self"))
    hubs = ranked.groupBy("bucket").agg(F.max("self").alias("hub"))
    best = ranked.join(hubs, "bucket").where("hub > self").groupBy("self").agg(F.max("hub").alias("hub"))
    return best.select((-F.col("hub.minus")).alias("a"), (-F.col("self.minus")).alias("b"))


def _between_classes(members: DataFrame, labels: DataFrame, nodes: DataFrame, least: float, best: bool) -> DataFrame:
    """Pairs (a, b) of open buckets between classes, with the share of equal registers, each pair once.

    With ``best`` every outsider gets its best partner of each block only.
    Buckets are cut into blocks by a hash, so that no task holds a whole bucket.
    """
    open_ = members.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = open_.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = (sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("k"))
            .where("k > 1").select("bucket", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("outside")))
    rows = (open_.join(main, "bucket").join(nodes.select("node", "bands", "marks"), "node")
            .withColumn("out", F.col("label") != F.col("main"))
            .select("bucket", "out", "all", "outside", F.struct("node", "label", "out", "bands", "marks").alias("item")))
    rows = stored(rows, "open")

    def blocked(part: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("item.node"), F.ceil(F.col(size) / BLOCK))
        return part.groupBy("bucket", block.alias("block")).agg(F.collect_list("item").alias(name)).drop("block")

    def unpacked(items: list[dict]) -> tuple[np.ndarray, ...]:
        return (np.array([i["node"] for i in items]), np.array([i["label"] for i in items]), np.array([i["out"] for i in items]),
                np.array([i["bands"] for i in items], np.int64), np.frombuffer(b"".join(i["marks"] for i in items), np.uint8).reshape(len(items), -1))

    def meet(bucket, left, right):
        out_a, out_b, out_s = [], [], []
        for key, outsiders, all_ in zip(bucket, left, right):
            x, x_label, _, x_bands, x_marks = unpacked(outsiders)
            y, y_label, y_out, y_bands, y_marks = unpacked(all_)
            for i in range(len(x)):
                wanted = np.flatnonzero((y_label != x_label[i]) & (~y_out | (y > x[i])))
                equal = y_bands[wanted] == x_bands[i]
                first = y_bands[wanted, equal.argmax(axis=1)] == key  # of the buckets that both are in
                wanted = wanted[first]
                share = (y_marks[wanted] == x_marks[i]).mean(axis=1)
                good = np.flatnonzero(share >= least)
                if best and len(good):
                    good = good[[share[good].argmax()]]
                out_a.append(np.minimum(y[wanted[good]], x[i]))
                out_b.append(np.maximum(y[wanted[good]], x[i]))
                out_s.append(share[good])
        none = np.empty(0)
        return {"a": np.concatenate([*out_a, none]).astype(np.int64), "b": np.concatenate([*out_b, none]).astype(np.int64), "share": np.concatenate([*out_s, none])}

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64())])
    both = blocked(rows.where("out"), "outside", "left").join(blocked(rows, "all", "right"), "bucket")
    return both.mapInArrow(batches(["bucket", "left", "right"], schema, meet, 200), "a long, b long, share double")


def _extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links (a, b) of nodes are added."""
    for name in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label")), name, "left")
    step = components(links.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    fresh = step.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti")
    return stored(relabelled(labels.unionByName(fresh), step), "labels")


def _named(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows of ``docs``, and ``digest``, ``first_id`` and ``label`` (of its class) of every text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    registers = max(registers, bands * rows)
    sketch = stored(sketched(docs, bands, rows, registers), "sketches")
    # Equal texts become one node; the numbers are final once the table is written.
    nodes = stored(sketch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
                   .select(F.monotonically_increasing_id().alias("node"), "digest", "first_id", "bands", "marks"), "nodes")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(placed.join(shared, "bucket"), "members")

    # Only texts that share a bucket with another one are moved, once.
    texts = stored(members.select("node").distinct().join(nodes.select("node", "digest", F.col("first_id").alias("doc_id")), "node")
                   .join(docs, "doc_id").where(F.md5("text") == F.col("digest")).groupBy("node").agg(F.first("text").alias("text")), "texts")

    labels = components(_verified(_hub_pairs(members), texts, similar))
    least = similar - 3.5 * (similar * (1 - similar) / registers) ** 0.5
    pairs = stored(_between_classes(members, labels, nodes, least, best=True), "pairs")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    first = ends.groupBy("a").agg(F.max(F.struct("share", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    labels = _extended(labels, stored(_verified(first, texts, similar), "verified"))
    rest = _between_classes(members, labels, nodes, least, best=False).select("a", "b")
    labels = _extended(labels, stored(_verified(stored(rest, "pairs"), texts, similar), "verified"))

    return sketch, nodes.select("node", "digest", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row of ``docs`` (columns doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch, named = _named(docs, **settings)
    ids = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    by_digest = named.join(ids, "label").select("digest", "class_id")
    taking_part = sketch.select("doc_id", "digest").join(by_digest, "digest").select("doc_id", "class_id")
    rest = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return taking_part.unionByName(rest)


def kept(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one with the smallest doc_id, of several texts with that doc_id the smallest digest.

    Rows without doc_id or text all stay.
    """
    named = _named(docs, **settings)[1]
    found = named.groupBy("label").agg(F.min(F.struct("first_id", "digest")).alias("k")).select(F.col("k.first_id").alias("kept_id"), F.col("k.digest").alias("kept_digest"))
    part = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").join(found, (F.col("doc_id").cast("long") == F.col("kept_id")) & (F.md5("text") == F.col("kept_digest")))
    return part.dropDuplicates(["kept_id", "kept_digest"]).drop("kept_id", "kept_digest").unionByName(docs.where("doc_id IS NULL OR text IS NULL"))
