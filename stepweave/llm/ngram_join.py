"""N-gram Jaccard join by MinHash banding.

Documents with equal n-gram sets form one class and go on as one row. Band and
row counts follow from the target recall at the threshold; classes meet where a
band's hash is equal. A unit of verification is a set of classes whose full
n-gram sets lie in one task, where every pair that shares a band is compared. A
component of the meeting graph that a task can hold is one unit. Of a larger one
either the classes that meet in a band are a unit for each band, and a pair is
compared in the first band that it shares; or the component is: whichever sends
fewer texts, that is, the former where weak similarities chain up, the latter
where all are alike. Where a unit is still too large it is cut into blocks and
every two blocks make a unit. So groups of any size are verified whole, in
bounded memory, and no pairs are ever emitted: a unit returns link counts and,
for each class, one edge towards its root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base, _words
from ._graph import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
UNIT_CLASSES = 512
UNIT_GRAMS = 1 << 20
SEED = 77


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest false meetings, with which max_hashes values still find a pair at the threshold with the target recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def gram_sets(chunk: _words.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each, and where each text's begin; a text of fewer words is one gram."""
    words = chunk.hashes()
    at, owner = _words.windows(chunk.first, n)
    grams = _words.window_hashes(words, at, n)
    counts = np.diff(chunk.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        grams = np.r_[grams, _words.segment_hashes(words, chunk.first[short], chunk.first[short + 1])]
        owner = np.r_[owner, short]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_keys(grams: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits for each set of grams; None for an empty one."""
    total = [np.r_[np.uint64(0), np.cumsum(_words.mix(grams ^ np.uint64(k)))] for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    size = (first[1:] - first[:-1]).astype(np.uint64)
    high, low = (_words.mix((t[first[1:]] - t[first[:-1]]) ^ size) for t in total)
    both = np.stack([high, low], axis=1).astype(">u8")
    return [both[i].tobytes() if n else None for i, n in enumerate(size.tolist())]


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands; rows of empty sets mean nothing."""
    out = np.zeros((len(first) - 1, bands), np.uint64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if not len(full):
        return out
    random = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, (bands, rows, 2), np.uint64)
    begins = first[:-1][full]
    work = np.empty_like(grams)
    for b in range(bands):
        value = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            np.bitwise_xor(grams, random[b, r, 0], out=work)
            np.multiply(work, random[b, r, 1] << np.uint64(1) | np.uint64(1), out=work)
            value = _words.mix(value ^ (np.minimum.reduceat(work, begins) >> np.uint64(8)))
        out[full, b] = value
    return out


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, raw in _words.rows_in_chunks(batches):
            grams, first = gram_sets(_words.Chunk(raw), n)
            keys = set_keys(grams, first)
            hashes = band_hashes(grams, first, bands, rows).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands), pa.int32()), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(columns["doc_id"], pa.int64()), pa.array(columns["text_key"], pa.int64()), pa.array(keys, pa.binary()), pa.array(np.diff(first).astype(np.int64)), flat], names=["doc_id", "text_key", "key", "n_grams", "bands"])

    return _texts(docs).mapInArrow(sign, "doc_id long, text_key long, key binary, n_grams long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def _first() -> Column:
    """The document that stands for a class: a named one before others, then by doc_id."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_key"))).alias("first")


def _blocks(n: str, grams: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / UNIT_CLASSES), F.ceil(F.col(grams) / UNIT_GRAMS)).cast("int")


def _units(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The units that a class goes to: key and what verification needs, root, j and band (-1 and 0: the whole component), a, b and own block, whole."""
    members = classes.select("key", "first", "n_copies", "n_grams", "bands").join(roots, "key")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams")).withColumn("blocks", _blocks("n", "grams"))
    sizes = _base.checkpoint(sizes)
    large = members.join(sizes.where("blocks > 1").select("root"), "root", "left_semi") if sizes.where("blocks > 1").count() > _base.BROADCAST_ROWS else members.join(F.broadcast(sizes.where("blocks > 1").select("root")), "root", "left_semi")
    meeting = large.select("root", "n_grams", F.posexplode("bands").alias("j", "band")).groupBy("root", "j", "band").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).where("m > 1").withColumn("blocks", _blocks("m", "g"))
    meeting = _base.checkpoint(meeting)
    sent = meeting.groupBy("root").agg(F.sum(F.col("m") * F.col("blocks")).alias("sent"))
    plan = _base.checkpoint(sizes.join(sent, "root", "left").select("root", "n", "blocks", (F.col("sent") < F.col("n") * F.col("blocks")).alias("by_band")))
    planned = _base.spread_join(members, plan, ["root"], "n").drop("n")
    whole = planned.where("by_band is null or not by_band").select("*", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("band"), (F.col("blocks") == 1).alias("whole"))
    places = planned.where("by_band").drop("blocks").select("*", F.posexplode("bands").alias("j", "band"))
    banded = _base.spread_join(places, meeting.drop("g"), ["root", "j", "band"], "m").drop("m").withColumn("whole", F.lit(False))
    cut = whole.unionByName(banded).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("other")


def _shared(bands: np.ndarray, own: np.ndarray, cross: bool, first: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with an equal band, or whose first equal band is ``first``; if cross, of different blocks only."""
    k = len(bands)
    meet = np.zeros((k, k), bool)
    for j in range(bands.shape[1] if first < 0 else first):
        meet |= bands[:, j][:, None] == bands[:, j][None, :]
    if first >= 0:
        meet = ~meet & (bands[:, first][:, None] == bands[:, first][None, :])
    if cross:
        meet &= own[:, None] != own[None, :]
    return np.nonzero(np.triu(meet, 1))


def _intersections(grams: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets x[i] and y[i]."""
    k = len(first) - 1
    kinds, place, n = np.unique(grams, return_inverse=True, return_counts=True)
    size = np.diff(first)
    owner = np.repeat(np.arange(k), size)
    common = n[place] > 1
    column = np.cumsum(n > 1) - 1
    place, owner = column[place[common]], owner[common]
    width = int((n > 1).sum())
    if 2.0 * k * k * width / 2e10 < 3e-6 * len(x) + 1e-9 * float(size[x].sum() + size[y].sum()):
        total = np.zeros((k, k), np.float32)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for low in range(0, width, 4096):
            s, e = np.searchsorted(place, [low, low + 4096])
            part = np.zeros((k, min(4096, width - low)), np.float32)
            part[owner[s:e], place[s:e] - low] = 1
            total += part @ part.T
        return total[x, y].astype(np.int64)
    begins = np.searchsorted(owner, np.arange(k + 1))
    mark = np.zeros(width, bool)
    out = np.zeros(len(x), np.int64)
    last = -1
    for i in np.argsort(x, kind="stable").tolist():
        a, b = x[i], y[i]
        if a != last:
            if last >= 0:
                mark[place[begins[last] : begins[last + 1]]] = False
            mark[place[begins[a] : begins[a + 1]]] = True
            last = a
        out[i] = np.count_nonzero(mark[place[begins[b] : begins[b + 1]]])
    return out


def _verify(rows: list[dict], n: int, threshold: float) -> Iterator[tuple]:
    """(key, linked documents, root within this unit) for the classes of one unit that have a link in it."""
    rows = list({r["key"]: r for r in rows}.values())
    if len(rows) < 2:
        return
    own = np.array([r["own"] for r in rows])
    x, y = _shared(np.array([r["bands"] for r in rows], np.int64), own, rows[0]["a"] != rows[0]["b"], rows[0]["j"])
    if not len(x):
        return
    grams, first = gram_sets(_words.Chunk([r["text"] or b"" for r in rows]), n)
    size = np.diff(first)
    near = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
    x, y = x[near], y[near]
    both = _intersections(grams, first, x, y) if len(x) else np.zeros(0, np.int64)
    linked = both >= threshold * (size[x] + size[y] - both)
    x, y = x[linked], y[linked]
    if not len(x):
        return
    copies = np.array([r["n_copies"] for r in rows], np.int64)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, x, copies[y])
    np.add.at(links, y, copies[x])
    keys = [r["key"] for r in rows]
    rank = np.argsort(np.argsort(np.array(keys, object)))
    root = rank.copy()
    while True:  # smallest rank of each component
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        if (low == root).all():
            break
        root = low
    by_rank = sorted(keys)
    for i in np.flatnonzero(links).tolist():
        yield keys[i], int(links[i]), by_rank[root[i]]


def _verified(docs: DataFrame, units: DataFrame, n: int, threshold: float) -> DataFrame:
    texts = _texts(docs)
    wanted = units.select(F.col("first.doc_id").alias("want_id"), F.col("first.text_key").alias("want_key"), "key", "root", "j", "band", "a", "b", "own", "whole", "n_copies", "bands")
    there = texts.join(wanted, (texts["text_key"] == wanted["want_key"]) & texts["doc_id"].eqNullSafe(wanted["want_id"]))
    unit = ["root", "j", "band", "a", "b"]
    dealt = there.select(*unit, "key", "own", "whole", "n_copies", "bands", "text").repartition(_base.shuffle_partitions(docs.sparkSession), *unit).sortWithinPartitions(*unit)

    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        current, held = None, []
        for batch in batches:
            text = batch.schema.get_field_index("text")
            raw = batch.set_column(text, "text", batch.column(text).cast(pa.binary()))
            for r in (r for low in range(0, raw.num_rows, _words.ROWS_AT_ONCE) for r in raw.slice(low, _words.ROWS_AT_ONCE).to_pylist()):
                its = tuple(r[c] for c in unit)
                if its != current:
                    if held:
                        yield held
                    current, held = its, []
                held.append(r)
        if held:
            yield held

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = (pa.binary(), pa.int64(), pa.binary(), pa.bool_())
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["key", "links", "root", "whole"])
        for rows in unit_rows(batches):
            out += [(*found, rows[0]["whole"]) for found in _verify(rows, n, threshold)]
            if len(out) > 10_000:
                yield make()
                out.clear()
        yield make()

    return dealt.mapInArrow(verify, "key binary, links long, root binary, whole boolean")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """Each input row's class of near duplicates and its number of links.

    Needs doc_id (long) and text; other columns of any name are ignored.
    Returns one row for each input row: doc_id, text_key (xxhash64 of the text),
    class_id (the smallest doc_id among all rows that links connect), is_first
    (whether this row's doc_id and text stand for the class), n_links (other
    rows whose n-gram set has a Jaccard similarity of at least ``threshold``
    with this one's) and n_copies (rows with the same set, this one included).

    Words are runs of anything but ASCII white space, unchanged; a text of fewer
    words than ``words`` is one gram. Null, empty and blank texts have no grams:
    they are in no class with others, class_id is their own doc_id, n_links and
    n_copies are 0 and is_first is true. Rows with a null doc_id take part; a
    class of such rows only has a null class_id. Repeated rows are copies. An
    empty table gives an empty result.
    """
    _base.require(docs, "doc_id", "text")
    bands, rows = choose_bands(threshold, recall, max_hashes)
    signed = _base.checkpoint(_signatures(docs, words, bands, rows))
    full = signed.where(F.col("key").isNotNull())
    classes = _base.checkpoint(full.groupBy("key").agg(_first(), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")))
    meeting = classes.select("key", F.explode("bands").alias("band"))
    places = _base.checkpoint(meeting.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low <> high").drop("high"))
    edges = _base.spread_join(meeting, places, ["band"], "n").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    units = _units(classes, connected_components(edges))
    found = _base.checkpoint(_verified(docs, units, words, threshold))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    # A component in one unit has its root already; the others' edges are joined up.
    whole = found.where("whole").select("key", "root")
    parts = connected_components(found.where("not whole").select(F.col("key").alias("a"), F.col("root").alias("b")))
    roots = whole.unionByName(parts)
    linked = classes.join(roots, "key").join(links, "key").select("key", "root", "links", "first", "n_copies")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    known = linked.join(heads, "root").select("key", "links", "head")
    each = classes.select("key", "first", "n_copies").join(known, "key", "left").select("key", "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", "first").alias("head"))
    own = signed.select("doc_id", "text_key", "key")
    joined = own.where(F.col("key").isNotNull()).join(each, "key").select(
        "doc_id",
        "text_key",
        F.col("head.doc_id").alias("class_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("is_first"),
        (F.col("links") + F.col("n_copies") - 1).alias("n_links"),
        "n_copies",
    )
    empty = own.where(F.col("key").isNull()).select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_first"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return joined.unionByName(empty)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one of each group, and all rows that have none.

    Repeated rows of a doc_id and text with words are one document of which one
    row stays; texts that are null, empty or blank all stay. Columns of any name
    are kept.
    """
    found = _base.checkpoint(near_duplicates(docs, **options))
    gone_id, gone_key = _base.fresh(docs, "gone_id"), _base.fresh(docs, "gone_key")
    gone = found.where(~F.col("is_first")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    left = docs.join(gone, (F.xxhash64(docs["text"]) == gone[gone_key]) & docs["doc_id"].cast("long").eqNullSafe(gone[gone_id]), "left_anti")
    again = found.where("is_first and n_copies > 1").groupBy("doc_id", "text_key").count().where("count > 1")
    if again.isEmpty():
        return left
    its_id, its_key = _base.fresh(docs, "its_id"), _base.fresh(docs, "its_key")
    again = again.select(F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key))
    same = (F.xxhash64(left["text"]) == F.col(its_key)) & left["doc_id"].cast("long").eqNullSafe(F.col(its_id))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every document."""
    return near_duplicates(_base.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def brute_force(rows: list[tuple], words: int = WORDS, threshold: float = THRESHOLD) -> dict:
    """doc_id: (class_id, n_links, n_copies), from all pairs; for tests."""
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}
    links, copies = dict.fromkeys(ids, 0), {i: int(bool(sets[i])) for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                copies[i] += a == b
                copies[j] += a == b
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), links[i], copies[i]) for i in ids}
