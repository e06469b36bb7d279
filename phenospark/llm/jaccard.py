"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set is its distinct word shingles. Documents whose sets are equal are one class; the join runs over one
representative of each. Two sets of Jaccard similarity t or more share a token of their prefixes (the first
n - ceil(t*n) + 1 tokens) under *every* global order, so candidates must share one under all of ``ORDERS`` orders. The
first order puts rare tokens first (by a table of hashed counts over the whole corpus, fixed in size); the others are
hash orders. The first finds the candidates by an equi-join on tokens; the others are intersected before verification.

Each document carries its prefix under the first order, a longer one, twice that, under the second, and one of short
hashes under the third. Tokens of at most ``SMALL`` holders make all their pairs. A pair is made of a token only where its
places in both sets leave room for enough common ones after it: the first common token of two similar sets does, whatever
other tokens they share; and where the bitmaps of both sets differ in no more places than the sets may differ in tokens.
What these allow must share under the second order, too, as many as two sets so similar cannot fail to share, and a token
under the third; only then are whole sets fetched and compared, for one pair of each document first, then for the pairs that
these links do not join already. Sets and sketches are fetched for the documents of
candidate pairs alone, by an id filter before the shuffle, and each round's tables are deleted once they are read.

A token that more sets hold makes no pairs of all of them. Rounds do most of the work, and links found become components:
the first compares the token's hub, the holder of least hash, with each other holder; the next deal the holders of each
token out by chance to cells of about ``CELL`` (four times as many each round) and compare those that meet in one, which soon joins a group whose members
are alike but not all like one hub. Holders already in one component need no more links. What remains are pairs from
different components, which are all compared at the end, by ranges of size, so that no link between components is lost.

Defined cases: null and wordless texts have no shingles, link with nothing and are components of their own; with fewer
words than a shingle, the whole sequence is the one shingle; rows repeated under one id with equal sets are one document;
of unlike sets under one id that of least fingerprint takes part, another stands alone unless it equals a set that takes
part. Very long texts are taken alone; tables without rows give none; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, PERCENT, ORDERS = 5, 80, 3
COUNT_SLOTS = 1 << 16
#: Holders of a token up to which all its pairs are made; mean size of the first cells; rounds at most, and the pairs for each
#: row of the larger tokens below which what remains is compared at once.
SMALL, CELL, ROUNDS, FEW = 16, 8, 3, 4
#: Holders of a token in a range of sizes that are compared in one key, with all that may fit them, at the end.
TOGETHER = 256
#: Bytes of text taken at once, and 64-bit words of a set's bitmap.
CHUNK_BYTES, MAP_WORDS = 1 << 18, 2


def shingle_sets(words: C.Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams = words.grams(k)
    for i in range(len(words.first) - 1):
        a, n = words.first[i], words.first[i + 1] - words.first[i]
        if n >= k:
            yield np.unique(grams[a : a + n - k + 1])
        else:
            yield np.array([words.whole(i)], np.uint64) if n else np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def print_of(tokens: np.ndarray) -> str:
    """Fingerprint of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def _describe(k: int):
    """Each document's set size and fingerprint; each task's table of hashed counts of the tokens it saw."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            for a, b, buf, off in C.slices(batch.column(1), CHUNK_BYTES):
                sizes, prints = [], []
                for s in shingle_sets(C.Words(buf, off, C.NOT_SPACE, lower=True), k):
                    sizes.append(len(s))
                    prints.append(print_of(s))
                    counts += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=COUNT_SLOTS) if len(s) > 4096 else 0
                    if len(s) <= 4096:
                        np.add.at(counts, (s >> np.uint64(48)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(prints, pa.string()), pa.nulls(b - a, pa.list_(pa.int64()))], names=["doc_id", "n", "print", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([counts], pa.list_(pa.int64()))], names=["doc_id", "n", "print", "counts"])

    return scan


def sketch_of(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The first 2p hashes (32 bits) under the second order, in order; p is the prefix length."""
    h = np.sort(C.mixed(tokens, 1))[: 2 * prefix_length(len(tokens), percent)]
    return (h >> np.uint64(32)).astype(np.uint32)


def third_of(tokens: np.ndarray, percent: int) -> bytes:
    """The first p hashes (16 bits) under the third order, as bytes."""
    h = C.mixed(tokens, 2)
    p = prefix_length(len(tokens), percent)
    return (np.partition(h, p - 1)[:p] >> np.uint64(48)).astype("<u2").tobytes()


def bitmap_of(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of 64 * MAP_WORDS slots; a token that only one of two sets has changes one
    bit, so that two bitmaps differ in no more bits than the sets in tokens."""
    size = 64 * MAP_WORDS
    slot = (C.mixed(tokens, ORDERS) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=size) & 1).astype(np.uint8)).view(np.int64)


def may_link(nx: int, x: np.ndarray, ny: int, y: np.ndarray, percent: int) -> bool:
    """Whether two sketches share what sets of the asked similarity can't fail to share.

    Of sets that link, ``least`` tokens are common, so that x lacks at most nx - least of its first m in y, and a common
    one among them is among the first m + ny - least of y."""
    least = -(-percent * (nx + ny) // (100 + percent))
    dx, dy = nx - least, ny - least
    if dx < 0 or dy < 0:
        return False
    m = min(len(x), len(y) - dy) if len(y) < ny else len(x)
    return m <= dx or int(np.isin(x[:m], y).sum()) >= m - dx


def _prefixes(k: int, percent: int, counts: np.ndarray):
    """Each document's prefix under the first order, tokens of small counts first, then by hash; sketch and bitmap."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in C.slices(batch.column(1), CHUNK_BYTES):
                out, sketches, thirds, maps, prints = [], [], [], [], []
                for s in shingle_sets(C.Words(buf, off, C.NOT_SPACE, lower=True), k):
                    p = prefix_length(len(s), percent) if len(s) else 0
                    heavy = counts[(s >> np.uint64(48)).astype(np.int64)]
                    out.append(s[np.argsort(heavy, kind="stable")[:p]])
                    sketches.append(sketch_of(s, percent) if len(s) else np.zeros(0, np.uint32))
                    thirds.append(third_of(s, percent) if len(s) else b"")
                    maps.append(bitmap_of(s))
                    prints.append(print_of(s))
                lists = [C.lists(C.signed(np.concatenate(out)), [len(x) for x in out], pa.int64()), C.lists(np.concatenate(sketches).view(np.int32), [len(x) for x in sketches], pa.int32()), C.lists(np.concatenate(maps), [MAP_WORDS] * len(maps), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints, pa.string()), *lists, pa.array(thirds, pa.binary())], names=["node", "print", "tokens", "sketch", "map", "third"])

    return scan


def _sets(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in C.slices(batch.column(1), CHUNK_BYTES):
                out = list(shingle_sets(C.Words(buf, off, C.NOT_SPACE, lower=True), k))
                flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([print_of(x) for x in out], pa.string()), C.lists(C.signed(flat), [len(x) for x in out], pa.int64())], names=["node", "print", "tokens"])

    return scan


def _sift(percent: int):
    """Pairs that share enough under the second order and a token under the third."""

    def share(x: bytes, y: bytes) -> bool:
        return bool(len(np.intersect1d(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"))))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(f["nu"].tolist(), f["x"], f["tx"], f["nv"].tolist(), f["y"], f["ty"], strict=True)
            yield f.loc[[may_link(nu, np.asarray(x), nv, np.asarray(y), percent) and share(tx, ty) for nu, x, tx, nv, y, ty in rows], ["u", "v"]]

    return scan


def _held(table: DataFrame, common: DataFrame) -> DataFrame:
    """token, place, node of the prefix tokens (node, tokens) that may be common: most have one holder and are not moved."""
    bits = C.id_filter(F.col("token"), common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = pc.list_value_length(lists).to_numpy()
            keep = np.flatnonzero(C.passes(bits, batch.column(2).flatten().to_numpy()))
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([lists.flatten().take(pa.array(keep)), pa.array(place[keep]), pa.array(np.repeat(batch.column(0).to_numpy(), n)[keep])], names=["token", "place", "node"])

    return table.select("node", "tokens", F.transform("tokens", lambda t: C.slot_of(t, bits))).mapInArrow(scan, "token long, place int, node long")


def components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row with an id or not."""
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    told = C.materialize(docs.mapInArrow(_describe(shingle), "doc_id long, n long, print string, counts array<long>"))
    rows = told.where("print is not null").select("doc_id", "n", "print")
    # Classes of equal sets; the representative is the smallest id. Of unlike sets under one id that of least print stands.
    own = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("print", "n")).alias("s"))
    reps = C.materialize(own.groupBy(F.col("s.print").alias("print")).agg(F.min("doc_id").alias("node"), F.max("s.n").alias("n")))
    links, read = _links(docs, told, reps, shingle, percent)
    found = C.components(links)
    C.drop(*read)
    out = rows.join(reps.select("print", "node"), "print", "left").join(found, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _links(docs: DataFrame, told: DataFrame, reps: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between representatives, enough for their components, and the tables that only the links are read from."""
    slots = told.where("counts is not null").select(F.posexplode("counts").alias("slot", "c")).where("c > 0").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(COUNT_SLOTS, np.int64)
    counts[slots["slot"].to_numpy(np.int64)] = slots["c"].to_numpy(np.int64)
    texts = docs.where("doc_id is not null and text is not null")
    table = texts.mapInArrow(_prefixes(shingle, percent, counts), "node long, print string, tokens array<long>, sketch array<int>, map array<long>, third binary").where("size(tokens) > 0")
    table = C.materialize(table.join(reps, ["node", "print"]).drop("print"))
    held = table.select(F.posexplode("tokens").alias("place", "token"), "node")
    # One shuffle of all prefix tokens at a time, each gone before the next; the second moves few but common ones.
    common = C.materialize(held.groupBy("token").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token", "m"))
    places = C.materialize(_held(table, common).join(common, "token"))
    sketches = C.materialize(table.select("node", "n", "map", "sketch", "third"))
    C.drop(table, common)
    posts = C.materialize(places.join(sketches.select("node", "n", "map"), "node"))
    C.drop(places)
    read = [posts, sketches]
    # Common tokens from this one on, at most, against those that the similarity asks for (sizes that fit included).
    differ = " + ".join(f"bit_count(mu[{k}] ^ mv[{k}])" for k in range(MAP_WORDS))
    fits = f"{100 + percent} * least(nu - iu, nv - iv) >= {percent} * (nu + nv) and {100 + percent} * (nu + nv - ({differ})) >= {2 * percent} * (nu + nv)"

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among distinct (u, nu, v, nv), enough for their components: by sketches, then by whole sets of those that pass."""
        pairs = C.materialize(pairs)
        some = C.only(sketches.select("node", "sketch", "third"), "node", C.id_filter(F.col("node"), ends(pairs)))
        both = pairs.join(some.toDF("u", "x", "tx"), "u").join(some.toDF("v", "y", "ty"), "v")
        near = C.materialize(both.mapInPandas(_sift(percent), "u long, v long").distinct())
        nodes = ends(near)
        sets = C.only(texts.select(F.col("doc_id").alias("node"), "text"), "node", C.id_filter(F.col("node"), nodes), _sets(shingle), "node long, print string, tokens array<long>")
        sets = C.materialize(sets.join(reps.join(nodes, "node", "left_semi").select("node", "print"), ["node", "print"]).groupBy("node").agg(F.first("tokens").alias("tokens")))

        def compared(some: DataFrame) -> DataFrame:
            both = some.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
            both = both.select("u", "v", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
            found = C.materialize(both.where(f"100 * common >= {percent} * (n - common)").select("u", "v"))
            read.append(found)
            return found

        # Sets are brought to each pair: first to one of each node's, then to those that these links do not join already.
        first = near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
        found = compared(first)
        up = found.select(F.col("v").alias("x"), F.col("u").alias("top"))
        top = up.join(up.toDF("top", "over"), "top", "left").select("x", F.coalesce("over", "top").alias("top"))
        apart = near.join(first, ["u", "v"], "left_anti").join(top.toDF("u", "a"), "u", "left").join(top.toDF("v", "b"), "v", "left")
        rest = C.materialize(apart.where("coalesce(a, u) <> coalesce(b, v)").select("u", "v"))
        if not rest.isEmpty():
            found = found.unionByName(compared(rest))
        C.drop(rest)
        C.drop(pairs, near, sets)
        return found

    def side(rows: DataFrame, x: str, *keys) -> DataFrame:
        return rows.select("token", *keys, F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"i{x}"), F.col("map").alias(f"m{x}"), F.col("comp").alias(f"c{x}"))

    def apart(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        """Pairs of holders of one token in different components."""
        return a.join(b, on).where(f"u < v and cu <> cv and {fits}").select("u", "nu", "v", "nv").distinct()

    def ranged(left: DataFrame) -> DataFrame:
        """The same, by ranges of size within which sizes can fit. The holders of a token in a range are dealt out to cells
        of about ``TOGETHER``, and each that may fit them goes to all of these, so that no key holds all pairs of a token."""
        step = F.floor(F.log("n") / float(np.log(100 / percent)) * (1 - 1e-9)).cast("int") if percent < 100 else F.col("n").cast("int")
        sized = left.withColumn("range", step)
        cells = sized.groupBy("token", "range").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("cells"))
        near = F.explode(F.array(F.col("range"), F.col("range") - 1, F.col("range") + 1)).alias("range")
        dealt = side(sized.join(cells, ["token", "range"]), "v", "range", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"))
        every = side(sized, "u", near).join(cells, ["token", "range"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
        return apart(every, dealt, ["token", "range", "cell"])

    small = posts.where(f"m <= {SMALL}").withColumn("comp", F.col("node"))
    left = posts.where(f"m > {SMALL}").withColumn("comp", F.col("node"))
    pairs = apart(side(small, "u"), side(small, "v"), ["token"])
    links = None
    for turn in range(ROUNDS):
        if turn:
            cell = F.pmod(F.xxhash64("node", "token", F.lit(turn)), F.ceil(F.col("m") / (CELL * 4 ** (turn - 1)))).alias("cell")
            pairs = apart(side(left, "u", cell), side(left, "v", cell), ["token", "cell"])
        else:
            first = F.struct(F.xxhash64("node").alias("h"), "node", F.col("n").alias("n"), F.col("place").alias("place"), F.col("map").alias("map"))
            hubs = left.groupBy("token").agg(F.min(first).alias("hub")).select("token", F.col("hub.node").alias("v"), F.col("hub.n").alias("nv"), F.col("hub.place").alias("iv"), F.col("hub.map").alias("mv"))
            stars = left.join(hubs, "token").select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("place").alias("iu"), F.col("map").alias("mu"), "v", "nv", "iv", "mv").where(f"u <> v and {fits}").select("u", "nu", "v", "nv")
            pairs = pairs.unionByName(stars).distinct()
        found = verified(pairs)
        links = found if links is None else links.unionByName(found)
        group = C.components(links)
        past = left if turn else None
        now = posts.where(f"m > {SMALL}").join(group, "node", "left").select("token", "m", "node", "n", "place", "map", F.coalesce("component", "node").alias("comp"))
        # Tokens whose holders are in more than one component, and how many pairs of them are still apart.
        mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("token")
        left = C.materialize(now.join(mixed, "token"))
        C.drop(group, *([past] if turn else []))
        by = left.groupBy("token", "comp").count().groupBy("token").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("q"))
        rows, rest = by.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.lit(0))).first()
        if not rest or rest <= FEW * rows:
            break
    read.append(left)
    return (links.unionByName(verified(ranged(left))) if rest else links), read


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row (all columns) of each component: the one whose id names it. Rows without an id or words all stay.

    Of rows under one id with the same words in order, one stays; rows of one id with other words are taken as documents each."""
    found = components(documents, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    key = F.col(f"`{id_col}`").cast("long")
    many = C.materialize(documents.groupBy(key.alias("__many")).count().where("__many is not null and count > 1").select("__many"))
    if many.isEmpty():
        return documents.join(gone, key == F.col("__gone"), "left_anti")
    kept = documents.join(C.materialize(gone), key == F.col("__gone"), "left_anti")
    said = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lower = F.translate(said, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    again = kept.join(many, key == F.col("__many"), "left_semi").withColumn("__id", key)
    again = again.withColumn("__words", F.regexp_replace(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "), "^ | $", ""))
    one = again.where("__words <> ''").dropDuplicates(["__id", "__words"]).unionByName(again.where("__words = ''"))
    return kept.join(many, key == F.col("__many"), "left_anti").unionByName(one.select(*[F.col(f"`{c}`") for c in documents.columns]))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id")
