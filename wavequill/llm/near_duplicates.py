"""N-gram Jaccard join: parity sketches, pigeonholed in chunks per size band, then exact comparison; and its components.

Copies of a set of shingles become one class. Classes that agree in a chunk meet by its key. Similar ones agree in more than
one chunk: how many a class needs follows from its size. So of the keys that others have too, a class that has fewer than it
needs drops out, and of the others it can do without its most frequent ones, one less than it needs (a prefix by rarity).

Each key's classes are compared with the least of them first, so that a large group of near copies costs a comparison a
member and not a pair; links found are made into components, and only classes of a key that are then still in different
components are compared further: by their sketches, block against block of at most about MEMBERS, and exactly where these
allow it.

Shingles that very many documents have, of passages that they share, stay out of the keys: unlike documents would meet by
them. Which are left out has no effect on the result, only on its cost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stage, unstage
from .components import components
from .shingles import Bands, Hot, close_pairs, keys_of, parts, shingle_sets, signatures, similar, sketch, sketches_allow

#: Share of the documents (and how many at least) that have a hot shingle, and how many hot ones are used (the most frequent).
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.002, 10, 1 << 20
#: Members of a key that are compared in one task at once, about.
MEMBERS = 256


def _raw(batch) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in batch.column("text").to_pylist()]


def _signed(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x.view(np.int64), pa.int64())


def _parts(batch, size: int = 512):
    """Slices of an Arrow batch, so that a worker holds few rows at once."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def _measured(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, s1, s2 for every row of docs; and rows with h and c: a shingle that is frequent in a part of docs, and how often."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "s1", "s2", "h", "c"]
        none = lambda n: pa.nulls(n, pa.int64())
        for batch in (p for b in batches for p in parts(b)):
            sets = shingle_sets(_raw(batch), size)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *map(_signed, signatures(sets)), none(n), none(n)], names=names)
            hashes, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            often = c >= max(3, HOT_SHARE * n)
            if often.any():
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, batch.column("doc_id").type), none(k), none(k), none(k), _signed(hashes[often]), pa.array(c[often].astype(np.int64))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, h long, c long")


def _keyed(docs: DataFrame, size: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, s1, s2, keys, met, needs, told for every row of docs: see keys_of(). The first met of the keys are also those of
    another class nearby, in the same part of a batch. A row with told for each part has these keys, once each, and no doc_id:
    it tells others that have one of them, elsewhere, that they share it."""
    hashes = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        import pyarrow as pa

        bands, warm = Bands(percent), Hot(hashes.value)
        for batch in (p for b in batches for p in parts(b)):
            sets = shingle_sets(_raw(batch), size)
            mine, needs = keys_of(sets, bands, warm)
            s1, s2 = signatures(sets)
            classes = np.unique(np.stack([s1, s2], axis=1), axis=0, return_index=True)[1]
            keys, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(mine[i]) for i in classes]]), return_counts=True)
            near = keys[seen > 1]
            is_near = [np.isin(k, near) for k in mine]
            mine = [np.concatenate([k[m], k[~m]]) for k, m in zip(mine, is_near, strict=True)] + [near]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in mine])]).astype(np.int32)
            four = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(mine) + 1, 4, dtype=np.int32)), pa.array(np.append(needs, np.ones((1, 4), np.int16)).astype(np.int16), pa.int16()))
            ids = pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, batch.column("doc_id").type)])
            met = pa.array([int(m.sum()) for m in is_near] + [0], pa.int32())
            told = pa.array([False] * len(sets) + [True])
            # The last row's signature is any, to spread those rows.
            mark = near[:1] if len(near) else np.zeros(1, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, _signed(np.append(s1, mark)), _signed(np.append(s2, mark)), pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(mine))), met, four, told], names=["doc_id", "s1", "s2", "keys", "met", "needs", "told"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, s1 long, s2 long, keys array<long>, met int, needs array<short>, told boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """key, doc_id, need of the rows (doc_id, met, needs, told, keys) whose key another class has too.

    What is met nearby needs no count, so it is spread by doc_id, and a key's rows that are counted in one task are one for
    each part of the documents at most, however many have the key.
    """
    rows = rows.select("doc_id", "met", "needs", "told", F.posexplode("keys").alias("at", "key"))
    rows = rows.select("key", "doc_id", "told", F.get("needs", F.col("key").bitwiseAND(F.lit(3)).cast("int")).alias("need"), (F.col("at") < F.col("met")).alias("near"))
    rows = rows.withColumn("spread", F.when(F.col("near"), F.xxhash64("doc_id")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("members", F.count("*").over(Window.partitionBy("key", "spread")))
    return rows.where((F.col("near") | (F.col("members") > 1)) & ~F.col("told")).select("key", "doc_id", "need")


def _with_members(rows: DataFrame) -> DataFrame:
    """rows (a staged table) whose key others have too, with members and leader (the least doc_id) of it.

    Counted with partial sums and joined back: a table of keys that is broadcast if it is small, and else one whose frequent
    keys' partitions can be split, since both sides are staged.
    """
    of_key = stage(rows.groupBy("key").agg(F.count("*").alias("members"), F.min("doc_id").alias("leader")).where("members > 1"), "members")
    return rows.join(small(of_key), "key")


def _meeting(shared: DataFrame) -> DataFrame:
    """key, doc_id, leader, members of shared (key, doc_id, need): what is left once classes that share fewer keys than they
    need are gone, twice, and each of the others is without its most frequent keys, one less than it needs."""
    of_doc = Window.partitionBy("doc_id", F.col("key").bitwiseAND(F.lit(3)))
    rows = shared.withColumn("need", F.min("need").over(of_doc)).withColumn("has", F.count("*").over(of_doc)).where("has >= need")
    first = stage(rows.select("key", "doc_id", "need"), "enough")
    rows = _with_members(first).withColumn("has", F.count("*").over(of_doc)).where("has >= need").withColumn("place", F.row_number().over(of_doc.orderBy("members", "key")))
    second = stage(rows.where(F.col("place") <= F.col("has") - F.col("need") + 1).select("key", "doc_id"), "rare")
    unstage(first)
    met = stage(_with_members(second), "met")
    unstage(second)
    return met


def _with_sets(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, band, own, above (sketches of the two schemes), hashes of the documents in nodes."""

    def run(batches):
        import pyarrow as pa

        bands = Bands(percent)
        for batch in (p for b in batches for p in parts(b)):
            sets = shingle_sets(_raw(batch), size)
            made = [[sketch(s, x).tobytes() for x in bands.of(len(s))] if len(s) else [] for s in sets]
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands.of(max(1, len(s)))[0].number for s in sets], pa.int32()), pa.array([m[0] if m else None for m in made], pa.binary()), pa.array([m[1] if len(m) > 1 else None for m in made], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "band", "own", "above", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text").join(small(nodes), "doc_id", "left_semi")
    return stage(chosen.mapInArrow(run, f"doc_id {kind}, n long, band int, own binary, above binary, hashes binary"), "sets")


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with columns of both, as a_.. and b_.."""
    for side in "ab":
        mine = sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(mine, side)
    return pairs


def _allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches' Hamming distance allows that they are similar."""

    def run(batches):
        import pyarrow as pa

        bands = Bands(percent)
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("a_n", "b_n", "a_own", "a_above", "b_own", "b_above")}
            words = lambda i, side: [np.frombuffer(c[f"{side}_{k}"][i], np.uint16) for k in ("own", "above") if c[f"{side}_{k}"][i] is not None]  # noqa: B023, E731
            keep = [sketches_allow(words(i, "a"), words(i, "b"), c["a_n"][i], c["b_n"][i], bands) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in "ab"], names=["a", "b"])

    return _beside(pairs, sets, ["n", "own", "above"]).mapInArrow(run, pairs.schema)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar."""

    def run(batches):
        import pyarrow as pa

        for batch in (p for b in batches for p in _parts(b)):
            a, b = (batch.column(f"{s}_hashes").to_pylist() for s in "ab")
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in "ab"], names=["a", "b"])

    return _beside(pairs, sets, ["hashes"]).mapInArrow(run, pairs.schema)


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of a key, of different components, whose sketches allow that they are similar.

    open_: key, doc_id, root. A key's members are dealt to blocks by hash, and two blocks meet in a row of their own.
    """
    size = stage(open_.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    mine = F.when(F.col("key").bitwiseAND(F.lit(1)) == F.col("band") % 2, F.col("own")).otherwise(F.col("above"))
    dealt = open_.join(small(size), "key").join(sets.select("doc_id", "n", "band", "own", "above"), "doc_id").select("key", block.alias("block"), F.struct("doc_id", "n", "root", mine.alias("sketch"), block.alias("block")).alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = dealt.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list("m").alias("members"))

    def run(batches):
        import pyarrow as pa

        for batch in (p for b in batches for p in _parts(b, 64)):
            a, b = [], []
            for i, j, members in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "members")), strict=True):
                for x, y in close_pairs(members, i != j, percent):
                    a.append(min(x, y))
                    b.append(max(x, y))
            kind = batch.schema.field("members").type.value_type.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = open_.schema["doc_id"].dataType.simpleString()
    return cells.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Two documents are linked if their sets of shingles of size words (A-Z lowered) are at least percent similar; fewer words
    are one shingle. component_id is the least doc_id that links reach. Null, empty and blank texts have no shingle and are
    linked with nothing. Rows with one doc_id are one document, and linked if any of their texts is. Rows with a null doc_id
    are linked with nothing, and have a null component_id. Empty tables give no rows. Other columns are not read.

    Sets are compared by 64-bit hashes of shingles, and copies found by 128 bits of the set.
    """
    docs = docs.select("doc_id", "text")
    measured = stage(_measured(docs, size), "measured")
    base = measured.where("h is null").select("doc_id", "n", "s1", "s2")
    least = max(HOT_LEAST, HOT_SHARE / 2 * base.count())
    hot = measured.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(HOT_MOST).select("h").toArrow()
    hot = np.sort(hot.column("h").to_numpy().astype(np.int64).view(np.uint64))
    known = base.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    copies = stage(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "copies")
    n_copies = copies.count()
    of_class = lambda rows: rows.join(small(copies, n_copies), ["s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    # A class has a row for each of its keys, so no key can hold more than a fraction of all rows.
    keyed = of_class(_keyed(docs, size, percent, hot).where(F.col("doc_id").isNotNull() | F.col("told"))).where(F.col("told") | (F.col("rep") == F.col("doc_id")))
    shared = shared_table = stage(_shared(keyed), "shared")
    if known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        shared = shared.groupBy("key", "doc_id").agg(F.min("need").alias("need"))
    met = _meeting(shared)
    star = stage(met.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    nodes = stage(star.select(F.col("a").alias("doc_id")).unionByName(star.select(F.col("b").alias("doc_id"))).distinct(), "nodes")
    sets = _with_sets(docs, nodes, size, percent)
    links = stage(_similar(_allowed(star, sets, percent), sets, percent), "links")
    roots = stage(components(links), "roots")
    others = met.where((F.col("members") > 2) & (F.col("doc_id") != F.col("leader"))).join(roots, F.col("doc_id") == F.col("node"), "left")
    others = others.select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    # Documents that share a passage meet by many keys; one of all keys with the same members is enough.
    member = F.xxhash64("doc_id")
    same_members = {"m1": F.count("*"), "m2": F.bit_xor(member), "m3": F.sum(F.hash(F.lit(1), member).cast("long")), "m4": F.sum(F.hash(F.lit(2), member).cast("long"))}
    of_keys = others.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), *[c.alias(n) for n, c in same_members.items()])
    mixed = stage(of_keys.where("x <> y").groupBy(*same_members).agg(F.min("key").alias("key")).select("key"), "mixed")
    open_ = stage(others.join(small(mixed), "key", "left_semi"), "open")
    more = stage(_similar(stage(_across(open_, sets, percent), "across"), sets, percent), "links")
    unstage(shared_table, met, mixed, open_, sets, star, nodes)
    if more.count():
        roots = stage(components(links.unionByName(more)), "roots")
    named = of_class(known).select(F.col("doc_id").alias("_doc"), "rep").join(roots, F.col("rep") == F.col("node"), "left")
    ids = named.groupBy("_doc").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    sizes = base.select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(ids, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, all columns, for each group of near duplicates: of the least doc_id, and of its rows the least by text
    and then by the columns as they come (null first). What has no words stays, one row for each doc_id too. Of equal rows
    without doc_id one stays. Empty tables give no rows. Texts are only moved of rows that repeat.
    """
    found = link(docs, size, percent).where(F.col("component_id").isNotNull() & (F.col("component_id") != F.col("doc_id")))
    gone = stage(found.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return _one_row_each(docs.join(small(gone), F.col("doc_id") == F.col("_gone"), "left_anti"))


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id, and one of equal rows without: see deduplicated()."""
    names = docs.columns
    nameless = F.concat(F.lit("row "), F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))
    keyed = docs.withColumn("_wq_key", F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), nameless))
    often = stage(keyed.groupBy("_wq_key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("_wq_key").alias("_wq_often")), "often")
    n = often.count()
    if not n:
        return docs
    meets = F.col("_wq_key") == F.col("_wq_often")
    row = F.struct("text", *[c for c in names if c != "text"])
    least = keyed.join(small(often, n), meets, "left_semi").groupBy("_wq_key").agg(F.min(row).alias("_wq_row"))
    once = keyed.join(small(often, n), meets, "left_anti").select(*names)
    return once.unionByName(least.select(*[F.col("_wq_row")[c].alias(c) for c in names]))
