"""Exact Jaccard self-join of word shingles by a grouped prefix join, and its components.

Documents are sets of hashed shingles. In one order of all shingles, two sets that
are similar enough share a shingle among their first few (their prefixes). The order
puts shingles that repeat within a chunk of documents last, the most frequent at the
very end; any order gives the same answer.

1. Documents with equal sets are one class; classes with the same prefix and size
   are one group, and only groups enter the join.
2. Groups that share a prefix shingle form a bucket. A bucket is never expanded to
   all its pairs. While buckets of over ``LARGE`` members hold several components,
   every member of one meets a member of its buckets that is drawn anew each round,
   if the sizes of their groups allow a link; the nearest is verified on the whole
   sets, and verified links join components.
3. Last, in buckets that still hold several components, groups with members outside
   the bucket's largest component meet the groups of other components; large buckets
   are split by size for it. A pair of groups stays if its sizes and the number of
   prefix shingles it shares allow the threshold, and only such pairs are expanded to
   members; a pair of members is verified if its parity bitmaps allow it too (their
   distance is at most the sets' difference). Pairs inside a component need no test:
   they change nothing. So the components are those of all links.

Defined results: words are runs of bytes other than space and \\x09-\\x0d, A-Z
lower-cased; null and blank texts have no shingles and link with nothing; rows that
repeat a text are one class; null ids never name a component unless all its ids are
null; an empty table gives an empty result. Only the id and text columns are read.
Shingles are compared by 64-bit hashes. Classes have 64-bit numbers too; two sets
that met in one number would be seen and all numbers drawn anew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.chunks import blocks
from ledgerloom.llm.common import arrow_rows, fresh, settled, shipped
from ledgerloom.llm.components import components
from ledgerloom.llm.wordhash import Words, mix

WIDTH, PERCENT, ROUNDS = 5, 80, 3
LARGE = 16
FREQUENT = 1 << 20  # shingles whose frequency the order knows; changes no result
BITMAP_WORDS = 8
BITS = [f"bits{i}" for i in range(BITMAP_WORDS)]


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct shingle hashes, sorted by both."""
    words = Words(texts, lower=True)
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.counts)
    left = np.repeat(words.counts, words.counts) - place
    rows = np.repeat(np.arange(len(texts)), words.counts)
    take = left >= width
    row, token = [rows[take]], [words.windows(width)[take]]
    for size in range(1, width):  # a shorter text is one shingle, its whole sequence
        short = np.flatnonzero(words.counts == size)
        if len(short):
            row.append(short)
            token.append(mix(words.windows(size)[words.first[short]] + np.uint64(size)))
    row, token = np.concatenate(row), np.concatenate(token)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[new], token[new]


def frequent_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that repeat most within chunks of documents, sorted, with counts.
    ``FREQUENT`` bounds the list, whatever the data."""
    def repeats(batches):
        for batch in batches:
            for _, texts in blocks(batch.column(0), 6_000_000):
                token = np.concatenate([shingles(part, width)[1] for _, part in blocks(texts, 1_000_000)])
                token, count = np.unique(token, return_counts=True)
                often = count > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[often].view(np.int64)), pa.array(count[often])], ["token", "n"])

    counts = settled(arrow_rows(rows.select("text"), repeats, "token long, n long").groupBy("token")
                     .agg(F.sum("n").alias("n")).where("n >= 16"), "repeated-shingles")
    # Whole levels of frequency, from the highest down, as many as the bound allows.
    level = F.floor(8 * F.log2("n"))
    least, held = None, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["level"]
    top = counts.where(level >= least if least is not None else F.lit(False)).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def profiles(rows: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """id, class (and a check of it), size, group, bitmap and prefix of every row."""
    hot, hot_count = frequent_shingles(rows, width)
    sent = rows.sparkSession.sparkContext.broadcast((hot, hot_count))
    one, two = mix(np.array([2 * seed + 1, 2 * seed + 2], np.uint64))

    def sums(values, starts, sizes):
        out = np.zeros(len(sizes), np.uint64)
        if len(values):
            out[sizes > 0] = np.add.reduceat(values, starts[sizes > 0])
        return out

    def run(batches):
        hot, hot_count = sent.value
        for batch in batches:
            for at, texts in blocks(batch.column("text"), 1_000_000):
                n_rows = len(texts)
                row, token = shingles(texts, width)
                sizes = np.bincount(row, minlength=n_rows)
                starts = np.cumsum(sizes) - sizes
                count = np.zeros(len(token), np.int64)
                if len(hot):
                    spot = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    count = np.where(hot[spot] == token, hot_count[spot], 0)
                order = np.lexsort((token, count, row))
                ordered = token[order]
                place = np.arange(len(row)) - np.repeat(starts, sizes)
                prefix = np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)
                taken = place < np.repeat(prefix, sizes)
                p_token = ordered[taken]
                p_starts = np.cumsum(prefix) - prefix
                cls = mix(sums(mix(token ^ one), starts, sizes) + sizes.astype(np.uint64))
                check = sums(mix(token ^ two), starts, sizes)
                group = mix(sums(mix(p_token ^ two), p_starts, prefix) + sizes.astype(np.uint64))
                bit = mix(token ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * BITMAP_WORDS)
                bits = np.zeros(n_rows * BITMAP_WORDS, np.uint64)
                np.bitwise_xor.at(bits, row * BITMAP_WORDS + (bit >> np.uint64(6)).astype(np.int64),
                                  np.uint64(1) << (bit & np.uint64(63)))
                bits = bits.view(np.int64).reshape(n_rows, BITMAP_WORDS)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(p_starts, len(p_token)), pa.int32()), pa.array(p_token.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, n_rows), batch.column("text_md5").slice(at, n_rows), pa.array(cls.view(np.int64)), pa.array(check.view(np.int64)),
                     pa.array(sizes.astype(np.int64)), pa.array(group.view(np.int64))]
                    + [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITMAP_WORDS)] + [lists], schema.names)

    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("text_md5", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("class", "check", "size", "group", *BITS)]
        + [T.StructField("prefix", T.ArrayType(T.LongType()))])
    return arrow_rows(rows.withColumn("text_md5", F.md5("text")), run, schema)


def buckets(found: DataFrame) -> DataFrame:
    """``bucket``, ``group``, ``weight``: groups that share a prefix shingle, and groups
    of several classes. The weight is the number of shingles that the bucket stands for."""
    entries = found.where("size > 0").select("group", F.explode("prefix").alias("token"))
    met = settled(entries.groupBy("token").agg(
        F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
        .where("low <> high"), "shared-shingles")
    # A shingle of two rows names both of its groups; the others are looked up.
    pairs = met.where("n = 2").groupBy("low", "high").agg(F.count("*").alias("weight")).select(
        F.xxhash64("low", "high").alias("bucket"), F.explode(F.array("low", "high")).alias("group"), "weight")
    many = settled(met.where("n > 2").select("token"), "many-shingles")
    looked = entries.join(shipped(many), "token").select(F.col("token").alias("bucket"), "group").distinct()
    alike = found.where("size > 0").groupBy("group").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.size("prefix")).alias("weight"))
    alike = alike.where("low <> high").select(F.xxhash64("group", F.lit(1)).alias("bucket"), "group",
                                              F.col("weight").cast("long"))
    return pairs.unionByName(looked.withColumn("weight", F.lit(1).cast("long"))).unionByName(alike)


def alike_sizes(percent: int):
    """Condition on ``size`` and ``size2`` that every linked pair meets."""
    return 100 * F.least("size", "size2") >= percent * F.greatest("size", "size2")


def allowed(percent: int):
    """Condition on a pair of sizes and bitmaps (columns ``size``, ``bits`` and the same
    with ``2``) that every linked pair meets."""
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(b + "2"))) for b in BITS), F.lit(0))
    return (alike_sizes(percent)
            & (apart * (100 + percent) <= (F.col("size") + F.col("size2")) * (100 - percent))), apart


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of classes whose whole sets reach the threshold. The sets
    of ``a`` travel once for each pair, those of ``b`` once."""
    def sets(wanted: DataFrame, label: str) -> DataFrame:
        """class, ``b`` and set of one row of each wanted class, made from its text."""
        wanted = shipped(settled(wanted.join(nodes.select("class", "sample", "seed"), "class"), label))
        texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("sample"))).select("class", "b", "seed", "text")

        def run(batches):
            for batch in batches:
                for at, texts in blocks(batch.column("text"), 1_000_000):
                    row, token = shingles(texts, width)
                    sizes = np.bincount(row, minlength=len(texts))
                    ends = np.cumsum(sizes)
                    part = batch.slice(at, len(texts))
                    cls, seed = np.asarray(part.column("class")), np.asarray(part.column("seed"))
                    keep, out = [], []
                    for i, (n, end) in enumerate(zip(sizes, ends)):
                        own = token[end - n:end]
                        mark = mix(np.array([2 * seed[i] + 1], np.uint64))[0]
                        total = np.add.reduce(mix(own ^ mark)) + np.uint64(n)
                        # Rows that share the id, but not the set, are not meant.
                        if mix(np.array([total]))[:1].view(np.int64)[0] == cls[i]:
                            keep.append(i)
                            out.append(own.tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c).take(pa.array(keep, pa.int64())) for c in ("class", "b")]
                        + [pa.array(out, pa.binary())], ["class", "b", "set"])

        return arrow_rows(texts, run, "class long, b long, set binary")

    left = sets(pairs.select(F.col("a").alias("class"), "b"), "wanted-a").select(F.col("class").alias("a"), "b", F.col("set").alias("x"))
    right = sets(pairs.select(F.col("b").alias("class")).distinct().withColumn("b", F.col("class")), "wanted-b")
    right = right.select("b", F.col("set").alias("y"))

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return arrow_rows(left.join(right, "b").select("a", "b", "x", "y"), compare, "a long, b long").distinct()


def class_labels(found: DataFrame, rows: DataFrame, width: int, percent: int, seed: int,
                 rounds: int) -> DataFrame | None:
    """``node``, ``label`` of the classes that have links, or None where none can."""
    nodes = settled(
        found.where("size > 0").groupBy("class").agg(
            F.min("id").alias("sample"), *[F.first(c).alias(c) for c in ("size", "group", *BITS)])
        .withColumn("seed", F.lit(seed).cast("long")), "classes")
    members = settled(buckets(found), "buckets")
    sizes = nodes.groupBy("group").agg(F.count("*").alias("_n"))
    big = settled(members.join(sizes, "group").groupBy("bucket").agg(F.sum("_n").alias("_n"))
                  .where(F.col("_n") > LARGE).select("bucket"), "large-buckets")
    condition, apart = allowed(percent)
    links, labels = None, None
    other = [F.col(c).alias(c + "2") for c in ("class", "size", *BITS)]
    band = F.floor(F.log("size") / (max(math.log(100 / percent), 1e-3) * 1.000001))

    for turn in range(rounds + 1):
        if labels is None:
            labelled = nodes.withColumn("label", F.col("class"))
        else:
            labelled = nodes.join(labels, nodes["class"] == labels["node"], "left").withColumn(
                "label", F.coalesce("label", "class")).drop("node")
        labelled = settled(labelled.select("class", "size", "group", "label", *BITS), "labelled")
        # Classes of one group and one component are one row until their group pairs are filtered.
        parts = labelled.groupBy("group", "label").agg(
            F.first("size").alias("size"), F.count("*").alias("n"), F.min("class").alias("least"))
        now = (members.join(big, "bucket") if turn < rounds else members).join(parts, "group")
        mixed = now.groupBy("bucket").agg(
            F.min("label").alias("_l"), F.max("label").alias("_h"), F.sum("n").alias("_all")
        ).where("_l <> _h").select("bucket", "_all")
        now = settled(now.join(mixed, "bucket"), "mixed-buckets")
        if not now.head(1):
            continue
        counted = now.groupBy("bucket", "label").agg(F.sum("n").alias("_n"))
        largest = settled(counted.groupBy("bucket").agg(
            F.max_by("label", F.struct("_n", F.xxhash64("label", F.lit(turn)))).alias("_main")), "largest-components")
        placed = now.join(largest, "bucket")
        outside = placed.where("label <> _main")
        if turn < rounds:
            # Each member outside the largest component of a bucket meets one drawn
            # member of that component; of all it meets, the nearest stays.
            order = F.xxhash64("bucket", "group", "label", F.lit(turn))
            drawn = placed.where("label = _main").groupBy("bucket").agg(
                F.min_by(F.struct(F.col("least").alias("class2"), F.col("size").alias("size2")), order).alias("_d"))
            met = outside.join(drawn.select("bucket", "_d.*"), "bucket").where(alike_sizes(percent))
            met = met.select("group", "label", "class2").distinct()
            met = labelled.join(met, ["group", "label"]).join(labelled.select(*other), "class2").where(condition)
            pairs = met.withColumn("_d", apart).groupBy("class").agg(F.min_by("class2", F.struct("_d", "class2")).alias("b"))
            pairs = pairs.select(F.col("class").alias("a"), "b")
        else:
            # Sizes within the threshold lie in one band or in neighbouring ones, so large
            # buckets are split by bands.
            large = F.col("_all") > LARGE
            across = placed.select("bucket", F.when(large, band).otherwise(0).alias("band"), "_main",
                                   F.struct("group", "label").alias("b"), F.col("size").alias("size2"))
            outside = outside.select(
                "bucket", "weight", F.struct("group", "label").alias("a"), "size",
                F.explode(F.when(large, F.array(band - 1, band, band + 1)).otherwise(
                    F.array(F.lit(0).cast("long")))).alias("band"))
            met = outside.join(across, ["bucket", "band"]).where(
                (F.col("a.label") != F.col("b.label")) & alike_sizes(percent)
                & ((F.col("b.label") == F.col("_main")) | (F.col("a") < F.col("b"))))
            # Each bucket that two groups share has given one row. Shingles beyond the
            # prefixes cannot make up for too few shared ones within them.
            met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
                F.sum("weight").alias("_shared"), F.first("size").alias("_s"), F.first("size2").alias("_t"))
            needed = lambda n: F.ceil(F.col(n) * percent / F.lit(100))
            beyond = F.greatest(needed("_s"), needed("_t")) - 1
            met = met.where((F.col("_shared") + beyond) * (100 + percent) >= percent * (F.col("_s") + F.col("_t")))
            met = met.select(F.col("a.group").alias("group"), F.col("a.label").alias("label"),
                             F.col("b.group").alias("group2"), F.col("b.label").alias("label2"))
            # Only now do members appear, with their bitmaps.
            second = labelled.select(*other, F.col("group").alias("group2"), F.col("label").alias("label2"))
            met = settled(met, "group-pairs").join(labelled, ["group", "label"]).join(
                second, ["group2", "label2"]).where(condition)
            pairs = met.select(F.col("class").alias("a"), F.col("class2").alias("b"))
        pairs = settled(pairs, "candidates")
        if not pairs.head(1):
            continue
        new = settled(verified(pairs, rows, nodes, width, percent), "links")
        links = new if links is None else links.unionByName(new)
        if new.head(1):
            labels = components(links)
    return labels


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                     percent: int = PERCENT, rounds: int = ROUNDS, with_key: bool = False) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links);
    ``with_key`` adds ``text_md5``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    seed = 0
    while True:
        found = settled(profiles(rows, width, percent, seed), "profiles")
        clash = found.where("size > 0").groupBy("class").agg(
            F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
        if not clash.head(1):
            break
        seed += 1
    labels = class_labels(found, rows, width, percent, seed, rounds)
    part = found.select("id", "size", "class", "text_md5")
    if labels is not None:
        part = part.join(labels, part["class"] == labels["node"], "left").withColumn(
            "class", F.coalesce("label", "class")).select("id", "size", "class", "text_md5")
    part = settled(part, "members")
    named = settled(part.where("size > 0").groupBy("class").agg(F.min("id").alias("least")), "component-names")
    linked = part.where("size > 0").join(named, "class").select("id", "size", "least", "text_md5")
    blank = part.where("size = 0").select("id", "size", F.col("id").alias("least"), "text_md5")
    return linked.unionByName(blank).select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("least").alias("component_id"),
        *(["text_md5"] if with_key else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the
    row with the smallest id. Rows without id stay where no member has one."""
    found = settled(ngram_components(docs, id_col, text_col, with_key=True), "components")
    own_id, own_key = fresh("_own_id", docs.columns), fresh("_own_key", docs.columns)
    goes = shipped(settled(
        found.where(~F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
        .select(F.col(f"`{id_col}`").alias(own_id), "text_md5").distinct(), "near-copies"))
    marked = docs.withColumn(own_key, F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = marked[f"`{id_col}`"].eqNullSafe(goes[own_id]) & (marked[own_key] == goes["text_md5"])
    return marked.join(goes, same, "left_anti").drop(own_key)
