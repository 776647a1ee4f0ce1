"""Near-duplicate records: a multi-index Hamming join over b-bit signatures, then the exact sets.

Each text's set of word shingles gets a signature of ``SYMBOLS`` symbols of ``BITS`` bits, the
low bits of its least hashes under as many hash functions; two sets of similarity s agree in each
symbol with probability s or more. Signatures are split into chunks of ``CHUNK`` symbols. By
pigeonhole two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have a
chunk with at most ``ERRORS`` errors; enumerating the allowed errors of a chunk (which symbols
are left out) gives keys, and such signatures share one for certain. Pairs that share a key are
then compared by their whole shingle sets.

With 40 symbols in 10 chunks of 4 and two errors each, all pairs within 29 differing symbols are
met; a pair at similarity 0.5 lies beyond with probability 0.0011, at 0.8 below 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.components import connected_components
from codeweft.runtime import broadcast_if_small, materialise

SYMBOLS, BITS, CHUNK, ERRORS = 40, 16, 4, 2
#: Classes that are looked at for crowded keys (at least this share of them), and classes of a key
#: beyond which its comparisons are cut into blocks of so many; all spread the work and change no result.
PROBED, PROBED_SHARE, CROWD = 5_000, 0.001, 2_048
_KEPT = list(combinations(range(CHUNK), CHUNK - ERRORS))
_LOW_WORDS = -(-SYMBOLS // 16)
_LOW = [f"_low{i}" for i in range(_LOW_WORDS)]


def words_of(text: Column) -> Column:
    """The runs of a-z and 0-9 of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of the distinct runs of ``n`` words; empty where there are fewer words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)])))


def _chunk_signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures, packed as one 64-bit number for each chunk."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    addends = rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
    for batch in it:
        sets = batch.column(1)
        hashes = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = (sets.offsets.to_numpy()[:-1] - sets.offsets[0].as_py()).astype(np.int64)
        packed = np.zeros((batch.num_rows, SYMBOLS // CHUNK), np.uint64)
        low = np.zeros((batch.num_rows, _LOW_WORDS), np.uint64)
        if batch.num_rows:
            for s in range(SYMBOLS):
                mixed = (hashes ^ addends[s]) * factors[s]
                mixed ^= mixed >> np.uint64(29)
                mixed *= factors[-1 - s]
                least = np.minimum.reduceat(mixed, starts)
                symbol = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                packed[:, s // CHUNK] |= symbol << np.uint64(BITS * (s % CHUNK))
                low[:, s // 16] |= (symbol & np.uint64(15)) << np.uint64(4 * (s % 16))
        flat = pa.array(packed.view(np.int64).ravel())
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (SYMBOLS // CHUNK))
        lows = [pa.array(low[:, i].copy().view(np.int64)) for i in range(_LOW_WORDS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat), *lows], names=["_class", "_chunks", *_LOW])


def _agreeing_low_bits() -> Column:
    """In how many symbols the low four bits of two signatures agree."""
    agree = F.lit(0)
    for i, name in enumerate(_LOW):
        apart = F.col(f"a.{name}").bitwiseXOR(F.col(f"b.{name}"))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 1))
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, 2)).bitwiseAND(0x1111111111111111)
        agree = agree + (min(16, SYMBOLS - 16 * i) - F.bit_count(apart))
    return agree


def _symbol(chunk: Column, at: int) -> Column:
    return F.shiftrightunsigned(chunk, BITS * at).bitwiseAND(2**BITS - 1)


def _keys(classes: DataFrame, kind: str) -> DataFrame:
    """Every class once for each chunk and each choice of the chunk's symbols that may be wrong."""
    signed = classes.select("_class", "_shingles").mapInArrow(_chunk_signatures, f"_class {kind}, _chunks array<bigint>, " + ", ".join(f"{x} bigint" for x in _LOW))
    chunks = signed.select("_class", *_LOW, F.posexplode("_chunks").alias("_no", "_chunk"))
    enumerated = F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), F.xxhash64("_no", F.lit(v), *[_symbol(F.col("_chunk"), i) for i in keep]).alias("key")) for v, keep in enumerate(_KEPT)
    ]))
    return chunks.select("_class", "_chunk", *_LOW, enumerated.alias("_k")).select("_class", "_chunk", *_LOW, F.col("_k.v").alias("_v"), F.col("_k.key").alias("_key"))


def _sides(classes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of the key join; where a key is crowded its rows are dealt into blocks that all meet."""
    n = classes.count()
    share = min(1.0, max(PROBED / max(n, 1), PROBED_SHARE))
    keyed, drawn = _keys(classes, kind), F.pmod(F.xxhash64("_class"), F.lit(1_000_000)) < int(share * 1_000_000)
    probed = _keys(classes.where(drawn), kind).groupBy("_key", "_v").count()
    blocks = F.ceil(F.col("count") / (share * CROWD)).cast("int")
    crowds = materialise(probed.where(F.col("count") > max(CROWD * share, 8)).select("_key", "_v", blocks.alias("_blocks")))
    if not crowds.head(1):
        both = keyed.withColumn("_i", F.lit(0)).withColumn("_j", F.lit(0))
        return both.alias("a"), both.alias("b")
    known = keyed.join(broadcast_if_small(crowds), ["_key", "_v"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own, all_of = F.pmod(F.xxhash64("_class", F.lit(7)), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return known.withColumn("_i", own).withColumn("_j", all_of).alias("a"), known.withColumn("_j", own).withColumn("_i", all_of).alias("b")


def _candidates(classes: DataFrame, kind: str) -> DataFrame:
    """Distinct pairs of classes whose signatures share a key."""
    a, b = _sides(classes, kind)
    block = (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))
    apart = F.col("a._chunk").bitwiseXOR(F.col("b._chunk"))
    # Of the keys that a pair shares in a chunk only the first counts, so it comes once a chunk.
    first = F.lit(False)
    for v, keep in enumerate(_KEPT):
        rest = [i for i in range(max(keep)) if i not in keep]
        own = F.col("a._v") == v
        for i in rest:
            own = own & (_symbol(apart, i) != 0)
        first = first | own
    # The keys meet more pairs than they promise: those beyond the signature distance go at once,
    # told by the low bits that travel with the keys (equal symbols have equal low bits).
    close = _agreeing_low_bits() >= SYMBOLS - (SYMBOLS // CHUNK * (ERRORS + 1) - 1)
    pairs = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a._v") == F.col("b._v")) & block & (F.col("a._class") < F.col("b._class")) & first & close)
    return pairs.select(F.col("a._class").alias("_a"), F.col("b._class").alias("_b")).distinct()


def near_duplicates(df: DataFrame, key: str, *texts: str, shingle: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts, and the links between classes that are similar enough.

    Returns ``members`` (``key``, class_id) with one row per key, and ``links``
    (class_a, class_b, similarity) between class representatives, class_a < class_b: the texts
    (joined by a blank, null as empty, lower case, runs of a-z and 0-9) whose sets of ``shingle``
    consecutive words have a Jaccard similarity of at least ``threshold``. A class is named by its
    smallest key; its members have equal words.

    Defined cases: null keys take no part; repeated keys count once (their smallest text);
    texts with fewer words than a shingle are in a class but have no links, not even to
    copies; texts of any length are compared whole; an empty table gives empty results; other
    columns are ignored. Copies are compared once, so a hot group of copies costs one row.
    """
    joined = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), joined.alias("_text"))
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text")).select("_id", words_of(F.col("_text")).alias("_words"))
    kind = df.schema[key].dataType.simpleString()
    hashed = materialise(rows.select("_id", F.sha2(F.array_join("_words", " "), 256).alias("_same"), shingles_of(F.col("_words"), shingle).alias("_shingles")))
    least = hashed.groupBy("_same").agg(F.min("_id").alias("_class"))
    members = materialise(hashed.select("_id", "_same").join(least, "_same").select(F.col("_id").alias(key), F.col("_class").alias("class_id")))
    classes = hashed.where(F.size("_shingles") > 0).join(least, "_same").where("_id = _class").select("_class", "_shingles")
    classes = materialise(classes)

    pairs = _candidates(classes, kind)
    one = classes.select(F.col("_class").alias("_a"), F.col("_shingles").alias("_of_a"))
    two = classes.select(F.col("_class").alias("_b"), F.col("_shingles").alias("_of_b"))
    compared = pairs.join(one, "_a").join(two, "_b").withColumn("_both", F.size(F.array_intersect("_of_a", "_of_b")))
    similarity = F.col("_both") / (F.size("_of_a") + F.size("_of_b") - F.col("_both"))
    links = compared.select(F.col("_a").alias("class_a"), F.col("_b").alias("class_b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return members, materialise(links)


def pairs_of_records(df: DataFrame, key: str, members: DataFrame, links: DataFrame, shingled: Column | None = None) -> DataFrame:
    """All linked pairs of records (record_a < record_b): members of linked classes, and copies."""
    one = members.select(F.col("class_id").alias("class_a"), F.col(key).alias("_a"))
    two = members.select(F.col("class_id").alias("class_b"), F.col(key).alias("_b"))
    across = links.select("class_a", "class_b").join(one, "class_a").join(two, "class_b").select("_a", "_b")
    within = one.join(two, (F.col("class_a") == F.col("class_b")) & (F.col("_a") < F.col("_b")))
    if shingled is not None:
        within = within.join(df.where(shingled).select(F.col(key).alias("_a")).distinct(), "_a", "left_semi")
    both = across.unionByName(within.select("_a", "_b"))
    return both.select(F.least("_a", "_b").alias("record_a"), F.greatest("_a", "_b").alias("record_b"))


def groups_of_records(key: str, members: DataFrame, links: DataFrame) -> DataFrame:
    """(``key``, class_id, n_links, group_id): a group holds all classes joined by links."""
    ends = links.select(F.col("class_a").alias("class_id")).unionByName(links.select(F.col("class_b").alias("class_id")))
    degree = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    component = connected_components(links, "class_a", "class_b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    joined = members.join(degree, "class_id", "left").join(component, "class_id", "left")
    return joined.select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
