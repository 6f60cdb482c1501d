"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text is taken as a sequence of units: words of up to UNIT_CHARS characters, the signs of scripts without spaces, and what longer
runs are cut into behind each of some common letters and digits (every UNIT_CHARS characters where none comes), so that units don't
depend on where a run begins. A k-mer of K units is a closed syncmer if the least hash among its inner S-unit substrings stands at its first or last place: about one k-mer in
three. Whether a k-mer is chosen depends on nothing outside it, so a passage keeps its anchors wherever it stands. A text of fewer
than K units, or without a closed syncmer, is one anchor. An anchor is a long: its hash (31 bits) and, below, its place in units.

The fingerprint holds the SKETCH anchors of the least distinct hashes, each with its first place (16 hexadecimal digits
each, ascending). Likeness matches the anchors of two fingerprints by position: of the least SKETCH hashes of their union, it is
the share that both have and that follow each other in the second text as they do in the first. Texts of any length are read
whole; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import free_name

K, S, UNIT_CHARS, SKETCH = 8, 3, 16, 64
# Blocks of scripts without spaces (Thai and Lao, Myanmar, Khmer, Chinese, Japanese).
SIGNS = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u2E80-\\u30FF\\u31F0-\\u31FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
#: What words consist of; letters and digits that longer runs are cut behind.
PLAIN = f"[^\\x20\\x09-\\x0D{SIGNS}]"
CUTS = "[aeiouAEIOU02468]"
UNITS = f"[{SIGNS}]|(?<!{PLAIN}){PLAIN}{{1,{UNIT_CHARS}}}(?!{PLAIN})|{PLAIN}{{0,{UNIT_CHARS - 1}}}?{CUTS}|{PLAIN}{{1,{UNIT_CHARS}}}"
#: Texts of words of at most UNIT_CHARS letters, none of them from here on, have the same units by a simpler pattern.
WORDS, FIRST_SIGN = "[^\\x20\\x09-\\x0D]+", "[\\u0E00-\\x{10FFFF}]"
PLACE_BITS, HASH_MASK, PLACE_MASK = 32, 0x7FFFFFFF, 0xFFFFFFFF


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def unit_hashes(text: Column) -> Column:
    """A hash for each unit of a text (null: none)."""
    t = F.coalesce(text, F.lit(""))
    unbroken = lambda words: F.exists(words, lambda w: F.length(w) > UNIT_CHARS) | F.regexp_like(t, F.lit(FIRST_SIGN))
    units = _let(F.regexp_extract_all(t, F.lit(WORDS), F.lit(0)), lambda words: F.when(unbroken(words), F.regexp_extract_all(t, F.lit(UNITS), F.lit(0))).otherwise(words))
    return F.transform(units, lambda u: F.xxhash64(u))


def anchor_positions(units: Column) -> Column:
    """Positions of the closed syncmers in an array of unit hashes; none in one of fewer than K."""
    inner = F.transform(F.sequence(F.lit(0), F.size(units) - S), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(S)]))
    places = F.sequence(F.lit(0), F.size(units) - K)
    last = K - S
    at_edge = lambda s, i: F.least(F.get(s, i), F.get(s, i + last)) <= F.least(*[F.get(s, i + j) for j in range(1, last)])
    return F.when(F.size(units) >= K, _let(inner, lambda s: F.filter(places, lambda i: at_edge(s, i)))).otherwise(F.array().cast("array<int>"))


def _anchor(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit(HASH_MASK)), PLACE_BITS).bitwiseOR(place.cast("long"))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(PLACE_MASK))


def anchors(units: Column) -> Column:
    """The anchors of an array of unit hashes in order of position; the whole, at place 0, if it has no closed syncmer."""
    each = lambda at: F.transform(at, lambda i: _anchor(F.xxhash64(*[F.get(units, i + j) for j in range(K)]), i))
    whole = F.array(_anchor(F.xxhash64(units), F.lit(0)))
    return _let(anchor_positions(units), lambda at: F.when(F.size(at) > 0, each(at)).otherwise(whole))


def sketch(found: Column) -> Column:
    """The SKETCH anchors of the least distinct hashes, each at its first place."""
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1))))
    return F.slice(_let(F.sort_array(found), first), 1, SKETCH)


def text_sketch(text: Column) -> Column:
    return _let(unit_hashes(text), lambda units: sketch(anchors(units)))


def sketch_hex(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two sketches, which are never empty; null where one is missing."""

    def by_hash(p: Column) -> Column:
        x, y = p["x"], p["y"]
        union = F.slice(F.sort_array(F.array_union(x, y)), 1, SKETCH)
        return _let(F.struct(union.alias("u"), x.alias("x"), y.alias("y")), in_order)

    def in_order(p: Column) -> Column:
        shared = F.array_intersect(F.array_intersect(p["u"], p["x"]), p["y"])
        place = lambda h, hashes, whole: place_of(F.get(whole, F.array_position(hashes, h).cast("int") - 1))
        matched = F.sort_array(F.transform(shared, lambda h: F.struct(place(h, p["x"], a).alias("a"), place(h, p["y"], b).alias("b"))))
        follow = lambda m: F.filter(m, lambda x, i: (i == 0) | (x["b"] > F.get(m, i - 1)["b"]))
        return F.size(_let(matched, follow)) / F.greatest(F.size(p["u"]), F.lit(1))

    both = F.struct(F.transform(a, hash_of).alias("x"), F.transform(b, hash_of).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), _let(both, by_hash))


def fingerprint_documents(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the sketch as array ``<out_col>_sketch`` and as string ``<out_col>``; columns of these names are replaced.

    Null and empty texts share one fingerprint; equal texts have equal ones. Other columns are kept.
    """
    made = docs.withColumn(f"{out_col}_sketch", text_sketch(F.col(text_col)))
    return made.withColumn(out_col, sketch_hex(F.col(f"{out_col}_sketch")))


def positioned_anchors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per anchor: id, position (in units) and hash, for positional matching between documents."""
    each = docs.select(F.col(id_col), F.explode(_let(unit_hashes(F.col(text_col)), anchors)).alias("a"))
    return each.select(F.col(id_col), place_of(F.col("a")).alias("position"), hash_of(F.col("a")).alias("hash"))


def with_next(rows: DataFrame, id_col: str, columns: list[str], buckets: int, derive: tuple[str, Column] | None = None) -> DataFrame:
    """Adds next_<column>: the row's follower by ascending id, the first row's after the last (ties and nulls: see below).

    Ids, of any type that has an order, are cut into ranges of about equal count; each range is ordered by itself in one task, and the first
    row of a range is copied, as a guest, to the end of the range before it. Null ids come first. Rows of one id are
    ordered by the columns. Only the cuts and the first id of each range come to the driver. ``derive`` is a
    column (name, expression) to add first and give next_ too; it is computed once a row. Columns called next_<column> are replaced.
    """
    spark = rows.sparkSession
    bucket_col, first_col, guest_col = (free_name(rows, x) for x in ("bucket", "first", "guest"))
    cuts = _cuts(rows, id_col, buckets) if buckets > 1 else []
    bucket = F.lit(0)
    for low in range(0, len(cuts), 50):  # short sums: long chains of additions are slow to plan
        part = cuts[low : low + 50]
        bucket = bucket + sum(((F.col(id_col) > F.lit(c)).cast("int") for c in part[1:]), (F.col(id_col) > F.lit(part[0])).cast("int"))
    placed = rows.withColumn(bucket_col, F.coalesce(bucket, F.lit(0)))
    edge = F.struct(F.col(id_col).isNotNull().alias("n"), F.col(id_col).alias("i"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    firsts = placed.groupBy(bucket_col).agg(F.min(F.struct(F.col(id_col).isNotNull().alias("n"), F.col(id_col).alias("i"))).alias("m")).orderBy(bucket_col).collect()  # a row per range
    leads = [*columns, derive[0]] if derive else columns
    old = {f"next_{c}".lower() for c in leads}
    kept = [F.col(f"`{c}`") for c in [*rows.columns, *([derive[0]] if derive and derive[0] not in rows.columns else [])] if c.lower() not in old]
    if not firsts:
        rows = rows.withColumn(*derive) if derive else rows
        return rows.select(*kept, *[F.col(c).alias(f"next_{c}") for c in leads])
    used = [r[bucket_col] for r in firsts]
    home = {r[bucket_col]: used[k - 1] for k, r in enumerate(firsts)}
    goes_to = F.create_map(*[F.lit(x) for pair in home.items() for x in pair])
    starts = spark.createDataFrame([(r[bucket_col], r["m"]["i"]) for r in firsts], f"{bucket_col} int, {first_col} {rows.schema[id_col].dataType.simpleString()}")
    candidates = placed.join(F.broadcast(starts), (placed[bucket_col] == starts[bucket_col]) & placed[id_col].eqNullSafe(starts[first_col])).select(placed["*"])
    guests = candidates.groupBy(bucket_col).agg(F.min(edge).alias("e")).select(
        F.element_at(goes_to, F.col(bucket_col)).alias(bucket_col), F.col("e.i").alias(id_col), *[F.col(f"e.c{k}").alias(c) for k, c in enumerate(columns)], F.lit(True).alias(guest_col)
    )
    extra = [c for c in rows.columns if c not in (id_col, *columns)]
    every = placed.withColumn(guest_col, F.lit(False)).unionByName(guests.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra]))
    if derive:
        every = every.withColumn(*derive)
    w = Window.partitionBy(bucket_col).orderBy(guest_col, F.col(id_col).asc_nulls_first(), *columns)
    follow = every.withColumns({f"{bucket_col}_{k}": F.lead(c).over(w) for k, c in enumerate(leads)}).where(~F.col(guest_col))
    return follow.select(*kept, *[F.col(f"{bucket_col}_{k}").alias(f"next_{c}") for k, c in enumerate(leads)])


def _cuts(rows: DataFrame, id_col: str, buckets: int) -> list:
    """Ascending ids between ranges of about equal count: quantiles of numbers, else of a sample of at most 100 ids a range by hash."""
    if isinstance(rows.schema[id_col].dataType, T.NumericType):
        found = rows.select(F.percentile_approx(id_col, [i / buckets for i in range(1, buckets)], 10_000).alias("c")).first()["c"]
        return sorted(set(found or []))
    sample = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i")).limit(100 * buckets).orderBy("i").collect()
    return sorted({sample[len(sample) * i // buckets]["i"] for i in range(1, buckets)}) if sample else []
