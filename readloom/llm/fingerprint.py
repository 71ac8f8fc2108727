"""Operator 7: document fingerprints from closed syncmers.

A text's units are its words; a word of over LONGEST characters, and what is written in scripts without spaces, is cut
into single characters, so that where one unit ends depends on nothing but the few characters around.  A k-mer of K
units is an anchor (a closed syncmer) if the least of its units' hashes is that of its first or its last unit.  Whether
a k-mer is chosen depends on nothing outside of it: texts that share a stretch share the stretch's anchors, wherever it
stands, and of any K - 1 k-mers in a row one is chosen.

The fingerprint lists all anchors in order of position: how many units after the one before (the first: after the
text's beginning; at most K - 1), as one digit, and a 32-bit hash in eight hexadecimal digits.  The likeness of two
fingerprints is positional: of the anchors that both have (each at its first place) those are matched whose shift, the
difference of their places in the two texts, is that of the matched anchor before or after it in the first text too.
So phrases that two texts share by chance, here and there, don't count, and passages that were moved as a whole do.
Likeness is the share of the matched among all distinct anchors of both.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm import sharding
from readloom.llm.common import table

K = 4
RANGE_ROWS = 2000
LONGEST = 16
#: The blocks of scripts that are written without spaces (Thai and Lao, Tibetan, Myanmar, Khmer, and from
#: the radicals and kana to the ideographs, their compatibility forms and their supplementary planes).
UNSPACED = r"฀-໿ༀ-࿿က-႟ក-៿⺀-꓏豈-﫿\x{20000}-\x{3FFFF}"
WORD = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"


def unit_hashes(text: Column) -> Column:
    """The hashes of a text's units, in order."""
    one = lambda w: F.array(F.xxhash64(w))
    single = lambda w: F.transform(F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0)), lambda c: F.xxhash64(c))
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(F.length(w) <= LONGEST, one(w)).otherwise(single(w))))


def positions(h: Column, k: int = K) -> Column:
    """The first unit of every closed syncmer among the unit hashes ``h``; none if there are fewer than ``k`` units."""
    starts = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.array().cast("array<int>"))
    inner = [lambda i, j=j: F.get(h, i + j) for j in range(1, k - 1)]
    least = lambda i: F.least(*[f(i) for f in inner]) if len(inner) > 1 else inner[0](i)
    return F.filter(starts, lambda i: F.least(F.get(h, i), F.get(h, i + (k - 1))) <= least(i))


def anchors(h: Column, k: int = K) -> Column:
    """array of (a: hash, p: first unit) of all anchors by position; fewer than ``k`` units, but not none, are one anchor."""
    chosen = F.transform(positions(h, k), lambda i: F.struct(F.hash(*[F.get(h, i + j) for j in range(k)]).alias("a"), i.alias("p")))
    whole = F.when(F.size(h) > 0, F.array(F.struct(F.hash(h).alias("a"), F.lit(0).alias("p")))).otherwise(F.array().cast("array<struct<a:int,p:int>>"))
    return F.when(F.size(h) >= k, chosen).otherwise(whole)


def positioned(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, anchor, pos): every anchor with the number of its first unit, for aligning documents by position."""
    h = docs.select(F.col(key).alias("doc_id"), unit_hashes(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    return h.select("doc_id", F.explode(anchors(F.col("h"), k)).alias("x")).select("doc_id", F.col("x.a").alias("anchor"), F.col("x.p").alias("pos"))


def offsets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, shift, shared): how many anchors two positioned tables' documents share at each shift of position.

    An anchor that a document has at several places counts at each of them.
    """
    one = lambda df, name: df.select(F.col("doc_id").alias(name), "anchor", F.col("pos").alias(f"pos_{name}"))
    return one(a, "a").join(one(b, "b"), "anchor").groupBy("a", "b", (F.col("pos_b") - F.col("pos_a")).alias("shift")).agg(F.count("*").alias("shared"))


def shown(found: str) -> Column:
    """The fingerprint of these anchors: nine digits for each, empty for a text without words."""
    gap = lambda x, i: F.when(i == 0, x["p"]).otherwise(x["p"] - F.get(F.col(found), i - 1)["p"])
    return F.array_join(F.transform(found, lambda x, i: F.concat(gap(x, i).cast("string"), F.lower(F.lpad(F.hex(x["a"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))), "")


def _first_only(ordered: str) -> Column:
    """Of each distinct anchor the first place; from anchors in order of hash and place."""
    return F.filter(ordered, lambda x, i: (i == 0) | (F.get(F.col(ordered), i - 1)["a"] != x["a"]))


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0 to 1, the share of all distinct anchors of ``a`` and ``b`` that are matched.

    ``a`` and ``b``: distinct anchors in order of their hashes.  An only shared anchor is matched; two texts without any
    anchor are alike.
    """
    side = lambda c, n: F.transform(c, lambda x: F.struct(x["a"].alias("a"), F.lit(n).alias("s"), x["p"].alias("p")))
    keep = rows.columns
    rows = rows.select(*keep, F.sort_array(F.concat(side(a, 0), side(b, 1))).alias("__both"))
    pair = lambda x, i: F.struct(x["p"].alias("p"), (F.get(F.col("__both"), i + 1)["p"] - x["p"]).alias("shift"))
    paired = F.transform("__both", lambda x, i: F.when((x["s"] == 0) & (F.get(F.col("__both"), i + 1)["a"] == x["a"]), pair(x, i)))
    rows = rows.select(*keep, F.sort_array(F.filter(paired, lambda x: x.isNotNull())).alias("__pairs"))
    near = lambda x, i: (i > 0) & (F.get(F.col("__pairs"), i - 1)["shift"] == x["shift"]) | F.coalesce(F.get(F.col("__pairs"), i + 1)["shift"] == x["shift"], F.lit(False))
    rows = rows.select(*keep, F.when(F.size("__pairs") == 1, F.lit(1)).otherwise(F.size(F.filter("__pairs", near))).alias("__n"), (F.size(a) + F.size(b) - F.size("__pairs")).alias("__of"))
    return rows.select(*keep, F.when(F.col("__of") == 0, F.lit(1.0)).otherwise(F.col("__n") / F.greatest("__of", F.lit(1))).alias(name))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), each row in the range ``part``, ready for a window ``within(part)``.

    Rows are ordered by doc_id, null first, and by a hash of the text where it repeats.  Sampled boundaries part them
    into ranges; a range's last row needs the next range's first, which is a boundary: such rows, and for the last range
    the very first row, are also dealt to the range before, as ``guest``.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(sharding.FIRST)).alias("h"), F.xxhash64("text").alias("id"), F.lit(1.0).alias("size"))
    rows, first = keyed.agg(F.count("*"), F.min(F.struct("h", "id"))).first()
    parts = max(1, min(sharding.MOST_RANGES, rows // RANGE_ROWS + 1))
    bounds = sharding.quantiles(sharding.draw(keyed, parts * sharding.OVERSAMPLING, rows), parts) if rows else []
    here = sharding.range_of(bounds)
    dealt = keyed.withColumn("here", here)
    guest_of = F.lit(None).cast("int")
    if bounds:
        value = lambda i: F.get(F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>"), F.col("here") - 1)
        guest_of = F.when((F.col("here") > 0) & (value(0) == F.col("h")) & (value(1) == F.col("id")), F.col("here") - 1)
    wrap = F.when((F.col("h") == first[0]) & (F.col("id") == first[1]), F.lit(len(bounds))) if rows else F.lit(None).cast("int")
    places = F.array(F.struct(F.col("here").alias("part"), F.lit(0).alias("guest")), F.struct(guest_of.alias("part"), F.lit(1).alias("guest")), F.struct(wrap.alias("part"), F.lit(2).alias("guest")))
    return dealt.select("doc_id", "text", "h", "id", F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("p")).select("doc_id", "text", "h", "id", "p.part", "p.guest")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row.

    The edited text has its last quarter (rounded down) replaced by as many first characters, or all, of the next
    document's; the last document's next is the first.  Rows that repeat a doc_id follow one another by a hash of the
    text.  A null text is empty; an empty one, or one of white space, has an empty fingerprint, and two of these are
    alike.  Other columns are not read; an empty table gives no rows.
    """
    rows = with_next(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    within = Window.partitionBy("part").orderBy("guest", "h", "id")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(within))
    rows = rows.select("doc_id", "part", "guest", "h", "id", n.cast("long").alias("n_chars"), unit_hashes(F.col("text")).alias("units"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter)).alias("edited"))
    rows = rows.select("doc_id", "part", "guest", "h", "id", "n_chars", "edited", anchors(F.col("units")).alias("found"))
    rows = rows.select("doc_id", "part", "guest", "h", "id", "n_chars", "edited", shown("found").alias("fingerprint"), F.sort_array("found").alias("found"))
    rows = rows.select("doc_id", "part", "guest", "h", "id", "n_chars", "edited", "fingerprint", _first_only("found").alias("own"))
    rows = rows.withColumn("following", F.lead("own").over(within)).filter("guest = 0")
    head = ["doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint"]
    rows = rows.select(*head, "own", "following", unit_hashes(F.col("edited")).alias("units"))
    head = ["doc_id", "n_chars", "edited_sha256", "fingerprint"]
    rows = rows.select(*head, "own", "following", anchors(F.col("units")).alias("found"))
    rows = rows.select(*head, "own", "following", shown("found").alias("edited_fingerprint"), F.sort_array("found").alias("found"))
    rows = rows.select(*head, "edited_fingerprint", "own", "following", _first_only("found").alias("other"))
    rows = with_likeness(with_likeness(rows, "own", "other", "near_edited"), "own", "following", "near_next")
    return rows.select(*head, "edited_fingerprint", "near_edited", "near_next")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return fingerprints(table(spark, sf_dir, "documents"))
