"""Operator 8: benchmark decontamination by a distributed positional inverted index.

The index holds, for the terms that tests can be looked up by, every posting (term, document, position) of the
training texts.  A test window is looked up from its rarest terms: the positions of each, less the term's offset in
the window, are the windows' possible starts, and only starts that the lists of all looked-up terms agree on go on.
The window's other words are then compared at these starts.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.common import ascii_lower, broadcast_if_small, table, written

WINDOW = 13
LISTS = 2  # posting lists that are intersected for a window, the rarest terms'
BROADCAST_TERMS = 200_000  # rows of terms, lookups, windows or item sets that may be broadcast; beyond, joins shuffle
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """The words of a text column: after lower-casing A-Z, runs of a-z, 0-9 and what is not ASCII."""
    parts = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAPS)
    return F.filter(parts, lambda w: w != "")


def id_of(window: str) -> Column:
    """The 32 bytes that stand for a window: the SHA-256 of its words, which hold no spaces, joined by one."""
    return F.unhex(F.sha2(F.array_join(window, " "), 256))


def windows_of(items: DataFrame, key: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(item, window: array of words) of every item; an item of fewer than ``n`` words, but not none, is one window."""
    words = items.select(F.col(key).cast("string").alias("item"), words_of(text).alias("words")).filter("size(words) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (n - 1)))).alias("i")
    return words.select("item", "words", starts).select("item", F.slice("words", F.col("i"), F.lit(n)).alias("window")).distinct()


class PositionalIndex:
    """Postings (term, doc, pos) of a corpus for the terms of some tests, as a table in the shared folder.

    ``terms``: term, df (documents that hold it).  ``postings`` can be joined by anything that asks for these terms.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text"):
        self.docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        self.terms = terms
        self.postings: DataFrame | None = None
        self.stored: DataFrame | None = None

    def frequencies(self) -> DataFrame:
        """(term, df) over all documents; a term that no document has is missing."""
        rows = self.docs.select(F.explode(F.array_distinct(words_of("text"))).alias("term"))
        terms = written(self.terms.select("term").distinct(), "terms")
        if terms.count() <= BROADCAST_TERMS:
            return rows.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
        # counted before they are joined: no task gets all the rows of a common word
        return rows.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi")

    def store(self, terms: DataFrame) -> DataFrame:
        """Writes and returns the postings of ``terms``."""
        self.stored = written(terms.select("term").distinct(), "terms")  # so that the join can deal a common word over tasks
        rows = self.docs.filter("doc is not null").select("doc", F.posexplode(words_of("text")).alias("pos", "term"))
        self.postings = written(rows.join(broadcast_if_small(self.stored, BROADCAST_TERMS), "term").select("term", "doc", "pos"), "postings")
        return self.postings

    def phrase_starts(self, lookups: DataFrame) -> DataFrame:
        """(window_id, doc, start) on which the lists of a window's terms agree.

        ``lookups``: window_id, rank (0: the rarest), term, off (the term's place in the window), lists (how many ranks
        the window has).  The rarest term's list comes first; each further list is intersected after its offset is
        taken away.
        """
        lists = self.postings.join(broadcast_if_small(lookups, BROADCAST_TERMS), "term")
        starts = lists.select("window_id", "doc", (F.col("pos") - F.col("off")).alias("start"), "rank", "lists").filter("start >= 0")
        found = starts.filter("rank = 0").drop("rank")
        for rank in range(1, LISTS):
            other = starts.filter(F.col("rank") == rank).select("window_id", "doc", "start")
            done = found.filter(F.col("lists") <= rank)
            found = found.filter(F.col("lists") > rank).join(other, ["window_id", "doc", "start"], "left_semi").union(done)
        return found.select("window_id", "doc", "start")

    def near(self, terms: list[str], within: int) -> DataFrame:
        """(doc, pos) where a stretch of at most ``within`` words that begins with one of ``terms`` holds them all.

        KeyError if one of ``terms`` was not among those that ``store`` was asked for: its postings aren't known.
        """
        if self.stored is None:
            raise KeyError("no postings are stored")
        known = {t.term for t in self.stored.filter(F.col("term").isin(terms)).collect()}
        if missing := sorted(set(terms) - known):
            raise KeyError(f"no postings are stored for {', '.join(missing)}")
        mine = self.postings.filter(F.col("term").isin(terms))
        ahead = Window.partitionBy("doc").orderBy("pos").rangeBetween(0, within - 1)
        return mine.withColumn("held", F.size(F.collect_set("term").over(ahead))).filter(F.col("held") == len(set(terms))).select("doc", "pos").distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items: one row for each row of ``docs``.

    A null text has no words; a null item text or one without words has no window, and a null item_id stands for no
    item.  Rows that repeat a doc_id are each judged by their own text; a null doc_id is never hit.  Other columns are
    not read.  Contaminated: n_hit > 0 and ``share`` * n_hit >= n_words.
    """
    windows = written(windows_of(items.filter(F.col(item_key).isNotNull()), item_key, item_text, n), "windows")
    phrases = windows.select("window").distinct().select(id_of("window").alias("window_id"), "window")
    terms = phrases.select(F.explode("window").alias("term")).distinct()
    index = PositionalIndex(docs, terms, key, text)
    df = written(index.frequencies(), "frequencies")

    placed = phrases.select("window_id", F.posexplode("window").alias("off", "term")).join(df, "term", "left")
    # a window with a term that the corpus lacks occurs nowhere; of a term that repeats, the first place will do
    whole = placed.groupBy("window_id").agg(F.count("df").alias("k"), F.count("*").alias("all")).filter("k = all").select("window_id")
    one = placed.join(whole, "window_id").groupBy("window_id", "term", "df").agg(F.min("off").alias("off"))
    rarest = Window.partitionBy("window_id").orderBy("df", "term")  # at most n rows
    ranked = one.withColumn("rank", F.row_number().over(rarest) - 1).filter(F.col("rank") < LISTS)
    lookups = ranked.withColumn("lists", F.count("*").over(Window.partitionBy("window_id"))).select("window_id", "rank", "term", "off", "lists")
    lookups = written(lookups, "lookups")
    index.store(lookups)
    starts = index.phrase_starts(lookups)

    # a document's possible starts travel to it, each with its window's length and SHA-256, which the words there must have
    lengths = phrases.select("window_id", F.size("window").cast("byte").alias("len") if n < 128 else F.size("window").alias("len"))
    asked = starts.join(broadcast_if_small(written(lengths, "lengths"), BROADCAST_TERMS), "window_id").groupBy("doc").agg(F.collect_list(F.struct("start", "len", "window_id")).alias("asked"))
    base = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    both = base.join(asked, "doc", "left").select("doc", words_of("text").alias("words"), "asked")
    # slice() gives fewer words where the text ends before the window does; their hash is another
    right = lambda c: F.unhex(F.sha2(F.array_join(F.slice(F.col("words"), c["start"] + 1, c["len"].cast("int")), " "), 256)) == c["window_id"]
    hits = F.array_sort(F.transform(F.filter("asked", right), lambda c: F.struct(c["start"].alias("a"), (c["start"] + c["len"].cast("int")).alias("b"), c["window_id"].alias("w"))))
    step = lambda acc, c: F.struct((acc["n"] + F.greatest(F.lit(0), c["b"] - F.greatest(c["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], c["b"]).alias("end"))
    judged = both.select("doc", F.size("words").cast("long").alias("n_words"), F.coalesce(hits, F.array().cast("array<struct<a:int,b:int,w:binary>>")).alias("hits"))
    judged = judged.select("doc", "n_words", F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["w"]))).alias("found"))
    judged = written(judged.withColumn("set", F.sha2(F.array_join(F.transform("found", lambda w: F.hex(w)), ","), 256)), "judged")

    # the items of the windows that were found, by set of windows: few sets, however many documents have them
    named = windows.select(id_of("window").alias("window_id"), "item")
    sets = judged.filter("size(found) > 0").select("set", "found").distinct().select("set", F.explode("found").alias("window_id"))
    items_of = written(sets.join(named, "window_id").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")), "items")
    # most documents have none: they don't meet in one task for the sake of an empty set; those of one passage neither
    none = judged.filter("size(found) = 0").withColumn("items", F.lit(None).cast("array<string>"))
    judged = judged.filter("size(found) > 0").join(broadcast_if_small(items_of, BROADCAST_TERMS // 10), "set", "left").unionByName(none)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return judged.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        listed.alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that are contaminated by ``items``; rows without an id stay."""
    bad = contamination(docs, items, key, text).filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[key].cast("long") == F.col("__bad"), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: ``documents`` against ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
