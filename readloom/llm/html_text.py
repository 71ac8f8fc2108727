"""Operator 6: main text of web pages, by structure and by a suffix array for each host.

1. Every page is cut into blocks.  What stands in an article or main element is the article; what stands in menus,
   headers, footers, sidebars, forms, scripts, notices, adverts and comments, by element or by class, id or role, is
   chrome; the rest is open.
2. The tokens outside articles of a host's pages are joined into one stream; its suffixes, sorted by their first
   ``MIN_RUN`` tokens, show which runs stand on more than one page.  A large host's are sorted in groups, which exchange
   what they count of each run.
3. A page with an article is its article.  On a page without one, runs that recur on pages that otherwise differ are
   boilerplate: the open blocks that mostly consist of them lose them, and the rest is the text.

A page differs otherwise than by a run if it has an article, or if at least a tenth of its open tokens stand in runs
of at most a third as many distinct pages.  Copies, and copies with a few words changed, have no such rest; they prove
nothing of one another.

Repetition alone can't be the rule: articles repeat too, whole or in passages, and an advert can be unique.  So within
an article nothing is removed for being repeated.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.common import arrow_map, table, written

MIN_RUN = 8  # tokens; a power of two
GROUP_BYTES = 4 << 20  # distinct text outside articles of a host that is sorted at once; a larger host is dealt over several groups
BROADCAST_HOSTS = 100_000
LEAST_PAGES, LEAST_SHARE = 3, 0.01  # boilerplate stands on so many otherwise different pages, and on that share of a host's distinct ones
OWN = 10  # a page's own tokens are at least one in so many
RARER = 3  # and stand on that many times fewer pages

#: Elements whose text is no text, to their closing tag.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title", "head"}
#: Elements that are never part of an article.
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
#: Elements that don't end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in a class, id or role that mark chrome.
_marks = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad-?(?:box|slot|unit|banner)\w*|advert\w*|adsense|adsbygoogle|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notices?|popup\w*|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|complementary|contentinfo|footer\w*|masthead"
    r"|comments?|comment-?\w+|disqus|replies|respond|share|sharing|social|newsletter|subscribe|signup|login|related|recommended|widget|toolbar|pagination|pager|skip-?link)(?:$|[\s_-])",
    re.I,
)
_named = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_tag = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[A-Za-z/][^>]*(?:>|\Z)""", re.S)
#: Elements whose end tags may be left out, and what ends them where it opens.
_block = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDED_BY = {"p": _block, "li": {"li"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Of these, what articles of its own can stand in without being the page's.
_others = re.compile(r"comment|disqus|replies|respond|related|recommended|widget", re.I)
#: Elements whose class says something of the page, not of themselves.
PAGE = {"html", "body", "main"}
_closing: dict[str, re.Pattern] = {}

ARTICLE, OPEN, OUTSIDE = 0, 1, 2


def blocks(page: str) -> Iterator[tuple[int, str]]:
    """(ARTICLE, OPEN or OUTSIDE, text) of a page's blocks, in order; white space is one space, references decoded."""
    at, parts, role = 0, [], OPEN
    article = 0  # article and main elements that are open
    held, inner = 0, 0  # elements, and articles of these, that are open inside of a skipped one whose end tag may be left out
    skip, nested, wrapper = "", 0, False  # the chrome element that is open, how deep in elements of its name, and whether it may wrap a page

    def block():
        nonlocal parts
        text = " ".join("".join(parts).split()) if parts else ""
        parts = []
        return text

    end = len(page)
    while at < end:
        m = _tag.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if not (m[3] and name in ("span", "a", "label") and _marked(m[3])):
                continue
        elif text := block():
            yield role, text
        if skip in ENDED_BY:
            # the next of its kind, or the end of what it stands in, ends it too
            if m[1]:
                ended = not inner if name in ("article", "main") else name == "body" or (name != skip and name not in INLINE and name not in ENDED_BY and not held)
                held -= name != skip and name not in INLINE and name not in ENDED_BY and held > 0
                inner -= name in ("article", "main") and inner > 0
            else:
                ended = name in ENDED_BY[skip] and not held
                held += not ended and name not in INLINE and name not in ENDED_BY and name not in VOID and name not in RAW and not m[3].endswith("/")
                inner += not ended and name in ("article", "main")
            if ended:
                skip, nested = "", 0
        if m[1]:
            if name in ("article", "main") and not skip:
                article = max(0, article - 1)
            elif skip == name:
                nested -= 1
                if not nested:
                    if text := block():
                        yield role, text
                    skip = ""
        elif name in RAW and not m[3].endswith("/"):
            if name not in _closing:
                _closing[name] = re.compile(rf"</{name}\s*/?>" if name != "head" else r"</head\s*>|(?=<body)", re.I)
            close = _closing[name].search(page, at)
            at = close.end() if close else (at if name == "head" else end)
        elif skip and name in ("article", "main") and wrapper and not _others.search(m[3]):
            # what holds the article wraps the page, whatever its class says
            skip, nested, article = "", 0, article + 1
        elif skip:
            nested += name == skip
        elif name not in VOID and not m[3].endswith("/") and (name in CHROME or (m[3] and name not in PAGE and _marked(m[3], name == "article"))):
            if text := block():
                yield role, text
            skip, nested, held, inner = name, 1, 0, 0
            wrapper = name in ("form", "div", "section", "table", "center") and not _others.search(m[3])
        elif name in ("article", "main"):
            article += 1
        role = OUTSIDE if skip else ARTICLE if article else OPEN
    if text := block():
        yield role, text


def _marked(attributes: str, article: bool = False) -> bool:
    """Whether a class, id or role marks chrome; an article's only if it marks another one than the page's."""
    return any((_others if article else _marks).search(v.strip("\"'")) for v in _named.findall(attributes))


class Runs:
    """The runs of ``run`` tokens on some pages, numbered from 0 by a suffix array of the pages' joined tokens.

    The pages are joined with a separator of its own after each; prefix doubling sorts the suffixes by their first
    ``run`` tokens.  ``at``: the number of the run that begins at each token of the stream, -1 where the page ends
    before it does.  ``on``: (run, page), once for each page a run stands on.
    """

    def __init__(self, pages: list[list[str]], run: int = MIN_RUN):
        self.numbers: dict[str, int] = {}
        self.run, self.lengths = run, np.array([len(p) for p in pages], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.stream = np.empty(int(self.lengths.sum()) + len(pages), np.int64)
        page = np.repeat(np.arange(len(pages)), self.lengths + 1)
        for i, (at, tokens) in enumerate(zip(self.starts.tolist(), pages)):
            self.stream[at : at + len(tokens)] = [self.numbers.setdefault(t, len(self.numbers)) for t in tokens]
            self.stream[at + len(tokens)] = -1 - i
        rank = np.unique(self.stream, return_inverse=True)[1]
        width = 1
        while width < run:
            after = np.full(len(rank), -1, np.int64)
            after[:-width or None] = rank[width:]
            rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1]
            width *= 2
        whole = np.arange(len(self.stream)) + run <= (self.starts + self.lengths)[page] if len(pages) else np.zeros(0, bool)
        self.at = np.full(len(self.stream), -1, np.int64)
        found, self.first, self.at[whole] = np.unique(rank[whole], return_index=True, return_inverse=True)
        self.first = np.flatnonzero(whole)[self.first]
        self.count = len(found)
        pairs = np.unique(self.at[whole] * max(1, len(pages)) + page[whole])
        self.on = pairs // max(1, len(pages)), pairs % max(1, len(pages))

    def total(self, weights: np.ndarray) -> np.ndarray:
        """For each run the sum of its pages' ``weights``."""
        return np.bincount(self.on[0], weights[self.on[1]], self.count).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each run's tokens, the same in every group."""
        token = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in self.numbers], np.uint64)
        out = np.zeros(self.count, np.uint64)
        for j in range(self.run):
            out = out * np.uint64(0x9E3779B97F4A7C15) + token[self.stream[self.first + j]]
        return out.view(np.int64)

    def commonest(self, counts: np.ndarray) -> list[np.ndarray]:
        """For each page's tokens the largest of ``counts`` over the runs that cover it, 0 where none does."""
        most = np.zeros(len(self.stream) + self.run, np.int64)
        here = np.where(self.at >= 0, counts[self.at], 0) if self.count else np.zeros(len(self.stream), np.int64)
        for j in range(self.run):
            np.maximum(most[j : j + len(here)], here, out=most[j : j + len(here)])
        return [most[s : s + n] for s, n in zip(self.starts.tolist(), self.lengths.tolist())]

    def covered(self, runs: np.ndarray) -> list[np.ndarray]:
        """For each page's tokens, which are covered by a run that ``runs`` is true for."""
        begins = np.zeros(len(self.stream) + 1, np.int64)
        hit = np.flatnonzero(self.at >= 0)
        hit = hit[runs[self.at[hit]]]
        begins[hit] += 1
        np.add.at(begins, hit + self.run, -1)
        covered = np.cumsum(begins)[:-1] > 0
        return [covered[s : s + n] for s, n in zip(self.starts.tolist(), self.lengths.tolist())]


def repeated(pages: list[list[str]], run: int = MIN_RUN) -> list[np.ndarray]:
    """For each page's tokens, which are covered by a run of ``run`` tokens that stands on another page too."""
    runs = Runs(pages, run)
    return runs.covered(runs.total(np.ones(len(pages), np.int64)) > 1)


def main_text(docs: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_outside, n_repeated; one row for each row of ``docs``.

    A null page is empty and has the text "".  ``n_outside``: tokens outside the article; ``n_repeated``: those that
    another page of the host repeats.  A null url is a host of its own.  Repeated rows are pages of their own; other
    columns are not read.

    Pages of a host with the same tokens outside their articles are one stream, which is decided once.  A large host's
    streams are dealt over several groups; what each group counts of its runs is summed over the host, and goes back
    to the groups of the runs that stand in several.
    """
    import zstandard

    spark = docs.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = docs.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(page), F.lit("")).alias("html"))

    def parse(texts: list[str]) -> Iterator[tuple[str | None, str, str, bytes, bytes | None]]:
        for p in texts:
            found: tuple[list, list, list] = ([], [], [])
            for role, text in blocks(p):
                found[role].append(text)
            main, open_, outside = " ".join(found[ARTICLE]) if found[ARTICLE] else None, "\n".join(found[OPEN]), " ".join(found[OUTSIDE])
            stream = hashlib.blake2b(f"{main is None}\0{len(open_)}\0{open_}{outside}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            article = None if main is None else hashlib.blake2b(main.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            yield main, open_, outside, stream, article

    def streams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                parsed = list(parse(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_pydict({"host": part.column(0), "stream": pa.array([p[3] for p in parsed], pa.binary()), "article": pa.array([p[4] for p in parsed], pa.binary()), "open": pa.array([p[1] for p in parsed], pa.string()), "outside": pa.array([p[2] for p in parsed], pa.string())})

    def articles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                parsed = list(parse(part.column(3).to_pylist()))
                main = [None if p[0] is None else c.compress(p[0].encode("utf-8", "surrogatepass")) for p in parsed]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "host": part.column(2), "stream": pa.array([p[3] for p in parsed], pa.binary()), "main": pa.array(main, pa.binary())})

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
                if group and group[-1][:2] != row[:2]:
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def of(group: list[tuple]) -> tuple[Runs, np.ndarray, np.ndarray]:
        """The runs of a group's streams, and on how many pages and distinct pages of the group each stands."""
        runs = Runs([g[4].split() + g[5].split() for g in group])
        return runs, runs.total(np.array([g[6] for g in group], np.int64)), runs.total(np.array([g[7] for g in group], np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches):
            runs, pages, distinct = of(group)
            yield pa.RecordBatch.from_pydict({"host": pa.array([group[0][0]] * runs.count, pa.string()), "salt": pa.array(np.full(runs.count, group[0][1], np.int32)), "run": runs.hashes(), "pages": pages, "distinct": distinct})

    def supported(runs: Runs, group: list[tuple], distinct: np.ndarray) -> np.ndarray:
        """For each run, on how many distinct pages of the group it stands that otherwise differ."""
        rest = np.zeros(len(group), np.int64)
        for i, (g, counts) in enumerate(zip(group, runs.commonest(distinct))):
            n = len(g[4].split())
            rest[i] = np.sort(counts[:n])[(n + OWN - 1) // OWN - 1] if n else np.iinfo(np.int64).max // RARER
        run, page = runs.on
        bare, own = np.array([g[3] for g in group], bool), np.array([g[7] for g in group], np.int64)
        return np.bincount(run, np.where(bare[page], RARER * rest[page] <= distinct[run], own[page]), runs.count).astype(np.int64)

    def supported_large(group: pa.Table, known: pa.Table) -> pa.Table:
        host, salt = known.column("host"), known.column("salt")
        if not known.num_rows:
            return pa.table({"host": host, "salt": salt, **{c: pa.array([], pa.int64()) for c in ("run", "pages", "distinct", "support")}})
        rows, known = rows_of(group), sorted_by_run(known)
        runs, _, distinct = of(rows)
        support = supported(runs, rows, with_known(runs, distinct, known, "distinct"))
        hashes = runs.hashes()
        order = np.argsort(hashes)
        return pa.table({"host": host, "salt": salt, **{c: known[c] for c in ("run", "pages", "distinct")}, "support": support[order[np.searchsorted(hashes[order], known["run"])]]})

    def decided(group: list[tuple], known: dict[str, np.ndarray]) -> pa.Table:
        runs, pages, distinct = of(group)
        covers = runs.covered(with_known(runs, pages, known, "pages") > 1)
        texts: list[str | None] = [None] * len(group)
        if any(g[3] for g in group):
            support = with_known(runs, supported(runs, group, with_known(runs, distinct, known, "distinct")), known, "support")
            least = max(LEAST_PAGES, LEAST_SHARE * (group[0][8] or sum(g[7] for g in group)))
            for i, (g, common) in enumerate(zip(group, runs.covered(support >= least))):
                if g[3]:
                    kept, at = [], 0
                    for block in g[4].split("\n"):
                        tokens = block.split()
                        cover = common[at : at + len(tokens)]
                        kept += [t for t, c in zip(tokens, cover.tolist()) if not c] if 2 * cover.sum() > len(tokens) else tokens
                        at += len(tokens)
                    texts[i] = " ".join(kept)
        return pa.table({"host": pa.array([g[0] for g in group], pa.string()), "stream": pa.array([g[2] for g in group], pa.binary()), "open_text": pa.array(texts, pa.string()), "n_outside": pa.array(list(map(len, covers)), pa.int64()), "n_repeated": pa.array([int(c.sum()) for c in covers], pa.int64())})

    def with_known(runs: Runs, own: np.ndarray, known: dict[str, np.ndarray], name: str) -> np.ndarray:
        """A group's counts of its runs, with the host's for those that stand in other groups too."""
        if known and len(known["run"]):
            hashes = runs.hashes()
            at = np.minimum(np.searchsorted(known["run"], hashes), len(known["run"]) - 1)
            own = np.where(known["run"][at] == hashes, known[name][at], own)
        return own

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches):
            yield from decided(group, {}).to_batches()

    def decide_large(group: pa.Table, known: pa.Table) -> pa.Table:
        return decided(rows_of(group), sorted_by_run(known))

    def rows_of(group: pa.Table) -> list[tuple]:
        return sorted(zip(*(group.column(c).to_pylist() for c in range(group.num_columns))), key=lambda g: g[2])

    def sorted_by_run(known: pa.Table) -> dict[str, np.ndarray]:
        known = known.sort_by("run")
        return {name: known.column(name).to_numpy() for name in known.column_names if name not in ("host", "salt")}

    parsed = rows.select("host", "html").transform(arrow_map, streams_of, "host string, stream binary, article binary, open string, outside string")
    texts = [F.first("open").alias("open"), F.first("outside").alias("outside")]
    articles = parsed.groupBy("host", "stream", "article").agg(*texts, F.count("*").alias("pages"))
    streams = written(articles.groupBy("host", "stream").agg(F.first(F.col("article").isNull()).alias("bare"), *texts, F.sum("pages").alias("pages"), F.count("*").alias("distinct")), "streams")
    hosts = streams.groupBy("host").agg(F.sum(F.octet_length("open") + F.octet_length("outside")).alias("bytes"), F.sum("distinct").alias("of"), F.max("bare").alias("some_bare"))
    large = written(hosts.filter(F.col("bytes") > GROUP_BYTES).select("host", F.ceil(F.col("bytes") / GROUP_BYTES).alias("groups"), "of", "some_bare"), "large")
    n_large, parts = large.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_large = lambda df, some, how: df.join(F.broadcast(some) if n_large <= BROADCAST_HOSTS else some, "host", how)

    def dealt(some: DataFrame, how: str) -> DataFrame:
        inner = how == "inner"
        salt = F.pmod(F.xxhash64("stream"), F.col("groups")).cast("int") if inner else F.lit(0)
        return with_large(streams, some, how).select("host", salt.alias("salt"), "stream", "bare", "open", "outside", "pages", "distinct", (F.col("of") if inner else F.lit(None).cast("long")).alias("of")).repartition(parts, "host", "salt")

    shape = "host string, stream binary, open_text string, n_outside long, n_repeated long"
    counts = "host string, salt int, run long, pages long, distinct long"
    done = dealt(large, "left_anti").sortWithinPartitions("host", "salt").transform(arrow_map, decide, shape)
    if n_large:
        own = dealt(large, "inner").sortWithinPartitions("host", "salt").transform(arrow_map, counted, counts)
        run = Window.partitionBy("host", "run")  # at most one row for each of the host's groups
        summed = lambda name: F.sum(name).over(run).alias(name)
        known = own.select("host", "salt", "run", summed("pages"), summed("distinct"), F.count("*").over(run).alias("in")).filter("in > 1").drop("in")
        bare = large.filter("some_bare")
        if bare.isEmpty():
            known = known.withColumn("support", F.lit(0).cast("long"))
        else:
            known = written(known, "runs")
            support = dealt(bare, "inner").groupBy("host", "salt").cogroup(with_large(known, bare, "left_semi").groupBy("host", "salt")).applyInArrow(supported_large, counts + ", support long")
            others = with_large(known, bare, "left_anti").withColumn("support", F.lit(0).cast("long"))
            known = support.select("host", "salt", "run", "pages", "distinct", summed("support")).union(others)
        done = done.union(dealt(large, "inner").groupBy("host", "salt").cogroup(known.groupBy("host", "salt")).applyInArrow(decide_large, shape))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [o if m is None else d.decompress(m).decode("utf-8", "surrogatepass") for m, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "n_outside": batch.column(4), "n_repeated": batch.column(5)})

    found = rows.transform(arrow_map, articles_of, "page_id long, url string, host string, stream binary, main binary")
    out = found.join(done, ["host", "stream"], "left").select("page_id", "url", "main", "open_text", "n_outside", "n_repeated")
    return out.transform(arrow_map, joined, "page_id long, url string, text string, n_chars long, n_outside long, n_repeated long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))
