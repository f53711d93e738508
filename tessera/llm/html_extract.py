"""Main text of web pages: page structure and a suffix array of each host.

A page is read tag by tag into blocks of three zones: content (inside an article
or main element), ruled out (menus, page headers, footers, sidebars, notices, adverts,
forms, comments, by element, role and class, wherever they stand; scripts, styles and
templates are not even read), and the rest, of which structure says nothing.

Host suffix array: the whole token streams of all pages of a host, what stands outside the
content first and then the content, are concatenated; the suffix array brings equal
substrings together; runs of ``MIN_WORDS`` words that at least max(``MIN_PAGES``,
``MIN_SHARE`` of the pages) distinct pages hold outside their content are boilerplate.  The
words that such runs cover, anywhere on a page, are to go; unique runs stay.

Check by structure, after it: of a page with a content element that element is the text and
whole, so words of it that the array would cut are restored (and counted, ``n_restored``),
since articles may be repeated word for word on other pages of their host, and what stands
outside goes; of a page without one, the blocks of the third zone are the text, as the array
left them.  Every row comes out of the array's pass.  (The README has the figures of
repetition alone.)

Distinct pages: equal pages are one page.  So are near copies (of the whole page, content
too), whose signatures, minima of the hashes of their runs, agree in half of the numbers,
as they do where half of their distinct runs are shared (found by bands, also by a chain),
so that what repeats only since its page does is kept; a page that would be left
without a word keeps all of them.

Scale: pages of a large host (by letters of html, before any is read) are dealt to groups of
a bounded number of words, each with a suffix array of its own.  What stands outside the
content is dealt first, equal pages once for each task, and the groups' (run, page class)
pairs are counted over the whole host before anything is removed, so a large host is judged
like a small one, in many tasks; then the whole pages are dealt at random, so copies of one
page are no one task's.  A class is known across groups by the four numbers of the signature
that most of its pages share.  Runs are counted by 64-bit hashes of their words.

Blocks: character references are decoded (HTML rules, also without a semicolon where
HTML allows it), white space becomes one space, blocks are trimmed and joined by one
line feed, empty blocks are left out.  A line break element is white space; cells of a
table row are one block.

Edge cases: null or empty html gives an empty text; broken, unclosed and cut-off markup
is read as far as it goes; a null url is a host of its own; repeated rows are extracted
each on its own; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL_ROWS, Scratch, need, prepare, texts_of
from tessera.llm.decontaminate import suffix_array

MIN_WORDS, MIN_SHARE, MIN_PAGES = 6, 0.1, 3
#: Words of a host that one suffix array holds.
GROUP_WORDS = 1 << 20
#: Letters of markup and text for each word, by which hosts are measured before pages are read.
WORD_LETTERS = 8
#: Numbers of a page's signature; those of a band that find near copies; those that name a class.
MINIMA, BAND_ROWS, NAMED = 48, 3, 4
#: Streams that a task knows as read before.
KNOWN_STREAMS = 500_000
#: Pages that share this part of their signatures are near copies.
NEAR_COPY = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text of another kind, up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption".split())
SPACES = frozenset("br td th".split())
#: Elements that are never main text.
LEFT_OUT = frozenset("head nav footer aside form menu dialog button select svg math object audio video canvas datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what is not main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies respond disqus discussion widget search pagination pager skip toolbar masthead".split())
CONTENT_ROLES = frozenset(("main", "article"))
_CLASS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def marked(attrs: dict[str, str]) -> bool:
    """Whether an element's attributes mark it as not main text."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    return any(w.lower() in MARKS for k in ("class", "id") for name in attrs.get(k, "").split() for w in _CLASS.findall(name))


def read_page(page: str) -> tuple[list[str], list[str], list[str], bool]:
    """(blocks of content, of which structure says nothing, ruled out; whether content was marked)."""
    stack: list[tuple[str, bool, bool]] = []  # element, left out, content
    out = content = found = False
    held: list[str] = []
    blocks: tuple[list[str], list[str], list[str]] = ([], [], [])

    def close_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks[2 if out else 0 if content else 1].append(text)
            held.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith(("<!", "<?")):
                held.append(html.unescape(m[0]))
            continue
        name = name.lower()
        if m[1]:  # end tag
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                if name in BLOCKS:
                    close_block()
                continue
            if name in BLOCKS or (out, content) != (stack[depth - 1][1:] if depth else (False, False)):
                close_block()
            elif name in SPACES:
                held.append(" ")
            del stack[depth:]
            out, content = stack[-1][1:] if stack else (False, False)
            continue
        if name in RAW:  # up to its end tag; whatever it holds is left out
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            if name in SPACES:
                held.append(" ")
            elif name in BLOCKS:
                close_block()
            continue
        if name in BLOCKS:
            close_block()
            # A block ends an open paragraph; a list item ends the one before.
            ends = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "option": "option"}.get(name)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == ends:
                    del stack[i:]
                    out, content = stack[-1][1:] if stack else (False, False)
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif name in SPACES:
            held.append(" ")
        attrs = attributes(m[3]) if "=" in m[3] or "hidden" in m[3] else {}
        was = out, content
        if name == "article" or name == "main" or attrs.get("role", "").lower() in CONTENT_ROLES or attrs.get("itemprop") == "articleBody":
            if not out and not (content and marked(attrs)):
                content = found = True
            else:
                out = True
        elif name in LEFT_OUT or (name == "header" and not content) or (attrs and name not in ("html", "body") and marked(attrs)):
            out = True
        if (out, content) != was:
            now, (out, content) = (out, content), was
            close_block()
            out, content = now
        stack.append((name, out, content))
    close_block()
    return *blocks, found


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return x ^ (x >> np.uint64(29))


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(names: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words (by their hashes) from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        out = _mixed(out * _PRIME + names[starts + k])
    return out


def signature(blocks: list[str], n: int = MIN_WORDS) -> np.ndarray:
    """MINIMA of the run hashes of a page, each in an order of its own; of a page without a
    run, hashes of the page."""
    words = " ".join(blocks).split()
    runs = run_hashes(word_hashes(words), np.arange(len(words) - n + 1), n) if len(words) >= n else np.array([xxhash.xxh64_intdigest(" ".join(words))], np.uint64)
    salts = (np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]
    return (np.concatenate([_mixed(runs ^ s).min(axis=1, initial=1 << 63) for s in np.split(salts, 4)]) >> np.uint64(33)).astype(np.int32)


def page_classes(signatures: np.ndarray, share: float = NEAR_COPY) -> np.ndarray:
    """A name for each page (rows of MINIMA numbers), equal for near copies, also by a chain
    of them: by each of the first NAMED numbers, the one that most of the class's pages have."""
    n = len(signatures)
    head = np.arange(n)

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for band in range(0, MINIMA if n else 0, BAND_ROWS):
        keys = signatures[:, band : band + BAND_ROWS]
        order = np.lexsort(keys.T)
        new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
        start = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        # Each page of a bucket is compared with the bucket's first and with the one before.
        for p, q in ((order, start), (order[1:], order[:-1])):
            inside = p != q if len(p) == n else ~new[1:]
            p, q = p[inside], q[inside]
            near = (signatures[p] == signatures[q]).sum(axis=1) >= share * MINIMA
            for x, y in zip(p[near].tolist(), q[near].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    head[max(x, y)] = min(x, y)
    root = [find(p) for p in range(n)]
    name = np.zeros(n, np.uint64)
    for k in range(NAMED):
        votes: dict[int, Counter] = {}
        for r, x in zip(root, signatures[:, k].tolist(), strict=True):
            votes.setdefault(r, Counter())[x] += 1
        most = {r: min(c, key=lambda x, c=c: (-c[x], x)) for r, c in votes.items()}
        name = _mixed(name * _PRIME + np.array([most[r] for r in root], np.int64).view(np.uint64))
    return name


class HostRuns:
    """The suffix array of the whole streams of distinct pages, and their runs of min_words words.

    outside: how many of each page's first blocks lie outside its article (by default all);
    only runs of these blocks are evidence of boilerplate.
    """

    def __init__(self, pages: list[list[str]], min_words: int = MIN_WORDS, outside: list[int] | None = None):
        self.pages, self.min_words = pages, min_words
        lines = [" ".join(blocks).split() for blocks in pages]
        self.words: list[str] = []
        for line in lines:
            self.words += line
            self.words.append("")  # a symbol of its own ends each page's stream
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(self.words))}
        ends = np.cumsum(np.array([len(line) + 1 for line in lines], np.int64)) - 1
        self.begin = np.concatenate((np.zeros(1, np.int64), ends + 1))[: len(pages)]
        owner = np.repeat(np.arange(len(pages)), ends + 1 - self.begin)
        line = np.fromiter(map(vocabulary.__getitem__, self.words), np.int64, len(self.words))
        names = word_hashes(vocabulary)[line] if len(line) else np.zeros(0, np.uint64)
        line += len(pages) + 1
        line[ends] = len(pages) - np.arange(len(pages))
        n = len(line)
        # Ranks of as many words at once as a number holds: fewer rounds, the same order.
        ranks, base, k = line, int(line.max(initial=0)) + 1, 1
        while n and base ** (k + 1) < 1 << 62:
            ranks = ranks * base + np.append(line[k:], np.zeros(min(k, n), np.int64))
            k += 1
        sa = suffix_array(ranks)
        same = np.ones(max(n - 1, 0), bool)  # neighbours in the suffix array that share min_words words
        for k in range(min_words):
            a, b = sa[:-1] + k, sa[1:] + k
            same &= (a < n) & (b < n)
            same &= line[np.minimum(a, n - 1)] == line[np.minimum(b, n - 1)]
        group = np.concatenate(([0], np.cumsum(~same)))[:n]
        whole = ends[owner[sa]] - sa >= min_words if n else np.zeros(0, bool)  # the run lies in its page
        #: Starts of whole runs in the line, and the number of each one's run.
        self.starts = sa[whole]
        first, self.run = np.unique(group[whole], return_index=True, return_inverse=True)[1:]
        self.hash = run_hashes(names, self.starts[first], min_words)
        self.size, self.owner, self.ends = n, owner, ends
        #: Where the words outside the article end.
        self.article = ends if outside is None else self.begin + np.array([sum(len(x.split()) for x in blocks[:o]) for blocks, o in zip(pages, outside, strict=True)], np.int64)
        #: Distinct (run, page) pairs outside articles, by page.
        out = self.starts + min_words <= self.article[owner[self.starts]] if n else whole
        pairs = np.unique(owner[self.starts[out]] * max(len(first), 1) + self.run[out])
        self.pair_page, self.pair_run = np.divmod(pairs, max(len(first), 1))

    def evidence(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run hash, class) of each distinct pair, and the distinct classes; of the pages that
        have words outside an article."""
        some, alike = self.article > self.begin, np.zeros(len(self.pages), np.uint64)
        alike[some] = page_classes(signatures[some])
        pairs = np.unique(np.stack((self.hash[self.pair_run], alike[self.pair_page])), axis=1)
        return pairs[0], pairs[1], np.unique(alike[some])

    def covered(self, boilerplate: np.ndarray) -> np.ndarray:
        """Whether boilerplate runs (hashes) cover each place of the line."""
        starts = self.starts[np.isin(self.hash, boilerplate)[self.run]] if len(self.hash) else self.starts
        marks = np.zeros(self.size + self.min_words + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + self.min_words, -1)
        return np.cumsum(marks)[: self.size] > 0

    def checked(self, boilerplate: np.ndarray, own: list[int | None], outside: list[int]) -> tuple[list[str], list[int]]:
        """The text of each page: its words without those that boilerplate covers, checked by
        structure; and how many words the check restored.

        own: how many first blocks are the text of a page without an article.  Where it is
        None, the blocks from ``outside`` on are the article, which is restored whole.
        """
        covered = np.concatenate(([0], np.cumsum(self.covered(boilerplate))))
        kept = self.kept(boilerplate, [blocks[: n or 0] for blocks, n in zip(self.pages, own, strict=True)])
        texts = ["\n".join(blocks[o:] if n is None else k) for blocks, n, o, k in zip(self.pages, own, outside, kept, strict=True)]
        return texts, np.where([n is None for n in own], covered[self.ends] - covered[self.article], 0).tolist() if texts else []

    def kept(self, boilerplate: np.ndarray, pages: list[list[str]] | None = None) -> list[list[str]]:
        """The blocks of each page (or its first ones, as given) without the words that
        boilerplate runs (hashes) cover; a page of such words alone keeps its blocks."""
        pages = self.pages if pages is None else pages
        covered = self.covered(boilerplate)
        touched = np.unique(self.owner[covered]) if self.size else covered
        out = [list(blocks) for blocks in pages]
        for p in touched.tolist():
            blocks, out[p], at = pages[p], [], int(self.begin[p])
            for block in blocks:
                n = len(block.split())
                mine, text = covered[at : at + n], self.words[at : at + n]
                edge = np.diff(np.concatenate(([0], mine.astype(np.int8), [0])))
                kept, last = [], 0
                for b, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
                    if e - b >= self.min_words or e - b == n:  # a neighbour's boilerplate does not take a few words here
                        kept += text[last:b]
                        last = e
                if kept := kept + text[last:]:
                    out[p].append(" ".join(kept))
                at += n
            out[p] = out[p] or blocks
        return out


def frequent(run: np.ndarray, classes: int, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> np.ndarray:
    """The run hashes that enough distinct classes hold; run: one hash for each (run, class)."""
    names, n = np.unique(run, return_counts=True)
    return names[n >= max(min_pages, min_share * classes)]


def unique_runs(pages: list[list[str]]) -> list[list[str]]:
    """The blocks of each page of a host without the words that repeated runs cover."""
    places: dict[tuple[str, ...], int] = {}
    place = [places.setdefault(tuple(blocks), len(places)) for blocks in pages]
    host = HostRuns([list(blocks) for blocks in places])
    run, _, classes = host.evidence(np.stack([signature(list(blocks)) for blocks in places]))
    kept = host.kept(frequent(run, len(classes)))
    return [kept[p] for p in place]


def extract_text(pages: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """page_id, url, text, n_chars of every page, and n_restored: words of its article that
    the host's boilerplate runs cover and structure restored."""
    spark = pages.sparkSession
    prepare(spark)
    pages = need(pages, "page_id", "url", "html").withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit("")))
    kind = pages.schema["page_id"].dataType.simpleString()

    def pages_of(b: pa.RecordBatch):
        """(blocks outside the article, its blocks, how many of the former are the text if it has none, a number of all this)."""
        for raw in texts_of(b.column("html")):
            content, other, out, found = read_page(raw.decode("utf-8")) if raw else ([], [], [], True)
            # Own blocks first: they are the text that is still to be decided on.
            stream, own = other + out, None if found else len(other)
            yield stream, content, own, xxhash.xxh64_intdigest("\0".join(("\n".join(content), "\n".join(stream), str(own)))) - (1 << 63)

    def parse(batches):
        for b in batches:
            read = list(pages_of(b))
            columns = [pa.array([own for _, _, own, _ in read], pa.int32()), pa.array([len(s) for s, _, _, _ in read], pa.int32()), pa.array([n for _, _, _, n in read], pa.int64()), pa.array([s + c for s, c, _, _ in read], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), *columns], ["page_id", "url", "host", "own", "outside", "stream_no", "stream"])

    def parse_outside(batches):
        """What stands outside the articles, once for each distinct page that a task has read."""
        known: set[tuple[str, int]] = set()
        for b in batches:
            rows = []
            for (stream, content, _, number), host in zip(pages_of(b), b.column("host").to_pylist(), strict=True):
                if stream and (host, number) not in known:
                    if len(known) >= KNOWN_STREAMS:
                        known.clear()
                    known.add((host, number))
                    rows.append((host, number, signature(content + stream).tobytes(), stream))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string())), strict=True)], ["host", "stream_no", "sign", "stream"])

    def distinct(part: pa.Table) -> pa.Table:
        """One row a page of those that are equal."""
        return part.take(pa.array(np.unique(part.column("stream_no").to_numpy(), return_index=True)[1]))

    def evidence(key, part: pa.Table) -> pa.Table:
        """The (kind 1) runs and (kind 2) classes of a part of a large host."""
        part = distinct(part)
        run, alike, classes = HostRuns(part.column("stream").to_pylist()).evidence(np.frombuffer(b"".join(part.column("sign").to_pylist()), np.int32).reshape(-1, MINIMA))
        n, m = len(run), len(classes)
        return pa.table({"kind": pa.array([1] * n + [2] * m, pa.int32()), "host": pa.array([key[0].as_py()] * (n + m), pa.string()), "class": pa.array(np.concatenate((alike, classes)).view(np.int64)), "run": pa.array(np.concatenate((run, np.zeros(m, np.uint64))).view(np.int64))})

    def decide(part: pa.Table, runs: pa.Table | None = None) -> pa.Table:
        """The texts of a host's pages by its suffix array; runs are those of a large host."""
        one = distinct(part)
        own, outside, streams = (one.column(c).to_pylist() for c in ("own", "outside", "stream"))
        host = HostRuns(streams, outside=outside)
        if not len(one):
            boilerplate = np.zeros(0, np.uint64)
        elif one.column("parts")[0].as_py() == 1:
            signs = [signature(s[o:] + s[:o]) if o else np.zeros(MINIMA, np.int32) for s, o in zip(streams, outside, strict=True)]
            run, _, classes = host.evidence(np.stack(signs))
            boilerplate = frequent(run, len(classes))
        else:
            boilerplate = runs.column("run").to_numpy().view(np.uint64)
        texts, restored = host.checked(boilerplate, own, outside)
        at = np.searchsorted(one.column("stream_no").to_numpy(), part.column("stream_no").to_numpy())
        return pa.table([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()).take(pa.array(at)), pa.array(restored, pa.int64()).take(pa.array(at))], names=["page_id", "url", "text", "n_restored"])

    scratch = Scratch(spark, "pages")
    letters = F.sum(F.coalesce(F.length("html"), F.lit(0)))
    large = scratch.save(pages.groupBy("host").agg(F.ceil(letters / (group_words * WORD_LETTERS)).alias("parts")).where("parts > 1"), "large")
    some = not large.isEmpty()
    parts = F.broadcast(large) if large.count() <= SMALL_ROWS else large
    read = pages.mapInArrow(parse, f"page_id {kind}, url string, host string, own int, outside int, stream_no long, stream array<string>")
    # A page of any number of copies: rows are dealt at random, not by what they hold.
    dealt = read.join(parts, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.floor(F.rand(5) * F.col("parts"))) if some else read.withColumn("parts", F.lit(1).cast("long")).withColumn("part", F.lit(0).cast("long"))
    schema = f"page_id {kind}, url string, text string, n_restored long"
    groups = dealt.groupBy("host", "part")
    if some:
        streams = pages.join(parts.select("host"), "host", "left_semi").mapInArrow(parse_outside, "host string, stream_no long, sign binary, stream array<string>")
        streams = streams.join(parts, "host").withColumn("part", F.pmod("stream_no", "parts"))
        told = scratch.save(streams.groupBy("host", "part").applyInArrow(lambda key, part: evidence(key, part), "kind int, host string, class long, run long"), "told")
        totals = told.where("kind = 2").groupBy("host").agg(F.countDistinct("class").alias("classes"))
        counted = told.where("kind = 1").select("host", "run", "class").distinct().groupBy("host", "run").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
        runs = scratch.save(counted.join(totals, "host").where(F.col("n") >= F.greatest(F.lit(float(MIN_PAGES)), MIN_SHARE * F.col("classes"))).select("host", "run"), "runs")
        scratch.drop("told")
        runs = runs.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        out = groups.cogroup(runs.select("host", "part", "run").groupBy("host", "part")).applyInArrow(lambda part, runs: decide(part, runs), schema)
    else:
        out = groups.applyInArrow(lambda part: decide(part), schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_restored")
