"""Main text of web pages, with a suffix array of each host's pages for what markup leaves open.

Markup decides first: blocks in menus, headers, footers, sidebars, notices, adverts, forms and comments go, blocks
in an article or main element stay. All other text of a page without such an element is judged by repetition: the
word streams of a host's pages are laid one after another, their suffixes are sorted, and runs of ``RUN`` words or
more that start suffixes of two different pages are boilerplate. Covered words go, unique runs stay. Repetition
never takes words out of an article, since copies of an article are still that page's text.

A host too large for one task is dealt into groups of pages by hash. What its pages share across groups is found by
counting: hashes of runs of ``RUN`` words, of which only those that may stand on a page without an article or main
element are sent, are grouped by host, and those of two different pages are joined back to the pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradegrain.llm.common import WordIds, as_long, columns_of, shingle_hashes, slices, split_count, store
from tradegrain.llm.url_rules import split_url

RUN = 8  # words of the shortest boilerplate, a power of two
GROUP_CHARS = 4_000_000  # characters of html a group of pages has at most on average
BITMAP_BITS = 24
MAX_SENT_HOSTS = 50_000  # large hosts that are broadcast at most

DROP, KEEP, OPEN = "0", "1", "2"
_JOIN = "\x1f"  # between blocks; white space, so never inside one

# Names of elements and of what their class, id or role says.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg math xmp noembed object canvas".split())
_CHROME = set("nav footer aside form button select dialog menu head fieldset datalist".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img picture audio video".split()
)
_CONTENT_TAGS = {"article", "main"}
_CONTENT_ROLES = {"main", "article"}
_CHROME_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Parts of a class or id name, cut at "-", "_" and changes to upper case.
_CHROME_PARTS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsored sponsor promo promos "
    "promotion cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations newsletter subscribe signup popup modal overlay widget login masthead toolbar pagination pager teaser "
    "sharebar addthis".split()
)
_CHROME_NAMES = set("side-bar skip-link skip-links searchform search-form".split())
_STATE_PARTS = set("has no with without is not hide show".split())  # such a name tells a state, not what the element is
_TITLE_PARTS = set("article entry post content title section story".split())  # headers of these hold the title
_OWN_CLOSERS = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_SCOPES = set("ul ol dl table article main section div body td th aside nav footer header form blockquote".split())
_ENDS_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul figure details".split()
)

# A quote counts only after "=", as browsers read tags. Nothing here is tried twice, so no pattern is slow on odd markup.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|=(?!\s*+[\"'])|[^>=])*+)>")
_OPENS = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _RAW}
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_chrome(value: str, tag: str, inside: bool) -> bool:
    """Whether one of the names in a class or id is that of a menu, header, advert, comment and the like.

    Articles carry their subjects in longer names, so only names of one part count there.
    """
    for word in value.split():
        name = _HUMP.sub("-", word).lower()
        parts = [part for part in re.split(r"[-_]+", name) if part]
        if not parts or parts[0] in _STATE_PARTS or (tag == "article" and len(parts) > 1):
            continue
        if name in _CHROME_NAMES or not _CHROME_PARTS.isdisjoint(parts):
            return True
        if "header" in parts and not inside and _TITLE_PARTS.isdisjoint(parts):
            return True
    return False


def _says(attributes: str, tag: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is chrome, whether it is so by class or id alone, and whether it holds the main content."""
    chrome = tag in _CHROME or (tag == "header" and not inside)
    content = tag in _CONTENT_TAGS
    named = False
    if not attributes.strip(" /"):
        return chrome, named, content
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            named |= tag not in ("html", "body", "main") and _is_chrome(value, tag, inside)
            continue
        value = value.lower()
        if name == "role":
            chrome |= value in _CHROME_ROLES
            content |= value in _CONTENT_ROLES
        elif name == "itemprop":
            content |= value == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            chrome = True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            chrome = True
    return chrome or named, named and not chrome, content


class _Open:
    """The open elements: (tag, within chrome, within content), and where each tag and each scope stands."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, chrome: bool, content: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, chrome, content))

    def last(self, tag: str) -> int:
        """Where the tag is open nearest, -1 if nowhere."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def cut(self, to: int) -> None:
        for tag, _, _ in self.stack[to:]:
            self.places[tag].pop()
        while self.scopes and self.scopes[-1] >= to:
            self.scopes.pop()
        del self.stack[to:]

    def state(self, at: int) -> tuple[bool, bool]:
        return self.stack[at][1:] if at >= 0 else (False, False)


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(state, text) of each block in page order; text has single spaces, blocks without text are left out.

    On a page with a main element that has text, articles beside it are no main content. A ``<`` that no ``>``
    follows is text; a tag whose quoted value never ends runs to the end of the page. Time grows with the length
    of the page, whatever its markup.
    """
    found: list[tuple[str, str]] = []
    within_main: list[bool] = []
    opened = _Open()
    held: list[str] = []
    chrome = content = False

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((DROP if chrome else KEEP if content else OPEN, text))
                within_main.append(mains > 0)

    def pop(to: int) -> None:
        nonlocal chrome, content, mains
        gone = opened.stack[to:]
        if any(tag not in _INLINE for tag, _, _ in gone) or opened.state(to - 1) != (chrome, content):
            close()
        opened.cut(to)
        mains = len(opened.places.get("main", ()))
        chrome, content = opened.state(to - 1)

    text = page or ""
    at = mains = 0
    last = text.rfind(">")
    while at < len(text):
        if text[at] != "<":
            end = text.find("<", at)
            end = len(text) if end < 0 else end
            held.append(text[at:end])
            at = end
            continue
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            at = len(text) if end < 0 else end + 3
            continue
        if at > last or not _OPENS.match(text, at):
            held.append("<")
            at += 1
            continue
        if text[at + 1] in "!?":
            at = text.find(">", at) + 1
            continue
        token = _TAG.match(text, at)
        if token is None:
            break
        at = token.end()
        end, name, attributes = token.groups()
        tag = name.lower()
        if end:
            place = opened.last(tag)
            if place >= 0:
                pop(place)
            elif tag not in _INLINE:
                close()
            continue
        if tag in _RAW:
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            over = _RAW_END[tag].search(text, at)
            at = over.end() if over else len(text)
            held.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                close()
            elif tag != "wbr":
                held.append(" ")
            continue
        if tag in _ENDS_P or tag in _OWN_CLOSERS:
            ends = _OWN_CLOSERS.get(tag, {"p"}) | ({"p"} if tag in _ENDS_P else set())
            place = max(opened.last(t) for t in ends)
            # The nearest of these ends, unless a scope lies above it.
            if place >= 0 and not (opened.scopes and opened.scopes[-1] > place):
                pop(place)
        is_chrome, by_name, is_content = _says(attributes, tag, content)
        if by_name and tag in _INLINE and max(opened.last("pre"), opened.last("code")) >= 0:
            is_chrome = False  # colours of program text, where "comment" is a kind of token
        state = (chrome or is_chrome, content or is_content)
        if tag not in _INLINE or state != (chrome, content):
            close()
        opened.push(tag, *state)
        mains = len(opened.places.get("main", ()))
        chrome, content = state
    close()
    if any(state == KEEP and inside for (state, _), inside in zip(found, within_main, strict=True)):
        found = [(OPEN if s == KEEP and not inside else s, t) for (s, t), inside in zip(found, within_main, strict=True)]
    return found


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes, sorted by their first ``depth`` words (a power of two), and each start's rank."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.full(len(rank), -1, dtype=np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def covered(ids: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Whether each word of the stream lies in a run of ``run`` words that stands on two different pages."""
    out = np.zeros(len(ids), dtype=bool)
    if len(ids) <= run:
        return out
    order, rank = suffix_order(ids, run)
    ranks, pages = rank[order], page[order]
    starts = np.flatnonzero(np.diff(ranks, prepend=-1))
    group = np.cumsum(np.diff(ranks, prepend=-1) != 0) - 1
    many = np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts)
    at = order[many[group]]
    edge = np.zeros(len(ids) + run + 1, dtype=np.int64)
    edge[at] += 1  # starts differ, so plain assignment counts each
    edge[at + run] -= 1
    return np.cumsum(edge)[: len(ids)] > 0


def _bitmap(runs: DataFrame) -> np.ndarray:
    """One bit for the low bits of every run, packed; its size is fixed."""

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for part in parts:
            seen[part.column(0).to_numpy(zero_copy_only=False) & ((1 << BITMAP_BITS) - 1)] = True
        packed = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    filled = runs.select("run").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    packed = np.zeros((1 << BITMAP_BITS) // 64, dtype=np.int64)
    for row in filled.toArrow().to_pylist():  # at most 2 ** BITMAP_BITS / 64 rows
        packed[row["at"]] = row["bits"]
    return packed


def _runs(parsed: DataFrame, packed: np.ndarray | None) -> DataFrame:
    """(row, host, page_id, run, at, open) of the runs of ``RUN`` words; all of open pages, or those a bitmap passes."""
    sent = None if packed is None else parsed.sparkSession.sparkContext.broadcast(packed)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        marked = None if sent is None else np.unpackbits(sent.value.view(np.uint8)).astype(bool)
        for part in slices(parts, 64):
            texts, states = columns_of(part, "blocks", "states")
            opened = [OPEN in s and KEEP not in s for s in states]
            words = [t.replace(_JOIN, " ").encode().split(b" ") if t else [] for t in texts]
            owners, runs, places = [], [], []
            for i, one in enumerate(ids(words)):
                if len(one) < RUN or (marked is None and not opened[i]):
                    continue
                found = as_long(shingle_hashes(one, RUN))
                at = np.arange(len(found))
                if marked is not None:
                    at = at[marked[found & ((1 << BITMAP_BITS) - 1)]]
                owners.append(np.full(len(at), i))
                runs.append(found[at])
                places.append(at)
            if not owners:
                continue
            owner = np.concatenate(owners)
            whole = part.select(["row", "host", "page_id"]).take(pa.array(owner))
            more = [pa.array(np.concatenate(runs)), pa.array(np.concatenate(places)), pa.array(np.array(opened)[owner])]
            yield pa.RecordBatch.from_arrays([*whole.columns, *more], names=["row", "host", "page_id", "run", "at", "open"])

    return parsed.select("row", "host", "page_id", "blocks", "states").mapInArrow(
        run, "row long, host string, page_id long, run long, at long, open boolean"
    )


def _shared(parsed: DataFrame) -> DataFrame | None:
    """(row, shared): where runs start in open pages that stand on two different pages of the host; None if none is open."""
    packed = _bitmap(_runs(parsed, None))
    if not packed.any():
        return None
    runs = store(_runs(parsed, packed), "host-runs")
    # Each row without an id is a page of its own; a run twice on one row is one place.
    pages = runs.filter("page_id IS NOT NULL").groupBy("host", "run").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    lone = runs.filter("page_id IS NULL").groupBy("host", "run", "row", "at").agg(F.count(F.lit(1)).alias("n"))
    lone = lone.groupBy("host", "run", "row").agg(F.max("n").alias("n")).groupBy("host", "run").agg(F.sum("n").alias("lone"))
    both = pages.withColumn("lone", F.lit(0).cast("long")).unionByName(lone, allowMissingColumns=True)
    both = both.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("lone").alias("lone"))
    both = both.filter((F.col("low") < F.col("high")) | (F.col("lone") > 1) | (F.col("low").isNotNull() & (F.col("lone") > 0)))
    both = both.select(F.col("host").alias("_host"), F.col("run").alias("_run"))
    opened = runs.filter("open").select("row", "host", "run", "at").distinct()
    met = opened.join(both, opened["host"].eqNullSafe(both["_host"]) & (opened["run"] == both["_run"]), "left_semi")
    return store(met.groupBy("row").agg(F.collect_list("at").alias("shared")), "shared-runs")  # at most the page's words


def _texts(group: pd.DataFrame) -> pd.DataFrame:
    """The main text of each page of one host group."""
    group = group.sort_values(["page_id", "url", "blocks"], na_position="first", ignore_index=True)
    split = [b.split(_JOIN) if b else [] for b in group["blocks"]]
    known: dict[str, int] = {}
    streams = [[known.setdefault(w, len(known)) for block in one for w in block.split()] for one in split]
    # Rows of the same page are one page; each page ends with a word that stands nowhere else.
    named = pd.factorize(group["page_id"], use_na_sentinel=True)[0].astype(np.int64)
    named = np.where(named < 0, len(group) + np.arange(len(group)), named)
    ids = np.concatenate([np.array([*s, -1 - i], dtype=np.int64) for i, s in enumerate(streams)])
    page = np.repeat(named, [len(s) + 1 for s in streams])
    hidden = covered(ids, page)
    texts, at = [], 0
    for one, states, stream, shared in zip(split, group["states"], streams, group["shared"], strict=True):
        marks = hidden[at : at + len(stream)]
        if shared is not None:
            marks[(np.asarray(shared)[:, None] + np.arange(RUN)).ravel()] = True
        at += len(stream) + 1
        whole = KEEP in states
        kept, word = [], 0
        for block, state in zip(one, states, strict=True):
            n = block.count(" ") + 1
            if state == KEEP:
                kept.append(block)
            elif state == OPEN and not whole:
                unique = [w for w, m in zip(block.split(" "), marks[word : word + n], strict=True) if not m]
                if unique:
                    kept.append(" ".join(unique))
            word += n
        texts.append(" ".join(kept))
    return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": texts})


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text. A null url, or one without a host, belongs to the host without a name.
    Repeated rows each keep their row and count as one page for repetition. Other columns are not carried.
    """
    chosen = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).withColumn("host", split_url(F.col("url"))[0])
    large = chosen.groupBy("host").agg(F.sum(F.length("html")).alias("chars")).filter(F.col("chars") > GROUP_CHARS)
    large = store(large, "large-hosts")
    # Few large hosts go to every task, so pages are shuffled once; more of them are joined by a shuffle.
    hosts = large.count()
    if hosts <= MAX_SENT_HOSTS:
        large = F.broadcast(large)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            found = [blocks(page) for page in columns_of(part, "html")[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i) for i in range(3)),
                    pa.array([_JOIN.join(t for _, t in one) for one in found], pa.string()),
                    pa.array(["".join(s for s, _ in one) for one in found], pa.string()),
                ],
                names=["page_id", "url", "host", "blocks", "states"],
            )

    schema = "page_id long, url string, host string, blocks string, states string"
    row = F.xxhash64(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "blocks", "states")

    def parse(rows: DataFrame) -> DataFrame:
        return rows.select("page_id", "url", "host", "html").mapInArrow(run, schema).withColumn("row", row)

    parsed = parse(chosen)
    same_host = chosen["host"].eqNullSafe(large["host"])
    shared = _shared(parse(chosen.join(large, same_host, "left_semi"))) if hosts else None
    if shared is None:
        parsed = parsed.withColumn("shared", F.lit(None).cast("array<long>"))
    else:
        parsed = parsed.join(shared, "row", "left")
    groups = split_count(F.coalesce("chars", F.lit(1)), GROUP_CHARS)
    dealt = parsed.join(large, "host", "left").withColumn(
        "deal", F.pmod(F.xxhash64("page_id", "url"), groups)
    )
    # A key of its own, else rows stay where the join on host put them and a large host is one task again. Two
    # hosts of one key would only be judged together.
    key = F.xxhash64("host", "deal").alias("key")
    texts = dealt.groupBy(key).applyInPandas(_texts, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
