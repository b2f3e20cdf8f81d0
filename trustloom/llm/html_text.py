"""Main text of web pages by consensus: pages vote for a path per host, and are extracted again along the winning paths.

1. Each page is read into containers and blocks of text. What can't be article is marked: by tag, by role, by words of class or id. A container gains the
   length of each good block inside it and loses for short lines and link lists; the one that gains most, the deepest of equals, is the page's choice.
2. The page votes for the choice's generalised path: the tags from the body down, each with its classes, digits replaced. Votes are counted per host and path
   (partial counts before the exchange, so a host of any size is one count per task). Paths with at least SHARE of their host's votes win: at most 1 / SHARE a host.
3. Each page is read again: of the containers that stand at the host's most voted path which the page has, the one that gains most is its article, else its own choice.
   The winners are counted and broadcast if they have at most BROADCAST_BYTES; else they are joined by host and salt.

Blocks are runs of text between block tags; white space of any kind inside one becomes a space, so a line break tag is a space. References are decoded, tags are dropped, and broken
nesting closes what it leaves open. Texts are whole.

Nulls: a null html or one without text gives an empty text; pages whose url is null or has no host vote for nothing and follow their own choice. Repeated rows are pages of
their own. Very long and very deep pages are read in one pass, without recursion. Other columns are not read. No rows: no texts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory, scratch
from .url_filter import host_of

#: A winning path has this share of its host's votes at least.
SHARE = 0.02
#: A container inside another is the core of it with this share of its gain.
MOST = 0.75
#: Winners of so many bytes are broadcast; more are joined with pages by host and salt.
BROADCAST_BYTES, SALT = 8 << 20, 32

# Names of the HTML standard.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body option legend caption tbody tfoot thead tr".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",), "tbody": ("tbody", "thead", "tr"), "tfoot": ("tbody", "thead", "tr")}
SCOPE = frozenset("ul ol dl table select menu body".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tablist tooltip form".split())

# What isn't article, by tag and by words of class and id. The second lists hold whatever the size of what they mark.
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video map button select textarea title dialog nav footer menu head".split())
SOFT = frozenset("aside header form search".split())
WORDS = frozenset(
    "sidebar rail widget widgets menu submenu nav navbar navigation breadcrumb breadcrumbs pagination pager toc skip header masthead topbar toolbar footer colophon copyright banner notice notices alert alerts popup modal overlay "
    "lightbox paywall subscribe subscription newsletter signup login share sharing sharebar social follow related recommended recommendations trending teaser teasers outbrain taboola search searchform".split()
)
SURE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion dfp cookie cookies cookiebar gdpr consent comment comments commentlist respond "
    "reply replies disqus responses discussion".split()
)

#: A heading's frame is part of the article if it also carries one of these.
OF_ARTICLE = frozenset("article post entry story headline title content".split())
#: What holds text but is no container to choose.
PARTS = HEADING | frozenset("p li tr tbody thead tfoot table ul ol dl dt dd pre blockquote figure figcaption caption".split())

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_END = re.compile(r"[.!?…。！？:;]")


class Page:
    """Containers of a page in the order of their start (parent, label, tag, how they are marked) and its blocks of text."""

    def __init__(self, source: str):
        self.parent, self.label, self.tag, self.mark = [-1], ["body"], ["body"], [0]
        self.blocks: list[tuple[int, str, int, int]] = []  # container, text, characters in links, level of the heading or 0
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack, pieces, linked, link, at, n = [0], [], 0, False, 0, len(source)
        opened: dict[str, int] = {}
        skip, nested, skip_from = "", 0, 0  # an inline element that is hidden or an advert, until it or its block ends

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    tag = self.tag[stack[-1]]
                    self.blocks.append((stack[-1], text, linked, int(tag[1]) if tag in HEADING else 0))
                pieces, linked = [], 0

        def pop_to(depth: int) -> None:
            nonlocal link, skip
            flush()
            for i in stack[depth:]:
                opened[self.tag[i]] -= 1
            del stack[depth:]
            link = False
            skip = skip if depth > skip_from else ""

        def close(names, stop=()) -> bool:
            if not any(opened.get(name) for name in names):
                return False
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[i]]
                if tag in names:
                    pop_to(i)
                    return True
                if tag in stop:
                    return False
            return False

        while at < n:
            found = _TOKEN.search(source, at)
            start = found.start() if found else n
            if start > at and not skip:
                pieces.append(source[at:start])
                linked += len(pieces[-1].strip()) if link else 0
            if not found:
                break
            at, tag = found.end(), (found[2] or "").lower()
            if not tag or tag in ("html", "body"):
                continue
            block = tag in BLOCK or tag in DROPPED or "-" in tag
            if found[1]:
                if tag == skip:
                    nested -= 1
                    skip = skip if nested else ""
                if tag == "a":
                    link = False
                elif tag in ("td", "th"):
                    self._cell(stack, pop_to)
                    pieces.append(" ")
                elif block and not close(HEADING if tag in HEADING else (tag,)) and tag == "p":
                    flush()
            elif tag in RAW:
                ends = re.compile(rf"(?i)</{tag}(?=[\s/>]|\Z)").search(source, at)
                at = source.find(">", ends.end()) + 1 or n if ends else n
                pieces.append(" ")
            elif tag == "hr":
                flush()
            elif tag in VOID:
                pieces.append(" " if tag in ("br", "img") else "")
            elif tag in ("td", "th"):
                self._cell(stack, pop_to)
                pieces.append(" ")
            elif not block:
                link |= tag == "a"
                if skip:
                    nested += tag == skip
                elif found[3] and self._describe(tag, found[3])[1] > 1:
                    skip, nested, skip_from = tag, 1, len(stack)
            else:
                if tag in CLOSES_P:
                    close(("p",), SCOPE)
                for name in CLOSES_OWN.get(tag, ()):
                    close((name,), SCOPE)
                flush()
                if tag == "svg" and found[3].endswith("/"):
                    continue
                label, mark = self._describe(tag, found[3])
                self.parent.append(stack[-1])
                self.label.append(label)
                self.tag.append(tag)
                self.mark.append(mark)
                stack.append(len(self.tag) - 1)
                opened[tag] = opened.get(tag, 0) + 1
        flush()

    def _cell(self, stack: list[int], pop_to) -> None:
        """A cell begins or ends: what is still open inside the row ends."""
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in ("tr", "table"):
                if i + 1 < len(stack):
                    pop_to(i + 1)
                return

    @staticmethod
    def _describe(tag: str, attrs: str) -> tuple[str, int]:
        """The label of a path, and 0: article may be inside, 1: only if it holds a heading of a page, 2: not, 3: never."""
        mark = 3 if tag in DROPPED else 1 if tag in SOFT else 0
        if not attrs.strip(" \t\r\n/"):
            return tag, mark
        named = {}
        for m in _ATTR.finditer(attrs):
            named.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
        classes = named.get("class", "").split()
        words = {w.lower() for text in (*classes, named.get("id", "")) for w in _WORD.findall(text)}
        role = named.get("role", "").strip().lower()
        if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(named.get("style", "")):
            mark = 3
        elif tag in ("article", "main"):
            mark = 2 if words & {"comment", "comments", "reply"} else mark
        elif words & SURE:
            mark = max(mark, 2)
        elif role in ROLES or (words & WORDS and not (words & WORDS == {"header"} and words & OF_ARTICLE)):
            mark = max(mark, 1)
        elif role in ("main", "article") or named.get("itemprop", "").lower() == "articlebody":
            return ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes}), "@"]), 0
        return ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})]), mark

    def _settle(self) -> None:
        """Which containers are dropped for good, and what every container gains."""
        n = len(self.tag)
        size, titled, holds, main = [0] * n, [False] * n, [False] * n, [False] * n
        for at, text, _, heading in self.blocks:
            size[at] += len(text)
            titled[at] |= heading == 1
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            main[i] |= self.tag[i] == "main"
            holds[i] |= main[i] or (self.tag[i] == "article" and not self.mark[i])
            size[up] += size[i]
            titled[up] |= titled[i]
            main[up] |= main[i]
            holds[up] |= holds[i]
        self.gone, inside = [False] * n, [False] * n
        for i in range(1, n):
            up, mark, share = self.parent[i], self.mark[i], size[i] / max(size[0], 1)
            inside[i] = inside[up] or self.tag[up] == "article"
            if mark == 1:
                drop = not (holds[i] or share > 0.9 or (titled[i] and (inside[i] or share > 0.5)))
            else:
                drop = mark == 3 or (mark == 2 and not (titled[i] or main[i]))
            self.gone[i] = self.gone[up] or drop
        gain = [0.0] * n
        for at, text, linked, heading in self.blocks:
            if self.gone[at]:
                continue
            long = len(text)
            if linked * 2 > long:
                gain[at] -= min(long, 100)
            elif heading or long >= 80 or (long >= 25 and _END.search(text)):
                gain[at] += long
            elif self.tag[at] not in PARTS:
                gain[at] -= 15
            else:
                gain[at] += long if self.tag[at] in ("p", "pre", "blockquote") else 0
        for i in range(n - 1, 0, -1):
            if gain[i] > 0 or not self.gone[i]:
                gain[self.parent[i]] += gain[i]
        for i in range(n):
            if not self.gone[i] and (self.tag[i] in ("article", "main") or self.label[i].endswith(".@")):
                gain[i] = gain[i] * (1.2 if self.tag[i] == "main" else 1.3) + (200 if size[i] else 0)
        self.gain = gain

    def choice(self) -> int:
        """The container that gains most; of equals the deepest, and of those the first."""
        best, most = 0, self.gain[0]
        for i in range(1, len(self.tag)):
            if not self.gone[i] and (self.gain[i] > most or (self.gain[i] == most and self.parent[i] == best)):
                best, most = i, self.gain[i]
        while best and self.tag[best] in PARTS:
            best = self.parent[best]
        return self._core(best)

    def _core(self, top: int) -> int:
        """Of nested containers that hold most of what a container gains, and its title if it has one, the innermost: what stands beside it is no article. What is marked up as one stays whole."""
        titles = [0] * len(self.tag)
        for at, _, _, heading in self.blocks:
            titles[at] += heading == 1 and not self.gone[at]
        for i in range(len(self.tag) - 1, 0, -1):
            titles[self.parent[i]] += titles[i]
        for i in range(top + 1, len(self.tag)):  # in the order of the page a container comes before what it holds
            marked = self.tag[top] in ("article", "main") or self.label[top].endswith(".@")
            if not marked and self.parent[i] == top and not self.gone[i] and self.tag[i] not in PARTS and self.gain[i] >= MOST * self.gain[top] > 0 and titles[i] == titles[top]:
                top = i
        return top

    def path(self, i: int) -> str:
        names = []
        while i >= 0:
            names.append(self.label[i])
            i = self.parent[i]
        return " ".join(reversed(names))

    def at_path(self, paths) -> int | None:
        """Of the containers at the first of these paths that the page has, the one that gains most."""
        wanted = [p.split(" ") for p in paths]
        best: dict[int, int] = {}
        alive: list[list[int]] = [[] for _ in self.tag]
        depth = [0] * len(self.tag)
        for i, label in enumerate(self.label):
            up = self.parent[i]
            depth[i] = depth[up] + 1 if i else 0
            for w in range(len(wanted)) if i == 0 else alive[up]:
                p = wanted[w]
                if depth[i] < len(p) and p[depth[i]] == label:
                    alive[i].append(w)
                    if depth[i] == len(p) - 1 and not self.gone[i] and (w not in best or self.gain[i] > self.gain[best[w]]):
                        best[w] = i
        return best[min(best)] if best else None

    def text(self, top: int) -> str:
        """The blocks below a container that aren't dropped, in the order of the page."""
        inside = [False] * len(self.tag)
        inside[top] = True
        for i in range(top + 1, len(self.tag)):
            inside[i] = inside[self.parent[i]] and not self.gone[i]
        return "\n".join(text for at, text, _, _ in self.blocks if inside[at] and not self.gone[at])


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n: how many pages of a host chose a path. pages: host, html."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                page = Page(source)
                top = page.choice()
                if page.gain[top] > 0:
                    out.append((host, page.path(top)))
            yield pd.DataFrame(out, columns=["host", "path"])
            memory.release()

    some = pages.filter("host <> '' and html <> ''").select("host", "html")
    return some.mapInPandas(read, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """host, paths: the paths with this share of a host's votes, the most voted first."""
    total = counted.groupBy("host").agg(F.sum("n").alias("total"))
    most = counted.join(total, "host").filter(F.col("n") >= F.col("total") * share)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return most.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (its code points), path of the container it was taken from: one row per page."""
    memory.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col).cast("string")).alias("host"))
    won = scratch.stored(winners(scratch.stored(votes(rows), "votes")), "winners")
    size = won.agg(F.sum(F.length("host") + F.aggregate("paths", F.lit(0), lambda s, p: s + F.length(p)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        both = rows.join(F.broadcast(won), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALT)).cast("int")
        both = rows.withColumn("salt", salt).join(won.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)]))), ["host", "salt"], "left")
    kind = pages.schema[id_col].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, paths = [], []
            for source, known in zip(pdf["html"], pdf["paths"], strict=True):
                page = Page(source)
                own = page.choice()
                top = page.at_path(known) if known is not None else None
                top = own if top is None or page.gain[top] <= 0 < page.gain[own] else top
                texts.append(page.text(top))
                paths.append(page.path(top))
            yield pdf[["id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts], path=paths)
            memory.release()

    out = both.select("id", "url", "html", "paths").mapInPandas(read, f"id {kind}, url string, text string, n_chars long, path string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op12_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars", "path")
