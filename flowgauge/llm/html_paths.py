"""Main text of web pages by consensus host paths.

Every page's containers are scored by their own text, and each page votes for its best
one. A container is named by its generalised path: tags with their classes, digits made
alike. Votes are summed per host and path in Spark, so that pages of one site correct
each other; then every page is read again along its host's winning path. Pages whose
host has no winner in them fall back on their own best container.

Words of a class or id that speak of menus, adverts or comments, and forms, only mark
what is inside. A mark does not reach into an ``article`` or ``main``, and does not count
where it covers most of a page's paragraphs or all of its text: then it is a wrapper.
"""

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from flowgauge.llm.shared import add_columns, pick
from flowgauge.session import stored

# Fixed values of HTML: elements without content, with raw content, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video")
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody
td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary"}
# An end tag is implied by these starts, up to the boundary named with them.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"})}
CONTAINERS = frozenset("article main section div td body blockquote".split())

# What is never part of an article: by tag, by role and by words of class or id.
BOILER_TAGS = frozenset("nav footer header aside button menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
menu breadcrumb breadcrumbs footer header masthead sidebar aside widget related recommended share sharing social cookie cookies consent
notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus reply replies respond pagination pager
toolbar skip copyright legal""".split())
# Readers' comments can be longer than the article and made of articles: their mark reaches
# into those, and counts unless the page's heading is inside.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
# Beside one of these a word says what a container has or lacks, not what it is.
BEFORE, AFTER = frozenset("no not non has have with without hide".split()), frozenset("free enabled disabled less".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 pre blockquote li".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"\d+")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def _tags(source):
    """(text before, closing, tag, attributes) of every tag; raw elements are skipped.
    A last entry without a tag carries the text after them."""
    at, before = 0, []
    while (start := source.find("<", at)) >= 0:
        m = TOKEN.match(source, start) or LOOSE_TAG.match(source, start)
        if m is None:
            before.append(source[at:start + 1])
            at = start + 1
            continue
        if start > at:
            before.append(source[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        yield "".join(before), bool(m[1]), tag, m[3]
        before = []
        if tag in RAW and not m[1] and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*(?:>|\Z|/)", re.I).search(source, at)
            at = end.start() if end else len(source)
    yield "".join([*before, source[at:]]), False, None, ""


def _unescaped(text):
    return html.unescape(text) if "&" in text else text


def _attributes(raw):
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _boiler(tag, attributes):
    if tag in BOILER_TAGS:
        return True
    return bool(attributes) and (attributes.get("role", "").lower() in BOILER_ROLES or attributes.get("aria-hidden") == "true"
                                 or "hidden" in attributes or bool(HIDDEN.search(attributes.get("style", ""))))


def _mark(tag, attributes):
    """What the words of a class or id say: "" (nothing), "boiler" or "comment"."""
    said = "boiler" if tag == "form" else ""
    if not attributes or tag in ("html", "body"):
        return said
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = ["", *WORDS.findall(name), ""]
        for before, part, after in zip(parts, parts[1:], parts[2:]):
            if part in BOILER_WORDS and before not in BEFORE and after not in AFTER:
                if part in COMMENT_WORDS:
                    return "comment"
                said = said or "boiler"
    return "" if tag in ("article", "main") else said


def _step(tag, attributes):
    """A tag and its sorted classes, digits made alike."""
    classes = sorted(set(DIGITS.sub("#", c).replace("/", "|") for c in attributes.get("class", "").lower().split()))
    return ".".join([tag.replace("/", "|"), *classes])


def _path_key(path):
    """The key of a path, as containers have it in this process."""
    key = 0
    for step in path.split("/")[1:]:
        key = hash((key, step))
    return key


class Page:
    """Blocks of text, each with the open containers, and what containers hold.

    ``containers`` has (key of the path, parent's place, step); ``blocks`` has
    (container, text, characters inside links, kind of block), without blocks whose mark
    counts."""

    def __init__(self, source):
        self.containers, self.blocks = [(0, -1, "")], []
        self._stack, self._held = [], Counter()     # (tag, container, boiler, link, mark); tags on it
        self._text, self._linked, self._kind = [], 0, ""
        self._marks, self._marked = [(-1, "")], []  # (mark around, what it says); the mark of each block
        for text, closing, tag, raw in _tags(source):
            if text and not (self._stack and self._stack[-1][2]):
                self._text.append(text)
                if self._stack and self._stack[-1][3]:
                    self._linked += len(text)
            if tag is None:
                break
            self._close(tag) if closing else self._open(tag, raw)
        self._end_block()
        self._weigh_marks()

    def _end_block(self):
        if self._text:
            text = " ".join(_unescaped("".join(self._text)).split())
            if text:
                inside, mark = (self._stack[-1][1], self._stack[-1][4]) if self._stack else (0, 0)
                self.blocks.append((inside, text, self._linked, self._kind))
                self._marked.append(mark)
        self._text, self._linked, self._kind = [], 0, ""

    def _weigh_marks(self):
        """Takes out the blocks under a mark that counts."""
        if len(self._marks) == 1:
            return
        held, heading = [0] * len(self._marks), [False] * len(self._marks)
        for (_, text, linked, kind), mark in zip(self.blocks, self._marked):
            if kind in PARAGRAPHS:
                held[mark] += max(0, len(text) - 2 * linked)
                heading[mark] |= kind == "h1"
        total = sum(held)
        for i in range(len(held) - 1, 0, -1):
            around = max(self._marks[i][0], 0)
            held[around] += held[i]
            heading[around] |= heading[i]
        counts = [False] * len(self._marks)
        for i, (around, says) in enumerate(self._marks):
            wrapper = 2 * held[i] > total and (says != "comment" or heading[i])
            counts[i] = i > 0 and (not wrapper or counts[max(around, 0)])
        left = [b for b, mark in zip(self.blocks, self._marked) if not counts[mark]]
        self.blocks = left or self.blocks

    def _drop(self, i):
        self._held.subtract(s[0] for s in self._stack[i:])
        del self._stack[i:]

    def _pop_to(self, tags, stops):
        if not any(self._held[tag] for tag in tags):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in tags:
                self._end_block()
                self._drop(i)
                return
            if self._stack[i][0] in stops:
                return

    def _open(self, tag, raw):
        if tag == "br":
            self._text.append(" ")
            return
        if tag in CLOSES_P:
            self._pop_to({"p"}, CONTAINERS | {"table", "ul", "ol", "button"})
        if tag in IMPLIED:
            self._pop_to(*IMPLIED[tag])
        if tag in BLOCKS:
            self._end_block()
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            return
        attributes = _attributes(raw)
        parent = self._stack[-1] if self._stack else ("", 0, False, False, 0)
        inside = parent[1]
        if tag in CONTAINERS and not parent[2]:
            step = _step(tag, attributes)
            self.containers.append((hash((self.containers[inside][0], step)), inside, step))
            inside = len(self.containers) - 1
        mark, says = parent[4], _mark(tag, attributes)
        if tag in ("article", "main") and self._marks[mark][1] != "comment":
            mark = 0
        if says:
            self._marks.append((mark, says))
            mark = len(self._marks) - 1
        self._held[tag] += 1
        self._stack.append((tag, inside, parent[2] or tag in RAW or _boiler(tag, attributes), parent[3] or tag == "a", mark))
        if tag in BLOCKS:
            self._kind = tag

    def _close(self, tag):
        if not self._held[tag]:
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                if any(s[0] in BLOCKS for s in self._stack[i:]):
                    self._end_block()
                self._drop(i)
                return
            if self._stack[i][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article", "div", "section"):
                return

    def scores(self):
        """Own text of each container in characters, links taken off, paragraphs and
        headings counted whole and other blocks by half; half of it counts for the
        container around as well, so that a split article is won by what holds it."""
        own = [0.0] * len(self.containers)
        for inside, text, linked, kind in self.blocks:
            weight = 1.0 if kind in PARAGRAPHS else 0.5
            own[inside] += max(0, len(text) - 2 * linked) * weight
        for i in range(len(own) - 1, 0, -1):
            own[self.containers[i][1]] += own[i] / 2
        for i, (_, _, step) in enumerate(self.containers):
            own[i] *= {"article": 2.0, "main": 1.5, "body": 0.8}.get(step.split(".")[0], 1.0)
        return own

    def best(self):
        """Place of the best container and its score; the first of equals."""
        scores = self.scores()
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return best, scores[best]

    def path(self, i):
        """The steps to a container, each with a slash before it."""
        steps = []
        while i > 0:
            steps.append(self.containers[i][2])
            i = self.containers[i][1]
        return "".join(f"/{step}" for step in reversed(steps))

    def text(self, chosen):
        """The blocks below any of the chosen containers, in page order."""
        below = [False] * len(self.containers)
        for i, (_, parent, _) in enumerate(self.containers):
            below[i] = i in chosen or parent >= 0 and below[parent]
        return "\n".join(text for inside, text, _, _ in self.blocks if below[inside])

    def along(self, path):
        """The text along a path, or of the page's own best container."""
        key = _path_key(path) if path else None
        chosen = {i for i, (k, _, _) in enumerate(self.containers) if k == key} if path else set()
        text = self.text(chosen) if chosen else ""
        return text or (self.text({self.best()[0]}) if self.blocks else "")


def _votes(pages):
    """One row per host and path of a batch: pages that vote for it and their scores."""
    def run(batches):
        for batch in batches:
            tally = defaultdict(lambda: [0, 0.0])
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host is not None and source:
                    page = Page(source)
                    best, score = page.best()
                    if score > 0:
                        row = tally[host, page.path(best)]
                        row[0] += 1
                        row[1] += score ** 0.5      # a long page is not worth many short ones
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in tally], pa.string()) for i in (0, 1)]
                + [pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.float64())],
                names=["host", "path", "pages", "score"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, pages long, score double")


def host_paths(pages):
    """The winning path of each host, of ``pages`` with host and html.

    Votes are added up in the tasks first, so a host with most pages is a few rows."""
    summed = _votes(pages).groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("score").alias("score"))
    best = F.max(F.struct(F.round("score", 3).alias("score"), "pages", "path"))
    return stored(summed.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path")), "paths")


def main_text(pages):
    """page_id, url, text, n_chars of every page.

    A null or empty page has an empty text. A null url, or one without a host, has no
    site to ask: such a page is read by its own best container. Repeated rows repeat
    their result; an empty table gives none. The winners join by host: a table known to
    be small is broadcast under Spark's own threshold, else the hot host's rows are
    split by the skew join."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    plain = pick(pages, "page_id", "url", "html").withColumn("host", F.when(host != "", host))
    guided = plain.join(host_paths(plain), "host", "left").select("page_id", "url", "html", "path")

    def make(batch):
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        texts = [Page(source).along(path) if source else "" for source, path in pairs]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    return add_columns(guided, make, "text string, n_chars long").drop("html", "path")
