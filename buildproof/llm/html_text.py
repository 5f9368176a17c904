"""HTML extraction: drop site templates, found by counting element subtrees per host, and read the rest as blocks."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401, as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ROW_TYPE, apart, in_tasks, numbered, settled, slices, stage

#: A subtree on at least so many different pages of a host is part of the site's template, if these are so many
#: of each thousand of its pages too. On a host with fewer pages nothing can be counted, and telling names serve instead.
MIN_PAGES, PER_MILLE = 5, 10
#: On pages without article or main, such elements, and plain div elements without others in them, in the block with most text of its own go only if most pages of the host have them.
PASSAGES = frozenset("p blockquote pre li dl dd dt table".split())

# Element names and naming habits of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
DROPPED = frozenset("aside button canvas dialog embed footer form head iframe input menu nav noscript object option select svg template textarea title audio video".split())
BOXES = frozenset("address center details div dl fieldset ol section table ul".split())
INNER = frozenset("h1 h2 h3 h4 h5 h6 hgroup ul ol tr tbody thead tfoot caption figure figcaption address details summary center".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
#: Start tags of these end an open paragraph; some also end an open element of their own kind.
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body article main section div aside nav footer form header".split())
_HINT = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|notice|consent|gdpr|popup|modal|newsletter|subscribe|subscription|sidebar|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|topbar|share|sharing|social|related|recommended|comment|comments|commentlist|disqus|respond|widget|pagination|pager|login|search)(?:$|[\s_-])", re.I)
_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert|alertdialog|menu|menubar|form)$", re.I)
#: Classes that mean adverts and reader comments and nothing else: these go inside an article too.
_NEVER_TEXT = frozenset("ad ads advert adverts advertisement sponsored comments commentlist comment-list disqus".split())
_NAME, _STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"=\s*[\"']|>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


#: Stands for the page itself among its elements, so that the pages of a host are counted with its subtrees.
WHOLE = -1
#: What a hash was made of: a subtree or a telling name, or the slot of a box counted on its host, or on all hosts (under the name EVERYWHERE).
SUBTREE, SLOT, ANY_SLOT = 0, 1, 2
EVERYWHERE = "*"


class Page:
    """The elements that give a page its structure, and its text with the element around each stretch.

    parent, tag, dropped, hinted, guarded, holds: one entry per element. dropped: by what kind of element it is; hinted: its
    class or id tells of a menu, an advert or the like; guarded: inside an article or main element; holds: such
    an element is inside. runs: (element, text), with element -1 where a block ends.
    """

    def __init__(self, source: str, names: bool = True):
        self.names = names  # whether telling classes and ids count
        self.parent, self.tag, self.dropped, self.hinted, self.guarded, self.holds, self.label = [], [], [], [], [], [], []
        self.runs: list[tuple[int, str]] = []
        self.stack: list[int] = []
        self.open: dict[str, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        """One way through the source: what follows a mark is looked for from there on, and the search goes on where it ended."""
        at, n = 0, len(source)
        last = {q: source.rfind(q) for q in "\"'"}
        while at < n:
            mark = source.find("<", at)
            self._text(source[at : mark if mark >= 0 else n])
            if mark < 0:
                return
            if source.startswith(("<!", "<?"), mark):
                end = "-->" if source.startswith("<!--", mark) else "]]>" if source.startswith("<![CDATA[", mark) else ">"
                found = source.find(end, mark + 2)
                at = found + len(end) if found >= 0 else n
                continue
            closes = source.startswith("</", mark)
            name = _NAME.match(source, mark + 1 + closes)
            if name is None:
                self._text("<")
                at = mark + 1
                continue
            end, stop = name.end(), None
            while (stop := _STOP.search(source, end)) and stop.group() != ">":
                quote, end = stop.group()[-1], stop.end()
                if end <= last[quote]:
                    end = source.index(quote, end) + 1
            if stop is None:  # the tag never ends: no tag is left
                self._text(source[mark:])
                return
            tag, at = name.group().lower(), stop.end()
            if closes:
                self._end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else n
            else:
                self._start(tag, source[name.end() : stop.start()])

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self.stack[-1] if self.stack else -2, text))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
        if tag in ("td", "th"):
            self._text(" ")
        if tag in BLOCKS:
            self._close_open({"p"}, frozenset())
            if tag in OWN_KIND:
                self._close_open(set(OWN_KIND[tag]), SCOPES)
            self.runs.append((-1, ""))
        if tag in VOID:
            return
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        around = self.stack[-1] if self.stack else None
        guarded = around is not None and (self.guarded[around] or self.tag[around] in CONTENT)
        names = f"{found.get('class', '')} {found.get('id', '')}"
        drop = tag in DROPPED or (tag == "header" and not guarded) or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        own = tag not in CONTENT and tag not in ("html", "body")
        drop = drop or (own and (bool(_ROLE.match(found.get("role", ""))) or self.names and not _NEVER_TEXT.isdisjoint(found.get("class", "").lower().split()) and guarded))
        hint = own and not drop and self.names and bool(_HINT.search(names))
        if tag in BLOCKS or drop or hint:
            self.parent.append(-1 if around is None else around)
            self.tag.append(tag)
            self.dropped.append(drop)
            self.hinted.append(hint)
            self.guarded.append(guarded)
            self.holds.append(tag in ("html", "body"))
            self.label.append(f"{tag}.{names.strip()}")
            self.stack.append(len(self.tag) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1
            if tag in CONTENT:
                for k in reversed(self.stack):
                    if self.holds[k] and self.tag[k] not in ("html", "body"):
                        break
                    self.holds[k] = True
            if attributes.endswith("/") and tag not in BLOCKS:
                self._cut(len(self.stack) - 1)

    def _cut(self, k: int) -> None:
        for j in self.stack[k:]:
            self.open[self.tag[j]] -= 1
        del self.stack[k:]

    def _close_open(self, tags: set, stop: frozenset) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.tag[self.stack[k]]
            if tag in tags:
                self._cut(k)
                self.runs.append((-1, ""))
                return
            if tag in stop or (not stop and tag in BLOCKS and tag != "p"):
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.runs.append((-1, ""))
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.tag[self.stack[k]] == tag:
                self._cut(k)
                return
            if self.tag[self.stack[k]] in CONTENT and tag not in ("body", "html"):
                return

    def labels(self) -> list[tuple[int, int]]:
        """(element, hash of its label) of elements with telling names, and of the page itself: a slot that most pages have, whatever it holds."""
        import xxhash

        made = [(k, f"\x02{self.label[k]}") for k, hint in enumerate(self.hinted) if hint and not self.holds[k]]
        return [(k, xxhash.xxh64_intdigest(x) - (1 << 63)) for k, x in [(WHOLE, "\x03"), *made]]

    def slots(self) -> list[tuple[int, int]]:
        """(element, hash of its label) of boxes with a class or id, beside the content: what they hold is masked, so that boxes of changing text are counted too."""
        import xxhash

        if not self.marked():
            return []
        made = [(k, f"\x04{label}") for k, label in enumerate(self.label) if self.tag[k] in BOXES and not (self.guarded[k] or self.holds[k] or self.dropped[k]) and not label.endswith(".")]
        return [(k, xxhash.xxh64_intdigest(x) - (1 << 63)) for k, x in made]

    def marked(self) -> bool:
        """Whether an element marks the content."""
        return any(tag in CONTENT and not drop for tag, drop in zip(self.tag, self.dropped))

    def _boxes(self, slots: set[int]) -> set[int]:
        """Boxes in recurring slots that go: those beside the content, unless they have more text than all of it."""
        if not slots or not self.marked():
            return set()
        size, content = [0] * len(self.tag), 0
        for k, text in self.runs:
            if k >= 0:
                n = len(text) - text.count(" ")
                size[k] += n
                content += n if self.guarded[k] or self.tag[k] in CONTENT else 0
        for k in range(len(self.tag) - 1, -1, -1):
            if self.parent[k] >= 0:
                size[self.parent[k]] += size[k]
        return {k for k in slots if size[k] <= content}

    def hashes(self) -> dict[int, int]:
        """Subtree hash of every element that may belong to a template: outside the content, and not around it."""
        import xxhash

        inner: list[list[str]] = [[] for _ in self.tag]
        for k, text in self.runs:
            if k >= 0 and not text.isspace():
                inner[k].append(" ".join(text.split()))
        out = {}
        for k in range(len(self.tag) - 1, -1, -1):
            digest = xxhash.xxh64_intdigest("\x00".join([self.label[k], *inner[k]]))
            if self.parent[k] >= 0:
                inner[self.parent[k]].append(f"\x01{digest:x}")
            if not self.guarded[k] and not self.holds[k] and inner[k]:
                out[k] = digest - (1 << 64) if digest >> 63 else digest
        return out

    def _named(self, template: set[int], most: set[int]) -> list[bool]:
        """Elements that go by kind or name. A telling name counts beside a marked content, and else where the host has too few pages to count, or pages of the host have that slot; inside the content, where most have."""
        large = WHOLE in template and not self.marked()
        return [d or (h and not self.holds[k] and (k in most if self.guarded[k] else k in template or not large)) for k, (d, h) in enumerate(zip(self.dropped, self.hinted))]

    def _spared(self, template: set[int], most: set[int], named: list[bool]) -> set[int]:
        """Recurring passages, and all in them, of the block that holds most text of the page itself, if nothing marks the content.

        The text of a passage counts for the element around it. Those that most pages of the host have are not spared.
        """
        if self.marked():
            return set()
        around = set(self.parent)
        passage = [not hint and (tag in PASSAGES or (label == "div." and k not in around)) for k, (tag, label, hint) in enumerate(zip(self.tag, self.label, self.hinted))]
        part = [p or tag in INNER for p, tag in zip(passage, self.tag)]
        gone, block, size = [], [], {}
        for k, parent in enumerate(self.parent):
            gone.append(named[k] or k in template or (parent >= 0 and gone[parent]))
            block.append(block[parent] if parent >= 0 and part[k] else k)
        for k, text in self.runs:
            if k >= 0 and not gone[k]:
                if not part[block[k]]:  # else a passage with no element around it
                    size[block[k]] = size.get(block[k], 0) + len("".join(text.split()))
        if not size:
            return set()
        main = max(size, key=lambda k: (size[k], -k))
        out, inside = set(), [False] * len(self.tag)
        lost = [False] * len(self.tag)
        for k, parent in enumerate(self.parent):
            inside[k] = k == main or (parent >= 0 and inside[parent])
            if k != main and inside[k] and not lost[parent] and k not in most and (parent in out or (k in template and passage[k])):
                out.add(k)
            lost[k] = named[k] or (k in template and k not in out) or (parent >= 0 and lost[parent])
        return out

    def read(self, template: set[int], most: set[int] = frozenset(), slots: set[int] = frozenset()) -> tuple[str, int]:
        """The blocks in page order, one a line, without what is dropped or part of the template; and how many subtrees the template took.

        template: elements that recur on the host, with WHOLE if it has pages enough to count; most: those of them
        that stand on most of its pages; slots: boxes whose slot recurs, on the host or on any. These are taken first; kinds and names are for what they leave.
        """
        named = self._named(template, most)
        counted = {k for k in template if k >= 0 and not self.guarded[k]}
        counted -= self._spared(counted, most, named) if counted else set()
        counted |= self._boxes(slots)
        gone, taken = [], 0
        for k, parent in enumerate(self.parent):
            below = parent >= 0 and gone[parent]
            taken += k in counted and not below
            gone.append(below or k in counted or named[k])
        blocks, current = [], []
        for k, text in [*self.runs, (-1, "")]:
            if k == -1:
                words = entities.unescape("".join(current)).split()
                if words:
                    blocks.append(" ".join(words))
                current = []
            elif k < 0 or not gone[k]:
                current.append(text)
        return "\n".join(blocks), taken

    def text(self, template: set[int], most: set[int] = frozenset()) -> str:
        return self.read(template, most)[0]


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id", min_pages: int = MIN_PAGES, names: bool = True) -> DataFrame:
    """__row, id, url, text, n_template of every page; text is empty where nothing is left, and for null html.

    n_template: subtrees of the page that the counts removed. Equal pages count once, so a page that was fetched many times is
    no template. A template stands on min_pages pages and on PER_MILLE of each thousand of the host; so does
    the slot of an element with a telling name, whatever it holds. On pages with an article or main, a box beside it goes by its class and id, whatever these are and it holds, where such boxes stand
    beside the content on so many pages of the host, or on min_pages of all hosts, which serves hosts with few pages. Telling names decide only on what no count does; names=False leaves
    them out. The counts are partial sums by host and hash, and
    what recurs is joined back by both; one host may hold most of the pages. Rows that repeat an id are pages of their
    own, pages without a host count as one host, an empty table gives no rows, other columns are ignored.
    """
    rows = numbered(settled(pages)).select(ROW, F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def subtrees(batches):
        for b in slices(batches):
            at, kind, order, digest = [], [], [], []
            for k, source in enumerate(b.column(3).to_pylist()):
                page = Page(source, names)
                slots = page.slots()
                for sort, found in ((SUBTREE, [*page.labels(), *page.hashes().items()]), (SLOT, slots), (ANY_SLOT, slots)):
                    at += [k] * len(found)
                    kind += [sort] * len(found)
                    order += [node for node, _ in found]
                    digest += [h for _, h in found]
            at, kind = pa.array(at, pa.int64()), pa.array(kind, pa.int32())
            host = pa.compute.if_else(pa.compute.equal(kind, ANY_SLOT), EVERYWHERE, b.column(1).take(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), host, b.column(2).take(at), kind, pa.array(order, pa.int32()), pa.array(digest, pa.int64())], names=[ROW, "host", "page", "kind", "node", "subtree"])

    found = rows.select(ROW, _host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    found = stage(in_tasks(found, subtrees, f"{ROW} {ROW_TYPE}, host string, page long, kind int, node int, subtree long"), "subtrees")
    totals = found.filter(F.col("node") == WHOLE).select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    shared = found.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    # the count over all hosts has no total of its own
    shared = shared.join(apart(totals, "host"), "host", "left").filter(F.col("pages").isNull() | (F.col("n") * 1000 >= F.col("pages") * PER_MILLE))
    shared = shared.select("host", "subtree", F.coalesce(F.col("n") * 2 > F.col("pages"), F.lit(False)).alias("most"))
    joined = found.join(apart(shared, "host", "subtree"), ["host", "subtree"])
    of = lambda condition: F.collect_set(F.when(condition, F.col("node")))
    template = joined.groupBy(ROW).agg(of(F.col("kind") == SUBTREE).alias("template"), of((F.col("kind") == SUBTREE) & F.col("most")).alias("most"), of(F.col("kind") != SUBTREE).alias("slots"))

    def pack(batches):
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            z = [shrink(source.encode()) for source in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], names=[ROW, "id", "url", "z"])

    def read(batches):
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            made = [Page(grow(z).decode(), names).read(set(t or ()), set(m or ()), set(x or ())) for z, t, m, x in zip(*(c.to_pylist() for c in b.columns[3:7]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32())], names=[ROW, "id", "url", "text", "n_template"])

    id_type = rows.schema["id"].dataType.simpleString()
    packed = in_tasks(rows, pack, f"{ROW} {ROW_TYPE}, id {id_type}, url string, z binary")  # pages are shuffled whole
    # templates grow with the pages, so they are never broadcast
    joined = packed.join(template.hint("merge"), ROW, "left").select(ROW, "id", "url", "z", "template", "most", "slots")
    return in_tasks(joined, read, f"{ROW} {ROW_TYPE}, id {id_type}, url string, text string, n_template int")
