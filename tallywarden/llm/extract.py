"""Main text of web pages: what the page nearest by URL does not have too, checked by markup."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywarden.llm.shared import parts, stored, text_steps

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that a reader of the article skips.
SKIPPED = RAW | frozenset("nav aside footer form noscript template svg math object canvas button select dialog menu head audio video map".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: Words in a class or id that mark what stands beside an article.
BESIDE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe share sharing social related recommended comment comments disqus replies widget toolbar pagination pager login signup".split())
#: These two mark the page's own head or foot.
EDGES = frozenset(("header", "footer"))
#: Words that may stand with them in one name and say where or what kind of box it is; any other word gives the name another sense.
BOXES = frozenset("top bottom left right center main site page global primary secondary upper lower inner outer first last fixed sticky floating mobile desktop side box block container wrapper wrap holder area section zone slot unit module panel pane row col column columns grid list lists item items entry entries link links button buttons bar bars form forms group card cards tile tiles body content inline in post posts article articles story stories news image text title heading label icon icons count message overlay dialog popup js c u o l m is the and of x".split())
#: Names with one of these speak of the page's layout: ``has-sidebar`` stands on what is not the sidebar.
LAYOUT = frozenset("has have no not non none with without hide hides show shows toggle enabled disabled open closed collapsed expanded layout theme template".split())
#: A name that says where furniture is (``sidebar-left``) is a layout too if the element is called one of these.
PLACES, WHOLE = frozenset("left right top bottom".split()), frozenset("article post entry content story main page layout container wrapper site row grid".split())
OWN = frozenset("article post entry content story main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: What makes a form more than a field or two: it wraps the page.
HOLDS = re.compile(r"<(?:article|main|h1)(?=[\s/>])", re.I)
FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
QUERY = re.compile(r"[?#]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Kinds of lines: beside the article, inside an article element, inside main, anywhere else.
BESIDE_LINE, ARTICLE_LINE, MAIN_LINE, PLAIN_LINE = range(4)
#: A page may be a near copy of its neighbour if so many of its lines beside no furniture are shared: then pages further away are asked.
COPY = 0.75
#: So many pages that are no near copies must have all of a marked article or main for it to count as the site's.
WITNESSES = 2
#: How far away these are, in pages with unlike lines.
FURTHER = (1, 3, 9, 81, 729, 6561)
#: A line's number: the hash in ``HASH``, below it whether the line stands beside no furniture, above it the kind, and whether another article begins.
HASH, KIND_AT, NEW_AT = 0xFFFFFFFF, 33, 35
#: Bits of the table of one alignment; a larger one is halved.
TABLE_BITS = 1 << 28


def _marks(attributes: str) -> tuple[list[str], str, bool]:
    """Names in class and id, the role, and whether the element is hidden."""
    names: list[str] = []
    role, hidden = "", False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names += value.split()
        elif name == "role":
            role = value.strip().lower()
        else:
            hidden |= name == "hidden" or bool(HIDDEN.search(value))
    return names, role, hidden


def _says(name: str, words: frozenset[str], names: list[str]) -> bool:
    """Does a name of an element mean one of the words, and not something that is only called after it?

    ``top-ad`` and ``commentList`` do; ``has-sidebar`` and ``related-none`` speak of the layout, ``social-history`` and
    ``ad-1914`` of something else, and ``sidebar-left`` beside a name like ``content`` of where that element's sidebar is.
    """
    parts = [w.lower() for w in WORDS.findall(name)]
    if not words.intersection(parts) or LAYOUT.intersection(parts):
        return False
    numbers = [w for w in parts if w.isdigit()]
    if len(numbers) == 1 and len(numbers[0]) == 4 and numbers[0][:2] in ("10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20"):
        return False  # a year
    if any(w not in words and w not in BESIDE and w not in BOXES and not w.isdigit() for w in parts):
        return False
    return not (PLACES.intersection(parts) and any(n.lower() in WHOLE for n in names if n != name))


def _kind(name: str, attributes: str, within: int, wraps: bool) -> int:
    """The kind of an element's lines, from its own marks and the element it stands in.

    A form that ``wraps`` the page counts like any other block.
    """
    names, role, hidden = _marks(attributes) if attributes.strip(" /") else ([], "", False)
    if within == BESIDE_LINE or (name in SKIPPED and not wraps) or hidden or role in ROLES:
        return BESIDE_LINE
    if name in ("html", "body"):
        return within
    if any(_says(n, BESIDE, names) for n in names) or (name == "header" and within != ARTICLE_LINE):
        return BESIDE_LINE
    if within != ARTICLE_LINE and any(_says(n, EDGES, names) and not OWN.intersection(w.lower() for w in WORDS.findall(n)) for n in names):
        return BESIDE_LINE
    if name == "article" or within == ARTICLE_LINE:
        return ARTICLE_LINE
    return MAIN_LINE if name == "main" or role == "main" else within


def lines(page: str) -> tuple[list[str], list[int]]:
    """The page's blocks in order, white space as one space, and the kind of each."""
    return blocks(page)[:2]


def blocks(page: str) -> tuple[list[str], list[int], list[int]]:
    """The lines of the page, and of each which outermost article element (from 1) was the last to begin."""
    texts: list[str] = []
    kinds: list[int] = []
    articles: list[int] = []
    begun = 0
    held: list[str] = []
    stack: list[tuple[str, int, list[str] | None]] = []  # name, kind, and the block that it interrupts
    kind, at = PLAIN_LINE, 0
    ahead = {HOLDS: -1, FORM_END: -1}  # where the next of each begins

    def following(what: re.Pattern) -> int:
        if ahead[what] < at:
            found = what.search(page, at)
            ahead[what] = found.start() if found else len(page)
        return ahead[what]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                texts.append(text)
                kinds.append(kind)
                articles.append(begun)

    def leave(depth: int) -> None:
        """Close all elements from ``depth`` on; a block that one of them interrupted goes on."""
        nonlocal kind
        broken = [s for _, _, s in stack[depth:] if s is not None]
        outer = stack[depth - 1][1] if depth else PLAIN_LINE
        if broken or outer != kind:
            flush()
        del stack[depth:]
        kind = outer
        held.extend(x for s in broken for x in s)

    while found := TOKEN.search(page, at):
        if found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        close, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if name in ("br", "td", "th"):
            held.append(" ")
            if name == "br":
                continue
        if close:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name in BLOCKS:
                flush()
            if depth is not None:
                leave(depth)
            continue
        if name in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                leave(len(stack) - 1)
        if name in VOID or attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        wraps = name == "form" and kind != ARTICLE_LINE and following(HOLDS) < following(FORM_END)
        inner, broken = _kind(name, attributes, kind, wraps), None
        if inner != kind and name not in BLOCKS:
            broken = list(held)
            held.clear()
        elif inner != kind:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
        stack.append((name, inner, broken))
        begun += inner == ARTICLE_LINE != kind
        kind = inner
    held.append(page[at:])
    flush()
    leave(0)
    flush()
    return texts, kinds, articles


def chosen(kinds: list[int]) -> int:
    """The kind that holds the main text if no other page tells: article elements before main, main before other lines."""
    return next((k for k in (ARTICLE_LINE, MAIN_LINE) if k in kinds), PLAIN_LINE)


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Rows of the table are kept as bits of whole numbers; equal ends are cut off first, values that
    the other side lacks cannot match, and a table above ``TABLE_BITS`` is halved (Hirschberg), so that
    memory stays bounded.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    left = [i for i in range(head, len(a) - tail) if a[i] in both]
    right = [x for x in b[head : len(b) - tail] if x in both]
    middle = [left[i] for i in _subsequence([a[i] for i in left], right)] if left else []
    return [*range(head), *middle, *range(len(a) - tail, len(a))]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each element of ``a``, the zero bits count the longest common subsequence with prefixes of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _subsequence(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        for first in _rows(a[:half], b):
            pass
        for second in _rows(a[half:][::-1], b[::-1]):
            pass
        ahead = np.concatenate([[0], np.cumsum(1 - _bits(first, len(b)))])
        back = np.concatenate([[0], np.cumsum(1 - _bits(second, len(b)))])
        cut = int((ahead + back[::-1]).argmax())
        return _subsequence(a[:half], b[:cut]) + [half + i for i in _subsequence(a[half:], b[cut:])]
    table = [(1 << len(b)) - 1, *_rows(a, b)]
    found, j = [], len(b)
    for i in range(len(a), 0, -1):
        if not j:
            break
        # The last length step below j that row i has: if row i - 1 has it too, a[i - 1] is not needed.
        now = ~table[i] & (1 << j) - 1
        if not now:
            break
        before = ~table[i - 1] & (1 << j) - 1
        if before.bit_count() < now.bit_count():
            found.append(i - 1)
            at = next(k for k in range(j - 1, -1, -1) if b[k] == a[i - 1] and (~table[i - 1] & (1 << k) - 1).bit_count() == now.bit_count() - 1)
            j = at
    return found[::-1]


def _bits(row: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)


def _numbered(texts: list[str], kinds: list[int], articles: list[int]) -> list[int]:
    """One whole number for each line, which holds all that an alignment needs."""
    made, last = [], 0
    for text, kind, article in zip(texts, kinds, articles):
        new = kind == ARTICLE_LINE and article != last
        last = article if new else last
        made.append(new << NEW_AT | kind << KIND_AT | xxhash.xxh32_intdigest(text) << 1 | (kind != BESIDE_LINE))
    return made


def _shared(own: list[int], path: str, neighbours: list[tuple[str | None, list[int] | None]]) -> list[int]:
    """Numbers of the lines beside no furniture that the neighbour with the longest common path start has too."""
    real = [(p, x) for p, x in neighbours if x is not None]
    if not real:
        return []

    def start(p: str) -> int:
        return next((k for k, (x, y) in enumerate(zip(p, path)) if x != y), min(len(p), len(path)))

    return _met(own, max(real, key=lambda n: start(n[0]))[1])


def _met(own: list[int], other: list[int]) -> list[int]:
    hit = set(common([x >> 1 & HASH for x in own], [x >> 1 & HASH for x in other]))
    return [i for i, x in enumerate(own) if x & 1 and i in hit]


def _marked(own: list[int]) -> dict[tuple[int, int], list[int]]:
    """The numbers of the lines of each article element, and of main, by kind and place."""
    found: dict[tuple[int, int], list[int]] = {}
    article = 0
    for i, x in enumerate(own):
        kind = x >> KIND_AT & 3
        article += x >> NEW_AT & 1
        if kind in (ARTICLE_LINE, MAIN_LINE):
            found.setdefault((kind, article if kind == ARTICLE_LINE else 0), []).append(i)
    return found


def _left(own: list[int], shared: list[int], furniture: set[tuple[int, int]]) -> list[int] | None:
    """Numbers of the lines of the main text; null if that is what markup alone would take.

    Of the elements that are marked and not the site's ``furniture`` the articles are the text, else main, each
    as a whole; else the plain lines that are not ``shared``. If no line is left so, nothing but markup tells.
    """
    marked = _marked(own)
    plain = [i for i, x in enumerate(own) if x >> KIND_AT & 3 == PLAIN_LINE]
    first = next((k for k in (ARTICLE_LINE, MAIN_LINE) if any(k == kind for kind, _ in marked)), PLAIN_LINE)
    simple = sorted(i for (kind, _), at in marked.items() if kind == first for i in at) if marked else plain
    for k in (ARTICLE_LINE, MAIN_LINE):
        left = sorted(i for (kind, n), at in marked.items() if kind == k and (kind, n) not in furniture for i in at)
        if left:
            return None if left == simple else left
    gone = set(shared)
    left = [i for i in plain if i not in gone]
    return None if left == simple or marked and not left else left


def _beside(own: list[int], path: str, neighbours: list[tuple[str | None, list[int] | None]]) -> tuple[list[int] | None, bool]:
    """What is left of a page after its alignment with the nearer neighbour, and whether others must be asked."""
    shared = _shared(own, path, neighbours)
    met = set(shared)
    if len(shared) > COPY * sum(x & 1 for x in own) or any(met.issuperset(at) for at in _marked(own).values()):
        return None, True
    return _left(own, shared, set()), False


def _among(own: list[int], path: str, others: list[tuple[str, list[int]]]) -> tuple[list[int] | None, bool]:
    """The same after alignment with several pages: plain lines must be in that which shares least, marked elements in all that are no near copies.

    Paths that differ in query or fragment only are parts of one page, say of its comments, and do not count for these.
    """
    shared = [_met(own, x) for _, x in others]
    bare = QUERY.split(path, 1)[0]
    witnesses = [set(x) for x, (p, _) in zip(shared, others) if len(x) <= COPY * sum(y & 1 for y in own) and QUERY.split(p, 1)[0] != bare]
    furniture = {r for r, at in _marked(own).items() if len(witnesses) >= WITNESSES and all(w.issuperset(at) for w in witnesses)}
    return _left(own, min(shared, key=len), furniture), False


#: Pages that a task holds as lists at once, besides as many that come before them.
STEP_ROWS = 1000


def _answers(batch: pa.RecordBatch, columns: list[str], found: list[tuple[list[int] | None, bool | None]]) -> pa.RecordBatch:
    made = [pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.bool_())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], [*columns, "left", "doubt"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in page order with what is left of each beside its neighbours; doubt is null for the first and last row, which have one here."""
    columns = ["host", "path", "same", "lines"]

    def solved(batch: pa.RecordBatch, rows: list[tuple], before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        found: list[tuple[list[int] | None, bool | None]] = []
        for last, (host, path, own), following in zip([before, *rows[:-1]], rows, [*rows[1:], after]):
            if not any(x & 1 for x in own):
                found.append((None, False))
            elif last is None or following is None:
                found.append((None, None))
            else:
                near = [(p, x) for h, p, x in (last, following) if h == host]
                found.append(_beside(own, path, near) if near else (None, False))
        return _answers(batch, columns, found)

    before, held, rows = None, None, []
    for batch in (b.slice(k, STEP_ROWS) for b in batches for k in range(0, b.num_rows, STEP_ROWS)):
        coming = list(zip(*[batch.column(c).to_pylist() for c in ("host", "path", "lines")]))
        if held is not None:
            yield solved(held, rows, before, coming[0])
            before = rows[-1]
        held, rows = batch, coming
    if held is not None:
        yield solved(held, rows, before, None)


def differences(parsed: DataFrame) -> DataFrame:
    """Pages that are ``parsed`` whose main text is not what markup alone would take: rows (c_url, c_mark, left), left the numbers (from 0) of its lines.

    Pages stand in order of host and path (lower-case host; query and fragment count last). Pages of a host
    with equal lines are copies: they stand as one, where the first of them does, and lose the same lines. Every
    page that has a line beside no furniture, marked or not, is aligned with one of its two neighbours on the same host, the one whose path
    begins alike for longer. If more than 75 % of these lines are shared, they may be near copies; so may a marked
    article or main be a copy if all its lines are. Then the page is aligned with unlike pages further away on both sides
    too (``FURTHER``): a template is shared with all of them, a copied text is not. Plain lines go that the one has which shares least; a
    marked element goes if all that are no near copies nor the same path with another query, two at least, have it. A page without an unlike one on its host loses nothing.
    The order is global: pages are range-sorted and numbered through partition counts, so a host
    with a third of all pages is many tasks, each of which reads its rows as a stream; only line hashes move. Equal pages (url and html)
    are one.
    """
    spark = parsed.sparkSession
    place = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = parsed.withColumn("host", F.lower(F.regexp_extract(place, r"^[^/?#]*", 0))).withColumn("path", F.regexp_replace(place, r"^[^/?#]*", ""))
    order = ["host", "path", "mark"]
    rows = rows.select("url", "mark", "host", "path", "lines").dropDuplicates(["url", "mark"])
    every = stored(rows.withColumn("same", F.xxhash64("lines")), "page-lines")
    rows = every.groupBy("host", "same", "lines").agg(F.min(F.struct("path", "mark")).alias("at")).select("host", "same", "at.*", "lines")
    rows = stored(rows, "page-kinds").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("host", "path", "same", "lines")
    rows = rows.mapInArrow(_in_order, "host string, path string, same long, lines array<long>, left array<int>, doubt boolean")
    rows = stored(rows.withColumn("pos", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("pos", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = stored(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "page-parts")
    rows = rows.withColumn("part", part).join(F.broadcast(base), "part").withColumn("nth", F.col("base") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)))
    other = rows.select(F.col("nth").alias("at"), F.col("host").alias("o_host"), F.struct("nth", "path", "lines").alias("other"))

    def compared(asking: DataFrame, steps: tuple[int, ...], align, few: bool = False) -> DataFrame:
        asked = asking.select("nth", "host", F.explode(F.array(*[F.col("nth") + d * k for k in steps for d in (-1, 1)])).alias("at"))
        met = (F.broadcast(asked) if few else asked).join(other, "at").where("host = o_host").groupBy("nth").agg(F.sort_array(F.collect_list("other")).alias("others"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for own, path, others in zip(*[batch.column(c).to_pylist() for c in ("lines", "path", "others")]):
                    found.append(align(own, path, [(n["path"], n["lines"]) for n in others]))
                yield _answers(batch, ["nth", "host", "same"], found)

        return asking.join(met, "nth").select("nth", "host", "same", "path", "lines", "others").mapInArrow(run, "nth long, host string, same long, left array<int>, doubt boolean")

    # The first and last rows of the partitions, two of each at most.
    ends = stored(compared(rows.where("doubt IS NULL").select("nth", "host", "same", "path", "lines"), (1,), _beside, few=True), "page-ends")
    near = rows.where("doubt IS NOT NULL").select("nth", "host", "same", "left", "doubt").unionAll(ends)
    again = compared(rows.select("nth", "host", "same", "path", "lines").join(near.where("doubt").select("nth"), "nth"), FURTHER, _among)
    cut = near.unionAll(again).where("left IS NOT NULL").select("host", "same", "left")
    return every.join(cut, ["host", "same"]).select(F.col("url").alias("c_url"), F.col("mark").alias("c_mark"), "left")


def parse(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Each page read once: its other columns as ``row``, url, mark (a hash of the page), and its lines.

    ``found`` holds the lines that stand beside no furniture and null for all others, ``numbers`` says which of them markup alone would take,
    ``lines`` has a number for each line, furniture too, to align pages by.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in text_steps(batch, "page"):
                found, numbers, hashes = [], [], []
                for text in step.column("page"):
                    texts, kinds, articles = blocks(text.as_py() or "")
                    kind = chosen(kinds)
                    found.append([t if k != BESIDE_LINE else None for t, k in zip(texts, kinds)])
                    numbers.append([i for i, k in enumerate(kinds) if k == kind])
                    hashes.append(_numbered(texts, kinds, articles))
                made = [pa.array(found, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[step.column(c) for c in ("row", "url", "mark")], *made], ["row", "url", "mark", "found", "numbers", "lines"])

    others = [c for c in pages.columns if c != page]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), F.col(url).cast("string").alias("url"), F.xxhash64(page).alias("mark"), F.col(page).cast("string").alias("page"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(read, f"row {kind}, url string, mark long, found array<string>, numbers array<int>, lines array<long>")


#: Pages with differences up to which their line numbers are sent to the readers; beyond, they are joined by a shuffle.
FEW_PAGES = 20_000


def main_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Every row and column of ``pages`` but the html, with ``text`` (main text, blocks joined by line feeds).

    Every page is aligned with the page nearest by URL, and what both have is the site's (``differences``); markup then
    checks what is the page's own. Lines beside marked navigation or other furniture never are the text. Of the others the article elements
    that hold lines of the page's own are the text, else main if it does, else the plain lines that are the page's own.
    The shared lines of an article or main that has own ones stay: pages that quote or copy each
    other would lose text. Line breaks and table cells are white space.

    A null or empty page has empty text. A null url is a host of its own. Repeated pages are
    one page and get the same text. A column that is called text already is replaced.
    """
    rows = stored(parse(pages, url, page), "page-texts")
    told = stored(differences(rows), "page-differences")
    if told.count() <= FEW_PAGES:
        told = F.broadcast(told)
    rows = rows.join(told, F.col("url").eqNullSafe(F.col("c_url")) & (F.col("mark") == F.col("c_mark")), "left")
    text = F.array_join(F.transform(F.coalesce("left", "numbers"), lambda i: F.get("found", i)), "\n")
    others = [c for c in pages.columns if c != page]
    return rows.select(*[F.col(f"row.`{c}`") for c in others if c != "text"], text.alias("text"))
