"""Main text by wrapper inference: union-free regular expressions over the token streams of a host's pages.

A page is a stream of block tags (with class, id and role) and text slots. Repeats in a stream are folded into repeated groups;
the distinct folded streams of a host are aligned one after the other, level by level, and each element that doesn't match becomes a
repeat of what stands beside it or an optional group. The result is the host's wrapper. Its slots are told apart by where they stand: slots inside
an article (or the main part, or else the page) are main text unless menus, headers, footers, sidebars, notices, adverts, forms
or comments hold them. A page's text is what its tokens put into its host's main slots, those of the best rank (RANKS) that
the page has text in. Where a page has neither article nor main part, a slot's text that more than half of the host's different pages of
that kind (three at least) have at the same place is part of the wrapper, not of the text, unless nothing else would be left.

Only distinct folded streams are shuffled, dealt by a hash of the stream into groups of about PART, and the groups' wrappers are merged FAN
at a time, so a host with a third of all pages merges in many tasks, a tree of them. The wrappers are a stored table that Catalyst
broadcasts only if its measured size allows it.

Defined cases: null html has the empty text and 0 characters; a null url counts as the host ""; broken markup, cut off or unclosed,
is read as far as it goes; html and body tags may be missing; a page without main slots has the empty text; repeated rows are each
returned, and equal pages of a host count once; long pages are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.common import documents, release, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(script|style|noscript|template|svg|iframe|textarea|select|title|math|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Fixed names of HTML: elements inside a line of text, elements without an end, and those that an opening one ends.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track".split())
ENDED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Elements, roles and words of class or id that hold no main text.
OTHER = set("nav header footer aside form button menu dialog head canvas audio video".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
OTHER_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_WORDS = set("article content entry post story main".split())
#: First words of names such as has-sidebar, which tell of a page and not of the element.
NOT_OTHER = set("has have is no not with without".split())
#: What holds main text, best first; "beside" is an article or main part within an element that is other by its class or id.
RANKS = ("article", "main", "beside", "")
LONGEST_REPEAT = 8
#: Streams of a group on average, and wrappers merged at a time.
PART, FAN = 64, 16


def key_of(name: str, attributes: str) -> str:
    """An element's key: its name with class, id and role in lower case, digits as 0; of html and body the role alone."""
    if not attributes:
        return name
    found = [f"{a.lower()}={v.strip('\"\'').lower()}" for a, v in ATTRIBUTE.findall(attributes) if name not in ("html", "body") or a.lower() == "role"]
    return re.sub(r"[\s<>()+?/]+", ".", re.sub(r"\d+", "0", " ".join([name, *found])))


def read(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", path, text), ("break", path, "") and ("tag", token, "") of a page in order; a path is the open elements' keys."""
    stack: list[tuple[str, str]] = []
    path = ""
    for m in TOKEN.finditer(page):
        name = m[3]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", path, m[0]
            continue
        name = name.lower()
        if name in INLINE:
            continue
        if name in VOID:
            yield "break", path, ""
            continue
        if m[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is None:
                continue
            while len(stack) > at:
                yield "tag", f"</{stack.pop()[1]}>", ""
        else:
            ends = ENDED_BY.get(name, set()) | ({"p"} if name in BLOCKS_END_P else set())
            while stack and stack[-1][0] in ends:
                yield "tag", f"</{stack.pop()[1]}>", ""
            stack.append((name, key_of(name, m[4])))
            yield "tag", f"<{stack[-1][1]}>", ""
        path = "/".join(k for _, k in stack)
    while stack:
        yield "tag", f"</{stack.pop()[1]}>", ""


_UNIT = re.compile(r"(.{1,%d}?)\1+" % LONGEST_REPEAT, re.S)


def _fold(parts: list[str]) -> list[str]:
    """Neighbouring elements and slots with repeats of up to LONGEST_REPEAT of them written once."""
    if len(parts) < 2:
        return parts
    names = {x: chr(0x100000 + k) if k < 0xFFFE else "" for k, x in enumerate(dict.fromkeys(parts))}
    if "" in names.values():  # more kinds than characters for them
        return parts
    flat = "".join(map(names.__getitem__, parts))
    while (folded := _UNIT.sub(r"\1", flat)) != flat:
        flat = folded
    own = {c: x for x, c in names.items()}
    return [own[c] for c in flat]


def stream(page: str) -> str:
    """The page's tokens, text as <#>, with neighbouring repeats of whole elements written once."""
    stack: list[list[str]] = [[]]  # of each open element: its tag, then what it holds
    for kind, where, text in read(page):
        if kind == "tag" and where[1] != "/":
            stack.append([where])
        elif kind == "tag":
            first, *parts = stack.pop()
            stack[-1].append("".join([first, *_fold(parts), where]))
        elif kind == "text" and not text.isspace():
            stack[-1].append("<#>")
    return "".join(_fold(stack[0]))


Wrapper = list  # of tokens, and of ["+", Wrapper] and ["?", Wrapper] around a whole element or slot
Forest = list  # of [optional, repeated, opening tag or <#>, Forest]


def _plain(items: Wrapper) -> list[str]:
    return [t for x in items for t in (_plain(x[1]) if isinstance(x, list) else [x])]


def _forest(items: Wrapper) -> Forest:
    top: Forest = []
    stack, groups = [top], [(iter(items), False, False, 1)]
    while groups:
        left, optional, repeated, depth = groups[-1]
        x = next(left, None)
        here = len(stack) == depth  # a group's marks are those of what stands in it, not of what that holds
        if x is None:
            groups.pop()
        elif isinstance(x, list):
            groups.append((iter(x[1]), here and optional or x[0] == "?", here and repeated or x[0] == "+", len(stack)))
        elif x[1] == "/":
            stack.pop()
        else:
            node = [here and optional, here and repeated, x, []]
            stack[-1].append(node)
            if x != "<#>":
                stack.append(node[3])
    return top


def _items(forest: Forest) -> Wrapper:
    out: Wrapper = []
    work: list[tuple] = [(x, out) for x in reversed(forest)]
    while work:
        x, to = work.pop()
        if isinstance(x, str):
            to.append(x)
            continue
        optional, repeated, token, inner = x
        for mark in ["?"] * optional + ["+"] * repeated:
            to.append([mark, []])
            to = to[-1][1]
        to.append(token)
        if token != "<#>":
            work.append((f"</{token[1:]}", to))
            work += [(y, to) for y in reversed(inner)]
    return out


def _cover(forest: Forest, other: Forest) -> None:
    """Let ``forest`` also cover ``other``, level by level, so that what is put in holds whole elements and alternatives stay apart."""
    work = [(forest, other)]
    while work:
        a, b = work.pop()
        out: Forest = []
        for op, i, j, k, n in SequenceMatcher(None, [x[2] for x in a], [x[2] for x in b], autojunk=False).get_opcodes():
            if op == "equal":
                for x, y in zip(a[i:j], b[k:n], strict=True):
                    out.append([x[0] or y[0], x[1] or y[1], x[2], x[3]])
                    work.append((x[3], y[3]))
                continue
            for x in (*a[i:j], *b[k:n]):
                if out and out[-1][2] == x[2]:  # the element before stands again
                    out[-1][1] = True
                    work.append((out[-1][3], x[3]))
                else:
                    out.append([True, *x[1:]])
        a[:] = out


def align(wrapper: Wrapper, tokens: Wrapper) -> Wrapper:
    """A wrapper that also covers ``tokens``: elements that don't match become repeated or optional groups."""
    out = _forest(wrapper)
    _cover(out, _forest(tokens))
    return _items(out)


def infer(streams: list[str]) -> Wrapper:
    """One wrapper of distinct folded streams, the longest first."""
    wrapper: Forest = []
    for k, text in enumerate(sorted(set(streams), key=lambda x: (-len(x), x))):
        own = _forest(re.findall(r"<[^<>]*>", text))
        if k:
            _cover(wrapper, own)
        else:
            wrapper = own
    return _items(wrapper)


def _classes(rest: str) -> list[list[str]]:
    """The words of each class and id of a key, without digits at their ends."""
    return [words for x in re.sub(r"(?:class|id|role)=", " ", rest).replace(".", " ").split() if (words := [w for w in re.split(r"[^a-z]+", x) if w])]


def _role(key: str, within: bool = False) -> str:
    """"article", "main", "other", "word" (other by its class or id) or "", of an element ``within`` a main container or not.

    Words for other text count as whole names, and outside main containers also as what a name like site-header ends
    with; never on html and body, nor on the article or main element that is the container.
    """
    name, _, rest = key.partition(".")
    classes = _classes(rest)
    if name in OTHER or any(f"role={r}" in rest for r in OTHER_ROLES):
        return "other"
    if name in ("html", "body"):
        return "main" if "role=main" in rest else ""
    box = name in ("article", "main")
    whole = any(len(words) == 1 and words[0] in OTHER_WORDS for words in classes)
    if whole and (within or not box) or not within and not box and any(words[-1] in OTHER_WORDS and words[0] not in NOT_OTHER for words in classes):
        return "word"
    if name == "article":
        return "article"
    return "main" if name == "main" or "role=main" in rest or any(w in MAIN_WORDS for words in classes for w in words) else ""


def _roles(stack: list[str]) -> list[str]:
    out: list[str] = []
    within = False
    for key in stack:
        out.append(_role(key, within))
        within = within or out[-1] in ("article", "main")
    return out


def main_slots(wrapper: Wrapper) -> list[list[str]]:
    """Paths of the wrapper's slots that hold main text, by RANKS."""
    stack: list[str] = []
    found: dict[str, int] = {}
    for token in _plain(wrapper):
        if token == "<#>":
            roles = _roles(stack)
            held = next((r for r in ("article", "main") if r in roles), "")
            if held == "article":  # an article's own header keeps its headings
                roles = [r for k, r in zip(stack, roles, strict=True) if not (k.partition(".")[0] == "header" and re.match("h[1-6]", stack[-1]))]
            if held and "word" in roles and min(map(roles.index, {"article", "main"} & set(roles))) > max(k for k, r in enumerate(roles) if r == "word"):
                held, roles = "beside", [r for r in roles if r != "word"]
            if not {"other", "word"} & set(roles):
                found["/".join(stack)] = RANKS.index(held)
        elif token[1] != "/":
            stack.append(token[1:-1])
        else:
            stack.pop()
    return [sorted(p for p, r in found.items() if r == rank) for rank in range(len(RANKS))]


def main_blocks(page: str, slots: dict[str, int]) -> tuple[int | None, list[tuple[str, str]]]:
    """The page's best rank, and the path and text of each block in those of ``slots`` (path, rank) that have it.

    References are decoded, and white space is one space.
    """
    parts = list(read(page))
    best = min((slots[where] for kind, where, text in parts if kind == "text" and where in slots and html.unescape(text).strip()), default=None)
    blocks: list[tuple[str, str]] = []
    now: list[str] = []
    last = ""

    def close() -> None:
        if text := " ".join(html.unescape("".join(now)).split()):
            blocks.append((last, text))
        now.clear()

    for kind, where, text in parts:
        if kind == "text" and slots.get(where, -1) == best:
            if where != last:
                close()
                last = where
            now.append(text)
        elif kind != "text":
            close()
    close()
    return best, blocks


def place_hash(path: str, text: str) -> int:
    """Of a text at a place, as a signed number of 64 bits."""
    return xxh3_64_intdigest(f"{path}\0{text}".encode()) - (1 << 63)


def main_text(page: str, slots: dict[str, int], common: frozenset[int] = frozenset()) -> str:
    """The blocks' texts joined by one space, without those in ``common`` (place_hash) if others are left."""
    best, blocks = main_blocks(page, slots)
    if common and best == len(RANKS) - 1:
        blocks = [b for b in blocks if place_hash(*b) not in common] or blocks
    return " ".join(text for _, text in blocks)


def _ranks(slots: list[list[str]] | None) -> dict[str, int]:
    return {path: rank for rank, paths in enumerate(slots or ()) for path in paths}


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page (a hash of the html) and place (place_hash) of each block of pages without article or main part; place null once a page."""
    for batch in batches:
        found = set()
        for host, page, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            best, blocks = main_blocks(page, _ranks(slots))
            if best == len(RANKS) - 1:
                own = xxh3_64_intdigest(page.encode()) - (1 << 63)
                found |= {(host, own, place_hash(*b)) for b in blocks} | {(host, own, None)}
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "page", "place"])


def common_places(pages: DataFrame) -> DataFrame:
    """host and common, the place_hashes that are part of its wrapper; ``pages``: host, html, slots.

    A page has few such texts on average, so ``common`` is no longer than twice a page's blocks.
    """
    plain = pages.where(F.size(F.get("slots", F.lit(len(RANKS) - 1))) > 0).select("host", "html", "slots")
    counted = stored(plain.mapInArrow(_places, "host string, page long, place long").distinct().groupBy("host", "place").agg(F.count(F.lit(1)).alias("n")), "places")
    every = counted.where("place is null").select("host", F.col("n").alias("pages"))
    usual = counted.where("place is not null and n >= 3").join(every, "host").where("2 * n > pages")
    return usual.groupBy("host").agg(F.collect_set("place").alias("common"))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(host, stream(page)) for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 2, ["host", "stream"])


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of all wrappers (as JSON) of a group."""
    wrapper: Wrapper | None = None
    for x in sorted(set(group["wrapper"]), key=lambda x: (-len(x), x)):
        items = json.loads(x)
        wrapper = items if wrapper is None else align(wrapper, items)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "part": [group["part"].iloc[0]], "wrapper": [json.dumps(wrapper)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of all hosts of ``pages`` (host, html)."""
    distinct = stored(pages.mapInArrow(_streams, "host string, stream string").distinct(), "streams")
    sizes = stored(distinct.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), "sizes")
    most = sizes.agg(F.max("parts").alias("n")).first()["n"] or 0
    first = lambda g: pd.DataFrame({"host": [g["host"].iloc[0]], "part": [g["part"].iloc[0]], "wrapper": [json.dumps(infer(list(g["stream"])))]})
    dealt = distinct.join(sizes, "host").select("host", "stream", F.pmod(F.xxhash64("stream"), "parts").alias("part"))
    now = stored(dealt.groupBy("host", "part").applyInPandas(first, "host string, part long, wrapper string"), "wrappers")
    release(distinct, sizes)
    while most > 1:
        most = -(-most // FAN)
        merged = now.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("host", "part").applyInPandas(_merge, "host string, part long, wrapper string")
        now = stored(merged, "wrappers")
    return now.select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    own = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    slots = F.pandas_udf(lambda s: s.map(lambda x: main_slots(json.loads(x))), "array<array<string>>")
    known = stored(wrappers(own.select("host", "html")).select("host", slots("wrapper").alias("slots")), "slots")
    common = common_places(own.join(known, "host", "left"))
    known = stored(known.join(common, "host", "left"), "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, _ranks(s), frozenset(c or ())) for page, s, c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = own.join(known, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "slots", "common")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))
