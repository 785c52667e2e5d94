"""The main body of web pages, by deduction of the template that the pages of a host share.

Tokens are a page's lines (with the site's name and numbers as slots) and the items of navigation lines; a token's role is
the zone it stands in: before the page's first sentence, after its last, or between. A token's occurrence vector says how
often it occurs on each page of its host; tokens of a host with equal vectors form an equivalence class. A class is valid if
its support, its number of pages, is at least HOST_PAGES and HOST_SHARE of the host's, if it has at least CLASS_TOKENS
tokens, and if these stand in the same order on every page. The valid class with the greatest support is the host's root; it
cuts each page into slots. A smaller class is valid if it is nested: on every page it stands in the same slot of the root, and
that isn't the slot with most of the page's other tokens. So a line of the body that recurs on some pages of a host, whatever
their number, isn't taken for the template: it shares its vector with nothing, and stands in the main slot.

Besides, what holds on single hosts isn't enough here: most have too few pages for vectors to tell anything. So a second tier,
which isn't part of the method named, takes tokens for template that stand on GLOBAL_SHARE of all pages and on several hosts,
with the sites' names as slots, and also what stands before a colon or dash in a line. What is left between the tokens of the
template are slots. A slot's short lines (titles, teasers, tags) belong to the body if they name something that the body's
sentences, its commands or the breadcrumb speak of: words that are rare over all pages are taken as names. Headings and the
page's title, which stands before the first sentence, belong to it too, unless a token of the template stands before it that
leads teasers elsewhere.

All counts are over all pages. Only what is bounded by a share is broadcast: no more tokens than lines a page / GLOBAL_SHARE
and no more common words than words a page / COMMON_SHARE; a host's own tokens, at most lines a page / HOST_SHARE, travel
with its pages, and hosts that hold many pages are joined apart.

Cases: null and blank texts, and rows without an id, have no lines. Pages without a host are of the host ''. Rows repeated under one id count
once. A page may consist of boilerplate or of body only. Long pages are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.skew import left_join
from fathomline.storage import stage

#: Support of a class of a host, in pages and as a share of its pages, and tokens of one that needn't be nested.
HOST_PAGES, HOST_SHARE, CLASS_TOKENS = 4, 0.15, 2
GLOBAL_PAGES, GLOBAL_HOSTS, GLOBAL_SHARE = 4, 3, 0.0025
#: What stands before a colon must be on that share of all pages, as a colon also stands after names.
HEAD_SHARE = 0.004
#: A token leads teasers if at least that share of the lines after it, past the first sentence, are teasers.
LEADS = 0.5
COMMON_PAGES, COMMON_SHARE = 4, 0.015
#: Endings of sentences. Fixed values.
ENDINGS = (".", "?", "!", ".”", "?”", "!”", '."', '?"', '!"', ":", ".)", "»")

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_BULLET = re.compile(r"^(?:[#*•–—>-]+|\d+[.)])\s+")
_ITEMS = re.compile(r"\s*[|·•»>]\s*|\s+/\s+|\s{2,}")
_HEAD = re.compile(r"^(.{1,60}?)\s*(?::|\s[—–])(?=\s|$)")
_CUT = re.compile(r"(?:…|\.\.\.)\s*(?:[\[(][^\])]*[\])]|[»›>]+)?$")
_WORD = re.compile(r"[^\W\d_]+")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f​⁠﻿]")


def token(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def site_name(host: str) -> str:
    """The label that is registered: the one before the last."""
    labels = host.lower().split(".")
    return labels[-2].replace("-", " ") if len(labels) > 1 else ""


class Line:
    """One line of a page and its tokens."""

    __slots__ = ("bullet", "head", "items", "key", "text")

    def __init__(self, raw: str, site: re.Pattern | None) -> None:
        text = _CONTROL.sub("", raw).strip()
        low = text.lower()
        if site is not None:
            low = site.sub("§", low)
        low = _NUMBER.sub("0", low)
        bare = _BULLET.sub("", low)
        self.text = text
        self.bullet = bare != low and not text.startswith("#")
        self.key = " ".join(bare.split()).strip("“”\"' ")
        m = _HEAD.match(self.key)
        self.head = m[1] + m[0][len(m[1]) :].strip() if m else None
        parts = [x for x in _ITEMS.split(bare) if x]
        self.items = parts if len(parts) > 1 else []

    def tokens(self) -> list[str]:
        return [self.key, *([f"<{self.head}"] if self.head else []), *self.items]


def lines(text: str, host: str) -> list[tuple[int, Line]]:
    """The non-blank lines of a page with their numbers."""
    name = site_name(host)
    site = re.compile(rf"\b{re.escape(name)}\b") if name else None
    out = ((k, Line(x, site)) for k, x in enumerate(text.split("\n")) if x.strip())
    return [(k, x) for k, x in out if x.key]


def is_sentence(text: str) -> bool:
    return text.rstrip().endswith(ENDINGS)


def is_cut(text: str) -> bool:
    return bool(_CUT.search(text))


def names(text: str, common: set[int]) -> set[str]:
    """The rare words of a text."""
    return {w for w in map(str.lower, _WORD.findall(text)) if len(w) > 2 and token(w) not in common}


def judge(page: list[tuple[int, Line]], template: set[int], own: set[int], common: set[int], leads: set[int]) -> tuple[list[int], list[tuple[int, bool]]]:
    """The places in page of the body's lines; and, past the first sentence, each line of the template with whether the next line is a teaser.

    template: tokens of all pages' template; own: of the host's; leads: those of template that lead teasers.
    """
    known = lambda x: token(x) in template or token(x) in own
    n = len(page)
    kind = ["slot"] * n
    spoken: set[str] = set()
    for at, (_, line) in enumerate(page):
        text = line.text
        if known(line.key) or line.head and token(f"<{line.head}") in template:
            kind[at] = "fixed"
        elif is_cut(text):
            kind[at] = "teaser"
        if line.items and kind[at] != "teaser":
            fixed = sum(known(x) for x in line.items)
            crumbs = ">" in text and not is_sentence(text)
            if kind[at] == "slot" and (fixed * 2 >= len(line.items) or crumbs and fixed):
                kind[at] = "fixed"
            if crumbs:
                spoken |= names(line.items[-1], common)
        if kind[at] == "slot":
            if is_sentence(text):
                kind[at] = "sentence"
                spoken |= names(text, common)
            elif text.startswith(("$", "`")):
                kind[at] = "command"
                spoken |= names(text, common)
    first = next((at for at in range(n) if kind[at] == "sentence"), n)
    titled = False
    for at, (_, line) in enumerate(page):
        if kind[at] != "slot":
            continue
        named = names(line.text, common)
        before = page[at - 1][1] if at else None
        led = before is not None and kind[at - 1] != "sentence" and (kind[at - 1] == "teaser" or token(before.key) in leads)
        mine = not named or bool(named & spoken) or line.text.startswith("#") or line.bullet and _lower(line.key, line.text)
        if not mine and not titled and at < first and not led and not line.bullet and len(line.key.split()) > 1:
            mine = True
        titled |= mine and at < first
        kind[at] = "body" if mine else "teaser"
    at = 0
    while at < n:  # the items of a list share their fate
        to = at
        while to < n and page[to][1].bullet and kind[to] in ("body", "teaser"):
            to += 1
        if any(kind[k] == "body" for k in range(at, to)):
            kind[at:to] = ["body"] * (to - at)
        at = max(to, at + 1)
    followed = [(token(page[at][1].key), kind[at + 1] == "teaser") for at in range(first, n - 1) if kind[at] == "fixed" and token(page[at][1].key) in template]
    return [at for at in range(n) if kind[at] in ("sentence", "command", "body")], followed


def _lower(key: str, text: str) -> bool:
    """Does the text of a list's item start with a small letter?"""
    start = next((c for c in text if c.isalpha()), "")
    return start.islower() and key[:1] == start


def pages(chunks: DataFrame, files: DataFrame, key) -> DataFrame:
    """(id, host, text) of the chunks whose file is HTML, once per id. key: normalises ids to compare them."""
    kind = F.lower(F.trim(F.substring_index("file_type", ";", 1)))
    html = files.where(kind.rlike(r"^(?:text|application)/(?:x-)?x?htm(?:l)?(?:\+xml)?$|^x?html?$"))
    host = F.lower(F.regexp_extract("file_path", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    html = html.select(key(F.col("id")).alias("file"), F.coalesce(host, F.lit("")).alias("host")).where(F.col("file").isNotNull()).groupBy("file").agg(F.min("host").alias("host"))
    rows = chunks.where(F.col("chunk_text").isNotNull() & F.col("file_id").isNotNull()).select("id", key(F.col("file_id")).alias("file"), F.col("chunk_text").alias("text"))
    return rows.join(html, "file").select("id", "host", "text").dropDuplicates(["id"])


def parsed(found: DataFrame) -> DataFrame:
    """found with each page's tokens in their order, with their roles, and its heads."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, roles, heads = [], [], []
            for host, text in zip(*(batch.column(c).to_pylist() for c in ("host", "text")), strict=True):
                page = [line for _, line in lines(text, host)]
                said = [k for k, line in enumerate(page) if is_sentence(line.text) and not line.items]
                own, zones = [], []
                for k, line in enumerate(page):
                    zone = 0 if not said or k < said[0] else 2 if k > said[-1] else 1
                    mine = [line.key, *line.items]
                    own += map(token, mine)
                    zones += [zone] * len(mine)
                tokens.append(own)
                roles.append(zones)
                heads.append(sorted({token(f"<{line.head}") for line in page if line.head}))
            arrays = [*(batch.column(c) for c in ("id", "host", "text")), pa.array(tokens, pa.list_(pa.int64())), pa.array(roles, pa.list_(pa.int8())), pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "host", "text", "tokens", "roles", "heads"])

    return found.mapInArrow(parse, "id string, host string, text string, tokens array<long>, roles array<byte>, heads array<long>")


def _hash(*numbers: int) -> int:
    return token(",".join(map(str, numbers)))


def occurrences(found: DataFrame) -> DataFrame:
    """(host, token, role, n, vector): on how many pages of a host a token occurs in a role, and a signature of how often on which.

    The role of heads is -1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            vector: dict[tuple[str, int, int], int] = {}
            for i, host, tokens, roles, heads in zip(*(batch.column(c).to_pylist() for c in ("id", "host", "tokens", "roles", "heads")), strict=True):
                page = token(i)
                for (t, role), times in [*Counter(zip(tokens, roles, strict=True)).items(), *(((t, -1), 1) for t in heads)]:
                    k = (host, t, role)
                    n[k] += 1
                    vector[k] = vector.get(k, 0) ^ _hash(page, times)
            if n:
                keys = list(n)
                yield pa.RecordBatch.from_arrays([*(pa.array([k[at] for k in keys], kind) for at, kind in enumerate((pa.string(), pa.int64(), pa.int8()))), pa.array([n[k] for k in keys], pa.int64()), pa.array([vector[k] for k in keys], pa.int64())], ["host", "token", "role", "n", "vector"])

    parts = found.select("id", "host", "tokens", "roles", "heads").mapInArrow(count, "host string, token long, role byte, n long, vector long")
    return parts.groupBy("host", "token", "role").agg(F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"))


def common_words(found: DataFrame, total: int) -> list[int]:
    """Tokens of the words that at least COMMON_SHARE of all pages have: at most words a page / COMMON_SHARE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for text in batch.column("text").to_pylist():
                n.update(set(_WORD.findall(text.lower())))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([token(w) for w in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    words = found.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r["token"] for r in words.where(F.col("n") >= max(COMMON_PAGES, COMMON_SHARE * total)).collect()]


def equivalence_classes(seen: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, classes): the classes of each host that have support, as (vector, n, tokens with their roles)."""
    support: Column = F.col("n") >= F.greatest(F.lit(HOST_PAGES), F.col("of") * HOST_SHARE)
    often = left_join(seen.where((F.col("n") >= HOST_PAGES) & (F.col("role") >= 0)), sizes, ["host"]).where(support)
    classes = often.groupBy("host", "vector", "n").agg(F.sort_array(F.collect_list(F.struct("token", "role"))).alias("members"))
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("vector", "n", "members"))).alias("classes"))


def places(tokens: list[int], roles: list[int], classes: list[dict]) -> Iterator[tuple[int, int]]:
    """Of each class on a page, a signature of where it stands there: the order of its tokens, or for one that is too small its slot; 0 for the main slot."""
    first: dict[tuple[int, int], int] = {}
    for at, k in enumerate(zip(tokens, roles, strict=True)):
        first.setdefault(k, at)
    held = [(c["vector"], c["n"], [(m["token"], m["role"]) for m in c["members"]]) for c in classes]
    root = max((c for c in held if len(c[2]) >= CLASS_TOKENS), key=lambda c: (c[1], len(c[2]), c[0]), default=None)
    inside = {m for _, _, members in held for m in members}
    cuts = sorted(first[m] for m in root[2] if m in first) if root else []
    free: Counter = Counter(bisect(cuts, at) for at, k in enumerate(zip(tokens, roles, strict=True)) if k not in inside)
    main = max(free, key=lambda g: (free[g], -g), default=-1)
    for vector, _, members in held:
        at = sorted((first[m], m) for m in members if m in first)
        if not at:
            continue
        if len(members) >= CLASS_TOKENS:
            yield vector, _hash(*(x for _, m in at for x in m)) or 1
        elif root is None or not cuts:
            yield vector, 0
        else:
            gap = bisect(cuts, at[0][0])
            yield vector, 0 if gap == main else gap + 1


def valid_tokens(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, own): the tokens of the classes of each host that are ordered or nested alike on all their pages."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low: dict[tuple[str, int], int] = {}
            high: dict[tuple[str, int], int] = {}
            for host, tokens, roles, mine in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "roles", "classes")), strict=True):
                for vector, sign in places(tokens, roles, mine or []):
                    k = (host, vector)
                    low[k], high[k] = min(low.get(k, sign), sign), max(high.get(k, sign), sign)
            if low:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in low], pa.string()), pa.array([k[1] for k in low], pa.int64()), pa.array(list(low.values()), pa.int64()), pa.array(list(high.values()), pa.int64())], ["host", "vector", "low", "high"])

    signs = left_join(found.select("host", "tokens", "roles"), classes, ["host"]).where("classes is not null").mapInArrow(look, "host string, vector long, low long, high long")
    alike = signs.groupBy("host", "vector").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high and low <> 0").select("host", "vector")
    members = classes.select("host", F.explode("classes").alias("c")).select("host", F.col("c.vector").alias("vector"), F.col("c.members.token").alias("tokens"))
    return members.join(alike, ["host", "vector"], "left_semi").groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("own"))


def templates(found: DataFrame, total: int) -> tuple[list[int], DataFrame]:
    """The tokens of all pages' template, and (host, own): the tokens of each host's valid classes."""
    seen = stage(occurrences(found), "tokens")
    everywhere = seen.withColumn("head", F.col("role") < 0).groupBy("token", "head").agg(F.sum("n").alias("n"), F.countDistinct("host").alias("hosts"))
    share = F.when(F.col("head"), F.lit(HEAD_SHARE)).otherwise(F.lit(GLOBAL_SHARE))
    wide = everywhere.where((F.col("n") >= F.greatest(F.lit(GLOBAL_PAGES), share * total)) & (F.col("hosts") >= GLOBAL_HOSTS))
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    classes = stage(equivalence_classes(seen, sizes), "classes")
    own = stage(valid_tokens(found, classes), "own")
    return [r["token"] for r in wide.select("token").collect()], own  # at most lines a page / GLOBAL_SHARE


def leading(found: DataFrame, held) -> list[int]:
    """The tokens of the template that lead teasers: at most as many as the template has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, common = held.value
        for batch in batches:
            n: dict[int, list[int]] = {}
            for host, text in zip(*(batch.column(c).to_pylist() for c in ("host", "text")), strict=True):
                for t, yes in judge(lines(text, host), template, set(), common, set())[1]:
                    c = n.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += yes
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([c[0] for c in n.values()], pa.int64()), pa.array([c[1] for c in n.values()], pa.int64())], ["token", "n", "teasers"])

    sums = found.select("host", "text").mapInArrow(count, "token long, n long, teasers long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("teasers").alias("teasers"))
    return [r["token"] for r in sums.where(F.col("teasers") >= LEADS * F.col("n")).collect()]


def main_lines(found: DataFrame) -> DataFrame:
    """(id, line_no, line): the lines of the main body of each page of found (id, host, text). Lines count from 0."""
    rows = found.select("id", F.coalesce("host", F.lit("")).alias("host"), "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    found = stage(parsed(rows), "pages")
    context = found.sparkSession.sparkContext
    total = found.count()
    wide, own = templates(found, total)
    held = context.broadcast((set(wide), set(common_words(found, total))))
    ahead = context.broadcast(set(leading(found, held)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, common = held.value
        for batch in batches:
            out: list[tuple] = []
            for i, host, text, mine in zip(*(batch.column(c).to_pylist() for c in ("id", "host", "text", "own")), strict=True):
                page, raw = lines(text, host), text.split("\n")
                out += [(i, page[at][0], raw[page[at][0]]) for at in judge(page, template, set(mine or ()), common, ahead.value)[0]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["id", "line_no", "line"])

    return left_join(found, own, ["host"]).select("id", "host", "text", "own").mapInArrow(pick, "id string, line_no int, line string")


def main_text(found: DataFrame) -> DataFrame:
    """(id, text): the main body of each page that has one."""
    rows = main_lines(found).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    return rows.select("id", F.array_join("rows.line", "\n").alias("text"))
