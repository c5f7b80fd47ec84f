"""Main text of web pages, with boilerplate found by suffix arrays over each host's pages.

Pages of one host meet in one task, in groups of a few hundred (a host with more pages is dealt into groups by a hash). The
token streams of a group's pages are concatenated and sorted into a suffix array (prefix doubling up to the least length of a
repeat). Runs of at least REPEAT tokens that occur on two distinct pages or more are boilerplate. Where a host's pages do not fit
one group, runs that pages of different groups share are found too, exactly up to equal 64-bit hashes: the hashes of all its runs
of REPEAT tokens meet by hash, and each group is sent those of its runs that two pages of the host have. Hosts on which every block
is an aside or in an article need no such pass, as repeats decide nothing there.

A page's blocks come from its markup: containers that hold something else than text for readers (menus, site headers, footers,
sidebars, notices, adverts, forms, comments, scripts, styles) are out by their element, role or class. What is in the article (or
main) element then stays whole, also if other pages repeat it, since copies of an article are articles. Outside it, and on a page
that marks no article, the covered tokens of repeated runs are removed and the unique runs kept.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one line break. A null
page counts as empty; an empty one, or one without main text, has the empty text. Repeated rows of one page id count
as one page for repeats. Rows without an address share the empty host. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, tidied, written

REPEAT = 8
GROUP = 256
GROUP_CHARS = 1 << 24
HELD_RUNS = 1 << 19
BUCKET_BYTES = 1 << 22
_RUN = mix(np.arange(9000, 9000 + REPEAT, dtype=np.uint64)) | np.uint64(1)

#: What the elements of HTML are for.
RAW = frozenset("script style template noscript iframe object svg math canvas audio video".split())
ASIDE = frozenset("head nav header footer aside form button select option textarea fieldset datalist dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul caption".split())
SPACED = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = BLOCK - frozenset(("html", "body", "head", "title"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASSES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr
notice notices popup modal overlay newsletter subscribe signup sidebar sidenav widget widgets menu menus nav navbar navigation topnav breadcrumb breadcrumbs
footer header masthead comment comments disqus reply replies respond responses share sharing social related recommended toolbar pagination pager login search skip""".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if tag in ARTICLE or tag in ("html", "body") or not attributes:
        return False
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value.strip() in ROLES:
                return True
        elif not CLASSES.isdisjoint(_PARTS.split(value)):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, aside) of each block of text, in page order; scripts and the like are left out."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool]] = []
    text: list[str] = []
    aside = article = 0

    def end() -> None:
        words = html.unescape("".join(text)).split()
        text.clear()
        if words:
            out.append((" ".join(words), article > 0, aside > 0))

    def pop() -> None:
        nonlocal aside, article
        name, off = stack.pop()
        aside -= off
        article -= name in ARTICLE

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end()
        elif tag in SPACED:
            text.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK and any(t in BLOCK for t, _ in stack[i + 1 :]):
                        break  # an inline end tag closes no block
                    while len(stack) > i:
                        pop()
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = close.end() if close else n
            continue
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCK:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] == tag == "li":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in BLOCK:
                    break
        off = _is_aside(tag, m[3])
        stack.append((tag, off))
        aside += off
        article += tag in ARTICLE
    end()
    return out


def suffix_ranks(tokens: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Ranks of the suffixes by their first d tokens (equal where these are equal), d being the least power of two >= least."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, d = len(rank), 1
    while d < least:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - d)] = rank[d:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        d *= 2
    return rank, d


def covered(pages: list[list[str]], owner: list, least: int = REPEAT) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of at least `least` tokens that pages of two owners have."""
    ids: dict[str, int] = {}
    stream, first = [], [0]
    for i, tokens in enumerate(pages):
        stream += [ids.setdefault(t, len(ids)) for t in tokens]
        stream.append(-1 - i)  # no run reaches over it
        first.append(len(stream))
    rank, d = suffix_ranks(np.array(stream, np.int64), least)
    who = np.repeat(np.unique([str(o) for o in owner], return_inverse=True)[1], np.diff(first))
    order = np.lexsort((who, rank))
    r, w = rank[order], who[order]
    lead = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    several = np.minimum.reduceat(w, lead) != np.maximum.reduceat(w, lead)
    starts = order[np.repeat(several, np.diff(np.r_[lead, len(r)]))]
    step = np.zeros(len(stream) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + d, len(stream)), -1)
    on = np.cumsum(step[:-1]) > 0
    return [on[a : b - 1] for a, b in zip(first[:-1], first[1:])]


def stream_of(page: list[tuple[str, bool, bool]]) -> list[str]:
    return [t for text, _, off in page for t in (f"<{off}>", *text.split(" "))]


def is_marked(page: list[tuple[str, bool, bool]]) -> bool:
    return any(art and not off for _, art, off in page)


def asks(page: list[tuple[str, bool, bool]]) -> bool:
    """Whether repeats decide on any block of the page."""
    marked = is_marked(page)
    return any(not off and not (marked and art) for _, art, off in page)


class Hashes(dict):
    """Text -> 64-bit hash; emptied when full, so that its size stays bounded."""

    def __missing__(self, text: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        h = self[text] = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def runs(self, host: str, tokens: list[str]) -> np.ndarray:
        """Hashes of the runs of REPEAT tokens on the host, by their first token."""
        n = len(tokens) - REPEAT + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        h = mix(np.array([self[t] for t in tokens], np.uint64))
        total = np.full(n, self[host], np.uint64)
        for i in range(REPEAT):
            total += h[i : i + n] * _RUN[i]
        return mix(total)


def squeezed(runs: np.ndarray, owner: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries (run, owner, asking group or 0) that tell as much: of each run every group once, and two owners if there are two."""
    order = np.lexsort((owner, runs))
    r, o, g = runs[order], owner[order], group[order]
    lead = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    last = np.r_[lead[1:], len(r)] - 1
    two = o[lead] != o[last]
    low = np.repeat(o[lead], last - lead + 1)
    some = np.logical_or.reduceat(g != 0, lead)
    by = np.lexsort((g, r))
    by = by[(g[by] != 0) & np.r_[True, (r[by][1:] != r[by][:-1]) | (g[by][1:] != g[by][:-1])]]
    plain = np.zeros(int((~some).sum()) + int(two.sum()), g.dtype)
    return np.r_[r[by], r[lead[~some]], r[lead[two]]], np.r_[low[by], o[lead[~some]], o[last[two]]], np.r_[g[by], plain]


def extract_group(pages: list[str], owner: list, host: str = "", shared: np.ndarray | None = None) -> list[str]:
    """The main texts of pages of one host. shared: hashes of runs that are known to lie on two pages of the host."""
    parsed = [blocks(p) for p in pages]
    streams = [stream_of(page) for page in parsed]
    texts, hashes = [], Hashes()
    for page, tokens, on in zip(parsed, streams, covered(streams, owner)):
        if shared is not None and asks(page):
            for at in np.flatnonzero(np.isin(hashes.runs(host, tokens), shared)).tolist():
                on[at : at + REPEAT] = True
        marked = is_marked(page)
        kept, at = [], 0
        for text, art, off in page:
            words = text.split(" ")
            live = ~on[at + 1 : at + 1 + len(words)]
            at += 1 + len(words)
            if off:
                continue
            if marked and art:
                kept.append(text)
            elif live.any():
                edge = np.flatnonzero(np.diff(np.r_[True, live, True]))
                for a, b in zip(edge[::2], edge[1::2]):
                    if b - a < REPEAT:  # the end of a repeat that began in another block, or common words
                        live[a:b] = True
                kept.append(" ".join(w for w, x in zip(words, live) if x))
        texts.append("\n".join(kept))
    return texts


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit(""))


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (html, host): the hosts with a page on which repeats decide."""
    found: set[str] = set()
    for batch in batches:
        new = {host for h, host in zip(*(c.to_pylist() for c in batch.columns)) if host not in found and asks(blocks(h))}
        found |= new
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.string())], ["host"])


def _entries(buckets: int):
    """Over (id, html, host, g): rows (bucket, runs, owners, groups) of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def flush():
            r, o, g = squeezed(*(np.concatenate(x) for x in zip(*held)))
            b = (r % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((g, o, b))
            r, o, g, b = r[order], o[order], g[order], b[order]
            lead = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            cuts = list(zip(lead.tolist(), [*lead[1:].tolist(), len(b)]))
            blobs = [pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in (r, o, g)]
            return pa.RecordBatch.from_arrays([pa.array(b[lead], pa.int64()), *blobs], ["bucket", "r", "o", "g"])

        for batch in batches:
            for id_, h, host, g in zip(*(c.to_pylist() for c in batch.columns)):
                page = blocks(h)
                runs = np.unique(hashes.runs(host, stream_of(page)))
                if len(runs):
                    held.append((runs, np.full(len(runs), hashes[str(id_)], np.uint64), np.full(len(runs), g if asks(page) else 0, np.int64)))
                    size += len(runs)
                if size >= HELD_RUNS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of _entries() sorted by bucket: of each asking group (g) the runs that two owners have."""
    at, held, size, least = None, [], 0, 0

    def end():
        r, o, g = squeezed(*(np.concatenate(x) for x in zip(*held)))
        order = np.lexsort((o, r))
        r, o, g = r[order], o[order], g[order]
        lead = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        n = np.diff(np.r_[lead, len(r)])
        on = np.repeat(o[lead] != o[lead + n - 1], n) & (g != 0)
        r, g = r[on], g[on]
        order = np.lexsort((r, g))
        r, g = r[order], g[order]
        lead = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        blobs = [r[i:j].tobytes() for i, j in zip(lead.tolist(), [*lead[1:].tolist(), len(g)])]
        return pa.RecordBatch.from_arrays([pa.array(g[lead], pa.int64()), pa.array(blobs, pa.binary())], ["g", "runs"])

    for batch in batches:
        for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if held and bucket != at:
                yield end()
                held, size, least = [], 0, 0
            at = bucket
            held.append(tuple(np.frombuffer(x, t) for x, t in zip(blobs, (np.uint64, np.uint64, np.int64))))
            size += len(held[-1][0])
            if size > max(4 * HELD_RUNS, 2 * least):
                held = [squeezed(*(np.concatenate(x) for x in zip(*held)))]
                size = least = len(held[0][0])
    if held:
        yield end()


def shared_runs(dealt: DataFrame, split: DataFrame) -> DataFrame | None:
    """g, runs (hashes) of the groups of split hosts; None if repeats decide nothing on these. split: host, bytes."""
    size = split.agg(F.sum("bytes")).first()[0]
    if size is None:
        return None
    ours = dealt.join(F.broadcast(split.select("host")), "host", "left_semi")
    hosts = written(ours.select("html", "host").mapInArrow(tidied(_asking), "host string").distinct(), "asking-hosts")
    if hosts.isEmpty():
        return None
    rows = ours.join(F.broadcast(hosts), "host", "left_semi").select("id", "html", "host", "g")
    entries = rows.mapInArrow(tidied(_entries(size // BUCKET_BYTES + 1)), "bucket bigint, r binary, o binary, g binary")
    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_shared), "g bigint, runs binary")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", group: int = GROUP) -> DataFrame:
    """key, url, text, n_chars of each row. Hosts with over a hundred-thousandth of all pages (so a hundred thousand at
    most) are dealt into groups by a hash; smaller ones are one run of rows, cut into groups as they pass. Groups of one host
    learn from each other by shared_runs()."""
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    counts = written(rows.groupBy("host").agg(F.count("*").alias("count"), F.sum(F.octet_length("html")).alias("bytes")), "hosts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    large = [(r["host"], -(-r["count"] // group)) for r in counts.where(F.col("count") > max(2 * group, total / 100_000)).collect()]
    deal = F.broadcast(spark.createDataFrame(large, "host string, m int"))
    part = F.pmod(F.xxhash64("id", "url"), F.coalesce("m", F.lit(1))).cast("int")
    dealt = rows.join(deal, "host", "left").select("id", "url", "html", "host", part.alias("part")).withColumn("g", F.xxhash64("host", "part"))
    shared = shared_runs(dealt, counts.where((F.col("count") > 2 * group) | (F.col("bytes") > GROUP_CHARS)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        told, runs = None, []
        id_type = None

        def flush():
            known = np.concatenate(runs) if runs and told == at[2] else None
            texts = extract_group([h[2] for h in held], [h[0] for h in held], at[0], known)
            cols = [pa.array([h[0] for h in held], id_type), pa.array([h[1] for h in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars"])

        for batch in batches:
            id_type = batch.column(0).type
            for lo in range(0, batch.num_rows, 500):
                for id_, u, h, host, part, g, more in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    if held and ((host, part, g) != at or len(held) >= 2 * group or size > GROUP_CHARS):
                        yield flush()
                        held, size = [], 0
                    if more is not None:  # these come before the pages of their group
                        told, runs = g, [*(runs if told == g else []), np.frombuffer(more, np.uint64)]
                        continue
                    at = (host, part, g)
                    held.append((id_, u, h))
                    size += len(h)
        if held:
            yield flush()

    if shared is None:
        sent = dealt.withColumn("runs", F.lit(None).cast("binary")).repartition("host", "part").sortWithinPartitions("host", "part", "id", "url")
    else:
        sent = dealt.unionByName(shared, allowMissingColumns=True).repartition("g").sortWithinPartitions("g", F.col("runs").isNull(), "host", "part", "id", "url")
    out = sent.mapInArrow(tidied(run), f"id {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars")
