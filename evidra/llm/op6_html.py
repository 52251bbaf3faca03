"""Main-text extraction by paths on which the pages of a host agree.

A page's containers are scored by the text that stands in them, links against
it, and the page chooses one: an article or main element that holds enough,
or else the innermost container that leaves out nothing that reads like text.
The chosen container's generalised path (tags with their classes, numbers as
#) is the page's vote.  Each page also reports the containers that own text:
whether its choice left them out, and what they hold.  Spark sums the reports
a host; a path is

* the host's winner if most votes are for it;
* outside the main text if the pages that have it mostly leave it out, or if
  it holds the same few texts on all of them.

Each page is then read again by its host's winner: what stands in it, and what
the page would choose by itself besides, but for paths that are outside.  A
page without the winner's path is judged by itself, as is one whose host has
no winner.  Words in classes and ids decide nothing for a container that holds
much of a page's text.

Defined cases: null html is empty and gives an empty text, as does a page
without text; a null url is a host of its own; repeated rows are extracted
each, and pages of equal markup count as one where texts are compared;
cut-off, malformed and very deep markup is read as far as it goes; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .html import CONTAINERS, Block, Node, read, settle

#: A container is left for an inner one that holds this share of its text, if what else it holds is short.
INNER = 0.85
#: Text that is not left out: a block of so many characters that are no links, or a title.
LONG = 60
#: The winner's path is read on a page where it holds this share of the page's own choice.
ENOUGH = 1 / 3
#: An article or main element is chosen from this share of the page's text.
NAMED = 0.25
#: Containers that own less of a page's text are not reported; so a page makes a bounded number of reports.
REPORTED = 0.01
#: A path is judged on hosts where it is on this share of the pages, which bounds the paths of a host, and on so many pages.
COMMON, LEAST = 0.1, 3
#: Shares of a host with many pages in the join; a constant, so that no host is one task's.
SALTS = 16


class Page:
    """A page's main blocks and how its containers share them, by path."""

    def __init__(self, html: str | None):
        nodes, blocks = read(html)
        self.blocks = settle(nodes, blocks)
        self.total = sum(b.weight for b in self.blocks)
        self.kind: dict[int, str] = {}
        self.up: dict[int, int | None] = {}
        self.weight: dict[int, int] = {}
        self.owners: list[Node | None] = []
        #: whether a container holds a block that would be missed if it were left out
        self.missed: dict[int, bool] = {}
        #: containers that own such a block themselves
        self.long: set[int | None] = set()
        sums: dict[int, list] = {}
        above: dict[int, Node | None] = {}

        def container(node: Node | None) -> Node | None:
            trail = []
            while node is not None and node.tag not in CONTAINERS and id(node) not in above:
                trail.append(node)
                node = node.parent
            found = above[id(node)] if node is not None and id(node) in above else node
            for x in trail:
                above[id(x)] = found
            return found

        for b in self.blocks:
            owner = container(b.node)
            self.owners.append(owner)
            if b.weight >= LONG or b.node.tag == "h1":
                self.long.add(owner.path if owner is not None else None)
            if owner is not None:
                held = sums.setdefault(id(owner), [owner, 0, False])
                held[1] += b.weight
                held[2] |= b.weight >= LONG or b.node.tag == "h1"
        # inner containers come after outer ones in the page, so sums are handed up from the last
        for node in reversed(nodes):
            if id(node) not in sums:
                continue
            _, weight, missed = sums[id(node)]
            path = node.path
            self.kind[path], self.weight[path] = node.tag, self.weight.get(path, 0) + weight
            up = container(node.parent)
            self.up[path] = up.path if up is not None else None
            self.missed[path] = self.missed.get(path, False) or missed
            if up is not None:
                held = sums.setdefault(id(up), [up, 0, False])
                held[1] += weight
                held[2] |= missed

    def choice(self) -> int | None:
        """The path of the container that the page takes for its main text by itself."""
        named = {p: w for p, w in self.weight.items() if self.kind[p] in ("article", "main") and w >= NAMED * self.total}
        if named and self.total:
            widest = max(named.values())
            inner = {p: w for p, w in named.items() if self.kind[p] == "article" and w >= INNER * widest} or {p: w for p, w in named.items() if w == widest}
            return max(inner, key=lambda p: (inner[p], p))
        below: dict[int | None, list[int]] = {}
        for p, up in self.up.items():
            below.setdefault(up, []).append(p)
        at = None
        held = self.total
        while below.get(at):
            best = max(below[at], key=lambda p: (self.weight[p], p))
            rest = any(self.missed[p] for p in below[at] if p != best) or at in self.long
            if self.weight[best] < INNER * held or rest or not self.weight[best]:
                break
            at, held = best, self.weight[best]
        return at

    def inside(self, paths: set[int]) -> list[bool]:
        """For each block, whether it stands in a container with one of these paths."""
        known: dict[int, bool] = {}

        def of(node: Node | None) -> bool:
            trail, found = [], False
            while node is not None:
                if id(node) in known:
                    found = known[id(node)]
                    break
                trail.append(node)
                if node.tag in CONTAINERS and node.path in paths:
                    found = True
                    break
                node = node.parent
            for x in trail:
                known[id(x)] = found
            return found

        return [of(o) for o in self.owners]

    def reports(self) -> list[tuple[int, bool, bool, int]]:
        """(path, whether it is the choice, whether the choice leaves it out, hash of its text) of the choice and the owners of text."""
        chosen = self.choice()
        within = self.inside({chosen}) if chosen is not None else [True] * len(self.blocks)
        texts: dict[int, list[str]] = {}
        out: dict[int, bool] = {}
        for b, o, i in zip(self.blocks, self.owners, within, strict=True):
            if o is not None:
                texts.setdefault(o.path, []).append(b.text)
                out[o.path] = not i
        all_text = sum(len(b.text) for b in self.blocks)
        rows = [(p, False, out[p], xxhash.xxh3_64_intdigest("\n".join(t)) >> 1) for p, t in texts.items() if p != chosen and sum(map(len, t)) >= REPORTED * all_text]
        if chosen is not None:
            rows.append((chosen, True, False, xxhash.xxh3_64_intdigest("\n".join(b.text for b, i in zip(self.blocks, within, strict=True) if i)) >> 1))
        return rows

    def text(self, winner: int | None, outside: set[int]) -> str:
        chosen = self.choice()
        own = self.weight.get(chosen, 0) if chosen is not None else self.total
        kept = self.inside({chosen}) if chosen is not None else [True] * len(self.blocks)
        if winner is not None and self.weight.get(winner, 0) >= ENOUGH * own > 0:
            won = self.inside({winner})
            gone = self.inside(outside)
            kept = [(w or k) and not g for w, k, g in zip(won, kept, gone, strict=True)]
        return "\n".join(b.text for b, k in zip(self.blocks, kept, strict=True) if k)


def chosen(html: str | None, winner: int | None = None, outside: tuple[int, ...] = ()) -> str:
    """The main text of a page, its blocks one a line."""
    return Page(html).text(winner, set(outside))


def hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def ballots(pages: DataFrame) -> DataFrame:
    """host, path, page, chosen, out, text: what each page says of its containers; hashes for the page and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                html = html.as_py()
                page = xxhash.xxh3_64_intdigest(html or "") >> 1
                for path, vote, out, text in Page(html).reports():
                    for column, value in zip(rows, (host, path, page, vote, out, text), strict=True):
                        column.append(value)
            paths = pa.array(np.array(rows[1], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), paths, pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.bool_()), pa.array(rows[4], pa.bool_()), pa.array(rows[5], pa.int64())], ["host", "path", "page", "chosen", "out", "text"])

    return pages.select("host", "html").mapInArrow(run, "host string, path long, page long, chosen boolean, out boolean, text long")


def consensus(reports: DataFrame) -> DataFrame:
    """host, winner (null without a majority), outside: one row a host.

    Distinct pages and texts are counted by sketches of fixed size, so a host
    with a third of all pages is summed in parts like any other.
    """
    one = F.lit(1)
    paths = reports.groupBy("host", "path").agg(
        F.count(one).alias("n"), F.count_if("chosen").alias("votes"), F.count_if("out").alias("left_out"), F.approx_count_distinct("page", 0.05).alias("pages"), F.approx_count_distinct("text", 0.05).alias("texts")
    )
    paths = materialize(paths, "paths")
    best = paths.groupBy("host").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "path", "pages", "texts")).alias("w"))
    best = best.select("host", "all", F.when(F.col("w.votes") * 2 > F.col("all"), F.col("w.path")).alias("winner"), (F.col("w.texts") * 2 > F.col("w.pages")).alias("varied"))
    judged = paths.join(best, "host").where((F.col("pages") >= LEAST) & (F.col("n") >= COMMON * F.col("all")) & ~F.col("path").eqNullSafe(F.col("winner")))
    repeats = F.col("varied") & (F.col("texts") * 2 <= F.col("pages")) & (F.col("votes") * 2 < F.col("n"))
    outside = judged.where((F.col("left_out") * 2 > F.col("n")) | repeats).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("outside"))
    return best.select("host", "winner").join(outside, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text.

    The hosts' verdicts are joined to their pages; a host's row is repeated
    for each of its shares, so that the pages of a large host are dealt out.
    """
    read_in = hosts(pages)
    told = materialize(consensus(ballots(read_in)), "hosts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = read_in.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(told, ["host", "salt"], "left").select("page_id", "url", "html", "winner", "outside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for batch in batches:
            out = []
            for html, winner, outside in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                out.append(chosen(html.as_py(), None if winner is None else winner & mask, tuple(x & mask for x in outside or ())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
