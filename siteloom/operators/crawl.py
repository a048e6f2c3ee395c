"""Round-by-round crawling of a corpus of answers: a fixpoint of links in DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robots, urls
from .scratch import shared_dir

#: Tables of pages seen that are read together before they are written as one.
COMPACT = 16
#: Links that one task holds at most, some 25 bytes each; of more, each round is a job.
WALKED = 1 << 25


def first_found(found: DataFrame) -> DataFrame:
    """One row per canonical_url: the first by (depth, source, pos)."""
    return found.groupBy("canonical_url").agg(F.min_by(F.struct(*[c for c in found.columns if c != "canonical_url"]), F.struct("depth", "source", "pos")).alias("r")).select("canonical_url", "r.*")


def new_frontier(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Links not visited yet, each once."""
    return first_found(found).join(visited, "canonical_url", "left_anti")


def limited(frontier: DataFrame, room: int) -> DataFrame:
    """The first rows in the order of discovery."""
    return frontier.orderBy("depth", "source", "pos").limit(room)


def _walk(batches: Iterator[pa.RecordBatch], n_links: int, offsets: np.ndarray, max_pages: int | None) -> Iterator[pa.RecordBatch]:
    """(e, depth) of the links by which pages are reached first.

    The links come by (src, pos), seeds before them without a src; a page's number is its partition in the upper bits and its row there, counted
    in dense numbers by the partitions' offsets. A lower place among the links is the earlier one in the order (source, pos).
    """
    dense = lambda x: (offsets[x >> 33] + (x & ((1 << 33) - 1))).astype(np.int32)
    src, dst, own, e, allowed = (np.empty(n_links, t) for t in (np.int32, np.int32, np.int64, np.int64, np.bool_))
    at = 0
    for b in batches:
        to = at + b.num_rows
        given = b["src"].fill_null(-1).to_numpy()
        src[at:to] = np.where(given < 0, -1, dense(given))
        dst[at:to], own[at:to], e[at:to] = dense(b["dst"].to_numpy()), b["own"].to_numpy(), b["e"].to_numpy()
        allowed[at:to] = b["allowed"].to_numpy(zero_copy_only=False)
        at = to
    if at != n_links:
        raise ValueError(f"{at} links of {n_links}")
    seen, site = np.zeros(offsets[-1], np.bool_), np.empty(offsets[-1], np.int64)
    new, depth, n, done, waiting = np.arange(np.searchsorted(src, 0)), 0, 0, [], 0
    while len(new):
        seen[dst[new]] = True  # with what robots forbid
        site[dst[new]] = own[new]
        if depth:
            new = new[allowed[new]]
        if max_pages is not None and depth and n + len(new) > max_pages:
            new = np.sort(new)[: max_pages - n]
        n += len(new)
        done.append((e[new], np.full(len(new), depth, np.int32)))
        waiting += len(new)
        if waiting > 100_000:
            yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*done)], ["e", "depth"])
            done, waiting = [], 0
        if max_pages is not None and n >= max_pages:
            break
        pages = dst[new]
        first, last = np.searchsorted(src, pages), np.searchsorted(src, pages, "right")
        many = last - first
        links = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        links = np.sort(links[~seen[dst[links]] & (own[links] == site[src[links]])])
        new, depth = links[np.unique(dst[links], return_index=True)[1]], depth + 1
    if done:
        yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*done)], ["e", "depth"])


def crawl(pages: DataFrame, seeds: DataFrame, robots_rules: DataFrame | None = None, max_pages: int | None = None, max_bytes: int = 0, seed_obeys_robots: bool = False) -> DataFrame:
    """(canonical_url, url, site, depth, source, pos) of every page reached.

    pages: (canonical_url, links array<string> resolved, and size where max_bytes is given); seeds: (canonical_url, url, site). A round joins
    the frontier with the pages' links, follows enqueueable ones, drops visited ones and those that robots forbid. It goes on until a round finds
    nothing new, unless the caller sets a limit: max_pages pages in the order (depth, source, pos), or no further round once those reached
    have max_bytes (0: no limit). Without max_bytes, one task walks over up to WALKED links, given as numbers, so that a round costs no job: a
    site can have thousands of rounds. Else each round ends in a table in the shared folder, which cuts its lineage. Of several seeds with one
    canonical URL, the smallest URL counts. The HTTP crawl's seeds pass robots unasked; the rendering crawl's do not (seed_obeys_robots), and
    with max_pages 0 the former keeps its seeds, the latter nothing.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"

    def judged(df: DataFrame) -> DataFrame:
        if robots_rules is None:
            return df.withColumn("allowed", F.lit(True))
        return robots.with_allowed(df.withColumn("_path", urls.parse_web_url(F.col("url"))["path"]), robots_rules, "site", "_path").drop("_path")

    def allowed(df: DataFrame) -> DataFrame:
        return judged(df).where("allowed").drop("allowed")

    def read(names: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*(f"{folder}/{x}" for x in names))

    def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        df.write.parquet(f"{folder}/{name}")
        out = read([name])
        return out, out.count()

    def full(n: int) -> bool:
        return max_pages is not None and n >= max_pages

    start = seeds.groupBy("canonical_url").agg(F.min(F.struct("url", "site")).alias("s")).select("canonical_url", "s.url", "s.site", F.lit(0).alias("depth"), F.lit("").alias("source"), F.lit(0).alias("pos"))
    if seed_obeys_robots:
        start = allowed(start)
        start = start if max_pages is None else limited(start, max_pages)
    schema = start.schema
    # links are parsed once, not in each round
    links = urls.with_url(pages.select(F.col("canonical_url").alias("source"), F.posexplode("links").alias("pos", "url")), "url", "u")
    links = links.where(urls.is_enqueueable_page(F.col("u"), F.col("u.host")))
    links.select("source", "pos", "url", urls.bare_host(F.col("u.host")).alias("host"), urls.normalize_url(F.col("u"), F.lit("page")).alias("canonical_url")).write.parquet(f"{folder}/links")
    edges = spark.read.parquet(f"{folder}/links")

    frontier, n = stored(start, "round-0")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def walk() -> DataFrame | None:
        """The pages reached, unless the links are too many for one task."""
        sites = kept(frontier.select("site").distinct().withColumn("own", F.monotonically_increasing_id()), "sites")
        links = judged(edges.join(sites.withColumn("host", urls.bare_host(F.col("site"))), "host").drop("host"))
        links = kept(frontier.join(sites, "site").select("canonical_url", "url", "site", F.lit(None).cast("string").alias("source"), "pos", "own", F.lit(True).alias("allowed")).unionByName(links), "followed")
        n_links = links.count()
        if n_links > WALKED:
            return None
        # numbers in the order of the names
        names = links.select(F.explode(F.array("canonical_url", "source")).alias("name")).where("name is not null").distinct().orderBy("name")
        names = kept(names.withColumn("number", F.monotonically_increasing_id()), "names")
        rows = dict(names.groupBy(F.shiftright("number", 33)).count().collect())
        offsets = np.cumsum([0, *(rows.get(p, 0) for p in range(max(rows, default=0) + 1))])
        number = lambda c, out: names.select(F.col("name").alias(c), F.col("number").alias(out))
        links = kept(links.join(number("canonical_url", "dst"), "canonical_url").join(number("source", "src"), "source", "left").withColumn("e", F.monotonically_increasing_id()), "numbered")
        first = links.select("src", "pos", "dst", "own", "e", "allowed").repartition(1).sortWithinPartitions("src", "pos").select("src", "dst", "own", "e", "allowed")
        first = kept(first.mapInArrow(partial(_walk, n_links=n_links, offsets=offsets, max_pages=max_pages), "e long, depth int"), "walked")
        return kept(links.join(first, "e").select("canonical_url", "url", "site", "depth", F.coalesce("source", F.lit("")).alias("source"), "pos"), "reached")

    if not max_bytes and (out := walk()) is not None:
        return out
    seen, reached, k, size = ["round-0"], ["round-0"], 0, 0
    while not full(n):
        if max_bytes:
            size += frontier.join(pages, "canonical_url").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            if size >= max_bytes:
                break
        k += 1
        links = frontier.select(F.col("canonical_url").alias("source"), F.col("site"), urls.bare_host(F.col("site")).alias("own")).join(edges, "source").where("host = own")
        found = links.select("canonical_url", "url", "site", F.lit(k).alias("depth"), "source", "pos")
        new = new_frontier(found, read(seen).select("canonical_url")).select(*start.columns)
        frontier, m = stored(new, f"round-{k}")
        if not m:
            break
        seen.append(f"round-{k}")  # with what robots forbids, so that it is not asked again
        if len(seen) > COMPACT:
            read(seen).write.parquet(f"{folder}/seen-{k}")
            seen = [f"seen-{k}"]
        name = f"round-{k}"
        if robots_rules is not None or (max_pages is not None and n + m > max_pages):
            fit = allowed(frontier)
            frontier, m = stored(fit if max_pages is None else limited(fit, max_pages - n), f"kept-{k}")
            name = f"kept-{k}"
        reached.append(name)
        n += m
    return read(reached)
