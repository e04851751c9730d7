"""Boilerplate line removal by site-relative frequency, with native functions.

For every host, the pages that contain a line are divided by the host's page
total; a line beyond the boilerplate ratio is dropped from that host's pages. A
line that only one page has is never boilerplate, however small the site.

A line is known by its MD5, so the count shuffles 16 bytes and the host per
distinct line of a page, pre-aggregated map-side: a very common line or a host
with a third of all pages reaches the shuffle as one row per task and key. The
boilerplate of a host is a short list, since at most (lines per page) / ratio
lines can pass. It is broadcast to the pages' scan where a bounded count proves
all hosts' lists small, so texts aren't shuffled; beyond, it is joined. A list is
kept in ``SLOTS`` parts by hash, so a page's lines are looked up in short arrays.

Defined results: lines are what newlines separate, compared without the white
space around them; blank lines are never dropped and not counted. A page counts
a line once. A share of exactly the ratio isn't beyond it. NULL hosts form one
site, NULL texts have no lines and stay NULL, empty texts stay empty. Repeated
rows are pages each. Very long pages cost in proportion to their lines. An empty
table gives no rows. Columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import bounded_count

from .common import fresh_name, let, materialize

#: A line on more than this share of a site's pages, and on more than one, is boilerplate.
RATIO = 0.02
#: Boilerplate lines of all hosts are broadcast up to so many.
BROADCAST_LINES = 500_000
SLOTS = 256
#: White space, as Unicode has it, the carriage return of CRLF texts included.
WHITE = "".join(map(chr, [32, *range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(_bare(line).cast("binary")))


def _slot(key: Column) -> Column:
    """The part of a host's list that a key belongs to: its first byte."""
    return F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int")


def boilerplate_lines(df: DataFrame, host: str, text: str, ratio: float = RATIO) -> DataFrame:
    """``(host, key)``: the MD5 keys of the boilerplate lines of each host."""
    pages = df.select(F.col(host).alias("host"), F.split(F.col(text), "\n").alias("lines"))
    per_page = pages.select("host", F.explode(F.array_distinct(F.transform(
        F.filter("lines", lambda x: _bare(x) != ""), _key))).alias("key"))
    counts = per_page.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > 1)
    totals = df.groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("total"))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("of")))
            .where(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "key"))


def drop_boilerplate(df: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """``df`` with ``text`` freed of its host's boilerplate lines, and
    ``n_lines`` (not blank) and ``n_dropped``."""
    site, keys, lines, kept = (fresh_name(df, n) for n in ("_site", "_keys", "_lines", "_kept"))
    found = materialize(boilerplate_lines(df, host, text, ratio))
    few = bounded_count(found, BROADCAST_LINES) <= BROADCAST_LINES
    parts = found.groupBy("host", _slot(F.col("key")).alias("slot")).agg(F.collect_list("key").alias("keys"))
    lists = parts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "keys"))).alias("parts")).select(
        F.col("host").alias(site), F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.try_element_at("parts", i)).alias(keys))
    # A slot without keys is NULL.
    listed = lambda x: let(_key(x), lambda k: F.coalesce(F.array_contains(F.get(F.col(keys), _slot(k)), k), F.lit(False)))
    joined = (df.join(F.broadcast(lists) if few else lists, F.col(host).eqNullSafe(F.col(site)), "left")
              .withColumn(lines, F.split(F.col(text), "\n"))
              .withColumn(kept, F.when(F.col(keys).isNull(), F.col(lines)).otherwise(F.filter(
                  lines, lambda x: (_bare(x) == "") | ~listed(x)))))
    count = lambda c: F.coalesce(F.size(F.filter(c, lambda x: _bare(x) != "")), F.lit(0)).cast("long")
    return (joined.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(count(lines)).cast("long"))
            .withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0)).otherwise(
                F.size(lines) - F.size(kept)).cast("long"))
            .withColumn(text, F.array_join(kept, "\n"))
            .drop(site, keys, lines, kept))
