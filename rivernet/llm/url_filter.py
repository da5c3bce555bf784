"""Weighted URL vocabulary: strict and soft terms found by an Aho-Corasick automaton.

A term counts where no ASCII letter or digit touches it.  One strict term, or
``soft_limit`` different soft terms, block a url; host rules come first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The default vocabulary and the default host rules.
STRICT = ("casino", "escort", "hentai", "porn", "porno", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "betting", "bonus", "cheap", "crack", "dating", "download", "free", "gambling", "loan", "naked", "nude", "pills", "poker", "sex", "slots", "torrent")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    out = none
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


MOST_TERMS, MOST_RULES = 100_000, 1_000  # terms of an automaton, rules of an expression; more come in blocks, or by a join


def rules_met(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, fit of those pairs of ``seen(host, path)`` that a rule of the table rules(host, path, verdict) fits.

    A host meets the rules of its endings by an equi-join; of equally long rules
    that of the longer host counts.
    """
    labels = F.split("host", "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = seen.select("host", "path").distinct().withColumn("ending", F.explode(endings))
    by_host = rules.select(F.col("host").alias("ending"), F.col("path").alias("start"), "verdict").filter("ending IS NOT NULL AND start IS NOT NULL")
    fits = pairs.join(by_host, "ending").filter(F.col("path").startswith(F.col("start")))
    longest = F.struct((F.length("ending") + F.length("start")).alias("length"), F.length("ending").alias("host_length"), "verdict", F.concat("ending", "start").alias("rule"))
    return fits.groupBy("host", "path").agg(F.max(longest).alias("fit")).select("host", "path", F.struct("fit.rule", "fit.verdict").alias("fit"))


def vocabulary_blocks(terms: DataFrame) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(strict, soft) of blocks of about MOST_TERMS terms of a table terms(term, strict boolean).

    A term given as both is strict; null and empty ones are left out.
    """
    rows = terms.select(F.translate("term", UPPER, LOWER).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict")).filter("term <> ''")
    rows = cut(rows.groupBy("term").agg(F.bool_or("strict").alias("strict")))
    blocks = max(1, -(-rows.count() // MOST_TERMS))
    out = []
    for k in range(blocks):
        found = rows.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()  # a block
        out.append((tuple(sorted(r.term for r in found if r.strict)), tuple(sorted(r.term for r in found if not r.strict))))
    return out


def vocabulary_of(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) of a table of at most MOST_TERMS terms, as ``judge_urls`` takes them; larger ones go to it as a table."""
    blocks = vocabulary_blocks(terms)
    if len(blocks) > 1:
        raise ValueError(f"more than {MOST_TERMS:,} terms: give judge_urls the table")
    return blocks[0]


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, terms in ((0, soft), (1, strict)):
        for term in terms:
            out.add_word(term, (kind, term))
    out.make_automaton()
    return out


def hits(url: str | None, auto: ahocorasick.Automaton) -> tuple[int, int]:
    """(different strict terms, different soft terms) with a boundary on both sides."""
    if not url or not len(auto):
        return 0, 0
    text = url.translate(_ASCII_LOWER)
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (kind, term) in auto.iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found[kind].add(term)
    return len(found[1]), len(found[0])


def term_hits(url: Column, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> Column:
    """struct<strict, soft>: how many different terms of each kind a url holds; null urls hold none."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("struct<strict:int,soft:int>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = automaton(strict, soft)
        for urls in batches:
            yield pd.DataFrame([hits(u, auto) for u in urls], columns=["strict", "soft"], dtype="int32")

    return count(url)


def hits_in_blocks(pages: DataFrame, blocks: Sequence[tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """url, hit of every different url: the hits of all blocks of a vocabulary added up; a term lies in one block."""
    urls = pages.filter("url IS NOT NULL").select("url").distinct()
    parts = [urls.select("url", term_hits(F.col("url"), strict, soft).alias("hit")) for strict, soft in blocks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("url").agg(F.sum("hit.strict").cast("int").alias("strict"), F.sum("hit.soft").cast("int").alias("soft")).select("url", F.struct("strict", "soft").alias("hit"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2, terms: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict, soft.

    A null url, or one without ``://``, has an empty host and path and meets no
    rule; its terms still count.  Repeated rows are judged row by row, urls of any
    length whole; an empty table gives an empty result; columns other than
    page_id and url are left out.

    Rules and terms may be tables of any size: rules(host, path, verdict), and
    terms(term, strict) in place of ``strict`` and ``soft``.
    """
    url = F.col("url")
    seen = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    if isinstance(rules, DataFrame):
        fits = rules_met(seen, rules).select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "fit")
        seen = seen.join(fits, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left").drop("of_host", "of_path")
    else:
        seen = seen.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    blocks = [(strict, soft)] if terms is None else vocabulary_blocks(terms)
    if terms is None and len(strict) + len(soft) > MOST_TERMS:
        blocks = [*((strict[i : i + MOST_TERMS], ()) for i in range(0, len(strict), MOST_TERMS)), *(((), soft[i : i + MOST_TERMS]) for i in range(0, len(soft), MOST_TERMS))]
    if len(blocks) == 1:
        seen = seen.withColumn("hit", term_hits(url, *blocks[0]))
    else:
        none = F.struct(F.lit(0).alias("strict"), F.lit(0).alias("soft"))
        seen = seen.join(hits_in_blocks(pages, blocks).withColumnRenamed("url", "of_url"), F.col("url") == F.col("of_url"), "left").withColumn("hit", F.coalesce("hit", none))
    bad = (F.col("hit.strict") >= 1) | (F.col("hit.soft") >= soft_limit)
    return seen.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("hit.strict").alias("strict"), F.col("hit.soft").alias("soft"),
    )


def oracle_sql() -> str:
    """DuckDB: the same verdicts, each term by a regular expression of its own."""
    rows = lambda terms: ", ".join(f"('{t}')" for t in terms)
    count = lambda name: f"(SELECT count(*) FROM {name} WHERE regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)'))::INTEGER"
    lower = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH strict_terms(term) AS (VALUES {rows(STRICT)}), soft_terms(term) AS (VALUES {rows(SOFT)}),
rules(h, p, v) AS (VALUES {rules}),
seen AS (SELECT page_id, {lower} AS u,
  coalesce(regexp_extract({lower}, '^.*?://([^/?#]*)', 1, 's'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
counted AS (SELECT *, {count("strict_terms")} AS strict, {count("soft_terms")} AS soft,
  (SELECT max_by(h || p || '>' || v, length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit FROM seen)
SELECT page_id, host, path, split_part(fit, '>', 1) AS rule,
  coalesce(split_part(fit, '>', 2), CASE WHEN strict >= 1 OR soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  strict, soft FROM counted"""
