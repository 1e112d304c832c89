"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean query: alternatives (OR) of trigrams that every match must hold (AND). One scan of the texts
numbers the rows, searches for the rules that have no such trigrams, and notes which of the queries' trigrams a text holds. The
index is a posting bitmap for each trigram and block of rows; alternatives intersect theirs, rules unite their alternatives, and
only the texts that a rule's bitmap names are read again and verified by its regex. All of it is DataFrame functions.
"""

from __future__ import annotations

import re._parser as regex_tree
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches are leftmost and do not overlap; those whose group is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The order gives the kinds' ranks; the first three are the contract's base, the others are added. Of runs of one class of
#: characters the short ones never match, which gives the same spans as dropping them.
RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", "(?i:bearer)\\x20+[A-Za-z0-9._~+/-]{16,}"),
    Rule("url", "://[^\\x00-\\x20:/@]{1,64}:[^\\x00-\\x20:/@]{3,64}@"),
)
BASE = 3

#: Sets of exact strings and of alternatives stay below these sizes while a query is derived; beyond them it gets weaker, never wrong.
EXACT, ALTERNATIVES = 64, 64
#: Running sums go by blocks of so many matches.
BLOCK = 64

Query = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative holds for every text
EVERY: Query = frozenset([frozenset()])


def _least(alternatives: Iterable[frozenset]) -> Query:
    """Without alternatives that ask for more than another one."""
    kept: list[frozenset] = []
    for a in sorted(set(alternatives), key=lambda a: (len(a), sorted(a))):
        if not any(k <= a for k in kept):
            kept.append(a)
    return frozenset(kept) if len(kept) <= ALTERNATIVES else EVERY


def _both(p: Query, q: Query) -> Query:
    return _least(a | b for a, b in product(p, q)) if len(p) * len(q) <= ALTERNATIVES**2 else min(p, q, key=len)


def _holding(strings: Iterable[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that match, if they are few, else None; the query) of nodes in a row, lower-cased."""
    here, query, whole = {""}, EVERY, True
    for op, arg in nodes:
        exact, needed = _node(op, arg)
        if exact is not None and len(exact) * len(here) <= EXACT:
            here = {a + b for a, b in product(here, exact)}
            continue
        query, whole = _both(_both(query, _holding(here)), needed), False
        here = {""} if exact is None else exact
    query = _both(query, _holding(here))
    return (here if whole else None), query


def _node(op, arg) -> tuple[set[str] | None, Query]:
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, EVERY
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            low, high = value if str(kind) == "RANGE" else (value, value)
            if str(kind) not in ("LITERAL", "RANGE") or high - low >= EXACT:
                return None, EVERY
            chars |= {chr(c).lower() for c in range(low, high + 1)}
        return (chars, EVERY) if len(chars) <= 8 else (None, EVERY)
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        branches = [_sequence(b) for b in arg[1]]
        if all(exact is not None for exact, _ in branches):
            strings = set().union(*(exact for exact, _ in branches))
            return (strings, _holding(strings)) if len(strings) <= EXACT else (None, _holding(strings))
        return None, _least(a for _, q in branches for a in q)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        exact, needed = _sequence(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, EVERY
        return (None, needed) if low else (None, EVERY)
    if name == "AT":
        return {""}, EVERY
    return None, EVERY


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, lower-cased, one of which every text with a match holds whole; EVERY where none is mandatory."""
    return _sequence(regex_tree.parse(pattern))[1]


def _let(value: Column, then) -> Column:
    """`then` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(steps: Column) -> Column:
    """Running sums of an array that is not empty: block by block, so that texts of very many matches take no square of work."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    bases = F.aggregate(
        F.transform(blocks, lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK))),
        start,
        lambda a, x: F.struct((a.getField("at") + x).alias("at"), F.concat(a.getField("out"), F.array(a.getField("at"))).alias("out")),
        lambda a: a.getField("out"),
    )
    return _let(bases, lambda base: F.transform(steps, lambda x, i: F.get(base, F.floor(i / BLOCK).cast("int")) + total(F.slice(steps, i - i % BLOCK + 1, i % BLOCK + 1))))


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """A rule's matches in a text as (start, rank, end) in code points, end exclusive: lengths of matches and of what lies between add up."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, 0)
    values = F.regexp_extract_all(text, pattern, rule.group) if rule.group else matches
    parts = F.arrays_zip(matches.alias("m"), values.alias("v"), F.split(text, rule.pattern, -1).alias("gap"))
    parts = F.transform(
        F.filter(parts, lambda x: x.getField("m").isNotNull()),
        lambda x: F.struct((F.length(x.getField("gap")) + F.length(x.getField("m"))).cast("long").alias("step"), F.length(x.getField("m")).cast("long").alias("n"), F.length(x.getField("v")).alias("v")),
    )

    def placed(p: Column) -> Column:
        ends = _let(p.getField("step"), _running)
        return F.transform(
            F.filter(F.arrays_zip(ends.alias("end"), p.getField("n").alias("n"), p.getField("v").alias("v")), lambda x: x.getField("v") >= rule.least),
            lambda x: F.struct((x.getField("end") - x.getField("n")).alias("start"), F.lit(rank).alias("rank"), x.getField("end").alias("end")),
        )

    return F.when(text.rlike(rule.pattern), _let(parts, placed)).otherwise(F.array()).cast(SPANS)


def scanned(docs: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """docs -> doc_id, k (a hash of the text), id (a row number), spans of the rules without mandatory trigrams, grams (places of those that the text holds)."""
    full = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern) == EVERY]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.lower("text").alias("folded"))
    spans = F.concat(*(spans_of(F.col("text"), r, i) for i, r in full)) if full else F.array().cast(SPANS)
    held = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(g)), i) for i, g in enumerate(grams)))) if grams else F.array().cast("array<int>")
    return rows.select("doc_id", F.xxhash64("text").alias("k"), F.monotonically_increasing_id().alias("id"), spans.alias("spans"), held.cast("array<int>").alias("grams"))


def posting_bitmaps(rows: DataFrame) -> DataFrame:
    """id, grams -> gram, block, bits: which of a block's rows hold a gram. Numbers run on within a partition, so sums are partial there."""
    postings = rows.select((F.col("id") + 1).alias("id"), F.explode("grams").alias("gram"))
    return postings.groupBy("gram", F.bitmap_bucket_number("id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def matching_blocks(index: DataFrame, queries: dict[int, Query], grams: list[str]) -> DataFrame:
    """block, found: the rules' bitmaps of candidates in a block, as (rank, bits)."""
    uses: list[list[Column]] = [[] for _ in grams]
    for rank, query in queries.items():
        for k, alternative in enumerate(sorted(map(sorted, query))):
            for g in alternative:
                uses[grams.index(g)].append(F.struct(F.lit(rank).alias("rank"), F.lit(k).alias("alternative"), F.lit(len(alternative)).alias("size")))
    asked = index.select("block", "bits", F.inline(F.get(F.array(*(F.array(*u) for u in uses)), F.col("gram"))))
    whole = asked.groupBy("block", "rank", "alternative").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n = size")
    united = whole.groupBy("block", "rank").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy("block").agg(F.collect_list(F.struct("rank", "bits")).alias("found"))  # as many as there are rules


def candidates(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, k, ranks: the rules whose bitmaps name a row; repeated rows with the same text once."""
    number = rows.select("doc_id", "k", (F.col("id") + 1).alias("id"))
    number = number.select("doc_id", "k", F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id").alias("at"))
    byte = lambda bits: F.conv(F.hex(F.substring(bits, F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    named = F.filter("found", lambda x: F.getbit(byte(x.getField("bits")), (F.col("at") % 8).cast("int")) == 1)
    rows = number.join(blocks, "block").select("doc_id", "k", named.getField("rank").alias("ranks")).where(F.size("ranks") > 0)
    return rows.groupBy("doc_id", "k").agg(F.first("ranks").alias("ranks"))


def _rarest(index: DataFrame, queries: dict[int, Query], grams: list[str]) -> list[str]:
    """The rarest trigram of each alternative that occurs at all, by the posting bitmaps: as few rows as there are trigrams come to the driver."""
    n = {grams[r["gram"]]: r["n"] for r in index.groupBy("gram").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    alternatives = {a for q in queries.values() for a in q if all(g in n for g in a)}
    return sorted({min(a, key=lambda g: (n[g], g)) for a in alternatives})


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans (start, rank, end by start, then rank): one row for each row of docs.

    A null text is empty. Rows without a doc_id and repeated rows are kept, each with its own spans. Offsets count code points
    of the whole text. Texts that hold none of the alternatives' rarest trigrams are not shuffled. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != EVERY}
    grams = sorted({g for q in queries.values() for a in q for g in a})
    rows = scratch.write(scanned(docs, rules, grams), "rows")
    narrow = rows.select("doc_id", "k", "spans")
    if not grams:
        return narrow.select("doc_id", F.array_sort("spans").alias("spans"))
    index = scratch.write(posting_bitmaps(rows), "index")
    rarest = _rarest(index, queries, grams)
    if not rarest:
        return narrow.select("doc_id", F.array_sort("spans").alias("spans"))
    named = scratch.write(candidates(rows, matching_blocks(index, queries, grams)), "candidates")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where(reduce(lambda a, b: a | b, (F.contains(F.lower("text"), F.lit(g)) for g in rarest)))
    texts = texts.select(F.col("doc_id").alias("other"), F.xxhash64("text").alias("h"), "text")
    read = texts.join(named, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("k") == F.col("h"))).select("doc_id", "k", "text", "ranks")
    verified = F.concat(*(F.when(F.array_contains("ranks", i), spans_of(F.col("text"), rules[i], i)).otherwise(F.array()).cast(SPANS) for i in queries))
    found = read.select("doc_id", "k", verified.alias("more")).where(F.size("more") > 0).groupBy("doc_id", "k").agg(F.first("more").alias("more"))
    found = scratch.write(found.withColumnsRenamed({"doc_id": "other", "k": "h"}), "found")
    out = narrow.join(found, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("k") == F.col("h")), "left")
    return out.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.getField("rank")), x.getField("start"), x.getField("end"))), ",")
