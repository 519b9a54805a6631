"""Secret scans by a trigram inverted index, with DataFrame operations alone.

From each rule's regular expression a Boolean query over trigrams is derived: every match contains them. The index holds,
for each trigram that some query names, the documents whose lower-cased text contains it. Postings are intersected and united as
the queries say, and only the documents left are verified with the expression itself. A rule without mandatory
trigrams (a run of hexadecimal digits) has no query and scans every text.

The pass that builds the index also runs the rules that scan fully. Verification reads the candidates' texts, which a fixed-size
bitmap of their keys selects before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import filter_bits, may_match, slot_filter, table, written

try:  # the standard library's parser of regular expressions; its name changed with Python 3.11
    from re import _parser
except ImportError:
    import sre_parse as _parser

_MOST = 64  # literal alternatives that are followed before a query gives up on them
_BITS = 60  # trigrams in one mask
_BLOCK = 256  # matches whose lengths are summed as one


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap. Those whose group ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Fixed values. The order is that in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),  # AKIA[A-Z0-9]+ of 20 or more: the run's shorter rests never qualify
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # whole runs of [0-9a-f]+ of 24 or more
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


# --- Boolean trigram queries: None (no demand), ("and" | "or", [queries]) or a trigram -----------------------------------


def _joined(kind: str, parts: list) -> object:
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = sorted({repr(p): p for p in parts if p is not None}.items())
    return None if not parts else parts[0][1] if len(parts) == 1 else (kind, [p for _, p in parts])


def _clause(words: set[str]) -> object:
    """What a text that holds one of the words must contain."""
    grams = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
    return _joined("or", [_joined("and", sorted(g)) for g in grams if not any(h < g for h in grams)])


def _alternatives(items: object) -> set[str] | None:
    """The single characters of a class, if few."""
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def _analysed(sequence: object) -> tuple[set[str] | None, list]:
    """(all strings it can match, if few, else None; the clauses that any match fulfils)."""
    pure, now, clauses = True, {""}, []

    def cut() -> None:
        nonlocal pure, now
        clauses.append(_clause(now))
        pure, now = False, {""}

    def follow(options: set[str] | None) -> None:
        nonlocal now
        if options is None or len(options) * len(now) > _MOST:
            cut()
            if options is not None and len(options) <= _MOST:
                now = set(options)
        else:
            now = {a + b for a, b in product(now, options)}

    for op, arg in sequence:
        name = str(op)
        if name == "LITERAL":
            follow({chr(arg).lower()})
        elif name == "IN":
            follow(_alternatives(arg))
        elif name == "SUBPATTERN":
            own, inner = _analysed(arg[3])
            follow(own)
            clauses += inner
        elif name == "BRANCH":
            each = [_analysed(x) for x in arg[1]]
            if all(own is not None for own, _ in each):
                follow(set().union(*(own for own, _ in each)))
            else:
                cut()
                clauses.append(_joined("or", [_joined("and", inner + ([_clause(own)] if own else [])) for own, inner in each]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, sub = arg
            own, inner = _analysed(sub)
            if (least, most) == (0, 1) and own is not None:
                follow(own | {""})
            elif least == most and own is not None and len(own) ** least <= _MOST:
                for _ in range(least):
                    follow(own)
            else:
                cut()
                clauses += inner + ([_clause(own)] if own else []) if least else []
        elif name != "AT":
            cut()
    if not pure:
        clauses.append(_clause(now))
    return (now if pure else None), [c for c in clauses if c is not None]


def trigram_query(pattern: str) -> object:
    """The query every match of pattern fulfils, over lower-case trigrams; None if nothing is mandatory."""
    own, clauses = _analysed(_parser.parse(pattern))
    return _joined("and", clauses + ([_clause(own)] if own else []))


def trigrams(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query: object, has: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return has[query]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, (_holds(q, has) for q in query[1]))


# --- The scan --------------------------------------------------------------------------------------------------------------

_SPANS = "array<struct<start:int,rule:int,stop:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a lambda's variable holds it."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _spans(text: Column, rules: tuple[Rule, ...], k: int) -> Column:
    """Rule k's matches with their offsets in code points: what lies between matches and the matches themselves add up to them.

    Sums of whole blocks of matches come first, so that a text of many matches doesn't sum all earlier ones for each.
    """
    rule = rules[k]
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.char_length)
    parts = F.struct(F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gaps"), lengths(0).alias("whole"), lengths(rule.group).alias("own"))

    def blocks(p: Column) -> Column:
        steps = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["whole"])), p["whole"], lambda g, n: g + n)
        return _let(steps, lambda s: F.struct(s.alias("steps"), F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / _BLOCK).cast("int")), lambda b: _sum(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))).alias("sums")))

    def spans(p: Column) -> Column:
        def one(q: Column) -> Column:
            def match(n: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                start = q["before"][block] + _sum(F.slice(q["steps"], block * _BLOCK + 1, i - block * _BLOCK)) + p["gaps"][i]
                return F.when(p["own"][i] >= rule.least, F.struct(start.alias("start"), F.lit(k).alias("rule"), (start + n).alias("stop")))

            return F.filter(F.transform(p["whole"], match), lambda s: s.isNotNull())

        before = lambda q: F.transform(q["sums"], lambda _, b: _sum(F.slice(q["sums"], F.lit(1), b)))
        return _let(_let(blocks(p), lambda q: F.struct(q["steps"].alias("steps"), before(q).alias("before"))), one)

    return F.when(text.rlike(rule.pattern), _let(parts, spans)).otherwise(F.array()).cast(_SPANS)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, and found, its spans (start, rule's place, stop) by start and then rule.

    Whole texts are scanned; null counts as empty and has no span. Rows that repeat an id are scanned each by its own text, which a 128-bit hash of
    both tells apart. The work grows with a text's length and, by a small factor, with its matches to the power 3/2. Other columns are not read;
    an empty table gives an empty result.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(trigrams, queries)))
    full = [k for k, q in enumerate(queries) if q is None]
    indexed = [k for k, q in enumerate(queries) if q is not None]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "text"))))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(n)) for n, g in enumerate(grams)))) if grams else F.array().cast("array<int>")
    own = F.concat(*(_spans(F.col("text"), rules, k) for k in full)) if full else F.array().cast(_SPANS)
    first = written(texts.withColumn("low", F.lower("text")).select("id", "key", held.alias("held"), own.alias("own")), "scan")
    found = first.select("id", "key", "own")
    if indexed:
        postings = written(first.select(F.explode("held").alias("gram"), "key").sortWithinPartitions("gram", "key"), "postings")
        masks = [F.bit_or(F.when(F.floor(F.col("gram") / _BITS) == w, F.expr(f"shiftleft(1L, cast(gram % {_BITS} as int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(-(-len(grams) // _BITS))]
        has = {g: F.col(f"m{n // _BITS}").bitwiseAND(F.lit(1 << n % _BITS).cast("long")) != 0 for n, g in enumerate(grams)}
        wanted = F.array_compact(F.array(*(F.when(_holds(queries[k], has), F.lit(k)) for k in indexed)))
        candidates = written(postings.groupBy("key").agg(*masks).select("key", wanted.alias("wanted")).where(F.size("wanted") > 0), "candidates")
        slot = F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1))
        bits = filter_bits(candidates.count())
        some = may_match(texts.withColumn("slot", slot), "slot", slot_filter(candidates.withColumn("slot", slot), "slot", bits), bits)
        verified = F.concat(*(F.when(F.array_contains("wanted", k), _spans(F.col("text"), rules, k)).otherwise(F.array().cast(_SPANS)) for k in indexed))
        more = some.select("key", "text").join(candidates, "key").select("key", verified.alias("more")).where(F.size("more") > 0)
        found = found.join(more.groupBy("key").agg(F.any_value("more").alias("more")), "key", "left").withColumn("own", F.concat("own", F.coalesce("more", F.array().cast(_SPANS))))
    return found.select(F.col("id").alias(id_col), F.array_sort("own").alias("found"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    base = [k for k, r in enumerate(RULES) if r.base]
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rule"]], s["start"], s["stop"])))
    count = lambda kind: F.size(F.filter("found", lambda s: kinds[s["rule"]] == kind)).cast("long").alias(f"n_{kind}")
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(F.filter("found", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def _sql_rule(k: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    n = f"list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x))"
    g = f"list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x))"
    gaps = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))"
    return f"SELECT doc_id, {k} AS rule, '{r.kind}' AS kind, {n} AS n, {g} AS g, {gaps} AS gaps, {r.least} AS least FROM d"


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(_sql_rule(k, r) for k, r in enumerate(RULES))}),
e AS (SELECT doc_id, rule, kind, n, g, gaps, least, unnest(range(1, len(n) + 1)) AS i FROM r),
s AS (
  SELECT doc_id, rule, kind, list_sum(gaps[1:i]) + coalesce(list_sum(n[1:i - 1]), 0) AS start, n[i] AS size
  FROM e WHERE g[i] >= least),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, start::BIGINT, (start + size)::BIGINT), ',' ORDER BY start, rule) FILTER (rule < 3) AS base,
         string_agg(concat_ws(':', kind, start::BIGINT, (start + size)::BIGINT), ',' ORDER BY start, rule) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
