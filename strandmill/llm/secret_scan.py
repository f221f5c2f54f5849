"""Secret scanning through a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean trigram query is derived: an OR of ANDs of trigrams that every match must contain, of
which the ``SELECTIVE`` rarest are kept (fewer mandatory trigrams can only add candidates). The index holds postings of row
numbers for the trigrams that some rule asks for, in blocks of at most ``BLOCK`` rows, so that no list grows with the
corpus. Per block the postings are intersected and united as the query says; only the candidates are searched with the
rule's pattern. Rules without mandatory trigrams scan all rows.

The first pass over the texts makes the postings and the spans of the rules that scan all, and leaves the texts where they
are; the second goes to the candidates, by address (see ``common.meet``). What is shuffled is numbers.

Defined cases: a null text counts as empty and has no spans; a null doc_id is returned as null; rows that share a
doc_id are searched each for itself. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import addressed, durable, meet

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

#: Bits of a row's number in its block, and the trigrams of an AND that are looked for.
BLOCK_BITS, SELECTIVE = 12, 3
BLOCK = 1 << BLOCK_BITS
#: Exact string sets larger than this are given up while deriving a query.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base. `[0-9a-f]+` of 16 or more characters is `[0-9a-f]{16,}`, as a match is always a whole
#: run; the same holds for AKIA, where a later AKIA in a run that is too short is shorter still.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----"),
    Rule("login", r"://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset[frozenset[str]] | None  # OR of ANDs; None: anything


def _trigrams(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    ands = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(a for a in ands if not any(b < a for b in ands))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    ands = {x | y for x in a for y in b}
    return frozenset(x for x in ands if not any(y < x for y in ands))


def _strings(node) -> set[str] | None:
    """All strings of a node that has few, folded to lower case; else None."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "SUBPATTERN":
        return _sequence(arg[3])[0]
    if name == "BRANCH":
        found = [_sequence(x)[0] for x in arg[1]]
        return None if any(x is None for x in found) or sum(map(len, found)) > MAX_STRINGS else set().union(*found)
    if name == "IN":
        chars = {chr(v).lower() for o, v in arg if str(o) == "LITERAL"}
        return chars if all(str(o) == "LITERAL" for o, _ in arg) and len(chars) <= 8 else None
    if name == "MAX_REPEAT" and arg[1] != sre.MAXREPEAT and arg[1] <= 2:
        one = _sequence(arg[2])[0]
        if one is not None and len(one) ** arg[1] <= MAX_STRINGS:
            return set().union(*({"".join(p) for p in product(one, repeat=n)} for n in range(arg[0], arg[1] + 1)))
    return None


def _needs(node) -> Query:
    """What a node without a small string set asks for at least."""
    op, arg = node
    if str(op) == "SUBPATTERN":
        return _sequence(arg[3])[1]
    if str(op) == "MAX_REPEAT" and arg[0] > 0:
        return _sequence(arg[2])[1]
    if str(op) == "BRANCH":
        parts = [_sequence(x)[1] for x in arg[1]]
        return None if any(p is None for p in parts) else frozenset().union(*parts)
    return None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    whole, run, query = True, {""}, None
    for node in nodes:
        found = _strings(node)
        if found is not None and len(run) * len(found) <= MAX_STRINGS:
            run = {a + b for a in run for b in found}
            continue
        query, whole = _both(query, _trigrams(run)), False
        run = found if found is not None else {""}
        if found is None:
            query = _both(query, _needs(node))
    query = _both(query, _trigrams(run))
    return (run if whole else None), query


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of lower-case trigrams, one AND of which any text with a match of ``pattern`` holds; None: no such."""
    return _sequence(sre.parse(pattern))[1]


#: Letters by falling frequency in English text; anything else is rarer.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def selective(query: Query) -> Query:
    """``query`` with the SELECTIVE trigrams of each AND that are rarest, judged by their letters."""
    rank = {c: i for i, c in enumerate(FREQUENT)}
    worth = lambda g: (-sum(rank.get(c, 20) for c in g), g)
    return None if query is None else frozenset(frozenset(sorted(a, key=worth)[:SELECTIVE]) for a in query)


def _marks(text: Column, grams: list[str]) -> list[Column]:
    """Longs whose bits tell which of ``grams`` a text holds, 62 a column."""
    low = F.lower(text)
    out = []
    for at in range(0, len(grams), 62):
        bit = F.lit(0).cast("long")
        for k, g in enumerate(grams[at : at + 62]):
            bit = bit + F.contains(low, F.lit(g)).cast("long") * F.lit(1 << k).cast("long")
        out.append(bit.alias(f"marks{at // 62}"))
    return out


def postings(marked: DataFrame, count: int) -> DataFrame:
    """(block, gram, rows): the rows of a block that hold a trigram, from (rid, marks0, ..); gram is the trigram's place."""
    each = [f"transform(filter(sequence(0, 61), i -> shiftright(marks{k}, i) & 1 = 1), i -> i + {62 * k})" for k in range(-(-count // 62))]
    rows = marked.select("rid", F.shiftright("rid", BLOCK_BITS).alias("block"), F.explode(F.expr(f"concat({', '.join(each)})")).alias("gram"))
    return rows.groupBy("block", "gram").agg(F.collect_list("rid").alias("rows"))


def _marked(bit: int):
    return lambda rid: F.struct(rid.alias("rid"), F.lit(bit).cast("long").alias("bit"))


def _of_order(k: int):
    return lambda span: span["ord"] == k


def candidates(index: DataFrame, grams: list[str], queries: dict[int, Query]) -> DataFrame:
    """(rid, rules): rows that hold the trigrams of a rule; bit k of rules stands for the k-th rule."""
    place, none = {g: i for i, g in enumerate(grams)}, F.array().cast("array<long>")
    lists = index.groupBy("block").agg(*[F.coalesce(F.first(F.when(F.col("gram") == i, F.col("rows")), ignorenulls=True), none).alias(f"p{i}") for i in range(len(grams))])
    found = []
    for k, query in queries.items():
        either = none
        for ands in sorted(map(sorted, query)):
            cut = F.col(f"p{place[ands[0]]}")
            for g in ands[1:]:
                cut = F.array_intersect(cut, F.col(f"p{place[g]}"))
            either = F.array_union(either, cut)
        found.append(F.transform(either, _marked(1 << k)))
    each = lists.select(F.explode(F.concat(*found)).alias("c")).select("c.rid", "c.bit")
    return each.groupBy("rid").agg(F.bit_or("bit").alias("rules"))


SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """array<struct<start, kind_order, end, kind>> of a rule's matches, in code points.

    The pieces between the matches and the matches themselves are laid end to end. Finished spans are kept in groups of
    256, so that a text with very many matches isn't copied again for each.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"), groups.alias("grp"))
    kind = "struct<start:int,ord:int,end:int,kind:string>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{kind}>").alias("cur"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        cur = F.when(F.length(x["grp"]) >= rule.least, F.concat(acc["cur"], one)).otherwise(acc["cur"])
        full = F.size(acc["cur"]) >= 256
        return F.struct(
            end.alias("pos"),
            F.when(full, F.when(F.length(x["grp"]) >= rule.least, one).otherwise(F.array().cast(f"array<{kind}>"))).otherwise(cur).alias("cur"),
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
        )

    spans = F.aggregate(rows, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))
    return F.when(F.regexp_like(text, pattern), spans).otherwise(F.array().cast(f"array<{kind}>"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans array<struct<start, ord, end, kind>> by start and then rule order, for each row of (doc_id, text)."""
    rows, names = addressed(docs)
    own = rows.select(*[F.col(n).alias(f"row{k}") for k, n in enumerate(names)], F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, key, empty = F.col("text"), ["row0", "row1"], F.array().cast(SPANS)
    queries = {k: selective(q) for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for a in q for g in a})
    scan = [_spans(text, k, r) for k, r in enumerate(rules) if k not in queries]
    first = durable(own.select(*key, "doc_id", *_marks(text, grams), (F.concat(*scan) if scan else empty).alias("spans")))
    if not grams:
        return first.select("doc_id", F.array_sort("spans").alias("spans"))
    marked = first.withColumn("rid", F.monotonically_increasing_id())
    picked = candidates(postings(marked, len(grams)), grams, queries).join(marked.select("rid", *key), "rid").select(*key, "rules")
    searched = [F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, _spans(text, k, rules[k])).otherwise(empty) for k in queries]
    more = meet(own.drop("doc_id"), picked, key, "inner").select(*key, F.concat(*searched).alias("more")).where(F.size("more") > 0)
    return first.join(more, key, "left").select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", empty))).alias("spans"))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """One row a document: counts of the base kinds, the digest of the base spans, and all spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = secret_spans(docs, rules)
    counts = [F.size(F.filter("spans", _of_order(k))).cast("long").alias(f"n_{rules[k].kind}") for k in range(base)]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s["ord"] < base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
