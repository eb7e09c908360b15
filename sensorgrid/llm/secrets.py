"""Secret scanning through a trigram index, with DataFrame functions only.

Each rule's regular expression is analysed once into a Boolean query over trigrams (an OR of ANDs) that every match
must satisfy. The postings (trigram, document) of the trigrams that some rule needs are taken from the lower-cased
texts; for each rule the postings of a clause are intersected, and only the surviving documents are verified with the
expression itself. A rule from which no mandatory trigram follows scans all documents.

Texts are shuffled only where they join with their candidates; what else is shuffled are keys and spans, which are
aggregated within the map task first, as all postings of a document arise in one task.

Edge cases: a null text is an empty one and has no spans; a null doc_id is kept as null; repeated rows each give a row;
an empty table gives an empty result; other columns are ignored. Positions are code points, ends exclusive. Matches are
leftmost and non-overlapping within a kind; kinds may overlap one another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that an expression's exact part may have before it is turned into trigrams.
MAX_EXACT = 32
#: Clauses that a query may have; beyond it the weaker of two sides is dropped, which only adds candidates.
MAX_CLAUSES = 64

Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the given group has at least min_length characters."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE + MORE


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_CLAUSES:
        return min(a, b, key=len)
    return _least(x | y for x in a for y in b)


def _least(clauses) -> Query:
    """Without clauses that another one implies."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: set[str]) -> Query:
    """Each match holds one of these strings."""
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


class _Part:
    """What is known of a match: one of `exact` (None: unknown), and that `query` holds."""

    def __init__(self, exact: set[str] | None, query: Query = EVERYTHING):
        self.exact, self.query = exact, query


def _in_class(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < 5:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 5 else None


def _part(op, value) -> _Part:
    if op is ops.LITERAL:
        return _Part({chr(value).lower()})
    if op is ops.IN:
        return _Part(_in_class(value))
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        exact = set().union(*(p.exact for p in parts)) if all(p.exact is not None for p in parts) else None
        if exact is not None and len(exact) <= MAX_EXACT:
            return _Part(exact)
        clauses = [c for p in parts for c in (p.query if p.exact is None else _of_strings(p.exact))]
        return _Part(None, _least(clauses) if len(clauses) <= MAX_CLAUSES else EVERYTHING)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        least, most, body = value
        inner = _sequence(body)
        if inner.exact is not None and most == 1:
            return _Part(inner.exact | {""} if least == 0 else inner.exact)
        if least == 0:
            return _Part(None)
        return _Part(None, inner.query if inner.exact is None else _of_strings(inner.exact))
    return _Part({""} if op is ops.AT else None)


def _sequence(items) -> _Part:
    exact, query, whole = {""}, EVERYTHING, True
    for op, value in items:
        part = _part(op, value)
        joined = {a + b for a in exact for b in part.exact} if part.exact is not None else None
        if joined is not None and len(joined) <= MAX_EXACT:
            exact = joined
            continue
        query, whole = _both(query, _of_strings(exact)), False
        exact = part.exact if part.exact is not None and len(part.exact) <= MAX_EXACT else {""}
        query = _both(query, part.query)
    return _Part(exact) if whole else _Part(None, _both(query, _of_strings(exact)))


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams; every text with a match holds all trigrams of one clause."""
    part = _sequence(_parser.parse(pattern))
    return part.query if part.exact is None else _of_strings(part.exact)


def indexed(rule: Rule) -> bool:
    return all(trigram_query(rule.pattern))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Rows (k1, k2, trigram) for the given trigrams that occur in docs (k1, k2, text), case aside."""
    wanted = F.array(*map(F.lit, trigrams))
    # The outer transform binds the lower-cased text once for all trigrams.
    present = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    return docs.select("k1", "k2", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (k1, k2, kinds): kinds of which some clause's postings all hold the document."""
    clauses = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for t in c]
    table = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    found = postings(docs, sorted({t for _, _, t, _ in clauses})).join(F.broadcast(table), "trigram")  # the rules' own table
    met = found.groupBy("k1", "k2", "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, from the lengths of the matches and of what lies between them."""
    regex = F.lit(rule.regex)
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length).alias("told"),
    )
    matches = F.filter(lengths, lambda x: x["size"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(
        matches,
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["told"] < rule.min_length, acc["found"])
            .otherwise(F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end")))))
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(F.rlike(text, regex), walked).otherwise(none)


def _tagged(text: Column, rule: Rule, order: int, wanted: Column | None = None) -> Column:
    found = F.transform(spans(text, rule), lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))
    return found if wanted is None else F.when(wanted, found).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, spans): spans is an array of (start, ord, kind, end) by start, then by the rules' order."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})
    order = {r.kind: i for i, r in enumerate(rules)}
    by_index = tuple(r for r in rules if indexed(r))
    text = F.col("text")
    scanned = F.concat(_no_spans(), *(_tagged(text, r, order[r.kind]) for r in rules if r not in by_index))
    whole = keyed.select("doc_id", "k1", "k2", scanned.alias("scanned"))
    if not by_index:
        return whole.select("doc_id", F.array_sort("scanned").alias("spans"))
    checked = keyed.select("k1", "k2", "text").join(candidates(keyed, by_index), ["k1", "k2"])
    verified = F.concat(*(_tagged(text, r, order[r.kind], F.array_contains("kinds", r.kind)) for r in by_index))
    found = checked.select("k1", "k2", verified.alias("verified")).where(F.size("verified") > 0).dropDuplicates(["k1", "k2"])
    every = F.concat("scanned", F.coalesce("verified", _no_spans()))
    return whole.join(found, ["k1", "k2"], "left").select("doc_id", F.array_sort(every).alias("spans"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", *(of(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result as SQL, without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = []
    for i, r in enumerate(rules):
        kinds.append(f"""
  select rid, {i} as ord, '{r.kind}' as kind, m, told, gaps,
         list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) as starts,
         {r.min_length} as least
  from (select rid, regexp_extract_all(text, {quote(r.regex)}) as m, regexp_extract_all(text, {quote(r.regex)}, {r.group}) as told,
               string_split_regex(text, {quote(r.regex)}) as gaps from d where regexp_matches(text, {quote(r.regex)}))""")
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
k as ({' union all '.join(kinds)}),
s as (
  select rid, ord, kind, cast(starts[j] as bigint) as a, cast(starts[j] + length(m[j]) as bigint) as b
  from (select *, unnest(range(1, len(m) + 1)) as j from k) where length(told[j]) >= least),
g as (
  select rid, count(*) filter (ord = 0) as n0, count(*) filter (ord = 1) as n1, count(*) filter (ord = 2) as n2,
         string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) filter (ord < 3) as base,
         string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) as spans
  from s group by rid)
select doc_id, cast(coalesce(n0, 0) as bigint) as n_assign, cast(coalesce(n1, 0) as bigint) as n_access,
       cast(coalesce(n2, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (rid)
"""


def compiled(rule: Rule) -> re.Pattern:
    """The rule for Python's re, for tests and callers outside Spark."""
    return re.compile(rule.regex, re.ASCII)
