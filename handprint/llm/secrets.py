"""Secret scans with a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: what every
match must contain.  Postings (trigram, document) are built for the trigrams
that some rule asks for, a document's postings are intersected into the rules
it can match, and only these rules' regexes run on its text.  A rule without
mandatory trigrams scans every text.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handprint.llm.common import narrowed, pinned, row_key

#: Literal strings that a piece of a regex may expand to before it is cut.
EXPAND = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, not overlapping) whose
    ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules.  Runs of one class are greedy, so a minimum on
#: such a run may stand in the pattern: a shorter run holds no longer one.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: A trigram query: alternatives, each a set of trigrams that must all occur.
#: An alternative without trigrams means that anything may match.
Query = frozenset[frozenset[str]]


def _trigrams(word: str) -> frozenset[str]:
    return frozenset(word[i:i + 3] for i in range(len(word) - 2))


def _least(alternatives) -> Query:
    """Alternatives that contain another one add nothing."""
    sets = set(alternatives)
    return frozenset(s for s in sets if not any(other < s for other in sets))


def _both(a: Query, b: Query) -> Query:
    return _least(x | y for x in a for y in b)


_ANY: Query = frozenset([frozenset()])


def _walk(sequence) -> tuple[set[str] | None, Query]:
    """Exact lower-case strings of a parsed sequence (None: too many), and its query."""
    exact: set[str] | None = {""}
    held: set[str] = {""}
    query = _ANY

    def close() -> None:
        nonlocal held, query
        query = _both(query, _least(_trigrams(w) for w in held))
        held = {""}

    for op, arg in sequence:
        strings: set[str] | None = None
        inner = _ANY
        if op is rc.LITERAL:
            strings = {chr(arg).lower()}
        elif op is rc.IN and len(arg) <= 4 and all(o is rc.LITERAL for o, _ in arg):
            strings = {chr(c).lower() for _, c in arg}
        elif op is rc.AT:
            strings = {""}
        elif op is rc.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is rc.BRANCH:
            parts = [_walk(part) for part in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            inner = _least(q for _, query_of in parts for q in query_of)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, body = arg
            strings_of, query_of = _walk(body)
            if strings_of is not None and (low, high) == (0, 1):
                strings = strings_of | {""}
            elif strings_of is not None and low == high == 1:
                strings = strings_of
            elif low > 0:
                inner = query_of
        if strings is not None and len(strings) * len(held) <= EXPAND:
            held = {a + b for a, b in product(held, strings)}
            if exact is not None:
                exact = {a + b for a, b in product(exact, strings)}
        else:
            exact = None
            close()
            query = _both(query, inner)
    close()
    return exact, query


def trigram_query(pattern: str) -> Query:
    """Lower-case trigrams that a match must contain, as alternatives."""
    return _walk(rp.parse(pattern))[1]


def _any_case(char: str) -> str:
    """A class of a lower-case character and its upper-case form."""
    forms = [char] + [u for u in (char.upper(),) if len(u) == 1 and u != char]
    return "".join(f"\\x{{{ord(c):x}}}" for c in forms)


def one_of(words: set[str]) -> str:
    """A pattern for any of some strings of equal length, in any case, branching by character.

    Characters with the same continuations share a class, so that a text's
    character is mostly compared once.
    """
    tails: dict[str, set[str]] = {}
    for word in words:
        tails.setdefault(word[0], set()).add(word[1:])
    same: dict[frozenset[str], list[str]] = {}
    for char, rest in sorted(tails.items()):
        same.setdefault(frozenset(rest), []).append(char)
    branches = [f"[{''.join(map(_any_case, chars))}]" + (one_of(set(rest)) if "" not in rest else "")
                for rest, chars in same.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, row): documents whose text holds a trigram in any case, of those given.

    One pass over a text finds them all: at every place the pattern looks ahead
    for any of the trigrams, which may overlap, if one begins with the character
    there.
    """
    first = f"[{''.join(_any_case(c) for c in sorted({t[0] for t in trigrams}))}]"
    found = F.regexp_extract_all("text", F.lit(f"(?={first})(?=({one_of(set(trigrams))}))"),
                                 F.lit(1))
    held = F.array_distinct(F.transform(found, F.lower))
    return docs.select(F.explode(held).alias("trigram"), "row")


def candidates(posted: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(row, kinds): the kinds whose trigram query a document's postings satisfy."""
    held = posted.groupBy("row").agg(F.collect_set("trigram").alias("held"))

    def fits(query: Query) -> Column:
        return F.greatest(*[F.size(F.array_intersect(
            "held", F.array(*[F.lit(t) for t in sorted(need)]))) == len(need)
            for need in sorted(query, key=sorted)], F.lit(False))
    kinds = F.array_compact(F.array(*[F.when(fits(q), F.lit(kind))
                                      for kind, q in sorted(queries.items())]))
    return held.select("row", kinds.alias("kinds")).where(F.size("kinds") > 0)


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches in code points, end exclusive.

    The text is split at the matches; the lengths of the stretches between
    and of the matches themselves add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
                         .alias("gap"), found.alias("match"), checked.alias("part"))

    def step(so_far: Column, one: Column) -> Column:
        start = so_far["at"] + F.length(one["gap"])
        end = start + F.length(one["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("kind"),
                                end.alias("end")))
        return F.struct(end.alias("at"), F.when(
            F.length(one["part"]) >= rule.least, F.concat(so_far["out"], span))
            .otherwise(so_far["out"]).alias("out"))
    nothing = F.array().cast(_SPANS)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("out"))
    made = F.aggregate(steps, begin, step, lambda end: end["out"])
    return F.when(text.rlike(rule.pattern), made).otherwise(nothing)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id and ``found``, its spans by start, then rule.

    A span is (start, kind, end): code points, end exclusive, kind the rule's
    place in ``rules``.  Null counts as the empty text, which has no spans.  Rows
    are known by a hash of id and text: rows alike in both, null ids included,
    get the same spans; should two hashes meet, a regex runs once in vain.  An
    empty table gives an empty result.

    The join brings a document's candidate rules to its text.  Spark
    broadcasts them where their written size allows and shuffles otherwise.
    """
    base = narrowed(docs, id=id_col, text=text_col)
    base = base.select("id", F.coalesce("text", F.lit("")).alias("text"),
                       row_key(F.col("id"), F.col("text")).alias("row"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    needed = sorted({t for q in indexed.values() for need in q for t in need})
    if needed:
        able = pinned(candidates(postings(base, needed), indexed), "candidates")
        base = base.join(able, "row", "left")
    else:
        base = base.withColumn("kinds", F.array().cast("array<string>"))
    nothing = F.array().cast(_SPANS)
    spans = [_spans(F.col("text"), rule, place) if rule.kind not in indexed
             else F.when(F.array_contains("kinds", rule.kind),
                         _spans(F.col("text"), rule, place)).otherwise(nothing)
             for place, rule in enumerate(rules)]
    return base.select(F.col("id").alias(id_col), F.array_sort(F.concat(*spans)).alias("found"))


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
