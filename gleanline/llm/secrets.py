"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regex is turned into a Boolean trigram query (Cox, "Regular Expression Matching with a Trigram Index",
2012). The index holds a posting (trigram, document) for the trigrams that some rule asks for; the postings of a
conjunction are intersected, and only the candidates' whole texts are matched. A rule without mandatory trigrams
scans everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import free_name, table, text_or_empty

_sre = re._parser  # the standard library's own parse of a regex


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that Java and Python read alike, the group that must have least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run that is too short ends where every match inside it would end, so the least length can stand in the regex
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public token formats that the base rules do not know.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Alternatives kept apart while a query is derived; beyond that a part asks for nothing.
MOST_STRINGS = 64


def _strings(node) -> tuple[set[str] | None, list[frozenset[str]]]:
    """The exact lower-case strings of a parsed part (None if not few), and what must occur: one string of each set."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, []
    if name == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 4:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (out, []) if len(out) <= 8 else (None, [])
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(exact is not None and not must for exact, must in parts):
            return set().union(*(exact for exact, _ in parts)), []
        musts = [must or ([frozenset(exact)] if exact else []) for exact, must in parts]
        # one set that holds for whichever branch is taken
        return None, [frozenset().union(*(max(m, key=lambda s: min(map(len, s))) for m in musts))] if all(musts) else []
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, sub = arg
        exact, must = _sequence(sub)
        if (low, high) == (0, 1) and exact is not None and not must:
            return exact | {""}, []
        if low == high == 1:
            return exact, must
        return None, must if low else []
    return None, []


def _sequence(parsed) -> tuple[set[str] | None, list[frozenset[str]]]:
    musts: list[frozenset[str]] = []
    run, whole = {""}, True
    for node in parsed:
        exact, inner = _strings(node)
        joined = {a + b for a, b in product(run, exact)} if exact is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
            continue
        musts += [frozenset(run), *inner]
        run, whole = (exact if exact is not None else {""}), False
    return (run, musts) if whole and not musts else (None, [*musts, frozenset(run)])


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """A disjunction of conjunctions of lower-case trigrams that every match of pattern satisfies; empty if there is none.

    Letters are taken in lower case, so the index is over lower-cased text and holds for either case.
    """
    exact, musts = _sequence(_sre.parse(pattern))
    groups = musts or ([frozenset(exact)] if exact else [])
    ors = [[frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in group] for group in groups if group and all(len(s) >= 3 for s in group)]
    out: set[frozenset[str]] = {frozenset()}
    for group in ors:
        if len(out) * len(group) <= MOST_STRINGS:
            out = {a | b for a in out for b in group}
    out = {c for c in out if not any(d < c for d in out)}
    return sorted(out, key=sorted) if out != {frozenset()} else []


def _let(x: Column, of) -> Column:
    """of(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _before(xs: Column, op, chunk: int = 64) -> Column:
    """Of each number of an array what op makes, from 0, of those before it.

    In chunks, since an array that grows by one is copied each time: first a chunk's own total, then what is before
    the chunk, then what is before each of its numbers.
    """

    def running(own, first):
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        return F.aggregate(own, F.struct(first.alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    def whole(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op))
        both = F.arrays_zip(chunks.alias("own"), running(totals, F.lit(0)).alias("first"))
        return F.flatten(F.transform(both, lambda z: running(z["own"], z["first"])))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int")), lambda c: F.slice(xs, c * chunk + 1, F.lit(chunk)))
    return F.when(F.size(xs) > 0, _let(cut, whole)).otherwise(F.array().cast("array<int>"))


def _found(rule: Rule, order: int, text: Column) -> Column:
    """All spans of a rule in text, as structs (start, order, kind, end) in code points.

    The pieces between the matches and the matches themselves are summed up to positions.
    """
    wanted = f"({rule.pattern})"
    whole, between = F.regexp_extract_all(text, F.lit(wanted), F.lit(1)), F.split(text, wanted, -1)
    secret = F.regexp_extract_all(text, F.lit(wanted), F.lit(rule.group + 1))
    step = F.arrays_zip(F.transform(whole, F.char_length).alias("own"), F.transform(between, F.char_length).alias("gap"), F.transform(secret, F.char_length).alias("size"))

    def spans(z):
        def of(before):
            def one(x, i):
                start = F.get(before, i) + x["gap"]
                return F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + x["own"]).alias("end"), x["size"].alias("size"))

            kept = F.filter(F.transform(z, one), lambda x: x["size"] >= max(rule.least, 1))
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))

        return _let(_before(F.transform(z, lambda x: x["gap"] + F.coalesce(x["own"], F.lit(0))), lambda a, x: a + x), of)

    return F.when(text.rlike(rule.pattern), _let(step, spans))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(tri, doc_id, h): in which documents a trigram (by its number) occurs, letters in either case; h is a hash of the text."""
    low = docs.select("doc_id", F.xxhash64("text").alias("h"), F.lower(text_or_empty()).alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return low.select("doc_id", "h", F.explode(has).alias("tri"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[int]]:
    """(doc_id, h, rules array of numbers) from the intersected postings, and the numbers of the rules that must scan everything."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*(c for q in queries for c in q)))
    at = {t: i for i, t in enumerate(trigrams)}
    asked = [(i, at[t]) for i, c in enumerate([c for q in queries for c in q]) for t in sorted(c)]
    size: dict[int, int] = {}
    for i, _ in asked:
        size[i] = size.get(i, 0) + 1
    rule_of = [r for r, q in enumerate(queries) for _ in q]
    # which conjunctions name a trigram: a map of as many entries as the rules have trigrams
    wanted = F.create_map(*(x for t in sorted({t for _, t in asked}) for x in (F.lit(t), F.array(*(F.lit(i) for i, u in asked if u == t)))))
    sizes, owners = F.array(*(F.lit(size[i]) for i in sorted(size))), F.array(*map(F.lit, rule_of))
    met = postings(docs, trigrams).distinct().select("doc_id", "h", F.explode(wanted[F.col("tri")]).alias("conj"))
    met = met.groupBy("doc_id", "h", "conj").count().where(F.col("count") == F.get(sizes, F.col("conj")))
    out = met.groupBy("doc_id", "h").agg(F.collect_set(F.get(owners, F.col("conj"))).alias("rules"))
    return out, [r for r, q in enumerate(queries) if not q]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, name: str = "spans") -> DataFrame:
    """docs with a column name: array<struct<start, ord, kind, end>>, sorted; code points, end exclusive.

    Every row comes back, with all its columns (one called name is replaced).
    A null text counts as empty and has no spans; matches of a rule do not overlap, those of two rules may.
    Repeated rows and rows without doc_id are scanned like any other: candidates are met by doc_id and a hash of the
    text, so that rows which share an id, or have none, spread. Time grows with a text's length and its matches.
    """
    few, full = candidates(docs.select("doc_id", "text"), rules)
    own_id, own_h, own_rules = (free_name(docs, c) for c in ("cand_id", "cand_h", "cand_rules"))
    few = few.toDF(own_id, own_h, own_rules)
    text = text_or_empty()
    joined = docs.drop(name).join(few, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_h)), "left")
    found = [_found(r, i, text) if i in full else F.when(F.array_contains(own_rules, i), _found(r, i, text)) for i, r in enumerate(rules)]
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    return joined.withColumn(name, F.sort_array(F.concat(*(F.coalesce(x, none) for x in found)))).drop(own_id, own_h, own_rules)


def _redacted(text: Column, spans: Column, mark: str, page: int = 4096) -> Column:
    """text without the spans, each run of spans that touch replaced by mark.

    The text is cut into pages first, because a substring is sought from the start of its string.
    """

    def pieces(pages):
        def cut(a, b):
            some = F.array_join(F.slice(pages, F.floor(a / page).cast("int") + 1, (F.floor(b / page) - F.floor(a / page)).cast("int") + 1), "")
            return F.substring(some, a % page + 1, b - a)

        def of(ends):
            # a span begins a new run if it starts beyond all ends before it; the run ends where the next one has its ends before
            fresh = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(ends, i).alias("before"), i.alias("i"))), lambda s: (s["i"] == 0) | (s["start"] > s["before"]))
            gaps = F.transform(fresh, lambda s: cut(F.when(s["i"] == 0, 0).otherwise(s["before"]), s["start"]))
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(gaps, mark), F.lit(mark), cut(last, F.char_length(text)))

        return _let(_before(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), of)

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{page}}}"), F.lit(0)), pieces)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of text replaced by mark (spans that overlap or touch by one), and n_chars to match where there is such a column.

    Texts without spans, nulls among them, stay as they are.
    """
    name = free_name(docs, "spans")
    found = secret_spans(docs, rules, name)
    hit = F.size(name) > 0
    out = found.withColumn("text", F.when(hit, _redacted(F.col("text"), F.col(name), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, repeated ones too; null text counts as empty: no spans, the hash of nothing."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
