"""Secret scans: Boolean trigram queries over an inverted index, then exact verification.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is derived:
an OR of ANDs of trigrams, lower-cased, of which one AND must be present in any
text that the rule matches. The index holds the posting lists (trigram, document) of every
trigram that some rule asks for; no other list can ever be read, so no other is
stored. Lists are intersected by document; only documents that satisfy a rule's query are
matched against that rule. A rule without mandatory trigrams (a long run of hex digits) has no
query and scans every text.

Everything is built-in functions. Spans are code points, end exclusive: with k matches a text
splits into k + 1 pieces, and running lengths of pieces and matches give the places.

A null or empty text has no spans. Repeated rows each get their row: documents are told apart
by id and text hash, and rows equal in both have equal results. Rows with a null id are scanned
too. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as c  # the standard library's own parse tree
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import stage, text_rows


@dataclass(frozen=True)
class Rule:
    """`value` is the group whose length must reach `least`; its match is the span."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


# The rules. The first three are the base ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same spans as AKIA[A-Z0-9]+ of 20 or more
    Rule("hex", r"[0-9a-f]{24,}"),  # the same spans as [0-9a-f]+ of 24 or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

#: A literal alternative set beyond this size stops growing: its trigrams so far are kept as the query.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs that a match implies, or None where nothing is mandatory.

    A node is known either exactly (the finite set of strings it matches) or not; runs of
    exactly known nodes are joined, and each run implies, by alternatives, the trigrams of one of its strings.
    """
    clauses = _implied(_parser.parse(pattern).data)
    return clauses or None


def _implied(nodes) -> list[frozenset[str]]:
    """Of a sequence of nodes: the query of the most selective part (longest shortest alternative)."""
    options: list[list[frozenset[str]]] = []
    run = {""}

    def close():
        nonlocal run
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(grams):
            options.append(list(dict.fromkeys(grams)))
        run = {""}

    for op, arg in nodes:
        exact = _strings(op, arg)
        if exact is not None:
            if len(run) * len(exact) > MOST_STRINGS:
                close()
            run = {a + b for a in run for b in exact} if len(exact) <= MOST_STRINGS else {""}
            continue
        close()
        inner = None
        if op is c.SUBPATTERN:
            inner = _implied(arg[3].data)
        elif op is c.BRANCH:
            each = [_implied(x.data) for x in arg[1]]
            inner = [q for part in each for q in part] if all(each) else None
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
            inner = _implied(arg[2].data)
        if inner:
            options.append(inner)
    close()
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=[])


def _strings(op, arg) -> set[str] | None:
    """Every string that a node matches, lower-cased, where there are few."""
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op is c.SUBPATTERN:
        return _joined(arg[3].data)
    if op is c.BRANCH:
        each = [_joined(x.data) for x in arg[1]]
        return set().union(*each) if all(x is not None for x in each) else None
    if op is c.IN and all(k is c.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(x).lower() for _, x in arg}
    if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] == 1:
        inner = _joined(arg[2].data)
        return inner if inner is None or arg[0] else inner | {""}
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _strings(op, arg)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


# --- index and search

KEY = ("doc_id", "text_hash")


def trigram_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the given trigrams, over every text."""
    low = rows.select(*KEY, F.lower("text").alias("low"))
    held = low.select(*KEY, F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)).alias("held"))
    return held.select(*KEY, F.explode("held").alias("trigram")).filter(F.col("trigram").isNotNull())


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, text_hash, kinds): documents whose postings satisfy a rule's query.

    The postings of one document meet in one group of at most as many rows as there are
    trigrams, whatever the length of a list: no list is ever gathered. Repeated rows
    repeat postings, which the flags absorb.
    """
    wanted = sorted({t for q in queries.values() for clause in q for t in clause})
    flags = [F.max(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(wanted)]
    has = {t: F.coalesce(F.col(f"t{i}"), F.lit(False)) for i, t in enumerate(wanted)}
    met = []
    for kind, query in queries.items():
        either = F.lit(False)
        for clause in query:
            every = F.lit(True)
            for t in sorted(clause):
                every = every & has[t]
            either = either | every
        met.append(F.when(either, F.lit(kind)))
    grouped = index.groupBy(*KEY).agg(*flags)
    kinds = F.array_compact(F.array(*met))
    return grouped.select(*KEY, kinds.alias("kinds")).filter(F.size("kinds") > 0)


def span_list(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, kind, end) of a rule's leftmost non-overlapping matches."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, 0), F.char_length)
    value = F.transform(F.regexp_extract_all(text, pattern, rule.value), F.char_length) if rule.value else whole

    def start(i: Column) -> Column:
        before = F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, b: a + b)
        return before + F.aggregate(F.slice(whole, 1, i), F.lit(0), lambda a, b: a + b)

    spans = F.transform(
        F.arrays_zip(whole.alias("whole"), value.alias("value")),
        lambda x, i: F.struct(
            start(i).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            (start(i) + x["whole"]).alias("end"), x["value"].alias("value"),
        ),
    )
    return F.filter(spans, lambda s: s["value"] >= rule.least)


def written(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, one count a rule (n_<kind>) and the array of spans of every row."""
    rows = text_rows(docs, id_col, text_col).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash")
    )
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:int>>)")

    def spans(rank: int, rule: Rule, wanted: Column) -> Column:
        return F.when(wanted, span_list(F.col("text"), rule, rank)).otherwise(none)

    of = {r.kind: spans(i, r, F.col("text").rlike(r.pattern)) for i, r in enumerate(rules) if r.kind not in queries}
    out = rows.select(*KEY, *(v.alias(k) for k, v in of.items()))
    if queries:
        trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
        found = stage(candidates(trigram_index(rows, trigrams), queries))
        of = {
            r.kind: spans(i, r, F.array_contains("kinds", r.kind)) for i, r in enumerate(rules) if r.kind in queries
        }
        # only candidates' texts are matched; Spark filters the texts by them before a shuffle, or broadcasts them
        verified = (
            rows.join(found.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "kinds"), _same())
            .select(*KEY, *(v.alias(k) for k, v in of.items()))
            .dropDuplicates(list(KEY))
            .select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), *of)
        )
        out = out.join(verified, _same(), "left").drop("id_", "hash_")
    lists = {r.kind: F.coalesce(r.kind, none) for r in rules}
    return out.select(
        "doc_id",
        *(F.size(v).cast("long").alias(f"n_{k}") for k, v in lists.items()),
        F.flatten(F.array(*lists.values())).alias("spans"),
    )


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_"))


def digest(found: DataFrame, base: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """The spans as text, and the digest of the base ones."""
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *(f"n_{k}" for k in base), F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


