"""Secret scans by a trigram inverted index, DataFrame functions only.

Each rule's regex is turned into a Boolean query over lower-case trigrams: an
AND of clauses, each an OR of alternatives, each an AND of trigrams.  The index
holds one posting (trigram, doc_id) for every trigram that some rule needs and
the document has.  Postings are intersected per document, the candidates of a
rule are verified with the regex, and a rule without mandatory trigrams scans
every document.

Spans are code points, end exclusive; matches of a rule are leftmost and do not
overlap, those shorter than the rule's least length are dropped.  Defined
results: a null or empty text has no spans; a row without doc_id has no posting
and is scanned by all rules; rows that share a doc_id share their postings and
are verified on their own text; other columns are kept as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A match of ``body`` (one capturing group at most) is kept if it has ``least`` code points, or its group ``group`` has."""

    kind: str
    body: str
    least: int = 0
    group: int = 0


#: Fixed patterns; the first three are the base kinds, in their order.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
VARIANTS = 64  # strings a clause may expand to before it is closed


# ---- regex -> Boolean trigram query --------------------------------------

def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of clauses, each a list of alternatives (sets of trigrams); empty if nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        found = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if strings and frozenset() not in found:
            kept = [a for a in found if not any(b < a for b in found)]
            if kept not in clauses:
                clauses.append(sorted(kept, key=sorted))

    def exact(tokens) -> set[str] | None:
        """All lower-case strings of a piece, or None where they are many."""
        out = {""}
        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                step = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                step = {chr(v).lower() for _, v in arg}
            elif name == "SUBPATTERN":
                step = exact(arg[3])
            elif name == "BRANCH":
                parts = [exact(b) for b in arg[1]]
                step = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] <= 8:
                one = exact(arg[2])
                step = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)} if len(one) ** arg[1] <= VARIANTS else None
            else:
                return None
            if step is None or len(out) * len(step) > VARIANTS:
                return None
            out = {a + b for a in out for b in step}
        return out

    def walk(tokens) -> None:
        run = {""}
        for token in tokens:
            step = exact([token])
            if step is not None and len(run) * len(step) <= VARIANTS:
                run = {a + b for a in run for b in step}
                continue
            close(run)
            run = step if step is not None else {""}
            if step is None:
                op, arg = token
                if str(op) == "SUBPATTERN":
                    walk(arg[3])
                elif str(op) == "MAX_REPEAT" and arg[0] > 0:
                    walk(arg[2])
        close(run)

    walk(list(re._parser.parse(regex)))
    return clauses


def mandatory_trigrams(rules=RULES) -> list[str]:
    """Every trigram of some rule's query, sorted; bounded by the rules."""
    return sorted({t for r in rules for clause in trigram_query(r.body) for alt in clause for t in alt})


# ---- index -----------------------------------------------------------------

def trigram_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams, without case; rows without id are left out."""
    low = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.lower(F.col(f"`{text}`").cast("string")).alias("low")).where("doc_id IS NOT NULL AND low IS NOT NULL")
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return low.select(F.explode(has).alias("trigram"), "doc_id")


def _bits(n: int) -> list[str]:
    return [f"w{i}" for i in range((n + 61) // 62)]


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): bit r is set where the postings satisfy the query of rule r; ids without any are absent."""
    trigrams = mandatory_trigrams(rules)
    place = {t: (i // 62, 1 << (i % 62)) for i, t in enumerate(trigrams)}
    code = F.create_map(*[x for t in trigrams for x in (F.lit(t), F.lit(place[t][1]))])
    word = F.create_map(*[x for t in trigrams for x in (F.lit(t), F.lit(place[t][0]))])
    coded = index.select("doc_id", word[F.col("trigram")].alias("word"), code[F.col("trigram")].cast("long").alias("bit"))
    met = coded.groupBy("doc_id").agg(*[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(_bits(len(trigrams)))])

    def holds(alternative) -> Column:
        masks: dict[int, int] = {}
        for t in alternative:
            masks[place[t][0]] = masks.get(place[t][0], 0) | place[t][1]
        out = F.lit(True)
        for i, m in masks.items():
            out = out & (F.col(f"w{i}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
        return out

    mask = F.lit(0)
    for r, rule in enumerate(rules):
        query = trigram_query(rule.body)
        if query:
            ok = F.lit(True)
            for clause in query:
                some = F.lit(False)
                for alternative in clause:
                    some = some | holds(alternative)
                ok = ok & some
            mask = mask.bitwiseOR(F.when(ok, F.lit(1 << r)).otherwise(F.lit(0)))
    return met.select("doc_id", mask.alias("rules")).where("rules > 0")


# ---- verification -------------------------------------------------------------

def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of one rule: the gap before each match and the match itself give its place."""
    whole = f"(?s)(.*?)(?:({rule.body})|\\z)"
    gaps, hits = F.regexp_extract_all(text, F.lit(whole), F.lit(1)), F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    counted = F.regexp_extract_all(text, F.lit(whole), F.lit(2 + rule.group)) if rule.group else hits
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(counted, F.length).alias("size"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = (x["hit"] > 0) & (x["size"] >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(steps, empty, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", result: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, ord, end, kind>> by start, then rule order."""
    pruned = [bool(trigram_query(r.body)) for r in rules]
    found = candidates(trigram_index(docs, mandatory_trigrams(rules), doc_id, text), rules).select(F.col("doc_id").alias("__cand"), F.col("rules").alias("__rules"))
    key = F.col(f"`{doc_id}`")
    joined = docs.join(found, key == F.col("__cand"), "left") if any(pruned) else docs.withColumns({"__cand": key, "__rules": F.lit(0)})
    everything = sum(1 << r for r in range(len(rules)))
    mask = F.when(key.isNull(), F.lit(everything)).otherwise(F.coalesce(F.col("__rules"), F.lit(0)))
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    parts = []
    for r, rule in enumerate(rules):
        hit = value.rlike(rule.body)
        wanted = (mask.bitwiseAND(F.lit(1 << r)) != 0) & hit if pruned[r] else hit
        parts.append(F.when(wanted, spans_of(value, rule, r)).otherwise(none))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != result]
    return joined.select(*kept, F.array_sort(F.concat(*parts)).alias(result))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every maximal run of overlapping spans replaced by ``mark``; same columns."""
    found = scan(docs, rules, doc_id, text, "__spans")
    value = F.col(f"`{text}`").cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(value, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]), inside).otherwise(fresh)

    cut = F.aggregate(F.col("__spans"), begin, step, lambda acc: F.concat(acc["out"], F.substring(value, acc["at"] + 1, F.length(value))))
    return found.select(*[F.when(F.size("__spans") > 0, cut).otherwise(value).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
